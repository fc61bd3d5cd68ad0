"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = str.maketrans(UPPER, UPPER.lower())

CLASHING = (
    "row", "key", "keys", "ids", "block", "rows", "kept", "component", "component_id", "host", "sha", "is_target", "_id", "_sha",
    "_hash", "_id_", "_hash_", "box", "id", "hash", "of_id", "n_tokens", "decoded", "text_hash", "a.b", "tick`s", "low", "x",
)


def texts(seed=7):
    """Invented texts: originals, copies with edits, a hot group of copies, shared passages, blanks of all kinds."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgéß中") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    line = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    out = []
    passage = line(40)
    for k in range(40):
        words = line(rnd.randint(5, 160))
        if k % 4 == 0:
            words[len(words) // 2 : len(words) // 2] = passage
        out.append(" ".join(words))
        if k % 3 == 0:
            edited = list(words)
            for _ in range(rnd.randint(1, 6)):
                edited[rnd.randrange(len(edited))] = rnd.choice(vocabulary)
            out.append("  ".join(edited) + "\n")
        if k % 5 == 0:
            out.append(" ".join(words).upper())
    family = line(120)
    for _ in range(25):
        edited = list(family)
        for _ in range(rnd.randint(0, 5)):
            edited[rnd.randrange(len(edited))] = rnd.choice(vocabulary)
        out.append("\t".join(edited))
    out += [out[0]] * 12
    out += ["", None, " \n ", "one", "One", "one two", "one two ", "\x00 \x85\xa0", "a" * 5000, "x y " * 3000, None, ""]
    return out


def documents(spark, rows):
    """A table like ``documents`` from (id, text) rows, with columns that operators might use themselves."""
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}
    )
    return table.withColumns({name: F.lit(name) for name in CLASHING})


def hard_rows(seed=7):
    rows = list(enumerate(texts(seed)))
    rows += [rows[3], rows[3], (None, "no id at all here"), (None, rows[5][1])]
    return rows


def words(text):
    return (text or "").encode().split()


def shingles(text, n):
    own = words((text or "").translate(FOLD))
    return {tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))} if own else set()
