"""Spelling variants, sharding and the prefix trie against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from cases import FOLD, documents, hard_rows
from pyspark.sql import functions as F

from corpuspipe.llm import conversation_trie, sharding, spelling


# Spelling variants


def brute_vocabulary(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_variants(rows):
    words = brute_vocabulary(rows)
    near = {word: [w for w in words if one_apart(word, w)] for word in words}
    form = {}
    for word, own in near.items():
        best = min(own, key=lambda w: (-words[w], w)) if own else None
        form[word] = best if own and words[best] >= 2 * words[word] else None
    out = collections.Counter()
    for word, n in words.items():
        root = word
        while form[root]:
            root = form[root]
        out[word, form[word], root, n, len(near[word]), words.get(form[word])] += 1
    return out


def variant_rows(seed, alphabet, lengths, words=120):
    """Words, each with variants of fewer and fewer occurrences, so that chains of forms arise."""
    rnd = random.Random(seed)
    rows, text = [], []
    for k in range(words):
        word = "".join(rnd.choice(alphabet) for _ in range(rnd.choice(lengths)))
        for step in range(4):
            text += [word] * rnd.choice((3, 4, 7, 12, 30) if step else (3, 40, 90))
            place = rnd.randrange(len(word) + 1)
            word = rnd.choice(
                (word[:place] + rnd.choice(alphabet) + word[place:], word[:place] + word[place + 1 :], word[:place] + rnd.choice(alphabet) + word[place + 1 :])
            )
    rnd.shuffle(text)
    for k in range(0, len(text), 50):
        rows.append((k, rnd.choice((" ", "-", "1", "\n")).join(w.upper() if rnd.random() < 0.1 else w for w in text[k : k + 50])))
    return rows


@pytest.mark.parametrize("block_words,block_letters", [(2_048, 1 << 18), (4, 1 << 18), (2_048, 40)])
def test_spelling_variants_match_all_pairs(spark, monkeypatch, block_words, block_letters):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(spelling, "BLOCK_LETTERS", block_letters)
    rows = hard_rows() + variant_rows(1, "abÀÿ×", (5, 6, 7)) + variant_rows(2, "abcdefghij", (5, 9, 14))
    rows += [(9_000, "a" * 700 + " " + "a" * 701), (9_001, ("a" * 701 + " ") * 3), (None, ("a" * 700 + " ") * 2), (None, None), (9_000, "a" * 700)]
    found = spelling.spelling_variants(documents(spark, rows)).collect()
    expected = brute_variants(rows)
    assert any(key[1] and key[2] != key[1] for key in expected)
    assert collections.Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found) == expected


def test_block_finds_all_pairs_of_its_groups():
    rnd = random.Random(3)
    for shorter in (1, 2, 5):
        words = ["".join(rnd.choice("abc") for _ in range(shorter + rnd.randrange(2))) for _ in range(150)]
        group = np.array([rnd.randrange(3) for _ in words])
        differ = np.array([rnd.randrange(min(3, shorter) + 1) for _ in range(3)])[group]
        letters = np.zeros((150, shorter + 1), dtype=np.uint8)
        for k, word in enumerate(words):
            letters[k, : len(word)] = list(word.encode())
        lengths = np.array([len(word) for word in words])
        asked, found = spelling.near_in_block(letters, lengths, group, differ, shorter)
        expected = {
            (a, b)
            for a in range(150)
            for b in range(150)
            if group[a] == group[b] and one_apart(words[a], words[b]) and min(lengths[a], lengths[b]) == shorter
            and not (differ[a] and words[a][: differ[a]] == words[b][: differ[a]])
        }
        assert set(zip(asked.tolist(), found.tolist())) == expected and len(asked) == len(expected)


def test_long_texts_are_searched_in_pieces(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "one two threefourfive six, seven" * 5
    assert [run for piece in spelling.pieces(text) for run in spelling.RUN.findall(piece)] == spelling.RUN.findall(text)


# Sharding


def check_shards(rows, found, shards):
    texts = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in found) == texts
    places = collections.defaultdict(list)
    for r in found:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        places[r.shard].append(r.slot)
    assert all(sorted(own) == list(range(len(own))) for own in places.values())
    loads = [sum(r.size for r in found if r.shard == k) for k in range(shards)]
    assert max(loads) - min(loads) <= max(r.size for r in found)


def test_sharding_is_whole_gapless_and_even(spark):
    rows = hard_rows() + [(7, "the same row " * 4)] * 900 + [(None, None)] * 300 + [(k, f"row {k} " * (k % 40)) for k in range(500)]
    found = sharding.shard_documents(documents(spark, rows)).collect()
    check_shards(rows, found, 8)
    # Copies of a row are spread as well.
    assert len({r.shard for r in found if r.doc_id == 7}) == 8
    again = sharding.shard_documents(documents(spark, rows[::-1]).repartition(5)).collect()
    key = lambda r: (r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.virtual_slot)
    assert collections.Counter(map(key, found)) == collections.Counter(map(key, again))


def test_map_versions_are_edited(spark, tmp_path):
    path = str(tmp_path / "map")
    rows = [(k, "x" * (k % 97)) for k in range(3_000)]
    found = sharding.shard_documents(documents(spark, rows), 4, path).collect()
    check_shards(rows, found, 4)
    slot_map = sharding.SlotMap(spark, path)
    assert slot_map.versions() == [0, 1] and {r.map_version for r in found} == {1}
    first = {r.slot: r.shard for r in slot_map.read(1).collect()}
    assert set(first) == set(range(sharding.SLOTS))
    version = slot_map.write(sharding.grown(slot_map.read(), 4))
    second = {r.slot: r.shard for r in slot_map.read(version).collect()}
    moved = {slot for slot in first if first[slot] != second[slot]}
    assert {second[slot] for slot in moved} == {4}
    assert sharding.SLOTS // 5 - 5 <= len(moved) <= sharding.SLOTS // 5 + 5
    # Rows that are added later find their slots in the map that is there.
    more = sharding.shard_documents(documents(spark, rows + [(k, "y") for k in range(3_000, 3_100)]), 5, path).collect()
    assert {r.shard for r in more} == {0, 1, 2, 3, 4}
    # A broken-off edit is no version.
    (tmp_path / "map" / "version=4").mkdir()
    assert slot_map.versions() == [0, 1, 2, 3]
    assert slot_map.write(slot_map.read()) == 4 and slot_map.versions()[-1] == 4


# Prefix trie


def brute_trie(rows):
    own = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv_id].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(role, text) for *_, role, text in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(node[:-1] for node in members if node)
    out = collections.Counter()
    for node, own_members in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(own_members) if len(rebuilt[c]) == len(node))
        words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        out[
            min(own_members), len(node), min(members[node[:-1]]) if node else None, len(own_members), children[node],
            sum(not children[n] for n in below), sum((len(members[n]) - 1) * words(n) for n in below),
            hashlib.sha256(ends.encode()).hexdigest(),
        ] += 1
    return out


def conversations(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return table.withColumns({name: F.lit(name) for name in ("place", "digest", "k1", "depth", "rows", "weight", "part", "at", "end", "base")})


def conversation_rows():
    rnd = random.Random(11)
    rows = []
    for c in (*range(-25, 130), 400, 433):
        for turn in range(rnd.randrange(7)):
            rows.append((c, turn if rnd.random() < 0.9 else None, rnd.choice(("user", "assistant", None)), rnd.choice(("a b", "", None, "c", "d\te\n f", " x\x85y é"))))
    rows += [(500 + c, turn, "user", f"same {turn}") for c in range(160) for turn in range(4)]
    rows += [(700, turn, "user", str(turn)) for turn in range(600)] + [(700, 5, "user", "5")] * 40
    rows += [(None, 0, "user", "nobody"), (801, 1, "", "only"), (802, 1, "u", ":x"), (803, 1, "u:", "x")]
    rnd.shuffle(rows)
    return rows


def test_prefix_trie_matches_a_walk(spark):
    rows = conversation_rows()
    expected = brute_trie(rows)
    table = conversations(spark, rows)
    for coalesced, frame in (("true", table), ("false", table.repartition(9))):  # one range, and conversations over several
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
        try:
            found = conversation_trie.prefix_trie(frame).collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
        assert collections.Counter(tuple(r[name] for name in names) for r in found) == expected


def test_long_lists_of_ends_are_hashed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PACKED_BYTES", 20)
    rows = [(c, 0, "user", "hello") for c in range(0, 4_000, 4)]
    found = conversation_trie.prefix_trie(conversations(spark, rows)).collect()
    assert collections.Counter(tuple(r) for r in found) == brute_trie(rows)


def test_empty_tables_have_no_groups(spark):
    assert spelling.spelling_variants(documents(spark, [])).count() == 0
    assert spelling.spelling_variants(documents(spark, [(1, None), (2, "")])).count() == 0
    assert sharding.shard_documents(documents(spark, [])).count() == 0
    assert conversation_trie.prefix_trie(conversations(spark, [])).count() == 0
    assert conversation_trie.prefix_trie(conversations(spark, [(None, 1, "a", "b")])).count() == 0
