"""Exact, near and substring de-duplication against brute force."""

import collections
import hashlib
import random

from cases import FOLD, documents, hard_rows, shingles, words

from corpuspipe.llm import exact_dedup, jaccard_join, substring_dedup
from corpuspipe.llm.jaccard_join import Bands, jaccard_components, without_near_copies


def by_fold(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(FOLD)].append(doc_id)
    return groups


def test_exact_dedup_matches_grouping(spark):
    rows = hard_rows()
    found = exact_dedup.exact_dedup(documents(spark, rows), capacity=8).collect()
    expected = collections.Counter()
    for body, ids in by_fold(rows).items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        for doc_id in ids:
            expected[doc_id, keep, len(ids), hashlib.sha256(body.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected
    assert sum(r.kept for r in found) == len(by_fold(rows))


def test_directory_doubles_until_buckets_fit(spark):
    rows = [(k, f"text {k}") for k in range(600)]
    index = exact_dedup.build_index(documents(spark, rows), capacity=40)
    assert index.depth >= 4
    assert index.directory.count() == 1 << index.depth
    assert index.entries.groupBy("bucket").count().agg({"count": "max"}).first()[0] <= 40
    assert index.entries.count() == 600
    assert index.directory.select("local_depth").distinct().count() >= 1


def test_without_copies_keeps_one_row_of_each_text(spark):
    rows = hard_rows()
    docs = documents(spark, rows)
    stay = exact_dedup.without_copies(docs)
    assert stay.columns == docs.columns
    kept = stay.collect()
    assert len(kept) == len(by_fold(rows))
    assert {(r.text or "").translate(FOLD) for r in kept} == set(by_fold(rows))


def brute_components(rows, n, num, den):
    sets = [shingles(text, n) for _, text in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    members = collections.defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        members[root(k)].append(doc_id)
    out = collections.Counter()
    for k, (doc_id, _) in enumerate(rows):
        known = [i for i in members[root(k)] if i is not None]
        out[doc_id, len(sets[k]), min(known) if known else None] += 1
    return out


def family(size, seed):
    """Near copies whose similarity lies around the threshold, so that one key joins several components."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    out = []
    for _ in range(size):
        text = list(base)
        for _ in range(rnd.randint(0, 14)):
            text[rnd.randrange(len(text))] = f"w{rnd.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def test_jaccard_components_match_all_pairs(spark):
    for n, num, den in ((3, 90, 100), (5, 80, 100)):
        rows = hard_rows(seed=n)
        rows += list(enumerate(family(60, n), 1000))
        found = jaccard_components(documents(spark, rows), n, num, den).collect()
        assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows, n, num, den)


def test_bands_hold_all_partners():
    for num, den in ((90, 100), (80, 100), (1, 2)):
        bands = Bands(num, den)
        for large in (*range(1, 400), 5_000, 123_456):
            smallest = -(-large * num // den)
            of_large, of_small = bands.of([large, smallest])
            assert of_small >= of_large - 1
            assert of_small == of_large or smallest >= bands.least[of_large]
            assert bands.used[of_large] > (large + large) * (den - num) // (den + num)


def passages(seed, size):
    """Texts of ``size`` words and others that differ in one to a ninth of them, beside texts that share a third of them."""
    rnd = random.Random(seed)
    fresh = lambda count: [f"n{rnd.randrange(10**9)}" for _ in range(count)]
    out = []
    for _ in range(3):
        base = fresh(size)
        out.append(base)
        for changed in {1, size // 40, size // 20, size // 12, size // 9}:
            at = rnd.randrange(size - changed)
            out.append(base[:at] + fresh(changed) + base[at + changed :])
            out.append(base[: size - changed])
        for _ in range(12):
            at = rnd.randrange(size - size // 3)
            out.append(fresh(size // 3) + base[at : at + size // 3] + fresh(size // 3))
    return [" ".join(text) for text in out]


def test_left_out_keys_lose_no_link(spark):
    rows = [(k, text) for k, text in enumerate(text for size in (12, 45, 90, 180, 400) for text in passages(size, size))]
    for n, num, den in ((3, 90, 100), (5, 80, 100)):
        docs = documents(spark, rows).repartition(7)
        found = jaccard_components(docs, n, num, den).collect()
        assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows, n, num, den)


def test_pairs_of_stars_grow_with_the_rows(spark, monkeypatch):
    base = [f"b{k}" for k in range(300)]  # a family of 1,770 pairs, each text with a few words of its own
    rows = [(k, " ".join(base + [f"r{k}x{j}" for j in range(6)])) for k in range(60)]
    compared = []
    near = jaccard_join.near_pairs

    def counted(pairs, sets, bands):
        compared.append(pairs.count())
        return near(pairs, sets, bands)

    monkeypatch.setattr(jaccard_join, "near_pairs", counted)
    found = jaccard_components(documents(spark, rows).repartition(4), 5, 80, 100).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows, 5, 80, 100)
    assert compared[0] <= 4 * len(rows)


def test_texts_that_share_a_passage_only_send_no_keys(spark, monkeypatch):
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join([f"a{k}x{j}" for j in range(120)] + passage + [f"z{k}x{j}" for j in range(120)])) for k in range(30)]
    with_keys = []
    near = jaccard_join.near_pairs

    def counted(pairs, sets, bands):
        with_keys.append(sets.count())
        return near(pairs, sets, bands)

    monkeypatch.setattr(jaccard_join, "near_pairs", counted)
    assert {r.component_id for r in jaccard_components(documents(spark, rows), 5, 80, 100).collect()} == set(range(30))
    assert with_keys == [0]


def test_without_near_copies(spark):
    rows = [(k, text) for k, text in enumerate(family(20, 3))] + [(50, None), (51, ""), (52, "alone here")]
    docs = documents(spark, rows)
    stay = without_near_copies(docs, 5, 80, 100)
    assert stay.columns == docs.columns
    components = {component for (_, _, component) in brute_components(rows, 5, 80, 100)}
    assert {r.doc_id for r in stay.collect()} == components


def brute_substring(rows, window=13):
    least = {}
    no_id = float("inf")
    key = lambda doc_id: no_id if doc_id is None else doc_id
    for doc_id, text in rows:
        own = words(text)
        for i in range(len(own) - window + 1):
            body = tuple(own[i : i + window])
            least[body] = min(least.get(body, no_id), key(doc_id))
    out = collections.Counter()
    for doc_id, text in rows:
        own = words(text)
        gone = set()
        for i in range(len(own) - window + 1):
            if least[tuple(own[i : i + window])] < key(doc_id):
                gone.update(range(i, i + window))
        out[doc_id, len(own), len(gone), b" ".join(w for k, w in enumerate(own) if k not in gone).decode()] += 1
    return out


def test_substring_dedup_matches_all_windows(spark):
    rows = hard_rows()
    for partitions in (1, 7):  # one block, and one for each partition
        found = substring_dedup.remove_repeats(documents(spark, rows).repartition(partitions)).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == brute_substring(rows)


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.without_copies(empty).count() == 0
    assert jaccard_components(empty, 3, 90, 100).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
