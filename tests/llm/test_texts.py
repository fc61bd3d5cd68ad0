"""Operators on single texts, pages and labels: against libraries, brute force and planted cases."""

import base64
import collections
import hashlib
import json
import random
import re
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from cases import CLASHING, FOLD, documents, hard_rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from corpuspipe.llm import bpe, decontaminate, license_scan, main_text, quality, queries, url_filter, warc

SMALL = "/root/testdata/sf0.001"

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


ALPHABET = st.text(st.sampled_from(list("abt he'sS12.!\n\t \x85\xa0　é中😀́²_")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.one_of(ALPHABET, st.text(max_size=40)))
def test_tree_of_small_leaves_is_the_library(text):
    kept = bpe.LEAF_CHARS, bpe.LEAF_BYTES, bpe.HEAP_BYTES, bpe.LEAF_IDS
    try:
        for bpe.LEAF_CHARS, bpe.LEAF_BYTES, bpe.HEAP_BYTES, bpe.LEAF_IDS in ((3, 1, 4, 2), (1, 2, 128, 1), kept):
            codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
            ids = codec.encode(text)
            assert ids.tolist() == LIBRARY.encode_ordinary(text)
            assert codec.decode(ids) == text.encode()
    finally:
        bpe.LEAF_CHARS, bpe.LEAF_BYTES, bpe.HEAP_BYTES, bpe.LEAF_IDS = kept


def test_long_stretches_without_borders():
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for text in ("a" * 20_000, " " * 50_000, "ab" * 9_000, "\n" * 300 + "x" + " " * 300):
        assert codec.encode(text).tolist() == LIBRARY.encode_ordinary(text)


def test_words_of_a_group_are_encoded_together():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abtheé中😀 's1.\n\x85\t") for _ in range(rnd.randint(0, 30))) for _ in range(3_000)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 60))) for _ in range(200)]
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    ids, offsets = codec.encode_all(texts)
    assert [ids[low:high].tolist() for low, high in zip(offsets, offsets[1:])] == [LIBRARY.encode_ordinary(text) for text in texts]
    pieces = [piece.encode() for piece in {text[:12] for text in texts} if piece]
    merged, counts = codec.merged_together(pieces)
    assert counts.sum() == len(merged)
    assert [part.tolist() for part in np.split(merged, np.cumsum(counts)[:-1])] == [codec.merged(piece) for piece in pieces]


def test_unknown_ids_fail():
    with pytest.raises(ValueError):
        bpe.Codec(RANKS, public_tokenizers.PATTERN).decode(np.array([60_000]))


def test_bpe_rows(spark):
    rows = hard_rows()
    coded = bpe.round_trip(documents(spark, rows).drop("ids"), "byte_bpe_50k.tiktoken", public_tokenizers.PATTERN)
    found = collections.Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in coded.collect())
    assert found == collections.Counter((i, tuple(LIBRARY.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    again = bpe.decode(coded.select("doc_id", "ids"), "byte_bpe_50k.tiktoken").collect()
    assert collections.Counter((r.doc_id, bytes(r.decoded)) for r in again) == collections.Counter((i, (t or "").encode()) for i, t in rows)


def pages(spark, rows):
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    return table.withColumns({name: F.lit(name) for name in ("host", "path", "digest", "removed", "text", "original", "rule")})


def test_warc_round_trip(spark):
    rows = [(1, "http://a/é", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "b\r\nc%0A", ""), (4, "d", None), (5, "e", "\r\n\r\nWARC/1.1" * 50)]
    rows += [(k, f"u{k}", "same" * 500) for k in range(10, 30)] + [(30, "l", "é" * 300_000), (2, None, "<p>x</p>"), (None, "n", "x")]
    found = collections.Counter(
        (r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages(spark, rows)).collect()
    )
    least = {}
    for page_id, _, html in rows:
        if page_id is not None:
            least[html or ""] = min(least.get(html or "", page_id), page_id)
    expected = collections.Counter()
    for page_id, url, html in rows:
        data = (html or "").encode()
        first = least.get(html or "")
        revisit = first is not None and first != page_id
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected[page_id, url, len(data), digest, "revisit" if revisit else "response", first if revisit else None] += 1
    assert found == expected


def test_warc_least_bytes_and_empty(spark):
    rows = [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long enough"), (4, "d", "long enough")]
    found = {r.page_id: r.record_type for r in warc.round_trip(pages(spark, rows), least_bytes=5).collect()}
    assert found == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_warc_streams_in_small_pieces(monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "READ_BYTES", 7)
    import gzip
    import io

    whole = [warc.record(k, f"u{k}", b"z" * (k * 91), None, False) for k in range(20)]
    stream = gzip.compress(b"".join(whole[:9])) + gzip.compress(b"".join(whole[9:]))
    assert list(warc.records(warc.inflated(io.BytesIO(stream)))) == whole
    with pytest.raises(ValueError):
        list(warc.records(warc.inflated(io.BytesIO(stream[:-20]))))


def test_normaliser_writes_one_member_for_each_record(spark, tmp_path):
    rows = [(k, f"u{k}", f"<p>{k}</p>") for k in range(12)]
    mixed, single = str(tmp_path / "mixed"), str(tmp_path / "single")
    index = warc.normalise(warc.write_archives(warc.with_originals(pages(spark, rows)), mixed), mixed, single).collect()
    assert len(index) == 12
    import zlib

    for row in index:
        data = (tmp_path / "single" / row.archive).read_bytes()[row.offset : row.offset + row.length]
        one = zlib.decompressobj(31)
        headers, _ = warc.split_record(one.decompress(data))
        assert one.eof and not one.unused_data and headers["warc-record-id"] == row.record_id
        beside = [json.loads(line) for line in (tmp_path / "single" / f"{row.archive}.index").read_text().splitlines()]
        assert row.asDict() in beside


def test_url_rules_and_list(spark):
    cases = [
        ("http://x.org/", "org/", "allow"), ("HTTP://A.Example.ORG/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org/en/1", "block"), ("http://com/fr/", "com/fr/", "allow"),
        ("http://notorg/", None, "allow"), ("no scheme.org/", None, "allow"), (None, None, "allow"), ("", None, "allow"),
        ("https://www.bad.net/a/?utm_x=1&b=2&a=1#f", None, "block"), ("ftp://bad.net:80/a?a=1&b=2", None, "block"),
        ("http://bad.net/b", None, "allow"), ("://x.com?/de/", None, "allow"), ("http://x.com/de/?a", "com/de/", "block"),
    ]
    rows = [(k, url, None) for k, (url, _, _) in enumerate(cases)]
    listed = spark.createDataFrame([("bad.net/a?a=1&b=2",), ("bad.net/a?a=1&b=2",), (None,)], "canonical string")
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages(spark, rows), listed).collect()}
    assert found == {k: (rule, verdict) for k, (_, rule, verdict) in enumerate(cases)}
    empty = listed.limit(0)
    assert url_filter.judge_urls(pages(spark, rows), empty).where("verdict = 'block'").count() == 3
    assert url_filter.judge_urls(pages(spark, []), listed).count() == 0


def test_bloom_filter_never_loses_and_join_removes_the_rest(spark):
    rows = [(k, f"http://h{k}.net/p", None) for k in range(3_000)]
    listed = spark.createDataFrame([(f"h{k}.net/p",) for k in range(0, 3_000, 3)], "canonical string")
    found = url_filter.judge_urls(pages(spark, rows), listed)
    assert {r.page_id for r in found.where("verdict = 'block'").collect()} == set(range(0, 3_000, 3))


def test_quality_keeps_clean_and_rejects_junk(spark):
    rnd = random.Random(5)
    clean_words, junk_words = [f"clean{k}" for k in range(300)], [f"SPAM{k}!!" for k in range(300)]
    rows, labels = [], []
    for k in range(400):
        junk = k % 5 == 0
        rows.append((k, " ".join(rnd.choice(junk_words if junk else clean_words) for _ in range(rnd.randint(30, 120)))))
        if k % 2:
            labels.append((k, int(not junk), 0))
    rows += [(1_000, None), (1_001, ""), (None, "clean1 clean2 clean3"), (3, rows[3][1])]
    labels += [(3, 1, 0), (None, 1, 0), (7, None, None)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = quality.resample(documents(spark, rows), marks).collect()
    assert len(found) == len(rows)
    junk = [r for r in found if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 5 == 0]
    clean = [r for r in found if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 5]
    assert not any(r.kept for r in junk) and sum(not r.kept for r in clean) <= 4
    assert sorted(r.sample_rank for r in found) == list(range(1, len(rows) + 1))
    docs = documents(spark, rows)
    assert quality.without_rejected(docs, marks).columns == docs.columns
    assert all(r.kept for r in quality.resample(docs, marks.limit(0)).collect())
    assert quality.resample(documents(spark, []), marks).count() == 0


def test_quality_counts_every_target_row(spark):
    import inspect

    marks = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.target_ids(marks).count() == 60_000 and "target_rows" not in inspect.signature(quality.resample).parameters
    halves = spark.createDataFrame([("a b", 0), ("a c", 1), ("a", None), ("a", 1)], "text string, target_half int")
    rows = [tuple(row)[1:] for row in quality.feature_counts(halves, 1 << 12).collect()]
    assert sum(raw for raw, _, _ in rows) == 8 and (4, 1, 2) in rows
    values = spark.createDataFrame([(float(k * k),) for k in range(100)], "x double")
    for share in (0.0, 0.0001, 0.3, 1.0):
        assert quality.quantile(values, "x", share) == pytest.approx(values.agg(F.percentile("x", share)).first()[0])
    assert quality.quantile(values.limit(0), "x", 0.5) is None


def test_licences_against_brute_force(spark):
    extra = [
        "Released under the MIT License.", "released under teh mit license", "MIT license apache LICENSE general public license",
        "mit licensed", "x" * 3000 + " mit--license", "Permission is hereby grantd, free of charge, to any person obtaining a copy",
        "Licensed under CC BY-NC 4.0.", "permission is granted to no one", "mit license " * 50, "é mit license",
    ]
    rows = hard_rows() + list(enumerate(extra, 5_000))
    found = license_scan.scan_licenses(documents(spark, rows)).collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    expected = collections.Counter()
    for doc_id, text in rows:
        own = word.findall((text or "").translate(FOLD))
        places = [
            (k, label)
            for phrase, label in license_scan.PHRASES
            for k in range(len(own))
            if own[k : k + len(phrase.split())] == phrase.split()
        ]
        expected[doc_id, len(own), tuple(sorted(places))] += 1
    assert collections.Counter((r.doc_id, r.n_words, tuple(sorted((b.word, b.label) for b in r.base))) for r in found) == expected
    notices = {r.doc_id: [(n.label, n.errors) for n in r.notices] for r in found if r.doc_id is not None}
    assert notices[5_000] == [("mit", 0)] and notices[5_005] == [("mit", 1)] and notices[5_006] == [("cc-by-nc", 0)]
    assert notices[5_007] == [] and notices[5_003] == []
    spans = {r.doc_id: r.notices for r in found if r.doc_id == 5_000}
    assert extra[0].encode()[spans[5_000][0].start : spans[5_000][0].end] == b"Released under the MIT License"
    assert license_scan.scan_licenses(documents(spark, [])).count() == 0


def test_notice_found_with_every_single_edit():
    import pyarrow as pa

    scanner = license_scan.Scanner(license_scan.NOTICES)
    for number, (text, label) in enumerate(license_scan.NOTICES):
        if not scanner.notices[number].errors:
            continue
        edits = [text[:k] + text[k + 1 :] for k in range(1, len(text) - 1)] + [text[:k] + "q" + text[k:] for k in range(1, len(text) - 1)]
        edits = [edit for edit in edits if "  " not in edit]  # a word of one letter went: two errors
        batch = pa.record_batch([pa.array(range(len(edits)), pa.int64()), pa.array([f"so it is {e} or not" for e in edits])], names=["doc_id", "text"])
        for hits in license_scan._scan(batch, scanner).column(3).to_pylist():
            assert any(hit["label"] == label and hit["errors"] <= 1 for hit in hits), (text, hits)


def test_many_notices_in_one_text():
    """The time of a text grows with its notices, not with their square; the longer notice stands for one inside it."""
    import pyarrow as pa

    scanner = license_scan.Scanner(license_scan.NOTICES)
    text = "licensed under a creative commons attribution sharealike then released under the mit license now " * 10_000
    batch = pa.record_batch([pa.array([1], pa.int64()), pa.array([text])], names=["doc_id", "text"])
    began = time.monotonic()
    hits = license_scan._scan(batch, scanner).column(3).to_pylist()[0]
    assert time.monotonic() - began < 60
    assert [hit["label"] for hit in hits] == ["cc-by-sa", "mit"] * 10_000
    assert [hit["first_word"] for hit in hits] == [14 * k + at for k in range(10_000) for at in (0, 8)]


def test_licence_query_against_brute_force(spark, tmp_path):
    """The query's own columns, on documents of the test table and planted notices with errors."""
    import regex

    rnd = random.Random(6)
    rows = [r for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect() if len(r.text) < 1_500]
    rows = [(r.doc_id, r.text) for r in rows]
    for number, (text, _) in enumerate(license_scan.NOTICES):
        broken = list(text)
        for _ in range(rnd.randrange(4)):
            broken[rnd.randrange(len(broken))] = rnd.choice("qxz")
        rows.append((100_000 + number, f"So it was. {''.join(broken).title()}! And then on"))
    rows += [(200_000, None), (200_001, "")]
    documents(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op7_license_scan(spark, str(tmp_path)).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    shapes = [license_scan.notice(*each) for each in license_scan.NOTICES]
    patterns = [[regex.compile(rf"\b(?:{' '.join(n.words)}){{e<={k}}}\b") for k in range(n.errors + 1)] for n in shapes]
    assert len(found) == len(rows)
    for doc_id, text in rows:
        own = word.findall((text or "").translate(FOLD))
        places = [
            (k, label)
            for phrase, label in license_scan.PHRASES
            for k in range(len(own))
            if own[k : k + len(phrase.split())] == phrase.split()
        ]
        joined, errors = " ".join(own), {}
        for number, each in enumerate(patterns):
            if each[-1].search(joined):
                errors[number] = next(k for k, pattern in enumerate(each) if pattern.search(joined))
        got, base = found[doc_id], {label for _, label in places}
        assert (got.n_words, got.n_base, got.base_labels) == (len(own), len(places), ",".join(sorted(base)))
        assert (got.first_word, got.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        inside = {"cc-by"} if {"cc-by-sa", "cc-by-nc"} & {shapes[n].label for n in errors} else set()
        assert got.labels == ",".join(sorted(base | ({shapes[n].label for n in errors} - inside))), (doc_id, errors)
        if places or len(errors) < 2:
            best = max([1 - k / len(license_scan.NOTICES[n][0]) for n, k in errors.items()], default=0.0)
            assert got.score == pytest.approx(1.0 if places else best)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if(a<b){"</p>"}</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="page with-sidebar"><article><h1>Title &amp; more</h1><p>First <b>bold</b>face<br>next<p>Second&nbsp;part &lt;tag&gt;
<div class="ad">Buy</div><!-- <p>no</p> --><table><tr><td>a<td>b</table><form>Mail <input></form></article>
<section id="comments"><article class="comment">Nice</article></section></div><aside>Side</aside><footer>&copy; us</footer>"""


def test_main_text_of_marked_up_pages():
    assert main_text.main_text(PAGE) == "Title & more First boldface next Second part <tag> a b"
    assert main_text.main_text("") == ""
    assert main_text.main_text("plain < text &eacute;") == "plain < text é"
    assert main_text.main_text("<nav>only a menu</nav>") == ""


def test_style_tree_removes_what_a_host_repeats(spark):
    rnd = random.Random(2)
    sentence = lambda: " ".join(f"w{rnd.randrange(1000)}" for _ in range(12))
    bodies = [sentence() for _ in range(8)]
    rows = [
        (k, f"http://h.net/{k}", f"<body><div class=top>Welcome to our site</div><div class=text>{body}</div><div>Ring us</div></body>")
        for k, body in enumerate(bodies)
    ]
    rows += [(20, "http://other.net/", rows[0][2]), (21, None, None), (22, "http://h.net/x", "")]
    found = {r.page_id: r.text for r in main_text.extract(pages(spark, rows)).collect()}
    assert {k: found[k] for k in range(8)} == dict(enumerate(bodies))
    assert found[20] == f"Welcome to our site {bodies[0]} Ring us" and found[21] == "" and found[22] == ""
    assert main_text.extract(pages(spark, [])).count() == 0


def test_style_tree_decides_inside_articles_and_counts_distinct_pages_once(spark):
    rnd = random.Random(3)
    sentence = lambda: " ".join(f"w{rnd.randrange(1000)}" for _ in range(12))
    bodies = [sentence() for _ in range(6)]
    article = lambda body: f"<article><p>{body} <b>Note</b></p><div class=zz>Call our hotline now</div></article>"
    rows = [(k, "http://a.net/", f"<div>{k}</div>{article(body)}") for k, body in enumerate(bodies)]
    # Mostly copies: of whole pages, and of one article on pages that differ around it.
    rows += [(20 + k, "http://b.net/", f"<div class=x>{bodies[0]}</div>") for k in range(40)]
    rows += [(70 + k, "http://b.net/", f"<div class=x>{body}</div>") for k, body in enumerate(bodies)]
    rows += [(80 + k, "http://c.net/", f"<div>{k}</div>{article(bodies[0])}") for k in range(9)]
    rows += [(90 + k, "http://d.net/", f"<article><h1>{k}</h1><p>{bodies[1]}</p></article>") for k in range(9)]
    found = {r.page_id: r.text for r in main_text.extract(pages(spark, rows)).collect()}
    assert [found[k] for k in range(6)] == [f"{body} Note" for body in bodies]
    assert all(found[20 + k] == bodies[0] for k in range(40)) and [found[70 + k] for k in range(6)] == bodies
    assert all(found[80 + k] == f"{bodies[0]} Note Call our hotline now" for k in range(9))
    assert all(found[90 + k] == f"{k} {bodies[1]}" for k in range(9))
    tree = {(r.host, r.node): (r.pages, r.importance) for r in main_text.style_tree(pages(spark, rows).withColumn("host", F.regexp_extract("url", "//([^/]*)", 1))).collect()}
    assert tree["b.net", "/div.x"] == (6, pytest.approx(0.9)) and tree["a.net", "/article/div.zz"] == (6, pytest.approx(main_text.ARTICLE_PRIOR))


def plain_alignment(item, text):
    table, best = [[0] * (len(text) + 1) for _ in range(len(item) + 1)], 0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if a == b else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


def test_alignment_matches_the_plain_table():
    rnd = random.Random(4)
    for _ in range(200):
        item, text = ([rnd.randrange(6) for _ in range(rnd.randint(1, 25))] for _ in range(2))
        score, matches, first, last, item_first, item_last = decontaminate.smith_waterman(np.array(item), np.array(text))
        assert score == plain_alignment(item, text)
        if score:
            assert item[item_first] == text[first] and item[item_last] == text[last] and 0 < matches <= last - first + 1


def whole_table(item, text):
    """Alignment with all rows kept: the reference for the one that keeps few."""
    m, n = len(item), len(text)
    slope, table = -np.arange(n + 1), np.zeros((m + 1, n + 1), dtype=np.int64)
    same = item[:, None] == text[None, :]
    for i in range(1, m + 1):
        table[i, 1:] = np.maximum(np.maximum(table[i - 1, 1:] - 1, table[i - 1, :-1] + np.where(same[i - 1], 2, -1)), 0)
        table[i] = np.maximum.accumulate(table[i] - slope) + slope
    i, j = divmod(int(table.argmax()), n + 1)
    score, ends, matches = int(table[i, j]), (j - 1, i - 1), 0
    while table[i, j] > 0:
        if table[i, j] == table[i - 1, j - 1] + (2 if same[i - 1, j - 1] else -1):
            matches, i, j = matches + bool(same[i - 1, j - 1]), i - 1, j - 1
        elif table[i, j] == table[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return score, matches, j, ends[0], i, ends[1]


def test_alignment_in_little_memory_is_the_whole_table():
    pick = np.random.default_rng(5)
    for _ in range(300):
        item, text = (pick.integers(0, 5, pick.integers(1, 60)).astype(np.uint64) for _ in range(2))
        assert decontaminate.smith_waterman(item, text) == whole_table(item, text)
    item = pick.integers(0, 10**6, 6_000).astype(np.uint64)
    copy = np.delete(item, pick.integers(0, 6_000, 300))
    copy[pick.integers(0, len(copy), 300)] = 7
    text = np.concatenate([pick.integers(0, 10**6, 5_000).astype(np.uint64), copy, pick.integers(0, 10**6, 5_000).astype(np.uint64)])
    tracemalloc.start()
    found = decontaminate.smith_waterman(item, text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20  # the whole table has 6,000 x 16,000 numbers
    assert found[0] > 2 * 6_000 * 0.8 and abs(found[2] - 5_000) < 10


def test_leaks_are_found_and_clean_texts_are_not(spark):
    rnd = random.Random(9)
    vocabulary = [f"v{rnd.randrange(10**5)}" for _ in range(3_000)]
    line = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(line(rnd.randint(12, 50)))) for k in range(30)] + [(40, None), (41, ""), (42, "two words")]
    rows, expected = [], set()
    for k in range(200):
        words = line(rnd.randint(5, 300))
        if k % 10 == 0:
            item = k // 10
            copy = items[item][1].upper().split()
            for _ in range(len(copy) // 9):
                copy[rnd.randrange(len(copy))] = "changed"
            words[len(words) // 2 : len(words) // 2] = copy
            expected.add((k, item))
        rows.append((k, " ".join(words)))
    rows += [(300, " ".join(line(20_000)) + " " + items[25][1]), (301, None), (302, ""), (303, items[26][1]), (303, items[26][1])]
    expected |= {(300, 25), (303, 26)}
    docs = documents(spark, rows)
    tests = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("gram", F.lit(1))
    found = decontaminate.find_leaks(docs, tests).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected and len(found) == len(expected) + 1
    many = decontaminate.find_leaks(docs, tests, words_per_pass=300).collect()
    assert {(r.doc_id, r.item_id) for r in many} == expected
    stay = decontaminate.without_leaks(docs, tests)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == {i for i, _ in rows} - {i for i, _ in expected}
    assert decontaminate.find_leaks(documents(spark, []), tests).count() == 0
    assert decontaminate.find_leaks(docs, tests.limit(0)).count() == 0


def test_every_copy_at_the_level_is_found(spark):
    """Edited and cut copies, also beside a verbatim one and where all n-grams are common, against the whole table."""
    rnd = random.Random(12)
    line = lambda n, kinds: [f"u{rnd.randrange(kinds)}" for _ in range(n)]
    items = [line(40, 10**6) for _ in range(12)] + [line(50, 10**6), line(4, 10**6), line(7, 10**6), line(30, 3)]
    texts = list(items)
    for k, edits in enumerate((6, 7, 8, 9, 10, 6, 7, 8, 9, 10)):
        copy = list(items[k])
        for place in range(edits):
            copy[place * 40 // edits + (k > 4)] = "changed"
        texts.append(line(30, 10**6) + copy + line(30, 10**6))
    texts += [items[12][18:], items[12][:-18], items[12][18:] + ["end"], ["start", *items[12][:32]]]
    texts.append([word for a, b in zip(items[10][::2], items[10][1::2]) for word in (a, b, "and")])  # no three words in a row
    texts += [[*items[13][:2], "or", items[13][3]], items[14][:5], line(400, 3), items[12][24:]]
    found = decontaminate.find_leaks(
        documents(spark, [(k, " ".join(text)) for k, text in enumerate(texts)]),
        spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id long, text string"),
    ).collect()
    level = {
        (i, k): share
        for i, text in enumerate(texts)
        for k, item in enumerate(items)
        if (share := plain_alignment(item, text) / (2 * len(item))) >= decontaminate.LEAST_SCORE
    }
    assert {(r.doc_id, r.item_id): r.score for r in found} == level and len(level) >= len(texts) - 1


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder)
        assert after.columns == docs.columns, name
        before = after
    final = corpus_pipeline.run(spark, folder).collect()
    assert 0 < len(final) < docs.count()
    assert all(list(r.ids) == LIBRARY.encode_ordinary(r.text) and r.n_tokens == len(r.ids) for r in final)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id] == r.text for r in final)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


def test_stages_keep_the_values_of_all_columns(spark):
    folder = "/root/testdata/sf0.001"
    docs = documents(spark, hard_rows()[:60] + [(None, "no id"), (None, None)])
    texts = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        rows = [r.asDict() for r in after.collect()]
        assert rows and all(r[column] == column for r in rows for column in CLASHING), name
        if stage is corpus_pipeline.tokens:
            assert all(r["n_tokens_"] == len(r["ids_"]) and r["ids_"] == LIBRARY.encode_ordinary(r["text"]) for r in rows)
            assert len(rows) == sum(texts.values())
        else:
            assert after.columns == docs.columns, name
            assert not collections.Counter((r["doc_id"], r["text"]) for r in rows) - texts, name
