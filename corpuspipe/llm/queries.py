"""The queries of the operators in this folder and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuspipe.llm import bpe, warc
from corpuspipe.llm.conversation_trie import prefix_trie
from corpuspipe.llm.decontaminate import find_leaks
from corpuspipe.llm.exact_dedup import exact_dedup
from corpuspipe.llm.jaccard_join import jaccard_components
from corpuspipe.llm.license_scan import NOTICES, scan_licenses
from corpuspipe.llm.main_text import extract
from corpuspipe.llm.quality import resample
from corpuspipe.llm.sharding import shard_documents
from corpuspipe.llm.spelling import spelling_variants
from corpuspipe.llm.substring_dedup import remove_repeats
from corpuspipe.llm.url_filter import judge_urls, spam_list
from corpuspipe.sources.tables import read_table

QUERIES = {}
TWINS = {}

# CRC-32 in SQL: the table from its rule, and the fold over the bytes of {text}.
CRC_TABLE = """
    SELECT list_transform(range(256), lambda b: list_reduce(range(8),
        lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, b::BIGINT)) AS steps
"""
CRC = """
    xor(4294967295::BIGINT, list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT),
        lambda v, b: xor(v >> 8, steps[(xor(v, b) & 255) + 1]), 4294967295::BIGINT))
"""


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            TWINS[name] = sql
        return function

    return add


@query("op1_ngram_jaccard_join")
def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(read_table(spark, folder, "documents"), n=3, num=90, den=100)


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    leaks = find_leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return leaks.drop("text_hash")


@query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.round_trip(
        read_table(spark, folder, "documents"), "byte_bpe_50k.tiktoken", public_tokenizers.PATTERN
    )
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op4_url_filter",
    """
    WITH parts AS (
        SELECT page_id, url,
            CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
            CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path,
            list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1, 's'), '&'),
                lambda part: part <> '' AND NOT regexp_matches(part, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS asked
        FROM pages
    ), named AS (
        SELECT *, CASE WHEN host <> '' THEN
            regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
            || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS canonical
        FROM parts
    ), rules(of_host, of_path, says) AS (
        VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
               ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
    ), fitting AS (
        SELECT page_id, max_by(of_host || of_path, length(of_host || of_path)) AS rule,
            max_by(says, length(of_host || of_path)) AS says
        FROM named JOIN rules ON (host = of_host OR suffix(host, '.' || of_host)) AND starts_with(path, of_path)
        GROUP BY page_id
    ), listed AS (
        SELECT DISTINCT canonical FROM named
        WHERE canonical IS NOT NULL AND regexp_matches(host, 'cheap-pills|casino-win|free-bets|ads-track')
    )
    SELECT n.page_id, n.url, n.host, n.path, n.canonical, f.rule, l.canonical IS NOT NULL AS listed,
        coalesce(f.says, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
    FROM named n LEFT JOIN fitting f USING (page_id) LEFT JOIN listed l ON n.canonical = l.canonical
    """,
)
def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    return judge_urls(pages, spam_list(pages))


@query(
    "op5_warc",
    """
    WITH hashed AS (
        SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
    ), first AS (
        SELECT payload, min(page_id) AS original FROM hashed GROUP BY payload
    ), groups AS (
        SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::INTEGER) AS bits
        FROM hashed JOIN first USING (payload)
    )
    SELECT page_id, strlen(payload) AS payload_bytes,
        array_to_string(list_transform(bits, lambda v: array_to_string(list_transform([15, 10, 5, 0],
            lambda shift: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> shift) & 31) + 1, 1)), '')), '') AS payload_digest,
        CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> original THEN original END AS refers_to
    FROM groups
    """,
)
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(read_table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op6_quality")
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return resample(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    lengths = F.array(*(F.lit(len(text)) for text, _ in NOTICES))
    exactness = F.transform("notices", lambda hit: 1 - hit["errors"] / F.get(lengths, hit["notice"]))
    return scan_licenses(read_table(spark, folder, "documents")).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base.label", "notices.label")), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(exactness), F.lit(0.0))).alias("score"),
        F.col("notices"),
    )


# Blocks are kept apart by line ends; inline tags go without a trace. The references are those the table holds.
@query(
    "op8_main_text",
    r"""
    WITH article AS (
        SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages
    ), plain AS (
        SELECT page_id, url, regexp_replace(regexp_replace(body,
            '</?(p|h1|h2|h3|br|ul|li|div)( [^>]*)?>', chr(10), 'gs'), '<[^>]*>', '', 'gs') AS body FROM article
    ), decoded AS (
        SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(body,
            '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&copy;', '©'),
            '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS text
        FROM plain
    )
    SELECT page_id, url, text, length(text) AS n_chars FROM decoded
    """,
)
def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    texts = extract(read_table(spark, folder, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query(
    "op9_substring_dedup",
    r"""
    WITH split AS (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
        FROM documents
    ), windows AS (
        SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS body
        FROM split, unnest(range(1, len(words) - 11)) AS places(i)
    ), least AS (
        SELECT body, min(doc_id) AS least FROM windows GROUP BY body
    ), gone AS (
        SELECT DISTINCT doc_id, i + k AS place
        FROM windows JOIN least USING (body), unnest(range(0, 13)) AS steps(k)
        WHERE doc_id > least
    ), gone_of AS (
        SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id
    ), kept AS (
        SELECT doc_id, words, coalesce(len(places), 0) AS n_removed,
            CASE WHEN places IS NULL THEN words
                 ELSE list_filter(words, lambda w, i: NOT list_contains(places, i)) END AS kept
        FROM split LEFT JOIN gone_of USING (doc_id)
    )
    SELECT doc_id, len(words)::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
        sha256(array_to_string(kept, ' ')) AS kept_sha256
    FROM kept
    """,
)
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(read_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


@query(
    "op10_exact_dedup",
    """
    WITH folded AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
        FROM documents
    ), grouped AS (
        SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM folded GROUP BY body
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
    FROM folded JOIN grouped USING (body)
    """,
)
def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(read_table(spark, folder, "documents"))


@query(
    "op11_spelling_variants",
    f"""
    WITH RECURSIVE crc AS ({CRC_TABLE}), runs AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents
    ), counted AS (
        SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run
    ), marked AS (
        SELECT run, n, {CRC.format(text="coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM counted, crc
    ), words AS (
        SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word,
            sum(n)::BIGINT AS n
        FROM marked GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
    ), shorter AS (
        SELECT word, n, k, left(word, k) || substr(word, k + 2) AS rest FROM words, unnest(range(length(word)::INTEGER)) AS places(k)
    ), pairs AS (
        SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
    ), best AS (
        SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM pairs GROUP BY word
    ), forms AS (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
            CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
        FROM words w LEFT JOIN best USING (word)
    ), chains AS (
        SELECT word, word AS at FROM forms
        UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL
    ), ends AS (
        SELECT c.word, c.at AS root FROM chains c JOIN forms f ON c.at = f.word WHERE f.form IS NULL
    )
    SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e USING (word)
    """,
)
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(read_table(spark, folder, "documents"))


@query(
    "op12_sharding",
    f"""
    WITH RECURSIVE crc AS ({CRC_TABLE}), read AS (
        SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {CRC.format(text="coalesce(text, '')")} AS text_crc32,
            sha256(coalesce(text, '')) AS sha, coalesce(doc_id::VARCHAR, '') || ':' || sha AS record
        FROM documents, crc
    ), counted AS (
        SELECT *, count(*) OVER (PARTITION BY record) AS copies FROM read
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY copies > 1 ORDER BY record) AS place FROM counted
    ), hashed AS (
        SELECT *, ('0x' || left(sha256(CASE WHEN copies > 1 THEN record || ':' || place ELSE record END), 3))::BIGINT AS virtual_slot FROM numbered
    ), slots AS (
        SELECT s AS slot, coalesce(sum(size), 0)::BIGINT AS bytes, count(size) AS n, (s * 8 // 4096)::INTEGER AS shard
        FROM range(4096) AS every(s) LEFT JOIN hashed ON virtual_slot = s GROUP BY s
    ), summed AS (
        SELECT *, sum(bytes) OVER (PARTITION BY shard ORDER BY bytes DESC, slot) * 8 <= sum(bytes) OVER () AS stays FROM slots
    ), pool AS (
        SELECT slot, bytes, row_number() OVER (ORDER BY bytes DESC, slot) AS k FROM summed WHERE NOT stays
    ), deal(k, loads, shard) AS (
        SELECT 0::BIGINT, (SELECT list(load ORDER BY shard) FROM
            (SELECT shard, sum(CASE WHEN stays THEN bytes ELSE 0 END)::BIGINT AS load FROM summed GROUP BY shard)), 0::BIGINT
        UNION ALL
        SELECT p.k, list_transform(d.loads, lambda x, i: CASE WHEN i = list_position(d.loads, list_min(d.loads)) THEN x + p.bytes ELSE x END),
            list_position(d.loads, list_min(d.loads)) - 1
        FROM deal d JOIN pool p ON p.k = d.k + 1
    ), placed AS (
        SELECT slot, n, shard FROM summed WHERE stays
        UNION ALL SELECT p.slot, s.n, d.shard FROM pool p JOIN deal d USING (k) JOIN slots s USING (slot)
    ), starts AS (
        SELECT slot, shard, coalesce(sum(n) OVER (PARTITION BY shard ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM placed
    )
    SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
        (start + row_number() OVER (PARTITION BY virtual_slot ORDER BY doc_id NULLS FIRST, sha) - 1)::BIGINT AS slot,
        NULL::INTEGER AS grown_shard, virtual_slot, 1::INTEGER AS map_version
    FROM hashed JOIN starts ON virtual_slot = starts.slot
    """,
)
def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(read_table(spark, folder, "documents"), shards=8)


@query(
    "op13_conversation_trie",
    f"""
    WITH crc AS ({CRC_TABLE}), turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
    ), numbered AS (
        SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id
            ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS place FROM turns
    ), lengths AS (
        SELECT conv_id, max(place) AS n FROM numbered GROUP BY conv_id
    ), plan AS (
        SELECT l.conv_id, l.conv_id - l.conv_id % 20 AS base, {CRC.format(text="l.conv_id::VARCHAR")} % 4 AS head FROM lengths l, crc
    ), taken AS (
        SELECT p.*, least(head, coalesce(b.n, 0)) AS taken FROM plan p LEFT JOIN lengths b ON b.conv_id = p.base
    ), rebuilt AS (
        SELECT t.conv_id, n.place, n.role, n.text FROM taken t JOIN numbered n ON n.conv_id = t.base AND n.place <= t.taken
        UNION ALL
        SELECT t.conv_id, n.place - t.head + t.taken, n.role, n.text FROM taken t JOIN numbered n ON n.conv_id = t.conv_id AND n.place > t.head
    ), whole AS (
        SELECT l.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY place) FILTER (place IS NOT NULL), []) AS turns
        FROM lengths l LEFT JOIN rebuilt r USING (conv_id) GROUP BY l.conv_id
    ), prefixes AS (
        SELECT conv_id, d AS depth, turns[1 : d] AS prefix, len(turns) = d AS ends FROM whole, unnest(range(len(turns) + 1)) AS depths(d)
    ), nodes AS (
        SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
            CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(prefix[depth].text, '[^\x20\x09-\x0D]+')) END AS words
        FROM prefixes GROUP BY prefix, depth
    ), children AS (
        SELECT prefix[1 : depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
    ), counted AS (
        SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (prefix)
    ), subtrees AS (
        SELECT prefix[1 : d] AS prefix, sum((n_children = 0)::INTEGER)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
        FROM counted, unnest(range(depth + 1)) AS above(d) GROUP BY 1
    )
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
    FROM counted n JOIN subtrees s USING (prefix) LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1 : n.depth - 1]
    """,
)
def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(read_table(spark, folder, "conversations"))
