"""URL filters: a blocked Bloom filter before an exact join. DataFrame operations only.

A list of canonical URLs is folded into a blocked Bloom filter: each URL sets four bits of one 64-bit block,
and blocks are folded with ``bit_or``, which combines before the shuffle. The filter has about ten bits for each
URL and at most ``MAX_BLOCKS`` blocks, so it may be broadcast whatever the list's size. Pages whose block lacks
a bit are not on the list; only the possible hits are joined with the list itself, and that join removes the
false positives. A list that outgrows the filter only makes more rows take the exact join.

Rules of hosts and path prefixes stand above the list. A rule fits its host and all subdomains if the path
starts with the rule's; the longest fitting rule (host, then path) decides.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule, has no canonical
form and is allowed. Repeated rows are judged alike, each gives a row. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpuspipe.llm.common import ascii_lower, keep_columns, store

# The largest filter: 2 ** 20 blocks of 64 bits. It is the proven bound of what is broadcast, 16 MB of rows.
MAX_BLOCKS = 1 << 20

# Fixed values of the contract: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

# Hosts whose name holds one of these words are what the query's list is made of.
SPAM_WORDS = ("cheap-pills", "casino-win", "free-bets", "ads-track")

# Query parameters that never name another document.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without a last slash, and the query without tracking parameters, sorted.

    Null where the URL has no host.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    asked = F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(asked, lambda part: (part != "") & ~part.rlike(rf"^({TRACKING})=")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(F.length(host) > 0, F.concat(host, path, query))


def _block_and_bits(url: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a canonical URL and the four bits it sets there."""
    place, bits = F.xxhash64(url), F.xxhash64(url, F.lit(1))
    one = F.lit(1).cast("long")
    masks = [
        F.call_function("shiftleft", one, F.shiftright(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
        for k in range(4)
    ]
    return F.pmod(place, F.lit(blocks)), reduce(lambda a, b: a.bitwiseOR(b), masks)


def filter_blocks(listed: int) -> int:
    """Blocks for so many URLs: about ten bits for each, a power of two, at most MAX_BLOCKS."""
    return min(MAX_BLOCKS, 1 << max(6, (listed * 10 // 64).bit_length()))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter's words: ``block, word``, at most ``blocks`` rows, from a table with a ``canonical`` column."""
    block, bits = _block_and_bits(F.col("canonical"), blocks)
    return (
        listed.where(F.col("canonical").isNotNull())
        .select(block.alias("block"), bits.alias("bits"))
        .groupBy("block")
        .agg(F.bit_or("bits").alias("word"))
    )


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host + path``, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for of, prefix, says in sorted(rules, key=lambda rule: (len(rule[0]) + len(rule[1]), rule)):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(prefix)
        name = F.when(fits, F.lit(of + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def spam_list(pages: DataFrame, words=SPAM_WORDS) -> DataFrame:
    """A list as a feed would give it: the distinct canonical URLs of pages on hosts with a listed word."""
    url = keep_columns(pages, url="string").select(canonical(F.col("url")).alias("canonical"), host_of(F.col("url")).alias("host"))
    return url.where(F.col("host").rlike("|".join(words))).select("canonical").distinct()


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, url, host, path, canonical, rule, listed, verdict`` of every page.

    ``listed`` has a ``canonical`` column; repeated and null entries do no harm.
    """
    urls = store(listed.select("canonical").where(F.col("canonical").isNotNull()).distinct(), "url-list")
    blocks = filter_blocks(urls.count())
    words = bloom_filter(urls, blocks)
    url = F.col("url")
    rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
    read = (
        keep_columns(pages, page_id="long", url="string")
        .select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
        .select("*", rule.alias("rule"), says.alias("ruled"))
    )
    block, bits = _block_and_bits(F.col("canonical"), blocks)
    passed = (
        read.withColumn("block", block)
        .withColumn("bits", bits)
        .join(F.broadcast(words), "block", "left")
        .withColumn("possible", F.coalesce(F.col("word").bitwiseAND(F.col("bits")) == F.col("bits"), F.lit(False)))
        .drop("block", "bits", "word")
    )
    clear = passed.where(~F.col("possible")).withColumn("listed", F.lit(False))
    on_list = urls.withColumn("found", F.lit(True))
    hits = passed.where("possible").join(on_list, "canonical", "left").withColumn("listed", F.coalesce("found", F.lit(False)))
    columns = ["page_id", "url", "host", "path", "canonical", "rule", "ruled", "listed"]
    return (
        clear.select(*columns)
        .unionByName(hits.select(*columns))
        .withColumn("verdict", F.coalesce("ruled", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))))
        .drop("ruled")
    )
