"""Queries over the catalog: worlds, settings and assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuspipe.functions import names
from corpuspipe.operators import catalog, dedup, validation
from corpuspipe.operators.scale import pinned, with_position
from corpuspipe.plans import roles
from corpuspipe.plans.registry import query
from corpuspipe.sources.tables import read_table

WORLDS = roles.WORLDS_SQL
ASSETS = roles.ASSETS_SQL
SETTINGS = roles.SETTINGS_SQL
USED = roles.TIME_SQL.format("last_used_at")
NOW = "2026-01-02 03:04:05"


def _now() -> F.Column:
    return F.to_timestamp(F.lit(NOW))


def _shown(worlds: DataFrame) -> DataFrame:
    """Times leave the engine as UTC text."""
    return worlds.withColumn("last_used_at", names.utc_text(F.col("last_used_at")))


# Listings and look-ups


@query(
    "list_worlds",
    f"""SELECT world_id, display_name, display_name_key, row_number() OVER (ORDER BY display_name_key, world_id) AS position
        FROM ({WORLDS})""",
)
def list_worlds(spark, folder):
    rows = roles.worlds(spark, folder).select("world_id", "display_name", "display_name_key")
    return with_position(rows, *catalog.WORLD_ORDER)


@query(
    "recent_worlds",
    f"""SELECT world_id, display_name_key, {USED} AS last_used_at,
               row_number() OVER (ORDER BY w.last_used_at DESC, display_name_key, world_id) AS position FROM ({WORLDS}) w""",
)
def recent_worlds(spark, folder):
    rows = roles.worlds(spark, folder).select("world_id", "display_name_key", "last_used_at")
    return _shown(with_position(rows, *catalog.recent_order()))


@query(
    "latest_world",
    f"""SELECT world_id, display_name, {USED} AS last_used_at FROM ({WORLDS}) w
        ORDER BY w.last_used_at DESC, display_name_key, world_id LIMIT 1""",
)
def latest_world(spark, folder):
    top = catalog.latest_world(roles.worlds(spark, folder))
    return _shown(top).select("world_id", "display_name", "last_used_at")


@query(
    "list_assets",
    f"""SELECT asset_id, asset_type, display_name, is_built_in, NOT is_built_in AS is_user_uploaded, NOT is_built_in AS is_deletable,
               row_number() OVER (ORDER BY lower(display_name), asset_id) AS position FROM ({ASSETS})""",
)
def list_assets(spark, folder):
    rows = roles.assets(spark, folder).select(
        "asset_id",
        "asset_type",
        "display_name",
        "is_built_in",
        (~F.col("is_built_in")).alias("is_user_uploaded"),
        (~F.col("is_built_in")).alias("is_deletable"),
    )
    return with_position(rows, *catalog.asset_order())


@query(
    "lookup_worlds",
    f"""SELECT world_id, display_name FROM ({WORLDS}) WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def lookup_worlds(spark, folder):
    """Worlds named by finished orders; ids of customers that do not exist find nothing."""
    wanted = (
        read_table(spark, folder, "orders")
        .where(F.col("o_orderstatus") == "F")
        .select(F.concat(F.lit("world-"), "o_custkey").alias("world_id"))
    )
    return catalog.lookup(roles.worlds(spark, folder), wanted, "world_id").select("world_id", "display_name")


@query(
    "lookup_assets",
    f"SELECT * FROM ({ASSETS}) WHERE asset_id IN (SELECT background_asset_id FROM ({WORLDS}))",
)
def lookup_assets(spark, folder):
    used = roles.worlds(spark, folder).select(F.col("background_asset_id").alias("asset_id"))
    return catalog.lookup(roles.assets(spark, folder), used, "asset_id")


@query(
    "default_assets",
    f"SELECT asset_id, asset_type FROM ({ASSETS}) WHERE is_built_in AND asset_type = 'font' AND asset_id = 'asset-3'",
)
def default_assets(spark, folder):
    """The default look-up: asset-3 is built in and a font; asked for as an image it is not found."""
    assets = roles.assets(spark, folder)
    found = catalog.default_asset(assets, "asset-3", "font").unionByName(
        catalog.default_asset(assets, "asset-3", "image")
    )
    return found.select("asset_id", "asset_type")


@query(
    "world_cards",
    f"""SELECT world_id, display_name, description, '/assets/' || url_encode(background_asset_id) || '/file' AS background_url,
               '/assets/' || url_encode(font_asset_id) || '/file' AS font_url, {USED} AS last_used_at FROM ({WORLDS})""",
)
def world_cards(spark, folder):
    return catalog.world_cards(roles.worlds(spark, folder))


_DETAIL_WORLDS = f"""
    SELECT DISTINCT source AS world_id, upper(source) AS display_name, 'builtin-image-main-world' AS background_asset_id,
           'builtin-font-inter' AS font_asset_id FROM documents"""


def _elsewhere(world: str):
    """The world's rows belong to a world that no table lists."""
    own = F.col("world_id")
    return F.when(own == world, F.concat(F.lit("no-"), own)).otherwise(own).alias("world_id")


@query(
    "world_detail",
    f"""SELECT w.*, s.chunk_size, s.max_lookback_size, s.overlap_size, s.splitter_version, s.is_locked, d.source_id,
               d.original_filename, d.source_file_type, d.book_number, coalesce(s.is_locked, false) AS is_readable
        FROM ({_DETAIL_WORLDS}) w LEFT JOIN (SELECT * FROM ({SETTINGS}) WHERE world_id <> 'src2') s ON w.world_id = s.world_id
        LEFT JOIN (SELECT world_id, 'doc-' || doc_id AS source_id, regexp_extract(source_path, '[^/]*$') AS original_filename,
                          {roles.TYPE_SQL} AS source_file_type, source_order + 1 AS book_number
                   FROM ({roles.BY_SOURCE}) WHERE world_id <> 'src3') d ON w.world_id = d.world_id""",
)
def world_detail(spark, folder):
    """Detail of one world per ``source``: src2 has no settings and src3 no sources, as theirs name worlds that are not there."""
    docs = roles.documents(spark, folder, "source")
    worlds = docs.select("world_id").distinct().select(
        "world_id",
        F.upper("world_id").alias("display_name"),
        F.lit(catalog.DEFAULT_BACKGROUND_ID).alias("background_asset_id"),
        F.lit(catalog.DEFAULT_FONT_ID).alias("font_asset_id"),
    )
    sources = docs.select(
        _elsewhere("src3"),
        F.concat(F.lit("doc-"), "doc_id").alias("source_id"),
        names.base_name(F.col("source_path")).alias("original_filename"),
        names.source_type(F.col("source_path")).alias("source_file_type"),
        (F.col("source_order") + 1).alias("book_number"),
    )
    settings = roles.settings(spark, folder).withColumn("world_id", _elsewhere("src2"))
    return catalog.world_detail(worlds, settings, sources)


# Checks


@query(
    "violations_worlds",
    roles.violations_sql(
        f"SELECT * FROM ({WORLDS})",
        "world",
        "world_id",
        [
            ("display_name_blank", "display_name must not be blank", "c_acctbal < 0"),
            ("background_asset_id_blank", "background_asset_id must not be blank", "c_nationkey = 3"),
            ("font_asset_id_blank", "font_asset_id must not be blank", "font_asset_id = 'asset-3'"),
        ],
        "world_id",
    ),
)
def violations_worlds(spark, folder):
    debt = read_table(spark, folder, "customer").select(
        F.concat(F.lit("world-"), "c_custkey").alias("world_id"), "c_acctbal"
    )
    bad = roles.worlds(spark, folder).join(debt, "world_id").withColumns(
        {
            "display_name": F.when(F.col("c_acctbal") < 0, " ").otherwise(F.col("display_name")),
            "background_asset_id": F.when(F.col("background_asset_id") == "asset-3", "").otherwise(
                F.col("background_asset_id")
            ),
            "font_asset_id": F.when(F.col("font_asset_id") == "asset-3", None).otherwise(F.col("font_asset_id")),
        }
    )
    return validation.world_violations(bad)


@query(
    "violations_assets",
    roles.violations_sql(
        f"SELECT *, CASE WHEN n = 9 THEN ' ' WHEN n = 10 THEN NULL ELSE asset_id END AS k "
        f"FROM (SELECT *, CAST(substr(asset_id, 7) AS INTEGER) AS n FROM ({ASSETS}))",
        "asset",
        "k",
        [
            ("asset_type_unknown", "asset_type must be image or font", "n = 6"),
            ("display_name_blank", "display_name must not be blank", "n = 7"),
            ("stored_path_blank", "stored_path must not be blank", "n = 8"),
            ("asset_id_blank", "asset_id must not be blank", "n = 9"),
            ("file_hash_missing", "an uploaded asset needs a file hash", "n > 20"),
        ],
        "NULL",
    ),
)
def violations_assets(spark, folder):
    number = F.substring("asset_id", 7, 10).cast("int")
    assets = roles.assets(spark, folder).withColumn("_n", number)
    n = F.col("_n")
    return validation.asset_violations(
        assets.withColumns(
            {
                "asset_type": F.when(n == 6, "video").otherwise(F.col("asset_type")),
                "display_name": F.when(n == 7, " ").otherwise(F.col("display_name")),
                "stored_path": F.when(n == 8, "").otherwise(F.col("stored_path")),
                "asset_id": F.when(n == 9, " ").when(n == 10, None).otherwise(F.col("asset_id")),
                "file_hash": F.when(n > 20, None).otherwise(F.col("file_hash")),
            }
        )
    )


_RAW_ID_SQL = """CASE source WHEN 'src1' THEN '{' || upper(dashed) || '}' WHEN 'src2' THEN 'urn:uuid:' || dashed
    WHEN 'src3' THEN hex WHEN 'src4' THEN 'World ' || doc_id WHEN 'src5' THEN substr(hex, 2)
    WHEN 'src6' THEN 'URN:UUID:' || dashed ELSE upper(dashed) END"""


@query(
    "normalize_world_ids",
    f"""SELECT doc_id, {_RAW_ID_SQL} AS raw_id, CASE WHEN source NOT IN ('src4', 'src5', 'src6') THEN dashed END AS world_id
        FROM (SELECT doc_id, source, hex, substr(hex, 1, 8) || '-' || substr(hex, 9, 4) || '-' || substr(hex, 13, 4) || '-'
                     || substr(hex, 17, 4) || '-' || substr(hex, 21, 12) AS dashed
              FROM (SELECT doc_id, source, md5(text || doc_id) AS hex FROM documents))""",
)
def normalize_world_ids(spark, folder):
    digits = F.col("hex")
    dashed = F.concat_ws("-", *[F.substring(digits, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    source = F.col("source")
    raw = (
        F.when(source == "src1", F.concat(F.lit("{"), F.upper(dashed), F.lit("}")))
        .when(source == "src2", F.concat(F.lit("urn:uuid:"), dashed))
        .when(source == "src3", digits)
        .when(source == "src4", F.concat(F.lit("World "), "doc_id"))
        .when(source == "src5", F.substring(digits, 2, 40))
        .when(source == "src6", F.concat(F.lit("URN:UUID:"), dashed))
        .otherwise(F.upper(dashed))
    )
    docs = read_table(spark, folder, "documents").select(
        "doc_id", "source", F.md5(F.encode(F.concat("text", F.col("doc_id").cast("string")), "UTF-8")).alias("hex")
    )
    return docs.select("doc_id", raw.alias("raw_id")).withColumn(
        "world_id", validation.normalize_world_id(F.col("raw_id"))
    )


_PATH_SQL = """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '/abs/' || c_name WHEN 'BUILDING' THEN 'a/../' || c_name
    WHEN 'FURNITURE' THEN 'a..b/' || c_name ELSE 'images/' || c_name END"""


@query(
    "unsafe_paths",
    f"""SELECT c_custkey, {_PATH_SQL} AS stored_path, c_mktsegment IN ('AUTOMOBILE', 'BUILDING') AS is_unsafe FROM customer""",
)
def unsafe_paths(spark, folder):
    segment = F.col("c_mktsegment")
    path = F.concat(
        F.when(segment == "AUTOMOBILE", "/abs/")
        .when(segment == "BUILDING", "a/../")
        .when(segment == "FURNITURE", "a..b/")
        .otherwise("images/"),
        "c_name",
    )
    rows = read_table(spark, folder, "customer").select("c_custkey", path.alias("stored_path"))
    return rows.withColumn("is_unsafe", validation.is_unsafe_path(F.col("stored_path")))


# Changes to worlds

# Suppliers ask for new worlds: half of the names are taken by customers, and one name is asked for by many.
_REQUESTS = """
    SELECT 'new-' || s_suppkey AS world_id, CAST(s_suppkey AS INTEGER) AS request_order,
           CASE WHEN s_acctbal < 1000 THEN upper('Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'))
                WHEN s_nationkey < 5 THEN 'Shared ' || s_nationkey WHEN s_nationkey = 5 THEN ' ' ELSE s_name END AS display_name
    FROM supplier"""


def _requests(spark, folder) -> DataFrame:
    nation = F.col("s_nationkey")
    return read_table(spark, folder, "supplier").select(
        F.concat(F.lit("new-"), "s_suppkey").alias("world_id"),
        F.col("s_suppkey").cast("int").alias("request_order"),
        F.when(
            F.col("s_acctbal") < 1000,
            F.upper(F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))),
        )
        .when(nation < 5, F.concat(F.lit("Shared "), nation))
        .when(nation == 5, " ")
        .otherwise(F.col("s_name"))
        .alias("display_name"),
        F.lit(None).cast("string").alias("description"),
        F.lit(catalog.DEFAULT_BACKGROUND_ID).alias("background_asset_id"),
        F.lit(catalog.DEFAULT_FONT_ID).alias("font_asset_id"),
    )


@query(
    "create_worlds",
    f"""SELECT world_id, display_name, display_name_key, {USED} AS last_used_at FROM ({WORLDS})
        UNION ALL SELECT world_id, display_name, lower(display_name), '{NOW}' FROM (
            SELECT *, row_number() OVER (PARTITION BY lower(display_name) ORDER BY request_order) AS n FROM ({_REQUESTS})
            WHERE trim(display_name) <> '') WHERE n = 1 AND lower(display_name) NOT IN (SELECT lower(c_name) FROM customer)""",
)
def create_worlds(spark, folder):
    state = catalog.create_worlds(roles.worlds(spark, folder), _requests(spark, folder), _now())
    return _shown(state).select("world_id", "display_name", "display_name_key", "last_used_at")


@query(
    "create_outcomes",
    f"""WITH r AS (SELECT *, lower(display_name) AS k, trim(display_name) <> '' AS valid FROM ({_REQUESTS})),
            n AS (SELECT *, row_number() OVER (PARTITION BY k, valid ORDER BY request_order) AS place FROM r)
        SELECT world_id, request_order, display_name, CASE WHEN NOT valid THEN 'invalid'
            WHEN k IN (SELECT lower(c_name) FROM customer) OR place > 1 THEN 'name_taken' ELSE 'created' END AS outcome
        FROM n""",
)
def create_outcomes(spark, folder):
    """Every request keeps a row that says what became of it."""
    found = catalog.create_outcomes(roles.worlds(spark, folder), _requests(spark, folder))
    return found.select("world_id", "request_order", "display_name", "outcome")


@query(
    "name_conflicts",
    f"""SELECT 'new-' || s_suppkey AS world_id, lower(display_name) AS display_name_key, 'world-' || c_custkey AS holder_id
        FROM ({_REQUESTS}) JOIN supplier ON world_id = 'new-' || s_suppkey JOIN customer ON lower(c_name) = lower(display_name)""",
)
def name_conflicts(spark, folder):
    wanted = _requests(spark, folder).select("world_id", F.lower("display_name").alias("display_name_key"))
    return catalog.name_conflicts(roles.worlds(spark, folder), wanted)


# Suppliers update the customer of the same number: own name, a taken name, a blank one, or a new one asked for by many.
_UPDATES = """
    SELECT 'world-' || (s_suppkey * 2) AS world_id, CAST(s_suppkey AS INTEGER) AS request_order,
           CASE WHEN s_nationkey < 5 THEN upper('Customer#' || lpad(CAST(s_suppkey * 2 AS VARCHAR), 9, '0'))
                WHEN s_nationkey < 8 THEN 'Customer#' || lpad(CAST(s_suppkey * 2 + 1 AS VARCHAR), 9, '0')
                WHEN s_nationkey = 8 THEN ' ' WHEN s_nationkey < 12 THEN 'Renamed ' || s_nationkey ELSE s_name END AS display_name
    FROM supplier"""


def _updates(spark, folder) -> DataFrame:
    nation = F.col("s_nationkey")
    number = F.col("s_suppkey") * 2

    def customer(key):
        return F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))

    return read_table(spark, folder, "supplier").select(
        F.concat(F.lit("world-"), number).alias("world_id"),
        F.col("s_suppkey").cast("int").alias("request_order"),
        F.when(nation < 5, F.upper(customer(number)))
        .when(nation < 8, customer(number + 1))
        .when(nation == 8, " ")
        .when(nation < 12, F.concat(F.lit("Renamed "), nation))
        .otherwise(F.col("s_name"))
        .alias("display_name"),
        F.lit(None).cast("string").alias("description"),
        F.lit("asset-1").alias("background_asset_id"),
        F.lit("asset-3").alias("font_asset_id"),
    )


@query(
    "update_worlds",
    f"""WITH w AS ({WORLDS}),
        u AS (SELECT r.*, trim(r.display_name) <> '' AS valid FROM ({_UPDATES}) r JOIN w ON w.world_id = r.world_id),
        f AS (SELECT lower(display_name) AS k, arg_min(world_id, request_order) AS first FROM u WHERE valid GROUP BY 1),
        d AS (SELECT u.*, CASE WHEN NOT valid THEN 'invalid' WHEN h.world_id <> u.world_id THEN 'name_taken'
                     WHEN f.first <> u.world_id THEN 'name_taken' ELSE 'updated' END AS outcome
              FROM u LEFT JOIN w h ON h.display_name_key = lower(u.display_name) LEFT JOIN f ON f.k = lower(u.display_name))
        SELECT w.world_id, CASE WHEN outcome = 'updated' THEN d.display_name ELSE w.display_name END AS display_name,
               CASE WHEN outcome = 'updated' THEN lower(d.display_name) ELSE w.display_name_key END AS display_name_key,
               CASE WHEN outcome = 'updated' THEN NULL ELSE w.description END AS description,
               CASE WHEN outcome = 'updated' THEN 'asset-1' ELSE w.background_asset_id END AS background_asset_id,
               CASE WHEN outcome = 'updated' THEN 'asset-3' ELSE w.font_asset_id END AS font_asset_id,
               CASE WHEN outcome = 'updated' THEN '{NOW}' ELSE {roles.TIME_SQL.format('w.last_used_at')} END AS last_used_at,
               coalesce(outcome, 'unchanged') AS outcome
        FROM w LEFT JOIN d ON d.world_id = w.world_id""",
)
def update_worlds(spark, folder):
    return _shown(catalog.update_worlds(roles.worlds(spark, folder), _updates(spark, folder), _now()))


@query(
    "mark_used",
    f"""SELECT w.world_id, {roles.TIME_SQL.format('coalesce(u.used, w.last_used_at)')} AS last_used_at
        FROM ({WORLDS}) w LEFT JOIN (SELECT 'world-' || user_id AS world_id, max(ts) AS used FROM events GROUP BY 1) u
        ON w.world_id = u.world_id""",
)
def mark_used(spark, folder):
    usage = read_table(spark, folder, "events").select(
        F.concat(F.lit("world-"), "user_id").alias("world_id"), F.col("ts").cast("timestamp").alias("used_at")
    )
    return _shown(catalog.mark_used(roles.worlds(spark, folder), usage)).select("world_id", "last_used_at")


@query(
    "backfill_last_used",
    f"""SELECT 'world-' || c_custkey AS world_id, CASE WHEN used IS NULL OR c_acctbal < 0 THEN '1970-01-01 00:00:00'
            ELSE {roles.TIME_SQL.format('used')} END AS last_used_at
        FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS used FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
)
def backfill_last_used(spark, folder):
    """Worlds in debt have lost their time of last use and get the default."""
    debt = read_table(spark, folder, "customer").select(
        F.concat(F.lit("world-"), "c_custkey").alias("world_id"), "c_acctbal"
    )
    lost = roles.worlds(spark, folder).join(debt, "world_id").withColumn(
        "last_used_at", F.when(F.col("c_acctbal") >= 0, F.col("last_used_at"))
    )
    return _shown(catalog.backfill_last_used(lost)).select("world_id", "last_used_at")


# Splitter settings


@query(
    "effective_settings",
    f"""SELECT w.world_id, coalesce(chunk_size, 4000) AS chunk_size, coalesce(max_lookback_size, 1000) AS max_lookback_size,
               coalesce(overlap_size, 400) AS overlap_size, coalesce(splitter_version, '1') AS splitter_version,
               coalesce(is_locked, false) AS is_locked
        FROM (SELECT DISTINCT source AS world_id FROM documents UNION SELECT DISTINCT lang FROM documents) w
        LEFT JOIN ({SETTINGS}) s ON w.world_id = s.world_id""",
)
def effective_settings(spark, folder):
    """Worlds per source have settings, worlds per language get the defaults."""
    worlds = (
        roles.documents(spark, folder, "source")
        .select("world_id")
        .unionByName(roles.documents(spark, folder).select("world_id"))
        .distinct()
    )
    return catalog.effective_settings(worlds, roles.settings(spark, folder))


# Requests: unlocked and locked worlds ask for new numbers, src11 for the same ones, languages have no row yet.
_ASKED = f"""
    SELECT world_id, CASE WHEN world_id = 'src11' THEN chunk_size ELSE 900 END AS chunk_size,
           CASE WHEN world_id = 'src11' THEN max_lookback_size ELSE 90 END AS max_lookback_size,
           CASE WHEN world_id = 'src11' THEN overlap_size ELSE 9 END AS overlap_size
    FROM ({SETTINGS}) WHERE world_id NOT IN ('src4', 'src14')
    UNION ALL SELECT DISTINCT lang, 900, 90, 9 FROM documents"""


@query(
    "save_settings",
    f"""SELECT coalesce(s.world_id, a.world_id) AS world_id,
               CASE WHEN a.world_id IS NULL OR s.is_locked THEN s.chunk_size ELSE a.chunk_size END AS chunk_size,
               CASE WHEN a.world_id IS NULL OR s.is_locked THEN s.max_lookback_size ELSE a.max_lookback_size END AS max_lookback_size,
               CASE WHEN a.world_id IS NULL OR s.is_locked THEN s.overlap_size ELSE a.overlap_size END AS overlap_size,
               coalesce(s.splitter_version, '1') AS splitter_version, coalesce(s.is_locked, false) AS is_locked,
               CASE WHEN a.world_id IS NULL THEN 'untouched' WHEN s.world_id IS NULL THEN 'inserted' WHEN NOT s.is_locked THEN 'updated'
                    WHEN s.chunk_size = a.chunk_size AND s.max_lookback_size = a.max_lookback_size AND s.overlap_size = a.overlap_size
                    THEN 'locked_equal' ELSE 'locked_refused' END AS outcome
        FROM ({SETTINGS}) s FULL JOIN ({_ASKED}) a ON s.world_id = a.world_id""",
)
def save_settings(spark, folder):
    stored = roles.settings(spark, folder)
    same = F.col("world_id") == "src11"
    asked = stored.where(~F.col("world_id").isin("src4", "src14")).select(
        "world_id",
        F.when(same, F.col("chunk_size")).otherwise(900).alias("chunk_size"),
        F.when(same, F.col("max_lookback_size")).otherwise(90).alias("max_lookback_size"),
        F.when(same, F.col("overlap_size")).otherwise(9).alias("overlap_size"),
    )
    fresh = roles.documents(spark, folder).select("world_id").distinct().select(
        "world_id",
        F.lit(900).alias("chunk_size"),
        F.lit(90).alias("max_lookback_size"),
        F.lit(9).alias("overlap_size"),
    )
    return catalog.save_settings(stored, asked.unionByName(fresh))


@query(
    "lock_settings",
    f"""SELECT * REPLACE (is_locked OR world_id IN (SELECT source FROM documents WHERE lang = 'fr' AND n_chars > 10000) AS is_locked)
        FROM ({SETTINGS})""",
)
def lock_settings(spark, folder):
    """Lock the worlds that hold a long French document."""
    wanted = roles.documents(spark, folder, "source").where((F.col("lang") == "fr") & (F.col("n_chars") > 10000))
    return catalog.lock_settings(roles.settings(spark, folder), wanted)


# Assets

# Seeds: the assets of region 0 with new names, and one new asset per region.
_SEEDS = f"""
    SELECT a.asset_id, a.asset_type, 'Seed ' || n_name AS display_name, 'seed/' || n_name AS stored_path, CAST(NULL AS VARCHAR) AS file_hash,
           true AS is_built_in, CAST(NULL AS VARCHAR) AS full_font_name, 'seed.png' AS original_filename
    FROM nation JOIN ({ASSETS}) a ON a.asset_id = 'asset-' || n_nationkey WHERE n_regionkey = 0
    UNION ALL SELECT 'seed-' || r_regionkey, 'image', r_name, 'seed/' || r_name, NULL, true, NULL, 'seed.png' FROM region"""


def _seeds(spark, folder) -> DataFrame:
    none = F.lit(None).cast("string")
    nation = read_table(spark, folder, "nation").where(F.col("n_regionkey") == 0)
    region = read_table(spark, folder, "region")

    def seed(asset_id, shown, name):
        return [
            asset_id.alias("asset_id"),
            F.lit("image").alias("asset_type"),
            shown.alias("display_name"),
            F.concat(F.lit("seed/"), name).alias("stored_path"),
            none.alias("file_hash"),
            F.lit(True).alias("is_built_in"),
            none.alias("full_font_name"),
            F.lit("seed.png").alias("original_filename"),
        ]

    return nation.select(
        *seed(F.concat(F.lit("asset-"), "n_nationkey"), F.concat(F.lit("Seed "), "n_name"), F.col("n_name"))
    ).unionByName(
        region.select(*seed(F.concat(F.lit("seed-"), "r_regionkey"), F.col("r_name"), F.col("r_name")))
    )


@query(
    "upsert_assets",
    f"""SELECT coalesce(s.asset_id, a.asset_id) AS asset_id,
               CASE WHEN s.asset_id IS NULL THEN a.asset_type ELSE s.asset_type END AS asset_type,
               CASE WHEN s.asset_id IS NULL THEN a.display_name ELSE s.display_name END AS display_name,
               CASE WHEN s.asset_id IS NULL THEN a.stored_path ELSE s.stored_path END AS stored_path,
               CASE WHEN s.asset_id IS NULL THEN a.file_hash ELSE s.file_hash END AS file_hash,
               CASE WHEN s.asset_id IS NULL THEN a.is_built_in ELSE s.is_built_in END AS is_built_in,
               CASE WHEN s.asset_id IS NULL THEN a.full_font_name ELSE s.full_font_name END AS full_font_name,
               CASE WHEN a.asset_id IS NULL THEN s.original_filename ELSE a.original_filename END AS original_filename
        FROM ({ASSETS}) a FULL JOIN ({_SEEDS}) s ON a.asset_id = s.asset_id""",
)
def upsert_assets(spark, folder):
    return catalog.upsert_assets(roles.assets(spark, folder), _seeds(spark, folder))


@query(
    "built_in_assets",
    f"""SELECT count(*) AS asset_count, count(*) FILTER (is_built_in) AS built_in_count FROM (
            SELECT asset_id, is_built_in FROM ({ASSETS})
            UNION ALL SELECT 'builtin-' || i, true FROM range(14) t(i))""",
)
def built_in_assets(spark, folder):
    """Upserting the built-in assets adds all of them to the catalog."""
    state = catalog.upsert_assets(roles.assets(spark, folder), catalog.built_in_assets(spark))
    return state.agg(
        F.count(F.lit(1)).alias("asset_count"), F.count_if("is_built_in").alias("built_in_count")
    )


# Parts are uploads: their name is the content, so that the nation names among them are duplicates.
_UPLOADS = """
    SELECT 'up-' || p_partkey AS upload_id, CASE WHEN p_size < 25 THEN 'image' ELSE 'font' END AS asset_type,
           CASE WHEN p_size = 7 THEN ' .ttf' WHEN p_size = 8 THEN 'unsafe\\' || p_brand || '.PNG' ELSE p_name || '.Otf' END AS original_filename,
           'sha256:' || sha256(CASE WHEN p_size < 5 THEN 'NATION_' || (p_size * 4) ELSE p_name END) AS file_hash FROM part"""


def _uploads(spark, folder) -> DataFrame:
    size = F.col("p_size")
    content = F.when(size < 5, F.concat(F.lit("NATION_"), size * 4)).otherwise(F.col("p_name"))
    return read_table(spark, folder, "part").select(
        F.concat(F.lit("up-"), "p_partkey").alias("upload_id"),
        F.when(size < 25, "image").otherwise("font").alias("asset_type"),
        F.when(size == 7, " .ttf")
        .when(size == 8, F.concat(F.lit("unsafe\\"), "p_brand", F.lit(".PNG")))
        .otherwise(F.concat("p_name", F.lit(".Otf")))
        .alias("original_filename"),
        names.source_hash(F.encode(content, "UTF-8")).alias("file_hash"),
        F.lit(None).cast("string").alias("full_font_name"),
    )


@query(
    "asset_duplicates",
    f"""SELECT upload_id, u.file_hash, min(asset_id) AS duplicate_asset_id
        FROM ({_UPLOADS}) u JOIN ({ASSETS}) a ON u.file_hash = a.file_hash GROUP BY 1, 2""",
)
def asset_duplicates(spark, folder):
    return dedup.asset_duplicates(_uploads(spark, folder), roles.assets(spark, folder))


_FILE = "regexp_extract(original_filename, '[^/\\\\]*$')"
_SUFFIX = f"regexp_extract({_FILE}, '(?s)^.+(\\.[^.]+)$', 1)"


@query(
    "register_assets",
    f"""SELECT asset_id, asset_type, display_name, stored_path, file_hash, is_built_in, full_font_name, original_filename FROM ({ASSETS})
        UNION ALL SELECT upload_id, asset_type, CASE WHEN trim(stem) = '' THEN CASE asset_type WHEN 'image' THEN 'Uploaded image' ELSE 'Uploaded font' END
                ELSE trim(stem) END, CASE asset_type WHEN 'image' THEN 'images/' ELSE 'fonts/' END || upload_id || lower(sfx), file_hash, false, NULL, original_filename
        FROM (SELECT *, {_SUFFIX} AS sfx, substr({_FILE}, 1, length({_FILE}) - length({_SUFFIX})) AS stem FROM ({_UPLOADS}))""",
)
def register_assets(spark, folder):
    return catalog.register_assets(roles.assets(spark, folder), _uploads(spark, folder))


_REFERENCES = f"""
    SELECT background_asset_id AS asset_id, world_id, display_name, display_name_key FROM ({WORLDS})
    UNION SELECT font_asset_id, world_id, display_name, display_name_key FROM ({WORLDS})"""


@query(
    "asset_references",
    f"""SELECT asset_id, world_id, display_name, row_number() OVER (ORDER BY asset_id, display_name_key, world_id) AS position
        FROM ({_REFERENCES})""",
)
def asset_references(spark, folder):
    rows = catalog.asset_references(roles.worlds(spark, folder))
    return with_position(rows, "asset_id", "display_name_key", "world_id").drop("display_name_key")


_DELETABLE = f"SELECT * FROM ({ASSETS}) WHERE NOT is_built_in AND asset_id NOT IN (SELECT asset_id FROM ({_REFERENCES}))"


@query("deletable_assets", _DELETABLE)
def deletable_assets(spark, folder):
    return catalog.deletable_assets(roles.assets(spark, folder), roles.worlds(spark, folder))


@query(
    "delete_assets",
    f"""SELECT asset_id, asset_type, is_built_in FROM ({ASSETS}) WHERE asset_id NOT IN (
            SELECT asset_id FROM ({_DELETABLE}) WHERE asset_type = 'image')""",
)
def delete_assets(spark, folder):
    """All images are asked to go; only the uploaded and unused ones do."""
    assets = roles.assets(spark, folder)
    asked = assets.where(F.col("asset_type") == "image")
    left = catalog.delete_unused_assets(assets, asked, roles.worlds(spark, folder))
    return left.select("asset_id", "asset_type", "is_built_in")


# Confirmed pairs: asset-6 and asset-8 rightly, asset-7 with one world too many, asset-9 without a world that
# uses it, asset-20 (unused) with no world at all, and asset-2, which is built in.
_CONFIRMED = f"""
    SELECT asset_id, world_id FROM ({_REFERENCES}) WHERE asset_id IN ('asset-2', 'asset-6', 'asset-7', 'asset-8')
    UNION ALL SELECT 'asset-7', 'world-none' FROM region WHERE r_regionkey = 0
    UNION ALL SELECT asset_id, world_id FROM ({_REFERENCES}) WHERE asset_id = 'asset-9'
        AND world_id <> (SELECT min(world_id) FROM ({_REFERENCES}) WHERE asset_id = 'asset-9')
    UNION ALL SELECT 'asset-' || n_nationkey, NULL FROM nation WHERE n_nationkey = 20"""


def _confirmed(spark, folder, worlds: DataFrame) -> DataFrame:
    used = catalog.asset_references(worlds).select("asset_id", "world_id")
    spare = used.where(F.col("asset_id") == "asset-9")
    first = spare.agg(F.min("world_id").alias("world_id"))
    return pinned(
        used.where(F.col("asset_id").isin("asset-2", "asset-6", "asset-7", "asset-8"))
        .unionByName(
            read_table(spark, folder, "region")
            .where(F.col("r_regionkey") == 0)
            .select(F.lit("asset-7").alias("asset_id"), F.lit("world-none").alias("world_id"))
        )
        .unionByName(spare.join(first, "world_id", "left_anti").select("asset_id", "world_id"))
        .unionByName(
            read_table(spark, folder, "nation")
            .where(F.col("n_nationkey") == 20)
            .select(
                F.concat(F.lit("asset-"), "n_nationkey").alias("asset_id"),
                F.lit(None).cast("string").alias("world_id"),
            )
        )
    )


@query(
    "stale_confirmations",
    f"""SELECT 'asset-7' AS asset_id, 'world-none' AS world_id, 'not_affected' AS reason
        UNION ALL SELECT 'asset-9', min(world_id), 'not_confirmed' FROM ({_REFERENCES}) WHERE asset_id = 'asset-9' HAVING count(*) > 0""",
)
def stale_confirmations(spark, folder):
    worlds = pinned(roles.worlds(spark, folder))
    return catalog.stale_confirmations(worlds, _confirmed(spark, folder, worlds))


_GONE = "('asset-6', 'asset-8', 'asset-20')"


@query(
    "delete_with_fallback",
    f"""SELECT world_id, CASE WHEN background_asset_id = 'asset-6' THEN 'builtin-image-main-world' ELSE background_asset_id END AS background_asset_id,
               CASE WHEN font_asset_id = 'asset-8' THEN 'builtin-font-inter' ELSE font_asset_id END AS font_asset_id,
               background_asset_id = 'asset-6' OR font_asset_id = 'asset-8' AS is_changed FROM ({WORLDS})""",
)
def delete_with_fallback(spark, folder):
    """State of the worlds after the deletions; asset-8 is a font and stays where it is a background."""
    stored = pinned(roles.worlds(spark, folder))
    _, worlds = catalog.delete_with_fallback(
        roles.assets(spark, folder), stored, _confirmed(spark, folder, stored)
    )
    return worlds.select("world_id", "background_asset_id", "font_asset_id", "is_changed")


@query(
    "delete_with_fallback_assets",
    f"SELECT asset_id, asset_type, is_built_in FROM ({ASSETS}) WHERE asset_id NOT IN {_GONE}",
)
def delete_with_fallback_assets(spark, folder):
    stored = pinned(roles.worlds(spark, folder))
    assets, _ = catalog.delete_with_fallback(
        roles.assets(spark, folder), stored, _confirmed(spark, folder, stored)
    )
    return assets.select("asset_id", "asset_type", "is_built_in")


@query(
    "reference_replacement",
    f"""SELECT count(*) FILTER (background_asset_id IN (SELECT asset_id FROM ({ASSETS}) WHERE NOT is_built_in AND asset_type = 'image')
                            OR font_asset_id IN (SELECT asset_id FROM ({ASSETS}) WHERE NOT is_built_in AND asset_type = 'font')) AS changed_count,
               count(*) AS world_count FROM ({WORLDS})""",
)
def reference_replacement(spark, folder):
    """How many worlds change when all uploaded assets go."""
    removed = roles.assets(spark, folder).where(~F.col("is_built_in")).select("asset_id", "asset_type")
    replaced = catalog.replace_references(roles.worlds(spark, folder), removed)
    return replaced.agg(F.count_if("is_changed").alias("changed_count"), F.count(F.lit(1)).alias("world_count"))


@query(
    "fallback_assets",
    f"""SELECT asset_id, CASE asset_type WHEN 'image' THEN 'builtin-image-main-world' ELSE 'builtin-font-inter' END AS fallback_asset_id
        FROM ({ASSETS})""",
)
def fallback_assets(spark, folder):
    return roles.assets(spark, folder).select(
        "asset_id", catalog.fallback_asset(F.col("asset_type")).alias("fallback_asset_id")
    )
