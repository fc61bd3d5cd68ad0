import datetime

from pyspark.sql import functions as F

from corpuspipe import schemas
from corpuspipe.operators import catalog, dedup

T = datetime.datetime
BG, FONT = catalog.DEFAULT_BACKGROUND_ID, catalog.DEFAULT_FONT_ID


def now():
    return F.to_timestamp(F.lit("2026-05-05 05:05:05"))


def worlds(spark, *rows):
    full = [(i, name, name.casefold(), None, bg, font, used) for i, name, bg, font, used in rows]
    return spark.createDataFrame(full, schemas.WORLDS)


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def asset(asset_id, kind="image", built_in=False, original="x.png"):
    return (asset_id, kind, asset_id, f"{kind}s/{asset_id}", None if built_in else f"sha256:{asset_id}", built_in, None, original)


def assets(spark, *list_):
    return spark.createDataFrame(list(list_), schemas.ASSETS)


def requests(spark, *list_):
    return spark.createDataFrame(
        list(list_),
        "world_id string, request_order int, display_name string, description string, "
        "background_asset_id string, font_asset_id string",
    )


def test_recent_order(spark):
    table = worlds(
        spark,
        ("1", "Zeta", BG, FONT, T(2026, 1, 3)), ("2", "Alpha", BG, FONT, T(2026, 2, 2)),
        ("3", "Gamma", BG, FONT, T(2026, 2, 1)), ("4", "Beta", BG, FONT, T(2026, 2, 1)),
    )
    assert [r.display_name for r in catalog.recent_worlds(table).collect()] == ["Alpha", "Beta", "Gamma", "Zeta"]
    assert [r.display_name for r in catalog.list_worlds(table).collect()] == ["Alpha", "Beta", "Gamma", "Zeta"]
    assert catalog.latest_world(table).first().display_name == "Alpha"


def test_create_refuses_taken_names(spark):
    table = worlds(spark, ("1", "Lighthouse", BG, FONT, T(2026, 1, 1)), ("2", "Straße", BG, FONT, T(2026, 1, 1)))
    asked = requests(
        spark,
        ("a", 0, "LIGHTHOUSE", None, BG, FONT), ("b", 1, "STRASSE", None, BG, FONT), ("c", 3, "new", "late", BG, FONT),
        ("d", 2, "New", "early", BG, FONT), ("e", 4, " ", None, BG, FONT), ("f", 5, "No font", None, BG, ""),
    )
    state = catalog.create_worlds(table, asked, now())
    assert rows(state, "world_id", "display_name") == [("1", "Lighthouse"), ("2", "Straße"), ("d", "New")]
    assert state.where("world_id = 'd'").first().last_used_at == T(2026, 5, 5, 5, 5, 5)


def test_update(spark):
    table = worlds(spark, ("1", "One", BG, FONT, T(2026, 1, 1)), ("2", "Two", BG, FONT, T(2026, 1, 1)))
    asked = requests(
        spark, ("1", 0, "ONE", None, "bg", "f"), ("2", 1, "one", None, BG, FONT), ("9", 2, "Two", None, BG, FONT)
    )
    state = catalog.update_worlds(table, asked, now())
    assert rows(state, "world_id", "display_name", "background_asset_id", "outcome") == [
        ("1", "ONE", "bg", "updated"), ("2", "Two", BG, "name_taken"),
    ]


def test_mark_used_and_backfill(spark):
    table = worlds(spark, ("1", "One", BG, FONT, None), ("2", "Two", BG, FONT, T(2026, 1, 1)))
    usage = spark.createDataFrame([("2", T(2026, 3, 3)), ("2", T(2026, 2, 2)), ("9", T(2026, 4, 4))], "world_id string, used_at timestamp")
    used = catalog.mark_used(table, usage)
    assert {r.world_id: r.last_used_at for r in used.collect()} == {"1": None, "2": T(2026, 3, 3)}
    assert catalog.backfill_last_used(used).where("world_id = '1'").first().last_used_at == T(1970, 1, 1)


def test_settings_lock(spark):
    stored = spark.createDataFrame(
        [("open", 10, 1, 1, "0", False), ("same", 10, 1, 1, "1", True), ("other", 20, 1, 1, "1", True), ("rest", 1, 0, 0, "1", False)],
        schemas.SPLITTER_SETTINGS,
    )
    asked = spark.createDataFrame(
        [(w, 10, 1, 1) for w in ("open", "same", "other", "fresh")],
        "world_id string, chunk_size int, max_lookback_size int, overlap_size int",
    )
    state = catalog.save_settings(stored, asked)
    assert rows(state, "world_id", "chunk_size", "splitter_version", "is_locked", "outcome") == [
        ("fresh", 10, "1", False, "inserted"), ("open", 10, "0", False, "updated"), ("other", 20, "1", True, "locked_refused"),
        ("rest", 1, "1", False, "untouched"), ("same", 10, "1", True, "locked_equal"),
    ]
    locked = catalog.lock_settings(stored, spark.createDataFrame([("open",)], "world_id string"))
    assert rows(locked.where("is_locked"), "world_id") == [("open",), ("other",), ("same",)]
    known = spark.createDataFrame([("open",), ("none",)], "world_id string")
    assert rows(catalog.effective_settings(known, stored), "world_id", "chunk_size", "max_lookback_size", "overlap_size") == [
        ("none", 4000, 1000, 400), ("open", 10, 1, 1),
    ]


def test_seeds_keep_the_original_file_name(spark):
    table = assets(spark, asset(BG, built_in=True, original="mine.png"), asset("up"))
    state = {r.asset_id: r for r in catalog.upsert_assets(table, catalog.built_in_assets(spark)).collect()}
    assert len(state) == 15 and state[BG].original_filename == "mine.png"
    assert state[BG].display_name == "Main World Image" and state["up"].display_name == "up"
    assert state[FONT].full_font_name == "Inter" and state[FONT].is_built_in


def test_delete_with_fallback(spark):
    table = assets(spark, asset("img"), asset("font", "font"), asset("both"), asset("spare"), asset(BG, built_in=True))
    used = worlds(
        spark,
        ("1", "A", "img", "font", T(2026, 1, 1)), ("2", "B", "img", "both", T(2026, 1, 1)), ("3", "C", BG, "font", T(2026, 1, 1)),
    )
    confirm = "asset_id string, world_id string"
    good = spark.createDataFrame([("img", "1"), ("img", "2"), ("both", "2"), ("spare", None), (BG, "3")], confirm)
    left, changed = catalog.delete_with_fallback(table, used, good)
    assert rows(left, "asset_id") == sorted([("font",), (BG,)])
    # "both" is an image, so the world that uses it as a font keeps the reference.
    assert rows(changed, "world_id", "background_asset_id", "font_asset_id", "is_changed") == [
        ("1", BG, "font", True), ("2", BG, "both", True), ("3", BG, "font", False),
    ]
    stale = spark.createDataFrame([("img", "1"), ("font", "1"), ("font", "3"), ("font", "2")], confirm)
    left, changed = catalog.delete_with_fallback(table, used, stale)
    assert left.count() == 5 and changed.where("is_changed").isEmpty()
    assert rows(catalog.stale_confirmations(used, stale), "asset_id", "world_id", "reason") == [
        ("font", "2", "not_affected"), ("img", "2", "not_confirmed"),
    ]
    assert rows(catalog.deletable_assets(table, used), "asset_id") == [("spare",)]
    everything = table.select("asset_id")
    assert rows(catalog.delete_unused_assets(table, everything, used), "asset_id") == sorted([("img",), ("font",), ("both",), (BG,)])


def test_register_and_find_duplicates(spark):
    table = assets(spark, asset("b"), asset("a"))
    uploads = spark.createDataFrame(
        [("u1", "image", "unsafe\\Portrait.PNG", "sha256:a", None), ("u2", "font", " .ttf", "sha256:n", "Full")],
        "upload_id string, asset_type string, original_filename string, file_hash string, full_font_name string",
    )
    state = {r.asset_id: r for r in catalog.register_assets(table, uploads).collect()}
    assert (state["u1"].display_name, state["u1"].stored_path) == ("Portrait", "images/u1.png")
    assert (state["u2"].display_name, state["u2"].stored_path) == ("Uploaded font", "fonts/u2.ttf")
    assert rows(dedup.asset_duplicates(uploads, table), "upload_id", "duplicate_asset_id") == [("u1", "a")]


def test_name_conflicts(spark):
    table = worlds(spark, ("1", "One", BG, FONT, T(2026, 1, 1)))
    wanted = spark.createDataFrame([("1", "one"), ("2", "one"), ("3", "two")], "world_id string, display_name_key string")
    assert rows(catalog.name_conflicts(table, wanted), "world_id", "holder_id") == [("2", "1")]


def test_world_detail(spark):
    table = worlds(spark, ("1", "One", BG, FONT, T(2026, 1, 1)), ("2", "Two", BG, FONT, T(2026, 1, 1)))
    settings = spark.createDataFrame([("1", 10, 1, 1, "1", True)], schemas.SPLITTER_SETTINGS)
    sources = spark.createDataFrame(
        [("1", "s", "f.txt", "p", "txt", "h", 1, T(2026, 1, 1)), ("1", "t", "g.txt", "q", "txt", "i", 2, T(2026, 1, 1))], schemas.SOURCES
    )
    detail = catalog.world_detail(table, settings, sources)
    assert sorted((r.world_id, r.book_number or 0, r.is_readable) for r in detail.collect()) == [("1", 1, True), ("1", 2, True), ("2", 0, False)]
    url = catalog.world_cards(worlds(spark, ("1", "One", "image asset/one", FONT, T(2026, 1, 1)))).first()
    assert url.background_url == "/assets/image%20asset%2Fone/file" and url.last_used_at == "2026-01-01 00:00:00"


def test_world_detail_reads_every_row(spark, monkeypatch):
    from corpuspipe.plans import catalog_queries, roles

    folder, given = "/root/testdata/sf0.001", []
    own = catalog.world_detail
    monkeypatch.setattr(catalog, "world_detail", lambda *tables: given.extend(tables) or own(*tables))
    detail = catalog_queries.world_detail(spark, folder)
    assert given[2].count() == roles.documents(spark, folder, "source").count()
    assert given[1].count() == roles.settings(spark, folder).count()
    assert not detail.where("world_id like 'no-%'").count() and detail.where("world_id = 'src3'").count() == 1
