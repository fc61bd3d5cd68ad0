"""Columns are worked on in pieces, whatever the sizes of the values."""

import pyarrow as pa

from corpuspipe.sources import pieces, readers
from test_readers import epub


def test_every_row_once_and_in_order(monkeypatch):
    monkeypatch.setattr(pieces, "PIECE_BYTES", 10)
    monkeypatch.setattr(pieces, "PIECE_ROWS", 3)
    texts = ["a" * 25, None, "", "bcd", "e" * 8, "é" * 4, *"fghijkl"]
    held = [len(values[0]) for values in pieces.pieces((pa.array(texts),))]
    assert sum(held) == len(texts) and max(held) == 3 and held[0] == 1
    batches = [(pa.array(texts),), (pa.array([], pa.string()),), (pa.array(texts).slice(4),)]
    done = list(pieces.mapped(iter(batches), lambda text: text, pa.string()))
    assert [part.to_pylist() for part in done] == [texts, [], texts[4:]]


def test_epubs_over_many_pieces(spark, monkeypatch):
    rows = [(n, bytes(epub({"x": f"<p>{n}</p>", "y": "<p>z</p>"}, ["x", "y"])) if n % 5 else (None if n % 2 else b"no")) for n in range(60)]
    files = spark.createDataFrame(rows, "path long, content binary").where("content IS NOT NULL").coalesce(1)
    monkeypatch.setattr(pieces, "PIECE_ROWS", 7)
    found = readers.epub_documents(files).collect()
    good = {(n, i) for n in range(60) if n % 5 for i in (0, 1)}
    assert {(r.path, r.spine_index) for r in found if r.error is None} == good and len(found) == len(good) + 6
    assert {r.path for r in found if r.error} == {n for n in range(0, 60, 10)}
    texts = dict(files.select("path", readers.epub_text(files.content)).collect())
    assert all(texts[n] == (f"{n}\n\nz" if n % 5 else None) for n in texts) and len(texts) == 54


def test_freed_memory_is_given_back_around_a_task(monkeypatch):
    seen = []
    monkeypatch.setattr(pieces, "release_memory", lambda: seen.append("given back"))

    class Held:
        def __del__(self):
            seen.append("freed")

    def work(batches):
        held = Held()
        for batch in batches:
            seen.append(batch)
            yield batch

    assert list(pieces.released(work)(iter("ab"))) == ["a", "b"]
    assert seen == ["given back", "a", "b", "freed", "given back"]
    assert pieces.released_group(lambda table: (Held(), table)[1])("c") == "c"
    assert seen[5:] == ["freed", "given back"]
