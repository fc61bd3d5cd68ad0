import io
import zipfile
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from corpuspipe.sources import readers
from corpuspipe.sources.html import BLOCKS, EMPTY, UNREADABLE, html_blocks, read_blocks

SF = "/root/testdata/sf0.001"


def test_decode_text(spark):
    cases = {
        "plain": ("utf-8", "a\r\nb é".encode(), "a\r\nb é"),
        "bom8": ("utf-8-sig", b"\xef\xbb\xbfhey", "hey"),
        "le16": ("utf-16", "héy".encode("utf-16"), "héy"),
        "be16": ("utf-16", b"\xfe\xff" + "hi".encode("utf-16-be"), "hi"),
        "le32": ("utf-32", b"\xff\xfe\x00\x00" + "h😀".encode("utf-32-le"), "h😀"),
        "be32": ("utf-32", b"\x00\x00\xfe\xff" + "hi".encode("utf-32-be"), "hi"),
        "bad": ("utf-16", b"\xff\xff\xff"[:0] + b"\xff\xfe\x00", None),
        "bad8": ("utf-8", b"\xff\xff\xff", None),
        "tail": ("utf-8", b"good\x80", None),
        "empty": ("utf-8", b"", ""),
    }
    frame = spark.createDataFrame(
        [(name, bytearray(content)) for name, (_, content, _) in cases.items()], "path string, content binary"
    )
    rows = {r.path: r for r in readers.decode_text(frame).collect()}
    for name, (encoding, _, expected) in cases.items():
        assert (rows[name].encoding, rows[name].parsed_text) == (encoding, expected), name
        assert rows[name].is_decodable == (expected is not None)


def test_read_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"alpha")
    rows = readers.decode_text(readers.read_files(spark, str(tmp_path))).collect()
    assert [r.parsed_text for r in rows] == ["alpha"]


HTML_CASES = [
    ("<body><h1>Title</h1><p>A <em>bold</em> word.</p><ul><li>One</li><li>Two</li></ul><blockquote>Q</blockquote></body>",
     ["Title", "A bold word.", "One", "Two", "Q"]),
    ("<div>a</div><div>b</div>", ["a b"]),
    ("x<div>t<p>p</p>after</div>tail", ["x", "t", "p", "after", "tail"]),
    ("<table><tr><td>a</td><td> b <b>c</b></td><td> </td></tr><tr>loose</tr></table>", ["a | b c", "loose"]),
    ("<pre> a \n\n  b <b>x</b></pre>", ["a\n  b\nx"]),
    ("<head><title>t</title></head><body>one<!-- c --> two<nav>no</nav></body>after", ["one two"]),
    ("<p>  </p><img src='x'>", []),
    ("<p>a<p>b</div>c", ["a b c"]),
    ("a<br/>b &amp; c", ["a b & c"]),
    ("<script>x<p>y</script><style>p{}</style>ok", ["ok"]),
    ("", []),
]


@pytest.mark.parametrize("markup,blocks", HTML_CASES)
def test_html_cases(markup, blocks):
    assert read_blocks(markup) == blocks


class _Tree(HTMLParser):
    """Independent check: build the whole tree, then walk it by the rules."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", []]
        self.path = [self.root]
        self.data = []

    def flush(self):
        if self.data:
            self.path[-1][1].append("".join(self.data))
            self.data = []

    def handle_data(self, data):
        self.data.append(data)

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_starttag(self, tag, attrs):
        self.flush()
        node = [tag, []]
        self.path[-1][1].append(node)
        if tag not in EMPTY:
            self.path.append(node)

    def handle_startendtag(self, tag, attrs):
        self.flush()
        self.path[-1][1].append([tag, []])

    def handle_endtag(self, tag):
        self.flush()
        names = [node[0] for node in self.path[1:]]
        if tag in names:
            while self.path.pop()[0] != tag:
                pass


def strings(node):
    if isinstance(node, str):
        return [node.strip()] if node.strip() else []
    return [s for child in node[1] for s in strings(child)]


def prune(node):
    node[1] = [c for c in node[1] if isinstance(c, str) or c[0] not in UNREADABLE]
    for child in node[1]:
        if not isinstance(child, str):
            prune(child)


def find(node, wanted):
    for child in node[1]:
        if not isinstance(child, str):
            if child[0] in wanted:
                return child
            inner = find(child, wanted)
            if inner:
                return inner
    return None


def flat(node):
    return " ".join(" ".join(strings(node)).split())


def walk(node):
    blocks, run = [], []

    def end_run():
        if run:
            blocks.append(" ".join(run))
            run.clear()

    structural = BLOCKS | {"tr"}
    for child in node[1]:
        if isinstance(child, str) or (child[0] not in structural and not find(child, structural)):
            piece = flat(child) if not isinstance(child, str) else " ".join(child.split())
            if piece:
                run.append(piece)
            continue
        end_run()
        if child[0] == "pre":
            lines = [line.rstrip() for line in "\n".join(strings(child)).splitlines()]
            found = "\n".join(line for line in lines if line)
            blocks.extend([found] if found else [])
        elif child[0] in BLOCKS:
            blocks.extend([flat(child)] if flat(child) else [])
        elif child[0] == "tr":
            cells = [flat(c) for c in child[1] if not isinstance(c, str) and c[0] in ("td", "th")]
            cells = [c for c in cells if c]
            row = " | ".join(cells) if cells else flat(child)
            blocks.extend([row] if row else [])
        else:
            blocks.extend(walk(child))
    end_run()
    return blocks


def tree_blocks(markup):
    tree = _Tree()
    tree.feed(markup)
    tree.close()
    tree.flush()
    prune(tree.root)
    return walk(find(tree.root, {"body"}) or tree.root)


def test_stream_reader_equals_tree_walk_on_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = pages.select("page_id", "html", html_blocks(F.col("html")).alias("blocks")).collect()
    assert len(rows) > 0
    for row in rows:
        assert row.blocks == tree_blocks(row.html), row.page_id


def test_stream_reader_equals_tree_walk_on_random_markup():
    import random

    pick = random.Random(7)
    tags = ["div", "p", "span", "tr", "td", "li", "pre", "nav", "body", "b", "table", "br", "head"]
    for _ in range(3000):
        parts = []
        for _ in range(pick.randrange(1, 25)):
            tag = pick.choice(tags)
            parts.append(pick.choice([f"<{tag}>", f"</{tag}>", f"<{tag}/>", "x", " y ", "\n", "<!--c-->", "z\n w"]))
        markup = "".join(parts)
        assert read_blocks(markup) == tree_blocks(markup), markup


def epub(documents, spine, extra=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr(
            "META-INF/container.xml",
            '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles>'
            '<rootfile full-path="OEBPS/content.opf"/></rootfiles></container>',
        )
        items = "".join(
            f'<item id="{i}" href="{i}%20file.xhtml" media-type="application/xhtml+xml"/>' for i in documents
        )
        refs = "".join(f'<itemref idref="{i}"/>' for i in spine)
        archive.writestr(
            "OEBPS/content.opf",
            f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}{extra}</manifest><spine>{refs}</spine></package>',
        )
        for name, body in documents.items():
            archive.writestr(f"OEBPS/{name} file.xhtml", f"<html><body>{body}</body></html>")
    return bytearray(out.getvalue())


def test_epub(spark):
    documents = {"a": "<p>First.</p>", "b": "<p>Second.</p>", "c": "<p> </p>"}
    image = '<item id="i" href="i.png" media-type="image/png"/>'
    files = [
        ("order", epub(documents, ["b", "i", "a", "c"], image)),
        ("unknown", epub(documents, ["a", "zz"])),
        ("broken", bytearray(b"no zip")),
    ]
    frame = spark.createDataFrame(files, "path string, content binary")
    texts = {r.path: r.t for r in frame.select("path", readers.epub_text(F.col("content")).alias("t")).collect()}
    assert texts == {"order": "Second.\n\nFirst.", "unknown": None, "broken": None}
    rows = readers.epub_documents(frame).collect()
    assert {(r.path, r.spine_index) for r in rows if r.error is None} == {("order", 0), ("order", 1), ("order", 2)}
    assert {r.path for r in rows if r.error} == {"unknown", "broken"}


def test_pages(spark, monkeypatch):
    pages = spark.createDataFrame(
        [("a", 2, "Second page."), ("a", 1, " First page. "), ("a", 3, "　"), ("b", 1, " "), ("c", 1, "x" * 100)],
        "source_id string, page int, t string",
    )
    whole = {r.source_id: r.parsed_text for r in readers.assemble_pages(pages, ["source_id"], "page", "t").collect()}
    assert whole == {"a": "First page.\n\nSecond page.", "c": "x" * 100}
    assert [r.entity_key for r in readers.page_violations(pages, ["source_id"], "t").collect()] == ["b"]
    monkeypatch.setattr(readers, "MAX_TEXT_BYTES", 50)
    kept = readers.assemble_pages(pages, ["source_id"], "page", "t").collect()
    assert [r.source_id for r in kept] == ["a"]
    assert [r.source_id for r in readers.oversized_pages(pages, ["source_id"], "t").collect()] == ["c"]
    told = {(r.entity_key, r.rule) for r in readers.page_violations(pages, ["source_id"], "t").collect()}
    assert told == {("b", "text_unusable"), ("c", "text_too_large")}


def test_oversized_sources_are_kept_as_parts(spark, monkeypatch, tmp_path):
    from corpuspipe.plans import text_queries

    large = [("big", k % 90, f" page {k} " + "é" * (k % 7)) for k in range(100)] + [("big", 95, "y" * 300), ("big", 96, "end")]
    rows = [*large, ("a", 2, "Second."), ("a", 1, "First."), ("big", 50, " \n"), ("b", 1, " ")]
    pages = spark.createDataFrame(rows, "conv_id string, turn int, text string")
    expected = {"a": "First.\n\nSecond.", "big": "\n\n".join(t.strip() for _, _, t in sorted((s, k, t.strip()) for s, k, t in large))}
    for limit in (1 << 30, 120):
        monkeypatch.setattr(readers, "MAX_TEXT_BYTES", limit)
        found = sorted(readers.assemble_parts(pages, ["conv_id"], "turn", "text").collect())
        assert len({(r.conv_id, r.part) for r in found}) == len(found)
        texts = {key: [r.parsed_text for r in found if r.conv_id == key] for key in {r.conv_id for r in found}}
        assert {key: "\n\n".join(parts) for key, parts in texts.items()} == expected
        assert (len(texts["big"]) > 5) == (limit == 120) and len(texts["a"]) == 1
    pages.write.parquet(str(tmp_path / "conversations.parquet"))
    rows = text_queries.assemble_pages(spark, str(tmp_path)).collect()
    assert sorted("\n\n".join(r.parsed_text for r in rows if r.conv_id == "big").split()) == sorted(expected["big"].split())
