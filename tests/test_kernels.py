"""Kernels against plain-Python models, and parsers against hand-written cases."""

import json
import random

from pyspark.sql import functions as F

from tessera.functions import symbols as X
from tessera.functions import text as T
from tessera.operators import code, graph, markdown, packing, search, structured
from tessera.sources import converters, symbols


def lines_model(sizes, capacity, extra, oversize):
    out, cur, total = [], [], 0
    for k, n in enumerate(sizes, 1):
        if oversize and n > capacity * oversize:
            if cur:
                out.append((cur[0], cur[-1], False))
            out.append((k, k, True))
            cur, total = [], 0
            continue
        if cur and total + n + extra > capacity:
            out.append((cur[0], cur[-1], False))
            cur, total = [k], n
        else:
            cur.append(k)
            total += n + extra
    return out + ([(cur[0], cur[-1], False)] if cur else [])


def test_pack(spark):
    rng = random.Random(1)
    rows = [(k, [rng.choice([0, 3, 9, 10, 14, 15, 16, 40]) for _ in range(rng.randint(0, 12))]) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, s array<int>")
    for extra, oversize in ((0, None), (1, None), (0, 1.5)):
        got = {r.k: [tuple(x) for x in r.o] for r in df.select("k", packing.pack(F.col("s"), 10, oversize, extra).alias("o")).collect()}
        for k, s in rows:
            want = lines_model(s, 10, extra, oversize)
            assert got[k] == want, (s, extra, oversize)
            if oversize:
                assert [(a + 1, b, x) for a, b, x in structured.fill(s, 10)] == want


def paragraphs_model(paras, capacity):
    out, cur = [], []
    for p in paras:
        total = sum(map(len, cur))
        if len(p) > capacity:
            if cur:
                out.append("\n\n".join(cur))
            cur = []
            lines = p.split("\n")
            out += ["\n".join(lines[a - 1 : b]) for a, b, _ in lines_model([len(x) for x in lines], capacity, 1, None)]
        elif cur and total + len(p) > capacity:
            out.append("\n\n".join(cur))
            cur = [cur[-1], p] if len(cur[-1]) + len(p) <= capacity else [p]
        else:
            cur.append(p)
    return out + (["\n\n".join(cur)] if cur else [])


def test_paragraphs(spark):
    rng = random.Random(2)
    rows = [(k, ["x" * rng.choice([1, 4, 6, 11]) if rng.random() < 0.8 else "ab\ncdefghi\n\njk" for _ in range(rng.randint(1, 9))]) for k in range(300)]
    got = {r.k: r.o for r in spark.createDataFrame(rows, "k int, p array<string>").select("k", packing.paragraph_pack(F.col("p"), 10).alias("o")).collect()}
    for k, p in rows:
        assert got[k] == paragraphs_model(p, 10)


def test_markdown(spark):
    text = "\nintro\n# One\nbody `x`\n#nospace\n```\n# fenced\n```\n###### Six  \nend"
    rows = [(1, text), (2, ""), (3, "# Only"), (4, "plain\r\ntext"), (5, "   \n\n")]
    got = spark.createDataFrame(rows, "k int, text string").select("k", F.explode(markdown.sections(F.col("text"))).alias("s")).select("k", "s.*").collect()
    assert [(r.k, r.title, r.level, r.start, r.end) for r in got] == [(1, "Introduction", 0, 1, 2), (1, "One", 1, 3, 6), (1, "fenced", 1, 7, 8), (1, "Six", 6, 9, 10), (3, "Only", 1, 1, 1), (4, "Introduction", 0, 1, 2)]
    chunks = markdown.chunks(spark.createDataFrame([(1, "# A\n" + "w " * 4 + "\n## B\nx\n# C\n" + "para one is long\n\npara two is long\n\nz")], "k int, text string"), 24).orderBy("ordinal").collect()
    assert [(r.text, r.section_hierarchy, r.header_levels, r.is_partial) for r in chunks] == [
        ("# A\nw w w w \n\n## B\nx", "A > B", "1,2", None),
        ("# C\npara one is long", "C", "1", True),
        ("para two is long\n\nz", "C", "1", True),
    ]


def test_markdown_line_breaks(spark):
    """Only a line feed ends a line, and one at the end of a text stays with its section, as an empty last line."""
    rows = [(1, "before\n# src\n"), (2, "# a\n## part\n\n## part\n"), (3, "x\r# y\n# z\u2028# w\nq"), (4, "# a\n\n\n")]
    got = spark.createDataFrame(rows, "k int, text string").select("k", F.explode(markdown.sections(F.col("text"))).alias("s")).select("k", "s.*").orderBy("k", "start").collect()
    assert [(r.k, r.title, r.start, r.end, r.content) for r in got] == [
        (1, "Introduction", 1, 1, "before"),
        (1, "src", 2, 3, "# src\n"),
        (2, "a", 1, 1, "# a"),
        (2, "part", 2, 3, "## part\n"),
        (2, "part", 4, 5, "## part\n"),
        (3, "Introduction", 1, 1, "x\r# y"),
        (3, "z\u2028# w", 2, 3, "# z\u2028# w\nq"),
        (4, "a", 1, 4, "# a\n\n\n"),
    ]


def test_counts(spark):
    rich = "- [ ] a\n- [x] b\n  - [X] c\n-[ ] no\n[![badge](s)](u) [l](m) ![i](j)\n| a | b |\n|---|:-:|\n```\nq\n```\nnb sp"
    r = spark.createDataFrame([(rich,)], "t string").select([c.alias(n) for n, c in T.markdown(F.col("t")).items()]).first()
    assert (r.checkbox_count, r.checked_count, r.unchecked_count, r.link_count, r.image_count, r.table_count, r.code_block_count) == (3, 2, 1, 2, 2, 1, 1)
    assert r.word_count == len(rich.split())


def test_json():
    big = {"a": 1, "b": {"x": "y" * 50}, "c": [1, 2]}
    out = structured.json_chunks(json.dumps(big), 40)
    assert [c["json_path"] for c in out] == ["$.a", "$.b", "$.c"] and out[1]["chunk_type"] == "json_split" and json.loads(out[1]["text"]) == {"b": {"x": "y" * 50}}
    assert [c["array_range"] for c in structured.json_chunks(json.dumps([{"k": "v" * 9}] * 45), 50)] == ["0-20", "20-40", "40-45"]
    small = structured.json_chunks('{"a": 1, "é": 2}', 400)
    assert small[0]["json_path"] == "$.{a,é}" and small[0]["keys"] == "a, é" and '"é": 2' in small[0]["text"] and "json_key" not in small[0]
    assert structured.json_chunks("{bad", 40) == [{"language": "json", "chunk_type": "structured", "text": "{bad", "json_path": "$"}]
    assert structured.json_chunks("{}", 40) == [] and structured.json_chunks(" ", 40) == []
    assert structured.json_chunks("7", 40)[0]["json_type"] == "int"
    nested = structured.json_chunks(json.dumps({"k": {str(i): "v" * 9 for i in range(9)}}), 40, split_nested=True)
    assert len(nested) > 1 and all(c["json_path"] == "$.k" for c in nested)
    assert structured.json_units(list(range(120)), "")[-1].name == "array_items_100_120"


def test_bounded_batches(spark, tmp_path):
    """Parsers get and give texts in batches of bounded size, whatever the table's."""
    from tessera.operators import batches
    from tessera.plans import catalogue

    rows = [{"text": "x" * n} for n in (5, 400, 1, 900, 2, 3)] + [{"text": None}]
    got = list(batches.pieces(rows, chars=450))
    assert [r for some in got for r in some] == rows and [len(some) for some in got] == [2, 2, 3]
    assert list(batches.pieces([])) == []
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = [None, "", *("line\n" * 60_000 for _ in range(20))]
    spark.createDataFrame([(k, "en", t) for k, t in enumerate(texts)], "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.json_chunks(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == batches.BATCH_BYTES
    assert [(r.doc_id, r.ordinal) for r in found.select("doc_id", "ordinal").collect()] == [(0, 0), (1, 0), *((k, o) for k in range(2, 22) for o in (0, 1))]


def test_xml():
    out = structured.xml_chunks("<r xmlns='u'><a>1</a>tail<b><c/></b></r>", 400)
    assert out[0]["xml_path"] == "/r/{a,b}" and out[0]["tag_count"] == 2 and out[0]["child_count"] == 1 and "tail" in out[0]["text"]
    many = structured.xml_chunks("<r>" + "<i>v</i>" * 60 + "</r>", 10_000)
    assert many[0]["is_grouped"] and many[0]["xml_tag"] == "i" and many[0]["child_count"] == 60
    large = structured.xml_chunks("<r><a>" + "<b>xxxxxxxxxx</b>" * 4 + "</a></r>", 30)
    assert {c["xml_path"] for c in large} == {"/r/a/b"} and all(c["is_partial"] for c in large)
    assert structured.xml_chunks("<r", 10)[0]["xml_path"] == "/" and structured.xml_chunks("<r/>", 10) == []


def test_code():
    source = "import os\n\n\n@x\ndef one():\n    return 1\n\n\nclass Two:\n    pass\n"
    chunks = code.code_chunks(source, "python", 40)
    assert [(c["start_line"], c["end_line"]) for c in chunks][0][0] == 1 and any("class Two" in c["text"] for c in chunks)
    assert "".join("".join(c["text"].split()) for c in chunks) == "".join(source.split())
    assert code.code_chunks("def broken(:", "python", 40)[0]["text"] == "def broken(:"
    assert code.code_chunks(" ", "python", 40) == [] and code.code_chunks("x", None, 40) == []
    parts = code.sentences("One two. Three four! Five six? Seven.", 4, 2)
    assert parts == ["One two. Three four!", "Three four! Five six?", "Five six? Seven."]


def test_symbol_names(spark):
    names = ["s a `f.py`/Cls#", "s a `f.py`/Cls#run().", "s a `f.py`/Cls#run(+1).", "s a `f.py`/Cls#Name.", "s a `f.py`/Cls#field.", "local 3"]
    rows = spark.createDataFrame([(n,) for n in names], "s string").select(X.display_name(F.col("s")).alias("d"), X.inferred_kind(F.col("s")).alias("k")).collect()
    assert [(r.d, r.k) for r in rows] == [("Cls", "class"), ("run", "method"), ("run", "method"), ("Name", "property"), ("field", "field"), ("3", "unknown")]


def test_filters(spark):
    rows = spark.createDataFrame([("f", "python", 3, 9), ("g", None, None, None)], "file_path string, language string, start_line int, end_line int")
    assert search.predicate({"languages": [], "line_min": 0, "must_contain": ""}) is None
    assert rows.where(search.predicate({"line_min": 1})).count() == 1
    assert search.merged_filters({"languages": ["a"]}, "b", None, "p") == {"languages": ["a", "b"], "file_path_contains": "p"}


def encode(field, value):
    if isinstance(value, int):
        out, head = b"", field << 3
        rest = value
        while rest >= 0x80:
            out += bytes([rest & 0x7F | 0x80])
            rest >>= 7
        return bytes([head]) + out + bytes([rest])
    data = value.encode() if isinstance(value, str) else value
    return bytes([field << 3 | 2]) + encode(0, len(data))[1:] + data


def test_symbol_index(spark, tmp_path):
    occurrence = lambda where, name, roles: encode(2, encode(1, bytes(where)) + encode(2, name) + (encode(3, roles) if roles else b""))
    symbol = lambda name, kind, doc: encode(3, encode(1, name) + encode(3, doc) + encode(5, kind))
    document = encode(1, "src/a.py") + occurrence([0, 4, 9], "m/first().", 1) + occurrence([3, 4, 9], "m/second().", 1) + occurrence([4, 1, 6], "m/first().", 0) + symbol("m/first().", 26, "Docs.\nmore") + symbol("m/second().", 26, "")
    (tmp_path / "x.index.scip").write_bytes(encode(2, document))
    (tmp_path / "y.index.scip").write_bytes(b"\xff\xff\xff")
    declared, seen = symbols.read(spark, [str(p) for p in tmp_path.iterdir()])
    seen = symbols.spans(seen)
    assert seen.count() == 3 and declared.count() == 2
    edges = graph.call_edges(seen, declared).collect()
    assert [(e.caller, e.callee) for e in edges] == [("m/second().", "m/first().")]
    chunks = spark.createDataFrame([("1", "/r/src/a.py", "code", 1, 2), ("2", "/r/src/a.py", "code", 4, 6), ("3", "/r/other.py", "code", 1, 2), ("4", "/r/src/a.py", "document", 1, 2)], "id string, file_path string, chunk_type string, start_line int, end_line int")
    got = {r.id: r for r in graph.enriched(chunks, declared, seen).collect()}
    assert (got["1"].display_name, got["1"].kind, got["1"].callers, got["2"].callees) == ("first", "method", "m/second().", "m/first().")
    assert got["3"].symbol is None and got["4"].symbol is None


def test_lookup_against_model(spark):
    rng = random.Random(7)
    table = [(0, k, f"s{k}", rng.randint(0, 40), f"d/{rng.choice('ab')}.py") for k in range(30)]
    spans = [(k, f"/x/d/{rng.choice('ab')}.py", a := rng.randint(1, 41), rng.choice([0, a, a + 5])) for k in range(200)]
    got = {r.id: r.symbol for r in graph.lookup(spark.createDataFrame(spans, "id int, file_path string, start_line int, end_line int"), spark.createDataFrame(table, "index_ord int, ord int, symbol string, start int, relative_path string")).collect()}
    for k, path, a, b in spans:
        near = [s for s in table if path.endswith(s[4])]
        inside = [s for s in near if b > 0 and a - 1 <= s[3] <= b - 1]
        before = [s for s in near if s[3] <= a - 1]
        want = min(inside, key=lambda s: (s[3], s[1])) if inside else min(before, key=lambda s: (-s[3], s[1])) if before else min(near, key=lambda s: (s[3], s[1]))
        assert got[k] == want[2]


def test_converters():
    assert converters.convert(".csv", b"a,b\n1,2|3\n") == "| a | b |\n| --- | --- |\n| 1 | 2\\|3 |"
    cells = {"cells": [{"cell_type": "markdown", "source": ["# T"]}, {"cell_type": "code", "source": ["x=1"]}]}
    assert converters.convert(".ipynb", json.dumps(cells).encode()) == "# T\n\n```\nx=1\n```"
    assert converters.convert(".pdf", b"%PDF") is None and converters.convert(".ipynb", b"{") is None
