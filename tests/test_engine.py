import json

import pytest

from tessera import config
from tessera.api import Engine
from tessera.sources import files
from tessera.streaming import incremental


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "node_modules" / "x").mkdir(parents=True)
    (root / "a.py").write_text("import os\n\n\ndef first():\n    return 1\n\n\ndef second():\n    return first()\n")
    (root / "src" / "B.CS").write_text("class B {\n  void M() { }\n}\n")
    (root / "src" / "gen.g.cs").write_text("class G { }\n")
    (root / "readme.md").write_text("intro line\n# Title\nsome words here\n## Part two\nmore words of the second part\n")
    (root / "data.json").write_text(json.dumps({"name": "x", "list": list(range(12)), "é": {"k": None}}, ensure_ascii=False))
    (root / "doc.xml").write_text("<r xmlns='u'><a>1</a><b><c/></b></r>")
    (root / "table.csv").write_text("h1,h2\n1,2\n")
    (root / "empty.md").write_text("")
    (root / "x.dll").write_text("zz")
    (root / "node_modules" / "x" / "n.js").write_text("var a;")
    return root


def names(df):
    return sorted(r.file_name for r in df.select("file_name").collect())


def test_scan(spark, tree):
    assert names(files.scan(spark, str(tree))) == ["B.CS", "a.py", "data.json", "doc.xml", "gen.g.cs", "readme.md", "table.csv"]
    assert names(files.scan(spark, str(tree), exclude=[".g.cs", ".PY"])) == ["B.CS", "data.json", "doc.xml", "readme.md", "table.csv"]
    assert names(files.scan(spark, str(tree), include=[".md"])) == ["readme.md"]
    assert files.count(spark, str(tree)) == 7 and files.count(spark, str(tree / "no")) == 0
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(tree / "no"))
    kinds = {r.file_name: (r.file_type, r.language, r.parser) for r in files.scan(spark, str(tree), content=False).collect()}
    assert kinds["B.CS"] == ("code", "csharp", "code") and kinds["doc.xml"] == ("structured", None, "xml")


def test_life_cycle(spark, tree, tmp_path):
    settings = config.Settings(ingest_batch_size=3)
    engine = Engine(spark, str(tmp_path / "db"), settings)
    assert engine.query("anything")["chunks"] == []
    report = engine.index_directory(str(tree))
    assert report["status"] == "ok" and report["files_processed"] == 7 == report["total_files"]
    assert [b["files_processed"] for b in report["batches"]] == [3, 3, 1] and report["batches_failed"] == 0
    assert report["chunks_created"] == sum(b["chunks_created"] for b in report["batches"])
    listed = engine.list_documents()
    assert listed["total_documents"] == 7 and listed["total_chunks"] == report["chunks_created"]
    sources = engine.list_sources()
    assert sources["languages"] == ["csharp", "json", "python", "xml"] and sources["chunk_types"] == ["code", "document", "structured"]
    found = engine.query("words of the second part", filters={"chunk_types": ["document"], "file_path_contains": "readme"})
    assert found["chunks"] and found["chunks"][0]["metadata"]["file_name"] == "readme.md" and found["chunks"][0]["text"].startswith("[Document: readme.md] [Type: md]")
    assert engine.query("def", language_filter="python")["chunks"][0]["text"].startswith("// File     : a.py\n// Language : python\n\n")
    bad = engine.query("x", filters={"sources": ["nope"]})
    assert bad["status"] == "error" and len(bad["known_sources"]) == 7
    path = f"{tree}/readme.md"
    (tree / "readme.md").write_text("# Only\none\n")
    done = engine.replace_document(path)
    assert done["status"] == "ok" and done["new_chunks"] == 1
    assert engine.query("Only one", filters={"sources": [path]})["chunks"][0]["metadata"]["section_title"] == "Only"
    assert engine.remove_document(path) == {"status": "ok", "removed": path, "chunks_deleted": 1}
    assert engine.remove_document(path)["status"] == "warning"
    assert engine.replace_document(f"{tree}/gone.md")["status"] == "error"
    state = json.loads(engine.read_resource("rag://stats"))
    assert state["by_language"] and state["total_documents"] == 6
    assert json.loads(engine.read_resource("rag://status"))["database"]["total_documents"] == 6
    assert json.loads(engine.call("nothing")) == {"error": "unknown tool: nothing"}
    assert engine.clear_database()["status"] == "rejected"
    assert engine.clear_database(confirm=True)["documents_removed"] == 6 and engine.store.chunks.count() == 0


def test_large_directory_asks(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"), config.Settings(ingest_large_dir_threshold=3))
    assert engine.index_directory(str(tree))["status"] == "requires_confirmation"
    assert engine.index_directory(str(tree), include_extensions=[".md"])["status"] == "ok"
    assert engine.index_directory(str(tree / "no"))["status"] == "error"


def test_failing_batch_stops(spark, tree, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "db"), config.Settings(ingest_batch_size=3))
    real = engine.pipeline.ingest_batch
    calls = []

    def flaky(found, indexes):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("down")
        return real(found, indexes)

    monkeypatch.setattr(engine.pipeline, "ingest_batch", flaky)
    report = engine.index_directory(str(tree))
    assert (report["status"], report["batches_completed"], report["batches_failed"], report["files_processed"]) == ("partial", 1, 1, 3)
    assert report["batches"][1]["error"] == "down"


def test_stream(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"), config.Settings(ingest_batch_size=4))
    for _ in range(2):
        incremental.start(engine.pipeline, str(tree), str(tmp_path / "ckpt")).awaitTermination()
        assert engine.store.registry.count() == 7
    (tree / "new.txt").write_text("fresh words")
    incremental.start(engine.pipeline, str(tree), str(tmp_path / "ckpt")).awaitTermination()
    assert engine.store.registry.count() == 8


def test_settings(tmp_path):
    s = config.Settings()
    assert (s.ingest_batch_size, s.ingest_large_dir_threshold, s.chunk_overlap) == (100, 10_000, round(512 * 0.2))
    (tmp_path / "c.yaml").write_text("chunk_size: 256\nexclude_dirs: [x]\ningest_batch_size: bad\n")
    s = config.load(str(tmp_path / "c.yaml"))
    assert (s.chunk_size, s.exclude_dirs, s.ingest_batch_size, s.chunk_overlap) == (256, ("x",), 100, 51)
    assert config.load(str(tmp_path / "no.yaml")) == config.Settings()


def office(kind):
    """Small files of each ZIP-packaged kind."""
    import io
    import zipfile

    members = {
        ".docx": {"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>some </w:t></w:r><w:r><w:t>words</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>'},
        ".pptx": {f"ppt/slides/slide{k}.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>point {k}</a:t></a:r></a:p></p:sld>' for k in (10, 2)},
        ".xlsx": {"xl/workbook.xml": '<workbook><sheets><sheet name="Data"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>head</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="B2"><v>8</v></c></row></sheetData></worksheet>'},
        ".epub": {"OPS/c1.xhtml": '<html xmlns="h"><body><h1>One</h1><p>text <i>here</i></p></body></html>'},
    }[kind]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def test_converters():
    from tessera.sources import converters

    assert converters.convert(".docx", office(".docx")) == "## Title\n\nsome words\n\n| a |  |\n| --- | --- |"
    assert converters.convert(".pptx", office(".pptx")) == "# Slide 1\n\npoint 2\n\n# Slide 2\n\npoint 10"
    assert converters.convert(".xlsx", office(".xlsx")) == "## Data\n\n| head |  | 7 |\n| --- | --- | --- |\n|  | 8 |  |"
    assert converters.convert(".epub", office(".epub")) == "# One\n\ntext here"
    assert converters.convert(".docx", b"no archive") is None


def test_errors_of_single_files(spark, tree, tmp_path):
    """A file that cannot be converted, and one that is gone by the time of its batch, are reported; the others are stored."""
    (tree / "scan.pdf").write_bytes(b"%PDF-1.4 \x00\xff")
    (tree / "text.docx").write_bytes(office(".docx"))
    (tree / "odd [name]*.txt").write_text("kept words")
    engine = Engine(spark, str(tmp_path / "db"), config.Settings(ingest_batch_size=4, embed_builder_debug=True, embed_builder_debug_output_dir=str(tmp_path / "debug")))
    real, gone = files.load, tree / "doc.xml"

    def load(session, paths, settings=None):
        gone.unlink(missing_ok=True)
        return real(session, paths, settings)

    files.load = load
    try:
        report = engine.index_directory(str(tree))
    finally:
        files.load = real
    assert report["status"] == "ok" and report["files_processed"] == 8
    assert sorted(e.split(": ", 1)[1] for e in report["errors"]) == ["cannot be converted: .pdf", "cannot be read"]
    assert report["errors"] == [e for b in report["batches"] for e in b["errors"]]
    stored = {r.file_name: r for r in engine.store.chunks.read().collect()}
    assert stored["text.docx"].markitdown_converted and stored["text.docx"].original_doc_type == "docx" and "odd [name]*.txt" in stored
    assert "scan.pdf" not in stored and "doc.xml" not in stored
    assert (tmp_path / "debug" / "a.py.html").read_text().startswith("<html>")


def test_store_versions(spark, tree, tmp_path):
    """A change appends; what has no registry row is not read; compaction keeps the live rows."""
    engine = Engine(spark, str(tmp_path / "db"))
    engine.index_directory(str(tree))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "db").rglob("*.parquet")}
    rows = lambda: sorted((r.file_path, r.ordinal, r.text) for r in engine.store.chunks.read().collect())
    first = rows()
    (tree / "readme.md").write_text("# New\nwords\n")
    engine.replace_document(f"{tree}/readme.md")
    assert all(p.exists() and p.stat().st_mtime_ns == t for p, t in before.items())
    second = rows()
    assert first != second and len([r for r in second if r[0].endswith("readme.md")]) == 1
    # a run that died after its chunks and before its commit
    engine.store.chunks.read().write.parquet(str(tmp_path / "db" / "chunks" / "version=5"))
    assert rows() == second and engine.store.chunks.count() == len(second)
    engine.remove_document(f"{tree}/a.py")
    third = rows()
    engine.store.compact()
    assert rows() == third and len(list((tmp_path / "db" / "registry").glob("version=*"))) == 1


def test_one_listing_and_one_read_of_each_file(spark, tmp_path):
    """Two thousand files in batches: every file is loaded by one batch."""
    root = tmp_path / "many"
    root.mkdir()
    for k in range(2000):
        (root / f"f{k:04d}.txt").write_text(f"words of file {k}")
    engine = Engine(spark, str(tmp_path / "db"), config.Settings(ingest_batch_size=500))
    real, seen = files.load, []
    files.load = lambda s, paths, settings=None: (seen.append(list(paths)), real(s, paths, settings))[1]
    try:
        report = engine.index_directory(str(root))
    finally:
        files.load = real
    assert [len(p) for p in seen] == [500] * 4 and len({x for p in seen for x in p}) == 2000
    assert report["files_processed"] == 2000 == engine.store.registry.count() == engine.store.chunks.count()


def test_many_batches_in_one_pass(spark, tree, tmp_path, monkeypatch):
    """Beyond a few batches there is one commit; reports, errors and rows are those of batches that run one by one."""
    (tree / "scan.pdf").write_bytes(b"%PDF-1.4 \x00\xff")
    (tree / "blank.md").write_text("  \n")
    (tree / "Zed.txt").write_text("last words")
    real, gone = files.symbol_indexes, tree / "doc.xml"

    def lost(session, root):
        gone.unlink()
        return real(session, root)

    monkeypatch.setattr(files, "symbol_indexes", lost)
    seen = []
    for few in (4, 99):
        gone.write_text("<r><a>1</a></r>")
        monkeypatch.setattr("tessera.ingest.FEW_BATCHES", few)
        engine = Engine(spark, str(tmp_path / f"db{few}"), config.Settings(ingest_batch_size=2))
        report = engine.index_directory(str(tree))
        versions = len(list((tmp_path / f"db{few}" / "registry").glob("version=*")))
        report["ingestion_stats"] = {k: v for k, v in report["ingestion_stats"].items() if k.startswith("by")}
        seen.append((versions, report, sorted((r.file_path, r.ordinal, r.text) for r in engine.store.chunks.read().collect()), sorted(r.file_path for r in engine.store.registry.read().collect())))
    assert (seen[0][0], seen[1][0]) == (1, 5) and seen[0][1:] == seen[1][1:]
    assert [b["files_processed"] for b in seen[0][1]["batches"]] == [2, 1, 1, 2, 2] and len(seen[0][1]["errors"]) == 2


def test_failing_pass_runs_batches(spark, tree, tmp_path, monkeypatch):
    """If the pass over all batches fails, those before the failing one are stored."""
    engine = Engine(spark, str(tmp_path / "db"), config.Settings(ingest_batch_size=1))
    real, calls = engine.pipeline._ingest, []

    def flaky(found, indexes):
        calls.append(1)
        if len(calls) in (1, 3):
            raise RuntimeError("down")
        return real(found, indexes)

    monkeypatch.setattr(engine.pipeline, "_ingest", flaky)
    report = engine.index_directory(str(tree))
    assert (report["status"], report["batches_completed"], report["batches"][1]) == ("partial", 1, {"batch_index": 1, "error": "down"})
    assert engine.store.registry.count() == 1


def test_symbol_indexes_below(spark, tree):
    for place in ("src/.scip/deep", "node_modules/x"):
        (tree / place).mkdir(parents=True, exist_ok=True)
        (tree / place / "a.index.scip").write_bytes(b"")
    (tree / "src" / "index.scip").mkdir()
    assert [p.removeprefix(f"file:{tree}/") for p in files.symbol_indexes(spark, str(tree))] == ["node_modules/x/a.index.scip", "src/.scip/deep/a.index.scip"]


def test_embedding_server(spark, tree, tmp_path):
    """The server that the settings name is asked; a store refuses the vectors of another model."""
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            assert self.path == "/api/embed" and asked["model"] == "m1"
            body = json.dumps({"embeddings": [[float(len(t)), 1.0, 2.0] for t in asked["input"]]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    (tmp_path / "c.yaml").write_text(f"ollama_base_url: http://127.0.0.1:{server.server_port}\nollama_embedding_model: m1\nvector_persist_dir: {tmp_path}/vectors\nhttpx_log_level: ERROR\n")
    settings = config.load(str(tmp_path / "c.yaml"))
    assert settings.log_levels == {"httpx": "ERROR"}
    engine = Engine(spark, settings=settings)
    assert engine.folder == f"{tmp_path}/vectors" and engine.embedder.dimensions == 3
    assert engine.index_directory(str(tree), include_extensions=[".md"])["status"] == "ok"
    assert engine.query("x")["chunks"]
    other = Engine(spark, f"{tmp_path}/vectors")
    assert "was made with" in other.query("x")["message"]
    assert other.index_directory(str(tree), include_extensions=[".md"])["status"] == "partial"
    server.shutdown()
