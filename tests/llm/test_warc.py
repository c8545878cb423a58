import io
import zipfile

import pytest

from tessera.llm import warc
from tessera.llm.common import written


def pages(spark):
    rows = [(k, f"http://x/{k} é", f"<p>{k % 7}</p>" * (k % 5)) for k in range(200)]
    rows += [(7, "http://x/7 é", "<p>0</p><p>0</p>"), (None, None, None), (None, "u", "<p>only</p>"), (900, None, ""), (901, "u", None), (902, "big", "é\r\n\r\nWARC/1.1" * 200_000)]
    rows += [(903, "z", "same"), (903, "z", "same"), (904, "z", "once")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string"), rows


@pytest.mark.parametrize("options", [{}, {"zip64": True, "member_bytes": 300, "archive_bytes": 2000}])
def test_round_trip(spark, options):
    frame, rows = pages(spark)
    got = warc.round_trip(frame.repartition(3), **options).collect()
    best = {}
    for i, _, html in rows:
        best[html or ""] = max((x for x in (best.get(html or ""), i) if x is not None), default=None)
    want = []
    for i, _, html in rows:
        payload = (html or "").encode()
        top = best[html or ""]
        revisit = top is not None and i != top
        want.append((i, len(payload), warc.digest(payload), "revisit" if revisit else "response", top if revisit else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    texts = {(i, html or "") for i, _, html in rows}
    assert all((r.page_id, bytes(r.payload).decode()) in texts for r in got if r.record_type == "response")


def test_least_and_empty(spark):
    frame = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.classified(frame, 5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.round_trip(frame.limit(0)).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_is_standard(zip64):
    """Other readers open our archives, and our reader opens theirs."""
    out = io.BytesIO()
    z = warc.Stored(out, zip64)
    z.add("a.warc", b"hello" * 1000)
    z.add("é.idx", b"")
    z.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as theirs:
        assert theirs.testzip() is None and theirs.read("a.warc") == b"hello" * 1000 and theirs.namelist() == ["a.warc", "é.idx"]
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as theirs:
        theirs.comment = b"PK\x05" * 50
        theirs.writestr("x.warc", "data")
        theirs.writestr("y", "packed" * 99, zipfile.ZIP_DEFLATED)
    found = warc.directory(made, len(made.getvalue()))
    assert [(n, m, s) for n, m, s, _ in found] == [("x.warc", 0, 4), ("y", 8, 594)]
    at = warc.member_start(made, found[0][3])
    assert made.getvalue()[at : at + 4] == b"data"


def test_table_is_written_once(spark):
    assert written(spark.range(3).toDF("k"), "t").count() == 3


def test_members_without_an_index_and_broken_ones(tmp_path):
    """Records are found from their headers; what is cut short is an error, not fewer records."""
    raw = [warc.record(k, f"u{k}", b"x" * n, warc.digest(b"x" * n), "response", None, k) for k, n in enumerate((0, 5000, 3, 1 << 21))]
    data = b"".join(raw)
    starts = warc.boundaries(io.BytesIO(b"before" + data), 6, len(data))
    assert starts == [sum(map(len, raw[:k])) for k in range(4)]
    assert list(warc.together(starts, [*starts[1:], len(data)])) == [(0, 2), (3, 3)]
    with pytest.raises(ValueError):
        warc.boundaries(io.BytesIO(data[: len(raw[0]) + 20]), 0, len(raw[0]) + 20)
    out = io.BytesIO()
    z = warc.Stored(out)
    z.add("a.warc", data)
    z.close()
    whole = out.getvalue()
    assert [m[:3] for m in warc.directory(io.BytesIO(whole), len(whole))] == [("a.warc", 0, len(data))]
    for cut in (0, 10, len(whole) - 5, len(whole) // 2):
        with pytest.raises(ValueError):
            warc.directory(io.BytesIO(whole[:cut]), cut)


def test_reading_without_an_index(spark, tmp_path):
    raw = [warc.record(k, f"u{k}", b"page%d" % k, warc.digest(b"page%d" % k), "response", None, k) for k in range(30)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.warc", b"".join(raw))
    archives = spark.createDataFrame([("a.zip", (tmp_path / "a.zip").stat().st_size)], "archive string, size long")
    folder = f"file://{tmp_path}"
    got = warc.read(warc.members(spark, folder, archives), folder).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in got) == [(k, b"page%d" % k) for k in range(30)]
    broken = bytearray((tmp_path / "a.zip").read_bytes())
    at = broken.index(b"page7")
    broken[at : at + 5] = b"PAGE7"
    (tmp_path / "a.zip").write_bytes(broken)
    with pytest.raises(Exception, match="broken record in a.zip"):
        warc.read(warc.members(spark, folder, archives), folder).collect()
