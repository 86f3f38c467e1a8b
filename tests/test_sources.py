"""Readers, sinks and streams."""

import io
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirefold.operators.lexical import corrections, known
from quirefold.operators.once import SeenLedger
from quirefold.operators.routing import forecast, page_cost
from quirefold.sources import docx, files
from quirefold.streaming import journal as sj


def test_tsv_observations(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "o.tsv").write_text(head + '4\t0\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n5\t0\t1\t1\t1\t1\t300\t600\t150\t50\t96.5\t"quoted\n5\t0\t1\t1\t1\t2\t500\t600\t150\t50\t130\tb\n5\t0\t1\t1\t1\t3\t1\t1\t1\t1\t50\t \n')
    r = files.observations(spark, str(tmp_path / "o.tsv")).orderBy("word_no").collect()
    assert [(x["text"], x["confidence"], x["x0"], x["y1"]) for x in r] == [('"quoted', 0.965, 72.0, 156.0), ("b", 1.0, 120.0, 156.0)]


def test_journal_round_trip(spark, tmp_path):
    rec = [(1, "sub/letter.pdf", "2024-01-01T00:00:00", 1.0, None, "issued", "sub__letter.docx", None, None, None, '{"a": 1}')]
    files.append_journal(spark.createDataFrame(rec, files.JOURNAL), str(tmp_path / "j"))
    files.append_journal(spark.createDataFrame([(2, *rec[0][1:])], files.JOURNAL), str(tmp_path / "j"))
    got = files.read_journal(spark, str(tmp_path / "j"))
    assert sorted(r["seq"] for r in got.collect()) == [1, 2]
    assert got.select(files.target_name(F.col("file"))).first()[0] == "sub__letter"


def test_manifest_checks(spark, tmp_path):
    case = {"case_id": 1, "input": "x.pdf", "expected_routes": ["OCR"], "expected_tables": 0}
    for name, cases, version in (("ok", [case], 1), ("twice", [case, case], 1), ("new", [case], 2)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"schema_version": version, "cases": cases}))
    assert files.read_manifest(spark, str(tmp_path / "ok.json")).count() == 1
    for name in ("twice", "new"):
        with pytest.raises(ValueError):
            files.read_manifest(spark, str(tmp_path / f"{name}.json"))


def test_folder_and_kinds(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.pdf").write_bytes(b"%PDF-1.7 ...")
    (tmp_path / "y.png").write_bytes(b"\x89PNG\r\n\x1a\n....")
    (tmp_path / "z.pdf").write_bytes(b"???")
    (tmp_path / "n.txt").write_text("no")
    got = {r["path"].rsplit("/", 1)[-1]: (r["kind"], r["refusal"]) for r in files.admitted(files.folder(spark, str(tmp_path))).collect()}
    assert got == {"x.pdf": ("pdf", None), "y.png": ("png", None), "z.pdf": (None, "unknown_type")}
    void = spark.createDataFrame([(bytearray(),), (None,)], "content binary")
    assert [r["refusal"] for r in files.admitted(void).collect()] == ["empty", "empty"]


BLOCKS = "doc_id long, page int, block_no int, block_type string, text string, kind string, level int, list_id int, list_marker string, alignment string, size double, bold boolean"
CELLS = "doc_id long, page int, table_no int, row_no int, col_no int, row_span int, col_span int, text string"
RUNS = "doc_id long, page int, block_no int, run_no int, text string, bold boolean, italic boolean, size double, direction string"


def parts(spark, blocks, cells=(), runs=()):
    one = docx.packages(spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(list(cells), CELLS), spark.createDataFrame(list(runs), RUNS)).first()
    z = zipfile.ZipFile(io.BytesIO(bytes(one["content"])))
    return one["sha256"], z.read("word/document.xml").decode(), z.read("word/numbering.xml").decode()


def test_packages_are_stable(spark):
    rows = [
        (1, 0, 0, "paragraph", "Title & <co>", "heading", 0, None, None, "left", 18.0, True), (1, 1, 0, "paragraph", "line\nnext", "paragraph", None, None, None, "justify", 11.0, False), (1, 1, 1, "paragraph", None, None, None, None, None, None, None, None),
    ]
    one, xml, _ = parts(spark, rows)
    assert one == parts(spark, rows[::-1])[0]
    assert "Title &amp; &lt;co&gt;" in xml and 'w:type="page"' in xml and "line</w:t><w:br/>" in xml


def test_packages_keep_tables_lists_and_runs(spark):
    p = lambda no, text, list_id=None, marker=None: (1, 0, no, "paragraph", text, "paragraph", None, list_id, marker, "left", 11.0, False)
    blocks = [p(0, "one two"), (1, 0, 1, "table", None, None, None, None, None, None, None, None), (1, 0, 2, "graphic", None, None, None, None, None, None, None, None), p(3, "first", 1, "1."), p(4, "other list", 2, "a)"), p(5, "bullet", 3, "•")]
    cells = [(1, 0, 0, 0, 0, 2, 1, "tall"), (1, 0, 0, 0, 1, 1, 2, "wide & <x>"), (1, 0, 0, 1, 1, 1, 1, None), (1, 0, 0, 1, 2, 1, 1, "end"), (1, 0, 7, 0, 0, 1, 1, "unannounced")]
    runs = [(1, 0, 0, 0, "one ", True, False, 11.0, "ltr"), (1, 0, 0, 1, "two", False, True, 11.0, "rtl"), (1, 0, 3, 0, "not its text", True, True, 11.0, "ltr")]
    _, xml, numbering = parts(spark, blocks, cells, runs)
    assert xml.count("<w:tbl>") == 2 and "unannounced" in xml and "wide &amp; &lt;x&gt;" in xml and "not its text" not in xml
    assert '<w:vMerge w:val="restart"/>' in xml and "<w:vMerge/>" in xml and '<w:gridSpan w:val="2"/>' in xml and xml.count("<w:tr>") == 3
    assert "<w:b/>" in xml and "<w:i/>" in xml and "<w:rtl/>" in xml and "[graphic 0.2]" in xml
    assert [numbering.count(f'<w:numFmt w:val="{k}"/>') for k in ("decimal", "lowerLetter", "bullet")] == [1, 1, 1] and xml.count("<w:numPr>") == 3
    _, xml, _ = parts(spark, [(1, 0, 0, "table", None, None, None, None, None, None, None, None)])
    assert xml.count("<w:tbl>") == 1  # a table without cells keeps its place


def test_costs(spark):
    df = spark.createDataFrame([("OCR", 15.0, False), ("OCR", 2.0, True), ("NATIVE", 0.0, False), ("BLANK", 0.0, False)], "route string, mp double, s boolean")
    assert [r[0] for r in df.select(page_cost(F.col("route"), F.col("mp"), F.col("s"))).collect()] == [3540.0, 90.0, 65.0, 5.0]
    plan = spark.createDataFrame([(1, i, "OCR", False, 4000.0) for i in range(4)], "doc_id long, page int, route string, searchable_scan boolean, estimated_ms double")
    assert forecast(plan, 4).first()["scan_ms"] * 3 < forecast(plan, 1).first()["scan_ms"] + 1


def test_known_and_corrections(spark):
    words = spark.createDataFrame([("создании",), ("закона",), ("well",), ("known",)], "word string")
    t = spark.createDataFrame([("созданин",), ("закона",), ("well-known",), ("zzz",)], "token string")
    got = {r["token"]: r["known"] for r in known(t, words).collect()}
    assert got == {"созданин": False, "закона": True, "well-known": True, "zzz": False}
    assert [(r["token"], r["word"]) for r in corrections(t, words).collect()] == [("созданин", "создании")]


def test_streams(spark, tmp_path):
    rows = pd.DataFrame(
        {
            "seq": [1, 2, 3, 4], "file": ["a", "b", "./a", "a"], "time": ["2024-01-01T00:00:00"] * 3 + ["2024-01-02T00:00:00"], "outcome": ["issued", "refused", "issued", "refused"],
            "reason": [None, "x", None, "y"], "seconds": [1.0, 2.0, 1.0, 3.0], "received_at": pd.to_datetime(["2024-01-01 00:10", "2024-01-01 00:20", "2024-01-01 01:00", "2024-01-02 00:00"]),
        }
    )
    df = spark.createDataFrame(rows)
    for k, part in enumerate(([1, 2], [3, 4])):
        df.where(F.col("seq").isin(part)).coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
    path, schema = str(tmp_path / "in/*"), df.schema

    def run(out, mode, name):
        out.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    hours = run(sj.arrivals_per_window(sj.read_stream(spark, path, schema)), "complete", "hours")
    assert hours.agg(F.sum("n")).first()[0] == 4 and hours.count() == 4
    last = {r["file"]: r["outcome"] for r in run(sj.latest_per_file(sj.read_stream(spark, path, schema)), "complete", "latest").collect()}
    assert last == {"a": "refused", "b": "refused", "./a": "issued"}
    assert run(sj.sessions(sj.read_stream(spark, path, schema)), "complete", "bursts").agg(F.sum("n")).first()[0] == 4
    ledger = SeenLedger(spark, f"file://{tmp_path}/ledger", 2)
    w = sj.once_only(sj.read_stream(spark, path, schema, 1), ledger, str(tmp_path / "out"), str(tmp_path / "cp"))
    w.trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.count() == 3 and kept.select("time", F.regexp_replace("file", r"^\./", "")).distinct().count() == 3


def test_state_over_pages(spark, tmp_path):
    df = spark.createDataFrame([(1, "Latin"), (1, "Han"), (2, "Latin")], "doc_id long, script string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    sj.page_hints(s).writeStream.outputMode("update").format("memory").queryName("hints").trigger(availableNow=True).start().awaitTermination()
    assert {r["doc_id"]: r["latin_share"] for r in spark.table("hints").collect()} == {1: 0.5, 2: 1.0}


def test_workspace_removes_what_was_staged(spark):
    from pathlib import Path

    from quirefold.session import staged, workspace

    with workspace(spark) as path:
        assert staged(spark.range(3), "x").count() == 3
        at = Path(path.removeprefix("file://"))
        assert any(at.iterdir())
    assert not at.exists()
    assert staged(spark.range(2), "y").count() == 2
