import json
import zipfile

from pyspark.sql import functions as F

from sedgewren.sources import files, sinks
from sedgewren.streaming import sessions


def test_load_documents(spark, tmp_path):
    for folder, name, data in (("law", "a.txt", "第一条".encode()), ("case", "b.md", b"x"), ("other", "c.xyz", b"?"), ("law", "d.docx", b"broken")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(data)
    with zipfile.ZipFile(tmp_path / "law" / "e.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>甲</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>乙</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    got = {r["source"]: r for r in files.load_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"]["text"] == "第一条" and got["a.txt"]["doc_type"] == "law" and got["b.md"]["doc_type"] == "case"
    assert got["c.xyz"]["text"] is None and "unknown" in got["c.xyz"]["error"] and got["c.xyz"]["doc_type"] is None
    assert got["d.docx"]["error"].startswith("BadZipFile") and got["e.docx"]["text"] == "甲\n乙"


def test_labelled_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text("\n".join(['{"text": " 甲 ", "label": 1}', "", "{broken", "[1]", '{"text": 5, "label": 1}', '{"text": "乙", "label": 2}', '{"text": " ", "label": 0}', '{"text": "丙", "label": 0}']))
    good, counts = files.read_labelled(spark, str(p))
    assert {(r["text"], r["label"]) for r in good.collect()} == {("甲", 1), ("丙", 0)}
    assert tuple(counts.first()) == (2, 5)


def test_frames_and_json_repair(spark):
    f = files.parse_frames(spark.createDataFrame([('{"type": "ping"}',), ("只是文字",), ('{"type": "question", "text": "问"}',)], "value string"))
    assert [(r["type"], r["text"]) for r in f.collect()] == [("ping", None), ("question", "只是文字"), ("question", "问")]
    j = spark.createDataFrame([("```json\n[1]\n```",), ("好的：[1, 2] 完",), ("没有",), ("[1, ",)], "t string").select(files.repaired_json(F.col("t")))
    assert [r[0] for r in j.collect()] == ["[1]", "[1, 2]", None, None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b")], "id int, t string")
    assert sinks.write_if_empty(df, str(tmp_path / "t")) and not sinks.write_if_empty(df, str(tmp_path / "t"))
    assert "| 1 | a\\|b |" in sinks.markdown_report("报告", [("表", df)])
    c = sinks.cache_rows(spark.createDataFrame([("问 题", "答", "2025-01-01 00:00:00"), ("问题", "新", "2025-01-01 00:30:00"), ("x", " ", "2025-01-01 00:00:00")], "question string, answer string, written_at string"))
    assert [(r["key"], json.loads(r["value"])["answer"]) for r in c.collect()] == [("问题", "新")]
    assert sinks.live_cache(c, "2025-01-01 01:29:59").count() == 1 and sinks.live_cache(c, "2025-01-01 01:30:00").count() == 0


def test_heartbeat(spark):
    f = spark.createDataFrame([("s", "2025-01-01 00:00:00"), ("s", "2025-01-01 00:02:00"), ("s", "2025-01-01 00:04:01")], "session_id string, ts string")
    assert [str(r["closed_at"]) for r in sessions.heartbeat(f).collect()] == ["2025-01-01 00:04:00"]


def test_session_stream(spark, tmp_path):
    sessions.configure(spark)
    (tmp_path / "in").mkdir()
    rows = [("a", "question", "一"), ("a", "ping", None), ("a", "question", "二"), ("b", "question", "三"), ("b", "close", None)]
    spark.createDataFrame(rows, "session_id string, type string, text string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, type string, text string").parquet(str(tmp_path / "in"))
    sessions.run_bounded(sessions.session_events(stream), "session_events_test", str(tmp_path / "cp"))
    got = {(r["session_id"], r["event"], r["seq"]) for r in spark.sql("SELECT * FROM session_events_test").collect()}
    assert got == {("a", "question", 1), ("a", "question", 2), ("b", "question", 1), ("b", "closed", 1)}


def test_bad_doc_type_is_reported(spark, tmp_path):
    (tmp_path / "law").mkdir()
    (tmp_path / "law" / "a.txt").write_text("x")
    r = files.load_documents(spark, str(tmp_path), "poem").first()
    assert r["doc_type"] == "law" and r["text"] == "x" and "poem" in r["error"]


def test_pptx_groups(spark):
    import io

    a, p = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    shape = lambda y, t: f'<p:sp><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    group = f'<p:grpSp><p:grpSpPr><a:xfrm><a:off x="0" y="500"/><a:chOff x="0" y="0"/></a:xfrm></p:grpSpPr>{shape(1, "third")}</p:grpSp>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("ppt/slides/slide1.xml", f'<p:sld xmlns:a="{a}" xmlns:p="{p}"><p:cSld><p:spTree>{shape(200, "second")}{group}{shape(100, "first")}</p:spTree></p:cSld></p:sld>')
    assert files.read_pptx(data.getvalue()) == "first\nsecond\nthird"


def test_workbook_artefacts_and_postings(spark, tmp_path):
    from sedgewren.operators import retrieval

    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cell = lambda t: f'<c t="inlineStr"><is><t>{t}</t></is></c>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row>{cell("q")}{cell("a")}</row><row>{cell("问")}{cell("答")}</row></sheetData></worksheet>')
    assert [tuple(r) for r in files.read_excel_pairs(spark, str(tmp_path / "b.xlsx")).collect()] == [("问", "答")]
    (tmp_path / "run.json").write_text(files.artefact({"n": 1}, [{"qa_id": "1", "answer": "甲"}]))
    assert files.read_artefact(spark, str(tmp_path / "run.json")).first()["answer"] == "甲"
    page = spark.createDataFrame([(6, 6, 10, 10), (5, 9, 10, 10)], "w int, h int, pw int, ph int")
    assert [r[0] for r in page.select(files.picture_counts(F.col("w"), F.col("h"), F.col("pw"), F.col("ph"))).collect()] == [True, False]
    sinks.write_json_lines(spark.createDataFrame([(1,)], "x int"), str(tmp_path / "j"))
    sinks.write_json_lines(spark.createDataFrame([(2,)], "x int"), str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    post = retrieval.postings(spark.createDataFrame([(1, "押金押金")], "id int, t string"), "id", "t")
    sinks.bucketed_postings(post, "held_postings", buckets=2)
    assert {(r["term"], r["tf"]) for r in spark.table("held_postings").collect()} == {("押金", 2), ("金押", 1)}
    spark.sql("DROP TABLE held_postings")
    cache = sinks.cache_rows(spark.sql("SELECT '问 题' AS question, '答' AS answer, TIMESTAMP '2024-01-01' AS written_at"))
    assert [tuple(r)[:2] for r in sinks.cached_answers(cache).collect()] == [("问题", "答")]


def test_resolver_and_commit(spark):
    from sedgewren.operators import models

    h = spark.createDataFrame([("那怎么办", [("user", "押金不退"), ("assistant", "x")]), ("新问题", [])], "q string, h array<struct<role string, content string>>")
    assert [r[0] for r in h.select(models.history_resolver(F.col("q"), F.col("h"))).collect()] == ["押金不退，那怎么办", "新问题"]
    a = spark.createDataFrame([("ok", "x"), ("ok", " "), ("open", "y"), ("error", None)], "status string, answer string")
    assert sessions.committed(a).count() == 1


def test_written_tables_are_shared_and_released(spark):
    import pytest

    from sedgewren import session

    df = session.written(spark.range(3))
    assert df.count() == 3 and session.shared_folder(spark) == session.shared_folder(spark)
    session.release(spark)
    with pytest.raises(Exception):  # noqa: B017
        df.collect()
    assert session.written(spark.range(2)).count() == 2


def test_streamed_conversations(spark, tmp_path):
    sessions.configure(spark)
    (tmp_path / "in").mkdir()
    put = lambda n, rows: (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))
    put(0, [{"session_id": "a", "type": "question", "text": "一"}, {"session_id": "a", "type": "get"}, {"session_id": "b", "type": "question", "text": "二"}, {"session_id": "b", "type": "delete"}, {"session_id": "b", "type": "get"}])
    frames = lambda: spark.readStream.schema("session_id string, type string, text string").json(str(tmp_path / "in"))
    sessions.run_bounded(sessions.session_events(frames()), "conversations", str(tmp_path / "c1"))
    got = {(r["session_id"], r["seq"], r["event"], r["text"]) for r in spark.table("conversations").collect()}
    assert got == {("a", 1, "question", "一"), ("a", 1, "history", "一"), ("b", 1, "question", "二"), ("b", 1, "deleted", None)}
    steps = sessions.stage_events(spark.table("conversations")).where("session_id = 'a'").orderBy("step").collect()
    assert [r["stage"] for r in steps] == ["received", "routed", "retrieved", "answered"]


def test_state_expires(spark, tmp_path):
    import time

    sessions.configure(spark)
    (tmp_path / "in").mkdir()
    row = json.dumps({"session_id": "a", "type": "question", "text": "x"})
    frames = lambda: spark.readStream.schema("session_id string, type string, text string").json(str(tmp_path / "in"))
    for n in range(3):
        (tmp_path / "in" / f"{n}.json").write_text(row)
        sessions.client_sink(sessions.session_events(frames(), 1500), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
        time.sleep(2 * n)
    got = {r["batch"]: r["seq"] for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got[2] == 1


def test_client_sink_writes_each_batch_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text(json.dumps({"session_id": "a", "seq": 0, "delta": "甲", "status": "ok"}))
    stream = spark.readStream.schema("session_id string, seq int, delta string, status string, error string").json(str(tmp_path / "in"))
    seen = []
    q = sessions.client_sink(sessions.client_frames(stream), str(tmp_path / "out"), str(tmp_path / "ck"), seen.append)
    q.awaitTermination(60)
    got = spark.read.json(str(tmp_path / "out")).collect()
    assert seen == [0] and [json.loads(r["value"])["type"] for r in got] == ["end"]
    with_id = sessions.with_session_id(spark.range(2)).select("session_id").distinct().collect()
    assert len(with_id) == 1 and len(with_id[0][0]) == 16
    assert sessions.stamped(spark.range(1)).first()["created_at"] is not None
