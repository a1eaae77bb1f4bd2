import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from agoradesk.sources import files, rows, sinks


def docx(xml, extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
        for name in extra:
            z.writestr(name, "x")
    return out.getvalue()


def test_inventory_and_layout(spark, tmp_path):
    good = "<w:document><w:p>texte</w:p></w:document>"
    content = {
        "a.pdf": b"%PDF-1.7 x", "b.pdf": b"nope!", "c.docx": docx(good), "d.docx": docx("<w:cols w:num='2'/>"), "e.docx": docx(good, ["word/charts/c1.xml"]),
        "f.docx": docx("<v:textbox>"), "g.docx": b"zip?", "h.txt": b"x", "i.pdf": b"", "j.docx": b"PK\x03\x04broken",
    }
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    inv = files.file_inventory(spark, str(tmp_path))
    short = F.regexp_extract("path", "([a-z])\\.[a-z]+$", 1).alias("n")
    assert {r.n: r.status for r in inv.select(short, "status").collect()} == {
        "a": "ok", "b": "invalid_pdf", "c": "ok", "d": "ok", "e": "ok", "f": "ok", "g": "invalid_docx", "h": "invalid_file_type", "j": "ok"}
    assert {r.n: r.layout_status for r in files.docx_layout(inv).select(short, "layout_status").collect()} == {
        "c": "ok", "d": "docx_complex_layout", "e": "docx_complex_layout", "f": "docx_complex_layout", "j": "docx_extraction_failed"}
    declared = inv.select("path", F.lit(files.DOCX).alias("mime_type"))
    empty = inv.where("extension = '.txt'").select(F.regexp_replace("path", "h.txt$", "i.pdf").alias("path"), F.lit(files.PDF).alias("mime_type"))
    declared = declared.unionByName(empty)
    again = {r.n: r.status for r in files.file_inventory(spark, str(tmp_path), declared).select(short, "status").collect()}
    assert again["a"] == "invalid_file_type" and again["c"] == "ok" and again["i"] == "empty_file"


def test_json_batches(spark):
    cases = {"{}": "invalid_passage_batch", "[]": "invalid_passage_batch_size", '[{"chunk_index": 5}]': "invalid_passage_index", '[{"chunk_index": 1}]': "ok", "x": "invalid_passage_batch",
             "[" + ",".join(['{"chunk_index": 0}'] * 33) + "]": "invalid_passage_batch_size"}
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    got = {r.p: r.s for r in df.select("p", rows.batch_status(F.col("p"), "struct<chunk_index:int>", F.lit(5)).alias("s")).collect()}
    assert got == cases
    kept = rows.rows_from_json(df, "p", "struct<chunk_index:int>", [], F.lit(5))
    assert kept.count() == 34  # the large batch gives its rows, its status is reported beside them


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "passages")
    first = spark.createDataFrame([(1, 0, "a", 1), (1, 1, "b", 1), (2, 0, "c", 1)], "doc int, chunk int, content string, v int")
    sinks.replace_partition(first, path, ["doc"])
    batch = spark.createDataFrame([(1, 1, "B", 2), (1, 1, "BB", 3), (1, 2, "d", 2)], "doc int, chunk int, content string, v int")
    sinks.merge_partition(batch, path, ["doc", "chunk"], ["v"], ["doc"])
    read = lambda: sorted((r.doc, r.chunk, r.content) for r in spark.read.parquet(path).collect())
    assert read() == [(1, 0, "a"), (1, 1, "BB"), (1, 2, "d"), (2, 0, "c")]
    sinks.replace_partition(spark.createDataFrame([(1, 0, "z", 9)], first.schema), path, ["doc"])
    assert read() == [(1, 0, "z"), (2, 0, "c")]
    log = str(tmp_path / "log")
    for day in (1, 2, 2):
        sinks.append_events(spark.createDataFrame([(day, dt.datetime(2024, 1, day))], "id int, created_at timestamp"), log)
    assert spark.read.parquet(log).where("event_date = '2024-01-02'").count() == 2


def test_upsert_and_insert(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "y")], "k int, v string")
    assert sorted(map(tuple, rows.upsert(stored, new, ["k"], ["v"]).collect())) == [(1, "a"), (2, "x"), (3, "y")]
    assert sorted(map(tuple, rows.insert_new(stored, new, ["k"]).collect())) == [(3, "y")]
