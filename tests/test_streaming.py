import datetime as dt
import random

from pyspark.sql import functions as F

from agoradesk.operators import limits
from agoradesk.operators.chunking import chunk_documents
from agoradesk.session import shared_dir
from agoradesk.streaming import ingest, state, windows

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k string, id int, ts timestamp"


def drip(spark, folder, rows, parts=4):
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option(
        "checkpointLocation", shared_dir(df.sparkSession, "stream", name)).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def events(n=240):
    rng = random.Random(5)
    at, rows = T0, []
    for i in range(n):
        at += dt.timedelta(seconds=rng.choice([0.5, 1, 2, 4, 20, 400]))
        rows.append((rng.choice("aab"), i, at))
    return rows


def test_sliding_limit_matches_batch(spark, tmp_path):
    rows = events()
    spec = ((60, 4), (3600, 30))
    got = {r.id: r.accepted for r in run(state.sliding_limit_stream(drip(spark, str(tmp_path / "e"), rows), "k", "ts", "id", spec), "sliding")}
    want = {r.id: r.accepted for r in limits.sliding_limit(spark.createDataFrame(rows, SCHEMA), ["k"], "ts", "id", spec).collect()}
    assert got == want and not all(want.values())


def test_duplicates_match_batch(spark, tmp_path):
    rows = events()
    got = {r.id: r.kept_id for r in run(state.duplicate_stream(drip(spark, str(tmp_path / "e"), rows), ["k"], "ts", "id"), "dupes")}
    want = {r.id: r.kept_id for r in limits.suppress_duplicates(spark.createDataFrame(rows, SCHEMA), ["k"], "ts", "id").collect()}
    assert got == want and any(str(i) != k for i, k in want.items())


def test_counts_marks_and_toggles(spark, tmp_path):
    rows = events()
    source = drip(spark, str(tmp_path / "e"), rows)
    counts = run(windows.tumbling_counts(source, "k", "ts", "10 minutes", 5), "counts", "complete")
    assert sum(r.attempts for r in counts) == len(rows)
    assert all(r.rejected == max(0, r.attempts - 5) for r in counts)
    marks = {r.k: r.seen for r in run(windows.high_water_marks(source, ["k"], "ts", "seen"), "marks", "complete")}
    assert marks == {k: max(t for g, _, t in rows if g == k) for k in "ab"}
    toggles = {r.k: r.is_on for r in run(windows.toggle_states(source, ["k"]), "toggles", "complete")}
    assert toggles == {k: sum(g == k for g, _, _ in rows) % 2 == 1 for k in "ab"}


def test_ingest_is_exactly_once_and_supersedes(spark, tmp_path):
    folder, out = str(tmp_path / "docs"), str(tmp_path / "passages")
    schema = "doc_id long, title string, text string"
    spark.createDataFrame([(1, "A", "Article 1\nun\nArticle 2\ndeux"), (2, "B", "Article 9\nneuf")], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    for _ in range(2):
        ingest.start_ingest(stream(), out, "ingest_test").awaitTermination(120)
    assert spark.read.parquet(out).count() == 3
    newer = spark.createDataFrame([(1, "A", "Article 1\nun seul")], schema)
    newer.coalesce(1).write.mode("append").parquet(folder)
    ingest.start_ingest(stream(), out, "ingest_test").awaitTermination(120)
    current = ingest.current_passages(spark.read.parquet(out)).select("doc_id", "content")
    want = chunk_documents(newer, ["doc_id"]).select("doc_id", "content").collect() + [(2, "Article 9\nneuf")]
    assert sorted(map(tuple, current.collect())) == sorted(map(tuple, want))
