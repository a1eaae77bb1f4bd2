import numpy as np
from pyspark.sql import functions as F

from agoradesk.operators import cells, onboarding, reporting
from agoradesk.operators import retrieval as rt


def brute(q, p, k, cap, low):
    found = {}
    for qid, tenant, qv in q:
        scored = sorted(((-float(np.dot(qv, pv) / np.linalg.norm(qv) / np.linalg.norm(pv)), pid, doc) for pid, doc, t, pv in p if t == tenant))
        used, out = {}, []
        for s, pid, doc in scored:
            if -s >= low and used.get(doc, 0) < cap:
                used[doc] = used.get(doc, 0) + 1
                out.append(pid)
        found[qid] = out[:k]
    return found


def test_cells_lose_nothing_even_with_a_hot_document(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = [(i, 0 if i % 3 == 0 else i % 17, int(i % 5 == 0), rng.normal(size=8).tolist()) for i in range(600)]
    q = [(i, int(i % 4 == 0), rng.normal(size=8).tolist()) for i in range(40)]
    monkeypatch.setattr(rt, "_CELL_BYTES", 8 * 8 * 50)
    monkeypatch.setattr(rt, "_CELL_QUESTIONS", 7)
    questions = spark.createDataFrame(q, "question_id int, institution_id int, embedding array<float>")
    passages = spark.createDataFrame(p, "passage_id int, document_id int, institution_id int, embedding array<float>")
    want = brute([(a, b, np.float32(c)) for a, b, c in q], [(a, b, c, np.float32(d)) for a, b, c, d in p], 6, 2, 0.05)
    got = {i: [] for i, _, _ in q}
    for r in rt.search(questions, passages, 6, 2, 0.05, dimensions=8).orderBy("question_id", "rank").collect():
        got[r.question_id].append(r.passage_id)
    assert got == want


def test_metric_cells_lose_nothing_and_skip_most_of_clustered_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    draw = lambda: (centres[rng.integers(40)] + 0.05 * rng.normal(size=16)).tolist()
    p = [(i, i % 23, int(i % 7 == 0), draw()) for i in range(1_200)] + [(2_000 + i, 3, 1, p) for i, p in enumerate([draw()] * 5)]
    q = [(i, int(i % 4 == 0), draw()) for i in range(60)] + [(90, 5, draw())]
    monkeypatch.setattr(rt, "_CELL_BYTES", 8 * 16 * 40)
    monkeypatch.setattr(rt, "_CELL_QUESTIONS", 9)
    questions = spark.createDataFrame(q, "question_id int, institution_id int, embedding array<float>")
    passages = spark.createDataFrame(p, "passage_id int, document_id int, institution_id int, embedding array<float>")
    want = brute([(a, b, np.float32(c)) for a, b, c in q], [(a, b, c, np.float32(d)) for a, b, c, d in p], 6, 2, 0.05)
    index = cells.build_index(passages, dimensions=16)
    hits, visits = cells.search_index(questions, index, 6, 2, 0.05, dimensions=16)
    got = {i: [] for i, _, _ in q}
    for r in hits.orderBy("question_id", "rank").collect():
        got[r.question_id].append(r.passage_id)
    assert got == want
    shares = {r.institution_id: r.share for r in cells.compared_share(visits, questions, index[1]).collect()}
    assert shares[0] < 0.2 and visits.count() == visits.distinct().count()


def test_metric_cells_send_a_question_once_per_block(spark, monkeypatch):
    rng = np.random.default_rng(5)
    p = [(i, i % 23, 0, rng.normal(size=16).tolist()) for i in range(900)]
    q = [(i, 0, rng.normal(size=16).tolist()) for i in range(50)]
    sent, staged = [], cells.staged

    def recorded(df, name):
        out = staged(df, name)
        sent.extend([out] if name == "visits" else [])
        return out

    monkeypatch.setattr(cells, "staged", recorded)
    questions = spark.createDataFrame(q, "question_id int, institution_id int, embedding array<float>")
    passages = spark.createDataFrame(p, "passage_id int, document_id int, institution_id int, embedding array<float>")
    hits, visits = cells.search_index(questions, cells.build_index(passages, dimensions=16), 6, 2, 0.05, dimensions=16)
    want = brute([(a, b, np.float32(c)) for a, b, c in q], [(a, b, c, np.float32(d)) for a, b, c, d in p], 6, 2, 0.05)
    got = {i: [] for i, _, _ in q}
    for r in hits.orderBy("question_id", "rank").collect():
        got[r.question_id].append(r.passage_id)
    assert got == want
    assert [v.count() <= 50 for v in sent] == [True, True] and visits.count() > 500


def test_packing_stops_at_the_first_overflow(spark):
    hits = spark.createDataFrame([(1, 1, "a" * 50), (1, 2, "b" * 60), (1, 3, "c" * 5), (2, 1, "d" * 200)], "question_id int, rank int, block string")
    packed = rt.pack_context(hits, 100)
    assert [(r.question_id, r.rank) for r in packed.collect()] == [(1, 1)]
    texts = {r.question_id: r.context_status for r in rt.context_texts(hits.select("question_id").distinct(), packed).collect()}
    assert texts == {1: "ok", 2: "context_limit_exceeded"}


def test_source_tags_are_neutralised(spark):
    got = spark.createDataFrame([("x < / SOURCE y=1> <sources> </source>",)], "t string").select(rt.neutralize(F.col("t")).alias("v")).first().v
    assert got == f"x {rt.NEUTRALISED} <sources> {rt.NEUTRALISED}"


def test_pages_and_whole_document_lists(spark):
    rows = spark.createDataFrame([(i // 2, i) for i in range(7)], "a int, b int")
    page = reporting.keyset_page(rows, ["a", "b"], 3)
    got = page.collect()
    assert [(r.b, r.has_more) for r in got] == [(6, True), (5, True), (4, True)]
    at = page.select(reporting.decode_cursor(F.col("next_cursor")).alias("c")).first().c
    assert (at["at"], at["id"]) == ("2", "4")
    last = reporting.keyset_page(rows, ["a", "b"], 3, (0, 2)).collect()
    assert [(r.b, r.has_more, r.next_cursor) for r in last] == [(1, False, None), (0, False, None)]
    assert reporting.keyset_page(rows.where("b < 0"), ["a", "b"], 3).count() == 0
    docs = spark.range(1200).select(F.lit("t").alias("institution_id"), F.col("id").alias("document_id"),
                                    F.expr("if(id = 7, null, timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id as int)))").alias("created_at"))
    jobs = spark.createDataFrame([(1, 5, 2), (2, 5, 3)], "job_id long, document_id long, job_created_at long")
    placed = {r.document_id: (r.position, r.job_id) for r in reporting.list_documents(docs, jobs).collect()}
    assert len(placed) == 1200 and placed[1199] == (1, None) and placed[7] == (1200, None) and placed[5] == (1194, 2)


def test_faq_search_of_a_table_of_queries(spark):
    faq = spark.createDataFrame([("h", 1, "Parking ?", "Oui", None), ("h", 2, "Repas", "Non", "Vie"), ("g", 3, "Parking", "Non", None)],
                                "institution_id string, item_id long, question string, answer string, category string")
    asked = spark.createDataFrame([("h", 10, " PARK "), ("h", 11, None), ("g", 12, "vie")], "institution_id string, query_id long, query string")
    hits = {(r.query_id, r.item_id) for r in onboarding.faq_search(faq, asked).collect()}
    assert hits == {(10, 1), (11, 1), (11, 2)}
    assert [r.item_id for r in onboarding.faq_search(faq, "vie").collect()] == [2]
