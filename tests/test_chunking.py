from pyspark.sql import functions as F

from agoradesk.operators import chunking as ch

TEXT = (
    "4.12.2 Congés extraordinaires\n1 L'employé a droit à un congé dans les cas suivants :\n" + "\n".join(
        f"{c}) motif {c} : {i} jours ;" for i, c in enumerate("abcdefg", 1))
)


def cut(spark, text, paged=None):
    docs = spark.createDataFrame([(1, "Règlement", text)], "id int, title string, text string")
    return ch.chunk_documents(docs, ["id"], paged=paged).orderBy("chunk_index").collect()


def test_lettered_list_shares_its_heading(spark):
    rows = cut(spark, TEXT, F.lit(True))
    lettered = [r for r in rows if r.content[1] == ")"]
    assert len(rows) > 1 and len(lettered) == 7
    assert {r.section_title for r in rows} == {"4.12.2 Congés extraordinaires"}
    frags = [r.metadata.list_fragment_index for r in rows if r.metadata.list_fragment_index is not None]
    assert frags == sorted(frags) and len(frags) >= 7
    assert rows[0].page_start == 1 and rows[0].source_reference == "Règlement — page 1"


def test_plain_lines_are_one_passage(spark):
    rows = cut(spark, "un\ndeux\ntrois\nquatre")
    assert len(rows) == 1 and rows[0].metadata.list_fragment_index is None
    assert rows[0].source_reference == "Règlement — passage 1"


def test_inline_letter_loses_nothing(spark):
    rows = cut(spark, "Titre I\nvoir la lettre a) de cet article et b) ensuite")
    assert "".join(r.content for r in rows).count("a) de cet article") == 1


def test_articles_are_titles(spark):
    rows = cut(spark, "Article 5\ntexte cinq\nArticle 6\ntexte six")
    assert [r.section_title for r in rows] == ["Article 5", "Article 6"]


def order(spark, numbers):
    return [r.section_title for r in cut(spark, "\n".join(f"Article {n}\ntexte {n}" for n in numbers))]


def test_reordering_is_conservative(spark):
    assert order(spark, [3, 1, 2]) == ["Article 1", "Article 2", "Article 3"]
    assert order(spark, [2, 1, 4]) == ["Article 2", "Article 1", "Article 4"]
    assert order(spark, [2, 1]) == ["Article 2", "Article 1"]
    assert order(spark, [3, 1, 2, 2]) == ["Article 3", "Article 1", "Article 2", "Article 2"]


def test_paged_text_keeps_its_order_and_carries_headings(spark):
    rows = cut(spark, "Article 2\n\fsuite deux\n\f\nArticle 1\nun", F.lit(True))
    assert [(r.page_start, r.section_title) for r in rows] == [(2, "Article 2"), (3, "Article 1")]
    assert rows[0].metadata.section_heading_source == "carried"


def test_headings(spark):
    cases = {
        "Chapitre premier": "explicit", "Sectioné": "explicit", "art. 12a": "article", "1.2 Objet": "hierarchical_number", "3) Durée": "numbered",
        "3) Durée ;": None, "5 Evaluation demandée": "numbered", "5 Le cas suivant": None, "5 L'employé a droit": None, "IV. Dispositions": "roman",
        "CONGÉS PAYÉS": "uppercase", "a) mariage": None, "ab": None, "Une phrase ordinaire": None,
    }
    rows = spark.createDataFrame([(c,) for c in cases], "l string").select("l", ch.detect_heading(F.col("l")).alias("h")).collect()
    assert {r.l: (r.h.kind if r.h else None) for r in rows} == cases


def test_statuses(spark):
    docs = spark.createDataFrame(
        [(1, "t", " \n "), (2, "t", "TITRE SEUL"), (3, "t", "x" * 1_500_001), (4, "t", "\n".join(f"Titre {i}\ncorps" for i in range(801)))],
        "id int, title string, text string")
    got = {r.id: r.chunk_status for r in ch.chunk_status(docs, ["id"]).collect()}
    assert got == {1: "no_usable_text", 2: "no_passages", 3: "document_too_large", 4: "too_many_passages"}


def test_long_documents_keep_all_passages(spark):
    words = [f"mot{i}" for i in range(190_000)]
    docs = spark.createDataFrame(
        [(1, "t", "\n".join(" ".join(words[a : a + 10]) for a in range(0, len(words), 10))), (2, "t", "\n".join(f"Titre {i}\ncorps {i}" for i in range(1000)))],
        "id int, title string, text string")
    parts = {}
    for r in ch.chunk_documents(docs, ["id"]).collect():
        parts.setdefault(r.id, []).append(r.content)
    assert len(parts[2]) == 1000
    held = set(" ".join(parts[1]).split())
    assert len(docs.first().text) > ch.MAX_CHARACTERS and held >= set(words)


def test_passages_cover_the_text(spark):
    text = "\n".join(f"Section {i}\n" + " ".join(f"mot{i}x{j}" for j in range(700)) for i in range(3))
    joined = " ".join(r.content for r in cut(spark, text))
    assert all(f"mot{i}x{j}" in joined for i in range(3) for j in range(0, 700, 13))
