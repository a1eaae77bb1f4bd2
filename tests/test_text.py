import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agoradesk.functions import text as tx


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "t string").select(build(F.col("t")).alias("v")).first().v


def test_normalize_text(spark):
    raw = "a\u0000b\u000bc\r\nd\re f g  h \t i \n \tpuce\n\n\n\n\n\nfin  \n"
    assert one(spark, raw, tx.normalize_text) == "ab\nc\nd\ne f g h i\n• puce\n\n\nfin"


def test_fold_matches_exact_unicode_on_latin(spark):
    sample = "  L’Été  à Zürich : ½ ﬁn … Œuvre ÀÉÎÕÜ ÿ Ǆ № ＡＢ ǖ é "
    both = spark.createDataFrame([(sample.replace("Ǆ", ""),)], "t string").select(
        tx.fold(F.col("t")).alias("a"), tx.fold_exact(F.col("t")).alias("b")).first()
    assert both.a == both.b


def test_fold_property(spark):
    alphabet = st.characters(min_codepoint=32, max_codepoint=0x24F)
    seen = []

    @settings(max_examples=60, deadline=None)
    @given(st.text(alphabet, max_size=30))
    def gather(value):
        seen.append(value)

    gather()
    rows = spark.createDataFrame([(v,) for v in seen], "t string").select("t", tx.comparable(F.col("t")).alias("c")).collect()
    for r in rows:
        plain = "".join(c for c in unicodedata.normalize("NFD", r.t) if not 0x300 <= ord(c) <= 0x36F)
        assert r.c == plain.lower(), repr(r.t)


def test_nfkc(spark):
    assert one(spark, "ﬁche ½ é Ａ", tx.nfkc) == unicodedata.normalize("NFKC", "ﬁche ½ é Ａ")
    assert one(spark, "Où ça ?", tx.nfkc) == "Où ça ?"


def test_small_helpers(spark):
    assert one(spark, "dossier/Règlement n°4 (été).PDF", tx.slug) == "reglement-n-4-ete.pdf"
    assert one(spark, "???.docx", tx.slug) == "document.docx"
    assert str(one(spark, "2024-02-29", tx.strict_date)) == "2024-02-29"
    assert one(spark, "2023-02-29", tx.strict_date) is None
    assert one(spark, " ab-12 x ", tx.clean_code) == "AB12X"
    assert one(spark, '{"label": "Soins", "id": 3}', tx.group_label) == "Soins"
    assert one(spark, '"Cuisine"', tx.group_label) == "Cuisine"
    assert one(spark, "x\nArt. 12.3 - Durée\ny", tx.article_ref) == "Art. 12.3 - Durée"
    assert one(spark, "é", tx.token_estimate) == 1


def brute_windows(text):
    if len(text) <= 4000:
        return [text.strip()]
    out, start = [], 0
    while True:
        stop = min(start + 4000, len(text))
        if stop < len(text):
            spots = [text.rfind(b, start, stop) - start for b in tx.BREAKS]
            best = next((s for s in spots if s >= 2480), None)
            stop = stop if best is None else start + best + 1
        out.append(text[start:stop].strip())
        if stop == len(text):
            return [w for w in out if w]
        start = max(start + 1, stop - 500)
        while start < len(text) and text[start].isspace():
            start += 1


def test_split_windows_against_brute_force(spark):
    import random

    rng = random.Random(7)
    texts = ["".join(rng.choice(["mot", " ", " ", ". ", ", ", "\n", "\n\n", "x" * 30]) for _ in range(n)) for n in (10, 2000, 4000, 9000)]
    texts += ["y" * 9001, " " * 4001 + "z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", tx.split_windows(F.col("t")).alias("w")).collect()
    for r in rows:
        assert r.w == brute_windows(r.t), r.i


def test_numbers_are_printed_plainly(spark):
    from agoradesk.functions.columns import number_text

    values = {12345678.5: "12345678.5", 0.00001: "0.00001", 3.0: "3", 1.25: "1.25"}
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", number_text(F.col("v")).alias("s")).collect()
    assert {r.v: r.s for r in rows} == values


def test_folding_of_common_characters_is_one_translation(spark):
    exact = lambda c: tx.collapse(F.translate(tx.strip_marks(c), "’`´", "'''"))
    points = [*range(0x500), *range(0x1E00, 0x2100), 0x3000, 0xFB01, 0xFF21]
    texts = [t for c in map(chr, points) for t in (c, f"a{c}  {c}É")] + ["", None, "J’ai  30 ans"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    folded = rows.select("t", tx.fold(F.col("t")).alias("new"), F.lower(exact(F.col("t"))).alias("old"))
    assert folded.where("not new <=> old").collect() == []
    # One class of far characters decides; the expansions are looked for as literals.
    assert tx._FAR in folded.select("new")._jdf.queryExecution().analyzed().toString()


def test_folding_in_two_steps_equals_fold(spark):
    texts = ["  L’Été  à\tZürich ", "½ … №", "Œuvre « ß »", "Ａ ﬁ", "a\uffff  b", "x  y", "", None, "日本  é", "😀  É", "ĳ", "plain ascii"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    both = tx.with_folded(rows, "t", "a").select("*", tx.fold(F.col("t")).alias("b"), tx.fold_exact(F.col("t")).alias("c"))
    for r in both.collect():
        assert r.a == r.b == r.c, r
    assert both.columns == ["t", "a", "b", "c"]
