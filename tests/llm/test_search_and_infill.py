"""Ranked search, exact top-k and fill-in-middle against plain Python; hashes that must not collide."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from agoradesk.llm import byte_bpe, infill, lexical, shingles, substrings, token_counts, topk
from agoradesk.llm.words import PRIME, text_bytes, times, window_hashes

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(UPPER))


def ranked(docs, items, k):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for (i, c), n in zip(held, sizes, strict=True):
            m = 75 + 25 * n * n_docs // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t]
            )
            if score > 0:
                found.append((-score, i is None, i, score))
        out += [(item, r + 1, i, s) for r, (_, _, i, s) in enumerate(sorted(found, key=str_last)[:k])]
    return sorted(out, key=str)


def str_last(row):
    return row[0], row[1], row[2] or 0


@pytest.fixture(scope="module")
def corpus():
    draw = np.random.default_rng(3)
    words = ["Alpha", "beta", "GAMMA", "ñandú", "日本", "x9", "delta", "the", "of", "rare1", "ÉTÉ", "été"]
    docs = [(k, " ".join(draw.choice(words, draw.integers(1, 40)))) for k in range(150)]
    docs += [(k, "the of the beta-beta, alpha") for k in range(200, 260)]  # equal scores
    docs += [(300, None), (301, ""), (302, "-- ++"), (None, "alpha rare1"), (7, "alpha beta"), (7, "alpha beta"), (400, "rare1 " * 20_000)]
    items = [(1, "alpha beta the"), (2, "Alpha BETA the rare1 rare1"), (3, "the of"), (4, None), (5, "!!"), (6, "unseen"), (7, "alpha beta the of of x9 日本")]
    items += [(8, "alpha beta the"), (8, "alpha beta the"), (None, "été of")]
    return docs, items


def test_ranked_search_equals_brute_force(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical, "CELLS", 500)
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, item string, n long, score int").repartition(5)
    asked = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, rank int")
    got = sorted((tuple(r) for r in lexical.ranked_search(frame, asked, 20).collect()), key=str)
    assert got == ranked(docs, items, 20)


def test_search_in_blocks_of_items_gives_the_same(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical, "ITEM_BYTES", 30)
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in lexical.ranked_search(frame, asked, 5).collect()), key=str) == ranked(docs, items, 5)


def test_search_of_empty_tables(spark, corpus):
    docs, items = (spark.createDataFrame([], s) for s in ("doc_id long, text string", "item_id long, text string"))
    assert lexical.ranked_search(docs, spark.createDataFrame(corpus[1], "item_id long, text string")).count() == 0
    assert lexical.ranked_search(spark.createDataFrame(corpus[0], "doc_id long, text string"), items).count() == 0


def test_shared_sets_are_summed_once():
    items = [[b"a", b"b", b"c", b"d"], [b"a", b"b", b"c", b"e"], [b"a", b"b", b"e", b"f"], [b"c", b"d", b"d"], []]
    plan = lexical.mine_shared_sets(items)
    below = {int(m): (int(x), int(y)) for made, left, right in plan.levels for m, x, y in zip(made, left, right, strict=True)}

    def spread(node):
        if node in below:
            return spread(below[node][0]) + spread(below[node][1])
        return Counter({plan.vocabulary[plan.leaf_term[node]]: int(plan.leaf_times[node])})

    assert [sum((spread(n) for n in own), Counter()) for own in plan.parts] == [Counter(i) for i in items]
    assert plan.additions < sum(max(len(set(i)) - 1, 0) for i in items)


def test_length_terms_beyond_64_bits():
    n = np.array([1, 10**9])
    assert lexical.length_terms(n, 10**12, 10**15).tolist() == [75, 75 + 25 * 10**9 * 10**12 // 10**15]


def best(rows, asks, k, scale=64):
    good = [(n, i, [math.floor(scale * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in good:
        if i is None or not asks(i):
            continue
        found = sorted(
            (-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c, strict=True)))), j is None, j or 0, j) for m, j, c in good if m != n and len(c) == len(q)
        )
        out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_top_scores_equal_brute_force(spark, monkeypatch, bins):
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 60)
    monkeypatch.setattr(topk, "SCORES", 500)
    draw = np.random.default_rng(8)
    rows = [(k, [float(np.float32(x)) for x in draw.normal(size=4)]) for k in range(200)]
    rows += [(k, [0.5, 0.5, 0.5, 0.5]) for k in range(300, 380)]  # more equal scores than places
    rows += [(400, None), (401, [1.0, None, 1.0, 1.0]), (402, [math.nan] * 4), (403, [math.inf] * 4), (404, []), (420, []), (None, [1.0, 2.0, 3.0, 4.0])]
    rows += [(20, rows[20][1]), (20, [9.0, 9.0, 9.0, 9.0]), (440, [1.0, 2.0]), (441, [1.0, 2.0]), (460, [1.0])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, row long, score int").repartition(4)
    got = topk.top_scores(frame, F.col("vec_id") % 20 == 0, 5, bins=bins)
    assert sorted((tuple(r) for r in got.collect()), key=str) == best(rows, lambda i: i % 20 == 0, 5)


def test_top_scores_of_huge_components_and_empty_tables(spark):
    rows = [(0, [1e15, 1.0]), (1, [1e15, 1.0]), (2, [1e15, 2.0]), (3, [-1e17, 1.0]), (4, [2.0**40, 3.0]), (20, [1.0, 2.0**53])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_scores(frame, F.col("vec_id") % 20 == 0, 3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == best(rows, lambda i: i % 20 == 0, 3)
    assert topk.top_scores(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_scores(frame, F.lit(False)).count() == 0


def filled(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = text[:a], text[a:z], text[z:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, z - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, z - a, f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_plain_python(spark, monkeypatch):
    monkeypatch.setattr(infill, "CHUNK_BYTES", 1_000)
    draw = np.random.default_rng(4)
    signs = ["a", "b ", "é", "日", "𝄞", "\n", "<", ">", "P", "S>", "<S", "\x00", "é"]
    rows = [(k, "".join(draw.choice(signs, draw.integers(0, 200)))) for k in range(300)]
    rows += [(400, None), (401, ""), (402, "x <M> y"), (None, "no id at all"), (7, "other text of 7"), (7, "other text of 7"), (403, "日" * 30_000 + "a" * 30_000)]
    frame = spark.createDataFrame([(i, t, "f", [1], (2,)) for i, t in rows], "doc_id long, text string, form string, infill array<int>, row struct<n:int>").repartition(3)
    made = infill.infill_texts(frame)
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "infill")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((filled(*r) for r in rows), key=str)
    assert made.where(infill.restored(F.col("form"), F.col("infill")) != F.coalesce("text", F.lit(""))).count() == 0
    assert {r[0] for r in got.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert made.columns == ["doc_id", "text", "row", *infill.ADDED]
    assert infill.infill_digest(frame.limit(0)).count() == 0


def test_rank_index_is_bounded_and_exact():
    draw = np.random.default_rng(5)
    texts = ["", "a" * 5_000, "".join(draw.choice(["a", "日", "𝄞"], 20_000)), "", "é" * 3_000 + "a" * 3_000, ""]
    data, offsets = text_bytes(pa.array(texts))
    index = infill.RankIndex(data, offsets[:-1], 16)
    want = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    rank = np.arange(len(want))
    assert (index.offset(rank) == want).all()
    assert np.abs(index.predict(rank) - want).max() <= 16
    assert len(index.first) < len(want) / 20
    assert index.rank_of_start(offsets).tolist() == np.concatenate([[0], np.cumsum([len(t) for t in texts])]).tolist()


def test_markers_must_be_found_again():
    for bad in (("<P>", "<S>", "<S>"), ("<P>", "<S<", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.check_markers(bad)


def doubling(n: int) -> str:
    """A Thue-Morse sequence: polynomial hashes modulo 2^64 give it and its letter swap one value, whatever the base."""
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("n", [1_024, 2_048])
def test_words_that_collide_modulo_two_to_the_64(spark, n):
    one = doubling(n)
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    library = tiktoken.Encoding("t", pat_str="[ab]+", mergeable_ranks={t: k for k, t in enumerate(byte_bpe.read_ranks(byte_bpe.vocabulary()))}, special_tokens={})
    for r in byte_bpe.round_trip_digest(docs).collect():
        text = dict(rows)[r["doc_id"]]
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(np.array(library.encode_ordinary(text), "<u4").tobytes()).hexdigest()
    alone = [token_counts.count_tokens(docs.where(F.col("doc_id") == k)).first()["n_tokens"] for k in (1, 2)]
    assert [r["n_tokens"] for r in token_counts.count_tokens(docs).orderBy("doc_id").collect()] == alone
    long = spark.createDataFrame([(k, " ".join([t, *map(str, range(34))])) for k, t in rows], "doc_id long, text string")
    stored = substrings.write_stage(long.coalesce(1), "collide")
    assert {r["n_removed"] for r in substrings.dedup_digest(stored).collect()} == {0}
    short = substrings.write_stage(spark.createDataFrame([(k, f"{t} b c d e") for k, t in rows], "doc_id long, text string").coalesce(1), "collide")
    assert sorted(r["component_id"] for r in shingles.jaccard_components(short).collect()) == [1, 2]


def test_windows_of_doubling_sequences_differ():
    codes = np.array([[3, 5][bin(k).count("1") % 2] for k in range(4_096)], dtype=np.uint64)
    hashes, at = window_hashes(codes, np.array([0, 4_096]), 2_048)
    assert hashes[0] != hashes[2_048]
    plain = {}
    for k in range(0, 2_049, 64):
        plain.setdefault(tuple(codes[k : k + 2_048]), set()).add(int(hashes[k]))
    assert all(len(v) == 1 for v in plain.values()) and len({x for v in plain.values() for x in v}) == len(plain)
    assert at.tolist() == list(range(2_049))


def test_products_modulo_the_prime():
    draw = np.random.default_rng(6)
    a, b = (np.append(draw.integers(0, PRIME, 500, dtype=np.uint64), [np.uint64(PRIME - 1), np.uint64(0)]) for _ in range(2))
    assert times(a, b).tolist() == [int(x) * int(y) % PRIME for x, y in zip(a, b, strict=True)]
