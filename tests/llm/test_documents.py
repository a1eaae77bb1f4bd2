"""Operators on documents against brute force, with nulls, empty and long texts, repeated rows and columns of clashing names."""

import base64
import hashlib
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from agoradesk.llm import byte_bpe, fingerprints, identifiers, languages, packing, quality, shingles, substrings, token_counts
from agoradesk.llm.pretokens import pretoken_starts
from agoradesk.llm.words import text_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __key string, starts string, bucket long, spans string, label int"


def prose(seed: int, n: int) -> list[str]:
    draw = np.random.default_rng(seed)
    parts = ["the", "of", "ra", "ti", "on", "é", "Wh", "ing", "st", "ä"]
    return ["".join(draw.choice(parts, draw.integers(1, 4))) for _ in range(n)]


def odd_texts() -> list[str | None]:
    base, other, passage = prose(1, 200), prose(2, 300), prose(3, 50)
    edited = list(base)
    edited[20] = "changed"
    far = base[:100] + prose(4, 100)
    long_text = prose(5, 9000)
    return [
        None, "", " \n\t ", "one", "Two words", "two  WORDS", " ".join(base), " ".join(base), "\n".join(base), " ".join(edited), " ".join(far),
        " ".join(other[:90] + passage + other[90:]), " ".join(prose(6, 70) + passage), " ".join(long_text), " ".join(long_text[:4000] + long_text[:60]),
        "x " * 80, "日本語 テキスト　и русский", "z" * 5000, "a b c d", "a b c d e", "A B C D E",
    ]


@pytest.fixture(scope="module")
def texts():
    return odd_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en" if k % 2 else None, "s", None, "k", "s", 1, "x", 2) for k, t in enumerate(texts)]
    rows += [rows[7], rows[12], (None, " ".join(prose(1, 200)), None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).sortWithinPartitions("doc_id", "text")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_substrings_equal_brute_force(docs):
    held = [(i, WORD.findall(t or "")) for i, t in rows_of(docs)]
    count = Counter(tuple(w[k : k + 35]) for _, w in held for k in range(len(w) - 34))
    want = []
    for i, w in held:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substrings.dedup_digest(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[2] > 0 for r in got) >= 9


def test_substring_texts_keep_columns_and_clean_texts(docs, texts):
    out = substrings.dedup_texts(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[0]["text"] is None and got[2]["text"] == " \n\t " and got[16]["text"] == texts[16] and got[16]["__key"] == "k"
    assert got[12]["text"] == "" and got[11]["text"] == " ".join(prose(2, 300))


def test_substring_memory_is_bounded_by_batches_and_chunks(spark, monkeypatch):
    seen, conf, limit = [], "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    write = substrings.write_stage

    def noted(df, name, *bounds):
        seen.append((name, *bounds))
        return write(df, name, *bounds)

    monkeypatch.setattr(substrings, "write_stage", noted)
    docs = write(spark.createDataFrame([(k, " ".join([*prose(k, 60), f"{k}.", *prose(99, 40)])) for k in range(50)], "doc_id long, text string"), "bounded")
    assert {r["n_removed"] for r in substrings.dedup_digest(docs).collect()} == {40}
    assert seen == [("repeats", substrings.BATCH_BYTES)] and spark.conf.get(conf) == limit
    rows = docs.mapInArrow(lambda batches: (pa.record_batch({"n": pa.array([b.num_rows], pa.int64())}) for b in batches), "n long")
    assert {r["n"] for r in write(rows, "one", 100).collect()} == {1} and max(r["n"] for r in write(rows, "many").collect()) > 1
    many = pa.record_batch({
        "doc_id": pa.array(range(3), pa.int64()), "text": [" ".join(f"{d}-{k}" for k in range(400_000)) for d in range(3)],
        "text_hash": pa.array(range(3), pa.int64()), "part": pa.array([0] * 3, pa.int32()),
    })
    chunks = {name for out in substrings._sender(35, 4)([many]) for name in out["chunk"].to_pylist()}
    assert len(chunks) == 2


def linked(docs, size=5, percent=75):
    sets, ids = {}, []
    for i, t in rows_of(docs):
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        own = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
        ids.append((i, own))
        if i is not None:
            sets[i] = own
    names = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and names[a] != names[b]:
                    names[a] = names[b] = min(names[a], names[b])
                    changed = True
    by_set = {own: names[i] for i, own in sets.items() if own}
    return [(i, len(own), names[i] if i is not None else by_set.get(own)) for i, own in ids]


@pytest.mark.parametrize("percent", [75, 40])
def test_jaccard_components_equal_brute_force(docs, percent):
    got = [tuple(r) for r in shingles.jaccard_components(docs, percent=percent).collect()]
    assert sorted(got, key=str) == sorted(linked(docs, percent=percent), key=str)


def test_near_copies_over_many_blocks(spark):
    base = prose(9, 160)
    rows = []
    for k in range(150):  # more than two blocks of one family, copies edited at different places
        w = list(base)
        w[k] = f"edit{k}"
        if k % 3 == 0:
            w[(k * 7) % 160] = "also"
        rows.append((k, " ".join(w)))
    rows.append((150, " ".join(base[:60] + prose(10, 100))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).sortWithinPartitions("doc_id")
    got = [tuple(r) for r in shingles.jaccard_components(docs).collect()]
    assert sorted(got) == sorted(linked(docs))
    assert len({r[2] for r in got}) == 2


def test_search_links_joins_all_that_link():
    draw = np.random.default_rng(3)
    base = np.arange(40)
    sets = [np.unique(np.where(draw.random(40) < 0.12, draw.integers(100, 140, 40), base)) for _ in range(60)]
    sizes = np.array([len(s) for s in sets])
    lists = pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))
    a, b, overlap = shingles.search_links(np.arange(60), sizes, lists, np.zeros(60, dtype=np.int64), 75, True)
    names = list(range(60))
    for x, y, o in zip(a, b, overlap, strict=True):
        assert o == len(np.intersect1d(sets[x], sets[y])) and 100 * o >= 75 * len(np.union1d(sets[x], sets[y]))
        names = [names[y] if n == names[x] else n for n in names]
    for x in range(60):
        for y in range(x):
            both = len(np.intersect1d(sets[x], sets[y]))
            assert 100 * both < 75 * (sizes[x] + sizes[y] - both) or names[x] == names[y]


def shingle_degrees(docs, size=5, percent=75):
    """(id, number of other rows with an id that link) of every row, pair by pair."""
    held = []
    for i, t in rows_of(docs):
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        held.append((i, {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()))
    out = []
    for x, (i, own) in enumerate(held):
        near = [y for y, (j, other) in enumerate(held) if y != x and j is not None and own and 100 * len(own & other) >= percent * len(own | other)]
        out.append((i, None if i is None else len(near)))
    return out


@pytest.mark.parametrize("percent", [75, 40])
def test_links_of_every_document_are_counted(spark, docs, percent):
    got = [(r["doc_id"], r["n_links"]) for r in shingles.jaccard_links(docs, percent=percent).collect()]
    assert sorted(got, key=str) == sorted(shingle_degrees(docs, percent=percent), key=str)
    base = prose(21, 160)
    rows = []
    for k in range(150):  # more than two blocks of near copies, some of them equal, two ids with several texts
        w = list(base)
        w[k % 140] = f"edit{k % 140}"
        w[(k * 7) % 140] = "also"
        rows.append((k - k % 50 // 49, " ".join(w)))
    near = spark.createDataFrame([*rows, (900, " ".join(base[:70] + prose(22, 90))), (None, rows[0][1])], "doc_id long, text string")
    near = near.repartition(4).sortWithinPartitions("doc_id")
    got = [(r["doc_id"], r["n_links"]) for r in shingles.jaccard_links(near, percent=percent).collect()]
    want = shingle_degrees(near, percent=percent)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(n or 0 for _, n in want) > 2 * len(rows)  # a forest has less


def odd_strings() -> list[str]:
    draw = np.random.default_rng(5)
    signs = ["a", "b", "é", "'s", "'ll", "'", " ", "  ", "\n", "\t", "ß", "中", "🙂", "1", "23", "==", "-", " ", "　", "re", "the", "\x00", "½"]
    out = ["".join(draw.choice(signs, draw.integers(0, 50))) for _ in range(1500)]
    return out + ["a" * k for k in range(40)] + ["ab" * k for k in range(40)] + ["=" * k for k in range(70)] + ["aba" * k for k in range(20)]


def test_encoding_equals_tiktoken_and_round_trips(spark, docs):
    path = byte_bpe.vocabulary()
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = byte_bpe.codec(path)
    strings = odd_strings()
    ids, first = own.encode(pa.array(strings))
    assert [ids[a:z].tolist() for a, z in pairwise(first)] == [library.encode_ordinary(s) for s in strings]
    assert own.decode(ids) == "".join(strings).encode()
    want = []
    for i, t in rows_of(docs):
        x = np.array(library.encode_ordinary(t or ""), dtype="<u4")
        want.append((i, len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in byte_bpe.round_trip_digest(docs).collect()), key=str) == sorted(want, key=str)


def test_offsets_and_split_characters(spark):
    docs = spark.createDataFrame([(1, "aé🙂b"), (2, None), (3, "")], "doc_id long, text string").withColumn("ids", F.lit("old"))
    out = {r["doc_id"]: r for r in byte_bpe.decode_ids(byte_bpe.encode_texts(docs)).collect()}
    first = out[1]
    assert first["decoded"] == "aé🙂b" and out[2]["ids"] == [] and out[3]["decoded"] == ""
    assert len(first["ids"]) == len(first["starts"]) and first["starts"][0] == 0 and first["ends"][-1] == 4
    assert all(s < e for s, e in zip(first["starts"], first["ends"], strict=True))
    cut = first.asDict() | {"ids": first["ids"][:-2]}
    again = byte_bpe.decode_ids(spark.createDataFrame([(cut["doc_id"], cut["ids"])], "doc_id long, ids array<int>")).first()
    assert "�" in again["decoded"] or again["decoded"] == "aé"
    with pytest.raises(ValueError):
        byte_bpe.codec(byte_bpe.vocabulary()).decode(np.array([60_000]))


def test_token_counts_equal_the_library(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    own = token_counts.merges(path)
    strings = odd_strings() + ["a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext|>", "<|endoftext|", "x <|endof", "text|> y"]
    assert own.count_texts(pa.array(strings)).tolist() == [len(e.ids) for e in library.encode_batch(strings, add_special_tokens=False)]
    want = []
    for i, t in rows_of(docs):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert sorted((tuple(r) for r in token_counts.count_tokens(docs).collect()), key=str) == sorted(want, key=str)


def test_pretokens_equal_the_pattern():
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    for text in odd_strings():
        data, offsets = text_bytes(pa.array([text]))
        cuts = np.append(pretoken_starts(data, offsets), len(data)) if len(data) else np.array([0])
        assert [data[a:z].tobytes().decode() for a, z in pairwise(cuts)] == pattern.findall(text)


def test_fingerprints_of_edited_texts(spark, docs):
    got = {(r["doc_id"], r["n_chars"]): r for r in fingerprints.edit_report(docs).collect()}
    rows = sorted(((i, t or "") for i, t in rows_of(docs) if i is not None), key=lambda r: -r[0])
    distinct = dict(rows)
    order = sorted(distinct, reverse=True)
    tail = " ".join(prose(1, 200))  # the row without id comes last, and before the first again
    for k, i in enumerate(order):
        t, n = distinct[i], distinct[order[k + 1]] if k + 1 < len(order) else tail
        if i in (7, 12):
            continue  # these rows repeat, so the next document of one of them is its copy
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        row = got[i, len(t)]
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        mine, other, after = fingerprints.simhash(pa.array([t, edited, n]))
        assert row["fingerprint"] == f"{mine:016x}" and row["edited_fingerprint"] == f"{other:016x}"
        assert row["near_edited"] == fingerprints.likeness(mine, other) and row["near_next"] == fingerprints.likeness(mine, after)
    values = [r["fingerprint"] for r in fingerprints.edit_report(docs).collect()]
    assert len(values) == docs.count()


def test_fingerprint_votes():
    text = " ".join(prose(11, 400))
    near, far = text.replace(text[200:210], "something"), " ".join(prose(12, 400))
    a, b, c, same, nothing = fingerprints.simhash(pa.array([text, near, far, text, ""]))
    assert a == same and nothing == 0
    assert fingerprints.likeness(a, b) > 0.9 > fingerprints.likeness(a, c)


def test_permuted_tables_find_all_within_the_radius(spark):
    draw = np.random.default_rng(8)
    base = draw.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = [int(b) for b in base]
    for b in base:
        for flips in (1, 2, 3, 4, 5):
            x = int(b)
            for bit in draw.choice(64, flips, replace=False):
                x ^= 1 << int(bit)
            values += [x] * int(draw.integers(1, 3))
    df = spark.createDataFrame([(f"{v:016x}",) for v in values], "fingerprint string")
    got = {r[0]: r[1] for r in fingerprints.near_counts(df).collect()}
    assert got == {f"{v:016x}": sum((v ^ w).bit_count() <= 3 for w in values) - 1 for v in values}


def test_languages(spark, empty):
    en, de = ["the", "house", "with", "thing", "street"], ["der", "straße", "schön", "nicht", "zwölf"]
    draw = np.random.default_rng(1)
    rows = []
    for k in range(120):
        lang = ("en", en) if k % 2 else ("de", de)
        rows.append((k, " ".join(draw.choice(lang[1], 30)), lang[0]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    report = languages.language_report(docs).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(report) == 120 and all(r["lang_pred"] == truth[r["doc_id"]] and r["score"] == 1 for r in report if r["held_out"])
    model = languages.fit_languages(languages.training_rows(docs))
    mixed = " ".join(en * 3) + ", " + " ".join(de * 4)
    extra = [(1, mixed), (2, None), (3, "12 !"), (4, "русский")]
    out = {r["doc_id"]: r for r in languages.predict_languages(spark.createDataFrame(extra, "doc_id long, text string"), model, spans=True).collect()}
    assert [s["lang"] for s in out[1]["spans"]] == ["en", "de"] and out[1]["lang_pred"] == "de"
    assert mixed[out[1]["spans"][1]["start"] :].startswith("der")
    assert (out[2]["lang_pred"], out[2]["score"]) == (out[3]["lang_pred"], out[3]["score"]) == ("und", 0.0)
    assert out[4]["lang_pred"] in ("de", "en")
    assert languages.language_report(empty).count() == 0
    nothing = languages.language_report(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")).first()
    assert nothing["lang_pred"] == "und"


def test_word_scores_do_not_depend_on_what_is_remembered(monkeypatch):
    draw = np.random.default_rng(3)
    uses = np.zeros((languages.SCRIPT_BUCKETS, 2), dtype=bool)
    uses[languages.SCRIPT_NAMES.index("Latin"), 0] = uses[languages.SCRIPT_NAMES.index("Cyrillic"), 1] = True
    weights = draw.normal(size=(languages.SPACE_OF_MODEL, 2)).astype(np.float32)
    model = languages.LanguageModel(["a", "b"], weights, uses)
    slices = [languages.letter_words(pa.array([" ".join(prose(k, 60)), "много слов", None])) for k in range(4)]
    want = [languages.LanguageModel(["a", "b"], weights, uses).word_scores(s) for s in slices]
    for most in (5, 80, 1000):
        monkeypatch.setattr(languages, "REMEMBERED", most)
        for words, scores in zip(slices, want, strict=True):
            assert np.array_equal(model.word_scores(words), scores)


def test_viterbi_is_the_best_path():
    draw = np.random.default_rng(2)
    scores = draw.normal(0, 3, (40, 3))
    first = np.array([0, 0, 7, 8, 12, 12])
    labels = languages.viterbi(scores[:12], first, 2.0)

    def best(part):
        paths = [((), 0.0)]
        for row in part:
            paths = [(p + (k,), v + row[k] - (2.0 if p and p[-1] != k else 0.0)) for p, v in paths for k in range(3)]
        return max(paths, key=lambda x: x[1])[0] if len(part) else ()

    for a, z in pairwise(first):
        assert tuple(labels[a:z]) == best(scores[a:z])


def test_quality(spark, empty):
    draw = np.random.default_rng(4)
    good, bad = ["calm", "river", "meadow", "stone"], ["BUY", "NOW!!", "WIN!!", "$$$"]
    rows = [(k, " ".join(draw.choice(good if k % 3 else bad, 25)), None) for k in range(300)] + [(300, None, None), (301, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    report = quality.quality_report(docs, labels).collect()
    assert len(report) == 302 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in report)
    held = [r for r in report if r["held_out"] and r["doc_id"] < 300]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) >= 0.95 * len(held) > 0
    assert quality.quality_report(empty, labels).count() == 0
    none = quality.quality_report(docs, labels.limit(0)).collect()
    assert len(none) == 302 and all(r["score"] == 0.5 for r in none)


def test_sum_of_squares_identity():
    draw = np.random.default_rng(6)
    model = quality.FactorisationMachine(0.3, draw.normal(size=quality.SIZE).astype(np.float32), draw.normal(size=(quality.SIZE, 4)).astype(np.float32))
    index, value = draw.integers(0, quality.SIZE, 9), draw.random(9).astype(np.float32)
    margin, _ = model.margins(np.array([0, 9]), index, value)
    pairs = sum(float(model.factors[index[a]] @ model.factors[index[b]]) * value[a] * value[b] for a in range(9) for b in range(a))
    assert margin[0] == pytest.approx(0.3 + float(model.linear[index] @ value) + pairs, rel=1e-4)


def brute_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in re.sub("[^0-9]", "", m[0])][::-1]
        if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], identifiers.KINDS.index(s[0])))


def test_base_identifiers_equal_the_patterns():
    draw = np.random.default_rng(7)
    signs = ["a", "b1", "@", ".", "-", "+", "1", "23", "4567", "255", " ", "(", ")", "x.y", "@@", "%", "_", "00", "é"]
    for _ in range(4000):
        text = "".join(draw.choice(signs, draw.integers(0, 40)))
        assert identifiers.base_spans(text) == brute_spans(text)
    known = "mail a.b@c.example.org, 10.0.0.255, 4111 1111-1111 1111 or +1 (555) 010-9999"
    assert [s[0] for s in identifiers.base_spans(known)] == ["email", "ip", "card", "phone"]


def test_identifiers_in_words_without_end():
    zeros = "0" * 6000
    assert identifiers.base_spans(f"{zeros}1.2.3.4") == [("ip", 0, 6007)]
    assert identifiers.base_spans(f"{zeros}256.2.3.4") == []
    long = "q" * 2_000_000 + " id 1234567 " + "7" * 400_000 + " a.b"
    spans, found = identifiers.mentions(long)
    assert spans == [] and [m["start"] for m in found] == [2_000_004]


def test_candidates_begin_at_words():
    plain = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*(?:\x20[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*)*")
    draw = np.random.default_rng(9)
    for _ in range(2000):
        text = "".join(draw.choice(["a", "1", "@", " ", "\n", "é", "bc"], draw.integers(0, 30)))
        assert [m.span() for m in identifiers.CANDIDATE.finditer(text)] == [m.span() for m in plain.finditer(text)]


def test_patterns_discover_identifiers(spark):
    rows = [(k, f"word{chr(97 + k % 26)} account holder +1 (5{k:02d}) 555-01{k:02d} confirmed today") for k in range(40)]
    rows += [(50, "account holder +1 (777) 555-010 confirmed")]  # a base phone as well
    rows += [(51, "account holder +1 (77) 55-01 confirmed"), (52, "the section +1 (77) 55-01 follows"), (53, None), (54, "page 1234567 of 7654321")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash"))
    got = {r["doc_id"]: r for r in identifiers.identifier_report(docs).collect()}
    found = len("account holder ")
    assert got[51]["n_phone"] == 0 and got[51]["spans"] == f"phone:{found}:{found + len('+1 (77) 55-01')}"
    assert got[52]["spans"] == "" and got[54]["spans"] == "" and got[53]["spans"] == ""
    assert got[53]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[0]["n_phone"] == 1
    masked = {r["doc_id"]: r["text"] for r in identifiers.mask_identifiers(docs).collect()}
    assert masked[51] == "account holder [PHONE] confirmed" and masked[52] == rows[42][1] and masked[53] is None


def test_patterns_discover_forms_that_no_base_pattern_matches(spark):
    rows = [(k, f"account holder +1 (5{k:02d}) 555-01{k:02d} confirmed today") for k in range(40)]
    new = {100 + k: f"(7{k:02d}) 555-38{k:02d}" for k in range(30)} | {200 + k: f"555-01{k:02d}-4567" for k in range(30)}
    rows += [(k, f"account holder {x} confirmed today") for k, x in new.items()]
    late = {300 + k: f"(8{k:02d}) 555-11{k:02d}" for k in range(6)}  # one context only: their form joined the patterns
    rows += [(k, f"account holder {x} word{'abcdef'[k - 300]}") for k, x in late.items()]
    rows += [(400, "the section (743) 555-3824 follows"), (401, "account holder 2011-2012 confirmed")]
    rows += [(500 + k, f"season{chr(97 + k)} 20{k:02d}-20{k + 1:02d} began") for k in range(20)]  # a form of other places
    # one number in ten passes the check of cards: the others failed it, their place does not make them cards
    rows += [(600 + k, f"order {4000000000000 + 7 * k} shipped") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in identifiers.identifier_report(docs).collect()}
    at = len("account holder ")
    for k, x in (new | late).items():
        assert got[k]["n_phone"] == 0 and got[k]["spans"] == f"phone:{at}:{at + len(x)}"
    assert got[400]["spans"] == got[401]["spans"] == "" and all(got[500 + k]["spans"] == "" for k in range(20))
    orders = [got[600 + k] for k in range(100)]
    assert sum(r["n_card"] for r in orders) >= identifiers.SUPPORT
    assert all((r["spans"] != "") == (r["n_card"] > 0) for r in orders)


def test_scoring_ends_when_a_round_accepts_nothing_new(spark, monkeypatch):
    rows = [(k, f"account holder +1 (5{k:02d}) 555-01{k:02d} confirmed today") for k in range(20)]
    late = [(k, f"account holder +1 (77) 55-{k:02d} confirmed today") for k in range(20, 30)]
    calls, score = [], identifiers._score
    monkeypatch.setattr(identifiers, "_score", lambda *a: calls.append(a) or score(*a))
    held = {}
    for name, part, rounds in (("none", rows, 3), ("some", rows + late, 5), ("fewer", rows + late, 1)):
        base = identifiers.write_stage(identifiers.find_mentions(spark.createDataFrame(part, "doc_id long, text string")), "held")
        calls.clear()
        held[name] = sorted(tuple(r) for r in identifiers.discover(base, rounds).collect()), len(calls)
    assert held["none"] == ([], 1)
    assert len(held["some"][0]) == 10 and held["some"][1] < 6 and held["some"][0] == held["fewer"][0]


def test_identifiers_of_odd_documents(docs, empty):
    assert identifiers.identifier_report(docs).count() == docs.count()
    assert identifiers.identifier_report(empty).count() == 0
    out = identifiers.mask_identifiers(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def check_packing(rows, capacities):
    bins = {}
    for r in rows:
        bins.setdefault((r["shard"], r["bin"]), []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r["position"])
        at = 0
        for r in own:
            assert r["position"] == at and r["length"] > 0
            at += r["length"]
        fits = [c for c in sorted(capacities) if c >= at]
        assert all(r["capacity"] == fits[0] for r in own)


@pytest.mark.parametrize("capacities", [(64, 256, 1024), (100,)])
def test_packing_places_every_word_once(docs, capacities):
    rows = packing.pack_documents(docs, capacities, 4).collect()
    check_packing(rows, capacities)
    placed = Counter()
    for r in rows:
        placed[r["doc_id"]] += r["length"]
    want = Counter()
    for i, t in rows_of(docs):
        want[i] += len(WORD.findall(t or ""))
    assert placed == Counter({i: n for i, n in want.items() if n})


def test_packing_is_near_the_optimum():
    draw = np.random.default_rng(9)
    for _ in range(30):
        lengths = sorted(draw.integers(1, 13, 7).tolist(), reverse=True)
        where, offset, fits = packing.pack_lengths(lengths, (6, 12), 1)
        cost = sum(f + 1 for f in fits)
        best = _optimum(lengths, (6, 12), 1)
        assert best <= cost <= 1.25 * best + 1
        used = Counter()
        for b, n in zip(where, lengths, strict=True):
            used[b] += n
        assert all(used[b] <= f for b, f in enumerate(fits))
    # best fit: the piece goes to the bin it fills
    where, _, fits = packing.pack_lengths([9, 7, 5, 3], (12,), 0)
    assert where == [0, 1, 1, 0] and fits == [12, 12]


def _optimum(lengths, capacities, overhead):
    best = [float("inf")]

    def place(k, bins):
        if k == len(lengths):
            best[0] = min(best[0], sum(min(c for c in capacities if c >= b) + overhead for b in bins))
            return
        for j, b in enumerate(bins):
            if b + lengths[k] <= max(capacities):
                place(k + 1, [*bins[:j], b + lengths[k], *bins[j + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


def test_empty_tables(empty):
    assert substrings.dedup_digest(empty).count() == shingles.jaccard_components(empty).count() == 0
    assert byte_bpe.round_trip_digest(empty).count() == token_counts.count_tokens(empty).count() == packing.pack_documents(empty).count() == 0
    assert fingerprints.edit_report(empty).count() == 0
