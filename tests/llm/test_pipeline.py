"""The pipeline's stages against plain-Python ones, text by text, on documents with planted copies, passages and personal data."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipe
from agoradesk.llm.shared import write_stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    draw = np.random.default_rng(seed)
    parts = ["the", "of", "ra", "ti", "on", "wh", "ing", "st", "el", "mo"]
    return ["".join(draw.choice(parts, draw.integers(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    base, passage = prose(1, 120), prose(2, 45)
    near = list(base)
    near[60] = "changed"
    texts = [" ".join(base), " ".join(near), " ".join(base)]
    texts += [" ".join([*prose(10 + k, 60), *passage, *prose(40 + k, 60)]) for k in range(4)]
    texts += [" ".join([*prose(70 + k, 50), f"mail person{k}@site.example.org or 10.0.{k}.7"]) for k in range(4)]
    texts += [" ".join(prose(100 + k, 80)) for k in range(6)]
    held = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    held += [(7, " ".join(prose(200, 90)), "en", "s", 1), (7, " ".join(prose(200, 90)), "en", "s", 1)]  # one id, another text, twice
    held += [(None, " ".join(base), "en", "s", 1), (None, " ".join(prose(201, 90)), None, "s", 1), (50, None, "en", "s", None), (51, "123 !", None, "s", 5)]
    return held


def table(spark, rows, name):
    return write_stage(spark.createDataFrame(rows, SCHEMA).coalesce(2), name)


def kept_by_jaccard(rows):
    """One row of each group of linked texts: the smallest id, null ids last; equal rows are one."""
    rows = list(dict.fromkeys(rows))

    def shingles(text):
        words = [w.lower() for w in WORD.findall(text or "")]
        return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()

    sets = [shingles(r[1]) for r in rows]
    name = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                name = [name[b] if n == name[a] else n for n in name]
    best = {}
    for r, n in zip(rows, name, strict=True):
        best[n] = min(best.get(n, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    return sorted(best.values(), key=str)


def without_passages(rows, width=35):
    held = [WORD.findall(r[1] or "") for r in rows]
    count = Counter(tuple(w[k : k + width]) for w in held for k in range(len(w) - width + 1))
    out = []
    for r, w in zip(rows, held, strict=True):
        gone = {p for k in range(len(w) - width + 1) if count[tuple(w[k : k + width])] > 1 for p in range(k, k + width)}
        text = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else r[1]
        out.append((r[0], text, r[2], r[3], None if text is None else len(text)))
    return sorted(out, key=str)


def masked(rows):
    out = []
    for r in rows:
        text = r[1]
        if text is not None:
            text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", text)
            text = re.sub(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "[IP]", text)
        out.append((r[0], text, r[2], r[3], None if text is None else len(text)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_equal_plain_python(spark, rows):
    kept = got(pipe.near_duplicate_stage(spark, table(spark, rows, "p"), ""))
    assert kept == kept_by_jaccard(rows) and len(kept) == len(rows) - 4
    cut = got(pipe.substring_stage(spark, table(spark, kept, "p"), ""))
    assert cut == without_passages(kept)
    assert sum(a != b for a, b in zip(kept, cut, strict=True)) >= 4
    clean = got(pipe.identifier_stage(spark, table(spark, cut, "p"), ""))
    assert clean == masked(cut)
    packed = pipe.packing_stage(spark, table(spark, clean, "p"), "")
    assert sum(r["length"] for r in packed.collect()) == sum(len((r[1] or "").split()) for r in clean)


def test_texts_stay_where_no_language_can_be_learned(spark, rows):
    bare = [(i, t, None, s, n) for i, t, _, s, n in rows]
    stayed = got(pipe.language_stage(spark, table(spark, bare, "p"), ""))
    assert stayed == sorted((r for r in bare if r[1] and re.search("[a-z]", r[1])), key=str)


def test_empty_table(spark, rows):
    for _, stage in pipe.STAGES:
        assert stage(spark, table(spark, rows, "p").limit(0), "").count() == 0
