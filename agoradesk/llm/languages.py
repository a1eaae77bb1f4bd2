"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores labels spans of mixed-language text.

A word is a run of letters. Its score in a language is the log-likelihood of its letter n-grams there; languages that do not use the
word's script are out. Going from one language to another costs a penalty, so a label changes only where several words speak for it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoradesk.llm.packing_bytes import pack, unpack
from agoradesk.llm.pretokens import LETTER, characters, classes
from agoradesk.llm.shared import is_remainder, tidy, tidy_groups
from agoradesk.llm.words import digests, distinct_spans, first_places, mix, ramps, slices, text_bytes

#: Labelled documents per language that the model is fitted on, about: a hash of the id decides which.
SAMPLE_DOCUMENTS = 2_000
#: More label values than this are an error: the model holds one row of n-gram weights per language.
MOST_LANGUAGES = 400
GRAM_BUCKETS = 1 << 16
RANGES = 64  # parts of the bucket space that are summed apart
SWITCH_PENALTY = 12.0
REMEMBERED = 200_000
NEITHER = -60.0  # score of a word in a language that does not use its script

# First code point of the ranges of scripts; a range ends where the next begins, "" is no script of its own.
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1D00, "Latin"),
    (0x1F00, "Greek"), (0x2C00, ""), (0x2C60, "Latin"), (0x2C80, ""), (0x3040, "Kana"), (0x3130, "Hangul"), (0x3190, ""), (0x3400, "Han"),
    (0xA000, ""), (0xA720, "Latin"), (0xA800, ""), (0xAC00, "Hangul"), (0xD800, ""), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, ""), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"),
    (0xFFA0, "Hangul"), (0xFFE0, ""), (0x20000, "Han"), (0x30000, ""),
)
SCRIPT_NAMES = tuple(sorted({name for _, name in SCRIPTS}))
SCRIPT_BUCKETS = 64
SPACE_OF_MODEL = GRAM_BUCKETS + SCRIPT_BUCKETS


@lru_cache(maxsize=1)
def lower_codes() -> np.ndarray:
    """Lower-case code point of each code point that has a single one."""
    return np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(sys.maxunicode + 1)), np.uint32, sys.maxunicode + 1)


@dataclass
class LetterWords:
    code: np.ndarray  # lower-case code points of the slice
    start: np.ndarray  # first character of each word, counted in the slice
    end: np.ndarray
    first: np.ndarray  # per text, its first word
    base: np.ndarray  # per text, its first character

    def script(self) -> np.ndarray:
        starts = np.array([s for s, _ in SCRIPTS])
        number = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS] + [SCRIPT_NAMES.index("")])
        return number[np.searchsorted(starts, self.code[self.start], side="right") - 1]

    def distinct(self) -> tuple[np.ndarray, pa.LargeBinaryArray, np.ndarray]:
        """(number of each word's value, the distinct values, index of the first word of each)."""
        code, values = distinct_spans(self.code.view(np.uint8), 4 * self.start, 4 * self.end)
        return code, values, first_places(code, len(values))


def letter_words(texts: pa.Array) -> LetterWords:
    data, offsets = text_bytes(texts)
    at, code = characters(data)
    letter = classes()[code] == LETTER
    base = np.searchsorted(at, offsets)
    opens = np.zeros(len(at) + 1, dtype=bool)
    opens[base] = True
    begins = letter.copy()
    begins[1:] &= ~letter[:-1] | opens[1:-1]
    stops = letter.copy()
    stops[:-1] &= ~letter[1:] | opens[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return LetterWords(lower_codes()[code], start, end, np.searchsorted(start, base), base)


def word_grams(code: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram buckets, number per word): pairs, triples and quadruples of letters with the word's edges, and the word itself (``whole``)."""
    size = end - start + 2
    at = np.repeat(start - 1, size) + ramps(size)
    inside = ramps(size)
    edge = (inside == 0) | (inside == np.repeat(size - 1, size))
    letters = np.where(edge, 32, code[np.clip(at, 0, max(len(code) - 1, 0))]).astype(np.uint64)
    left = np.repeat(size, size) - inside  # letters from here to the word's end
    keys, owners = [], []
    word = np.repeat(np.arange(len(start)), size)
    value = letters
    for n in (2, 3, 4):
        value = value[:-1] * np.uint64(0x1FFFFF) + letters[n - 1 :]
        fits = left[: len(value)] >= n
        keys.append(value[fits] + np.uint64(n << 50))
        owners.append(word[: len(value)][fits])
    keys.append(whole)
    owners.append(np.arange(len(start)))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    bucket = (mix(key[order]) >> np.uint64(48)).astype(np.int64) % GRAM_BUCKETS
    return bucket, np.bincount(owner, minlength=len(start))


@dataclass
class LanguageModel:
    names: list[str]
    weights: np.ndarray  # buckets x languages, log-probabilities
    uses: np.ndarray  # scripts x languages, whether the language uses the script

    def __post_init__(self):
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.scores = np.zeros((0, len(self.names)), np.float32)

    def __getstate__(self):
        return {"names": self.names, "weights": self.weights, "uses": self.uses}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def word_scores(self, words: LetterWords) -> np.ndarray:
        """words x languages; equal words are scored once."""
        code, values, sample = words.distinct()
        scores = self._distinct_scores(words, values.to_pylist(), sample)[code]
        uses = self.uses[words.script()]
        return np.where(uses | ~uses.any(axis=1, keepdims=True), scores, NEITHER * (words.end - words.start)[:, None])

    def _distinct_scores(self, words: LetterWords, values: list[bytes], sample: np.ndarray) -> np.ndarray:
        """Scores of distinct words; those of earlier slices are remembered until there are too many."""
        new = [k for k, x in enumerate(values) if x not in self.place]
        if len(self.place) + len(new) > REMEMBERED:
            self._forget()
            new = list(range(len(values)))
        if new:
            fresh = [values[k] for k in new]
            bucket, count = word_grams(words.code, words.start[sample[new]], words.end[sample[new]], digests(pa.array(fresh, pa.large_binary())))
            score = np.add.reduceat(self.weights[bucket], np.cumsum(count) - count, axis=0) / 3
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
            self.scores = np.concatenate([self.scores, score])
        return self.scores[[self.place[x] for x in values]]

    def label(self, texts: pa.Array, penalty: float = SWITCH_PENALTY) -> tuple[LetterWords, np.ndarray]:
        words = letter_words(texts)
        if not len(words.start) or not self.names:
            return words, np.zeros(len(words.start), np.int64)
        return words, viterbi(self.word_scores(words), words.first, penalty)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; all texts advance together, word by word."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    counts, begin = counts[order], first[:-1][order]
    longest = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(longest), side="left")
    labels = np.zeros(len(scores), dtype=np.int64)
    jumps = np.zeros(scores.shape, dtype=bool)
    best_before = np.zeros(len(scores), dtype=np.int16)
    value = scores[begin[: active[0]]].astype(np.float64) if longest else np.zeros((0, scores.shape[1]))
    final = np.zeros(len(counts), dtype=np.int64)
    for t in range(1, longest):
        live = active[t]
        if live < len(value):
            final[live : len(value)] = value[live:].argmax(axis=1)
            value = value[:live]
        at = begin[:live] + t
        top = value.argmax(axis=1)
        reach = value[np.arange(live), top][:, None] - penalty
        jump = reach > value
        jumps[at], best_before[at] = jump, top
        value = np.where(jump, reach, value) + scores[at]
    final[: len(value)] = value.argmax(axis=1) if len(value) else 0
    current = final
    for t in range(longest - 1, -1, -1):
        live = active[t]
        at = begin[:live] + t
        own = current[:live]
        labels[at] = own
        if t:
            current[:live] = np.where(jumps[at, own], best_before[at], own)
    return labels


def fit_languages(labelled: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> LanguageModel:
    """A model of the languages in ``labelled`` (doc_id, text, lang), fitted on about ``sample`` whole documents of each."""
    rows = labelled.where("lang is not null and text is not null")
    held = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("held")).limit(MOST_LANGUAGES + 1).collect()
    if len(held) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")
    if not held:
        return LanguageModel([], np.zeros((SPACE_OF_MODEL, 0), np.float32), np.zeros((SCRIPT_BUCKETS, 0), bool))
    share = F.create_map(*(F.lit(x) for row in held for x in (row["lang"], min(1.0, sample / row["held"]))))
    taken = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * share[F.col("lang")])
    parts = taken.select("lang", "text").mapInArrow(tidy(_gather), "lang string, part int, counts binary")
    summed = parts.groupBy("lang", "part").applyInArrow(tidy_groups(_add), "lang string, part int, counts binary").collect()
    names = sorted({row["lang"] for row in summed})
    counts = np.zeros((SPACE_OF_MODEL, len(names)), dtype=np.float64)
    for row in summed:
        at, number = unpack(bytes(row["counts"]))
        counts[at.astype(np.int64), names.index(row["lang"])] = number
    grams, scripts = counts[:GRAM_BUCKETS], counts[GRAM_BUCKETS:]
    weights = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * GRAM_BUCKETS))
    uses = scripts >= 0.001 * np.maximum(scripts.sum(axis=0), 1)
    return LanguageModel(names, weights.astype(np.float32), uses & (scripts > 0))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for a, z in slices(batch["text"]):
            words = letter_words(batch["text"].slice(a, z - a))
            if not len(words.start):
                continue
            # n-grams of each distinct word once, weighted by how often a language's documents have it
            code, values, sample = words.distinct()
            bucket, size = word_grams(words.code, words.start[sample], words.end[sample], digests(values))
            script = words.script() + GRAM_BUCKETS
            doc = np.repeat(np.arange(z - a), np.diff(words.first))
            langs = np.array(batch["lang"].slice(a, z - a).to_pylist(), dtype=object)
            for lang in set(langs):
                own = (langs == lang)[doc]
                total = counts.setdefault(lang, np.zeros(SPACE_OF_MODEL, dtype=np.int64))
                often = np.bincount(code[own], minlength=len(values))
                total += np.bincount(bucket, weights=np.repeat(often, size), minlength=SPACE_OF_MODEL).astype(np.int64)
                total += np.bincount(script[own], minlength=SPACE_OF_MODEL)
    for lang, total in counts.items():
        at = np.flatnonzero(total)
        part = at * RANGES // SPACE_OF_MODEL
        own = [(k, at[part == k]) for k in np.unique(part)]
        yield pa.record_batch({
            "lang": [lang] * len(own), "part": pa.array([int(k) for k, _ in own], pa.int32()),
            "counts": pa.array([pack(x, total[x]) for _, x in own], pa.binary()),
        })


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(SPACE_OF_MODEL, dtype=np.int64)
    for data in table["counts"].to_pylist():
        at, number = unpack(data)
        total[at.astype(np.int64)] += number.astype(np.int64)
    at = np.flatnonzero(total)
    return pa.table({"lang": table["lang"][:1], "part": table["part"][:1], "counts": pa.array([pack(at, total[at])], pa.binary())})


def predict_languages(docs: DataFrame, model: LanguageModel, penalty: float = SWITCH_PENALTY, spans: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score, and with ``spans`` also the labelled spans (start, end in characters, lang).

    The language of a text is the one whose spans hold most letters (ties: the first by name), the score their share. A text that is
    null or has no letter is ``und`` with score 0. Columns of these names are replaced.
    """
    rest = docs.drop("lang_pred", "score", "spans")
    names = rest.columns
    columns = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # texts of a slice advance together, word by word: of like length they take fewest steps
            size = pc.binary_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False)
            batch = batch.take(pa.array(np.argsort(size, kind="stable")))
            for a, z in slices(batch["text"]):
                part = batch.slice(a, z - a)
                words, labels = model.label(part["text"], penalty)
                doc = np.repeat(np.arange(z - a), np.diff(words.first))
                size = (words.end - words.start).astype(np.float64)
                held = np.bincount(doc * len(model.names) + labels, weights=size, minlength=(z - a) * len(model.names)) if model.names else np.zeros(0)
                held = held.reshape(z - a, -1)
                total = held.sum(axis=1)
                best = held.argmax(axis=1) if model.names else np.zeros(z - a, dtype=np.int64)
                some = total > 0
                score = np.where(some, held[np.arange(z - a), best] / np.maximum(total, 1), 0.0) if model.names else np.zeros(z - a)
                some &= bool(model.names)
                out = [*(part[n] for n in names), pa.array([model.names[k] if s else "und" for k, s in zip(best, some, strict=True)]), pa.array(score)]
                if spans:
                    out.append(_spans(words, labels, doc, z - a, model.names))
                yield pa.record_batch(out, names=[*names, "lang_pred", "score", *(["spans"] if spans else [])])

    kind = columns + "lang_pred string, score double" + (", spans array<struct<start:int,end:int,lang:string>>" if spans else "")
    return rest.mapInArrow(tidy(run), kind)


def _spans(words: LetterWords, labels: np.ndarray, doc: np.ndarray, n: int, names: list[str]) -> pa.Array:
    opens = np.ones(len(doc), dtype=bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (labels[1:] != labels[:-1])
    closes = np.append(opens[1:], True)[: len(doc)]
    own = doc[opens]
    out: list[list] = [[] for _ in range(n)]
    for d, s, e, k in zip(own, words.start[opens] - words.base[own], words.end[closes] - words.base[own], labels[opens], strict=True):
        out[d].append({"start": int(s), "end": int(e), "lang": names[k]})
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled documents outside the held-out fold (crc32 of the id mod 3 is 1); rows without an id are left out too."""
    return docs.where("doc_id is not null and lang is not null").where(~is_remainder("doc_id", 3, 1))


def language_report(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document, with a model fitted on the documents that are not held out."""
    model = fit_languages(training_rows(docs), sample)
    rows = docs.select("doc_id", "text", is_remainder("doc_id", 3, 1).alias("held_out"))
    return predict_languages(rows, model).select("doc_id", "held_out", "lang_pred", "score")
