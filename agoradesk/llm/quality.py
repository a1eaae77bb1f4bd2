"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): the last term holds all pairwise interactions in time
linear in the features of a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoradesk.llm.shared import is_remainder
from agoradesk.llm.words import slices, split_words

#: Labelled documents that the model is fitted on, about: a hash of the id decides which.
SAMPLE_DOCUMENTS = 6_000
WORD_BUCKETS = 1 << 15
STATISTICS = (
    "capitals", "letters", "digits", "signs", "exclamations", "bars", "symbols", "line_ends", "repeated_words", "distinct_words", "word_length",
    "words", "metadata_characters",
)
SIZE = WORD_BUCKETS + len(STATISTICS)
RANK, EPOCHS, BATCH, RATE, DECAY = 8, 12, 128, 0.08, 1e-5


def features(texts: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first feature of each text, feature indices, values); ``n_chars`` is the metadata column, NaN where it is null.

    Words count by the logarithm of their frequency, scaled to length one per text; statistics are ratios between 0 and about 2.
    """
    words = split_words(texts)
    n = len(words.counts)
    code = words.hashes()
    doc = words.text_of_word()
    bucket = (code >> np.uint64(64 - 15)).astype(np.int64)
    key, count = np.unique(doc * WORD_BUCKETS + bucket, return_counts=True)
    owner = key // WORD_BUCKETS
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(owner, weights=value**2, minlength=n))
    value /= norm[owner] if len(owner) else 1
    held = np.maximum(words.counts, 1)
    edges = np.concatenate([[0], np.cumsum(_lengths(texts))])
    data = words.data
    total = np.maximum(np.diff(edges), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[edges]) / total

    capital, small, digit = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122), (data >= 48) & (data <= 57)
    sign = (data > 32) & (data < 128) & ~capital & ~small & ~digit
    symbol = (data == 35) | (data == 36) | (data == 37) | (data == 38) | (data == 42)
    same = np.zeros(len(code), dtype=bool)
    same[1:] = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
    size = np.where(np.isnan(n_chars), total, np.maximum(n_chars, 0))
    statistics = np.stack([
        2 * share(capital), share(small | (data >= 128)), 2 * share(digit), 2 * share(sign), 10 * share(data == 33), 10 * share(data == 124),
        10 * share(symbol), 10 * share(data == 10), np.bincount(doc, weights=same, minlength=n) / held, np.bincount(owner, minlength=n) / held,
        np.bincount(doc, weights=words.end - words.start, minlength=n) / held / 10, np.log1p(words.counts) / 10, np.log1p(size) / 10,
    ], axis=1)
    index = np.concatenate([key % WORD_BUCKETS, np.tile(np.arange(WORD_BUCKETS, SIZE), n)])
    owner = np.concatenate([owner, np.repeat(np.arange(n), len(STATISTICS))])
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(n + 1))
    return first, index[order], np.concatenate([value, statistics.ravel()])[order].astype(np.float32)


def _lengths(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, first: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score before the sigmoid, sum of v x per factor); every text has a feature."""
        at = first[:-1]
        vx = self.factors[index] * value[:, None]
        sums = np.add.reduceat(vx, at, axis=0)
        squares = np.add.reduceat((vx**2).sum(axis=1), at)
        line = np.add.reduceat(self.linear[index] * value, at)
        return self.bias + line + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def scores(self, first: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(first, index, value)[0].astype(np.float64), -30, 30)))


def fit_machine(label: np.ndarray, first: np.ndarray, index: np.ndarray, value: np.ndarray, epochs: int = EPOCHS) -> FactorisationMachine:
    """Logistic loss, AdaGrad over batches; fixed seed and order of rows, so equal rows give an equal model."""
    random = np.random.default_rng(7)
    model = FactorisationMachine(0.0, np.zeros(SIZE, np.float32), random.normal(0, 0.02, (SIZE, RANK)).astype(np.float32))
    if not len(label):
        return model
    mean = min(max(float(label.mean()), 0.01), 0.99)
    model.bias = float(np.log(mean / (1 - mean)))
    seen_linear, seen_factors, seen_bias = np.full(SIZE, 1e-4, np.float32), np.full((SIZE, RANK), 1e-4, np.float32), 1e-4
    for _ in range(epochs):
        order = random.permutation(len(label))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            size = first[rows + 1] - first[rows]
            at = np.repeat(first[rows] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            i, x = index[at], value[at]
            begin = np.concatenate([[0], np.cumsum(size)])
            margin, sums = model.margins(begin, i, x)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[rows]).astype(np.float32) / len(rows)
            e = np.repeat(error, size) * x
            own, back = np.unique(i, return_inverse=True)
            slope = np.bincount(back, weights=e).astype(np.float32) + DECAY * model.linear[own]
            pull = e[:, None] * (np.repeat(sums, size, axis=0) - model.factors[i] * x[:, None])
            deep = np.stack([np.bincount(back, weights=pull[:, f]) for f in range(RANK)], axis=1).astype(np.float32) + DECAY * model.factors[own]
            seen_linear[own] += slope**2
            seen_factors[own] += deep**2
            seen_bias += float(error.sum()) ** 2
            model.linear[own] -= RATE * slope / np.sqrt(seen_linear[own])
            model.factors[own] -= RATE * deep / np.sqrt(seen_factors[own])
            model.bias -= RATE * float(error.sum()) / seen_bias**0.5
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> FactorisationMachine:
    """A machine fitted on about ``sample`` labelled documents whose crc32 of the id mod 4 is not 2.

    Of several labels of one document the lowest counts. The sampled labels are at most about ``sample`` rows and may be broadcast; their
    documents' features are fitted in one task.
    """
    some = labels.where("doc_id is not null and quality is not null").where(~is_remainder("doc_id", 4, 2))
    some = some.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = some.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    taken = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) * F.lit(held) < F.lit(1_000_000 * sample))
    rows = docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars")).join(F.broadcast(taken), "doc_id")
    vectors = rows.mapInArrow(_vectors, "doc_id long, label float, indices array<int>, amounts array<float>")
    found = vectors.groupBy(F.lit(0).alias("one")).applyInArrow(_fit, "model binary").first()
    if found is None:
        return FactorisationMachine(0.0, np.zeros(SIZE, np.float32), np.zeros((SIZE, RANK), np.float32))
    flat = np.frombuffer(found["model"], dtype=np.float32)
    return FactorisationMachine(float(flat[0]), flat[1 : SIZE + 1].copy(), flat[SIZE + 1 :].reshape(SIZE, RANK).copy())


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for a, z in slices(batch["text"]):
        part = batch.slice(a, z - a)
        given = part["n_chars"].to_numpy(zero_copy_only=False).astype(np.float64)
        yield part, *features(part["text"], given)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, first, index, value in _parts(batch):
            offsets = pa.array(first, pa.int32())
            yield pa.record_batch({
                "doc_id": part["doc_id"], "label": part["quality"].cast(pa.float32()),
                "indices": pa.ListArray.from_arrays(offsets, pa.array(index, pa.int32())),
                "amounts": pa.ListArray.from_arrays(offsets, pa.array(value, pa.float32())),
            })


def _fit(table: pa.Table) -> pa.Table:
    table = table.sort_by("doc_id").combine_chunks()
    index, value = table["indices"].combine_chunks(), table["amounts"].combine_chunks()
    if isinstance(index, pa.ChunkedArray):
        index, value = pa.concat_arrays(index.chunks), pa.concat_arrays(value.chunks)
    first = index.offsets.to_numpy().astype(np.int64)
    label = table["label"].to_numpy().astype(np.float32)
    model = fit_machine(label, first - first[0], index.flatten().to_numpy(), value.flatten().to_numpy())
    flat = np.concatenate([[model.bias], model.linear, model.factors.ravel()]).astype(np.float32)
    return pa.table({"model": pa.array([flat.tobytes()], pa.binary())})


def score_quality(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; a null text scores as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, index, value in _parts(batch):
                score = model.scores(first, index, value)
                yield pa.record_batch({
                    "doc_id": part["doc_id"], "held_out": part["held_out"], "score": pa.array(score),
                    "predicted": pa.array((score >= threshold).astype(np.int32)),
                })

    rows = docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars"), is_remainder("doc_id", 4, 2).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    return score_quality(docs, fit_quality(docs, labels, sample))
