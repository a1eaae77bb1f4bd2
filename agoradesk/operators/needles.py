"""Substring search of many needles at once, by an inverted index of trigrams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a gram; shorter needles, of which there are few different ones, are compared with every row.
GRAM = 3
#: Bytes of text that a slice of rows holds.
SLICE_BYTES = 4_000_000


def _find(own: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
    """(_tenant, _row_id, _needle_id) of one slice of rows and the needles of its tenant."""
    row, take = [own["_row_id"].to_numpy()[:0]], [np.zeros(0, np.int64)]
    if len(own) and len(sent):
        texts, ids = [t.encode() for t in own["_text"]], own["_row_id"].to_numpy()
        alike = {sign.encode(): at for sign, at in sent.groupby("_needle", sort=False).indices.items()}
        for (sign, at), held in zip(alike.items(), _places(texts, list(alike))):
            once, copies = np.unique(ids[[i for i in held if sign in texts[i]]], return_counts=True)
            hits = np.repeat(once, copies * copies)  # an id that comes twice meets each of its copies
            row.append(np.tile(hits, len(at)))
            take.append(np.repeat(at, len(hits)))
    kept = sent.iloc[np.concatenate(take)]
    return pd.DataFrame({"_tenant": kept["_tenant"].to_numpy(), "_row_id": np.concatenate(row), "_needle_id": kept["_needle_id"].to_numpy()})


def _places(texts: list[bytes], signs: list[bytes]) -> list:
    """Rows each needle is compared with: those that hold its rarest gram."""
    whole = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    cut = lambda b: (b[:-2].astype(np.int32) << 16) | (b[1:-1].astype(np.int32) << 8) | b[2:]
    if len(whole) < GRAM:
        return [()] * len(signs)
    own = [np.unique(cut(np.frombuffer(s, np.uint8))) for s in signs]
    wanted = np.unique(np.concatenate(own))
    asked = np.zeros(1 << 24, bool)
    asked[wanted] = True
    codes = cut(whole)
    at = np.flatnonzero(asked[codes])
    row = np.searchsorted(ends, at, side="right")
    inside = at + GRAM <= ends[row]
    pairs = np.unique(np.searchsorted(wanted, codes[at[inside]]) * len(texts) + row[inside])
    gram = pairs // len(texts)
    first, last = np.searchsorted(gram, np.arange(len(wanted))), np.searchsorted(gram, np.arange(len(wanted)), side="right")

    def rarest(grams) -> np.ndarray:
        k = np.searchsorted(wanted, grams)
        best = k[np.argmin((last - first)[k])]
        return pairs[first[best] : last[best]] % len(texts)

    return [rarest(g) for g in own]


def find_needles(rows: DataFrame, needles: DataFrame, tenant: str, row_id: str, text: str, needle_id: str, needle: str) -> DataFrame:
    """(tenant, row_id, needle_id): the rows whose text contains a needle of their tenant, ignoring case.

    Needles are trimmed; a blank or null one is in every row of its tenant. Rows travel once, in slices of bounded size, and meet the needles of their
    tenant there. A slice is read once into an inverted index of the grams (three bytes) that any needle has; each needle takes the rarest of its
    grams and is compared with the rows that hold it. Rows with a null text hold nothing; ids must be unique within a tenant.
    """
    low = F.lower(F.trim(F.coalesce(F.col(needle), F.lit(""))))
    asked = needles.select(F.col(tenant).alias("_tenant"), F.col(needle_id).alias("_needle_id"), low.alias("_needle"))
    held = rows.where(F.col(text).isNotNull()).select(F.col(tenant).alias("_tenant"), F.col(row_id).alias("_row_id"), F.lower(F.col(text)).alias("_text"))
    everywhere = asked.where("_needle = ''").join(held.select("_tenant", "_row_id"), "_tenant").select("_tenant", "_row_id", "_needle_id")
    sizes = rows.where(F.col(text).isNotNull()).groupBy(F.col(tenant).alias("_tenant")).agg(
        F.ceil((F.sum(F.octet_length(text)) + 1) / SLICE_BYTES).alias("_slices"))
    dealt = held.where("_row_id is not null").join(sizes, "_tenant").withColumn("_slice", F.pmod(F.xxhash64("_row_id"), F.col("_slices"))).drop("_slices")
    sent = asked.where("_needle <> ''").distinct().join(sizes, "_tenant").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))).drop("_slices")
    kinds = ", ".join(f"{c} {everywhere.schema[c].dataType.simpleString()}" for c in everywhere.columns)
    brief = F.octet_length("_needle") < GRAM
    met = dealt.groupBy("_tenant", "_slice").cogroup(sent.where(~brief).groupBy("_tenant", "_slice")).applyInPandas(_find, kinds)
    few = dealt.join(sent.where(brief), ["_tenant", "_slice"]).where(F.contains("_text", "_needle"))
    few = few.groupBy("_tenant", "_row_id", "_needle_id", "_needle").agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    few = few.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies") * F.col("_copies")))).select(everywhere.columns)
    hits = everywhere.unionByName(met).unionByName(few)
    return hits.select(F.col("_tenant").alias(tenant), F.col("_row_id").alias(row_id), F.col("_needle_id").alias(needle_id))
