"""Order-dependent columns for groups that may be too large for one task.

A plain window puts a whole group into one task. Here the group is first cut
into buckets of its own order (an hour, a range of ids): windows run inside
buckets, one small row per bucket carries what crosses the border, and the two
are joined on the partitioning the inner window already has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _packed(values: Mapping[str, Column]) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()])


def _spread(df: DataFrame, packed: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    cols = {name: F.col(holder)[name] for holder, values in packed.items() for name in values}
    return df.withColumns(cols)


def place_key(keys: list[str], *more: Column) -> Column:
    """Keys as one struct: joined or grouped by it, rows whose keys are null meet like any others."""
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *more)


def _across(keys: list[str]):
    """A window over the buckets of each group."""
    held = F.col("_place")
    return Window.partitionBy(*[held[f"k{i}"] for i in range(len(keys))]).orderBy(held["bucket"])


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    lag: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Values of the previous (``lag``) and next (``lead``) row of each group."""
    lag, lead = lag or {}, lead or {}
    base = df.withColumn("_place", place_key(keys, bucket.alias("bucket")))
    inside = Window.partitionBy("_place").orderBy(*order)
    across = _across(keys)
    place = F.struct(*order)
    rows, aggs, shift = base, [], {}
    if lag:
        rows = rows.withColumn("_lag", F.lag(_packed(lag)).over(inside))
        aggs.append(F.max_by(_packed(lag), place).alias("_last"))
        shift["_before"] = F.lag("_last").over(across)
    if lead:
        rows = rows.withColumn("_lead", F.lead(_packed(lead)).over(inside))
        aggs.append(F.min_by(_packed(lead), place).alias("_first"))
        shift["_after"] = F.lead("_first").over(across)
    edges = base.groupBy("_place").agg(*aggs).withColumns(shift).drop("_last", "_first")
    out = rows.join(edges, "_place")
    if lag:
        out = out.withColumn("_lag", F.coalesce("_lag", "_before"))
    if lead:
        out = out.withColumn("_lead", F.coalesce("_lead", "_after"))
    out = _spread(out, {k: v for k, v in (("_lag", lag), ("_lead", lead)) if v})
    return out.drop("_place", "_lag", "_lead", "_before", "_after")


def with_running(
    df: DataFrame, keys: list[str], order: list[str | Column], bucket: Column, sums: Mapping[str, Column]
) -> DataFrame:
    """Running totals up to and including each row of its group."""
    base = df.withColumn("_place", place_key(keys, bucket.alias("bucket")))
    inside = Window.partitionBy("_place").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    edges = base.groupBy("_place").agg(*[F.sum(c).alias(f"_total_{a}") for a, c in sums.items()])
    edges = edges.select(
        "_place", *[F.coalesce(F.sum(f"_total_{a}").over(before), F.lit(0)).alias(f"_off_{a}") for a in sums]
    )
    rows = base.withColumns({a: F.sum(c).over(inside) for a, c in sums.items()})
    out = rows.join(edges, "_place")
    out = out.withColumns({a: F.coalesce(F.col(a), F.lit(0)) + F.col(f"_off_{a}") for a in sums})
    return out.drop("_place", *[f"_off_{a}" for a in sums])


def with_last(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: Mapping[str, Column]
) -> DataFrame:
    """Last non-null value seen up to and including each row of its group."""
    base = df.withColumn("_place", place_key(keys, bucket.alias("bucket")))
    inside = Window.partitionBy("_place").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    edges = base.groupBy("_place").agg(
        *[F.max_by(c, F.when(c.isNotNull(), place)).alias(f"_end_{a}") for a, c in values.items()]
    )
    edges = edges.select(
        "_place", *[F.last(f"_end_{a}", ignorenulls=True).over(before).alias(f"_in_{a}") for a in values]
    )
    rows = base.withColumns({a: F.last(c, ignorenulls=True).over(inside) for a, c in values.items()})
    out = rows.join(edges, "_place")
    out = out.withColumns({a: F.coalesce(F.col(a), F.col(f"_in_{a}")) for a in values})
    return out.drop("_place", *[f"_in_{a}" for a in values])


def as_of(
    df: DataFrame, history: DataFrame, keys: list[str], at: str, since: str, values: list[str], bucket: Callable[[Column], Column], order: str | None = None,
    at_order: str | None = None,
) -> DataFrame:
    """Rows of ``df`` with the values of ``history`` that were in force at their own time, null before the first.

    The last row of ``history`` with equal keys and ``since`` at or before ``at`` counts; of several at one time the one of
    the highest ``order``, and with ``at_order`` none above that of the row itself. Orders are whole numbers. Both sides travel once, in buckets of time with a carried value, so a key of any size is many
    tasks. Null keys meet; a row without a time gets nulls.
    """
    tie = F.col(order) if order else F.lit(0)
    names = {f"_k{i}": F.col(k) for i, k in enumerate(keys)}
    asked = df.select(
        *[c.alias(n) for n, c in names.items()], F.col(at).alias("_at"), F.lit(1).alias("_side"), (F.col(at_order) if at_order else F.lit((1 << 63) - 1)).cast("long").alias("_tie"),
        F.struct(*[F.col(c) for c in df.columns]).alias("_row"),
    )
    known = history.where(F.col(since).isNotNull()).select(
        *[c.alias(n) for n, c in names.items()], F.col(since).alias("_at"), F.lit(0).alias("_side"), tie.cast("long").alias("_tie"),
        F.struct(*values).alias("_value"),
    )
    both = asked.unionByName(known, allowMissingColumns=True)
    found = with_last(both, list(names), ["_at", "_tie", "_side"], bucket(F.col("_at")), {"_state": F.col("_value")}).where("_side = 1")
    timed = F.col("_at").isNotNull()
    return found.select("_row.*", *[F.when(timed, F.col("_state")[v]).alias(v) for v in values])


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each group. The rank filter is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group, in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    return kept.withColumnRenamed("_rank", rank) if rank else kept.drop("_rank")


def replay(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    start: Callable[[], Callable[..., object]],
    inputs: list[str],
    output: str,
    output_type,
) -> DataFrame:
    """Serial rules: walk each group in order with a small state.

    Rows stream through in Arrow batches and only the state of the current
    group is held, so memory does not grow with the group. ``start`` returns a
    step function for a new group; it is called once per row with ``inputs``. Null keys are equal.
    """
    schema = StructType(df.schema.fields).add(output, output_type)

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step = None, None
        for batch in batches:
            results = []
            group_keys = list(zip(*[batch[k].astype(object).where(batch[k].notna(), None) for k in keys]))
            for key, *args in zip(group_keys, *[batch[c] for c in inputs]):
                if step is None or key != current:
                    current, step = key, start()
                results.append(step(*args))
            yield batch.assign(**{output: pd.Series(results, index=batch.index, dtype=object)})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(walk, schema)
