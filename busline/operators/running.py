"""Running sums, numbers and previous rows within keys of any size.

A window over a key puts all its rows in one task. These operators divide each key into ordered buckets, work inside
buckets, and carry totals or last rows over a table with one row a bucket. Rows are shuffled once, by key and bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busline.sources.store import stored

#: Rows that a slice has at most, as far as its values tell them apart.
SLICE_ROWS = 262_144
#: What sliced() adds: where a slice begins, and its part where all its rows have one value.
SLICED = ["__slice", "__sub"]
#: Crowded cells up to which their widths are sent to all tasks.
_FEW = 100_000


def solid_keys(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """df with a copy of each column in which a value that data don't hold stands for null, and the copies' names.

    Plain equality on them keeps the partitioning that windows and joins share; null-safe equality would shuffle again.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    void = {c: F.lit("\0") if isinstance(kinds[c], T.StringType) else F.lit(-(2**31)).cast(kinds[c]) for c in columns}
    return df.withColumns({f"__s_{c}": F.coalesce(F.col(c), void[c]) for c in columns}), [f"__s_{c}" for c in columns]


def _dropped(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__s_")], *names)


def running_sum(df: DataFrame, keys: list[str], bucket: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows of its keys up to its own in (bucket, order).

    Buckets must ascend with order. Tasks hold a bucket at a time; a key's buckets are summed in one.
    """
    marked, solid = solid_keys(df.withColumn("__v", value), [*keys, *bucket])
    group, cells = solid[: len(keys)], solid[len(keys) :]
    totals = marked.groupBy(*solid).agg(F.sum("__v").alias("__t"))
    ahead = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*solid, F.coalesce(F.sum("__t").over(ahead), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy(*solid).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = marked.withColumn("__v", F.sum("__v").over(inside)).join(totals, solid)
    return _dropped(summed.withColumn(name, F.col("__ahead") + F.col("__v")), "__v", "__ahead")


def numbered(df: DataFrame, keys: list[str], bucket: list[str], order: list[str], name: str = "n") -> DataFrame:
    """df with the 1-based position of each row within its keys."""
    return running_sum(df, keys, bucket, order, F.lit(1).cast("bigint"), name)


def neighbour(df: DataFrame, keys: list[str], bucket: list[str], order: list[str], value: str, name: str, before: bool = True) -> DataFrame:
    """df with value of the row before (or after) in its keys (null kept as null), and null for the first (or last).

    Only a bucket's outermost row looks beyond it: at the nearest row of the neighbouring bucket, carried over a table with
    one row a bucket.
    """
    marked, solid = solid_keys(df.withColumn("__b", F.struct(F.col(value).alias("v"))), [*keys, *bucket])
    group, cells = solid[: len(keys)], solid[len(keys) :]
    inside, across = Window.partitionBy(*solid).orderBy(*order), Window.partitionBy(*group).orderBy(*cells)
    shift, outermost = (F.lag, F.max_by) if before else (F.lead, F.min_by)
    edge = marked.groupBy(*solid).agg(outermost("__b", F.struct(*order)).alias("__edge"))
    edge = edge.withColumn("__carried", shift("__edge").over(across)).drop("__edge")
    joined = marked.withColumn("__p", shift("__b").over(inside)).join(edge, solid)
    return _dropped(joined.withColumn(name, F.coalesce("__p", "__carried")["v"]), "__b", "__p", "__carried")


def sliced(df: DataFrame, keys: list[str], value: Column, scale: int, width: int, then: Column | None = None, most: int = SLICE_ROWS) -> DataFrame:
    """df with __slice and __sub, which ascend with value within keys, so that a slice has `most` rows at most.

    Rows are counted in cells of `width` units, of which value has `scale`; a cell with more rows is cut in halves as often as its fullest part needs, all
    such cells at once, and counted again. Where one value alone has more, `then` (an integer that orders such rows) cuts it into parts. Without crowded cells
    this is one count; else rows meet their cell's width in a join, of which one side has a row a crowded cell. Values that differ by less than
    a unit are not parted.
    """
    most_units = 1 << 61
    v = F.when(value.isNull(), -most_units).otherwise(F.greatest(F.least(F.floor(value * scale), F.lit(most_units)), F.lit(-most_units)).cast("bigint"))
    part = lambda v, w: v - F.pmod(v, w)
    marked = df.withColumns({"__v": v, "__o": value, "__t": F.lit(0).cast("bigint") if then is None else F.coalesce(then, F.lit(0).cast("bigint"))}).withColumn("__cell", part(F.col("__v"), F.lit(width)))
    halved = lambda w, n: F.greatest(F.lit(1).cast("bigint"), F.floor(w / F.pow(F.lit(2.0), F.ceil(F.log2(n / F.lit(most))))).cast("bigint"))
    crowded = marked.groupBy(*keys, "__cell").agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    if crowded.isEmpty():
        return marked.withColumns({"__slice": F.col("__cell"), "__sub": F.lit(0).cast("bigint")}).drop("__v", "__o", "__t", "__cell")
    crowded = stored(crowded.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__cell").alias("__c"), halved(F.lit(width), F.col("__n")).alias("__w")), "crowded")
    few = crowded.count()
    on = F.col("__cell") == F.col("__c")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    names = [*[f"__k_{k}" for k in keys], "__c"]
    sent = lambda rows: F.broadcast(rows) if few <= _FEW else rows
    fine = F.col("__cell") + part(F.col("__v") - F.col("__cell"), F.col("__w"))
    for _ in range(64):  # a width is at least halved each time
        inner = marked.join(sent(crowded), on).groupBy(*names, "__w", fine.alias("__f")).agg(F.count("*").alias("__n"), F.min("__o").eqNullSafe(F.max("__o")).alias("__one"))
        fullest = inner.groupBy(*names, "__w").agg(F.max("__n").alias("__n"), F.min(F.when(F.col("__n") > most, F.col("__one"))).alias("__one"))
        again = (F.col("__n") > most) & (F.col("__w") > 1)
        crowded = stored(fullest.select(*names, F.when(again, halved(F.col("__w"), F.col("__n"))).otherwise(F.col("__w")).alias("__w"), ((F.col("__n") > most) & F.col("__one")).alias("__by"), again.alias("__again")), "crowded")
        if crowded.where("__again").isEmpty():
            break
    joined = marked.join(sent(crowded.drop("__again")), on, "left")
    slices = {"__slice": F.when(F.col("__w").isNull(), F.col("__cell")).otherwise(fine), "__sub": F.when(F.col("__by"), part(F.col("__t"), F.lit(most))).otherwise(F.lit(0)).cast("bigint")}
    return joined.withColumns(slices).drop(*names, "__w", "__by", "__v", "__o", "__t", "__cell")
