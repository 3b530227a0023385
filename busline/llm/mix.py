"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busline.llm.common import WORD, materialized

#: Documents of a source that one key range should hold at most.
RANGE_ROWS = 500_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeat: int = 2) -> DataFrame:
    """Targets of the sources of sizes (source, size): rows source, source_size, target.

    Sources in code-point order, null last, take the weights in turn and share `share` times all words. A target stops
    at `repeat` times its source's words; what it cannot use goes to the others by weight until none is above. That
    fixed point is found at once: sorted by limit per weight, the sources that stop are a prefix.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(name) - 1) % len(weights) + 1).cast("int"))
    fill = Window.orderBy((F.col("lim") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, rest, every = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    per = per.withColumn("w", weight.cast("bigint")).withColumn("lim", F.col("source_size") * repeat)
    per = per.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    per = per.withColumn("stops", F.col("lim") * F.sum("w").over(rest) <= (F.col("budget") - F.coalesce(F.sum("lim").over(before), F.lit(0))) * F.col("w"))
    left = F.col("budget") - F.sum(F.when(F.col("stops"), F.col("lim")).otherwise(0)).over(every)
    level = left / F.sum(F.when(F.col("stops"), 0).otherwise(F.col("w"))).over(every)
    return per.select("source", "source_size", F.when(F.col("stops"), F.col("lim").cast("double")).otherwise(level * F.col("w")).alias("target"))


def n_words(text: Column) -> Column:
    """The number of words; null counts as none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def numbered_alike(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """rows with __k, the 0-based position among those of equal keys, nulls being equal."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeat: int = 2, seed: str = "mix", range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken: how often the mix takes each document.

    Each document draws u from a hash of seed and doc_id (its text if that is null) and gets the exponential key -ln(u) / w, where w in [0.1, 1]
    falls with the share of symbol characters. A source first gives as many complete epochs as its target holds; the
    rest comes from its documents in key order until their summed words reach it, the document at the border
    being taken if that comes nearer. The order inside a source is summed in key ranges, so no task orders a whole source:
    ranges are equal in the logarithm of the key, where no weight, nor any mix of weights, puts more than 0.37 of a source
    into a unit, and as many as hold `range_rows` documents at most. Only ids, names and counts are shuffled, never texts.

    Null and empty texts have size 0 and are taken 0 words. A null source is a source of its own. Rows with the same
    doc_id are separate documents; equal keys are ordered by doc_id and size. An empty table gives no rows. Extra columns are
    ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    chars = F.length(text)
    symbols = chars - F.length(F.translate(text, "#*$%&|<>", ""))
    quality = F.greatest(F.lit(0.1), F.lit(1.0) - symbols * F.lit(10.0) / F.greatest(chars, F.lit(1)))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5(text)))), 1, 13), 16, 10).cast("bigint")
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), quality.alias("q"), drawn.alias("u"))
    rows = rows.withColumn("key", -F.log((F.col("u") + F.lit(0.5)) / F.lit(float(2**52))) / F.col("q"))
    rows = materialized(rows.drop("q", "u"), "mix")  # ids and counts, read several times below; the texts are read once
    per_unit = max(64, math.ceil(rows.count() * 0.37 / range_rows))
    rows = rows.withColumn("range", F.floor(F.log("key") * per_unit).cast("bigint"))
    targets = source_targets(rows, weights, share, repeat)

    per_range = rows.groupBy("source", "range").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = per_range.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    per_range = per_range.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.*", "source_size", "target")

    joined = rows.alias("r").join(per_range.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.range") == F.col("p.range")))
    joined = joined.select("r.*", "ahead", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("ahead") + F.sum("size").over(inside)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = F.col("target") - epochs * F.col("source_size")
    times = epochs + F.when((F.col("size") > 0) & (2 * upto - F.col("size") <= 2 * rest), 1).otherwise(0)
    return joined.withColumn("times", times.cast("int")).select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(t))), 1, 13) AS BIGINT) AS u,
  greatest(0.1::DOUBLE, 1.0::DOUBLE - (length(t) - length(translate(t, '#*$%&|<>', ''))) * 10.0::DOUBLE / greatest(length(t), 1)) AS q FROM d),
k AS (SELECT doc_id, source, size, -ln((u + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / q AS key FROM s),
per AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS w FROM k GROUP BY source),
lim AS (SELECT *, source_size * 2 AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM per),
stop AS (SELECT *, cap * sum(w) OVER f <= (budget - coalesce(sum(cap) OVER b, 0)) * w AS stops FROM lim
  WINDOW f AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
         b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (SELECT source, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE
  (budget - (sum(CASE WHEN stops THEN cap ELSE 0 END) OVER ())::DOUBLE) / (sum(CASE WHEN stops THEN 0 ELSE w END) OVER ())::DOUBLE * w END AS target FROM stop),
run AS (SELECT k.doc_id, k.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
  sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM k JOIN tgt t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN size > 0 AND 2 * upto - size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM run
"""
