"""Line dedup over windows of three consecutive lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with text rewritten, n_chars brought up to date, and n_lines and n_removed added.

    A line is what stands between \\n characters. Every run of `window` consecutive lines is hashed; of each run that
    stands in several places, all places but the first by (doc_id, line) are removed. Places may overlap: what is
    removed from a document is the union of the lines they cover, judged on the input.

    Null texts have no lines and stay null; texts of fewer lines than a window stay whole; the empty text is one empty
    line. Rows that share doc_id and text count as one document and are treated alike; a null doc_id comes before all others.
    An empty table gives no rows. Extra columns are kept, whatever their names, except that n_lines and n_removed are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    named, cut = docs.select(*kept, F.xxhash64("text").alias("__text")), F.split("text", "\n", -1).alias("__lines")
    size = F.size("__lines")
    run = lambda i: [F.get("__lines", i + k) for k in range(window)]
    places = (
        named.select(F.col("doc_id").alias("__doc"), "__text", cut)
        .where(size >= window)
        .select("__doc", "__text", "__lines", F.explode(F.sequence(F.lit(0), size - window)).alias("__at"))
        .select("__doc", "__text", "__at", F.xxhash64(*run(F.col("__at"))).alias("__h"), F.hash(*run(F.col("__at"))).alias("__g"))
    )
    place = F.struct("__doc", "__text", "__at")
    first = places.groupBy("__h", "__g").agg(F.count("*").alias("__n"), F.min(place).alias("__first")).where("__n > 1")
    later = places.join(first, ["__h", "__g"]).where(~place.eqNullSafe(F.col("__first")))
    covered = F.flatten(F.transform(F.collect_set("__at"), lambda s: F.sequence(s, s + (window - 1))))
    cover = later.groupBy("__doc", "__text").agg(covered.alias("__cover")).withColumnRenamed("__text", "__same")
    # Texts are shuffled as they are and cut into lines again where they arrive.
    joined = named.join(cover, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__text") == F.col("__same")), "left").select("*", cut)
    left = F.array_except(F.sequence(F.lit(0), size - 1), F.col("__cover"))
    joined = joined.withColumn("__left", F.when(F.col("__cover").isNotNull(), left))
    text = F.when(F.col("__left").isNull(), F.col("text")).otherwise(F.array_join(F.transform("__left", lambda i: F.get("__lines", i)), "\n"))
    out = joined.withColumn("n_removed", F.when(F.col("__left").isNull(), 0).otherwise(size - F.size("__left")).cast("bigint"))
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(size).cast("bigint")).withColumn("text", text)
    if "n_chars" in kept:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*kept, "n_lines", "n_removed")


ORACLE = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, ls, unnest(range(len(ls)::BIGINT - 2)) AS i FROM l WHERE len(ls) >= 3),
w AS (SELECT doc_id, i, md5(ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3]) AS h FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM w),
c AS (SELECT DISTINCT doc_id, i + unnest([1, 2, 3]) AS i FROM r WHERE k > 1),
x AS (SELECT doc_id, unnest(range(1, len(ls)::BIGINT + 1)) AS i, unnest(ls) AS line FROM l),
k AS (SELECT x.doc_id, count(*) AS n_lines, count(c.i) AS n_removed,
  string_agg(CASE WHEN c.i IS NULL THEN line END, chr(10) ORDER BY x.i) AS kept FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, md5(coalesce(kept, '')) AS kept_md5
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
