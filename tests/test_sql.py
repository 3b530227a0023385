"""SQL functions against the column functions."""

import random

from pyspark.sql import functions as F

from busline.functions import columns, sql


def test_functions_equal_columns(spark):
    rnd = random.Random(1)
    assert sql.register(spark) == sql.register(spark)
    texts = [rnd.randbytes(n).hex() for n in (0, 1, 7, 8, 15, 16, 17, 40, 64, 65, 200)] + [None, "abc", "zz", "FF00", "1000800100000008000000010101020000"]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string").withColumn("raw", F.when(columns.is_hex(F.col("a")), F.unhex("a")).otherwise(F.lit(b""))).withColumn("raw", F.when(F.col("a").isNotNull(), F.col("raw")))
    rows.createOrReplaceTempView("pairs")
    got = spark.sql("SELECT a, b, is_hex(a) h, bit_distance(a, b) d, is_message(raw) m, header_of(raw) AS head, kept_hex(raw) k, message_name(CAST(length(raw) AS INT)) n, is_discovery(header_of(raw).service_id) s, class_index(CASE WHEN a = b THEN 'fuzzy' ELSE a END) c FROM pairs")
    code = F.length("raw").cast("int")
    head = columns.header_fields(F.col("raw"))
    want = rows.select("a", "b", columns.is_hex(F.col("a")), columns.bit_distance(F.col("a"), F.col("b")), columns.is_valid_message(F.col("raw")), F.when(F.length("raw") >= 16, F.struct(*head)), columns.kept_hex(F.col("raw")), columns.message_type_name(code), columns.is_discovery(columns.uint_at(F.col("raw"), 0, 2)), columns.class_index(F.when(F.col("a") == F.col("b"), "fuzzy").otherwise(F.col("a"))))
    key = lambda r: str([None if v is None else v for v in r])
    shown = lambda df: sorted(key((*r[:4], r[4], r[5] and tuple(r[5]), r[6], r[7], bool(r[8]) if r[5] else None, r[9])) for r in df.collect())
    assert shown(got) == shown(want)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
