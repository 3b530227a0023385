"""Exploded rows, whose size Spark takes for that of the table they come from, are dealt out and never sent to the driver."""

from pyspark.sql import functions as F

from busline.llm import common, vectors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_rows_are_not_broadcast(spark, tmp_path):
    spark.range(200).select(F.col("id").alias("doc_id"), F.array(*[F.col("id") % k for k in range(2, 40)]).alias("keys")).write.parquet(f"{tmp_path}/coded")
    banded = spark.read.parquet(f"{tmp_path}/coded").select("doc_id", F.posexplode("keys").alias("band", "key"))
    made = common.blocks(banded, ["band", "key"])
    assert "Broadcast" not in plan(made)
    assert made.count() == 200 * 38 and "Broadcast" not in plan(made)


def test_chosen_rows_are_not_broadcast(spark, monkeypatch):
    plans, kept = {}, vectors.materialized
    monkeypatch.setattr(vectors, "materialized", lambda df, name: plans.update({name: plan(df)}) or kept(df, name))
    rows = [(i, [1.0, i // 2 * 0.5, 2.0], 1) for i in range(40)]
    out = vectors.vector_classes(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    assert out.count() == 40 and out.where("n_links > 0").count() == 40
    assert "SortMergeJoin [doc_id" in plans["links"]
    assert "SortMergeJoin [label" in plans["chosen"] and "BroadcastHashJoin [label" not in plans["chosen"]
