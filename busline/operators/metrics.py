"""Classification metrics as aggregations over rows (label, prediction, score, attack_type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busline.functions.columns import class_index, ratio
from busline.operators.running import SLICED, running_sum, sliced
from busline.schema import CLASSES
from busline.sources.store import stored


def _count(condition) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def confusion(rows: DataFrame) -> DataFrame:
    """One row: tn, fp, fn, tp."""
    y, p = F.col("label") == 1, F.col("prediction") == 1
    return rows.agg(_count(~y & ~p).alias("tn"), _count(~y & p).alias("fp"), _count(y & ~p).alias("fn"), _count(y & p).alias("tp"))


def binary_metrics(rows: DataFrame) -> DataFrame:
    """One row: accuracy, precision, recall and f1 of class 1, each 0 where its denominator is."""
    c = confusion(rows)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _by_score(rows: DataFrame) -> DataFrame:
    """score, pos, neg and what stands at or above each score, pos_up and neg_up; scores are summed in slices by counted rows."""
    per = rows.groupBy("score").agg(_count(F.col("label") == 1).alias("pos"), _count(F.col("label") != 1).alias("neg"))
    per = stored(per.withColumn("__down", -F.col("score")), "scores")
    per = sliced(per, [], F.col("__down"), 1 << 40, 1 << 28)
    per = running_sum(per, [], SLICED, ["__down"], F.col("pos"), "pos_up")
    return running_sum(per, [], SLICED, ["__down"], F.col("neg"), "neg_up").drop("__down", *SLICED)


def auc(rows: DataFrame) -> DataFrame:
    """One row: exact area under the ROC curve, ties counting half; null with a single class."""
    per = _by_score(rows)
    won = F.sum(F.col("neg") / F.lit(2.0) * F.col("pos") - F.col("neg_up") * F.col("pos"))
    total = per.agg(won.alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    # A positive wins against the negatives below its score: all negatives less those at or above it.
    return total.select(F.try_divide(F.col("w") + F.col("p").cast("double") * F.col("n"), F.col("p").cast("double") * F.col("n")).alias("auc"))


def roc_curve(rows: DataFrame) -> DataFrame:
    """threshold, fpr, tpr for every score."""
    per = _by_score(rows)
    whole = F.broadcast(rows.agg(_count(F.col("label") == 1).alias("__p"), _count(F.col("label") != 1).alias("__n")))  # one row
    return per.crossJoin(whole).select(F.col("score").alias("threshold"), ratio(F.col("neg_up"), F.col("__n")).alias("fpr"), ratio(F.col("pos_up"), F.col("__p")).alias("tpr"))


def recall_by_type(rows: DataFrame) -> DataFrame:
    """attack_type, total (all its rows), tp, fn (rows of label 1), fp (rows of label 0), recall."""
    y, p = F.col("label") == 1, F.col("prediction") == 1
    per = rows.groupBy("attack_type").agg(F.count("*").alias("total"), _count(y & p).alias("tp"), _count(y & ~p).alias("fn"), _count(~y & p).alias("fp"))
    return per.withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def multi_metrics(rows: DataFrame) -> DataFrame:
    """class, support, predicted, tp, recall, precision for all classes, also those absent; rows hold class_id and pred_class."""
    names = rows.sparkSession.createDataFrame(list(enumerate(CLASSES)), "class_id int, class string")
    true = rows.groupBy("class_id").agg(F.count("*").alias("support"), _count(F.col("class_id") == F.col("pred_class")).alias("tp"))
    said = rows.groupBy(F.col("pred_class").alias("class_id")).agg(F.count("*").alias("predicted"))
    out = names.join(true, "class_id", "left").join(said, "class_id", "left").fillna(0, ["support", "tp", "predicted"])
    return out.select("class", "support", "predicted", "tp", ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(F.col("tp"), F.col("predicted")).alias("precision"))


def class_balance(rows: DataFrame) -> DataFrame:
    """label, n, share."""
    per = rows.groupBy("label").agg(F.count("*").alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # a row a label


def capture_summary(rows: DataFrame) -> DataFrame:
    """pcap_file, read, written, dropped, attacks, share; frames of other protocols are rows without transport."""
    kept = F.col("transport").isNotNull()
    per = rows.groupBy("pcap_file").agg(F.count("*").alias("read"), _count(kept).alias("written"), _count(~kept).alias("dropped"), _count(kept & (F.col("label") == 1)).alias("attacks"))
    return per.withColumn("share", ratio(F.col("attacks"), F.col("written")))


def with_classes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("class_id", class_index(F.col("attack_type")))
