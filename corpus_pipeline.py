"""A corpus pipeline in stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A null or
empty text is a document without words: no stage drops it for that, and the mix takes it with the epochs of its source. Texts are handled
whole, however long. An empty table gives an empty table, and extra columns of docs are left behind.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busline.llm import bpe, lines, mix, ngrams, toxicity
from busline.llm.common import WORD, components, spread
from busline.llm.queries import TOXIC_FROM, VOCABULARY, held_out
from busline.sources.store import delete, new_folder, scratch, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model learned from the labels, outside the held-out fold, does not reject.

    Rows are scored one by one, so repeated rows, and those of a null doc_id, share no fate but that of their text.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = toxicity.score_toxicity(docs.select(*COLUMNS), toxicity.fit_toxicity(docs, labels))
    return scored.where(F.col("score") < TOXIC_FROM).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later occurrences of three-line windows; one that loses all its words that way is dropped.

    Rows that share doc_id and text count as one document and are treated alike; a null doc_id comes before all others.
    """
    deduped = lines.dedup_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(WORD)
    return deduped.where(~F.coalesce(emptied, F.lit(False))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each near-duplicate class.

    A copy of which line dedup has left a few lines no longer resembles its model. So documents are compared twice: as they
    are, and with the texts that sf_dir's documents have for those whose present text consists of lines of that text. Links of
    both kinds form the classes. Rows that share a doc_id are one document, of which the smallest row stays; rows with a null
    doc_id can't be named in a link and stay.
    """
    docs = docs.select(*COLUMNS)
    first = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("text").alias("__whole"))
    said = lambda c: F.split(c, "\n", -1)
    part = F.size(F.array_except(said("text"), said("__whole"))) == 0
    before = docs.where("doc_id IS NOT NULL").join(first, F.col("doc_id") == F.col("__id"), "left").select("doc_id", F.when(part, F.col("__whole")).otherwise(F.col("text")).alias("text"))
    links = [ngrams.jaccard_classes(rows).where("doc_id <> class_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b")) for rows in (docs, before)]
    copies = components(links[0].union(links[1])).where("node <> component").select(F.col("node").alias("doc_id"))
    left = docs.join(stored(copies, "copies"), "doc_id", "left_anti").select(*COLUMNS)
    repeated = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    sole = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return left.join(repeated, "doc_id", "left_anti").select(*COLUMNS).unionByName(sole)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    What is taken of rows that share a doc_id, or have none, is dealt out evenly among those of equal source and size.
    """
    docs = docs.select(*COLUMNS)
    taken = stored(mix.mix_sources(docs).select("doc_id", "source", "size", "times"), "taken")
    repeated = stored(taken.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__id")), "repeated")
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    once = taken.join(repeated, same, "left_anti").where("times > 0").select(F.col("doc_id").alias("__id"), F.col("times").alias("__times"))
    sole = docs.join(once, same).select(*COLUMNS, "__times")
    key = ["doc_id", "source", "size"]
    shared = mix.numbered_alike(docs.join(repeated, same, "left_semi").withColumn("size", mix.n_words(F.col("text"))), key, F.xxhash64("text"))
    total = taken.join(repeated, same, "left_semi").groupBy(*(F.col(c).alias(f"__{c}") for c in key)).agg(F.count("*").alias("__n"), F.sum("times").alias("__all"))
    alike = F.lit(True)
    for c in key:
        alike &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    times = F.floor(F.col("__all") / F.col("__n")) + F.when(F.col("__k") < F.col("__all") % F.col("__n"), 1).otherwise(0)
    many = shared.join(total, alike).withColumn("__times", times.cast("int")).where("__times > 0").select(*COLUMNS, "__times")
    return sole.unionByName(many).withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of each row; null and empty texts have no ids."""
    encoded = bpe.encode_documents(docs.select("doc_id", "source", "text"), public_tokenizers.path(VOCABULARY), with_ids=True, digests=False)
    return encoded.drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("mix_sources", mix_to_targets),
    ("bpe", tokenize),
]

#: Training, MinHash and byte-pair encoding have no SQL form; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is in the shared folder, and deleted when the next stage is written."""
    docs, read = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for name, stage in STAGES[:-1]:
        written = new_folder(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(written)
        if read:
            delete(spark, read)
        docs, read = spark.read.parquet(written), written
    return STAGES[-1][1](spark, docs, sf_dir)
