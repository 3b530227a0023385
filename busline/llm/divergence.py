"""Source divergence audit: how far the term shares of each source of a language stand from those of the others."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from busline.llm.common import bounded_batches, materialized

#: Documents of its language that a term must stand in, what is added to each count, parts of a whole, and terms reported a group.
LEAST_DOCS, PRIOR, PARTS, TOP = 30, 5, 10**9, 50
#: Different terms that a task counts before it hands them on, and bytes of text that it cuts at a time.
HELD, SLICE = 200_000, 1 << 20

# Letters of a term as they are counted (A-Z lower-cased), anything else as a space: terms are what stands between spaces.
_LETTER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(raw: bytes, most: int = SLICE) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, about `most` bytes of it at a time, cut between terms."""
    if len(raw) <= most:
        yield raw.translate(_LETTER).split()
        return
    letters, at = raw.translate(_LETTER), 0
    while at < len(letters):
        to = letters.find(b" ", at + most)
        to = len(letters) if to < 0 else to
        yield letters[at:to].split()
        at = to


def count_terms(docs: DataFrame, held: int = HELD) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents with the term), summed in each task; a row of null term for each group.

    A task holds about `held` different terms; beyond that it hands on what it has and begins anew. Sums of its rows are exact.
    """
    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("d", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in counts.items():
                terms = [None, *(t.decode("utf-8", "replace") for t in n)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(d[t] for t in n)], pa.int64())], names=schema.fieldNames())
            counts.clear()

        size = 0
        for batch in batches:
            for raw, lang, source in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n, d = counts.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                own: set[bytes] = set()
                for words in pieces(raw.as_py()):
                    n.update(words)
                    own.update(words)
                d.update(own)
                size += len(n)
                if size > held:
                    yield from rows()
                    size = 0
        yield from rows()

    return docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary"), *[F.coalesce(F.col(c), F.lit("")) for c in ("lang", "source")]).mapInArrow(run, schema)


def share(count: Column, total: Column, terms: Column, prior: int = PRIOR) -> Column:
    """1 + floor(PARTS * (count + prior) / (total + prior * terms)), exact; count is part of total."""
    return F.lit(1).cast("bigint") + F.call_function("div", F.lit(PARTS).cast("decimal(10,0)") * (count + prior).cast("decimal(20,0)"), (total + prior * terms).cast("decimal(20,0)"))


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, prior: int = PRIOR, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: sources of a language against each other and against their language.

    Each language keeps the terms that stand in least_docs of its documents or more. A group's (and a language's) smoothed share of
    a term is share(). Part "pair": for each two sources of a language the summed differences of their shares. Part "term": the `top` kept
    terms that a source has more of, by share, than its language.

    Tasks sum counts before they are shuffled by term, so no term, source or language lands in one task. A kept term's counts are
    pivoted into an array with a place for each source of its language; higher-order functions make the shares
    and emit a contribution for each pair of sources, which are summed before they are shuffled. Of a language's sources
    an array is held in memory a term, and results hold all their pairs, as asked for; the terms themselves are never gathered.

    Null text, lang and source are ''. A group without terms has pairs all the same. Repeated rows, and rows of one or no doc_id, are
    documents of their own. An empty table gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    counted = count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    kept = counted.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("found")).where(F.col("term").isNull() | (F.col("d") >= least_docs))
    kept = materialized(kept.drop("d"), "terms")
    terms = kept.where("term IS NOT NULL")

    sums = terms.select("lang", F.explode("found").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = kept.where("term IS NULL").select("lang", F.explode(F.map_keys("found")).alias("source")).join(sums, ["lang", "source"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n"))))
    langs = groups.groupBy("lang").agg(ordered.alias("groups"), F.sum(F.coalesce("n", F.lit(0))).alias("whole"))
    langs = langs.join(terms.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").fillna(0, ["v"])
    langs = materialized(langs, "langs")

    # A language's row meets its terms in as many tasks as shuffles have partitions, unless Spark sees that the rows are small enough to send to all.
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wide = terms.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int"))
    wide = wide.join(langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["lang", "salt"])
    # Each array is an argument of the next, so that it is made once a term.
    counts = F.transform("groups", lambda g: F.coalesce(F.try_element_at("found", g["source"]), F.lit(0).cast("bigint")))
    cells = F.zip_with("groups", counts, lambda g, n: F.struct(g["source"].alias("source"), n.alias("n"), share(n, g["n"], F.col("v"), prior).alias("p")))
    whole = F.aggregate(F.map_values("found"), F.lit(0).cast("bigint"), lambda a, n: a + n)
    wide = materialized(wide.select("lang", "term", cells.alias("cells"), share(whole, F.col("whole"), F.col("v"), prior).alias("q")), "wide")

    apart = F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda x, k: F.struct((F.col("i") + 1 + k).alias("j"), F.abs(x - F.col("mine")).alias("f")))
    # Dealt out anew, as small rows become many.
    emitted = wide.select("lang", F.col("cells.p").alias("p")).repartition(salts).select("lang", "p", F.posexplode("p").alias("i", "mine")).select("lang", "i", F.explode(apart).alias("e")).select("lang", "i", "e.j", "e.f")
    summed = emitted.groupBy("lang", "i", "j").agg(F.sum("f").alias("f"))
    every = langs.select("lang", "groups", F.posexplode("groups").alias("i", "mine")).select("lang", "i", "mine.source", F.posexplode("groups").alias("j", "other")).where("i <> j")
    pair = every.withColumns({"a": F.least("i", "j"), "b": F.greatest("i", "j")}).join(summed.select("lang", F.col("i").alias("a"), F.col("j").alias("b"), "f"), ["lang", "a", "b"], "left")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), F.col("other.source").alias("item"), F.coalesce("f", F.lit(0).cast("bigint")).alias("value"))

    more = F.explode(F.filter("cells", lambda c: (c["n"] > 0) & (c["p"] > F.col("q")))).alias("m")
    term = wide.select("lang", F.col("term").alias("item"), "q", more).select("lang", "m.source", F.lit("term").alias("part"), "item", (F.col("m.p") - F.col("q")).alias("value"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = term.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)  # each task drops what can't be among the first before the shuffle
    return pair.withColumn("rank", F.row_number().over(ranked)).unionByName(first).select("lang", "source", "part", "item", "value", "rank")


ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(ts) AS term FROM docs) GROUP BY ALL),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(*) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM docs),
c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM t GROUP BY ALL) USING (lang, source, term)),
s AS (SELECT *, 1 + {PARTS} * (n + {PRIOR}) // (sum(n) OVER w + {PRIOR} * count(*) OVER w) AS p FROM c WINDOW w AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, 1 + {PARTS} * (sum(n) + {PRIOR}) // (sum(sum(n)) OVER (PARTITION BY lang) + {PRIOR} * count(*) OVER (PARTITION BY lang)) AS q FROM c GROUP BY lang, term),
v AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM s JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= {TOP}
"""
