"""Quality rules on documents and hosts: failures by host, shrunk with an empirical beta prior, joined back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busline.llm.common import Words, append_from_text, materialized, slices

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: Failure rate, shrunk to the corpus' rate, above which a host fails.
HOST_LIMIT = 0.5

COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


def _repeated(words: Words) -> np.ndarray:
    """Per text, the words in windows of three words that stand twice or more in the text."""
    n, owner = len(words.hash), words.owner()
    if n < 3:
        return np.zeros(len(words.first) - 1, np.int64)
    whole = np.zeros(n, bool)
    whole[: n - 2] = owner[: n - 2] == owner[2:]
    at = np.flatnonzero(whole)
    gram = words.grams(3)[at]
    order = np.lexsort((gram, owner[at]))
    g, o = gram[order], owner[at][order]
    same = (g[1:] == g[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[order[twice]]
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[hit + k] = True
    return np.bincount(owner[covered], minlength=len(words.first) - 1)


def count_rules(texts: list) -> list[list]:
    """The counts of COUNTS for texts; null counts as no text."""
    out: list[list] = [[] for _ in COUNTS]
    for a, b in slices(texts):
        part = texts[a:b]
        words = Words(part)
        buf = np.frombuffer(words.data, np.uint8)
        points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        chars = np.concatenate([[0], np.cumsum(points[words.end] - points[words.start])])
        out[0] += np.diff(words.first).tolist()
        out[1] += (chars[words.first[1:]] - chars[words.first[:-1]]).tolist()
        out[4] += _repeated(words).tolist()
        for t in part:
            t = t or ""
            lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            out[2].append(sum(map(t.count, SYMBOLS)))
            out[3].append(len(lines) - len(set(lines)))
    return out


def with_base_rules(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    counted = append_from_text(docs, lambda: count_rules, COUNTS)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def host_verdicts(rows: DataFrame, host: str = "host", failed: str = "base_failed", limit: float = HOST_LIMIT) -> DataFrame:
    """host, n_docs, n_failed, rate, host_failed over rows (host, failed).

    The beta prior is fitted by moments to the failure rates of all hosts, each host counting by its documents; the
    rate is the posterior mean (n_failed + a) / (n_docs + a + b), so that a host of few documents stays near the
    corpus' rate. A host fails when its rate is above limit.
    """
    per = rows.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("bigint")).alias("n_failed"))
    share = F.col("n_failed") / F.col("n_docs")
    m = per.agg(F.count("*").alias("hosts"), F.sum("n_docs").alias("n"), F.sum("n_failed").alias("k"), F.sum(F.col("n_docs") * share * share).alias("q")).first()
    mean = (m["k"] or 0) / max(m["n"] or 0, 1)
    spread = mean * (1 - mean)
    # What of the variance between rates is more than drawing n_docs documents explains.
    between = (m["q"] or 0.0) / max(m["n"] or 0, 1) - mean * mean - spread * (m["hosts"] or 0) / max(m["n"] or 0, 1)
    weight = min(max(spread / between - 1, 1.0), 1e6) if between > 1e-12 else 1e6
    a, b = max(mean, 1e-6) * weight, max(1 - mean, 1e-6) * weight
    rate = (F.col("n_failed") + F.lit(a)) / (F.col("n_docs") + F.lit(a + b))
    return per.withColumn("rate", rate).withColumn("host_failed", F.col("rate") > limit)


def apply_quality(docs: DataFrame, host: Column, limit: float = HOST_LIMIT) -> DataFrame:
    """The columns of docs without text, the counts, base_failed, host, host_rate, host_failed and kept.

    kept is false for documents that fail the base rules and for those of a failing host. Null and empty texts have no
    word and fail; a null host is a host of its own. Extra columns pass, except those named like a result; repeated
    rows count as often as they stand; an empty table gives no rows. Texts are read once and never shuffled; a host's
    rows are counted before they are shuffled.
    """
    counted = with_base_rules(docs.withColumn("host", host)).drop("text")
    counted = materialized(counted, "quality")
    verdicts = host_verdicts(counted, limit=limit).alias("v")
    joined = counted.drop("host_rate", "host_failed", "kept").alias("c").join(verdicts, F.col("c.host").eqNullSafe(F.col("v.host")))
    joined = joined.select("c.*", F.col("v.rate").alias("host_rate"), "v.host_failed")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


_ORACLE = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM t),
g AS (SELECT doc_id, unnest(range(1, len(ws)::BIGINT - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM h WHERE n >= 2) GROUP BY doc_id),
c AS (SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT
   - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_dup_lines,
  coalesce(n_repeat, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
p AS (SELECT source, count(*) AS n, sum(base_failed::INT)::DOUBLE AS k FROM f GROUP BY source),
m AS (SELECT count(*)::DOUBLE AS hosts, sum(n)::DOUBLE AS n, sum(k) / sum(n) AS mean, sum(n * (k / n) * (k / n)) AS q FROM p),
b AS (SELECT mean, mean * (1 - mean) AS spread, q / n - mean * mean - mean * (1 - mean) * hosts / n AS btw FROM m),
a AS (SELECT mean, CASE WHEN btw > 1e-12 THEN least(greatest(spread / btw - 1, 1.0), 1e6) ELSE 1e6 END AS wt FROM b),
v AS (SELECT source, (k + greatest(mean, 1e-6) * wt) / (n + greatest(mean, 1e-6) * wt + greatest(1 - mean, 1e-6) * wt) > HOST_LIMIT AS host_failed FROM p, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""


def oracle(limit: float = HOST_LIMIT) -> str:
    """DuckDB SQL for the counts and verdicts, a document's source being its host."""
    return _ORACLE.replace("HOST_LIMIT", repr(limit))
