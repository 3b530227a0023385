"""Toxicity by multiple-instance learning: sentence probabilities joined by noisy-or, trained from document labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busline.llm.common import append_from_text, bounded_batches

_TOKEN = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
#: Beside whole words, beginnings of words of these lengths are features, so that unseen forms of a stem are known.
PREFIXES = range(3, 9)
#: Words remembered by one Python worker.
MEMO = 400_000


def features(word: str) -> list[str]:
    """A lower-case word and its beginnings, marked to tell them apart."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


class _Memo(dict):
    """word -> ids of its features that the model knows, or None."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known

    def __missing__(self, word: str):
        if len(self) >= MEMO:
            self.clear()
        got = tuple(self.known[f] for f in features(word) if f in self.known) or None
        self[word] = got
        return got


@dataclass
class ToxicityModel:
    """Feature weights of a sentence and its bias; a document's probability is 1 - prod(1 - p(sentence)).

    Of the sentences without a known feature all count as one, which stands for what the features don't know: else any
    document would become toxic by length alone.
    """

    known: dict[str, int]
    weights: np.ndarray
    bias: float

    def probability(self, found: tuple[int, ...]) -> float:
        z = self.bias + float(self.weights[list(found)].sum()) if found else self.bias
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

    def score(self, text: str | None, memo: dict) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability and (start, end, probability) of its offending sentences, offsets in code points."""
        clean, spans, m = math.log1p(-self.probability(())), [], None
        for m in _SENTENCE.finditer(text or ""):
            hits = [h for h in map(memo.__getitem__, _TOKEN.findall(m[0].lower())) if h]
            if not hits:
                continue
            p = self.probability(tuple(sorted({i for h in hits for i in h})))
            clean += math.log1p(-min(p, 1 - 1e-12))
            if p >= 0.5:
                spans.append((m.start(), m.end(), p))
        return -math.expm1(clean) if m else 0.0, spans


def _bags(text: str | None, memo: dict) -> Counter:
    """How many sentences have each set of features; those without any count as one."""
    bag: Counter = Counter()
    for s in _SENTENCE.findall(text or ""):
        bag[tuple(sorted({i for h in map(memo.__getitem__, _TOKEN.findall(s.lower())) if h for i in h}))] += 1
    bag[()] = 1
    return bag


def _stems(counts: dict[str, tuple[int, int]]) -> list[str]:
    """Leave out a beginning that a longer one equals, and what a shorter beginning says with no lower precision."""
    def longer(f: str) -> bool:
        return any(g != f and len(g) > len(f) and g.startswith(f[:-1]) and counts[g] == counts[f] for g in counts) if f[-1] == "*" else False

    stems = {f: c for f, c in counts.items() if not longer(f)}
    precision = lambda c: c[0] / (c[0] + c[1])
    return [f for f, c in stems.items() if not any(g != f and g[-1] == "*" and f.rstrip("*").startswith(g[:-1]) and precision(d) >= precision(c) for g, d in stems.items())]


def _descend(sets: list[tuple], counts: np.ndarray, doc: np.ndarray, y: np.ndarray, n: int, rounds: int = 500, rate: float = 0.1, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam on the noisy-or likelihood; a row is a feature set of a document and how many of its sentences have it."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    row, col = np.repeat(np.arange(len(sets)), size), np.fromiter((i for s in sets for i in s), np.int64, int(size.sum()))
    theta = np.zeros(n + 1)
    theta[-1] = -6.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + 1):
        z = np.clip(theta[-1] + np.bincount(row, theta[col], len(sets)), -40, 40)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(doc, -counts * np.logaddexp(0, z), len(y))
        none = np.minimum(none, -1e-9)
        lift = np.where(y == 1, -np.exp(none) / -np.expm1(none), 1.0)
        g = counts * p * lift[doc]
        grad = np.append(np.bincount(col, g[row], n), g.sum())
        grad[:-1] += ridge * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = 12_000, max_features: int = 768, least: int = 4, share: float = 0.015, sure: float = 5.0) -> ToxicityModel:
    """Fit on documents whose label is known, at most about max_docs of them (a bounded sample by a hash of doc_id).

    Features are the max_features words and word beginnings that stand in at least `least` toxic documents and in
    `share` of the toxic documents of the sample and lean most to them (two-sample z of document frequencies above
    `sure`, counted in Spark); those that only repeat a better beginning are left out. The driver then holds, for
    each sampled document, its distinct sets of these features with counts. Null labels are ignored; a document with
    several labels is toxic if one says so; without both classes the model scores everything 0.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    total = known.count()
    bound = F.abs(F.xxhash64(F.lit("toxicity"), "doc_id") % 1_000_000) < int(1_000_000 * min(1.0, max_docs / max(total, 1))) + 1
    # The sample has max_docs rows by its bound, give or take a few percent: small enough for every executor.
    train = docs.select("doc_id", "text").join(F.broadcast(known.where(bound)), "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"]):
                n[y == 1] += 1
                seen[y == 1].update({f for w in set(_TOKEN.findall((text or "").lower())) for f in features(w)})
        every = [None, *(seen[0] | seen[1])]
        for at in range(0, len(every), 50_000):
            part = every[at : at + 50_000]
            yield pd.DataFrame({"f": part, "n1": [n[1] if f is None else seen[1][f] for f in part], "n0": [n[0] if f is None else seen[0][f] for f in part]})

    counts = train.mapInPandas(count, "f string, n1 bigint, n0 bigint").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    sums = F.broadcast(counts.where("f IS NULL").select(F.col("n1").alias("t1"), F.col("n0").alias("t0")))  # one row
    p = (F.col("n1") + F.col("n0")) / (F.col("t1") + F.col("t0"))
    z = (F.col("n1") / F.col("t1") - F.col("n0") / F.col("t0")) / F.sqrt(p * (1 - p) * (1 / F.col("t1") + 1 / F.col("t0")) + 1e-12)
    best = counts.where((F.col("f").isNotNull()) & (F.col("n1") >= least)).join(sums, F.lit(True)).where("t1 > 0 AND t0 > 0").where(F.col("n1") >= F.col("t1") * share)
    ranked = best.withColumn("z", F.round(z, 9)).where(F.col("z") > sure).orderBy(F.desc("z"), "f").limit(max_features)
    chosen = _stems({r["f"]: (r["n1"], r["n0"]) for r in ranked.select("f", "n1", "n0").collect()})
    known_features = {f: i for i, f in enumerate(chosen)}

    def bag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Memo(known_features)
        for pdf in batches:
            rows = [(i, int(y), list(s), c) for i, y, b in zip(pdf["doc_id"], pdf["y"], map(lambda t: _bags(t, memo), pdf["text"])) for s, c in b.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "y", "found", "n"])

    rows = train.mapInPandas(bag, "doc_id bigint, y int, found array<int>, n bigint").toPandas()
    if not chosen or not len(rows):
        return ToxicityModel({}, np.zeros(0), -40.0)
    rows["found"] = [tuple(map(int, s)) for s in rows["found"]]
    rows = rows.sort_values(["doc_id", "found"], kind="stable")
    codes, _ = pd.factorize(rows["doc_id"])
    y = np.zeros(codes.max() + 1)
    y[codes] = rows["y"].to_numpy()
    w, b = _descend(list(rows["found"]), rows["n"].to_numpy(float), codes, y, len(chosen))
    return ToxicityModel(known_features, w, b)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with score (double, 0 to 1) and offending (array of start, end, p of sentences, offsets in code points).

    Reads whole texts. Null and empty texts have no sentence and score 0. Extra columns are kept, except that score and
    offending are replaced; repeated rows are scored one by one, and an empty table gives no rows. No shuffle.
    """
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])
    fields = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(span))])

    def start():
        memo = _Memo(model.known)

        def run(texts: list) -> list[list]:
            got = [model.score(t, memo) for t in texts]
            return [[g[0] for g in got], [[dict(zip(("start", "end", "p"), s)) for s in g[1]] for g in got]]

        return run

    return append_from_text(docs, start, fields)
