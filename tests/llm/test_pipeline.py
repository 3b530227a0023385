"""Each stage of the pipeline on its own input, and the driver's contract with and without this subpackage."""

import collections
import importlib.util
import os
import random
import re
import shutil
import subprocess
import sys

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pipeline():
    import corpus_pipeline

    return corpus_pipeline


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(rnd):
    """(doc_id, text, source): near copies with repeated lines, nulls, empty and long texts, and rows that stand twice."""
    line = lambda n=12: " ".join(f"w{rnd.randrange(900)}" for _ in range(n))
    page = lambda k: [line() for _ in range(k)]
    base = [page(14) for _ in range(8)]
    rows = [(i, "\n".join(b), "abc"[i % 3]) for i, b in enumerate(base)]
    for k, b in enumerate(base[:5]):  # one word differs: line dedup leaves a few lines of these
        near = list(b)
        near[6] = near[6].replace("w", "v", 1)
        rows.append((20 + k, "\n".join(near), "a"))
    rows += [(40, rows[0][1], "b"), (41, None, "a"), (42, "", None), (43, " \n ", "c"), (44, "\n".join(page(1500)), "c"), (45, line() + " vile", "a")]
    rows += [(60 + i, f"{line()}. {line()} {'vile' if i % 2 else 'kind'}. {line()}", "b") for i in range(60)]
    return [*rows, rows[3], rows[3], (None, "\n".join(page(5)), "a"), (None, "\n".join(page(5)), "a"), (None, None, None)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """The fixture as tables of a folder, and the rows."""
    rows, at = rows_of(random.Random(21)), tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{at}/documents.parquet")
    labels = [(60 + i, 1, i % 2) for i in range(60)] + [(60, None, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def stage(pipeline, spark, name, docs, at):
    """A stage's rows (doc_id, text, source), also with extra columns of clashing names."""
    fn = dict(pipeline.STAGES)[name]
    plain = fn(spark, docs, at)
    assert plain.columns == docs.columns
    more = fn(spark, docs.withColumns({c: F.lit("x") for c in ("score", "a", "b", "size", "times", "n", "rep", "__id", "n_removed", "words")}), at)
    key = lambda df: sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=repr)
    found = key(plain)
    assert key(more) == found
    none = fn(spark, docs.limit(0), at)
    assert none.columns == docs.columns and none.count() == 0
    return found


def grams(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def similar(x, y):
    return bool(x and y) and len(x & y) >= 0.8 * len(x | y)


def test_toxicity_stage(spark, pipeline, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    got = stage(pipeline, spark, "toxicity", docs, made)
    want = [(r.doc_id, r.text, r.source) for r in docs.collect() if "vile" not in (r.text or "")]
    assert got == sorted(want, key=repr)


def test_line_stage(spark, pipeline, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    seen, want = {}, []
    for i, t, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ls = [] if t is None else t.split("\n")
        gone = set()
        for k in range(len(ls) - 2):
            if seen.setdefault(tuple(ls[k : k + 3]), (i, t, k)) != (i, t, k):
                gone |= {k, k + 1, k + 2}
        left = None if t is None else "\n".join(x for k, x in enumerate(ls) if k not in gone)
        if not gone or WORD.search(left):
            want.append((i, left, s))
    assert stage(pipeline, spark, "line_dedup", docs, made) == sorted(want, key=repr)
    assert any(i == 20 and len(t) < 200 for i, t, _ in want) and not any(i == 40 for i, _, _ in want)


def test_ngram_stage(spark, pipeline, made):
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{made}/documents.parquet").collect()}
    docs = dict(pipeline.STAGES)["line_dedup"](spark, spark.read.parquet(f"{made}/documents.parquet"), made)
    docs.write.mode("overwrite").parquet(f"{made}/lines")
    docs = spark.read.parquet(f"{made}/lines")
    rows = sorted({(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id is not None})
    root = {r[0]: r[0] for r in rows}
    now = {i: grams(t) for i, t, _ in rows}
    before = {i: grams(whole[i]) for i in now}  # the stage's input holds lines of these
    for i in now:
        for j in now:
            if i < j and (similar(now[i], now[j]) or similar(before[i], before[j])):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    want = [r for r in rows if root[r[0]] == r[0]] + [(r.doc_id, r.text, r.source) for r in docs.where("doc_id IS NULL").collect()]
    got = stage(pipeline, spark, "ngram_join", docs, made)
    assert got == sorted(want, key=repr)
    assert not {20, 21, 22, 23, 24} & {i for i, _, _ in got} and len([1 for i, _, _ in got if i == 3]) == 1
    # Texts that sf_dir has under the same doc_id but that the present ones are no part of don't count.
    other = spark.createDataFrame([(0, "one two three four five six", "en", "a", 1), (20, "un deux trois quatre cinq six", "en", "a", 1)], docs.schema)
    assert len(stage(pipeline, spark, "ngram_join", other, made)) == 2


def test_mix_stage(spark, pipeline, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    size = lambda t: len(WORD.findall(t or ""))
    per = collections.Counter()
    for _, t, s in rows:
        per[s] += size(t)
    order, total = [*sorted(s for s in per if s), *([None] if None in per else [])], sum(per.values())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * total, set(order)
    while open_ and (over := [s for s in open_ if weight[s] * left / sum(weight[o] for o in open_) > 2 * per[s]]):
        for s in over:
            target[s] = 2 * per[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    target |= {s: weight[s] * left / sum(weight[o] for o in open_) for s in open_}
    got = stage(pipeline, spark, "mix_sources", docs, made)
    there, taken = collections.Counter(rows), collections.Counter(got)
    assert not set(taken) - set(there) and all(taken[r] <= 2 * there[r] for r in taken)
    for s in order:
        sizes = [size(t) for _, t, x in rows if x == s]
        assert abs(sum(size(t) for _, t, x in got if x == s) - target[s]) <= max(sizes)
        if target[s] >= per[s]:  # a complete epoch comes first
            assert all(taken[r] >= n for r, n in there.items() if r[2] == s and size(r[1]))


def test_bpe_stage(spark, pipeline, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = dict(pipeline.STAGES)["bpe"](spark, docs.withColumns({"ids": F.lit("x"), "n_tokens": F.lit("x")}), made)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"]
    key = lambda rows: sorted(rows, key=repr)
    want = [(r.doc_id, r.source, library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    assert key((r.doc_id, r.source, list(r.ids)) for r in out.collect()) == key(want) and out.where("n_tokens <> size(ids)").count() == 0


def test_run_is_the_stages(spark, pipeline):
    first, second = pipeline.run(spark, SF), pipeline.run(spark, SF)
    key = lambda df: sorted((r.doc_id, r.n_tokens, hash(tuple(r.ids))) for r in df.collect())
    assert key(first) == key(second) and len(key(first)) > 0


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= names


def test_entry_without_this_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()), len(e.oracle_sql()))"], cwd=tmp_path / "repo", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0 and done.stdout.split()[1] == "False" and int(done.stdout.split()[0]) > 40, done.stderr


def test_nothing_else_imports_it():
    assert importlib.util.find_spec("busline.llm")
    for folder, _, names in os.walk(os.path.join(ROOT, "busline")):
        for name in names:
            if name.endswith(".py") and not folder.endswith("llm"):
                with open(os.path.join(folder, name)) as f:
                    assert "busline.llm" not in f.read()
