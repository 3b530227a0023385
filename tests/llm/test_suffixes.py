"""Suffix-array dedup against brute force over all strings of a window's length."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from busline.llm import queries, suffixes

SF = "/root/testdata/sf0.001"
CLASH = ["key", "h", "same", "context", "place", "hashes", "n", "at", "first", "gone", "sha", "bucket"]


def brute(rows, window):
    """{(doc_id, text): (n_bytes, n_removed, spans, digest)}: windows are equal if their bytes are."""
    texts = {(d, t): (t or "").encode() for d, t in rows}
    first = {}
    for (d, _), raw in texts.items():
        if d is not None:
            for i in range(len(raw) - window + 1):
                w = raw[i : i + window]
                first[w] = min(first.get(w, (d, i)), (d, i))
    out = {}
    for (d, t), raw in texts.items():
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - window + 1) if d is not None else ():
            if first[raw[i : i + window]] < (d, i):
                gone[i : i + window] = True
        spans = [tuple(x) for x in suffixes.ranges(gone).tolist()]
        out[d, t] = len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()
    return out


def made():
    rnd = random.Random(3)
    prose = lambda n: "".join(rnd.choice("abcdefgh  é\0\n") for _ in range(n))
    shared, common = prose(180), prose(130)
    rows = [(i, prose(rnd.randrange(90, 900))) for i in range(12)]
    rows += [(20 + i, prose(50 + i) + shared + prose(40)) for i in range(6)]
    rows += [(30 + i, prose(7 * i) + common + prose(200) + common + prose(9)) for i in range(8)]
    rows += [(50, "a" * 700), (51, "x" * 99 + "a" * 300), (52, "ab" * 400), (53, "-=-" * 90), (54, "ab" * 400)]
    rows += [(60, rows[3][1]), (61, rows[3][1]), (2, rows[4][1] + "tail"), (70, rows[13][1][:150]), (-5, rows[14][1])]
    rows += [(80, None), (81, ""), (82, "short"), (83, "ü" * 49 + "ab"), (84, "ü" * 60), (85, "q" * 100), (86, "q" * 100), (None, shared), (None, rows[0][1])]
    long = prose(300_000)
    return [*rows, (90, long), (91, prose(500) + long[250_000:290_000] + prose(300)), rows[1], rows[-1]]


@pytest.mark.parametrize("group_bytes", [suffixes.GROUP_BYTES, 1500])
def test_against_brute_force(spark, group_bytes):
    rows = made()
    docs = spark.createDataFrame([(d, t, *["x"] * len(CLASH)) for d, t in rows], "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in CLASH))
    want = brute(rows, 100)
    got = suffixes.remove_earlier(docs, group_bytes=group_bytes).collect()
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, [tuple(s) for s in r.spans], r.kept_sha256) for r in got))) == sorted(map(str, ((d, n, g, len(s), s, k) for (d, t) in rows for n, g, s, k in [want[d, t]])))


def test_short_windows_and_one_piece_length(spark):
    rows = [(i, t) for i, t in made() if t is None or len(t) < 1000]
    want = brute(rows, 40)
    got = suffixes.remove_earlier(spark.createDataFrame(rows, "doc_id bigint, text string"), 40, (8,), 600).collect()
    assert sorted(map(str, ((r.doc_id, r.n_removed, r.kept_sha256) for r in got))) == sorted(map(str, ((d, want[d, t][1], want[d, t][3]) for d, t in rows)))


def test_empty_table(spark):
    out = suffixes.remove_earlier(spark.createDataFrame([], "doc_id bigint, text string"))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] and not out.collect()


def test_longest_previous_factor():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 200):
        text = bytes(rnd.integers(97, 99, n).tolist())
        order = sorted(range(n), key=lambda i: text[i:])
        same = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or text[i + k] != text[j + k]), 0)
        common = np.array([0] + [same(a, b) for a, b in zip(order, order[1:])], np.int64)[:n]
        got = suffixes.longest_previous(np.array(order, np.int64), common)
        assert got.tolist() == [max((same(i, j) for j in range(i)), default=0) for i in order]


def test_equal_windows_meet():
    rnd = random.Random(8)
    passage = bytes(rnd.randrange(256) for _ in range(150))
    parts = [bytes(rnd.randrange(256) for _ in range(k)) + passage for k in (0, 3, 40)]
    w = suffixes.Windows(parts, 100, 32)
    at = [[w.least[w.begin[i] + len(p) - 150 + k] for k in range(51)] for i, p in enumerate(parts)]
    assert at[0] == at[1] == at[2] and all(at[0]) and not w.least[w.begin[1] - 99 : w.begin[1]].any()
    lead = w.hashes[w.leaders()]
    assert all((lead == h).sum() >= 3 for h in at[0])


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    out = queries.op12_suffix_dedup(spark, SF)
    names = ", ".join(out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(con.execute(f"SELECT {names} FROM ({suffixes.ORACLE})").fetchall())
