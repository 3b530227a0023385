"""Source divergence audit against brute force with Python integers."""

import collections
import random
import re

import duckdb

from busline.llm import divergence, queries

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(lower))) for text, lang, source in rows]
    out = []
    for lang in {x for x, _, _ in docs}:
        df = collections.Counter(t for x, _, ts in docs if x == lang for t in set(ts))
        kept = sorted(t for t, n in df.items() if n >= least)
        count = collections.defaultdict(collections.Counter)
        for x, s, ts in docs:
            if x == lang:
                count[s].update(ts)
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        q = share(sum(count.values(), collections.Counter()))
        p = {s: share(c) for s, c in count.items()}
        for s in p:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(ranked, 1) if part == "pair" or r <= top]
    return sorted(out)


def corpus():
    rnd = random.Random(6)
    words = ["Ab", "aB", "é", "É", "x1y", "foo-bar", "ﬀ", "日本", "zz"] + [f"w{chr(97 + i)}{chr(97 + k)}" for i in range(5) for k in range(9)]
    rows = [(" ".join(rnd.choices(words, weights=range(1, len(words) + 1), k=rnd.randrange(40))), rnd.choice(["en", "de", None, ""]), rnd.choice(["a", "b", "ü", None, "", "c"])) for _ in range(200)]
    rows += [(None, "en", "silent"), ("", "xx", "one"), ("12 34", "xx", "two"), ("lonely", "yy", None), ("\0A\0", "en", "a"), ("Same same " * 40_000, "en", "b")]
    return rows * 2  # rows that stand twice


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, term string, rank string").repartition(3)
    assert sorted(map(tuple, divergence.audit_sources(df, 12, top=7).collect())) == brute(rows, 12, 7)


def test_no_kept_term_and_empty_table(spark):
    rows = [("a b", "en", "x"), ("c", "en", "y"), ("d", "fr", "z")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit_sources(df).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert not divergence.audit_sources(df.limit(0)).collect()


def test_tasks_hand_on_what_they_hold(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    total = lambda held: sorted(map(tuple, divergence.count_terms(df, held).groupBy("lang", "source", "term").sum("n", "d").collect()), key=str)
    assert total(5) == total(10**6)


def test_terms_are_cut_between(spark):
    raw = "Ab, cdé EF12gh ".encode() * 50
    assert [t for p in divergence.pieces(raw, 40) for t in p] == next(divergence.pieces(raw))


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    out = queries.op13_source_divergence(spark, SF)
    assert sorted(map(tuple, out.collect())) == sorted(con.execute(f"SELECT {', '.join(out.columns)} FROM ({divergence.ORACLE})").fetchall())
