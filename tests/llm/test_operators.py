"""Each operator against brute force on small fixtures, and on nulls, empty and long texts, ties, repeated rows and empty tables."""

import base64
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from busline.llm import bpe, common, lines, mix, ngrams, quality, queries, records, secrets, substrings, toxicity, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Names that operators use inside or return.
CLASH = ["score", "words", "band", "key", "n", "a", "b", "rep", "set", "size", "times", "range", "n_words", "kept", "host", "class_id", "ids", "part", "prefix"]


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    df = df.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("bigint"))
    return df.withColumns({c: F.lit("x") for c in CLASH})


def corpus():
    rnd = random.Random(5)
    base = [prose(rnd, 120) for _ in range(12)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(20, base[0], "s0"), (21, base[0], None), (22, base[1] + " tail", "s1"), (23, base[2].replace("w1 ", "w2 "), "s0"), (24, "head " + base[1], "s2")]
    shared = prose(rnd, 60)
    rows += [(30 + i, f"{prose(rnd, 30)} {shared} {prose(rnd, 20)}", "s0") for i in range(4)]
    rows += [(40, None, "s0"), (41, "", "s1"), (42, "  \n\t ", "s1"), (43, "one two", "s2"), (44, "one two", "s2"), (45, prose(rnd, 30_000, 5000), "s2")]
    rows += [(46, "a\nb\nc\nd\na\nb\nc\ne", "s1"), (47, "x\na\nb\nc\n", "s1"), (48, "Ünï ½ <|endoftext|>   é  😀", "s1"), (49, "hh " * 80, "s9")]
    return [*rows, rows[3], rows[12]]  # rows that stand twice


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, corpus()).cache()


def by_id(df, *columns):
    return {r[0]: tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("doc_id", *columns).collect()}


def distinct_docs():
    return sorted(dict((i, t or "") for i, t, _ in corpus()).items())


def test_words():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab \t\n é\x1c") for _ in range(rnd.randrange(30))) for _ in range(300)] + [None, ""]
    w = common.Words(texts)
    for i, t in enumerate(texts):
        mine = [w.data[w.start[k] : w.end[k]].decode() for k in range(w.first[i], w.first[i + 1])]
        assert mine == WORD.findall(t or "")
    seen = {}
    for k in range(len(w.hash)):
        assert seen.setdefault(int(w.hash[k]), w.text(k, k + 1)) == w.text(k, k + 1)


def twins(n, a="a", b="b"):
    """A Thue-Morse word of n letters and its complement, which a polynomial modulo a power of two can't tell apart when they are long."""
    one = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(b if x else a for x in one), "".join(a if x else b for x in one)


@pytest.mark.parametrize("n", [16, 64, 1024, 2048, 4096])
def test_long_words_differ(spark, tmp_path, n):
    x, y = twins(n)
    w = common.Words([f"{x} {y}"])
    assert len(set(w.hash.tolist())) == 2
    assert quality.count_rules([f"{x} {x} {x} {y} {y} {y}"])[4] == [0]
    rows = [(i, " ".join([word] * 10 + ["tail"] * 41), "s") for i, word in enumerate((x, y))]
    docs = table(spark, rows)
    assert [r.n_removed for r in substrings.remove_repeats(docs).collect()] == [0, 0]
    assert [r.n_links for r in ngrams.jaccard_classes(docs).collect()] == [0, 0]
    docs.select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    out = queries.op6_quality_rules(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == sorted(con.execute(f"SELECT {', '.join(out.columns)} FROM ({quality.oracle()})").fetchall())


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}


def test_mix(spark, docs):
    rows = mix.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    sizes = collections.Counter()
    for i, t, s in corpus():
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:  # share again until none is above its limit
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: weight[s] * level for s in open_}
    for s in order:
        mine = [r for r in rows if r.source == s]
        assert mine[0].target == pytest.approx(target[s]) and mine[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(r.size for r in mine)
        assert all(r.taken <= 2 * r.size for r in mine)
    assert sorted(map(str, rows)) == sorted(map(str, mix.mix_sources(docs.repartition(3)).collect()))
    assert mix.mix_sources(docs.limit(0)).count() == 0


def test_lines(spark, docs):
    seen, want = {}, {}
    for i, t in distinct_docs():
        ls = t.split("\n")
        gone = set()
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            if seen.setdefault(w, (i, k)) != (i, k):
                gone |= {k, k + 1, k + 2}
        want[i] = (len(ls), len(gone), "\n".join(x for k, x in enumerate(ls) if k not in gone))
    out = lines.dedup_lines(docs)
    assert set(docs.columns) <= set(out.columns) and out.count() == docs.count()
    for i, (n, g, t) in by_id(out, "n_lines", "n_removed", "text").items():
        assert (n, g, t) == ((0, 0, None) if i == 40 else want[i])
    assert by_id(out, "n_removed")[46] == 3 and by_id(out, "n_removed")[47] == 3
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    none = table(spark, [(None, "a\nb\nc", "s"), (1, "a\nb\nc", None)])
    assert sorted((str(r.doc_id), r.text) for r in lines.dedup_lines(none).collect()) == [("1", ""), ("None", "a\nb\nc")]


def test_quality(docs):
    out = quality.apply_quality(docs, F.col("source"))
    assert out.count() == docs.count()
    got = by_id(out, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, t in distinct_docs():
        w = WORD.findall(t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
        ls = [x for x in t.split("\n") if WORD.search(x)]
        n = len(covered)
        assert got[i] == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), n, len(w) < 50 or 100 * n > 50 * len(w))
    assert quality.apply_quality(docs.limit(0), F.col("source")).count() == 0


def test_hosts_on_both_sides_of_the_limit(spark, tmp_path):
    """Shrunk rates by hand, and the whole table against the registered SQL."""
    rnd = random.Random(14)
    hosts = [("bad", 40, 30), ("good", 300, 6), ("fair", 80, 30), ("tiny", 1, 1), (None, 12, 11), ("clean", 50, 0)]
    rows = [(prose(rnd, 8 if k < failing else 60), host) for host, n, failing in hosts for k in range(n)]
    docs = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(rows)], "doc_id bigint, text string, source string")
    docs = docs.withColumns({c: F.lit("x") for c in ("host", "kept", "host_failed", "n_words", "__host")})
    docs.write.parquet(f"{tmp_path}/documents")
    n, k = sum(h[1] for h in hosts), sum(h[2] for h in hosts)
    mean, q = k / n, sum(f * f / m for _, m, f in hosts) / n
    between = q - mean**2 - mean * (1 - mean) * len(hosts) / n
    weight = mean * (1 - mean) / between - 1
    rate = {h: (f + mean * weight) / (m + weight) for h, m, f in hosts}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    for limit in (0.5, 0.3):
        out = quality.apply_quality(docs, F.col("source"), limit)
        failed = {r.host: (r.host_rate, r.host_failed) for r in out.select("host", "host_rate", "host_failed").distinct().collect()}
        assert failed == {h: (pytest.approx(r), r > limit) for h, r in rate.items()}
        assert failed["bad"][1] and not failed["good"][1] and not failed["clean"][1] and failed["fair"][1] == (limit < 0.4)
        assert mean < failed["tiny"][0] < 0.8  # one failure of one document, shrunk
        got = {r.doc_id: (r.n_words, r.base_failed, r.kept) for r in out.collect()}
        assert all(got[i][2] == (len(t.split()) >= 50 and not failed[h][1]) for i, (t, h) in enumerate(rows))
        want = con.execute(quality.oracle(limit)).df()
        assert got == {r.doc_id: (r.n_words, r.base_failed, r.kept) for r in want.itertuples()}


def scanned(text):
    """(kind, start, end) of the base rules by stepping through the text, without regular expressions."""
    found, digits = [], "0123456789"
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = "".join(low[upper.index(c)] if c in upper else c for c in text)
    run = lambda i, allowed: next((j for j in range(i, len(text)) if text[j] not in allowed), len(text))

    def value(i):
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if folded.startswith(w, i)), None)
        if word is None:
            return None
        i += len(word)
        i += text[i : i + 1] in ("'", '"') and i < len(text)
        i = run(i, " ")
        if text[i : i + 1] not in (":", "=") or i >= len(text):
            return None
        i = run(i + 1, " ")
        starts = [i + 1, i] if i < len(text) and text[i] in "'\"" else [i]
        for s in starts:
            e = run(s, upper + low + digits + "+/_.=-")
            if e > s:
                return s, e
        return None

    i = 0
    while i < len(text):
        v = value(i)
        if v and v[1] - v[0] >= 6:
            found.append((i, 0, "assign", v[1]))
        i = v[1] if v else i + 1
    i = 0
    while i < len(text):
        if text.startswith("AKIA", i) and (e := run(i + 4, upper + digits)) > i + 4:
            if e - i >= 20:
                found.append((i, 1, "access", e))
            i = e
        else:
            i += 1
    i = 0
    while i < len(text):
        e = run(i, digits + "abcdef")
        if e - i >= 24:
            found.append((i, 2, "hex", e))
        i = max(e, i + 1)
    return [(k, a, e) for a, _, k, e in sorted(found)]


def test_secret_scan_against_stepping(spark):
    rnd = random.Random(15)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "APIKEY", "apikey", ":", "=", " ", "  ", '"', "'", "AKIA", "AKIAB", "ABCDEFGH12345678", "é", "ſecret", "\n", "abc123", "0f" * 12, "deadbeef" * 3, "x", "==", "a.b-c_d/", "ToKen=", "K"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 25))) for _ in range(3000)] + ["", None, "y" * 300_000 + " token = longenough " + "f" * 100_000]
    rows = [(i if i % 7 else None, t, str(i)) for i, t in enumerate(texts)]
    df = table(spark, [*rows, rows[5], rows[5]]).withColumn("spans", F.lit("x")).withColumn("n_hex", F.lit("x"))
    out = secrets.scan_secrets(df).select("text", "source", "spans", "n_assign", "n_access", "n_hex", "base_sha256").collect()
    assert len(out) == len(rows) + 2
    some = 0
    for r in out:
        want = scanned(r.text or "")
        line = ",".join(f"{k}:{a}:{e}" for k, a, e in want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in want) for kind in ("assign", "access", "hex")), r.text
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and set(line.split(",")) - {""} <= set(r.spans.split(","))
        some += len(want)
    assert some > 1000


def der(*parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return b"\x30" + size + body


def test_secrets(spark):
    rsa = der(b"\x02\x01\x00", *[b"\x02\x20" + bytes([1 + k] * 32) for k in range(8)])
    ssh = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"".join(len(x).to_bytes(4, "big") + x for x in (b"pub" * 9, b"priv" * 9))
    url = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    jwt = f"{url(b'{\"alg\":\"HS256\"}')}.{url(b'{\"sub\":1}')}.c2ln"
    texts = [f"é Password = 'abc123!' {base64.b64encode(rsa).decode()} end", f"x {base64.b64encode(ssh).decode()}", f"t {jwt} u", rsa.hex(), base64.b64encode(rsa[:-1]).decode(), "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "token=ab secret: longer.one", None, "", "eyJhbGc.eyJ.x " + "0f" * 12]
    rows = {r.doc_id: r for r in secrets.scan_secrets(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert rows[0].spans.startswith("assign:2:20,der:23:") and rows[0].n_assign == 1 and rows[0].n_confirmed == 1
    assert rows[0].base_sha256 == hashlib.sha256(b"assign:2:20").hexdigest()
    assert rows[1].spans.startswith("ssh:2:") and rows[2].spans == f"jwt:2:{2 + len(jwt)}"
    assert rows[3].n_hex == 1 and rows[3].spans == f"hex:0:{2 * len(rsa)},der:0:{2 * len(rsa)}"
    assert rows[4].n_confirmed == 0 and rows[5].n_access == 1 and rows[6].n_assign == 1 and rows[9].spans == "hex:14:38"
    assert rows[7].spans == rows[8].spans == "" and rows[7].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.scan_secrets(table(spark, [(1, "x", "s")]).limit(0)).count() == 0


def test_bpe_and_records(spark, docs):
    library = Tokenizer.from_file(VOCABULARY)
    rnd = random.Random(9)
    odd = ["".join(rnd.choice(["a", "b ", " ", "\n", "'s", "é", "1", "½", ".", "the", " the", "<|endoftext|>", "\u0085", "😀", "aaaa"]) for _ in range(rnd.randrange(40))) for _ in range(1500)]
    one = bpe.Bpe(VOCABULARY)
    made = bpe.piece_encoder(VOCABULARY)(odd)
    other = records.library_encoder(VOCABULARY)(odd)
    for t, x, y in zip(odd, made, other):
        ids = library.encode(t, add_special_tokens=False).ids
        assert x == y == np.array(ids, "<u4").tobytes()
        assert one.decode(x) == library.decode(ids, skip_special_tokens=False)
    out = bpe.encode_documents(docs, VOCABULARY, with_ids=True)
    got, start = by_id(out, "n_tokens", "ids_sha256", "decoded_sha256", "ids"), 0
    assert out.count() == docs.count() and bpe.encode_documents(docs.limit(0), VOCABULARY).count() == 0
    path = f"{common.shared_dir(spark)}/records-test-{rnd.random()}"
    unique = docs.dropDuplicates(["doc_id"])
    records.write_records(unique, path, VOCABULARY, range_bytes=20_000)
    index = by_id(records.read_index(spark, path), "start", "n_tokens", "ids_crc32")
    fetched = dict(map(tuple, records.read_shuffled(spark, path, 3).collect()))
    for i, t in distinct_docs():
        ids = library.encode(t, add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert got[i] == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids)
        assert index[i] == (start, len(ids) + 1, zlib.crc32(raw + b"\2\0\0\0")) and fetched[i] == [*ids, 2]
        start += len(ids) + 1
    frame = records.frame(b"payload")
    assert records.unframe(frame, 0) == (b"payload", len(frame))
    for k in (0, 9, 14, len(frame) - 1):
        with pytest.raises(ValueError):
            records.unframe(frame[:k] + bytes([frame[k] ^ 1]) + frame[k + 1 :], 0)
    empty = f"{path}-empty"
    records.write_records(docs.limit(0), empty, VOCABULARY)
    assert records.read_index(spark, empty).count() == 0
    nulls = f"{path}-nulls"
    records.write_records(table(spark, [(None, "b", "s"), (5, "a", "s"), (5, "a", "s")]), nulls, VOCABULARY)
    assert [tuple(r) for r in records.read_index(spark, nulls).orderBy("start").select("doc_id", "start").collect()] == [(None, 0), (5, 2), (5, 4)]


def test_ngrams(spark, docs):
    sets = {}
    for i, t in distinct_docs():
        w = WORD.findall(t)
        sets[i] = set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()
    links = collections.defaultdict(set)
    for x in sets:
        for y in sets:
            if x < y and sets[x] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                links[x].add(y)
                links[y].add(x)
    out = ngrams.jaccard_classes(docs)
    got = by_id(out, "class_id", "n_links", "kept")
    assert out.count() == len(sets)
    for i in sets:
        group, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        assert got[i] == (min(group), len(links[i]), min(group) == i)
    assert got[44][0] == 43 and got[21][0] == 0 and ngrams.jaccard_classes(docs.limit(0)).count() == 0
    bands, rows = ngrams.band_plan(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_ngram_blocks(spark, monkeypatch):
    rnd = random.Random(8)
    base = prose(rnd, 200).split()
    rows = []
    for i in range(60):
        w = list(base)
        w[rnd.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(w), "s"))
    by_row = ngrams.jaccard_classes(table(spark, rows))
    monkeypatch.setattr(common, "CHUNK", 16)
    few_rows = ngrams.jaccard_classes(table(spark, rows))
    monkeypatch.setattr(common, "MOST_WEIGHT", 1000)  # five documents of 196 n-grams
    few_grams = ngrams.jaccard_classes(table(spark, rows))
    for got in (by_row, few_rows, few_grams):
        assert {(r.class_id, r.n_links) for r in got.collect()} == {(0, 59)}


def test_common_counts(monkeypatch):
    rnd = random.Random(12)
    sets = [set(rnd.sample(range(200), rnd.randrange(1, 120))) for _ in range(40)] + [{1000 + i} for i in range(5)]
    want = [[len(x & y) if x is not y else 0 for y in sets] for x in sets]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    for listed in (ngrams.LISTED, 1):
        monkeypatch.setattr(ngrams, "LISTED", listed)
        got = ngrams.common_counts(arrays)
        np.fill_diagonal(got, 0)
        assert got.tolist() == want


@pytest.mark.parametrize("most", [substrings.GROUP_BYTES, 2000, 1])
def test_substrings(docs, most):
    seen, want = {}, {}
    for i, t in distinct_docs():
        w = WORD.findall(t)
        gone = set()
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            if seen.setdefault(g, i) != i:
                gone |= set(range(k, k + 50))
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    out = substrings.remove_repeats(docs, group_bytes=most)
    assert out.count() == docs.count() and by_id(out, "n_words", "n_removed", "kept_sha256") == want
    assert want[31][1] >= 60 and substrings.remove_repeats(docs.limit(0)).count() == 0


def test_subtree():
    """Order, common prefixes and nodes against sorted tuples."""
    rnd = random.Random(13)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 60))) for _ in range(30)]
    texts += texts[:3]
    w = common.Words(texts)
    tuples = {int(w.first[i]) + k: tuple(t.split()[k:]) for i, t in enumerate(texts) for k in range(len(t.split()))}
    places = np.array(sorted(rnd.sample(sorted(tuples), 400)))
    tree, same = substrings.Subtree(w, places, 12), lambda a, b, n: a[:n] == b[:n] and len(a) >= n and len(b) >= n
    assert sorted(tree.order.tolist()) == places.tolist()
    for x, y, n in zip(tree.order[:-1].tolist(), tree.order[1:].tolist(), tree.common[1:].tolist()):
        real = next((k for k, (a, b) in enumerate(zip(tuples[x], tuples[y])) if a != b), min(len(tuples[x]), len(tuples[y])))
        assert n == real or n >= 16 and real >= n
    node = dict(zip(tree.order.tolist(), tree.nodes(12).tolist()))
    for x in places[:80].tolist():
        for y in places.tolist():
            if x != y:
                assert (node[x] == node[y]) == same(tuples[x], tuples[y], 12)


def test_substrings_without_order(spark):
    t = prose(random.Random(4), 70)
    out = substrings.remove_repeats(table(spark, [(None, t, "s"), (5, t, "s"), (5, t + " x", "s"), (6, t, "s")])).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in out) == [("5", 70, 0), ("5", 71, 0), ("6", 70, 70), ("None", 70, 0)]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 64))
    rows, k = [], 0
    for c in range(40):
        for s in (0, 0.05, 0.1, 0.2):
            rows.append((k, (base[c] + s * rng.standard_normal(64)).astype(np.float32).tolist(), c % 3))
            k += 1
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 1), (502, None, 1), (503, [0.0] * 64, 1), (504, [float("nan")] * 64, 1), (505, rows[0][1], None), (506, [1.0, 2.0], 0), (507, [2.0, 4.0], 0), (508, [], 0), (509, [1.0, None], 0), rows[0]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("band", "key", "dim", "rep")})
    links, vec = collections.defaultdict(set), {i: (np.array(v, float), y) for i, v, y in rows if v and None not in v and np.isfinite(v).all() and np.any(v) and y is not None}
    for x, (v, y) in vec.items():
        for z, (w, u) in vec.items():
            if x != z and y == u and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[x].add(z)
    got = {r.vec_id: r for r in vectors.vector_classes(df).collect()}
    assert len(got) == len({r[0] for r in rows})
    for i, r in got.items():
        group, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        assert (r.n_links, r.component_id, r.kept) == (len(links[i]), min(group), min(group) == i)
    assert vectors.vector_classes(df.limit(0)).count() == 0


def test_vectors_of_extreme_size(spark):
    """Squares that overflow or vanish change no link."""
    rnd = np.random.default_rng(6)
    base = [rnd.standard_normal(12) for _ in range(5)]
    sizes = [1.0, 1e200, 1e-200, 3e307, 1e-300, 2.0**-1020, 0.5]
    rows = [(100 * k + j, (b + rnd.standard_normal(12) * 0.01 * (j % 2)) / np.abs(b).max() * 0.5 * s, 0) for k, b in enumerate(base) for j, s in enumerate(sizes)]
    rows += [(900, np.array([1e200, 1e200, 1e200, 0]), 1), (901, np.array([1.0001e200, 1e200, 1e200, 0]), 1), (902, np.array([1e-200, 1e-200, 1e-200, 0]), 1), (903, np.array([5e-324, 5e-324, 5e-324, 0]), 1)]
    df = spark.createDataFrame([(i, x.tolist(), y) for i, x, y in rows], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.vector_classes(df).collect()}
    unit = {i: (x / np.abs(x).max()) / np.linalg.norm(x / np.abs(x).max()) for i, x, _ in rows}
    for i, _, y in rows:
        near = [j for j, _, z in rows if y == z and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.98]
        assert got[i] == (len(near) - 1, min(near))


def test_estimates_are_unbiased():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3, 70))
    x[2] = x[0] + 0.1 * rng.standard_normal(70)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    guesses, inside, i, j = [], 0, np.array([0, 0]), np.array([1, 2])
    for seed in range(400):
        codes = vectors.encode(x, vectors.rotation(70, seed), seed)
        guesses.append(codes.estimate(i, j))
        inside += guesses[-1][1] >= codes.least(i, j, float(x[0] @ x[2]))[1]
        on = codes.bits.view(np.uint8).size
        assert on == 3 * 16 and codes.planes.shape == (3, vectors.LEVELS, 2)
    assert np.mean(guesses, axis=0) == pytest.approx([x[0] @ x[1], x[0] @ x[2]], abs=0.02) and inside >= 398


def test_vector_blocks(spark, monkeypatch):
    """One large group of near copies in many small blocks, all of whose pairs must be met once."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal(32)
    rows = [(i, (base + (0.02 if i < 70 else 0.15) * rng.standard_normal(32)).tolist(), 1) for i in range(90)]
    monkeypatch.setattr(common, "CHUNK", 8)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.vector_classes(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    linked = v @ v.T >= 0.98
    assert {i: n for i, (n, _) in got.items()} == {i: int(linked[i].sum()) - 1 for i in range(90)}
    assert {c for i, (_, c) in got.items() if i < 70} == {0}


def test_block_pairs():
    rnd = random.Random(11)
    bounds, same, side, want = [0], [], [], set()
    for _ in range(40):
        n, one = rnd.randrange(1, 9), rnd.random() < 0.5
        sides = [0] * n if one else sorted(rnd.randrange(2) for _ in range(n))
        a = bounds[-1]
        want |= {(a + i, a + j) for i in range(n) for j in range(i + 1, n) if one or sides[i] != sides[j]}
        bounds.append(a + n)
        same += [one] * n
        side += sides
    for most in (1, 7, 1000):
        got = [p for i, j in common.block_pairs(np.array(bounds), np.array(same), np.array(side), most) for p in zip(i.tolist(), j.tolist())]
        assert len(got) == len(set(got)) and set(got) == want


def test_toxicity(spark):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        sentences = [prose(rnd, 8, 60) for _ in range(6)]
        toxic = i % 4 == 0
        if toxic:
            sentences[rnd.randrange(6)] += f" vile{rnd.choice(['a', 'ish', 'ness'])}"
        rows.append((i, ". ".join(sentences), "s"))
        labels.append((i, int(toxic)))
    df = table(spark, [*rows, (900, None, "s"), (901, "", None), (None, "fine words", "s"), rows[0]])
    known = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1), (5, None), (1, 0)], "doc_id bigint, toxic int")
    out = toxicity.score_toxicity(df, toxicity.fit_toxicity(df, known)).collect()
    assert len(out) == 404
    by = {r.doc_id: r for r in out}
    wrong = [i for i, y in labels if (by[i].score >= 0.7) != bool(y)]
    assert not wrong and by[900].score == by[901].score == 0.0
    model = toxicity.fit_toxicity(df, known)
    for r in out:  # the noisy-or once more, sentence by sentence from the weights
        p, spans = [], []
        for m in re.finditer(r"[^.!?\n]+", r.text or ""):
            found = {f for w in re.findall(r"[^\W\d_]+", m[0].lower()) for f in [w, *(w[:n] + "*" for n in range(3, 9) if len(w) > n)] if f in model.known}
            q = 1 / (1 + np.exp(-(model.bias + sum(model.weights[model.known[f]] for f in found))))
            p += [q] if found else []
            spans += [(m.start(), m.end(), q)] if found and q >= 0.5 else []
        leak = 1 / (1 + np.exp(-model.bias)) if re.search(r"[^.!?\n]", r.text or "") else 0
        assert r.score == pytest.approx(1 - (1 - leak) * np.prod([1 - q for q in p]), abs=1e-9)
        assert [tuple(s) for s in r.offending] == [(a, b, pytest.approx(q)) for a, b, q in spans]
    long = model.score(". ".join(["fine words"] * 100_000), toxicity._Memo(model.known))[0]
    assert long < 0.5
    spans = by[0].offending
    assert len(spans) == 1 and "vile" in rows[0][1][spans[0]["start"] : spans[0]["end"]]
    empty = toxicity.fit_toxicity(df.limit(0), known)
    assert toxicity.score_toxicity(df, empty).agg(F.max("score")).first()[0] < 1e-6
    assert toxicity.score_toxicity(df.limit(0), empty).count() == 0
