"""Periodic runs, the filter audit and line dedup against brute force, with nulls, empties, repeats, long texts and clashing columns."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwise.llm import filter_audit, line_dedup, periodic_runs, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, runs string, n_lines string, shard string, part string"


@pytest.fixture(scope="module")
def docs(spark):
    line = "Shared line of many"
    texts = [None, "", "   ", "one", "a a a a a a", "x " + "b c " * 4, "a a " * 6, "\x1c \x1c a", "ÄÄ ää\n" + line, " ".join("w%d" % (i % 977) for i in range(30_000)), "Zz\n\n\nZz\n"]
    texts += [f"{line.upper() if i % 2 else line}  \n\ttext {i}\n{line}\r" for i in range(12)]
    texts += ["tie a a a a a a z b b b b b b", "a b " * 9 + "a", "AB " * 260, "$ " + "word " * 10]
    rows = [(i if i != 5 else None, t, None if i % 4 == 0 else f"s{i % 3}", "r", "n", "x", "p") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "one", "s1", "r", "n", "x", "p")]
    return spark.createDataFrame(rows, DOCS)


def against_sql(sql, **tables):
    con = duckdb.connect()
    for k, v in tables.items():
        con.register(k, v.toPandas()) if not isinstance(v, str) else con.execute(f"create view {k} as select * from read_parquet('{v}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return [dict(zip(names, r, strict=True)) for r in found.fetchall()]


def same(got, want):
    key = lambda r: str(sorted((k, str(v)) for k, v in r.items()))
    return sorted(map(key, (r.asDict() for r in got))) == sorted(map(key, want)) and len(want) > 0


def brute_runs(w):
    """Every period: maximal stretches whose words agree with those one period on; the least period of an interval stays."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in out.items())


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_runs_of_random_words():
    draw = random.Random(1)
    for _ in range(300):
        texts = []
        for _ in range(draw.randint(1, 4)):
            w = [draw.choice("abcde"[: draw.choice((1, 2, 3, 5))]) for _ in range(draw.randint(0, 50))]
            at = draw.randint(0, len(w))
            w[at:at] = [draw.choice("abc") for _ in range(draw.randint(1, 6))] * draw.randint(0, 8)
            texts.append(w)
        words, ids, bounds = periodic_runs.interned([" ".join(w).encode() for w in texts])
        assert words == [[x.encode() for x in w] for w in texts]
        assert periodic_runs.runs_of(ids, bounds) == [brute_runs(w) for w in texts]


def test_z_function():
    assert periodic_runs.z_function(list(b"aabaab")) == [6, 1, 0, 3, 1, 0] and periodic_runs.z_function([]) == []


def test_runs_on_documents(spark):
    got = periodic_runs.op11_periodic_runs(spark, SF)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted(brute_row(r.doc_id, r.text) for r in rows)
    assert got.columns == names and sorted(tuple(r) for r in got.collect()) == want
    assert sum(r[1] for r in want) > 20


def test_runs_edges(spark, docs):
    got = periodic_runs.collapse_runs(docs)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "shard", "part", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        runs = brute_runs(w) if len(w) < 1000 else [(0, len(w), 977)]
        assert [tuple(x) for x in r.runs] == runs
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in drop)
    assert periodic_runs.collapse_runs(docs.limit(0)).count() == 0
    best = {r.doc_id: r.best for r in got.select("doc_id", periodic_runs.strongest(F.col("runs")).alias("best")).collect()}
    assert tuple(best[23]) == (1, 6, 1) and best[3] is None and tuple(best[24]) == (0, 19, 2)


def test_matrices_against_orders():
    made = filter_audit.incidence()
    assert all(m.shape == (32, 600) for m in made.values())
    for o, order in enumerate(itertools.permutations(range(5))):
        for mask in range(32):
            gone = False
            for step, f in enumerate(order):
                fails, at = bool(mask >> f & 1), (mask, 5 * o + step)
                assert made["removed"][at] == (fails and not gone) and made["redundant"][at] == (fails and gone) and made["unique"][at] == (mask == 1 << f)
                gone |= fails
                assert made["kept"][at] == (not gone)


@pytest.mark.parametrize("name,sql", [("op12_filter_audit", filter_audit.OP12_SQL), ("op13_line_dedup", line_dedup.OP13_SQL)])
def test_matches_sql(spark, name, sql):
    views = {t: f"{SF}/{t}.parquet" for t in ("documents", "labels")}
    assert same(queries.queries()[name](spark, SF).collect(), against_sql(sql, **views))


def test_filter_audit_edges(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 1), (4, 1, 0), (12, 1, 1), (13, None, None), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.outcomes(filter_audit.histograms(docs, labels))
    want = against_sql(filter_audit.OP12_SQL, documents=docs, labels=labels)
    assert same(got.collect(), want) and {r["part"] for r in want} == {"", "s0", "s1", "s2"}
    assert sum(r["unique_fails"] for r in want) > 0 and sum(r["redundant"] for r in want) > 0
    assert filter_audit.outcomes(filter_audit.histograms(docs.limit(0), labels.limit(0))).count() == 0


def test_filter_copies_of_repeated_rows(spark):
    """Rows alike in id and text do not fail E for one another; a null id neither fails nor makes a copy."""
    rows = [(3, "t", "a"), (3, "t", "a"), (2, "t", "b"), (2, "t", "a"), (None, "t", "a"), (None, "u", "a"), (9, "u", "a")]
    got = filter_audit.histograms(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {(r.part, r.mask >> 4): r.docs for r in got.collect()} == {("a", 0): 4, ("a", 1): 2, ("b", 0): 1}


def brute_lines(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen = collections.Counter(k for t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < least]
        out.append((t, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [1 << 20, -1])
@pytest.mark.parametrize("least", [2, 10, 300])
def test_line_dedup_near_and_far(spark, docs, monkeypatch, bound, least):
    monkeypatch.setattr(line_dedup, "INDEX_BYTES", bound)
    monkeypatch.setattr(line_dedup, "SHARD", 16)
    given = docs.unionByName(docs) if least == 2 else docs
    got = line_dedup.drop_shared_lines(given, least=least)
    assert got.columns == ["doc_id", "text", "source", "runs", "shard", "part", "n_lines", "n_dropped", "kept_text"]
    rows = got.collect()
    want = brute_lines([r.text for r in given.collect()], least)
    assert sorted(((r.text, r.n_lines, r.n_dropped, r.kept_text) for r in rows), key=str) == want
    assert (sum(r[2] for r in want) > 0) == (least < 300)
    assert line_dedup.drop_shared_lines(docs.limit(0)).count() == 0


def test_line_index_is_minimal_and_exact():
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(0, 1 << 63, (300_000, 2), dtype=np.int64).view(np.uint64), axis=0)
    n = np.where(np.arange(len(keys)) % 7 == 0, draw.integers(10, 400, len(keys)), draw.integers(1, 10, len(keys)))
    made = line_dedup.Shard.build(keys[:, 0], keys[:, 1], n, 10)
    again = line_dedup.Shard.read(made.parts())
    own = n >= 10
    assert sorted(made.number(keys[own, 0], keys[own, 1]).tolist()) == list(range(own.sum()))
    assert made.rare and set(made.rare.values()) <= set(range(1, 10))
    for shard in (made, again):
        got = shard.probe(keys[:, 0], keys[:, 1])
        assert (got[own] == np.minimum(n[own], 255)).all() and (got[~own] < 10).all()
    assert sum(map(len, made.parts())) < 4 * own.sum()
    wide = line_dedup.Shard.read(line_dedup.Shard.build(keys[:, 0], keys[:, 1], n, 300).parts())
    got = wide.probe(keys[:, 0], keys[:, 1])
    assert (got[n >= 300] == n[n >= 300]).all() and (got[n < 300] < 300).all()
    none = line_dedup.Shard.read(line_dedup.Shard.build(keys[:5, 0], keys[:5, 1], n[:5] * 0 + 1, 10).parts())
    assert (none.probe(keys[:9, 0], keys[:9, 1]) == 0).all()


def test_check_table_runs():
    """Documents of the larger check table, if it is there, by brute force: planted runs and natural ones."""
    path = "/root/testdata/check_s/documents.parquet"
    if not os.path.isdir(path):
        pytest.skip("no check tables")
    rows = duckdb.sql(f"select text from read_parquet('{path}/*.parquet') where length(text) between 2000 and 6000 and doc_id % 199 = 0 limit 60").fetchall()
    words, ids, bounds = periodic_runs.interned([r[0].encode() for r in rows])
    assert periodic_runs.runs_of(ids, bounds) == [brute_runs(w) for w in words]
