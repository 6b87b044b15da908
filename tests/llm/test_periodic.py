"""Periodic runs against a search of all lags."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from colectivo.llm import periodic, queries


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def brute(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and w[e] == w[e + q]:
                e += 1
            part = w[i : e + q]
            if len(part) >= max(24, 3 * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((i, len(part), q))
            i = e
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone).decode()


def texts():
    rng = random.Random(4)
    out = [None, "", " \t\n ", "one", "a " * 23, "a " * 24, "a " * 5000, "\x0ba\x0c" * 30, "é 😀 " * 40, "a b " * 30]
    for _ in range(150):  # few words, many runs of all kinds beside and within each other
        out.append(" ".join(rng.choice("ab" if rng.random() < 0.5 else "abc") for _ in range(rng.randrange(120))))
    for q in (1, 2, 7, 8, 9, 15, 16, 17, 18, 31, 32, 33, 64, 65, 100):
        unit = [f"w{rng.randrange(3 * q)}" for _ in range(q)]
        for length in (max(24, 3 * q) - 1, max(24, 3 * q), 5 * q + 24):
            body = (unit * 50)[:length]
            out.append(" ".join(["x"] + body + ["y"] + body[::-1]))
    inner = (["a", "b"] * 20 + ["c"]) * 4  # a run whose period holds runs
    out += [" ".join(inner), " ".join(inner[:-3] + inner), "\n".join(inner)]
    fib, last = "a", "b"
    while len(fib) < 700:
        fib, last = fib + last, fib
    out.append(" ".join(fib))
    return out + out[:9]


@pytest.mark.parametrize("chunk", [200, 1 << 21])
def test_equals_all_lags(spark, monkeypatch, chunk):
    monkeypatch.setattr(periodic, "CHUNK", chunk)
    rows = texts()
    df = spark.createDataFrame([(i, t, "r", "c", 5) for i, t in enumerate(rows)], "doc_id long, text string, row string, collapsed string, n_words int")
    out = periodic.collapse_runs(df)
    assert out.columns == ["doc_id", "row", "n_words", "runs", "collapsed"]
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()}
    for i, t in enumerate(rows):
        w = words_of(t)
        assert got[i] == (len(w), brute(w), collapsed(w, brute(w))), t
    assert sum(len(g[1]) for g in got.values()) > 100
    assert periodic.collapse_runs(df.limit(0)).count() == 0


def test_contract_query(spark):
    """The digest columns of the query over the whole small table, with every tenth document made periodic."""
    sf_dir = "/root/testdata/sf0.001"
    got, planted = {r.doc_id: r for r in queries.op13_runs(spark, sf_dir).collect()}, 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") < 4000).collect():
        w, h = words_of(r.text), zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        lines = "".join("%d,%d,%d\n" % x for x in runs)
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
        row = got[r.doc_id]
        assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == want
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert planted > 5
