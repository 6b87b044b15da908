"""Corpus operators against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from colectivo.llm import language_id, line_dedup, minhash, mixing, pieces, substrings, token_counts, toxicity, vectors

SCHEMA = "doc_id long, text string, lang string, source string, row string, n_removed string"
MODEL, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n\n", "x", "a  b", "İß ẞ ŉ é", "漢字 テスト 😀", "<|endoftext|> y", "▁ ▁▁x", "\x00 a\tb\r\n", "word " * 3000, "q" * 5000, "don't 'S é"]


def frame(spark, texts, **more):
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, "r", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, words=40):
    return " ".join(rng.choice(["ka", "lo", "mi", "re", "sun", "tor", "vel", "wex"]) + rng.choice("abcdefgh") for _ in range(n or words))


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# -- line dedup


def test_line_dedup(spark):
    rng = random.Random(1)
    block = ["one", "two", "three", "four"]
    texts = ["\n".join(rng.choice([block, block[:3], [f"l{rng.random()}"], ["one"]])[k] for _ in range(rng.randrange(9)) for k in [0]) for _ in range(10)]
    texts += ["\n".join(block + [str(i)] + block) for i in range(4)] + ODD
    seen, want = set(), {}
    for i, t in enumerate(texts):
        lines = t.split("\n") if t is not None else []
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        want[i] = (None if t is None else "\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone))
    out = line_dedup.dedup_lines(frame(spark, texts))
    assert out.columns == ["doc_id", "text", "lang", "source", "row", "n_lines", "n_removed"]
    assert {k: (r["text"], r["n_lines"], r["n_removed"]) for k, r in by_id(out).items()} == want


def test_line_dedup_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "x\na\nb\nc")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect())
    assert got == [("1", "", 3), ("1", "", 3), ("2", "x", 3), ("None", "a\nb\nc", 0)]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


# -- mixing


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(1, 60)), rng.choice(["en", "de", None]), rng.choice("aab"), "t" + rng.choice("12"), 9) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string, weight int")
    wanted = spark.createDataFrame([("a", 0.4), ("b", 0.6)], "source string, share double")
    out = mixing.mix(docs, targets={"source": wanted}, rounds=25).collect()
    mass = collections.Counter()
    for r in out:
        mass[r["source"]] += r["n_tokens"] * r["weight"]
        assert r["n_tokens"] == len(r["text"].split()) and 0 < r["keep_probability"] <= 1
    assert abs(mass["a"] / sum(mass.values()) - 0.4) < 1e-6
    again = {r["doc_id"]: r["kept"] for r in mixing.mix(docs, targets={"source": wanted}, rounds=25).collect()}
    assert again == {r["doc_id"]: r["kept"] for r in out}


def test_mixing_odd_rows(spark):
    out = by_id(mixing.mix(frame(spark, ODD)))
    assert len(out) == len(ODD) and out[0]["n_tokens"] == 0
    assert mixing.mix(frame(spark, ODD).limit(0)).count() == 0
    assert mixing.mix(frame(spark, [None, ""])).where("kept").count() == 2


def test_mixing_stray_cell(spark):
    rng = random.Random(13)
    rows = [(i, prose(rng, rng.randrange(5, 60)), rng.choice(["en", "en", "de"]), rng.choice("aaabbc")) for i in range(1500)]
    schema = "doc_id long, text string, lang string, source string"
    before = by_id(mixing.mix(spark.createDataFrame(rows, schema)))
    after = by_id(mixing.mix(spark.createDataFrame([*rows, (-1, "one stray row", "xx", "stray")], schema)))
    assert after[-1]["kept"] and after[-1]["keep_probability"] == 1
    assert sum(before[i]["kept"] != after[i]["kept"] for i in before) <= 0.01 * len(rows)
    for out in (before, after):
        tokens = sum(r["n_tokens"] for r in out.values())
        assert abs(sum(r["n_tokens"] * r["keep_probability"] for r in out.values()) / tokens - mixing.BUDGET) < 1e-6
        assert abs(sum(r["n_tokens"] for r in out.values() if r["kept"]) / tokens - mixing.BUDGET) < 0.05


def test_mixing_rates(spark):
    cells = spark.createDataFrame([(10.0, 40.0), (100.0, 2.0), (390.0, 1.0), (500.0, 0.5), (50.0, 0.0)], "base double, weight double")
    for budget in (0.01, 0.3, 0.8, 0.95, 1.0):
        out = mixing.keep_rates(cells, budget).collect()
        assert abs(sum(r["base"] * r["keep_probability"] for r in out) - min(1050 * budget, 1000)) < 1e-6
        c = [r["keep_probability"] / r["weight"] for r in out if r["weight"] and not r["clamped"]]
        assert not c or max(c) - min(c) < 1e-12


# -- vectors


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vector_rows(rng, n=300, dim=8):
    x = rng.standard_normal((n, dim))
    x[40:60] = x[40] + 0.02 * rng.standard_normal((20, dim))
    x[60:64] = x[60]
    rows = [(i, [float(v) for v in x[i]], i % 3 if i < 250 else None) for i in range(n)]
    return x, rows


def test_nearest_recall_and_scores(spark):
    x, rows = vector_rows(np.random.default_rng(3))
    odd = [(900, None, 1), (950, [0.0] * 8, 1), (901, [float("nan")] * 8, 1), (902, [1.0, None] + [0.0] * 6, 1), (1000, [1.0, 2.0], 1), (None, [1.0] * 8, 1)]
    docs = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    out = vectors.nearest(docs, F.expr("vec_id % 50 = 0")).collect()
    s = unit(x) @ unit(x).T
    np.fill_diagonal(s, -9)
    hits = 0
    for q in range(0, 300, 50):
        mine = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        for r in mine:
            assert abs(r["score"] - s[q, r["vec_id"]]) < 1e-12
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(np.argsort(-s[q], kind="stable")[:5].tolist()))
    assert hits >= 27 and {r["query_id"] for r in out} == set(range(0, 300, 50))
    few = vectors.nearest(docs.where("vec_id in (0, 1, 2)"), F.expr("vec_id % 50 = 0")).collect()
    assert len(few) == 2
    assert vectors.nearest(docs.limit(0), F.expr("vec_id % 50 = 0")).count() == 0


def test_near_vectors(spark):
    x, rows = vector_rows(np.random.default_rng(4))
    odd = [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("inf")] * 8, 1), (None, [1.0] * 8, 1)]
    docs = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = by_id(vectors.near_vectors(docs), "vec_id")
    label = np.array([i % 3 if i < 250 else -1 for i in range(300)])
    near = (unit(x) @ unit(x).T >= 0.98) & (label[:, None] == label[None]) & (label >= 0)
    np.fill_diagonal(near, False)
    comp = list(range(300))
    for _ in range(300):
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(300)]
    for i in range(300):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum(), comp[i], comp[i] == i), i
    assert (got[900]["n_links"], got[900]["component_id"]) == (0, 900) and len(got) == 304
    assert got[None]["kept"] and got[None]["component_id"] is None
    assert vectors.near_vectors(docs.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [16, 0])
def test_near_vectors_dense_label(spark, copies, monkeypatch):
    if not copies:  # sorted passes, over many partitions
        monkeypatch.setattr(vectors, "PAIR_ROWS", (4, 4))
    rng = np.random.default_rng(14)
    x = unit(rng.standard_normal(64) + 0.25 * rng.standard_normal((6000, 64)))
    for i in range(0, 600, 2):  # isolated pairs
        off = rng.standard_normal(64)
        off = unit((off - off @ x[i] * x[i])[None])[0]
        x[i + 1] = 0.982 * x[i] + np.sqrt(1 - 0.982**2) * off
    docs = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(8)
    near = (x @ x.T >= 0.98).sum(axis=1) - 1
    got = by_id(vectors.near_vectors(docs, copies=copies), "vec_id")
    found, there = sum(r["n_links"] for r in got.values()), near.sum()
    assert there >= 600 and (found == there if copies else 0.99 * there <= found <= there)


def test_near_vectors_whole_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PAIR_ROWS", (40, 40))
    monkeypatch.setattr(vectors, "WHOLE_BYTES", 40 * 8 * 16)
    monkeypatch.setattr(vectors, "TILE", 16)
    monkeypatch.setattr(vectors, "_planned", None)  # more than 16 blocks were planned on a sample before
    rng = np.random.default_rng(15)
    x = unit(rng.standard_normal(16) + 0.35 * rng.standard_normal((800, 16)))
    docs = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    near = x @ x.T >= 0.98
    comp = np.arange(len(x))
    while (low := np.where(near, comp[None], len(x)).min(1)).tolist() != comp.tolist():
        comp = low
    got = by_id(vectors.near_vectors(docs), "vec_id")
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(len(x))] == list(zip(near.sum(1) - 1, comp))
    assert near.sum() > len(x) + 100


# -- near-duplicate documents


def brute_near(texts, words, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    link = [[j for j in range(len(sets)) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in range(len(sets))]
    for _ in sets:
        comp = [min([comp[i], *(comp[j] for j in link[i])]) for i in range(len(sets))]
    return [(len(s), c) for s, c in zip(sets, comp)]


@pytest.mark.parametrize("words", [2, 5])
def test_minhash(spark, words):
    rng = random.Random(5)
    texts = list(ODD)
    for _ in range(8):
        base = prose(rng, 120).split()
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
    got = by_id(minhash.near_duplicates(frame(spark, texts), words=words))
    want = brute_near(texts, words, 80)
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == want
    kept = minhash.keep_one(frame(spark, texts), words=words)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, (_, c) in enumerate(want) if c == i]
    assert kept.columns == SCHEMA_COLUMNS


SCHEMA_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def test_minhash_odd_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "A b c"), (3, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, words=2).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("3", 3, True), ("None", None, True)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_block_links_finds_all():
    import pandas as pd

    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 60, 200)
    sets = [np.sort(np.where(rng.random(200) < 0.08, rng.integers(0, 1 << 60, 200), base)) for _ in range(20)]
    group = pd.DataFrame({"id": range(20), "comp": range(20), "stray": [k < 8 for k in range(20)], "s": sets})
    got = set(map(tuple, minhash.block_links(group, 80)[["a", "b"]].to_numpy().tolist()))
    want = {(i, j) for i in range(8) for j in range(8, 20) if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))}
    assert got == want and want


# -- toxicity


def toxic_rows(rng, n):
    rows, labels = [], []
    for i in range(n):
        bad, poor = rng.random() < 0.3, rng.random() < 0.3
        words = prose(rng, 30).split()
        for k in range(2 * bad):
            words[rng.randrange(30)] = rng.choice(["grub", "Grubby!", "zonk,"])
        if poor:
            words += ["click", "here"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), int(poor)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows(random.Random(7), 900)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, poor int").where("doc_id < 600")
    chain = toxicity.fit(docs, marks, ("poor", "toxic"))
    got = by_id(toxicity.predict(docs.withColumn("p_toxic", F.lit("clash")), chain))
    right = [got[i]["is_toxic"] == bool(t) and got[i]["is_poor"] == bool(p) for i, t, p in labels if i >= 600]
    assert sum(right) / len(right) > 0.97
    assert len(chain.models[1].given) == 1  # the later classifier reads the earlier probability


def test_toxicity_odd(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int, poor int")
    one = spark.createDataFrame([(3, 1, None), (3, 1, None), (None, 0, 1)], "doc_id long, toxic int, poor int")
    for labels in (none, one):
        chain = toxicity.fit(docs, labels, ("poor", "toxic"))
        assert toxicity.predict(docs, chain).count() == len(ODD)
    assert toxicity.predict(docs.limit(0), chain).count() == 0


def test_toxicity_learns_from_every_labelled_row(spark):
    docs = spark.range(26_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    marks = docs.select("doc_id", F.expr("int(doc_id % 977 = 0)").alias("toxic"))
    chain = toxicity.fit(docs, marks, ("toxic",))
    share = 27 / 26_000
    assert 1 / (1 + np.exp(-chain.models[0].bias)) == pytest.approx(share, rel=1e-6)


def test_toxicity_fit_is_the_optimum(spark):
    rows, labels = toxic_rows(random.Random(17), 700)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, poor int")
    model = toxicity.fit(docs, marks, ("toxic",)).models[0]
    owner, feature = toxicity._text_features(pa.array([t for _, t in rows]))
    x = np.zeros((len(rows), toxicity.FEATURES))
    x[owner, feature] = 1
    y = np.array([t for _, t, _ in labels], float)
    kept = np.flatnonzero((x.sum(0) >= 3) & (np.abs(x.T @ (y - y.mean())) > 0))  # fewer than SCREENED here
    x = np.column_stack([np.ones(len(y)), x[:, kept]])
    penalty = np.r_[0.0, np.full(len(kept), toxicity.PENALTY)]

    def objective(w):
        z = x @ w
        return (np.logaddexp(0, z) - y * z).mean() + penalty @ np.abs(w)

    w = ahead = np.zeros(x.shape[1])
    step, t = 4 / np.linalg.norm(x.T @ x / len(y), 2), 1.0
    for _ in range(6000):  # accelerated proximal gradients
        new = ahead - step * x.T @ (1 / (1 + np.exp(-x @ ahead)) - y) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (last - 1) / t * (new - w), new
    assert objective(np.r_[model.bias, model.dense()[kept]]) <= objective(w) * 1.001


# -- repeated strings


def brute_strings(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        hit = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                hit[p : p + 100] = True
            seen.add(b[p : p + 100])
        left = bytes(np.frombuffer(b, np.uint8)[~hit])
        runs = int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum()) if len(b) else 0
        out.append((len(b), int(hit.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


def test_substrings(spark, monkeypatch):
    rng = random.Random(8)
    parts = [prose(rng, n) for n in (20, 25, 40, 60)] + ["ab" * 90, "z" * 240, "é漢" * 60]
    texts = list(ODD) + [" ".join(rng.choice([*parts, prose(rng, 30)])[rng.randrange(40) :] for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    got = by_id(substrings.remove_repeats(frame(spark, texts)))
    assert [(got[i]["n_bytes"], got[i]["n_removed"], len(got[i]["spans"]), got[i]["kept_sha256"]) for i in range(len(texts))] == brute_strings(texts)


def test_substrings_odd_ids(spark):
    t = "0123456789" * 3 + "the quick brown fox jumps over the lazy dog and on it runs until the very end of this line of text" * 2
    docs = spark.createDataFrame([(2, t), (2, t), (None, t), (3, "x" + t)], "doc_id long, text string")
    want = brute_strings([t, t, "x" + t])
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substrings.remove_repeats(docs).collect())
    assert got == [("2", want[1][1]), ("2", want[1][1]), ("3", want[2][1]), ("None", want[0][1])]
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_long_text_is_cut_with_overlap(monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 700)
    rng = random.Random(9)
    text = prose(rng, 600)
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([text])], names=["k", "text"])
    found = []
    for raw, cuts, _, offset, own in substrings._pieces(batch):
        at, _ = substrings.marks(raw, cuts)
        found += [int(a + offset[0]) for a in at if own[0, 0] <= a < own[0, 1]]
    raw = np.frombuffer(text.encode(), np.uint8)
    assert sorted(found) == substrings.marks(raw, np.array([len(raw)]))[0].tolist()


# -- token counts, pieces


def sample_texts(n=300):
    rng = random.Random(10)
    table = __import__("pyarrow.parquet", fromlist=["read_table"]).read_table("/root/testdata/sf0.001/documents.parquet")
    return [*ODD, *(t for t in table["text"].to_pylist()[:n]), *(prose(rng, 50) for _ in range(20))]


def test_token_counts(spark):
    texts = sample_texts()
    tok = tokenizers.Tokenizer.from_file(BPE)
    got = by_id(token_counts.count_tokens(frame(spark, texts), BPE))
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048), repr(t)[:80]
    few = by_id(token_counts.count_tokens(frame(spark, texts[:60]), MODEL))
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert all(few[i]["n_tokens"] == len(sp.encode(texts[i] or "")) for i in range(60))
    assert token_counts.count_tokens(frame(spark, texts).limit(0), BPE).count() == 0


def test_token_counts_forget(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    tok = tokenizers.Tokenizer.from_file(BPE)
    texts = [t for t in sample_texts(40) if t]
    for t in texts:
        assert token_counts.text_lengths(BPE, pa.array([t]))[0] == len(tok.encode(t, add_special_tokens=False))


def test_pieces_match_library(spark):
    texts = sample_texts()
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = pieces.encode_texts(frame(spark, texts).withColumn("piece_ids", F.lit("clash")), MODEL)
    got = by_id(pieces.decode_texts(out, MODEL))
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert got[i]["piece_ids"] == ids, repr(t)[:80]
        assert got[i]["decoded"] == sp.decode(ids)
        assert got[i]["round_trip"] == (sp.decode(ids) == (t or ""))
    null = spark.createDataFrame([(1, None), (2, []), (3, [5, None, 262])], "doc_id long, piece_ids array<int>")
    assert [r["decoded"] for r in pieces.decode_texts(null, MODEL).sort("doc_id").collect()] == [None, "", sp.decode([5, 262])]
    assert out.limit(0).count() == 0


def test_stable_pairs_are_what_merges_leave():
    machine = pieces.transducer(MODEL)
    rng = random.Random(11)
    words = [p for p in machine.normal if p.isascii() and 1 < len(p) < 8]
    for _ in range(3000):
        a, b = rng.choice(words), rng.choice(words)
        left = [s for s, _, _ in machine.merges(a + b)]
        assert machine.stable(a, b) == (left == [a, b])


# -- language


def test_language_phrases_are_longest_matches():
    parser = language_id.Parser({"a": "the cat sat on the mat and the hat", "b": "die katze und der hund sitzen da"})
    rng = random.Random(12)
    for _ in range(60):
        text = "".join(rng.choice("thecasondiru xyz.é") for _ in range(rng.randrange(0, 80)))
        codes = parser.codes(language_id._points(text)).tolist()
        counts, size, letters = parser.phrases([text])
        assert size[0] == len(codes) and letters[0] == sum(c > 0 for c in codes)
        for j, sample in enumerate(["the cat sat on the mat and the hat", "die katze und der hund sitzen da"]):
            s, n, i = bytes(parser.codes(language_id._points(sample)).tolist()), 0, 0
            while i < len(codes):
                k = i
                while k < len(codes) and bytes(codes[i : k + 1]) in s:
                    k += 1
                n, i = n + 1, max(k, i + 1)
            assert counts[0, j] == n


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    samples = language_id.learn(docs.where(~language_id.held_out()), "doc_id", "text", "lang")
    got = by_id(language_id.identify(docs, samples))
    rows = docs.where(language_id.held_out()).collect()
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97
    odd = by_id(language_id.identify(frame(spark, ODD), samples))
    assert [odd[i]["lang_pred"] for i in range(4)] == ["und"] * 4 and odd[0]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.identify(docs.limit(0), samples).count() == 0
    nothing = language_id.learn(docs.limit(0), "doc_id", "text", "lang")
    assert {r["lang_pred"] for r in language_id.identify(frame(spark, ODD), nothing).collect()} == {"und"}
