"""The pipeline's stages, each on the whole of its own input, against plain Python."""

from __future__ import annotations

import os

import pytest
import sentencepiece

import corpus_pipeline
from colectivo.llm import mixing
from tests.llm.test_corpus import MODEL, brute_near

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stages"))
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(os.path.join(root, str(i)))
        after = spark.read.parquet(os.path.join(root, str(i)))
        out.append((docs, after, {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in after.collect()}))
        docs = after
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash", "mixing", "pieces"]
    assert all(after.columns == COLUMNS for _, after, _, _ in stages[:-1])


def test_toxic_documents_go(spark, stages):
    _, _, before, after = stages[0]
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i in before if toxic.get(i) == 0]
    assert sum(i in after for i in clean) >= 0.95 * len(clean)
    assert sum(i not in after for i, t in toxic.items() if t == 1) >= 1


def test_lines(stages):
    _, _, before, after = stages[1]
    seen = set()
    for i in sorted(before):
        lines, gone = before[i]["text"].split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            gone |= {p, p + 1, p + 2} if w in seen else set()
            seen.add(w)
        assert after[i]["text"] == "\n".join(x for p, x in enumerate(lines) if p not in gone)
        assert after[i]["n_chars"] == (len(after[i]["text"]) if gone else before[i]["n_chars"])


def test_near_copies(stages):
    _, _, before, after = stages[2]
    ids = sorted(before)
    found = brute_near([before[i]["text"] for i in ids], 5, 80)
    assert sorted(after) == [i for k, (i, (_, c)) in enumerate(zip(ids, found)) if c == k]


def test_mixing(stages):
    docs, _, before, after = stages[3]
    kept = {r["doc_id"] for r in mixing.mix(docs).where("kept").collect()}
    assert set(after) == kept and 0 < len(after) < len(before)
    assert all(after[i] == before[i] for i in after)


def test_pieces(stages):
    _, _, before, after = stages[4]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert set(before) == set(after)
    assert all(after[i]["piece_ids"] == sp.encode(before[i]["text"]) and after[i]["round_trip"] for i in after)
