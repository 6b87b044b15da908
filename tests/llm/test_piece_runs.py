"""Long runs of one symbol through the merges, against the model's own library."""

from __future__ import annotations

import time

import public_tokenizers
import pyarrow as pa
import sentencepiece

from colectivo.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_blank_runs_are_whole_and_not_quadratic():
    machine, library = pieces.Transducer(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [" " * n for n in (1, 2, 3, 15, 16, 17, 100, 1001)] + ["a" + " " * 333 + "b", "x" * 700, "=" * 500, "ab" * 300]
    assert machine.encode(pa.array(texts)).to_pylist() == library.encode(texts, num_threads=1)
    begun = time.process_time()
    long = " " * 60_000 + "end"
    assert machine.encode(pa.array([long])).to_pylist() == library.encode([long], num_threads=1)
    assert time.process_time() - begun < 20


def test_text_column_left_out(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, None)], "doc_id long, text string, row string")
    kept, bare = pieces.encode_texts(docs, MODEL), pieces.encode_texts(docs, MODEL, keep_text=False)
    assert kept.columns == ["doc_id", "text", "row", "piece_ids", "round_trip"] and bare.columns == ["doc_id", "row", "piece_ids", "round_trip"]
    drop = lambda df: sorted((r.doc_id, r.row, r.piece_ids, r.round_trip) for r in df.collect())
    assert drop(kept) == drop(bare) and [r.text for r in kept.orderBy("doc_id").collect()] == ["a b", None]
