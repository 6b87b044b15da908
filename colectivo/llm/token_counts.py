"""Token counts by batch encoding that returns lengths only."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import text_chunks

#: Bytes of text handled at once, and words whose lengths a worker remembers between batches.
BATCH_BYTES, REMEMBERED = 4 << 20, 600_000

_LOADED: dict[str, object] = {}
_KNOWN: dict[str, dict[str, int]] = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_padding()
            t.no_truncation()
            _LOADED[path] = t
    return _LOADED[path]


def _encoded(path: str, words: list[str]) -> np.ndarray:
    """Tokens of each word; only words not met lately are encoded, in one batch."""
    tok, known = _tokenizer(path), _KNOWN.setdefault(path, {})
    new = [w for w in words if w not in known]
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = words
    encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
    known.update(zip(new, map(len, encode(new, add_special_tokens=False)), strict=True))
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _word_lengths(path: str, words: pa.StringArray) -> np.ndarray:
    """Tokens of each word of ``words``.

    Case is folded (ASCII only) and closing punctuation after a letter is
    counted by itself: the tokenizer lowers case and parts letters from
    punctuation anyway. Words that may hold a special string are left alone.
    """
    bare = pc.ascii_rtrim(words, characters=".,;:!?")
    plain = pc.and_(pc.match_substring_regex(bare, r"\pL$"), pc.invert(pc.match_substring(words, "<|")))
    body = pc.if_else(plain, pc.ascii_lower(bare), words).dictionary_encode()
    cut = pc.and_(plain, pc.not_equal(words, bare))
    n = _encoded(path, body.dictionary.to_pylist())[body.indices.to_numpy()]
    rows = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
    if len(rows):
        tails = [w[len(b) :] for w, b in zip(words.take(rows).to_pylist(), bare.take(rows).to_pylist(), strict=True)]
        n[rows] += _encoded(path, tails)
    return n


def text_lengths(path: str, texts: pa.StringArray) -> np.ndarray:
    """Number of tokens of each text (no nulls).

    A tokenizer that drops white space never joins what a space or a line feed
    parts, and its special strings hold neither, so every text is split there
    and equal words of the batch are encoded once. For a .model file white
    space counts, and whole texts are encoded.
    """
    if path.endswith(".model"):
        return np.fromiter(map(len, _tokenizer(path).encode(texts.to_pylist(), num_threads=1)), np.int64, len(texts))
    parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    words = parts.flatten().dictionary_encode()
    n = _word_lengths(path, words.dictionary)[words.indices.to_numpy()]
    ends = np.cumsum(np.concatenate([[0], n]))
    cuts = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    return ends[cuts[1:]] - ends[cuts[:-1]]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every row of ``docs``, in the file order of its partitions.

    ``tokenizer`` is the path of a .json (tokenizers) or .model (sentencepiece)
    file that every executor can read. No begin, end or added tokens, no
    truncation, no padding. A null text counts as empty: 0 bytes, 0 tokens.
    Null ids are kept, repeated rows are counted each, other columns are not
    read. Arrow batches are cut by bytes, so each holds about four megabytes or
    a single text, and texts are split at spaces and line feeds, which no
    token of a tokenizer that drops white space crosses. The batch's distinct
    words are encoded together and only their lengths come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", BATCH_BYTES):
            column = batch.column(1).fill_null("")
            n_bytes = pc.binary_length(column).cast(pa.int64())
            n = text_lengths(tokenizer, column)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"]
            )

    narrow = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
