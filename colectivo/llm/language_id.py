"""Language of a text by cross-parsing it against labelled text of each language."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_chunks

#: Bounds of the fitted sample: texts per language, characters of each, symbols of all automata.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_SYMBOLS = 64, 3000, 240_000
#: Letters told apart (the most frequent of the sample), symbols between restarts of a parse, bytes parsed at once.
ALPHABET, SEGMENT, CHUNK_BYTES = 250, 256, 2 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the least automaton that accepts every substring of ``codes``; state 0 is the start."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return step


class Parser:
    """Counts the phrases of texts in every language's sample.

    A phrase is the longest match of the rest of the text in the sample, or one
    symbol that the sample lacks. Symbols are lower-case letters and one blank
    for each run of anything else; a parse starts anew every 256 symbols, so
    that all pieces of a batch can take their next step together.
    """

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        points = {k: _points(v) for k, v in samples.items()}
        found, n = np.unique(np.concatenate([p[_letters()[p]] for p in points.values()] or [np.zeros(0, np.uint32)]), return_counts=True)
        known = np.sort(found[np.argsort(-n, kind="stable")[:ALPHABET]])
        self.symbol = np.where(_letters(), len(known) + 1, 0).astype(np.uint8)
        self.symbol[known] = np.arange(1, len(known) + 1)
        self.pad, self.width = len(known) + 2, len(known) + 3
        self.tables, self.logs = [], []
        for k in self.langs:
            codes = self.codes(points[k])
            self.tables.append(self._table(codes.tolist()))
            self.logs.append(np.log2(max(2, len(codes))))

    def codes(self, points: np.ndarray) -> np.ndarray:
        s = self.symbol[points]
        return s[(s != 0) | np.concatenate([[True], s[:-1] != 0])[: len(s)]]

    def _table(self, codes: list[int]) -> np.ndarray:
        """Next state * 4 + phrases that end, for each state and symbol."""
        step = suffix_automaton(codes)
        table = np.full((len(step), self.width), -1, np.int32)
        sizes = np.fromiter(map(len, step), np.int64, len(step))
        rows = np.repeat(np.arange(len(step)), sizes)
        table[rows, np.fromiter((c for d in step for c in d), np.int64, len(rows))] = np.fromiter((t for d in step for t in d.values()), np.int64, len(rows))
        again = np.where(table[0] < 0, 1, table[0] * 4)  # the symbol read anew from the start
        ended = (np.arange(len(step)) > 0).astype(np.int32)[:, None]
        out = np.where(table < 0, again[None, :] + ended, table * 4).astype(np.int32)
        out[:, self.pad] = np.arange(len(step)) * 4
        return out.ravel()

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each text by language (texts x languages), symbols and letters of each text."""
        codes = [self.codes(_points(t)) for t in texts]
        size = np.fromiter(map(len, codes), np.int64, len(codes))
        letters = np.fromiter((np.count_nonzero(c) for c in codes), np.int64, len(codes))
        pieces = -(-size // SEGMENT)
        lanes = np.full((int(pieces.sum()), SEGMENT), self.pad, np.uint8)
        starts = np.cumsum(pieces) - pieces
        flat = lanes.reshape(-1)
        for c, at in zip(codes, starts.tolist(), strict=True):
            flat[at * SEGMENT : at * SEGMENT + len(c)] = c
        lanes = np.ascontiguousarray(lanes.T).astype(np.int32)
        owner = np.repeat(np.arange(len(texts)), pieces)
        out = np.zeros((len(texts), len(self.langs)))
        for j, table in enumerate(self.tables):
            state = np.zeros(lanes.shape[1], np.int32)
            count = np.zeros(lanes.shape[1], np.int32)
            for column in lanes:
                v = table[state * self.width + column]
                count += v & 3
                state = v >> 2
            out[:, j] = np.bincount(owner, weights=count + (state > 0), minlength=len(texts))
        return out, size, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        n, size, letters = self.phrases(texts)
        cost = n * np.asarray(self.logs)[None, :] / np.maximum(size, 1)[:, None]
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = cost.argmin(1)
        ranked = np.sort(cost, 1)
        score = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-12) if len(self.langs) > 1 else np.ones(len(texts))
        score = np.where(letters > 0, np.clip(score, 0, 1), 0.0)
        return [self.langs[b] if k else "und" for b, k in zip(best.tolist(), letters.tolist(), strict=True)], score


_PARSERS: dict[tuple, Parser] = {}


def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    if samples not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[samples] = Parser(dict(samples))
    return _PARSERS[samples]


def learn(rows: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[tuple[str, str], ...]:
    """Language and sample text of every language of ``rows``.

    The bound is fixed: of each language at most 64 texts (those with the least
    hash of their id) and 3 000 characters of each, and the samples of all
    languages share 240 000 symbols. Spark ranks within tasks before the
    shuffle, so a common language sends 64 rows a task.
    """
    narrow = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.lit("sample"), F.col(id_col).cast("string")).alias("h"), F.substring(text_col, 1, SAMPLE_CHARS).alias("text")
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    taken = narrow.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_TEXTS).drop("h")
    texts: dict[str, list[str]] = {}
    for r in sorted(taken.collect(), key=lambda r: (r["lang"], r["rank"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    most = SAMPLE_SYMBOLS // max(1, len(texts))
    return tuple((k, " ".join(v)[:most]) for k, v in sorted(texts.items()))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` of every row, from whole texts.

    The language is the one with the fewest phrases, each weighed by the
    logarithm of its sample's length; ties go to the smaller name. The score
    is 1 less the ratio to the second best (1 if there is one language only).
    A text that is null, empty or without letters is ``und`` with score 0, and
    so is every text when nothing was learned. Null ids and repeated rows are
    kept; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples)
        for batch in text_chunks(batches, "text", CHUNK_BYTES):
            lang, score = parser.predict(batch.column(1).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """Rows kept from learning: crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
