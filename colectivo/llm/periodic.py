"""Periodic runs of words within a document, found by seeds that are extended along their diagonal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, text_chunks, unpacked

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of a seed for the smallest periods: a run of 24 words and three periods overlaps itself by 16 words or more.
SEED = 16
#: Bytes of text that are searched together; a longer text is searched alone.
CHUNK = 2 << 20


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word of texts that end at ``ends``, and the text of each (by number)."""
    inside = np.ones(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    opens, closes = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    edges = np.unique(ends[(ends > 0) & (ends < len(data))])
    edges = edges[inside[edges] & inside[edges + 1]]  # a word that reaches its text's end beside one that begins the next
    opens[edges] = closes[edges] = True
    first = np.flatnonzero(opens)
    return first, np.flatnonzero(closes), np.searchsorted(ends, first, side="right")


def _named(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for every word, equal for equal words only."""
    if not len(first):
        return np.zeros(0, dtype=np.int64)
    cuts = np.empty(2 * len(first) + 1, dtype=np.int64)
    cuts[0:-1:2], cuts[1::2] = first, end
    cuts[-1] = cuts[-2]
    cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(first), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    return np.asarray(cells.take(pa.array(np.arange(0, 2 * len(first), 2))).dictionary_encode().indices).astype(np.int64)


def _repeating(a: np.ndarray, b: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places ``at``, those whose (a, b) recurs within their text, in order, and numbers of these pairs."""
    order = np.lexsort((at, b, a, doc))
    same = np.empty(len(at) + 1, dtype=bool)
    same[0] = same[-1] = False
    same[1:-1] = (np.diff(a[order]) == 0) & (np.diff(b[order]) == 0) & (np.diff(doc[order]) == 0)
    name = np.cumsum(~same[:-1])
    twice = same[:-1] | same[1:]
    back = np.argsort(order[twice])
    return at[order[twice]][back], name[twice][back]


def _furthest(word: np.ndarray, doc: np.ndarray, i: int, lag: int) -> tuple[int, int]:
    """The longest stretch around ``i`` whose words equal the words ``lag`` later in the same text."""
    low, high = int(np.searchsorted(doc, doc[i])), int(np.searchsorted(doc, doc[i], side="right")) - lag
    step, end = 64, i
    while end < high:
        stop = min(high, end + step)
        differs = word[end:stop] != word[end + lag : stop + lag]
        if differs.any():
            end += int(differs.argmax())
            break
        end, step = stop, 2 * step
    step, start = 64, i
    while start > low:
        stop = max(low, start - step)
        differs = (word[stop:start] != word[stop + lag : start + lag])[::-1]
        if differs.any():
            start -= int(differs.argmax())
            break
        start, step = stop, 2 * step
    return start, end


def runs(word: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all maximal runs of ``word``, numbers of words whose texts ``doc`` ascend.

    A run of smallest period q overlaps its own copy q words later by
    max(24, 3q) - q words or more. Periods come in classes, up to 16, 32, 64
    and so on, and for each class the grams of that guaranteed overlap (16,
    32, 64 … words, never fewer than the period) are indexed. Within a run the
    next occurrence of such a gram lies exactly one smallest period on, since
    two periods of a stretch as long as their sum have their common divisor as
    a period. So the pairs of an occurrence and the next one suffice, and all
    other pairs are never formed. A pair whose place lies before the furthest
    place covered at its lag belongs to a stretch that is known; any other is
    extended word by word both ways. Grams are numbered by doubling (a gram is
    the pair of its halves), which is exact; places whose gram doesn't recur
    in their text are left behind at each doubling.
    """
    found, size = [], 1
    at, name = _repeating(word, np.zeros_like(word), doc, np.arange(len(word)))
    while len(at):
        if size >= SEED:
            order = np.lexsort((at, name))
            i, lag = at[order][:-1], np.diff(at[order])
            paired = (np.diff(name[order]) == 0) & (lag <= size) & (lag > (size // 2 if size > SEED else 0))
            i, lag = i[paired], lag[paired]
            order = np.lexsort((i, lag))
            i, lag = i[order], lag[order]
            fresh = np.ones(len(i), dtype=bool)  # a seed right behind another one of its lag is covered by that one's stretch
            fresh[1:] = (np.diff(lag) != 0) | (np.diff(i) > 1)
            covered: dict[int, int] = {}
            for place, q in zip(i[fresh].tolist(), lag[fresh].tolist(), strict=True):
                if place < covered.get(q, 0):
                    continue
                start, end = _furthest(word, doc, place, q)
                covered[q] = end
                if end - start + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
                    found.append((start, end - start + q, q))
        slot = np.searchsorted(at, at + size)
        slot[slot == len(at)] = 0
        met = (at[slot] == at + size) & (doc[at[slot]] == doc[at])
        at, name = _repeating(name[met], name[slot[met]], doc[at[met]], at[met])
        size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def _kept_text(data: np.ndarray, ends: np.ndarray, first: np.ndarray, end: np.ndarray, doc: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by single spaces."""
    first, end, doc = first[keep], end[keep], doc[keep]
    last = np.ones(len(first), dtype=bool)
    last[:-1] = np.diff(doc) != 0
    size = end - first + ~last
    out = np.full(int(size.sum()), 32, dtype=np.uint8)
    to = np.cumsum(size) - size
    shift = np.repeat(first - to, end - first)
    places = np.arange(len(shift)) + np.repeat(to - (np.cumsum(end - first) - (end - first)), end - first)
    out[places] = data[places + shift]
    by_doc = np.zeros(len(ends), dtype=np.int64)
    np.add.at(by_doc, doc, size)
    cuts = np.concatenate([[0], np.cumsum(by_doc)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(cuts), pa.py_buffer(out)).cast(pa.string())


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in text_chunks(batches, "text", CHUNK):
        text = batch.column(1).cast(pa.large_string()).fill_null("")
        cuts = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        raw = text.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[cuts[0] : cuts[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
        ends = cuts[1:] - cuts[0]
        first, end, doc = _words(data, ends)
        found = runs(_named(data, first, end), doc)
        n_words = np.bincount(doc, minlength=len(text))
        base = np.cumsum(n_words) - n_words
        change = np.zeros(len(first) + 1, dtype=np.int64)
        rows = [[] for _ in range(len(text))]
        for start, length, period in found:
            change[start + period] += 1
            change[start + length] -= 1
            d = int(doc[start])
            rows[d].append({"start": start - int(base[d]), "length": length, "period": period})
        keep = np.cumsum(change[:-1]) == 0
        collapsed = _kept_text(data, ends, first, end, doc, keep)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(rows, type=kind), collapsed], names=["row", "n_words", "runs", "collapsed"])


def collapse_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text, plus ``n_words, runs, collapsed``.

    Words are stretches of bytes other than blank and 0x09 to 0x0D. A run is a
    stretch of consecutive words with smallest period q (words q apart are
    equal), at least 24 words and three periods long, that no neighbouring
    word extends. ``runs`` lists ``start, length, period`` by start, then
    period, ``collapsed`` holds the words that no run contains behind its
    first q words, joined by blanks. A null text counts as empty: no words, no
    runs, an empty ``collapsed``. Equal rows get equal results, each its own.
    Columns named like a result are replaced; ids play no part, so null and
    repeated ids are as good as others.

    Documents never meet, so nothing is shuffled: texts go to Python once, in
    Arrow batches that are searched some megabytes at a time (a longer text by
    itself), as ``runs`` says. Time grows with words times the doublings that
    repeat, memory with the longest text.
    """
    taken = (text_col, "n_words", "runs", "collapsed")
    rows = docs.select(packed(docs, *taken).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    made = rows.mapInArrow(_search, f"row {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return made.select(*unpacked("row", docs, *taken), "n_words", "runs", "collapsed")
