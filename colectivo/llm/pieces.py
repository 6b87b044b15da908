"""SentencePiece encoding and decoding as a weighted transducer over Arrow batches.

The transducer is the composition of three machines. The normaliser writes a
blank before the text and turns spaces into the blank mark. The piece machine
has one arc per vocabulary piece and, for a character without a piece, one arc
to its UTF-8 byte pieces. Its weights are those of the tropical semiring: for a
unigram model each piece costs its negative score. A BPE model is not a sum of
piece scores, so there a third machine weighs each pair of neighbours: 0 if the
merges would leave both as they are, infinite if they would not. A sequence
whose neighbours are all stable is exactly what the merges yield, so one path
of finite weight remains, and the shortest path is the library's encoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, packed, small_batches, text_chunks, unpacked, with_text

BLANK = "▁"
#: Bytes of text taken at once, longest unit that runs with others in step, slots that remember weighed pairs.
CHUNK_BYTES, STEP_CHARS, PAIR_SLOTS = 1 << 20, 40, 1 << 21
_INF = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if key & 7 == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Transducer:
    """A .model file compiled for encoding and decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        self.pieces, self.cost, kinds = [], [], []
        for number, value in model:
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.cost.append(-float(np.frombuffer(piece.get(2, b"\0\0\0\0"), np.float32)[0]))
                kinds.append(piece.get(3, 1))
        trainer = dict(_fields(next(v for n, v in model if n == 2)))
        normaliser = dict(_fields(next(v for n, v in model if n == 3)))
        self.bpe = trainer.get(3, 1) == 2
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1) or 4 in kinds or trainer.get(24):
            raise ValueError("only models with the identity normaliser, escaped blanks and no user-defined pieces are compiled")
        self.prefix = bool(normaliser.get(3, 1))
        self.normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 1}
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 6}
        self.unk = kinds.index(2)
        self.control = {i for i, k in enumerate(kinds) if k == 3}
        self.longest = max(map(len, self.normal))
        #: Pieces never reach over the start of a blank run, and a piece with two blanks is a run of blanks.
        if any(BLANK in p.lstrip(BLANK) or (p.count(BLANK) > 1 and p.strip(BLANK)) for p in self.normal):
            raise ValueError("pieces across words are not compiled")
        self.runs: dict[int, list[int]] = {}
        self.spines: dict[str, tuple[list, list]] = {}
        self._stable: dict[tuple[str, str], bool] = {}

    # -- weights of neighbours in a BPE model -------------------------------------------------

    def merges(self, text: str) -> list[tuple[str, str | None, str | None]]:
        """Symbols of ``text`` after all merges, each with the two parts it was last made of."""
        parts: list[tuple[str, str | None, str | None] | None] = [(c, None, None) for c in text]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < len(parts):
                left, right = parts[k][0], parts[after[k]][0]
                if (i := self.normal.get(left + right)) is not None:
                    heappush(heap, (self.cost[i], k, left, right))

        for k in range(len(parts)):
            offer(k)
        while heap:  # cheapest merge first, of equal ones the leftmost; offers whose parts have changed are stale
            _, k, left, right = heappop(heap)
            if parts[k] is None or parts[k][0] != left or after[k] >= len(parts) or parts[after[k]][0] != right:
                continue
            gone = after[k]
            parts[k], parts[gone], after[k] = (left + right, left, right), None, after[gone]
            if after[k] < len(parts):
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [part for part in parts if part is not None]

    def spine(self, token: str) -> tuple[list, list] | None:
        """Parts of a token along its left and right edge, each with the cost at which it is merged away.

        None for a piece that the merges never make.
        """
        if token not in self.spines:
            made = self.merges(token) if len(token) > 1 else [(token, None, None)]
            if len(made) > 1:
                self.spines[token] = None
            elif made[0][1] is None:
                self.spines[token] = ([(token, _INF)], [(token, _INF)])
            else:
                own, left, right = self.cost[self.normal[token]], self.spine(made[0][1]), self.spine(made[0][2])
                edge = lambda side: [*side[:-1], (side[-1][0], own), (token, _INF)]
                self.spines[token] = (edge(left[0]), edge(right[1]))
        return self.spines[token]

    def stable(self, a: str, b: str) -> bool:
        """True if merging ``a + b`` from characters ends in these two tokens.

        It does unless parts that meet at the border merge: that needs both to
        be there at once, and a merge that comes before those inside (of equal
        ones, the left comes first).
        """
        left, right = self.spine(a), self.spine(b)
        if left is None or right is None:
            return False
        born_x = -_INF
        for x, gone_x in left[1]:
            born_y = -_INF
            for y, gone_y in right[0]:
                if max(born_x, born_y) < min(gone_x, gone_y) and (i := self.normal.get(x + y)) is not None and self.cost[i] < gone_x and self.cost[i] <= gone_y:
                    return False
                born_y = gone_y
            born_x = gone_x
        return True

    def _pair(self, a: str, b: str) -> bool:
        if (a, b) not in self._stable:
            if len(self._stable) > PAIR_SLOTS // 64:
                self._stable.clear()
            self._stable[a, b] = self.stable(a, b)
        return self._stable[a, b]

    # -- shortest paths -----------------------------------------------------------------------

    def _ids(self, token: str) -> list[int]:
        if token in self.normal:
            return [self.normal[token]]
        return [self.byte[b] for b in token.encode("utf-8", "replace")] if self.byte else [self.unk]

    def path(self, text: str) -> list[str]:
        """Shortest path of one unit, a word behind its blank, character by character."""
        far: list[tuple[float, str, int] | None] = [(0.0, "", 0), *([None] * len(text))]
        for j in range(len(text)):
            if far[j] is None:
                continue
            for k in range(j + 1, min(len(text), j + self.longest) + 1):
                token = text[j:k]
                if token not in self.normal and k > j + 1:
                    continue
                weight = 0.0 if self.bpe else self.cost[self.normal[token]] if token in self.normal else 1e6
                if self.bpe and j and not self._pair(far[j][1], token):
                    continue
                if self.bpe and self.spine(token) is None:
                    continue
                if far[k] is None or far[j][0] + weight < far[k][0]:
                    far[k] = (far[j][0] + weight, token, j)
        out, k = [], len(text)
        while k:
            out.append(far[k][1])
            k = far[k][2]
        return out[::-1]

    def unit(self, text: str) -> list[int]:
        """Piece ids of one unit: a run of blanks and the word behind it."""
        word = text.lstrip(BLANK)
        n = len(text) - len(word)
        tokens = self.path(BLANK + word) if n and word else self.path(word) if word else []
        if not word or n > 1:
            alone = bool(tokens) and tokens[0] == BLANK and n > 0
            run = n if not word or alone else n - 1
            if run not in self.runs:
                self.runs[run] = [i for s, _, _ in self.merges(BLANK * run) for i in self._ids(s)] if self.bpe else [i for s in self.path(BLANK * run) for i in self._ids(s)]
            return self.runs[run] + [i for t in tokens[alone:] for i in self._ids(t)]
        return [i for t in tokens for i in self._ids(t)]

    @cached_property
    def _dense(self):
        """Piece tree over Latin characters as a table, for units that take their steps together."""
        chars = [chr(c) for c in (*range(1, 32), *range(33, 256)) if chr(c) in self.normal or (c < 128 and self.byte)] + [BLANK]
        symbol = np.full(0x2600, len(chars) + 1, np.int64)
        for k, c in enumerate(chars):
            symbol[ord(c)] = k + 1
        width, child, token = len(chars) + 2, [{}], [-1]
        for piece, i in self.normal.items():
            if BLANK * 2 in piece or any(ord(c) >= 0x2600 or symbol[ord(c)] > len(chars) for c in piece) or self.spine(piece) is None:
                continue
            node = 0
            for c in piece:
                s = int(symbol[ord(c)])
                if s not in child[node]:
                    child[node][s] = len(child)
                    child.append({})
                    token.append(-1)
                node = child[node][s]
            token[node] = i
        for c in chars:  # a character without a piece stands for its byte piece
            s = int(symbol[ord(c)])
            if c not in self.normal:
                child[0].setdefault(s, len(child))
                if child[0][s] == len(child):
                    child.append({})
                    token.append(-1)
                token[child[0][s]] = self.byte[ord(c)]
        table = np.zeros((len(child), width), np.uint16 if len(child) < 1 << 16 else np.int32)
        for node, steps in enumerate(child):
            for s, to in steps.items():
                table[node, s] = to
        byte_text = {i: chr(b) for b, i in self.byte.items()}
        texts = [byte_text.get(i, p) for i, p in enumerate(self.pieces)]
        return symbol, len(chars), width, table.ravel(), np.asarray(token, np.int32), texts, np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)

    def _pairs_ok(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        *_, texts, keys, values = self._dense
        key = a.astype(np.int64) * len(self.pieces) + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        out = values[slot]
        missed = np.flatnonzero(keys[slot] != key)
        if len(missed):
            new, back = np.unique(key[missed], return_inverse=True)
            found = np.fromiter((self.stable(texts[k // len(self.pieces)], texts[k % len(self.pieces)]) for k in new.tolist()), bool, len(new))
            at = ((new.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
            keys[at], values[at] = new, found
            same = keys[at] == new  # two new pairs may share a slot; the later one stays
            values[at[same]] = found[same]
            out[missed] = found[back]
        return out

    def units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after another, and where each begins (one more than units)."""
        symbol, known, width, table, token, _, _, _ = self._dense
        size = np.fromiter(map(len, units), np.int64, len(units))
        fast = np.flatnonzero((size <= STEP_CHARS) & (size > 1)) if self.bpe else np.zeros(0, np.int64)
        points = np.frombuffer("".join(units[i] for i in fast.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(points < 0x2600, symbol[np.minimum(points, 0x25FF)], known + 1)
        starts = np.cumsum(size[fast]) - size[fast]
        if len(fast):
            second = codes[starts + 1] == symbol[ord(BLANK)]
            good = (np.maximum.reduceat(codes, starts) <= known) & (codes[starts] == symbol[ord(BLANK)]) & ~second
            fast, starts = fast[good], starts[good]
        n, longest = len(fast), int(size[fast].max()) if len(fast) else 0
        grid = np.zeros((longest + self.longest + 1, n), np.int16)
        for j in range(longest):
            rows = np.flatnonzero(size[fast] > j)
            grid[j, rows] = codes[starts[rows] + j]
        last = np.full((longest + 1, n), -1, np.int32)
        length = np.zeros((longest + 1, n), np.uint8)
        for j in range(longest):
            rows = np.flatnonzero((last[j] >= 0) & (size[fast] > j)) if j else np.arange(n)
            node = np.zeros(len(rows), np.int64)
            for d in range(min(self.longest, longest - j)):
                node = table[node * width + grid[j + d, rows]].astype(np.int64)
                on = np.flatnonzero(node)
                rows, node = rows[on], node[on]
                if not len(rows):
                    break
                t = token[node]
                at = np.flatnonzero(t >= 0)
                if not len(at):
                    continue
                to, t = rows[at], t[at]
                if j:
                    ok = self._pairs_ok(last[j, to], t)
                    to, t = to[ok], t[ok]
                last[j + d + 1, to], length[j + d + 1, to] = t, d + 1
        counts = np.zeros(len(units), np.int64)
        at, rows, steps = size[fast].copy(), np.arange(n), []
        while len(rows):
            t = last[at[rows], rows]
            steps.append((rows, t))
            counts[fast[rows]] += 1
            at[rows] -= length[at[rows], rows]
            rows = rows[at[rows] > 0]
        slow = np.ones(len(units), bool)
        slow[fast] = False
        others = {i: self.unit(units[i]) for i in np.flatnonzero(slow).tolist()}
        for i, ids in others.items():
            counts[i] = len(ids)
        begin = np.concatenate([[0], np.cumsum(counts)])
        flat = np.zeros(begin[-1], np.int32)
        for k, (rows, t) in enumerate(steps):
            flat[begin[fast[rows] + 1] - 1 - k] = t
        for i, ids in others.items():
            flat[begin[i] : begin[i + 1]] = ids
        return flat, begin

    def encode(self, texts: pa.StringArray) -> pa.ListArray:
        """Piece ids of each text (no nulls). A blank mark in the text itself counts as a space, as in the library."""
        texts = pc.replace_substring(texts, BLANK, " ")
        spaced = pc.binary_join_element_wise(" " if self.prefix else "", texts, "")
        spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", spaced)
        ends = np.cumsum(np.concatenate([[0], pc.binary_length(spaced).to_numpy(zero_copy_only=False).astype(np.int64)]))
        data = b"".join(spaced.cast(pa.binary()).to_pylist())
        raw = np.frombuffer(data, np.uint8)
        space = raw == 32
        begins = np.flatnonzero(space & ~np.concatenate([[False], space[:-1]])) if len(raw) else np.zeros(0, np.int64)
        begins = np.union1d(begins, ends[:-1][np.diff(ends) > 0])
        offsets = pa.array(np.concatenate([begins, [len(raw)]]).astype(np.int64))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, offsets.buffers()[1], pa.py_buffer(data)]).dictionary_encode()
        units = [w.decode("utf-8", "replace").replace(" ", BLANK) for w in words.dictionary.to_pylist()]
        flat, at = self.units(units)
        index = words.indices.to_numpy().astype(np.int64)
        sizes = np.diff(at)[index]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(at[:-1][index] - total[:-1], sizes) + np.arange(total[-1])]
        cuts = total[np.searchsorted(begins, ends)]
        return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))

    @cached_property
    def _surface(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that each piece writes, one after another, and where each piece's begin."""
        back = {i: bytes([b]) for b, i in self.byte.items()}
        texts = [back[i] if i in back else b"" if i in self.control else " ⁇ ".encode() if i == self.unk else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    def decode(self, ids: pa.ListArray) -> pa.StringArray:
        """Texts of id lists (no nulls); bytes that are not UTF-8 become replacement characters."""
        data, at = self._surface
        flat, cuts = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
        sizes = np.diff(at)[flat]
        total = np.concatenate([[0], np.cumsum(sizes)])
        raw = data[np.repeat(at[:-1][flat] - total[:-1], sizes) + np.arange(total[-1])].tobytes()
        ends = total[cuts].tolist()
        skip = [1 if self.prefix and b > a and raw[a] == 32 else 0 for a, b in zip(ends, ends[1:])]
        return pa.array([raw[a + s : b].decode("utf-8", "replace") for a, b, s in zip(ends, ends[1:], skip)], pa.string())


_LOADED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _LOADED:
        machine = _LOADED[path] = Transducer(path)
        if machine.bpe:
            _ = machine._dense  # compiled now, so that what compiling leaves behind goes back at once
        give_back()
    return _LOADED[path]


def encode_texts(docs: DataFrame, model: str, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Every row of ``docs`` plus ``piece_ids`` (array of int) and ``round_trip``.

    ``piece_ids`` are the ids of the whole text, as the model's own library
    gives them without begin and end marks; ``round_trip`` says that decoding
    them returns the text. A null or empty text has an empty list and is a
    round trip. ``model`` is a path that every executor can read. Repeated
    rows, null ids and further columns are kept; columns named like a result
    are replaced. Without ``keep_text`` the text column is left out, and texts
    don't come back from Python. Arrow batches are cut at about one megabyte of text, and
    the distinct words of a batch take their steps through the transducer
    together; long words and those with characters beyond Latin go one by one.
    """
    taken = ("piece_ids", "round_trip")
    small_batches(docs)
    rows = docs.select(packed(docs, *taken, text_col).alias("row"), F.col(text_col).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in text_chunks(batches, "_t", CHUNK_BYTES):
            texts = batch.column(1).fill_null("")
            ids = machine.encode(texts)
            same = pc.equal(machine.decode(ids), texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + keep_text], ids, same], names=["row", *["_t"] * keep_text, *taken])

    text = "_t string, " if keep_text else ""
    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {text}piece_ids array<int>, round_trip boolean")
    return out.select(*with_text("row", docs, text_col, "_t" if keep_text else None, *taken), *taken)


def decode_texts(rows: DataFrame, model: str, ids_col: str = "piece_ids") -> DataFrame:
    """Every row plus ``decoded``, the text of its piece ids; null where the list is null."""
    kept = rows.select(packed(rows, "decoded").alias("row"), F.col(ids_col).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            lists = batch.column(1)
            empty = pa.array([[] if x is None else [i for i in x if i is not None] for x in lists.to_pylist()], pa.list_(pa.int32())) if lists.null_count or lists.flatten().null_count else lists
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(lists.is_valid(), machine.decode(empty), None)], names=["row", "decoded"])

    out = kept.mapInArrow(run, f"row {kept.schema['row'].dataType.simpleString()}, decoded string")
    return out.select(*unpacked("row", rows, "decoded"), "decoded")
