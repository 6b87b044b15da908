"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import snapshot
from .common import packed, small_batches, text_chunks, with_text

#: Folds, hashed features.
FOLDS, FEATURES, CHUNK_BYTES = 3, 1 << 18, 2 << 20
#: L1 penalty, features that a fit looks at: those that tell most about the category by themselves.
PENALTY, SCREENED = 2e-4, 1024
#: A fit ends when a step lowers its mean loss by less than this share of it, after this many steps at most.
TOLERANCE, STEPS = 1e-5, 200
CHAIN = ("low_quality", "toxic")


@dataclass
class Linear:
    """One fitted classifier; ``given`` are the weights of the earlier categories' probabilities."""

    bias: float
    features: np.ndarray
    weights: np.ndarray
    given: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(FEATURES)
        out[self.features] = self.weights
        return out


@dataclass
class Chain:
    """Fitted classifiers in their order, and the probability from which each category is taken as given."""

    categories: tuple[str, ...]
    models: list[Linear]
    thresholds: list[float]


def _word_features(words: pa.StringArray) -> np.ndarray:
    """Hashed features of each word (words x 3): the word, its first 4 and its first 6 letters; -1 for none."""
    out = np.full((len(words), 3), -1, np.int64)
    for i, w in enumerate(words.to_pylist()):
        if w:
            out[i, 0] = crc32(w.encode()) & (FEATURES - 1)
            if len(w) > 4:
                out[i, 1] = crc32(("4:" + w[:4]).encode()) & (FEATURES - 1)
            if len(w) > 6:
                out[i, 2] = crc32(("6:" + w[:6]).encode()) & (FEATURES - 1)
    return out


def _text_features(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of whole texts, as two arrays sorted by text.

    Words lie between white space, in lower case and without the punctuation around them.
    """
    parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    words = parts.flatten().dictionary_encode()
    plain = pc.utf8_lower(pc.utf8_trim(words.dictionary, characters=".,;:!?\"'()[]{}<>*_#|\t\r")).dictionary_encode()
    features = _word_features(plain.dictionary)[plain.indices.to_numpy()][words.indices.to_numpy()]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(parts.offsets.to_numpy()))
    pairs = ((owner * FEATURES)[:, None] + features)[features >= 0]
    pairs.sort()
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])[: len(pairs)]]
    return pairs // FEATURES, pairs % FEATURES


def _with_features(rows: DataFrame) -> DataFrame:
    """``rows`` with its column ``_t`` replaced by the features ``_x`` of that text."""
    kept = [f for f in rows.schema.fields if f.name != "_t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "_t", CHUNK_BYTES):
            owner, feature = _text_features(batch.column(batch.schema.get_field_index("_t")).fill_null(""))
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), lists], names=[*(f.name for f in kept), "_x"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", _x array<int>"
    return rows.mapInArrow(run, schema)


def _descent(start: np.ndarray, penalty: np.ndarray) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Minimum of a smooth loss plus ``penalty * |w|`` by limited-memory quasi-Newton steps within orthants (OWL-QN).

    Yields the points where the loss and its gradient are wanted, and returns the best point.
    """
    w, past = start, []
    loss, grad = yield w
    total = loss + penalty @ np.abs(w)
    for _ in range(STEPS):
        side = np.where(w != 0, np.sign(w), -np.sign(grad) * (np.abs(grad) > penalty))
        slope = np.where((w != 0) | (side != 0), grad + penalty * side, 0.0)
        ahead, use = -slope, []
        for s, y in reversed(past):
            use.append((s @ ahead) / (s @ y))
            ahead = ahead - use[-1] * y
        if past:
            ahead = ahead * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(use), strict=True):
            ahead = ahead + (a - (y @ ahead) / (s @ y)) * s
        ahead = np.where(ahead * slope < 0, ahead, 0.0)
        step = 1.0 if past else 1 / max(1.0, np.abs(slope).sum())
        for _ in range(20):
            new = w + step * ahead
            new = np.where((penalty > 0) & (np.sign(new) != side), 0.0, new)
            loss, new_grad = yield new
            now = loss + penalty @ np.abs(new)
            if now <= total + 1e-4 * (slope @ (new - w)):
                break
            step /= 2
        else:
            return w
        s, y = new - w, new_grad - grad
        past = (past + [(s, y)])[-10:] if s @ y > 1e-12 * (y @ y) else past
        gain, w, grad, total = total - now, new, new_grad, now
        if gain <= TOLERANCE * abs(total):
            break
    return w


def _screened(rows: DataFrame, categories: Sequence[str], sums: dict[int, dict[str, tuple[float, float]]]) -> dict[str, dict[int, np.ndarray]]:
    """For each category and left-out fold, the features with the largest score test against the category's share."""
    y = {c: F.col(f"_y_{c}") for c in categories}
    counts = rows.select("_fold", *y.values(), F.explode("_x").alias("feature")).groupBy("feature").agg(*(
        f for c in categories for k in range(FOLDS)
        for f in (F.count(F.when(F.col("_fold") == k, y[c])).alias(f"_n_{c}_{k}"), F.sum(F.when(F.col("_fold") == k, y[c])).alias(f"_s_{c}_{k}"))
    ))
    models = []
    for c in categories:
        for k, by in sums.items():
            n, s = by[c]
            folds = [j for j in range(FOLDS) if j != k]
            count = sum((F.col(f"_n_{c}_{j}") for j in folds), F.lit(0))
            found = sum((F.coalesce(f"_s_{c}_{j}", F.lit(0.0)) for j in folds), F.lit(0.0))
            score = F.abs(found - F.lit(s / n if n else 0.0) * count) / F.sqrt(F.greatest(count, F.lit(1)))
            models.append(F.struct(F.lit(c).alias("category"), F.lit(k).alias("without"), F.when(count >= 3, score).otherwise(0.0).alias("score")))
    order = Window.partitionBy("category", "without").orderBy(F.desc("score"), "feature")
    best = (
        counts.select("feature", F.inline(F.array(*models))).where("score > 0")
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= SCREENED)
        .groupBy("category", "without").agg(F.sort_array(F.collect_list("feature")).alias("features"))
    )
    out = {c: {k: np.zeros(0, np.int64) for k in sums} for c in categories}
    for r in best.collect():
        out[r["category"]][r["without"]] = np.array(r["features"], np.int64)
    return out


def _narrowed(rows: DataFrame, features: dict[str, np.ndarray]) -> DataFrame:
    """``rows`` with ``_x_<category>`` instead of ``_x``: places in the category's sorted ``features``, others left out."""
    kept = [f for f in rows.schema.fields if f.name != "_x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("_x"))
            owner, feature = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            found = []
            for of in features.values():
                place = np.searchsorted(of, feature)
                on = np.append(of, -1)[place] == feature
                ends = np.searchsorted(owner[on], np.arange(batch.num_rows + 1)).astype(np.int32)
                found.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(place[on].astype(np.int32))))
            columns = [*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), *found]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), *(f"_x_{c}" for c in features)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"_x_{c} array<int>" for c in features)])
    return rows.mapInArrow(run, schema)


def _logits(batch: pa.RecordBatch, category: str, before: Sequence[str], points: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Row and place of each feature of a batch, its dense columns, and the logits of each point (bias, given, features)."""
    lists = batch.column(batch.schema.get_field_index(f"_x_{category}"))
    owner, place = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    dense = np.column_stack([np.ones(batch.num_rows), *(np.asarray(batch.column(batch.schema.get_field_index(f"_p_{c}"))) for c in before)])
    m = dense.shape[1]
    return owner, place, dense, {k: dense @ w[:m] + np.bincount(owner, weights=w[m:][place], minlength=batch.num_rows) for k, w in points.items()}


def _losses(rows: DataFrame, category: str, before: Sequence[str], points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
    """Summed loss and gradient of each point over the rows outside its fold: one pass, each task hands on one sum a point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(1 + len(w)) for k, w in points.items()}
        for batch in batches:
            owner, place, dense, logits = _logits(batch, category, before, points)
            y = batch.column(batch.schema.get_field_index(f"_y_{category}")).to_numpy(zero_copy_only=False)
            fold = np.asarray(batch.column(batch.schema.get_field_index("_fold")))
            for k, z in logits.items():
                on = (fold != k) & ~np.isnan(y)
                r = np.where(on, 1 / (1 + np.exp(-z)) - y, 0.0)
                sums[k][0] += np.where(on, np.logaddexp(0, z) - y * z, 0.0).sum()
                sums[k][1:] += np.concatenate([dense.T @ r, np.bincount(place, weights=r[owner], minlength=len(points[k]) - dense.shape[1])])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["k", "v"])

    used = rows.select("_fold", f"_y_{category}", f"_x_{category}", *(f"_p_{c}" for c in before))
    out = {k: np.zeros(1 + len(w)) for k, w in points.items()}
    for part in used.mapInArrow(run, "k int, v array<double>").collect():
        out[part["k"]] += np.array(part["v"])
    return {k: (v[0], v[1:]) for k, v in out.items()}


def _fits(rows: DataFrame, category: str, before: Sequence[str], kept: dict[int, np.ndarray], union: np.ndarray, sums: dict[int, tuple[float, float]]) -> dict[int, np.ndarray]:
    """Logistic regressions with an L1 penalty over all rows: one without each fold, and under -1 the one of all rows.

    Bias and weights of the earlier categories are not penalised. All fits share each pass over the rows.
    """
    m, found, running = 1 + len(before), {}, {}
    for k, (n, positive) in sums.items():
        start = np.zeros(m + len(union))
        share = min(max(positive / n, 1e-9), 1 - 1e-9) if n else 0.0
        start[0] = np.log(share / (1 - share)) if n else -20.0  # no row to learn from
        found[k] = start
        if 0 < positive < n:  # else one class only: a constant
            on = np.concatenate([np.arange(m), m + np.searchsorted(union, kept[k])])
            fit = _descent(start[on], np.concatenate([np.zeros(m), np.full(len(on) - m, PENALTY)]))
            running[k] = (fit, on, next(fit))
    while running:
        points = {}
        for k, (_, on, w) in running.items():
            points[k] = np.zeros(m + len(union))
            points[k][on] = w
        for k, (loss, grad) in _losses(rows, category, before, points).items():
            fit, on, _ = running.pop(k)
            try:
                running[k] = (fit, on, fit.send((loss / sums[k][0], grad[on] / sums[k][0])))
            except StopIteration as end:
                found[k] = np.zeros(m + len(union))
                found[k][on] = end.value
    return found


def _probabilities(models: Sequence[Linear], owner: np.ndarray, feature: np.ndarray, n: int, given: np.ndarray) -> np.ndarray:
    """Probability of each further category for n rows (n x models); ``given`` holds those before them."""
    for m in models:
        z = m.bias + np.bincount(owner, weights=m.dense()[feature], minlength=n) + given @ m.given
        given = np.column_stack([given, 1 / (1 + np.exp(-z))])
    return given


def _held_out(points: dict[int, np.ndarray], rows: DataFrame, category: str, before: Sequence[str]) -> DataFrame:
    """``rows`` with ``_p_<category>``, predicted by the model that did not see the row's fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = _logits(batch, category, before, {k: w for k, w in points.items() if k >= 0})[3]
            fold = np.asarray(batch.column(batch.schema.get_field_index("_fold")))
            p = np.select([fold == k for k in by], [1 / (1 + np.exp(-z)) for z in by.values()], 0.0)
            yield batch.append_column(f"_p_{category}", pa.array(p))

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", _p_{category} double")


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CHAIN, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit one classifier per category, in order, on every labelled row.

    ``labels``: the id and a 0/1 column per category; nulls are left out of
    that category, of several rows for one id the larger values count. Tasks
    sum losses and gradients of their rows; only these sums and the weights
    pass through the driver. A later classifier learns from the words and
    from the earlier categories' probabilities, each predicted by models that
    did not see the row (three folds). The threshold of a category is the one
    of 19 that gives the best F1 on such predictions.
    """
    labelled = snapshot(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(*(F.max(F.col(c).cast("double")).alias(f"_y_{c}") for c in categories)))
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("_id")), F.lit(FOLDS)).cast("int").alias("_fold")
    small_batches(docs)
    rows = snapshot(_with_features(text.where("_id IS NOT NULL")).join(labelled.hint("merge"), "_id").select("_x", fold, *(f"_y_{c}" for c in categories)))
    by_fold = rows.groupBy("_fold").agg(*(f for c in categories for f in (F.count(f"_y_{c}").alias(f"n_{c}"), F.sum(f"_y_{c}").alias(f"s_{c}")))).collect()
    sums = {
        k: {c: (sum(r[f"n_{c}"] for r in by_fold if r["_fold"] != k), sum(r[f"s_{c}"] or 0.0 for r in by_fold if r["_fold"] != k)) for c in categories}
        for k in (-1, *range(FOLDS))
    }
    kept = _screened(rows, categories, sums)
    union = {c: np.unique(np.concatenate(list(by.values()))) for c, by in kept.items()}
    rows = snapshot(_narrowed(rows, union))
    models, thresholds = [], []
    for i, c in enumerate(categories):
        before = categories[:i]
        points = _fits(rows, c, before, kept[c], union[c], {k: by[c] for k, by in sums.items()})
        w, m = points[-1], 1 + i
        found = np.flatnonzero(w[m:])
        models.append(Linear(float(w[0]), union[c][found], w[m:][found], w[1:m]))
        rows = snapshot(_held_out(points, rows, c, before))
        thresholds.append(_threshold(rows, c))
    return Chain(tuple(categories), models, thresholds)


def _threshold(rows: DataFrame, category: str) -> float:
    """The cut with the best F1; 0.5 if no row is positive."""
    p, y = F.col(f"_p_{category}"), F.col(f"_y_{category}")
    grid = [t / 20 for t in range(1, 20)]
    sums = rows.where(y.isNotNull()).agg(
        F.sum(y), *(f for t in grid for f in (F.sum(F.when(p >= t, y)), F.sum(F.when(p >= t, 1))))
    ).first()
    given = sums[0] or 0.0
    score = [2 * (sums[1 + 2 * i] or 0) / ((sums[2 + 2 * i] or 0) + given) if given else 0.0 for i in range(len(grid))]
    best = [t for t, s in zip(grid, score, strict=True) if s == max(score)]
    return best[len(best) // 2] if max(score) > 0 else 0.5


def predict(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` plus ``p_<category>`` and a boolean ``is_<category>`` for each category.

    Whole texts are read; a null or empty text has no words, and gets the
    classifiers' bare intercepts. Null ids and repeated rows are kept; columns
    named like a result are replaced. Where a category had no labelled row,
    its probability is 0; where all labelled rows agree, it is their share.
    """
    taken = [f"{k}_{c}" for c in chain.categories for k in ("p", "is")]
    small_batches(docs)
    rows = docs.select(packed(docs, *taken, text_col).alias("row"), F.col(text_col).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "_t", CHUNK_BYTES):
            owner, feature = _text_features(batch.column(1).fill_null(""))
            p = _probabilities(chain.models, owner, feature, batch.num_rows, np.zeros((batch.num_rows, 0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in p.T)], names=["row", "_t", *(f"p_{c}" for c in chain.categories)])

    scored = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, _t string, " + ", ".join(f"p_{c} double" for c in chain.categories))
    found = [
        col for c, t in zip(chain.categories, chain.thresholds, strict=True)
        for col in (F.col(f"p_{c}"), (F.col(f"p_{c}") >= t).alias(f"is_{c}"))
    ]
    return scored.select(*with_text("row", docs, text_col, "_t", *taken), *found)


def label_columns(labels: DataFrame) -> DataFrame:
    """``doc_id, low_quality, toxic`` from the labels table: its two annotations, both as 1 for bad."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
