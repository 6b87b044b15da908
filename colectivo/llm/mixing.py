"""Sampling documents so that their tokens meet target shares of several margins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import snapshot
from .common import packed, unpacked

DIMS, ROUNDS, TEMPER, SEED = ("source", "lang", "topic"), 10, 0.9, "mix-1"
#: Token budget of the kept rows, as a share of all tokens.
BUDGET = 0.8
RESULT = ("n_tokens", "topic", "weight", "keep_probability", "kept")
#: Token weights: words between ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
#: Form of a text, the coarse topic of the test tables: first rule that holds.
TOPICS = (("licence", "licensed under"), ("table", " | "), ("advert", "!! "), ("contact", "@"))


def topic_of(text: str) -> Column:
    """Coarse topic by marks in the whole text."""
    rule = "CASE " + " ".join(f"WHEN contains(lower({text}), '{mark}') THEN '{name}'" for name, mark in TOPICS) + " ELSE 'prose' END"
    return F.expr(rule)


def _factor(dim: str) -> str:
    return f"f_{dim}"


def rake(cells: DataFrame, dims: Sequence[str], targets: Mapping[str, DataFrame] | None, rounds: int, temper: float) -> DataFrame:
    """``cells (dims, base)`` with ``weight``, the factor by which its tokens are to be multiplied.

    Iterative proportional fitting: in each round every margin in turn is
    scaled to its targets. The fit is a product of one factor per value of
    each margin, so only the factor tables change; each half step sums the
    cells by one margin (combined before the shuffle) and is written, so no
    plan grows with the rounds. ``targets[dim]`` holds ``dim, share``; values it
    lacks get share 0. Without targets, shares are tempered: proportional to
    tokens ** ``temper``.
    """
    key = lambda d: F.col(d).eqNullSafe(F.col(f"_{d}"))  # a null value is a value of its own
    total = cells.agg(F.sum("base")).first()[0] or 0.0
    share, factors = {}, {}
    for d in dims:
        sums = cells.groupBy(d).agg(F.sum("base").alias("base"))
        if targets and d in targets:
            wanted = targets[d].select(F.col(d).alias(f"_{d}"), F.col("share").cast("double").alias("share"))
            share[d] = sums.join(wanted, key(d), "left").select(F.col(d).alias(f"_{d}"), F.coalesce("share", F.lit(0.0)).alias("share"))
        else:
            share[d] = sums.select(F.col(d).alias(f"_{d}"), F.pow("base", F.lit(temper)).alias("share"))
        whole = share[d].agg(F.sum("share")).first()[0] or 1.0
        share[d] = snapshot(share[d].select(f"_{d}", (F.col("share") / whole * total).alias("want"), F.lit(1.0).alias(_factor(d))))
        factors[d] = share[d].select(f"_{d}", _factor(d))
    for _ in range(rounds):
        for d in dims:
            others = [x for x in dims if x != d]
            met = reduce(lambda df, x: df.join(factors[x], key(x)).drop(f"_{x}"), others, cells)
            now = met.groupBy(d).agg(F.sum(reduce(lambda a, x: a * F.col(_factor(x)), others, F.col("base"))).alias("now"))
            scaled = now.join(share[d], key(d)).select(f"_{d}", F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(F.lit(0.0)).alias(_factor(d)))
            factors[d] = snapshot(scaled)
    met = reduce(lambda df, x: df.join(factors[x], key(x)).drop(f"_{x}"), dims, cells)
    weight = reduce(lambda a, x: a * F.col(_factor(x)), dims, F.lit(1.0))
    return snapshot(met.select(*dims, "base", weight.alias("weight")))


def keep_rates(raked: DataFrame, budget: float | None = BUDGET) -> DataFrame:
    """``raked`` with ``keep_probability`` and ``clamped``, which marks the cells whose rows are all kept.

    The probability is min(1, c * weight), with c such that the expected tokens
    are ``budget`` of all: a cell of a very large weight is clamped at 1 and
    scales nobody else down. Rows are not repeated, so a clamped cell stays
    below its target. Expected tokens are concave in c and linear between the
    clamps, so each step from the left ends at or before the c that is wanted,
    and the last one meets it; a step is one sum over the cells. Without a
    budget, c is 1 over the largest weight, which meets all targets.
    """
    if budget is None:
        c = 1.0 / (raked.agg(F.max("weight")).first()[0] or 1.0)
    else:
        c, full = 0.0, -1
        while True:
            at = F.col("weight") * F.lit(c) >= 1
            n, whole, held, slope = raked.agg(
                F.count_if(at), F.sum("base"), F.sum(F.when(at, F.col("base"))), F.sum(F.when(~at, F.col("base") * F.col("weight")))
            ).first()
            if n == full or not slope:
                break
            c, full = max(c, (budget * whole - (held or 0.0)) / slope), n
    rate = F.least(F.lit(1.0), F.col("weight") * F.lit(c))
    return raked.select("*", rate.alias("keep_probability"), (rate >= 1).alias("clamped"))


def mix(
    docs: DataFrame,
    targets: Mapping[str, DataFrame] | None = None,
    dims: Sequence[str] = DIMS,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = ROUNDS,
    temper: float = TEMPER,
    seed: str = SEED,
    budget: float | None = BUDGET,
) -> DataFrame:
    """Every row of ``docs`` plus ``n_tokens, topic, weight, keep_probability, kept``.

    ``weight`` is the raked factor of the row's cell (source, language, topic);
    ``keep_probability`` comes from ``keep_rates``: in proportion to the weight,
    at most 1, and such that the kept rows hold ``budget`` of all tokens in
    expectation; nothing is repeated. A row is kept when a uniform number made from its id and the
    seed is below that probability; equal ids are kept or dropped together,
    and a null id has a number too. Words are counted over whole texts; a null
    or empty text has 0 tokens, and a cell without tokens has weight and
    probability 1, since it costs nothing. A null margin value is a value of
    its own. Topic is the row's own column when ``docs`` has one, else it comes
    from ``topic_of``. Columns named like a result are replaced.
    """
    has_topic = "topic" in docs.columns
    drop = RESULT if not has_topic else tuple(r for r in RESULT if r != "topic")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        packed(docs, *drop).alias("row"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("n_tokens"),
        *(F.col(d).alias(d) if d != "topic" or has_topic else topic_of(f"coalesce(`{text_col}`, '')").alias(d) for d in dims),
        F.col(id_col).cast("string").alias("key"),
    )
    cells = snapshot(rows.groupBy(*dims).agg(F.sum("n_tokens").cast("double").alias("base")))
    raked = rake(cells.where("base > 0"), dims, targets, rounds, temper)
    wide = keep_rates(raked, budget).select(*(F.col(d).alias(f"_{d}") for d in dims), "weight", "keep_probability")
    on = reduce(lambda a, d: a & F.col(d).eqNullSafe(F.col(f"_{d}")), dims, F.lit(True))
    unit = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce("key", F.lit("null")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    met = rows.join(wide, on, "left").withColumns({"weight": F.coalesce("weight", F.lit(1.0)), "keep_probability": F.coalesce("keep_probability", F.lit(1.0))})
    extra = [] if has_topic or "topic" not in dims else ["topic"]
    return met.select(*unpacked("row", docs, *drop), "n_tokens", *extra, "weight", "keep_probability", (unit < F.col("keep_probability")).alias("kept"))


def _oracle(rounds: int = ROUNDS, temper: float = TEMPER, seed: str = SEED) -> str:
    """The same fit in SQL: one common table expression per half step."""
    cases = " ".join(f"WHEN contains(lower(coalesce(text, '')), '{mark}') THEN '{name}'" for name, mark in TOPICS)
    ctes = [
        f"d AS (SELECT doc_id, source, lang, CASE {cases} ELSE 'prose' END AS topic, "
        f"len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents)",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, base, base AS w FROM (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS base FROM d GROUP BY 1, 2, 3) WHERE base > 0)",
    ]
    for dim in DIMS:
        ctes.append(f"t_{dim} AS MATERIALIZED (SELECT {dim}, pow(b, {temper}) / sum(pow(b, {temper})) OVER () * sum(b) OVER () AS want FROM (SELECT {dim}, sum(base) AS b FROM c0 GROUP BY 1))")
    step = 0
    for _ in range(rounds):
        for dim in DIMS:
            ctes.append(
                f"c{step + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, base, w * want / sum(w) OVER (PARTITION BY c.{dim}) AS w"
                f" FROM c{step} c JOIN t_{dim} t ON c.{dim} IS NOT DISTINCT FROM t.{dim})"
            )
            step += 1
    ctes.append(f"g AS (SELECT source, lang, topic, w / base AS weight, w / base / max(w / base) OVER () AS p FROM c{step})")
    return (
        "WITH " + ",\n".join(ctes) + f"""
SELECT d.doc_id, d.source, d.lang, d.topic, n_tokens::BIGINT AS n_tokens, round(coalesce(weight, 1), 6) AS weight, round(coalesce(p, 1), 6) AS keep_probability,
  ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 < coalesce(p, 1) AS kept
FROM d LEFT JOIN g ON g.source IS NOT DISTINCT FROM d.source AND g.lang IS NOT DISTINCT FROM d.lang AND g.topic = d.topic
"""
    )


SQL = _oracle()
