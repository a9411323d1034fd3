"""Temperature mixing of sources [native].

Source shares of all tokens are raised to an exponent between 0 (all sources alike) and 1 (as they are) and normalised.
The exponent is the smallest that keeps every source's repetition within a limit and, if asked for, the entropy at or
below a target. It is found by bisection into 32 parts a round: one aggregation over the table of sources tries all of
a round's exponents. The weights are then realised as whole passes over a source plus a prefix, within the token budget,
of a random permutation of it. The permutation is made of blocks whose token sums are added up first, so that no task
orders a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import checkpoint

PARTS, ROUNDS = 32, 5


def _measured() -> list[Column]:
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return [F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), words.alias("n_tokens")]


def _grid(shares: DataFrame, alphas: list[float]) -> list[dict]:
    """For each exponent: the sum of share^a, the entropy of the normalised weights, the most that a source is repeated."""
    tried = shares.select("_p", F.explode(F.array(*map(F.lit, alphas))).alias("a"))
    power = F.pow("_p", F.col("a"))
    sums = tried.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("_p")).alias("l"), F.max(power / F.col("_p")).alias("m"))
    found = {r["a"]: r for r in sums.collect()}  # one row an exponent, however many sources
    return [{"a": a, "z": (r := found[a])["z"], "entropy": math.log(r["z"]) - a * r["l"] / r["z"], "most": r["m"] / r["z"]} for a in alphas]


def exponent(shares: DataFrame, budget_ratio: float | None, repetition: float, entropy: float | None) -> dict:
    """The smallest exponent in [0, 1] that meets the limits, with its normaliser z. `shares` has the column _p.

    budget_ratio: budget over all tokens. None: the least budget that takes every document once.
    """
    highest = shares.agg(F.max("_p")).first()[0]

    def fits(g: dict) -> bool:
        # With no budget given, the largest source is taken just once and the others in proportion.
        ratio = budget_ratio if budget_ratio is not None else g["z"] * highest / highest ** g["a"]
        return g["most"] * ratio <= repetition * (1 + 1e-12) and (entropy is None or g["entropy"] <= entropy + 1e-12)

    low, high, best = 0.0, 1.0, None
    for _ in range(ROUNDS):
        tries = _grid(shares, [low + (high - low) * i / PARTS for i in range(PARTS + 1)])
        at = next((i for i, g in enumerate(tries) if fits(g)), None)
        if at is None:  # even the shares as they are do not meet the limits: they are the closest
            return tries[-1] | {"highest": highest}
        best = tries[at]
        if at == 0:
            break
        low, high = tries[at - 1]["a"], tries[at]["a"]
    return best | {"highest": highest}


def mix(docs: DataFrame, repetition: float = 4.0, entropy: float | None = None, budget_tokens: int | None = None, cover: bool = False, seed: int = 9, rows_per_block: int = 50_000, least_blocks: int = 64) -> DataFrame:
    """How often each document is taken so that the sources reach their weights.

    Tokens are words (runs without space and U+0009 to U+000D). The budget is `budget_tokens`, or as many tokens as
    there are, or with `cover` the least that takes each document once at least. Returns doc_id, source, n_tokens,
    exponent, weight (of the source), block and copies; a document has one row, also with copies 0. Within a source,
    copies differ by one at most, and its tokens taken are within its part of the budget by less than one document.

    A null source is the source ''. A text without words (null, empty) has no tokens and is taken once. A document
    longer than what is left of its source's budget ends that source's last pass. Rows with equal doc_id,
    source and n_tokens are taken alike, together. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    base = checkpoint(docs.select("doc_id", *_measured()))
    sources = base.groupBy("source").agg(F.sum("n_tokens").alias("_t"), F.count("*").alias("_n"))
    total = base.agg(F.sum("n_tokens")).first()[0] or 0
    sources = checkpoint(sources.withColumn("_p", F.col("_t") / F.lit(float(max(1, total)))))
    if not total:
        return base.select("doc_id", "source", "n_tokens", F.lit(1.0).alias("exponent"), F.lit(0.0).alias("weight"), F.lit(0).alias("block"), F.lit(1).alias("copies"))
    full = sources.filter("_p > 0")
    ratio = None if cover else (budget_tokens if budget_tokens is not None else total) / total
    found = exponent(full, ratio, repetition, entropy)
    if cover:
        ratio = found["z"] * found["highest"] / found["highest"] ** found["a"]
    weight = F.when(F.col("_p") > 0, F.pow("_p", F.lit(found["a"])) / F.lit(found["z"])).otherwise(0.0)
    want = F.col("weight") * F.lit(float(ratio) * total)
    plan = (
        sources.withColumn("weight", weight)
        .withColumn("_passes", F.when(F.col("_t") > 0, F.floor(want / F.col("_t") + F.lit(1e-9))).otherwise(1).cast("int"))
        .withColumn("_rest", F.greatest(F.lit(0.0), want - F.col("_passes") * F.col("_t")))
        .withColumn("_blocks", F.greatest(F.lit(least_blocks), F.ceil(F.col("_n") / F.lit(rows_per_block))).cast("int"))
    )
    plan = checkpoint(plan.select("source", "weight", "_passes", "_rest", "_blocks"))
    rows = base.join(plan, "source").withColumn("_r", F.xxhash64(F.lit(seed), "source", "doc_id", "n_tokens"))
    rows = checkpoint(rows.withColumn("block", (F.shiftrightunsigned("_r", 33) * F.col("_blocks") / F.lit(2**31)).cast("int")))
    sums = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("_b"))
    before = F.sum("_b").over(Window.partitionBy("source").orderBy("block")) - F.col("_b")
    sums = checkpoint(sums.select("source", "block", before.alias("_before")))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("_r", "doc_id").rangeBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("_inside", inside).join(sums, ["source", "block"])
    more = (F.col("n_tokens") > 0) & (F.col("_before") + F.col("_inside") <= F.col("_rest"))
    copies = F.when(F.col("n_tokens") == 0, 1).otherwise(F.col("_passes") + more.cast("int"))
    return placed.select("doc_id", "source", "n_tokens", F.lit(found["a"]).alias("exponent"), "weight", "block", copies.alias("copies"))


def repeated(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The rows of `docs`, whole and in the same columns, each as often as mix(docs) in `taken` says."""
    key = ["source", "n_tokens"]
    more = taken.filter("copies <> 1").select(F.col("doc_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in key], "copies").distinct()
    rows = docs.select(F.struct("*").alias("d"), "doc_id", *_measured())
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    for c in key:
        same = same & (F.col(c) == F.col(f"_{c}"))
    joined = rows.join(more.hint("shuffle_hash"), same, "left").select("d", F.coalesce("copies", F.lit(1)).alias("copies")).filter("copies > 0")
    return joined.select("d", F.explode(F.sequence(F.lit(1), "copies"))).select("d.*")
