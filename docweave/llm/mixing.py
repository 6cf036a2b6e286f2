"""Mixing (operator 8): temperature weights of sources, realised as budgeted block permutations.

DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

STEPS = 5  # bisection steps that one job settles
NO_SOURCE = "n"


def token_count(text: Column) -> Column:
    """Words of a text: runs of other than blank, tab, line feed, form feed and return."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\f\r]+")).cast("long")


def source_key(source: Column) -> Column:
    """The source as a key that tells null from every string."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(NO_SOURCE))


def _log(x: float) -> float:
    return math.log(x) if x > 0 else 0.0


@dataclass(frozen=True)
class Temperature:
    exponent: float
    entropy: float
    total: float  # tokens of all sources
    norm: float  # sum of the shares to that exponent


def temperature(sources: DataFrame, *, entropy_share: float | None, max_repeats: float | None, budget: float, rounds: int = 6) -> Temperature:
    """The exponent in [0, 1] nearest to 1 that meets the target entropy, raised as far as the
    repetition limit needs.

    A source's weight is its token share to the exponent, normalised. The entropy falls and the
    most repeated source's epochs fall as the exponent rises, so both limits are found by bisection;
    one job evaluates the 2 ** STEPS - 1 points that STEPS bisections could visit.
    """
    total, n = sources.where("tokens > 0").agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not total:
        return Temperature(1.0, 0.0, 0.0, 1.0)
    share = F.col("tokens") / F.lit(float(total))

    def measure(points: list[float]) -> list[tuple[float, float, float, float]]:
        w = F.pow(share, F.col("a"))
        rows = sources.where("tokens > 0").select("tokens", F.explode(F.array(*map(F.lit, points))).alias("a"))
        got = rows.groupBy("a").agg(F.sum(w).alias("s"), F.sum(w * F.log(w)).alias("l"), F.max(w / F.col("tokens")).alias("m")).collect()
        return sorted((r.a, r.s, float(_log(r.s) - r.l / r.s), budget * r.m / r.s) for r in got)

    def seek(met: Callable[[tuple[float, float, float, float]], bool]) -> float:
        """Least exponent in [0, 1] at which ``met`` holds, which stays true from there on; 1 if nowhere."""
        low, high = 0.0, 1.0
        if met(measure([0.0])[0]):
            return 0.0
        for _ in range(rounds):
            points = [low + (high - low) * i / (1 << STEPS) for i in range(1, 1 << STEPS)]
            seen = measure(points)
            high = min([x[0] for x in seen if met(x)] + [high])
            low = max([x[0] for x in seen if not met(x) and x[0] < high] + [low])
        return high

    exponent = 1.0
    if entropy_share is not None:
        target = entropy_share * _log(n)
        if measure([1.0])[0][2] < target:
            exponent = seek(lambda x: x[2] < target)
    if max_repeats is not None:
        exponent = max(exponent, seek(lambda x: x[3] <= max_repeats))
    a, s, entropy, _ = measure([exponent])[0]
    return Temperature(a, entropy, float(total), s)


def _order(block: Column, seed: int) -> Column:
    """Place of a block in its source's permutation."""
    return F.xxhash64(F.col("key"), block, F.lit(seed))


def plan(docs: DataFrame, *, entropy_share: float | None = 0.98, max_repeats: float | None = 4.0, budget_tokens: int | None = None, block_rows: int = 1024, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(documents, sources): each row's narrow record, and what each source gets.

    documents: doc_id, source, key, tokens, place. sources: key, tokens, docs, blocks, weight,
    quota, epochs, cut_order, cut_block, cut_place, cut_id. A source is read ``epochs`` times whole,
    then its blocks in the order of a permutation, each block's rows by place, up to the cut: the
    longest run of whole rows within the quota. Rows with equal place and id stand or fall together.
    """
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"), source_key(F.col("source")).alias("key"), token_count(F.col("text")).alias("tokens"))
    narrow = common.materialize(narrow.withColumn("place", F.xxhash64(F.col("doc_id"), F.lit(seed))), "mix_rows")
    sources = narrow.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    sources = common.materialize(sources, "mix_sources", rows=narrow.count())
    n_rows, total = sources.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    budget = float(total if budget_tokens is None else budget_tokens)
    t = temperature(sources, entropy_share=entropy_share, max_repeats=max_repeats, budget=budget)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(t.total or 1.0), F.lit(t.exponent)) / F.lit(t.norm)).otherwise(F.lit(0.0))
    quotas = sources.withColumn("weight", weight).withColumn("quota", F.floor(F.round(F.col("weight") * budget, 6)))
    quotas = quotas.withColumn("blocks", F.ceil(F.col("docs") / block_rows).cast("long"))
    # rows without tokens cost nothing: they go with every epoch, once at least
    quotas = quotas.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1)))
    quotas = common.materialize(quotas.withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") % F.col("tokens")).otherwise(F.lit(0))), "mix_quotas", rows=n_rows)
    dealt = common.join_hot(narrow, quotas.select("key", "blocks", "rest", F.col("docs").alias("size")), "key", "size", max(n_rows, 1))
    dealt = dealt.withColumn("block", F.pmod(F.col("place"), F.col("blocks")))
    sums = dealt.groupBy("key", "block").agg(F.sum("tokens").alias("held"), F.first("rest").alias("rest")).withColumn("order", _order(F.col("block"), seed))
    sums = common.materialize(sums.withColumn("span", F.shiftright("order", 48)), "mix_blocks", rows=n_rows)
    # the cut's span of the permutation first, among 65,536 at most, then its block in the span: no window holds all blocks of a source
    along = Window.partitionBy("key").orderBy("span")
    spans = sums.groupBy("key", "span").agg(F.sum("held").alias("span_held"), F.first("rest").alias("span_rest"))
    spans = spans.withColumn("base", F.sum("span_held").over(along) - F.col("span_held")).where("base <= span_rest and span_rest < base + span_held")
    along = Window.partitionBy("key").orderBy("order", "block")
    inner = sums.join(spans.select("key", "span", "base"), ["key", "span"])
    cuts = inner.withColumn("before", F.col("base") + F.sum("held").over(along) - F.col("held")).where("before <= rest and rest < before + held")
    cuts = common.materialize(cuts.select("key", F.col("block").alias("cut_block"), F.col("order").alias("cut_order"), "before"), "mix_cuts", rows=n_rows)
    hot_cuts = common.join_hot(dealt, cuts.join(quotas.select("key", F.col("docs").alias("cut_size")), "key"), "key", "cut_size", max(n_rows, 1))
    inside = hot_cuts.where((F.col("block") == F.col("cut_block")) & (F.col("tokens") > 0))
    steps = Window.partitionBy("key", "block").orderBy("place", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(steps)).where("upto <= rest").groupBy("key").agg(F.max(F.struct("place", "doc_id")).alias("last"))
    final = quotas.join(cuts.drop("before"), "key", "left").join(last, "key", "left")
    final = final.select("key", "tokens", "docs", "blocks", "weight", "quota", "epochs", "cut_order", "cut_block", F.col("last.place").alias("cut_place"), F.col("last.doc_id").alias("cut_id"), F.col("last").isNotNull().alias("cut_some"))
    return narrow, common.materialize(final, "mix_plan", rows=n_rows)


def _copies(place: Column, doc_id: Column, seed: int) -> Column:
    """How often a row is read, from the columns of its source's plan."""
    block = F.pmod(place, F.col("blocks"))
    order = _order(block, seed)
    earlier = (order < F.col("cut_order")) | ((order == F.col("cut_order")) & (block < F.col("cut_block")))
    same = (order == F.col("cut_order")) & (block == F.col("cut_block")) & F.col("cut_some")
    within = same & (F.struct(place.alias("p"), doc_id.alias("i")) <= F.struct(F.col("cut_place").alias("p"), F.col("cut_id").alias("i")))
    return (F.col("epochs") + F.coalesce(earlier | within, F.lit(False)).cast("long")).cast("long")


def mix(docs: DataFrame, *, seed: int = 1, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, n_tokens, weight (of its source), copies.

    A null source is a source of its own; null and empty texts have no tokens, cost nothing and are
    read with every epoch of their source, and as they come with the last one; texts of any length
    count whole; repeated rows are rows, and rows of equal place (which is a hash of the id) and id
    are read equally often; an empty table gives no row; other columns play no part. See ``plan`` for
    the options.
    """
    narrow, sources = plan(docs, seed=seed, **options)
    joined = common.join_hot(narrow, sources.drop("tokens"), "key", "docs", max(narrow.count(), 1))
    return joined.select("doc_id", "source", F.col("tokens").alias("n_tokens"), "weight", _copies(F.col("place"), F.col("doc_id"), seed).alias("copies"))


def mixed(docs: DataFrame, *, seed: int = 1, **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix reads it (odd rows as in ``mix``)."""
    narrow, sources = plan(docs, seed=seed, **options)
    shaped = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), source_key(docs["source"]).alias("key"), F.xxhash64(docs["doc_id"], F.lit(seed)).alias("place"))
    joined = common.join_hot(shaped, sources, "key", "docs", max(narrow.count(), 1))
    read = joined.select("row", _copies(F.col("place"), F.col("row.doc_id"), seed).alias("copies")).where("copies > 0")
    return read.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("n")).select("row.*")
