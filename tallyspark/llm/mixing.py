"""Mixing sources to target weights by temperature, and drawing the documents in block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, maybe_broadcast, row_key, written


def n_tokens(text: Column) -> Column:
    """Number of words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_tokens(docs: DataFrame, source_col: str = "source", tokens_col: str = "n_tokens") -> DataFrame:
    """(source, docs, tokens). A null source is a source of its own."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("docs"), F.sum(tokens_col).alias("tokens"))


def _measures(shares: DataFrame, exponents: list[float], budget: float) -> dict:
    """For each exponent the entropy of the weights and the largest repetition, in one aggregate."""
    aggs = []
    for k, t in enumerate(exponents):
        aggs += [F.sum(F.pow("p", F.lit(t))).alias(f"z{k}"), F.sum(F.pow("p", F.lit(t)) * t * F.log("p")).alias(f"s{k}"), F.max(F.pow("p", F.lit(t)) / F.col("tokens")).alias(f"r{k}")]
    got = shares.agg(*aggs).first()
    out = {}
    for k, t in enumerate(exponents):
        z = got[f"z{k}"]
        out[t] = (math.log(z) - got[f"s{k}"] / z, got[f"r{k}"] / z * budget)
    return out


def bisect_exponent(shares: DataFrame, budget: float, entropy: float | None = None, most_repeats: float | None = None, steps: int = 14, fan: int = 15) -> float:
    """The exponent in [0, 1] for shares (p, tokens): the largest that reaches `entropy` (a share of the
    log of the number of sources), or the smallest that keeps every source within `most_repeats` passes.

    With both, repetition has the last word; an error if not even exponent 1 keeps within it. Entropy falls and repetition falls as the exponent rises,
    so an interval is cut until it is narrow; each aggregate tries `fan` exponents at once.
    """
    n = shares.count()
    goal = None if entropy is None else entropy * math.log(max(n, 1))

    def search(ok, low, high):
        """Largest t in [low, high] with ok(t), if ok holds from low up to some t; low if nowhere."""
        for _ in range(max(1, math.ceil(steps * math.log(2) / math.log(fan + 1)))):
            grid = [low + (high - low) * (k + 1) / (fan + 1) for k in range(fan)]
            got = _measures(shares, grid, budget)
            good = [t for t in grid if ok(*got[t])]
            if good:
                top = max(good)
                low, high = top, min([t for t in grid if t > top], default=high)
            else:
                high = grid[0]
        return low

    if most_repeats is not None and _measures(shares, [1.0], budget)[1.0][1] > most_repeats * (1 + 1e-9):
        raise ValueError(f"a budget of {budget} tokens takes more than {most_repeats} passes at any exponent")
    t = 1.0
    if goal is not None:
        at_one = _measures(shares, [1.0], budget)[1.0]
        t = 1.0 if at_one[0] >= goal else search(lambda h, _: h >= goal, 0.0, 1.0)
    if most_repeats is not None:
        start = 0.0 if goal is None else t
        at = _measures(shares, [start], budget)[start]
        if at[1] > most_repeats:
            # The smallest t from `start` that keeps within the limit: one step past the largest that does not.
            low, high = start, 1.0
            for _ in range(max(1, math.ceil(steps * math.log(2) / math.log(fan + 1)))):
                grid = [low + (high - low) * (k + 1) / (fan + 1) for k in range(fan)]
                got = _measures(shares, grid, budget)
                bad = [x for x in grid if got[x][1] > most_repeats]
                low, high = (max(bad), min([x for x in grid if x > max(bad)], default=high)) if bad else (low, grid[0])
            t = high
        else:
            t = start
    return t


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", budget: int | None = None, entropy: float | None = 0.98, most_repeats: float | None = 4.0, seed: int = 7, block_docs: int = 256) -> DataFrame:
    """The drawn documents: docs' columns with mix_tokens, mix_weight, mix_epoch and mix_offset.

    Weights are source token shares to the power found by bisect_exponent, normalised; a source's budget
    is its weight times `budget` tokens (default: all tokens there are). A source is read block by block
    in an order permuted anew for each pass; a document is drawn in a pass while the tokens before it,
    whole passes included, are fewer than the budget. mix_offset is that number, so rows ordered by it
    are the source's stream. Documents without words (null, empty, blank) are drawn in the first pass. A
    null source is a source. Rows that repeat are drawn each for itself. No documents: no rows. Other
    columns, of any name but those four, pass through. Very long texts count as any other.

    A block holds about `block_docs` documents, dealt by hash: running sums are taken within blocks and
    over block totals, never over a source's documents in one task.
    """
    d = docs.drop("mix_tokens", "mix_weight", "mix_epoch", "mix_offset")
    key = row_key(col(id_col), col(source_col), col(text_col))
    slim = d.select(col(id_col).alias("id"), col(source_col).alias("source"), key.alias("key"), n_tokens(col(text_col)).alias("n_tokens"))
    # Rows that repeat are one entry that counts several times.
    slim = written(slim.groupBy("id", "source", "key").agg(F.max("n_tokens").alias("one"), F.count("*").alias("times")).withColumn("n_tokens", F.col("one") * F.col("times")), "lengths")
    sources = source_tokens(slim, "source")
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    budget = total if budget is None else budget
    shares = written(sources.filter("tokens > 0").select("source", "docs", "tokens", (F.col("tokens") / max(total, 1)).alias("p")), "shares")
    t = bisect_exponent(shares, budget, entropy, most_repeats) if total else 1.0
    z = shares.agg(F.sum(F.pow("p", F.lit(t))).alias("z")).first()["z"] or 1.0
    weights = sources.join(shares.select(F.col("source").alias("__tally_s"), "p"), F.col("source").eqNullSafe(F.col("__tally_s")), "left").select(
        "source", "docs", "tokens", F.coalesce(F.pow("p", F.lit(t)) / z, F.lit(0.0)).alias("weight"))
    weights = weights.withColumn("budget", F.floor(F.col("weight") * budget + 0.5)).withColumn("epochs", F.when(F.col("tokens") > 0, F.ceil(F.col("budget") / F.col("tokens"))).otherwise(1))
    weights = weights.withColumn("epochs", F.greatest("epochs", F.lit(1))).withColumn("blocks", F.ceil(F.col("docs") / block_docs))
    w = weights.select(F.col("source").alias("__tally_s"), "tokens", "weight", "budget", "epochs", "blocks")
    dealt = slim.join(maybe_broadcast(written(w, "weights")), F.col("source").eqNullSafe(F.col("__tally_s"))).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("blocks")))
    blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("held"), *[F.max(c).alias(c) for c in ("tokens", "weight", "budget", "epochs", "blocks")])
    passes = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    # The order of blocks is that of `turn`; running sums go over stretches of it and within a stretch.
    passes = passes.withColumn("turn", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "epoch", "block"), 33)).withColumn("stretch", F.shiftright(F.col("turn") * F.ceil(F.sqrt("blocks")), 31))
    ahead = lambda *by, order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = passes.groupBy("source", "epoch", "stretch").agg(F.sum("held").alias("all"))
    sums = sums.select(F.col("source").alias("__tally_s"), F.col("epoch").alias("__tally_e"), F.col("stretch").alias("__tally_t"), F.coalesce(F.sum("all").over(ahead("source", "epoch", order=["stretch"])), F.lit(0)).alias("before"))
    start = passes.join(sums, F.col("source").eqNullSafe(F.col("__tally_s")) & (F.col("epoch") == F.col("__tally_e")) & (F.col("stretch") == F.col("__tally_t")))
    within = F.coalesce(F.sum("held").over(ahead("source", "epoch", "stretch", order=["turn", "block"])), F.lit(0))
    start = start.withColumn("start", F.col("epoch") * F.col("tokens") + F.col("before") + within).filter((F.col("start") < F.col("budget")) | (F.col("epoch") == 0))
    start = start.select(F.col("source").alias("__tally_s"), F.col("block").alias("__tally_b"), "epoch", "start", "weight", "budget")
    rows = dealt.select("id", "key", "source", "block", "n_tokens", "one", "times").join(start, F.col("source").eqNullSafe(F.col("__tally_s")) & (F.col("block") == F.col("__tally_b")))
    inside = Window.partitionBy("source", "block", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "key"), "key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.col("start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    drawn = rows.filter((F.col("offset") < F.col("budget")) | ((F.col("one") == 0) & (F.col("epoch") == 0)))
    # The entry's copies share its place; each is a row of docs and meets it by key.
    drawn = drawn.select(F.col("id").alias("__tally_id"), F.col("source").alias("__tally_source"), F.col("key").alias("__tally_key"), F.col("one").alias("mix_tokens"), F.col("weight").alias("mix_weight"), F.col("epoch").cast("int").alias("mix_epoch"), F.col("offset").alias("mix_offset"))
    out = d.withColumn("__tally_k", key).join(drawn, (F.col("__tally_k") == F.col("__tally_key")) & col(id_col).eqNullSafe(F.col("__tally_id")) & col(source_col).eqNullSafe(F.col("__tally_source")))
    return out.select(*[col(c) for c in d.columns], "mix_tokens", "mix_weight", "mix_epoch", "mix_offset")
