"""What filters do to each other: all coalitions' removals, step counts of every order, exact Shapley shares."""

from __future__ import annotations

import itertools
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, col

#: Filters of which all orders are listed; their number grows as the factorial.
MOST_FILTERS = 6


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions of a text, null being empty: few words, few distinct words, many capitals, odd signs."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    clean = F.btrim(text, F.lit(BLANKS))
    words = F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, r"[\x20\x09-\x0D]+"))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 2 * F.char_length(text).cast("long"), "D": text.rlike(r"[#$%&*|]")}


def coalition_weights(n: int) -> list[list[Fraction]]:
    """For each of n filters the weight of each coalition's worth in its Shapley share.

    The shares are the efficient additive game nearest to the given one under the Shapley kernel: with z the members of
    a coalition S and k its kernel weight they solve (sum k z z') x = sum k z v(S) - m, where m, the same for all, makes
    them sum to the worth of all. Solved in fractions for unit games, once: the shares are linear in the worths.
    """
    full = (1 << n) - 1
    if n == 1:
        return [[Fraction(0), Fraction(1)]]
    inner = [s for s in range(1, full)]
    kernel = {s: Fraction(n - 1, math.comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in inner}
    a = [[sum((kernel[s] for s in inner if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(n)] for i in range(n)]
    rows = [a[i] + [Fraction(int(i == j)) for j in range(n)] for i in range(n)]
    for i in range(n):  # Gauss-Jordan: rows become the inverse
        p = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[p] = rows[p], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    inverse = [r[n:] for r in rows]
    total = sum(map(sum, inverse), Fraction(0))
    out = [[Fraction(0)] * (full + 1) for _ in range(n)]
    for s in [*inner, full]:
        b = [kernel[s] * (s >> i & 1) if s != full else Fraction(0) for i in range(n)]
        free = [sum((inverse[i][j] * b[j] for j in range(n)), Fraction(0)) for i in range(n)]
        miss = (sum(free, Fraction(0)) - (s == full)) / total
        for i in range(n):
            out[i][s] = free[i] - miss * sum(inverse[i], Fraction(0))
    return out


def failing(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column], copies: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail, bit k for the k-th.

    `copies` names one more filter, failed by a text that a row with a smaller id has as well. Of a row only its id,
    part, text hash and mask are shuffled. Rows alike in these are counted before they meet their label or their text's
    least id, so neither a hot text nor a hot part is gathered.
    """
    mask = F.lit(0)
    for k, when in enumerate(conditions.values()):
        mask = mask + F.when(when, F.lit(1 << k)).otherwise(F.lit(0))
    slim = docs.select(col(id_col).alias("id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary"), 256)).alias("key"), mask.alias("mask"))
    one = slim.groupBy("id", "part", "key", "mask").agg(F.count("*").alias("c"))
    known = labels.filter(col(id_col).isNotNull()).groupBy(col(id_col).alias("id")).agg(F.coalesce(F.bool_or(col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(col("toxic") == 1), F.lit(False)).alias("toxic"))
    one = one.join(known, "id", "left").select("id", "part", "key", "mask", "c", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    has = F.col("id").isNotNull()
    x = one.groupBy("key", "part", "mask", "good", "toxic").agg(F.sum("c").alias("c"), F.coalesce(F.sum(F.when(has, F.col("c"))), F.lit(0)).alias("named"), F.min(F.when(has, F.struct("id", "c"))).alias("first"))
    if copies:
        least = F.min("first.id").over(Window.partitionBy("key"))
        x = x.withColumn("copied", F.col("named") - F.when(F.col("first.id") == least, F.col("first.c")).otherwise(F.lit(0)))
        parts = F.array(F.struct(F.col("mask"), (F.col("c") - F.col("copied")).alias("n")), F.struct((F.col("mask") + F.lit(1 << len(conditions))).alias("mask"), F.col("copied").alias("n")))
        x = x.select("part", "good", "toxic", F.inline(parts))
    else:
        x = x.select("part", "good", "toxic", "mask", F.col("c").alias("n"))
    n = F.col("n")
    return x.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), n).otherwise(F.lit(0))).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(F.lit(0))).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column] | None = None, copies: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), a row for each part, order and step.

    `conditions` are failure conditions by one-letter names (default: text_conditions). From the documents of each part
    by the filters they fail come the removals of every coalition of filters; a step of an order is the difference of
    two of them, and a filter's Shapley share, times the number of orders, the weighted sum of all. Counts are exact.

    Null and empty parts are one part, ''; a null text is empty and a copy of any other empty one. A row without an id has
    no label, is no copy and makes none; rows that repeat, id and all, are documents each, and none is the other's copy.
    A document counts as good or toxic if any of its label rows says so. No documents: no rows. Columns but the four
    named are not read. A text is split into words within its row: memory grows with the longest text, not with the table.
    """
    conditions = conditions or text_conditions(col(text_col))
    names = [*conditions, *([copies] if copies else [])]
    n = len(names)
    if not 0 < n <= MOST_FILTERS or any(len(x) != 1 for x in names):
        raise ValueError(f"1 to {MOST_FILTERS} filters with names of one letter")
    full = (1 << n) - 1
    weights = [[int(w * math.factorial(n)) for w in row] for row in coalition_weights(n)]  # whole numbers: n! clears the fractions
    x = failing(docs, labels, conditions, copies, id_col, text_col, part_col)
    x = x.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2 ** n at most
    worth = lambda k: F.transform(F.lit(list(range(full + 1))), lambda s: F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(c["mask"].bitwiseAND(s) != 0, c[k]).otherwise(F.lit(0))))
    x = x.select("part", F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("all"), worth("n").alias("v"), worth("good").alias("g"), worth("toxic").alias("t"))
    orders = ["".join(p) for p in itertools.permutations(names)]
    x = x.select("*", F.explode(F.lit(orders)).alias("filter_order")).select("*", F.explode(F.lit(list(range(1, n + 1)))).alias("step"))
    letters = F.split("filter_order", "")
    x = x.withColumn("me", F.instr(F.lit("".join(names)), F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("bit", F.get(F.lit([1 << k for k in range(n)]), F.col("me") - 1))
    x = x.withColumn("s", F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda a, c: a + F.get(F.lit([1 << k for k in range(n)]), F.instr(F.lit("".join(names)), c) - 1)))
    at = lambda k, s: F.get(k, s)
    after = F.col("s") + F.col("bit")
    step = lambda k: at(k, after) - at(k, F.col("s"))
    share = F.aggregate(F.zip_with("v", F.get(F.array(*[F.lit(row) for row in weights]), F.col("me") - 1), lambda v, w: v * w), F.lit(0).cast("long"), lambda a, y: a + y)
    return x.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), (F.col("all") - at("v", after)).alias("kept"), step("v").alias("removed"), (at("v", F.col("bit")) - step("v")).alias("redundant"),
        (at("v", F.lit(full)) - at("v", F.lit(full) - F.col("bit"))).alias("unique_fails"), step("g").alias("good_lost"), step("t").alias("toxic_lost"), share.alias("shapley"))
