"""Benchmark decontamination: a prefix-filtered join of item windows with the word shingles of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, col, maybe_broadcast, row_key, written

#: Fixed value: what stands between words (after A-Z are lower-cased).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased and no other letter, so that a word is the same wherever it stands."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), lambda w: w != "")


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """(item_id, window): every `window` consecutive words of an item; a shorter item, if not empty, is one window."""
    w = benchmark.select(col(item_col).cast("string").alias("item_id"), words(col(text_col)).alias("words")).filter((F.size("words") > 0) & F.col("item_id").isNotNull())
    at = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(at, lambda i: F.slice("words", i, window))).alias("window")).distinct()


def shingles(words_col: str, width: int) -> Column:
    """(at, shingle) of each run of `width` words, hashed; `at` counts from 0."""
    w = F.col(words_col)
    at = F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(width), F.slice(w, i + 1, width)).alias("shingle")))


def find_windows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, width: int = 5) -> DataFrame:
    """(id, rid, hits): for documents with any, the distinct (item_id, start, len) of occurring windows.

    A window is the set of its shingles of `width` words (fewer, if it has fewer), ordered by how often
    the documents hold them. It must be contained whole, so one token is the necessary prefix: the
    rarest. Documents join on it; the bounds of position and length (the window must fit around the
    shingle) prune; the words in place are then compared.
    """
    wins = written(item_windows(benchmark, item_col, item_text_col, window), "windows")
    # As a rule every window is longer than `width`; else each width that occurs has its shingles, `width` at most.
    widths = sorted(r["k"] for r in wins.select(F.least(F.size("window"), F.lit(width)).alias("k")).distinct().collect())
    own = F.lit(None).cast("array<struct<at:int,shingle:bigint>>")
    for k in widths:
        own = F.when(F.least(F.size("window"), F.lit(width)) == k, shingles("window", k)).otherwise(own)
    placed = written(wins.select("item_id", "window", F.explode(own).alias("s")).select("item_id", "window", "s.*"), "shingles")
    sought = maybe_broadcast(written(placed.select("shingle").distinct(), "sought"))
    # One pass over all words: the places of shingles that any window holds.
    rows = docs.select(col(id_col).alias("id"), row_key(col(id_col), col(text_col)).alias("rid"), col(text_col).alias("text"))
    spoken = rows.select("id", "rid", words(F.col("text")).alias("words"))
    runs = F.concat(*[F.coalesce(shingles("words", k), F.array().cast("array<struct<at:int,shingle:bigint>>")) for k in widths]) if widths else F.array().cast("array<struct<at:int,shingle:bigint>>")
    spots = written(spoken.select("id", "rid", F.explode(runs).alias("s")).select("id", "rid", F.col("s.at").alias("pos"), "s.shingle").join(sought, "shingle", "left_semi").distinct(), "spots")
    counts = spots.groupBy("shingle").agg(F.count("*").alias("n"))
    ranked = placed.join(maybe_broadcast(written(counts, "counts")), "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    anchors = ranked.groupBy("item_id", "window").agg(F.min_by(F.struct("shingle", "at"), F.struct("n", "at")).alias("a"), F.min("n").alias("least"))
    # A window of which a shingle is in no document occurs nowhere.
    anchors = written(anchors.filter("least > 0").select("item_id", "window", "a.shingle", "a.at"), "anchors")
    near = spots.join(maybe_broadcast(anchors.select("shingle").distinct()), "shingle", "left_semi")
    held = near.groupBy("id", "rid").agg(F.collect_list(F.struct("shingle", "pos")).alias("spots"))
    held = maybe_broadcast(written(held.withColumnsRenamed({"id": "__tally_id", "rid": "__tally_rid"}), "held"))
    d = rows.join(held, (F.col("rid") == F.col("__tally_rid")) & F.col("id").eqNullSafe(F.col("__tally_id"))).dropDuplicates(["id", "rid"]).select("id", "rid", words(F.col("text")).alias("words"), "spots")
    # Only the words around a spot travel on, not the text: window words each way suffice.
    low = lambda s: F.greatest(s["pos"] - (window - 1), F.lit(0))
    wide = d.select("id", "rid", F.size("words").alias("n"), F.explode(F.transform("spots", lambda s: F.struct(
        s["shingle"].alias("shingle"), s["pos"].alias("pos"), low(s).alias("low"), F.slice("words", low(s) + 1, 2 * window - 1).alias("around")))).alias("s")).select("id", "rid", "n", "s.*")
    c = wide.join(maybe_broadcast(anchors), "shingle")
    start, length = F.col("pos") - F.col("at"), F.size("window")
    c = c.filter((start >= 0) & (start + length <= F.col("n"))).filter(F.slice("around", F.greatest(start - F.col("low"), F.lit(0)) + 1, length) == F.col("window"))
    return c.groupBy("id", "rid").agg(F.array_sort(F.collect_set(F.struct("item_id", start.alias("start"), length.alias("len")))).alias("hits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """The documents with n_words, n_hit, items (sorted ids), spans (item_id, start, len) and contaminated.

    A word is hit if it lies in any occurrence of a window; contaminated: n_hit > 0 and
    `share` * n_hit >= n_words. Null or empty text: no words, nothing hit. Items without words or with
    a null id are not searched; items with equal ids are searched as one. Very long texts are split
    whole. Repeated rows give equal rows; other columns, of any name but those five, pass through.
    """
    hits = find_windows(docs, benchmark, id_col, text_col, item_col, item_text_col, window)
    hits = maybe_broadcast(written(hits.withColumnsRenamed({"id": "__tally_id", "rid": "__tally_rid", "hits": "__tally_hits"}), "hits"))
    d = docs.drop("n_words", "n_hit", "items", "spans", "contaminated")
    out = d.withColumn("__tally_key", row_key(col(id_col), col(text_col))).join(hits, (F.col("__tally_key") == F.col("__tally_rid")) & col(id_col).eqNullSafe(F.col("__tally_id")), "left")
    spans = F.array_distinct(F.transform("__tally_hits", lambda h: F.struct(h["start"].alias("start"), h["len"].alias("len"))))
    covered = F.size(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))))
    # Counting the gaps is enough here: the letters of a word do not matter.
    n_words = F.size(F.filter(F.split(F.lower(F.coalesce(col(text_col), F.lit(""))), BETWEEN, -1), lambda w: w != "")).cast("long")
    out = out.select(
        *[col(c) for c in d.columns],
        n_words.alias("n_words"),
        F.when(F.col("__tally_hits").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_hit"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("__tally_hits", lambda h: h["item_id"]))), F.array().cast("array<string>")).alias("items"),
        F.col("__tally_hits").alias("spans"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
