"""Line deduplication: repeated long lines stay in one document only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, col, maybe_broadcast, row_key, written

_WORD = 64


def line_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """(h1, h2, id, rid, pos, first): where each line key of at least `min_chars` code points stands.

    Hashes are range-partitioned together with the document, so that a line that most documents hold
    is spread over many tasks, and sorted by document and position: windows over a document's
    occurrences of a key need neither another shuffle nor another sort, and the first of them streams by.
    """
    rows = docs.select(
        col(id_col).alias("id"),
        row_key(col(id_col), col(text_col)).alias("rid"),
        F.posexplode(F.split(F.coalesce(col(text_col), F.lit("")), "\n", -1)).alias("pos", "line"),
    )
    key = rows.withColumn("line", F.trim(F.col("line"), F.lit(BLANKS))).filter(F.char_length("line") >= min_chars)
    key = key.withColumn("line", ascii_lower(F.col("line")))
    hashed = key.select("id", "rid", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    ranged = hashed.repartitionByRange(F.col("h1"), F.col("h2"), F.col("id"), F.col("rid")).sortWithinPartitions("h1", "h2", "id", "rid", "pos")
    return ranged.withColumn("first", F.row_number().over(Window.partitionBy("h1", "h2", "id", "rid").orderBy("pos")) == 1)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, rid, dropped): for each document that loses lines, the compressed bitmap of those lines.

    `dropped` holds a struct (word, bits) for each run of 64 lines in which a line goes; a run that is
    not listed is kept whole. A key goes if at least `min_docs` documents hold it, from all of them
    but the one with the largest id. Equal ids count as one document; a null id is the smallest.
    """
    found = written(line_occurrences(docs, id_col, text_col, min_chars), "lines")
    # Counts are summed in each task first: a hot line adds one row a task.
    per_doc = found.filter("first").groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    heavy = per_doc.groupBy("h1", "h2").agg(F.count("one").alias("n_docs"), F.max("id").alias("last_id")).filter(F.col("n_docs") >= min_docs)
    heavy = maybe_broadcast(written(heavy.select("h1", "h2", "last_id"), "heavy"))
    gone = found.join(heavy, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("last_id")))
    bits = gone.select("id", "rid", F.floor(F.col("pos") / _WORD).cast("int").alias("word"), F.expr(f"shiftleft(1L, CAST(pos % {_WORD} AS INT))").alias("bit"))
    words = bits.groupBy("id", "rid", "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy("id", "rid").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The documents with n_lines, n_dropped, dropped (see keep_bitmaps; null: none) and kept_text.

    A null or empty text is one empty line and stays as it is (kept_text ''). Rows that repeat give
    equal rows. Very long texts are split whole. Other columns, of any name but those four, pass through.
    """
    gone = maybe_broadcast(written(keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), "bitmaps").withColumnsRenamed({"id": "__tally_id", "rid": "__tally_rid", "dropped": "__tally_dropped"}))
    d = docs.drop("n_lines", "n_dropped", "dropped", "kept_text")
    text = F.coalesce(col(text_col), F.lit(""))
    d = d.withColumn("__tally_key", row_key(col(id_col), col(text_col)))
    out = d.join(gone, (F.col("__tally_key") == F.col("__tally_rid")) & col(id_col).eqNullSafe(F.col("__tally_id")), "left")
    lines = F.split(text, "\n", -1)
    # A column of its own, and named twice so that it stays one: inside filter() the map would be made anew for each line.
    out = out.withColumn("__tally_map", F.map_from_entries(F.col("__tally_dropped")))
    by_word = F.coalesce(F.col("__tally_map"), F.col("__tally_map"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (i % _WORD).cast("int"))
    kept = F.filter(lines, lambda line, i: F.coalesce(F.try_element_at(by_word, F.floor(i / _WORD).cast("int")), F.lit(0).cast("long")).bitwiseAND(bit(i)) == 0)
    return out.select(
        *[col(c) for c in d.columns if c != "__tally_key"],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("__tally_dropped", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w["bits"])), F.lit(0).cast("long")).alias("n_dropped"),
        F.col("__tally_dropped").alias("dropped"),
        F.when(F.col("__tally_dropped").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
