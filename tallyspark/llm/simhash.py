"""SimHash fingerprints of texts, and search of all fingerprints within a Hamming radius."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import col, maybe_broadcast, row_key, written

BITS = 64
_LANES = 0x0000000100000001


def term_hashes(docs: DataFrame, keys: list[str], text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(keys, h): hashes of the runs of `shingle` words of each text, one for each place; fewer words are one run.

    Words are a column of their own: inside transform() they would be split anew for each run.
    """
    w = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    at = F.sequence(F.lit(1), F.greatest(F.size("_w") - shingle + 1, F.lit(1)))
    runs = F.transform(at, lambda i: F.xxhash64(F.slice("_w", i, shingle)))
    return docs.select(*keys, w.alias("_w")).select(*keys, F.explode(runs).alias("h"))


def vote(hashes: DataFrame, keys: list[str], hash_col: str = "h") -> DataFrame:
    """(keys, fingerprint): the sign of the votes of each bit. A term weighs as often as it stands there.

    Two bits share a 64-bit sum, 32 bits each, so 32 sums count all 64 bits; partial sums are made
    before rows are shuffled. A tie votes 0.
    """
    h = F.col(hash_col)
    sums = [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES))).alias(f"_s{k}") for k in range(32)]
    counted = hashes.groupBy(*keys).agg(F.count("*").alias("_n"), *sums)
    bits = []
    for k in range(32):
        low, high = F.col(f"_s{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"_s{k}"), 32)
        bits += [F.when(2 * low > F.col("_n"), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")]
        value = (1 << (k + 32)) - (1 << 64 if k == 31 else 0)
        bits += [F.when(2 * high > F.col("_n"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long"))]
    fp = bits[0]
    for b in bits[1:]:
        fp = fp.bitwiseOR(b)
    return counted.select(*keys, fp.alias("fingerprint"))


def fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(keys, fingerprint long) for each distinct key; null text is empty. Equal texts have equal fingerprints."""
    return vote(term_hashes(docs, keys, text_col, shingle), keys)


def likeness(a: Column, b: Column) -> Column:
    """1 - Hamming distance / 64."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / BITS


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def blocks_of(n_blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of nearly equal blocks of the 64 bits."""
    edges = [round(i * BITS / n_blocks) for i in range(n_blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def within_radius(queries: DataFrame, table: DataFrame, radius: int = 3, n_blocks: int = 6) -> DataFrame:
    """(query, fingerprint, distance): all distinct fingerprints of `table` within `radius` bits of those of `queries`.

    Of `n_blocks` blocks at most `radius` differ, so n_blocks - radius agree: one table for each choice
    of that many blocks, permuted to the front as the join key. A pair is given by the first table in
    which it agrees, so none is given twice. More blocks make keys longer and buckets smaller.
    Both inputs need a long column `fingerprint`; a fingerprint equal to the query counts too.
    """
    cut = blocks_of(n_blocks)
    tables = list(combinations(range(n_blocks), n_blocks - radius))

    def part(fp: Column, b: int) -> Column:
        shift, width = cut[b]
        return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))

    def permuted(df: DataFrame, name: str) -> DataFrame:
        fp = F.col("fingerprint")
        keyed = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(*[part(fp, b) for b in bs]).alias("key")) for t, bs in enumerate(tables)])
        return df.select("fingerprint").distinct().select(fp.alias(name), F.explode(keyed).alias("k")).select(name, "k.t", "k.key")

    q, s = F.col("query"), F.col("fingerprint")
    same = [part(q.bitwiseXOR(s), b) == 0 for b in range(n_blocks)]
    first = F.lit(None).cast("int")
    for t, bs in reversed(list(enumerate(tables))):
        agree = same[bs[0]]
        for b in bs[1:]:
            agree = agree & same[b]
        first = F.when(agree, F.lit(t)).otherwise(first)
    # A merge join: neither side is small at scale, and one fingerprint's bucket can be split when it is hot.
    on = permuted(queries, "query").hint("merge").join(permuted(table, "fingerprint"), ["t", "key"])
    distance = F.bit_count(q.bitwiseXOR(s))
    return on.filter((distance <= radius) & (F.col("t") == first)).select("query", "fingerprint", distance.alias("distance"))


def range_cuts(ids: DataFrame, parts: int, total: int, sampled: int = 20) -> list:
    """Ascending ids that cut rows (id, weight), `total` by weight, in about `parts` ranges of like weight; of any type that has an order.

    Numbers are cut at approximate quantiles. Of others some `sampled` ids a range come to the driver, chosen by a hash
    with a chance that grows with their weight; that moves the cuts, never a row.
    """
    if isinstance(ids.schema["id"].dataType, NumericType):
        weighed = ids.select("id", F.explode(F.array_repeat(F.lit(0), F.col("weight"))))
        return sorted(set(weighed.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10000).alias("c")).first()["c"] or []))
    one_in = max(1, total // (parts * sampled))
    some = ids.filter(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(one_in)) < F.col("weight"))).select("id").distinct().sort("id").limit(4 * parts * sampled)
    picked = [r["id"] for r in some.collect()]
    return picked[sampled::sampled] if len(picked) > sampled else []


def asked(id_: Column, kind, step: int) -> Column:
    """Whether a row's neighbours are asked for: those of ids that `step` divides, of ids that are no numbers those of such hashes."""
    return (id_ if isinstance(kind, NumericType) else F.crc32(id_.cast("string").cast("binary"))) % step == 0


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_a_bucket: int = 4000, most_buckets: int = 4096) -> DataFrame:
    """(bucket, pos, id, rid, text, next_id, next_rid, next_text): each row with the one after it by descending id; after the last the first.

    Ids are cut at quantiles weighted by the lengths of the texts, so each window sorts one range of
    about as many characters; only a range's first row is looked up by the range before. Null ids come
    last; of equal ids the larger row hash comes first.
    """
    d = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text")).withColumn("rid", row_key(F.col("id"), F.col("text")))
    # A row weighs 1, and 1 for each 2,000 characters.
    weight = (F.floor(F.coalesce(F.char_length(col(text_col)), F.lit(0)) / 2000) + 1).cast("int")
    n = docs.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, min(most_buckets, n // rows_a_bucket))
    cuts = range_cuts(docs.select(col(id_col).alias("id"), weight.alias("weight")), parts, n) if parts > 1 else []
    bucket = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("id"))), F.lit(-1)) if cuts else F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.lit(0))
    d = d.withColumn("bucket", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(bucket))
    order = [F.col("id").desc_nulls_last(), F.col("rid").desc()]
    w = Window.partitionBy("bucket").orderBy(*order)
    head = d.groupBy("bucket").agg(F.max_by(F.struct("id", "rid", "text"), F.struct("id", "rid")).alias("head"))
    # One row for each range; the range before the lowest is the highest.
    ends = written(head, "heads")
    all_buckets = sorted(r["bucket"] for r in ends.select("bucket").collect())
    step = {b: all_buckets[i - 1] for i, b in enumerate(all_buckets)}
    asks = F.create_map(*[F.lit(x) for pair in step.items() for x in pair]) if step else F.create_map(F.lit(0), F.lit(0))
    seen = d.withColumn("next", F.lead(F.struct("id", "rid", "text")).over(w)).withColumn("pos", F.row_number().over(w))
    last = F.when(F.col("next").isNull(), asks[F.col("bucket")])
    ends = ends.select(F.col("bucket").alias("at"), "head")
    out = seen.withColumn("at", last).join(maybe_broadcast(ends), "at", "left")
    nxt = F.coalesce("next", "head")
    return out.select("bucket", "pos", "id", "rid", "text", nxt["id"].alias("next_id"), nxt["rid"].alias("next_rid"), nxt["text"].alias("next_text"))


def edited(text: Column, other: Column) -> Column:
    """The text with its last third (rounded down, code points) replaced by the first as many of another (or all)."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(other, F.lit(1), third))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, n_blocks: int = 6, query_step: int = 20) -> DataFrame:
    """One row for each document: its fingerprint, that of its edited text, and how alike they are.

    near_edited and near_next are 1 - distance / 64 to the edited text's and the next document's
    fingerprint. n_near: for documents whose id `query_step` divides, how many distinct fingerprints
    of all documents lie within `radius` bits, its own included; null for the others. Ids may be of any type with an order:
    of those that are no numbers, the ones whose crc32 `query_step` divides are asked for. Null text is
    empty; the empty text has a fingerprint like any other. Rows that repeat each have their row. A lone
    document is its own next. Very long texts are read whole. Columns but the id and the text are not read.
    """
    rows = with_next(docs, id_col, text_col)
    row = ["bucket", "pos", "id", "rid", "next_id", "next_rid"]
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), edited(F.col("text"), F.col("next_text")).alias("text")))
    side = rows.select(*row, F.explode(both).alias("b")).select(*row, "b.*")
    side = side.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("sha", F.when(F.col("which") == 1, F.sha2(F.col("text").cast("binary"), 256)))
    votes = fingerprints(side, [*row, "which", "n_chars", "sha"], "text")
    per_row = votes.groupBy(*row).agg(
        F.max(F.when(F.col("which") == 0, F.col("n_chars"))).alias("n_chars"), F.max("sha").alias("sha"),
        F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited"))
    made = written(per_row, "fingerprints")
    nexts = made.select(F.col("id").alias("_id"), F.col("rid").alias("_rid"), F.col("fingerprint").alias("next_fp")).dropDuplicates(["_id", "_rid"])
    kind = docs.schema[id_col].dataType
    asks = made.filter(asked(F.col("id"), kind, query_step))
    near = within_radius(asks, made, radius, n_blocks).groupBy("query").agg(F.count("*").alias("n_near"))
    out = made.join(nexts, (F.col("next_rid") == F.col("_rid")) & F.col("next_id").eqNullSafe(F.col("_id")), "left")
    out = out.join(near, F.col("fingerprint") == F.col("query"), "left")
    return out.select(
        "id", "n_chars", F.col("sha").alias("edited_sha256"), as_hex(F.col("fingerprint")).alias("fingerprint"), as_hex(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"),
        F.when(asked(F.col("id"), kind, query_step), F.col("n_near")).alias("n_near"),
    ).withColumnRenamed("id", id_col)
