"""Sharding over fixed virtual slots: records hash into slots, a versioned map gives slots to shards and is edited to rebalance."""

from __future__ import annotations

import heapq
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, row_key, shared_dir, written

#: Virtual slots never change once records lie in them; a map of them is held by the driver and sent to every task.
SLOTS, MOST_SLOTS = 8192, 65_536
#: Bytes a record takes besides its text.
RECORD_BYTES = 16
_COPIES = 65_536


def records(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, key, copy, virtual_slot) of every row.

    The slot is a hash of id, text and, among rows that repeat, a number: so many equal rows, or rows without an id,
    spread over slots as any others. Equal rows are counted in partial sums, not gathered.
    """
    if not 0 < slots <= MOST_SLOTS:
        raise ValueError(f"slots must lie between 1 and {MOST_SLOTS}")
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    one = docs.select(col(id_col).alias("id"), (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), row_key(col(id_col), col(text_col)).alias("key"))
    n = F.col("n")
    many = one.groupBy("id", "size", "text_crc32", "key").agg(F.count("*").alias("n"))
    many = many.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / _COPIES))))
    many = many.withColumn("copy", F.explode(F.sequence(F.col("part") * _COPIES, F.least(n, (F.col("part") + 1) * _COPIES) - 1)))
    return many.select("id", "size", "text_crc32", "key", "copy", F.pmod(F.xxhash64("key", "copy"), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """(bytes, rows) of each slot: one aggregate of at most `slots` rows."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
        size[r["virtual_slot"]], count[r["virtual_slot"]] = r["size"], r["n"]
    return size, count


def even_map(slots: int, shards: int) -> list[int]:
    """Each shard one stretch of the slots: the map before anything is known of their sizes."""
    return [s * shards // slots for s in range(slots)]


def rebalanced(owner: list[int], load: list[int], shards: int, tolerance: float = 0.001) -> list[int]:
    """`owner` edited until the shards' loads are near equal, with few slots moved.

    Shards above the mean give their largest slots that fit in what they have too much, shards that are no more give
    all; each goes to the lightest shard. Then the heaviest and the lightest move or swap the slots that halve the gap
    between them best, until it is within `tolerance` of the mean or nothing helps; a shard that cannot give is left out.
    """
    owner, held = list(owner), [[] for _ in range(shards)]
    loads, mean, free = [0] * shards, sum(load) / shards, []
    for s, k in enumerate(owner):
        if k < shards:
            held[k].append(s)
            loads[k] += load[s]
        else:
            free.append(s)
    for k in range(shards):
        for s in sorted(held[k], key=lambda s: (-load[s], s)):
            if 0 < load[s] <= loads[k] - mean:
                held[k].remove(s)
                loads[k] -= load[s]
                free.append(s)
    light = [(x, k) for k, x in enumerate(loads)]
    heapq.heapify(light)
    for s in sorted(free, key=lambda s: (-load[s], s)):
        x, k = heapq.heappop(light)
        held[k].append(s)
        heapq.heappush(light, (x + load[s], k))
    loads = [0] * shards
    for x, k in light:
        loads[k] = x
    fixed: set[int] = set()  # shards that can give nothing: the one of a slot beyond the mean
    for _ in range(4 * len(owner)):
        b = int(np.argmin(loads))
        a = max((k for k in range(shards) if k not in fixed), key=lambda k: loads[k], default=b)
        gap = loads[a] - loads[b]
        if gap <= max(1, tolerance * mean):
            break
        give = np.array([load[s] for s in held[a]], np.int64)
        take = np.array([0, *sorted(load[s] for s in held[b])], np.int64)  # 0: nothing comes back
        at = np.searchsorted(take, give - gap / 2)
        best = None
        for j in (at - 1, at):
            change = give - take[np.clip(j, 0, len(take) - 1)]
            miss = np.where((change > 0) & (change < gap), np.abs(change - gap / 2), np.inf)
            i = int(np.argmin(miss)) if len(miss) else 0
            if len(miss) and miss[i] < np.inf and (best is None or miss[i] < best[0]):
                best = (miss[i], i, int(take[np.clip(j[i], 0, len(take) - 1)]))
        if best is None:
            fixed.add(a)
            continue
        s = held[a].pop(best[1])
        held[b].append(s)
        if best[2]:
            back = next(x for x in held[b] if load[x] == best[2] and x != s)
            held[b].remove(back)
            held[a].append(back)
        loads[a] -= load[s] - best[2]
        loads[b] += load[s] - best[2]
    for k, some in enumerate(held):
        for s in some:
            owner[s] = k
    return owner


def write_map(spark: SparkSession, path: str, version: int, owner: list[int], before: list[int] | None = None) -> None:
    """Adds a version of the map: (slot, shard, moved_from). One file, so it is there whole or not; a version is never written twice."""
    rows = [(s, k, before[s] if before and before[s] != k else None) for s, k in enumerate(owner)]
    spark.createDataFrame(rows, "slot int, shard int, moved_from int").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    """(version, shard of each slot), the latest version if none is asked for."""
    x = spark.read.parquet(path)
    version = x.agg(F.max("version")).first()[0] if version is None else version
    rows = x.filter(F.col("version") == version).select("slot", "shard").collect()  # at most MOST_SLOTS
    if not rows:
        raise ValueError(f"no version {version} of the map in {path}")
    return version, [r["shard"] for r in sorted(rows)]


def rebalance(spark: SparkSession, path: str, load: list[int], shards: int, tolerance: float = 0.001) -> int:
    """Edits the latest map for `shards` shards and writes it as the next version, whose number is returned."""
    version, owner = read_map(spark, path)
    write_map(spark, path, version + 1, rebalanced(owner, load, shards, tolerance), owner)
    return version + 1


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001) -> DataFrame:
    """(`id_col`, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version, next_shard) of every row of docs.

    Records hash into fixed virtual slots, whose bytes are summed; the map in `map_path` (a new one in the shared folder
    unless given) is edited by them, so the law is `bytes`: shards have near equal bytes, as near as one record allows.
    slot is a row's place in its shard, gapless from 0; next_shard is its shard in the version after that, with one shard
    more, which takes most of the rows that move. grown_shard is null, as bytes decide, not ids.

    Places are numbered within virtual slots and on the totals of slots, never over a shard in one task. Null ids are
    ids of their own; null and empty texts have no bytes; rows that repeat are rows each; no rows: no result, and the
    even map stays. Columns but the id and the text are not read, whatever their names. A text of any length is one record.
    """
    spark = docs.sparkSession
    rows = written(records(docs, slots, id_col, text_col), "records")
    size, count = slot_loads(rows, slots)
    if map_path is None:
        map_path = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
        write_map(spark, map_path, 0, even_map(slots, shards))
    version = rebalance(spark, map_path, size, shards, tolerance)
    _, owner = read_map(spark, map_path, version)
    grown = read_map(spark, map_path, rebalance(spark, map_path, size, shards + 1, tolerance))[1]
    used, table = [0] * shards, []
    for s, k in enumerate(owner):
        table.append((s, k, used[k], grown[s]))
        used[k] += count[s]
    known = spark.createDataFrame(table, "virtual_slot int, shard int, base long, next_shard int")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("key", "copy", "id", "size", "text_crc32"))
    out = rows.withColumn("place", place).join(F.broadcast(known), "virtual_slot")  # MOST_SLOTS rows at most
    return out.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"), "next_shard")
