"""The trie of conversations' prefixes, its subtree totals by time-forward processing within shards, then across their roots."""

from __future__ import annotations

import hashlib
import heapq
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, maybe_broadcast, written

#: Messages that a queue holds in memory before it spills.
HELD = 200_000
#: Levels of a piece of heavy nodes; rows below which a subtree always stays whole.
BAND, LEAST_PIECE = 64, 64
#: Ids joined to one string before the strings of a node meet.
JOINED = 8192


class SpillingQueue:
    """A priority queue of rows of six whole numbers, the first three its key. Past `held` rows the later ones go to sorted runs in files."""

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.runs, self.spilled = held, [], [], 0

    def push(self, row: tuple) -> None:
        heapq.heappush(self.heap, row)
        if len(self.heap) > self.held:
            self.heap.sort()
            keep = self.held // 4
            self._run(self.heap[keep:])
            self.heap = self.heap[:keep]

    def _run(self, rows: list[tuple], block: int = 4096) -> None:
        file = tempfile.TemporaryFile()  # nameless: gone with the task
        np.array(rows, np.int64).tofile(file)
        file.flush()
        size = 6 * 8 * block

        def read():
            at = 0
            while at < len(rows_in):
                file.seek(at * 48)
                some = np.frombuffer(file.read(size), np.int64).reshape(-1, 6)
                at += len(some)
                yield from map(tuple, some.tolist())

        rows_in = range(len(rows))
        run = read()
        self.spilled += 1
        heapq.heappush(self.runs, (next(run), self.spilled, run))

    def first(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            row, k, run = self.runs[0]
            later = next(run, None)
            if later is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (later, k, run))
            return row
        return heapq.heappop(self.heap)


TOTALS = "n_children long, n_leaves long, saved_tokens long"


def time_forward(held: int = HELD):
    """A task's function over batches of nodes, deepest level first: each takes the messages sent to it and sends its totals to its parent.

    Nodes: depth, k1, k2 (the node), p_depth, p1, p2 (where its totals go; null: nowhere in this shard), and children,
    leaves and saved, which it has besides what it is sent; sorted by depth, falling, and node.
    """

    def run(batches):
        queue = SpillingQueue(held)
        for batch in batches:
            get = {n: batch.column(n).to_pylist() for n in ("depth", "k1", "k2", "p_depth", "p1", "p2", "children", "leaves", "saved")}
            out = [], [], []
            for depth, k1, k2, p_depth, p1, p2, children, leaves, saved in zip(*get.values(), strict=True):
                me = (-depth, k1, k2)
                while (head := queue.first()) is not None and head[:3] == me:
                    _, _, _, c, n, s = queue.pop()
                    children += c
                    leaves += n
                    saved += s
                leaves = leaves if children else leaves + 1
                if p_depth is not None:
                    queue.push((-p_depth, p1, p2, 1, leaves, saved))
                for o, x in zip(out, (children, leaves, saved), strict=True):
                    o.append(x)
            keep = [n for n in batch.schema.names if n not in ("p_depth", "children", "leaves", "saved")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], *[pa.array(o, pa.int64()) for o in out]], names=[*keep, "n_children", "n_leaves", "saved_tokens"])

    return run


def passed_up(nodes: DataFrame, by: list[str], held: int = HELD) -> DataFrame:
    """`nodes` with their totals within their shard; shards are hashes of `by`."""
    keep = [f for f in nodes.schema.fields if f.name not in ("p_depth", "children", "leaves", "saved")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keep], TOTALS])
    dealt = nodes.repartition(_parts(nodes), *by).sortWithinPartitions(F.desc("depth"), "k1", "k2")
    return dealt.mapInArrow(time_forward(held), schema)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with chunk, pos from 1 in the order of their key, and size, the key's number of rows; keys in several chunks).

    Rows are range-partitioned by key and order, so a key with a third of all rows lies in many chunks; a row is numbered
    within its chunk, and what comes before it in other chunks is added. At most one key runs from a chunk to the next.
    """
    t = written(rows.repartitionByRange(_parts(rows), key, *order).withColumn("chunk", F.spark_partition_id()), "ordered")
    ends = t.groupBy("chunk").agg(F.min(key).alias("a"), F.max(key).alias("z")).select("chunk", F.explode(F.array("a", "z")).alias(key)).distinct()
    spanning = written(ends.groupBy(key).count().filter("count > 1").select(key), "spanning")  # fewer rows than chunks
    held = t.join(F.broadcast(spanning), key, "left_semi").groupBy(key, "chunk").agg(F.count("*").alias("n"))
    by = Window.partitionBy(key)
    before = held.select(key, "chunk", (F.sum("n").over(by.orderBy("chunk")) - F.col("n")).alias("before"), F.sum("n").over(by).alias("whole"))
    w = Window.partitionBy("chunk", key)
    out = t.withColumns({"pos": F.row_number().over(w.orderBy(*order)).cast("long"), "size": F.count("*").over(w)}).join(F.broadcast(before), [key, "chunk"], "left")
    return out.withColumns({"pos": F.col("pos") + F.coalesce("before", F.lit(0)), "size": F.coalesce("whole", "size")}).drop("before", "whole"), spanning


def turn_hashes(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, a, b, bytes): turns of conversations with their texts as two hashes of role and text. Turns without a conversation are left out."""
    role, text = F.coalesce(col(role_col).cast("string"), F.lit("")), F.coalesce(col(text_col).cast("string"), F.lit(""))
    return turns.filter(col(id_col).isNotNull()).select(col(id_col).cast("long").alias("conv"), col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("text"), text, role).alias("b"), F.octet_length(text).cast("long").alias("bytes"))


def prefix_rows(turns: DataFrame, order: list[str]) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, bytes, size): a row for each turn, its node and the node's parent; size is its conversation's length.

    A node is known by its depth and 128 bits: the exclusive or of a hash of each turn with its place. That is
    associative, so prefixes, like numbers, are taken within chunks and carried from one to the next.
    """
    x, spanning = numbered(turns, "conv", order)
    x = written(x.select("conv", "chunk", "pos", "size", "bytes", F.xxhash64("pos", "a", "b").alias("g1"), F.xxhash64(F.lit("turn"), "b", "pos", "a").alias("g2")), "placed")
    held = x.join(F.broadcast(spanning), "conv", "left_semi").groupBy("conv", "chunk").agg(F.bit_xor("g1").alias("g1"), F.bit_xor("g2").alias("g2"))
    ahead = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("conv", "chunk", *[F.coalesce(F.bit_xor(g).over(ahead), F.lit(0)).alias(f"before{g}") for g in ("g1", "g2")])
    so_far = Window.partitionBy("chunk", "conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"k{g[1]}": F.bit_xor(g).over(so_far) for g in ("g1", "g2")}).join(F.broadcast(before), ["conv", "chunk"], "left")
    k = {n: F.col(f"k{n}").bitwiseXOR(F.coalesce(f"beforeg{n}", F.lit(0))) for n in "12"}
    return x.select("conv", F.col("pos").alias("depth"), k["1"].alias("k1"), k["2"].alias("k2"), k["1"].bitwiseXOR(F.col("g1")).alias("p1"), k["2"].bitwiseXOR(F.col("g2")).alias("p2"), "bytes", "size")


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of rows (k1, k2, conv): the digest of each node's ids, ascending, comma-joined.

    Ids are range-partitioned with their node and joined to strings of up to JOINED of them first; a node's strings are
    then hashed as they stream by in order, as such a digest can only be taken from front to back.
    """

    def joined(batches):
        node, ids = None, []
        out: list = []

        def close():
            if ids:
                out.append((*node, ids[0], ",".join(map(str, ids))))
                ids.clear()

        for batch in batches:
            for k1, k2, conv in zip(*(batch.column(n).to_pylist() for n in ("k1", "k2", "conv")), strict=True):
                if (k1, k2) != node or len(ids) >= JOINED:
                    close()
                    node = (k1, k2)
                ids.append(conv)
            if len(out) > 1000:
                yield _batch(out, ("k1", "k2", "first", "ids"))
                out.clear()
        close()
        if out:
            yield _batch(out, ("k1", "k2", "first", "ids"))

    def digested(batches):
        node, sha, out = None, None, []
        for batch in batches:
            for k1, k2, ids in zip(*(batch.column(n).to_pylist() for n in ("k1", "k2", "ids")), strict=True):
                if (k1, k2) != node:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (k1, k2), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if out:
                yield _batch(out, ("k1", "k2", "ends_sha256"))
                out = []
        if node:
            yield _batch([(*node, sha.hexdigest())], ("k1", "k2", "ends_sha256"))

    n = _parts(ends)
    x = ends.repartitionByRange(n, "k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv").mapInArrow(joined, "k1 long, k2 long, first long, ids string")
    return x.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(digested, "k1 long, k2 long, ends_sha256 string")


def _batch(rows: list[tuple], names: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))


def prefix_trie(turns: DataFrame, ids: DataFrame, order: list[str] = ["turn", "role", "a", "b"], held: int = HELD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each distinct prefix.

    `turns` is as of turn_hashes(); `ids` (conv) are all conversations, those without turns among them. Nulls come first
    in the order; turns of one place that are alike in all of `order` are one after the other. No conversations: no rows.

    A subtree total is a sum over a node's children, passed up level by level, the deepest first. A node is heavy if its
    subtree may hold more rows than a small part of a task's share (the root always is); a light child of a heavy node
    stands over a whole subtree that is small, and a hash of it says in which shard that lies. Heavy nodes are few at each depth;
    they are cut into bands of BAND levels, first for themselves, with what their light children passed up; then across the roots
    of the pieces, one row each; then again with what the pieces below sent. So neither a turn that a third of all
    conversations begin with nor one conversation with a third of all turns meets in one task.
    """
    parts = _parts(turns)
    rows = written(prefix_rows(turns, order), "prefixes")
    n_rows = rows.count()
    bound = max(LEAST_PIECE, n_rows // (4 * parts))
    heavy = written(rows.groupBy("k1", "k2").agg(F.sum(F.col("size") - F.col("depth") + 1).alias("below")).filter(F.col("below") > bound).select("k1", "k2", F.lit(True).alias("heavy")), "heavy")
    x = rows.join(maybe_broadcast(heavy), ["k1", "k2"], "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    # A conversation's heavy nodes come first; its first light one is the top of a light subtree.
    x = x.withColumn("band", F.when(F.col("heavy"), F.floor((F.col("depth") - 1) / BAND)).otherwise(F.lit(-1)))
    top = Window.partitionBy("conv", "band").orderBy("depth")
    x = x.withColumns({"t1": F.first("k1").over(top), "t2": F.first("k2").over(top), "t_depth": F.first("depth").over(top)})
    same = [F.max(c).alias(c) for c in ("depth", "p1", "p2", "bytes", "heavy", "t1", "t2", "t_depth")]
    nodes = x.groupBy("k1", "k2").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), *same)
    root = ids.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    null = lambda kind: F.lit(None).cast(kind)
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("depth"), null("long").alias("p1"), null("long").alias("p2"), zero.alias("bytes"), F.lit(True).alias("heavy"), zero.alias("t1"), zero.alias("t2"), zero.alias("t_depth"))
    nodes = nodes.unionByName(root).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))
    is_top = F.col("depth") == F.col("t_depth")
    nodes = written(nodes.withColumns({"is_top": is_top, "p_depth": F.when(~is_top, F.col("depth") - 1)}), "nodes")
    fresh = {"children": zero, "leaves": zero}
    light = written(passed_up(nodes.filter("NOT heavy").withColumns(fresh), ["t1", "t2"], held), "light")
    big = nodes.filter("heavy")
    sent = [F.sum(c).alias(c) for c in ("leaves", "saved")]
    sends = lambda df: df.select("p1", "p2", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")).groupBy("p1", "p2").agg(*sent, F.count("*").alias("children"))
    to_heavy = sends(light.filter("is_top"))
    tops = big.filter("is_top AND depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("tops"))
    got = to_heavy.join(tops, ["p1", "p2"], "full").select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.coalesce("children", F.lit(0)) + F.coalesce("tops", F.lit(0))).alias("children"), F.coalesce("leaves", F.lit(0)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("more"))
    big = big.join(got, ["k1", "k2"], "left").withColumns({"children": F.coalesce("children", zero), "leaves": F.coalesce("leaves", zero), "saved": F.col("saved") + F.coalesce("more", zero)}).drop("more")
    big = written(big, "big")
    pieces = written(passed_up(big, ["t1", "t2"], held).filter("is_top"), "pieces")
    # Across the roots of pieces: one row a piece, which passes its total to the piece that its parent lies in.
    where = big.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.col("t_depth").alias("p_depth"))
    tree = pieces.drop("n_children").join(where, ["p1", "p2"], "left")
    tree = tree.select("depth", "k1", "k2", "p_depth", F.col("u1").alias("p1"), F.col("u2").alias("p2"), F.lit(1).cast("long").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    total = passed_up(tree.withColumn("all", F.lit(0)), ["all"], held).select("k1", "k2", "n_leaves", "saved_tokens")
    final = pieces.select("k1", "k2", "p1", "p2", "depth").join(total, ["k1", "k2"])
    below = sends(final.filter("depth > 0")).select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("leaves").alias("l"), F.col("saved").alias("s"))
    big = big.join(below, ["k1", "k2"], "left").withColumns({"leaves": F.col("leaves") + F.coalesce("l", zero), "saved": F.col("saved") + F.coalesce("s", zero)}).drop("l", "s")
    big = written(passed_up(big, ["t1", "t2"], held), "heavy-totals")
    # Parents: a light parent has few children; heavy ones are joined as a counted table, or by a join that Spark splits.
    up = lambda df: df.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    under = light.filter("is_top").unionByName(big)
    all_ = light.filter("NOT is_top").join(up(light), ["p1", "p2"], "left").unionByName(under.join(maybe_broadcast(written(up(big), "parents")), ["p1", "p2"], "left"))
    last = rows.filter("depth = size").select("k1", "k2", "conv")
    silent = ids.join(rows.filter("depth = 1").select("conv"), "conv", "left_anti").select(zero.alias("k1"), zero.alias("k2"), "conv")
    out = all_.join(end_digests(last.unionByName(silent)), ["k1", "k2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after each conversation c takes its first turns from the first of its family, c - c % family.

    crc32 of c in decimal, modulo `most`, says how many. `turns` is as of turn_hashes().
    """
    x, _ = numbered(turns, "conv", ["turn", "role", "a", "b"])
    x = written(x.select("conv", "pos", "a", "b", "bytes"), "numbered")
    ids = written(x.select("conv").distinct(), "conversations")
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("taken")
    own = x.filter((F.col("pos") > taken) | (F.col("conv") % family == 0)).select("conv", F.lit(1).alias("part"), "pos", "a", "b", "bytes")
    heads = x.filter((F.col("conv") % family == 0) & (F.col("pos") < most)).select(F.col("conv").alias("base"), "pos", "a", "b", "bytes")
    lent = ids.filter(F.col("conv") % family != 0).select("conv", (F.col("conv") - F.col("conv") % family).alias("base"), taken).join(heads, "base").filter("pos <= taken")
    return own.unionByName(lent.select("conv", F.lit(0).alias("part"), "pos", "a", "b", "bytes")), ids


def family_trie(conversations: DataFrame) -> DataFrame:
    """prefix_trie() of the rebuilt() conversations of a table (conv_id, turn, role, text)."""
    turns, ids = rebuilt(turn_hashes(conversations))
    return prefix_trie(turns, ids, ["part", "pos"])
