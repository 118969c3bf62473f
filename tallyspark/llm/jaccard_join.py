"""Jaccard join of documents on word shingles, with set-relation skipping.

The steps, each a Spark job over partitioned data:

1. Shingle hashes of every document; documents of the same set are one set from here on.
2. How many sets hold each shingle: hashes are counted within chunks of sets first, then in buckets, so
   that a shingle of very many sets adds one entry a chunk to its bucket; the counts return to the
   chunks. A shingle of one set links nothing, so sets go on with their shared shingles only, the rarest first.
3. Prefix filter: two sets can reach the threshold only if they share a token of both prefixes. Each
   token has an index list of (set, size, position). Lists of the same members are one list. Sets that
   lists join, however far, are one unit of work, so that each is sent once and not once for each list; a unit
   that is too large for a task is cut into pairs of blocks by size and position, and pairs whose sizes or
   positions rule out the threshold are skipped whole.
4. Within a unit index lists are in order of size classes, and a set reads only those stretches of them
   whose sizes it can link with. Its overlaps are derived from those computed for the set before it, which
   is highly similar after sorting: only the lists of the tokens in which the two differ are read.
   A pair counts where its first common token leads, so no link is counted twice; of the links only
   their number and a spanning forest leave the task.
5. Connected components of the forests.

Shingles are compared by all 64 bits of their hashes; documents have the same set if its size and 128 bits
of hash agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Words, col, maybe_broadcast, mixed, slices, written
from .components import components

#: Shingles that a bucket of step 2 is sized for.
BUCKET_TOKENS = 1 << 19
#: Index entries of a block of step 3.
BLOCK_SETS = 1024
#: Sets, and tokens of theirs, up to which all that share tokens are one unit of work.
GROUP_SETS, GROUP_TOKENS = 4096, 1 << 22


def shingle_hashes(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; fewer than `width` words are one shingle."""
    w = Words(texts)
    h = w.hashes()
    bounds = np.searchsorted(w.row, np.arange(w.rows + 1))
    out = []
    if len(h) >= width:
        runs = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            runs += mixed(h[k : len(h) - width + 1 + k], 10 + k)
        runs = mixed(runs, 2)
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for k in range(b - a):
                short += mixed(h[a + k : a + k + 1], 10 + k)
            out.append(mixed(short, 3))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_ids(hashes: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set of hashes."""
    out = []
    for seed in (4, 14):
        both = np.array([mixed(hashes, seed).sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(hashes, seed + 1)), np.uint64(len(hashes))], np.uint64)
        out.append(int(np.array([mixed(both + mixed(np.arange(3, dtype=np.uint64), seed + 2), seed + 3).sum(dtype=np.uint64)], np.uint64).view(np.int64)[0]))
    return out[0], out[1]


def document_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n_shingles, h1, h2): the hashes are null for a document without words."""
    schema = StructType([StructField("id", docs.schema[id_col].dataType), *StructType.fromDDL("n_shingles long, h1 long, h2 long").fields])

    def one(batches):
        for batch in batches:
            for i, texts in slices(batch.column(1)):
                sets = shingle_hashes(texts, width)
                names = [set_ids(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[k] for x in names], pa.int64()) for k in (0, 1))], ["id", "n_shingles", "h1", "h2"])

    return docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).mapInArrow(one, schema)


def _binary(parts) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


#: What rows of the counting steps hold: tokens of one set of the chunk, hashes and sizes of the chunk's sets,
#: tokens of several sets of the chunk with their counts, and which sets these are.
SINGLE, META, SEVERAL, HOME = range(4)


def _dealt(texts: DataFrame, width: int, n_buckets: int, chunk_bytes: int = 16 << 20) -> DataFrame:
    """(bucket, chunk, kind, a, b, c) for each chunk of sets.

    SINGLE: a = set indexes (as steps), b = tokens; SEVERAL: a = tokens, b = counts; both once for each bucket.
    META: a = both hashes of the sets, b = sizes; HOME: a = tokens, b = counts, c = set indexes; these two only pass through.
    """
    shift = np.uint64(64 - int(n_buckets).bit_length() + 1)

    def by_bucket(tokens):
        bucket = (tokens >> shift).astype(np.int64) if n_buckets > 1 else np.zeros(len(tokens), np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        return order, bucket[order][at], at, np.append(at[1:], len(bucket))

    def deal(batches):
        task, serial = TaskContext.get().partitionId(), 0

        def chunk(sets):
            nonlocal serial
            name = (task << 24) + serial
            serial += 1
            ids = np.array([set_ids(s) for s in sets], np.int64)
            sizes = np.array([len(s) for s in sets], np.int64)
            tokens = np.concatenate(sets)
            index = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
            order = np.argsort(tokens, kind="stable")
            start = np.flatnonzero(np.concatenate([[True], np.diff(tokens[order]) != 0]))
            runs = np.diff(np.append(start, len(tokens)))
            more = runs > 1
            many, count = tokens[order[start[more]]], runs[more].astype(np.uint32)
            several = np.zeros(len(tokens), bool)
            several[order] = np.repeat(more, runs)
            home = index[order[np.repeat(more, runs)]]
            rows = [(name % n_buckets, META, ids.tobytes(), sizes.tobytes(), b""), (name % n_buckets, HOME, many.tobytes(), count.tobytes(), home.tobytes())]
            tokens, index = tokens[~several], index[~several]
            order, buckets, at, end = by_bucket(tokens)
            for bucket, a, b in zip(buckets, at, end):
                # Indexes ascend: the step from the one before fits a byte almost always.
                step = np.diff(index[order[a:b]], prepend=np.uint32(0))
                rows.append((bucket, SINGLE, (step.astype(np.uint8) if step.max() < 256 else step).tobytes(), tokens[order[a:b]].tobytes(), b""))
            order, buckets, at, end = by_bucket(many)
            for bucket, a, b in zip(buckets, at, end):
                rows.append((bucket, SEVERAL, many[order[a:b]].tobytes(), count[order[a:b]].tobytes(), b""))
            bucket, kind, a, b, c = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([name] * len(rows), pa.int64()), pa.array(kind, pa.int32()), *(pa.array(x, pa.binary()) for x in (a, b, c))], ["bucket", "chunk", "kind", "a", "b", "c"])

        sets, held = [], 0
        for batch in batches:
            for _, part in slices(batch.column(0)):
                made = [s for s in shingle_hashes(part, width) if len(s)]
                sets += made
                held += sum(len(s) for s in made) * 8
                if held >= chunk_bytes:
                    yield from chunk(sets)
                    sets, held = [], 0
        if sets:
            yield from chunk(sets)

    return texts.mapInArrow(deal, "bucket long, chunk long, kind int, a binary, b binary, c binary")


def _count_bucket(table: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk the (set index, token, count) of tokens that several sets hold."""
    out, singles, several = [], [], []
    for chunk, kind, a, b, c in zip(*(table.column(x).to_pylist() for x in ("chunk", "kind", "a", "b", "c"))):
        if kind == SINGLE:
            tokens = np.frombuffer(b, np.uint64)
            step = np.frombuffer(a, np.uint8 if len(a) == len(tokens) else np.uint32)
            singles.append((chunk, np.cumsum(step, dtype=np.int64).astype(np.uint32), tokens))
        elif kind == SEVERAL:
            several.append((chunk, np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32)))
        else:
            out.append((chunk, kind, a, b, c))
    if singles or several:
        tokens = np.concatenate([x[2] for x in singles] + [x[1] for x in several])
        held = np.concatenate([np.ones(sum(len(x[2]) for x in singles), np.int64)] + [x[2].astype(np.int64) for x in several])
        order = np.argsort(tokens, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], np.diff(tokens[order]) != 0]))
        count = np.empty(len(tokens), np.uint32)
        count[order] = np.repeat(np.minimum(np.add.reduceat(held[order], at), (1 << 32) - 1).astype(np.uint32), np.diff(np.append(at, len(tokens))))
        i = 0
        for chunk, index, mine in singles:
            n = count[i : i + len(mine)]
            i += len(mine)
            some = n > 1
            if some.any():
                out.append((chunk, SINGLE, index[some].tobytes(), mine[some].tobytes(), n[some].tobytes()))
        for chunk, mine, _ in several:
            out.append((chunk, SEVERAL, b"", mine.tobytes(), count[i : i + len(mine)].tobytes()))
            i += len(mine)
    columns = zip(*out) if out else [[]] * 5
    return pa.table({k: pa.array(list(v), t) for (k, t), v in zip({"chunk": pa.int64(), "kind": pa.int32(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary()}.items(), columns)})


def _prefixes(percent: int):
    """Of one chunk: the sets that may link, with shared tokens in order and how many are of the prefix."""

    def joined(rows, kind, column, of):
        return np.concatenate([np.frombuffer(r[column], of) for r in rows if r[0] == kind] or [np.zeros(0, of)])

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(x).to_pylist() for x in ("kind", "a", "b", "c"))))
        ids, sizes = joined(rows, META, 1, np.int64).reshape(-1, 2), joined(rows, META, 2, np.int64)
        names, total = joined(rows, SEVERAL, 2, np.uint64), joined(rows, SEVERAL, 3, np.uint32)
        by = np.argsort(names)
        home, times = joined(rows, HOME, 1, np.uint64), joined(rows, HOME, 2, np.uint32)
        total = total[by][np.searchsorted(names[by], home)] if len(home) else total
        index = np.concatenate([joined(rows, SINGLE, 1, np.uint32), joined(rows, HOME, 3, np.uint32)])
        token = np.concatenate([joined(rows, SINGLE, 2, np.uint64), np.repeat(home, times)])
        count = np.concatenate([joined(rows, SINGLE, 3, np.uint32), np.repeat(total, times)])
        shared = np.bincount(index, minlength=len(ids))
        # ceil(percent * n / 100) tokens must be common; those of one set come first in the order.
        need = sizes - (percent * sizes + 99) // 100 + 1 - (sizes - shared)
        ok = np.flatnonzero((need > 0) & (shared > 0))
        keep = need[index] > 0
        index, token, count = index[keep], token[keep], count[keep]
        order = np.lexsort((token, count, index))
        index, token, count = index[order], token[order], count[order]
        start, end = np.searchsorted(index, ok), np.searchsorted(index, ok, side="right")
        return pa.table({
            "h1": pa.array(ids[ok, 0], pa.int64()), "h2": pa.array(ids[ok, 1], pa.int64()), "n": pa.array(sizes[ok], pa.int64()),
            "prefix": pa.array([int(min(need[k], e - s)) for k, s, e in zip(ok, start, end)], pa.int64()),
            "tokens": _binary([token[s:e] for s, e in zip(start, end)]),
            "counts": _binary([count[s : s + max(0, need[k])] for k, s, e in zip(ok, start, end)]),
        })

    return run


def _postings(batches):
    """(token, df, set_id, n, pos): an index entry for each token of each prefix. pos: place in the whole order."""
    for batch in batches:
        ids, n, prefix = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
        tokens = [np.frombuffer(x, np.uint64) for x in batch.column(3).to_pylist()]
        counts = [np.frombuffer(x, np.uint32) for x in batch.column(4).to_pylist()]
        if not len(ids):
            continue
        own = [int(a - len(t)) for a, t in zip(n, tokens)]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([t[:p] for t, p in zip(tokens, prefix)]).view(np.int64)),
            pa.array(np.concatenate([c[:p] for c, p in zip(counts, prefix)]).astype(np.int64)),
            pa.array(np.repeat(ids, prefix)), pa.array(np.repeat(n, prefix)),
            pa.array(np.concatenate([o + np.arange(p, dtype=np.int64) for o, p in zip(own, prefix)])),
        ], ["token", "df", "set_id", "n", "pos"])


def class_step(percent: int) -> float:
    """The logarithm of what a size class spans: more than the ratio 100 / percent, so that sizes within it are one class apart at most."""
    return max(float(np.log(100 / percent)), 1e-9) * 1.001


def _block_pairs(lists: DataFrame, percent: int, block_sets: int) -> DataFrame:
    """(token, df, unit, set_id, side): the block pairs to compare, one row for each set in them.

    Sizes are cut into classes so that sets of classes further apart than one cannot link; in a class
    entries are cut by position, and by hash where a block would still be too large. A pair of blocks
    is skipped if its smallest positions leave too few tokens for the least overlap its sizes ask for.
    """
    e = lists.withColumn("size_class", F.floor(F.log("n") / class_step(percent)).cast("long"))
    e = e.withColumn("place", F.floor(F.col("pos") * 8 * 100 / ((100 - percent) * F.col("n") + 100)).cast("int"))
    size = e.groupBy("token", "size_class", "place").agg(F.count("*").alias("k"))
    total = size.groupBy("token").agg(F.sum("k").alias("total"))
    size = size.join(total, "token").withColumn("salts", F.when(F.col("total") <= block_sets, F.lit(1)).otherwise(F.ceil(F.col("k") / block_sets)).cast("int"))
    e = e.join(size.select("token", "size_class", "place", "total", "salts"), ["token", "size_class", "place"])
    whole = e.filter(F.col("total") <= block_sets).select("token", "df", F.lit(0).cast("long").alias("unit"), "set_id", F.lit(0).alias("side"))
    big = e.filter(F.col("total") > block_sets).withColumn("salt", F.pmod(F.xxhash64("set_id"), F.col("salts")).cast("int"))
    blocks = big.groupBy("token", "size_class", "place", "salt").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("left"))
    a = blocks.select("token", *[F.col(c).alias(f"a_{c}") for c in ("size_class", "place", "salt", "least", "most", "left")])
    b = blocks.select("token", *[F.col(c).alias(f"b_{c}") for c in ("size_class", "place", "salt", "least", "most", "left")])
    first = F.struct("a_size_class", "a_place", "a_salt") <= F.struct(F.col("b_size_class").alias("a_size_class"), F.col("b_place").alias("a_place"), F.col("b_salt").alias("a_salt"))
    near = F.abs(F.col("a_size_class") - F.col("b_size_class")) <= 1
    sizes = F.greatest("a_least", "b_least") * percent <= F.least("a_most", "b_most") * 100
    room = F.least("a_left", "b_left") * (100 + percent) >= percent * (F.col("a_least") + F.col("b_least"))
    pairs = a.join(b, "token").filter(first & near & sizes & room)
    pairs = pairs.withColumn("unit", F.xxhash64("a_size_class", "a_place", "a_salt", "b_size_class", "b_place", "b_salt"))
    cols = ("size_class", "place", "salt")
    one = pairs.select("token", "unit", F.lit(0).alias("side"), *[F.col(f"a_{c}").alias(c) for c in cols])
    two = pairs.filter(~((F.col("a_size_class") == F.col("b_size_class")) & (F.col("a_place") == F.col("b_place")) & (F.col("a_salt") == F.col("b_salt")))).select("token", "unit", F.lit(1).alias("side"), *[F.col(f"b_{c}").alias(c) for c in cols])
    cut = big.join(one.unionByName(two), ["token", *cols]).select("token", "df", "unit", "set_id", "side")
    return whole.unionByName(cut)


def compare_block(lead: int | None, side: np.ndarray, ids: np.ndarray, n: np.ndarray, many: np.ndarray, tokens: list, kept: list, percent: int):
    """(links of each set, weighted by copies, and the edges of a spanning forest) of one block or block pair.

    A pair counts if its least common kept token is `lead`; without a lead (None) every pair does. If
    both sides are there, pairs within a side are left to their own block.
    """
    size_class = np.floor(np.log(n) / class_step(percent)).astype(np.int64)
    # By size class, and in a class similar sets next to each other: by their first tokens.
    order = np.array(sorted(range(len(ids)), key=lambda k: (size_class[k], tokens[k][:8].tobytes())))
    m = len(ids)
    rank = np.concatenate([tokens[k] for k in order])
    who = np.repeat(np.arange(m), [len(tokens[k]) for k in order])
    by = np.argsort(rank, kind="stable")
    rank, who = rank[by], who[by]
    start = np.flatnonzero(np.concatenate([[True], np.diff(rank) != 0]))
    names, length = rank[start], np.diff(np.append(start, len(rank)))
    place = np.repeat(np.arange(len(start)), length) * m + who  # the index lists, one after another
    side, ids, n, many, size_class = side[order], ids[order], n[order], many[order], size_class[order]
    two = side.any() and not side.all()
    sets = [np.searchsorted(names, tokens[k]) for k in order]
    # A token that one set here holds adds nothing to an overlap.
    sets = [np.sort(s[length[s] > 1]) for s in sets]
    before = []
    for k in order if lead is not None else ():
        earlier = kept[k][: int(np.flatnonzero(kept[k] == np.uint64(lead))[0])]
        before.append(np.searchsorted(names, earlier))

    def gather(which: np.ndarray, low: int, high: int) -> np.ndarray:
        """How many of some lists hold each of the sets low..high; the rest of the lists is skipped."""
        a, b = np.searchsorted(place, which * m + low), np.searchsorted(place, which * m + high)
        size = b - a
        at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(who[at] - low, minlength=high - low)

    links, parent, edges = np.zeros(m, np.int64), np.arange(m), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    last, overlap, low, high = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
    for x in range(m):
        mine = sets[x]
        if x == 0 or size_class[x] != size_class[x - 1]:
            low, high = x, int(np.searchsorted(size_class, size_class[x] + 1, side="right"))
            overlap = gather(mine, low, high)
        else:
            added, gone = np.setdiff1d(mine, last, True), np.setdiff1d(last, mine, True)
            overlap = overlap + gather(added, low, high) - gather(gone, low, high) if len(added) + len(gone) < len(mine) else gather(mine, low, high)
        last = mine
        hit = 100 * overlap >= percent * (n[low:high] + n[x] - overlap)
        hit[: x - low + 1] = False
        if two:
            hit &= side[low:high] != side[x]
        if lead is not None and hit.any() and len(before[x]):
            hit &= gather(before[x], low, high) == 0
        found = low + np.flatnonzero(hit)
        links[x] += many[found].sum()
        links[found] += many[x]
        for y in found:
            a, b = root(x), root(int(y))
            if a != b:
                parent[a] = b
                edges.append((ids[x], ids[y]))
    return ids, links, edges


def _compare(percent: int):
    """Streams rows sorted by block pair and compares each when its last row has come."""

    def run(batches):
        held: list[tuple] = []

        def close():
            rows = [r for k, r in enumerate(held) if k == 0 or r[3] != held[k - 1][3] or r[4] != held[k - 1][4]]
            ids, links, edges = compare_block(
                None if rows[0][0] is None else np.int64(rows[0][0]).view(np.uint64), np.array([r[4] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64), np.array([r[5] for r in rows], np.int64),
                np.array([r[6] for r in rows], np.int64), [np.frombuffer(r[7], np.uint64) for r in rows], [np.frombuffer(r[8], np.uint64) for r in rows], percent)
            some = np.flatnonzero(links)
            a = [*map(int, ids[some]), *(int(x) for x, _ in edges)]
            b = [None] * len(some) + [int(y) for _, y in edges]
            return a, b, [*map(int, links[some]), *[0] * len(edges)]

        out = [[], [], []]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[0], row[2]) != (held[0][0], held[0][2]):
                    for o, x in zip(out, close()):
                        o += x
                    held = []
                held.append(row)
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["a", "b", "links"])
                out = [[], [], []]
        if held:
            for o, x in zip(out, close()):
                o += x
        yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["a", "b", "links"])

    return run


def linked_sets(texts: DataFrame, one: DataFrame, total: int, repeated: bool, width: int, percent: int, block_sets: int, group_sets: int) -> DataFrame:
    """(a, b, links): rows with b are edges of the spanning forests, rows without give a's links to other sets.

    `one` numbers the sets: (h1, h2, n, set_id, many). `repeated`: some texts have the same set. Index lists are told apart by sums over their members, so
    a set may stand in a list once only.
    """
    n_buckets = 1
    while n_buckets * BUCKET_TOKENS < total or n_buckets < 64:
        n_buckets *= 2
    dealt = _dealt(texts, width, n_buckets)
    counted = dealt.groupBy("bucket").applyInArrow(_count_bucket, "chunk long, kind int, a binary, b binary, c binary")
    sets = counted.groupBy("chunk").applyInArrow(_prefixes(percent), "h1 long, h2 long, n long, prefix long, tokens binary, counts binary")
    sets = sets.join(one.select("h1", "h2", "n", "set_id"), ["h1", "h2", "n"])
    sets = written(sets.dropDuplicates(["set_id"]) if repeated else sets, "sets")
    entries = sets.select("set_id", "n", "prefix", "tokens", "counts").mapInArrow(_postings, "token long, df long, set_id long, n long, pos long")
    entries = written(entries, "entries")
    seen = entries.groupBy("token", "df").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("set_id")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "set_id")).alias("x2")).filter("k > 1")
    # Of lists with the same members the first in the order stands for all.
    kept = seen.groupBy("k", "x1", "x2").agg(F.min(F.struct("df", "token")).alias("t")).select("t.df", "t.token")
    lists = written(entries.join(kept, ["token", "df"]), "lists")
    leads = lists.groupBy("set_id").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("kept"))
    pack = F.transform("kept", lambda t: t["token"])
    body = sets.select("set_id", "n", "tokens").join(leads, "set_id").join(one.select("set_id", "many"), "set_id").select("set_id", "n", "many", "tokens", pack.alias("kept"))
    body = written(body, "bodies")
    # A list is a node of its own, below all sets: its members hang together by it.
    node = -1 - F.col("token").bitwiseAND(F.lit((1 << 63) - 1))
    groups = components(lists.select(node.alias("a"), F.col("set_id").alias("b"))).filter("node >= 0")
    sized = body.select(F.col("set_id").alias("node"), (F.octet_length("tokens") / 8).alias("t")).join(groups, "node")
    large = sized.groupBy("component").agg(F.count("*").alias("k"), F.sum("t").alias("t")).filter((F.col("k") > group_sets) | (F.col("t") > GROUP_TOKENS)).select("component")
    groups = written(groups.join(large.withColumn("large", F.lit(True)), "component", "left").select(F.col("node").alias("set_id"), F.col("component").alias("unit"), F.coalesce("large", F.lit(False)).alias("large")), "groups")
    whole = groups.filter("NOT large").select(F.lit(None).cast("long").alias("token"), F.lit(None).cast("long").alias("df"), "unit", "set_id", F.lit(0).alias("side"))
    cut = lists.join(groups.filter("large").select("set_id"), "set_id", "left_semi").select("token", "df", "set_id", "n", "pos")
    units = whole.unionByName(_block_pairs(cut, percent, block_sets))
    rows = units.join(body, "set_id").select("token", "df", "unit", "set_id", "side", "n", "many", "tokens", "kept")
    rows = rows.repartition("token", "unit").sortWithinPartitions("token", "unit", "side", "set_id")
    return rows.mapInArrow(_compare_rows(percent), "a long, b long, links long")


def _compare_rows(percent: int):
    inner = _compare(percent)

    def run(batches):
        def packed():
            for batch in batches:
                kept = batch.column(8)
                flat, off = kept.flatten().to_numpy(), kept.offsets.to_numpy()
                off = off - off[0]
                yield pa.RecordBatch.from_arrays([*batch.columns[:8], _binary([flat[a:b] for a, b in zip(off, off[1:])])], names=batch.schema.names)

        yield from inner(packed())

    return run


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block_sets: int = BLOCK_SETS, group_sets: int = GROUP_SETS) -> DataFrame:
    """(id_col, n_shingles, component_id, n_links) for every row of docs.

    Two documents link when 100 * intersection >= percent * union of their shingle sets. component_id
    is the smallest id reachable by links, the document's own included; n_links how many other rows
    link with it. A null or blank text has no shingles and links with nothing, and its component is its
    own id. Rows with a null id take part; they are named by no component unless all ids there are
    null. Rows that repeat are documents like others. Very long texts are read whole; columns but the id and the
    text are not read. A group of k near copies that differ costs k * k comparisons, as each of its links is
    counted. Give a table, not a plan with random parts: it is read several times.
    """
    named = written(document_sets(docs, id_col, text_col, width), "named")
    worded = named.filter("h1 IS NOT NULL")
    one = worded.groupBy("h1", "h2", F.col("n_shingles").alias("n")).agg(F.min("id").alias("least"), F.count("*").alias("many"))
    # Numbered as they are written: a set has one number from here on.
    one = written(one.withColumn("set_id", F.monotonically_increasing_id()), "classes")
    total, n_sets = one.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # One text for each set: other ids of a class are taken out. Few: broadcast; else the texts are dealt by id.
    spare = worded.filter("id IS NOT NULL").join(one.select(F.col("least").alias("id")), "id", "left_anti").select("id").distinct()
    spare = written(spare, "spare")
    # Null ids, and ids of several rows, can leave more than one text of a set.
    repeated = worded.join(spare, "id", "left_anti").count() > n_sets
    texts = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    known = maybe_broadcast(spare)
    texts = texts.join(known, "id", "left_anti").select("text")
    if known is spare:
        texts = written(texts, "texts")
    found = written(linked_sets(texts, one, total, repeated, width, percent, block_sets, group_sets), "links")
    graph = components(found.filter("b IS NOT NULL").select("a", "b"))
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("set_id")).agg(F.sum("links").alias("others"))
    joined = one.join(graph.withColumnRenamed("node", "set_id"), "set_id", "left").join(links, "set_id", "left")
    roots = joined.filter("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("component_id"))
    classes = joined.join(roots, "component", "left").select("h1", "h2", F.col("n").alias("n_shingles"), "many", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("others", F.lit(0)).alias("others"))
    out = named.join(classes, ["h1", "h2", "n_shingles"], "left")
    return out.select(
        F.col("id").alias(id_col), "n_shingles",
        F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("others") + F.col("many") - 1, F.lit(0)).cast("long").alias("n_links"),
    )
