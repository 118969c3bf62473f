"""Token ids packed into rows of one length: best-fit decreasing, with a segment tree over capacities."""

from __future__ import annotations

import base64
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, maybe_broadcast, written

#: Where the public vocabularies are; a parameter of pack_documents.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary cuts a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of a rank file that is sent to the executors.
MOST_VOCABULARY = 64 << 20

_loaded: dict = {}


def read_vocabulary(path: str) -> bytes:
    """A rank file as the driver sees it."""
    if os.path.getsize(path) > MOST_VOCABULARY:
        raise ValueError(f"{path} has over {MOST_VOCABULARY} bytes")
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes):
    """The byte-level BPE of a rank file's lines, made once a worker."""
    name = hashlib.sha256(ranks).hexdigest()
    if name not in _loaded:
        import tiktoken

        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _loaded[name] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})
    return _loaded[name]


class Capacities:
    """A segment tree over room sizes 0..capacity: how many open bins have each, and the least room that fits."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.tree = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, bin_: int) -> None:
        self.bins.setdefault(room, []).append(bin_)
        k = room + self.size
        while k:
            self.tree[k] += 1
            k //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of an open bin with the least room of at least `need`, taken out; None without one."""
        k = need + self.size
        if not self.tree[k]:
            while k > 1 and (k % 2 or not self.tree[k + 1]):
                k //= 2
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.tree[2 * k] else 2 * k + 1
        room = k - self.size
        bin_ = self.bins[room].pop()
        while k:
            self.tree[k] -= 1
            k //= 2
        return room, bin_


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: items by falling length (then number), each into the fullest bin with room."""
    tree, bins = Capacities(capacity), []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        got = tree.take(n) if n else None
        if got is None:
            bins.append([int(i)])
            room, b = capacity, len(bins) - 1
        else:
            room, b = got
            bins[b].append(int(i))
        if room - n:
            tree.add(room - n, b)
    return bins


def id_type(largest: int) -> type:
    """uint16 if all ids fit, else uint32."""
    return np.uint16 if largest < 1 << 16 else np.uint32


PACKED = "pack long, input_ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{0}>, parts array<int>"


def pack_shard(table: pa.Table, ranks: bytes, capacity: int, pad: int) -> pa.Table:
    """Packs the rows of one shard (id, text) in the order of ids and texts."""
    enc = encoder(ranks)
    wide = id_type(max(enc.max_token_value, pad))
    table = table.sort_by([("id", "ascending"), ("text", "ascending")])
    texts = table.column("text").to_pylist()
    segments, owner, part = [], [], []
    for row, text in enumerate(texts):
        ids = np.array(enc.encode_ordinary(text or ""), wide)
        for k in range(0, len(ids), capacity):
            segments.append(ids[k : k + capacity])
            owner.append(row)
            part.append(k // capacity)
    lengths = np.array([len(s) for s in segments], np.int64)
    out = {k: [] for k in ("input_ids", "n_tokens", "cu_seqlens", "position_resets", "rows", "parts")}
    for items in best_fit_decreasing(lengths, capacity):
        sizes = lengths[items]
        ends = np.cumsum(sizes)
        full = np.full(capacity, pad, wide)
        full[: ends[-1]] = np.concatenate([segments[i] for i in items])
        out["input_ids"].append(full.tobytes())
        out["n_tokens"].append(int(ends[-1]))
        out["cu_seqlens"].append([0, *ends.tolist()])
        out["position_resets"].append((ends - sizes).tolist() + ([int(ends[-1])] if ends[-1] < capacity else []))
        out["rows"].append([owner[i] for i in items])
        out["parts"].append([part[i] for i in items])
    ids = table.column("id").combine_chunks()
    flat = pa.array([r for rows in out["rows"] for r in rows], pa.int64())
    off = pa.array(np.cumsum([0, *map(len, out["rows"])]), pa.int32())
    listed = pa.ListArray.from_arrays(off, ids.take(flat))
    return pa.table({
        "pack": pa.array(range(len(off) - 1), pa.int64()), "input_ids": pa.array(out["input_ids"], pa.binary()), "n_tokens": pa.array(out["n_tokens"], pa.int32()),
        "cu_seqlens": pa.array(out["cu_seqlens"], pa.list_(pa.int32())), "position_resets": pa.array(out["position_resets"], pa.list_(pa.int32())), "doc_ids": listed, "parts": pa.array(out["parts"], pa.list_(pa.int32())),
    })


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocabulary: str = VOCABULARY, pad: int = 50256, shard_chars: int = 8 << 20) -> DataFrame:
    """Packed rows: shard, pack, input_ids (capacity little-endian uint16, or uint32 where ids pass 65,535), n_tokens, cu_seqlens, position_resets, doc_ids, parts.

    The ids of a text are cut every `capacity` tokens, so no token is lost: the segments of a document
    (doc_ids, in parts order) joined give its ids. A row's segment k lies between cu_seqlens[k] and
    cu_seqlens[k + 1]; positions start at 0 at each of position_resets, the padding's start among them.
    Documents are dealt to shards of about `shard_chars` characters by a hash of id, text and, among rows that
    repeat, a number; a shard is packed by one task; the number of shards grows with the corpus, and only a
    text longer than that makes a shard larger. Null and empty texts have no tokens and no segment. Rows that
    repeat are packed as often as they stand there. Columns but the id and the text are not read. The driver
    reads `vocabulary` and sends it to the executors.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).filter(F.char_length("text") > 0)
    size = d.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars")).first()["chars"]
    shards = max(1, -(-size // shard_chars))
    # Rows that repeat would share a hash: they are counted, in partial sums, and each gets a number of its own.
    key = F.xxhash64("id", "text")
    twice = written(d.groupBy(key.alias("__tally_key")).count().filter("count > 1").select("__tally_key"), "repeats")
    if twice.limit(1).count():
        known = maybe_broadcast(twice)
        keyed = d.withColumn("__tally_key", key)
        many = keyed.join(known, "__tally_key", "left_semi").groupBy("id", "text").agg(F.count("*").cast("int").alias("n"))
        many = many.select("id", "text", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
        d = keyed.join(known, "__tally_key", "left_anti").select("id", "text", F.lit(0).alias("copy")).unionByName(many)
    else:
        d = d.withColumn("copy", F.lit(0))
    d = d.select("id", "text", F.pmod(F.xxhash64("id", "text", "copy"), F.lit(shards)).alias("shard"))
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0]
        out = pack_shard(table.select(["id", "text"]), ranks.value, capacity, pad)
        return out.add_column(0, "shard", pa.array([shard.as_py()] * len(out), pa.int64()))

    return d.groupBy("shard").applyInArrow(run, "shard long, " + PACKED.format(kind))
