"""What the text operators share: the shared folder, checked broadcasts, numpy word splitting."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A-Z and the white space of the text contracts, `[\x20\x09-\x0D]`.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"

#: Rows and bytes up to which a counted side may be broadcast; past either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one in local mode; on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes `df` as Parquet to the shared folder and reads it again."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(field: T.StructField) -> Column:
    """About how many bytes a value of the column takes."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(8)


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows of `most_bytes` in all, else as it is (shuffle join).

    Both are counted, in one aggregate; give a written table.
    """
    width = F.lit(0)
    for field in df.schema.fields:
        width = width + _width(field)
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= most_bytes else df


def col(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(*columns: Column) -> Column:
    """A 64-bit hash in which null and '' differ, and so do values in another column. Joins compare an id beside it."""
    return F.xxhash64(*[x for c in columns for x in (c.isNull(), c)])


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone. lower() is used where it means the same, as translate() is slow."""
    other = c.rlike(r"[\p{IsUppercase}\p{IsTitlecase}&&[^A-Z]]")
    return F.when(other, F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls in `part` of `parts`; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


# ---- numpy on Arrow string columns: used inside mapInArrow tasks ----

_P = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32
#: Bytes that are hashed at once; the powers of the hash base reach no further.
WINDOW = 1 << 17
_powers: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """The first WINDOW powers of the hash base mod 2**64, and of its inverse."""
    if not _powers:
        for base in (_P, pow(_P, -1, 1 << 64)):
            x = np.full(WINDOW, base, np.uint64)
            x[0] = 1
            _powers.append(np.cumprod(x))
    return _powers


def range_sums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """sum((data[i] + 1) * P ** (i - start)) of each range; ranges ascend and do not overlap.

    Ranges are taken in windows of the bytes, a longer range by itself in pieces, so memory does not
    grow with the length of a text.
    """
    up, down = powers()
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + WINDOW, side="right")))
        if end[j - 1] - start[i] <= WINDOW:
            low = int(start[i])
            part = data[low : int(end[j - 1])]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
            at = start[i:j] - low
            out[i:j] = (sums[end[i:j] - low] - sums[at]) * down[at]
        else:
            for at in range(int(start[i]), int(end[i]), WINDOW):
                part = data[at : min(at + WINDOW, int(end[i]))]
                value = int(((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)]).sum(dtype=np.uint64))
                out[i] = (int(out[i]) + value * pow(_P, at - int(start[i]), 1 << 64)) % (1 << 64)
        i = j
    return out


def gram_sums(data: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """range_sums() of the k bytes from each place, in any order of places."""
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out += (data[at + j].astype(np.uint64) + np.uint64(1)) * powers()[0][j]
    return out


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit words (the finaliser of splitmix64)."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: lower-cased bytes, start and end of each word, the row it is of."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.rows = len(texts)
        if self.rows == 0 or off[-1] == off[0]:
            self.bytes = np.zeros(0, np.uint8)
            self.start = self.end = self.row = np.zeros(0, np.int64)
            return
        self.bytes = _TO_LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]]]
        off = off - off[0]
        inside = ~_SPACE[self.bytes]
        cut = np.zeros(len(inside) + 1, bool)  # a text begins here
        cut[off] = True
        before = np.concatenate([[False], inside[:-1]])
        self.start = np.flatnonzero(inside & (~before | cut[:-1]))
        before = np.concatenate([inside[1:], [False]])
        self.end = np.flatnonzero(inside & (~before | cut[1:])) + 1
        self.row = np.searchsorted(off, self.start, side="right") - 1

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return mixed(range_sums(self.bytes, self.start, self.end), 1)


def slices(column: pa.Array, most_bytes: int = 1 << 19):
    """(first row, texts) for runs of about `most_bytes` of text; a longer text stands alone. Null is empty."""
    texts = column.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most_bytes, side="right")) - 1)
        yield i, texts.slice(i, j - i)
        i = j
