"""Language-model scoring with Brown's class-based bigrams.

log10 P(text) = sum over words of log10 P(class | class before) + log10 P(word | class). Classes are
learned by exchange clustering of word types over the whole training text; transitions and emissions
are counts over it.

Words are named by 64-bit hashes. Exchange goes over the `n_types` most frequent words, each for itself, with all
others pooled by a hash of their last three bytes. Every further word of the training text, however
many there are, then gets a class of its own by the same likelihood, from the classes its occurrences
follow; the class it is read as by the word after it stays that of its pool, so that a word's share of
a score needs nothing but its own row of a join. Words that training does not hold have their pool's class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Words, col, held_out, mixed, range_sums, row_key, slices, written

#: The token that ends a text, as a hash.
END = -0x5851F42D4C957F2D
#: Tokens of words without a type that are brought together in one task.
BUCKET_TOKENS = 1 << 20


def xlogx(x):
    return x * np.log(np.maximum(x, 1))


def likelihood(matrix: np.ndarray) -> float:
    """What the log likelihood of the class bigrams is beyond what no classing changes."""
    m = matrix.astype(float)
    return float(xlogx(m).sum() - xlogx(m.sum(0)).sum() - xlogx(m.sum(1)).sum())


def gains(matrix: np.ndarray, a: int, after: np.ndarray, before: np.ndarray, own: int) -> np.ndarray:
    """likelihood() with one type in each class, less what it is without the type.

    The type is in class `a`; classes stand `after` and `before` it so often, and it follows itself `own` times
    (which both hold in place a).
    """
    m = matrix.astype(float)
    m[a, :] -= after
    m[:, a] -= before
    m[a, a] += own
    rows, columns = matrix.sum(1).astype(float), matrix.sum(0).astype(float)
    rows[a] -= after.sum()
    columns[a] -= before.sum()
    x, y = after.astype(float), before.astype(float)
    x[a] -= own
    y[a] -= own
    by_row, by_column = xlogx(m + x) - xlogx(m), xlogx(m + y[:, None]) - xlogx(m)
    d = np.diagonal(m)
    corner = xlogx(d + x + y + own) - xlogx(d)
    out = by_row.sum(1) - np.diagonal(by_row) + by_column.sum(0) - np.diagonal(by_column) + corner
    return out - (xlogx(rows + after.sum()) - xlogx(rows)) - (xlogx(columns + before.sum()) - xlogx(columns))


def _rows(docs: DataFrame, id_col: str, text_col: str, parts: int, part: int) -> DataFrame:
    return docs.select(row_key(col(id_col), col(text_col)).alias("key"), col(id_col).alias("id"), held_out(col(id_col), parts, part).alias("held"), col(text_col).cast("string").alias("text"))


def count_words(rows: DataFrame, n_pools: int) -> DataFrame:
    """(word, pool, n): how often each word, ends included, stands in training texts, and its pool of last bytes."""

    def batch_of(words, counts, pools):
        return pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(pools, pa.int32()), pa.array(counts, pa.int64())], ["word", "pool", "n"])

    def tally(batches):
        words, counts, pools = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, texts in slices(batch.column(3)):
                w = Words(texts)
                keep = ~held[i : i + len(texts)]
                mine = keep[w.row]
                u, at, n = np.unique(w.hashes()[mine].view(np.int64), return_index=True, return_counts=True)
                pool = pools_of(w, n_pools)[mine][at]
                ends = [END] if keep.any() else []
                words, counts, pools = np.concatenate([words, u, ends]).astype(np.int64), np.concatenate([counts, n, [keep.sum()][: len(ends)]]).astype(np.int64), np.concatenate([pools, pool, [-1][: len(ends)]]).astype(np.int64)
                if len(words) > 500_000:
                    words, counts, pools = _summed(words, counts, pools)
                    if len(words) > 250_000:
                        yield batch_of(words, counts, pools)
                        words, counts, pools = words[:0], counts[:0], pools[:0]
        yield batch_of(*_summed(words, counts, pools))

    return rows.mapInArrow(tally, "word long, pool int, n long").groupBy("word", "pool").agg(F.sum("n").alias("n"))


def _summed(words, counts, pools):
    if not len(words):
        return words, counts, pools
    u, first, at = np.unique(words, return_index=True, return_inverse=True)
    return u, np.bincount(at, weights=counts).astype(np.int64), pools[first]


def pools_of(w: Words, n_pools: int) -> np.ndarray:
    """The pool of each word: a hash of its last three bytes."""
    return (mixed(range_sums(w.bytes, np.maximum(w.start, w.end - 3), w.end), 8) % np.uint64(n_pools)).astype(np.int64)


def places(hashes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted table, whether it is there) of each hash."""
    if not len(table):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.searchsorted(table, hashes)
    at[at == len(table)] = 0
    return at, table[at] == hashes


def _sequences(column, heads, n_pools):
    """For each run of texts: its first row, tokens a text, and types and hashes of the tokens, ends included."""
    for i, texts in slices(column):
        w = Words(texts)
        h = w.hashes()
        at, known = places(h, heads)
        kind = np.where(known, at, len(heads) + pools_of(w, n_pools))
        size = np.bincount(w.row, minlength=len(texts)) + 1
        n = int(size.sum())
        types, hashes, inner = np.full(n, len(heads) + n_pools, np.int32), np.full(n, END, np.int64), np.ones(n, bool)
        inner[np.cumsum(size) - 1] = False
        types[inner], hashes[inner] = kind, h.view(np.int64)
        yield i, size, types, hashes


def _before(types: np.ndarray, end: int) -> np.ndarray:
    """The type before each token: texts follow each other behind their ends."""
    return np.append(np.int32(end), types[:-1])


def cluster(rows: DataFrame, heads: np.ndarray, n_pools: int, n_classes: int, rounds: int, least_gain: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Exchange clustering: (class of each type, class bigram counts of the training text).

    Types follow the text as 16-bit numbers in a table of their own. In a round each task counts, for
    every type, the classes before and after it; the counts are summed by blocks of types; and each
    type of the part at turn moves to the class that raises the likelihood of the class bigrams most.
    As the types of a part move at once, the likelihood is taken anew after each round: one that lowered it is
    undone and smaller parts follow. Rounds end when two in a row add less than `least_gain` of all that
    was won, or after `rounds`.
    """
    n_types = len(heads) + n_pools + 1
    end = n_types - 1
    wide = np.uint16 if n_types <= 1 << 16 else np.uint32

    def encode(batches):
        for batch in batches:
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, size, types, _ in _sequences(batch.column(3), heads, n_pools):
                keep = np.repeat(~held[i : i + len(size)], size)
                yield pa.RecordBatch.from_arrays([pa.array([types[keep].astype(wide).tobytes()], pa.binary())], ["types"])

    text = written(rows.mapInArrow(encode, "types binary"), "types")
    n_blocks = 16
    block = -(-n_types // n_blocks)

    def contexts(classes):
        classes = classes.astype(np.int64)

        def run(batches):
            sums, own = np.zeros((2, n_types * n_classes), np.int64), np.zeros(n_types, np.int64)
            held = []

            def add():
                t = np.concatenate(held)
                before = np.concatenate([_before(x, end) for x in held])
                sums[0] += np.bincount(t * n_classes + classes[before], minlength=sums.shape[1])
                sums[1] += np.bincount(before * n_classes + classes[t], minlength=sums.shape[1])
                own[:] += np.bincount(t[t == before], minlength=n_types)
                held.clear()

            for batch in batches:
                for x in batch.column(0).to_pylist():
                    if x:
                        held.append(np.frombuffer(x, wide).astype(np.int64))
                    if sum(map(len, held)) > 500_000:
                        add()
            if held:
                add()
            whole = np.concatenate([sums.reshape(2, n_types, n_classes), np.broadcast_to(own[None, :, None], (2, n_types, 1))], 2)
            parts = [whole[:, b * block : (b + 1) * block] for b in range(n_blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(range(n_blocks), pa.int32()), pa.array([p.astype(np.uint32).tobytes() if p.size == 0 or p.max() < 1 << 32 else p.tobytes() for p in parts], pa.binary())], ["block", "sums"])

        return run

    def add(table: pa.Table) -> pa.Table:
        b = table.column("block")[0].as_py()
        shape = 2, max(0, min(block, n_types - b * block)), n_classes + 1
        total = np.zeros(shape, np.int64)
        for x in table.column("sums").to_pylist():
            total += np.frombuffer(x, np.uint32 if len(x) == 4 * total.size else np.int64).reshape(shape)
        return pa.table({"block": pa.array([b], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    def move(classes, matrix, turn, parts):
        def run(batches):
            for batch in batches:
                for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    before, after = np.frombuffer(x, np.int64).reshape(2, -1, n_classes + 1)
                    out_t, out_c = [], []
                    for k in range(len(after)):
                        t = b * block + k
                        if t == end or not after[k, :-1].any() or (t * 2654435761 >> 7) % parts != turn % parts:
                            continue
                        a = classes[t]
                        gain = gains(matrix, a, after[k, :-1], before[k, :-1], after[k, -1])
                        gain[classes[end]] = -np.inf  # the end's own
                        best = int(gain.argmax())
                        if best != a and gain[best] > gain[a]:
                            out_t.append(t)
                            out_c.append(best)
                    yield pa.RecordBatch.from_arrays([pa.array(out_t, pa.int64()), pa.array(out_c, pa.int64())], ["type", "class"])

        return run

    classes = np.arange(n_types) % (n_classes - 1) + 1 if n_classes > 1 else np.zeros(n_types, int)
    classes[end] = 0  # the end has a class of its own
    best, first, parts, idle = None, None, 2, 0
    for turn in range(rounds + 1):
        sums = written(text.mapInArrow(contexts(classes), "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary"), "contexts")
        matrix = np.zeros((n_classes, n_classes), np.int64)
        for r in sums.mapInArrow(_class_matrix(classes, n_classes, block), "matrix binary").collect():  # one small table a block
            matrix += np.frombuffer(r["matrix"], np.int64).reshape(n_classes, n_classes)
        value = likelihood(matrix)
        if best is not None and value < best[0]:
            parts *= 2
        else:
            first = value if first is None else first
            idle = idle + 1 if best is not None and value - best[0] < least_gain * (value - first) else 0
            best = value, classes, matrix, sums
        if turn == rounds or n_classes < 3 or idle > 1:
            break
        _, classes, matrix, sums = best
        classes = classes.copy()
        for r in sums.mapInArrow(move(classes, matrix, turn, parts), "type long, class long").toArrow().to_pylist():  # at most n_types rows
            classes[r["type"]] = r["class"]
    return best[1], best[2]


def _class_matrix(classes, n_classes, block):
    def run(batches):
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, after = np.frombuffer(x, np.int64).reshape(2, -1, n_classes + 1)
                out = np.zeros((n_classes, n_classes), np.int64)
                np.add.at(out, classes[b * block : b * block + len(after)], after[:, :-1])
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["matrix"])

    return run


def best_classes(matrix: np.ndarray, before: np.ndarray, n: np.ndarray, start: np.ndarray, own: np.ndarray, taken: int | None = None) -> np.ndarray:
    """The class of each word that raises the likelihood of the transitions into it most, all else as in `matrix`.

    Word k holds the entries start[k]..start[k + 1]: it follows class before[i] n[i] times; it counts in class own[k] now.
    taken: a class that takes no word.
    """
    m, size = matrix.astype(float), matrix.sum(0).astype(float)
    once = xlogx(m + 1) - xlogx(m)
    out = np.zeros(len(own), np.int64)
    bounds = np.append(start, len(before))
    for low in range(0, len(own), 2048):
        high = min(low + 2048, len(own))
        a, b = bounds[low], bounds[high]
        p, k = before[a:b], n[a:b].astype(float)
        gain = once[p]
        more = np.flatnonzero(k > 1)
        gain[more] = xlogx(m[p[more]] + k[more, None]) - xlogx(m[p[more]])
        # In its own class the word is there already.
        c = np.repeat(own[low:high], np.diff(bounds[low : high + 1]))
        at = np.arange(b - a)
        gain[at, c] = xlogx(m[p, c]) - xlogx(np.maximum(m[p, c] - k, 0))
        at = bounds[low:high] - a
        gain, total = np.add.reduceat(gain, at), np.add.reduceat(k, at)
        cost = xlogx(size + total[:, None]) - xlogx(size)
        c, at = own[low:high], np.arange(high - low)
        cost[at, c] = xlogx(size[c]) - xlogx(np.maximum(size[c] - total, 0))
        gain -= cost
        if taken is not None:
            gain[:, taken] = -np.inf
        out[low:high] = gain.argmax(1)
    return out


def refine(rows: DataFrame, tokens: int, heads: np.ndarray, n_pools: int, n_classes: int, classes: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """(word, class, before, to, moved): the class of each training word that is no type, in rows with a word;
    in the others how many transitions from `before` to class `to` are added (moved) by that.

    Words are dealt to buckets by their hash, `tokens` of them in all; a task brings its own counts, so that
    a bucket holds each word once a task and class at most.
    """
    end = len(heads) + n_pools
    n_buckets = 64
    while n_buckets * BUCKET_TOKENS < tokens:
        n_buckets *= 2
    shift = np.uint64(64 - n_buckets.bit_length() + 1)
    pair = np.uint16 if n_classes**2 <= 1 << 16 else np.uint32

    def contexts(batches):
        words, pairs, held_n = [], [], 0

        def deal():
            w, p = np.concatenate(words), np.concatenate(pairs)
            order = np.lexsort((p, w))
            w, p = w[order], p[order]
            at = np.flatnonzero(np.concatenate([[True], (np.diff(w) != 0) | (np.diff(p) != 0)]))
            n = np.diff(np.append(at, len(w))).astype(np.uint32)
            w, p = w[at], p[at]
            bucket = (w >> shift).astype(np.int64)
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            to = np.append(at[1:], len(w))
            small = lambda x: x.astype(np.uint8) if x.max() < 256 else x
            return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int64()), *(pa.array([x[a:b].tobytes() if x is not n else small(x[a:b]).tobytes() for a, b in zip(at, to)], pa.binary()) for x in (w, p, n))], ["bucket", "words", "pairs", "ns"])

        for batch in batches:
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, size, types, hashes in _sequences(batch.column(3), heads, n_pools):
                mine = np.repeat(~held[i : i + len(size)], size) & (types >= len(heads)) & (types != end)
                if mine.any():
                    words.append(hashes.view(np.uint64)[mine])
                    pairs.append((classes[_before(types, end)[mine]] * n_classes + classes[types[mine]]).astype(pair))
                    held_n += int(mine.sum())
                if held_n > 1_000_000:
                    yield deal()
                    words, pairs, held_n = [], [], 0
        if words:
            yield deal()

    def assign(table: pa.Table) -> pa.Table:
        w = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()])
        p = np.concatenate([np.frombuffer(x, pair) for x in table.column("pairs").to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint8 if len(x) * 8 == len(y) else np.uint32).astype(np.int64) for x, y in zip(table.column("ns").to_pylist(), table.column("words").to_pylist())])
        order = np.lexsort((p, w))
        w, p, n = w[order], p[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], (np.diff(w) != 0) | (np.diff(p) != 0)]))
        w, p, n = w[at], p[at].astype(np.int64), np.add.reduceat(n, at)
        start = np.flatnonzero(np.concatenate([[True], np.diff(w) != 0]))
        before, own = p // n_classes, (p % n_classes)[start]
        new = best_classes(matrix, before, n, start, own, int(classes[end]))
        each = np.diff(np.append(start, len(w)))
        moved = np.bincount(before * n_classes + np.repeat(new, each), weights=n, minlength=n_classes**2) - np.bincount(p, weights=n, minlength=n_classes**2)
        cells = np.flatnonzero(moved)
        some, none = [None] * len(start), [None] * len(cells)
        return pa.table({
            "word": pa.array([*w[start].view(np.int64).tolist(), *none], pa.int64()), "class": pa.array([*new.tolist(), *none], pa.int32()),
            "before": pa.array([*some, *(cells // n_classes).tolist()], pa.int32()), "to": pa.array([*some, *(cells % n_classes).tolist()], pa.int32()), "moved": pa.array([*some, *moved[cells].astype(np.int64).tolist()], pa.int64())})

    dealt = rows.mapInArrow(contexts, "bucket long, words binary, pairs binary, ns binary")
    return dealt.groupBy("bucket").applyInArrow(assign, "word long, class int, before int, to int, moved long")


def transitions(matrix: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """P(class | class before), smoothed towards the share of the class; each row sums to 1."""
    sizes = matrix.sum(0).astype(float)
    share = (sizes + 1) / (sizes.sum() + len(sizes))
    return (matrix + weight * share[None, :]) / (matrix.sum(1, keepdims=True) + weight)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 10, part: int = 0, n_types: int = 8192, n_pools: int = 4096, n_classes: int = 64, rounds: int = 10, looked_up: int = 131_072) -> DataFrame:
    """For every row of docs: held_out, token counts, base_score, score and perplexity.

    Learns from the texts whose crc32(id as text) mod `parts` is not `part`. Tokens: the words of the
    text (A-Z lower-cased) and one end. base_score: add-0.1 unigram log10 probability. score: log10
    probability by the class model; class transitions are smoothed towards class shares, emissions by
    absolute discounting, which leaves each class a mass for unknown words. Null or empty text: its end
    alone. No training text: each token has base probability 1 and score 0. Rows that repeat each have
    their row; a null id counts as the empty text in the split. Very long texts are read whole; columns but the id and the
    text are not read.

    `n_types` words are exchanged and `looked_up` words scored without a join; neither bounds which words
    have counts, a class and an emission of their own.
    """
    rows = _rows(docs, id_col, text_col, parts, part)
    counts = written(count_words(rows, n_pools), "counts")
    s = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count("*").alias("V"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), F.lit(0)).alias("ends")).first()
    total, distinct, ends = int(s["N"]), int(s["V"]), int(s["ends"])
    discount = s["n1"] / (s["n1"] + 2 * s["n2"]) if s["n1"] and s["n2"] else 0.5
    often = counts.filter(F.col("word") != END).orderBy(F.desc("n"), "word")
    top = often.limit(n_types).toArrow()  # bounded by the parameter
    heads, head_n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    by = np.argsort(heads)
    heads, head_n = heads[by], head_n[by]
    classes, matrix = cluster(rows, heads, n_pools, n_classes, rounds)
    end_class = int(classes[len(heads) + n_pools])
    refined = written(refine(rows, total - ends - int(head_n.sum()), heads, n_pools, n_classes, classes, matrix), "refined")
    for r in refined.filter("word IS NULL").groupBy("before", "to").agg(F.sum("moved").alias("moved")).collect():  # n_classes**2 rows at most
        matrix[r["before"], r["to"]] += r["moved"]
    words = written(counts.filter(F.col("word") != END).join(refined.filter("word IS NOT NULL").select("word", "class"), "word", "left"), "words")
    top = words.orderBy(F.desc("n"), "word").limit(looked_up).toArrow()  # bounded by the parameter
    near, near_n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    by = np.argsort(near)
    near, near_n = near[by], near_n[by]
    at, is_head = places(near, heads)
    near_class = np.where(is_head, classes[at], top.column("class").fill_null(0).to_numpy()[by])

    log_step = np.log10(transitions(matrix))
    # Emissions: tokens and distinct words of each class.
    sizes = matrix.sum(0).astype(float)
    log_size = np.log10(np.maximum(sizes, 1))
    vocabulary = np.bincount(classes[: len(heads)], minlength=n_classes)
    for r in words.filter("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("v")).collect():  # n_classes rows
        vocabulary[r["class"]] += r["v"]
    vocabulary[end_class] += bool(ends)
    unknown = np.log10(np.maximum(discount * np.maximum(vocabulary, 1), 1e-9)) - log_size
    end_base = math.log10((ends + 0.1) / (total + 0.1 * (distinct + 1))) if total else 0.0
    end_bits = math.log10(max(ends - discount, 1e-9)) - log_size[end_class] if ends else float(unknown[end_class])
    base_of = np.log10((near_n + 0.1) / (total + 0.1 * (distinct + 1))) if total else np.zeros(len(near))
    emit_of = np.log10(np.maximum(near_n - discount, 1e-9)) - log_size[near_class]

    def own(batches):
        """A row for each text: sums over its ends and looked-up words; its other words with the class before, the pool's class and number."""
        for batch in batches:
            keys, ids, held = batch.column(0), batch.column(1), batch.column(2)
            for i, size, types, hashes in _sequences(batch.column(3), heads, n_pools):
                m = len(size)
                row = np.repeat(np.arange(m), size)
                at, known = places(hashes.view(np.uint64), near)
                end = hashes == END
                c, p = np.where(known, near_class[at] if len(near) else 0, classes[types]), classes[_before(types, len(heads) + n_pools)]
                sums = lambda which, x: np.bincount(row[which], weights=x, minlength=m)  # noqa: B023, E731
                sure = known | end
                base = sums(known, base_of[at[known]]) + end_base
                got = sums(known, emit_of[at[known]]) + sums(sure, log_step[p[sure], c[sure]]) + end_bits
                other = np.flatnonzero(~sure)
                other = other[np.lexsort((p[other], hashes[other], row[other]))]
                new = np.ones(len(other), bool)
                new[1:] = (np.diff(row[other]) != 0) | (np.diff(hashes[other]) != 0) | (np.diff(p[other]) != 0)
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(other)))
                first = other[first]
                off = pa.array(np.searchsorted(row[first], np.arange(m + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(off, pa.array(x, t)) for x, t in ((hashes[first], pa.int64()), (p[first], pa.int16()), (c[first], pa.int16()), (n, pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, m), ids.slice(i, m), held.slice(i, m), pa.array(size.astype(np.int64)), pa.array(np.bincount(row[known], minlength=m) + bool(ends), pa.int64()), pa.array(base), pa.array(got), *lists],
                    ["key", "id", "held", "n_tokens", "n_known", "base", "score", "words", "befores", "pools", "ns"])

    fields = StructType.fromDDL("held boolean, n_tokens long, n_known long, base double, score double, words array<long>, befores array<short>, pools array<short>, ns array<int>").fields
    kept = written(rows.mapInArrow(own, StructType([StructField("key", rows.schema["key"].dataType), rows.schema["id"], *fields])), "scores")
    # The words that are not looked up meet their counts and classes in a shuffle join, whatever their number.
    tails = kept.select("key", "id", F.explode(F.arrays_zip("words", "befores", "pools", "ns")).alias("t"))
    tails = tails.select("key", "id", F.col("t.words").alias("word"), F.col("t.befores").alias("before"), F.col("t.pools").alias("pool"), F.col("t.ns").alias("n"))
    joined = tails.join(words.select("word", F.col("n").alias("c"), "class"), "word", "left")
    joined = joined.select("key", "id", "before", "n", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("class", "pool").alias("class"))
    c, n, k = F.col("c"), F.col("n"), F.col("class") + 1
    step = F.element_at(F.lit(log_step.ravel().tolist()), F.col("before") * n_classes + k)
    base = n * F.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    emitted = n * (step + F.when(c > 0, F.log10(F.greatest(c - discount, F.lit(1e-9))) - F.element_at(F.lit(log_size.tolist()), k)).otherwise(F.element_at(F.lit(unknown.tolist()), k)))
    more = joined.select("key", "id", F.when(c > 0, n).otherwise(0).alias("m_known"), base.alias("m_base"), emitted.alias("m_score"))
    more = more.groupBy("key", "id").agg(F.sum("m_known").alias("m_known"), F.sum("m_base").alias("m_base"), F.sum("m_score").alias("m_score"))
    # Rows that repeat share key and id, and so were summed together.
    times = kept.groupBy("key", "id").agg(F.count("*").alias("times"))
    both = lambda a, b: (a["key"] == b["key"]) & a["id"].eqNullSafe(b["id"])
    more = more.join(times, both(more, times)).select(more["key"].alias("m_key"), more["id"].alias("m_id"), "m_known", "m_base", "m_score", "times")
    out = kept.select("key", "id", "held", "n_tokens", "n_known", "base", "score").join(more, (F.col("key") == F.col("m_key")) & F.col("id").eqNullSafe(F.col("m_id")), "left")
    add = lambda x: F.coalesce(F.col(x) / F.col("times"), F.lit(0.0))
    result = out.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens",
        (F.col("n_known") + F.round(add("m_known"))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + add("m_base") if total else F.lit(0.0)).alias("base_score"),
        (F.col("score") + add("m_score") if total else F.lit(0.0)).alias("score"),
    )
    return result.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
