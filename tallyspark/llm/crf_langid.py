"""Language of each word by a linear-chain conditional random field.

A word's features are its prefixes and suffixes of one to four bytes, its two- and three-byte grams and
itself (the lexicon), hashed into a weight table; labels of neighbouring words are tied by learned
transitions. Forward-backward gives each word's label probabilities in its line of words, and so the
spans of code-switched text; a document's language is that of the largest expected share of words.
A long run without blanks, as in scripts that write none, is cut into consecutive pieces, and each is
a word of the chain.

The model is fitted on a bounded sample of labelled text (`train_bytes`); all texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Words, col, gram_sums, held_out, maybe_broadcast, mixed, row_key, slices, written

FEATURES = 1 << 16
#: Bytes of a piece of a long word. Pieces overlap by a character or two, so that each gram is in one of them.
PIECE = 64
#: Distinct words whose features are held at once in prediction.
SCORED = 1 << 13


class Pieces(Words):
    """The words of some texts, those over PIECE + 2 bytes in pieces; n_words: how many words each text has."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts)
        self.n_words = np.bincount(self.row, minlength=self.rows)
        long = self.end - self.start > PIECE + 2
        if not long.any():
            return
        many = np.where(long, -(-(self.end - self.start - 2) // PIECE), 1)
        first = np.cumsum(many) - many
        end, row = np.repeat(self.end, many), np.repeat(self.row, many)
        start = self._whole(np.repeat(self.start, many) + PIECE * (np.arange(many.sum()) - np.repeat(first, many)), end)
        start[first] = self.start
        last = np.zeros(len(start), bool)
        last[first + many - 1] = True
        end = np.where(last, end, self._whole(np.minimum(np.append(start[1:], 0) + 2, end), end))
        some = end > start
        self.start, self.end, self.row = start[some], end[some], row[some]

    def _whole(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Moves cuts inside a UTF-8 character behind it."""
        for _ in range(3):
            inside = (at < end) & (self.bytes[np.minimum(at, len(self.bytes) - 1)] >> 6 == 2)
            at = at + inside
        return at


class Features:
    """Hashed features of distinct words: flat feature numbers and the word each is of."""

    def __init__(self, w: Words, which: np.ndarray, hashes: np.ndarray):
        start, end = w.start[which], w.end[which]
        size, n = end - start, len(which)
        flat, word = [(mixed(hashes[which], 20) % np.uint64(FEATURES)).astype(np.int32)], [np.arange(n, dtype=np.int32)]

        def add(at, of, k, seed):
            flat.append((mixed(gram_sums(w.bytes, at, k), seed) % np.uint64(FEATURES)).astype(np.int32))
            word.append(of.astype(np.int32))

        for k in (1, 2, 3, 4):
            of = np.flatnonzero(size >= k)
            add(start[of], of, k, 20 + k)
            add(end[of] - k, of, k, 30 + k)
        for k in (2, 3):
            many = np.maximum(size - k + 1, 0)
            at = np.repeat(start, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            add(at, np.repeat(np.arange(n), many), k, 40 + k)
        self.n = n
        self.flat, self.word = np.concatenate(flat), np.concatenate(word)
        self.count = np.bincount(self.word, minlength=n)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """(words, labels): mean of the features' weights, times the square root of their number."""
        out = np.stack([np.bincount(self.word, weights=weights[self.flat, y], minlength=self.n) for y in range(weights.shape[1])], 1)
        return out / np.sqrt(self.count)[:, None]

    def gradient(self, by_word: np.ndarray) -> np.ndarray:
        g = by_word / np.sqrt(self.count)[:, None]
        return np.stack([np.bincount(self.flat, weights=g[self.word, y], minlength=FEATURES) for y in range(g.shape[1])], 1)


def forward_backward(unary: np.ndarray, length: np.ndarray, first: np.ndarray, step: np.ndarray, pairs: bool = False):
    """Label probabilities of the words of several chains at once.

    `unary` (words, labels) holds the chains one after another, exp(first) starts a chain and
    exp(step) ties neighbours. With pairs=True also the expected number of each transition, and of
    each label at a start. Chains are taken by falling length, so step t works on those still running.
    """
    order = np.argsort(-length, kind="stable")
    begin = (np.cumsum(length) - length)[order]
    length = length[order]
    y = unary.shape[1]
    e = np.exp(unary - unary.max(1, keepdims=True))
    a, b = np.exp(first), np.exp(step)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    longest = int(length[0]) if len(length) else 0
    running = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")
    for t in range(longest):
        at = begin[: running[t]] + t
        x = (a if t == 0 else alpha[at - 1] @ b) * e[at]
        alpha[at] = x / x.sum(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = begin[: running[t + 1]] + t
        x = (beta[at + 1] * e[at + 1]) @ b.T
        beta[at] = x / x.sum(1, keepdims=True)
    p = alpha * beta
    p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
    if not pairs:
        return p
    inner = np.ones(len(e), bool)
    inner[begin + length - 1] = False
    at = np.flatnonzero(inner)
    x = alpha[at][:, :, None] * b[None] * (beta[at + 1] * e[at + 1])[:, None, :]
    x /= x.sum((1, 2), keepdims=True)
    return p, x.sum(0), p[begin].sum(0)


class Model:
    """Labels, feature weights (features, labels), start and transition weights."""

    def __init__(self, labels, weights, first, step):
        self.labels, self.weights, self.first, self.step = labels, weights, first, step

    def predict(self, texts: pa.Array):
        """(words, label probabilities of each word) of some texts; a text is one chain."""
        w = Pieces(texts)
        if not len(w.start):
            return w, np.zeros((0, len(self.labels)))
        hashes = w.hashes()
        _, which, at = np.unique(hashes, return_index=True, return_inverse=True)
        unary = np.concatenate([Features(w, which[i : i + SCORED], hashes).scores(self.weights) for i in range(0, len(which), SCORED)])[at]
        size = np.bincount(w.row, minlength=w.rows)
        return w, forward_backward(unary, size[size > 0], self.first, self.step)


def fit_table(table: pa.Table, epochs: int = 25, chain: int = 40, rate: float = 0.3) -> pa.Table:
    """One row with the model fitted on (text, lang) rows: Adagrad on the likelihood of chains of up to `chain` words.

    Neighbouring documents of the sample follow each other in chains, so changes of language are seen.
    """
    langs = table.column("lang").to_pylist()
    labels = sorted(set(langs))
    y_of = np.array([labels.index(x) for x in langs], np.int64)
    sets = []
    for i, t in slices(table.column("text").combine_chunks()):
        w, y = Pieces(t), y_of[i : i + len(t)]
        if len(w.start):
            hashes = w.hashes()
            _, which, at = np.unique(hashes, return_index=True, return_inverse=True)
            n = len(at)
            length = np.full(-(-n // chain), chain)
            length[-1] = n - chain * (len(length) - 1)
            sets.append((Features(w, which, hashes), at.astype(np.int32), y[w.row].astype(np.int32), length))
    k = len(labels)
    weights, first, step = np.zeros((FEATURES, k)), np.zeros(k), np.zeros((k, k))
    squares = [np.full_like(x, 1e-6) for x in (weights, first, step)]
    for _ in range(epochs if k > 1 else 0):
        for f, at, y, length in sets:
            p, pairs, starts = forward_backward(f.scores(weights)[at], length, first, step, True)
            begin = np.cumsum(length) - length
            inner = np.ones(len(at), bool)
            inner[begin + length - 1] = False
            i = np.flatnonzero(inner)
            seen = np.bincount(y[i] * k + y[i + 1], minlength=k * k).reshape(k, k)
            diff = -p
            diff[np.arange(len(at)), y] += 1
            by_word = np.stack([np.bincount(at, weights=diff[:, c], minlength=f.n) for c in range(k)], 1)
            grads = (f.gradient(by_word) / len(length) - 1e-5 * weights, (np.bincount(y[begin], minlength=k) - starts) / len(length), (seen - pairs) / len(length) - 1e-3 * step)
            for x, g, s in zip((weights, first, step), grads, squares):
                s += g * g
                x += rate * g / np.sqrt(s)
    return pa.table({"labels": pa.array([labels], pa.list_(pa.string())), **{n: pa.array([x.astype(np.float32).tobytes()], pa.binary()) for n, x in (("weights", weights), ("first", first), ("step", step))}})


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_bytes: int = 3 << 20, piece_chars: int = 2048) -> Model | None:
    """Fits on about `train_bytes` bytes of labelled text; None without any.

    Texts are cut into pieces of `piece_chars` characters, of all texts and all of each, and pieces are
    chosen by a hash: half of the bytes by the languages' shares, half evenly among them, so that a rare
    language is learned as well. Rows with null or empty text, or null label, do not count. The bound
    holds whatever the number and the length of the texts, and one task fits on it.
    """
    rows = labelled.select(col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang"), row_key(col(id_col), col(text_col)).alias("key"))
    rows = rows.filter(F.col("lang").isNotNull() & (F.char_length("text") > 0))
    held = written(rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")), "langs")
    n, total = held.agg(F.count("*"), F.sum("bytes")).first()
    if not n:
        return None
    quota = train_bytes * (F.col("bytes") / (2 * total) + 1 / (2 * n))
    rows = rows.join(maybe_broadcast(held.select("lang", (quota / F.col("bytes")).alias("rate"))), "lang")
    rows = rows.select("text", "lang", "rate", "key", F.explode(F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / piece_chars).cast("int"))).alias("at"))
    rows = rows.withColumn("pick", F.xxhash64(F.lit("sample"), "key", "at")).filter(F.pmod("pick", F.lit(1 << 30)) < (1 << 30) * F.col("rate"))
    rows = rows.select(F.substring("text", F.col("at") * piece_chars + 1, F.lit(piece_chars)).alias("text"), "lang", "pick")
    # Sorted by the hash within the one task, so the model does not depend on how rows were dealt.
    one = rows.groupBy(F.lit(1).alias("all")).applyInArrow(lambda t: fit_table(t.sort_by("pick")), "labels array<string>, weights binary, first binary, step binary").first()
    if one is None:
        return None
    k = len(one["labels"])
    read = lambda x, *shape: np.frombuffer(x, np.float32).reshape(*shape).astype(float)
    return Model(list(one["labels"]), read(one["weights"], FEATURES, k), read(one["first"], k), read(one["step"], k, k))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with lang_pred, score, certainty, n_words, lang_shares (map) and n_switches.

    lang_shares: expected share of the words of each label; lang_pred the label with the largest (the
    first by name if equal) and score its share. `und` with score 0 if the text is null, has no letter,
    or there is no model. certainty: mean over the words of the likeliest label's probability, however
    many languages they are of; 0 for `und`. n_switches: how often the likeliest label changes from word to word.
    Pieces of a long word count each for itself, but in n_words, where it is one. A text is held whole, with
    some 60 bytes for each of its own. Rows that repeat give equal rows; other columns, of any name but
    those six, pass through.
    """
    d = docs.drop("lang_pred", "score", "certainty", "n_words", "lang_shares", "n_switches")
    at = d.columns.index(text_col)
    labels = model.labels if model else []

    def run(batches):
        for batch in batches:
            for i, texts in slices(batch.column(at).cast(pa.string())):
                m = len(texts)
                if model:
                    w, p = model.predict(texts)
                    n, nodes = w.n_words, np.bincount(w.row, minlength=m)
                    share = np.stack([np.bincount(w.row, weights=p[:, k], minlength=m) for k in range(len(labels))], 1) / np.maximum(nodes, 1)[:, None]
                    sure = np.bincount(w.row, weights=p.max(1), minlength=m) / np.maximum(nodes, 1)
                    best = p.argmax(1)
                    turn = np.flatnonzero((np.diff(best) != 0) & (np.diff(w.row) == 0))
                    switches = np.bincount(w.row[turn], minlength=m)
                else:
                    n = np.bincount(Words(texts).row, minlength=m)
                    share, sure, switches = np.zeros((m, 1)), np.zeros(m), np.zeros(m, np.int64)
                flat = pa.array(share[:, : len(labels)].ravel(), pa.float64())
                shares = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * len(labels), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, m) for c in batch.columns), pa.array(n, pa.int64()), shares, pa.array(sure, pa.float64()), pa.array(switches, pa.int64())], [*batch.schema.names, "n_words", "__tally_shares", "__tally_sure", "n_switches"])

    # By place, as mapInArrow takes no name with a dot.
    own = [f"__tally_{i}" for i in range(len(d.columns))]
    placed = d.toDF(*own)
    made = placed.mapInArrow(run, StructType([*placed.schema.fields, *StructType.fromDDL("n_words long, __tally_shares array<double>, __tally_sure double, n_switches long").fields]))
    known = F.coalesce(F.col(own[at]).cast("string").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(labels)) & (F.col("n_words") > 0)
    names = F.lit(labels or ["und"])
    top = F.array_max("__tally_shares")
    return made.select(
        *[F.col(x).alias(c) for x, c in zip(own, d.columns)],
        F.when(known, F.element_at(names, F.array_position("__tally_shares", top).cast("int"))).otherwise("und").alias("lang_pred"),
        F.when(known, F.least(top, F.lit(1.0))).otherwise(0.0).alias("score"),
        F.when(known, F.least("__tally_sure", F.lit(1.0))).otherwise(0.0).alias("certainty"),
        "n_words",
        F.when(known, F.map_from_arrays(names, "__tally_shares")).alias("lang_shares"),
        "n_switches",
    )


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 3, part: int = 1, train_bytes: int = 3 << 20) -> DataFrame:
    """identify() with a model trained on the rows whose crc32(id as text) mod `parts` is not `part`; adds held_out."""
    held = held_out(col(id_col), parts, part)
    model = train(docs.filter(~held), id_col, text_col, lang_col, train_bytes)
    return identify(docs.drop("held_out"), model, id_col, text_col).withColumn("held_out", held)
