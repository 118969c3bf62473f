"""Each operator against brute force or by its contract, with nulls, empty and long texts, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyspark.llm import brown, common, components, crf_langid, decontaminate, jaccard_join, licenses, line_dedup, mixing, packing, simhash, url_filter

LOW = {k: k + 32 for k in range(65, 91)}
LONG = "A line that many documents hold, long enough to count as one."
SCHEMA = "doc_id long, text string, lang string, source string, score string, _key string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = {lang: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(120)] for lang, a in (("en", "abcdehot"), ("fr", "éèqruxiv"))}
    rows = []
    for i in range(n):
        lang = rng.choice(("en", "fr"))
        text = " ".join(rng.choice(vocabulary[lang]) + rng.choice(("", "", "", ".\n")) for _ in range(rng.randint(1, 60)))
        rows.append((i, text, lang, "hot" if i % 3 == 0 else f"s{i % 4}", "x", "y"))
    for i in range(n, n + 25):
        t = rows[i % 9][1].split(" ")
        if len(t) > 12 and i % 2:
            t[rng.randrange(len(t))] = "edited"
        rows.append((i, " ".join(t), rows[i % 9][2], "hot", None, None))
    rows += [(i, f"{LONG}\nown {i}\n  {LONG.upper()}  ", "en", "s1", None, None) for i in range(900, 907)]
    rows += [(1000, None, None, None, None, None), (1001, "", "en", "s1", None, None), (1002, " \n\t ", "en", "s1", None, None), (1003, "word " * 9000, "en", "s2", None, None), (1004, "one", "en", "s2", None, None), (1004, "one", "en", "s2", None, None), (None, "no id here at all", "en", "s2", None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_brown(docs, none):
    got = brown.score(docs, n_types=40, n_pools=16, n_classes=4, rounds=3, looked_up=30).collect()
    train = collections.Counter()
    for r in corpus():
        if zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 10:
            train.update([*words_of(r[1]), "\0"])
    n, v = sum(train.values()), len(train)
    want = collections.Counter()
    for r in corpus():
        t = [*words_of(r[1]), "\0"]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want[(r[0], len(t), sum(train[w] > 0 for w in t), round(base, 6))] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert brown.score(none, n_types=4, n_pools=4, n_classes=2, rounds=1).count() == 0


def test_licenses(spark, docs, none):
    known = licenses.known_digests(spark)
    mit = next(t for k, t in licenses.known_texts() if k == "MIT" and t.startswith("MIT License\n"))
    rows = [(1, "Copyright (c) 2020 Someone\n" + mit.upper().replace(" ", "  "), "p"), (2, mit.replace("sublicense", "sub-licence"), None), (3, "x\nReleased under the MIT  Licence!\ny", None), (4, None, None), (5, mit[:-40], None)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string"), known).collect()}
    assert got[1]["license"] == got[2]["license"] == "MIT" and got[1]["digest"] == got[2]["digest"]
    assert got[3]["license"] is None and got[3]["notices"] == ["MIT"] and got[3]["n_notices"] == 1
    assert got[4]["digest"] is None and got[5]["license"] is None
    assert licenses.scan_licenses(docs, known).count() == docs.count() and licenses.scan_licenses(none, known).count() == 0
    whole = [(i, f"\n  Copyright 2021 Somebody\n\n{t.upper()}", k) for i, (k, t) in enumerate(licenses.known_texts())]
    got = licenses.scan_licenses(spark.createDataFrame(whole, "doc_id long, text string, want string"), known).filter("license IS NULL OR license <> want").collect()
    assert not got and len({k for _, _, k in whole}) >= 20


def test_sifted_lines_lose_none(spark):
    rng = random.Random(6)
    notices = [t for _, t in licenses.known_texts() if "\n" not in t]
    lines = []
    for i in range(600):
        t = list(rng.choice(notices))
        for _ in range(rng.randint(0, 3)):
            t.insert(rng.randint(0, len(t)), rng.choice([" ", "\t", "*", "«", "&", "\u212a", "x", "(", "İ"]))
        t = "".join(t)
        lines.append(rng.choice([t, t.upper(), t.replace("License", "Licence"), "& " + t, "  // " + t, "copyright x " + t]))
    known = licenses.known_digests(spark)
    d = spark.createDataFrame([(i, "\n".join(lines[i : i + 5])) for i in range(0, 600, 5)], "doc_id long, text string")
    key = lambda df: sorted((r["doc_id"], r["n_notices"], r["notices"]) for r in df.collect())
    sifted = key(licenses.scan_licenses(d, known))
    assert sifted == key(licenses.scan_licenses(d, known.drop("head"))) and sum(n for _, n, _ in sifted) > 100


def test_mixing(docs, none):
    got = mixing.mix(docs, entropy=0.99, most_repeats=3.0, block_docs=4).collect()
    sizes = collections.defaultdict(int)
    for r in corpus():
        sizes[r[3]] += len(words_of(r[1]))
    total = sum(sizes.values())
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert r["mix_tokens"] == len(words_of(r["text"]))
    assert abs(sum(rows[0]["mix_weight"] for s, rows in by.items() if sizes[s]) - 1) < 1e-9
    for source, rows in by.items():
        budget = math.floor(rows[0]["mix_weight"] * total + 0.5)
        drawn = sum(r["mix_tokens"] for r in rows)
        assert budget <= drawn < budget + max(r["mix_tokens"] for r in rows) + 2 or not sizes[source]
        assert all(r["mix_offset"] < budget or not r["mix_tokens"] for r in rows)
    assert mixing.mix(none).count() == 0
    w = {s: rows[0]["mix_weight"] for s, rows in by.items() if sizes[s]}
    h = -sum(x * math.log(x) for x in w.values()) / math.log(len(w))
    assert h >= 0.99 - 1e-6 or max(x * total / sizes[s] for s, x in w.items()) <= 3 + 1e-6


def spark_hash(*values):
    """xxhash64() of longs, ints (as ("i", n)), booleans and strings; nulls are skipped."""
    h = 42
    for v in values:
        if v is None:
            continue
        data = struct.pack("<i", int(v[1]) if isinstance(v, tuple) else v) if isinstance(v, (tuple, bool)) else struct.pack("<q", v) if isinstance(v, int) else v.encode()
        h = xxhash.xxh64_intdigest(data, h & (2**64 - 1))
    return h - (h >> 63 << 64)


def test_mixing_is_the_stream_of_a_plain_loop(docs):
    rows = corpus()
    rows += rows[3:6]
    entries = collections.Counter((r[0], r[3], r[1]) for r in rows)
    sources = collections.defaultdict(list)
    for (i, source, text), times in entries.items():
        key = spark_hash(i is None, i, source is None, source, text is None, text)
        sources[source].append((key, i, len(words_of(text)), times))
    total = sum(n * t for e in sources.values() for _, _, n, t in e)
    share = {s: sum(n * t for _, _, n, t in e) / total for s, e in sources.items()}
    positive = [p for p in share.values() if p]

    def entropy(t):
        z = sum(p**t for p in positive)
        return -sum(p**t / z * math.log(p**t / z) for p in positive)

    low, high = 0.0, 1.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= 0.99 * math.log(len(positive)) else (low, mid)
    got = mixing.mix(docs.unionByName(docs.limit(0)).sparkSession.createDataFrame(rows, SCHEMA), entropy=0.99, most_repeats=None, block_docs=4).collect()
    weight = {r["source"]: r["mix_weight"] for r in got}
    z = sum(p**low for p in positive)
    assert all(abs(w - (share[s] ** low / z if share[s] else 0)) < 1e-3 for s, w in weight.items())
    want = collections.Counter()
    for source, e in sources.items():
        tokens = sum(n * t for _, _, n, t in e)
        budget = math.floor(weight[source] * total + 0.5)
        blocks = math.ceil(sum(t for *_, t in e) / 4)
        for epoch in range(max(1, math.ceil(budget / tokens) if tokens else 1)):
            offset = epoch * tokens
            turn = lambda b: ((spark_hash(("i", 7), epoch, b) & (2**64 - 1)) >> 33, b)  # noqa: B023, E731
            for b in sorted(range(blocks), key=turn):
                mine = [x for x in e if spark_hash(("i", 7), x[0]) % blocks == b]
                for key, i, n, times in sorted(mine, key=lambda x: (spark_hash(("i", 7), epoch, x[0]), x[0])):  # noqa: B023
                    if offset < budget or (n == 0 and epoch == 0):
                        want[(i, source, n, epoch, offset)] += times
                    offset += n * times
    assert collections.Counter((r["doc_id"], r["source"], r["mix_tokens"], r["mix_epoch"], r["mix_offset"]) for r in got) == want
    with pytest.raises(ValueError, match="passes"):
        mixing.mix(docs, budget=10**9, most_repeats=2.0)


def test_rows_whose_columns_swap_places_stay_apart(spark):
    """Nulls are no part of a hash by themselves: these rows once shared a key."""
    a, b = (1, "web words here", None), (1, None, "web words here")
    d = spark.createDataFrame([a, b], "doc_id long, text string, source string")
    assert sorted((r["text"] or "", r["mix_tokens"]) for r in mixing.mix(d, entropy=None, most_repeats=None).collect()) == [("", 0), ("web words here", 3)]
    d = spark.createDataFrame([("zz yy xx", None), (None, "zz yy xx")], "doc_id string, text string")
    got = {r["doc_id"]: r for r in brown.score(d, n_types=2, n_pools=2, n_classes=3, rounds=1, looked_up=0).collect()}
    assert got["zz yy xx"]["n_tokens"] == 1 and got[None]["n_tokens"] == 4 and got["zz yy xx"]["base_score"] > got[None]["base_score"]
    mit = next(t for k, t in licenses.known_texts() if k == "MIT")
    d = spark.createDataFrame([(mit, None), (None, mit)], "doc_id string, text string")
    assert {r["doc_id"]: r["license"] for r in licenses.scan_licenses(d, licenses.known_digests(spark)).collect()} == {mit: None, None: "MIT"}


def test_columns_of_any_name_pass_through(spark):
    """Extra columns with dots, and with the names that operators use within."""
    extra = ["a.b", "id", "key", "rid", "n", "h1", "pos", "words", "word", "shard", "copy", "digest2", "set_id", "token", "held", "n.chars", "`q`"]
    rows = [r[:4] for r in corpus(30)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    wide = spark.createDataFrame([(*r, *[f"{k}-{r[0]}" for k in range(len(extra))]) for r in rows], ["doc_id", "text", "lang", "source", *extra])
    bench = spark.createDataFrame([(1, "no id here at all", "x")], ["item_id", "text", "a.b"])
    known = licenses.known_digests(spark)
    pages = lambda d: d.withColumn("url", F.concat(F.lit("http://h.com/"), F.col("doc_id"))).withColumn("at", F.to_date(F.lit("2024-01-01")))
    entries = spark.createDataFrame([("l", "prefix", "h.com/3", "block", "2023-01-01")], "list string, kind string, pattern string, action string, listed_at string").withColumn("listed_at", F.to_date("listed_at"))
    passing = {
        "licenses": lambda d: licenses.scan_licenses(d, known), "mixing": lambda d: mixing.mix(d, block_docs=4), "langid": crf_langid.identify_documents,
        "decontaminate": lambda d: decontaminate.decontaminate(d, bench), "lines": lambda d: line_dedup.dedup_lines(d, min_chars=10, min_docs=2), "urls": lambda d: url_filter.filter_urls(pages(d), entries, at_col="at").drop("url", "at"),
    }
    for name, run in passing.items():
        a, b = run(plain), run(wide)
        assert set(b.columns) - set(a.columns) == set(extra), name
        both = [c for c in a.columns if c != "lang_shares"]
        key = lambda df: collections.Counter(repr([r[c] if not isinstance(r[c], float) else round(r[c], 6) for c in both]) for r in df.collect())  # noqa: B023, E731
        assert key(a) == key(b), name
        assert all(r["a.b"] == f"0-{r['doc_id']}" and r["`q`"] == f"{len(extra) - 1}-{r['doc_id']}" for r in b.collect()), name
    reading = {"brown": lambda d: brown.score(d, n_types=20, n_pools=4, n_classes=3, rounds=1, looked_up=10).drop("score", "base_score", "perplexity"), "simhash": simhash.fingerprint_documents, "packing": lambda d: packing.pack_documents(d, capacity=64), "jaccard": jaccard_join.jaccard_classes}
    for name, run in reading.items():
        key = lambda df: collections.Counter(map(str, df.collect()))
        assert key(run(plain)) == key(run(wide)), name


def test_shuffled_sides_give_the_same_rows(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, r[1]) for i, r in enumerate(corpus()[:60:7])], "item_id long, text string")
    runs = {
        "decontaminate": lambda: decontaminate.decontaminate(docs, bench).select("doc_id", "n_hit", "items"), "lines": lambda: line_dedup.dedup_lines(docs).select("doc_id", "n_dropped", "kept_text"),
        "licenses": lambda: licenses.scan_licenses(docs, licenses.known_digests(spark)).select("doc_id", "digest", "n_notices"), "mixing": lambda: mixing.mix(docs, block_docs=4).select("doc_id", "mix_offset"),
        "simhash": lambda: simhash.fingerprint_documents(docs).select("doc_id", "edited_sha256", "n_near"), "jaccard": lambda: jaccard_join.jaccard_classes(docs),
    }
    key = lambda df: collections.Counter(map(str, df.collect()))
    before = {name: key(run()) for name, run in runs.items()}
    for module in (decontaminate, line_dedup, licenses, mixing, simhash, jaccard_join):
        monkeypatch.setattr(module, "maybe_broadcast", lambda df: df)
    for name, run in runs.items():
        assert key(run()) == before[name], name


def test_broadcasts_are_bounded_in_bytes(spark):
    d = spark.createDataFrame([(1, "x" * 5000, ["y" * 3000])], "a long, b string, c array<string>")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(common.maybe_broadcast(d, most_bytes=9000)) and not hinted(common.maybe_broadcast(d, most_bytes=7000)) and not hinted(common.maybe_broadcast(d.union(d), rows=1))


def test_long_words_hash_as_a_whole():
    import pyarrow as pa

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é") for _ in range(1000)), "x" * (3 * common.WINDOW + 17), "y " * common.WINDOW, " " + "x" * (3 * common.WINDOW + 17)]
    w = common.Words(pa.array(texts))
    h, names = w.hashes(), [bytes(w.bytes[a:b]) for a, b in zip(w.start, w.end)]
    assert len({(x, y) for x, y in zip(names, h.tolist())}) == len(set(names)) == len(set(h.tolist()))
    value = sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(b"abc")) % (1 << 64)
    assert common.range_sums(np.frombuffer(b"..abc", np.uint8), np.array([2]), np.array([5]))[0] == value == common.gram_sums(np.frombuffer(b"..abc", np.uint8), np.array([2]), 3)[0]


def test_exchange_gains_are_likelihood_differences():
    rng = np.random.default_rng(5)
    text, k = rng.integers(0, 9, 400), 4
    text[50:56] = 3  # words that follow themselves
    classes = rng.integers(0, k, 9)

    def table(classes):
        m = np.zeros((k, k), np.int64)
        np.add.at(m, (classes[text[:-1]], classes[text[1:]]), 1)
        return m

    for t in range(9):
        after, before = np.zeros(k, np.int64), np.zeros(k, np.int64)
        np.add.at(after, classes[text[1:][text[:-1] == t]], 1)
        np.add.at(before, classes[text[:-1][text[1:] == t]], 1)
        gain = brown.gains(table(classes), classes[t], after, before, int(((text[1:] == t) & (text[:-1] == t)).sum()))
        for c in range(k):
            moved = classes.copy()
            moved[t] = c
            assert gain[c] - gain[classes[t]] == pytest.approx(brown.likelihood(table(moved)) - brown.likelihood(table(classes)))
    # A word that is no type: the transitions into it alone.
    m, p, n = table(classes), np.array([0, 1, 3]), np.array([2, 1, 1])
    own = int((m[p] - n[:, None] >= 0).all(0).argmax())
    side = lambda x: float(brown.xlogx(x.astype(float)).sum() - brown.xlogx(x.sum(0).astype(float)).sum())
    values = []
    for c in range(k):
        moved = m.copy()
        moved[p, own] -= n
        moved[p, c] += n
        values.append(side(moved))
    assert brown.best_classes(m, p, n, np.array([0]), np.array([own]))[0] == int(np.argmax(values))


def test_brown_probabilities_sum_to_one(spark, monkeypatch):
    """Transitions from each class, and the words of a class with its unknown one, as scores of one-word texts show them."""
    m = brown.transitions(np.array([[3, 0, 1], [5, 5, 5], [0, 0, 0]]))
    assert np.allclose(m.sum(1), 1)
    monkeypatch.setattr(brown, "held_out", lambda c, parts, part: c >= 1000)
    rng = random.Random(3)
    names = [f"w{i}" for i in range(30)]
    train = [(i, " ".join(rng.choice(names[: rng.randint(2, 30)]) for _ in range(rng.randint(1, 20)))) for i in range(40)]
    seen = sorted({w for _, t in train for w in t.split()})
    # One class for the end and one for all words: what follows a word is the end, or any word after any word.
    asks = [(1000, ""), (1001, "w1"), (1002, "w1 w1"), (1003, "never"), (1004, "never w1"), *((1010 + i, w) for i, w in enumerate(seen))]
    got = {r["doc_id"]: r["score"] for r in brown.score(spark.createDataFrame(train + asks, "doc_id long, text string"), n_types=8, n_pools=4, n_classes=2, rounds=2, looked_up=12).collect()}
    n = collections.Counter(w for _, t in train for w in t.split())
    once, twice = sum(x == 1 for x in n.values()), sum(x == 2 for x in n.values())
    discount = once / (once + 2 * twice) if once and twice else 0.5
    end = (len(train) - discount) / len(train)  # the end's class has room for unknown ends
    first = 1 - 10 ** got[1000] / end  # a word begins the text
    again = 10 ** (got[1002] - got[1001])  # w1 after a word
    # P(text of one word) = P(word class | start) P(word | class) P(end | word class); over all words the middle sums to 1.
    stop = (sum(10 ** got[1010 + i] for i in range(len(seen))) + 10 ** got[1003]) / first
    assert 0 < stop < 1
    in_class = 10 ** got[1001] / (first * stop)
    assert again == pytest.approx((1 - stop / end) * in_class, rel=1e-6)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    unary, first, step = rng.normal(size=(7, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    p, pairs, starts = crf_langid.forward_backward(unary, np.array([4, 1, 2]), first, step, True)
    begin = 0
    want = np.zeros((3, 3))
    for n in (4, 1, 2):
        total, marginal = 0.0, np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            w = math.exp(first[path[0]] + sum(unary[begin + t, y] for t, y in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:])))
            total += w
            for t, y in enumerate(path):
                marginal[t, y] += w
        assert np.allclose(p[begin : begin + n], marginal / total)
        begin += n
    assert pairs.sum() == pytest.approx(4) and starts.sum() == pytest.approx(3)


def test_langid(docs, none):
    got = crf_langid.identify_documents(docs).collect()
    assert len(got) == len(corpus())
    real = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 100 and r["n_words"] > 3]
    assert sum(r["lang_pred"] == r["lang"] for r in real if r["held_out"]) >= 0.95 * sum(r["held_out"] for r in real)
    for r in got:
        assert 0 <= r["score"] <= 1
        if not r["text"] or not r["text"].strip():
            assert r["lang_pred"] == "und"
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 3 == 1)
    assert crf_langid.identify_documents(none).count() == 0


def test_code_switch_is_labelled(spark):
    rows = [(i, r[1], r[2]) for i, r in enumerate(corpus(80)) if r[1]]
    model = crf_langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    en, fr = (next(x[1] for x in rows if x[2] == y and len(x[1].split()) > 15) for y in ("en", "fr"))
    import pyarrow as pa

    w, p = model.predict(pa.array([" ".join(en.split()[:12] + fr.split()[:12])], pa.large_string()))
    names = [model.labels[k] for k in p.argmax(1)]
    assert names[2:10] == ["en"] * 8 and names[14:22] == ["fr"] * 8


def test_long_runs_are_read_whole(spark):
    import pyarrow as pa

    rng = random.Random(5)
    for text in ("".join(rng.choice("中文字a😀é") for _ in range(2000)), "x" * 67, "é" * 33, "y" * 66 + " " + "z" * 200 + "é"):
        w = crf_langid.Pieces(pa.array(["w", text, None], pa.large_string()))
        assert w.n_words.tolist() == [1, len(text.split()), 0]
        raw = bytes(w.bytes)
        covered = {g for a, b in zip(w.start, w.end) for k in (2, 3) for g in ((i, k) for i in range(a, b - k + 1))}
        begin = 1
        for word in text.encode().split():
            assert covered >= {(i, k) for k in (2, 3) for i in range(begin, begin + len(word) - k + 1)}
            begin += len(word) + 1
        assert all(raw[a:b].decode() and b - a <= crf_langid.PIECE + 8 for a, b in zip(w.start, w.end))
    rows = [(i, r[1], r[2]) for i, r in enumerate(corpus(80)) if r[1]]
    model = crf_langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    part = {y: "".join(x[1] for x in rows if x[2] == y).replace(" ", "").replace("\n", "")[:2000] for y in ("en", "fr")}
    d = spark.createDataFrame([(1, part["en"][:150] + part["fr"])], "doc_id long, text string")
    got = crf_langid.identify(d, model).first()
    assert got["lang_pred"] == "fr" and got["n_words"] == 1 and got["n_switches"] >= 1


def test_simhash(docs, none):
    rows = sorted(((r[0], r[1] or "") for r in corpus()), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    got = simhash.fingerprint_documents(docs).collect()
    shas = collections.Counter()
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        third = len(t) // 3
        shas[(i, len(t), hashlib.sha256((t[: len(t) - third] + nxt[:third]).encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == shas
    by_text = collections.defaultdict(set)
    text = {r[0]: r[1] or "" for r in corpus()}

    def plain(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t.lower()) if x]
        hashes = [spark_hash(*w[k : k + 5]) for k in range(max(1, len(w) - 4))]
        return format(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)), "016x")

    want = collections.Counter()
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        want[(i, plain(t), plain(t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]), 64 - bin(int(plain(t), 16) ^ int(plain(nxt), 16)).count("1"))] += 1
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["edited_fingerprint"], round(64 * r["near_next"])) for r in got) == want
    for r in got:
        by_text[text[r["doc_id"]]].add(r["fingerprint"])
        same = 1 - bin(int(r["fingerprint"], 16) ^ int(r["edited_fingerprint"], 16)).count("1") / 64
        assert r["near_edited"] == pytest.approx(same)
    assert all(len(v) == 1 for v in by_text.values())
    fps = {r["fingerprint"] for r in got}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] % 20 == 0:
            assert r["n_near"] == sum(bin(int(f, 16) ^ int(r["fingerprint"], 16)).count("1") <= 3 for f in fps)
    assert simhash.fingerprint_documents(none).count() == 0


def test_simhash_ranges_meet(spark):
    rows = [(i * 7 % 501, f"text {i} " * (i % 5 + 1)) for i in range(501)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["next_id"] for r in simhash.with_next(d, rows_a_bucket=20).collect()}
    assert got == {i: (i - 1 if i else 500) for i in range(501)}


def test_decontaminate(spark, docs, none):
    bench = [(1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron."), (2, "Short item"), (3, None), (4, "..."), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    rows = [(1, "x ALPHA beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu tail", "n"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", None), (3, "a short ITEM short item " + "filler " * 100, None), (4, None, None), (5, "", None), (5, "short item", None), (None, "short item", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, items string")
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.decontaminate(d, b).collect()), key=repr)
    assert got == sorted([(1, 15, 13, ["1", "5"], True), (2, 12, 0, [], False), (3, 105, 4, ["2"], False), (4, 0, 0, [], False), (5, 0, 0, [], False), (5, 2, 2, ["2"], True), (0, 2, 2, ["2"], True)], key=repr)
    assert decontaminate.decontaminate(none, b).count() == 0
    assert decontaminate.decontaminate(docs, b.limit(0)).filter("n_hit > 0").count() == 0


def test_items_fold_letter_by_letter(spark):
    """A capital sigma is folded by what follows it where whole texts are; words must not depend on that."""
    rng = random.Random(9)
    letters = ["ΑΣ", "Σ", "ς", "İ", "I", "ı", "ẞ", "ß", "a", "Z", "\u212a", "é"]
    bench, rows = [], []
    for i in range(40):
        item = "".join(rng.choice(letters) + rng.choice(["", "'", ".", " ", ": "]) for _ in range(rng.randint(2, 40)))
        bench.append((i, item))
        rows.append((i, rng.choice(["x ", "", "Σ."]) + item + rng.choice([" y", "", ".Σ"])))
    fold = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW)) if w]
    items = {i: fold(t) for i, t in bench}
    windows = {(i, tuple(w[k : k + 13])) for i, w in items.items() if w for k in range(max(1, len(w) - 12))}
    want = []
    for i, t in rows:
        w, hit, found = fold(t), set(), set()
        for item, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(str(item))
        want.append((i, len(w), len(hit), sorted(found)))
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.decontaminate(d, b).collect())
    assert got == want and sum(n > 0 for _, _, n, _ in want) > 20


def test_repeated_rows_are_dealt_to_many_shards(spark):
    rows = [(1, "one text " * 40)] * 400 + [(i, f"text {i} " * 30) for i in range(2, 40)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), capacity=128, shard_chars=6000).collect()
    per = collections.Counter()
    for r in got:
        per[r["shard"]] += len(r["doc_ids"])
    assert sum(d == 1 for r in got for d in r["doc_ids"]) == 400 and max(per.values()) < 4 * sum(per.values()) / len(per)


def test_wide_ids_fit():
    assert packing.id_type(65_535) is np.uint16 and packing.id_type(65_536) is np.uint32


def test_packing(docs, none):
    got = packing.pack_documents(docs, capacity=64, shard_chars=4000).collect()
    enc = packing.encoder(packing.read_vocabulary(packing.VOCABULARY))
    parts = collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["input_ids"], np.uint16)
        assert len(ids) == 64 and r["cu_seqlens"][-1] == r["n_tokens"] and (ids[r["n_tokens"] :] == 50256).all()
        assert r["position_resets"][: len(r["doc_ids"])] == r["cu_seqlens"][:-1]
        for k, (d, p) in enumerate(zip(r["doc_ids"], r["parts"])):
            parts[d].append((p, ids[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]].tolist()))
    want = collections.defaultdict(list)
    for r in corpus():
        if r[1]:
            want[r[0]].append(r[1])
    for d, texts in want.items():
        if len(texts) == 1:
            assert enc.decode([x for _, ids in sorted(parts[d]) for x in ids]) == texts[0]
    assert sum(r["n_tokens"] for r in got) == sum(len(enc.encode_ordinary(t)) for ts in want.values() for t in ts)
    assert packing.pack_documents(none).count() == 0


def test_best_fit_decreasing():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 33, 300)
    bins = packing.best_fit_decreasing(lengths, 32)
    assert sorted(i for b in bins for i in b) == list(range(300)) and all(lengths[b].sum() <= 32 for b in bins)
    rooms, plain = [], 0
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            plain += 1
            rooms.append(32 - n)
    assert len(bins) == plain


def test_shingles_are_told_apart_by_all_bits():
    """Tokens that agree in their lower 32 bits and their bucket are still two."""
    import pyarrow as pa

    a, b = np.array([7, (1 << 40) + 7], np.uint64), np.array([0, 0], np.uint8)
    table = pa.table({"chunk": [1, 2], "kind": [0, 0], "a": [b[:1].tobytes()] * 2, "b": [a[:1].tobytes(), a[1:].tobytes()], "c": [b"", b""]})
    assert jaccard_join._count_bucket(table).num_rows == 0
    table = pa.table({"chunk": [1, 2], "kind": [0, 2], "a": [b[:1].tobytes(), a[:1].tobytes()], "b": [a[:1].tobytes(), np.array([5], np.uint32).tobytes()], "c": [b"", b""]})
    got = jaccard_join._count_bucket(table).to_pylist()
    assert [np.frombuffer(r["c"], np.uint32).tolist() for r in got] == [[6], [6]]


def brute_links(rows):
    sets = []
    for i, t in rows:
        w = words_of(t)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent, links = list(range(len(sets))), [0] * len(sets)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for k in range(len(sets)):
        groups[root(k)].append(k)
    least = {r: min((sets[k][0] for k in g if sets[k][0] is not None), default=None) for r, g in groups.items()}
    return collections.Counter((sets[k][0], len(sets[k][1]), least[root(k)], links[k]) for k in range(len(sets)))


@pytest.mark.parametrize("limits", [{}, {"block_sets": 3, "group_sets": 2}])
def test_jaccard(spark, docs, none, limits):
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = [(r[0], r[1]) for r in corpus()]
    for i in range(200, 240):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(80)] = f"e{rng.randrange(99)}"
        rows.append((i, " ".join(t[: rng.choice((80, 80, 76, 70))])))
    for k in range(6):  # one id with two texts, of which another id holds one too
        t = list(base)
        t[10 * k] = f"own{k}"
        rows += [(300 + 2 * k, " ".join(t)), (301 + 2 * k, " ".join(t)), (301 + 2 * k, f"single {k}")]
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), **limits).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got) == brute_links(rows)
    assert jaccard_join.jaccard_classes(none).count() == 0


def test_jaccard_blocks_at_the_size_bound(spark):
    words = [f"w{i}" for i in range(4779)]
    rows = [(i, " ".join([*words[:3824 - i], *(f"a{i}-{k}" for k in range(i))])) for i in range(6)] + [(10, " ".join(words))]
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), block_sets=1, group_sets=2).collect()
    want = brute_links(rows)
    assert want[(10, 4775, 0, 1)] == 1
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got) == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: root(x) for x in parent} and len(got) == len(parent)


def test_line_dedup(docs, none):
    rows = [(r[0], r[1]) for r in corpus()]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(-1 if i is None else i)
    want = collections.Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == i]
        want[(i, len(lines), len(lines) - len(keep), "\n".join(keep))] += 1
    got = line_dedup.dedup_lines(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == want
    assert any(r["n_dropped"] for r in got) and line_dedup.dedup_lines(none).count() == 0


def test_url_filter(spark):
    entries = [("spam", "domain", "bad.com", "block", "2024-02-01"), ("spam", "domain", "bad.com", "remove", "2024-03-01"), ("ok", "domain", "good.bad.com", "allow", "2024-01-01"), ("p", "prefix", "good.bad.com/x", "block", "2024-01-15"), ("spam", "domain", None, "block", "2024-01-01")]
    e = spark.createDataFrame(entries, "list string, kind string, pattern string, action string, listed_at string").withColumn("listed_at", F.to_date("listed_at"))
    caps = [(1, "http://www.BAD.com/a", "2024-01-31"), (2, "http://bad.com", "2024-02-01"), (3, "https://u@bad.com:8080/", "2024-02-29"), (4, "http://bad.com", "2024-03-01"), (5, "http://good.bad.com/", "2024-02-10"), (6, "http://good.bad.com/x?y", "2024-02-10"), (7, None, "2024-02-10"), (8, "not a url", "2024-02-10"), (9, "http://a.bad.com", None), (2, "http://bad.com", "2024-02-01")]
    c = spark.createDataFrame([(*x, "z") for x in caps], "page_id long, url string, fetched_at string, verdict string").withColumn("fetched_at", F.to_date("fetched_at"))
    got = sorted((r["page_id"], r["verdict"], r["n_active"]) for r in url_filter.filter_urls(c, e).collect())
    assert got == [(1, "allow", 0), (2, "block", 1), (2, "block", 1), (3, "block", 1), (4, "allow", 0), (5, "allow", 2), (6, "block", 3), (7, "allow", 0), (8, "allow", 0), (9, "allow", 0)]
    assert url_filter.filter_urls(c.limit(0), e).count() == 0
    entries = [("p", "prefix", "a.com/x/y", "block"), ("p", "prefix", "HTTP://www.B.com/", "block"), ("p", "domain", "www.C.com", "block"), ("q", "prefix", "d.com", "allow"), ("q", "domain", "sub.d.com", "block"), ("q", "prefix", "?", "block")]
    e = spark.createDataFrame([(*x, "2024-01-01") for x in entries], "list string, kind string, pattern string, action string, listed_at string").withColumn("listed_at", F.to_date("listed_at"))
    caps = {"http://a.com/x/y/z": "block", "http://a.com/x/yy": "allow", "http://a.com/x": "allow", "http://www.a.com//x//y?q": "block", "http://m.a.com/x/y": "block", "http://b.com/q": "block", "http://b.com": "block", "https://C.com./": "block", "http://sub.d.com/1": "allow", "http://xa.com/x/y": "allow", "http://e.com/" + "s/" * 500: "allow"}
    c = spark.createDataFrame([(u, "2024-02-01") for u in caps], "url string, fetched_at string").withColumn("fetched_at", F.to_date("fetched_at"))
    assert {r["url"]: r["verdict"] for r in url_filter.filter_urls(c, e).collect()} == caps


def test_url_filter_hosts(spark):
    e = spark.createDataFrame([("l", "prefix", "/ads", "block", 1), ("l", "prefix", "", "block", 1), ("l", "domain", " ", "block", 1), ("l", "domain", None, "block", 1), ("l", "prefix", None, "block", 1), ("l", "domain", "3.4", "block", 1), ("l", "domain", "5.6.7.8", "block", 1), ("l", "domain", "[2001:DB8::1]:443", "block", 1), ("l", "prefix", "http://[::2]/x", "block", 1)], "list string, kind string, pattern string, action string, listed_at int")
    urls = {"http://ads/x": "allow", "http://1.2.3.4/": "allow", "http://5.6.7.8:80/a": "block", "http://[2001:db8::1]/": "block", "http://[2001:db8::2]/": "allow", "http://u@[::2]:8080/x/y": "block", "http://[::2]/y": "allow", "http://[::ffff:1.2.3.4]/": "allow", "/ads": "allow", "http:///": "allow"}
    c = spark.createDataFrame([(u, 2) for u in urls], "url string, fetched_at int")
    assert {r["url"]: r["verdict"] for r in url_filter.filter_urls(c, e).collect()} == urls
    assert {r["pattern"] for r in url_filter.validity_intervals(e).collect()} == {"3.4", "5.6.7.8", "[2001:db8::1]", "[::2]/x"}


def test_simhash_of_text_ids(spark):
    ids = [f"d-{i:04d}" for i in range(300)] + [None]
    d = spark.createDataFrame([(i, f"words of document {i} are here and there") for i in ids], "doc_id string, text string")
    got = {r["id"]: r["next_id"] for r in simhash.with_next(d, rows_a_bucket=20).collect()}
    order = [*sorted(filter(None, ids), reverse=True), None]
    assert got == dict(zip(order, [*order[1:], order[0]])) and len(simhash.range_cuts(d.selectExpr("doc_id AS id", "1 AS weight"), 10, 301)) >= 5
    rows = simhash.fingerprint_documents(d).collect()
    assert len(rows) == 301 and {r["doc_id"] for r in rows if r["n_near"] is not None} == {i for i in ids if i and zlib.crc32(i.encode()) % 20 == 0}
