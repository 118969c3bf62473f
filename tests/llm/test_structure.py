"""Sharding, the filter audit and the prefix trie against plain Python, with odd input."""

import collections
import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import filter_audit, prefix_trie, slots

DOCS = "doc_id long, text string, source string, shard string, slot int, mask string"


def documents(n=400, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice("ab") * rng.randint(1, 9) + rng.choice(("", "", "X", "%")) for _ in range(rng.choice((3, 40, 260)))]
        rows.append((i, " ".join(words), rng.choice((None, "", "s1", "hot", "hot")), "x", 1, None))
    rows += [(1000 + i, rows[i % 7][1], "hot", None, None, None) for i in range(200)]
    rows += [(5000, None, "s1", None, None, None), (5001, "", "s2", None, None, None), (5002, "", None, None, None, None), (None, "no id", "s1", None, None, None), (None, "no id", "s1", None, None, None), (6000, "word " * 30000, "s1", None, None, None)]
    return rows + [(7000, "the same row", "s2", None, None, None)] * 150


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS)


def test_shards_are_near_equal_and_places_gapless(spark, docs):
    got = slots.shard_documents(docs, shards=7, slots=512).collect()
    want = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in documents())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None and r["map_version"] == 1
    assert sorted(by) == list(range(7))
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    loads = {k: sum(r["size"] for r in rows) for k, rows in by.items()}
    of_slot = collections.Counter()
    for r in got:
        of_slot[r["virtual_slot"]] += r["size"]
    mean, largest = sum(loads.values()) / 7, max(of_slot.values())
    assert max(loads.values()) == largest  # a slot beyond the mean, that of the long text, has a shard of its own
    rest = [x for x in loads.values() if x != largest]
    assert max(rest) - min(rest) <= 0.01 * mean
    assert len({r["virtual_slot"] for r in got if r["doc_id"] == 7000}) > 50  # equal rows spread
    moved = [r for r in got if r["next_shard"] != r["shard"]]
    assert moved and sum(r["next_shard"] == 7 for r in moved) > 0.6 * len(moved)
    again = slots.shard_documents(docs.repartition(3), shards=7, slots=512)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got))
    assert slots.shard_documents(docs.limit(0)).count() == 0


def test_map_versions(spark, docs, tmp_path):
    path = f"{tmp_path}/map"
    slots.write_map(spark, path, 0, slots.even_map(64, 4))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        slots.write_map(spark, path, 0, slots.even_map(64, 4))
    rng = random.Random(1)
    load = [rng.randint(0, 99) * (s % 3) for s in range(64)]
    assert slots.rebalance(spark, path, load, 4) == 1
    assert slots.rebalance(spark, path, load, 3) == 2
    for version, shards in ((1, 4), (2, 3)):
        _, owner = slots.read_map(spark, path, version)
        loads = [sum(x for x, k in zip(load, owner) if k == j) for j in range(shards)]
        assert sum(loads) == sum(load) and max(loads) - min(loads) <= 2
    assert slots.read_map(spark, path)[0] == 2
    moves = spark.read.parquet(path).filter("version = 2 AND moved_from IS NOT NULL")
    assert moves.count() == sum(a != b for a, b in zip(slots.read_map(spark, path, 1)[1], slots.read_map(spark, path, 2)[1]))
    assert set(range(4)) >= {r["moved_from"] for r in moves.collect()}
    shards = slots.shard_documents(docs, shards=3, slots=64, map_path=path)
    assert {r["map_version"] for r in shards.collect()} == {3}
    assert slots.rebalanced([0, 0, 1, 1], [0, 0, 0, 0], 2) == [0, 0, 1, 1]
    with pytest.raises(ValueError):
        slots.records(docs, 0)


def brute_audit(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, q, x in labels if v in (("q", q), ("x", x))} for v in (("q", 1), ("x", 1)))
    fails = []
    for i, t, source, *_ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and i > least[t])
        fails.append((source or "", f, i in good, i in toxic))
    out = {}
    for part in {x[0] for x in fails}:
        own = [x for x in fails if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, name in enumerate(order):
                here = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                out[part, "".join(order), k + 1] = [len(left), len(here), sum(name in x[1] for x in own) - len(here), sum(x[1] == name for x in own), sum(x[2] for x in here), sum(x[3] for x in here)]
        for name in "ABCDE":
            steps = [k for k in out if k[0] == part and k[1][k[2] - 1] == name]
            share = sum(out[k][1] for k in steps)
            for k in steps:
                out[k].append(share)
    return out


def test_audit_is_that_of_every_order(spark, docs):
    rng = random.Random(2)
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in [*range(0, 400, 3), *range(1000, 1100), 7000, 7000, None]]
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, source string".replace(", source string", "")))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got.collect()} == brute_audit(documents(), [x for x in labels if x[0] is not None])
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), empty).count() == 0
    assert filter_audit.audit(docs, empty).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_audit_of_other_filters(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels, {"x": F.col("doc_id") % 2 == 0, "y": F.col("text").isNull()}, copies=None, part_col="shard").filter("part = ''").collect()
    assert {(r["filter_order"], r["step"]): (r["removed"], r["shapley"]) for r in got}["yx", 1] == (1, 1)
    with pytest.raises(ValueError):
        filter_audit.audit(docs, labels, {"long": F.lit(True)})


def test_weights_are_shapley(spark):
    for n in (1, 2, 3, 5):
        rng = random.Random(n)
        v = [Fraction(0), *[Fraction(rng.randint(0, 50)) for _ in range((1 << n) - 1)]]
        want = [Fraction(0)] * n
        orders = list(itertools.permutations(range(n)))
        for order in orders:
            s = 0
            for i in order:
                want[i] += (v[s | 1 << i] - v[s]) / len(orders)
                s |= 1 << i
        assert [sum(w * x for w, x in zip(row, v)) for row in filter_audit.coalition_weights(n)] == want


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, chunk string"


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(own[c], key=lambda x: x[:2])] for c in own}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members, ends, below = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(set)
    for c in sorted(made):
        path = made[c]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
            if d:
                below[tuple(path[: d - 1])].add(tuple(path[:d]))
        ends[tuple(path)].append(c)
    out, total = {}, {}
    for node in sorted(members, key=len, reverse=True):
        worth = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        total[node] = (sum(total[x][0] for x in below[node]) or 1, worth + sum(total[x][1] for x in below[node]))
    for node, who in members.items():
        parent = members[node[:-1]][0] if node else None
        out[who[0], len(node)] = (parent, len(who), len(below[node]), *total[node], hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())
    return out


def conversations(n=260, seed=4):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for k in range(rng.randint(1, 12)):
            text = "the hot first turn" if k < 2 and c % 2 else rng.choice(("é", "yes", "no", None, "why " * 20)) if rng.random() < 0.8 else f"own {c}"
            rows.append((c, k if k or c % 7 else None, rng.choice(("user", "assistant", None)) if k > 1 else "user", text, 1, "x"))
    rows += [(1000 + 5 * i, k, "user", f"copy {k}", None, None) for i in range(120) for k in range(4)]
    rows += [(2000, k, "user", f"long {k % 3}", None, None) for k in range(1500)]
    rows += [(3001 + i, 0, "user", "gone", None, None) for i in range(3)]  # turnless where more than one is asked for
    return rows + [(None, 1, "user", "no conversation", None, None), (4000, 1, "user", "twice", None, None), (4000, 1, "user", "twice", None, None), (4001, None, None, None, None, None)]


@pytest.mark.parametrize(("held", "least", "band"), [(200_000, 64, 64), (5, 4, 3)])
def test_trie_is_that_of_plain_python(spark, monkeypatch, held, least, band):
    monkeypatch.setattr(prefix_trie, "LEAST_PIECE", least)
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie, "JOINED", 16)
    rows = conversations()
    random.Random(1).shuffle(rows)
    turns, ids = prefix_trie.rebuilt(prefix_trie.turn_hashes(spark.createDataFrame(rows, CONVERSATIONS)))
    got = prefix_trie.prefix_trie(turns, ids, ["part", "pos"], held).collect()
    want = brute_trie(rows)
    assert len(got) == len(want)
    for r in got:
        assert (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) == want[r["conv_id"], r["depth"]], r


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie.family_trie(none).count() == 0
    nameless = spark.createDataFrame([(None, 1, "user", "x", 1, "")], CONVERSATIONS)
    assert prefix_trie.family_trie(nameless).count() == 0


def test_queue_spills_in_order():
    rng = random.Random(3)
    queue, rows = prefix_trie.SpillingQueue(20), [tuple(rng.randint(-9, 9) for _ in range(6)) for _ in range(3000)]
    out = []
    for k, row in enumerate(rows):
        queue.push(row)
        if k % 3 == 2:
            out.append(queue.pop())
    assert queue.spilled > 10
    left = []
    while queue.first() is not None:
        left.append(queue.pop())
    assert left == sorted(left) and sorted(out + left) == sorted(rows)
