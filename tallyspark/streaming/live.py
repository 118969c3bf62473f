"""Captures as a stream: each micro-batch derives its calls, re-assembles their whole sessions and publishes what changed.

Derived tables are kept by day. A batch writes a version of the days it touches and no others. A manifest for each
version says which version holds each day, so the last one is all that is read of the past; an index from calls and
sessions to days, in hash buckets kept the same way, says which days a batch has to look at.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.operators import assemble, derive, detect, pricing
from tallyspark.sources import captures as sources
from tallyspark.sources.catalog import catalog_meta
from tallyspark.sources.maintenance import backfill_report, merge_dims, pending, quarantine, refresh_if_stale
from tallyspark.streaming.standing import refresh_totals
from tallyspark.streaming.versions import last_done, latest_days, part_sizes, read_manifest, read_parts, read_table, write_manifest, write_parts  # noqa: F401

#: Fixed value: the day of rows without a time.
NO_DAY = "0000-00-00"
TABLES = {"generations": "started_at", "tool_calls": "call_started_at", "sessions": "started_at", "alerts": "occurred_at", "failures": "at"}
EVENTS = "batch long, seq long, kind string, call_id long, session_id string, trace_id string"


def stream_calls(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """New capture files as they come."""
    return spark.readStream.schema(sources.SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def change_feed(captured: DataFrame, derived: DataFrame, failures: DataFrame, batch_id: int, ranges: int = 1024) -> DataFrame:
    """(batch, seq, kind, call_id, session_id, trace_id): events of a batch, numbered within it by kind and call id.

    capture.started for each capture (id), generation.derived and derive.failed. Numbers are running counts over
    stretches of call ids, `ranges` at most, and a row number within each: no task numbers a whole batch.
    """
    none = F.lit(None).cast("string")
    began = captured.select(F.lit("capture.started").alias("kind"), F.col("id").alias("call_id"), none.alias("session_id"), none.alias("trace_id"))
    ok = derived.select(F.lit("generation.derived").alias("kind"), "call_id", "session_id", "trace_id")
    bad = failures.select(F.lit("derive.failed").alias("kind"), "call_id", none.alias("session_id"), none.alias("trace_id"))
    x = began.unionByName(ok).unionByName(bad)
    low, high = x.agg(F.min("call_id"), F.max("call_id")).first()
    width = 1 if low is None else -(-(high - low + 1) // ranges)
    x = x.withColumn("stretch", F.floor((F.col("call_id") - F.lit(low or 0)) / width))
    sizes = x.groupBy("kind", "stretch").agg(F.count("*").alias("n"))
    before = sizes.select("kind", "stretch", (F.sum("n").over(Window.partitionBy("kind").orderBy("stretch")) - F.col("n")).alias("before"))
    at = F.row_number().over(Window.partitionBy("kind", "stretch").orderBy("call_id"))
    return x.join(before, ["kind", "stretch"]).select(F.lit(batch_id).cast("long").alias("batch"), (F.col("before") + at).cast("long").alias("seq"), "kind", "call_id", "session_id", "trace_id")


#: Hash buckets of the index. A batch reads and writes those of its calls and sessions.
BUCKETS = 256


def _bucketed(keys: DataFrame) -> DataFrame:
    return keys.withColumn("part", F.pmod(F.xxhash64("kind", "key"), F.lit(BUCKETS)).cast("string"))


def keys_of(ids: DataFrame, kind: str, column: str) -> DataFrame:
    """(kind, key): what the index knows rows of a table by."""
    return ids.filter(F.col(column).isNotNull()).select(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("key")).distinct()


def days_of(spark: SparkSession, root: str, before: int, keys: DataFrame) -> dict[str, set[str]]:
    """For each kind of keys the days in which rows with them may lie: no more pairs than kinds times days."""
    keys = _bucketed(keys)
    parts = {r["part"] for r in keys.select("part").distinct().collect()}  # BUCKETS at most
    known = read_parts(spark, root, "index", before, parts)
    out: dict[str, set[str]] = {}
    if known is not None and parts:
        for r in known.join(keys.drop("part"), ["kind", "key"], "left_semi").select("kind", "day").distinct().collect():
            out.setdefault(r["kind"], set()).add(r["day"])
    return out


def add_to_index(spark: SparkSession, root: str, version: int, pairs: DataFrame, gone: DataFrame | None = None, whole: bool = False) -> None:
    """Puts (kind, key, day) into the index, in place of what it has of the keys in `gone`.

    A day that no longer has a row of some other key stays listed with it: that costs a look and no more.
    """
    pairs = _write(_bucketed(pairs.distinct()), f"{root}/work/v={version}/pairs")
    touched, known = None, None
    if not whole:
        keys = pairs.select("part") if gone is None else pairs.select("part").unionByName(_bucketed(gone).select("part"))
        touched = {r["part"] for r in keys.distinct().collect()}
        known = read_parts(spark, root, "index", version, touched)
    if known is not None and gone is not None:
        known = known.join(gone, ["kind", "key"], "left_anti")
    rows = pairs if known is None else _bucketed(known.select("kind", "key", "day").unionByName(pairs.drop("part")).distinct())
    write_parts(spark, root, "index", version, rows, touched)


#: By which columns a table's rows are looked up.
KEYS = {"generations": ("call_id", "session_id"), "tool_calls": ("call_id",), "sessions": ("session_id",), "alerts": ("call_id", "session_id"), "failures": ("call_id",)}


def day_of(name: str) -> Column:
    return F.coalesce(F.date_format(TABLES[name], "yyyy-MM-dd"), F.lit(NO_DAY))


def replace_rows(spark: SparkSession, root: str, name: str, version: int, new: DataFrame, leaving: dict[str, DataFrame], whole: bool = False, days: dict[str, set[str]] | None = None, table: bool = False) -> DataFrame:
    """Writes a version of the days in which rows leave or come: without those that have a key of `leaving`, with `new`.

    `days` (as days_of() gives them for the leaving keys) are the only old ones looked at. whole: all that was there
    leaves. table: `new` is one that was written already. Returns what the index has to know of the new rows.
    """
    new = new.withColumn("part", day_of(name))
    new = new if table else _write(new, f"{root}/work/v={version}/new-{name}")
    old, touched, sizes = None, None, part_sizes(new)  # the days of one batch
    if not whole:
        touched = set(sizes)
        for column in leaving:
            touched |= (days or {}).get(f"{name}.{column}", set())
        old = read_parts(spark, root, name, version, touched)
    rows = new
    if old is not None:
        for column, ids in leaving.items():
            old = old.join(ids.select(column).filter(F.col(column).isNotNull()).distinct(), column, "left_anti")
        rows = old.withColumn("part", day_of(name)).unionByName(new, allowMissingColumns=True)
    if whole or touched or old is None:
        write_parts(spark, root, name, version, rows, touched, sizes)
    return _union([new.filter(F.col(c).isNotNull()).select(F.lit(f"{name}.{c}").alias("kind"), F.col(c).cast("string").alias("key"), F.col("part").alias("day")).distinct() for c in KEYS[name]])


#: What the requests declare, kept once for each fingerprint: table -> its key. A set comes after its members, so it is there with all of them or not at all.
HARNESS = {"system_prompts": "system_hash", "tool_schemas": "tools_hash", "tool_sets": "tools_hash"}


def merge_harness(spark: SparkSession, root: str, version: int, calls: DataFrame, whole: bool = False) -> None:
    """Adds the prompts, tool sets and their members that are not there yet. whole: all that was there leaves.

    Kept by the first two digits of the fingerprint: a batch looks at those of its own and writes those that gain a row.
    """
    work = f"{root}/work/v={version}"
    made = _write(derive.harness_rows(derive.normalised_calls(calls, ("segs", "decls"))), f"{work}/harness")
    prompts, sets = (made.filter(F.col("kind") == k).select(F.col("hash").alias(h), f"{k}.*") for k, h in (("prompt", "system_hash"), ("set", "tools_hash")))
    at = lambda name: F.left(HARNESS[name], F.lit(2))
    new = {"system_prompts": prompts, "tool_sets": sets}
    if not whole:
        for name, df in new.items():
            known = read_parts(spark, root, name, version, {r["part"] for r in df.select(at(name).alias("part")).distinct().collect()})  # 256 at most
            new[name] = df if known is None else _write(merge_dims(df, known, HARNESS[name]), f"{work}/new-{name}")
    new["tool_schemas"] = derive.tool_schemas(new["tool_sets"])
    new = {n: new[n].drop("tools").withColumn("parser_version", F.lit(derive.PARSER_VERSION)).withColumn("part", at(n)) for n in HARNESS}
    for name, df in new.items():
        sizes = part_sizes(df)
        old = None if whole else read_parts(spark, root, name, version, set(sizes))
        if whole or sizes or old is None:
            rows = df if old is None else old.withColumn("part", at(name)).unionByName(df)
            write_parts(spark, root, name, version, rows, None if old is None else set(sizes), sizes)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _write(df: DataFrame, path: str) -> DataFrame:
    """A table named by its batch: a batch that runs again writes the same one anew."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def process_batch(calls: DataFrame, batch_id: int, root: str, rates: tuple[DataFrame, DataFrame, DataFrame], whole: bool = False) -> None:
    """Derives a batch and replaces what it touches: its calls with their tool rows, the sessions these are or were in, their rollups, alerts and failures; adds what prompts and tool sets are new.

    Order is by start time and a session is assembled whole, so a call that comes late, however late,
    lands where it belongs. Nothing is dropped for lateness. A call that is sent again replaces its row, whatever
    session it was in; of several in one batch the last to end counts. A failure stays until its call succeeds; the row
    of a call that fails when sent again stays as it was. whole: the tables are made anew of these calls.
    """
    spark = calls.sparkSession
    once = Window.partitionBy("id").orderBy(F.desc_nulls_last("timestamp_end"), F.xxhash64("request_body", "response_body"))
    calls = calls.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
    good, failures = quarantine(calls)
    g, tools, _, _ = derive.derive_generations(good)
    work = f"{root}/work/v={batch_id}"
    version = pricing_stamp(rates)
    new = _write(pricing.price(g, *rates, version=version), f"{work}/generations")
    failures = _write(failures, f"{work}/failures")
    new_tools = _write(tools, f"{work}/tools")
    merge_harness(spark, root, batch_id, good, whole)
    ids = new.select("call_id")
    added = ("agent_id", "agent_role", "agent_name", "span_id", "trace_id", "parent_span_id", "depth")
    part_of = lambda name, days, column: read_parts(spark, root, name, batch_id, days.get(f"{name}.{column}", set()))
    old = None if whole else part_of("generations", days_of(spark, root, batch_id, keys_of(ids, "generations.call_id", "call_id")), "call_id")
    if old is None:
        sessions, again = _write(new.select("session_id").filter("session_id IS NOT NULL").distinct(), f"{work}/sessions"), new
    else:
        moved = old.join(ids, "call_id", "left_semi").select("session_id")
        sessions = _write(new.select("session_id").unionByName(moved).filter("session_id IS NOT NULL").distinct(), f"{work}/sessions")
        there = part_of("generations", days_of(spark, root, batch_id, keys_of(sessions, "generations.session_id", "session_id")), "session_id")
        rest = there.join(sessions, "session_id", "left_semi").join(ids, "call_id", "left_anti").drop(*added)
        again = rest.unionByName(new, allowMissingColumns=True)
    done = _write(assemble.assemble(again), f"{work}/assembled")
    failed = failures.select("call_id")
    leaving = {"generations": {"session_id": sessions, "call_id": ids}, "tool_calls": {"call_id": done}, "sessions": {"session_id": sessions}, "failures": {"call_id": ids.unionByName(failed)}, "alerts": {"session_id": sessions, "call_id": done.select("call_id").unionByName(failed)}}
    gone = _write(_union([keys_of(df, f"{name}.{c}", c) for name, by in leaving.items() for c, df in by.items()]), f"{work}/keys")
    days = {} if whole else days_of(spark, root, batch_id, gone)
    own = done.select("call_id", F.col("started_at").alias("call_started_at"), "trace_id")
    prior = None if whole else part_of("tool_calls", days, "call_id")
    kept = new_tools.drop("trace_id")
    if prior is not None:
        # Tool rows of the sessions' other calls stay; those of the batch's calls are replaced, or go.
        kept = prior.drop("trace_id", "call_started_at").join(done.select("call_id"), "call_id", "left_semi").join(ids, "call_id", "left_anti").unionByName(kept, allowMissingColumns=True)
    done_tools = _write(kept.join(own, "call_id"), f"{work}/tool_calls")
    rows = {"generations": done, "tool_calls": done_tools, "sessions": assemble.rollup_sessions(done), "failures": failures, "alerts": detect.alerts(done, done_tools, failures)}
    pairs = [replace_rows(spark, root, name, batch_id, df, leaving[name], whole, days, name in ("generations", "tool_calls", "failures")) for name, df in rows.items()]
    add_to_index(spark, root, batch_id, _union(pairs), gone, whole)
    refresh_totals(spark, root, batch_id)
    if last_done(spark, f"{root}/changes") != batch_id:  # a batch that runs again has the same events: readers may have them
        _write(change_feed(calls, done.join(ids, "call_id", "left_semi"), failures, batch_id), f"{root}/changes/v={batch_id}")
    stamp(spark, root, batch_id, version)


def start_live(spark: SparkSession, path: str, root: str, rates: tuple[DataFrame, DataFrame, DataFrame], checkpoint: str, once: bool = True):
    """Runs process_batch over a capture folder; with once=True over what is there now, resuming where it stopped."""
    writer = stream_calls(spark, path).writeStream.foreachBatch(lambda df, i: process_batch(df, i, root, rates)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


# ---- jobs over stored captures ----


def stamp(spark: SparkSession, root: str, version: int, rates_version: str) -> None:
    """Notes with which parser and which rates the tables were made."""
    spark.createDataFrame([(derive.PARSER_VERSION, rates_version)], "parser_version string, pricing_version string").coalesce(1).write.mode("overwrite").parquet(f"{root}/meta/v={version}")


def pricing_stamp(rates: tuple[DataFrame, DataFrame, DataFrame]) -> str:
    """The version of the pricing rules and the digest of all three rate tables."""
    digests = [catalog_meta(df, provider).first()["digest"] for df, provider in zip(rates, ("provider", "provider", "id"))]
    return pricing.stamp(hashlib.sha256("".join(digests).encode()).hexdigest())


def next_version(spark: SparkSession, root: str) -> int:
    last = last_done(spark, f"{root}/meta")
    return 0 if last is None else last + 1


def backfill(calls: DataFrame, root: str, rates: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """Derives the captures that have neither a row of this parser version nor a failure on record; one row that reports on it."""
    spark = calls.sparkSession
    version = next_version(spark, root)
    have, failed = read_table(spark, root, "generations"), read_table(spark, root, "failures")
    todo = calls if have is None else pending(calls, have, derive.PARSER_VERSION)
    if failed is not None:
        todo = todo.join(failed.select(F.col("call_id").alias("id")), "id", "left_anti")
    todo = _write(todo.select(*calls.columns), f"{root}/work/pending-{version}")
    process_batch(todo, version, root, rates)
    return backfill_report(todo, spark.read.parquet(f"{root}/work/v={version}/generations"), spark.read.parquet(f"{root}/work/v={version}/failures"))


def rebuild(calls: DataFrame, root: str, rates: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """Drops every derived table and makes it anew from the captures; one row that reports on it. Ids are functions of the captures, so they stay.

    Dropped are the rows of TABLES and HARNESS, the index and the totals: the manifests of the new version name nothing older. Each table changes
    from its old rows to its new ones at once, so readers see none of them empty; a rebuild that broke off is run again as the same version.
    """
    spark = calls.sparkSession
    version = next_version(spark, root)
    process_batch(calls, version, root, rates, whole=True)
    return backfill_report(calls, spark.read.parquet(f"{root}/work/v={version}/generations"), spark.read.parquet(f"{root}/work/v={version}/failures"))


def reprice_tables(spark: SparkSession, root: str, rates: tuple[DataFrame, DataFrame, DataFrame]) -> None:
    """All generations at new rates, with the rollups and alerts that follow from them; reads no payload."""
    version = next_version(spark, root)
    g, tools, failures = (read_table(spark, root, n) for n in ("generations", "tool_calls", "failures"))
    if g is None:
        return
    rates_version = pricing_stamp(rates)
    g = _write(pricing.reprice(g, *rates, version=rates_version), f"{root}/work/v={version}/generations")
    rows = {"generations": g, "sessions": assemble.rollup_sessions(g), "alerts": detect.alerts(g, tools, failures)}
    add_to_index(spark, root, version, _union([replace_rows(spark, root, name, version, df, {}, True) for name, df in rows.items()]))
    refresh_totals(spark, root, version)
    stamp(spark, root, version, rates_version)


def refresh(calls: DataFrame, root: str, rates: tuple[DataFrame, DataFrame, DataFrame]) -> str:
    """Rebuilds if the parser moved, reprices if only the rates did, else backfills; says which."""
    spark = calls.sparkSession
    last = last_done(spark, f"{root}/meta")
    meta = spark.read.parquet(f"{root}/meta/v={last}").first().asDict() if last is not None else {"parser_version": derive.PARSER_VERSION, "pricing_version": pricing_stamp(rates)}
    what = refresh_if_stale(meta, derive.PARSER_VERSION, pricing_stamp(rates))
    if what == "rebuild":
        rebuild(calls, root, rates)
    elif what == "reprice":
        reprice_tables(spark, root, rates)
    else:
        backfill(calls, root, rates)
    return what


def reprice_if_changed(g: DataFrame, rates: tuple[DataFrame, DataFrame, DataFrame], digest: str, known: str) -> DataFrame:
    """The generations at new rates if the catalogue's digest moved, else as they are."""
    return g if digest == known else pricing.reprice(g, *rates, version=pricing.stamp(digest))
