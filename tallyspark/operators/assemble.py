"""Agents, traces, spans and sessions of generations, set-wise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.scalars import fingerprint, stop_sequence_tag
from tallyspark.functions.tables import cut


#: What classify_agents() reads of a call beside its id, session, time, model, system prompt and billing variant.
ROLE_FACTS = ("tools_hash", "tools_declared_count", "max_tokens", "system_segments", "stop_sequences")


def session_baseline(g: DataFrame, by: str = "session_id") -> DataFrame:
    """Adds max_tools, main_model and main_variant: the session's most tools, and the model and variant of the first call with them."""
    session = Window.partitionBy(by)
    x = g.withColumn("max_tools", F.max(F.coalesce("tools_declared_count", F.lit(0))).over(session))
    full = F.coalesce("tools_declared_count", F.lit(0)) == F.col("max_tools")
    first = F.min_by(F.struct("model", "billing_variant"), F.when(full, F.struct("started_at", "call_id"))).over(session)
    return x.withColumn("_first", first).withColumn("main_model", F.col("_first.model")).withColumn("main_variant", F.col("_first.billing_variant")).drop("_first")


def classify_agents(g: DataFrame, by: str = "session_id") -> DataFrame:
    """Adds agent_id, agent_role and agent_name by an ordered rule table over what the provider sends."""
    return with_roles(session_baseline(g, by))


def with_roles(x: DataFrame) -> DataFrame:
    """The rule table of classify_agents over rows that have their session's max_tools, main_model and main_variant; drops these."""
    tools = F.coalesce("tools_declared_count", F.lit(0))
    none = tools == 0
    agent = fingerprint(F.col("billing_variant"), F.col("system_hash"), F.col("tools_hash"))
    rules = [
        (none & (F.col("max_tokens") == 1) & (F.coalesce("system_segments", F.lit(0)) == 0), "probe", F.lit("quota-probe")),
        (none & F.col("stop_sequences").isNotNull(), "sidechain", F.concat(F.lit("classifier:"), F.coalesce(stop_sequence_tag(F.col("stop_sequences")), F.lit("classifier")))),
        (none, "sidechain", F.lit("sidechain")),
        (F.col("billing_variant").isNotNull() & (F.col("billing_variant") == F.col("main_variant")), "main", F.lit("main")),
        (tools < F.col("max_tools"), "subagent", F.concat(F.lit("subagent:"), F.coalesce(F.get(F.split("model", "-"), F.lit(1)), F.lit("agent")))),
        (F.col("main_model").isNull() | F.col("model").eqNullSafe(F.col("main_model")), "main", F.lit("main")),
        (tools == F.col("max_tools"), "subagent", F.lit("subagent:peer")),
    ]
    role, name = F.lit("unknown"), F.concat(F.lit("agent-"), F.left(agent, F.lit(6)))
    for hit, r, n in reversed(rules):
        hit = F.coalesce(hit, F.lit(False))
        role, name = F.when(hit, F.lit(r)).otherwise(role), F.when(hit, n).otherwise(name)
    return x.withColumns({"agent_id": agent, "agent_role": role, "agent_name": name}).drop("max_tools", "main_model", "main_variant")


def trace_name(call):
    return fingerprint(F.lit("trace"), F.col("session_id"), call, length=32)


def span_name():
    return fingerprint(F.lit("gen"), F.col("session_id"), F.col("call_id"))


def begins():
    """Whether a row begins a trace, by the main call before it in `_prev`."""
    turned = F.coalesce("new_user_turn", F.lit(False)) | F.coalesce(F.col("_prev.stop_reason") == "end_turn", F.lit(False)) | ~F.col("_prev.first_turn_hash").eqNullSafe(F.col("first_turn_hash"))
    return (F.col("agent_role") == "main") & (F.col("_prev").isNull() | turned)


def traced(g: DataFrame, by: str = "session_id") -> DataFrame:
    """Adds trace_id, and for helpers parent_span_id; `_unsure` where that needs a look at the other main calls.

    A trace begins with the first main call, when the human speaks, after a call that ended its turn,
    and when the conversation's first turn is another. It ends with its last main call. A helper attaches to
    the first trace that was open when it started. Of the traces, those that end later than all before them
    matter for that: the first to end at or after a time is the first of them in the order of their ends, so a
    window over ends and helpers' starts finds it. All windows are partitioned by session: one shuffle serves them.
    """
    at = [F.col("started_at"), F.col("call_id")]
    so_far = Window.partitionBy(by).orderBy(*at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(by).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    main = F.col("agent_role") == "main"
    prev = F.last(F.when(main, F.struct("stop_reason", "first_turn_hash")), True).over(earlier)
    x = g.withColumn("_prev", prev).withColumn("_begins", begins())
    x = x.withColumn("_ordinal", F.when(main, F.sum(F.col("_begins").cast("int")).over(so_far)))
    own = Window.partitionBy(by, "_ordinal").orderBy(*at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.withColumns({"_trace": F.when(main, trace_name(F.first("call_id").over(own))), "_end": F.when(F.col("_begins"), F.last(F.coalesce("ended_at", "started_at")).over(own))})
    top = F.max("_end").over(earlier)
    x = x.withColumn("_later", F.col("_begins") & (top.isNull() | (F.col("_end") > top)))
    key = F.when(F.col("_later"), F.col("_end")).when(~main, F.col("started_at"))
    by_end = Window.partitionBy(by).orderBy(key.desc_nulls_last(), main.desc(), F.col("call_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("_open", F.last(F.when(F.col("_later"), F.struct(F.col("_trace").alias("trace"), F.col("started_at").alias("start"))), True).over(by_end))
    joined = F.when(F.col("_open.start") <= F.col("started_at"), F.col("_open.trace"))
    x = x.withColumn("trace_id", F.when(main, F.col("_trace")).otherwise(F.coalesce(joined, trace_name(F.col("call_id")))))
    return hosted(x, [by]).drop("_prev", "_begins", "_ordinal", "_trace", "_end", "_later", "_open")


def hosted(x: DataFrame, by: list[str], chunks: DataFrame | None = None) -> DataFrame:
    """Adds parent_span_id, `_unsure` and `_overlaps` to rows with their trace.

    The latest main call of the trace that was running is as a rule the last that had started. A helper for which that
    one was over while an earlier one may not have been is `_unsure`; its parent is among the main calls that ran on
    when the next had started (`_overlaps`). With `chunks`, `by` names chunks of sessions and `chunks` what each chunk of a trace takes over.
    """
    main = F.col("agent_role") == "main"
    ended = main & F.col("ended_at").isNotNull()
    began = Window.partitionBy(*by, "trace_id").orderBy(F.col("started_at"), main.desc(), F.col("call_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*by, "trace_id", "_ended").orderBy("started_at", "call_id")
    host, longest = F.last(F.when(ended, F.struct("ended_at", "span_id")), True).over(began), F.max(F.when(ended, F.col("ended_at"))).over(began)
    if chunks is not None:
        x = x.join(chunks, [*by, "trace_id"])
        host, longest = F.coalesce(host, F.col("host")), F.greatest(longest, F.col("longest"))
    x = x.withColumns({"_host": host, "_longest": longest, "_ended": ended})
    # At the end of a chunk the next one is not seen: then it may overlap.
    x = x.withColumn("_overlaps", F.col("_ended") & F.coalesce(F.col("ended_at") >= F.lead("started_at").over(after), F.lit(chunks is not None)))
    runs = F.col("_host.ended_at") >= F.col("started_at")
    x = x.withColumns({"parent_span_id": F.when(~main & runs, F.col("_host.span_id")), "_unsure": F.coalesce(~main & ~runs & (F.col("_longest") >= F.col("started_at")), F.lit(False))})
    return x.drop("_host", "_longest", "_ended", "host", "longest")


def carried(rows: DataFrame, by: list[str], **told) -> DataFrame:
    """(by, _c, name..): what each chunk `_c` of a key takes over from the chunks before it.

    `told` gives for each name an aggregate over a chunk that is null where the chunk has nothing to tell, and how those of several
    chunks make one (left out: the last that tells counts). A key has a row a chunk, so the window is over as many rows as there are chunks.
    """
    before = Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    told = {n: t if isinstance(t, tuple) else (t, lambda c: F.last(c, True)) for n, t in told.items()}
    parts = rows.groupBy(*by, "_c").agg(*[a.alias(f"_{n}") for n, (a, _) in told.items()])
    return parts.select(*by, "_c", *[fold(f"_{n}").over(before).alias(n) for n, (_, fold) in told.items()])


def traced_in_chunks(k: DataFrame, by: str, rows: int, chunk_calls: int) -> DataFrame:
    """The rows of `traced` over `classify_agents` for very long sessions: no task takes more than about `chunk_calls` of the `rows` calls.

    Rows are cut in ranges of (session, time), so a session is a row of chunks. Each scan over a session is one within its
    chunks, begun with what the chunks before left (`carried`). Helpers meet traces in a second cut, by the time they ask
    for. A session's own facts are aggregates, one row for each session. Calls of one instant stay in one chunk. Needs `_row` and
    span_id; each step is a table in the shared folder.
    """
    n = -(-rows // chunk_calls)
    at = F.struct("started_at", "call_id")
    main = F.col("agent_role") == "main"
    so_far = Window.partitionBy(by, "_c").orderBy("started_at", "call_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = so_far.rowsBetween(Window.unboundedPreceding, -1)

    tools = F.coalesce("tools_declared_count", F.lit(0))
    base = cut(k.groupBy(by).agg(F.max(tools).alias("max_tools"), F.min_by(F.struct("model", "billing_variant"), F.struct((-tools).alias("less"), "started_at", "call_id")).alias("_first")), "baseline")
    base = F.broadcast(base.select(by, "max_tools", F.col("_first.model").alias("main_model"), F.col("_first.billing_variant").alias("main_variant")))  # one row for each long session: `rows` / `hot_calls` at most
    x = k.repartitionByRange(n, by, "started_at").withColumn("_c", F.spark_partition_id())
    x = cut(with_roles(x.join(base, by)), "roles")

    x = x.join(carried(x, [by], before=F.max_by(F.struct("stop_reason", "first_turn_hash"), F.when(main, at))), [by, "_c"])
    x = x.withColumn("_prev", F.coalesce(F.last(F.when(main, F.struct("stop_reason", "first_turn_hash")), True).over(earlier), F.col("before")))
    x = cut(x.withColumn("_begins", begins()).drop("_prev", "before"), "begun")

    # A main call is of the trace that began last; a trace is named by its first call.
    x = x.join(carried(x, [by], before=F.max_by(F.struct(F.col("call_id").alias("of")), F.when(F.col("_begins"), at))), [by, "_c"])
    of = F.coalesce(F.last(F.when(F.col("_begins"), F.struct(F.col("call_id").alias("of"))), True).over(so_far), F.col("before"))
    x = cut(x.withColumn("_of", F.when(main, of["of"])).drop("before"), "owned")
    traces = x.filter(main).groupBy(by, F.col("_of").alias("call_id")).agg(F.max_by(F.coalesce("ended_at", "started_at"), at).alias("_end"), F.min_by(F.struct("_c", "started_at", "session_id"), at).alias("_from"))
    traces = cut(traces.select(by, "call_id", "_end", "_from.*"), "traces")

    # Traces that end later than all before them, and the helpers, by the times they end and ask for.
    later = traces.join(carried(traces, [by], before=(F.max("_end"), F.max)), [by, "_c"]).withColumn("_top", F.greatest(F.max("_end").over(earlier), F.col("before")))
    later = later.filter(F.col("_top").isNull() | (F.col("_end") > F.col("_top"))).select(by, "call_id", F.col("_end").alias("_key"), F.lit(True).alias("_is"), F.struct(trace_name(F.col("call_id")).alias("trace"), F.col("started_at").alias("start")).alias("_open"), F.lit(None).cast("long").alias("_row"))
    asks = x.filter(~main).select(by, "call_id", F.col("started_at").alias("_key"), F.lit(False).alias("_is"), F.lit(None).cast(later.schema["_open"].dataType).alias("_open"), "_row")
    order = [F.col("_key").desc_nulls_last(), F.col("_is").desc(), F.col("call_id")]
    both = cut(later.unionByName(asks).repartitionByRange(n, F.col(by), *order).withColumn("_c", F.spark_partition_id()), "asked")
    both = both.join(carried(both, [by], before=F.min_by("_open", F.when(F.col("_is"), F.col("_key")))), [by, "_c"])
    met = F.coalesce(F.last("_open", True).over(Window.partitionBy(by, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("before"))
    helped = both.withColumn("_met", met).filter("NOT _is").select("_row", F.when(F.col("_met.start") <= F.col("_key"), F.col("_met.trace")).alias("_joined"))

    x = x.join(helped, "_row", "left")
    x = x.withColumn("trace_id", F.when(main, trace_name(F.col("_of"))).otherwise(F.coalesce("_joined", trace_name(F.col("call_id")))))
    x = cut(x.drop("_begins", "_of", "_joined"), "own")
    ended = main & F.col("ended_at").isNotNull()
    left = carried(x, [by, "trace_id"], host=F.max_by(F.struct("ended_at", "span_id"), F.when(ended, at)), longest=(F.max(F.when(ended, F.col("ended_at"))), F.max))
    return hosted(x, [by, "_c"], left).drop("_c")


LEVELS = 62
WIDE = 26  # blocks of 2^26 microseconds (67 s) and more are asked for by many helpers: their rows are salted
SALTS = 32


def running_hosts(asked: DataFrame, hosts: DataFrame, by: str) -> DataFrame:
    """(_row, parent): for each helper the main call of its trace that began last among those that were running when it started.

    A main call's time is cut into the blocks of a binary division of time that just fill it, about two a level. Whoever
    asks for a time within a block is within the call's time, so a block needs only the call that began last of all
    that fill it, and a helper looks up one block a level: equal keys, one answer a key, whatever overlaps.
    """
    lo, hi = F.unix_micros("started_at"), F.unix_micros("ended_at") + 1
    one = F.lit(1).cast("long")

    def blocks(level):
        first = F.call_function("shiftright", lo + F.call_function("shiftleft", one, level) - 1, level)
        end = F.call_function("shiftright", hi, level)
        odd = lambda c: c.bitwiseAND(F.lit(1)) == 1
        inside = first < end
        return F.array(F.when(inside & odd(first), F.struct(level.alias("level"), first.alias("block"))), F.when(inside & odd(end), F.struct(level.alias("level"), (end - 1).alias("block"))))

    cover = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 2)), blocks)), lambda b: b.isNotNull())
    # Only traces in which a helper asks; a trace may be very long, so that join is salted as well.
    traces = asked.select(by, "trace_id").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hosts = hosts.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(traces, [by, "trace_id", "salt"], "left_semi")
    filled = hosts.select(by, "trace_id", "started_at", "call_id", "span_id", F.explode(cover).alias("b"))
    best = filled.groupBy(by, "trace_id", "b.level", "b.block").agg(F.max(F.struct("started_at", "call_id", "span_id")).alias("_best"))
    best = cut(best, "blocks")
    levels = sorted(best.agg(F.collect_set("level")).first()[0])  # at most LEVELS numbers
    if not levels:
        return asked.select("_row", F.lit(None).cast("string").alias("parent")).limit(0)
    salts = lambda level: F.when(level >= WIDE, SALTS).otherwise(1)
    table = best.select("*", F.explode(F.sequence(F.lit(0), salts(F.col("level")) - 1)).alias("salt"))
    asks = asked.select("_row", by, "trace_id", F.unix_micros("started_at").alias("_t"), F.explode(F.array(*map(F.lit, levels))).alias("level"))
    asks = asks.select("_row", by, "trace_id", "level", F.call_function("shiftright", F.col("_t"), F.col("level")).alias("block"), F.pmod(F.xxhash64("_row"), salts(F.col("level"))).cast("int").alias("salt"))
    return asks.join(table, [by, "trace_id", "level", "block", "salt"]).groupBy("_row").agg(F.max("_best")["span_id"].alias("parent"))


READ = ("session_id", "call_id", "started_at", "ended_at", "model", "billing_variant", "system_hash", "tools_hash", "tools_declared_count", "max_tokens", "system_segments", "stop_sequences", "stop_reason", "first_turn_hash", "new_user_turn")


def assemble(g: DataFrame, hot_calls: int = 1_000_000, chunk_calls: int = 250_000) -> DataFrame:
    """Adds agent, trace_id, span_id, parent_span_id and depth; calls without a session have none.

    A helper's parent is the latest main call of its trace that was running when it started. Sessions are shuffled and
    sorted with the columns that this needs, and the result is joined back to whole rows. Sessions of more than `hot_calls` calls are scanned in
    chunks (`traced_in_chunks`), to the same rows. Writes tables in spark.checkpoint.dir when it is called.
    """
    added = ("agent_id", "agent_role", "agent_name", "span_id", "trace_id", "parent_span_id", "depth")
    # Written with a number of its own for each row, as ids may repeat. Calls without a session are sessions of one call meanwhile.
    calls = cut(g.drop(*added).withColumn("_row", F.monotonically_increasing_id()), "calls")
    x = calls.select("_row", *READ).withColumn("_s", F.coalesce("session_id", F.concat(F.lit("\u0000"), F.col("call_id")))).withColumn("span_id", span_name())
    sizes = x.groupBy("_s").count().filter(F.col("count") > hot_calls)
    hot = cut(sizes, "hot")
    n = hot.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    if n:
        keys = F.broadcast(hot.select("_s"))  # fewer rows than calls / hot_calls
        done = traced(classify_agents(x.join(keys, "_s", "left_anti"), "_s"), "_s").unionByName(traced_in_chunks(x.join(keys, "_s", "left_semi"), "_s", n, chunk_calls))
    else:
        done = traced(classify_agents(x, "_s"), "_s")
    done = cut(done.select("_row", "_s", "call_id", "started_at", "ended_at", "_unsure", "_overlaps", *added[:-1]), "traced")
    asked = done.filter("_unsure")
    if not asked.isEmpty():
        done = done.join(running_hosts(asked, done.filter("_overlaps"), "_s"), "_row", "left").withColumn("parent_span_id", F.coalesce("parent_span_id", "parent"))
    some = F.substring("_s", 1, 1) != "\u0000"
    done = done.withColumn("depth", F.when(F.col("parent_span_id").isNotNull(), 1).otherwise(0))
    some = F.col("session_id").isNotNull()
    return calls.join(done.select("_row", *added), "_row").withColumns({c: F.when(some, F.col(c)) for c in added}).drop("_row")


def tool_traces(tools: DataFrame, g: DataFrame) -> DataFrame:
    """Tool rows with the trace of their call."""
    return tools.drop("trace_id").join(g.select("call_id", "trace_id"), "call_id", "left")


def rollup_sessions(g: DataFrame, keys: DataFrame | None = None, version: str = "1") -> DataFrame:
    """One row for each session (of `keys`, if given). Sums skip unknown values; coverage says how many are known."""
    x = g.filter(F.col("session_id").isNotNull())
    if keys is not None:
        x = x.join(keys.select("session_id").distinct(), "session_id", "left_semi")
    at = F.struct("started_at", "call_id")
    said = F.col("user_prompt").isNotNull()
    gap = F.sum(F.coalesce("cost_uncached_equiv_usd", F.lit(0.0))) - F.sum(F.coalesce("cost_total_usd", F.lit(0.0)))
    return x.groupBy("session_id").agg(
        F.coalesce(F.min_by("user_prompt", F.when(said & (F.col("tools_declared_count") > 0), at)), F.min_by("user_prompt", F.when(said, at))).alias("title"),
        *[F.max(c).alias(c) for c in ("project_name", "git_branch", "cwd", "account_uuid", "org_id", "framework", "client_version")],
        F.mode("model", True).alias("primary_model"), F.array_sort(F.collect_set("model")).alias("models"),
        F.min("started_at").alias("started_at"), F.max(F.coalesce("ended_at", "started_at")).alias("ended_at"), F.lit(None).cast("long").alias("duration_ms"),
        F.count("*").alias("generation_count"), F.sum("tool_call_count").alias("tool_call_count"), F.sum(F.col("is_error").cast("long")).alias("error_count"),
        *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "thinking_tokens", "cost_total_usd")],
        F.greatest(gap, F.lit(0.0)).alias("cache_savings_usd"), F.max("input_tokens").alias("peak_context_tokens"),
        (F.count("input_tokens") / F.count("*")).alias("usage_coverage"), F.lit(version).alias("parser_version"),
    )
