"""Parameterised queries over the derived tables: filters, pages, details and group-bys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filter name -> (column, comparison).
GENERATION_FILTERS = {
    **{c: (c, "=") for c in ("session_id", "trace_id", "agent_role", "agent_name", "model", "provider", "framework", "stop_reason", "error_kind")},
    "from": ("started_at", ">="), "to": ("started_at", "<="), "min_cost": ("cost_total_usd", ">="), "min_latency_ms": ("latency_ms", ">="), "min_input_tokens": ("input_tokens", ">="),
}
ALERT_FILTERS = {c: (c, "=") for c in ("severity", "category", "rule_id", "confidence", "session_id", "trace_id", "call_id", "scope_kind")}
CONTROLS = ("cursor", "limit", "offset", "group_by", "sort", "order")
DEFAULT_LIMIT, MOST = 50, 200


def apply_filters(df: DataFrame, params: Mapping, allowed: Mapping = GENERATION_FILTERS) -> DataFrame:
    """The rows that meet every filter; an unknown filter is an error, control parameters are left alone."""
    for name, value in params.items():
        if name in CONTROLS:
            continue
        if name not in allowed:
            raise ValueError(f"unknown filter {name!r}; accepted: {', '.join(allowed)}")
        column, how = allowed[name]
        value = F.lit(value).cast(df.schema[column].dataType)
        df = df.filter({"=": F.col(column) == value, ">=": F.col(column) >= value, "<=": F.col(column) <= value}[how])
    return df


def page_limit(limit=None) -> int:
    try:
        return max(1, min(MOST, int(limit)))
    except (TypeError, ValueError):
        return DEFAULT_LIMIT


def page(df: DataFrame, at: str, tie: str | None = None, cursor=None, limit=None) -> DataFrame:
    """Newest first, before the cursor: a keyset page (a top-k, never an offset)."""
    if cursor:
        df = df.filter(F.col(at) < F.lit(cursor).cast("timestamp"))
    return df.orderBy(F.desc(at), *([F.desc(tie)] if tie else [])).limit(page_limit(limit))


def generations_page(g, params: Mapping = {}):
    return page(apply_filters(g, params), "started_at", "call_id", params.get("cursor"), params.get("limit"))


def generation_detail(g, tools, alerts, key):
    """(generation, its tool rows, its alerts) by span id or call id."""
    one = g.filter((F.col("span_id") == str(key)) | (F.col("call_id").cast("string") == str(key)))
    ids = one.select("call_id")
    return one, tools.join(ids, "call_id", "left_semi").orderBy("seq"), alerts.join(ids, "call_id", "left_semi")


def generation_raw(calls, g, key):
    """The capture behind a generation."""
    one = g.filter((F.col("span_id") == str(key)) | (F.col("call_id").cast("string") == str(key))).select(F.col("call_id").alias("id"))
    return calls.join(one, "id")


def coverage(name: str) -> Column:
    """Share of rows in which a value is known; null without rows."""
    return F.count(name) / F.nullif(F.count("*"), F.lit(0))


def known_savings() -> Column:
    return F.greatest(F.lit(0.0), F.sum(F.coalesce("cost_uncached_equiv_usd", F.lit(0.0))) - F.sum(F.coalesce("cost_total_usd", F.lit(0.0))))


def context_composition(g):
    """System, tool and history characters of each call: disjoint, with their sum and shares."""
    parts = [F.coalesce(c, F.lit(0)) for c in ("system_chars", "tools_chars", "context_chars")]
    total = parts[0] + parts[1] + parts[2]
    x = g.select("call_id", *[p.alias(n) for p, n in zip(parts, ("system_chars", "tools_chars", "history_chars"))], total.alias("total_chars"))
    return x.withColumns({f"{n}_share": F.col(f"{n}_chars") / F.nullif(F.col("total_chars"), F.lit(0)) for n in ("system", "tools", "history")})


def context_tokens(strict: bool = False) -> Column:
    """Input, cache read and cache creation; strict: null if the input is unknown, else 0 for unknown parts."""
    total = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("cache_read_tokens", F.lit(0)) + F.coalesce("cache_creation_tokens", F.lit(0))
    return F.when(F.col("input_tokens").isNotNull(), total) if strict else total


def meta(calls, g, tools, sessions, alerts, failures):
    """Counts of the tables, traces, and how much usage and cost is known: one row."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    own = g.agg(F.count("*").alias("generations"), F.count_distinct("trace_id").alias("traces"), coverage("input_tokens").alias("usage_coverage"), coverage("cost_total_usd").alias("cost_coverage"))
    for df, name in ((calls, "calls"), (tools, "tool_calls"), (sessions, "sessions"), (alerts, "alerts"), (failures, "derive_failures")):
        own = own.crossJoin(n(df, name))  # one row each
    return own


_SUMS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")


def overview_totals(g):
    return g.agg(
        F.count("*").alias("generations"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("trace_id").alias("traces"), F.sum(F.col("is_error").cast("long")).alias("errors"),
        *[F.sum(c).alias(c) for c in (*_SUMS, "thinking_tokens", "cost_total_usd")], known_savings().alias("cache_savings_usd"), F.sum("tool_call_count").alias("tool_calls"), F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"))


def alerts_by_severity(alerts):
    return alerts.groupBy("severity").agg(F.count("*").alias("count"))


def by_model(g):
    return g.filter("model IS NOT NULL").groupBy("model").agg(F.count("*").alias("generations"), F.sum("cost_total_usd").alias("cost_total_usd"), F.sum("total_tokens").alias("total_tokens")).orderBy(F.desc(F.coalesce("cost_total_usd", F.lit(0.0))), "model")


def recent_sessions(sessions, n: int = 10):
    return sessions.orderBy(F.desc("started_at"), "session_id").limit(n).select("session_id", "title", "generation_count", "tool_call_count", "error_count", "cost_total_usd", "primary_model", "started_at", "ended_at")


def models_usage(g):
    """Models observed, with sums, the largest context, when seen, and how much is priced."""
    return g.filter("model IS NOT NULL").groupBy("provider", "model").agg(
        F.max(F.coalesce("pricing_model_id", "model")).alias("priced_as"), F.count("*").alias("generations"), *[F.sum(c).alias(c) for c in (*_SUMS, "cost_total_usd")],
        F.max(context_tokens()).alias("peak_context_tokens"), F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"), coverage("cost_total_usd").alias("priced_share"))


def models_enriched(usage, models):
    """Observed models with what the catalogue says of them; what it does not know stays null."""
    from tallyspark.operators.pricing import resolve_models

    info = models.select(F.col("provider").alias("cat_provider"), F.col("model_id").alias("cat_model"), *[c for c in ("name", "family", "context_limit", "input_limit", "output_limit", "input", "output", "tiered") if c in models.columns])
    x = resolve_models(usage, models).join(info, ["cat_provider", "cat_model"], "left")
    return x.withColumn("in_catalog", F.col("cat_model").isNotNull())


def headroom(enriched):
    """Largest context as a share of the limit, and whether anything of the model is unpriced."""
    return enriched.select("provider", "model", "peak_context_tokens", "context_limit", (F.col("peak_context_tokens") / F.nullif(F.col("context_limit"), F.lit(0))).alias("headroom"), (F.col("priced_share") < 1).alias("partly_unpriced"))


def harness_budget(g):
    sums = g.agg(
        F.sum("system_chars").alias("system_chars"), F.sum("tools_chars").alias("tools_chars"), F.sum("context_chars").alias("history_chars"), F.count("*").alias("generations"),
        F.count("tools_chars").alias("with_tools"), F.max("tools_chars").alias("max_tools_chars"), F.max("context_chars").alias("max_history_chars"))
    total = F.coalesce("system_chars", F.lit(0)) + F.coalesce("tools_chars", F.lit(0)) + F.coalesce("history_chars", F.lit(0))
    return sums.withColumns({f"{n}_share": F.coalesce(f"{n}_chars", F.lit(0)) / F.nullif(total, F.lit(0)) for n in ("system", "tools", "history")})


def _used(g, key):
    return g.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("generations"), F.count_distinct("session_id").alias("sessions"), F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"),
        F.array_join(F.array_sort(F.collect_set("agent_role")), ",").alias("agent_roles"), F.max_by("span_id", F.struct("started_at", "call_id")).alias("latest_span"))


def harness_prompts(prompts, g):
    """System prompts with their use; one without calls stays, with zeros."""
    from tallyspark.operators.derive import BILLING_PREFIX

    first = F.get("segments", F.lit(0))["text"]
    opening = F.left(F.when(first.startswith(BILLING_PREFIX), F.get("segments", F.lit(1))["text"]).otherwise(first), F.lit(120))
    x = prompts.join(_used(g, "system_hash"), "system_hash", "left")
    return x.select("system_hash", "total_chars", "segment_count", "cache_points", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("generations", "sessions")], "first_seen", "last_seen", "agent_roles", "latest_span", opening.alias("opening"))


def harness_tool_sets(sets, g):
    x = sets.join(_used(g, "tools_hash").drop("latest_span"), "tools_hash", "left")
    return x.select("tools_hash", "tool_count", "total_chars", "mcp_count", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("generations", "sessions")], "first_seen", "last_seen", "agent_roles")


def declared_tools(schemas, tools):
    """Declared tools against their calls: least used and heaviest first."""
    calls = tools.groupBy("name").agg(F.count("*").alias("calls"), F.max("emitted_at").alias("last_used"))
    x = schemas.groupBy("name").agg(F.max("server").alias("server"), F.max(F.col("is_mcp")).alias("is_mcp"), F.max("chars").alias("chars"), F.count_distinct("tools_hash").alias("tool_sets"))
    return x.join(calls, "name", "left").withColumn("calls", F.coalesce("calls", F.lit(0)).cast("long")).orderBy("calls", F.desc("chars"), "name")


def prompt_detail(prompts, g, key):
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}s")
    used = g.filter(F.col("system_hash") == key).agg(F.count("*").alias("generations"), F.count_distinct("session_id").alias("sessions"), F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"), joined("agent_role"), joined("model"), joined("billing_variant"))
    return prompts.filter(F.col("system_hash") == key).crossJoin(used)  # one row each


def tool_set_detail(schemas, tools, g, key=None):
    """Members of tool sets by weight, with the calls made under that very set."""
    used = tools.join(g.select("call_id", "tools_hash"), "call_id").groupBy("tools_hash", "name").agg(F.count("*").alias("calls"))
    x = schemas if key is None else schemas.filter(F.col("tools_hash") == key)
    return x.join(used, ["tools_hash", "name"], "left").withColumn("calls", F.coalesce("calls", F.lit(0)).cast("long")).orderBy("tools_hash", F.desc("chars"), "name")


def context_parts(prompts, schemas, g, key, head: int = 240):
    """(prompt row, tools by weight with their heads) of one generation."""
    one = g.filter((F.col("span_id") == str(key)) | (F.col("call_id").cast("string") == str(key))).select("system_hash", "tools_hash")
    tools = schemas.join(one.select("tools_hash"), "tools_hash").select("name", "server", "chars", F.left("description", F.lit(head)).alias("description_head"), F.left("input_schema", F.lit(head)).alias("schema_head")).orderBy(F.desc("chars"), "name")
    return prompts.join(one.select("system_hash"), "system_hash"), tools


def traces(g, params: Mapping = {}):
    """One row for each trace of the filtered calls."""
    at = F.struct("started_at", "call_id")
    return apply_filters(g, params).filter("trace_id IS NOT NULL").groupBy("trace_id").agg(
        F.any_value("session_id", True).alias("session_id"), F.min("started_at").alias("started_at"), F.max(F.coalesce("ended_at", "started_at")).alias("ended_at"), F.count("*").alias("generation_count"),
        F.sum("tool_call_count").alias("tool_call_count"), F.count_distinct("agent_id").alias("agent_count"), F.sum(F.col("is_error").cast("long")).alias("error_count"), F.sum("total_tokens").alias("total_tokens"),
        F.sum("cost_total_usd").alias("cost_total_usd"), F.max("depth").alias("max_depth"), F.min_by("user_prompt", F.when(F.col("user_prompt").isNotNull(), at)).alias("user_prompt"))


def traces_page(g, params: Mapping = {}):
    return page(traces(g, params), "started_at", "trace_id", params.get("cursor"), params.get("limit"))


def trace_spans(g, trace_id=None):
    """Spans with their place and width in their trace's window, as shares of it."""
    x = g.filter("trace_id IS NOT NULL") if trace_id is None else g.filter(F.col("trace_id") == trace_id)
    w = Window.partitionBy("trace_id")
    ends = F.coalesce("ended_at", "started_at")
    first, last = F.min("started_at").over(w), F.max(ends).over(w)
    width = F.nullif(F.unix_micros(last) - F.unix_micros(first), F.lit(0))
    return x.select(
        "trace_id", "call_id", "span_id", "parent_span_id", "depth", "agent_name", "agent_role", "model", "started_at", "ended_at", "latency_ms", "total_tokens", "cost_total_usd", "is_error",
        first.alias("trace_start"), last.alias("trace_end"), ((F.unix_micros("started_at") - F.unix_micros(first)) / width).alias("offset_share"), ((F.unix_micros(ends) - F.unix_micros("started_at")) / width).alias("width_share"))


def trace_detail(g, tools, alerts, trace_id):
    return trace_spans(g, trace_id).orderBy("started_at", "call_id"), tools.filter(F.col("trace_id") == trace_id).orderBy("call_id", "seq"), alerts.filter(F.col("trace_id") == trace_id)


def sessions_page(sessions, params: Mapping = {}):
    return page(sessions, "started_at", "session_id", params.get("cursor"), params.get("limit"))


def session_agents(g, session_id=None):
    x = g.filter("agent_id IS NOT NULL") if session_id is None else g.filter((F.col("session_id") == session_id) & F.col("agent_id").isNotNull())
    return x.groupBy("session_id", "agent_id").agg(
        *[F.min_by(c, F.struct("started_at", "call_id")).alias(c) for c in ("agent_name", "agent_role", "billing_variant", "model")], F.count("*").alias("generation_count"), F.sum("cost_total_usd").alias("cost_total_usd"), F.sum("total_tokens").alias("total_tokens"))


def session_timeline(g, session_id=None):
    """Calls in order with their context, and that as a share of the session's largest."""
    x = g.filter("session_id IS NOT NULL") if session_id is None else g.filter(F.col("session_id") == session_id)
    peak = F.max("context_tokens").over(Window.partitionBy("session_id"))
    x = x.withColumn("context_tokens", context_tokens())
    return x.select("session_id", "call_id", "span_id", "trace_id", "agent_name", "agent_role", "model", "started_at", "ttft_ms", "latency_ms", "context_tokens", "cost_total_usd", "is_error", "stop_reason", (F.col("context_tokens") / F.nullif(peak, F.lit(0))).alias("height"))


def session_alerts_view(alerts, session_id):
    return alerts.filter(F.col("session_id") == session_id).orderBy(F.desc("occurred_at"))


def severity_rank(c="severity") -> Column:
    return F.when(F.col(c) == "critical", 0).when(F.col(c) == "error", 1).when(F.col(c) == "warning", 2).otherwise(3)


def alerts_page(alerts, params: Mapping = {}):
    x = apply_filters(alerts, params, ALERT_FILTERS)
    if params.get("cursor"):
        x = x.filter(F.col("occurred_at") < F.lit(params["cursor"]).cast("timestamp"))
    return x.orderBy(severity_rank(), F.desc("occurred_at"), "dedup_key").limit(page_limit(params.get("limit")))


def alert_facets(alerts):
    return alerts.groupBy("severity", "category", "rule_id").agg(F.count("*").alias("count"))


def errors_by_rule(alerts):
    """Findings that matter by rule; a rule with several severities has its worst."""
    x = alerts.filter(F.col("severity").isin("critical", "error", "warning")).groupBy("rule_id").agg(
        F.any_value("category").alias("category"), F.min_by("severity", severity_rank()).alias("severity"), F.any_value("title").alias("title"), F.count("*").alias("occurrences"),
        F.count_distinct("session_id").alias("sessions"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"), F.min("summary").alias("sample_summary"))
    return x.orderBy(severity_rank(), F.desc("occurrences"))


def tools_stats(tools):
    errors = F.sum(F.coalesce(F.col("is_error").cast("long"), F.lit(0)))
    return tools.groupBy("name", "server").agg(
        F.max(F.col("is_mcp").cast("int")).alias("is_mcp"), F.count("*").alias("calls"), errors.alias("errors"), (errors / F.count("*")).alias("error_rate"), F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(~F.col("was_declared")).alias("undeclared"), F.avg("result_chars").cast("long").alias("avg_result_chars"), F.max("result_chars").alias("max_result_chars"), F.count_distinct("session_id").alias("sessions"), F.max("emitted_at").alias("last_used"))


def tool_calls_of(tools, g, name, limit=None):
    x = tools.filter(F.col("name") == name).join(g.select("call_id", "span_id", "agent_name", "model"), "call_id", "left")
    return x.orderBy(F.desc("emitted_at"), "call_id", "seq").limit(page_limit(limit))


AXES = {"model": "model", "session": "session_id", "agent": "agent_name", "provider": "provider", "day": "started_at"}


def cost_by(g, axis: str = "model"):
    """Tokens and cost by an axis, with the savings and how much of the bucket is priced."""
    if axis not in AXES:
        raise ValueError(f"unknown group_by {axis!r}; accepted: {', '.join(AXES)}")
    bucket = F.to_date(AXES[axis]).cast("string") if axis == "day" else F.col(AXES[axis])
    costs = ("cost_input_usd", "cost_output_usd", "cost_cache_write_usd", "cost_cache_read_usd", "cost_total_usd")
    x = g.withColumn("bucket", bucket).filter("bucket IS NOT NULL").groupBy("bucket")
    return x.agg(F.count("*").alias("generations"), *[F.sum(c).alias(c) for c in (*_SUMS, *costs)], known_savings().alias("cache_savings_usd"), coverage("cost_total_usd").alias("priced_share"))


def cost_share(buckets):
    """Totals over buckets, and the share of cache reads and writes in them."""
    x = buckets.agg(*[F.sum(c).alias(c) for c in ("cost_total_usd", "cost_cache_write_usd", "cost_cache_read_usd", "cache_savings_usd")])
    return x.withColumn("cache_share", (F.col("cost_cache_write_usd") + F.col("cost_cache_read_usd")) / F.nullif(F.col("cost_total_usd"), F.lit(0.0)))
