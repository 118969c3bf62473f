"""Detection rules over generations, tool calls, sessions and failures; each finding explains itself."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Thresholds of the rules. The defaults."""

    version: str = "1"
    slow_ttft_ms: int = 3_000
    slow_latency_ms: int = 60_000
    low_cache_reuse_rate: float = 0.20
    cache_analysis_min_input_tokens: int = 1_000
    large_block_chars: int = 10_000
    large_tool_result_chars: int = 20_000
    context_growth_ratio: float = 1.40
    context_growth_min_tokens: int = 20_000
    compaction_drop_ratio: float = 0.30
    context_trend_min_tokens: int = 1_000
    expensive_call_usd: float = 0.50
    session_budget_usd: float = 5.00
    sidechain_cost_share: float = 0.30
    high_utilization: float = 0.80
    critical_utilization: float = 0.95
    thinking_budget_exhausted_ratio: float = 0.95


def policy_df(spark: SparkSession, policy: Policy = Policy()) -> DataFrame:
    """(name, value) rows of a policy."""
    return spark.createDataFrame([(k, str(v)) for k, v in asdict(policy).items()], "name string, value string")


@dataclass(frozen=True)
class Rule:
    """`when`, `metric`, `summary` and `severity` are SQL over the rule's source; {names} come from the policy."""

    id: str
    source: str
    severity: str
    when: str
    summary: str
    title: str
    advice: str
    observed: tuple[str, ...] = ()
    metric: str = "NULL"
    threshold: str = "NULL"
    unit: str = ""
    confidence: str = "exact"

    @property
    def category(self) -> str:
        return self.id.split(".")[0]


_REUSE = "coalesce(cache_read_tokens, 0) / nullif(coalesce(input_tokens, 0) + coalesce(cache_read_tokens, 0) + coalesce(cache_creation_tokens, 0), 0)"
_UTIL = "greatest(coalesce(ratelimit_5h_utilization, 0), coalesce(ratelimit_7d_utilization, 0))"

RULES = [
    Rule("execution.http_error", "call", "'error'", "http_status >= 400 AND http_status <> 429", "concat('The provider answered with HTTP ', http_status, '.')", "Call failed", "Read the response body for the kind of error.", ("http_status",), "http_status"),
    Rule("execution.rate_limited", "call", "if(agent_role = 'probe', 'info', 'error')", "http_status = 429", "if(agent_role = 'probe', 'A quota probe met HTTP 429.', 'The call was rejected with HTTP 429.')", "Rate limited", "Wait before trying again.", ("http_status", "agent_role"), "http_status"),
    Rule("execution.transport_error", "call", "'error'", "error_kind = 'transport'", "'The connection failed before an answer came.'", "No answer", "Check the network between client and provider.", ("error_kind",)),
    Rule("execution.stream_incomplete", "call", "'error'", "error_kind = 'stream_incomplete'", "'The stream ended before its last event.'", "Stream cut off", "Treat the output as partial.", ("error_kind",)),
    Rule("execution.truncated_output", "call", "'warning'", "stop_reason = 'max_tokens'", "'The output stopped at the token limit.'", "Output cut at the limit", "Raise max_tokens or split the task.", ("stop_reason", "output_tokens"), "output_tokens", "max_tokens", "tokens"),
    Rule("execution.refusal", "call", "'warning'", "stop_reason = 'refusal'", "'The model refused.'", "Refused", "Look at the prompt of this call.", ("stop_reason",)),
    Rule("tooling.tool_error", "tool", "'warning'", "is_error", "concat('Tool `', coalesce(name, '<unnamed>'), '` returned an error.')", "Tool error", "Look at the tool's result.", ("name", "status")),
    Rule("tooling.undeclared_tool", "tool", "'warning'", "NOT was_declared", "concat('Tool `', coalesce(name, '<unnamed>'), '` was not declared.')", "Undeclared tool", "Compare the declared tools with those used.", ("name",)),
    Rule("tooling.oversized_result", "tool", "'warning'", "result_chars >= {large_tool_result_chars}", "concat('Tool `', coalesce(name, '<unnamed>'), '` returned ', result_chars, ' characters.')", "Very large tool result", "Trim or page the result.", ("name", "result_chars"), "result_chars", "{large_tool_result_chars}", "chars"),
    Rule("performance.slow_ttft", "call", "'warning'", "ttft_ms > {slow_ttft_ms}", "concat('The first token took ', ttft_ms, ' ms.')", "Slow first token", "See whether the context or the provider is slow.", ("ttft_ms",), "ttft_ms", "{slow_ttft_ms}", "ms"),
    Rule("performance.slow_latency", "call", "'info'", "latency_ms > {slow_latency_ms}", "concat('The call took ', latency_ms, ' ms.')", "Long call", "Expected for long outputs; else check load.", ("latency_ms", "output_tokens"), "latency_ms", "{slow_latency_ms}", "ms"),
    Rule("cache.low_reuse", "call", "'warning'", f"input_tokens IS NOT NULL AND input_tokens + coalesce(cache_read_tokens, 0) >= {{cache_analysis_min_input_tokens}} AND {_REUSE} < {{low_cache_reuse_rate}}", f"concat(cast(round(100.0 * {_REUSE}) AS int), '% of the context came from the cache.')", "Little cache reuse", "Keep the start of the context stable.", ("cache_read_tokens", "input_tokens"), _REUSE, "{low_cache_reuse_rate}", "ratio", "derived"),
    Rule("context.thinking_budget_exhausted", "call", "'warning'", "thinking_budget > 0 AND thinking_tokens / thinking_budget >= {thinking_budget_exhausted_ratio}", "concat('Thinking used ', thinking_tokens, ' of ', thinking_budget, ' tokens.')", "Thinking budget used up", "Raise the budget if answers suffer.", ("thinking_tokens", "thinking_budget"), "thinking_tokens", "thinking_budget", "tokens"),
    Rule("rate_limit.utilization_high", "call", f"if({_UTIL} >= {{critical_utilization}}, 'error', 'warning')", f"{_UTIL} >= {{high_utilization}}", f"concat('Rate-limit use reached ', cast(round(100.0 * {_UTIL}) AS int), '%.')", "Rate limit nearly used up", "Slow down until the window resets.", ("ratelimit_5h_utilization", "ratelimit_7d_utilization"), _UTIL, "{high_utilization}", "ratio"),
    Rule("rate_limit.overage_rejected", "call", "'warning'", "overage_status = 'rejected' AND coalesce(ratelimit_5h_utilization, 0) >= {high_utilization}", "'Overage is rejected while use is high.'", "No overage left", "Expect rejected calls soon.", ("overage_status", "ratelimit_5h_utilization"), "ratelimit_5h_utilization", "{high_utilization}", "ratio"),
    Rule("cost.expensive_generation", "call", "'info'", "cost_total_usd > {expensive_call_usd}", "concat('The call cost $', round(cost_total_usd, 4), '.')", "Expensive call", "See which part of the context is new.", ("cost_total_usd",), "cost_total_usd", "{expensive_call_usd}", "usd", "derived"),
    Rule("data_quality.response_body_missing", "call", "'warning'", "error_kind = 'body_missing' AND model IS NOT NULL", "'No body was stored: usage and cost are unknown.'", "No response body", "Check what captured this call.", ("http_status", "model")),
    Rule("data_quality.pricing_unknown", "call", "'info'", "model IS NOT NULL AND cost_total_usd IS NULL AND input_tokens IS NOT NULL", "concat('No rates are known for `', model, '`.')", "Unpriced model", "Add rates, then reprice.", ("model",)),
    # Over calls with their predecessor of the same session and agent.
    Rule("context.compaction_observed", "trend", "'info'", "prev >= {context_trend_min_tokens} AND ctx / prev <= 1.0D - {compaction_drop_ratio}", "concat('The context fell from ', prev, ' to ', ctx, ' tokens.')", "Context compacted", "Facts may have been lost.", ("prev", "ctx"), "ctx / prev", "{compaction_drop_ratio}", "ratio", "inferred"),
    Rule("context.excessive_growth", "trend", "'warning'", "prev >= {context_trend_min_tokens} AND ctx / prev > {context_growth_ratio} AND ctx - prev >= {context_growth_min_tokens}", "concat('The context grew from ', prev, ' to ', ctx, ' tokens.')", "Context grew fast", "Find the large block that came in.", ("prev", "ctx"), "ctx / prev", "{context_growth_ratio}", "ratio", "derived"),
    # Over one row for each session.
    Rule("cache.ttl_overpaid", "session", "'info'", "hour_tokens > 0 AND minutes < 60", "concat('One-hour cache writes in a session of ', cast(minutes AS int), ' minutes.')", "Cache kept longer than needed", "The short lifetime would do.", ("minutes", "hour_tokens"), "minutes", "60", "minutes", "derived"),
    Rule("cost.session_budget", "session", "'warning'", "known_cost > {session_budget_usd}", "concat('The session cost $', round(known_cost, 4), '.')", "Session over budget", "See its costliest calls.", ("known_cost",), "known_cost", "{session_budget_usd}", "usd", "derived"),
    Rule("cost.sidechain_overhead", "session", "'warning'", "total > 0 AND side / total >= {sidechain_cost_share}", "concat(cast(round(100.0 * side / total) AS int), '% of the cost went to helpers.')", "Helpers cost much", "See which helper it is.", ("side", "total"), "side / total", "{sidechain_cost_share}", "ratio", "derived"),
    Rule("data_quality.parser_failed", "failure", "'critical'", "true", "concat('Deriving the capture failed at ', stage, '.')", "Capture not derived", "The raw capture is kept: fix and rebuild.", ("stage", "error")),
]

FINDING = ("rule_id", "severity", "scope_kind", "scope_id", "call_id", "span_id", "trace_id", "session_id", "summary", "observed", "metric_value", "threshold", "metric_unit", "occurred_at")
_SCOPE = {
    "call": ("call", "span_id", "call_id", "span_id", "trace_id", "session_id", "started_at"),
    "trend": ("call", "span_id", "call_id", "span_id", "trace_id", "session_id", "started_at"),
    "tool": ("tool", "tool_id", "call_id", "CAST(NULL AS STRING)", "trace_id", "session_id", "emitted_at"),
    "session": ("session", "session_id", "CAST(NULL AS BIGINT)", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)", "session_id", "started_at"),
    "failure": ("call", "CAST(call_id AS STRING)", "call_id", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)", "at"),
}


def _fold(df: DataFrame, source: str, policy: Policy, only: tuple[str, ...] = ()) -> DataFrame:
    """All rules of the sources, or `only` some, in one pass: first which rules a row meets, then the findings of those alone."""
    rules = [r for r in RULES if r.source in source.split() and (not only or r.id in only)]
    say = lambda x: F.expr(x.format(**{k: (f"{v}D" if isinstance(v, float) else v) for k, v in asdict(policy).items()}))
    met = F.filter(F.array(*[F.when(F.coalesce(say(r.when), F.lit(False)), F.lit(k)) for k, r in enumerate(rules)]), lambda k: k.isNotNull())
    hits = df.withColumn("_rule", F.explode(met))

    def pick(kind: str, of, make=F.expr) -> Column:
        """What `of` gives for the row's rule, made a column; rules that share it share a branch."""
        out, same = F.lit(None).cast(kind), {}
        for k, r in enumerate(rules):
            same.setdefault(of(r), []).append(k)
        for v, ks in same.items():
            out = F.when(F.col("_rule").isin(*ks), make(v).cast(kind)).otherwise(out)
        return out

    seen = lambda names: F.to_json(F.struct(*[F.col(c) for c in names]) if names else F.struct(F.lit(1)), {"ignoreNullFields": "false"})
    scope = lambda k, kind: pick(kind, lambda r: _SCOPE[r.source][k])
    return hits.select(
        pick("string", lambda r: r.id, F.lit).alias("rule_id"), pick("string", lambda r: r.severity, say).alias("severity"), pick("string", lambda r: _SCOPE[r.source][0], F.lit).alias("scope_kind"), scope(1, "string").alias("scope_id"), scope(2, "long").alias("call_id"),
        scope(3, "string").alias("span_id"), scope(4, "string").alias("trace_id"), scope(5, "string").alias("session_id"), pick("string", lambda r: r.summary, say).alias("summary"), pick("string", lambda r: r.observed, seen).alias("observed"),
        pick("double", lambda r: r.metric, say).alias("metric_value"), pick("double", lambda r: r.threshold, say).alias("threshold"), F.nullif(pick("string", lambda r: r.unit, F.lit), F.lit("")).alias("metric_unit"), scope(6, "timestamp").alias("occurred_at"))


def context_trend(g: DataFrame) -> DataFrame:
    """The calls with ctx, and prev: ctx of the call with known usage before, of the same session and agent. Both null where usage or session is unknown."""
    known = F.col("session_id").isNotNull() & F.col("input_tokens").isNotNull()
    ctx = F.when(known, F.coalesce("input_tokens", F.lit(0)) + F.coalesce("cache_read_tokens", F.lit(0)) + F.coalesce("cache_creation_tokens", F.lit(0)))
    own = F.coalesce("session_id", F.concat(F.lit("\u0000"), F.col("call_id")))
    earlier = Window.partitionBy(own, "agent_id").orderBy("started_at", "call_id").rowsBetween(Window.unboundedPreceding, -1)
    x = g.withColumn("ctx", ctx)
    return x.withColumn("prev", F.when(known, F.last("ctx", True).over(earlier)))


def session_measures(g: DataFrame) -> DataFrame:
    """One row for each session: what its rules look at."""
    ends = F.max(F.coalesce("ended_at", "started_at"))
    return g.filter("session_id IS NOT NULL").groupBy("session_id").agg(
        F.min("started_at").alias("started_at"), ((F.unix_micros(ends) - F.unix_micros(F.min("started_at"))) / 6e7).alias("minutes"),
        F.sum(F.coalesce("cache_creation_1h_tokens", F.lit(0))).alias("hour_tokens"), F.sum("cost_total_usd").alias("known_cost"),
        F.sum(F.when(F.col("agent_role") != "main", F.coalesce("cost_total_usd", F.lit(0.0))).otherwise(0.0)).alias("side"), F.sum(F.coalesce("cost_total_usd", F.lit(0.0))).alias("total"))


def run_rules(g: DataFrame, tools: DataFrame | None = None, failures: DataFrame | None = None, policy: Policy = Policy(), rules: tuple[str, ...] = ()) -> DataFrame:
    """All findings, or those of `rules` alone, unmerged: only what these rules look at is made."""
    wanted = {r.source for r in RULES if not rules or r.id in rules}
    sides = [("call trend", lambda: context_trend(g) if "trend" in wanted else g), ("session", lambda: session_measures(g)), ("tool", lambda: tools), ("failure", lambda: failures)]
    out = None
    for source, made in sides:
        df = made() if wanted & set(source.split()) else None
        if df is not None:
            found = _fold(df, source, policy, rules)
            out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("none of the rules looks at what was given")
    return out


def prose(spark: SparkSession) -> DataFrame:
    """(rule_id, category, confidence, title, recommendation): one row for each rule."""
    return spark.createDataFrame([(r.id, r.category, r.confidence, r.title, r.advice) for r in RULES], "rule_id string, category string, confidence string, title string, recommendation string")


def alerts(g: DataFrame, tools: DataFrame | None = None, failures: DataFrame | None = None, policy: Policy = Policy()) -> DataFrame:
    """One alert for each dedup_key (rule, scope kind and id; a call without span goes by its id), with occurrences; the first finding stands."""
    found = run_rules(g, tools, failures, policy)
    scope = F.coalesce("scope_id", F.concat(F.lit("call-"), F.col("call_id")))
    keyed = found.withColumn("dedup_key", F.concat_ws(":", "rule_id", "scope_kind", scope))
    one = keyed.groupBy("dedup_key").agg(F.min_by(F.struct(*FINDING), F.struct("occurred_at", "call_id", "metric_value")).alias("a"), F.count("*").alias("occurrences"))
    text = F.broadcast(prose(g.sparkSession))  # as many rows as there are rules
    return one.select("dedup_key", "occurrences", "a.*").join(text, "rule_id").withColumn("policy_version", F.lit(policy.version))
