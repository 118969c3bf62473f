"""Read-time diagnostics of normalised calls: session changes, metrics, alerts, dashboards and documents."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.scalars import excerpt
from tallyspark.operators import derive, normalise


@dataclass(frozen=True)
class CallPolicy:
    """Thresholds of these diagnostics (the latency limit differs from the detectors')."""

    slow_ttft_ms: int = 3_000
    slow_latency_ms: int = 10_000
    low_cache_reuse_rate: float = 0.2
    cache_min_input_tokens: int = 1_000
    large_block_chars: int = 10_000
    growth_ratio: float = 1.40
    growth_min_tokens: int = 20_000


#: Beginnings of injected user text, in lower case.
INJECTED = ("<system-reminder>", "<local-command-", "caveat:", "[request interrupted")


def call_frame(calls: DataFrame) -> DataFrame:
    """One row for each call with its session, model, times, usage, thread size, history and system fingerprints, made within the row."""
    x = derive.normalised_calls(calls)
    old = F.filter("turns", lambda t: t["origin"] == "history")
    said = F.flatten(F.transform(F.filter("turns", lambda t: t["role"] == "user"), lambda t: t["blocks"]))
    own = lambda b: (b["kind"] == "text") & (F.trim(b["content"]) != "") & ~F.exists(F.array(*map(F.lit, INJECTED)), lambda m: F.startswith(F.lower(F.ltrim(b["content"])), m)) & b["content_tag"].isNull()
    size = lambda bs: F.aggregate(bs, F.lit(0).cast("long"), lambda a, b: a + F.coalesce(b["chars"], F.lit(0).cast("long")))
    some, first = F.size("turns") > 0, F.get(F.filter(said, own), F.lit(0))["content"]
    return x.select(
        F.col("id").alias("call_id"), "session_key", "model", "url", "method", F.col("timestamp_start").alias("start"), F.col("timestamp_first_chunk").alias("first_chunk"), F.col("timestamp_end").alias("end"), F.col("response_status").alias("status"), "error", F.col("response_raw_sse").isNotNull().alias("is_stream"),
        "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", F.when(some, derive.prefix_hashes(F.transform(old, derive.turn_hash))).alias("history"), F.when(some, size(F.flatten(F.transform("turns", lambda t: t["blocks"])))).alias("thread_chars"),
        F.when(F.size("segs") > 0, F.sha2(F.array_join(F.transform("segs", lambda s: s["text"]), "\n"), 256)).alias("system_hash"), F.coalesce("session_key", F.concat(F.lit("unscoped-call-"), F.col("id"))).alias("session"), F.trim(F.regexp_replace(first, r"\s+", " ")).alias("prompt"))


def _before() -> Window:
    return Window.partitionBy("session").orderBy("start", "call_id")


def token_metrics(c: DataFrame) -> DataFrame:
    """Total only if input and output are known; reuse as a share of the whole context, if input and reads are known."""
    rate = F.col("cache_read_tokens") / F.nullif(F.col("input_tokens") + F.col("cache_read_tokens") + F.coalesce("cache_creation_tokens", F.lit(0)), F.lit(0))
    return c.withColumns({"total_tokens": F.col("input_tokens") + F.col("output_tokens"), "cache_reuse_rate": rate})


def timeline(c: DataFrame) -> DataFrame:
    """Calls in session order with ttft, latency, chain break, compaction and system drift against the call before.

    Chain break: the earlier history is no prefix of this one, that is, its last hash is not this one's of that place. Compaction: input tokens or thread
    characters under 70 % of the call before. Drift: another system text.
    """
    w = _before()
    length, last = F.lag(F.size("history")).over(w), F.lag(F.try_element_at("history", F.lit(-1))).over(w)
    broken = (length > 0) & ~F.get("history", (length - 1).cast("int")).eqNullSafe(last)
    fell = lambda n: F.coalesce(F.col(n) * 100 < F.lag(n).over(w) * 70, F.lit(False))
    has = F.lag("call_id").over(w).isNotNull()
    ms = lambda a, b: F.timestamp_diff("MILLISECOND", F.col(a), F.col(b))
    return c.withColumns({
        "ttft_ms": ms("start", "first_chunk"), "latency_ms": ms("start", "end"), "chain_break": F.coalesce(has & broken, F.lit(False)), "compaction": has & (fell("input_tokens") | fell("thread_chars")),
        "system_drift": has & ~F.coalesce("system_hash", F.lit("")).eqNullSafe(F.coalesce(F.lag("system_hash").over(w), F.lit(""))), "before_tokens": F.lag("input_tokens").over(w)})


def summaries(c: DataFrame) -> DataFrame:
    """One row for each session: title, calls, first model, times, and whether anything went wrong."""
    t = timeline(c)
    at = F.struct("start", "call_id")
    failed = F.col("error").isNotNull() | F.coalesce(~F.col("status").between(200, 299), F.lit(False))
    return t.groupBy("session").agg(
        excerpt(F.min_by("prompt", F.when(F.col("prompt").isNotNull(), at)), 100).alias("title"), F.count("*").alias("call_count"), F.min_by("model", F.when(F.col("model").isNotNull(), at)).alias("model"), F.min("start").alias("start"), F.max(F.coalesce("end", "start")).alias("end"),
        F.bool_or(failed).alias("has_error"), F.bool_or("compaction").alias("has_compaction"))


FOUND = "struct<rule:string,severity:string,evidence:string>"


def _one(when, rule: str, severity: str, evidence=None):
    """An array of the one finding of a row that meets a condition, else an empty one."""
    found = F.struct(F.lit(rule), F.lit(severity), F.lit(None).cast("string") if evidence is None else evidence.cast("string")).cast(FOUND)
    return F.when(F.coalesce(when, F.lit(False)), F.array(found)).otherwise(F.array().cast(f"array<{FOUND}>"))


def _each(evidence, rule: str, severity: str):
    """A finding for each item of an array (null: none)."""
    return F.coalesce(F.transform(evidence, lambda e: F.struct(F.lit(rule), F.lit(severity), e.cast("string")).cast(FOUND)), F.array().cast(f"array<{FOUND}>"))


def _findings(df: DataFrame, *found) -> DataFrame:
    """(rule, severity, call_id, session, evidence): what is found in each row, all in one pass over the rows."""
    return df.select("call_id", "session", F.inline(F.concat(*found))).select("rule", "severity", "call_id", "session", "evidence")


def pairing_gaps(blocks: DataFrame) -> DataFrame:
    """(call_id, rule, tool_use_id): uses without a result, and results without a use, in the same call: one pass over the blocks."""
    x = blocks.filter("kind IN ('tool_use', 'tool_result') AND tool_use_id IS NOT NULL").groupBy("call_id", "tool_use_id").agg(F.bool_or(F.col("kind") == "tool_use").alias("used"), F.bool_or(F.col("kind") == "tool_result").alias("answered"))
    return x.filter("used <> answered").select("call_id", F.when(F.col("used"), "tool_result_missing").otherwise("tool_use_missing").alias("rule"), "tool_use_id")


def call_alerts(c: DataFrame, blocks: DataFrame, policy: CallPolicy = CallPolicy()) -> DataFrame:
    """What is wrong with single calls and their blocks. Either table is read once: what a call's blocks tell is one row that its call takes over."""
    use, answer = F.col("kind") == "tool_use", F.col("kind") == "tool_result"
    large = F.coalesce(F.col("chars") >= policy.large_block_chars, F.lit(False))
    told = blocks.filter(use | answer | large).groupBy("call_id").agg(
        F.collect_list(F.when(large, F.col("chars"))).alias("_large"), F.collect_list(F.when(answer & F.col("is_error"), F.struct("tool_use_id"))).alias("_failed"),
        F.collect_set(F.when(use, F.col("tool_use_id"))).alias("_uses"), F.collect_set(F.when(answer, F.col("tool_use_id"))).alias("_results"))
    enough = F.col("input_tokens") >= policy.cache_min_input_tokens
    return _findings(
        token_metrics(c).join(told, "call_id", "left"),
        _one(~F.col("status").between(200, 299), "http_status", "error", F.col("status")), _one(F.col("error").isNotNull() & F.col("status").isNull(), "transport_error", "error", F.col("error")), _one(F.col("end").isNull(), "incomplete_response", "warning"),
        _one(F.col("input_tokens").isNull() & F.col("output_tokens").isNull(), "usage_missing", "info"), _one(F.col("start").isNull() | F.col("first_chunk").isNull(), "timestamp_missing", "info"),
        _one(enough & (F.col("cache_reuse_rate") < policy.low_cache_reuse_rate), "cache.low_reuse", "info", F.col("cache_reuse_rate")), _one(F.col("cache_reuse_rate").isNull(), "cache.reuse_unavailable", "info"),
        _each(F.col("_large"), "context.large_block", "warning"), _each(F.transform("_failed", lambda f: f["tool_use_id"]), "execution.tool_error", "warning"),
        _each(F.array_except("_uses", "_results"), "tool_result_missing", "warning"), _each(F.array_except("_results", "_uses"), "tool_use_missing", "warning"))


def session_alerts(c: DataFrame, policy: CallPolicy = CallPolicy()) -> DataFrame:
    """Compaction, system drift, growth, slow first tokens and slow calls in session order."""
    grew = (F.col("input_tokens") / F.greatest("before_tokens", F.lit(1)) > policy.growth_ratio) & (F.col("input_tokens") - F.col("before_tokens") >= policy.growth_min_tokens)
    return _findings(
        timeline(c), _one(F.col("compaction"), "compaction", "info"), _one(F.col("system_drift"), "system_prompt_drift", "warning"), _one(grew, "excessive_growth", "warning", F.col("input_tokens")),
        _one(F.col("ttft_ms") > policy.slow_ttft_ms, "slow_ttft", "warning", F.col("ttft_ms")), _one(F.col("latency_ms") > policy.slow_latency_ms, "slow_latency", "warning", F.col("latency_ms")))


def dashboard(c: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row of totals; the cache rate is the mean of the calls' rates."""
    m = token_metrics(c).agg(F.count("*").alias("calls"), F.count_distinct("session").alias("sessions"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("total_tokens").alias("total_tokens"), F.avg("cache_reuse_rate").alias("cache_reuse_rate"))
    a = alerts.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return m.crossJoin(a)  # one row each


def alert_inventory(alerts: DataFrame, params: Mapping = {}) -> tuple[DataFrame, DataFrame]:
    """(page, total) of the filtered alerts: offset and limit, the limit at most 100."""
    x = alerts
    for k, column in (("severity", "severity"), ("rule", "rule"), ("call_id", "call_id"), ("session_id", "session")):
        if k in params:
            x = x.filter(F.col(column).cast("string") == str(params[k]))
    limit = max(1, min(100, int(params.get("limit", 50))))
    return x.orderBy("call_id", "rule", "evidence").offset(int(params.get("offset", 0))).limit(limit), x.agg(F.count("*").alias("total"))


def calls_list(calls: DataFrame) -> DataFrame:
    """Captures in short: time, model, status, whether streamed and whether failed."""
    model = F.get_json_object("request_body", "$.model")
    failed = F.col("error").isNotNull() | F.coalesce(~F.col("response_status").between(200, 299), F.lit(False))
    return calls.select("id", "timestamp_start", "method", "url", "response_status", model.alias("model"), F.col("response_raw_sse").isNotNull().alias("is_stream"), failed.alias("has_error"))


def normalised_docs(calls: DataFrame) -> DataFrame:
    """(call_id, doc): one nested record for each call with system, tools, thread, usage and block counts, in order, made within the row."""
    x = derive.normalised_calls(calls)
    n = lambda k: F.size(F.filter(F.flatten(F.transform("turns", lambda t: t["blocks"])), lambda b: b["kind"] == k))
    system = F.transform("segs", lambda s, i: F.struct(i.alias("seg"), s["text"].alias("text"), F.char_length(s["text"]).cast("long").alias("chars"), s["cache_control"].alias("cache_control")))
    tools = F.transform("decls", lambda d, i: F.struct(i.alias("pos"), d["name"].alias("name"), d["description"].alias("description"), d["input_schema"].alias("input_schema")))
    some = lambda listed, c: F.when(F.size(listed) > 0, c)
    doc = F.struct(
        F.col("id").alias("call_id"), "dialect", "model", "session_key", "response_status", "error", "raw_fallback", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens",
        some("segs", system).alias("system"), some("decls", tools).alias("tools"), some("turns", F.col("turns")).alias("thread"), *[some("turns", n(k)).cast("long").alias(k) for k in normalise.KINDS])
    return x.select(F.col("id").alias("call_id"), F.to_json(doc).alias("doc"))
