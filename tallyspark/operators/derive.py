"""Generations, tool calls and harness dimensions out of normalised captures: everything of a call within its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import excerpt, fingerprint, is_injected, lowered, line_value, mcp_server, millis_between, trace_context
from tallyspark.functions.variants import items, let, listed, once, read, strict_json, sub, text, whole
from tallyspark.operators import normalise

BILLING_PREFIX = "x-anthropic-billing-header:"
PARSER_VERSION = "1"
#: What derive_generations() reads of a request, of an answer and of the user id in it: each object is walked once.
ASKS = "struct<metadata:struct<user_id:variant>,max_tokens:variant,temperature:double,thinking:struct<type:variant,budget_tokens:variant>,stop_sequences:variant,context_management:variant>"
SAYS = (
    "struct<model:variant,service_tier:variant,stop_reason:variant,status:variant,choices:array<struct<finish_reason:variant>>,usage:struct<service_tier:variant,cache_creation:struct<ephemeral_5m_input_tokens:variant,ephemeral_1h_input_tokens:variant>,"
    "output_tokens_details:struct<thinking_tokens:variant,reasoning_tokens:variant>,completion_tokens_details:struct<reasoning_tokens:variant>>>")
USER = "struct<session_id:variant,account_uuid:variant,device_id:variant>"


def frameworks(headers: Column):
    """The client of a call by its user agent or originator; header names in lower case."""
    named = lambda n: F.lower(F.coalesce(F.try_element_at(headers, F.lit(n)), F.lit("")))
    has = lambda s: named("user-agent").contains(s) | named("originator").contains(s)
    return F.when(F.col("dialect") == "claude_code", "claude-code").when(F.col("dialect") == "openai", F.when(has("codex"), "codex").when(has("opencode"), "opencode").when(has("pi-"), "pi-dev").otherwise("openai-sdk"))


def _sum(values) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, n: a + F.coalesce(n, F.lit(0)).cast("long"))


def with_system_shape(x: DataFrame) -> DataFrame:
    """System prompt of each row's `segs`: fingerprint without the billing segment; sizes with it; variant, branch, folder. Null without segments."""
    some = F.size("segs") > 0
    texts = F.transform("segs", lambda s: s["text"])
    kept = F.filter(texts, lambda t: ~t.startswith(BILLING_PREFIX))
    x = x.withColumn("_said", F.when(some, F.array_join(texts, "\n")))
    variant = F.regexp_extract(F.get("segs", F.lit(0))["text"], r"cc_version=([^;]*);", 1)
    return x.withColumns({
        "system_hash": F.when(some, fingerprint(F.array_join(kept, "\u001e"))), "system_chars": F.when(some, _sum(F.transform("segs", lambda s: F.char_length(s["text"])))), "system_segments": F.when(some, F.size("segs").cast("long")),
        "cache_points": F.when(some, F.size(F.filter("segs", lambda s: s["cache_control"])).cast("long")), "billing_variant": F.when(some, F.nullif(F.trim(variant), F.lit(""))),
        "git_branch": line_value(F.col("_said"), "Current branch:"), "cwd": line_value(F.col("_said"), "Primary working directory:")}).drop("_said")


def with_tool_shape(x: DataFrame) -> DataFrame:
    """Declared tools of each row's `decls`: fingerprint of the set by name, sizes, and how many are from servers. Null without tools, but the count."""
    size = lambda d: F.char_length(d["name"]) + F.coalesce(F.char_length(d["description"]), F.lit(0)) + F.coalesce(F.char_length(d["input_schema"]), F.lit(0))
    x = x.withColumn("tools", F.array_sort(F.transform("decls", lambda d: F.struct(d["name"].alias("name"), d["description"].alias("description"), d["input_schema"].alias("input_schema"), size(d).cast("long").alias("chars")))))
    some = F.size("decls") > 0
    key = F.array_join(F.transform("tools", lambda t: F.concat_ws("\u001e", t["name"], F.coalesce(t["description"], F.lit("")), F.coalesce(t["input_schema"], F.lit("")))), "\u001e")
    return x.withColumns({
        "tools_hash": F.when(some, fingerprint(key)), "tools_declared_count": F.size("decls").cast("long"), "tools_chars": F.when(some, _sum(F.transform("tools", lambda t: t["chars"]))),
        "mcp_tools_count": F.when(some, F.size(F.filter("decls", lambda t: mcp_server(t["name"]).isNotNull())).cast("long"))})


def turn_hash(t: Column) -> Column:
    """A turn's digest: its role and what its blocks hold, their sizes and errors aside."""
    said = F.array_join(F.transform(t["blocks"], lambda b: F.concat_ws("\u001f", b["kind"], F.coalesce(b["content"], F.lit("")), F.coalesce(b["tool_name"], F.lit("")), F.coalesce(b["input"], F.lit("")), F.coalesce(b["tool_use_id"], F.lit("")))), "\u001e")
    return F.sha2(F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\u001e"), said), 256)


def chained(hashes: Column) -> Column:
    """The digest of a whole array of digests: each step is that of the step before and the next."""
    return F.aggregate(hashes, F.lit(""), lambda acc, h: F.sha2(F.concat(acc, h), 256))


def prefix_hashes(hashes: Column) -> Column:
    """A 64-bit hash of each prefix of an array of digests, from the first on: two calls share their first n turns if their n-th are equal."""
    return F.aggregate(hashes, F.array().cast("array<bigint>"), lambda acc, h: F.array_append(acc, F.xxhash64(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")), h)))


def with_thread_shape(x: DataFrame) -> DataFrame:
    """Thread of each row's `turns`: turns and characters, whether a human spoke last, prefix fingerprints, first prompt.

    The conversation's fingerprint is chained() over its history, turn by turn.
    """
    x = once(x, {"_old": F.filter("turns", lambda t: t["origin"] == "history")}).withColumn("_hashes", F.transform("_old", turn_hash))
    last, some = F.try_element_at("_old", F.lit(-1)), F.size("_old") > 0
    own = lambda b: (b["kind"] == "text") & b["content_tag"].isNull() & ~is_injected(b["content"]) & (F.trim(b["content"]) != "")
    said = F.flatten(F.transform(F.filter("turns", lambda t: t["role"] == "user"), lambda t: F.filter(t["blocks"], own)))
    any_turn = F.size("turns") > 0
    return x.withColumns({
        "messages_count": F.when(any_turn, F.size("_old").cast("long")), "context_chars": F.when(any_turn, _sum(F.transform(F.flatten(F.transform("turns", lambda t: t["blocks"])), lambda b: b["chars"]))),
        "new_user_turn": F.when(any_turn, F.coalesce((last["role"] == "user") & F.exists(last["blocks"], lambda b: b["kind"] == "text"), F.lit(False))),
        "conversation_hash": F.when(some, F.substring(chained(F.col("_hashes")), 1, 16)), "first_turn_hash": F.when(some, F.substring(chained(F.slice("_hashes", 1, 1)), 1, 16)), "user_prompt": excerpt(F.get(said, F.lit(0))["content"], 512)}).drop("_old", "_hashes")


def _uses(x: DataFrame) -> DataFrame:
    """`x` with _uses: the tool uses of its thread in order, each with the first result of its id in the same call."""
    flat = F.flatten(F.transform("turns", lambda t: F.transform(t["blocks"], lambda b: F.struct(t["origin"].alias("origin"), b.alias("b")))))
    ids = lambda rs: F.transform(rs, lambda r: r["b"]["tool_use_id"])

    def made(blocks, results, known):
        def use(u):
            b, name = u["b"], F.coalesce(u["b"]["tool_name"], F.lit("<unnamed>"))
            got = F.get(results, F.array_position(known["ids"], b["tool_use_id"]).cast("int") - 1)["b"]
            return F.struct(u["origin"].alias("origin"), b["tool_use_id"].alias("tool_use_id"), name.alias("name"), b["input"].alias("input"), F.coalesce(F.array_contains(known["names"], name), F.lit(False)).alias("was_declared"), got.alias("r"))

        return F.transform(F.filter(blocks, lambda u: u["b"]["kind"] == "tool_use"), use)

    names = F.transform("decls", lambda d: d["name"])
    results = lambda bs: F.filter(bs, lambda r: (r["b"]["kind"] == "tool_result") & r["b"]["tool_use_id"].isNotNull())
    # Bound by let(): a column that a lambda reads once would be worked out anew for each element.
    return x.withColumn("_uses", let(flat, lambda bs: let(results(bs), lambda rs: let(F.struct(ids(rs).alias("ids"), names.alias("names")), lambda known: made(bs, rs, known)))))


def tool_calls(x: DataFrame) -> DataFrame:
    """A row for each tool use of each normalised() call's thread (one that is sent again shows in every later call)."""
    u, n = F.col("u"), F.col("seq")
    y = _uses(x).select(F.col("id").alias("call_id"), F.col("session_key").alias("session_id"), F.coalesce("timestamp_end", "timestamp_start").alias("emitted_at"), F.posexplode("_uses").alias("seq", "u"))
    failed, paired = F.coalesce(u["r"]["is_error"], F.lit(False)), u["r"].isNotNull()
    return y.select(
        "call_id", "session_id", "seq", F.concat_ws(":", "call_id", n).alias("tool_id"), u["tool_use_id"].alias("tool_use_id"), u["name"].alias("name"), mcp_server(u["name"]).alias("server"), u["name"].startswith("mcp__").alias("is_mcp"), u["was_declared"].alias("was_declared"),
        F.coalesce(F.char_length(u["input"]), F.lit(0)).cast("long").alias("input_chars"), excerpt(u["input"], 400).alias("input_excerpt"), u["r"]["chars"].alias("result_chars"), excerpt(u["r"]["content"], 400).alias("result_excerpt"),
        F.when(paired, failed).alias("is_error"), F.when(~paired, "pending").when(failed, "error").otherwise("ok").alias("status"), "emitted_at", F.lit(None).cast("timestamp").alias("observed_at"), F.lit(None).cast("long").alias("duration_ms"))


def normalised_calls(calls: DataFrame, parts: tuple[str, ...] = ("segs", "decls", "turns")) -> DataFrame:
    """Inference calls with their segments, declarations, turns (or only those `parts`) and usage in the row."""
    return normalise.normalised(normalise.parse(normalise.inference_calls(calls)), parts)


def derive_generations(calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(generations, tool calls, segments by call, declarations by call) of inference calls; unpriced and unassembled."""
    x = normalised_calls(calls)
    new = F.flatten(F.transform(F.filter("turns", lambda t: t["origin"] == "new"), lambda t: F.transform(F.filter(t["blocks"], lambda b: b["kind"] == "tool_use"), lambda b: b["tool_name"])))
    body, asks, r, u, user = F.col("body"), F.col("_asks"), F.col("_says"), F.col("_says.usage"), F.col("_user")
    x1 = once(x, {"_asked_by": lowered(F.col("request_headers")), "_told": lowered(F.col("response_headers")), "_asks": read(body, "$", ASKS), "_says": read(F.col("response"), "$", SAYS), "_new": new})
    five, hour = whole(u["cache_creation"]["ephemeral_5m_input_tokens"]), whole(u["cache_creation"]["ephemeral_1h_input_tokens"])
    split = five.isNotNull() | hour.isNotNull()
    made = F.coalesce(F.col("cache_creation_tokens"), F.lit(0)) > 0
    ttls = F.regexp_extract_all(F.concat(F.coalesce(F.to_json(sub(body, "$.system")), F.lit("")), F.coalesce(F.to_json(sub(body, "$.messages")), F.lit(""))), F.lit(r'"cache_control":\{[^}]*"ttl":"([^"]+)"'), F.lit(1))
    x1 = once(x1, {"_ttls": F.when(made & ~split, ttls), "_user": let(text(asks["metadata"]["user_id"]), lambda t: read(strict_json(t), "$", USER))})  # lifetimes are read where the answer does not split what it wrote
    y = with_thread_shape(with_tool_shape(with_system_shape(x1)))
    h = lambda n: F.try_element_at("_asked_by", F.lit(n))
    rh = lambda n: F.try_element_at("_told", F.lit(n))
    asked = F.col("_ttls")
    long_ttl, short_ttl = F.array_contains(asked, "1h"), F.size(asked) > 0
    trace_id, parent = trace_context(h("traceparent"))
    status = F.col("response_status")
    incomplete = F.col("response_raw_sse").isNotNull() & F.col("response_reconstructed").isNull()
    failed = F.col("error").isNotNull() & status.isNull()
    kind = F.when(failed, "transport").when(status.isNotNull() & ~status.between(200, 299), "http").when(incomplete | F.coalesce(F.col("error").startswith("reconstruct:"), F.lit(False)), "stream_incomplete").when(F.col("response_body").isNull() & F.col("response_reconstructed").isNull(), "body_missing")
    cols = {
        "call_id": F.col("id"), "session_id": F.coalesce("session_key", text(user["session_id"])), "started_at": F.col("timestamp_start"), "ended_at": F.col("timestamp_end"),
        "ttft_ms": millis_between(F.col("timestamp_start"), F.col("timestamp_first_chunk")), "latency_ms": millis_between(F.col("timestamp_start"), F.col("timestamp_end")), "http_status": status, "is_stream": F.col("response_raw_sse").isNotNull(),
        "provider": F.when(F.col("dialect") == "claude_code", "anthropic").otherwise(F.col("dialect")), "framework": frameworks(F.col("_asked_by")), "client_version": F.nullif(F.regexp_extract(F.coalesce(h("user-agent"), F.lit("")), r"/([0-9][^ ]*)", 1), F.lit("")),
        "model": F.col("model"), "resolved_model": text(r["model"]), "account_uuid": text(user["account_uuid"]), "device_id": text(user["device_id"]),
        "max_tokens": whole(asks["max_tokens"]), "temperature": asks["temperature"], "thinking_type": text(asks["thinking"]["type"]), "thinking_budget": whole(asks["thinking"]["budget_tokens"]),
        "stop_sequences": F.when(F.size(listed(asks["stop_sequences"])) > 0, F.to_json(asks["stop_sequences"])), "context_management": F.to_json(asks["context_management"]), "compaction_requested": F.size(items(asks["context_management"], "$.edits")) > 0,
        "input_tokens": F.col("input_tokens"), "output_tokens": F.col("output_tokens"), "total_tokens": F.col("input_tokens") + F.col("output_tokens"), "cache_read_tokens": F.col("cache_read_tokens"), "cache_creation_tokens": F.col("cache_creation_tokens"),
        "cache_creation_5m_tokens": F.when(split, five).when(made & ~long_ttl, F.col("cache_creation_tokens")), "cache_creation_1h_tokens": F.when(split, hour).when(made & long_ttl, F.col("cache_creation_tokens")),
        "cache_ttl_source": F.when(split, "response").when(made & short_ttl, "request").when(made, "assumed"), "thinking_tokens": F.coalesce(whole(u["output_tokens_details"]["thinking_tokens"]), whole(u["completion_tokens_details"]["reasoning_tokens"]), whole(u["output_tokens_details"]["reasoning_tokens"])),
        "service_tier": F.coalesce(text(u["service_tier"]), text(r["service_tier"])), "stop_reason": F.coalesce(text(r["stop_reason"]), text(F.get(r["choices"], F.lit(0))["finish_reason"]), text(r["status"])),
        "retry_count": F.try_to_number(h("x-stainless-retry-count"), F.lit("999999")).cast("long"), "request_id": F.coalesce(rh("request-id"), rh("x-request-id")), "org_id": F.coalesce(rh("anthropic-organization-id"), rh("openai-organization")), "should_retry": rh("x-should-retry") == "true",
        "ratelimit_status": rh("anthropic-ratelimit-unified-status"), "ratelimit_5h_utilization": rh("anthropic-ratelimit-unified-5h-utilization").try_cast("double"), "ratelimit_7d_utilization": rh("anthropic-ratelimit-unified-7d-utilization").try_cast("double"),
        "overage_status": rh("anthropic-ratelimit-unified-overage-status"), "ratelimit_reset_at": F.timestamp_seconds(rh("anthropic-ratelimit-unified-reset").try_cast("long")),
        "upstream_trace_id": trace_id, "upstream_parent_id": parent, "error": F.col("error"), "error_kind": kind, "is_error": F.coalesce(kind.isin("transport", "http", "stream_incomplete"), F.lit(False)), "raw_fallback": F.col("raw_fallback"), "parser_version": F.lit(PARSER_VERSION),
    }
    shapes = ["system_hash", "system_chars", "system_segments", "cache_points", "billing_variant", "git_branch", "cwd"]
    called = F.array_sort(F.array_distinct(F.filter("_new", lambda n: n.isNotNull())))
    cols |= {n: F.col(n) for n in shapes} | {"project_name": F.nullif(F.substring_index("cwd", "/", -1), F.lit(""))}
    cols |= {n: F.col(n) for n in ("tools_hash", "tools_declared_count", "tools_chars", "mcp_tools_count", "messages_count", "context_chars", "new_user_turn", "conversation_hash", "first_turn_hash", "user_prompt")}
    cols |= {"tool_call_count": F.size("_new").cast("long"), "tools_called": F.when(F.size("_new") > 0, called)}
    return y.select(*[c.alias(n) for n, c in cols.items()]), tool_calls(x), normalise.system_segments(x), normalise.tool_decls(x)


def _prompt_row() -> Column:
    texts = F.transform("segs", lambda s: F.struct(s["text"].alias("text"), F.char_length(s["text"]).cast("long").alias("chars"), s["cache_control"].alias("cache_control")))
    return F.struct(F.col("system_chars").alias("total_chars"), F.col("system_segments").alias("segment_count"), "cache_points", texts.alias("segments"))


def _set_row() -> Column:
    return F.struct(F.col("tools_declared_count").alias("tool_count"), F.col("tools_chars").alias("total_chars"), F.col("mcp_tools_count").alias("mcp_count"), "tools")


def system_prompts(calls: DataFrame) -> DataFrame:
    """A row for each system prompt of normalised() calls, of which only the segments are read."""
    s = with_system_shape(calls).filter("system_hash IS NOT NULL")
    return s.groupBy("system_hash").agg(F.min_by(_prompt_row(), "id").alias("p")).select("system_hash", "p.*")


def tool_schemas(sets: DataFrame) -> DataFrame:
    """The members of tool sets that still have their `tools`."""
    members = sets.select("tools_hash", F.posexplode("tools").alias("seq", "t")).select("tools_hash", "seq", "t.*").dropDuplicates(["tools_hash", "name"])
    return members.withColumns({"server": mcp_server(F.col("name")), "is_mcp": F.col("name").startswith("mcp__")})


def harness_dims(calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(system prompts, tool sets, tool schemas) of normalised() calls: one row for each fingerprint, and each member of a set.

    The texts of a fingerprint are those of its least call: only they meet in a shuffle, one for each fingerprint and task.
    """
    t = with_tool_shape(calls).filter("tools_hash IS NOT NULL")
    sets = t.groupBy("tools_hash").agg(F.min_by(_set_row(), "id").alias("p")).select("tools_hash", "p.*")
    return system_prompts(calls), sets.drop("tools"), tool_schemas(sets)


def harness_rows(calls: DataFrame) -> DataFrame:
    """(kind, hash, prompt, set) of normalised() calls: the prompts and tool sets of harness_dims(), all in one pass over the calls."""
    x = with_tool_shape(with_system_shape(calls)).select("id", _prompt_row().alias("prompt"), _set_row().alias("set"), "system_hash", "tools_hash")
    # Not in the select above: beside a generator Spark forgets how the fields of a struct were named.
    x = x.select("id", "prompt", "set", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(h).alias("hash")) for k, h in (("prompt", "system_hash"), ("set", "tools_hash"))])).alias("k"))
    own = lambda kind: F.min_by(F.when(F.col("k.kind") == kind, F.col(kind)), "id").alias(kind)
    return x.filter("k.hash IS NOT NULL").groupBy(F.col("k.kind").alias("kind"), F.col("k.hash").alias("hash")).agg(own("prompt"), own("set"))
