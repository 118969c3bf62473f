"""Captures of any dialect as one call model: a row for each call with its segments, tool declarations and turns as arrays, or a row for each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.scalars import lowered
from tallyspark.functions.variants import chars, flag, flat_text, items, json_kind, let, listed, once, read, strict_json, sub, text, whole

#: Wrappers that mark text which the harness put in.
TAGS = ("system-reminder", "local-command-caveat", "command-name", "command-message", "command-args", "local-command-stdout")
LARGE_BLOCK = 10_000
BLOCK = "struct<kind:string,content_tag:string,chars:bigint,content:string,tool_name:string,input:string,tool_use_id:string,is_error:boolean>"
USAGE = "struct<input_tokens:variant,output_tokens:variant,prompt_tokens:variant,completion_tokens:variant,cache_read_input_tokens:variant,cache_creation_input_tokens:variant,prompt_tokens_details:struct<cached_tokens:variant>,input_tokens_details:struct<cached_tokens:variant>>"
SEGMENT, DECLARATION = "struct<text:string,cache_control:boolean>", "struct<name:string,description:string,input_schema:string>"
TURN = f"struct<turn:int,role:string,origin:string,blocks:array<{BLOCK}>>"
#: What is read of a message, a block, an item and a tool call, each in one walk; `binary` as in text().
CLAUDE_MESSAGE = "struct<role:binary,content:variant>"
CLAUDE_BLOCK = "struct<type:binary,text:binary,thinking:binary,name:binary,input:variant,id:binary,content:variant,tool_use_id:binary,is_error:variant>"
OPENAI_ITEM = "struct<type:binary,role:binary,content:variant,tool_calls:array<variant>,tool_call_id:binary,call_id:binary,output:variant,name:binary,arguments:binary>"
CALL = "struct<name:binary,arguments:binary>"
#: Further dialects: name -> function(body, response) -> an array of TURN as a column. The two built in are below.
DIALECTS: dict = {}


def detect_provider(headers: Column, url: Column) -> Column:
    """The dialect of a request by its headers and URL; the first rule that holds, else `unknown`."""
    return let(F.struct(lowered(headers).alias("h"), url.alias("url")), lambda r: _provider(r["h"], r["url"]))


def _provider(low: Column, url: Column) -> Column:
    h = lambda name: F.coalesce(F.try_element_at(low, F.lit(name)), F.lit(""))
    agent = F.lower(h("user-agent"))
    claude = (F.lower(h("x-app")) == "cli") | agent.contains("claude-cli") | (h("anthropic-version") != "") | url.contains("/v1/messages")
    openai = url.contains("/chat/completions") | url.contains("/responses") | (h("openai-organization") != "") | agent.contains("openai") | agent.contains("codex") | agent.contains("opencode")
    return F.when(claude, "claude_code").when(openai, "openai").otherwise("unknown")


def inference_calls(calls: DataFrame) -> DataFrame:
    """POST requests with a body: the others derive nothing and are no failures."""
    return calls.filter((F.upper("method") == "POST") & F.col("request_body").isNotNull())


def parse(calls: DataFrame) -> DataFrame:
    """Calls with dialect, body and response as VARIANT, model and session_key. Invalid JSON is null."""
    body, answer = strict_json(F.col("request_body")), F.coalesce(strict_json(F.col("response_reconstructed")), strict_json(F.col("response_body")))
    x = once(calls, {"_low": lowered(F.col("request_headers")), "body": body, "_answer": answer})
    x = once(x, {"dialect": _provider(F.col("_low"), F.col("url"))})
    # A type that is no string says nothing.
    x = x.withColumn("response", F.when((F.col("dialect") != "claude_code") | (F.coalesce(text(F.col("_answer"), "$.type"), F.lit("message")) == "message"), F.col("_answer"))).drop("_answer")
    h = lambda n: F.nullif(F.try_element_at("_low", F.lit(n)), F.lit(""))
    claude_key = F.coalesce(F.try_element_at("_low", F.lit("x-claude-code-session-id")), text(F.col("body"), "$.metadata.user_id.session_id"))
    openai_key = F.coalesce(*[h(n) for n in ("session-id", "thread-id", "session_id", "x-session-id", "x-codex-session-id")], text(F.col("body"), "$.conversation"))
    return x.withColumns({
        "model": text(F.col("body"), "$.model"), "raw_fallback": F.col("dialect") == "unknown",
        "session_key": F.when(F.col("dialect") == "claude_code", claude_key).when(F.col("dialect") == "openai", openai_key)}).drop("_low")


def _openai_items(body: Column) -> Column:
    given = F.when(sub(body, "$.messages").isNull(), listed(body, "$.input"))  # asked for only where the messages are no array
    return F.coalesce(listed(body, "$.messages"), given, F.array().cast("array<variant>"))


def _is_system(i: Column) -> Column:
    return F.coalesce(text(i, "$.role").isin("system", "developer"), F.lit(False))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _leading(given: Column) -> Column:
    """How many leading items are the harness's, not the conversation's."""
    other = F.array_position(F.transform(given, lambda i: ~_is_system(i)), F.lit(True))
    return F.when(other == 0, F.size(given)).otherwise(other - 1).cast("int")


def _segments() -> Column:
    """The system prompt in pieces. Of an OpenAI request: the instructions and the text of its leading system items."""
    seg = lambda t, c: F.struct(t.alias("text"), c.alias("cache_control"))
    body = F.col("body")
    several = lambda parts: F.filter(F.transform(parts, lambda b: seg(text(b, "$.text"), sub(b, "$.cache_control").isNotNull())), lambda s: s["text"].isNotNull())
    single = let(text(body, "$.system"), lambda t: F.when(t.isNotNull(), F.array(seg(t, F.lit(False)))).otherwise(_none(SEGMENT)))
    claude = let(listed(body, "$.system"), lambda parts: F.when(parts.isNotNull(), several(parts)).otherwise(single))
    said = F.filter(F.slice("_items", F.lit(1), F.col("_start")), lambda i: ~F.coalesce(text(i, "$.type") == "additional_tools", F.lit(False)))
    lead = F.filter(F.transform(said, lambda i: seg(flat_text(sub(i, "$.content")), F.lit(False))), lambda s: F.coalesce(s["text"], F.lit("")) != "")
    given = F.filter(F.array(seg(text(body, "$.instructions"), F.lit(False))), lambda s: s["text"].isNotNull())
    return F.when(F.col("dialect") == "claude_code", claude).when(F.col("dialect") == "openai", F.concat(given, lead)).otherwise(_none(SEGMENT))


def _flat_tools(tools: Column) -> Column:
    """Tools with every namespace replaced, in place, by what it holds, however deep: a round a level, no more than there are namespaces."""
    is_space = lambda t: F.coalesce(text(t, "$.type") == "namespace", F.lit(False))
    level = lambda ts: F.flatten(F.transform(ts, lambda t: F.when(is_space(t), items(t, "$.tools")).otherwise(F.array(t))))
    deepest = F.aggregate(F.transform(F.filter(tools, is_space), lambda t: F.regexp_count(F.to_json(t), F.lit('"namespace"'))), F.lit(0), lambda a, n: F.greatest(a, n))
    return let(deepest, lambda n: F.when(n == 0, tools).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), tools, lambda ts, _: F.when(F.exists(ts, is_space), level(ts)).otherwise(ts))))


def _declarations() -> Column:
    """Declared tools; nameless ones are dropped, namespaces flattened."""
    extra = F.flatten(F.transform(F.filter(F.slice("_items", F.lit(1), F.col("_start")), lambda i: F.coalesce(text(i, "$.type") == "additional_tools", F.lit(False))), lambda i: items(i, "$.tools")))
    own = items(F.col("body"), "$.tools")
    given = F.when(F.col("dialect") == "claude_code", own).when(F.col("dialect") == "openai", let(F.concat(own, extra), _flat_tools)).otherwise(_none("variant"))

    def one(spec):
        schema = F.coalesce(sub(spec, "$.parameters"), sub(spec, "$.input_schema"), sub(spec, "$.format"))
        return F.struct(text(spec, "$.name").alias("name"), text(spec, "$.description").alias("description"), F.to_json(schema).alias("input_schema"))

    return F.filter(F.transform(given, lambda t: let(F.coalesce(sub(t, "$.function"), t), one)), lambda d: d["name"].isNotNull())


def _block(kind, content=None, size=None, tag=None, name=None, given=None, use=None, error=None) -> Column:
    null = F.lit(None)
    return F.struct(F.lit(kind) if isinstance(kind, str) else kind, *[null if x is None else x for x in (tag, size, content, name, given, use, error)]).cast(BLOCK)


def _tagged(said: Column) -> Column:
    """A text block; a wrapper that marks injected text is taken off and named (its end may be missing)."""
    pattern = rf"(?s)^<({'|'.join(TAGS)})>(.*?)(?:</\1>)?$"
    found = lambda s, k: F.regexp_extract(F.trim(s), pattern, k)
    inner = lambda s, tag: F.when(tag.isNotNull(), F.trim(found(s, 2))).otherwise(s)
    made = lambda s, tag: let(inner(s, tag), lambda t: _block("text", t, F.char_length(t).cast("long"), tag))
    return let(said, lambda s: let(F.nullif(found(s, 1), F.lit("")), lambda tag: made(s, tag)))


def _said(fields: Column, name: str) -> Column:
    """A text among the fields that were read of an object; empty if there is none."""
    return F.coalesce(fields[name].cast("string"), F.lit(""))


def _plain(said: Column) -> Column:
    return let(said, lambda s: _block("text", s, F.char_length(s).cast("long")))


def _claude_block(b: Column) -> Column:
    return let(read(b, "$", CLAUDE_BLOCK), lambda f: let(_said(f, "type"), lambda t: _claude_kind(t, f, b)))


def _claude_kind(t: Column, f: Column, b: Column) -> Column:
    return (
        F.when(t == "text", _tagged(_said(f, "text")))
        .when(t == "thinking", _block("thinking", f["thinking"].cast("string"), chars(b)))
        .when(t == "tool_use", _block("tool_use", None, chars(b), None, f["name"].cast("string"), F.to_json(f["input"]), f["id"].cast("string")))
        .when(t == "tool_result", _block("tool_result", flat_text(f["content"]), chars(b), None, None, None, f["tool_use_id"].cast("string"), flag(f["is_error"])))
        .when(t == "image", _block("image", None, chars(b)))
        .otherwise(_block("other", F.to_json(b), chars(b))))


def _role(said: Column) -> Column:
    return let(said, lambda r: F.when(r.isin("user", "assistant", "tool", "system"), r).when(r == "developer", "system").otherwise("other"))


def _turn(at, role, origin: str, made) -> Column:
    return F.struct(at.cast("int").alias("turn"), role.alias("role"), F.lit(origin).alias("origin"), made.alias("blocks"))


def _claude_turns(body: Column, response: Column) -> Column:
    def turn(m, at, origin):
        single = lambda c: F.when(json_kind(c) == "STRING", F.array(_tagged(F.try_variant_get(c, "$", "string")))).when(c.isNotNull(), F.array(_block("other", F.to_json(c), chars(c)))).otherwise(_none(BLOCK))
        made = let(listed(m["content"]), lambda parts: F.when(parts.isNotNull(), F.transform(parts, _claude_block)).otherwise(single(m["content"])))
        return _turn(at, _role(m["role"].cast("string")), origin, made)

    old = F.coalesce(read(body, "$.messages", f"array<{CLAUDE_MESSAGE}>"), F.array().cast(f"array<{CLAUDE_MESSAGE}>"))
    new = lambda at: let(read(response, "$", CLAUDE_MESSAGE), lambda m: F.array(turn(m, at, "new")))
    return let(old, lambda sent: F.concat(F.transform(sent, lambda m, i: turn(m, i, "history")), F.when(response.isNotNull(), new(F.size(sent))).otherwise(_none(TURN))))


def _arguments(raw: Column) -> Column:
    return F.to_json(strict_json(raw))


def _uses(calls: Column) -> Column:
    use = lambda c, f: _block("tool_use", None, chars(c), None, f["name"].cast("string"), _arguments(f["arguments"].cast("string")), text(c, "$.id"))
    return F.transform(calls, lambda c: let(read(F.coalesce(sub(c, "$.function"), c), "$", CALL), lambda f: use(c, f)))


def _function_call(i: Column, f: Column) -> Column:
    return _block("tool_use", None, chars(i), None, f["name"].cast("string"), _arguments(f["arguments"].cast("string")), f["call_id"].cast("string"))


def _some(said: Column, make=_plain) -> Column:
    """One block of a text that is there and not empty, else none."""
    return let(said, lambda s: F.when(F.coalesce(s, F.lit("")) != "", F.array(make(s))).otherwise(_none(BLOCK)))


def _openai_turns(body: Column, response: Column) -> Column:
    result = lambda said, use: let(F.coalesce(said, F.lit("")), lambda s: F.array(_block("tool_result", s, F.char_length(s).cast("long"), None, None, None, use)))

    def old(m, at):
        return let(read(m, "$", OPENAI_ITEM), lambda f: let(F.struct(_said(f, "type").alias("kind"), _role(f["role"].cast("string")).alias("role")), lambda k: sent_turn(m, f, at, k["kind"], k["role"])))

    def sent_turn(m, f, at, kind, given):
        role = F.when(kind == "function_call", "assistant").when(kind == "function_call_output", "tool").otherwise(given)
        made = (
            F.when(kind == "function_call", F.array(_function_call(m, f)))
            .when(kind == "function_call_output", result(flat_text(f["output"]), f["call_id"].cast("string")))
            .when(given == "tool", result(flat_text(f["content"]), f["tool_call_id"].cast("string")))
            .otherwise(F.concat(_some(flat_text(f["content"])), _uses(F.coalesce(f["tool_calls"], F.array().cast("array<variant>"))))))
        return _turn(at, role, "history", made)

    def out(i):
        said, summary = flat_text(sub(i, "$.content")), F.coalesce(flat_text(sub(i, "$.summary")), F.lit(""))
        return let(text(i, "$.type"), lambda t: F.when(t == "message", _some(said)).when(t == "reasoning", F.array(_block("thinking", summary, chars(i)))).when(t == "function_call", F.array(let(read(i, "$", OPENAI_ITEM), lambda f: _function_call(i, f)))).otherwise(_none(BLOCK)))

    r = response
    thinks = lambda m: let(text(m, "$.reasoning_content"), lambda t: F.when(t.isNotNull(), F.array(_block("thinking", t, F.char_length(t).cast("long")))).otherwise(_none(BLOCK)))
    chat = lambda m: F.when(m.isNotNull(), F.concat(_some(flat_text(sub(m, "$.content"))), thinks(m), _uses(items(m, "$.tool_calls")))).otherwise(_none(BLOCK))
    made = F.concat(let(sub(r, "$.choices[0].message"), chat), F.flatten(F.transform(items(r, "$.output"), out)))
    sent = F.transform(F.slice("_items", F.col("_start") + 1, F.size("_items")), old)
    new = let(F.when(r.isNotNull(), made), lambda b: F.when(F.size(b) > 0, F.array(_turn(F.size("_items") - F.col("_start"), F.lit("assistant"), "new", b))).otherwise(_none(TURN)))
    return F.concat(sent, new)


def normalised(parsed: DataFrame, parts: tuple[str, ...] = ("segs", "decls", "turns")) -> DataFrame:
    """parse()'s rows with segs, decls and turns as arrays, and the usage numbers: a capture is read once and never shuffled.

    Turns are the history in order, then the new turn. Unknown dialects have none of the three. Only `parts` are made.
    """
    x = once(parsed, {"_items": F.when(F.col("dialect") == "openai", _openai_items(F.col("body")))})
    x = once(x, {"_start": _leading(F.col("_items"))}) if parts else x.withColumn("_start", F.lit(0))
    body, r = F.col("body"), F.col("response")
    turns_ = F.when(F.col("dialect") == "claude_code", _claude_turns(body, r)).when(F.col("dialect") == "openai", _openai_turns(body, r))
    for name, f in DIALECTS.items():
        turns_ = turns_.when(F.col("dialect") == name, f(body, r))
    claude, known = F.col("dialect") == "claude_code", F.col("dialect") != "unknown"
    n = lambda p: whole(F.col(f"_usage.{p}"))
    made = {"segs": _segments(), "decls": _declarations(), "turns": turns_.otherwise(_none(TURN))}
    return once(x, {"_usage": read(r, "$.usage", USAGE)} | {k: made[k] for k in parts}).withColumns({
        "input_tokens": F.when(claude, n("input_tokens")).when(known, F.coalesce(n("prompt_tokens"), n("input_tokens"))), "output_tokens": F.when(claude, n("output_tokens")).when(known, F.coalesce(n("completion_tokens"), n("output_tokens"))),
        "cache_read_tokens": F.when(claude, n("cache_read_input_tokens")).when(known, F.coalesce(n("prompt_tokens_details.cached_tokens"), n("input_tokens_details.cached_tokens"))), "cache_creation_tokens": F.when(claude, n("cache_creation_input_tokens"))}).drop("_items", "_start", "_usage")


def _listed(parsed: DataFrame, *parts: str) -> DataFrame:
    return parsed if set(parts) <= set(parsed.columns) else normalised(parsed, parts)


def system_segments(parsed: DataFrame) -> DataFrame:
    """(call_id, seg, text, chars, bytes, cache_control): a row for each piece of the system prompt."""
    x = _listed(parsed, "segs").select(F.col("id").alias("call_id"), F.posexplode("segs").alias("seg", "s"))
    return x.select("call_id", "seg", "s.text", F.char_length("s.text").cast("long").alias("chars"), F.octet_length("s.text").cast("long").alias("bytes"), "s.cache_control")


def tool_decls(parsed: DataFrame) -> DataFrame:
    """(call_id, pos, name, description, input_schema): a row for each declared tool."""
    return _listed(parsed, "decls").select(F.col("id").alias("call_id"), F.posexplode("decls").alias("pos", "d")).select("call_id", "pos", "d.*")


def turns(parsed: DataFrame) -> DataFrame:
    """(call_id, turn, role, origin, blocks): a row for each turn of each call's thread."""
    return _listed(parsed, "turns").select(F.col("id").alias("call_id"), F.inline("turns"))


def blocks(turn_rows: DataFrame) -> DataFrame:
    """(call_id, turn, role, origin, block, kind, content_tag, chars, content, tool_name, input, tool_use_id, is_error)."""
    return turn_rows.select("call_id", "turn", "role", "origin", F.posexplode("blocks").alias("block", "b")).select("call_id", "turn", "role", "origin", "block", "b.*")


def usage(parsed: DataFrame) -> DataFrame:
    """(call_id, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens): null where not reported."""
    return (parsed if "input_tokens" in parsed.columns else normalised(parsed, ())).select(F.col("id").alias("call_id"), "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")


KINDS = ("text", "thinking", "tool_use", "tool_result", "image", "other")


def block_counts(b: DataFrame) -> DataFrame:
    return b.groupBy("call_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])


def oversized_blocks(b: DataFrame, most: int = LARGE_BLOCK) -> DataFrame:
    return b.filter(F.col("chars") >= most).select("call_id", "turn", "block", "kind", "chars")


def pair_tools(b: DataFrame) -> DataFrame:
    """Tool uses with the first result of their id in the same call (result columns null if there is none).

    Uses and results meet in one window, so what makes the blocks runs once. Blocks without an id have no result.
    """
    done = F.when((F.col("kind") == "tool_result") & F.col("tool_use_id").isNotNull() & F.col("call_id").isNotNull(), F.struct("turn", "block"))
    r = F.struct(F.col("content").alias("result"), F.col("chars").alias("result_chars"), F.coalesce("is_error", F.lit(False)).alias("result_error"))
    x = b.filter("kind IN ('tool_use', 'tool_result')").withColumn("r", F.min_by(r, done).over(Window.partitionBy("call_id", "tool_use_id")))
    return x.filter("kind = 'tool_use'").select("call_id", "turn", "block", "origin", "tool_use_id", F.col("tool_name").alias("name"), "input", "r.result", "r.result_chars", "r.result_error", F.col("r").isNotNull().alias("paired"))


def undeclared(uses: DataFrame, decls: DataFrame) -> DataFrame:
    """Tool uses whose name the same call does not declare; nameless ones are `<unnamed>`."""
    named = uses.withColumn("name", F.coalesce("name", F.lit("<unnamed>")))
    return named.join(decls.select("call_id", "name").distinct(), ["call_id", "name"], "left_anti")


def undeclared_uses(parsed: DataFrame) -> DataFrame:
    """undeclared() of parse()'s rows, (call_id, tool_use_id, name), made within the row: a call holds its uses and its declarations. Without an id no declaration is its own."""
    uses = F.filter(F.flatten(F.transform("turns", lambda t: t["blocks"])), lambda b: b["kind"] == "tool_use")
    named = F.transform(uses, lambda b: F.struct(b["tool_use_id"].alias("tool_use_id"), F.coalesce(b["tool_name"], F.lit("<unnamed>")).alias("name")))
    own = F.when(F.col("id").isNotNull(), F.transform("decls", lambda d: d["name"])).otherwise(F.array().cast("array<string>"))
    return _listed(parsed, "decls", "turns").select(F.col("id").alias("call_id"), F.inline(let(own, lambda names: F.filter(named, lambda u: ~F.array_contains(names, u["name"])))))


def thread_outline(b: DataFrame, preview: int = 2000) -> DataFrame:
    """Blocks with a preview of their content, and whether it was cut."""
    return b.select("call_id", "turn", "role", "origin", "block", "kind", "content_tag", "tool_name", "chars", F.left("content", F.lit(preview)).alias("preview"), F.coalesce(F.char_length("content") > preview, F.lit(False)).alias("truncated"))


def kinds(b: DataFrame) -> DataFrame:
    """Blocks and characters of each call by kind."""
    return b.groupBy("call_id", "kind").agg(F.count("*").alias("count"), F.sum("chars").alias("chars"))
