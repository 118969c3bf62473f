"""Streamed captures to whole messages, each folded within its row: events as an array, then blocks cut out of it by index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.variants import items, json_fields, json_kind, json_object, let, merged, once, quoted, strict_json, sub, text, whole

#: What a chat response takes from the first chunk that has it.
CHAT_HEADER = ("id", "model", "created", "system_fingerprint", "service_tier")


def events(raw: Column) -> Column:
    """array<struct<seq, event, data VARIANT, parse_error>> of a raw stream.

    Lines end at a line feed, with a carriage return or without, and at nothing else; a blank line ends an event.
    Its data lines are joined by line feeds, with one leading space off each; its last name counts, else the type
    its data names. Events without data are none; data that is no JSON leaves a note.
    """
    cut = F.transform(F.split(F.replace(raw, F.lit("\r\n"), F.lit("\n")), "\n\n+"), lambda b: F.split(b, "\n"))
    after = lambda line, n: F.substring(line, n, 1 << 30)
    data = lambda lines: F.array_join(F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.when(x.startswith("data: "), after(x, 7)).otherwise(after(x, 6))), "\n")
    name = lambda lines: F.nullif(F.trim(after(F.try_element_at(F.filter(lines, lambda x: x.startswith("event:")), F.lit(-1)), 7)), F.lit(""))
    named = F.filter(F.transform(cut, lambda lines: F.struct(name(lines).alias("name"), data(lines).alias("text"))), lambda e: F.trim(e["text"]) != "")
    read = F.transform(named, lambda e: F.struct(e["name"].alias("name"), e["text"].alias("text"), strict_json(e["text"]).alias("data")))
    bad = lambda e: F.when(e["data"].isNull() & (F.trim(e["text"]) != "[DONE]"), F.concat(F.lit("bad event data: "), F.left(e["text"], F.lit(80))))
    return F.transform(read, lambda e, i: F.struct(i.alias("seq"), F.coalesce(e["name"], text(e["data"], "$.type")).alias("event"), e["data"].alias("data"), bad(e).alias("parse_error")))


def sse_events(calls: DataFrame) -> DataFrame:
    """(call_id, seq, event, data, parse_error): a row for each event of each raw stream."""
    return calls.filter(F.col("response_raw_sse").isNotNull()).select(F.col("id").alias("call_id"), F.inline(events(F.col("response_raw_sse"))))


def sse_dialect(raw: Column) -> Column:
    """chat, responses or anthropic by what the stream holds."""
    return F.when(raw.contains("chat.completion.chunk") | raw.contains("data: [DONE]"), "chat").when(raw.contains("event: response."), "responses").otherwise("anthropic")


def _some(e: Column, *names: str) -> Column:
    return F.coalesce(e["event"].isin(*names), F.lit(False)) & e["data"].isNotNull()


def _place(v: Column) -> Column:
    """A wire index: 0 unless it is a whole number from 0 on."""
    n = whole(v, "$.index")
    return F.coalesce(F.when(n >= 0, n), F.lit(0))


def _joined(pieces: Column) -> Column:
    return F.array_join(F.filter(pieces, lambda p: p.isNotNull()), "")


def _last(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))


def _groups(x: DataFrame, rows: str, key, name: str) -> DataFrame:
    """`x` with `name`: array<struct<key, rows>> of an array that is sorted by `key`, each group one stretch of it."""
    def made(keys):
        stretch = lambda k: let(F.array_position(keys["k"], k), lambda a: F.when(a > 0, F.slice(rows, a, F.size(keys["k"]) - F.array_position(keys["r"], k) + 2 - a)))
        return F.transform(F.array_distinct(keys["k"]), lambda k: F.struct(k.alias("key"), stretch(k).alias("rows")))

    return once(x, {name: let(F.transform(rows, key), lambda k: let(F.struct(k.alias("k"), F.reverse(k).alias("r")), made))})


def _anthropic(x: DataFrame) -> DataFrame:
    """`x` (ev, mine) with a_message and a_error, for the rows that are mine."""
    own = F.when(F.col("mine"), F.col("ev"))
    pick = lambda *names: F.filter(own, lambda e: _some(e, *names))
    d = lambda e: e["data"]

    def piece(e):
        kind = F.coalesce(text(d(e), "$.delta.type"), F.lit(""))
        said = F.when(kind == "thinking_delta", text(d(e), "$.delta.thinking")).when(kind == "signature_delta", text(d(e), "$.delta.signature")).when(kind == "input_json_delta", text(d(e), "$.delta.partial_json")).otherwise(text(d(e), "$.delta.text"))
        field = F.when(kind == "thinking_delta", "thinking").when(kind == "signature_delta", "signature").when(kind == "input_json_delta", "input").otherwise("text")
        return F.struct(_place(d(e)).alias("index"), e["seq"].alias("seq"), field.alias("field"), said.alias("said"))

    start = lambda e: F.struct(_place(d(e)).alias("index"), e["seq"].alias("seq"), F.lit("start").alias("field"), F.lit(None).cast("string").alias("said"))
    stop = lambda e: F.struct(_place(d(e)).alias("index"), e["seq"].alias("seq"), F.lit("stop").alias("field"), F.lit(None).cast("string").alias("said"))
    parts = F.transform(pick("content_block_start", "content_block_delta", "content_block_stop"), lambda e: F.when(e["event"] == "content_block_start", start(e)).when(e["event"] == "content_block_stop", stop(e)).otherwise(piece(e)))
    noted = F.filter(own, lambda e: e["parse_error"].isNotNull() | _some(e, "error"))
    x = once(x, {
        "_parts": F.array_sort(parts), "_began": F.exists(own, lambda e: _some(e, "message_start")), "_seed": _last(F.transform(pick("message_start"), lambda e: F.when(json_kind(sub(d(e), "$.message")) == "OBJECT", sub(d(e), "$.message")))),
        "_ends": pick("message_delta"), "_notes": F.transform(noted, lambda e: F.coalesce(e["parse_error"], F.concat(F.lit("error event: "), F.coalesce(text(d(e), "$.error.message"), F.to_json(d(e))))))})
    # A stop makes no block of its own.
    x = _groups(x, "_parts", lambda p: p["index"], "_all").withColumn("_groups", F.filter("_all", lambda g: F.exists(g["rows"], lambda p: p["field"] != "stop")))

    def block(g):
        began = F.try_element_at(F.filter(g["rows"], lambda p: p["field"] == "start"), F.lit(-1))
        grown = lambda v, f, since: F.filter(g["rows"], lambda p: (p["field"] == f) & p["said"].isNotNull() & (p["seq"] > since))
        partial = _joined(F.transform(F.filter(g["rows"], lambda p: p["field"] == "input"), lambda p: p["said"]))
        closed = F.exists(g["rows"], lambda p: p["field"] == "stop")

        def made(s):
            v, since = s["v"], F.coalesce(s["seq"], F.lit(-1))
            base = F.coalesce(json_fields(v), F.when(v.isNull(), F.create_map(F.lit("type"), F.lit('"text"'))).otherwise(F.create_map().cast("map<string,string>")))
            more = [F.when(F.size(grown(v, f, since)) > 0, F.struct(F.lit(f).alias("key"), quoted(F.concat(F.coalesce(text(v, f"$.{f}"), F.lit("")), _joined(F.transform(grown(v, f, since), lambda p: p["said"])))).alias("value"))) for f in ("text", "thinking", "signature")]
            given = F.when(closed & (partial != ""), F.struct(F.lit("input").alias("key"), F.to_json(strict_json(partial)).alias("value")))
            fields = F.map_from_entries(F.filter(F.array(*more, F.when(given["value"].isNotNull(), given)), lambda e: e.isNotNull()))
            return json_object(merged(base, fields))

        lost = F.when(closed & (partial != "") & strict_json(partial).isNull(), F.concat(F.lit("unparsable tool input in block "), g["key"]))
        v = F.when(began.isNotNull(), sub(F.get("ev", began["seq"])["data"], "$.content_block"))
        return F.struct(let(F.struct(v.alias("v"), began["seq"].alias("seq")), made).alias("json"), lost.alias("lost"))

    x = once(x, {"_blocks": F.transform("_groups", block)})
    none = F.create_map().cast("map<string,string>")
    folded = lambda at: F.aggregate("_ends", none, lambda acc, e: merged(acc, json_fields(sub(e["data"], at))))
    base = F.map_filter(F.coalesce(json_fields(F.col("_seed")), none), lambda k, _: ~k.isin("content", "usage"))
    usage = json_object(merged(json_fields(sub(F.col("_seed"), "$.usage")), folded("$.usage")))
    content = F.concat(F.lit("["), F.array_join(F.transform("_blocks", lambda b: b["json"]), ","), F.lit("]"))
    message = json_object(merged(merged(base, folded("$.delta")), F.create_map(F.lit("content"), content, F.lit("usage"), usage)))
    note = F.concat_ws("; ", F.nullif(F.array_join("_notes", "; "), F.lit("")), F.nullif(_joined_by(F.transform("_blocks", lambda b: b["lost"])), F.lit("")), F.when(~F.col("_began"), "no message_start"))
    return x.withColumns({"a_message": F.when(F.col("_seed").isNotNull() | (F.size("_blocks") > 0), message), "a_error": F.nullif(note, F.lit(""))}).drop("_parts", "_began", "_seed", "_ends", "_notes", "_all", "_groups", "_blocks")


def _joined_by(notes: Column) -> Column:
    return F.array_join(F.filter(notes, lambda n: n.isNotNull()), "; ")


def _openai(x: DataFrame) -> DataFrame:
    """`x` (ev, mine) with o_message and o_error, for the rows that are not mine."""
    own = F.when(~F.col("mine"), F.col("ev"))
    done = F.get(F.filter(own, lambda e: _some(e, "response.completed", "response.incomplete") & sub(e["data"], "$.response").isNotNull()), F.lit(0))
    x = once(x, {"_done": done})
    before = F.filter(own, lambda e: F.col("_done").isNull() | (e["seq"] < F.col("_done")["seq"]))
    x = x.withColumns({"_notes": F.filter(F.transform(before, lambda e: e["parse_error"]), lambda n: n.isNotNull()), "_chunks": F.when(F.col("_done").isNull(), F.filter(own, lambda e: e["data"].isNotNull()))})

    def frame(c, n):
        return F.struct(_place(c).alias("choice"), n.alias("seq"), text(c, "$.delta.role").alias("role"), text(c, "$.delta.content").alias("content"), text(c, "$.delta.reasoning_content").alias("thought"), text(c, "$.delta.reasoning").alias("thought2"), text(c, "$.finish_reason").alias("finish"))

    def use(choice, t, n):
        return F.struct(choice.alias("choice"), _place(t).alias("wire"), n.alias("seq"), text(t, "$.id").alias("id"), text(t, "$.function.name").alias("name"), text(t, "$.function.arguments").alias("arguments"))

    frames = F.flatten(F.transform("_chunks", lambda e: items(e["data"], "$.choices")))
    x = once(x, {"_frames": frames})
    uses = F.flatten(F.transform("_frames", lambda c, n: F.transform(items(c, "$.delta.tool_calls"), lambda t, m: use(_place(c), t, n.cast("long") * 1_000_000 + m))))
    first = lambda k: F.get(F.filter(F.transform("_chunks", lambda e: F.to_json(sub(e["data"], f"$.{k}"))), lambda v: v.isNotNull()), F.lit(0))
    usage = _last(F.transform("_chunks", lambda e: F.when(json_kind(sub(e["data"], "$.usage")) != "VOID", F.to_json(sub(e["data"], "$.usage")))))
    x = once(x, {"_said": F.array_sort(F.transform("_frames", frame)), "_uses": F.array_sort(uses), "_head": F.array(*[F.when(first(k).isNotNull(), F.struct(F.lit(k).alias("key"), first(k).alias("value"))) for k in CHAT_HEADER]), "_usage": usage})
    x = _groups(_groups(x, "_said", lambda s: s["choice"], "_choices"), "_uses", lambda u: F.struct(u["choice"].alias("choice"), u["wire"].alias("wire")), "_tools")
    tool = lambda g: F.struct(_last(F.transform(g["rows"], lambda u: u["id"])).alias("id"), F.lit("function").alias("type"), F.struct(_last(F.transform(g["rows"], lambda u: u["name"])).alias("name"), _joined(F.transform(g["rows"], lambda u: u["arguments"])).alias("arguments")).alias("function"))

    def choice(g):
        of = lambda f: F.transform(g["rows"], lambda s: s[f])
        thought = _joined(F.transform(g["rows"], lambda s: F.concat(F.coalesce(s["thought"], F.lit("")), F.coalesce(s["thought2"], F.lit("")))))
        tools = F.transform(F.filter("_tools", lambda t: t["key"]["choice"] == g["key"]), tool)
        message = F.struct(F.coalesce(_last(of("role")), F.lit("assistant")).alias("role"), _joined(of("content")).alias("content"), F.nullif(thought, F.lit("")).alias("reasoning_content"), F.when(F.size(tools) > 0, tools).alias("tool_calls"))
        return F.concat(F.lit('{"index":'), g["key"].cast("string"), F.lit(',"finish_reason":'), F.coalesce(quoted(_last(of("finish"))), F.lit("null")), F.lit(',"message":'), F.to_json(message), F.lit("}"))

    head = F.filter("_head", lambda h: h.isNotNull())
    listed = F.concat(F.lit("["), F.array_join(F.transform("_choices", choice), ","), F.lit("]"))
    chat = json_object(merged(F.map_from_entries(head), F.create_map(F.lit("object"), F.lit('"chat.completion"'), F.lit("choices"), listed, F.lit("usage"), F.coalesce("_usage", F.lit("null")))))
    some = (F.size(head) > 0) | (F.size("_choices") > 0)
    is_chat = F.col("dialect") == "chat"
    message = F.when(F.col("_done").isNotNull(), F.to_json(sub(F.col("_done")["data"], "$.response"))).when(is_chat & some, chat)
    none = F.when(F.col("_done").isNull() & ~is_chat, "no terminal response event").when(F.col("_done").isNull() & ~some, "no assembled response")
    note = F.concat_ws("; ", F.nullif(F.array_join("_notes", "; "), F.lit("")), none)
    return x.withColumns({"o_message": message, "o_error": F.nullif(note, F.lit(""))}).drop("_done", "_notes", "_chunks", "_frames", "_said", "_uses", "_head", "_usage", "_choices", "_tools")


def assembled(calls: DataFrame) -> DataFrame:
    """`calls` with stream_message (JSON text) and stream_error; null for calls without a raw stream. One pass, no shuffle.

    Messages stream: content blocks start from their last start event, with what their deltas added since; a tool input is
    read when its block stops; keys of message_delta replace the message's, its usage keys are merged, the later
    one winning. Chat chunks: by choice, texts and thoughts in order, last role and finish reason, tool calls by wire
    index. Responses: the object of the first completed or incomplete event. What came before a cut is kept.
    """
    raw = F.col("response_raw_sse")
    x = once(calls.select(F.struct(*calls.columns).alias("_call"), raw), {"dialect": sse_dialect(raw), "ev": F.when(raw.isNotNull(), events(raw)), "mine": sse_dialect(raw) == "anthropic"})
    x = _openai(_anthropic(x))
    both = lambda k: F.when(F.col("_call")["response_raw_sse"].isNotNull(), F.when(F.col("mine"), F.col(f"a_{k}")).otherwise(F.col(f"o_{k}")))
    return once(x, {"stream_message": both("message"), "stream_error": both("error")}).select("_call.*", "stream_message", "stream_error")


def reassemble(calls: DataFrame) -> DataFrame:
    """(call_id, message, error) of every streamed capture, by its dialect."""
    x = assembled(calls.filter(F.col("response_raw_sse").isNotNull()))
    return x.select(F.col("id").alias("call_id"), F.col("stream_message").alias("message"), F.col("stream_error").alias("error"))


def finalize_streams(calls: DataFrame) -> DataFrame:
    """Captures with their assembled message, and what went wrong noted after any error they had."""
    note = F.when(F.col("stream_error").isNotNull(), F.concat(F.lit("reconstruct: "), F.col("stream_error")))
    x = assembled(calls.drop("response_reconstructed"))
    return x.withColumns({"response_reconstructed": F.col("stream_message"), "error": F.nullif(F.concat_ws("; ", "error", note), F.lit(""))}).select(*calls.columns)
