"""Column functions that the operators share. Unknown stays null; none of them raises on odd input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEP = "\u001e"


def header(headers: Column, name: str) -> Column:
    """A header of a map by name, whatever the case of either."""
    return F.try_element_at(lowered(headers), F.lit(name.lower()))


def lowered(headers: Column) -> Column:
    """A map of headers with its names in lower case: what reads several of them makes it once."""
    return F.transform_keys(headers, lambda k, _: F.lower(k))


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds from one timestamp to another, cut towards zero."""
    return F.timestamp_diff("MILLISECOND", start.try_cast("timestamp"), end.try_cast("timestamp"))


def fingerprint(*parts: Column, length: int = 16) -> Column:
    """Hex digest of the parts in order, each closed by a separator; null parts are empty."""
    closed = [F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit(_SEP)) for p in parts]
    return F.substring(F.sha2(F.concat(*closed), 256), 1, length)


def trace_context(value: Column) -> tuple[Column, Column]:
    """(trace id, parent id) of a `00-<32 hex>-<16 hex>-..` header, in lower case; null if it is not one."""
    pattern = r"^[0-9a-fA-F]{2}-([0-9a-fA-F]{32})-([0-9a-fA-F]{16})-[0-9a-fA-F]{2}"
    return tuple(F.nullif(F.lower(F.regexp_extract(value, pattern, k)), F.lit("")) for k in (1, 2))


def line_value(text: Column, marker: str) -> Column:
    """What follows a marker up to the end of its line, trimmed; null if nothing does."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?s)\Q{marker}\E([^\n]*)", 1)), F.lit(""))


def mcp_server(name: Column) -> Column:
    """The server of a tool named `mcp__<server>__<tool>`, else null."""
    return F.when(name.startswith("mcp__"), F.nullif(F.split(F.substring(name, 6, 1 << 30), "__")[0], F.lit("")))


def excerpt(text: Column, most: int) -> Column:
    """The first `most` characters, with an ellipsis if there are more."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def strip_alias(model: Column) -> Column:
    """A model id without one trailing `-latest` or build date; null if it has neither."""
    base = F.regexp_extract(model, r"^(.*)-(?:latest|[0-9]{8})$", 1)
    return F.when(model.rlike(r"^.*-(?:latest|[0-9]{8})$"), base)


def stop_sequence_tag(stops: Column) -> Column:
    """The tag inside the first of a JSON array of stop sequences; null if there is none."""
    first = F.get_json_object(stops, "$[0]")
    return F.nullif(F.regexp_replace(F.regexp_replace(first, r"^<*/*", ""), r">*$", ""), F.lit(""))


#: How text that a harness puts into a user turn begins.
INJECTED = ("<system-reminder>", "<command-", "<local-command-", "Caveat:", "[Request interrupted")


def is_injected(text: Column) -> Column:
    """Whether a user text was put there by the harness."""
    hits = [F.ltrim(text).startswith(m) for m in INJECTED]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return F.coalesce(out, F.lit(False))


def model_label(model: Column) -> Column:
    """A model id without its build date."""
    return F.regexp_replace(model, r"-[0-9]{8}$", "")


def flat_truncate(text: Column, most: int) -> Column:
    """White space runs made one space, then excerpt()."""
    return excerpt(F.trim(F.regexp_replace(text, r"\s+", " ")), most)


