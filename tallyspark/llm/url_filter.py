"""URL filters: captures against the entries of dated lists that were active when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def _host_of(authority: Column) -> Column:
    """Lower case, without user, port, `www.` and a closing dot; an address in brackets is taken whole; null if nothing is left."""
    host = F.lower(F.regexp_extract(authority, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.|\.$", ""), F.lit(""))


def url_host(url: Column) -> Column:
    """Lower-case host of a URL without user, port and a leading `www.`; null if it has none."""
    return _host_of(F.regexp_extract(url, _SCHEME + r"([^/?#]*)", 1))


def path_segments(rest: Column) -> Column:
    """The segments of a path, empty ones left out; query and fragment do not count."""
    return F.filter(F.split(F.regexp_extract(rest, r"^([^?#]*)", 1), "/", -1), lambda s: s != "")


def url_site(url: Column) -> Column:
    """Host and path segments of a URL joined by `/`; null without a host."""
    rest = F.regexp_replace(url, _SCHEME + r"[^/?#]*", "")
    return F.when(url_host(url).isNotNull(), F.array_join(F.concat(F.array(url_host(url)), path_segments(rest)), "/"))


def url_keys(site: Column) -> Column:
    """What a list can name of a site: (kind, pattern, rank).

    `domain`: the host and each parent domain of two labels at least (or the host itself); an address has no parents. `prefix`:
    each of these followed by none, one, two .. all of the path's segments. rank: (segments, labels),
    the larger the more specific; a prefix without segments ranks above its domain.
    """
    host, segments = F.substring_index(site, "/", 1), F.slice(F.split(site, "/", -1), F.lit(2), F.size(F.split(site, "/", -1)))
    labels = F.split(host, r"\.")
    address = host.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")
    domains = F.transform(F.sequence(F.lit(1), F.when(address, F.lit(1)).otherwise(F.greatest(F.size(labels) - 1, F.lit(1)))), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("name"), (F.size(labels) - i + 1).alias("labels")))
    paths = F.transform(F.sequence(F.lit(0), F.size(segments)), lambda n: F.struct(F.when(n > 0, F.concat(F.lit("/"), F.array_join(F.slice(segments, F.lit(1), n), "/"))).otherwise("").alias("path"), n.alias("n")))
    key = lambda kind, pattern, n, m: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"), F.struct(n.alias("segments"), m.alias("labels")).alias("rank"))
    whole = F.transform(domains, lambda d: key("domain", d["name"], F.lit(-1), d["labels"]))
    deep = F.flatten(F.transform(domains, lambda d: F.transform(paths, lambda p: key("prefix", F.concat(d["name"], p["path"]), p["n"], d["labels"]))))
    return F.concat(whole, deep)


def normal_pattern(kind: Column, pattern: Column) -> Column:
    """An entry's pattern written as url_keys() writes its own: scheme, `www.`, port, closing slashes and the host's case away; null without a host."""
    bare = F.regexp_replace(F.trim(pattern), _SCHEME, "")
    host = _host_of(F.regexp_extract(bare, r"^([^/?#]*)", 1))
    segments = path_segments(F.regexp_replace(bare, r"^[^/?#]*", ""))
    return F.when(host.isNotNull() & (kind == "prefix"), F.array_join(F.concat(F.array(host), segments), "/")).otherwise(host)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (list, kind, pattern, action, listed_at) as intervals [valid_from, valid_to).

    An entry holds until the next of the same list, kind and (normalised) pattern; action `remove` ends
    it. Of entries with the same date the one with the largest action counts. Entries with a null date,
    kind or pattern, or without a host, are left out.
    """
    keep = entries.select("list", "kind", normal_pattern(F.col("kind"), F.col("pattern")).alias("pattern"), "action", "listed_at")
    keep = keep.filter(F.col("listed_at").isNotNull() & F.col("kind").isNotNull() & F.col("pattern").isNotNull())
    one = keep.groupBy("list", "kind", "pattern", "listed_at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "kind", "pattern").orderBy("listed_at")
    return one.withColumn("valid_to", F.lead("listed_at").over(w)).withColumnRenamed("listed_at", "valid_from").filter(F.col("action") != "remove")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", at_col: str = "fetched_at", salts: int = 16) -> DataFrame:
    """The captures with verdict, matched_list, matched_pattern and n_active.

    An as-of join: a capture meets the entries of kind domain for its host and parent domains, and those
    of kind prefix for each of these with any leading part of its path, whose interval holds its time.
    The most specific decides (most path segments, then the longest domain, a prefix before a domain), then the
    latest listed, then the largest list and action by name; `block` or `allow` is its action, and without
    one `allow`. A capture without URL, host or time matches nothing. Hosts may be very uneven:
    captures are salted and the intervals, few beside them, are repeated for each salt. Very long URLs
    are taken whole. Rows that repeat give equal rows; other columns, of any name but those four, pass through.
    """
    c = captures.drop("verdict", "matched_list", "matched_pattern", "n_active")
    # Captures of one host, path and time share a verdict: they are joined once.
    keyed = c.withColumn("__tally_site", url_site(col(url_col))).withColumn("__tally_at", col(at_col))
    asked = keyed.filter(F.col("__tally_site").isNotNull() & F.col("__tally_at").isNotNull()).select("__tally_site", "__tally_at").distinct()
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("__tally_site", "__tally_at"), F.lit(salts)).cast("int")).select("__tally_site", "__tally_at", "salt", F.explode(url_keys(F.col("__tally_site"))).alias("k")).select("__tally_site", "__tally_at", "salt", "k.*")
    spans = validity_intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = asked.join(spans, ["kind", "pattern", "salt"]).filter((F.col("valid_from") <= F.col("__tally_at")) & (F.col("valid_to").isNull() | (F.col("__tally_at") < F.col("valid_to"))))
    best = F.max_by(F.struct("action", "list", "pattern"), F.struct(F.col("rank"), F.col("valid_from"), F.col("list"), F.col("action")))
    found = met.groupBy("__tally_site", "__tally_at").agg(best.alias("__tally_m"), F.count("*").alias("__tally_n"))
    out = keyed.join(found, ["__tally_site", "__tally_at"], "left")
    m = F.col("__tally_m")
    return out.select(
        *[col(x) for x in c.columns],
        F.coalesce(m["action"], F.lit("allow")).alias("verdict"),
        m["list"].alias("matched_list"),
        m["pattern"].alias("matched_pattern"),
        F.coalesce("__tally_n", F.lit(0)).cast("long").alias("n_active"),
    )
