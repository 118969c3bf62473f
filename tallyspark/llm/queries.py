"""One query for each text operator: (spark, sf_dir) -> DataFrame over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, crf_langid, decontaminate, filter_audit, jaccard_join, licenses, line_dedup, mixing, packing, prefix_trie, simhash, slots, url_filter
from .common import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.known_digests(spark))
    return out.select("doc_id", "digest", "license", "n_notices", F.array_join("notices", ",").alias("notices"))


def op3_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "mix_tokens", F.round("mix_weight", 9).alias("mix_weight"), "mix_epoch", "mix_offset")


def op4_crf_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return crf_langid.identify_documents(docs).select("doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op7_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time made from their id: `pages` has none."""
    return pages.select("page_id", "url", F.expr("date_add(DATE'2024-01-01', CAST(page_id * 37 % 366 AS INT))").alias("fetched_at"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries made from the hosts and paths that `pages` holds, prefixes in the spelling of raw lists."""
    sites = written(pages.select(url_filter.url_site(F.col("url")).alias("site")).filter("site IS NOT NULL").distinct(), "sites")
    hosts = sites.select(F.substring_index("site", "/", 1).alias("host")).distinct()
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int").alias("n")
    labels = F.split("host", r"\.")
    domain = F.when(F.size(labels) > 3, F.array_join(F.slice(labels, F.lit(2), F.size(labels)), ".")).otherwise(F.col("host"))
    rows = written(hosts.select("host", number("host"), domain.alias("domain")), "hosts")
    day = lambda k: F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int")).alias("listed_at")
    n = F.col("n")

    def entry(df, when, name, kind, pattern, action, at):
        return df.filter(when).select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), day(at))

    deep = sites.select(number("site"), F.split("site", "/", -1).alias("parts")).filter(F.size("parts") > 2)
    out = entry(rows, n % 3 == 0, "spam", "domain", F.col("domain"), "block", n % 200)
    for more in (
        entry(rows, n % 6 == 0, "spam", "domain", F.col("domain"), "remove", n % 200 + 60),
        entry(rows, n % 5 == 0, "trusted", "domain", F.col("host"), "allow", n % 300),
        entry(rows, n % 4 == 0, "paths", "prefix", F.concat(F.lit("http://WWW."), F.upper("host"), F.lit("/de/")), "block", n % 150),
        entry(rows, n % 9 == 0, "paths", "prefix", F.concat("domain", F.lit("/fr")), "allow", n % 220),
        entry(deep, n % 7 == 0, "deep", "prefix", F.array_join(F.slice("parts", 1, 3), "/"), "allow", n % 250),
    ):
        out = out.unionByName(more)
    return out


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(captures(pages), dated_entries(pages)).select("page_id", F.col("fetched_at").cast("string").alias("fetched_at"), "verdict", "matched_list", "matched_pattern", "n_active")


def op11_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.shard_documents(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.family_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_brown_lm, op2_license_scan, op3_temperature_mix, op4_crf_langid, op5_simhash, op6_decontaminate, op7_pack_tokens, op8_jaccard_join, op9_line_dedup, op10_url_filter, op11_virtual_slots, op12_filter_audit, op13_prefix_trie)}


_WORDS6 = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS6} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS6} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS win, len(w[i:i + 12]) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hit AS (SELECT DISTINCT doc_id, item_id, i, n FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM spots, sizes WHERE i + n - 1 <= len(w)) JOIN win USING (win, n)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""

OP9_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id <> last_id AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pairs WHERE 100 * c >= 80 * (nx + ny - c)),
reach AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.root),
least AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id),
degree AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links
FROM s JOIN least USING (doc_id) LEFT JOIN degree ON degree.x = s.doc_id"""

OP10_SQL = r"""
WITH u AS (SELECT page_id, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS DATE) AS day, url,
    nullif(regexp_replace(lower(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^(?:[^@]*@)?([^:]*)', 1)), '^www\.|\.$', '', 'g'), '') AS host,
    list_filter(string_split(regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '^([^?#]*)', 1), '/'), lambda x: x <> '') AS segs FROM pages),
p AS (SELECT *, CASE WHEN host IS NOT NULL THEN array_to_string(list_concat([host], segs), '/') END AS site FROM u),
sites AS (SELECT site, any_value(host) AS host, any_value(segs) AS segs FROM p WHERE site IS NOT NULL GROUP BY site),
r AS (SELECT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS n, CASE WHEN len(string_split(host, '.')) > 3 THEN array_to_string(string_split(host, '.')[2:], '.') ELSE host END AS domain FROM (SELECT DISTINCT host FROM sites)),
deep AS (SELECT CAST('0x' || substr(md5(site), 1, 4) AS INTEGER) AS n, host || '/' || segs[1] || '/' || segs[2] AS pattern FROM sites WHERE len(segs) > 1),
e AS (SELECT 'spam' AS list, 'domain' AS kind, domain AS pattern, 'block' AS action, DATE '2024-01-01' + n % 200 AS day FROM r WHERE n % 3 = 0
  UNION ALL SELECT 'spam', 'domain', domain, 'remove', DATE '2024-01-01' + (n % 200 + 60) FROM r WHERE n % 6 = 0
  UNION ALL SELECT 'trusted', 'domain', host, 'allow', DATE '2024-01-01' + n % 300 FROM r WHERE n % 5 = 0
  UNION ALL SELECT 'paths', 'prefix', host || '/de', 'block', DATE '2024-01-01' + n % 150 FROM r WHERE n % 4 = 0
  UNION ALL SELECT 'paths', 'prefix', domain || '/fr', 'allow', DATE '2024-01-01' + n % 220 FROM r WHERE n % 9 = 0
  UNION ALL SELECT 'deep', 'prefix', pattern, 'allow', DATE '2024-01-01' + n % 250 FROM deep WHERE n % 7 = 0),
one AS (SELECT list, kind, pattern, day, max(action) AS action FROM e GROUP BY list, kind, pattern, day),
v AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS until FROM one) WHERE action <> 'remove'),
names AS (SELECT page_id, day, segs, array_to_string(labels[i:], '.') AS name, len(labels) - i + 1 AS size FROM (SELECT page_id, day, segs, string_split(host, '.') AS labels, unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) AS i FROM p WHERE host IS NOT NULL)),
keys AS (SELECT page_id, day, 'domain' AS kind, name AS pattern, -1 AS depth, size FROM names
  UNION ALL SELECT page_id, day, 'prefix', array_to_string(list_concat([name], segs[1:k]), '/'), k, size FROM (SELECT *, unnest(range(0, len(segs) + 1)) AS k FROM names)),
m AS (SELECT page_id, action, list, v.pattern, row_number() OVER (PARTITION BY page_id ORDER BY depth DESC, size DESC, v.day DESC, list DESC, action DESC) AS rn, count(*) OVER (PARTITION BY page_id) AS n
      FROM keys JOIN v ON keys.kind = v.kind AND keys.pattern = v.pattern AND v.day <= keys.day AND (until IS NULL OR keys.day < until))
SELECT p.page_id, CAST(p.day AS VARCHAR) AS fetched_at, coalesce(action, 'allow') AS verdict, list AS matched_list, pattern AS matched_pattern, coalesce(n, 0) AS n_active
FROM p LEFT JOIN m ON p.page_id = m.page_id AND rn = 1"""


OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
first_of AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 2 * length(d.text) THEN 'C' ELSE '' END)
        || (CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN d.doc_id > least THEN 'E' ELSE '' END) AS fails
      FROM d JOIN first_of USING (text) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
p AS (SELECT '' AS o UNION ALL SELECT o || x FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
o AS (SELECT o, unnest(range(1, 6)) AS step FROM p WHERE length(o) = 5),
s AS (SELECT c.*, o.o, step, substr(o.o, CAST(step AS INTEGER), 1) AS me, list_bool_or(list_transform(string_split(substr(o.o, 1, CAST(step AS INTEGER) - 1), ''), lambda x: x <> '' AND contains(fails, x))) AS gone FROM c, o),
r AS (SELECT part, o AS filter_order, step, any_value(me) AS me,
        sum(CASE WHEN NOT coalesce(gone, false) AND NOT contains(fails, me) THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT coalesce(gone, false) AND contains(fails, me) THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN coalesce(gone, false) AND contains(fails, me) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = me THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT coalesce(gone, false) AND contains(fails, me) THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT coalesce(gone, false) AND contains(fails, me) THEN toxic ELSE 0 END) AS toxic_lost
      FROM s GROUP BY part, o, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, me) AS BIGINT) AS shapley
FROM r"""

#: crc32 of a short text in SQL: its bits, eight a character, folded.
_CRC = """list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, x: list_reduce(list_concat([xor(a, x)], [CAST(0 AS BIGINT) for k in range(8)]), lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, CAST(3988292384 AS BIGINT)) ELSE r >> 1 END))"""

OP13_SQL = rf"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS pos, sha256(coalesce(role, '') || chr(31) || coalesce(text, '')) AS turn, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT c, xor({_CRC.format("CAST(c AS VARCHAR)")}, 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT c, 1 AS part, pos, turn, bytes FROM t JOIN i USING (c) WHERE pos > h OR c % 5 = 0
  UNION ALL SELECT i.c, 0, pos, turn, bytes FROM i JOIN t ON t.c = i.c - i.c % 5 WHERE i.c % 5 <> 0 AND pos <= h),
q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, turn, bytes FROM r),
k AS (SELECT c, d, bytes, string_agg(turn, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path, count(*) OVER (PARTITION BY c) AS n FROM q),
m AS (SELECT c, d, bytes, sha256(path) AS node, d = n AS ends, CASE WHEN d = 1 THEN '' ELSE sha256(left(path, -64)) END AS up FROM k
  UNION ALL SELECT i.c, 0, 0, '', NOT EXISTS (SELECT 1 FROM q WHERE q.c = i.c), NULL FROM i),
g AS (SELECT node, any_value(up) AS up, any_value(d) AS d, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ends FROM m GROUP BY node),
ch AS (SELECT up AS node, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY up),
v AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN ch USING (node)),
path AS (SELECT DISTINCT a.node AS top, b.node AS under FROM m a JOIN m b ON a.c = b.c AND b.d >= a.d),
s AS (SELECT top AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM path JOIN v ON v.node = path.under GROUP BY top)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, CAST(v.n_children AS BIGINT) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN s USING (node) LEFT JOIN v u ON u.node = v.up"""


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower({text}), '(^|\\n)[ \\t]*(copyright|\\(c\\)|©)[^\\n]*', '\\1', 'g')"
    for a, b in licenses.EQUIVALENT:
        out = f"replace({out}, '{a}', '{b}')"
    return f"nullif(trim(regexp_replace({out}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+|[©«»‘’“”–—…]+', ' ', 'g')), '')"


def _op2_sql() -> str:
    listed = ", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in licenses.known_texts())
    return f"""
WITH known AS (SELECT digest, min(license) AS license FROM (SELECT license, sha256({_canonical_sql("text")}) AS digest FROM (VALUES {listed}) t(license, text)) GROUP BY digest),
l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
n AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM (SELECT doc_id, pos, sha256({_canonical_sql("line")}) AS digest FROM l) JOIN known USING (digest) GROUP BY doc_id),
d AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents)
SELECT doc_id, digest, license, coalesce(n, 0) AS n_notices, coalesce(names, '') AS notices FROM d LEFT JOIN known USING (digest) LEFT JOIN n USING (doc_id)"""


def oracle_sql() -> dict:
    return {"op2_license_scan": _op2_sql(), "op6_decontaminate": OP6_SQL, "op8_jaccard_join": OP8_SQL, "op9_line_dedup": OP9_SQL, "op10_url_filter": OP10_SQL, "op12_filter_audit": OP12_SQL, "op13_prefix_trie": OP13_SQL}
