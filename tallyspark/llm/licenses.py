"""Licence scans: canonical texts hashed and joined to the digests of known licences."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, maybe_broadcast, row_key, written

#: The texts that stewards publish, one file a licence, named by its identifier.
TEXTS = Path(__file__).parent / "licences"
#: How notices name licences.
NAMES = [
    ("MIT", "MIT License"), ("MIT", "MIT license"), ("ISC", "ISC License"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache-2.0 license"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("MPL-2.0", "Mozilla Public License, version 2.0"), ("MPL-2.0", "Mozilla Public License 2.0"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("Unlicense", "Unlicense"), ("Zlib", "zlib License"),
    ("GPL-2.0", "GNU General Public License, version 2"), ("GPL-2.0", "GNU General Public License v2.0"), ("GPL-3.0", "GNU General Public License, version 3"), ("GPL-3.0", "GNU General Public License v3.0"), ("AGPL-3.0", "GNU Affero General Public License, version 3"), ("AGPL-3.0", "GNU Affero General Public License v3.0"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"), ("LGPL-3.0", "GNU Lesser General Public License, version 3"), ("CC0-1.0", "CC0 1.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"), ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
]
#: The wordings of a notice of one line.
WORDINGS = [
    "Licensed under the {}.", "Licensed under {}.", "Licensed under a {}.", "Released under the {}.", "Released under {}.", "Distributed under the {}.", "Available under the {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "This work is licensed under a {}.",
    "This project is licensed under the {}.", "This software is licensed under the {}.", "This software is released under the {}.", "This file is licensed under the {}.", "This program is licensed under the {}.", "{}.", "License: {}.",
]
#: Fixed value: the notice that the Apache licence asks for in each file.
APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n"
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
#: Spellings that mean the same, (pattern, replacement), over lower-case text.
EQUIVALENT = [
    ("licence", "license"), ("sub-license", "sublicense"), ("merchantibility", "merchantability"), ("non-infringement", "noninfringement"),
    ("organisation", "organization"), ("authorisation", "authorization"), ("favour", "favor"), ("per cent", "percent"), ("https://", "http://"), ("&", " and "),
]

_COPYRIGHT = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*"
_PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F©«»‘’“”–—…]+"
#: Heads up to which lines are sifted by them.
MOST_HEADS = 200


def known_texts() -> list[tuple[str, str]]:
    """(license, text): whole licences, with and without their title line, and notices of one line."""
    out = [("Apache-2.0", APACHE_NOTICE), *((k, w.format(name)) for k, name in NAMES for w in WORDINGS)]
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text()
        title, _, body = text.partition("\n\n")
        out += [(path.stem, text), *([(path.stem, body)] if "\n" not in title.strip() and body.count(" ") > 50 else [])]
    return out


def canonical(text: Column) -> Column:
    """Lower case, copyright lines out, equivalent spellings made one, punctuation and white space to one space."""
    c = F.regexp_replace(F.lower(text), _COPYRIGHT, "$1")
    for a, b in EQUIVALENT:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, _PUNCTUATION, " "))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical text; null for null or if nothing is left."""
    c = F.nullif(canonical(text), F.lit(""))
    return F.sha2(c.cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license, digest, head) of known texts, without repeats; head: the first letters or digits of the canonical text, three at most."""
    head = F.regexp_extract(canonical(F.col("text")), "^[a-z0-9]{0,3}", 0)
    return spark.createDataFrame(known_texts() if known is None else known, "license string, text string").select("license", digest(F.col("text")).alias("digest"), head.alias("head")).distinct()


def may_be_known(line: Column, heads: list[str]) -> Column:
    """Whether a line's canonical form can begin with one of the heads.

    Equivalent spellings agree in their first three letters, but for `&`; a letter beyond ASCII may fold
    to any. Lines with either stay in, so none is lost.
    """
    if not heads or "" in heads or len(heads) > MOST_HEADS:
        return F.lit(True)
    return line.rlike(r"^[\x00-\x25\x27-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*(?:&|[^\x00-\x7F]|(?i:" + "|".join(map(re.escape, heads)) + "))")


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with digest, license, n_notices and notices.

    digest: of the whole canonical text; license: the known licence with that digest (smallest name if
    several). notices: known licences that a line by itself is, sorted; n_notices: how many lines.
    Null text, and text of which nothing is left, have neither. `known` has license and digest, and head
    if lines are to be sifted by it. Rows that repeat give equal rows; other columns, of any name but those
    four, pass through. Very long texts are read whole.
    """
    d = docs.drop("digest", "license", "n_notices", "notices")
    heads = sorted(r["head"] or "" for r in known.filter("digest IS NOT NULL").select("head").distinct().limit(MOST_HEADS + 1).collect()) if "head" in known.columns else []
    listed = maybe_broadcast(written(known.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("license").alias("license")), "known"))
    key = row_key(col(id_col), col(text_col))
    lines = docs.select(col(id_col).alias("__tally_id"), key.alias("__tally_key"), F.posexplode(F.split(col(text_col), "\n", -1)).alias("pos", "line")).filter(may_be_known(F.col("line"), heads))
    hits = lines.select("__tally_id", "__tally_key", "pos", digest(F.col("line")).alias("digest")).join(listed, "digest")
    found = hits.groupBy("__tally_id", "__tally_key").agg(F.count_distinct("pos").alias("__tally_n"), F.array_sort(F.collect_set("license")).alias("__tally_names"))
    found = maybe_broadcast(written(found, "notices"))
    out = d.withColumn("__tally_digest", digest(col(text_col))).withColumn("__tally_k", key)
    out = out.join(listed.select(F.col("digest").alias("__tally_d"), F.col("license").alias("__tally_license")), F.col("__tally_digest") == F.col("__tally_d"), "left")
    out = out.join(found, (F.col("__tally_k") == F.col("__tally_key")) & col(id_col).eqNullSafe(F.col("__tally_id")), "left")
    return out.select(
        *[col(c) for c in d.columns], F.col("__tally_digest").alias("digest"), F.col("__tally_license").alias("license"),
        F.coalesce("__tally_n", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("__tally_names", F.array().cast("array<string>")).alias("notices"))
