"""Tables kept in parts, each by the version that last wrote it, with a manifest for each version."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _files(spark: SparkSession, path: str):
    """(the Hadoop classes, the file system of a path, the path)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    return hadoop, root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions named under a path, the last first: one listing."""
    _, fs, root = _files(spark, path)
    if not fs.exists(root):
        return []
    return sorted((int(s.getPath().getName().split("=")[1].removesuffix(".json")) for s in fs.listStatus(root) if s.getPath().getName().startswith("v=")), reverse=True)


def last_done(spark: SparkSession, path: str) -> int | None:
    """The last version of a table under a path that was written to its end."""
    hadoop, fs, root = _files(spark, path)
    return next((v for v in versions(spark, path) if fs.exists(hadoop.Path(root, f"v={v}/_SUCCESS"))), None)


def read_manifest(spark: SparkSession, root: str, name: str, before: int | None = None) -> dict | None:
    """{"parts": {part: version that holds it}, "schema": ..} of a table's last version (below `before`), or None."""
    path = f"{root}/{name}/manifest"
    version = next((v for v in versions(spark, path) if before is None or v < before), None)
    if version is None:
        return None
    hadoop, fs, file = _files(spark, f"{path}/v={version}.json")
    stream = fs.open(file)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_manifest(spark: SparkSession, root: str, name: str, version: int, parts: dict[str, int], schema: str, **more: str | dict | None) -> None:
    """Puts a version in force, with what `more` there is to say of it: written aside, then renamed, so it is there whole or not at all."""
    hadoop, fs, file = _files(spark, f"{root}/{name}/manifest/v={version}.json")
    aside = hadoop.Path(f"{root}/{name}/manifest/_v={version}.json")
    stream = fs.create(aside, True)
    stream.write(bytearray(json.dumps({"parts": parts, "schema": schema, **more}).encode()))
    stream.close()
    fs.delete(file, False)  # that of the same batch, run before
    fs.rename(aside, file)


def latest_days(spark: SparkSession, root: str, name: str, before: int | None = None) -> dict[str, int]:
    """For each day of a table the version that holds it."""
    m = read_manifest(spark, root, name, before)
    return m["parts"] if m else {}


def read_parts(spark: SparkSession, root: str, name: str, before: int | None = None, only: set[str] | None = None) -> DataFrame | None:
    """The rows of a table as of its last version (below `before`) in its parts, or `only` some: one scan of their folders. None without a version.

    Of a folder that parts share, those of its rows are read whose part is asked for and still in force there.
    """
    m = read_manifest(spark, root, name, before)
    if m is None:
        return None
    schema = T.StructType.fromJson(json.loads(m["schema"]))
    folders, shared = m.get("folders") or {}, m.get("shared") or {}
    asked: dict[str, list[str]] = {}
    for p, v in m["parts"].items():
        if only is None or p in only:
            asked.setdefault(f"v={v}/part={folders.get(p, p)}", []).append(f"{v}/{p}")
    if not asked:
        return spark.createDataFrame([], schema)
    some = {f for f, rows in asked.items() if len(rows) < shared.get(f, 1)}
    paths = lambda fs: [f"{root}/{name}/data/{f}" for f in sorted(fs)]
    whole = spark.read.schema(schema).parquet(*paths(asked.keys() - some)) if len(some) < len(asked) else None
    if not some:
        return whole
    marked = spark.read.schema(T.StructType([*schema, T.StructField(MARK, T.StringType())])).parquet(*paths(some))
    picked = marked.filter(F.col(MARK).isin([r for f in some for r in asked[f]])).drop(MARK)
    return picked if whole is None else whole.unionByName(picked)


def read_table(spark: SparkSession, root: str, name: str, before: int | None = None) -> DataFrame | None:
    """A derived table as of its last version (below `before`), or None."""
    return read_parts(spark, root, name, before)


#: A version has no more folders than this, and about this many rows a file.
FOLDERS = 256
FILE_ROWS = 500_000
#: In folders that parts share: the version and part of a row.
MARK = "__tally_part"


def part_sizes(rows: DataFrame) -> dict[str, int]:
    """How many rows each part has."""
    return {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}


def write_parts(spark: SparkSession, root: str, name: str, version: int, rows: DataFrame, touched: set[str] | None, sizes: dict[str, int] | None = None) -> None:
    """Writes `rows`, which have a column `part`, as the whole of the `touched` parts (None: of the table), and the manifest.

    Each part has a folder, up to FOLDERS; of more, neighbours share one, so a version's files follow its rows and not its parts.
    `sizes`: the rows known of parts, where the caller has counted them; all parts of `rows` must be in it or in `touched`.
    """
    path = f"{root}/{name}/data/v={version}"
    if sizes is None:
        sizes = part_sizes(rows) if touched is None else {}
    parts = sorted(sizes.keys() | (touched or set()))
    step = max(1, -(-len(parts) // FOLDERS))
    folder = {p: parts[i - i % step] for i, p in enumerate(parts)}
    held: dict[str, int] = {}
    for p, f in folder.items():
        held[f] = held.get(f, 0) + sizes.get(p, 0)
    least = max(1, min(8, 128 // max(1, len(held))))
    files = {f: max(least, min(64, -(-n // FILE_ROWS))) for f, n in held.items()}
    columns = [c for c in rows.columns if c != "part"]
    # One row a part, all known here. The number of tasks is given, or Spark would merge small parts into one task that writes all files.
    plan = F.broadcast(spark.createDataFrame([(p, f, files[f]) for p, f in folder.items()], "part string, _folder string, _files int").coalesce(1))
    x = rows.join(plan, "part", "left").withColumn("_salt", F.pmod(F.xxhash64(*columns[:2]), F.coalesce("_files", F.lit(1))))
    mark = [F.concat(F.lit(f"{version}/"), "part").alias(MARK)] if step > 1 else []
    x = x.select(*columns, *mark, F.coalesce("_folder", "part").alias("part"), "_salt")
    tasks = max(1, min(sum(files.values()), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    x.repartition(tasks, "part", "_salt").drop("_salt").write.mode("overwrite").partitionBy("part").parquet(path)
    _, fs, base = _files(spark, path)
    there = {n.split("=", 1)[1] for n in (s.getPath().getName() for s in fs.listStatus(base)) if n.startswith("part=")}
    last = (read_manifest(spark, root, name, version) if touched is not None else None) or {"parts": {}}
    now = {p: version for p, f in folder.items() if f in there} | {p: version for p in there if p not in folder}
    old = {p: v for p, v in last["parts"].items() if p not in now and p not in (touched or ())}
    folders = {p: f for p, f in (last.get("folders") or {}).items() if p in old}
    still = {f"v={old[p]}/part={f}" for p, f in folders.items()}
    shared = {f: n for f, n in (last.get("shared") or {}).items() if f in still}
    if step > 1:
        folders |= {p: folder.get(p, p) for p in now}
        for p in now:
            f = f"v={version}/part={folders[p]}"
            shared[f] = shared.get(f, 0) + 1
    write_manifest(spark, root, name, version, old | now, rows.drop("part").schema.json(), folders=folders, shared=shared)
