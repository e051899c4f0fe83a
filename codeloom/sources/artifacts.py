"""Reading and writing of snapshots: artifact documents, overlays, traces and coverage maps as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SITE = "struct<file: string, line: int, col: int, endLine: int, endCol: int>"
NODE = (
    "struct<id: string, kind: string, qualifiedName: string, displayName: string, summary: string, parentId: string, language: string, "
    "location: struct<file: string, startLine: int, endLine: int, startCol: int>, signature: string, tags: array<string>, "
    "telemetry: struct<codeNamespace: string, codeFunction: string, spanNameHints: array<string>>>"
)
EDGE = f"struct<id: string, source: string, target: string, kind: string, resolution: string, weight: int, callSites: array<{SITE}>, confidence: double>"
HEADER = "schemaVersion string, generatedAt string, generator struct<name: string, version: string>, target struct<name: string, root: string, language: string>"
OVERLAY = "env string, metrics map<string, struct<callCount: bigint, errorRate: double, latencyMs: struct<p50: int, p95: int, p99: int>, sampleCount: bigint>>"
PLACE = "struct<line: int, column: int>"
COVERAGE = (
    f"map<string, struct<path: string, fnMap: map<string, struct<name: string, decl: struct<start: {PLACE}, `end`: {PLACE}>>>, f: map<string, bigint>, "
    f"branchMap: map<string, struct<type: string, line: int>>, b: map<string, array<bigint>>>>"
)


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each artifact document, with the file that it comes from; a malformed one fails the job."""
    schema = f"{HEADER}, nodes array<{NODE}>, edges array<{EDGE}>"
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return read.withColumn("graph_id", F.input_file_name())


def nodes(documents: DataFrame) -> DataFrame:
    """Nodes of all artifacts, with their place (ord) in the document."""
    return documents.select("graph_id", F.posexplode("nodes").alias("ord", "n")).select("graph_id", "ord", "n.*")


def edges(documents: DataFrame) -> DataFrame:
    return documents.select("graph_id", F.posexplode("edges").alias("ord", "e")).select("graph_id", "ord", "e.*")


def overlay(spark: SparkSession, path: str, env: str) -> DataFrame:
    """(node_id, callCount, errorRate, p50, p95, p99, sampleCount) of one environment; another one in the file fails the job."""
    read = spark.read.schema(OVERLAY).option("multiLine", True).option("mode", "FAILFAST").json(path)
    same = F.assert_true(F.col("env") == env, "the overlay is of another environment")
    rows = read.filter(same.isNull()).select(F.explode("metrics").alias("node_id", "m"))
    return rows.select("node_id", "m.callCount", "m.errorRate", "m.latencyMs.*", "m.sampleCount")


def _segments(path: Column) -> Column:
    """The segments of a path, without empty ones and dots; ``..`` takes its folder back where there is one."""
    own = F.filter(F.split(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^[A-Za-z]:(?=/|$)", ""), "/"), lambda x: ~x.isin("", "."))
    back = lambda seen, x: (x == "..") & (F.size(seen) > 0) & (F.element_at(seen, -1) != "..")
    return F.aggregate(own, F.array().cast("array<string>"), lambda seen, x: F.when(back(seen, x), F.slice(seen, 1, F.size(seen) - 1)).otherwise(F.concat(seen, F.array(x))))


def _checked(df: DataFrame, test: Column, message: str) -> DataFrame:
    return df.filter(F.assert_true(test, message).isNull())


def coverage_files(paths: DataFrame, files: DataFrame, root: str | None = None) -> DataFrame:
    """(path, file) of report paths (path) that stand for a file (file) of the graph; root is the folder that files are relative to.

    The path below the root is taken first, else the one file whose whole segments end the
    path; several such files fail the job. Paths with a drive letter match whatever their case.
    """
    absolute, windows = F.col("path").rlike(r"^([A-Za-z]:)?[/\\]|^[A-Za-z]:$"), F.col("path").rlike(r"^[A-Za-z]:([/\\]|$)")
    p = paths.select("path").distinct().select("path", _segments(F.col("path")).alias("s"), absolute.alias("absolute"), windows.alias("windows"))
    p = _checked(p, F.col("absolute") | ~F.array_contains("s", ".."), "a coverage path escapes its relative root")
    p = p.withColumn("s", F.filter("s", lambda x: x != ".."))
    below = _segments(F.lit(root or "/"))
    cased = lambda x: F.when(F.col("windows"), F.lower(x)).otherwise(x)
    at = F.when(~F.col("absolute"), 1).when(cased(F.array_join(F.slice("s", F.lit(1), F.size(below)), "/")) == cased(F.array_join(below, "/")), F.size(below) + 1)
    ends = p.filter(F.size("s") > 0).select("path", "windows", at.alias("at"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.array_join(F.slice("s", i, F.size("s")), "/"))).alias("k", "end"))
    known = files.select("file").distinct()
    known = known.select("file", F.col("file").alias("key"), F.lit(False).alias("windows")).unionByName(known.select("file", F.lower("file").alias("key"), F.lit(True).alias("windows")))
    met = ends.withColumn("key", cased(F.col("end"))).join(known, ["key", "windows"])
    exact = (F.col("k") + 1 == F.col("at")) & (F.col("file") == F.col("end"))
    found = met.groupBy("path").agg(F.min(F.when(exact, F.col("file"))).alias("own"), F.count_distinct("file").alias("n"), F.min("file").alias("one"))
    found = _checked(found, F.col("own").isNotNull() | (F.col("n") == 1), "a coverage path matches several files")
    return found.select("path", F.coalesce("own", "one").alias("file"))


def coverage(spark: SparkSession, path: str, files: DataFrame, root: str | None = None) -> DataFrame:
    """(file, what, key, hits) of function and branch counters in coverage maps, for files (file) of the graph.

    An entry's key and its inner path are matched by :func:`coverage_files`; where they mean
    different files, where two entries mean one, or where counters and their maps name
    different ids or a count is negative, the job fails. Entries without a file are left out.
    """
    text = spark.read.option("wholetext", True).text(path)
    entries = text.select(F.explode(F.from_json("value", COVERAGE)).alias("entry", "c"))
    found = coverage_files(entries.select(F.explode(F.array("entry", F.coalesce("c.path", "entry"))).alias("path")), files, root)
    by_key, by_path = (found.select(F.col("path").alias(k), F.col("file").alias(v)) for k, v in (("entry", "key_file"), ("inner", "path_file")))
    met = entries.withColumn("inner", F.coalesce("c.path", "entry")).join(by_key, "entry", "left").join(by_path, "inner", "left")
    met = _checked(met, F.coalesce(F.col("key_file") == F.col("path_file"), F.lit(True)), "the key and the path of a coverage entry are different files")
    met = met.withColumn("file", F.coalesce("path_file", "key_file")).filter("file IS NOT NULL")
    ids = lambda m: F.array_sort(F.map_keys(m))
    met = _checked(met, (ids("c.f") == ids("c.fnMap")) & (ids("c.b") == ids("c.branchMap")), "counters and their maps name different ids")
    counts = F.concat(F.map_values("c.f"), F.flatten(F.map_values("c.b")))
    met = _checked(met, F.forall(counts, lambda x: F.coalesce(x >= 0, F.lit(False))), "a count is missing or negative")
    twice = met.groupBy("file").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("bad"))
    met = _checked(met.join(F.broadcast(twice)), F.col("bad") == 0, "two coverage entries for one file")
    functions = met.select("file", F.explode("c.f").alias("id", "hits"), "c").select("file", F.lit("function").alias("what"), F.col("c.fnMap")[F.col("id")]["name"].alias("key"), "hits")
    paths = met.select("file", F.explode("c.b").alias("id", "all")).select("file", "id", F.posexplode("all").alias("k", "hits"))
    return functions.unionByName(paths.select("file", F.lit("branch").alias("what"), F.concat_ws(".", "id", "k").alias("key"), "hits"))


def write_snapshot(nodes: DataFrame, edges: DataFrame, base: str, snapshot: str) -> DataFrame:
    """Writes a snapshot's tables below base and returns its manifest row: counts and an order-free digest of each.

    The manifest is written last, so a reader who finds it finds whole tables.
    """
    spark, rows = nodes.sparkSession, []
    for name, df in (("nodes", nodes), ("edges", edges)):
        path = f"{base}/{name}/snapshot={snapshot}"
        df.write.mode("overwrite").parquet(path)
        rows.append((snapshot, name, *_digest(spark.read.parquet(path))))
    manifest = spark.createDataFrame(rows, "snapshot string, table string, rows long, digest string")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest/snapshot={snapshot}")
    return manifest


def read_snapshot(spark: SparkSession, base: str, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of a snapshot; an error where it has no manifest or isn't what the manifest says."""
    told = {r["table"]: (r["rows"], r["digest"]) for r in spark.read.parquet(f"{base}/manifest/snapshot={snapshot}").collect()}  # a row for each table
    found = []
    for name in ("nodes", "edges"):
        df = spark.read.parquet(f"{base}/{name}/snapshot={snapshot}")
        if _digest(df) != told.get(name):
            raise ValueError(f"{name} of snapshot {snapshot} differ from its manifest")
        found.append(df)
    return found[0], found[1]


def _digest(df: DataFrame) -> tuple[int, str]:
    """How many rows a table has, and a digest of them in whatever order."""
    digest = F.sum(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)"))
    one = df.agg(F.count("*").alias("rows"), F.coalesce(digest, F.lit(0)).cast("string").alias("digest")).first()
    return one["rows"], one["digest"]


def report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): counts by kind and resolution, and nodes with a summary."""
    from codeloom.operators.relations import extraction_stats

    told = nodes.agg(F.count_if(F.coalesce(F.col("summary"), F.lit("")) != "").alias("n")).select(F.lit("summary").alias("what"), F.lit("present").alias("kind"), "n")
    return extraction_stats(nodes, edges).unionByName(told)
