"""Small filters: which nodes and edges a view, a mode or an environment lets through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.ids import parse_node_id
from codeloom.functions.paths import is_test_path

from .changes import suffix_match

#: Edge kinds of the call view and of the tree of rendered components; modes that draw no such edges.
CALL_KINDS = (
    "calls", "instantiates", "extends", "implements", "references", "sends", "handles", "createsPromise", "returnsPromise", "awaitsPromise", "resolvesPromise", "rejectsPromise",
)
RENDER_KIND = "renders"
EDGELESS_MODES = ("logic", "modules", "prs")
#: Kinds and languages of nodes that have no source file.
SOURCELESS_KINDS = ("package", "system", "external", "unresolved", "channel")
SOURCELESS_LANGUAGES = ("sys", "ext", "unresolved", "ipc")
TEST_TAG, CHANGED_TAG = "test", "changed"


def tagged_tests(nodes: DataFrame, file: str = "file", tags: str = "tags") -> DataFrame:
    """nodes, with the tag of tests, once, on those of test files."""
    own = F.coalesce(tags, F.array().cast("array<string>"))
    return nodes.withColumn(tags, F.when(is_test_path(F.col(file)), F.array_union(own, F.array(F.lit(TEST_TAG)))).otherwise(own))


def has_tag(tags: Column, tag: str) -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def changed_ids(nodes: DataFrame) -> DataFrame:
    """(id) of nodes that are tagged as changed themselves; what holds them is not."""
    return nodes.filter(has_tag(F.col("tags"), CHANGED_TAG)).select("id").distinct()


def edges_for_mode(edges: DataFrame, mode: str) -> DataFrame:
    """Edges that a view mode draws."""
    if mode == "ui":
        return edges.filter(F.col("kind") == RENDER_KIND)
    if mode in EDGELESS_MODES:
        return edges.filter(F.lit(False))
    return edges.filter(F.col("kind").isin(*CALL_KINDS))


def is_source_backed(node_id: Column, kind: Column, file: Column) -> Column:
    """Whether a node's file can be read: it is not blank, and neither kind nor language is structural."""
    return (F.btrim(F.coalesce(file, F.lit(""))) != "") & ~kind.isin(*SOURCELESS_KINDS) & ~parse_node_id(node_id)["lang"].isin(*SOURCELESS_LANGUAGES)


def around_deleted(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Calls from and to deleted nodes (id), and references to them."""
    gone = lambda end: deleted.select(F.col("id").alias(end)).distinct().withColumn(f"_{end}", F.lit(True))
    met = edges.filter("kind IN ('calls', 'references')").join(gone("source"), "source", "left").join(gone("target"), "target", "left")
    return met.filter("_target OR kind = 'calls' AND _source").select(*edges.columns)


def visible_wires(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """edges, but implementedBy only from nodes that are visible (id)."""
    rest = edges.filter("kind <> 'implementedBy'")
    shown = edges.filter("kind = 'implementedBy'").join(visible.select(F.col("id").alias("source")), "source", "left_semi")
    return rest.unionByName(shown.select(*edges.columns))


def allows_environment(mode: Column, environments: Column, environment: str) -> Column:
    """Whether a telemetry source may be asked for an environment: it takes any, or names it. There is no default."""
    return F.coalesce(mode == "arbitrary", F.lit(False)) | F.coalesce(F.array_contains(environments, environment), F.lit(False))


def expected_producer(kind: Column) -> Column:
    """The producer that a source's data must name; a saved file keeps its own."""
    return F.when(kind != "file", kind)


def without_tests(nodes: DataFrame, edges: DataFrame, tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without tests (id) and all that touches them."""
    gone = lambda end: tests.select(F.col("id").alias(end))
    return nodes.join(gone("id"), "id", "left_anti"), edges.join(gone("source"), "source", "left_anti").join(gone("target"), "target", "left_anti")


def review_files(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(file, status, module, module_file) of changed files (file, status) that a module (id, module) of the graph stands for.

    Both are read with plain slashes and without a leading slash or ./; the same path
    wins, then the longest path that ends the file's; of modules alike the first id.
    """
    plain = lambda c: F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^\.?/", "")
    one = modules.withColumn("module", plain(F.col("module"))).groupBy("module").agg(F.min("id").alias("id"))
    asked = files.withColumn("_plain", plain(F.col("file")))
    found = suffix_match(asked.select(F.col("_plain").alias("file")), one).filter("status = 'matched'").select(F.col("file").alias("_plain"), F.col("module").alias("id"))
    return asked.join(found, "_plain").join(one.withColumnRenamed("module", "module_file"), "id").select("file", "status", F.col("id").alias("module"), "module_file")
