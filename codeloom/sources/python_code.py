"""Python source files as nodes and call occurrences; nothing of the source is run.

Files are read by Spark and parsed in its tasks, one at a time; names are resolved
afterwards by joins over the whole corpus. Folders are packages. Spark lists no files
whose names begin with an underscore, so what ``__init__`` files define is not seen.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "file string, what string, id string, kind string, parent_id string, name string, line int, end_line int, col int, message string"


def _parsed(file: str, module: str, text: str) -> list[tuple]:
    """Definitions, calls, bases and imports of one file; a file that doesn't parse gives one diagnostic."""
    root = f"py:{module}"
    rows = [(file, "node", root, "module", f"py:{module.rpartition('/')[0]}" if "/" in module else None, module.rpartition("/")[2], 1, text.count("\n") + 1, 0, None)]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as error:
        return [*rows, (file, "diagnostic", root, "syntax", None, None, getattr(error, "lineno", None) or 0, 0, 0, str(error))]
    todo = [(tree, root, False)]
    while todo:
        at, owner, in_class = todo.pop()
        for child in ast.iter_child_nodes(at):
            here, inner = owner, in_class
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                cls = isinstance(child, ast.ClassDef)
                here, inner = f"{owner}{'.' if '#' in owner else '#'}{child.name}", cls
                kind = "class" if cls else "method" if in_class else "function"
                rows.append((file, "node", here, kind, owner, child.name, child.lineno, child.end_lineno, child.col_offset, None))
                bases = child.bases if cls else []
                rows += [(file, "edge", here, "extends", None, ast.unparse(b), b.lineno, b.end_lineno, b.col_offset, None) for b in bases]
            elif isinstance(child, ast.Call):
                rows.append((file, "edge", owner, "calls", None, ast.unparse(child.func), child.lineno, child.end_lineno, child.col_offset, None))
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                source = "." * getattr(child, "level", 0) + (getattr(child, "module", None) or "")
                names = [f"{source}.{a.name}".strip(".") if source else a.name for a in child.names]
                rows += [(file, "edge", owner, "imports", None, n, child.lineno, child.end_lineno, child.col_offset, None) for n in names]
            todo.append((child, here, inner))
    return rows


def parse(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all .py files below path (see ROWS): nodes, occurrences of edges with the target's written name, diagnostics."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", True).load(path)
    relative = F.substring_index("path", path.rstrip("/") + "/", -1)
    module = F.regexp_replace(relative, r"\.py$", "")
    rows = files.select(relative.alias("file"), module.alias("module"), "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ROWS.split(", ")]
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                yield pd.DataFrame(_parsed(r.file, r.module, bytes(r.content).decode("utf-8", "replace")), columns=names)

    parts = F.split("module", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    folders = rows.filter(F.size(parts) > 1).select(F.explode(above).alias("folder")).distinct()
    parent = F.when(F.col("folder").contains("/"), F.concat(F.lit("py:"), F.regexp_replace("folder", "/[^/]*$", "")))
    packages = folders.select(
        F.col("folder").alias("file"), F.lit("node").alias("what"), F.concat(F.lit("py:"), "folder").alias("id"), F.lit("package").alias("kind"), parent.alias("parent_id"),
        F.substring_index("folder", "/", -1).alias("name"), *[F.lit(0).alias(c) for c in ("line", "end_line", "col")], F.lit(None).cast("string").alias("message"),
    )
    return rows.mapInPandas(run, ROWS).unionByName(packages)


def resolved(rows: DataFrame) -> DataFrame:
    """(kind, source, target, resolution, file, line, col): written names met with definitions.

    A name of the own module wins, then a definition whose last name is unique in the
    corpus; a call of a class instantiates it; other names stay unresolved.
    """
    defined = rows.filter("what = 'node' AND kind <> 'module'").select("id", F.col("kind").alias("def_kind"), F.col("file").alias("def_file"), F.col("name").alias("last"))
    used = rows.filter("what = 'edge' AND kind <> 'imports'").withColumn("last", F.substring_index("name", ".", -1)).withColumnRenamed("id", "source")
    local = defined.groupBy(F.col("def_file").alias("file"), "last").agg(F.min("id").alias("here"), F.min_by("def_kind", "id").alias("here_kind"))
    sole = defined.groupBy("last").agg(F.count("*").alias("n"), F.min("id").alias("there"), F.min("def_kind").alias("there_kind")).filter("n = 1").drop("n")
    met = used.join(local, ["file", "last"], "left").join(sole, "last", "left")
    target, target_kind = F.coalesce("here", "there"), F.coalesce("here_kind", "there_kind")
    kind = F.when((F.col("kind") == "calls") & (target_kind == "class"), "instantiates").otherwise(F.col("kind"))
    return met.select(
        kind.alias("kind"), "source", F.coalesce(target, F.lit("unresolved:py/?")).alias("target"), F.when(target.isNotNull(), "resolved").otherwise("unresolved").alias("resolution"), "file", "line", "col"
    )
