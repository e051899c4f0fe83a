"""Which files must be read with some others for module ids to come out as in a whole extraction.

Two relations feed each other: a file draws in the initialisers of all packages above
it, and a module that shares its dotted path with a package draws in what makes that a
package, its initialiser or else the first file below; whatever is drawn in does the
same. Files of one dotted path always come together. All slices are closed at once, in
rounds of one join, until a round adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.materialize import Unsettled, cut, union


def _prefixes(module: str):
    parts = F.split(module, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def identity_needs(topology: DataFrame) -> DataFrame:
    """(module, needs) of dotted paths of topology (path, module): initialisers above, and what makes a package of the same path one."""
    facts = topology.select("path", "module", F.col("path").rlike(r"(^|/)__init__\.py$").alias("is_package"))
    starts = facts.filter("is_package").select("module").distinct()
    nested = facts.filter(F.contains("module", F.lit("."))).select("path", "module", F.explode(_prefixes("module")).alias("prefix"))
    above = nested.select("module", F.col("prefix").alias("needs")).distinct().join(starts.select(F.col("module").alias("needs")), "needs", "left_semi")
    first = nested.groupBy("prefix").agg(F.min_by("module", "path").alias("witness"))
    plain = facts.filter("NOT is_package").select("module").distinct()
    shared = plain.join(starts, "module", "left_anti").join(first, F.col("module") == F.col("prefix")).select("module", F.col("witness").alias("needs"))
    return above.select("module", "needs").unionByName(shared).filter("module <> needs").distinct()


def closed_slices(topology: DataFrame, selected: DataFrame, max_files: int, max_rounds: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """(slice, path) of slices with all their files need, and (slice, reason) of slices refused.

    topology: path, module (of Python files, as their ids say); selected: slice, path. Files
    of other languages count and pass through. A slice that names an unknown Python file, or
    that holds more than max_files when closed, is refused whole rather than cut: reason is
    unknown or large. A slice without package context takes the first file that has some.
    """
    facts = cut(topology.select("path", "module").distinct())
    needs = cut(identity_needs(facts))
    asked = cut(selected.select("slice", "path").distinct())
    python = asked.filter(F.endswith("path", F.lit(".py"))).join(facts, "path", "left")
    unknown = python.filter("module IS NULL").select("slice").distinct()
    context = F.col("path").rlike(r"(^|/)__init__\.py$") | F.contains("module", F.lit("."))
    witness = facts.filter(context).agg(F.min_by("module", "path").alias("module")).filter("module IS NOT NULL")
    flat = python.groupBy("slice").agg(F.bool_or(F.coalesce(context, F.lit(False))).alias("some")).filter("NOT some").select("slice")
    levels = [cut(python.filter("module IS NOT NULL").select("slice", "module").unionByName(flat.crossJoin(F.broadcast(witness))).distinct())]
    for _ in range(max_rounds):
        level = cut(levels[-1].join(needs, "module").select("slice", F.col("needs").alias("module")).distinct().join(union(levels), ["slice", "module"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
    else:
        raise Unsettled(f"slices have not closed within {max_rounds} rounds")
    files = union(levels).join(facts, "module").select("slice", "path").unionByName(asked.filter(~F.endswith("path", F.lit(".py")))).distinct()
    files = cut(files)
    large = files.groupBy("slice").agg(F.count("*").alias("n")).filter(F.col("n") > max_files).select("slice").join(unknown, "slice", "left_anti")
    refused = cut(unknown.withColumn("reason", F.lit("unknown")).unionByName(large.withColumn("reason", F.lit("large"))))
    return files.join(refused, "slice", "left_anti"), refused
