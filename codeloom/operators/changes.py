"""Change impact: which nodes, flows and groups a change touches.

Overlap joins are equi-joins on the file (here: owner); inside a file intervals meet by
buckets of lines, so that a long file costs its overlaps and not its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.ids import is_outside
from codeloom.functions.materialize import cut
from codeloom.functions.scalars import fnv1a, percent

from .iterate import components

#: Kinds that are no code blocks, and edges that make two changed modules one change.
NO_BLOCKS = ("package", "module")
CONNECTING = ("imports", "calls", "instantiates", "renders", "extends", "implements")
#: Widths of the buckets of lines; an interval is put into the smallest that is longer than it.
WIDTHS = tuple(64 << (4 * k) for k in range(8))


def _level(a: Column, b: Column) -> Column:
    out = F.lit(len(WIDTHS) - 1)
    for k in reversed(range(len(WIDTHS) - 1)):
        out = F.when(b - a < WIDTHS[k], F.lit(k)).otherwise(out)
    return out


def overlaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of rows of one key whose intervals [a, b] meet; columns of left, then of right with the prefix r_.

    Each interval lies in one or two buckets of its own level, whatever its length, and
    of every higher level that the other side has. A pair meets on the level of the
    longer of the two, in the bucket where the later begins, so no pair comes twice.
    """
    on_level = lambda df: df.withColumn("_own", _level(F.col("a"), F.col("b")))
    left, right = on_level(left), on_level(right)
    has = [{r["_own"] for r in df.select("_own").distinct().collect()} for df in (left, right)]  # eight levels at most

    def cells(df, levels):
        widths = F.array(*[F.lit(w) for w in WIDTHS])
        upper = F.filter(F.array(*[F.lit(k) for k in sorted(levels)]).cast("array<int>"), lambda k: k > F.col("_own"))
        placed = df.withColumn("_level", F.explode(F.concat(F.array("_own"), upper)))
        wide = F.element_at(widths, F.col("_level") + 1)
        return placed.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("a") / wide), F.floor(F.col("b") / wide))))

    mine, other = cells(left, has[1]), cells(right, has[0])
    other = other.select([F.col(c).alias(f"r_{c}") if c not in (key, "_level", "_cell") else F.col(c) for c in other.columns])
    met = mine.join(other, [key, "_level", "_cell"]).filter("a <= r_b AND r_a <= b AND _level = greatest(_own, r__own)")
    wide = F.element_at(F.array(*[F.lit(w) for w in WIDTHS]), F.col("_level") + 1)
    return met.filter(F.floor(F.greatest("a", "r_a") / wide) == F.col("_cell")).drop("_level", "_cell", "_own", "r__own")


def islands(spans: DataFrame, key: str, gap: int = 0) -> DataFrame:
    """Merged intervals of each key: those that overlap, touch or lie ``gap`` apart become one, with how many they were.

    For spans of whole lines the gap is 1, as lines 5 and 6 have nothing between them.
    """
    before = W.partitionBy(key).orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max("b").over(before)
    fresh = F.when(reach.isNull() | (F.col("a") > reach + gap), 1).otherwise(0)
    upto = W.partitionBy(key).orderBy("a", "b").rowsBetween(W.unboundedPreceding, 0)
    numbered = spans.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(upto))
    return numbered.groupBy(key, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n"))


def union_length(spans: DataFrame, key: str) -> DataFrame:
    """The length that the intervals of each key cover together."""
    return islands(spans, key).groupBy(key).agg(F.sum(F.col("b") - F.col("a")).alias("length"), F.count("*").alias("islands"))


def not_covered(hunks: DataFrame, children: DataFrame, key: str, gap: int = 1) -> DataFrame:
    """Hunks that are not inside one merged island of children: the parent's own lines changed."""
    inside = overlaps(hunks, islands(children, key, gap), key).filter("r_a <= a AND b <= r_b")
    return hunks.join(inside.select(key, "a", "b").distinct(), [key, "a", "b"], "left_anti")


def affected_nodes(nodes: DataFrame, files: DataFrame, hunks: DataFrame) -> DataFrame:
    """id, file, status and by_hunk of what a change touches, in order of file and id.

    nodes: id, kind, parent_id, file, a, b; files: file, status, has_hunks; hunks: file,
    a, b. A node without children is touched by any hunk that meets its lines, one with
    children only where a line of the hunk lies in none of them. Packages and modules are
    no blocks: a module stands for its file where the file has no hunks, or where its
    hunks touch no block.
    """
    placed = nodes.join(files, "file")
    lines = placed.filter("has_hunks").filter(~F.col("kind").isin(*NO_BLOCKS) & ~is_outside(F.col("id"))).select("id", "file", "status", "a", F.coalesce("b", "a").alias("b"))
    met = overlaps(lines, hunks.select("file", "a", "b"), "file")
    met = met.select("id", "file", "status", F.greatest("a", "r_a").alias("a"), F.least("b", "r_b").alias("b"))
    children = nodes.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id"), "a", F.coalesce("b", "a").alias("b"))
    touched = not_covered(met, children, "id").select("id", "file", "status").distinct().withColumn("by_hunk", F.lit(True))
    modules = placed.filter("kind = 'module'").select("id", "file", "status").join(touched.select("file"), "file", "left_anti")
    return touched.unionByName(modules.select("id", "file", "status", F.lit(False).alias("by_hunk"))).select("id", "file", "status", "by_hunk").orderBy("file", "id")


def changed_tags(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """nodes with is_changed: declarations that a range (file, a, b) meets, and the modules of changed files in which none does."""
    files = ranges.select("file").distinct()
    own = nodes.filter(~F.col("kind").isin(*NO_BLOCKS)).select("id", "file", "a", F.coalesce("b", "a").alias("b"))
    met = overlaps(own, ranges.select("file", "a", "b"), "file").select("id", "file").distinct()
    alone = nodes.filter("kind = 'module'").select("id", "file").join(files, "file", "left_semi").join(met.select("file"), "file", "left_anti")
    tagged = met.unionByName(alone).select("id").distinct().withColumn("is_changed", F.lit(True))
    return nodes.join(tagged, "id", "left").withColumn("is_changed", F.coalesce("is_changed", F.lit(False)))


def changed_lines(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, line, kind) of the changed lines within each node; spans: file, a, b, kind. Deleted beats modified, modified beats added."""
    met = overlaps(nodes.select("id", "file", "a", F.coalesce("b", "a").alias("b")), spans.select("file", "a", "b", "kind"), "file")
    rank = F.when(F.col("r_kind") == "deleted", 2).when(F.col("r_kind") == "modified", 1).otherwise(0)
    lines = met.select("id", rank.alias("rank"), F.explode(F.sequence(F.greatest("a", "r_a"), F.least("b", "r_b"))).alias("line"))
    name = F.element_at(F.array(F.lit("added"), F.lit("modified"), F.lit("deleted")), F.col("rank") + 1)
    return lines.groupBy("id", "line").agg(F.max("rank").alias("rank")).select("id", "line", name.alias("kind"))


def unmapped(files: DataFrame, affected: DataFrame, key: str) -> DataFrame:
    return files.join(affected.select(key).distinct(), key, "left_anti")


def affected_flows(calls: DataFrame, changed: DataFrame) -> DataFrame:
    """Flows (flow, target) that call a changed id, with how many of their distinct targets changed."""
    met = calls.join(changed.select(F.col("id").alias("target")), "target", "left_semi")
    return met.groupBy("flow").agg(F.count_distinct("target").alias("changed_targets"))


def flow_impact(flows: DataFrame, calls: DataFrame, nodes: DataFrame, affected: DataFrame, whole: DataFrame | None = None, uses: DataFrame | None = None) -> DataFrame:
    """flow, owner_file, owner_changed and files_hit of flows that changed or that surely call what changed.

    flows: flow (the owner's id); calls: flow, target, resolution; nodes: id, kind, file,
    a; affected: id. Where many flows call the same targets, uses (flow, via) tells what a
    flow goes by and calls has via in the place of flow, so that no call is written out. In files that changed as a whole (whole: file) every block counts.
    Those whose owner changed come first, then by file, line and id, without a file last.
    """
    changed = affected.select("id")
    if whole is not None:
        blocks = nodes.filter(~F.col("kind").isin(*NO_BLOCKS) & ~is_outside(F.col("id")))
        changed = changed.unionByName(blocks.join(whole.select("file"), "file", "left_semi").select("id"))
    changed = changed.distinct()
    files = nodes.filter(~is_outside(F.col("id")) & (F.col("kind") != "package")).select("id", F.col("file").alias("hit"))
    hits = calls.filter("resolution = 'resolved'").join(changed.select(F.col("id").alias("target")), "target", "left_semi")
    hits = hits.join(files.withColumnRenamed("id", "target"), "target").groupBy("flow" if uses is None else "via").agg(F.array_sort(F.collect_set("hit")).alias("files_hit"))
    if uses is not None:
        hits = uses.select("flow", "via").distinct().join(hits, "via").groupBy("flow").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("files_hit")))).alias("files_hit"))
    owners = nodes.select(F.col("id").alias("flow"), F.when(~is_outside(F.col("id")) & (F.col("kind") != "package"), F.col("file")).alias("owner_file"), F.col("a").alias("_line"))
    own = changed.select(F.col("id").alias("flow"), F.lit(True).alias("owner_changed"))
    met = flows.select("flow").distinct().join(own, "flow", "left").join(hits, "flow", "left").filter("owner_changed OR files_hit IS NOT NULL").join(owners, "flow", "left")
    told = met.withColumn("owner_changed", F.coalesce("owner_changed", F.lit(False))).withColumn("files_hit", F.coalesce("files_hit", F.array().cast("array<string>")))
    return told.orderBy(F.desc("owner_changed"), F.asc_nulls_last("owner_file"), F.asc_nulls_last("_line"), "flow").select("flow", "owner_file", "owner_changed", "files_hit")


def change_groups(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, group): changed nodes that edges between changed nodes connect; unchanged neighbours join nothing."""
    changed = cut(changed.select("id").distinct())
    here = lambda end: changed.select(F.col("id").alias(end))
    own = edges.join(here("source"), "source", "left_semi").join(here("target"), "target", "left_semi")
    return components(changed, own).select("id", F.col("root").alias("group"))


def module_change_groups(modules: DataFrame, edges: DataFrame, near: DataFrame) -> DataFrame:
    """(id, file, group) of changed modules (id, file), joined by resolved edges of connecting kinds below them (near: id, near)."""
    kinds = F.col("kind").isin(*CONNECTING) & (F.coalesce("resolution", F.lit("resolved")) == "resolved")
    of = lambda end: near.select(F.col("id").alias(end), F.col("near").alias(f"m{end}"))
    lifted = edges.filter(kinds).join(of("source"), "source").join(of("target"), "target").select(F.col("msource").alias("source"), F.col("mtarget").alias("target"))
    return change_groups(modules.select("id"), lifted.filter("source <> target").distinct()).join(modules.select("id", "file"), "id")


def _shared_start(low: Column, high: Column) -> Column:
    """The segments that the first and the last of some sorted arrays begin with: all between begin with them too."""
    same = F.zip_with(low, high, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    n = F.least(F.size(low), F.size(high))
    return F.slice(low, F.lit(1), F.when(first > 0, F.least(first.cast("int") - 1, n)).otherwise(n))


def group_labels(members: DataFrame) -> DataFrame:
    """("group", label, n_files, id) of groups of files (group, file).

    One file is told by its name; more by their common folder, unless that is empty or
    the one that all files share: then by up to three of the folders below it. The id is
    a hash of the sorted files.
    """
    folder = F.expr("slice(split(file, '/'), 1, size(split(file, '/')) - 1)")
    rows = members.select("group", "file").distinct().withColumn("_dir", folder).withColumn("_name", F.substring_index("file", "/", -1))
    span = lambda: (F.min("_dir").alias("lo"), F.max("_dir").alias("hi"))
    root = rows.agg(*span()).select(_shared_start(F.col("lo"), F.col("hi")).alias("root"))
    told = rows.groupBy("group").agg(*span(), F.count("*").alias("n_files"), F.min("_name").alias("name"), fnv1a(F.array_join(F.array_sort(F.collect_list("file")), "\n")).alias("id"))
    told = told.withColumn("dir", _shared_start(F.col("lo"), F.col("hi"))).join(F.broadcast(root))
    below = rows.join(F.broadcast(root)).select("group", F.when(F.size("_dir") > F.size("root"), F.get("_dir", F.size("root"))).otherwise(F.col("_name")).alias("part")).distinct()
    ranked = below.withColumn("_rank", F.row_number().over(W.partitionBy("group").orderBy("part"))).filter("_rank <= 4")
    parts = ranked.groupBy("group").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    joined = F.concat(F.array_join(F.slice("parts", 1, 3), "+"), F.when(F.size("parts") > 3, "+…").otherwise(""))
    label = F.when(F.col("n_files") == 1, F.col("name")).when((F.size("dir") > 0) & (F.col("dir") != F.col("root")), F.array_join("dir", "/")).otherwise(joined)
    return told.join(parts, "group").select("group", label.alias("label"), "n_files", "id")


def suffix_match(files: DataFrame, modules: DataFrame) -> DataFrame:
    """file, status and module (an id): the module of just that path, else of that path without leading ./, else of the longest path that ends it.

    files: file; modules: module (a path) and, where paths repeat, id. A file is keyed by
    each of its ends, so the match is an equi-join. Several modules that match equally
    well make a file ambiguous.
    """
    bare = lambda c: F.regexp_replace(c, r"^(\./)+", "")
    known = modules if "id" in modules.columns else modules.withColumn("id", F.col("module"))
    known = known.select("id", F.col("module").alias("raw"), bare("module").alias("path"))
    parts = F.split("_file", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    asked = files.select("file", bare("file").alias("_file")).distinct().select("file", "_file", F.explode(ends).alias("path"))
    fit = F.when(F.col("raw") == F.col("_file"), F.lit(1 << 30)).when(F.col("path") == F.col("_file"), F.lit(1 << 29)).otherwise(F.length("path"))
    met = asked.join(known, "path").withColumn("fit", fit)
    best = met.groupBy("file").agg(F.max("fit").alias("fit"))
    won = met.join(best, ["file", "fit"]).groupBy("file").agg(F.count_distinct("id").alias("n"), F.min("id").alias("module"))
    status = F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("unmatched")
    return files.select("file").distinct().join(won, "file", "left").select("file", status.alias("status"), F.when(F.col("n") == 1, F.col("module")).alias("module"))


def blast_radius(edges: DataFrame, changed: DataFrame, file_of: Column) -> DataFrame:
    """Per changed file, the distinct unchanged files that call into it."""
    rows = edges.select(file_of.alias("caller"), F.regexp_replace("target", "#.*$", "").alias("file"))
    hit = rows.join(changed.select("file"), "file", "left_semi")
    outside = hit.join(changed.select(F.col("file").alias("caller")), "caller", "left_anti")
    return outside.groupBy("file").agg(F.count_distinct("caller").alias("callers"))


def surviving_callers(edges: DataFrame, deleted: DataFrame, cap: int = 5) -> DataFrame:
    """For each deleted id, its callers that stay: their number and the first ``cap`` of them."""
    left = edges.join(deleted.select(F.col("id").alias("target")), "target", "left_semi").join(deleted.select(F.col("id").alias("source")), "source", "left_anti")
    rank = F.row_number().over(W.partitionBy("target").orderBy("source"))
    some = left.select("source", "target").distinct().withColumn("rn", rank)
    return some.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("callers"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("rn") <= cap, F.col("source")))), ",").alias("shown"))


def line_kinds(runs: DataFrame) -> DataFrame:
    """Kinds of added lines: in each run the first min(added, deleted) are modified, the rest added."""
    place = F.row_number().over(W.partitionBy("run").orderBy("line"))
    return runs.withColumn("kind", F.when(place <= F.col("deleted"), "modified").otherwise("added"))


def version_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Counts of keys by what became of them between two versions."""
    a, b = old.select(key, F.col(value).alias("before")), new.select(key, F.col(value).alias("after"))
    both = a.join(b, key, "full_outer")
    state = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").when(F.col("before") == F.col("after"), "unchanged").otherwise("changed")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def counter_coverage(rows: DataFrame, groups: list[str], counters: list[str]) -> DataFrame:
    """Per group and counter: rows with hits, rows in all and the whole percentage."""
    long = rows.select(*groups, F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("hits")) for c in counters])).alias("c")).select(*groups, "c.*")
    hit = F.count_if(F.col("hits") > 0)
    return long.groupBy(*groups, "counter").agg(hit.alias("hit"), F.count("*").alias("total"), percent(hit, F.count("*")).alias("percent"))
