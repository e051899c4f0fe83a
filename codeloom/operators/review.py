"""Review of a change: patches, comment places, coverage evidence, renamed declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.materialize import Unsettled, cut, union

from .changes import overlaps
from .tree import first_of

HEADER = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def patch_lines(patches: DataFrame) -> DataFrame:
    """(path, hunk, pos, kind, old_line, new_line, text) of the lines of unified diffs (path, patch).

    kind is added, deleted or context; a line that its side lacks has no number there.
    Lines before the first hunk header and notes on missing line ends are skipped.
    """
    lines = patches.select("path", F.posexplode(F.split("patch", "\n")).alias("pos", "line"))
    lines = lines.withColumn("start", F.when(F.col("line").rlike(HEADER), F.struct(*[F.regexp_extract("line", HEADER, k).cast("long").alias(n) for k, n in ((1, "old"), (2, "new"))])))
    upto = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    hunks = lines.withColumn("hunk", F.count("start").over(upto)).withColumn("from", F.last("start", ignorenulls=True).over(upto))
    sign = F.substring("line", 1, 1)
    body = hunks.filter((F.col("hunk") > 0) & F.col("start").isNull() & sign.isin("+", "-", " "))
    before = W.partitionBy("path", "hunk").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    at = lambda side, own: F.when(sign.isin(own, " "), F.col(f"from.{side}") + F.count(F.when(sign.isin(own, " "), 1)).over(before))
    kind = F.when(sign == "+", "added").when(sign == "-", "deleted").otherwise("context")
    return body.select("path", "hunk", "pos", kind.alias("kind"), at("old", "-").alias("old_line"), at("new", "+").alias("new_line"), F.expr("substring(line, 2)").alias("text"))


def changed_ranges(lines: DataFrame) -> DataFrame:
    """(path, hunk, first, last, added, deleted) of every hunk of :func:`patch_lines` on the new side; a pure deletion has the seam line."""
    added = F.when(F.col("kind") == "added", F.col("new_line"))
    return lines.groupBy("path", "hunk").agg(
        F.min(added).alias("first"), F.max(added).alias("last"), F.count_if(F.col("kind") == "added").alias("added"), F.count_if(F.col("kind") == "deleted").alias("deleted")
    )


def name_status(manifests: DataFrame) -> DataFrame:
    """(path, status, previous) of NUL-separated status manifests (body): A, D, M or T with a path, R with a score and two paths."""
    # one match is a status with its paths: it begins where the one before it ended, so that a path is never read as a status
    path = r"\x00+([^\x00]+)"
    record = rf"\G\x00*(?:(R[^\x00]*){path}{path}|([^R\x00][^\x00]*){path})"
    rows = manifests.select(F.explode(F.regexp_extract_all("body", F.lit(record), F.lit(0))).alias("r"))
    tokens = rows.select(F.filter(F.split("r", "\x00"), lambda x: x != "").alias("p"))
    status, renamed = F.col("p")[0], F.size("p") == 3
    name = F.when(renamed, "renamed").when(status == "A", "added").when(status == "D", "deleted").otherwise("modified")
    return tokens.select(F.when(renamed, F.get("p", F.lit(2))).otherwise(F.col("p")[1]).alias("path"), name.alias("status"), F.when(renamed, F.col("p")[1]).alias("previous"))


def comment_places(comments: DataFrame, spans: DataFrame, file: str) -> DataFrame:
    """comments (file, comment, line) with the deepest span (file, node, a, b, depth) around their line, then the narrowest; null without one."""
    points = comments.select(file, "comment", F.col("line").alias("a"), F.col("line").alias("b"))
    met = overlaps(points, spans.select(file, "node", "a", "b", "depth"), file).withColumn("width", F.col("r_b") - F.col("r_a"))
    best = first_of(met, ["comment"], [F.desc("r_depth"), F.asc("width"), F.asc("r_node")]).select("comment", F.col("r_node").alias("node"))
    return comments.join(best, "comment", "left").select(file, "comment", "line", "node")


def coverage_evidence(nodes: DataFrame, functions: DataFrame) -> DataFrame:
    """(node, function, score): the one best counter of a node, none where two score the same.

    8 for the declaration line, 4 for the body line, 2 for the name, 1 for a span inside
    the node's; only a declaration on the node's line reaches the 8 that are asked for,
    so file and line are the join key.
    """
    met = nodes.join(functions, (nodes["file"] == functions["in_file"]) & (nodes["line"] == functions["decl"]))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    score = 8 + 4 * flag(F.col("body") == F.col("line")) + 2 * flag(F.col("name") == F.col("fn_name")) + flag((F.col("body") >= F.col("line")) & (F.col("fn_end") <= F.col("end_line")))
    scored = met.select("node", "function", score.alias("score"))
    top = scored.groupBy("node").agg(F.max("score").alias("score"))
    return scored.join(top, ["node", "score"]).groupBy("node", "score").agg(F.count("*").alias("n"), F.min("function").alias("function")).filter("n = 1").select("node", "function", "score")


def paired(base: DataFrame, head: DataFrame) -> DataFrame:
    """(base_id, head_id, how) of declarations (id, group, signature) of two versions.

    By equal id, then by a signature that is left once on either side of a group, then
    as the only ones left in a group; what remains has one side only.
    """
    same = base.join(head.select("id"), "id", "left_semi").select(F.col("id").alias("base_id"), F.col("id").alias("head_id"), F.lit("id").alias("how"))
    left = base.join(head.select("id"), "id", "left_anti")
    right = head.join(base.select("id"), "id", "left_anti")

    def single(keys: list[str], how: str):
        one = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias(name)).filter("n = 1").drop("n")
        return one(left, "base_id").join(one(right, "head_id"), keys).select("base_id", "head_id", F.lit(how).alias("how"))

    by_signature = single(["group", "signature"], "signature")
    left = left.join(by_signature.select(F.col("base_id").alias("id")), "id", "left_anti")
    right = right.join(by_signature.select(F.col("head_id").alias("id")), "id", "left_anti")
    by_rest = single(["group"], "leftover")
    left = left.join(by_rest.select(F.col("base_id").alias("id")), "id", "left_anti")
    right = right.join(by_rest.select(F.col("head_id").alias("id")), "id", "left_anti")
    none = F.lit(None).cast(dict(base.dtypes)["id"])
    gone = left.select(F.col("id").alias("base_id"), none.alias("head_id"), F.lit("deleted").alias("how"))
    new = right.select(none.alias("base_id"), F.col("id").alias("head_id"), F.lit("new").alias("how"))
    return same.unionByName(by_signature).unionByName(by_rest).unionByName(gone).unionByName(new)


def value_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, field, state) of fields of flat JSON objects (key, body) that were added, removed or changed."""
    fields = lambda df, name: df.select(key, F.explode(F.from_json("body", "map<string,string>")).alias("field", name))
    met = fields(before, "old").withColumn("had", F.lit(True)).join(fields(after, "new").withColumn("has", F.lit(True)), [key, "field"], "full_outer")
    state = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return met.select(key, "field", state.alias("state")).filter("state IS NOT NULL")


def nested_changes(pairs: DataFrame, key: str, shallow: bool = False, max_depth: int = 200) -> DataFrame:
    """(key, path, state, before, after) of what differs between two JSON texts (key, before, after): added, removed or changed.

    Objects are compared by name and arrays by place, level by level over all pairs at
    once, down to values of which one isn't such; added and removed parts are told whole, as are
    parts at the first level where shallow. The order of an object's names doesn't count.
    Values are told as JSON texts with sorted names; a text that is null or no JSON counts as null.
    """
    text = lambda c: F.coalesce(F.to_json(F.try_parse_json(c)), F.lit("null"))
    told, now = [], cut(pairs.select(key, F.lit("$").alias("path"), text(F.col("before")).alias("before"), text(F.col("after")).alias("after")).filter("before <> after"))
    none = F.lit(None).cast("string")
    for depth in range(max_depth):
        kind = F.when(F.col("before").startswith("{") & F.col("after").startswith("{"), "object").when(F.col("before").startswith("[") & F.col("after").startswith("["), "array")
        rows = now.withColumn("_kind", F.lit(None) if shallow and depth else kind)
        told.append(rows.filter("_kind IS NULL").select(key, "path", F.lit("changed").alias("state"), "before", "after"))
        inner = rows.filter("_kind IS NOT NULL")
        fields = lambda c: F.map_entries(F.from_json(c, "map<string,variant>"))
        items = lambda c: F.transform(F.from_json(c, "array<variant>"), lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value")))
        parts = lambda c: F.explode(F.when(F.col("_kind") == "object", fields(c)).otherwise(items(c)))
        side = lambda c: inner.select(key, "path", "_kind", parts(c).alias("e")).select(key, "path", "_kind", F.col("e.key").alias("name"), F.to_json("e.value").alias(c))
        met = side("before").join(side("after"), [key, "path", "_kind", "name"], "full_outer")
        named = F.when(F.col("name").rlike("^[A-Za-z_$][A-Za-z0-9_$]*$"), F.concat(F.lit("."), "name")).otherwise(F.to_json(F.array("name")))
        below = F.concat("path", F.when(F.col("_kind") == "array", F.concat(F.lit("["), "name", F.lit("]"))).otherwise(named))
        met = cut(met.select(key, below.alias("path"), "before", "after").filter(~F.col("before").eqNullSafe(F.col("after"))))
        lone = F.col("before").isNull() | F.col("after").isNull()
        told.append(met.filter(lone).select(key, "path", F.when(F.col("before").isNull(), "added").otherwise("removed").alias("state"), "before", "after"))
        now = met.filter(~lone)
        if now.isEmpty():
            return union(told)
    raise Unsettled(f"values nested deeper than {max_depth}")


def tick_states(ticks: DataFrame, prints: DataFrame) -> DataFrame:
    """(id, state): done where the last tick (id, at, digest) saw the present digest (id, digest), stale where another, todo without one."""
    last = ticks.groupBy("id").agg(F.max_by("digest", "at").alias("seen"))
    state = F.when(F.col("seen").isNull(), "todo").when(F.col("seen") == F.col("digest"), "done").otherwise("stale")
    return prints.join(last, "id", "left").select("id", state.alias("state"))


def view_states(states: DataFrame, group: str) -> DataFrame:
    """Per group: stale if any member is, done if all are, else todo."""
    stale, done = F.bool_or(F.col("state") == "stale"), F.bool_and(F.col("state") == "done")
    return states.groupBy(group).agg(F.when(stale, "stale").when(done, "done").otherwise("todo").alias("state"), F.count_if(F.col("state") == "done").alias("viewed"))
