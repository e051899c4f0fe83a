"""Symbol search, and filters of reviews and comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds that can be searched for.
SYMBOLS = ("function", "method", "module", "class", "interface", "typeAlias", "object")


def symbols(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """Searchable nodes with how many steps their flow has (0 without one) and whether their name is private."""
    steps = flows.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("steps"))
    rows = nodes.filter(F.col("kind").isin(*SYMBOLS)).join(steps, "id", "left")
    private = F.col("display_name").rlike("^[_#]")
    return rows.select("id", "display_name", "kind", F.coalesce("steps", F.lit(0).cast("long")).alias("steps"), private.alias("is_private"))


def ranked(rows: DataFrame, text: str, flows_first: bool = True, top: int = 40) -> DataFrame:
    """The first ``top`` symbols with the text in name or id, whatever the case; an empty text finds those with a flow."""
    low = text.lower()
    hit = F.lower("display_name").contains(low) | F.lower("id").contains(low) if low else F.col("steps") > 0
    order = [F.desc(F.col("steps") > 0)] if flows_first else []
    return rows.filter(hit).orderBy(*order, "display_name", "id").limit(top)


def scope_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count_if("is_private").alias("private"), F.count_if(~F.col("is_private")).alias("public"))


def overriding(loaded: DataFrame, indexed: DataFrame) -> DataFrame:
    """Rows of both by id; those that are loaded stand for those that are only indexed."""
    return loaded.unionByName(indexed.join(loaded.select("id"), "id", "left_anti"))


def reviews(pulls: DataFrame, text: str) -> DataFrame:
    """pulls (number, title, author, body) that match: ``#n`` the number, other texts any field, whatever the case."""
    low = text.strip().lower()
    if low.startswith("#") and low[1:].isdigit():
        return pulls.filter(F.col("number") == int(low[1:]))
    fields = ["title", "author", "body"]
    hit = F.col("number").cast("string").contains(low)
    for name in fields:
        hit = hit | F.coalesce(F.lower(name).contains(low), F.lit(False))
    return pulls.filter(hit)


def comments_of(comments: DataFrame, author: str, threads: bool) -> DataFrame:
    """comments (id, reply_to, author) by an author, or all of the threads in which the author wrote."""
    rooted = comments.withColumn("thread", F.coalesce("reply_to", "id"))
    own = rooted.filter(F.lower("author") == author.lower())
    return rooted.join(own.select("thread").distinct(), "thread", "left_semi") if threads else own


def path_suggestions(paths: DataFrame) -> DataFrame:
    """(folder, files) of folders above more than one of the distinct paths."""
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    return paths.select("path").distinct().select(F.explode(above).alias("folder")).groupBy("folder").agg(F.count("*").alias("files")).filter("files > 1")


def files_in_scope(closure: DataFrame, modules: DataFrame, chosen: DataFrame, top: int = 100) -> DataFrame:
    """(file, total) of the modules at or below what is chosen, and of the modules around it; the first ``top``, and how many there are."""
    down = closure.join(chosen.select(F.col("id").alias("anc_id")), "anc_id", "left_semi").select(F.col("id").alias("file"))
    up = closure.join(chosen, "id", "left_semi").select(F.col("anc_id").alias("file"))
    found = down.unionByName(up).distinct().join(modules.select(F.col("id").alias("file")), "file", "left_semi")
    total = found.agg(F.count("*").alias("total"))
    return found.join(F.broadcast(total)).orderBy("file").limit(top)


def appended(local: DataFrame, remote: DataFrame, key: str = "number") -> DataFrame:
    """local, and what remote has beside it."""
    return local.unionByName(remote.join(local.select(key), key, "left_anti"))


def comment_authors(comments: DataFrame) -> DataFrame:
    return comments.groupBy(F.lower("author").alias("key")).agg(F.min("author").alias("author"), F.count("*").alias("n"))
