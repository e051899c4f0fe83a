"""Search (group J) and merges (group K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import merge as G
from codeloom.operators import search as S

from .registry import query

SYMBOLS = """sym AS (SELECT id, display_name, kind, coalesce(n, 0)::BIGINT AS steps, regexp_matches(display_name, '^[_#]') AS is_private
FROM nodes LEFT JOIN (SELECT source AS id, count(*) AS n FROM edges GROUP BY source) USING (id) WHERE kind IN ('function', 'method', 'module', 'class', 'interface', 'typeAlias', 'object'))"""


@query("nodes edges", f"WITH {SYMBOLS} SELECT * FROM sym")
def symbol_index(nodes, edges):
    return S.symbols(nodes, edges)


@query("nodes edges", f"WITH {SYMBOLS} SELECT * FROM sym WHERE contains(lower(display_name), 'r1/') OR contains(lower(id), 'r1/') ORDER BY steps > 0 DESC, display_name, id LIMIT 40")
def symbol_search(nodes, edges):
    return S.ranked(S.symbols(nodes, edges), "R1/")


@query("nodes edges", f"WITH {SYMBOLS} SELECT kind, count_if(is_private)::BIGINT AS private, count_if(NOT is_private)::BIGINT AS public FROM sym GROUP BY kind")
def symbol_counts(nodes, edges):
    return S.scope_counts(S.symbols(nodes, edges))


@query("nodes edges", f"WITH {SYMBOLS} SELECT id, CASE WHEN steps > 0 THEN 'loaded' ELSE 'indexed' END AS origin FROM sym")
def symbol_merge(nodes, edges):
    """Symbols with a flow count as loaded and stand for their index rows."""
    rows = S.symbols(nodes, edges)
    loaded = rows.filter("steps > 0").select("id", F.lit("loaded").alias("origin"))
    return S.overriding(loaded, rows.select("id", F.lit("indexed").alias("origin")))


def _pulls(orders):
    return orders.select(
        F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("Dev"), "o_custkey").alias("author"), F.col("o_orderstatus").alias("body")
    )


PULLS = "pulls AS (SELECT o_orderkey AS number, o_orderpriority AS title, concat('Dev', o_custkey) AS author, o_orderstatus AS body FROM orders)"


@query("orders", f"WITH {PULLS} SELECT * FROM pulls WHERE contains(CAST(number AS VARCHAR), 'dev11') OR contains(lower(title), 'dev11') OR contains(lower(author), 'dev11') OR contains(lower(body), 'dev11')")
def pr_search(orders):
    return S.reviews(_pulls(orders), " DEV11 ")


@query("orders", f"WITH {PULLS} SELECT * FROM pulls WHERE number = 7")
def pr_number(orders):
    return S.reviews(_pulls(orders), "#7")


COMMENTS = "comments AS (SELECT event_id AS id, CASE WHEN event_id % 4 <> 0 THEN event_id - event_id % 4 END AS reply_to, concat('User', user_id % 40) AS author FROM events)"


def _comments(events):
    k = F.col("event_id")
    return events.select(k.alias("id"), F.when(k % 4 != 0, k - k % 4).alias("reply_to"), F.concat(F.lit("User"), (F.col("user_id") % 40).cast("string")).alias("author"))


@query("events", f"WITH {COMMENTS}, r AS (SELECT *, coalesce(reply_to, id) AS thread FROM comments) SELECT * FROM r WHERE thread IN (SELECT thread FROM r WHERE lower(author) = 'user7')")
def comment_filter(events):
    """All comments of the threads in which one author wrote."""
    return S.comments_of(_comments(events), "user7", threads=True)


@query("events", f"WITH {COMMENTS} SELECT lower(author) AS key, min(author) AS author, count(*)::BIGINT AS n FROM comments GROUP BY 1")
def comment_authors(events):
    return S.comment_authors(_comments(events))


@query("orders", "SELECT o_orderkey AS id, o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 <> 0")
def merge_slices(orders):
    rows = orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_custkey")
    return G.merge([rows.filter("id % 3 <> 0"), rows.filter("id % 2 <> 0")])


@query("orders", "SELECT o_orderkey AS id, 2::BIGINT AS versions FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0 AND o_orderkey % 7 = 0")
def merge_conflicts(orders):
    """Orders that the second slice tells differently."""
    rows = orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_custkey")
    other = rows.filter("id % 2 <> 0").withColumn("o_orderstatus", F.when(F.col("id") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return G.conflicts([rows.filter("id % 3 <> 0"), other])


@query("documents", """WITH s AS (SELECT source, lang, count(*) AS documents, sum(n_chars) AS chars FROM documents GROUP BY ALL),
l AS (SELECT source, lang, 'documents' AS counter, documents AS n FROM s UNION ALL SELECT source, lang, 'chars', chars FROM s)
SELECT source, counter, sum(n)::BIGINT AS n, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) ELSE 'mixed' END AS language FROM l GROUP BY source, counter""")
def merge_extractions(documents):
    """Counters of each source's languages, merged."""
    per = documents.groupBy("source", F.col("lang").alias("language")).agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))
    return G.merged_stats(per.unpivot(["source", "language"], ["documents", "chars"], "counter", "n"), "source")


@query("orders", """WITH e AS (SELECT o_custkey AS cache, o_orderkey AS entry, CAST(CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS INTEGER) AS used_at, o_orderkey % 10 = 0 AS pinned, 1 AS n, floor(o_totalprice)::BIGINT AS bytes FROM orders),
f AS (SELECT *, NOT pinned AND 2600 - used_at > 2000 AS stale FROM e),
g AS (SELECT *, sum(CASE WHEN stale THEN 0 ELSE n END) OVER (PARTITION BY cache) AS all_n, sum(CASE WHEN stale THEN 0 ELSE bytes END) OVER (PARTITION BY cache) AS all_b,
 coalesce(sum(CASE WHEN stale OR pinned THEN 0 ELSE n END) OVER w, 0) AS gone_n, coalesce(sum(CASE WHEN stale OR pinned THEN 0 ELSE bytes END) OVER w, 0) AS gone_b FROM f
 WINDOW w AS (PARTITION BY cache ORDER BY used_at, entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT cache, entry, CASE WHEN stale THEN 'idle' ELSE 'pressure' END AS reason FROM g
WHERE stale OR NOT pinned AND (all_n > 8 AND all_n - gone_n > 5 OR all_b > 2000000 AND all_b - gone_b > 1000000)""")
def retention(orders):
    """What the caches of customers may drop: orders as entries, their price as bytes."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    entries = orders.select(
        F.col("o_custkey").alias("cache"), F.col("o_orderkey").alias("entry"), day.alias("used_at"), (F.col("o_orderkey") % 10 == 0).alias("pinned"), F.lit(1).alias("n"), F.floor("o_totalprice").alias("bytes")
    )
    return G.evictions(entries, "cache", 2600, 2000, {"n": (5, 8), "bytes": (1_000_000, 2_000_000)})
