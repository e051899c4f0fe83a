"""Graph views over the driver's star-schema tables.

Every view is one SQL text that Spark and DuckDB both run; ``{name}`` stands for a table
or another view. :func:`view` gives a view as a DataFrame, :func:`ctes` gives it, with
all it needs, as the head of a DuckDB query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)

_PLACE = "SELECT n_nationkey, concat('tp:r', n_regionkey, '/n', n_nationkey) AS module FROM {nation}"

VIEWS = {
    "nation_module": _PLACE,
    "part_module": "SELECT p_partkey, concat('tp:', replace(p_brand, '#', '')) AS package, concat('tp:', replace(p_brand, '#', ''), '/', p_type) AS module FROM {part}",
    # containment: packages, modules, classes, callables; test methods are orders of one market segment
    "nodes": """
        SELECT concat('tp:r', r_regionkey) AS id, 'package' AS kind, r_name AS display_name, CAST(NULL AS STRING) AS parent_id, false AS is_test FROM {region}
        UNION ALL SELECT module, 'module', n_name, concat('tp:r', n_regionkey), false FROM {nation} JOIN {nation_module} USING (n_nationkey)
        UNION ALL SELECT concat(module, '#S', s_suppkey), 'function', s_name, module, false FROM {supplier} JOIN {nation_module} ON s_nationkey = n_nationkey
        UNION ALL SELECT DISTINCT package, 'package', package, CAST(NULL AS STRING), false FROM {part_module}
        UNION ALL SELECT DISTINCT module, 'module', module, package, false FROM {part_module}
        UNION ALL SELECT concat(module, '#P', p_partkey), 'function', p_name, module, false FROM {part} JOIN {part_module} USING (p_partkey)
        UNION ALL SELECT concat(module, '#C', c_custkey), 'class', c_name, module, false FROM {customer} JOIN {nation_module} ON c_nationkey = n_nationkey
        UNION ALL SELECT concat(module, '#C', c_custkey, '.O', o_orderkey), 'method', concat('order ', o_orderkey), concat(module, '#C', c_custkey), true
          FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation_module} ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY'""",
    # the same with files and lines: classes of eight lines in their nation's file, methods inside them
    "located": """
        SELECT module AS id, 'module' AS kind, CAST(NULL AS STRING) AS parent_id, concat(module, '.ts') AS file, 1 AS a, 5000 AS b FROM {nation_module}
        UNION ALL SELECT concat(module, '#C', c_custkey), 'class', module, concat(module, '.ts'), CAST(10 * (c_custkey % 211) + 1 AS INT), CAST(10 * (c_custkey % 211) + 8 AS INT) FROM {customer} JOIN {nation_module} ON c_nationkey = n_nationkey
        UNION ALL SELECT concat(module, '#C', c_custkey, '.O', o_orderkey), 'method', concat(module, '#C', c_custkey), concat(module, '.ts'),
               CAST(10 * (c_custkey % 211) + 1 + o_orderkey % 7 AS INT), CAST(10 * (c_custkey % 211) + 1 + o_orderkey % 7 + o_orderkey % 2 AS INT)
          FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation_module} ON c_nationkey = n_nationkey WHERE o_orderkey % 3 = 0""",
    "line_ends": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus,
               concat(pm.module, '#P', l_partkey) AS part_id, concat(nm.module, '#S', l_suppkey) AS supplier_id, pm.module AS part_module, nm.module AS supplier_module
        FROM {lineitem} JOIN {part_module} pm ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation_module} nm ON s_nationkey = n_nationkey""",
    "edges": """
        SELECT DISTINCT 'calls' AS kind, concat(module, '#C', c_custkey, '.O', o_orderkey) AS source, part_id AS target,
               CASE WHEN l_partkey % 9 = 4 THEN 'unresolved' ELSE 'resolved' END AS resolution
          FROM {line_ends} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation_module} ON c_nationkey = n_nationkey
          WHERE c_mktsegment = 'MACHINERY' AND l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 1
        UNION ALL SELECT DISTINCT 'calls', part_id, supplier_id, CASE WHEN l_suppkey % 5 = 3 THEN 'unresolved' END FROM {line_ends} WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 2
        UNION ALL SELECT DISTINCT CASE WHEN l_suppkey % 4 = 1 THEN 'references' ELSE 'calls' END, supplier_id, part_id, 'resolved' FROM {line_ends} WHERE l_returnflag = 'N' AND l_linestatus = 'F' AND l_linenumber = 3 AND l_quantity < 5""",
    # one occurrence for each line item, from supplier to part
    "occurrences": """
        SELECT CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'R' THEN 'instantiates' ELSE 'references' END AS kind, supplier_id AS source,
               CASE WHEN l_partkey % 11 = 0 THEN concat('ext:npm/p', l_partkey % 97) WHEN l_partkey % 13 = 0 THEN 'unresolved:npm/?' ELSE part_id END AS target,
               CASE WHEN l_linestatus = 'F' THEN 'resolved' ELSE 'unresolved' END AS resolution, 1 - l_discount AS confidence,
               concat(supplier_module, '.ts') AS file, l_orderkey + 1 AS line, l_linenumber AS col,
               concat(lpad(CAST(l_orderkey AS STRING), 10, '0'), CAST(l_linenumber AS STRING), lpad(CAST(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS STRING), 12, '0'), lpad(CAST(l_partkey AS STRING), 9, '0'), lpad(CAST(l_suppkey AS STRING), 8, '0')) AS ord
        FROM {line_ends}""",
    # nations as units, couplings from customer to supplier nation
    "unit_edges": """
        SELECT kind, source, target, CAST(sum(w) AS BIGINT) AS weight FROM (
          SELECT CASE WHEN l_quantity <= 1 THEN 'calls' WHEN l_quantity <= 2 THEN 'references' ELSE 'extends' END AS kind,
                 a.module AS source, b.module AS target, 1 AS w
          FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
          JOIN {nation_module} a ON c_nationkey = a.n_nationkey JOIN {nation_module} b ON s_nationkey = b.n_nationkey
          WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 1 AND l_quantity <= 3 AND c_nationkey <> s_nationkey) x
        GROUP BY kind, source, target""",
    "units": "SELECT module AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'interface' ELSE 'class' END AS kind, concat('tp:r', n_regionkey) AS package FROM {nation} JOIN {nation_module} USING (n_nationkey)",
    # parts as members of the nation with the number of their brand
    "members": "SELECT concat('P', p_partkey) AS id, module AS unit, p_size % 3 = 0 OR n_nationkey % 7 = 2 AS is_abstract FROM {part} JOIN {nation_module} ON concat('Brand#', n_nationkey) = p_brand",
    # what units depend on outside the graph
    "outside": "SELECT DISTINCT module AS source, concat('ext:npm/p', l_partkey % 97) AS target FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation_module} ON s_nationkey = n_nationkey WHERE l_partkey % 50 = 0",
    "member_calls": """
        SELECT DISTINCT concat('P', a.l_partkey) AS source, concat('P', b.l_partkey) AS target
        FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey
        WHERE a.l_returnflag = 'A' AND a.l_linestatus = 'F' AND b.l_returnflag = 'A' AND b.l_linestatus = 'F' AND a.l_partkey < b.l_partkey""",
    # telemetry: an event is a span; a gap of twelve hours begins a new trace of its user
    "spans": """
        SELECT event_id, user_id, event_type, ts, value, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS trace
        FROM (SELECT event_id, user_id, event_type, ts, value, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL '12' HOUR THEN 0 ELSE 1 END AS fresh FROM {events}) e""",
    "intervals": """
        SELECT o_custkey AS owner, l_orderkey, l_linenumber, l_partkey, l_suppkey,
               datediff(least(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)), DATE '1992-01-01') AS a, datediff(greatest(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)), DATE '1992-01-01') AS b,
               l_shipdate < o_orderdate AS reversed
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # step trees: orders as flows, a branch for each line status, line items as its steps
    "flow_steps": """
        SELECT DISTINCT l_orderkey AS flow, l_linestatus AS path, CAST(NULL AS STRING) AS parent, 0 AS depth, CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END AS ord, 'branch' AS kind, CAST(NULL AS STRING) AS target FROM {lineitem}
        UNION ALL SELECT l_orderkey, concat(l_linestatus, '.', lpad(CAST(k AS STRING), 4, '0')), l_linestatus, 1, k, CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'R' THEN 'exit' ELSE 'await' END, CASE WHEN l_returnflag = 'A' THEN concat('P', l_partkey) END
          FROM (SELECT l_orderkey, l_linestatus, l_returnflag, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey, l_quantity) AS INT) AS k FROM {lineitem}) x""",
    # edges as calls, deliveries, waits and returned promises, by the digits of their ends, and where they stand
    "causal_edges": """
        SELECT concat(kind, ':', source, '>', target) AS id, kind, source, target, resolution, CASE WHEN n % 6 = 1 THEN CAST(0.5 + n % 5 / 10.0 AS DOUBLE) END AS confidence, regexp_replace(source, '#.*$', '') AS file, CAST(m % 40 AS INT) AS line, CAST(n % 20 AS INT) AS col
        FROM (SELECT DISTINCT source, target, resolution, n, m, CASE WHEN n % 10 = 4 THEN 'handles' WHEN n % 10 IN (3, 7) THEN 'awaitsPromise' WHEN n % 23 = 5 THEN 'returnsPromise' WHEN n % 10 = 9 THEN 'resolvesPromise' WHEN n % 17 = 1 THEN 'references' ELSE 'calls' END AS kind
          FROM (SELECT source, target, resolution, CAST(regexp_extract(target, '([0-9]+)$', 1) AS BIGINT) AS n, CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) + CAST(regexp_extract(target, '([0-9]+)$', 1) AS BIGINT) AS m FROM {edges} WHERE kind <> 'references') e) x""",
    # each trace as spans that call each other, some linked to others, forward and back
    "trace_spans": """
        SELECT concat(user_id, '/', trace) AS trace, CAST(event_id AS STRING) AS span, event_id, ts,
               CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 'gone' WHEN event_id % 29 = 1 THEN CAST(lead(event_id) OVER w AS STRING) ELSE CAST(CASE event_id % 3 WHEN 0 THEN lag(event_id, 1) OVER w WHEN 1 THEN lag(event_id, 2) OVER w ELSE lag(event_id, 3) OVER w END AS STRING) END AS parent,
               datediff(CAST(ts AS DATE), DATE '1992-01-01') * CAST(86400 AS BIGINT) + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS start,
               lag(event_id) OVER w AS earlier, lead(event_id) OVER w AS later, event_type
        FROM {spans} WINDOW w AS (PARTITION BY user_id, trace ORDER BY ts, event_id)""",
    "trace_links": """
        SELECT trace, span, 0 AS ord, CASE WHEN event_id % 7 = 0 THEN 'other' ELSE trace END AS linked_trace, CAST(CASE WHEN event_id % 3 = 0 THEN later ELSE earlier END AS STRING) AS linked_span, 'async' AS relation FROM {trace_spans} WHERE event_id % 4 = 0 AND (CASE WHEN event_id % 3 = 0 THEN later ELSE earlier END) IS NOT NULL
        UNION ALL SELECT trace, span, 1, trace, CAST(earlier AS STRING), 'message' FROM {trace_spans} WHERE event_id % 4 = 0 AND earlier IS NOT NULL""",
    # parts as Python files: a folder for each brand and type, some with initialisers, and modules beside folders of their name
    "python_files": """
        SELECT concat(b, '/', p_type, '/s', p_size, '.py') AS path, concat(b, '.', p_type, '.s', p_size) AS module FROM (SELECT replace(p_brand, '#', '') AS b, p_type, p_size FROM {part}) x WHERE p_size % 10 <> 0
        UNION SELECT concat(b, '/', p_type, '/__init__.py'), concat(b, '.', p_type) FROM (SELECT replace(p_brand, '#', '') AS b, p_type, p_size FROM {part}) x WHERE p_size % 10 = 0 AND p_size > 10
        UNION SELECT concat(b, '/', p_type, '.py'), concat(b, '.', p_type) FROM (SELECT replace(p_brand, '#', '') AS b, p_type, p_size FROM {part}) x WHERE p_size = 7
        UNION SELECT concat(b, '/__init__.py'), b FROM (SELECT replace(p_brand, '#', '') AS b, p_type, p_size FROM {part}) x WHERE p_size = 3 AND b LIKE '%1'
        UNION SELECT concat('main', p_size, '.py'), concat('main', p_size) FROM {part} WHERE p_size < 4""",
    "python_slices": """
        SELECT p_partkey % 97 AS slice, CASE WHEN p_partkey % 11 = 0 THEN concat('main', p_size % 3 + 1, '.py') WHEN p_partkey % 13 = 0 THEN concat('web/p', p_partkey, '.ts') ELSE concat(replace(p_brand, '#', ''), '/', p_type, CASE WHEN p_size = 7 THEN '.py' ELSE concat('/s', p_size, '.py') END) END AS path
        FROM {part} WHERE (p_partkey % 97 >= 90 OR p_partkey % 7 = 0) AND (p_size % 10 <> 0 OR p_partkey % 97 < 2 OR p_partkey % 11 = 0) AND (p_partkey % 97 <> 5 OR p_partkey % 11 = 0)""",
    # the containment tree below two packages that hold one package each
    "deep_nodes": """
        SELECT id, CASE WHEN parent_id IS NULL THEN CASE WHEN id LIKE 'tp:r%' THEN 'tp:world/ends' ELSE 'tp:world/parts' END ELSE parent_id END AS parent_id, kind, display_name AS name, kind = 'package' AND (id LIKE 'tp:Brand1%' OR id LIKE 'tp:r%') AS owns_files FROM {nodes}
        UNION ALL SELECT 'tp:all', CAST(NULL AS STRING), 'package', 'all', true UNION ALL SELECT 'tp:world', 'tp:all', 'package', 'world', false
        UNION ALL SELECT 'tp:world/ends', 'tp:world', 'package', 'ends', false UNION ALL SELECT 'tp:world/parts', 'tp:world', 'package', 'parts', false""",
    "deep_edges": """
        SELECT kind, source, target, CAST(count(*) AS BIGINT) AS weight FROM {edges} GROUP BY kind, source, target
        UNION ALL SELECT 'imports', supplier_module, part_module, CAST(count(*) AS BIGINT) FROM {line_ends} WHERE l_linenumber = 4 AND l_quantity <= 2 GROUP BY supplier_module, part_module""",
    # requests: an event runs the order of its number; its calls of returned items made spans, and it tells which ways it went
    "request_steps": """
        SELECT CAST(flow AS STRING) AS flow, path, parent, CASE WHEN parent IS NOT NULL THEN 0 END AS arm, depth, kind, target, CASE WHEN parent IS NULL THEN path END AS site, kind = 'exit' AS throws, false AS detached FROM {flow_steps}""",
    "request_arms": """
        SELECT flow, path, 0 AS arm, 'then' AS label, 'then' AS role, 'then' AS path_id FROM {request_steps} WHERE parent IS NULL
        UNION ALL SELECT flow, path, 1, 'else', 'else', 'else' FROM {request_steps} WHERE parent IS NULL""",
    "request_spans": """
        SELECT CAST(event_id AS STRING) AS span, CAST(NULL AS STRING) AS parent, CAST(event_id AS STRING) AS node, CAST(0 AS BIGINT) AS start, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, event_id % 7 <> 0 AS complete FROM {events}
        UNION ALL SELECT concat(l_orderkey, '.', l_linenumber, '.', l_partkey, '.', l_suppkey), CAST(l_orderkey AS STRING), concat('P', l_partkey), CAST(l_linenumber AS BIGINT), CASE WHEN l_suppkey % 17 = 0 THEN 'error' ELSE 'ok' END, true
          FROM {lineitem} WHERE l_returnflag = 'A' AND l_partkey % 4 <> 0""",
    "request_events": """
        SELECT CAST(event_id AS STRING) AS span, concat(event_id, site) AS event, CAST(k AS BIGINT) AS at, 'branch' AS what, site, CASE WHEN (event_id + k) % 3 <> 0 THEN 'then' ELSE 'else' END AS path_id, CAST(NULL AS BIGINT) AS iterations, false AS handled
        FROM {events} CROSS JOIN (SELECT 'F' AS site, 1 AS k UNION ALL SELECT 'O', 2) s WHERE (event_id + 2 * k) % 5 <> 0""",
    # orders as control-flow graphs: two arms and a join for each branch, some calls with their body in them
    "logic_nodes": """
        SELECT CAST(flow AS STRING) AS flow, path AS id, parent, CASE WHEN parent IS NOT NULL THEN ord % 2 END AS arm, ord, kind, target, CASE WHEN target LIKE '%5' THEN 'external' ELSE 'resolved' END AS resolution, target IS NOT NULL AND target LIKE '%7' AS definition, kind = 'call' AND ord % 3 = 2 AS expanded FROM {flow_steps}
        UNION ALL SELECT CAST(flow AS STRING), concat(path, '.~join'), CAST(NULL AS STRING), CAST(NULL AS INT), 9999, 'join', CAST(NULL AS STRING), CAST(NULL AS STRING), false, false FROM {flow_steps} WHERE parent IS NULL
        UNION ALL SELECT CAST(flow AS STRING), concat(path, '/s'), path, CAST(NULL AS INT), 1, 'branch', CAST(NULL AS STRING), CAST(NULL AS STRING), false, false FROM {flow_steps} WHERE kind = 'call' AND ord % 3 = 2
        UNION ALL SELECT CAST(flow AS STRING), concat(path, '/s/c'), concat(path, '/s'), 1, 1, 'call', concat(target, '1'), 'resolved', false, false FROM {flow_steps} WHERE kind = 'call' AND ord % 3 = 2""",
    "logic_edges": """
        SELECT flow, concat(kind, ':', source, '>', target) AS id, concat(kind, ':', source, '>', target) AS key, source, target, kind, arm, CAST(NULL AS STRING) AS port, true AS collapsible FROM (
          SELECT flow, id AS source, coalesce(lead(id) OVER w, concat(parent, '.~join')) AS target, CASE WHEN kind <> 'exit' THEN 'seq' END AS kind, CAST(NULL AS INT) AS arm FROM {logic_nodes} WHERE parent IN ('F', 'O') WINDOW w AS (PARTITION BY flow, parent, arm ORDER BY ord)
          UNION ALL SELECT flow, parent, min(id), 'branch', arm FROM {logic_nodes} WHERE arm IS NOT NULL GROUP BY flow, parent, arm
          UNION ALL SELECT flow, 'F.~join', id, 'seq', CAST(NULL AS INT) FROM {logic_nodes} WHERE id = 'O' AND flow IN (SELECT flow FROM {logic_nodes} WHERE id = 'F')
          UNION ALL SELECT flow, id, 'O.~join', 'async', CAST(NULL AS INT) FROM {logic_nodes} WHERE id LIKE 'F.%1' AND flow IN (SELECT flow FROM {logic_nodes} WHERE id = 'O')) x WHERE kind IS NOT NULL""",
    "logic_cuts": """
        SELECT flow, key FROM {logic_edges} WHERE kind = 'branch' AND CAST(flow AS BIGINT) % 3 = 0 AND arm = 0
        UNION ALL SELECT flow, key FROM {logic_edges} WHERE kind = 'seq' AND CAST(flow AS BIGINT) % 5 = 0 AND source LIKE '%2'
        UNION ALL SELECT flow, key FROM {logic_edges} WHERE kind = 'async' AND CAST(flow AS BIGINT) % 7 = 0""",
    "part_verdicts": "SELECT concat('P', p_partkey) AS id, CASE p_size % 4 WHEN 0 THEN 'covered' WHEN 1 THEN 'indirect' WHEN 2 THEN 'uncovered' END AS status FROM {part}",
    # what modules are called: the names and sizes of their parts
    "module_terms": """
        SELECT id, term, CAST(count(*) AS BIGINT) AS n FROM (
          SELECT module AS id, p_name AS term FROM {part} JOIN {part_module} USING (p_partkey)
          UNION ALL SELECT module, concat('size', p_size) FROM {part} JOIN {part_module} USING (p_partkey)) x GROUP BY id, term""",
    "module_groups": "SELECT DISTINCT module AS id, package FROM {part_module}",
    "page_paths": "SELECT page_id, url, regexp_replace(url, '^https?://', '') AS bare, regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', '') AS path FROM {pages}",
}

_NAME = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = dict.fromkeys(_NAME.findall(VIEWS[name]))
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in needs})


def _in_order(names, seen: dict[str, None]) -> dict[str, None]:
    for name in names:
        if name not in TABLES and name not in seen:
            _in_order(_NAME.findall(VIEWS[name]), seen)
            seen[name] = None
    return seen


def ctes(*names: str) -> str:
    """``WITH RECURSIVE a AS (...), b AS (...)`` for DuckDB; empty where only tables are named."""
    parts = [f"{n} AS ({_duck(_NAME.sub(r'\1', VIEWS[n]))})" for n in _in_order(names, {})]
    return "WITH RECURSIVE " + ",\n".join(parts) if parts else ""


def _duck(text: str) -> str:
    """The one function that the engines spell differently: days since 1992."""
    return re.sub(r"datediff\((.*?\)), DATE '1992-01-01'\)", r"CAST(\1 - DATE '1992-01-01' AS INTEGER)", text)
