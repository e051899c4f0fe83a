"""Node and edge ids: ``<lang>:<module path>[#<qualname>][~n]`` and ``<kind>@<source>|<target>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ORDINAL = r"~([0-9]+)$"


def parse_node_id(node_id: Column) -> dict[str, Column]:
    """lang, module_path, qualname and ordinal; the first ':' ends the language, the first '#' the path."""
    lang = F.when(F.instr(node_id, ":") > 0, F.substring_index(node_id, ":", 1)).otherwise(F.lit(""))
    rest = F.regexp_replace(node_id, "^[^:]*:", "")
    body = F.regexp_replace(rest, _ORDINAL, "")
    ordinal = F.regexp_extract(rest, _ORDINAL, 1)
    return {
        "lang": lang,
        "module_path": F.substring_index(body, "#", 1),
        "qualname": F.when(F.instr(body, "#") > 0, F.regexp_replace(body, "^[^#]*#", "")),
        "ordinal": F.when(ordinal != "", ordinal.cast("long")),
    }


def node_id(lang: Column, module_path: Column, qualname: Column, ordinal: Column) -> Column:
    name = F.when(F.coalesce(qualname, F.lit("")) != "", F.concat(F.lit("#"), qualname)).otherwise(F.lit(""))
    nth = F.when(F.coalesce(ordinal, F.lit(0)) > 0, F.concat(F.lit("~"), ordinal.cast("string"))).otherwise(F.lit(""))
    return F.concat(lang, F.lit(":"), module_path, name, nth)


def edge_id(kind: Column, source: Column, target: Column) -> Column:
    return F.concat(kind, F.lit("@"), source, F.lit("|"), target)


def normal_scope(qualname: Column) -> Column:
    """``::``, ``#`` and ``$`` become '.', and local scopes vanish."""
    return F.replace(F.regexp_replace(qualname, r"::|#|\$", "."), F.lit(".<locals>"), F.lit(""))


def is_outside(target: Column) -> Column:
    return target.startswith("ext:") | target.startswith("unresolved:")
