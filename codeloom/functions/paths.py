"""What a file path says about the file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories of test code, and shapes of test file and directory names.
TEST_DIRECTORIES = ("__tests__", "__test__", "__mocks__", "__mock__", "test", "tests", "e2e", "spec", "specs", "testing")
TEST_FILES = (r"(?i)\.(test|spec)\.[a-z0-9]+$", r"(^|/)test_[^/]+\.py$", r"_test\.(py|go)$", r"(^|/)conftest\.py$")
TEST_DIRECTORY = r"(?i)(^|-)(e2e|tests?|testbench|testkit)(-|$)"
#: Path segments of the roles, in order of precedence.
UTIL = ("utils", "util", "helpers", "lib", "shared", "common")
UI = ("ui", "components", "component", "pages", "views", "hooks", "styles")
CONFIG = ("config", "constants", "types")


def is_test_path(path: Column) -> Column:
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    named = F.lit(False)
    for pattern in TEST_FILES:
        named = named | plain.rlike(pattern)
    parts = F.split(plain, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    inside = F.exists(folders, lambda s: F.lower(s).isin(*TEST_DIRECTORIES) | s.rlike(TEST_DIRECTORY))
    return named | inside


def role_of_path(path: Column) -> Column:
    """util, ui, config or app, the first that a segment (for config also the file's stem) says."""
    parts = F.split(F.lower(path), "/")
    stem = F.substring_index(F.element_at(parts, -1), ".", 1)
    names = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return (
        F.when(F.arrays_overlap(parts, names(*UTIL)), "util")
        .when(F.arrays_overlap(parts, names(*UI)), "ui")
        .when(F.arrays_overlap(parts, names(*CONFIG)) | stem.isin(*CONFIG), "config")
        .otherwise("app")
    )


def in_scope(path: Column, scope: Column) -> Column:
    """Whether a path is the scope or lies below it, by whole segments."""
    clean = lambda p: F.btrim(F.regexp_replace(F.regexp_replace(p, r"^(\./)+", ""), "/+", "/"), F.lit("/"))
    return (clean(scope) == "") | (clean(path) == clean(scope)) | clean(path).startswith(F.concat(clean(scope), F.lit("/")))
