"""Helpers that the training-data operators share.

Words are maximal runs of characters other than space and the controls 09-0D;
every operator that counts or hashes words uses :func:`words`, so that counts agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.materialize import cut, shared_folder  # noqa: F401  the pipeline's stages lie there too

#: A run of the characters that separate words.
SEPARATORS = r"[\x20\x09-\x0D]+"
#: The same characters one by one, for translate().
SEPARATOR_CHARS = " \t\n\x0b\x0c\r"
#: Rows of keys that :func:`small` broadcasts: some tens of MB. Larger tables are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Rows in a batch of Arrow where whole texts go to Python: the JVM and the worker hold one each, with room to grow.
BATCH_ROWS = 500
#: Rows of a few numbers that a partition holds at least, before :func:`in_parts` leaves one more.
PART_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column, with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def occurrences(text: Column, chars: str) -> Column:
    """How many characters of the text are in a character class."""
    return F.regexp_count(text, F.lit(chars))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def listed_words(text: Column, listed: list[str]) -> Column:
    """How many words are in the list, in lower case and without punctuation at their end."""
    bare = F.split(F.lower(text), r"[.,;:!?]*[\x20\x09-\x0D]+|[.,;:!?]+\z")
    return F.size(F.filter(bare, lambda x: x.isin(listed)))


def let(value: Column, body) -> Column:
    """``body(value)`` with value evaluated once for each row, however often body refers to it."""
    return F.transform(F.array(value), body)[0]


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of a column's text form, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def labels_of(labels: DataFrame, label: str) -> DataFrame:
    """One row for each labelled document: doc_id, y (0 or 1)."""
    return labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))


def shuffle_key(column: Column, seed: int) -> Column:
    """60 bits of an MD5 over seed and value: an order that other engines can repeat."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def fresh(name: str, *frames: DataFrame) -> str:
    """name, with as many underscores behind it as it takes to differ from the frames' columns, whatever their case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """df materialised in the folder of spark.checkpoint.dir, which all executors share, and read from there."""
    return cut(df)


def checkpointed_in_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """:func:`checkpointed`, where Python functions in df get at most so many rows in a batch, or fewer if the session says so."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = conf.get(name)
    if 0 < int(own) <= rows:
        return checkpointed(df)
    conf.set(name, str(rows))
    try:
        return checkpointed(df)
    finally:
        conf.set(name, own)


def small(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """keys, a materialised table of a few numbers a row, marked for broadcasting if it has at most so many rows."""
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys


def in_parts(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many rows, in no more partitions than these fill: every partition is files in every later shuffle."""
    return df.coalesce(max(1, -(-rows // PART_ROWS)))


def gathered(df: DataFrame) -> DataFrame:
    """df checkpointed and read in no more partitions than its rows fill."""
    out = checkpointed(df)
    return in_parts(out, out.count())
