"""From raw documents to packed sequences: five stages, each one of the operators in codeloom.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
in a folder below spark.checkpoint.dir and read again as the next stage's docs. All but
the last return the columns of documents.

Every stage takes what its operator takes: a null text is an empty one, repeated rows are
documents of their own (copies, for near dedup), an empty table gives an empty table, and
columns beyond those of documents pass through. What a stage does with rows without a
doc_id stands in its docstring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import line_dedup, mixing, packing, simhash, toxicity
from codeloom.llm.common import shared_folder, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go, with or without a doc_id; without labels of both classes none does.

    Labels are learnt from the documents they belong to in sf_dir; a labelled doc_id of several rows counts once.
    """
    model = toxicity.trained_by_fold(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.below(docs, model)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages keep their first occurrence; documents that consist of later ones only go.

    Rows without a doc_id stay as they are; rows that share one lose the same lines.
    """
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    A row without a doc_id stays only if no copy has one; unlike texts that share a doc_id all stay. Rows with
    neither an id nor a word stay, other rows without a word are copies of each other.
    """
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares, documents repeated or left out as the schedule says.

    Rows are told apart by themselves and not by their doc_id; a null source is one of its own; rows without a word go.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every row with its place in a sequence; a null doc_id stays null."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: Learnt scores, XXH64 and a tokenizer are beyond SQL; the stages are tested one by one against plain Python (tests/llm/test_brute_force.py).
ORACLE_SQL = None


def _path(spark: SparkSession, name: str):
    """A path and its file system, which may be one that only Spark's readers can open."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over the documents of sf_dir.

    In a given folder all stages are kept, and a run that begins again there goes on
    after the last one that was finished. Without one, a stage's table is removed when
    the next one is written.
    """
    base = folder or f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        done, files = _path(spark, f"{base}/{name}/_SUCCESS")
        if not (folder and files.exists(done)):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before and not folder:
            files.delete(_path(spark, before)[0], True)
        before = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
