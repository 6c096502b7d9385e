"""Materialised stages, shared by the operators of this package.

Hot keys: aggregates here are algebraic, so Spark combines them before the shuffle; joins that bring a group's answer
back to its rows are plain sort-merge joins whose hot partitions adaptive execution splits.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share for checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Where nothing is set and Spark runs inside one process, as in
    tests, a temporary folder does; on a cluster without the setting this raises.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quillspark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder; later plans read those files.

    Used where a plan must not be evaluated twice (ids handed out by position) and where lineage would grow with
    each round of an iteration. A lost executor costs nothing that the folder does not hold.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def marked_documents(docs: DataFrame) -> DataFrame:
    """doc_id, mark and text of the rows that have both; ``mark`` tells the texts of one id apart.

    It is a hash of the text, or 0 throughout where no id has two texts, as is usual: then it costs nothing in the shuffles.
    """
    rows = with_columns_of(docs, doc_id="bigint", text="string").where("doc_id IS NOT NULL AND text IS NOT NULL")
    mark = F.hash("text")
    several = rows.select("doc_id", mark.alias("mark")).groupBy("doc_id").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low < high")
    return rows.select("doc_id", (F.lit(0) if several.isEmpty() else mark).alias("mark"), "text")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder and read again, for the rounds of an iteration.

    What the optimiser knows of a checkpoint's rows (which columns are equal or differ) it carries on to all that is made of it, so it
    piles up from round to round in the driver; of a table it knows nothing.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` for a join that sorts and merges both sides, whatever their size: it is never gathered in the driver to be broadcast."""
    return df.hint("merge")


def with_columns_of(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns of ``df``, cast to the named types, so that other columns can't clash with ours."""
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in wanted.items()])
