"""JSON documents and journals of JSON lines, read with explicit schemas; what doesn't parse is null or left out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT = "id string, startMs bigint, endMs bigint, source string, speakerId int, speakerName string, text string, isEdited boolean, confidence float"
ENTRY = f"kind string, at string, metadata struct<folderName: string, title: string, startedAtLocal: string>, segment struct<{', '.join(f'{x.split()[0]}: {x.split()[1]}' for x in SEGMENT.split(', '))}>, durationSeconds double, message string"


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, doc: one row for each file; ``doc`` is null where the file is no such document."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("doc"))


def parse_journal(lines: DataFrame) -> DataFrame:
    """meeting_id, line_no and the entry's fields of ``lines`` (meeting_id, line_no, value); blank and torn lines are skipped."""
    rows = lines.where(F.trim("value") != "").withColumn("e", F.from_json("value", ENTRY, {"mode": "PERMISSIVE"})).where("e.kind IS NOT NULL")
    # a torn line parses as far as it goes: it must end as an object does
    return rows.where(F.rtrim("value").endswith("}")).select("meeting_id", "line_no", "e.kind", "e.at", "e.metadata", "e.segment", F.col("e.segment.id").alias("segment_id"), F.col("e.segment.startMs").alias("start_ms"), F.col("e.segment.text").alias("text"), F.col("e.durationSeconds").alias("duration_seconds"))


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the ``journal.jsonl`` files in the folders below ``path``; a meeting is its folder."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path, wholetext=True)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1)
    return parse_journal(rows.select(folder.alias("meeting_id"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value")))


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON line for each row, in place of what was at ``path``.

    The rows are written beside it first and moved when the job has committed, so a job that fails or is killed leaves the old documents as they were. Between
    the two moves at the end the old ones lie beside ``path``, whole, as ``.old-``.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    folder = path.rstrip("/")
    where = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    staged, old = f"{folder}.staging-{mark}", f"{folder}.old-{mark}"
    try:
        df.write.json(staged)
    except Exception:
        where.delete(at(staged), True)
        raise
    if where.exists(at(folder)):
        where.rename(at(folder), at(old))
    where.rename(at(staged), at(folder))
    where.delete(at(old), True)


def upsert_manifest(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """The manifest with ``entries`` in place of those of the same id, whatever its case; of several new ones the last."""
    last = Window.partitionBy(F.lower("id")).orderBy(F.desc("verified_at"))
    new = entries.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
    keep = manifest.join(new.select(F.lower("id").alias("k")), F.lower(manifest["id"]) == F.col("k"), "left_anti")
    return keep.unionByName(new)


def manifest_entries(manifests: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, wanted, id, file, sha256: the entry of each ``wanted`` id (path, wanted) in its manifest (path, doc with ``entries``), whatever its case; of several of one id the first, nulls where there is none."""
    rows = manifests.select("path", F.posexplode("doc.entries").alias("pos", "e"))
    first = rows.groupBy("path", F.lower("e.id").alias("key")).agg(F.min_by("e", "pos").alias("e"))
    return wanted.withColumn("key", F.lower("wanted")).join(first, ["path", "key"], "left").select("path", "wanted", "e.id", "e.file", "e.sha256")
