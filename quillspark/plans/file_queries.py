"""Queries that write files of rows derived from the driver's tables into the shared folder and read them back, with the DuckDB SQL for what must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.operators import imports
from quillspark.operators.lineage import shared_folder, written
from quillspark.sources import documents
from quillspark.sources.wav_source import read_wav, save_wav
from quillspark.streaming import capture

from . import adapters as ad

RATE = 16000


def _recordings(spark, sf_dir) -> str:
    """A WAV file for each stream of events, in a new folder."""
    folder = f"{shared_folder(spark)}/wav-{uuid.uuid4().hex}"
    blocks = ad.short_blocks(spark, sf_dir).select(F.concat(F.lit("s"), F.col("stream").cast("string"), F.lit(".wav")).alias("path"), "block", F.lit(RATE).alias("sample_rate"), "samples")
    save_wav(blocks, folder)
    return folder


def _stream(path):
    return F.regexp_extract(path, r"s([0-9]+)\.wav$", 1).cast("long").alias("stream")


def wav_round_trip(spark, sf_dir):
    rows = read_wav(spark, _recordings(spark, sf_dir), block_samples=50, split_bytes=1000)
    rows = rows.select(_stream(F.col("path")), "sample_rate", "start_sample", F.posexplode("samples").alias("i", "y"))
    return rows.select("stream", "sample_rate", (F.col("start_sample") + F.col("i")).alias("pos"), F.round(F.col("y").cast("double") * 32768).cast("long").alias("y"))


def audio_imports(spark, sf_dir):
    found = imports.import_audio(spark, _recordings(spark, sf_dir), f"{shared_folder(spark)}/imported-{uuid.uuid4().hex}", RATE)
    return found.select(_stream(F.col("path")), "refusal", "duration_seconds", F.round(F.col("peak").cast("double") * 32768).cast("long").alias("peak"), "clipped")


def reimport_reasons(spark, sf_dir):
    c = F.col("c_custkey")
    meetings = ad.table(spark, sf_dir, "customer").select(c.alias("meeting_id"), F.when(c % 5 != 0, F.concat(F.lit("/in/"), c.cast("string"), F.lit(".wav"))).otherwise(F.lit(" ")).alias("imported_from"))
    working = ad.table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("meeting_id"))
    originals = ad.table(spark, sf_dir, "supplier").select(F.concat(F.lit("/in/"), F.col("s_suppkey").cast("string"), F.lit(".wav")).alias("path"))
    return imports.reimports(meetings, working, originals)


def documents_replaced(spark, sf_dir):
    """Metadata documents written, then written anew, then read back."""
    path = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    rows = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("meeting_id"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("durationSeconds"))
    documents.write_documents(rows.limit(10), path)
    documents.write_documents(rows, path)
    return spark.read.schema("meeting_id long, title string, durationSeconds double").json(path).withColumnRenamed("durationSeconds", "duration_seconds")


def manifest_lookups(spark, sf_dir):
    """Parts as the entries of manifests of ten, each asked for one id in capitals and one that it has not. Tasks put their files in place themselves: nobody reads the folder of a run that failed."""
    p = F.col("p_partkey")
    folder = f"{shared_folder(spark)}/manifests-{uuid.uuid4().hex}"
    rows = ad.table(spark, sf_dir, "part").select(F.floor(p / 10).alias("m"), p.alias("p"), F.concat(F.lit("model-"), (p % 7).cast("string")).alias("id"), F.col("p_name").alias("file"), F.when(p % 2 == 0, F.col("p_brand")).alias("sha256"))
    docs = rows.groupBy("m").agg(F.sort_array(F.collect_list(F.struct("p", F.struct("id", "file", "sha256").alias("e")))).alias("x"))
    docs.select("m", F.to_json(F.struct(F.transform("x", lambda r: r["e"]).alias("entries"))).alias("value")).repartition("m").write.partitionBy("m").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)
    found = documents.read_documents(spark, folder, "entries array<struct<id string, file string, sha256 string>>")
    manifests = written(found.select(F.regexp_extract("path", r"/m=([0-9]+)/", 1).alias("path"), "doc"))
    wanted = manifests.select("path", F.explode(F.array(F.lit("MODEL-3"), F.lit("none"))).alias("wanted"))
    return documents.manifest_entries(manifests, wanted)


def journals_written(spark, sf_dir):
    """A stream of entries through the journal's sink, one of its two sources missing, and back."""
    folder = f"{shared_folder(spark)}/journal-{uuid.uuid4().hex}"
    rows = ad.table(spark, sf_dir, "events").select(F.col("user_id").alias("meeting_id"), F.col("event_id").alias("line_no"), F.col("event_type").alias("kind"))
    rows.write.parquet(f"{folder}/in")
    entries = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    capture.write_journal(capture.degraded_union(None, entries), f"{folder}/out", f"{folder}/state", None).awaitTermination()
    return spark.read.schema(rows.schema).json(f"{folder}/out")


QUERIES = {f.__name__: f for f in (wav_round_trip, audio_imports, reimport_reasons, documents_replaced, manifest_lookups, journals_written)}
_Q = "round_even(least(greatest(value, -1.0), 1.0) * 32767, 0)"
SQL = {
    "wav_round_trip": f"WITH {ad.LEVELS_SQL} SELECT stream, CAST(16000 AS INTEGER) AS sample_rate, seq - 1 AS pos, CAST({_Q} AS BIGINT) AS y FROM levels",
    # twice through 16 bits: read as a share of 32,768, written as one of 32,767
    "audio_imports": f"""WITH {ad.LEVELS_SQL}, q AS (SELECT stream, round_even(CAST({_Q} AS DOUBLE) / 32768 * 32767, 0) AS y FROM levels)
SELECT stream, NULL AS refusal, count(*) / CAST(16000 AS DOUBLE) AS duration_seconds, CAST(max(abs(y)) AS BIGINT) AS peak, count(*) FILTER (abs(y) / 32768 >= 0.999) / CAST(count(*) AS DOUBLE) >= 1e-4 AS clipped FROM q GROUP BY stream""",
    "documents_replaced": "SELECT c_custkey AS meeting_id, c_name AS title, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS duration_seconds FROM customer",
    "manifest_lookups": """WITH e AS (SELECT CAST(p_partkey // 10 AS VARCHAR) AS path, 'model-' || p_partkey % 7 AS id, p_name AS file, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS sha256, p_partkey AS p FROM part),
f AS (SELECT * FROM e WHERE id = 'model-3' QUALIFY row_number() OVER (PARTITION BY path ORDER BY p) = 1), m AS (SELECT DISTINCT path FROM e)
SELECT path, 'MODEL-3' AS wanted, id, file, sha256 FROM m LEFT JOIN f USING (path) UNION ALL SELECT path, 'none', NULL, NULL, NULL FROM m""",
    "journals_written": "SELECT user_id AS meeting_id, event_id AS line_no, event_type AS kind FROM events",
    "reimport_reasons": """SELECT c_custkey AS meeting_id, CASE WHEN c_custkey % 5 <> 0 THEN '/in/' || c_custkey || '.wav' END AS source,
CASE WHEN c_custkey % 5 = 0 THEN 'not imported' WHEN c_custkey NOT IN (SELECT s_suppkey FROM supplier) THEN 'original missing' END AS reason FROM customer WHERE c_custkey NOT IN (SELECT 2 * o_custkey FROM orders)""",
}
