"""Queries of parsed source texts, journal lines, features, and operators that take a callable (here a plain one), with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import conversion, recurrence, speech, summaries
from quillspark.sources import catalog, documents

from . import adapters as ad
from .oracles import LEVELS_SQL, _FOLD, _biquad

RATE = 1600


def _sources(spark, sf_dir):
    """Ten parts to a source text that declares models in several ways."""
    p = F.col("p_partkey")
    n, k = p.cast("string"), p % 5
    constant = F.when(k.isin(0, 2), F.concat(F.lit('    public const string Model'), n, F.lit(' = "model-'), n, F.lit('";\n'))).otherwise("")
    ident = F.when(k == 1, F.concat(F.lit('Id = "literal-'), n, F.lit('",\n'))).when(k == 3, F.lit("")).otherwise(F.concat(F.lit("Id = Model"), n, F.lit(",\n")))
    url = F.when(k == 2, F.concat(F.lit('Url = BaseUrl + "'), n, F.lit('.bin",\n'))).when(k == 4, F.lit("")).otherwise(F.concat(F.lit('Url = "'), F.when(p % 3 == 0, "http").otherwise("https"), F.lit("://host/x/"), n, F.when(p % 4 == 0, ".zip").otherwise(".gguf"), F.lit('",\n')))
    size = F.when(p % 7 != 0, F.concat(F.lit("ApproximateSizeBytes = 1_"), F.lpad((p % 1000).cast("string"), 3, "0"), F.lit(",\n"))).otherwise("")
    digest = F.when(p % 2 == 0, F.concat(F.lit('Sha256 = "'), F.col("p_brand"), F.lit('",\n'))).otherwise("")
    block = F.concat(F.lit("        new ModelDescriptor\n        {\n"), ident, F.lit('LicenseUrl = "https://license",\n'), url, size, digest, F.lit("        },\n"))
    rows = ad.table(spark, sf_dir, "part").select(F.floor(p / 10).cast("string").alias("path"), p.alias("p"), constant.alias("c"), block.alias("b"))
    text = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", c))), lambda r: r[c]), "")
    return rows.groupBy("path").agg(F.concat(F.lit('    const string BaseUrl = "https://base/";\n'), text("c"), text("b")).alias("text"))


def catalog_entries(spark, sf_dir):
    return catalog.parse_catalog(_sources(spark, sf_dir))


def catalog_problems(spark, sf_dir):
    files = _sources(spark, sf_dir)
    return catalog.catalog_problems(files, catalog.parse_catalog(files))


def journal_lines(spark, sf_dir):
    """Journals as text with blank, foreign and torn lines among the entries."""
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, "Progress").otherwise("Segment")
    entry = F.to_json(F.struct(kind.alias("kind"), F.struct(e.cast("string").alias("id"), (e * 10).alias("startMs"), F.col("event_type").alias("text")).alias("segment"), F.when(e % 3 == 0, F.col("value")).alias("durationSeconds")))
    line = F.when(e % 11 == 0, "  ").when(e % 11 == 1, "nonsense").when(e % 11 == 2, F.expr("left(entry, length(entry) - 3)")).otherwise(F.col("entry"))
    rows = ad.table(spark, sf_dir, "events").withColumn("entry", entry).select(F.col("user_id").alias("meeting_id"), e.alias("line_no"), line.alias("value"))
    return documents.parse_journal(rows).select("meeting_id", "line_no", "kind", "segment_id", "start_ms", "text", "duration_seconds")


def recognised_spans(spark, sf_dir):
    """Blocks as chunks, and a recogniser that names the chunk; one in four says nothing."""
    chunks = ad.short_blocks(spark, sf_dir).select(F.col("stream").alias("meeting_id"), F.lit("Microphone").alias("source"), F.col("block").alias("seq"), (F.col("block") * 2).alias("start_ms"), "samples")
    name = lambda: lambda x, seq: [(0, len(x) * 1000 // 16000, f" chunk-{seq} " if seq % 4 else "  ", 0.5)]
    return speech.recognised(chunks, name)


def model_answers(spark, sf_dir):
    """The beginning of a prompt as its answer; a model that fails on long prompts, where the extractive minutes stand in."""
    rows = ad.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("response_id"), F.lit(0).cast("long").alias("block"), F.coalesce("text", F.lit("")).alias("prompt"))

    def make():
        def model(prompt: str) -> str:
            if len(prompt) > 2000:
                raise ValueError("too long")
            return prompt[:20]

        return model

    extractive = rows.select("response_id", F.lit("extract").alias("markdown"))
    return summaries.minutes_or_fallback(summaries.inferred(rows, make), extractive)


def sample_downsampled(spark, sf_dir):
    out = conversion.resampled(ad.short_blocks(spark, sf_dir), 32000, 16000)
    rows = out.select("stream", "block", F.posexplode("samples").alias("at", "y"))
    return rows.select("stream", (F.col("block") * 16 + F.col("at")).cast("long").alias("pos"), F.round("y", 9).alias("y"))


def sample_equalised(spark, sf_dir):
    rows = recurrence.equalised(ad.short_blocks(spark, sf_dir), 16000).select("stream", "block", F.posexplode("samples").alias("at", "y"))
    return rows.select("stream", (F.col("block") * 32 + F.col("at")).cast("long").alias("pos"), F.round("y", 9).alias("y"))


def sample_adaptive_downmix(spark, sf_dir):
    """Two channels at a rate so low that a stream's second block decides; in every other stream the second channel is nearly the first one turned over."""
    rows = ad.levels(spark, sf_dir).select("stream", F.floor((F.col("seq") - 1) / 16).alias("block"), "seq", "value")
    second = F.when(F.col("stream") % 2 == 0, -0.9 * F.col("value")).otherwise(0.5 * F.col("value"))
    blocks = rows.groupBy("stream", "block").agg(F.sort_array(F.collect_list(F.struct("seq", F.array(F.col("value"), second).alias("x")))).alias("x")).select("stream", "block", F.flatten(F.transform("x", lambda v: v["x"])).alias("samples"))
    out = conversion.adaptively_downmixed(blocks, 2, 50).select("stream", "block", F.posexplode("samples").alias("at", "y"))
    return out.select("stream", (F.col("block") * 16 + F.col("at")).cast("long").alias("pos"), F.round("y", 9).alias("y"))


def sample_cepstra(spark, sf_dir):
    """At a rate so low that a block of 64 samples has two frames."""
    rows = speech.cepstra_rows(ad.short_blocks(spark, sf_dir, 64), RATE)
    return rows.withColumn("value", F.round("value", 6))


QUERIES = {f.__name__: f for f in (catalog_entries, catalog_problems, journal_lines, recognised_spans, model_answers, sample_downsampled, sample_equalised, sample_adaptive_downmix, sample_cepstra)}

_CATALOG = """e AS (SELECT CAST(p_partkey // 10 AS VARCHAR) AS path, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) - 1 AS pos, p_partkey AS p, p_brand,
  CASE p_partkey % 5 WHEN 1 THEN 'literal-' || p_partkey WHEN 3 THEN '?' WHEN 4 THEN 'Model' || p_partkey ELSE 'model-' || p_partkey END AS id,
  CASE p_partkey % 5 WHEN 4 THEN NULL WHEN 2 THEN 'https://base/' || p_partkey || '.bin' ELSE CASE WHEN p_partkey % 3 = 0 THEN 'http' ELSE 'https' END || '://host/x/' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '.zip' ELSE '.gguf' END END AS url FROM part),
entries AS (SELECT path, pos, id, url, regexp_extract(url, '[^/]*$') AS file, CASE WHEN p % 2 = 0 THEN p_brand END AS sha256, CAST(CASE WHEN p % 7 <> 0 THEN 1000 + p % 1000 ELSE 0 END AS BIGINT) AS size FROM e WHERE url IS NOT NULL)"""
_LOW = "SELECT (1 - c) / 2 / (1 + alpha) AS b0, (1 - c) / (1 + alpha) AS b1, -2 * c / (1 + alpha) AS a1, (1 - alpha) / (1 + alpha) AS a2 FROM (SELECT cos(w) AS c, sin(w) / (2 * sqrt(CAST(0.5 AS DOUBLE))) AS alpha FROM (SELECT 2 * pi() * 7200 / 32000 AS w))"
SQL = {
    "catalog_entries": f"WITH {_CATALOG} SELECT * FROM entries",
    "catalog_problems": f"""WITH {_CATALOG} SELECT path, id, 'no id' AS problem FROM entries WHERE id = '?' UNION ALL SELECT path, id, 'not https' FROM entries WHERE url LIKE 'http:%' UNION ALL SELECT path, id, 'not a model file' FROM entries WHERE url LIKE '%.zip'
UNION ALL SELECT path, id, 'no size' FROM entries WHERE size = 0 UNION ALL SELECT path, NULL, 'too few entries' FROM e GROUP BY path HAVING count(url) < 4""",
    "journal_lines": """SELECT user_id AS meeting_id, event_id AS line_no, CASE WHEN event_id % 3 = 0 THEN 'Progress' ELSE 'Segment' END AS kind, CAST(event_id AS VARCHAR) AS segment_id, event_id * 10 AS start_ms, event_type AS text,
CASE WHEN event_id % 3 = 0 THEN value END AS duration_seconds FROM events WHERE event_id % 11 > 2""",
    "recognised_spans": f"""WITH {LEVELS_SQL}, b AS (SELECT stream, (seq - 1) // 32 AS block, count(*) AS n FROM levels GROUP BY ALL)
SELECT stream AS meeting_id, 'Microphone' AS source, block AS seq, block * 2 AS start_ms, block * 2 + 1000 AS end_ms, 'chunk-' || block AS text, CAST(0.5 AS DOUBLE) AS confidence FROM b WHERE block % 4 <> 0""",
    "model_answers": """WITH a AS (SELECT doc_id, CASE WHEN length(text) <= 2000 THEN nullif(nullif(trim(left(text, 20), chr(32) || chr(9) || chr(10) || chr(13)), ''), 'なし') END AS answer FROM documents)
SELECT doc_id AS response_id, coalesce(answer, 'extract') AS markdown, CASE WHEN answer IS NULL THEN 'extractive' ELSE 'local' END AS generator, CASE WHEN answer IS NULL THEN 'no answer of the model' END AS reason FROM a""",
    "sample_downsampled": _FOLD.format(levels=LEVELS_SQL) + f"""
l AS MATERIALIZED (SELECT stream, seq, value AS x FROM levels), k AS MATERIALIZED ({_LOW}),
f AS (SELECT stream, CAST(0 AS BIGINT) AS seq, CAST(0 AS DOUBLE) AS z, CAST(0 AS DOUBLE) AS s1, CAST(0 AS DOUBLE) AS t1, CAST(0 AS DOUBLE) AS s2, CAST(0 AS DOUBLE) AS t2 FROM n
  UNION ALL SELECT stream, seq, z, b1 * x - a1 * y + t1, b0 * x - a2 * y, b1 * y - a1 * z + t2, b0 * y - a2 * z FROM (SELECT *, b0 * y + s2 AS z FROM (
    SELECT l.stream, l.seq, l.x, f.t1, f.s2, f.t2, k.b0, k.b1, k.a1, k.a2, k.b0 * l.x + f.s1 AS y FROM f JOIN l ON l.stream = f.stream AND l.seq = f.seq + 1, k))),
s AS (SELECT stream, list(z ORDER BY seq) AS x FROM f WHERE seq > 0 GROUP BY stream), i AS (SELECT stream, x, unnest(range((len(x) + 1) // 2)) AS i FROM s)
SELECT stream, i AS pos, round(x[greatest(2 * i - 1, 1)], 9) AS y FROM i""",
    "sample_equalised": _biquad("2 * pi() * 3000 / 16000", "pow(10, CAST(6 AS DOUBLE) / 40) AS g, sqrt(2 * pow(10, CAST(6 AS DOUBLE) / 40)) * sin(w) AS r",
                                "g * (g + 1 + (g - 1) * c + r) AS b0, -2 * g * (g - 1 + (g + 1) * c) AS b1, g * (g + 1 + (g - 1) * c - r) AS b2, g + 1 - (g - 1) * c + r AS a0, 2 * (g - 1 - (g + 1) * c) AS a1, g + 1 - (g - 1) * c - r AS a2").replace(
        "SELECT stream, seq - 1 AS pos, round(y, 9) AS y FROM f", """,
h AS (SELECT 1 AS i, b0 AS y, b1 - a1 * b0 AS s, b2 - a2 * b0 AS t FROM k UNION ALL SELECT i + 1, s, -a1 * s + t, -a2 * s FROM h, k WHERE i < 8192), m AS (SELECT sum(abs(y)) AS norm FROM h)
SELECT stream, seq - 1 AS pos, round(y / norm, 9) AS y FROM f CROSS JOIN m""").replace("\n,\nh AS", ",\nh AS"),
    "sample_adaptive_downmix": f"""WITH {LEVELS_SQL}, v AS (SELECT stream, seq, (seq - 1) // 16 AS block, value AS a, CASE WHEN stream % 2 = 0 THEN -0.9 * value ELSE 0.5 * value END AS b FROM levels),
g AS (SELECT stream, block, sum(((a + b) / 2) * ((a + b) / 2)) AS mean_energy, sum(a * a + b * b) / 2 AS energy, count(*) AS n FROM v GROUP BY stream, block),
c AS (SELECT stream, block, sum(mean_energy) OVER o AS me, sum(energy) OVER o AS e, sum(n) OVER o AS seen FROM g WHERE sqrt(energy / n) >= pow(10, CAST(-55 AS DOUBLE) / 20) WINDOW o AS (PARTITION BY stream ORDER BY block ROWS UNBOUNDED PRECEDING)),
d AS (SELECT stream, min(block) AS decided, arg_min(10 * log10(greatest(me / e, 1e-12)) < -10 * log10(2) - 6, block) AS first_only FROM c WHERE seen >= 25 GROUP BY stream)
SELECT stream, seq - 1 AS pos, round(CASE WHEN block > decided AND first_only THEN a ELSE (a + b) / 2 END, 9) AS y FROM v LEFT JOIN d USING (stream)""",
    # frames of 40 samples every 16, a transform of 64, 26 triangles from 80 to 800 Hz, 13 cosines
    "sample_cepstra": f"""WITH {LEVELS_SQL}, x AS (SELECT stream, (seq - 1) // 64 AS block, (seq - 1) % 64 AS i, value FROM levels), n AS (SELECT stream, block, count(*) AS n FROM x GROUP BY ALL),
w AS (SELECT n.stream, n.block, f.frame, x.i - 16 * f.frame AS j, x.value * (0.54 - 0.46 * cos(2 * pi() * (x.i - 16 * f.frame) / 39)) AS v FROM n JOIN (SELECT unnest(range(3)) AS frame) f ON 16 * f.frame + 40 <= n.n JOIN x ON x.stream = n.stream AND x.block = n.block AND x.i BETWEEN 16 * f.frame AND 16 * f.frame + 39),
p AS (SELECT stream, block, frame, bin, (sum(v * cos(2 * pi() * bin * j / 64)) ** 2 + sum(v * sin(2 * pi() * bin * j / 64)) ** 2) / 64 AS power FROM w CROSS JOIN (SELECT unnest(range(33)) AS bin) GROUP BY ALL),
h AS (SELECT i, 700 * (pow(10, (lo + (hi - lo) * i / 27) / 2595) - 1) * 64 / 1600 AS edge FROM (SELECT unnest(range(28)) AS i, 2595 * log10(1 + CAST(80 AS DOUBLE) / 700) AS lo, 2595 * log10(1 + CAST(800 AS DOUBLE) / 700) AS hi)),
t AS (SELECT a.i AS filter, bin, greatest(least((bin - a.edge) / (b.edge - a.edge), (c.edge - bin) / (c.edge - b.edge)), 0) AS weight FROM h a JOIN h b ON b.i = a.i + 1 JOIN h c ON c.i = a.i + 2 CROSS JOIN (SELECT unnest(range(33)) AS bin)),
e AS (SELECT stream, block, frame, filter, ln(greatest(sum(power * weight), 1e-10)) AS energy FROM p JOIN t USING (bin) GROUP BY ALL)
SELECT stream, block, frame, coefficient, round(sum(energy * cos(pi() * coefficient * (2 * filter + 1) / 52)), 6) AS value FROM e CROSS JOIN (SELECT unnest(range(13)) AS coefficient) GROUP BY ALL""",
}
