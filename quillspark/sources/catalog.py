"""Model catalogues read from the source text that declares them: blocks of ``Name = value`` fields, with constants in place of some values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a declaration looks: its block up to the closing brace of its indentation, and constants.
BLOCK = r"(?s)new ModelDescriptor\s*\{(.*?)\n {8}\}"
CONSTANT = r'const\s+string\s+(\w+)\s*=\s*"([^"]+)"'
LEAST_ENTRIES = 4
SUFFIXES = (".bin", ".gguf")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without a match."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def _field(name: str, value: str) -> str:
    """A field by its whole name: ``Url`` is not the end of ``LicenseUrl``."""
    return rf"(?<![A-Za-z]){name}\s*=\s*{value}"


def constants(files: DataFrame) -> DataFrame:
    """path, name, value of the string constants in ``files`` (path, text); of several of one name the last."""
    both = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(CONSTANT), F.lit(i)).alias(c) for i, c in ((1, "name"), (2, "value"))])
    rows = files.select("path", F.posexplode(both).alias("pos", "c"))
    return rows.groupBy("path", F.col("c.name").alias("name")).agg(F.max_by("c.value", "pos").alias("value"))


def parse_catalog(files: DataFrame) -> DataFrame:
    """path, pos, id, url, file, sha256, size of every declared model with an address, from whole source texts (path, text).

    An id is a constant's value, or the name itself where there is no such constant, or a literal, else ``?``. An address is a literal, or a constant and a
    literal behind it (nothing where the constant is unknown). Without a file name the address' last part is the file; without a size it is 0.
    """
    blocks = files.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(BLOCK), F.lit(1))).alias("pos", "block"))
    b = F.col("block")
    rows = blocks.select(
        "path", "pos", _found(b, _field("Id", r"(\w+)\s*,")).alias("id_name"), _found(b, _field("Id", r'"([^"]*)"')).alias("id_text"), _found(b, _field("Url", r'"([^"]*)"')).alias("url_text"),
        _found(b, _field("Url", r'(\w+)\s*\+\s*"([^"]+)"')).alias("base_name"), _found(b, _field("Url", r'(\w+)\s*\+\s*"([^"]+)"'), 2).alias("tail"),
        _found(b, _field("FileName", r'"([^"]*)"')).alias("file"), _found(b, _field("Sha256", r'"([^"]*)"')).alias("sha256"), F.replace(_found(b, r"ApproximateSizeBytes\s*=\s*([0-9_]+)"), F.lit("_"), F.lit("")).alias("size"))
    for name in ("id", "base"):
        known = constants(files).select("path", F.col("name").alias(f"{name}_name"), F.col("value").alias(f"{name}_value"))
        rows = rows.join(known, ["path", f"{name}_name"], "left")
    url = F.coalesce("url_text", F.when(F.col("tail").isNotNull(), F.concat(F.coalesce("base_value", F.lit("")), "tail")))
    rows = rows.withColumn("url", url).where(F.col("url").isNotNull() & (F.col("url") != ""))
    size = F.coalesce(F.try_to_number(F.col("size"), F.lit("9" * 18)).cast("long"), F.lit(0).cast("long"))
    return rows.select("path", F.col("pos").cast("long").alias("pos"), F.coalesce("id_value", "id_name", "id_text", F.lit("?")).alias("id"), "url", F.coalesce("file", F.substring_index("url", "/", -1)).alias("file"), "sha256", size.alias("size"))


def catalog_problems(files: DataFrame, entries: DataFrame) -> DataFrame:
    """path, id, problem: what is wrong with the parsed ``entries`` of ``files``; a file with too few entries has a row without id."""
    tests = [(F.col("id").isin("?", ""), "no id"), (~F.startswith("url", F.lit("https://")), "not https"), (~F.col("url").rlike(r"\.(bin|gguf)$"), "not a model file"), (F.col("size") <= 0, "no size")]
    found = F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in tests]))
    wrong = entries.select("path", "id", F.explode(found).alias("problem"))
    counts = files.select("path").join(entries.groupBy("path").agg(F.count("*").alias("n")), "path", "left").where(F.coalesce("n", F.lit(0)) < LEAST_ENTRIES)
    return wrong.unionByName(counts.select("path", F.lit(None).cast("string").alias("id"), F.lit("too few entries").alias("problem")))
