"""File kinds, inventories, JSON snapshots and appending only what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What reads a file, by extension.
READERS = {"txt": "chat", "csv": "table", "pdf": "pages", "docx": "blocks", "html": "blocks", "htm": "blocks", "mp3": "voice", "m4a": "voice", "mp4": "video", "png": "scan", "jpg": "scan"}


def reader_of(path: Column) -> Column:
    """The reader for a path or url by its extension; null if there is none."""
    name = F.regexp_extract(F.regexp_replace(F.lower(path), r"[?#].*$", ""), r"\.([a-z0-9]{1,5})$", 1)
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in READERS.items() for x in pair)), name)


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length and time of each file; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def write_snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write df as JSON lines under a path that nothing has been written to, and read it back with its own schema."""
    df.write.mode("error").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def checked_json(lines: DataFrame, schema: str) -> DataFrame:
    """lines: line. The parsed fields, and `corrupt`: the line itself where it doesn't fit the schema."""
    parsed = F.from_json("line", f"{schema}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    return lines.select(parsed.alias("x")).select("x.*")


def only_new(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new, once each, whose key isn't in old."""
    return new.dropDuplicates(key).join(old.select(*key).distinct(), key, "left_anti")
