"""Line dedup by distinct-site spread.

Each line (cut at \\n, trimmed of blanks, of MIN_CHARS characters at least) is known by the md5 of its bytes. A HyperLogLog sketch of
its sites merges by aggregation; where the estimate is near MIN_SITES the sites are counted exactly. A
line on MIN_SITES sites or more is boilerplate: it stays where it comes first (smallest doc_id, then position) and goes everywhere else.

Only keys and positions are shuffled for the search. The list of boilerplate lines is a written table, so Spark broadcasts it when
its size allows and otherwise sorts, splitting hot lines; texts are shuffled once, by document, to drop lines.

Null text stays null, an empty text stays empty; a null source is one site of its own; short lines stay; repeated rows (same doc_id and text) are
treated alike; a text whose lines all go becomes empty. Other columns are kept, and n_chars is set anew where there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

MIN_SITES = 8
MIN_CHARS = 12
#: Estimates within this share of MIN_SITES are counted exactly; six standard errors of the sketch at least.
NEAR = 0.25
SKETCH_BITS = 12
BLANKS = " \t\r"


def exploded(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, site, pos, key of each line that is long enough."""
    lines = docs.filter(F.col("text").isNotNull()).select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("site"),
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"),
    )
    line = F.btrim("raw", F.lit(BLANKS))
    return lines.filter(F.length(line) >= MIN_CHARS).select("doc_id", "text_hash", "site", "pos", F.unhex(F.md5(line)).alias("key"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """key and first (doc_id, text_hash, pos) of each line on min_sites sites or more."""
    lines = exploded(docs)
    place = F.struct("doc_id", "text_hash", "pos")
    spread = lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("about"), F.min(place).alias("first"))
    # beyond the few that stand out no line is written
    found = materialise(spread.filter(F.col("about") >= min_sites * (1 - NEAR)), "lines-spread")
    sure = F.col("about") > min_sites * (1 + NEAR)
    near = found.filter(~sure).select("key", "first")
    exact = lines.select("key", "site").join(near.select("key"), "key", "left_semi").distinct().groupBy("key").count().filter(F.col("count") >= min_sites)
    return materialise(found.filter(sure).select("key", "first").unionByName(near.join(exact.select("key"), "key", "left_semi")), "lines-boilerplate")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with repeated boilerplate lines taken out of text, and n_lines and n_removed (columns of these names are replaced)."""
    names = [n for n in docs.columns if n not in ("n_lines", "n_removed")]
    bad = boilerplate(docs, min_sites)
    place = F.struct("doc_id", "text_hash", "pos")
    drop = exploded(docs).join(bad, "key").filter(~place.eqNullSafe(F.col("first"))).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))
    keyed = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"), "doc_id", F.xxhash64("text").alias("text_hash")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.text_hash") == F.col("x.text_hash"))
    joined = keyed.join(drop.alias("x"), same, "left").select("row", "gone")
    old = F.col("row.text")
    lines = F.split(old, "\n", -1)
    left = F.transform(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")), lambda i: F.get(lines, i))
    text = F.when(F.col("gone").isNull(), old).otherwise(F.array_join(left, "\n"))
    new = {"text": text.alias("text")}
    if "n_chars" in names:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return joined.select(
        *(new.get(n, F.col(f"row.`{n}`").alias(n)) for n in names),
        F.when(old.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, text, coalesce('=' || source, 'null') AS site, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS raw
  FROM documents WHERE text IS NOT NULL),
keyed AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM lines),
spread AS (SELECT line, count(DISTINCT site) AS sites FROM keyed WHERE length(line) >= 12 GROUP BY 1),
judged AS (
  SELECT k.*, s.line IS NOT NULL AND row_number() OVER (PARTITION BY k.line ORDER BY k.doc_id, k.pos) > 1 AS goes
  FROM keyed k LEFT JOIN spread s ON s.line = k.line AND s.sites >= 8),
done AS (
  SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT goes), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_removed
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE x.text END AS text, coalesce(x.n_lines, 0) AS n_lines, coalesce(x.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN done x USING (doc_id)
"""
