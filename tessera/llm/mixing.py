"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue of its documents in a fixed pseudo-random order (md5 of doc_id and text), once for each copy. A packet that ends after
`place` words of its queue has the virtual finish time place / target(source). All packets are range-sorted by finish time and summed, and
where the running total reaches the budget the queue is truncated: packets before the cut are taken, the one at the cut gives the words left. A
packet is a copy of a document; only the copy that a source serves at virtual time 1, when the targets are used up, is served in PIECES
pieces, so that a long document can't carry its source past its target by more than a piece.

Prefix sums never gather a source: rows are dealt by (source, digits of the md5), summed per cell, the cells' sums are
accumulated, and rows are accumulated within a cell. The number of digits grows with the number of rows, so a source
with a third of all rows is spread like any other. The range-sorted queue is summed per partition, and only the partition that holds the cut is
accumulated row by row. Only the one-row-per-source and one-row-per-partition tables are ordered in one task.

Null text has size 0, null source is a source of its own (last in order), empty tables give empty results, repeated
rows count each, several texts under one doc_id (null too) are documents of their own; other columns are ignored by `allocate` and kept by `mix`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop_tables, materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
COPIES = 2
ROWS_PER_CELL = 4096
#: Pieces of the document that a source serves when its target is used up.
PIECES = 1024
CELL = ["source_key", "cell"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, copies=COPIES) -> DataFrame:
    """(source_key, source_size, target): weights by the order of sources; what a capped source can't use is reshared.

    With sources in the order of cap/weight, the capped ones come first; the level at which the rest is shared is
    the largest level met at an uncapped source."""
    sums = sized.groupBy("source_key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sums.select(
        "source_key",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long").alias("w"),
        (F.sum("source_size").over(every) * F.lit(float(share))).alias("budget"),
        (F.col("source_size") * copies).alias("cap"),
    )
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "source_key")
    levels = ranked.select(
        "*",
        (
            (F.col("budget") - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            / F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
        ).alias("level"),
    )
    level = F.max(F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("level"))).over(every)
    target = F.coalesce(F.least(F.col("cap").cast("double"), level * F.col("w")), F.col("cap").cast("double"))
    return levels.select("source_key", "source_size", target.alias("target"))


def sized(docs: DataFrame, *kept: Column) -> DataFrame:
    """kept, source, source_key, size, shuffled (the place in the queue's order) of each document."""
    text = F.col("text")
    known = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return docs.select(*kept, "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("source_key"), word_count(text).alias("size"), F.md5(known).alias("shuffled"))


def in_cells(rows: DataFrame, digits: int) -> DataFrame:
    return rows.withColumn("cell", F.substring("shuffled", 1, digits))


def placed(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows with source_size, target and before (words of the queue before them)."""
    in_cell = Window.partitionBy(*CELL).orderBy("shuffled", "size").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(cells, CELL).withColumn("before", F.col("cell_before") + F.coalesce(F.sum("size").over(in_cell), F.lit(0)))


def packets(low: Column) -> Column:
    """The packets (place of the end, words) of a copy of a document that begins after `low` words of its queue."""
    size, target = F.col("size"), F.col("target")
    n = F.when((low < target) & (low + size > target), F.least(size, F.lit(PIECES))).otherwise(F.lit(1)).cast("long")
    end = lambda i: F.floor(size * i / n)
    return F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: F.struct((low + end(i)).alias("place"), (end(i) - end(i - 1)).alias("words")))


def low_of(copy: int) -> Column:
    return F.col("source_size") * copy + F.col("before")


def queue(rows: DataFrame, copies: int) -> DataFrame:
    """All packets in the order of service: finish, source_key, place, words, and the number of their range partition."""
    each = F.concat(*(packets(low_of(c)) for c in range(copies)))
    found = rows.filter("size > 0 AND target > 0").select("source_key", "target", F.explode(each).alias("p")).select((F.col("p.place") / F.col("target")).alias("finish"), "source_key", "p.place", "p.words")
    return found.repartitionByRange("finish", "source_key", "place").sortWithinPartitions("finish", "source_key", "place").withColumn("part", F.spark_partition_id())


def cut_of(queued: DataFrame, budget: int) -> tuple | None:
    """(finish, source_key, place, words taken of it) of the packet at which the running total reaches the budget; None if none does."""
    totals = queued.groupBy("part").agg(F.sum("words").alias("total"))
    running = totals.withColumn("to", F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))
    part = running.filter(F.col("to") >= budget).orderBy("part").select("part", (F.col("to") - F.col("total")).alias("before")).first()
    if part is None:
        return None
    order = Window.orderBy("finish", "source_key", "place").rowsBetween(Window.unboundedPreceding, 0)
    inside = queued.filter(F.col("part") == part.part).withColumn("to", part.before + F.sum("words").over(order))
    at = inside.filter(F.col("to") >= budget).orderBy("finish", "source_key", "place").first()
    return at.finish, at.source_key, at.place, budget - (at.to - at.words)


def served(copy: int, cut: tuple | None) -> Column:
    """Words of the given copy (0: the first) before the cut."""
    each = packets(low_of(copy))
    if cut is not None:
        finish, source_key, place, words = cut
        mine = lambda p: p["place"] / F.col("target")
        here = F.col("source_key") == source_key
        whole = lambda p: (mine(p) < finish) | ((mine(p) == finish) & ((F.col("source_key") < source_key) | (here & (p["place"] < place))))
        taken = lambda p: F.when(whole(p), p["words"]).when(here & (p["place"] == place), F.lit(words)).otherwise(F.lit(0))
        total = F.aggregate(each, F.lit(0).cast("long"), lambda a, p: a + taken(p).cast("long"))
    else:
        total = F.col("size")
    return F.when((F.col("size") > 0) & (F.col("target") > 0), total).otherwise(F.lit(0)).cast("long")


def plan(docs: DataFrame, weights, share: float, copies: int) -> tuple[DataFrame, DataFrame, int, tuple | None]:
    """The placed documents without texts, the cells of the queues, their digits, and the cut."""
    rows = materialise(sized(docs, F.col("doc_id")), "mix-sized")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    digits = max(2, math.ceil(math.log(max(1, n / ROWS_PER_CELL), 16)))
    rows = in_cells(rows, digits)
    targets = source_targets(rows, weights, share, copies)
    sums = rows.groupBy(*CELL).agg(F.sum("size").alias("cell_size"))
    in_source = Window.partitionBy("source_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = sums.join(targets, "source_key").select(*CELL, "source_size", "target", F.coalesce(F.sum("cell_size").over(in_source), F.lit(0)).alias("cell_before"))
    cells = materialise(cells, "mix-cells")
    found = materialise(placed(rows, cells).select("doc_id", "size", "source_key", "source_size", "target", "before"), "mix-placed")
    queued = materialise(queue(found, copies), "mix-queue")
    cut = cut_of(queued, math.floor(total * share + 0.5))
    drop_tables(queued)
    return found, cells, digits, cut


def allocate(docs: DataFrame, weights=WEIGHTS, share=SHARE, copies=COPIES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, virtual_finish (of its first copy), before
    (words of its source's queue before it)."""
    found, _, _, cut = plan(docs, weights, share, copies)
    taken = sum((served(c, cut) for c in range(1, copies)), served(0, cut))
    finish = F.when(F.col("target") > 0, (F.col("before") + F.col("size")) / F.col("target"))
    return found.select("doc_id", "size", "source_size", "target", taken.alias("taken"), finish.alias("virtual_finish"), "before")


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, copies=COPIES) -> DataFrame:
    """The mixed documents: each copy taken is a row with docs' columns, globally sorted by virtual finish time.

    A copy cut at the end of service keeps its first words with the white space before each, and n_chars, where there is one, follows."""
    _, cells, digits, cut = plan(docs, weights, share, copies)
    rows = placed(in_cells(sized(docs, F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row")), digits), cells)
    service = F.array(*(F.struct(served(c, cut).cast("int").alias("words"), (low_of(c) + F.col("size")).alias("place")) for c in range(copies)))
    taken = rows.select("row", "size", "source_key", "target", F.explode(service).alias("c")).filter("c.words > 0")
    ordered = taken.orderBy(F.col("c.place") / F.col("target"), "source_key", "c.place")
    text = F.col("row.text")
    cut_text = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("c.words")), "")
    cut_text = F.when(F.col("c.words") < F.col("size"), cut_text).otherwise(text)
    new = {"text": cut_text.alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(cut_text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return ordered.select(*(new.get(n, F.col(f"row.`{n}`").alias(n)) for n in docs.columns))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS source_key, row_number() OVER () AS row,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS shuffled
  FROM documents),
sums AS (SELECT source_key, min(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
ranked AS (
  SELECT source_key, source_size, 2 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS budget,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sums),
levels AS (
  SELECT *, (budget - coalesce(CAST(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
         / CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM ranked),
targets AS (
  SELECT source_key, source_size,
         coalesce(least(CAST(cap AS DOUBLE), max(CASE WHEN cap > level * w THEN level END) OVER () * w), CAST(cap AS DOUBLE)) AS target
  FROM levels),
placed AS (
  SELECT row, doc_id, source_key, size, source_size, target,
         CAST(coalesce(sum(size) OVER (PARTITION BY source_key ORDER BY shuffled, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized JOIN targets USING (source_key)),
copies AS (
  SELECT *, c * source_size + before AS low,
         CASE WHEN c * source_size + before < target AND c * source_size + before + size > target THEN least(size, 1024) ELSE 1 END AS n
  FROM placed, (VALUES (0), (1)) t(c) WHERE size > 0 AND target > 0),
pieces AS (SELECT *, unnest(generate_series(1, n)) AS i FROM copies),
packets AS (SELECT row, source_key, target, low + (size * i) // n AS place, (size * i) // n - (size * (i - 1)) // n AS words FROM pieces),
queue AS (
  SELECT *, CAST(sum(words) OVER (ORDER BY place / target, source_key, place ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM packets),
served AS (
  SELECT row, sum(greatest(0, least(words, (SELECT CAST(floor(sum(size) * CAST(1.5 AS DOUBLE) + 0.5) AS BIGINT) FROM sized) - (total - words)))) AS words
  FROM queue GROUP BY row)
SELECT doc_id, size, source_size, target, CAST(coalesce(s.words, 0) AS BIGINT) AS taken FROM placed LEFT JOIN served s USING (row)
"""
