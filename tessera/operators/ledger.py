"""The fact ledger: keys, exact duplicates, near names, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separates the fields of a hashed key.
FIELD = "\x1f"


def digest(*parts: Column) -> Column:
    """sha256 of the fields in order; null is the empty field."""
    return F.sha2(F.concat_ws(FIELD, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def first_of(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """key, first (the least order value) and n of each group: partial minima meet, not rows."""
    return rows.groupBy(*key).agg(F.min(order).alias("first"), F.count("*").alias("n"))


def edit_one_pairs(names: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id, left_name, right_name) of names that differ by one edit, through shared one-deletion neighbours.

    names: id, name. A name and each of its one-deletions are its codes; names one edit apart share a code, so an equi-join on codes finds them."""

    def codes(df: DataFrame, side: str) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.concat(F.substring(F.col("name"), F.lit(1), i - 1), F.substring(F.col("name"), i + 1, F.length("name"))))
        return df.filter(F.length("name") >= 3).select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.explode(F.array_distinct(F.array_union(F.array("name"), cut))).alias("code"))

    pairs = codes(names, "left").join(codes(names if other is None else other, "right"), "code").filter((F.col("left_id") < F.col("right_id")) & (F.col("left_name") != F.col("right_name")))
    return pairs.drop("code").distinct().filter(F.levenshtein("left_name", "right_name", 1) == 1)


def open_conflicts(facts: DataFrame) -> DataFrame:
    """facts: slot, identity, fact_id. Slots with more than one identity: (slot, low_id, high_id) between identities' first facts, next to each other
    in the order of first facts - a chain for each slot, which keeps the group linked without all its pairs."""
    from pyspark.sql import Window

    firsts = facts.groupBy("slot", "identity").agg(F.min("fact_id").alias("high_id"))
    before = F.lag("high_id").over(Window.partitionBy("slot").orderBy("high_id"))
    return firsts.withColumn("low_id", before).filter("low_id IS NOT NULL").select("slot", "low_id", "high_id")
