"""Merge chains, prerequisites and cycles. Parts form the graphs: a part's parent is a smaller part by rule."""

from pyspark.sql import functions as F

from ..operators.graph import closure, merge_roots
from .registry import query

#: part k hangs on part k - 3 unless k is one of the first seven of a hundred: chains of at most 34 edges
PARENT = "p_partkey % 100 > 6"


def edges(t):
    return t("part").filter(PARENT).select(F.col("p_partkey").alias("src"), (F.col("p_partkey") - 3).alias("dst"))


RECURSIVE = f"WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey - 3 AS dst FROM part WHERE {PARENT}), c AS (SELECT src, dst, 1 AS hops FROM e UNION ALL SELECT c.src, e.dst, hops + 1 FROM c JOIN e ON e.src = c.dst) "


@query(RECURSIVE + "SELECT src, dst, min(hops) AS hops FROM c GROUP BY 1, 2")
def requires_closure(t):
    return closure(edges(t))


@query(RECURSIVE + "SELECT src AS node, arg_max(dst, hops) AS root, max(hops) AS hops FROM c GROUP BY 1")
def merge_chain_resolve(t):
    return merge_roots(edges(t).select(F.col("src").alias("node"), F.col("dst").alias("into")))


@query(RECURSIVE + "SELECT dst AS node, count(DISTINCT src) AS descendants FROM c GROUP BY 1")
def merged_descendants(t):
    return closure(edges(t)).groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("descendants"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS src, CASE WHEN n_nationkey % 5 = 4 THEN n_nationkey - 2 ELSE n_nationkey + 1 END AS dst FROM nation),
c AS (SELECT src, dst, 1 AS hops FROM e UNION ALL SELECT c.src, e.dst, hops + 1 FROM c JOIN e ON e.src = c.dst WHERE hops < 25) SELECT DISTINCT src AS node FROM c WHERE src = dst""")
def cycle_detect(t):
    """Nodes that reach themselves."""
    n = F.col("n_nationkey")
    e = t("nation").select(n.alias("src"), F.when(n % 5 == 4, n - 2).otherwise(n + 1).alias("dst"))
    return closure(e).filter("src = dst").select(F.col("src").alias("node"))


@query(f"SELECT p_partkey AS src, p_partkey - 3 AS missing FROM part p WHERE {PARENT} AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = p.p_partkey - 3 AND q.p_size > 10)")
def referential_closure(t):
    """Required parts that aren't among the approved ones (larger than 10)."""
    approved = t("part").filter("p_size > 10").select(F.col("p_partkey").alias("dst"))
    return edges(t).join(approved, "dst", "left_anti").select("src", F.col("dst").alias("missing"))
