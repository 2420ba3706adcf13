"""Cost and usage analytics. A line item is a usage attempt: returnflag N means that its usage is unknown, shipdate its month."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.quantiles import quantiles
from .registry import query

RATES = [("A", "1.50", "0.25"), ("N", "2.00", None), ("R", "0.75", "0.10")]
RATE_SQL = "(VALUES ('A', 1.50, 0.25), ('N', 2.00, NULL), ('R', 0.75, 0.10)) r(model, per_unit, per_tax)"
SCENARIOS = [("LOW", 3, 4), ("BASE", 6, 6), ("HIGH", 12, 9)]
SCENARIO_SQL = "(VALUES ('LOW', 3, 4), ('BASE', 6, 6), ('HIGH', 12, 9)) s(id, people, questions)"


def attempts(t):
    """Line items as attempts with exact decimals."""
    money = lambda c, p: F.col(c).cast(f"decimal({p})")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_returnflag").alias("model"), "l_linestatus", money("l_quantity", "18,2").alias("units"), money("l_tax", "18,2").alias("tax"), money("l_extendedprice", "18,2").alias("price"), "l_shipdate")


ATTEMPTS = "(SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag AS model, l_linestatus, CAST(l_quantity AS DECIMAL(18,2)) AS units, CAST(l_tax AS DECIMAL(18,2)) AS tax, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, l_shipdate FROM lineitem) a"


@query(f"SELECT l_orderkey, count(*) AS attempts, CAST(CASE WHEN bool_and(model <> 'N') THEN sum(price) END AS DOUBLE) AS total, count(*) FILTER (WHERE model = 'N') AS unknown FROM {ATTEMPTS} GROUP BY 1")
def usage_rollup_null_total(t):
    """The total of an order is null unless every attempt is known: an unknown cost isn't zero."""
    a = attempts(t).groupBy("l_orderkey")
    return a.agg(F.count("*").alias("attempts"), F.when(F.bool_and(F.col("model") != "N"), F.sum("price")).cast("double").alias("total"), F.count_if(F.col("model") == "N").alias("unknown"))


@query(f"""SELECT l_orderkey, l_linenumber, CAST(coalesce(units * per_unit, 0) + coalesce(tax * per_tax, 0) AS DOUBLE) AS known_cost, CASE WHEN model = 'R' AND units < 3 THEN 0 WHEN per_tax IS NOT NULL THEN CAST(units * per_unit + tax * per_tax AS DOUBLE) END AS cost,
CASE WHEN model = 'R' AND units < 3 THEN 'PRICED' WHEN per_unit IS NULL THEN 'NO_RATE' WHEN per_tax IS NULL THEN 'UNKNOWN_UNITS' ELSE 'PRICED' END AS price_status FROM {ATTEMPTS} LEFT JOIN {RATE_SQL} USING (model)""")
def priced_attempts(t):
    """The rate card is a fixed handful of rows, so it broadcasts."""
    rates = t.spark.createDataFrame(RATES, "model string, per_unit string, per_tax string").select("model", F.col("per_unit").cast("decimal(10,2)").alias("per_unit"), F.col("per_tax").cast("decimal(10,2)").alias("per_tax"))
    p = attempts(t).join(F.broadcast(rates), "model", "left")
    free = (F.col("model") == "R") & (F.col("units") < 3)
    known = F.coalesce(F.col("units") * F.col("per_unit"), F.lit(0)) + F.coalesce(F.col("tax") * F.col("per_tax"), F.lit(0))
    cost = F.when(free, F.lit(0.0)).when(F.col("per_tax").isNotNull(), (F.col("units") * F.col("per_unit") + F.col("tax") * F.col("per_tax")).cast("double"))
    status = F.when(free, "PRICED").when(F.col("per_unit").isNull(), "NO_RATE").when(F.col("per_tax").isNull(), "UNKNOWN_UNITS").otherwise("PRICED")
    return p.select("l_orderkey", "l_linenumber", known.cast("double").alias("known_cost"), cost.alias("cost"), status.alias("price_status"))


@query(f"SELECT l_linestatus AS stage, count(DISTINCT l_orderkey) AS calls, count(*) AS attempts, round(CAST(sum(price) AS DOUBLE) / count(DISTINCT l_orderkey), 6) AS unit_cost FROM {ATTEMPTS} GROUP BY 1")
def unit_cost_by_stage(t):
    a = attempts(t).groupBy(F.col("l_linestatus").alias("stage"))
    return a.agg(F.countDistinct("l_orderkey").alias("calls"), F.count("*").alias("attempts"), F.round(F.sum("price").cast("double") / F.countDistinct("l_orderkey"), 6).alias("unit_cost"))


@query(f"SELECT l_suppkey, l_linestatus AS stage, CASE WHEN sum(u) OVER (PARTITION BY l_suppkey) = 0 THEN round(c / sum(c) OVER (PARTITION BY l_suppkey), 6) END AS share FROM (SELECT l_suppkey, l_linestatus, CAST(sum(price) AS DOUBLE) AS c, count(*) FILTER (WHERE model = 'N' AND units > 49) AS u FROM {ATTEMPTS} GROUP BY 1, 2)")
def stage_share_suppressed(t):
    """A stage's share of a supplier's cost; not given where any cost is unknown."""
    unknown = F.count_if((F.col("model") == "N") & (F.col("units") > 49))
    g = attempts(t).groupBy("l_suppkey", F.col("l_linestatus").alias("stage")).agg(F.sum("price").cast("double").alias("c"), unknown.alias("u"))
    w = Window.partitionBy("l_suppkey")
    return g.select("l_suppkey", "stage", F.when(F.sum("u").over(w) == 0, F.round(F.col("c") / F.sum("c").over(w), 6)).alias("share"))


@query(f"""SELECT id, CAST(month AS INTEGER) AS month, people * questions * 30 AS questions, round(people * questions * 30 * unit, 6) AS cost, CASE WHEN unit IS NULL THEN 'UNDETERMINED' WHEN people * questions * 30 * unit <= 30000000 THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM {SCENARIO_SQL}, (SELECT month(l_shipdate) AS month, avg(CASE WHEN month(l_shipdate) <> 2 THEN CAST(price AS DOUBLE) END) AS unit FROM {ATTEMPTS} GROUP BY 1)""")
def scenario_projection(t):
    """Each scenario by month of the year: at most twelve months by a fixed handful of scenarios."""
    unit = attempts(t).groupBy(F.month("l_shipdate").alias("month")).agg(F.avg(F.when(F.month("l_shipdate") != 2, F.col("price").cast("double"))).alias("unit"))
    each = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("id", "people", "questions"), s, strict=True))) for s in SCENARIOS))
    asked = F.col("people") * F.col("questions") * 30
    verdict = F.when(F.col("unit").isNull(), "UNDETERMINED").when(asked * F.col("unit") <= 30_000_000, "PASS").otherwise("FAIL")
    return unit.select("*", F.inline(each)).select("id", "month", F.round(asked * F.col("unit"), 6).alias("cost"), verdict.alias("verdict"), asked.alias("questions"))


@query(f"SELECT l_suppkey, min(seq) AS first_breach FROM (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS seq, sum(price) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS spent FROM {ATTEMPTS}) WHERE spent > 1000000 GROUP BY 1")
def budget_running_breach(t):
    """The first attempt at which a supplier's running total passes the cap."""
    running = F.sum("price").over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, 0))
    return attempts(t).withColumn("spent", running).filter("spent > 1000000").groupBy("l_suppkey").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_breach"))


@query(f"SELECT model, min(price) AS low, max(price) AS high, CAST(quantile_cont(CAST(price AS DOUBLE), 0.5) AS DOUBLE) AS median, round(stddev_samp(CAST(price AS DOUBLE)), 4) AS spread FROM (SELECT model, CAST(price AS DOUBLE) AS price FROM {ATTEMPTS}) GROUP BY 1")
def run_variability(t):
    p = F.col("price").cast("double")
    a = attempts(t).select("model", p.alias("price"))
    g = a.groupBy("model").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.round(F.stddev_samp("price"), 4).alias("spread"))
    q = quantiles(a, ["model"], "price", {"median": ("between", 0.5)}).withColumnRenamed("model", "of")
    return g.join(q, F.col("model").eqNullSafe(F.col("of")), "left").select("model", "low", "high", "median", "spread")


@query("""SELECT s_nationkey, count(*) AS n, CASE WHEN bool_and(s_acctbal >= 0) THEN 'COMPLETE' WHEN bool_or(s_acctbal >= 0) THEN 'PARTIAL' ELSE 'UNKNOWN' END AS status, round(sum(CASE WHEN s_acctbal >= 0 THEN s_acctbal END), 4) AS known FROM supplier GROUP BY 1""")
def storage_cost_status(t):
    known = F.col("s_acctbal") >= 0
    status = F.when(F.bool_and(known), "COMPLETE").when(F.bool_or(known), "PARTIAL").otherwise("UNKNOWN")
    return t("supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), status.alias("status"), F.round(F.sum(F.when(known, F.col("s_acctbal"))), 4).alias("known"))


@query("SELECT sum(n)::BIGINT AS rows, (sum(n) - count(*))::BIGINT AS repeats, round(sum(p), 2) AS total FROM (SELECT count(*) AS n, min(l_extendedprice) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def receipt_dedup(t):
    """Receipts are summed once for each key; rows that repeat a key are counted."""
    keyed = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("p"))
    return keyed.agg(F.sum("n").alias("rows"), (F.sum("n") - F.count("*")).alias("repeats"), F.round(F.sum("p"), 2).alias("total"))
