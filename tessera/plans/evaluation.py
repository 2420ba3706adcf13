"""Scoring of extraction and grouping runs, and heads of edited facts. Lines are claims of a ledger (part: subject, return flag: attribute, quantity: value),
parts are the truth (size: value), finished lines are what reached a card."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query

TRUTH = "(SELECT p_partkey AS subject, CASE WHEN p_size % 4 > 0 THEN substr('NRA', p_size % 4, 1) END AS attribute, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_size > 5)"


def truth(t):
    """Subject, attribute (null: any) and value of each true fact."""
    kind = F.col("p_size") % 4
    attribute = F.when(kind > 0, F.substring(F.lit("NRA"), kind, F.lit(1)))
    return t("part").filter("p_size > 5").select(F.col("p_partkey").alias("subject"), attribute.alias("attribute"), F.col("p_size").cast("double").alias("value"))


@query(f"""SELECT t.subject, t.in_ledger, t.in_card, CASE WHEN in_ledger AND in_card THEN 'OK' WHEN in_ledger THEN 'ASSEMBLY' WHEN in_card THEN 'CARD_ONLY' ELSE 'EXTRACTION' END AS stage FROM (
SELECT subject, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = subject AND l_quantity = value AND (attribute IS NULL OR l_returnflag = attribute)) AS in_ledger,
 EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = subject AND l_quantity = value AND l_linestatus = 'F') AS in_card FROM {TRUTH}) t""")
def ledger_loss_stage(t):
    """At which stage a true fact was lost: facts and ledger rows meet on subject and value, and flags combine before the shuffle."""
    lines = t("lineitem").groupBy(F.col("l_partkey").alias("subject"), F.col("l_quantity").alias("value"))
    held = lines.agg(F.collect_set("l_returnflag").alias("attributes"), F.bool_or(F.col("l_linestatus") == "F").alias("card"))
    j = truth(t).join(held, ["subject", "value"], "left")
    there = F.col("attributes").isNotNull() & (F.col("attribute").isNull() | F.array_contains("attributes", F.col("attribute")))
    j = j.select("subject", F.coalesce(there, F.lit(False)).alias("in_ledger"), F.coalesce("card", F.lit(False)).alias("in_card"))
    stage = F.when(F.col("in_ledger") & F.col("in_card"), "OK").when(F.col("in_ledger"), "ASSEMBLY").when(F.col("in_card"), "CARD_ONLY").otherwise("EXTRACTION")
    return j.select("*", stage.alias("stage"))


@query(f"""WITH judged AS (SELECT l_suppkey AS run, CASE WHEN t.subject IS NULL OR (t.attribute IS NOT NULL AND t.attribute <> l_returnflag) THEN 'UNVERIFIED' WHEN t.value = l_quantity THEN 'MATCHED' ELSE 'CONFLICT' END AS verdict
 FROM lineitem LEFT JOIN {TRUTH} t ON t.subject = l_partkey)
SELECT run, count(*) AS claims, count(*) FILTER (WHERE verdict = 'MATCHED') AS matched, count(*) FILTER (WHERE verdict = 'CONFLICT') AS conflicts, count(*) FILTER (WHERE verdict = 'UNVERIFIED') AS unverified,
 round(count(*) FILTER (WHERE verdict = 'MATCHED') / count(*), 4) AS precision_lower, round(count(*) FILTER (WHERE verdict <> 'CONFLICT') / count(*), 4) AS precision_upper, round(count(*) FILTER (WHERE verdict = 'UNVERIFIED') / count(*), 4) AS undetermined_rate
FROM judged GROUP BY 1""")
def claim_precision_bounds(t):
    """The truth isn't complete, so precision is a range: unverified claims all wrong, or all right."""
    j = t("lineitem").join(truth(t), F.col("subject") == F.col("l_partkey"), "left")
    none = F.col("subject").isNull() | F.coalesce(F.col("attribute") != F.col("l_returnflag"), F.lit(False))
    verdict = F.when(none, "UNVERIFIED").when(F.col("value") == F.col("l_quantity"), "MATCHED").otherwise("CONFLICT")
    n = F.count("*")
    count = lambda v: F.count_if(F.col("verdict") == v)
    g = j.select(F.col("l_suppkey").alias("run"), verdict.alias("verdict")).groupBy("run")
    return g.agg(
        n.alias("claims"), count("MATCHED").alias("matched"), count("CONFLICT").alias("conflicts"), count("UNVERIFIED").alias("unverified"), F.round(count("MATCHED") / n, 4).alias("precision_lower"),
        F.round((n - count("CONFLICT")) / n, 4).alias("precision_upper"), F.round(count("UNVERIFIED") / n, 4).alias("undetermined_rate"),
    )


@query("""SELECT o_orderkey AS run, CASE WHEN total > 0 AND failed = total THEN 'DEAD' WHEN cards = 0 THEN 'DEAD' WHEN failed > 0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS health,
CASE WHEN total > 0 AND failed = total THEN 'all_sources_failed' WHEN cards = 0 THEN 'no_cards' END AS reason
FROM (SELECT o_orderkey, count(l_orderkey) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, count(*) FILTER (WHERE l_linestatus = 'F' OR l_returnflag = 'N') AS cards FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""")
def run_health(t):
    """A run whose sources all failed, or that made no card, is no measurement; one that lost some sources is not like one that lost none."""
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.count_if((F.col("l_linestatus") == "F") | (F.col("l_returnflag") == "N")).alias("cards"))
    j = t("orders").select(F.col("o_orderkey").alias("run")).join(lines, "run", "left").fillna(0, ["total", "failed", "cards"])
    lost, empty = (F.col("total") > 0) & (F.col("failed") == F.col("total")), F.col("cards") == 0
    health = F.when(lost | empty, "DEAD").when(F.col("failed") > 0, "PARTIAL").otherwise("SUCCEEDED")
    return j.select("run", health.alias("health"), F.when(lost, "all_sources_failed").when(empty, "no_cards").alias("reason"))


@query("""WITH q AS (SELECT c_custkey AS id, c_mktsegment AS scope, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS grp FROM customer),
judged AS (SELECT a.grp IS NOT NULL AND a.grp = b.grp AS merged, a.scope = b.scope AS expected FROM q a JOIN q b ON b.id = a.id + 1),
pairs AS (SELECT a.scope <> b.scope AS across FROM q a JOIN q b ON a.id < b.id AND a.grp = b.grp)
SELECT count(*) FILTER (WHERE expected AND coalesce(merged, false)) AS true_merge, count(*) FILTER (WHERE NOT expected AND coalesce(merged, false)) AS false_merge, count(*) FILTER (WHERE expected AND NOT coalesce(merged, false)) AS false_split,
 count(*) FILTER (WHERE NOT expected AND NOT coalesce(merged, false)) AS true_separation, (SELECT count(*) FROM pairs) - count(*) FILTER (WHERE coalesce(merged, false)) AS unjudged_merged, (SELECT count(*) FILTER (WHERE across) FROM pairs) AS scope_violations FROM judged""")
def grouping_evaluation(t):
    """Pair counts of a grouping against reviewed pairs (neighbours; they should share a group if they share a scope). Merged pairs are counted from
    group sizes, never listed; null is an abstention."""
    q = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("scope"), F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("grp"))
    after = q.select((F.col("id") - 1).alias("id"), F.col("scope").alias("scope2"), F.col("grp").alias("grp2"))
    merged, expected = F.coalesce(F.col("grp") == F.col("grp2"), F.lit(False)), F.col("scope") == F.col("scope2")
    judged = q.join(after, "id").agg(
        F.count_if(expected & merged).alias("true_merge"), F.count_if(~expected & merged).alias("false_merge"), F.count_if(expected & ~merged).alias("false_split"), F.count_if(~expected & ~merged).alias("true_separation"), F.count_if(merged).alias("seen"),
    )
    two = lambda n: (n * (n - 1) / 2).cast("long")
    inner = q.filter("grp IS NOT NULL").groupBy("grp", "scope").agg(F.count("*").alias("n"))
    groups = inner.groupBy("grp").agg(F.sum("n").alias("n"), F.sum(two(F.col("n"))).alias("inside"))
    sums = groups.agg(F.coalesce(F.sum(two(F.col("n"))), F.lit(0)).alias("merged"), F.coalesce(F.sum("inside"), F.lit(0)).alias("inside"))
    key = F.lit(1).alias("k")  # one row on either side
    j = judged.select("*", key).join(sums.select("*", key), "k")
    return j.select("true_merge", "false_merge", "false_split", "true_separation", (F.col("merged") - F.col("seen")).alias("unjudged_merged"), (F.col("merged") - F.col("inside")).alias("scope_violations"))


@query("""WITH f AS (SELECT l_orderkey AS card, l_linenumber AS fact, CASE WHEN l_quantity >= 10 THEN CAST(l_quantity AS INTEGER) % 3 END AS step, l_returnflag || l_linestatus AS sentence, l_suppkey % 2 AS variant, l_discount > 0.08 AS marked FROM lineitem)
SELECT card, fact, step, CASE WHEN step IS NULL OR marked THEN step WHEN EXISTS (SELECT 1 FROM f g WHERE g.card = f.card AND g.variant = f.variant AND g.step = f.step AND g.sentence <> f.sentence AND NOT g.marked) THEN NULL
 WHEN EXISTS (SELECT 1 FROM f g WHERE g.card = f.card AND g.sentence = f.sentence AND g.step <> f.step) THEN NULL ELSE step END AS kept FROM f""")
def normalised_step_orders(t):
    """A number stays a step if its sentence marks an order, or if it stands alone: not shared with another unmarked sentence of its variant, and not one of
    several numbers of one sentence. Least and largest over a card tell both, so no pairs are made."""
    l = t("lineitem")
    step = F.when(F.col("l_quantity") >= 10, F.col("l_quantity").cast("int") % 3)
    f = l.select(F.col("l_orderkey").alias("card"), F.col("l_linenumber").alias("fact"), step.alias("step"), F.concat("l_returnflag", "l_linestatus").alias("sentence"), (F.col("l_suppkey") % 2).alias("variant"), (F.col("l_discount") > 0.08).alias("marked"))
    numbered, said = Window.partitionBy("card", "variant", "step"), Window.partitionBy("card", "sentence")
    plain = F.when(~F.col("marked"), F.col("sentence"))
    shared = F.min(plain).over(numbered) != F.max(plain).over(numbered)
    listed = F.min("step").over(said) != F.max("step").over(said)
    kept = F.when(F.col("step").isNull() | F.col("marked"), F.col("step")).when(F.coalesce(shared, F.lit(False)) | F.coalesce(listed, F.lit(False)), None).otherwise(F.col("step"))
    return f.select("card", "fact", "step", kept.cast("int").alias("kept"))


@query("""WITH r AS (SELECT o_custkey AS fact, o_orderkey AS rev, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS relink, o_orderstatus AS entity FROM orders),
p AS (SELECT fact, max(n) FILTER (WHERE relink IS FALSE) AS pinned FROM r GROUP BY 1),
h AS (SELECT r.fact, max(r.n) AS head, coalesce(max(p.pinned), 1) AS pinned, arg_max(entity, n) AS head_entity FROM r JOIN p USING (fact) GROUP BY 1)
SELECT h.fact, a.rev AS pinned_rev, b.rev AS head_rev, CASE WHEN head_entity <> a.entity THEN 'MOVED_ENTITY' WHEN head > pinned + 2 THEN 'CHANGED_ELSEWHERE' END AS block, CASE WHEN head_entity = a.entity AND head <= pinned + 2 THEN b.rev END AS base
FROM h JOIN r a ON a.fact = h.fact AND a.n = pinned JOIN r b ON b.fact = h.fact AND b.n = head""")
def head_classification(t):
    """How each fact's head stands to its pinned revision: the same or relinked only, over at most two steps here (the base of an edit), moved to another
    entity, or changed elsewhere. The pinned one is the last that isn't a mere relink, else the first."""
    order = Window.partitionBy("fact").orderBy("o_orderdate", "rev")
    o = t("orders").select(F.col("o_custkey").alias("fact"), F.col("o_orderkey").alias("rev"), "o_orderdate", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM").alias("relink"), F.col("o_orderstatus").alias("entity"))
    r = o.withColumn("n", F.row_number().over(order))
    row = F.struct("n", "rev", "entity")
    g = r.groupBy("fact").agg(F.max(row).alias("head"), F.max(F.when(~F.col("relink"), row)).alias("last"), F.min(row).alias("first"))
    g = g.select("fact", "head", F.coalesce("last", "first").alias("pinned"))
    moved, far = F.col("head.entity") != F.col("pinned.entity"), F.col("head.n") > F.col("pinned.n") + 2
    return g.select("fact", F.col("pinned.rev").alias("pinned_rev"), F.col("head.rev").alias("head_rev"), F.when(moved, "MOVED_ENTITY").when(far, "CHANGED_ELSEWHERE").alias("block"), F.when(~moved & ~far, F.col("head.rev")).alias("base"))
