"""Versions, snapshots and their audits. An order is a card, its line items are the facts."""

from pyspark.sql import functions as F

from .registry import query


@query("SELECT o_custkey, count(*) AS versions, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS current, max(o_orderdate) AS published_at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def current_manifest(t):
    current = F.max(F.struct("o_orderdate", "o_orderkey"))
    return t("orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("versions"), current["o_orderkey"].alias("current"), F.max("o_orderdate").alias("published_at"))


@query("SELECT l_orderkey, count(*) AS facts, string_agg(DISTINCT l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber || ':' || l_partkey) AS content, sha256(string_agg(DISTINCT l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber || ':' || l_partkey)) AS digest FROM lineitem GROUP BY 1")
def snapshot_digest(t):
    """Nested content in a fixed order, and its hash."""
    fact = F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    c = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("facts"), F.array_join(F.array_sort(F.collect_set(fact)), ",").alias("content"))
    return c.withColumn("digest", F.sha2("content", 256))


@query("SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, CASE WHEN a.l_partkey IS NULL THEN 'ADDED' WHEN b.l_partkey IS NULL THEN 'REMOVED' WHEN a.p IS DISTINCT FROM b.p THEN 'CHANGED' ELSE 'SAME' END AS change FROM (SELECT l_partkey, max(l_suppkey) AS p FROM lineitem WHERE year(l_shipdate) = 1995 GROUP BY 1) a FULL JOIN (SELECT l_partkey, max(l_suppkey) AS p FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1) b ON a.l_partkey = b.l_partkey")
def version_diff(t):
    of = lambda y, n: t("lineitem").filter(F.year("l_shipdate") == y).groupBy("l_partkey").agg(F.max("l_suppkey").alias(n))
    a, b = F.col("a"), F.col("b")
    change = F.when(a.isNull(), "ADDED").when(b.isNull(), "REMOVED").when(a != b, "CHANGED").otherwise("SAME")
    return of(1995, "a").join(of(1996, "b"), "l_partkey", "full").select("l_partkey", change.alias("change"))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal >= 0)")
def purge_list(t):
    """Cards of stores that are to be purged."""
    live = t("customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return t("orders").join(live, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, CASE WHEN n IS NULL THEN 'NEW' WHEN open_n = n THEN 'DEFER' WHEN open_n > 0 THEN 'REDRAFT' ELSE 'REASSEMBLE' END AS state FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def entity_card_state(t):
    g = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open_n"))
    state = F.when(F.col("n").isNull(), "NEW").when(F.col("open_n") == F.col("n"), "DEFER").when(F.col("open_n") > 0, "REDRAFT").otherwise("REASSEMBLE")
    return t("customer").select("c_custkey").join(g, "c_custkey", "left").select("c_custkey", state.alias("state"))


@query("""SELECT 'order without lines' AS rule, count(*) AS violations FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'discount out of range', count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 1
UNION ALL SELECT 'unknown status', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F', 'P')""")
def violation_counts(t):
    o, li = t("orders"), t("lineitem")
    rules = [
        ("order without lines", o.join(li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")),
        ("line without order", li.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")),
        ("discount out of range", li.filter("l_discount < 0 OR l_discount > 1")),
        ("unknown status", o.filter("o_orderstatus NOT IN ('O', 'F', 'P')")),
    ]
    counts = [d.agg(F.count("*").alias("violations")).select(F.lit(n).alias("rule"), "violations") for n, d in rules]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("SELECT o_clerk AS key, count(*) AS n FROM (SELECT o_custkey || ':' || o_orderpriority AS o_clerk, o_orderstatus FROM orders) GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def idempotency_conflicts(t):
    """Operation keys that were used with different bodies."""
    o = t("orders").select(F.concat_ws(":", F.col("o_custkey").cast("string"), "o_orderpriority").alias("key"), "o_orderstatus")
    return o.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("o_orderstatus").alias("bodies")).filter("bodies > 1").select("key", "n")


@query("""WITH f AS (SELECT l_orderkey AS card, l_returnflag AS block, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS facts, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey AS card, coalesce(sum(n), 0)::BIGINT AS facts, string_agg(block || '[' || facts || ']', '|' ORDER BY block) AS content, CASE WHEN max(n) IS NULL THEN 'INVALID' ELSE 'OK' END AS state FROM orders LEFT JOIN f ON card = o_orderkey GROUP BY 1""")
def knowledge_content(t):
    """Each card's blocks, and in them its facts, nested and in order; a card without facts is no content. The second grouping keeps the first one's partitioning key."""
    fact = F.struct("l_linenumber", "l_partkey")
    text = lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))
    b = t("lineitem").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("card"), F.col("l_returnflag").alias("block")).agg(F.array_sort(F.collect_list(fact)).alias("facts"))
    line = F.concat("block", F.lit("["), F.array_join(F.transform("facts", text), ","), F.lit("]"))
    c = b.groupBy("card").agg(F.sum(F.size("facts")).alias("facts"), F.array_join(F.array_sort(F.collect_list(line)), "|").alias("content"))
    j = t("orders").select(F.col("o_orderkey").alias("card")).join(c, "card", "left")
    return j.select("card", F.coalesce("facts", F.lit(0)).alias("facts"), "content", F.when(F.col("content").isNull(), "INVALID").otherwise("OK").alias("state"))


@query("""SELECT l_partkey AS fact, count(DISTINCT l_orderkey) AS cards, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS provenance, count(DISTINCT l_linestatus) > 1 AS differs FROM lineitem GROUP BY 1""")
def merged_facts(t):
    """A fact that several cards hold, once, with the union of its sources in order; whether the cards disagree about it."""
    g = t("lineitem").groupBy(F.col("l_partkey").alias("fact"))
    sources = F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda s: s.cast("string")), ",")
    return g.agg(F.count_distinct("l_orderkey").alias("cards"), sources.alias("provenance"), (F.min("l_linestatus") != F.max("l_linestatus")).alias("differs"))


@query("""SELECT user_id AS card, count(*) AS revision, arg_max(event_type, (ts, event_id)) = 'signup' AS visible, max(ts) FILTER (WHERE event_type = 'error') AS last_excluded FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1""")
def card_visibility(t):
    """Whether a card is shown after all that excluded (error) and restored (signup) it; each of these raises the revision."""
    e = t("events").filter("event_type IN ('error', 'signup')").groupBy(F.col("user_id").alias("card"))
    last = F.max(F.struct("ts", "event_id", "event_type"))["event_type"]
    return e.agg(F.count("*").alias("revision"), (last == "signup").alias("visible"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("last_excluded"))


@query("""WITH v AS (SELECT l_suppkey AS card, l_partkey AS fact, max(l_quantity) FILTER (WHERE year(l_shipdate) < 1999) AS old, max(l_quantity) FILTER (WHERE year(l_shipdate) >= 1999) AS now FROM lineitem GROUP BY 1, 2)
SELECT card, fact, CASE WHEN now IS NULL THEN 'ADD' WHEN old IS NULL THEN 'DELETE' WHEN old = now THEN 'KEEP' ELSE 'MODIFY' END AS op, CASE WHEN old IS DISTINCT FROM now THEN old END AS value FROM v""")
def revert_plan(t):
    """The edits that bring a card's present facts back to an older version: both versions come from one pass, so the full join is a grouping."""
    early = F.year("l_shipdate") < 1999
    v = t("lineitem").groupBy(F.col("l_suppkey").alias("card"), F.col("l_partkey").alias("fact")).agg(F.max(F.when(early, F.col("l_quantity"))).alias("old"), F.max(F.when(~early, F.col("l_quantity"))).alias("now"))
    op = F.when(F.col("now").isNull(), "ADD").when(F.col("old").isNull(), "DELETE").when(F.col("old") == F.col("now"), "KEEP").otherwise("MODIFY")
    return v.select("card", "fact", op.alias("op"), F.when(~F.col("old").eqNullSafe(F.col("now")), F.col("old")).alias("value"))


@query("""WITH dead AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT o_orderkey, o_custkey FROM orders JOIN dead ON c_custkey = o_custkey)
SELECT 1 AS step, 'lineitem' AS part, o_custkey AS store, count(*) AS n FROM lineitem JOIN o ON o_orderkey = l_orderkey GROUP BY 3 UNION ALL SELECT 2, 'orders', o_custkey, count(*) FROM o GROUP BY 3 UNION ALL SELECT 3, 'customer', c_custkey, 1 FROM dead""")
def purge_cascade(t):
    """What a purge of stores takes from each table, children before parents, so that no step leaves a row without its parent."""
    dead = t("customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("store"))
    o = t("orders").select(F.col("o_custkey").alias("store"), F.col("o_orderkey").alias("l_orderkey")).join(dead, "store", "left_semi")
    li = t("lineitem").select("l_orderkey").join(o, "l_orderkey").groupBy("store").agg(F.count("*").alias("n"))
    steps = [("lineitem", li), ("orders", o.groupBy("store").agg(F.count("*").alias("n"))), ("customer", dead.withColumn("n", F.lit(1).cast("long")))]
    out = [d.select(F.lit(i + 1).alias("step"), F.lit(name).alias("part"), "store", "n") for i, (name, d) in enumerate(steps)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""WITH e AS (SELECT l_orderkey AS card, max(l_shipdate) AS edited FROM lineitem GROUP BY 1)
SELECT o_orderkey AS card, CASE WHEN c_nationkey % 10 = 0 THEN 'STALE' WHEN o_orderpriority = '1-URGENT' THEN 'SKIPPED_MANUAL' WHEN edited > o_orderdate + INTERVAL 365 DAY THEN 'SKIPPED_NEWER_EDIT' ELSE 'APPLIED' END AS result,
 CASE WHEN c_nationkey % 10 > 0 AND o_orderpriority <> '1-URGENT' AND (edited IS NULL OR edited <= o_orderdate + INTERVAL 365 DAY) THEN c_mktsegment END AS category FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN e ON card = o_orderkey""")
def reclassification_results(t):
    """A job's snapshot of cards against what they are when it writes: stores whose categories moved on stay, as do cards that were set by hand or edited since."""
    edited = t("lineitem").groupBy(F.col("l_orderkey").alias("card")).agg(F.max("l_shipdate").alias("edited"))
    o = t("orders").select(F.col("o_orderkey").alias("card"), F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderpriority")
    j = o.join(t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey").join(edited, "card", "left")
    newer = F.col("edited") > F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")
    result = F.when(F.col("c_nationkey") % 10 == 0, "STALE").when(F.col("o_orderpriority") == "1-URGENT", "SKIPPED_MANUAL").when(newer, "SKIPPED_NEWER_EDIT").otherwise("APPLIED")
    return j.select("card", result.alias("result"), F.when(result == "APPLIED", F.col("c_mktsegment")).alias("category"))
