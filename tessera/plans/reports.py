"""Verdicts on expected facts, gates over repeated runs, reports bound to what was judged, and audits of the truth itself."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .answers import LINES, lines
from ..operators.quantiles import quantiles
from .registry import query

VERDICTS = ("MISSING", "PARTIAL", "UNDETERMINED", "COVERED")


@query("""WITH s AS (SELECT p_partkey AS fact, l_orderkey AS card, l_linestatus = 'F' AS named, l_quantity = p_size AS held, p_partkey % 3 = 0 AS needs, CASE WHEN p_size % 2 = 0 THEN 'HOT' ELSE 'ICE' END AS want, CASE l_returnflag WHEN 'R' THEN 'HOT' WHEN 'A' THEN 'ICE' END AS variant, l_tax = 0.08 AS denied
 FROM part LEFT JOIN lineitem ON l_partkey = p_partkey),
v AS (SELECT fact, card, coalesce(named, false) AS named, coalesce(held, false) AS held, CASE WHEN card IS NULL THEN 0 WHEN variant IS NOT NULL AND variant <> want THEN 1 WHEN NOT held THEN 1 WHEN needs AND variant IS NULL THEN 1 WHEN NOT named THEN 1 WHEN denied THEN 2 ELSE 3 END AS rank FROM s)
SELECT fact, CASE rank WHEN 0 THEN 'MISSING' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'UNDETERMINED' ELSE 'COVERED' END AS verdict, card, held FROM (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY rank DESC, named DESC, held DESC, card) AS n FROM v) WHERE n = 1""")
def fact_verdicts(t):
    """The best verdict that one card gives a fact: covered if subject, value, variant and attribute stand in it and nothing denies them; the other variant, another value
    or an unnamed attribute make it partial. Claims that say the same of a subject are one row, with the first card, before they meet the facts, and that combines before the shuffle,
    so a subject that all cards name is no hot task."""
    f = t("part").select(F.col("p_partkey").alias("fact"), "p_size", F.when(F.col("p_size") % 2 == 0, "HOT").otherwise("ICE").alias("want"), (F.col("p_partkey") % 3 == 0).alias("needs"))
    c = t("lineitem").select(
        F.col("l_partkey").alias("fact"), F.col("l_orderkey").alias("card"), (F.col("l_linestatus") == "F").alias("named"), "l_quantity", F.when(F.col("l_returnflag") == "R", "HOT").when(F.col("l_returnflag") == "A", "ICE").alias("variant"), (F.col("l_tax") == 0.08).alias("denied")
    )
    c = c.groupBy("fact", "named", "l_quantity", "variant", "denied").agg(F.min("card").alias("card"))
    held = F.col("l_quantity") == F.col("p_size")
    partial = (F.col("variant").isNotNull() & (F.col("variant") != F.col("want"))) | ~held | (F.col("needs") & F.col("variant").isNull()) | ~F.col("named")
    rank = F.when(F.col("card").isNull(), 0).when(partial, 1).when(F.col("denied"), 2).otherwise(3)
    no = F.lit(False)
    best = F.max(F.struct(rank.alias("rank"), F.coalesce("named", no).alias("named"), F.coalesce(held, no).alias("held"), (-F.col("card")).alias("card"))).alias("b")
    b = f.join(c, "fact", "left").groupBy("fact").agg(best)
    return b.select("fact", F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("b.rank") + 1).alias("verdict"), (-F.col("b.card")).alias("card"), F.col("b.held").alias("held"))


@query("""WITH q AS (SELECT c_nationkey AS campaign, o_custkey AS question, year(o_orderdate) - 1995 AS pair, CASE WHEN o_custkey % 25 = 0 AND count(*) FILTER (WHERE o_orderstatus = 'P') = count(*) THEN NULL ELSE bool_or(o_orderstatus = 'F') END AS before, bool_or(o_totalprice > 200000) AS after
 FROM orders JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) BETWEEN 1995 AND 1997 GROUP BY 1, 2, 3),
k AS (SELECT question FROM q GROUP BY 1 HAVING count(*) = 3), f AS (SELECT q.* FROM q JOIN k USING (question)),
d AS (SELECT campaign, pair, count(*) FILTER (WHERE after) - count(*) FILTER (WHERE before) AS delta FROM f GROUP BY 1, 2),
p AS (SELECT campaign, count(*) FILTER (WHERE delta > 0) AS rising, median(delta) AS middle FROM d GROUP BY 1),
s AS (SELECT campaign, count(DISTINCT question) AS questions, count(DISTINCT question) FILTER (WHERE before IS NULL OR after IS NULL) AS unjudged, count(DISTINCT question) FILTER (WHERE question % 20 = 0 AND before AND NOT after) AS regressions FROM f GROUP BY 1)
SELECT campaign, questions, unjudged, regressions, CASE WHEN unjudged = 0 THEN middle END AS median_delta, concat_ws(',', CASE WHEN unjudged > 0 THEN 'UNJUDGED_RESULTS' END, CASE WHEN regressions > 0 THEN 'MUST_HAVE_REGRESSION' END, CASE WHEN unjudged = 0 AND middle < 5 THEN 'BELOW_EFFECT_THRESHOLD' END,
 CASE WHEN unjudged = 0 AND rising * 3 < 6 THEN 'INSUFFICIENT_POSITIVE_PAIRS' END) AS reasons FROM s JOIN p USING (campaign)""")
def paired_gate(t):
    """Three paired runs of the questions that all of them asked: why the candidate may not pass. One unjudged answer leaves the effect unknown; a must-have question that was right and
    is wrong blocks whatever the effect."""
    o = t("orders").withColumn("pair", F.year("o_orderdate") - 1995).filter("pair BETWEEN 0 AND 2").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("campaign")), "o_custkey")
    before = F.when((F.col("o_custkey") % 25 != 0) | (F.count_if(F.col("o_orderstatus") == "P") < F.count("*")), F.bool_or(F.col("o_orderstatus") == "F"))
    q = o.groupBy("campaign", F.col("o_custkey").alias("question"), "pair").agg(before.alias("before"), F.bool_or(F.col("o_totalprice") > 200000).alias("after"))
    q = q.withColumn("n", F.count("*").over(Window.partitionBy("campaign", "question"))).filter("n = 3")
    one = lambda c: F.count_if(c)
    lost = (F.col("question") % 20 == 0) & F.coalesce(F.col("before") & ~F.col("after"), F.lit(False))
    d = q.groupBy("campaign", "pair").agg((one(F.col("after")) - one(F.col("before"))).alias("delta")).groupBy("campaign").agg(F.median("delta").alias("middle"), F.count_if(F.col("delta") > 0).alias("rising"))
    per = q.groupBy("campaign", "question").agg(F.bool_or(F.col("before").isNull() | F.col("after").isNull()).alias("unjudged"), F.bool_or(lost).alias("lost"))
    s = per.groupBy("campaign").agg(F.count("*").alias("questions"), F.count_if("unjudged").alias("unjudged"), F.count_if("lost").alias("regressions")).join(d, "campaign")
    known = F.col("unjudged") == 0
    reasons = F.concat_ws(
        ",", F.when(~known, "UNJUDGED_RESULTS"), F.when(F.col("regressions") > 0, "MUST_HAVE_REGRESSION"), F.when(known & (F.col("middle") < 5), "BELOW_EFFECT_THRESHOLD"), F.when(known & (F.col("rising") * 3 < 6), "INSUFFICIENT_POSITIVE_PAIRS")
    )
    return s.select("campaign", "questions", "unjudged", "regressions", F.when(known, F.col("middle")).alias("median_delta"), reasons.alias("reasons"))


@query("""WITH a AS (SELECT conv_id, turn, sha256(text) AS row_hash FROM conversations WHERE role = 'assistant'),
j AS (SELECT conv_id, turn, sha256(CASE WHEN turn % 4 = 1 THEN text ELSE text || '!' END) AS judged_hash, length(text) % 3 > 0 AS correct FROM conversations WHERE role = 'assistant' AND (conv_id % 3 > 0 OR turn = 1))
SELECT a.conv_id, count(*) AS answers, count(judged_hash) FILTER (WHERE judged_hash = row_hash) AS judged, count(judged_hash) FILTER (WHERE judged_hash <> row_hash) AS foreign_judgments,
 CASE WHEN count(*) = count(judged_hash) FILTER (WHERE judged_hash = row_hash) THEN round(count(*) FILTER (WHERE correct) / count(*), 4) END AS correct_rate FROM a LEFT JOIN j USING (conv_id, turn) GROUP BY 1""")
def bound_judgments(t):
    """A judgment counts only for the very text that was judged (its hash); the rate is null while any answer is unjudged."""
    c = t("conversations").filter("role = 'assistant'")
    a = c.select("conv_id", "turn", F.sha2("text", 256).alias("row_hash"))
    seen = F.when(F.col("turn") % 4 == 1, F.col("text")).otherwise(F.concat("text", F.lit("!")))
    j = c.filter("conv_id % 3 > 0 OR turn = 1").select("conv_id", "turn", F.sha2(seen, 256).alias("judged_hash"), (F.length("text") % 3 > 0).alias("correct"))
    same = F.col("judged_hash") == F.col("row_hash")
    g = a.join(j, ["conv_id", "turn"], "left").groupBy("conv_id").agg(F.count("*").alias("answers"), F.count_if(same).alias("judged"), F.count_if(~same).alias("foreign_judgments"), F.count_if("correct").alias("right"))
    return g.select("conv_id", "answers", "judged", "foreign_judgments", F.when(F.col("judged") == F.col("answers"), F.round(F.col("right") / F.col("answers"), 4)).alias("correct_rate"))


@query("""SELECT event_type AS scope, count(*) AS total, count(*) FILTER (WHERE event_id % 3 = 0) AS reviewed, count(*) FILTER (WHERE event_id % 11 = 0) AS failed, count(*) FILTER (WHERE event_id % 3 = 0 AND event_id % 5 = 0) AS wrong, round(quantile_cont(value, 0.5), 6) AS p50,
 list_sort(list(value))[CAST(ceil(count(*) * 0.95) AS INTEGER)] AS p95, max(value) AS slowest FROM events GROUP BY 1""")
def shadow_report(t):
    """Observations of a scope: how many were reviewed, failed or found wrong, and their latency. Quantiles are exact and hold no scope in a task."""
    reviewed = F.col("event_id") % 3 == 0
    counts = (F.count("*").alias("total"), F.count_if(reviewed).alias("reviewed"), F.count_if(F.col("event_id") % 11 == 0).alias("failed"), F.count_if(reviewed & (F.col("event_id") % 5 == 0)).alias("wrong"))
    g = t("events").groupBy(F.col("event_type").alias("scope")).agg(*counts, F.max("value").alias("slowest"))
    rank = quantiles(t("events").select(F.col("event_type").alias("of"), "value"), ["of"], "value", {"p50": ("between", 0.5), "p95": ("nearest", 0.95)})
    return g.join(rank, F.col("scope").eqNullSafe(F.col("of")), "left").select("scope", "total", "reviewed", "failed", "wrong", F.round("p50", 6).alias("p50"), "p95", "slowest")


@query("""WITH f AS (SELECT l_suppkey AS store, l_orderkey || ':' || l_linenumber AS fact, l_partkey AS source, l_returnflag AS label, l_tax = 0 AS unplaced, p_type, p_partkey IS NULL AS dangling FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 2)
SELECT store, count(*) AS facts, count(*) - count(DISTINCT fact) AS repeated, count(DISTINCT source) FILTER (WHERE dangling) AS dangling, count(*) FILTER (WHERE unplaced) AS no_locator, count(DISTINCT p_type) AS types, count(*) FILTER (WHERE label = 'R') AS must_have FROM f GROUP BY 1""")
def truth_audit(t):
    """What is wrong with a store's truth: repeated fact ids, sources that its manifest lacks, facts without a place, and which source types it has."""
    p = t("part").filter("p_size > 2").select(F.col("p_partkey").alias("source"), "p_type", F.lit(True).alias("known"))
    f = t("lineitem").select(F.col("l_suppkey").alias("store"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("fact"), F.col("l_partkey").alias("source"), "l_returnflag", "l_tax")
    g = f.join(p, "source", "left").groupBy("store")
    return g.agg(
        F.count("*").alias("facts"), (F.count("*") - F.count_distinct("fact")).alias("repeated"), F.count_distinct(F.when(F.col("known").isNull(), F.col("source"))).alias("dangling"), F.count_if(F.col("l_tax") == 0).alias("no_locator"),
        F.count_distinct("p_type").alias("types"), F.count_if(F.col("l_returnflag") == "R").alias("must_have"),
    )


@query("""WITH c AS (SELECT l_orderkey AS answer, l_linestatus = 'F' AS published, l_tax > 0.04 AS drafted, l_returnflag = 'A' AS blocked, l_partkey FROM lineitem WHERE l_discount > 0.05)
SELECT o_orderkey AS answer, CASE WHEN o_orderkey % 10 = 0 THEN 'NO_FACTS' WHEN n IS NULL THEN 'FACTS_PENDING' WHEN changed > 0 OR held > 0 THEN 'REVIEW' WHEN fresh > 0 THEN 'PUBLISH' ELSE 'LINKED' END AS outcome,
 CASE WHEN o_orderkey % 10 = 0 OR n IS NULL THEN 'NEW' WHEN changed > 0 THEN 'SUPPLEMENT' WHEN fresh > 0 THEN 'NEW' ELSE 'IDENTICAL' END AS relation, CASE WHEN o_orderkey % 10 > 0 THEN CASE WHEN changed > 0 THEN first_changed WHEN fresh = 0 THEN first_linked END END AS target
FROM orders LEFT JOIN (SELECT answer, count(*) AS n, count(*) FILTER (WHERE published AND drafted) AS changed, count(*) FILTER (WHERE NOT published AND blocked) AS held, count(*) FILTER (WHERE NOT published) AS fresh, min(l_partkey) FILTER (WHERE published AND drafted) AS first_changed, min(l_partkey) FILTER (WHERE published AND NOT drafted) AS first_linked FROM c GROUP BY 1) ON answer = o_orderkey""")
def owner_outcome(t):
    """What becomes of an owner's answer by the cards that its facts reached: published ones with a new draft, new ones that may be blocked, or linked ones without change."""
    pub, draft = F.col("l_linestatus") == "F", F.col("l_tax") > 0.04
    c = t("lineitem").filter("l_discount > 0.05").groupBy(F.col("l_orderkey").alias("answer")).agg(
        F.count_if(pub & draft).alias("changed"), F.count_if(~pub & (F.col("l_returnflag") == "A")).alias("held"), F.count_if(~pub).alias("fresh"),
        F.min(F.when(pub & draft, F.col("l_partkey"))).alias("first_changed"), F.min(F.when(pub & ~draft, F.col("l_partkey"))).alias("first_linked"),
    )
    j = t("orders").select(F.col("o_orderkey").alias("answer")).join(c, "answer", "left")
    empty, pending, changed, fresh = F.col("answer") % 10 == 0, F.col("fresh").isNull(), F.col("changed") > 0, F.col("fresh") > 0
    outcome = F.when(empty, "NO_FACTS").when(pending, "FACTS_PENDING").when(changed | (F.col("held") > 0), "REVIEW").when(fresh, "PUBLISH").otherwise("LINKED")
    relation = F.when(empty | pending, "NEW").when(changed, "SUPPLEMENT").when(fresh, "NEW").otherwise("IDENTICAL")
    return j.select("answer", outcome.alias("outcome"), relation.alias("relation"), F.when(~empty, F.when(changed, F.col("first_changed")).when(~fresh, F.col("first_linked"))).alias("target"))


@query(LINES + """SELECT a.l_orderkey AS card, a.place AS fact, CASE WHEN b.place IS NULL THEN '(other card)' WHEN b.l_returnflag = 'N' THEN b.l_linenumber || '.' ELSE left(p_name || ' ' || b.l_quantity, 12) END AS label FROM l a LEFT JOIN l b ON b.l_orderkey = a.l_orderkey AND b.place = a.place - 2 LEFT JOIN part ON p_partkey = b.l_partkey WHERE a.l_tax > 0.05""")
def requirement_labels(t):
    """How a card names what a fact requires (here the fact two before it): its step number, else the start of its sentence, or that it is on another card."""
    f = lines(t).select(F.col("l_orderkey").alias("card"), F.col("place").alias("fact"), "l_returnflag", "l_linenumber", "l_quantity", "l_partkey", "l_tax")
    b = f.join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left")
    b = b.select("card", (F.col("fact") + 2).alias("fact"), F.when(F.col("l_returnflag") == "N", F.concat(F.col("l_linenumber").cast("string"), F.lit("."))).otherwise(F.left(F.concat_ws(" ", "p_name", F.col("l_quantity").cast("string")), F.lit(12))).alias("label"))
    return f.filter("l_tax > 0.05").select("card", "fact").join(b, ["card", "fact"], "left").select("card", "fact", F.coalesce("label", F.lit("(other card)")).alias("label"))


@query("""WITH f AS (SELECT user_id, event_id, ts FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events a WHERE a.user_id = e.user_id AND a.event_type = 'purchase' AND a.event_id % 10 = e.event_id % 10))
SELECT user_id, event_id, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM f) WHERE n <= 10""")
def failed_turns(t):
    """The last ten failed turns of a session that were not answered since (same request number): the bound is the feature, and Spark keeps ten a session before the shuffle."""
    e = t("events").withColumn("request", F.col("event_id") % 10)
    answered = e.filter("event_type = 'purchase'").select("user_id", "request")
    f = e.filter("event_type = 'error'").join(answered, ["user_id", "request"], "left_anti")
    return f.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id"))).alias("n")).filter("n <= 10")


@query(LINES + """SELECT l_orderkey AS card, l_partkey AS fact, row_number() OVER (PARTITION BY l_orderkey ORDER BY added, place) AS position FROM (SELECT l_orderkey, l_partkey, bool_and(l_linestatus = 'O') AS added, coalesce(min(place) FILTER (WHERE l_linestatus = 'F'), min(place)) AS place FROM l GROUP BY 1, 2)""")
def appended_layout(t):
    """A card's layout with new facts after those that it has, in their order; a fact that it has stays where it is."""
    old = F.col("l_linestatus") == "F"
    f = lines(t).groupBy(F.col("l_orderkey").alias("card"), F.col("l_partkey").alias("fact")).agg(F.bool_and(~old).alias("added"), F.coalesce(F.min(F.when(old, F.col("place"))), F.min("place")).alias("place"))
    return f.select("card", "fact", F.row_number().over(Window.partitionBy("card").orderBy("added", "place")).alias("position"))


@query("""WITH q AS (SELECT c_nationkey AS campaign, c_custkey AS question, bool_or(year(o_orderdate) = 1995) AS old, bool_or(year(o_orderdate) = 1996) AS new, count(DISTINCT o_orderstatus) FILTER (WHERE year(o_orderdate) BETWEEN 1995 AND 1996) > 1 AS changed FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT campaign, count(*) FILTER (WHERE old AND new) AS shared, count(*) FILTER (WHERE old AND NOT new) AS missing, count(*) FILTER (WHERE new AND NOT old) AS unexpected, count(*) FILTER (WHERE old AND new AND changed) AS changed_inputs,
 count(*) FILTER (WHERE old <> new) = 0 AND count(*) FILTER (WHERE old AND new AND changed) = 0 AS comparable FROM q WHERE old OR new GROUP BY 1""")
def campaign_inputs(t):
    """Whether two runs of a campaign may be compared: the same questions, with the same inputs. Both runs come from one grouping, so there is no join of the two."""
    year = F.year("o_orderdate")
    o = t("orders").filter(year.isin(1995, 1996)).join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("campaign")), "o_custkey")
    q = o.groupBy("campaign", "o_custkey").agg(F.bool_or(year == 1995).alias("old"), F.bool_or(year == 1996).alias("new"), (F.min("o_orderstatus") != F.max("o_orderstatus")).alias("changed"))
    both, old, new = F.col("old") & F.col("new"), F.col("old") & ~F.col("new"), F.col("new") & ~F.col("old")
    g = q.groupBy("campaign").agg(F.count_if(both).alias("shared"), F.count_if(old).alias("missing"), F.count_if(new).alias("unexpected"), F.count_if(both & F.col("changed")).alias("changed_inputs"))
    return g.withColumn("comparable", (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("changed_inputs") == 0))


@query("""WITH c AS (SELECT l_orderkey AS snapshot, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS content FROM lineitem GROUP BY 1)
SELECT snapshot, sha256(content) AS digest, CASE WHEN snapshot % 9 = 0 THEN 'HASH_MISMATCH' ELSE 'OK' END AS state FROM c""")
def snapshot_verified(t):
    """Each snapshot's content hashed again and held against the hash that it was frozen with (another one for every ninth here)."""
    part = lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))
    c = t("lineitem").groupBy(F.col("l_orderkey").alias("snapshot")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    c = c.select("snapshot", F.array_join(F.transform("x", part), ",").alias("content"))
    frozen = F.sha2(F.when(F.col("snapshot") % 9 == 0, F.concat("content", F.lit("+"))).otherwise(F.col("content")), 256)
    c = c.select("snapshot", F.sha2("content", 256).alias("digest"), frozen.alias("frozen"))
    return c.select("snapshot", "digest", F.when(F.col("digest") == F.col("frozen"), "OK").otherwise("HASH_MISMATCH").alias("state"))


@query(LINES + """, b AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(place)) AS rank FROM l GROUP BY 1, 2),
f AS (SELECT l.l_orderkey, l.l_partkey, min(rank) AS rank FROM l JOIN b USING (l_orderkey, l_suppkey) WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT o_orderkey AS question, count(l_partkey) AS needed, count(*) FILTER (WHERE rank <= 2) AS found, CASE WHEN count(l_partkey) > 0 THEN round(count(*) FILTER (WHERE rank <= 2) / count(l_partkey), 4) END AS recall FROM orders LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY 1""")
def evidence_recall(t):
    """Which of the facts that a question needs (returned) are in the first two blocks (suppliers) found for it; null if it needs none."""
    f = lines(t).select(F.col("l_orderkey").alias("question"), "place", "l_suppkey", "l_partkey", "l_returnflag")
    first = F.min("place").over(Window.partitionBy("question", "l_suppkey"))
    f = f.withColumn("first", first).withColumn("rank", F.dense_rank().over(Window.partitionBy("question").orderBy("first")))
    need = f.filter("l_returnflag = 'R'").groupBy("question", "l_partkey").agg(F.min("rank").alias("rank")).groupBy("question").agg(F.count("*").alias("needed"), F.count_if(F.col("rank") <= 2).alias("found"))
    j = t("orders").select(F.col("o_orderkey").alias("question")).join(need, "question", "left").fillna(0, ["needed", "found"])
    return j.withColumn("recall", F.when(F.col("needed") > 0, F.round(F.col("found") / F.col("needed"), 4)))


@query("""WITH u AS (SELECT user_id, date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) AS b FROM events GROUP BY 1), w AS (SELECT user_id, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS start FROM u),
c AS (SELECT user_id, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, CAST(start AS DATE) AS day, coalesce(n, 0) AS n FROM w LEFT JOIN c USING (user_id, start)""")
def filled_windows(t):
    """A user's fixed windows from the first to the last event, the empty ones between included."""
    day = F.to_date("ts")
    c = t("events").groupBy("user_id", day.alias("day")).agg(F.count("*").alias("n"))
    w = c.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("user_id", F.explode(F.sequence("a", "b")).alias("day"))
    return w.join(c, ["user_id", "day"], "left").select("user_id", "day", F.coalesce("n", F.lit(0)).alias("n"))
