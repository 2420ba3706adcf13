"""Checks of answers and written lines, and scores of cases. An order is an answer, its lines (in order of place) are what it selected: the part is
the fact, the supplier the block. Line numbers repeat, so place is counted anew."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import checks, fixed
from ..functions.text import lexical_terms
from ..sources.shared import in_tasks
from .registry import query

LINES = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS place FROM lineitem)
"""


def placed(lineitem):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return lineitem.withColumn("place", F.row_number().over(order))


def lines(t):
    return placed(in_tasks(t("lineitem"), "l_orderkey"))


@query(LINES + """, f AS (SELECT l.*, p.p_partkey AS fact, p.p_size AS ord, CASE WHEN p.p_partkey % 5 = 0 THEN p.p_partkey - 1 END AS requires FROM l LEFT JOIN part p ON p.p_partkey = l.l_partkey AND p.p_size > 2)
SELECT l_orderkey AS answer, CASE WHEN bool_or(fact IS NULL) THEN 'UNKNOWN_FACT'
 WHEN bool_or(EXISTS (SELECT 1 FROM f g WHERE g.l_orderkey = f.l_orderkey AND g.l_suppkey % 3 = f.l_suppkey % 3 AND g.place < f.place AND (g.ord, g.fact) > (f.ord, f.fact))) THEN 'ORDER_CHANGED'
 WHEN count(*) > count(DISTINCT fact) THEN 'DUPLICATE'
 WHEN bool_or(requires IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f g WHERE g.l_orderkey = f.l_orderkey AND g.fact = f.requires AND g.place < f.place)) THEN 'PREREQUISITE' END AS fault
FROM f GROUP BY 1""")
def answer_references(t):
    """The first rule that an answer's references break: facts outside the published version, an approved order of a block that was changed, a fact cited
    twice, a prerequisite that is missing or comes later. Citations and requirements of a fact meet in one grouping, so all but the join with the facts shares one
    shuffle by answer."""
    p = t("part").filter("p_size > 2").select("p_partkey", F.col("p_partkey").alias("fact"), F.col("p_size").alias("ord"))
    f = placed(in_tasks(t("lineitem").join(p, F.col("p_partkey") == F.col("l_partkey"), "left"), "l_orderkey", t("lineitem")))
    f = f.select(F.col("l_orderkey").alias("answer"), "place", "fact", F.struct("ord", "fact").alias("key"), (F.col("l_suppkey") % 3).alias("block"))
    before = Window.partitionBy("answer", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    f = f.withColumn("swapped", F.coalesce(F.max("key").over(before) > F.col("key"), F.lit(False)))
    said = F.struct(F.col("fact").alias("about"), F.col("place").alias("cited"), F.lit(None).cast("int").alias("needed"))
    needs = F.when(F.col("fact") % 5 == 0, F.struct((F.col("fact") - 1).alias("about"), F.lit(None).cast("int").alias("cited"), F.col("place").alias("needed")))
    f = f.select("answer", "swapped", F.explode(F.filter(F.array(said, needs), lambda x: x.isNotNull())).alias("x")).select("answer", "swapped", "x.*")
    g = f.groupBy("answer", "about").agg(F.bool_or("swapped").alias("swapped"), F.count("cited").alias("n"), F.min("cited").alias("cited"), F.min("needed").alias("needed"))
    missing = F.col("needed").isNotNull() & ~F.coalesce(F.col("cited") < F.col("needed"), F.lit(False))
    n = g.groupBy("answer").agg(F.bool_or(F.col("about").isNull()).alias("unknown"), F.bool_or("swapped").alias("swapped"), F.bool_or(F.col("n") > 1).alias("twice"), F.bool_or(missing).alias("missing"))
    return n.select("answer", F.when(F.col("unknown"), "UNKNOWN_FACT").when(F.col("swapped"), "ORDER_CHANGED").when(F.col("twice"), "DUPLICATE").when(F.col("missing"), "PREREQUISITE").alias("fault"))


@query(LINES + """, f AS (SELECT l.*, o_orderstatus, o_orderpriority, o_custkey % 3 AS asked, l_quantity % 3 AS predicate, l_returnflag = 'R' AS chained, l_suppkey % 4 AS variant FROM l JOIN orders ON o_orderkey = l_orderkey),
g AS (SELECT f.*, predicate = asked OR EXISTS (SELECT 1 FROM f h WHERE h.l_orderkey = f.l_orderkey AND h.place > f.place AND h.predicate = h.asked AND NOT EXISTS (SELECT 1 FROM f i WHERE i.l_orderkey = f.l_orderkey AND i.place > f.place AND i.place <= h.place AND NOT i.chained)) AS allowed FROM f)
SELECT l_orderkey AS answer, CASE WHEN max(o_orderstatus) = 'P' THEN 'UNRESOLVED_CONTEXT' WHEN count(*) FILTER (WHERE predicate = asked) = 0 THEN 'NO_TARGET' WHEN bool_or(NOT allowed) THEN 'NOT_ASKED' WHEN bool_or(l_tax = 0.08 AND max_prio) THEN 'UNSUPPORTED_SCHEMA'
 WHEN bool_or(variant = 3) THEN 'UNRESOLVED_CONTEXT' WHEN count(DISTINCT variant) FILTER (WHERE predicate = asked) < 2 THEN 'VARIANT_MISSING' END AS fault
FROM (SELECT *, o_orderpriority <> '1-URGENT' AS max_prio FROM g) GROUP BY 1""")
def answer_suitability(t):
    """Whether an answer suits its question: its targets (facts of the predicate asked for) and what they require, each line the one before it, are all that it
    cites; conditions were judged; each fact has a variant (3: none), and two variants of the question are answered."""
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 3).alias("asked"))
    f = lines(t).join(o, "l_orderkey").withColumn("variant", F.col("l_suppkey") % 4).withColumn("target", F.col("l_quantity") % 3 == F.col("asked"))
    chain = F.sum(F.when(F.col("l_returnflag") == "R", 0).otherwise(1)).over(Window.partitionBy("l_orderkey").orderBy("place"))
    last = F.max(F.when(F.col("target"), F.col("place"))).over(Window.partitionBy("l_orderkey", "chain"))
    f = f.withColumn("chain", chain).withColumn("allowed", F.coalesce(last >= F.col("place"), F.lit(False)))
    unjudged = (F.col("l_tax") == 0.08) & (F.col("o_orderpriority") != "1-URGENT")
    n = f.groupBy(F.col("l_orderkey").alias("answer")).agg(
        F.bool_or(F.col("o_orderstatus") == "P").alias("open"), F.bool_or("target").alias("any"), F.bool_or(~F.col("allowed")).alias("extra"), F.bool_or(unjudged).alias("unjudged"),
        F.bool_or(F.col("variant") == 3).alias("none"), F.count_distinct(F.when(F.col("target"), F.col("variant"))).alias("variants"),
    )
    fault = F.when(F.col("open"), "UNRESOLVED_CONTEXT").when(~F.col("any"), "NO_TARGET").when(F.col("extra"), "NOT_ASKED").when(F.col("unjudged"), "UNSUPPORTED_SCHEMA")
    return n.select("answer", fault.when(F.col("none"), "UNRESOLVED_CONTEXT").when(F.col("variants") < 2, "VARIANT_MISSING").alias("fault"))


@query("""SELECT p_partkey AS line, CASE p_partkey % 6 WHEN 0 THEN 'LINE_EMPTY' WHEN 1 THEN 'LINE_BARE_VALUE' WHEN 3 THEN 'LINE_INVENTED_NUMBER' WHEN 4 THEN 'LINE_INVENTED_UNIT' END AS fault FROM part""")
def line_checks(t):
    """Lines written in six ways about a fact: empty, a value alone, right, with another number, with another unit, and right with a particle after the unit."""
    kind, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    add = lambda *parts: F.concat(F.lit("시럽 "), *parts)
    text = (
        F.when(kind == 0, "  ").when(kind == 1, F.concat(size, F.lit(".0 ml"))).when(kind == 2, add(size, F.lit(" ML"))).when(kind == 3, add((F.col("p_size") + 1).cast("string"), F.lit("ml")))
        .when(kind == 4, add(size, F.lit("oz"))).otherwise(add(size, F.lit("스푼을 넣는다")))
    )
    pool = F.when(kind == 5, add(size, F.lit("스푼"))).otherwise(add(size, F.lit("ml")))
    return t("part").select(F.col("p_partkey").alias("line"), checks.line_fault(text, pool).alias("fault"))


@query(LINES + "SELECT l_orderkey AS card, list_sort(list(place) FILTER (WHERE l_returnflag = 'R' OR (l_linestatus = 'O' AND l_quantity <> 10 * round(l_discount * 100)))) AS uncovered FROM l GROUP BY 1 HAVING uncovered IS NOT NULL")
def uncovered_facts(t):
    """Facts that no line of their card cites (here those returned), or whose value no citing line has: citations meet facts by an equi-join."""
    f = lines(t).select(F.col("l_orderkey").alias("card"), F.col("place").alias("fact"), F.format_string("%.1f", "l_quantity").alias("value"), "l_returnflag", "l_linestatus", "l_discount")
    said = F.when(F.col("l_linestatus") == "F", F.col("value")).otherwise(F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("0")))
    cited = f.filter("l_returnflag <> 'R'").select("card", "fact", checks.numbers_in(F.concat(said, F.lit("ml 넣기"))).alias("said"))
    cited = cited.groupBy("card", "fact").agg(F.flatten(F.collect_set("said")).alias("said"))
    lost = F.col("said").isNull() | ~F.arrays_overlap(checks.numbers_in(F.col("value")), "said")
    return f.select("card", "fact", "value").join(cited, ["card", "fact"], "left").filter(lost).groupBy("card").agg(F.array_sort(F.collect_list("fact")).alias("uncovered"))


@query("""SELECT p_partkey AS fact, CASE p_partkey % 4 WHEN 0 THEN p_size || 'ml 넣어 주세요' ELSE '우유 ' || p_size || 'ml, 1,200원' END AS shown FROM part""")
def friendly_guard(t):
    """The rewritten sentence stands only if it invents no number and keeps the value; else the original is shown."""
    kind, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    original = F.concat(F.lit("우유 "), size, F.lit("ml, 1,200원"))
    text = F.when(kind == 0, F.concat(size, F.lit("ml 넣어 주세요"))).when(kind == 1, F.concat(size, F.lit("ml와 9999g"))).when(kind == 2, F.lit("우유를 넣어 주세요"))
    return t("part").select(F.col("p_partkey").alias("fact"), checks.friendly(text, original, size).alias("shown"))


@query(LINES + """SELECT l_orderkey AS question, CASE WHEN bool_or(l_tax = 0) THEN 'INCOMPLETE' WHEN NOT bool_or(l_returnflag = 'R') THEN 'NO_REQUIRED' WHEN bool_or(l_returnflag = 'R' AND l_linestatus = 'O') THEN 'MISSING' ELSE 'COVERED' END AS status,
 CASE WHEN NOT bool_or(l_tax = 0) AND bool_or(l_returnflag = 'R') THEN coalesce(list_sort(list(place) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O')), []) END AS missing FROM l GROUP BY 1""")
def conclusion_coverage(t):
    """Each candidate must have been inspected (here: taxed), at least one must be required (returned), and the required ones must be cited (finished)."""
    required, cited = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    n = lines(t).groupBy(F.col("l_orderkey").alias("question")).agg(F.bool_or(F.col("l_tax") == 0).alias("unseen"), F.bool_or(required).alias("any"), F.array_sort(F.collect_list(F.when(required & ~cited, F.col("place")))).alias("m"))
    status = F.when(F.col("unseen"), "INCOMPLETE").when(~F.col("any"), "NO_REQUIRED").when(F.size("m") > 0, "MISSING").otherwise("COVERED")
    return n.select("question", status.alias("status"), F.when(~F.col("unseen") & F.col("any"), F.col("m")).alias("missing"))


@query(LINES + """, s AS (SELECT l_orderkey, min(place) FILTER (WHERE l_returnflag = 'R') AS rank, count(*) FILTER (WHERE l_linestatus = 'F') AS cited, count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'R') AS good,
 count(*) FILTER (WHERE l_tax > 0.02) AS held, count(*) FILTER (WHERE l_discount < 0.09) AS facts, count(*) FILTER (WHERE l_tax > 0.02 AND l_discount < 0.09) AS covered FROM l GROUP BY 1),
c AS (SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 'MISS' WHEN '4-NOT SPECIFIED' THEN 'REFUSE' ELSE 'HIT' END AS expected, CASE WHEN o_custkey % 2 = 1 THEN 'no_match' END AS wanted, CASE WHEN o_custkey % 3 = 0 THEN 'no_anchor' ELSE 'no_match' END AS reason,
 CASE WHEN o_orderkey % 10 = 0 THEN 'ERROR' WHEN o_orderkey % 10 < 4 THEN 'MISS' ELSE 'HIT' END AS actual, rank, coalesce(cited, 0) AS cited, CASE WHEN rank IS NOT NULL AND cited > 0 THEN round(good / cited, 4) END AS prec, CASE WHEN facts > 0 THEN round(covered / facts, 4) END AS coverage FROM orders LEFT JOIN s ON l_orderkey = o_orderkey)
SELECT o_orderkey AS "case", expected, actual, rank, prec, coverage, CASE WHEN actual = 'ERROR' THEN 'RUN_ERROR' WHEN expected <> 'HIT' AND actual = 'HIT' THEN 'SHOULD_NOT_ANSWER' WHEN expected = 'MISS' AND wanted <> reason THEN 'MISS_REASON_MISMATCH' WHEN expected <> 'HIT' THEN NULL
 WHEN actual = 'MISS' THEN 'FALSE_MISS' WHEN cited = 0 THEN 'NO_CITATION' WHEN rank IS NULL THEN 'EXPECTED_CARD_ABSENT' WHEN prec = 0 THEN 'WRONG_CITATION' WHEN coverage < 1 THEN 'MISSING_FACT' END AS failure FROM c""")
def case_scores(t):
    """Rank of the first expected card, share of citations that were expected, share of facts held, and the failure kind (eight of them) of each case."""
    expected, cited, fact, held = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", F.col("l_discount") < 0.09, F.col("l_tax") > 0.02
    s = lines(t).groupBy(F.col("l_orderkey").alias("case")).agg(
        F.min(F.when(expected, F.col("place"))).alias("rank"), F.count_if(cited).alias("cited"), F.count_if(cited & expected).alias("good"), F.count_if(fact).alias("facts"), F.count_if(fact & held).alias("covered")
    )
    o, last = t("orders"), F.col("o_orderkey") % 10
    c = o.select(
        F.col("o_orderkey").alias("case"), F.when(F.col("o_orderpriority") == "5-LOW", "MISS").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "REFUSE").otherwise("HIT").alias("expected"),
        F.when(F.col("o_custkey") % 2 == 1, "no_match").alias("wanted"), F.when(F.col("o_custkey") % 3 == 0, "no_anchor").otherwise("no_match").alias("reason"), F.when(last == 0, "ERROR").when(last < 4, "MISS").otherwise("HIT").alias("actual"),
    )
    c = c.join(s, "case", "left").withColumn("cited", F.coalesce("cited", F.lit(0)))
    c = c.withColumn("prec", F.when(F.col("rank").isNotNull() & (F.col("cited") > 0), F.round(F.col("good") / F.col("cited"), 4)))
    c = c.withColumn("coverage", F.when(F.col("facts") > 0, F.round(F.col("covered") / F.col("facts"), 4)))
    kind = checks.failure_kind(*(F.col(n) for n in ("expected", "actual", "reason", "wanted", "rank", "cited", "prec", "coverage")))
    return c.select("case", "expected", "actual", "rank", "prec", "coverage", kind.alias("failure"))


SMALL, LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PLAIN = "trim(regexp_replace(lower({}), '[^0-9a-z가-힣]+', ' ', 'g'))"


@query(f"""WITH q AS (SELECT a.conv_id, a.turn, [translate(array_to_string(string_split(b.text, ' ')[1:2], ' -- '), '{SMALL}', '{LARGE}'), array_to_string(string_split(a.text, ' ')[1:1], ' ')] AS facts, b.text AS answer FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'),
u AS (SELECT conv_id, turn, answer, unnest(facts) AS fact FROM q)
SELECT conv_id, turn, CASE WHEN coalesce(max(answer), '') = '' THEN 0 ELSE round(count(*) FILTER (WHERE contains({PLAIN.format('answer')}, {PLAIN.format('fact')})) / count(*), 4) END AS coverage FROM u WHERE regexp_matches(fact, '\\S') GROUP BY 1, 2""")
def answer_fact_coverage(t):
    """Expected facts whose words an answer has, whatever its case and punctuation."""
    c = t("conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    j = c.filter("role = 'user'").join(after, ["conv_id", "turn"])
    words = lambda col, n, by: F.array_join(F.slice(F.split(col, " "), 1, n), by)
    facts = F.array(F.translate(words(F.col("answer"), 2, " -- "), SMALL, LARGE), words(F.col("text"), 1, " "))
    return j.select("conv_id", "turn", checks.fact_coverage(facts, F.col("answer")).alias("coverage")).filter("coverage IS NOT NULL")


LOGICS = ("FACT", "PROCEDURE", "NOTICE", "TALK", "NONE")
CARD_LOGICS, REGISTERED = ("FACT", "PROCEDURE", "NOTICE"), ("FACT", "NOTICE")


@query("""WITH r AS (SELECT l_orderkey AS section, l_suppkey % 5 AS logic, max(l_discount) * 10 AS score FROM lineitem GROUP BY 1, 2),
b AS (SELECT r.*, CASE WHEN o_custkey % 5 = logic THEN least(1.0, score + 0.15) ELSE score END AS boosted FROM r JOIN orders ON o_orderkey = section),
n AS (SELECT section, logic, round(boosted, 6) AS boosted, row_number() OVER (PARTITION BY section ORDER BY round(score, 6) DESC, logic) AS before, row_number() OVER (PARTITION BY section ORDER BY round(boosted, 6) DESC, logic) AS place FROM b),
s AS (SELECT section, max(logic) FILTER (WHERE place = 1) AS l1, max(boosted) FILTER (WHERE place = 1) AS s1, max(logic) FILTER (WHERE place = 2) AS l2, max(boosted) FILTER (WHERE place = 2) AS s2, max(logic) FILTER (WHERE before = 1) AS model, coalesce(arg_min(logic, place) FILTER (WHERE logic IN (0, 2)), 0) AS usable FROM n GROUP BY 1),
d AS (SELECT *, CASE WHEN l1 <> 4 THEN CASE WHEN l1 IN (0, 2) THEN l1 ELSE usable END END AS first, CASE WHEN l1 < 3 AND l2 < 3 AND s2 >= 0.35 THEN CASE WHEN l2 IN (0, 2) THEN l2 ELSE usable END END AS second FROM s)
SELECT section, l1 AS logic, first, CASE WHEN second <> first THEN second END AS second, s1 < 0.5 OR coalesce(round(s1 - s2, 6) < 0.15, false) AS doubtful, (first IS NOT NULL AND l1 NOT IN (0, 2)) OR coalesce(second <> first AND l2 NOT IN (0, 2), false) AS fallback, model <> l1 AS hint_decided FROM d""")
def section_decisions(t):
    """Which extractors a section goes to: scores of its logics (numbers into LOGICS), raised where the owner hinted, the first two, and whether the decision is doubtful or fell
    back on a registered logic. Top two and the best registered one are minima of structs, so no sort of a section."""
    r = t("lineitem").groupBy(F.col("l_orderkey").alias("section"), (F.col("l_suppkey") % len(LOGICS)).alias("logic")).agg((F.max("l_discount") * 10).alias("score"))
    o = t("orders").select(F.col("o_orderkey").alias("section"), (F.col("o_custkey") % len(LOGICS)).alias("hint"))
    boosted = F.when(F.col("hint") == F.col("logic"), F.least(F.lit(1.0), F.col("score") + fixed.HINT_BOOST)).otherwise(F.col("score"))
    b = r.join(o, "section").select("section", "logic", F.round("score", 6).alias("score"), F.round(boosted, 6).alias("boosted"))
    has = lambda c, names: c.isin(*(LOGICS.index(n) for n in names))
    row = lambda c: F.struct((-F.col(c)).alias("down"), F.col("logic").alias("logic"))
    s = b.groupBy("section").agg(F.array_sort(F.collect_list(row("boosted"))).alias("rank"), F.min(row("score"))["logic"].alias("model"), F.min(F.when(has(F.col("logic"), REGISTERED), row("boosted")))["logic"].alias("usable"))
    at = lambda i: F.get("rank", F.lit(i))
    s = s.select("section", "model", F.coalesce("usable", F.lit(0)).alias("usable"), at(0)["logic"].alias("l1"), (-at(0)["down"]).alias("s1"), at(1)["logic"].alias("l2"), (-at(1)["down"]).alias("s2"))
    known = lambda c: F.when(has(F.col(c), REGISTERED), F.col(c)).otherwise(F.col("usable"))
    two = has(F.col("l1"), CARD_LOGICS) & has(F.col("l2"), CARD_LOGICS) & (F.col("s2") >= fixed.SECOND_LOGIC)
    s = s.withColumn("first", F.when(F.col("l1") != LOGICS.index("NONE"), known("l1"))).withColumn("second", F.when(two, known("l2")))
    extra = F.coalesce(F.col("second") != F.col("first"), F.lit(False))
    doubtful = (F.col("s1") < fixed.DOUBTFUL_TOP) | F.coalesce(F.round(F.col("s1") - F.col("s2"), 6) < fixed.DOUBTFUL_GAP, F.lit(False))
    fallback = (F.col("first").isNotNull() & ~has(F.col("l1"), REGISTERED)) | (extra & ~has(F.col("l2"), REGISTERED))
    return s.select("section", F.col("l1").alias("logic"), "first", F.when(extra, F.col("second")).alias("second"), doubtful.alias("doubtful"), fallback.alias("fallback"), (F.col("model") != F.col("l1")).alias("hint_decided"))


ASKED = [("우유는 어디에서 꺼내나요", "꺼내나요 어디 어디에서 우유 우유는"), ("라떼에서는 275.0 ml", "275.0 ml 라떼 라떼에서는"), ("가 은 물", "가 물 은"), ("Milk MILK 2", "2 milk"), (None, "")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{w}')" for i, (_, w) in enumerate(ASKED)) + ") v(id, terms)")
def lexical_expansion(t):
    """Search terms of fixed questions: tokens, and tokens without their ending; the SQL lists what they must be."""
    q = t.spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ASKED)], "id int, text string")
    return q.select("id", F.array_join(F.array_sort(lexical_terms(F.col("text"))), " ").alias("terms"))


@query(LINES + """, n AS (SELECT l_orderkey, count(*) AS n FROM l GROUP BY 1), a AS (SELECT l.*, n, CASE l_suppkey % 3 WHEN 0 THEN 'SCAN' WHEN 1 THEN 'KAKAO' ELSE 'VOICE' END AS kind, CASE WHEN l_tax > 0.05 THEN l_linenumber END AS page FROM l JOIN n USING (l_orderkey))
SELECT l_orderkey AS source, place AS assertion, concat_ws(',', CASE WHEN page IS NOT NULL AND kind <> 'SCAN' THEN 'page:WRONG_SOURCE' WHEN page > n THEN 'page:ABSENT' END,
 CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN CASE WHEN l_discount > 0.08 THEN 'unit:NEEDS_IMAGE_CHECK' ELSE 'unit:UNGROUNDED_TEXT' END END, CASE WHEN l_discount = 0 AND place + 1 > n THEN 'requires:REMOVED' END) AS flags FROM a""")
def assertion_flags(t):
    """What a fact claims beyond its input, each with a verdict and nothing thrown away: pages that its kind of source or the input doesn't have, units not in the text (to be looked
    at in the image if there is one), and references to facts that aren't there."""
    a = lines(t).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey")))
    scan, page = F.col("l_suppkey") % 3 == 0, F.col("l_tax") > 0.05
    unit = F.when(F.col("l_discount") > 0.08, "unit:NEEDS_IMAGE_CHECK").otherwise("unit:UNGROUNDED_TEXT")
    flags = F.concat_ws(
        ",", F.when(page & ~scan, "page:WRONG_SOURCE").when(page & (F.col("l_linenumber") > F.col("n")), "page:ABSENT"), F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), unit),
        F.when((F.col("l_discount") == 0) & (F.col("place") + 1 > F.col("n")), "requires:REMOVED"),
    )
    return a.select(F.col("l_orderkey").alias("source"), F.col("place").alias("assertion"), flags.alias("flags"))
