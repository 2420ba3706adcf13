"""Smaller operators, each in a query of its own."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from .operations import DAY, business_date
from ..operators.quantiles import quantiles
from .registry import query


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN published ELSE draft END AS version FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS published, o_orderkey + 1 AS draft FROM orders) WHERE CASE WHEN o_custkey % 2 = 0 THEN published ELSE draft END IS NOT NULL")
def role_projection(t):
    """Staff (even customers) see the published version, owners the draft."""
    o = t("orders").withColumn("published", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).withColumn("draft", F.col("o_orderkey") + 1)
    return o.select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.col("published")).otherwise(F.col("draft")).alias("version")).filter("version IS NOT NULL")


@query("""SELECT c_custkey, CASE WHEN done = current THEN 'DONE' WHEN done IS NOT NULL THEN 'RECONFIRM_REQUIRED' ELSE 'NOT_STARTED' END AS status FROM customer
LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS current, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def learning_status(t):
    g = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("current"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("done"))
    status = F.when(F.col("done") == F.col("current"), "DONE").when(F.col("done").isNotNull(), "RECONFIRM_REQUIRED").otherwise("NOT_STARTED")
    return t("customer").select("c_custkey").join(g, "c_custkey", "left").select("c_custkey", status.alias("status"))


@query("""SELECT l_orderkey, s_name, place FROM (SELECT l_orderkey, unnest(keys) AS s_suppkey, unnest(range(1, len(keys) + 1)) AS place FROM (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS keys FROM lineitem GROUP BY 1)) JOIN supplier USING (s_suppkey)""")
def parallel_array_join(t):
    """Two arrays side by side, opened together and joined."""
    keys = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("keys")).withColumn("places", F.sequence(F.lit(1).cast("long"), F.size("keys").cast("long")))
    opened = keys.select("l_orderkey", F.explode(F.arrays_zip("keys", "places")).alias("z")).select("l_orderkey", F.col("z.keys").alias("s_suppkey"), F.col("z.places").alias("place"))
    return opened.join(t("supplier").select("s_suppkey", "s_name"), "s_suppkey").select("l_orderkey", "s_name", "place")


@query("SELECT DISTINCT n.n_nationkey, x.s_suppkey FROM nation n JOIN supplier x ON x.s_nationkey = n.n_nationkey OR x.s_suppkey = n.n_nationkey")
def or_join(t):
    """A join on either of two keys: two equi-joins and a distinct union."""
    n, s = t("nation").select("n_nationkey"), t("supplier").select("s_suppkey", "s_nationkey")
    a = n.join(s, F.col("s_nationkey") == F.col("n_nationkey")).select("n_nationkey", "s_suppkey")
    b = n.join(s, F.col("s_suppkey") == F.col("n_nationkey")).select("n_nationkey", "s_suppkey")
    return a.union(b).distinct()


@query("""WITH s AS (SELECT user_id, event_id, ts, event_type = 'signup' AS sampled FROM events),
w AS (SELECT *, max(CASE WHEN sampled THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS before, min(CASE WHEN sampled THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM s)
SELECT event_id, CASE WHEN before IS NULL THEN after WHEN after IS NULL THEN before WHEN after - ts < ts - before THEN after ELSE before END AS nearest FROM w""")
def nearest_sampled(t):
    """Each event takes on its user's nearest sampled event, the earlier of two at one distance."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    back = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    sampled = F.when(F.col("event_type") == "signup", F.col("ts"))
    e = t("events").withColumn("before", F.max(sampled).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.min(sampled).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    nearest = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull(), F.col("before")).when(F.col("after") - F.col("ts") < F.col("ts") - F.col("before"), F.col("after")).otherwise(F.col("before"))
    return e.select("event_id", nearest.alias("nearest"))


@query("""SELECT conv_id, count(*) AS n, count(DISTINCT place) = count(*) AND min(place) = 1 AND max(place) = count(*) AS permutation FROM (SELECT conv_id, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN 2 ELSE row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) END AS place FROM conversations) GROUP BY 1""")
def rerank_permutation(t):
    """Whether new ranks are a permutation of the old ones; every fifth conversation's are broken on purpose."""
    place = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), 2).otherwise(F.row_number().over(Window.partitionBy("conv_id").orderBy(F.length("text"), "turn")))
    c = t("conversations").select("conv_id", place.alias("place")).groupBy("conv_id")
    return c.agg(F.count("*").alias("n"), ((F.countDistinct("place") == F.count("*")) & (F.min("place") == 1) & (F.max("place") == F.count("*"))).alias("permutation"))


@query(r"SELECT page_id, CASE WHEN url ILIKE '%//m.%' THEN 'mobile' WHEN url ILIKE '%//www.%' THEN 'desktop' WHEN regexp_matches(url, '/(api|feed)') THEN 'robot' ELSE 'other' END AS device FROM pages")
def device_label(t):
    """The first rule that matches."""
    u = F.col("url")
    return t("pages").select("page_id", F.when(u.ilike("%//m.%"), "mobile").when(u.ilike("%//www.%"), "desktop").when(u.rlike("/(api|feed)"), "robot").otherwise("other").alias("device"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<mail>', 'g'), '\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b', '<ip>', 'g') AS text FROM documents WHERE regexp_matches(text, '@|[0-9]\.[0-9]')""")
def redaction(t):
    d = t("documents").filter(F.col("text").rlike(r"@|[0-9]\.[0-9]"))
    text = F.regexp_replace(F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<mail>"), X.whole(r"[0-9]{1,3}(\.[0-9]{1,3}){3}"), "<ip>")
    return d.select("doc_id", text.alias("text"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: length(l) > 160)) = 0 AS arrows FROM documents")
def line_layout(t):
    """Whether all lines are short."""
    return t("documents").select("doc_id", F.forall(F.split("text", "\n", -1), lambda x: F.length(x) <= 160).alias("arrows"))


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month_start, last_day(o_orderdate) AS month_end, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def month_rollup(t):
    d = F.to_date("o_orderdate")
    return t("orders").groupBy(F.trunc(d, "month").alias("month_start"), F.last_day(d).alias("month_end")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT count(*) AS attempts, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6) AS error_rate,
min(ts) AS first_ts, max(ts) AS last_ts, round(stddev_pop(value), 4) AS spread, (SELECT to_json(map_from_entries(list((event_type, n) ORDER BY event_type))) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)) AS kinds FROM events""")
def run_metrics(t):
    """One row of metrics, with the distribution over kinds as JSON."""
    e = t("events")
    one = e.agg(
        F.count("*").alias("attempts"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"), 
        F.round(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)), 6).alias("error_rate"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.stddev_pop("value"), 4).alias("spread"),
    )
    kinds = e.groupBy("event_type").count().agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "count"))))).alias("kinds"))
    key = F.lit(1).alias("k")  # one row on either side
    p95 = quantiles(e.select("value"), [], "value", {"q": ("between", 0.95)}).select(F.round("q", 6).alias("p95"), key)
    return one.select("*", key).join(kinds.select("*", key), "k").join(p95, "k", "left").drop("k")


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'click') THEN 'REQUESTED' WHEN bool_and(event_type = 'error') THEN 'FAILED' ELSE 'PENDING' END AS status, count(DISTINCT event_type || ':' || CAST(ts AS DATE)) AS notices FROM events GROUP BY 1""")
def delivery_status(t):
    kind = F.col("event_type")
    status = F.when(F.bool_or(kind == "click"), "REQUESTED").when(F.bool_and(kind == "error"), "FAILED").otherwise("PENDING")
    return t("events").groupBy("user_id").agg(status.alias("status"), F.countDistinct(F.concat_ws(":", kind, F.to_date("ts").cast("string"))).alias("notices"))


@query(f"""SELECT user_id, business_date, event_id, n FROM (SELECT user_id, {DAY} AS business_date, event_id, count(*) OVER (PARTITION BY user_id, {DAY}) AS n,
row_number() OVER (PARTITION BY user_id, {DAY} ORDER BY (hour(ts) * 60 + minute(ts) - 240 + 1440) % 1440, event_id) AS rn FROM events) WHERE rn = 1""")
def business_day_order(t):
    """The first event, by minutes into it, of each business day of a user; the day starts at four."""
    into = F.pmod(F.hour("ts") * 60 + F.minute("ts") - 60 * fixed.DAY_START_HOUR, F.lit(1440))
    days = t("events").groupBy("user_id", business_date(F.col("ts")).alias("business_date"))
    return days.agg(F.min(F.struct(into.alias("m"), "event_id")).alias("x"), F.count("*").alias("n")).select("user_id", "business_date", "x.event_id", "n")


@query("SELECT p_brand, min(p_size) AS low, max(p_size) AS high, least(max(p_size), 30) >= greatest(min(p_size), 20) AS overlaps, greatest(min(p_size), 20) AS from_size, least(max(p_size), 30) AS to_size FROM part GROUP BY 1")
def interval_intersection(t):
    low, high = F.min("p_size"), F.max("p_size")
    a, b = F.greatest(low, F.lit(20)), F.least(high, F.lit(30))
    return t("part").groupBy("p_brand").agg(low.alias("low"), high.alias("high"), (b >= a).alias("overlaps"), a.alias("from_size"), b.alias("to_size"))


@query("SELECT kind, round(avg(score), 4) AS mean, count(*) AS n FROM (SELECT unnest(['price', 'tax', 'discount']) AS kind, unnest([l_extendedprice / 100000, l_tax, l_discount]) AS score FROM lineitem) GROUP BY 1")
def ranking_averages(t):
    scores = F.map_from_arrays(F.array(F.lit("price"), F.lit("tax"), F.lit("discount")), F.array(F.col("l_extendedprice") / 100000, "l_tax", "l_discount"))
    return t("lineitem").select(F.explode(scores).alias("kind", "score")).groupBy("kind").agg(F.round(F.avg("score"), 4).alias("mean"), F.count("*").alias("n"))


@query("SELECT item_id, list_transform(string_split(text, ' ')[1:6], lambda w: left(w, 2)) AS head, array_to_string(list_concat(string_split(text, ' ')[2:3], string_split(text, ' ')[1:1], string_split(text, ' ')[4:6]), ' ') AS moved FROM benchmark WHERE len(string_split(text, ' ')) >= 6")
def reorder_slices(t):
    """The first word moved behind the third, by slices."""
    w = F.split("text", " ", -1)
    b = t("benchmark").filter(F.size(w) >= 6)
    return b.select("item_id", F.transform(F.slice(w, 1, 6), lambda x: F.left(x, F.lit(2))).alias("head"), F.array_join(F.concat(F.slice(w, 2, 2), F.slice(w, 1, 1), F.slice(w, 4, 3)), " ").alias("moved"))


@query(r"""SELECT p_partkey, unnest(CASE WHEN p_type LIKE '%STEEL%' THEN ['HOT', 'ICE'] WHEN p_type LIKE '%TIN%' THEN ['HOT'] ELSE ['ANY'] END) AS variant FROM part""")
def dual_variants(t):
    """A part of both variants is two rows."""
    kind = F.col("p_type")
    variants = F.when(kind.contains("STEEL"), F.array(F.lit("HOT"), F.lit("ICE"))).when(kind.contains("TIN"), F.array(F.lit("HOT"))).otherwise(F.array(F.lit("ANY")))
    return t("part").select("p_partkey", F.explode(variants).alias("variant"))


@query(r"""SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_type), ' '), lambda w: w NOT IN ('small', 'medium', 'large', 'standard', 'economy', 'promo')), ' ') AS name,
list_filter(string_split(lower(p_type), ' '), lambda w: w IN ('small', 'medium', 'large'))[1] AS size FROM part""")
def entity_name_parts(t):
    """The name without its size and grade words, and the size."""
    sizes, grades = ("small", "medium", "large"), ("standard", "economy", "promo")
    words = F.split(F.lower("p_type"), " ")
    among = lambda w, these: F.array_contains(F.array(*map(F.lit, these)), w)
    name = F.array_join(F.filter(words, lambda w: ~among(w, sizes + grades)), " ")
    return t("part").select("p_partkey", name.alias("name"), F.get(F.filter(words, lambda w: among(w, sizes)), 0).alias("size"))


@query(r"""SELECT p_partkey, CAST(regexp_extract(s, '([0-9]+)\.([0-9]+)', 1) AS BIGINT) AS whole, CAST(regexp_extract(s, '([0-9]+)\.([0-9]+)', 2) AS BIGINT) AS part FROM (SELECT p_partkey, 'price ' || p_size || '.' || (p_partkey % 100) AS s FROM part)""")
def price_split(t):
    s = F.concat(F.lit("price "), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 100).cast("string"))
    pattern = r"([0-9]+)\.([0-9]+)"
    return t("part").select("p_partkey", F.regexp_extract(s, pattern, 1).cast("bigint").alias("whole"), F.regexp_extract(s, pattern, 2).cast("bigint").alias("part"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE op WHEN 0 THEN q + 5 WHEN 1 THEN q - 5 ELSE q * 3 END AS result, CASE op WHEN 0 THEN 'ADD' WHEN 1 THEN 'SUBTRACT' ELSE 'SCALE' END AS op, CASE op WHEN 0 THEN q + 5 WHEN 1 THEN q - 5 ELSE q * 3 END BETWEEN 0 AND 100 AS inside FROM (SELECT *, l_quantity AS q, l_linenumber % 3 AS op FROM lineitem)")
def typed_calculation(t):
    q, op = F.col("l_quantity"), F.col("l_linenumber") % 3
    result = F.when(op == 0, q + 5).when(op == 1, q - 5).otherwise(q * 3)
    name = F.when(op == 0, "ADD").when(op == 1, "SUBTRACT").otherwise("SCALE")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", result.alias("result"), name.alias("op"), result.between(0, 100).alias("inside"))


@query(r"""WITH v AS (SELECT DISTINCT string_split(lower(p_type), ' ')[3] AS alias, string_split(lower(p_type), ' ')[1] AS term FROM part) SELECT alias, count(DISTINCT term) AS terms FROM v GROUP BY 1 HAVING count(DISTINCT term) > 1""")
def lexicon_ambiguity(t):
    """Aliases that stand for more than one term."""
    w = F.split(F.lower("p_type"), " ")
    return t("part").select(F.get(w, 2).alias("alias"), F.get(w, 0).alias("term")).groupBy("alias").agg(F.countDistinct("term").alias("terms")).filter("terms > 1")


@query(r"""SELECT item_id, alias FROM benchmark b, (SELECT unnest(['with', 'and', 'der', 'que', 'les']) AS alias) a WHERE regexp_matches(lower(b.text), '(^|[^a-z])' || alias || '([^a-z]|$)')""")
def lexicon_match(t):
    """Aliases that stand in a text between boundaries: the five aliases are a fixed list."""
    aliases = F.broadcast(t.spark.createDataFrame([(a,) for a in ("with", "and", "der", "que", "les")], "alias string"))
    words = t("benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]"))).alias("alias"))
    return words.join(aliases, "alias").select("item_id", "alias")


@query(r"""SELECT conv_id, turn, contains(text, '###') AS cells, string_split(text, '. ')[1] AS head, len(string_split(text, '. ')) AS parts FROM conversations""")
def arrow_statements(t):
    parts = F.split("text", r"\. ", -1)
    return t("conversations").select("conv_id", "turn", F.contains("text", F.lit("###")).alias("cells"), parts[0].alias("head"), F.size(parts).cast("long").alias("parts"))
