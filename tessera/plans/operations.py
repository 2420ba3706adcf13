"""Operations: reports, business days, shifts, paging, job states and limits, on events and orders."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.quantiles import quantiles
from .registry import query

def user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def business_date(ts, hours=fixed.DAY_START_HOUR):
    return F.to_date(ts - F.make_dt_interval(hours=F.lit(hours)))


@query("""SELECT count(*) AS n_events, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'error') AS errors,
count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS buyers FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17'""")
def report_counts(t):
    e = t("events").filter((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-17").cast("timestamp_ntz")))
    kind = F.col("event_type")
    return e.agg(F.count("*").alias("n_events"), F.count_if(kind == "view").alias("views"), F.count_if(kind == "error").alias("errors"), F.countDistinct("user_id").alias("users"), F.countDistinct(F.when(kind == "purchase", F.col("user_id"))).alias("buyers"))


@query("""WITH p AS (SELECT v.event_id, v.ts AS asked, min(b.ts) AS answered FROM events v JOIN events b ON b.user_id = v.user_id AND b.event_type = 'purchase' AND b.ts > v.ts WHERE v.event_type = 'view' GROUP BY 1, 2)
SELECT count(*) AS n, round(quantile_cont((epoch_us(answered) - epoch_us(asked)) / 6e7, 0.5), 6) AS median_minutes FROM p""")
def median_response_minutes(t):
    # the next purchase is the least later one; ties in ts are no answer
    bought = F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(Window.partitionBy("user_id").orderBy(F.desc("micros")).rangeBetween(Window.unboundedPreceding, -1))
    e = t("events").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("answered", bought).filter("event_type = 'view' AND answered IS NOT NULL")
    minutes = (F.unix_micros(F.col("answered").cast("timestamp")) - F.col("micros")) / 6e7
    m = e.select(minutes.alias("m"))
    one = F.lit(1).alias("k")  # one row on either side
    return m.agg(F.count("*").alias("n")).select("n", one).join(quantiles(m, [], "m", {"q": ("between", 0.5)}).select("q", one), "k", "left").select("n", F.round("q", 6).alias("median_minutes"))


@query("SELECT event_type, CAST(quantile_disc(value, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95, count(*) AS n FROM events GROUP BY 1")
def nearest_rank_latency(t):
    e = t("events").select("event_type", "value")
    q = quantiles(e, ["event_type"], "value", {"p50": ("nearest", 0.5), "p95": ("nearest", 0.95)}).withColumnRenamed("event_type", "of")
    return e.groupBy("event_type").count().join(q, F.col("event_type").eqNullSafe(F.col("of")), "left").select("event_type", "p50", "p95", F.col("count").alias("n"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(urgent, 0) AS n_urgent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def per_user_counts_with_zeros(t):
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    return t("customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("u", F.lit(0)).alias("n_urgent"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(t):
    """max of a struct, which combines before the shuffle, in place of a window over a key."""
    return t("events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x")).select("user_id", "x.event_id", "x.event_type")


DAY = "CAST(date_trunc('day', ts - INTERVAL 4 HOUR) AS DATE)"


@query(f"""SELECT coalesce(a.d, b.d) AS business_date, coalesce(a.n, 0) AS checks, coalesce(b.n, 0) AS submissions
FROM (SELECT {DAY} AS d, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) a FULL JOIN (SELECT {DAY} AS d, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1) b ON a.d = b.d""")
def record_days_full_join(t):
    e = t("events").withColumn("business_date", business_date(F.col("ts")))
    a = e.filter("event_type = 'error'").groupBy("business_date").agg(F.count("*").alias("a"))
    b = e.filter("event_type = 'signup'").groupBy("business_date").agg(F.count("*").alias("b"))
    return a.join(b, "business_date", "full").select("business_date", F.coalesce("a", F.lit(0)).alias("checks"), F.coalesce("b", F.lit(0)).alias("submissions"))


@query(f"SELECT {DAY} AS business_date, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def business_day_rollup(t):
    return t("events").groupBy(business_date(F.col("ts")).alias("business_date"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


SHIFTS = [(1, "morning", 360, 840), (2, "day", 780, 1260), (3, "night", 1320, 300)]
SHIFT_SQL = "(VALUES (1, 'morning', 360, 840), (2, 'day', 780, 1260), (3, 'night', 1320, 300)) s(sort_order, name, start, stop)"


@query(f"""WITH m AS (SELECT event_id, hour(ts) * 60 + minute(ts) AS mins FROM events),
r AS (SELECT event_id, name, covers, row_number() OVER (PARTITION BY event_id ORDER BY covers DESC, CASE WHEN covers THEN sort_order ELSE later END, sort_order) AS rn
 FROM (SELECT event_id, name, sort_order, CASE WHEN start < stop THEN start <= mins AND mins < stop ELSE mins >= start OR mins < stop END AS covers,
   CASE WHEN (start - 240 + 1440) % 1440 > (mins - 240 + 1440) % 1440 THEN (start - 240 + 1440) % 1440 ELSE 100000 END AS later FROM m, {SHIFT_SQL}))
SELECT event_id, name AS shift, NOT covers AS upcoming FROM r WHERE rn = 1""")
def shift_lookup_wrap(t):
    """The covering shift of each event, else the next to start in the business day. The shifts are a fixed handful, so each event meets them as a literal array."""
    shifts = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("sort_order", "name", "start", "stop"), s, strict=True))) for s in SHIFTS))
    at = F.hour("ts") * 60 + F.minute("ts")
    into = lambda m: F.pmod(m - 60 * fixed.DAY_START_HOUR, F.lit(1440))
    covers = F.when(F.col("start") < F.col("stop"), (F.col("start") <= F.col("at")) & (F.col("at") < F.col("stop"))).otherwise((F.col("at") >= F.col("start")) | (F.col("at") < F.col("stop")))
    later = F.when(into(F.col("start")) > into(F.col("at")), into(F.col("start"))).otherwise(100000)
    pairs = t("events").select("event_id", at.alias("at")).select("*", F.inline(shifts)).withColumn("covers", covers)
    order = F.struct(~F.col("covers"), F.when(F.col("covers"), F.col("sort_order")).otherwise(later), "sort_order")
    return pairs.groupBy("event_id").agg(F.min_by(F.struct("name", "covers"), order).alias("x")).select("event_id", F.col("x.name").alias("shift"), (~F.col("x.covers")).alias("upcoming"))


@query("""SELECT o_orderkey, total, failed, CASE WHEN failed = total THEN 'FAILED' WHEN failed > 0 THEN 'PARTIAL' WHEN cards = 0 THEN 'NO_RESULT' ELSE 'SUCCEEDED' END AS status
FROM (SELECT o_orderkey, count(l_orderkey) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, count(*) FILTER (WHERE l_linestatus = 'F') AS cards FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""")
def job_rollup_status(t):
    """No line at all counts as failed: failed = total = 0."""
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.count_if(F.col("l_linestatus") == "F").alias("cards"))
    j = t("orders").select("o_orderkey").join(lines, "o_orderkey", "left").fillna(0, ["total", "failed", "cards"])
    status = F.when(F.col("failed") == F.col("total"), "FAILED").when(F.col("failed") > 0, "PARTIAL").when(F.col("cards") == 0, "NO_RESULT").otherwise("SUCCEEDED")
    return j.select("o_orderkey", "total", "failed", status.alias("status"))


PAGE = "o_orderkey, o_custkey, o_orderstatus"


@query(f"SELECT {PAGE} FROM orders WHERE o_orderkey < 5000 ORDER BY o_orderkey DESC LIMIT 21")
def keyset_page(t):
    return t("orders").filter("o_orderkey < 5000").orderBy(F.desc("o_orderkey")).limit(21).select(*PAGE.split(", "))


@query(f"SELECT {PAGE} FROM (SELECT * FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 21) ORDER BY o_orderkey DESC")
def keyset_before(t):
    return t("orders").filter("o_orderkey > 5000").orderBy("o_orderkey").limit(21).orderBy(F.desc("o_orderkey")).select(*PAGE.split(", "))


@query(f"SELECT {PAGE} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 30")
def offset_page(t):
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(30).limit(10).select(*PAGE.split(", "))


@query(f"SELECT {PAGE} FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority ILIKE '%urgent%' AND o_custkey IS DISTINCT FROM 7 AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def conjunctive_filter(t):
    """A list of optional predicates; those that aren't given are left out, the rest reach the scan."""
    given = {"status": ["F", "P"], "like": "%urgent%", "not_customer": 7, "since": "1995-01-01", "until": "1996-01-01", "clerk": None}
    col = F.col
    parts = {
        "status": lambda v: col("o_orderstatus").isin(v), "like": lambda v: col("o_orderpriority").ilike(v), "not_customer": lambda v: ~col("o_custkey").eqNullSafe(v),
        "since": lambda v: col("o_orderdate") >= F.lit(v).cast("timestamp_ntz"), "until": lambda v: col("o_orderdate") < F.lit(v).cast("timestamp_ntz"), "clerk": lambda v: col("o_clerk") == v,
    }
    out = t("orders")
    for name, value in given.items():
        if value is not None:
            out = out.filter(parts[name](value))
    return out.select(*PAGE.split(", "))


@query("""SELECT event_id, user_id, n_last_hour FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_last_hour FROM events) WHERE n_last_hour > 1""")
def sliding_rate_limit(t):
    window = Window.partitionBy("user_id").orderBy("micros").rangeBetween(-3_600_000_000, 0)
    e = t("events").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", "user_id", F.count("*").over(window).alias("n_last_hour")).filter("n_last_hour > 1")


@query("""SELECT user_id, session_start, session_end, n FROM (
SELECT user_id, sid, min(ts) AS session_start, max(ts) AS last_ts, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM (
 SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM (
  SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2)""")
def session_windows(t):
    return t("events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


@query("""SELECT event_id, attempts, delay_seconds, ts + CAST(delay_seconds AS INTEGER) * INTERVAL 1 SECOND AS next_at, attempts >= 5 AS terminal FROM (
SELECT event_id, ts, attempts, least(60, pow(2, least(attempts, 6))) AS delay_seconds FROM (SELECT event_id, ts, CAST(event_id % 8 AS INTEGER) AS attempts FROM events WHERE event_type = 'error'))""")
def retry_schedule(t):
    """Exponential backoff, at most a minute."""
    e = t("events").filter("event_type = 'error'").select("event_id", "ts", (F.col("event_id") % 8).cast("int").alias("attempts"))
    e = e.withColumn("delay_seconds", F.least(F.lit(60.0), F.pow(F.lit(2.0), F.least("attempts", F.lit(6)))))
    return e.select("event_id", "attempts", "delay_seconds", (F.col("ts") + F.make_dt_interval(secs=F.col("delay_seconds").cast("int"))).alias("next_at"), (F.col("attempts") >= 5).alias("terminal"))


@query("""SELECT event_id FROM events e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.user_id = e.user_id AND c.event_type IN ('click', 'view') AND c.ts >= e.ts AND c.ts < e.ts + INTERVAL 60 SECOND)""")
def lease_claimable(t):
    """Events not leased: no claim by the same user in the minute from the event on. Equi-join on user and minute bucket, not a cross product."""
    e = t("events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    minute = 60_000_000
    claims = e.filter("event_type IN ('click', 'view')").select("user_id", F.col("at").alias("c_at"), F.floor(F.col("at") / minute).alias("slot"))
    asked = e.filter("event_type = 'purchase'").withColumn("slot", F.explode(F.array(F.floor(F.col("at") / minute), F.floor(F.col("at") / minute) + 1)))
    leased = asked.join(claims, ["user_id", "slot"]).filter("c_at >= at AND c_at < at + 60000000").select("event_id")
    return e.filter("event_type = 'purchase'").select("event_id").join(leased, "event_id", "left_anti")


@query("SELECT event_id, user_id FROM events e WHERE event_type = 'click' AND event_id < (SELECT max(event_id) FROM events n WHERE n.user_id = e.user_id AND n.event_type = 'click')")
def stale_revisions(t):
    """All but the newest revision of each key."""
    e = t("events").filter("event_type = 'click'")
    newest = e.groupBy("user_id").agg(F.max("event_id").alias("newest"))
    return e.join(newest, "user_id").filter("event_id < newest").select("event_id", "user_id")


@query("""SELECT user_id, min(ts) AS from_ts, max(ts) AS to_ts, count(DISTINCT d) AS days FROM (
 SELECT user_id, ts, d, d - CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS island FROM (SELECT user_id, ts, CAST(ts AS DATE) AS d FROM events)) GROUP BY user_id, island""")
def gaps_islands_days(t):
    """Runs of days in a row on which a user was active."""
    e = t("events").select("user_id", "ts", F.to_date("ts").alias("d"))
    rank = F.dense_rank().over(Window.partitionBy("user_id").orderBy("d"))
    return e.withColumn("island", F.date_sub("d", rank)).groupBy("user_id", "island").agg(F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.countDistinct("d").alias("days")).drop("island")


@query("""SELECT user_id, CAST(ts AS DATE) AS day, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type""")
def change_points(t):
    """Events whose kind differs from the user's last one."""
    return t("events").withColumn("before", F.lag("event_type").over(user())).filter("before IS NULL OR before <> event_type").select("user_id", F.to_date("ts").alias("day"), "event_id")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS signup FROM events""")
def fill_down(t):
    return t("events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(user().rowsBetween(Window.unboundedPreceding, 0)).alias("signup"))


@query("SELECT o_custkey, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, max(gap) AS widest FROM (SELECT *, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM orders) GROUP BY 1")
def sequence_gap_audit(t):
    gap = F.col("o_orderkey") - F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return t("orders").withColumn("gap", gap).groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.max("gap").alias("widest"))


@query("""SELECT user_id, event_type, count(*) FILTER (WHERE j <> '') AS n, count(DISTINCT j) AS kinds FROM (SELECT user_id, event_type, json_extract_string(props, '$.k') AS j FROM events) GROUP BY 1, 2""")
def ragged_json_props(t):
    e = t("events").withColumn("j", F.get_json_object("props", "$.k"))
    return e.groupBy("user_id", "event_type").agg(F.count_if(F.col("j") != "").alias("n"), F.countDistinct("j").alias("kinds"))


@query("""SELECT d.user_id, d.event_id AS dismissed, max(e.event_id) AS reopened_by FROM (SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'error' GROUP BY 1) d
JOIN events e ON e.user_id = d.user_id AND e.event_type = 'click' AND e.event_id > d.event_id AND round(e.value) <> round(d.value) GROUP BY 1, 2""")
def dismissal_memory(t):
    """A dismissed pair opens again only if the value has changed since the latest decision."""
    e = t("events")
    d = e.filter("event_type = 'error'").groupBy("user_id").agg(F.max(F.struct("event_id", "value")).alias("x")).select("user_id", F.col("x.event_id").alias("dismissed"), F.col("x.value").alias("was"))
    later = e.filter("event_type = 'click'").join(d, "user_id").filter("event_id > dismissed AND round(value) <> round(was)")
    return later.groupBy("user_id", "dismissed").agg(F.max("event_id").alias("reopened_by"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))""")
def status_cube(t):
    return t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
