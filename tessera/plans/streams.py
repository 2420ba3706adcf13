"""Streaming queries, each with its batch twin as the oracle."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import question_key
from ..sources.shared import shared_path
from ..streaming import delivery
from ..streaming.contexts import FAILED_MOST, RETAIN, TTL, TURNS_MOST, forget_context, turn
from ..streaming.jobs import appended, completed, events, stream
from ..streaming.maintained import View, maintain
from ..streaming.ordered import replayed
from .dialogue import KEY
from .registry import query


def plain(c):
    return F.col(c).cast("timestamp_ntz").alias(c)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(t):
    s = events(t.spark, t.sf_dir).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return completed(s.select(F.col("w.start").alias("start"), "event_type", "n", "total")).select(plain("start"), "event_type", "n", "total")


@query("SELECT w AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1")
def stream_sliding(t):
    s = events(t.spark, t.sf_dir).groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return completed(s.select(F.col("w.start").alias("start"), "n")).select(plain("start"), "n")


SESSIONS = """SELECT user_id, start, n FROM (SELECT user_id, sid, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM (
 SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL {} MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2)"""


@query(SESSIONS.format(30))
def stream_session(t):
    s = events(t.spark, t.sf_dir).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return completed(s.select("user_id", F.col("w.start").alias("start"), "n")).select("user_id", plain("start"), "n")


@query(SESSIONS.format(10))
def stream_context_ttl(t):
    """A user's context lives until ten minutes pass without an event."""
    s = events(t.spark, t.sf_dir).groupBy("user_id", F.session_window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n"))
    return completed(s.select("user_id", F.col("w.start").alias("start"), "n")).select("user_id", plain("start"), "n")


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_dedup(t):
    """Each event once, however often and late it is delivered; the state holds all event_ids."""
    return appended(events(t.spark, t.sf_dir).dropDuplicates(["event_id"]).select("event_id", "user_id", "event_type"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def stream_latest(t):
    newest = F.max(F.struct("ts", "event_id", "event_type"))
    s = events(t.spark, t.sf_dir).groupBy("user_id").agg(newest.alias("x"))
    return completed(s.select("user_id", F.col("x.event_type").alias("event_type"), F.col("x.ts").alias("ts"))).select("user_id", "event_type", plain("ts"))


@query("SELECT user_id, max(event_id) AS revision, count(*) - 1 AS stale FROM events WHERE event_type = 'click' GROUP BY 1")
def stream_stale(t):
    s = events(t.spark, t.sf_dir).filter("event_type = 'click'").groupBy("user_id").agg(F.max("event_id").alias("revision"), (F.count("*") - 1).alias("stale"))
    return completed(s)


@query(f"SELECT {KEY} AS question_key, count(*) AS n, max(conv_id) AS last_conv FROM conversations WHERE role = 'user' GROUP BY 1")
def stream_pending(t):
    s = stream(t.spark, t.sf_dir, "conversations").filter("role = 'user'").groupBy(question_key(F.col("text")).alias("question_key")).agg(F.count("*").alias("n"), F.max("conv_id").alias("last_conv"))
    return completed(s)


NUMBERED = "r AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


def publish(state, row):
    """One request of a store: a key that was applied is answered again, another revision than the present one is stale."""
    (revision, applied), (_, event_id) = state, row
    name = event_id % 23
    if name in applied:
        return state, (event_id, "ALREADY_APPLIED", revision)
    if event_id % 7 != revision:
        return state, (event_id, "STALE", revision)
    return (revision + 1, [*applied, name]), (event_id, "PUBLISHED", revision + 1)


@query(f"""WITH RECURSIVE {NUMBERED}, s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0::BIGINT AS event_id, '' AS status, 0::BIGINT AS revision, []::BIGINT[] AS applied FROM r UNION ALL
SELECT user_id, n, event_id, status, CASE WHEN status = 'PUBLISHED' THEN revision + 1 ELSE revision END, CASE WHEN status = 'PUBLISHED' THEN list_append(applied, event_id % 23) ELSE applied END FROM
 (SELECT s.user_id, r.n, r.event_id, revision, applied, CASE WHEN list_contains(applied, r.event_id % 23) THEN 'ALREADY_APPLIED' WHEN r.event_id % 7 <> revision THEN 'STALE' ELSE 'PUBLISHED' END AS status FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1))
SELECT user_id, event_id, status, revision FROM s WHERE n > 0""")
def stream_publish(t):
    """Requests to publish, in the order of their time: compare the revision, raise it, and answer repeated operation keys as before."""
    return replayed(events(t.spark, t.sf_dir), "user_id", ["event_id"], "revision long, applied array<long>", (0, []), "event_id long, status string, revision long", publish)


LEASE, PAUSE, ATTEMPTS = 8 * 3_600_000_000, 900_000_000, 3


def lease(state, row):
    """One action on an outbox event: view claims it, click is a heartbeat, purchase finishes it, error fails it, signup puts a new one in its place."""
    (status, until, attempts), (now, event_id, event_type) = state, row
    live = status == "CLAIMED" and until > now
    if event_type == "signup":
        state, said = ("NEW", 0, 0), "NEW"
    elif event_type == "view":
        if status in ("DONE", "TERMINAL"):
            said = "NONE"
        elif until > now:
            said = "HELD"
        elif attempts >= ATTEMPTS:
            state, said = ("TERMINAL", 0, attempts), "EXHAUSTED"
        else:
            state, said = ("CLAIMED", now + LEASE, attempts + 1), "CLAIMED"
    elif not live:
        said = "LOST"
    elif event_type == "click":
        state, said = (status, now + LEASE, attempts), "EXTENDED"
    elif event_type == "purchase":
        state, said = ("DONE", 0, attempts), "DONE"
    elif attempts < ATTEMPTS:
        state, said = ("FAILED", now + min(fixed.RETRY_SECONDS_MOST, 2 ** min(attempts, 6)) * PAUSE, attempts), "RETRY"
    else:
        state, said = ("TERMINAL", 0, attempts), "EXHAUSTED"
    return state, (event_id, said, state[2])


@query(f"""WITH RECURSIVE {NUMBERED}, s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0::BIGINT AS event_id, '' AS said, 'NEW' AS status, 0::BIGINT AS until, 0::BIGINT AS attempts FROM r UNION ALL
SELECT user_id, n, event_id, said, CASE said WHEN 'NEW' THEN 'NEW' WHEN 'EXHAUSTED' THEN 'TERMINAL' WHEN 'CLAIMED' THEN 'CLAIMED' WHEN 'DONE' THEN 'DONE' WHEN 'RETRY' THEN 'FAILED' ELSE status END,
 CASE WHEN said IN ('NEW', 'EXHAUSTED', 'DONE') THEN 0 WHEN said IN ('CLAIMED', 'EXTENDED') THEN now + {LEASE} WHEN said = 'RETRY' THEN now + CAST(least({fixed.RETRY_SECONDS_MOST}, power(2, least(attempts, 6))) AS BIGINT) * {PAUSE} ELSE until END,
 CASE said WHEN 'NEW' THEN 0 WHEN 'CLAIMED' THEN attempts + 1 ELSE attempts END FROM
 (SELECT s.user_id, r.n, r.event_id, r.now, status, until, attempts, CASE WHEN event_type = 'signup' THEN 'NEW' WHEN event_type = 'view' THEN CASE WHEN status IN ('DONE', 'TERMINAL') THEN 'NONE' WHEN until > now THEN 'HELD' WHEN attempts >= {ATTEMPTS} THEN 'EXHAUSTED' ELSE 'CLAIMED' END
  WHEN status <> 'CLAIMED' OR until <= now THEN 'LOST' WHEN event_type = 'click' THEN 'EXTENDED' WHEN event_type = 'purchase' THEN 'DONE' WHEN attempts < {ATTEMPTS} THEN 'RETRY' ELSE 'EXHAUSTED' END AS said FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1))
SELECT user_id, event_id, said, attempts FROM s WHERE n > 0""")
def stream_leases(t):
    """Leases on outbox events with heartbeats, growing pauses before a retry, and an end after three attempts (hours here, as events are rare)."""
    return replayed(events(t.spark, t.sf_dir), "user_id", ["event_id", "event_type"], "status string, until long, attempts long", ("NEW", 0, 0), "event_id long, said string, attempts long", lease)


@query(f"""WITH RECURSIVE r AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS now, day(ts) // 10 - CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS known, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0::BIGINT AS event_id, '' AS said, 0::BIGINT AS turns, 0::BIGINT AS revision, 0::BIGINT AS offered, 0::BIGINT AS knowledge, 0::BIGINT AS expires, []::BIGINT[] AS failed FROM r UNION ALL
SELECT user_id, n, event_id, said, CASE said WHEN 'ASKED' THEN 1 WHEN 'OFFERED' THEN turns + 1 ELSE turns END, CASE said WHEN 'ASKED' THEN 1 WHEN 'OFFERED' THEN revision + 1 WHEN 'ACCEPTED' THEN revision + 1 ELSE revision END,
 CASE WHEN said IN ('ASKED', 'OFFERED') THEN now WHEN said = 'ACCEPTED' THEN 0 ELSE offered END, CASE WHEN said IN ('ASKED', 'ACCEPTED') THEN known ELSE knowledge END, CASE WHEN said IN ('ASKED', 'ACCEPTED') THEN now + {TTL} ELSE expires END,
 CASE WHEN said = 'FAILED' THEN list_append(failed, now)[-{FAILED_MOST}:] ELSE failed END FROM
 (SELECT *, CASE WHEN event_type = 'signup' THEN 'ASKED' WHEN event_type = 'error' THEN 'FAILED' WHEN turns = 0 THEN 'NOT_FOUND' WHEN expires <= now THEN 'EXPIRED' WHEN event_type = 'purchase' THEN 'FOUND'
   WHEN event_type = 'view' THEN CASE WHEN offered > 0 THEN 'OPEN_OFFER' WHEN turns >= {TURNS_MOST} THEN 'LIMIT' ELSE 'OFFERED' END
   WHEN known < knowledge THEN 'STALE_KNOWLEDGE' WHEN revision <> 1 + event_id % 3 THEN 'CHANGED' WHEN offered = 0 THEN 'NO_OFFER' WHEN len(list_filter(failed, lambda x: x > offered)) > 0 THEN 'UNBOUND' ELSE 'ACCEPTED' END AS said FROM
  (SELECT r.*, CASE WHEN expires + {RETAIN} > now THEN turns ELSE 0 END AS turns, CASE WHEN expires + {RETAIN} > now THEN revision ELSE 0 END AS revision, CASE WHEN expires + {RETAIN} > now THEN offered ELSE 0 END AS offered, CASE WHEN expires + {RETAIN} > now THEN knowledge ELSE 0 END AS knowledge, CASE WHEN expires + {RETAIN} > now THEN expires ELSE 0 END AS expires,
    list_filter(failed, lambda x: x > now - {RETAIN}) AS failed FROM s JOIN (SELECT * FROM r) r ON r.user_id = s.user_id AND r.n = s.n + 1)))
SELECT user_id, event_id, said, turns, revision, len(failed) AS failed FROM s WHERE n > 0""")
def stream_contexts(t):
    """Clarification contexts: a question opens one, an offer and its selection raise its revision, at most TURNS_MOST offers; it lives TTL after the last selection (a day here, as
    events are rare) and is swept RETAIN later; the last FAILED_MOST failed turns are kept as long, and one since an offer unbinds typed selections. signup asks, view offers, click
    selects (the revision and knowledge it was shown come from its id and day), purchase reads, error fails."""
    e = events(t.spark, t.sf_dir).withColumn("known", (F.dayofmonth("ts") / 10).cast("long") - F.when(F.col("event_id") % 5 == 0, 1).otherwise(0))
    state = "turns long, revision long, offered long, knowledge long, expires long, failed array<long>"
    return replayed(e, "user_id", ["event_id", "event_type", "known"], state, (0, 0, 0, 0, 0, []), "event_id long, said string, turns long, revision long, failed long", turn, forget_context)


CHANGES = """c AS (SELECT user_id AS card_id, user_id % 5 AS store_id, {ts: ts, id: event_id} AS moment, CASE WHEN event_type IN ('click', 'purchase') AND event_id % 12 <> 11 THEN event_id % 12 END AS category, event_id AS version FROM events),
items AS (SELECT card_id, store_id, max(moment) FILTER (WHERE category IS NOT NULL) AS placed, arg_max(category, moment) FILTER (WHERE category IS NOT NULL) AS category, arg_max(version, moment) FILTER (WHERE category IS NOT NULL) AS version,
 coalesce(max(moment) FILTER (WHERE category IS NOT NULL) = max(moment), false) AS is_active FROM c GROUP BY ALL)"""


def roadmap(t) -> View:
    """Events as changes of the cards of five stores: click and purchase publish a version in a category (one id of twelve has none), all others take the card back."""
    e = events(t.spark, t.sf_dir)
    category = F.when(F.col("event_type").isin("click", "purchase") & (F.col("event_id") % 12 != 11), F.col("event_id") % 12)
    stage = F.when(category.isNotNull(), F.struct((F.col("user_id") % 5).alias("store_id"), category.alias("category")))
    changes = e.select(F.col("user_id").alias("key"), F.struct("ts", F.col("event_id").alias("id")).alias("at"), stage.alias("grp"), F.col("event_id").alias("weight"))
    return maintain(changes, shared_path(t.spark, "roadmap"))


@query(f"WITH {CHANGES} SELECT card_id, store_id, category, version, is_active FROM items WHERE placed IS NOT NULL")
def stream_roadmap_items(t):
    """Each card that was ever published in a category, with its last place, and whether it is still shown there."""
    return roadmap(t).keys().select(F.col("key").alias("card_id"), "grp.store_id", "grp.category", F.col("weight").alias("version"), F.col("holds").alias("is_active"))


@query(f"""WITH {CHANGES} SELECT g.store_id, g.category, row_number() OVER (PARTITION BY g.store_id ORDER BY g.began) AS stage_order, count(i.card_id) AS n_items, count(i.card_id) > 0 AS is_active, coalesce(sum(i.version), 0)::BIGINT AS versions
FROM (SELECT store_id, category, min(moment) AS began FROM c WHERE category IS NOT NULL GROUP BY ALL) g LEFT JOIN items i ON i.store_id = g.store_id AND i.category = g.category AND i.is_active GROUP BY g.store_id, g.category, g.began""")
def stream_roadmap(t):
    """The stages of each store's roadmap, in the order in which its categories were first used (one row a category in the window); a stage whose cards have all gone stays, inactive. `versions` sums the versions shown."""
    order = F.row_number().over(Window.partitionBy("grp.store_id").orderBy("first")).cast("long")
    return roadmap(t).groups().select("grp.store_id", "grp.category", order.alias("stage_order"), F.col("n").alias("n_items"), (F.col("n") > 0).alias("is_active"), F.col("weight").alias("versions"))


@query("""WITH RECURSIVE e AS (SELECT user_id * 4 + device AS subscription_id, event_id, epoch_us(ts) AS now, CASE WHEN event_type <> 'signup' THEN user_id * 10 + event_id % 10 END AS notification,
 CASE (event_id + device) % 7 WHEN 0 THEN 410 WHEN 1 THEN 500 WHEN 2 THEN 404 ELSE 201 END AS answer FROM events, unnest(range(user_id % 4)) AS d(device)),
r AS (SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY now, event_id) AS n FROM e),
s AS (SELECT DISTINCT subscription_id, 0::BIGINT AS n, 0::BIGINT AS event_id, 0::BIGINT AS now, NULL::BIGINT AS notification, '' AS said, false AS sent, true AS enabled, []::BIGINT[] AS got FROM r UNION ALL
SELECT subscription_id, n, event_id, now, notification, said, sent, CASE WHEN said = 'JOINED' THEN true WHEN said = 'FAILED' AND answer IN (404, 410) THEN false ELSE enabled END, CASE WHEN said = 'REQUESTED' AND sent THEN list_append(got, notification) ELSE got END FROM
 (SELECT *, said IN ('REQUESTED', 'FAILED') AND NOT list_contains(got, notification) AS sent FROM (SELECT s.subscription_id, r.n, r.event_id, r.now, r.notification, r.answer, enabled, got,
   CASE WHEN r.notification IS NULL THEN 'JOINED' WHEN NOT enabled THEN 'OFF' WHEN list_contains(got, r.notification) OR answer < 300 THEN 'REQUESTED' ELSE 'FAILED' END AS said FROM s JOIN r ON r.subscription_id = s.subscription_id AND r.n = s.n + 1))),
runs AS (SELECT notification, event_id, now, count(*) FILTER (WHERE said <> 'OFF') AS tried, count(*) FILTER (WHERE said = 'REQUESTED') AS got, count(*) FILTER (WHERE sent) AS sends FROM s WHERE n > 0 AND notification IS NOT NULL GROUP BY ALL)
SELECT notification, CASE WHEN max(tried) = 0 THEN 'PENDING' WHEN arg_max(got, (now, event_id)) FILTER (WHERE tried > 0) > 0 THEN 'REQUESTED' ELSE 'FAILED' END AS status, count(*) AS requests, sum(tried)::BIGINT AS attempts, sum(sends)::BIGINT AS sends FROM runs GROUP BY 1""")
def stream_delivery(t):
    """Requests to notify a user go to each of the user's devices; a device that has the message isn't sent it again, one whose subscription is gone takes none until it joins again (signup).
    Devices, notifications and the service's answers come from user and event ids by rule."""
    e = events(t.spark, t.sf_dir).filter("user_id % 4 > 0").withColumn("device", F.explode(F.sequence(F.lit(0).cast("long"), F.col("user_id") % 4 - 1)))
    kind = (F.col("event_id") + F.col("device")) % 7
    e = e.select(
        "ts", "event_id", (F.col("user_id") * 4 + F.col("device")).alias("subscription_id"), F.when(F.col("event_type") != "signup", F.col("user_id") * 10 + F.col("event_id") % 10).otherwise(delivery.NONE).alias("notification"),
        F.when(kind == 0, 410).when(kind == 1, 500).when(kind == 2, 404).otherwise(201).cast("long").alias("answer"),
    )
    done = replayed(e, "subscription_id", ["event_id", "notification", "answer"], delivery.STATE, delivery.START, "event_id long, notification long, said string, sent boolean", delivery.deliver)
    when = t("events").select("event_id", F.col("ts").alias("at"))
    return delivery.folded(done.join(when, "event_id"))
