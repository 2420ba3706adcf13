"""URL filters by a temporal list join, in DataFrame operations only.

A dated list (entry_date, kind, key, action) says from which day an entry holds: kind is `domain` (the host and all below
it) or `prefix` (host plus leading path segments), action is `block`, `allow` or `remove` (the entry ends). The entries
of a key become validity intervals [valid_from, valid_to). Each capture yields the keys that could hold it - its host, the parent domains,
and its path prefixes - and an as-of join finds, for each key, the one interval that was the last to begin by the day of the fetch, if it still held. The
longest active key decides. No row is written for the other intervals of a key.

Lists up to BROADCAST_ROWS intervals (counted first) are broadcast as one timeline for each key. Longer ones are joined by a sorted union: list entries
and captures of a key in the order of days, each capture takes the last entry before it. Keys that over SALT_ROWS captures ask for are
dealt over several tasks, each with that key's entries, so a host with a third of all captures is spread.

List keys are brought to the form of captures: scheme, user, port, query, leading `.` or `*.` and final dot of a host go, hosts are lower-cased, empty path
segments dropped; entries that are one in that form share intervals. A prefix without a path holds the host itself. A domain key with a path, or a key
without a host, matches nothing.

Captures without a host match nothing and pass; null url or fetch time passes; repeated captures are judged each on its own;
of several entries of one key and day the last by action holds. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

BROADCAST_ROWS = 100_000
SALT_ROWS = 200_000
SPAN = ["valid_from", "valid_to", "action"]


def host_of(url: Column) -> Column:
    """The lower-case host without user, port and final dot; empty if there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.regexp_replace(host, r"\.$", "")


def path_of(url: Column) -> Column:
    """The path without query and fragment, as the url has it."""
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def prefix_key(host: Column, parts: Column) -> Column:
    return F.array_join(F.concat(F.array(host), parts), "/")


def list_key(kind: Column, key: Column) -> Column:
    """A list's key in the form of the keys of captures; null if it can match nothing."""
    url = F.when(F.trim(key).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), F.trim(key)).otherwise(F.concat(F.lit("any://"), F.trim(key)))
    host, parts = F.regexp_replace(host_of(url), r"^(\*?\.)+", ""), segments(path_of(url))
    return F.when(host == "", None).when(kind == "prefix", prefix_key(host, parts)).when(F.size(parts) == 0, host)


def validity(entries: DataFrame) -> DataFrame:
    """Dated entries as intervals: key, kind, action, valid_from, valid_to (null: still valid)."""
    day = Window.partitionBy("kind", "key").orderBy("entry_date")
    named = entries.withColumn("key", list_key(F.col("kind"), F.col("key"))).filter("key IS NOT NULL AND entry_date IS NOT NULL")
    one = named.groupBy("kind", "key", "entry_date").agg(F.max("action").alias("action"))
    return one.select("kind", "key", "action", F.col("entry_date").alias("valid_from"), F.lead("entry_date").over(day).alias("valid_to")).filter("action <> 'remove'")


def candidate_keys(host: Column, path: Column, depths: list[int]) -> Column:
    """All keys of a capture: parent domains of its host, and its host with as many path segments as entries of the list have (depths)."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    parts = segments(path)
    held = F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda i: i <= F.size(parts))
    prefixes = F.transform(held, lambda i: F.struct(F.lit("prefix").alias("kind"), prefix_key(host, F.slice(parts, 1, i)).alias("key")))
    return F.when(host == "", F.array().cast("array<struct<kind:string,key:string>>")).otherwise(F.concat(domains, prefixes))


def asof_broadcast(keys: DataFrame, active: DataFrame) -> DataFrame:
    """keys with `entry`, the last interval of its key to begin by `fetched`."""
    timelines = active.groupBy("kind", "key").agg(F.sort_array(F.collect_list(F.struct(*SPAN))).alias("spans"))
    begun = F.filter("spans", lambda s: s["valid_from"] <= F.col("fetched"))
    return keys.join(F.broadcast(timelines), ["kind", "key"], "left").withColumn("entry", F.try_element_at(begun, F.lit(-1))).drop("spans")


def asof_sorted(keys: DataFrame, active: DataFrame, salt_rows: int) -> DataFrame:
    """The same by a sorted union of entries and captures."""
    hot = keys.filter("key IS NOT NULL").groupBy("kind", "key").count().filter(F.col("count") > salt_rows)
    hot = materialise(hot.select("kind", "key", F.ceil(F.col("count") / salt_rows).cast("int").alias("parts")), "url-hot")
    parts = F.coalesce("parts", F.lit(1))
    asked = keys.filter("key IS NOT NULL").join(hot, ["kind", "key"], "left").withColumn("salt", F.pmod(F.xxhash64("row"), parts).cast("int")).drop("parts")
    listed = active.join(hot, ["kind", "key"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    capture = F.struct(*(c for c in keys.columns if c not in ("kind", "key")))
    events = asked.select("kind", "key", "salt", F.col("fetched").alias("day"), F.lit(1).alias("turn"), F.lit(None).cast(active.select(F.struct(*SPAN).alias("e")).schema["e"].dataType).alias("entry"), capture.alias("capture"))
    events = events.unionByName(listed.select("kind", "key", "salt", F.col("valid_from").alias("day"), F.lit(0).alias("turn"), F.struct(*SPAN).alias("entry")), allowMissingColumns=True)
    window = Window.partitionBy("kind", "key", "salt").orderBy("day", "turn").rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("entry", F.last("entry", True).over(window)).filter("turn = 1").select("kind", "key", "capture.*", "entry")
    return found.unionByName(keys.filter("key IS NULL"), allowMissingColumns=True)


def filter_urls(captures: DataFrame, entries: DataFrame, broadcast_rows: int = BROADCAST_ROWS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """captures: capture_id, url, fetched (date). Returns capture_id, url, host, fetched, blocked, rule, rule_kind, n_active."""
    active = materialise(validity(entries), "url-list")
    deep = F.when(F.col("kind") == "prefix", F.size(segments(F.col("key"))) - 1)
    listed = active.agg(F.count("*").alias("n"), F.collect_set(deep).alias("depths")).first()
    asked = captures.select("capture_id", "url", "fetched", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    asked = asked.withColumn("row", F.monotonically_increasing_id())
    keys = asked.select("*", F.explode_outer(candidate_keys(F.col("host"), F.col("path"), sorted(listed.depths))).alias("k")).select("row", "capture_id", "url", "host", "fetched", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"))
    joined = asof_broadcast(keys, active) if listed.n <= broadcast_rows else asof_sorted(keys, active, salt_rows)
    held = F.col("entry").isNotNull() & (F.col("entry.valid_to").isNull() | (F.col("fetched") < F.col("entry.valid_to")))
    hit = F.when(held, F.struct(F.length("key").alias("n"), "key", "kind", F.col("entry.action").alias("action")))
    best = joined.groupBy("row", "capture_id", "url", "host", "fetched").agg(F.max(hit).alias("best"), F.count(hit).alias("n_active"))
    return best.select("capture_id", "url", "host", "fetched", (F.coalesce(F.col("best.action"), F.lit("allow")) == "block").alias("blocked"), F.col("best.key").alias("rule"), F.col("best.kind").alias("rule_kind"), "n_active")


def captures_of(pages: DataFrame) -> DataFrame:
    """pages carry no fetch time; the query dates them from page_id over the 366 days of 2024."""
    return pages.select(F.col("page_id").alias("capture_id"), "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")).alias("fetched"))


def digits(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 2), 16, 10).cast("int")


def dated_list(pages: DataFrame) -> DataFrame:
    """The query's list, drawn by rule from the hosts seen: of the hosts by the first two md5 digits mod 7, 0 is blocked, released and blocked
    again; 1 is blocked from spring on but for its /en pages; 2 was blocked until summer; one registered domain goes in autumn."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    code = digits(F.col("host")) % 7
    dated = lambda day, kind, key, action: F.struct(F.lit(day).cast("date").alias("entry_date"), F.lit(kind).alias("kind"), key.alias("key"), F.lit(action).alias("action"))
    host = F.col("host")
    found = F.when(code == 0, F.array(dated("2024-02-01", "domain", host, "block"), dated("2024-05-15", "domain", host, "remove"), dated("2024-09-01", "domain", host, "block")))
    found = found.when(code == 1, F.array(dated("2024-03-20", "domain", host, "block"), dated("2024-03-20", "prefix", F.concat(host, F.lit("/en")), "allow")))
    found = found.when(code == 2, F.array(dated("2023-01-01", "domain", host, "block"), dated("2024-06-21", "domain", host, "remove")))
    wide = hosts.select(F.explode(F.array(dated("2024-10-01", "domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), "block"))).alias("e")).filter(digits(F.col("e.key")) % 2 == 0).distinct()
    return hosts.select(F.explode(found).alias("e")).unionByName(wide).select("e.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(captures_of(pages), dated_list(pages)).withColumnRenamed("capture_id", "page_id")


ORACLE = r"""
WITH captures AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched,
         regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1), '\.$', '') AS host,
         regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
hosts AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 2) AS INTEGER) % 7 AS code FROM captures WHERE host <> ''),
wide AS (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS key FROM hosts),
entries AS (
  SELECT host AS key, 'domain' AS kind, 'block' AS action, DATE '2024-02-01' AS valid_from, DATE '2024-05-15' AS valid_to FROM hosts WHERE code = 0
  UNION ALL SELECT host, 'domain', 'block', DATE '2024-09-01', NULL FROM hosts WHERE code = 0
  UNION ALL SELECT host, 'domain', 'block', DATE '2024-03-20', NULL FROM hosts WHERE code = 1
  UNION ALL SELECT host || '/en', 'prefix', 'allow', DATE '2024-03-20', NULL FROM hosts WHERE code = 1
  UNION ALL SELECT host, 'domain', 'block', DATE '2023-01-01', DATE '2024-06-21' FROM hosts WHERE code = 2
  UNION ALL SELECT key, 'domain', 'block', DATE '2024-10-01', NULL FROM wide WHERE key <> '' AND CAST('0x' || substr(md5(key), 1, 2) AS INTEGER) % 2 = 0),
hits AS (
  SELECT c.page_id, e.key, e.kind, e.action, row_number() OVER (PARTITION BY c.page_id ORDER BY length(e.key) DESC, e.key DESC, e.kind DESC) AS rank,
         count(*) OVER (PARTITION BY c.page_id) AS n_active
  FROM captures c JOIN entries e
    ON c.fetched >= e.valid_from AND (e.valid_to IS NULL OR c.fetched < e.valid_to)
   AND (e.kind = 'domain' AND (c.host = e.key OR ends_with(c.host, '.' || e.key))
     OR e.kind = 'prefix' AND starts_with(c.host || regexp_replace(c.path, '/+', '/', 'g') || '/', e.key || '/')))
SELECT c.page_id, c.url, c.host, c.fetched, coalesce(h.action, 'allow') = 'block' AS blocked, h.key AS rule, h.kind AS rule_kind, coalesce(h.n_active, 0) AS n_active
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.rank = 1
"""
