"""Readers and writers, tried on the tables."""

from pyspark.sql import functions as F

from ..sources import chat, files
from ..sources.shared import shared_path
from .registry import query


@query(r"""SELECT page_id, CASE regexp_extract(regexp_replace(lower(url), '[?#].*$', ''), '\.([a-z0-9]{1,5})$', 1) WHEN 'html' THEN 'blocks' WHEN 'htm' THEN 'blocks' WHEN 'pdf' THEN 'pages' WHEN 'txt' THEN 'chat' END AS reader FROM pages""")
def file_readers(t):
    return t("pages").select("page_id", files.reader_of(F.col("url")).alias("reader"))


#: Steps to blocks, for Java's regular expressions and DuckDB's: what is no text goes, inline tags go, cells of a row are joined, and breaks are spaces.
BLOCK_STEPS = [
    (r"(?is)<!--.*?-->|<script[ >].*?</script>|<style[ >].*?</style>", ""),
    (r"(?i)</?(?:a|b|i|u|em|strong|span|small|sup|sub|code)(?: [^>]*)?>", ""),
    (r"(?i)<br ?/?>", " "),
    (r"(?i)</t[dh]>[ \t\r\n]*<t[dh](?: [^>]*)?>", " | "),
]
#: A tag with the text behind it, if there is any.
BLOCK = r"<[^>]*>[ \t\r\n]*[^< \t\r\n][^<]*"


def _sql_steps(text: str) -> str:
    for pattern, by in BLOCK_STEPS:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


@query(rf"""SELECT page_id, CAST(ord AS INTEGER) AS ord, CASE WHEN regexp_matches(raw, '(?i)^<h[1-6][ >]') THEN 'HEADING' WHEN regexp_matches(raw, '(?i)^<t[dh][ >]') THEN 'TABLE_ROW' ELSE 'PARA' END AS kind,
trim(regexp_replace(regexp_replace(raw, '^<[^>]*>', ''), '[ \t\r\n]+', ' ', 'g')) AS text
FROM (SELECT page_id, generate_subscripts(m, 1) AS ord, unnest(m) AS raw FROM (SELECT page_id, regexp_extract_all({_sql_steps("'<p>' || html")}, '{BLOCK}') AS m FROM pages))""")
def html_blocks(t):
    """All text of a page in order, a block for each run of text between tags: a heading, a table row (cells joined by a bar) or a paragraph. Inline tags
    don't end a block; comments, scripts and styles are no text; a null page has no blocks."""
    plain = F.concat(F.lit("<p>"), "html")
    for pattern, by in BLOCK_STEPS:
        plain = F.regexp_replace(plain, pattern, by)
    b = t("pages").select("page_id", F.posexplode(F.regexp_extract_all(plain, F.lit(BLOCK), F.lit(0))).alias("pos", "raw"))
    kind = F.when(F.col("raw").rlike("(?i)^<h[1-6][ >]"), "HEADING").when(F.col("raw").rlike("(?i)^<t[dh][ >]"), "TABLE_ROW").otherwise("PARA")
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", "^<[^>]*>", ""), r"[ \t\r\n]+", " "))
    return b.select("page_id", (F.col("pos") + 1).alias("ord"), kind.alias("kind"), text.alias("text"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS file, role AS who, TIMESTAMP '2026-08-18 00:00:00' + CAST(turn % 1440 AS INTEGER) * INTERVAL 1 MINUTE AS sent, text FROM conversations WHERE trim(text) <> ''""")
def chat_export_parse(t):
    """Conversations as a desktop export, one row a line, parsed back; texts of several lines go on without a head."""
    c = t("conversations").filter("trim(text) <> ''").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    minute = F.col("turn") % 1440
    hour = F.floor(minute / 60)
    half = F.when(hour >= 12, "오후").otherwise("오전")
    shown = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    head = F.concat(F.lit("["), "role", F.lit("] ["), half, F.lit(" "), shown.cast("string"), F.lit(":"), F.lpad((minute % 60).cast("string"), 2, "0"), F.lit("] "), "text")
    line = F.when(F.col("i") == 0, head).otherwise(F.col("text"))
    file = F.col("conv_id").cast("string")
    dates = c.select(file.alias("file")).distinct().select("file", F.lit(-1).cast("long").alias("pos"), F.lit("--------------- 2026년 8월 18일 화요일 ---------------").alias("line"))
    return chat.parse(dates.unionByName(c.select(file.alias("file"), (F.col("turn") * 1_000_000 + F.col("i")).alias("pos"), line.alias("line")))).drop("pos")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def snapshot_export(t):
    """Written as JSON lines and read back."""
    o = t("orders").filter("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return files.write_snapshot(o, shared_path(t.spark, "snapshot"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 10 = 0 THEN 'x' || props END AS corrupt FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT event_id, NULL, 'x' || props FROM events WHERE event_id % 10 = 0""".replace("CASE WHEN event_id % 10 = 0 THEN 'x' || props END AS corrupt", "CAST(NULL AS VARCHAR) AS corrupt"))
def checked_json_reader(t):
    """Every tenth line is broken and comes back whole as corrupt."""
    e = t("events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("x"), "props")).otherwise(F.col("props")).alias("line"))
    parsed = F.from_json("line", "k bigint, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    return e.select("event_id", parsed.alias("x")).select("event_id", "x.k", "x.corrupt")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def append_only_new(t):
    """Customers' first orders, for customers that the history doesn't have."""
    o = t("orders")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return files.only_new(first, o.filter("o_orderstatus = 'F'"), ["o_custkey"])


@query()
def object_inventory(t):
    return files.inventory(t.spark, t.sf_dir, "*.parquet")
