"""Sections of documents, and checks and repairs of transcribed tables. An order is a table, its lines in order of place are the rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import checks
from .answers import LINES, lines
from ..operators.boxes import box_pairs
from .registry import query

LEAST_CHARS, MOST_SECTIONS = 200, 8


@query(f"""WITH b AS (SELECT doc_id, pos, part, CASE WHEN regexp_matches(part, '[0-9]') THEN 'ROW' WHEN length(part) <= 40 THEN 'HEADING' ELSE 'PARA' END AS kind FROM
 (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS part FROM documents) WHERE trim(part) <> ''),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR kind = 'HEADING' OR (kind <> 'ROW' AND before = 'ROW') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM b)),
g AS (SELECT doc_id, run, min(pos) AS first_line, max(pos) AS last_line, count(*) AS n, sum(length(part)) AS chars FROM r GROUP BY 1, 2),
m AS (SELECT *, sum(CASE WHEN run = 1 OR chars >= {LEAST_CHARS} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY run) AS grp FROM g),
k AS (SELECT *, sum(chars) FILTER (WHERE grp = 1) OVER (PARTITION BY doc_id) < {LEAST_CHARS} AS short, max(grp) OVER (PARTITION BY doc_id) AS groups FROM m),
i AS (SELECT *, CASE WHEN short AND groups > 1 THEN greatest(grp, 2) - 2 ELSE grp - 1 END AS i, CASE WHEN short AND groups > 1 THEN groups - 1 ELSE groups END AS total FROM k),
s AS (SELECT *, CASE WHEN total <= {MOST_SECTIONS} THEN i WHEN i < (total % {MOST_SECTIONS}) * (total // {MOST_SECTIONS} + 1) THEN i // (total // {MOST_SECTIONS} + 1) ELSE total % {MOST_SECTIONS} + (i - (total % {MOST_SECTIONS}) * (total // {MOST_SECTIONS} + 1)) // (total // {MOST_SECTIONS}) END AS section FROM i)
SELECT doc_id, CAST(section + 1 AS BIGINT) AS section, min(first_line) AS first_line, max(last_line) AS last_line, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(chars) AS BIGINT) AS n_chars FROM s GROUP BY 1, 2""")
def document_sections(t):
    """A document's lines as sections: a heading, or prose after rows, starts a run; short runs join the one before (the first joins the next), and neighbours
    are merged evenly into at most eight. All windows and groups share one shuffle by document."""
    doc = Window.partitionBy("doc_id")
    d = t("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "part")).filter(F.trim("part") != "")
    kind = F.when(F.col("part").rlike("[0-9]"), "ROW").when(F.length("part") <= 40, "HEADING").otherwise("PARA")
    d = d.repartition("doc_id").select("doc_id", "pos", F.length("part").alias("size"), kind.alias("kind"))
    before = F.lag("kind").over(doc.orderBy("pos"))
    new = before.isNull() | (F.col("kind") == "HEADING") | ((F.col("kind") != "ROW") & (before == "ROW"))
    d = d.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(doc.orderBy("pos")))
    g = d.groupBy("doc_id", "run").agg(F.min("pos").alias("first_line"), F.max("pos").alias("last_line"), F.count("*").alias("n"), F.sum("size").alias("chars"))
    g = g.withColumn("grp", F.sum(((F.col("run") == 1) | (F.col("chars") >= LEAST_CHARS)).cast("int")).over(doc.orderBy("run")))
    g = g.withColumn("short", F.sum(F.when(F.col("grp") == 1, F.col("chars"))).over(doc) < LEAST_CHARS).withColumn("groups", F.max("grp").over(doc))
    join = F.col("short") & (F.col("groups") > 1)
    g = g.withColumn("i", F.when(join, F.greatest("grp", F.lit(2)) - 2).otherwise(F.col("grp") - 1)).withColumn("total", F.when(join, F.col("groups") - 1).otherwise(F.col("groups")))
    size, extra, i = F.floor(F.col("total") / MOST_SECTIONS), F.col("total") % MOST_SECTIONS, F.col("i")
    wide = extra * (size + 1)
    section = F.when(F.col("total") <= MOST_SECTIONS, i).when(i < wide, F.floor(i / (size + 1))).otherwise(extra + F.floor((i - wide) / size))
    g = g.groupBy("doc_id", (section + 1).cast("long").alias("section"))
    return g.agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.sum("n").alias("n_lines"), F.sum("chars").alias("n_chars"))


@query(LINES + """, r AS (SELECT l_orderkey AS tab, place - 1 AS row, CASE WHEN l_returnflag <> 'A' THEN l_partkey % 12 END AS label, CASE WHEN l_tax = 0.08 THEN 2 ELSE 3 END AS cells FROM l),
f AS (SELECT tab, label, min(row) AS row FROM r WHERE label IS NOT NULL GROUP BY 1, 2), g AS (SELECT *, label - lag(label) OVER (PARTITION BY tab ORDER BY label) AS step FROM f),
h AS (SELECT *, sum(step - 1) OVER (PARTITION BY tab) AS missing, row_number() OVER (PARTITION BY tab ORDER BY label) AS gap FROM g WHERE step > 1)
SELECT tab, row, 'COLUMN_COUNT' AS code FROM r WHERE cells <> 3 UNION ALL SELECT r.tab, r.row, 'ROW_COUNT' FROM r JOIN f USING (tab, label) WHERE r.row > f.row
UNION ALL SELECT tab, row, 'ROW_MISSING' FROM h WHERE missing <= 5 OR gap = 1 UNION ALL SELECT tab, max(row), 'ROW_COUNT' FROM r GROUP BY 1 HAVING count(*) < 5""")
def table_checks(t):
    """Rows with another number of cells than the header, labels that come twice, gaps in numbered labels (told at the row after the gap; only the first if more are
    missing than expected rows), and tables with fewer rows than expected."""
    r = lines(t).select(
        F.col("l_orderkey").alias("tab"), (F.col("place") - 1).alias("row"), F.when(F.col("l_returnflag") != "A", F.col("l_partkey") % 12).alias("label"), F.when(F.col("l_tax") == 0.08, 2).otherwise(3).alias("cells")
    )
    by = Window.partitionBy("tab")
    first, n, last = F.min("row").over(Window.partitionBy("tab", "label")), F.count("*").over(by), F.max("row").over(by)
    # a label's first row stands for it: the others get no number
    r = r.withColumn("twice", F.col("label").isNotNull() & (F.col("row") > first)).withColumn("few", (n < 5) & (F.col("row") == last))
    r = r.withColumn("number", F.when(~F.col("twice"), F.col("label")))
    r = r.withColumn("step", F.when(F.col("number").isNotNull(), F.col("number") - F.lag("number").over(by.orderBy(F.asc_nulls_first("number")))))
    gap = F.when(F.col("step") > 1, F.col("step") - 1)
    r = r.withColumn("gap", gap).withColumn("missing", F.sum("gap").over(by)).withColumn("lowest", F.min(F.when(F.col("gap").isNotNull(), F.col("number"))).over(by))
    skipped = F.col("gap").isNotNull() & ((F.col("missing") <= 5) | (F.col("number") == F.col("lowest")))
    codes = F.array(F.when(F.col("cells") != 3, "COLUMN_COUNT"), F.when(F.col("twice"), "ROW_COUNT"), F.when(skipped, "ROW_MISSING"), F.when(F.col("few"), "ROW_COUNT"))
    return r.select("tab", "row", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


@query(LINES + """, s AS (SELECT l_orderkey, place AS lo, place + CAST(l_quantity AS INTEGER) % 3 AS hi, CASE WHEN l_suppkey % 2 = 0 THEN 'HOT' ELSE 'ICE' END AS label FROM l WHERE l_returnflag = 'R')
SELECT l.l_orderkey AS tab, l.place AS row, arg_max(s.label, s.lo) AS label, count(*) AS spans, CASE WHEN count(DISTINCT s.label) > 1 THEN true ELSE false END AS clash FROM l JOIN s ON s.l_orderkey = l.l_orderkey AND l.place BETWEEN s.lo AND s.hi GROUP BY 1, 2""")
def merged_spans(t):
    """The label of the merged cell that covers a row, the last one if several do. Spans are spread over the rows that they cover, which meet the rows by an equi-join."""
    r = lines(t).select(F.col("l_orderkey").alias("tab"), F.col("place").alias("row"), "l_returnflag", "l_quantity", "l_suppkey")
    s = r.filter("l_returnflag = 'R'").select("tab", F.col("row").alias("lo"), (F.col("row") + F.col("l_quantity").cast("int") % 3).alias("hi"), F.when(F.col("l_suppkey") % 2 == 0, "HOT").otherwise("ICE").alias("label"))
    s = s.select("tab", "lo", "label", F.explode(F.sequence("lo", "hi")).alias("row"))
    g = r.select("tab", "row").join(s, ["tab", "row"]).groupBy("tab", "row")
    return g.agg(F.max_by("label", "lo").alias("label"), F.count("*").alias("spans"), (F.min("label") != F.max("label")).alias("clash"))


@query("WITH RECURSIVE " + LINES.removeprefix("WITH ") + """, b AS (SELECT l_orderkey AS tab, (place - 1) // 3 AS band, list(l_suppkey % 2 ORDER BY place) AS cells FROM l GROUP BY 1, 2),
m AS (SELECT tab, band, cells AS rows, len(cells) AS kept FROM b WHERE band = 0 UNION ALL
 SELECT tab, band, list_concat(rows, cells[k + 1:]), len(cells) - k FROM (SELECT m.tab, b.band, m.rows, b.cells, CASE WHEN least(m.kept, len(b.cells)) >= 2 AND m.rows[-2:] = b.cells[1:2] THEN 2 WHEN least(m.kept, len(b.cells)) >= 1 AND m.rows[-1] = b.cells[1] THEN 1 ELSE 0 END AS k
  FROM m JOIN b ON b.tab = m.tab AND b.band = m.band + 1))
SELECT tab, max(len(rows)) AS n_rows, arg_max(array_to_string(rows, ''), band) AS rows FROM m GROUP BY 1""")
def band_merge(t):
    """A table read in bands that overlap by up to two rows: the longest end of one band that the next begins with is dropped. A fold over a table's bands in the
    JVM, as what is kept of a band decides what the next can meet."""
    r = lines(t).select(F.col("l_orderkey").alias("tab"), F.floor((F.col("place") - 1) / 3).alias("band"), "place", (F.col("l_suppkey") % 2).alias("cell"))
    band = F.transform(F.array_sort(F.collect_list(F.struct("place", "cell"))), lambda x: x["cell"])
    bands = r.groupBy("tab", "band").agg(band.alias("cells")).groupBy("tab").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "cells"))), lambda x: x["cells"]).alias("bands"))

    def merge(state, cells):
        meets = lambda k: (F.least(state["kept"], F.size(cells)) >= k) & (F.slice(state["rows"], F.greatest(F.size(state["rows"]) - k + 1, F.lit(1)), F.lit(k)) == F.slice(cells, 1, k))
        k = F.when(meets(2), F.lit(2)).when(meets(1), F.lit(1)).otherwise(F.lit(0))
        return F.struct(F.concat(state["rows"], F.slice(cells, k + 1, F.size(cells))).alias("rows"), (F.size(cells) - k).alias("kept"))

    rows = F.aggregate("bands", F.struct(F.array().cast("array<bigint>").alias("rows"), F.lit(0).alias("kept")), merge, lambda s: s["rows"])
    return bands.select("tab", rows.alias("r")).select("tab", F.size("r").alias("n_rows"), F.array_join("r", "").alias("rows"))


@query("""SELECT p_partkey AS row, list_filter([CASE WHEN p_partkey % 3 = 1 AND p_size <> 1200 THEN 'NUM ' || p_size END, CASE WHEN p_partkey % 3 = 2 THEN 'NUM 1200' END, CASE WHEN p_partkey % 7 = 0 AND p_partkey % 2 = 0 THEN 'NEG hot water' END], lambda x: x IS NOT NULL) AS missing
FROM part""")
def missing_tokens(t):
    """What a row's cells say and none of its facts does: numbers (as whole numbers), and crossed cells without a denied fact of that column."""
    kind, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    cells = F.array(size, F.lit("1,200"))
    crossed = F.when(F.col("p_partkey") % 7 == 0, "hot water")
    facts = F.when(kind == 1, F.lit("price 1200")).when(kind == 2, F.concat(size, F.lit(" ml for 12001 or 1.1200"))).otherwise(F.concat(size, F.lit("ml, 1,200")))
    denied = F.when(F.col("p_partkey") % 2 == 1, F.lit("hotwater allowed"))
    return t("part").select(F.col("p_partkey").alias("row"), checks.missing_tokens(cells, crossed, facts, denied).alias("missing"))


#: Boxes of a page: a supplier's lines as boxes of days on the way by price.
BOX_DAYS, BOX_PRICE = 32, 2048


@query("""WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS page, datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS x0, x0 + 1 + l_quantity AS x1, l_extendedprice AS y0, l_extendedprice + 40 * l_quantity AS y1 FROM lineitem),
p AS (SELECT a.id AS l, b.id AS r, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS common, (a.x1 - a.x0) * (a.y1 - a.y0) AS s, (b.x1 - b.x0) * (b.y1 - b.y0) AS t
FROM b a JOIN b ON a.page = b.page AND a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
every AS (SELECT l AS id, common / (s + t - common) AS iou, common / least(s, t) AS inside FROM p UNION ALL SELECT r, common / (s + t - common), common / least(s, t) FROM p)
SELECT id, count(*) AS overlaps, count(*) FILTER (WHERE inside >= 0.9) AS nested, round(max(iou), 6) AS best_iou FROM every GROUP BY 1""")
def box_overlaps(t):
    """For each box that overlaps others of its page: how many, how many of them one inside the other, and the best intersection over union."""
    start = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("double")
    days, price = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    boxes = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("page"), start.alias("x0"), price.alias("y0"), (start + 1 + days).alias("x1"), (price + 40 * days).alias("y1"))
    pairs = box_pairs(boxes, boxes, BOX_DAYS, BOX_PRICE, same=True)
    each = pairs.select(F.explode(F.array("left_id", "right_id")).alias("id"), "iou", "inside")
    return each.groupBy("id").agg(F.count("*").alias("overlaps"), F.count_if(F.col("inside") >= 0.9).alias("nested"), F.round(F.max("iou"), 6).alias("best_iou"))
