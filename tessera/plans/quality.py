"""Evaluation and quality: verdicts, confusion, ranking metrics, judgments that may be missing.

A day of events is a run: event_type is what a user's case came out as on that day."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.vectors import nearest
from ..operators.quantiles import quantiles
from ..sources.shared import in_tasks
from .registry import query

PREDICTED = "CASE WHEN n_chars >= 1500 THEN 1 ELSE 0 END"


def judged(t):
    return t("documents").join(t("labels"), "doc_id").withColumn("predicted", F.when(F.col("n_chars") >= 1500, 1).otherwise(0))


@query(f"SELECT quality AS expected, count(*) FILTER (WHERE {PREDICTED} = 0) AS actual_0, count(*) FILTER (WHERE {PREDICTED} = 1) AS actual_1 FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def confusion_matrix(t):
    return judged(t).groupBy(F.col("quality").alias("expected")).pivot("predicted", [0, 1]).agg(F.count(F.lit(1))).select("expected", F.coalesce("0", F.lit(0)).alias("actual_0"), F.coalesce("1", F.lit(0)).alias("actual_1"))


@query(f"SELECT lang, quality, count(*) AS n, round(avg(CASE WHEN {PREDICTED} = quality THEN 1.0 ELSE 0.0 END), 6) AS recall FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def per_class_recall(t):
    return judged(t).groupBy("lang", "quality").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("predicted") == F.col("quality"), 1.0).otherwise(0.0)), 6).alias("recall"))


VOTES = "(SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1, 2) v"


def votes(t):
    return t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen"))


@query(f"SELECT user_id, event_type AS verdict, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_seen) AS rn FROM {VOTES}) WHERE rn = 1")
def majority_verdict(t):
    """The most frequent verdict; of equals, the one seen first."""
    best = F.max(F.struct("n", (-F.col("first_seen")).alias("early"), "event_type")).alias("x")
    return votes(t).groupBy("user_id").agg(best).select("user_id", F.col("x.event_type").alias("verdict"), F.col("x.n").alias("n"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT event_type) = 1 AS unanimous, count(*) AS n FROM events GROUP BY 1, 2")
def unanimous_verdict(t):
    return t("events").groupBy("user_id", F.to_date("ts").alias("day")).agg((F.countDistinct("event_type") == 1).alias("unanimous"), F.count("*").alias("n"))


@query("""SELECT count(*) AS pairs, round(quantile_cont(b - a, 0.5), 6) AS median_delta, round(avg(b - a), 6) AS mean_delta, count(*) FILTER (WHERE b < a) AS regressions FROM (
SELECT user_id, avg(value) FILTER (WHERE day(ts) % 2 = 0) AS a, avg(value) FILTER (WHERE day(ts) % 2 = 1) AS b FROM events GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL""")
def paired_deltas_median(t):
    odd = F.dayofmonth("ts") % 2
    p = t("events").groupBy("user_id").agg(F.avg(F.when(odd == 0, F.col("value"))).alias("a"), F.avg(F.when(odd == 1, F.col("value"))).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    d = p.select((F.col("b") - F.col("a")).alias("d"))
    one = F.lit(1).alias("k")  # one row on either side
    g = d.agg(F.count("*").alias("pairs"), F.round(F.avg("d"), 6).alias("mean_delta"), F.count_if(F.col("d") < 0).alias("regressions")).select("*", one)
    return g.join(quantiles(d, [], "d", {"q": ("between", 0.5)}).select("q", one), "k", "left").select("pairs", F.round("q", 6).alias("median_delta"), "mean_delta", "regressions")


DAILY = "(SELECT user_id, CAST(ts AS DATE) AS day, arg_max(event_type, event_id) AS state FROM events GROUP BY 1, 2)"


@query(f"SELECT coalesce(a.state, 'none') AS before, b.state AS after, count(*) AS n FROM {DAILY} b LEFT JOIN {DAILY} a ON a.user_id = b.user_id AND a.day = b.day - 1 GROUP BY 1, 2")
def stability_transitions(t):
    d = t("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max_by("event_type", "event_id").alias("after"))
    before = d.select("user_id", F.date_add("day", 1).alias("day"), F.col("after").alias("before"))
    return d.join(before, ["user_id", "day"], "left").groupBy(F.coalesce("before", F.lit("none")).alias("before"), "after").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT l_partkey, l_suppkey, count(DISTINCT l_orderkey) AS votes, min(l_orderkey) AS representative FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, l_suppkey, votes, representative, count(*) OVER (PARTITION BY l_partkey) > 1 AS contested FROM k WHERE votes >= 3""")
def consensus_vote(t):
    """Values of a part that a quorum of three runs agrees on; contested if more than one does."""
    k = in_tasks(t("lineitem"), ["l_partkey", "l_suppkey"]).groupBy("l_partkey", "l_suppkey").agg(F.countDistinct("l_orderkey").alias("votes"), F.min("l_orderkey").alias("representative")).filter("votes >= 3")
    return k.withColumn("contested", F.count("*").over(Window.partitionBy("l_partkey")) > 1)


@query("""SELECT lang, count(*) AS n_docs, count(quality) AS judged, CASE WHEN count(quality) = count(*) THEN round(avg(quality), 6) END AS quality_share, count(*) = count(quality) AS complete FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def metrics_unjudged_null(t):
    """A metric is null while any document of the group is unjudged."""
    j = t("documents").join(t("labels"), "doc_id", "left").groupBy("lang")
    full = F.count("quality") == F.count("*")
    return j.agg(F.count("*").alias("n_docs"), F.count("quality").alias("judged"), F.when(full, F.round(F.avg("quality"), 6)).alias("quality_share"), full.alias("complete"))


@query("SELECT source, lang, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS recall, grouping_id(source, lang) AS level FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (source), (lang), (source, lang))")
def source_type_recall_grouping_sets(t):
    return judged(t).groupingSets([[], ["source"], ["lang"], ["source", "lang"]], "source", "lang").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)), 6).alias("recall"), F.grouping_id("source", "lang").alias("level"))


@query("SELECT doc_id, quality, toxic FROM labels ORDER BY quality, toxic DESC, doc_id LIMIT 50")
def review_queue_low_conf_first(t):
    return t("labels").orderBy("quality", F.desc("toxic"), "doc_id").limit(50).select("doc_id", "quality", "toxic")


COSINE = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))"
RANKED = f"""ranked AS (SELECT q.vec_id AS query_id, v.vec_id, q.label = v.label AS relevant, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COSINE}, 9) DESC, v.vec_id) AS rank
FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)"""


def ranked(t, k=fixed.NDCG_K):
    """The k nearest of every hundredth vector, and whether they have its label."""
    e = t("embeddings")
    labels = e.select("vec_id", "label")
    near = nearest(e.filter("vec_id % 100 = 0"), e, k)
    return near.join(labels.withColumnRenamed("label", "found"), "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), "label"), "query_id").select("query_id", "vec_id", "rank", (F.col("found") == F.col("label")).alias("relevant"))


@query(f"""WITH {RANKED}, top AS (SELECT * FROM ranked WHERE rank <= 10), ideal AS (SELECT vec_id AS query_id, least(10, (SELECT count(*) - 1 FROM embeddings v WHERE v.label = q.label)) AS n FROM embeddings q WHERE vec_id % 100 = 0)
SELECT t.query_id, round(coalesce(max(1.0 / rank) FILTER (WHERE relevant), 0), 4) AS mrr, round(sum(CASE WHEN relevant THEN 1 / log2(rank + 1) ELSE 0 END) / max((SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= ideal.n)), 4) AS ndcg
FROM top t JOIN ideal USING (query_id) WHERE ideal.n > 0 GROUP BY 1""")
def mrr_ndcg_at_10(t):
    e = t("embeddings")
    size = e.groupBy("label").agg(F.least(F.lit(10), F.count("*") - 1).cast("int").alias("n"))
    ideal = e.filter("vec_id % 100 = 0").join(size, "label").filter("n > 0").select(F.col("vec_id").alias("query_id"), F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1)).alias("ideal"))
    gain = F.sum(F.when(F.col("relevant"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    m = ranked(t).groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("relevant"), 1 / F.col("rank"))), F.lit(0.0)).alias("mrr"), gain.alias("gain"))
    return m.join(ideal, "query_id").select("query_id", F.round("mrr", 4).alias("mrr"), F.round(F.col("gain") / F.col("ideal"), 4).alias("ndcg"))


@query(f"WITH {RANKED} SELECT query_id, count(*) FILTER (WHERE relevant) AS hits, round(avg(CASE WHEN relevant THEN 1.0 ELSE 0.0 END), 6) AS recall FROM ranked WHERE rank <= 10 GROUP BY 1")
def knn_label_recall(t):
    return ranked(t).groupBy("query_id").agg(F.count_if("relevant").alias("hits"), F.round(F.avg(F.when(F.col("relevant"), 1.0).otherwise(0.0)), 6).alias("recall"))


@query(f"""WITH {RANKED}, j AS (SELECT query_id, min(rank) FILTER (WHERE relevant) AS at, count(*) AS cited FROM ranked WHERE rank <= 10 GROUP BY 1)
SELECT query_id, CASE WHEN cited = 0 THEN 'NO_CITATION' WHEN at IS NULL THEN 'EXPECTED_CARD_ABSENT' WHEN at > 3 THEN 'WRONG_CITATION' ELSE 'PASS' END AS failure FROM j""".replace(" AS at,", " AS first_hit,").replace("WHEN at ", "WHEN first_hit "))
def failure_kind(t):
    j = ranked(t).groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_hit"), F.count("*").alias("cited"))
    return j.select("query_id", F.when(F.col("cited") == 0, "NO_CITATION").when(F.col("first_hit").isNull(), "EXPECTED_CARD_ABSENT").when(F.col("first_hit") > 3, "WRONG_CITATION").otherwise("PASS").alias("failure"))
