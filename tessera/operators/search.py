"""Lexical search, rank fusion and the retrieval gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import anchors
from ..sources.shared import shared_path


#: A question's threshold is set by about so many documents, times k, that hold its rarest terms.
LEADS = 10
#: Of the terms that may go unmet, this share goes: the rest of the terms then decides better which documents can still reach the threshold.
UNMET = 0.8
#: So few documents may lie in one row group, which is one task: they are dealt out before their terms are made. Larger tables are read as they lie.
FEW = 50_000
#: Terms of questions, counted, that are broadcast to the postings; more are met in a shuffle.
MET_AT_ONCE = 500_000


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def lexical(queries: DataFrame, docs: DataFrame, terms: Column, k: int) -> DataFrame:
    """query_id, doc_id, score (distinct terms matched), rank; ties by doc_id. queries: query_id, terms (an array). docs: doc_id (a key) and what the terms are made of.

    Exact, without a row for each question and document that share a word. Terms are taken from rare to frequent. Documents of the rarest terms are
    scored whole; the k-th best of them, t, is a score that any result reaches. A document that holds none but the t - 1 most frequent terms of a
    question stays below t. So postings of d < t most frequent terms are never met; a document that holds fewer than t - d of the others is dropped, and
    what is left is scored whole. Which documents set t, and d, change what work is saved, never the result: of a rarest term that more documents hold, a
    share by hash sets t."""
    asked = queries.select("query_id", F.array_distinct("terms").alias("terms"))
    each = asked.select("query_id", F.explode("terms").alias("term"))
    if docs.count() <= FEW:
        docs = docs.repartition(docs.sparkSession.sparkContext.defaultParallelism)
    index = _written(docs.select("doc_id", F.array_distinct(terms).alias("held")), "index")
    post = index.select("doc_id", F.explode("held").alias("term"))
    held = post.groupBy("term").agg(F.count("*").alias("n")).join(each.select("term").distinct(), "term", "left_semi")
    order = Window.partitionBy("query_id").orderBy("n", "term")
    ranked = each.join(held, "term").select("*", F.row_number().over(order).alias("place"), F.sum("n").over(order).alias("upto"), F.count("*").over(Window.partitionBy("query_id")).alias("m"))
    ranked = _written(ranked, "terms")
    few = ranked.count() <= MET_AT_ONCE

    def meet(terms: DataFrame) -> DataFrame:
        """Postings of some of the ranked terms. Spark takes an explode to be as small as its input, so it isn't left to choose the side."""
        return post.join(F.broadcast(terms), "term") if few else post.hint("merge").join(terms, "term")

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(asked, "query_id").join(index.hint("merge"), "doc_id")
        return both.select("query_id", "doc_id", F.size(F.array_intersect("terms", "held")).cast("long").alias("score"))

    enough = LEADS * k
    leads = meet(ranked.filter((F.col("place") == 1) | (F.col("upto") <= enough))).filter(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / enough)) == 0)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    least = scored(leads.select("query_id", "doc_id").distinct()).withColumn("at", best).filter(F.col("at") == k).select("query_id", F.col("score").alias("least"))
    unmet = F.floor((F.coalesce("least", F.lit(1)) - 1) * UNMET)
    needed = ranked.join(least, "query_id", "left").filter(F.col("place") <= F.col("m") - unmet).select("query_id", "term", (F.coalesce("least", F.lit(1)) - unmet).alias("reach"))
    met = meet(needed).groupBy("query_id", "doc_id").agg(F.count("*").alias("met"), F.first("reach").alias("reach"))
    found = scored(met.filter(F.col("met") >= F.col("reach")).select("query_id", "doc_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fuse(channels: list[DataFrame], k: int, constant: int = fixed.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of channels (query_id, id, rank): query_id, id, score, rank."""
    every = channels[0].select("query_id", "id", "rank")
    for c in channels[1:]:
        every = every.unionByName(c.select("query_id", "id", "rank"))
    scores = every.groupBy("query_id", "id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def gate(questions: DataFrame, candidates: DataFrame, threshold: float = fixed.RETRIEVAL_THRESHOLD) -> DataFrame:
    """questions: query_id, question. candidates: query_id, id, score, text. Returns query_id, outcome, reason, n_kept.

    No anchors: miss. A candidate must reach the threshold and hold an anchor; if one failed only for its anchors the reason is intent_mismatch."""
    q = questions.select("query_id", "question", anchors(F.col("question")).alias("anchors"))
    c = q.select("query_id", "anchors").join(candidates.filter(F.col("score") >= threshold), "query_id").withColumn("held", F.exists("anchors", lambda a: F.contains(F.col("text"), a)))
    counts = c.groupBy("query_id").agg(F.count_if("held").alias("n_kept"), F.count_if(~F.col("held")).alias("n_dropped"))
    j = q.join(counts, "query_id", "left").fillna(0, ["n_kept", "n_dropped"])
    empty = (F.length(F.trim(F.coalesce("question", F.lit("")))) < 2) | (F.size("anchors") == 0)
    kept = F.when(empty, 0).otherwise(F.col("n_kept"))
    reason = F.when(empty, "no_anchor").when(F.col("n_kept") > 0, F.lit(None)).when(F.col("n_dropped") > 0, "intent_mismatch").otherwise("no_match")
    return j.select("query_id", F.when(kept > 0, "hit").otherwise("miss").alias("outcome"), reason.alias("reason"), kept.cast("long").alias("n_kept"))
