"""Retrieval: vector and lexical channels, fusion, the gate, index upkeep. Benchmark items are questions, documents are cards."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import anchors, tokens
from ..operators.search import fuse, gate, lexical
from ..operators.vectors import nearest
from .quality import COSINE
from .registry import query

#: Parts of a card's blocks.
SALTS = 16


def near(t, k=20):
    e = t("embeddings")
    return nearest(e.filter("vec_id % 100 = 0"), e, k)


NEAR = f"""near AS (SELECT query_id, vec_id, score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round({COSINE}, 9) AS score, v.label,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COSINE}, 9) DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 20)"""


@query(f"WITH {NEAR} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM near WHERE rank <= 10")
def cosine_topk(t):
    return near(t, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {NEAR} SELECT query_id, label, round(max(score), 6) AS best, count(*) AS blocks FROM near JOIN embeddings USING (vec_id) GROUP BY 1, 2")
def max_block_per_card(t):
    """The best block of each card (label) among a query's neighbours."""
    return near(t).join(t("embeddings").select("vec_id", "label"), "vec_id").groupBy("query_id", "label").agg(F.round(F.max("score"), 6).alias("best"), F.count("*").alias("blocks"))


TOKENS = r"list_filter(regexp_split_to_array(coalesce(lower({}), ''), '[^0-9A-Za-z가-힣]+'), lambda w: w <> '')"
LEX = f"""asked AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark),
post AS (SELECT DISTINCT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents),
lex AS (SELECT * FROM (SELECT query_id, doc_id, count(*) AS score, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id) AS rank FROM asked JOIN post USING (term) GROUP BY 1, 2) WHERE rank <= 20)"""


def lex(t, k=20):
    terms = tokens(F.lower("text"))
    asked = t("benchmark").select(F.col("item_id").alias("query_id"), terms.alias("terms"))
    return lexical(asked, t("documents").select("doc_id", "text"), terms, k)


@query(f"WITH {LEX} SELECT query_id, doc_id, score, rank FROM lex")
def lexical_topk(t):
    return lex(t)


@query(f"""WITH {LEX}, short AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars, doc_id) AS rank FROM lex JOIN documents USING (doc_id)) WHERE rank <= 20),
every AS (SELECT query_id, doc_id, rank FROM lex UNION ALL SELECT query_id, doc_id, rank FROM short)
SELECT query_id, doc_id AS id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM every GROUP BY 1, 2)) WHERE rank <= 10""")
def rrf_fusion(t):
    """The lexical channel fused with the same candidates from short to long."""
    a = lex(t)
    order = Window.partitionBy("query_id").orderBy("n_chars", "doc_id")
    b = a.drop("rank").join(t("documents").select("doc_id", "n_chars"), "doc_id").withColumn("rank", F.row_number().over(order))
    return fuse([x.withColumnRenamed("doc_id", "id") for x in (a, b)], 10)


@query(f"""WITH {LEX}, q AS (SELECT item_id AS query_id, text, {TOKENS.format('text').replace('lower(text)', 'text')} AS anchors FROM benchmark),
c AS (SELECT q.query_id, len(list_filter(anchors, lambda a: contains(d.text, a))) > 0 AS held FROM q JOIN lex USING (query_id) JOIN documents d USING (doc_id) WHERE lex.score / len(list_distinct({TOKENS.format('q.text')})) >= 0.35),
n AS (SELECT query_id, count(*) FILTER (WHERE held) AS k, count(*) FILTER (WHERE NOT held) AS d FROM c GROUP BY 1)
SELECT q.query_id, CASE WHEN k > 0 THEN 'hit' ELSE 'miss' END AS outcome, CASE WHEN len(anchors) = 0 THEN 'no_anchor' WHEN k > 0 THEN NULL WHEN d > 0 THEN 'intent_mismatch' ELSE 'no_match' END AS reason, coalesce(k, 0) AS n_kept FROM q LEFT JOIN n USING (query_id)""")
def retrieval_gate(t):
    """The score is the share of the question's terms that a candidate holds."""
    b = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.size(F.array_distinct(tokens(F.lower("text")))).alias("n"))
    c = lex(t).join(b.select("query_id", "n"), "query_id").join(t("documents").select("doc_id", "text"), "doc_id").select("query_id", F.col("doc_id").alias("id"), (F.col("score") / F.col("n")).alias("score"), "text")
    return gate(b, c)


@query(f"""WITH {NEAR}, top AS (SELECT query_id, vec_id, label, round(score, 6) AS score FROM near JOIN embeddings USING (vec_id) WHERE rank <= 3)
SELECT query_id, vec_id, score, false AS sibling FROM top UNION ALL SELECT DISTINCT t.query_id, e.vec_id, 0.0, true FROM top t JOIN embeddings e USING (label) WHERE NOT EXISTS (SELECT 1 FROM top x WHERE x.query_id = t.query_id AND x.vec_id = e.vec_id)""")
def sibling_completion(t):
    """The top three, and their cards' other key blocks with score zero."""
    e = t("embeddings").select("vec_id", "label")
    top = near(t, 3).join(e, "vec_id").select("query_id", "vec_id", "label", F.round("score", 6).alias("score"))
    # a card may have a third of all blocks: its rows are dealt over salts, and each card asked for meets every salt
    blocks = e.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    asked = top.select("query_id", "label").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    more = asked.join(blocks, ["label", "salt"]).join(top.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti")
    return top.select("query_id", "vec_id", "score", F.lit(False).alias("sibling")).unionByName(more.select("query_id", "vec_id", F.lit(0.0).alias("score"), F.lit(True).alias("sibling")))


@query("""SELECT 'missing' AS problem, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'unexpected', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)
UNION ALL SELECT 'duplicate', doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1""")
def index_audit(t):
    """Set difference both ways, and duplicates."""
    want, have = t("documents").select("doc_id"), t("labels").select("doc_id")
    parts = [("missing", want.join(have, "doc_id", "left_anti")), ("unexpected", have.join(want, "doc_id", "left_anti")), ("duplicate", have.groupBy("doc_id").count().filter("count > 1").select("doc_id"))]
    found = [d.distinct().select(F.lit(n).alias("problem"), "doc_id") for n, d in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS age FROM orders) WHERE age > 4 AND o_orderdate < TIMESTAMP '1998-06-01' AND o_orderstatus <> 'P'""")
def retention_prune_list(t):
    """Versions that go: not current, not among the three before, old enough, not in use."""
    age = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return t("orders").withColumn("age", age).filter((F.col("age") > 4) & (F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") != "P")).select("o_custkey", "o_orderkey")


@query("""SELECT source, CASE WHEN count(l.doc_id) = 0 THEN 'MISSING' WHEN count(l.doc_id) < count(*) THEN 'OUTDATED' ELSE 'READY' END AS status, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def index_status(t):
    j = t("documents").join(t("labels").select("doc_id", F.lit(1).alias("held")), "doc_id", "left").groupBy("source")
    n = F.count("held")
    return j.agg(F.when(n == 0, "MISSING").when(n < F.count("*"), "OUTDATED").otherwise("READY").alias("status"), F.count("*").alias("n"))


@query("SELECT doc_id, sha256(lower(text)) AS vector_key, CAST(d.doc_id - first_id AS BIGINT) > 0 AS reused FROM (SELECT *, min(doc_id) OVER (PARTITION BY sha256(lower(text))) AS first_id FROM documents) d")
def vector_reuse(t):
    """A text whose key has been embedded before reuses the vector: only first rows go to the embedder."""
    d = t("documents").select("doc_id", F.sha2(F.lower("text"), 256).alias("vector_key"))
    first = d.groupBy("vector_key").agg(F.min("doc_id").alias("first_id"))
    return d.join(first, "vector_key").select("doc_id", "vector_key", (F.col("doc_id") > F.col("first_id")).alias("reused"))


@query("SELECT doc_id, source FROM documents ORDER BY sha256('seed-1:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 25")
def hash_sample(t):
    """A sample by hash order: the same rows whatever the partitioning."""
    return t("documents").orderBy(F.sha2(F.concat(F.lit("seed-1:"), F.col("doc_id").cast("string")), 256), "doc_id").limit(25).select("doc_id", "source")


@query("SELECT doc_id, source, rn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) ORDER BY rn, source LIMIT 40")
def stratified_round_robin(t):
    """The first two of each source, one of each in turn."""
    rn = F.row_number().over(Window.partitionBy("source").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id"))
    # no source can give more than all 40, and this limit cuts each group before the shuffle
    return t("documents").withColumn("rn", rn).filter("rn <= 40").orderBy("rn", "source").limit(40).select("doc_id", "source", "rn")


@query(f"""WITH {LEX}, pool AS (SELECT query_id, doc_id, 'channel' AS origin FROM lex WHERE rank <= 3), placed AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos FROM documents),
seeds AS (SELECT item_id AS query_id, (SELECT count(*) FROM documents WHERE sha256(CAST(doc_id AS VARCHAR)) < sha256('q:' || CAST(item_id AS VARCHAR))) AS seed FROM benchmark),
tried AS (SELECT query_id, i, (seed + i) % (SELECT count(*) FROM documents) AS pos FROM seeds, range(5) r(i)),
rest AS (SELECT a.query_id, p.doc_id, row_number() OVER (PARTITION BY a.query_id ORDER BY i) AS rn FROM tried a JOIN placed p USING (pos) WHERE NOT EXISTS (SELECT 1 FROM pool x WHERE x.query_id = a.query_id AND x.doc_id = p.doc_id))
SELECT * FROM pool UNION ALL SELECT query_id, doc_id, 'unpooled' FROM rest WHERE rn <= 2""")
def judgment_pool(t):
    """What the channel found, and two documents that it didn't: the next ones after the question's seed in the order of hashes of all documents.

    Places in that order come from counts per bucket of hashes and from a running count within a bucket, so no task orders all documents. Of five
    documents in a row three at most are in the pool."""
    pool = lex(t, 3).select("query_id", "doc_id", F.lit("channel").alias("origin"))
    docs = t("documents").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("h"), F.lit(None).cast("long").alias("query_id"), "doc_id", F.lit(1).alias("n"))
    seeds = t("benchmark").select(F.sha2(F.concat(F.lit("q:"), F.col("item_id").cast("string")), 256).alias("h"), F.col("item_id").alias("query_id"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("n"))
    both = docs.unionByName(seeds).withColumn("bucket", F.substring("h", 1, 3))
    sums = both.groupBy("bucket").agg(F.sum("n").alias("held"))
    before = F.sum("held").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")
    sums = sums.select("bucket", before.alias("before"), F.sum("held").over(Window.partitionBy()).alias("total"))
    inside = F.sum("n").over(Window.partitionBy("bucket").orderBy("h", "n", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("inside", inside).join(sums, "bucket").withColumn("at", F.col("before") + F.col("inside"))
    asked = placed.filter("n = 0").select("query_id", "at", "total", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("query_id", "i", ((F.col("at") + F.col("i")) % F.col("total")).alias("pos"))
    rest = asked.join(placed.filter("n = 1").select((F.col("at") - 1).alias("pos"), "doc_id"), "pos").join(pool, ["query_id", "doc_id"], "left_anti")
    picked = rest.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("i"))).filter("rn <= 2")
    return pool.unionByName(picked.select("query_id", "doc_id", F.lit("unpooled").alias("origin")))


@query(f"""WITH {LEX}, q AS (SELECT item_id AS query_id, {TOKENS.format('text').replace('lower(text)', 'text')} AS anchors FROM benchmark)
SELECT query_id, doc_id, len(list_filter(anchors, lambda a: contains(d.text, a))) > 0 AS grounded FROM lex JOIN q USING (query_id) JOIN documents d USING (doc_id)""")
def grounding_check(t):
    """Which of a question's candidates hold one of its anchors, anywhere in the whole text."""
    asked = t("benchmark").select(F.col("item_id").alias("query_id"), anchors(F.col("text")).alias("anchors"))
    found = lex(t).select("query_id", "doc_id").join(asked, "query_id").join(t("documents").select("doc_id", "text"), "doc_id")
    return found.select("query_id", "doc_id", F.exists("anchors", lambda a: F.contains(F.col("text"), a)).alias("grounded"))
