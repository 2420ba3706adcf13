"""Facts, duplicates, entities and conflicts. Suppliers' parts are facts: the part is the slot, supplier and rounded price the identity."""

from pyspark.sql import functions as F

from ..functions.text import squash
from ..operators.ledger import digest, edit_one_pairs, first_of, open_conflicts
from .registry import query


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1")
def content_hash_dedup(t):
    return first_of(t("documents").withColumn("content_hash", F.sha2("text", 256)), ["content_hash"], "doc_id")


@query(r"SELECT source, sha256(regexp_replace(lower(text), '[\s\x{00A0}\x{200B}-\x{200D}\x{2060}\x{FEFF}]', '', 'g')) AS k, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1, 2")
def normalised_dedup(t):
    """Texts of a source that are the same but for case, white space and invisible characters."""
    return first_of(t("documents").withColumn("k", F.sha2(squash(F.lower("text")), 256)), ["source", "k"], "doc_id")


@query("""WITH n AS (SELECT split_part(p_name, ' ', 1) || (p_partkey % 97) AS name, min(p_partkey) AS id, count(*) AS n FROM part GROUP BY 1)
SELECT a.id AS left_id, b.id AS right_id, a.name AS left_name, b.name AS right_name, a.n AS left_n, b.n AS right_n FROM n a JOIN n b ON a.id < b.id AND levenshtein(a.name, b.name) = 1 WHERE length(a.name) >= 3 AND length(b.name) >= 3""")
def edit1_pairs(t):
    """Names one edit apart, each by its first part, with the number of parts of the name: equal names are one class before names are linked."""
    name = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), (F.col("p_partkey") % 97).cast("string"))
    names = t("part").groupBy(name.alias("name")).agg(F.min("p_partkey").alias("id"), F.count("*").alias("n"))
    pairs = edit_one_pairs(names)
    for side in ("left", "right"):
        pairs = pairs.join(names.select(F.col("id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n")), f"{side}_id")
    return pairs


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) AS w FROM part UNION SELECT DISTINCT lower(n_name) FROM nation UNION SELECT DISTINCT lower(r_name) FROM region)
SELECT a.w AS short, b.w AS long FROM w a JOIN w b ON a.w <> b.w AND length(a.w) >= 2 AND contains(b.w, a.w)""")
def contains_pairs(t):
    """Names that are part of another name, through the longer one's substrings: an equi-join, not a nested loop."""
    words = t("part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("w")).union(t("nation").select(F.lower("n_name"))).union(t("region").select(F.lower("r_name"))).distinct()
    n = F.length("w")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(F.col("w"), i, k))))
    inner = words.select(F.col("w").alias("long"), F.explode(F.array_distinct(parts)).alias("short")).filter("short <> long AND length(short) >= 2")
    return inner.join(words.select(F.col("w").alias("short")), "short", "left_semi").select("short", "long")


FACTS = "(SELECT l_partkey AS slot, l_suppkey || ':' || CAST(round(l_extendedprice / l_quantity) AS BIGINT) AS identity, l_orderkey * 10 + l_linenumber AS fact_id FROM lineitem) f"


def facts(t):
    price = F.round(F.col("l_extendedprice") / F.col("l_quantity")).cast("long").cast("string")
    return t("lineitem").select(F.col("l_partkey").alias("slot"), F.concat_ws(":", F.col("l_suppkey").cast("string"), price).alias("identity"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"))


@query(f"SELECT slot, low_id, high_id FROM (SELECT slot, lag(first) OVER (PARTITION BY slot ORDER BY first) AS low_id, first AS high_id FROM (SELECT slot, identity, min(fact_id) AS first FROM {FACTS} GROUP BY 1, 2)) WHERE low_id IS NOT NULL")
def slot_conflicts(t):
    return open_conflicts(facts(t))


@query(f"SELECT slot, count(DISTINCT identity) AS identities, count(*) AS evidence, max(fact_id) AS latest FROM {FACTS} GROUP BY 1 HAVING count(DISTINCT identity) > 1 ORDER BY evidence DESC, slot LIMIT 100")
def conflict_review(t):
    g = facts(t).groupBy("slot").agg(F.countDistinct("identity").alias("identities"), F.count("*").alias("evidence"), F.max("fact_id").alias("latest"))
    return g.filter("identities > 1").orderBy(F.desc("evidence"), "slot").limit(100)


@query(f"""WITH f AS (SELECT identity, slot, min(fact_id) AS first, count(*) AS n FROM {FACTS} GROUP BY 1, 2)
SELECT f.fact_id, CASE WHEN f.fact_id = x.first THEN 'CREATED' ELSE 'MATCHED' END AS outcome, x.first AS head FROM {FACTS} JOIN f x USING (slot, identity) WHERE f.fact_id % 7 = 0""".replace(" WHERE f.fact_id % 7 = 0", "").replace(f"FROM {FACTS} JOIN f x", f"FROM {FACTS} JOIN f x".replace(") f JOIN", ") g JOIN")).replace("SELECT f.fact_id, CASE WHEN f.fact_id", "SELECT g.fact_id, CASE WHEN g.fact_id"))
def fact_link(t):
    """A fact whose identity is known is matched to its first fact, others are created."""
    f = facts(t)
    first = f.groupBy("slot", "identity").agg(F.min("fact_id").alias("head"))
    return f.join(first, ["slot", "identity"]).select("fact_id", F.when(F.col("fact_id") == F.col("head"), "CREATED").otherwise("MATCHED").alias("outcome"), "head")


@query("""SELECT o_orderkey, CASE WHEN n IS NULL THEN 'NEW' WHEN r = n THEN 'CONFLICT' WHEN a = n THEN 'IDENTICAL' ELSE 'SUPPLEMENT' END AS relation FROM orders LEFT JOIN
(SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_returnflag = 'A') AS a FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def change_relation(t):
    flag = F.col("l_returnflag")
    g = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(flag == "R").alias("r"), F.count_if(flag == "A").alias("a"))
    relation = F.when(F.col("n").isNull(), "NEW").when(F.col("r") == F.col("n"), "CONFLICT").when(F.col("a") == F.col("n"), "IDENTICAL").otherwise("SUPPLEMENT")
    return t("orders").select("o_orderkey").join(g, "o_orderkey", "left").select("o_orderkey", relation.alias("relation"))


@query("SELECT p_brand, p_type, count(DISTINCT p_size) AS sizes, list_sort(list(DISTINCT p_size)) AS axis FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_size) > 1")
def variant_axis(t):
    return t("part").groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_set("p_size")).alias("axis")).filter(F.size("axis") > 1).select("p_brand", "p_type", F.size("axis").cast("long").alias("sizes"), "axis")


@query("""SELECT source, lang, sha256(source || chr(31) || lang || chr(31) || CAST(n_chars // 500 AS VARCHAR)) AS slot_key, count(*) AS n FROM documents GROUP BY source, lang, n_chars // 500""")
def slot_keys(t):
    size = F.floor(F.col("n_chars") / 500)
    return t("documents").groupBy("source", "lang", size.alias("b")).agg(F.count("*").alias("n")).select("source", "lang", digest(F.col("source"), F.col("lang"), F.col("b")).alias("slot_key"), "n")


@query("SELECT p_partkey, min(s_suppkey) AS owner, count(*) AS suppliers, max(l_shipdate) AS last_ship FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY 1")
def multiway_join(t):
    """Five relations; Spark broadcasts those that it measures as small."""
    j = t("lineitem").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(t("region").filter("r_name = 'ASIA'"), F.col("r_regionkey") == F.col("n_regionkey"))
    j = j.join(t("part").select("p_partkey"), F.col("p_partkey") == F.col("l_partkey"))
    return j.groupBy("p_partkey").agg(F.min("s_suppkey").alias("owner"), F.count("*").alias("suppliers"), F.max("l_shipdate").alias("last_ship"))


@query("""SELECT a.id AS id, a.name, coalesce(b.id, a.id) AS entity_id, b.id IS NULL AS created FROM (SELECT c_custkey AS id, 'n' || c_nationkey AS name FROM customer) a LEFT JOIN (SELECT min(s_suppkey) AS id, 'n' || s_nationkey AS name FROM supplier GROUP BY s_nationkey) b USING (name)""")
def entity_resolve_or_create(t):
    names = t("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("name"))
    known = t("supplier").groupBy(F.concat(F.lit("n"), "s_nationkey").alias("name")).agg(F.min("s_suppkey").alias("known"))
    return names.join(known, "name", "left").select("id", "name", F.coalesce("known", "id").alias("entity_id"), F.col("known").isNull().alias("created"))


@query("SELECT l_partkey, bool_and(l_returnflag = 'N') AS held, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY 1")
def notice_hold(t):
    """Held if every occurrence is in a notice."""
    return t("lineitem").groupBy("l_partkey").agg(F.bool_and(F.col("l_returnflag") == "N").alias("held"), F.countDistinct("l_suppkey").alias("sources"))


@query("SELECT l_suppkey, list_sort(list(DISTINCT CAST(CAST(l_shipdate AS DATE) AS VARCHAR)))[1:3] AS first_three, count(DISTINCT CAST(l_shipdate AS DATE)) AS n FROM lineitem GROUP BY 1")
def ordered_array_agg(t):
    """Values in order, capped in length; Spark's array_agg has no order, so the set is sorted."""
    g = t("lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set(F.to_date("l_shipdate").cast("string"))).alias("d"))
    return g.select("l_suppkey", F.slice("d", 1, 3).alias("first_three"), F.size("d").cast("long").alias("n"))


@query("SELECT o_orderkey, new.price AS price, o_totalprice IS DISTINCT FROM new.price AS changed FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1) new ON l_orderkey = o_orderkey")
def guarded_update(t):
    """Update from a join, with the rows that really change marked."""
    new = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("price"))
    return t("orders").join(new, "o_orderkey", "left").select("o_orderkey", "price", (~F.col("o_totalprice").eqNullSafe(F.col("price"))).alias("changed"))
