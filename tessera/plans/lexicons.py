"""Lexicons of many aliases, and names replaced by tokens and put back; both lists come from `benchmark`."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.patterns import lexicon_terms, replace_all
from .registry import query

#: The first two words of each item are an alias of its first one, and each longer word one of its first letters.
ALIASES = r"""words AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
named AS (SELECT w[1] || ' ' || w[2] AS alias, w[1] AS term FROM words WHERE len(w) >= 2 UNION SELECT x, left(x, 4) FROM (SELECT unnest(w) AS x FROM words) WHERE length(x) >= 5),
lexicon AS (SELECT alias, min(term) AS term FROM named GROUP BY 1 HAVING count(DISTINCT term) = 1)"""
#: The first three words of an item are a name; a name's token has the number of its first item.
NAMES = r"""names AS (SELECT original, '[[R_' || lpad((min(item_id) + 1)::VARCHAR, 6, '0') || ']]' AS token FROM (SELECT item_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS original FROM benchmark WHERE len(string_split(text, ' ')) > 3) GROUP BY 1)"""


def aliases(t):
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    b = t("benchmark").select(w.alias("w"))
    two = b.filter(F.size("w") >= 2).select(F.concat_ws(" ", F.get("w", 0), F.get("w", 1)).alias("alias"), F.get("w", 0).alias("term"))
    return two.unionByName(b.select(F.explode("w").alias("alias")).filter(F.length("alias") >= 5).select("alias", F.left("alias", F.lit(4)).alias("term")))


def names(t):
    w = F.split("text", " ", -1)
    b = t("benchmark").filter(F.size(w) > 3).select("item_id", F.array_join(F.slice(w, 1, 3), " ").alias("original"))
    return b.groupBy("original").agg(F.concat(F.lit("[[R_"), F.lpad((F.min("item_id") + 1).cast("string"), 6, "0"), F.lit("]]")).alias("token"))


@query(f"""WITH {ALIASES}, q AS (SELECT doc_id, replace(lower(regexp_replace(trim(text), '[ \n\t\r]+', ' ', 'g')), 'ß', 'ss') AS line FROM documents)
SELECT DISTINCT doc_id, term FROM q JOIN lexicon ON contains(line, alias) AND regexp_matches(line, '(^|[^가-힣a-z])' || alias || '[{fixed.ALIAS_PARTICLES}]?($|[^가-힣a-z])')""")
def lexicon_terms_found(t):
    """The terms that each document names, by any of its aliases between boundaries."""
    return lexicon_terms(t("documents"), "doc_id", "text", aliases(t))


@query(rf"""WITH {NAMES}, p AS (SELECT string_agg(regexp_escape(original), '|' ORDER BY length(original) DESC) AS p FROM names), m AS (SELECT map_from_entries(list((original, token))) AS m FROM names),
d AS (SELECT doc_id, text, regexp_extract_all(text, p) AS hits, string_split_regex(text, p) AS rest, m FROM documents, p, m)
SELECT doc_id, array_to_string(list_transform(generate_series(1, len(rest)), lambda i: rest[i] || CASE WHEN i <= len(hits) THEN m[hits[i]] ELSE '' END), '') AS text, len(hits) AS n, true AS restored FROM d""")
def reversible_redaction(t):
    """Names in documents replaced by tokens in one pass, the longest first; putting the originals back gives each text again."""
    d, mapping = t("documents").select("doc_id", "text"), names(t)
    hidden = replace_all(d, "doc_id", "text", mapping)
    back = replace_all(hidden.select("doc_id", "text"), "doc_id", "text", mapping, restore=True).select("doc_id", F.col("text").alias("again"))
    both = hidden.join(back, "doc_id").join(d.select("doc_id", F.col("text").alias("given")), "doc_id")
    return both.select("doc_id", "text", "n", F.col("again").eqNullSafe(F.col("given")).alias("restored"))
