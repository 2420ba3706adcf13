"""Facts judged against whole texts: facts come from `benchmark`, cards are `documents`."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.scoring import score_facts
from .registry import query

DENIED = f"(?i)({'|'.join(fixed.DENIALS)}|({'|'.join(fixed.DENIALS_ENGLISH)})($|[^\\p{{L}}\\p{{N}}_]))"
WORDS = "regexp_extract_all(lower({}), '[0-9a-z가-힣]+')"
NAMED = "(contains(array_to_string({0}, ' '), subject) OR len(list_filter({0}, lambda x: CASE WHEN length(x) = length(subject) AND length(x) >= 4 THEN levenshtein(x, subject) = 1 ELSE false END)) > 0)"


def stated(t):
    """Two facts an item: a word is the subject, the next four are its value."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    b = t("benchmark").select("item_id", w.alias("w")).filter(F.size("w") >= 16)
    at = b.select("item_id", "w", F.explode(F.array(F.lit(3), F.lit(10))).alias("at"))
    return at.select((F.col("item_id") * 100 + F.col("at")).alias("fact_id"), F.get("w", F.col("at") - 1).alias("subject"), F.concat_ws(" ", F.slice("w", F.col("at") + 1, 4)).alias("value"), F.lit(None).cast("string").alias("variant"))


@query(rf"""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
f AS (SELECT item_id * 100 + spot AS fact_id, w[spot] AS subject, list_distinct(w[spot + 1:spot + 4]) AS value FROM b, (SELECT unnest([3, 10]) AS spot) WHERE len(w) >= 16),
c AS (SELECT doc_id, text, string_split_regex(regexp_replace(text, '[.!?]([0-9])', ' \1', 'g'), '[.!?;\n]|이며|하며') AS parts, {WORDS.format('text')} AS w FROM documents),
d AS (SELECT doc_id, text, parts, w, list_transform(parts, lambda p: {WORDS.format('p')}) AS said FROM c),
p AS (SELECT fact_id, subject, value, doc_id, text, parts, list_transform(said, lambda s: {NAMED.format('s')}) AS named FROM f JOIN d ON {NAMED.format('w')}),
s AS (SELECT *, list_filter(generate_series(1, len(parts)), lambda i: named[i] OR (i > 1 AND named[i - 1] AND trim(parts[i]) <> '' AND NOT regexp_matches(parts[i], '[0-9]'))) AS kept FROM p),
x AS (SELECT *, CASE WHEN len(kept) = 0 THEN text ELSE array_to_string(list_transform(kept, lambda i: parts[i]), ' ') END AS scoped FROM s),
y AS (SELECT *, {WORDS.format('scoped')} AS have FROM x),
z AS (SELECT *, len(list_intersect(value, have)) >= 0.6 * len(value) AS held, len(list_filter(value, lambda v: len(list_filter(have, lambda h: h = v OR (length(v) > 1 AND starts_with(h, v)))) = 0)) = 0 AS full_ FROM y),
j AS (SELECT fact_id, doc_id, held, CASE WHEN NOT held THEN 1 WHEN NOT full_ OR regexp_matches(text, '{DENIED}') THEN 2 ELSE 3 END AS rank FROM z),
best AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY rank DESC, held DESC, doc_id) = 1)
SELECT fact_id, CASE rank WHEN 3 THEN 'COVERED' WHEN 2 THEN 'UNDETERMINED' WHEN 1 THEN 'PARTIAL' ELSE 'MISSING' END AS verdict, doc_id AS card_id, coalesce(held, false) AS held FROM f LEFT JOIN best USING (fact_id)""")
def facts_in_texts(t):
    """Each fact's best document: whether its text covers the fact, leaves it open, holds a part of it or doesn't name its subject."""
    cards = t("documents").select(F.col("doc_id").alias("card_id"), F.lit("").alias("title"), F.col("text").alias("content"))
    return score_facts(stated(t), cards)
