"""Secret scans by corpus-wide ownership frequency.

Patterns give candidates: the base kinds assign, access and hex, whose spans always stay, and the added kinds pem, jwt and random (runs of 20
characters and more with a digit and both cases). The hash of each candidate's value is aggregated by distinct repositories and owners. A value of
EXAMPLE_OWNERS owners or more is a widely copied example, one with few different characters a placeholder, any other looks live. Spans of
an added kind are only those that look live and overlap no base span and no span of an added kind named before.

Texts are scanned once, in Python tasks, and only hashes are shuffled: (hash, owner, repository) combine before they are dealt, so a value that a
third of all rows holds is one row a task. Verdicts come back by the hashes that have several owners or repositories; rows with the same list of hashes share one
lookup, and rows without candidates take part in no join.

Null text is empty; a null owner or repository is one of its own; an owner's repositories are told apart by name and owner; repeated rows are
judged alike and all kept; an empty table gives no rows. Columns of the input other than those named are not touched, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, materialise, table

#: Owners from which on a value is a widely copied example.
EXAMPLE_OWNERS = 3
#: Different characters that a value needs to look live, and that a random run needs.
LIVE_CHARS, RANDOM_CHARS = 6, 12
BASE, ADDED = ("assign", "access", "hex"), ("pem", "jwt", "random")
KINDS = BASE + ADDED


def either(words: str) -> str:
    """Each ASCII letter in either case; no case folding, which would let other letters in."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


ASSIGN = f"({either('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
PEM = "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[^-]*-----END (?:[A-Z]+ )*PRIVATE KEY-----"
JWT = r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
RANDOM = "[A-Za-z0-9+/_-]+"
#: kind: pattern, group that holds the value, characters that the value needs.
RULES = {"assign": (ASSIGN, 2, 12), "access": (ACCESS, 0, 18), "hex": (HEX, 0, 16), "pem": (PEM, 0, 1), "jwt": (JWT, 0, 1), "random": (RANDOM, 0, 20)}
COMPILED = {k: (re.compile(p), group, least) for k, (p, group, least) in RULES.items()}
#: Runs shorter than the least length can't count, so the scan may pass over them.
COMPILED["hex"] = (re.compile("[0-9a-f]{16,}"), 0, 16)
COMPILED["random"] = (re.compile("[A-Za-z0-9+/_-]{20,}"), 0, 20)

SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string()), ("looks", pa.bool_())])


def random_looking(value: str) -> bool:
    return len(set(value)) >= RANDOM_CHARS and all(re.search(p, value) for p in ("[0-9]", "[A-Z]", "[a-z]"))


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) by start, then kind; added kinds only where nothing named before lies."""
    found, taken = [], []
    for n, kind in enumerate(KINDS):
        pattern, group, least = COMPILED[kind]
        here = [(n, *m.span(), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
        if kind in ADDED and here:
            merged: list[list[int]] = []
            for s, e in sorted(taken):
                if merged and s < merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
            ends = [e for _, e in merged]
            free = lambda s, e: (i := bisect_right(ends, s)) == len(ends) or merged[i][0] >= e  # noqa: B023, E731
            here = [x for x in here if free(x[1], x[2]) and (kind != "random" or random_looking(x[3]))]
        taken += [x[1:3] for x in here]
        found += here
    return sorted(found, key=lambda x: (x[1], x[0]))


def digest(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:32]


def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [[{"kind": k, "start": s, "end": e, "hash": digest(v), "looks": len(set(v)) >= LIVE_CHARS} for k, s, e, v in candidates(x.as_py() or "")] for x in b.column("text")]
        keys = [hashlib.sha256("".join(s["hash"] for s in x).encode()).hexdigest() if x else None for x in spans]
        yield pa.RecordBatch.from_arrays([b.column("kept"), b.column("owner"), b.column("repo"), pa.array(keys, pa.string()), pa.array(spans, pa.list_(SPAN))], ["kept", "owner", "repo", "list_key", "spans"])


def spread(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos of the values that have more than one of either."""
    places = found.select("owner", "repo", F.explode(F.array_distinct("spans.hash")).alias("hash")).distinct()
    owners = places.groupBy("hash", "owner").count()
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("count").alias("n_repos")).filter("n_owners > 1 OR n_repos > 1")


def scan(docs: DataFrame, owner: Column, repo: Column, keep: Sequence[str]) -> DataFrame:
    """The columns `keep` of docs, and spans: array of (kind, start, end, hash, n_owners, n_repos, verdict) by start, then kind; verdict is live,
    example or placeholder. Positions are code points, ends exclusive."""
    bounded_batches(docs.sparkSession)
    given = docs.select(F.struct(*(F.col(f"`{n}`") for n in keep)).alias("kept"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), "text")
    rest = "list_key string, spans array<struct<kind: int, start: bigint, end: bigint, hash: string, looks: boolean>>"
    schema = StructType([given.schema[n] for n in ("kept", "owner", "repo")] + StructType.fromDDL(rest).fields)
    found = materialise(given.mapInArrow(found_in, schema), "secret-spans")
    shared = materialise(spread(found), "secret-spread")
    lists = found.filter("list_key IS NOT NULL").select("list_key", F.explode(F.array_distinct("spans.hash")).alias("hash")).distinct()
    marks = lists.join(shared, "hash").groupBy("list_key").agg(F.map_from_entries(F.collect_list(F.struct("hash", F.struct("n_owners", "n_repos")))).alias("marks"))
    some = found.filter("list_key IS NOT NULL").join(marks, "list_key", "left").select("kept", "spans", "marks")
    none = found.filter("list_key IS NULL").select("kept", "spans", F.lit(None).cast(marks.schema["marks"].dataType).alias("marks"))

    def judged(s: Column) -> Column:
        mark = F.try_element_at("marks", s["hash"])
        owners, repos = F.coalesce(mark["n_owners"], F.lit(1)), F.coalesce(mark["n_repos"], F.lit(1))
        verdict = F.when(owners >= EXAMPLE_OWNERS, "example").when(~s["looks"], "placeholder").otherwise("live")
        kind = F.get(F.array(*map(F.lit, KINDS)), s["kind"])
        return F.struct(kind.alias("kind"), s["kind"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["hash"].alias("hash"), owners.alias("n_owners"), repos.alias("n_repos"), verdict.alias("verdict"))

    spans = F.filter(F.transform("spans", judged), lambda s: (s["rank"] < len(BASE)) | (s["verdict"] == "live"))
    return some.unionByName(none).select(*(F.col(f"kept.`{n}`").alias(n) for n in keep), spans.alias("spans"))


def places(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An owner is a source; its repositories are its languages."""
    found = scan(table(spark, sf_dir, "documents"), F.col("source"), F.col("lang"), ["doc_id"])
    count = lambda field, value: F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        *(count("kind", k).alias(f"n_{k}") for k in BASE),
        F.sha2(places(base), 256).alias("base_sha256"),
        places(F.col("spans")).alias("spans"),
        *(count("verdict", v).alias(f"n_{v}") for v in ("live", "example", "placeholder")),
    )


def _matches(kind: str) -> str:
    """SQL of a kind's matches: what lies between them and what matches, by place, gives the positions."""
    pattern, group, least = RULES[kind]
    p = pattern.replace("'", "''")
    value = f"regexp_extract(m, '^{p}', {group})" if group else "m"
    return f"""SELECT row_id, source, lang, {KINDS.index(kind)} AS kind, s, s + length(m) AS e, v FROM (
  SELECT row_id, source, lang, m, {value} AS v, list_sum(list_transform(between_[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(all_[:i - 1], lambda x: length(x))), 0)::BIGINT AS s FROM (
    SELECT row_id, source, lang, between_, all_, unnest(all_) AS m, generate_subscripts(all_, 1) AS i FROM (
      SELECT row_id, source, lang, string_split_regex(text, '{p}') AS between_, regexp_extract_all(text, '{p}') AS all_ FROM d)))
WHERE length(v) >= {least}"""


_LIVE = f"owners < {EXAMPLE_OWNERS} AND length(v) > 0 AND len(list_distinct(string_split(v, ''))) >= {LIVE_CHARS}"
_FREE = "NOT EXISTS (FROM {} t WHERE t.row_id = c.row_id AND t.s < c.e AND t.e > c.s)"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, source, lang, coalesce(text, '') AS text FROM documents),
base AS ({' UNION ALL '.join(_matches(k) for k in BASE)}),
pem AS (SELECT * FROM ({_matches('pem')}) c WHERE {_FREE.format('base')}),
upto_pem AS (FROM base UNION ALL FROM pem),
jwt AS (SELECT * FROM ({_matches('jwt')}) c WHERE {_FREE.format('upto_pem')}),
upto_jwt AS (FROM upto_pem UNION ALL FROM jwt),
random AS (SELECT * FROM ({_matches('random')}) c WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')
  AND len(list_distinct(string_split(v, ''))) >= {RANDOM_CHARS} AND {_FREE.format('upto_jwt')}),
every AS (FROM upto_jwt UNION ALL FROM random),
spread AS (SELECT v, count(DISTINCT coalesce('=' || source, 'null')) AS owners FROM every GROUP BY 1),
judged AS (SELECT e.*, CASE WHEN owners >= {EXAMPLE_OWNERS} THEN 'example' WHEN {_LIVE} THEN 'live' ELSE 'placeholder' END AS verdict,
  list_extract({list(KINDS)}, kind + 1) || ':' || s || ':' || e.e AS place FROM every e JOIN spread USING (v)),
kept AS (FROM judged WHERE kind < {len(BASE)} OR verdict = 'live'),
told AS (SELECT row_id, {', '.join(f"count(*) FILTER (WHERE kind = {n}) AS n_{k}" for n, k in enumerate(BASE))},
  string_agg(place, ',' ORDER BY s, kind) FILTER (WHERE kind < {len(BASE)}) AS base, string_agg(place, ',' ORDER BY s, kind) AS spans,
  {', '.join(f"count(*) FILTER (WHERE verdict = '{v}') AS n_{v}" for v in ("live", "example", "placeholder"))} FROM kept GROUP BY 1)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  {', '.join(f"coalesce(n_{v}, 0) AS n_{v}" for v in ("live", "example", "placeholder"))}
FROM d LEFT JOIN told USING (row_id)
"""
