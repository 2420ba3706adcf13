"""Source divergence audit with wide term vectors.

A term is a run of letters (ASCII letters and all characters beyond ASCII), A-Z lower-cased; a language keeps the terms that MIN_DOCS of its documents
hold. With counts smoothed by one, a group (language, source) gives each kept term p = 1 + floor(10^9 (count + 1) / (N + V)), and so does the whole language.
The divergence of a group from another of its language is the sum over all kept terms of floor((p - q)^2 / q); the terms that stand
out against the language are listed by the same figure.

Each kept term is one row: an array of (source index, count) of the sources that have it. Terms with the same array contribute the same, so they are
counted first. Higher-order functions emit contributions for pairs of sources that both have the term, and map-side aggregation sums
them. Sources without a term have one p each, so what they contribute follows from counts of (source, count) and of V alone: by inclusion and
exclusion the sum over all terms is exact, and the work of a rare term doesn't grow with the number of sources.

Nulls in text, lang and source are read as ''. A group without terms takes part with counts of zero; a language without kept terms gives pairs of value 0; an
empty table gives no rows. Every row is a document, so repeated rows count again. Other columns are not read. Everything is integer arithmetic: p in decimals (a count of 10^10 and more
would pass 64 bits), (p - q)^2 at most 10^18.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, table

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
#: Entries of the counters of a task that lead to a flush.
HELD = 400_000
#: Parts in which the terms of a language meet its sources, and of a group its terms before they are ranked.
PARTS = 32

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
#: Letters lower-cased, all else a blank: UTF-8 bytes of characters beyond ASCII are 128 and more.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b in _LETTERS else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_TERMS).split()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), docs (rows that hold it), combined over HELD entries."""
    held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            names = list(n)
            for i in range(0, len(names), 10_000):
                some = names[i : i + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        held.clear()

    for b in batches:
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text"), strict=True):
            n, docs = held[lang, source]
            before, found = len(n), terms(text.as_py())
            n.update(found)
            docs.update(set(found))
            size += len(n) - before
        if size >= HELD:
            yield from flush()
            size = 0
    yield from flush()


def p_of(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + 1) / (total + kept)), exact."""
    return F.lit(1) + F.call_function("div", (count + 1).cast("decimal(24,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + kept).cast("decimal(24,0)"))


def f_of(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """The tables of an audit: kept terms with their vectors, the groups, and by language the zero p of each source."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        bounded_batches(spark)
        plain = docs.select(*(F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in ("lang", "source", "text")))
        by_source = Window.partitionBy("lang").orderBy("source")
        # a row for each source; the index counts from 1
        groups = materialise(plain.select("lang", "source").distinct().withColumn("i", F.row_number().over(by_source)), "audit-groups")
        counts = plain.mapInArrow(counted, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        vector = F.array_sort(F.collect_list(F.struct("i", "n")))
        self.kept = materialise(
            counts.join(groups, ["lang", "source"]).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), vector.alias("vector")).filter(F.col("docs") >= MIN_DOCS).drop("docs"), "audit-terms"
        )
        entries = self.kept.select("lang", F.explode("vector").alias("e")).groupBy("lang", F.col("e.i").alias("i")).agg(F.sum("e.n").alias("n_group"))
        whole = self.kept.groupBy("lang").agg(F.count("*").alias("n_kept"), F.sum("total").alias("n_lang"))
        with_sums = groups.join(entries, ["lang", "i"], "left").join(whole, "lang", "left").na.fill(0, ["n_group", "n_kept", "n_lang"])
        # a language without kept terms has no p; 1 stands for its zero p and is not used
        zero = F.when(F.col("n_kept") > 0, p_of(F.lit(0), F.col("n_group"), F.col("n_kept"))).otherwise(1)
        self.groups = materialise(with_sums.withColumn("zero", zero), "audit-sums")
        sides = F.transform(F.array_sort(F.collect_list(F.struct("i", "n_group", "zero"))), lambda x: F.struct(x["n_group"].alias("n"), x["zero"].alias("zero")))
        langs = self.groups.groupBy("lang", "n_kept", "n_lang").agg(sides.alias("sides"))
        self.langs = materialise(langs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), "audit-langs")

    def pairs(self) -> DataFrame:
        """lang, s, t, value of each ordered pair of different sources of a language."""
        side = lambda i: F.element_at("sides", i)
        p = lambda i, n: p_of(n, side(i)["n"], F.col("n_kept"))
        full = lambda e: F.struct(e["i"].alias("i"), p(e["i"], e["n"]).alias("p"), side(e["i"])["zero"].alias("z"))
        row = lambda s, t, v: F.struct(s.alias("s"), t.alias("t"), v.alias("value"))
        x, z = F.col("x"), F.col("x.z")
        seen = materialise(self.kept.groupBy("lang", "vector").agg(F.count("*").alias("m")), "audit-vectors")
        vectors = seen.filter(F.size("vector") > 1).withColumn("part", F.pmod(F.hash("vector"), F.lit(PARTS))).join(self.langs, ["lang", "part"])
        each = vectors.select("lang", "m", F.transform("vector", full).alias("all")).select("lang", "m", "all", F.posexplode("all").alias("at", "x"))
        # each pair once, in both directions; the array is sorted, so what follows x has larger indices
        rest = F.slice("all", F.col("at") + 2, F.size("all"))
        both = F.transform(rest, lambda y: F.struct(x["i"].alias("s"), y["i"].alias("t"), x["p"].alias("p"), z.alias("z"), y["p"].alias("q"), y["z"].alias("w")))
        less = lambda p, z, q, w: F.col("m") * (f_of(F.col(p), F.col(q)) - f_of(F.col(p), F.col(w)) - f_of(F.col(z), F.col(q)) + f_of(F.col(z), F.col(w)))
        met = each.select("lang", "m", F.explode(both).alias("r")).select("lang", "m", "r.*").select("lang", "s", "t", less("p", "z", "q", "w").alias("there"), less("q", "w", "p", "z").alias("back"))
        met = met.groupBy("lang", "s", "t").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
        met = met.select("lang", F.explode(F.array(row(F.col("s"), F.col("t"), F.col("there")), row(F.col("t"), F.col("s"), F.col("back")))).alias("r")).select("lang", "r.*")
        # one source's counts against the zero p of all others, in either direction
        single = seen.select("lang", "m", F.explode("vector").alias("e")).groupBy("lang", "e").agg(F.sum("m").alias("m"))
        alone = single.withColumn("part", F.pmod(F.hash("e"), F.lit(PARTS))).join(self.langs, ["lang", "part"]).select("lang", "m", full(F.col("e")).alias("x"), "sides")
        others = F.filter(F.sequence(F.lit(1), F.size("sides")), lambda t: t != x["i"])
        one = F.flatten(
            F.transform(
                others,
                lambda t: F.array(
                    row(x["i"], t, F.col("m") * (f_of(x["p"], side(t)["zero"]) - f_of(z, side(t)["zero"]))), row(t, x["i"], F.col("m") * (f_of(side(t)["zero"], x["p"]) - f_of(side(t)["zero"], z)))
                ),
            )
        )
        base = self.groups.withColumn("part", F.lit(0)).join(self.langs.select("lang", "part", "sides"), ["lang", "part"])
        none = F.transform(F.filter(F.sequence(F.lit(1), F.size("sides")), lambda t: t != F.col("i")), lambda t: row(F.col("i"), t, F.col("n_kept") * f_of(F.col("zero"), side(t)["zero"])))
        parts = [alone.select("lang", F.explode(one).alias("r")), base.select("lang", F.explode(none).alias("r"))]
        summed = [x.groupBy("lang", "r.s", "r.t").agg(F.sum("r.value").alias("value")) for x in parts]
        return met.unionByName(summed[0]).unionByName(summed[1]).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))

    def standing_out(self) -> DataFrame:
        """lang, s, term, value of the terms that a group has and uses more than its language does."""
        known = self.kept.withColumn("part", F.pmod(F.hash("term"), F.lit(PARTS))).join(self.langs, ["lang", "part"])
        rows = known.select("lang", "term", "sides", "n_kept", p_of(F.col("total"), F.col("n_lang"), F.col("n_kept")).alias("q"), F.explode("vector").alias("e"))
        p = p_of(F.col("e.n"), F.element_at("sides", F.col("e.i"))["n"], F.col("n_kept"))
        return rows.select("lang", F.col("e.i").alias("s"), "term", "q", p.alias("p")).filter("p > q").select("lang", "s", "term", f_of(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    a = Audit(docs)
    names = a.groups.select("lang", F.col("i").alias("s"), "source")
    pairs = a.pairs().join(a.groups.select("lang", F.col("i").alias("t"), F.col("source").alias("item")), ["lang", "t"]).select("lang", "s", F.lit("pair").alias("part"), "item", "value")
    best = [F.desc("value"), F.asc("item")]
    found = a.standing_out().withColumnRenamed("term", "item")
    # first in parts of a group, then over what is left of them
    first = F.row_number().over(Window.partitionBy("lang", "s", "deal").orderBy(*best))
    some = found.withColumn("deal", F.pmod(F.hash("item"), F.lit(PARTS))).withColumn("rank", first).filter(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang", "s").orderBy(*best))
    listed = some.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "s", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.withColumn("rank", rank).unionByName(listed).join(names, ["lang", "s"]).select("lang", "source", "part", "item", "value", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT row_id) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
sums AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.total, 0) + l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
