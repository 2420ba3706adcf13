"""Many patterns at once: Aho-Corasick automata over texts, boundary rules of a lexicon, and replacement that can be undone.

Patterns are counted first and dealt into parts of at most PART patterns; a part's list goes to the tasks, each Python worker builds its automaton once and texts are read
once a part. What a task holds is bounded by PART and by a batch of texts, whatever the number of patterns.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import fixed
from ..functions.text import nfkc

#: Patterns of a part.
PART = 200_000
#: Automata of this worker process, by part; one part is kept.
BUILT: dict[str, Any] = {}


def normal(text: str | None) -> str:
    """NFKC, case folding and single spaces."""
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split())


def automaton(name: str, patterns: list[str]) -> Any:
    import ahocorasick

    if name not in BUILT:
        BUILT.clear()
        a = ahocorasick.Automaton()
        for i, p in enumerate(patterns):
            a.add_word(p, (i, len(p)))
        a.make_automaton()
        BUILT[name] = a
    return BUILT[name]


def occurrences(name: str, patterns: list[str], text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, place in the list) of every occurrence, overlaps included, by end."""
    if patterns:
        for last, (i, n) in automaton(name, patterns).iter(text):
            yield last + 1 - n, last + 1, i


def parts_of(patterns: DataFrame, columns: list[str], part: int) -> Iterator[list[tuple]]:
    """The distinct patterns in lists of about `part` rows, one at a time; a list's rows are dealt by hash, so its size has a bound near `part`."""
    rows = patterns.select(*columns).distinct()
    n = max(1, -(-rows.count() // part))
    dealt = rows.withColumn("dealt", F.pmod(F.xxhash64(*columns), F.lit(n)))
    for i in range(n):
        yield [tuple(r) for r in dealt.filter(F.col("dealt") == i).drop("dealt").orderBy(*columns).toLocalIterator()]


def scanned(texts: DataFrame, key: str, text: str, lists: Iterator[list[tuple]], found: Callable, out: str) -> DataFrame:
    """One row for each tuple of found(automaton's name, patterns, list, text), with the row's key before it; the parts' results as a union."""
    kept = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema, result = StructType([texts.schema[key], *StructType.fromDDL(out).fields]), None
    kinds = [to_arrow_type(f.dataType) for f in schema.fields[1:]]

    def runner(rows: list[tuple]) -> Callable:
        name, patterns = uuid.uuid4().hex, [r[0] for r in rows]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = [(i, *x) for i, t in enumerate(b.column("text")) for x in found(name, patterns, rows, t.as_py())]
                columns = list(zip(*hits, strict=True)) or [()] * len(schema)
                arrays = [b.column("key").take(pa.array(columns[0], pa.int64()))] + [pa.array(c, kind) for c, kind in zip(columns[1:], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

        return run

    for rows in lists:
        one = kept.mapInArrow(runner(rows), schema)
        result = one if result is None else result.unionByName(one)
    return result


def letter(c: str) -> bool:
    return "a" <= c <= "z" or "가" <= c <= "힣"


def bounded(text: str, start: int, end: int) -> bool:
    """Whether a match is a word of its own, or one with a particle."""
    if start and letter(text[start - 1]):
        return False
    free = lambda at: at >= len(text) or not letter(text[at])
    return free(end) or (text[end] in fixed.ALIAS_PARTICLES and free(end + 1))


def lexicon_terms(texts: DataFrame, key: str, text: str, lexicon: DataFrame, part: int = PART) -> DataFrame:
    """key, term of each term one of whose aliases stands in the text between boundaries, a particle after it allowed. lexicon: alias, term.

    Texts and aliases are normalised alike. An alias of several terms is ambiguous and matches nothing (`lexicon_ambiguity` lists such); empty aliases and null texts match nothing."""
    given = lexicon.select(nfkc(F.col("alias")).alias("alias"), "term").filter(F.col("alias") != "")
    clear = given.groupBy("alias").agg(F.min("term").alias("term"), F.max("term").alias("other")).filter("term = other").select("alias", "term")

    def found(name: str, patterns: list[str], rows: list[tuple], t: str | None) -> set[tuple]:
        line = normal(t)
        return {(rows[i][1],) for s, e, i in occurrences(name, patterns, line) if bounded(line, s, e)}

    return scanned(texts, key, text, parts_of(clear, ["alias", "term"], part), found, "term string").distinct()


def checked(mapping: DataFrame) -> DataFrame:
    """mapping (original, token) if it can be undone: originals of two characters and more, tokens [[R_123]], one original a token and one token an original, no token within an original."""
    rows = mapping.select("original", "token")
    well = F.coalesce(F.length(F.trim("original")) >= 2, F.lit(False)) & F.coalesce(F.col("token").rlike(r"^\[\[R_[0-9]{3,6}\]\]$"), F.lit(False)) & ~F.coalesce(F.col("original").rlike(r"\[\[R_[0-9]{3,6}\]\]"), F.lit(False))
    c = rows.agg(F.count("*").alias("n"), F.countDistinct("original").alias("originals"), F.countDistinct("token").alias("tokens"), F.count_if(~well).alias("bad")).first()
    if c.bad or c.n != c.originals or c.n != c.tokens:
        raise ValueError("a mapping needs distinct originals of two characters and more, and distinct tokens [[R_001]] that no original holds")
    if c.n > PART:
        raise ValueError(f"a mapping has at most {PART} originals")
    return rows


def replaced(name: str, patterns: list[str], by: list[str], text: str) -> tuple[str, int]:
    """The text with the leftmost, and of those the longest, matches replaced in one pass, and their number."""
    out, at, n = [], 0, 0
    for s, e, i in sorted(occurrences(name, patterns, text), key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], by[i]]
            at, n = e, n + 1
    return "".join([*out, text[at:]]), n


def replace_all(texts: DataFrame, key: str, text: str, mapping: DataFrame, restore: bool = False) -> DataFrame:
    """key, text, n: originals replaced by their tokens, or with restore tokens by their originals; null text stays null. A replacement never sets off another one.

    A text that holds a token already can't be told from a replaced one: `holds_tokens` finds such texts beforehand."""
    rows = checked(mapping)
    lists = parts_of(rows.select(F.col("token").alias("a"), F.col("original").alias("b")) if restore else rows.select(F.col("original").alias("a"), F.col("token").alias("b")), ["a", "b"], PART)

    def found(name: str, patterns: list[str], rows: list[tuple], t: str | None) -> list[tuple]:
        return [(None, 0) if t is None else replaced(name, patterns, [r[1] for r in rows], t)]

    return scanned(texts, key, text, lists, found, f"{text} string, n long")


def holds_tokens(texts: DataFrame, text: str) -> DataFrame:
    return texts.filter(F.col(text).rlike(r"\[\[R_[0-9]{3,6}\]\]"))
