"""Phrase collocation mining by suffix-sigma.

Texts are cut at punctuation into pieces and those into words, A-Z lower-cased. From each word on, the suffix of its piece, truncated to MAX_WORDS
words, is dealt by language and first word and sorted in reverse lexicographic order; one stack of open prefixes counts all phrases in one
pass, as a prefix is complete once a suffix comes that doesn't start with it. Counts of phrases are then joined with those of their parts.

A phrase is only as frequent as its rarest word, so suffixes end at words that a filter of the frequent ones doesn't know: it has a fixed size, and once it is
full it lets rare words pass, which costs rows and never a count. Equal suffixes of about CHUNK bytes of text combine before the shuffle. Suffixes of a first word with HOT of all words or more are dealt by their
first two words, and those of a pair with HOT_PAIR or more by all words; what such pairs count in several tasks is summed afterwards. There are at
most 1 / HOT such words; pairs are found by chunk, at most 1 / HOT_PAIR of each, and only decide where rows go, never a count. A task holds a chunk, or ROWS
sorted suffixes and a stack of MAX_WORDS prefixes.

Null text is empty, null lang is und; repeated rows count again; texts without words and empty tables give no rows; columns other than lang and text
are not read. Scores are exact: decimals of 38 digits, floored by integer division.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, table

MAX_WORDS, MIN_COUNT, TOP = 4, 30, 2000
#: A candidate goes if a longer one has this percentage of its count.
COVERED = 80
HOT, HOT_PAIR = 1 / 20_000, 1 / 5_000
CHUNK, ROWS = 3 << 20, 50_000
#: Bits of the filter of frequent words, two for each: 8 MB whatever the corpus.
FILTER_BITS = 1 << 26
#: Parts of a language that are ranked before the whole.
PARTS = 64

#: A-Z lower-cased, punctuation that ends a piece as a full stop, a tab as a blank.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
#: Bytes 0 to 8 move up by one, in order (no word holds byte 9), so byte 0 can stand between words and sorts below all of them.
RAISED = bytes(b + 1 if b < 9 else b for b in range(256))
LOWERED = bytes(32 if b == 0 else b - 1 if b < 10 else b for b in range(256))
AHEAD = re.compile(rb" *(?:[^ .]+(?: +|(?=\.)|$)){0,%d}" % (MAX_WORDS - 1))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], int]]:
    """(lang, words with b"." between pieces, words at the end that are only there to be looked at) of about CHUNK bytes each."""
    held: dict[str, list[bytes]] = defaultdict(list)
    sizes: Counter = Counter()

    def cut(lang: str) -> Iterator[tuple[str, list[bytes], int]]:
        blob, at = b".".join(held.pop(lang)), 0
        sizes.pop(lang)
        while at < len(blob):
            end, ahead = len(blob), 0
            if end - at > CHUNK:
                end = blob.rfind(b".", at, at + CHUNK)
                if end < at:  # a piece longer than a chunk is cut between words, and the next words are looked at
                    end = min(x for x in (blob.find(b" ", at + CHUNK), blob.find(b".", at + CHUNK), len(blob)) if x >= 0)
                    ahead = AHEAD.match(blob, end).end() - end if blob[end : end + 1] == b" " else 0
            tail = len(blob[end : end + ahead].split())
            yield lang, blob[at : end + ahead].replace(b".", b" . ").split(), tail
            at = end + 1

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            text = text.as_py().encode().translate(PLAIN)
            held[lang].append(text)
            sizes[lang] += len(text) + 1
            if sizes[lang] >= CHUNK:
                yield from cut(lang)
    for lang in list(held):
        yield from cut(lang)


def coded(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The sorted vocabulary, and each word's place in it from 1 on; 0 ends a piece."""
    names = set(words)
    names.discard(b".")
    vocabulary = sorted(names)
    of = {w: i for i, w in enumerate(vocabulary, 1)} | {b".": 0}
    return vocabulary, np.fromiter(map(of.__getitem__, words), np.int64, len(words))


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, first, second, n: words (second null), the number of all words (both null), and pairs that are frequent in a chunk."""
    for lang, words, tail in chunks(batches):
        vocabulary, a = coded(words)
        n = len(a) - tail
        at = np.flatnonzero(a[:n])
        if not len(at):
            continue
        names = pa.array(vocabulary, pa.binary())
        size = len(vocabulary) + 1
        each = np.bincount(a[at], minlength=size)[1:]
        pairs, times = np.unique(a[at] * size + np.append(a, 0)[at + 1], return_counts=True)
        some = (times >= max(2, len(at) * HOT_PAIR)) & (pairs % size > 0)
        pairs, times = pairs[some], times[some]
        there = np.flatnonzero(each)
        first = pa.concat_arrays([pa.nulls(1, pa.binary()), names.take(pa.array(there)), names.take(pa.array(pairs // size - 1))])
        second = pa.concat_arrays([pa.nulls(1 + len(there), pa.binary()), names.take(pa.array(pairs % size - 1))])
        count = np.concatenate([[len(at)], each[there], times])
        yield from sliced([pa.array([lang] * len(first), pa.string()), first.cast(pa.string()), second.cast(pa.string()), pa.array(count, pa.int64())], ["lang", "first", "second", "n"])


def sliced(arrays: list[pa.Array], names: list[str], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(arrays, names)
    for i in range(0, whole.num_rows, rows):
        yield whole.slice(i, rows)


def mixed(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    x = (key ^ (more * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a word's hash in the filter of frequent words."""
    return h & np.uint64(FILTER_BITS - 1), h >> np.uint64(32) & np.uint64(FILTER_BITS - 1)


def suffixes(frequent: np.ndarray, hot: dict[str, set[bytes]], hot_pairs: dict[str, set[tuple[bytes, bytes]]]) -> Callable:
    """key (what decides the task; odd for a hot pair), suffix (the language and two words or more, with byte 0 between them), n. A word that is not in
    the filter ends a piece: no phrase that is frequent holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, tail in chunks(batches):
            vocabulary, a = coded(words)
            n, size = len(a) - tail, len(vocabulary) + 1
            before = lang.encode() + b" "
            hashes = np.array([0, *(xxhash.xxh64_intdigest(before + x, 42) for x in vocabulary)], np.uint64)
            known = np.ones(size, bool)
            for bit in places(hashes):
                known &= frequent[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1) > 0
            known[0] = False
            padded = np.append(np.where(known[a], a, 0), np.zeros(MAX_WORDS, np.int64))
            w = [padded[i : n + i] for i in range(MAX_WORDS)]
            begins = (w[0] > 0) & (w[1] > 0)
            if not begins.any():
                continue
            front = (w[0] * size + w[1])[begins]
            back = np.where(w[2] > 0, w[2] * size + w[3], 0)[begins]
            u, front = np.unique(front, return_inverse=True)
            v, back = np.unique(back, return_inverse=True)
            code, times = np.unique(front * len(v) + back, return_counts=True)
            front, back = u[code // len(v)], v[code % len(v)]
            ids = [front // size, front % size, back // size, back % size]
            of = {x: i for i, x in enumerate(vocabulary, 1)}
            is_hot = np.zeros(size, bool)
            is_hot[[of[x] for x in hot.get(lang, ()) if x in of]] = True
            pairs = [of[x] * size + of[y] for x, y in hot_pairs.get(lang, ()) if x in of and y in of]
            of_pair = np.isin(front, np.array(pairs, np.int64))
            by_first = hashes[ids[0]]
            by_pair = mixed(by_first, hashes[ids[1]])
            by_all = mixed(mixed(by_pair, hashes[ids[2]]), hashes[ids[3]])
            key = np.where(of_pair, by_all, np.where(is_hot[ids[0]], by_pair, by_first)) & ~np.uint64(1) | of_pair
            names = pa.array([x.translate(RAISED) for x in vocabulary], pa.binary())
            texts = [names.take(pa.array(i - 1, mask=i == 0)) for i in ids]
            joined = pc.binary_join_element_wise(pa.scalar(quote(lang, safe="").encode()), *texts, pa.scalar(b"\0", pa.binary()), null_handling="skip")
            yield from sliced([pa.array(key.view(np.int64)), joined, pa.array(times, pa.int64())], ["key", "suffix", "n"])

    return run


def counted_prefixes(least: int) -> Callable:
    """From sorted suffixes: lang, phrase, n_words, n of phrases of two words and more; all that reach `least`, and all parts of hot pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: dict[int, tuple] = {}  # by number of words: what is open, (key, language and words), and its count so far

        def told(done: list[tuple[tuple, int]]) -> Iterator[pa.RecordBatch]:
            done = [(what, n) for what, n in done if n >= least or (what[0] & 1 and len(what[1]) <= MAX_WORDS)]
            if done:
                langs = [unquote(what[1][0].decode()) for what, _ in done]
                phrases = [b"\0".join(what[1][1:]).translate(LOWERED).decode() for what, _ in done]
                yield from sliced([pa.array(langs, pa.string()), pa.array(phrases), pa.array([len(what[1]) - 1 for what, _ in done], pa.int32()), pa.array([n for _, n in done], pa.int64())], ["lang", "phrase", "n_words", "n"])

        for t in gathered(batches):
            key, n, text = t["key"].to_numpy(), t["n"].to_numpy(), t["suffix"].combine_chunks()
            words = pc.split_pattern(text, b"\0")
            sizes = pc.list_value_length(words).to_numpy()
            row = np.repeat(np.arange(len(key)), sizes)
            depth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.full((MAX_WORDS + 1, len(key)), -1)
            at[depth, row] = words.flatten().dictionary_encode().indices.to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (at[0][1:] != at[0][:-1]) | (at[1][1:] != at[1][:-1])
            what = lambda i, d: (int(key[i]), tuple(text[i].as_py().split(b"\0")[: d + 1]))  # noqa: B023, E731
            done: list[tuple[tuple, int]] = []
            for d in range(2, MAX_WORDS + 1):
                new[1:] |= at[d][1:] != at[d][:-1]
                rows = np.flatnonzero(at[d] >= 0)
                if not len(rows):
                    continue
                group = np.cumsum(new)[rows]
                starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                sums, first = np.add.reduceat(n[rows], starts), rows[starts]
                if d in stack:
                    was, count = stack[d]
                    if was == what(first[0], d):
                        sums[0] += count
                    else:
                        done.append((was, count))
                full = sums[:-1] >= least if d == MAX_WORDS else (sums[:-1] >= least) | (key[first[:-1]] & 1 > 0)
                done += [(what(first[i], d), int(sums[i])) for i in np.flatnonzero(full)]
                stack[d] = (what(first[-1], d), int(sums[-1]))
            yield from told(done)
        yield from told(list(stack.values()))

    return run


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= ROWS:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def filter_of(words: DataFrame) -> np.ndarray:
    """The filter of frequent words. Spark sets the bits; what reaches the driver has a fixed bound."""
    h = F.xxhash64(F.concat("lang", F.lit(" "), "first"))
    bits = words.filter("first IS NOT NULL AND second IS NULL").select(F.explode(F.array(h, F.shiftrightunsigned(h, 32))).alias("h")).select(F.col("h").bitwiseAND(FILTER_BITS - 1).alias("bit"))
    slots = bits.groupBy(F.shiftright("bit", 6).alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))).alias("set")).toArrow()
    frequent = np.zeros(FILTER_BITS // 64, np.int64)
    frequent[slots["slot"].to_numpy()] = slots["set"].to_numpy()
    return frequent.view(np.uint64)


def phrase_counts(docs: DataFrame, least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n), (lang, phrase, n) of words, (lang, phrase, n_words, n) of phrases; words and phrases that occur `least` times."""
    spark = docs.sparkSession
    bounded_batches(spark)
    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = plain.mapInArrow(counted_words, "lang string, first string, second string, n long").groupBy("lang", "first", "second").agg(F.sum("n").alias("n"))
    words = materialise(counts.filter((F.col("n") >= least) | F.col("first").isNull()), "phrase-words")
    totals = words.filter("first IS NULL").select("lang", "n")
    all_words = totals.agg(F.sum("n")).first()[0] or 0
    hot: dict[str, set[bytes]] = defaultdict(set)
    hot_pairs: dict[str, set[tuple[bytes, bytes]]] = defaultdict(set)
    # both lists are bounded: shares of all words
    for lang, first in words.filter(f"first IS NOT NULL AND second IS NULL AND n >= {all_words * HOT}").select("lang", "first").toLocalIterator():
        hot[lang].add(first.encode())
    for lang, first, second in words.filter(f"second IS NOT NULL AND n >= {all_words * HOT_PAIR}").select("lang", "first", "second").toLocalIterator():
        hot_pairs[lang].add((first.encode(), second.encode()))
    dealt = plain.mapInArrow(suffixes(filter_of(words), dict(hot), dict(hot_pairs)), "key long, suffix binary, n long").repartition("key")
    found = dealt.sortWithinPartitions("key", F.desc("suffix")).mapInArrow(counted_prefixes(least), "lang string, phrase string, n_words int, n long")
    phrases = materialise(found.groupBy("lang", "phrase", "n_words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "phrases")
    return totals, words.filter("first IS NOT NULL AND second IS NULL").select("lang", F.col("first").alias("phrase"), "n"), phrases


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    totals, words, phrases = phrase_counts(docs, least)
    exact = lambda c: c.cast("decimal(38,0)")
    w = F.split("phrase", " ")
    text = lambda at, n: F.array_join(F.slice(w, at, n), " ")
    parts = words.unionByName(phrases.select("lang", "phrase", "n"))
    cuts = phrases.select("lang", "phrase", "n_words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", text(F.lit(1), F.col("k")).alias("left"), text(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("right"))
    joined = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = F.call_function("div", F.col("a").cast("decimal(28,0)") * F.lit(2_000_000).cast("decimal(8,0)"), exact(F.col("l") + F.col("r")))
    worst = joined.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    inner = F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("n_words") - n + 1), lambda at: text(at, n)))
    longer = phrases.filter("n_words > 2").select("lang", "n", F.explode(F.flatten(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = worst.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (exact(F.col("longer")) * 100 < exact(F.col("a")) * COVERED))
    rows = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = rows.withColumn("part", F.pmod(F.hash("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(generate_series(1, len(words) - k + 1), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(words) >= k),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY 1, 2, 3 HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY 1),
cuts AS (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS words, unnest(generate_series(1, k - 1)) AS cut FROM f WHERE k > 1),
scored AS (SELECT c.lang, c.phrase, c.a, c.cut, x.n AS l, y.n AS r, ((2000000::HUGEINT * c.a) // (x.n + y.n))::BIGINT AS score FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:c.cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[c.cut + 1:], ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT * FROM worst s WHERE NOT EXISTS (FROM f WHERE f.lang = s.lang AND f.k > len(string_split(s.phrase, ' ')) AND contains(' ' || f.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * f.n >= 80 * s.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
