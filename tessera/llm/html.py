"""Main text of web pages: page structure first, a suffix array over each host's pages for what structure leaves open.

Each page becomes blocks of text in page order, each with a level: 3 inside an article, 2 inside main, 1 inside a container named
for its content, 0 open, below 0 inside a menu, header, footer, sidebar, notice, advert, form or reader comments. Where only a form, a header or a class name
says so (-1), a main inside still has its level, and an article has 1; a nav, footer, aside and the like (-2) hold for all inside. The pages of a
host are dealt in shards of SHARD_PAGES pages or fewer. In a shard the pages' token streams are concatenated with a separator of its own after each page and
their suffixes ordered to depth MIN_TOKENS by prefix doubling; substrings of that length that occur on PAGE_SHARE of the host's pages (MIN_PAGES at least)
cover boilerplate. For a host of several shards their counts are summed over all its shards first, and those that the sums of some shards leave open are counted in the others too. A page with blocks above level 0 keeps those of its highest level; any other page keeps its open blocks
that hold a token that isn't covered. Coverage alone would take away articles that several pages of a host carry.

Null html: empty text. Null url: a host of its own, named ''. A page without main text has the empty string. Repeated rows give repeated rows.
Character references are decoded, white space inside a block is one space, blocks are joined by \\n. Unclosed tags end with
the container around them. Markup is scanned once: after a tag whose quotes never close, quotes don't count any more, and without a further ">" the
rest is text. Other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, table
from .urls import host_of

SHARD_PAGES = 200
#: Pages of a task, in whole shards.
TASK_PAGES = 4000
MIN_TOKENS = 8
MIN_PAGES = 3
PAGE_SHARE = 0.3
#: From this share of a shard's pages on, a substring is counted at once. What enough pages of a host have, at least one shard has so often.
SHARD_SHARE = 0.15

OUT_TAGS = frozenset("nav footer aside menu dialog button select textarea label datalist".split())
SOFT_TAGS = frozenset("form header".split())
#: Their content is no text at all.
RAW_TAGS = frozenset("script style noscript template iframe svg object math canvas audio video title".split())
#: Without an end tag these have all that follows.
CODE_TAGS = frozenset("script style".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img input meta link".split())
LOOSE = frozenset("p li dt dd tr td th option".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form status".split())
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar pagination pager login signup comment comments commentlist disqus respond replies share sharing social related recommended widget widgets".split()
)
MAIN_NAMES = frozenset("article post entry content story articlebody".split())
#: What follows one of these in a name is beside the container, not the container.
BESIDE = frozenset("with has no without".split())
HARD, SOFT = -2, -1
OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
PART = re.compile(r"[^>\"']+")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def names_in(value: str) -> set[str]:
    words = re.split(r"[^a-z0-9]+", value)
    return {w for before, w in zip(["", *words], words, strict=False) if before not in BESIDE}


def level_of(tag: str, attributes: str, around: int) -> int:
    """The level inside a container that opens where the level is around."""
    if around <= HARD or tag in OUT_TAGS:
        return HARD
    level = {"article": 3, "main": 2}.get(tag, 0)
    out = tag in SOFT_TAGS and (tag != "header" or around < 1)
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), (a or b or c).lower()
        if name == "role":
            if value in OUT_ROLES:
                return HARD
            level = max(level, {"main": 2, "article": 3}.get(value, 0))
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return HARD
        elif level == 3:  # an article is out by a whole name only
            out |= any(w in OUT_NAMES or w.startswith("comment") for w in value.split())
        elif level < 2:
            found = names_in(value)
            out |= bool(found & OUT_NAMES) or ("header" in found and around < 1)
            level = max(level, int(bool(found & MAIN_NAMES)))
    if out and level != 2:
        return SOFT
    if around == SOFT:
        return {3: 1, 2: 2}.get(level, SOFT)
    return max(level, around)


class Scanner:
    """Tags of a page, each character read a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.quotes, self.unclosed = page, True, set()

    def end_of(self, at: int) -> int:
        """Where the tag ends whose attributes begin at `at`: the place of its ">", or -1."""
        page, i = self.page, at
        while self.quotes:
            m = PART.match(page, i)
            i = m.end() if m else i
            if i == len(page):
                self.quotes = False
            elif page[i] == ">":
                return i
            else:
                i = page.find(page[i], i + 1) + 1
                self.quotes = i > 0
        return page.find(">", at)

    def next_tag(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """The next tag from `at` on: start, end, closing, name, attributes. Comments and declarations have no name."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith(("<!--", "<![CDATA["), start):
                mark = "-->" if page[start + 2] == "-" else "]]>"
                end = page.find(mark, start + 4)
                return start, len(page) if end < 0 else end + 3, False, "", ""
            m = OPENING.match(page, start)
            if m or page[start + 1 : start + 2] in ("!", "?"):
                end = self.end_of(m.end()) if m else page.find(">", start)
                if end < 0:
                    return None
                return start, end + 1, bool(m and m[1]), m[2].lower() if m else "", page[m.end() : end] if m else ""
            at = start + 1
        return None

    def close_of(self, tag: str, at: int) -> int:
        """The end of what a raw tag holds."""
        if tag not in self.unclosed:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(self.page, at)
            if end:
                return end.end()
            self.unclosed.add(tag)
        return len(self.page) if tag in CODE_TAGS else at


def blocks_of(page: str | None) -> list[tuple[str, int]]:
    """(text, level) of each block that isn't empty."""
    page = page or ""
    found: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    level, at = 0, 0
    scanner = Scanner(page)

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((text, level))
            parts.clear()

    def leave(tag: str) -> int:
        """The level around the innermost open tag of this name; what is open inside it ends too."""
        before = level
        while opened[tag]:
            name, before = stack.pop()
            opened[name] -= 1
            if name == tag:
                break
        return before

    def enter(tag: str, inner: int) -> int:
        stack.append((tag, level))
        opened[tag] += 1
        return inner

    while tag_found := scanner.next_tag(at):
        start, end, closing, tag, attributes = tag_found
        if start > at:
            parts.append(page[at:start])
        at = end
        if tag in RAW_TAGS:
            close()
            if not closing and not attributes.endswith("/"):
                at = scanner.close_of(tag, at)
        elif tag == "br":
            parts.append(" ")
        elif tag and tag not in INLINE:
            close()
            if tag in VOID or tag in ("html", "head", "body"):
                continue
            if tag in LOOSE:  # their end tags may be left out, so only those that change the level are remembered
                if stack and stack[-1][0] == tag:
                    level = leave(tag)
                if not closing and (inner := level_of(tag, attributes, level)) != level:
                    level = enter(tag, inner)
            elif closing:
                level = leave(tag)
            elif not attributes.endswith("/"):
                level = enter(tag, level_of(tag, attributes, level))
    parts.append(page[at:])
    close()
    return found


def suffix_ranks(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The streams in a row, each with an end of its own: the rank of each suffix by its first MIN_TOKENS tokens, where streams start, their lengths with that end, and on how many streams each rank is."""
    lengths = np.array([len(s) + 1 for s in streams])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    total = int(lengths.sum())
    top = max((int(s.max()) for s in streams if len(s)), default=0) + 1
    rank = np.empty(total, np.int64)
    page = np.repeat(np.arange(len(streams)), lengths)
    for i, (s, at) in enumerate(zip(streams, starts, strict=True)):
        rank[at : at + len(s)] = s
        rank[at + len(s)] = top + i
    depth = 1
    rank = np.unique(rank, return_inverse=True)[1]
    while depth < MIN_TOKENS:  # the order of suffixes by their first 2 * depth tokens
        step = min(depth, MIN_TOKENS - depth)
        later = np.zeros(total, np.int64)
        later[: max(0, total - step)] = rank[step:] + 1
        rank = np.unique(rank * (total + 2) + later, return_inverse=True)[1]
        depth += step
    suffixes = np.argsort(rank, kind="stable")
    ordered, owner = rank[suffixes], page[suffixes]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]) | (owner[1:] != owner[:-1])])
    return rank, starts, lengths, np.bincount(ordered[new], minlength=total)


def enough(pages: int) -> int:
    return max(MIN_PAGES, math.ceil(PAGE_SHARE * pages))


def within(often: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """For each stream, which tokens lie in a substring of MIN_TOKENS tokens that begins where it is often."""
    edge = np.zeros(len(often) + MIN_TOKENS + 1, np.int64)
    np.add.at(edge, np.nonzero(often)[0], 1)
    np.add.at(edge, np.nonzero(often)[0] + MIN_TOKENS, -1)
    inside = np.cumsum(edge)[: len(often)] > 0
    return [inside[at : at + n - 1] for at, n in zip(starts, lengths, strict=True)]


def covered(streams: list[np.ndarray], pages: int) -> list[np.ndarray]:
    """For each page's token ids, which tokens lie in a substring of MIN_TOKENS tokens that enough pages have."""
    if not len(streams):
        return []
    rank, starts, lengths, spread = suffix_ranks(streams)
    return within(spread[rank] >= enough(pages), starts, lengths)


def streams_of(pages: list[list[str]], grams: list[str]) -> list[np.ndarray]:
    """Token ids of pages (their blocks), then of substrings, each a stream."""
    ids: dict[str, int] = {}
    return [np.array([ids.setdefault(w, len(ids)) for t in texts for w in t.split(" ")], np.int64) for texts in [*pages, *([g] for g in grams)]]


def frequent_here(pages: list[list[str]]) -> dict[str, int]:
    """The substrings of MIN_TOKENS tokens on SHARD_SHARE of a shard's pages or more, with the number of pages."""
    rank, starts, lengths, spread = suffix_ranks(streams_of(pages, []))
    often = spread[rank] >= math.ceil(SHARD_SHARE * len(pages) - 1e-9)
    words = [[w for t in texts for w in t.split(" ")] for texts in pages]
    found: dict[int, str] = {}
    for page, at in zip(words, starts.tolist(), strict=True):
        for i in np.nonzero(often[at : at + max(0, len(page) - MIN_TOKENS + 1)])[0].tolist():
            if rank[at + i] not in found:
                found[rank[at + i]] = " ".join(page[i : i + MIN_TOKENS])
    return {gram: int(spread[r]) for r, gram in found.items()}


def pages_with(pages: list[list[str]], grams: list[str]) -> list[int]:
    """How many of the pages have each substring."""
    rank, starts, _, spread = suffix_ranks(streams_of(pages, grams))
    return (spread[rank[starts[len(pages) :]]] - 1).tolist()


def main_texts(pages: list[tuple[list[str], list[int]]], often: list[str] | None = None) -> list[str]:
    """The main text of each page of a shard: its blocks' texts and levels. Substrings that are often on the host are given, or counted where the shard is the host."""
    words = [[t.split(" ") for t in texts] for texts, _ in pages]
    streams = streams_of([texts for texts, _ in pages], often or [])
    if often is None:
        cover = covered(streams, len(pages))
    else:
        rank, starts, lengths, _ = suffix_ranks(streams)
        cover = within(np.isin(rank, rank[starts[len(pages) :]]), starts, lengths)[: len(pages)]
    out = []
    for (texts, levels), page, hit in zip(pages, words, cover, strict=True):
        best = max(levels, default=-1)
        if best < 1:
            ends = np.cumsum([len(b) for b in page]).tolist()
            kept = [t for t, level, b, e in zip(texts, levels, page, ends, strict=True) if level == 0 and not hit[e - len(b) : e].all()]
        else:
            kept = [t for t, level in zip(texts, levels, strict=True) if level == best]
        out.append("\n".join(kept))
    return out


def extract(pages: DataFrame, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """page_id, url, text, n_chars."""
    bounded_batches(pages.sparkSession)
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"))
    named = named.withColumn("row", F.xxhash64("page_id", "url", "html"))  # page_id may be null or repeated
    hosts = materialise(named.groupBy("host").agg(F.count("*").alias("pages")), "html-hosts")
    large = hosts.filter(F.col("pages") > shard_pages).select("host", F.ceil(F.col("pages") / (0.75 * shard_pages)).cast("int").alias("parts"))
    kind = pages.schema["url"].dataType.simpleString()
    shuffled = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def parse(batches):
        for b in batches:
            found = [blocks_of(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("host"), b.column("shard"), pa.array([[t for t, _ in f] for f in found], pa.list_(pa.string())), pa.array([[v for _, v in f] for f in found], pa.list_(pa.int8()))], ["page_id", "url", "host", "shard", "texts", "levels"])

    def dealt(rows: DataFrame, of: DataFrame) -> DataFrame:
        """Blocks of the pages, by shard."""
        tasks = math.ceil((of.agg(F.sum("pages")).first()[0] or 0) / TASK_PAGES)
        blocks = rows.select("page_id", "url", "html", "host", "shard").mapInArrow(parse, f"page_id long, url {kind}, host string, shard int, texts array<string>, levels array<tinyint>")
        return blocks.repartition(max(tasks, shuffled), "host", "shard")

    def result(shard: pa.Table, often: list[str] | None) -> pa.Table:
        texts = main_texts(list(zip(shard.column("texts").to_pylist(), shard.column("levels").to_pylist(), strict=True)), often)
        return pa.table({"page_id": shard.column("page_id"), "url": shard.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    def judge(shard: pa.Table) -> pa.Table:
        return result(shard, None)

    def judge_by(shard: pa.Table, often: pa.Table) -> pa.Table:
        return result(shard, often.column("gram").to_pylist()) if shard.num_rows else out_schema.empty_table()

    def propose(shard: pa.Table) -> pa.Table:
        found = frequent_here(shard.column("texts").to_pylist())
        whole = lambda x: pa.array([x] * len(found), pa.int64())
        return pa.table({"host": pa.array([shard.column("host")[0].as_py()] * len(found), pa.string()), "gram": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64()), "seen": whole(shard.num_rows)})

    def count(shard: pa.Table, asked: pa.Table) -> pa.Table:
        grams = asked.column("gram").to_pylist() if shard.num_rows else []
        n = pages_with(shard.column("texts").to_pylist(), grams) if grams else []
        return pa.table({"host": pa.array([shard.column("host")[0].as_py()] * len(grams) if grams else [], pa.string()), "gram": pa.array(grams, pa.string()), "n": pa.array(n, pa.int64())})

    out = f"page_id long, url {kind}, text string, n_chars long"
    out_schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    if large.isEmpty():
        return dealt(named.withColumn("shard", F.lit(0)), hosts).groupBy("host", "shard").applyInArrow(judge, out)
    few = dealt(named.join(large, "host", "left_anti").withColumn("shard", F.lit(0)), hosts).groupBy("host", "shard").applyInArrow(judge, out)
    shards = named.join(large, "host").withColumn("shard", F.pmod("row", F.col("parts")).cast("int"))
    each = large.select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("shard"))
    of = hosts.join(large, "host", "left_semi")
    proposed = dealt(shards, of).groupBy("host", "shard").applyInArrow(propose, "host string, gram string, n long, seen long")
    known = proposed.groupBy("host", "gram").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")).join(hosts, "host")
    least = F.greatest(F.lit(MIN_PAGES), F.ceil(F.lit(PAGE_SHARE) * F.col("pages")))
    # shards that didn't name a substring have it on less than SHARD_SHARE of their pages
    most = F.col("n") + F.ceil(F.lit(SHARD_SHARE) * (F.col("pages") - F.col("seen")))
    known = materialise(known.filter(most >= least).select("host", "gram", (F.col("n") >= least).alias("sure")), "html-known")
    often, asked = known.filter("sure").select("host", "gram"), known.filter("NOT sure").select("host", "gram")
    if not asked.isEmpty():  # counted on all pages of their hosts
        again = shards.join(asked.select("host").distinct(), "host", "left_semi")
        counted = dealt(again, of).groupBy("host", "shard").cogroup(asked.join(each, "host").groupBy("host", "shard")).applyInArrow(count, "host string, gram string, n long")
        counted = counted.groupBy("host", "gram").agg(F.sum("n").alias("n")).join(hosts, "host").filter(F.col("n") >= least).select("host", "gram")
        often = often.unionByName(materialise(counted, "html-counted"))
    many = dealt(shards, of).groupBy("host", "shard").cogroup(often.join(each, "host").groupBy("host", "shard")).applyInArrow(judge_by, out)
    return few.unionByName(many)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
