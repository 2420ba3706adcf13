"""Facts against the texts of cards.

Facts are dealt into parts, whose lists go to the tasks, and cards are read once a part. Which facts a card can hold comes from an automaton of the subjects over the
card (a subject may be part of a longer word), from its words with one place left open (one wrong letter), and from its keys: a text with the needed share of a value's n keys
has one of any n - needed + 1 of them. Only these are judged on the text, and only while the task has seen no card that this one can't pass; a task gives one row a fact.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import fixed
from ..functions.scoring import VERDICTS, Card, all_begin, keys, numbers, stem, whole_words, words
from .patterns import occurrences, parts_of

#: Facts of a part.
PART = 50_000


def open_places(word: str) -> list[tuple[int, str]]:
    """A word with each of its places left open."""
    return [(i, word[:i] + word[i + 1 :]) for i in range(len(word))] if len(word) >= fixed.NEAR_LETTERS else []


class Facts:
    """A part's facts (fact_id, subject, value, variant) by subject and by the keys of their values, and the best card seen for each."""

    def __init__(self, rows: list[tuple]):
        self.name, self.rows = uuid.uuid4().hex, rows
        self.asked = [" ".join(words(r[1])) for r in rows]
        self.numbers = [numbers(r[2]) for r in rows]
        self.keys = [sorted({f"#{x}" for x in n} or keys(r[2])) for n, r in zip(self.numbers, rows, strict=True)]
        self.needed = [len(k) if n else math.ceil(fixed.VALUE_SHARE * len(k) - 1e-9) for n, k in zip(self.numbers, self.keys, strict=True)]
        self.whole = [[] if n else whole_words(r[2]) for n, r in zip(self.numbers, rows, strict=True)]
        spread = Counter(k for of in self.keys for k in of)
        self.by: dict[str, dict[str, list[int]]] = {}
        for i, (s, of, n) in enumerate(zip(self.asked, self.keys, self.needed, strict=True)):
            by = self.by.setdefault(s, {})
            for k in sorted(of, key=lambda k: (spread[k], k))[: len(of) - n + 1]:
                by.setdefault(k, []).append(i)
        self.by.pop("", None)
        self.subjects = sorted(self.by)
        self.open: dict[tuple, list[str]] = {}
        for s in self.subjects:
            for code in open_places(s):
                self.open.setdefault(code, []).append(s)
        self.best: dict[int, tuple] = {}
        self.least: dict[str, Any] = {}

    def named(self, said: list[str]) -> dict[str, set[str]]:
        """The subjects that the words name, each with the forms that are it but for one letter."""
        found: dict[str, set[str]] = {self.subjects[i]: set() for _, _, i in occurrences(self.name, self.subjects, " ".join(said))}
        have = set(said)
        for f in have | {stem(w) for w in have}:
            for code in open_places(f):
                for s in self.open.get(code, ()):
                    if s != f:
                        found.setdefault(s, set()).add(f)
        return found

    def meet(self, card_id: Any, title: str | None, content: str | None) -> None:
        text, card = f"{title or ''} {content or ''}", None
        have = keys(text) | {f"#{n}" for n in numbers(text)}
        said = words(text)
        # words in order, to see which values can't be there whole; where clauses break within words, all may be
        have_words = None if any(x in text for x in fixed.CLAUSE_BREAKS) else sorted(set(said))
        for s, close in self.named(said).items():
            if s not in self.least or card_id < self.least[s]:
                self.least[s] = card_id
            by = self.by[s]
            for i in {i for k in by.keys() & have for i in by[k]}:
                before = self.best.get(i, (0, True, card_id))
                if before < (-3, False, card_id) or sum(k in have for k in self.keys[i]) < self.needed[i]:
                    continue
                if before < (-2, False, card_id) and have_words is not None and not all_begin(self.whole[i], have_words):
                    continue
                card = card or Card(title, content)
                if card.denied and before < (-2, False, card_id):
                    continue
                rank, held = card.judge(s, self.rows[i][2] or "", self.rows[i][3], self.numbers[i], () if self.numbers[i] else self.keys[i], close)
                if rank and (this := (-rank, not held, card_id)) < before:
                    self.best[i] = this

    def found(self) -> list[tuple]:
        """fact_id, rank, whether the value lacks, card_id; a card that only names the subject is partial."""
        only = ((i, (-1, True, self.least[s])) for i, s in enumerate(self.asked) if s in self.least)
        return [(self.rows[i][0], *min(self.best.get(i, x), x)) for i, x in only]


def judged(rows: list[tuple], kinds: list[pa.DataType]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = Facts(rows)
        for b in batches:
            for card in zip(b.column("card_id").to_pylist(), b.column("title").to_pylist(), b.column("content").to_pylist(), strict=True):
                if card[0] is not None:
                    facts.meet(*card)
        columns = list(zip(*facts.found(), strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["fact_id", "rank", "lacks", "card_id"])

    return run


def score_facts(facts: DataFrame, cards: DataFrame, part: int = PART) -> DataFrame:
    """facts: fact_id, subject, value, variant (null: none). cards: card_id, title, content. For each fact: verdict, card_id, held (whether that card has the value) of
    its best card; of equal cards, the smallest card_id. Facts whose subject no card names are MISSING, without a card.

    Facts and cards with null texts have empty ones; an empty subject is MISSING. fact_id and card_id are unique; columns besides those named are not read."""
    f, c = facts.select("fact_id", "subject", "value", "variant"), cards.select("card_id", "title", "content")
    kinds = [f.schema["fact_id"].dataType, "int", "boolean", c.schema["card_id"].dataType]
    arrow, names = [to_arrow_type(kinds[0]), pa.int32(), pa.bool_(), to_arrow_type(kinds[3])], ["fact_id", "rank", "lacks", "card_id"]
    schema = ", ".join(f"{n} {k if isinstance(k, str) else k.simpleString()}" for n, k in zip(names, kinds, strict=True))
    found = None
    for rows in parts_of(f, ["fact_id", "subject", "value", "variant"], part):
        one = c.mapInArrow(judged(rows, arrow), schema)
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("fact_id").agg(F.min(F.struct("rank", "lacks", "card_id")).alias("b"))
    verdict = F.element_at(F.array(*map(F.lit, VERDICTS)), F.coalesce(-F.col("b.rank"), F.lit(0)) + 1)
    return f.select("fact_id").join(best, "fact_id", "left").select("fact_id", verdict.alias("verdict"), F.col("b.card_id").alias("card_id"), F.coalesce(~F.col("b.lacks"), F.lit(False)).alias("held"))
