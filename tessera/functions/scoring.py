"""What one card says of a fact: subject, value and variant within the clauses of the subject. Small helpers for a row; `operators.scoring` finds which rows."""

from __future__ import annotations

import re
from bisect import bisect_left

from . import fixed

WORD = re.compile("[0-9A-Za-z가-힣]+")
CLAUSE = re.compile(f"[{fixed.CLAUSE_ENDS}](?![0-9])|" + "|".join(map(re.escape, fixed.CLAUSE_BREAKS)))
DENIED = re.compile("|".join((*fixed.DENIALS, *(w + r"\b" for w in fixed.DENIALS_ENGLISH))), re.IGNORECASE)
DECIMAL = r"[0-9]+(?:\.[0-9]+)?"
BOUND = re.compile(rf"({DECIMAL})\s*({'|'.join(sorted(fixed.BOUND_UNITS, key=len, reverse=True))})", re.IGNORECASE)
VERDICTS = ("MISSING", "PARTIAL", "UNDETERMINED", "COVERED")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def stem(word: str) -> str:
    """Without the first ending that leaves a letter or more; all endings are Hangul."""
    return word if word.isascii() else next((word[: -len(e)] for e in fixed.SCORING_ENDINGS if word.endswith(e) and len(word) > len(e)), word)


def keys(text: str | None) -> set[str]:
    """Words and stems that can carry a value."""
    forms = {f for w in words(text) if w not in fixed.SCORING_STOP_WORDS for f in (w, stem(w))}
    return {f for f in forms if f not in fixed.SCORING_STOP_WORDS and not (len(f) == 1 and f in fixed.SCORING_STOP_LETTERS)}


def numbers(text: str | None) -> list[str]:
    found = (n.replace(",", "") for n in re.findall(r"[0-9]+(?:[.,][0-9]+)?", text or ""))
    return [n.removesuffix(".0") for n in found]


def near(a: str, b: str) -> bool:
    return len(a) == len(b) and len(a) >= fixed.NEAR_LETTERS and sum(x != y for x, y in zip(a, b, strict=True)) == 1


def names(subject: str, said: list[str]) -> bool:
    """Whether the normalised subject is part of the words, or a word is it but for one letter."""
    return bool(subject) and (subject in " ".join(said) or any(near(subject, w) or near(subject, stem(w)) for w in set(said)))


def scope(subject: str, text: str | None) -> list[str]:
    """The clauses that name the subject, and after each the next one if it has words, no digit, and doesn't name it."""
    parts = CLAUSE.split(text or "")
    named = [names(subject, words(p)) for p in parts]
    after = lambda i: i and named[i - 1] and parts[i].strip() and not re.search(r"\d", parts[i])
    return [p for i, p in enumerate(parts) if named[i] or after(i)]


def shown(variant: str, said: str) -> bool:
    return any(w in said for w in fixed.VARIANT_WORDS.get(variant.upper(), (variant.lower(),)))


def whole_words(value: str | None) -> list[str]:
    asked = [stem(w) for w in words(value) if w not in fixed.SCORING_STOP_WORDS and not w.isdecimal()]
    return [w for w in asked if w not in fixed.SCORING_STOP_WORDS and not (len(w) == 1 and w in fixed.SCORING_STOP_LETTERS)]


def whole(value: str, said: list[str]) -> bool:
    """Whether each word of the value is there, as it is, as a stem or as the beginning of a longer word."""
    return all_begin(whole_words(value), sorted(set(said)))


def all_begin(asked: list[str], have: list[str]) -> bool:
    """have: distinct words in order. A stem is a beginning; a single letter must be a word or a stem."""
    at = [bisect_left(have, w) for w in asked]
    return all(i < len(have) and have[i].startswith(w) if len(w) > 1 else any(x == w or stem(x) == w for x in have[i : i + 1] + [w + e for e in fixed.SCORING_ENDINGS if held(have, w + e)]) for i, w in zip(at, asked, strict=True))


def held(have: list[str], word: str) -> bool:
    i = bisect_left(have, word)
    return i < len(have) and have[i] == word


def doubtful(value: str, variant: str | None, text: str, said: list[str], counted: bool) -> bool:
    """Whether something in the text leaves open that it states the value: a denial, a number with another unit, another number with the unit, both variants, words missing."""
    return bool(DENIED.search(text)) or unclear(value, variant, text, said, counted)


def unclear(value: str, variant: str | None, text: str, said: list[str], counted: bool) -> bool:
    """The same but for denials."""
    if not counted and not whole(value, said):
        return True
    for n, unit in BOUND.findall(value):
        if not re.search(rf"(?<![0-9]){re.escape(n)}\s*{re.escape(unit)}(?![A-Za-z])", text, re.IGNORECASE):
            return True
        if any(x not in numbers(value) for x in re.findall(rf"({DECIMAL})\s*{re.escape(unit)}", text, re.IGNORECASE)):
            return True
    return bool(variant) and sum(shown(v, " ".join(said)) for v in fixed.VARIANT_WORDS) > 1


def judge(subject: str, value: str | None, variant: str | None, title: str | None, content: str | None) -> tuple[int, bool, float]:
    """(place in VERDICTS, whether the value is there, its share) of a card for a fact; 0 where the card doesn't name the subject. The value is looked for in the subject's clauses, in the
    whole text if only the title names it."""
    asked = " ".join(words(subject))
    text = f"{title or ''} " + " ".join(scope(asked, content) or [content or ""])
    said, value = words(text), value or ""
    if not names(asked, said):
        return 0, False, 0.0
    wanted = numbers(value)
    if wanted:
        there = set(numbers(text))
        share = sum(n in there for n in wanted) / len(wanted)
        held = share == 1
    else:
        want = keys(value)
        share = len(want & keys(text)) / len(want) if want else 0.0
        held = share >= fixed.VALUE_SHARE
    plain = " ".join(said)
    if variant and not shown(variant, plain):
        return 1, held and not any(shown(v, plain) for v in fixed.VARIANT_WORDS), share
    if not held:
        return 1, False, share
    every = f"{title or ''} {content or ''}"
    return (2 if doubtful(value, variant, text, said, bool(wanted)) or DENIED.search(every) else 3), True, share


class Card:
    """A card split into clauses once for all its facts: `judge` gives what the function gives, without the share. Clauses are bits of a number: those that hold a key, those that name a subject."""

    def __init__(self, title: str | None, content: str | None):
        self.title, self.content = title or "", content or ""
        self.every = f"{self.title} {self.content}"
        self.denials: dict[str, bool] = {}
        self.denied = bool(DENIED.search(self.every))
        self.parts = CLAUSE.split(self.content)
        said = [words(p) for p in self.parts]
        self.lines = [" ".join(s) for s in said]
        self.line = " ".join(self.lines)
        # bit 0 is the title, bit i + 1 clause i, the last one the whole content: the words that clauses break at count only there
        self.whole = 2 << len(self.parts)
        self.follows = sum(2 << i for i, p in enumerate(self.parts) if i and p.strip() and not re.search(r"\d", p))
        self.forms: dict[str, int] = {}
        self.keys: dict[str, int] = {}
        self.numbers: dict[str, int] = {}
        for i, text in enumerate([self.title, *self.parts]):
            self.add(text, 1 << i)
        for i, s in enumerate(said):
            for w in set(s):
                for x in {w, stem(w)}:
                    self.forms[x] = self.forms.get(x, 0) | 2 << i
        self.scopes: dict[str, tuple[int, str, list[str], bool]] = {}
        self.added = False

    def add(self, text: str, bit: int) -> None:
        for found, of in ((self.keys, keys(text)), (self.numbers, numbers(text))):
            for x in of:
                found[x] = found.get(x, 0) | bit

    def scope(self, subject: str, close: set[str] | None = None) -> tuple[int, str, list[str], bool]:
        """Clauses and title as bits, their text, its words, and whether it names the subject. close: forms that are the subject but for one letter, if they are known."""
        if subject not in self.scopes:
            bits = 0
            if subject:
                if subject in self.line:
                    bits = sum(2 << i for i, x in enumerate(self.lines) if subject in x)
                for x in [x for x in self.forms if near(subject, x)] if close is None else close:
                    bits |= self.forms.get(x, 0)
            bits |= bits << 1 & self.follows
            kept = [p for i, p in enumerate(self.parts) if bits >> i + 1 & 1]
            text = f"{self.title} " + " ".join(kept or [self.content])
            said = words(text)
            named = bool(kept) or names(subject, said)
            if named and not kept and not self.added:
                self.added = True
                self.add(self.content, self.whole)
            self.scopes[subject] = (bits if kept else self.whole) | 1, text, said, named
        return self.scopes[subject]

    def judge(self, asked: str, value: str, variant: str | None, wanted: list[str], want: list[str], close: set[str] | None = None) -> tuple[int, bool]:
        """asked, wanted, want: words, numbers and keys of the subject and the value. close: as in scope."""
        bits, text, said, named = self.scope(asked, close)
        if not named:
            return 0, False
        if wanted:
            held = all(self.numbers.get(n, 0) & bits for n in wanted)
        else:
            held = bool(want) and sum(bool(self.keys.get(w, 0) & bits) for w in want) / len(want) >= fixed.VALUE_SHARE
        if not held:
            return 1, False
        if variant and not shown(variant, plain := " ".join(said)):
            return 1, not any(shown(v, plain) for v in fixed.VARIANT_WORDS)
        if not self.denied and asked not in self.denials:
            self.denials[asked] = bool(DENIED.search(text))
        return (2 if self.denied or self.denials[asked] or unclear(value, variant, text, said, bool(wanted)) else 3), True
