"""Checks of written lines against the facts that they cite, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import canonical_number


def canonical(number: Column) -> Column:
    """A fraction as it is; others without thousands separators and zeros at the end of a decimal."""
    return F.when(number.contains("/"), number).otherwise(canonical_number(F.regexp_replace(number, ",", "")))


def numbers_in(text: Column) -> Column:
    """The distinct numbers of a text: fractions as they are, no thousands separators, no zeros at the end of a decimal. Null text: none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(fixed.LINE_NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, canonical))


def bare_value(text: Column) -> Column:
    """Whether nothing but numbers and their units is there: the line doesn't say of what."""
    rest = F.regexp_replace(text, f"(?:{fixed.LINE_NUMBER})(?:{fixed.LINE_UNIT})?", " ")
    return text.rlike(fixed.LINE_NUMBER) & ~rest.rlike("[가-힣A-Za-z]")


def unit_grounded(unit: Column, pool: Column) -> Column:
    """Whether a unit stands in the facts' texts; ASCII ones in any case, others also without a last syllable (a particle)."""
    ascii_unit = ~unit.rlike(r"[^\x00-\x7F]")
    shorter = F.substring(unit, F.lit(1), F.length(unit) - 1)
    return F.when(ascii_unit, F.contains(F.lower(pool), F.lower(unit))).otherwise(F.contains(pool, unit) | ((F.length(unit) > 1) & F.contains(pool, shorter)))


def line_fault(text: Column, pool: Column) -> Column:
    """Why a line may not stand beside the facts whose texts, one a line, are in pool; null if it may. The first number with a fault decides: one that no fact has is invented, else
    the word after it may be. Null text is empty; a null pool has no facts."""
    line, held = F.coalesce(text, F.lit("")), F.coalesce(pool, F.lit(""))
    known, pattern = numbers_in(held), F.lit(f"({fixed.LINE_NUMBER})(?:{fixed.LINE_UNIT})?")
    each = F.arrays_zip(F.regexp_extract_all(line, pattern, F.lit(1)).alias("n"), F.regexp_extract_all(line, pattern, F.lit(2)).alias("unit"))
    fault = lambda x: F.when(~F.array_contains(known, canonical(x["n"])), "LINE_INVENTED_NUMBER").when((x["unit"] != "") & ~unit_grounded(x["unit"], held), "LINE_INVENTED_UNIT")
    first = F.get(F.filter(F.transform(each, fault), lambda f: f.isNotNull()), 0)
    return F.when(~line.rlike(r"\S"), "LINE_EMPTY").when(bare_value(line), "LINE_BARE_VALUE").otherwise(first)


def friendly(text: Column, original: Column, value: Column) -> Column:
    """The rewritten sentence if it has no number that the original lacks and keeps the value's numbers, else the original."""
    new = F.trim(F.coalesce(text, F.lit("")))
    made = F.size(F.array_except(numbers_in(new), numbers_in(original))) > 0
    lost = F.size(F.array_except(numbers_in(value), numbers_in(new))) > 0
    return F.when((new == "") | (F.length(new) > fixed.FRIENDLY_CHARS) | made | lost, original).otherwise(new)


def plain_words(text: Column) -> Column:
    """Lower case; runs of anything but ASCII letters, digits and Hangul as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z가-힣]+", " "))


def fact_coverage(facts: Column, text: Column) -> Column:
    """The share of the expected facts that an answer's words contain; null if none is expected, 0 without an answer."""
    asked = F.filter(facts, lambda f: f.isNotNull() & f.rlike(r"\S"))
    words = plain_words(F.coalesce(text, F.lit("")))
    hit = F.size(F.filter(asked, lambda f: F.contains(words, plain_words(f))))
    return F.when(F.size(asked) > 0, F.when(F.coalesce(text, F.lit("")) == "", F.lit(0.0)).otherwise(F.round(hit / F.size(asked), 4)))


def failure_kind(expected: Column, actual: Column, reason: Column, wanted: Column, rank: Column, citations: Column, precision: Column, coverage: Column) -> Column:
    """What a case failed by, the first that holds; null if it passed. rank: where the first expected card was found; wanted: the reason a miss should give."""
    refused = expected.isin("MISS", "REFUSE", "SAFE_ROUTE")
    mismatch = refused & (expected == "MISS") & (F.coalesce(wanted, F.lit("")) != "") & ~reason.eqNullSafe(wanted)
    return (
        F.when(actual == "ERROR", "RUN_ERROR").when(refused & (actual == "HIT"), "SHOULD_NOT_ANSWER").when(mismatch, "MISS_REASON_MISMATCH").when(refused, None)
        .when(actual == "MISS", "FALSE_MISS").when(citations == 0, "NO_CITATION").when(rank.isNull(), "EXPECTED_CARD_ABSENT")
        .when(F.coalesce(precision == 0, F.lit(False)), "WRONG_CITATION").when(F.coalesce(coverage < 1, F.lit(False)), "MISSING_FACT")
    )


def missing_tokens(cells: Column, crossed: Column, facts: Column, denied: Column) -> Column:
    """Numbers of a row's cells that its facts' text lacks (a number there isn't part of a longer one), as "NUM n", and "NEG column" where a crossed column
    (null: none) has no denied attribute that contains it, or is part of it."""
    text = F.regexp_replace(F.coalesce(facts, F.lit("")), r"(?<=[0-9]),(?=[0-9]{3})", "")
    found = F.flatten(F.transform(cells, lambda c: F.regexp_extract_all(F.regexp_replace(c, r"(?<=[0-9]),(?=[0-9]{3})", ""), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))))
    there = lambda n: F.regexp_like(text, F.concat(F.lit(r"(?<![0-9.])"), F.replace(n, F.lit("."), F.lit("\\.")), F.lit("(?![0-9])")))
    lost = F.transform(F.filter(found, lambda n: ~there(n)), lambda n: F.concat(F.lit("NUM "), n))
    name, attribute = F.replace(crossed, F.lit(" ")), F.replace(F.coalesce(denied, F.lit("")), F.lit(" "))
    said = F.contains(attribute, name) | ((attribute != "") & F.contains(name, attribute))
    return F.concat(lost, F.when(crossed.isNotNull() & ~said, F.array(F.concat(F.lit("NEG "), crossed))).otherwise(F.array().cast("array<string>")))
