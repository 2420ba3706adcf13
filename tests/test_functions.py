import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import checks
from tessera.functions import text as X


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_question_key(spark):
    assert one(spark, "  Where \n IS  it? ", X.question_key) == "where is it?"
    assert one(spark, None, X.question_key) == ""


def test_squash_drops_invisible_characters(spark):
    assert one(spark, "a​ b﻿ c⁠", X.squash) == "abc"


def test_nfkc(spark):
    assert one(spark, "  ＨＯＴ   ２２５ml ", X.nfkc) == "hot 225ml"
    assert one(spark, None, X.nfkc) is None


def test_anchors(spark):
    # the particle goes, stop words and bare predicates go, single letters stay but for the stop letters
    assert set(one(spark, "컵은 어디 있어요?", X.anchors)) == {"컵은"}
    assert set(one(spark, "시럽에서 샷 몇 개", X.anchors)) == {"시럽에서", "시럽", "샷"}
    assert one(spark, None, X.anchors) == []


def test_lexical_terms(spark):
    assert one(spark, "원두는 225.5 Gram", X.lexical_terms) == ["원두는", "원두", "225.5", "gram"]


def test_faq_overlap(spark):
    r = spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), ([], ["a"])], "a array<string>, b array<string>").select(X.overlap(F.col("a"), F.col("b")).alias("o")).collect()
    assert [x.o for x in r] == [0.5, None]


def test_numbers(spark):
    assert one(spark, "1,234 ml and 275.0 or 0.50", X.numbers) == ["1234", "275", "0.5"]


def test_in_order(spark):
    assert one(spark, "a then b then c", lambda c: X.in_order(c, ["a", "b", "c"]))
    assert not one(spark, "c then b then a", lambda c: X.in_order(c, ["a ", "b", "c"]))
    assert not one(spark, "aa", lambda c: X.in_order(c, ["aa", "a"]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=20), st.lists(st.sampled_from("abcde"), max_size=20))
def test_word_diff_follows_the_whole_table(a, b):
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i, j in ((i, j) for i in reversed(range(n)) for j in reversed(range(m))):
        best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    want, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            want.append(("same", a[i]))
            i, j = i + 1, j + 1
        elif i < n and (j == m or best[i + 1][j] >= best[i][j + 1]):
            want.append(("removed", a[i]))
            i += 1
        else:
            want.append(("added", b[j]))
            j += 1
    assert [(kind, w) for kind, words in X.word_diff(" ".join(a), " ".join(b)) for w in words.split()] == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=8), st.lists(st.sampled_from("abcd"), max_size=8))
def test_word_diff_rebuilds_both_sides(a, b):
    parts = X.word_diff(" ".join(a), " ".join(b))
    assert " ".join(w for k, w in parts if k != "added").split() == a
    assert " ".join(w for k, w in parts if k != "removed").split() == b


def test_units_are_normal_forms():
    from tessera.functions.fixed import UNITS

    folded = [unicodedata.normalize("NFKC", a).casefold() for names in UNITS.values() for a in names]
    assert all(folded)


@pytest.mark.parametrize(
    "text, pool, fault",
    [
        (None, "a 1", "LINE_EMPTY"), ("  ", "", "LINE_EMPTY"), ("20.0 ml", "20ml", "LINE_BARE_VALUE"), ("1/2", "1/2", "LINE_BARE_VALUE"), ("milk 1,200.50 won", "1200.5 won", None),
        ("milk 3 ml", "milk 2 ml", "LINE_INVENTED_NUMBER"), ("milk 2 oz", "milk 2 ml", "LINE_INVENTED_UNIT"), ("우유 2래들을 넣기", "우유 2래들", None), ("milk", None, None), ("② milk", "milk", None),
    ],
)
def test_line_fault(spark, text, pool, fault):
    d = spark.createDataFrame([(text, pool)], "text string, pool string")
    assert d.select(checks.line_fault(F.col("text"), F.col("pool"))).first()[0] == fault


@pytest.mark.parametrize("text, shown", [(None, "o 20"), (" so 20 ", "so 20"), ("so 20 or 21", "o 20"), ("so", "o 20"), ("20" + "x" * 300, "o 20")])
def test_friendly(spark, text, shown):
    d = spark.createDataFrame([(text, "o 20", "20.0")], "text string, o string, v string")
    assert d.select(checks.friendly(F.col("text"), F.col("o"), F.col("v"))).first()[0] == shown


@pytest.mark.parametrize("facts, text, share", [(["A  b", "c"], "a, B; d", 0.5), ([" ", None], "a", None), (["a"], None, 0.0), ([], "a", None)])
def test_fact_coverage(spark, facts, text, share):
    d = spark.createDataFrame([(facts, text)], "f array<string>, t string")
    assert d.select(checks.fact_coverage(F.col("f"), F.col("t"))).first()[0] == share


def test_the_first_number_with_a_fault_decides(spark):
    from tessera.functions.checks import line_fault

    rows = [("시럽 5oz 우유 99ml", "시럽 5ml"), ("우유 99ml 시럽 5oz", "시럽 5ml"), ("시럽 5.0ml", "시럽 5ml"), ("시럽 5", "시럽 5ml"), ("시럽 1/2컵", "시럽 1/2컵을"), ("1,000ml 물", "물 1000 ml"), (None, "x"), ("물", None)]
    got = [r.f for r in spark.createDataFrame(rows, "a string, b string").select(line_fault(F.col("a"), F.col("b")).alias("f")).collect()]
    assert got == ["LINE_INVENTED_UNIT", "LINE_INVENTED_NUMBER", None, None, None, None, "LINE_EMPTY", None]
