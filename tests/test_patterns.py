"""Lexicon terms against regular expressions, and replacement that can be undone."""

import random
import re

import pytest

from tessera.functions import fixed
from tessera.operators import patterns


def brute_terms(lexicon, text):
    terms = {}
    for alias, term in lexicon:
        if patterns.normal(alias):
            terms.setdefault(patterns.normal(alias), set()).add(term)
    line = patterns.normal(text)
    return {next(iter(t)) for a, t in terms.items() if len(t) == 1 and re.search(r"(?<![가-힣a-z])" + re.escape(a) + f"(?:{'|'.join(fixed.ALIAS_PARTICLES)})?(?![가-힣a-z])", line)}


LEXICON = [("에스프레소", "espresso"), ("Espresso", "espresso"), ("샷", "espresso"), ("cold brew", "cold brew"), ("콜드 브루", "cold brew"), ("brew", "brew"), ("ade", "ade"), ("에이드", "ade"), ("both", "x"), ("both", "y"), ("", "nothing"), ("ｆｕｌｌ", "full"), ("이", "tooth")]
TEXTS = ["에스프레소를 내린다", "ESPRESSO", "espressos", "샷이 두 개", "샷이다", "cold  brew\n", "coldbrew", "콜드\t브루의 맛", "lemonade ade", "éade", "both", "full", None, "", "이가 아프다", "이이", "가이", "brew" * 50_000 + " brew"]


@pytest.mark.parametrize("part", [1, 3, 1000])
def test_lexicon_terms(spark, part):
    texts = spark.createDataFrame(list(enumerate(TEXTS)) + [(0, TEXTS[0])], "id long, text string").repartition(3)
    lexicon = spark.createDataFrame(LEXICON, "alias string, term string")
    got = patterns.lexicon_terms(texts, "id", "text", lexicon, part).collect()
    assert {(r.id, r.term) for r in got} == {(i, term) for i, t in enumerate(TEXTS) for term in brute_terms(LEXICON, t)} and len(got) == len(set(got))
    assert patterns.lexicon_terms(texts.limit(0), "id", "text", lexicon).count() == 0
    assert patterns.lexicon_terms(texts, "id", "text", lexicon.limit(0)).count() == 0


def test_random_texts_match_like_regular_expressions(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab 가은") for _ in range(n))
    lexicon = [(word(rng.randint(1, 5)), f"t{i}") for i in range(60)]
    texts = [word(rng.randint(0, 40)) for _ in range(200)]
    got = patterns.lexicon_terms(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", spark.createDataFrame(lexicon, "alias string, term string")).collect()
    assert {(r.id, r.term) for r in got} == {(i, t) for i, x in enumerate(texts) for t in brute_terms(lexicon, x)}


def test_replacement_can_be_undone(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc [R_") for _ in range(n))
    originals = sorted({w for w in (word(rng.randint(2, 6)) for _ in range(80)) if len(w.strip()) >= 2})
    mapping = [(o, f"[[R_{i:03d}]]") for i, o in enumerate(originals, 1)]
    texts = [(i, word(rng.randint(0, 80))) for i in range(300)] + [(900, None), (901, ""), (902, originals[0] * 40_000)]
    m = spark.createDataFrame(mapping, "original string, token string")
    hidden = patterns.replace_all(spark.createDataFrame(texts, "id long, text string"), "id", "text", m)
    alternation = re.compile("|".join(re.escape(o) for o in sorted(originals, key=len, reverse=True)))
    token = dict(mapping)
    want = {i: None if t is None else alternation.sub(lambda x: token[x[0]], t) for i, t in texts}
    assert {r.id: r.text for r in hidden.collect()} == want
    back = patterns.replace_all(hidden.select("id", "text"), "id", "text", m, restore=True)
    assert {r.id: r.text for r in back.collect()} == dict(texts)
    assert patterns.holds_tokens(spark.createDataFrame([(1, "a [[R_001]]"), (2, "[[R_1]]"), (3, None)], "id long, text string"), "text").count() == 1


@pytest.mark.parametrize("rows", [[("a", "[[R_001]]")], [("ab", "[[R_01]]")], [("ab", "R_001")], [("ab", "[[R_001]]"), ("cd", "[[R_001]]")], [("ab", "[[R_001]]"), ("ab", "[[R_002]]")], [("x [[R_002]]", "[[R_001]]")], [(None, "[[R_001]]")], [("ab", None)]])
def test_mappings_that_cannot_be_undone_are_refused(spark, rows):
    with pytest.raises(ValueError, match="mapping"):
        patterns.checked(spark.createDataFrame(rows, "original string, token string"))
