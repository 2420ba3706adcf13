"""Facts against cards: rules by example, and the distributed search against judging every pair."""

import random

import pytest

from tessera.functions.scoring import VERDICTS, judge, scope, words
from tessera.operators.scoring import score_facts


def verdict(subject, value, *cards, variant=None):
    return VERDICTS[max((judge(subject, value, variant, t, c)[0] for t, c in cards), default=0)]


@pytest.mark.parametrize(
    ("subject", "value", "variant", "cards", "want"),
    [
        ("카페라떼", "275ml", "HOT", [("카페라떼(HOT)", "스팀우유 275ml 를 넣습니다")], "COVERED"),
        ("카페라떼", "275ml", "HOT", [("카페라떼(HOT)", "스팀우유 270ml")], "PARTIAL"),
        ("카페라떼", "275ml", "HOT", [("아이스 카페라떼", "우유 275ml")], "PARTIAL"),
        ("카페라떼", "275ml", "HOT", [("카페라떼", "스팀우유 275ml")], "PARTIAL"),
        ("카페라떼", "275ml", None, [("카페라떼", "우유를 스팀합니다"), ("우유 보관", "275ml 단위로 소분")], "PARTIAL"),
        ("카페라떼", "275ml", None, [("쓰레기 배출", "매일 밤 10시에 버립니다")], "MISSING"),
        ("카페라떼", "275ml", None, [], "MISSING"),
        ("카페라떼", "추출 스팀 컵 샷 투입", None, [("카페라떼 제조", "추출 후 스팀하고 컵에 샷 투입")], "COVERED"),
        ("배수구", "한 스푼", None, [("배수구 청소", "배수구 막힘을 예방하기 위해 약품 한 스푼을 넣고 물을 흘려보냅니다.")], "COVERED"),
        ("아메리카노", "얼음 물 샷 순서", None, [("아메리카노 제조 순서", "아메리카노는 얼음, 물, 샷 순서로 담아 제조한다.")], "COVERED"),
        ("포터필터", "중성세제", None, [("부품 세척", "포타필터 홈은 중성세제를 묻혀 닦아줍니다.")], "COVERED"),
        ("우유", "3일", None, [("우유", "우유는 3일 보관. 5일 지나면 버린다")], "COVERED"),
        ("우유", "3일", None, [("우유", "우유는 3일이며 우유는 5일")], "UNDETERMINED"),
        ("우유", "3일", None, [("우유", "우유는 3분 보관")], "UNDETERMINED"),
        ("우유", "냉장 보관", None, [("우유", "우유는 냉장 보관이 아니라 냉동 보관")], "UNDETERMINED"),
        ("milk", "keep cold", None, [("", "Keep milk cold. Do not freeze")], "UNDETERMINED"),
        ("milk", "one two three four five", None, [("", "milk one two three")], "UNDETERMINED"),
        ("milk", "one two three four five", None, [("", "milk one two")], "PARTIAL"),
        ("", "x", None, [("x", "x")], "MISSING"),
        ("x", None, None, [("x", None)], "PARTIAL"),
    ],
)
def test_verdicts(subject, value, variant, cards, want):
    assert verdict(subject, value, *cards, variant=variant) == want


def test_scope_takes_the_clause_after_if_it_has_no_digit():
    assert scope("milk", "Milk is cold. Keep it so. Tea 3. milk 2.5 l; 4 cups") == ["Milk is cold", " Keep it so", " milk 2.5 l"]


def brute(facts, cards):
    out = []
    for fact_id, subject, value, variant, *_ in facts:
        best = (0, True, None)
        for card_id, title, content in cards:
            rank, held, _ = judge(subject or "", value, variant, title, content)
            if rank:
                best = min(best, (-rank, not held, card_id)) if best[0] else (-rank, not held, card_id)
        out.append((fact_id, VERDICTS[-best[0]], best[2], bool(best[0]) and not best[1]))
    return out


@pytest.mark.parametrize("part", [3, 1000])
def test_search_equals_judging_every_pair(spark, part):
    rng = random.Random(8)
    names = ["latte", "matcha", "mocha", "lattes", "cold brew", "물", "샷을", "우유는", "2.5", "30분", "275ml", "not", "tea", "Latta"]
    text = lambda n: "".join(rng.choice(names) + rng.choice([" ", " ", ", ", ". ", "; ", "\n"]) for _ in range(rng.randint(0, n)))
    cards = [(i, rng.choice([None, "", "latte", "tea"]), text(25)) for i in range(60)] + [(99, None, None), (98, "x", "latte " * 30_000)]
    facts = [(i, rng.choice(["latte", "Cold Brew", "mocha", "물", "absent thing", "matche", "", None]), text(4), rng.choice([None, None, "HOT"]), "extra") for i in range(70)] + [(200, "tea", None, None, "")]
    f = spark.createDataFrame(facts, "fact_id long, subject string, value string, variant string, rank string").repartition(3)
    c = spark.createDataFrame([(*r, "k") for r in cards], "card_id long, title string, content string, key string").repartition(3)
    got = [tuple(r) for r in score_facts(f, c, part).collect()]
    assert sorted(got) == sorted(brute(facts, cards))
    assert len({g[1] for g in got}) == 4
    assert score_facts(f, c.limit(0)).filter("verdict <> 'MISSING'").count() == 0 and score_facts(f.limit(0), c).count() == 0


def test_words():
    assert words("Ab-1 é 가나!") == ["ab", "1", "가나"]
