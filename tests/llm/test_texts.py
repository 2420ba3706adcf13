"""Line dedup, language ID, HTML, URL filters and mixing."""

import datetime
import hashlib
import heapq
import math
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import verify
from tessera.llm import html, language, lines, mixing, urls
from tessera.llm.queries import ORACLES

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "k") for r in rows], DOC).repartition(3)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, sf, name):
    assert verify.differs(spark, verify.views(sf), name, sf) == ""


def test_line_dedup(spark):
    common, rare = "a line on every site", "a line on few sites"
    rows = [(i, f"{common}\nown line number {i}\n{rare if i < 4 else 'short'}\n", "en", f"s{i}") for i in range(12)]
    rows += [(50, None, "en", "s1"), (51, "", "en", None), (52, common, "en", None), (0, rows[0][1], "en", "s0")]
    got = lines.dedup_lines(docs(spark, rows))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "n_lines", "n_removed"]
    found = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert found[0].n_removed == 0 and found[0].text.startswith(common)
    assert found[7].text == "own line number 7\nshort\n" and found[7].n_removed == 1 and found[7].n_chars == len(found[7].text)
    assert found[3].text == f"own line number 3\n{rare}\n"
    assert found[50].text is None and found[51].text == "" and found[52].text == ""
    assert lines.dedup_lines(docs(spark, rows).limit(0)).count() == 0


def test_lines_near_the_threshold_are_counted(spark):
    rows = [(i, "exactly at the threshold" if i < 8 else "just below the threshold", "en", f"s{i % 8 if i < 8 else i % 7}") for i in range(30)]
    got = lines.dedup_lines(docs(spark, rows)).agg(F.sum("n_removed")).first()[0]
    assert got == 7


def brute_phrases(sample, text):
    n = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        n, at = n + 1, end
    return n


def test_phrases_are_longest_matches():
    rng = np.random.default_rng(1)
    word = lambda n: bytes(rng.choice(list(b"abc"), n).tolist())
    samples = {"x": word(60), "y": word(60)}
    parser = language.Parser(samples)
    texts = [word(n) for n in (1, 2, 30, 500)] + [b"", b"zzz"]
    got = parser.phrases(texts)
    assert got[:4].tolist() == [[brute_phrases(samples[n], t) for n in ("x", "y")] for t in texts[:4]]
    assert got[4].tolist() == [0, 0] and got[5].tolist() == [3, 3]


@pytest.mark.parametrize(("rounds", "few"), [(1, 0), (3, 0), (3, 64)])
def test_phrases_run_on_over_lanes(monkeypatch, rounds, few):
    """Texts of many lanes, some of a period that no parse leaves: as one greedy parse of the whole text."""
    monkeypatch.setattr(language, "ROUNDS", rounds)
    monkeypatch.setattr(language, "FEW", few)
    rng = np.random.default_rng(7)
    word = lambda n: bytes(rng.choice(list(b"abc"), n).tolist())
    samples = {"x": word(200), "y": b"abcabcabcabcabcabcabcabcab"}
    texts = [word(n) for n in (511, 512, 513, 1024, 5000)] + [b"abc" * 1500, b"ab" * 1300 + b"q" * 700 + b"abc" * 400, b"", b"c"]
    got = language.Parser(samples).phrases(texts)
    assert got.tolist() == [[brute_phrases(samples[n], t) for n in ("x", "y")] for t in texts]


def test_language_id_accuracy_and_edges(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    parser = language.fit(d)
    got = language.identify(d, parser, ("doc_id", "lang")).withColumn("held", language.held_out(F.col("doc_id"))).filter("held")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()
    odd = docs(spark, [(1, None, None, None), (2, "", "en", "s"), (3, "123 !!", "en", "s"), (4, "the and of that with", None, "s"), (4, "the and of that with", "de", "t"), (5, "the " * 200_000, "en", "s")])
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, parser).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[4][0] == found[5][0] == "en" and 0 <= found[4][1] <= 1
    assert {r.doc_id for r in language.keep_known(odd).collect()} == {4, 5}
    assert language.identify(odd, language.fit(odd.limit(0))).filter("lang_pred <> 'und'").count() == 0
    assert language.keep_known(odd).columns == odd.columns


def test_languages_of_many_scripts_and_unequal_samples(spark):
    rng = np.random.default_rng(18)

    def tongue(letters, n_words):
        return ["".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(n_words)]

    scripts = {"ru": "абвгдежзиклмнопрстуф", "el": "αβγδεζηθικλμνξοπρστυ", "th": "กขคงจฉชซญดตถทธนบปผพ", "zh": "的一是不了人我在有他这中大来上国", "xx": "abcdefgh", "yy": "abcdefgh"}
    words = {k: tongue(v, 300) for k, v in scripts.items()}
    text = lambda k, n: " ".join(rng.choice(words[k], n))
    rows, i = [], 0
    for k in scripts:
        for _ in range(1 if k == "xx" else 40):  # xx has one short labelled text, yy, of the same letters, many
            i += 1
            while language_held(i):
                i += 1
            rows.append((i, text(k, 120 if k == "xx" else 200), k, "s"))
    parser = language.fit(docs(spark, rows))
    asked = [text(k, 60) for k in scripts for _ in range(20)]
    names, scores, _ = language.predict(parser, asked)
    want = [k for k in scripts for _ in range(20)]
    assert sum(a == b for a, b in zip(names, want, strict=True)) >= 0.97 * len(want) and all(0 <= s <= 1 for s in scores)


def test_texts_in_a_script_nobody_labelled_stay(spark):
    """Of any size: kept as und, never under the label of another language."""
    learned = {"en": "the house and the garden are near the old river where they were often seen ", "de": "das haus und der garten sind nahe am alten fluss wo sie oft gesehen wurden "}
    rows = [(2 * i + j, t * 8, lang, "s") for i in range(30) for j, (lang, t) in enumerate(learned.items())]
    chinese = "的一是不了人我在有他这中大来上国的一是不了人我在有他这中大来上国大来上国"
    a, b, c, d, e, f = [i for i in range(1000, 1100) if language_held(i)][:6]  # labels of these aren't learned from
    odd = [(a, chinese, None, "s"), (b, chinese[:20], None, "s"), (c, chinese[:1], "en", "s"), (d, "ሀሁሂሃሄህሆለሉሊላሌልሎ " * 5, "en", "s"), (e, "the old garden", None, "s"), (f, "12 - 34", "en", "s")]
    kept = {r.doc_id: r.lang for r in language.keep_known(docs(spark, rows + odd)).collect()}
    assert [kept.get(i) for i in (a, b, c, d, e, f)] == ["und", "und", "und", "und", "en", None]
    assert all(kept[i] == lang for i, _, lang, _ in rows)


def language_held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


PAGE = """<!DOCTYPE html><head><title>t</title><script>var a="</p>";</script></head><body><header>Site</header><nav><a href=x>Menu</a></nav>
<div class="cookie-banner">We use cookies</div><article><h1>Head &amp; more</h1><p>one <b>two</b>&nbsp;&eacute;
 three<p>four<br>five<div class="comments"><p>nice</p></div><aside>side</aside><form>f<input></form></article><footer>foot</footer>"""


def test_main_text_of_a_page(spark):
    rows = [(1, "https://a.example/x", PAGE), (1, "https://a.example/x", PAGE), (2, None, None), (3, "https://a.example/y", ""), (4, "https://b.example", "plain & simple <i>text</i>"), (5, "https://a.example/z", "<nav>only menu")]
    p = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string").repartition(2)
    got = {r.page_id: r for r in html.extract(p).collect()}
    assert got[1].text == "Head & more\none two é three\nfour five" and got[1].n_chars == len(got[1].text)
    assert [got[i].text for i in (2, 3, 4, 5)] == ["", "", "plain & simple text", ""]
    assert html.extract(p).count() == len(rows) and html.extract(p.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="layout with-sidebar"><main><article>A<p>b</article></main></div>', "A\nb"),
        ("<form id=aspnet><div class='menu'>m</div><main>x<article>A</article></main></form>", "A"),
        ('<div id="page-header-fixed"><article>A</article></div>', "A"),
        ('<article>A</article><div id="comments"><article class="comment-body">c</article></div>', "A"),
        ('<main>A<div id="comments"><article>c</article></div></main>', "A"),
        ("<aside><article>teaser</article></aside><article class='post with-sidebar'>A</article>", "A"),
        ('<html><head><title>t<meta x=">">A', "tA"),
        ("<head><meta charset=x><p>one<p>two", "one\ntwo"),
        ("<p>1 < 2 and 3 > 2 <b", "1 < 2 and 3 > 2 <b"),
        ('<p title="a>b">A<p class=ad>no<p>B', "A\nB"),
        ("<svg><p>A", "A"),
        ("<script>x<p>A", ""),
        ("<article><p hidden>h</p><p>A</p><header><h1>T</h1></header></article>", "A\nT"),
        ('<p title="x>A</p><p>B</p>', "A\nB"),
    ],
)
def test_containers_and_broken_markup(page, text):
    (got,) = html.main_texts([tuple(map(list, zip(*html.blocks_of(page), strict=True))) or ([], [])])
    assert got == text


@pytest.mark.parametrize("part", ['<a "', "<a '", "<a x=", "<", "<!", "<!--", "<svg>", "<title>", "</x>", "<div>", "<p class=ad>", "&amp;", '<div class="', "a "])
def test_hostile_pages_take_linear_time(part):
    page = "<article>text" + part * (1_000_000 // len(part))
    begun = time.process_time()
    html.blocks_of(page)
    assert time.process_time() - begun < 3


def test_pages_that_share_an_id_and_a_host_of_many(spark):
    menu = "<div>home news sport weather contact about imprint help</div>"
    story = lambda i: f"story number {i} tells of thing {i * 7} in many words"
    pages = [(None if i % 2 else 7, "https://c.example/", f"{menu}<p>{story(i)}</p>", 1, "h", "r") for i in range(200)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string, shard int, host string, row string")
    got = html.extract(d, shard_pages=50).collect()
    assert sorted(r.text for r in got) == sorted(map(story, range(200)))


def test_repeated_runs_of_a_host_go_where_structure_is_open(spark):
    menu = "<div>home news sport weather contact about imprint help</div>"
    pages = [(i, "https://c.example/", f"{menu}<p>story number {i} tells of thing {i * 7} in many words</p>") for i in range(12)]
    got = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"story number {i} tells of thing {i * 7} in many words" for i in range(12)}


def test_covered_against_brute_force():
    rng = np.random.default_rng(2)
    streams = [rng.integers(0, 3, n) for n in (0, 5, 40, 60, 80, 30, 30)]
    n = html.MIN_TOKENS
    grams = {}
    for i, s in enumerate(streams):
        for k in range(len(s) - n + 1):
            grams.setdefault(tuple(s[k : k + n]), set()).add(i)
    for s, got in zip(streams, html.covered(streams, len(streams)), strict=True):
        want = np.zeros(len(s), bool)
        for k in range(len(s) - n + 1):
            if len(grams[tuple(s[k : k + n])]) >= 3:
                want[k : k + n] = True
        assert (want == got).all()


def day(s):
    return datetime.date.fromisoformat(s)


ENTRIES = [(day("2024-01-10"), "domain", "bad.example", "block"), (day("2024-02-01"), "domain", "bad.example", "remove"), (day("2024-01-10"), "prefix", "bad.example/ok", "allow"), (day("2024-01-01"), "domain", "example", "block"), (None, "domain", "x", "block"), (day("2024-01-01"), "domain", None, "block")]


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_url_filter_by_day(spark, broadcast_rows):
    asked = [(1, "http://WWW.Bad.example:80/x", "2024-01-09"), (2, "http://www.bad.example/x", "2024-01-10"), (3, "https://bad.example/ok/y?z", "2024-01-31"), (4, "https://bad.example./x", "2024-02-01"), (5, "https://other.net/", "2024-01-15"), (6, None, "2024-01-15"), (7, "nonsense", "2024-01-15"), (8, "http://bad.example/okay", None), (2, "http://www.bad.example/x", "2024-01-10")]
    caps = spark.createDataFrame([(i, u, day(d) if d else None, "k") for i, u, d in asked], "capture_id long, url string, fetched date, key string")
    listed = spark.createDataFrame(ENTRIES, "entry_date date, kind string, key string, action string")
    got = urls.filter_urls(caps, listed, broadcast_rows, salt_rows=2)
    found = {r.capture_id: (r.blocked, r.rule, r.n_active) for r in got.collect()}
    assert found == {1: (True, "example", 1), 2: (True, "bad.example", 2), 3: (False, "bad.example/ok", 3), 4: (True, "example", 1), 5: (False, None, 0), 6: (False, None, 0), 7: (False, None, 0), 8: (False, None, 0)}
    assert got.count() == len(asked)
    assert urls.filter_urls(caps.limit(0), listed).count() == 0 and urls.filter_urls(caps, listed.limit(0)).filter("blocked").count() == 0


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_url_prefixes_of_any_depth(spark, broadcast_rows):
    listed = [("deep.example/a/b/c/d/e/f", "block"), ("deep.example/a/b", "allow"), ("deep.example/a/b/c/d/e/f/g/h/i", "allow")]
    entries = spark.createDataFrame([(day("2024-01-01"), "prefix", k, a) for k, a in listed], "entry_date date, kind string, key string, action string")
    asked = [(1, "a/b/c/d/e"), (2, "a/b/c/d/e/f"), (3, "a//b/c/d/e/f/g?q"), (4, "a/b/c/d/e/f/g/h/i/j"), (5, "a"), (6, "")]
    caps = spark.createDataFrame([(i, f"https://deep.example/{p}", day("2024-02-01")) for i, p in asked], "capture_id long, url string, fetched date")
    found = {r.capture_id: (r.blocked, r.rule, r.n_active) for r in urls.filter_urls(caps, entries, broadcast_rows, salt_rows=2).collect()}
    a, b, c = (k for k, _ in listed)
    assert found == {1: (False, b, 1), 2: (True, a, 2), 3: (True, a, 2), 4: (False, c, 3), 5: (False, None, 0), 6: (False, None, 0)}


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_url_list_keys_in_other_forms(spark, broadcast_rows):
    listed = [("prefix", "a.com/x/"), ("domain", "Example.com"), ("domain", ".münchen.de"), ("domain", "*.wild.org."), ("prefix", "HTTPS://user@Deep.net:443//p//q/?z"), ("prefix", "whole.net/"), ("domain", "path.net/only"), ("domain", "[2001:DB8::1]"), ("domain", "..."), ("prefix", "/x"), ("domain", "EXAMPLE.com.")]
    entries = spark.createDataFrame([(day("2024-01-01"), k, n, "block") for k, n in listed], "entry_date date, kind string, key string, action string")
    asked = {"http://a.com/x": "a.com/x", "http://a.com/x/y": "a.com/x", "http://a.com/xy": None, "http://www.example.com/": "example.com", "http://www.MÜNCHEN.de/": "münchen.de", "http://b.wild.org": "wild.org", "http://deep.net/p/q": "deep.net/p/q", "http://deep.net/P/q": None,
             "http://whole.net": "whole.net", "http://sub.whole.net": None, "http://path.net/only": None, "http://[2001:db8::1]:80/a": "[2001:db8::1]", "http://[2001:db8::2]/a": None}
    caps = spark.createDataFrame([(i, u, day("2024-02-01")) for i, u in enumerate(asked)], "capture_id long, url string, fetched date")
    found = {r.url: (r.blocked, r.rule, r.n_active) for r in urls.filter_urls(caps, entries, broadcast_rows, salt_rows=2).collect()}
    assert found == {u: (rule is not None, rule, int(rule is not None)) for u, rule in asked.items()}


def test_url_filter_by_brute_force(spark):
    rng = np.random.default_rng(17)
    keys = ["a.example", "example", "b.example", "a.example/x", "a.example/x/y"]
    entries = [(day("2024-01-01") + datetime.timedelta(int(rng.integers(0, 60))), "prefix" if "/" in k else "domain", k, str(rng.choice(["block", "allow", "remove"]))) for k in keys for _ in range(6)]
    asked = [(i, f"http://{rng.choice(['a.example', 'b.example', 'c.example'])}/{rng.choice(['', 'x', 'x/y', 'x/yz'])}", day("2024-01-01") + datetime.timedelta(int(rng.integers(-3, 70)))) for i in range(300)]
    held = {}
    for d, kind, key, action in entries:
        held[kind, key, d] = max(action, held.get((kind, key, d), ""))
    want = {}
    for i, url, d in asked:
        at = url[7:]
        best = None
        for kind, key in {(k, n) for k, n, _ in held}:
            past = [(x, a) for (k, n, x), a in held.items() if (k, n) == (kind, key) and x <= d]
            match = at.split("/")[0] == key or at.split("/")[0].endswith("." + key) if kind == "domain" else (at.rstrip("/") + "/").startswith(key + "/")
            if match and past and max(past)[1] != "remove":
                best = max(best or (0, "", ""), (len(key), key, max(past)[1]))
        want[i] = (best is not None and best[2] == "block", best and best[1])
    listed = spark.createDataFrame(entries, "entry_date date, kind string, key string, action string")
    caps = spark.createDataFrame(asked, "capture_id long, url string, fetched date")
    for broadcast_rows in (100_000, 0):
        assert {r.capture_id: (r.blocked, r.rule) for r in urls.filter_urls(caps, listed, broadcast_rows, salt_rows=20).collect()} == want


def test_columns_that_clash(spark):
    """Other columns, whatever their names, are kept or ignored by operators that read documents."""
    names = "doc_id,text,lang,source,n_chars,_id,_drop,_hash,_text_hash,_judged,_size,_copies,_c,lang_pred,score,key,gone,row,kept,cell,before,target,taken,size,words,shuffled,source_key,n_lines,n_removed,part,a.b".split(",")
    rows = [(i, f"{'the line that all of the sites have' if i < 9 else ''}\nthe words of document {i} and some more of them", "en", f"s{i}", 1, *range(len(names) - 5)) for i in range(10)]
    d = spark.createDataFrame(rows, names)
    assert language.keep_known(d).columns == names and language.keep_known(d).count() == 10
    got = lines.dedup_lines(d)
    assert got.columns == [n for n in names if n not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"] and got.agg(F.sum("n_removed")).first()[0] == 8
    assert mixing.mix(d).columns == names and mixing.allocate(d).count() == 10
    first = mixing.mix(d).filter("doc_id = 3").first()
    assert list(first)[5:] == list(rows[3])[5:]


def simulated(rows, weights=(5, 2, 1), share=1.5):
    """(doc_id, size, source_size, target, taken) by water filling and by serving a heap of queues, packet after packet."""
    sizes, queues = {}, {}
    for i, t, _, source in rows:
        size = len((t or "").split())
        sizes[source] = sizes.get(source, 0) + size
        shuffled = hashlib.md5(f"{'null' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
        queues.setdefault(source, []).append((shuffled, size, i))
    budget, total = share * sum(sizes.values()), math.floor(share * sum(sizes.values()) + 0.5)
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if 2 * sizes[s] <= level * weight[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= set(full)
    heap, out = [], {}
    for s, q in queues.items():
        q.sort(key=lambda x: x[:2])
        at = 0
        for copy in range(2):
            for k, (_, size, i) in enumerate(q):
                out.setdefault((s, k), [i, size, sizes[s], target[s], 0])
                n = min(size, 1024) if at < target[s] < at + size else 1
                for p in range(1, n + 1):
                    end, words = at + size * p // n, size * p // n - size * (p - 1) // n
                    if words:
                        heap.append((end / target[s], "null" if s is None else f"={s}", end, words, (s, k)))
                at += size
    heapq.heapify(heap)
    while heap and total:
        *_, words, doc = heapq.heappop(heap)
        words = min(words, total)
        out[doc][4] += words
        total -= words
    return sorted(map(tuple, out.values()), key=str)


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), "en", None if i % 9 == 0 else f"s{min(i % 7, 4)}") for i in range(400)] + [(400, None, "en", "s1"), (401, "w " * 3000, "en", "s2")]
    d = docs(spark, rows)
    got = mixing.allocate(d).collect()
    total = sum(len((r[1] or "").split()) for r in rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert sum(t for _, t in by) == pytest.approx(1.5 * total) and all(t <= 2 * s + 1e-9 for s, t in by)
    assert sum(r.taken for r in got) == math.floor(1.5 * total + 0.5)
    assert all(abs(sum(v) - t) <= 8 for (_, t), v in by.items())
    want = simulated(rows)
    assert [r[:3] + r[4:] for r in want] == sorted(((r.doc_id, r.size, r.source_size, r.taken) for r in got), key=lambda r: str((r[0], r[1], r[2], next(w[3] for w in want if w[0] == r[0]), r[3])))
    assert sorted(map(tuple, mixing.allocate(d.repartition(1)).collect())) == sorted(map(tuple, got))
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == {r.doc_id: r.taken for r in got if r.taken}
    assert mixing.allocate(d.limit(0)).count() == 0 and mixing.mix(d.limit(0)).count() == 0
    assert {r.taken for r in mixing.allocate(docs(spark, [(1, None, None, None), (2, "", "en", "s")])).collect()} == {0}


def test_mixing_of_texts_that_share_a_doc_id(spark):
    rows = [(None, "a a a", "en", "s"), (None, "b b b", "en", "s"), (None, "c c c", "en", "s"), (3, "d d", "en", "t"), (3, "e e", "en", "t"), (3, "e e", "en", "t"), (3, None, "en", "t")]
    d = docs(spark, rows)
    assert sorted((str((r.doc_id, r.size, r.taken)) for r in mixing.allocate(d).collect())) == sorted(str((w[0], w[1], w[4])) for w in simulated(rows))
    texts = [r.text for r in mixing.mix(d).collect()]
    assert {t[0] for t in texts} == {"a", "b", "c", "d", "e"} and sum(len(t.split()) for t in texts) == math.floor(1.5 * 15 + 0.5)


@pytest.mark.parametrize("shard_share", [html.SHARD_SHARE, html.PAGE_SHARE])
def test_coverage_counts_all_pages_of_a_host(spark, monkeypatch, shard_share):
    """Shares and thresholds are of the host, not of one of its shards: some sentences are on just under, others on just enough of the pages."""
    monkeypatch.setattr(html, "SHARD_SHARE", shard_share)
    said = lambda k: " ".join(f"s{k}w{j}" for j in range(9))
    shares = [20, 28, 29, 30, 31, 35, 60]
    rows = [(i, "http://a.example/x", "".join(f"<p>{said(k)}</p>" for k, share in enumerate(shares) if (i * 37 + k * 11) % 100 < share) + f"<p>only {i}</p>") for i in range(100)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(d, shard_pages=12).collect()}
    assert got == {i: "\n".join([said(k) for k, share in enumerate(shares) if share < 30 and (i * 37 + k * 11) % 100 < share] + [f"only {i}"]) for i in range(100)}
    assert got == {r.page_id: r.text for r in html.extract(d, shard_pages=1000).collect()}
