"""Secret scans, collocations and source divergence against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations, divergence, ownership

DOC = "doc_id long, text string, lang string, source string, term string, kept string, spans string"


def docs(spark, rows):
    """(doc_id, text, lang, source), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "t", "k", "s") for r in rows], DOC).repartition(3)


LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

# secrets

KEY = "Ab3" * 3 + "xYz9Q7w5E1rT8u"
PEM = "-----BEGIN RSA PRIVATE KEY-----\nMIIabc123\n-----END RSA PRIVATE KEY-----"
JWT = "eyJhbGci.eyJzdWIi.SflKx_w"
SECRETS = [
    (1, None, "en", "s1"),
    (2, "", "en", None),
    (3, 'é PassWord: "abcdefghijkl" and api_key=ABCDEFGHIJKL1234', "en", "s1"),
    (4, "token = abcdefghijk", "en", "s1"),  # eleven characters
    (5, "ſecret=abcdefghijkl toKen=abcdefghijkl", "en", "s2"),  # letters beyond ASCII don't fold
    (6, "AKIAABCDEFGHIJKLMN AKIAABC deadbeefdeadbeef0 DEADBEEFDEADBEEF", "en", "s1"),
    (7, f"{KEY} 😀 {JWT} {PEM}", "en", "s1"),
    (8, f"{KEY}", "de", "s2"),
    (9, f"secret={KEY}", "de", "s1"),
    (10, "secret=passwordpassword token==abcdefghijklm", None, None),
    (11, "token=aaaaaaaaaaaaaaaa", "en", "s4"),
    (12, "word " * 50_000 + "secret=zyxwvutsrqponm", "en", "s5"),
    (3, 'é PassWord: "abcdefghijkl" and api_key=ABCDEFGHIJKL1234', "en", "s1"),
    (None, "AKIAABCDEFGHIJKLMN", "en", "s3"),
    (13, "AKIAABCDEFGHIJKLMN", "fr", "s9"),
]


def plain_secrets(rows, owners=3):
    """By the contract's words, with verdicts counted over a dictionary of values."""
    rules = [(ownership.ASSIGN, 2, 12), (ownership.ACCESS, 0, 18), (ownership.HEX, 0, 16), (ownership.PEM, 0, 1), (ownership.JWT, 0, 1), (ownership.RANDOM, 0, 20)]
    every, spread = [], defaultdict(set)
    for _, text, _, source in rows:
        mine = []
        for k, (pattern, group, least) in enumerate(rules):
            for m in re.finditer(pattern, text or ""):
                v = m[group]
                if len(v) < least or k == 5 and not (len(set(v)) >= 12 and any(c.isdigit() for c in v) and v.upper() != v and v.lower() != v):
                    continue
                if k < 3 or not any(s < m.end() and m.start() < e for j, s, e, _ in mine if j < 3 or j < k):
                    mine.append((k, m.start(), m.end(), v))
        every.append(sorted(mine, key=lambda x: (x[1], x[0])))
        for x in mine:
            spread[x[3]].add(source)
    out = []
    for (doc_id, *_), mine in zip(rows, every, strict=True):
        verdict = lambda v: "example" if len(spread[v]) >= owners else "live" if len(set(v)) >= 6 else "placeholder"
        kept = [x for x in mine if x[0] < 3 or verdict(x[3]) == "live"]
        told = lambda xs: ",".join(f"{ownership.KINDS[k]}:{s}:{e}" for k, s, e, _ in xs)
        n = Counter(x[0] for x in kept)
        out.append((doc_id, n[0], n[1], n[2], hashlib.sha256(told([x for x in kept if x[0] < 3]).encode()).hexdigest(), told(kept), *(sum(verdict(x[3]) == v for x in kept) for v in ("live", "example", "placeholder"))))
    return out


def secrets_of(spark, rows, tmp_path):
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in ownership.query(spark, str(tmp_path)).collect()]


def order(rows):
    return sorted(rows, key=repr)


def test_secrets_against_brute_force(spark, tmp_path):
    got = secrets_of(spark, SECRETS, tmp_path)
    assert order(got) == order(plain_secrets(SECRETS))
    by_id = {r[0]: r for r in got}
    assert by_id[5][1] == 1 and by_id[4][1] == 0 and by_id[6][2:4] == (1, 1)
    assert by_id[7][5].count("random") == 1 and "jwt" in by_id[7][5] and "pem" in by_id[7][5]
    assert by_id[6][7] == 1  # the access key of three owners is an example, and its span stays
    assert by_id[11][8] == 2  # as assign and as hex


def test_random_runs_of_many_owners_are_no_spans(spark, tmp_path):
    rows = [(i, f"see {KEY}", "en", f"s{i}") for i in range(5)]
    assert all(r[5] == "" for r in secrets_of(spark, rows, tmp_path))


def test_secrets_of_an_empty_table(spark, tmp_path):
    assert secrets_of(spark, [], tmp_path) == []


def test_scan_keeps_columns_and_counts_repositories(spark):
    rows = [(1, "AKIAABCDEFGHIJKLMN", "en", "s1"), (2, "AKIAABCDEFGHIJKLMN", "de", "s1"), (3, "AKIAABCDEFGHIJKLMN", "de", "s2")]
    got = ownership.scan(docs(spark, rows), F.col("source"), F.col("lang"), ["doc_id", "kept", "term"])
    assert got.columns == ["doc_id", "kept", "term", "spans"]
    found = [s for r in got.collect() for s in r["spans"]]
    assert {(s.n_owners, s.n_repos, s.verdict) for s in found} == {(2, 3, "live")} and len(found) == 3


# collocations


def plain_phrases(rows, least=30, top=2000):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rated = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * n >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, n in found.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rated.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rated)[:top], 1)]
    return out


def phrase_rows(seed=3):
    rng = random.Random(seed)
    names = ["the", "of", "A", "Ä", "b", "b\x01", "b\x00c", "\x08", "\x0e", "long-word", "'s", " x", "z "]
    text = lambda: "".join(rng.choice(names) + rng.choice([" ", " ", "  ", "\t", " ", ". ", ", ", "\n", ""]) for _ in range(rng.randint(1, 60)))
    rows = [(i, text(), rng.choice(["en", "en", "de", None]), "s") for i in range(150)]
    return rows + [(900, None, "en", "s"), (901, "", None, None), (902, " \t ..", "xx", "s"), (903, "the of a " * 3000, "en", "s"), (0, rows[0][1], rows[0][2], "s")]


def test_phrases_against_brute_force(spark):
    rows = phrase_rows()
    for least, some in ((30, 2), (6, 50)):
        got = [tuple(r) for r in collocations.collocations(docs(spark, rows), least).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
        want = plain_phrases(rows, least)
        assert len(want) > some and sorted(got) == sorted(want)


def test_phrases_of_an_empty_table(spark):
    assert collocations.collocations(docs(spark, [])).count() == 0


def test_top_cuts_by_score_then_phrase(spark):
    rows = [(i, "p q. r s. t u", "en", "s") for i in range(40)]
    got = collocations.collocations(docs(spark, rows), top=2).orderBy("rank").collect()
    assert [(r.rank, r.phrase, r.score) for r in got] == [(1, "p q", 1_000_000), (2, "r s", 1_000_000)]


@pytest.mark.parametrize("chunk", [40, 300, 1 << 20])
def test_chunks_and_hot_words_do_not_change_counts(monkeypatch, chunk):
    """Small chunks cut pieces between words; everything hot deals by all words."""
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    rows = phrase_rows(5)[:80] + [(1, "a b c d e f g " * 40, "en", "s")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[2] or "und" for r in rows]), pa.array([r[1] or "" for r in rows])], ["lang", "text"])
    want = defaultdict(int)
    for lang, _, phrase, a, *_ in plain_phrases(rows, 1, 10**9):
        want[lang, phrase] = a
    every = {"en": {b"the", b"of", b"a"}}
    for hot, pairs in (({}, {}), (every, {}), (every, {"en": {(b"the", b"of"), (b"a", b"a")}})):
        full = np.full(collocations.FILTER_BITS // 64, -1, np.int64).view(np.uint64)  # lets every word pass
        parts = pa.Table.from_batches(list(collocations.suffixes(full, hot, pairs)([batch]))).to_pylist()
        parts.sort(key=lambda r: r["suffix"], reverse=True)
        parts.sort(key=lambda r: r["key"])
        monkeypatch.setattr(collocations, "ROWS", 37)
        again = pa.Table.from_pylist(parts, schema=pa.schema([("key", pa.int64()), ("suffix", pa.binary()), ("n", pa.int64())]))
        got = Counter()
        for b in collocations.counted_prefixes(1)(iter(again.to_batches(max_chunksize=11))):
            for r in b.to_pylist():
                got[r["lang"], r["phrase"]] += r["n"]
        assert {k: got[k] for k in want} == want
        assert sum(got.values()) == sum(max(0, len(re.findall(r"[^\x20\x09]+", p)) - k + 1) for r in rows for p in re.split(r"[.,;:!?\x0A-\x0D]", r[1] or "") for k in (2, 3, 4))


def test_words_of_small_chunks(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 30)
    text = "a b c d e f g h i j k l " * 30
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])
    rows = pa.Table.from_batches(list(collocations.counted_words([batch]))).to_pylist()
    n = Counter()
    for r in rows:
        if r["second"] is None:
            n[r["first"]] += r["n"]
    assert n[None] == 360 and all(n[w] == 30 for w in "abcdefghijkl")


# divergence


def plain_divergence(rows, top=200):
    held, groups = defaultdict(Counter), set()
    docs_of = defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups.add((lang, source))
        held[lang, source].update(found)
        docs_of[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs_of[lang].items() if n >= 3]
        mine = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in mine:
            whole.update({t: held[lang, s][t] for t in kept})

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(held[lang, s]) for s in mine}
        for s in mine:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in mine if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if held[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)]
    return out


def test_divergence_against_brute_force(spark):
    rng = random.Random(9)
    words = ["The", "of", "naïve", "ÄRGER", "x2y", "don't", "日本", "rare", "Zz"]
    rows = [(i, " ".join(rng.choice(words[: 3 + i % 7]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de"]), f"s{rng.randint(0, 5)}") for i in range(120)]
    rows += [(500, None, "en", "empty"), (501, "", "yy", "a"), (502, "once only", "yy", "b"), (503, "the of", None, None), (504, "the of", None, "s1"), (505, "THE", "", "s1"), (506, "1 2 3", "zz", None)]
    rows += [rows[0], (507, "of " * 100_000, "de", "s1")]
    got = [tuple(r) for r in divergence.audit(docs(spark, rows)).collect()]
    assert sorted(got) == sorted(plain_divergence(rows))


def test_divergence_of_an_empty_table_and_large_counts(spark):
    assert divergence.audit(docs(spark, [])).count() == 0
    p = spark.range(1).select(divergence.p_of(F.lit(5 * 10**13), F.lit(10**14), F.lit(10**9)).alias("p")).first().p
    assert p == 1 + 10**9 * (5 * 10**13 + 1) // (10**14 + 10**9)


def test_top_terms_are_cut_by_value_then_term(spark):
    rows = [(i, f"common {w} {w}", "en", f"s{i % 2}") for i, w in enumerate(["aa", "bb", "aa", "bb", "aa", "bb", "cc", "cc", "cc"])]
    got = [tuple(r) for r in divergence.audit(docs(spark, rows), top=1).collect()]
    assert sorted(got) == sorted(plain_divergence(rows, top=1))
