"""SimHash, embeddings, suffixes, components and the pipeline."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import embeddings, graph, simhash, suffixes


def union_find(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = np.random.default_rng(5)
    n = 300
    pairs = {"chain": [(i, i + 1) for i in range(n - 1)], "star": [(150, i) for i in range(0, n, 2) if i != 150], "random": [tuple(map(int, rng.integers(0, n, 2))) for _ in range(200)]}[shape]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    assert [got.get(i, i) for i in range(n)] == union_find(n, pairs)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    runs = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "A", "a B", "a b c", "a b c D", "é É \x1c x y \x0b z", "the same the same the same the same", "w " * 700])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == [plain_fingerprint(text)]


@pytest.mark.parametrize(("words", "radius"), [(1, 0), (1, 1), (1, 3), (2, 12), (4, 44)])
def test_bit_sliced_distances(words, radius):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.integers(0, 1 << 63, (5, words), dtype="u8"), 30, 0)
    for r in x:
        for k in rng.choice(64 * words, rng.integers(0, radius + 3), replace=False):
            r[k // 64] ^= np.uint64(1 << int(k % 64))
    d = np.bitwise_count(x[:, None, :] ^ x[None, :, :]).sum(2)
    q, f = simhash.within(x, x, radius)
    assert set(zip(q.tolist(), f.tolist(), strict=True)) == set(zip(*(v.tolist() for v in np.nonzero(d <= radius)), strict=True))


@pytest.mark.parametrize("cell", [1024, 8])
def test_simhash_links_against_brute_force(spark, cell):
    rng = np.random.default_rng(7)
    fp = np.repeat(rng.integers(0, 1 << 63, 40, dtype="u8"), 12)
    for i in range(len(fp)):
        for k in rng.choice(64, rng.integers(0, 4), replace=False):
            fp[i] ^= np.uint64(1 << int(k))
    prints = spark.createDataFrame(list(enumerate(fp.view("i8").tolist())), "doc_id long, f0 long").repartition(4)
    got = prints.join(simhash.classes(prints, simhash.block_masks(), 3, cell), "f0").select("doc_id", "component_id").collect()
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(union_find(len(fp), zip(*(v.tolist() for v in np.nonzero(near)), strict=True))))


def near_docs(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(3, 8)))
    base = [word() for _ in range(400)]
    rows = [(i, " ".join(base[:k] + [word()] + base[k + 1 :])) for i, k in enumerate(range(5, 400, 13))]
    other = [(100 + i, " ".join(word() for _ in range(300))) for i in range(20)]
    return rows, other, spark.createDataFrame([*((*r, "a") for r in rows + other), (200, None, "a"), (201, "", "a"), (202, rows[0][1], "a"), (202, rows[0][1], "a"), (None, "x", "a")], "doc_id long, text string, component_id string").repartition(3)


def test_similar_documents(spark):
    rows, other, d = near_docs(spark)
    got = {r.doc_id: r.component_id for r in simhash.similar(d.drop("component_id")).collect()}
    assert {got[i] for i, _ in rows} == {0} and all(got[i] == i for i, _ in other) and got[200] == got[201] == 200 and got[202] == 0
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 0, *[i for i, _ in other], 200]
    assert simhash.keep_one(d.limit(0)).count() == 0


def test_texts_that_share_a_doc_id_are_told_apart(spark):
    rng = np.random.default_rng(16)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 7)) for _ in range(n))
    a, b, c, e = (text(100) for _ in range(4))
    rows = [(5, a), (5, b), (6, b), (None, a), (None, c), (None, c), (7, c + " more"), (None, e), (None, e + " end"), (None, ""), (8, None), (5, a)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, `s0.x` int").repartition(3)
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(map(str, found)) == sorted(map(str, [(5, a), (5, b), (7, c + " more"), (8, None), *[f for f in found if f[0] is None]]))
    assert [t.removesuffix(" end") for i, t in found if i is None] == [e]


def shingles_of(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_similar(rows):
    sets = [shingles_of(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    return {rows[i][0]: rows[r][0] for i, r in enumerate(union_find(len(rows), near))}


@pytest.mark.parametrize(("cell", "part"), [(1024, 512), (8, 4)])
def test_similar_pairs_about_the_limit_against_brute_force(spark, cell, part):
    """Pairs of similarity 0.70 to 0.90, sets of a few shingles, and a family whose members are near the limit to each other."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 7))
    rows = []
    for k in range(160):
        n = int(rng.integers(8, 14)) if k % 4 == 0 else 204
        base = [word() for _ in range(n)]
        copy = base[: n - 1 - int(rng.integers(0, 3))] if k % 4 == 0 else base[: int((n - 4) * (0.70 + 0.2 * k / 160)) + 4]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    base = [word() for _ in range(104)]
    rows += [(1000 + i, " ".join(base[:k] + [word()] * 9 + base[k + 9 :])) for i, k in enumerate(rng.integers(0, 95, 40).tolist())]
    want = brute_similar(rows)
    linked = sum(want[2 * k + 1] == 2 * k for k in range(160))
    assert 60 < linked < 120
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), cell=cell, part=part).collect()}
    assert got == want


def test_repeats_of_a_shingle_do_not_count(spark):
    """A line repeated 60 times neither parts texts of similar sets nor links texts that share nothing else."""
    rng = np.random.default_rng(13)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 7)) for _ in range(n))
    line, same = text(14), text(200)
    rows = [(0, f"{same} {line}"), (1, f"{same} " + f"{line} " * 60), (2, f"{text(200)} " + f"{line} " * 60), (3, f"{text(200)} " + f"{line} " * 60)]
    assert brute_similar(rows) == {0: 0, 1: 0, 2: 2, 3: 3}
    assert {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_bands_meet_at_the_limit():
    """Pairs at similarity 0.8 share a band as often as the docstring says; unlike sets don't."""
    rng = np.random.default_rng(12)
    met = []
    for n in [4, 40, 400] * 20:
        h = rng.integers(0, 1 << 63, n * 5 // 4, dtype="u8")
        met.append(int((simhash.bands_of(h) == simhash.bands_of(h[:n])).sum()))
        assert not (simhash.bands_of(h) == simhash.bands_of(h + np.uint64(1))).any()
    assert min(met) > 0 and 7 < np.mean(met) < 12


def test_simhash_query_edges(spark):
    _, _, d = near_docs(spark)
    rows = simhash.near_duplicates(d.drop("component_id")).collect()
    assert len(rows) == d.count() and all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in rows)
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {200}
    assert simhash.near_duplicates(d.drop("component_id").limit(0)).count() == 0


@pytest.mark.parametrize(("per_cell", "part"), [(500, 2048), (20, 16), (5, 2048)])
def test_embedding_links_against_brute_force(spark, per_cell, part):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(30, 8))
    x = np.repeat(base, 10, 0) + rng.normal(size=(300, 8)) * 0.05
    x[:20] = x[0]
    label = [None if i % 50 == 3 else int(i % 2) for i in range(300)]
    rows = [(i, v.tolist(), y) for i, (v, y) in enumerate(zip(x, label, strict=True))]
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0] * 5]
    rows += [(300 + i, v, 0) for i, v in enumerate(odd)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, dim int").repartition(4)
    got = {r.vec_id: r for r in embeddings.near_duplicates(d, per_cell=per_cell, part=part).collect()}
    u = embeddings.unit(x)
    hit = (u @ u.T >= 0.98) & np.array([[a is not None and a == b for b in label] for a in label])
    np.fill_diagonal(hit, False)
    roots = union_find(300, zip(*(v.tolist() for v in np.nonzero(hit)), strict=True))
    for i in range(300):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (int(hit[i].sum()), roots[i], roots[i] == i)
    assert all((got[300 + i].n_links, got[300 + i].component_id, got[300 + i].kept) == (0, 300 + i, True) for i in range(len(odd)))
    assert embeddings.near_duplicates(d.limit(0)).count() == 0


def test_cells_at_every_size(spark, sf):
    """Each label is split, a large group of near copies stays together, and a vector goes to few of many cells."""
    rng = np.random.default_rng(19)
    base = rng.normal(size=(400, 16))
    far = [(i, v.tolist(), 0) for i, v in enumerate(np.repeat(base, 5, 0) + rng.normal(size=(2000, 16)) * 0.02)]
    ball = [(5000 + i, (base[0] + v).tolist(), 1) for i, v in enumerate(rng.normal(size=(1500, 16)) * 0.02)]
    d = spark.createDataFrame(far + ball, "first long, embedding array<double>, label long").selectExpr("label", "16 AS dim", "first", "1L AS n", "embedding").repartition(4)
    cells = {r.label: r for r in embeddings.placed(d, 0.98, 40).groupBy("label").agg(F.count_distinct("cell").alias("cells"), F.count("*").alias("rows"), F.sum(F.col("owner").cast("int")).alias("owners")).collect()}
    assert cells[0].cells > 30 and cells[0].owners == 2000 and cells[0].rows < 16000
    assert 2 <= cells[1].cells < 16 and cells[1].owners == 1500 and cells[1].rows < 16000
    small = spark.read.parquet(f"{sf}/embeddings.parquet").filter("label IS NOT NULL").selectExpr("cast(label AS long) AS label", "size(embedding) AS dim", "vec_id AS first", "1L AS n", "embedding")
    assert embeddings.placed(small, 0.98, 500).groupBy("label").agg(F.count_distinct("cell").alias("cells")).filter("cells < 2").count() <= small.groupBy("label").count().filter("count < 2").count()


def test_embeddings_that_share_an_id(spark):
    d = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (None, [0.0, 1.0], 1), (4, [-1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted((str(tuple(r)) for r in embeddings.near_duplicates(d).collect()))
    assert got == sorted(map(str, [(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 1, None, True), (None, 1, None, True), (4, 0, 4, True)]))


def removed(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of each row, sorted; a null doc_id is the largest."""
    order = lambda d: float("inf") if d is None else d
    first, out = {}, []
    raws = [(d, (t or "").encode()) for d, t in rows]
    for d, r in raws:
        for i in range(len(r) - 49):
            first[r[i : i + 50]] = min(order(d), first.get(r[i : i + 50], order(d)))
    for d, r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - 49):
            if first[r[i : i + 50]] < order(d):
                gone[i : i + 50] = True
        left = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((d, len(r), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n=80):
    rng = np.random.default_rng(seed)
    text = lambda k, letters="abc ": "".join(rng.choice(list(letters), k))
    shared = [text(int(k), "abcdefghij ") for k in (49, 50, 51, 64, 120, 400)]
    rows = []
    for i in range(n):
        parts = [text(int(rng.integers(0, 120)), "klmnop ")]
        for _ in range(int(rng.integers(0, 4))):
            s = shared[int(rng.integers(0, len(shared)))]
            cut = int(rng.integers(0, 20))
            parts += [s[cut:] if rng.random() < 0.5 else s, text(int(rng.integers(0, 30)), "qrstuv")]
        rows.append((i, "".join(parts)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "x" * 300), (n + 3, "x" * 120), (n + 4, "é" * 60), (n + 5, "é" * 60), (n + 6, rows[3][1]), (n + 7, "ab" * 200_000)]


def check_removed(spark, rows):
    d = spark.createDataFrame([(*r, 1, b"x", 5, "t") for r in rows], "doc_id long, text string, s int, kept binary, key int, g string").repartition(4)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(d).collect()]
    assert sorted(got, key=str) == removed(rows)


@pytest.mark.parametrize(("hot", "crowd"), [(2000, 4096), (3, 4096), (2000, 1)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, hot, crowd):
    monkeypatch.setattr(suffixes, "HOT_DOCS", hot)
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    if hot == 3:
        monkeypatch.setattr(suffixes, "SAMPLE_DOCS", 10**6)
    check_removed(spark, passages(hot))


def test_suffix_dedup_edges(spark):
    same = "the same long passage of words that is over fifty bytes"
    d = spark.createDataFrame([(5, same), (5, same), (None, same), (9, same)], "doc_id long, text string")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_removed) for r in suffixes.remove_repeats(d).collect())
    assert got == [(-1, len(same)), (5, 0), (5, 0), (9, len(same))]
    assert suffixes.remove_repeats(d.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [4096, 1])
def test_suffix_dedup_texts_that_share_a_doc_id(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    rng = np.random.default_rng(14)
    text = lambda k: "".join(rng.choice(list("abcdefgh "), k))
    shared, other = text(80), text(90)
    rows = [(1, shared), (None, "x" * 200 + shared), (None, "short"), (None, text(43) + shared + other), (None, text(70) + other)]
    rows += [(4, "y" * 130 + shared), (4, "z"), (4, text(30) + other), (4, text(123)), (9, other + text(9)), (9, other + text(9)), (None, None), (4, None)]
    check_removed(spark, rows)


def test_suffix_dedup_of_a_passage_in_thousands_of_documents(spark):
    rng = np.random.default_rng(15)
    text = lambda k: "".join(rng.choice(list("abcdefgh "), k))
    shared = text(120)
    rows = [(i, text(int(rng.integers(0, 12))) + shared[int(rng.integers(0, 40)) :] + text(int(rng.integers(0, 12)))) for i in range(10_000)]
    check_removed(spark, rows)


def test_blind_trie_and_strings():
    rng = np.random.default_rng(10)
    rows = rng.integers(97, 99, (400, suffixes.LENGTH)).astype("u1")
    rows[:, :40] = rows[0, :40]
    rows[200:] = rows[:200]
    group = np.repeat([1, 2], 200)[rng.permutation(400)]
    cls = suffixes.equal_strings(group, rows)
    want = {}
    for c, g, r in zip(cls.tolist(), group.tolist(), rows, strict=True):
        assert want.setdefault((g, r.tobytes()), c) == c
    assert len(set(want.values())) == len(want)


def test_pipeline_stages(spark, sf):
    """Each stage against brute force on what its predecessor kept."""
    import corpus_pipeline as P
    from test_texts import simulated
    from tokenizers import Tokenizer

    from tessera.llm import packing
    from tessera.llm.common import materialise, table

    d = table(spark, sf, "documents")
    names, kept = d.columns, {None: d.collect()}
    for name, stage in P.STAGES:
        d = materialise(stage(spark, d, sf), name)
        kept[name] = d.collect()
        if name != P.STAGES[-1][0]:
            assert d.columns == names
    start, known, lined, single, mixed, packed = kept.values()
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "source_mixing", "packing"]

    letters = {r.doc_id: r for r in start if re.search(r"[^\W\d_]", r.text or "")}
    assert {r.doc_id for r in known} == set(letters) and all(r.text == letters[r.doc_id].text for r in known)
    told = [(r.lang, letters[r.doc_id].lang) for r in known if letters[r.doc_id].lang]
    assert sum(a == b for a, b in told) >= 0.97 * len(told)

    sites, first = {}, {}
    for r in known:
        for pos, line in enumerate(r.text.split("\n")):
            line = line.strip(" \t\r")
            if len(line) >= 12:
                sites.setdefault(line, set()).add(r.source)
                first[line] = min(first.get(line, (r.doc_id, pos)), (r.doc_id, pos))
    bad = {x for x, s in sites.items() if len(s) >= 8}
    want = {r.doc_id: "\n".join(x for pos, x in enumerate(r.text.split("\n")) if (t := x.strip(" \t\r")) not in bad or first[t] == (r.doc_id, pos)) for r in known}
    assert {r.doc_id: r.text for r in lined} == want

    groups = brute_similar(sorted((r.doc_id, r.text.lower()) for r in lined))
    assert {r.doc_id for r in single} == {i for i, g in groups.items() if i == g} and len(single) < len(lined)

    words = {}
    for r in mixed:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {w[0]: w[4] for w in simulated([(r.doc_id, r.text, None, r.source) for r in single]) if w[4]}

    tokens = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted((r.doc_id, len(tokens.encode(r.text, add_special_tokens=False).ids) + 1) for r in mixed)
    assert sorted((r.doc_id, r.doc_tokens) for r in packed if r.start == 0) == want and sum(r.length for r in packed) == sum(n for _, n in want)
    assert P.run(spark, sf).columns == d.columns


def test_pipeline_stages_keep_extra_columns_and_bear_edges(spark):
    import corpus_pipeline as P

    text = "the words of a text that is long enough to be told from others by all of the stages"
    rows = [(1, text, "en", "a", 1), (None, text + " and one more", None, None, 2), (None, text.upper(), "en", None, 3), (2, None, "en", "b", 4), (2, "", None, "b", 5), (3, "!!", "en", "b", 6), (4, text, "en", "b", 7), (5, "short", "en", "", 8), (5, "short", "en", "", 9)]
    d = spark.createDataFrame([(*r, *"xyzuv") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, `_id` string, row string, part string, `a.b` string")
    for docs in (d, d.limit(0)):
        names = docs.columns
        for name, stage in P.STAGES:
            out = stage(spark, docs, "")
            out.count()
            if name != "packing":
                assert out.columns == names
                docs = out
