"""Toxicity, packing, dedup, token output, language, Jaccard and quality on small and odd tables."""

import hashlib
import string
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import common, exact_dedup, jaccard, langid, line_dedup, packing, quality, token_output, tokens, toxicity

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, fp string, id int, sig bigint, score double, place string"
LONG = " ".join(f"word{i}" for i in range(9000))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog today", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog today", "en", None),
    (2, "the quick brown fox jumps over the lazy dog today", "en", None),
    (3, None, None, None),
    (4, "", "de", "a"),
    (5, LONG, "en", "b"),
    (6, LONG + " tail", "en", "b"),
    (None, "no id here at all but words", "fr", "a"),
    (7, "  odd   spaces\t\n\n here ", "fr", "c"),
    (8, "one\ntwo lines\none", "fr", "c"),
    (9, "THE QUICK brown fox jumps over the lazy dog today", "en", "a"),
    (10, "idiot scum you are trash", "en", "a"),
    (11, "é ß 漢字 <|endoftext|> !!", None, "a"),
    (12, "12 34 !!", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, len(t or ""), True, "x", 1, 2, 0.5, "y") for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, q, t) for i, q, t in [(1, 1, 0), (2, 1, 0), (4, 0, 0), (5, 1, 0), (8, 0, 0), (9, 1, 0), (10, 0, 1), (11, None, None), (None, 1, 1)]], "doc_id bigint, quality int, toxic int")


def brute_tokens(text):
    return [*tokens.encoder(tokens.default_vocabulary()).tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_word_encoder_equals_the_tokenizer():
    e = tokens.WordEncoder(tokens.default_vocabulary(), capacity=3)
    odd = ["", " ", "a  b", "a \n b", "x " * 5, "it's I'll, don't! 're", "é! <|endoftext|>, b<|endoftext|>c", "a\x85 b　c", "foo, bar!! _x_. 12,3", "a\nb\nc d\n", "\n\n a"]
    texts = odd + [t or "" for _, t, *_ in TEXTS]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() + [0] for x in e.many(texts)] == [brute_tokens(t) for t in texts]


# -- toxicity ------------------------------------------------------------------------------------


def test_maximal_segments_equal_the_definition():
    rng = np.random.default_rng(3)

    def brute(s):  # recursively: the largest segment, then left and right of it
        if not len(s) or s.max() <= 0:
            return []
        sums = np.concatenate(([0.0], np.cumsum(s)))
        best = max((sums[j] - sums[i], -(j - i), -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1))
        i, j = best[3], best[4]
        return [*brute(s[:i]), (i, j, best[0]), *[(a + j, b + j, v) for a, b, v in brute(s[j:])]]

    for _ in range(200):
        s = rng.normal(-0.3, 1.0, rng.integers(0, 25))
        got = toxicity.maximal_segments(s)
        want = brute(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [v for *_, v in got] == pytest.approx([v for *_, v in want])


def test_toxicity_separates_and_handles_odd_rows(spark, docs, labels, empty):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        w = list(rng.choice(vocab, 60))
        if i % 4 == 0:
            for j in rng.integers(0, 60, 4):
                w[j] = str(rng.choice(["vile", "scumbag", "filth"]))
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(d, d)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i].score >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and got[0].passages
    assert toxicity.reject(d, model).where("toxic = 1").count() < 10 and toxicity.reject(d, model).count() > 430
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 for r in out)
    none = toxicity.fit(empty, labels)
    assert toxicity.score(empty, none).count() == 0 and {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.reject(docs, none, threshold=0.6).columns == docs.columns


# -- packing -------------------------------------------------------------------------------------


def test_packing_holds_every_id_once(docs, empty):
    got = packing.pack(docs, window=64).collect()
    want = sorted((i if i is not None else -1, brute_tokens(t)) for i, t, *_ in TEXTS)
    windows = defaultdict(list)
    pieces = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id if r.doc_id is not None else -1].append((r.start, np.frombuffer(r.piece_ids, "<u4").tolist()))
        assert len(r.piece_ids) == 4 * r.length
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0 and at < 64
    for i, ids in want:
        if i != 2:  # two equal rows
            assert [x for _, p in sorted(pieces[i]) for x in p] == ids
    assert sum(len(p) for _, p in pieces[2]) == 2 * len(brute_tokens(TEXTS[1][1]))
    assert packing.pack(empty).count() == 0


def test_sum_of_squares_rule():
    rng = np.random.default_rng(0)
    p, levels, sizes = packing.SumOfSquares(20), defaultdict(int), {}
    for w in rng.integers(1, 21, 500).tolist():
        counts = {h: sum(1 for v in levels.values() if v == h) for h in range(1, 20)}

        def total(h, w=w, counts=counts):
            c = dict(counts)
            if h:
                c[h] -= 1
            if h + w < 20:
                c[h + w] += 1
            return sum(v * v for v in c.values())

        window, offset = p.place(w)
        options = [total(h) for h in [0, *(h for h in counts if counts[h] and h + w <= 20)]]
        assert total(offset) == min(options) and levels[window] == offset
        levels[window] += w
    assert all(v <= 20 for v in levels.values())


# -- exact dedup ---------------------------------------------------------------------------------


def test_quotient_filters_merge_losslessly():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 2**63, 400, dtype=np.uint64) >> np.uint64(8)  # one slice of 2 ** 8
    values = np.concatenate((values, values[:50], np.repeat(values[:1], 700)))
    parts = np.array_split(rng.permutation(values), 7)
    width, q = 1 << 4, 12
    filters = [exact_dedup.CountingQuotientFilter.load(exact_dedup.CountingQuotientFilter.build(q, 0, x).dump(width), q, 0, width) for x in parts]
    merged = exact_dedup.CountingQuotientFilter.merge(filters)
    want, counts = np.unique(values, return_counts=True)
    assert merged.fingerprints.tolist() == want.tolist() and merged.counts.tolist() == counts.tolist()


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_groups(docs).collect()
    groups = defaultdict(list)
    for i, t, *_ in TEXTS:
        groups[t or ""].append(i)
    assert len(got) == len(TEXTS) and sum(r.kept for r in got) == len(groups)
    by = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    for r in got:
        v = by[r.text_sha256]
        assert r.group_size == len(v) and r.keep_id == max((x for x in v if x is not None), default=None) and r.doc_id in v
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns and sorted(left.select(F.coalesce("text", F.lit(""))).toPandas().iloc[:, 0]) == sorted(groups)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0


# -- line dedup ----------------------------------------------------------------------------------


def test_lines_against_brute_force(spark, docs, empty):
    rng = np.random.default_rng(2)
    base = ["".join(rng.choice(list("abcdé "), 30)) for _ in range(12)]
    rows = []
    for i in range(40):
        lines = []
        for s in rng.choice(base, 4):
            s, k, at = str(s), rng.integers(0, 5), int(rng.integers(0, 30))
            lines.append([s, s[:at] + "Z" + s[at + 1 :], s[:at] + s[at + 1 :], s[:at] + "Q" + s[at:], s[:at] + "XY" + s[at + 1 :]][k])
        rows.append((i, "\n".join([*lines, "", "short"])))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")

    def within(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) > len(b):
            a, b = b, a
        i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return a[i + (len(a) == len(b)) :] == b[i + 1 :]

    first = {}
    for i, t in rows:
        for p, line in enumerate(t.split("\n")):
            if line.strip():
                first.setdefault(line, (i, p))
    gone = {x for x in first if len(x) >= 20 and any(len(y) >= 20 and first[y] < first[x] and within(x, y) for y in first if y != x)}
    got = {r.doc_id: r.text for r in line_dedup.deduplicate(d).collect()}
    for i, t in rows:
        assert got[i] == "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip() or (first[x] == (i, p) and x not in gone))
    out = {r.doc_id: r for r in line_dedup.deduplicate(docs).collect()}
    assert out[8].text == "one\ntwo lines" and out[3].text == "" and out[9].text == TEXTS[10][1] and len(out) == len({i for i, *_ in TEXTS})
    assert line_dedup.deduplicate(empty).count() == 0


# -- token output --------------------------------------------------------------------------------


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    path = f"file://{tmp_path}/out"
    token_output.write(docs, path, block_bytes=2000)
    got = token_output.read(spark, path).collect()
    order = sorted(((i is not None, i or 0), brute_tokens(t)) for i, t, *_ in TEXTS)
    assert len(got) == len(TEXTS)
    starts = sorted((r.start, (r.doc_id is not None, r.doc_id or 0), np.frombuffer(r.ids, "<u4").tolist()) for r in got)
    assert [k for _, k, _ in starts] == [k for k, _ in order]
    at = 0
    for start, key, ids in starts:
        assert start == at and ids in [x for k, x in order if k == key]
        at += len(ids)
    assert [x.tolist() for x in token_output.fetch(spark, path, 5)] == [brute_tokens(LONG)] and len(token_output.fetch(spark, path, 2)) == 2
    token_output.write(empty, f"{path}-none")
    assert token_output.read(spark, f"{path}-none").count() == 0


# -- language ------------------------------------------------------------------------------------


def test_language_mixture(spark, docs, empty):
    rng = np.random.default_rng(4)
    syllables = {"xx": "ka ro ti mu".split(), "yy": "schl eng ver".split(), "zz": "óñ ue cio".split()}

    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang], rng.integers(1, 4))) for _ in range(n))

    rows = [(i, text(lang, 40), lang) for i, lang in enumerate(list(syllables) * 40)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(d)
    got = {r.doc_id: r for r in langid.identify(d, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows]) > 0.98
    mixed = model.infer(text("xx", 60) + " " + text("yy", 30))
    assert set(mixed) == {"xx", "yy"} and mixed["xx"] > mixed["yy"] > 0.2
    out = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert out[3].lang_pred == out[4].lang_pred == out[12].lang_pred == "und" and out[12].score == 0
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(empty)).collect()} == {"und"}


# -- n-gram Jaccard ------------------------------------------------------------------------------

_LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_sets(rows):
    import re

    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(_LOW))
        out.append((i, frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def brute_components(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            k = len(sets[a][1] & sets[b][1])
            if k and 100 * k >= 75 * (len(sets[a][1]) + len(sets[b][1]) - k):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for a in range(len(sets)):
        least[find(a)].append(sets[a][0])
    return [min((x for x in least[find(a)] if x is not None), default=None) for a in range(len(sets))]


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(12):
        n = int(rng.integers(5, 120))
        base = [f"f{f}w{j}" for j in range(n)]
        for _ in range(int(rng.integers(1, 14))):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                at = int(rng.integers(0, len(w)))
                w[at : at + int(rng.integers(0, 2))] = [f"r{rng.integers(1e6)}"] * int(rng.integers(0, 2))
            w = ["shared", "passage", "of", "many", "words", "here"] * int(rng.integers(0, 2)) + w
            rows.append((len(rows), " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(d, bucket_entries=500).collect()}
    sets = brute_sets(rows)
    assert got == {i: (len(s), c) for (i, s), c in zip(sets, brute_components(sets), strict=True)}


def test_jaccard_odd_rows(docs, empty):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.join(docs).collect())
    sets = brute_sets([(i, t) for i, t, *_ in TEXTS])
    assert got == sorted((i or -1, len(s), (c or -1) if s else (i or -1)) for (i, s), c in zip(sets, brute_components(sets), strict=True))
    assert jaccard.join(empty).count() == 0


def test_sketches_never_overstate():
    rng = np.random.default_rng(0)
    for _ in range(50):
        pool = common.mix64(rng.integers(0, 2**62, 400).astype(np.uint64))
        a, b = (np.unique(rng.choice(pool, rng.integers(90, 300))) for _ in range(2))
        apart = len(np.setxor1d(a, b))
        for _, d in jaccard._apart(jaccard.sketch(a).view(np.uint64), {len(jaccard.sketch(b)): (np.array([0]), jaccard.sketch(b).view(np.uint64)[None, :])}):
            assert d[0] <= apart


# -- quality -------------------------------------------------------------------------------------


def test_quality(spark, docs, labels, empty):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        w = ["".join(rng.choice(list(string.ascii_lowercase), 5)) for _ in range(50)]
        bad = i % 5 == 0
        rows.append((i, " ".join(x.upper() + "!!" if bad else x for x in w), int(not bad)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    got = {r.doc_id: r.score for r in quality.score(d, quality.fit(d, d, bits=14)).collect()}
    assert np.mean([(got[i] >= 0.3) == bool(q) for i, _, q in rows]) > 0.98
    out = quality.score(docs, quality.fit(docs, labels, bits=12)).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality.score(docs, quality.fit(empty, labels, bits=12)).collect()} == {0.5}
    assert quality.score(empty, quality.fit(empty, labels, bits=12)).count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(80)]
    y = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    values, cost = rng.normal(1, 0.2, 30), np.full(80, 0.7)
    w = quality.dual_coordinate_descent(rows, values, y, cost, epochs=400, tolerance=1e-8)
    x = np.zeros((80, 30))
    for i, r in enumerate(rows):
        x[i, r] = values[r] / np.sqrt(len(r))
    # hinge loss: the dual's value, found by projected gradient from many steps, equals the primal's
    k, alpha = (y[:, None] * x) @ (y[:, None] * x).T, np.zeros(80)
    for _ in range(20_000):
        alpha = np.clip(alpha - (k @ alpha - 1) / np.linalg.norm(k, 2), 0, cost)
    primal = 0.5 * w @ w + cost @ np.maximum(0, 1 - y * (x @ w))
    assert primal == pytest.approx(alpha.sum() - 0.5 * alpha @ k @ alpha, abs=1e-4)
    assert w == pytest.approx(x.T @ (alpha * y), abs=1e-3)
