"""Operators against slow versions of their definitions, and the pipeline on odd tables."""

import itertools
import math
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import COLUMNS, TEXTS, brute_components, brute_sets, brute_tokens

import corpus_pipeline
from docweave.llm import common, jaccard, langid, line_dedup, mixing, packing, quality, token_output, tokens, toxicity

# -- shared folder ---------------------------------------------------------------------------------


@pytest.mark.parametrize("master, good", [("local", True), ("local[4]", True), ("local-cluster[2,1,1024]", False), ("yarn", False), ("spark://host:7077", False)])
def test_a_cluster_needs_a_checkpoint_folder(master, good):
    found = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=found.append)
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    if good:
        assert common.shared_dir(fake).startswith("file://") and found
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(fake)


def test_bitmaps_hold_every_key(spark):
    d = spark.range(0, 3000, 3).withColumn("x", F.lit("a"))
    bits, places = common.bitmap(d, F.col("id"), d.count())
    inside = {r.id for r in common.by_bitmap(spark.range(3000), F.col("id"), bits, places, True).collect()}
    assert inside >= set(range(0, 3000, 3)) and len(inside) < 1400
    assert common.by_bitmap(spark.range(3000), F.col("id"), bits, places, False).count() == 3000 - len(inside)


def test_scratch_of_small_tables_is_one_file(spark):
    t = common.materialize(spark.range(100).repartition(4), "x", rows=100)
    assert len(t.inputFiles()) == 1 and t.count() == 100
    before = common.written()
    u = common.materialize(spark.range(2), "y")
    assert common.release(spark, since=before) == 1
    common.discard(t, u)
    assert not {t._scratch, u._scratch} & common.written()


# -- toxicity --------------------------------------------------------------------------------------


def brute_segments(s):
    if not len(s) or max(s) <= 0:
        return []
    *_, i, j = max((sum(s[i:j]), i - j, -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1))
    return [*brute_segments(s[:i]), sum(s[i:j]), *brute_segments(s[j:])]


def test_toxic_scores_equal_their_definition():
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}x".encode() for i in range(30)]
    model = toxicity.SegmentModel({w: float(x) for w, x in zip(vocabulary[:20], rng.normal(-0.2, 1, 20), strict=True)}, {b"w25x": 0.7}, 0.05, 0.8, -1.3, (0.9, 0.4, -0.2, -1.0))
    for _ in range(40):
        words = [vocabulary[i].decode() for i in rng.integers(0, 30, rng.integers(0, 22))]
        s = [model.scores.get(w.encode(), model.stems.get(w.encode()[:4], 0.0)) - 0.05 for w in words]
        normed = [0.8 * x + 1.3 - math.log(len(words)) for x in brute_segments(s)]
        best = max(normed, default=-3.0)
        tail = 1 - math.exp(-math.exp(-best))  # P(the largest segment of a clean text reaches this)
        significant = [x for x in normed if x > 0]
        x = [-math.log(tail), math.log(1 + sum(significant)), math.log(1 + len(significant))]
        z = sum(a * b for a, b in zip(x, model.weights, strict=False)) + model.weights[-1]
        assert model.score(" ".join(words)) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_toxic_fit_equals_its_definition(spark):
    rng = np.random.default_rng(2)
    ids = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5]
    rows = []
    for i in ids:
        toxic = int(i % 3 == 0)
        words = [f"p{x}q" for x in rng.integers(0, 12, 12)] + ([f"bad{x}" for x in rng.integers(0, 3, 90 if i % 2 else 2)] if toxic else [])
        rows.append((i, " ".join(rng.permutation(words)), toxic))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(d, d)

    def counts(some):
        n = {0: Counter(), 1: Counter()}
        for i, text, y in rows:
            if some(i):
                n[y].update(set(text.encode().split()))
        return n

    def odds(n, w):
        total = {y: sum(c.values()) for y, c in n.items()}
        share = (n[0][w] + n[1][w]) / (total[0] + total[1])
        a, b = n[1][w] + 0.05 * total[1] * share + 1e-9, n[0][w] + 0.05 * total[0] * share + 1e-9
        delta = math.log(a / (1.05 * total[1] - a + 1e-9)) - math.log(b / (1.05 * total[0] - b + 1e-9))
        return delta, abs(delta) / math.sqrt(1 / a + 1 / b) >= 3

    whole = counts(lambda i: True)
    for w in {*whole[0], *whole[1]}:
        delta, sure = odds(whole, w)
        if sure:
            assert model.scores[w] == pytest.approx(delta, abs=1e-9)
        else:
            assert model.scores.get(w, 0.0) == 0.0
    assert {w for w, x in model.scores.items() if x > 0} == {b"bad0", b"bad1", b"bad2"}
    # a text of ninety segments calibrates by all of them: features are the same in fit and score
    many = " ".join(f"bad0 {' '.join(['p1q'] * 40)}" for _ in range(90))
    assert len(model.segments(many)[1]) == 90
    held = [i for i in range(900) if i not in set(ids)]
    scored = {i: model.score(f"p1q p2q {'bad1 bad2' if i % 2 else 'p3q p4q'} p5q") for i in held}
    assert all((v >= 0.5) == bool(i % 2) for i, v in scored.items())


# -- language --------------------------------------------------------------------------------------


def brute_mixture(model, text):
    """The best penalised log-likelihood over every set of languages, and each set's."""
    found, n = np.unique(langid.grams(text), return_counts=True)
    price, value = model.penalty * np.log(n.sum() + 1), {}
    for size in range(1, len(model.languages) + 1):
        for some in itertools.combinations(range(len(model.languages)), size):
            p, share = model.likelihood[found][:, some], np.full(size, 1 / size)
            for _ in range(400):
                r = p * share
                share = (n[:, None] * r / r.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
            value[some] = float(n @ np.log(p @ share)) - price * size, dict(zip(some, share, strict=True))
    return value


def random_model(languages, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.gamma(0.3, size=(1 << langid.BITS, languages)) + 1e-4
    return langid.MixtureModel(tuple(f"l{i:02}" for i in range(languages)), p / p.sum(axis=0))


def test_mixtures_against_all_subsets(spark):
    rng = np.random.default_rng(1)
    syllables = ["ka ro ti mu", "schl eng ver zu", "ue cio que la", "ou eau ait ment"]
    rows = [(i, " ".join("".join(rng.choice(syllables[i % 4].split(), 3)) for _ in range(40)), f"l{i % 4}") for i in range(200)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    same = 0
    for n in range(60):
        kinds = rng.choice(4, rng.integers(1, 4), replace=False)
        text = " ".join("".join(rng.choice(syllables[k].split(), 3)) for k in kinds for _ in range(int(rng.integers(3, 25))))
        value, got = brute_mixture(model, text), model.infer(text)
        best = max(value, key=lambda s: value[s][0])
        mine = tuple(sorted(model.languages.index(x) for x in got))
        same += mine == best
        assert value[mine][0] > value[best][0] - 1.0
        for i, share in value[mine][1].items():
            assert got[model.languages[i]] == pytest.approx(share, abs=0.02)
    assert same >= 57


def test_many_languages_and_texts_that_tell_nothing():
    flat = langid.MixtureModel(tuple(f"l{i:02}" for i in range(60)), np.full((1 << langid.BITS, 60), 1.0 / (1 << langid.BITS)))
    assert flat.predict("any words at all")[0] == "l00" and flat.predict("12 !")[0] == "und"
    model = random_model(60)
    mixture = model.infer("some longer text with many words in it to tell of " * 3)
    assert 1 <= len(mixture) <= 60 and sum(mixture.values()) == pytest.approx(1)


# -- mixing ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_rows", [4, 1024])
def test_copies_are_a_walk_along_the_permutation(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    rows = [(int(i), " ".join(["w"] * int(rng.integers(1, 20))), s) for i, s in enumerate(["big"] * 700 + ["mid"] * 120 + ["small"] * 30)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    narrow, sources = mixing.plan(d, entropy_share=0.9, max_repeats=5.0, block_rows=block_rows, seed=3)
    plan = {r.key: r for r in sources.collect()}
    blocked = narrow.join(sources.select("key", "blocks"), "key").withColumn("block", F.pmod("place", "blocks"))
    blocked = blocked.withColumn("order", F.xxhash64("key", "block", F.lit(3))).collect()
    got = {r.doc_id: r.copies for r in mixing.mix(d, entropy_share=0.9, max_repeats=5.0, block_rows=block_rows, seed=3).collect()}
    for key, p in plan.items():
        own = sorted((r.order, r.block, r.place, r.doc_id, r.tokens) for r in blocked if r.key == key)
        assert p.blocks == math.ceil(len(own) / block_rows)
        total = sum(x[-1] for x in own)
        want, left = {}, p.quota
        while left >= total:
            left -= total
            for x in own:
                want[x[3]] = want.get(x[3], 0) + 1
        for x in own:  # the last, partial reading
            if x[-1] > left:
                break
            left -= x[-1]
            want[x[3]] = want.get(x[3], 0) + 1
        assert {x[3]: got[x[3]] for x in own} == {x[3]: want.get(x[3], 0) for x in own}


# -- quality ---------------------------------------------------------------------------------------


def test_quality_margins_equal_their_definition():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["good", "fine,", "BAD!!", "x9", "words"], 25)) for _ in range(40)]
    y = np.array([i % 2 for i in range(40)], float)
    rows = [quality.indicators(t, 10).astype(np.int64) for t in texts]
    w = quality._train(rows, y, 10, 1.0, 1.0)
    n = {0: Counter(), 1: Counter()}
    for r, k in zip(rows, y, strict=True):
        n[int(k)].update(r.tolist())
    total = {k: sum(c.values()) + (1 << 10) for k, c in n.items()}
    ratio = np.array([math.log((n[1][i] + 1) / total[1]) - math.log((n[0][i] + 1) / total[0]) for i in range(1 << 10)])
    svm = quality.dual_coordinate_descent(rows, ratio, np.where(y > 0, 1.0, -1.0), np.full(40, 1.0))
    assert w == pytest.approx(ratio * svm)
    model = quality.QualityModel(w, 10, 2.0, -0.5)
    for t, r in zip(texts, rows, strict=True):
        assert model.margin(t) == pytest.approx(sum(ratio[i] * svm[i] for i in r) / math.sqrt(len(r)))


# -- n-gram Jaccard --------------------------------------------------------------------------------


@pytest.mark.parametrize("percent", [50, 60, 67, 75, 90, 100])
def test_jaccard_at_any_percent(spark, percent):
    rng = np.random.default_rng(percent)
    rows = []
    for f in range(40):
        n = int(rng.integers(1, 5)) if f % 2 else int(rng.integers(5, 40))
        base = [f"f{f}w{j}" for j in range(n + 1)]
        for _ in range(4):
            at, much = int(rng.integers(0, len(base))), int(rng.integers(0, 3))
            rows.append((len(rows), " ".join(base[:at] + base[at + much :] + [f"f{f}v{rng.integers(2)}"] * int(rng.integers(0, 2)))))
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.join(d, percent=percent, words=2, bucket_entries=200, cell_rows=3).collect()}
    sets = []
    for i, t in rows:
        w = t.split()
        sets.append((i, {tuple(w[j : j + 2]) for j in range(len(w) - 1)} if len(w) > 1 else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        k = len(sets[a][1] & sets[b][1])
        if k and 100 * k >= percent * len(sets[a][1] | sets[b][1]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {i: find(n) for n, (i, _) in enumerate(sets)}


def test_jaccard_refuses_what_it_cant_do(spark):
    for percent in (49, 101):
        with pytest.raises(ValueError, match="percent"):
            jaccard.join(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), percent=percent)


def test_one_passage_in_many_unlike_texts(spark):
    """A long list of sets of different components is compared in cells, and none is lost."""
    rng = np.random.default_rng(0)
    passage = " ".join(f"common{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"own{i}x{j}" for j in range(int(rng.integers(6, 14))))) for i in range(80)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(0, 80, 9)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    sets = brute_sets(rows)
    for cells in (7, 4096):
        got = {r.doc_id: r.component_id for r in jaccard.join(d, cell_rows=cells, most_frequent=0).collect()}
        assert got == dict(zip((i for i, _ in rows), brute_components(sets), strict=True))


def test_long_lists_are_scanned_in_parts(spark):
    """A family of near copies and a passage that fill whole lists: their lists are split, and nothing is lost."""
    rng = np.random.default_rng(1)
    base, rows = [f"b{j}" for j in range(60)], []
    for i in range(90):
        w = list(base[: int(rng.integers(6, 60))] if i % 3 == 0 else base)
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(0, len(w)))] = f"r{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    want = dict(zip((i for i, _ in rows), brute_components(brute_sets(rows)), strict=True))
    for hot, most in ((16, 1 << 17), (40, 60), (10**9, 0)):
        got = {r.doc_id: r.component_id for r in jaccard.join(d, bucket_entries=60, hot_entries=hot, most_frequent=most, cell_rows=10).collect()}
        assert got == want


def test_shingles_of_long_texts_and_long_words():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in rng.integers(0, 5000, 40_000)]
    long_word = "y" * 200_000
    texts = [" ".join(words), "x  " + " ".join(words), f"{long_word} " + " ".join(words[:9]), f"a {long_word}z b c d e {long_word} f", long_word, " " * 100_000 + "a b", "\n".join(words[:30_000]) + " "]
    sets = [s for _, s in brute_sets(enumerate(texts))]
    found = [jaccard.shingles(t) for t in texts]
    assert [len(f) for f in found] == [len(s) for s in sets]
    for a, b in itertools.combinations(range(len(texts)), 2):
        assert len(np.intersect1d(found[a], found[b])) == len(sets[a] & sets[b])


def test_signatures_of_clashing_hashes_differ():
    a, b = jaccard.shingles("one two three four five six"), jaccard.shingles("one two three four five seven")
    both = frozenset({jaccard.signature(a)})
    assert jaccard.signature(a, both) == jaccard.signature(a) ^ jaccard.second(a) != jaccard.signature(a)
    assert jaccard.signature(b, both) == jaccard.signature(b)


# -- line dedup ------------------------------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_lines_within_edits(spark, edits):
    rng = np.random.default_rng(edits)
    base = ["".join(rng.choice(list("aabé "), int(rng.integers(18, 27)))) for _ in range(6)] + ["a" * 24, "a" * 25, "ab" * 12]
    rows = []
    for i in range(40):
        s = list(str(rng.choice(base)))
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(s)))
            s[at : at + int(rng.integers(0, 2))] = list("ab")[: int(rng.integers(0, 2))]
        rows.append((i, "".join(s) + "\nother"))
    first = {}
    for i, t in rows:
        for p, line in enumerate(t.split("\n")):
            if line.strip():
                first.setdefault(line, (i, p))
    gone = {x for x in first if len(x) >= 20 and any(len(y) >= 20 and first[y] < first[x] and edit_distance(x, y) <= edits for y in first if y != x)}
    got = {r.doc_id: r.text for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), edits=edits).collect()}
    assert got == {i: "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip() or (first[x] == (i, p) and x not in gone)) for i, t in rows}
    with pytest.raises(ValueError, match="edits"):
        line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string"), edits=3)


def test_edit_bound_holds_from_min_chars_on(spark):
    rows = [(1, "a" * 18 + "1"), (2, "a" * 18 + "2"), (3, "b" * 19 + "1"), (4, "b" * 19 + "2"), (5, "c" * 19), (6, "c" * 20), (7, "a" * 18 + "1")]
    got = {r.doc_id: r.n_dropped for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0, 6: 0, 7: 1}


def test_variants_meet_exactly_within_the_bound():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("ab"), int(rng.integers(0, 7)))) for _ in range(2))
        for edits in (1, 2):
            met = False
            one, two = (list(zip(*line_dedup.neighbourhood(x, edits), strict=True)) for x in (a, b))
            for (k, r), (m, s) in itertools.product(one, two):
                met |= k == m and r // 3 + r % 3 + s % 3 <= edits
            assert met == (edit_distance(a, b) <= edits)


def test_rows_of_one_id_are_documents_of_their_own(spark):
    line = "a line of more than twenty characters"
    rows = [(1, f"{line}\nx"), (1, f"{line}\nx"), (1, "y\nz"), (None, f"{line}\nown"), (None, None), (None, None), (2, "z\n\nz")]
    got = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    kept = Counter(x for r in got for x in r.text.split("\n") if x)
    assert kept == {line: 1, "x": 1, "y": 1, "z": 1, "own": 1}
    assert {r.text for r in got if r.doc_id is None} == {f"{line}\nown", ""}
    assert sorted((r.n_lines, r.n_dropped) for r in got if r.doc_id == 1) == [(2, 0), (2, 1), (2, 2)]
    assert next(r.text for r in got if r.doc_id == 2) == ""


# -- packing and token files -----------------------------------------------------------------------


def test_packing_in_lanes(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["word"] * int(rng.integers(0, 90)))) for i in range(600)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8), window=64, lane_rests=100).collect()
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, np.frombuffer(r.piece_ids, "<u4").tolist()))
    for w in windows.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(w))]
        assert [o for o, _ in sorted(w)] == ends[:-1] and (ends[-1] == 64 or ends[-1] & (ends[-1] - 1) == 0)
    assert {i: [x for _, p in sorted(ps) for x in p] for i, ps in pieces.items()} == {i: brute_tokens(t) for i, t in rows}
    assert sum(sum(n for _, n in w) < 64 for w in windows.values()) <= 6 * 8  # of a lane's last window alone


def test_windows_that_fill_each_other_join():
    rng = np.random.default_rng(0)
    windows = [[(i, 0, int(n))] for i, n in enumerate(rng.integers(1, 64, 500))]
    full, left = packing.close(64, windows)
    assert all(sum(p[2] for p in w) == 64 for w in full) and len(full) > 150
    assert sorted(p for w in full + left for p in w) == sorted(p for w in windows for p in w)
    sizes = Counter(sum(p[2] for p in w) for w in left)
    assert not any(sizes[64 - a] - (2 * a == 64) > 0 for a in sizes)


def test_token_files_of_an_id_of_many_rows(spark, tmp_path):
    rows = [(i if i < 40 else 50 if i < 240 else None if i < 400 else i, f"text {i} " * (1 + i % 3)) for i in range(440)]
    path = f"file://{tmp_path}/out"
    token_output.write(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), path, parts=8, block_bytes=500)
    got = sorted(token_output.read(spark, path).collect(), key=lambda r: r.start)
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order) and len(got) == len(rows)
    assert list(itertools.accumulate((r.n_tokens for r in got[:-1]), initial=0)) == [r.start for r in got]
    assert Counter((r.doc_id, r.ids) for r in got) == Counter((i, np.array(brute_tokens(t), "<u4").tobytes()) for i, t in rows)
    parts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens")).count()
    assert parts >= 6 and len(token_output.fetch(spark, path, 50)) == 200


def test_long_words_arent_remembered():
    e = tokens.WordEncoder(tokens.default_vocabulary())
    long_word = "ab1" * 300
    texts = [f"x {long_word} y {long_word}!!", f"{long_word}\nz", "z" * 500 + ",,,"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() + [0] for x in e.many(texts)] == [brute_tokens(t) for t in texts]
    assert max(len(w) for held in e.young + e.old for w in held) <= tokens.LONGEST


# -- the pipeline ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rows = [(i, t, lang, s, len(t or ""), True, "x", 1, 2, 0.5, "y") for i, t, lang, s in TEXTS]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(root / "odd" / "documents.parquet"))
    spark.createDataFrame([], COLUMNS).write.parquet(str(root / "empty" / "documents.parquet"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (9, 1, 0), (11, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for name in ("odd", "empty"):
        labels.write.parquet(str(root / name / "labels.parquet"))
    return root


def read_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, sf_dir), name)
        yield name, docs, out
        docs = out


def test_stages_on_odd_rows(spark, folder):
    """Null ids, texts and sources, repeated rows, long texts and clashing names: every stage by its definition."""
    for name, docs, out in read_stages(spark, str(folder / "odd")):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        if name != "packing":
            assert out.dtypes == docs.dtypes
            after = [(r.doc_id, r.text) for r in out.collect()]
        if name == "toxicity":  # no label is 1: nothing is told apart
            assert Counter(after) == Counter(before) == Counter((i, t) for i, t, *_ in TEXTS)
        elif name == "exact_dedup":
            best = {}
            for i, t in before:
                best[t or ""] = max(-1 if i is None else i, best.get(t or "", -1))
            assert Counter((-1 if i is None else i, t or "") for i, t in after) == Counter((i, t) for t, i in best.items())
        elif name == "ngram_jaccard":
            sets = brute_sets(before)
            keep = {i for (i, s), c in zip(sets, brute_components(sets), strict=True) if i == c or not s}
            assert Counter(after) == Counter((i, t) for i, t in before if i in keep)
        elif name == "mixing":
            assert set(after) <= set(before) and {i for i, t in before if not (t or "").split()} <= {i for i, _ in after}
        else:
            pieces = defaultdict(list)
            for r in out.collect():
                pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
            n = Counter(i for i, _ in before)
            for i, t in before:
                ids = brute_tokens(t)
                assert sum(x[1] for x in pieces[i]) == n[i] * len(ids)
                for start, length, crc in pieces[i]:
                    assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())


def test_stages_on_an_empty_table(spark, folder):
    for name, docs, out in read_stages(spark, str(folder / "empty")):
        assert out.count() == 0 and (name == "packing" or out.dtypes == docs.dtypes)


def test_the_whole_run_equals_its_stages(spark, folder):
    """``run`` gives what its stages give one by one, and leaves only what its result reads."""
    before = common.written()
    out = corpus_pipeline.run(spark, str(folder / "odd"))
    got = Counter((r.doc_id, r.doc_tokens) for r in out.groupBy("doc_id", "doc_tokens").count().collect())
    assert len(common.written() - before) <= 2
    for name, _, last in read_stages(spark, str(folder / "odd")):
        if name == "packing":
            assert got == Counter((r.doc_id, r.doc_tokens) for r in last.groupBy("doc_id", "doc_tokens").count().collect())
    assert corpus_pipeline.run(spark, str(folder / "empty")).count() == 0


def test_mixing_stage_meets_its_target(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(5, 15))), s) for i, s in enumerate(["a"] * 600 + ["b"] * 300 + ["c"] * 100)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = corpus_pipeline.mix_sources(spark, d, "")
    read = Counter()
    for r in out.collect():
        read[r.source] += len(r.text.split())
    total = sum(len(t.split()) for _, t, _ in rows)
    p = np.array([read[s] for s in "abc"]) / sum(read.values())
    assert sum(read.values()) == pytest.approx(total, rel=0.02)
    assert -(p * np.log(p)).sum() == pytest.approx(0.99 * math.log(3), abs=0.01)
    most = Counter(r.doc_id for r in out.collect()).most_common(1)[0][1]
    assert most <= 5
