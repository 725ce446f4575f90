"""The overlap join, phrase mining and hard negatives against brute force, with awkward rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from brute import awkward, empty, lower

from ledgerline.llm import overlap_join
from ledgerline.llm.hard_negatives import Codebooks, MultiIndex, hard_negatives, vector_rows
from ledgerline.llm.overlap_join import _cut, _folded, _marks, _may_link, _numbers, _planes, _prefix_lists, _sets, merge_skip, overlap_components
from ledgerline.llm.phrase_mining import collocations, frequent_phrases
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def joined(rows, percent=80):
    """[(id, n, component)] of all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    return sorted(((str(d), len(sets[i]), str(min((x for x in ids[root(i)] if x is not None), default=None))) for i, (d, _) in enumerate(rows)))


def got_joined(docs, **options):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in overlap_components(docs, **options).collect())


def test_overlap_join_on_near_copies(spark):
    """Chains of edits, families around a text, short texts, and texts of shared passages, against all pairs."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 6, 9, 40, 120]))]
        for _ in range(rng.randrange(1, 14)):
            if rng.random() < 0.5:
                base = list(base)
            else:
                base = base[:]
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.4:
                base = copy
            texts.append(" ".join(copy))
    lines = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(8)]
    texts += ["\n".join(rng.sample(lines, rng.randrange(2, 8))) for _ in range(60)]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    assert len({c for _, _, c in joined(rows)}) < len(rows) - 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got_joined(docs) == joined(rows)
    assert got_joined(docs, percent=50) == joined(rows, 50)


@pytest.mark.parametrize("block", [None, 1500])
def test_overlap_join_compares_families_in_blocks(spark, monkeypatch, block):
    """Texts that are alike and mostly do not link, of many lengths: no lists of a family are searched, in one block or in many, and links are those of all pairs."""
    rng = random.Random(11)
    rows = []
    for f, size in enumerate((90, 40)):
        base = [f"f{f}w{i}" for i in range(160)]
        for _ in range(size):
            copy = base[: rng.choice([160, 160, 150, 135, 120])]
            for _ in range(rng.randrange(8)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(1 << 30)}"
            rows.append((len(rows), " ".join(copy)))
    searched = []
    search = overlap_join._search

    def counted(open_, percent):
        searched.append(open_.count())
        return search(open_, percent)

    monkeypatch.setattr(overlap_join, "_search", counted)
    if block:
        monkeypatch.setattr(overlap_join, "_BLOCK", block)
        monkeypatch.setattr(overlap_join, "_LEAST", 1)
    want = joined(rows)
    assert 15 < len({c for _, _, c in want}) < 110
    assert got_joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want
    assert searched == [0]


def test_overlaps_of_blocks_are_counts():
    rng = np.random.default_rng(4)

    def sets(n, most, values):
        return [np.unique(rng.integers(0, values, size=rng.integers(1, most)).astype(np.uint64)) for _ in range(n)]

    for a, b in ((sets(5, 9, 12), sets(7, 9, 12)), (sets(90, 40, 3000), sets(120, 60, 3000)), (sets(200, 30, 50), sets(3, 2500, 4000))):
        a[0] = np.arange(8, dtype=np.uint64)
        for x, y in ((a, b), (b, a), (a, None)):
            got = overlap_join._overlaps(x, y)
            want = [[len(np.intersect1d(p, q)) for q in (x if y is None else y)] for p in x]
            differ = got != np.array(want)
            assert not (differ[np.triu_indices(len(x), 1)] if y is None else differ).any()


def test_first_look_at_sets(spark):
    """Entries travel as planes of bytes; at the first look near copies share shingles, and texts with one passage in common hardly any."""
    x = np.random.default_rng(5).integers(0, 1 << 64, size=1000, dtype=np.uint64)
    assert (_numbers(_planes(x, 6), 6) == x & np.uint64((1 << 48) - 1)).all() and (_numbers(_planes(x)) == x).all()
    passage = " ".join(f"p{i}" for i in range(12))
    texts = [passage + " " + " ".join(f"t{t}w{i}" for i in range(200)) for t in range(30)]
    texts += [texts[0] + " end", texts[1]]
    docs = spark.createDataFrame([(x,) for x in texts], "t string").select(F.col("t").cast("binary"))
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    counts = [r["c"] for r in _prefix_lists(docs, 5, 80, none, 4, glance=True).groupBy("short").agg(F.sum("token").alias("c")).collect()]
    assert len(counts) <= 31 and sum(c >= 13 for c in counts) == 2


def test_overlap_join_awkward_rows(spark):
    docs = awkward(spark)
    assert got_joined(docs) == joined([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert overlap_components(empty(spark)).collect() == []


def test_merge_skip_is_a_count():
    rng = random.Random(1)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randrange(12))) for _ in range(rng.randrange(1, 9))]
        for least in (1, 2, 3, 5):
            counts = Counter(x for one in lists for x in one)
            assert merge_skip(lists, least) == sorted((x, c) for x, c in counts.items() if c >= least)


def test_marks_never_hide_a_link():
    rng = np.random.default_rng(2)
    for n, m in ((40, 48), (70, 60), (500, 520), (1030, 1000), (9, 11)):
        for both in range(min(n, m) // 2, min(n, m) + 1, 3):
            x = np.unique(rng.integers(0, 1 << 64, size=n + m - both, dtype=np.uint64))
            x = rng.permutation(x)
            a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:both], x[n:]]))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert _may_link(len(a), len(b), _marks(a), _marks(b), 80)
    assert not _may_link(n, m, _marks(np.arange(9, dtype=np.uint64) << np.uint64(60)), _marks(a ^ np.uint64(1 << 59)), 80)
    raw = rng.integers(0, 2, size=1 << 12).astype(bool)
    folded = np.packbits(raw.reshape(-1, 8).any(axis=1))
    assert (_folded(np.packbits(raw).tobytes(), len(folded)) == folded).all()


def test_hashed_words_are_the_words(spark):
    """Sets of texts hashed together, cut inside and far beyond a segment, are those of each text's own words."""
    import pyarrow as pa

    rng = random.Random(8)
    texts = ["", None, " ", "a", "A b", "a b c d e", "a\tb\nc\x0bd\x0ce\rf", "x" * 70, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(600_000)), "b a c d e f", "a b c d e", "é à ☃ b c d"]
    flat, counts = _sets(pa.array([None if t is None else t.encode() for t in texts], pa.binary()), 5)
    assert counts.tolist() == [len(shingles(t)) for t in texts]
    cut = _cut(flat, counts)
    alone = [_sets(pa.array([(t or "").encode()], pa.binary()), 5)[0] for t in texts]
    assert all((a == b).all() for a, b in zip(cut, alone))
    assert (cut[5] == cut[10]).all() and len(np.intersect1d(cut[5], cut[9])) == 0 and len(np.intersect1d(cut[5], cut[6])) == 1


def pieces_of(text):
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)) if (w := re.findall(r"[^\x20\x09]+", p))]


def mined(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for w in pieces_of(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    many = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    out = []
    for lang in n:
        own = []
        for (x, p), a in many.items():
            if x != lang:
                continue
            inside = any(y == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (y, q), b in many.items())
            if not inside:
                score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
                own.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(own)[:top])]
    return sorted(out)


@pytest.mark.parametrize("budget", [1 << 20, 3000, 60])
def test_phrases_by_any_budget(spark, budget):
    """Groups of prefixes of one word up to five give the same counts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").coalesce(2)
    want = Counter()
    for r in docs.collect():
        for w in pieces_of(r["text"]):
            want.update((r["lang"], " ".join(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    found, totals = frequent_phrases(docs, 15, budget=budget)
    got = {(r["lang"], r["phrase"]): r["f"] for r in found.collect()}
    assert got == {k: v for k, v in want.items() if v >= 15}
    assert {r["lang"]: r["n"] for r in totals.collect()} == {x: sum(c for (y, p), c in want.items() if y == x and " " not in p) for x in {y for y, _ in want}}


def test_collocations(spark):
    rng = random.Random(2)
    words = ["a", "b", "c", "d", "é", "☃", "of", "New", "York"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", "\n"]) for _ in range(rng.randrange(40))), rng.choice(["x", "y", None, "und"])) for i in range(120)]
    rows += [(i, None, "x") for i in range(3)] + [(9, "in New York City now", "x")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("phrase", F.lit("clash"))
    for top in (2000, 7):
        got = sorted(tuple(r) for r in collocations(docs, 12, top).collect())
        assert got == mined([(r[2], r[1]) for r in rows], 12, top)
    awk = awkward(spark)
    assert sorted(tuple(r) for r in collocations(awk, 2).collect()) == mined([(r["lang"], r["text"]) for r in awk.collect()], 2, 2000)
    assert collocations(empty(spark)).collect() == []


def mine(rows, anchors, k=5):
    out = []
    for a in anchors:
        def score(r, a=a):
            return sum(x * y for x, y in zip(a[2], r[2]))

        order = sorted(((-score(r), r[0], r[1]) for r in rows if r[0] != a[0]), key=lambda x: x[:2])
        for s, p, _ in [x for x in order if x[2] == a[1]][:k]:
            fine = [(-t, n) for t, n, x in order if x != a[1] and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a[0], p, i + 1, n, -s, t) for i, (t, n) in enumerate(fine)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 50_000.0])
def test_hard_negatives_on_clusters(spark, scale):
    """Clustered vectors with ties, beyond exact doubles too, in several shards and blocks."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(3)), [float(np.float32(x)) for x in scale * (centres[i % 6] + 0.2 * rng.normal(size=8))]) for i in range(400)]
    rows += [(1000 + i, i % 3, rows[i][2]) for i in range(60)]
    made = vector_rows(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), "vec_id", "embedding", F.col("label"))
    got = hard_negatives(made, made.where("id % 10 = 0"), shard_rows=90, block=17, codes=5)
    plain = [(i, c, [int(np.floor(256 * x)) for x in v]) for i, c, v in rows]
    assert sorted(tuple(r) for r in got.collect()) == mine(plain, [r for r in plain if r[0] % 10 == 0])


def test_cells_are_visited_by_falling_bounds_that_hold():
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, size=(300, 6))
    books = Codebooks(x[:7, :3].astype(float), x[:9, 3:].astype(float), 6, 50)
    index = MultiIndex(books, np.arange(300), np.zeros(300, dtype=np.int64), x)
    for q in x[:20].astype(float):
        seen = list(index.visit(q))
        assert [b for b, _ in seen] == sorted((b for b, _ in seen), reverse=True)
        assert len({c for _, c in seen}) == len(seen)
        bound = {c: b for b, c in seen}
        assert all(index.x[i] @ q <= bound[int(index.cell[i])] for i in range(300))


def test_hard_negatives_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 2, [0.9, 0.5]), (3, 2, [0.9, 0.5]), (3, 2, [0.9, 0.5]),
        (4, None, [1.0, 0.5]), (None, 2, [1.0, 0.5]), (5, 2, None), (6, 2, [1.0, None]), (7, 2, [nan, 1.0]), (8, 2, [inf, 1.0]), (9, 2, []), (10, 1, [1.0]), (11, 1, [-1.0, -1.0]), (12, 3, [1.0, 0.4, 7.0]),
    ]
    docs = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "v", "a", "shard", "p")})
    made = vector_rows(docs, "vec_id", "embedding", F.col("label"))
    kept = [(i, c, [int(np.floor(256 * x)) for x in v]) for i, c, v in dict.fromkeys((r[0], r[1], tuple(r[2])) for r in rows if None not in r and None not in r[2] and np.isfinite(r[2]).all())]
    got = sorted(tuple(r) for r in hard_negatives(made, made.where("id in (0, 10)")).collect())
    assert got == mine(kept, [r for r in kept if r[0] in (0, 10)])
    none = made.where("id < 0")
    assert hard_negatives(none, none).collect() == []
    assert hard_negatives(made, none).collect() == []
