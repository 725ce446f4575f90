"""Exact and near deduplication, components and mixing against plain versions."""

import random

import numpy as np
import pytest
from brute import awkward, components, empty, simhash

from ledgerline.llm import queries
from ledgerline.llm.components import connected_components
from ledgerline.llm.exact_dedup import drop_exact_copies, exact_dedup
from ledgerline.llm.golay import decode, near_indices
from ledgerline.llm.golay_dedup import drop_near_copies, fingerprint_links, fuzzy_keys, near_duplicates
from ledgerline.llm.source_mix import mix_plan, mixed_documents, mixing_exponent

SF = "/root/testdata/sf0.01"


def test_exact_awkward_rows(spark):
    # A map of so few bits lets nearly all rows through to the full hash.
    for bits in (25, 7):
        rows = exact_dedup(awkward(spark), bits=bits).collect()
        assert len(rows) == 16
        groups = {}
        for d in awkward(spark).collect():
            groups.setdefault(d["text"] or "", []).append(d["doc_id"])
        want = sorted((str(d["doc_id"]), str(max((x for x in groups[d["text"] or ""] if x is not None), default=None)), len(groups[d["text"] or ""])) for d in awkward(spark).collect())
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in rows) == want
        assert sum(r["kept"] for r in rows) == len(groups)
    kept = drop_exact_copies(awkward(spark))
    assert kept.columns == awkward(spark).columns and len({r["text"] or "" for r in kept.collect()}) == kept.count() == len(groups)
    assert exact_dedup(empty(spark)).count() == 0 and drop_exact_copies(empty(spark)).count() == 0


def test_exact_copies_are_dropped_by_row(spark):
    """Null and repeated ids: of equal texts the largest id stays, and no text goes with another's id."""
    rows = [(None, "a"), (None, "b"), (None, "b"), (1, "a"), (2, "c"), (2, "d"), (2, "d"), (3, None), (4, ""), (5, "e"), (5, "c")]
    out = drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect()) == sorted([("1", "a"), ("None", "b"), ("2", "d"), ("4", ""), ("5", "e"), ("5", "c")])


def test_exact_dedup_hashes_survivors_alone(spark):
    plan = exact_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert plan.count() == 1
    docs = spark.createDataFrame([(i, "x" * i) for i in range(1, 50)], "doc_id long, text string")
    # All lengths differ: no row gets a group hash.
    assert all(r["group_size"] == 1 and r["kept"] and r["keep_id"] == r["doc_id"] for r in exact_dedup(docs).collect())


def test_golay_code_is_perfect():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 2000, dtype=np.uint32)
    index = decode(words)
    assert index.max() < 4096
    found, two, one = near_indices(words)
    assert set(two.sum(axis=1)) <= {1, 6} and (one <= two).all()
    for bits in (1, 2):
        other = words.copy()
        for i in range(len(other)):
            for b in random.sample(range(23), bits):
                other[i] ^= np.uint32(1 << b)
        f2, t2, o2 = near_indices(other)
        for a, b, x, y in zip(found, f2, one if bits == 1 else two, o2 if bits == 1 else t2):
            assert set(a[x]) & set(b[y])


@pytest.mark.parametrize("errors", range(5))
def test_fuzzy_keys_meet_within_four_bits(errors):
    rng = random.Random(errors)
    base = np.array([rng.getrandbits(64) for _ in range(2000)], dtype=np.uint64)
    other = np.array([int(x) ^ sum(1 << b for b in rng.sample(range(64), errors)) for x in base], dtype=np.uint64)
    sets = []
    for fps in (base, other):
        rows, keys = fuzzy_keys(fps.view(np.int64))
        own = [set() for _ in fps]
        for r, k in zip(rows.tolist(), keys.tolist()):
            own[r].add(k)
        sets.append(own)
    assert all(a & b for a, b in zip(*sets))


def test_near_duplicates_on_the_corpus(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    ids = sorted(docs)
    fps = [simhash(docs[d]) for d in ids]
    assert got == {d: (f"{f:016x}", c) for d, f, c in zip(ids, fps, components(ids, fps))}


def test_near_duplicates_awkward_rows(spark):
    rows = near_duplicates(awkward(spark)).collect()
    source = [(d["doc_id"], d["text"]) for d in awkward(spark).collect()]
    fps = [simhash(t) for _, t in source]
    want = sorted(zip([str(d) for d, _ in source], [f"{f:016x}" for f in fps], map(str, components([d for d, _ in source], fps))))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows) == want
    kept = drop_near_copies(awkward(spark))
    assert kept.columns == awkward(spark).columns and kept.count() == len({c for _, _, c in want})
    assert near_duplicates(empty(spark)).count() == 0


def test_near_copies_are_dropped_by_row_not_by_id(spark):
    """Null ids and one id with two texts: each component keeps one row, and no other row goes with a dropped one."""
    body = [" ".join(f"{name}{i}" for i in range(60)) for name in ("ash", "birch", "cedar", "dogwood", "elm", "fir")]
    rows = [
        *((None, t) for t in body[:3]),
        # A null id beside an id, in one component; then an id with two texts, of which one is a copy of a smaller id's.
        *((1, body[3]), (None, body[3].upper())),
        *((5, body[4]), (5, body[3] + "\n")),
        *((6, body[5]), (6, "quite another text under the same id")),
        # Rows that tie in id and text.
        *((7, "one text twice under one id"), (7, "one text twice under one id")),
    ]
    want = sorted((str(d), t) for d, t in [*rows[:4], rows[5], *rows[7:10]])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in drop_near_copies(docs).collect()) == want


def test_dense_group_and_chain_of_fingerprints(spark):
    """Fingerprints a few bits apart, in a dense ball and in a chain, close to the same components as all pairs."""
    rng = random.Random(7)
    fps = []
    for centre in (rng.getrandbits(64) for _ in range(6)):
        fps += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(60)]
    chain = rng.getrandbits(64)
    for _ in range(40):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        fps.append(chain)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps} | {rng.getrandbits(63) for _ in range(200)})
    # Many fingerprints that share the bits of a key and are far from each other, with some pairs among them.
    far = [rng.getrandbits(32) << 32 | 5 for _ in range(120)]
    fps = sorted({*fps, *(f - (1 << 64) if f >> 63 else f for f in far + [f ^ 1 << 40 ^ 1 << 50 for f in far[:30]])})
    want = components(fps, [f & (1 << 64) - 1 for f in fps])
    for crowd in (256, 2):
        got = {r["node"]: r["label"] for r in fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), crowd).collect()}
        assert [got.get(f, f) for f in fps] == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, None), (5, 5)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if v is not None and u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def _skewed(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), "big" if i % 3 else f"s{i % 4}", "en") for i in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def test_mixing_meets_its_aims(spark):
    docs = _skewed(spark)
    plan = mix_plan(docs, target_entropy=0.9, max_repeat=None, block_tokens=64).collect()
    share = {s: next(r["weight"] for r in plan if r["source"] == s) for s in {r["source"] for r in plan}}
    assert abs(sum(share.values()) - 1) < 1e-9
    entropy = -sum(w * np.log(w) for w in share.values())
    assert abs(entropy / np.log(len(share)) - 0.9) < 1e-6
    capped = mix_plan(docs, target_entropy=1.0, max_repeat=3.0, block_tokens=64).collect()
    repeats = {r["source"]: r["repeats"] for r in capped}
    assert max(repeats.values()) / min(repeats.values()) == pytest.approx(3.0, abs=1e-6)


def test_mixing_passes_are_budgeted_permutations(spark):
    docs = _skewed(spark)
    plan = mix_plan(docs, target_entropy=None, max_repeat=None, budget=3000, block_tokens=64).collect()
    tokens = {d["doc_id"]: len(d["text"].split()) for d in docs.collect()}
    for s in {r["source"] for r in plan}:
        own = [r for r in plan if r["source"] == s]
        total = sum(tokens[d["doc_id"]] for d in docs.where(f"source = '{s}'").collect())
        for e in {r["epoch"] for r in own}:
            rows = sorted((r for r in own if r["epoch"] == e), key=lambda r: r["position"])
            assert [r["position"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])[:-1]]).tolist()
            assert [r["block"] for r in rows] == sorted(r["block"] for r in rows)
        taken = sum(r["n_tokens"] for r in own)
        assert 0 <= taken - own[0]["repeats"] * total < 13


def test_mixing_awkward_rows(spark):
    plan = mix_plan(awkward(spark)).collect()
    assert {r["source"] for r in plan} == {"", "a", "b", "c"} and {r["doc_id"] for r in plan} == {d["doc_id"] for d in awkward(spark).collect()}
    out = mixed_documents(awkward(spark), max_repeat=1.0)
    assert out.columns == awkward(spark).columns and out.count() == 16
    assert mix_plan(empty(spark)).count() == 0 and mixed_documents(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert mix_plan(blank).count() == 2
    assert mixing_exponent(spark.createDataFrame([("a", 1, 1.0)], "source string, tokens long, share double"), 0.5) == 1.0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(d[0] for d in want.description)
    rows = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, rows))


def test_crowded_bucket_meets_by_bits_that_differ(spark):
    """Members that share the segments A and C: few pairs for 3,000 of them, and the components of all pairs."""
    from ledgerline.llm.golay_dedup import _halves

    rng = random.Random(11)
    low, high = rng.getrandbits(23), rng.getrandbits(18)
    fps = sorted({high << 46 | rng.getrandbits(23) << 23 | low for _ in range(3000)})
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    halves = _halves(spark.createDataFrame([(1, f, f) for f in fps], "bucket long, fp long, label long")).groupBy("part", "bits").count()
    met = halves.selectExpr("sum(count * (count - 1) div 2) as pairs", "sum(count) as n").first()
    assert met["n"] == 70 * len(fps) and met["pairs"] < len(fps) ** 2 / 2 / 20
    some = fps[:400]
    got = {r["node"]: r["label"] for r in fingerprint_links(spark.createDataFrame([(f,) for f in some], "fp long"), 64).collect()}
    assert [got.get(f, f) for f in some] == components(some, [f & (1 << 64) - 1 for f in some])


def test_rows_without_an_id_are_units_of_their_own_text(spark):
    rows = [(None, f"text {i} " * 5, "a") for i in range(40)] + [(None, "text 1 " * 5, "a"), (1, "x y", "a"), (1, "z", "a"), (2, "x y", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mix_plan(docs, max_repeat=1.0)
    assert plan.where("doc_id is null").select("twin", "epoch").distinct().count() == plan.where("doc_id is null").count() >= 40
    out = mixed_documents(docs, max_repeat=1.0)
    assert out.where("doc_id is null").select("text").distinct().count() == 40
    assert len({r["mix_order"] for r in plan.where("doc_id is null and epoch = 0").collect()}) == 40
