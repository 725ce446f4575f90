"""License scan, quality rules, language ID and quality classifier against plain versions and held-out rows."""

import math
import pytest
import unicodedata
import zlib

import numpy as np
import xxhash
import zstandard
from brute import awkward, empty, held_out, license_base, license_votes, quality_base, spark_xxhash64
from pyspark.sql import functions as F

from ledgerline.llm import queries
from ledgerline.llm.lang_compress import classify, drop_rejected, learn
from ledgerline.llm.license_scan import BASE, NOTICES, Template, license_scan
from ledgerline.llm.ordinal_quality import fit, graded, minimize, predict, text_tokens
from ledgerline.llm.quality_forest import FEATURES, document_stats, fit_forest, quality_rules, with_features

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_license_base_on_the_corpus(spark, texts):
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) for r in queries.op1_license_scan(spark, SF).collect()}
    assert got == {d: license_base(t) for d, t in texts.items()}


def test_license_votes_on_the_corpus(spark, texts):
    """Labels and scores of all documents against a plain diagonal vote."""
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in queries.op1_license_scan(spark, SF).collect()}
    want = {d: license_votes(t, NOTICES, BASE) for d, t in texts.items()}
    assert got == {d: (labels, round(score, 9)) for d, (labels, score) in want.items()}
    assert sum(bool(labels) for labels, _ in want.values()) > 20


def test_license_in_a_text_that_repeats_it(spark):
    """Ten thousand notices in one text: matches are verified by place, and the count is whole."""
    text = "Released under the MIT License. All rights reserved. é " * 10_000
    (row,) = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row["n_base"] == 10_000 and row["labels"] == "mit,reserved" and row["last_word"] == 90_000 - 4


def test_license_awkward_rows(spark):
    rows = license_scan(awkward(spark)).collect()
    source = awkward(spark).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows) == sorted((str(d["doc_id"]), *license_base(d["text"])) for d in source)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["labels"] == "cc-by,cc-by-4.0,reserved" and by_id[1]["score"] == 1.0
    # One word more in the middle of a notice: two neighbouring diagonals merge into one span.
    assert "gpl-3.0" in by_id[11]["labels"] and by_id[11]["spans"][-1]["last"] - by_id[11]["spans"][-1]["first"] == 12
    assert license_scan(empty(spark)).count() == 0


def test_each_notice_gives_its_own_labels(spark):
    want = {
        "This work is licensed under the GNU General Public License, version 3": "gpl,gpl-3.0",
        "This work is licensed under the GNU General Public License, version 2": "gpl,gpl-2.0",
        "Licensed under the GNU General Public License, version 3": "gpl,gpl-3.0",
        "This work is licensed under the GNU Affero General Public License, version 3": "agpl,gpl",
        "This file is subject to the terms of the Mozilla Public License, v. 1.1": "",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "gpl",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "",
        "Licensed under the Apache License, Version 2": "apache-2.0",
    }
    want |= {t.text: ",".join(sorted({t.label} | set(license_base(t.text)[4].split(",")) - {""})) for t in NOTICES}
    rows = license_scan(spark.createDataFrame(list(enumerate(want)), "doc_id int, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in rows} == dict(enumerate(want.values()))
    # The best cover counts even where it is too little for a label.
    assert round([r["score"] for r in rows if r["doc_id"] == 4][0], 6) == round(10 / 12, 6)


def test_license_rejects_templates_it_cannot_vote_for(spark):
    with pytest.raises(ValueError):
        license_scan(awkward(spark), templates=[Template("x", "word")])


def test_quality_stats_and_calibration(spark, texts):
    rows = queries.op2_quality_forest(spark, SF).collect()
    assert {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in rows} == {d: quality_base(t) for d, t in texts.items()}
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    grade = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(grade[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in grade and not r["base_failed"]]
    good, bad = [k for g, k in judged if g], [k for g, k in judged if not g]
    assert sum(good) >= 0.99 * len(good) and sum(bad) < 0.15 * len(bad)


def test_quality_verdicts_are_those_of_the_trees(spark, docs):
    """Scores from plain walks down the trees, the threshold from a plain scan over all cuts, and the verdicts that follow."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stats = with_features(document_stats(docs))
    forest = fit_forest(stats)
    n, mean = forest.sample, 2 * (math.log(forest.sample - 1) + 0.5772156649015329) - 2 * (forest.sample - 1) / forest.sample

    def path(tree, x):
        feature, cut, left, right, length = tree
        at = 0
        while feature[at] >= 0:
            at = int(left[at] if x[feature[at]] <= cut[at] else right[at])
        return length[at]

    rows = {r["doc_id"]: r for r in queries.op2_quality_forest(spark, SF).collect()}
    scores = {r["id"]: 2 ** -(sum(path(t, [r[f] for f in FEATURES]) for t in forest.trees) / len(forest.trees) / mean) for r in stats.collect()}
    assert len(forest.trees) == 100 and n == 128
    assert all(abs(rows[d]["score"] - s) < 1e-9 for d, s in scores.items())
    judged = [(min(999, int(scores[r["doc_id"]] * 1000)), r["quality"] > 0) for r in labels.collect() if r["quality"] is not None and r["doc_id"] in rows and not rows[r["doc_id"]]["base_failed"]]
    good, bad = [b for b, g in judged if g], [b for b, g in judged if not g]
    found = {k: sum(b >= k for b in bad) for k in range(1000) if sum(b >= k for b in good) <= 0.005 * len(good)}
    threshold = max(k for k, v in found.items() if v == max(found.values())) / 1000
    assert {r["threshold"] for r in rows.values()} == {threshold}
    assert all(r["kept"] == (not r["base_failed"] and r["score"] < threshold) for r in rows.values())


def test_quality_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (13, 0, 0), (99, 1, 0), (12, None, None)], "doc_id long, quality int, toxic int")
    rows = quality_rules(awkward(spark), labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(r["doc_id"]), *(r[c] for c in names)) for r in rows) == sorted((str(d["doc_id"]), *quality_base(d["text"])) for d in awkward(spark).collect())
    assert all(r["threshold"] == 1.0 for r in quality_rules(awkward(spark), labels.limit(0)).collect())
    assert quality_rules(empty(spark), labels).count() == 0


def test_language_held_out_accuracy(spark, docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = queries.op5_lang_compress(spark, SF).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    kept = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(kept) / len(kept) > 0.96
    assert sum(r["rejected"] for r in rows) < 0.02 * len(rows)


def _plain_letters(text):
    return " ".join("".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split()).encode()


def test_language_by_plain_compression(spark):
    """Dictionaries drawn and texts compressed one by one give the same languages and scores."""
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = learn(small, docs_per_lang=8)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in small.collect()]

    def place(h):
        n = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)
        return n - (1 << 64) if n >> 63 else n

    for lang, content in zip(model.langs, model.contents):
        own = set()
        for d, t, g in rows:
            if g == lang and t is not None:
                h = spark_xxhash64(d, t, (5,)) % (1 << 30)
                at = place(h) % (max(len(t) - 4096, 0) + 1)
                own.add((h, t[at : at + 4096]))
        n = sum(g == lang and t is not None for _, t, g in rows)
        space = 1 << 30
        own = sorted(x for x in own if x[0] < max(min(own)[0] + 1, min(space, 48 * space // n)))[:24]
        assert content == b" ".join(_plain_letters(t) for _, t in own)[: 32_768]
    want = {}
    for d, t, _ in rows:
        body = _plain_letters(t or "")
        sizes = []
        for content in model.contents:
            params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=17, chain_log=16, hash_log=16, search_log=4, target_length=32, write_content_size=False, write_checksum=False, write_dict_id=False)
            press = zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            sizes.append(sum(len(press.compress(body[i : i + 2048])) for i in range(0, len(body), 2048)))
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        want[d] = ("und", 0.0) if not body else (model.langs[order[0]], 1 - sizes[order[0]] / sizes[order[1]])
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in classify(small, model).collect()} == want


def test_language_needs_a_letter(spark):
    model = learn(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows = spark.createDataFrame(list(enumerate(["½ ² ③ Ⅻ _ 12", "½a", "☃ !", "한"])), "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in classify(rows, model).orderBy("doc_id").collect()] == [True, False, True, False]


def test_samples_do_not_hang_on_the_ids(spark, docs):
    """Null ids, and one id for all rows, teach as much as others do."""
    for one in (F.lit(None).cast("long"), F.lit(1).cast("long")):
        model = learn(docs.withColumn("doc_id", one))
        assert len(model.langs) == 4 and all(len(c) > 10_000 for c in model.contents)
    marks = spark.createDataFrame([(1, 2), (None, 0)], "doc_id long, grade int")
    few = docs.limit(30).withColumn("doc_id", F.lit(1).cast("long"))
    assert fit(few, marks, rounds=2).levels == (2,)


def test_language_awkward_rows(spark, docs):
    model = learn(docs.where("doc_id % 3 <> 1"))
    assert model.langs[0] == "en" and set(model.langs) == {"en", "fr", "de", "es"} and all(len(c) <= 32_768 for c in model.contents)
    rows = classify(awkward(spark), model).collect()
    assert len(rows) == 16
    blank = [r for r in rows if r["doc_id"] in (2, 3, 4, 13) and r["lang_pred"] == "und"]
    assert {r["doc_id"] for r in blank} == {2, 3, 4} and all(r["score"] == 0 and r["rejected"] for r in blank)
    assert drop_rejected(awkward(spark), model).columns == awkward(spark).columns
    nothing = learn(empty(spark))
    assert all(r["lang_pred"] == "und" and r["rejected"] for r in classify(awkward(spark), nothing).collect())
    assert classify(empty(spark), model).count() == 0
    # A language of long documents only still gets a dictionary.
    assert learn(docs.where("lang = 'fr' and length(text) > 4096")).langs == ("fr",)


def test_ordinal_held_out(spark):
    big = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{big}/documents.parquet")
    labels = spark.read.parquet(f"{big}/labels.parquet").withColumn("grade", graded(F.col("quality"), F.col("toxic")))
    model = fit(docs, labels.where("doc_id % 4 <> 0"))
    assert model.levels == (0, 1, 2) and list(model.cuts) == sorted(model.cuts)
    rows = predict(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    kept = {g: [r["kept"] for r in rows if r["grade"] == g] for g in (0, 1, 2)}
    # Under 2,400 graded rows teach this; the bounds are for that.
    assert sum(kept[2]) > 0.97 * len(kept[2]) and sum(kept[0]) < 0.3 * len(kept[0]) and sum(kept[1]) < 0.2 * len(kept[1])
    mean = {g: sum(r["expected_grade"] for r in rows if r["grade"] == g) / len(kept[g]) for g in kept}
    assert mean[0] < mean[1] < mean[2] - 0.5
    assert all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in rows)


def test_ordinal_fit_is_that_of_a_plain_objective(spark, docs):
    """Weights, thresholds and predictions against a plain loss over all rows in one process."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("grade", graded(F.col("quality"), F.col("toxic")))
    model = fit(docs, labels, rounds=12)
    rows = docs.join(labels, "doc_id").where("grade is not null and text is not null").select("doc_id", "text", "grade").collect()
    folds = [spark_xxhash64(r["doc_id"], r["text"]) for r in rows]
    used = [r for r, f in zip(rows, folds) if spark_xxhash64(f, (9,)) % 5]
    slots = [sorted({zlib.crc32(t) % (1 << 18) for t in text_tokens(r["text"].encode())}) for r in used]
    count = np.bincount(np.concatenate(slots), minlength=1 << 18)
    active = np.flatnonzero(count >= 3)
    assert model.slots.tolist() == active.tolist()
    where = {s: i for i, s in enumerate(active.tolist())}
    x = np.zeros((len(used), len(active)))
    for i, own in enumerate(slots):
        for s in own:
            if s in where:
                x[i, where[s]] = 10 / math.sqrt(len(own))
    grade = np.array([r["grade"] for r in used])

    def objective(theta):
        w, (first, gap) = theta[:-2], theta[-2:]
        cuts = np.array([-np.inf, first, first + np.exp(gap), np.inf])
        s = x @ w
        upper, lower = (1 / (1 + np.exp(-np.clip(cuts[grade + k] - s, -35, 35))) for k in (1, 0))
        upper, lower = np.where(grade == 2, 1.0, upper), np.where(grade == 0, 0.0, lower)
        p = np.maximum(upper - lower, 1e-12)
        up, low = upper * (1 - upper), lower * (1 - lower)
        by_cut = [-np.sum(((grade == j) * up - (grade == j + 1) * low) / p) for j in (0, 1)]
        grad = np.concatenate([x.T @ ((up - low) / p) + 4 * w, [sum(by_cut), by_cut[1] * np.exp(gap)]])
        return (-np.log(p).sum() + 2 * w @ w) / len(used), grad / len(used)

    below = (np.array([np.sum(grade <= k) for k in (0, 1)]) + 0.5) / (len(used) + 1)
    start = np.log(below / (1 - below))
    theta = minimize(objective, np.concatenate([np.zeros(len(active)), [start[0], np.log(start[1] - start[0])]]), 12)
    assert np.abs(model.weights - theta[:-2]).max() < 1e-7 and np.abs(model.cuts - [theta[-2], theta[-2] + np.exp(theta[-1])]).max() < 1e-7
    # The gradient is that of the loss.
    rng = np.random.default_rng(1)
    way = rng.normal(size=len(theta)) * 1e-3
    value, grad = objective(theta)
    assert objective(theta + way)[0] - objective(theta - way)[0] == pytest.approx(2 * grad @ way, rel=1e-3)
    got = {r["doc_id"]: r for r in predict(docs, model).collect()}
    table = dict(zip(model.slots.tolist(), model.weights))
    for r in rows[:200]:
        own = {zlib.crc32(t) % (1 << 18) for t in text_tokens(r["text"].encode())}
        score = 10 * sum(table.get(s, 0.0) for s in own) / math.sqrt(len(own))
        above = [1 - 1 / (1 + math.exp(-(c - score))) for c in model.cuts]
        assert got[r["doc_id"]]["expected_grade"] == pytest.approx(sum(above), abs=1e-9) and got[r["doc_id"]]["tail_probability"] == pytest.approx(above[1], abs=1e-9)


def test_ordinal_awkward_rows(spark):
    grades = spark.createDataFrame([(1, 2), (5, 0), (12, 1), (2, 1), (3, None), (99, 1)], "doc_id long, grade int")
    model = fit(awkward(spark), grades, rounds=3)
    assert model.levels == (0, 1, 2)
    assert predict(awkward(spark), model).count() == 16 and predict(empty(spark), model).count() == 0
    one = fit(awkward(spark), grades.where("grade = 2"), rounds=3)
    assert {(r["expected_grade"], r["tail_probability"]) for r in predict(awkward(spark), one).collect()} == {(2.0, 1.0)}
    none = fit(awkward(spark), grades.limit(0), rounds=3)
    assert all(r["expected_grade"] is None and r["kept"] for r in predict(awkward(spark), none).collect())


def test_forest_draws_repeated_rows_by_their_number(spark):
    """Equal rows without an id are drawn as often as their share, whatever the size of the table, and no tree gets more than its sample."""
    rows = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "'' as text").union(spark.range(20_000).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 60) as text"))
    stats = with_features(document_stats(rows))
    forest = fit_forest(stats, trees=12, sample=64)
    assert len(forest.trees) == 12
    # The blank rows are half of every sample, and so a leaf of their own with a mean depth of some 32 rows.
    x = np.array([[0.0, 0.0, 0.0, 1.0]])
    assert 0.2 < float(forest.scores(x)[0]) < 0.6
    one = fit_forest(with_features(document_stats(rows.where("doc_id is null"))), trees=3, sample=64)
    assert len(one.trees) == 3 and all(len(t[0]) == 1 for t in one.trees)


def test_a_repeated_row_comes_as_often_as_it_stands(spark):
    rows = spark.range(2500).selectExpr("7L as doc_id", "'all rights reserved by us' as text")
    got = license_scan(rows)
    assert got.count() == 2500 and got.where("base_labels = 'reserved' and n_base = 1").count() == 2500


def test_long_texts_teach_like_short_ones(spark):
    """A language of mostly long texts is learnt from stretches of them, beginning anywhere."""
    rows = [(i, f"begin {i} " + "alpha beta gamma " * 3000 + "omega psi", "x") for i in range(30)] + [(100, "kurz", "x")]
    model = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.contents[0].count(b"gamma") > 1000 and b"begin" not in model.contents[0][:4000]
