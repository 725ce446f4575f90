"""Quality rules: per-document statistics, an isolation forest over them, and a threshold calibrated from labelled rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, ship_package

_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines"]
#: What the forest sees: shares, means and rates, so that a long clean text is no anomaly. Few of them, since random splits on a statistic
#: that tells nothing only blur the paths.
FEATURES = ["symbol_share", "copied_share", "word_length", "distinct_rate"]


def text_stats(text: bytes) -> tuple[int, ...]:
    """The counts named in _STATS for a text in UTF-8."""
    words = text.split()
    bare = text.translate(None, _SPACES)
    lines = Counter(x for x in text.split(b"\n") if x.strip(_SPACES))
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int64, count=len(words))
    repeated = 0
    if len(words) >= 3:
        pair = np.unique(ids[:-1] * len(codes) + ids[1:], return_inverse=True)[1]
        _, at, n = np.unique(pair[:-1] * len(codes) + ids[2:], return_inverse=True, return_counts=True)
        often = n[at] > 1
        covered = np.zeros(len(words), dtype=bool)
        for k in range(3):
            covered[k : k + len(often)] |= often
        repeated = int(covered.sum())

    def count(chars: bytes) -> int:
        return len(bare) - len(bare.translate(None, chars))

    return len(words), len(bare) - count(_CONTINUED), count(_SYMBOLS), sum(lines.values()) - len(lines), repeated, len(codes), sum(lines.values())


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the counts, base_failed) for each row.

    A null, empty or blank text has no word and fails. Texts of any length are counted whole, one at a time; repeated rows give repeated
    results, an empty table none; other columns are not looked at.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_stats(t.as_py() or b"") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * len(_STATS)))], names=["id", *_STATS])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    stats = rows.mapInArrow(run, schema=f"id {kind}, " + ", ".join(f"{c} long" for c in _STATS))
    return stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def with_features(stats: DataFrame) -> DataFrame:
    """The rows with FEATURES: finite for every row, those of texts without a word too; ids are not looked at, an empty table stays empty."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    made = {
        "symbol_share": F.col("n_symbols") / words,
        # Words of repeated windows or repeated lines, whichever is more of the text.
        "copied_share": F.greatest(F.col("n_repeat_words") / words, F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "word_length": F.col("word_chars") / words,
        # Distinct words grow about as a power of the length; the rate takes that out.
        "distinct_rate": F.ln(F.greatest(F.col("n_distinct"), F.lit(1)) + 1.0) / F.ln(words + 1.0),
    }
    return stats.withColumns({k: made[k].cast("double") for k in FEATURES})


def _mean_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of a leaf in a random search tree of n rows."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_tree(x: np.ndarray, rng: np.random.Generator, height: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, cut, left, right, path length at a leaf); the root is first and a leaf has feature -1."""
    nodes: list = [None]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth >= height or len(rows) < 2 or not len(open_):
            nodes[at] = (-1, 0.0, at, at, depth + float(_mean_depth(len(rows))))
            continue
        f = int(rng.choice(open_))
        cut = float(rng.uniform(low[f], high[f]))
        left = x[rows, f] <= cut
        nodes[at] = (f, cut, len(nodes), len(nodes) + 1, 0.0)
        nodes += [None, None]
        todo += [(len(nodes) - 2, rows[left], depth + 1), (len(nodes) - 1, rows[~left], depth + 1)]
    return nodes


@dataclass(frozen=True)
class Forest:
    trees: tuple[tuple[np.ndarray, ...], ...]
    sample: int
    height: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ^ -(mean path length / mean depth): near 1 for rows that random splits isolate at once."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.height):
                f = feature[at]
                go = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], left[at], right[at])
                at = np.where(f < 0, at, go)
            total += path[at]
        return np.exp2(-total / len(self.trees) / max(1e-9, float(_mean_depth(self.sample))))


def fit_forest(stats: DataFrame, trees: int = 100, sample: int = 128, seed: int = 11) -> Forest:
    """Grow every tree in a task of its own on at most `sample` rows drawn from all rows.

    One rule for every size: each row is drawn for each tree with the same chance, told by a hash of row and tree, 1.5 x `sample` being
    expected a tree, of which `sample` are chosen. Rows that are equal in id and statistics are counted first and drawn by their number, so
    that repeated rows, null ids among them, weigh as much as others. An empty table grows no tree.
    """
    n = stats.count()
    if not n:
        return Forest((), sample, 0)
    height = max(1, int(np.ceil(np.log2(sample))))
    share = min(1.0, 1.5 * sample / n)
    equal = stats.groupBy("id", *FEATURES).agg(F.count("*").alias("copies")).withColumn("h", F.xxhash64("id", *FEATURES, F.lit(seed)))

    def drawn(tree: Column) -> Column:
        return F.floor(F.col("copies") * share + F.pmod(F.xxhash64("h", tree), F.lit(1 << 40)) / float(1 << 40)).cast("int")

    copies = equal.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: drawn(t) > 0)))
    copies = copies.select(*FEATURES, "h", "tree", drawn(F.col("tree")).alias("drawn"))

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        tree = int(frame["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        frame = frame.sort_values(["h", *FEATURES])
        frame = frame.iloc[np.repeat(np.arange(len(frame)), np.minimum(frame["drawn"], 2 * sample))]
        if len(frame) > sample:
            frame = frame.iloc[np.sort(rng.choice(len(frame), sample, replace=False))]
        nodes = grow_tree(frame[FEATURES].to_numpy(dtype=float), rng, height)
        return pd.DataFrame([(tree, i, *n_) for i, n_ in enumerate(nodes)], columns=["tree", "node", "feature", "cut", "left", "right", "path"])

    got = copies.groupBy("tree").applyInPandas(grow, schema="tree int, node int, feature int, cut double, left int, right int, path double").toPandas()
    made = tuple(tuple(g.sort_values("node")[c].to_numpy() for c in ("feature", "cut", "left", "right", "path")) for _, g in got.groupby("tree", sort=True))
    return Forest(made, min(sample, n), height)


def score_rows(stats: DataFrame, forest: Forest) -> DataFrame:
    """The rows with a column `score`; zero for every row where no tree was grown. An empty table gives no rows."""
    ship_package(stats.sparkSession)
    names = stats.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(names.index(f)).to_numpy(zero_copy_only=False) for f in FEATURES]) if b.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.scores(x))], names=[*names, "score"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields)
    return stats.mapInArrow(run, schema=f"{schema}, score double")


def calibrate(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", grade_col: str = "quality", max_clean_loss: float = 0.005, bins: int = 1000) -> float:
    """The threshold above which a row is an anomaly.

    Of the cuts that lose at most `max_clean_loss` of the labelled good rows (grade above 0) the one that finds most of the bad
    rows, and of equals the highest. Scores are counted in `bins` bins over all labelled rows. Without labelled rows of both
    kinds the threshold is 1, which finds nothing.
    """
    marks = labels.where(F.col(grade_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(grade_col) > 0).alias("good"))
    rows = scored.where("not base_failed").join(marks, "id").select("good", F.least(F.lit(bins - 1), F.floor(F.col("score") * bins)).cast("int").alias("bin"))
    hist = rows.groupBy("bin", "good").count().collect()
    good, bad = np.zeros(bins), np.zeros(bins)
    for r in hist:
        (good if r["good"] else bad)[r["bin"]] += r["count"]
    if not good.sum() or not bad.sum():
        return 1.0
    # Cut k calls bins k and above anomalies.
    lost, found = good[::-1].cumsum()[::-1] / good.sum(), bad[::-1].cumsum()[::-1] / bad.sum()
    fine = np.flatnonzero(lost <= max_clean_loss)
    if not len(fine):
        return 1.0
    best = fine[found[fine] >= found[fine].max()]
    return float(best.max()) / bins


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", trees: int = 100, sample: int = 128, max_clean_loss: float = 0.005) -> DataFrame:
    """One row per input row: id, the counts, base_failed, score, threshold, kept.

    A row is kept unless it fails the base rules (under 50 words, or more than half of them in repeated 3-word windows) or its
    isolation score reaches the threshold calibrated from the labelled rows. Counts cover whole texts; the forest is fitted
    on at most 1.5 x trees x sample rows. A null text counts as having no word and fails the base rules. Repeated
    rows give repeated results; labels without a document, and null grades, are ignored; an empty table gives no rows. Long texts are
    judged by shares and rates like short ones.
    """
    stats = materialize(with_features(document_stats(docs, id_col, text_col)), "quality-stats")
    scored = materialize(score_rows(stats, fit_forest(stats, trees, sample)), "quality-scored")
    threshold = calibrate(scored, labels, id_col, grade_col, max_clean_loss)
    kept = ~F.col("base_failed") & (F.col("score") < F.lit(threshold))
    return scored.select(F.col("id").alias(id_col), *_STATS, "base_failed", "score", F.lit(threshold).alias("threshold"), kept.alias("kept"))
