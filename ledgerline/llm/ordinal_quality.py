"""Quality classifier: cumulative-link (ordered logit) regression over hashed text with shared weights and ordered thresholds."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, ship_package

_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+")
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CACHE_LIMIT = 500_000


def text_tokens(text: bytes) -> set[bytes]:
    """Distinct lower-cased words and runs of marks of a whole text in UTF-8, and marks for its capitals, variety and length."""
    tokens = _TOKEN.findall(text.lower())
    seen = set(tokens)
    upper = len(text) - len(text.translate(None, _UPPER))
    n = len(tokens)
    return seen | {b"\0upper%d" % (10 * upper // max(1, len(text))), b"\0variety%d" % (10 * len(seen) // max(1, n)), b"\0length%d" % int(math.log2(n + 1))}


class _Slots(dict):
    """Token to slot of the hash space, remembered up to a limit."""

    def __init__(self, size: int) -> None:
        self.size = size

    def __missing__(self, token: bytes) -> int:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        slot = self[token] = zlib.crc32(token) % self.size
        return slot


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade <= levels[k]) = sigmoid(cuts[k] - score); score = scale x the sum of slot weights over the root of their number."""

    levels: tuple[int, ...]
    slots: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    size: int
    min_tail: float = 0.5
    scale: float = 10.0

    def cumulative(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > levels[k]) by column k."""
        return 1.0 - _sigmoid(self.cuts[None, :] - scores[:, None])


def _features(docs: DataFrame, size: int) -> DataFrame:
    """(grade, fold, slots) of rows (grade, fold, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots(size)
        for b in batches:
            found = [sorted({slots[t] for t in text_tokens(x.as_py() or b"")}) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["grade", "fold", "slots"])

    return docs.mapInArrow(run, schema="grade int, fold long, slots array<int>")


def _scored(model: OrdinalModel, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, weight) of each slot in use, and (root of the number of slots, score) of each document of a batch of (grade, slots)."""
    where = np.full(model.size, -1, dtype=np.int64)
    where[model.slots] = np.arange(len(model.slots))
    sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
    doc, slot = np.repeat(np.arange(b.num_rows), sizes), where[b.column(1).flatten().to_numpy(zero_copy_only=False)]
    doc, slot = doc[slot >= 0], slot[slot >= 0]
    root = np.sqrt(np.maximum(1, sizes))
    return doc, slot, root, model.scale * np.bincount(doc, model.weights[slot], minlength=b.num_rows) / root


def _tails(model: OrdinalModel):
    """Task: the tail probability of each row of (grade, slots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.cumulative(_scored(model, b)[3])[:, -1])], names=["tail"])

    return run


def _gradient(model: OrdinalModel):
    """Task: the negative log-likelihood over its rows of (grade, slots), and its gradient by slot in use and by cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, total, on_cuts = 0.0, np.zeros(len(model.slots)), np.zeros(len(model.cuts))
        for b in batches:
            if not b.num_rows:
                continue
            grade = np.searchsorted(model.levels, b.column(0).to_numpy(zero_copy_only=False))
            doc, slot, root, score = _scored(model, b)
            cum = np.concatenate([np.zeros((b.num_rows, 1)), 1.0 - model.cumulative(score), np.ones((b.num_rows, 1))], axis=1)
            rows = np.arange(b.num_rows)
            p = np.maximum(cum[rows, grade + 1] - cum[rows, grade], 1e-12)
            loss -= np.log(p).sum()
            slope = cum * (1 - cum)
            on_score = (slope[rows, grade + 1] - slope[rows, grade]) / p
            total += np.bincount(slot, model.scale * (on_score / root)[doc], minlength=len(total))
            for j in range(len(on_cuts)):
                on_cuts[j] -= np.sum(((grade == j) * slope[:, j + 1] - (grade == j + 1) * slope[:, j + 1]) / p)
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([total.tobytes()], pa.binary()), pa.array([on_cuts.tobytes()], pa.binary())], names=["loss", "w", "c"])

    return run


def _cuts(theta: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first, and the logarithms of the gaps behind it."""
    return np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))


def minimize(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, evaluations: int, memory: int = 8) -> np.ndarray:
    """The best point of a limited-memory quasi-Newton descent with halved steps, after at most so many evaluations."""
    value, grad = objective(x)
    used, past = 1, []
    while used < evaluations and np.abs(grad).max(initial=0.0) > 1e-9:
        way, kept = grad.copy(), []
        for s, y, rho in reversed(past):
            kept.append(rho * (s @ way))
            way -= kept[-1] * y
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 50 / max(1.0, np.abs(grad).sum())
        for (s, y, rho), a in zip(past, reversed(kept)):
            way += (a - rho * (y @ way)) * s
        step = 1.0
        while True:
            there = x - step * way
            new, new_grad = objective(there)
            used += 1
            if new <= value - 1e-4 * step * (grad @ way) or used >= evaluations:
                break
            step /= 2
        if new >= value:
            break
        s, y = there - x, new_grad - grad
        if s @ y > 1e-12:
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
        x, value, grad = there, new, new_grad
    return x


def fit(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", max_rows: int = 20_000, size: int = 1 << 18, min_docs: int = 3, penalty: float = 4.0, rounds: int = 40, parts: int = 8, max_loss: float = 0.005) -> OrdinalModel:
    """Fit on a hash-drawn sample of about `max_rows` graded rows (all, if there are fewer).

    Each of `rounds` evaluations sums the exact loss and gradient of the sample over `parts` tasks, one number a slot in use, for a
    quasi-Newton step; slots in fewer than `min_docs` sampled documents have no weight; `penalty` is that on half the squared
    weights, against the sum over the sample. Rows without
    an id, a grade or a text are left out, and so are ids that are graded differently. An id of several documents grades them all.
    Rows that repeat each other count once. Long texts are read whole. Without two grades the model has no weights and no cuts.

    A fifth of the sample, drawn by hash, is held out of the fit: the tail probability that selects is the one that loses `max_loss` of
    its rows of the highest grade; it is one half with fewer than fifty such rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    marks = grades.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(grade_col).cast("int")).alias("grade"), F.max(F.col(grade_col).cast("int")).alias("_most")).where("grade = _most").drop("_most")
    marks = _thinned(marks, F.xxhash64("_id", F.lit(3)), marks.count(), max_rows)
    # At most `max_rows` pairs of id and grade, give or take the chance of the hash.
    marks = F.broadcast(materialize(marks.limit(2 * max_rows), "ordinal-marks"))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_key"), F.col(text_col).cast("binary").alias("text"))
    n = texts.select("_key").join(marks, F.col("_id") == F.col("_key"), "left_semi").count()
    joined = texts.join(marks, F.col("_id") == F.col("_key")).select("grade", F.xxhash64("_key", "text").alias("fold"), "text")
    found = _features(_thinned(joined, F.xxhash64("fold", F.lit(4)), n, max_rows), size).groupBy("grade", "fold").agg(F.first("slots").alias("slots"))
    rows = materialize(found.repartition(parts, "fold"), "ordinal-rows")
    apart = F.pmod(F.xxhash64("fold", F.lit(9)), F.lit(5)) == 0
    levels = tuple(sorted(r[0] for r in rows.select("grade").distinct().limit(65).collect()))
    if len(levels) > 64:
        raise ValueError("more than 64 grades")
    held, rows = rows.where(apart), rows.where(~apart)
    n = rows.count()
    active = np.array(sorted(r[0] for r in rows.select(F.explode("slots").alias("s")).groupBy("s").count().where(F.col("count") >= min_docs).select("s").collect()), dtype=np.int64)
    if len(levels) < 2:
        return OrdinalModel(levels, active[:0], np.zeros(0), np.zeros(0), size)

    k = len(levels)
    counts = {r["grade"]: r["count"] for r in rows.groupBy("grade").count().collect()}
    # A grade that no row of the fit has leaves hardly a gap between its cuts.
    below = (np.cumsum([counts.get(lv, 0) for lv in levels[:-1]]) + 0.5) / (n + 1)
    cuts = np.log(below / (1 - below))

    def model_of(x: np.ndarray) -> OrdinalModel:
        return OrdinalModel(levels, active, x[: len(active)], _cuts(x[len(active) :]), size)

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        got = rows.select("grade", "slots").coalesce(parts).mapInArrow(_gradient(model_of(x)), schema="loss double, w binary, c binary").collect()
        # Sums in a fixed order, so that the fit does not depend on which task ends first.
        got = sorted(got, key=lambda r: (r["loss"], bytes(r["w"])))
        w, theta = x[: len(active)], x[len(active) :]
        on_cuts = sum((np.frombuffer(r["c"]) for r in got), np.zeros(k - 1))
        behind = np.cumsum(on_cuts[::-1])[::-1]
        on_theta = behind * np.concatenate([[1.0], np.exp(theta[1:])])
        grad = np.concatenate([sum((np.frombuffer(r["w"]) for r in got), np.zeros(len(active))) + penalty * w, on_theta])
        return (sum(r["loss"] for r in got) + penalty / 2 * (w @ w)) / max(1, n), grad / max(1, n)

    start = np.concatenate([np.zeros(len(active)), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    model = model_of(minimize(objective, start, rounds))
    found = sorted(r[0] for r in held.where(F.col("grade") == levels[-1]).select("grade", "slots").mapInArrow(_tails(model), schema="tail double").collect())
    return replace(model, min_tail=found[int(max_loss * len(found))] if len(found) >= 50 else 0.5)


def _thinned(rows: DataFrame, hashed: Column, n: int, wanted: int) -> DataFrame:
    """About `wanted` of n rows, drawn by a hash; all, if there are fewer."""
    space = 1 << 30
    return rows.where(F.pmod(hashed, F.lit(space)) < F.lit(wanted * space // n)) if n > wanted else rows


def predict(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, expected_grade, tail_probability (of the highest grade), kept (tail at least the model's `min_tail`).

    Null and empty texts have only their length mark; long ones are read whole, one at a time. A model of one grade expects that grade with tail 1; one fitted without
    any graded row gives nulls and keeps every row. Repeated rows give repeated results; other columns are not looked at.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots(model.size)
        table = np.zeros(model.size)
        table[model.slots] = model.weights
        levels = np.array(model.levels, dtype=float)
        for b in batches:
            scores = []
            for x in b.column(1):
                at = list({slots[t] for t in text_tokens(x.as_py() or b"")})
                scores.append(model.scale * table[at].sum() / math.sqrt(max(1, len(at))))
            if not model.levels:
                grade = tail = pa.nulls(b.num_rows, pa.float64())
            else:
                above = model.cumulative(np.array(scores, dtype=float))
                grade = pa.array(levels[0] + above @ np.diff(levels))
                tail = pa.array(above[:, -1] if above.shape[1] else np.ones(b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column(0), grade, tail], names=["id", "expected_grade", "tail_probability"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, schema=f"id {kind}, expected_grade double, tail_probability double")
    return out.select(F.col("id").alias(id_col), "expected_grade", "tail_probability", F.coalesce(F.col("tail_probability") >= model.min_tail, F.lit(True)).alias("kept"))


def graded(quality: Column, toxic: Column) -> Column:
    """Ratings from two marks: 0 toxic, 1 poor, 2 good; null if either mark is null."""
    return F.when(quality.isNotNull() & toxic.isNotNull(), F.when(toxic > 0, 0).when(quality > 0, 2).otherwise(1))
