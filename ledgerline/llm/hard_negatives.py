"""Hard-negative mining: an inverted multi-index of two half-space codebooks, searched exactly by certified windows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, scratch_path, ship_package

#: Sums of products below this are exact in double precision; larger components are multiplied as 64-bit integers.
_EXACT = 1 << 53
#: Components of a row that takes part are smaller, so that scores of up to 1,024 of them fit 64 bits.
_LARGEST = 1 << 26


@dataclass(frozen=True)
class Codebooks:
    """Centroids of the first and the second half of the components; `width` is the longest vector, `largest` the largest component."""

    first: np.ndarray
    second: np.ndarray
    width: int
    largest: int

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.width // 2
        return x[:, :cut], x[:, cut:]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row: nearest centroid of its first half times the size of the second book, plus that of its second half."""
        i, j = (_nearest(h, c) for h, c in zip(self.halves(x), (self.first, self.second)))
        return i * len(self.second) + j


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def vector_rows(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = 256) -> DataFrame:
    """(id, label, v) of the rows that take part, v the integer components floor(scale * x) with x as double.

    Rows without an id, with a null label or vector, or with a null or non-finite component (or one of 2^26 or more after scaling)
    take no part; rows equal in all three columns are one row. An empty vector takes part and scores zero; an empty table gives no rows.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (F.abs(x * scale) < _LARGEST))
    rows = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull()).where(fine)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))
    return rows.distinct()


def train(rows: DataFrame, codes: int = 16, sample: int = 20_000, rounds: int = 8, seed: int = 13) -> Codebooks:
    """Two codebooks by k-means over at most about `sample` rows drawn by a hash of all columns; every row is indexed afterwards.

    The books only decide in which order cells are visited: results do not depend on the sample.
    """
    n, width, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width = max(2, width or 0)
    space = 1 << 40
    share = min(1.0, sample / max(n, 1))
    drawn = rows.where(F.pmod(F.xxhash64("id", "label", "v", F.lit(seed)), F.lit(space)) < int(share * space)).select("id", "v").limit(2 * sample).collect()
    x = _matrix([r["v"] for r in sorted(drawn)] or [[]], width).astype(np.float64)
    rng = np.random.default_rng(seed)
    cut = width // 2
    return Codebooks(_k_means(x[:, :cut], codes, rounds, rng), _k_means(x[:, cut:], codes, rounds, rng), width, int(largest or 0))


def _matrix(vectors: list[list[int]], width: int) -> np.ndarray:
    """Rows of one width; shorter vectors are filled with zeros, as missing components add nothing to a product."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _column(col: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as rows of one width."""
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(col) and (sizes == width).all():
        return flat.reshape(len(col), width)
    out = np.zeros((len(col), width), dtype=np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(col)), sizes), at] = flat
    return out


class MultiIndex:
    """Rows of one shard in the cells of the product of two codebooks, with the radius of each half-cell."""

    def __init__(self, books: Codebooks, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        cell = books.cells(x.astype(np.float64))
        order = np.lexsort((ids, cell))
        self.books, self.ids, self.labels, self.cell = books, ids[order], labels[order], cell[order]
        exact = books.largest**2 * books.width < _EXACT
        x = x[order]
        self.x = x.astype(np.float64 if exact else np.int64)
        self.starts = np.searchsorted(self.cell, np.arange(len(books.first) * len(books.second) + 1))
        # A radius is the largest distance of a member's half from its centroid.
        self.radii = []
        for half, centres, code in zip(books.halves(x.astype(np.float64)), (books.first, books.second), (self.cell // len(books.second), self.cell % len(books.second))):
            r = np.full(len(centres), -1.0)
            np.maximum.at(r, code, np.sqrt(((half - centres[code]) ** 2).sum(axis=1)))
            self.radii.append(r)

    def bounds(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both halves (codes by falling bound, bound): no row of a half-cell scores more with that half of the query."""
        out = []
        for half, centres, r in zip((h[0] for h in self.books.halves(q[None, :])), (self.books.first, self.books.second), self.radii):
            # A little is added for rounding.
            b = centres @ half + np.linalg.norm(half) * np.maximum(r, 0)
            b = b + 1e-9 * (np.abs(b) + np.linalg.norm(half) * (np.linalg.norm(centres, axis=1) + np.maximum(r, 0)) + 1)
            used = np.flatnonzero(r >= 0)
            order = used[np.argsort(-b[used], kind="stable")]
            out.append((order, b[order]))
        return out

    def visit(self, q: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) by falling sum of both half-bounds: the multi-sequence walk with a heap."""
        (a, ba), (b, bb) = self.bounds(q)
        if not len(a) or not len(b):
            return
        heap, pushed = [(-(ba[0] + bb[0]), 0, 0)], {(0, 0)}
        while heap:
            minus, i, j = heapq.heappop(heap)
            yield -minus, int(a[i]) * len(self.books.second) + int(b[j])
            for s, t in ((i + 1, j), (i, j + 1)):
                if s < len(a) and t < len(b) and (s, t) not in pushed:
                    pushed.add((s, t))
                    heapq.heappush(heap, (-(ba[s] + bb[t]), s, t))

    def runs(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(places of rows, their scores, bound of all rows to come): cells as they are visited, taken together to runs that double."""
        walk = self.visit(q)
        ahead = next(walk, None)
        least, whole = 128, q.astype(self.x.dtype)
        while ahead:
            cells, size = [], 0
            while ahead and size < least:
                cells.append(np.arange(self.starts[ahead[1]], self.starts[ahead[1] + 1]))
                size += len(cells[-1])
                ahead = next(walk, None)
            least = min(2 * least, 4096)
            at = np.concatenate(cells)
            yield at, (self.x[at] @ whole).astype(np.int64), ahead[0] if ahead else -np.inf

    def best(self, at: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The first k (score, id)."""
        if len(at) > 4 * k:
            top = scores >= np.partition(scores, len(at) - k)[len(at) - k]
            at, scores = at[top], scores[top]
        order = np.lexsort((self.ids[at], -scores))[:k]
        return list(zip(scores[order].tolist(), self.ids[at[order]].tolist()))

    def positives(self, q: np.ndarray, own: int, label: int, k: int) -> list[tuple[int, int]]:
        """The first k (score, id) of the label with another id; cells are visited until none can hold a better one."""
        found: list[tuple[int, int]] = []
        for at, s, bound in self.runs(q):
            fine = (self.labels[at] == label) & (self.ids[at] != own)
            if len(found) == k:
                fine &= s >= found[-1][0]
            if fine.any():
                found = sorted(found + self.best(at[fine], s[fine], k), key=_first)[:k]
            if len(found) == k and found[-1][0] > bound:
                break
        return found

    def windows(self, q: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (low, high) the first k (score, id) of other labels between both; a window is certified, and no
        longer searched, once its k rows beat the bound of all cells to come or no such cell reaches its low end."""
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        open_ = list(range(len(windows)))
        for at, s, bound in self.runs(q) if windows else ():
            other = self.labels[at] != label
            for w in open_:
                low, high = windows[w]
                fine = other & (s >= (found[w][-1][0] if len(found[w]) == k else low)) & (s <= high)
                if fine.any():
                    found[w] = sorted(found[w] + self.best(at[fine], s[fine], k), key=_first)[:k]
            open_ = [w for w in open_ if bound >= windows[w][0] and not (len(found[w]) == k and found[w][-1][0] > bound)]
            if not open_:
                break
        return found


def _first(hit: tuple[int, int]) -> tuple[int, int]:
    return -hit[0], hit[1]


def build_index(rows: DataFrame, books: Codebooks, shard_rows: int = 16_384) -> DataFrame:
    """(shard, ids, labels, v): every row in one of the shards of about `shard_rows` rows, dealt by a hash so that no cell makes a large one."""
    n = max(1, -(-rows.count() // shard_rows))
    return materialize(rows.withColumn("shard", F.pmod(F.xxhash64("id", "label", "v"), F.lit(n)).cast("int")).repartitionById(n, F.col("shard")), "multi-index")


def _search(index: DataFrame, books: Codebooks, run, schema: str) -> DataFrame:
    """Apply `run` to the multi-index of every shard; a shard is gathered by the task that reads it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        shard = table.column("shard").to_numpy()
        for one in np.unique(shard):
            own = table.filter(pa.array(shard == one)).combine_chunks()
            v = own.column("v").combine_chunks()
            at = MultiIndex(books, own.column("id").to_numpy(), own.column("label").to_numpy(), _column(v, books.width))
            yield from run(at)

    return index.mapInArrow(task, schema=schema)


_MINED = ["a", "p", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
_RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * len(names))], names=names)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, codes: int = 16, sample: int = 20_000, shard_rows: int = 16_384, block: int = 1000) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (id, label, v) as `vector_rows` makes them.

    `anchors` is a stated set of the rows. Scores are integer inner products; higher ones come first, ties by the smaller id. An
    anchor's positives are its first `positives` rows of the same label with another id; for each of them the first `negatives` rows
    of other labels whose score is from low to high per cent of the positive's follow. A positive with a negative score has none.

    Every row lies in a shard, and every anchor searches each shard's inverted multi-index: cells are visited by falling bound of the two
    half-scores, centroid product plus norm times radius, until the window is certified; so results are exact. Anchors are taken in
    blocks of `block`, whose vectors are sent to the tasks; what meets after the search is `positives` * `negatives` rows an anchor
    and shard. Rows that share an id are rows of their own
    and none is a positive of another. Empty tables give no rows.
    """
    spark = rows.sparkSession
    ship_package(spark)
    rows = materialize(rows, "vector-rows")
    books = train(rows, codes, sample)
    index = build_index(rows, books, shard_rows)
    # An anchor is told by its place in its block, since ids may repeat.
    keyed = materialize(anchors.withColumn("a", F.monotonically_increasing_id()), "anchors")
    groups = max(1, -(-keyed.count() // block))
    path = scratch_path(spark, "hard-negatives")
    for g in range(groups):
        queries = [(r["id"], r["a"], r["label"], r["v"]) for r in keyed.where(F.pmod(F.xxhash64("a"), F.lit(groups)) == g).collect()]
        x = _matrix([q[3] for q in queries], books.width)

        def find(at: MultiIndex, queries=queries, x=x) -> Iterator[pa.RecordBatch]:
            got = [(q[1], s, i) for q, v in zip(queries, x) for s, i in at.positives(v, q[0], q[2], positives)]
            yield _batch(got, ["a", "s", "i"])

        first = _search(index, books, find, "a long, s long, i long").selectExpr("*", "row_number() over (partition by a order by s desc, i) as p")
        windows: dict[int, list[tuple[int, int, int, int, int]]] = {}
        for r in first.where(F.col("p") <= positives).collect():
            if r["s"] >= 0:
                windows.setdefault(r["a"], []).append((-(-low * r["s"] // 100), high * r["s"] // 100, r["p"], r["i"], r["s"]))

        def mine(at: MultiIndex, queries=queries, x=x, windows=windows) -> Iterator[pa.RecordBatch]:
            got = []
            for q, v in zip(queries, x):
                own = windows.get(q[1], [])
                for (_, _, p, i, s), hits in zip(own, at.windows(v, q[2], [w[:2] for w in own], negatives)):
                    got += [(q[1], p, q[0], i, n, s, t) for t, n in hits]
            yield _batch(got, _MINED)

        hits = _search(index, books, mine, ", ".join(f"{c} long" for c in _MINED))
        ranked = hits.selectExpr("*", "cast(row_number() over (partition by a, p order by negative_score desc, negative_id) as int) as rank").where(F.col("rank") <= negatives)
        ranked.select(*_RESULT).write.mode("append").parquet(path)
    return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(path)
