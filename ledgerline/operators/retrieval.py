"""Retrieval: metadata predicates, exact vector search, lexical scores, rank fusion and diversity re-ranking."""

from __future__ import annotations

import datetime
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerline.functions import vectors
from ledgerline.functions.scalars import DOC_TYPES, clamp_doc_type, clean_ticker
from ledgerline.functions.text import tokens

# Fixed values.
K1, B, RRF_K, MMR_LAMBDA, OVERFETCH = 1.5, 0.75, 60, 0.7, 4


def predicate(ticker: str | None = None, year: int | str | None = None, document_type: str | None = None, period_of_report: str | None = None, period_start: str | None = None, period_end: str | None = None, lenient: bool = False) -> Column:
    """Conjunction of what is given; true if nothing is. An invalid value raises, or in lenient mode drops every filter."""
    parts = []
    try:
        if ticker is not None:
            t = ticker.strip().upper()
            if not re.fullmatch(r"[A-Z][A-Z0-9.\-]{0,9}", t):
                raise ValueError(f"invalid ticker: {ticker!r}")
            parts.append(F.col("ticker") == t)
        if year is not None:
            parts.append(F.col("filing_year") == int(year))
        if document_type is not None:
            if document_type not in DOC_TYPES:
                raise ValueError(f"invalid document type: {document_type!r}")
            parts.append(F.col("document_type") == document_type)
        for value, test in ((period_of_report, lambda d: F.col("period_of_report") == d), (period_start, lambda d: F.col("period_of_report") >= d), (period_end, lambda d: F.col("period_of_report") <= d)):
            if value is not None:
                if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
                    raise ValueError(f"invalid date: {value!r}")
                parts.append(test(F.lit(datetime.date.fromisoformat(value))))
    except ValueError:
        if not lenient:
            raise
        parts = []
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def blocks(queries: DataFrame, key: str, block: int = 1000) -> list[DataFrame]:
    """A stated query set in parts of about `block` rows by a hash of its key, each small enough to be broadcast."""
    n = max(1, -(-queries.count() // block))
    return [queries] if n == 1 else [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def near_pairs(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", digits: int = 9, within: Sequence[str] = (), skip_self: bool = False, lists: tuple[str, str] | None = None) -> DataFrame:
    """(the columns of both sides): a few pairs more than the k best of each query (query_id, _q, and `within` as _w0, ...) among the rows (item_id, _v, ...).

    The queries, a stated set that a task can hold, are multiplied with the rows of a batch at once. In each task a query keeps what comes within a
    margin of its k-th best so far, by far wider than the rounding of products and of `digits` digits; so what is not kept has k better rows in the
    same task. Vectors that cannot be measured so (null, not finite, zero or of another width) stay paired with all. `within` names columns of the rows that
    have to equal those of the query where it gives a value; with `skip_self` a row is no neighbour of the query of its id. `lists` names a number of the rows that has
    to be among those of an array of the queries, which goes no further.
    """
    table = queries.toArrow()
    member = None
    if lists:
        wanted = [np.array(x, dtype=np.int64) for x in table.column(lists[1]).to_pylist()]
        member = np.zeros((len(wanted), 2 + max((int(x.max(initial=0)) for x in wanted), default=0)), dtype=bool)
        for i, x in enumerate(wanted):
            member[i, x] = True
        queries, table = queries.drop(lists[1]), table.drop_columns([lists[1]])
    held = table.select(["query_id", "_q", *(f"_w{i}" for i in range(len(within)))]).to_pylist()
    names, ids = rows.columns, [h["query_id"] for h in held]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    width = Counter(len(h["_q"]) for h in held if h["_q"]).most_common(1)
    width = width[0][0] if width else 1

    def matrix(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, those that can be measured); others are zero."""
        flat = vectors.flatten()
        if not vectors.null_count and not flat.null_count and (np.diff(vectors.offsets.to_numpy()) == width).all():
            out, fit = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width), np.ones(len(vectors), dtype=bool)
        else:
            listed = vectors.to_pylist()
            out = np.zeros((len(listed), width))
            fit = np.array([v is not None and len(v) == width and None not in v for v in listed], dtype=bool)
            if fit.any():
                out[fit] = np.array([v for v, f in zip(listed, fit) if f], dtype=np.float64)
        size = np.linalg.norm(out, axis=1)
        fit &= np.isfinite(size) & (size < 1e100) & ((size > 1e-100) | (metric != "cosine"))
        out[~fit] = 0
        return (out / np.where(fit, size, 1)[:, None] if metric == "cosine" else out), fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, q_fit = matrix(pa.array([h["_q"] for h in held], pa.list_(pa.float64())))
        q_size = (q * q).sum(axis=1)
        # The k best measures of each query so far, larger is nearer.
        best = np.full((len(held), k), -np.inf)
        number = {x: i for i, x in enumerate(ids)}
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                v, v_fit = matrix(part.column(names.index("_v")))
                score = q @ v.T
                slack = 1e-11
                if metric != "cosine":
                    v_size = (v * v).sum(axis=1)
                    score = 2 * score - q_size[:, None] - v_size
                    slack = slack * (q_size[:, None] + v_size.max(initial=0)) + 1e-200
                allowed = np.ones(score.shape, dtype=bool)
                for i, c in enumerate(within):
                    theirs = np.array(part.column(names.index(c)).to_pylist(), dtype=object)
                    allowed &= np.array([np.ones(len(theirs), dtype=bool) if h[f"_w{i}"] is None else theirs == h[f"_w{i}"] for h in held])
                if member is not None:
                    # What no query asks for is the last column, which is false.
                    allowed &= member[:, np.minimum(part.column(names.index(lists[0])).to_numpy(zero_copy_only=False).astype(np.int64), member.shape[1] - 1)]
                if skip_self:
                    for j, x in enumerate(part.column(names.index("item_id")).to_pylist()):
                        if x in number:
                            allowed[number[x], j] = False
                odd = allowed & ~(q_fit[:, None] & v_fit)
                score[~allowed | odd] = -np.inf
                near = np.partition(score, score.shape[1] - k, axis=1)[:, -k:] if score.shape[1] > k else score
                both = np.concatenate([best, near], axis=1)
                best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                kth = best.min(axis=1, keepdims=True)
                if metric == "cosine":
                    floor = kth - slack - 2 * 10.0**-digits
                else:
                    # Of squared distances: so much further as rounding may tell.
                    far = np.sqrt(np.maximum(-kth, 0)) + 2 * 10.0**-digits
                    floor = -far * far - slack
                i, j = np.nonzero(allowed & ((score >= floor) | odd) & (np.isfinite(score) | odd))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), *part.take(pa.array(j)).columns], names=["_i", *names])

    numbered = rows.sparkSession.createDataFrame(table.append_column("_i", pa.array(range(len(held)), pa.int32())), StructType([*queries.schema.fields, StructField("_i", IntegerType())]))
    return rows.mapInArrow(run, schema=f"_i int, {schema}").join(F.broadcast(numbered), "_i").drop("_i")


def vector_top_k(rows: DataFrame, queries: DataFrame, k: int, row_id: str, row_vector: str, query_id: str, query_vector: str, metric: str = "cosine", digits: int = 9, block: int = 1000, carry: Sequence[str] = ()) -> DataFrame:
    """(query, row, similarity or distance, vec_rank, carry): the k nearest rows of each query, ties by row id; exact.

    The stated query set meets all rows in blocks of about `block` queries: products of matrices leave few pairs (near_pairs), which are measured
    exactly, and each task keeps its k best a query before anything is shuffled (a window group limit). `carry` names columns of the rows that go along.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("_q"))
    v = rows.select(F.col(row_id).alias("item_id"), F.col(row_vector).alias("_v"), *carry)
    if metric == "cosine":
        q, v = q.withColumn("_qn", vectors.norm(F.col("_q"))), v.withColumn("_vn", vectors.norm(F.col("_v")))
        measure = F.try_divide(vectors.dot(F.col("_q"), F.col("_v")), F.col("_qn") * F.col("_vn"))
    else:
        measure = vectors.l2(F.col("_q"), F.col("_v"))
    order = F.desc("score") if metric == "cosine" else F.asc("score")
    out = None
    for part in blocks(q, "query_id", block):
        scored = near_pairs(v, part, k, metric, digits).select("query_id", "item_id", F.round(measure, digits).alias("score"), *carry)
        best = scored.withColumn("vec_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "item_id"))).where(F.col("vec_rank") <= k)
        out = best if out is None else out.unionByName(best)
    return out


def retrieved(found: DataFrame, chunks: DataFrame, chunk_col: str = "chunk_id", synthetic: Column | None = None) -> DataFrame:
    """Results (query_id, item_id, score, rank) with their chunk's columns: `distance` is the raw measure, zero where there is none.

    Blank dates become null; is_synthetic marks rows that stand for tool results instead of stored chunks.
    """
    own = chunks.withColumnRenamed(chunk_col, "item_id")
    rows = found.join(own, "item_id", "left").withColumn("distance", F.coalesce("score", F.lit(0.0)))
    if "period_of_report" in chunks.columns:
        rows = rows.withColumn("period_of_report", F.nullif(F.col("period_of_report").cast("string"), F.lit("")))
    return rows.withColumn("is_synthetic", F.lit(False) if synthetic is None else F.coalesce(synthetic, F.lit(False)))


def effective(explicit: Column, extracted: Column, valid: Column) -> Column:
    """A filter value: the explicit one before what was read out of the question; null, so no filter at all, where any value is invalid."""
    return F.when(valid, F.coalesce(explicit, extracted))


def ingest_plan(requested: DataFrame, present: DataFrame, ticker: str = "ticker", form: str = "doc_type") -> DataFrame:
    """(ticker, doc_type) to fetch: tickers that were asked for and are not among the results; forms that cannot be fetched become 10-K."""
    wanted = requested.select(clean_ticker(F.col(ticker)).alias(ticker), F.coalesce(clamp_doc_type(F.col(form)), F.lit("10-K")).alias(form)).where(F.col(ticker).isNotNull()).distinct()
    return wanted.join(present.select(clean_ticker(F.col(ticker)).alias(ticker)).distinct(), ticker, "left_anti")


def bm25(candidates: DataFrame, query_col: str = "query", text_col: str = "text", keys: Sequence[str] = ("query_id", "item_id"), k1: float = K1, b: float = B, max_candidates: int | None = 1000) -> DataFrame:
    """Candidates with a lexical score; statistics are over the candidates of each query, so these must be fixed before.

    Query terms count once; a query or text without terms scores zero. Where the candidates of a query are a list cut by rank to at most
    `max_candidates` it is folded inside one row, so that candidates are computed and moved once (more raise). With None there may be any
    number of them: counts are aggregated by query and term and joined back, and no query is gathered.
    """
    query, item = keys
    terms, words = F.array_distinct(tokens(F.col(query_col))), tokens(F.col(text_col))
    counted = candidates.withColumn("_words", words).withColumn("_len", F.size("_words")).withColumn("_tf", F.transform(terms, lambda t: F.size(F.filter("_words", lambda w: w == t)))).drop("_words")
    rest = [c for c in candidates.columns if c != query]

    def score(tf: Column, held: Column, length: Column) -> Column:
        def part(tf: Column, df: Column) -> Column:
            idf = F.log1p((F.col("_n") - df + 0.5) / (df + 0.5))
            return F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("_avg")))).otherwise(0.0)

        return F.aggregate(F.zip_with(tf, held, part), F.lit(0.0), lambda s, x: s + x)

    if max_candidates is None:
        sums = counted.groupBy(query).agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"))
        terms_in = counted.select(query, F.posexplode("_tf").alias("_i", "_x")).groupBy(query, "_i").agg(F.count_if(F.col("_x") > 0).alias("_d"))
        held = terms_in.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_d"))), lambda x: x["_d"]).alias("_df"))
        joined = counted.join(sums.join(held, query, "left"), query)
        return joined.select(*candidates.columns, F.coalesce(score(F.col("_tf"), F.col("_df"), F.col("_len")), F.lit(0.0)).alias("lex_score"))
    listed = counted.groupBy(query).agg(F.collect_list(F.struct(*rest, "_len", "_tf")).alias("_c"))
    listed = listed.withColumn("_c", F.when(F.size("_c") <= max_candidates, F.col("_c")).otherwise(F.raise_error(F.lit(f"more than {max_candidates} candidates of one query"))))
    n = F.size("_c")
    mean = F.aggregate("_c", F.lit(0).cast("long"), lambda s, c: s + c["_len"]) / n
    zero = F.transform(F.col("_c")[0]["_tf"], lambda x: F.lit(0))
    held = F.aggregate("_c", zero, lambda s, c: F.zip_with(s, c["_tf"], lambda d, x: d + (x > 0).cast("int")))
    listed = listed.withColumns({"_n": n, "_avg": mean, "_df": held})
    scored = F.transform("_c", lambda c: F.struct(*(c[x].alias(x) for x in rest), score(c["_tf"], F.col("_df"), c["_len"]).alias("lex_score")))
    return listed.select(query, F.inline(scored)).select(*candidates.columns, "lex_score")


def fuse(candidates: DataFrame, query: str = "query_id", first_rank: str = "vec_rank", score: str = "lex_score", k: int = RRF_K, digits: int = 9) -> DataFrame:
    """Reciprocal-rank fusion of a given ranking with that by score; rows without a match are ranked too, ties keep the first ranking."""
    by_score = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(F.round(score, digits)), F.asc(first_rank)))
    fused = candidates.withColumn("lex_rank", by_score).withColumn("rrf", 1 / (F.col(first_rank) + k) + 1 / (F.col("lex_rank") + k))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(F.round("rrf", 12)), F.asc(first_rank))))


def reciprocal_rank_sum(rankings: DataFrame, query: str, item: str, rank: str, k: int = RRF_K) -> DataFrame:
    """Fusion of any number of rankings stacked in one table, ranks from one."""
    return rankings.groupBy(query, item).agg(F.sum(1 / (F.col(rank) + k)).alias("rrf"))


def mmr(candidates: DataFrame, top_k: int, query: str = "query_id", item: str = "item_id", rank: str = "rank", text: str = "text", lam: float = MMR_LAMBDA) -> DataFrame:
    """(query, item, pick): greedy choice by lam x relevance - (1 - lam) x the largest Jaccard similarity to what is chosen.

    Relevance falls evenly with the rank; of equals the better ranked wins. All candidates take part, however many: whoever makes the
    list cuts it by rank, and the choice folds over it inside one row, so fewer picks are a prefix of more. A query without `top_k`
    candidates gives all it has.
    """
    listed = candidates.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(item).alias("i"), F.array_distinct(tokens(F.col(text))).alias("w")))).alias("_c"))
    kind = candidates.schema[item].dataType.simpleString()
    state = f"struct<left:array<struct<r:int,i:{kind},rel:double,sim:double,w:array<string>>>,picked:array<{kind}>>"
    n = F.size("_c")
    start = F.struct(F.transform("_c", lambda c, at: F.struct(c["r"].cast("int").alias("r"), c["i"].alias("i"), ((n - at) / n).alias("rel"), F.lit(0.0).alias("sim"), c["w"].alias("w"))).alias("left"), F.expr(f"cast(array() as array<{kind}>)").alias("picked")).cast(state)

    def value(c: Column) -> Column:
        return c["rel"] * lam - c["sim"] * (1 - lam)

    def step(s: Column, _: Column) -> Column:
        best = F.array_max(F.transform(s["left"], lambda c: F.struct(F.round(value(c), 12).alias("v"), (-c["r"]).alias("o"), c["i"].alias("i"), c["w"].alias("w"))))

        def against(c: Column) -> Column:
            either = F.size(F.array_union(c["w"], best["w"]))
            sim = F.when((F.size(c["w"]) == 0) | (F.size(best["w"]) == 0), 0.0).otherwise(F.size(F.array_intersect(c["w"], best["w"])) / either)
            return F.struct(c["r"].alias("r"), c["i"].alias("i"), c["rel"].alias("rel"), F.greatest(c["sim"], sim).alias("sim"), c["w"].alias("w"))

        rest = F.transform(F.filter(s["left"], lambda c: c["r"] != -best["o"]), against)
        return F.when(F.size(s["left"]) == 0, s).otherwise(F.struct(rest.alias("left"), F.concat(s["picked"], F.array(best["i"])).alias("picked")).cast(state))

    picks = listed.select(query, F.aggregate(F.sequence(F.lit(1), F.lit(top_k)), start, step)["picked"].alias("p"))
    return picks.select(query, F.posexplode("p").alias("pick", item)).withColumn("pick", F.col("pick") + 1)


def search(candidates: DataFrame, top_k: int, **options) -> DataFrame:
    """Candidates (query_id, query, item_id, text, vec_rank) through lexical scores, fusion and diversity to the top k, of any size."""
    pool = candidates.where(F.col("vec_rank") <= max(top_k * OVERFETCH, top_k))
    return mmr(fuse(bm25(pool, max_candidates=1000 if top_k * OVERFETCH <= 1000 else None)), top_k, **options)


def context_text(rows: DataFrame, query: str, order: str, title: Column, payload: Column) -> DataFrame:
    """One row a query: its sources numbered and joined for a prompt."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), title.alias("t"), payload.alias("p"))))
    return rows.groupBy(query).agg(F.array_join(F.transform(listed, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s["t"], F.lit("\n"), s["p"])), "\n\n---\n\n").alias("context"))


def first_seen(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows whose key was not seen before in the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def new_ids(steps: DataFrame, run: str, step: str, ids: str) -> DataFrame:
    """(run, step, new_ids): how many ids of each step no earlier step of its run had; ids that repeat inside a step count once.

    A null or empty list brings none. Each id's first step is found by an aggregate, so no run is gathered.
    """
    seen = steps.select(run, step, F.explode(ids).alias("_id")).where(F.col("_id").isNotNull())
    first = seen.groupBy(run, "_id").agg(F.min(step).alias(step))
    fresh = first.groupBy(run, step).agg(F.count("*").alias("new_ids"))
    return steps.select(run, step).distinct().join(fresh, [run, step], "left").select(run, step, F.coalesce("new_ids", F.lit(0)).cast("long").alias("new_ids"))


def loop_stops(steps: DataFrame, run: str, step: str, signature: str, new_ids: str, max_steps: int = 5) -> DataFrame:
    """(run, step, reason) of the first step that ends a run: the same action twice, a search without new ids, or the last step."""
    w = Window.partitionBy(run).orderBy(step)
    reason = F.when(F.lag(signature).over(w) == F.col(signature), "repeated").when(F.col(new_ids) == 0, "nothing new").when(F.row_number().over(w) >= max_steps, "last step")
    return first_seen(steps.withColumn("reason", reason).where("reason is not null"), [run], step).select(run, step, "reason")


def missing(requested: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested keys, distinct, that are not among the present ones."""
    return requested.select(*keys).distinct().join(present.select(*keys), list(keys), "left_anti")
