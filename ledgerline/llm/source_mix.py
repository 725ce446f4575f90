"""Temperature mixing of sources: tempered shares, a bisected exponent, and budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, shard_count, small_side

#: A run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def unit_tokens(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, twin, n_tokens); rows that share id and source are one unit, and without an id rows that share text and source, whose
    digest is `twin`. A null source is the empty name, a null text has no token."""
    n = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), _source(source_col), _twin(id_col, text_col), n.alias("n_tokens"))
    return rows.groupBy("id", "source", "twin").agg(F.sum("n_tokens").alias("n_tokens"))


def _source(source_col: str) -> Column:
    return F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")


def _twin(id_col: str, text_col: str) -> Column:
    return F.when(F.col(id_col).isNull(), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("twin")


def source_shares(units: DataFrame) -> DataFrame:
    """(source, tokens, share); shares are null if there is no token at all."""
    sums = materialize(units.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "mix-sums")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    return sums.select("source", "tokens", F.try_divide(F.col("tokens").cast("double"), F.lit(float(total))).alias("share"))


def _midpoints(lo: float, hi: float, depth: int) -> list[float]:
    mid = (lo + hi) / 2
    return [mid] if depth == 1 else [*_midpoints(lo, mid, depth - 1), mid, *_midpoints(mid, hi, depth - 1)]


def mixing_exponent(shares: DataFrame, target_entropy: float | None = None, max_repeat: float | None = None, steps: int = 40) -> float:
    """The largest exponent in [0, 1] that meets the aims; 1 keeps the shares, 0 makes them equal.

    `target_entropy` is a fraction of the largest entropy, ln(number of sources with tokens): the exponent falls until
    the entropy of the weights reaches it. `max_repeat` bounds how much more often one source is repeated than
    another and wins over the entropy. Bisection takes `steps` halvings; each job evaluates the midpoints of the next four.
    """
    used = shares.where("share > 0")
    n, low, high = used.agg(F.count("*"), F.min("share"), F.max("share")).first()
    if n < 2:
        return 1.0

    def entropy(alphas: list[float]) -> list[float]:
        sums = [f(F.pow("share", F.lit(a))) for a in alphas for f in (lambda x: F.sum(x), lambda x: F.sum(x * F.ln("share")))]
        got = used.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
        return [math.log(got[2 * i]) - a * got[2 * i + 1] / got[2 * i] for i, a in enumerate(alphas)]

    def repeat(alphas: list[float]) -> list[float]:
        return [(high / low) ** (1 - a) for a in alphas]

    def bisect(measure, fine) -> float:
        """The largest exponent for which `fine` holds; it holds below and fails above."""
        if fine(measure([1.0])[0]):
            return 1.0
        lo, hi = 0.0, 1.0
        for _ in range(0, steps, 4):
            tree = _midpoints(lo, hi, 4)
            good = dict(zip(tree, map(fine, measure(tree))))
            for _ in range(4):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if good[mid] else (lo, mid)
        return lo

    alpha = 1.0
    if target_entropy is not None:
        alpha = bisect(entropy, lambda h: h >= target_entropy * math.log(n))
    if max_repeat is not None:
        # Repetition falls as the exponent grows: bisect the complement.
        alpha = max(alpha, 1.0 - bisect(lambda xs: repeat([1 - x for x in xs]), lambda r: r <= max_repeat))
    return alpha


def source_budgets(shares: DataFrame, alpha: float, budget: int | None = None) -> DataFrame:
    """(source, tokens, weight, repeats, whole, rest): normalised weights, passes over the source, whole passes and tokens left.

    Without a budget it is the least that takes every document once. A source without tokens has weight zero and one pass.
    Sources that tie in tokens tie in weight; no source gives no rows.
    """
    used = shares.where("share > 0")
    norm, least = used.agg(F.sum(F.pow("share", F.lit(alpha))), F.max(F.pow("share", F.lit(1 - alpha)))).first()
    norm, least = norm or 1.0, least or 1.0
    total = shares.agg(F.sum("tokens")).first()[0] or 0
    tokens = float(budget) if budget is not None else total * least * norm
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(alpha)) / F.lit(norm)).otherwise(0.0)
    repeats = F.when(F.col("share") > 0, F.lit(tokens) * F.col("weight") / F.col("tokens")).otherwise(1.0)
    whole = F.floor(F.col("repeats") + F.lit(1e-9)).cast("long")
    rest = F.round((F.col("repeats") - F.col("whole")) * F.col("tokens")).cast("long")
    return shares.select("source", "tokens", "share", weight.alias("weight")).withColumn("repeats", repeats).withColumn("whole", whole).withColumn("rest", F.greatest(rest, F.lit(0)).cast("long"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = 0.95, max_repeat: float | None = 2.0, budget: int | None = None, block_tokens: int = 32_768, max_blocks: int = 65_536, seed: int = 17, broadcast_rows: int = 100_000) -> DataFrame:
    """One row per unit and pass: id, source, twin (see unit_tokens), n_tokens, weight, repeats, epoch, block, position, mix_order.

    Every pass over a source is a permutation of its own: units fall into blocks by a hash of (seed, pass, id), blocks
    follow each other by number and units inside a block by the rest of the hash. The last, partial pass takes the units
    that begin before its rest of the budget is used up. `position` is the token offset inside the pass and
    `mix_order` in [0, 1] the offset in the source's budget: sorted by it, every stretch holds the sources in proportion
    to their weights. Running sums stay inside one block, so a source with a third of all rows is spread over its blocks.

    Units without tokens join the passes and take no budget. Rows that repeat an id and source are one unit; null sources are
    one source of the empty name; rows without an id are told apart by their text. Empty tables give no rows; other columns are ignored.
    """
    units = materialize(unit_tokens(docs, id_col, text_col, source_col), "mix-units")
    shares = source_shares(units)
    alpha = mixing_exponent(shares, target_entropy, max_repeat)
    budgets = materialize(source_budgets(shares, alpha, budget), "mix-budgets")
    side = F.broadcast(budgets) if small_side(budgets, broadcast_rows) else budgets

    epochs = F.when(F.col("rest") > 0, F.col("whole")).otherwise(F.col("whole") - 1)
    copies = units.join(side, "source").where(epochs >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs)))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("id").cast("string"), F.col("twin"))).cast("binary"))
    blocks = F.least(F.lit(max_blocks), F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(block_tokens))))
    copies = copies.withColumn("_h", digest).withColumn("block", (F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % blocks).cast("long"))

    # Running sums: over the block totals of a pass, then over the units of a block.
    inner = copies.selectExpr("*", "sum(n_tokens) over (partition by source, epoch, block order by _h, id, twin rows unbounded preceding) - n_tokens as _in")
    sums = copies.groupBy("source", "epoch", "block").agg(F.sum("n_tokens").alias("_n"))
    starts = materialize(sums.selectExpr("source", "epoch", "block", "sum(_n) over (partition by source, epoch order by block rows unbounded preceding) - _n as _start"), "mix-blocks")
    placed = inner.join(F.broadcast(starts) if small_side(starts, broadcast_rows) else starts, ["source", "epoch", "block"])
    placed = placed.withColumn("position", F.col("_start") + F.col("_in")).where((F.col("epoch") < F.col("whole")) | (F.col("position") < F.col("rest")))
    order = F.try_divide(F.col("epoch") * F.col("tokens") + F.col("position"), F.col("repeats") * F.col("tokens"))
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "twin", "n_tokens", "weight", "repeats", "epoch", "block", "position", F.coalesce(order, F.lit(0.0)).alias("mix_order"))


def written_order(docs: DataFrame) -> Column:
    """Where a row stands in a table that was written in order and is read back: by the number of its file, and then inside the file.

    Spark numbers the files of a write by partition, and reads them in any order. 2^25 partitions of up to 64 files with 2^32 rows each are
    told apart. A table that is not read from files stands as it comes.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta.getField("file_name"))
    except AnalysisException:
        return F.monotonically_increasing_id()
    name = meta.getField("file_name")
    part, piece = F.regexp_extract(name, r"part-(\d+)", 1).cast("long"), F.regexp_extract(name, r"-c(\d+)", 1).try_cast("long")
    return F.shiftleft(part, 38) + F.shiftleft(F.coalesce(piece, F.lit(0)), 32) + meta.getField("row_index")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of `docs`, all columns, once for each pass that takes them, dealt and sorted by mix_order.

    mix_order is even over [0, 1] in tokens, so slices of it make even partitions without sampling. Rows that share id and source are taken
    together, without an id those that share the text; texts without a token come in every pass, long ones whole. An empty table gives no rows.
    """
    plan = mix_plan(docs, id_col, text_col, source_col, **options)
    plan = materialize(plan.select(F.col(id_col).alias("plan_id"), F.col(source_col).alias("plan_source"), F.col("twin").alias("plan_twin"), "mix_order"), "mix-plan")
    # The whole row travels as one struct, so that no column of it can clash with a name used here.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), _source(source_col), _twin(id_col, text_col))
    out = rows.join(plan, F.col("id").eqNullSafe(F.col("plan_id")) & (F.col("source") == F.col("plan_source")) & F.col("twin").eqNullSafe(F.col("plan_twin")))
    n = shard_count(docs.sparkSession)
    slot = F.least(F.lit(n - 1), F.floor(F.col("mix_order") * n)).cast("int")
    return out.withColumn("slot", slot).repartitionById(n, F.col("slot")).sortWithinPartitions("mix_order", "id").select("row.*")
