"""Watchlists: membership, dashboard rows, snapshots and what changed since the last one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import first_line, fixed, moved, strip, verdict


def add_tickers(watched: DataFrame, new: DataFrame) -> DataFrame:
    """Both lists, cleaned, each ticker once with its earliest time; blanks are left out."""
    clean = F.upper(strip(F.col("ticker")))
    return watched.unionByName(new).withColumn("ticker", clean).where("ticker <> ''").groupBy("ticker").agg(F.min("added_at").alias("added_at")).orderBy("ticker")


def remove_tickers(watched: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the tickers of `gone`; the same call drops their snapshots."""
    return watched.join(gone.select(F.upper(strip(F.col("ticker"))).alias("ticker")), "ticker", "left_anti")


def read_snapshots(rows: DataFrame, payload: str, schema: str) -> DataFrame:
    """(ticker, snapshot) from JSON text; unreadable text is null."""
    return rows.select("ticker", F.when(F.try_parse_json(payload).isNotNull(), F.from_json(payload, schema)).alias("snapshot"))


def snapshot_rows(rows: DataFrame, taken_at: Column, key: str = "ticker") -> DataFrame:
    """(ticker, taken_at, data): each row's metrics, labels and filing date as JSON text."""
    names = [c for c in rows.columns if c != key]
    return rows.select(F.upper(strip(F.col(key).cast("string"))).alias("ticker"), taken_at.alias("taken_at"), F.to_json(F.struct(*names)).alias("data"))


def save_snapshots(stored: DataFrame, taken: DataFrame) -> DataFrame:
    """Stored snapshots with those just taken in place of older ones: one row a ticker."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(taken.withColumn("_new", F.lit(1)))
    return both.groupBy("ticker").agg(F.max_by(F.struct("taken_at", "data"), F.struct("_new", "taken_at")).alias("s")).select("ticker", "s.*")


def run_dashboard(valued: DataFrame, signals: DataFrame, stored: DataFrame, taken_at: Column, schema: str, latest_filed: Column | None = None, enrichments: dict[str, DataFrame] | None = None, key: str = "ticker") -> tuple[DataFrame, DataFrame]:
    """(rows, snapshots): dashboard rows with what changed since the stored snapshot, and the snapshots to keep.

    `schema` is that of a snapshot: the columns of a row that are kept. `latest_filed` is the newest filing date known elsewhere; a row
    says whether that is newer than what was ingested.
    """
    rows = dashboard(valued, signals, enrichments, key)
    names = [f.split()[0] for f in schema.replace(", ", ",").split(",")]
    now = rows.select(key, *names)
    before = read_snapshots(stored, "data", schema).where("snapshot is not null").select(F.col("ticker").alias(key), "snapshot.*")
    moved_by = changes(now, before, key).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "change"))), lambda x: x["change"]), "; ").alias("changes"))
    out = rows.join(moved_by, key, "left").withColumn("changes", F.coalesce("changes", F.lit("")))
    if latest_filed is not None:
        out = out.withColumn("newer_filing", has_newer_filing(latest_filed, F.col("ingested_filing_date")))
    return out, save_snapshots(stored, snapshot_rows(now, taken_at, key))


def changes(current: DataFrame, previous: DataFrame, key: str = "ticker") -> DataFrame:
    """(key, pos, change): moves of five metrics, new and cleared labels, a newer filing; nothing where there is no previous snapshot."""
    both = current.alias("c").join(previous.alias("p"), key)

    def move(name: str, label: str, digits: int, unit: str, scale: float = 1.0, tolerance: float = 0.05) -> Column:
        now, then = F.col(f"c.{name}"), F.col(f"p.{name}")
        return F.when(moved(now, then, tolerance), F.concat(F.lit(f"{label} "), fixed(then * scale, digits), F.lit(f"{unit} to "), fixed(now * scale, digits), F.lit(unit)))

    moves = [move("pe", "P/E", 1, "x"), move("dcf_upside", "DCF gap", 0, "%", 100, 0.10), move("net_margin", "Net margin", 1, "%", 100), move("revenue_growth_yoy", "Rev growth", 1, "%", 100), move("net_debt_to_ebitda", "Leverage", 1, "x")]
    none = F.array().cast("array<string>")
    now, then = F.coalesce("c.signal_labels", none), F.coalesce("p.signal_labels", none)
    new = F.transform(F.array_sort(F.array_except(now, then)), lambda s: F.concat(F.lit("New signal: "), s))
    gone = F.transform(F.array_sort(F.array_except(then, now)), lambda s: F.concat(F.lit("Cleared: "), s))
    filing = F.when(F.col("c.ingested_filing_date") > F.col("p.ingested_filing_date"), F.concat(F.lit("New filing ingested ("), F.col("c.ingested_filing_date").cast("string"), F.lit(")")))
    return both.select(key, F.posexplode(F.array_compact(F.concat(F.array(*moves), new, gone, F.array(filing)))).alias("pos", "change"))


def dashboard(valued: DataFrame, signals: DataFrame, enrichments: dict[str, DataFrame] | None = None, key: str = "ticker") -> DataFrame:
    """One row an entity: verdict, flags as text, key metrics and the first lines of what is known besides, by left joins on the key."""
    own = signals.where("dimension <> 'valuation'").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("label", F.lit(" ("), "detail", F.lit(")")).alias("t")))).alias("_s"), F.array_sort(F.collect_set("label")).alias("signal_labels"))
    out = valued.join(own, key, "left").withColumn("verdict", verdict(F.col("dcf_upside")))
    flag = F.when(F.col("verdict").isNotNull(), F.concat(F.initcap("verdict"), F.lit(" vs DCF")))
    out = out.withColumn("flags", F.concat_ws("; ", flag, F.array_join(F.transform("_s", lambda x: x["t"]), "; "))).drop("_s")
    for name, frame in (enrichments or {}).items():
        out = out.join(frame.select(key, first_line(F.col("text")).alias(name)), key, "left")
    return out


def has_newer_filing(latest: Column, ingested: Column) -> Column:
    return F.coalesce(latest > ingested, F.lit(False))
