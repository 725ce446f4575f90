"""SimHash near-duplicates: Golay fuzzy keys of fingerprint segments, joined, verified and closed to components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import discard, join_groups, materialize, row_key, ship_package, without_rows
from ledgerline.llm.components import connected_components
from ledgerline.llm.golay import decode, near_indices

#: Bits of each byte value, lowest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLANE = 256 * np.arange(8)
_STEP = 65536


def simhash(text: bytes, width: int, seed: int) -> int:
    """Signed 64-bit fingerprint of a text in UTF-8; zero without a word."""
    words = text.lower().split()
    if not words:
        return 0
    counts = np.zeros((8, 8), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(b" ".join(words), seed)]
        n = 1
        counts += _tally(np.array(hashes, dtype=np.uint64))
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
        stops = ends[width - 1 :].tolist()
        n = len(starts)
        for at in range(0, n, _STEP):
            counts += _tally(np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + _STEP], stops[at : at + _STEP])], dtype=np.uint64))
    bits = (2 * counts > n).ravel()
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _tally(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit: row j has the bits of byte j."""
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLANE).ravel(), minlength=2048).reshape(8, 256)
    return seen @ _BITS


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, carry: Sequence[Column] = ()) -> DataFrame:
    """(id, fp) for each row, then the `carry` columns: the SimHash over XXH64 of the shingles of `width` words, repeats included.

    A null, empty or blank text has the fingerprint zero; null and repeated ids are handed on; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"), *carry)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name != "t"}
    extra = [c for c in kinds if c != "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(t.as_py() or b"", width, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], names=["id", "fp", *extra])

    return rows.mapInArrow(run, schema=", ".join([f"id {kinds['id']}", "fp long", *(f"{c} {kinds[c]}" for c in extra)]))


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) pairs such that any two fingerprints within four bits share a key.

    Segments: A and B of 23 bits, decoded by the Golay code, and C of 18 bits. By the errors (a, b, c) of a pair:
    c = 0: A or B has at most two, keys C + index. a = 0 or b = 0 and c <= 1: keys A or B + an exact half of C.
    a, b <= 2 and c <= 1: indices of A and B + half of C. a = 0 or b = 0, the other <= 2: keys A or B + index of the other.
    a, b <= 1 and c <= 2: indices of A and B + an exact third of C. Nothing else sums to four.
    """
    u = fps.view(np.uint64)
    seg = {"a": u & np.uint64(0x7FFFFF), "b": (u >> np.uint64(23)) & np.uint64(0x7FFFFF), "c": u >> np.uint64(46)}
    n = len(u)
    a, a2, a1 = near_indices(seg["a"])
    b, b2, b1 = near_indices(seg["b"])
    halves = [seg["c"] & np.uint64(0x1FF), seg["c"] >> np.uint64(9)]
    thirds = [(seg["c"] >> np.uint64(6 * i)) & np.uint64(0x3F) for i in range(3)]
    both = ((a << np.uint64(12))[:, :, None] | b[:, None, :]).reshape(n, 36)
    # Errors two in both segments leave none for C, which the first groups cover.
    wide = ((a2[:, :, None] & b1[:, None, :]) | (a1[:, :, None] & b2[:, None, :])).reshape(n, 36)
    tight = (a1[:, :, None] & b1[:, None, :]).reshape(n, 36)
    all1 = np.ones((n, 1), dtype=bool)
    groups = [
        (seg["c"][:, None] << np.uint64(12) | a, a2),
        (seg["c"][:, None] << np.uint64(12) | b, b2),
        *(((seg["a"] << np.uint64(9) | h)[:, None], all1) for h in halves),
        *(((seg["b"] << np.uint64(9) | h)[:, None], all1) for h in halves),
        *((both << np.uint64(9) | h[:, None], wide) for h in halves),
        (seg["a"][:, None] << np.uint64(12) | b, b2),
        (seg["b"][:, None] << np.uint64(12) | a, a2),
        *((both << np.uint64(6) | t[:, None], tight) for t in thirds),
    ]
    rows, keys = [], []
    for tag, (values, here) in enumerate(groups):
        r, c = np.nonzero(here)
        rows.append(r)
        keys.append((values[r, c] | np.uint64(tag) << np.uint64(40)).view(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(fps), 1024):
            part = fps[at : at + 1024]
            rows, keys = fuzzy_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["bucket", "fp"])


def _near(a: str, b: str, bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


#: Beyond this many fingerprints the members of a bucket are not joined pairwise but by four of eight parts of their bits.
_CROWD = 256
_FOURS = list(combinations(range(8), 4))


def _halves(members: DataFrame) -> DataFrame:
    """(bucket, fp, label, part, bits) for the members (bucket, fp, label) of crowds: where they meet.

    A bucket's key fixes part of the bits, so what tells its members apart is counted: bits are ordered by how evenly the bucket has
    zeros and ones there and dealt to eight parts in turn. Four errors leave four of the eight parts exact, so members that link share one of
    the 70 choices of four, each of which holds half of the bits that differ.
    """
    ones = [F.sum(F.expr(f"shiftrightunsigned(fp, {i}) & 1")) for i in range(64)]
    counted = members.groupBy("bucket").agg(F.array(*ones).alias("ones"), F.count("*").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ones = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, 64)
            order = np.argsort(np.abs(2 * ones - b.column(4).to_numpy(zero_copy_only=False)[:, None]), axis=1, kind="stable")
            masks = np.stack([(np.uint64(1) << order[:, i::8].astype(np.uint64)).sum(axis=1, dtype=np.uint64) for i in range(8)])
            for part, four in enumerate(_FOURS):
                bits = fps & np.bitwise_or.reduce(masks[list(four)], axis=0)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.full(len(fps), part, dtype=np.int32)), pa.array(bits.view(np.int64))], names=["bucket", "fp", "label", "part", "bits"])

    return members.join(counted, "bucket").select("bucket", "fp", "label", "ones", "size").mapInArrow(run, schema="bucket long, fp long, label long, part int, bits long")


def fingerprint_links(fps: DataFrame, crowd: int = _CROWD) -> DataFrame:
    """(node, label) for the distinct fingerprints of column fp that link, through any chain, at four or fewer bits.

    Keys meet in one shuffle; a window keeps buckets with two different fingerprints. First each member is checked
    against the least of its bucket, which gives one row a member and closes dense groups; then only buckets that still
    hold two components are joined pairwise, and only between components. Of a bucket of more than `crowd` such members only those meet
    that agree in half of the bits that tell them apart (see _halves). So every link between different texts counts towards the
    components while a group of m copies gives m rows, not m squared. An empty table has no links; null fingerprints are not allowed.
    """
    keys = fps.select("fp").mapInArrow(_emit, schema="bucket long, fp long")
    bucket = "min(fp) over (partition by bucket)", "max(fp) over (partition by bucket)"
    met = keys.selectExpr("bucket", "fp", f"{bucket[0]} as low", f"{bucket[1]} as high").where("low <> high").drop("high")
    met = materialize(met, "golay-met")
    first = materialize(connected_components(met.where(_near("fp", "low", 4)).select(F.col("fp").alias("u"), F.col("low").alias("v"))), "golay-first")
    named = met.select("bucket", "fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select("bucket", "fp", F.coalesce("label", "fp").alias("label"))
    over = "over (partition by bucket)"
    open_ = named.selectExpr("bucket", "fp", "label", f"min(label) {over} as l", f"max(label) {over} as h", f"count(*) {over} as m").where("l <> h").select("bucket", "fp", "label", "m")
    open_ = materialize(open_, "golay-crowds")
    some = open_.where(F.col("m") <= crowd).select("bucket", "fp", "label", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("bits"))
    split = materialize(some.unionByName(_halves(open_.where(F.col("m") > crowd).select("bucket", "fp", "label"))), "golay-open")
    discard(open_)
    open_ = split
    discard(met)
    other = open_.select("bucket", "part", "bits", F.col("fp").alias("fp2"), F.col("label").alias("label2"))
    pairs = open_.join(other, ["bucket", "part", "bits"]).where((F.col("label") < F.col("label2")) & _near("fp", "fp2", 4))
    second = connected_components(pairs.select(F.col("label2").alias("u"), F.col("label").alias("v")))
    second = materialize(second.select(F.col("node").alias("label"), F.col("label").alias("top")), "golay-second")
    discard(open_)
    # Fingerprints that only the second pass links are their own first label.
    nodes = first.unionByName(second.join(first, second["label"] == first["node"], "left_anti").select(F.col("label").alias("node"), F.col("label")))
    return nodes.join(second, "label", "left").select("node", F.coalesce("top", "label").alias("label"))


def component_tops(rows: DataFrame, least: Column) -> DataFrame:
    """(fp, top, c) for each fingerprint of column fp: the least value of `least` over the rows of its component, and its own rows.

    Rows that repeat a fingerprint are one node; nulls of `least` count only where a component has nothing else. An empty table gives no rows.
    """
    # Equal fingerprints are one node, whatever the size of their group.
    nodes = materialize(rows.groupBy("fp").agg(F.min(least).alias("least"), F.count("*").alias("c")), "golay-nodes")
    links = materialize(fingerprint_links(nodes), "golay-links")
    named = nodes.join(links.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "c", F.coalesce("label", "fp").alias("label"))
    tops = materialize(named.groupBy("label").agg(F.min("least").alias("top"), F.sum("c").alias("members")), "golay-tops")
    # A component may hold any share of the fingerprints.
    out = join_groups(named.select("fp", "c", "label"), tops, "label", "members", nodes.count())
    out = materialize(out.select("fp", "top", "c"), "golay-named")
    discard(nodes, links, tops)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (least id reachable over links, itself included).

    A-Z are lower-cased, words are runs without ASCII white space, and shingles of `width` words count with repeats;
    fewer words make one shingle, no word (null, empty, blank) the fingerprint zero, which links like any other.
    Fingerprints link at four or fewer different bits. Repeated rows and equal texts share a fingerprint and a
    component; a null id never is a component's id unless all its ids are null. Empty tables give no rows; other columns
    are ignored. Texts are read whole, one at a time.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, width, seed), "golay-fp")
    joined = join_groups(rows, component_tops(rows, F.col("id")), "fp", "c", rows.count())
    return joined.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("top").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns, of which one a component stays: that with the component's least id.

    Rows are told apart by id and text, so every component keeps exactly one row, whatever ids others have. Of rows that tie in
    the id that with the least hash of id and text stays, of rows that tie in both any one. Rows whose id is null stay only if no
    other row of the component has an id. Texts without a word are one component; an empty table gives no rows. Texts that
    have no near copy are not shuffled; every text, however long, is read whole.
    """
    key = row_key(F.col(id_col), F.col(text_col))
    found = materialize(fingerprints(docs, id_col, text_col, carry=[key.alias("key")], **options), "golay-fp")
    named = component_tops(found, F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    judged = join_groups(found, named, "fp", "c", found.count()).select("key", (F.col("key") == F.col("top.key")).alias("kept"))
    judged = materialize(judged.groupBy("key").agg(F.first("kept").alias("kept"), F.count("*").alias("n")), "golay-judged")
    discard(found, named)
    return without_rows(docs, key, judged.where("not kept").select("key"), judged.where("kept and n > 1").select("key"))
