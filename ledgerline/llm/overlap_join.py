"""Set-similarity join of documents by word shingles: T-occurrence search over inverted lists by DivideSkip, then components."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import discard, in_map, join_groups, key_map, materialize, shard_count, ship_package, string_bytes
from ledgerline.llm.components import connected_components

#: A word is the sum of random numbers of its bytes, each times a power of the first number; a shingle that of its words, by the second.
_BYTE, _BASE, _MIX = 0x5851F42D4C957F2D, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BYTES = np.arange(256, dtype=np.uint8)
_SPACE = np.isin(_BYTES, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_RANDOM = np.random.default_rng(42).integers(0, 1 << 64, size=256, dtype=np.uint64)
_RANDOM[0x41:0x5B] = _RANDOM[0x61:0x7B]
#: Bytes whose words are hashed at once.
_SEGMENT = 1 << 20
#: Tokens of lists that a task sorts at once; rows of a list that travel as one array; sets of a list from which on it is a crowd.
_LIST_TOKENS, _LIST_ROWS, _CROWD = 1 << 20, 256, 64
#: One in so many of the shingles that a partner needs has to stand among those that are looked at.
_DEPTH = 2
#: With how many others a set of a crowd is compared at first.
_NEIGHBOURS = 32
#: Lists of more sets than this hold them together as a family. Families are compared in blocks of so many shingles, where a set counts for so many at least.
_FAMILY, _BLOCK, _LEAST = 16, 1 << 20, 512
#: Shingles that are columns of one product of matrices; pairs of sets that are counted one by one at once, if that many are left.
_COLUMNS, _SPARSE = 1024, 1 << 22
#: A shingle of so many texts of one batch is taken for a common one.
_COMMON = 16
#: A list's number is its length (that of longer ones is the largest), its part and its place there: so many bits each.
_LENGTH_BITS, _PART_BITS, _PLACE_BITS = 19, 18, 26
#: Bytes of a set's name that travel with an entry. Sets of one short name share lists and are candidates of each other.
_SHORT = 6
#: The first look goes one in so many of the shingles that a partner needs deep, by as many leading bytes of shingles and trailing bytes of names.
_GLANCE, _GLANCE_TOKEN, _GLANCE_NAME = 10, 6, 4


def _powers(base: int) -> np.ndarray:
    out = np.full(_SEGMENT + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BYTE), _powers(pow(_BYTE, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX)
    return h ^ (h >> np.uint64(29))


def _words(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, where they begin) of at most _SEGMENT bytes; a text that begins at one of `begins` ends the word before it."""
    word = ~_SPACE[raw]
    after = np.append(True, ~word[:-1])
    after[begins[begins < len(raw)]] = True
    first = np.flatnonzero(word & after)
    last = np.flatnonzero(word & np.append(~word[1:] | after[1:], True)) + 1
    sums = np.append(np.uint64(0), np.cumsum(_RANDOM[raw] * _DOWN[: len(raw)], dtype=np.uint64))
    return _mixed((sums[last] - sums[first]) * _UP[first] + (last - first).astype(np.uint64)), first


def _word_runs(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the words, words of each text) of texts that stand one after the other, some _SEGMENT bytes at a time."""
    at = 0
    while at < len(offsets) - 1:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _SEGMENT, side="right")) - 1)
        begin, end = int(offsets[at]), int(offsets[stop])
        if end - begin <= _SEGMENT:
            h, first = _words(raw[begin:end], offsets[at:stop] - begin)
            yield h, np.diff(np.searchsorted(first, offsets[at : stop + 1] - begin))
        else:
            # One long text, cut where white space stands; a word of more than a segment is hashed in parts.
            parts = []
            while begin < end:
                cut = min(end, begin + _SEGMENT)
                if cut < end:
                    blank = np.flatnonzero(_SPACE[raw[begin:cut]])
                    cut = begin + int(blank[-1]) + 1 if len(blank) else cut
                parts.append(_words(raw[begin:cut], np.zeros(1, dtype=np.int64))[0])
                begin = cut
            h = np.concatenate(parts)
            yield h, np.array([len(h)])
        at = stop


def _sets(column: pa.BinaryArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit hashes of the shingles of each text, their number): a shorter sequence is one shingle of its own kind."""
    raw, begins, sizes = string_bytes(column.fill_null(b""))
    found = []
    for h, counts in _word_runs(raw, np.append(begins, begins[-1] + sizes[-1] if len(begins) else 0)):
        sums = np.zeros(max(0, len(h) - width + 1), dtype=np.uint64)
        for i in range(width):
            sums = sums * np.uint64(_BASE) + h[i : i + len(sums)]
        sums = _mixed(sums)
        for start, n in zip((np.cumsum(counts) - counts).tolist(), counts.tolist()):
            if n >= width:
                own = np.sort(sums[start : start + n - width + 1])
                found.append(own[np.append(True, own[1:] != own[:-1])])
            else:
                found.append(np.frombuffer(xxhash.xxh64_digest(h[start : start + n].tobytes(), n), dtype=np.uint64) if n else h[:0])
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64), np.array([len(x) for x in found], dtype=np.int64)


def _cut(flat: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else []


def _digest(s: np.ndarray) -> tuple[int, int]:
    """Two halves of a 128-bit digest of a set, signed; the empty set is zero."""
    if not len(s):
        return 0, 0
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
    return int(d[0]), int(d[1])


def required(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap of a set of n with any set at this Jaccard similarity."""
    return -(-n * percent // 100)


def _plan(n: np.ndarray | int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(lists looked at, lists of them set aside) for sets of n shingles.

    A set meets every partner in its first n - T + k shingles of one common order, in k of them at least, T being the least overlap and
    k = max(1, T / _DEPTH). Of these it sets aside the longest lists, half as many as the k of its smallest partner.
    """
    t = required(n, percent)
    return n - t + np.maximum(1, t // _DEPTH), np.maximum(1, required(t, percent) // _DEPTH) // 2


def _shown(n: int, m: int, percent: int) -> int:
    """How many of the lists that both merge a set of n and a partner of m shingles share at least.

    Of the overlap that this pair needs, all but the shingles that one lacks stand among the first ones of the other; of those that
    stand in both, the longest lists are set aside by one or the other, as many as the larger of both numbers.
    """
    need = -(-percent * (n + m) // (100 + percent))
    (p, a), (q, b) = _plan(n, percent), _plan(m, percent)
    return max(1, int(min(p - n, q - m) + need - max(a, b)))


def document_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, text, n, rec, check) for each row: a hash of the text, the number of distinct shingles and both halves of the digest of the set;
    and, with n = -1, (rec, check) = (shingle, count) of shingles that are common in some batch of texts. A null text has no shingle."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"), F.xxhash64(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = _cut(*_sets(b.column(1), width))
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(c, pa.int64()) for c in (zip(*digests) if digests else ((), ())))], names=["id", "text", "n", "rec", "check"])
            own = list(dict(zip(digests, sets)).values())
            if len(own) >= _COMMON:
                token, count = np.unique(np.concatenate(own), return_counts=True)
                token, count = token[count >= _COMMON].view(np.int64), count[count >= _COMMON]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(token), b.schema.field(0).type), pa.nulls(len(token), pa.int64()), pa.array(np.full(len(token), -1)), pa.array(token), pa.array(count.astype(np.int64))], names=["id", "text", "n", "rec", "check"])

    return rows.mapInArrow(run, schema=f"id {kind}, text long, n long, rec long, check long")


def _short_name(rec: Column, width: int = _SHORT) -> Column:
    return rec.bitwiseAND(F.lit((1 << 8 * width) - 1))


def _planes(x: np.ndarray, width: int = 8) -> bytes:
    """The lower `width` bytes of 64-bit numbers, all first ones before all second ones: in order, so that the high bytes of sorted numbers compress."""
    return x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(planes: bytes, width: int = 8) -> np.ndarray:
    out = np.zeros((len(planes) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(planes, dtype=np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _prefix_lists(texts: DataFrame, width: int, percent: int, common: tuple[np.ndarray, np.ndarray], parts: int, glance: bool = False) -> DataFrame:
    """(token, short): entries of the inverted lists of two sets or more, over the first shingles of every set; `token` is the list's
    number, in the order of lengths, and `short` the set's short name.

    With `glance` it is (token, short) = (count, name): for sets by a shorter name how many of their first n - T + k shingles, k = max(1, T / _GLANCE),
    other sets have as well. Heads of shingles and repeats of a set only add to the count.

    The common order is: shingles that are not common by their hash, then the common ones by their count. Entries travel as planes of bytes by
    ranges of shingles; equal sets are one.
    """
    hot, weight = common
    token_width, name_width = (_GLANCE_TOKEN, _GLANCE_NAME) if glance else (8, _SHORT)
    bounds = np.linspace(0, 2.0**64, parts + 1)[1:-1].astype(np.uint64)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, counts = _sets(b.column(0), width)
            t = required(counts, percent)
            firsts = (counts - t + np.maximum(1, t // _GLANCE) if glance else _plan(counts, percent)[0]).tolist()
            at = np.minimum(np.searchsorted(hot, flat), max(len(hot) - 1, 0))
            is_hot = hot[at] == flat if len(hot) else np.zeros(len(flat), dtype=bool)
            # Equal sets of a batch are one.
            tokens, names = [], {}
            for s, late, place, first in zip(_cut(flat, counts), _cut(is_hot, counts), _cut(at, counts), firsts):
                rec = _digest(s)[0]
                if not len(s) or rec in names:
                    continue
                early = s[~late][:first]
                if len(early) < first:
                    rest = s[late]
                    early = np.append(early, rest[np.lexsort((rest, weight[place[late]]))][: first - len(early)])
                names[rec] = len(early)
                tokens.append(early)
            if not tokens:
                continue
            token, name = np.concatenate(tokens), np.repeat(np.array(list(names), dtype=np.int64).view(np.uint64), list(names.values()))
            order = np.argsort(token)
            token, name = token[order], name[order]
            part = np.searchsorted(bounds, token, side="right")
            edges = np.flatnonzero(np.diff(part, prepend=-1))
            out = [(int(part[i]), _planes(token[i:j] >> np.uint64(64 - 8 * token_width), token_width), _planes(name[i:j], name_width)) for i, j in zip(edges, [*edges[1:], len(token)])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int32(), pa.binary(), pa.binary()])], names=["part", "tokens", "names"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], 0
        for b in batches:
            # All rows of a part are in one task, so its number is that of no list elsewhere.
            part = b.column(0)[0].as_py() if b.num_rows else part
            held += [(_numbers(t, token_width), _numbers(n, name_width)) for t, n in zip(*(c.to_pylist() for c in b.columns[1:]))]
        if not held:
            return
        token, name = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(token)
        token, name = token[order], name[order]
        # Shingles of one set go before names are sorted.
        twin = np.append(token[1:] == token[:-1], False)
        twin[1:] |= twin[:-1]
        token, name = token[twin], name[twin]
        if glance:
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, dtype=np.int64)
            several = np.minimum.reduceat(name, starts) != np.maximum.reduceat(name, starts) if len(token) else np.zeros(0, dtype=bool)
            name, count = np.unique(name[np.repeat(several, np.diff(np.append(starts, len(token))))], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(count.astype(np.int64)), pa.array(name.view(np.int64))], names=["token", "short"])
            return
        order = np.lexsort((name, token))
        token, name = token[order], name[order]
        fresh = np.ones(len(token), dtype=bool)
        fresh[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1])
        token, name = token[fresh], name[fresh]
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, dtype=np.int64)
        df = np.diff(np.append(starts, len(token)))
        place = np.repeat(np.arange(len(df), dtype=np.int64), df)
        df = np.repeat(df, df)
        number = np.minimum(df, (1 << _LENGTH_BITS) - 1) << (_PART_BITS + _PLACE_BITS) | part << _PLACE_BITS | place
        shared = np.flatnonzero(df > 1)
        for at in range(0, len(shared), 100_000):
            i = shared[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(number[i]), pa.array(name[i].view(np.int64))], names=["token", "short"])

    rows = texts.mapInArrow(scatter, schema="part int, tokens binary, names binary")
    return rows.repartitionById(parts, F.col("part")).mapInArrow(gather, schema="token long, short long")


def _short_lists(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(token, rec, n, lists) of the lists that each of the sets (rec, n) merges, and their number: the longest of its lists are set aside, and a set
    that shares too few shingles with any other to have a partner is left out."""
    t = F.ceil(F.col("n") * percent / 100)
    least = F.greatest(F.lit(1), F.floor(F.ceil(t * percent / 100) / _DEPTH))
    lists = entries.groupBy("short").agg(F.sort_array(F.collect_list("token")).alias("lists"))
    lists = lists.join(sets.select("rec", "n", "short"), "short").withColumn("least", least.cast("int"))
    kept = lists.where(F.size("lists") >= F.col("least")).withColumn("lists", F.slice("lists", F.lit(1), F.greatest(F.lit(0), F.size("lists") - F.floor(F.col("least") / 2).cast("int"))))
    return kept.select("rec", F.col("n").cast("int").alias("n"), F.size("lists").alias("lists"), F.explode("lists").alias("token"))


def _similar(a: Column, b: Column, percent: int) -> Column:
    """Sizes that any two sets at this similarity have."""
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def _texts(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(t) of the texts whose hashes are in `wanted`, and a few more: a map of the hashes, whose size follows their number up to 2^28 bits, tells most
    other texts before they leave the scan."""
    bits = min(28, max(20, int(wanted.count()).bit_length() + 4))
    keys = key_map(wanted.select(F.xxhash64("text").alias("hash")), bits)
    texts = docs.select(F.col(text_col).cast("binary").alias("t"), F.xxhash64(text_col).alias("text")).where(F.col("t").isNotNull())
    return in_map(texts, keys, F.xxhash64("text"), "maybe", bits).where("maybe").select("t")


def _candidate_sets(docs: DataFrame, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """(rec, n, tokens, marks) of the sets of the texts whose hashes are in `wanted`; `marks` has a bit of four for each shingle.

    Equal texts and sets are brought together by set, so nothing but one row a task and set is moved.
    """
    maybe = _texts(docs, text_col, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = {_digest(s)[0]: s for s in _cut(*_sets(b.column(0), width)) if len(s)}
            offsets = np.cumsum([0, *map(len, own.values())]).astype(np.int32)
            flat = np.concatenate(list(own.values())).view(np.int64) if own else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(np.diff(offsets).astype(np.int64)), lists, pa.array([_marks(s) for s in own.values()], pa.binary())], names=["rec", "n", "tokens", "marks"])

    sets = maybe.mapInArrow(run, schema="rec long, n long, tokens array<long>, marks binary")
    return materialize(sets.groupBy("rec").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("marks").alias("marks")), "overlap-sets")


def _marks(s: np.ndarray) -> bytes:
    """A bit for each shingle in a row of about four times as many bits."""
    bits = min(20, max(8, int(4 * len(s) - 1).bit_length()))
    out = np.zeros(1 << bits, dtype=bool)
    out[s >> np.uint64(64 - bits)] = True
    return np.packbits(out).tobytes()


def _folded(marks: bytes, size: int) -> np.ndarray:
    """Marks of at most `size` bytes: neighbouring bits are one, as a shingle's bit is the head of its hash."""
    x = np.frombuffer(marks, dtype=np.uint8)
    while len(x) > size:
        y = x | x << 1
        y = (y >> 7 & 1) << 3 | (y >> 5 & 1) << 2 | (y >> 3 & 1) << 1 | y >> 1 & 1
        x = y[::2] << 4 | y[1::2]
    return x


def _may_link(n: int, m: int, a: bytes, b: bytes, percent: int) -> bool:
    """False if the marks alone show that sets of n and m shingles overlap too little: a bit that the other lacks is a shingle it lacks."""
    size = min(len(a), len(b))
    x, y = _folded(a, size), _folded(b, size)
    most = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return 100 * most >= percent * (n + m - most)


def _probe(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets overlap enough. Marks of a sixteenth of the size go first; then the shingles of the smaller set are
    looked up by binary search in the larger."""

    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("rec").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, x, y = (c.to_pylist() for c in b.columns[2:])
            yield b.select(["u", "v"]).filter(pa.array([_may_link(*z, percent) for z in zip(n, m, x, y)], pa.bool_()))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            lists = [(c.offsets.to_numpy(), c.values.to_numpy().view(np.uint64)) for c in b.columns[2:]]
            for i in range(b.num_rows):
                x, y = sorted((values[at[i] : at[i + 1]] for at, values in lists), key=len)
                found = np.searchsorted(y, x)
                common = int((y[np.minimum(found, len(y) - 1)] == x).sum())
                kept.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    marked = pairs.select("u", "v").join(side("u", "n", "marks"), "u").join(side("v", "n", "marks"), "v").select("u", "v", "n_u", "n_v", "marks_u", "marks_v")
    maybe = materialize(marked.mapInArrow(sift, schema="u long, v long"), "overlap-maybe")

    def met(name: str) -> DataFrame:
        """The shingles of that side's sets: a map of their names keeps most others where they are."""
        bits = min(28, max(20, int(maybe.count()).bit_length() + 4))
        keys = key_map(maybe.select(F.xxhash64(name).alias("hash")).distinct(), bits)
        return in_map(side(name, "tokens"), keys, F.xxhash64(name), "_met", bits).where("_met").drop("_met")

    return maybe.join(met("u"), "u").join(met("v"), "v").select("u", "v", "tokens_u", "tokens_v").mapInArrow(look_up, schema="u long, v long")


def merge_skip(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(value, count) of what stands in at least `least` of the sorted lists: a heap of their heads, which skips what cannot occur often enough."""
    if least > len(lists):
        return []
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    out = []
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            out.append((top, len(popped)))
            jump = top + 1
        else:
            # Too few: the next heads go too, so that least - 1 lists move on to the value then on top.
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            jump = heap[0][0]
        for _, i, at in popped:
            at = bisect_left(lists[i], jump, at)
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))
    return out


def _in_chunks(lists: DataFrame) -> DataFrame:
    """List entries (token, rec, m), m their number, with the chunk of about _LIST_ROWS sets that holds them."""
    return lists.withColumn("chunk", F.pmod(F.xxhash64("rec", "token"), F.ceil(F.col("m") / _LIST_ROWS)))


def _first_pairs(short: DataFrame, percent: int) -> DataFrame:
    """(u, v) to compare first: each set with the least of every list, and in crowded lists with its neighbours in a random order, some
    _NEIGHBOURS of them over all its lists. That closes dense groups without all their pairs; what it leaves open is searched."""
    heads = short.groupBy("token").agg(F.min(F.struct("rec", "n")).alias("head"), F.count("*").alias("m")).where("m > 1").select("token", F.col("head.rec").alias("v"), F.col("head.n").alias("vn"), "m")
    met = materialize(short.join(heads, "token"), "overlap-met")
    to_head = met.where((F.col("rec") != F.col("v")) & _similar(F.col("n"), F.col("vn"), percent)).select(F.col("rec").alias("u"), "v")
    drawn = met.where((F.col("m") > _CROWD) & (F.pmod(F.xxhash64("token", "rec"), F.col("lists")) < _NEIGHBOURS))
    listed = _in_chunks(drawn).groupBy("token", "chunk").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("token", "rec", F.lit(1)).alias("h"), "rec", "n"))).alias("list"))
    beside = listed.select(F.explode(F.expr("transform(slice(list, 1, size(list) - 1), (x, i) -> struct(x, list[i + 1] as y))")).alias("p"))
    beside = beside.where(_similar(F.col("p.x.n"), F.col("p.y.n"), percent)).select(F.greatest("p.x.rec", "p.y.rec").alias("u"), F.least("p.x.rec", "p.y.rec").alias("v"))
    pairs = materialize(to_head.union(beside).distinct(), "overlap-pairs")
    discard(met)
    return pairs


def _families(open_: DataFrame, block: int) -> DataFrame:
    """(rec, n, label, family, weight) of the sets that long lists of `open_` (token, rec, n, label, m, head) hold together, through any chain; `head`
    is the least set of a list, `family` the least one of all.

    Families are left out where the pairs in their long lists are fewer than the shingles that their blocks move.
    """
    long = open_.where(F.col("m") > _FAMILY)
    groups = connected_components(long.select(F.col("rec").alias("u"), F.col("head").alias("v")).distinct()).select(F.col("node").alias("rec"), F.col("label").alias("family"))
    members = materialize(open_.select("rec", "n", "label").distinct().join(groups, "rec"), "overlap-members")
    met = long.groupBy("token").agg(F.first("m").alias("m"), F.first("head").alias("rec")).join(groups, "rec").groupBy("family").agg(F.sum(F.col("m") * F.col("m")).alias("met"))
    sizes = members.groupBy("family").agg(F.sum(F.greatest(F.col("n"), F.lit(_LEAST))).alias("weight"))
    worth = sizes.join(met, "family").where(F.col("weight") * F.ceil(F.col("weight") / block) <= F.col("met")).select("family", "weight")
    return members.join(worth, "family").select("rec", "n", "label", "family", "weight")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """How many elements each set of `a` and each of `b` (if none, of `a`) have in common. Elements that stand in many sets of both are multiplied as
    columns of matrices, the pairs of the others are counted one by one."""
    other = a if b is None else b
    shape = len(a), len(other)
    out = np.zeros(shape[0] * shape[1], dtype=np.int32)
    ends = len(a) if b is None else len(a) + len(b)
    sets = a if b is None else a + b
    _, of = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(ends), [len(s) for s in sets])
    cut = sum(map(len, a))
    total = int(of.max()) + 1

    def side(of: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(of, kind="stable")
        return of[order], row[order], np.bincount(of, minlength=total)

    of_a, row_a, n_a = side(of[:cut], row[:cut])
    of_b, row_b, n_b = (of_a, row_a, n_a) if b is None else side(of[cut:], row[cut:] - len(a))
    pairs = n_a * n_b
    shared = pairs > 1 if b is None else pairs > 0
    dense = shared & (pairs * _COLUMNS >= len(out))
    columns = np.flatnonzero(dense)
    place = np.cumsum(dense) - 1
    x, y = dense[of_a], dense[of_b]
    col_a, col_b, r_a, r_b = place[of_a[x]], place[of_b[y]], row_a[x], row_b[y]
    for low in range(0, len(columns), _COLUMNS):
        width = min(_COLUMNS, len(columns) - low)
        sides = []
        for col, r, rows in ((col_a, r_a, shape[0]), (col_b, r_b, shape[1])):
            begin, end = np.searchsorted(col, [low, low + width])
            m = np.zeros((rows, width), dtype=np.float32)
            m[r[begin:end], col[begin:end] - low] = 1
            sides.append(m)
        out += (sides[0] @ sides[1].T).astype(np.int32).ravel()
    # What is left: each entry of the one side with the run of its shingle on the other.
    starts = np.cumsum(n_b) - n_b
    z = np.flatnonzero((shared & ~dense)[of_a])
    many = n_b[of_a[z]]
    sums = np.cumsum(many)
    at = 0
    while at < len(z):
        stop = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + _SPARSE, side="right")))
        part, count = z[at:stop], many[at:stop]
        inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        cell = np.repeat(row_a[part], count) * shape[1] + row_b[np.repeat(starts[of_a[part]], count) + inside]
        # Cells repeat, and a plain sum over an index would count each of them once.
        cell, c = np.unique(cell, return_counts=True)
        out[cell] += c.astype(np.int32)
        at = stop
    return out.reshape(shape)


def _linked(a: tuple[list[int], list[int], list[np.ndarray]], b: tuple[list[int], list[int], list[np.ndarray]] | None, percent: int) -> list[tuple[int, int]]:
    """Pairs of sets, given as (names, labels, sets), that overlap enough: one for every two labels, none within a label."""
    other = a if b is None else b
    if len(set(a[1]) | set(other[1])) < 2:
        return []
    common = _overlaps(a[2], None if b is None else b[2])
    n, m = (np.array([len(s) for s in x[2]], dtype=np.int64) for x in (a, other))
    la, lb = (np.array(x[1], dtype=np.int64) for x in (a, other))
    found = {}
    for at in range(0, len(n), _LIST_ROWS):
        c = common[at : at + _LIST_ROWS].astype(np.int64)
        near = (100 * c >= percent * (n[at : at + _LIST_ROWS, None] + m - c)) & (la[at : at + _LIST_ROWS, None] != lb)
        i, j = np.nonzero(near)
        i += at
        once = np.unique(np.stack([np.minimum(la[i], lb[j]), np.maximum(la[i], lb[j])]), axis=1, return_index=True)[1]
        for i, j in zip(i[once].tolist(), j[once].tolist()):
            found[min(a[1][i], other[1][j]), max(a[1][i], other[1][j])] = a[0][i], other[0][j]
    return list(found.values())


def _family_links(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """(u, v) of sets of one family and different labels that overlap enough, one pair at least for every two labels that have some.

    Whole sets are compared, block by block. Large families are dealt to classes of size, of which a set meets its own and the next ones, and these by a hash
    to blocks, so a task holds two blocks of any family.
    """
    base = max(100 / percent, 1.1) * 1.01
    size = F.when(F.col("weight") <= block, F.lit(0)).otherwise(F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(base)))).cast("int")
    rows = members.withColumn("size", size)
    blocks = materialize(rows.groupBy("family", "size").agg(F.ceil(F.sum(F.greatest(F.col("n"), F.lit(_LEAST))) / block).cast("int").alias("own")), "overlap-blocks")
    rows = rows.join(blocks, ["family", "size"])
    for name, step in (("after", -1), ("before", 1)):
        rows = rows.join(blocks.select("family", (F.col("size") + step).alias("size"), F.col("own").alias(name)), ["family", "size"], "left")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rec"), F.col("own")).cast("int"))
    met = F.expr("""flatten(array(
        transform(sequence(0, own - 1), y -> struct(size as c, least(part, y) as i, size as d, greatest(part, y) as j, part > y as late)),
        transform(filter(sequence(0, coalesce(after, 0)), y -> y < coalesce(after, 0)), y -> struct(size as c, part as i, size + 1 as d, y as j, false as late)),
        transform(filter(sequence(0, coalesce(before, 0)), y -> y < coalesce(before, 0)), y -> struct(size - 1 as c, y as i, size as d, part as j, true as late))))""")
    dealt = rows.join(sets.select("rec", "tokens"), "rec").select("rec", "label", "tokens", "family", F.explode(met).alias("met"))
    dealt = dealt.select(F.xxhash64("family", "met.c", "met.i", "met.d", "met.j").alias("task"), "family", "met.c", "met.i", "met.d", "met.j", "met.late", "rec", "label", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: tuple) -> pa.RecordBatch:
            out = _linked(held[0], held[1] if held[1][0] else None, percent) if held[0][0] else []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), ()))], names=["u", "v"])

        key, held = None, None
        for b in batches:
            at, values = b.column(9).offsets.to_numpy(), b.column(9).values.to_numpy().view(np.uint64)
            for i, (*own, late, rec, label) in enumerate(zip(*(c.to_pylist() for c in b.columns[1:9]))):
                if own != key:
                    if key is not None:
                        yield found(held)
                    key, held = own, (([], [], []), ([], [], []))
                for x, y in zip(held[late], (rec, label, values[at[i] : at[i + 1]].copy())):
                    x.append(y)
        if key is not None:
            yield found(held)

    order = ["task", "family", "c", "i", "d", "j"]
    return dealt.repartition(F.col("task")).sortWithinPartitions(*order).mapInArrow(run, schema="u long, v long")


def _search(open_: DataFrame, percent: int) -> DataFrame:
    """(u, v): for every set of `open_` (token, rec, n, label, family, m) the sets of other components and families that its merged lists show often enough; m is
    the length of a list.

    Lists travel in arrays of some _LIST_ROWS sets of like size, and only to sets of like size.
    """
    lists = _in_chunks(open_.repartition(F.col("token"))).groupBy("token", "chunk").agg(F.sort_array(F.collect_list(F.struct("rec", "n", "label", "family"))).alias("list"))
    q = open_.select("token", F.col("rec").alias("q"), F.col("n").alias("qn"), F.col("label").alias("ql"), F.col("family").alias("qf"))
    smaller = "filter(list, x -> x.label <> ql and x.family <> qf and (x.n < qn or x.n = qn and x.rec < q) and 100 * x.n >= " + f"{percent} * qn)"
    met = q.join(lists, "token").select("q", "qn", F.expr(smaller).alias("list")).where(F.size("list") > 0)
    met = met.select("q", "qn", F.col("list.rec").alias("recs"), F.col("list.n").alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(q: int, n: int, lists: list[list[int]], sizes: dict[int, int]) -> list[tuple[int, int]]:
            shown = {m: _shown(n, m, percent) for m in set(sizes.values())}
            return [(q, v) for v, count in merge_skip(lists, min(shown.values())) if count >= shown[sizes[v]]]

        key, n, held, sizes = None, 0, [], {}
        for b in batches:
            out = []
            for q, size, recs, ns in zip(*(c.to_pylist() for c in b.columns)):
                if q != key:
                    if key is not None:
                        out += found(key, n, held, sizes)
                    key, n, held, sizes = q, size, [], {}
                held.append(recs)
                sizes.update(zip(recs, ns))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])
        if key is not None and (out := found(key, n, held, sizes)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])

    return met.repartition(F.col("q")).sortWithinPartitions("q").mapInArrow(run, schema="u long, v long")


def set_links(docs: DataFrame, text_col: str, width: int, percent: int, counted: DataFrame) -> DataFrame:
    """(node, label) for the sets that link with another one, through any chain; label is the least node reachable."""
    spark = docs.sparkSession
    rows, tokens = counted.where(F.col("n") >= 0).agg(F.count("*"), F.sum("n")).first()
    # Order only: common shingles stand last and so are merged by sets of little else. At most 200 of them for each shingle of a mean set.
    often = counted.where(F.col("n") < 0).groupBy("rec").agg(F.sum("check").alias("c")).where(F.col("c") > max(_COMMON, rows // 200)).toPandas().to_numpy(dtype=np.int64).reshape(-1, 2)
    often = often[np.argsort(often[:, 0].view(np.uint64))]
    common = often[:, 0].view(np.uint64).copy(), often[:, 1].copy()
    parts = max(shard_count(spark), -(-int(_plan(100, percent)[0] * (tokens or 0) / 100) // _LIST_TOKENS))
    nodes = materialize(counted.where("n > 0").groupBy("rec").agg(F.first("n").alias("n"), F.min("text").alias("text")).withColumn("short", _short_name(F.col("rec"))), "overlap-named-sets")
    # A first look at fewer shingles turns away most sets: those that share too few of them for any partner, the smallest of which needs `least`.
    all_texts = docs.select(F.col(text_col).cast("binary").alias("t"))
    seen = _prefix_lists(all_texts, width, percent, common, min(parts, 1 << _PART_BITS), glance=True).groupBy("short").agg(F.sum("token").alias("c"))
    t = F.ceil(F.col("n") * percent / 100)
    least = F.greatest(F.lit(1), F.floor(F.ceil(t * percent / 100) / _GLANCE))
    small = nodes.withColumn("g", _short_name(F.col("rec"), _GLANCE_NAME)).join(seen.withColumnRenamed("short", "g"), "g", "left")
    # Sets of one name are not told apart there, so they stay.
    namesakes = F.count("*").over(Window.partitionBy("g"))
    seeds = materialize(small.withColumn("s", namesakes).where((F.col("s") > 1) | (F.col("c") >= least)).select("rec", "n", "text", "short"), "overlap-seeds")
    entries = _prefix_lists(_texts(docs, text_col, seeds), width, percent, common, min(parts, 1 << _PART_BITS))
    short = materialize(_short_lists(entries, seeds, percent), "overlap-lists")

    # Sets of one short name (hardly any) are told apart by nothing but their shingles.
    twins = materialize(nodes.groupBy("short").agg(F.sort_array(F.collect_list("rec")).alias("r")).where(F.size("r") > 1), "overlap-twins")
    alike = twins.select(F.explode("r").alias("u"), "r").select("u", F.explode("r").alias("v")).where("u > v")
    pairs = _first_pairs(short, percent).union(alike)
    wanted = materialize(nodes.join(short.select("rec").union(twins.select(F.explode("r"))).distinct(), "rec", "left_semi").select("rec", "text"), "overlap-wanted")
    sets = _candidate_sets(docs, text_col, width, wanted)
    first = materialize(connected_components(_probe(pairs, sets, percent)), "overlap-first")
    discard(wanted, nodes, seeds)

    # Then the lists that still hold several components.
    named = short.join(first.withColumnRenamed("node", "rec"), "rec", "left").select("token", "rec", "n", F.coalesce("label", "rec").alias("label"))
    named = materialize(named, "overlap-named")
    open_tokens = named.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("m"), F.min("rec").alias("head")).where("a <> b").select("token", "m", "head")
    open_ = materialize(named.join(open_tokens, "token"), "overlap-open")
    discard(short, named)
    # Families are compared as wholes, and lists that hold nothing but one family are done with.
    families = materialize(_families(open_, _BLOCK), "overlap-families")
    within = _family_links(families, sets, percent, _BLOCK)
    strange = open_.join(families.select("rec", "family"), "rec", "left").withColumn("family", F.coalesce("family", "rec"))
    mixed = strange.groupBy("token").agg(F.min("family").alias("a"), F.max("family").alias("b")).where("a <> b").select("token")
    left = materialize(strange.join(mixed, "token").select("token", "rec", "n", "label", "family", "m"), "overlap-left")
    links = materialize(_probe(_search(left, percent), sets, percent).union(within), "overlap-links")
    discard(open_, families, left, sets)
    tops = first.select(F.col("node").alias("x"), F.col("label").alias("top"))
    ends = links.join(tops.withColumnRenamed("x", "u"), "u", "left").withColumn("a", F.coalesce("top", "u")).drop("top")
    ends = ends.join(tops.withColumnRenamed("x", "v"), "v", "left").withColumn("b", F.coalesce("top", "v"))
    second = materialize(connected_components(ends.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("label"), F.col("label").alias("last")), "overlap-second")
    nodes = first.unionByName(second.join(first, second["label"] == first["node"], "left_anti").select(F.col("label").alias("node"), F.col("label")))
    return nodes.join(second, "label", "left").select("node", F.coalesce("last", "label").alias("label"))


def overlap_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (least id reachable over links, itself included).

    A-Z are lower-cased, words are runs without ASCII white space, and a text's set holds its distinct shingles of `width` words; fewer words
    are one shingle. Texts link when their sets have a Jaccard similarity of `percent` hundredths or more. A null, empty or blank text has
    an empty set and is its own component, as is its id. Shingles are told apart by 64-bit hashes, equal sets by 128 bits, and sets are
    compared whole. Repeated rows and equal texts share a component; a null id never is a component's id unless all its ids are null. An
    empty table gives no rows; other columns are not looked at.
    """
    seen = materialize(document_sets(docs, id_col, text_col, width), "overlap-docs")
    rows = seen.where(F.col("n") >= 0)
    if rows.groupBy("rec").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").limit(1).count():
        raise RuntimeError("two sets share the first half of their digest")
    nodes = materialize(rows.where("n > 0").groupBy("rec").agg(F.min("id").alias("least"), F.count("*").alias("c")), "overlap-nodes")
    links = materialize(set_links(docs, text_col, width, percent, seen), "overlap-components")
    named = nodes.join(links.withColumnRenamed("node", "rec"), "rec", "left").select("rec", "least", "c", F.coalesce("label", "rec").alias("label"))
    tops = materialize(named.groupBy("label").agg(F.min("least").alias("top"), F.count("*").alias("members")), "overlap-tops")
    sets = materialize(join_groups(named.select("rec", "c", "label"), tops, "label", "members", nodes.count()).select("rec", "c", "top"), "overlap-sets")
    discard(nodes, links, tops)
    # Empty sets have no node, and so keep their own id.
    out = join_groups(rows.select("id", "n", F.when(F.col("n") > 0, F.col("rec")).alias("rec")), sets, "rec", "c", rows.count())
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("top")).otherwise(F.col("id")).alias("component_id"))
