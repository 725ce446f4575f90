"""Phrase collocations: word suffixes grouped by prefix under a memory budget, one depth-truncated subtree a group, counts from its leaves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import discard, materialize, ship_package

#: Words of the longest phrase: the depth at which suffixes are cut.
DEPTH = 5
UNKNOWN = "und"
#: Ends a piece; no byte of UTF-8.
_END = b"\xff"
_TABLE = bytes(0xFF if c in b".,;:!?\n\v\f\r" else 0x20 if c == 0x09 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Bytes that are split to words at once, suffixes that are sorted at once, slots that travel in one row.
_SEGMENT, _FLUSH, _CHUNK = 1 << 20, 1 << 19, 64


class _Codes(dict):
    """Numbers of words as they come; zero ends a piece."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def _word_codes(text: bytes, codes: _Codes) -> np.ndarray:
    """Numbers of the words of a text, zero where a piece ends; long texts are taken in segments cut at blanks."""
    if _END in text:
        text = text.replace(_END, "�".encode())
    parts, at = [], 0
    while at < len(text):
        stop = len(text) if len(text) - at <= _SEGMENT else max(text.rfind(b" ", at, at + _SEGMENT), text.rfind(b"\n", at, at + _SEGMENT))
        if stop <= at:
            # One word of more than a segment: to the next blank, or the end.
            ends = [x for x in (text.find(b" ", at + _SEGMENT), text.find(b"\n", at + _SEGMENT)) if x >= 0]
            stop = min(ends, default=len(text))
        words = text[at : stop + 1].translate(_TABLE).replace(_END, b" \xff ").split()
        parts.append(np.fromiter(map(codes.__getitem__, words), dtype=np.int64, count=len(words)))
        at = stop + 1
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _suffixes(codes: np.ndarray) -> np.ndarray:
    """For every word the next DEPTH words of its piece, filled with zeros."""
    padded = np.concatenate([codes, np.zeros(DEPTH, dtype=codes.dtype)])
    out = np.zeros((len(codes), DEPTH), dtype=np.int32)
    out[:, 0] = codes
    for d in range(1, DEPTH):
        out[:, d] = np.where(out[:, d - 1] == 0, 0, padded[d : d + len(codes)])
    return out[codes > 0]


@dataclass
class _Part:
    """Suffixes of some texts: the number of the language and the words of each, numbered by `words`."""

    langs: list[str]
    words: list[bytes]
    lang: np.ndarray
    rows: np.ndarray


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[_Part]:
    """Suffixes of batches (lang, text in bytes), about _FLUSH at a time."""
    codes, langs, held, size = _Codes({_END: 0}), {}, [], 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            rows = _suffixes(_word_codes(text.as_py() or b"", codes))
            # A long text is handed on in slices: suffixes of one text are independent of each other.
            for at in range(0, len(rows), _FLUSH):
                own = rows[at : at + _FLUSH]
                held.append((langs.setdefault(lang, len(langs)), own))
                size += len(own)
                if size >= _FLUSH:
                    yield _Part(list(langs), list(codes), np.repeat(np.array([x for x, _ in held], dtype=np.int64), [len(r) for _, r in held]), np.concatenate([r for _, r in held]))
                    held, size = [], 0
            if not held:
                codes, langs = _Codes({_END: 0}), {}
    if held:
        yield _Part(list(langs), list(codes), np.repeat(np.array([x for x, _ in held], dtype=np.int64), [len(r) for _, r in held]), np.concatenate([r for _, r in held]))


def _prefix_hashes(part: _Part) -> Iterator[np.ndarray]:
    """Hashes of language and first word, of these and the second word, and so on."""
    word = np.array([xxhash.xxh64_intdigest(w) for w in part.words], dtype=np.uint64)
    word[0] = 0
    h = np.array([xxhash.xxh64_intdigest(x, 1) for x in part.langs] or [0], dtype=np.uint64)[part.lang]
    for d in range(DEPTH):
        h = (h ^ word[part.rows[:, d]]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        yield h


def _sorted(lang: np.ndarray, rows: np.ndarray, base: int) -> np.ndarray:
    """The order of suffixes by language and words; up to 2^21 words, three to five of them are compared as one number."""
    if max(base, int(lang.max(initial=0)) + 1) <= 1 << 21:
        low, high = (a << 42 | b << 21 | c for a, b, c in (rows[:, 2:].T.astype(np.int64), (lang, *rows[:, :2].T.astype(np.int64))))
        return np.lexsort((low, high))
    return np.lexsort((*rows.T[::-1], lang))


def _branches(lang: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """For each depth whether a sorted suffix differs there, or above, from the one before it: where the nodes of that depth begin."""
    new = np.ones(len(rows), dtype=bool)
    new[1:] = lang[1:] != lang[:-1]
    for d in range(DEPTH):
        new = new.copy()
        new[1:] |= rows[1:, d] != rows[:-1, d]
        yield new


@dataclass(frozen=True)
class Groups:
    """Vertical partition: for every prefix length the group of each slot of prefixes, or -1 where the slot exceeds the budget and its
    prefixes are extended by a word; `level` is the prefix length of each group."""

    bits: int
    of: tuple[np.ndarray, ...]
    level: np.ndarray

    def find(self, part: _Part) -> np.ndarray:
        out = np.full(len(part.rows), -1, dtype=np.int32)
        for h, groups in zip(_prefix_hashes(part), self.of):
            left = out < 0
            out[left] = groups[(h[left] >> np.uint64(64 - self.bits)).astype(np.int64)]
        return out


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("binary").alias("text"))


def vertical_partition(texts: DataFrame, budget: int) -> tuple[Groups, DataFrame]:
    """(groups of prefixes, (lang, n)): every suffix is counted by slots of its prefixes of one to DEPTH words.

    Slots of at most `budget` suffixes are packed into groups of that size; the prefixes of larger ones are extended by the next word.
    The counts that reach the driver are DEPTH times at most 2^20 numbers. At full depth equal suffixes are one row of a task.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, 4 * size / 6 / budget))), 12, 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, words = np.zeros((DEPTH, 1 << bits), dtype=np.int64), {}
        for part in _parts(batches):
            for x, c in zip(part.langs, np.bincount(part.lang, minlength=len(part.langs)).tolist()):
                words[x] = words.get(x, 0) + c
            for d, h in enumerate(_prefix_hashes(part)):
                sums[d] += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        rows = [(d, at, None, 0, chunk.tobytes()) for d in range(DEPTH) for at, chunk in enumerate(sums[d].reshape(-1, _CHUNK)) if chunk.any()]
        rows += [(DEPTH, 0, x, c, b"") for x, c in words.items()]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["level", "chunk", "lang", "n", "sums"])

    counted = materialize(texts.mapInArrow(count, schema="level int, chunk int, lang string, n long, sums binary"), "phrase-slots")

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(_CHUNK, dtype=np.int64)
        for x in rows.column("sums").to_pylist():
            total += np.frombuffer(x, dtype=np.int64)
        return pa.table({"level": rows.column("level")[:1], "chunk": rows.column("chunk")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    sums = np.zeros((DEPTH, 1 << bits), dtype=np.int64)
    for r in counted.where(F.col("level") < DEPTH).groupBy("level", "chunk").applyInArrow(add, schema="level int, chunk int, sums binary").collect():
        sums[r["level"], r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["sums"], dtype=np.int64)
    totals = materialize(counted.where(F.col("level") == DEPTH).groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    discard(counted)
    of, level, heavy = [], [], True
    for d in range(DEPTH):
        groups = np.full(1 << bits, -1, dtype=np.int32)
        fits = (sums[d] <= budget) if d < DEPTH - 1 else np.ones(1 << bits, dtype=bool)
        if heavy:
            run = 0
            for slot in np.flatnonzero(fits & (sums[d] > 0)):
                if not run or run + sums[d, slot] > budget:
                    level.append(d + 1)
                    run = 0
                run += int(sums[d, slot])
                groups[slot] = len(level) - 1
            heavy = not fits.all()
        of.append(groups)
    return Groups(bits, tuple(of), np.array(level, dtype=np.int32)), totals


def _width(words: int) -> type:
    """The type of word numbers in a row of so many words."""
    return np.uint16 if words <= 1 << 16 else np.int32


def _scatter(texts: DataFrame, groups: Groups) -> DataFrame:
    """(grp, lang, words, rows, counts): the suffixes of a task by group, equal ones counted; words are numbered inside a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            order = _sorted(part.lang, part.rows, len(part.words))
            lang, rows = part.lang[order], part.rows[order]
            *_, new = _branches(lang, rows)
            first = np.flatnonzero(new)
            counts = np.diff(np.append(first, len(rows)))
            own = _Part(part.langs, part.words, lang[first], rows[first])
            place = groups.find(own) * np.int64(len(part.langs)) + own.lang
            order = np.argsort(place, kind="stable")
            edges = np.flatnonzero(np.diff(place[order], prepend=-1))
            out = []
            for start, stop in zip(edges, [*edges[1:], len(order)]):
                at = order[start:stop]
                used, code = np.unique(np.append(own.rows[at].ravel(), 0), return_inverse=True)
                out.append((int(place[at[0]]) // len(part.langs), part.langs[int(own.lang[at[0]])], b" ".join(part.words[w] for w in used[1:]), code[:-1].astype(_width(len(used))).tobytes(), counts[at].astype(np.int64).tobytes()))
            kinds = [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
            for at in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 256]), kinds)], names=["grp", "lang", "words", "suffixes", "counts"])

    return texts.mapInArrow(run, schema="grp int, lang string, words binary, suffixes binary, counts binary")


def _subtrees(scattered: DataFrame, groups: Groups, least: int) -> DataFrame:
    """(lang, phrase, len, f, whole) for the nodes of each group's subtree.

    Nodes at least as deep as the group's prefixes are counted whole, and only those of at least `least` occurrences are given; nodes
    above them lie in several groups, each of which gives its share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, langs, held, level = _Codes({b"": 0}), {}, [], 1
        for b in batches:
            for grp, lang, words, suffixes, counts in zip(*(c.to_pylist() for c in b.columns)):
                level = int(groups.level[grp])
                own = np.array([0, *map(codes.__getitem__, words.split(b" "))], dtype=np.int32) if words else np.zeros(1, dtype=np.int32)
                rows = own[np.frombuffer(suffixes, dtype=_width(len(own)))].reshape(-1, DEPTH)
                held.append((np.full(len(rows), langs.setdefault(lang, len(langs)), dtype=np.int64), rows, np.frombuffer(counts, dtype=np.int64)))
        if not held:
            return
        words, names = list(codes), list(langs)
        lang, rows, counts = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = _sorted(lang, rows, len(words))
        lang, rows, counts = lang[order], rows[order], counts[order]
        for d, new in enumerate(_branches(lang, rows)):
            first = np.flatnonzero(new)
            total = np.add.reduceat(counts, first)
            whole = d + 1 >= level
            # A node without a word at this depth stands for suffixes that end above it.
            kept = np.flatnonzero((total >= (least if whole else 1)) & (rows[first, d] > 0))
            for at in range(0, len(kept), 10_000):
                part = kept[at : at + 10_000]
                phrases = [b" ".join(words[w] for w in rows[i, : d + 1]) for i in first[part]]
                arrays = [pa.array([names[x] for x in lang[first[part]]], pa.string()), pa.array(phrases, pa.binary()), pa.array([d + 1] * len(part), pa.int32()), pa.array(total[part]), pa.array([whole] * len(part))]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "phrase", "len", "f", "whole"])

    return scattered.repartitionById(max(1, len(groups.level)), F.col("grp")).mapInArrow(run, schema="lang string, phrase binary, len int, f long, whole boolean")


def frequent_phrases(docs: DataFrame, least: int = 100, text_col: str = "text", lang_col: str = "lang", budget: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, len, f) of phrases of 1 to 5 words with f >= `least`, (lang, n) of all word occurrences).

    A-Z are lower-cased; pieces end at . , ; : ! ? and line ends; words are parted by blanks and tabs; bytes that are no UTF-8 are
    replacement characters. f counts every contiguous occurrence inside a piece. A null language is `und`; a null or empty text has no word; repeated rows count
    each time; an empty table gives no rows. Long texts are taken whole. A group holds some `budget` suffixes, however often a phrase repeats.
    """
    ship_package(docs.sparkSession)
    texts = _texts(docs, text_col, lang_col)
    groups, totals = vertical_partition(texts, budget)
    nodes = materialize(_subtrees(_scatter(texts, groups), groups, least), "phrase-nodes")
    shared = nodes.where("not whole").groupBy("lang", "phrase", "len").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    found = nodes.where("whole").select("lang", "phrase", "len", "f").unionByName(shared)
    found = materialize(found.withColumn("phrase", F.col("phrase").cast("string")), "phrases")
    discard(nodes)
    return found, totals


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang", budget: int = 1 << 20) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of 2 to 5 words of each language.

    A phrase of a occurrences cut after its first k words scores floor(1000 a n / (l r)), l and r the occurrences of both parts and n
    those of all words; its lowest cut counts, of equals that with the least k. A phrase inside a longer one that occurs as often is
    dropped. Order: score and a descending, then the phrase by its bytes. Products are decimals of 38 digits. Texts, nulls,
    repeated rows and empty tables are taken as `frequent_phrases` says; other columns are not looked at.
    """
    phrases, totals = frequent_phrases(docs, least, text_col, lang_col, budget)
    long_ = phrases.where("len > 1")
    cuts = long_.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("len") - 1))).withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substr(phrase, length(head) + 2)"))
    part = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("count"))
    heads, rests = part.select("lang", F.col("part").alias("head"), F.col("count").alias("l")), part.select("lang", F.col("part").alias("rest"), F.col("count").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).join(totals, "lang")
    exact = "cast({} as decimal(19, 0))".format
    scored = scored.withColumn("score", F.expr(f"(1000 * ({exact('f')} * {exact('n')})) div ({exact('l')} * {exact('r')})"))
    best = scored.groupBy("lang", "phrase").agg(F.first("f").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Every phrase of two words or more inside a longer one, with the occurrences of the latter.
    inner = long_.withColumn("w", F.split("phrase", " ")).withColumn("size", F.explode(F.expr("filter(sequence(2, 4), x -> x < len)"))).withColumn("at", F.explode(F.expr("sequence(1, len - size + 1)")))
    inner = inner.groupBy("lang", F.array_join(F.expr("slice(w, at, size)"), " ").alias("phrase")).agg(F.max("f").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
