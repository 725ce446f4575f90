"""SentencePiece encoding with byte offsets: normalisation by the compiled character map keeps the source of every byte."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from ledgerline.llm.common import gather, scatter, ship_package, string_bytes, text_groups
from ledgerline.llm.pair_merge import MAX_SYMBOLS, PairMerger

_SPACE_BYTES = "▁".encode()
_INNER = re.compile("[^▁]▁")


class CharMap:
    """The compiled map of a model: a double array of prefixes, each leading to its replacement."""

    def __init__(self, blob: bytes) -> None:
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist()
        self.targets = blob[4 + size :]
        root = self._offset(self.units[0])
        #: Bytes with which some prefix begins; others are copied without a search.
        self.heads = frozenset(c for c in range(256) if root ^ c < len(self.units) and self.units[root ^ c] & 0x800000FF == c)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest prefix of data[at:] in the map."""
        node, found, units = self._offset(self.units[0]), None, self.units
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                target = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.targets[target : self.targets.index(b"\0", target)])
        return found


class Normalizer:
    """Text to normalised bytes and, for each of them, the place of its source in the text's UTF-8 bytes."""

    def __init__(self, spec, symbols: Sequence[str] = ()) -> None:
        """`symbols` are the user-defined pieces, which no rule changes."""
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.symbols = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(symbols, key=len, reverse=True))) if symbols else None
        #: Nothing but spaces changes, and every text by itself.
        self.plain = self.map is None and not self.squeeze and self.escape and not symbols

    def all(self, raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(normalised bytes, their sources, bytes by text, end of the used part by text) of texts that stand one after the other."""
        if not self.plain:
            parts = [self(raw[a : a + n].tobytes()) for a, n in zip(begins.tolist(), sizes.tolist())]
            body = np.frombuffer(b"".join(p[0] for p in parts), dtype=np.uint8)
            return body, np.concatenate([*(p[1][:-1] for p in parts), np.zeros(0, dtype=np.int64)]), np.array([len(p[0]) for p in parts], dtype=np.int64), np.array([p[1][-1] for p in parts], dtype=np.int64)
        mark = len(_SPACE_BYTES)
        wide = np.where(raw == 32, mark, 1)
        head = np.where(sizes > 0, mark if self.prefix else 0, 0)
        starts = begins[sizes > 0]
        # The mark before a text goes in front of its first byte, as copies of that which are overwritten.
        if self.prefix:
            wide[starts] += mark
        ends = np.cumsum(wide)
        at = np.repeat(np.arange(len(raw)), wide)
        body = raw[at]
        spaces = (ends - mark)[raw == 32]
        fronts = (ends - wide)[starts] if self.prefix else starts[:0]
        for i, c in enumerate(_SPACE_BYTES):
            body[spaces + i] = c
            body[fronts + i] = c
        lengths = np.add.reduceat(np.append(wide, 0), begins) if len(begins) else head
        lengths = np.where(sizes > 0, lengths, 0)
        return body, at - np.repeat(begins, lengths), lengths, sizes

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised, source): source has one number more than there are bytes, the end of the text that was used."""
        if not data:
            return b"", np.zeros(1, dtype=np.int64)
        mark = _SPACE_BYTES if self.escape else b" "
        out, source, at, end = bytearray(), [], 0, len(data)
        if self.squeeze:
            while at < end:
                used, piece = self._unit(data, at)
                if piece != b" ":
                    break
                at += used
            if at == end:
                return b"", np.array([end], dtype=np.int64)
        if self.prefix:
            out += mark
            source += [at] * len(mark)
        spaced = self.squeeze
        while at < end:
            used, piece = self._unit(data, at)
            while spaced and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                for c in piece:
                    if c == 32:
                        out += mark
                        source += [at] * len(mark)
                    else:
                        out.append(c)
                        source.append(at)
                spaced = piece.endswith(b" ")
            at += used
            if not self.squeeze:
                spaced = False
        last = at
        if self.squeeze:
            while out.endswith(mark) and out:
                last = source[len(out) - len(mark)]
                del out[len(out) - len(mark) :]
                del source[len(out) :]
        return bytes(out), np.array([*source, last], dtype=np.int64)

    def _unit(self, data: bytes, at: int) -> tuple[int, bytes]:
        if self.symbols and (own := self.symbols.match(data, at)):
            return own.end() - at, own[0]
        first = data[at]
        if self.map is not None and first in self.map.heads and (found := self.map.longest(data, at)):
            return found
        n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return n, data[at : at + n]


@dataclass(frozen=True)
class Encoded:
    """The pieces of a group of texts: ids and byte spans, one text after the other, and the number of pieces of each text."""

    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    def split(self, values: np.ndarray) -> list[np.ndarray]:
        return np.split(values, np.cumsum(self.counts)[:-1]) if len(self.counts) else []


class Codec:
    """Normalises texts, encodes the normalised bytes exactly as the library does and projects each piece to its source bytes.

    What is encoded is this module's normalisation: the library serves a copy of the model that normalises nothing. Where no
    piece reaches from a letter over a following space mark, each distinct word of a group of texts is encoded once, all words
    together, by merging the neighbours that make the best piece; words with a character that is no piece, and models of another
    kind, go to that copy of the model.
    """

    def __init__(self, path: str) -> None:
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.lib.serialized_model_proto())
        if model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that mark the ends of words are not known here")
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece.Type
        self.normalize = Normalizer(model.normalizer_spec, [p.piece for p in model.pieces if p.type == kind.USER_DEFINED])
        self.lengths = np.array([1 if p.type == kind.BYTE else len(p.piece.encode()) for p in model.pieces], dtype=np.int64)
        self.unknown = self.lib.unk_id()
        self.by_word = model.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE and model.trainer_spec.byte_fallback and self.normalize.escape and not any(p.type in (kind.USER_DEFINED, kind.UNUSED) or _INNER.search(p.piece) for p in model.pieces)
        if self.by_word:
            self._tables({p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == kind.NORMAL})
        spec = model.normalizer_spec
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def _tables(self, pieces: dict[str, tuple[int, float]]) -> None:
        """Pairs of pieces that make a piece, ranked by its score, and the ids of single characters by code point."""
        order = {score: rank for rank, score in enumerate(sorted({s for _, s in pieces.values()}, reverse=True))}
        left, right, rank, made = [], [], [], []
        for piece, (i, score) in pieces.items():
            for at in range(1, len(piece)):
                if piece[:at] in pieces and piece[at:] in pieces:
                    left.append(pieces[piece[:at]][0])
                    right.append(pieces[piece[at:]][0])
                    rank.append(order[score])
                    made.append(i)
        # Two characters that are no pieces cannot be told apart here.
        self.by_word = all(c in pieces for p in pieces for c in p)
        self.merge = PairMerger(left, right, rank, made)
        self.chars = np.full(0x110000, -1, dtype=np.int32)
        for piece, (i, _) in pieces.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = i

    def _words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by word) for distinct words."""
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), dtype="<u4")
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
        symbols = self.chars[points]
        fine = (sizes <= MAX_SYMBOLS) & (np.minimum.reduceat(symbols, np.cumsum(sizes) - sizes) >= 0)
        ids, counts = self.merge(symbols[np.repeat(fine, sizes)], sizes[fine])
        slow = np.flatnonzero(~fine)
        others = [np.array(x, dtype=np.int32) for x in self.bare.encode(words.take(pa.array(slow)).to_pylist(), num_threads=1)] if len(slow) else []
        return scatter(len(words), [(np.flatnonzero(fine), ids, counts), (slow, np.concatenate([*others, ids[:0]]), np.array([len(x) for x in others], dtype=np.int64))])

    def encode_all(self, texts: pa.StringArray) -> Encoded:
        """Pieces with their spans in the UTF-8 bytes of each text; pieces made of one character share its span. A null counts as empty."""
        body, source, lengths, used = self.normalize.all(*string_bytes(texts.fill_null("")))
        stops = np.cumsum(lengths)
        if self.by_word:
            at_mark = np.zeros(len(body) + 3, dtype=bool)
            at_mark[: max(0, len(body) - 2)] = (body[:-2] == _SPACE_BYTES[0]) & (body[1:-1] == _SPACE_BYTES[1]) & (body[2:] == _SPACE_BYTES[2])
            # A word begins at a mark that does not follow another, and where a text does.
            first = at_mark[: len(body)].copy()
            first[3:] &= ~at_mark[: max(0, len(body) - 3)]
            first[(stops - lengths)[lengths > 0]] = True
            cuts = np.flatnonzero(first)
            words = pa.StringArray.from_buffers(len(cuts), pa.array(np.append(cuts, len(body)).astype(np.int32)).buffers()[1], pa.py_buffer(body)).dictionary_encode()
            ids, counts = gather(*self._words(words.dictionary), words.indices.to_numpy()) if len(cuts) else (np.zeros(0, dtype=np.int32), cuts)
            counts = np.diff(np.append(0, np.cumsum(counts))[np.append(0, np.searchsorted(cuts, stops))])
            sizes = self.lengths[ids]
        else:
            rows = [bytes(body[z - n : z]).decode() for z, n in zip(stops.tolist(), lengths.tolist())]
            found = [self.bare.encode(t) for t in rows]
            ids, counts = np.array([i for f in found for i in f], dtype=np.int32), np.array([len(f) for f in found], dtype=np.int64)
            sizes = self.lengths[ids]
            if (ids == self.unknown).any():
                sizes = np.array([1 if self.bare.is_byte(i) else len(p.encode()) for t, f in zip(rows, found) for i, p in zip(f, self.bare.encode(t, out_type=str))], dtype=np.int64)
        ends = np.cumsum(sizes)
        if (ends[-1] if len(ends) else 0) != len(body):
            raise ValueError("the pieces do not cover the normalised text")
        # A piece ends where the next one begins, the last of a text where its used part ends.
        begin = source[ends - sizes]
        end = np.append(begin[1:], 0)
        some = counts > 0
        end[np.cumsum(counts)[some] - 1] = used[some]
        return Encoded(ids, begin, end, counts)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, end) of one text."""
        got = self.encode_all(pa.array([text], pa.string()))
        return got.ids, got.begins, got.ends

    def decode(self, ids: np.ndarray) -> str:
        return self.lib.decode(ids.tolist())


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids, begins, ends (byte spans in the text's UTF-8 form).

    Texts are encoded whole; a null or empty text has no piece. Repeated rows give repeated results, an empty table none; other
    columns are not looked at. Rows come in the order of `docs`.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for part, texts in text_groups(batches):
            got = c.encode_all(texts)
            bounds = pa.array(np.append(0, np.cumsum(got.counts)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (got.ids, got.begins, got.ends)]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["id", "ids", "begins", "ends"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, schema=f"id {kind}, ids array<int>, begins array<int>, ends array<int>").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256, spans_crc32, exact.

    Encodes with offsets and decodes each whole text. ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the
    decoded text in UTF-8; spans_crc32 is over the spans, and `exact` says that the decoded text is the text. Null texts are empty and
    have no piece; repeated rows give repeated results, an empty table none; other columns are not looked at. Texts are worked
    on in groups of some megabytes, a longer one by itself.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for part, texts in text_groups(batches):
            got, rows = c.encode_all(texts), []
            for text, ids, begins, ends in zip(texts, *map(got.split, (got.ids, got.begins, got.ends))):
                back, ids = (c.decode(ids), ids.tolist())
                rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), zlib.crc32(np.stack([begins, ends]).astype("<i8").tobytes()), back == (text.as_py() or "")))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32", "exact"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, schema=f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long, exact boolean").withColumnRenamed("id", id_col)
