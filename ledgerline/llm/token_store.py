"""Token-id files: documents compressed one by one with a shared zstandard dictionary, and an offset index."""

from __future__ import annotations

import hashlib
import itertools
import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from ledgerline.llm.common import discard, gather, materialize, publish, range_shards, scatter, shard_count, ship_package, string_bytes, text_groups, whole_numbers, with_shard
from ledgerline.llm.pair_merge import MAX_SYMBOLS, PairMerger

#: File: header, frames, index, footer. Header: magic, id width in bytes, SHA-256 of the dictionary (zeros: none).
_MAGIC = b"LLTK0001"
_HEADER = struct.Struct("<8sB32s")
#: Index columns, one number a document: id, has an id, offset of the frame, tokens. Footer: offset of the index, documents, magic.
_INDEX = (("doc_id", "<i8"), ("known", "u1"), ("offset", "<u8"), ("n_tokens", "<u8"))
_FOOTER = struct.Struct("<QQ8s")
_MANIFEST = "file string, temp string, n_docs long, n_tokens long, n_bytes long, first_id long, last_id long, sha256 string"
#: Fixed value: the pattern whose pieces `_cut` finds by character class.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of these characters are in normal form, and lower case keeps them so.
_PLAIN = "^[!-~¡-¬®-ÿ]+$"
_LETTER, _NUMBER, _MARK = 0, 1, 2


def _class_of(code: int) -> int:
    char = chr(code)
    return _LETTER if char.isalpha() else _NUMBER if char.isnumeric() else _MARK


#: Class of a character of one byte, and of one of two bytes that begins with C2 or C3, by its second byte.
_ONE = np.array([_class_of(c) for c in range(128)] + [_MARK] * 128, dtype=np.int8)
_TWO = {lead: np.array([_MARK] * 128 + [_class_of((lead & 3) << 6 | c & 0x3F) for c in range(128, 192)] + [_MARK] * 64, dtype=np.int8) for lead in (0xC2, 0xC3)}


def _cut(raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pieces of plain words without apostrophes begin: at each word, change of class and number."""
    kind = _ONE[raw]
    after = np.append(raw[1:], np.uint8(0))
    for lead, table in _TWO.items():
        at = np.flatnonzero(raw == lead)
        kind[at] = table[after[at]]
        kind[at + 1] = kind[at]
    first = np.ones(len(raw), dtype=bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    first[begins] = True
    return np.flatnonzero(first & (raw & 0xC0 != 0x80))


class WordEncoder:
    """Encodes texts exactly as the tokenizer does, each distinct word of a group of texts once.

    Holds for tokenizers whose pre-tokenizer drops white space and cuts by the common pattern, so that no token and no rule reaches
    across white space; others are encoded whole. Words of plain Latin characters, which no normal form changes, are cut to pieces,
    and all distinct pieces are merged together by the tokenizer's own table of merges; all other words go through the
    tokenizer as they are.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        model = spec["model"]
        self.by_word = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in splits] == ["Split", "ByteLevel"] and splits[0]["invert"] and splits[0]["behavior"] == "Removed" and not splits[1]["add_prefix_space"]
        self.by_word = self.by_word and splits[0]["pattern"].get("Regex") == _PIECES and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
        if self.by_word:
            self.added = [t["content"] for t in spec["added_tokens"]]
            self.level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
            pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
            self.merge = PairMerger([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], range(len(pairs)), [vocab[a + b] for a, b in pairs])
            # Ids of a byte inside a piece and at its end; the bytes of plain words are all among them.
            self.inner, self.last = np.full(256, -1, dtype=np.int32), np.full(256, -1, dtype=np.int32)
            for code in range(256):
                for byte, spelled in zip(chr(code).encode(), self.level.pre_tokenize_str(chr(code))[0][0]):
                    self.inner[byte], self.last[byte] = vocab.get(spelled, -1), vocab.get(spelled + end, -1)

    def _ids(self, word: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype=np.int32)

    def _pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by piece) for distinct pieces."""
        raw, begins, sizes = string_bytes(pieces)
        symbols = self.inner[raw]
        symbols[begins + sizes - 1] = self.last[raw[begins + sizes - 1]]
        # Pieces that are long, or have a byte without an id, are the tokenizer's own work.
        fine = (sizes <= MAX_SYMBOLS) & (np.minimum.reduceat(symbols, begins) >= 0)
        ids, counts = self.merge(symbols[np.repeat(fine, sizes)], sizes[fine])
        slow = np.flatnonzero(~fine)
        others = [np.array([t.id for t in self.tokenizer.model.tokenize(self.level.pre_tokenize_str(pieces[i].as_py())[0][0])], dtype=np.int32) for i in slow.tolist()]
        return scatter(len(pieces), [(np.flatnonzero(fine), ids, counts), (slow, np.concatenate([*others, ids[:0]]), np.array([len(x) for x in others], dtype=np.int64))])

    def _words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by word) for distinct words."""
        plain = pc.match_substring_regex(words, _PLAIN)
        for t in [*self.added, "'"]:
            plain = pc.and_not(plain, pc.match_substring(words, t))
        simple = plain.to_numpy(zero_copy_only=False)
        rest = [self._ids(w) for w in words.filter(pc.invert(plain)).to_pylist()]
        parts = [(np.flatnonzero(~simple), np.concatenate([*rest, np.zeros(0, dtype=np.int32)]), np.array([len(x) for x in rest], dtype=np.int64))]
        if simple.any():
            raw, begins, _ = string_bytes(pc.utf8_lower(words.filter(plain)))
            cuts = _cut(raw, begins)
            offsets = pa.array(np.append(cuts, len(raw)).astype(np.int32))
            pieces = pa.StringArray.from_buffers(len(cuts), offsets.buffers()[1], pa.py_buffer(raw)).dictionary_encode()
            ids, counts = self._pieces(pieces.dictionary)
            ids, counts = gather(ids, counts, pieces.indices.to_numpy())
            # Ids by word, from those by piece.
            ends = np.append(0, np.cumsum(counts))[np.searchsorted(cuts, np.append(begins, len(raw)))]
            parts.append((np.flatnonzero(simple), ids, np.diff(ends)))
        return scatter(len(words), parts)

    def encode_all(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of each text as little-endian integers of self.width bytes; a null counts as empty."""
        if not self.by_word:
            return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        words = lists.flatten().dictionary_encode()
        # Text without a word but for the empty one at its ends keeps that; it has no id.
        ids, counts = gather(*self._words(words.dictionary), words.indices.to_numpy())
        ends = np.append(0, np.cumsum(counts))[np.append(0, np.cumsum(lists.value_lengths().to_numpy()))] * self.width
        data = ids.astype(self.kind).tobytes()
        return [data[a:z] for a, z in itertools.pairwise(ends.tolist())]

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process, which keeps its words from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def train_dictionary(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, sample_docs: int, max_ids: int, dict_bytes: int) -> bytes:
    """A dictionary trained on the serialized ids of at most `sample_docs` documents, the least by a hash of id and text.

    Of a long document `max_ids` ids from a place drawn by the hash are taken. Null and empty texts teach nothing, rows that repeat each
    other count as one. Empty if the sample is too small to train on.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).where(F.octet_length("t") > 0)
    n = texts.count()
    if not n:
        return b""
    space = 1 << 30
    hashed = texts.select(F.pmod(F.xxhash64("id", "t"), F.lit(space)).alias("h"), "t")
    # The threshold keeps about twice what is wanted; the order then makes the choice exact. Few rows are all looked at.
    drawn = hashed.where(F.col("h") < min(space, max(2 * sample_docs, 1000) * space // n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for part, texts in text_groups(batches):
            rows = []
            for h, ids in zip(part.column(0).to_pylist(), enc.encode_all(texts)):
                spare = max(0, len(ids) // enc.width - max_ids)
                first = h % (spare + 1) * enc.width
                rows.append(ids[first : first + max_ids * enc.width])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], names=["h", "ids"])

    samples = [bytes(r["ids"]) for r in drawn.mapInArrow(run, schema="h long, ids binary").distinct().orderBy("h", "ids").limit(sample_docs).collect()]
    try:
        return zstandard.train_dictionary(min(dict_bytes, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class _ShardWriter:
    """Writes one file a shard; a file is rolled once its frames have reached `roll_bytes`."""

    def __init__(self, root: str, width: int, dict_hash: bytes, roll_bytes: int) -> None:
        self.store, self.base = fs.FileSystem.from_uri(root)
        self.head = _HEADER.pack(_MAGIC, width, dict_hash)
        self.roll, self.attempt, self.done, self.out, self.shard = roll_bytes, uuid.uuid4().hex, [], None, -1

    def add(self, shard: int, doc_id: int | None, n_tokens: int, frame: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        elif self.out is not None and self.size >= self.roll:
            self.close()
        if self.out is None:
            self.file = f"tokens-{shard:06d}-{self.number:04d}.lltk"
            self.temp = f"_temporary/{self.file}.{self.attempt}"
            self.out, self.sum, self.size, self.index = self.store.open_output_stream(f"{self.base}/{self.temp}", compression=None), hashlib.sha256(), 0, []
            self.number += 1
            self._write(self.head)
        self.index.append((doc_id or 0, doc_id is not None, self.size, n_tokens))
        self._write(frame)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is None:
            return
        at = self.size
        for (_, kind), column in zip(_INDEX, zip(*self.index)):
            self._write(np.array(column, dtype=kind).tobytes())
        self._write(_FOOTER.pack(at, len(self.index), _MAGIC))
        self.out.close()
        ids = [x[0] for x in self.index if x[1]]
        self.done.append((self.file, self.temp, len(self.index), sum(x[3] for x in self.index), self.size, min(ids, default=None), max(ids, default=None), self.sum.hexdigest()))
        self.out = None


def write_tokens(docs: DataFrame, root: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 1024, max_ids: int = 4096, dict_bytes: int = 112_640, level: int = 3, roll_bytes: int = 256 << 20) -> dict:
    """Encode every whole text, append `end_id`, and write token files below `root` in ascending order of id. Returns the manifest.

    Each document is one zstandard frame over its ids, compressed with the shared dictionary, so that one short document can be
    read through the index alone. Rows are encoded and compressed where they are read; only frames are shuffled, into ranges of
    ids of about equal size. Ids are whole numbers of at most 64 bits (others raise). A null text counts as empty (its only id is the
    end); a null id sorts first; rows that repeat an id are all written, in order of a hash of their frames, and spread over
    shards where they are many. Long texts are held one at a time. An empty table gives a manifest without files. Tasks write
    temporary names, the driver renames those that counted and writes the manifest last.
    """
    spark = docs.sparkSession
    ship_package(spark)
    whole_numbers(docs, id_col)
    shared = train_dictionary(docs, tokenizer, id_col, text_col, sample_docs, max_ids, dict_bytes)
    digest = hashlib.sha256(shared).digest() if shared else bytes(32)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.kind).tobytes()
        press = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(shared))
        for part, texts in text_groups(batches):
            ids = [x + end for x in enc.encode_all(texts)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // enc.width for x in ids], pa.int64()), pa.array([press.compress(x) for x in ids], pa.binary())], names=["id", "n", "frame"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    frames = materialize(rows.mapInArrow(pack, schema="id long, n long, frame binary"), "token-frames")
    hashed = frames.withColumn("hash", F.xxhash64("frame"))
    shards = range_shards(hashed, "id", "hash", F.octet_length("frame") + F.lit(32), shard_count(spark))
    dealt = with_shard(hashed, "id", "hash", shards, "shard").sortWithinPartitions("shard", "id", "hash", "frame").select("id", "n", "frame", "shard")
    width = WordEncoder(tokenizer).width

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _ShardWriter(root, width, digest, roll_bytes)
        for b in batches:
            for doc_id, n, frame, shard in zip(*(b.column(i).to_pylist() for i in range(4))):
                out.add(shard, doc_id, n, frame)
        out.close()
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out.done)) or [()] * 8, kinds)], names=[f.split()[0] for f in _MANIFEST.split(", ")])

    store, base = fs.FileSystem.from_uri(root)
    store.create_dir(f"{base}/_temporary", recursive=True)
    files = sorted((r.asDict() for r in dealt.mapInArrow(write, schema=_MANIFEST).collect()), key=lambda r: r["file"])
    publish(store, base, [(entry.pop("temp"), entry["file"]) for entry in files])
    start = 0
    for entry in files:
        entry["start"] = start
        start += entry["n_tokens"]
    store.delete_dir(f"{base}/_temporary")
    discard(frames)
    manifest = {"width": width, "dictionary": digest.hex() if shared else None, "files": files}
    for name, data in (("dictionary.zdict", shared), ("manifest.json", json.dumps(manifest, indent=0).encode())):
        with store.open_output_stream(f"{base}/{name}.tmp", compression=None) as out:
            out.write(data)
        store.move(f"{base}/{name}.tmp", f"{base}/{name}")
    return manifest


def _load(root: str) -> tuple[fs.FileSystem, str, dict, bytes]:
    store, base = fs.FileSystem.from_uri(root)
    with store.open_input_stream(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())
    with store.open_input_stream(f"{base}/dictionary.zdict", compression=None) as f:
        shared = f.read()
    if (hashlib.sha256(shared).hexdigest() if shared else None) != manifest["dictionary"]:
        raise ValueError("the dictionary is not the one that the files were written with")
    return store, base, manifest, shared


def _index(f: pa.NativeFile, manifest: dict) -> dict[str, np.ndarray]:
    """The index of an open file, after its header and footer are checked; offset has the end of the last frame too."""
    size = f.size()
    magic, width, digest = _HEADER.unpack(f.read_at(_HEADER.size, 0))
    at, n, end = _FOOTER.unpack(f.read_at(_FOOTER.size, size - _FOOTER.size))
    if magic != _MAGIC or end != _MAGIC or width != manifest["width"] or (digest.hex() if any(digest) else None) != manifest["dictionary"]:
        raise ValueError("not a token file of this manifest")
    out, data, pos = {}, f.read_at(size - _FOOTER.size - at, at), 0
    for name, kind in _INDEX:
        out[name] = np.frombuffer(data, dtype=kind, count=n, offset=pos)
        pos += out[name].nbytes
    out["offset"] = np.append(out["offset"], np.uint64(at))
    return out


def read_tokens(spark: SparkSession, root: str) -> DataFrame:
    """One row per document of the files in the manifest: doc_id, start (tokens of all documents before it), n_tokens, ids.

    `ids` has the ids as little-endian unsigned 32-bit integers. Documents without an id have a null one and come first, those that
    share an id come one after the other; an empty manifest gives no rows. A long document is unpacked by itself. Fails if a dictionary
    hash, count or frame does not fit.
    """
    ship_package(spark)
    files = [(e["file"], e["start"]) for e in _load(root)[2]["files"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base, manifest, shared = _load(root)
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(shared))
        for b in batches:
            for name, start in zip(*(b.column(i).to_pylist() for i in range(2))):
                with store.open_input_file(f"{base}/{name}") as f:
                    index = _index(f, manifest)
                    rows, held = [], 0
                    for i, n in enumerate(index["n_tokens"].tolist()):
                        a, z = int(index["offset"][i]), int(index["offset"][i + 1])
                        ids = np.frombuffer(unpack.decompress(f.read_at(z - a, a)), dtype=f"<u{manifest['width']}").astype("<u4")
                        if len(ids) != n:
                            raise ValueError(f"{name}: document {i} has {len(ids)} tokens, not {n}")
                        rows.append((int(index["doc_id"][i]) if index["known"][i] else None, start, n, ids.tobytes()))
                        start, held = start + n, held + 4 * n
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    listed = spark.createDataFrame(files, "file string, start long").repartition(max(1, min(len(files), shard_count(spark))))
    return listed.mapInArrow(run, schema="doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids"])


def lookup(root: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with this id, in their order; none if there is none. Reads manifest, indexes and the frames themselves."""
    store, base, manifest, shared = _load(root)
    unpack, found = zstandard.ZstdDecompressor(dict_data=_dictionary(shared)), []
    for e in manifest["files"]:
        if e["first_id"] is not None and e["first_id"] <= doc_id <= e["last_id"]:
            with store.open_input_file(f"{base}/{e['file']}") as f:
                index = _index(f, manifest)
                for i in np.flatnonzero((index["doc_id"] == doc_id) & (index["known"] == 1)):
                    a, z = int(index["offset"][i]), int(index["offset"][i + 1])
                    found.append(np.frombuffer(unpack.decompress(f.read_at(z - a, a)), dtype=f"<u{manifest['width']}"))
    return found
