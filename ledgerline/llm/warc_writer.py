"""Deterministic sharded WARC writer: range-sorted records, files rolled by compressed size, manifests."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import discard, join_groups, materialize, publish, range_shards, shard_count, ship_package, whole_numbers, with_shard

_DATE = "1970-01-01T00:00:00Z"
_SCHEMA = "file string, temp string, n_records long, n_bytes long, first_id string, last_id string, sha256 string"
_FIELDS = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary, file string, at long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(name: str, value: object) -> list[tuple[str, str]]:
    """A header; a value that would break its line is written with escaped breaks and goes along whole, in base64, under an X- name."""
    text = str(value)
    safe = text.replace("\r", "%0D").replace("\n", "%0A")
    return [(name, safe)] if safe == text and text.strip() == text else [(name, safe), (f"X-{name}-Base64", base64.b64encode(text.encode()).decode())]


def _value(headers: dict[str, str], name: str) -> str | None:
    whole = headers.get(f"X-{name}-Base64")
    return base64.b64decode(whole).decode() if whole is not None else headers.get(name)


def _record(head: list[tuple[str, object]], block: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", len(block))]).encode() + b"\r\n" + block + b"\r\n\r\n"
    return packer.compress(raw) + packer.flush()


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(map(str, parts)))}>"


def info_record(file: str) -> bytes:
    """The record that opens a file."""
    block = b"software: ledgerline\r\nformat: WARC File Format 1.1\r\n"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id("warcinfo", file)), ("WARC-Date", _DATE), ("WARC-Filename", file), ("Content-Type", "application/warc-fields")], block)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, refers_url=None) -> bytes:
    """The record of a page; the same arguments always give the same bytes."""
    block = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, url, digest)), ("WARC-Date", _DATE)]
    if url is not None:
        head += _header("WARC-Target-URI", url)
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to, refers_url, digest))]
        if refers_url is not None:
            head += _header("WARC-Refers-To-Target-URI", refers_url)
        head.append(("WARC-Refers-To-Date", _DATE))
    if page_id is not None:
        head.append(("X-Page-Id", page_id))
    if refers_to is not None:
        head.append(("X-Refers-To-Page-Id", refers_to))
    head += [("X-Payload-Length", len(payload)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"), ("Content-Type", "application/http;msgtype=response")]
    return _record(head, block)


class _Roller:
    """Files of one shard: a new one begins once the open one has reached the compressed size."""

    def __init__(self, root: str, roll_bytes: int, attempt: str) -> None:
        self.store, self.base = fs.FileSystem.from_uri(root)
        self.roll, self.attempt, self.done = roll_bytes, attempt, []
        self.out = None
        self.shard, self.n = -1, 0

    def add(self, shard: int, page_id, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.n = shard, 0
        elif self.size >= self.roll:
            self.close()
        if self.out is None:
            self.file = f"part-{shard:06d}-{self.n:04d}.warc.gz"
            self.temp = f"_temporary/{self.file}.{self.attempt}"
            self.out, self.sum, self.size, self.records, self.first = self.store.open_output_stream(f"{self.base}/{self.temp}", compression=None), hashlib.sha256(), 0, 0, page_id
            self.n += 1
            self._write(info_record(self.file))
        self._write(data)
        self.records += 1
        self.last = page_id

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.file, self.temp, self.records, self.size, *(None if x is None else str(x) for x in (self.first, self.last)), self.sum.hexdigest()))
            self.out = None


def write_warc(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0, roll_bytes: int = 64 << 20) -> list[dict]:
    """Write one record per row below `root` and return the manifest, one entry a file.

    Rows are sorted by id over shards of equal payload bytes whose bounds depend on the rows alone, and every record's
    bytes depend on its row alone, so a second run writes the same files. Of equal payloads of at least
    `min_payload` bytes the row with the largest id is a response and the others are revisits of it; smaller payloads are all
    responses. A null payload is empty; a null id sorts first and refers to nothing; rows that tie in payload and
    id give one response, then revisits. Ids are whole numbers of at most 64 bits (others raise). Many rows of one id are spread over shards
    by their payload. A task holds one batch of payloads, however long, at a time. An empty table gives no file and an empty manifest.
    A file opens with a warcinfo record; a revisit names the record, URL and date it refers to.

    A task writes to names of its attempt; the driver renames those of the attempts that counted and then writes
    manifest.json, by which readers go, so lost executors and second attempts leave nothing visible.
    """
    spark = pages.sparkSession
    ship_package(spark)
    whole_numbers(pages, id_col)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    sha = F.unhex(F.sha1("payload"))
    keys = materialize(rows.select("id", "url", F.octet_length("payload").alias("n"), sha.alias("sha"), F.xxhash64(sha).alias("hash")), "warc-keys")
    chosen = F.max(F.struct("id", F.col("url").isNotNull().alias("named"), "url"))
    best = materialize(keys.where(F.col("n") >= min_payload).groupBy("sha").agg(chosen.alias("best"), F.count("*").alias("c")).where("c > 1").select("sha", F.col("best.id").alias("best"), F.col("best.url").alias("best_url"), "c"), "warc-best")
    # Where a payload repeats, a mark with the response's id and URL goes along with each row's id; the writer meets both in sorted order.
    repeated = join_groups(keys.where(F.col("n") >= min_payload).select("id", "sha", "hash").distinct(), best, "sha", "c", keys.count()).where("c is not null")
    marks = repeated.select("id", F.col("best_url").alias("url"), F.col("sha").alias("payload"), "best", F.lit(0).alias("kind"), "hash")
    both = marks.unionByName(rows.select("id", "url", "payload", F.lit(None).cast("long").alias("best"), F.lit(1).alias("kind"), F.xxhash64(sha).alias("hash")))
    shards = range_shards(keys, "id", "hash", F.col("n") + F.lit(200), shard_count(spark))
    # Of rows that tie in id and payload the response is the one that revisits refer to, with the largest URL.
    order = ("shard", "id", "hash", "kind", "payload", F.desc("url"))
    dealt = with_shard(both, "id", "hash", shards, "shard").sortWithinPartitions(*order).select("id", "url", "payload", "best", "kind", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = _Roller(root, roll_bytes, uuid.uuid4().hex)
        refers, served, was = {}, None, 1
        for b in batches:
            for page_id, url, payload, best_id, kind, shard in zip(*(b.column(i) for i in range(6))):
                page_id, url, payload, shard, kind = page_id.as_py(), url.as_py(), payload.as_py(), shard.as_py(), kind.as_py()
                # All marks of an id and hash come before its records.
                if kind == 0 and was == 1:
                    refers = {}
                was = kind
                if kind == 0:
                    refers[page_id, payload] = (best_id.as_py(), url)
                    continue
                sha = hashlib.sha1(payload).digest()
                known = refers.get((page_id, sha))
                revisit = known is not None and (known[0] != page_id or served == (page_id, sha))
                served = page_id, sha
                digest = base64.b32encode(sha).decode()
                roller.add(shard, page_id, record_bytes(page_id, url, payload, digest, known[0], True, known[1]) if revisit else record_bytes(page_id, url, payload, digest, None, False))
        roller.close()
        cols = list(zip(*roller.done)) or [()] * 7
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in _SCHEMA.split(", ")])

    store, base = fs.FileSystem.from_uri(root)
    store.create_dir(f"{base}/_temporary", recursive=True)
    files = sorted((r.asDict() for r in dealt.mapInArrow(run, schema=_SCHEMA).collect()), key=lambda r: r["file"])
    publish(store, base, [(entry.pop("temp"), entry["file"]) for entry in files])
    store.delete_dir(f"{base}/_temporary")
    discard(keys, best)
    with store.open_output_stream(f"{base}/manifest.json.tmp") as out:
        out.write(json.dumps(files, indent=0).encode())
    store.move(f"{base}/manifest.json.tmp", f"{base}/manifest.json")
    return files


def _members(source, chunk: int = 1 << 20, step: int = 1 << 14) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member, read as a stream."""
    offset, unpack, parts, data, at, base = 0, zlib.decompressobj(31), [], memoryview(b""), 0, 0
    while True:
        if at == len(data):
            base += len(data)
            data, at = memoryview(source.read(chunk)), 0
            if not len(data):
                if parts:
                    raise ValueError("a WARC file ends inside a record")
                return
        # Small steps, since what lies behind the end of a member is handed back as a copy.
        taken = data[at : at + step]
        parts.append(unpack.decompress(taken))
        at += len(taken) - len(unpack.unused_data)
        if unpack.eof:
            yield offset, b"".join(parts)
            offset, unpack, parts = base + at, zlib.decompressobj(31), []


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """The page records of all files in the manifest: header fields, the payload (null for a revisit), file and offset.

    Ids are strings as in the headers, null where a page had none. A payload of any length is held one at a time, repeated rows are
    records of their own, an empty manifest gives no rows. Fails if a digest or length does not match.
    """
    ship_package(spark)
    store, base = fs.FileSystem.from_uri(root)
    with store.open_input_stream(f"{base}/manifest.json") as f:
        names = [e["file"] for e in json.loads(f.read())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, folder = fs.FileSystem.from_uri(root)
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64()]
        names_ = [f.split()[0] for f in _FIELDS.split(", ")]
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with reader.open_input_stream(f"{folder}/{name}", compression=None) as f:
                    for at, data in _members(f):
                        head, _, rest = data.partition(b"\r\n\r\n")
                        h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        block = rest[: int(h["Content-Length"])]
                        payload = None if h["WARC-Type"] == "revisit" else block.partition(b"\r\n\r\n")[2]
                        if payload is not None and (len(payload) != int(h["X-Payload-Length"]) or "sha1:" + payload_digest(payload) != h["WARC-Payload-Digest"]):
                            raise ValueError(f"{name} at {at}: the payload does not match its digest")
                        rows.append((h.get("X-Page-Id"), _value(h, "WARC-Target-URI"), h["WARC-Type"], int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][5:], h.get("X-Refers-To-Page-Id"), payload, name, at))
                        held += len(data)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names_)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names_)

    listed = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, min(len(names), shard_count(spark))))
    return listed.mapInArrow(run, schema=_FIELDS)
