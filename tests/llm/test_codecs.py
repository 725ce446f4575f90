"""Token files, SentencePiece spans and WARC archives: exact round trips against the libraries."""

import hashlib
import json
import zlib

import numpy as np
import pytest
import sentencepiece
from brute import awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from ledgerline.llm import queries
from ledgerline.llm.common import scratch_path
from ledgerline.llm.piece_codec import Codec, Normalizer, encode, round_trip
from ledgerline.llm.token_store import WordEncoder, lookup, read_tokens, write_tokens
from ledgerline.llm.warc_writer import payload_digest, read_warc, write_warc

SF = "/root/testdata/sf0.001"
WORDS = WordEncoder(queries.WORD_VOCABULARY)
PIECES = Codec(queries.PIECE_MODEL)
ODD = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t▁'éÀßσΣİ½ﬁ́  \x1c\x85<|>endoftext")), max_size=60)


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_word_encoder_is_the_tokenizer(text):
    assert np.frombuffer(WORDS.encode(text), dtype=WORDS.kind).tolist() == WORDS.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_codec_is_the_library_and_spans_tile_the_text(text):
    ids, begins, ends = PIECES.encode(text)
    assert ids.tolist() == PIECES.lib.encode(text)
    if len(ids):
        assert begins[0] == 0 and ends[-1] == len(text.encode()) and (begins[1:] == ends[:-1]).all()


def test_spans_are_the_source_of_their_pieces():
    text = "Ein naïver Test"
    ids, begins, ends = PIECES.encode(text)
    for i, a, z in zip(ids.tolist(), begins, ends):
        piece = PIECES.lib.id_to_piece(i).replace("▁", " ").encode()
        assert text.encode()[a:z].strip() == piece.strip() or PIECES.lib.is_byte(i)


@pytest.mark.parametrize("squeeze", [True, False])
def test_character_map_against_the_library(squeeze):
    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(lib.serialized_model_proto())
    own = Normalizer(model.normalizer_spec)
    for text in ("", " ", "  ﬁne  ｶﾞ Ⅷ　x ", "é ½ ™​\u0007 end", "㌔㌢ à́", "plain", "한국어 текст", "ﬁ\t\n ok"):
        want, offsets = lib.normalize(text, with_offsets=True)
        body, source = own(text.encode())
        assert body.decode() == want
        # The library counts characters of the text; the last entry is the end of what was used.
        chars = [len(text.encode()[:s].decode()) for s in source]
        starts = [i for i, b in enumerate(body) if b & 0xC0 != 0x80]
        assert [chars[i] for i in starts] == list(offsets)[: len(starts)]


def _mapped_model(tmp_path, squeeze):
    """The model with another one's compiled character map: nothing is trained."""
    rules = sentencepiece_model_pb2.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze).serialized_model_proto())
    model = sentencepiece_model_pb2.ModelProto()
    with open(queries.PIECE_MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.CopyFrom(rules.normalizer_spec)
    path = str(tmp_path / f"mapped-{squeeze}.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    return path


@pytest.mark.parametrize("squeeze", [True, False])
def test_operator_on_a_model_with_a_character_map(spark, tmp_path, squeeze):
    """Ids and spans of the whole operator against the library, whose surfaces are the text between the spans."""
    path = _mapped_model(tmp_path, squeeze)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", " ", "  ﬁne  ｶﾞ Ⅷ　x ", "é ½ ™​\u0007 end", "㌔㌢ à́", "plain words  with  two spaces", "한국어 текст ☃", "ﬁ\t\n ok", "▁▁ mark", *(r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 2000").limit(60).collect())]
    rows = {r["doc_id"]: r for r in encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    for i, t in enumerate(texts):
        want = lib.encode(t, return_type="proto")
        assert rows[i]["ids"] == [p.id for p in want.pieces], t
        # The library's surfaces: where a piece ends inside what one character became, both sides share the character.
        spans = [t.encode()[a:z].decode() for a, z in zip(rows[i]["begins"], rows[i]["ends"])]
        assert spans == [p.surface for p in want.pieces], t


def test_numbers_at_both_ends(spark):
    """Ids of 64 bits reach neither an overflow nor a float; rows of one id and of none are spread, and stay in order."""
    edge = 1 << 63
    ids = [-edge, edge - 1, -edge + 1, edge - 2, 0, 2**53 + 1, 2**53, None, None, *([77] * 200), *range(1000, 1040)]
    docs = spark.createDataFrame([(d, f"text {i}") for i, d in enumerate(ids)], "doc_id long, text string")
    root = scratch_path(spark, "test-tokens")
    manifest = write_tokens(docs, root, queries.WORD_VOCABULARY)
    got = [r["doc_id"] for r in read_tokens(spark, root).orderBy("start").collect()]
    assert got == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(manifest["files"]) > 2
    assert len({e["file"].split("-")[1] for e in manifest["files"] if e["first_id"] == e["last_id"] == 77}) > 1
    root = scratch_path(spark, "test-warc")
    write_warc(docs.selectExpr("doc_id as page_id", "'http://u' as url", "text as html"), root)
    assert sorted(str(r["page_id"]) for r in read_warc(spark, root).collect()) == sorted(map(str, ids))
    for bad in ("string", "double"):
        with pytest.raises(ValueError):
            write_tokens(docs.withColumn("doc_id", docs["doc_id"].cast(bad)), scratch_path(spark, "test-tokens"), queries.WORD_VOCABULARY)


def test_texts_that_are_no_utf8(spark):
    docs = spark.createDataFrame([(1, b"ab \xff\xfe cd"), (2, b"fine")], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    root = scratch_path(spark, "test-tokens")
    write_tokens(docs, root, queries.WORD_VOCABULARY)
    assert read_tokens(spark, root).count() == 2 and round_trip(docs, queries.PIECE_MODEL).count() == 2


def test_token_files_round_trip(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op3_token_store(spark, SF).collect()}
    lib, start, want = Tokenizer.from_file(queries.WORD_VOCABULARY), 0, {}
    for d, t in docs:
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        want[d] = (start, len(ids), crc(ids))
        start += len(ids)
    assert got == want


def test_token_files_awkward_rows_and_lookup(spark):
    root = scratch_path(spark, "test-tokens")
    manifest = write_tokens(awkward(spark), root, queries.WORD_VOCABULARY, roll_bytes=200)
    assert sum(e["n_docs"] for e in manifest["files"]) == 16 and len(manifest["files"]) > 1
    rows = read_tokens(spark, root).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10, 11, 12, 13]
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])[:-1]]).tolist()
    lib = Tokenizer.from_file(queries.WORD_VOCABULARY)
    texts = {d["doc_id"]: d["text"] for d in awkward(spark).collect()}
    for r in rows:
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == [*lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
    assert [x.tolist() for x in lookup(root, 5)] == [[*lib.encode("one", add_special_tokens=False).ids, 2]] and len(lookup(root, 7)) == 2 and lookup(root, 99) == []
    none = scratch_path(spark, "test-tokens")
    assert write_tokens(empty(spark), none, queries.WORD_VOCABULARY)["files"] == [] and read_tokens(spark, none).count() == 0
    store, base = fs.FileSystem.from_uri(root)
    with store.open_output_stream(f"{base}/dictionary.zdict", compression=None) as f:
        f.write(b"other")
    with pytest.raises(ValueError):
        lookup(root, 5)


def test_token_files_repeat_byte_for_byte(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, two = (write_tokens(d, scratch_path(spark, "test-tokens"), queries.WORD_VOCABULARY) for d in (docs, docs.repartition(7)))
    assert one == two and one["dictionary"]


def test_pieces_round_trip(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    for r in queries.op4_piece_codec(spark, SF).collect():
        ids = lib.encode(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_pieces_awkward_rows(spark):
    rows = encode(awkward(spark), queries.PIECE_MODEL).collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    texts = {d["doc_id"]: d["text"] for d in awkward(spark).collect()}
    assert len(rows) == 16 and all(r["ids"] == lib.encode(texts[r["doc_id"]] or "") and len(r["begins"]) == len(r["ends"]) == len(r["ids"]) for r in rows)
    assert round_trip(empty(spark), queries.PIECE_MODEL).count() == 0


def test_warc_headers_are_true(spark):
    pages = spark.createDataFrame([(1, "http://a/%20x?q=100%25", "same"), (2, "http://b/é", "same"), (3, " odd\n", "other")], "page_id long, url string, html string")
    root = scratch_path(spark, "test-warc")
    (entry,) = write_warc(pages, root, roll_bytes=1 << 30)[:1]
    rows = {r["page_id"]: r for r in read_warc(spark, root).collect()}
    assert {k: r["url"] for k, r in rows.items()} == {"1": "http://a/%20x?q=100%25", "2": "http://b/é", "3": " odd\n"}
    store, base = fs.FileSystem.from_uri(root)
    heads = {}
    for name in sorted({r["file"] for r in rows.values()}):
        with store.open_input_stream(f"{base}/{name}", compression=None) as f:
            records = [x.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:] for x in f.read() and _inflate(store, f"{base}/{name}")]
        assert "WARC-Type: warcinfo" in records[0] and f"WARC-Filename: {name}" in records[0]
        for r in records[1:]:
            head = dict(x.split(": ", 1) for x in r)
            heads[head["X-Page-Id"]] = head
    assert heads["1"]["WARC-Target-URI"] == "http://a/%20x?q=100%25"
    assert heads["1"]["WARC-Refers-To"] == heads["2"]["WARC-Record-ID"] and heads["1"]["WARC-Refers-To-Target-URI"] == "http://b/é" and "WARC-Refers-To-Date" in heads["1"]
    assert entry["n_records"] >= 1


def _inflate(store, path):
    with store.open_input_stream(path, compression=None) as f:
        data = f.read()
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return out


PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "u\r\nWARC-Type: response", ""), (5, "http://é/", "é☃"), (5, "http://é/", "é☃"), (None, "n", "<p>x</p>"), (6, "big", "y" * 300_000), (7, "http://b", "z")]


def test_warc_awkward_rows(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as kind", "2 as shard", "3 as id")
    root = scratch_path(spark, "test-warc")
    files = write_warc(pages, root, roll_bytes=400)
    assert sum(f["n_records"] for f in files) == len(PAGES)
    rows = read_warc(spark, root).collect()
    assert sorted((str(r["page_id"]), r["url"] or "") for r in rows) == sorted((str(p), u or "") for p, u, _ in PAGES)
    html = {p: (h or "").encode() for p, _, h in PAGES}
    for r in rows:
        body = html[None if r["page_id"] is None else int(r["page_id"])]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == payload_digest(body)
        assert (r["payload"] is None) == (r["record_type"] == "revisit") and (r["payload"] is None or bytes(r["payload"]) == body)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in rows)
    assert kinds == sorted([("1", "revisit", "2"), ("2", "response", None), ("3", "revisit", "4"), ("4", "response", None), ("5", "response", None), ("5", "revisit", "5"), ("None", "revisit", "2"), ("6", "response", None), ("7", "response", None)])
    store, base = fs.FileSystem.from_uri(root)
    names = {f.base_name for f in store.get_file_info(fs.FileSelector(base))}
    assert names == {f["file"] for f in files} | {"manifest.json"}
    with store.open_input_stream(f"{base}/manifest.json") as f:
        assert json.loads(f.read()) == files
    again = write_warc(pages.repartition(5), scratch_path(spark, "test-warc"), roll_bytes=400)
    assert again == files
    few = scratch_path(spark, "test-warc")
    write_warc(pages, few, min_payload=9)
    assert {r["record_type"] for r in read_warc(spark, few).collect() if r["payload_bytes"] < 9} == {"response"}
    none = scratch_path(spark, "test-warc")
    assert write_warc(pages.limit(0), none) == [] and read_warc(spark, none).count() == 0
