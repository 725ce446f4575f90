"""Queries of the corpus operators and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import scratch_path
from ledgerline.llm.exact_dedup import exact_dedup
from ledgerline.llm.golay_dedup import near_duplicates
from ledgerline.llm.hard_negatives import hard_negatives, vector_rows
from ledgerline.llm.lang_compress import classify, learn
from ledgerline.llm.license_scan import license_scan
from ledgerline.llm.ordinal_quality import fit, graded, predict
from ledgerline.llm.overlap_join import overlap_components
from ledgerline.llm.phrase_mining import collocations
from ledgerline.llm.piece_codec import round_trip
from ledgerline.llm.quality_forest import quality_rules
from ledgerline.llm.source_mix import mix_plan
from ledgerline.llm.token_store import read_tokens, write_tokens
from ledgerline.llm.warc_writer import read_warc, write_warc

#: Where the vocabulary files lie; the package that holds them is public and installed beside the libraries.
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents")).drop("spans")


def op2_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "threshold")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "tokens")
    write_tokens(_table(spark, sf_dir, "documents"), root, WORD_VOCABULARY)
    return read_tokens(spark, root).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), PIECE_MODEL)


def op5_lang_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = learn(docs.where(~held_out))
    return classify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = fit(docs, labels.withColumn("grade", graded(F.col("quality"), F.col("toxic"))))
    return predict(docs, model)


def op7_golay_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), root)
    return read_warc(spark, root).select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return exact_dedup(_table(spark, sf_dir, "documents"), carry=[F.sha2(text, 256).alias("text_sha256")])


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "source", "n_tokens", "epoch", "block", "position", *(F.round(c, 6).alias(c) for c in ("weight", "repeats", "mix_order")))


def op11_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_components(_table(spark, sf_dir, "documents"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The contract moves the label of every seventh row on by one.
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vector_rows(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label)
    return hard_negatives(rows, rows.where("id % 100 = 0"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_forest": op2_quality_forest,
    "op3_token_store": op3_token_store,
    "op4_piece_codec": op4_piece_codec,
    "op5_lang_compress": op5_lang_compress,
    "op6_ordinal_quality": op6_ordinal_quality,
    "op7_golay_dedup": op7_golay_dedup,
    "op8_warc_writer": op8_warc_writer,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_source_mix": op10_source_mix,
    "op11_overlap_join": op11_overlap_join,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_hard_negatives": op13_hard_negatives,
}

#: Base32 by SQL: five hex digits are twenty bits, which are four letters.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha1(p), {5 * g + 1}, 5))::BIGINT) >> {s}) & 31)::INT + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))

ORACLES = {
    "op8_warc_writer": f"""
        WITH d AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
        g AS (SELECT page_id, octet_length(encode(p)) AS payload_bytes, {_BASE32} AS payload_digest FROM d),
        b AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM g)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
        FROM b
    """,
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """,
    "op10_source_mix": r"""
        WITH RECURSIVE u AS (
            SELECT doc_id, twin, coalesce(source, '') AS source, coalesce(sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))), 0)::BIGINT AS n_tokens
            FROM (SELECT doc_id, source, text, CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) END AS twin FROM documents) GROUP BY doc_id, coalesce(source, ''), twin),
        s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE / (SELECT sum(n_tokens) FROM u) AS share FROM u GROUP BY source),
        k AS (SELECT count(*) AS n, min(share) AS low, max(share) AS high FROM s WHERE share > 0),
        -- Halve [0, 1] forty times for the entropy, and once more for the repetition limit.
        e AS (
            SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
            UNION ALL
            SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
            FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
                         (SELECT ln(sum(pow(share, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(share, (lo + hi) / 2) * ln(share)) / sum(pow(share, (lo + hi) / 2)) FROM s WHERE share > 0)
                         >= 0.95 * ln((SELECT n FROM k)) AS ok
                  FROM e WHERE i < 40)),
        r AS (
            SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
            UNION ALL
            SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
            FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, pow((SELECT high / low FROM k), (lo + hi) / 2) <= 2.0 AS ok FROM r WHERE i < 40)),
        a AS (
            SELECT CASE WHEN (SELECT n FROM k) < 2 THEN 1.0 ELSE greatest(
                CASE WHEN (SELECT -sum(share * ln(share)) FROM s WHERE share > 0) >= 0.95 * ln((SELECT n FROM k)) THEN 1.0 ELSE (SELECT lo FROM e WHERE i = 40) END,
                1.0 - CASE WHEN (SELECT high / low FROM k) <= 2.0 THEN 1.0 ELSE (SELECT lo FROM r WHERE i = 40) END) END AS alpha),
        z AS (SELECT sum(pow(share, alpha)) AS norm, max(pow(share, 1 - alpha)) AS least, (SELECT sum(tokens) FROM s) AS total FROM s, a WHERE share > 0),
        b AS (
            SELECT source, tokens, CASE WHEN share > 0 THEN pow(share, alpha) / norm ELSE 0.0 END AS weight,
                   CASE WHEN share > 0 THEN total * least * norm * (pow(share, alpha) / norm) / tokens ELSE 1.0 END AS repeats
            FROM s, a, z),
        w AS (SELECT *, floor(repeats + 1e-9)::BIGINT AS whole FROM b),
        v AS (SELECT *, greatest(round((repeats - whole) * tokens), 0)::BIGINT AS rest FROM w),
        c AS (
            SELECT *, md5('17:' || epoch || ':' || coalesce(doc_id::VARCHAR, twin)) AS h
            FROM (SELECT u.*, tokens, weight, repeats, whole, rest, unnest(range(0, CASE WHEN rest > 0 THEN whole + 1 ELSE whole END)) AS epoch FROM u JOIN v USING (source))),
        d AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % least(65536, greatest(1, ceil(tokens / 32768.0)))::BIGINT AS block FROM c),
        p AS (SELECT *, (sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY block, h, doc_id, twin ROWS UNBOUNDED PRECEDING) - n_tokens)::BIGINT AS position FROM d)
        SELECT doc_id, source, n_tokens, epoch, block, position, round(weight, 6) AS weight, round(repeats, 6) AS repeats,
               round(coalesce((epoch * tokens + position) / nullif(repeats * tokens, 0), 0.0), 6) AS mix_order
        FROM p WHERE epoch < whole OR position < rest
    """,
    "op11_overlap_join": r"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS g
            FROM d),
        n AS (SELECT rid, doc_id, len(g)::BIGINT AS n_shingles FROM s),
        e AS (SELECT rid, unnest(g) AS x FROM s),
        c AS (SELECT a.rid AS a, b.rid AS b, count(*) AS m FROM e a JOIN e b ON a.x = b.x AND a.rid <> b.rid GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE 100 * m >= 80 * (p.n_shingles + q.n_shingles - m)),
        r AS (SELECT rid AS a, rid AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT k.doc_id, k.n_shingles, min(m.doc_id) AS component_id FROM n k JOIN r ON r.a = k.rid JOIN n m ON m.rid = r.b GROUP BY k.rid, k.doc_id, k.n_shingles
    """,
    "op12_phrase_mining": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
            FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
        n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang HAVING sum(len(w)) > 0),
        o AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM (SELECT lang, w, unnest(range(1, least(5, len(w)) + 1)) AS size FROM p)),
        f AS (SELECT lang, array_to_string(w[pos : pos + size - 1], ' ') AS phrase, size, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
        k AS (SELECT lang, phrase, w, size, f AS a, unnest(range(1, size)) AS k FROM c),
        s AS (
            SELECT k.lang, k.phrase, a, h.f AS l, t.f AS r, n, k, (1000 * a::HUGEINT * n) // (h.f::HUGEINT * t.f) AS score
            FROM k JOIN f h ON h.lang = k.lang AND h.phrase = array_to_string(w[1 : k], ' ') JOIN f t ON t.lang = k.lang AND t.phrase = array_to_string(w[k + 1 :], ' ') JOIN n ON n.lang = k.lang),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        i AS (SELECT lang, array_to_string(w[pos : pos + z - 1], ' ') AS phrase, max(f) AS g FROM (SELECT *, unnest(range(1, size - z + 2)) AS pos FROM (SELECT *, unnest(range(2, size)) AS z FROM c)) GROUP BY ALL),
        d AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE g IS NULL OR 100 * g < 100 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
        FROM d QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
    """,
    "op13_hard_negatives": """
        WITH r AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a, r b WHERE a.id % 100 = 0 AND a.id <> b.id),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        n AS (
            SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
        SELECT * FROM n WHERE rank <= 5
    """,
}
