"""Plain implementations that the corpus operators are held against, and fixtures with awkward rows."""

import re
import zlib
from collections import Counter

import xxhash

#: (doc_id, text, lang, source, n_chars): nulls, empty and blank texts, ties, repeated rows, a long text.
AWKWARD = [
    (1, "All Rights Reserved. Licensed under CC BY 4.0, all rights reserved", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \t\n ", None, "b", 4),
    (5, "one", "en", "a", 3),
    (6, "the cat sat on the mat\nthe cat sat on the mat\n\nthe cat sat on the mat", "en", "a", 70),
    (7, "the cat sat on the mat\nthe cat sat on the mat\n\nthe cat sat on the mat", "en", "c", 70),
    (7, "the cat sat on the mat\nthe cat sat on the mat\n\nthe cat sat on the mat", "en", "c", 70),
    (8, "École ☃ naïve ﬁne  x y <|endoftext|> it's I'LL 12½ ΑΣ é \u0001 \u001c z", "fr", "a", 60),
    (9, "  two  spaces ▁ under\r\n\tbar  ", "fr", "a", 20),
    (None, "no id at all", "en", "a", 12),
    (None, "no id at all", "en", "a", 12),
    (10, "word " * 30_000, "de", "a", 150_000),
    (11, "This work is licensed under the new GNU General Public License, version 3.", "en", "a", 70),
    (12, "plain words follow here without any repetition at all in them, " + " ".join(f"w{i}" for i in range(80)), "en", "c", 200),
    (13, "### $$$ %%% <a> | b | c ***", "es", "c", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names inside the operators.
CLASHES = ["id", "fp", "kept", "score", "_h", "_k", "bucket", "block", "epoch", "tokens", "label", "labels", "n", "frame", "shard", "slots", "grade", "h", "tree", "bin", "_row", "_text", "_digest", "_order"]


def awkward(spark, clashes=True):
    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("clash") for c in CLASHES}) if clashes else docs


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


def license_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    at, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += found
        if found:
            labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def quality_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def simhash(text, k=4, seed=42):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), seed) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps, bits=4):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def license_votes(text, templates, base, long_gram=4, min_cover=0.8):
    """(labels, score) by a plain diagonal vote over one text."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))

    def cut(phrase):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(phrase))

    places = {k: {} for k in (2, long_gram)}
    for k, at in places.items():
        for i in range(len(words) - k + 1):
            at.setdefault(tuple(words[i : i + k]), []).append(i)
    labels, score = set(), 0.0
    for t in (*base, *templates):
        own = cut(t.text)
        k = 2 if t.exact or len(own) < long_gram else long_gram
        slack = 0 if t.exact else min(3, len(own) // 4)
        votes = {}
        for a in range(len(own) - k + 1):
            for i in places[k].get(tuple(own[a : a + k]), ()):
                around = " " + " ".join(words[max(i - a - slack, 0) :][: len(own) + 2 * slack]) + " "
                told = all(" " + " ".join(cut(m)) + " " in around for m in t.must)
                votes.setdefault(i - a, []).append((a, i, told))
        spans, last = [], None
        for d in sorted(votes):
            if last is None or d - last > slack:
                spans.append([])
            spans[-1] += votes[d]
            last = d
        for span in spans:
            covered = {a + j for a, _, _ in span for j in range(k)}
            cover = len(covered) / len(own)
            width = max(i for _, i, _ in span) + k - 1 - min(i for _, i, _ in span)
            score = max(score, cover)
            if cover == 1 if t.exact else any(x[2] for x in span) and cover >= min_cover and width < 1.5 * len(own):
                labels.add(t.label)
    return ",".join(sorted(labels)), score


def spark_xxhash64(*parts):
    """Spark's chained xxhash64 of longs, ints and strings, as a signed number."""
    import struct

    seed = 42
    for p in parts:
        if p is None:
            continue
        data = p.encode() if isinstance(p, str) else struct.pack("<i", p[0]) if isinstance(p, tuple) else struct.pack("<q", p)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed
