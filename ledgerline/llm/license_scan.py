"""License scans by diagonal voting: rolling word k-gram hashes joined to template positions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerline.llm.common import ship_package

#: A-Z to a-z; bytes that are no part of a word to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MARK = np.uint64(0x2545F4914F6CDD1D)
_CACHE_LIMIT = 200_000
#: Hashes in one batch that a task hands on.
_PART = 1 << 18


@dataclass(frozen=True)
class Template:
    """A phrase to look for. An exact one counts only where all its words stand in a row.

    The phrases of `must` tell it from its neighbours: each has to stand, word by word, at the place of the match.
    """

    label: str
    text: str
    exact: bool = False
    must: tuple[str, ...] = ()


#: Phrases and labels of the base rules.
BASE = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)

#: Notices that name a licence, as their publishers word them.
NOTICES = (
    Template("agpl", "licensed under the GNU Affero General Public License, version 3", must=("GNU Affero General Public License", "version 3")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", must=("Version 2",)),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("bsd", "Use of this source code is governed by a BSD-style license"),
    Template("cc-by-4.0", "licensed under CC BY 4.0", must=("CC BY 4",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", must=("Attribution 4",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", must=("CC BY-NC 4",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", must=("CC BY-SA 4",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    Template("gpl-2.0", "the terms of the GNU General Public License, version 2", must=("GNU General Public License", "version 2")),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", must=("GNU General Public License", "version 2")),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", must=("GNU General Public License", "version 3")),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", must=("GNU General Public License", "version 3")),
    Template("gpl-notice", "under the terms of the GNU General Public License as published by the Free Software Foundation", must=("GNU General Public License",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl", "licensed under the GNU Lesser General Public License", must=("GNU Lesser General Public License",)),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", must=("Mozilla Public License", "v. 2")),
    Template("no-warranty", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a text in UTF-8: letters a-z, digits and everything beyond ASCII."""
    return text.translate(_FOLD).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def gram_hashes(words: Sequence[bytes], k: int, known: dict) -> np.ndarray:
    """Hash of each run of k words, rolled up from the hashes of the words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _gram_rows(docs: DataFrame, id_col: str, text_col: str, sizes: tuple[int, ...]) -> DataFrame:
    """(id, body, uid, n_words, starts, grams) for each row.

    body holds the words joined by spaces, starts where each word begins and where one more would; grams are the hashes of every k-gram
    of each size in turn, then a mark.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            start, held, rows = 0, 0, []
            for i, x in enumerate(b.column(1)):
                words = words_of(x.as_py() or b"")
                body = b" ".join(words)
                starts = np.append(0, np.cumsum(np.fromiter(map(len, words), dtype=np.int32, count=len(words)) + 1)).astype(np.int32)
                rows.append((body, xxhash.xxh3_128_digest(body), len(words), starts, np.concatenate([*(gram_hashes(words, k, known) for k in sizes), [_MARK]]).astype(np.uint64).view(np.int64)))
                held += len(rows[-1][4])
                # Hand on a part at a time: the hashes of a whole batch would weigh many times its texts.
                if held >= _PART or i + 1 == b.num_rows:
                    bodies, uids, counts, *arrays = zip(*rows)
                    lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in a])).astype(np.int32)), pa.array(np.concatenate(a))) for a in arrays]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(rows)), pa.array(bodies, pa.binary()), pa.array(uids, pa.binary()), pa.array(counts, pa.int64()), *lists], names=["id", "body", "uid", "n_words", "starts", "grams"])
                    start, held, rows = i + 1, 0, []

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, schema=f"id {kind}, body binary, uid binary, n_words long, starts array<int>, grams array<long>")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = NOTICES, long_gram: int = 4, min_cover: float = 0.8, max_templates: int = 10_000) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    All 2-gram and `long_gram`-gram hashes of every text are joined to the positions of the templates' grams: 2-grams for the
    base phrases and templates shorter than `long_gram`, long ones for the rest. The table of positions is broadcast;
    at most `max_templates` templates of a few words each bound its size. Every match is verified word by word and votes for the
    diagonal (place in the text less place in the template). A base phrase is found where all of its grams vote for one diagonal.
    For the rest neighbouring diagonals merge, so that a word more or less does not break a span, and a span counts
    when it covers `min_cover` of the template's words in about its length and the template's `must` phrases stand there.
    `score` is the best cover of any span, counted or not; labels are distinct,
    sorted and joined by commas (none: empty). spans lists (label, first word, last word, cover) of merged spans.

    A null or empty text has no word, no label and score 0. Repeated rows give repeated results. An empty table gives no rows;
    other columns are not looked at. A match costs the same in texts of any length. Nothing but matches and one mark a document is
    shuffled.
    """
    spark = docs.sparkSession
    ship_package(spark)
    every = [*BASE, *templates]
    if len(every) > max_templates:
        raise ValueError(f"more than {max_templates} templates")
    most = max(len(t.must) for t in every)
    sizes, known, rows = (2, long_gram), _Hashes(), [(int(_MARK.view(np.int64)), -1, 0, 0, 0, "", b"", False, *[None] * most)]
    for i, t in enumerate(every):
        words = words_of(t.text.encode())
        if len(words) < 2:
            raise ValueError(f"the template {t.text!r} has under two words")
        must = [b" " + b" ".join(words_of(m.encode())) + b" " for m in t.must]
        k = 2 if t.exact or len(words) < long_gram else long_gram
        for j, h in enumerate(gram_hashes(words, k, known).view(np.int64).tolist()):
            rows.append((h, i, j, k, len(words), t.label, b" ".join(words[j : j + k]), t.exact, *must, *[None] * (most - len(must))))
    table = spark.createDataFrame(rows, "gram long, template int, at int, k int, len int, label string, words binary, exact boolean" + "".join(f", must{i} binary" for i in range(most)))

    grams = _gram_rows(docs, id_col, text_col, sizes).select("id", "uid", "body", "n_words", "starts", F.posexplode("grams").alias("p", "gram"))
    # The 2-grams come first, then the long grams, then the mark.
    pairs = F.greatest(F.col("n_words") - 1, F.lit(0))
    place = F.when(F.col("k") == 2, F.col("p")).otherwise(F.col("p") - pairs)
    kind = F.when(F.col("p") < pairs, 2).when(F.col("p") < pairs + F.greatest(F.col("n_words") - (long_gram - 1), F.lit(0)), long_gram).otherwise(0)
    same = _words_at(place, F.col("k")) == F.col("words")
    hits = grams.join(F.broadcast(table), "gram").where((F.col("k") == kind) & ((F.col("k") == 0) | same))
    # The words where the template would lie, with as many on either side as a span may be off.
    begin = F.greatest(place - F.col("at") - _slack(), F.lit(0))
    blank = F.lit(b" ")
    around = F.concat(blank, _words_at(begin, F.least(F.col("len") + 2 * _slack(), F.col("n_words") - begin)), blank)
    # No lambda here: in one generated loop with the join, bodies are looked at in place and never copied to its rows.
    told = F.lit(True)
    for i in range(most):
        told = told & F.coalesce(F.contains(around, F.col(f"must{i}")), F.lit(True))
    hits = hits.select("id", "uid", "n_words", "template", "label", "exact", "k", "len", "at", F.when(F.col("k") == 0, 0).otherwise(place).cast("long").alias("pos"), told.alias("told"))

    # One row a diagonal; the mark of a document counts how often its row is repeated.
    diagonals = hits.withColumn("diag", F.col("pos") - F.col("at")).groupBy("id", "uid", "n_words", "template", "label", "exact", "k", "len", "diag").agg(F.count("*").alias("n"), F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("told").alias("told"))
    opens = F.coalesce(F.col("diag") - F.lag("diag").over(_by("template", "diag")) > _slack(), F.lit(True)).cast("int")
    runs = diagonals.withColumn("_open", opens).withColumn("run", F.sum("_open").over(_by("template", "diag")))
    spans = runs.groupBy("id", "uid", "n_words", "template", "label", "exact", "k", "len", "run").agg(F.max("n").alias("n"), F.flatten(F.collect_list("ats")).alias("ats"), F.min("first").alias("first"), (F.max("last") + F.first("k") - 1).alias("last"), F.max("told").alias("told"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("k") - 1)))))
    spans = spans.withColumn("cover", F.when(F.col("k") == 0, 0.0).otherwise(covered / F.col("len")))
    found = F.when(F.col("exact"), F.col("cover") == 1.0).otherwise(F.col("told") & (F.col("cover") >= min_cover) & (F.col("last") - F.col("first") < 1.5 * F.col("len")))
    # The score is taken over all spans, found or not.
    spans = spans.withColumn("found", (F.col("k") > 0) & found)
    base = F.col("exact") & F.col("found")
    per_doc = spans.groupBy("id", "uid", "n_words").agg(
        F.max(F.when(F.col("k") == 0, F.col("n"))).alias("copies"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("found"), F.col("label")))), ",").alias("labels"),
        F.max("cover").alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("found"), F.struct("label", "first", "last", "cover")))).alias("spans"),
    )
    # A repeated row comes as often as it stands in the input, by two steps, so that no array holds all its numbers.
    thousand = 1000
    some = per_doc.withColumn("_some", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / thousand))))
    copied = some.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(thousand).cast("long"), F.col("copies") - thousand * F.col("_some")))))
    return copied.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def _words_at(first: Column, n: Column) -> Column:
    """n words of the body from a word on, cut by their places in bytes: the cost does not depend on the length of the text."""
    first = first.cast("int")
    start = F.get("starts", first)
    return F.substring("body", start + 1, F.get("starts", first + n.cast("int")) - start - 1)


def _slack() -> Column:
    """By how many words neighbouring diagonals of a template may differ."""
    return F.when(F.col("exact"), 0).otherwise(F.least(F.lit(3), F.floor(F.col("len") / 4))).cast("int")


def _by(template: str, diagonal: str) -> WindowSpec:
    """Over the diagonals of one template in one document."""
    return Window.partitionBy("id", "uid", "n_words", template).orderBy(diagonal)
