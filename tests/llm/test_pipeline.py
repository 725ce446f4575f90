"""The pipeline against a plain version that applies the same stages one after the other."""

from collections import Counter

import corpus_pipeline
import sentencepiece
from brute import awkward, components, empty, simhash

from ledgerline.llm import queries
from ledgerline.llm.lang_compress import UNKNOWN, learn, letters_of
from ledgerline.llm.source_mix import mix_plan

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = learn(docs)
    packers = [c.compress for c in model.compressors()]

    def told(text):
        body = letters_of(text or "")
        sizes = sorted(sum(len(p(body[i : i + model.block])) for i in range(0, len(body), model.block)) for p in packers)
        return bool(body) and 1 - sizes[0] / sizes[1] >= 0.01

    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if told(r["text"])]
    best = {}
    for d, t, _ in rows:
        best[t] = max(d, best.get(t, d))
    rows = [r for r in rows if best[r[1]] == r[0]]
    tops = components([r[0] for r in rows], [simhash(r[1]) for r in rows])
    rows = [r for r, top in zip(rows, tops) if r[0] == top]
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    want = {r[0]: lib.encode(r[1]) for r in rows}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == want
    # Sorted by its place every stretch deals the sources in proportion to their budgets, as the mixing stage sorts them.
    source = {r[0]: r[2] for r in rows}
    dealt = [source[r["doc_id"]] for r in sorted(got, key=lambda r: r["mix_order"])]
    assert len({r["mix_order"] for r in got}) == len(got)
    kept = spark.createDataFrame([(d, t, s) for d, t, s in rows], "doc_id long, text string, source string")
    plan = mix_plan(kept, target_entropy=0.95, max_repeat=2.0).orderBy("mix_order", "doc_id").collect()
    assert dealt == [r["source"] for r in plan]
    # Every source gets at least one pass and at most two.
    assert set(Counter(r["doc_id"] for r in got).values()) <= {1, 2}


def test_stages_keep_columns_and_take_awkward_rows(spark):
    for docs in (awkward(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns == ["doc_id", "mix_order", "ids", "begins", "ends"]
    assert UNKNOWN == "und"
