from collections import Counter

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_duplicates import plain_similar

from palisade.llm import mixing, quality, registered, secrets
from palisade.llm.common import table

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_its_stages_by_hand(spark):
    docs = table(spark, SF, "documents")
    forest = quality.train(docs, table(spark, SF, "labels"))
    import numpy as np

    rows = {r.doc_id: r for r in docs.collect()}
    stats = np.array([quality.statistics(r.text.encode()) for r in rows.values()])
    good = ~quality.base_failed(stats) & forest.keeps(quality.features(stats))
    kept = [(i, r.text) for (i, r), g in zip(rows.items(), good) if g]
    heads = set(plain_similar(kept).values())
    kept = [(i, t) for i, t in kept if i in heads]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    leaks = {i for i, _ in brute.contamination(kept, items)}
    kept = {i: secrets.redact(t, secrets.spans_of(t)) for i, t in kept if i not in leaks}
    got = corpus_pipeline.run(spark, SF).collect()
    assert set(kept) >= {r.doc_id for r in got} and all(r.text == kept[r.doc_id] for r in got)
    left = docs.where(docs.doc_id.isin(list(kept)))
    want = Counter(r.doc_id for r in mixing.replicated(left).select("doc_id").collect())
    assert Counter(r.doc_id for r in got) == want


def test_stages_keep_the_columns_and_take_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a few plain words that follow each other and say nothing at all", "en", "s", 64)], table(spark, SF, "documents").schema)
    for docs_in in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs_in, SF)
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
            assert out.count() <= 3 * 4
            docs_in = out if name != corpus_pipeline.STAGES[-1][0] else docs_in


def test_names():
    found = registered.queries()
    assert all(any(k.startswith(f"op{n}_") for k in found) for n in range(1, 11)) and "pipeline" in found
    assert set(registered.oracle_sql()) <= set(found)
