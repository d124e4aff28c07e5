"""The pipeline on the smallest tables, each stage held against a plain version of its own decision."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from fixtures import SF, edge_docs, groups_of, plain_components, table
from meterlark.llm import quality
from meterlark.llm.common import new_folder
from meterlark.llm.source_mixing import mix_sources
from test_tables import check_packing


def kept(spark, stage, docs):
    path = new_folder(spark, "stage-test")
    dict(corpus_pipeline.STAGES)[stage](spark, docs, SF).write.parquet(path)
    return spark.read.parquet(path)


def test_stages_one_after_another(spark):
    docs = table(spark, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "source_mixing", "best_fit_packing"]
    good = kept(spark, "quality_classifier", docs)
    scores = quality.score_quality(docs, quality.train(docs, table(spark, "labels"))).collect()
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in scores if r.predicted == 1)
    once = kept(spark, "exact_dedup", good)
    groups = groups_of([(r.doc_id, r.text) for r in good.collect()])
    assert sorted(r.doc_id for r in once.collect()) == sorted(min(g, key=lambda r: (-len(r[1]), r[0]))[0] for g in groups.values())
    apart = kept(spark, "minhash_near_dedup", once)
    component = plain_components([(r.doc_id, r.text) for r in once.collect()], 5, 80)
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for i, c in component.items() if i == c)
    mixed = kept(spark, "source_mixing", apart)
    want = {r.doc_id: r.copies for r in mix_sources(apart).collect() if r.copies}
    assert dict(Counter(r.doc_id for r in mixed.collect())) == want
    for stage in (good, once, apart, mixed):
        assert stage.dtypes == docs.dtypes and stage.count() > 0
    packed = kept(spark, "best_fit_packing", mixed)
    check_packing(packed.collect(), [(r.doc_id, r.text) for r in mixed.collect()])


def test_stages_bear_odd_rows(spark):
    docs = edge_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(stage(spark, docs, SF).columns) == sorted(docs.columns), name
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
