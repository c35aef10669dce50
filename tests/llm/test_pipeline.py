"""The pipeline against its stages in plain Python."""

import corpus_pipeline
from crease.llm.queries import QUERIES

from tests.llm.test_operators import expected_bpe, grams5, plain_components, plain_fingerprint, plain_quality


def test_pipeline(spark, sf_dir, docs, texts):
    kept = {i: t for i, t in texts.items() if not plain_quality(t)[-1]}
    verdict = {r["doc_id"] for r in QUERIES["op10_quality"](spark, sf_dir).filter("kept").collect()}
    assert verdict <= set(kept)
    kept = {i: kept[i] for i in verdict}
    first = {c for _, _, c in plain_components([(i, plain_fingerprint(t)) for i, t in kept.items()])}
    kept = {i: kept[i] for i in first}
    items = [grams5(r["text"])[0] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not any(10 * len(x & grams5(t)[0]) >= 8 * len(x) for x in items)}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(kept) and len(got) == len(kept)
    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.secrets_stage(spark, docs.filter(docs["doc_id"].isin(list(kept))), sf_dir).collect()}
    assert sorted(map(tuple, got), key=str) == expected_bpe(masked.items())
    assert sum(masked[i] != kept[i] for i in kept) > 0


def test_stages_return_the_documents_columns(spark, sf_dir, docs, edge, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
        for odd in (edge, empty):
            assert stage(spark, odd, sf_dir).columns == odd.columns
            assert stage(spark, odd, sf_dir).count() <= odd.count()
