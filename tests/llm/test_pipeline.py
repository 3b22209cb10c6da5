"""The pipeline: each stage's decisions take effect on the next."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secrets", "mix", "pack"]
    from barwright.llm import neardup, packing, quality, secret_scan
    from barwright.llm.common import staged

    now, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = staged(stage(spark, now, sf), name)
        assert now.columns == corpus_pipeline.COLUMNS
        counts.append(now.count())
        if name == "quality_rules":
            assert {r[0] for r in now.select("doc_id").collect()} == {r[0] for r in quality.judged(docs, ["doc_id"]).where("kept").collect()}
        elif name == "near_duplicates":
            assert neardup.joined(now).where("n_links > 0").count() == 0
        elif name == "secrets":
            assert secret_scan.scanned(now).agg({"n_live": "sum"}).first()[0] == 0
    assert counts[0] > counts[1] > counts[2] == counts[3]
    tokens = packing.packed(now).agg({"length": "sum"}).first()[0]
    assert corpus_pipeline.run(spark, sf).agg({"length": "sum"}).first()[0] == tokens


def test_odd_rows(spark, sf, odd):
    now = odd
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
    assert now.count() >= 0
    now = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
    assert now.count() == 0


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
