"""The pipeline as a whole: each stage's decisions, and that the driver can do without it."""

import corpus_pipeline
from sextant.llm import pii, quality
from sextant.llm.stages import table


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == table(spark, sf, "documents").columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0
    assert pii.find_personal_data(docs).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    whole = corpus_pipeline.run(spark, sf)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, packed.collect())) == sorted(map(key, whole.collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "personal_data", "packing"]


def test_good_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    judged = quality.quality_rules(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id")
    rows = judged.where("not base_failed").select("kept", "quality").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1
