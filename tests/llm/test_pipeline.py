import re
from collections import Counter

import corpus_pipeline
from granary.llm import mixing
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_phrases import brute as passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mixing", "tokens"]

    def step(name, df):
        stages[name](spark, df, SF).write.parquet(f"file://{tmp_path}/{name}")
        return spark.read.parquet(f"file://{tmp_path}/{name}")

    good = step("quality", docs)
    assert good.schema == docs.schema
    kept = {r.doc_id for r in good.collect()}
    assert sum(kept.isdisjoint([d]) != bool(q) for d, q in labels.items()) >= 0.93 * len(labels)

    rows = [(r.doc_id, r.text) for r in good.collect()]
    one = step("near_duplicates", good)
    assert one.schema == docs.schema
    assert {r.doc_id for r in one.collect()} == {d for (d, _, c), n in groups(rows, 80, 5).items() if d == c}

    cut = step("repeated_passages", one)
    assert cut.schema == docs.schema
    before = {r.doc_id: r for r in one.collect()}
    removed = {d: n for d, _, n, _ in passages([(r.doc_id, r.text) for r in before.values()], 20)}
    after = {r.doc_id: r for r in cut.collect()}
    assert after.keys() == before.keys()
    for d, r in after.items():
        assert len(WORD.findall(before[d].text)) - len(WORD.findall(r.text)) == removed[d]
        assert removed[d] or r == before[d]

    mixed = step("mixing", cut)
    assert mixed.schema == docs.schema
    want = {r.doc_id: r.copies for r in mixing.mix(cut).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(want)

    out = step("tokens", mixed).collect()
    assert Counter(r.doc_id for r in out) == Counter(want) and all(r.lossless for r in out)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "ids"}
