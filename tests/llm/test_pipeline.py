"""The corpus pipeline by stages, and its registration."""

import re

import pytest

import corpus_pipeline
from orrery.llm import decontaminate, mixing, quality, registry, tokens
from orrery.llm.common import saved
from orrery.session import table
from tests import oracle
from tests.llm.test_nearcopies import heads
from tests.llm.test_operators import odd, words  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = first = table(spark, SF, "documents")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs, before = saved(stage(spark, docs, SF), name), docs
        seen.append((name, before, docs))
    for name, _, after in seen[:-1]:
        assert after.columns == first.columns, name
    good, one, clean, mixed, files = (after for *_, after in seen)
    scores = quality.score(first, ["doc_id"], quality.fit(first, table(spark, SF, "labels")))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scores.where("score >= 0.5").collect()}
    kept = heads([(r.doc_id, r.text) for r in good.collect()])
    assert {r.doc_id for r in one.collect()} == kept and one.count() == len(kept)
    leaks = {r.doc_id for r in decontaminate.contaminated(one, table(spark, SF, "benchmark")).collect()}
    assert {r.doc_id for r in clean.collect()} == kept - leaks
    assert {r.doc_id for r in mixed.collect()} <= kept - leaks
    assert sorted(map(tuple, files.collect())) == sorted(map(tuple, tokens.encode_to_files(mixed).collect()))


def test_odd_documents_go_through(spark, odd, tmp_path):  # noqa: F811
    item = words(40, 77)
    leak = [(50, f"x {item} y", "en", "s", 1, 0, 0.5, 1, "h", 1), (51, words(80, 5), None, None, 1, 0, 0.5, 1, "h", 1), (51, words(80, 5), None, None, 1, 0, 0.5, 1, "h", 1)]
    odd.unionByName(spark.createDataFrame(leak, odd.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(d, 1, 0) for d in (3, 4, 50, 51)] + [(None, 0, 0), (2, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    docs = first = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = seen[name] = saved(stage(spark, docs, str(tmp_path)), name)
    assert all(seen[n].columns == first.columns for n in ("quality", "near_duplicates", "decontamination", "mixing"))
    clean = [r.doc_id for r in seen["decontamination"].collect()]
    assert 51 in clean and 50 not in clean and clean.count(51) == 1 and 5 not in clean  # 4 and 5 are copies
    assert sum(r.taken for r in mixing.mix(seen["decontamination"]).collect()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in seen["mixing"].collect())
    assert sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(repr, docs.collect()))
    for name in ("documents", "benchmark", "labels"):
        table(spark, str(tmp_path), name).limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_all_ten_are_registered(spark):
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twins(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), SF, registry.queries()[name], registry.oracle_sql()[name]) == ""
