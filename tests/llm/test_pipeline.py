"""The pipeline against its stages done one by one in plain ways, and the registered names."""

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from tests.llm.test_operators import brute_classes

from tests.llm.test_operators import awkward, nothing

from arcloom.llm import decontaminate, jaccard_join, packing, queries, resampling, runtime, toxicity


def test_names():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
    assert {*queries.QUERIES, "pipeline"} <= {*entry.queries()}


def test_stages(spark, sf):
    docs = runtime.table(spark, sf, "documents")
    labels, bench = runtime.table(spark, sf, "labels"), runtime.table(spark, sf, "benchmark")
    rows = {r["doc_id"]: r for r in docs.collect()}
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before = out
        out = stage(spark, before, sf)
        ids = {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == ids
            continue
        out = spark.createDataFrame(out.collect(), docs.schema)
        kept = {r["doc_id"] for r in out.collect()}
        assert out.columns == docs.columns and all(rows[r["doc_id"]] == r for r in out.collect())
        if name == "toxicity":
            want = {r["doc_id"] for r in toxicity.score(before, toxicity.fit(before, labels)).collect() if not r["predicted"]}
        elif name == "quality":
            want = {r["doc_id"] for r in resampling.resample(before, resampling.fit(before, labels)).collect() if r["selected"]}
        elif name == "near_copies":
            want = {i for i, (_, c) in brute_classes({i: rows[i]["text"] for i in ids}).items() if i == c}
        else:
            items = [decontaminate.normal(r["text"]) for r in bench.collect()]
            want = {i for i in ids if not any(t and t in decontaminate.normal(rows[i]["text"]) for t in items)}
        assert kept == want


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and {"doc_id", "sequence_id", "offset"} <= {*out[0].asDict()}
    assert packing.pack(runtime.table(spark, sf, "documents").limit(0), corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_stages_on_awkward_rows(spark, sf):
    """Nulls, empty and very long texts, repeated rows and ids, and columns that differ from others by case alone."""
    labels, bench = runtime.table(spark, sf, "labels"), runtime.table(spark, sf, "benchmark")
    docs = runtime.table(spark, sf, "documents")
    net, model = toxicity.fit(docs, labels), resampling.fit(docs, labels)
    odd = awkward(spark)
    odd = odd.unionAll(odd.where("doc_id = 6").selectExpr("doc_id", "'another text of the same id'", "lang", "source", "n_chars", "n_tokens", "score", "host"))
    odd = odd.toDF("doc_id", "text", "lang", "source", "n_chars", "DOC_ID", "TEXT", "component_id")
    place = lambda df: sorted(((r[0] is None, r[0] or 0, r[1] or "") for r in df.collect()))
    for stage in (lambda d: toxicity.clean(d, net), lambda d: resampling.selected(d, model), jaccard_join.one_of_each, lambda d: decontaminate.clean(d, bench)):
        out = stage(odd)
        assert out.columns == odd.columns and {*place(out)} <= {*place(odd)}
        assert stage(odd.limit(0)).count() == 0
    one = place(jaccard_join.one_of_each(odd))
    assert (False, 6, "another text of the same id") in one and (False, 6, "one two") in one and (False, 7, "one two") not in one
    assert sum(x[1] == 4 for x in one) == 1 and (True, 0, "null id here") in one
    assert sum(not x[2].strip() for x in one) == sum(not x[2].strip() for x in place(odd))
    assert place(decontaminate.clean(odd, bench.limit(0))) == place(odd)
    assert decontaminate.matches(nothing(spark), bench.limit(0)).count() == 0


def test_each_stage_first_has_the_executors_collect_their_garbage(spark, monkeypatch):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    collected = lambda: sum(b.getCollectionCount() for b in beans())
    before = collected()
    runtime.trim_executors(spark)
    assert collected() > before  # the executor of local mode is this Java process

    class Begun(Exception):
        pass

    def begun(s):
        raise Begun

    monkeypatch.setattr(runtime, "trim_executors", begun)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Begun):
            stage(spark, None, "")


def test_near_copies_frees_spent_shuffles_before_whole_rows_are_dealt_out(spark, monkeypatch):
    told, checkpoint = [], runtime.checkpoint
    monkeypatch.setattr(runtime, "checkpoint", lambda df: told.append("checkpoint") or checkpoint(df))
    monkeypatch.setattr(runtime, "free_shuffles", lambda s: told.append("free"))
    texts = ["one two three four five six seven", "one two three four five six seven", "other words"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = corpus_pipeline.without_near_copies(spark, docs, "")
    assert told[-1] == "free"
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]
