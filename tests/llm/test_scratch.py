import pytest

from tidewatch.llm import scratch, toxicity


@pytest.fixture
def released(monkeypatch):
    """What the JVM says to each release."""
    said, plain = [], scratch.release
    for module in (scratch, toxicity):
        monkeypatch.setattr(module, "release", lambda spark: said.append(plain(spark)))
    return said


def test_a_written_table_releases_memory(spark, released):
    assert scratch.cut(spark.range(9)).count() == 9
    assert released == [True]


def test_a_fit_releases_its_examples(spark, released):
    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) is not None
    assert released == [True]


def test_a_jvm_without_the_command_goes_on(spark, monkeypatch):
    monkeypatch.setattr(scratch, "TRIM", "noSuchCommand")
    assert not scratch.release(spark)


def test_a_worker_trims_after_its_last_batch(monkeypatch):
    seen = []
    monkeypatch.setattr(scratch, "trim", lambda: seen.append("trim"))
    double = scratch.trimmed(lambda batches, by: (seen.append(x) or x * by for x in batches))
    assert list(double(iter([1, 2]), by=2)) == [2, 4]
    assert seen == [1, 2, "trim"]
