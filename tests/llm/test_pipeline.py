import random

import corpus_pipeline
import pytest
from test_shingles import plain_kept

from tidewatch.llm import toxicity


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(11)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(k, text(60)) for k in range(800)]
    toxic = {k for k in range(0, 800, 4)}
    docs = [(k, " ".join([t, "blockhead scoundrel dimwit", t[:40]]) if k in toxic else t) for k, t in docs]
    leak = text(30)
    docs += [(1300, docs[1][1]), (1301, docs[1][1]), (1310, f"{docs[2][1]} {leak} {docs[3][1]}"), (1320, docs[5][1] + " call me at +1 (415) 555-7713 please"), (1321, text(60) + " call me at +1 (415) 555-7714 please"), (1330, None), (1340, ""), (1350, "tail " * 30_000), (1300, docs[1][1])]
    spark.createDataFrame([(d, t, "en", "s", len(t or ""), 7) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long, score int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(800)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs, toxic


def test_stages_take_effect(spark, tables):
    sf_dir, docs, toxic = tables
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = frame.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf_dir)
        assert frame.columns == columns
        frame.write.parquet(f"{sf_dir}/{name}")
        frame = spark.read.parquet(f"{sf_dir}/{name}")
        kept[name] = {r.doc_id: r for r in frame.collect()}
    clean = set(range(800)) - toxic
    assert len(toxic & set(kept["toxicity"])) <= 0.05 * len(toxic) and len(clean - set(kept["toxicity"])) <= 0.03 * len(clean)
    before = [(d, t) for d, t in docs if d in kept["toxicity"]]
    assert set(kept["near_duplicates"]) == plain_kept(before)
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {1310}
    masked = kept["personal_data"][1321]
    assert set(kept["personal_data"]) == set(kept["decontamination"])
    assert "[phone]" in masked.text and masked.n_chars == len(masked.text)
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept["personal_data"])


def test_held_out_rows_are_never_fitted(spark, tables, monkeypatch):
    sf_dir, _, _ = tables
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda examples: seen.extend(examples) or None)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    toxicity.fit(docs, labels)
    known = labels.where(~toxicity.held_out(labels.doc_id)).count()
    assert len(seen) == known


def test_stages_on_odd_rows_and_empty_tables(spark, tables):
    sf_dir, docs, _ = tables
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    broken = spark.sql("SELECT 2000L AS doc_id, CAST(X'6A6F65406D61696C2E636F6DFF2020' AS STRING) AS text, 'en' AS lang, CAST(NULL AS STRING) AS source, CAST(NULL AS BIGINT) AS n_chars, 7L AS score")
    odd = spark.createDataFrame([(None, docs[1][1]), (None, None), (None, ""), (2001, None), (2001, None), (2002, ""), (2003, " \n\t ")], "doc_id long, text string")
    odd = odd.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars", "7L AS score").unionByName(broken)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame.limit(40).unionByName(odd), sf_dir)
        rows = out.collect()
        assert out.columns == frame.columns, name
        # null, empty and blank texts are copies of one another
        kept = {2000, 2001} if name == "near_duplicates" else {2000, 2001, 2002, 2003}
        assert sum(r.doc_id is None for r in rows) == 3 and {r.doc_id for r in rows if r.doc_id and 2000 <= r.doc_id < 2010} == kept, name
        assert sum(r.doc_id == 2001 for r in rows) == 2
        empty = stage(spark, frame.limit(0), sf_dir)
        assert empty.columns == frame.columns and empty.count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert {2000, 2001, None} <= {r.doc_id for r in last(spark, odd, sf_dir).collect()} and last(spark, frame.limit(0), sf_dir).count() == 0
