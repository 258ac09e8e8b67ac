import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from spectraloom.llm import langid, packing, secrets, simhash, toxicity
from tests.llm.test_packing import verify
from tests.llm.test_simhash import components, fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf_dir, documents, tmp_path_factory):
    """Each stage's input and result, written and read again."""
    folder, docs, found = tmp_path_factory.mktemp("pipeline"), documents, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        result = spark.read.parquet(f"{folder}/{name}")
        found[name], docs = (docs, result), result
    return found


def test_stages(stages, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "secrets", "packing"]
    assert all(result.columns == documents.columns for name, (_, result) in stages.items() if name != "packing")


def test_language_and_toxicity(spark, sf_dir, stages):
    docs, kept = stages["language"]
    model = langid.learn_languages(langid.taught(docs))
    sure = {r.doc_id for r in langid.identify(docs, model).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_CERTAIN}
    assert {r.doc_id for r in kept.collect()} == sure and len(sure) >= 0.97 * docs.count()
    docs, kept = stages["toxicity"]
    net = toxicity.learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score_toxicity(docs, net).collect() if not r.predicted}
    assert {r.doc_id for r in kept.collect()} == clean


def test_one_of_each_group(stages):
    docs, kept = stages["near_duplicates"]
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    groups = components([fingerprint(t) for _, t in rows])
    assert sorted(r.doc_id for r in kept.collect()) == [rows[i][0] for i in sorted(set(groups))]


def test_secrets_are_masked(stages):
    docs, masked = stages["secrets"]
    found = {r.doc_id: r for r in masked.collect()}
    spans = {r.doc_id: r.spans for r in secrets.find_secrets(docs).collect()}
    assert set(found) == set(spans)
    for r in docs.collect():
        text, at, parts = r.text, 0, []
        for s in spans[r.doc_id]:
            if s.start >= at:
                parts += [text[at : s.start], secrets.MASK]
            at = max(at, s.end)
        assert found[r.doc_id].text == "".join([*parts, text[at:]])
        assert found[r.doc_id].n_chars == len(found[r.doc_id].text)


def test_packing(stages, word_model):
    docs, pieces = stages["packing"]
    import pyarrow as pa

    rows = docs.collect()
    ids = packing.WordTokenizer.of(word_model).encode(pa.array([r.text for r in rows]))
    verify(pieces.collect(), {r.doc_id: [*map(int, own), 1] for r, own in zip(rows, ids)})


def test_run_is_the_stages(spark, sf_dir, stages):
    found = __spark_entry__.queries()["pipeline"](spark, sf_dir)
    columns = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, found.where("length = 2048").select(columns).collect())) == sorted(map(tuple, stages["packing"][1].where("length = 2048").select(columns).collect()))
    assert found.agg(F.sum("length")).first() == stages["packing"][1].agg(F.sum("length")).first()


def test_odd_tables(spark, odd_documents, tmp_path):
    folder, docs = str(tmp_path / uuid.uuid4().hex), odd_documents
    spark.createDataFrame([(1, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for docs in (odd_documents, odd_documents.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, folder)
            assert name == "packing" or result.columns == odd_documents.columns
            docs = spark.createDataFrame(result.collect(), result.schema)


def test_simhash_contract():
    assert (simhash.SHINGLE_WORDS, simhash.MAX_BITS) == (3, 2)
