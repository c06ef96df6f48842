"""The stages of the pipeline against plain versions, one after the other."""

import corpus_pipeline
import llm_brute as brute

SF_DIR = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        path = str(tmp_path / str(k))
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "language_id":
            assert len(rows) >= 0.98 * len(before)
        elif name == "minhash_near_dedup":
            assert {r.doc_id for r in rows} == {i for i, w in brute.near_duplicates(list(before.items())).items() if w[2]}
        elif name == "substring_dedup":
            want = brute.substring_dedup(list(before.items()))
            assert len(rows) == len(before)
            for r in rows:
                assert brute.sha(r.text) == want[r.doc_id][2] if want[r.doc_id][1] else r.text == before[r.doc_id]
                assert r.n_chars == len(r.text)
        elif name == "decontamination":
            assert {r.doc_id for r in rows} == {i for i, w in brute.decontamination(list(before.items()), items).items() if not w[4]}
        else:
            assert {r.doc_id: tuple(r)[1:] for r in rows} == brute.byte_bpe(list(before.items()))
