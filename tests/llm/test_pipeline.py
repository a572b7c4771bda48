import re

import corpus_pipeline
from apexframe.llm import packing, personal, quality, similarity, toxicity
from apexframe.llm.queries import QUERIES, table, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "ngram_jaccard_join", "personal_data", "best_fit_packing"]


def test_one_query_per_operator():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES]
    assert sorted(numbers) == list(range(1, 11))


def test_pipeline_equals_its_operators_one_by_one(spark):
    """The same decisions from the operators' own results, kept in Python."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ddl = "doc_id long, text string"

    def frame(kept):
        return spark.createDataFrame(sorted(kept.items()), ddl)

    forest = quality.fit(quality.document_statistics(docs.join(labels.filter("quality = 1"), "doc_id", "left_semi")), labels)
    import pyarrow as pa

    ids = sorted(texts)
    keep = quality.verdicts(quality.statistics(pa.array([texts[i] for i in ids])), forest)[2]
    kept = {i: texts[i] for i, ok in zip(ids, keep) if ok}
    civil = {r.doc_id for r in toxicity.toxicity(frame(kept), labels).collect() if r.predicted == 0}
    kept = {i: t for i, t in kept.items() if i in civil}
    first = {r.class_id for r in similarity.jaccard_join(frame(kept)).collect()}
    kept = {i: personal.masked_text(t) for i, t in kept.items() if i in first}
    want = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack(frame(kept), tokenizer_path("word_bpe_49k.json")).collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    assert 0 < len({r.doc_id for r in got}) < len(texts)


def test_filtering_stages_keep_all_columns(spark, edges, nothing):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (edges, nothing):
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count(), name
