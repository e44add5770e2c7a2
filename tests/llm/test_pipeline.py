import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from curatrix.llm import toxicity

from .test_duplicates import components, norm
from .test_scans import brute


def test_pipeline_equals_a_plain_version(spark, sf):
    docs, labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    clean = {r.doc_id for r in toxicity.toxicity(docs, labels).filter("predicted = 0").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in clean)
    first = {}
    for i, t in rows:
        first.setdefault(norm(t), i)
    rows = [(i, t) for i, t in rows if first[norm(t)] == i]
    kept = {i for i, (_, _, own) in components(rows, 5).items() if own}
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = [(i, t) for i, t in rows if i in kept and not brute(t, items)[1]]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: library.encode(t) for i, t in rows} and 0 < len(got) < docs.count()


def test_stages_hand_on_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    empty = docs.filter("false")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf)
        assert out.collect() == [] and (name == "sentencepiece" or out.columns == docs.columns)


def test_stages_keep_one_row_of_each_class(spark, sf):
    """Ids may be repeated or null: what counts is the row, not its id."""
    long = " ".join(f"word{k}" for k in range(60))
    other = " ".join(f"term{k}" for k in range(60))
    rows = [(1, long), (1, long), (1, long.replace(" ", "  ", 1)), (2, other), (2, long), (None, "only here, said once and no more"), (None, other), (None, "only here, said once and no more"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = sorted((r.doc_id is None, r.doc_id, norm(r.text)) for r in corpus_pipeline.drop_copies(spark, docs, sf).collect())
    want = [(False, 1, norm(long)), (False, 2, norm(other)), (True, None, ""), (True, None, norm(rows[5][1]))]
    assert texts == want
    near = [(1, long), (1, long), (1, long + " tail"), (2, long + " end"), (2, other), (None, other + " tail"), (None, rows[5][1]), (None, rows[5][1]), (None, other.upper() + " once"), (4, ""), (4, "")]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(near, "doc_id long, text string"), sf).collect()
    assert len(got) == 5 and sorted((r.doc_id or 0, r.text[:4]) for r in got) == [(0, "only"), (1, "word"), (2, "term"), (4, ""), (4, "")]


def test_stages_take_columns_of_any_name(spark, sf):
    rows = [(k % 3, f"words that are said {k % 3} times in here", True, k, {"a": k}) for k in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, single boolean, key int, row map<string,int>").withColumns({"id": F.lit(1), "kept_id": F.lit("x"), "n": F.lit(2)})
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.drop_contaminated):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {0, 1, 2}
    assert corpus_pipeline.drop_copies(spark, docs, sf).count() == 3


def test_entry_has_the_queries():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
