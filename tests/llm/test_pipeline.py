import __spark_entry__
import corpus_pipeline
from loomframe.llm.common import durable, read
from loomframe.llm import bpe
from tests.llm.helpers import SF


def test_stages_in_order(spark):
    docs = read(spark, SF, "documents")
    ids, columns = {r.doc_id for r in docs.collect()}, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = durable(stage(spark, docs, SF), f"stage{k}")
        if k < 4:
            assert docs.columns == columns, name
            now = {r.doc_id for r in docs.collect()}
            assert now <= ids, name
            ids = now
    want = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.digests(before).collect()}
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in docs.collect()} == want
    assert docs.count() == before.count() > 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_on_rows_without_ids_texts_or_any_row(spark):
    docs = read(spark, SF, "documents").limit(60)
    odd = docs.limit(5).selectExpr("cast(null as bigint) doc_id", "text", "lang", "cast(null as string) source", "n_chars")
    blank = docs.limit(5).selectExpr("doc_id + 1000000 as doc_id", "cast(null as string) text", "lang", "source", "n_chars")
    own = durable(docs.union(docs.limit(7)).union(odd).union(blank), "odd")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, own, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        rows = out.collect()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in own.collect()}, name
        if k < 4:
            assert out.columns == docs.columns, name
        if k == 0:
            assert not any(r.text is None for r in rows)  # no words: rejected
        if k == 4:
            assert len(rows) == own.count()


def test_nothing_is_left_when_a_stage_rejects_all(spark):
    blank = durable(read(spark, SF, "documents").limit(20).selectExpr("doc_id", "'' as text", "lang", "source", "n_chars"), "blank")
    for name, stage in corpus_pipeline.STAGES:
        blank = durable(stage(spark, blank, SF), "blank")
    assert blank.count() == 0
