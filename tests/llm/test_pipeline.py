"""The pipeline against a brute-force version, and the registered queries."""

import pathlib
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, "/root/repo")
from test_texts import brute_groups, brute_spans

import __spark_entry__
import corpus_pipeline
from logloom.llm import language_id
from logloom.llm.queries import piece_model
from logloom.llm.sentencepiece_codec import Codec

DATA = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    model, reader = language_id.fit_documents(docs), language_id.Reader()
    ids = sorted(held)
    kept = [i for i, (lang, score, _) in zip(ids, language_id.label([held[i] for i in ids], reader, model), strict=True) if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    kept = [i for i, (_, c) in brute_groups([(i, held[i]) for i in kept], 5, 80, 100).items() if c == i]

    def redacted(text):
        out, to = [], 0
        for _, a, b in brute_spans(text):
            if a >= to:
                out += [text[to:a], "[SECRET]"]
            to = max(to, b)
        return "".join([*out, text[to:]])

    library = Codec(piece_model()).library
    wanted = {i: library.encode(redacted(held[i]), add_bos=True, add_eos=True) for i in kept}
    found = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, DATA).collect()}
    assert found == wanted


def test_stages_keep_columns_and_mixing_orders_files(spark, odd_docs, no_docs):
    names = ["_blob", "spans", "blob", "lang_pred", "score", "text_hash", "mix_slot", "mix_source"]
    clashing = odd_docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    for docs in (odd_docs, no_docs, clashing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
            if docs is clashing:
                assert {tuple(r) for r in out.select(*names).collect()} == {tuple(f"own {n}" for n in names)}
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()


def test_stages_decide_by_row(spark):
    text = "the cat and the dog are thinking about the long way home to the river "
    other = "a second and quite different text of many words about bread and water for all of them "
    rows = [(7, text, "en"), (7, "123 456", None), (None, "", None), (None, text, "en"), (8, text, "en"), (8, other, "en"), (9, other, "en"), (9, other, "en"), (3, "one more", "en"), (3, "one more", "en")]
    docs = spark.createDataFrame([(i, t, k, "a", 1) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)

    def held(df):
        return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)

    wanted = sorted(((i, t) for i, t, k in rows if k), key=repr)
    assert held(stages["language"](spark, docs, DATA)) == wanted
    # 8's first text is a copy of 7's; 9's is one of 8's second; repeats of one id and text are one.
    assert held(stages["near_copies"](spark, docs.where("lang IS NOT NULL"), DATA)) == sorted([(7, text), (None, text), (8, other), (3, "one more")], key=repr)
    secret = spark.createDataFrame([(1, "token = abcdefghijklmnop x", 26), (1, "clean", 5), (2, "token = abcdefghijklmnop x", 26), (None, None, 0)], "doc_id long, text string, n_chars long")
    found = sorted((tuple(r) for r in stages["secrets"](spark, secret, DATA).collect()), key=repr)
    assert found == sorted([(1, "[SECRET] x", 10), (1, "clean", 5), (2, "[SECRET] x", 10), (None, None, 0)], key=repr)


def test_the_run_leaves_only_its_result(spark):
    corpus_pipeline.run(spark, DATA).count()
    left = [p.name for p in pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).glob("logloom-pipeline-*/*") if p.is_dir()]
    assert set(left) == {"tokens"}


def test_registered_queries():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op1_language_id", "op9_toxicity", "op2_pfair_mix", "op4_pii_feistel"])
def test_queries_return_every_document(spark, name):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    found = __spark_entry__.queries()[name](spark, DATA)
    assert found.count() == n == found.select("doc_id").distinct().count()
