"""SQL checks of the registered queries, and the pipeline against its parts."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import brute
import corpus_pipeline
from compare import diff, duck
from tillgrain.llm.oracle import ORACLES
from tillgrain.llm.queries import QUERIES

PERSONAL = "mail7.example.com"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    assert diff(QUERIES[name](spark, sf).toArrow(), duck(sf).sql(ORACLES[name]).to_arrow_table()) is None


def test_stages_in_turn(spark):
    """Each stage keeps what brute force keeps, and later ones see its result."""
    good = " ".join(f"word{i}" for i in range(60))
    near = good.replace("word30", "other")
    mail = " ".join(f"term{i}" for i in range(40)) + f" me@{PERSONAL} end"
    data = [(1, good, "a", "a"), (2, good.upper(), "a", "a"), (3, near, "a", "b"), (4, "too short", "a", "b"), (5, mail, "a", "b"), (5, mail, "a", "b"), (6, None, "a", None)]
    docs = spark.createDataFrame([(d, t, "en", s, 0, x) for d, t, s, x in data], "doc_id long, text string, lang string, source string, n_chars long, sha string")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "sha"]
    assert kept == [[1, 2, 3, 5, 5], [2, 3, 5], [2, 5], [2, 5]]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert texts[2] == good.upper() and PERSONAL not in texts[5] and texts[5].startswith("term0 ")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == {2, 5} and sum(r["length"] for r in packed) == sum({r["doc_id"]: r["doc_tokens"] for r in packed}.values())


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_run_on_a_small_table(spark, sf):
    """Against brute force: documents that stay, and whole token counts."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base = brute.quality(rows)
    rows = [(d, t) for d, t in rows if base[d][0] >= 20 and 100 * base[d][4] <= 30 * base[d][0]]
    exact = brute.exact(rows)
    rows = [(d, t) for d, t in rows if exact[d][2]]
    near = brute.jaccard(rows)
    want = {d for d, _ in rows if near[d][1] == d}
    got = corpus_pipeline.run(spark, sf).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).toDF("doc_id", "length", "tokens").collect()
    assert {r["doc_id"] for r in got} == want and all(r["length"] == r["tokens"] for r in got)
