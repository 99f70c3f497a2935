"""The pipeline's stages on nulls, empty texts, repeated rows, extra columns and empty tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)
WORDS = "the harbour froze early that year and the boats stayed where they were until the middle of march "


def odd(spark):
    rows = [(k, f"{WORDS} number {k} {chr(97 + k % 26) * 3} {k * 7919}", ("en", "de")[k % 2], f"s{k % 3}", None) for k in range(40)]
    rows += [(50, None, "en", "s1", None), (51, "", None, None, 0), (52, " \n\t", "de", None, 3), (53, WORDS, None, None, 97), (None, WORDS * 2, "en", "s1", None), (7, rows[7][1], "en", "s1", None), (7, rows[7][1], "en", "s1", None)]
    return spark.createDataFrame(rows, DOC).withColumn("score", F.lit(1.5)).withColumn("bucket", F.lit("x")).withColumn("_key", F.lit(0)).withColumn("n_dropped", F.lit(1)).withColumn("ids", F.lit(1)).withColumn("component_id", F.lit(1)).withColumn("taken", F.lit(1))


@pytest.mark.parametrize("name", STAGES)
def test_odd_rows(spark, name):
    docs = odd(spark)
    out = STAGES[name](spark, docs, "/none")
    assert out.columns[:5] == list(corpus_pipeline.COLUMNS) and len(out.columns) == (8 if name == "encode" else 5)
    got, texts = out.collect(), [r["text"] for r in docs.collect()]
    ids = [r["doc_id"] for r in got]
    if name == "language_id":
        assert not set(ids) & {50, 51, 52} and set(range(40)) | {53, None} <= set(ids) and ids.count(7) == 3
    elif name == "near_dedup":
        assert ids.count(7) == 1 and len({r["text"] for r in got if (r["text"] or "").strip()}) == len([t for t in ids if t not in (50, 51, 52)])
        assert len(set(ids) & {50, 51, 52}) == 1
    elif name in ("line_dedup", "mix"):
        assert {r["text"] for r in got} <= {*texts, "", None}
    else:
        assert len(got) == len(texts) and all(r["same"] in (True, None) for r in got)
        assert {r["doc_id"]: r["n_ids"] for r in got}[51] == 0


@pytest.mark.parametrize("name", STAGES)
def test_empty_tables(spark, name):
    assert STAGES[name](spark, spark.createDataFrame([], DOC), "/none").count() == 0
