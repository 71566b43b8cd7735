"""What the Katz operator writes, and orders beyond the registered one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers as H
from tidemark.llm import katz

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def zipf_texts(n, size, seed):
    r = random.Random(seed)
    return [" ".join(f"w{int(r.paretovariate(0.7))}" for _ in range(size)) for _ in range(n)]


def docs(spark, texts):
    rows = [(i, i % 10 == 0, t) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, h boolean, text string").repartition(2)


def test_tables_take_few_bytes_a_token(spark):
    _, df = docs(spark, zipf_texts(60, 2000, 1))
    model = katz.Model(df, F.col("h"), 3, 20_000, 20_000)
    tokens = model.blocks.agg(F.sum("size")).first()[0]
    size = 0
    for t in model.tables:
        for name, kind in t.dtypes:
            if kind == "binary":
                size += t.agg(F.sum(F.octet_length(name))).first()[0] or 0
            elif kind == "array<binary>":
                size += t.agg(F.sum(F.aggregate(name, F.lit(0), lambda a, x: a + F.octet_length(x)))).first()[0] or 0
    assert size < 1.8 * tokens


def test_shuffled_rows_end_with_their_job(spark):
    before = spark.conf.get(CLEANUP)
    _, df = docs(spark, ["a b c", "a b d"])
    scores = katz.Model(df, F.col("h")).scores()
    assert scores.sparkSession.conf.get(CLEANUP) == "true" and spark.conf.get(CLEANUP) == before
    # the result reads stored tables, so it can be read again
    assert sorted(scores.collect()) == sorted(scores.collect()) != []


@pytest.mark.parametrize("size", [2_000_000, 300])
def test_order_four_equals_dictionaries(spark, size):
    rows, df = docs(spark, [*zipf_texts(80, 25, 2), "", "w1", "w1 w1 w2"])
    mine = {x.doc_id: (x.score, x.base_score) for x in katz.Model(df, F.col("h"), 4, size, size).scores().collect()}
    for (doc_id, _, _), expected in zip(rows, H.katz_scores([(h, t) for _, h, t in rows], 4, katz.discounts), strict=True):
        assert np.allclose(mine[doc_id], expected, atol=1e-8)
