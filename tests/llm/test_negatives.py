"""Hard negatives against brute force, on several blocks and rounds and on awkward rows."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pedigraph.llm import negatives

ROWS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_pairs_above_a_threshold(spread):
    rng = np.random.default_rng(int(spread * 2))
    scale = np.exp(-spread * np.arange(40) / 8)
    a, x = (np.floor(256 * rng.normal(size=(n, 40)) * scale).astype(np.int64) for n in (30, 500))
    x[7] = 0
    full = a @ x.T
    for rank in (1, 20, 400, 500):
        least = np.sort(full, axis=1)[:, -rank]
        i, j, score = negatives.above(a, x, least, slab=8)
        assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(full >= least[:, None]))) and (score == full[i, j]).all()
    none = negatives.above(a, x, np.full(30, 10**9))
    assert not len(none[0]) and len(negatives.above(a[:0], x, np.empty(0, np.int64))[0]) == 0


def rows_of(seed, n, dim=12, labels=4):
    rng = random.Random(seed)
    rows = [(k * rng.choice([1, 1, 50]) % 5000, [rng.gauss(0.3, 1) for _ in range(dim)], rng.randrange(labels)) for k in range(n)]
    rows += [(k, [rng.choice([0.0, 0.5, 1.0]) for _ in range(dim)], rng.randrange(labels)) for k in range(5000, 5400)]  # many ties
    return rows


AWKWARD = [(100, None, 1), (200, [1.0, None] + [0.0] * 10, 1), (300, [float("nan")] * 12, 2), (400, [0.0] * 12, 3), (None, [1.0] * 12, 1), (500, [1.0] * 12, None),
           (600, [1.0, 2.0], 1), (601, [2.0, 1.0], 1), (602, [1.0, 1.0], 2), (700, [], 1), (701, [], 2), (702, [], 1), (800, [1e30] * 12, 1), (900, [math.inf] * 12, 1)]


def slow(rows, of=lambda i: i % 100 == 0):
    kept = set()
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None or any(x is None or not math.isfinite(x) or abs(x) >= 1 << 19 for x in vector):
            continue
        kept.add((vec_id, str(label), tuple(math.floor(256 * float(np.float32(x))) for x in vector)))
    out = set()
    for anchor in {i for i, _, _ in kept if of(i)}:
        _, label, q = min(r for r in kept if r[0] == anchor)
        line = sorted((-sum(a * b for a, b in zip(q, v)), i, other) for i, other, v in kept if i != anchor and len(v) == len(q))
        for score, positive, _ in [x for x in line if x[2] == label][:5]:
            window = [x for x in line if x[2] != label and 30 * -score <= 100 * -x[0] <= 90 * -score][:10]
            out |= {(anchor, positive, n + 1, x[1], -score, -x[0]) for n, x in enumerate(window)}
    return out


@pytest.mark.parametrize("sample,block,chunk", [(4096, 4096, 4096), (60, 64, 8), (0, 100, 1000)])
def test_against_brute_force(spark, sample, block, chunk):
    rows = rows_of(sample, 500) + AWKWARD
    rows += rows[:20] + [(123, [0.5] * 12, 1)] * 7
    df = spark.createDataFrame(rows, ROWS).withColumn("id", F.lit("x")).withColumn("tag", F.lit("y")).withColumn("q", F.lit("z"))
    got = negatives.mined(df, "id % 100 = 0", sample=sample, block=block, chunk=chunk).collect()
    want = slow(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want and len(want) > 300
    assert negatives.mined(df.limit(0), "id % 100 = 0").count() == 0


def test_query_equals_its_sql(spark, tmp_path):
    rows = rows_of(3, 400) + [r for r in AWKWARD if r[1] is None or len(r[1]) != 0]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = negatives.op11_hard_negatives(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    answer = con.execute(negatives.ORACLE)
    names = [c[0] for c in answer.description]
    want = answer.fetchall()
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(want) and want
