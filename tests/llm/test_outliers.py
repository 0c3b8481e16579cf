"""Quality rules: counts by plain Python, estimates by numpy, the query by its SQL."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pedigraph.llm import outliers
from tests.llm.helpers import DOCS, awkward, clashing, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    met = {g for g in grams if grams.count(g) > 1} if len(grams) < 400 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    covered = {k + j for k, g in enumerate(grams) if g in met for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "théta", "iota", "kappa", "la", "mu", "nu", "xi", "中文", "\U0001f389x"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\n", "\t", "\x0b"]) for _ in range(rng.randrange(1, 120)))
        if i % 9 == 0:
            text += "\n" + "\n".join([" ".join(rng.choices(words, k=3))] * rng.randrange(1, 4)) * 2
        if i % 11 == 0:
            text = " ".join("".join(rng.choices("#*$%&|<>abcdef", k=9)) for _ in range(60))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), len(text)))
    return rows + [(n, None, "en", "a", 0), (n + 1, "", "de", "b", 0), (n + 2, " \n \n", None, None, 4), (n + 3, "same\nsame\r\nsame", "en", "a", 15)]


def test_counts(spark):
    rows = texts(1, 150)
    long = " ".join(random.Random(2).choices([f"w{k}" for k in range(4000)], k=60_000)) + "\n" + "x y z v w u " * 20
    df = clashing(spark.createDataFrame([*rows, (9000, long, "en", "a", 1), (9000, long, "en", "a", 1)], DOCS)).withColumn("g", F.lit("x")).withColumn("v1", F.lit("y"))
    got = {r.id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in outliers.counted(df).collect()}
    assert got == {r[0]: slow_counts(r[1]) for r in [*rows, (9000, long)]}


def slow_fit(x):
    """Mean and covariance of the nearest three quarters, by concentration from the same two starts."""
    floors, cut = np.diag((np.array(outliers.FLOORS) * outliers.SCALE) ** 2), []
    middle = lambda v: np.sort(v, axis=0)[(len(v) - 1) // 2]
    m = middle(x)
    for mean, cov in ((m, np.diag(2.198 * middle(np.abs(x - m)) ** 2) + floors), (x.mean(axis=0), np.cov(x.T, bias=True) + floors)):
        for _ in range(outliers.STEPS):
            near = nearest(x, mean, cov)
            mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) + floors
        cut.append((np.linalg.det(cov), mean, cov))
    _, mean, cov = min(cut, key=lambda c: c[0])
    near = nearest(x, mean, cov)
    return near.mean(axis=0), outliers.CONSISTENT * np.cov(near.T, bias=True) + floors


def distances(x, mean, cov):
    return np.einsum("ij,ij->i", x - mean, np.linalg.solve(cov, (x - mean).T).T)


def nearest(x, mean, cov):
    b = np.floor(outliers.BUCKETS * np.log(distances(x, mean, cov) + 1e-6))
    return x[b <= np.sort(b)[int(np.ceil(0.75 * len(x))) - 1]]


def test_distances_and_planted_rows(spark):
    rng = random.Random(4)
    words = [f"wort{k}" for k in range(50)] + list("abcdefghijklmnop")
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(30, 90))), "en", "a", 0) for i in range(400)]
    rows += [(1000 + i, " ".join("%%$#" + "q" * 12 + str(rng.random()) for _ in range(40)), "en", "a", 0) for i in range(60)]
    got = {r.id: r for r in outliers.screened(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].kept for i in range(400)) and not any(got[i].kept or got[i].base_failed for i in range(1000, 1060))
    n, chars, symbols, dups, repeats = np.array([slow_counts(r[1]) for r in rows], dtype=float).T
    shares = [(chars + 500) / (n + 100), 1 + 100 * symbols / (chars + 500), 1 + 100 * dups / 21, 1 + 100 * repeats / (n + 100)]
    x = np.floor(outliers.SCALE * np.log(np.array(shares))).T
    want = distances(x, *slow_fit(x))
    assert np.allclose([got[r[0]].distance for r in rows], want, rtol=1e-6)


def test_awkward_rows(spark):
    got = outliers.screened(clashing(awkward(spark)))
    assert got.count() == awkward(spark).count() and got.where("kept is null or base_failed is null").count() == 0
    assert outliers.screened(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", [5, 6])
def test_query_equals_its_sql(spark, tmp_path, seed):
    spark.createDataFrame(texts(seed, 900), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    df = outliers.op13_quality_outliers(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    answer = con.execute(outliers.ORACLE)
    names = [c[0] for c in answer.description]
    got = sorted(tuple(r) for r in df.select(*names).collect())
    assert got == sorted(answer.fetchall()) and {r[-1] for r in got} == {True, False}
