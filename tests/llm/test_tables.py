"""Operators on whole tables: mixing, near copies, neighbours, shards, and the pipeline."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pedigraph.llm import components, hashing, mixing, pairs, sharding, simhash
from pedigraph.llm.vectors import unit
from tests.llm.helpers import DOCS, SF, awkward, clashing, empty


def slow_roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, k) for k in range(501, 560)]
    edges = spark.createDataFrame(links + [(None, 3), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges, "a", "b").collect()}
    want = slow_roots({n for e in links for n in e}, links)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components.components(edges.limit(0), "a", "b").count() == 0


def slow_print(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def test_fingerprints():
    for t in (None, "", " \n", "One", "One two three", "a b c d", "A b c d e é É x a b c d", "x y z w " * 30):
        assert simhash.fingerprint(t) & (1 << 64) - 1 == slow_print(t)


@pytest.mark.parametrize("blocks,tile", [(None, 2048), (6, 8), (8, 16)])
def test_fingerprints_within_the_radius(spark, blocks, tile):
    rng = random.Random(blocks or 1)
    prints = {0, (1 << 64) - 1}
    for _ in range(30):
        base = rng.getrandbits(64)
        prints |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(6)}
    prints |= {(1 << rng.randrange(64)) for _ in range(40)}  # one dense group around zero
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.linked(frame, 4, blocks, tile)
    got = {r.node: r.root for r in components.components(links, "a", "b").collect()}
    mask = (1 << 64) - 1
    want = slow_roots(sorted(signed), [(a, b) for a in signed for b in signed if ((a ^ b) & mask).bit_count() <= 4])
    assert {n: got.get(n, n) for n in signed} == want


def test_near_copies_rows(spark):
    rows = simhash.near_copies(clashing(awkward(spark))).collect()
    by = {r.id: r.component for r in rows}
    assert len(rows) == 11 and by[2] == 1 and by[7] == 3 and by[4] == 3 and by[5] == 5
    assert simhash.near_copies(empty(spark)).count() == 0


def test_shards(spark):
    docs = clashing(awkward(spark))
    rows = sharding.shard(docs, 3).collect()
    assert len(rows) == 11
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {r.size for r in rows if r.id in (3, 4)} == {16} and [r.crc for r in rows if r.id == 1] == [zlib.crc32(b"Alpha beta gamma delta eps zeta")]
    assert sharding.shard(empty(spark)).count() == 0


def test_shards_cut_one_hot_text(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("other "), "id")).alias("text"))
    rows = sharding.shard(docs, 8).toPandas()
    held = rows.groupby("shard")["size"].sum()
    assert len(held) == 8 and held.max() - held.min() <= 2 * rows["size"].max()
    again = sharding.shard(docs.repartition(7), 8).toPandas()
    assert dict(zip(rows["id"], rows["shard"])) == dict(zip(again["id"], again["shard"]))


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 1)
    rows = sharding.keyed(spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text")))
    rows = rows.selectExpr("*", "size as bytes", "1L as copies").cache()
    total = rows.agg(F.sum("size")).first()[0]
    bounds, found = sharding.splitters(rows, 3000, total, 2)
    first = np.unique(sharding._quantiles(sharding._sample(rows, "size", 32 / total), 32))
    assert found["rows"].sum() == 3000 and len(bounds) > len(first)


def mix_sources(spark):
    return spark.range(600).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 400, "big").when(F.col("id") < 550, "mid").when(F.col("id") < 597, "small").alias("source"),
        F.expr("repeat('w ', cast(id % 9 as int))").alias("text"))


def test_mixing_meets_the_repetition_limit(spark):
    rows = mixing.schedule(mix_sources(spark), mixing.Target(repetition=3.0)).toPandas()
    copies = rows.groupby("id").size()
    assert copies.min() >= 1 and copies.max() <= 4
    smallest = rows[rows["source"].isna()]
    assert smallest["tokens"].sum() / smallest.drop_duplicates("id")["tokens"].sum() == pytest.approx(3.0, rel=0.2)
    for _, part in rows.groupby("source", dropna=False):
        part = part.sort_values("start")
        assert (part["start"].to_numpy()[1:] == part["tokens"].cumsum().to_numpy()[:-1]).all()  # budgets fill without a gap
        for _, epoch in part.groupby("epoch"):
            assert not epoch["id"].duplicated().any()
        assert part["position"].between(0, 1, inclusive="left").all()


def test_mixing_meets_an_entropy_and_a_budget(spark):
    docs = mix_sources(spark)
    rows = mixing.schedule(docs, mixing.Target(repetition=None, entropy=0.8, budget=1500))
    w = [r.weight for r in rows.select("source", "weight").distinct().collect()]
    assert len(w) == 4 and sum(w) == pytest.approx(1, abs=1e-6) and -sum(x * np.log(x) for x in w) / np.log(4) == pytest.approx(0.8, abs=1e-4)
    assert rows.agg(F.sum("tokens")).first()[0] == pytest.approx(1500, abs=40)
    with pytest.raises(ValueError):
        mixing.Target(repetition=None)


def test_mixing_rows(spark):
    docs = clashing(awkward(spark))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert out.count() >= docs.count() and mixing.mixed(empty(spark)).count() == 0 and mixing.schedule(empty(spark)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, seed=4, n=160, d=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[40:80] = x[0] + 0.08 * rng.normal(size=(40, d)).astype(np.float32)  # near copies
    x[80:90] = x[3]  # exact copies
    rows = [(i, [float(v) for v in r], i % 3 if i >= 90 else 1) for i, r in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * d, 1), (1002, [float("nan")] * d, 1), (1003, [None] + [1.0] * (d - 1), 1), (1004, rows[0][1], None),
             (1005, [1.0, 2.0], 1), (1006, [2.0, 4.0], 1), (1007, [], 1), (1008, [float("inf")] + [1.0] * (d - 1), 1), (None, rows[0][1], 1)]
    return spark.createDataFrame(rows, VECTORS), rows


@pytest.mark.parametrize("tile,leading", [(512, 4), (16, 5)])
def test_near_vectors(spark, tile, leading):
    frame, rows = vectors(spark)
    got = {r.id: (r.n_links, r.component) for r in pairs.near_vectors(clashing(frame), tile=tile, leading=leading).collect()}
    good = [(i, unit(np.array([v], dtype=np.float64))[0], lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for a, x, l in good for b, y, m in good if a != b and l == m and len(x) == len(y) and float(x @ y) >= 0.98]
    roots = slow_roots([i for i, *_ in rows if i is not None], links)
    assert got.pop(None) == (0, None)
    assert got == {i: (sum(a == i for a, _ in links), roots[i]) for i in roots}
    assert pairs.near_vectors(frame.limit(0)).count() == 0


def test_suffix_bounds_lose_no_pair():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 20))
    x[30:] = x[:30] + rng.normal(size=(30, 20)) * rng.uniform(0, 0.4, size=(30, 1))
    axes = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    for leading in (1, 7, 20, 50):
        i, j = pairs.linked_pairs(x, x, axes, 0.98, leading)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(unit(x) @ unit(x).T >= 0.98))))


def test_probing_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(3)
    q, b = rng.integers(0, 256, (20, 6), dtype=np.uint8), rng.integers(0, 256, (300, 6), dtype=np.uint8)
    b[:100] = q[rng.integers(0, 20, 100)] ^ (1 << rng.integers(0, 8, (100, 6))).astype(np.uint8) * (rng.random((100, 6)) < 0.5)
    for radius in (0, 3, 6, 13, 48):
        far = np.bitwise_count(q[:, None] ^ b[None]).sum(axis=2)
        got = hashing.retrieve(q, b, radius)
        assert set(zip(*map(np.ndarray.tolist, got))) == set(zip(*map(np.ndarray.tolist, np.nonzero(far <= radius))))


def test_nearest_recall_and_order(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = frame.orderBy("vec_id").collect()
    x, ids = unit(np.array([r.embedding for r in rows], dtype=np.float64)), [r.vec_id for r in rows]
    got = hashing.nearest(frame, "id % 50 = 0").collect()
    asked, hits = [i for i, v in enumerate(ids) if v % 50 == 0], 0
    for i in asked:
        mine = sorted((r for r in got if r.query_id == ids[i]), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and [r.score for r in mine] == sorted((r.score for r in mine), reverse=True)
        cosine = x[i] @ x.T
        for r in mine:
            assert r.vec_id != ids[i] and r.score == pytest.approx(cosine[ids.index(r.vec_id)], abs=1e-12)
        cosine[i] = -2
        hits += len({ids[k] for k in np.argsort(-cosine)[:5]} & {r.vec_id for r in mine})
    assert hits >= 0.9 * 5 * len(asked)


def test_nearest_rows(spark):
    frame, rows = vectors(spark)
    got = hashing.nearest(clashing(frame), "id % 50 = 0 or id >= 1000").collect()
    assert {r.query_id for r in got} == {0, 50, 100, 150, 1004, 1005, 1006}
    assert [(r.vec_id, r.rank) for r in got if r.query_id == 1005] == [(1006, 1)]  # all candidates, if fewer
    zero = sorted((r.rank, r.vec_id) for r in got if r.query_id == 0)
    assert zero[0] == (1, 1004)
    assert hashing.nearest(frame.limit(0), "id % 50 = 0").count() == 0


def test_repeated_neighbours_take_one_place(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    other = [(i, (base + 0.3 * rng.normal(size=8)).tolist()) for i in range(2, 9)]
    near = (base + 0.01).tolist()
    rows = [(0, base.tolist()), *[(1, near)] * 6, *[(1, [2.0 ** k * v for v in near]) for k in range(1, 6)], *other]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hashing.nearest(frame, "id = 0").orderBy("rank").collect()
    cosine = {i: float(unit(np.array([v]))[0] @ unit(np.array([base]))[0]) for i, v in [(1, near), *other]}
    assert [r.vec_id for r in got] == sorted(cosine, key=lambda i: -cosine[i])[:5]


def test_near_copy_stage_equals_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = ["", "one two"]
    for size in (12, 30, 60, 200, 900):
        base = rng.choices(words, k=size)
        for edits in (0, 1, 1, 1, 2, 2, 3, 5, 9):
            base = base if edits < 3 else base[:]
            copy = base[:]
            for _ in range(edits):
                copy[rng.randrange(size)] = rng.choice(words)
            base = copy if rng.random() < 0.4 else base  # chains of copies
            texts.append(" ".join(copy))
    line = rng.choices(words, k=12)
    texts += [" ".join(line + rng.choices(words, k=n)) for n in (0, 1, 2, 3, 4, 20) for _ in range(6)]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (t.split() for t in texts)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    roots = slow_roots(range(len(texts)), links)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert kept == sorted(set(roots.values())) and len(kept) < len(texts) - 20


def test_near_copy_stage_keeps_the_links_of_fingerprints(spark):
    rng = random.Random(55)
    words = [f"w{i}" for i in range(900)]
    base = rng.choices(words, k=500)
    copy = base[:]
    for k in range(5, 500, 33):
        copy[k] = rng.choice(words)
    a, b = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (base, copy))
    texts = [" ".join(base), " ".join(copy), " ".join(rng.choices(words, k=500))]
    one, two = (simhash.fingerprint(t) & (1 << 64) - 1 for t in texts[:2])
    assert 5 * len(a & b) < 4 * len(a | b) and (one ^ two).bit_count() <= simhash.RADIUS
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [0, 2]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        kept[name] = docs.count()
    assert kept["near_copies"] < kept["language"] and kept["secrets"] == kept["near_copies"] and kept["mixture"] >= kept["secrets"]
    assert docs.columns == [*corpus_pipeline.COLUMNS, "n_pieces", "piece_ids"]


def test_pipeline_stages_on_awkward_rows(spark):
    rows = awkward(spark)
    near = corpus_pipeline.near_copies(spark, rows, "").collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in near) == [(False, 1), (False, 3), (False, 5), (False, 6), (False, 8), (True, None)]
    twice = spark.createDataFrame([(1, "a b c d e", "en", "a", 9)] * 3 + [(None, "a b c d e", "en", "a", 9)], DOCS)
    assert [r.doc_id for r in corpus_pipeline.near_copies(spark, twice, "").collect()] == [1]
    clean = {r.text: r.n_chars for r in corpus_pipeline.secrets(spark, rows, "").collect()}
    assert clean["password = [secret]"] == 19
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), "").count() == 0


def test_shards_against_a_plain_placement(spark):
    rng = random.Random(17)
    rows = [(rng.randrange(400), rng.choice(["same text", f"text {rng.randrange(90)}" * rng.randrange(1, 200), None]), "en", "a", 0) for _ in range(900)]
    rows += [(7, "again " * 50, "en", "a", 0)] * 800 + [(None, "no id", "en", "a", 0)] * 5
    docs = spark.createDataFrame(rows, DOCS)
    ordered = sorted(((r.key, r.id is not None, r.id or 0, r.size, r.crc or -1) for r in sharding.keyed(docs).collect()))
    total, start, want, nth = sum(r[3] for r in ordered), 0, [], {}
    for _, known, doc_id, size, crc in ordered:
        shard = min(6, (2 * start + size) * 7 // (2 * total))
        want.append((doc_id if known else None, size, None if crc == -1 else crc, shard, nth.get(shard, 0)))
        nth[shard] = nth.get(shard, 0) + 1
        start += size
    assert sorted(map(tuple, sharding.shard(docs, 7).collect()), key=repr) == sorted(want, key=repr)
