"""Block-gzip lines and interval operators against plain Python."""

import gzip
import random
import struct
import zlib

from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThanOrEqual

from pedigraph.operators.intervals import dyadic_nodes, first_containing, merge_intervals, with_masks
from pedigraph.sinks import write_lines
from pedigraph.sources import regions
from pedigraph.sources.text import read_lines


def test_block_gzip_lines_split_anywhere(spark, tmp_path):
    rng = random.Random(2)
    lines = [f"line{i}:" + "".join(rng.choices("ACGT0123456789", k=rng.randint(0, 300))) for i in range(3000)]
    data = ("\n".join(lines) + "\n").encode()
    path = tmp_path / "b.txt.gz"
    with open(path, "wb") as fh:
        for at in [*range(0, len(data), 9000), None]:
            block = b"" if at is None else data[at:at + 9000]
            c = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = c.compress(block) + c.flush()
            fh.write(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(block), len(block)))
    read_lines(spark, str(path)).count()
    got = spark.read.format("bgzip_lines").option("path", str(path)).option("split_bytes", 7000).load()
    assert got.rdd.getNumPartitions() > 5
    assert [r.value for r in got.orderBy("block", "seq").collect()] == lines


def test_text_outputs_are_put_together_from_parts(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, f"{i}\t" + "é" * rng.randrange(5) + "x" * rng.choice([0, 10, 70_000])) for i in range(900)]
    df = spark.createDataFrame(rows, "n long, value string").repartitionByRange(7, "n").sortWithinPartitions("n")
    for name in ("a.txt", "b.vcf.gz"):
        listed = write_lines(df, str(tmp_path / name), ["#head", "#two"])
        data = (tmp_path / name).read_bytes()
        assert sum(e["size"] for e in listed) == len(data) and len(listed) > 3 and not (tmp_path / f"{name}.parts").exists()
        text = gzip.decompress(data) if name.endswith("gz") else data
        assert text.decode() == "".join(f"{v}\n" for v in ["#head", "#two", *(v for _, v in rows)])
    got = spark.read.format("bgzip_lines").option("path", str(tmp_path / "b.vcf.gz")).option("split_bytes", 20_000).load()
    assert [r.value for r in got.orderBy("block", "seq").collect()][2:] == [v for _, v in rows]
    write_lines(df.limit(0), str(tmp_path / "c.gz"), ["#only"])
    assert gzip.decompress((tmp_path / "c.gz").read_bytes()) == b"#only\n"


def test_merged_intervals(spark):
    rng = random.Random(9)
    rows = [("k" if rng.random() < 0.6 else "j", s := rng.randint(0, 3000), s + rng.randint(1, 90)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    want = []
    for key in "jk":
        for s, e in sorted((s, e) for k, s, e in rows if k == key):
            if want and want[-1][0] == key and s <= want[-1][2]:
                want[-1][2] = max(want[-1][2], e)
            else:
                want.append([key, s, e])
    assert sorted(map(list, merge_intervals(df, ["k"], "s", "e", chunk=256).collect())) == want


def test_first_segment_of_each_point(spark):
    rng = random.Random(4)
    segments = [(rng.choice("xy"), a := rng.randint(0, 900), a + rng.randint(0, 300), i) for i in range(60)]
    points = [(rng.choice("xyz"), rng.randint(0, 1300), i) for i in range(500)]
    got = first_containing(spark.createDataFrame(points, "c string, p long, n long"), spark.createDataFrame(segments, "c string, s long, e long, no long")
                           .selectExpr("c", "s", "e", "no", "no * 2 as twice"), ["c"], "p", "s", "e", "no", ["twice"]).collect()
    want = {n: next((2 * i for c2, s, e, i in segments if c2 == c and s <= p <= e), None) for c, p, n in points}
    assert len(got) == 500 and {r.n: r.twice for r in got} == want


def test_a_segment_becomes_few_ranges(spark):
    rng = random.Random(8)
    rows = [(a := rng.randrange(-5000, 10**6), a + rng.choice([0, 1, 7, 900, 10**5])) for _ in range(200)] + [(0, 2**30), (5, 4)]
    made = spark.createDataFrame(rows, "s long, e long").select("s", "e", dyadic_nodes("s", "e").alias("n")).collect()
    for r in made:
        spans = sorted((n._node << n._level, n._node + 1 << n._level) for n in r.n)
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and len(spans) <= 2 * max(1, r.e - r.s + 1).bit_length()
        assert not spans if r.e < r.s else (spans[0][0], spans[-1][1]) == (r.s, r.e + 1)


def test_masks_met_by_variants(spark):
    rng = random.Random(12)
    raw = [(no, rng.choice("ab"), s := rng.randrange(0, 4000), s + rng.choice([1, 5, 40, 700])) for no in (0, 1, 2) for _ in range(25)]
    merged = merge_intervals(spark.createDataFrame(raw, "mask_no int, contig string, s long, e long"), ["mask_no", "contig"], "s", "e")
    rows = [(i, rng.choice("abc"), rng.randrange(1, 5000), "A" * rng.choice([1, 1, 1, 3, 60])) for i in range(400)]
    got = with_masks(spark.createDataFrame(rows, "n long, contig string, pos long, ref string"), merged, ["one", "two", "one"], chunk=256).collect()
    want = {n: {["one", "two", "one"][no] for no, c, s, e in raw if c == contig and s < pos - 1 + len(ref) and e > pos - 1} for n, contig, pos, ref in rows}
    assert len(got) == 400 and all(set(r.masks) == want[r.n] and len(r.masks) == len(want[r.n]) for r in got) and any(want.values())


def test_a_region_reads_only_its_blocks(spark, tmp_path):
    rng = random.Random(14)
    rows = [(c, p, f"{c}\t{p}\tr{c}{p}\tA\tC\t9\tPASS\tX=" + "".join(rng.choices("abcdefgh", k=400))) for c in ("1", "2", "X") for p in range(10, 20_000, 40)]
    df = spark.createDataFrame([(i, v) for i, (_, _, v) in enumerate(rows)], "n long, value string").orderBy("n")
    path = str(tmp_path / "calls.vcf.gz")
    write_lines(df, path, ["##fileformat=VCFv4.2", "#CHROM\tPOS"])
    regions.write_block_index(spark, path, 20_000)
    split, index = regions.read_block_index(path)
    assert split == 20_000 and len(index) > 9
    for contig, first, last in (("2", 5000, 5400), ("X", 19_000, None), ("1", None, 100), ("7", 1, 2), (None, None, None)):
        reader = regions.FilteredCalls({"path": path}).reader(None)
        asked = [*([EqualTo(("chrom",), contig)] if contig else []), *([GreaterThanOrEqual(("pos",), first)] if first else []), *([LessThanOrEqual(("pos",), last)] if last else [])]
        assert list(reader.pushFilters(asked)) == asked
        got = regions.read_calls(spark, path, contig, first, last)
        want = [(c, p) for c, p, _ in rows if contig in (None, c) and (first or 0) <= p <= (last or 10**9)]
        assert sorted((r.chrom, r.pos) for r in got.select("chrom", "pos").collect()) == sorted(want)
        blocks = [p for p in reader.partitions() if p.start < p.end]
        assert got.rdd.getNumPartitions() == max(1, len(blocks))
        assert len(blocks) <= 3 if contig else len(blocks) == len({b for b, *_ in index})
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = spark.read.format("vcf_filtered").option("path", path).load().where("chrom = '2' and pos between 5000 and 5400")
        assert pushed.count() == 10 and pushed.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_places_between_segments_and_points_made_once(spark):
    """Gaps, borders of chunks, nested and empty segments against all pairs; the points stand once in the plan."""
    segments = [("1", 10, 40, 2), ("1", 20, 30, 1), ("1", 60, 70, 3), ("1", 90, 80, 0), ("2", 0, 200, 4), ("1", 130, 260, 5)]
    points = spark.range(0, 300, 1, 3).selectExpr("if(id % 3 = 0, null, cast(id % 3 as string)) as c", "if(id % 50 = 7, null, id) as p", "id as n")
    made = first_containing(points, spark.createDataFrame(segments, "c string, s long, e long, no long"), ["c"], "p", "s", "e", "no", ["no"], chunk=16)
    want = {}
    for c, p, n in points.collect():
        inside = [no for d, s, e, no in segments if c == d and p is not None and s <= p <= e]
        want[n] = (c, p, min(inside) if inside else None)
    got = made.collect()
    assert len(got) == 300 and {r["n"]: (r["c"], r["p"], r["no"]) for r in got} == want
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 300") == 1
