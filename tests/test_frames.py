import pytest
from pyspark.sql import functions as F

from shoal.operators import frames, histogram, multiplex, ordered, sampling
from shoal.sources import io


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_natural_join(spark):
    a = spark.createDataFrame([(i, 2 * i, 3 * i) for i in range(1, 10)], "a int, b int, c int")
    b = spark.createDataFrame([(i, 2 * i, 4 * i) for i in range(1, 13)], "a int, b int, d int")
    joined = frames.natural_join(a, b)
    assert joined.columns == ["a", "b", "c", "d"]
    assert rows(joined) == [(i, 2 * i, 3 * i, 4 * i) for i in range(1, 10)]
    none = frames.natural_join(a, spark.createDataFrame([(1,)], "f int"))
    assert none.columns == ["a", "b", "c", "f"] and none.count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([(i, 2 * i, 4 * i) for i in range(1, 6)], "a int, b int, c int")
    assert [list(r[0]) for r in frames.dense_vectors(df, "b", "c").collect()] == [[2.0 * i, 4.0 * i] for i in range(1, 6)]
    assert all(list(r.features) == [2 * r.label, 4 * r.label] for r in frames.labeled_points(df, "a", "b", "c").collect())


def test_splits(spark):
    df = spark.createDataFrame([(v,) for v in (1, 0, 2, 0, 3, None, 4, 0, 5, 0)], "v int")
    yes, no = frames.split_filter(df, F.col("v") > 0)
    assert sorted(r.v for r in yes.collect()) == [1, 2, 3, 4, 5] and no.count() == 5
    left, right = frames.split_either(df.where("v is not null"), F.col("v") == 0, F.lit("0"), F.col("v"))
    assert [r.value for r in left.collect()] == ["0"] * 4 and sorted(r.value for r in right.collect()) == [1, 2, 3, 4, 5]


@pytest.fixture(scope="module")
def six(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate([0, 3, 6, 1, 4, 7, 2, 5, 8])], "ord long, v int").repartition(3)


def values(df):
    return [r.v for r in df.orderBy("ord").collect()]


@pytest.mark.parametrize("n", [0, 1, 6, 9, 12])
def test_drop(six, n):
    all_ = [0, 3, 6, 1, 4, 7, 2, 5, 8]
    assert values(ordered.drop(six, n, "ord")) == all_[n:]
    assert values(ordered.drop_right(six, n, "ord")) == all_[: max(0, 9 - n)]


def test_drop_while(six):
    assert values(ordered.drop_while(six, F.col("v") < 7, "ord")) == [7, 2, 5, 8]
    assert values(ordered.drop_while(six, F.col("v") < 9, "ord")) == []
    assert len(values(ordered.drop_while(six, F.col("v") < 0, "ord"))) == 9


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_scan(spark, parts):
    data = [(i, (i * 37) % 11) for i in range(40)]
    df = spark.createDataFrame(data, "ord long, v long").repartition(parts)
    sums = [sum(v for _, v in data[: i + 1]) for i in range(40)]
    assert [r.scanned for r in ordered.scan_left(df, "v", "ord", 0).orderBy("ord").collect()] == [0, *sums]
    assert [r.scanned for r in ordered.scan(df, "v", "ord", "max").orderBy("ord").collect()] == [max(v for _, v in data[: i + 1]) for i in range(40)]
    assert [r.scanned for r in ordered.scan_with(df, "v", "ord", 0, lambda a, b: a + b, "ord long, scanned long").orderBy("ord").collect()] == sums


def test_scan_empty_and_general(spark):
    none = spark.createDataFrame([], "ord long, v long")
    assert rows(ordered.scan_left(none, "v", "ord", 0)) == [(0, 0)]
    four = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "ord long, v string")
    assert [r.scanned for r in ordered.scan_left_with(four, "ord", "", lambda s, r: s + r.v, "ord long, scanned string").orderBy("ord").collect()] == ["", "a", "ab", "abc"]


def test_paste(spark, six):
    other = spark.createDataFrame([(100 - i, i) for i in range(9)], "k long, w int")
    got = ordered.paste(six, other, "ord", "k").orderBy("ord").collect()
    assert [(r.v, r.w) for r in got][:2] == [(0, 8), (3, 7)]
    with pytest.raises(ValueError, match="length"):
        ordered.paste(six, other.limit(3), "ord", "k")


def test_mux(spark):
    df = spark.createDataFrame([(v, (v - 1) // 5) for v in range(1, 11)], "v int, bucket int")
    outs = multiplex.mux(df, "bucket", [F.max("v"), 2 * F.max("v"), 3 * F.max("v")])
    assert [sorted(r.value for r in o.collect()) for o in outs] == [[5, 10], [10, 20], [15, 30]]
    a, b = multiplex.flat_mux_with(df, "bucket", 2, lambda k, p: ([p.v.max(), p.v.min()], []), "int")
    assert sorted(r.value for r in a.collect()) == [1, 5, 6, 10] and b.count() == 0
    with pytest.raises(Exception, match="instead of"):
        multiplex.mux_with(df, "bucket", 3, lambda k, p: (1,), "int")[0].collect()


def test_flat_mux_by_rows(spark):
    df = spark.range(30_000, numPartitions=1).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("bucket"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"), F.col("id").cast("string").alias("s"))

    def f(k, p):
        assert len(p) <= 10_000  # a batch, not the bucket
        return p.v[p.v % 2 == 0], p.s

    whole, pieces = ([o.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")) for o in outs] for outs in (
        multiplex.flat_mux_with(df, "bucket", 2, lambda k, p: (p.v[p.v % 2 == 0], p.s), ["long", "string"]), multiplex.flat_mux_with(df, "bucket", 2, f, ["long", "string"], by_rows=True)))
    assert [set(o.collect()) for o in whole] == [set(o.collect()) for o in pieces]
    assert sum(r.n for r in pieces[1].collect()) == 30_000


def test_split_samples(spark):
    df = spark.range(2000)
    parts = multiplex.weighted_split_sample(df, [2, 1, 1], F.col("id"), 5)
    got = [{r.id for r in p.collect()} for p in parts]
    assert sum(map(len, got)) == 2000 and set.union(*got) == set(range(2000))
    assert abs(len(got[0]) - 1000) < 120
    with pytest.raises(ValueError):
        multiplex.split_sample(df, 0, F.col("id"))


def test_histogram(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 2, 3, 3)], "v int")
    hist = lambda **k: [(r.value, round(r.freq, 4)) for r in histogram.hist_by(df, F.col("v"), **k).orderBy("place").collect()]
    assert hist() == [(3, 3.0), (2, 2.0), (1, 1.0)]
    assert hist(cumulative=True) == [(3, 3.0), (2, 5.0), (1, 6.0)]
    assert hist(normalized=True) == [(3, 0.5), (2, 0.3333), (1, 0.1667)]
    assert hist(normalized=True, cumulative=True) == [(3, 0.5), (2, 0.8333), (1, 1.0)]
    assert histogram.promise(spark.range(1, 101), F.sum("id").alias("s")).first().s == 5050
    sink = histogram.sample_sink(df, F.col("v")).first()
    assert (sink.n, sink.least, sink.most, round(sink.variance, 4)) == (6, 1, 3, 0.5556)


def test_samples(spark):
    assert sampling.sample_fraction(10, 20) == 1.0 and sampling.sample_fraction(0, 5) == 0.0
    assert sampling.sample_by_size(spark.range(100), 1000).count() == 100
    assert sampling.sample_distinct(spark.range(50), 7, 3).distinct().count() == 7
    with pytest.raises(ValueError):
        sampling.sample_distinct(spark.createDataFrame([(1,), (1,)], "v int"), 2)
    patterns = spark.createDataFrame([([1.0, 0.0, 0.0],), ([0.0, 1.0, 0.0],), ([0.0, 0.0, 1.0],)] * 300, "features array<double>")
    drawn = [r.features for r in sampling.iid_features(patterns, 999, seed=1).collect()]
    assert len(drawn) == 999 and all(abs(sum(r[i] for r in drawn) / 999 - 1 / 3) < 0.06 for i in range(3))
    both = sum(r[0] and r[1] for r in drawn) / 999
    assert 0.07 < both < 0.16  # independent, though never together in the input


def test_load_dir(spark, tmp_path):
    for i in range(1, 4):
        spark.createDataFrame([(i * j,) for j in range(1, 11)], "i int").write.parquet(str(tmp_path / "box" / f"n{i}"))
    assert io.load_dir(spark, str(tmp_path / "box"), 2).count() == 30
    assert io.list_dir(spark, str(tmp_path / "no")) is None and io.read_dir(spark, str(tmp_path / "no")) == []
    with pytest.raises(ValueError):
        io.load_dir(spark, str(tmp_path / "no"))
    assert spark.createDataFrame([(1, None)], "a int, b string").select(io.csv_line(F.col("a"), F.col("b")).alias("l")).first().l == "1,null"
