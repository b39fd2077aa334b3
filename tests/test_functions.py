import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.ml.linalg import DenseVector, SparseVector
from pyspark.sql import functions as F

from shoal.functions import arrays, jsonx, stats, text, timeutil
from shoal.functions.features import FeatureSpec, IndexFunction, InvertibleIndexFunction, OneHotModel, ml_vector
from shoal.queries import QUERIES


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize("message, expected", [
    ("Started  worker-7 (pool=blue) in 31 ms!", "Started worker-7 poolblue in ms"),
    ("mailto:ops@host.example, see /var/log/x.log.", "mailto:ops@host.example see /var/log/x.log"),
    ("\t12:30:05  ::retry::\n7% of 90", "retry of"),
    ("snake_case @user --flag", "snake_case user --flag"),
    ("", ""),
])
def test_tokens(spark, message, expected):
    assert one(spark, text.tokens(F.col("m")), m=message) == expected.split()


def test_tokens_post_and_keep(spark):
    assert one(spark, text.tokens(F.col("m"), post=F.reverse, keep=lambda t: F.length(t) == 3), m="sub no yrt gnol") == ["bus", "try"]


def test_tokens_at_once(spark):
    rng = np.random.default_rng(2)
    signs = list("aZ09_./:@- \t\n\x0b\f\r!\u00e9\u00a0\u0085$,")
    messages = [("".join(rng.choice(signs, int(n))),) for n in rng.integers(0, 25, 3000)] + [(None,), ("9" * 20_000,), ("a" + "." * 20_000,)]
    df = spark.createDataFrame(messages, "m string")
    slow = text.tokens(F.col("m"), post=lambda t: t)  # word by word
    fast = text.tokens(F.col("m"))
    assert df.where(~fast.eqNullSafe(slow)).count() == 0
    assert "transform" in str(slow) and "transform" not in str(fast)


def test_ml_vector(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.0],), ([1.0, 2.0, 0.0],), ([],), (None,), ([0.0, 0.0],), ([1.0, 0.0],)], "a array<double>").coalesce(1)
    made = df.select(ml_vector(F.col("a")).alias("v"), ml_vector(F.col("a"), sparse_at_half=False).alias("w"))
    assert "BatchEvalPython" not in made._jdf.queryExecution().executedPlan().toString()  # by column, not row by row
    dense, sparse = DenseVector, SparseVector
    assert [r.v for r in made.collect()] == [sparse(3, {1: 1.0}), dense([1.0, 2.0, 0.0]), dense([]), None, sparse(2, {}), sparse(2, {0: 1.0})]
    assert [type(r.w) for r in made.collect()] == [sparse, dense, dense, type(None), sparse, dense]


def test_whitelist(spark):
    words = [f"word{i}" for i in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    known = text.train_whitelist(df.limit(100).select("w"), "w").crossJoin(df.select("w"))
    got = {r.w: r.ok for r in known.select("w", text.maybe_contains(F.col("bitmap"), F.col("w")).alias("ok")).collect()}
    assert all(got[r.w] for r in df.limit(100).collect()) and sum(got.values()) < 150


@pytest.mark.parametrize("slices, expected", [
    ([0, 4, 11], [0, 4, 11]), ([-1, -12, -6], [11, 0, 6]), ([arrays.span(8, 10, 1, True)], [8, 9, 10]), ([arrays.span(1, -9)], [1, 2]), ([arrays.span(-2, 6, -1)], [10, 9, 8, 7]),
    ([arrays.span(-2, 6, -2, True)], [10, 8, 6]), ([arrays.span(1, 11, 5, True)], [1, 6, 11]), ([arrays.span(9)], [9, 10, 11]), ([arrays.span(None, 2)], [0, 1]), (["*", 5], [*range(12), 5]),
    ([arrays.span(step=4)], [0, 4, 8]), ([arrays.span(step=-5)], [11, 6, 1]), ([0, arrays.span(2, None, -1)], [0, 2, 1, 0]),
])
def test_rich_slice(spark, slices, expected):
    assert spark.range(1).select(arrays.rich_slice(F.sequence(F.lit(0), F.lit(11)), *slices).alias("x")).first().x == expected


def test_regex_and_time(spark):
    assert one(spark, arrays.regex_groups(F.col("s"), r"(\d+)::(\d+)", 2), s="123::456") == ["123", "456"]
    assert one(spark, arrays.regex_groups(F.col("s"), r"(\d+)::(\d+)", 2), s="x123::456") is None
    assert one(spark, timeutil.render(timeutil.parse(F.col("s"))), s="2016-07-08 01:23:45") == "2016-07-08 01:23:45"
    assert one(spark, F.dayofyear(timeutil.parse(F.col("s"))), s="2016-07-08 01:23:45") == 190
    a, b = timeutil.parse(F.lit("2016-01-01 23:00:00")), timeutil.parse(F.lit("2016-01-03 01:00:00"))
    assert spark.range(1).select(timeutil.days_between(a, b).alias("x")).first().x == 1


def test_json(spark):
    cars = '[{"make":"a","year":"1999"},{"make":"b","year":"2001"}]'
    assert one(spark, jsonx.transform(F.col("j"), lambda v: int(v) if isinstance(v, str) and v.isdigit() else v), j=cars) == '[{"make":"a","year":1999},{"make":"b","year":2001}]'
    assert one(spark, jsonx.transform_field(F.col("j"), lambda k, v: (k.upper(), v)), j='{"a":{"b":1}}') == '{"A":{"B":1}}'


@pytest.mark.parametrize("pairs, v", [([(1, 1), (2, 2), (3, 3)], 1.0), ([(1, 1), (1, 2), (2, 1), (2, 2)], 0.0), ([(1, 1), (1, 1)], 1.0), ([(1, 1), (1, 2)], 0.0), ([], 0.0)])
def test_cramers_v(spark, pairs, v):
    df = spark.createDataFrame(pairs, "x int, y int")
    assert stats.cramers_v(df, F.col("x"), F.col("y")).first().v == pytest.approx(v)


def test_permutation_p(spark):
    df = spark.createDataFrame([(i % 10, i % 10) for i in range(100)], "x int, y int")
    assert stats.permutation_p(df, "x", "y", 100, 1234) == 0.0


@pytest.mark.parametrize("shape", [1, 4])
def test_fit_pdf_reads_all_rows(spark, tmp_path, shape):
    rng = np.random.default_rng(shape)
    values = [*np.full(1000, 7.5), *np.round(rng.gamma(shape, 3.0, 4000), 2)]  # the first 1,000 rows are unlike the rest
    rows = [(i, float(v) * (-1) ** i) for i, v in enumerate(values)] + [(9999, None)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    density, parameters = stats.fit_pdf(values)
    got = QUERIES["a19_fit_pdf"](spark, str(tmp_path)).first()
    assert got.parameters == parameters and got.density == pytest.approx(density(1.0), rel=1e-9)
    assert stats.fit_pdf_of(spark.createDataFrame([(0.0,), (None,)], "v double"), F.col("v"))[1] == 0


@given(st.lists(st.integers(), max_size=5), st.lists(st.integers(), max_size=5), st.lists(st.integers(), max_size=5))
def test_index_function_laws(a, b, c):
    a, b, c = (IndexFunction.of(*x) for x in (a, b, c))
    assert (a + b) + c == a + (b + c) and a + IndexFunction(0) == a and (a + b).width == a.width + b.width


def test_invertible():
    f = InvertibleIndexFunction.serial("foo", 3)
    assert f(2) == "foo2" and f.inverse["foo1"] == 1
    with pytest.raises(ValueError):
        f + f
    with pytest.raises(KeyError):
        IndexFunction.undefined(3)(0)


def test_features(spark):
    x = F.lit(0.0)
    spec = FeatureSpec.of(x + 1, x + 2, x + 3).with_names("a", "b", "c")
    assert spec.quadratic().names.values[4] == "a*c"
    vec = lambda s: spark.range(1).select(s.array().alias("x")).first().x
    assert vec(spec.quadratic()) == [1, 2, 3, 2, 3, 6] and vec(spec.quadratic(["a", "b"], True)) == [1, 2, 3, 1, 2, 4]
    assert vec(spec + FeatureSpec.empty()) == [1, 2, 3] and spec.with_categories(b=4, zzz=1).categories.values == {1: 4}
    with pytest.raises(ValueError):
        spec.with_names("a")


def test_one_hot(spark):
    model = OneHotModel([("a", 3.0), ("b", 2.0), ("c", 1.0)])
    row = spark.createDataFrame([("b", ["a", "a", "z"]), ("z", [])], "v string, vs array<string>")
    got = lambda s: [r.x for r in row.select(s.array().alias("x")).collect()]
    assert got(model.one_hot(F.col("v"))) == [[0, 1, 0], [0, 0, 0]]
    assert got(model.one_hot(F.col("v"), undefined="?")) == [[0, 1, 0, 0], [0, 0, 0, 1]]
    assert got(model.multi_hot(F.col("vs"), undefined="?")) == [[1, 0, 0, 1], [0, 0, 0, 0]]
    assert got(model.hist(F.col("vs"), undefined="?")) == [[2, 0, 0, 1], [0, 0, 0, 0]]
    assert [v for v, _ in model.filtered(min_freq=2, max_prob=0.4).vocabulary] == ["b"]
    trained = OneHotModel.train(spark.createDataFrame([(v,) for v in (3, 2, 1, 2, 1, 1)], "v int"), F.col("v"))
    assert trained.vocabulary == [(1, 3.0), (2, 2.0), (3, 1.0)]
