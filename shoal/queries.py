"""Queries over the test tables, one or more for each group of operators, with their SQL."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays, jsonx, stats, text, timeutil
from .functions.features import FeatureSpec, OneHotModel, active_keys, compressed, density, ml_vector, vector_with_id
from .operators import cluster, frames, histogram, multiplex, ordered, sampling, som
from .plans.lineage import lineage
from .plans.tables import shared_folder, stash
from .sources import io

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"), spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# --- joins and loading


@query("entry_labelled_language", """
WITH h AS (SELECT lang AS value, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1),
p AS (SELECT value, n / (SELECT sum(n) FROM h) AS p, row_number() OVER (ORDER BY n DESC, value) AS place FROM h)
SELECT value, round(sum(p) OVER (ORDER BY place), 6) AS freq, place::INTEGER AS place FROM p""")
def _(t, spark, d):
    joined = frames.natural_join(t("documents"), t("labels"))
    return histogram.hist_by(joined, F.col("lang"), normalized=True, cumulative=True).select("value", r6(F.col("freq")).alias("freq"), "place")


@query("j1_natural_join_docs", "SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def _(t, spark, d):
    return frames.natural_join(t("documents").drop("text"), t("labels"))


@query("j1_natural_join_two_keys", """
SELECT l_orderkey AS orderkey, l_suppkey AS custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_suppkey = o_custkey GROUP BY 1, 2""")
def _(t, spark, d):
    left = t("lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_suppkey").alias("custkey"), "l_linenumber")
    right = t("orders").select(F.col("o_totalprice"), F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))
    return frames.natural_join(left, right).groupBy("orderkey", "custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("j2_natural_join_disjoint", "SELECT 0::BIGINT AS n, 'r_regionkey,r_name,event_id,ts,user_id,event_type,value,props' AS columns")
def _(t, spark, d):
    joined = frames.natural_join(t("region"), t("events"))
    return joined.agg(F.count(F.lit(1)).alias("n")).withColumn("columns", F.lit(",".join(joined.columns)))


@query("j7_cross_product", "SELECT r_name, n_name FROM region, nation")
def _(t, spark, d):
    return frames.cross_product(t("region").select("r_name"), t("nation").select("n_name"))


@query("s1_union_load", "SELECT o_orderpriority AS value, 2 * count(*) AS n FROM orders GROUP BY 1")
def _(t, spark, d):
    both = io.load_all(spark, [f"{d}/orders.parquet"] * 2, 4)
    return histogram.count_by(both, F.col("o_orderpriority"))


@query("s1_load_dir", "SELECT 2 * count(*) AS n, count(DISTINCT n_nationkey) AS keys FROM nation")
def _(t, spark, d):
    import uuid

    folder = f"{shared_folder(spark)}/dir-{uuid.uuid4().hex}"
    for part in ("a", "b"):
        t("nation").write.parquet(f"{folder}/{part}")
    return io.load_dir(spark, folder).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("n_nationkey").alias("keys"))


@query("s5_csv_line", """
SELECT n_nationkey, concat(n_nationkey, ',', n_name, ',', coalesce(CASE WHEN n_regionkey > 1 THEN n_regionkey END::VARCHAR, 'null')) AS line FROM nation""")
def _(t, spark, d):
    return t("nation").select("n_nationkey", io.csv_line(F.col("n_nationkey"), F.col("n_name"), F.when(F.col("n_regionkey") > 1, F.col("n_regionkey"))).alias("line"))


@query("s7_rgb", """
SELECT p_partkey, (r << 16) | (g << 8) | b AS rgb, (a << 24) | (r << 16) | (g << 8) | b AS argb, ((255 * (1 - 0.25))::INTEGER) * 65793 AS gray FROM (
  SELECT p_partkey, trunc(255 * (p_size % 7 / 8.0))::INTEGER AS r, trunc(255 * (p_size % 5 / 8.0))::INTEGER AS g, trunc(255 * (p_size % 3 / 8.0))::INTEGER AS b, 64 AS a FROM part)""")
def _(t, spark, d):
    part = lambda n: F.col("p_size") % n / F.lit(8.0)
    return t("part").select("p_partkey", io.rgb(part(7), part(5), part(3)).alias("rgb"), io.argb(F.lit(0.2520), part(7), part(5), part(3)).alias("argb"), io.grayscale(F.lit(0.25), inverse=True).alias("gray"))


# --- projections and splits


@query("p1_dense_vectors", "SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount AS b, l_linenumber::DOUBLE AS c FROM lineitem")
def _(t, spark, d):
    v = t("lineitem").select("l_orderkey", "l_linenumber", frames.doubles("l_quantity", "l_discount", "l_linenumber").alias("v"))
    return v.select("l_orderkey", "l_linenumber", *[F.col("v")[i].alias(n) for i, n in enumerate("abc")])


@query("p2_labeled_points", "SELECT p_size::DOUBLE AS label, round(sum(p_retailprice), 4) AS price, sum(p_partkey)::DOUBLE AS keys FROM part GROUP BY 1")
def _(t, spark, d):
    points = frames.labeled_points(t("part"), "p_size", "p_retailprice", "p_partkey").select("label", vector_to_array("features").alias("v"))
    return points.groupBy("label").agg(F.round(F.sum(F.col("v")[0]), 4).alias("price"), F.sum(F.col("v")[1]).alias("keys"))


@query("p4_split_filter", "SELECT l_discount > 0.05 AS side, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(t, spark, d):
    yes, no = frames.split_filter(t("lineitem").select("l_discount", "l_returnflag"), F.col("l_discount") > 0.05)
    return yes.withColumn("side", F.lit(True)).union(no.withColumn("side", F.lit(False))).groupBy("side", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("p5_split_either", """
SELECT 'left' AS side, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_discount > 0.05
UNION ALL SELECT 'right', count(*), round(sum(l_quantity), 2) FROM lineitem WHERE NOT l_discount > 0.05""")
def _(t, spark, d):
    left, right = frames.split_either(t("lineitem"), F.col("l_discount") > 0.05, F.col("l_extendedprice"), F.col("l_quantity"))
    each = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return each(left, "left").union(each(right, "right"))


@query("p6_predicates", "SELECT '(p_size <= 10)' AS rule, count(*) AS n FROM part WHERE p_size <= 10 UNION ALL SELECT '(p_size > 10)', count(*) FROM part WHERE p_size > 10 UNION ALL SELECT '(p_size in [1,2])', count(*) FROM part WHERE p_size IN (1, 2) UNION ALL SELECT '(p_size not-in [1,2])', count(*) FROM part WHERE p_size NOT IN (1, 2)")
def _(t, spark, d):
    part = t("part")
    atoms = [frames.at_most("p_size", 10), frames.above("p_size", 10), frames.among("p_size", [1, 2]), frames.not_among("p_size", [1, 2])]
    counts = part.agg(*[F.count_if(c).alias(f"c{i}") for i, (c, _) in enumerate(atoms)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"c{i}").alias("n")) for i, (_, name) in enumerate(atoms)])).alias("x")).select("x.*")


# --- order


@query("l1_drop", "SELECT event_id, event_type FROM events ORDER BY event_id OFFSET 137")
def _(t, spark, d):
    return ordered.drop(t("events").select("event_id", "event_type"), 137, "event_id")


@query("l2_drop_right", "SELECT event_id, event_type FROM events ORDER BY event_id DESC OFFSET 137")
def _(t, spark, d):
    return ordered.drop_right(t("events").select("event_id", "event_type"), 137, "event_id")


@query("l3_drop_while", "SELECT event_id, event_type FROM events WHERE event_id >= (SELECT min(event_id) FROM events WHERE NOT event_type <> 'purchase')")
def _(t, spark, d):
    return ordered.drop_while(t("events").select("event_id", "event_type"), F.col("event_type") != "purchase", "event_id")


@query("w1_scan_left_sum", """
SELECT 0::BIGINT AS ord, 0.0::DOUBLE AS scanned UNION ALL
SELECT row_number() OVER (ORDER BY event_id), round(sum(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 3) FROM events""")
def _(t, spark, d):
    return ordered.scan_left(t("events"), "value", "event_id", 0.0).select("ord", F.round("scanned", 3).alias("scanned"))


@query("w1_scan_left_with", """
SELECT 0::BIGINT AS ord, 0::BIGINT AS scanned UNION ALL
SELECT row_number() OVER (ORDER BY c_custkey), sum(2 * c_nationkey + 1) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING)::BIGINT FROM customer""")
def _(t, spark, d):
    return ordered.scan_left_with(t("customer").select("c_custkey", "c_nationkey"), "c_custkey", 0, lambda s, r: s + 2 * r.c_nationkey + 1, "ord long, scanned long")


@query("w2_scan_max", "SELECT event_id, max(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS scanned FROM events")
def _(t, spark, d):
    return ordered.scan(t("events").select("event_id", "value"), "value", "event_id", "max").select("event_id", "scanned")


@query("w2_scan_with", "SELECT event_id, max(user_id) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS scanned FROM events")
def _(t, spark, d):
    return ordered.scan_with(t("events"), "user_id", "event_id", -1, max, "event_id long, scanned long")


@query("w4_cascade", "SELECT bucket::INTEGER AS bucket, sum(n) OVER (ORDER BY bucket)::BIGINT AS total FROM (SELECT r_regionkey AS bucket, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)")
def _(t, spark, d):
    import pandas as pd

    def step(pdf, before):
        return pd.DataFrame({"bucket": [pdf["n_regionkey"].iloc[0]], "total": [len(pdf) + (0 if before is None else int(before["total"].iloc[0]))]})

    return ordered.cascade(t("nation"), "n_regionkey", step, "bucket int, total long")


@query("j4_paste", """
SELECT a.c_custkey, b.c_nationkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) a
JOIN (SELECT c_nationkey, row_number() OVER (ORDER BY -c_custkey) AS k FROM customer) b USING (k)""")
def _(t, spark, d):
    right = t("customer").select((-F.col("c_custkey")).alias("key"), "c_nationkey")
    return ordered.paste(t("customer").select("c_custkey"), right, "c_custkey", "key").select("c_custkey", "c_nationkey")


@query("j5_paste_by", "SELECT a.n_name AS a, b.n_nationkey * 2 AS b FROM nation a JOIN nation b ON a.n_nationkey = 24 - b.n_nationkey")
def _(t, spark, d):
    right = t("nation").select((-F.col("n_nationkey")).alias("k"), "n_nationkey")
    return ordered.paste_by(t("nation"), right, "n_nationkey", "k", F.col("n_name"), F.col("n_nationkey") * 2)


# --- counts and moments


@query("a1_count_by", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def _(t, spark, d):
    return histogram.count_by(t("events"), F.col("event_type"))


for _name, _norm, _cum in (("a2_hist", False, False), ("a2_hist_normalized", True, False), ("a2_hist_cumulative", False, True), ("a2_hist_both", True, True)):
    _freq = "n / sum(n) OVER ()" if _norm else "n::DOUBLE"
    _sum = "sum(f) OVER (ORDER BY place)" if _cum else "f"

    @query(_name, f"""
WITH h AS (SELECT l_linenumber AS value, count(*) AS n FROM lineitem GROUP BY 1),
f AS (SELECT value, {_freq} AS f, row_number() OVER (ORDER BY n DESC, value)::INTEGER AS place FROM h)
SELECT value, round({_sum}, 6) AS freq, place FROM f""")
    def _(t, spark, d, norm=_norm, cum=_cum):
        return histogram.hist_by(t("lineitem"), F.col("l_linenumber"), norm, cum).select("value", r6(F.col("freq")).alias("freq"), "place")


@query("a3_count_by_flat", "SELECT value, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS value FROM documents) GROUP BY 1")
def _(t, spark, d):
    return histogram.count_by_flat(t("documents"), F.split("text", " "))


@query("a4_hist_by_flat", """
WITH h AS (SELECT value, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS value FROM benchmark) GROUP BY 1)
SELECT value, round(n / sum(n) OVER (), 8) AS freq, row_number() OVER (ORDER BY n DESC, value)::INTEGER AS place FROM h""")
def _(t, spark, d):
    return histogram.hist_by_flat(t("benchmark"), F.split("text", " "), normalized=True).select("value", F.round("freq", 8).alias("freq"), "place")


@query("a5_sample_sink", """
SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS least, max(l_quantity) AS most,
       round(var_pop(l_quantity), 6) AS variance, round(stddev_pop(l_quantity), 6) AS stddev FROM lineitem GROUP BY 1""")
def _(t, spark, d):
    m = histogram.sample_sink(t("lineitem"), F.col("l_quantity"), "l_returnflag")
    return m.select("l_returnflag", "n", r6(F.col("mean")).alias("mean"), "least", "most", r6(F.col("variance")).alias("variance"), r6(F.col("stddev")).alias("stddev"))


@query("a8_promise", "SELECT n_nationkey, round((SELECT sum(c_acctbal) FROM customer), 2) AS total, 42 AS answer FROM nation")
def _(t, spark, d):
    total = histogram.promise(t("customer"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    return histogram.with_promise(histogram.with_promise(t("nation").select("n_nationkey"), total), histogram.constant_promise(spark, 42, "answer"))


@query("a11_cramers_v", """
WITH p AS (SELECT o_orderstatus AS x, o_orderpriority AS y, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
xs AS (SELECT x, sum(n) AS nx FROM p GROUP BY 1), ys AS (SELECT y, sum(n) AS ny FROM p GROUP BY 1), t AS (SELECT sum(n) AS n FROM p),
c AS (SELECT sum(power(coalesce(p.n, 0) - nx * ny / t.n, 2) / (nx * ny / t.n)) AS chi2 FROM xs CROSS JOIN ys CROSS JOIN t LEFT JOIN p ON p.x = xs.x AND p.y = ys.y)
SELECT round(sqrt(chi2 / t.n / (least((SELECT count(*) FROM xs), (SELECT count(*) FROM ys)) - 1)), 6) AS v FROM c, t""")
def _(t, spark, d):
    return stats.cramers_v(t("orders"), F.col("o_orderstatus"), F.col("o_orderpriority")).select(r6(F.col("v")).alias("v"))


@query("a12_cramers_p")
def _(t, spark, d):
    p = stats.permutation_p(t("customer"), "c_nationkey", "c_mktsegment", seed=1)
    return spark.createDataFrame([(p,)], "p double")


@query("a19_fit_pdf")
def _(t, spark, d):
    density_at, parameters = stats.fit_pdf_of(t("events"), F.abs("value"))
    return spark.createDataFrame([(parameters, float(density_at(1.0)))], "parameters int, density double")


# --- many outputs and samples


@query("m1_mux", "SELECT event_id % 4 AS bucket, 'max' AS output, max(value) AS value FROM events GROUP BY 1 UNION ALL SELECT event_id % 4, 'min', min(value) FROM events GROUP BY 1 UNION ALL SELECT event_id % 4, 'sum', round(sum(value), 3) FROM events GROUP BY 1")
def _(t, spark, d):
    rows = t("events").withColumn("bucket", F.col("event_id") % 4)
    outs = multiplex.mux(rows, "bucket", [F.max("value"), F.min("value"), F.round(F.sum("value"), 3)])
    a, b, c = [o.withColumn("output", F.lit(n)) for o, n in zip(outs, ("max", "min", "sum"), strict=True)]
    return a.union(b).union(c)


@query("m2_mux_with", "SELECT event_id % 4 AS bucket, max(user_id) - min(user_id) AS spread, count(*) + event_id % 4 AS n FROM events GROUP BY event_id % 4")
def _(t, spark, d):
    rows = t("events").select((F.col("event_id") % 4).alias("bucket"), "user_id")
    a, b = multiplex.mux_with(rows, "bucket", 2, lambda k, pdf: (pdf["user_id"].max() - pdf["user_id"].min(), len(pdf) + k), "long")
    return a.withColumnRenamed("value", "spread").join(b.withColumnRenamed("value", "n"), "bucket")


@query("m7_mux_with_types", "SELECT event_id % 4 AS bucket, max(user_id) AS most, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(*) / 2.0::DOUBLE AS half FROM events GROUP BY event_id % 4")
def _(t, spark, d):
    rows = t("events").select((F.col("event_id") % 4).alias("bucket"), "user_id", "event_type")
    outs = multiplex.mux_with(rows, "bucket", 3, lambda k, pdf: (pdf["user_id"].max(), ",".join(sorted(pdf["event_type"].dropna().unique())), len(pdf) / 2), ["long", "string", "double"])
    a, b, c = (o.withColumnRenamed("value", n) for o, n in zip(outs, ("most", "kinds", "half"), strict=True))
    return a.join(b, "bucket").join(c, "bucket")


@query("m17_flat_mux_with_types", "SELECT event_id % 4 AS bucket, 'id' AS output, count(*) AS n, sum(user_id)::VARCHAR AS last FROM events WHERE user_id % 2 = 0 GROUP BY 1 UNION ALL SELECT event_id % 4, 'type', count(*), max(event_type) FROM events GROUP BY 1")
def _(t, spark, d):
    rows = t("events").select((F.col("event_id") % 4).alias("bucket"), "user_id", "event_type")
    ids, kinds = multiplex.flat_mux_with(rows, "bucket", 2, lambda k, pdf: (pdf["user_id"][pdf["user_id"] % 2 == 0], pdf["event_type"]), ["long", "string"], by_rows=True)
    last = [(ids, "id", F.sum("value").cast("string")), (kinds, "type", F.max("value"))]
    a, b = (o.groupBy("bucket").agg(F.lit(n).alias("output"), F.count(F.lit(1)).alias("n"), c.alias("last")) for o, n, c in last)
    return a.unionByName(b)


@query("m11_flat_mux", "SELECT 'cheap' AS output, count(*) AS n, sum(p_partkey)::BIGINT AS total FROM part WHERE p_retailprice < 1000 UNION ALL SELECT 'small', count(*), sum(p_size)::BIGINT FROM part WHERE p_size < 10 UNION ALL SELECT 'all', count(*), sum(p_partkey + p_size)::BIGINT FROM part")
def _(t, spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    outs = multiplex.flat_mux(t("part"), [(F.col("p_retailprice") < 1000, key), (size < 10, size), (F.lit(True), key + size)])
    a, b, c = [o.agg(F.lit(n).alias("output"), F.count(F.lit(1)).alias("n"), F.sum("value").cast("long").alias("total")) for o, n in zip(outs, ("cheap", "small", "all"), strict=True)]
    return a.union(b).union(c)


@query("m12_flat_mux_with", "SELECT event_id % 4 AS bucket, user_id AS value, (user_id % 2)::INTEGER AS output FROM events WHERE user_id IS NOT NULL")
def _(t, spark, d):
    rows = t("events").select((F.col("event_id") % 4).alias("bucket"), "user_id")
    outs = multiplex.flat_mux_with(rows, "bucket", 2, lambda k, pdf: (pdf["user_id"][pdf["user_id"] % 2 == 0], pdf["user_id"][pdf["user_id"] % 2 == 1]), "long", by_rows=True)
    even, odd = (o.withColumn("output", F.lit(i)) for i, o in enumerate(outs))
    return even.unionByName(odd)


@query("x1_split_sample", "SELECT event_id, least(3, floor(('0x' || substr(md5(event_id || '-0'), 1, 8))::BIGINT / 4294967296.0 * 4))::INTEGER AS part FROM events")
def _(t, spark, d):
    parts = [p.select("event_id").withColumn("part", F.lit(j)) for j, p in enumerate(multiplex.split_sample(t("events"), 4, F.col("event_id")))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("x2_weighted_split", "SELECT event_id, CASE WHEN u < 0.5 THEN 0 WHEN u < 0.75 THEN 1 ELSE 2 END AS part FROM (SELECT event_id, ('0x' || substr(md5(event_id || '-7'), 1, 8))::BIGINT / 4294967296.0 AS u FROM events)")
def _(t, spark, d):
    parts = [p.select("event_id").withColumn("part", F.lit(j)) for j, p in enumerate(multiplex.weighted_split_sample(t("events"), [2, 1, 1], F.col("event_id"), 7))]
    return parts[0].union(parts[1]).union(parts[2])


@query("x4_iid_features")
def _(t, spark, d):
    rows = t("lineitem").select(F.array(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")).alias("features"))
    return sampling.iid_features(rows, 1000, seed=3).select("row", *[F.col("features")[i].alias(c) for i, c in enumerate(("quantity", "discount", "tax"))])


@query("x7_sample_by_size")
def _(t, spark, d):
    return sampling.sample_by_size(t("lineitem").select("l_orderkey", "l_linenumber"), 1000, 1)


@query("x8_sample_distinct", "SELECT 5::BIGINT AS n, 5::BIGINT AS distinct_n")
def _(t, spark, d):
    five = sampling.sample_distinct(t("customer").select("c_nationkey"), 5, 1)
    return five.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_nationkey").alias("distinct_n"))


# --- features


@query("e11_quadratic", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 6) AS qd, round(l_quantity * l_tax, 6) AS qt, round(l_discount * l_tax, 6) AS dt FROM lineitem")
def _(t, spark, d):
    spec = FeatureSpec.of(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")).with_names("q", "d", "t").quadratic()
    at = spec.names.inverse
    return t("lineitem").select("l_orderkey", "l_linenumber", *[r6(spec.columns[at[n]]).alias(a) for n, a in (("q*d", "qd"), ("q*t", "qt"), ("d*t", "dt"))])


@query("e13_extractor_algebra", "SELECT p_partkey, p_size::DOUBLE AS a, p_size * 2.0::DOUBLE AS b, 1.0::DOUBLE AS c, p_size + p_size * 2.0::DOUBLE AS d FROM part")
def _(t, spark, d):
    base = FeatureSpec.of(F.col("p_size"), F.col("p_size") * 2) + FeatureSpec.constant(1.0)
    spec = base.fold(lambda a: FeatureSpec.of(F.element_at(a, 1) + F.element_at(a, 2)))
    return t("part").select("p_partkey", *[c.alias(n) for c, n in zip(spec.columns, "abcd", strict=True)])


@query("e12_compose", "SELECT p_partkey, p_size + 1::DOUBLE AS a, p_size::DOUBLE * p_partkey AS b FROM part")
def _(t, spark, d):
    spec = FeatureSpec.of(F.col("x") + 1, F.col("x") * F.col("y"))
    found = spec.compose(t("part").select("p_partkey", "p_size"), x=F.col("p_size").cast("double"), y=F.col("p_partkey"))
    return found.select("p_partkey", *[F.col("features")[i].alias(c) for i, c in enumerate("ab")])


@query("e8_numeric_string", "SELECT vec_id, embedding[4]::DOUBLE AS a, embedding[1]::DOUBLE AS b, embedding[4]::DOUBLE AS c, label * 1.5::DOUBLE AS s, len(list_filter(embedding, lambda x: x <> 0)) / len(embedding)::DOUBLE AS density, len(list_filter(embedding, lambda x: x <> 0))::INTEGER AS active FROM embeddings")
def _(t, spark, d):
    e = t("embeddings")
    spec = FeatureSpec.numeric(F.col("embedding"), 3, 0, 3) + FeatureSpec.string(F.array((F.col("label") * 1.5).cast("string")), 0)
    return e.select("vec_id", *[c.alias(n) for c, n in zip(spec.columns, "abcs", strict=True)], density(F.col("embedding")).alias("density"), F.size(active_keys(F.col("embedding"))).alias("active"))


@query("e23_one_hot", """
SELECT o_orderkey, (o_orderpriority = p1)::INTEGER::DOUBLE AS a, (o_orderpriority = p2)::INTEGER::DOUBLE AS b, (o_orderpriority NOT IN (p1, p2))::INTEGER::DOUBLE AS other
FROM orders, (SELECT max(p) FILTER (k = 1) AS p1, max(p) FILTER (k = 2) AS p2 FROM (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS k FROM orders GROUP BY 1))""")
def _(t, spark, d):
    spec = OneHotModel.train(t("orders"), F.col("o_orderpriority"), max_size=2).one_hot(F.col("o_orderpriority"), undefined="other")
    return t("orders").select("o_orderkey", *[c.alias(n) for c, n in zip(spec.columns, ("a", "b", "other"), strict=True)])


_TOP = "WITH v AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS k FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) GROUP BY 1 HAVING count(*) >= 3 ORDER BY k LIMIT 3), d AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)"


@query("e24_multi_hot", _TOP + " SELECT doc_id, max(list_contains(ws, w)::INTEGER::DOUBLE) FILTER (k = 1) AS a, max(list_contains(ws, w)::INTEGER::DOUBLE) FILTER (k = 2) AS b, max(list_contains(ws, w)::INTEGER::DOUBLE) FILTER (k = 3) AS c FROM d, v GROUP BY doc_id")
def _(t, spark, d):
    model = OneHotModel.train_flat(t("benchmark"), F.split("text", " "), min_freq=3, max_size=3)
    spec = model.multi_hot(F.split("text", " "))
    return t("documents").select("doc_id", *[c.alias(n) for c, n in zip(spec.columns, "abc", strict=True)])


@query("e25_hist_extractor", _TOP + " SELECT doc_id, max(len(list_filter(ws, lambda x: x = w))::DOUBLE) FILTER (k = 1) AS a, max(len(list_filter(ws, lambda x: x = w))::DOUBLE) FILTER (k = 2) AS b, max(len(list_filter(ws, lambda x: x = w))::DOUBLE) FILTER (k = 3) AS c FROM d, v GROUP BY doc_id")
def _(t, spark, d):
    model = OneHotModel.train_flat(t("benchmark"), F.split("text", " "), min_freq=3, max_size=3)
    spec = model.hist(F.split("text", " "))
    return t("documents").select("doc_id", *[c.alias(n) for c, n in zip(spec.columns, "abc", strict=True)])


# --- text, time, arrays, JSON

_TOKENS = r"""list_filter(list_transform(string_split(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '), lambda t: regexp_replace(regexp_replace(regexp_replace(t, '[^A-Za-z0-9_./:@-]', '', 'g'), '[^ \t\n\x0B\f\rA-Za-z0-9_/-]+$', ''), '^[^ \t\n\x0B\f\rA-Za-z0-9_/-]+', '')), lambda t: regexp_matches(t, '[A-Za-z_-]'))"""


@query("f1_log_tokens", f"SELECT doc_id, len(k) AS n, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS} AS k FROM documents)")
def _(t, spark, d):
    found = t("documents").select("doc_id", text.tokens(F.col("text")).alias("k"))
    return found.select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", " ")).alias("digest"))


_BITS = "list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(md5(w), i, 8))::BIGINT % 32768)"


@query("f3_whitelist", f"""
WITH b AS (SELECT DISTINCT unnest({_BITS.replace('w)', 'w)')}) AS p FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM benchmark)),
a AS (SELECT list(p) AS bits FROM b),
w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents)
SELECT list_has_all(bits, {_BITS}) AS accepted, count(*) AS n FROM w, a GROUP BY 1""")
def _(t, spark, d):
    halves = [text.train_whitelist(t("benchmark").where(F.col("item_id") % 2 == i).select(F.explode(F.split("text", " ")).alias("w")), "w") for i in (0, 1)]
    bitmap = text.combine_whitelists(halves[0].union(halves[1]))
    words = t("documents").select(F.explode(F.split("text", " ")).alias("w")).distinct()
    return histogram.with_promise(words, bitmap).groupBy(text.maybe_contains(F.col("bitmap"), F.col("w")).alias("accepted")).agg(F.count(F.lit(1)).alias("n"))


@query("f6_time_parts", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, dayofyear(o_orderdate)::INTEGER AS day_of_year, epoch(o_orderdate)::BIGINT AS seconds, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS shown, dayofyear(o_orderdate)::INTEGER AS again FROM orders")
def _(t, spark, d):
    ts, seconds = F.col("o_orderdate"), timeutil.seconds_since_epoch(F.col("o_orderdate"))
    p = timeutil.parts(timeutil.parse(timeutil.render(ts)))
    return t("orders").select("o_orderkey", p["year"].alias("year"), p["month"].alias("month"), p["day_of_year"].alias("day_of_year"), seconds.alias("seconds"), timeutil.render(timeutil.from_seconds(seconds)).alias("shown"), timeutil.year_and_day(seconds)["day"].alias("again"))


@query("f8_days_between", "SELECT l_orderkey, l_linenumber, date_sub('day', o_orderdate, l_shipdate) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t, spark, d):
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", timeutil.days_between(F.col("o_orderdate"), F.col("l_shipdate")).alias("days"))


@query("f9_from_zone", "SELECT o_orderkey, strftime(o_orderdate::TIMESTAMP - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS shown FROM orders")
def _(t, spark, d):
    return t("orders").select("o_orderkey", timeutil.render(timeutil.from_zone(F.col("o_orderdate"), "+05:30")).alias("shown"))


@query("f10_amortize", """
SELECT o_orderkey, strftime(o_orderdate + INTERVAL (i) DAY, '%Y-%m-%d') AS day, round(o_totalprice / greatest(o_orderkey % 5, 1), 6) AS part
FROM (SELECT *, unnest(range(greatest(o_orderkey % 5, 1))) AS i FROM orders)""")
def _(t, spark, d):
    rows = t("orders").withColumn("until", F.timestamp_add("DAY", (F.col("o_orderkey") % 5).cast("int"), F.col("o_orderdate")))
    return timeutil.amortize(rows, "o_orderdate", "until", "o_totalprice").select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"), r6(F.col("part")).alias("part"))


@query("f14_json_transform", """SELECT event_id, '{"k":' || (json_extract(props, '$.k')::BIGINT + 1) || '}' AS props FROM events""")
def _(t, spark, d):
    return t("events").select("event_id", jsonx.transform(F.col("props"), lambda v: v + 1 if isinstance(v, int) else v).alias("props"))


@query("f15_json_transform_field", """SELECT event_id, '{"key":"' || json_extract(props, '$.k')::BIGINT || '"}' AS props FROM events""")
def _(t, spark, d):
    return t("events").select("event_id", jsonx.transform_field(F.col("props"), lambda k, v: ("key" if k == "k" else k, str(v))).alias("props"))


@query("f17_rich_slice", """SELECT vec_id, array_to_string(list_transform(list_concat(list_concat([embedding[3], embedding[64]], embedding[5:7]), list_reverse(embedding[61:64])), lambda x: floor(x * 1000)::BIGINT::VARCHAR), ',') AS s FROM embeddings""")
def _(t, spark, d):
    s = arrays.rich_slice(F.col("embedding"), 2, -1, arrays.span(4, 7), arrays.span(None, -4, -1, True))
    return t("embeddings").select("vec_id", F.array_join(F.transform(s, lambda x: F.floor(x.cast("float") * F.lit(1000).cast("float")).cast("string")), ",").alias("s"))


@query("f18_regex_groups", r"SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)#(\d+)$', 1) AS a, regexp_extract(c_name, '^([A-Za-z]+)#(\d+)$', 2) AS b FROM customer WHERE regexp_matches(c_name, '^([A-Za-z]+)#(\d+)$')")
def _(t, spark, d):
    found = t("customer").select("c_custkey", arrays.regex_groups(F.col("c_name"), r"([A-Za-z]+)#(\d+)", 2).alias("g")).where("g is not null")
    return found.select("c_custkey", F.col("g")[0].alias("a"), F.col("g")[1].alias("b"))


@query("c11_leaf_hamming", "SELECT a.vec_id, len(list_filter(range(1, 65), lambda i: (a.embedding[i] > 0) <> (b.embedding[i] > 0)))::DOUBLE AS distance FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def _(t, spark, d):
    signs = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x > 0).alias("s"))
    one = signs.where("vec_id = 0").select(F.col("s").alias("o"))
    return histogram.with_promise(signs, one).select("vec_id", arrays.hamming(F.col("s"), F.col("o")).alias("distance"))


# --- clustering and maps

_MED = """m AS (SELECT vec_id AS j, embedding AS f FROM embeddings WHERE vec_id < 5),
p AS (SELECT vec_id, embedding AS f FROM embeddings),
dd AS (SELECT p.vec_id, j, list_sum(list_transform(range(1, 65), lambda i: abs(p.f[i]::DOUBLE - m.f[i]::DOUBLE))) AS dist FROM p, m),
n AS (SELECT vec_id, arg_min(j, (dist, j)) AS cluster, min(dist) AS distance FROM dd GROUP BY 1)"""


def _medoids(t):
    first = t("embeddings").where("vec_id < 5").orderBy("vec_id").collect()
    rows = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    return rows, [list(map(float, r["embedding"])) for r in first]


@query("j9_nearest_medoid", f"WITH {_MED} SELECT vec_id, cluster::INTEGER AS cluster, round(distance, 6) AS distance FROM n")
def _(t, spark, d):
    rows, medoids = _medoids(t)
    return cluster.nearest(rows, "features", medoids, "manhattan").select("vec_id", "cluster", r6(F.col("distance")).alias("distance"))


@query("a16_medoid_cost", f"WITH {_MED} SELECT round(sum(distance), 4) AS total, round(avg(distance), 6) AS mean FROM n")
def _(t, spark, d):
    rows, medoids = _medoids(t)
    return cluster.cost(rows, "features", medoids, "manhattan").select(F.round("total", 4).alias("total"), r6(F.col("mean")).alias("mean"))


@query("a15_medoid_step", f"""
WITH {_MED}, c AS (SELECT vec_id, cluster, f FROM n JOIN p USING (vec_id)),
s AS (SELECT a.cluster, a.vec_id, sum(list_sum(list_transform(range(1, 65), lambda i: abs(a.f[i]::DOUBLE - b.f[i]::DOUBLE)))) AS total FROM c a JOIN c b ON a.cluster = b.cluster GROUP BY 1, 2)
SELECT cluster::INTEGER AS cluster, arg_min(vec_id, (round(total, 6), vec_id)) AS vec_id, round(min(total), 5) AS total FROM s GROUP BY cluster""")
def _(t, spark, d):
    rows, medoids = _medoids(t)
    assigned = cluster.nearest(rows, "features", medoids, "manhattan")
    return cluster.medoid_step(assigned, "vec_id", "features", "manhattan").select("cluster", "vec_id", F.round("total", 5).alias("total"))


@query("c2_kmedoids_fit")
def _(t, spark, d):
    rows, _ = _medoids(t)
    model = cluster.KMedoids(metric="manhattan", k=4, seed=5, sample_size=1000).fit(rows)
    return model.transform(rows).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("distance")).alias("mean"))


@query("c4_kmedoids_auto")
def _(t, spark, d):
    rows = t("events").where("value is not null").select(F.array(F.col("value").cast("double")).alias("features"))
    model = cluster.KMedoids(metric="manhattan", k=0, max_iterations=6, seed=5, sample_size=200).fit(rows)
    return model.transform(rows).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def _forest(t):
    spec = FeatureSpec.of(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")).with_names("quantity", "price", "discount")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    forest = cluster.RandomForestCluster(spec, trees=4, depth=4, clusters=cluster.KMedoids(metric="hamming", k=3, seed=1, sample_size=200), seed=1)
    return spec, rows, forest.fit(rows)


@query("c10_rf_cluster")
def _(t, spark, d):
    _, rows, model = _forest(t)
    return model.transform(rows).select("l_orderkey", "l_linenumber", "cluster", "distance")


@query("c15_rf_rules")
def _(t, spark, d):
    import uuid

    spec, _, model = _forest(t)
    base = shared_folder(spark)
    nodes = cluster.node_table(model.forest, f"{base}/forest-{uuid.uuid4().hex}", spark)
    found = [(a, b, c, e, " and ".join(f)) for a, b, c, e, f in cluster.rules(nodes, spec.names.values)]
    return spark.createDataFrame(found, "tree int, leaf int, prediction double, depth int, rule string")


_CODE = """c AS (SELECT vec_id::INTEGER AS cell, embedding AS f FROM embeddings WHERE vec_id < 9),
s AS (SELECT e.vec_id, cell, list_cosine_similarity(e.embedding::DOUBLE[], c.f::DOUBLE[]) AS sim FROM embeddings e, c),
b AS (SELECT vec_id, arg_min(cell, (round(-sim, 9), cell)) AS prediction, max(sim) AS similarity FROM s GROUP BY 1)"""


def _map(t):
    import numpy as np

    code = t("embeddings").where("vec_id < 9").orderBy("vec_id").collect()
    return som.SOM(3, 3, np.array([r["embedding"] for r in code], dtype=float))


@query("c18_som_closest", f"WITH {_CODE} SELECT vec_id, prediction, round(similarity, 6) AS similarity FROM b")
def _(t, spark, d):
    return _map(t).transform(t("embeddings"), "embedding").select("vec_id", "prediction", r6(F.col("similarity")).alias("similarity"))


@query("a18_som_sums", f"WITH {_CODE} SELECT prediction, count(*) AS n, round(sum(embedding[1]::DOUBLE), 5) AS first, round(avg(similarity), 6) AS mean FROM b JOIN embeddings USING (vec_id) GROUP BY 1")
def _(t, spark, d):
    scored = _map(t).transform(t("embeddings"), "embedding")
    return scored.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("embedding")[0].cast("double")), 5).alias("first"), r6(F.avg("similarity")).alias("mean"))


@query("c16_neighborhood", "SELECT i::INTEGER AS i, round(exp(-power(i - 3, 2) / power(1.5, 2)), 9) AS h FROM range(8) r(i)")
def _(t, spark, d):
    return spark.range(8).select(F.col("id").cast("int").alias("i"), F.round(arrays.gaussian((F.col("id") - 3).cast("double"), 1.5), 9).alias("h"))


@query("c23_som_fit")
def _(t, spark, d):
    from pyspark.ml.functions import array_to_vector

    rows = t("embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return som.SOMEstimator(x=4, y=4, epochs=3, seed=1).fit(rows).transform(rows).select("vec_id", "prediction", r6(F.col("similarity")).alias("similarity"))


@query("k11_lineage")
def _(t, spark, d):
    joined = frames.natural_join(t("documents"), t("labels"))
    return spark.createDataFrame(lineage(joined), "depth int, operator string, successor string")


@query("streaming_counts", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def _(t, spark, d):
    import uuid

    from .streaming.windows import windowed_counts

    base = shared_folder(spark)
    folder = f"{base}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(t("events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    name = f"shoal_{uuid.uuid4().hex}"
    stream = windowed_counts(source, "ts", F.col("event_type"), "1 day", "1 hour").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", folder).trigger(availableNow=True).start()
    stream.awaitTermination()
    return stash(spark.table(name).groupBy("value").agg(F.sum("n").alias("n")))


# --- more of samples, vectors and promises, and what must hold of fitted models


@query("a8_promise_of_rows", "SELECT n_nationkey, (SELECT max(length(p_name)) + count(*) FROM part) AS answer FROM nation")
def _(t, spark, d):
    import pandas as pd

    def f(batches):
        longest = rows = 0
        for pdf in batches:
            longest, rows = max(longest, int(pdf["p_name"].str.len().max())), rows + len(pdf)
        return pd.DataFrame({"answer": [longest + rows]})

    return histogram.with_promise(t("nation").select("n_nationkey"), histogram.promise_of_rows(t("part").select("p_name"), f, "answer long"))


def _sparse():
    return F.array((F.col("l_linenumber") - 1).cast("double"), F.col("l_discount").cast("double"), F.lit(0.0), F.col("l_tax").cast("double"))


_SPARSE_SQL = "SELECT l_orderkey, l_linenumber, [l_linenumber - 1::DOUBLE, l_discount::DOUBLE, 0::DOUBLE, l_tax::DOUBLE] AS a FROM lineitem"


@query("e26_compressed", f"""
WITH v AS ({_SPARSE_SQL}), n AS (SELECT *, len(list_filter(a, lambda x: x <> 0)) AS active FROM v)
SELECT l_orderkey, l_linenumber, active > 2 AS dense, active >= 2 AS dense_at_half, (CASE WHEN active > 2 THEN 4 ELSE active END)::INTEGER AS held FROM n""")
def _(t, spark, d):
    one, two = compressed(_sparse()), compressed(_sparse(), sparse_at_half=False)
    return t("lineitem").select("l_orderkey", "l_linenumber", one["dense"].alias("dense"), two["dense"].alias("dense_at_half"), F.size(one["values"]).alias("held"))


@query("e27_ml_vector", f"WITH v AS ({_SPARSE_SQL}) SELECT l_orderkey, l_linenumber, round(a[1], 6) AS a, round(a[2], 6) AS b, round(a[3], 6) AS c, round(a[4], 6) AS d FROM v")
def _(t, spark, d):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", vector_to_array(ml_vector(_sparse())).alias("v"))
    return rows.select("l_orderkey", "l_linenumber", *[r6(F.col("v")[i]).alias(c) for i, c in enumerate("abcd")])


@query("e30_vector_with_id", "SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def _(t, spark, d):
    return t("embeddings").select(vector_with_id(F.col("vec_id"), F.col("embedding")).alias("v")).select("v.id", r6(F.col("v.vector")[0].cast("double")).alias("first"))


@query("x5_marginals", """
WITH x AS (SELECT unnest([0, 1, 2]) AS place, unnest([l_linenumber - 1, l_quantity::BIGINT, round(l_discount * 100)::BIGINT])::BIGINT AS x FROM lineitem),
c AS (SELECT place, x, count(*) AS n FROM x GROUP BY ALL)
SELECT place::INTEGER AS place, coalesce(sum(n) FILTER (x = 0), 0)::BIGINT AS zeros, coalesce(sum(n) FILTER (x = 1), 0)::BIGINT AS ones, (count(*) FILTER (x NOT IN (0, 1)))::INTEGER AS others, sum(x * n)::BIGINT AS total FROM c GROUP BY place""")
def _(t, spark, d):
    places = F.array((F.col("l_linenumber") - 1).cast("long"), F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long"))
    found = sampling.marginals(t("lineitem").select(places.alias("features")))
    total = F.col("ones") + F.aggregate("others", F.lit(0).cast("long"), lambda s, o: s + o["x"] * o["n"])
    return found.select("place", "zeros", "ones", F.size("others").alias("others"), total.alias("total"))


@query("k15_ks_two_sample", """
WITH c AS (SELECT l_extendedprice AS x, (count(*) FILTER (l_returnflag = 'A')) AS na, (count(*) FILTER (l_returnflag = 'R')) AS nb FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1),
u AS (SELECT sum(na) OVER (ORDER BY x) / (SELECT sum(na) FROM c) AS a, sum(nb) OVER (ORDER BY x) / (SELECT sum(nb) FROM c) AS b FROM c) SELECT round(max(abs(a - b)), 6) AS d FROM u""")
def _(t, spark, d):
    price = lambda flag: t("lineitem").where(F.col("l_returnflag") == flag).select("l_extendedprice")
    return stats.ks_two_sample(price("A"), price("R"), "l_extendedprice").select(r6(F.col("d")).alias("d"))


@query("c2_kmedoids_holds", "SELECT count(*) AS n, true AS in_range, true AS are_rows FROM embeddings")
def _(t, spark, d):
    rows, _ = _medoids(t)
    model = cluster.KMedoids(metric="manhattan", k=4, seed=5).fit(rows)
    own = F.size(F.collect_set(F.when(F.col("distance") < 1e-9, F.col("cluster")))) == model.k  # every medoid is a row
    return model.transform(rows).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("cluster").between(0, 3)).alias("in_range"), own.alias("are_rows"))


@query("c10_rf_holds", "SELECT count(*) AS n, true AS in_range, true AS not_negative FROM lineitem")
def _(t, spark, d):
    _, rows, model = _forest(t)
    return model.transform(rows).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("cluster").between(0, 2)).alias("in_range"), F.min(F.col("distance") >= 0).alias("not_negative"))


def _nodes(model, spark):
    import uuid

    return cluster.node_table(model.forest, f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}", spark)


@query("c13_heap_leaves_hold", "SELECT tree::INTEGER AS tree, true AS one_to_one, (SELECT count(*) FROM lineitem) AS n FROM range(4) r(tree)")
def _(t, spark, d):
    spec, rows, model = _forest(t)
    both = model.leaves(rows).select(F.posexplode(F.arrays_zip(F.transform("leaf_ids", lambda x: x.cast("int")).alias("ordinal"), cluster.heap_leaves(_nodes(model, spark), spec.array()).alias("heap"))).alias("tree", "z"))
    met = both.groupBy("tree", "z.ordinal", "z.heap").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.count(F.lit(1))
    return met.groupBy("tree").agg(((pairs == F.countDistinct("ordinal")) & (pairs == F.countDistinct("heap"))).alias("one_to_one"), F.sum("n").alias("n"))


@query("a14_feature_hist_holds", "SELECT true AS known, true AS descending, 1.0::DOUBLE AS total")
def _(t, spark, d):
    spec, _, model = _forest(t)
    nodes = _nodes(model, spark)
    hist = cluster.feature_hist(nodes, spec.names.values).select("place", F.struct("value", "freq").alias("one"))
    last = cluster.feature_hist(nodes, spec.names.values, normalized=True, cumulative=True).agg(F.round(F.max("freq"), 6).alias("total"))  # one row
    ordered_by = F.expr("transform(array_sort(collect_list(struct(place, one))), x -> x.one)")  # as many rows as features
    every = hist.agg(ordered_by.alias("a")).select(F.forall("a", lambda x: x["value"].isin("quantity", "price", "discount")).alias("known"), F.expr("a.freq = reverse(array_sort(a.freq))").alias("descending"))
    return every.crossJoin(F.broadcast(last))


@query("c23_som_holds", "SELECT count(*) AS n, true AS in_range, true AS bounded FROM embeddings")
def _(t, spark, d):
    from pyspark.ml.functions import array_to_vector

    rows = t("embeddings").select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    found = som.SOMEstimator(x=4, y=4, epochs=3, seed=1).fit(rows).transform(rows)
    return found.agg(F.count(F.lit(1)).alias("n"), F.min(F.col("prediction").between(0, 15)).alias("in_range"), F.min(F.abs("similarity") <= 1.000001).alias("bounded"))


@query("a12_cramers_p_holds", "SELECT true AS likely")
def _(t, spark, d):
    p = stats.permutation_p(t("customer"), "c_nationkey", "c_mktsegment", seed=1)  # the columns are drawn independently
    return spark.createDataFrame([(bool(0.001 < p <= 1),)], "likely boolean")


@query("x4_iid_holds", "SELECT 1000::BIGINT AS n, true AS within FROM (SELECT 1)")
def _(t, spark, d):
    rows = t("lineitem").select(F.array(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")).alias("features"))
    made = sampling.iid_features(rows, 1000, seed=3)
    known = t("lineitem").agg(F.collect_set("l_quantity").alias("known"))  # fifty quantities
    return made.crossJoin(F.broadcast(known)).agg(F.count(F.lit(1)).alias("n"), F.min(F.exists("known", lambda q: q == F.col("features")[0])).alias("within"))
