import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import algebra, causal, features, impute, models, neural, outliers, plots, profile, relate, select, temporal
from quillon.operators.moments import gram, merge
from quillon.operators.quantiles import exact_quantiles, nth_values


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=300), rng.normal(size=300)
    y = 2 + 3 * a - b + rng.normal(scale=0.1, size=300)
    rows = [(i, float(a[i]), float(b[i]), float(y[i]), float(a[i] + b[i])) for i in range(300)]
    return spark.createDataFrame(rows, "i long, a double, b double, y double, s double").cache()


def test_moments_by_hand(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (7.0,), (None,), (float("nan"),)], "v double")
    r = profile.numeric_summary(d, ["v"]).first()
    x = np.array([1, 2, 2, 7.0])
    s = x.std(ddof=1)
    assert (r["n"], r["missing"], r["mean"], r["median"], r["mode_value"], r["mad"]) == (4, 2, 3.0, 2.0, 2.0, 0.5)
    assert r["skewness"] == pytest.approx(4 / 6 * (((x - 3) / s) ** 3).sum())
    assert r["geometric_mean"] == pytest.approx(28 ** 0.25) and r["harmonic_mean"] == pytest.approx(4 / (1 + 0.5 + 0.5 + 1 / 7))


def test_empty_and_constant(spark):
    empty = spark.createDataFrame([], "v double, c string")
    r = profile.moments(empty, ["v"]).first()
    assert r["n"] == 0 and r["mean"] is None
    assert profile.histogram(empty, "v").count() == 0 and profile.ecdf(empty, "v").count() == 0
    same = spark.createDataFrame([(5.0,)] * 9, "v double")
    r = profile.moments(same, ["v"]).first()
    assert r["variance"] == 0 and r["skewness"] == 0 and r["kurtosis"] == 0
    assert profile.histogram(same, "v").agg(F.sum("n")).first()[0] == 9


def test_quantiles_by_narrowing(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=500), np.full(300, 3.0), [1e300, -1e300, 0.0, -0.0]])
    d = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = exact_quantiles(d, ["v"], [0.0, 0.1, 0.5, 0.9, 1.0], single_pass=10)["v"]
    for p, x in got.items():
        assert x == pytest.approx(np.quantile(v, p))
    assert nth_values(d, ["v"], {"v": [0, 700]})["v"][700] == np.sort(v)[700]


def test_outlier_rules(spark):
    rng = np.random.default_rng(3)
    v = [*rng.normal(size=60).tolist(), 50.0, -40.0]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "k long, v double")
    for method in ("iqr", "zscore", "modified_z", "adjusted_boxplot"):
        flagged = {r["k"] for r in outliers.flag(d, ["v"], method).where("v_outlier").collect()}
        assert {60, 61} <= flagged and len(flagged) < 15
    assert outliers.remove(d, ["v"]).count() == 62 - outliers.counts(d, ["v"]).first()["outliers"]
    capped = outliers.cap(d, ["v"]).agg(F.max("v"), F.min("v")).first()
    assert capped[0] < 10 and capped[1] > -10
    lof = {r["k"]: r["lof"] for r in outliers.lof(d, "v", "k", k=10).collect()}
    assert lof[60] > 1.5 and lof[61] > 1.5 and np.median(list(lof.values())) < 1.3
    constant = spark.createDataFrame([(i, 1.0) for i in range(30)], "k long, v double")
    assert outliers.lof(constant, "v", "k").where("outlier").count() == 0
    assert outliers.counts(constant, ["v"], "zscore").first()["outliers"] == 0


def test_interpolation_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(impute, "BLOCK_ROWS", 4)
    v = [None, None, 1.0, None, None, None, None, None, None, 8.0, None, 10.0, None]
    d = spark.createDataFrame([(i, x, None) for i, x in enumerate(v)], "i long, v double, w double")
    got = {r["i"]: (r["v"], r["w"]) for r in impute.interpolate(d, ["v", "w"], "i").collect()}
    assert [round(got[i][0], 9) for i in range(13)] == [1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10]
    assert {w for _, w in got.values()} == {None}


def test_imputation(spark):
    d = spark.createDataFrame([(i, float(i) if i % 5 else None, 2.0 * i + 1, "a" if i % 3 else None) for i in range(60)], "i long, y double, x double, c string")
    assert impute.run(d, {"y": "mice", "c": "auto"}, "i").where("y is null or c is null").count() == 0
    filled = {r["i"]: r["y"] for r in impute.mice(d, ["y", "x"]).collect()}
    assert filled[20] == pytest.approx(20.0, abs=1e-6)
    near = {r["i"]: r["y"] for r in impute.knn(d.select("i", "y", "x"), "y", ["x"], "i", k=2).collect()}
    assert near[20] == pytest.approx(20.0)
    with pytest.raises(Exception, match="does not apply"):
        impute.check_strategy("categorical", "mean")


def test_features(spark):
    d = spark.createDataFrame([(1.0, "a,b", "Yes"), (2.0, "b", "no"), (3.0, "a,b,c", "YES"), (4.0, "c,a", "no")], "v double, picks string, flag string")
    wide, sep = features.multi_select(d, "picks")
    assert sep == "," and {"picks_selection_count", "picks_has_a"} <= set(wide.columns)
    assert [r["flag_bool"] for r in features.boolean_flags(d, ["flag"]).orderBy("v").collect()] == [1, 0, 1, 0]
    scaled, used = features.scaled(d, ["v"], "zscore")
    assert scaled.agg(F.avg("v")).first()[0] == pytest.approx(0) and used["v"][0] == "zscore"
    kept, gone = features.cull_columns(d.withColumn("k", F.lit(1.0)))
    assert "k" in gone and "v" in kept
    coded = features.encoded_target(d, "picks").where("picks_code is null").count()
    assert coded == 0


def test_engineering_keeps_useful(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), float(a * b)) for a, b in rng.uniform(1, 5, size=(200, 2))]
    _, kept = features.engineered(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y")
    assert "a_x_b" in kept


def test_gram_equals_rowwise(linear):
    g = gram(linear, ["a", "b", "y"])
    x = linear.toPandas()
    fit = algebra.ols(g, ["a", "b"], "y")
    z = np.column_stack([np.ones(300), x["a"], x["b"]])
    beta = np.linalg.lstsq(z, x["y"], rcond=None)[0]
    assert fit.beta == pytest.approx(beta, abs=1e-9)
    assert g.correlation()[0, 2] == pytest.approx(np.corrcoef(x["a"], x["y"])[0, 1])
    assert algebra.ols(gram(linear, ["a", "b", "s", "y"]), ["a", "b", "s"], "y") is None
    assert algebra.vif(gram(linear, ["a", "b", "s"]), ["a", "b", "s"])["s"] > 1e6
    per = gram(linear.withColumn("f", (F.col("i") % 3).cast("int")), ["a", "y"], fold="f")
    both = merge(list(per.values()))
    assert both.cross == pytest.approx(g.pick(["a", "y"]).cross) and (both - per[0]).n == 200


def test_wide_gram_by_partition(linear, monkeypatch):
    from quillon.operators import moments

    plain = gram(linear, ["a", "b", "y"])
    monkeypatch.setattr(moments, "ONE_PASS_COLUMNS", 0)
    assert gram(linear, ["a", "b", "y"]).cross == pytest.approx(plain.cross)
    monkeypatch.setattr(moments, "AGGREGATE_COLUMNS", 1)
    assert gram(linear, ["a", "b", "y"]).cross == pytest.approx(plain.cross)


def test_selection_kernels(linear):
    g = gram(linear, ["a", "b", "s", "y"])
    beta = algebra.lasso(g, ["a", "b"], "y")
    assert beta["a"] > 0.5 and beta["b"] < 0
    assert algebra.stepwise(g, ["a", "b"], "y")[0][0] == "a"
    assert algebra.identity_block(gram(linear.withColumn("c", F.col("a") * 2), ["a", "c"]), ["a", "c"]) == ["c"]
    assert abs(algebra.partial_r(g, "y", "b", ["a"])) > 0.9
    assert algebra.hidden_driver(g, ["a", "b"], "y")[1] == "b"
    assert algebra.drift(0.5, -0.4) == "sign reversal" and algebra.drift(0.5, 0.1) == "magnitude collapse"


def test_structural_reads_all_rows(spark):
    d = spark.range(2000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b")).withColumn("c", F.col("a") + F.col("b") + F.when(F.col("a") >= 600, 50.0).otherwise(0.0))
    assert relate.structural(d.coalesce(1), ["a", "b", "c"]).count() == 0
    rate = relate.structural(d.coalesce(1), ["a", "b", "c"], hit=0.2).where("kind = 'sum' and c = 'c'").first()["hit_rate"]
    assert rate == 0.3


def test_structure_and_pairs(linear):
    found = {(r["kind"], r["a"], r["b"], r["c"]) for r in relate.structural(linear, ["a", "b", "s"]).collect()}
    assert ("sum", "a", "b", "s") in found
    top = relate.analyse_pairs(linear, ["a", "b", "y"], "i").first()
    assert {top["a"], top["b"]} == {"a", "y"} and top["selected"] and top["p_value"] < 1e-6
    assert relate.kendall(linear.where("i < 100"), "a", "y", "i") > 0.6


def test_categories(spark):
    cells = [("x", "u")] * 30 + [("x", "v")] * 10 + [("y", "u")] * 5 + [("y", "v")] * 35
    r = relate.contingency(spark.createDataFrame(cells, "a string, b string"), "a", "b").first()
    assert r["chi2"] == pytest.approx(31.74603, abs=1e-4) and r["odds_ratio"] == pytest.approx(30.5 * 35.5 / (10.5 * 5.5))
    g = spark.createDataFrame([(c, float(v)) for c, s in (("p", 0), ("q", 10)) for v in range(s, s + 15)], "g string, v double")
    assert relate.strata(g, "g", "v").first()["stratified"] and relate.anova(g, "g", "v").first()["eta2"] > 0.5


def test_models(linear):
    r = models.cross_validated(linear, ["a", "b"], "y", "i").first()
    assert r["n"] == 300 and r["rmse"] < 0.12 and r["r2"] > 0.99
    assert 0.2 < models.stump(linear, ["a", "b"], "y", "i").first()["r2"] < 0.9
    moved = linear.withColumn("m", F.col("a") + F.when(F.col("i") >= 210, 3).otherwise(0))
    assert models.psi(moved, "m", F.col("i") < 210).first()["band"] == "critical"
    assert models.out_of_distribution(moved.withColumn("m", F.col("m") * F.when(F.col("i") >= 210, 5).otherwise(1)), ["m", "b"], "i").first()["ood_rate"] > 0.5
    assert models.evenly(linear, 50, "i").count() == 50


def test_neural(linear, tmp_path):
    net, x, y = neural.fit(linear, ["a", "b"], "y", "i", neural.Settings(epochs=80))
    scored = neural.score(linear, net, ["a", "b"], "i").join(linear, "i")
    assert models.errors(scored, F.col("prediction"), "y", "net").first()["r2"] > 0.95
    w = neural.hybrid(net, x[:50], y[:50])
    assert w[0] > w[1]
    net.save(str(tmp_path / "n.npz"))
    assert neural.Network.load(str(tmp_path / "n.npz")).predict(x[:5]) == pytest.approx(net.predict(x[:5]))
    m, u = net.uncertainty(x[:4])
    assert len(m) == 4 and (u >= 0).all()


def test_neural_gradient():
    rng = np.random.default_rng(5)
    for name in ("relu", "tanh", "sigmoid", "gelu", "linear"):
        x = rng.normal(size=50)
        num = (neural.activate(name, x + 1e-6) - neural.activate(name, x - 1e-6)) / 2e-6
        assert neural.slope(name, x) == pytest.approx(num, abs=1e-4)


def test_time(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=400)
    y = np.zeros(400)
    for t in range(1, 400):
        y[t] = 0.3 * y[t - 1] + 0.8 * x[t - 1] + rng.normal(scale=0.2)
    d = spark.createDataFrame([(t, float(x[t]), float(y[t])) for t in range(400)], "t long, x double, y double")
    assert temporal.granger(d, "x", "y", "t", "t").first()["p_approx"] < 1e-6
    assert temporal.adf_drift(d, "y", "t").first()["verdict"] == "stationary"
    lag = {r["t"]: r["y_lag3"] for r in temporal.lagged(d, ["y"], "t", "t", 3).collect()}
    assert lag[2] is None and all(lag[t] == y[t - 3] for t in range(3, 400))
    s = {r["t"]: r["smoothed"] for r in temporal.exponential_smoothing(d.withColumn("k", F.lit(1)), "k", "y", "t").collect()}
    e = y[0]
    for t in range(1, 400):
        e = 0.3 * y[t] + 0.7 * e
        assert s[t] == pytest.approx(e, abs=1e-9)


def test_targets(spark):
    d = spark.createDataFrame([(i, float(i % 7), float(i), "ab"[i % 2]) for i in range(50)], "row_id long, size double, target double, kind string")
    t = select.resolve_target(d)
    assert t.name == "target" and t.task == "regression"
    assert select.resolve_target(d, user="size").strategy == "user"
    kept, gone = select.collect_features(d, "target")
    assert gone["row_id"] == "administrative" and "size" in kept


def test_causal_chain(spark):
    rng = np.random.default_rng(7)
    a, b = rng.exponential(size=600), rng.exponential(size=600)
    c = a + b + rng.exponential(scale=0.3, size=600)
    d = spark.createDataFrame([(i, float(a[i]), float(b[i]), float(c[i])) for i in range(600)], "i long, a double, b double, c double")
    edges = {(r["cause"], r["effect"]) for r in causal.discover(d, "c", ["a", "b"], "i", causal.Knobs(bootstraps=8)).collect()}
    assert edges == {("a", "c"), ("b", "c")}
    assert causal.kernel_p(a[:150], np.sin(3 * a[:150])) < 0.05 and not causal.acyclic({("a", "b"), ("b", "a")})


def test_partitioning_changes_nothing(linear):
    one = relate.pearson(linear.coalesce(1), ["a", "b", "y"]).collect()
    many = relate.pearson(linear.repartition(7), ["a", "b", "y"]).collect()
    assert all(math.isclose(p["r"], q["r"], abs_tol=1e-12) for p, q in zip(one, many, strict=True))


def test_plot_rules():
    assert plots.pie_fits([5, 5]) and not plots.pie_fits([99, 1]) and not plots.pie_fits([3])
    assert plots.line_fits(0.5, 50) and not plots.line_fits(0.4, 20) and plots.band_fits(0.5, 30) and not plots.residuals_fit(0.5, 99)
    r = np.array([[1, 0.1, 0.9], [0.1, 1, 0.2], [0.9, 0.2, 1]])
    assert sorted(plots.greedy_order(r)) == [0, 1, 2] and abs(plots.linkage_order(r).index(0) - plots.linkage_order(r).index(2)) == 1


def test_policies_and_scores():
    assert relate.choose_policy([0.7, 0.1]) == "corr_heavy" and relate.choose_policy([0.1] * 8) == "importance_heavy"
    assert relate.label(-0.9) == "Very strong negative association"
    w = relate.coherent_importance({"a": 3.0, "b": 1.0}, {"a": 0.2, "b": 0.2})
    assert w["a"] == pytest.approx(0.70 * 0.75 + 0.30 * 0.5) and sum(w.values()) == pytest.approx(1)
    assert profile.health_score(100, 0, 10, 5, 4, 0, 0, 0, 0.5)[0] == pytest.approx(100 * (0.30 + 0.05 + 0.15 + 0.05))
    assert neural.training_stability([(1.0, 1.0), (0.2, 0.2)]) == pytest.approx(0.7 * 0.9 + 0.3)
    assert neural.confidence(np.zeros(3), np.zeros(3), 0.5, "warning") == pytest.approx(1 - 0.15 - 0.15)


def test_groups_and_time_votes(spark, linear):
    g = gram(linear.withColumn("c", F.col("a") * 2 + 1), ["a", "b", "c"])
    assert relate.redundancy_groups(g, ["a", "b", "c"]) == {"a": "a", "b": "b", "c": "a"}
    assert [p[:2] for p in relate.deterministic(g, ["a", "b", "c"])] == [("a", "c")] and relate.leading({"a": 1, "b": 3}, 1) == ["b"]
    rng = np.random.default_rng(9)
    x = rng.exponential(size=400)
    y = np.concatenate([[0], x[:-1]]) * 0.9 + x * 0.5 + rng.exponential(scale=0.2, size=400)
    d = spark.createDataFrame([(i, float(x[i]), float(y[i])) for i in range(400)], "i long, x double, y double")
    one = causal.discover(d, "y", ["x"], "i", causal.Knobs(bootstraps=4)).first()
    two = causal.discover(d, "y", ["x"], "i", causal.Knobs(bootstraps=4), axis="i").first()
    assert {one["cause"], one["effect"]} == {"x", "y"} and two["confidence"] >= one["confidence"]


def test_heavy_tails_fill_no_single_bucket(spark, monkeypatch):
    """One value of 1e12 does not put all others into one bucket; order and ranks stay right."""
    from quillon.operators import profile, quantiles, temporal

    monkeypatch.setattr(quantiles, "BUCKET_ROWS", 1)

    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=3000), [1e12, -1e12], np.repeat(0.5, 200)])
    d = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double")
    cuts = quantiles.even_cuts(d, F.col("v"))
    sizes = [r["count"] for r in quantiles.with_bucket(d, F.col("v"), cuts, "b").groupBy("b").count().collect()]
    assert len(sizes) > 500 and max(sizes) <= 220
    order = np.sort(v)
    for parts in (2, 33, 64, 1024):
        few = quantiles.even_cuts(d, F.col("v"), parts)
        got = quantiles.with_bucket(d, F.col("v"), few, "b").collect()
        assert all(r["b"] == sum(c <= r["v"] for c in few) for r in got[::50])
    running = {r["v"]: (r["n"], r["upto"]) for r in profile.running_counts(d, F.col("v")).collect()}
    assert all(running[x][1] == int((order <= x).sum()) for x in list(running)[::20]) and running[0.5][0] == 200
    at = {r["i"]: r["place"] for r in temporal.positions(d, "v", "i", "place").collect()}
    assert [i for i, _ in sorted(at.items(), key=lambda t: t[1])] == sorted(range(len(v)), key=lambda i: (v[i], i))
    total = {r["i"]: r["v_cum"] for r in temporal.cumulative(d.withColumn("t", F.col("i")), "v", "t", "i").collect()}
    assert abs(total[1000] - v[:1001].sum()) < 1e-6


def test_quantiles_of_several_columns(spark, monkeypatch):
    from quillon.operators import quantiles

    monkeypatch.setattr(quantiles, "LISTED", 200)
    rng = np.random.default_rng(5)
    a, b = rng.lognormal(0, 8, 5000), np.repeat([1.0, 2.0, 3.0], [10, 4000, 990])
    d = spark.createDataFrame([(float(x), float(y), None, float("nan")) for x, y in zip(a, b, strict=True)], "a double, b double, c double, e double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(d, ["a", "b", "c", "e"], probs, single_pass=10)
    for name, x in (("a", a), ("b", b)):
        assert np.allclose([got[name][p] for p in probs], np.quantile(x, probs), rtol=1e-12)
    assert set(got["c"].values()) == set(got["e"].values()) == {None}


def test_knn_over_blocks(spark, monkeypatch):
    """Blocks of known rows and of holes give what one table gives; all rows are searched."""
    from quillon.operators import impute

    rng = np.random.default_rng(6)
    rows = [(i, float(rng.integers(0, 9)), float(rng.normal()) if rng.random() > 0.2 else None, float(rng.normal()) if i % 5 else None) for i in range(400)]
    d = spark.createDataFrame(rows, "i long, x double, z double, y double")
    want = {r["i"]: r["y"] for r in impute.knn(d, "y", ["x", "z"], "i").collect()}
    monkeypatch.setattr(impute, "KNOWN_ROWS", 37)
    monkeypatch.setattr(impute, "HOLE_ROWS", 11)
    got = {r["i"]: r["y"] for r in impute.knn(d, "y", ["x", "z"], "i").collect()}
    assert got == want and None not in got.values()
    x = np.array([[r[1], np.nan if r[2] is None else r[2]] for r in rows])
    z = (x - np.nanmean(x, axis=0)) / np.nanstd(x, axis=0, ddof=1)
    known = [r[0] for r in rows if r[3] is not None]
    for i in (0, 5, 100, 395):
        gap = (z[known] - z[i]) ** 2
        dist = np.round(np.sqrt(np.nanmean(gap, axis=1)), 12)
        near = sorted(zip(dist, known, strict=True))[:5]
        w = [1 / max(a, 1e-9) for a, _ in near]
        assert abs(want[i] - sum(k * rows[j][3] for k, (_, j) in zip(w, near, strict=True)) / sum(w)) < 1e-9
