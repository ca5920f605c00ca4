"""Group tests, associations and models against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import associate as S
from assayer.operators import groups as G
from assayer.operators import models as M


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 900
    group = np.where(rng.random(n) < 0.4, "a", rng.choice(["b", "c"], n))
    value = np.round(rng.normal(10, 3, n) + (group == "c") * 1.5)
    rows = [(str(g), float(v), bool(rng.random() < 0.5), float(x)) for g, v, x in zip(group, value, rng.random(n), strict=True)]
    return rows, spark.createDataFrame(rows, "g string, v double, flag boolean, x double")


def ranks(values):
    order = np.sort(values)
    return (np.searchsorted(order, values, "left") + np.searchsorted(order, values, "right") + 1) / 2


def test_mann_whitney_and_posthoc(spark, table):
    rows, df = table
    frame = G.group_frame(df, [("v", "g")])
    for row in G.mann_whitney(frame, 6, range_rows=5).collect():
        left = np.array([v for g, v, *_ in rows if g == row["left_group"]])
        right = np.array([v for g, v, *_ in rows if g == row["right_group"]])
        r = ranks(np.concatenate([left, right]))[: left.size]
        assert row["u"] == pytest.approx(r.sum() - left.size * (left.size + 1) / 2)
    adjusted = G.posthoc(frame).collect()
    assert len(adjusted) == 3 and all(r["holm_adjusted_p_value"] >= r["raw_p_value"] for r in adjusted)


def test_kruskal_in_small_ranges(spark, table):
    rows, df = table
    row = G.kruskal(G.group_frame(df, [("v", "g")]), range_rows=4).first()
    values = np.array([r[1] for r in rows])
    labels = np.array([r[0] for r in rows])
    r, n = ranks(values), len(rows)
    h = 12 / (n * (n + 1)) * sum(r[labels == g].sum() ** 2 / (labels == g).sum() for g in "abc") - 3 * (n + 1)
    _, t = np.unique(values, return_counts=True)
    assert row["h"] == pytest.approx(h / (1 - (t**3 - t).sum() / (n**3 - n)))


def test_dispatch_and_rare_groups(spark, table):
    _, df = table
    rare = df.unionByName(df.limit(5).withColumn("g", F.lit("zz")))
    frame = G.group_frame(rare, [("v", "g"), ("x", "flag")])
    assert {r["level"] for r in frame.select("level").distinct().collect()} == {"a", "b", "c", "0", "1"}
    found = {r["pair"]: r for r in G.compare(frame, G.assumptions(frame)).collect()}
    assert found["v|g"]["n_groups"] == 3 and found["v|g"]["p_value"] < 0.001
    assert found["x|flag"]["test_name"] == "Mann-Whitney U" and found["x|flag"]["p_value"] > 0.001


def cells(spark, table):
    rows = [("p", f"l{i}", f"r{j}", n) for i, line in enumerate(table) for j, n in enumerate(line)]
    return spark.createDataFrame(rows, "pair string, left_level string, right_level string, n long")


def test_yates_and_cramers_v(spark):
    row = S.chi_square(cells(spark, [[359976, 5492], [51478, 12595]])).first()
    assert row["chi2"] == pytest.approx(44541.7829912694, rel=1e-12)
    assert row["cramers_v"] == pytest.approx(0.3220189925120536, rel=1e-12)


def test_zero_cells_count(spark):
    row = S.chi_square(cells(spark, [[10, 20, 5], [20, 0, 15]]).filter("n > 0")).first()
    observed = np.array([[10, 20, 5], [20, 0, 15]], dtype=float)
    expected = observed.sum(1, keepdims=True) * observed.sum(0) / observed.sum()
    assert row["chi2"] == pytest.approx(((observed - expected) ** 2 / expected).sum())


def test_fisher(spark):
    row = S.fisher(cells(spark, [[8, 2], [1, 5]])).first()
    assert row["odds_ratio"] == pytest.approx(20.0) and row["p_value"] == pytest.approx(0.03496503, rel=1e-6)


def test_spearman_with_ties_and_hot_value(spark):
    rng = np.random.default_rng(9)
    x = np.where(rng.random(600) < 0.4, 0.0, rng.integers(0, 300, 600)).astype(float)
    y = x * 0.3 + rng.integers(0, 60, 600)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    rho = S.spearman(df, [("x", "y")], range_rows=40).first()["spearman_rho"]
    assert rho == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1], rel=1e-10)


def test_spearman_index_with_nulls(spark, monkeypatch):
    """Three columns with different gaps: each pair has ranks of its own complete rows, by broadcast and by shuffle."""
    rng = np.random.default_rng(10)
    table = rng.integers(0, 40, (500, 3)).astype(float)
    table[rng.random((500, 3)) < 0.2] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in table], "x double, y double, z double")
    pairs = [("x", "y"), ("z", "x"), ("y", "z")]
    for few in (200_000, 5):
        monkeypatch.setattr(S, "SMALL_SIDE_ROWS", few)
        for row in S.spearman(df, pairs, range_rows=30).collect():
            a, b = (table[:, "xyz".index(row[c])] for c in ("left_column", "right_column"))
            both = ~np.isnan(a) & ~np.isnan(b)
            assert row["n_used"] == both.sum()
            assert row["spearman_rho"] == pytest.approx(np.corrcoef(ranks(a[both]), ranks(b[both]))[0, 1], rel=1e-10)
    assert S.spearman(df.limit(0), pairs).collect() == [("x", "y", 0, None), ("z", "x", 0, None), ("y", "z", 0, None)]


def test_shared_ranks_equal_the_tests_of_their_own(spark, table):
    """Levene, Kruskal-Wallis, statistics and Mann-Whitney from the shared table equal those from the rows."""
    _, df = table
    frame = G.group_frame(df, [("v", "g"), ("x", "flag")])
    shared = G.shared_ranks(frame, range_rows=7)

    def same(a, b, on):
        left, right = ({tuple(r[c] for c in on): r.asDict() for r in t.collect()} for t in (a, b))
        assert left.keys() == right.keys() and left
        for k, row in left.items():
            for c, v in row.items():
                assert right[k][c] == (pytest.approx(v, rel=1e-9) if isinstance(v, float) else v)

    same(G.levene(frame), G.levene(frame, shared), ["pair"])
    same(G.kruskal(frame), G.kruskal(frame, shared=shared), ["pair"])
    same(G.group_stats(frame), G.group_stats(frame, shared), ["pair", "level"])
    same(G.welch(frame), G.welch(frame, shared), ["pair", "left_group", "right_group"])
    same(G.mann_whitney(frame, 2), G._mann_whitney(shared.sums.filter("pair = 'x|flag'"), shared.levels, [(0, 1)]), ["pair"])


def test_linear_model_equals_least_squares(spark, table):
    rows, df = table
    design = M.design_matrix(df, "v", ["x"], ["flag"], ["g"])
    assert design.terms == ("x", "flag", "g_b", "g_c")
    coefficients, diagnostics, fitted = M.fit_linear(design)
    X = np.array([[1, x, flag, g == "b", g == "c"] for g, _, flag, x in rows], dtype=float)
    y = np.array([r[1] for r in rows])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    assert [r["coefficient"] for r in coefficients.collect()] == pytest.approx(beta.tolist(), rel=1e-6, abs=1e-8)
    residual = y - X @ beta
    assert diagnostics.first()["rmse"] == pytest.approx(math.sqrt((residual**2).mean()), rel=1e-8)
    assert fitted.count() == len(rows)


def test_logistic_model_and_skips(spark, table):
    _, df = table
    target = df.withColumn("hit", ((F.col("x") > 0.5) | (F.col("v") > 14)).cast("int"))
    coefficients, diagnostics, _ = M.fit_logistic(M.design_matrix(target, "hit", ["v"]))
    assert diagnostics.first()["status"] == "ok" and coefficients.count() == 2
    constant = M.fit_logistic(M.design_matrix(df.withColumn("hit", F.lit(1)), "hit", ["v"]))
    assert constant[1].first()["skip_reason"] == "target_has_single_class"
    assert M.fit_linear(M.design_matrix(df.limit(0), "v", ["x"]))[1].first()["skip_reason"] == "no_complete_cases"


def newton(X, y):
    beta = np.zeros(X.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-X @ beta))
        H = X.T @ (X * (mu * (1 - mu))[:, None])
        beta = beta + np.linalg.solve(H, X.T @ (y - mu))
    return beta, np.sqrt(np.diag(np.linalg.inv(H)))


def test_logistic_model_with_dependent_terms(spark):
    """Score parts and flags that determine each other: the later term goes, the others equal Newton's method."""
    rng = np.random.default_rng(31)
    n = 700
    a, flag = rng.normal(0, 1, n), rng.random(n) < 0.3
    hit = rng.random(n) < 1 / (1 + np.exp(-(0.4 + 1.2 * a - 0.8 * flag)))
    rows = [(int(h), float(x), float(2 * x), int(f), float(x + f)) for h, x, f in zip(hit, a, flag, strict=True)]
    df = spark.createDataFrame(rows, "hit int, a double, b double, flag int, c double").repartition(5)
    coefficients, diagnostics, predicted = M.fit_logistic(M.design_matrix(df, "hit", ["a", "b", "c"], ["flag"]))
    row = diagnostics.first()
    assert row["status"] == "ok" and row["dropped_terms"] == "b, flag"
    X, y = np.column_stack([np.ones(n), a, a + flag]), hit.astype(float)
    beta, error = newton(X, y)
    found = coefficients.collect()
    assert [r["term"] for r in found] == ["const", "a", "c"]
    assert [r["coefficient"] for r in found] == pytest.approx(beta.tolist(), rel=1e-8)
    assert [r["standard_error"] for r in found] == pytest.approx(error.tolist(), rel=1e-8)
    mu = 1 / (1 + np.exp(-X @ beta))
    assert row["brier"] == pytest.approx(((mu - y) ** 2).mean()) and row["accuracy"] == pytest.approx(((mu >= 0.5) == hit).mean())
    assert row["aic"] == pytest.approx(6 - 2 * np.log(np.where(hit, mu, 1 - mu)).sum())
    assert predicted.agg(F.sum("probability")).first()[0] == pytest.approx(y.sum())


@pytest.mark.parametrize("kind", ["complete", "quasi", "level"])
def test_separated_classes(spark, kind):
    """Classes that a term tells apart, wholly or up to ties on the border, have a status and no coefficients."""
    rng = np.random.default_rng(32)
    rows = []
    for k in range(400):
        x, noise = float(rng.normal()), float(rng.normal())
        hit = x > 0 if kind == "complete" else (x > 0 if abs(x) > 0.5 else k % 2 == 0)
        x = x if kind == "complete" or abs(x) > 0.5 else 0.0
        level = float(k % 10 == 0)
        rows.append((int(level or k % 3 == 0), level, noise) if kind == "level" else (int(hit), x, noise))
    design = M.design_matrix(spark.createDataFrame(rows, "hit int, x double, noise double"), "hit", ["x", "noise"])
    coefficients, diagnostics, _ = M.fit_logistic(design)
    row = diagnostics.first()
    assert row["status"] == "separated" and "x" in row["skip_reason"] and coefficients.count() == 0


def test_badly_scaled_and_singular_least_squares(spark):
    rng = np.random.default_rng(33)
    n = 500
    a, b, c = rng.normal(0, 1, (3, n))
    X = np.column_stack([np.ones(n), 1e6 + a, 1e-6 * b, 1e6 * a + c])
    y = X @ np.array([3.0, 2.0, 4e5, 1e-3]) + rng.normal(0, 0.1, n)
    df = spark.createDataFrame([tuple(map(float, (t, *r[1:]))) for t, r in zip(y, X, strict=True)], "y double, p double, q double, r double").repartition(7)
    coefficients, diagnostics, _ = M.fit_linear(M.design_matrix(df, "y", ["p", "q", "r"]))
    scale = np.linalg.norm(X, axis=0)
    want = np.linalg.lstsq(X / scale, y, rcond=None)[0] / scale
    fitted = X @ np.array([r["coefficient"] for r in coefficients.collect()])
    assert np.abs(fitted - X @ want).max() <= 1e-8 * np.abs(y).max() and diagnostics.first()["dropped_terms"] is None
    double = df.select("y", "q", (F.col("q") * 2).alias("twice"), F.col("p"))
    design = M.design_matrix(double, "y", ["q", "twice", "p"])
    kept = M.fit_linear(design)
    assert kept[1].first()["dropped_terms"] == "twice" and kept[0].count() == 3
    least = {r["term"]: r["coefficient"] for r in M.fit_linear(design, "minimum_norm")[0].collect()}
    assert least["twice"] == pytest.approx(2 * least["q"], rel=1e-6)


def test_inference_plan(spark, table):
    from assayer import Spec
    from assayer.plans.infer import Analysis, infer

    _, df = table
    named = df.withColumns({"id": F.xxhash64("v", "x").cast("string"), "hit": (F.col("x") + F.col("v") / 40 > 0.8).cast("int")})
    found = infer(named, Spec(id="id"), Analysis(
        outcomes=["v", "x"], grouping=["g", "flag"], categorical=["g", "flag"], numeric=["v", "x"], binary=["hit"],
        linear_target="v", logistic_target="hit", continuous_predictors=["v"], categorical_predictors=["g"],
    ))
    assert found["group_comparisons"].count() == 4
    assert found["categorical_associations"].first()["status"] == "ok"
    assert found["logistic_diagnostics"].first()["status"] == "ok"
    assert {"linear_coefficients", "posthoc", "mean_intervals", "diagnostics"} <= set(found)
    assert found["posthoc"].select("pair").distinct().collect() == [("v|g",)]
    assert {r["analysis"] for r in found["diagnostics"].collect()} >= {"group_comparison", "linear_model", "categorical_association"}


def test_linear_model_on_singular_and_perfect_designs(spark, table):
    _, df = table
    double = df.withColumns({"x2": F.col("x") * 3 - 1, "flag2": F.col("flag").cast("int")})
    coefficients, diagnostics, _ = M.fit_linear(M.design_matrix(double, "v", ["x", "x2", "flag2"], ["flag"]))
    found = diagnostics.first()
    assert found["status"] == "ok" and found["dropped_terms"] == "x2, flag" and coefficients.count() == 3
    perfect = M.fit_linear(M.design_matrix(df.withColumn("y", F.col("x") * 2 + 1), "y", ["x"]))
    assert perfect[1].first()["r2"] == pytest.approx(1.0) and perfect[0].count() == 2


def test_fractional_groups_and_missing_numbers(spark):
    from assayer.operators import intervals, plotdata, profile

    rows = [(float(i % 4) / 4, float(i)) for i in range(200)] + [(0.25, float("nan")), (None, 1.0)]
    df = spark.createDataFrame(rows, "g double, v double")
    levels = {r["level"] for r in G.group_frame(df, [("v", "g")]).select("level").distinct().collect()}
    assert levels == {"0", "0.25", "0.5", "0.75"}
    odd = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (float("nan"), "a"), (None, "a"), (5.0, "b")], "v double, g string")
    assert profile.null_profile(odd).filter("column = 'v'").first()["null_count"] == 2
    assert intervals.mean_intervals(odd, ["v"]).first()["estimate"] == pytest.approx(8 / 3)
    assert {r["g"]: r["mean"] for r in profile.numeric_by_group(odd, "v", "g").collect()} == {"a": 1.5, "b": 5.0}
    assert sum(r["n"] for r in plotdata.histogram(odd, "v", 4).collect()) == 3
    assert plotdata.boxplot(odd, "v").first()["n"] == 3


def test_normality_against_published_form(spark):
    random = np.random.default_rng(3)
    groups = {"normal": random.normal(0, 1, 400), "skewed": random.lognormal(0, 1, 400)}
    frame = spark.createDataFrame([("p", k, float(x)) for k, v in groups.items() for x in v], "pair string, level string, value double")
    got = {r["level"]: r for r in G.normality(frame).collect()}
    assert got["normal"]["p_value"] > 0.01 and got["skewed"]["p_value"] < 1e-10 and got["normal"]["n"] == 400
    assert {r["level"]: r["n"] for r in G.shapiro(frame).collect()} == {"normal": 400, "skewed": 400}


def test_levels_beyond_what_is_provided_for_fail(spark):
    frame = spark.createDataFrame([("p", f"l{i % 4}", float(i)) for i in range(200)], "pair string, level string, value double")
    with pytest.raises(ValueError, match="4 levels"):
        G.kruskal(frame, top_n=2)
    assert G.too_many_levels(frame, 3).collect() == [("p", 4)]
