"""Quantiles, moments, Gram / linear models, folds, calendar."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit.operators import profile as PR
from panelkit.operators import linear as LI
from panelkit.operators import folds as FO
from panelkit.functions.calendar import business_day


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25)])  # a hot value
    g = np.repeat([0, 1, 2], 1500)
    pdf = pd.DataFrame({"g": g, "v": v})
    df = spark.createDataFrame(pdf)
    got = PR.exact_quantiles(df, "v", [0.1, 0.25, 0.5, 0.9], by="g").toPandas()
    for (k, q), r in got.set_index(["g", "q"]).iterrows():
        assert abs(r["quantile"] - np.quantile(pdf[pdf.g == k].v, q)) < 1e-12
    whole = PR.exact_quantiles(df, "v", [0.5]).first()["quantile"]
    assert abs(whole - np.quantile(v, 0.5)) < 1e-12


def test_moments_match_pandas(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"g": 1, "x": rng.standard_t(5, size=500)})
    got = PR.moments(spark.createDataFrame(pdf), "x", by="g").first()
    assert abs(got["skew"] - pdf.x.skew()) < 1e-9
    assert abs(got["kurt"] - pdf.x.kurt()) < 1e-9
    assert abs(got["median"] - pdf.x.median()) < 1e-12


def test_enet_kkt_and_ols(spark):
    rng = np.random.default_rng(7)
    n, p = 2000, 5
    X = rng.normal(size=(n, p))
    y = X @ np.array([1.0, -0.5, 0.0, 0.0, 0.2]) + 0.1 * rng.normal(size=n)
    pdf = pd.DataFrame(X, columns=[f"x{i}" for i in range(p)]).assign(y=y)
    df = spark.createDataFrame(pdf)
    feats = [f"x{i}" for i in range(p)]
    ols = LI.fit(df, feats, "y").first()
    ref = np.linalg.lstsq(np.c_[np.ones(n), X], y, rcond=None)[0]
    assert abs(ols["intercept"] - ref[0]) < 1e-9
    np.testing.assert_allclose(ols["coef"], ref[1:], atol=1e-9)
    en = LI.fit(df, feats, "y", alpha=0.05, l1_ratio=0.5).first()
    w = np.array(en["coef"])
    Xc, yc = X - X.mean(0), y - y.mean()
    C, c = Xc.T @ Xc / n, Xc.T @ yc / n
    assert LI.kkt_violation(C, c, w, 0.05, 0.5) < 1e-8


def test_time_folds_and_kfold(spark):
    counts = spark.createDataFrame([(1, 2500)], "series_id long, n long")
    f = FO.time_folds(counts, 8, 252, 1).orderBy("fold").toPandas()
    assert list(f.test_lo) == [2500 - (8 - i) * 252 for i in range(8)]
    assert (f.train_hi == f.test_lo - 1).all()
    assert (f.train_hi - f.fit_hi == np.maximum(np.minimum(f.train_hi // 5, 252), 50)).all()
    small = FO.time_folds(spark.createDataFrame([(1, 8 * 252)], "series_id long, n long"), 8, 252).toPandas()
    assert not small.valid.any()
    rows = spark.range(23).select(F.lit(1).alias("k"), F.col("id").alias("rn"), F.lit(23).alias("n"))
    sizes = FO.kfold_contiguous(rows, 10).groupBy("fold").count().orderBy("fold").toPandas()["count"].tolist()
    assert sizes == [3, 3, 3, 2, 2, 2, 2, 2, 2, 2]


def test_business_day_matches_pandas(spark):
    for start in ("1990-01-01", "2024-01-03", "2024-01-06"):
        got = [r[0] for r in spark.range(40).select(business_day("id", start)).collect()]
        ref = pd.bdate_range(start=start, periods=40)
        assert [d.isoformat() for d in got] == [d.date().isoformat() for d in ref]


def test_enet_cv_is_the_direct_one(spark):
    """CV losses and the refit against a plain solve on the rows; any chunk gives the same."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 4))
    y = x @ [0.8, 0.0, -0.3, 0.0] + 0.5 * rng.normal(size=400) + 3
    fold = np.arange(400) * 5 // 400
    rows = [(g, int(f), *map(float, r), float(t)) for g in (None, 7) for f, r, t in zip(fold, x, y)]
    df = spark.createDataFrame(rows, "g long, fold int, a double, b double, c double, d double, y double")
    alphas = [0.01, 0.03, 0.1, 0.3, 1.0]

    def solved(xs, ys, a):
        C, c = np.cov(xs.T, bias=True), (xs - xs.mean(0)).T @ (ys - ys.mean()) / len(ys)
        w = LI.enet_cd(C, c, a, 0.5)
        assert LI.kkt_violation(C, c, w, a, 0.5) < 1e-8
        return w, ys.mean() - xs.mean(0) @ w

    want = {}
    for a in alphas:
        loss = []
        for f in range(5):
            w, b = solved(x[fold != f], y[fold != f], a)
            loss.append(((x[fold == f] @ w + b - y[fold == f]) ** 2).mean())
        want[a] = np.mean(loss)
    for chunk in (1, 2, 10):
        cv, model = LI.enet_cv(df, ["a", "b", "c", "d"], "y", by="g", alphas=alphas, chunk=chunk)
        got = {(r.g, r.alpha): r.mse for r in cv.collect()}
        assert set(got) == {(g, a) for g in (None, 7) for a in alphas}
        for (_, a), v in got.items():
            assert abs(v - want[a]) < 1e-9
        w, b = solved(x, y, min(want, key=want.get))
        for r in model.collect():
            np.testing.assert_allclose(r.coef, w, atol=1e-7)
            assert abs(r.intercept - b) < 1e-7


def test_quantiles_of_any_size_with_null_keys(spark):
    rng = np.random.default_rng(1)
    rows = [(None, float(v)) for v in rng.normal(size=25_000)] + [(1, float(v)) for v in rng.integers(0, 3, 4000)]
    rows += [(k, float(v)) for k in range(2, 40) for v in rng.normal(size=k)] + [(50, None), (51, float("nan")), (52, 5.0)]
    df = spark.createDataFrame(rows, "g long, v double")
    qs = [0.0, 0.01, 0.25, 0.5, 0.777, 1.0]
    got = {(r.g, r.q): r.quantile for r in PR.exact_quantiles(df, "v", qs, by="g").collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    pdf = pdf[pdf.v.notna()]
    pdf["g"] = pdf.g.astype(float).fillna(-1)
    want = {(None if g < 0 else int(g), q): np.quantile(x.v, q) for g, x in pdf.groupby("g") for q in qs}
    assert set(got) == set(want)
    for k, v in want.items():
        assert abs(got[k] - v) < 1e-12, k
    d = {r.g: r for r in PR.describe(df, by="g", value="v").collect()}
    assert abs(d[None].q50 - want[None, 0.5]) < 1e-12 and d[50].q50 is None and d[50]["count"] == 0
    b = {r.g: r for r in PR.box_stats(df, "v", by="g").collect()}
    assert abs(b[None].q3 - np.quantile(pdf[pdf.g == -1].v, 0.75)) < 1e-12


def test_density_within_its_bound(spark):
    rng = np.random.default_rng(3)
    rows = [(None, float(v)) for v in rng.normal(size=3000)] + [(1, float(v)) for v in rng.exponential(size=800)]
    rows += [(2, 5.0)] * 7 + [(1, None)]
    df = spark.createDataFrame(rows, "g long, v double")
    for bins in (32, 256, 1024):
        got = PR.kde_curve(df.withColumnRenamed("g", "k"), "v", 60, by="k", bins=bins).toPandas()
        for g in (None, 1):
            v = np.array([x for k, x in rows if k == g and x is not None])
            bw = len(v) ** -0.2 * v.std(ddof=1)
            part = got[(got.iloc[:, 0].isna() if g is None else got.iloc[:, 0] == g)].sort_values("i")
            at = v.min() + (v.max() - v.min()) * part["i"].to_numpy() / 59
            exact = np.exp(-0.5 * ((at[:, None] - v) / bw) ** 2).sum(1) / (len(v) * bw * np.sqrt(2 * np.pi))
            assert (np.abs(part["density"].to_numpy() - exact) <= part["error_bound"].to_numpy() + 1e-12).all()
    assert part["error_bound"].max() < 2e-4  # densities reach 0.7
    assert got[got.iloc[:, 0] == 2]["density"].isna().all()


def test_tiled_gram(spark):
    """Pairs of column tiles give the one-tile result, gaps and a NULL key included."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 11)) + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    cols = [f"c{i}" for i in range(11)]
    rows = [(None if k % 3 == 0 else k % 3, *[None if np.isnan(v) else float(v) for v in r]) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "g long, " + ", ".join(f"{c} double" for c in cols))
    key = lambda r: ((r["g"] or 0), r["i"], r["j"])
    one = sorted(PR.gram(df, cols, "g").collect(), key=key)
    many = sorted(PR.gram(df, cols, "g", tile=4).collect(), key=key)
    assert len(one) == len(many) == 3 * 121
    for a, b in zip(one, many):
        assert key(a) == key(b)
        np.testing.assert_allclose([a[c] for c in a.asDict() if c != "g"], [b[c] for c in a.asDict() if c != "g"], rtol=1e-9, atol=1e-6)


def test_narrow_gram_equals_the_tiled_one(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 3)) + [1e8, 0.0, 5.0]
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:300, 1] = 2.0
    df = spark.createDataFrame([(None if i < 200 else i % 3, *map(float, r)) for i, r in enumerate(x)],
                               "k long, a double, b double, c double").repartition(5)
    for by in ((), ("k",)):
        order = [*by, "i", "j"]
        want = PR._gram_pair(df, ["a", "b", "c"], range(3), range(3), list(by)).toPandas().sort_values(order)
        got = PR.gram(df, ["a", "b", "c"], by)
        assert "FlatMapGroups" not in got._jdf.queryExecution().analyzed().toString() and got.columns == list(want.columns)
        np.testing.assert_allclose(got.toPandas().sort_values(order).to_numpy(float), want.to_numpy(float), rtol=1e-9, atol=1e-6)


def test_stacked_elastic_nets_equal_single_ones():
    rng = np.random.default_rng(6)
    X = rng.normal(size=(7, 40, 3))
    C, c, alpha = np.einsum("bni,bnj->bij", X, X) / 40, rng.normal(size=(7, 3)), np.geomspace(1e-4, 10, 7)
    C[3, 1] = C[3, :, 1] = 0.0  # a constant feature
    got = LI.enet_cd_many(C, c, alpha, 0.5)
    want = np.array([LI.enet_cd(C[i], c[i], alpha[i], 0.5) for i in range(7)])
    np.testing.assert_allclose(got, want, rtol=0, atol=1e-12)


@pytest.mark.parametrize("p", [2, LI.NARROW + 1])
def test_groups_are_solved_by_the_batch(spark, p):
    rng = np.random.default_rng(7)
    rows = [(g, i % 5, *map(float, rng.normal(size=p + 1))) for g in range(4) for i in range(60)]
    feats = [f"f{i}" for i in range(p)]
    df = spark.createDataFrame(rows, "g long, fold int, " + ", ".join(f"{f} double" for f in [*feats, "y"]))
    cv, model = LI.enet_cv(df, feats, "y", by="g", alphas=[0.01, 0.1, 1.0], chunk=2)
    assert cv.count() == 12 and model.count() == 4
    one = {(r.g, r.alpha): r.mse for r in LI.enet_cv(df.where("g = 2"), feats, "y", by="g", alphas=[0.01, 0.1, 1.0], chunk=3)[0].collect()}
    got = {(r.g, r.alpha): r.mse for r in cv.where("g = 2").collect()}
    assert got == pytest.approx(one, rel=1e-8)
    x = df.where("g = 1").toPandas()
    w = np.linalg.lstsq(np.column_stack([x[feats], np.ones(len(x))]), x["y"], rcond=None)[0]
    assert LI.fit(df, feats, "y", by="g").where("g = 1").first().coef == pytest.approx(w[:-1].tolist(), rel=1e-8)
    if p <= LI.NARROW:  # no Python call per group
        assert "FlatMapGroups" not in model._jdf.queryExecution().analyzed().toString()
