"""Values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from privaudit.functions import arrays, noise, normal
from privaudit.operators import features, labels, metrics, scaler, splits
from privaudit.sources import splits_io


def scores(spark, values, truth):
    rows = [("g", str(i), float(s), y) for i, (s, y) in enumerate(zip(values, truth))]
    return spark.createDataFrame(rows, "g string, sample_id string, score double, y int")


FOUR = ([0.9, 0.8, 0.7, 0.6], [1, 0, 1, 0])


def test_tpr(spark):
    assert metrics.tpr_at_fpr(scores(spark, *FOUR), ["g"]).first()["tpr_at_fpr"] == 0.5
    assert metrics.tpr_at_fpr(scores(spark, FOUR[0], [1] * 4), ["g"]).first()["tpr_at_fpr"] == 0.0
    assert metrics.tpr_at_fpr(scores(spark, FOUR[0], [0] * 4), ["g"]).first()["tpr_at_fpr"] == 0.0


def test_auc(spark):
    auc = lambda *a: metrics.auc(scores(spark, *a), ["g"]).first()["auc"]
    assert auc(*FOUR) == 0.75
    assert auc([0.5, 0.5], [1, 0]) == 0.5
    assert math.isnan(auc(FOUR[0], [1] * 4))
    many, truth = [(i * 37 % 101) / 50 for i in range(200)], [i % 3 == 0 for i in range(200)]
    truth = [int(t) for t in truth]
    assert auc(many, truth) == pytest.approx(1 - auc([-s for s in many], truth))


def test_accuracy(spark):
    assert metrics.accuracy(scores(spark, *FOUR), ["g"]).first()["acc"] == 0.5
    assert metrics.accuracy(scores(spark, [0.5], [1]), ["g"]).first()["acc"] == 0.0


def test_tpr_grows_with_target(spark):
    s = scores(spark, [(i * 37 % 101) / 100 for i in range(100)], [int(i % 2 == 0) for i in range(100)])
    found = [metrics.tpr_at_fpr(s, ["g"], t).first()["tpr_at_fpr"] for t in (0.01, 0.1, 0.5, 1.0)]
    assert found == sorted(found) and found[-1] == 1.0


def test_summaries(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0, 2.0],)], "f array<double>")
    assert df.select(arrays.summaries(F.col("f"), 2, 2)).first()[0] == [2, 1, 1, 3, 2, 0, 2, 2]


def test_kl(spark):
    df = spark.createDataFrame([([0.0, 1.0], [0.0, 0.0])], "m array<double>, v array<double>")
    assert df.select(arrays.kl_terms(F.col("m"), F.col("v"))).first()[0] == [0.0, 0.5]


def test_splits(spark):
    samples = spark.range(1089).select(F.col("id").cast("string").alias("sample_id"))
    few, more = splits.assign(samples, [1, 2], 0.8), splits.assign(samples, list(range(1, 6)), 0.8)
    counts = {r["split_no"]: (r["n_member"], r["n_nonmember"]) for r in splits.counts(more, "split_no").collect()}
    assert counts == {s: (871, 218) for s in range(1, 6)}
    assert few.exceptAll(more).isEmpty()  # more splits leave the old ones as they are
    assert splits.assign(samples.limit(0), [1], 0.8).isEmpty()
    assert splits.assign(samples, [1], 0.0).where("is_member").isEmpty()
    assert splits.assign(samples, [1], 1.0).where("not is_member").isEmpty()


def test_roles(spark):
    found = {r["split_no"]: r["role"] for r in splits.roles(spark, 15, 5).collect()}
    assert [found[s] for s in (1, 10, 11, 15, 16, 20)] == ["train", "train", "val", "val", "holdout", "holdout"]
    for k, n in ((1, 1), (2, 1), (5, 3), (10, 7), (15, 10), (20, 14), (30, 21)):
        assert splits.roles(spark, k, 1).where("role = 'train'").count() == n
    assert splits.capped(15, 5, 5) == (4, 1) and splits.capped(3, 2, 5) == (3, 2)


def test_alpha_bar():
    a = noise.alpha_bar()
    for t, v in ((0, 0.999), (5, 0.99373115), (10, 0.98801968), (100, 0.820982), (999, 2.565e-05)):
        assert a[t] == pytest.approx(v, rel=1e-4)


def test_noise_column_equals_numpy(spark):
    got = spark.range(20).select(noise.normal(7, F.lit(1), F.col("id")).alias("e")).collect()
    assert [r["e"] for r in got] == pytest.approx(noise.bank(7, 2, 20)[1].tolist(), abs=1e-12)


def test_quantiles(spark):
    cells = spark.createDataFrame([(0, float(v)) for v in range(1, 6)], "gene_idx int, value double")
    fitted = scaler.fit(cells, ["gene_idx"], 5).cache()
    at = lambda x: fitted.select(scaler.normal(F.lit(x), F.col("quantiles")).alias("z")).first()["z"]
    assert at(2.5) == pytest.approx(-0.318639, abs=1e-6)
    assert at(0.0) == pytest.approx(-5.199337582605575, abs=1e-6)
    Q = scaler.quantile_matrix(fitted)
    X = np.array([[2.5], [0.0], [5.0], [3.0]])
    assert scaler.transform_matrix(X, Q)[:, 0] == pytest.approx([at(v) for v in X[:, 0].tolist()], abs=1e-9)
    assert scaler.inverse_matrix(scaler.transform_matrix(X[[0, 3]], Q), Q) == pytest.approx(X[[0, 3]], abs=1e-6)


def test_ties_in_quantiles(spark):
    cells = spark.createDataFrame([(0, v) for v in (1.0, 2.0, 2.0, 2.0, 3.0)], "gene_idx int, value double")
    fitted = scaler.fit(cells, ["gene_idx"], 5).cache()
    u = fitted.select(scaler.uniform(F.lit(2.0), F.col("quantiles")).alias("u")).first()["u"]
    assert u == 0.5
    assert scaler.transform_matrix(np.array([[2.0]]), scaler.quantile_matrix(fitted))[0, 0] == pytest.approx(0.0, abs=1e-12)


def test_normal_quantile():
    from statistics import NormalDist

    p = np.array([1e-6, 0.01, 0.3, 0.5, 0.9, 0.999999])
    assert normal.ppf_array(p) == pytest.approx([NormalDist().inv_cdf(v) for v in p], abs=1e-9)


def test_labels(spark):
    classes = labels.class_list(["a", "b", "c"], spark)
    df = spark.createDataFrame([("x", "c"), ("y", "a")], "sample_id string, label string")
    assert {r["sample_id"]: r["label_idx"] for r in labels.encode(df, classes).collect()} == {"x": 2, "y": 0}
    with pytest.raises(PySparkException, match="unknown label: d"):
        labels.encode(df.union(spark.createDataFrame([("z", "d")], df.schema)), classes).collect()


def test_positional_needs_equal_lengths(spark):
    a, b = spark.range(3).withColumnRenamed("id", "ordinal"), spark.range(2).withColumnRenamed("id", "ordinal")
    with pytest.raises(PySparkException, match="different lengths"):
        labels.positional(a.withColumn("x", F.lit(1)), b.withColumn("y", F.lit(1))).collect()


def test_stale(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], "f"), ("b", [1.0], "f"), ("c", [1.0, 2.0], "g"), ("d", [1.0, 2.0], None)], "id string, features array<double>, fingerprint string")
    assert {r["id"] for r in features.stale(df, 2, "f").collect()} == {"b", "c", "d"}


def test_best_step(spark):
    df = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.5), (1, 3, 0.5), (1, 4, 0.4)], "k int, step int, tpr double")
    assert metrics.best_step(df, ["k"]).first()["step"] == 2


def test_null_features_fail(spark):
    df = spark.createDataFrame([("a", [1.0, None])], "sample_id string, features array<double>")
    with pytest.raises(PySparkException, match="null or NaN"):
        features.checked(df).collect()


def test_tpr_with_tied_scores(spark):
    """One score holds all or most rows: cuts inside it follow the ids, whatever ranges they fall in."""
    import random

    rng = random.Random(4)
    rows = [(g, f"s{rng.randrange(10**6):06d}-{i}", score, int(rng.random() < 0.4)) for g, scores in ((1, [0.5]), (2, [0.9, 0.5, 0.1]), (3, [k / 50 for k in range(50)])) for i in range(400) for score in [rng.choice(scores)]]
    got = {r["g"]: r["tpr_at_fpr"] for r in metrics.tpr_at_fpr(spark.createDataFrame(rows, "g int, sample_id string, score double, y int"), ["g"], 0.1).collect()}
    for g in (1, 2, 3):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        p, n, tp, fp, best = sum(r[3] for r in own), sum(1 - r[3] for r in own), 0, 0, 0.0
        for r in own:
            tp, fp = tp + r[3], fp + 1 - r[3]
            best = max(best, tp / p) if fp / n <= 0.1 else best
        assert got[g] == best


def test_exact_quantiles_of_tied_and_small_columns(spark):
    import random

    import numpy as np

    rng = random.Random(5)
    columns = {0: [1.0] * 30, 1: [float(rng.randrange(4)) for _ in range(1500)], 2: [rng.gauss(0, 1) for _ in range(1500)], 3: [7.5], 4: [2.0, 4.0]}
    cells = spark.createDataFrame([(k, v) for k, vs in columns.items() for v in vs], "gene_idx int, value double")
    for n in (2, 400, 1500):
        got = {r["gene_idx"]: r["quantiles"] for r in scaler.fit(cells, ["gene_idx"], n).collect()}
        for k, vs in columns.items():
            assert np.allclose(got[k], np.quantile(vs, np.linspace(0, 1, max(2, min(1000, n)))), atol=1e-12), (k, n)


def test_split_lists_keep_the_samples_order(spark):
    import json

    samples = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2), ("d", 3)], "sample_id string, ordinal long")
    table = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "c", False), (1, "d", True)], "split_no int, sample_id string, is_member boolean")
    found = json.loads(splits_io.to_json(table, samples).first()["json"])
    assert found == {"split_1": {"train_ids": ["b", "a", "d"], "test_ids": ["c"]}}
