"""Shadow families against direct NumPy evaluation, and the audit's stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from privaudit.config import AuditConfig
from privaudit.functions import noise
from privaudit.operators import statistics
from privaudit.plans import shadows
from privaudit.plans.audit import Audit
from privaudit.plans.queries import _member_rows, _samples
from privaudit.sources import matrix, splits_io, stages

CFG = AuditConfig(levels=(5, 20), draws=3, temperatures=(0.0, 1.0), latent_dim=4, train_shadows=2, holdout_shadows=1, scale=False, rf={"numTrees": 10, "maxDepth": 4, "minInstancesPerNode": 5})


def test_spectrum_equals_numpy(spark, small):
    rows = _member_rows(spark, small).where("split_no <= 2")
    X = np.array([r["features"] for r in rows.where("split_no = 2").collect()], float)
    g = shadows.gaussians(statistics.spectrum(rows))[2]
    values = np.linalg.eigvalsh(np.cov(X.T, bias=True))[::-1]
    assert g.mean[0] == pytest.approx(X.mean(axis=0), abs=1e-9)
    assert g.values == pytest.approx(np.maximum(values, 1e-6), abs=1e-9)
    assert (g.vectors * g.values) @ g.vectors.T == pytest.approx(np.cov(X.T, bias=True), abs=1e-5)


def test_diffusion_loss_is_the_best_denoisers_error():
    rng = np.random.default_rng(0)
    d, a = 5, 0.9
    L = rng.normal(size=(d, d))
    S, mu = L @ L.T + np.eye(d), rng.normal(size=d)
    values, vectors = np.linalg.eigh(S)
    x, e = rng.normal(size=d), rng.normal(size=d)
    xt = np.sqrt(a) * x + np.sqrt(1 - a) * e
    x0 = mu + np.sqrt(a) * S @ np.linalg.solve(a * S + (1 - a) * np.eye(d), xt - np.sqrt(a) * mu)
    direct = (((xt - np.sqrt(a) * x0) / np.sqrt(1 - a) - e) ** 2).mean()
    got = shadows.diffusion_losses(((x - mu) @ vectors)[None], (e @ vectors)[None], values, np.array([a]))
    assert got[0, 0] == pytest.approx(direct)


def test_latent_loss_is_the_reconstruction_error():
    rng = np.random.default_rng(1)
    X = rng.normal(size=(40, 6)) @ rng.normal(size=(6, 6))
    mu = X.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov(X.T, bias=True))
    values, vectors, q = values[::-1], vectors[:, ::-1], 2
    E, R = rng.normal(size=(1, q)), X - mu
    loss, kl = shadows.latent_losses(R, values, vectors, q, (0.5,), E)
    s2 = values[q:].mean()
    s = np.sqrt(values[:q] - s2)
    m, var = s * (R @ vectors[:, :q]) / values[:q], s2 / values[:q]
    z = m + 0.5 * np.sqrt(var) * E[0]
    assert loss[:, 0] == pytest.approx((((z * s) @ vectors[:, :q].T - R) ** 2).mean(axis=1))
    assert kl == pytest.approx(-0.5 * (1 + np.log(var) - m**2 - var))


def test_zero_temperature_draws_are_equal(spark, small):
    family = shadows.FAMILIES["latent"]
    found = family.losses(family.fit(_member_rows(spark, small).where("split_no = 1"), 1e-6), _samples(spark, small), CFG).first()["features"]
    assert found[0] == found[1] == found[2] and len(found) == family.width(CFG)


def test_members_score_lower(spark, small):
    audit = Audit(_samples(spark, small), "unused", CFG)
    family = audit.family
    rows = _member_rows(spark, small).where("split_no = 1")
    losses = family.losses(family.fit(rows, 1e-6), audit.samples, CFG)
    mean = losses.select("sample_id", F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("loss"))
    both = mean.join(rows.select("sample_id", F.lit(1).alias("m")), "sample_id", "left")
    found = {r["m"]: r["l"] for r in both.groupBy("m").agg(F.avg("loss").alias("l")).collect()}
    assert found[1] < found[None]


def test_generation_keeps_the_labels(spark, small):
    family, members = shadows.FAMILIES["latent"], _member_rows(spark, small, F.col("label")).where("split_no = 1")
    drawn = family.generate(family.fit(members, 1e-6), members.withColumnRenamed("sample_id", "row_id"), CFG)
    count = lambda df: {r["label_idx"]: r["count"] for r in df.groupBy("label_idx").count().collect()}
    assert count(drawn) == count(members)


@pytest.mark.parametrize("family", ["diffusion", "latent"])
def test_audit_is_incremental(spark, small, tmp_path, family):
    from dataclasses import replace

    cfg = replace(CFG, family=family)
    audit = Audit(_samples(spark, small), f"file://{tmp_path}/audit", cfg)
    metrics = audit.metrics("synth", "synth").collect()
    assert len(metrics) == 1 and 0 <= metrics[0]["auc"] <= 1
    n = 500 * len(cfg.splits)
    assert audit.computed["features-synth"] == n and audit.computed["shadows-synth"] == cfg.splits
    again = Audit(_samples(spark, small).repartition(3), audit.root, cfg)
    assert again.metrics("synth", "synth").collect() == metrics
    assert again.computed["features-synth"] == 0 and again.computed["splits"] == []
    path, made = f"file://{tmp_path}/stage", []
    compute = lambda n: made.extend(n) or spark.createDataFrame([(i, i * len(made)) for i in n], "split_no int, v int")
    assert stages.ensure(spark, path, [1, 2, 3], "one", compute) == [1, 2, 3] and stages.ensure(spark, path, [1, 3], "one", compute) == []
    assert stages.ensure(spark, path, [1, 2, 3, 9], {1: "one", 2: "other", 3: "one", 9: "new"}, compute) == [2, 9]
    assert made == [1, 2, 3, 2, 9] and {r["split_no"]: r["v"] for r in spark.read.parquet(path).collect()} == {1: 3, 2: 10, 3: 9, 9: 45}
    gap = audit.domain_gap().first()
    assert gap["trained_on"] == "real"
    # a forced stage renews those after it, once
    forced = Audit(_samples(spark, small), audit.root, cfg, force=frozenset({"synthetic"}))
    assert not forced._forced("shadows", "a") and forced._forced("synthetic", "b") and forced._forced("classifier", "c") and not forced._forced("classifier", "c")
    assert Audit(_samples(spark, small), audit.root, cfg, force=frozenset({"splits"}))._forced("splits", "a")


def cells(audit, source="real"):
    return {(r["split_no"], r["sample_id"]): (r["y_member"], r["features"]) for r in audit.features(source).collect()}


def same(a, b):
    return a.keys() == b.keys() and all(a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1], rel=1e-4, abs=1e-6) for k in a)


@pytest.mark.parametrize("scale", [False, True])
def test_audit_follows_its_samples(spark, small, tmp_path, scale):
    """More, fewer and changed samples under one root give what a new root gives."""
    from dataclasses import replace

    cfg, root = replace(CFG, scale=scale), f"file://{tmp_path}/one"
    samples = _samples(spark, small)
    wide = samples.withColumn("features", F.slice("features", 1, 6))
    few = wide.where("ordinal < 250")
    first = Audit(few, root, cfg)
    before = cells(first)
    assert len(before) == 250 * 3 == first.computed["features-real"]
    assert {r["n_member"] for r in first.metrics("real", "real").collect()} == {200}
    more = Audit(wide.where("ordinal < 260"), root, cfg)
    assert same(cells(more), cells(Audit(wide.where("ordinal < 260"), f"file://{tmp_path}/two", cfg))) and len(cells(more)) == 260 * 3
    assert more.computed["splits"] == cfg.splits  # the member threshold has moved
    back = Audit(few, root, cfg)
    assert same(cells(back), before) and back.computed["features-real"] in (0, 250 * 3)
    with pytest.raises(ValueError, match="in no split"):
        lost = Audit(few, root, cfg)
        lost._known["splits"] = lost.splits().where("sample_id <> '7'")
        lost.features("real")


def test_only_changed_cells_are_scored(spark, small, tmp_path):
    """Rows that no shadow was fitted on come, change and go at the cost of their own cells."""
    from privaudit.operators import splits

    samples, root = _samples(spark, small).withColumn("features", F.slice("features", 1, 6)), f"file://{tmp_path}/one"
    old = samples.where("ordinal < 300")
    folds = splits.assign(old, [1, 2, 3], 0.8, 7)
    extra = samples.where("ordinal between 300 and 309")
    listed = folds.union(extra.select(F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("split_no"), "sample_id", F.lit(False)))
    first = Audit(old, root, CFG, split_table=folds)
    before = cells(first)
    grown = Audit(old.union(extra), root, CFG, split_table=listed)
    after = cells(grown)
    assert grown.computed["features-real"] == 30 and grown.computed["shadows-real"] == []
    assert {k: v for k, v in after.items() if k in before} == before  # cells that stay are those that were there
    assert same(after, cells(Audit(old.union(extra), f"file://{tmp_path}/two", CFG, split_table=listed)))
    other = F.when(F.col("ordinal") >= 305, F.transform("features", lambda x: x + F.lit(1).cast("float"))).otherwise(F.col("features"))
    changed = Audit(old.union(extra.withColumn("features", other)), root, CFG, split_table=listed)
    assert changed.features("real").count() == 930 and changed.computed["features-real"] == 15
    gone = Audit(old, root, CFG, split_table=folds)
    assert cells(gone) == before and gone.computed["features-real"] == 0
    # a member that changes renews the shadows it is a member of, and only those
    asked = folds.where("is_member").groupBy("sample_id").agg(F.collect_list("split_no").alias("s")).where("size(s) = 2").first()
    bent = old.withColumn("features", F.when(F.col("sample_id") == asked["sample_id"], F.transform("features", lambda x: x * F.lit(2).cast("float"))).otherwise(F.col("features")))
    moved = Audit(bent, root, CFG, split_table=folds)
    assert same(cells(moved), cells(Audit(bent, f"file://{tmp_path}/three", CFG, split_table=folds)))
    assert moved.computed["shadows-real"] == sorted(asked["s"]) and moved.computed["features-real"] == 300 * 2 + 1


def test_jobs_do_not_grow_with_splits(spark, small, tmp_path):
    from dataclasses import replace

    def jobs(k):
        group = f"audit-{k}"
        spark.sparkContext.setJobGroup(group, group)
        audit = Audit(_samples(spark, small), f"file://{tmp_path}/{k}", replace(CFG, train_shadows=k))
        assert audit.features("real").count() == 500 * (k + 1)
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    few, many = jobs(2), jobs(9)
    assert abs(few - many) <= 2


def test_far_means_lose_nothing(spark):
    rng = np.random.default_rng(0)
    X = np.column_stack([1e8 + rng.normal(size=400), -3e7 + 2 * rng.normal(size=400), rng.normal(size=400)])
    X[:, 2] += X[:, 0] - 1e8
    y = np.arange(400) % 2
    Y = X + 5e8 * y[:, None]
    rows = [(int(i), [1, 2] if i % 3 else [2], int(k), v.tolist()) for i, (k, v) in enumerate(zip(y, Y))]
    df = spark.createDataFrame(rows, "sample_id long, splits array<int>, label_idx int, features array<double>").repartition(5)
    for number, inside in ((1, np.arange(400) % 3 > 0), (2, np.ones(400, bool))):
        g = shadows.gaussians(statistics.spectrum(df))[number]
        centred = np.vstack([X[inside & (y == k)] - X[inside & (y == k)].mean(axis=0) for k in (0, 1)])
        want = centred.T @ centred / inside.sum()
        assert (g.vectors * g.values) @ g.vectors.T == pytest.approx(want, rel=1e-6, abs=1e-6)
        assert g.mean[1] == pytest.approx(Y[inside & (y == 1)].mean(axis=0), rel=1e-12)


def test_external_tables_are_capped_and_use_their_splits(spark, small, tmp_path):
    from dataclasses import replace

    from privaudit.operators import splits

    samples = _samples(spark, small)
    folds = splits.assign(samples, [1, 2, 3], 0.8, 7)
    made = samples.join(folds.where("is_member"), "sample_id").select("split_no", F.col("sample_id").alias("row_id"), F.lit(0).alias("label_idx"), "features")
    audit = Audit(samples, f"file://{tmp_path}/audit", replace(CFG, train_shadows=15, holdout_shadows=5), external=made, split_table=folds)
    assert (audit.cfg.train_shadows, audit.cfg.holdout_shadows) == (2, 1)
    found = audit.metrics("synth", "synth").first()
    assert found["split_no"] == 3 and found["n_member"] == 400 and found["auc"] > 0.6
    holes = Audit(samples, audit.root, replace(CFG, train_shadows=1, holdout_shadows=1), external=made.where("split_no <> 2"), split_table=folds)
    with pytest.raises(FileNotFoundError, match="no synthetic table for splits .2."):
        holes.features("synth")


def test_split_files(spark, small, tmp_path):
    samples, path = _samples(spark, small), f"file://{tmp_path}/splits"
    assert splits_io.extend(samples, path, [1, 2], 0.8, 42) == [1, 2]
    before = spark.read.parquet(path).collect()
    assert splits_io.extend(samples, path, [1, 2, 3], 0.8, 42) == [3]
    assert {tuple(r) for r in before} <= {tuple(r) for r in spark.read.parquet(path).collect()}
    fold = spark.createDataFrame([('{"splits": {"split_1": {"train_index": ["a"], "test_index": ["b", "c"]}}}',)], "json string")
    found = {(r["split_no"], r["sample_id"], r["is_member"]) for r in splits_io.from_kfold_json(fold).collect()}
    assert found == {(1, "a", True), (1, "b", False), (1, "c", False)}
    with pytest.raises(FileNotFoundError, match="run it first"):
        stages.read(spark, f"file://{tmp_path}/none", hint="run it first")


def test_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("gene\ts1\ts2\nG1\t1.0\t2.0\nG2\t3.0\t4.0\nG0\t5.0\t6.0\n")
    samples, genes = matrix.read_matrix(spark, f"file://{tmp_path}/m.tsv")
    assert genes == ["G1", "G2", "G0"]
    assert {r["sample_id"]: (r["ordinal"], r["features"]) for r in samples.collect()} == {"s1": (0, [1, 3, 5]), "s2": (1, [2, 4, 6])}
    (tmp_path / "r.csv").write_text("G0,G1,G2\n5,1,3\n6,2,4\n")
    (tmp_path / "l.csv").write_text("id,label\n0,a\n1,b\n")
    found = matrix.read_labelled(spark, f"file://{tmp_path}/r.csv", f"file://{tmp_path}/l.csv", genes).collect()
    assert sorted((r["features"], r["label"]) for r in found) == [([1, 3, 5], "a"), ([2, 4, 6], "b")]
    with pytest.raises(ValueError, match="missing"):
        matrix.read_released(spark, f"file://{tmp_path}/r.csv", ["G9"])
    assert matrix.read_reference(spark, None).isEmpty() and matrix.read_reference(spark, f"file://{tmp_path}/nowhere.tsv").isEmpty()
    assert [r["label"] for r in matrix.read_labels(spark, f"file://{tmp_path}/l.csv").collect()] == ["a", "b"]
    matrix.write_predictions(spark.createDataFrame([("b", 1, 0.5), ("a", 0, 0.25)], "sample_id string, ordinal long, score double"), f"file://{tmp_path}/out")
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text.splitlines() == ["sample_id,score", "a,0.25", "b,0.5"]


def test_top_of_the_spectrum(spark):
    """A range finder's values, vectors and losses are those of the whole spectrum."""
    rng = np.random.default_rng(6)
    d, n = 90, 500
    X = rng.normal(size=(n, d)) * (30 * 0.7 ** np.arange(d) + 0.5) @ np.linalg.qr(rng.normal(size=(d, d)))[0] + 100
    rows = [(f"{i}", [1, 2] if i % 4 else [2], i % 3, v.tolist()) for i, v in enumerate(X)]
    df = spark.createDataFrame(rows, "sample_id string, splits array<int>, label_idx int, features array<double>").repartition(4)
    family = shadows.FAMILIES["latent"]
    whole, top = shadows.gaussians(family.fit(df, 1e-6)), shadows.gaussians(family.fit(df, 1e-6, rank=8, numbers=[1, 2]))
    small = shadows.gaussians(statistics.top_spectrum(df, 8, [1, 2], held=1))  # a split at a time
    for s in (1, 2):
        assert top[s].values[:8] == pytest.approx(whole[s].values[:8], rel=1e-6) and small[s].values == pytest.approx(top[s].values, rel=1e-9)
        assert top[s].values[8] == pytest.approx(whole[s].values[8:].mean(), rel=1e-6)
        assert np.abs((top[s].vectors * whole[s].vectors[:, :8]).sum(axis=0)) == pytest.approx(np.ones(8), abs=1e-4)
        assert top[s].mean[2] == pytest.approx(whole[s].mean[2]) and top[s].n == whole[s].n
    from dataclasses import replace

    cfg = replace(CFG, family="latent", latent_dim=8, temperatures=(0.0,), draws=1)
    a, b = ({(r["split_no"], r["sample_id"]): r["features"] for r in family.losses(p, df.drop("splits"), cfg).collect()} for p in (family.fit(df, 1e-6), family.fit(df, 1e-6, rank=8, numbers=[1, 2])))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-3, abs=1e-4) for k in a)
    with pytest.raises(ValueError, match="whole spectrum"):
        shadows.FAMILIES["diffusion"].fit(df, 1e-6, rank=8, numbers=[1])


def test_noise_bank_is_shared():
    assert (noise.bank(1, 2, 3) == noise.bank(1, 4, 3)[:2]).all()


def test_split_rows_stay_where_they_are(spark):
    from collections import Counter

    from privaudit.operators import splits

    table = splits.assign(spark.range(1000).select(F.col("id").cast("string").alias("sample_id")), [1, 2])
    assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
    assert table.where("is_member").count() == 1600
    copies = spark.range(90).select(F.when(F.col("id") >= 10, (F.col("id") % 3).cast("string")).alias("sample_id"))  # the cut goes through an id's copies
    found = splits.assign(copies, [1, 2], 0.5).collect()
    assert Counter((r["split_no"], r["is_member"]) for r in found) == {(s, m): 45 for s in (1, 2) for m in (True, False)}
    assert Counter(r["sample_id"] for r in found if r["split_no"] == 1) == Counter(r["sample_id"] for r in copies.collect())


def test_prepared_features_are_the_summaries(spark):
    from privaudit.functions import arrays
    from privaudit.plans import classify

    X = np.random.default_rng(3).lognormal(size=(3000, 57)).astype(np.float32)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "i int, features array<float>").repartition(2)
    for family, at in (("diffusion", {"levels": (5, 10, 20)}), ("latent", {"temperatures": (0.0, 1.0, 2.0), "latent_dim": 6})):
        cfg = AuditConfig(family=family, draws=17, **at)
        used = arrays.summaries(F.col("features"), 3, 17)
        if family == "latent":
            used = F.concat(used, F.slice("features", 52, 6).cast("array<double>"))
        width = 12 + 6  # six columns follow the draws
        want = {r["i"]: r["f"] for r in rows.select("i", used.alias("f")).collect()}
        got = {r["i"]: r["features"] for r in classify.prepared(rows, cfg).collect()}
        assert {len(x) for x in got.values()} == {12 if family == "diffusion" else width}
        assert got == want


def test_metrics_read_written_scores(spark, small, tmp_path):
    from dataclasses import replace

    audit = Audit(_samples(spark, small), f"file://{tmp_path}/audit", replace(CFG, train_shadows=2, holdout_shadows=1))
    files = audit.metrics("real", "real").inputFiles()
    assert files and all("/scores-" in f for f in files)
    assert all("/prepared-" in f for f in audit.scores("real", "real").inputFiles())


def test_many_rows_are_not_broadcast(spark, small):
    from privaudit.plans import queries

    for query in (queries.shadow_stats_orders, queries.member_rows):
        assert "BroadcastHashJoin" not in query(spark, small)._jdf.queryExecution().executedPlan().toString()


def test_diagonal_losses_of_odd_rows(spark, small, tmp_path):
    from privaudit.plans import queries

    x, i = F.col("embedding"), F.col("vec_id")
    odd = F.when(i == 3, F.lit(None)).when(i == 9, F.array_append(F.slice(x, 1, 63), F.lit(None).cast("float"))).otherwise(x)
    spark.read.parquet(f"{small}/embeddings.parquet").withColumn("embedding", odd).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    losses = queries._diag_losses(spark, f"file://{tmp_path}")
    plan = losses._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan  # one scan, no lambda over each cell
    at = losses.where("loss is not null").groupBy("sample_id").count().collect()
    assert {r["count"] for r in at} == {60} and {r["sample_id"] for r in at} == {r["sample_id"] for r in _samples(spark, small).collect()} - {"3", "9"}
