"""The audit operators' queries over the tables of one folder, and their DuckDB forms.

``embeddings`` stands for the sample matrix, ``orders`` and ``lineitem`` for
large id sets, cells and score tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from privaudit.config import AuditConfig
from privaudit.functions import arrays, noise, normal
from privaudit.operators import features as feats
from privaudit.operators import labels, metrics, scaler, splits, statistics
from privaudit.plans.shadows import FAMILIES, generate_class
from privaudit.sources import matrix, splits_io, stages

SPLITS, SEED, RATIO = [1, 2, 3, 4, 5], 42, 0.8
LEVELS, DRAWS = (5, 10, 20), 4
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return matrix.from_embeddings(_table(spark, d, "embeddings"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders").withColumn("sample_id", F.col("o_orderkey").cast("string"))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(_samples(spark, d), SPLITS, RATIO, SEED)


# ---- splits


def split_assign(spark, d):
    return _assigned(spark, d)


def split_assign_orders(spark, d):
    return splits.assign(_orders(spark, d), [1, 2, 3], RATIO, SEED)


def membership_counts(spark, d):
    return splits.counts(splits.assign(_orders(spark, d), SPLITS, RATIO, SEED), "split_no")


def membership_flags(spark, d):
    return splits.membership(_samples(spark, d), _assigned(spark, d))


def member_rows(spark, d):
    orders = _orders(spark, d)
    return splits.members(orders, splits.assign(orders, [1], RATIO, SEED), 1).select("o_orderkey", "o_totalprice")


def nonmember_fold_rows(spark, d):
    orders = _orders(spark, d)
    test = splits.assign(orders, [2], RATIO, SEED).where("not is_member")
    return splits.outside(orders, test).select("o_orderkey", "o_totalprice")


def missing_splits(spark, d):
    required = spark.range(1, 31).select(F.col("id").cast("int").alias("split_no"))
    present = _table(spark, d, "orders").select((F.col("o_custkey") % 25 + 1).cast("int").alias("split_no"))
    return splits.missing(required, present)


def split_role_counts(spark, d):
    return splits.counts(_assigned(spark, d).join(splits.roles(spark, 4, 1), "split_no"), "split_no", "role")


def cap_splits(spark, d):
    present = _table(spark, d, "embeddings").select((F.col("label") + 1).alias("split_no"))
    return splits.capped_roles(present, 15, 5)


def splits_json(spark, d):
    return splits_io.from_json(splits_io.to_json(_assigned(spark, d)))


# ---- matrix forms and labels


def cells_long(spark, d):
    return matrix.cells(_samples(spark, d))


def matrix_from_long(spark, d):
    back = matrix.wide(matrix.cells(_samples(spark, d)))
    x = F.transform("features", lambda v: v.cast("double"))
    return back.select("sample_id", F.size("features").alias("n"), F.get(x, F.lit(0)).alias("first"), F.get(x, F.size(x) - 1).alias("last"), F.round(arrays.total(x), 6).alias("total"))


def label_encode(spark, d):
    return labels.encode(_orders(spark, d), labels.class_list(PRIORITIES, spark), "o_orderpriority").select("o_orderkey", "o_orderpriority", "label_idx")


def one_hot_codes(spark, d):
    coded = labels.encode(_orders(spark, d), labels.class_list(STATUSES, spark), "o_orderstatus")
    code = arrays.one_hot(F.col("label_idx"), 3)
    return coded.select("o_orderkey", F.get(code, F.lit(0)).alias("is_f"), F.get(code, F.lit(1)).alias("is_o"), F.get(code, F.lit(2)).alias("is_p"), arrays.decode_one_hot(code).alias("label_idx"))


def positional_join(spark, d):
    tags = _table(spark, d, "labels").select("doc_id", "quality", "toxic")
    documents = _table(spark, d, "documents").select("doc_id", "n_chars").join(tags.select("doc_id"), "doc_id", "left_semi")
    left, right = labels.with_ordinal(documents, "doc_id"), labels.with_ordinal(tags.withColumnRenamed("doc_id", "tag_id"), "tag_id")
    return labels.positional(left, right).select("ordinal", "doc_id", "n_chars", "quality", "toxic")


def _sides(spark, d):
    samples = _samples(spark, d)
    chosen = splits.assign(samples, [1], RATIO, SEED).select("sample_id", "is_member")
    both = samples.join(chosen, "sample_id")
    reference = both.where("not is_member").select(F.col("ordinal").alias("ref_id"), "features", F.col("label").alias("y_label"))
    return both.where("is_member").select("sample_id", "features"), reference


def knn_neighbours(spark, d):
    asked, reference = _sides(spark, d)
    found = labels.nearest(asked, reference.select("ref_id", "features"), 5)
    return found.select("sample_id", "rank", "ref_id", F.round("distance", 9).alias("distance"))


def knn_labels(spark, d):
    asked, reference = _sides(spark, d)
    return asked.transform(labels.knn_labels(reference, 5)).select("sample_id", "y_label")


def constant_labels(spark, d):
    return labels.constant(_samples(spark, d)).groupBy("y_label").count().withColumnRenamed("count", "n")


# ---- files


def _columns(spark, d):
    """Samples as one text column a feature, in id order, and the features' names."""
    samples = _samples(spark, d)
    names = [f"G{i}" for i in range(samples.select(F.max(F.size("features"))).first()[0])]
    return samples.select("sample_id", "ordinal", *(F.get("features", F.lit(i)).cast("string").alias(g) for i, g in enumerate(names))), names


def matrix_tsv(spark, d):
    """The samples written as a genes x samples TSV and read back."""
    path = stages.shared_path(spark, "matrix")
    cell = F.struct("ordinal", F.col("sample_id").alias("id"), F.col("value").cast("float").cast("string").alias("v"))
    lines = matrix.cells(_samples(spark, d).drop("label")).join(_samples(spark, d).select("sample_id", "ordinal"), "sample_id")
    lines = lines.groupBy("gene_idx").agg(F.sort_array(F.collect_list(cell)).alias("c"))  # a line of the file
    line = lambda of, first: F.concat_ws("\t", first, F.transform("c", lambda x: x[of]))
    head = lines.where("gene_idx = 0").select(F.lit(-1).alias("gene_idx"), line("id", F.lit("gene")).alias("value"))
    body = lines.select("gene_idx", line("v", F.concat(F.lit("G"), F.col("gene_idx").cast("string"))).alias("value"))
    head.union(body).orderBy("gene_idx").coalesce(1).select("value").write.text(path)
    samples, genes = matrix.read_matrix(spark, path)
    x = F.transform("features", lambda v: v.cast("double"))
    return samples.select("sample_id", F.dense_rank().over(Window.orderBy("ordinal")).alias("place"), F.lit(len(genes)).alias("genes"), F.round(arrays.total(x), 5).alias("total"), F.round(F.get(x, F.lit(3)), 6).alias("fourth"))


def released_csv(spark, d):
    """The samples written as CSV files and labels as others, and read back row by row, columns in another order."""
    rows, names = _columns(spark, d)
    data, tags = stages.shared_path(spark, "released"), stages.shared_path(spark, "tags")
    rows.orderBy("ordinal").drop("sample_id", "ordinal").write.csv(data, header=True)
    _samples(spark, d).orderBy("ordinal").select("sample_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("label")).coalesce(1).write.csv(tags, header=True)
    found = matrix.read_labelled(spark, data, tags, names[::-1])
    return found.select("row_id", "label", F.round(F.get("features", F.lit(0)).cast("double"), 6).alias("last"), F.round(F.get("features", F.lit(len(names) - 1)).cast("double"), 6).alias("first"))


def labels_csv(spark, d):
    """Labels written with another column before them, read by name and coded."""
    path = stages.shared_path(spark, "labels")
    orders = _orders(spark, d).select("sample_id", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    orders.write.csv(path, header=True)
    read = matrix.read_labels(spark, path, "priority")
    return labels.encode(read, labels.class_list(PRIORITIES, spark)).groupBy("label", "label_idx").count().withColumnRenamed("count", "n")


def predictions_csv(spark, d):
    """Scores written in input order, read back as lines."""
    path = stages.shared_path(spark, "predictions")
    orders = _orders(spark, d)
    scores = orders.select("sample_id", F.col("o_orderkey").alias("ordinal"), (F.col("o_custkey") % 1000 / F.lit(1000.0)).alias("score"))
    matrix.write_predictions(scores, path)
    lines = spark.read.csv(path, schema="sample_id string, score double").where("sample_id <> 'sample_id'")
    return lines.select("sample_id", F.round("score", 6).alias("score"))


# ---- quantile normaliser


def _priced(spark, d):
    lines = _table(spark, d, "lineitem")
    return lines.unpivot([], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "gene", "value")


def quantile_fit(spark, d):
    fitted = scaler.fit(_priced(spark, d), ["gene"], 1000)
    return fitted.select("gene", F.posexplode("quantiles").alias("i", "q")).select("gene", "i", F.round("q", 7).alias("q"))


def _scaled_cells(spark, d):
    samples = _samples(spark, d)
    own = splits.members(samples, splits.assign(samples, [1], RATIO, SEED), 1)
    fitted = scaler.fit(matrix.cells(own), ["gene_idx"], own.count())
    return matrix.cells(samples).join(fitted, "gene_idx")


def quantile_uniform(spark, d):
    return _scaled_cells(spark, d).select("sample_id", "gene_idx", F.round(scaler.uniform(F.col("value"), F.col("quantiles")), 9).alias("u"))


def quantile_normal(spark, d):
    return _scaled_cells(spark, d).select("sample_id", "gene_idx", F.round(scaler.normal(F.col("value"), F.col("quantiles")), 6).alias("z"))


def quantile_round_trip(spark, d):
    """Members' values after transform and inverse, summed, and the largest difference."""
    samples = _samples(spark, d)
    own = splits.members(samples, splits.assign(samples, [1], RATIO, SEED), 1).select("sample_id", "features")
    Q = scaler.quantile_matrix(scaler.fit(matrix.cells(own), ["gene_idx"], own.count()))
    back = scaler.apply_rows(scaler.apply_rows(own, Q), Q, inverse=True).withColumnRenamed("features", "back")
    gap = F.array_max(F.zip_with("features", "back", lambda a, b: F.abs(a.cast("double") - b)))
    total = F.round(arrays.total(F.transform("back", lambda x: F.round(x, 4))), 2)
    return own.join(back, "sample_id").select("sample_id", (gap < 1e-4).alias("restored"), total.alias("total"))


# ---- noise, shadows, losses


def forward_diffuse(spark, d):
    rows, out = matrix.cells(_samples(spark, d)), None
    alphas = noise.alpha_bar()
    for t in LEVELS:
        a = float(alphas[t])
        x = F.lit(math.sqrt(a)) * F.col("value") + F.lit(math.sqrt(1 - a)) * noise.normal(SEED, F.lit(0), F.col("gene_idx"))
        part = rows.groupBy("sample_id").agg(F.round(F.sum(x * x), 6).alias("energy")).select("sample_id", F.lit(t).alias("level"), "energy")
        out = part if out is None else out.union(part)
    return out


def _member_cells(spark, d):
    return matrix.cells(_samples(spark, d)).join(_assigned(spark, d).where("is_member").select("split_no", "sample_id"), "sample_id")


def shadow_stats_diag(spark, d):
    stats = statistics.diagonal(_member_cells(spark, d), ["split_no", "gene_idx"])
    return stats.select("split_no", "gene_idx", "n", F.round("mean", 9).alias("mean"), F.round("var", 9).alias("var"))


def shadow_stats_orders(spark, d):
    orders = _orders(spark, d)
    chosen = splits.assign(orders, [1, 2, 3], RATIO, SEED).where("is_member")
    # chosen has a row for each order and split: too many to broadcast
    cells = orders.join(chosen.hint("merge"), "sample_id").select("split_no", "o_orderstatus", F.col("o_totalprice").alias("value"))
    stats = statistics.diagonal(cells, ["split_no", "o_orderstatus"])
    return stats.select("split_no", "o_orderstatus", "n", F.round("mean", 2).alias("mean"), F.round(F.col("var") / 1e6, 2).alias("var_millions"))


def _diag_scored(plan: list):
    """Losses of every row for each (split, level, draw), added up gene by gene as a sum over an array is; null for rows with nulls or of another width."""
    columns = [(r, np.array([(s["mean"], s["var"]) for s in r["s"]], float).reshape(-1, 2), np.array(r["e"] or [], float)) for r in plan]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lists = batch.column(1)
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                holes = np.add.reduceat(np.append(pc.is_null(pc.list_flatten(lists)).to_numpy(zero_copy_only=False).astype(int), 0), np.cumsum(lengths) - lengths) * (lengths > 0)
                for width in {len(m) for _, m, _ in columns}:
                    own = np.flatnonzero((lengths == width) & (holes == 0))
                    X = np.ascontiguousarray(statistics.wide_matrix(lists.take(pa.array(own))).T).reshape(width, len(own))
                    for r, stats, e in columns:
                        if len(stats) != width:
                            continue
                        loss, known = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
                        if len(e) == width:
                            total, a, v = np.zeros(len(own)), r["a"], stats[:, 1]
                            for t in (math.sqrt(a * (1 - a)) * (X - stats[:, :1]) - (a * v * e)[:, None]) / (a * v + 1 - a)[:, None]:
                                total += t * t
                            loss[own], known[own] = total / width, True
                        ids = [pa.array(np.full(batch.num_rows, r[c]), pa.int32()) for c in ("split_no", "level_idx", "noise_idx")]
                        yield pa.RecordBatch.from_arrays([ids[0], batch.column(0), *ids[1:], pa.array(loss, pa.float64(), mask=~known)], names=["split_no", "sample_id", "level_idx", "noise_idx", "loss"])

    return run


def _diag_losses(spark, d):
    """Losses under independent Gaussians: per-split means and variances as arrays, every row under each split, level and draw in one scan."""
    stats = statistics.diagonal(_member_cells(spark, d), ["split_no", "gene_idx"])
    per_split = stats.groupBy("split_no").agg(F.sort_array(F.collect_list(F.struct("gene_idx", "mean", "var"))).alias("s"))
    cells = _samples(spark, d).select("sample_id", F.col("features").cast("array<double>").alias("x"))
    bank = spark.range(DRAWS).select(F.col("id").cast("int").alias("noise_idx")).join(_samples(spark, d).select(F.size("features").alias("width")).distinct())
    bank = bank.select("noise_idx", F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda g: noise.normal(SEED, F.col("noise_idx"), g)).alias("e"))
    alphas = noise.alpha_bar()
    levels = spark.createDataFrame([(i, float(alphas[t])) for i, t in enumerate(LEVELS)], "level_idx int, a double")
    plan = per_split.crossJoin(bank).crossJoin(levels).collect()  # splits x draws x levels: 60 rows
    return cells.mapInArrow(_diag_scored(plan), "split_no int, sample_id string, level_idx int, noise_idx int, loss double")


def diffusion_losses_diag(spark, d):
    return _diag_losses(spark, d).withColumn("loss", F.round("loss", 9))


def loss_summary(spark, d):
    found = feats.summarise(_diag_losses(spark, d), ["split_no", "sample_id"])
    return found.select("split_no", "sample_id", "level_idx", *(F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")))


def _diag_arrays(spark, d):
    losses = _diag_losses(spark, d)
    ordered = F.sort_array(F.collect_list(F.struct("level_idx", "noise_idx", "loss")))
    return losses.groupBy("split_no", "sample_id").agg(F.transform(ordered, lambda x: x["loss"]).alias("features"))


def loss_summary_array(spark, d):
    """The same summary from level-major arrays."""
    four = arrays.summaries(F.col("features"), len(LEVELS), DRAWS)
    rows = _diag_arrays(spark, d).select("split_no", "sample_id", four.alias("f"))
    at = lambda i: F.round(F.get("f", F.col("level_idx") * 4 + i), 6)
    return rows.select("*", F.explode(F.array(*(F.lit(i) for i in range(len(LEVELS))))).alias("level_idx")).select("split_no", "sample_id", "level_idx", at(0).alias("mean"), at(1).alias("std"), at(2).alias("min"), at(3).alias("max"))


def losses_long(spark, d):
    back = feats.explode_losses(_diag_arrays(spark, d), DRAWS, ["split_no", "sample_id"])
    return back.withColumn("loss", F.round("loss", 9))


def latent_kl_diag(spark, d):
    """Divergence and its mean over rows for codes with each split's z-scores as means, variances as they are."""
    stats = statistics.diagonal(_member_cells(spark, d), ["split_no", "gene_idx"])
    cells = matrix.cells(_samples(spark, d)).join(stats, "gene_idx")
    rows = cells.groupBy("split_no", "sample_id").agg(F.sort_array(F.collect_list(F.struct("gene_idx", ((F.col("value") - F.col("mean")) / F.sqrt("var")).alias("m"), F.log("var").alias("v")))).alias("c"))
    kl = arrays.kl_terms(F.transform("c", lambda c: c["m"]), F.transform("c", lambda c: c["v"]))
    return rows.select("split_no", "sample_id", F.round(arrays.total(kl), 6).alias("kl"))


def elbo_by_split(spark, d):
    return latent_kl_diag(spark, d).groupBy("split_no").agg(F.round(F.avg("kl"), 5).alias("mean_kl"))


def output_transforms(spark, d):
    x = F.col("features").cast("array<double>")
    return _samples(spark, d).select("sample_id", *(F.round(arrays.total(arrays.output_transform(x, k)), 6).alias(f"{k}_sum") for k in ("none", "exp", "sigmoid", "relu")))


def stale_features(spark, d):
    rows = _samples(spark, d).select("sample_id", F.slice("features", F.lit(1), F.lit(60) + F.col("label") % 5).alias("features"))
    return feats.stale(rows, 63).select("sample_id", F.size("features").alias("width"))


_CFG = AuditConfig(levels=LEVELS, draws=10, train_shadows=4, holdout_shadows=2, scale=False, rf={"numTrees": 100, "maxDepth": 8, "featureSubsetStrategy": "sqrt", "minInstancesPerNode": 20, "subsamplingRate": 0.7})


def _member_rows(spark, d, label=None):
    chosen = splits.assign(_samples(spark, d), _CFG.splits, RATIO, SEED).where("is_member").select("split_no", "sample_id")
    return _samples(spark, d).join(chosen, "sample_id").select("split_no", "sample_id", (label if label is not None else F.lit(0)).alias("label_idx"), "features")


def shadow_spectrum(spark, d):
    fitted = statistics.spectrum(_member_rows(spark, d))
    return fitted.select("split_no", "n", F.round(F.get("eigvals", F.lit(0)), 6).alias("largest"), F.round(arrays.total(F.col("eigvals")), 6).alias("trace"))


def shadow_forms(spark, d):
    """The spectrum's trace, and its quadratic forms onto the sum and the difference of neighbouring columns."""
    fitted = statistics.spectrum(_member_rows(spark, d))
    places = F.sequence(F.lit(0), F.size("eigvals") - 1)
    # component i of vector k stands at i * size + k
    along = lambda sign: arrays.total(F.transform("eigvals", lambda v, k: v * F.pow(arrays.total(F.transform(places, lambda i: sign(i) * F.get("eigvecs", i * F.size("eigvals") + k))), F.lit(2.0))))
    both = along(lambda i: F.lit(1.0)), along(lambda i: F.when(i % 2 == 0, 1.0).otherwise(-1.0))
    return fitted.select("split_no", "n", F.round(arrays.total(F.col("eigvals")), 6).alias("trace"), F.round(both[0], 6).alias("sum_form"), F.round(both[1], 6).alias("difference_form"))


def diffusion_losses_full(spark, d):
    family = FAMILIES["diffusion"]
    return family.losses(family.fit(_member_rows(spark, d), 1e-6), _samples(spark, d), _CFG)


def latent_losses(spark, d):
    family = FAMILIES["latent"]
    params = family.fit(_member_rows(spark, d, F.col("label")), 1e-6)
    return family.losses(params, _samples(spark, d).withColumnRenamed("label", "label_idx"), _CFG)


def generate_latent(spark, d):
    family, members = FAMILIES["latent"], _member_rows(spark, d, F.col("label"))
    return family.generate(family.fit(members, 1e-6), members.withColumnRenamed("sample_id", "row_id"), _CFG)


def generate_diffusion(spark, d):
    family, members = FAMILIES["diffusion"], _member_rows(spark, d)
    return family.generate(family.fit(members, 1e-6), members.withColumnRenamed("sample_id", "row_id"), _CFG)


def generate_one_class(spark, d):
    family, members = FAMILIES["latent"], _member_rows(spark, d, F.col("label"))
    n = members.where("split_no = 1 and label_idx = 3").count()
    return generate_class(family, family.fit(members, 1e-6), 1, 3, n, _CFG)


# ---- metrics


def _order_scores(spark, d):
    return _orders(spark, d).select(
        F.when(F.col("o_orderstatus") == "P", "synth").otherwise("real").alias("trained_on"),
        F.when(F.col("o_custkey") % 2 == 1, "real").otherwise("synth").alias("source"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("split_no"),
        "sample_id",
        F.round(F.col("o_totalprice") / F.lit(600000.0), 3).alias("score"),
        (F.col("o_orderkey") % 3 == 0).cast("int").alias("y"),
    )


_KEYS = ["trained_on", "source", "split_no"]


def score_accuracy(spark, d):
    return metrics.accuracy(_order_scores(spark, d), _KEYS).withColumn("acc", F.round("acc", 9))


def score_auc(spark, d):
    return metrics.auc(_order_scores(spark, d), _KEYS).withColumn("auc", F.round("auc", 9))


def tpr_at_fpr(spark, d):
    return metrics.tpr_at_fpr(_order_scores(spark, d), _KEYS).withColumn("tpr_at_fpr", F.round("tpr_at_fpr", 9))


def lineitem_auc(spark, d):
    """One million-row style group: the two-phase running counts at scale."""
    lines = _table(spark, d, "lineitem").select(F.lit(1).alias("split_no"), F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return metrics.auc(lines, ["split_no"]).withColumn("auc", F.round("auc", 9))


def _metrics(spark, d):
    return metrics.evaluate(_order_scores(spark, d), _KEYS)


def eval_report(spark, d):
    found = metrics.report(_metrics(spark, d))
    return found.select(*_KEYS, *(F.round(c, 9).alias(c) for c in ("auc", "tpr_at_fpr", "acc")))


def domain_gap(spark, d):
    found = metrics.domain_gap(_metrics(spark, d))
    return found.select("trained_on", F.round("auc_gap", 9).alias("auc_gap"), F.round("tpr_at_fpr_gap", 9).alias("tpr_at_fpr_gap"))


def best_checkpoint(spark, d):
    steps = _orders(spark, d).groupBy("o_orderpriority", (F.col("o_custkey") % 12).cast("int").alias("step")).agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 2).alias("tpr"))
    return metrics.best_step(steps, ["o_orderpriority"]).select("o_orderpriority", "step", "tpr")


def audit_minimal(spark, d):
    """Splits, diagonal shadows, losses, score, metrics per split."""
    losses = _diag_losses(spark, d).groupBy("split_no", "sample_id").agg(F.round(-F.avg("loss"), 9).alias("score"))
    truth = _assigned(spark, d).select("split_no", "sample_id", F.col("is_member").cast("int").alias("y"))
    scores = stages.written(losses.join(truth, ["split_no", "sample_id"]), "scores")
    found = metrics.auc(scores, ["split_no"]).join(metrics.tpr_at_fpr(scores, ["split_no"]), "split_no")
    return found.select("split_no", F.round("auc", 9).alias("auc"), F.round("tpr_at_fpr", 9).alias("tpr_at_fpr"))


def audit_full(spark, d):
    """The same with full covariances: shadows, expected losses, score, metrics per split."""
    losses = diffusion_losses_full(spark, d).select("split_no", "sample_id", (-arrays.total(F.col("features"))).alias("score"))
    truth = splits.assign(_samples(spark, d), _CFG.splits, RATIO, SEED).select("split_no", "sample_id", F.col("is_member").cast("int").alias("y"))
    scores = stages.written(losses.join(truth, ["split_no", "sample_id"]), "scores")
    return metrics.auc(scores, ["split_no"]).join(metrics.tpr_at_fpr(scores, ["split_no"]), "split_no")


_TWO = AuditConfig(levels=LEVELS, draws=DRAWS, train_shadows=4, holdout_shadows=1, scale=False, temperatures=(0.0,), latent_dim=1, family="diffusion")


def _two(spark, d):
    """Samples with two columns, the sums of the even and of the odd ones: a covariance that SQL can invert."""
    x = F.col("features").cast("array<double>")
    side = lambda k: arrays.total(F.filter(x, lambda _, i: i % 2 == k))
    return _samples(spark, d).withColumn("features", F.array(side(0), side(1)))


def _two_fitted(spark, d, family, label):
    chosen = splits.assign(_samples(spark, d), SPLITS, RATIO, SEED).where("is_member").groupBy("sample_id").agg(F.collect_list("split_no").alias("splits"))
    members = _two(spark, d).join(chosen, "sample_id").select("splits", label.alias("label_idx"), "features")
    return family.fit(members, 1e-6)


def diffusion_losses_two(spark, d):
    """Losses under full covariances, all splits in one scan."""
    family = FAMILIES["diffusion"]
    losses = family.losses(_two_fitted(spark, d, family, F.lit(0)), _two(spark, d), _TWO)
    return feats.explode_losses(losses, DRAWS, ["split_no", "sample_id"]).withColumn("loss", F.round("loss", 4))


def latent_losses_two(spark, d):
    """Reconstruction losses without noise, and divergences, under class means and a pooled full covariance."""
    family = FAMILIES["latent"]
    params = _two_fitted(spark, d, family, F.col("label"))
    found = family.losses(params, _two(spark, d).withColumnRenamed("label", "label_idx"), replace(_TWO, family="latent", draws=1))
    at = lambda i: F.round(F.get("features", F.lit(i)).cast("double"), 4)
    return found.select("split_no", "sample_id", at(0).alias("loss"), at(1).alias("kl"))


def audit_two(spark, d):
    """Splits, full-covariance shadows, losses, score, metrics per split."""
    losses = diffusion_losses_two(spark, d).groupBy("split_no", "sample_id").agg(F.round(-F.avg("loss"), 6).alias("score"))
    truth = _assigned(spark, d).select("split_no", "sample_id", F.col("is_member").cast("int").alias("y"))
    scores = stages.written(losses.join(truth, ["split_no", "sample_id"]), "scores")
    found = metrics.auc(scores, ["split_no"]).join(metrics.tpr_at_fpr(scores, ["split_no"]), "split_no")
    return found.select("split_no", F.round("auc", 9).alias("auc"), F.round("tpr_at_fpr", 9).alias("tpr_at_fpr"))


# ---- classifiers and the whole audit


def audit_defaults(spark, d):
    """The whole audit with the settings a user gets who sets none: 7 levels, 50 draws, quantile scaling, 500 trees."""
    from privaudit.plans.audit import Audit

    return Audit(_samples(spark, d), stages.shared_path(spark, "run"), AuditConfig()).metrics("real", "real")


def _audit(spark, d, **changes):
    from privaudit.plans.audit import Audit

    return Audit(_samples(spark, d).withColumnRenamed("label", "label_idx"), stages.shared_path(spark, "run"), replace(_CFG, **changes))


def rf_scores(spark, d):
    return _audit(spark, d).metrics("real", "real")


def mlp_scores(spark, d):
    return _audit(spark, d, classifier="mlp", rounds=3).metrics("real", "real")


def latent_audit(spark, d):
    return _audit(spark, d, family="latent", label_mode="real").metrics("real", "real", holdout_only=False)


def audit_gap(spark, d):
    return _audit(spark, d, scale=True, train_shadows=2, holdout_shadows=1).domain_gap()


def released_scores(spark, d):
    audit = _audit(spark, d, train_shadows=2, holdout_shadows=1)
    released = audit.synthetic().where("split_no = 3").select("row_id", "features")
    return audit.score_released(released, trained_on="real").select("sample_id", "score")


_ALL = (
    split_assign, split_assign_orders, membership_counts, membership_flags, member_rows, nonmember_fold_rows, missing_splits, split_role_counts, cap_splits, splits_json,
    cells_long, matrix_from_long, label_encode, one_hot_codes, positional_join, knn_neighbours, knn_labels, constant_labels,
    matrix_tsv, released_csv, labels_csv, predictions_csv,
    quantile_fit, quantile_uniform, quantile_normal, quantile_round_trip,
    forward_diffuse, shadow_stats_diag, shadow_stats_orders, diffusion_losses_diag, loss_summary, loss_summary_array, losses_long, latent_kl_diag, elbo_by_split, output_transforms, stale_features,
    shadow_spectrum, shadow_forms, diffusion_losses_full, latent_losses, generate_latent, generate_diffusion, generate_one_class,
    score_accuracy, score_auc, tpr_at_fpr, lineitem_auc, eval_report, domain_gap, best_checkpoint, audit_minimal, audit_full,
    diffusion_losses_two, latent_losses_two, audit_two,
    rf_scores, mlp_scores, latent_audit, audit_gap, released_scores, audit_defaults,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


# ---- DuckDB

_S = "s AS (SELECT vec_id::VARCHAR AS sample_id, vec_id, embedding, label FROM embeddings)"


def _split_cte(name: str, source: str, numbers: list[int]) -> str:
    return (
        f"{name} AS (SELECT split_no, sample_id, row_number() OVER (PARTITION BY split_no ORDER BY md5(concat({SEED} + split_no, ':', sample_id)), sample_id)"
        f" <= floor(count(*) OVER (PARTITION BY split_no) * {RATIO}e0) AS is_member FROM {source}, (SELECT unnest({numbers})::INT AS split_no))"
    )


_O = "o AS (SELECT *, o_orderkey::VARCHAR AS sample_id FROM orders)"
_CELLS = "cells AS (SELECT sample_id, unnest(range(len(embedding)))::INT AS gene_idx, unnest(embedding)::DOUBLE AS value FROM s)"
_SP = _split_cte("sp", "s", SPLITS)
_STATS = "stats AS (SELECT split_no, gene_idx, count(*) AS n, avg(value) AS mean, greatest(var_pop(value), 1e-6) AS var FROM cells JOIN sp USING (sample_id) WHERE is_member GROUP BY ALL)"
_ALPHA = f"alpha AS (SELECT t, exp(sum(ln(1e0 - (0.001e0 + t * 0.019e0 / 999))) OVER (ORDER BY t)) AS a FROM (SELECT range AS t FROM range({noise.STEPS})))"


def _hash_normal(*keys: str) -> str:
    text = "concat_ws(':', '42', " + ", ".join(f"{k}::VARCHAR" for k in keys) + ")"
    u = lambda k: f"((('0x' || substr(md5(concat({text}, ':{k}')), 1, 13))::BIGINT + 0.5e0) / 4503599627370496e0)"
    return f"(sqrt(-2e0 * ln({u(1)})) * cos(2 * pi() * {u(2)}))"


_LOSSES = (
    f"lv AS (SELECT (row_number() OVER (ORDER BY t) - 1)::INT AS level_idx, a FROM alpha WHERE t IN {LEVELS}), "
    f"bank AS (SELECT n::INT AS noise_idx, g AS gene_idx, {_hash_normal('n', 'g')} AS e FROM (SELECT range AS n FROM range({DRAWS})), (SELECT DISTINCT gene_idx AS g FROM cells)), "
    "losses AS (SELECT split_no, sample_id, level_idx, noise_idx, avg(pow((sqrt(a * (1 - a)) * (value - mean) - a * var * e) / (a * var + 1 - a), 2)) AS loss "
    "FROM cells JOIN stats USING (gene_idx) JOIN bank USING (gene_idx), lv GROUP BY ALL)"
)
_LOSS_CTES = f"WITH {_S}, {_SP}, {_CELLS}, {_STATS}, {_ALPHA}, {_LOSSES} "
_TWO_ROWS = "x AS (SELECT sample_id, label, list_sum(list_filter(embedding::DOUBLE[], lambda v, i: i % 2 = 1)) AS p, list_sum(list_filter(embedding::DOUBLE[], lambda v, i: i % 2 = 0)) AS q FROM s)"
_TWO_LOSSES = (
    f"WITH {_S}, {_SP}, {_TWO_ROWS}, {_ALPHA}, "
    "g AS (SELECT split_no, avg(p) AS mp, avg(q) AS mq, var_pop(p) AS pp, var_pop(q) AS qq, covar_pop(p, q) AS pq FROM x JOIN sp USING (sample_id) WHERE is_member GROUP BY split_no), "
    f"lv AS (SELECT (row_number() OVER (ORDER BY t) - 1)::INT AS level_idx, a FROM alpha WHERE t IN {LEVELS}), "
    f"bank AS (SELECT n::INT AS noise_idx, {_hash_normal('n', '0')} AS e, {_hash_normal('n', '1')} AS f FROM (SELECT range AS n FROM range({DRAWS}))), "
    # u is what the inverse of a S + (1 - a) I meets
    "u AS (SELECT split_no, sample_id, level_idx, noise_idx, a * pp + 1 - a AS m1, a * qq + 1 - a AS m2, a * pq AS m12, "
    "sqrt(a * (1 - a)) * (p - mp) - a * (pp * e + pq * f) AS u1, sqrt(a * (1 - a)) * (q - mq) - a * (pq * e + qq * f) AS u2 FROM x, g, lv, bank), "
    "losses AS (SELECT split_no, sample_id, level_idx, noise_idx, round(((pow(m2 * u1 - m12 * u2, 2) + pow(m1 * u2 - m12 * u1, 2)) / pow(m1 * m2 - m12 * m12, 2) / 2)::FLOAT::DOUBLE, 4) AS loss FROM u) "
)
_TWO_LATENT = (
    f"WITH {_S}, {_SP}, {_TWO_ROWS}, m AS (SELECT split_no, label, avg(p) AS mp, avg(q) AS mq FROM x JOIN sp USING (sample_id) WHERE is_member GROUP BY ALL), "
    "w AS (SELECT split_no, avg(pow(p - mp, 2)) AS pp, avg(pow(q - mq, 2)) AS qq, avg((p - mp) * (q - mq)) AS pq FROM x JOIN sp USING (sample_id) JOIN m USING (split_no, label) WHERE is_member GROUP BY split_no), "
    "v AS (SELECT *, (pp + qq) / 2 + sqrt(pow((pp - qq) / 2, 2) + pq * pq) AS big, (pp + qq) / 2 - sqrt(pow((pp - qq) / 2, 2) + pq * pq) AS small FROM w), "
    "r AS (SELECT v.split_no, sample_id, big, small, pow(p - mp, 2) + pow(q - mq, 2) AS far, pow((big - qq) * (p - mp) + pq * (q - mq), 2) / (pow(big - qq, 2) + pq * pq) AS along FROM x JOIN m USING (label) JOIN v USING (split_no)) "
    "SELECT split_no, sample_id, round(((far - along + along * pow(1 - (big - small) / big, 2)) / 2)::FLOAT::DOUBLE, 4) AS loss, "
    "round((-0.5e0 * (1 + ln(small / big) - along * (big - small) / (big * big) - small / big))::FLOAT::DOUBLE, 4) AS kl FROM r"
)
_SIDES = f"WITH {_S}, {_split_cte('sp', 's', [1])}, q AS (SELECT s.* FROM s JOIN sp USING (sample_id) WHERE is_member), r AS (SELECT s.* FROM s JOIN sp USING (sample_id) WHERE NOT is_member), "
_NEAR = (
    "pairs AS (SELECT q.sample_id, r.vec_id AS ref_id, r.label, sqrt(list_sum(list_transform(list_zip(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance FROM q, r), "
    "near AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY distance, ref_id)::INT AS rank FROM pairs QUALIFY rank <= 5) "
)
_QUANTILES = (
    f"WITH {_S}, {_split_cte('sp', 's', [1])}, {_CELLS}, k AS (SELECT least(1000, count(*)) AS k FROM sp WHERE is_member), "
    "fitted AS (SELECT gene_idx, list_sort(list(value)) AS q FROM cells JOIN sp USING (sample_id) WHERE is_member GROUP BY gene_idx), "
    "lev AS (SELECT i / (k - 1)::DOUBLE AS p, i FROM k, unnest(range(k)) AS u(i)), "
    "knots AS (SELECT gene_idx, list(q[1 + floor(p * (len(q) - 1))::INT] + (p * (len(q) - 1) - floor(p * (len(q) - 1))) * (q[least(len(q), 2 + floor(p * (len(q) - 1))::INT)] - q[1 + floor(p * (len(q) - 1))::INT]) ORDER BY i) AS q FROM fitted, lev GROUP BY gene_idx), "
    "u0 AS (SELECT sample_id, c.gene_idx, value, q, len(q) AS n, len(list_filter(q, lambda x: x <= value)) AS le, len(list_filter(q, lambda x: x < value)) AS lt FROM cells c JOIN knots USING (gene_idx)), "
    "u AS (SELECT sample_id, gene_idx, CASE WHEN value <= q[1] THEN 0e0 WHEN value >= q[n] THEN 1e0 WHEN le > lt THEN ((le - 1 + lt) / 2e0) / (n - 1) ELSE (le - 1 + (value - q[le]) / (q[le + 1] - q[le])) / (n - 1) END AS u FROM u0) "
)


def _poly(x: str, coefficients) -> str:
    out = f"{coefficients[-1]!r}::DOUBLE"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {float(c)!r}::DOUBLE)"
    return out


def _ppf_sql() -> str:
    n = normal
    tail = f"CASE WHEN r <= 5 THEN {_poly('(r - 1.6e0)', n.C)} / {_poly('(r - 1.6e0)', n.D)} ELSE {_poly('(r - 5e0)', n.E)} / {_poly('(r - 5e0)', n.F_)} END"
    return (
        _QUANTILES + f", p AS (SELECT sample_id, gene_idx, least(greatest(u, {1e-7 - 2.0**-52!r}::DOUBLE), {1 - (1e-7 - 2.0**-52)!r}::DOUBLE) AS p FROM u), "
        "pq AS (SELECT *, p - 0.5e0 AS q, sqrt(-ln(CASE WHEN p < 0.5e0 THEN p ELSE 1e0 - p END)) AS r, 0.180625e0 - (p - 0.5e0) * (p - 0.5e0) AS r0 FROM p) "
        f"SELECT sample_id, gene_idx, round(greatest(least(CASE WHEN abs(q) <= 0.425e0 THEN q * {_poly('r0', n.A)} / {_poly('r0', n.B)} WHEN q < 0 THEN -({tail}) ELSE {tail} END, {n.CLIP!r}::DOUBLE), -{n.CLIP!r}::DOUBLE), 6) AS z FROM pq"
    )


_SCORES = (
    "WITH sc AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'synth' ELSE 'real' END AS trained_on, CASE WHEN o_custkey % 2 = 1 THEN 'real' ELSE 'synth' END AS source, substr(o_orderpriority, 1, 1)::INT AS split_no, "
    "o_orderkey::VARCHAR AS sample_id, round(o_totalprice / 600000e0, 3) AS score, (o_orderkey % 3 = 0)::INT AS y FROM orders), "
)
_GROUPED = "PARTITION BY trained_on, source, split_no"
_MET = (
    f"rk AS (SELECT *, rank() OVER ({_GROUPED} ORDER BY score) + (count(*) OVER ({_GROUPED}, score) - 1) / 2e0 AS r, sum(y) OVER ({_GROUPED} ORDER BY score DESC, sample_id ROWS UNBOUNDED PRECEDING) AS tp, sum(1 - y) OVER ({_GROUPED} ORDER BY score DESC, sample_id ROWS UNBOUNDED PRECEDING) AS fp, "
    f"sum(y) OVER ({_GROUPED}) AS p, sum(1 - y) OVER ({_GROUPED}) AS n FROM sc), "
    "met AS (SELECT trained_on, source, split_no, CASE WHEN max(p) = 0 OR max(n) = 0 THEN 'nan'::DOUBLE ELSE (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - max(p) * (max(p) + 1) / 2e0) / (max(p)::DOUBLE * max(n)) END AS auc, "
    "coalesce(max(CASE WHEN n > 0 AND p > 0 AND fp / n::DOUBLE <= 0.1e0 THEN tp / p::DOUBLE END), 0e0) AS tpr_at_fpr, avg(((score > 0.5)::INT = y)::INT::DOUBLE) AS acc, sum(y)::BIGINT AS n_member, sum(1 - y)::BIGINT AS n_nonmember FROM rk GROUP BY ALL) "
)


_SPLIT_METRICS = (
    "rk AS (SELECT *, rank() OVER (PARTITION BY split_no ORDER BY score) + (count(*) OVER (PARTITION BY split_no, score) - 1) / 2e0 AS r, sum(y) OVER (PARTITION BY split_no ORDER BY score DESC, sample_id ROWS UNBOUNDED PRECEDING) AS tp, sum(1 - y) OVER (PARTITION BY split_no ORDER BY score DESC, sample_id ROWS UNBOUNDED PRECEDING) AS fp, sum(y) OVER (PARTITION BY split_no) AS p, sum(1 - y) OVER (PARTITION BY split_no) AS n FROM sc) "
    "SELECT split_no, round((sum(r) FILTER (WHERE y = 1) - max(p) * (max(p) + 1) / 2e0) / (max(p)::DOUBLE * max(n)), 9) AS auc, round(coalesce(max(CASE WHEN fp / n::DOUBLE <= 0.1e0 THEN tp / p::DOUBLE END), 0e0), 9) AS tpr_at_fpr FROM rk GROUP BY split_no"
)


def oracle_sql() -> dict[str, str]:
    summary = _LOSS_CTES + "SELECT split_no, sample_id, level_idx, round(avg(loss), 6) AS mean, round(stddev_pop(loss), 6) AS std, round(min(loss), 6) AS min, round(max(loss), 6) AS max FROM losses GROUP BY ALL"
    losses = _LOSS_CTES + "SELECT split_no, sample_id, level_idx, noise_idx, round(loss, 9) AS loss FROM losses"
    kl = f"WITH {_S}, {_SP}, {_CELLS}, {_STATS}, kl AS (SELECT split_no, sample_id, round(sum(-0.5e0 * (1 + ln(var) - pow((value - mean) / sqrt(var), 2) - var)), 6) AS kl FROM cells JOIN stats USING (gene_idx) GROUP BY ALL) "
    role = "CASE WHEN split_no <= greatest(1, floor({k} * 0.7e0)) THEN 'train' WHEN split_no <= {k} THEN 'val' ELSE 'holdout' END AS role"
    return {
        "split_assign": f"WITH {_S}, {_SP} SELECT * FROM sp",
        "split_assign_orders": f"WITH {_O}, {_split_cte('sp', 'o', [1, 2, 3])} SELECT * FROM sp",
        "membership_counts": f"WITH {_O}, {_split_cte('sp', 'o', SPLITS)} SELECT split_no, sum(is_member::INT)::BIGINT AS n_member, sum((NOT is_member)::INT)::BIGINT AS n_nonmember FROM sp GROUP BY split_no",
        "membership_flags": f"WITH {_S}, {_SP} SELECT split_no, sample_id, is_member::INT AS y_member FROM sp",
        "member_rows": f"WITH {_O}, {_split_cte('sp', 'o', [1])} SELECT o_orderkey, o_totalprice FROM o JOIN sp USING (sample_id) WHERE is_member",
        "nonmember_fold_rows": f"WITH {_O}, {_split_cte('sp', 'o', [2])} SELECT o_orderkey, o_totalprice FROM o WHERE sample_id NOT IN (SELECT sample_id FROM sp WHERE NOT is_member)",
        "missing_splits": "SELECT r::INT AS split_no FROM (SELECT unnest(range(1, 31)) AS r) WHERE r NOT IN (SELECT o_custkey % 25 + 1 FROM orders)",
        "split_role_counts": f"WITH {_S}, {_SP} SELECT split_no, {role.format(k=4)}, sum(is_member::INT)::BIGINT AS n_member, sum((NOT is_member)::INT)::BIGINT AS n_nonmember FROM sp GROUP BY ALL",
        "cap_splits": f"WITH p AS (SELECT DISTINCT (label + 1)::INT AS split_no FROM embeddings), c AS (SELECT CASE WHEN n >= 20 THEN 15 ELSE n - greatest(1, 5 - (20 - n)) END AS k, CASE WHEN n >= 20 THEN 5 ELSE greatest(1, 5 - (20 - n)) END AS q FROM (SELECT count(*) AS n FROM p)) SELECT split_no, {role.format(k='k')} FROM p, c WHERE split_no <= k + q",
        "splits_json": f"WITH {_S}, {_SP} SELECT 'custom' AS split_set, * FROM sp",
        "cells_long": f"WITH {_S}, {_CELLS} SELECT * FROM cells",
        "matrix_from_long": "SELECT vec_id::VARCHAR AS sample_id, len(embedding)::INT AS n, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
        "label_encode": f"SELECT o_orderkey, o_orderpriority, (list_position({PRIORITIES}, o_orderpriority) - 1)::INT AS label_idx FROM orders",
        "one_hot_codes": f"SELECT o_orderkey, (o_orderstatus = 'F')::INT::DOUBLE AS is_f, (o_orderstatus = 'O')::INT::DOUBLE AS is_o, (o_orderstatus = 'P')::INT::DOUBLE AS is_p, (list_position({STATUSES}, o_orderstatus) - 1)::INT AS label_idx FROM orders",
        "positional_join": "WITH d AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), l AS (SELECT quality, toxic, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM labels) SELECT ordinal, doc_id, n_chars, quality, toxic FROM d JOIN l USING (ordinal)",
        "knn_neighbours": _SIDES + _NEAR + "SELECT sample_id, rank, ref_id, round(distance, 9) AS distance FROM near",
        "knn_labels": _SIDES + _NEAR + ", votes AS (SELECT sample_id, label, count(*) AS c FROM near GROUP BY ALL) SELECT sample_id, label AS y_label FROM votes QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY c DESC, label) = 1",
        "constant_labels": "SELECT 0 AS y_label, count(*) AS n FROM embeddings",
        "matrix_tsv": "SELECT vec_id::VARCHAR AS sample_id, (row_number() OVER (ORDER BY vec_id))::INT AS place, len(embedding)::INT AS genes, round(list_sum(embedding::DOUBLE[]), 5) AS total, round(embedding[4]::DOUBLE, 6) AS fourth FROM embeddings",
        "released_csv": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, 'c' || label AS label, round(embedding[-1]::DOUBLE, 6) AS last, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings",
        "labels_csv": f"SELECT o_orderpriority AS label, (list_position({PRIORITIES}, o_orderpriority) - 1)::INT AS label_idx, count(*) AS n FROM orders GROUP BY ALL",
        "predictions_csv": "SELECT o_orderkey::VARCHAR AS sample_id, round(o_custkey % 1000 / 1000e0, 6) AS score FROM orders",
        "quantile_fit": "WITH c AS (SELECT 'l_quantity' AS gene, l_quantity AS value FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem), "
        f"q AS (SELECT gene, quantile_cont(value, {[i / 999 for i in range(1000)]}) AS q FROM c GROUP BY gene) SELECT gene, unnest(range(1000))::INT AS i, round(unnest(q), 7) AS q FROM q",
        "quantile_uniform": _QUANTILES + "SELECT sample_id, gene_idx, round(u, 9) AS u FROM u",
        "quantile_normal": _ppf_sql(),
        "quantile_round_trip": f"WITH {_S}, {_split_cte('sp', 's', [1])} SELECT sample_id, true AS restored, round(list_sum(list_transform(embedding, lambda x: round(x::DOUBLE, 4))), 2) AS total FROM sp JOIN s USING (sample_id) WHERE is_member",
        "forward_diffuse": f"WITH {_S}, {_CELLS}, {_ALPHA} SELECT sample_id, t::INT AS level, round(sum(pow(sqrt(a) * value + sqrt(1 - a) * {_hash_normal('0', 'gene_idx')}, 2)), 6) AS energy FROM cells, alpha WHERE t IN {LEVELS} GROUP BY ALL",
        "shadow_stats_diag": f"WITH {_S}, {_SP}, {_CELLS}, {_STATS} SELECT split_no, gene_idx, n, round(mean, 9) AS mean, round(var, 9) AS var FROM stats",
        "shadow_forms": f"WITH {_S}, {_split_cte('sp', 's', [1, 2, 3, 4, 5, 6])}, {_CELLS}, t AS (SELECT split_no, sum(v) AS trace FROM (SELECT split_no, gene_idx, var_pop(value) AS v FROM cells JOIN sp USING (sample_id) WHERE is_member GROUP BY ALL) GROUP BY split_no), "
        "m AS (SELECT split_no, sum(value) AS plus, sum(CASE WHEN gene_idx % 2 = 0 THEN value ELSE -value END) AS turns FROM cells JOIN sp USING (sample_id) WHERE is_member GROUP BY split_no, sample_id) "
        "SELECT split_no, count(*) AS n, round(any_value(trace), 6) AS trace, round(var_pop(plus), 6) AS sum_form, round(var_pop(turns), 6) AS difference_form FROM m JOIN t USING (split_no) GROUP BY split_no",
        "shadow_stats_orders": f"WITH {_O}, {_split_cte('sp', 'o', [1, 2, 3])} SELECT split_no, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 2) AS mean, round(var_pop(o_totalprice) / 1e6, 2) AS var_millions FROM o JOIN sp USING (sample_id) WHERE is_member GROUP BY ALL",
        "diffusion_losses_diag": losses,
        "losses_long": losses,
        "loss_summary": summary,
        "loss_summary_array": summary,
        "latent_kl_diag": kl + "SELECT * FROM kl",
        "elbo_by_split": kl + "SELECT split_no, round(avg(kl), 5) AS mean_kl FROM kl GROUP BY split_no",
        "output_transforms": f"WITH {_S}, {_CELLS} SELECT sample_id, round(sum(value), 6) AS none_sum, round(sum(exp(value)), 6) AS exp_sum, round(sum(1e0 / (1e0 + exp(-value))), 6) AS sigmoid_sum, round(sum(greatest(value, 0e0)), 6) AS relu_sum FROM cells GROUP BY sample_id",
        "stale_features": "SELECT vec_id::VARCHAR AS sample_id, (60 + label % 5)::INT AS width FROM embeddings WHERE 60 + label % 5 <> 63",
        "score_accuracy": _SCORES + _MET + "SELECT trained_on, source, split_no, round(acc, 9) AS acc, n_member, n_nonmember FROM met",
        "score_auc": _SCORES + _MET + "SELECT trained_on, source, split_no, round(auc, 9) AS auc FROM met",
        "tpr_at_fpr": _SCORES + _MET + "SELECT trained_on, source, split_no, round(tpr_at_fpr, 9) AS tpr_at_fpr FROM met",
        "lineitem_auc": "WITH sc AS (SELECT l_extendedprice AS score, (l_returnflag = 'R')::INT AS y FROM lineitem), rk AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r FROM sc) SELECT 1 AS split_no, round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y)::DOUBLE * sum(1 - y)), 9) AS auc FROM rk",
        "eval_report": _SCORES + _MET + "SELECT trained_on, source, split_no, round(avg(auc), 9) AS auc, round(avg(tpr_at_fpr), 9) AS tpr_at_fpr, round(avg(acc), 9) AS acc FROM met GROUP BY GROUPING SETS ((trained_on, source, split_no), (trained_on, source))",
        "domain_gap": _SCORES + _MET + "SELECT trained_on, round(avg(auc) FILTER (WHERE source = 'real') - avg(auc) FILTER (WHERE source = 'synth'), 9) AS auc_gap, round(avg(tpr_at_fpr) FILTER (WHERE source = 'real') - avg(tpr_at_fpr) FILTER (WHERE source = 'synth'), 9) AS tpr_at_fpr_gap FROM met GROUP BY trained_on",
        "best_checkpoint": "WITH c AS (SELECT o_orderpriority, (o_custkey % 12)::INT AS step, round(avg((o_orderstatus = 'F')::INT::DOUBLE), 2) AS tpr FROM orders GROUP BY ALL) SELECT o_orderpriority, step, tpr FROM c QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY tpr DESC, step) = 1",
        "diffusion_losses_two": _TWO_LOSSES + "SELECT * FROM losses",
        "latent_losses_two": _TWO_LATENT,
        "audit_two": _TWO_LOSSES + ", sc AS (SELECT split_no, sample_id, round(-avg(loss), 6) AS score, any_value(is_member)::INT AS y FROM losses JOIN sp USING (split_no, sample_id) GROUP BY ALL), " + _SPLIT_METRICS,
        "audit_minimal": _LOSS_CTES + ", sc AS (SELECT split_no, sample_id, round(-avg(loss), 9) AS score, any_value(is_member)::INT AS y FROM losses JOIN sp USING (split_no, sample_id) GROUP BY ALL), "
        + _SPLIT_METRICS,
    }
