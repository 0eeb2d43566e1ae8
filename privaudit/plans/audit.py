"""The audit: splits, shadows, synthetic tables, loss features, classifier, metrics, scores.

Every stage is a Parquet table below ``root`` that follows its inputs:

* The samples, with their labels and a hash of their contents, are written once for
  each state of the input tables.
* Splits are made again when the sample ids change.  A split has a fingerprint of its
  members' contents; its scaler, shadow and synthetic table are computed when that, or a
  setting that they use, is new.
* Loss features are kept by cell: split with its fingerprint, sample with its hash.  Only
  cells that are missing are scored and added, so rows that a split's shadow was not
  fitted on can change or come at the cost of their own cells; cells of rows or shadows
  that have changed are no longer read.

So the tables under one root give what a new root would give.  All splits that a stage
lacks are computed in one scan of the samples.  A forced stage is computed once more, and
so are all stages after it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privaudit.config import AuditConfig
from privaudit.operators import features as feats
from privaudit.operators import labels, metrics, scaler, splits
from privaudit.plans import classify
from privaudit.plans.shadows import FAMILIES, Family
from privaudit.sources import splits_io, stages

_STAGES = ("splits", "scalers", "shadows", "synthetic", "features", "classifier")
_DATA = ("seed", "ratio", "scale", "label_mode", "neighbours")
_FIT = (*_DATA, "family", "floor", "latent_dim", "rank")
_SCORE = (*_FIT, "levels", "draws", "temperatures")
_CELL = ["split_no", "sample_id", "row_hash"]


def _digest(*parts) -> str:
    return hashlib.sha1(repr(parts).encode()).hexdigest()[:12]


def _total(column: Column) -> Column:
    return F.coalesce(F.sum(column.cast("decimal(20,0)")), F.lit(0)).cast("string")


@dataclass
class Audit:
    """``samples``: ``sample_id, ordinal, features`` and, for label mode ``real``, ``label_idx``;
    ``labelled``: ``ref_id, features, y_label`` for label mode ``knn``.
    ``external``: synthetic tables made elsewhere (``split_no, row_id, label_idx, features``); they take the place of
    generated ones, and the shadows asked for are capped at the splits they have.  ``split_table``: the splits they were
    made from (``split_no, sample_id, is_member``, e.g. k-fold), which then also decide membership; a sample that a
    split does not list has no part in it.  ``computed``: what the last call of each stage had to compute, in splits or,
    for features, in cells."""

    samples: DataFrame
    root: str
    cfg: AuditConfig
    labelled: DataFrame | None = None
    external: DataFrame | None = None
    split_table: DataFrame | None = None
    force: frozenset[str] = frozenset()

    def __post_init__(self):
        self.spark = self.samples.sparkSession
        self.computed: dict[str, list[int] | int] = {}
        self._renewed: set[str] = set()
        self._known: dict[str, object] = {}
        if self.external is not None:
            n = self.external.select("split_no").distinct().count()
            k, q = splits.capped(self.cfg.train_shadows, self.cfg.holdout_shadows, n)
            self.cfg = replace(self.cfg, train_shadows=k, holdout_shadows=q)
        self.samples = feats.checked(self.samples)

    @property
    def family(self) -> Family:
        return FAMILIES[self.cfg.family]

    def path(self, stage: str) -> str:
        return f"{self.root}/{self.cfg.family}/{stage}"

    def _once(self, key: str, compute):
        if key not in self._known:
            self._known[key] = compute()
        return self._known[key]

    def _with_labels(self, df: DataFrame) -> DataFrame:
        if self.cfg.label_mode == "real":
            problem = F.raise_error(F.concat(F.lit("no label for "), F.col("sample_id")))
            return df.withColumn("label_idx", F.when(F.col("label_idx").isNull(), problem).otherwise(F.col("label_idx")))
        if self.cfg.label_mode == "knn":
            return df.drop("label_idx").transform(labels.knn_labels(self.labelled, self.cfg.neighbours)).withColumnRenamed("y_label", "label_idx")
        return df.withColumn("label_idx", F.lit(0))

    def rows(self) -> DataFrame:
        """``sample_id, ordinal, label_idx, features, row_hash``, written once for each state of the inputs."""

        def compute() -> DataFrame:
            tables = [t for t in (self.samples, self.labelled if self.cfg.label_mode == "knn" else None) if t is not None]
            sums = [tuple(map(str, t.agg(F.count("*"), _total(F.xxhash64(*sorted(t.columns)))).first())) for t in tables]
            path = f"{self.root}/samples-{_digest(self.cfg.label_mode, self.cfg.neighbours, sums)}"
            if not stages.exists(self.spark, path):
                ordinal = [] if "ordinal" not in self.samples.columns else ["ordinal"]
                rows = self._with_labels(self.samples).select(F.col("sample_id").cast("string").alias("sample_id"), *ordinal, F.col("label_idx").cast("int").alias("label_idx"), "features")
                rows.withColumn("row_hash", F.xxhash64("label_idx", "features")).write.mode("overwrite").parquet(path)
            return self.spark.read.parquet(path)

        return self._once("rows", compute)

    def _forced(self, stage: str, path: str) -> bool:
        """Whether the stage, or one before it, is to be computed again and has not been yet."""
        if path in self._renewed or not self.force & {*_STAGES[: _STAGES.index(stage) + 1]}:
            return False
        self._renewed.add(path)
        return True

    def splits(self) -> DataFrame:
        """``split_no, sample_id, is_member`` of the splits asked for."""

        def compute() -> DataFrame:
            if self.split_table is not None:
                return self.split_table.select("split_no", F.col("sample_id").cast("string").alias("sample_id"), "is_member")
            path = f"{self.root}/splits-{self.cfg.fingerprint('seed', 'ratio')}"
            self.computed["splits"] = splits_io.extend(self.rows(), path, self.cfg.splits, self.cfg.ratio, self.cfg.seed, self._forced("splits", path))
            return self.spark.read.parquet(path).select("split_no", "sample_id", "is_member")

        return self._once("splits", compute).where(F.col("split_no").isin(self.cfg.splits))

    def _prints(self, source: str, *fields: str) -> dict[int, str]:
        """A fingerprint of each split: the settings named and the contents of the rows its shadow is fitted on."""

        def contents() -> dict[int, str]:
            if source == "synth" and self.external is not None:
                rows = self.external.where(F.col("split_no").isin(self.cfg.splits)).select("split_no", F.xxhash64(*sorted(self.external.columns)).alias("h"))
            else:
                chosen = self.splits().where("is_member").select("split_no", "sample_id")
                rows = chosen.join(self.rows().select("sample_id", "row_hash"), "sample_id").select("split_no", F.xxhash64("sample_id", "row_hash").alias("h"))
            sums = rows.groupBy("split_no").agg(F.count("*").alias("n"), _total(F.col("h")).alias("s")).collect()  # a row a split
            return {r["split_no"]: _digest(r["n"], r["s"]) for r in sums}

        found = self._once(f"contents-{source}", contents)
        lost = [s for s in self.cfg.splits if s not in found]
        if lost:
            what = "no synthetic table" if source == "synth" and self.external is not None else "no members"
            raise FileNotFoundError(f"{what} for splits {lost[:5]}: give them in the external or split table, or ask for fewer shadows")
        return {s: f"{self.cfg.fingerprint(*fields)}-{found[s]}" for s in self.cfg.splits}

    def _ensured(self, stage: str, name: str, source: str, fields: tuple[str, ...], compute) -> DataFrame:
        """The stage's table with the splits asked for, computing those that are not there."""
        path, prints = self.path(name), self._prints(source, *fields)

        def ensure() -> None:
            self.computed[name] = stages.ensure(self.spark, path, self.cfg.splits, prints, compute, self._forced(stage, path))

        self._once(name, ensure)
        table = stages.read(self.spark, path, hint=f"stage {stage} has not been run")
        return table.join(F.broadcast(stages.by_split(self.spark, prints)), ["split_no", "fingerprint"], "left_semi").drop("fingerprint")

    def _members(self, numbers: list[int]) -> DataFrame:
        """The members of the splits, once each, with ``splits``, those they are members of."""
        chosen = self.splits().where(F.col("split_no").isin(numbers) & F.col("is_member"))
        chosen = chosen.groupBy("sample_id").agg(F.sort_array(F.collect_list("split_no")).alias("splits"))  # at most as many as splits
        return self.rows().join(chosen, "sample_id").select("sample_id", "splits", "label_idx", "features")

    def _fitted_on(self, source: str, numbers: list[int]) -> DataFrame:
        return self._members(numbers) if source == "real" else self.synthetic().where(F.col("split_no").isin(numbers))

    def scalers(self, source: str) -> DataFrame | None:
        """Each split's quantiles (``split_no, gene_idx, quantiles``), of the rows its shadow is fitted on, fitted together."""
        if not self.cfg.scale:
            return None

        def compute(numbers: list[int]) -> DataFrame:
            rows = self._fitted_on(source, numbers)
            rows = rows.select((F.explode("splits") if source == "real" else F.col("split_no")).alias("split_no"), "features")
            return scaler.fit(rows.select("split_no", F.posexplode("features").alias("gene_idx", "value")), ["split_no", "gene_idx"])

        return self._ensured("scalers", f"scalers-{source}", source, _FIT if source == "synth" else _DATA, compute)

    def _fit(self, rows: DataFrame, scalers: DataFrame | None, numbers: list[int]) -> DataFrame:
        """Shadows of the splits; the quantiles of so many as are held at a time go to the tasks."""
        if scalers is None:
            return self.family.fit(rows, self.cfg.floor, None, self.cfg.rank, numbers)
        width = scalers.agg(F.max("gene_idx") + 1).first()[0]
        step, out = max(1, (64 << 20) // (8 * scaler.MOST * width)), None
        for at in range(0, len(numbers), step):
            some = numbers[at : at + step]
            many = "splits" in rows.columns
            own = rows.withColumn("splits", F.array_intersect("splits", F.array(*map(F.lit, some)))) if many else rows.where(F.col("split_no").isin(some))
            fitted = self.family.fit(own, self.cfg.floor, scaler.quantile_matrices(scalers.where(F.col("split_no").isin(some))), self.cfg.rank, some)
            out = fitted if out is None else out.union(fitted)
        return out

    def shadows(self, source: str = "real") -> DataFrame:
        """Parameters per split, fitted on members or on the split's synthetic rows."""

        def compute(numbers: list[int]) -> DataFrame:
            return self._fit(self._fitted_on(source, numbers), self.scalers(source), numbers)

        return self._ensured("shadows", f"shadows-{source}", source, _FIT, compute)

    def synthetic(self) -> DataFrame:
        """One synthetic row per member and split, in the original space; or the external tables."""
        if self.external is not None:
            self._prints("synth")
            return self.external.select("split_no", "row_id", "label_idx", "features")

        def compute(numbers: list[int]) -> DataFrame:
            chosen, scalers = F.col("split_no").isin(numbers), self.scalers("real")
            members = self._members(numbers).select(F.explode("splits").alias("split_no"), F.col("sample_id").alias("row_id"), "label_idx")
            return self.family.generate(self.shadows("real").where(chosen), members, self.cfg, None if scalers is None else scalers.where(chosen))

        return self._ensured("synthetic", "synthetic", "real", _FIT, compute)

    def features(self, source: str) -> DataFrame:
        """``split_no, sample_id, features, y_member`` of every sample under every shadow."""
        name = f"features-{source}"
        path = self.path(name)

        def ensure() -> DataFrame:
            prints = F.broadcast(stages.by_split(self.spark, self._prints(source, *_SCORE)))  # a row a split
            rows = self.rows().select("sample_id", "row_hash")
            truth = self.splits()
            if self.split_table is None and not (lost := rows.join(truth.select("sample_id"), "sample_id", "left_anti").limit(1)).isEmpty():
                raise ValueError(f"sample {lost.first()['sample_id']} is in no split")
            cells = truth.join(rows, "sample_id").select(*_CELL, F.col("is_member").cast("int").alias("y_member"))
            forced = self._forced("features", path)
            there = None if forced or not stages.exists(self.spark, path) else self.spark.read.parquet(path).join(prints, ["split_no", "fingerprint"], "left_semi")
            lacking = cells if there is None else cells.join(there.select(*_CELL), _CELL, "left_anti")
            lacking = stages.written(lacking, "cells")
            self.computed[name] = lacking.count()
            if self.computed[name]:
                asked = lacking.groupBy("sample_id").agg(F.collect_list("split_no").alias("splits"))
                wanted = [r["split_no"] for r in lacking.select("split_no").distinct().collect()]
                chosen, scalers = F.col("split_no").isin(wanted), self.scalers(source)
                scored = self.family.losses(self.shadows(source).where(chosen), self.rows().join(asked, "sample_id"), self.cfg, None if scalers is None else scalers.where(chosen))
                added = scored.join(lacking, ["split_no", "sample_id"]).join(prints, "split_no")
                if forced:
                    stages.write(added, path)
                else:
                    added.write.mode("append").partitionBy("split_no").parquet(path)
            table = self.spark.read.parquet(path).join(prints, ["split_no", "fingerprint"], "left_semi")
            if table.count() != cells.count():  # cells of rows that are no longer there
                table = table.join(cells.select(*_CELL), _CELL, "left_semi")
            return table.select("split_no", "sample_id", "features", "y_member")

        return self._once(name, ensure)

    def _by_role(self, source: str) -> DataFrame:
        """What the classifiers read, written once: training and scoring pass over it many times."""

        def compute() -> DataFrame:
            roles = splits.roles(self.spark, self.cfg.train_shadows, self.cfg.holdout_shadows)
            found = classify.prepared(self.features(source), self.cfg).join(F.broadcast(roles), "split_no")  # a row per split
            return stages.written(found, f"prepared-{source}")

        return self._once(f"prepared-{source}", compute)

    def classifier(self, source: str = "real") -> classify.Classifier:
        sums = self.rows().agg(F.count("*"), _total(F.xxhash64("sample_id", "row_hash"))).first()
        path = self.path(f"classifier-{source}-{self.cfg.classifier}-{_digest(self.cfg.fingerprint(), self._prints(source), *map(str, sums))}")
        if not self._forced("classifier", path) and classify.saved(self.spark, path):
            return classify.load(path, self.cfg.classifier)
        rows = self._by_role(source)
        validation = rows.where("role = 'val'") if self.cfg.train_shadows > 1 else rows.where("role = 'train'")
        found = classify.train(rows.where("role = 'train'"), validation, self.cfg)
        found.save(path)
        return found

    def scores(self, trained_on: str = "real", source: str = "real") -> DataFrame:
        """``trained_on, source, split_no, role, sample_id, score, y`` of all splits."""
        scored = self.classifier(trained_on).scores(self._by_role(source))
        return scored.select(F.lit(trained_on).alias("trained_on"), F.lit(source).alias("source"), "split_no", "role", "sample_id", "score", F.col("y_member").alias("y"))

    def metrics(self, trained_on: str = "real", source: str = "real", holdout_only: bool = True) -> DataFrame:
        scored = self.scores(trained_on, source)
        if holdout_only:
            scored = scored.where("role = 'holdout'")
        scored = stages.written(scored, "scores")  # the metrics read them many times
        return metrics.evaluate(scored, ["trained_on", "source", "split_no"], self.cfg.target_fpr)

    def domain_gap(self) -> DataFrame:
        """The real-trained classifier on real and on synthetic shadows' features."""
        return metrics.domain_gap(self.metrics("real", "real").unionByName(self.metrics("real", "synth")))

    def score_released(self, released: DataFrame, trained_on: str = "synth") -> DataFrame:
        """Membership scores of all samples against a released table (``row_id, features``)."""
        rows = released.select(F.lit(0).alias("split_no"), "row_id", "features")
        if self.cfg.label_mode == "none":
            rows = rows.withColumn("label_idx", F.lit(0))
        else:
            near = labels.infer(released.select(F.col("row_id").alias("sample_id"), "features"), self.labelled, self.cfg.neighbours)
            rows = rows.join(near.select(F.col("sample_id").alias("row_id"), F.col("y_label").alias("label_idx")), "row_id")
        scalers = None
        if self.cfg.scale:
            cells = rows.select("split_no", F.posexplode("features").alias("gene_idx", "value"))
            scalers = stages.written(scaler.fit(cells, ["split_no", "gene_idx"]), "released-scaler")
        params = stages.written(self._fit(rows.select("split_no", "label_idx", "features"), scalers, [0]), "released-shadow")
        losses = self.family.losses(params, self.rows(), self.cfg, scalers)
        scored = self.classifier(trained_on).scores(classify.prepared(losses, self.cfg))
        return scored.join(self.rows().select("sample_id", "ordinal"), "sample_id").select("sample_id", "ordinal", "score")
