"""Shadow families: linear-Gaussian generators whose fit is a distributed sum.

``diffusion``: mean and covariance of a split's members; the loss is the squared
error of the best Gaussian denoiser's noise estimate per noise level and draw.
``latent``: probabilistic principal components with class means; the loss is the
reconstruction error per temperature and draw, next to the divergence of the
latent code.  A family fits parameters, draws synthetic rows and scores rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit.functions import noise
from privaudit.operators.scaler import inverse_matrix, quantile_matrices, transform_matrix
from privaudit.operators.statistics import spectrum, top_spectrum, wide_lists, wide_matrix

#: Bytes of splits' parameters that the driver and a task hold at a time; more take another scan of the rows.
_HELD = 64 << 20
_bank = lru_cache(maxsize=8)(noise.bank)


class Gaussian:
    """One split's parameters: d x d numbers, whatever the rows."""

    def __init__(self, rows: list):
        self.mean = {r["label_idx"]: np.array(r["mean"]) for r in rows}
        self.values = np.array(rows[0]["eigvals"])
        self.width = len(rows[0]["mean"])
        self.vectors = np.array(rows[0]["eigvecs"]).reshape(self.width, -1)  # all of them, or the first
        self.n = {r["label_idx"]: r["n"] for r in rows}
        self._turned: tuple = (None, None)

    def centred(self, X: np.ndarray, labels: np.ndarray) -> np.ndarray:
        overall = sum(self.mean[k] * self.n[k] for k in self.mean) / sum(self.n.values())
        return X - np.array([self.mean.get(int(k), overall) for k in labels]).reshape(X.shape)

    def turned(self, E: np.ndarray) -> np.ndarray:
        """The noise in the eigenbasis, computed once a task."""
        if self._turned[0] is not E:
            self._turned = E, E @ self.vectors
        return self._turned[1]


def gaussians(params: DataFrame) -> dict[int, Gaussian]:
    out: dict[int, list] = {}
    for r in params.orderBy("split_no", "label_idx").toLocalIterator():
        out.setdefault(r["split_no"], []).append(r)
    return {k: Gaussian(v) for k, v in out.items()}


def held(params: DataFrame, scalers: DataFrame | None = None) -> Iterator[tuple[dict[int, Gaussian], dict[int, np.ndarray] | None]]:
    """The splits' parameters and quantiles, about ``_HELD`` bytes at a time."""
    sizes = params.groupBy("split_no").agg(F.max(8 * (F.size("eigvecs") + (1000 * F.size("eigvals") if scalers is not None else F.lit(0)))).alias("b")).orderBy("split_no").collect()  # a row a split
    part, size = [], 0
    for i, (number, b) in enumerate(sizes):
        part.append(number)
        size += b
        if i == len(sizes) - 1 or size + b > _HELD:
            chosen = F.col("split_no").isin(part)
            yield gaussians(params.where(chosen)), None if scalers is None else quantile_matrices(scalers.where(chosen))
            part, size = [], 0


def diffusion_losses(C: np.ndarray, E: np.ndarray, values: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Rows x (levels x draws): C rows and E noise in the eigenbasis."""
    d, out = len(values), []
    for a in alphas:
        below = a * values + 1.0 - a
        A, B = np.sqrt(a * (1 - a)) / below, a * values / below
        out.append(((C**2) @ (A**2))[:, None] - 2 * (C * (A * B)) @ E.T + ((E**2) @ (B**2))[None, :])
    return np.concatenate(out, axis=1) / d


def latent_parts(R: np.ndarray, values: np.ndarray, vectors: np.ndarray, q: int) -> tuple:
    """Projections, latent means, latent variance, scales, and squared lengths of centred rows R."""
    q = max(1, min(q, len(values) - 1))
    sigma2 = float(values[q:].mean())  # of a cut spectrum the mean of the rest is the last value
    scale = np.sqrt(np.maximum(values[:q] - sigma2, 0.0))
    P = R @ vectors[:, :q]
    return P, scale * P / values[:q], sigma2 / values[:q], scale, (R**2).sum(axis=1)


def latent_losses(R: np.ndarray, values: np.ndarray, vectors: np.ndarray, q: int, temperatures, E: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reconstruction losses (temperature-major) and divergence per latent dimension."""
    P, M, var, scale, length = latent_parts(R, values, vectors, q)
    rest, out = length - (P**2).sum(axis=1), []
    for t in temperatures:
        for e in E[:, : len(scale)]:
            Z = M + t * np.sqrt(var) * e
            out.append((rest + ((P - scale * Z) ** 2).sum(axis=1)) / R.shape[1])
    kl = -0.5 * (1 + np.log(var) - M**2 - var)
    return np.array(out).T.reshape(len(R), -1), kl


class Family:
    """A generator family; see the module's description."""

    name = ""

    def fit(self, rows: DataFrame, floor: float, quantiles: dict[int, np.ndarray] | None = None, rank: int = 0, numbers: list[int] | None = None) -> DataFrame:
        """Parameters of ``split_no`` or ``splits``, ``label_idx, features``; of scaled rows if there are ``quantiles``.

        With ``rank`` only so many directions of the splits ``numbers``, for rows too wide for a d x d matrix; the diffusion family needs all.
        """
        if not rank:
            return spectrum(rows, floor, quantiles)
        if self.name != "latent":
            raise ValueError(f"family {self.name} needs the whole spectrum")
        return top_spectrum(rows, rank, numbers, floor, quantiles)

    def score(self, gaussian: Gaussian, X: np.ndarray, labels: np.ndarray, cfg) -> np.ndarray:
        raise NotImplementedError

    def width(self, cfg) -> int:
        raise NotImplementedError

    def losses(self, params: DataFrame, samples: DataFrame, cfg, scalers: DataFrame | None = None) -> DataFrame:
        """``split_no, sample_id, features`` of every sample under every split's shadow, or under those in the sample's ``splits``.

        One scan of the samples serves all splits whose parameters are held at a time; the
        samples are never shuffled.
        """
        label = F.col("label_idx") if "label_idx" in samples.columns else F.lit(0)
        asked = F.col("splits").cast("array<int>") if "splits" in samples.columns else F.lit(None).cast("array<int>")
        rows = samples.select("sample_id", label.cast("int").alias("label_idx"), F.col("features").cast("array<double>").alias("features"), asked.alias("splits"))
        parts = [rows.mapInArrow(self._scored(some, quantiles, cfg), "split_no int, sample_id string, features array<float>") for some, quantiles in held(params, scalers)]
        return reduce(DataFrame.union, parts) if parts else params.sparkSession.createDataFrame([], "split_no int, sample_id string, features array<float>")

    def _scored(self, some: dict[int, Gaussian], quantiles: dict[int, np.ndarray] | None, cfg):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    X, labels, asked = wide_matrix(part.column(2)), part.column(1).to_numpy(), part.column(3).to_pylist()
                    for number, gaussian in some.items():
                        own = np.flatnonzero([a is None or number in a for a in asked])
                        if len(own):
                            Z = X[own] if quantiles is None else transform_matrix(X[own], quantiles[number])
                            S = self.score(gaussian, Z, labels[own], cfg).astype(np.float32)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), number), pa.int32()), part.column(0).take(pa.array(own)), wide_lists(S, pa.float32())], names=["split_no", "sample_id", "features"])

        return run

    def sample(self, gaussian: Gaussian, labels: np.ndarray, normals: np.ndarray, cfg) -> np.ndarray:
        raise NotImplementedError

    def generate(self, params: DataFrame, members: DataFrame, cfg, scalers: DataFrame | None = None) -> DataFrame:
        """One synthetic row per member (``split_no, row_id, label_idx``), so the labels stay as they are; in the original space if the shadows were fitted on scaled rows."""
        kinds = "split_no int, row_id string, label_idx int, features array<float>"
        rows = members.select(F.col("split_no").cast("int").alias("split_no"), F.col("row_id").cast("string").alias("row_id"), F.col("label_idx").cast("int").alias("label_idx"))
        parts = [rows.where(F.col("split_no").isin([*some])).mapInArrow(self._drawn(some, quantiles, cfg), kinds) for some, quantiles in held(params, scalers)]
        return reduce(DataFrame.union, parts) if parts else params.sparkSession.createDataFrame([], kinds)

    def _drawn(self, some: dict[int, Gaussian], quantiles: dict[int, np.ndarray] | None, cfg):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbers = batch.column(0).to_numpy()
                for number in np.unique(numbers).tolist():
                    part, gaussian = batch.filter(pa.array(numbers == number)), some[number]
                    seeds = [np.random.SeedSequence([cfg.seed, number, *str(i).encode()]) for i in part.column(1).to_pylist()]
                    normals = np.array([np.random.default_rng(s).normal(size=gaussian.width) for s in seeds])
                    X = self.sample(gaussian, part.column(2).to_numpy(), normals, cfg)
                    if quantiles is not None:
                        X = inverse_matrix(X, quantiles[number])
                    yield pa.RecordBatch.from_arrays([*part.columns, wide_lists(X.astype(np.float32), pa.float32())], names=["split_no", "row_id", "label_idx", "features"])

        return run


class Diffusion(Family):
    name = "diffusion"

    def score(self, gaussian, X, labels, cfg):
        E = gaussian.turned(_bank(cfg.seed, cfg.draws, X.shape[1]))
        alphas = noise.alpha_bar()[list(cfg.levels)]
        return diffusion_losses(gaussian.centred(X, labels) @ gaussian.vectors, E, gaussian.values, alphas)

    def width(self, cfg):
        return len(cfg.levels) * cfg.draws

    def sample(self, gaussian, labels, normals, cfg):
        return -gaussian.centred(np.zeros_like(normals), labels) + (normals * np.sqrt(gaussian.values)) @ gaussian.vectors.T


class Latent(Family):
    name = "latent"

    def score(self, gaussian, X, labels, cfg):
        E = _bank(cfg.seed, cfg.draws, cfg.latent_dim)
        rec, kl = latent_losses(gaussian.centred(X, labels), gaussian.values, gaussian.vectors, cfg.latent_dim, cfg.temperatures, E)
        return np.hstack([rec, kl])

    def width(self, cfg):
        return len(cfg.temperatures) * cfg.draws + cfg.latent_dim

    def sample(self, gaussian, labels, normals, cfg):
        q = max(1, min(cfg.latent_dim, len(gaussian.values) - 1))
        sigma2 = gaussian.values[q:].mean()
        scale = np.sqrt(np.maximum(gaussian.values[:q] - sigma2, 0.0))
        return -gaussian.centred(np.zeros_like(normals), labels) + (normals[:, :q] * scale) @ gaussian.vectors[:, :q].T


FAMILIES: dict[str, Family] = {f.name: f for f in (Diffusion(), Latent())}


def generate_class(family: Family, params: DataFrame, split: int, label: int, n: int, cfg) -> DataFrame:
    """``n`` rows of one class."""
    ids = params.sparkSession.range(n).select(F.lit(split).alias("split_no"), F.concat(F.lit(f"class{label}-"), F.col("id").cast("string")).alias("row_id"), F.lit(label).alias("label_idx"))
    return family.generate(params.where(F.col("split_no") == split), ids, cfg)
