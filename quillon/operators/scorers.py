"""Unknownness scores behind one interface: fit on known training rows, score any rows.

Larger scores are more unknown-like. A fitted model is at most classes x d or d x d
numbers; the moments are aggregated by Spark and finished on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import vec
from quillon.operators import centroids
from quillon.operators.checks import finite_scores
from quillon.operators.neighbors import nearest_neighbors
from quillon.operators.prefix import linear_quantiles
from quillon.session import cut


class Scorer(Protocol):
    """``fit`` returns a scorer that is ready; ``score`` a column of doubles."""

    def fit(self, train: DataFrame) -> Scorer: ...

    def score(self) -> Column: ...


def maximum_softmax(z: Column) -> Column:
    return 1 - F.array_max(vec.softmax(z))


def predictive_entropy(z: Column) -> Column:
    return -vec.total(F.transform(vec.softmax(z), lambda p: p * F.log(p + 1e-12)))


def energy(z: Column, temperature: float = 1.0) -> Column:
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    return -temperature * vec.log_sum_exp(z, temperature)


@dataclass
class Moments:
    """Count, sum, scatter about the origin and summed fourth norms of vectors, by label."""

    labels: list[str]
    n: np.ndarray
    sums: np.ndarray
    scatter: np.ndarray
    fourth: float

    @property
    def means(self) -> np.ndarray:
        return self.sums / self.n[:, None]

    def within(self) -> np.ndarray:
        """Scatter about the class means, pooled over classes."""
        return self.scatter - (self.sums.T / self.n) @ self.sums


def gather_moments(df: DataFrame, label: str, vector: str) -> Moments:
    """One pass over the rows: each partition adds up its own, and the sums of all partitions
    are added element by element in Spark. What reaches the driver is classes x d and d x d
    numbers, whatever the number of rows or partitions."""

    def part(batches):
        sums: dict[str, list] = {}
        scatter, fourth = 0.0, 0.0
        for pdf in batches:
            x = np.stack(pdf[vector].to_numpy()).astype(float) if len(pdf) else None
            if x is None:
                continue
            scatter = scatter + x.T @ x
            fourth += float(((x * x).sum(axis=1) ** 2).sum())
            for name, at in pdf.groupby(label).indices.items():
                s = sums.setdefault(name, [0, 0.0])
                s[0] += len(at)
                s[1] = s[1] + x[at].sum(axis=0)
        for i, (name, (n, s)) in enumerate(sums.items()):
            full = np.asarray(scatter).ravel() if i == 0 else np.zeros(0)
            yield pd.DataFrame({"label": [name], "n": [n], "s": [s], "scatter": [full], "fourth": [fourth if i == 0 else 0.0]})

    rows = df.select(label, vector).mapInPandas(part, "label string, n bigint, s array<double>, scatter array<double>, fourth double")
    rows = cut(rows)
    counts = {r["label"]: float(r["n"]) for r in rows.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    labels = sorted(counts)
    place = {x: i for i, x in enumerate(labels)}
    each = rows.select("label", F.posexplode("s").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x")).collect()
    whole = rows.select(F.posexplode("scatter").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    d = int(round(len(whole) ** 0.5))
    sums, scatter = np.zeros((len(labels), d)), np.zeros(d * d)
    for r in each:
        sums[place[r["label"]], r["i"]] = r["x"]
    for r in whole:
        scatter[r["i"]] = r["x"]
    fourth = rows.agg(F.sum("fourth").alias("f")).first()["f"] or 0.0
    return Moments(labels, np.array([counts[x] for x in labels]), sums, scatter.reshape(d, d), fourth)


def _quadratic(vector: Column, means: np.ndarray, precision: np.ndarray) -> Column:
    @F.pandas_udf("double")
    def least(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float)
        d = x[:, None, :] - means[None, :, :]
        return pd.Series(np.einsum("nci,ij,ncj->nc", d, precision, d).min(axis=1))

    return least(vector)


class Mahalanobis:
    """Least squared distance to a class mean under the pooled within-class covariance.

    ``shrink`` uses the Ledoit-Wolf intensity of the centred rows in place of the ridge.
    """

    def __init__(self, label: str, vector: str, ridge: float = 1e-4, shrink: bool = False, relative: bool = False):
        self.label, self.vector, self.ridge, self.shrink, self.relative = label, vector, ridge, shrink, relative

    def fit(self, train: DataFrame) -> Mahalanobis:
        m = gather_moments(train, self.label, self.vector)
        n, d = m.n.sum(), m.sums.shape[1]
        self.means = m.means
        if self.shrink:
            centred = self._centred(train, m)
            cov = _ledoit_wolf(centred.scatter, n, centred.fourth)
        else:
            cov = m.within() / max(1.0, n - 1) + self.ridge * np.eye(d)
        self.precision = np.linalg.pinv(cov)
        if self.relative:
            self.center = (m.sums.sum(axis=0) / n)[None, :]
            total = m.scatter - n * np.outer(self.center[0], self.center[0])
            moved = train.select(F.lit("all").alias(self.label), self._less(self.center[0]).alias(self.vector))
            self.whole = np.linalg.pinv(_ledoit_wolf(total, n, gather_moments(moved, self.label, self.vector).fourth))
        return self

    def _less(self, center: np.ndarray) -> Column:
        c = F.array(*[F.lit(float(x)) for x in center])
        return F.zip_with(F.col(self.vector), c, lambda x, y: x - y)

    def _centred(self, train: DataFrame, m: Moments) -> Moments:
        means = train.sparkSession.createDataFrame([(n, [float(x) for x in v]) for n, v in zip(m.labels, m.means, strict=True)], "__class string, __mean array<double>")
        both = train.join(F.broadcast(means), F.col(self.label) == F.col("__class"))
        less = F.zip_with(F.col(self.vector), F.col("__mean"), lambda x, y: x - y)
        return gather_moments(both.select(F.lit("all").alias(self.label), less.alias(self.vector)), self.label, self.vector)

    def score(self) -> Column:
        s = _quadratic(F.col(self.vector), self.means, self.precision)
        return s - _quadratic(F.col(self.vector), self.center, self.whole) if self.relative else s


def _ledoit_wolf(scatter: np.ndarray, n: float, fourth: float) -> np.ndarray:
    """Shrunk covariance of centred rows from their scatter and summed fourth norms."""
    d = len(scatter)
    cov = scatter / n
    mu = np.trace(cov) / d
    delta = ((cov - mu * np.eye(d)) ** 2).sum()
    beta = min(delta, (fourth / n - (cov**2).sum()) / n)
    s = 0.0 if delta == 0 else beta / delta
    return (1 - s) * cov + s * mu * np.eye(d)


class SubspaceResidual:
    """Virtual-logit score: scaled norm outside the principal subspace less log-sum-exp.

    The subspace takes the first components that explain ``explained`` of the variance,
    but never all of them; the scale matches mean residual and mean log-sum-exp in training.
    """

    def __init__(self, label: str, vector: str, logits: str, explained: float = 0.95):
        self.label, self.vector, self.logits, self.explained = label, vector, logits, explained

    def fit(self, train: DataFrame) -> SubspaceResidual:
        m = gather_moments(train, self.label, self.vector)
        n, d = m.n.sum(), m.sums.shape[1]
        self.center = m.sums.sum(axis=0) / n
        values, axes = np.linalg.eigh((m.scatter - n * np.outer(self.center, self.center)) / max(1.0, n - 1))
        share = np.cumsum(np.maximum(values[::-1], 0)) / max(np.maximum(values, 0).sum(), 1e-300)
        k = min(int(np.searchsorted(share, self.explained)) + 1, d - 1)
        self.rest = axes[:, : d - k]
        r = train.agg(F.avg(vec.log_sum_exp(F.col(self.logits))).alias("l"), F.avg(self._residual()).alias("r")).first()
        self.alpha = r["l"] / r["r"] if r["r"] else 0.0
        return self

    def _residual(self) -> Column:
        center, rest = self.center, self.rest

        @F.pandas_udf("double")
        def outside(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_numpy()).astype(float) - center
            return pd.Series(np.linalg.norm(x @ rest, axis=1))

        return outside(F.col(self.vector))

    def score(self) -> Column:
        return self.alpha * self._residual() - vec.log_sum_exp(F.col(self.logits))


def train_only(df: DataFrame) -> DataFrame:
    """Known training rows; raises if there are none."""
    rows = df.where("split = 'train' and status = 'known'")
    if rows.isEmpty():
        raise ValueError("no known training rows to fit on")
    return rows


def check_fit_rows(df: DataFrame) -> DataFrame:
    """``df``, after a check that it holds known training rows only and at least one."""
    bad = df.where(~F.coalesce((F.col("split") == "train") & (F.col("status") == "known"), F.lit(False)))
    if not bad.isEmpty():
        raise ValueError("rows to fit on must be known training rows")
    return train_only(df)


def nearest_class(train: DataFrame, rows: DataFrame, cosine: bool = False, scaled: bool = False) -> DataFrame:
    """``rows`` with ``score``: distance to the nearest class mean, Euclidean, cosine or after scaling."""
    if scaled:
        rows, train = (centroids.standardized(x, train, "e", "e") for x in (rows, train))
    if cosine:
        means = centroids.class_means(train.withColumn("u", vec.l2_normalize(F.col("e"))), "label", "u")
        return centroids.with_nearest(rows, means, "label", "e", "cosine").withColumn("score", F.col("nearest"))
    return centroids.with_nearest(rows, centroids.class_means(train, "label", "e"), "label", "e").withColumn("score", F.col("nearest"))


def neighbour_means(train: DataFrame, rows: DataFrame, ks: list[int]) -> DataFrame:
    """(sample_id, k1, k5, ..): mean cosine distance to the k nearest training rows, for all ``ks`` from one search."""
    near = nearest_neighbors(rows, train, "sample_id", "e", max(ks))
    means = [F.avg(F.when(F.col("rank") <= k, F.col("distance"))).alias(f"k{k}") for k in ks]
    return near.groupBy(F.col("id").alias("sample_id")).agg(*means)


def neighbour_mean(train: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with ``score``: mean cosine distance to the k nearest training rows."""
    return rows.join(neighbour_means(train, rows, [k]).withColumnRenamed(f"k{k}", "score"), "sample_id")


def clipped_energy(train: DataFrame, rows: DataFrame, share: float) -> DataFrame:
    """``rows`` with ``score``: energy of class-mean logits of the vector clipped at a quantile of all training activations.

    The quantile is exact and comes from counts by value, ordered range by range.
    """
    counts = cut(train.select(F.explode("e").alias("x")).groupBy("x").agg(F.count("*").alias("n")))
    cap = linear_quantiles(counts, [], "x", "n", {"c": share})
    head = centroids.class_means(train, "label", "e").agg(F.array_sort(F.collect_list(F.struct("label", "mean"))).alias("h"))
    both = rows.crossJoin(F.broadcast(cut(cap))).crossJoin(F.broadcast(cut(head)))
    clipped = both.withColumn("__e", vec.clip_above(F.col("e"), F.col("c")))
    z = F.transform("h", lambda h: vec.dot(F.col("__e"), h["mean"]) / F.size("__e"))
    return clipped.withColumn("__z", z).withColumn("score", energy(F.col("__z"))).drop("h", "c", "__e", "__z")


def _number(variant: str) -> float:
    return float(variant.split("=")[-1].lstrip("p"))


def fit_and_score(method: str, variant: str, train: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with ``score`` by a method of the matrix, fitted on ``train`` only; a foreign method raises.

    Both frames have sample_id, label, status, split, e and z. A score that is not finite
    raises where it is read.
    """
    z = F.col("z")
    plain = {"msp": maximum_softmax, "entropy": predictive_entropy, "energy": lambda c: energy(c, _number(variant))}
    if method in plain:
        return finite_scores(rows.withColumn("score", plain[method](z)), "score")
    check_fit_rows(train)
    if method == "ncm":
        out = nearest_class(train, rows, variant == "cosine", variant == "standardized")
    elif method == "knn_cosine":
        out = neighbour_mean(train, rows, int(_number(variant)))
    elif method == "react":
        out = clipped_energy(train, rows, _number(variant) / 100)
    elif method == "vim":
        out = rows.withColumn("score", SubspaceResidual("label", "e", "z", _number(variant)).fit(train).score())
    elif method == "mahalanobis":
        model = Mahalanobis("label", "e", shrink=variant != "pinv", relative=variant == "relative")
        out = rows.withColumn("score", model.fit(train).score())
    else:
        raise ValueError(f"unknown method: {method}/{variant}")
    return finite_scores(out, "score")


REGISTRY = {
    "msp": lambda: maximum_softmax(F.col("z")), "entropy": lambda: predictive_entropy(F.col("z")), "energy": lambda: energy(F.col("z")),
    "mahalanobis": lambda: Mahalanobis("label", "e"), "mahalanobis_lw": lambda: Mahalanobis("label", "e", shrink=True),
    "relative_mahalanobis": lambda: Mahalanobis("label", "e", shrink=True, relative=True), "vim": lambda: SubspaceResidual("label", "e", "z"),
}


def create_scorer(name: str):
    """A scorer by name; ``maximum_softmax_probability`` and ``energy_score`` are aliases."""
    alias = {"maximum_softmax_probability": "msp", "predictive_entropy": "entropy", "energy_score": "energy"}
    key = alias.get(name.lower(), name.lower())
    if key not in REGISTRY:
        raise ValueError(f"unknown scorer: {name}")
    return REGISTRY[key]()
