"""Training of trajectory heads: data-parallel gradients, AdamW, early stop on validation scores.

A row is one target of a directed scene: features, and its 2 * steps future coordinates (null where there is no truth). The loss is the mean over the drawn scenes of
the mean distance of a scene's valid points. Draws of many steps are made and joined with the rows at once and kept by step, so that a
step reads its own batch only. Tasks return one sum of gradients each, sums are added up in two levels, and the driver holds parameters and moments.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import fresh, staged
from .panels import hierarchical_sample

#: Steps whose batches are drawn and joined together.
TOGETHER = 64


@dataclass
class AdamW:
    """Decoupled weight decay; moments are corrected for their start."""

    rate: float = 1e-3
    decay: float = 1e-4
    betas: tuple[float, float] = (0.9, 0.999)
    epsilon: float = 1e-8
    step: int = 0
    first: np.ndarray | None = None
    second: np.ndarray | None = None

    def update(self, p: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        if self.first is None:
            self.first, self.second = np.zeros_like(p), np.zeros_like(p)
        self.step += 1
        a, b = self.betas
        self.first = a * self.first + (1 - a) * gradient
        self.second = b * self.second + (1 - b) * gradient**2
        m, v = self.first / (1 - a**self.step), self.second / (1 - b**self.step)
        return p * (1 - self.rate * self.decay) - self.rate * m / (np.sqrt(v) + self.epsilon)


@dataclass
class Head:
    """A network of dense layers (ReLU between them); sizes: features, hidden ones, 2 * steps."""

    sizes: Sequence[int]
    shapes: list = field(init=False)

    def __post_init__(self):
        self.shapes = [s for a, b in zip(self.sizes[:-1], self.sizes[1:]) for s in ((a, b), (b,))]

    def start(self, seed: int = 0) -> np.ndarray:
        r = np.random.default_rng(seed)
        return np.concatenate([(r.uniform(-1, 1, s) / np.sqrt(self.sizes[i // 2])).ravel() for i, s in enumerate(self.shapes)])

    def split(self, p: np.ndarray) -> list[np.ndarray]:
        cut = np.cumsum([int(np.prod(s)) for s in self.shapes])
        return [x.reshape(s) for x, s in zip(np.split(p, cut[:-1]), self.shapes)]

    def forward(self, p: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """The input of each layer, and the output."""
        w, out = self.split(p), [x]
        for i in range(0, len(w), 2):
            y = out[-1] @ w[i] + w[i + 1]
            out.append(np.maximum(y, 0) if i + 2 < len(w) else y)
        return out

    def loss(self, p: np.ndarray, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """(loss, gradient): sums of weight * distance over valid points. target: NaN where there is no truth."""
        held, w = self.forward(p, x), self.split(p)
        away = (held[-1] - target).reshape(len(x), -1, 2)
        valid = ~np.isnan(away).any(axis=2)
        away = np.where(valid[:, :, None], away, 0.0)
        distance = np.sqrt((away**2).sum(axis=2))
        back = (weight[:, None, None] * away / np.where(distance > 0, distance, 1.0)[:, :, None]).reshape(len(x), -1)
        grads = []
        for i in range(len(w) - 2, -1, -2):
            grads[:0] = [held[i // 2].T @ back, back.sum(axis=0)]
            if i:
                back = (back @ w[i].T) * (held[i // 2] > 0)
        return float((weight[:, None] * distance).sum()), np.concatenate([g.ravel() for g in grads])


def prepared(rows: DataFrame, match: str, window: str, scene: str, features: str, target: str) -> DataFrame:
    """match, window, scene, x, y (NaN for null), share: the weight of a point of its scene, one over the scene's number of valid points. Scenes without a valid point go."""
    both = F.transform(target, lambda v, i: (i % 2 == 0) & v.isNotNull() & F.get(target, i + 1).isNotNull())
    points = F.size(F.filter(both, lambda x: x))
    y = F.transform(target, lambda v: F.coalesce(v.cast("double"), F.lit(float("nan"))))
    r = rows.select(F.col(match).alias("match"), F.col(window).alias("window"), F.col(scene).alias("scene"), F.col(features).cast("array<double>").alias("x"), y.alias("y"), points.alias("__n"))
    n = r.groupBy("match", "window", "scene").agg(F.sum("__n").alias("__all")).where("__all > 0")
    return r.join(n, ["match", "window", "scene"]).withColumn("share", 1 / F.col("__all")).drop("__n", "__all")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _gradient(head: Head, shared):
    def run(batches):
        total, loss, rows = np.zeros(len(shared.value)), 0.0, 0
        for b in batches:
            if len(b):
                part, g = head.loss(shared.value, _matrix(b.column("x")), _matrix(b.column("y")), b.column("weight").to_numpy())
                total, loss, rows = total + g, loss + part, rows + len(b)
        if rows:
            yield pa.record_batch([pa.array([np.append(total, loss).tolist()], pa.list_(pa.float64()))], names=["g"])

    return run


def _added(batches):
    total = None
    for b in batches:
        for g in b.column("g"):
            x = np.asarray(g.values)
            total = x if total is None else total + x
    if total is not None:
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])


def summed_gradient(batch: DataFrame, head: Head, p: np.ndarray) -> tuple[float, np.ndarray]:
    """(loss, gradient) of rows (x, y, weight): one sum a task, added up by about the square root of the cores' number of tasks, then by the driver."""
    shared = batch.sparkSession.sparkContext.broadcast(p)
    each = batch.mapInArrow(_gradient(head, shared), "g array<double>")
    n = batch.sparkSession.sparkContext.defaultParallelism
    found = each.repartition(max(1, int(n**0.5))).mapInArrow(_added, "g array<double>").collect()
    shared.unpersist()
    total = np.sum([r["g"] for r in sorted(found)], axis=0) if found else np.zeros(len(p) + 1)
    return float(total[-1]), total[:-1]


def drawn(rows: DataFrame, batch: int, first: int, steps: int, seed: int) -> DataFrame:
    """Batches of steps first .. first + steps - 1, kept by step: x, y, weight, step. A scene that is drawn twice counts twice."""
    scenes = rows.select("match", "window", "scene").distinct()
    d = hierarchical_sample(scenes, "match", "window", "scene", batch * steps, seed + first)
    d = d.withColumn("step", (F.lit(first) + F.floor(F.col("draw") / batch)).cast("int")).groupBy("step", "match", "window", "scene").agg(F.count(F.lit(1)).alias("times"))
    path = fresh(rows.sparkSession, "batches")
    both = rows.join(d, ["match", "window", "scene"]).select("x", "y", (F.col("share") * F.col("times") / batch).alias("weight"), "step")
    both.repartition("step").write.partitionBy("step").parquet(path)
    return rows.sparkSession.read.parquet(path)


def score(rows: DataFrame, head: Head, p: np.ndarray) -> float:
    """The mean over all scenes of prepared() rows of their mean distance."""
    n = rows.select("match", "window", "scene").distinct().count()
    loss, _ = summed_gradient(rows.withColumn("weight", F.col("share") / max(1, n)), head, p)
    return loss


def train(rows: DataFrame, validation: DataFrame, head: Head, batch: int = 128, steps: int = 5000, every: int = 100, patience: int = 5, seed: int = 0, optimiser: AdamW | None = None, start: np.ndarray | None = None):
    """(parameters, history): the parameters with the lowest validation score, the earliest of equal ones, and (step, training loss, score, improved) of each evaluation.

    rows and validation are tables of prepared(). Evaluation comes every ``every`` steps; after ``patience`` of them without a lower score training stops."""
    rows, validation = staged(rows, "rows"), staged(validation, "validation")
    optimiser = optimiser or AdamW()
    p = head.start(seed) if start is None else start
    best, kept, since, history, batches = np.inf, p, 0, [], None
    for step in range(1, steps + 1):
        if (step - 1) % TOGETHER == 0:
            batches = drawn(rows, batch, step, min(TOGETHER, steps - step + 1), seed)
        loss, g = summed_gradient(batches.where(F.col("step") == step), head, p)
        if not np.isfinite(g).all():
            raise ValueError(f"step {step}: the gradient isn't finite")
        p = optimiser.update(p, g)
        if step % every == 0 or step == steps:
            now = score(validation, head, p)
            improved = now < best
            history.append((step, loss, now, improved))
            best, kept, since = (now, p, 0) if improved else (best, kept, since + 1)
            if since >= patience:
                break
    return kept, history
