"""Linear support-vector classifiers fitted by distributed aggregation.

Minimises, per class, penalty(w, b) + sum_i C * weight_i * max(0, 1 - y_i (w.x_i + b))^2, where the bias is
the weight of a constant feature 1 and is penalised like the others. With the squared penalty
(1/2)(|w|^2 + b^2) the objective is strictly convex, so the optimum does not depend on the solver.

Each step of the fit is one Spark aggregate over the training vectors that returns loss, gradient and
(for narrow matrices) curvature for all classes at once; the driver holds only the model.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cohortgrid.cluster import durable
from cohortgrid.fixed import BINARY_CLASSIFIER, OVR_CLASSIFIER
from cohortgrid.operators.partials import collected, dense, list_column, summed

CURVATURE_BYTES = 128 << 20
MODEL_BYTES = 256 << 20
STALLED = 1e-6


@dataclass(frozen=True)
class ClassifierSpec:
    penalty: str
    cost: float
    one_vs_rest: bool


def parse_classifier(text: str) -> ClassifierSpec:
    """"LinearSVC_<l1|l2>_c<cost>", with prefix "ovr_" for one-vs-rest."""
    found = re.fullmatch(r"(ovr_)?LinearSVC_(l1|l2)_c([0-9.eE+-]+)", text)
    if not found:
        raise ValueError(f"classifier must look like {BINARY_CLASSIFIER} or {OVR_CLASSIFIER}, got {text!r}")
    try:
        cost = float(found[3])
    except ValueError:
        raise ValueError(f"bad cost in classifier {text!r}") from None
    if not cost > 0:
        raise ValueError(f"cost must be positive in {text!r}")
    return ClassifierSpec(found[2], cost, bool(found[1]))


@dataclass(frozen=True)
class LinearModel:
    """Row k of weights scores class k; a binary model has one row, positive for label 1."""

    weights: np.ndarray
    bias: np.ndarray
    classes: tuple[str, ...]
    passes: int = 0

    def scores(self, x="x"):
        """Column: the raw margins as an array, one per class; a vector with a missing value raises, as in the fit."""
        weights, bias = self.weights, self.bias

        @F.arrow_udf(ArrayType(DoubleType()))
        def margins(column: pa.Array) -> pa.Array:
            rows = dense(column, weights.shape[1])
            if not np.isfinite(rows).all():
                raise ValueError("vectors to score must not have missing values")
            return list_column(rows @ weights.T + bias)

        return margins(x)

    def score(self, x="x"):
        """Column: the raw margin of a binary model."""
        return F.element_at(self.scores(x), 1)


@dataclass(frozen=True)
class _Problems:
    """One row per class: its code, and the cost of a positive and of a negative sample."""

    positive: np.ndarray
    cost_pos: np.ndarray
    cost_neg: np.ndarray
    width: int


def _evaluate(train: DataFrame, problems: _Problems, w: np.ndarray, live: np.ndarray, curved: bool):
    """Loss, gradient and curvature of the data term at w for the live classes: one job."""
    width = problems.width
    size = width + 1
    rows_of = (size if curved else 0) + 1

    def start():
        return {int(k): np.zeros((rows_of, size + 1)) for k in live}

    def add(blocks, batch):
        x = np.empty((batch.num_rows, size))
        x[:, :width] = dense(batch.column("x"), width)
        x[:, width] = 1.0
        if not np.isfinite(x).all():
            raise ValueError("training vectors must not have missing values")
        code = batch.column("code").to_numpy(zero_copy_only=False)
        weight = batch.column("weight").to_numpy(zero_copy_only=False)
        margins = x @ w[live].T
        for j, k in enumerate(live):
            mine = code == problems.positive[k]
            y = np.where(mine, 1.0, -1.0)
            cost = weight * np.where(mine, problems.cost_pos[k], problems.cost_neg[k])
            gap = 1.0 - y * margins[:, j]
            active = gap > 0
            xa, ca, ga = x[active], cost[active], gap[active]
            out = blocks[int(k)]
            out[0, :size] -= 2.0 * (xa.T @ (ca * y[active] * ga))
            out[0, size] += ca @ (ga * ga)
            if curved:
                out[1:, :size] += 2.0 * (xa.T @ (xa * ca[:, None]))

    sums = collected(summed(train, start, add), {int(k): (rows_of, size + 1) for k in live})
    loss = np.array([sums[int(k)][0, size] for k in live])
    grad = np.array([sums[int(k)][0, :size] for k in live])
    curve = [sums[int(k)][1:, :size] for k in live] if curved else None
    return loss, grad, curve


class _Penalty:
    """Squared or absolute penalty on all weights, the bias included.

    With the absolute penalty a step stays in one orthant: the signs of the weights, and for a weight of 0 the sign
    in which the objective falls. There it is smooth; weights that would cross 0 stop at it.
    """

    def __init__(self, kind: str):
        self.kind = kind

    def value(self, w):
        return 0.5 * float(w @ w) if self.kind == "l2" else float(np.abs(w).sum())

    def slope(self, w, g):
        """Gradient of the objective, given the data-term gradient g; of its flattest sub-gradients with l1."""
        if self.kind == "l2":
            return w + g
        return np.where(w != 0, g + np.sign(w), np.sign(g) * np.maximum(np.abs(g) - 1.0, 0.0))

    def newton(self, w, slope, h):
        """Step to the minimum of the quadratic model; with l1 over the weights that may leave 0."""
        if self.kind == "l2":
            return -np.linalg.solve(h + np.eye(len(w)), slope)
        step = np.zeros(len(w))
        free = np.flatnonzero((w != 0) | (slope != 0))
        if len(free):
            inner = h[np.ix_(free, free)]
            inner = inner + 1e-10 * max(1.0, np.trace(inner) / len(free)) * np.eye(len(free))
            step[free] = -np.linalg.solve(inner, slope[free])
            step[(w == 0) & (step * slope >= 0)] = 0.0  # would leave 0 uphill
        return step

    def aligned(self, slope, step):
        """A step from remembered curvature; with l1 without its parts that lead uphill."""
        return step if self.kind == "l2" else np.where(step * slope < 0, step, 0.0)

    def moved(self, w, slope, step, length):
        """The weights after a step of this length."""
        there = w + length * step
        if self.kind == "l2":
            return there
        orthant = np.where(w != 0, np.sign(w), -np.sign(slope))
        return np.where(there * orthant > 0, there, 0.0)


class _Memory:
    """Curvature of wide matrices from the last steps and changes of the gradient."""

    def __init__(self, keep: int = 10):
        self.pairs, self.keep = [], keep

    def push(self, s, y):
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            self.pairs = [*self.pairs[-(self.keep - 1) :], (s, y)]

    def step(self, g):
        q, used = g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append((a, s, y))
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(g))
        for a, s, y in reversed(used):
            q += s * (a - (y @ q) / (s @ y))
        return -q


def _minimise(train: DataFrame, problems: _Problems, kind: str, tolerance: float, max_passes: int):
    """Damped quasi-Newton for all classes side by side; the classes share every pass over the data. Curvature is
    summed with the gradient if the matrix is narrow, else remembered."""
    size, classes = problems.width + 1, len(problems.positive)
    if classes * size * 8 > MODEL_BYTES:
        raise ValueError(f"a model of {classes} x {size} weights is too large; reduce the matrix first")
    curved = classes * size * size * 8 <= CURVATURE_BYTES
    penalty = _Penalty(kind)
    smooth = 1.0 if kind == "l2" else 0.0  # the part of the penalty that remembered gradients include
    memory = [_Memory() for _ in range(classes)]
    accepted = np.zeros((classes, size))
    trial = accepted.copy()
    value = np.full(classes, np.inf)
    grad = [np.zeros(size) for _ in range(classes)]
    slope = [np.zeros(size) for _ in range(classes)]
    step = [np.zeros(size) for _ in range(classes)]
    scale = np.zeros(classes)
    length = np.ones(classes)
    live = np.arange(classes)
    for done in range(1, max_passes + 1):
        loss, data_grad, curve = _evaluate(train, problems, trial, live, curved)
        still = []
        for j, k in enumerate(live):
            total = penalty.value(trial[k]) + loss[j]
            move = trial[k] - accepted[k]
            if total > value[k] + 1e-4 * float(slope[k] @ move) + 1e-13 * abs(value[k]):
                length[k] *= 0.5
                if length[k] < 1e-12:  # no further decrease in floating point
                    left = float(np.abs(slope[k]).max())
                    if left > STALLED * max(1.0, scale[k]):
                        raise RuntimeError(f"the fit of problem {k} stalled {left:.1e} from its optimum")
                    continue
                trial[k] = penalty.moved(accepted[k], slope[k], step[k], length[k])
                still.append(k)
                continue
            if not curved and np.isfinite(value[k]):
                memory[k].push(move, smooth * move + data_grad[j] - grad[k])
            accepted[k], value[k], grad[k] = trial[k].copy(), total, data_grad[j]
            slope[k] = penalty.slope(accepted[k], grad[k])
            gap = float(np.abs(slope[k]).max())
            scale[k] = max(scale[k], gap)
            if gap <= tolerance * max(1.0, scale[k]):
                continue
            if curved:
                step[k] = penalty.newton(accepted[k], slope[k], curve[j])
            else:
                step[k] = penalty.aligned(slope[k], memory[k].step(slope[k]))
            length[k] = 1.0
            trial[k] = penalty.moved(accepted[k], slope[k], step[k], 1.0)
            still.append(k)
        live = np.array(still, dtype=int)
        if not len(live):
            return accepted, done
    raise RuntimeError(f"no convergence in {max_passes} passes")


def _prepared(train: DataFrame, code, weight) -> DataFrame:
    rows = train.select("x", code.cast("int").alias("code"), weight.cast("double").alias("weight"))
    return durable(rows).persist(StorageLevel.MEMORY_AND_DISK)


def _code_counts(rows: DataFrame) -> dict[int, int]:
    return {r["code"]: r["count"] for r in rows.groupBy("code").count().collect()}


def fit_binary(
    train: DataFrame,
    width: int,
    label: str = "label",
    classifier: str = BINARY_CLASSIFIER,
    weight: str | None = None,
    tolerance: float = 1e-9,
    max_passes: int = 500,
) -> LinearModel:
    """Fit x -> label (0/1) with balanced class weights N / (2 n_class); scores are positive for 1."""
    spec = parse_classifier(classifier)
    if spec.one_vs_rest:
        raise ValueError("a binary fit takes a binary classifier")
    rows = _prepared(train, F.col(label), F.col(weight) if weight else F.lit(1.0))
    try:
        counts = _code_counts(rows)
        if set(counts) != {0, 1}:
            raise ValueError(f"labels must be 0 and 1, got {sorted(counts, key=str)}")
        n = sum(counts.values())
        problems = _Problems(
            np.array([1]), np.array([spec.cost * n / (2 * counts[1])]), np.array([spec.cost * n / (2 * counts[0])]), width
        )
        w, passes = _minimise(rows, problems, spec.penalty, tolerance, max_passes)
    finally:
        rows.unpersist()
    return LinearModel(w[:, :width], w[:, width], ("1",), passes)


def fit_one_vs_rest(
    train: DataFrame,
    width: int,
    classes: list[str],
    code: str = "code",
    classifier: str = OVR_CLASSIFIER,
    weight: str | None = None,
    tolerance: float = 1e-9,
    max_passes: int = 500,
) -> LinearModel:
    """Fit one classifier per class against the rest; code is the position in the class list.

    A sample of class c weighs N / (K n_c) as a positive of c, and 1 as a negative of another class.
    """
    spec = parse_classifier(classifier)
    if not spec.one_vs_rest:
        raise ValueError("a one-vs-rest fit takes a classifier with prefix ovr_")
    if len(classes) < 3:
        raise ValueError("one-vs-rest needs three or more classes; use the binary fit for two")
    rows = _prepared(train, F.col(code), F.col(weight) if weight else F.lit(1.0))
    try:
        counts = _code_counts(rows)
        absent = [c for i, c in enumerate(classes) if i not in counts]
        if absent or None in counts:
            raise ValueError(f"classes without training samples: {absent}" if absent else "samples without a class")
        n = sum(counts.values())
        k = len(classes)
        positive = np.array([spec.cost * n / (k * counts[i]) for i in range(k)])
        problems = _Problems(np.arange(k), positive, np.full(k, spec.cost), width)
        w, passes = _minimise(rows, problems, spec.penalty, tolerance, max_passes)
    finally:
        rows.unpersist()
    return LinearModel(w[:, :width], w[:, width], tuple(classes), passes)
