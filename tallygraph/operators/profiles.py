"""How many estimators an error needs, and the best estimate within a time."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygraph.operators import estimators
from tallygraph.operators.estimators import Estimation, Successes
from tallygraph.plans.graph import Graph

#: Weight of a new error in the moving average, where that starts, and the factor on errors.
ALPHA, START, FACTOR = 0.04, 100.0, 5.0


def regression_through_origin(x: Column, y: Column) -> Column:
    """The slope k that fits y = k x best; an aggregate."""
    return F.sum(x * y) / F.sum(x * x)


def bound(epsilon: Column | float, delta: float, edge_calls: float, conditional_calls: float, estimate: Column | float, max_degree: Column | int, num_edges: Column | int) -> Column:
    """max_degree^b * m^a / (epsilon^2 f) * ln(2 / delta)."""
    c = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.pow(c(max_degree), F.lit(float(conditional_calls))) * F.pow(c(num_edges), F.lit(float(edge_calls))) / c(estimate) / F.pow(c(epsilon), F.lit(2.0)) * F.lit(math.log(2 / delta))


def moving_average(errors: np.ndarray, alpha: float = ALPHA, start: float = START) -> np.ndarray:
    out, now = np.empty(len(errors)), start
    for i, e in enumerate(errors):
        now = now * (1 - alpha) + e * alpha
        out[i] = now
    return out


@dataclass(frozen=True)
class ErrorProfile:
    """Numbers of estimators from a profile on a sample of the edges.

    Batches of estimators on the sample show how the error falls with their number; the constant K between that and the bound is fitted. The count
    in the whole graph is guessed from the sample's by the chance that all edges of an instance are in it."""

    pattern_edges: int
    rate: float = 0.1
    points: int = 1 << 10
    per_point: int = 16
    more: int = 1 << 16
    seed: int = 31

    def num_estimators(self, graph: Graph, estimator: Successes, error: float, confidence: float) -> int:
        sample = graph.sample(self.rate, self.seed).reindexed().persist()
        try:
            n = self.points * self.per_point + self.more
            # All batches are one table: each estimator's batch follows from its id.
            sums = estimators.running(estimator(sample, 0, n, self.seed), n, self.per_point).where(F.col("batch_no") < self.points).orderBy("batch_no").toPandas()
            final = estimators.calculate(sample, estimator, n, self.seed).mean
            if not final:
                raise ValueError("no instance was found in the sample; raise rate or more")
            means = sums.total.to_numpy(float) / sums.done.to_numpy(float)
            averaged = moving_average(np.abs(means - final) / final * FACTOR)
            top = sample.degrees.agg(F.max("deg")).first()[0]
            b = self.pattern_edges - 1 if estimator is not estimators.triangle else 1
            cost = top**b * sample.num_edges / final * math.log(2 / (1 - confidence))
            x = np.sqrt(cost / sums.done.to_numpy(float))
            k = float((x * averaged).sum() / (x * x).sum())
            guess = final / self.rate**self.pattern_edges
            whole = graph.degrees.agg(F.max("deg")).first()[0] ** b * graph.num_edges / guess / error**2 * math.log(2 / (1 - confidence))
            return max(1, math.ceil(whole * k * k))
        finally:
            sample.unpersist()

    def run(self, graph: Graph, estimator: Successes, error: float, confidence: float, start: Estimation | None = None) -> Estimation:
        return estimators.calculate(graph, estimator, self.num_estimators(graph, estimator, error, confidence), self.seed + 1, start)


def within_time(graph: Graph, estimator: Successes, seconds: float, seed: int, first: int = 1 << 12) -> Estimation:
    """Rounds of doubling numbers of estimators while the next should still fit; the last round fills what is left."""
    began, n, state, last = time.perf_counter(), first, Estimation(), 0.0
    while True:
        used = time.perf_counter() - began
        left = max(0.0, seconds - used)
        if last and 2 * last > left:
            n = int(n / 2 * left / last)
            if n < 1:
                return state
            return estimators.calculate(graph, estimator, state.n + n, seed, state)
        at = time.perf_counter()
        state = estimators.calculate(graph, estimator, state.n + n, seed, state)
        last = max(1e-3, time.perf_counter() - at)
        n *= 2


def statistics(values: DataFrame, column: str) -> DataFrame:
    """Mean, population standard deviation and population variance of replicates."""
    return values.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"), F.var_pop(column).alias("variance"))
