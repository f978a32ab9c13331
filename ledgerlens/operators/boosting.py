"""Second-order boosted trees: gradient and Hessian histograms by Spark aggregates, trees grown best leaf first.

Rows are binned once and stay where they are; a level of a tree is one aggregate of integer sums by leaf, column and bin,
so for given cuts another partitioning gives the same trees; the cuts are a quantile sketch's. The driver holds those sums and the trees, whose size follows
from columns, bins and depth.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import stage

#: Gradients are summed as multiples of this part of one.
UNIT = float(1 << 20)
#: Bins of probability by which validation rows are ranked.
RANKS = 1024


@dataclass
class Tree:
    """A complete binary tree by position: node i has children 2i+1 and 2i+2; column -1 marks a leaf."""

    column: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), int)
        while (inner := self.column[at] >= 0).any():
            low = bins[np.arange(len(bins)), np.maximum(self.column[at], 0)] <= self.bin[at]
            at = np.where(inner, 2 * at + np.where(low, 1, 2), at)
        return at

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaf(bins)]


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(m, -30, 30)))


def binned(pdf: pd.DataFrame, n: int) -> np.ndarray:
    return np.array(pdf["bins"].tolist(), int).reshape(len(pdf), n)


def average_precision(ranked: pd.DataFrame) -> float:
    """From positives and rows by probability bin."""
    t = ranked.sort_values("bin", ascending=False)
    hit, seen = t["g"].cumsum(), t["h"].cumsum()
    return float((t["g"] * hit / seen).sum() / max(1, t["g"].sum()))


@dataclass
class Booster:
    """``leaves``: leaves of a tree at most (None: all that ``depth`` allows); ``patience``: trees without a better
    average precision on the validation rows after which the trees up to the best are kept."""

    trees: int = 300
    depth: int = 6
    leaves: int | None = None
    step: float = 0.05
    l2: float = 1.0
    least_hessian: float = 1.0
    bins: int = 32
    patience: int = 20
    staged_trees: int = 10
    columns: list[str] = field(default_factory=list)
    cuts: list[list[float]] = field(default_factory=list)
    base: float = 0.0
    model: list[Tree] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    def _binned(self, df: DataFrame):
        """The bin of each column: how many cuts lie below its value. Nulls count as 0."""
        value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        one = lambda c, cuts: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda k: k < value(c))) if cuts else F.lit(0)
        return F.array(*(one(c, cuts).cast("short") for c, cuts in zip(self.columns, self.cuts, strict=True)))

    def fit(self, df: DataFrame, columns: list[str], label: str = "label", weight: str | None = None, validation: str | None = None, cuts: list[list[float]] | None = None) -> Booster:
        """Rows of which the boolean column ``validation`` is true only stop the growth. ``cuts``: bin edges by column, if not
        quantiles of the training rows. Raises ValueError without training rows."""
        self.columns, self.model, self.history = list(columns), [], []
        valid = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        train = df.filter(~valid)
        shares = [i / self.bins for i in range(1, self.bins)]
        self.cuts = cuts or [sorted(set(q)) for q in train.na.fill(0, self.columns).approxQuantile(self.columns, shares, 0.2 / self.bins)]
        n, total, positive = train.agg(F.count(F.lit(1)), F.sum(w), F.sum(w * F.col(label))).first()
        if not n:
            raise ValueError("no training rows")
        share = min(max(positive / total, 1e-6), 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        rows = stage(df.select(self._binned(df).alias("bins"), F.col(label).cast("double").alias("y"), w.alias("w"), valid.alias("v"), F.lit(self.base).alias("m")), "boost")
        done, best = 0, (-1.0, 0)
        while len(self.model) < self.trees:
            tree, precision = self._grow(rows, self.model[done:])
            if validation and self.model:
                self.history.append(precision)
                if precision > best[0]:
                    best = (precision, len(self.model))
                elif len(self.model) - best[1] >= self.patience:
                    break
            self.model.append(tree)
            if len(self.model) - done >= self.staged_trees and len(self.model) < self.trees:
                rows, done = stage(self._advanced(rows, self.model[done:]), "boost"), len(self.model)
        if validation:
            last = average_precision(self._sums(rows, self.model[done:], None, [])[0])
            self.history.append(last)
            self.model = self.model[: len(self.model) if last > best[0] else best[1]]
        return self

    def _advanced(self, rows: DataFrame, new: list[Tree]) -> DataFrame:
        n = len(self.columns)

        def add(batches):
            for pdf in batches:
                b, m = binned(pdf, n), pdf["m"].to_numpy().copy()
                for t in new:
                    m += t.margin(b)
                yield pdf.assign(m=m)

        return rows.mapInPandas(add, rows.schema)

    def _sums(self, rows: DataFrame, new: list[Tree], tree: Tree | None, live: list[int]) -> tuple[pd.DataFrame, np.ndarray]:
        """Validation ranks (bin, g positives, h rows), and gradient and Hessian sums by live node, column and bin."""
        n, width = len(self.columns), self.bins
        slot = np.full(1 << (self.depth + 2), -1)
        slot[live] = np.arange(len(live))

        def partial(batches):
            both, ranks = np.zeros((2, len(live) * n * width), np.int64), np.zeros((2, RANKS), np.int64)
            for pdf in batches:
                b, m, y, w, v = binned(pdf, n), pdf["m"].to_numpy().copy(), pdf["y"].to_numpy(), pdf["w"].to_numpy(), pdf["v"].to_numpy(bool)
                for t in new:
                    m += t.margin(b)
                p = sigmoid(m)
                if tree is None or live == [0]:
                    r = np.minimum((p[v] * RANKS).astype(int), RANKS - 1)
                    ranks += np.array([np.bincount(r, y[v], RANKS), np.bincount(r, minlength=RANKS)]).astype(np.int64)
                if tree is None:
                    continue
                s = slot[tree.leaf(b)]
                use = (s >= 0) & ~v
                at = ((s[use, None] * n + np.arange(n)) * width + b[use]).ravel()
                for k, x in enumerate((w * (p - y), w * p * (1 - p))):
                    whole = np.repeat(np.rint(x[use] * UNIT), n)  # whole numbers: their sums are exact in any order
                    both[k] += np.bincount(at, whole, both.shape[1]).astype(np.int64)
            for kind, (g, h) in enumerate((both, ranks)):
                at = np.flatnonzero((g != 0) | (h != 0))
                yield pd.DataFrame({"kind": kind, "bin": at, "g": g[at], "h": h[at]})

        got = rows.mapInPandas(partial, "kind int, bin long, g long, h long").groupBy("kind", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
        sums = np.zeros((2, len(live) * n * width))
        hist = got[got["kind"] == 0]
        sums[:, hist["bin"].to_numpy(int)] = hist[["g", "h"]].to_numpy(float).T / UNIT
        return got[got["kind"] == 1], sums.reshape(2, len(live), n, width)

    def _grow(self, rows: DataFrame, new: list[Tree]) -> tuple[Tree, float]:
        """One tree, and the average precision of the trees before it: all levels are measured, then leaves are split by gain."""
        size = (1 << (self.depth + 1)) - 1
        full = Tree(np.full(size, -1), np.zeros(size, int), np.zeros(size))
        gain, precision, live = np.zeros(size), 0.0, [0]
        for level in range(self.depth + 1):
            ranked, (g, h) = self._sums(rows, new, full, live)
            if level == 0:
                precision = average_precision(ranked)
            deeper = []
            for s, node in enumerate(live):
                G, H = g[s, 0].sum(), h[s, 0].sum()
                full.value[node] = -self.step * G / (H + self.l2)
                if level == self.depth:
                    continue
                gl, hl = g[s].cumsum(1)[:, :-1], h[s].cumsum(1)[:, :-1]
                gr, hr = G - gl, H - hl
                score = gl**2 / (hl + self.l2) + gr**2 / (hr + self.l2) - G**2 / (H + self.l2)
                score[(hl < self.least_hessian) | (hr < self.least_hessian)] = -1
                best = int(score.argmax())  # the first column and bin of equals
                if score.flat[best] > 1e-9:
                    gain[node] = score.flat[best]
                    full.column[node], full.bin[node] = divmod(best, score.shape[1])
                    deeper += [2 * node + 1, 2 * node + 2]
            live = deeper
            if not live:
                break
        return self._best_first(full, gain), precision

    def _best_first(self, full: Tree, gain: np.ndarray) -> Tree:
        """The splits that growth by largest gain makes first; a split's gain does not depend on other leaves."""
        most = self.leaves or len(gain)
        tree, count, heap = Tree(np.full(len(gain), -1), full.bin, full.value), 1, []
        if full.column[0] >= 0:
            heap = [(-gain[0], 0)]
        while heap and count < most:
            _, node = heapq.heappop(heap)
            tree.column[node] = full.column[node]
            count += 1
            for child in (2 * node + 1, 2 * node + 2):
                if full.column[child] >= 0:
                    heapq.heappush(heap, (-gain[child], child))
        return tree

    def predict(self, df: DataFrame, name: str = "probability") -> DataFrame:
        model, base, n = self.model, self.base, len(self.columns)

        @F.pandas_udf("double")
        def score(bins: pd.Series) -> pd.Series:
            b = np.array(bins.tolist(), int).reshape(len(bins), n)
            return pd.Series(sigmoid(base + sum((t.margin(b) for t in model), np.zeros(len(b)))))

        return df.withColumn(name, score(self._binned(df)))
