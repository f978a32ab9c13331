"""Quality by a sparse rule ensemble: tree paths as rules, lasso logistic weights, one Spark expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold
from .mixing import WORDS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = "#$%&*!|@^~<>{}[]=+_\\/"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, all JVM expressions. An empty text has zeros."""
    t = F.coalesce(text, F.lit(""))
    n = F.char_length(t)
    words = F.regexp_extract_all(t, F.lit(WORDS), F.lit(0))
    lines = F.split(t, "\n")
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return {
        "chars": n.cast("double"),
        "words": F.size(words).cast("double"),
        "word_length": ratio(n.cast("double"), F.size(words)),
        "distinct_words": ratio(F.size(F.array_distinct(words)).cast("double"), F.size(words)),
        "distinct_lines": ratio(F.size(F.array_distinct(lines)).cast("double"), F.size(lines)),
        "line_length": ratio(n.cast("double"), F.size(lines)),
        "upper": ratio((n - F.char_length(F.translate(t, _UPPER, ""))).cast("double"), n),
        "marks": ratio((n - F.char_length(F.translate(t, _MARKS, ""))).cast("double"), n),
        "digits": ratio((n - F.char_length(F.translate(t, "0123456789", ""))).cast("double"), n),
    }


NAMES = ["chars", "words", "word_length", "distinct_words", "distinct_lines", "line_length", "upper", "marks", "digits"]

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, cut) ...; all must hold


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, least: int, path: Rule, out: list[Rule], leaf: np.ndarray) -> None:
    """A regression tree on gradients (gain g^2 / h); every path but the root is a rule."""
    if path:
        out.append(path)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    leaf[rows] = total_g / (total_h + 1.0)
    if depth == 0 or len(rows) < 2 * least:
        return
    best = (1e-9, None)
    for j in range(x.shape[1]):
        order = rows[np.argsort(x[rows, j], kind="stable")]
        v = x[order, j]
        cg, ch = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
        k = np.arange(1, len(v))
        gain[(v[1:] <= v[:-1]) | (k < least) | (len(v) - k < least)] = -1
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (gain[i], (j, float((v[i] + v[i + 1]) / 2)))
    if best[1] is None:
        return
    j, cut = best[1]
    above = x[rows, j] > cut
    grow(x, g, h, rows[~above], depth - 1, least, (*path, (j, False, cut)), out, leaf)
    grow(x, g, h, rows[above], depth - 1, least, (*path, (j, True, cut)), out, leaf)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, cut in rule:
        out &= (x[:, j] > cut) == above
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """FISTA on the mean logistic loss; the constant is free."""
    n = len(y)
    a = np.column_stack([r, np.ones(n)])
    step = 4 * n / (np.linalg.norm(a, 2) ** 2 + 1e-12)
    w = np.zeros(a.shape[1])
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
        new = z - step * (a.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + (old - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


class RuleModel:
    """Rules with weights; ``column`` is the score as one Spark expression."""

    def __init__(self, rules: list[Rule], weights: np.ndarray, constant: float):
        self.rules, self.weights, self.constant = rules, weights, constant

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 12, depth: int = 3, least: int = 8, penalty: float = 2e-4) -> RuleModel:
        """Boosted trees propose rules, lasso keeps few. With one class or no rows: a constant."""
        if len(y) == 0 or y.min() == y.max():
            return cls([], np.zeros(0), 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0))
        rules: list[Rule] = []
        f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            leaf = np.zeros(len(y))
            grow(x, y - p, p * (1 - p), np.arange(len(y)), depth, min(least, max(1, len(y) // 20)), (), rules, leaf)
            f += 0.5 * leaf
        seen: dict[bytes, Rule] = {}
        for rule in rules:  # rules that hold for the same rows are one
            seen.setdefault(np.packbits(holds(rule, x)).tobytes(), rule)
        rules = list(seen.values())
        r = np.column_stack([holds(rule, x) for rule in rules]).astype(float)
        w, b = lasso_logistic(r, y, penalty)
        keep = np.flatnonzero(np.abs(w) > 1e-6)
        return cls([rules[i] for i in keep], w[keep], b)

    def predict(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.constant)
        for rule, w in zip(self.rules, self.weights, strict=True):
            s += w * holds(rule, x)
        return 1 / (1 + np.exp(-s))

    def column(self, stats: dict[str, Column]) -> Column:
        s = F.lit(self.constant)
        for rule, w in zip(self.rules, self.weights, strict=True):
            cond = None
            for j, above, cut in rule:
                c = stats[NAMES[j]] > cut if above else stats[NAMES[j]] <= cut
                cond = c if cond is None else cond & c
            s = s + F.when(cond, F.lit(float(w))).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-s))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000, mod: int = 5, held: int = 0, id_col: str = "doc_id") -> RuleModel:
    """Learns from at most ``sample`` labelled rows (lowest hash of the id first) of ids whose crc32
    modulo ``mod`` is not ``held``; their statistics, a few numbers a row, go to the driver. Of labels of
    one id that disagree the largest counts."""
    learn = labels.filter((fold(F.col(id_col), mod) != held) & F.col("quality").isNotNull() & F.col(id_col).isNotNull())
    learn = learn.select(F.col(id_col).alias("_id"), F.col("quality").cast("int").alias("_y")).groupBy("_id").agg(F.max("_y").alias("_y"))
    # labels of ids that the documents have not take no place in the sample
    present = docs.select(F.col(id_col).alias("_id")).distinct()
    learn = learn.join(present, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    stats = statistics(F.col("text"))
    rows = docs.select(F.col(id_col).alias("_id"), "text").join(F.broadcast(learn), "_id")
    got = rows.select("_id", "_y", *(stats[n].alias(n) for n in NAMES)).toPandas().sort_values(["_id", *NAMES])
    return RuleModel.fit(got[NAMES].to_numpy(float), got["_y"].to_numpy(float))


def score_quality(docs: DataFrame, model: RuleModel) -> DataFrame:
    """Adds ``score`` (0 to 1) to the input rows, without Python on the executors.

    Defined cases: null and empty texts have the statistics of no words and are scored by the same
    rules; an input column named score is replaced; repeated rows score alike; texts are read whole;
    an empty table stays empty; without labels the score is 0.5.
    """
    docs = docs.drop("score")
    stats = statistics(F.col("text"))
    rows = docs.withColumn("_s", F.struct(*(stats[n].alias(n) for n in NAMES)))
    return rows.withColumn("score", model.column({n: F.col("_s")[n] for n in NAMES})).drop("_s")
