"""Exact Shapley values of tree ensembles for every row of a table."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .iterate import shared_dir


@dataclass(frozen=True)
class Leaf:
    """A leaf's weighted value, the features on its way, the share of training weight that goes its way at all
    splits of each feature, and each feature's splits as (threshold, whether the way goes left)."""

    value: float
    features: tuple[int, ...]
    share: tuple[float, ...]
    splits: tuple[tuple[tuple[float, bool], ...], ...]


def node_table(model, spark) -> DataFrame:
    """The nodes of a fitted ensemble of pyspark.ml with their tree's weight: tree, node, its children, split, value and
    training weight. Read from the model's own saved form; categorical splits are refused."""
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weight = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias("treeID"), F.col("_3").alias("weight"))
    stats = F.col("impurityStats")
    if "Regression" in type(model).__name__ or "GBT" in type(model).__name__:
        value, cover = F.col("prediction"), stats[0]
    else:  # class weights: the leaf's share of class 1
        cover = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
        value = stats[1] / cover
    return nodes.join(F.broadcast(weight), "treeID").select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("split.numCategories").alias("categories"), value.alias("value"), cover.alias("cover"), "weight",
    )


def leaves_of(nodes: list) -> list[Leaf]:
    """All leaves of all trees; tree weights are multiplied in, averaged where they are votes."""
    trees: dict = {}
    for r in nodes:
        if r["left"] >= 0 and r["categories"] >= 0:
            raise ValueError("splits by category are not supported")
        trees.setdefault(r["tree"], {})[r["node"]] = r
    out: list[Leaf] = []
    for tree in trees.values():

        def walk(k: int, way: dict[int, tuple[float, tuple]], tree=tree) -> None:
            n = tree[k]
            if n["left"] < 0:
                parts = list(way.items())
                out.append(Leaf(n["weight"] * n["value"], tuple(f for f, _ in parts), tuple(s for _, (s, _) in parts), tuple(c for _, (_, c) in parts)))
                return
            for child, left in ((n["left"], True), (n["right"], False)):
                share, splits = way.get(n["feature"], (1.0, ()))
                part = tree[child]["cover"] / n["cover"] if n["cover"] else 0.0
                walk(child, way | {n["feature"]: (share * part, (*splits, (n["threshold"], left)))})

        walk(0, {})
    return out


def shapley(leaves: list[Leaf], x: np.ndarray) -> tuple[float, np.ndarray]:
    """The expected value, and each row's Shapley value of each feature, where a feature that is not known goes both
    ways by training weight.

    A leaf's value with the known features S is v * prod(S: hit) * prod(others: share); summed over all orders with
    the coefficients of the polynomial prod(share + hit * t), which takes depth^3 steps a leaf for all rows together.
    """
    out = np.zeros(x.shape)
    base = 0.0
    for leaf in leaves:
        d = len(leaf.features)
        base += leaf.value * math.prod(leaf.share)
        hit = np.ones((d, len(x)))
        for j, (f, splits) in enumerate(zip(leaf.features, leaf.splits, strict=True)):
            for threshold, left in splits:
                hit[j] *= (x[:, f] <= threshold) == left
        for i in range(d):
            poly = np.zeros((d, len(x)))
            poly[0] = 1.0
            for size, j in enumerate(j for j in range(d) if j != i):
                poly[1 : size + 2] = poly[1 : size + 2] * leaf.share[j] + poly[: size + 1] * hit[j]
                poly[0] *= leaf.share[j]
            orders = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
            out[:, leaf.features[i]] += leaf.value * (hit[i] - leaf.share[i]) * (orders @ poly)
    return base, out


def tree_shap(model, columns: list[str], rows: DataFrame, key: str = "account_id") -> DataFrame:
    """``key``, base_value (the ensemble's mean raw score over its training weight) and one column per feature.

    The values of a row and base_value add up to the model's raw score of it: the margin of boosted trees, the mean
    share of class 1 of a forest. Nulls and NaN count as 0. The trees (bounded by the model's size) are sent
    to all tasks; rows are worked on in batches where they lie.
    """
    nodes = node_table(model, rows.sparkSession).collect()  # at most trees * 2^(depth + 1) rows
    leaves = leaves_of(nodes)
    if "Forest" in type(model).__name__:
        n = len({r["tree"] for r in nodes})
        leaves = [Leaf(v.value / n, v.features, v.share, v.splits) for v in leaves]
    sent = rows.sparkSession.sparkContext.broadcast(leaves)
    as_double = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns]
    schema = T.StructType([rows.schema[key], T.StructField("base_value", T.DoubleType()), *(T.StructField(c, T.DoubleType()) for c in columns)])

    def explain(batches):
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(columns))]) if batch.num_rows else np.zeros((0, len(columns)))
            base, values = shapley(sent.value, x)
            arrays = [batch.column(0), pa.array(np.full(len(x), base)), *(pa.array(values[:, j]) for j in range(len(columns)))]
            yield pa.RecordBatch.from_arrays(arrays, [key, "base_value", *columns])

    return rows.select(key, *as_double).mapInArrow(explain, schema)
