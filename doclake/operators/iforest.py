"""Isolation forest (Liu, Ting, Zhou 2008) as Spark jobs.

Training looks at a hash sample whose size depends on the forest only; each tree grows in
its own task from at most ``max_samples`` rows. Scoring is a pass over all rows with the
forest broadcast. The forest has at most ``n_trees * (2 * max_samples - 1)`` nodes, a
bound that does not depend on the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from doclake.functions.text import ML_FEATURES
from doclake.operators.quantile import exact_quantile
from doclake.session import written

MAX_NODES = 2_000_000  # 48 bytes each: what scoring sends to every task stays below 100 MB
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double"


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of n keys."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def sample_trees(rows: DataFrame, key: str, n_rows: int, n_trees: int, max_samples: int, seed: int) -> DataFrame:
    """Rows with a ``tree`` column: ``max_samples`` rows per tree (all, if there are fewer), drawn
    without replacement and for each tree on its own.

    A tree takes the rows with the smallest hashes of (key, tree). Rows above a cut are left
    out before the shuffle; the cut lets eight standard deviations more than ``max_samples``
    rows pass, so every tree is filled. The draw does not depend on partitioning, and a
    retried task picks the same rows.
    """
    share = min(1.0, (max_samples + 8 * math.sqrt(max_samples) + 32) / n_rows)
    space = 1 << 40

    def draw(tree):
        return F.pmod(F.xxhash64(F.col(key), tree, F.lit(seed)), F.lit(space))

    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: draw(t) < F.lit(int(share * space)))
    picked = rows.select("*", F.explode(trees).alias("tree"))
    order = Window.partitionBy("tree").orderBy(draw(F.col("tree")), F.col(key))
    return picked.withColumn("_order", F.row_number().over(order)).where(F.col("_order") <= max_samples)


def _grower(features: list[str], max_depth: int, seed: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_order")
        tree, x = int(pdf["tree"].iloc[0]), pdf[features].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        nodes, todo = [None], [(0, np.arange(len(x)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            usable = np.flatnonzero(low < high)
            if depth == max_depth or len(usable) == 0:
                nodes[node] = (tree, node, -1, 0.0, node, node, depth + expected_path(len(rows)))
                continue
            f = int(rng.choice(usable))
            cut = float(rng.uniform(low[f], high[f]))
            goes_left = x[rows, f] <= cut
            nodes[node] = (tree, node, f, cut, len(nodes), len(nodes) + 1, 0.0)
            todo += [(len(nodes), rows[goes_left], depth + 1), (len(nodes) + 1, rows[~goes_left], depth + 1)]
            nodes += [None, None]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])

    return grow


@dataclass
class IsolationForest:
    features: list[str]
    nodes: pd.DataFrame
    n_trees: int
    max_samples: int
    max_depth: int
    contamination: float
    offset: float | None = None

    def scores(self, df: DataFrame) -> DataFrame:
        """The frame with ``raw_score`` = -2^(-mean path / expected path); low is unusual."""
        if len(self.nodes) > MAX_NODES:
            raise ValueError(f"a forest of {len(self.nodes)} nodes is too large to send to every task (at most {MAX_NODES})")
        nodes = self.nodes.sort_values(["tree", "node"])
        starts = nodes.groupby("tree", sort=True).size().cumsum().shift(fill_value=0)
        base = nodes["tree"].map(starts).to_numpy()
        flat = {
            "roots": starts.to_numpy(),
            "feature": nodes["feature"].to_numpy(), "threshold": nodes["threshold"].to_numpy(),
            "left": nodes["left"].to_numpy() + base, "right": nodes["right"].to_numpy() + base,
            "path": nodes["path"].to_numpy(),
        }
        forest = df.sparkSession.sparkContext.broadcast(flat)
        depth, scale = self.max_depth, expected_path(self.max_samples) or 1.0

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            t = forest.value
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            at = np.repeat(t["roots"][None, :], len(x), axis=0)
            rows = np.arange(len(x))[:, None]
            for _ in range(depth):
                f = t["feature"][at]
                inner = f >= 0
                if not inner.any():
                    break
                left = x[rows, np.where(inner, f, 0)] <= t["threshold"][at]
                at = np.where(inner, np.where(left, t["left"][at], t["right"][at]), at)
            return pd.Series(-np.exp2(-t["path"][at].mean(axis=1) / scale))

        return df.withColumn("raw_score", score(*[F.col(f) for f in self.features]))

    def predict(self, df: DataFrame) -> DataFrame:
        """The frame with ``anomaly_score`` (below 0 is unusual) and ``anomaly`` (-1 or 1)."""
        return self._label(self.scores(df))

    def _label(self, scored: DataFrame) -> DataFrame:
        decision = F.col("raw_score") - F.lit(self.offset)
        return scored.withColumn("anomaly_score", decision).withColumn(
            "anomaly", F.when(decision < 0, -1).otherwise(1)
        ).drop("raw_score")

    def save(self, spark: SparkSession, path: str) -> None:
        meta = [(self.features, self.n_trees, self.max_samples, self.max_depth, self.contamination, self.offset)]
        spark.createDataFrame(
            meta, "features array<string>, n_trees int, max_samples int, max_depth int, contamination double, offset double"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters")
        spark.createDataFrame(self.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "IsolationForest":
        m = spark.read.parquet(f"{path}/parameters").first()
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        return cls(list(m["features"]), nodes, m["n_trees"], m["max_samples"], m["max_depth"], m["contamination"], m["offset"])


def fit(df: DataFrame, features: list[str] | None = None, key: str = "data_id", n_trees: int = 100,
        max_samples: int = 256, contamination: float = 0.1, seed: int = 42) -> tuple[IsolationForest, DataFrame]:
    """Fit the forest and return it with the labelled rows: key, anomaly_score, anomaly."""
    features = list(features or ML_FEATURES)
    # The features are narrow and read three times, the texts behind them are wide: write once.
    rows = written(df.select(key, *features), "forest-features")
    n_rows = rows.count()
    if n_rows == 0:
        raise ValueError("no rows to train on")
    size = min(max_samples, n_rows)
    depth = max(1, math.ceil(math.log2(max(size, 2))))
    sample = sample_trees(rows, key, n_rows, n_trees, size, seed)
    nodes = sample.groupBy("tree").applyInPandas(_grower(features, depth, seed), NODE_SCHEMA).toPandas()
    forest = IsolationForest(features, nodes, n_trees, size, depth, contamination)
    # The scores are written once: the threshold needs several passes, over this column alone.
    scored = written(forest.scores(rows).select(key, "raw_score"), "forest-scores")
    forest.offset = exact_quantile(scored, "raw_score", contamination)
    return forest, forest._label(scored)


def anomaly_detection(df: DataFrame, **parameters) -> DataFrame:
    return fit(df, **parameters)[1]


def anomaly_count(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.count_if(F.col("anomaly") == -1).alias("anomalies"), F.count("*").alias("total"))
