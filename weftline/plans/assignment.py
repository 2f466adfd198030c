"""One-to-one assignment of two small sets, of greatest total score."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(scores: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of greatest total score; scores are at least 0 and a pair of 0 is none.

    Shortest augmenting paths with potentials: each row in turn takes a column, over a path of exchanges if need be.
    """
    turned = scores.shape[0] > scores.shape[1]
    cost = -(scores.T if turned else scores)
    n, m = cost.shape
    over_row, over_column = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for i in range(n):
        distance, before, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, column, so_far = i, -1, 0.0
        while True:
            through = so_far + cost[row] - over_row[row] - over_column
            nearer = ~done & (through < distance)
            distance[nearer], before[nearer] = through[nearer], column
            column = int(np.argmin(np.where(done, np.inf, distance)))
            so_far, done[column] = distance[column], True
            if row_of[column] < 0:
                break
            row = row_of[column]
        inner = done.copy()
        inner[column] = False
        over_row[row_of[inner]] += so_far - distance[inner]
        over_column[inner] -= so_far - distance[inner]
        over_row[i] += so_far
        while column >= 0:
            earlier = before[column]
            row_of[column] = row_of[earlier] if earlier >= 0 else i
            column = earlier
    pairs = [(int(r), c) for c, r in enumerate(row_of) if r >= 0]
    pairs = [(c, r) for r, c in pairs] if turned else pairs
    return sorted((r, c) for r, c in pairs if scores[r, c] > 0)


def one_to_one(pairs: DataFrame, group: str, least: float) -> DataFrame:
    """(a, b, score) of an assignment within each group of pairs (group, a, b, score) of a score of ``least`` or more.

    A group is the endpoints, or the fields, of two services: thousands at most. Of equal totals names decide.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["a", "b"])
        a, b = pd.Index(rows["a"].unique()), pd.Index(sorted(rows["b"].unique()))
        scores = np.zeros((len(a), len(b)))
        scores[a.get_indexer(rows["a"]), b.get_indexer(rows["b"])] = rows["score"]
        found = assign(scores)
        return pd.DataFrame({"a": [a[i] for i, _ in found], "b": [b[j] for _, j in found], "score": [scores[i, j] for i, j in found]})

    worth = pairs.where(F.col("score") >= least).select(group, "a", "b", "score")
    return worth.groupBy(group).applyInPandas(run, "a string, b string, score double")


