"""Discrimination that two densities allow: out-of-fold log ratio of Gaussian kernel densities of the classes, binned.

Points are counted in the cells of a grid; a kernel density of all folds but one is what
the smoothed grid of all leaves without that of the fold, so a bandwidth is one small
task over the occupied cells, and the number of points only shows in the counting.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import counted_table, score_summary
from .shared import once
from .stats import folds

#: Cells of a grid's side that a task may hold; a wider range needs a coarser grid.
SIDE = 4096


def density_error(bandwidth: float, fineness: int) -> float:
    """How far a binned density of the plane can be off, as a share of the kernel's peak: points and places move by half a cell's diagonal each."""
    return math.sqrt(2) / fineness * math.exp(-0.5)


def density_ratio(rows: DataFrame, x: str, y: str, label: str, key: str, bandwidths: tuple[float, ...] = (0.5, 1.0, 2.0, 3.0), k: int = 5, fineness: int = 8) -> DataFrame:
    """(bandwidth, fold, label, cx, cy, n, score): cells with their points and the log ratio of the densities of the other folds.

    Cells are a bandwidth / ``fineness`` wide.  Rows without a label of 0 or 1 or without a
    place take no part.  A density below the smallest number counts as that.
    """
    known = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(label).cast("int").alias("label"))
    dealt = folds(known, "label", key, k).select("fold", "label", "x", "y")
    each = dealt.withColumn("bandwidth", F.explode(F.array(*[F.lit(float(b)) for b in bandwidths])))
    cells = each.groupBy("bandwidth", "fold", "label", F.floor(F.col("x") * fineness / F.col("bandwidth")).alias("cx"), F.floor(F.col("y") * fineness / F.col("bandwidth")).alias("cy")).agg(F.count("*").alias("n"))

    def scored(pdf: pd.DataFrame) -> pd.DataFrame:
        low = pdf.cx.min(), pdf.cy.min()
        i, j = (pdf.cx - low[0]).to_numpy(), (pdf.cy - low[1]).to_numpy()
        sides = int(i.max()) + 1, int(j.max()) + 1
        if max(sides) > SIDE:
            raise ValueError(f"a grid of {sides} cells is larger than {SIDE} a side")
        kernels = [np.exp(-0.5 * ((np.arange(s)[:, None] - np.arange(s)[None, :]) / fineness) ** 2) for s in sides]
        label, fold, n = pdf.label.to_numpy(), pdf.fold.to_numpy(), pdf.n.to_numpy(float)
        score = np.zeros(len(pdf))
        for c, sign in ((1, 1.0), (0, -1.0)):
            for f in np.unique(fold):
                own = (label == c) & (fold != f)
                grid = np.zeros(sides)
                np.add.at(grid, (i[own], j[own]), n[own])
                dense = kernels[0] @ grid @ kernels[1]
                here = fold == f
                score[here] += sign * np.log(np.maximum(dense[i[here], j[here]] / max(1.0, n[own].sum()), 1e-300))
        return pdf.assign(score=score)

    return cells.groupBy("bandwidth").applyInPandas(scored, "bandwidth double, fold int, label int, cx long, cy long, n long, score double")


def density_ratio_auc(rows: DataFrame, x: str, y: str, label: str, key: str, bandwidths: tuple[float, ...] = (0.5, 1.0, 2.0, 3.0), k: int = 5, fineness: int = 8) -> DataFrame:
    """(bandwidth, n_pos, n_neg, auc, low, high, peak_error) of the out-of-fold log density ratio."""
    cells = once(density_ratio(rows, x, y, label, key, bandwidths, k, fineness))
    of = lambda c: F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0))
    counts = cells.groupBy("bandwidth", "score").agg(of(1).alias("p"), of(0).alias("n_"))
    found = score_summary(counted_table(counts.withColumnRenamed("n_", "n"), "bandwidth"), "bandwidth")
    return found.select("bandwidth", "n_pos", "n_neg", "auc", "low", "high", F.lit(density_error(1.0, fineness)).alias("peak_error"))
