"""Leaky noisy-OR: maximum likelihood on pattern counts, and its bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_leaky_noisy_or(x: np.ndarray, y: np.ndarray, n: np.ndarray, start=None, rounds: int = 400, leaky: bool = True) -> tuple[float, np.ndarray, float]:
    """(leak, strengths, negative log likelihood) of P(y) = 1 - (1 - leak) prod (1 - p_i)^x_i.

    Newton-like steps on the logits with the exact gradient; a step that does not lower
    the loss is halved.
    """
    k = x.shape[1]
    theta = np.concatenate([[-2.5 if leaky else -30.0], np.full(k, -1.0)]) if start is None else np.array(start, float)

    def loss(t):
        p = 1 / (1 + np.exp(-t))
        log_not = np.log1p(-np.minimum(p, 1 - 1e-12))
        s = log_not[0] + x @ log_not[1:]
        prob = np.clip(1 - np.exp(s), 1e-12, 1 - 1e-12)
        value = -(n * np.where(y, np.log(prob), np.log1p(-prob))).sum()
        # d loss / d s, and d s / d theta = -p
        ds = n * np.where(y, (1 - prob) / prob, -1.0)
        grad = np.concatenate([[(ds * -p[0]).sum()], (ds[:, None] * x * -p[1:]).sum(0)])
        curve = np.concatenate([[(np.abs(ds) * p[0] ** 2).sum()], (np.abs(ds)[:, None] * x * p[1:] ** 2).sum(0)]) + np.abs(grad) * 0.5 + 1e-6
        if not leaky:
            grad[0] = 0
        return value, grad, curve

    value, grad, curve = loss(theta)
    step = 1.0
    for _ in range(rounds):
        move = np.clip(-grad / curve, -2, 2)
        new = theta + step * move
        v, g, c = loss(np.clip(new, -30, 30))
        if v <= value:
            gain, theta, value, grad, curve = value - v, np.clip(new, -30, 30), v, g, c
            step = min(1.0, step * 1.5)
            if gain < 1e-10 * max(1, abs(value)):
                break
        else:
            step /= 2
            if step < 1e-8:
                break
    p = 1 / (1 + np.exp(-theta))
    return float(p[0]), p[1:], float(value)


def target_patterns(presence: DataFrame, records: DataFrame, target: str, factors: list[str]) -> DataFrame:
    """(bits, y, n): distinct presence patterns of ``factors`` with the target, at most 2**(k+1) rows."""
    bits = [F.max((F.col("factor_type") == f).cast("int")).alias(f"f{i}") for i, f in enumerate(factors)]
    per = records.select("record_id").join(presence.filter(F.col("factor_type").isin([*factors, target])), "record_id", "left").groupBy("record_id").agg(F.max((F.col("factor_type") == target).cast("int")).alias("y"), *bits)
    per = per.na.fill(0)
    return per.groupBy("y", *[f"f{i}" for i in range(len(factors))]).agg(F.count("*").alias("n"))


def fit_target(presence: DataFrame, records: DataFrame, target: str, factors: list[str], draws: int = 0, seed: int = 1) -> pd.DataFrame:
    """Leak and strengths with bootstrap intervals, and base rates of the factors with those of the same redraws; the patterns are a small table whatever the records are."""
    pdf = target_patterns(presence, records, target, factors).toPandas().sort_values([*[f"f{i}" for i in range(len(factors))], "y"])
    x, y, n = pdf[[f"f{i}" for i in range(len(factors))]].to_numpy(float), pdf.y.to_numpy() == 1, pdf.n.to_numpy(float)
    leak, p, nll = fit_leaky_noisy_or(x, y, n)
    rows = [("leak", leak, nll)] + [(f, float(v), nll) for f, v in zip(factors, p, strict=True)]
    out = pd.DataFrame(rows, columns=["factor", "p", "nll"])
    out["base"] = [None, *(n @ x / n.sum()).tolist()]
    if draws:
        logit = np.log(np.clip(np.concatenate([[leak], p]), 1e-9, 1 - 1e-9))
        logit = logit - np.log1p(-np.exp(logit))

        def refit(tables):
            for table in tables:
                found = []
                for draw in table.id.tolist():
                    redrawn = np.random.default_rng([seed, draw]).multinomial(int(n.sum()), n / n.sum()).astype(float)
                    a, b, _ = fit_leaky_noisy_or(x, y, redrawn, start=logit, rounds=60)
                    found.append([a, *b.tolist(), *(redrawn @ x / redrawn.sum()).tolist()])
                yield pd.DataFrame({"fitted": found})

        spark = presence.sparkSession
        spread = spark.range(0, draws, 1, min(draws, 24)).mapInPandas(refit, "fitted array<double>")
        found = np.array([r.fitted for r in spread.collect()])
        low, high = np.percentile(found, 2.5, axis=0), np.percentile(found, 97.5, axis=0)
        fitted = len(p) + 1
        out["low"], out["high"] = low[:fitted], high[:fitted]
        out["base_low"], out["base_high"] = [None, *low[fitted:]], [None, *high[fitted:]]
    return out
