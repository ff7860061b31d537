"""One global ranking from pairwise verdicts: ties and first-position effect, penalised Newton.

Model (Davidson's ties with an order effect): with log-strengths b, the weights of the outcomes of "i shown first
against j" are  first wins: exp(b_i + h),  second wins: exp(b_j),  tie: exp(t + (b_i + b_j + h) / 2).
Minus log-likelihood plus ``ridge/2 * |b|^2`` is convex in (b, h, t); Newton with step halving finds its minimum. The ridge
fixes the scale (mean near 0) and gives models that are compared hardly ever, or that always win, finite strengths.

The table is reduced to counts per (first, second, outcome) by one partial aggregation; only these are sent to the driver,
after a check that there are at most ``max_models`` models (K models give at most 3*K^2 counts). A count touches four parameters,
so the driver holds a few dozen numbers per count and one K x K matrix: some 150 MB for 400 fully compared models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spellings of the verdicts after trimming and lower case (fixed values).
FIRST, SECOND, TIE = ("a",), ("b",), ("tie",)


#: Rows: first wins, second wins, tie; columns: strength of the first, of the second, first position, tie.
DESIGN = np.array([[1, 0, 1, 0], [0, 1, 0, 0], [0.5, 0.5, 0.5, 1]])


def verdicts(df: DataFrame, key: str = "id", a: str = "model_a", b: str = "model_b", pref: str = "human_pref", at: str = "voted_at") -> DataFrame:
    """(a, b, outcome) of each valid comparison: the latest vote of every id; names without case and outer or doubled blanks.

    Out go: verdicts other than a, b, tie (null, ``skip``, ``both bad``, ...), a model against itself, null or blank names. The
    latest vote counts even where it is invalid (a withdrawn vote). Rows with a null id are comparisons of their own."""
    name = lambda c: F.nullif(F.lower(F.trim(F.regexp_replace(F.col(c), r"\s+", " "))), F.lit(""))
    said = F.lower(F.trim(pref))
    outcome = F.when(said.isin(*FIRST), 1).when(said.isin(*SECOND), 2).when(said.isin(*TIE), 3)
    rows = df.select(F.col(key).alias("k"), name(a).alias("a"), name(b).alias("b"), outcome.alias("outcome"), F.col(at).alias("at"))
    latest = F.max_by(F.struct("a", "b", "outcome"), F.struct("at", F.coalesce("outcome", F.lit(0)), "a", "b"))
    kept = rows.where(F.col("k").isNotNull()).groupBy("k").agg(latest.alias("r")).select("r.*")
    kept = kept.unionByName(rows.where(F.col("k").isNull()).select("a", "b", "outcome"))
    return kept.where(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("outcome").isNotNull() & (F.col("a") != F.col("b")))


def comparison_counts(df: DataFrame, **names: str) -> DataFrame:
    return verdicts(df, **names).groupBy("a", "b", "outcome").agg(F.count("*").alias("n"))


def fit(i: np.ndarray, j: np.ndarray, outcome: np.ndarray, n: np.ndarray, k: int, ridge: float = 0.1, tol: float = 1e-10, most: int = 100) -> tuple[np.ndarray, np.ndarray, int]:
    """Strengths b[k], then h (first position) and t (tie); standard errors; steps. No comparisons: all 0."""
    # each count touches four parameters only: b_i, b_j, h and t; DESIGN says how they enter the three outcomes
    at = np.stack([i, j, np.full(len(n), k), np.full(len(n), k + 1)], 1)
    cells = (at[:, :, None] * (k + 2) + at[:, None, :]).ravel()
    pen = np.r_[np.full(k, ridge), 1e-3, 1e-3]
    p, steps = np.zeros(k + 2), 0
    chosen = DESIGN[outcome - 1]

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        u = p[at] @ DESIGN.T
        top = u.max(1, keepdims=True)
        lse = top[:, 0] + np.log(np.exp(u - top).sum(1))
        return float((n * (lse - (chosen * p[at]).sum(1))).sum() + 0.5 * (pen * p * p).sum()), np.exp(u - lse[:, None])

    value, q = loss(p)
    hess = np.diag(pen)
    for steps in range(1, most + 1):
        mean = q @ DESIGN
        grad = np.bincount(at.ravel(), (n[:, None] * (mean - chosen)).ravel(), k + 2) + pen * p
        own = np.einsum("ro,oa,ob->rab", q, DESIGN, DESIGN, optimize=True) - mean[:, :, None] * mean[:, None, :]
        hess = np.bincount(cells, (n[:, None, None] * own).ravel(), (k + 2) ** 2).reshape(k + 2, k + 2) + np.diag(pen)
        step = np.linalg.solve(hess, grad)
        if abs(grad @ step) < tol:
            break
        size = 1.0
        while size > 1e-8 and (new := loss(p - size * step))[0] > value:
            size /= 2
        p, (value, q) = p - size * step, new
    return p, np.sqrt(np.diag(np.linalg.inv(hess))), steps


def rank_models(df: DataFrame, ridge: float = 0.1, max_models: int = 400, **names: str) -> DataFrame:
    """(model, strength, std_error, win_probability, n_compared, rank) of all models that occur in valid comparisons.

    ``strength`` is centred to mean 0; ``win_probability`` is that of a decisive win over an average model without position
    effect. Equal strengths share a rank. Empty input: empty result. More than ``max_models`` models: ValueError."""
    spark = df.sparkSession
    counts = comparison_counts(df, **names)
    schema = "model string, strength double, std_error double, win_probability double, n_compared long, rank int"
    rows = counts.limit(3 * max_models * max_models + 1).toPandas()
    models = sorted(set(rows["a"]) | set(rows["b"])) if len(rows) else []
    if len(models) > max_models:
        raise ValueError(f"{len(models)} models; the counts of at most {max_models} are fitted on the driver")
    if not models:
        return spark.createDataFrame([], schema)
    at = {m: z for z, m in enumerate(models)}
    i, j = (rows[c].map(at).to_numpy() for c in "ab")
    n = rows["n"].to_numpy().astype(float)
    # a fixed order of the counts, so that sums come out the same whatever the partitioning
    order = np.lexsort((rows["outcome"], j, i))
    p, se, _ = fit(i[order], j[order], rows["outcome"].to_numpy()[order], n[order], len(models), ridge)
    b = p[: len(models)] - p[: len(models)].mean()
    compared = np.bincount(i, n, len(models)) + np.bincount(j, n, len(models))
    b = np.round(b, 6)
    rank = [int((b > x).sum()) + 1 for x in b]
    out = [(m, float(b[z]), round(float(se[z]), 6), round(float(1 / (1 + np.exp(-b[z]))), 6), int(compared[z]), rank[z]) for z, m in enumerate(models)]
    return spark.createDataFrame(out, schema)
