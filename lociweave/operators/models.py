"""Nested models from distributed moments, residuals, and null tests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.operators.scale import positions, quantiles, quantiles_of

ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)


# --- residuals


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """The distinct interior edges of equal-frequency bins, exact and interpolated."""
    return _interior(quantiles(df, column, [k / bins for k in range(bins + 1)])["all"])


def _interior(q: list[float | None]) -> list[float]:
    return sorted(set(q) - {None})[1:-1]


def bin_of(column: str, edges: list[float]) -> Column:
    """How many interior edges are not above the value."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(column))) if edges else F.lit(0)


def binned_residuals(df: DataFrame, value: str, monomers: list[str], train: str, bins: int = 20, out: str = "residual") -> DataFrame:
    """value less the mean of the training rows in the same bins of all monomers, or their total mean where a bin has none."""
    training = df.filter(F.col(train))
    names = [f"__bin{i}" for i in range(len(monomers))]
    cuts = quantiles_of(training, {m: m for m in monomers}, [k / bins for k in range(bins + 1)])
    edges = [_interior(cuts[m]["all"]) for m in monomers]
    binned = df.withColumns({n: bin_of(m, e) for n, m, e in zip(names, monomers, edges)})
    means = binned.filter(F.col(train)).groupBy(*names).agg(F.avg(value).alias("__mean"))
    overall = training.agg(F.avg(value).alias("m")).first().m
    # at most bins ** len(monomers) rows
    joined = binned.join(F.broadcast(means) if bins ** len(monomers) <= 100_000 else means, names, "left")
    return joined.withColumn(out, F.col(value) - F.coalesce("__mean", F.lit(overall))).drop(*names, "__mean")


def cross_fitted_residuals(df: DataFrame, value: str, monomers: list[str], fold: str, bins: int = 20, out: str = "residual") -> DataFrame:
    """For every fold the residuals of its rows, learnt from the other folds' rows; all folds together in every pass."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    others = {str(i): F.col(fold) != k for i, k in enumerate(folds)}
    got = df.agg(*[F.avg(F.when(c, F.col(value))).alias(f"m{i}") for i, c in others.items()]).first() if folds else None
    cuts = quantiles_of(df, {m: m for m in monomers}, [k / bins for k in range(bins + 1)], others) if folds else {}
    edges = {(i, j): _interior(cuts[m][str(i)]) for i in range(len(folds)) for j, m in enumerate(monomers)}
    names = [f"__bin{j}" for j in range(len(monomers))]
    copies = F.explode(F.array(*[F.struct(F.lit(i).alias("__i"), F.lit(k).alias("__k"), *[bin_of(m, edges[i, j]).alias(names[j]) for j, m in enumerate(monomers)]) for i, k in enumerate(folds)]))
    spread = df.withColumn("__c", copies).select(*df.columns, "__c.*")
    means = spread.filter(F.col(fold) != F.col("__k")).groupBy("__i", *names).agg(F.avg(value).alias("__mean"))
    held = spread.filter(F.col(fold) == F.col("__k"))
    overall = F.coalesce(*[F.when(F.col("__i") == i, F.lit(got[f"m{i}"])) for i in range(len(folds))])
    joined = held.join(F.broadcast(means) if len(folds) * bins ** len(monomers) <= 100_000 else means, ["__i", *names], "left")
    return joined.withColumn(out, F.col(value) - F.coalesce("__mean", overall)).select(*df.columns, out)


# --- ridge regression from moments


def fold_moments(df: DataFrame, fold: str, features: list[str], outcome: str) -> DataFrame:
    """(fold, n, s_<i>, g_<i>_<j>): sums and products of features and outcome, from which every training set is summed up."""
    names = [*features, outcome]
    sums = [F.sum(c).alias(f"s_{i}") for i, c in enumerate(names)]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    return df.groupBy(F.col(fold).alias("fold")).agg(F.count("*").alias("n"), *sums, *products)


class Moments:
    """Counts, sums and products of one or more folds."""

    def __init__(self, n: float, s: np.ndarray, g: np.ndarray) -> None:
        self.n, self.s, self.g = n, s, g

    def __add__(self, o: Moments) -> Moments:
        return Moments(self.n + o.n, self.s + o.s, self.g + o.g)

    def only(self, at: list[int]) -> Moments:
        return Moments(self.n, self.s[at], self.g[np.ix_(at, at)])


def gram(df: DataFrame, keys: list[str], columns: list[str]) -> dict[tuple[int, ...], Moments]:
    """{keys: counts, sums and products of all columns}, for integer keys of which there are few combinations, in one job over the rows.

    Every task multiplies its blocks with NumPy and gives a row for each combination; these are summed by Spark. A null is an error.
    """
    k = len(columns)
    own = df.select(*[F.col(x).cast("long").alias(f"k{i}") for i, x in enumerate(keys)], *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            if any(x.null_count for x in batch.columns):
                raise ValueError("moments need values in all rows")
            of = np.stack([batch.column(i).to_numpy() for i in range(len(keys))]) if keys else np.zeros((0, batch.num_rows))
            x = np.stack([batch.column(len(keys) + i).to_numpy() for i in range(k)], axis=1)
            groups, at = np.unique(of, axis=1, return_inverse=True)
            for g in range(groups.shape[1]):
                rows = x[at.ravel() == g]
                m = sums.setdefault(tuple(groups[:, g].tolist()), [0, np.zeros(k), np.zeros((k, k))])
                m[0] += len(rows)
                m[1] += rows.sum(0)
                m[2] += rows.T @ rows
        if sums:
            yield pa.RecordBatch.from_pydict({"key": [list(g) for g in sums], "v": [np.concatenate(([n], s, g.ravel())) for n, s, g in sums.values()]}, pa.schema([("key", pa.list_(pa.int64())), ("v", pa.list_(pa.float64()))]))

    parts = own.mapInArrow(add, "key array<long>, v array<double>").select("key", F.posexplode("v").alias("i", "v"))
    out: dict[tuple, np.ndarray] = {}
    for r in parts.groupBy("key", "i").agg(F.sum("v").alias("v")).collect():  # 1 + k + k * k numbers for each combination
        out.setdefault(tuple(r.key), np.zeros(1 + k + k * k))[r.i] = r.v
    return {g: Moments(v[0], v[1 : k + 1], v[k + 1 :].reshape(k, k)) for g, v in out.items()}


def moments_by_fold(df: DataFrame, fold: str, features: list[str], outcome: str) -> dict[int, Moments]:
    return {g[0]: m for g, m in gram(df, [fold], [*features, outcome]).items()}


def ridge(m: Moments, alpha: float) -> tuple[np.ndarray, float, np.ndarray]:
    """(coefficients, intercept, standardised coefficients): standardised features, free intercept, penalty on the sum of squares."""
    mean = m.s / m.n
    cov = m.g - m.n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:-1] / m.n, 0))
    scale[scale == 0] = 1
    xx, xy = cov[:-1, :-1] / np.outer(scale, scale), cov[:-1, -1] / scale
    beta = np.linalg.solve(xx + alpha * np.eye(len(xx)), xy)
    return beta / scale, float(mean[-1] - (beta / scale) @ mean[:-1]), beta


def mse(m: Moments, coefficients: np.ndarray, intercept: float) -> float:
    w = np.append(-coefficients, 1.0)
    return float((w @ m.g @ w - 2 * intercept * (w @ m.s) + m.n * intercept**2) / m.n)


def _nested_fits(by: dict[int, Moments], baseline: int, added: int) -> tuple[dict[str, list], dict[str, list[float]], list[list[float]], dict[str, float]]:
    """Of each outer fold the models p0 and p1, their penalties, the added columns' standardised coefficients, and both held-out sums of squares."""
    folds = sorted(by)
    if folds != list(range(len(folds))) or len(folds) < 3:
        raise ValueError("folds must be 0, 1, 2, ... and three at least")
    sets = {"p0": [*range(baseline), baseline + added], "p1": list(range(baseline + added + 1))}
    fits: dict[str, list] = {"p0": [], "p1": []}
    chosen: dict[str, list[float]] = {"p0": [], "p1": []}
    squares = {"p0": 0.0, "p1": 0.0}
    coefficients = []
    for i in folds:
        check = (i + 1) % len(folds)
        train = None
        for k in folds:
            if k not in (i, check):
                train = by[k] if train is None else train + by[k]
        for name, at in sets.items():
            own, valid = train.only(at), by[check].only(at)
            losses = [mse(valid, *ridge(own, a)[:2]) for a in ALPHAS]
            alpha = ALPHAS[int(np.argmin(losses))]
            c, b, standard = ridge(own, alpha)
            fits[name].append((c, b))
            chosen[name].append(alpha)
            held = by[i].only(at)
            squares[name] += mse(held, c, b) * held.n
            if name == "p1":
                coefficients.append(standard[baseline:].tolist())
    return fits, chosen, coefficients, squares


def nested_from_moments(by: dict[int, Moments], baseline: int, added: int) -> dict:
    """The summary of nested models from moments alone, without predictions."""
    _, chosen, coefficients, squares = _nested_fits(by, baseline, added)
    n = sum(m.n for m in by.values())
    return {
        "n": int(n), "mse_m0": squares["p0"] / n, "mse_m1": squares["p1"] / n, "partial_r2": 1 - squares["p1"] / squares["p0"], "alphas_m0": chosen["p0"], "alphas_m1": chosen["p1"],
        "added_coefficients": coefficients, "median_added_coefficients": np.median(np.array(coefficients), axis=0).tolist(), "all_positive": all(x > 0 for r in coefficients for x in r),
    }


def _by_fold(fold: str, values: list[tuple[np.ndarray, float]], names: list[str], folds: list) -> Column:
    """For each row the linear prediction of its fold's (coefficients, intercept)."""
    out = None
    for i, (c, b) in zip(folds, values):
        p = F.lit(float(b))
        for w, f in zip(c, names):
            p = p + F.lit(float(w)) * F.col(f"`{f}`")
        out = F.when(F.col(fold) == i, p) if out is None else out.when(F.col(fold) == i, p)
    return out


def nested_outcomes(df: DataFrame, fold: str, baseline: list[str], added: list[str], outcomes: list[str]) -> tuple[DataFrame, dict[str, dict]]:
    """Chromosome-held-out M0 (baseline) and M1 (with added features) of several outcomes: out-of-fold predictions p0::<outcome> and p1::<outcome>, and a summary of each.

    Fold i is tested, fold i + 1 chooses alpha, the others train. One pass gives all moments of all outcomes, one more predicts.
    """
    features = [*baseline, *added]
    by = {g[0]: m for g, m in gram(df, [fold], [*features, *outcomes]).items()}
    fits, columns = {}, {}
    for j, outcome in enumerate(outcomes):
        fits[outcome] = _nested_fits({i: m.only([*range(len(features)), len(features) + j]) for i, m in by.items()}, len(baseline), len(added))
        for name, own in (("p0", baseline), ("p1", features)):
            columns[f"{name}::{outcome}"] = _by_fold(fold, fits[outcome][0][name], own, sorted(by))
    predicted = df.withColumns(columns)
    errors = predicted.agg(*[F.avg((F.col(f"`{o}`") - F.col(f"`{n}::{o}`")) ** 2).alias(f"{n}_{j}") for j, o in enumerate(outcomes) for n in ("p0", "p1")]).first()
    n = int(sum(m.n for m in by.values()))
    out = {}
    for j, o in enumerate(outcomes):
        _, chosen, coefficients, _ = fits[o]
        e0, e1 = errors[f"p0_{j}"], errors[f"p1_{j}"]
        out[o] = {
            "n": n, "mse_m0": e0, "mse_m1": e1, "partial_r2": 1 - e1 / e0, "alphas_m0": chosen["p0"], "alphas_m1": chosen["p1"],
            "added_coefficients": coefficients, "median_added_coefficients": np.median(np.array(coefficients), axis=0).tolist(), "all_positive": all(x > 0 for r in coefficients for x in r),
        }
    return predicted, out


def nested_continuous(df: DataFrame, fold: str, baseline: list[str], added: list[str], outcome: str) -> tuple[DataFrame, dict]:
    """The same of one outcome, with predictions p0 and p1."""
    predicted, summaries = nested_outcomes(df, fold, baseline, added, [outcome])
    return predicted.withColumnsRenamed({f"p0::{outcome}": "p0", f"p1::{outcome}": "p1"}), summaries[outcome]


def logistic_by_fold(df: DataFrame, fold: str, sets: dict[str, list[str]], outcome: str, c: float = 1.0, tolerance: float = 1e-9, most: int = 100) -> dict[str, dict]:
    """{set: {fold: (coefficients, intercept)}} of class-balanced logistic models on standardised features, each trained without a fold; for features as they are.

    Newton's method for all folds and sets at once: each step is one pass over the rows, in which every task sums gradients and Hessians. A step that raises a
    model's loss is halved. The penalty is half the sum of squared standardised coefficients over c, the intercept is free.
    """
    names = sorted({x for own in sets.values() for x in own})
    y, k = F.col(f"`{outcome}`").cast("double"), len(names)
    rows = df.select(F.col(fold).cast("long").alias("f"), y.alias("y"), *[F.col(f"`{x}`").cast("double").alias(f"x{i}") for i, x in enumerate(names)])
    by = {g[0]: m for g, m in gram(rows, ["f"], [*[f"x{i}" for i in range(k)], "y"]).items()}
    folds = sorted(by)
    total = None
    for m in by.values():
        total = m if total is None else total + m
    scale, weight = {}, {}
    for i in folds:
        n, s, g = total.n - by[i].n, total.s - by[i].s, total.g - by[i].g
        if not 0 < s[-1] < n:
            raise ValueError(f"the rows outside of fold {i} are of one class")
        mean = s[:-1] / n
        std = np.sqrt(np.maximum(np.diag(g)[:-1] / n - mean**2, 0))
        scale[i], weight[i] = (mean, np.where(std > 0, std, 1.0)), (n / (2 * (n - s[-1])), n / (2 * s[-1]))
    models = [(i, name, [names.index(x) for x in own]) for i in folds for name, own in sets.items()]
    at = [np.zeros(len(own) + 1) for _, _, own in models]
    step = [np.zeros(len(own) + 1) for _, _, own in models]
    loss = [np.inf] * len(models)

    def sums(now: list[np.ndarray]) -> list[np.ndarray]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = [np.zeros(1 + len(w) + len(w) ** 2) for w in now]
            for batch in batches:
                f, label = batch.column("f").to_numpy(), batch.column("y").to_numpy()
                x = np.stack([batch.column(f"x{j}").to_numpy() for j in range(k)], axis=1)
                for j, (i, _, own) in enumerate(models):
                    keep = f != i
                    mean, std = scale[i]
                    z = np.column_stack([(x[keep][:, own] - mean[own]) / std[own], np.ones(keep.sum())])
                    t, s = label[keep], np.where(label[keep] == 1, weight[i][1], weight[i][0])
                    eta = z @ now[j]
                    p = 0.5 * (1 + np.tanh(eta / 2))
                    out[j][0] += float(s @ (np.logaddexp(0, eta) - t * eta))
                    out[j][1 : 1 + len(now[j])] += z.T @ (s * (p - t))
                    out[j][1 + len(now[j]) :] += ((z.T * (s * p * (1 - p))) @ z).ravel()
            yield pa.RecordBatch.from_pydict({"m": pa.array(range(len(out)), pa.int32()), "v": pa.array(out, pa.list_(pa.float64()))})

        got = [np.zeros(1 + len(w) + len(w) ** 2) for w in now]
        parts = rows.mapInArrow(add, "m int, v array<double>").select("m", F.posexplode("v").alias("i", "v"))
        for r in parts.groupBy("m", "i").agg(F.sum("v").alias("v")).collect():
            got[r.m][r.i] = r.v
        return got

    for _ in range(most):
        moved = 0.0
        for j, got in enumerate(sums(at)):
            n = len(at[j])
            free = np.append(np.ones(n - 1), 0.0) / c
            value = got[0] + 0.5 * float(free @ at[j] ** 2)
            if value > loss[j] + 1e-12 * abs(loss[j]):
                step[j] = step[j] / 2
                at[j] = at[j] - step[j]
                moved = max(moved, float(np.abs(step[j]).max()))
                continue
            loss[j] = value
            step[j] = -np.linalg.solve(got[1 + n :].reshape(n, n) + np.diag(free), got[1 : 1 + n] + free * at[j])
            at[j] = at[j] + step[j]
            moved = max(moved, float(np.abs(step[j]).max()))
        if moved < tolerance:
            break
    out: dict[str, dict] = {name: {} for name in sets}
    for (i, name, own), w in zip(models, at):
        mean, std = scale[i]
        out[name][i] = (w[:-1] / std[own], float(w[-1] - (w[:-1] / std[own]) @ mean[own]))
    return out


def nested_binary(df: DataFrame, fold: str, baseline: list[str], added: list[str], outcome: str, c: float = 1.0) -> DataFrame:
    """Out-of-fold probabilities p0 and p1 of class-balanced logistic models on standardised features, each trained on the other folds."""
    sets = {"p0": sorted(baseline), "p1": sorted([*baseline, *added])}
    found = logistic_by_fold(df, fold, sets, outcome, c)
    columns = {}
    for name, own in sets.items():
        folds = sorted(found[name])
        columns[name] = 1 / (1 + F.exp(-_by_fold(fold, [found[name][i] for i in folds], own, folds)))
    return df.withColumns(columns)


# --- resampling


def stable_seed(*parts: object) -> int:
    h = hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8)
    return int.from_bytes(h.digest(), "big") % (2**32 - 1)


def sse_by_block(df: DataFrame, block: str, outcome: str, p0: str = "p0", p1: str = "p1") -> DataFrame:
    return df.groupBy(block).agg(F.sum((F.col(outcome) - F.col(p0)) ** 2).alias("sse0"), F.sum((F.col(outcome) - F.col(p1)) ** 2).alias("sse1"))


def coefficient_summary(coefficients: DataFrame) -> DataFrame:
    """(feature, folds, median, all_positive) of (fold, feature, coefficient)."""
    c = F.col("coefficient")
    return coefficients.groupBy("feature").agg(F.count("*").alias("folds"), F.percentile(c, F.lit(0.5)).alias("median"), F.bool_and(c > 0).alias("all_positive"))


def block_bootstrap(df: DataFrame, block: str, outcome: str, draws: int = 2000, seed: int = 0) -> dict[str, float]:
    """Percentiles of partial R2 over resampled blocks; the driver holds one row for each chromosome."""
    rows = sorted(sse_by_block(df, block, outcome).collect())
    return bootstrap_sse([r.sse0 for r in rows], [r.sse1 for r in rows], draws, seed)


def bootstrap_sse(sse0: list[float], sse1: list[float], draws: int, seed: int) -> dict[str, float]:
    s0, s1, rows = np.array(sse0), np.array(sse1), sse0
    at = np.random.default_rng(seed).integers(0, len(rows), (draws, len(rows)))
    r2 = 1 - s1[at].sum(1) / s0[at].sum(1)
    low, mid, high = np.percentile(r2, [2.5, 50, 97.5])
    return {"low": float(low), "median": float(mid), "high": float(high)}


def shift_within(df: DataFrame, group: list[str], order: list[str], columns: list[str], shifts: DataFrame) -> DataFrame:
    """df with columns rolled within groups: row i takes the values of row i - shift. shifts: (group..., shift)."""
    numbered = positions(df, group, order, "__i", "__n")
    moved = numbered.join(F.broadcast(shifts), group, "left").withColumn("__to", F.pmod(F.col("__i") + F.coalesce("shift", F.lit(0)), F.col("__n")))
    values = moved.select(*group, F.col("__to").alias("__i"), *columns)
    return numbered.drop(*columns, "__n").join(values, [*group, "__i"]).drop("__i")


def draw_shifts(sizes: dict[tuple, int], seed: int) -> dict[tuple, int]:
    """A shift from 1 to n - 1 for every group of two or more, in the order given."""
    rng = np.random.default_rng(seed)
    return {k: int(rng.integers(1, n)) for k, n in sizes.items() if n > 1}


def permutation_p(null: list[float], observed: float) -> float:
    return (sum(x >= observed for x in null) + 1) / (len(null) + 1)


#: The distribution function of Poisson weights of mean 1, at 0 to 7.
POISSON = np.cumsum([np.exp(-1) / np.prod(range(1, k + 1)) for k in range(8)])


def uniform(key: Column, draw: Column, seed: int = 0) -> Column:
    """A number from 0 to 1 for each integer key and draw, by steps of a multiplicative generator, in any engine's 64-bit arithmetic."""
    x = (key % 2147483647 * 48271 + (draw + 1) * 69621 + (seed + 1) * 16807) % 2147483647
    for m in (16807, 39373, 48271):
        x = ((x + 90211) * m) % 2147483647
    return x / F.lit(2147483647.0)


def bootstrap_mean(df: DataFrame, value: str, key: str, draws: int = 200, seed: int = 0) -> DataFrame:
    """median, low and high of the mean over Poisson bootstrap weights, which need no resampled copy; key is an integer column that tells rows apart."""
    copies = df.select(F.col(key).cast("long").alias("key"), F.col(value).alias("value"), F.explode(F.expr(f"sequence(0L, {draws - 1}L)")).alias("draw"))
    u = uniform(F.col("key"), F.col("draw"), seed)
    weight = sum((F.when(u >= float(s), 1).otherwise(0) for s in POISSON), F.lit(0))
    means = copies.groupBy("draw").agg((F.sum(weight * F.col("value")) / F.sum(weight)).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.5)).alias("median"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
