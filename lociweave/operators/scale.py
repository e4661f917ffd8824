"""Total orders without a single task."""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rank error of the sketches that brackets are made of, as a share; distinct values in brackets that the driver takes at once.
ERROR, MOST = 1e-4, 200_000


def kept(df: DataFrame) -> DataFrame:
    """df as files in the shared folder: what is costly to work out and read several times is worked out once, and survives a lost executor."""
    from lociweave.sources.writers import shared_folder

    at = shared_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over two tasks for each core: for rows that cost much more than they weigh, as a table of few row groups is read by as few tasks, whatever its splits."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def _buckets(df: DataFrame, value: str, buckets: int | None) -> Column:
    """The number of a value's range among ranges cut at approximate quantiles, some for each shuffle partition."""
    n = buckets or max(64, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(df.approxQuantile(value, [k / n for k in range(1, n)], 0.25 / n)))
    if not cuts:
        return F.lit(0)
    # two steps of the square root's size each
    step = math.isqrt(len(cuts)) or 1
    array = lambda values: F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")
    v = F.col(value).cast("double")
    below = lambda some: F.size(F.filter(some, lambda e: e <= v))
    coarse = F.transform(F.array(below(array(cuts[step - 1 :: step]))), lambda c: c * step + below(F.slice(array(cuts), c * step + 1, step)))
    return F.coalesce(coarse[0], F.lit(-1))


def running_sums(df: DataFrame, value: str, columns: dict[str, str], descending: bool = False, buckets: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """df with running sums over the order of a number: {result: summed column}, each inclusive of its row; with keys, within these.

    The order is cut at approximate quantiles into buckets; each bucket of each key is summed on its own, after the sums of the key's buckets
    before it, so that neither a key nor the whole is in one task. value must be unique within keys, as after a groupBy.
    """
    keys = keys or []
    bucket = _buckets(df, value, buckets)
    dealt = df.withColumn("__b", (-bucket if descending else bucket))
    sums = dealt.groupBy(*keys, "__b").agg(*[F.sum(c).alias(f"__t_{r}") for r, c in columns.items()])
    # a row for each bucket of each key
    before = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*keys, "__b", *[F.coalesce(F.sum(f"__t_{r}").over(before), F.lit(0)).alias(f"__s_{r}") for r in columns])
    own = W.partitionBy(*keys, "__b").orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(W.unboundedPreceding, 0)
    if keys:
        starts = starts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__c"), *[f"__s_{r}" for r in columns])
        same = F.col("__b") == F.col("__c")
        for i, k in enumerate(keys):
            same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
        out = dealt.join(starts, same)
    else:
        out = dealt.join(F.broadcast(starts), "__b")
    return out.select(*df.columns, *[(F.col(f"__s_{r}") + F.sum(c).over(own)).alias(r) for r, c in columns.items()])


def positions(df: DataFrame, group: list[str], order: list[str], index: str, total: str, buckets: int | None = None) -> DataFrame:
    """df with each row's place in its group, from 0, and the group's size.

    The first column of order is a number; order ends in a unique key. Rows are numbered within ranges of that number, after the rows of
    the group's ranges before, so a group needs no task of its own.
    """
    dealt = df.withColumn("__b", _buckets(df, order[0], buckets))
    counts = dealt.groupBy(*group, "__b").agg(F.count("*").alias("__n"))
    every = W.partitionBy(*group)
    starts = counts.select(*group, "__b", F.coalesce(F.sum("__n").over(every.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__s"), F.sum("__n").over(every).alias(total))
    own = W.partitionBy(*group, "__b").orderBy(*order)
    out = dealt.join(starts, [*group, "__b"])
    return out.select(*df.columns, (F.col("__s") + F.row_number().over(own) - 1).alias(index), total)


def at_ranks(df: DataFrame, columns: dict[str, Column], wanted: dict[tuple[str, str], list[int]], parts: dict[str, Column], sizes: dict[tuple[str, str], int] | None = None) -> dict[tuple[str, str, int], float]:
    """The values at ranks, from 0, of several columns' values that aren't null, in several parts of the rows: {(column, part, rank): value}.

    One aggregate of sketches brackets every rank by two values; a second counts what lies below the brackets, and a third the distinct values in them. Brackets
    that hold more than MOST values together are bracketed anew among their own values, so the driver never takes more.
    """
    names, conds = list(columns), list(parts)
    rows = df.select(*[c.cast("double").alias(f"v{i}") for i, c in enumerate(columns.values())], *[c.alias(f"c{j}") for j, c in enumerate(parts.values())])
    sizes = sizes or part_sizes(df, columns, parts)
    value = {k: F.when(F.col(f"c{conds.index(k[1])}"), F.col(f"v{names.index(k[0])}")) for k in wanted}
    # neighbouring ranks share a bracket: [column and part, ranks, its ends, how many values lie below it and in it]
    brackets: list[list] = []
    for k, ranks in wanted.items():
        for r in sorted(ranks):
            if brackets and brackets[-1][0] == k and r - brackets[-1][1][0] <= 1:
                brackets[-1][1].append(r)
            else:
                brackets.append([k, [r], (-math.inf, math.inf), 0, sizes[k]])
    before = math.inf
    while True:
        # one sketch for all brackets among the same values
        spans: dict[tuple, list] = {}
        for x in brackets:
            spans.setdefault((x[0], x[2]), []).append(x)
        aggregates = []
        for n, ((k, (low, high)), own) in enumerate(spans.items()):
            v = value[k] if (low, high) == (-math.inf, math.inf) else F.when((value[k] >= low) & (value[k] <= high), value[k])
            ends = [min(1.0, max(0.0, (r - x[3]) / max(1, x[4] - 1) + e)) for x in own for r, e in ((x[1][0], -2 * ERROR), (x[1][-1], 2 * ERROR))]
            aggregates += [F.percentile_approx(v, ends, int(1 / ERROR)).alias(f"q{n}"), F.min(v).alias(f"l{n}"), F.max(v).alias(f"h{n}")]
        got = rows.agg(*aggregates).first()
        for n, own in enumerate(spans.values()):
            for m, x in enumerate(own):
                first, last = ((r - x[3]) / max(1, x[4] - 1) for r in (x[1][0], x[1][-1]))
                x[2] = (got[f"l{n}"] if first <= 2 * ERROR else got[f"q{n}"][2 * m], got[f"h{n}"] if last >= 1 - 2 * ERROR else got[f"q{n}"][2 * m + 1])
        counts = rows.agg(*[f(value[x[0]]).alias(f"{a}{n}") for n, x in enumerate(brackets) for low, high in [x[2]] for a, f in (("b", lambda v, low=low: F.count_if(v < low)), ("w", lambda v, low=low, high=high: F.count_if(v.between(low, high))))]).first()
        for n, x in enumerate(brackets):
            x[3], x[4] = counts[f"b{n}"], counts[f"w{n}"]
        near = {c: F.lit(False) for c in names}
        for (c, p), _, (low, high), *_ in brackets:
            near[c] |= value[c, p].between(low, high)
        long = F.explode(F.array_compact(F.array(*[F.when(near[c], F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v"))) for i, c in enumerate(names)])))
        found = rows.select(long.alias("x"), *[f"c{j}" for j in range(len(conds))]).groupBy("x.i", "x.v").agg(*[F.count_if(f"c{j}").alias(f"n{j}") for j in range(len(conds))])
        few = found.limit(MOST + 1).collect()
        if len(few) <= MOST:
            break
        if (now := sum(x[4] for x in brackets)) >= before:  # as narrow as they get
            few = found.collect()
            break
        before = now
    by: dict[int, list] = {}
    for r in few:
        by.setdefault(r["i"], []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r["v"])
    lists = {i: [r["v"] for r in own] for i, own in by.items()}
    out = {}
    for (c, p), ranks, (low, high), below, _ in brackets:
        if low == high:
            out |= {(c, p, r): low for r in ranks}
            continue
        i, j, left = names.index(c), f"n{conds.index(p)}", list(ranks)
        for r in by[i][bisect_left(lists[i], low) :]:
            below += r[j]
            while left and below > left[0]:
                out[c, p, left.pop(0)] = r["v"]
            if not left:
                break
    return out


def part_sizes(df: DataFrame, columns: dict[str, Column], parts: dict[str, Column]) -> dict[tuple[str, str], int]:
    """How many values that aren't null each column has in each part."""
    got = df.agg(*[F.count(F.when(p, c)).alias(f"{i}_{j}") for i, c in enumerate(columns.values()) for j, p in enumerate(parts.values())]).first()
    return {(c, p): got[f"{i}_{j}"] for i, c in enumerate(columns) for j, p in enumerate(parts)}


def few_valued(df: DataFrame, columns: dict[str, Column]) -> list[str]:
    """The columns with so few distinct values, by a sketch, that the driver can take all of them."""
    got = df.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns.values())]).first()
    return [n for i, n in enumerate(columns) if got[f"d{i}"] <= MOST // (4 * len(columns))]


def ranks_by_counts(df: DataFrame, columns: dict[str, Column], wanted: dict[tuple[str, str], list[int]], parts: dict[str, Column]) -> dict[tuple[str, str, int], float]:
    """at_ranks for columns of few distinct values: each value is counted in every part, in one job."""
    names, conds = list(columns), list(parts)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.cast("double").alias("v")) for i, c in enumerate(columns.values())]))
    rows = df.select(pairs.alias("x"), *[c.alias(f"c{j}") for j, c in enumerate(parts.values())]).filter(F.col("x.v").isNotNull())
    found = rows.groupBy("x.i", "x.v").agg(*[F.count_if(f"c{j}").alias(f"n{j}") for j in range(len(conds))]).collect()
    found.sort(key=lambda r: (math.isnan(r["v"]), r["v"]))
    out = {}
    for (c, p), ranks in wanted.items():
        i, j, below, left = names.index(c), f"n{conds.index(p)}", 0, sorted(ranks)
        for r in found:
            if r["i"] == i:
                below += r[j]
                while left and below > left[0]:
                    out[c, p, left.pop(0)] = r["v"]
    return out


def quantiles(df: DataFrame, column: str | Column, probabilities: list[float], parts: dict[str, Column] | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles, linearly interpolated, of a number's values that aren't null: {part: quantiles of the rows where its condition holds}.

    Without parts there is one, "all". A part without values has None for each.
    """
    return quantiles_of(df, {"v": column}, probabilities, parts)["v"]


def quantiles_of(df: DataFrame, columns: dict[str, str | Column], probabilities: list[float], parts: dict[str, Column] | None = None) -> dict[str, dict[str, list[float | None]]]:
    """The same of several columns, together: {column: {part: quantiles}}."""
    parts = parts or {"all": F.lit(True)}
    own = {n: F.col(c) if isinstance(c, str) else c for n, c in columns.items()}
    sizes = part_sizes(df, own, parts)
    at = {k: [p * (n - 1) for p in probabilities] for k, n in sizes.items() if n}
    ranks = {k: sorted({r for x in xs for r in (math.floor(x), math.ceil(x))}) for k, xs in at.items()}
    few = few_valued(df, own) if ranks else []
    value = {}
    for names, find in ((few, ranks_by_counts), ([n for n in own if n not in few], at_ranks)):
        if some := {k: r for k, r in ranks.items() if k[0] in names}:
            value |= find(df, {n: own[n] for n in names}, some, parts)

    def between(k: tuple[str, str], x: float) -> float:
        low, high = math.floor(x), math.ceil(x)
        a, b = value[*k, low], value[*k, high]
        return a if low == high or a == b else (high - x) * a + (x - low) * b

    return {c: {p: [between((c, p), x) for x in at[c, p]] if (c, p) in at else [None] * len(probabilities) for p in parts} for c in columns}
