"""Directed pairs, smoothed rates and panels."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.operators.scale import at_ranks, spread

if TYPE_CHECKING:
    from pyspark.ml import Transformer

TARGETS = ("cooperative_signal", "composite_motif", "spacing_or_orientation")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("->"), b)


def directed_pairs(interactions: DataFrame, constructs: DataFrame) -> DataFrame:
    """Interactions of known constructs with both sides' family and sequence, the directed and the family pair's key; targets as 0 or 1."""
    side = lambda p: constructs.select(F.col("tf").alias(p), F.col("family").alias(f"{p}_family"), F.col("protein_sequence").alias(f"{p}_sequence"))
    out = interactions.join(side("bait"), "bait").join(side("prey"), "prey")
    return out.select(
        "bait", "prey", *[F.least(F.greatest(F.col(t).cast("int"), F.lit(0)), F.lit(1)).alias(t) for t in TARGETS],
        "bait_family", "prey_family", "bait_sequence", "prey_sequence", pair_key(F.col("bait"), F.col("prey")).alias("directed_pair"),
        F.concat(F.least("bait_family", "prey_family"), F.lit("|"), F.greatest("bait_family", "prey_family")).alias("family_pair"),
    )


def pair_summary(pairs: DataFrame, target: str = "cooperative_signal") -> DataFrame:
    """rows, positives, unique_tfs and directed_asymmetries, pairs whose two directions differ in the target."""
    a, b = pairs.select("bait", "prey", target), pairs.select(F.col("bait").alias("b2"), F.col("prey").alias("p2"), F.col(target).alias("t2"))
    differ = a.join(b, (a["bait"] == b["p2"]) & (a["prey"] == b["b2"])).filter((F.col("bait") < F.col("prey")) & (F.col(target) != F.col("t2")))
    tfs = pairs.select(F.explode(F.array("bait", "prey")).alias("tf")).agg(F.count_distinct("tf").alias("unique_tfs"))
    return pairs.agg(F.count("*").alias("rows"), F.sum(target).alias("positives")).crossJoin(F.broadcast(tfs)).crossJoin(F.broadcast(differ.agg(F.count("*").alias("directed_asymmetries"))))


def smoothed_rates(train: DataFrame, keys: list[str], target: str, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """(keys, rate): (sum + alpha) / (n + alpha + beta); null keys are a group."""
    return train.groupBy(*keys).agg(((F.sum(target) + alpha) / (F.count("*") + alpha + beta)).alias("rate"))


def apply_rates(df: DataFrame, train: DataFrame, keys: list[str], target: str, alpha: float = 1.0, beta: float = 1.0, out: str = "probability") -> DataFrame:
    """df with the group's smoothed rate, or the overall one for a group that isn't in training."""
    rates = smoothed_rates(train, keys, target, alpha, beta).withColumnsRenamed({k: f"__{k}" for k in keys})
    overall = train.agg(((F.sum(target) + alpha) / (F.count("*") + alpha + beta)).alias("__overall"))
    cond = F.lit(True)
    for k in keys:
        cond &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = df.join(rates, cond, "left").crossJoin(F.broadcast(overall))
    return joined.withColumn(out, F.coalesce("rate", "__overall")).drop("rate", "__overall", *[f"__{k}" for k in keys])


def partner_frequency(pairs: DataFrame, target: str) -> DataFrame:
    return pairs.filter(F.col(target) == 1).groupBy("prey").agg(F.count("*").alias("n"))


def eligible_panel(pairs: DataFrame, least: tuple[int, int, int] = (10, 5, 5)) -> DataFrame:
    """(tf, n_<target>): factors that reach each target's number of positives as bait or prey."""
    rows = pairs.select(F.explode(F.array_distinct(F.array("bait", "prey"))).alias("tf"), *TARGETS)
    counts = rows.groupBy("tf").agg(*[F.sum(F.col(t).cast("long")).alias(f"n_{t}") for t in TARGETS])
    cond = F.lit(True)
    for t, n in zip(TARGETS, least):
        cond &= F.col(f"n_{t}") >= n
    return counts.filter(cond)


def leave_one_out(pairs: DataFrame, tf: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): test has the pairs with the factor; an error if there are none."""
    test = with_factor(pairs, tf)
    if test.isEmpty():
        raise ValueError(f"no pair has {tf}")
    return pairs.filter((F.col("bait") != tf) & (F.col("prey") != tf)), test


def evaluable(interactions: DataFrame) -> DataFrame:
    """Tested interactions between two different known factors."""
    return interactions.filter(F.col("tested") & F.col("bait").isNotNull() & F.col("prey").isNotNull() & (F.col("bait") != F.col("prey")))


def is_positive(composite: Column, spacing: Column) -> Column:
    """Whether an interaction has a composite motif, or a spacing or orientation."""
    return F.coalesce(composite, F.lit(False)) | F.coalesce(spacing, F.lit(False))


def with_factor(pairs: DataFrame, tf: str) -> DataFrame:
    """The pairs with a factor on either side."""
    return pairs.filter((F.col("bait") == tf) | (F.col("prey") == tf))


def _drawn(value: Column, seed: int) -> Column:
    """What a seeded draw is ordered by: a hash that any engine can make."""
    return F.md5(F.concat(value.cast("string"), F.lit(f"|{seed}")))


def assign_split(pairs: DataFrame, by: str, fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """pairs with split 'train' or 'test': of the groups, max(1, round(n * fraction)) are drawn without replacement, those with the least seeded hashes.

    A pair is in the test split if any of its groups is drawn: itself, its pair of families, or either factor.
    """
    members = {"pair": ["directed_pair"], "family_pair": ["family_pair"], "tf": ["bait", "prey"]}[by]
    groups = pairs.select(F.explode(F.array(*members)).alias("g")).distinct().withColumn("h", _drawn(F.col("g"), seed))
    # the first 52 bits of the hashes, as numbers, give the n-th least; only those that share them with it are told apart by the whole hash
    own = groups.withColumn("u", F.conv(F.substr("h", F.lit(1), F.lit(13)), 16, 10).cast("double"))
    n = max(1, round(groups.count() * fraction))
    last = at_ranks(own, {"u": F.col("u")}, {("u", "all"): [n - 1]}, {"all": F.lit(True)})["u", "all", n - 1]
    ties = sorted((r.h, r.g) for r in own.filter(F.col("u") == last).collect())[: n - own.filter(F.col("u") < last).count()]
    held = own.filter((F.col("u") < last) | F.col("g").isin([g for _, g in ties])).select("g")
    out, hit = pairs, F.lit(False)
    for k, m in enumerate(members):
        out = out.join(held.select(F.col("g").alias(m), F.lit(True).alias(f"__{k}")), m, "left")
        hit |= F.coalesce(f"__{k}", F.lit(False))
    return out.withColumn("split", F.when(hit, "test").otherwise("train")).select(*pairs.columns, "split")


def random_split(df: DataFrame, key: str, shares: tuple[float, ...] = (0.7, 0.15, 0.15), names: tuple[str, ...] = ("train", "validation", "test"), seed: int = 0) -> DataFrame:
    """df with split, drawn for each row by a seeded hash of its key."""
    u = F.conv(F.substr(_drawn(F.col(key), seed), F.lit(1), F.lit(8)), 16, 10).cast("long") / float(1 << 32)
    out, upto = None, 0.0
    for name, share in list(zip(names, shares))[:-1]:
        upto += share
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return df.withColumn("split", out.otherwise(names[-1]) if out is not None else F.lit(names[-1]))


def unpivot_matrix(matrix: DataFrame, key: str, value: str = "value", name: str = "prey") -> DataFrame:
    """A wide matrix as rows (key, name, value), without nulls."""
    columns = [c for c in matrix.columns if c != key]
    return matrix.unpivot([key], columns, name, value).filter(F.col(value).isNotNull())


def parse_tokens(x: Column) -> Column:
    """struct<tested, composite, spacing, specificity> of a cell.

    '0' is tested and negative; N/A, self and null are untested; else comma-separated tokens begin with '1-' (composite) or '2-'
    (spacing), one of which is needed, and what follows the dash is the specificity.
    """
    s = F.lower(F.trim(x))
    no, zero = s.isNull() | s.isin("n/a", "self"), s == "0"
    tokens = F.filter(F.transform(F.split(s, ","), lambda t: F.trim(t)), lambda t: t != "")
    has = lambda p: F.coalesce(F.exists(tokens, lambda t: t.startswith(p)), F.lit(False))
    kinds = F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.substr(t, F.locate("-", t) + 1))))
    none = F.array().cast("array<string>")
    known = F.when(no | zero, none).when(has("1-") | has("2-"), kinds).otherwise(F.raise_error(F.lit("unrecognised interaction value")).cast("array<string>"))
    return F.struct((~no).alias("tested"), (has("1-") & ~no).alias("composite"), (has("2-") & ~no).alias("spacing"), known.alias("specificity"))


def protein_features(pairs: DataFrame, k: int = 2) -> DataFrame:
    """pairs with kmers: map of features of both sides, their absolute difference and product."""
    from lociweave.functions.pwm import kmer_columns

    def both(s: Column) -> Column:
        at = lambda m, key: F.coalesce(F.try_element_at(m, key), F.lit(0.0))
        keys = F.array_union(F.map_keys(s.a), F.map_keys(s.b))
        rows = F.transform(keys, lambda key: F.struct(key.alias("key"), at(s.a, key).alias("a"), at(s.b, key).alias("b")))
        part = lambda p, f: F.transform(rows, lambda r: F.struct(F.concat(F.lit(p), r.key).alias("key"), f(r.a, r.b).alias("value")))
        return F.map_from_entries(F.concat(part("a:", lambda x, _: x), part("b:", lambda _, y: y), part("d:", lambda x, y: F.abs(x - y)), part("p:", lambda x, y: x * y)))

    # both sides' maps are bound to a lambda's variable, so that each is worked out once
    sides = F.struct(kmer_columns(F.col("bait_sequence"), k).alias("a"), kmer_columns(F.col("prey_sequence"), k).alias("b"))
    # a row becomes some hundred features, so that a file too small to be split is much work for one task
    return spread(pairs).withColumn("kmers", F.transform(F.array(sides), both)[0])


def fitted(stages: list, rows: DataFrame) -> Transformer:
    """A pipeline fitted to rows, as it is read back from the shared folder.

    What fit() gives holds a summary with the session, which can't go to tasks once anything in the session was observed.
    """
    from pyspark.ml import Pipeline, PipelineModel

    from lociweave.sources.writers import shared_folder

    Pipeline(stages=stages).fit(rows).write().save(at := shared_folder(rows.sparkSession))
    return PipelineModel.load(at)


def identity_baseline(train: DataFrame, test: DataFrame, target: str, c: float = 1.0) -> DataFrame:
    """test with probability by class-balanced logistic regression on both sides' factor and family."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = ["bait", "prey", "bait_family", "prey_family"]
    s = train.agg(F.count("*").alias("n"), F.sum(target).alias("p")).first()
    rows = train.withColumns({"__y": F.col(target).cast("double"), "__w": F.when(F.col(target) == 1, s.n / (2.0 * s.p)).otherwise(s.n / (2.0 * (s.n - s.p)))})
    steps = [
        StringIndexer(inputCols=names, outputCols=[f"__i_{n}" for n in names], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"__i_{n}" for n in names], outputCols=[f"__h_{n}" for n in names], dropLast=False),
        VectorAssembler(inputCols=[f"__h_{n}" for n in names], outputCol="__x"),
        LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", regParam=1 / (c * s.n), standardization=False, maxIter=200, probabilityCol="__p", predictionCol="__q", rawPredictionCol="__r"),
    ]
    return fitted(steps, rows).transform(test).select(*test.columns, vector_to_array("__p")[1].alias("probability"))
