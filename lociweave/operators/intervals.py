"""Joins of half-open intervals, and what stands on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.operators.loci import first_per_group
from lociweave.operators.scale import kept
from lociweave.schemas import AUTOSOMES


def _bins(start: str, end: str, size: int) -> Column:
    return F.explode(F.expr(f"sequence({start} div {size}, greatest({start}, {end} - 1) div {size})"))


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def bin_width(*sides: tuple[DataFrame, str, str]) -> int:
    """A bin size for intervals (table, start, end): the sum of their mean lengths.

    So the intervals of a side have at most two bins each on average, however long the longest are, and what shares a bin is mostly near enough to overlap.
    """
    means = [t.agg(F.avg(F.greatest(F.col(e) - F.col(s), F.lit(0)))).first()[0] for t, s, e in sides]
    return max(16, math.ceil(sum(m or 0 for m in means)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], how: str = "inner", bin_size: int | None = None) -> DataFrame:
    """Pairs whose intervals overlap, each once: an equality join on bins, and a pair counts in the bin where its overlap begins.

    Bins spread a chromosome's intervals over many tasks; an interval goes to each of its bins only. Without a size bins are about as long as the intervals
    (bin_width), so that few pairs are compared in vain.
    """
    bin_size = bin_size or bin_width((left, *l), (right, *r))
    a = left.withColumn("__bin", _bins(*l, bin_size))
    b = right.withColumn("__bin", _bins(*r, bin_size))
    if how == "left":
        # rows without a partner by their keys and interval, which decide; a row number could change when a lost task is run again
        inner = overlap_join(left, right, keys, l, r, bin_size=bin_size)
        found = overlap_join(left.select(*keys, *l).distinct(), right.select(*keys, *r).distinct(), keys, l, r, bin_size=bin_size).select(*keys, *l).distinct().alias("f")
        same = F.lit(True)
        for c in (*keys, *l):
            same &= F.col(f"x.{c}").eqNullSafe(F.col(f"f.{c}"))
        return inner.unionByName(left.alias("x").join(found, same, "left_anti"), allowMissingColumns=True)
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [
        F.col("a.__bin") == F.col("b.__bin"), F.col(f"a.{l[0]}") < F.col(f"b.{r[1]}"), F.col(f"b.{r[0]}") < F.col(f"a.{l[1]}"),
        F.expr(f"greatest(a.{l[0]}, b.{r[0]}) div {bin_size}") == F.col("a.__bin"),
    ]
    cond = on[0]
    for c in on[1:]:
        cond &= c
    rest = [c for c in right.columns if c not in keys]
    # a fixed number of tasks: few rows can make very many pairs, so partitions can't be put together by their size
    a, b = _dealt(a, *keys, "__bin"), _dealt(b, *keys, "__bin")
    return a.alias("a").join(b.alias("b"), cond, how).select(*[F.col(f"a.{c}") for c in left.columns], *[F.col(f"b.{c}") for c in rest])


def interval_mean(loci: DataFrame, signal: DataFrame, column: str, statistic: str = "mean", bin_size: int | None = None) -> DataFrame:
    """loci (locus_id, chrom, start, end, ...) with the signal over each: the mean over covered bases, the sum, or the max; 0 if none.

    signal: chrom, s_start, s_end, value, of disjoint intervals; where they overlap each counts. Equal intervals are summed up before they meet, on both sides, so
    the pairs are those of different places, however often each occurs.
    """
    at = ["chrom", "start", "end"]
    bin_size = bin_size or bin_width((loci, "start", "end"), (signal, "s_start", "s_end"))
    own = signal.groupBy("chrom", "s_start", "s_end").agg(F.sum("value").alias("__v"), F.max("value").alias("__m"), F.count("*").alias("__n"))
    found = overlap_join(loci.select(*at).distinct(), own, ["chrom"], ("start", "end"), ("s_start", "s_end"), bin_size=bin_size)
    width = (F.least("end", "s_end") - F.greatest("start", "s_start")).cast("double")
    value = {"mean": F.sum(F.col("__v") * width) / F.sum(F.col("__n") * width), "sum": F.sum(F.col("__v") * width), "max": F.max("__m")}[statistic]
    out = loci.join(found.groupBy(*at).agg(value.alias(column)), at, "left").select(*loci.columns, column)
    v = F.col(column)
    return out.withColumn(column, F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))


def bedgraph_summary(signal: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """records, covered_bases and weighted_sum of signal intervals, of all or by keys."""
    width = F.col("s_end") - F.col("s_start")
    return signal.groupBy(*(keys or [])).agg(F.count("*").alias("records"), F.sum(width).alias("covered_bases"), F.sum(width * F.col("value")).alias("weighted_sum"))


def liftover(loci: DataFrame, blocks: DataFrame, least: float = 0.95, unique: bool = False) -> DataFrame:
    """loci with mapped, mapped_chrom, mapped_start, mapped_end, mapped_strand and mapped_bases, by the blocks of chains between two assemblies.

    blocks: (chrom, b_start, b_end, to_chrom, to_start), both on the forward strand, with strand (forward if there is none), and with chain_id and score, which
    the blocks of a chain have in common; without chain_id each block is a chain. A chain maps a locus if its blocks hold at least this share of the bases; the
    target spans all of these, with the gaps between them. Of several chains that map a locus the one with the highest score counts, then the least chain_id; with
    unique such a locus stays unmapped, as does one that no chain maps.
    """
    have = {c.lower() for c in blocks.columns}
    whole = F.struct("chrom", "b_start", "b_end", "to_chrom", "to_start")
    own = blocks.select(
        "chrom", "b_start", "b_end", "to_chrom", F.col("to_start").alias("__t"), (F.col("strand") if "strand" in have else F.lit("+")).alias("__strand"),
        (F.col("chain_id") if "chain_id" in have else whole).alias("__chain"), (F.col("score") if "score" in have else F.lit(0)).cast("double").alias("__score"),
    )
    found = overlap_join(loci.select("locus_id", "chrom", "start", "end"), own, ["chrom"], ("start", "end"), ("b_start", "b_end"))
    a, b = F.greatest("start", "b_start"), F.least("end", "b_end")
    at = F.col("__t") + F.when(F.col("__strand") == "-", F.col("b_end") - b).otherwise(a - F.col("b_start"))
    chains = found.select("locus_id", "chrom", "start", "end", "to_chrom", "__strand", "__chain", "__score", at.alias("__from"), (b - a).alias("__n"))
    chains = chains.groupBy("locus_id", "chrom", "start", "end", "__chain", "to_chrom", "__strand", "__score").agg(F.sum("__n").alias("__n"), F.min("__from").alias("__from"), F.max(F.col("__from") + F.col("__n")).alias("__to"))
    enough = chains.filter(F.col("__n") >= F.lit(float(least)) * (F.col("end") - F.col("start")))
    best = enough.groupBy("locus_id", "chrom", "start", "end").agg(F.min(F.struct((-F.col("__score")).alias("s"), "__chain", "to_chrom", "__from", "__to", "__strand", "__n")).alias("m"), F.count("*").alias("__hits"))
    if unique:
        best = best.filter("__hits = 1")
    out = loci.join(best.drop("__hits"), ["locus_id", "chrom", "start", "end"], "left")
    return out.select(
        *loci.columns, F.col("m").isNotNull().alias("mapped"), F.col("m.to_chrom").alias("mapped_chrom"), F.col("m.__from").alias("mapped_start"),
        F.col("m.__to").alias("mapped_end"), F.col("m.__strand").alias("mapped_strand"), F.col("m.__n").alias("mapped_bases"),
    )


def cross_assembly_signal(loci: DataFrame, signal: DataFrame, blocks: DataFrame, sizes: DataFrame, column: str, assembly: str) -> DataFrame:
    """loci with the mean signal of another assembly over each one's place there, whether it has one, and the place.

    sizes: (chrom, size) of that assembly; a locus that isn't mapped, or beyond a chromosome's end, has nulls; one that is mapped but without signal 0.
    """
    moved = liftover(loci.select("locus_id", "chrom", "start", "end"), blocks).filter("mapped and mapped_start >= 0 and mapped_end > mapped_start")
    inside = moved.join(sizes.select(F.col("chrom").alias("mapped_chrom"), "size"), "mapped_chrom").filter("mapped_end <= size")
    places = inside.select("locus_id", F.col("mapped_chrom").alias("chrom"), F.col("mapped_start").alias("start"), F.col("mapped_end").alias("end"))
    means = interval_mean(places, signal, column)
    own = means.select("locus_id", F.col(column).alias(column), F.lit(True).alias(f"{column}_mapped"), *[F.col(c).alias(f"{column}_{assembly}_{c}") for c in ("chrom", "start", "end")])
    return loci.join(own, "locus_id", "left").withColumn(f"{column}_mapped", F.coalesce(f"{column}_mapped", F.lit(False)))


def _by_place(places: DataFrame, things: DataFrame, bin_size: int | None) -> DataFrame:
    """(chrom, start, end, g): for each place, rows of genes of the things (chrom, a_start, a_end, genes) that overlap it, summed up where things cover its start.

    What overlaps a place covers its first base or begins behind it. The first depends on the start alone, which places of many lengths share.
    """
    whole, width = ["chrom", "start", "end"], ("a_start", "a_end")
    size = bin_size or bin_width((places, "start", "end"), (things, *width))
    have = {f.name for f in things.schema["genes"].dataType.elementType.fields}
    real, odd = F.col("end") > F.col("start"), F.col("a_end") > F.col("a_start")
    points = places.filter(real).select("chrom", "start").distinct().withColumn("end", F.col("start") + 1)
    cover = overlap_join(points, things.filter(odd), ["chrom"], ("start", "end"), width, bin_size=size).select("chrom", "start", F.explode("genes").alias("g"))
    sums = [F.sum("g.n").alias("n"), *([F.max("g.loop_score").alias("loop_score")] if "loop_score" in have else [])]
    cover = cover.groupBy("chrom", "start", "g.gene").agg(*sums)
    cover = _dealt(places.filter(real), "chrom", "start").join(_dealt(cover, "chrom", "start"), ["chrom", "start"]).select(*whole, F.struct("gene", *[c for c in ("n", "loop_score") if c in cover.columns]).alias("g"))
    rest = places.filter(real).select("chrom", (F.col("start") + 1).alias("s"), "end").filter("s < end")
    starts = things.filter(odd).withColumn("a_end", F.col("a_start") + 1)
    inner = overlap_join(rest, starts, ["chrom"], ("s", "end"), width, bin_size=size).select("chrom", (F.col("s") - 1).alias("start"), "end", F.explode("genes").alias("g"))
    # an empty interval overlaps what has it inside
    empty = [overlap_join(x, y, ["chrom"], ("start", "end"), width, bin_size=size).select(*whole, F.explode("genes").alias("g")) for x, y in ((places.filter(~real), things), (places.filter(real), things.filter(~odd)))]
    return cover.unionByName(inner).unionByName(empty[0]).unionByName(empty[1])


def link_loci_to_promoters(loci: DataFrame, promoters: DataFrame, loops: DataFrame, bin_size: int | None = None) -> DataFrame:
    """(gene, locus_id, direct, loop_count, loop_score): promoter overlaps, and links through either side of a loop.

    loop_count counts all rows of a link, the direct one too. Each loop is followed once in either direction.

    Single links are never made into rows: each step works on different places with counts and best scores by gene. Promoters give the genes of a loop's far anchor,
    these the genes of each near anchor, and these, with the direct ones, the genes of each locus's place, which its loci have in common.
    """
    at, near, far, loop = ["chrom", "start", "end"], ["a_chrom", "a_start", "a_end"], ["f_chrom", "f_start", "f_end"], ["chrom", "start", "end"]
    p = promoters.groupBy("chrom", "promoter_start", "promoter_end", "gene").agg(F.count("*").alias("n"))
    p = p.groupBy("chrom", "promoter_start", "promoter_end").agg(F.collect_list(F.struct("gene", "n")).alias("genes"))
    places = loci.groupBy("locus_id", *at).agg(F.count("*").alias("copies"))
    own = loci.select(*at).distinct()
    ends = loops.groupBy(*[f"{c}{k}" for k in "12" for c in loop]).agg(F.count("*").alias("copies"), F.max("loop_score").alias("loop_score"))
    both = [ends.select(*[F.col(f"{c}{k}").alias(n) for k, names in ((a, near), (b, far)) for c, n in zip(loop, names)], "copies", "loop_score") for a, b in ("12", "21")]
    both = both[0].unionByName(both[1])
    bins = bin_size or bin_width((promoters, "promoter_start", "promoter_end"), (loops, "start1", "end1"))
    anchors = both.select(*far).distinct().withColumnRenamed("f_chrom", "chrom")
    at_far = overlap_join(anchors, p, ["chrom"], ("f_start", "f_end"), ("promoter_start", "promoter_end"), bin_size=bins).withColumnRenamed("chrom", "f_chrom")
    at_far = at_far.select(*far, F.explode("genes").alias("g")).groupBy(*far, "g.gene").agg(F.sum("g.n").alias("n"))
    via = _dealt(both, *far).join(_dealt(at_far, *far), far).groupBy(*near, "gene").agg(F.sum(F.col("copies") * F.col("n")).alias("n"), F.max("loop_score").alias("loop_score"))
    via = kept(via.groupBy(F.col("a_chrom").alias("chrom"), "a_start", "a_end").agg(F.collect_list(F.struct("gene", "n", "loop_score")).alias("genes")))
    direct = _by_place(own, p.withColumnsRenamed({"promoter_start": "a_start", "promoter_end": "a_end"}), bin_size).select(*at, "g.gene", F.lit(True).alias("direct"), "g.n", F.lit(None).cast("double").alias("loop_score"))
    distal = _by_place(own, via, bin_size).select(*at, "g.gene", F.lit(False).alias("direct"), "g.n", F.col("g.loop_score").cast("double").alias("loop_score"))
    rows = direct.unionByName(distal)
    # as it is read twice
    found = kept(rows.groupBy(*at, "gene").agg(F.max("direct").alias("direct"), F.sum("n").alias("n"), F.max("loop_score").alias("loop_score")))
    # a locus of one place has that place's links, and only those of several are summed up
    ids = places.groupBy("locus_id").agg(F.count("*").alias("k"), F.min(F.struct(*at, "copies")).alias("p"))
    names = ["gene", "locus_id", "direct", (F.col("n") * F.col("copies")).alias("loop_count"), "loop_score"]
    one = ids.filter("k = 1").select("locus_id", "p.*")
    one = _dealt(one, *at).join(_dealt(found, *at), at).select(*names)
    some = ids.filter("k > 1").select(F.col("locus_id").alias("__id"))
    more = places.join(some, F.col("locus_id").eqNullSafe(F.col("__id")), "left_semi").join(found, at).select(*names)
    more = more.groupBy("gene", "locus_id").agg(F.max("direct").alias("direct"), F.sum("loop_count").alias("loop_count"), F.max("loop_score").alias("loop_score"))
    return one.unionByName(more).withColumn("loop_score", F.coalesce("loop_score", F.lit(0.0)))


def link_summary(links: DataFrame) -> DataFrame:
    return links.agg(F.count_if("direct").alias("direct_links"), F.count_if(~F.col("direct")).alias("distal_links"), F.count_distinct("gene").alias("genes"))


def strongest_linked_locus(links: DataFrame, loci: DataFrame) -> DataFrame:
    """Per gene the locus with the largest signal, of equal ones the least locus_id, and how many distinct loci it has."""
    both = links.join(loci.select("locus_id", "chip_mean_log1p"), "locus_id")
    counts = both.groupBy("gene").agg(F.count_distinct("locus_id").alias("linked_locus_count"))
    best = first_per_group(both, ["gene"], [F.desc("chip_mean_log1p"), F.asc("locus_id")])
    return best.join(counts, "gene")


def bedpe_anchors(loops: DataFrame, width: int = 5000) -> DataFrame:
    """Loops with both anchors set anew about their middle, not below zero, both on autosomes."""
    out = loops
    for n in ("1", "2"):
        start = F.greatest(F.expr(f"(start{n} + end{n}) div 2") - width // 2, F.lit(0))
        out = out.withColumn(f"__s{n}", start).drop(f"start{n}", f"end{n}").withColumnRenamed(f"__s{n}", f"start{n}").withColumn(f"end{n}", F.col(f"start{n}") + width)
    return out.filter(F.col("chrom1").isin(AUTOSOMES) & F.col("chrom2").isin(AUTOSOMES))


def assemble_features(loci: DataFrame, parts: list[DataFrame], fill: float = 0.0) -> DataFrame:
    """loci left-joined with tables unique on locus_id; missing and non-finite numbers become fill."""
    out = loci
    for part in parts:
        out = out.join(part, "locus_id", "left")
        for name, kind in part.dtypes:
            if kind in ("double", "float"):
                v = F.col(name)
                out = out.withColumn(name, F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), fill).otherwise(v))
    return out
