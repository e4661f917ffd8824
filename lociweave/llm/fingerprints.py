r"""Operator 12, fingerprints of documents by invertible Bloom lookup sketches.

A paragraph is a line, or a sentence of one; its digest is a 64-bit hash. The fingerprint of a text has three rows of WIDTH cells. Every distinct digest goes to one
cell of each row, which keeps how many it has got, their exclusive or, and that of their 32-bit check hashes. Taken cell by cell, the difference of two
fingerprints is the sketch of the paragraphs that only one of the texts has: what both have cancels out. A cell with one digest left shows it by its check hash; it
is taken out of its other cells, which may free the next one, until nothing is left. The number of digests recovered gives the share of common paragraphs
(Jaccard), and is exact. If cells remain, both texts are sketched anew in as many tables as keep LOAD digests in each on average, and a table that still
doesn't come apart is sketched larger, with other places. What the last size in GROWTH can't tell is compared digest by digest.

The main path is made of DataFrame functions. The next document's text comes from one window over ranges of doc_id: ranges are cut at approximate quantiles, the
first document of each range also goes to the range before it, so texts are shuffled once and no task gets more than a range. The driver holds two numbers for
each range, of which there are as many as shuffle partitions.

Defined results: a null text is an empty one, without paragraphs; two texts without paragraphs are alike by 1. A null doc_id comes first; rows with one doc_id
follow each other by a hash of their text. The next document of the last is the first, of a single one itself. An empty table gives an empty one. Other columns stay,
but for those that are replaced by the added ones of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociweave.llm.common import unused

#: Cells of each of the three rows of a fingerprint; a power of two, 16 at most.
WIDTH = 16
#: Digests that a table gets at most on average, of both texts, when a comparison is tried again, and the cells of its rows, one size after the other.
LOAD, GROWTH = 6, (8, 16, 32)
#: Ends of sentences, at whose space a line is cut.
ENDS = ".!?"
ADDED = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with value bound to a lambda's variable, so that it is worked out once however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs, in order."""
    for end in ENDS:
        text = F.replace(text, F.lit(f"{end} "), F.lit(f"{end}\n"))
    return F.sort_array(F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: x != ""), lambda x: F.xxhash64(x))))


def places(keys: Column, width: int = WIDTH, salt: int = 0) -> Column:
    """(key, check, a, b, c) of digests: a cell of each of three rows of so many cells."""
    bits = width.bit_length() - 1

    def one(k: Column) -> Column:
        own = lambda h: F.struct(k.alias("key"), F.hash(k).alias("check"), *[F.shiftright(h, j * bits).bitwiseAND(F.lit(width - 1)).cast("int").alias(r) for j, r in enumerate("abc")])
        return let(F.xxhash64(k, F.lit(salt)), own)

    return F.transform(keys, one)



def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.alias("n"), key.alias("key"), check.alias("check"))


def _nothing() -> Column:
    return _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0))


def sketch(keys: Column, width: int = WIDTH, salt: int = 0, sign: Column | None = None) -> Column:
    """The cells of digests: three rows, one after the other. sign: of each digest; a sketch is linear, so the difference of two is that of all digests with their signs."""
    placed = places(keys, width, salt)
    if sign is not None:
        placed = F.zip_with(placed, sign, lambda e, q: e.withField("sign", q))
    one = (lambda e: e.sign) if sign is not None else lambda e: F.lit(1)

    def row(placed: Column, r: str) -> Column:
        gather = lambda s, e: _cell(s.n + one(e), s.key.bitwiseXOR(e.key), s.check.bitwiseXOR(e.check))
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(F.filter(placed, lambda e: e[r] == i), _nothing(), gather))

    return let(placed, lambda p: F.concat(*[row(p, r) for r in "abc"]))


def subtract(mine: Column, other: Column) -> Column:
    return F.zip_with(mine, other, lambda x, y: _cell(x.n - y.n, x.key.bitwiseXOR(y.key), x.check.bitwiseXOR(y.check)))


def peel(cells: Column, width: int = WIDTH, salt: int = 0) -> Column:
    """The digests (key, sign) that a difference of sketches holds, or null if it doesn't come apart. sign: 1 for the minuend's, -1 for the subtrahend's."""
    alone = lambda c: (F.abs(c.n) == 1) & (c.check == F.hash(c.key))

    def step(s: Column, _: Column) -> Column:
        pure = F.array_distinct(F.transform(F.filter(s.cells, alone), lambda c: F.struct(c.key.alias("key"), c.n.alias("sign"))))

        def take(p: Column) -> Column:
            at = F.zip_with(places(p["key"], width, salt), p, lambda e, q: F.struct(e.key.alias("key"), e.check.alias("check"), e.a.alias("a"), e.b.alias("b"), e.c.alias("c"), q.sign.alias("sign")))

            def out_of(e: Column) -> Column:
                drop = lambda r: lambda c, i: F.aggregate(F.filter(e, lambda x: x[r] == i), c, lambda s, x: _cell(s.n - x.sign, s.key.bitwiseXOR(x.key), s.check.bitwiseXOR(x.check)))
                rows = [F.transform(F.slice(s.cells, k * width + 1, width), drop(r)) for k, r in enumerate("abc")]
                return F.concat(*rows)

            return F.when(F.size(p) == 0, F.struct(s.cells.alias("cells"), s.found.alias("found"), F.lit(True).alias("done"))).otherwise(
                F.struct(let(at, out_of).alias("cells"), F.concat(s.found, p).alias("found"), F.lit(False).alias("done"))
            )

        return F.when(s.done, s).otherwise(let(pure, take))

    begin = F.struct(cells.alias("cells"), F.array().cast("array<struct<key: bigint, sign: int>>").alias("found"), F.lit(False).alias("done"))
    empty = lambda c: (c.n == 0) & (c.key == 0) & (c.check == 0)
    # every step but the last takes out a digest at least, of which fewer than cells are left when the table comes apart
    return F.aggregate(F.sequence(F.lit(1), F.lit(3 * width)), begin, step, lambda s: F.when(F.forall(s.cells, empty), s.found))


def difference(mine: Column, other: Column) -> Column:
    """The digests (key, sign) of only one of two sorted arrays of digests, by sketches of growing size."""

    def table(a: Column, b: Column) -> Column:
        signs = F.concat(F.array_repeat(F.lit(1), F.size(a)), F.array_repeat(F.lit(-1), F.size(b)))
        tries = [peel(sketch(F.concat(a, b), w, w, signs), w, w) for w in GROWTH]
        signed = lambda keys, sign: F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(sign).alias("sign")))
        return F.when(a == b, F.array().cast("array<struct<key: bigint, sign: int>>")).otherwise(F.coalesce(*tries, F.concat(signed(F.array_except(a, b), 1), signed(F.array_except(b, a), -1))))

    # dealt to side * side tables in two steps, so that a text of n paragraphs takes n * sqrt(n) comparisons
    def dealt(keys: Column, side: Column) -> Column:
        upto = F.sequence(F.lit(0).cast("long"), side - 1)
        part = lambda some, i, shift: F.filter(some, lambda k: F.pmod(F.shiftright(k, shift), side) == i)
        return F.flatten(F.transform(upto, lambda i: let(part(keys, i, 0), lambda own: F.transform(upto, lambda j: part(own, j, 32)))))

    side = F.greatest(F.ceil(F.sqrt((F.size(mine) + F.size(other)) / F.lit(LOAD))), F.lit(1))
    return let(side, lambda t: F.flatten(F.zip_with(dealt(mine, t), dealt(other, t), table)))


def likeness(mine: Column, other: Column) -> Column:
    """The Jaccard index of two texts' digests; a text: (keys, cells)."""
    differ = F.coalesce(F.size(peel(subtract(mine.cells, other.cells))), F.size(difference(mine["keys"], other["keys"])))
    total = (F.size(mine["keys"]) + F.size(other["keys"])).cast("double")
    return let(differ, lambda d: F.when(total == 0, 1.0).otherwise((total - d) / (total + d)))


def sketched(keys: Column) -> Column:
    """(keys, cells) of a text's digests."""
    return let(keys, lambda k: F.struct(k.alias("keys"), sketch(k).alias("cells")))


def written(cells: Column) -> Column:
    """Cells as a string: the count, 16 and 8 hexadecimal digits for each that isn't empty, and a full stop behind each."""
    digits = lambda c: F.concat(c.n.cast("string"), F.lit(":"), F.lpad(F.hex(c.key), 16, "0"), F.lpad(F.hex(c.check.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.lower(F.array_join(F.transform(cells, lambda c: F.when(c.n == 0, "").otherwise(digits(c))), "."))


def fingerprint(docs: DataFrame) -> DataFrame:
    """docs with fingerprint, the written sketch of each text, and paragraphs, its distinct digests."""
    keep = [c for c in docs.columns if c.lower() not in ("fingerprint", "paragraphs")]
    own = let(sketched(digests(F.coalesce("text", F.lit("")))), lambda s: F.struct(written(s.cells).alias("fingerprint"), s["keys"].alias("paragraphs")))
    return docs.select(*keep, F.inline(F.array(own)))


def with_next(docs: DataFrame, out: str, *columns: str) -> DataFrame:
    """docs with a struct of the text and other columns of the next document by doc_id, the first one's behind the last."""
    bucket, guest, key, tie = unused(docs, "bucket", "guest", "key", "tie")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    cuts = sorted(set(docs.select(of.alias(key)).agg(F.percentile_approx(key, [k / n for k in range(1, n)] or [0.5], max(10_000, 10 * n))).first()[0] or ()))
    step = max(1, int(len(cuts) ** 0.5))
    numbers = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")
    below = lambda some: F.size(F.filter(some, lambda b: b <= F.col(key)))
    keyed = docs.withColumn(key, of)
    coarse = below(numbers(cuts[step - 1 :: step]))
    number = let(coarse, lambda c: c * step + below(F.slice(numbers(cuts), c * step + 1, step)))
    firsts = sorted(keyed.select(key, number.alias(bucket)).groupBy(bucket).agg(F.min(key)).collect())  # a row for each range
    least, before = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for k, (b, first) in enumerate(firsts):
        least[b], before[b] = first, firsts[k - 1][0]
    own = F.struct(number.alias(bucket), F.lit(False).alias(guest))
    ahead = let(number + 1, lambda b: F.when(F.element_at(numbers(least), b) == F.col(key), F.struct(F.element_at(numbers(before), b).cast("int").alias(bucket), F.lit(True).alias(guest))))
    # xxhash64 orders the rows of one doc_id; the first of a range stands behind all of the range before it
    rows = keyed.withColumn(tie, F.xxhash64("text")).select("*", F.inline(F.filter(F.array(own, ahead), lambda x: x.isNotNull())))
    w = W.partitionBy(bucket).orderBy(guest, key, tie)
    return rows.withColumn(out, F.lead(F.struct("text", *columns)).over(w)).filter(~F.col(guest)).drop(bucket, guest, key, tie)


def edit_and_compare(docs: DataFrame) -> DataFrame:
    """docs with n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next; the edited text has the next document's beginning as its last quarter."""
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    after, own = unused(docs, "next", "digests")
    # digests go with the texts, so that each text is cut once for itself and the document before it
    plain = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn(own, digests(F.col("text")))
    text, following = F.col("text"), F.col(after)
    quarter = F.floor(F.length(text) / 4).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following["text"], F.lit(1), quarter))

    def compare(x: Column) -> Column:
        return F.struct(
            F.length(text).cast("long").alias("n_chars"), F.sha2(x.edited, 256).alias("edited_sha256"), written(x.mine.cells).alias("fingerprint"), written(x.other.cells).alias("edited_fingerprint"),
            likeness(x.mine, x.other).alias("near_edited"), likeness(x.mine, x.following).alias("near_next"),
        )

    both = let(edited, lambda e: F.struct(e.alias("edited"), sketched(F.col(own)).alias("mine"), sketched(digests(e)).alias("other"), sketched(following[own]).alias("following")))
    return with_next(plain, after, own).select(*keep, F.inline(F.array(let(both, compare))))
