r"""Operator 5, MinHash near-dedup: fast similarity sketching, banding, exact verification.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Its sketch has BINS coordinates and is filled in
rounds: in round i < BINS every element goes to a hashed bin and each empty bin keeps the least value that fell into it;
in round BINS + j all elements go to bin j, so that no coordinate stays empty after 2 * BINS rounds. Most sets are full after one
or a few rounds. Coordinates agree with the probability of the sets' similarity, with concentration bounds.

Equal word sequences are one class, which its least doc_id stands for. Bands of ROWS coordinates put representatives
into buckets. A bucket isn't expanded into pairs: first each member meets the bucket's least doc_id, its hub, and links
are confirmed on full sets. Buckets whose members are in one component are settled. The members of the others form a group for each component of
hubs: those inside the component and those beside it. In arrays of bounded size, dealt over as many tasks as the group needs, those beside meet all the group's
members that aren't in their own component, by an index of shingles that gives exact intersections. Before that, groups
with more than FINER shingles beside the component are dealt to the buckets of a further, independent sketch, up to LEVELS times, where the same
steps find most links. Nothing is capped and no pair is left out by an estimate: what two documents that share a bucket have in common is always counted
on full sets, unless a component already holds both. Components of up to MOST_LINKS links are found in one task, those of more by alternating large-star and small-star
steps.

With 32 bands of 4 a pair of similarity 0.75 shares no bucket with probability 5e-6, at each level that it goes through.

Defined results: words are [^\x20\x09-\x0D]+ after A-Z are lower-cased; a text of fewer than 5 words has its whole sequence as one
shingle; a null, empty or wordless text has an empty set and is linked with nothing; of rows with the same doc_id
each has the component of its own text; a null doc_id counts as the smallest and is returned as null; an empty table gives an empty table; columns
besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import (
    bounded_batches, map_batches, materialise, mix, seq_hash, shingle_hashes, space_words, text_bytes, word_hashes,
)

SHINGLE = 5
BINS = 128
BITS = 7
ROWS = 4
#: Shingles of a group's members that one task indexes, 16 bytes each, and of those that it looks up: the least, and the most when a group would have several
#: blocks for every shuffle partition.
BLOCK, MOST_BLOCK = 1 << 15, 1 << 20
#: Shingles beside a group's component from which on a finer sketch comes first, and how often.
FINER, LEVELS = 1 << 22, 2
#: Rows of two or three numbers that may be broadcast, and links that one task may hold.
MOST_IDS, MOST_LINKS = 250_000, 4_000_000
NULL_ID = -(1 << 63)
_BASE = 0xC2B2AE3D27D4EB4F
_SEEDS = mix(np.arange(1, (2 << 10) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(shingle_hashes(word_hashes(words), SHINGLE, _BASE))


def sketch(elements: np.ndarray, bits: int = BITS) -> np.ndarray:
    """2 ** bits values, up to 2 ** 10; all filled if there is an element."""
    bins = 1 << bits
    out = np.full(bins, _EMPTY)
    if not len(elements):
        return out
    low, shift = np.uint64((1 << (64 - bits - 10)) - 1), np.uint64(64 - bits)
    for i in range(bins):
        v = mix(elements ^ _SEEDS[i])
        v.sort()
        fell = (v >> shift).astype(np.int64)
        first = np.flatnonzero(np.diff(fell, prepend=-1))
        at = fell[first]
        new = out[at] == _EMPTY
        out[at[new]] = (np.uint64(i) << np.uint64(64 - 10)) | (v[first[new]] & low)
        empty = np.flatnonzero(out == _EMPTY)
        if not len(empty):
            return out
    for j in empty:
        out[j] = (np.uint64(bins + j) << np.uint64(64 - 10)) | (mix(elements ^ _SEEDS[bins + j]) & low).min()
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, its number included."""
    x = values.reshape(-1, ROWS)
    key = mix(np.arange(1, len(x) + 1, dtype=np.uint64) * np.uint64(_BASE))
    for j in range(ROWS):
        key = mix(key ^ x[:, j]) * np.uint64(_BASE)
    return key


def _id() -> F.Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id")


def _words(text: bytes) -> list[bytes]:
    return space_words(text.lower())


def _sketched(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        n, seqs, keys = [], [], []
        for text in text_bytes(batch, "text"):
            words = _words(text)
            own = shingles(words)
            n.append(len(own))
            seqs.append(seq_hash(b" ".join(words)) if words else None)
            keys.append(bands(sketch(own)).view(np.int64) if words else None)
        return {"id": batch.column("id"), "n": n, "seq": seqs, "keys": keys}

    return map_batches(docs.select(_id(), "text"), run, "id long, n long, seq binary, keys array<long>")


def _bounded(ids: DataFrame, most: int = MOST_IDS) -> DataFrame:
    """A side to be joined: broadcast if its count, which is of bounded rows, allows that."""
    return F.broadcast(ids) if ids.count() <= most else ids


def _buckets(members: DataFrame) -> DataFrame:
    """(key, id, n, hub, size) of members (key, id, n) whose bucket has two or more; the hub is its least id.

    The counts are materialised, so that the join has two plain shuffles and adaptive execution can split a hot bucket's rows.
    """
    sizes = materialise(members.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("hub")).filter("size > 1"))
    return materialise(members.join(sizes, "key"))


def _sets(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, own): the shingles of these ids' texts, 8 bytes each; a bounded list of ids is broadcast, so that no text is shuffled."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column("id"), "own": [shingles(_words(t)).tobytes() for t in text_bytes(batch, "text")]}

    return materialise(map_batches(texts.join(_bounded(ids), "id", "left_semi"), run, "id long, own binary"))


def _similar(both, m, n):
    return 100 * both >= 75 * (m + n - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) those with 100 * intersection >= 75 * union.

    The partners of a hub are dealt by hash over several times as many parts as there are shuffle partitions, so that a hub with any number of
    partners is spread over all tasks; a part holds the hub's set and one other at a time.
    """
    parts = 4 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int").alias("part"))
    roles = dealt.select(F.col("a").alias("id"), "a", "part", F.lit(0).alias("role")).distinct().unionByName(
        dealt.select(F.col("b").alias("id"), "a", "part", F.lit(1).alias("role"))
    )

    def compare(batches):
        key, hubs = None, []
        for batch in batches:
            out_a, out_b = [], []
            for a, part, role, doc, own in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "role", "id", "own"))):
                own = np.frombuffer(own, np.uint64)
                if (a, part) != key:
                    key, hubs = (a, part), []
                if role == 0:
                    hubs.append(own)
                    continue
                if any(_similar(len(np.intersect1d(hub, own, assume_unique=True)), len(hub), len(own)) for hub in hubs if len(own)):
                    out_a.append(a)
                    out_b.append(doc)
            if out_a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    ordered = roles.join(sets, "id").select("a", "part", "role", "id", "own").repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return ordered.mapInArrow(compare, "a long, b long")


def components(links: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """(id, component): for each id in links (a, b) that isn't least among those that it reaches, the least.

    Up to so many links fit one task, 16 bytes each; more go through large-star and small-star steps in turn, each of which writes fewer.
    """
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n = edges.count()
    while n > most and not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        n = edges.count()
    if n > most:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))

    def solve(batches):
        got = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if got:
            u, v = (np.concatenate([x[k] for x in got]) for k in (0, 1))
            ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            least = _least(at[: len(u)], at[len(u) :], len(ids))
            moved = np.flatnonzero(least != np.arange(len(ids)))
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids[moved], pa.int64()), "component": pa.array(ids[least[moved]], pa.int64())})

    return materialise(edges.coalesce(1).mapInArrow(solve, "id long, component long"))


def _least(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For 0..n-1 the least number that each reaches over the links (u, v)."""
    to = np.arange(n)
    while True:
        a, b = to[u], to[v]
        if (a == b).all():
            return to
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while (to[to] != to).any():
            to = to[to]


def _are_stars(edges: DataFrame) -> bool:
    """Whether each id below another has one edge (u, v), u > v, and none that leads to it."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out")), F.struct(F.col("v").alias("x"), F.lit(0).alias("out")))).alias("e"))
    by = ends.select("e.x", "e.out").groupBy("x").agg(F.sum("out").alias("out"), F.count("*").alias("n"))
    return by.filter("out > 1 or (out = 1 and n > 1)").isEmpty()


def _apart(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """(g, id, n, component, inside): members of buckets that hold more than one component.

    g is the component of a bucket's hub, and a member is inside or beside it. All buckets with hubs of one component are one group, so that a member meets
    it once, however many buckets they share.
    """
    of = buckets.filter("size > 2").join(_bounded(comps), "id", "left").withColumn("component", F.coalesce("component", "id"))
    spread = of.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.when(F.col("id") == F.col("hub"), F.col("component"))).alias("g")
    )
    spread = materialise(spread.filter("lo < hi").select("key", "g"))
    of = of.join(_bounded(spread), "key")
    return materialise(of.select("g", "id", "n", "component", (F.col("component") == F.col("g")).alias("inside")).distinct())


def _meet(ids: np.ndarray, component: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links between the rows at left and those at right whose components differ; components linked meanwhile count as one.

    The left shingles are an index, in which each right set finds its intersections with all left sets at once. A set is passed over if less
    than three quarters of it occur in other sets there, as it can't reach the threshold.
    """
    n = np.array([len(x) for x in sets], np.int64)
    flat, owner = np.concatenate([sets[x] for x in left]), np.repeat(left, n[left])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    is_left = np.zeros(len(ids), np.int64)
    is_left[left] = 1
    links = []
    for y in right:
        low, high = np.searchsorted(flat, sets[y], "left"), np.searchsorted(flat, sets[y], "right")
        m = high - low
        if 100 * np.count_nonzero(m > is_left[y]) < 75 * n[y]:
            continue
        at = np.repeat(low - np.cumsum(m) + m, m) + np.arange(m.sum())
        both = np.bincount(owner[at], minlength=len(ids))
        for x in np.flatnonzero(_similar(both, n, n[y]) & (both > 0) & (component != component[y])):
            if component[x] != component[y]:
                links.append((int(ids[x]), int(ids[y])))
                component[component == component[x]] = component[y]
    return links


def _met(roles: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the members of a group that stand beside it and all of its members, of rows (g, id, n, component, inside).

    Those inside are dealt over `rows` blocks, those beside over `cols` blocks; each block inside meets each beside in one task, and each two blocks beside in another. A
    group whose few others stand beside a large component copies only these.
    """
    many = 4 * int(roles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inner, outer = F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n")))
    blocks = roles.groupBy("g").agg(inner.alias("rows"), outer.alias("cols"))
    block = F.greatest(F.lit(BLOCK), F.least(F.lit(MOST_BLOCK), (F.col("rows") + F.col("cols")) / many))
    blocks = materialise(blocks.select("g", *(F.ceil((F.col(x) + 1) / block).cast("int").alias(x) for x in ("rows", "cols"))))
    dealt = roles.join(_bounded(blocks), "g").withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("inside"), F.col("rows")).otherwise(F.col("cols"))).cast("int"))
    to = F.expr("""if(inside, transform(sequence(0, cols - 1), x -> struct(true as across, own as i, x as j)),
        concat(transform(sequence(0, rows - 1), x -> struct(true as across, x as i, own as j)), transform(sequence(0, cols - 1), x -> struct(false as across, least(x, own) as i, greatest(x, own) as j))))""")
    dealt = dealt.select("g", F.explode(to).alias("to"), "own", "id", "component", "inside")
    left = F.when(F.col("to.across"), F.col("inside")).otherwise(F.col("to.i") == F.col("own"))
    right = F.when(F.col("to.across"), ~F.col("inside")).otherwise(F.col("to.j") == F.col("own"))
    dealt = dealt.select("g", "to", left.alias("left"), right.alias("right"), "id", "component")

    def run(batches):
        key, block, links = None, [], []

        def settle():
            if len(block) > 1:
                ids, component = (np.array([r[k] for r in block], np.int64) for k in (0, 1))
                left, right = (np.flatnonzero([r[k] for r in block]) for k in (2, 3))
                if len(left) and len(right):
                    links.extend(_meet(ids, component, [np.frombuffer(r[4], np.uint64) for r in block], left, right))

        for batch in batches:
            for *at, row in zip(*(batch.column(x).to_pylist() for x in ("g", "across", "i", "j")), zip(*(batch.column(x).to_pylist() for x in ("id", "component", "left", "right", "own")))):
                if at != key:
                    settle()
                    key, block = at, []
                block.append(row)
        settle()
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    at = ("g", "across", "i", "j")
    rows = dealt.join(sets, "id").select("g", "to.across", "to.i", "to.j", "id", "component", "left", "right", "own")
    return rows.repartition(*at).sortWithinPartitions(*at).mapInArrow(run, "a long, b long")


def _finer(roles: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """Members (key, id, n) of the groups by bands of a further, independent sketch."""

    def run(batch: pa.RecordBatch) -> dict:
        turn = mix(np.array([level], np.uint64) * np.uint64(_BASE))
        return {"id": batch.column("id"), "keys": [bands(sketch(mix(np.frombuffer(x, np.uint64) ^ turn))).view(np.int64) for x in batch.column("own").to_pylist()]}

    keys = map_batches(sets.join(_bounded(materialise(roles.select("id").distinct())), "id", "left_semi"), run, "id long, keys array<long>")
    return roles.join(keys, "id").select("g", "id", "n", F.explode("keys").alias("k")).select(F.xxhash64("g", "k").alias("key"), "id", "n")


def link_representatives(members: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, components) of members (key, id, n) of buckets; texts: (id, text)."""
    buckets = _buckets(members)
    sets = _sets(texts, materialise(buckets.select("id").distinct()))
    links = None
    for level in range(LEVELS + 1):
        tested = buckets.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
        found = _verified(tested, sets)
        links = materialise(found if links is None else links.unionByName(found))
        comps = components(links)
        roles = _apart(buckets, comps)
        if roles.isEmpty():
            return links, comps
        beside = roles.groupBy("g").agg(F.sum(F.when(~F.col("inside"), F.col("n"))).alias("w")).filter(F.col("w") > (FINER if level < LEVELS else 1 << 62))
        large = materialise(beside.select("g"))
        rest = large.isEmpty()
        now = roles if rest else roles.join(_bounded(large), "g", "left_anti")
        links = materialise(links.unionByName(_met(now, sets)))
        if rest:
            return links, components(links)
        buckets = _buckets(_finer(roles.join(_bounded(large), "g", "left_semi"), sets, level + 1))
    raise AssertionError


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = materialise(_sketched(docs))
    classes = rows.filter("n > 0").groupBy("seq").agg(F.min_by(F.struct("id", "n", "keys"), "id").alias("r"))
    classes = materialise(classes.select("seq", "r.id", "r.n", "r.keys"))
    _, comps = link_representatives(classes.select("id", "n", F.explode("keys").alias("key")), docs.select(_id(), "text"))
    named = classes.select("seq", "id").join(_bounded(comps), "id", "left")
    named = materialise(named.select("seq", F.coalesce("component", "id").alias("component_id")))
    out = rows.select("id", "n", "seq").join(named, "seq", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(
        F.when(F.col("id") == NULL_ID, None).otherwise(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("component_id") == NULL_ID, None).otherwise(F.col("component_id")).alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"),
    )
