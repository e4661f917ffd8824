r"""Operator 3, quality classifier: nearest-neighbour voting in a latent-semantic space.

A text's terms are its byte trigrams, its words, its pairs of adjacent words, and the recurrences of its words: for each word, the power of two of the distance to where it
stood before. The first three are hashed to TERMS numbers; nothing is cut or left out of the text. Terms are weighted by the root of their share and by inverse
document frequency. A bounded sample of MOST labelled rows, the first by a hash of their ids, gives the document frequencies and, by a truncated singular value
decomposition of the weighted terms, DIMENSIONS latent directions. The sample's vectors and labels are broadcast (MOST * DIMENSIONS floats at most). Every
document meets all of them in exact blocked cosine products; the labels of its NEIGHBOURS nearest vote with similarity to the power POWER as weight.

Defined results: the score of a null, empty or wordless text, or of any text if no label can be learnt from, is the
sample's share of label 1 (0.5 without labels); labels with a null id or quality are not used, of repeated ids the least quality, and of the documents with that id the
least text; ties of similarity have no order but each score stays a vote of so many nearest; repeated rows get equal scores; extra columns are kept, but for
those named as an output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import add_columns, bounded_batches, map_batches, mix, space_words, text_bytes, word_hashes

MOST = 4096
BITS = 13
#: Numbers of hashed terms, behind which those of recurrences stand: a new word is the last.
TERMS, RECURRENCES = 1 << BITS, 32
DIMENSIONS = 48
#: Rounds of subspace iteration, and rows of a block of dense vectors.
ROUNDS, BLOCK = 5, 256
NEIGHBOURS = 15
POWER = 16
THRESHOLD = 0.3
#: Bytes of a text whose trigrams are hashed at a time.
_SLICE = 1 << 20


def _numbers(hashes: np.ndarray) -> np.ndarray:
    return np.bincount((hashes >> np.uint64(64 - BITS)).astype(np.int64), minlength=TERMS)


def terms(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a text's terms, and the root of the share of each among those of its kind; empty for a wordless text."""
    words = space_words(text)
    if not words:
        return np.empty(0, np.uint16), np.empty(0, np.float32)
    counts = np.zeros(TERMS, np.int64)
    for at in range(0, max(1, len(text) - 2), _SLICE):
        x = np.frombuffer(text, np.uint8)[at : at + _SLICE + 2].astype(np.uint64)
        if len(x) > 2:
            counts += _numbers(mix(x[:-2] | x[1:-1] << np.uint64(8) | x[2:] << np.uint64(16) | np.uint64(1 << 24)))
    h = word_hashes(words)
    counts += _numbers(mix(h))
    counts += _numbers(mix(h[1:] ^ mix(h[:-1] + np.uint64(1))))
    order = np.argsort(h, kind="stable")
    again = h[order[1:]] == h[order[:-1]]
    gaps = (order[1:] - order[:-1])[again]
    before = np.bincount(np.minimum(np.log2(np.maximum(gaps, 1)).astype(np.int64), RECURRENCES - 2), minlength=RECURRENCES)
    before[-1] = len(h) - len(gaps)
    share = np.concatenate([counts / counts.sum(), before / len(h)])
    found = np.flatnonzero(share)
    return found.astype(np.uint16), np.sqrt(share[found]).astype(np.float32)


class Model:
    """Term weights, directions, and the labelled vectors."""

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        df = np.bincount(np.concatenate([i for i, _ in found]), minlength=TERMS + RECURRENCES) if found else np.zeros(TERMS + RECURRENCES)
        idf = (np.log((1 + len(found)) / (1 + df)) + 0.1).astype(np.float32)
        # subspace iteration on unit rows, a block of them dense at a time
        space = np.random.default_rng(0).standard_normal((TERMS + RECURRENCES, min(DIMENSIONS, max(1, len(found))))).astype(np.float32)
        for _ in range(ROUNDS if found else 0):
            new = np.zeros_like(space)
            for at in range(0, len(found), BLOCK):
                x = _dense(found[at : at + BLOCK]) * idf
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                new += x.T @ (x @ space)
            space, _ = np.linalg.qr(new)
        self.directions = (space * idf[:, None]).astype(np.float32)
        self.points = np.concatenate([self.project(found[at : at + BLOCK]) for at in range(0, len(found), BLOCK)]) if found else np.zeros((0, space.shape[1]), np.float32)

    def project(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        x = _dense(found) @ self.directions
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(found), self.prior)
        return np.concatenate([self._score(found[at : at + BLOCK]) for at in range(0, len(found), BLOCK)]) if found else np.empty(0)

    def _score(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        sims = self.project(found) @ self.points.T
        k = min(NEIGHBOURS, sims.shape[1])
        near = np.argpartition(sims, -k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(sims, near, 1), 0).astype(np.float64) ** POWER
        total = weight.sum(1)
        votes = (weight * self.labels[near]).sum(1)
        return np.where(total > 1e-9, votes / np.maximum(total, 1e-9), self.prior)


def _dense(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(found), TERMS + RECURRENCES), np.float32)
    for row, (i, v) in zip(x, found):
        row[i] = v
    return x


def held_out(col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """A model of a bounded sample of the labelled rows that aren't held out, of each id one."""
    bounded_batches(docs.sparkSession)
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    sample = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").dropna().join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def describe(batch: pa.RecordBatch) -> dict:
        found = [terms(t) for t in text_bytes(batch, "text")]
        return {"doc_id": batch.column("doc_id"), "q": batch.column("quality"), "t": [i.tobytes() for i, _ in found], "v": [v.tobytes() for _, v in found]}

    key = docs.schema["doc_id"].dataType.simpleString()
    made = map_batches(rows, describe, f"doc_id {key}, q int, t binary, v binary").toLocalIterator()
    got = sorted((r.doc_id, r.q, bytes(r.t), bytes(r.v)) for r in made)
    return Model([(np.frombuffer(t, np.uint16), np.frombuffer(v, np.float32)) for _, _, t, v in got], np.array([float(q > 0) for _, q, _, _ in got]))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        scores = shared.value.score([terms(t) for t in text_bytes(batch, "text")])
        scores = np.clip(np.round(scores, 9), 0, 1)
        return {"score": scores, "predicted": (scores >= THRESHOLD).astype(np.int32)}

    return add_columns(docs, ["text"], run, "score double, predicted int")
