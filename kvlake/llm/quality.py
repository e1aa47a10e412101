"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

Every word that the labelled sample has in TEXTS texts or more has a vector of its own, gathered from its
contexts in all documents; the other words, which the network cannot have learnt by themselves, share
vectors by hash bucket. So the table is bounded by the sample, and no telling word shares a vector.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import crc_of_id, kept, stored, texts

#: Buckets of words without a vector of their own, dimensions and non-zero entries of an index vector, words on each side of a context.
BUCKETS, DIM, ENTRIES, REACH = 8192, 32, 4, 2
#: Labelled texts in which a word must be to have a vector of its own, and words of a block of sums.
TEXTS, BLOCK = 2, 4096
#: Tasks' sums are added up in groups of at most 2 ** FAN, then those of these groups, and so on, so that no task adds up many.
FAN = 6
#: Words of one text that are worked on at once.
STRETCH = 1 << 17
#: Labelled rows that the network is fitted on at most, those with the least hash of their id.
SAMPLE = 20_000


def index_vectors(many: int) -> np.ndarray:
    """A sparse vector of ENTRIES times +1 or -1 for each of so many words."""
    rng, out = np.random.default_rng(5), np.zeros((many, DIM), np.int8)
    for k in range(0, many, BLOCK):  # in blocks, so that temporary arrays stay small
        part = out[k : k + BLOCK]
        at = np.argsort(rng.random(part.shape, np.float32), axis=1)[:, :ENTRIES]
        np.put_along_axis(part, at, rng.choice(np.array([-1, 1], np.int8), at.shape), 1)
    return out


def _split(batches):
    """(rows of the batch, word hashes, row of each word) by parts of a batch; words keep their case, marks are words."""
    for batch in batches:
        for a, z in words.pieces(batch.column("text")):
            part = batch.slice(a, z - a)
            yield part, *words.split(*words.utf8(part.column("text")), words.letter_words(False, True))


class Words:
    """Numbers of words: those with a vector of their own by their sorted hashes, then the buckets."""

    def __init__(self, own: np.ndarray):
        self.own, self.many = own, len(own) + BUCKETS

    def __call__(self, batches):
        """(rows of the batch, word numbers, row of each word) by parts of a batch."""
        for part, h, doc in _split(batches):
            w = len(self.own) + (h >> np.uint64(20)).astype(np.int64) % BUCKETS
            if len(self.own):
                at = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
                w = np.where(self.own[at] == h, at, w)
            yield part, w, doc


def own_words(labelled: DataFrame) -> Words:
    """The words of TEXTS or more of the labelled texts, of which there are a bounded number."""

    def run(batches):
        for _, h, doc in _split(batches):
            once = np.unique(np.stack([h, doc.astype(np.uint64)], 1), axis=0)[:, 0] if len(h) else h
            word, n = np.unique(once, return_counts=True)
            yield pa.record_batch({"word": pa.array(word.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    found = labelled.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TEXTS).select("word").toArrow()
    return Words(np.sort(found["word"].to_numpy().view(np.uint64)) if found.num_rows else np.zeros(0, np.uint64))


def word_vectors(docs: DataFrame, known: Words) -> np.ndarray:
    """A unit vector in half precision for each word number: the sum of the index vectors around all its occurrences in all documents."""
    many = known.many

    def run(batches):
        index = np.ascontiguousarray(index_vectors(many).T)
        total = np.zeros((DIM, many), np.int32)  # a task has fewer words than would overflow
        for _, all_w, all_doc in known(batches):
            for a in range(0, len(all_w), STRETCH):  # with REACH words more on either side, whose own contexts don't count here
                b, z = max(0, a - REACH), min(len(all_w), a + STRETCH + REACH)
                w, doc, own = all_w[b:z], all_doc[b:z], slice(a - b, min(len(all_w), a + STRETCH) - b)
                same = [(doc[step:] == doc[:-step]).astype(np.float32) for step in range(1, REACH + 1)]
                for d in range(DIM):
                    x = index[d][w].astype(np.float32)
                    around = np.zeros(len(w), np.float32)
                    for step, both in enumerate(same, 1):
                        around[:-step] += x[step:] * both
                        around[step:] += x[:-step] * both
                    total[d] += np.bincount(w[own], around[own], many).astype(np.int32)
        task = pa.array([TaskContext.get().partitionId()], pa.int64())
        for k in range(0, many, BLOCK):
            part = total[:, k : k + BLOCK].astype("<i8")
            if part.any():
                yield pa.record_batch({"block": pa.array([k // BLOCK], pa.int64()), "task": task, "sums": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    def added(group: pa.Table) -> pa.Table:
        total = 0
        for x in group.column("sums"):
            total = total + np.frombuffer(zlib.decompress(x.as_py()), "<i8")
        return group.slice(0, 1).drop_columns(["sums"]).append_column("sums", pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()))

    sums = texts(docs).mapInArrow(run, "block long, task long, sums binary")
    for _ in range(max(1, -(-(sums.rdd.getNumPartitions() - 1).bit_length() // FAN))):  # there are no more tasks than the plan has parts
        sums = sums.withColumn("task", F.shiftright("task", FAN)).groupBy("block", "task").applyInArrow(added, "block long, task long, sums binary")
    out = np.zeros((many, DIM), np.float16)
    for k, _, x in sums.toLocalIterator():  # a row for each block, of which the sample bounds the number
        part = np.frombuffer(zlib.decompress(x), "<i8").reshape(DIM, -1).T
        out[k * BLOCK : k * BLOCK + len(part)] = part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return out


def pooled(vectors: np.ndarray, w: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    """Features of each row: mean and spread of its words' vectors, share of words that repeat the one before, share of different words, and the logarithm of its length."""
    out = np.zeros((rows, 2 * DIM + 3), np.float32)
    if not len(w):
        return out
    n = np.bincount(doc, minlength=rows)
    full = np.flatnonzero(n)
    first = np.concatenate(([0], np.cumsum(n[full])[:-1]))
    if rows == 1 and len(w) > STRETCH:  # a very long text, by its count of each word
        many = np.bincount(w, minlength=len(vectors)).astype(np.float64)
        v = vectors.astype(np.float32)
        mean, square = ((many @ x)[None] / n[full, None] for x in (v, v * v))
    else:
        v = vectors[w].astype(np.float32)
        mean, square = (np.add.reduceat(x, first) / n[full, None] for x in (v, v * v))
    out[full, :DIM] = mean
    out[full, DIM : 2 * DIM] = np.sqrt(np.maximum(square - mean**2, 0))
    repeat = np.zeros(len(w))
    repeat[1:] = (w[1:] == w[:-1]) & (doc[1:] == doc[:-1])
    key = np.unique(doc * len(vectors) + w) // len(vectors)
    out[full, -3] = np.add.reduceat(repeat, first) / n[full]
    out[full, -2] = np.bincount(key, minlength=rows)[full] / n[full]
    out[full, -1] = np.log1p(n[full])
    return out


class Network:
    """Two dense layers over standardised features, with a temperature fitted on rows not trained on."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 3):
        self.constant = None
        if len(np.unique(y[~held])) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        rng = np.random.default_rng(seed)
        self.mid, self.scale = x[~held].mean(0), x[~held].std(0) + 1e-3
        a, t = self._scaled(x[~held]), y[~held].astype(np.float64)
        p = {"w1": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, hidden**-0.5, hidden), "b2": np.zeros(1)}
        m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(a))
            for k in range(0, len(a), 128):
                b = order[k : k + 128]
                h = np.maximum(a[b] @ p["w1"] + p["b1"], 0)
                e = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30))) - t[b]) / len(b)
                back = np.outer(e, p["w2"]) * (h > 0)
                g = {"w1": a[b].T @ back + 1e-4 * p["w1"], "b1": back.sum(0), "w2": h.T @ e + 1e-4 * p["w2"], "b2": np.array([e.sum()])}
                step += 1
                for c in p:
                    m[c] = 0.9 * m[c] + 0.1 * g[c]
                    s[c] = 0.999 * s[c] + 0.001 * g[c] ** 2
                    p[c] -= 0.003 * (m[c] / (1 - 0.9**step)) / (np.sqrt(s[c] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if held.any():
            z, t = self._logit(x[held]), y[held]
            loss = lambda u: np.logaddexp(0, np.where(t == 1, -z, z) / u).mean()
            self.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mid) / self.scale, -8, 8)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self._scaled(x) @ self.p["w1"] + self.p["b1"], 0) @ self.p["w2"] + self.p["b2"]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -500, 500)))


def sampled(labels: DataFrame, target: str, train, most: int) -> DataFrame:
    """At most `most` (doc_id, label) rows for which the condition `train` on doc_id holds; of a repeated id the largest label."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL").where(train)
    return own.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled_texts(docs: DataFrame, labels: DataFrame, target: str, train, most: int) -> DataFrame:
    """(doc_id, label, text) of the sampled ids, one row of each, so at most `most`: of an id with several texts the largest in byte order."""
    rows = texts(docs).join(F.broadcast(sampled(labels, target, train, most)), "doc_id")  # at most `most` rows
    return rows.groupBy("doc_id", "label").agg(F.max("text").alias("text"))


class Fitted:
    """Scores of texts by word numbers, vectors, and the network over their pooled features. Tasks get them with their code and let go of them at their end."""

    def __init__(self, words: Words, vectors: np.ndarray, network: Network):
        self.words, self.vectors, self.network = words, vectors, network

    def __call__(self, w: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
        return self.network(pooled(self.vectors, w, doc, rows).astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, train, sample: int = SAMPLE) -> Fitted:
    """Fitted on labelled rows that `train` holds for; the sample bounds the table's size (72 bytes a word)."""
    labelled = stored(labelled_texts(docs, labels, "quality", train, sample))
    known = own_words(labelled)
    vectors = word_vectors(docs, known)

    def run(batches):
        for part, w, doc in known(batches):
            x = pooled(vectors, w, doc, part.num_rows)
            yield pa.record_batch({"doc_id": part.column("doc_id"), "label": part.column("label"), "x": pa.array(list(x), pa.list_(pa.float32()))})

    got = labelled.mapInArrow(run, "doc_id long, label int, x array<float>").toArrow().sort_by("doc_id")  # at most `sample` rows
    x = np.stack(got["x"].to_numpy(zero_copy_only=False)) if got.num_rows else np.zeros((0, 2 * DIM + 3), np.float32)
    y = got["label"].to_numpy()
    held = got["doc_id"].to_numpy() // 3 % 5 == 0 if got.num_rows else np.zeros(0, bool)
    return Fitted(known, vectors, Network(x.astype(np.float64), y, held))


def without_low(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, unchanged, that quality_scores doesn't predict to be labelled 0."""
    scores = fit(docs, labels, F.pmod(crc_of_id(), F.lit(3)) != 1, sample)
    return kept(docs, scores.words, lambda w, doc, rows: scores(w, doc, rows) >= 0.5)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text).

    score is the calibrated probability of label 1, from the whole text only. Word vectors come from all
    documents; the network is fitted on at most `sample` rows of labels (doc_id, quality) that are not
    held out (crc32 of the id as text, modulo 3, is 1). Null labels and ids are not learnt from; without
    rows of both labels every score is their share of 1, 0.5 without any. Empty and null texts score as texts
    without words; null ids and repeated rows are scored like others; other columns are ignored.
    """
    held = F.pmod(crc_of_id(), F.lit(3)) == 1
    scores = fit(docs, labels, ~held, sample)

    def run(batches):
        for part, w, doc in scores.words(batches):
            score = scores(w, doc, part.num_rows)
            yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    return texts(docs).withColumn("held_out", held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
