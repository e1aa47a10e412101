"""Toxicity by class-conditional Kneser-Ney models over word pairs.

For each class, a pair of words counts by the number of different words before it, and a word by the
number of different words before it, so that copies of a text count once. Every count is kept, less a
discount that the numbers of small counts ask for; the mass this frees goes from a pair to its last word,
and from a word to counts that both classes share. What a word tells is trusted the more the more
often it was counted, and what a pair adds to that likewise, so rare expressions rest on what both share.

A text is compared by its log-likelihoods under the two models: the mean difference per word of the whole
text, that of its most telling stretch of STRETCH words, without which a few toxic words in a long text
would drown, and how much its words speak for the toxic model in all, which tells one toxic word from
several. A logistic fit on rows not counted makes these a probability.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import crc_of_id, kept, stored, texts
from .quality import labelled_texts

#: Labelled rows that the models are fitted on at most; words of a stretch; counts by which what a word tells, and what a pair adds, is trusted by half.
SAMPLE, STRETCH = 20_000, 3
WORD_TRUST, PAIR_TRUST = 4.0, 20.0


def _words(batches):
    for batch in batches:
        for a, z in words.pieces(batch.column("text")):
            part = batch.slice(a, z - a)
            data, offsets = words.utf8(part.column("text"))
            h, doc = words.split(words.fold_latin(data), offsets, words.letter_words(True, False))
            yield part, (h >> np.uint64(32)).astype(np.int64), doc


def _before(w: np.ndarray, doc: np.ndarray, step: int) -> np.ndarray:
    """The word `step` places before in the same text; 0 stands for a text's start."""
    out = np.zeros(len(w), np.int64)
    out[step:] = np.where(doc[step:] == doc[:-step], w[:-step], 0)
    return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What modified Kneser-Ney smoothing takes off counts of 0, 1, 2 and more, from how many counts are 1, 2, 3 and 4: less than the count itself, so that none is lost."""
    if not (n1 and n2 and n3):
        return [0, 0.75, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [0.0, *(float(np.clip(d, 0.1, k - 0.1)) for k, d in enumerate(raw, 1))]


class Models:
    """Both classes' counts of all words and pairs as sorted arrays. less: what counts of 0, 1, 2 and more lose, of words and of pairs, by class."""

    def __init__(self, word: tuple[np.ndarray, np.ndarray], pair: tuple[np.ndarray, np.ndarray], less: np.ndarray):
        self.word, m = word
        m = m.astype(np.int64)
        self.pair, self.n = pair
        every = np.maximum(1, m.sum(1)).astype(float)
        over = m - np.stack([less[0][c][np.minimum(m[c], 3)] for c in (0, 1)])
        self.spare = 1 - over.sum(1) / every  # of a class, for the shared counts
        self.p = (over / every[:, None] + self.spare[:, None] * (m.sum(0) / every.sum())).astype(np.float32)
        self.rare = float(np.log(self.spare[1] / self.spare[0]))
        self.m, self.less = m.sum(0).astype(np.uint32), less[1]
        v = self.pair >> np.uint64(32)
        self.starts = np.flatnonzero(np.concatenate((np.ones(min(len(v), 1), bool), v[1:] != v[:-1])))
        self.first = v[self.starts]
        del v
        sums = lambda x, kind: np.add.reduceat(x, self.starts, dtype=kind) if len(self.starts) else np.zeros(0, kind)
        lost = [sums(less[1][c].astype(np.float32)[np.minimum(self.n[c], 3)], np.float64) for c in (0, 1)]
        of = np.stack([sums(self.n[c], np.int64) for c in (0, 1)])
        self.all_of = np.maximum(1, of)
        self.back = np.where(of > 0, np.stack(lost) / self.all_of, 1)  # of a first word, for its followers' own counts

    def __getstate__(self) -> dict:
        """Pairs as their last words, packed, and how many each first word has, which makes what tasks get half as long."""
        packed = {"pair": zlib.compress(self.pair.astype("<u4"), 1), "n": zlib.compress(np.ascontiguousarray(self.n), 1)}
        return self.__dict__ | packed | {"many": len(self.pair), "kind": self.n.dtype.str}

    def __setstate__(self, state: dict) -> None:
        many, kind = state.pop("many"), state.pop("kind")
        self.__dict__ = state
        pair = np.repeat(self.first << np.uint64(32), np.diff(self.starts, append=many))
        pair |= np.frombuffer(zlib.decompress(self.pair), "<u4")  # in place: all workers of a machine unpack at once
        self.pair = pair
        self.n = np.frombuffer(zlib.decompress(self.n), kind).reshape(2, -1)

    def ratios(self, w: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log P(word | word before; toxic) - log P(...; ordinary) of each word, less that of a rare word: what the word tells by itself and what the pair adds, each as far as its counts are trusted."""
        find = lambda table, x: np.minimum(np.searchsorted(table, x), len(table) - 1)
        if not len(self.word):
            return np.zeros(len(w))
        w, before = w.astype(np.uint64), before.astype(np.uint64)
        at = find(self.word, w)
        known = self.word[at] == w
        p = np.where(known, self.p[:, at], self.spare[:, None] * 1e-9)
        alone, m = np.log(p[1] / p[0]) - self.rare, np.where(known, self.m[at], 0)
        b, q = find(self.first, before), find(self.pair, key := (before << np.uint64(32)) | w)
        n = np.where(self.pair[q] == key, self.n[:, q], 0)
        seen = (n - np.stack([self.less[c][np.minimum(n[c], 3)] for c in (0, 1)])) / self.all_of[:, b]
        p = seen + np.where(self.first[b] == before, self.back[:, b], 1.0) * p
        n = n.sum(0)
        return alone * (m / (m + WORD_TRUST)) + (np.log(p[1] / p[0]) - self.rare - alone) * (n / (n + PAIR_TRUST))

    def features(self, w: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
        """Mean ratio of the text, of its best stretch, and of its best stretches together."""
        out = np.zeros((rows, 3))
        if not len(w):
            return out
        r = self.ratios(w, _before(w, doc, 1))
        n = np.bincount(doc, minlength=rows)
        full = np.flatnonzero(n)
        first = np.concatenate(([0], np.cumsum(n[full])[:-1]))
        out[full, 0] = np.add.reduceat(r, first) / n[full]
        run = r.copy()
        for step in range(1, STRETCH):
            run[step:] += np.where(doc[step:] == doc[:-step], r[:-step], 0)
        run /= STRETCH
        out[full, 1] = np.maximum.reduceat(run, first)
        out[full, 2] = np.log1p(np.add.reduceat(np.maximum(r - 1, 0), first))
        return np.clip(out, -20, 20)


class Calibration:
    """Logistic regression of the label on the features, by Newton steps with a small ridge; without rows of both labels the best stretch decides."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.weights = None
        if len(np.unique(y)) < 2:
            return
        self.mid, self.scale = x.mean(0), x.std(0) + 1e-3
        a = np.column_stack([np.ones(len(x)), (x - self.mid) / self.scale])
        w = np.zeros(a.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w))
            w += np.clip(np.linalg.solve(h, a.T @ (y - p) - 0.1 * w), -3, 3)
        self.weights = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return 1 / (1 + np.exp(-x[:, 1]))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + (x - self.mid) / self.scale @ self.weights[1:], -500, 500)))


class Fitted:
    """Scores of texts by Models and their calibration. Tasks get them with their code, packed, and let go of them at their end."""

    def __init__(self, models: Models, calibration: Calibration):
        self.models, self.calibration = models, calibration

    def __call__(self, w: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
        return self.calibration(self.models.features(w, doc, rows))


def counted(df: DataFrame, key: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a table of counts, sorted as unsigned numbers (a pair's first word is in the upper bits), and both classes' counts of each; only the sample bounds how many there are.

    Tasks pack them, and the driver takes one partition after the other, so that it never holds them as rows.
    """

    def run(batches):
        for batch in batches:
            n = np.stack([batch.column(f"{name}{c}").to_numpy() for c in (0, 1)]).astype("<u4")
            yield pa.record_batch({"keys": pa.array([batch.column(key).to_numpy().tobytes()], pa.binary()), "n": pa.array([zlib.compress(n.tobytes(), 1)], pa.binary())})

    rows = df.select(key, *(F.col(f"{name}{c}").cast("int") for c in (0, 1)))
    many, *most = rows.agg(F.count("*"), *(F.max(f"{name}{c}") for c in (0, 1))).first()
    keys, counts, at = np.empty(many, np.uint64), np.empty((2, many), np.min_scalar_type(max(x or 0 for x in most))), 0
    for some, n in rows.orderBy(F.col(key) < 0, key).mapInArrow(run, "keys binary, n binary").toLocalIterator():
        own = np.frombuffer(some, "<u8")
        keys[at : at + len(own)], counts[:, at : at + len(own)] = own, np.frombuffer(zlib.decompress(n), "<u4").reshape(2, -1)
        at += len(own)
    return keys, counts


def fit(docs: DataFrame, labels: DataFrame, train, sample: int = SAMPLE) -> Fitted:
    """Counts come from three in four of the sampled rows, the calibration from the others."""

    def triples(batches):
        for part, w, doc in _words(batches):
            toxic = part.column("label").to_numpy()[doc] if len(doc) else np.zeros(0, int)
            v, u = _before(w, doc, 1), _before(w, doc, 2)
            x = np.unique(np.stack([toxic.astype(np.int64), (v << 32) | w, u], 1), axis=0) if len(w) else np.zeros((0, 3), np.int64)
            yield pa.record_batch({"toxic": pa.array(x[:, 0].astype(np.int32)), "vw": pa.array(x[:, 1]), "u": pa.array(x[:, 2])})

    rows = labelled_texts(docs, labels, "toxic", train, sample)
    rows = rows.where("label IN (0, 1)").withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    rows = stored(rows)
    seen = rows.where("NOT held").select("text", "label").mapInArrow(triples, "toxic int, vw long, u long").repartition("vw").dropDuplicates(["toxic", "vw", "u"])
    of = lambda c: F.count(F.when(F.col("toxic") == c, 1))
    pairs = stored(seen.groupBy("vw").agg(of(0).alias("n0"), of(1).alias("n1")))
    some = lambda c: F.count(F.when(F.col(f"n{c}") > 0, 1))
    by_word = pairs.groupBy(F.col("vw").bitwiseAND(0xFFFFFFFF).alias("w")).agg(some(0).alias("m0"), some(1).alias("m1"))
    by_word = stored(by_word)
    small = lambda df, name: df.agg(*(F.count(F.when(F.col(f"{name}{c}") == k, 1)) for c in (0, 1) for k in range(1, 5))).first()
    less = np.array([[discounts(*x[:4]), discounts(*x[4:])] for x in (small(by_word, "m"), small(pairs, "n"))])
    models = Models(counted(by_word, "w", "m"), counted(pairs, "vw", "n"), less)

    def features(batches):
        for part, w, doc in _words(batches):
            yield pa.record_batch({"label": part.column("label"), "x": pa.array(list(models.features(w, doc, part.num_rows)), pa.list_(pa.float64()))})

    got = rows.where("held").mapInArrow(features, "label int, x array<double>").toArrow()
    x = np.stack(got["x"].to_numpy(zero_copy_only=False)) if got.num_rows else np.zeros((0, 3))
    return Fitted(models, Calibration(x, got["label"].to_numpy()))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, unchanged, that toxicity_scores doesn't predict to be toxic."""
    scores = fit(docs, labels, F.pmod(crc_of_id(), F.lit(5)) != 0, sample)
    return kept(docs, _words, lambda w, doc, rows: scores(w, doc, rows) < 0.5)


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text).

    score is the calibrated probability that the whole text is toxic. Words are runs of letters, digits
    and non-ASCII bytes, in lower case. The models are fitted on at most `sample` rows of labels (doc_id,
    toxic) that are not held out (crc32 of the id as text, modulo 5, is 0); null labels and ids are not
    learnt from. Without labels of both kinds the score follows the models uncalibrated. Empty and null
    texts have no word that tells; null ids and repeated rows are scored like others; other columns are
    ignored.
    """
    held = F.pmod(crc_of_id(), F.lit(5)) == 0
    scores = fit(docs, labels, ~held, sample)

    def run(batches):
        for part, w, doc in _words(batches):
            score = scores(w, doc, part.num_rows)
            yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    return texts(docs).withColumn("held_out", held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
