"""Document quality by supervised subword embeddings.

Words, and the character n-grams of words, are hashed into a table of learned vectors. A document's vector is the average of
its words' vectors (a word's is the average of its own and its n-grams'), and a softmax layer scores it. Vectors and
layer are trained together by stochastic gradient descent in numpy, on the driver, on a bounded sample.

Besides the word itself, its form is a feature (case, length class, marks at its end), hashed like n-grams; a word that
repeats the one before is a word of its own.

After training only the softmax of the averaged vectors is needed, which is linear in them; so every hash bucket keeps one
number (of the two classes' difference), and whole texts are scored by adding up those of their words. Words' sums are kept in
a bounded cache per worker.

Nulls: a null or empty text has no features and gets the score of the bias, which is the prior. Rows with a null label, or a
label of neither class, aren't learned from; repeated labels of one document are learned from each. Without labels the
score is 0.5. Repeated documents are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, ship
from tessera.llm.tokenizing import in_parts

BUCKETS, DIM = 1 << 17, 16
GRAMS = (3, 4)
SAMPLE = 6_000  # labelled documents that are learned from at most: those of the least hashes of their ids
CACHE = 100_000
SAME = "\x00"  # stands for a word that repeats the one before
_PRIME = np.uint64(0x100000001B3)
_MARKS = re.compile(r"[\W_]{0,3}$")


def _bucket(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of words, word after word, and how many each has.

    A word has its lower-cased self (marked at both ends), its form (case and marks), the marks that it ends in, and
    the character n-grams of the marked self.
    """
    marked = [f"<{w.lower()}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    power = np.cumprod(np.full(int(sizes.max()), _PRIME, np.uint64), dtype=np.uint64)
    whole = np.add.reduceat(chars * power[np.arange(len(chars)) - np.repeat(starts, sizes)], starts)
    form = np.array([(1 if w.isupper() else 2 if w[:1].isupper() else 3) * 8 + w.isalpha() * 4 + min(len(w) // 6, 3) for w in words], np.uint64)
    tails = np.array([zlib.crc32(_MARKS.search(w)[0].encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    flat = [_bucket(whole), _bucket(form + np.uint64(1 << 40)), _bucket(tails + np.uint64(1 << 41))]
    owner = [np.arange(len(words))] * 3
    word = np.repeat(np.arange(len(words)), sizes)
    for n in GRAMS:
        if len(chars) >= n:
            gram = chars[: len(chars) - n + 1].copy()
            for k in range(1, n):
                gram = gram * _PRIME + chars[k : len(chars) - n + 1 + k]
            inside = word[: len(gram)] == word[n - 1 :]
            flat.append(_bucket(gram[inside] + np.uint64(n << 42)))
            owner.append(word[: len(gram)][inside])
    flat_, owner_ = np.concatenate(flat), np.concatenate(owner)
    order = np.argsort(owner_, kind="stable")
    return flat_[order], np.bincount(owner_, minlength=len(words))


@dataclass
class Model:
    """weights: (BUCKETS,) what a bucket adds to the difference of the classes; bias: the same of an empty text."""

    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def values(self, words: list[str]) -> np.ndarray:
        flat, each = word_features(words)
        return np.add.reduceat(self.weights[flat].astype(np.float64), np.cumsum(each) - each) / each

    def score(self, texts: list[str]) -> list[float]:
        """The probability of class 1 for each whole text."""
        split = [t.split() for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        missing = set().union(*split, [SAME]).difference(known)
        for part in _even(list(missing), 10_000):
            known.update(zip(part, self.values(part).tolist(), strict=True))
        same, get = known[SAME], known.__getitem__
        out = []
        for words in split:
            z = self.bias
            if words:
                total = sum(map(get, words))
                for w in [w for w, b in zip(words[1:], words, strict=False) if w == b]:
                    total += same - get(w)
                z += total / len(words)
            out.append(float(1 / (1 + np.exp(-min(30.0, max(-30.0, z))))))
        return out


def _even(items: list, most: int) -> Iterator[list]:
    for i in range(0, len(items), most):
        yield items[i : i + most]


def train(texts: list[str], labels: list[int], epochs: int = 5, rate: float = 0.3, seed: int = 1) -> Model:
    """Learn from documents: minibatches of documents, vectors and softmax layer updated together.

    The learning rate falls to zero; steps are scaled by adagrad sums for each bucket and for the layer.
    """
    rng = np.random.default_rng(seed)
    if len(set(labels)) < 2:
        prior = min(max(sum(labels) / len(labels), 0.01), 0.99) if labels else 0.5
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))))
    y = np.array(labels)
    vocabulary: dict[str, int] = {SAME: 0}
    docs = []  # different words of each document, and how often each occurs
    for t in texts:
        own = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in t.split()), np.int32)
        if len(own) > 1:
            own[1:] = np.where(own[1:] == own[:-1], 0, own[1:])
        docs.append(tuple(x.astype(np.int32) for x in np.unique(own, return_counts=True)))
    parts = [tuple(x.astype(np.int32) for x in word_features(p)) for p in _even(list(vocabulary), 10_000)]
    buckets, each = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    del vocabulary, parts
    begin = np.cumsum(each, dtype=np.int64) - each
    vectors = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    square, layer_square, bias_square = np.full(BUCKETS, 1e-4, np.float32), np.full((DIM, 2), 1e-3, np.float32), np.full(2, 1e-1, np.float32)
    batch, column = 32, np.zeros(BUCKETS, np.int64)
    steps, step = epochs * -(-len(y) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            own = order[lo : lo + batch]
            sizes = np.array([len(docs[d][0]) for d in own])  # different words of each document
            words, times = (np.concatenate([docs[d][i] for d in own]) for i in (0, 1))
            if not len(words):
                continue
            n = each[words]
            total = np.array([max(1, int(docs[d][1].sum())) for d in own])
            at = np.repeat(begin[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            flat = buckets[at]
            share = np.repeat(times / n / np.repeat(total, sizes), n)
            doc = np.repeat(np.repeat(np.arange(len(own)), sizes), n)
            seen = np.zeros(BUCKETS, bool)
            seen[flat] = True
            uniq = np.flatnonzero(seen)
            column[uniq] = np.arange(len(uniq))
            inv = column[flat]
            mix = np.bincount(doc * len(uniq) + inv, weights=share, minlength=len(own) * len(uniq)).reshape(len(own), -1).astype(np.float32)
            own_vectors = vectors[uniq]
            hidden = mix @ own_vectors
            z = hidden @ layer + bias
            z -= z.max(axis=1)[:, None]
            p = np.exp(z)
            p /= p.sum(axis=1)[:, None]
            p[np.arange(len(own)), y[own]] -= 1
            slope = rate * (1 - step / steps)
            grad_layer, grad = hidden.T @ p, mix.T @ (p @ layer.T)
            square[uniq] += (grad**2).mean(axis=1)
            vectors[uniq] = own_vectors - slope * grad / np.sqrt(square[uniq])[:, None]
            layer_square += grad_layer**2
            layer -= slope * grad_layer / np.sqrt(layer_square)
            grad_bias = p.sum(axis=0)
            bias_square += grad_bias**2
            bias -= slope * 0.1 * grad_bias / np.sqrt(bias_square)
            step += 1
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most: int = SAMPLE) -> tuple[list[str], list[int]]:
    """At most `most` labelled texts on the driver: those whose ids have the least hashes."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    there = docs.select(F.col(id_col).cast("long").alias("id"))
    chosen = known.join(there, "id", "left_semi").orderBy(F.xxhash64("id"), "id", "y").limit(most)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id", "y", F.crc32(F.col("t").cast("binary"))).limit(most)
    found = [(r.t, r.y) for r in rows.toLocalIterator()]
    return [t for t, _ in found], [y for _, y in found]


def scored(text: Column, model: Model, spark) -> Column:
    """The probability (double) of class 1 for whole texts."""
    held = spark.sparkContext.broadcast((model.weights, model.bias))  # a fixed size: BUCKETS numbers
    own: dict[str, Model] = {}

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if "model" not in own:
            own["model"] = Model(*held.value)
        whole = [t or "" for t in texts.to_pylist()]
        out = pa.array([x for lo, hi in in_parts(whole) for x in own["model"].score(whole[lo:hi])], pa.float64())
        del whole
        give_back()
        return out

    ship(spark)
    return score(text)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    return train(*sample(docs, labels, label, id_col, text_col))


def held_out(id_col: str, mod: int, rest: int) -> Column:
    """True where crc32 of the id as text leaves `rest`; null ids count as the text of nothing."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == rest


def op2_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    model = fit(docs, labels.where(~held_out("doc_id", 5, 0)))
    out = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), scored(F.col("text").cast("string"), model, docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
