"""Language identification by words first, then shorter and shorter character n-grams.

The model is learned from at most SAMPLE different labelled texts of each language, those of the least hashes (a documented bound; copies
of a text count once). Of these, words and the character n-grams (four letters down to one) of their words are counted by
language, and all of them are kept: there is no cap on words or n-grams. What a text repeats counts as often as its number has binary digits,
so that no text of one word over and over outweighs a language. A known word scores its log frequency in each
language. An unseen word is looked at as n-grams: the longest length of which any n-gram is known decides, by the mean of
their log frequencies. A document's score in a language is the sum over its words, repeats included.

Nulls: rows with a null language aren't learned from; a null text, or one without a letter, is `und` with score 0. So is
every text if nothing was learned. Ties go to the language that sorts first. A text with several languages is learned in each.
Rows are predicted one by one, repeated ones too; texts are read whole, in learning and in prediction. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import forget, ship, written
from tessera.llm.tokenizing import in_parts

SAMPLE = 4_000  # texts of each language that are learned from at most
LONGEST = 4
FLUSH = 150_000  # distinct tokens that a task holds before it emits their counts
LONG, FLUSH_LONG = 60, 1 << 21  # tokens above LONG characters count by these, too: text without spaces
CACHE = 200_000
SMOOTH = 0.5
_LETTERS = re.compile(r"[^\W\d_]+")


def letters(token: str) -> list[str]:
    """The lower-cased words (runs of letters) of a white-space token."""
    return _LETTERS.findall(token.lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (size, gram, lang, n): size 0 is a word, others n-grams."""
    own: dict[str, Counter] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, tokens in own.items():
            counts: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
            whole = counts[0]
            for token, n in tokens.items():
                for w in letters(token):
                    whole[w] = whole.get(w, 0) + n
            for w, n in whole.items():
                for size in range(1, LONGEST + 1):
                    c = counts[size]
                    for g in grams(w, size):
                        c[g] = c.get(g, 0) + n
            for size, c in enumerate(counts):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), size, np.int32)), pa.array(list(c), pa.string()), pa.array([lang] * len(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["size", "gram", "lang", "n"])
        own.clear()

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1)
        for lang, text in zip(langs, texts, strict=True):
            tokens = (text.as_py() or "").split()
            own.setdefault(lang, Counter()).update({t: n.bit_length() for t, n in Counter(tokens).items()})
            held += sum(n for n in map(len, tokens) if n > LONG)
            if sum(map(len, own.values())) > FLUSH or held > FLUSH_LONG:
                yield from flush()
                held = 0
    yield from flush()


def sample(docs: DataFrame, text_col: str, lang_col: str, most: int) -> DataFrame:
    """(lang, text): of each language the `most` different texts of the least hashes, or all.

    A first look at hashes tells about which share of a language's texts that is, so that only few texts are moved.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    hashed = labelled.withColumn("h", F.xxhash64("text"))
    kinds = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).where(F.col("n") > most)
    shares = {r.lang: 1.3 * most / r.n for r in kinds.collect()}  # one row for each language
    keep = F.lit(True)
    for lang, share in shares.items():
        keep = F.when(F.col("lang") == lang, F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40))).otherwise(keep)
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h", "text")
    few = hashed.where(keep).dropDuplicates(["lang", "text"])
    return few.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).select("lang", "text")


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE) -> dict:
    """The model: languages, log frequencies of known words and n-grams, and those of unseen ones."""
    ship(docs.sparkSession)
    chosen = written(sample(docs, text_col, lang_col, most), "sample")
    part = written(chosen.mapInArrow(_count, "size int, gram string, lang string, n long"), "counts")
    counted = part.groupBy("size", "gram", "lang").agg(F.sum("n").alias("n")).toArrow()  # the words of `most` texts a language
    forget(chosen, part)
    sizes, n = counted["size"].to_numpy(), counted["n"].to_numpy()
    names = counted["lang"].combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    place = np.array([langs.index(x) for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()] if len(n) else np.zeros(0, np.int64)
    model: dict = {"langs": langs, "known": [], "logs": []}
    for size in range(LONGEST + 1):
        own = np.flatnonzero(sizes == size)
        grams_ = counted["gram"].combine_chunks().take(pa.array(own)).dictionary_encode()
        counts = np.zeros((len(grams_.dictionary), len(langs)))
        counts[grams_.indices.to_numpy(), place[own]] = n[own]
        types = int(max((counts > 0).sum(axis=0), default=1)) if len(counts) else 1
        model["known"].append({g: i for i, g in enumerate(grams_.dictionary.to_pylist())})
        model["logs"].append(np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * (types + 1))).astype(np.float32))
    return model


class Scorer:
    """Scores of whole texts, with the sums of tokens kept in a bounded cache."""

    def __init__(self, model: dict):
        self.model, self.rows = model, {}
        self.table = np.zeros((0, len(model["langs"])), np.float32)

    def _sums(self, tokens: list[str]) -> np.ndarray:
        """Per token the summed log scores of its words; zero without letters."""
        known, logs = self.model["known"], self.model["logs"]
        out = np.zeros((len(tokens), len(self.model["langs"])), np.float64)
        hits: list[list[int]] = [[] for _ in known]
        owner: list[list[int]] = [[] for _ in known]
        share: list[list[float]] = [[] for _ in known]
        for i, token in enumerate(tokens):
            for w in letters(token):
                at = known[0].get(w)
                if at is not None:
                    hits[0].append(at)
                    owner[0].append(i)
                    share[0].append(1.0)
                    continue
                for size in range(LONGEST, 0, -1):
                    table = known[size]
                    found = [table[g] for g in grams(w, size) if g in table]
                    if found:
                        hits[size] += found
                        owner[size] += [i] * len(found)
                        share[size] += [1 / len(found)] * len(found)
                        break
        for size, rows in enumerate(hits):
            if rows:
                np.add.at(out, np.array(owner[size]), logs[size][np.array(rows)] * np.array(share[size])[:, None])
        return out.astype(np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        split = [t.split() for t in texts]
        if len(self.rows) > CACHE:
            self.rows, self.table = {}, self.table[:0]
        missing = list(set().union(*split).difference(self.rows))
        if missing:
            self.table = np.concatenate([self.table, self._sums(missing)])
            self.rows.update(zip(missing, range(len(self.rows), len(self.rows) + len(missing)), strict=True))
        langs, get = self.model["langs"], self.rows.__getitem__
        names, scores = [], []
        for text, words in zip(texts, split, strict=True):
            if not langs or not _LETTERS.search(text):
                names.append("und")
                scores.append(0.0)
                continue
            z = self.table[np.fromiter(map(get, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
            p = np.exp(z - z.max())
            best = int(z.argmax())
            names.append(langs[best])
            scores.append(float(p[best] / p.sum()))
        return names, scores


def identified(text: Column, model: dict, spark) -> Column:
    """struct<lang, score> of whole texts."""
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # the words and n-grams of at most SAMPLE texts a language
    own: dict[str, Scorer] = {}

    @F.arrow_udf("struct<lang: string, score: double>")
    def of(texts: pa.Array) -> pa.Array:
        if "scorer" not in own:
            own["scorer"] = Scorer(held.value)
        whole = [t or "" for t in texts.to_pylist()]
        names, scores = [], []
        for lo, hi in in_parts(whole):
            a, b = own["scorer"].predict(whole[lo:hi])
            names += a
            scores += b
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return of(text)


def op4_language(docs: DataFrame) -> DataFrame:
    out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    model = learn(docs.where(~out))
    found = docs.select("doc_id", out.alias("held_out"), identified(F.col("text").cast("string"), model, docs.sparkSession).alias("_f"))
    return found.select("doc_id", "held_out", F.col("_f.lang").alias("lang_pred"), F.col("_f.score").alias("score"))
