"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text's tokens are its stretches of non-space characters, cut after TOKEN characters. K tokens in a row are kept (they are a
closed syncmer) if the least hash of their inner strings of S tokens is the first or the last. Whether a k-mer is kept depends on nothing
around it, so the kept ones are anchors that shared passages have in common, wherever they stand. The fingerprint is the SKETCH
anchors of the least hashes, each with its place (the first of equal ones). Two fingerprints are matched by place: of the least hashes
of both together, those count that both have and that stand in the same order in both, as many as a longest such chain has. The
likeness is their share: an estimate of the Jaccard similarity of the anchors of passages that the texts share in order.

A text without anchors (short ones) has one: its words, at place 0; only a text without tokens has an empty fingerprint, which
is like an empty one only. Nulls: a null
text is empty; a null id sorts below all others. Documents with one id follow each other in the order of their texts'
hashes and are sorted in one task. A lone document is its own next. Texts are read whole. Repeated rows are rows. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import NO_ID, partitions_for, range_bounds, range_bucket

TOKEN, K, S = 8, 4, 2
SKETCH = 64
BUCKET_BYTES = 8 << 20
_PLACE, _HASH = 24, 39  # bits of an anchor's place (places beyond are the last of these), below those of its hash
_LAST = (1 << _PLACE) - 1


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _above(hash_: Column) -> Column:
    """The upper bits of a hash, above an empty place."""
    return F.shiftleft(F.shiftrightunsigned(hash_, 64 - _HASH), _PLACE)


def _tokens(text: Column) -> Column:
    """Hashes of the tokens of a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"\S{{1,{TOKEN}}}"), F.lit(0)), lambda t: F.xxhash64(t))


def _inner(tokens: Column) -> Column:
    """Hashes of every S = 2 tokens in a row."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def anchors(text: Column) -> Column:
    """array<long>: the closed syncmers of a text in order, hash above place. Places count tokens from 0."""

    def kept(inner: Column) -> Column:  # of K - S + 1 = 3 inner strings in a row the middle one isn't less than both others
        last = lambda i: F.get(inner, i + 2)
        own = lambda a, i: _above(F.xxhash64(a, last(i))).bitwiseOR(F.least(i, F.lit(_LAST)).cast("long"))
        return F.array_compact(F.transform(inner, lambda a, i: F.when(F.least(a, last(i)) <= F.get(inner, i + 1), F.when(last(i).isNotNull(), own(a, i)))))

    return _let(_let(_tokens(text), _inner), kept)


def bottom(anchors: Column) -> Column:
    """The SKETCH anchors of the least hashes, ascending; of those of one hash the first in the text."""
    hash_ = lambda x: F.shiftright(x, _PLACE)
    ordered = lambda s: F.filter(s, lambda x, i: (i == 0) | (hash_(x) != hash_(F.get(s, i - 1))))
    return F.slice(_let(F.array_sort(anchors), ordered), 1, SKETCH)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text (array<long>)."""
    alone = F.when(text.rlike(r"\S"), F.array(_above(F.xxhash64(F.array_join(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), " "))))).otherwise(F.array().cast("array<long>"))
    return _let(bottom(anchors(text)), lambda p: F.when(F.size(p) == 0, alone).otherwise(p))


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`: array<long>, the fingerprint of column `text` (not null)."""
    return df.withColumn(out, fingerprint(F.col(text)))


def as_text(sketch: Column) -> Column:
    """A fingerprint as sixteen hex digits an anchor: hash, then place."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _chain(places: Column) -> Column:
    """How many of a list of places can be taken, in a row, so that they ascend (the longest such)."""

    def longer(ends: Column, x: Column) -> Column:  # ends[i]: the least place that a chain of i + 1 ends at
        return _let(F.size(F.filter(ends, lambda e: e < x)), lambda k: F.concat(F.slice(ends, F.lit(1), k), F.array(x), F.slice(ends, k + 2, F.lit(SKETCH))))

    return F.size(F.aggregate(places, F.array().cast("array<long>"), longer))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: of the SKETCH least hashes of both, the share that both have in the same order; two empty fingerprints are alike."""
    hashes = lambda s: F.transform(s, lambda x: F.shiftright(x, _PLACE))
    place = lambda x: x.bitwiseAND(F.lit(_LAST))

    def share(least: Column) -> Column:
        both = F.array_intersect(F.array_intersect(hashes(a), hashes(b)), least)
        of = lambda s, shared: F.filter(s, lambda x: F.array_contains(shared, F.shiftright(x, _PLACE)))
        pairs = lambda shared: F.zip_with(of(a, shared), of(b, shared), lambda x, y: F.shiftleft(place(x), _PLACE).bitwiseOR(place(y)))
        chain = _let(both, lambda shared: F.when(F.size(shared) < 2, F.size(shared)).otherwise(_chain(F.transform(F.array_sort(pairs(shared)), place))))
        return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(chain / F.size(least))

    return _let(F.slice(F.array_sort(F.array_union(hashes(a), hashes(b))), 1, SKETCH), share)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, sketch, next_text, next_sketch): every document with the one after it in descending order of ids.

    One shuffle of the texts: documents go to buckets of ids; the greatest of a bucket goes to the one above it, too,
    and the greatest of all to the lowest, where they only serve as the next of others.
    """
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size, top = own.agg(F.sum(F.octet_length("text")), F.max("id")).first()
    bounds = range_bounds(own, "id", partitions_for(size or 0, BUCKET_BYTES))
    place = range_bucket(F.col("id"), bounds)
    top = NO_ID if top is None else top
    sketched = with_sketch(own, "text", "sketch").withColumn("bucket", place.cast("int"))
    above = _is_bound(F.col("id"), F.col("bucket"), bounds)
    homes = F.array_compact(
        F.array(
            F.struct(F.col("bucket").alias("at"), F.lit(0).alias("role")),
            F.when(above, F.struct((F.col("bucket") + 1).alias("at"), F.lit(1).alias("role"))),
            F.when(F.col("id") == top, F.struct(F.lit(0).alias("at"), F.lit(2).alias("role"))),
        )
    )
    held = ["id", "text", "sketch"]
    sent = sketched.select(*held, F.explode(homes).alias("home")).select(*held, "home.at", "home.role").repartitionById(len(bounds) + 1, F.col("at"))  # a task for each bucket
    order = Window.partitionBy("at").orderBy((F.col("role") == 2).asc(), F.col("id").desc(), F.xxhash64("text"))
    after = sent.withColumn("next", F.lead(F.struct("text", "sketch")).over(order)).where("role = 0")
    return after.select(*held, F.col("next.text").alias("next_text"), F.col("next.sketch").alias("next_sketch"))


def _is_bound(key: Column, bucket: Column, bounds: list[int]) -> Column:
    """Whether key is the upper bound of its bucket."""
    if not bounds:
        return F.lit(False)
    return F.coalesce(F.get(F.array(*[F.lit(b).cast("long") for b in bounds]), bucket) == key, F.lit(False))


def op9_syncmers(docs: DataFrame) -> DataFrame:
    pairs = with_next(docs, "doc_id", "text").withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut))).drop("text", "next_text")
    both = with_sketch(edited, "edited", "edited_sketch")
    return both.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
