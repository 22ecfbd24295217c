"""A text index that is built once: postings of one or more fields, searched without reading the texts again.

An index is two tables that may be kept anywhere: postings (field, term, id, tf), sorted by field and term where they are
stored, so that a search reads only the row groups of its terms; and lengths (field, id, length) of every document, empty ones too. Changes
to documents give a new index; a document has one entry for each field.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.search import K1, WORD, B, asked_terms

STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


def _split(text: Column, by: str) -> Column:
    return F.filter(F.split(text, by), lambda w: w != "")


ANALYZERS = {
    "standard": lambda text: _split(F.lower(text), WORD),
    "simple": lambda text: _split(F.lower(text), "[^\\p{L}]+"),
    "whitespace": lambda text: _split(text, "\\s+"),
    "keyword": lambda text: F.filter(F.array(text), lambda w: w != ""),
    "stop": lambda text: F.filter(_split(F.lower(text), WORD), lambda w: ~w.isin(*STOP_WORDS)),
}


@dataclass(frozen=True)
class TextIndex:
    postings: DataFrame
    lengths: DataFrame
    fields: tuple[str, ...]
    analyzer: str = "standard"
    fuzzy: int = 0  # edit distance of searches that don't say
    synonyms: Sequence[Sequence[str]] = field(default=())

    def _entries(self, docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
        texts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), ANALYZERS[self.analyzer](F.coalesce(F.col(f).cast("string"), F.lit(""))).alias("w")) for f in self.fields])).alias("t")
        own = docs.select(F.col(id_col).alias("id"), texts).select("id", "t.field", "t.w")
        terms = own.select("field", "id", F.explode("w").alias("term")).groupBy("field", "term", "id").agg(F.count(F.lit(1)).alias("tf"))
        return terms, own.select("field", "id", F.size("w").alias("length"))

    def put(self, docs: DataFrame, id_col: str = "id") -> TextIndex:
        """With documents added, or replaced where the id is known."""
        terms, lengths = self._entries(docs, id_col)
        rest = self.remove(docs.select(F.col(id_col).alias("id")))
        return replace(self, postings=rest.postings.unionByName(terms), lengths=rest.lengths.unionByName(lengths))

    def remove(self, ids: DataFrame) -> TextIndex:
        gone = ids.select("id").distinct()
        return replace(self, postings=self.postings.join(gone, "id", "left_anti").select("field", "term", "id", "tf"), lengths=self.lengths.join(gone, "id", "left_anti").select("field", "id", "length"))

    def search(self, query: str, field: str | None = None, mode: str = "or", fuzzy: int | None = None, admitted: DataFrame | None = None) -> DataFrame:
        """(id, score): BM25 over one field, or the sum over all of them; `admitted` (id) limits what is ranked, not the statistics.

        A field that isn't indexed is an error if there are others, and gives nothing in an index without fields.
        """
        if field is not None and field not in self.fields:
            if self.fields:
                raise ValueError(f"field {field!r} has no text index")
            return self.lengths.where("false").select("id", F.lit(0.0).alias("score"))
        terms = list(dict.fromkeys(asked_terms(query, self.synonyms) if self.analyzer not in ("whitespace", "keyword") else [query] if self.analyzer == "keyword" else query.split()))
        near = self.fuzzy if fuzzy is None else fuzzy
        own = self.postings if field is None else self.postings.where(F.col("field") == field)
        lengths = self.lengths if field is None else self.lengths.where(F.col("field") == field)
        if near:
            close = F.filter(F.array(*map(F.lit, terms)), lambda a: F.levenshtein(F.col("term"), a) <= near)
            own = own.select("field", "id", "tf", F.explode(close).alias("term")).groupBy("field", "term", "id").agg(F.sum("tf").alias("tf"))
        else:
            own = own.where(F.col("term").isin(terms))  # reaches the scan
        sizes = {r.field: (r.n, r.average) for r in lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average")).collect()}  # one row a field
        seen = own.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).collect()  # one row for each field and term
        weight, average = F.lit(0.0), F.lit(1.0)
        for r in seen:
            n = sizes[r.field][0]
            weight = F.when((F.col("field") == r.field) & (F.col("term") == r.term), math.log(1 + (n - r.df + 0.5) / (r.df + 0.5))).otherwise(weight)
        for f, (_, mean) in sizes.items():
            average = F.when(F.col("field") == f, mean or 1.0).otherwise(average)
        if admitted is not None:
            own = own.join(admitted.select("id").distinct(), "id", "left_semi")
        x = own.join(lengths, ["field", "id"])
        part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / average))
        scores = x.groupBy("id").agg(F.sum(part).alias("score"), F.count_distinct("term").alias("_n"))
        return (scores.where(F.col("_n") == len(terms)) if mode == "and" else scores).drop("_n")

    def save(self, path: str, files: int | None = None) -> TextIndex:
        """Write both tables and read them back; postings are sorted by field and term over all files."""
        spark = self.lengths.sparkSession
        parts = [files] if files else []
        self.postings.repartitionByRange(*parts, "field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        return load(spark, path, self.fields, self.analyzer, self.fuzzy, self.synonyms)


def build(docs: DataFrame, fields: Sequence[str], id_col: str = "id", analyzer: str = "standard", fuzzy: int = 0, synonyms: Sequence[Sequence[str]] = ()) -> TextIndex:
    """The index of some text columns of a table with unique ids."""
    if analyzer not in ANALYZERS:
        raise ValueError(f"unknown analyzer {analyzer!r}")
    kind = docs.schema[id_col].dataType.simpleString()
    none = docs.sparkSession.createDataFrame([], f"field string, term string, id {kind}, tf bigint"), docs.sparkSession.createDataFrame([], f"field string, id {kind}, length int")
    index = TextIndex(*none, tuple(fields), analyzer, fuzzy, synonyms)
    terms, lengths = index._entries(docs, id_col) if fields else none
    return replace(index, postings=terms, lengths=lengths)


def load(spark: SparkSession, path: str, fields: Sequence[str], analyzer: str = "standard", fuzzy: int = 0, synonyms: Sequence[Sequence[str]] = ()) -> TextIndex:
    return TextIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), tuple(fields), analyzer, fuzzy, synonyms)
