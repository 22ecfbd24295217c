"""Vector, sparse, full-text and hybrid search, exact and distributed.

Full-text: words are runs of letters and digits, lower-cased. BM25 has k1 = 1.2, b = 0.75 and
idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Reciprocal ranks are 1 / (k + rank) with ranks from 1.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.expressions import vector, vector_distance
from tessera.session import cut

K1, B = 1.2, 0.75
WORD = "[^\\p{L}\\p{N}]+"


def vector_top_k(df: DataFrame, query: list[float], k: int, metric: str = "l2", id_col: str = "id", vec_col: str = "embedding", where: Column | None = None, allowed: DataFrame | None = None, query_dim: int | None = None) -> DataFrame:
    """(id, distance) of the k nearest; ties by id. Filters and `allowed` ids (a DataFrame with the id column) act before ranking.

    query_dim: compare the first so many dimensions only.
    """
    if where is not None:
        df = df.where(where)
    if allowed is not None:
        df = df.join(allowed.select(id_col).distinct(), id_col, "left_semi")
    v, q = F.col(vec_col), vector(query)
    if query_dim is not None:
        v, q = F.slice(v, 1, query_dim), vector(query[:query_dim])
    return df.select(F.col(id_col).alias("id"), vector_distance(v, q, metric).alias("distance")).orderBy("distance", "id").limit(k)


def vector_put(df: DataFrame, new: DataFrame, dim: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """df with the rows of `new` added, or replaced whole where the id is known; a vector of another dimension is an error."""
    right = F.when(F.col(vec_col).isNull() | (F.size(vec_col) == dim), F.col(vec_col)).otherwise(F.raise_error(F.lit(f"a vector has not {dim} dimensions")).cast(new.schema[vec_col].dataType))
    return df.join(new.select(id_col).distinct(), id_col, "left_anti").select(*df.columns).unionByName(new.withColumn(vec_col, right), allowMissingColumns=True)


def vector_delete(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(ids.select(id_col).distinct(), id_col, "left_anti").select(*df.columns)


def vector_stats(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """One row: vectors, rows without one, least and greatest dimension."""
    return df.agg(F.count(vec_col).alias("vectors"), F.count_if(F.col(vec_col).isNull()).alias("empty"), F.min(F.size(vec_col)).alias("least_dim"), F.max(F.size(vec_col)).alias("most_dim"))


def sparse_put(df: DataFrame, new: DataFrame, id_col: str = "id", map_col: str = "weights") -> DataFrame:
    """df with the maps of `new` added or replaced; a weight that isn't finite is an error."""
    bad = F.exists(F.map_values(map_col), lambda w: w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")))
    checked = new.withColumn(map_col, F.when(bad, F.raise_error(F.lit("weight is not finite")).cast(new.schema[map_col].dataType)).otherwise(F.col(map_col)))
    return df.join(new.select(id_col).distinct(), id_col, "left_anti").select(*df.columns).unionByName(checked, allowMissingColumns=True)


def sparse_top_k(df: DataFrame, query: dict[int, float], k: int, id_col: str = "id", map_col: str = "weights") -> DataFrame:
    """(id, score): dot products over shared dimensions, zero scores left out, ties by id. Weights must be finite."""
    terms = F.create_map(*[F.lit(x) for d, w in query.items() for x in (int(d), float(w))])
    own = df.select(F.col(id_col).alias("id"), F.explode(map_col).alias("dim", "weight")).where(F.col("dim").isin([int(d) for d in query]))
    own = own.withColumn("weight", F.when(F.isnan("weight") | (F.abs("weight") == float("inf")), F.raise_error(F.lit("weight is not finite")).cast("double")).otherwise(F.col("weight")))
    scores = own.groupBy("id").agg(F.sum(F.col("weight") * F.element_at(terms, F.col("dim"))).alias("score"))
    return scores.where("score <> 0").orderBy(F.desc("score"), "id").limit(k)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD), lambda w: w != "")


def spaced(text: Column) -> Column:
    """The words of words() in one string, with a space before, between and after them: counted and found there without arrays."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), WORD, " ")


def _occurrences(text: Column, part: str) -> Column:
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part.encode())).cast("int")


def _tally(text: str, terms: Sequence[str]) -> list[Column]:
    """`length` and `tf` of a column with a spaced() text: its words, and how often each term is among them."""
    apart = F.replace(F.col(text), F.lit(" "), F.lit("  "))  # else two words in a row would share a space
    return [(_occurrences(F.col(text), " ") - 1).alias("length"), F.array(*[_occurrences(apart, f" {t} ") for t in terms]).alias("tf")]


def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, length) of every document."""
    own = df.select(F.col(id_col).alias("id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    return own.select("id", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def expanded(terms: Sequence[str], synonyms: Sequence[Sequence[str]] = ()) -> list[str]:
    """Query terms with those of their synonym groups."""
    out = list(dict.fromkeys(t.lower() for t in terms))
    for group in synonyms:
        if any(t in out for t in group):
            out += [t for t in group if t not in out]
    return out


def asked_terms(query: str, synonyms: Sequence[Sequence[str]] = ()) -> list[str]:
    """The terms of a query text; a query with NOT is refused."""
    if re.search(r"\bNOT\b", query):
        raise ValueError("NOT queries are not supported")
    return expanded([w for w in re.split(r"[^\w]+|_", query) if w], synonyms)


def _counts(terms: Sequence[str], fuzzy: int) -> Column:
    """How often each term occurs among the words `w`."""
    one = lambda term: F.size(F.filter("w", lambda x: F.levenshtein(x, F.lit(term)) <= fuzzy))
    return F.array(*map(one, terms))


def _scores(x: DataFrame, terms: Sequence[str], mode: str, *keep: str) -> DataFrame:
    """(id, score, those of `keep`) of rows (id, admitted, length, tf: how often each of `terms` occurs); one pass gives the statistics, another the scores."""
    tf = [F.get("tf", F.lit(i)) for i in range(len(terms))]
    known = x.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"), *[F.count_if(t > 0).alias(f"d{i}") for i, t in enumerate(tf)]).first()
    total = F.lit(0.0)
    for i, t in enumerate(tf):
        idf = math.log(1 + (known.n - known[f"d{i}"] + 0.5) / (known[f"d{i}"] + 0.5))
        total = total + F.when(t > 0, idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("length") / F.lit(known.average or 1.0)))).otherwise(0.0)
    met = F.col("tf")
    enough = F.forall(met, lambda t: t > 0) if mode == "and" else F.exists(met, lambda t: t > 0)
    return x.where(F.col("admitted") & enough).select("id", total.alias("score"), *keep)


def bm25(df: DataFrame, query: str, id_col: str = "id", text_col: str = "text", mode: str = "or", admitted: Column | None = None, synonyms: Sequence[Sequence[str]] = (), fuzzy: int = 0) -> DataFrame:
    """(id, score) of the documents that match; statistics come from all documents, `admitted` limits those that are ranked.

    mode 'and' asks for every term. fuzzy: a term also matches words within that edit distance. Texts are read twice and no row is
    moved; for many queries over the same texts keep a text index (`textindex`).
    """
    terms = asked_terms(query, synonyms)
    text = words(F.coalesce(F.col(text_col), F.lit(""))) if fuzzy else spaced(F.col(text_col))
    own = df.select(F.col(id_col).alias("id"), text.alias("w"), (F.lit(True) if admitted is None else F.coalesce(admitted, F.lit(False))).alias("admitted"))
    if not terms:
        return own.where("false").select("id", F.lit(0.0).alias("score"))
    tally = [F.size("w").alias("length"), _counts(terms, fuzzy).alias("tf")] if fuzzy else _tally("w", terms)
    return _scores(own.select("id", "admitted", *tally), terms, mode)


def bm25_top_k(df: DataFrame, query: str, k: int, **options) -> DataFrame:
    return bm25(df, query, **options).orderBy(F.desc("score"), "id").limit(k)


def score_scan(df: DataFrame, query: str, id_col: str = "id", text_col: str = "text", where: Column | None = None) -> DataFrame:
    """Every admitted row with its score: 0 without a match, null for a null text."""
    scores = bm25(df, query, id_col, text_col)
    own = df if where is None else df.where(where)
    return own.join(scores.withColumnRenamed("id", id_col), id_col, "left").withColumn("score", F.when(F.col(text_col).isNotNull(), F.coalesce("score", F.lit(0.0))))


def phrase(df: DataFrame, query: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, score, position): documents with the words in a row; BM25 of all terms, damped by the first position: score / (1 + 0.01 * position)."""
    asked = asked_terms(query.lower())
    inorder = [w for w in re.split(r"[^\w]+|_", query.lower()) if w]
    if not asked:
        return df.sparkSession.createDataFrame([], f"id {df.schema[id_col].dataType.simpleString()}, score double, position int")
    text = df.select(F.col(id_col).alias("id"), spaced(F.col(text_col)).alias("w"))
    said = f" {' '.join(inorder)} "
    at = F.when(F.col("w").contains(said), _occurrences(F.substring_index("w", said, 1), " "))
    counted = cut(text.select("id", *_tally("w", asked), at.alias("position")).withColumn("admitted", F.col("position").isNotNull()))  # read again without the texts
    return _scores(counted, asked, "and", "position").select("id", (F.col("score") / (1 + 0.01 * F.col("position"))).alias("score"), "position")


def score_to_distance(score: Column) -> Column:
    return 1 - F.least(score / 20, F.lit(1.0))


def fused(legs: Sequence[tuple[DataFrame, float]], k: int) -> DataFrame:
    """(id, rrf_score): reciprocal-rank fusion of legs (id, rank from 1; constant)."""
    parts = [df.select("id", (1.0 / (F.lit(float(c)) + F.col("rank"))).alias("s")) for df, c in legs]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("id").agg(F.sum("s").alias("rrf_score")).orderBy(F.desc("rrf_score"), "id").limit(k)


def with_rank(top: DataFrame, *order: Column) -> DataFrame:
    """Ranks from 1 of an already cut leg (at most a few k rows)."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hybrid(df: DataFrame, query_vector: list[float], query_text: str, k: int, weight: float = 0.5, id_col: str = "id", vec_col: str = "embedding", text_col: str = "text", metric: str = "l2", graph: DataFrame | None = None, vector_k: int | None = None, text_k: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Vector and text legs of 3 k each (or vector_k, text_k), fused with the constants 60 * weight and 60 * (1 - weight).

    graph: a third leg (id, rank), with constant 60. allowed: ids that may be returned.
    """
    own = df if allowed is None else df.join(allowed.select(id_col).distinct(), id_col, "left_semi")
    near = with_rank(vector_top_k(own, query_vector, vector_k or 3 * k, metric, id_col, vec_col), F.col("distance"), F.col("id"))
    said = with_rank(bm25_top_k(own, query_text, text_k or 3 * k, id_col=id_col, text_col=text_col), F.desc("score"), F.col("id"))
    legs = [(near, 60 * weight), (said, 60 * (1 - weight))]
    return fused([*legs, (graph, 60.0)] if graph is not None else legs, k)
