"""Lexical retrieval: postings with BM25, document frequencies by containment and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_of

K1, B = 1.2, 0.75


def haystack() -> Column:
    """The lower-cased text of a memory in which terms are looked for."""
    return F.lower(F.concat_ws(" ", "content", "evidence", F.concat_ws(" ", "tags"), "subject.name", "subject.id", "object.name", "object.id", "group_id"))


def words(text: Column) -> Column:
    """Runs of letters, digits and '_', lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def postings(df: DataFrame, key: str, text: Column) -> DataFrame:
    """Inverted index (term, key, tf, n_terms) of :func:`words`. Rows without terms have none."""
    rows = df.select(F.col(key).alias("key"), words(text).alias("words")).where(F.size("words") > 0)
    return rows.select("key", F.size("words").alias("n_terms"), F.explode("words").alias("term")).groupBy("term", "key", "n_terms").agg(F.count(F.lit(1)).alias("tf"))


def corpus_totals(df: DataFrame, text: Column) -> tuple[int, float]:
    """(documents with terms, their mean number of terms), without making an index."""
    n = F.size(words(text))
    row = df.select(n.alias("n")).where("n > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean")).first()
    return row.n, row.mean or 1.0


def bm25(index: DataFrame, terms: list[str], n_documents: int, mean_terms: float) -> DataFrame:
    """(key, score) of every document that has one of ``terms``.

    The filter on terms reaches the index, so with postings stored by term only
    the lists asked for are read.
    """
    hit = index.where(F.col("term").isin(terms))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.lit(float(n_documents)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_terms") / F.lit(mean_terms)))
    return hit.join(F.broadcast(df), "term").groupBy("key").agg(F.sum(part).alias("score"))


def containment_idf(pool: DataFrame, hay: Column, terms: list[str]) -> DataFrame:
    """(term, df, idf) over a pool, by substring containment, in one pass; terms that no row contains are left out."""
    counts = pool.agg(F.count(F.lit(1)).alias("n"), *[F.sum(hay.contains(t).cast("bigint")).alias(f"t{i}") for i, t in enumerate(terms)])
    rows = counts.select("n", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("df")) for i, t in enumerate(terms)])).alias("x")).select("n", "x.*")
    return rows.where("df > 0").select("term", "df", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def containment_score(hay: Column, idf: dict[str, float]) -> Column:
    """Saturated sum of idf over the terms a text contains; no length normalisation."""
    total = F.lit(0.0)
    for term, weight in idf.items():
        n = count_of(hay, F.lit(term))
        total = total + F.lit(weight) * (n * 2.2) / (n + 1.2)
    return total
