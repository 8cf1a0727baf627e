"""Nearest neighbours by cosine: exact in blocks, and by an inverted file over cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block; a block pair is one matrix product.
BLOCK = 2048
#: Vectors on which cells are fitted at most.
FIT_ROWS = 20_000


def _matrix(vectors: pd.Series) -> np.ndarray:
    out = np.array([np.asarray(v, np.float64) for v in vectors])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _usable(df: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vector")).where((F.size("vector") == dimension) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))


def _blocks(df: DataFrame, size: int) -> DataFrame:
    """One row per block: keys and the vectors themselves, packed."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), size):
                piece = part.iloc[at : at + size]
                yield pd.DataFrame({"keys": [piece["key"].tolist()], "data": [_matrix(piece["vector"]).tobytes()]})

    return df.mapInPandas(pack, "keys array<bigint>, data binary")


def _best(k: int, threshold: float):
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                q, x = (np.frombuffer(d, np.float64).reshape(len(n), -1) for n, d in ((row.qkeys, row.qdata), (row.keys, row.data)))
                similar = q @ x.T
                qk, xk = np.asarray(row.qkeys), np.asarray(row.keys)
                similar[qk[:, None] == xk[None, :]] = -2.0
                n = min(k, similar.shape[1])
                nearest = np.argpartition(-similar, n - 1, axis=1)[:, :n]
                out = pd.DataFrame({"query": np.repeat(qk, n), "key": xk[nearest].ravel(), "cosine": np.clip(np.take_along_axis(similar, nearest, 1).ravel(), -2, 1)})
                yield out[out["cosine"] >= max(threshold, -1.0)]

    return score


def _top(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.round("cosine", 9).desc(), "key")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_exact(df: DataFrame, queries: DataFrame, key: str, vector: str, dimension: int, k: int = 10, threshold: float = -1.0) -> DataFrame:
    """(query, key, cosine, rank): the ``k`` rows nearest to each query vector, itself left out.

    Vectors of another dimension, or with nulls, are left out; zero vectors
    have cosine 0. The stated query set is packed into blocks, as are the
    rows. Blocks of rows are dealt over a grid whose other side are the blocks
    of queries, of which each column of the grid gets every one, so blocks meet
    by an equi-join and each two are one matrix product whose best ``k`` go on.
    """
    wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _blocks(_usable(df, key, vector, dimension), BLOCK).withColumn("cell", F.pmod(F.xxhash64(F.element_at("keys", 1), F.size("keys")), F.lit(wide)))
    asked = _blocks(_usable(queries, key, vector, dimension), BLOCK).select(F.col("keys").alias("qkeys"), F.col("data").alias("qdata"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(wide - 1).cast("bigint"))).alias("cell"))
    pairs = rows.join(asked, "cell").select("qkeys", "qdata", "keys", "data")
    return _top(pairs.mapInPandas(_best(k, threshold), "query bigint, key bigint, cosine double"), k)


def fit_cells(df: DataFrame, key: str, vector: str, dimension: int, cells: int, rounds: int = 12, limit: int = FIT_ROWS) -> np.ndarray:
    """Unit centres of ``cells`` cells, fitted by spherical k-means on at most ``limit`` rows chosen by hash."""
    sample = _usable(df, key, vector, dimension).orderBy(F.xxhash64("key")).limit(limit).toPandas()
    x = _matrix(sample["vector"]) if len(sample) else np.zeros((0, dimension))
    centres = x[: min(cells, len(x))].copy()
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1) if len(centres) else np.zeros(0, int)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def knn_cells(df: DataFrame, queries: DataFrame, key: str, vector: str, dimension: int, centres: np.ndarray, probes: int, k: int = 10) -> DataFrame:
    """Like :func:`knn_exact`, but rows are compared with queries that probe their cell only.

    Every row is indexed. Cells are counted, and one of more than ``BLOCK``
    rows is dealt into several parts, each of which meets all the cell's
    queries; rows and queries of a part are packed, so a part is a few matrix
    products and no task holds a cell.
    """

    def cells_of(n: int):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    unit = _matrix(part["vector"])
                    near = np.argsort(-(unit @ centres.T), axis=1)[:, :n]
                    data = [v.tobytes() for v in unit]
                    yield pd.DataFrame({"key": np.repeat(part["key"].to_numpy(), near.shape[1]), "data": np.repeat(np.array(data, object), near.shape[1]), "cell": near.ravel()})

        return run

    schema = "key bigint, data binary, cell int"
    placed = _usable(df, key, vector, dimension).mapInPandas(cells_of(1), schema)
    # One row per cell; centres are few.
    parts = {r.cell: max(1, -(-r["count"] // BLOCK)) for r in placed.groupBy("cell").count().collect()}
    of = F.create_map(*[F.lit(x) for c in range(len(centres)) for x in (c, parts.get(c, 1))]) if len(centres) else F.lit(None)
    packed = lambda rows, keys, data: rows.groupBy("cell", "part").agg(F.collect_list(F.struct("key", "data")).alias("v")).select("cell", "part", F.col("v.key").alias(keys), F.array_join(F.transform("v.data", lambda d: F.hex(d)), "").alias(data))
    rows = packed(placed.withColumn("part", F.pmod(F.xxhash64("key"), of[F.col("cell")].cast("bigint"))), "keys", "data")
    probing = _usable(queries, key, vector, dimension).mapInPandas(cells_of(probes), schema).withColumn("turn", F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(64)))
    asked = probing.groupBy("cell", "turn").agg(F.collect_list(F.struct("key", "data")).alias("v")).select("cell", F.col("v.key").alias("qkeys"), F.array_join(F.transform("v.data", lambda d: F.hex(d)), "").alias("qdata"), F.explode(F.sequence(F.lit(0).cast("bigint"), of[F.col("cell")].cast("bigint") - 1)).alias("part"))
    pairs = rows.join(asked, ["cell", "part"]).select("qkeys", F.unhex("qdata").alias("qdata"), "keys", F.unhex("data").alias("data"))
    return _top(pairs.mapInPandas(_best(k, -1.0), "query bigint, key bigint, cosine double"), k)
