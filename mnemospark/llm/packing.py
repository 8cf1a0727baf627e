"""Filling containers of fixed capacity by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, small

#: Containers that one differencing run fills; the last of a run holds the slack, so waste is about one part in this many.
WINDOWS = 96
#: Room that a container may leave and still be kept while others overflow.
SLACK = 0.02
SPEC_LIMIT = 1000
#: Items of a run at most on average; many small ones would need much memory for their partial partitions.
RUN_ITEMS = 20_000
SCHEMA = "spec_id int, container string, doc_id bigint, piece int, token_start bigint, token_end bigint, n_tokens bigint"


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """(container of each item, largest load) of the k-way differencing method.

    Every item starts as a partition with one loaded container. The two
    partitions of largest imbalance are merged, the fullest container of one
    onto the emptiest of the other, until one is left.
    """
    n = len(sizes)
    if k <= 1 or n <= 1:
        return np.zeros(n, np.int64), int(sizes.sum())
    loads: list[np.ndarray | None] = [None] * (2 * n - 1)
    merged: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)

    def load(node: int) -> np.ndarray:
        if node < n:
            out = np.zeros(k, np.int64)
            out[0] = sizes[node]
            return out
        out, loads[node] = loads[node], None
        return out

    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = load(a) + load(b)[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        node = n + len(merged)
        merged.append((a, b, order))
        loads[node] = total
        heapq.heappush(heap, (-int(total[0] - total[-1]), node))
    out = np.zeros(n, np.int64)
    root = n + len(merged) - 1
    highest = int(loads[root][0])
    places: dict[int, np.ndarray] = {root: np.arange(k)}
    # places[node][slot] is the container that the node's slot ended in.
    for node in range(root, n - 1, -1):
        a, b, order = merged[node - n]
        here = places.pop(node)
        back = np.empty(k, np.int64)
        back[order] = here
        for child, slots in ((a, back), (b, back[::-1])):
            if child < n:
                out[child] = slots[0]
            else:
                places[child] = slots
    return out, highest


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item; none above ``capacity`` may be among them.

    Differencing gives near-equal containers. If all hold, that's it. Else
    those that hold and are full but for ``SLACK`` are kept and the other
    items are divided again; if there is none, the count of containers rises.
    """
    out = np.empty(len(sizes), np.int64)
    left, named, k = np.arange(len(sizes)), 0, 0
    while len(left):
        k = max(k, 1, -(-int(sizes[left].sum()) // capacity))
        if k >= len(left):
            out[left] = named + np.arange(len(left))
            break
        containers, highest = difference(sizes[left], k)
        if highest <= capacity:
            out[left] = named + containers
            break
        loads = np.bincount(containers, sizes[left], k)
        full = np.flatnonzero((loads <= capacity) & (loads >= capacity * (1 - SLACK)))
        if len(full):
            numbers = np.full(k, -1)
            numbers[full] = named + np.arange(len(full))
            kept = numbers[containers] >= 0
            out[left[kept]] = numbers[containers[kept]]
            left, named, k = left[~kept], named + len(full), 0
        else:
            k += 1 if k < 200 else k // 100
    return out


def pack_documents(sizes: DataFrame, specs: DataFrame, doc_id: str = "doc_id", n_tokens: str = "n_tokens", windows: int = WINDOWS) -> DataFrame:
    """One row per piece of a document and spec: spec_id, container, doc_id, piece, token_start, token_end, n_tokens.

    ``sizes`` has a unique doc_id and its count of tokens, ``specs`` spec_id
    and capacity_tokens (at most ``SPEC_LIMIT`` rows). Only a document above
    the capacity is cut, into full containers and a rest that is packed like
    any other item. Documents of null or no tokens fill nothing and have
    container null. Specs with a null or non-positive capacity are left out;
    empty tables give no rows.

    Items are spread by hash over runs of about ``windows`` containers, and of
    ``RUN_ITEMS`` items at most on average, whose number follows from the
    totals, so a run's work does not grow with the data.
    """
    chosen = [r for r in specs.select("spec_id", "capacity_tokens").limit(SPEC_LIMIT + 1).collect() if r.capacity_tokens and r.capacity_tokens > 0]
    if len(chosen) > SPEC_LIMIT:
        raise ValueError(f"more than {SPEC_LIMIT} specs")
    spark = sizes.sparkSession
    if not chosen:
        return spark.createDataFrame([], SCHEMA)
    base = cut(sizes.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(n_tokens), F.lit(0)).cast("bigint").alias("size")))
    rests = base.agg(*[x for i, r in enumerate(chosen) for x in (F.coalesce(F.sum(F.col("size") % r.capacity_tokens), F.lit(0)).alias(f"r{i}"), F.count_if(F.col("size") % r.capacity_tokens > 0).alias(f"n{i}"))]).first()
    plans = [F.struct(F.lit(r.spec_id).cast("int").alias("spec_id"), F.lit(r.capacity_tokens).cast("bigint").alias("capacity"), F.lit(max(1, round(rests[f"r{i}"] / (windows * r.capacity_tokens)), -(-rests[f"n{i}"] // RUN_ITEMS))).cast("bigint").alias("runs")) for i, r in enumerate(chosen)]
    items = base.select("doc_id", "size", F.explode(F.array(*plans)).alias("s")).select("doc_id", "size", "s.*").withColumn("full", F.floor(F.col("size") / F.col("capacity")))
    cuts = items.where("full > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("full"))).alias("p"))
    whole = cuts.select(
        "spec_id", F.concat(F.lit("full-"), F.col("doc_id"), F.lit("-"), F.col("p")).alias("container"), "doc_id", F.col("p").cast("int").alias("piece"),
        ((F.col("p") - 1) * F.col("capacity")).alias("token_start"), (F.col("p") * F.col("capacity")).alias("token_end"), F.col("capacity").alias("n_tokens"),
    )
    nothing = items.where("size = 0").select("spec_id", F.lit(None).cast("string").alias("container"), "doc_id", F.lit(1).alias("piece"), F.lit(0).cast("bigint").alias("token_start"), F.lit(0).cast("bigint").alias("token_end"), F.lit(0).cast("bigint").alias("n_tokens"))
    loose = items.where("size % capacity > 0").select("spec_id", "capacity", F.pmod(F.xxhash64("doc_id", "spec_id"), F.col("runs")).alias("run"), "doc_id", (F.col("full") + 1).cast("int").alias("piece"), "size", (F.col("size") % F.col("capacity")).alias("rest"))

    def fill(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values(["rest", "doc_id"], ascending=[False, True], ignore_index=True)
        containers = pack(run["rest"].to_numpy(np.int64), int(run["capacity"].iloc[0]))
        return pd.DataFrame({
            "spec_id": run["spec_id"], "container": [f"{r}-{c}" for r, c in zip(run["run"], containers, strict=True)], "doc_id": run["doc_id"], "piece": run["piece"],
            "token_start": run["size"] - run["rest"], "token_end": run["size"], "n_tokens": run["rest"],
        })

    return loose.groupBy("spec_id", "run").applyInPandas(fill, SCHEMA).unionByName(whole).unionByName(nothing)


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers, the tokens in them and the share of their capacity that is filled."""
    loads = packed.where("container is not null").groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("load"))
    per = loads.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("load").alias("tokens"), F.max("load").alias("largest"))
    return per.join(small(specs.select("spec_id", "capacity_tokens"), SPEC_LIMIT), "spec_id").withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
