"""Problem 9: filling fixed-capacity containers with documents, sizes in tokens.

Cost-balanced packing. A document costs its tokens plus a quadratic term for attention. Documents are taken by falling
size; each goes to the container with the lowest cost so far that still has room. As many containers are open from the
start as the tokens need at least; what fits in none of them goes through the same again with new containers. Documents
longer than the capacity, and no others, are split: into full containers and one rest, which is packed like a document.

Documents are spread over shards of about SHARD items by hash of their id, each packed on its own, so no task holds
more than a shard whatever a source's share is; a shard wastes at most the room of its last containers.

Defined results: null and empty texts have no tokens and go to a container like others (they take no room); a capacity
that is null or below one is left out; equal sizes are taken by id; repeated documents are packed each; container ids
are unique within a size; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.encoding import count_column, read_vocabulary, spread
from rollcall.session import broadcast_if_small, cut

#: Items packed together, and the attention cost of a token pair relative to the linear cost of a token.
SHARD, QUADRATIC = 8192, 1 / 2048
PACKED = "size_id int, container_id string, doc_id long, part int, start_token long, n_tokens long"


def pack(sizes: np.ndarray, capacity: int, quadratic: float = QUADRATIC) -> np.ndarray:
    """Container numbers of items no larger than the capacity, in the order given."""
    cost = sizes + quadratic * sizes.astype(float) ** 2
    out = np.full(len(sizes), -1, np.int64)
    waiting, opened = np.argsort(-sizes, kind="stable"), 0
    while len(waiting):
        n = max(1, -(-int(sizes[waiting].sum()) // capacity))
        room, load = np.full(n, capacity, np.int64), np.zeros(n)
        left = []
        for i in waiting:
            fits = room >= sizes[i]
            if not fits.any():
                left.append(i)
                continue
            at = int(np.where(fits, load, np.inf).argmin())
            out[i] = opened + at
            room[at] -= sizes[i]
            load[at] += cost[i]
        opened += n
        waiting = np.array(left, np.int64)
    return out


def _shard(quadratic: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "part"], ascending=[False, True, True], kind="stable")
        got = pack(pdf["n_tokens"].to_numpy(np.int64), int(pdf["capacity"].iloc[0]), quadratic)
        names = [f"{s}-{c}" for s, c in zip(pdf["shard"], got)]
        return pdf.assign(container_id=names)[["size_id", "container_id", "doc_id", "part", "start_token", "n_tokens"]]

    return run


def fill_containers(documents: DataFrame, capacities: DataFrame, vocabulary: bytes | None = None, shard: int = SHARD, quadratic: float = QUADRATIC) -> DataFrame:
    """(size_id, container_id, doc_id, part, start_token, n_tokens) of every document, or part of a longer one, for every capacity."""
    counted = cut(spread(documents.select("doc_id", "text")).select("doc_id", count_column("text", vocabulary or read_vocabulary()).cast("long").alias("tokens")))
    shards = max(1, -(-counted.count() // shard))
    sizes = capacities.filter("capacity_tokens >= 1").select("size_id", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    both = counted.crossJoin(broadcast_if_small(sizes))  # one row per container size
    full = F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity"))).otherwise(0).cast("long")
    both = both.withColumn("_full", full).withColumn("_rest", F.col("tokens") - F.col("_full") * F.col("capacity"))
    whole = both.filter("_full > 0").select("size_id", "doc_id", "capacity", F.explode(F.sequence(F.lit(0), F.col("_full").cast("int") - 1)).alias("part"))
    whole = whole.select("size_id", F.concat_ws("-", F.lit("full"), "doc_id", "part").alias("container_id"), "doc_id", "part", (F.col("part") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"))
    items = both.filter("_full = 0 or _rest > 0").select("size_id", "doc_id", "capacity", F.col("_full").cast("int").alias("part"), (F.col("_full") * F.col("capacity")).alias("start_token"), F.col("_rest").alias("n_tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))
    return whole.unionByName(items.groupBy("size_id", "shard").applyInPandas(_shard(quadratic), PACKED))


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(size_id, containers, tokens, filled): how full the containers are."""
    one = packed.groupBy("size_id", "container_id").agg(F.sum("n_tokens").alias("used"))
    per = one.groupBy("size_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"))
    return per.join(broadcast_if_small(capacities.select("size_id", "capacity_tokens").distinct()), "size_id").select("size_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("filled"))
