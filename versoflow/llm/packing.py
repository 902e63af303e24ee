"""Problem 6: texts assigned to containers of fixed token capacity.

Method: large-item matching. Documents above a third of the capacity, of which at most two fit a container, are
paired greedily, the largest with the largest that still fits; smaller documents then go where they leave the
least space. A document is divided only if it alone exceeds the capacity: into full containers and a rest.

Scale: items are dealt by hash to shards of a bounded number of tokens, and each shard is packed by itself. The
loss is one part-filled container a shard, at most ``1 / CONTAINERS`` of the space.

Defined results: null and empty texts have 0 tokens and take no space; they are assigned too. Repeated documents
are items each for itself. Profiles without a positive capacity are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoflow.llm.tokens import TOKENIZERS, VOCABULARY, token_counts
from versoflow.session import materialize

#: Containers that a shard fills, about.
CONTAINERS = 2000

ITEMS = "profile string, shard int, container_no int, doc_id bigint, part_no int, first_token bigint, n_tokens bigint, capacity_tokens int"


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, numbered from 0; every size is at most the capacity."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.full(len(sizes), -1, dtype=np.int64)
    large = [int(i) for i in order if 3 * sizes[i] > capacity]
    small = [int(i) for i in order if 0 < 3 * sizes[i] <= capacity]
    # partners still free, ascending by size; each large item takes the largest that fits beside it
    free = sorted((int(sizes[i]), -k, i) for k, i in enumerate(large))
    gaps: list[tuple[int, int]] = []
    n = 0
    for k, i in enumerate(large):
        if bins[i] >= 0:
            continue
        bins[i] = n
        del free[bisect.bisect_left(free, (int(sizes[i]), -k, i))]
        room = capacity - int(sizes[i])
        at = bisect.bisect_right(free, (room, 1, 0)) - 1
        if at >= 0:
            size, _, j = free.pop(at)
            bins[j] = n
            room -= size
        gaps.append((room, n))
        n += 1
    gaps.sort()
    for i in small:
        size = int(sizes[i])
        at = bisect.bisect_left(gaps, (size, -1))
        if at == len(gaps):
            room, b = capacity, n
            n += 1
        else:
            room, b = gaps.pop(at)
        bins[i] = b
        bisect.insort(gaps, (room - size, b))
    bins[sizes == 0] = 0
    return bins


def _pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "doc_id", "part_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    pdf["container_no"] = pack(pdf["n_tokens"].to_numpy(), int(pdf["capacity_tokens"].iloc[0])) if len(pdf) else []
    return pdf[["profile", "shard", "container_no", "doc_id", "part_no", "first_token", "n_tokens", "capacity_tokens"]]


def assign(documents: DataFrame, limits: DataFrame, folder: str = TOKENIZERS, file: str = VOCABULARY) -> DataFrame:
    """Each document, or part of one above the capacity, with its container (shard, container_no) of each profile."""
    keep = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = materialize(token_counts(keep, ["doc_id"], folder, file))
    total = counts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()["t"]
    profiles = limits.where("capacity_tokens > 0").select("profile", F.col("capacity_tokens").cast("int").alias("capacity_tokens")).distinct()
    # a profile a row: configuration, so small enough to broadcast
    items = counts.join(F.broadcast(profiles))
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).cast("int") - 1))
    items = items.select("profile", "capacity_tokens", "doc_id", F.col("n_tokens").alias("total"), F.explode(parts).alias("part_no"))
    first = F.col("part_no").cast("long") * F.col("capacity_tokens")
    items = items.select(
        "profile", "capacity_tokens", "doc_id", "part_no", first.alias("first_token"), F.least(F.col("capacity_tokens").cast("long"), F.col("total") - first).alias("n_tokens")
    )
    shards = F.greatest(F.lit(1), F.floor(F.lit(float(total)) / (F.col("capacity_tokens") * F.lit(float(CONTAINERS))))).cast("int")
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part_no", "n_tokens"), shards).cast("int"))
    return items.groupBy("profile", "shard").applyInPandas(_pack_shard, ITEMS)


def fill_report(assigned: DataFrame) -> DataFrame:
    """For each profile: containers, items, divided items, and the share of space used."""
    return assigned.groupBy("profile", "capacity_tokens").agg(
        F.count_distinct("shard", "container_no").alias("n_containers"),
        F.count("*").alias("n_items"),
        F.count_if(F.col("part_no") > 0).alias("n_further_parts"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_tokens") / (F.count_distinct("shard", "container_no") * F.max("capacity_tokens"))).alias("fill"),
    )
