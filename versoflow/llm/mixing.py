"""Problem 7: a selection of documents with repeat counts whose token totals by source meet target weights.

Method: each source's documents, in pseudorandom order, make one stream of tokens that is packed into blocks of a fixed
length; a document belongs to the block it begins in. Every output shard draws its count of slots of each source from a
multinomial that is conditioned on the sources' totals. The slots of a source are mapped through pseudorandom
permutations of its block indexes, a fresh one for each pass over the source, and joined with the blocks by index: a
document is chosen once for every slot of its block, in that slot's shard. The last tokens of each quota are filled
document by document from the blocks that come next, in the last shard.

The total is the largest at which every source with documents can meet its share without being repeated more than
``max_repeats`` times, unless a total is asked for; then sources fall short where their cap is reached.

Defined results: source names are compared trimmed and in lower case; null sources and those without a target
contribute nothing; null and empty texts count 0 tokens and are never chosen. Targets without documents get share
0 and don't hold back the rest. Repeated targets are summed, with their smallest cap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versoflow.llm.tokens import TOKENIZERS, VOCABULARY, token_counts
from versoflow.session import materialize

#: Tokens of a block at least, blocks of a source at most (blocks grow with the corpus, their number doesn't).
BLOCK_TOKENS, MAX_BLOCKS = 2048, 500_000
#: Tokens of a bucket, the unit in which a source is laid out in order, about.
BUCKET_TOKENS = 1_000_000
#: Blocks behind the end of a quota among whose documents its last tokens are sought, at most, and their tokens, about.
FILL, FILL_TOKENS = 32, 1_000_000
#: Buckets whose offsets are summed by one task.
GROUP = 4096
SEED = 20240229


def clean_source(column: str):
    return F.lower(F.trim(F.col(column)))


def quotas(totals: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens wanted of each source. ``totals``: tokens that each source has."""
    live = [(s, share, cap) for s, share, cap in targets if share > 0 and cap > 0 and totals.get(s, 0) > 0]
    whole = sum(share for _, share, _ in live)
    if not live:
        return {}
    most = min(totals[s] * cap * whole / share for s, share, cap in live)
    size = most if total is None else total
    wanted = {s: size * share / whole for s, share, _ in live}
    return {s: int(min(wanted[s], totals[s] * cap)) for s, _, cap in live}


def slot_counts(slots: dict[str, int], shards: int, seed: int = SEED) -> list[tuple[int, str, int, int]]:
    """(shard, source, first slot of the source, count): multinomial draws of each shard, given the sources' totals."""
    names = sorted(slots)
    rest = np.array([slots[s] for s in names], dtype=np.int64)
    first = np.zeros(len(names), dtype=np.int64)
    rng = np.random.default_rng(seed)
    out = []
    for shard in range(shards):
        left = shards - shard
        size = int(round(rest.sum() / left))
        drawn = rest.copy() if left == 1 else rng.multivariate_hypergeometric(rest, size, method="marginals")
        for k, name in enumerate(names):
            if drawn[k]:
                out.append((shard, name, int(first[k]), int(drawn[k])))
        first += drawn
        rest -= drawn
    return out


def _offsets(docs: DataFrame) -> DataFrame:
    """source, bucket and the tokens of the source's buckets before it, by sums of groups of buckets."""
    size = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("size")).withColumn("group", F.floor(F.col("bucket") / GROUP))
    before = lambda *keys: Window.partitionBy("source", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = size.groupBy("source", "group").agg(F.sum("size").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(before("group")), F.lit(0)))
    inside = size.withColumn("inner", F.coalesce(F.sum("size").over(before("group", "bucket")), F.lit(0)))
    return inside.join(groups.select("source", "group", "base"), ["source", "group"]).select("source", "bucket", (F.col("base") + F.col("inner")).alias("offset"))


def mix(
    documents: DataFrame, targets: DataFrame, total: int | None = None, shards: int = 64, folder: str = TOKENIZERS, file: str = VOCABULARY
) -> DataFrame:
    """doc_id, source, n_tokens, ``repeats`` (at least 1) and the shard of each repeat of every chosen document."""
    spark = documents.sparkSession
    keep = documents.select(F.col("doc_id").cast("long").alias("doc_id"), clean_source("source").alias("source"), "text").where("source is not null")
    wanted = targets.select(clean_source("source").alias("source"), "target_share", "max_repeats").groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")
    )
    counts = materialize(token_counts(keep, ["doc_id", "source"], folder, file)).where("n_tokens > 0")
    listed = wanted.where("source is not null and target_share is not null and max_repeats is not null")
    # targets are configuration, a row a source; totals are asked for listed sources only
    plan = [(r.source, r.target_share, r.max_repeats) for r in listed.collect()]
    totals = {r.source: r.t for r in counts.join(F.broadcast(listed.select("source")), "source").groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    quota = quotas(totals, plan, total)
    if not quota:
        return counts.where("false").select("doc_id", "source", "n_tokens", F.lit(0).alias("repeats"), F.array(F.lit(0)).alias("shards"))
    block = {s: max(BLOCK_TOKENS, -(-totals[s] // MAX_BLOCKS)) for s in quota}
    sources = spark.createDataFrame(
        [(s, quota[s], block[s], max(1, totals[s] // BUCKET_TOKENS), cap) for s, _, cap in plan if s in quota],
        "source string, quota bigint, block bigint, buckets bigint, cap int",
    )
    docs = counts.join(F.broadcast(sources), "source").withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.col("buckets")))
    # documents in pseudorandom order, a bucket at a time; the buckets of a source follow one another
    inside = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", F.lit(SEED + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    docs = docs.withColumn("inner", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(_offsets(docs), ["source", "bucket"])
    begins = F.col("offset") + F.col("inner")
    docs = materialize(docs.select("source", begins.alias("begins"), F.floor(begins / F.col("block")).cast("long").alias("block_no"), "doc_id", "n_tokens"))
    # one row a block in which a document begins: at most MAX_BLOCKS a source, so windows over a source's blocks are bounded
    blocks = materialize(docs.groupBy("source", "block_no").agg(F.sum("n_tokens").alias("tokens")))
    have = {r.source: (r.n, r.t) for r in blocks.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}
    passes = {s: quota[s] // have[s][1] for s in quota}
    rest = {s: quota[s] - passes[s] * have[s][1] for s in quota}
    told = spark.createDataFrame([(s, int(passes[s]), int(rest[s]), have[s][0]) for s in quota], "source string, passes bigint, rest bigint, n bigint")
    # a slot for every block and pass, in the order of that pass's permutation; of the last pass as many as its quota holds
    slots = blocks.join(F.broadcast(told), "source").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    order = Window.partitionBy("source", "pass").orderBy(F.xxhash64("block_no", "pass", F.lit(SEED)), "block_no")
    reached = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    slots = slots.withColumn("at", F.row_number().over(order) - 1).withColumn("reached", reached)
    slots = slots.withColumn("slot", F.col("pass") * F.col("n") + F.col("at")).withColumn("full", (F.col("pass") < F.col("passes")) | (F.col("reached") <= F.col("rest")))
    slots = materialize(slots.select("source", "block_no", "slot", "full", "pass", "passes", "reached"))
    ended = {r.source: (r.n, r.t or 0) for r in slots.where("full").groupBy("source").agg(F.count("*").alias("n"), F.max(F.when(F.col("pass") == F.col("passes"), F.col("reached"))).alias("t")).collect()}
    ends = [(s, ended.get(s, (0, 0))[0], rest[s] - ended.get(s, (0, 0))[1], max(1, min(FILL, FILL_TOKENS // block[s]))) for s in quota]
    draws = slot_counts({s: n for s, n, _, _ in ends}, shards)
    first: dict[str, list[int]] = {s: [] for s in quota}
    for shard in range(shards):
        for s in quota:
            mine = [a for sh, x, a, _ in draws if sh == shard and x == s]
            first[s].append(mine[0] if mine else -1)
    for s in quota:  # where a shard has no slot of a source, the next one's first slot stands for it
        nxt = ended.get(s, (0, 0))[0]
        for shard in range(shards - 1, -1, -1):
            nxt = first[s][shard] = first[s][shard] if first[s][shard] >= 0 else nxt
    starts = F.broadcast(spark.createDataFrame(list(first.items()), "source string, starts array<bigint>"))
    taken = slots.where("full").join(starts, "source").withColumn("shard", F.size(F.filter("starts", lambda x: x <= F.col("slot"))) - 1)
    chosen = docs.join(taken.select("source", "block_no", "shard"), ["source", "block_no"]).select("doc_id", "source", "n_tokens", "shard")
    # the last tokens of a quota are filled document by document from the next blocks: a bounded number of tokens
    near = slots.join(F.broadcast(spark.createDataFrame(ends, "source string, ended bigint, room bigint, fill bigint")), "source")
    near = near.where((F.col("slot") >= F.col("ended")) & (F.col("slot") < F.col("ended") + F.col("fill")) & (F.col("room") > 0)).select("source", "block_no", "slot", "room")
    filled = docs.join(near, ["source", "block_no"]).groupBy("source").applyInPandas(_fill, "doc_id bigint, source string, n_tokens bigint, shard int")
    filled = filled.withColumn("shard", F.lit(shards - 1))
    chosen = chosen.unionByName(filled).groupBy("doc_id", "source", "n_tokens")
    return chosen.agg(F.count("*").cast("int").alias("repeats"), F.array_sort(F.collect_list("shard")).alias("shards"))


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """Documents, the largest first, that fit what is left of their source's quota."""
    pdf = pdf.sort_values(["n_tokens", "slot", "begins", "doc_id"], ascending=[False, True, True, True])
    room, kept = int(pdf["room"].iloc[0]), []
    for i, n in zip(pdf.index, pdf["n_tokens"]):
        if n <= room:
            room -= n
            kept.append(i)
    return pdf.loc[kept, ["doc_id", "source", "n_tokens"]].assign(shard=0)


def share_report(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of each source, tokens, documents and the most repeats."""
    wanted = targets.where("source is not null").groupBy(clean_source("source").alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")
    )
    got = selection.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats")
    )
    # one row a source: a window over all of them is small
    everything = Window.partitionBy(F.lit(1))
    out = wanted.join(got, "source", "left").fillna(0, ["tokens", "n_docs", "most_repeats"])
    return out.withColumn("share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(everything), F.lit(0)), F.lit(0.0)))
