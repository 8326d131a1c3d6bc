"""Filling fixed-capacity containers with items (problem 8).

Texts are measured in tokens and put whole into containers of each capacity; only a text above the capacity is split,
into full pieces and a rest. Items are spread over shards of bounded size by a hash; within a shard, multiway
Karmarkar-Karp differencing joins partial partitions whose imbalances oppose each other until one is left, which gives
near-equal windows. Where a window exceeds the capacity, the number of windows rises.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.llm.tokens import token_counts
from docveil.operators.lineage import checkpointed
from docveil.sources.tables import table

#: Windows and items of one shard, on average; a shard is one task's work whatever the size of the corpus and of its texts.
WINDOWS, ITEMS = 224, 8192


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """``k`` windows of item numbers with near-equal sums.

    A partial partition is a list of at most ``k`` (sum, items) in falling order, empty windows left out; its spread is
    the largest less the smallest sum. The two of the largest spread are joined, largest to smallest.
    """
    if k <= 1:
        return [list(range(len(sizes)))]
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # Windows of a beyond its own length are empty: b's largest go there first, the rest onto a's smallest.
        free = k - len(a)
        joined = a + b[:free]
        over = b[free:]
        if over:
            m = len(joined)
            for j, (s, items) in enumerate(over):
                at = m - 1 - j if free == 0 else len(a) - 1 - j
                t, other = joined[at]
                joined[at] = (t + s, (other, items))
        joined.sort(key=lambda w: -w[0])
        spread = joined[0][0] - (joined[-1][0] if len(joined) == k else 0)
        heapq.heappush(heap, (-spread, serial, joined))
        serial += 1
    return [_flat(items) for _, items in heap[0][2]] if heap else []


def _flat(items) -> list[int]:
    out, todo = [], [items]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo.extend(x)
        else:
            out.append(x)
    return out


def settle(sizes: list[int], windows: list[list[int]], capacity: int) -> list[int]:
    """Takes from each overfull window what makes it so, and puts it where it leaves the least room. Returns the items
    for which there is none."""
    sums = [sum(sizes[i] for i in w) for w in windows]
    loose: list[int] = []
    for n, w in enumerate(windows):
        while sums[n] > capacity:
            excess = sums[n] - capacity
            enough = [i for i in w if sizes[i] >= excess]
            i = min(enough, key=lambda i: (sizes[i], i)) if enough else max(w, key=lambda i: (sizes[i], -i))
            w.remove(i)
            sums[n] -= sizes[i]
            loose.append(i)
    room = sorted((capacity - s, n) for n, s in enumerate(sums))
    left = []
    for i in sorted(loose, key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            left.append(i)
            continue
        free, n = room.pop(at)
        windows[n].append(i)
        insort(room, (free - sizes[i], n))
    return left


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``. The least number of windows is tried first; where differencing exceeds the
    capacity and the excess finds no room elsewhere, the number rises by what is left over."""
    if not sizes:
        return []
    k = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        windows = difference(sizes, k)
        left = settle(sizes, windows, capacity)
        if not left:
            return [w for w in windows if w]
        k = min(len(sizes), k + max(1, sum(sizes[i] for i in left) // capacity))


def _pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    sizes = pdf["tokens"].tolist()
    window = [0] * len(sizes)
    for n, items in enumerate(pack(sizes, int(pdf["capacity_tokens"].iloc[0]))):
        for i in items:
            window[i] = n
    pdf = pdf.assign(window=window)
    return pdf[["container", "capacity_tokens", "shard", "window", "doc_id", "piece", "first_token", "tokens"]]


OUT = "container string, capacity_tokens int, shard long, window long, doc_id long, piece int, first_token long, tokens long"


def packed(docs: DataFrame, capacities: DataFrame, windows: int = WINDOWS, items: int = ITEMS) -> DataFrame:
    """Each item of ``doc_id, text`` in a container of each capacity.

    Columns out: ``container, capacity_tokens, shard, window, doc_id, piece, first_token, tokens``: the piece of the
    text that begins at token ``first_token``; a text of at most the capacity is one piece. ``shard, window`` tell the
    windows of a container apart. Full pieces are windows of their own: the shard is negative, one for each piece, and
    the window is the row's own number. Texts of no token need no room and are left out, capacities below 1 or null as well. Rows are
    kept as they come: a doc_id given twice is packed twice.
    """
    # The number of a row is fixed by the checkpoint; rows of one doc_id are told apart by it.
    sized = checkpointed(token_counts(docs, "doc_id").where("tokens > 0").withColumn("row", F.monotonically_increasing_id()))
    # A few rows, one per container.
    caps = capacities.where("capacity_tokens > 0 and container is not null").select("container", F.col("capacity_tokens").cast("int")).distinct().collect()
    listed = F.array(*(F.struct(F.lit(c).alias("container"), F.lit(n).alias("capacity_tokens")) for c, n in sorted(map(tuple, caps)))) if caps else F.expr("cast(array() as array<struct<container:string,capacity_tokens:int>>)")
    pieces = sized.select("doc_id", "row", "tokens", F.explode(listed).alias("cap")).select("doc_id", "row", "tokens", "cap.*").select(
        "container", "capacity_tokens", "doc_id", "row", F.posexplode(F.expr("sequence(0L, greatest(ceil(tokens / capacity_tokens) - 1, 0L))")).alias("piece", "p"), "tokens"
    ).select("container", "capacity_tokens", "doc_id", "row", "piece", (F.col("p") * F.col("capacity_tokens")).alias("first_token"), F.least(F.col("capacity_tokens").cast("long"), F.col("tokens") - F.col("p") * F.col("capacity_tokens")).alias("tokens"))
    full = pieces.where("tokens = capacity_tokens").select("container", "capacity_tokens", (-1 - F.col("piece")).cast("long").alias("shard"), F.col("row").alias("window"), "doc_id", "piece", "first_token", "tokens")
    part = pieces.where("tokens < capacity_tokens")
    # One row per capacity tells how many shards its items need.
    shards = part.groupBy("container", "capacity_tokens").agg(F.greatest(F.lit(1), F.ceil(F.sum("tokens") / (F.max("capacity_tokens") * F.lit(windows).cast("long"))), F.ceil(F.count("*") / F.lit(items))).alias("shards"))
    sharded = part.join(F.broadcast(shards), ["container", "capacity_tokens"]).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "row"), "shards").cast("long")).drop("shards", "row")
    return full.unionByName(sharded.groupBy("container", "capacity_tokens", "shard").applyInPandas(_pack_group, OUT))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacities"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and the share of their room that is used, by container."""
    w = p8_packed(spark, sf_dir).groupBy("container", "capacity_tokens", "shard", "window").agg(F.sum("tokens").alias("used"))
    return w.groupBy("container", "capacity_tokens").agg(
        F.count("*").alias("windows"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count("*") * F.max("capacity_tokens")), 6).alias("fill")
    )


def queries():
    return {"p8_packed": p8_packed, "p8_fill": p8_fill}


def oracle_sql():
    return {}
