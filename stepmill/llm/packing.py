"""Problem 6: items of varying length into containers of fixed capacity.

Texts are measured once in tokens of a public tokenizer.  Items are spread
over partitions by hash and packed there by best-fit decreasing; lower bounds
from dual feasible functions certify the container count of a partition.
Where a count is not certified, the items of its emptier containers are
exchanged: they meet in fewer partitions and are packed again, until a single
pool is left or nothing is gained.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepmill.session import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Split of a text before byte pairs are merged: the pattern published with the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_tokenizer(path: str = TOKENIZER):
    """The encoder of a ``.tiktoken`` rank file."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every document (doc_id, text); null texts have 0 tokens.

    The rank file need lie on the driver alone; Spark hands it to the executors.
    """
    documents.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = load_tokenizer(SparkFiles.get(name))
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) if t is not None else 0 for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_tokens": pd.Series(sizes, dtype="int32")})

    return spread(documents.select("doc_id", "text")).mapInPandas(run, "doc_id bigint, n_tokens int")


def pieces(sizes: DataFrame, windows: DataFrame, most: int = 1000) -> DataFrame:
    """(window_name, capacity, doc_id, piece, start_token, size): a text longer than the capacity is cut into full pieces and a rest.

    The windows are a handful of rows (at most ``most``); texts of 0 tokens need no room and give no piece.
    """
    caps = windows.select("window_name", F.col("capacity_tokens").alias("capacity")).where("capacity > 0").distinct().limit(most + 1).collect()
    if len(caps) > most:
        raise ValueError(f"more than {most} windows")
    each = F.array(*[F.struct(F.lit(c.window_name).alias("window_name"), F.lit(c.capacity).alias("capacity")) for c in sorted(caps)])
    if not caps:
        each = F.array().cast("array<struct<window_name:string,capacity:int>>")
    wide = sizes.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(each).alias("w")).select("doc_id", "n_tokens", "w.*")
    cutting = wide.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr("cast((n_tokens - 1) div capacity as int)"))))
    start = F.col("piece") * F.col("capacity")
    return cutting.select("window_name", "capacity", "doc_id", "piece", start.alias("start_token"), F.least(F.col("capacity"), F.col("n_tokens") - start).alias("size"))


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Best-fit decreasing: the bin of every size, and the room left in every bin."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins = [0] * len(sizes)
    room: list[int] = []
    gaps: list[int] = []
    at_gap: dict[int, list[int]] = {}
    for i in order:
        need = sizes[i]
        k = bisect_left(gaps, need)
        if k == len(gaps):
            b = len(room)
            room.append(capacity - need)
        else:
            gap = gaps[k]
            held = at_gap[gap]
            b = held.pop()
            if not held:
                del at_gap[gap]
                gaps.pop(k)
            room[b] = gap - need
        bins[i] = b
        left = room[b]
        if left:
            if left not in at_gap:
                at_gap[left] = []
                insort(gaps, left)
            at_gap[left].append(b)
    return bins, room


def lower_bound(sizes: list[int], capacity: int) -> int:
    """The greatest of several dual-feasible bounds on the number of bins; see ``counted_bound``."""
    return counted_bound(Counter(sizes), capacity)


def counted_bound(counts: dict[int, int], capacity: int, most_k: int = 100) -> int:
    """The greatest of several dual-feasible bounds on the number of bins, from the number of items of every size.

    The family u_k, tried up to k = ``most_k``, rounds a size x to
    floor((k+1)x/C)/k unless (k+1)x/C is whole; the family f_e counts sizes over C-e as a whole bin and drops those
    under e, and is tried for every e that matters.  Either never sums to more
    than 1 over what fits one bin.
    """
    if not counts:
        return 0
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    size, many = np.array(list(counts)), np.array(list(counts.values()))
    for k in range(1, most_k + 1):
        # in whole numbers, scaled by k * C: a size whose (k + 1) x / C is whole counts x, others floor((k + 1) x / C) / k
        q, r = np.divmod((k + 1) * size, capacity)
        total = int((many * np.where(r == 0, size * k, q * capacity)).sum())
        best = max(best, -(-total // (k * capacity)))
    order = sorted(counts)
    items = [0, *accumulate(counts[s] for s in order)]
    tokens = [0, *accumulate(s * counts[s] for s in order)]
    # between two sizes the greater e is the better one, so the sizes themselves are enough, and half the capacity
    for e in [*order[: bisect_right(order, capacity // 2)], capacity // 2]:
        low, high = bisect_left(order, e), bisect_right(order, capacity - e)
        total = capacity * (items[-1] - items[high]) + tokens[high] - tokens[low]
        best = max(best, -(-total // capacity))
    return best


_PACKED = "window_name string, capacity int, doc_id bigint, piece int, start_token int, size int, part bigint, bin int, room int, bins int, bound int"


def _pack(batch: pd.DataFrame) -> pd.DataFrame:
    # ties in size are taken in order of the ids, so the result does not hang on how rows arrive
    batch = batch.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    capacity = int(batch["capacity"].iloc[0])
    sizes = batch["size"].tolist()
    bins, room = best_fit(sizes, capacity)
    return batch.assign(bin=bins, room=[room[b] for b in bins], bins=len(room), bound=lower_bound(sizes, capacity))


def pack(items: DataFrame, per_partition: int = 20_000, slack: float = 0.005) -> DataFrame:
    """``items`` (as from ``pieces``) with container, the room left in it, and whether its pool was certified.

    A partition holds about ``per_partition`` items of one window, whatever
    the number of documents.  Full pieces are containers of their own and are
    never moved.  In each round the containers of uncertified partitions with
    more than ``slack`` of the capacity free, and any that are not half full,
    hand their items on; the pool, much smaller, is packed again in as many
    partitions as it needs.  A window is done when its pool has been packed in
    one partition, or when a round saves no container any more.  Equal sizes
    are taken in order of the ids; no items give no containers.
    """
    full = items.where("size = capacity").select(
        "window_name", "doc_id", "piece", "start_token", "size",
        F.concat_ws(":", F.lit("f"), "doc_id", "piece").alias("container"), F.lit(0).alias("room"), F.lit(True).alias("certified"),
    )
    pool = cut(items.where("size < capacity"))
    done = full
    counts = {r.window_name: r.n for r in pool.groupBy("window_name").agg(F.count("*").alias("n")).collect()}
    held: dict[str, int] = {}
    last, k = None, 0
    while counts:
        parts = F.lit(1)
        for w, n in counts.items():
            parts = F.when(F.col("window_name") == w, F.lit(-(-n // per_partition))).otherwise(parts)
        mixed = pool.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(k)), parts.cast("bigint")))
        packed = cut(mixed.groupBy("window_name", "part").applyInPandas(_pack, _PACKED))
        sure = F.col("bins") == F.col("bound")
        stays = (sure & (F.col("room") * 2 <= F.col("capacity"))) | (F.col("room") <= F.col("capacity") * slack)
        # one row for each window: containers of this round, and items and containers that would go on
        bins = packed.groupBy("window_name", "part", "bin").agg(F.count("*").alias("n"), F.first(stays).alias("stays"))
        now = bins.groupBy("window_name").agg(F.count("*").alias("bins"), F.count_if(~F.col("stays")).alias("open"), F.sum(F.when(~F.col("stays"), F.col("n")).otherwise(0)).alias("n")).collect()
        same = [r.window_name for r in now if r.bins >= held.get(r.window_name, r.bins + 1)]
        ends = [r.window_name for r in now if counts[r.window_name] <= per_partition and r.window_name not in same]
        name = F.concat_ws(":", F.lit(f"r{k}"), "part", "bin").alias("container")
        named = packed.select("window_name", "capacity", "doc_id", "piece", "start_token", "size", name, "room", sure.alias("certified"), stays.alias("stays"))
        if same:
            # nothing was saved: these windows keep the containers of the round before
            done = done.unionAll(last.where(F.col("window_name").isin(same)).select(*done.columns))
            named = named.where(~F.col("window_name").isin(same))
        closed = F.col("stays") | F.col("window_name").isin(ends)
        done = done.unionAll(named.where(closed).select(*done.columns))
        last = named.where(~closed)
        pool = last.select(*items.columns)
        counts = {r.window_name: r.n for r in now if r.n and r.window_name not in (*ends, *same)}
        held = {r.window_name: r.open for r in now}
        k += 1
    return done


def faults(packed: DataFrame, sizes: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_name, documents, overfull, torn, cut_short, wrong_room): documents placed, and containers or documents at fault.

    ``torn``: documents whose pieces leave out or repeat tokens; ``cut_short``:
    documents cut although they fit, or into other than full pieces and a rest;
    ``wrong_room``: containers whose stated room is not what is left.
    """
    caps = windows.select("window_name", F.col("capacity_tokens").alias("capacity")).where("capacity > 0").distinct()
    each = packed.join(F.broadcast(caps), "window_name")
    boxes = each.groupBy("window_name", "container").agg(F.sum("size").alias("used"), F.first("capacity").alias("capacity"), F.min("room").alias("room"), F.max("room").alias("most"))
    of_boxes = boxes.groupBy("window_name").agg(F.count_if(F.col("used") > F.col("capacity")).alias("overfull"), F.count_if((F.col("used") + F.col("room") != F.col("capacity")) | (F.col("room") != F.col("most"))).alias("wrong_room"))
    spot = F.array_sort(F.collect_list(F.struct("start_token", "size")))
    docs = each.groupBy("window_name", "doc_id").agg(spot.alias("s"), F.first("capacity").alias("capacity")).join(sizes, "doc_id", "left")
    upto = F.aggregate("s", F.lit(0), lambda at, x: F.when(x.start_token == at, at + x.size).otherwise(-1))
    whole = F.ceil(F.col("n_tokens") / F.col("capacity"))
    of_docs = docs.groupBy("window_name").agg(F.count("*").alias("documents"), F.count_if(upto != F.col("n_tokens")).alias("torn"), F.count_if(F.size("s") != whole).alias("cut_short"))
    return of_docs.join(of_boxes, "window_name").select("window_name", "documents", "overfull", "torn", "cut_short", "wrong_room")


def _bound_of(counts: pd.DataFrame) -> pd.DataFrame:
    bound = counted_bound(dict(zip(counts["size"].tolist(), counts["n"].tolist(), strict=True)), int(counts["capacity"].iloc[0]))
    return counts[["window_name", "capacity"]].head(1).assign(bound=bound)


def packing_report(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_name, capacity, items, tokens, containers, certified, bound, spare_pct): containers against the least possible by ``counted_bound``.

    ``certified`` counts the containers of partitions whose own bound was met.

    The bound is that of all items of the window together; it needs only the
    number of items of each size, of which there are no more than the capacity.
    """
    per = packed.groupBy("window_name", "container").agg(F.count("*").alias("items"), F.sum("size").alias("tokens"), F.min("certified").alias("sure"))
    whole = per.groupBy("window_name").agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.count("*").alias("containers"), F.count_if("sure").alias("certified"))
    caps = windows.select("window_name", F.col("capacity_tokens").alias("capacity"))
    out = whole.join(F.broadcast(caps), "window_name")
    sizes = packed.groupBy("window_name", "size").agg(F.count("*").alias("n")).join(F.broadcast(caps.where("capacity > 0").distinct()), "window_name")
    bounds = sizes.groupBy("window_name", "capacity").applyInPandas(_bound_of, "window_name string, capacity int, bound bigint")
    out = out.join(bounds, ["window_name", "capacity"])
    return out.select("window_name", "capacity", "items", "tokens", "containers", "certified", "bound", F.round(100 * (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))), 4).alias("spare_pct"))
