"""One ranking from several differently-scaled scores, by a Markov chain over ranks.

From an item the walk picks one of the query's lists and jumps, with equal chance, to one of the items that the list
scores at least as high; an item that the list lacks counts as below all of it. With damping it jumps to any item of
the query. Items are ordered by how often the walk, started anywhere, is there after ROUNDS steps. Only the order in
each list matters, so no scale does. A step needs one running sum along each sorted list.

Queries are walked many at a time with numpy; a query of more than max_group rows is walked by DataFrame operations,
with running sums over range buckets, so that no task holds it whole. The chance of being somewhere is a whole number of
ONE-th parts, and every division is one of whole numbers, so that sums don't depend on their order: both ways give the
same result, to the last part, and items in the same places are tied exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import BROADCAST_BYTES, checkpoint, written

ROUNDS, DAMPING = 30, 0.85
#: A query's whole chance; small enough for a thousand times a part of a thousand of it.
ONE = 1 << 56


def lists_of(search_result: DataFrame, display_result: DataFrame) -> DataFrame:
    """(query_id, list, chunk_id, score double): one list per query and scorer or engine, a chunk once with its highest
    score. Null and NaN scores and rows without query or chunk don't exist; a null scorer or engine is a name of its own."""

    def part(df: DataFrame, kind: str, name: str) -> DataFrame:
        return df.select("query_id", F.concat(F.lit(kind), F.coalesce(F.concat(F.lit(":"), F.col(name)), F.lit(""))).alias("list"), "chunk_id", F.col("score").cast("double").alias("score"))

    both = part(search_result, "search", "scorer").unionByName(part(display_result, "display", "engine"))
    real = F.col("score").isNotNull() & ~F.isnan("score") & F.col("query_id").isNotNull() & F.col("chunk_id").isNotNull()
    return both.where(real).groupBy("query_id", "list", "chunk_id").agg(F.max("score").alias("score"))


def _walk(pdf: pd.DataFrame, rounds: int, damping: float) -> pd.DataFrame:
    """All queries of the frame at once."""
    pdf = pdf.sort_values(["query_id", "list", "score"], kind="stable")
    item, items = pd.factorize(pd.MultiIndex.from_arrays([pdf.query_id, pdf.chunk_id]))
    query, queries = pd.factorize(items.get_level_values(0))  # of each item
    listed = pd.factorize(pd.MultiIndex.from_arrays([pdf.query_id, pdf.list]))[0]  # of each row
    score = pdf.score.to_numpy()
    n_rows, n_items = len(pdf), len(items)
    first = np.flatnonzero(np.append(True, listed[1:] != listed[:-1]))
    size = np.diff(np.append(first, n_rows))
    list_query = query[item[first]]
    n_lists = np.bincount(list_query, minlength=len(queries))
    of_query = np.bincount(query, minlength=len(queries))
    tie = np.append(True, (listed[1:] != listed[:-1]) | (score[1:] != score[:-1]))
    tie_first = np.flatnonzero(tie)
    tie_of = np.cumsum(tie) - 1
    tie_last = np.append(tie_first[1:], n_rows)  # exclusive
    end = (first + size)[listed]
    at_least = end - tie_first[tie_of]  # rows of the list with this score or a higher one
    higher = end - tie_last[tie_of]
    mass = ONE // of_query[query]
    part = round(damping * 1000)
    for _ in range(rounds):
        run = np.concatenate([[0], np.cumsum(mass[item] // (n_lists[list_query[listed]] * at_least))])
        there = np.add.reduceat(mass[item], first)
        away = np.maximum(0, ONE - there) // (n_lists[list_query] * size)
        got = np.zeros(n_items, np.int64)
        np.add.at(got, item, run[tie_last[tie_of]] - run[first[listed]] + away[listed])
        mass = ONE // 1000 * (1000 - part) // of_query[query] + got // 1000 * part + got % 1000 * part // 1000
    order = np.lexsort((-mass, query))
    qs, ms = query[order], mass[order]
    start = np.flatnonzero(np.append(True, qs[1:] != qs[:-1]))
    new = np.append(True, (qs[1:] != qs[:-1]) | (ms[1:] != ms[:-1]))
    place = np.maximum.accumulate(np.where(new, np.arange(n_items), 0)) - np.repeat(start, np.diff(np.append(start, n_items)))
    position = np.empty(n_items, np.int64)
    position[order] = place + 1
    worst = np.zeros(n_items, np.int64)
    np.maximum.at(worst, item, higher)
    return pd.DataFrame(
        {
            "query_id": items.get_level_values(0),
            "chunk_id": items.get_level_values(1),
            "stationarity": mass / ONE,
            "position": position,
            "n_lists": np.bincount(item, minlength=n_items),
            "query_lists": n_lists[query],
            "worst_higher": worst,
        }
    )


_OUT = "stationarity double, position long, n_lists long, query_lists long, worst_higher long"


def _running(df: DataFrame, keys: list[str], by: str, value: str, bucket_rows: int) -> DataFrame:
    """df, whose (keys, by) are distinct, with upto: the sum of value over the rows of the same keys with this by or a
    lower one. Rows are put into range buckets; only sums of buckets and the rows of one bucket meet in a window."""
    cuts = df.groupBy(keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx(by, F.array(*[F.lit(i / 64) for i in range(1, 64)]), 10000).alias("__cuts"))
    df = df.join(cuts, keys).withColumn("__b", F.when(F.col("__n") <= bucket_rows, 0).otherwise(F.size(F.filter("__cuts", lambda c: c < F.col(by)))))
    sums = df.groupBy(*keys, "__b").agg(F.sum(value).alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__b").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("upto", F.sum(value).over(within)).join(sums, [*keys, "__b"]).withColumn("upto", F.col("upto") + F.col("__before")).drop("__b", "__n", "__cuts", "__before")


def _walk_large(lists: DataFrame, rounds: int, damping: float, bucket_rows: int) -> DataFrame:
    """The walk of the few queries that are too large for one task."""
    rows = written(lists)
    by_list = ["query_id", "list"]
    sizes = rows.groupBy(by_list).agg(F.count(F.lit(1)).alias("size"))
    per_query = sizes.groupBy("query_id").agg(F.count(F.lit(1)).alias("query_lists"))
    levels = _running(rows.groupBy(*by_list, "score").agg(F.count(F.lit(1)).alias("n")), by_list, "score", "n", bucket_rows).join(sizes, by_list)
    levels = levels.join(per_query, "query_id").select(*by_list, "score", "size", "query_lists", (F.col("size") - F.col("upto") + F.col("n")).alias("at_least"), (F.col("size") - F.col("upto")).alias("higher"))
    levels = written(levels)
    items = written(rows.join(levels, [*by_list, "score"]).groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("n_lists"), F.max("higher").alias("worst_higher"), F.max("query_lists").alias("query_lists")))
    total = items.groupBy("query_id").agg(F.count(F.lit(1)).alias("items"))
    part = round(damping * 1000)
    mass = items.join(total, "query_id").select("query_id", "chunk_id", F.expr(f"{ONE} div items").alias("mass"))
    for _ in range(rounds):
        here = rows.join(mass, ["query_id", "chunk_id"]).withColumn("m", F.col("mass")).join(levels, [*by_list, "score"])
        # each row's own division, as in memory, before anything is added up
        share = here.groupBy(*by_list, "score").agg(F.sum(F.expr("m div (query_lists * at_least)")).alias("share"), F.sum("m").alias("m"), F.first("size").alias("size"), F.first("query_lists").alias("query_lists"))
        present = share.groupBy(by_list).agg(F.greatest(F.lit(0), F.lit(ONE) - F.sum("m")).alias("absent"), F.first("size").alias("size"), F.first("query_lists").alias("query_lists"))
        present = present.select(*by_list, F.expr("absent div (query_lists * size)").alias("away"))
        level = _running(share.select(*by_list, "score", "share"), by_list, "score", "share", bucket_rows).join(present, by_list)
        got = rows.join(level, [*by_list, "score"]).groupBy("query_id", "chunk_id").agg(F.sum(F.col("upto") + F.col("away")).alias("got"))
        stays = F.expr(f"{ONE // 1000 * (1000 - part)} div items + got div 1000 * {part} + got % 1000 * {part} div 1000")
        mass = checkpoint(got.join(total, "query_id").select("query_id", "chunk_id", stays.alias("mass")))
    ranks = _running(mass.groupBy("query_id", (-F.col("mass")).alias("down")).agg(F.count(F.lit(1)).alias("n")), ["query_id"], "down", "n", bucket_rows)
    ranks = ranks.select("query_id", (-F.col("down")).alias("mass"), (F.col("upto") - F.col("n") + 1).alias("position"))
    out = mass.join(ranks, ["query_id", "mass"]).join(items, ["query_id", "chunk_id"])
    return out.select("query_id", "chunk_id", (F.col("mass") / ONE).alias("stationarity"), "position", "n_lists", "query_lists", "worst_higher")


def rank_walk(lists: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, max_group: int = 200_000, batch: int = 20_000) -> DataFrame:
    """One row per query and chunk: (query_id, chunk_id, stationarity, position, n_lists, query_lists, worst_higher).

    position is 1 for the best; equal items share one (order by position, chunk_id). n_lists counts the lists that hold
    the chunk, query_lists those of the query, worst_higher is the most items that any list puts strictly above it.
    lists is what lists_of returns; an empty one gives no rows.
    """
    types = dict(lists.dtypes)
    schema = f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, {_OUT}"
    lists = written(lists)
    sizes = lists.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    large = written(sizes.where(F.col("n") > max_group).select("query_id"))
    n_rows, n_large = lists.count(), large.count()
    near = F.broadcast(large) if n_large * 16 <= BROADCAST_BYTES else large
    small = lists.join(near, "query_id", "left_anti") if n_large else lists
    groups = max(1, math.ceil(n_rows / batch))
    out = small.withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(groups))).groupBy("g").applyInPandas(lambda pdf: _walk(pdf, rounds, damping), schema)
    if n_large:
        out = out.unionByName(_walk_large(lists.join(near, "query_id", "left_semi"), rounds, damping, batch))
    return out
