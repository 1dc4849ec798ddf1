"""Mixing sources to target weights, by weighted fair queueing.

Every text of a source, in shuffled order and at most max_repeats times over, gets a virtual finish time: the tokens of
its source up to and with it, divided by the source's weight. Taken in the order of these times up to a total budget,
the sources advance in proportion to their weights. Both running sums, within a source and over all, are taken over
range buckets: only sums of buckets and the rows of one bucket meet in a window.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.vocabulary import TOKENIZERS
from tessera.runtime import written

VOCABULARY = "byte_bpe_50k.tiktoken"
#: How that vocabulary splits a text before merging (fixed value, published with the tokenizer).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict[str, object] = {}


def _encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _sizes(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = _encoding(path).encode_ordinary
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array([len(encode(t)) for t in texts], pa.int64())], [*batch.schema.names[:-1], "tokens"]
        )


def source_name(source: Column) -> Column:
    """The source without differences of case, blanks and dashes."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(source, r"[\s ]+", " "))), r"[\s_-]+", "_")


def sized_texts(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, key): each different text once, under its least doc_id and that row's source; null and
    blank texts are left out. Texts are encoded where they are read and never shuffled; copies meet by their hash, after
    a partial aggregation."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    path = os.path.join(tokenizers, vocabulary)
    rows = documents.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select("doc_id", source_name(F.col("source")).alias("source"), F.sha2("text", 256).alias("key"), "text")
    sized = rows.mapInArrow(lambda it: _sizes(it, path), f"doc_id {id_type}, source string, key string, tokens long")
    one = sized.groupBy("key").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("m"))
    return one.select("m.doc_id", "m.source", "m.tokens", "key")


def _running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: str, out: str) -> DataFrame:
    """df with out: the sum of value over the rows of the same keys up to and with this one. bucket rises with order."""
    df = df.withColumn("__b", bucket)
    sums = df.groupBy(*keys, "__b").agg(F.sum(value).alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__w", F.sum(value).over(within)).join(sums, [*keys, "__b"])
    return df.withColumn(out, F.col("__w") + F.col("__before")).drop("__b", "__w", "__before")


def _reach(weight: np.ndarray, most: np.ndarray, budget: float) -> float:
    """The virtual time at which the sources together reach the budget, each going on at its weight until it is dry."""
    dry = most / weight
    order = np.argsort(dry)
    weight, most, dry = weight[order], most[order], dry[order]
    done, at = 0.0, 0.0
    speed = weight.sum()
    for w, m, d in zip(weight, most, dry):
        if done + speed * (d - at) >= budget:
            break
        done, at, speed = done + speed * (d - at), d, speed - w
    else:
        return float(dry.max())
    return float(at + (budget - done) / speed)


def mixture(
    documents: DataFrame, targets: DataFrame, budget: int | None = None, default_repeats: int = 1, seed: int = 0, bucket_rows: int = 20_000, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY
) -> tuple[DataFrame, DataFrame]:
    """(draws, shares). draws: (doc_id, repeat, source, tokens, finish), one row per use of a text, repeat from 0.
    shares: (source, target_share, actual_share, tokens, available_tokens, max_repeats), one row per source of either
    table, null source included.

    budget is the total of tokens drawn; by default the largest that leaves every source with text and a positive
    target at its share, repeats exhausted in none. With a larger budget, sources run dry and the rest fill it. Shares
    are over the sources that have text: those without text get nothing and are reported. A text that several documents
    hold counts once. A source without statement, or without target, may be used default_repeats times; one whose
    target is missing, null or not positive is not drawn. Repeated target rows: the highest share and repeats count.
    The draw is the same for the same seed, whatever the partitioning.

    The targets come to the driver, a row a source: they tell the virtual time at which the budget is reached, and with
    it how often each text can be used at all; later uses are never made.
    """
    sized = written(sized_texts(documents, tokenizers, vocabulary))
    wanted = (
        targets.groupBy(source_name(F.col("source")).alias("source"))
        .agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        .withColumn("max_repeats", F.coalesce("max_repeats", F.lit(default_repeats)))
    )
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.count(F.lit(1)).alias("n"), F.max("tokens").alias("longest"))
    plan = written(wanted.join(have, "source", "full_outer").withColumn("max_repeats", F.coalesce("max_repeats", F.lit(default_repeats))))
    weights = plan.where((F.col("target_share") > 0) & (F.col("available_tokens") > 0) & (F.col("max_repeats") > 0))
    known = weights.select("target_share", (F.col("available_tokens") * F.col("max_repeats")).cast("double").alias("most"), "longest", "n").toArrow()
    weight, most, longest, n = (known.column(c).to_numpy().astype(np.float64) for c in range(4))
    if budget is None:
        budget = math.floor(float((most / weight).min()) * weight.sum()) if len(weight) else 0
    # past this time the sum is past the budget, or every source is dry
    horizon = (_reach(weight, most, budget) + float((longest / weight).max())) * (1 + 1e-9) if len(weight) else 1.0
    passes = F.least(F.ceil(F.lit(horizon) * F.col("target_share") / F.col("available_tokens")), F.col("max_repeats"))
    n_uses = float(np.minimum(np.ceil(horizon * weight * n / np.maximum(most, 1)) + 1, 1e18).sum() + n.sum()) if len(weight) else 1.0
    # as many buckets as rows in one, so that neither window grows faster than the square root
    buckets = max(1, int(n_uses / max(bucket_rows, math.sqrt(n_uses))))
    # the sources are few in any mixture, but no bound is proven: Catalyst decides by size how they are joined
    uses = sized.join(weights.select("source", "target_share", "available_tokens", passes.cast("int").alias("passes")), "source")
    uses = uses.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    uses = uses.withColumn("u", F.xxhash64("key", "repeat", F.lit(seed)))
    span = F.floor((F.col("u").cast("double") / 2.0**64 + 0.5) * buckets)
    uses = _running(uses, ["source", "repeat"], span, [F.col("u"), F.col("key")], "tokens", "within")
    uses = uses.withColumn("finish", (F.col("repeat") * F.col("available_tokens") + F.col("within")) / F.col("target_share"))
    uses = uses.select("doc_id", "repeat", "source", "tokens", "finish", "key").where(F.col("finish") <= horizon)
    place = F.floor(F.col("finish") / horizon * buckets)
    draws = _running(uses.withColumn("all", F.lit(0)), ["all"], place, [F.col("finish"), F.col("source"), F.col("key"), F.col("repeat")], "tokens", "total")
    draws = written(draws.where(F.col("total") <= budget).select("doc_id", "repeat", "source", "tokens", "finish"))
    drawn = draws.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    all_drawn = int(drawn.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    key = plan.withColumn("k", F.coalesce("source", F.lit("\0"))).join(drawn.select(F.coalesce("source", F.lit("\0")).alias("k"), "tokens"), "k", "left")
    shares = key.select(
        "source",
        "target_share",
        (F.coalesce("tokens", F.lit(0)) / F.lit(max(1, all_drawn))).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
        F.col("max_repeats").cast("int").alias("max_repeats"),
    )
    return draws, shares
