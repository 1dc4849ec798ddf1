"""Evaluation texts leaking into training text, by winnowing.

Words are maximal runs of letters and digits, compared in lower case. Both sides keep the least hash of k consecutive
words in each window of w such hashes; every run of k + w - 1 shared words shares one of them, at the same place of the
run. A fingerprint travels with the w - 1 words on either side, so that each hit is extended where it is found: the
longest shared run around it reaches at least over one window of k + w - 1 words, and the runs of neighbouring hits
overlap. No text is shuffled: documents are read once, and only fingerprints that a filter of bounded size over those of
the items lets through leave the task that read them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import hashing as H
from tessera.runtime import BROADCAST_BYTES, written

#: Most bits of the filter, as a power of two (8 MB); with more items it lets more through, and the join decides.
FILTER_BITS = 26
#: Parts into which the rows of each fingerprint are put where the item side is too large to be broadcast.
SALTS = 16

_WORD = re.compile(r"[^\W_]+")
_KINDS = np.arange(256, dtype=np.uint8)
_KINDS[10] = 0  # words are joined by line feeds


def words(text: str | None) -> list[str]:
    return "\n".join(_WORD.findall(text)).lower().split("\n") if text else []


def _prints(batches: Iterator[pa.RecordBatch], k: int, w: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(fp, id, row, pos, left, words): the fingerprints of each text that the filter lets through, with the words around."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            joined, counts = [], np.zeros(part.num_rows, np.int64)
            for i, t in enumerate(part.column(2).to_pylist()):
                if t:
                    found = _WORD.findall(t)
                    counts[i] = len(found)
                    joined += found
            data = "\n".join(joined).lower().encode()
            starts, ends, h = H.tokens(np.frombuffer(data, np.uint8), _KINDS)
            rows = np.repeat(np.arange(part.num_rows), counts)
            g = H.kgrams(h, rows, k)
            where = H.winnow(g, w)
            if bits is not None and len(where):
                where = where[_passes(g[where], bits)]
            if not len(where):
                continue
            r = rows[where]
            end = np.cumsum(counts)
            first = (end - counts)[r]
            a, b = np.maximum(first, where - (w - 1)), np.minimum(end[r], where + k + w - 1)
            around = [data[i:j].decode() for i, j in zip(starts[a].tolist(), ends[b - 1].tolist())]
            take = pa.array(r)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[where].view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array((where - first).astype(np.int32)), pa.array((where - a).astype(np.int32)), pa.array(around)],
                ["fp", "id", "row", "pos", "left", "words"],
            )


def _passes(g: np.ndarray, bits: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(bits) * 64 - 1)
    ok = np.ones(len(g), bool)
    for shift in (0, 32):
        p = (g >> np.uint64(shift)) & mask
        ok &= (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) != 0
    return ok


def _filter(prints: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of two bits a fingerprint; the bits of each 64-bit word meet in an aggregation, and no more than
    2**FILTER_BITS / 64 words come to the driver."""
    size = min(FILTER_BITS, max(10, (16 * n).bit_length()))
    mask = (1 << size) - 1
    p = F.explode(F.array(F.col("fp").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(mask)))).alias("p")
    set_bits = prints.select(p).groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (size - 6), np.uint64)
    got = set_bits.toArrow()
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _extend(batches: Iterator[pa.RecordBatch], k: int, least: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(doc, row, item, lo, hi): the shared run around each hit, as far as the words that came along show it."""
    for batch in batches:
        split: dict[str, list[str]] = {}
        kept, lo, hi = [], [], []
        at, left, around, ileft, iaround = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("pos", "left", "words", "ileft", "iwords"))
        for i in range(batch.num_rows):
            for c in (around[i], iaround[i]):
                if c not in split:
                    split[c] = c.split("\n")
            a, b, x, y = split[around[i]], split[iaround[i]], left[i], ileft[i]
            e = 0
            while x + e < len(a) and y + e < len(b) and a[x + e] == b[y + e]:
                e += 1
            s = 0
            while s < x and s < y and a[x - s - 1] == b[y - s - 1]:
                s += 1
            if e >= k and s + e >= least:
                kept.append(i)
                lo.append(at[i] - s)
                hi.append(at[i] + e)
        take = pa.array(kept, pa.int32())
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).take(take) for c in names), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], [*names, "lo", "hi"])


def leaked_passages(documents: DataFrame, items: DataFrame, shared: int = 13, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """Every document and item with a shared run of at least shared words: (doc_id, item_id, n_words, first_word), the
    words of the document that stand in such runs and the 0-based place of the first of them.

    Null and empty texts share nothing. Rows repeated under one id count once; of different texts under one id the one
    with the most shared words counts. The item side is broadcast only if a count of its fingerprints shows it to be
    small; else the rows of each fingerprint are spread over SALTS parts. An item's repetitions of the same words count
    once, so that the hits of a text of one repeated word are in proportion to it.
    """
    spark = documents.sparkSession
    k = (shared + 1) // 2
    w = shared - k + 1
    dt, it = (df.schema[c].dataType.simpleString() for df, c in ((documents, doc_id), (items, item_id)))
    rows = lambda df, c: df.select(F.col(f"`{c}`").alias("id"), F.xxhash64("text").alias("row"), "text").where(F.col("text").isNotNull())
    schema = "fp long, id {}, row long, pos int, left int, words string"
    theirs = written(rows(items, item_id).mapInArrow(lambda b: _prints(b, k, w, None), schema.format(it)).select("fp", F.col("id").alias("item"), F.col("left").alias("ileft"), F.col("words").alias("iwords")).distinct())
    n = theirs.count()
    bits = spark.sparkContext.broadcast(_filter(theirs, n))
    ours = rows(documents, doc_id).mapInArrow(lambda b: _prints(b, k, w, bits.value), schema.format(dt))
    if n * 200 <= BROADCAST_BYTES:
        hits = ours.join(F.broadcast(theirs), "fp")
    else:
        parts = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = ours.withColumn("salt", F.pmod(F.xxhash64("row", "pos"), F.lit(SALTS)).cast("int")).join(parts, ["fp", "salt"])
    names = ["id", "row", "item"]
    runs = hits.select(*names, "pos", "left", "words", "ileft", "iwords").mapInArrow(lambda b: _extend(b, k, shared, names), f"id {dt}, row long, item {it}, lo int, hi int")
    # of the runs of one document and item, what none before reached is counted
    runs = runs.groupBy(*names, "lo").agg(F.max("hi").alias("hi"))
    before = Window.partitionBy(*names).orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo"), F.coalesce(F.max("hi").over(before), F.lit(0))))
    per = runs.withColumn("fresh", fresh).groupBy(*names).agg(F.sum("fresh").cast("int").alias("n_words"), F.min("lo").alias("first_word"))
    best = per.groupBy("id", "item").agg(F.max(F.struct("n_words", (-F.col("first_word")).alias("f"))).alias("m"))
    return best.select(F.col("id").alias(doc_id), F.col("item").alias(item_id), "m.n_words", (-F.col("m.f")).alias("first_word"))
