"""How distinctive a term is for a record: hypergeometric enrichment against the whole collection.

Terms are maximal runs of A-Za-z0-9_, A-Z folded to a-z, that start with a letter and have at least min_length
characters; with unicode, of the letters, marks and digits of all scripts and _, in lower case. The collection is an urn of N term occurrences, K of them the term; a record draws n, and the score is
-log10 of P(X >= k), the exact upper tail, summed from log-gamma values, after Benjamini-Hochberg adjustment over the
terms scored for the record.

One pass counts each term's occurrences and records, added up per batch before anything is shuffled. A second pass
yields the pairs of record and term, with 64-bit hashes in place of strings. The pairs of frequent terms, which are most,
stay with their record as arrays of small numbers, as the statistics of a bounded number of such terms are known to every
task; those of rare terms meet their statistics by hash, then their record. Strings come last.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import hashing as H
from tessera.runtime import written

#: At most so many terms count as heavy: those with at least this part of all pairs of record and term.
HEAVY = 10_000

_KINDS = H.byte_table(H.WORD)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_KINDS_ALL = H.byte_table(H.WORD, high=True)
_LETTER_ALL = _LETTER.copy()
_LETTER_ALL[128:] = True


class _Folded(dict):
    """For str.translate: letters, marks and ASCII as they are, digits of all scripts as ASCII digits, else a blank."""

    def __missing__(self, c: int) -> int:
        kind = unicodedata.category(chr(c))
        self[c] = c if c < 128 or kind[0] in "LM" else 48 + unicodedata.digit(chr(c)) if kind == "Nd" else 32
        return self[c]


_FOLDED = _Folded()


def _folded(texts: pa.Array) -> pa.Array:
    """Texts of which every byte above 127 belongs to a letter or mark, in lower case."""
    return pa.array([t if t is None or t.isascii() else t.lower().translate(_FOLDED) for t in texts.to_pylist()], pa.string())


def _terms(data: np.ndarray, at: np.ndarray, least: int, unicode: bool):
    """Per slice of rows: buffer, first row, starts, ends, hashes and rows of its terms."""
    kinds, letter = (_KINDS_ALL, _LETTER_ALL) if unicode else (_KINDS, _LETTER)
    for a, b in H.slices(at):
        buf = data[at[a] : at[b]]
        starts, ends, h = H.tokens(buf, kinds)
        size = ends - starts
        if unicode and least > 1 and len(starts):  # characters, not bytes
            more = np.append(0, np.cumsum((buf & 0xC0) == 0x80))
            size = size - (more[ends] - more[starts])
        ok = (size >= least) & letter[buf[np.minimum(starts, max(len(buf) - 1, 0))]] if len(starts) else np.zeros(0, bool)
        starts, ends, h = starts[ok], ends[ok], h[ok]
        rows = np.searchsorted(at[a : b + 1] - at[a], starts, "right") - 1
        yield buf, a, starts, ends, h, rows


def _count(batches: Iterator[pa.RecordBatch], least: int, unicode: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = H.spaced_buffers(_folded(batch.column(0)) if unicode else batch.column(0))
        for buf, _, starts, ends, h, rows in _terms(data, at, least, unicode):
            if not len(h):
                continue
            h, tf, _, first = _pairs(h, rows)
            keys, where, each = np.unique(h, return_index=True, return_inverse=True)
            low = (_KINDS_ALL if unicode else _KINDS)[buf].tobytes()
            text = [low[s:e].decode() for s, e in zip(starts[first[where]].tolist(), ends[first[where]].tolist())]
            cf, df = np.bincount(each, weights=tf), np.bincount(each)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(cf.astype(np.int64)), pa.array(df.astype(np.int64)), pa.array(text)], ["h", "cf", "df", "term"])


def _pairs(h: np.ndarray, rows: np.ndarray):
    """Distinct (row, hash) with counts: hash, count, row, index of the first occurrence."""
    order = np.lexsort((h, rows))
    hs, rs = h[order], rows[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    first = np.flatnonzero(new)
    return hs[first], np.diff(np.append(first, len(hs))).astype(np.int64), rs[first], order[first]


def _candidates(batches: Iterator[pa.RecordBatch], least: int, min_count: int, unicode: bool, heavy: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """For each record with pairs one row (key, id, row, n, heavy_at, heavy_tf), and one (key, row, tf) for each pair of
    a rare term, key being its hash. heavy holds the sorted hashes of the frequent terms and which of them are scored."""
    hashes, scored = heavy
    for batch in batches:
        data, at = H.spaced_buffers(_folded(batch.column(1)) if unicode else batch.column(1))
        for _, a, _, _, h, rows in _terms(data, at, least, unicode):
            if not len(h):
                continue
            length = np.bincount(rows)
            h, tf, r, _ = _pairs(h, rows)
            place = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
            frequent = hashes[place] == h if len(hashes) else np.zeros(len(h), bool)
            ok = (tf >= min_count) & (~frequent | scored[place] if len(hashes) else True)
            h, tf, r, place, frequent = h[ok], tf[ok], r[ok], place[ok], frequent[ok]
            heads, n_heads = np.unique(r), len(np.unique(r))
            if not n_heads:
                continue
            where = pa.array(heads + a)
            ids, numbers = batch.column(0).take(where), batch.column(2).take(where)
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(np.searchsorted(heads, r[frequent]), minlength=n_heads))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[frequent].astype(np.int32))) for x in (place, tf)]
            none = lambda t: pa.nulls(n_heads, t)
            spread = H.mix(numbers.to_numpy(zero_copy_only=False).view(np.uint64) + np.uint64(1)).view(np.int64)
            names = ["key", "id", "row", "n", "heavy_at", "heavy_tf", "tf"]
            yield pa.RecordBatch.from_arrays([pa.array(spread), ids, numbers, pa.array(length[heads].astype(np.int64)), *lists, none(pa.int64())], names)
            m = int((~frequent).sum())
            if m:
                none = lambda t: pa.nulls(m, t)
                light = [pa.array(h[~frequent].view(np.int64)), none(ids.type), batch.column(2).take(pa.array(r[~frequent] + a)), none(pa.int64()), none(lists[0].type), none(lists[0].type), pa.array(tf[~frequent])]
                yield pa.RecordBatch.from_arrays(light, names)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of gamma for x > 0: Stirling's series after a shift to x >= 8."""
    x = np.asarray(x, np.float64).copy()
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        if not small.any():
            break
        shift[small] += np.log(x[small])
        x[small] += 1
    y = 1 / (x * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + series - shift


def _log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def log_upper_tail(k: np.ndarray, n: np.ndarray, K: np.ndarray, N: np.ndarray) -> np.ndarray:
    """log P(X >= k) for X hypergeometric: n draws from N of which K are marked. All terms of the tail are added,
    until they no longer change the sum."""
    k, n, K, N = (np.asarray(v, np.float64) for v in (k, n, K, N))
    top = np.minimum(n, K)
    low = np.maximum(0, n + K - N)
    out = np.full(len(k), -np.inf)
    out[k <= low] = 0.0
    todo = np.flatnonzero((k > low) & (k <= top))
    if len(todo):
        x, n, K, N, top = k[todo], n[todo], K[todo], N[todo], top[todo]
        first = _log_choose(K, x) + _log_choose(N - K, n - x) - _log_choose(N, n)
        total, term, at = np.ones(len(x)), np.ones(len(x)), x.copy()
        on = np.arange(len(x))
        while len(on):
            a = at[on]
            term[on] *= (K[on] - a) * (n[on] - a) / ((a + 1) * (N[on] - K[on] - n[on] + a + 1))
            total[on] += term[on]
            at[on] += 1
            on = on[(at[on] < top[on]) & (term[on] > 1e-17 * total[on])]
        out[todo] = np.minimum(0.0, first + np.log(total))
    return out


def _adjusted(log_p: np.ndarray, record: np.ndarray) -> np.ndarray:
    """Benjamini-Hochberg over each record's terms, in logarithms."""
    order = np.lexsort((log_p, record))
    starts = np.flatnonzero(np.append(True, record[order][1:] != record[order][:-1])) if len(order) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(order)))
    rank = np.arange(len(order)) - np.repeat(starts, sizes) + 1
    q = log_p[order] + np.log(np.repeat(sizes, sizes) / rank)
    for s, n in zip(starts.tolist(), sizes.tolist()):
        q[s : s + n] = np.minimum.accumulate(q[s : s + n][::-1])[::-1]
    out = np.empty(len(q))
    out[order] = np.minimum(0.0, q)
    return out


def _score(batches: Iterator[pa.RecordBatch], total: int, heavy: tuple[np.ndarray, np.ndarray, pa.Array]) -> Iterator[pa.RecordBatch]:
    cf_h, df_h, term_h = heavy
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            ids, n, places, tfs, light = (b.column(i) for i in range(5))
            number = np.arange(b.num_rows)
            one = np.repeat(number, pa.compute.list_value_length(places).to_numpy(zero_copy_only=False))
            two = np.repeat(number, pa.compute.list_value_length(light).to_numpy(zero_copy_only=False))
            p, rare = places.flatten().to_numpy(), light.flatten()
            of = lambda i: rare.field(i).to_numpy(zero_copy_only=False)
            record = np.concatenate([one, two])
            k = np.concatenate([tfs.flatten().to_numpy(), of(0)]).astype(np.int64)
            df, cf = np.concatenate([df_h[p], of(1)]).astype(np.int64), np.concatenate([cf_h[p], of(2)]).astype(np.int64)
            drawn = n.to_numpy(zero_copy_only=False)[record]
            log_p = log_upper_tail(k, drawn, cf, np.full(len(k), total))
            log_q = _adjusted(log_p, record)
            term = pa.concat_arrays([term_h.take(pa.array(p)), rare.field(3).cast(pa.string())])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(record)), term, pa.array(k), pa.array(df), pa.array(cf), pa.array(np.exp(log_p)), pa.array(-log_q / np.log(10) + 0.0)], ["id", "term", "tf", "df", "cf", "p_value", "score"]
            )


def distinctive_terms(
    records: DataFrame, id_col: str = "chunk_id", text_col: str = "text", min_length: int = 6, min_count: int = 1, min_df: int = 1, max_df: int | None = None, unicode: bool = False
) -> DataFrame:
    """Terms of each record with their weight: (id_col, term, tf, df, cf, p_value, score), score high for terms that
    mark the record. Pairs with fewer than min_count occurrences in the record, and terms in fewer than min_df or more
    than max_df records, are not scored (and not in the family that the false-discovery adjustment counts).

    All statistics are over all rows. A repeated row counts as another record and yields its rows again; a null id is a
    record like any other; null and empty texts have no terms; other columns are not read.
    """
    text = F.col(f"`{text_col}`").alias("text")
    spark = records.sparkSession
    counts = written(
        records.select(text)
        .mapInArrow(lambda it: _count(it, min_length, unicode), "h long, cf long, df long, term string")
        .groupBy("h")
        .agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"), F.min("term").alias("term"))
    )
    total, n_pairs = counts.agg(F.coalesce(F.sum("cf"), F.lit(0)), F.coalesce(F.sum("df"), F.lit(0))).first()
    # terms with a HEAVY-th of all pairs or more are HEAVY at most; no key of the shuffled join has more pairs than that
    frequent = F.col("df") * HEAVY >= n_pairs
    top = counts.where(frequent).toArrow().combine_chunks()
    top = top.take(pa.array(np.argsort(top.column("h").to_numpy().view(np.uint64))))
    hashes, cf, df = top.column("h").to_numpy().view(np.uint64), top.column("cf").to_numpy(), top.column("df").to_numpy()
    scored = (df >= min_df) & (df <= (max_df if max_df is not None else n_pairs))
    terms = pa.concat_arrays([pa.array([], pa.string()), *(c.cast(pa.string()) for c in top.column("term").chunks)])
    known = spark.sparkContext.broadcast((hashes, scored, cf, df, terms))
    within = F.col("df") >= min_df
    if max_df is not None:
        within &= F.col("df") <= max_df
    light = counts.where(~frequent & within).select(F.col("h").alias("key"), "cf", "df", "term")
    id_type = records.schema[id_col].dataType.simpleString()
    pairs = records.select(F.col(f"`{id_col}`").alias("id"), text, F.monotonically_increasing_id().alias("row")).mapInArrow(
        lambda it: _candidates(it, min_length, min_count, unicode, known.value[:2]), f"key long, id {id_type}, row long, n long, heavy_at array<int>, heavy_tf array<int>, tf long"
    )
    joined = pairs.join(light, "key", "left").where(F.col("n").isNotNull() | F.col("cf").isNotNull())
    rare = F.when(F.col("n").isNull(), F.struct("tf", "df", "cf", "term"))
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    per = joined.groupBy("row").agg(first("id"), first("n"), first("heavy_at"), first("heavy_tf"), F.collect_list(rare).alias("rare")).select("id", "n", "heavy_at", "heavy_tf", "rare")
    out = per.mapInArrow(lambda it: _score(it, total, known.value[2:]), f"id {id_type}, term string, tf long, df long, cf long, p_value double, score double")
    return out.withColumnRenamed("id", id_col)
