"""Sums and maxima over overlapping spans, without the pairs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from opsloom.operators.joins import overlap_join
from opsloom.shared import rounds


def overlap_totals(rows: DataFrame, spans: DataFrame, start: str, end: str, r_start: str, r_end: str, count: str, value: str, most: int = 8192) -> DataFrame:
    """``rows`` with the sum of ``count`` and the greatest ``value`` of the spans that overlap them (r_start < end and r_end > start), in parts to be grouped.

    A row comes out once for each block of spans that holds some of its own.
    Times are timestamps, counts longs, values numbers; nothing ends before it
    begins. Both sides are sorted by time and cut into blocks of ``most``;
    blocks that meet in time are joined, and a task finds all totals of a block
    of rows in a block of spans by binary search. So work grows with rows and
    blocks, and no more than two blocks are held.
    """
    written = rounds(rows.sparkSession, "spans")
    left = written(_blocks(rows, start, end, most), "rows")
    right = written(_blocks(spans.select(r_start, r_end, F.col(count).cast("long").alias(count), value), r_start, r_end, most), "spans").withColumnsRenamed({c: f"r_{c}" for c in ("block", "lo", "hi", "held")})
    near = overlap_join(left.drop("held"), right.drop("r_held").withColumn("r_key", F.lit(None).cast("string")), "block", "r_key", "lo", "hi", "r_lo", "r_hi", inclusive=True)
    met = near.select("block", "r_block").join(left.select("block", "held"), "block").join(right.select("r_block", "r_held"), "r_block").select("held", "r_held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                mine, s = (pa.ipc.open_stream(b.column(c)[i].as_buffer()).read_all().combine_chunks() for c in ("held", "r_held"))
                known = np.asarray(s[value].is_valid())
                ranked, rank = np.unique(s[value].drop_null().to_numpy(), return_inverse=True)
                ranks = np.full(len(known), -1)
                ranks[known] = rank
                n, best = _totals(*_closed(mine, start, end, 1), *_closed(s, r_start, r_end, 0), s[count].to_numpy(), ranks)
                out = mine.append_column(count, pa.array(n)).append_column(value, pa.array(ranked, s.schema.field(value).type).take(pa.array(best, mask=best < 0))).filter(pa.array(n > 0))
                yield from out.to_batches()

    return met.mapInArrow(run, StructType([*rows.schema.fields, StructField(count, LongType()), spans.schema[value]]))


def _blocks(df: DataFrame, start: str, end: str, most: int) -> DataFrame:
    """Rows with both times, sorted and cut into blocks: ``block`` (a name), ``lo``, ``hi`` (first start, last end) and ``held`` (the rows in Arrow's format)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, most):
                part, sink = b.slice(at, most), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                lo, hi = pc.min(part.column(start)), pc.max(part.column(end))
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([lo.as_py()], lo.type), pa.array([hi.as_py()], hi.type), pa.array([sink.getvalue().to_pybytes()])], names=["block", "lo", "hi", "held"])

    kinds = dict(df.dtypes)
    dealt = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).repartitionByRange(start).sortWithinPartitions(start)
    return dealt.mapInArrow(run, f"block string, lo {kinds[start]}, hi {kinds[end]}, held binary")


def _closed(t: pa.Table, start: str, end: str, point: int) -> tuple[np.ndarray, np.ndarray]:
    """Open spans of time as closed ones of a finer scale; a row without length has a point of its own, which no span without length shares."""
    a, z = (t[c].cast(pa.int64()).to_numpy() * 4 for c in (start, end))
    return np.where(a < z, a + 2, a + point), np.where(a < z, z - 2, a + point)


def _totals(lo: np.ndarray, hi: np.ndarray, a: np.ndarray, z: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the spans a to z that meet each lo to hi (all closed): the sum of ``n`` and the greatest ``rank``, -1 without one.

    Begun by hi less ended before lo gives the sum. Ranks go to the segments
    between all bounds by two runs of a power of two each, which are halved
    down to single segments; then runs are doubled again for the asked ranges.
    """
    by_a, by_z = np.argsort(a), np.argsort(z)
    begun, ended = np.r_[0, np.cumsum(n[by_a])], np.r_[0, np.cumsum(n[by_z])]
    total = begun[np.searchsorted(a[by_a], hi, "right")] - ended[np.searchsorted(z[by_z], lo, "left")]
    edges = np.unique(np.r_[a, z + 1])
    m, power = len(edges) - 1, lambda width: np.frexp(width)[1] - 1
    first, last = np.searchsorted(edges, a), np.searchsorted(edges, z + 1) - 1
    k = power(last - first + 1)
    runs = [np.full(m, -1) for _ in range(int(power(m)) + 1)]
    for level, run in enumerate(runs):
        at = k == level
        np.maximum.at(run, first[at], rank[at])
        np.maximum.at(run, last[at] - (1 << level) + 1, rank[at])
    for level in range(len(runs) - 1, 0, -1):
        half = 1 << (level - 1)
        runs[level - 1] = np.maximum(runs[level - 1], runs[level])
        runs[level - 1][half:] = np.maximum(runs[level - 1][half:], runs[level][:-half])
    for level in range(1, len(runs)):
        half, below = 1 << (level - 1), runs[level - 1]
        runs[level] = below.copy()
        runs[level][:-half] = np.maximum(below[:-half], below[half:])
    first, last = (np.clip(np.searchsorted(edges, x, "right") - 1, 0, m - 1) for x in (lo, hi))
    k = power(last - first + 1)
    table = np.stack(runs)
    return total, np.maximum(table[k, first], table[k, last - (1 << k) + 1])
