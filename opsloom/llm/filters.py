"""A filter of fixed size that keeps rows without a partner from being shuffled into a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 22


def slots(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _slot(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - FILTER_BITS)


def _inside(slot: Column) -> Column:
    return slot.bitwiseAND(F.lit(63).cast("long")).cast("int")


def bit_words(rows: DataFrame, hashed: Column) -> DataFrame:
    """_word, _bits: which values of the first FILTER_BITS bits of 64-bit hashes occur, 64 of them a row; 65,536 rows at most, whatever the input."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _inside(_slot(hashed)))
    return rows.select(F.shiftright(_slot(hashed), 6).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def bit_filter(rows: DataFrame, hashed: Column) -> np.ndarray:
    """The same as an array of packed bits, for tasks in Python."""
    words = bit_words(rows, hashed).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["_word"].to_numpy(np.int64)] = words["_bits"].to_numpy(np.int64).view(np.uint64)
    return out


def known_slots(sent) -> np.ndarray:
    return np.unpackbits(sent.value.astype("<u8").view(np.uint8), bitorder="little").view(bool)


def with_may_meet(rows: DataFrame, hashed: Column, partners: DataFrame, partner_hashed: Column) -> DataFrame:
    """``rows`` with ``_may``: may the row's hash be among the partners' hashes?

    It is true for all that have a partner; for how many others grows with the
    number of partners, up to all of them. The words of the filter are sent to
    the tasks (65,536 rows at most).
    """
    words = F.broadcast(bit_words(partners, partner_hashed))
    held = rows.withColumn("_slot", _slot(hashed)).join(words, F.shiftright("_slot", 6) == F.col("_word"), "left")
    bit = F.call_function("shiftrightunsigned", F.col("_bits"), _inside(F.col("_slot"))).bitwiseAND(F.lit(1).cast("long"))
    return held.withColumn("_may", F.coalesce(bit == 1, F.lit(False))).drop("_slot", "_word", "_bits")


def that_may_meet(rows: DataFrame, hashed: Column, partners: DataFrame, partner_hashed: Column) -> DataFrame:
    """Those of ``rows`` that may have a partner; the join behind it decides."""
    return with_may_meet(rows, hashed, partners, partner_hashed).filter("_may").drop("_may")
