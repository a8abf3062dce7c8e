"""Sequential decisions per key: rows dealt by key, sorted, folded with bounded state."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.operators.aggregates import MOST_PAIRS
from opsloom.operators.logs import SEVERITY_RANK, has_trace


def sorted_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, tuple], list[tuple]], finish: Callable[[object], list[tuple]], schema: str) -> DataFrame:
    """Calls ``step(state, row)`` for the rows of a key in order, and ``finish(state)`` after its last row.

    Rows stream through a task batch by batch; only the state of the current
    key is held, so a key of any length needs no more memory than its state.
    """
    rows = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    cols, names = rows.columns, [x.strip().split(" ")[0] for x in schema.split(",")]
    at = [cols.index(k) for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                k = tuple(None if row[i] != row[i] else row[i] for i in at)  # null keys come as NaN
                if k != key:
                    if key is not None:
                        out += finish(state)
                    key, state = k, start()
                out += step(state, row)
            if out:
                yield pd.DataFrame(out, columns=names)
        if key is not None and (rest := finish(state)):
            yield pd.DataFrame(rest, columns=names)

    return rows.mapInPandas(run, schema)


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1e6


def _missing(v: object) -> bool:
    return v is None or v != v


def refractory_fire(df: DataFrame, keys: list[str], ts: str, score: str, threshold: float = 0.48, dwell: int = 2, quiet_s: int = 1800, escalate: float = 0.20) -> DataFrame:
    """Fires when ``dwell`` scores in a row reach the threshold, then not for ``quiet_s`` unless the score rises by ``escalate``; null scores break the run.

    The state of a key is the length of its run and the last firing.
    """
    rows = df.select(*keys, ts, score, _seconds(F.col(ts)).alias("_at"))
    n, types = len(keys), dict(rows.dtypes)

    def step(s: dict, row: tuple) -> list[tuple]:
        value, now = row[n + 1], row[n + 2]
        if _missing(value) or value < threshold:
            s["run"] = 0
            return []
        s["run"] += 1
        if s["run"] < dwell or (s["at"] is not None and now - s["at"] < quiet_s and value < s["score"] + escalate):
            return []
        s["at"], s["score"] = now, value
        return [row[: n + 2]]

    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, ts, score))
    return sorted_fold(rows, keys, [ts], lambda: {"run": 0, "at": None, "score": 0.0}, step, lambda s: [], schema)


def rate_limit(df: DataFrame, keys: list[str], epoch_s: str, cooldown_s: float = 900, cap: int = 3, cap_window_s: float = 3600, arrival: list[str] | None = None) -> DataFrame:
    """``decision`` for each call: TRIGGERED, SUPPRESSED_RATE_LIMIT nearer than the cooldown to a trigger, RATE_LIMITED_HOURLY_CAP beyond the cap.

    Calls are decided in the order of ``arrival`` (by default of time) and may
    come late; triggers count while they are less than ``cap_window_s`` away. The
    state of a key is the triggers within that time of its latest one.
    """
    order = arrival or [epoch_s]
    rows = df.select(*keys, F.col(epoch_s).cast("double").alias(epoch_s), *[c for c in order if c != epoch_s])
    n, types = len(keys), dict(rows.dtypes)

    def step(hot: list, row: tuple) -> list[tuple]:
        now = row[n]
        latest = max([now, *hot])
        hot[:] = [t for t in hot if t > latest - cap_window_s]
        if any(abs(now - t) < cooldown_s for t in hot):
            decision = "SUPPRESSED_RATE_LIMIT"
        elif sum(abs(now - t) < cap_window_s for t in hot) >= cap:
            decision = "RATE_LIMITED_HOURLY_CAP"
        else:
            decision = "TRIGGERED"
            hot.append(now)
        return [(*row, decision)]

    schema = ", ".join(f"{c} {types[c]}" for c in rows.columns)
    return sorted_fold(rows, keys, order, list, step, lambda s: [], schema + ", decision string")


def dwell_alerts(df: DataFrame, keys: list[str], ts: str, value: str, threshold: float, dwell_s: int = 300, repeat_s: int = 3600) -> DataFrame:
    """Static-threshold alerts: after ``dwell_s`` over the threshold, again every ``repeat_s``; a recovery resets both."""
    rows = df.select(*keys, ts, value, _seconds(F.col(ts)).alias("_at"))
    n, types = len(keys), dict(rows.dtypes)

    def step(s: dict, row: tuple) -> list[tuple]:
        level, now = row[n + 1], row[n + 2]
        if _missing(level) or level < threshold:
            s["since"] = s["fired"] = None
            return []
        s["since"] = now if s["since"] is None else s["since"]
        if now - s["since"] < dwell_s or (s["fired"] is not None and now - s["fired"] < repeat_s):
            return []
        s["fired"] = now
        return [row[: n + 2]]

    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, ts, value))
    return sorted_fold(rows, keys, [ts], lambda: {"since": None, "fired": None}, step, lambda s: [], schema)


def slope_of(t: np.ndarray, v: np.ndarray) -> float:
    """The median slope of all pairs of points in order of time; more than ``MOST_PAIRS`` pairs are made of evenly spaced points, ends included."""
    n = len(t)
    if n * (n - 1) // 2 > MOST_PAIRS:
        keep = int((2 * MOST_PAIRS) ** 0.5)
        at = np.unique(np.rint(np.arange(keep) * ((n - 1) / (keep - 1.0))).astype(np.int64))
        t, v, n = t[at], v[at], len(at)
    i, j = np.triu_indices(n, 1)
    apart = t[j] - t[i]
    ok = apart > 0
    return float(np.median((v[j] - v[i])[ok] / apart[ok])) if ok.any() else 0.0


def sliding_theil_sen(df: DataFrame, keys: list[str], order: list[str], value: str, window: float, least: int = 2) -> DataFrame:
    """Every row with the Theil-Sen ``slope`` and ``n_points`` of its key's points in the last ``window`` up to it, itself included.

    ``order`` is the time and what decides ties. The state of a key is the points
    of one window; rows with an unknown value have no point, and a row whose
    window has fewer than ``least`` points has no slope.
    """
    t = order[0]
    types = dict(df.dtypes)
    cols = df.columns
    at, of = cols.index(t), cols.index(value)

    def step(points: list, row: tuple) -> list[tuple]:
        now = float(row[at])
        if not _missing(row[of]):
            points.append((now, float(row[of])))
        gone = 0
        while gone < len(points) and points[gone][0] < now - window:
            gone += 1
        del points[:gone]
        n = len(points)
        slope = slope_of(*np.array(points).T) if n >= max(least, 1) else None
        return [(*row, slope, n)]

    schema = ", ".join(f"{c} {types[c]}" for c in cols) + ", slope double, n_points long"
    return sorted_fold(df, keys, order, list, step, lambda s: [], schema)


# How a chunk that is too long is cut.
CHUNK_CUT, CHUNK_CUT_ROOM = "\n... [CHUNK TRUNCATED FOR TOKEN LIMIT] ...\n", 45


def count_chunks(df: DataFrame, keys: list[str], epoch_s: str, log_id: str, severity: str, text: str, size: int = 5, stride: int = 2, gap_s: float = 30.0, limit: int = 6000, trace: str | None = None) -> DataFrame:
    """Sliding windows of ``size`` lines a key, moving by ``stride``.

    A severe line, one with a stack trace (column ``trace``; by default the text
    is looked at) or a gap to the window's first line flushes what is there; what
    is left at the end is flushed too. chunk_id hashes key and first line.
    """
    has = has_trace(F.col(text)) if trace is None else F.coalesce(F.col(trace), F.lit(False))
    rows = df.select(*keys, epoch_s, log_id, severity, text, has.alias("_trace"))
    n = len(keys)

    def chunk(w: list) -> tuple:
        first = w[0]
        body = "\n".join(str(r[n + 3]) for r in w)
        if len(body) > limit:
            half = (limit - CHUNK_CUT_ROOM) // 2
            body = body[:half] + CHUNK_CUT + body[-half:]
        top = max(w, key=lambda r: SEVERITY_RANK.get(str(r[n + 2]).upper(), 20))[n + 2]
        ident = hashlib.sha256("|".join(map(str, first[: n + 2])).encode()).hexdigest()[:32]
        return (*first[:n], ident, [str(r[n + 1]) for r in w], str(top).upper(), any(r[n + 4] for r in w), body)

    def step(s: list, row: tuple) -> list[tuple]:
        out = []
        if s and row[n] - s[0][n] > gap_s:
            out.append(chunk(s))
            s.clear()
        s.append(row)
        severe = str(row[n + 2]).upper() in ("ERROR", "CRITICAL", "FATAL") or bool(row[n + 4])
        if len(s) >= size:
            out.append(chunk(s[:size]))
            del s[:stride]
        elif severe:
            out.append(chunk(s))
            del s[: stride if len(s) > stride else len(s)]
        return out

    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", chunk_id string, log_ids array<string>, severity string, has_stack_trace boolean, chunk_text string"
    return sorted_fold(rows, keys, [epoch_s, log_id], list, step, lambda s: [chunk(s)] if s else [], schema)
