"""Smoothed likelihoods as a stream: what the batch folds over a series, one line's state carries from window to window."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from taktwerk.functions.shipping import ship

OUT = "line {line}, window long, top_station int, llr double, near boolean"
PACKED = ("windows", "ks", "llrs")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SmoothTops(StatefulProcessor):
    """Per line: the smoothed value of each hypothesis, the last window and its top, and rows of windows that are not complete.

    A window is worked off when its ``expected`` rows are there, in order of windows; one that ``patience`` later windows have overtaken goes with what it has.
    Rows of windows that are worked off already give nothing.
    """

    def __init__(self, expected: int, alpha: float, patience: int, key_name: str):
        self.expected, self.alpha, self.patience, self.key_name = expected, alpha, patience, key_name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.series = handle.getValueState("series", "window long, top int, ks array<int>, ys array<double>")
        self.pending = handle.getListState("pending", "window long, k int, llr double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, top, smooth = -1, None, {}
        if self.series.exists():
            last, top, ks, ys = self.series.get()
            smooth = dict(zip(ks, ys, strict=True))
        parts = [([w], [k], [v]) for w, k, v in self.pending.get()]
        parts += [p for some in rows for p in zip(*(some[c].tolist() for c in PACKED), strict=True)]
        w, k, v = (np.concatenate([np.asarray(x, kind) for x in column]) for column, kind in zip(zip(*parts), (np.int64, np.int32, float)))
        new = w > last
        w, k, v = w[new], k[new], v[new]
        order = np.lexsort((k, w))  # stable: of a row that is sent twice the later one counts
        w, k, v = w[order], k[order], v[order]
        kept = np.ones(len(w), bool)
        kept[:-1] = (w[1:] != w[:-1]) | (k[1:] != k[:-1])
        w, k, v = w[kept], k[kept], v[kept]
        waiting, n_rows = np.unique(w, return_counts=True)
        n = len(waiting)
        done = next((i for i in range(max(0, n - self.patience), n) if n_rows[i] < self.expected), n)
        ready = int(n_rows[:done].sum())
        out = self._tops(waiting[:done], np.repeat(np.arange(done), n_rows[:done]), k[:ready], v[:ready], top, smooth)
        if done:
            self.series.update((int(waiting[done - 1]), int(out["top_station"].iloc[-1]), list(smooth), list(smooth.values())))
        self.pending.clear()
        rest = list(zip(w[ready:].tolist(), k[ready:].tolist(), v[ready:].tolist(), strict=True))
        if rest:
            self.pending.put(rest)
        out.insert(0, self.key_name, key[0])
        yield out

    def _tops(self, windows: np.ndarray, at: np.ndarray, k: np.ndarray, v: np.ndarray, top: int | None, smooth: dict[int, float]) -> pd.DataFrame:
        """(window, top_station, llr, near) of windows in order; row i is of window ``at[i]``. ``smooth`` is carried on to the last of them; the work is in proportion to the rows."""
        ks = np.array(sorted({*smooth, *np.unique(k).tolist()}), np.int32)
        level = np.empty((len(ks), len(windows)))
        for j, h in enumerate(ks.tolist()):
            own = k == h
            # One more value than rows: what holds before the first row, nothing for a hypothesis that is new.
            values = list(accumulate(v[own].tolist(), lambda y, x: self.alpha * x + (1 - self.alpha) * y, initial=smooth.get(h)))
            values = values if h in smooth else [-np.inf, *values]
            seen = np.zeros(len(windows), np.int64)
            seen[at[own]] = 1
            level[j] = np.array(values)[np.cumsum(seen)]
            smooth[h] = values[-1]
        best = np.argmax(np.round(level, 9), axis=0) if len(windows) else np.empty(0, np.int64)
        tops = ks[best]
        near = np.zeros(len(windows), bool)
        near[1:] = np.abs(np.diff(tops)) <= 1
        near[:1] = top is not None and np.abs(tops[:1] - top) <= 1
        return pd.DataFrame({"window": windows, "top_station": tops, "llr": level[best, np.arange(len(windows))], "near": near})

    def close(self) -> None:
        pass


def pack(line: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row a line of each batch of rows, with lists: Spark hands rows to a state one by one, which costs more than the state's own work. A missing likelihood counts as 0."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            some = some.filter(pc.and_(some["window"].is_valid(), some["k"].is_valid()))
            lines = some[line].dictionary_encode(null_encoding="encode")
            for n in range(len(lines.dictionary)):
                own = some.filter(pc.equal(lines.indices, n))
                llr = pc.fill_null(own["llr"].cast(pa.float64()), 0.0)
                values = (own["window"].cast(pa.int64()), own["k"].cast(pa.int32()), pc.if_else(pc.is_nan(llr), 0.0, llr))
                ends = pa.array([0, own.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([own[line][:1], *(pa.ListArray.from_arrays(ends, v) for v in values)], names=[line, *PACKED])

    return packed


def smoothed_tops(stream: DataFrame, line: str, expected: int, alpha: float = 0.55, patience: int = 8) -> DataFrame:
    """(line, window, top_station, llr, near) of a stream (line, window, k, llr): the hypothesis of the highest smoothed value, and whether it lies within one of the window before.

    State grows with lines and hypotheses, not with time. It is kept in RocksDB, which the session is set to."""
    ship(stream.sparkSession)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = dict(stream.dtypes)[line]
    schema = OUT.format(line=kind).replace("line ", f"{line} ", 1)
    packed = stream.select(line, "window", "k", "llr").mapInArrow(pack(line), f"{line} {kind}, windows array<long>, ks array<int>, llrs array<double>")
    return packed.groupBy(line).transformWithStateInPandas(statefulProcessor=SmoothTops(expected, alpha, patience, line), outputStructType=schema, outputMode="Append", timeMode="None")
