"""Take-offs, sell-offs and prominent turns of a smoothed daily series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def prominent(x: np.ndarray, least: float) -> list[int]:
    """Middles of flat-topped local maxima that stand at least ``least`` above the higher of the lowest points on the way to something higher on either side."""
    out, n, i = [], len(x), 1
    while i < n - 1:
        j = i
        while j < n - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < n - 1 and x[j + 1] < x[i]:
            lows = []
            for step in (-1, 1):
                k, low = (i if step < 0 else j), x[i]
                while 0 <= k < n and x[k] <= x[i]:
                    low, k = min(low, x[k]), k + step
                lows.append(low)
            if x[i] - max(lows) >= least:
                out.append((i + j) // 2)
        i = j + 1
    return out


def inflection(series: DataFrame, span: int = 7, k: float = 2.0, peak_k: float = 3.0) -> DataFrame:
    """series (entity, day, n): exponentially smoothed, its change, unusual rises and falls, prominent peaks and troughs.

    Prominence looks along the whole series, which no window frame expresses; a name's calendar is a few thousand rows, so it fits one task. Thresholds are of the whole series (for display, not for trading).
    """

    def of(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("day").reset_index(drop=True)
        s = g["n"].astype(float).ewm(span=span, min_periods=1).mean()
        v = s.diff().fillna(0.0)
        spread, mid = v.std() if len(v) > 1 else 0.0, v.mean()
        x, sd = s.to_numpy(), s.std() if len(s) > 1 else 0.0
        need = peak_k * (sd or 1.0)
        at = np.arange(len(g))
        return g.assign(smoothed=s, velocity=v, rise=(v > mid + k * spread) & (v > 0), fall=(v < mid - k * spread) & (v < 0), peak=np.isin(at, prominent(x, need)), trough=np.isin(at, prominent(-x, need)))

    cols = series.select("entity", "day", "n")
    return cols.groupBy("entity").applyInPandas(of, "entity string, day date, n long, smoothed double, velocity double, rise boolean, fall boolean, peak boolean, trough boolean")
