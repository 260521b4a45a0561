"""Small series and straightforward one-machine statements of the operators, for comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd


def make_bars(spark, lengths=(230, 97, 2, 1), seed=3, gaps=True, flat=()):
    """Random-walk bars; ``flat`` stretches hold the price constant."""
    rng = np.random.default_rng(seed)
    frames = []
    for k, n in enumerate(lengths):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for lo, hi in flat:
            close[lo:hi] = close[min(lo, n - 1)]
        spread = rng.uniform(0, 2, n)
        hours = np.arange(n)
        if gaps:
            hours = hours + np.cumsum(rng.integers(0, 3, n))
        frames.append(
            pd.DataFrame(
                {
                    "ticker": f"t{k}",
                    "ts": pd.Timestamp("2024-01-01 05:00") + pd.to_timedelta(hours, unit="h"),
                    "open": close - 0.1,
                    "high": close + spread,
                    "low": close - spread,
                    "close": close,
                    "volume": rng.integers(1, 100, n).astype(float),
                }
            )
        )
    pdf = pd.concat(frames, ignore_index=True)
    return pdf, spark.createDataFrame(pdf)


def by_ticker(pdf, fn):
    return pd.concat([fn(g.reset_index(drop=True)) for _, g in pdf.groupby("ticker", sort=True)], ignore_index=True)


def cusum(r, limit, mode):
    fired, high, low = [], 0.0, 0.0
    for x, h in zip(r, limit):
        high, low = max(0.0, high + x), min(0.0, low + x)
        hit_up, hit_down = high > h, low < -h
        if mode == "symmetric":
            hit = hit_up or hit_down
            if hit:
                high = low = 0.0
        elif mode == "positive":
            hit = hit_up
            high = 0.0 if hit else high
        else:
            hit = hit_down
            low = 0.0 if hit else low
        fired.append(hit)
    return np.array(fired, dtype=bool)


def supertrend(pdf, n, multiplier):
    pc = pdf.close.shift(1)
    tr = pd.concat([pdf.high - pdf.low, (pdf.high - pc).abs(), (pdf.low - pc).abs()], axis=1).max(axis=1)
    width = multiplier * tr.ewm(alpha=1 / n, min_periods=n).mean()
    mid = (pdf.high + pdf.low) / 2
    up, dn, close = (mid + width).to_numpy(), (mid - width).to_numpy(), pdf.close.to_numpy()
    line, side = np.full(len(pdf), np.nan), 1
    for i in range(1, len(pdf)):
        if close[i] > up[i - 1]:
            side = 1
        elif close[i] < dn[i - 1]:
            side = -1
        elif side == 1:
            dn[i] = dn[i - 1] if dn[i] < dn[i - 1] else dn[i]
        else:
            up[i] = up[i - 1] if up[i] > up[i - 1] else up[i]
        line[i] = dn[i] if side == 1 else up[i]
    return line
