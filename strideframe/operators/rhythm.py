"""Rhythm of sample windows: dominant frequency, periodic score, repetitions and step frequency.

Signals are array columns of one window each.  An Arrow batch is worked off as one matrix per
(length, rate): a single FFT gives all spectra of the matrix and, through the inverse transform of the
power spectrum, all autocorrelations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

RHYTHM = T.StructType([T.StructField(c, T.DoubleType()) for c in ("freq", "score", "period", "reps")])
_TINY = 1e-8


def filled(signal) -> np.ndarray:
    """Missing samples by linear interpolation, the ends by the nearest sample; zeros where all are missing."""
    x = np.array([np.nan if v is None else v for v in signal], float)
    known = np.flatnonzero(np.isfinite(x))
    return np.interp(np.arange(len(x)), known, x[known]) if len(known) else np.zeros(len(x))


def _matrices(signals: pd.Series, rates: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Row numbers, centred signals and rate of all signals of one length and rate."""
    groups: dict[tuple[int, float], list[int]] = {}
    for i, (s, r) in enumerate(zip(signals, rates)):
        groups.setdefault((len(s), float(r)), []).append(i)
    for (n, rate), rows in groups.items():
        x = np.array([filled(signals.iloc[i]) for i in rows]).reshape(len(rows), n)
        yield np.array(rows), x - x.mean(1, keepdims=True) if n else x, rate


def autocorrelations(x: np.ndarray) -> np.ndarray:
    """Sums of lagged products of each row, for all lags from 0 on."""
    n = x.shape[1]
    return np.fft.irfft(np.abs(np.fft.rfft(x, 2 * n, axis=1)) ** 2, 2 * n, axis=1)[:, :n]


def rhythm(signals: pd.Series, rates: pd.Series, least_rows: int, least_seconds: float, low: float = 0.2, high: float = 3.0) -> pd.DataFrame:
    """freq, score, period and reps of each signal; zeros (period missing) for short and constant ones.

    The score weighs the strongest echo at lags of 1/high to 1/low seconds with 0.55, and three times the
    strongest frequency's share of the power between low and high, at most 1, with 0.45.
    """
    out = np.zeros((len(signals), 4))
    out[:, 2] = np.nan
    for rows, x, rate in _matrices(signals, rates):
        n, spread = x.shape[1], x.std(1) if x.size else np.zeros(len(rows))
        alive = spread >= 1e-6
        freqs = np.fft.rfftfreq(n, 1.0 / rate) if n else np.zeros(0)
        band = np.flatnonzero((freqs >= low) & (freqs <= high))
        if n < max(least_rows, int(least_seconds * rate)) or not alive.any() or not len(band):
            continue
        z, rows = x[alive] / spread[alive][:, None], rows[alive]
        power = np.abs(np.fft.rfft(z * np.hanning(n), axis=1)[:, band]) ** 2
        top = power.argmax(1)
        share = power[np.arange(len(rows)), top] / (power.sum(1) + _TINY)
        first, last = max(1, int(rate / high)), min(n - 1, int(rate / low))
        echo = autocorrelations(z)
        echo = (echo[:, first:last] / (echo[:, :1] + _TINY)).max(1) if last > first else np.zeros(len(rows))
        freq = freqs[band][top]
        out[rows, 0], out[rows, 1] = freq, np.clip(0.55 * echo + 0.45 * np.minimum(1.0, 3.0 * share), 0.0, 1.0)
        moving = freq > 0
        out[rows[moving], 2], out[rows[moving], 3] = 1.0 / freq[moving], n / rate * freq[moving]
    return pd.DataFrame(out, columns=RHYTHM.names).astype(object).where(lambda d: d.notna(), None)


def periodicity(signal: Column, rate: Column, least_rows: int = 16, least_seconds: float = 1.5) -> Column:
    """A struct of freq, score, period and reps.  NULL samples are interpolated; a window of fewer than max(least_rows, least_seconds * rate) rows has no rhythm."""

    @F.pandas_udf(RHYTHM)
    def run(signals: pd.Series, rates: pd.Series) -> pd.DataFrame:
        return rhythm(signals, rates, least_rows, least_seconds)

    return run(signal, rate)


def steps(signals: pd.Series, seconds: pd.Series, low: float = 0.30, high: float = 1.50, least: float = 0.25) -> np.ndarray:
    """Steps per second: the rate over the lag (low to high seconds) of the strongest echo; 0 if that is under ``least`` or there are under ten samples."""
    rates = pd.Series([len(s) / max(t, 0.01) for s, t in zip(signals, seconds)], dtype=float)
    out = np.zeros(len(signals))
    for rows, x, rate in _matrices(signals, rates):
        first, last = max(1, int(low * rate)), min(x.shape[1] - 1, int(high * rate))
        if x.shape[1] < 10 or first >= last:
            continue
        echo = autocorrelations(x)
        echo = echo[:, first:last] / (echo[:, :1] + 1e-9)
        lag = echo.argmax(1)
        out[rows] = np.where(echo.max(1) < least, 0.0, np.round(rate / (lag + first), 2))
    return out


@F.pandas_udf(T.DoubleType())
def step_frequency(signal: pd.Series, seconds: pd.Series) -> pd.Series:
    """Steps per second of one window's magnitudes; 0 without rhythm."""
    return pd.Series(steps(signal, seconds))
