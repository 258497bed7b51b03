"""Log-mel features of waveforms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MelSettings:
    """Fixed values of the acoustic model's front end; frames of 25 ms every 10 ms at 16 kHz."""

    rate: int = 16000
    frame: int = 400
    hop: int = 160
    fft: int = 512
    mels: int = 80
    stack: int = 2
    preemphasis: float = 0.97
    floor: float = 1.192092955078125e-07
    lowest: float = 20.0
    highest: float = 8000.0
    epsilon: float = 1e-7
    normalize: bool = True


def mel_bank(s: MelSettings) -> np.ndarray:
    """(fft // 2 + 1, mels): triangles that are straight on the mel scale; the Nyquist bin counts nowhere."""
    scale = lambda hz: 1127.0 * np.log1p(np.asarray(hz) / 700.0)
    corners = np.linspace(scale(s.lowest), scale(s.highest), s.mels + 2)
    bins = scale(np.arange(s.fft // 2) * s.rate / s.fft)[:, None]
    rise = (bins - corners[:-2]) / np.diff(corners)[:-1]
    fall = (corners[2:] - bins) / np.diff(corners)[1:]
    return np.vstack([np.clip(np.minimum(rise, fall), 0, None), np.zeros((1, s.mels))])


def log_mel(samples: np.ndarray, s: MelSettings = MelSettings(), chunk: int = 4096) -> np.ndarray:
    """(frames // stack, mels * stack) of samples in [-1, 1]; no rows where they are fewer than a frame.

    Spectra are taken ``chunk`` frames at a time, so memory beyond the result is bounded.
    """
    x = np.asarray(samples, dtype=np.float64) * 32768
    if len(x) < s.frame:
        return np.zeros((0, s.mels * s.stack), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, s.frame)[:: s.hop]
    window = np.hanning(s.frame) ** 0.85
    bank, out = mel_bank(s), np.empty((len(frames), s.mels))
    for a in range(0, len(frames), chunk):
        part = frames[a : a + chunk] - frames[a : a + chunk].mean(axis=1, keepdims=True)
        before = np.concatenate([part[:, :1], part[:, :-1]], axis=1)
        power = np.abs(np.fft.rfft((part - s.preemphasis * before) * window, s.fft)) ** 2
        out[a : a + chunk] = np.log(np.maximum(power @ bank, s.floor))
    if s.normalize:
        out = (out - out.mean(axis=0)) / np.sqrt(out.var(axis=0) + s.epsilon)
    whole = len(out) // s.stack
    return out[: whole * s.stack].reshape(whole, -1).astype(np.float32)


def mel_features(samples: Column, settings: MelSettings = MelSettings()) -> Column:
    """Features of each waveform (array of floats) as an array of rows; a null waveform has none."""

    @F.pandas_udf("array<array<float>>")
    def features(waves: pd.Series) -> pd.Series:
        return waves.map(lambda w: list(log_mel(w, settings)) if w is not None else [])

    return features(samples)
