"""Sound operators on arrays of shape (channels, frames): quality findings, repairs, augmentations, runs over files.

Short-time spectra, filters and stretchers are re-derived in NumPy. Augmentations take (sound, rate, generator,
**parameters) and return a sound of the same rate.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sedimento.operators.generate import round_robin
from sedimento.sources.codec import read_wav, write_wav

Gen = np.random.Generator
N_FFT, HOP = 1024, 256


def spectrum(y: np.ndarray, n: int = N_FFT, hop: int = HOP) -> np.ndarray:
    """bins x frames of one channel."""
    w = np.hanning(n + 1)[:-1]
    p = np.pad(y, (n // 2, n // 2 + hop), mode="constant")
    at = np.arange(0, len(p) - n + 1, hop)
    return np.fft.rfft(p[at[:, None] + np.arange(n)] * w, axis=1).T


def waveform(s: np.ndarray, length: int, n: int = N_FFT, hop: int = HOP) -> np.ndarray:
    w = np.hanning(n + 1)[:-1]
    out, norm = np.zeros(hop * (s.shape[1] - 1) + n), np.zeros(hop * (s.shape[1] - 1) + n)
    for k, f in enumerate(np.fft.irfft(s.T, n, axis=1)):
        out[k * hop : k * hop + n] += f * w
        norm[k * hop : k * hop + n] += w * w
    y = (out / np.maximum(norm, 1e-8))[n // 2 :]
    return np.pad(y, (0, max(0, length - len(y))))[:length]


def _each(y: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    return np.stack([f(c) for c in y])


def fit_length(y: np.ndarray, n: int) -> np.ndarray:
    return np.pad(y, ((0, 0), (0, max(0, n - y.shape[1]))))[:, :n]


# ---- quality ---------------------------------------------------------------------------------------------------------


def snr(y: np.ndarray) -> float:
    floor = np.percentile(np.abs(y), 10)
    return float(20 * np.log10(max(np.sqrt((y**2).mean()), 1e-12) / max(floor, 1e-12)))


def voiced(y: np.ndarray, top_db: float = 30, frame: int = 2048, hop: int = 512) -> np.ndarray:
    """A mask of frames (samples) no more than top_db below the loudest."""
    mono = y.mean(0)
    p = np.pad(mono, frame // 2)
    at = np.arange(0, max(1, len(p) - frame + 1), hop)
    rms = np.sqrt(np.array([(p[a : a + frame] ** 2).mean() for a in at]))
    loud = 20 * np.log10(np.maximum(rms, 1e-10)) > 20 * np.log10(max(rms.max(), 1e-10)) - top_db
    return np.repeat(loud, hop)[: len(mono)] if len(loud) * hop >= len(mono) else np.pad(np.repeat(loud, hop), (0, len(mono) - len(loud) * hop), mode="edge")


def findings(y: np.ndarray | None, snr_threshold: float = 18, target_peak: float = 0.95, top_db: float = 30, silence_ratio_threshold: float = 0.2) -> list[tuple[str, str, float]]:
    if y is None or not y.size:
        return [("invalid_audio", "delete", 1.0)]
    clamp = lambda v: round(min(1.0, max(0.0, v)), 4)
    out, s, peak = [], snr(y), float(np.abs(y).max())
    if s < snr_threshold:
        out.append(("audio_noise", "repair", clamp(1 - s / snr_threshold)))
    if not 0.5 <= peak <= 0.99:
        out.append(("audio_level", "repair", clamp(abs(peak - target_peak) / target_peak)))
    silent = 1 - voiced(y, top_db).mean()
    if silent > silence_ratio_threshold:
        out.append(("audio_silence", "repair", clamp(silent)))
    return out


def denoise(y: np.ndarray, rate: int, noise_reduce_strength: float = 1) -> np.ndarray:
    def gate(c: np.ndarray) -> np.ndarray:
        s = spectrum(c)
        m = np.abs(s)
        return waveform(s * (np.maximum(m - noise_reduce_strength * np.percentile(m, 20, axis=1, keepdims=True), 0) / np.maximum(m, 1e-12)), len(c))

    return _each(y, gate)


def normalize(y: np.ndarray, rate: int, target_peak: float = 0.95) -> np.ndarray:
    peak = np.abs(y).max(initial=0.0)
    return y / peak * target_peak if peak else y


def trim_silence(y: np.ndarray, rate: int, top_db: float = 30) -> np.ndarray:
    keep = voiced(y, top_db)
    return y[:, keep] if keep.any() else y


# ---- augmentations ---------------------------------------------------------------------------------------------------


def colored(g: Gen, n: int, kind: str) -> np.ndarray:
    w = g.normal(0, 1, n) if kind != "uniform" else g.uniform(-1, 1, n)
    if kind == "pink":
        w = np.cumsum(w) / np.sqrt(max(n, 1))
    elif kind == "brown":
        w = np.cumsum(w)
        w -= w.mean()
    return w / max(np.abs(w).max(initial=0.0), 1e-12)


def noise_injection(y: np.ndarray, rate: int, g: Gen, noise_type: str = "white", noise_intensity: float = 0.1) -> np.ndarray:
    return y + np.stack([colored(g, y.shape[1], noise_type) for _ in y]) * noise_intensity


def spectrum_reconstruction(y: np.ndarray, rate: int, g: Gen, low: float = 0, high: float = 4000) -> np.ndarray:
    f = np.fft.rfftfreq(N_FFT, 1 / rate)
    return _each(y, lambda c: waveform(spectrum(c) * ((f >= low) & (f <= high))[:, None], len(c)))


def stretch(c: np.ndarray, rate: float) -> np.ndarray:
    """Phase vocoder: rate above 1 is faster."""
    s = spectrum(c)
    at = np.arange(0, s.shape[1], rate)
    advance = np.linspace(0, np.pi * HOP, s.shape[0])
    phase, out = np.angle(s[:, 0]), np.zeros((s.shape[0], len(at)), complex)
    p = np.pad(s, ((0, 0), (0, 2)))
    for k, t in enumerate(at):
        i, f = int(t), t - int(t)
        a, b = p[:, i], p[:, i + 1]
        out[:, k] = ((1 - f) * np.abs(a) + f * np.abs(b)) * np.exp(1j * phase)
        d = np.angle(b) - np.angle(a) - advance
        phase = phase + advance + d - 2 * np.pi * np.rint(d / (2 * np.pi))
    return waveform(out, int(round(len(c) / rate)))


def tempo_pitch(y: np.ndarray, rate: int, g: Gen, time_stretch: float = 1, n_steps: float = 0) -> np.ndarray:
    n = y.shape[1]
    if time_stretch != 1:
        y = _each(y, lambda c: stretch(c, time_stretch))
    if n_steps:
        k = 2 ** (n_steps / 12)
        y = _each(y, lambda c: np.interp(np.arange(0, len(c)) * 1.0, np.arange(len(s := stretch(c, 1 / k))) / k, s))
    return fit_length(y, n)


def energy(y: np.ndarray, rate: int, g: Gen, volume_scale: float = 1, mute_probability: float = 0.5, mute_count: int = 1, min_sec: float = 0.05, max_sec: float = 0.2) -> np.ndarray:
    out = y * volume_scale
    if g.random() < mute_probability:
        for _ in range(int(mute_count)):
            k = min(int(g.uniform(min_sec, max_sec) * rate), out.shape[1])
            a = int(g.integers(0, out.shape[1] - k + 1))
            out[:, a : a + k] = 0
    return out


def timeseries(y: np.ndarray, rate: int, g: Gen, operation: str = "mix", shift_sec: float = 0.2, crop_ratio: float = 0.9, concat_segments: int = 2, reverse_probability: float = 0.5) -> np.ndarray:
    n = y.shape[1]

    def one(op: str, z: np.ndarray) -> np.ndarray:
        if op == "shift":
            k = int(g.uniform(-shift_sec, shift_sec) * rate)
            return fit_length(z[:, k:], n) if k >= 0 else fit_length(np.pad(z, ((0, 0), (-k, 0))), n)
        if op == "rotate":
            return np.roll(z, int(g.uniform(-shift_sec, shift_sec) * rate), axis=1)
        if op == "crop":
            k = max(1, int(n * crop_ratio))
            a = int(g.integers(0, n - k + 1))
            return fit_length(z[:, a : a + k], n)
        if op == "concat":
            k = max(1, n // max(1, int(concat_segments)))
            starts = g.integers(0, max(1, n - k + 1), max(1, int(concat_segments)))
            return fit_length(np.concatenate([z[:, a : a + k] for a in starts], axis=1), n)
        return z[:, ::-1] if g.random() < reverse_probability else z

    ops = ("shift", "rotate", "crop", "concat", "reverse")
    for op in g.choice(ops, 2, replace=False) if operation == "mix" else [operation]:
        y = one(str(op), y)
    return y


def channel_config(y: np.ndarray, rate: int, g: Gen, target_channel: str = "auto", mix_strategy: str = "avg", dither: float = 0.002, swap_probability: float = 0.2) -> np.ndarray:
    if target_channel == "mono" or (target_channel == "auto" and len(y) > 1):
        w = g.dirichlet(np.ones(len(y))) if mix_strategy == "random_weight" else np.full(len(y), 1 / len(y))
        return (w @ y)[None]
    two = np.stack([y[0], y[-1]]) + g.normal(0, dither, (2, y.shape[1]))
    return two[::-1] if g.random() < swap_probability else two


def specaugment(y: np.ndarray, rate: int, g: Gen, freq_mask_param: int = 8, time_mask_param: int = 8) -> np.ndarray:
    """One band and one span of the spectrum are silenced; phases are kept instead of being estimated again."""

    def mask(c: np.ndarray) -> np.ndarray:
        s = spectrum(c)
        f, t = int(g.integers(0, freq_mask_param * 8 + 1)), int(g.integers(0, time_mask_param + 1))
        a, b = int(g.integers(0, max(1, s.shape[0] - f))), int(g.integers(0, max(1, s.shape[1] - t)))
        s[a : a + f], s[:, b : b + t] = 0, 0
        return waveform(s, len(c))

    return _each(y, mask)


def band_filter(y: np.ndarray, rate: int, g: Gen, filter_type: str = "bandpass", low_cutoff_hz: float = 300, high_cutoff_hz: float = 3000) -> np.ndarray:
    low, high = sorted((low_cutoff_hz, high_cutoff_hz))
    f = np.fft.rfftfreq(y.shape[1], 1 / rate)
    keep = {"lowpass": f <= high, "highpass": f >= low, "bandstop": (f < low) | (f > high)}.get(filter_type, (f >= low) & (f <= high))
    return np.fft.irfft(np.fft.rfft(y, axis=1) * keep, y.shape[1], axis=1)


def environment_noise(y: np.ndarray, rate: int, g: Gen, noise_type: str = "white", target_snr: float = 10) -> np.ndarray:
    w = np.stack([colored(g, y.shape[1], noise_type) for _ in y])
    power, ratio = (y**2).mean(), 10 ** (float(np.clip(target_snr, -5, 60)) / 10)
    return y + w * np.sqrt(power / ratio / max((w**2).mean(), 1e-12))


def spatial(y: np.ndarray, rate: int, g: Gen, effect_type: str = "echo", probability: float = 0.8, count: int = 3, delay: float = 0.3, decay: float = 0.6, tau: float = 0.5) -> np.ndarray:
    if g.random() >= probability:
        return y
    n = y.shape[1]
    if effect_type == "reverb":
        k = max(1, int(delay * rate))
        ir = g.normal(0, 1, k) * np.exp(-np.arange(k) / max(tau * rate, 1))
        ir[0] = 1.0
        size = 1 << (n + k).bit_length()
        wet = np.fft.irfft(np.fft.rfft(y, size, axis=1) * np.fft.rfft(ir, size), size, axis=1)[:, :n]
        return wet / max(np.abs(wet).max(initial=0.0), 1e-12) * np.abs(y).max(initial=0.0)
    out = y.copy()
    for k in range(1, int(count) + 1):
        d = int(k * delay * rate)
        if d < n:
            out[:, d:] += y[:, : n - d] * decay**k
    return out


def quality(y: np.ndarray, rate: int, g: Gen, downsample_ratio: float = 0.8, quantize_bits: int = 8, distortion_drive: float = 0) -> np.ndarray:
    n = y.shape[1]
    k = max(1, int(n * min(1.0, downsample_ratio)))
    y = _each(y, lambda c: np.interp(np.linspace(0, k - 1, n), np.arange(k), np.interp(np.linspace(0, n - 1, k), np.arange(n), c)))
    steps = (1 << int(np.clip(quantize_bits, 1, 16))) - 1
    y = np.rint((y.clip(-1, 1) + 1) / 2 * steps) / steps * 2 - 1
    return np.tanh(y * (1 + distortion_drive)) if distortion_drive > 0 else y


AUGMENTATIONS: dict[str, Callable[..., np.ndarray]] = {
    "noise_injection": noise_injection, "spectrum_reconstruction": spectrum_reconstruction, "tempo_pitch": tempo_pitch, "energy_amplitude": energy, "timeseries_structure": timeseries, "channel_config": channel_config,
    "specaugment": specaugment, "filter_processing": band_filter, "environment_noise_injection": environment_noise, "spatial_acoustics": spatial, "quality_distortion": quality,
}


def composite(y: np.ndarray, rate: int, g: Gen, combination_count: int = 3, include_specaugment: bool = True, include_spatial: bool = True) -> np.ndarray:
    names = [n for n in AUGMENTATIONS if n not in ("channel_config", "composite") and (include_specaugment or n != "specaugment") and (include_spatial or n != "spatial_acoustics")]
    for name in g.choice(names, int(np.clip(combination_count, 2, 6)), replace=False):
        y = AUGMENTATIONS[str(name)](y, rate, g)
    return y


AUGMENTATIONS["composite"] = composite
REPAIRS: dict[str, Callable[..., np.ndarray]] = {"denoise": denoise, "normalize": normalize, "trim_silence": trim_silence}


def audio_findings(files: DataFrame, **limits: float) -> DataFrame:
    """sample_id, issue_type, suggested_action, confidence of sound files (id, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *f) for i, c in zip(b["id"], b["content"], strict=True) for f in findings((read_wav(c) or (None, 0))[0], **limits)]
            yield pd.DataFrame(rows, columns=["sample_id", "issue_type", "suggested_action", "confidence"])

    return files.select("id", "content").mapInPandas(run, "sample_id long, issue_type string, suggested_action string, confidence double")


def repair_audio(files: DataFrame, repair: str, **params: float) -> DataFrame:
    """id, content (WAV) of every sound that decodes."""
    op = REPAIRS[repair]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, write_wav(op(s[0], s[1], **params), s[1])) for i, c in zip(b["id"], b["content"], strict=True) if (s := read_wav(c))]
            yield pd.DataFrame(rows, columns=["id", "content"])

    return files.select("id", "content").mapInPandas(run, "id long, content binary")


def augment_audio(files: DataFrame, target: int, operator: str, seed: int = 0, **params: object) -> DataFrame:
    """i, source_sample_id, content (WAV) of `target` outputs; undecodable sources give none of theirs."""
    op = AUGMENTATIONS[operator]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, i, write_wav(op(s[0], s[1], np.random.default_rng(zlib.crc32(f"{seed}/{i}/{n}".encode())), **params), s[1])) for n, i, c in zip(b["i"], b["id"], b["content"], strict=True) if (s := read_wav(c))]
            yield pd.DataFrame(rows, columns=["i", "source_sample_id", "content"])

    return round_robin(files.select("id", "content"), target).select("i", "id", "content").mapInPandas(run, "i long, source_sample_id long, content binary")


def sound_rows(files: DataFrame, key: str = "id") -> DataFrame:
    """key, channel, t, value (of 16 bits) of every frame of the sounds (key, content) that decode."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, c in zip(b[key], b["content"], strict=True):
                if s := read_wav(c):
                    k, t = np.indices(s[0].shape).reshape(2, -1)
                    yield pd.DataFrame({key: np.full(s[0].size, i), "channel": k, "t": t, "value": np.rint(s[0].ravel() * 32768).astype(int)})

    return files.select(key, "content").mapInPandas(run, f"{key} long, channel int, t int, value int")


def sound_shapes(files: DataFrame, key: str = "id") -> DataFrame:
    """key, rate, channels, frames of sounds (key, content) that decode."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, s[1], *s[0].shape) for i, c in zip(b[key], b["content"], strict=True) if (s := read_wav(c))]
            yield pd.DataFrame(rows, columns=[key, "rate", "channels", "frames"])

    return files.select(key, "content").mapInPandas(run, f"{key} long, rate int, channels int, frames int")
