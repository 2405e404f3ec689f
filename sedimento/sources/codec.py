"""Pixels and waveforms from bytes and back, with NumPy and the standard library only.

Images are uint8 arrays of shape (height, width, channels), channels in RGB order; PNM (P2, P3, P5, P6) and PNG (8 bit,
not interlaced) are read, PNG is written. Sounds are float arrays of shape (channels, frames) with a rate; PCM WAV of 8,
16 and 32 bits is read, 16 bits written. Undecodable bytes give None, as do sounds without a frame.
"""

from __future__ import annotations

import io
import re
import struct
import wave
import zlib

import numpy as np

PNG_MARK = b"\x89PNG\r\n\x1a\n"


def read_pnm(data: bytes) -> np.ndarray | None:
    kind, at, head = data[:2], 2, []
    if kind not in (b"P2", b"P3", b"P5", b"P6"):
        return None
    token = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")
    while len(head) < 3:
        m = token.match(data, at)
        if not m:
            return None
        head.append(int(m[1]))
        at = m.end()
    w, h, top = head
    c = 3 if kind in (b"P3", b"P6") else 1
    if not (w and h and 0 < top < 65536):
        return None
    if kind in (b"P2", b"P3"):
        values = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: w * h * c], dtype=np.float64)
    else:
        step = 1 if top < 256 else 2
        values = np.frombuffer(data[at + 1 : at + 1 + w * h * c * step], dtype=">u1" if step == 1 else ">u2").astype(np.float64)
    if values.size != w * h * c:
        return None
    return np.rint(values * 255 / top).clip(0, 255).astype(np.uint8).reshape(h, w, c)


def read_png(data: bytes) -> np.ndarray | None:
    if data[:8] != PNG_MARK:
        return None
    at, body, size, palette = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    if size is None or size[2] != 8 or size[6]:
        return None
    w, h, _, colour = size[:4]
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    raw = np.frombuffer(zlib.decompress(body), np.uint8)
    if c is None or raw.size != h * (w * c + 1):
        return None
    raw = raw.reshape(h, w * c + 1)
    out = np.zeros((h, w * c), np.uint8)
    above = np.zeros(w * c, np.int64)
    for y in range(h):
        line, rule = raw[y, 1:].astype(np.int64), raw[y, 0]
        if rule == 2:
            line = (line + above) & 255
        elif rule in (1, 3, 4):
            for x in range(w * c):
                a, b, d = (line[x - c] if x >= c else 0), above[x], (above[x - c] if x >= c else 0)
                if rule == 4:
                    p = a + b - d
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                line[x] = (line[x] + (a if rule == 1 else (a + b) // 2 if rule == 3 else near)) & 255
        out[y], above = line, line
    pixels = out.reshape(h, w, c)
    if colour == 3:
        return palette[pixels[..., 0]] if palette is not None else None
    return pixels[..., :3] if c == 4 else pixels[..., :1] if c == 2 else pixels


def read_image(data: bytes | None) -> np.ndarray | None:
    if not data:
        return None
    try:
        return read_png(data) if data[:8] == PNG_MARK else read_pnm(data)
    except (ValueError, zlib.error, struct.error, IndexError):
        return None


def write_png(image: np.ndarray) -> bytes:
    h, w, c = image.shape
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    rows = b"".join(b"\0" + image[y].tobytes() for y in range(h))
    return PNG_MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def read_wav(data: bytes | None) -> tuple[np.ndarray, int] | None:
    if not data:
        return None
    try:
        with wave.open(io.BytesIO(data)) as f:
            width, n, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
            raw = f.readframes(f.getnframes())
    except (wave.Error, EOFError):
        return None
    if width not in (1, 2, 4) or not raw:
        return None
    x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return x.reshape(-1, n).T, rate


def write_wav(sound: np.ndarray, rate: int) -> bytes:
    """Sounds that pass full scale are scaled down to 0.999 first."""
    peak = np.abs(sound).max(initial=0.0)
    y = sound * (0.999 / peak) if peak > 1 else sound
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(y.shape[0])
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.rint(y.T * 32767).astype("<i2").tobytes())
    return out.getvalue()
