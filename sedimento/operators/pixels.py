"""Image operators on pixel arrays: quality findings, repairs, augmentations, and how they run over a table of files.

Kernels are re-derived in NumPy; bit-for-bit equality with other imaging libraries is not claimed. Every augmentation
takes (image, generator, **parameters) and is pure: the generator of an output is seeded by its source and number.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sedimento.operators.generate import round_robin
from sedimento.sources.codec import read_image, write_png

Gen = np.random.Generator


def gray(x: np.ndarray) -> np.ndarray:
    f = x.astype(np.float64)
    return f[..., 0] if f.shape[2] == 1 else f @ np.array([0.299, 0.587, 0.114])


def to_bytes(x: np.ndarray) -> np.ndarray:
    return np.rint(x).clip(0, 255).astype(np.uint8)


def convolve(x: np.ndarray, k: np.ndarray, mode: str = "reflect") -> np.ndarray:
    """2-d correlation of each channel with a small odd kernel."""
    py, px = k.shape[0] // 2, k.shape[1] // 2
    p = np.pad(x.astype(np.float64), ((py, py), (px, px)) + ((0, 0),) * (x.ndim - 2), mode=mode)
    return sum(k[i, j] * p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(k.shape[0]) for j in range(k.shape[1]))


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    if sigma <= 0:
        return x.astype(np.float64)
    r = max(1, int(3 * sigma + 0.5))
    r = min(r, x.shape[0] - 1 or 1, x.shape[1] - 1 or 1)
    g = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma**2))
    g /= g.sum()
    return convolve(convolve(x, g[:, None], "symmetric"), g[None, :], "symmetric")


def sample_at(x: np.ndarray, ys: np.ndarray, xs: np.ndarray, border: float | None = 0.0) -> np.ndarray:
    """Bilinear values at real places; outside is a constant, or the mirrored image if border is None."""
    h, w = x.shape[:2]
    if border is None:
        mirror = lambda v, n: np.abs((v + n - 1) % max(2 * (n - 1), 1) - (n - 1)) if n > 1 else v * 0
        ys, xs = mirror(ys, h), mirror(xs, w)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    fy, fx = (ys - y0)[..., None], (xs - x0)[..., None]
    p = np.pad(x.astype(np.float64), ((1, 1), (1, 1), (0, 0)), constant_values=border or 0.0, mode="constant") if border is not None else np.pad(x.astype(np.float64), ((1, 1), (1, 1), (0, 0)), mode="edge")
    at = lambda y, z: p[np.clip(y + 1, 0, h + 1), np.clip(z + 1, 0, w + 1)]
    return (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1))


# ---- quality ---------------------------------------------------------------------------------------------------------

LAPLACE = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float)


def sharpness(x: np.ndarray) -> float:
    return float(convolve(gray(x), LAPLACE).var()) if min(x.shape[:2]) > 1 else 0.0


def median3(x: np.ndarray) -> np.ndarray:
    p = np.pad(x, ((1, 1), (1, 1)) + ((0, 0),) * (x.ndim - 2), mode="edge")
    return np.median([p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(3) for j in range(3)], axis=0)


def noise(x: np.ndarray) -> float:
    g = gray(x)
    return float(np.abs(g - median3(g)).mean())


def contrast(x: np.ndarray) -> float:
    g = gray(x)
    low, high = float(g.min()), float(g.max())
    return (high - low) / (high + low) if high + low else 0.0


def difference_hash(x: np.ndarray, size: int = 8) -> int:
    """size x size bits: a pixel of the shrunk image is brighter than its right neighbour.

    The image shrinks to size + 1 columns by nearest places from end to end, halves to even, of its rounded gray values.
    """
    size = int(np.clip(size, 4, 16))
    g = np.rint(gray(x))
    at = lambda n, m: np.rint(np.arange(m) * (n - 1) / (m - 1)).astype(int)
    s = g[at(g.shape[0], size)][:, at(g.shape[1], size + 1)]
    return int("".join("1" if b else "0" for b in (s[:, :-1] > s[:, 1:]).ravel()), 2)


def average_hash(x: np.ndarray) -> int:
    g = gray(x)
    rows = [np.array_split(r, 8, axis=1) for r in np.array_split(g, 8, axis=0)]
    s = np.array([[c.mean() if c.size else 0.0 for c in r] for r in rows])
    return int("".join("1" if b else "0" for b in (s > s.mean()).ravel()), 2)


def findings(x: np.ndarray | None, blur_below: float = 100.0, noise_above: float = 12.0, contrast_below: float = 0.3) -> list[tuple[str, str, float]]:
    """(issue, action, confidence) of one image."""
    if x is None:
        return [("invalid_image", "delete", 1.0)]
    clamp = lambda v: round(min(1.0, max(0.0, v)), 4)
    out, s, n, c = [], sharpness(x), noise(x), contrast(x)
    if s < blur_below:
        out.append(("image_blur", "repair", clamp(1 - s / max(blur_below, 1))))
    if n > noise_above:
        out.append(("image_noise", "repair", clamp((n - noise_above) / max(2 * noise_above, 1))))
    if c < contrast_below:
        out.append(("low_contrast", "repair", clamp(1 - c / contrast_below)))
    return out


def deblur(x: np.ndarray) -> np.ndarray:
    return to_bytes(1.6 * x.astype(float) - 0.6 * gaussian(x, 3.0))


def denoise(x: np.ndarray, strength: float = 10.0) -> np.ndarray:
    """A bilateral mean over 5 x 5 (in place of non-local means, which this approximates)."""
    f, h = x.astype(float), float(np.clip(strength, 3, 30))
    p = np.pad(f, ((2, 2), (2, 2), (0, 0)), mode="edge")
    total, weight = np.zeros_like(f), np.zeros(f.shape[:2] + (1,))
    for i in range(5):
        for j in range(5):
            q = p[i : i + f.shape[0], j : j + f.shape[1]]
            w = np.exp(-((q - f) ** 2).mean(2, keepdims=True) / (2 * h * h))
            total, weight = total + w * q, weight + w
    return to_bytes(total / weight)


def high_pass(x: np.ndarray) -> np.ndarray:
    """Sharpened by a 3 x 3 high-pass kernel with nine in the middle, then denoised."""
    return denoise(to_bytes(convolve(x, np.array([[-1, -1, -1], [-1, 9, -1], [-1, -1, -1]], float))))


# ---- augmentations ---------------------------------------------------------------------------------------------------


def geometric(x: np.ndarray, g: Gen, rotation_degrees: float = 0, scale: float = 1, translate_x_pct: float = 0, translate_y_pct: float = 0, flip_horizontal: bool = False, flip_vertical: bool = False, border_value: float = 0) -> np.ndarray:
    h, w = x.shape[:2]
    a = np.deg2rad(rotation_degrees)
    ys, xs = np.mgrid[0:h, 0:w].astype(float)
    ys, xs = ys - h / 2 - translate_y_pct * h / 100, xs - w / 2 - translate_x_pct * w / 100
    k = 1 / max(scale, 1e-6)
    out = sample_at(x, k * (np.sin(a) * xs + np.cos(a) * ys) + h / 2, k * (np.cos(a) * xs - np.sin(a) * ys) + w / 2, border_value)
    out = out[:, ::-1] if flip_horizontal else out
    return to_bytes(out[::-1] if flip_vertical else out)


def edges(x: np.ndarray, low: float = 100, high: float = 200) -> np.ndarray:
    """0/255 edge map: Sobel gradients, thinned along their direction, weak ones only beside strong ones."""
    s = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)
    gx, gy = convolve(gray(x), s), convolve(gray(x), s.T)
    m = np.abs(gx) + np.abs(gy)
    d = (np.rint(np.arctan2(gy, gx) / (np.pi / 4)).astype(int)) % 4
    p = np.pad(m, 1)
    shift = {0: (0, 1), 1: (1, 1), 2: (1, 0), 3: (1, -1)}
    keep = np.zeros_like(m, bool)
    for k, (dy, dx) in shift.items():
        a, b = p[1 + dy : 1 + dy + m.shape[0], 1 + dx : 1 + dx + m.shape[1]], p[1 - dy : 1 - dy + m.shape[0], 1 - dx : 1 - dx + m.shape[1]]
        keep |= (d == k) & (m >= a) & (m >= b)
    strong, weak = keep & (m > high), keep & (m > low)
    while True:
        q = np.pad(strong, 1)
        grown = weak & np.any([q[i : i + m.shape[0], j : j + m.shape[1]] for i in range(3) for j in range(3)], axis=0)
        if (grown == strong).all():
            return strong.astype(np.uint8) * 255
        strong = grown | strong


def style_transfer(x: np.ndarray, g: Gen, strength: float = 0.7) -> np.ndarray:
    return to_bytes((1 - strength) * x.astype(float) + strength * edges(x)[..., None])


def turned_hue(f: np.ndarray, degrees: float, saturation: float) -> np.ndarray:
    """Colours (0..255) with hue moved and saturation scaled in the HSV hexcone; values stay."""
    v, low = f.max(2), f.min(2)
    c = v - low
    safe = np.where(c > 0, c, 1)
    r, g, b = (f[..., k] for k in range(3))
    h = np.select([c == 0, v == r, v == g], [0.0, (g - b) / safe % 6, (b - r) / safe + 2], (r - g) / safe + 4)
    s = np.clip(np.where(v > 0, c / np.where(v > 0, v, 1), 0) * saturation, 0, 1)
    h = (h + degrees / 60) % 6
    k = (np.array([5, 3, 1]) + h[..., None]) % 6
    return v[..., None] * (1 - s[..., None] * np.clip(np.minimum(k, 4 - k), 0, 1))


def color_space(x: np.ndarray, g: Gen, brightness: float = 0, contrast: float = 1, saturation: float = 1, hue: float = 0, pca_jitter: float = 0) -> np.ndarray:
    """Contrast and brightness, then saturation and hue (in steps of two degrees) in HSV, then one colour shift along the
    principal axes of the pixels. Fractions are cut off."""
    f = (x.astype(float) * contrast + brightness).clip(0, 255)
    if f.shape[2] == 3:
        if saturation != 1 or hue:
            f = turned_hue(np.floor(f), 2 * hue, saturation)
        if pca_jitter:
            val, vec = np.linalg.eigh(np.cov(f.reshape(-1, 3), rowvar=False))
            f = f + pca_jitter * (vec @ (np.sqrt(np.maximum(val, 0)) * g.normal(0, 1, 3)))
    return np.floor(f.clip(0, 255) + 1e-9).astype(np.uint8)


def clarity(x: np.ndarray, g: Gen, blur_strength: float = 0, blur_kernel: int = 5, sharpen_strength: float = 0, sharpen_amount: float = 0.5) -> np.ndarray:
    f = x.astype(float)
    if blur_strength > 0:
        k = min(int(blur_kernel + 10 * blur_strength), 31) | 1
        f = gaussian(f, 0.3 * ((k - 1) * 0.5 - 1) + 0.8)
    if sharpen_strength > 0:
        f = f + sharpen_amount * sharpen_strength * (f - gaussian(f, 1.0))
    return to_bytes(f)


def occlusion(x: np.ndarray, g: Gen, occlusion_type: str = "random_erasing", erase_count: int = 1, area_ratio: float = 0.2, fill_mode: str = "mean", grid_size: int = 32) -> np.ndarray:
    out, (h, w) = x.copy(), x.shape[:2]
    fill = lambda y, z: {"zero": 0, "random": g.integers(0, 256, (y, z, x.shape[2]))}.get(fill_mode, x.mean((0, 1)))
    if occlusion_type == "gridmask":
        ys, xs = np.mgrid[0:h, 0:w]
        hole = ((ys % grid_size) < grid_size * np.sqrt(area_ratio)) & ((xs % grid_size) < grid_size * np.sqrt(area_ratio))
        out[hole] = np.rint(fill(1, 1)).astype(np.uint8).reshape(-1, x.shape[2])[0]
        return out
    for _ in range(max(1, int(erase_count))):
        ratio = 1.0 if occlusion_type == "cutout" else float(np.exp(g.uniform(np.log(0.3), np.log(3.0))))
        eh, ew = int(np.clip(np.sqrt(area_ratio * h * w * ratio), 1, h)), int(np.clip(np.sqrt(area_ratio * h * w / ratio), 1, w))
        y, z = int(g.integers(0, h - eh + 1)), int(g.integers(0, w - ew + 1))
        out[y : y + eh, z : z + ew] = to_bytes(np.asarray(fill(eh, ew), float))
    return out


def environment(x: np.ndarray, g: Gen, fog_intensity: float = 0, snow_intensity: float = 0, shadow_intensity: float = 0) -> np.ndarray:
    f, (h, w) = x.astype(float), x.shape[:2]
    if fog_intensity > 0:
        t = np.exp(-2 * fog_intensity * np.linspace(1, 0, h))[:, None, None]
        f = f * t + 200 * (1 - t)
    if snow_intensity > 0:
        f[g.random((h, w)) < 0.02 * snow_intensity] = 255
    if shadow_intensity > 0:
        ys, xs = np.mgrid[0:h, 0:w]
        inside = ((ys - g.uniform(0, h)) / (h / 3)) ** 2 + ((xs - g.uniform(0, w)) / (w / 3)) ** 2 < 1
        f[inside] *= 1 - shadow_intensity
    return to_bytes(f)


def deformation(x: np.ndarray, g: Gen, elastic_strength: float = 0, elastic_gaussian_kernel: float = 10, distortion_k1: float = 0, distortion_k2: float = 0) -> np.ndarray:
    h, w = x.shape[:2]
    ys, xs = np.mgrid[0:h, 0:w].astype(float)
    if elastic_strength > 0:
        ys = ys + gaussian(g.uniform(-1, 1, (h, w)), elastic_gaussian_kernel) * elastic_strength
        xs = xs + gaussian(g.uniform(-1, 1, (h, w)), elastic_gaussian_kernel) * elastic_strength
    v, u = (ys - h / 2) / (h / 2), (xs - w / 2) / (w / 2)
    r = u * u + v * v
    k = 1 + distortion_k1 * r + distortion_k2 * r * r
    return to_bytes(sample_at(x, v * k * h / 2 + h / 2, u * k * w / 2 + w / 2, None))


def imaging(x: np.ndarray, g: Gen, shot_noise: float = 0, read_noise: float = 0, blur_kernel: int = 0, downsample: float = 1) -> np.ndarray:
    f = gaussian(x, blur_kernel / 3) if blur_kernel > 1 else x.astype(float)
    if downsample > 1:
        k = int(downsample)
        f = np.repeat(np.repeat(f[::k, ::k], k, 0), k, 1)[: x.shape[0], : x.shape[1]]
    f = f + g.normal(0, 1, f.shape) * np.sqrt(np.maximum(f, 0)) * shot_noise + g.normal(0, 1, f.shape) * read_noise
    return to_bytes(f)


def channel_shuffle(x: np.ndarray, g: Gen, shuffle: bool = True) -> np.ndarray:
    return x[..., g.permutation(x.shape[2])] if shuffle else x


def cross_modal(x: np.ndarray, g: Gen, clahe_clip: float = 2, ir_weight: float = 0.5) -> np.ndarray:
    """A contrast-limited equalised brightness, tile by tile and stretched to the whole range, mixed into the HSV value."""
    v = gray(x)
    tiles = np.zeros_like(v)
    for ys in np.array_split(np.arange(v.shape[0]), min(8, v.shape[0])):
        for xs in np.array_split(np.arange(v.shape[1]), min(8, v.shape[1])):
            t = v[np.ix_(ys, xs)]
            hist = np.bincount(to_bytes(t).ravel(), minlength=256).astype(float)
            top = max(0.1, clahe_clip) * t.size / 256
            hist = np.minimum(hist, top) + np.maximum(hist - top, 0).sum() / 256
            tiles[np.ix_(ys, xs)] = (hist.cumsum() / hist.sum() * 255)[to_bytes(t)]
    low, high = tiles.min(), tiles.max()
    infrared = (tiles - low) / (high - low) * 255 if high - low > 1e-6 else np.zeros_like(tiles)
    f = x.astype(float)
    value = f.max(2)
    new = (1 - ir_weight) * value + ir_weight * infrared
    # With hue and saturation kept, a new value scales all channels; black has neither.
    out = np.where(value[..., None] > 0, f * (new / np.where(value > 0, value, 1))[..., None], new[..., None])
    return np.floor(out.clip(0, 255) + 1e-9).astype(np.uint8)


def generator_fallback(x: np.ndarray, g: Gen) -> np.ndarray:
    """What the adversarial generator does without enough images: a flip and a blur."""
    return to_bytes(gaussian(x[:, ::-1], 1.0))


def diffusion_fallback(x: np.ndarray, g: Gen, diffusion_steps: int = 1000) -> np.ndarray:
    """Forward noise of a tenth of the steps on the schedule 1e-4 .. 0.02."""
    keep = np.prod(1 - np.linspace(1e-4, 0.02, 200)[: max(1, min(200, diffusion_steps // 10))])
    return to_bytes((x / 127.5 - 1) * np.sqrt(keep) * 127.5 + 127.5 + g.normal(0, 127.5 * np.sqrt(1 - keep) * 0.1, x.shape))


def masked_fallback(x: np.ndarray, g: Gen, patch_size: int = 4) -> np.ndarray:
    """Eight swaps of patches, then a light blur."""
    if patch_size < 1 or patch_size > min(x.shape[:2]):
        raise ValueError("INVALID_PATCH_SIZE")
    out, p = x.copy(), int(patch_size)
    for _ in range(8):
        (a, b), (c, d) = [(int(g.integers(0, x.shape[0] - p + 1)), int(g.integers(0, x.shape[1] - p + 1))) for _ in range(2)]
        one, two = out[a : a + p, b : b + p].copy(), out[c : c + p, d : d + p].copy()
        out[a : a + p, b : b + p], out[c : c + p, d : d + p] = two, one
    return to_bytes(gaussian(out, 0.5))


AUGMENTATIONS: dict[str, Callable[..., np.ndarray]] = {
    "geometric": geometric, "style_transfer": style_transfer, "color_space": color_space, "clarity": clarity, "occlusion": occlusion, "environment_simulation": environment, "deformation_distortion": deformation,
    "imaging_simulation": imaging, "channel_shuffle": channel_shuffle, "cross_modal_fusion": cross_modal, "wgan_gp_fallback": generator_fallback, "diffusion_fallback": diffusion_fallback, "vit_mae_fallback": masked_fallback,
}
REPAIRS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"deblur": deblur, "denoise": denoise, "high_pass": high_pass}


# ---- over tables of files (id, content) ------------------------------------------------------------------------------


def image_findings(files: DataFrame, **limits: float) -> DataFrame:
    """sample_id, issue_type, suggested_action, confidence; files that cannot be decoded are findings, null contents too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *f) for i, c in zip(b["id"], b["content"], strict=True) for f in findings(read_image(c), **limits)]
            yield pd.DataFrame(rows, columns=["sample_id", "issue_type", "suggested_action", "confidence"])

    return files.select("id", "content").mapInPandas(run, "sample_id long, issue_type string, suggested_action string, confidence double")


def image_hashes(files: DataFrame, size: int = 8) -> DataFrame:
    """id, dhash (hexadecimal), ahash of the images that decode."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, f"{difference_hash(x, size):0{-(-size * size // 4)}x}", f"{average_hash(x):016x}") for i, c in zip(b["id"], b["content"], strict=True) if (x := read_image(c)) is not None]
            yield pd.DataFrame(rows, columns=["id", "dhash", "ahash"])

    return files.select("id", "content").mapInPandas(run, "id long, dhash string, ahash string")


def repair_images(files: DataFrame, repair: str) -> DataFrame:
    """id, content (PNG) of every image that decodes."""
    op = REPAIRS[repair]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, write_png(op(x))) for i, c in zip(b["id"], b["content"], strict=True) if (x := read_image(c)) is not None]
            yield pd.DataFrame(rows, columns=["id", "content"])

    return files.select("id", "content").mapInPandas(run, "id long, content binary")


def augment_images(files: DataFrame, target: int, operator: str, seed: int = 0, **params: object) -> DataFrame:
    """i, source_sample_id, content (PNG) of `target` outputs; undecodable sources give none of theirs."""
    op = AUGMENTATIONS[operator]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, i, write_png(op(x, np.random.default_rng(zlib.crc32(f"{seed}/{i}/{n}".encode())), **params))) for n, i, c in zip(b["i"], b["id"], b["content"], strict=True) if (x := read_image(c)) is not None]
            yield pd.DataFrame(rows, columns=["i", "source_sample_id", "content"])

    return round_robin(files.select("id", "content"), target).select("i", "id", "content").mapInPandas(run, "i long, source_sample_id long, content binary")


def pixel_rows(files: DataFrame) -> DataFrame:
    """id, y, x, channel, value of every pixel of the images (id, content) that decode."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, c in zip(b["id"], b["content"], strict=True):
                if (p := read_image(c)) is not None:
                    y, x, k = np.indices(p.shape).reshape(3, -1)
                    yield pd.DataFrame({"id": np.full(p.size, i), "y": y, "x": x, "channel": k, "value": p.ravel()})

    return files.select("id", "content").mapInPandas(run, "id long, y int, x int, channel int, value int")


def image_shapes(files: DataFrame, key: str = "id") -> DataFrame:
    """key, width, height, channels of images (key, content); null where they don't decode."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shapes = [(None, None, None) if (p := read_image(c)) is None else (p.shape[1], p.shape[0], p.shape[2]) for c in b["content"]]
            out = pd.DataFrame(shapes, columns=["width", "height", "channels"]).astype("Int32")
            out.insert(0, key, b[key].to_numpy())
            yield out

    return files.select(key, "content").mapInPandas(run, f"{key} long, width int, height int, channels int")
