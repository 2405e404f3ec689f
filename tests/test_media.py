import math

import numpy as np
import pytest

from sedimento.operators import pixels as P
from sedimento.operators import sounds as S
from sedimento.sources import codec as C


def picture(seed=0, h=24, w=20, c=3):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c)).astype(np.uint8)


def tone(rate=8000, sec=0.5, channels=1):
    t = np.arange(int(rate * sec)) / rate
    return np.stack([0.4 * np.sin(2 * np.pi * 440 * t)] * channels), rate


def test_codecs_round_trip():
    for c in (1, 3):
        assert (C.read_image(C.write_png(picture(c=c))) == picture(c=c)).all()
    raw = b"P5\n# note\n4 3\n255\n" + bytes(range(12))
    assert C.read_image(raw).ravel().tolist() == list(range(12))
    assert C.read_image(b"P2 2 1 15 0 15").ravel().tolist() == [0, 255]
    y, rate = tone(channels=2)
    z, r = C.read_wav(C.write_wav(y, rate))
    assert r == rate and np.abs(z - y).max() < 1e-3
    assert C.read_image(b"junk") is None and C.read_image(None) is None and C.read_wav(b"RIFF") is None and C.read_image(b"P5 9 9 255\nxx") is None


def test_near_hash_flags_only_the_near_picture():
    x, y = np.mgrid[0:10, 0:10][1], np.mgrid[0:10, 0:10][0]
    base = ((x * 24 + y * 3) % 256).astype(np.uint8)[..., None]
    near = base.copy()
    near[4, 4] += 2
    bits = lambda a, b: (P.difference_hash(a) ^ P.difference_hash(b)).bit_count()
    assert bits(base, near) <= 4 < bits(base, 255 - base)


@pytest.mark.parametrize("name", sorted(P.AUGMENTATIONS))
def test_image_augmentations_keep_the_shape_and_repeat(name):
    for c in (1, 3):
        out = [P.AUGMENTATIONS[name](picture(c=c), np.random.default_rng(5)) for _ in range(2)]
        assert out[0].shape == picture(c=c).shape and out[0].dtype == np.uint8 and (out[0] == out[1]).all()


def test_image_findings_and_repairs():
    flat = np.full((16, 16, 1), 90, np.uint8)
    assert {f[0] for f in P.findings(flat)} == {"image_blur", "low_contrast"}
    assert P.findings(None) == [("invalid_image", "delete", 1.0)]
    assert "image_noise" in {f[0] for f in P.findings(picture(h=40, w=40))}
    for r in P.REPAIRS.values():
        assert r(picture()).shape == picture().shape
    assert (P.geometric(picture(), None, flip_horizontal=True) == picture()[:, ::-1]).all()


@pytest.mark.parametrize("name", sorted(S.AUGMENTATIONS))
def test_audio_augmentations_keep_the_length_and_repeat(name):
    y, rate = tone(channels=2)
    out = [S.AUGMENTATIONS[name](y, rate, np.random.default_rng(3)) for _ in range(2)]
    assert out[0].shape[1] == y.shape[1] and np.isfinite(out[0]).all() and np.array_equal(out[0], out[1])


def test_audio_findings_and_filters():
    y, rate = tone()
    assert np.abs(S.waveform(S.spectrum(y[0]), y.shape[1]) - y[0])[500:-500].max() < 1e-6
    assert np.abs(S.band_filter(y, rate, None, "highpass", 1000, 3000)).max() < 0.05
    assert "audio_level" in {f[0] for f in S.findings(y * 0.5)}
    quiet = np.concatenate([y, np.zeros_like(y)], axis=1)
    assert "audio_silence" in {f[0] for f in S.findings(quiet)}
    assert S.trim_silence(quiet, rate).shape[1] < quiet.shape[1]
    assert math.isclose(np.abs(S.normalize(y, rate)).max(), 0.95)
    assert S.findings(None) == [("invalid_audio", "delete", 1.0)]


def test_over_tables(spark):
    files = spark.createDataFrame([(1, bytearray(C.write_png(picture()))), (2, bytearray(b"bad")), (3, None)], "id long, content binary")
    assert {(r.sample_id, r.issue_type) for r in P.image_findings(files).collect()} >= {(2, "invalid_image"), (3, "invalid_image")}
    made = P.augment_images(files, 7, "geometric", rotation_degrees=10).collect()
    assert {(r.i, r.source_sample_id) for r in made} == {(0, 1), (3, 1), (6, 1)}
    y, rate = tone()
    sounds = spark.createDataFrame([(1, bytearray(C.write_wav(y, rate))), (2, bytearray(b""))], "id long, content binary")
    assert S.augment_audio(sounds, 3, "energy_amplitude").count() == 2 and S.repair_audio(sounds, "normalize").count() == 1
    assert "invalid_audio" in {r.issue_type for r in S.audio_findings(sounds).collect()}
