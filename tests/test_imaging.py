import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.functions import imaging
from sievewright.operators import feature_stats, spectrum


def plain_components(mask, diagonal):
    h, w = mask.shape
    out, n = np.zeros((h, w), int), 0
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    for y in range(h):
        for x in range(w):
            if mask[y, x] and not out[y, x]:
                n += 1
                todo = [(y, x)]
                out[y, x] = n
                while todo:
                    i, j = todo.pop()
                    for a, b in steps:
                        if 0 <= i + a < h and 0 <= j + b < w and mask[i + a, j + b] and not out[i + a, j + b]:
                            out[i + a, j + b] = n
                            todo.append((i + a, j + b))
    return out


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 14), st.integers(1, 14), st.floats(0.1, 0.9), st.integers(0, 2**31), st.booleans())
def test_components_equal_a_search(h, w, share, seed, diagonal):
    mask = np.random.default_rng(seed).random((h, w)) < share
    assert (imaging.components(mask, diagonal) == plain_components(mask, diagonal)).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(3, 12), st.integers(1, 4), st.integers(0, 2**31))
def test_closing_by_the_diamond(side, steps, seed):
    mask = np.random.default_rng(seed).random((side, side)) < 0.3
    ball = [(a, b) for a in range(-steps, steps + 1) for b in range(-steps, steps + 1) if abs(a) + abs(b) <= steps]
    inside = lambda y, x: 0 <= y < side and 0 <= x < side
    grown = np.array([[any(inside(y + a, x + b) and mask[y + a, x + b] for a, b in ball) for x in range(side)] for y in range(side)])
    want = np.array([[all(inside(y + a, x + b) and grown[y + a, x + b] for a, b in ball) for x in range(side)] for y in range(side)])
    assert (imaging.closing(mask, steps) == want).all()


def test_otsu_parts_two_levels():
    image = np.r_[np.full(300, 20.0), np.full(100, 200.0)].reshape(20, 20)
    assert 20 <= imaging.otsu(image) < 200 and imaging.otsu(np.full((3, 3), 7.0)) == 7
    rng = np.random.default_rng(0)
    x = np.clip(np.r_[rng.normal(60, 12, 3000), rng.normal(170, 15, 1500)], 0, 255).reshape(50, 90)
    between = lambda t: (x <= t).mean() * (x > t).mean() * (x[x <= t].mean() - x[x > t].mean()) ** 2
    assert between(imaging.otsu(x)) > 0.999 * max(between(t) for t in np.arange(40, 200, 0.5))


def disc(side, radius, level=180, hole=0):
    y, x = np.mgrid[:side, :side] - side // 2
    image = np.where(x * x + y * y <= radius * radius, level, 0)
    return np.where(x * x + y * y <= hole * hole, 0, image).astype(np.uint8) if hole else image.astype(np.uint8)


def test_known_masks_and_the_cascade():
    image = disc(96, 36, hole=10)
    mask, which = imaging.object_mask(image.astype(np.float32))
    y, x = np.mgrid[:96, :96] - 48
    assert which == 1 and abs(mask.mean() - (x * x + y * y <= 36 * 36).mean()) < 0.01 and mask[48, 48]  # the hole is filled
    image[2:6, 2:6] = 180
    assert not imaging.object_mask(image.astype(np.float32))[0][:8, :8].any()  # the smaller object is left out
    tiny, which = imaging.object_mask(disc(96, 3).astype(np.float32))
    assert which > 0 and not tiny.any()  # below the least size in every attempt: the nearest to a half, though empty
    none, which = imaging.object_mask(np.zeros((40, 40), np.float32))
    assert which == 0 and none.all()  # no attempt finds an object: all ones
    wide = np.where(np.arange(96)[None, :] < 3, 5, 180) * np.ones((96, 1))
    assert imaging.object_mask(wide.astype(np.float32))[1] > 0


def test_a_later_attempt_is_taken_when_the_first_covers_too_much():
    y, x = np.mgrid[:320, :320] - 160
    image = np.where(x * x + y * y <= 90 * 90, 250, 90).astype(np.float32)
    share = [imaging.attempt(image, f, s).mean() for f, s in imaging.ATTEMPTS]
    which = imaging.object_mask(image)[1]
    assert which == next(i for i, s in enumerate(share, 1) if 0.15 <= s <= 0.85) > 1


def test_levels_frame_and_chain():
    image = disc(160, 40, 200)
    image[image == 200] = (120 + np.arange((image == 200).sum()) % 100).astype(np.uint8)
    out, which, share = imaging.normalised(image, 64)
    assert out.shape == (64, 64) and which == 1 and 0.15 < share < 0.25 and (out[out > 0] >= 5).all()
    rows = np.flatnonzero(out.any(axis=1))
    assert rows[0] <= 6 and rows[-1] >= 57 and out[0, 0] == 0  # the object fills the frame but for the margin
    mask = np.zeros((4, 4), bool)
    assert imaging.rescaled(np.arange(16, dtype=np.uint8).reshape(4, 4), mask).max() == 254
    mask[:2] = True
    level = imaging.rescaled(np.arange(16, dtype=np.uint8).reshape(4, 4), mask)
    low, high = np.percentile(np.arange(8), [1, 99])
    assert level[1, 0] == int((4 - low) / (high - low + 1e-8) * 255) and (level[2:] == 254).all()
    assert (imaging.framed(image, np.zeros_like(image, bool), 32)[1] == 0).all()
    assert (imaging.gray(np.full((2, 2, 3), 90, np.uint8)) == 90).all()


def test_blur_and_sharpening():
    flat = np.full((9, 9), 50, np.uint8)
    assert np.allclose(imaging.blurred(flat, 1.7), 50) and (imaging.sharpened(flat, 1.7, 150, 2) == 50).all()
    edge = np.tile(np.r_[np.full(10, 60), np.full(10, 180)].astype(np.uint8), (6, 1))
    sharp = imaging.sharpened(edge, 2.0, 150, 3)
    assert sharp[3, 9] < 60 and sharp[3, 10] > 180 and sharp[3, 0] == 60
    point = np.zeros((41, 41))
    point[20, 20] = 1
    spread = imaging.blurred(point, 2.5)
    assert spread.sum() == pytest.approx(1) and (spread * (np.arange(41) - 20) ** 2).sum() == pytest.approx(2.5**2, rel=0.02)


@pytest.mark.parametrize("piece", [5, 256])
def test_spectrum_of_four_images(spark, monkeypatch, piece):
    monkeypatch.setattr(spectrum, "PIECE", piece)
    x = np.random.default_rng(1).integers(0, 256, (4, 6, 6))
    df = spark.createDataFrame([(i, v.ravel().tolist()) for i, v in enumerate(x)], "id int, px array<int>").repartition(3)
    got = spectrum.power(df, "px", 6, 3).collect()
    w = np.kaiser(6, 8)
    w = np.outer(w, w) / (w * w).sum()
    want = np.zeros((18, 18))
    for image in x:
        y = (image - x.mean()) / x.std() * w
        for v in range(18):
            for u in range(18):
                r, c = np.mgrid[:6, :6]
                want[v, u] += abs((y * np.exp(-2j * np.pi * (v * r + u * c) / 18)).sum()) ** 2 / 4
    assert len(got) == 324 and all(r.power == pytest.approx(want[r.v, r.u]) for r in got)
    cut = spectrum.slices(spectrum.power(df, "px", 6, 3), 6).collect()
    assert sorted((r.angle, r.step) for r in cut) == [(a, k) for a in (0, 45) for k in range(10)]
    for r in cut:
        assert r.db == pytest.approx(10 * np.log10(want[0 if r.angle == 0 else r.step, r.step])) and r.frequency == pytest.approx(r.step / 9 * (3 if r.angle == 0 else 6 / np.sqrt(2)))


def test_spectrum_of_nothing(spark):
    df = spark.createDataFrame([], "px array<int>")
    assert spectrum.power(df, "px", 4).collect() == [] and spectrum.slices(spectrum.power(df, "px", 4), 4).collect() == []


def items(spark, n, d=4):
    x = np.random.default_rng(2).normal(3, 2, (n, d))
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>").repartition(5)


def test_resumed_statistics_equal_one_run(spark, tmp_path):
    x, df = items(spark, 300)
    one = f"{tmp_path}/one"
    assert feature_stats.append(df, one, 0, 250) == 250
    many = f"{tmp_path}/many"
    took = [feature_stats.append(df.filter((F.col("id") >= 100 * b) & (F.col("id") < 100 * b + 100)), many, b, 250) for b in range(2)]
    took.append(feature_stats.append(df.filter("id >= 200"), many, 2, 250))
    took.append(feature_stats.append(df.filter("id >= 200"), many, 2, 250))  # written again after a loss: it replaces itself
    assert took == [100, 100, 50, 50] and feature_stats.append(df, many, 3, 250) == 0
    for path in (one, many):
        n, mean, cov = feature_stats.merged(spark, path)
        assert n == 250 and np.allclose(mean, x[:250].mean(axis=0)) and np.allclose(cov, np.cov(x[:250].T, bias=True))
    assert feature_stats.merged(spark, f"{tmp_path}/none")[0] == 0


def test_statistics_of_a_stream_over_a_restart(spark, tmp_path):
    x, df = items(spark, 120)
    for at in (0, 1, 2):
        df.filter(F.col("id") % 3 == at).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        q = feature_stats.stream(rows, f"{tmp_path}/sums", f"{tmp_path}/cp")
        assert q.awaitTermination(120) and q.exception() is None
    n, mean, cov = feature_stats.merged(spark, f"{tmp_path}/sums")
    assert n == 120 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, bias=True))
