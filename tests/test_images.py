"""Pixel kernels against formulas written out for single pixels, stacks against single images, orientations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgaudit.functions import conditions
from imgaudit.operators import images

RNG = np.random.default_rng(7)
IMAGE = RNG.integers(0, 256, (21, 30, 3)).astype(np.uint8)
SMOOTH = (np.add.outer(np.arange(24) * 4, np.arange(40) * 3)[..., None] + np.array([0, 20, 40])).clip(0, 255).astype(np.uint8)
NAMES = ["clean", *(f"{f}_{s}" for f, s, _ in conditions.TRANSFORMS), *conditions.CHAINS]


def rounded(x):
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def near(a, b, most=1):
    assert a.shape == b.shape and np.abs(a.astype(int) - b.astype(int)).max() <= most


def test_blur_is_a_normalized_gaussian_sum():
    sigma, r = 1.0, 3
    want = np.zeros(IMAGE.shape)
    for i in range(IMAGE.shape[0]):
        for j in range(IMAGE.shape[1]):
            total, weight = np.zeros(3), 0.0
            for di in range(-r, r + 1):
                for dj in range(-r, r + 1):
                    w = np.exp(-(di * di + dj * dj) / (2 * sigma * sigma))
                    total += w * IMAGE[min(max(i + di, 0), 20), min(max(j + dj, 0), 29)]
                    weight += w
            want[i, j] = total / weight
    near(images.blur(IMAGE, sigma), rounded(want))


def test_resize_is_a_weighted_mean_of_near_pixels():
    def cubic(x):
        x = abs(x)
        return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0

    def line(values, n):
        scale, out = max(len(values) / n, 1.0), []
        for k in range(n):
            center = (k + 0.5) * len(values) / n
            w = np.array([cubic((i + 0.5 - center) / scale) for i in range(len(values))])
            out.append((w[:, None] * values).sum(axis=0) / w.sum())
        return np.array(out)

    x = SMOOTH[..., 1].astype(float)
    want = line(line(x, 12).T, 17).T
    assert images.resize(SMOOTH, 12, 17)[..., 1] == pytest.approx(want, abs=1e-9)
    small = rounded(images.resize(SMOOTH, 12, 20))
    near(images.rescale(SMOOTH, 0.5), rounded(images.resize(small, 24, 40)))


def test_jpeg_quantizes_blocks_of_the_cosine_transform():
    def coded(tile, table):
        n = np.arange(8)
        out = np.zeros((8, 8))
        for u in range(8):
            for v in range(8):
                c = (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
                basis = np.outer(np.cos((2 * n + 1) * u * np.pi / 16), np.cos((2 * n + 1) * v * np.pi / 16))
                q = np.floor((table[u][v] * 100 + 50) / 100)
                out += c * basis * np.rint(c * (basis * tile).sum() / q) * q
        return out

    gray = np.repeat(RNG.integers(60, 200, (8, 16, 1)), 3, 2).astype(np.uint8)  # no color, so chroma is flat
    want = np.concatenate([coded(gray[:, k : k + 8, 0].astype(float) - 128, images.LUMINANCE) + 128 for k in (0, 8)], axis=1)
    near(images.jpeg(gray, 50), np.repeat(rounded(want)[..., None], 3, 2))
    losses = [np.abs(images.jpeg(SMOOTH, q).astype(int) - SMOOTH).mean() for q in (95, 50, 10)]
    assert losses[0] < losses[1] < losses[2] < 30


def test_noise_jitter_crop_and_sharpen_follow_their_formulas():
    drawn = np.random.default_rng(3).normal(0, 0.05, IMAGE.shape)
    near(images.noise(IMAGE, 0.05, 3), rounded(np.clip(IMAGE / 255 + drawn, 0, 1) * 255))
    b, c, s = np.random.default_rng(4).uniform(0.8, 1.2, 3)
    x = rounded(IMAGE * b).astype(float)
    luma = lambda v: 0.299 * v[..., 0] + 0.587 * v[..., 1] + 0.114 * v[..., 2]
    x = rounded(np.rint(luma(x).mean()) * (1 - c) + x * c).astype(float)
    gray = np.rint(luma(x))[..., None]
    near(images.jitter(IMAGE, 0.2, 4), rounded(gray * (1 - s) + x * s))
    part = IMAGE[2:19, 3:27]  # four fifths of each side about the middle
    near(images.crop(IMAGE, 0.8), rounded(images.resize(part, 21, 30)))
    i, j = 5, 9
    around = IMAGE[i - 1 : i + 2, j - 1 : j + 2].astype(float)
    smooth = (around.sum(axis=(0, 1)) + 4.0 * IMAGE[i, j]) / 13
    near(images.sharpen(IMAGE, 2.0)[i, j], rounded(smooth + (IMAGE[i, j] - smooth) * 2.0))


def test_chains_apply_their_steps_in_order():
    for name, steps in conditions.CHAINS.items():
        want = IMAGE
        for k, (step, value) in enumerate(steps):
            want = images.STEPS[step](want, value, 11 + k * 1_000_003)
        assert (images.apply_condition(IMAGE, name, 11) == want).all()


def test_stacks_give_what_single_images_give():
    stack = np.stack([IMAGE, IMAGE[::-1], 255 - IMAGE])
    for name in NAMES:
        done = images.apply_condition(stack, name, [5, 6, 7])
        assert (done == np.stack([images.apply_condition(x, name, s) for x, s in zip(stack, (5, 6, 7), strict=True)])).all(), name
    assert images.radial_spectrum(stack, 8, 32) == pytest.approx(np.stack([images.radial_spectrum(x, 8, 32) for x in stack]), abs=1e-5)
    assert images.difference_hash(stack).tolist() == [images.difference_hash(x) for x in stack]


def test_spectrum_is_the_mean_of_rings():
    size, bins = 16, 5
    gray = np.rint(SMOOTH @ images.GRAY)
    small = images.resize(gray[..., None], size, size)[..., 0]
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))
    x = (small - small.mean()) * w[:, None] * w[None, :]
    n = np.arange(size)
    transform = np.exp(-2j * np.pi * np.outer(n, n) / size)
    full = np.log1p(np.abs(transform @ x @ transform.T))
    rings = [[] for _ in range(bins)]
    for i in range(size):
        for j in range(size):
            u, v = (i if i < size // 2 else i - size), (j if j < size // 2 else j - size)
            rings[min(int(np.hypot(u, v) / np.hypot(size // 2, size // 2) * bins), bins - 1)].append(full[i, j])
    assert images.radial_spectrum(SMOOTH, bins, size) == pytest.approx([np.mean(r) for r in rings], rel=1e-5)


def test_difference_hash_compares_neighbours():
    small = np.rint(images.resize(np.rint(IMAGE @ images.GRAY)[..., None], 8, 9, "lanczos")[..., 0])
    bits = "".join("1" if small[i, j + 1] > small[i, j] else "0" for i in range(8) for j in range(8))
    want = int(bits, 2)
    assert images.difference_hash(IMAGE) == (want - (1 << 64) if want >> 63 else want)


SCHEMA = "image_id string, condition string, seed long, height int, width int, pixels binary"


def table(spark):
    made = [(f"{k}-{name}", name, 100 + k, x.shape[0], x.shape[1], x.tobytes()) for k, x in enumerate((IMAGE, SMOOTH)) for name in NAMES]
    return spark.createDataFrame(made, SCHEMA).repartition(2)


def test_jobs_over_mixed_shapes(spark):
    got = {r["image_id"]: r for r in images.transform_images(table(spark)).collect()}
    features = {r["image_id"]: r for r in images.view_features(table(spark), 8, 32).collect()}
    for k, x in enumerate((IMAGE, SMOOTH)):
        for name in NAMES:
            want = images.apply_condition(x, name, 100 + k)
            row = got[f"{k}-{name}"]
            assert row["pixels"] == want.tobytes() and (row["height"], row["width"]) == want.shape[:2]
            assert features[f"{k}-{name}"]["dhash"] == images.difference_hash(want)
            assert features[f"{k}-{name}"]["frequency"] == pytest.approx(images.radial_spectrum(want, 8, 32), abs=1e-5)
    unit = images.encode_batches(table(spark), images.random_projection(6), 6).first()["semantic"]
    assert sum(v * v for v in unit) == pytest.approx(1, abs=1e-5)


def head(turn, order="big"):
    """The head of a JPEG file with an orientation in its Exif part."""
    n = lambda v, size: v.to_bytes(size, order)
    tiff = (b"MM" if order == "big" else b"II") + n(42, 2) + n(8, 4) + n(2, 2)
    tiff += n(0x0100, 2) + n(4, 2) + n(1, 4) + n(640, 4)
    tiff += n(0x0112, 2) + n(3, 2) + n(1, 4) + n(turn, 2) + n(0, 2)
    part = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + (len(part) + 2).to_bytes(2, "big") + part + b"\xff\xda\0\x02"


def stored(image, turn):
    """Pixels as a camera stores them under an orientation, told by where the first row and column lie."""
    corners = {1: image, 2: np.fliplr(image), 3: np.rot90(image, 2), 4: np.flipud(image)}
    corners |= {5: np.transpose(image, (1, 0, 2)), 6: np.rot90(image, 1), 7: np.rot90(np.transpose(image, (1, 0, 2)), 2), 8: np.rot90(image, -1)}
    return corners[turn]


def test_eight_orientations_are_one_image(spark):
    files = [(str(t), head(t, order)) for t in range(1, 9) for order in ("big", "little")]
    odd = [("none", b"\xff\xd8\xff\xda"), ("png", b"\x89PNG\r\n\x1a\n"), ("text", b"x"), ("empty", b""), ("wrong", head(9)), ("null", None), ("cut", head(6)[:40])]
    told = images.orientations(spark.createDataFrame(files + odd, "path string, content binary")).collect()
    assert all(r["orientation"] == (int(r["path"]) if r["path"].isdigit() else 1) for r in told)
    rows = [(str(t), *stored(IMAGE, t).shape[:2], np.ascontiguousarray(stored(IMAGE, t)).tobytes(), t) for t in range(1, 9)]
    rows += [("none", *IMAGE.shape[:2], IMAGE.tobytes(), None)]
    turned = images.turn_upright(spark.createDataFrame(rows, "image_id string, height int, width int, pixels binary, orientation int"))
    assert {(r["height"], r["width"], bytes(r["pixels"])) for r in turned.collect()} == {(*IMAGE.shape[:2], IMAGE.tobytes())}
    hashes = images.difference_hashes(turned).agg(F.count_distinct("dhash").alias("n"), F.max("dhash").alias("h")).first()
    assert hashes["n"] == 1 and hashes["h"] == images.difference_hash(IMAGE)
