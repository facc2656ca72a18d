"""Pixel jobs: seeded transforms, radial spectra, difference hashes and batch encoders.

Pixels are RGB bytes in row order. Every job maps Arrow batches of an image table
(image_id, height, width, pixels, ...), so nothing is shuffled. Images of a batch are stacked by
shape (and condition), and kernels take stacks of any leading axes: one matrix product, filter or FFT
serves a whole stack. The formulas are this library's own and hold to tolerances, not to the bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import CHAINS, TRANSFORMS

# The standard luminance and chrominance tables of baseline JPEG.
LUMINANCE = [
    [16, 11, 10, 16, 24, 40, 51, 61],
    [12, 12, 14, 19, 26, 58, 60, 55],
    [14, 13, 16, 24, 40, 57, 69, 56],
    [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77],
    [24, 35, 55, 64, 81, 104, 113, 92],
    [49, 64, 78, 87, 103, 121, 120, 101],
    [72, 92, 95, 98, 112, 100, 103, 99],
]
CHROMINANCE = [
    [17, 18, 24, 47, 99, 99, 99, 99],
    [18, 21, 26, 66, 99, 99, 99, 99],
    [24, 26, 56, 99, 99, 99, 99, 99],
    [47, 66, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99],
]
GRAY = np.array([0.299, 0.587, 0.114])


def to_bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def resample(n_in: int, n_out: int, radius: float, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Weights of an antialiased resize from n_in to n_out samples."""
    scale = max(n_in / n_out, 1.0)
    centers = (np.arange(n_out) + 0.5) * n_in / n_out
    w = kernel((np.arange(n_in)[None, :] + 0.5 - centers[:, None]) / scale) * (np.abs(np.arange(n_in)[None, :] + 0.5 - centers[:, None]) < radius * scale)
    return w / w.sum(axis=1, keepdims=True)


def _cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, np.where(x < 2, a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a, 0.0))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def resize(image: np.ndarray, height: int, width: int, kernel: str = "cubic") -> np.ndarray:
    k, r = (_cubic, 2.0) if kernel == "cubic" else (_lanczos, 3.0)
    rows, cols = resample(image.shape[-3], height, r, k), resample(image.shape[-2], width, r, k)
    return np.einsum("ij,...jkc,lk->...ilc", rows, image.astype(np.float64), cols, optimize=True)


def _dct() -> np.ndarray:
    k, n = np.mgrid[0:8, 0:8]
    return np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)


def _padded(x: np.ndarray, rows: tuple[int, int], cols: tuple[int, int], mode: str = "edge") -> np.ndarray:
    """The last two axes of a stack of planes with more rows and columns."""
    return np.pad(x, [(0, 0)] * (x.ndim - 2) + [rows, cols], mode=mode)


def _quantized(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    h, w = plane.shape[-2:]
    full = _padded(plane, (0, -h % 8), (0, -w % 8)) - 128
    tiles = full.reshape(*full.shape[:-2], full.shape[-2] // 8, 8, -1, 8).swapaxes(-3, -2)
    d = _dct()
    coded = np.rint(d @ tiles @ d.T / table) * table
    back = (d.T @ coded @ d).swapaxes(-3, -2).reshape(full.shape)
    return back[..., :h, :w] + 128


def jpeg(image: np.ndarray, quality: float, seed: object = 0) -> np.ndarray:
    """Loss of baseline JPEG with 4:2:0 chroma; entropy coding loses nothing and is left out."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    tables = [np.clip(np.floor((np.array(t) * scale + 50) / 100), 1, 255) for t in (LUMINANCE, CHROMINANCE)]
    x = image.astype(np.float64)
    y = x @ GRAY
    cb, cr = (x[..., 2] - y) / 1.772 + 128, (x[..., 0] - y) / 1.402 + 128
    y = _quantized(y, tables[0])
    h, w = y.shape[-2:]
    small = []
    for c in (cb, cr):
        c = _padded(c, (0, h % 2), (0, w % 2))
        c = c.reshape(*c.shape[:-2], c.shape[-2] // 2, 2, -1, 2).mean(axis=(-3, -1))
        small.append(np.repeat(np.repeat(_quantized(c, tables[1]), 2, -2), 2, -1)[..., :h, :w] - 128)
    cb, cr = small
    return to_bytes(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1))


def blur(image: np.ndarray, sigma: float, seed: object = 0) -> np.ndarray:
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma**2))
    k /= k.sum()
    h, w = image.shape[-3:-1]
    x = np.pad(image.astype(np.float64), [(0, 0)] * (image.ndim - 3) + [(r, r), (r, r), (0, 0)], mode="edge")
    x = sum(k[i] * x[..., i : i + h, :, :] for i in range(2 * r + 1))
    return to_bytes(sum(k[i] * x[..., i : i + w, :] for i in range(2 * r + 1)))


def rescale(image: np.ndarray, factor: float, seed: object = 0) -> np.ndarray:
    h, w = image.shape[-3:-1]
    small = to_bytes(resize(image, max(1, round(h * factor)), max(1, round(w * factor))))
    return to_bytes(resize(small, h, w))


def _drawn(image: np.ndarray, seed: object, draw: Callable[[np.random.Generator], np.ndarray]) -> np.ndarray:
    """What each image of a stack draws from a generator of its own seed; ``seed`` is one for an image, one each for a stack."""
    if image.ndim == 3:
        return draw(np.random.default_rng(seed))
    return np.stack([draw(np.random.default_rng(s)) for s in np.broadcast_to(np.asarray(seed, dtype=object), image.shape[:1])])


def noise(image: np.ndarray, sigma: float, seed: object = 0) -> np.ndarray:
    drawn = _drawn(image, seed, lambda rng: rng.normal(0.0, sigma, image.shape[-3:]))
    return to_bytes(np.clip(image / 255.0 + drawn, 0, 1) * 255)


def jitter(image: np.ndarray, amount: float, seed: object = 0) -> np.ndarray:
    """Brightness, contrast and saturation, in this order, by three seeded factors."""
    factors = _drawn(image, seed, lambda rng: rng.uniform(1 - amount, 1 + amount, 3))
    brightness, contrast, saturation = (factors[..., k, None, None, None] for k in range(3))
    x = to_bytes(image * brightness).astype(np.float64)
    middle = np.rint((x @ GRAY).mean(axis=(-2, -1)))[..., None, None, None]
    x = to_bytes(middle + (x - middle) * contrast).astype(np.float64)
    gray = np.rint(x @ GRAY)[..., None]
    return to_bytes(gray + (x - gray) * saturation)


def crop(image: np.ndarray, ratio: float, seed: object = 0) -> np.ndarray:
    h, w = image.shape[-3:-1]
    ch, cw = max(1, round(h * ratio)), max(1, round(w * ratio))
    top, left = (h - ch) // 2, (w - cw) // 2
    return to_bytes(resize(image[..., top : top + ch, left : left + cw, :], h, w))


def sharpen(image: np.ndarray, factor: float, seed: object = 0) -> np.ndarray:
    x = image.astype(np.float64)
    p = np.pad(x, [(0, 0)] * (x.ndim - 3) + [(1, 1), (1, 1), (0, 0)], mode="edge")
    h, w = image.shape[-3:-1]
    smooth = (sum(p[..., i : i + h, j : j + w, :] for i in range(3) for j in range(3)) + 4 * x) / 13
    return to_bytes(smooth + (x - smooth) * factor)


STEPS = {"jpeg": jpeg, "blur": blur, "resize": rescale, "noise": noise, "jitter": jitter, "crop": crop, "sharpen": sharpen}


def apply_condition(image: np.ndarray, condition: str, seed: object) -> np.ndarray:
    """An image, or a stack with a seed each, under a condition; each step of a chain has seeds of its own."""
    if condition == "clean":
        return image
    single = {f"{f}_{s}": (f, v) for f, s, v in TRANSFORMS}
    steps = CHAINS.get(condition) or [single[condition]]
    of = lambda s, index: (int(s) + index * 1_000_003) % (1 << 63)
    for index, (name, value) in enumerate(steps):
        seeds = of(seed, index) if image.ndim == 3 else [of(s, index) for s in np.broadcast_to(np.asarray(seed, dtype=object), image.shape[:1])]
        image = STEPS[name](image, value, seeds)
    return image


def pixels_of(row: tuple) -> np.ndarray:
    return np.frombuffer(row.pixels, dtype=np.uint8).reshape(row.height, row.width, 3)


#: Numbers of a stack that a kernel works on at a time.
STACK = 1 << 23


def stacks(batch: pd.DataFrame, by: list[str]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(values of ``by``, places in the batch, stack of images) for images of one shape and equal values."""
    places = np.arange(len(batch))
    for key, own in batch.assign(_at=places).groupby(["height", "width", *by], sort=False, dropna=False):
        h, w = int(key[0]), int(key[1])
        size = max(1, STACK // max(1, h * w * 3))
        for k in range(0, len(own), size):
            part = own.iloc[k : k + size]
            yield key[2:], part["_at"].to_numpy(), np.frombuffer(b"".join(part["pixels"]), dtype=np.uint8).reshape(len(part), h, w, 3)


_IMAGE = "image_id {kind}, condition string, height int, width int, pixels binary"


def _seeds(batch: pd.DataFrame, at: np.ndarray) -> list[int]:
    return [int(s) % (1 << 63) for s in batch["seed"].iloc[at]]


def transform_images(views: DataFrame) -> DataFrame:
    """views(image_id, condition, seed, height, width, pixels) -> the same rows with transformed pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.empty(len(batch), dtype=object)
            for (condition,), at, stack in stacks(batch, ["condition"]):
                out[at] = [x.tobytes() for x in apply_condition(stack, condition, _seeds(batch, at))]
            yield pd.DataFrame({"image_id": batch["image_id"], "condition": batch["condition"], "height": batch["height"], "width": batch["width"], "pixels": out})

    return views.select("image_id", "condition", "seed", "height", "width", "pixels").mapInPandas(run, _IMAGE.format(kind=dict(views.dtypes)["image_id"]))


def _gray(image: np.ndarray) -> np.ndarray:
    return np.rint(image @ GRAY)[..., None]


def radial_spectrum(image: np.ndarray, bins: int = 32, size: int = 256) -> np.ndarray:
    """Mean log magnitude of the windowed spectrum in rings of equal width; 0 for an empty ring.

    Of an RGB image, of a stack of them, or of one plane.
    """
    gray = resize(image[..., None] if image.ndim == 2 else _gray(image), size, size)[..., 0]
    window = np.hanning(size)
    spectrum = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2((gray - gray.mean(axis=(-2, -1), keepdims=True)) * np.outer(window, window)), axes=(-2, -1))))
    y, x = np.indices((size, size)) - size // 2
    radius = np.hypot(x, y)
    ring = np.minimum((radius / radius.max() * bins).astype(int), bins - 1).ravel()
    order = np.argsort(ring, kind="stable")
    there, first, n = np.unique(ring[order], return_index=True, return_counts=True)
    out = np.zeros((*spectrum.shape[:-2], bins), dtype=np.float32)
    out[..., there] = np.add.reduceat(spectrum.reshape(*spectrum.shape[:-2], -1)[..., order], first, axis=-1) / n
    return out


def difference_hash(image: np.ndarray) -> int | np.ndarray:
    """64 bits: is each of 8 x 8 cells darker than its right neighbour's left; first comparison on top; signed. One for each image of a stack."""
    gray = np.rint(resize(_gray(image), 8, 9, "lanczos")[..., 0])
    bits = (gray[..., 1:] > gray[..., :-1]).reshape(*image.shape[:-3], 64)
    found = np.packbits(bits, axis=-1).view(">i8")[..., 0].astype(np.int64)
    return int(found) if image.ndim == 3 else found


def view_features(images: DataFrame, bins: int = 32, size: int = 256) -> DataFrame:
    """image_id, condition, frequency, dhash of transformed views, from views(image_id, condition, seed, ...)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frequency, hashes = np.empty(len(batch), dtype=object), np.zeros(len(batch), dtype=np.int64)
            for (condition,), at, stack in stacks(batch, ["condition"]):
                some = max(1, STACK // (size * size))
                for k in range(0, len(at), some):
                    done = apply_condition(stack[k : k + some], condition, _seeds(batch, at[k : k + some]))
                    frequency[at[k : k + some]] = list(radial_spectrum(done, bins, size))
                    hashes[at[k : k + some]] = difference_hash(done)
            yield pd.DataFrame({"image_id": batch["image_id"], "condition": batch["condition"], "frequency": frequency, "dhash": hashes})

    return images.mapInPandas(run, f"image_id {dict(images.dtypes)['image_id']}, condition string, frequency array<float>, dhash long")


def encode_batches(images: DataFrame, factory: Callable[[], Callable[[list[np.ndarray]], np.ndarray]], size: int) -> DataFrame:
    """image_id and a unit vector of ``size`` floats by a batch encoder, made once in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = factory()
        for batch in batches:
            found = np.asarray(encode([pixels_of(r) for r in batch.itertuples()]), dtype=np.float64).reshape(len(batch), -1)
            if found.shape[1] != size:
                raise ValueError(f"the encoder gives {found.shape[1]} values, not {size}")
            unit = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"image_id": batch["image_id"], "semantic": list(unit.astype(np.float32))})

    return images.select("image_id", "height", "width", "pixels").mapInPandas(run, f"image_id {dict(images.dtypes)['image_id']}, semantic array<float>")


def random_projection(size: int, seed: int = 0) -> Callable[[], Callable[[list[np.ndarray]], np.ndarray]]:
    """Encoder factory for tests: a fixed random projection of the image at 16 x 16."""

    def make() -> Callable[[list[np.ndarray]], np.ndarray]:
        matrix = np.random.default_rng(seed).normal(size=(16 * 16 * 3, size))
        return lambda images: np.stack([(resize(i, 16, 16) / 255.0).ravel() @ matrix for i in images])

    return make


def vectors_as_images(rows: DataFrame, side: int = 8) -> DataFrame:
    """Images drawn from feature vectors: one gray tile of 2 x 2 pixels for each of side * side values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for v in batch["features"]:
                x = np.asarray(v, dtype=np.float64)[: side * side]
                gray = to_bytes((x - x.min()) / max(np.ptp(x), 1e-9) * 255).reshape(side, side)
                out.append(np.repeat(np.repeat(np.repeat(gray, 2, 0), 2, 1)[..., None], 3, 2).tobytes())
            yield pd.DataFrame({"image_id": batch["image_id"], "condition": batch["condition"], "seed": batch["seed"], "height": 2 * side, "width": 2 * side, "pixels": out})

    return rows.mapInPandas(run, f"image_id {dict(rows.dtypes)['image_id']}, condition string, seed decimal(20,0), height int, width int, pixels binary")


def _size(content: bytes) -> tuple[int, int]:
    """Width and height that the head of a PNG, JPEG or WEBP file tells; 0, 0 if it tells none."""
    if content[:4] == b"\x89PNG" and len(content) >= 24:
        return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(content) and content[at] == 0xFF:
            marker = content[at + 1]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # a frame
                return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
            alone = marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD8
            at += (1 if marker == 0xFF else 2) if alone else 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP" and len(content) >= 30:
        if content[12:16] == b"VP8X":
            return int.from_bytes(content[24:27], "little") + 1, int.from_bytes(content[27:30], "little") + 1
        if content[12:16] == b"VP8L":
            bits = int.from_bytes(content[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if content[12:16] == b"VP8 ":
            return int.from_bytes(content[26:28], "little") & 0x3FFF, int.from_bytes(content[28:30], "little") & 0x3FFF
    return 0, 0


def orientation(content: bytes) -> int:
    """Orientation 1 to 8 that the Exif part of a JPEG's head tells; 1 if it tells none."""
    if content[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        marker, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xDA or 0xC0 <= marker <= 0xC3:  # pixels follow, no more head
            break
        part = content[at + 4 : at + 2 + size]
        at += 2 + size
        if marker != 0xE1 or part[:6] != b"Exif\0\0":
            continue
        tiff = part[6:]
        order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
        if order is None:
            return 1
        start = int.from_bytes(tiff[4:8], order)
        for k in range(int.from_bytes(tiff[start : start + 2], order)):
            entry = tiff[start + 2 + 12 * k : start + 14 + 12 * k]
            if len(entry) == 12 and int.from_bytes(entry[:2], order) == 0x0112:
                found = int.from_bytes(entry[8:10], order)
                return found if 1 <= found <= 8 else 1
        return 1
    return 1


def upright(image: np.ndarray, turn: int) -> np.ndarray:
    """The image as it is meant to be seen, from pixels stored under an orientation; also of stacks."""
    if turn >= 5:  # rows and columns are exchanged
        image = image.swapaxes(-3, -2)
    # what is left is to mirror columns, rows or both
    if turn in (2, 3, 6, 7):
        image = image[..., :, ::-1, :]
    if turn in (3, 4, 7, 8):
        image = image[..., ::-1, :, :]
    return np.ascontiguousarray(image)


def orientations(files: DataFrame) -> DataFrame:
    """path and orientation of files(path, content), from the first 64 KB of each; 1 for a null content."""

    @F.pandas_udf("int")
    def told(head: pd.Series) -> pd.Series:
        return pd.Series([1 if c is None else orientation(c) for c in head], dtype="int32")

    return files.select("path", told(F.substring("content", 1, 1 << 16)).alias("orientation"))


def turn_upright(images: DataFrame) -> DataFrame:
    """images(image_id, height, width, pixels, orientation) with pixels turned upright, height and width as they are then."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["image_id", "height", "width", "pixels"]].copy()
            pixels = out["pixels"].to_numpy(dtype=object, copy=True)
            sizes = out[["height", "width"]].to_numpy(copy=True)
            for (turn,), at, stack in stacks(batch, ["orientation"]):
                done = upright(stack, int(turn))
                pixels[at] = [x.tobytes() for x in done]
                sizes[at] = done.shape[1:3]
            yield out.assign(pixels=pixels, height=sizes[:, 0], width=sizes[:, 1])

    return images.select("image_id", "height", "width", "pixels", F.coalesce("orientation", F.lit(1)).alias("orientation")).mapInPandas(run, f"image_id {dict(images.dtypes)['image_id']}, height int, width int, pixels binary")


def difference_hashes(images: DataFrame) -> DataFrame:
    """image_id and dhash of images(image_id, height, width, pixels)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = np.zeros(len(batch), dtype=np.int64)
            for _, at, stack in stacks(batch, []):
                hashes[at] = difference_hash(stack)
            yield pd.DataFrame({"image_id": batch["image_id"], "dhash": hashes})

    return images.select("image_id", "height", "width", "pixels").mapInPandas(run, f"image_id {dict(images.dtypes)['image_id']}, dhash long")


def image_properties(files: DataFrame) -> DataFrame:
    """path, bytes, format, width and height of a table of files(path, content), all from the files' heads.

    Width and height are null where the head tells none.
    """

    @F.pandas_udf("width int, height int")
    def sizes(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(0, 0) if c is None else _size(c) for c in content], columns=["width", "height"])

    head = F.hex(F.substring("content", 1, 12))
    kind = F.when(head.startswith("89504E47"), "PNG").when(head.startswith("FFD8FF"), "JPEG").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "WEBP").otherwise("unknown")
    found = files.select("path", F.length("content").alias("bytes"), kind.alias("format"), sizes("content").alias("_size"))
    known = lambda c: F.when(F.col(f"_size.{c}") > 0, F.col(f"_size.{c}")).alias(c)
    return found.select("path", "bytes", "format", known("width"), known("height"))
