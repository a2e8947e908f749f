"""Pixels: scan orders, bit planes, the candidate grid, ramp fits, OCR consensus, rulings."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.content import latin1
from ..rules import CLEAN, CONFUSIONS, DECOY_ONLY, DISAGREEING, FOUND, FRAGMENT, LOOSE_ONLY, Rules
from .detect import bare_hex, canonical, judged, ruled_out, sightings
from .metadata import metadata_texts

CHANNELS, ORDERS, DEPTHS, BIT_ORDERS = ("R", "G", "B", "luma", "RGB"), ("row", "column", "diagonal", "border"), (1, 2, 4), ("msb", "lsb")
RAMP, DEVIATION = 8.0, 12.0


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """h x w x 3, RGB, of Spark's image data."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, 2) if channels == 1 else a[:, :, 2::-1]


def channel(rgb: np.ndarray, name: str) -> np.ndarray:
    if name == "luma":
        return (rgb @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    return rgb if name == "RGB" else rgb[:, :, "RGB".index(name)]


def scan(plane: np.ndarray, order: str) -> np.ndarray:
    h, w = plane.shape[:2]
    if order in ("row", "column"):
        return plane.reshape(h * w, -1).squeeze() if order == "row" else plane.swapaxes(0, 1).reshape(h * w, -1).squeeze()
    if order == "diagonal":
        i, j = np.divmod(np.arange(h * w), w)
        turn = np.where((i + j) % 2 == 0, -i, i)
        return plane[i, j][np.lexsort((turn, i + j))]
    i, j = np.divmod(np.arange(h * w), w)
    ring = np.minimum.reduce([i, j, h - 1 - i, w - 1 - j])
    top, left, bottom, right = ring, ring, h - 1 - ring, w - 1 - ring
    wide, tall = right - left, bottom - top
    at = np.where(i == top, j - left, np.where(j == right, wide + i - top, np.where(i == bottom, wide + tall + right - j, 2 * wide + tall + bottom - i)))
    return plane[i, j][np.lexsort((at, ring))]


def packed(values: np.ndarray, depth: int, order: str) -> bytes:
    """The low bits of each value in a row; lsb turns each byte round if bytes come out even."""
    bits = (values[:, None] >> np.arange(depth - 1, -1, -1)) & 1
    flat = bits.ravel()
    even = len(flat) % 8 == 0
    flat = flat[: len(flat) // 8 * 8]
    return np.packbits(flat.reshape(-1, 8)[:, ::-1] if order == "lsb" and even else flat).tobytes()


def grid() -> Iterator[tuple[str, str, str, str, bool]]:
    """(channel, order, encoding, bit order, reversed) of the 376 candidates of an image; RGB's bits are taken from each of its planes."""
    for ch, order, back in product(CHANNELS, ORDERS, (False, True)):
        yield ch, order, "ascii", "", back
        for depth, bits, plane in product(DEPTHS, BIT_ORDERS, "RGB" if ch == "RGB" else "-"):
            yield f"RGB.{plane}" if ch == "RGB" else ch, order, f"bits{depth}", bits, back


def candidates(rgb: np.ndarray) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) for each of grid(): an RGB ascii candidate has all three values of each pixel in turn; planes of RGB share a name."""
    for ch, order, encoding, bits, back in grid():
        if encoding == "ascii":
            data = (rgb.reshape(-1) if ch == "RGB" else scan(channel(rgb, ch), order)).astype(np.uint8).tobytes()
        else:
            data = packed(scan(channel(rgb, ch.partition(".")[2] or ch), order), int(encoding[4:]), bits)
        yield "/".join(x for x in (ch.partition(".")[0], order, encoding, bits, "rev" * back) if x), data[::-1] if back else data


def plane_fit(rgb: np.ndarray) -> tuple[bool, float, int, str]:
    """(is_ramp, max_residual, deviating_px, explanation) of a least-squares plane for each channel."""
    h, w = rgb.shape[:2]
    if min(h, w) < 8:
        return False, -1.0, -1, "too small"
    y, x = np.mgrid[:h, :w]
    design, z = np.stack([x.ravel(), y.ravel(), np.ones(h * w)], 1), rgb.reshape(-1, 3).astype(float)
    residual = np.abs(z - design @ np.linalg.lstsq(design, z, rcond=None)[0])
    if residual.max() > RAMP:
        r, g, b = (rgb[:, :, k].astype(int) for k in range(3))
        step_x, step_y = (r[0, 1] - r[0, 0]) % 256, (g[1, 0] - g[0, 0]) % 256
        even = ((r - r[0, 0] - step_x * x) % 256 == 0).all() and ((g - g[0, 0] - step_y * y) % 256 == 0).all()
        buckets = pd.Series(b.ravel()).groupby(((x ^ y) % 64).ravel()).nunique()
        return (True, 0.0, 0, "modular ramp") if even and (buckets == 1).all() else (False, round(float(residual.max()), 2), -1, "no ramp")
    side = max(4, min(h, w) // 8)
    corner = (((x < side) | (x >= w - side)) & ((y < side) | (y >= h - side))).ravel()
    fit = np.linalg.lstsq(design[corner], z[corner], rcond=None)[0]
    off = (np.abs(z - design @ fit) > DEVIATION).any(1)
    return True, round(float(residual.max()), 2), int(off.sum()), "ramp"


def sweep(images: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(sha256, candidate, hits array<string>) of images (sha256, image): a row for each candidate, with a character for each byte of a hit."""
    mark = rules.prefix.encode()
    strict, loose = re.compile(mark + rb"\{[0-9a-f]{16}\}"), re.compile(mark + rb"\s*\{[^}]{0,80}\}")

    def hits(data: bytes) -> list[str]:
        if mark not in data:
            return []
        return [x.decode("latin-1") for x in [*strict.findall(data), *(x for x in loose.findall(data) if not strict.fullmatch(x))]]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                rows = [(r.sha256, name, hits(data)) for name, data in candidates(pixels(r.data, r.height, r.width, r.channels))]
                yield pd.DataFrame(rows, columns=["sha256", "candidate", "hits"])

    rows = images.filter("image.height > 0").select("sha256", "image.data", "image.height", "image.width", F.col("image.nChannels").alias("channels"))
    return rows.mapInPandas(each, "sha256 string, candidate string, hits array<string>")


def pixel_sightings(swept: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A sweep's hits, judged, as (sha256, candidate, how_found, raw, canonical, ruled_out, strict, bucket)."""
    return judged(swept.select("sha256", "candidate", F.concat(F.lit("pixel:"), "candidate").alias("how_found"), F.explode("hits").alias("raw")), rules)


def sweep_log(swept: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(sha256, candidate, outcome): clean, LOOSE, or STRICT: and the last strict value, for every candidate."""
    value = F.transform("hits", lambda x: F.when(ruled_out(x, canonical(x, rules), rules) == "", canonical(x, rules)))
    last = F.element_at(F.filter(value, lambda x: x.isNotNull()), -1)
    return swept.select("sha256", "candidate", F.when(F.size("hits") == 0, "clean").when(last.isNotNull(), F.concat(F.lit("STRICT:"), last)).otherwise("LOOSE").alias("outcome"))


def metadata_sightings(blobs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Hits in the metadata of rasters (sha256, content), in UTF-16 as well, a strict value once for each image, and bare runs of 16 digits."""
    texts = blobs.select("sha256", F.explode(metadata_texts(F.col("content"))).alias("s")).select("sha256", "s.sub", "s.data")
    bare = texts.select("sha256", F.concat("sub", F.lit(":bare_hex16")).alias("how_found"), F.explode(bare_hex(latin1(F.col("data")))).alias("raw"))
    found = sightings(texts, rules, F.lit(True)).select("sha256", "how_found", "raw", "canonical", "ruled_out", "strict", "bucket")
    own = Window.partitionBy("sha256", "canonical").orderBy("how_found", "raw")
    once = found.withColumn("_n", F.row_number().over(own)).filter("not strict or _n = 1").drop("_n")
    return once.unionByName(judged(bare.withColumn("raw", F.concat(F.lit(FRAGMENT), "raw")), rules))


def fits(images: DataFrame) -> DataFrame:
    """(sha256, is_ramp, max_residual, deviating_px, explanation)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(r.sha256, *plane_fit(pixels(r.data, r.height, r.width, r.channels))) for r in b.itertuples()], columns=["sha256", "is_ramp", "max_residual", "deviating_px", "explanation"])

    rows = images.filter("image.height > 0").select("sha256", "image.data", "image.height", "image.width", F.col("image.nChannels").alias("channels"))
    return rows.mapInPandas(each, "sha256 string, is_ramp boolean, max_residual double, deviating_px int, explanation string")


def ruling(payloads: Column, sightings: Column, open_review: Column, ruled: Column) -> Column:
    return F.when(payloads > 1, DISAGREEING).when(sightings > 0, FOUND).when(open_review > 0, LOOSE_ONLY).when(ruled > 0, DECOY_ONLY).otherwise(CLEAN)


def image_reports(swept: DataFrame, found: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """(sha256, candidates_tried, candidates_with_hits, ruling) of a sweep and all sightings (sha256, how_found, canonical, bucket) of its images.

    Values read from pixels or by OCR may disagree, those of metadata are only counted as found. An image in merged
    (sha256, canonical not null) has its payload found.
    """
    tried = swept.groupBy("sha256").agg(F.count("*").alias("candidates_tried"), F.count_if(F.size("hits") > 0).alias("candidates_with_hits"))
    strict, seen = F.col("bucket") == "strict", F.col("how_found").rlike("^(pixel|img_ocr):")
    marks = found.groupBy("sha256").agg(F.count_distinct(F.when(strict & seen, F.col("canonical"))).alias("payloads"), F.count_if(strict).alias("strict"), F.count_if(F.col("bucket") == "needs_review").alias("open"), F.count_if(F.col("bucket") == "ruled_out").alias("ruled"))
    rows = tried.join(marks, "sha256", "left").fillna(0, ["payloads", "strict", "open", "ruled"])
    rows = rows.select("sha256", "candidates_tried", "candidates_with_hits", ruling(F.col("payloads"), F.col("strict"), F.col("open"), F.col("ruled")).alias("ruling"))
    if merged is None:
        return rows
    agreed = merged.filter("canonical is not null").select("sha256", F.lit(True).alias("_agreed")).distinct()
    return rows.join(agreed, "sha256", "left").withColumn("ruling", F.when(F.col("_agreed"), FOUND).otherwise(F.col("ruling"))).drop("_agreed")


def reports(swept: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """image_reports of a sweep alone."""
    return image_reports(swept, pixel_sightings(swept, rules))


def ocr_eligible(images: DataFrame, found: DataFrame) -> DataFrame:
    """Images (sha256, image) that are to be read by OCR: three times as wide as high, or without a strict sighting in found (sha256, strict)."""
    explained = found.filter("strict").select("sha256").distinct().withColumn("_explained", F.lit(True))
    wide = F.col("image.width") >= 3 * F.greatest(F.col("image.height"), F.lit(1))
    rows = images.filter("image.height > 0").join(explained, "sha256", "left")
    return rows.filter(wide | F.col("_explained").isNull()).drop("_explained")


def variants(rgb: np.ndarray) -> dict[str, np.ndarray]:
    """The planes that a reader is given: gray, upscaled where the longer side is under 1,000 pixels, and binary at a middle threshold."""
    gray = channel(rgb, "luma")
    out, (h, w) = {"gray": gray}, gray.shape
    if max(h, w) < 1000:
        times = max(2, min(6, 1000 // max(1, min(h, w))))
        y, x = ((np.arange(n * times) + 0.5) / times - 0.5 for n in (h, w))
        grid = np.pad(gray.astype(float), 1, "edge")
        (i, u), (j, v) = (((k := np.floor(z).astype(int)), z - k) for z in (y, x))
        rows = grid[i + 1] * (1 - u)[:, None] + grid[i + 2] * u[:, None]
        out["upscaled"] = np.rint(rows[:, j + 1] * (1 - v) + rows[:, j + 2] * v).astype(np.uint8)
    return out | {"binary": np.where(gray > 127, 255, 0).astype(np.uint8)}


def read_text(images: DataFrame, reader: Callable[[np.ndarray], str] | None = None) -> DataFrame:
    """(sha256, variant, text) that a reader makes of the variants of images; blank reads are left out, no reader reads nothing.

    A variant that the reader raises a ValueError or RuntimeError for is left out too.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                for name, plane in variants(pixels(r.data, r.height, r.width, r.channels)).items() if reader else ():
                    try:
                        text = reader(plane)
                    except (ValueError, RuntimeError):
                        continue
                    rows += [(r.sha256, name, text)] * bool(text.strip())
            yield pd.DataFrame(rows, columns=["sha256", "variant", "text"])

    rows = images.filter("image.height > 0").select("sha256", "image.data", "image.height", "image.width", F.col("image.nChannels").alias("channels"))
    return rows.mapInPandas(each, "sha256 string, variant string, text string")


def consensus(texts: list[str], prefix: str) -> str | None:
    """The canonical value that OCR passes agree on: a whole window by two passes, else two thirds at each place and most of those.

    A pass's window is the first of those behind the prefix, in any case, with most hexadecimal digits.
    """
    digits, table, windows = set("0123456789abcdef"), str.maketrans(CONFUSIONS), []
    for t in texts:
        if m := re.search(re.escape(prefix), t, re.IGNORECASE):
            tail = t[m.end() :]
            some = (tail[k : k + 16].translate(table).lower() for k in range(max(1, len(tail) - 15)))
            windows.append(max(some, key=lambda w: sum(x in digits for x in w)))
    windows = [w for w in windows if w]
    if len(windows) < 2:
        return None
    whole = [w for w, n in Counter(windows).most_common() if n > 1 and re.fullmatch("[0-9a-f]{16}", w)]
    if whole:
        return f"{prefix}{{{whole[0]}}}"
    need, out = -(-2 * len(windows) // 3), ""
    for k in range(16):
        seen = Counter(w[k] for w in windows if len(w) > k and w[k] in digits)
        if not seen or seen.total() < need or seen.most_common(1)[0][1] * 2 <= seen.total():
            return None
        out += seen.most_common(1)[0][0]
    return f"{prefix}{{{out}}}"


def ocr_consensus(passes: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(sha256, canonical) of passes (sha256, variant, text); the passes of an image are a few."""

    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], consensus(rows.sort_values("variant")["text"].tolist(), rules.prefix))], columns=["sha256", "canonical"])

    return passes.groupBy("sha256").applyInPandas(each, "sha256 string, canonical string")
