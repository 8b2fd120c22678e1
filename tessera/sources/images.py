"""Pixels: decoding, perceptual hashes, quality, embedded metadata.

Images are decoded by Spark's image source or from content by a decoder that the caller may replace; hashes, quality and
metadata are numpy work on Arrow batches.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LUMA = (0.299, 0.587, 0.114)
Decoder = Callable[[bytes], "np.ndarray | None"]


def literal_path(path: str) -> str:
    """A path that names one file, whatever wildcards it holds."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def read_images(spark: SparkSession, *roots: str) -> DataFrame:
    """Rows ``(path, width, height, channels, data)`` of files or all below folders; undecodable files have null sizes."""
    rows = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(list(roots)).select("image.*")
    ok = F.col("width") > 0
    # The source gives encoded addresses; a plus sign stands for itself there.
    path = F.url_decode(F.replace(F.regexp_replace("origin", "^file:(//)?", ""), F.lit("+"), F.lit("%2B")))
    return rows.select(path.alias("path"), *[F.when(ok, F.col(c)).alias(a) for c, a in (("width", "width"), ("height", "height"), ("nChannels", "channels"), ("data", "data"))])


def gray_of(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Luma of Spark's image bytes (blue, green, red order)."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return pixels[..., 0] if channels == 1 else pixels[..., 2] * LUMA[0] + pixels[..., 1] * LUMA[1] + pixels[..., 0] * LUMA[2]


def decode_png(data: bytes) -> np.ndarray | None:
    """Luma of an 8-bit, non-interlaced PNG; None for anything else."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, body, palette, head = 8, b"", None, None
    try:
        while at < len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            chunk = data[at + 8 : at + 8 + size]
            head = struct.unpack(">IIBBBBB", chunk) if kind == b"IHDR" else head
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3) if kind == b"PLTE" else palette
            body += chunk if kind == b"IDAT" else b""
            at += 12 + size
        width, height, depth, color, _, _, interlaced = head
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
        if depth != 8 or interlaced:
            return None
        rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    except (struct.error, zlib.error, ValueError, KeyError, TypeError):
        return None
    out, before = np.zeros((height, width * channels), np.uint8), np.zeros(width * channels, np.int64)
    for y in range(height):
        line, kind = rows[y, 1:].astype(np.int64), rows[y, 0]
        if kind == 1:
            line = np.cumsum(line.reshape(width, channels), axis=0).ravel() & 255
        elif kind == 2:
            line = (line + before) & 255
        elif kind in (3, 4):
            # A pixel needs the one to its left, so pixels are sequential; their channels go together.
            left, corner = np.zeros(channels, np.int64), np.zeros(channels, np.int64)
            for at in range(0, len(line), channels):
                above = before[at : at + channels]
                if kind == 3:
                    guess = (left + above) >> 1
                else:
                    p, q, r = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
                    guess = np.where((p <= q) & (p <= r), left, np.where(q <= r, above, corner))
                left = line[at : at + channels] = (line[at : at + channels] + guess) & 255
                corner = above
        out[y], before = line, line
    pixels = out.reshape(height, width, channels).astype(np.float64)
    if color == 3:
        pixels = palette[out.reshape(height, width)].astype(np.float64)
    return pixels[..., 0] if pixels.shape[2] < 3 else pixels[..., :3] @ np.array(LUMA)


def resize(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """Triangle-filter resampling whose support grows with the reduction."""

    def weights(old: int, new: int) -> np.ndarray:
        scale = old / new
        support = max(1.0, scale)
        centre = (np.arange(new) + 0.5) * scale - 0.5
        w = np.maximum(0, 1 - np.abs(np.arange(old)[None] - centre[:, None]) / support)
        return w / w.sum(axis=1, keepdims=True)

    return np.rint(weights(gray.shape[0], height) @ gray @ weights(gray.shape[1], width).T)


def average_hash(gray: np.ndarray, side: int = 8) -> bytes:
    small = resize(gray, side, side)
    return np.packbits(small > np.floor(small.mean())).tobytes()


def difference_hash(gray: np.ndarray, side: int = 8) -> bytes:
    small = resize(gray, side + 1, side)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes()


def gradient_hash(gray: np.ndarray, side: int = 8) -> bytes:
    """Double gradient: half of the bits across, half of them down."""
    n = side * side // 2
    k = int(np.ceil((1 + np.sqrt(1 + 4 * n)) / 2))
    small = resize(gray, k, k)
    return np.packbits(np.concatenate([(small[:, :-1] > small[:, 1:]).ravel()[:n], (small[:-1] > small[1:]).ravel()[:n]])).tobytes()


ALGORITHMS: dict[str, Callable[[np.ndarray, int], bytes]] = {"average": average_hash, "difference": difference_hash, "perceptual": gradient_hash}


def _pixels(files: DataFrame, decoder: Decoder) -> tuple[DataFrame, Callable[[pd.DataFrame], Iterator["np.ndarray | None"]]]:
    """The columns to read and the luma of each row: of decoded rows (see :func:`read_images`), else of ``content``."""
    if "data" in files.columns:
        known = lambda row: row.data is not None and row.width > 0
        return files.select("path", "width", "height", "channels", "data"), lambda frame: (gray_of(bytes(r.data), int(r.width), int(r.height), int(r.channels)) if known(r) else None for r in frame.itertuples())
    return files.select("path", "content"), lambda frame: (decoder(bytes(c)) if c is not None else None for c in frame["content"])


def hash_images(files: DataFrame, algorithm: str = "difference", side: int = 8, decoder: Decoder = decode_png) -> DataFrame:
    """Rows ``(path, algorithm, hash)`` of ``files``; undecodable files have a null hash.

    ``files`` are rows of :func:`read_images`, so all formats of Spark's image source (JPEG, PNG, GIF, BMP), or have ``path`` and
    ``content`` for the decoder.
    'fusion' gives the three hashes as ``ahash``, ``dhash`` and ``phash`` from one decoding.
    """
    if side not in (8, 16, 32):
        raise ValueError("side must be 8, 16 or 32")
    chosen = list(ALGORITHMS.values()) if algorithm == "fusion" else [ALGORITHMS[algorithm]]
    names = ["ahash", "dhash", "phash"] if algorithm == "fusion" else ["hash"]
    narrow, grays = _pixels(files, decoder)

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [[f(g, side) if g is not None else None for f in chosen] for g in grays(frame)]
            columns = {n: [r[k] for r in rows] for k, n in enumerate(names)}
            yield pd.DataFrame({"path": frame["path"], "algorithm": algorithm} | columns)

    return narrow.mapInPandas(hashed, "path string, algorithm string, " + ", ".join(f"{n} binary" for n in names))


def quality(gray: np.ndarray) -> tuple[float, float, float, float]:
    """(sharpness, contrast, brightness, overall): variance of the Laplacian, deviation and mean of the luma."""
    scale = 512 / max(gray.shape)
    if scale < 1:
        gray = resize(gray, max(1, round(gray.shape[1] * scale)), max(1, round(gray.shape[0] * scale)))
    sharp = 0.0
    if min(gray.shape) >= 3:
        inner = gray[1:-1, 1:-1]
        sharp = float((gray[:-2, 1:-1] + gray[2:, 1:-1] + gray[1:-1, :-2] + gray[1:-1, 2:] - 4 * inner).var())
    contrast, bright = float(gray.std()), float(gray.mean())
    return sharp, contrast, bright, 0.6 * min(sharp / 50, 100) + 0.3 * min(contrast / 0.6, 100) + 0.1 * (100 - abs(bright - 128) / 1.28)


def image_quality(files: DataFrame, decoder: Decoder = decode_png) -> DataFrame:
    """Rows ``(path, sharpness, contrast, brightness, overall)``, nulls for undecodable files; ``files`` as in :func:`hash_images`."""
    narrow, grays = _pixels(files, decoder)

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [quality(g) if g is not None else (None,) * 4 for g in grays(frame)]
            yield pd.DataFrame(rows, columns=["sharpness", "contrast", "brightness", "overall"], dtype="float64").assign(path=list(frame["path"]))[["path", "sharpness", "contrast", "brightness", "overall"]]

    return narrow.mapInPandas(scored, "path string, sharpness double, contrast double, brightness double, overall double")


# Tag numbers of the public EXIF standard.
TAGS = {0x010F: "make", 0x0110: "model", 0x0131: "software", 0x0132: "changed", 0x9003: "taken", 0xA002: "width", 0xA003: "height", 0x0100: "raw_width", 0x0101: "raw_height"}


def exif(data: bytes) -> dict[str, object]:
    """Known tags of the TIFF structure in a JPEG, PNG or TIFF file; empty where there is none."""
    start = data.find(b"Exif\0\0") + 6 if data[:2] == b"\xff\xd8" else data.find(b"eXIf") + 4 if data[:4] == b"\x89PNG" else 0
    tiff = data[start:] if start >= 6 or data[:2] in (b"II", b"MM") or data[:4] == b"\x89PNG" else b""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    found: dict[str, object] = {}
    if not order:
        return found
    try:
        folders, seen = [struct.unpack_from(order + "I", tiff, 4)[0]], set()
        while folders:
            at = folders.pop()
            if at in seen:
                continue
            seen.add(at)
            for i in range(struct.unpack_from(order + "H", tiff, at)[0]):
                tag, kind, n, value = struct.unpack_from(order + "HHII", tiff, at + 2 + 12 * i)
                place = at + 2 + 12 * i + 8
                if tag == 0x8769:
                    folders.append(value)
                elif tag in TAGS and kind == 2:
                    raw = tiff[value : value + n] if n > 4 else tiff[place : place + n]
                    found[TAGS[tag]] = raw.decode("latin-1").strip("\0 ") or None
                elif tag in TAGS and kind in (3, 4):
                    found[TAGS[tag]] = struct.unpack_from(order + ("H" if kind == 3 else "I"), tiff, place)[0]
    except struct.error:
        pass
    return found


def read_metadata(files: DataFrame) -> DataFrame:
    """Rows ``(path, taken, changed, make, model, software, width, height)``, null where a file has no such tag."""
    columns = ["taken", "changed", "make", "model", "software"]

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            tags = [exif(bytes(c)) if c is not None else {} for c in frame["content"]]
            out = {"path": list(frame["path"])} | {c: [t.get(c) for t in tags] for c in columns}
            out |= {c: pd.array([t.get(c, t.get(f"raw_{c}")) for t in tags], dtype="Int32") for c in ("width", "height")}
            yield pd.DataFrame(out)

    return files.select("path", "content").mapInPandas(parsed, "path string, taken string, changed string, make string, model string, software string, width int, height int")
