"""Pluggable models as batch functions, with stubs that need no weights."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship


class Embedder(Protocol):
    dim: int

    def embed_texts(self, texts: list[str]) -> np.ndarray: ...
    def embed_images(self, images: list[bytes], names: list[str]) -> np.ndarray: ...


class FaceBackend(Protocol):
    def detect(self, image: bytes, name: str) -> list[dict]: ...


class OcrBackend(Protocol):
    def extract(self, image: bytes, name: str) -> str: ...


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def label_vector(label: str, dim: int) -> np.ndarray:
    """A direction for a label: one checksum a coordinate."""
    return unit(np.array([zlib.crc32(f"{i}:{label}".encode()) / (1 << 31) - 1 for i in range(dim)]))


def gram_vector(text: str, dim: int, size: int = 3) -> np.ndarray:
    """Signed counts of the text's character runs, hashed to coordinates: texts with common runs are near."""
    flat, out = f" {' '.join(re.findall('[a-z0-9]+', text.lower()))} ", np.zeros(dim)
    for i in range(max(len(flat) - size + 1, 0)):
        h = zlib.crc32(flat[i : i + size].encode())
        out[h % dim] += 1 if h & (1 << 31) else -1
    return out


class StubEmbedder:
    """Character runs of the text, or of the file's name."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed_texts(self, texts: list[str]) -> np.ndarray:
        return unit(np.stack([gram_vector(t or "", self.dim) for t in texts]))

    def embed_images(self, images: list[bytes], names: list[str]) -> np.ndarray:
        return self.embed_texts([re.sub(r"\.[^.]*$", "", n.rsplit("/", 1)[-1]) for n in names])


class NullFaces:
    def detect(self, image: bytes, name: str) -> list[dict]:
        return []


class StubFaces:
    """One face for each name after `with-` in the file's name."""

    def __init__(self, dim: int = 32):
        self.dim = dim

    def detect(self, image: bytes, name: str) -> list[dict]:
        m = re.search(r"with-([a-z]+(?:-[a-z]+)*)", name)
        return [{"vector": label_vector(p, self.dim).tolist(), "x": 10 * i, "y": 0, "w": 120, "h": 120, "det_score": 0.9, "quality": 0.8} for i, p in enumerate(m[1].split("-"))] if m else []


class StubOcr:
    def extract(self, image: bytes, name: str) -> str:
        return image[:64].decode("utf-8", "ignore")


def _each(batch, one) -> list:
    """The batch, or item by item where it fails; an item that fails is null."""
    try:
        return list(batch())
    except Exception:
        out = []
        for f in one:
            try:
                out.append(f())
            except Exception:
                out.append(None)
        return out


def embed_files(files: DataFrame, make) -> DataFrame:
    """path and vector of files (path, content); `make` builds the embedder once per worker."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            c, p = list(b["content"]), list(b["path"])
            got = _each(lambda c=c, p=p: model.embed_images(c, p), [lambda c=x, p=y: model.embed_images([c], [p])[0] for x, y in zip(c, p, strict=True)])
            yield pd.DataFrame({"path": p, "vector": [None if v is None else np.asarray(v, np.float32) for v in got]})

    return files.select("path", "content").mapInPandas(run, "path string, vector array<float>")


def detect_faces(files: DataFrame, make) -> DataFrame:
    """One row per face of files (path, content)."""
    ship(files.sparkSession)
    cols = ["path", "vector", "x", "y", "w", "h", "det_score", "quality"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            rows = []
            for c, p in zip(b["content"], b["path"], strict=True):
                for f in _each(lambda: model.detect(c, p), []):  # noqa: B023
                    rows.append((p, *(f[k] for k in cols[1:])))
            yield pd.DataFrame(rows, columns=cols)

    return files.select("path", "content").mapInPandas(run, "path string, vector array<float>, x int, y int, w int, h int, det_score float, quality float")


def recognise(files: DataFrame, make, engine: str) -> DataFrame:
    """Text of files (path, content); a failure is an empty text, so that it is not tried for ever."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            got = _each(lambda b=b: [model.extract(c, p) for c, p in zip(b["content"], b["path"], strict=True)], [lambda c=c, p=p: model.extract(c, p) for c, p in zip(b["content"], b["path"], strict=True)])
            yield pd.DataFrame({"path": list(b["path"]), "text": [t or "" for t in got], "failed": [t is None for t in got]})

    return files.select("path", "content").mapInPandas(run, "path string, text string, failed boolean").withColumn("engine", F.lit(engine))


def self_check(model: Embedder, golden: dict[str, list[float]], tolerance: float = 1e-3) -> float:
    """The largest departure from stored vectors of texts; a model beyond the tolerance (2e-2 suits 8-bit weights) is refused."""
    texts = sorted(golden)
    off = float(np.abs(model.embed_texts(texts) - np.array([golden[t] for t in texts])).max()) if texts else 0.0
    if not off <= tolerance:
        raise ValueError(f"vectors depart by {off:.4g}, more than {tolerance:.4g}")
    return off


def load_rgb(content: bytes, max_side: int | None = None) -> np.ndarray:
    """Pixels, upright, as red, green and blue; needs Pillow."""
    import io

    from PIL import Image, ImageOps

    with Image.open(io.BytesIO(content)) as picture:
        upright = ImageOps.exif_transpose(picture).convert("RGB")
    if max_side and max(upright.size) > max_side:
        upright.thumbnail((max_side, max_side))
    return np.asarray(upright)


def phash_pixels(grey: np.ndarray) -> int:
    """64 bits of a 32 x 32 grey picture: the first 8 x 8 coefficients above the median of all but the first; first bit highest, as a signed number.

    The transform is B P B^T with samples in B's rows, frequencies in its columns and
    the first row scaled by 1 / sqrt 2. That is not the textbook cosine transform (which is the
    transpose), but stored hashes are made so, and only equal transforms compare.
    """
    n = len(grey)
    basis = np.cos(np.outer(2 * np.arange(n) + 1, np.arange(n)) * (np.pi / (2 * n)))
    basis[0] /= np.sqrt(2)
    low = (basis[:8] @ grey.astype(float) @ basis[:8].T).ravel()
    bits = low > np.median(low[1:])
    v = int("".join("1" if b else "0" for b in bits), 2)
    return v - (1 << 64) if v >= 1 << 63 else v


def laplacian_variance(grey: np.ndarray) -> float:
    g = grey.astype(float)
    if min(g.shape) < 3:
        return 0.0
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())
