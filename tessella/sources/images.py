"""Image files by their headers alone: width, height and compressed bits a pixel, without decoding."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.lineage import cut, ranked

PNG = b"\x89PNG\r\n\x1a\n"
SIZES = "path string, bytes long, width int, height int, kind string"


def dimensions(read: Callable[[int, int], bytes]) -> tuple[int, int, str] | None:
    """(width, height, kind) of a PNG or JPEG from read(offset, length), or None for other or broken files.

    A PNG says both in its first chunk. In a JPEG the segments before the frame header are skipped by their lengths, so only their heads are read.
    """
    head = read(0, 24)
    if head[:8] == PNG and head[12:16] == b"IHDR" and len(head) == 24:
        return (*struct.unpack(">II", head[16:24]), "png")
    if head[:2] != b"\xff\xd8":
        return None
    at = 2
    while True:
        mark = read(at, 9)
        if len(mark) < 2 or mark[0] != 0xFF:
            return None
        code = mark[1]
        if code == 0xFF:
            at += 1
        elif code == 0x01 or 0xD0 <= code <= 0xD8:
            at += 2
        elif 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            if len(mark) < 9:
                return None
            height, width = struct.unpack(">HH", mark[5:9])
            return width, height, "jpeg"
        elif code in (0xD9, 0xDA) or len(mark) < 4:
            return None
        else:
            at += 2 + struct.unpack(">H", mark[2:4])[0]


def ranged(path: str) -> Callable[[int, int], bytes]:
    system, where = pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")
    file = system.open_input_file(where)

    def read(offset: int, length: int) -> bytes:
        size = file.size()
        return file.read_at(max(0, min(length, size - offset)), offset) if offset < size else b""

    return read


def described(found: tuple[int, int, str] | None) -> tuple:
    return found or (None, None, None)


def sizes(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, bytes, width, height, kind) of the files under a path; null sizes for files that are no PNG or JPEG, or broken. Spark lists no empty files.

    Spark lists the files with their lengths and never reads their content; a task reads a few ranges of each file, over any file
    system that pyarrow opens. For files in other stores use header_sizes() over their content.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", F.col("length").alias("bytes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [described(dimensions(ranged(p))) for p in batch["path"]]
            yield batch.assign(**{n: pd.array([f[i] for f in found], dtype=kind) for i, (n, kind) in enumerate((("width", "Int32"), ("height", "Int32"), ("kind", "string")))})

    # Listing gives few large partitions; reading headers waits on the store, so files are dealt out.
    return files.repartition("path").mapInPandas(run, SIZES)


def header_sizes(files: DataFrame, head: int = 1 << 16) -> DataFrame:
    """(path, bytes, width, height, kind) of (path, content): the first `head` bytes go to Python, and whole files where a JPEG's frame header lies beyond."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for start, rest in zip(batch["start"], batch["rest"], strict=True):
                whole = bytes(start) if start is not None else b""
                one = dimensions(lambda o, n, whole=whole: whole[o : o + n])
                if one is None and rest is not None:
                    whole = bytes(rest)
                    one = dimensions(lambda o, n, whole=whole: whole[o : o + n])
                found.append(described(one))
            out = batch[["path", "bytes"]]
            yield out.assign(**{n: pd.array([f[i] for f in found], dtype=kind) for i, (n, kind) in enumerate((("width", "Int32"), ("height", "Int32"), ("kind", "string")))})

    size = F.length("content").cast("long")
    jpeg = F.hex(F.substring("content", 1, 2)) == "FFD8"
    parts = files.select("path", size.alias("bytes"), F.substring("content", 1, head).alias("start"), F.when(jpeg & (size > head), F.col("content")).alias("rest"))
    return parts.mapInPandas(run, SIZES)


def bits_per_pixel(found: DataFrame) -> DataFrame:
    """Add bpp: 8 * bytes / (width * height), null where a size is unknown or nothing."""
    area = F.col("width").cast("long") * F.col("height")
    return found.withColumn("bpp", F.when(area > 0, F.round(8.0 * F.col("bytes") / area, 9)))


def choose(found: DataFrame, budget: int, keep: str = "high") -> DataFrame:
    """bits_per_pixel() rows (path first) with keep_rank and selected: the most complex files, or with keep="low" the least, by path on ties; unknown ones come last."""
    if keep not in ("high", "low"):
        raise ValueError(f"keep must be high or low, got {keep!r}")
    held = cut(bits_per_pixel(found))
    n = held.count()
    if budget < 0 or budget > n:
        raise ValueError(f"budget={budget} is out of range")
    order = F.desc_nulls_last("bpp") if keep == "high" else F.asc_nulls_last("bpp")
    return ranked(held, [order, F.asc("path")], "keep_rank", n).withColumn("selected", F.col("keep_rank") <= budget)
