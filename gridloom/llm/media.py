"""Media columns: Netpbm and BMP images as numpy arrays, area-resized to NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import bounded_batches, documents

#: A payload's row: 64 RGB samples.
ROW_BYTES = 192
#: A tile is one sample wider than high, for the difference hash.
TILE = (8, 9)
#: Weights of red, green and blue in the grey value, in 1/256: fixed values.
_GREY = (77, 150, 29)
_STRIP = 2048


def payload(text: str | None) -> bytes:
    """UTF-8 with spaces after it, up to a positive multiple of ROW_BYTES; null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (max(1, -(-len(data) // ROW_BYTES)) * ROW_BYTES - len(data))


def encode_ppm(image: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """24 bits a pixel, bottom row first, rows padded to 4 bytes."""
    height, width = image.shape[:2]
    rows = np.zeros((height, -(-width * 3 // 4) * 4), np.uint8)
    rows[:, : width * 3] = image[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHI IiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


_PNM = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\d+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with 8-bit samples: (height, width), or (height, width, 3) for colour. A set bit of P1 and P4 is 0."""
    kind, at, numbers = data[1] - 48, 2, []
    if data[:1] != b"P" or not 1 <= kind <= 6:
        raise ValueError("not a Netpbm image")
    for _ in range(2 if kind in (1, 4) else 3):
        found = _PNM.match(data, at)
        if not found:
            raise ValueError("Netpbm header ends early")
        numbers.append(int(found[1]))
        at = found.end()
    (width, height), most = numbers[:2], numbers[2] if len(numbers) > 2 else 1
    if most > 255:
        raise ValueError("only 8-bit samples are read")
    depth = 3 if kind in (3, 6) else 1
    size = width * height * depth
    if kind == 1:
        samples = np.frombuffer(re.sub(rb"\s|#[^\n]*", b"", data[at:])[:size], np.uint8) - 48
    elif kind in (2, 3):
        samples = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:size], np.uint8)
    elif kind == 4:
        packed = np.frombuffer(data, np.uint8, offset=at + 1, count=height * (-(-width // 8))).reshape(height, -1)
        samples = np.unpackbits(packed, axis=1)[:, :width].reshape(-1)
    else:
        samples = np.frombuffer(data, np.uint8, offset=at + 1, count=size)
    if len(samples) < size:
        raise ValueError("Netpbm samples end early")
    if kind in (1, 4):
        samples = (1 - samples) * np.uint8(255)
    return samples.reshape((height, width, 3) if depth == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed with 8 (palette), 24 or 32 bits a pixel, either row order: (height, width, 3)."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, head, width, height, _, bits, packed = struct.unpack_from("<I IiiHHI", data, 10)
    if bits not in (8, 24, 32) or packed not in (0, 3):
        raise ValueError("only plain BMP with 8, 24 or 32 bits is read")
    stride, rows = -(-width * bits // 32) * 4, abs(height)
    body = np.frombuffer(data, np.uint8, offset=start, count=stride * rows).reshape(rows, stride)[:, : width * bits // 8]
    if height > 0:
        body = body[::-1]
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 4), np.uint8)
        palette[:colours] = np.frombuffer(data, np.uint8, offset=14 + head, count=4 * colours).reshape(-1, 4)
        return palette[body][:, :, 2::-1]
    return body.reshape(rows, width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode(image: np.ndarray) -> bytes:
    """BMP for an odd number of rows, else Netpbm: both formats carry any payload."""
    return encode_bmp(image) if len(image) % 2 else encode_ppm(image)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean grey value under each cell of a height x width grid, from the integral image at the cells' edges.

    The integral is kept at the grid's columns only and built in strips of rows, so that tall images need little memory.
    """
    rows, columns = image.shape[:2]
    across, down = np.arange(width + 1) * columns / width, np.arange(height + 1) * rows / height

    def between(integral: np.ndarray, edge: np.ndarray) -> np.ndarray:
        low = np.minimum(edge.astype(np.int64), len(integral) - 2)
        return integral[low] + (integral[low + 1] - integral[low]) * (edge - low).reshape(-1, *[1] * (integral.ndim - 1))

    sums = np.zeros((rows + 1, width + 1))
    for at in range(0, rows, _STRIP):
        strip = image[at : at + _STRIP].astype(np.int64)
        grey = strip if strip.ndim == 2 else (strip @ np.array(_GREY)) / 256
        integral = np.zeros((columns + 1, len(grey)))
        np.cumsum(grey.T, axis=0, out=integral[1:])
        sums[at + 1 : at + 1 + len(grey)] = between(integral, across).T
    np.cumsum(sums, axis=0, out=sums)
    cells = np.diff(np.diff(between(sums, down), axis=0), axis=1)
    return cells / (rows / height * columns / width)


def tile_of(image: np.ndarray) -> np.ndarray:
    return np.clip(np.round(area_resize(image, *TILE)), 0, 255).astype(np.uint8)


def difference_hash(tile: np.ndarray) -> str:
    """A bit for each neighbour to the right that is brighter, row by row, as hexadecimal digits."""
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, tile, version=(1, 0))
    return out.getvalue()


def _mapped(df: DataFrame, row: Callable, schema: str, passed: int) -> DataFrame:
    """Keeps the first `passed` columns; `row` makes the others of the last column's value."""

    def run(batches):
        for batch in batches:
            made = [row(x.as_py()) for x in batch[batch.num_columns - 1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:passed], *[pa.array([m[k] for m in made], t) for k, t in enumerate(kinds)]], names)

    added = [x.split() for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t] for _, t in added]
    names = [*df.columns[:passed], *[n for n, _ in added]]
    bounded_batches(df.sparkSession)
    out = T.StructType(df.schema.fields[:passed])
    for n, t in added:
        out = out.add(n, t)
    return df.mapInArrow(run, out)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each text's payload as an image of 64 pixels a row, in its file format's bytes.

    Null texts count as empty, which give one row of spaces. Other columns of docs aren't read.
    """

    def row(text):
        data = payload(text)
        size = len((text or "").encode("utf-8", "surrogatepass"))
        return size, encode(np.frombuffer(data, np.uint8).reshape(-1, ROW_BYTES // 3, 3))

    fed = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _mapped(fed, row, "n_bytes long, media binary", 1)


def read(stored: DataFrame) -> DataFrame:
    """Of id, n_bytes, media: adds what the stored bytes give, decoded: payload_bytes, payload_sha256, tail_crc32,
    tile (an NPY file) and difference_hash."""

    def row(data):
        image = decode(data)
        back = image.tobytes()
        tile = tile_of(image)
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), npy(tile), difference_hash(tile)

    fed = stored.select("id", "n_bytes", "media", F.col("media").alias("_media"))
    return _mapped(fed, row, "payload_bytes long, payload_sha256 string, tail_crc32 long, tile binary, difference_hash string", 3)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(store(documents(spark, sf_dir)))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("dhash:"), "difference_hash").alias("feature"), F.sha2("tile", 256).alias("tile_sha256"),
    )
