"""Media columns: Netpbm and BMP images as numpy arrays, tiles and hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import slices, string_of, written
from weftgraph.llm.segments import column_bytes

#: Bytes of one row of the images that carry payloads: 64 pixels of 3 samples.
ROW_BYTES = 192
#: Payload images of more rows are stored as BMP, others as Netpbm.
TALL = 8
#: Side of the tiles of payload images.
TILE = 16


class ImageError(ValueError):
    """Bytes that are no image of a kind that is read here."""


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """Numbers of a Netpbm header (comments skipped), and where samples start."""
    values, at = [], 2
    while len(values) < fields:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data) if data[at : at + 1] == b"#" else at + 1
        stop = at
        while data[stop : stop + 1].isdigit():
            stop += 1
        if stop == at:
            raise ImageError("header")
        values.append(int(data[at:stop]))
        at = stop
    return values, at + 1


def read_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 (height, width, channels); bitmaps as 0 and 255.

    Samples with another maximum than 255 are scaled to it.
    """
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ImageError("not Netpbm")
    bitmap, channels = kind in b"P1 P4", 3 if kind in b"P3 P6" else 1
    values, at = _header(data, 2 if bitmap else 3)
    width, height, most = values[0], values[1], 1 if bitmap else values[2]
    if not (0 < most < 65536):
        raise ImageError("maximum")
    count = width * height * channels
    if kind == b"P1":
        samples = np.frombuffer(bytes(c for c in data[at - 1 :] if c in b"01"), dtype=np.uint8)[:count] - 48
    elif kind in (b"P2", b"P3"):
        samples = np.array(data[at - 1 :].split()[:count], dtype=np.int64)
    elif kind == b"P4":
        row = (width + 7) // 8
        packed = np.frombuffer(data, dtype=np.uint8, count=min(row * height, len(data) - at), offset=at)
        if len(packed) < row * height:
            raise ImageError("samples are missing")
        samples = np.unpackbits(packed.reshape(height, row), axis=1)[:, :width].ravel()
    else:
        wide = 2 if most > 255 else 1
        if len(data) - at < count * wide:
            raise ImageError("samples are missing")
        samples = np.frombuffer(data, dtype=">u2" if wide == 2 else np.uint8, count=count, offset=at)
    if len(samples) < count:
        raise ImageError("samples are missing")
    if bitmap:
        samples = (1 - samples) * 255
    elif most != 255:
        samples = (samples.astype(np.int64) * 255 + most // 2) // most
    return samples.astype(np.uint8, copy=False).reshape(height, width, channels)


def write_netpbm(image: np.ndarray) -> bytes:
    height, width, channels = image.shape
    return b"P%d\n%d %d\n255\n" % (6 if channels == 3 else 5, width, height) + image.tobytes()


def read_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits as uint8 RGB."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ImageError("not BMP")
    start, head, width, height, _, bits, packed = struct.unpack_from("<I I i i H H I", data, 10)
    if packed or bits not in (8, 24, 32) or width <= 0 or not height:
        raise ImageError("kind of BMP")
    rows, row = abs(height), (width * bits // 8 + 3) // 4 * 4
    if len(data) < start + rows * row:
        raise ImageError("samples are missing")
    samples = np.frombuffer(data, dtype=np.uint8, count=rows * row, offset=start).reshape(rows, row)[:, : width * bits // 8]
    if height > 0:
        samples = samples[::-1]
    if bits == 8:
        colours = (start - 14 - head) // 4
        palette = np.frombuffer(data, dtype=np.uint8, count=4 * colours, offset=14 + head).reshape(colours, 4)[:, 2::-1]
        if len(samples) and samples.max() >= colours:
            raise ImageError("palette")
        return palette[samples]
    return np.ascontiguousarray(samples.reshape(rows, width, bits // 8)[:, :, 2::-1])


def write_bmp(image: np.ndarray) -> bytes:
    height, width, _ = image.shape
    row = (width * 3 + 3) // 4 * 4
    body = np.zeros((height, row), dtype=np.uint8)
    body[:, : width * 3] = image[::-1, :, ::-1].reshape(height, width * 3)
    return struct.pack("<2sIHHI IiiHHIIiiII", b"BM", 54 + body.size, 0, 0, 54, 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def read_image(data: bytes) -> np.ndarray:
    return read_bmp(data) if data[:2] == b"BM" else read_netpbm(data)


def _edges(old: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(new + 1, dtype=np.int64) * old
    return at // new, at % new


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over areas (rounded half up), in whole numbers throughout.

    The integral image is read at the corners of each target pixel; corners
    between samples are interpolated, which is exact, as a sample is constant
    over its area.  Works for smaller and larger sizes.  Of the integral image
    only the rows at target edges are held, so memory follows the target.
    """
    old_h, old_w, channels = image.shape
    at, part = _edges(old_h, height)
    held = np.unique(np.concatenate([at, np.minimum(at + 1, old_h)]))  # from 0 to old_h
    total = np.zeros((len(held), old_w + 1, channels), dtype=np.int64)
    np.cumsum(np.add.reduceat(image, held[:-1], axis=0, dtype=np.int64), axis=0, out=total[1:, 1:])
    low, high = total[np.searchsorted(held, at)], total[np.searchsorted(held, np.minimum(at + 1, old_h))]
    rows = np.cumsum(low * height + part[:, None, None] * (high - low), axis=1)
    at, part = _edges(old_w, width)
    both = rows[:, at] * width + part[None, :, None] * (rows[:, np.minimum(at + 1, old_w)] - rows[:, at])
    areas = both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]
    whole = old_h * old_w
    return ((2 * areas + whole) // (2 * whole)).astype(np.uint8)


def grey(image: np.ndarray) -> np.ndarray:
    """One channel by the weights 77, 150 and 29 of 256."""
    if image.shape[2] == 1:
        return image
    return ((image.astype(np.int64) @ np.array([77, 150, 29]) + 128) >> 8).astype(np.uint8)[:, :, None]


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 9 area means is below the next.

    The means are taken before the channels are mixed: that is less to mix.
    """
    small = grey(area_resize(image, 8, 9))[:, :, 0].astype(np.int16)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_bytes(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, tile, version=(1, 0), allow_pickle=False)
    return out.getvalue()


def media_tiles(frame: DataFrame, bytes_col: str, id_col: str, height: int = 32, width: int = 32) -> DataFrame:
    """Decodes a column of image bytes: one row per row of ``frame``.

    Columns: id, ``height``, ``width``, ``channels`` of the image, ``tile``
    (NPY bytes of the resized image), ``dhash`` and ``error``.  Null bytes and
    bytes that are no image give nulls and the reason in ``error``.  Narrow.
    """
    kind = frame.schema[id_col].dataType.simpleString()
    picked = frame.select(F.col(id_col).alias("id"), F.col(bytes_col).alias("media"))
    names = ["height", "width", "channels", "tile", "dhash", "error"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None, None, None, None, None, "null")
        try:
            image = read_image(data)
            if not image.size:
                raise ImageError("no samples")
        except (ValueError, IndexError, struct.error) as e:
            return (None, None, None, None, None, str(e) or "broken")
        return (*image.shape, npy_bytes(area_resize(image, height, width)), difference_hash(image), None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media"):
            cols = zip(*map(one, string_of(part, "media").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([string_of(part, "id"), *(pa.array(c, type=t) for c, t in zip(cols, types, strict=True))], ["id", *names])

    return picked.mapInArrow(run, f"id {kind}, height int, width int, channels int, tile binary, dhash string, error string").withColumnRenamed("id", id_col)


def write_tiles(frame: DataFrame, path: str, bytes_col: str, id_col: str, height: int = 32, width: int = 32) -> None:
    """Writes the rows of ``media_tiles`` as Parquet."""
    media_tiles(frame, bytes_col, id_col, height, width).write.parquet(path)


def payload_image(text: bytes) -> np.ndarray:
    """Bytes as rows of 64 RGB pixels, filled up with spaces."""
    rows = max(1, -(-len(text) // ROW_BYTES))
    return np.frombuffer(text.ljust(rows * ROW_BYTES), dtype=np.uint8).reshape(rows, ROW_BYTES // 3, 3)


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) of each text: its payload as a Netpbm or BMP image.

    A null text is empty; an empty one is a single row of spaces.  Equal texts
    have equal images; the pass is narrow.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = column_bytes(string_of(part, "text"))
            images = (payload_image(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True))
            media = [write_bmp(x) if len(x) > TALL else write_netpbm(x) for x in images]
            yield pa.RecordBatch.from_arrays([string_of(part, "id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(media, type=pa.binary())], ["id", "n_bytes", "media"])

    return picked.mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def payload_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored as images in the shared folder, read back, and described.

    Columns: id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature (difference hash, and the digest of the
    NPY tile).  A null text is empty; an empty one is a single row of spaces.
    Equal texts have equal values; all rows are kept; both passes are narrow.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    stored = written(store_payloads(docs, id_col, text_col), "media", compression="zstd")
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(n_bytes: int, media: bytes) -> tuple:
        image = read_image(media)
        payload = image.tobytes()
        tile = npy_bytes(area_resize(image, TILE, TILE))
        feature = f"{difference_hash(image)}-{hashlib.sha256(tile).hexdigest()}"
        return (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media"):
            cols = zip(*map(one, string_of(part, "n_bytes").to_pylist(), string_of(part, "media").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([string_of(part, "id"), *(pa.array(c, type=t) for c, t in zip(cols, types, strict=True))], ["id", *names])

    out = stored.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("id", id_col)
