"""Media columns: Netpbm and BMP in a binary column, decoded to numpy arrays.

decode() reads P1 to P6 with 8-bit samples and uncompressed BMP of 8, 24 or 32 bits. resize() averages
areas by an integral image (a summed-area table), with exact fractions of pixels at the edges of an area.
dhash() compares horizontal neighbours of a 9 x 8 picture. tiles() writes an array as NPY tiles, each with
its difference hash.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import flat, map_text

#: Payloads are filled up to a multiple of this: rows of 24 grey or 8 colour pixels make whole pictures.
UNIT = 576
KINDS = ("pgm", "ppm", "bmp")


def encode(pixels: np.ndarray, kind: str) -> bytes:
    """uint8 (h, w) as pgm, (h, w, 3) RGB as ppm or bmp (24 bits, bottom row first)."""
    h, w = pixels.shape[:2]
    if kind == "pgm":
        return b"P5\n%d %d\n255\n" % (w, h) + pixels.tobytes()
    if kind == "ppm":
        return b"P6\n%d %d\n255\n" % (w, h) + pixels.tobytes()
    if kind == "bmp":
        pad = -3 * w % 4
        rows = np.zeros((h, 3 * w + pad), np.uint8)
        rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
        return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()
    raise ValueError(f"no such format: {kind}")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1] - 48, 2, []
    while len(head) < (2 if kind in (1, 4) else 3):
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken header")
        head.append(int(data[at:end]))
        at = end
    w, h = head[:2]
    deep = 3 if kind in (3, 6) else 1
    if len(head) > 2 and not 0 < head[2] < 256:
        raise ValueError("samples of more than 8 bits")
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, h * (-(-w // 8)), at + 1).reshape(h, -1), axis=1)[:, :w]
        return (1 - bits).astype(np.uint8) * 255
    if kind == 1:
        bits = np.frombuffer(data[at:], np.uint8)
        bits = bits[(bits == 48) | (bits == 49)][: w * h] - 48
        return (1 - bits.reshape(h, w)).astype(np.uint8) * 255
    samples = np.array(data[at:].split()[: w * h * deep], np.int64).astype(np.uint8) if kind in (2, 3) else np.frombuffer(data, np.uint8, w * h * deep, at + 1)
    return samples.reshape((h, w, 3) if deep == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    begin, = struct.unpack_from("<I", data, 10)
    size, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24, 32) or w <= 0:
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * stride, begin).reshape(abs(h), stride)[:: -1 if h > 0 else 1]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, begin - 14 - size, 14 + size).reshape(-1, 4)[:, 2::-1]
        return palette[rows[:, :w]]
    return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """uint8 (h, w) for grey and bitmaps, (h, w, 3) RGB else. Bitmaps: 0 is black. ValueError for anything else."""
    if data[:1] == b"P" and data[1:2] in b"123456" and data[1:2]:
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma in integers: (299 R + 587 G + 114 B) / 1000, rounded down."""
    return pixels if pixels.ndim == 2 else ((pixels.astype(np.int64) * (299, 587, 114)).sum(-1) // 1000).astype(np.uint8)


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means of a grey picture, as float64, for larger and smaller sizes alike."""
    h, w = pixels.shape
    table = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(pixels, axis=0, dtype=np.float64), axis=1, out=table[1:, 1:])

    def lines(t, n, m):  # the table at the edges of m equal parts of n lines: linear between its lines
        at = np.arange(m + 1) * n / m
        low = np.minimum(at.astype(np.int64), n - 1)
        part = (at - low)[:, None]
        return t[low] * (1 - part) + t[low + 1] * part

    edges = lines(lines(table, h, height).T, w, width).T
    area = edges[1:, 1:] - edges[:-1, 1:] - edges[1:, :-1] + edges[:-1, :-1]
    return area * (height * width / (h * w))


def dhash(pixels: np.ndarray) -> str:
    """64 bits, in hex: is a pixel of the 9 x 8 picture (rounded to 1/256) brighter than its right neighbour?"""
    small = np.rint(resize(grey(pixels), 8, 9) * 256).astype(np.int64)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def cut(pixels: np.ndarray, side: int = 256) -> list[dict]:
    """Tiles of at most side x side pixels in row order: top, left, npy (bytes), dhash."""
    h, w = pixels.shape[:2]
    return [{"top": y, "left": x, "npy": npy(t := pixels[y : y + side, x : x + side]), "dhash": dhash(t)} for y in range(0, h, side) for x in range(0, w, side)]


def joined(tiles: list[dict], shape: tuple[int, ...]) -> np.ndarray:
    """The picture of a list of tiles, read back from their NPY bytes."""
    out = np.zeros(shape, np.uint8)
    for t in tiles:
        part = np.load(io.BytesIO(t["npy"]), allow_pickle=False)
        out[t["top"] : t["top"] + len(part), t["left"] : t["left"] + part.shape[1]] = part
    return out


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def store(text: bytes) -> bytes:
    """A text's payload as a picture, format by its checksum: pgm of 24 columns, ppm or bmp of 8."""
    data = payload(text)
    kind = KINDS[zlib.crc32(data) % len(KINDS)]
    flat_ = np.frombuffer(data, np.uint8)
    return encode(flat_.reshape(-1, 24) if kind == "pgm" else flat_.reshape(-1, 8, 3), kind)


def pictures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text, in UTF-8, kept as a picture.

    Null counts as empty; an empty text is 576 bytes of 255. Equal texts make equal pictures. Repeated
    documents have a picture each.
    """

    def make():
        def of(part):
            data, at = flat(part.column("body"))
            raw = data.tobytes()
            return [pa.array(at[1:] - at[:-1], pa.int64()), pa.array([store(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())]

        return of

    return map_text(docs, text_col, [id_col], "n_bytes long, media binary", make)


def _map_media(media: DataFrame, keep: list[str], media_col: str, out: str, make) -> DataFrame:
    from pyspark.sql.types import StructType, _parse_datatype_string

    columns = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    inner = media.select(*columns, F.col(media_col).alias("media_bytes_"))
    schema = StructType([*inner.schema.fields[:-1], *_parse_datatype_string(out).fields])
    names = [f.name for f in schema.fields]

    def run(batches):
        f = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *f(b.column(len(keep)))], names=names)

    return inner.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names[len(keep) :])


def tiles(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", side: int = 256) -> DataFrame:
    """(id, height, width, channels, tiles): pictures as NPY tiles with difference hashes; 0 x 0 and no tiles
    for null. A broken or other format raises ValueError: bytes are never dropped in silence."""

    def make():
        def of(column):
            shape, out = [], []
            for x in column.to_pylist():
                p = decode(x) if x is not None else np.zeros((0, 0), np.uint8)
                shape.append((*p.shape, 1)[:3])
                out.append(cut(p, side))
            tile = pa.list_(pa.struct([("top", pa.int32()), ("left", pa.int32()), ("npy", pa.binary()), ("dhash", pa.string())]))
            return [*(pa.array([s[i] for s in shape], pa.int32()) for i in range(3)), pa.array(out, tile)]

        return of

    return _map_media(media, [id_col], media_col, "height int, width int, channels int, tiles array<struct<top: int, left: int, npy: binary, dhash: string>>", make)


def features(media: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ("n_bytes",), media_col: str = "media", side: int = 256) -> DataFrame:
    """Decodes stored pictures, cuts them into NPY tiles and reads these back: payload_bytes, payload_sha256, tail_crc32 (of
    the last 32 bytes), media_bytes, media_sha256, feature (height x width x channels, then the difference hash of the
    whole picture), tiles (their number) and tile_hashes (of the tiles' difference hashes, one after the other, the SHA-256).

    A null picture has null features; equal pictures have equal ones, repeated rows a row each; an empty table stays empty. A
    broken or other format raises ValueError."""

    def make():
        def of(column):
            rows = []
            for x in column.to_pylist():
                if x is None:
                    rows.append((None,) * 8)
                    continue
                decoded = decode(x)
                parts = cut(decoded, side)
                pixels = joined(parts, decoded.shape)
                back = pixels.tobytes()
                hashes = hashlib.sha256("".join(t["dhash"] for t in parts).encode()).hexdigest()
                h, w, c = (*pixels.shape, 1)[:3]
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(x), hashlib.sha256(x).hexdigest(), f"{h}x{w}x{c}:{dhash(pixels)}", len(parts), hashes))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

        return of

    return _map_media(media, [id_col, *keep], media_col, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tiles long, tile_hashes string", make)


def op2_media_columns(spark, sf_dir: str) -> DataFrame:
    """All whole texts as pgm, ppm or bmp, read back through NPY tiles."""
    return features(pictures(spark.read.parquet(f"{sf_dir}/documents.parquet")))
