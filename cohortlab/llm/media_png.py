"""Media columns: payloads kept losslessly as PNG in a binary column, and perceptual features computed from them.

Writing: 8-bit grey samples, rows of ``width`` bytes, per-row filter chosen by the least sum of absolute differences
among None, Sub and Up, one zlib stream cut into IDAT chunks, CRC-32 in every chunk. Reading: every chunk's CRC-32 and
the stream's Adler-32 are tested, the rows are unfiltered in numpy (all five filters). The feature is a hash of the
low-frequency coefficients of a 2-D cosine transform of the picture, scaled to 32 x 32 by box means.

Filtering, compressing and inflating go in stripes of rows, so that a long text takes a task a few times its own bytes and
no more; batches are cut by bytes.

Defined cases: a null or empty text is a payload of ``width`` zero bytes; equal texts give equal stored bytes and
features, rows that repeat are stored each; coefficients that tie with the median count as below it; a very long text is
one picture, whole; an empty table gives an empty table; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_bytes, save, utf8

WIDTH = 64
IDAT_BYTES = 1 << 16
#: Rows that are filtered, compressed or inflated at once; bytes of a batch.
STRIPE, BATCH_BYTES = 1 << 14, 1 << 23
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_IHDR = struct.Struct(">IIBBBBB")


class PngError(ValueError):
    """The bytes are no intact PNG of the kind that is read here."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _filtered(rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Rows with a filter byte in front, each by the cheapest of None, Sub and Up; ``above`` is the row before them."""
    h, w = rows.shape
    kinds = np.empty((3, h, w), np.uint8)
    kinds[0] = rows
    kinds[1, :, 0] = rows[:, 0]
    np.subtract(rows[:, 1:], rows[:, :-1], out=kinds[1, :, 1:])
    np.subtract(rows[0], above, out=kinds[2, 0])
    np.subtract(rows[1:], rows[:-1], out=kinds[2, 1:])
    cost = np.abs(kinds.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    out = np.empty((h, w + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = kinds[best, np.arange(h)]
    return out


def encode_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """``payload``, whose length is a positive multiple of ``width``, as an 8-bit grey PNG."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    packer, stream = zlib.compressobj(level), bytearray()
    for y in range(0, len(rows), STRIPE):
        stream += packer.compress(_filtered(rows[y : y + STRIPE], rows[y - 1] if y else np.zeros(width, np.uint8)).tobytes())
    stream += packer.flush()
    parts = [_SIGNATURE, _chunk(b"IHDR", _IHDR.pack(width, len(rows), 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", bytes(stream[i : i + IDAT_BYTES])) for i in range(0, len(stream), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _by_diagonals(kind: int, rows: np.ndarray, above: np.ndarray, out: np.ndarray) -> None:
    """Undo Average (3) or Paeth (4) in a run of rows: a sample needs its left, upper and upper left neighbours, so all
    samples of a diagonal, one row down and one column back each, are done at once."""
    h, w = rows.shape
    done = np.zeros((h + 1, w + 1), np.int16)  # with the row above and a column of zeros to the left
    done[0, 1:] = above
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner = done[y + 1, x], done[y, x + 1], done[y, x]
        if kind == 3:
            guess = (left + up) >> 1
        else:
            p = left + up - corner
            pa, pb, pc = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
            guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
        done[y + 1, x + 1] = (rows[y, x] + guess) & 255
    out[:] = done[1:, 1:]


def unfilter(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray | None = None) -> np.ndarray:
    """Undo PNG's row filters for one byte a pixel, run by run of rows with the same filter; ``above`` is the row before."""
    out = np.empty_like(rows)
    above = np.zeros(rows.shape[1], np.uint8) if above is None else above
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for start, end in zip([0, *cuts], [*cuts, len(kinds)], strict=True):
        kind, part = int(kinds[start]), rows[start:end]
        if kind == 0:
            out[start:end] = part
        elif kind == 1:
            np.cumsum(part, axis=1, dtype=np.uint8, out=out[start:end])
        elif kind == 2:
            np.cumsum(part, axis=0, dtype=np.uint8, out=out[start:end])
            out[start:end] += above
        elif kind in (3, 4):
            _by_diagonals(kind, part.astype(np.int16), above, out[start:end])
        else:
            raise PngError(f"unknown filter {kind}")
        above = out[end - 1]
    return out


def _inflated(parts: list[bytes], height: int, width: int) -> np.ndarray:
    """The samples of the zlib stream, inflated and unfiltered a stripe at a time; tests its Adler-32 and its length."""
    out, y, held, unpacker = np.empty((height, width), np.uint8), 0, b"", zlib.decompressobj()
    for i, part in enumerate(parts):
        while part or i + 1 == len(parts):
            held += unpacker.decompress(part, STRIPE * (width + 1))
            part = unpacker.unconsumed_tail
            n = len(held) // (width + 1)
            if y + n > height:
                raise PngError("wrong number of samples")
            if n:
                raw = np.frombuffer(held, np.uint8, n * (width + 1)).reshape(n, width + 1)
                out[y : y + n] = unfilter(raw[:, 0], raw[:, 1:], out[y - 1] if y else None)
                y, held = y + n, held[n * (width + 1) :]
            if not part:
                break
    if not unpacker.eof or held or y != height or unpacker.unused_data:
        raise PngError("wrong number of samples")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG, height x width. Raises :class:`PngError` on any damage."""
    if data[:8] != _SIGNATURE:
        raise PngError("no PNG signature")
    at, header, idat, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise PngError("a chunk is cut short")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data) or zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise PngError(f"chunk {kind!r}: checksum differs")
        if kind == b"IHDR":
            header = _IHDR.unpack(body)
        elif kind == b"IDAT":
            idat.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if header is None or not ended:
        raise PngError("no header or no end")
    width, height, *rest = header
    if rest != [8, 0, 0, 0, 0]:
        raise PngError("only 8-bit grey without interlacing is read")
    try:
        return _inflated(idat, height, width)
    except zlib.error as e:
        raise PngError(str(e)) from e


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (np.arange(n) + 0.5)[None, :] * np.arange(k)[:, None] / n)


_SIDE, _LOW = 32, 8
_COS = _cosines(_SIDE, _LOW)


def _box_means(a: np.ndarray, side: int) -> np.ndarray:
    """Scale axis 0 to ``side``: means of boxes, or repeated rows where there are fewer."""
    edges = np.arange(side + 1) * len(a) / side
    lo = np.minimum(edges[:-1].astype(np.int64), len(a) - 1)
    hi = np.maximum(np.ceil(edges[1:]).astype(np.int64), lo + 1)
    if len(a) > STRIPE:  # running sums take eight times the samples; sums of bytes are exact either way
        return np.array([a[x:y].sum(axis=0, dtype=np.float64) / (y - x) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
    sums = np.concatenate([np.zeros((1, a.shape[1])), np.cumsum(a, axis=0, dtype=np.float64)])
    return (sums[hi] - sums[lo]) / (hi - lo)[:, None]


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients exceed their median (the mean level, coefficient 0,0,
    does not count towards it). Ties with the median are 0."""
    small = _box_means(_box_means(samples, _SIDE).T, _SIDE).T
    low = np.round((_COS @ small @ _COS.T).ravel(), 6)
    return np.packbits(low > np.median(low[1:])).tobytes()


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, level: int = 6) -> DataFrame:
    """``id, n_bytes, media``: the UTF-8 text, filled up with zero bytes to a multiple of ``width``, as PNG."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["t"].tolist()
            for a, z in by_bytes([len(t) for t in texts], BATCH_BYTES):
                media = [encode_png(t + bytes((-len(t)) % width or (0 if t else width)), width, level) for t in texts[a:z]]
                yield pd.DataFrame({"id": b["id"].iloc[a:z].reset_index(drop=True), "n_bytes": [len(t) for t in texts[a:z]], "media": media})

    return df.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("t")).mapInPandas(encode, "id long, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """What the stored pictures hold, from their bytes alone: payload digests and the cosine hash."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for media in b["media"]:
                samples = decode_png(media)
                payload, h = samples.tobytes(), cosine_hash(samples)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), h.hex(), h))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "feature_bits"]
            yield pd.concat([b[["id", "n_bytes"]].reset_index(drop=True), pd.DataFrame(out, columns=names, dtype=object)], axis=1)

    return stored.mapInPandas(read, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, feature_bits binary")


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts as a table of PNG columns in the shared folder, read it back and compute the features."""
    return features(save(store(df, id_col, text_col), "media")).withColumnRenamed("id", id_col)
