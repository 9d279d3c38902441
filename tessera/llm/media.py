"""Media columns: payloads stored losslessly as progressive JPEG coefficients, and progressive JPEG decoded to RGB tensors.

A payload's bytes become quantised DCT coefficients, the unit of the format (one byte each, quantiser 1), of a 4:2:0 YCbCr image
in 8 x 8 blocks of zigzag order: four blocks in luma to one in each chroma. The file has these scans, each of one component:
DC first (Al=1, one block per restart interval), AC 1-5 first and AC 6-63 first (Al=1), DC refinement, AC 1-63 refinement (Al=0).
A byte's upper seven bits are the magnitude bits of a category 7 value, its lowest bit is the refinement bit, so each
coefficient is non-zero and every scan has a fixed layout that numpy reads and writes whole; a COM segment names the length.

The decoder accumulates the scans of any progressive JPEG of 8-bit samples in coefficient arrays (scans of the layout above as
arrays, others bit by bit), dequantises, inverse-transforms with one matrix product, upsamples chroma by replication and
stores full-resolution RGB tensors: a binary column of height x width x 3 samples beside its height and width. Features are
computed from the tensor's bytes, in the step that makes them.

Defined results: a null text is empty; an empty payload is one unit of 576 bytes of 255; repeated rows stay; an empty table gives
an empty result; extra columns are ignored. A tensor has two bytes for each of the payload and must fit into a binary value, so a
payload may have up to MOST bytes, and a longer one is an error that names it; rows are handled in slices of bounded bytes.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_of, column, table

UNIT = 576
WIDEST = 4095  # MCUs in a row or column: 65,520 samples
MOST = (1 << 30) - (1 << 20)
SLICE = 2_000_000  # payload bytes whose coefficients stand in memory at once, but for one longer row

# Zigzag order and the ITU-R BT.601 weights of JFIF.
ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)
TO_RGB = np.array([[1, 0, 1.402], [1, -0.344136, -0.714136], [1, 1.772, 0]], np.float32)


def _basis() -> np.ndarray:
    """64 x 64: zigzag coefficients to samples in rows."""
    k = np.arange(8)
    one = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)[:, None]
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG].astype(np.float32)


BASIS = _basis()


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _huffman(kind: int, ident: int, lengths: dict[int, list[int]]) -> bytes:
    return segment(0xC4, bytes([kind << 4 | ident]) + bytes(len(lengths.get(n, [])) for n in range(1, 17)) + b"".join(bytes(lengths[n]) for n in sorted(lengths)))


def _scan(component: int, first: int, last: int, high: int, low: int, ac: int, data: bytes) -> bytes:
    return segment(0xDA, bytes([1, component, ac, first, last, high << 4 | low])) + data


def _bits(bits: np.ndarray) -> bytes:
    """Packed, padded with ones, and a zero byte after each 255."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")


def _number(n: int, width: int) -> list[int]:
    return [n >> i & 1 for i in range(width - 1, -1, -1)]


LONGEST_RUN = 32767
MARKER = re.compile(b"\xff[^\x00\xff]", re.DOTALL)
TABLES = _huffman(0, 0, {1: [7]}) + _huffman(1, 0, {1: [7]}) + _huffman(1, 1, {4: [r << 4 for r in range(15)]})


def geometry(size: int) -> tuple[int, int]:
    """MCUs in a row and in a column that hold so many bytes."""
    if size > MOST:
        raise ValueError(f"{size} bytes do not fit into one image")
    units = max(1, -(-size // 384))
    across = min(units, WIDEST)
    return across, -(-units // across)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload."""
    across, down = geometry(len(payload))
    n = across * down
    flat = np.full(n * 384, 255, np.uint8)
    flat[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = flat.reshape(-1, 64)
    planes = [blocks[: 4 * n], blocks[4 * n : 5 * n], blocks[5 * n :]]
    frame = struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", segment(0xFE, b"payload %d" % len(payload)), segment(0xDB, b"\0" + b"\1" * 64), segment(0xC2, frame), TABLES]
    out.append(segment(0xDD, b"\0\1"))
    for c, plane in enumerate(planes, 1):
        dc = np.full((len(plane), 3), 255, np.uint8)
        dc[:, 0] = plane[:, 0] >> 1
        dc[:, 2] = 0xD0 + np.arange(len(plane)) % 8
        out.append(_scan(c, 0, 0, 0, 1, 0, dc.tobytes()[:-2]))
    out.append(segment(0xDD, b"\0\0"))
    for first, last in ((1, 5), (6, 63)):
        out += [_scan(c, first, last, 0, 1, 0, (plane[:, first : last + 1] >> 1).tobytes()) for c, plane in enumerate(planes, 1)]
    for c, plane in enumerate(planes, 1):
        low = plane & 1
        out.append(_scan(c, 0, 0, 1, 0, 0, _bits(low[:, 0])))
        bits = []
        for i in range(0, len(plane), LONGEST_RUN):
            run = min(LONGEST_RUN, len(plane) - i)
            r = run.bit_length() - 1
            bits += [np.array(_number(r, 4) + _number(run - (1 << r), r), np.uint8), low[i : i + run, 1:].ravel()]
        out.append(_scan(c, 1, 63, 1, 0, 1, _bits(np.concatenate(bits))))
    return b"".join([*out, b"\xff\xd9"])


class Component:
    def __init__(self, ident: int, across: int, down: int, table: int):
        self.ident, self.across, self.down, self.table = ident, across, down, table
        self.coefficients = np.zeros((0, 64), np.int16)


class BitReader:
    """Bits of entropy-coded data without stuffing; ones after the end."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bit(self) -> int:
        i, self.at = self.at >> 3, self.at + 1
        return self.data[i] >> (8 - self.at & 7) & 1 if i < len(self.data) else 1

    def bits(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code, length = 0, 0
        while length < 16:
            code, length = code << 1 | self.bit(), length + 1
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such code")

    def signed(self, n: int) -> int:
        v = self.bits(n)
        return v if n == 0 or v >> n - 1 else v - (1 << n) + 1


def _codes(body: bytes) -> Iterator[tuple[int, dict[tuple[int, int], int]]]:
    at = 0
    while at < len(body):
        ident, counts = body[at], body[at + 1 : at + 17]
        at, code, codes = at + 17, 0, {}
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                codes[length, code] = body[at]
                at, code = at + 1, code + 1
            code <<= 1
        yield ident, codes


def _one_byte_intervals(media: bytes, at: int, n: int) -> tuple[list[bytes], int]:
    """All restart intervals but the last, and where the last begins, if each is one byte; else none."""
    if n > 1 and at + 3 * n <= len(media):
        a = np.frombuffer(media, np.uint8, 3 * (n - 1), at).reshape(-1, 3)
        if (a[:, 0] < 255).all() and (a[:, 1] == 255).all() and (a[:, 2] == 0xD0 + np.arange(n - 1) % 8).all():
            return [media[i : i + 1] for i in range(at, at + 3 * (n - 1), 3)], at + 3 * (n - 1)
    return [], at


def _whole(parts: list[bytes], comps: list[Component], band: tuple[int, int], high: int, low: int, codes: dict) -> bool:
    """Reads a scan of the fixed layout as arrays; False if it has another."""
    if len(comps) != 1:
        return False
    comp, (first, last) = comps[0], band
    c, n = comp.coefficients, len(comp.coefficients)
    if high == 0 and codes == {(1, 0): 7}:
        if first == 0 and len(parts) == n and all(len(p) == 1 for p in parts):
            e = np.frombuffer(b"".join(parts), np.uint8)[:, None]
        elif first and len(parts) == 1 and len(parts[0]) == n * (last - first + 1):
            e = np.frombuffer(parts[0], np.uint8).reshape(n, -1)
        else:
            return False
        if (e > 127).any():
            return False
        v = e.astype(np.int16)
        c[:, first : last + 1] = np.where(v >= 64, v, v - 127) << low if first == 0 else np.where(v >= 64, v << low, -((127 - v) << low))
        return True
    if high and len(parts) == 1:
        if first == 0:
            c[:, 0] |= np.unpackbits(np.frombuffer(parts[0], np.uint8), count=n).astype(np.int16) << low
            return True
        if (c[:, first : last + 1] == 0).any():
            return False
        reader, done, found = BitReader(parts[0]), 0, []
        raw = np.unpackbits(np.frombuffer(parts[0], np.uint8))
        while done < n:
            s = reader.symbol(codes)
            if s & 15 or s == 0xF0:
                return False
            run = min((1 << (s >> 4)) + reader.bits(s >> 4), n - done)
            found.append(raw[reader.at : reader.at + run * (last - first + 1)])
            reader.at, done = reader.at + run * (last - first + 1), done + run
        band_bits = np.concatenate(found).reshape(n, -1).astype(np.int16) << low
        part = c[:, first : last + 1]
        c[:, first : last + 1] = np.where(part > 0, part + band_bits, part - band_bits)
        return True
    return False


def _bitwise(part: bytes, order: list[tuple[int, Component, int]], band: tuple[int, int], high: int, low: int, dc: dict, ac: dict) -> None:
    """Reads one restart interval bit by bit. order: component number, component and block for each block in turn."""
    r, (first, last), run, before = BitReader(part), band, 0, {}
    for k, comp, i in order:
        c = comp.coefficients[i]
        if first == 0:
            if high:
                c[0] |= r.bit() << low
            else:
                before[k] = before.get(k, 0) + r.signed(r.symbol(dc[k]))
                c[0] = before[k] << low
            continue
        at = first
        if run == 0:
            while at <= last:
                s = r.symbol(ac[k])
                zeros, size = s >> 4, s & 15
                if size == 0 and zeros < 15:
                    run = (1 << zeros) + r.bits(zeros)
                    break
                if high == 0:
                    at += zeros
                    if size:
                        c[at] = r.signed(size) * (1 << low)
                    at += 1
                    continue
                value = (1 if r.bit() else -1) << low if size else 0
                while at <= last:
                    if c[at]:
                        if r.bit():
                            c[at] += (1 << low) if c[at] > 0 else -(1 << low)
                    elif zeros == 0:
                        c[at] = value
                        at += 1
                        break
                    else:
                        zeros -= 1
                    at += 1
        if run:
            if high:
                for j in range(at, last + 1):
                    if c[j] and r.bit():
                        c[j] += (1 << low) if c[j] > 0 else -(1 << low)
            run -= 1


def read_scans(media: bytes) -> tuple[int, int, list[Component], dict[int, np.ndarray], bytes]:
    """Height, width, components with all scans accumulated, quantisers by number, and the comment."""
    at, tables, quantisers, comps, comment, interval = 2, {}, {}, [], b"", 0
    height = width = most_h = most_v = 0
    shape: dict[int, tuple[int, int]] = {}
    while media[at + 1] != 0xD9:
        kind, size = media[at + 1], struct.unpack_from(">H", media, at + 2)[0]
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xFE:
            comment = body
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            tables.update(_codes(body))
        elif kind == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif kind == 0xC2:
            _, height, width, _ = struct.unpack(">BHHB", body[:6])
            own = [body[i : i + 3] for i in range(6, len(body), 3)]
            most_h, most_v = max(x[1] >> 4 for x in own), max(x[1] & 15 for x in own)
            mcus = -(-width // (8 * most_h)), -(-height // (8 * most_v))
            for ident, hv, q in own:
                comp = Component(ident, mcus[0] * (hv >> 4), mcus[1] * (hv & 15), q)
                comp.coefficients = np.zeros((comp.across * comp.down, 64), np.int16)
                shape[ident] = hv >> 4, hv & 15
                comps.append(comp)
        elif kind == 0xDA:
            n = body[0]
            used = [(next(c for c in comps if c.ident == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            first, last, hl = body[1 + 2 * n :]
            end = at
            parts, begin = [], at
            if interval == 1 and n == 1:
                parts, end = _one_byte_intervals(media, at, len(used[0][0].coefficients))
                begin = end
            for found in MARKER.finditer(media, end):
                end = found.start()
                parts.append(media[begin:end].replace(b"\xff\x00", b"\xff"))
                if media[end + 1] & 0xF8 != 0xD0:
                    break
                begin = end + 2
            at = end
            high, low = hl >> 4, hl & 15
            dc = {k: tables.get(t >> 4, {}) for k, (_, t) in enumerate(used)}
            ac = {k: tables.get(16 + (t & 15), {}) for k, (_, t) in enumerate(used)}
            if not _whole(parts, [c for c, _ in used], (first, last), high, low, ac[0] if first else dc[0]):
                if n == 1:
                    c, (h, v) = used[0][0], shape[used[0][0].ident]
                    wide, tall = -(-(-(-width * h // most_h)) // 8), -(-(-(-height * v // most_v)) // 8)
                    order = [[(0, c, y * c.across + x)] for y in range(tall) for x in range(wide)]
                else:
                    order = [[(k, c, (my * shape[c.ident][1] + y) * c.across + mx * shape[c.ident][0] + x) for k, (c, _) in enumerate(used) for y in range(shape[c.ident][1]) for x in range(shape[c.ident][0])] for my in range(mcus[1]) for mx in range(mcus[0])]
                step = interval or len(order)
                for i, part in enumerate(parts):
                    _bitwise(part, [x for unit in order[i * step : (i + 1) * step] for x in unit], (first, last), high, low, dc, ac)
        elif kind not in range(0xE0, 0xF0):
            raise ValueError(f"marker {kind:#x} is not of a progressive JPEG")
    return height, width, comps, quantisers, comment


def payload_of(comps: list[Component], comment: bytes) -> bytes:
    """The bytes that encode() stored."""
    c = np.concatenate([x.coefficients for x in comps])
    mag = np.abs(c)
    half = np.where(c > 0, mag >> 1, 127 - (mag >> 1))
    low = mag & 1
    half[:, 0] = np.where(c[:, 0] > 0, c[:, 0] >> 1, (c[:, 0] >> 1) + 127)
    low[:, 0] = c[:, 0] & 1
    return (half << 1 | low).astype(np.uint8).tobytes()[: int(comment.split()[1])]


def rgb_of(height: int, width: int, comps: list[Component], quantisers: dict[int, np.ndarray]) -> np.ndarray:
    """height x width x 3 samples."""
    planes = []
    for c in comps:
        samples = (c.coefficients * quantisers[c.table]).astype(np.float32) @ BASIS
        planes.append(samples.reshape(c.down, c.across, 8, 8).transpose(0, 2, 1, 3).reshape(c.down * 8, c.across * 8))
    full = planes[0].shape
    planes = [p if p.shape == full else p.repeat(full[0] // p.shape[0], 0).repeat(full[1] // p.shape[1], 1) for p in planes]
    if len(planes) == 1:
        planes *= 3
        out = np.stack(planes, -1) + 128
    else:
        out = np.stack(planes, -1) @ TO_RGB.T + np.float32(128)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)[:height, :width]


def feature_of(rgb: np.ndarray) -> str:
    """Size, channel means and a histogram of green in eighths, in text."""
    n = rgb.shape[0] * rgb.shape[1]
    means = rgb.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // n
    bars = np.bincount(rgb[:, :, 1].ravel() >> 5, minlength=8) * 1000 // n
    return f"{rgb.shape[0]}x{rgb.shape[1]};{'.'.join(map(str, means))};{'.'.join(map(str, bars))}"


def padded(text: str | None) -> tuple[int, bytes]:
    b = (text or "").encode("utf-8", "surrogatepass")
    return len(b), b + b"\xff" * ((-len(b) % UNIT) or (0 if b else UNIT))


def store_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
        for b in batches:
            for rows in blocks_of(zip(column(b, "doc_id"), column(b, "text"), strict=True), lambda r: len(r[1] or ""), SLICE):
                made = [padded(t) for _, t in rows]
                yield pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array([encode(p) for _, p in made], pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _mapped(df: DataFrame, columns: str, weight: str, one) -> DataFrame:
    """df with one(row)'s values as new columns; rows go through Python in slices of about SLICE bytes of the column weight."""
    new = [c.split()[0] for c in columns.split(", ")]
    kinds = {"binary": pa.binary(), "int": pa.int32(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.binary_length(b.column(b.schema.get_field_index(weight))).to_pylist()
            for part in blocks_of(range(b.num_rows), lambda i: sizes[i], SLICE):
                some = b.slice(part[0], len(part))
                made = list(zip(*map(one, some.to_pylist()), strict=True))
                more = [pa.array(list(v), kinds[c.split()[1]]) for v, c in zip(made, columns.split(", "), strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns, *more], names=[*some.schema.names, *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + columns
    return df.mapInArrow(run, schema)


def read_media(stored: DataFrame) -> DataFrame:
    """stored(doc_id, n_bytes, media) -> the same with payload, the tensor as rgb, height and width, and the feature of the tensor's stored bytes."""

    def one(row: dict) -> tuple:
        height, width, comps, quantisers, comment = read_scans(row["media"])
        rgb = rgb_of(height, width, comps, quantisers).tobytes()
        return payload_of(comps, comment), rgb, height, width, feature_of(np.frombuffer(rgb, np.uint8).reshape(height, width, 3))

    return _mapped(stored, "payload binary, rgb binary, height int, width int, feature string", "media", one)


def op9_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_media(store_texts(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "height",
        "width",
        "rgb",
        "feature",
    )
