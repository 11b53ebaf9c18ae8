"""Media columns over baseline JPEG.

The reader parses markers, builds Huffman tables, decodes the scan and keeps
quantised coefficients; a thumbnail of one pixel a block follows from the DC
coefficients alone.  Restart intervals are decoded side by side in numpy, one
symbol of each per step, so the number of Python steps is that of symbols in one
interval whatever the number of images.

The writer stores bytes losslessly.  JPEG's exact unit is the quantised
coefficient, so each byte is one coefficient of an 8 x 8 block, 64 bytes a block
in zigzag order, a restart marker after each block.  Byte b becomes the
coefficient of size 8 whose eight magnitude bits are b: b for b >= 128, else
b - 255.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import parts

#: Blocks across, unless the format's greatest height forces more.
ROW_BLOCKS = 64
MOST_DOWN = 65_535 // 8
#: Payload bytes of texts that are taken together.
GROUP_BYTES = 1 << 20
#: Blocks encoded, and restart intervals decoded, side by side.
LANES = 1 << 14


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, lengths: dict[int, list[int]]) -> bytes:
    counts = bytes(len(lengths.get(n, [])) for n in range(1, 17))
    return bytes([kind]) + counts + bytes(s for n in sorted(lengths) for s in lengths[n])


#: One-bit codes for "size 8"; two-bit codes for the end of a block and of size 0.
_DC = _table(0x00, {1: [8], 2: [0]})
_AC = _table(0x10, {1: [0x08], 2: [0x00]})


def _blocks_across(blocks: int) -> int:
    return max(min(blocks, ROW_BLOCKS), -(-blocks // MOST_DOWN))


def _head(n_bytes: int, blocks: int) -> bytes:
    wide = _blocks_across(blocks)
    tall = -(-blocks // wide)
    frame = struct.pack(">BHHB", 8, tall * 8, wide * 8, 1) + bytes([1, 0x11, 0])
    return b"\xff\xd8" + _segment(0xFE, struct.pack(">QQ", n_bytes, blocks * 64)) + _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC0, frame) + _segment(0xC4, _DC) + _segment(0xC4, _AC) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def encode_payloads(texts: list[bytes]) -> list[bytes]:
    """Baseline JPEG files whose coefficients are each text's bytes, zero-filled to blocks of 64."""
    padded, heads, images = [], [], []
    for raw in texts:
        blocks = max(1, -(-len(raw) // 64))
        wide = _blocks_across(blocks)
        grid = -(-blocks // wide) * wide  # whole rows of blocks
        padded.append(raw + bytes(grid * 64 - len(raw)))
        heads.append(_head(len(raw), blocks))
        images.append(grid)
    data = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, 64)
    del padded
    counts = np.array(images)
    begins = np.cumsum(counts) - counts
    ends = np.zeros(len(data), bool)
    ends[begins + counts - 1] = True
    pieces, sizes = [], []
    for at in range(0, len(data), LANES):
        place = np.arange(at, min(at + LANES, len(data)))
        image = np.searchsorted(begins, place, "right") - 1
        flat, size = _coded(data[at : at + LANES], place - begins[image], ends[at : at + LANES])
        pieces.append(flat)
        sizes.append(size)
    whole, cuts = b"".join(pieces), np.cumsum(np.concatenate(sizes))[begins + counts - 1]
    return [h + whole[a:b] for h, a, b in zip(heads, np.concatenate(([0], cuts[:-1])), cuts, strict=True)]


def _coded(data: np.ndarray, place: np.ndarray, last: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded blocks, each with the marker that ends its interval, and their sizes; ``place`` is a block's number in its image."""
    bits = np.zeros((len(data), 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(data, axis=1).reshape(-1, 64, 8)
    coded = np.packbits(bits.reshape(len(data), 576), axis=1)  # 72 bytes a block
    # Stuff a zero after each 0xFF, add the marker.
    stuffed = np.zeros((len(data), 74, 2), np.uint8)
    stuffed[:, :72, 0] = coded
    keep = np.zeros(stuffed.shape, bool)
    keep[:, :, 0] = True
    keep[:, :72, 1] = coded == 255
    stuffed[:, 72, 0] = 0xFF
    stuffed[:, 73, 0] = np.where(last, 0xD9, 0xD0 + place % 8)
    return stuffed[keep].tobytes(), keep.sum((1, 2))


class Unsupported(ValueError):
    """Not a baseline Huffman JPEG, or cut short."""


def parse(data: bytes) -> dict:
    """Markers of one file: frame, tables, restart interval, and where the scan's bytes begin."""
    if data[:2] != b"\xff\xd8":
        raise Unsupported("no start of image")
    out: dict = {"quant": {}, "huff": {}, "restart": 0, "comment": b"", "components": []}
    at = 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise Unsupported("no marker")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1")
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out["huff"][body[0]] = bytes(body[: 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            bits, out["height"], out["width"], n = struct.unpack(">BHHB", body[:6])
            if bits != 8:
                raise Unsupported("not 8-bit")
            out["components"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise Unsupported("not baseline")
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body[:2])[0]
        elif marker == 0xFE:
            out["comment"] = bytes(body)
        elif marker == 0xDA:
            if body[0] != len(out["components"]) or not body[0] or not out["width"] or not out["height"]:
                raise Unsupported("not one interleaved scan")
            out["tables"] = [(body[2 + 2 * i] >> 4, 0x10 | body[2 + 2 * i] & 15) for i in range(body[0])]
            out["scan"] = at + 2 + size
            return out
        elif marker == 0xD9:
            raise Unsupported("no scan")
        at += 2 + size


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length * 256 + symbol; 0 where no code fits."""
    out = np.zeros(65536, np.int32)
    code, k = 0, 17
    for n in range(1, 17):
        for _ in range(table[n]):
            low = code << (16 - n)
            out[low : low + (1 << (16 - n))] = n * 256 + table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _layout(p: dict) -> tuple[list[tuple[int, int]], int, int]:
    """Blocks of one MCU as (component, index in it), and MCUs across and down."""
    if len(p["components"]) == 1:
        return [(0, 0)], -(-p["width"] // 8), -(-p["height"] // 8)
    h, v = max(c[1] for c in p["components"]), max(c[2] for c in p["components"])
    units = [(i, k) for i, c in enumerate(p["components"]) for k in range(c[1] * c[2])]
    return units, -(-p["width"] // (8 * h)), -(-p["height"] // (8 * v))


def decode_scans(files: list[bytes], heads: list[dict]) -> list[np.ndarray]:
    """Quantised coefficients of each file, (blocks in scan order, 64) in zigzag order.

    All files must share tables, components and restart interval; every restart
    interval of every file is one lane.
    """
    p = heads[0]
    units, _, _ = _layout(p)
    mcus = [(lambda t: t[1] * t[2])(_layout(h)) for h in heads]
    step = p["restart"] or max(mcus)
    per_file = [-(-m // step) for m in mcus]
    raw = np.frombuffer(b"".join(f[h["scan"] :] for f, h in zip(files, heads, strict=True)) + bytes(8), np.uint8)
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    is_marker = (after >= 0xD0) & (after <= 0xD9)
    mark = ff[is_marker]
    zeros = ff[after == 0] + 1  # stuffed
    last = after[is_marker] == 0xD9
    lanes = sum(per_file)
    if len(mark) != lanes or int(last.sum()) != len(files) or not np.array_equal(np.flatnonzero(last), np.cumsum(per_file) - 1):
        raise Unsupported("restart markers do not match the image")
    begin = np.concatenate(([0], mark[:-1] + 2))

    lane_mcus = np.full(lanes, step)
    lane_mcus[np.cumsum(per_file) - 1] = np.array(mcus) - step * (np.array(per_file) - 1)
    blocks = lane_mcus * len(units)
    first = np.cumsum(blocks) - blocks
    out = np.zeros((int(blocks.sum()), 64), np.int16)
    flat = out.reshape(-1)
    tables = np.concatenate([_lookup(p["huff"][k]) for pair in p["tables"] for k in pair])
    component = np.array([c for c, _ in units])

    def decode(some: slice) -> None:
        """Fills ``out`` from the lanes of ``some``."""
        low, high = int(begin[some][0]), int(mark[some][-1])
        gone = np.zeros(high - low, bool)
        gone[zeros[np.searchsorted(zeros, low) : np.searchsorted(zeros, high)] - low] = True
        gone[mark[some][:-1] - low] = gone[mark[some][:-1] + 1 - low] = True
        clean = np.concatenate((raw[low:high][~gone], np.zeros(8, np.uint8)))
        word = (clean[:-3].astype(np.uint32) << 24) | (clean[1:-2].astype(np.uint32) << 16) | (clean[2:-1].astype(np.uint32) << 8) | clean[3:]
        starts = begin[some] - low
        before = np.searchsorted(np.flatnonzero(gone), starts)  # bytes dropped ahead of each lane
        n = len(starts)
        bit, k, done = (starts - before).astype(np.int64) * 8, np.zeros(n, np.int64), np.zeros(n, np.int64)  # done: blocks of the lane
        previous = np.zeros((n, len(p["components"])), np.int64)
        live, size_of, first_of = np.arange(n), blocks[some], first[some]

        def peek(at: np.ndarray) -> np.ndarray:
            """The 16 bits at each bit position."""
            return (word[np.minimum(at >> 3, len(word) - 1)] >> (16 - (at & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF

        while len(live):
            b, z, c = bit[live], k[live], component[done[live] % len(units)]
            entry = tables[(2 * c + (z > 0)) * 65536 + peek(b)]
            if not entry.all():
                raise Unsupported("no such code")
            b = b + (entry >> 8)
            symbol = entry & 255
            size, run = symbol & 15, symbol >> 4
            value = peek(b) >> (16 - size)
            value = np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)
            b = b + size
            at_dc = z == 0
            if at_dc.any():
                dc = live[at_dc]
                previous[dc, c[at_dc]] += value[at_dc]
                value[at_dc] = previous[dc, c[at_dc]]
            spot = np.where(at_dc, 0, z + run)
            full = (size > 0) | at_dc
            if (spot[full] > 63).any():
                raise Unsupported("too many coefficients")
            row = (first_of[live] + done[live])[full]
            flat[row * 64 + spot[full]] = value[full]
            z = np.where(full, spot + 1, np.where(run == 15, z + 16, 64))
            bit[live] = b
            over = z >= 64
            k[live] = np.where(over, 0, z)
            done[live] += over
            if over.any():
                live = live[done[live] < size_of[live]]

    for at in range(0, lanes, LANES):
        decode(slice(at, at + LANES))
    return np.split(out, np.cumsum([m * len(units) for m in mcus])[:-1])


def thumbnail(coefficients: np.ndarray, p: dict) -> np.ndarray:
    """Luminance of one pixel a block from DC coefficients alone."""
    units, across, down = _layout(p)
    _, h, v, quant = p["components"][0]
    if len(p["components"]) == 1:
        h = v = 1
    dc = coefficients.reshape(down, across, len(units), 64)[:, :, : h * v, 0].reshape(down, across, v, h)
    dc = dc.transpose(0, 2, 1, 3).reshape(down * v, across * h).astype(np.int64)
    return np.clip((dc * int(p["quant"][quant][0]) + 4) // 8 + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64-bit average hash of the thumbnail laid over an 8 x 8 grid, in hex."""
    rows = np.minimum(np.arange(9) * pixels.shape[0] // 8, pixels.shape[0])
    cols = np.minimum(np.arange(9) * pixels.shape[1] // 8, pixels.shape[1])
    total = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1), np.int64)
    total[1:, 1:] = pixels.cumsum(0, dtype=np.int64).cumsum(1)
    r0, r1 = np.minimum(rows[:-1], pixels.shape[0] - 1), np.maximum(rows[1:], rows[:-1] + 1).clip(max=pixels.shape[0])
    c0, c1 = np.minimum(cols[:-1], pixels.shape[1] - 1), np.maximum(cols[1:], cols[:-1] + 1).clip(max=pixels.shape[1])
    area = (r1 - r0)[:, None] * (c1 - c0)
    cell = (total[r1][:, c1] - total[r0][:, c1] - total[r1][:, c0] + total[r0][:, c0]) / area
    return np.packbits(cell.ravel() > cell.mean()).tobytes().hex()


def describe(files: list[bytes | None]) -> list[dict]:
    """Width, height, thumbnail hash and coefficients of each file; an ``error`` where it is not baseline JPEG."""
    out: list[dict] = [{} for _ in files]
    groups: dict[tuple, list[int]] = {}
    for i, data in enumerate(files):
        try:
            p = parse(bytes(data or b""))
            out[i]["head"] = p
            key = (p["restart"], tuple(p["components"]), tuple(p["tables"]), tuple(sorted(p["huff"].items())))
            groups.setdefault(key if p["restart"] else (i,), []).append(i)
        except (Unsupported, IndexError, struct.error, KeyError) as error:
            out[i] = {"error": str(error) or "cut short"}
    for members in groups.values():
        try:
            decoded = decode_scans([files[i] for i in members], [out[i]["head"] for i in members])
        except (Unsupported, IndexError, KeyError):
            decoded = []
            for i in members:  # find the one at fault
                try:
                    decoded += decode_scans([files[i]], [out[i]["head"]])
                except (Unsupported, IndexError, KeyError) as error:
                    decoded.append(None)
                    out[i] = {"error": str(error) or "cut short"}
        for i, c in zip(members, decoded, strict=True):
            if c is not None:
                p, small = out[i]["head"], thumbnail(c, out[i]["head"])
                out[i] |= {"coefficients": c, "width": p["width"], "height": p["height"], "thumbnail": small, "hash": thumbnail_hash(small)}
    return out


def payload_of(file: dict) -> tuple[int, bytes]:
    """Unpadded length, and the padded payload that :func:`encode_payloads` stored."""
    n_bytes, size = struct.unpack(">QQ", file["head"]["comment"])
    c = file["coefficients"].reshape(-1)[:size]
    return n_bytes, np.where(c < 0, c + 255, c).astype(np.uint8).tobytes()


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep_media: bool = False) -> DataFrame:
    """Store each text as a baseline JPEG, read it back and describe it.

    Per row: id, ``n_bytes``, ``payload_bytes``, ``payload_sha256``,
    ``tail_crc32`` and ``feature`` from the bytes read back, ``media_bytes`` and
    ``media_sha256`` of the file, ``width``, ``height``; with ``keep_media``
    also the file, ``media``.  A null or empty text is one block of zeros; a
    text may be of any length.  Equal texts give equal values; null and repeated
    ids are kept, each row with its own text; an empty table gives no rows; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1, size=GROUP_BYTES):
                media = encode_payloads([(x.as_py() or "").encode("utf-8") for x in part.column(1)])
                rows = []
                for file, m in zip(describe(media), media, strict=True):
                    n, payload = payload_of(file)
                    feature = f"jpeg {file['width']}x{file['height']} thumb {file['thumbnail'].shape[1]}x{file['thumbnail'].shape[0]} {file['hash']}"
                    rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature, file["width"], file["height"]))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, *([pa.array(media, pa.binary())] * keep_media)], names + ["media"] * keep_media)
        pa.default_memory_pool().release_unused()

    source = df.select(id_col, F.col(text_col).cast("string"))
    schema = f"`{id_col}` {source.dtypes[0][1]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"
    return source.mapInArrow(run, schema + ", media binary" * keep_media)
