"""Baseline JPEG in numpy: text payloads as quantised coefficients, and features of JPEG columns.

**Storing.** A payload is a positive number of 64-byte blocks. Block b is the b-th 8x8 block of a
grey baseline JPEG whose quantisation table is all ones: byte k, less 128, is its k-th coefficient in
zigzag order, so the file holds the payload without loss. A comment segment holds the payload's
length and the unpadded length; blocks that only fill up the grid are empty. Every eight blocks a
restart marker makes the rest decodable by itself.

**Reading.** Markers are parsed per image. Scans of all images of one layout are then Huffman-decoded
in lockstep: each restart interval is a lane, and one numpy step decodes one symbol in every lane. DC
coefficients give the luminance thumbnail (an eighth of the size), its average hash and the dimensions.

Any baseline file of one or several interleaved or single-component scans is read (8-bit precision,
Huffman coding, any sampling). Null media give null features. Anything else, cut or damaged files
included, gives null features and a message in ``error``; sizes that the scan's bytes can't fill are
refused before memory is taken for them. Equal media give equal features; rows are kept as they are.
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

from .common import chunks, extended, over_texts

INTERVAL = 8  # blocks between restart markers

#: Code lengths of the stored files: symbol -> bits. AC symbols are run * 16 + size.
DC_BITS = {6: 2, 7: 2, 5: 3, 4: 4, 8: 4, 0: 6, 1: 6, 2: 6, 3: 6}
AC_BITS = {0x05: 2, 0x07: 2, 0x04: 3, 0x06: 3, 0x03: 4, 0x08: 5, 0x00: 6, 0x01: 6, 0x02: 6} | {
    x: 11 for x in [0xF0, *(16 * run + size for run in range(1, 16) for size in range(1, 9))]
}


def table_segment(bits: dict[int, int]) -> bytes:
    """BITS and HUFFVAL of a DHT segment."""
    symbols = sorted(bits, key=lambda s: (bits[s], s))
    return bytes(sum(bits[s] == n for s in symbols) for n in range(1, 17)) + bytes(symbols)


def canonical(segment: bytes) -> tuple[list[tuple[int, int, int]], int]:
    """(symbol, code, length) of each entry of a DHT table, and the bytes it takes up."""
    counts, at, code, out = segment[:16], 16, 0, []
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((segment[at], code, length))
            code += 1
            at += 1
        code <<= 1
    return out, at


def _coding(bits: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    codes, lengths = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for symbol, code, length in canonical(table_segment(bits))[0]:
        codes[symbol], lengths[symbol] = code, length
    return codes, lengths


_BIT_LENGTHS = np.array([x.bit_length() for x in range(2048)], np.int64)


def _sizes(values: np.ndarray) -> np.ndarray:
    """Bits of the magnitude, JPEG's size category, for values of up to 11 bits."""
    return _BIT_LENGTHS[np.abs(values)]


def _extra(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.where(values >= 0, values, values + (1 << sizes) - 1).astype(np.uint64)


def _header(width: int, height: int, n_payload: int, n_bytes: int) -> bytes:
    part = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    return (
        b"\xff\xd8"
        + part(0xFE, struct.pack(">QQ", n_payload, n_bytes))
        + part(0xDB, b"\0" + b"\1" * 64)
        + part(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0")
        + part(0xC4, b"\0" + table_segment(DC_BITS))
        + part(0xC4, b"\x10" + table_segment(AC_BITS))
        + part(0xDD, struct.pack(">H", INTERVAL))
        + part(0xDA, b"\1\1\0\0\x3f\0")
    )


def encode_payloads(raw: list[bytes]) -> list[bytes]:
    """One JPEG file for each byte string, all at once."""
    if not raw:
        return []
    n_blocks = np.array([max(1, -(-len(x) // 64)) for x in raw])
    wide = np.ceil(np.sqrt(n_blocks)).astype(np.int64)
    if (wide > 8191).any():
        raise ValueError("a payload has more blocks than a JPEG image can have")
    grid = wide * -(-n_blocks // wide)
    starts = np.concatenate([[0], np.cumsum(grid)])
    total = int(starts[-1])
    coef = np.zeros((total, 64), np.int64)
    for text, n, at in zip(raw, n_blocks, starts):
        own = np.zeros(64 * n, np.uint8)
        own[: len(text)] = np.frombuffer(text, np.uint8)
        coef[at : at + n] = own.reshape(-1, 64).astype(np.int64) - 128
    inner = np.arange(total) - np.repeat(starts[:-1], grid)
    first = inner % INTERVAL == 0
    lane = np.cumsum(first) - 1

    # bits of each coefficient: the zero runs before it, its code, its magnitude; column 64 ends the block
    value, length = np.zeros((total, 65), np.uint64), np.zeros((total, 65), np.int64)
    diff = coef[:, 0] - np.where(first, 0, np.concatenate([[0], coef[:-1, 0]]))
    size = _sizes(diff)
    codes, lengths = _coding(DC_BITS)
    value[:, 0], length[:, 0] = codes[size] << size.astype(np.uint64) | _extra(diff, size), lengths[size] + size
    codes, lengths = _coding(AC_BITS)
    there = coef != 0
    there[:, 0] = True
    last = np.maximum.accumulate(np.where(there, np.arange(64), 0), axis=1)
    row, col = np.nonzero(there[:, 1:])
    run, v = col - last[row, col], coef[row, col + 1]
    size = _sizes(v)
    symbol = (run % 16) * 16 + size
    bits, n = codes[symbol] << size.astype(np.uint64) | _extra(v, size), lengths[symbol] + size
    for times in range(1, 4):
        more = run >= 16 * times
        if more.any():
            bits[more] |= codes[0xF0] << n[more].astype(np.uint64)
            n[more] += lengths[0xF0]
    value[row, col + 1], length[row, col + 1] = bits, n
    ends = last[:, 63] < 63
    value[ends, 64], length[ends, 64] = codes[0], lengths[0]

    # place them: every interval begins at a byte, ends are filled with ones
    per_lane = np.bincount(lane, weights=length.sum(axis=1)).astype(np.int64)
    lane_bytes = -(-per_lane // 8)
    lane_at = np.concatenate([[0], np.cumsum(lane_bytes)])
    flat = length.ravel()
    before = np.cumsum(flat) - flat
    lane_first = np.concatenate([[0], np.cumsum(per_lane)])[:-1]
    offset = before - np.repeat(lane_first[lane], 65) + np.repeat(lane_at[:-1][lane] * 8, 65)
    used = flat > 0
    flat, offset, bits = flat[used], offset[used], value.ravel()[used]
    bits = bits << (64 - (offset & 7) - flat).astype(np.uint64)
    byte, span = offset >> 3, (offset & 7) + flat
    out = np.zeros(int(lane_at[-1]) + 8)
    for k in range(8):
        some = span > 8 * k
        if not some.any():
            break
        out += np.bincount(byte[some] + k, weights=(bits[some] >> np.uint64(56 - 8 * k)) & np.uint64(255), minlength=len(out))
    scan = out[: lane_at[-1]].astype(np.uint8)
    scan[lane_at[1:] - 1] |= ((1 << (lane_bytes * 8 - per_lane)) - 1).astype(np.uint8)

    # stuff zero bytes after 255 and put a restart marker after each interval
    full = scan == 255
    shift = np.cumsum(full) - full
    owner = np.repeat(np.arange(len(lane_bytes)), lane_bytes)
    spot = np.arange(len(scan)) + shift + 2 * owner
    done = np.zeros(len(scan) + int(full.sum()) + 2 * len(lane_bytes), np.uint8)
    done[spot] = scan
    end = spot[lane_at[1:] - 1] + 1 + full[lane_at[1:] - 1]  # of each interval, where its marker stands
    number = inner[first] // INTERVAL
    done[end], done[end + 1] = 255, 0xD0 + number % 8
    lanes = np.concatenate([[0], np.cumsum(-(-grid // INTERVAL))])
    files = []
    for i, text in enumerate(raw):
        a = int(end[lanes[i] - 1]) + 2 if lanes[i] else 0
        head = _header(int(8 * wide[i]), int(8 * grid[i] // wide[i]), int(64 * n_blocks[i]), len(text))
        files.append(head + done[a : int(end[lanes[i + 1] - 1])].tobytes() + b"\xff\xd9")
    return files


class Frame:
    """What the markers of one file say."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no start of image")
        self.data, self.quant, self.huffman, self.restart, self.comment, self.scans = data, {}, {}, 0, b"", []
        self.width = self.height = 0
        self.parts: list[tuple[int, int, int, int]] = []  # id, h, v, quantisation table
        at = 2
        while True:
            if at + 2 > len(data) or data[at] != 255:
                raise ValueError("a marker is missing")
            marker = data[at + 1]
            if marker == 255:
                at += 1
                continue
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if len(body) != size - 2:
                raise ValueError("a segment is cut off")
            at += 2 + size
            if marker == 0xC0:
                precision, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if precision != 8 or not self.width or not self.height:
                    raise ValueError("not an 8-bit image of known size")
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if any(not 1 <= h <= 4 or not 1 <= v <= 4 for _, h, v, _ in self.parts):
                    raise ValueError("sampling factors are out of range")
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline frame")
            elif marker == 0xDB:
                while body:
                    n = 128 if body[0] >> 4 else 64
                    if len(body) <= n:
                        raise ValueError("a quantisation table is cut off")
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : n + 1], ">u2" if n == 128 else np.uint8).astype(np.int64)
                    body = body[n + 1 :]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    if len(body) < max(n, 17) or n > 17 + 256:
                        raise ValueError("a Huffman table is cut off")
                    if any(code >> length for _, code, length in canonical(body[1:n])[0]):
                        raise ValueError("a Huffman table has too many codes")
                    self.huffman[body[0]] = body[1:n]
                    body = body[n:]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                chosen = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                stop = at
                while True:  # to the next marker that is neither stuffing nor a restart
                    stop = data.find(b"\xff", stop)
                    if stop < 0 or stop + 1 >= len(data):
                        raise ValueError("the scan has no end")
                    if data[stop + 1] == 0 or 0xD0 <= data[stop + 1] <= 0xD7:
                        stop += 2
                        continue
                    break
                self.scans.append((chosen, self.restart, dict(self.huffman), at, stop))
                at = stop
        if not self.parts or not self.scans:
            raise ValueError("no frame or no scan")

    def blocks(self, part: int) -> tuple[int, int]:
        """Rows and columns of a component's blocks in a scan of its own."""
        _, h, v, _ = self.parts[part]
        most_h, most_v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        return -(-(-(-self.height * v // most_v)) // 8), -(-(-(-self.width * h // most_h)) // 8)


_lookups: dict[bytes, np.ndarray] = {}


def _lookup(segment: bytes) -> np.ndarray:
    """For each 16 bits ahead: length * 256 + symbol; 0 where no code fits."""
    if segment not in _lookups:
        table = np.zeros(1 << 16, np.int64)
        for symbol, code, length in canonical(segment)[0]:
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
        if len(_lookups) > 64:
            _lookups.clear()
        _lookups[segment] = table
    return _lookups[segment]


def decode_lanes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, count: np.ndarray, slots: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (zigzag order, DC still as differences) of the blocks of all lanes, lane after
    lane, and whether each lane was sound. ``data`` has no stuffing left; lane i lies in
    ``data[start[i]:stop[i]]`` and holds ``count[i]`` blocks, whose tables repeat as in ``slots``."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    ahead = np.zeros(len(padded) - 8, np.uint64)
    for k in range(8):
        ahead |= padded[k : len(padded) - 8 + k] << np.uint64(56 - 8 * k)
    tables = np.concatenate([x for dc, ac in slots for x in (_lookup(dc), _lookup(ac))])
    base = np.concatenate([[0], np.cumsum(count)])
    coef, sound = np.zeros((int(base[-1]), 64), np.int16), np.ones(len(count), bool)
    live = np.nonzero(count > 0)[0]
    pos, k, block = start[live] * 8, np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    end, left = stop[live] * 8, count[live]
    while len(live):
        window = ahead[pos >> 3] << (pos & 7).astype(np.uint64)
        slot = block % len(slots) if len(slots) > 1 else 0
        entry = tables[(2 * slot + (k > 0)) * 65536 + (window >> np.uint64(48)).astype(np.int64)]
        length, size, run = entry >> 8, entry & 15, (entry & 255) >> 4
        dc = k == 0
        extra = ((window << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        v = np.where((size > 0) & (extra < 1 << np.maximum(size - 1, 0)), extra - (1 << size) + 1, extra)
        pos = pos + length + size
        at = np.where(dc, 0, k + run)
        bad = (length == 0) | (pos > end) | (at > 63) & (size > 0)
        keep = (size > 0) & ~bad
        coef[(base[live] + block)[keep], at[keep]] = v[keep]
        k = np.where(dc, 1, np.where(size > 0, at + 1, np.where(run == 15, k + 16, 64)))
        over = k >= 64
        block, k = block + over, np.where(over, 0, k)
        done = bad | (block >= left)
        if done.any():
            sound[live[bad]] = False
            go = ~done
            live, pos, k, block, end, left = live[go], pos[go], k[go], block[go], end[go], left[go]
    return coef, sound


_DAMAGE = (ValueError, IndexError, KeyError, StopIteration, struct.error, OverflowError)


def decode_images(files: list[bytes | None]) -> list[dict | str | None]:
    """For each file: None, what is wrong with it, or a dict of width, height, thumbnail (luminance,
    uint8), comment and ``coefficients`` (of the first component, zigzag order, block rows)."""
    out: list[dict | str | None] = [None] * len(files)
    groups: dict[tuple, list[tuple[int, Frame, int]]] = {}
    for i, data in enumerate(files):
        if data is None:
            continue
        try:
            frame = Frame(bytes(data))
            luma = frame.parts[0][0]
            s = next(k for k, x in enumerate(frame.scans) if any(c[0] == luma for c in x[0]))
            chosen, restart, huffman, _, _ = frame.scans[s]
            slots = []
            for part_id, dc, ac in chosen:
                p = next(p for p in frame.parts if p[0] == part_id)
                slots += [(part_id, huffman[dc], huffman[16 | ac])] * (p[1] * p[2] if len(chosen) > 1 else 1)
            key = (tuple(slots), restart, len(chosen) > 1)
        except _DAMAGE as error:
            out[i] = f"unreadable: {error}"
            continue
        groups.setdefault(key, []).append((i, frame, s))
    for key, members in groups.items():
        try:
            _decode_group(key, members, out)
        except _DAMAGE:
            for member in members:  # one damaged file must not take the others of its layout with it
                try:
                    _decode_group(key, [member], out)
                except _DAMAGE as error:
                    out[member[0]] = f"unreadable: {error}"
    return out


def _decode_group(key: tuple, members: list[tuple[int, Frame, int]], out: list) -> None:
    """Decode files (number, frame, scan) of one layout in lockstep into ``out``."""
    slots, restart, interleaved = key
    parts, start, stop, count, ranges = [], [], [], [], []
    at = 0
    for i, frame, s in members:
        _, _, _, a, b = frame.scans[s]
        scan = np.frombuffer(frame.data, np.uint8)[a:b]
        if interleaved:
            h, v = max(p[1] for p in frame.parts), max(p[2] for p in frame.parts)
            units = -(-frame.width // (8 * h)) * -(-frame.height // (8 * v))
        else:
            rows, cols = frame.blocks(0)
            units = rows * cols
        mark = np.nonzero(scan[:-1] == 255)[0] if len(scan) else np.empty(0, np.int64)
        rst = mark[(scan[mark + 1] & 0xF8) == 0xD0]
        if 2 * units * len(slots) > 8 * len(scan):  # a block takes two codes at least
            out[i] = "unreadable: the scan is too short for the size"
            continue
        lanes = -(-units // restart) if restart else 1
        if len(rst) != lanes - 1:
            out[i] = "unreadable: restart markers are missing"
            continue
        drop = np.ones(len(scan), bool)
        drop[mark[scan[mark + 1] == 0] + 1] = False
        drop[rst] = drop[rst + 1] = False
        cuts = np.concatenate([[0], np.cumsum(drop)])[np.concatenate([[0], rst, [len(scan)]])] + at
        parts.append(scan[drop])
        at += len(parts[-1])
        ranges.append((i, frame, len(start), lanes, units))
        start += cuts[:-1].tolist()
        stop += cuts[1:].tolist()
        per = restart or units
        count += [per * len(slots)] * (lanes - 1) + [(units - per * (lanes - 1)) * len(slots)]
    if not ranges:
        return
    counts = np.array(count)
    coef, sound = decode_lanes(np.concatenate(parts), np.array(start), np.array(stop), counts, [x[1:] for x in slots])
    luma_slots = [k for k, x in enumerate(slots) if x[0] == slots[0][0] or x[0] == members[0][1].parts[0][0]]
    luma_slots = [k for k in luma_slots if slots[k][0] == members[0][1].parts[0][0]]
    base = np.concatenate([[0], np.cumsum(counts)])
    for i, frame, lane, lanes, units in ranges:
        if not sound[lane : lane + lanes].all():
            out[i] = "unreadable: the scan is damaged"
            continue
        own = coef[base[lane] : base[lane + lanes]].reshape(units, len(slots), 64)[:, luma_slots]
        per = restart or units
        diff = own[:, :, 0].astype(np.int64)
        total = np.cumsum(diff.ravel()).reshape(diff.shape)
        before = np.concatenate([[0], total[:, -1]])[(np.arange(units) // per) * per]
        own[:, :, 0] = total - before[:, None]
        if interleaved:
            _, h, v, _ = frame.parts[0]
            wide = -(-frame.width // (8 * max(p[1] for p in frame.parts)))
            own = own.reshape(-1, wide, v, h, 64).transpose(0, 2, 1, 3, 4).reshape(units // wide * v, wide * h, 64)
        else:
            own = own.reshape(*frame.blocks(0), 64)
        rows, cols = frame.blocks(0)
        own = own[:rows, :cols]
        step = frame.quant.get(frame.parts[0][3], np.ones(64, np.int64))[0]
        thumb = np.clip(np.floor(own[:, :, 0] * step / 8 + 128.5), 0, 255).astype(np.uint8)
        out[i] = {"width": frame.width, "height": frame.height, "thumbnail": thumb, "comment": frame.comment, "coefficients": own}


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: whether each of 8x8 area means of the thumbnail exceeds their mean; small thumbnails
    repeat their rows and columns."""
    rows, cols = (np.arange(9) * n // 8 for n in thumb.shape)
    table = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    table[1:, 1:] = thumb.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    a, b = np.minimum(rows[:-1], thumb.shape[0] - 1), np.minimum(cols[:-1], thumb.shape[1] - 1)
    c, d = np.maximum(rows[1:], a + 1), np.maximum(cols[1:], b + 1)
    mean = (table[c][:, d] - table[a][:, d] - table[c][:, b] + table[a][:, b]) / ((c - a)[:, None] * (d - b)[None, :])
    return np.packbits((mean > mean.mean()).ravel()).tobytes().hex()


def payload_of(image: dict) -> tuple[bytes, int]:
    """The stored payload and its unpadded length."""
    n_payload, n_bytes = struct.unpack(">QQ", image["comment"])
    return (image["coefficients"].reshape(-1)[:n_payload] + 128).astype(np.uint8).tobytes(), n_bytes


def store_texts(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Add each text (null: empty) as a JPEG file in binary column ``media``, replaced if it exists."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != media])
    schema = extended(docs.schema, **{media: "binary"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(frames, text, 400_000):
            yield part.assign(**{media: encode_payloads([(t or "").encode() for t in part[text]])})

    return over_texts(docs, run, schema)


def media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Replace ``media`` by width, height, thumbnail (bytes, row by row), thumb_hash and error."""
    kept = [c for c in df.columns if c not in (media, "width", "height", "thumbnail", "thumb_hash", "error")]
    schema = extended(df.select(*[F.col(f"`{c}`") for c in kept]).schema, width="int", height="int", thumbnail="binary", thumb_hash="string", error="string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(frames, media, 600_000):
            rows = [(x["width"], x["height"], x["thumbnail"].tobytes(), average_hash(x["thumbnail"]), None) if isinstance(x, dict) else (None, None, None, None, x) for x in decode_images(list(part[media]))]
            more = pd.DataFrame(rows, columns=["width", "height", "thumbnail", "thumb_hash", "error"], index=part.index)
            more = more.astype({"width": "Int32", "height": "Int32"})
            yield pd.concat([part[kept], more], axis=1)

    return over_texts(df.select(*[F.col(f"`{c}`") for c in [*kept, media]]), run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """Store every text, read the stored bytes back, and describe payload, media and features."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(frames, "media", 600_000):
            rows = []
            for doc_id, data, image in zip(part["doc_id"], part["media"], decode_images(list(part["media"]))):
                if not isinstance(image, dict):
                    raise ValueError(f"stored media of document {doc_id} can't be read: {image}")
                payload, n_bytes = payload_of(image)
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), f"{image['width']}x{image['height']}:{average_hash(image['thumbnail'])}"))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return over_texts(store_texts(docs.select("doc_id", "text")).select("doc_id", "media"), run, schema)
