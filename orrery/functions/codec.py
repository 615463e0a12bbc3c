"""Byte-level codecs: BLAKE3, canonical JSON, tile blobs, tile indexes, zstd storage.

Small helpers for tasks; the Column forms at the end run them over Arrow batches. BLAKE3
is computed for all rows of a batch together; for bulk content use SHA-256, which Spark has.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Initial words, word order of the next round, flags.
_IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
_NEXT = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
_START, _END, _PARENT, _ROOT, _CONTEXT, _MATERIAL = 1, 2, 4, 8, 32, 64
_MIXES = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return x >> np.uint32(by) | x << np.uint32(32 - by)


def _compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values (8, n) of n blocks (16, n)."""
    n = block.shape[1]
    v = [*cv, *(np.full(n, x, np.uint32) for x in _IV[:4]), (counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), size.astype(np.uint32), flags.astype(np.uint32)]
    m = list(block)
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_MIXES):
            for word, first, second in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = v[a] + v[b] + word
                v[d] = _turn(v[d] ^ v[a], first)
                v[c] = v[c] + v[d]
                v[b] = _turn(v[b] ^ v[c], second)
        m = [m[k] for k in _NEXT]
    return np.stack([v[k] ^ v[k + 8] for k in range(8)])


def blake3(messages: list[bytes], key: np.ndarray = _IV, flags: int = 0) -> list[bytes]:
    """The 32-byte digests of all messages; every chunk of every message is a lane."""
    if not messages:
        return []
    counts = [max(1, -(-len(m) // 1024)) for m in messages]
    owner = np.repeat(np.arange(len(messages)), counts)
    number = np.concatenate([np.arange(c) for c in counts]).astype(np.int64)
    lanes = np.zeros((len(owner), 1024), np.uint8)
    size = np.zeros(len(owner), np.int64)
    for lane, (o, k) in enumerate(zip(owner, number, strict=True)):
        part = messages[o][1024 * k : 1024 * (k + 1)]
        lanes[lane, : len(part)] = np.frombuffer(part, np.uint8)
        size[lane] = len(part)
    words = lanes.view("<u4").reshape(len(owner), 16, 16).transpose(1, 2, 0)
    blocks = np.maximum(1, -(-size // 64))
    only = np.array(counts)[owner] == 1
    cv = np.repeat(key[:, None], len(owner), axis=1)
    for b in range(int(blocks.max())):
        live = np.flatnonzero(blocks > b)
        last = blocks[live] == b + 1
        f = flags | np.where(b == 0, _START, 0) | np.where(last, _END, 0) | np.where(last & only[live], _ROOT, 0)
        cv[:, live] = _compress(cv[:, live], words[b][:, live], number[live], np.minimum(64, size[live] - 64 * b), f)
    # pairs of neighbours merge level by level, an odd last one moves up
    trees = np.split(cv, np.cumsum(counts)[:-1], axis=1)
    while any(t.shape[1] > 1 for t in trees):
        at = [k for k, t in enumerate(trees) if t.shape[1] > 1]
        left = [trees[k][:, 0 : trees[k].shape[1] // 2 * 2 : 2] for k in at]
        right = [trees[k][:, 1::2] for k in at]
        f = np.concatenate([np.full(x.shape[1], flags | _PARENT | (_ROOT if trees[k].shape[1] == 2 else 0)) for k, x in zip(at, left, strict=True)])
        block = np.concatenate([np.concatenate(left, axis=1), np.concatenate(right, axis=1)])
        n = block.shape[1]
        up = _compress(np.repeat(key[:, None], n, axis=1), block, np.zeros(n, np.int64), np.full(n, 64), f)
        for k, part in zip(at, np.split(up, np.cumsum([x.shape[1] for x in left])[:-1], axis=1), strict=True):
            odd = trees[k][:, -1:] if trees[k].shape[1] % 2 else trees[k][:, :0]
            trees[k] = np.concatenate([part, odd], axis=1)
    return [t[:, 0].astype("<u4").tobytes() for t in trees]


def derive_key(context: str, messages: list[bytes]) -> list[bytes]:
    """BLAKE3 key derivation: 32 bytes for each message under a context."""
    key = np.frombuffer(blake3([context.encode()], flags=_CONTEXT)[0], "<u4").astype(np.uint32)
    return blake3(messages, key, _MATERIAL)


def number_text(x: float) -> str:
    """A binary64 number as ECMAScript writes it."""
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("not a finite number")
    if x == 0:
        return "0"
    sign, digits, exponent = re.fullmatch(r"(-?)([0-9.]+)(?:e([-+]\d+))?", repr(x)).groups()
    whole, _, part = digits.partition(".")
    point = len(whole) + int(exponent or 0)
    all_ = whole + part
    lead = len(all_) - len(all_.lstrip("0"))
    all_, point = all_.lstrip("0").rstrip("0"), point - lead
    n = len(all_)
    if n <= point <= 21:
        return sign + all_ + "0" * (point - n)
    if 0 < point <= 21:
        return sign + all_[:point] + "." + all_[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + all_
    e = point - 1
    return f"{sign}{all_[0]}{'.' + all_[1:] if n > 1 else ''}e{'+' if e >= 0 else '-'}{abs(e)}"


#: The largest integer of canonical JSON on either side of zero.
_MOST = (1 << 53) - 1


def _sorted(pairs: list) -> dict:
    """An object with its names in UTF-16 order, which is that of code points up to U+D7FF."""
    if len(out := dict(pairs)) < len(pairs):
        raise ValueError("a name is repeated")
    if any(max(n, default="") > "\ud7ff" for n in out):
        names = sorted(out, key=lambda n: n.encode("utf-16-be", "surrogatepass"))
    else:
        names = sorted(out)
    return {n: out[n] for n in names}


def _integer(text: str) -> int:
    if abs(x := int(text)) > _MOST:
        raise ValueError("an integer is out of range")
    return x


def _refused(text: str):
    raise ValueError("a number is not an integer")


def _wide(text: str) -> int:
    if (x := int(text)).bit_length() > 1023 or int(float(x)) != x:
        raise ValueError("an integer is out of range")
    return x


#: Readers that sort and check as they parse, without ``floats`` and with, and the writer; made once.
_READ = json.JSONDecoder(object_pairs_hook=_sorted, parse_int=_integer, parse_float=_refused, parse_constant=_refused)
_READ_FLOATS = json.JSONDecoder(object_pairs_hook=_sorted, parse_int=_wide, parse_constant=_refused)
_WRITE = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), check_circular=False)


def canonical_json(text: str, floats: bool = False) -> str:
    """Canonical JSON: names in UTF-16 order, none repeated; integers within 2^53 - 1, or
    with ``floats`` any number that is exact in binary64."""

    def write(x) -> str:
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return number_text(float(x))
        if isinstance(x, list):
            return "[" + ",".join(map(write, x)) + "]"
        if isinstance(x, dict):
            return "{" + ",".join(f"{_WRITE.encode(n)}:{write(v)}" for n, v in x.items()) + "}"
        return _WRITE.encode(x)

    out = write(_READ_FLOATS.decode(text)) if floats else _WRITE.encode(_READ.decode(text))
    out.encode()  # a lone surrogate has no UTF-8 form; its error is a ValueError
    return out


#: Fixed values of the blob format: magic, kinds, storage types.
MAGIC, KINDS = b"VYB1", {"raster": 1, "index": 2, "columnar": 3}
DTYPES = {"raw": (0, None), "u8": (1, "<u1"), "i8": (2, "<i1"), "u16": (3, "<u2"), "i16": (4, "<i2"), "u32": (5, "<u4"), "i32": (6, "<i4"), "f32": (7, "<f4")}
RANGES = {"u8": (0, 255), "i8": (-128, 127), "u16": (0, 65535), "i16": (-32768, 32767), "u32": (0, 4294967295), "i32": (-2147483648, 2147483647), "f32": (0, 4294967295)}
MOST_BYTES = 64 << 20


def pack_raster(values: np.ndarray, dtype: str) -> bytes:
    """A tile (slices, j, i) as a blob: 16 bytes of header and the values, i fastest."""
    slices, dim_j, dim_i = values.shape
    code, kind = DTYPES[dtype]
    low, high = RANGES[dtype]
    if values.size and (values.min() < low or values.max() > high):
        raise ValueError("a value does not fit the storage type")
    if dtype == "f32":  # 32 bits of a pattern
        kind = "<u4"
    return MAGIC + struct.pack("<BBBBHHHH", KINDS["raster"], code, 0, 0, dim_i, dim_j, slices, 0) + values.astype(kind).tobytes()


def unpack_raster(data: bytes) -> np.ndarray:
    if len(data) < 16 or len(data) > MOST_BYTES or data[:4] != MAGIC:
        raise ValueError("not a blob")
    kind, code, a, b, dim_i, dim_j, slices, c = struct.unpack("<BBBBHHHH", data[4:16])
    forms = {v[0]: v[1] for v in DTYPES.values() if v[1]}
    if kind != KINDS["raster"] or code not in forms or a or b or c or not dim_i * dim_j * slices:
        raise ValueError("not a raster blob")
    if dim_i * dim_j * slices * np.dtype(forms[code]).itemsize != len(data) - 16:
        raise ValueError("the payload does not fit the dimensions")
    return np.frombuffer(data, forms[code], offset=16).reshape(slices, dim_j, dim_i)


def const_bytes(value: int, dtype: str) -> bytes:
    """A constant tile's raw value as its storage type has it."""
    low, high = RANGES[dtype]
    if not low <= value <= high:
        raise ValueError("a value does not fit the storage type")
    return np.array([value], "<u4" if dtype == "f32" else DTYPES[dtype][1]).tobytes()


def _index_ids(field_id: int, topology: int, tile_log2: int, entries: list[tuple]) -> None:
    """Refuse a field id with an empty half, levels beyond 30 and keys of no tile: a cube
    tile's key is that of its ancestor at max(0, level - tile_log2); a radial one's is at its own
    level, with an ordinal below 2^(level - tile_log2)."""
    if not field_id >> 16 or not field_id & 0xFFFF or topology not in (1, 2) or tile_log2 > 30 or any(e[0] > 30 for e in entries):
        raise ValueError("a field id, topology or level is out of range")
    for level, key, *_ in entries:
        up = max(0, level - tile_log2)
        if topology == 1:
            mark = 60 - 2 * up
            good = key and key & -key == 1 << mark and key >> 61 <= 5 and key < 1 << 64
        else:
            good = key >> level == 1 and key - (1 << level) < 1 << up
        if not good:
            raise ValueError("a key is not that of a tile")


def pack_index(field_id: int, topology: int, tile_log2: int, entries: list[tuple]) -> bytes:
    """Entries (level, unsigned key, const value or None, 32-byte hash or None), in order."""
    _index_ids(field_id, topology, tile_log2, entries)
    places = [(e[0], e[1]) for e in entries]
    if any(x >= y for x, y in zip(places, places[1:])):
        raise ValueError("entries are not in strict order")
    out = [struct.pack("<IIBBBB", field_id, len(entries), topology, tile_log2, 8, 0)]
    for level, key, const, digest in entries:
        out.append(struct.pack("<BB6xQ", level, const is not None, key) + (struct.pack("<q24x", const) if const is not None else digest))
    return b"".join(out)


def unpack_index(data: bytes) -> tuple[int, int, int, list[tuple]]:
    field_id, count, topology, tile_log2, eight, zero = struct.unpack_from("<IIBBBB", data)
    if eight != 8 or zero or len(data) != 12 + 48 * count:
        raise ValueError("not an index")
    out = []
    for k in range(count):
        level, flag, pad, key = struct.unpack_from("<BB6sQ", data, 12 + 48 * k)
        rest = data[28 + 48 * k : 60 + 48 * k]
        if flag > 1 or any(pad) or flag and any(rest[8:]):
            raise ValueError("padding is not zero")
        out.append((level, key, struct.unpack("<q", rest[:8])[0] if flag else None, None if flag else rest))
    if any(x[:2] >= y[:2] for x, y in zip(out, out[1:])):
        raise ValueError("entries are not in strict order")
    _index_ids(field_id, topology, tile_log2, out)
    return field_id, topology, tile_log2, out


def store(data: bytes) -> bytes:
    """Even bytes, then odd bytes, compressed."""
    raw = np.frombuffer(data, np.uint8)
    return zstandard.ZstdCompressor(level=3).compress(np.concatenate([raw[::2], raw[1::2]]).tobytes())


def restore(data: bytes, most: int = MOST_BYTES) -> bytes:
    """The inverse of ``store``: one whole frame and nothing behind it, with at most ``most``
    bytes of content. What the frame says of its size is not trusted beyond that."""
    zstd = zstandard.ZstdDecompressor(max_window_size=64 << 20)
    try:
        with zstd.stream_reader(data) as reader:
            if len(reader.read(most + 1)) > most:
                raise ValueError("more bytes than allowed")
        whole = zstd.decompressobj()
        raw = whole.decompress(data)
    except zstandard.ZstdError as bad:
        raise ValueError("not a frame") from bad
    if not whole.eof or whole.unused_data:
        raise ValueError("the frame is cut off, or something follows it")
    both = np.frombuffer(raw, np.uint8)
    out = np.empty(len(both), np.uint8)
    half = (len(both) + 1) // 2
    out[::2], out[1::2] = both[:half], both[half:]
    return out.tobytes()


@F.pandas_udf(StringType())
def blake3_hex(texts: pd.Series) -> pd.Series:
    """BLAKE3 of strings in hex; null stays null."""
    known = texts.notna()
    out = pd.Series([None] * len(texts), dtype=object, index=texts.index)
    found, held, size = [], [], 0
    for text in texts[known]:
        held.append(text.encode())
        size += len(held[-1])
        if size >= 1 << 20:  # lanes of about a megabyte at a time
            found += blake3(held)
            held, size = [], 0
    out[known] = [d.hex() for d in found + blake3(held)]
    return out


@F.pandas_udf(StringType())
def canonical_or_null(texts: pd.Series) -> pd.Series:
    """Canonical JSON of strings; null where a text is none."""

    def one(text):
        try:
            return None if text is None else canonical_json(text)
        except (ValueError, RecursionError):
            return None

    return texts.map(one)  # row by row: no built-in function orders names or writes numbers so
