"""Columnar text kernels shared by the operators of this subpackage.

Everything here works on the UTF-8 buffer of an Arrow string column: word
spans, 64-bit span hashes and n-gram hashes come out as numpy arrays, without
a Python object per word.  Nulls count as empty text.  Batches are cut into
blocks of whole documents, so memory follows the block and the longest text,
never the partition.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
LONG_SPAN = 512
_CODEC = "zstd"

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
_POSITION = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                      0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2127599BF4325C37], dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``size`` text bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    trim()


def trim() -> None:
    """Give freed memory and the tables of powers back: workers live on beside the next stage's."""
    for k, have in enumerate(_powers):
        _powers[k] = have[:1].copy()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def space_flags(data: np.ndarray) -> np.ndarray:
    """True for the bytes 0x20 and 0x09-0x0D."""
    return (data == 32) | ((data - np.uint8(9)) < 5)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; other bytes, so other letters, stay."""
    return np.where((data - np.uint8(65)) < 26, data | np.uint8(32), data)


def spans(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of set flags within each value: starts, ends, and the n + 1 offsets of the values' runs."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = flags.copy()
    first[1:] &= ~flags[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(flags)]
    first[inner] = flags[inner]
    last = flags.copy()
    last[:-1] &= ~flags[1:]
    inner = inner[inner > 0]
    last[inner - 1] = flags[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(33))) * _MIX_1
    h = (h ^ (h >> np.uint64(33))) * _MIX_2
    return h ^ (h >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    for k, base in enumerate((_P, _P_INVERSE)):
        while len(_powers[k]) < n:
            have = _powers[k]
            _powers[k] = np.concatenate([have, have * (have[-1:] * base)])
    return _powers[0], _powers[1]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same for equal bytes in any block.

    A polynomial over prefix sums; long spans, where some texts have colliding
    polynomials whatever the base, are hashed one by one.
    """
    powers, inverses = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:len(data)], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * inverses[starts])
    for i in np.flatnonzero(ends - starts >= LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of one word sequence (windows may cross values; see window_offsets)."""
    count = max(0, len(words) - n + 1)
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total += (words[k:k + count] ^ (words[k:k + count] >> np.uint64(29))) * _POSITION[k % 8] * np.uint64(2 * (k // 8) + 1)
    return mix(total)


def words_of(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words split at 0x20 and 0x09-0x0D: (bytes, starts, ends, word offsets by value)."""
    data, offsets = utf8(column)
    if lower:
        data = lower_ascii(data)
    return data, *spans(~space_flags(data), offsets)


def sums_by_value(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags (or counts) within each value."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty lines between newline bytes: starts, ends, line offsets by value."""
    return spans(data != 10, offsets)


def value_index(offsets: np.ndarray) -> np.ndarray:
    """For each element under ``offsets``, the number of its value."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """An array as compressed byte planes; ascending values as differences, whose high planes are nearly empty."""
    if ascending and len(values):
        values = np.diff(values, prepend=values[:1] * 0)
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec(_CODEC, compression_level=1).compress(planes, asbytes=True)


def unpack(data: bytes, kind: type, ascending: bool = False) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = pa.Codec(_CODEC).decompress(data[8:], n * size, asbytes=True) if n else b""
    values = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if ascending else values
