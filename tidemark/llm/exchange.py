"""Golomb-coded exchange of sorted fingerprints: which of a partition's fingerprints occur more than once anywhere.

A partition sorts its distinct 64-bit fingerprints, cuts them at the owners' ranges of the value space, codes the
differences by Golomb's rule with a power of two as divisor, and sends one blob to each owner. An owner decodes what
all partitions sent, marks the values that more than one partition holds, and answers each with a bitmap in the
order of its blob. Values that a partition itself holds twice need no answer. A blob holds a value once, so a value
that a third of all rows share costs an owner one entry for each partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SENT = "owner int, part int, n bigint, shift int, quotients binary, remainders binary, extra binary"
ANSWER = "part int, owner int, n bigint, bitmap binary"


def golomb_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Sorted uint64 values as (shift, unary quotients, packed remainders) of their differences."""
    if not len(values):
        return 0, b"", b""
    gaps = np.diff(values, prepend=np.uint64(0))
    gaps[0] = 0  # the first value goes before the remainders
    mean = float(values[-1] - values[0]) / len(values)
    shift = max(0, int(np.log2(max(mean * 0.69, 1.0))))
    quotients = (gaps >> np.uint64(shift)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    return shift, np.packbits(unary, bitorder="little").tobytes(), int(values[0]).to_bytes(8, "little") + _pack(gaps, shift)


def golomb_decode(n: int, shift: int, quotients: bytes, remainders: bytes) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8), bitorder="little"))[:n]
    high = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    gaps = (high << np.uint64(shift)) | _unpack(remainders[8:], n, shift)
    gaps[0] = int.from_bytes(remainders[:8], "little")
    return np.cumsum(gaps, dtype=np.uint64)


def _pack(values: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` of each value, packed: whole bytes as byte planes, the rest by bits."""
    planes = [((values >> np.uint64(8 * b)) & np.uint64(255)).astype(np.uint8).tobytes() for b in range(bits // 8)]
    if rest := bits % 8:
        top = ((values >> np.uint64(bits - rest)) & np.uint64((1 << rest) - 1)).astype(np.uint8)
        planes.append(np.packbits(np.unpackbits(top[:, None], axis=1, bitorder="little")[:, :rest].ravel(), bitorder="little").tobytes())
    return b"".join(planes)


def _unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    for b in range(bits // 8):
        out |= np.frombuffer(data, np.uint8, n, b * n).astype(np.uint64) << np.uint64(8 * b)
    if rest := bits % 8:
        flat = np.unpackbits(np.frombuffer(data, np.uint8, offset=bits // 8 * n), bitorder="little")[: n * rest].reshape(n, rest)
        out |= np.packbits(flat, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(bits - rest)
    return out


def sent_blobs(part: int, values: np.ndarray, owners: int, extra: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each owner that gets something. ``extra``: 32 more bits of each value, compared by owners too."""
    rows = []
    owner = (values >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)
    begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(values) else []
    for a, b in zip(begins, [*begins[1:], len(values)], strict=True) if len(values) else ():
        rows.append((int(owner[a]), part, int(b - a), *golomb_encode(values[a:b]), b"" if extra is None else extra[a:b].astype("<u4").tobytes()))
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in SENT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def repeated(values: np.ndarray, more: np.ndarray | None) -> np.ndarray:
    """Which entries occur more than once, by value and, if given, 32 more bits."""
    order = np.argsort(values)
    same = values[order][1:] == values[order][:-1]
    at = order[np.append(same, False) | np.append(False, same)]
    if more is not None and len(at):
        at = at[np.lexsort((more[at], values[at]))]
        same = (values[at][1:] == values[at][:-1]) & (more[at][1:] == more[at][:-1])
        at = at[np.append(same, False) | np.append(False, same)]
    out = np.zeros(len(values), bool)
    out[at] = True
    return out


def answers(sent: DataFrame) -> DataFrame:
    """The owners' bitmaps for what was sent: bit i is set if another partition sent the i-th value too."""

    def mark(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        values = np.concatenate([golomb_decode(r["n"], r["shift"], r["quotients"], r["remainders"]) for r in rows])
        more = np.concatenate([np.frombuffer(r["extra"], "<u4") for r in rows])
        twice = repeated(values, more if len(more) else None)
        ends = np.cumsum([r["n"] for r in rows])
        bits = [np.packbits(twice[e - r["n"] : e], bitorder="little").tobytes() for r, e in zip(rows, ends, strict=True)]
        return pa.table({"part": pa.array([r["part"] for r in rows], pa.int32()), "owner": pa.array([r["owner"] for r in rows], pa.int32()), "n": pa.array([r["n"] for r in rows], pa.int64()), "bitmap": pa.array(bits, pa.binary())})

    return sent.groupBy("owner").applyInArrow(mark, ANSWER)


def answered(table: pa.Table, n: int) -> np.ndarray:
    """The bitmaps that came back to a partition, in the order of its sorted values."""
    rows = sorted(table.to_pylist(), key=lambda r: r["owner"])
    if not rows:
        return np.zeros(n, bool)
    return np.concatenate([np.unpackbits(np.frombuffer(r["bitmap"], np.uint8), count=r["n"], bitorder="little") for r in rows]).astype(bool)
