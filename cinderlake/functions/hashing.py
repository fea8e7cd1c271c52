"""Fingerprints.  Spark has no wrapping multiplication, so FNV-1a runs in Arrow batches.

The hash takes one byte after the other, but can be computed by vector steps.  A step
adds d = (low ^ byte) - low to the state and multiplies by the prime, where low is the
state's lowest byte; so after n bytes the state is h * P ** n plus the sum of d_i * P **
(n - i), modulo 2 ** 64.  The lowest byte depends on the lowest bytes before only, and
bit k of it is an exclusive-or of all earlier bits k and of carries from lower bits: eight
running exclusive-ors give it for all places at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from .jsontree import TEXT, _load, canonical

BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3
_MASK = 0xFFFFFFFFFFFFFFFF
#: Bytes of one vector step; shorter data goes through a plain loop.
CHUNK, SHORT = 1 << 18, 1 << 10
#: Fewer items than this aren't worth a vector step across them.
FEW = 48
_powers: list[np.ndarray] = []


def _power(n: int) -> np.ndarray:
    """PRIME ** 0 .. PRIME ** (n - 1), modulo 2 ** 64."""
    if not _powers:
        have = np.full(CHUNK + 1, PRIME, np.uint64)
        have[0] = 1
        _powers.append(np.cumprod(have, dtype=np.uint64))
    return _powers[0][:n]


def folded(state: int, data: bytes) -> int:
    """The state of FNV-1a after more bytes; the first state is ``BASIS``."""
    if len(data) < SHORT:
        for b in data:
            state = (state ^ b) * PRIME & _MASK
        return state
    one = np.uint8(1)
    with np.errstate(over="ignore"):
        for at in range(0, len(data), CHUNK):
            b = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - at), at)
            low = np.zeros(len(b), np.uint8)  # the state's lowest byte before each step, as far as its bits are known
            for k in range(8):
                known = low ^ (b & np.uint8((1 << k) - 1))
                flips = (b >> np.uint8(k) & one) ^ (known * np.uint8(PRIME & 0xFF) >> np.uint8(k) & one)
                bits = np.empty(len(b), np.uint8)
                bits[0] = state >> k & 1
                np.bitwise_xor.accumulate(flips[:-1], out=bits[1:])
                bits[1:] ^= bits[0]
                low |= bits << np.uint8(k)
            steps = ((low ^ b).astype(np.int64) - low).astype(np.uint64)
            power = _power(len(b) + 1)
            state = (state * int(power[-1]) + int((steps * power[:0:-1]).sum(dtype=np.uint64))) & _MASK
    return state


def fnv1a(data: bytes) -> str:
    return f"{folded(BASIS, data):016x}"


def fnv1a_many(items: list[bytes]) -> list[str]:
    """Short items side by side, one vector step a place, while there are many; long items, and what is left of others, one by one."""
    order = [i for i in sorted(range(len(items)), key=lambda i: -len(items[i])) if len(items[i]) < SHORT]
    lengths = [len(items[i]) for i in order]
    states, at, alive = np.full(len(order), BASIS, np.uint64), 0, len(order)
    with np.errstate(over="ignore"):
        while True:
            while alive and lengths[alive - 1] <= at:
                alive -= 1
            if alive < FEW:
                break
            column = np.fromiter((items[i][at] for i in order[:alive]), np.uint64, alive)
            states[:alive] = (states[:alive] ^ column) * np.uint64(PRIME)
            at += 1
    out = [fnv1a(x) if len(x) >= SHORT else "" for x in items]
    for place, i in enumerate(order):
        out[i] = f"{folded(int(states[place]), items[i][at:]):016x}"
    return out


@F.pandas_udf(TEXT)
def fnv1a_hex(texts: pd.Series) -> pd.Series:
    """FNV-1a, 64 bits, of the UTF-8 bytes, as 16 hex digits."""
    known = [(i, t.encode() if isinstance(t, str) else bytes(t)) for i, t in enumerate(texts) if t is not None]
    out = [None] * len(texts)
    for (i, _), h in zip(known, fnv1a_many([b for _, b in known])):
        out[i] = h
    return pd.Series(out, dtype=object)


@F.pandas_udf(TEXT)
def manifest_fingerprint(tools: pd.Series) -> pd.Series:
    """Of a JSON array of tools: sorted by name, canonical, hashed."""
    places, data = [], []
    for i, t in enumerate(tools):
        ok, v = _load(t)
        if ok and isinstance(v, list):
            places.append(i)
            data.append(canonical(sorted(v, key=lambda x: x.get("name") or "")).encode())
    out = [None] * len(tools)
    for i, h in zip(places, fnv1a_many(data)):
        out[i] = h
    return pd.Series(out, dtype=object)


def tree_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of directories whose files (tree, path, content) come in order: for each file its path, a zero byte, its length and its content.

    The state goes on from batch to batch, so a task holds one batch, however large a tree is.
    """
    tree, state = None, None
    kind = None
    for batch in batches:
        done = []
        kind = batch.schema.field(0).type
        for name, path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if state is None or name != tree:
                if state is not None:
                    done.append((tree, f"{state:016x}"))
                tree, state = name, BASIS
            data = content.as_buffer().to_pybytes() if content.is_valid else b""
            state = folded(folded(state, path.encode() + b"\0" + len(data).to_bytes(8, "little")), data)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in done], kind), pa.array([h for _, h in done])], ["tree", "fingerprint"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([tree], kind), pa.array([f"{state:016x}"])], ["tree", "fingerprint"])
