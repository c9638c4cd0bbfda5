"""Keccak-256 (the padding of before SHA-3) over a batch of byte strings at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

RATE = 136  # bytes absorbed a round: 1600 bits less twice the digest
_ONE = np.uint64(1)


def _round_constants() -> list[np.uint64]:
    """Bit 2^j - 1 of constant k is output 7k + j of the register x^8 + x^6 + x^5 + x^4 + 1."""
    bits, state = [], 1
    for _ in range(24 * 7):
        bits.append(state & 1)
        state <<= 1
        if state & 0x100:
            state ^= 0x171
    return [np.uint64(sum(bits[7 * k + j] << ((1 << j) - 1) for j in range(7))) for k in range(24)]


def _rotations() -> dict[tuple[int, int], int]:
    """Lane offsets: the triangular numbers along the walk (x, y) -> (y, 2x + 3y)."""
    out, x, y = {(0, 0): 0}, 1, 0
    for t in range(24):
        out[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


_CONSTANTS, _OFFSETS = _round_constants(), _rotations()


def _turn(lane: np.ndarray, n: int) -> np.ndarray:
    return lane if not n else (lane << np.uint64(n)) | (lane >> np.uint64(64 - n))


def _permute(state: np.ndarray) -> np.ndarray:
    """state[y, x] holds lane (x, y) of every message."""
    for constant in _CONSTANTS:
        parity = np.bitwise_xor.reduce(state, axis=0)
        state = state ^ np.stack([parity[(x - 1) % 5] ^ _turn(parity[(x + 1) % 5], 1) for x in range(5)])[None]
        moved = np.empty_like(state)
        for (x, y), n in _OFFSETS.items():
            moved[(2 * x + 3 * y) % 5, y] = _turn(state[y, x], n)
        state = moved ^ (~np.roll(moved, -1, axis=1) & np.roll(moved, -2, axis=1))
        state[0, 0] ^= constant
    return state


def keccak256_batch(messages: list[bytes]) -> list[bytes]:
    """Digests of whole messages. Messages of as many blocks are absorbed together, so a long one doesn't hold up short ones."""
    out: list[bytes] = [b""] * len(messages)
    groups: dict[int, list[int]] = {}
    for k, m in enumerate(messages):
        groups.setdefault(len(m) // RATE + 1, []).append(k)
    for blocks, members in groups.items():
        state = np.zeros((5, 5, len(members)), dtype=np.uint64)
        for b in range(blocks):
            padded = bytearray(RATE * len(members))
            for at, k in enumerate(members):
                part = messages[k][b * RATE : (b + 1) * RATE]
                padded[at * RATE : at * RATE + len(part)] = part
                if b == blocks - 1:
                    padded[at * RATE + len(part)] ^= 0x01
                    padded[(at + 1) * RATE - 1] ^= 0x80
            lanes = np.frombuffer(bytes(padded), dtype="<u8").reshape(len(members), RATE // 8).T
            for i, lane in enumerate(lanes):
                state[i // 5, i % 5] ^= lane
            state = _permute(state)
        digests = np.ascontiguousarray(state[0, :4].T).astype("<u8")
        for at, k in enumerate(members):
            out[k] = digests[at].tobytes()
    return out


@F.arrow_udf(BinaryType())
def keccak256(data: pa.Array) -> pa.Array:
    """Digest of each byte string; null stays null."""
    values = data.to_pylist()
    digests = iter(keccak256_batch([v for v in values if v is not None]))
    return pa.array([None if v is None else next(digests) for v in values], pa.binary())
