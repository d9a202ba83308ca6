"""CRC-32C, as shard indexes carry it."""

from __future__ import annotations

import functools

POLYNOMIAL = 0x82F63B78  # reversed Castagnoli polynomial


@functools.lru_cache(maxsize=1)
def _table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (POLYNOMIAL if i & 1 else 0)
        out.append(i)
    return out


def crc32c(data: bytes) -> int:
    table, c = _table(), 0xFFFFFFFF
    for b in data:
        c = table[(c ^ b) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF
