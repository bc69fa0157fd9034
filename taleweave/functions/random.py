"""The 32-bit generator that seeds samples and partitions."""

from __future__ import annotations

_MASK = 0xFFFFFFFF


class Mulberry32:
    """Public-domain generator: a Weyl sequence and two rounds of mixing; gives numbers in [0, 1)."""

    def __init__(self, seed: int):
        self.state = seed & _MASK

    def __call__(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & _MASK
        x = self.state
        x = ((x ^ (x >> 15)) * (x | 1)) & _MASK
        x ^= (x + (((x ^ (x >> 7)) * (x | 61)) & _MASK)) & _MASK
        return (x ^ (x >> 14)) / 4294967296
