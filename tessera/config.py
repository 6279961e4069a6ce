"""Parameters of the retrieval engine. Dimension is data, everything else a default."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    planes: int = 32
    segment_bits: int = 8
    #: Records of an extent; 283 fill a 128 KiB block of 384-d vectors.
    extent_capacity: int = 283
    window_tokens: int = 96
    window_step: int = 64
    min_chunk_chars: int = 50
    min_page_tokens: int = 20
    top_k: int = 5
    probes: int = 4

    @property
    def segments(self) -> int:
        return 1 << self.segment_bits


#: The test vectors are few, so extents are kept small enough for segments to hold several.
SMALL = Config(extent_capacity=4)
