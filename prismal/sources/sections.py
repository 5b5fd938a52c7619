"""Sections of arrays: `first:last:stride` for each dimension."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Range:
    first: int
    last: int
    stride: int = 1

    @property
    def count(self) -> int:
        return (self.last - self.first) // self.stride + 1

    @staticmethod
    def parse(text: str) -> Range:
        parts = [int(p) for p in text.strip().split(":")]
        if len(parts) == 1:
            return Range(parts[0], parts[0])
        return Range(*parts)

    def every(self, n: int) -> Range:
        """Every n-th of these; the last one is the last that is met."""
        stride = self.stride * n
        return Range(self.first, self.first + (self.last - self.first) // stride * stride, stride)

    def __str__(self) -> str:
        return f"{self.first}:{self.last}:{self.stride}"


def parse(text: str) -> list[Range]:
    return [Range.parse(p) for p in text.split(",")]


def whole(shape: tuple[int, ...]) -> list[Range]:
    return [Range(0, n - 1) for n in shape]


def with_stride(section: list[Range], strides: tuple[int, ...]) -> list[Range]:
    if len(section) != len(strides):
        raise ValueError(f"{len(strides)} strides for {len(section)} dimensions")
    return [r.every(n) for r, n in zip(section, strides, strict=True)]


def spell(section: list[Range]) -> str:
    return ",".join(map(str, section))
