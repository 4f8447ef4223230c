"""Strided selections of rows and columns: start and step of each, nested, undone, and as filters."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Stride(NamedTuple):
    """start, start + step, start + 2 step, ..."""

    start: int
    step: int

    def of(self, outer: Stride) -> Stride:
        """This selection made within `outer`, in terms of the whole."""
        return Stride(self.start * outer.step + outer.start, self.step * outer.step)

    def within(self, outer: Stride) -> Stride:
        """The selection that, made within `outer`, gives this one; ValueError if this isn't part of it."""
        if self.step % outer.step or (self.start - outer.start) % outer.step or self.start < outer.start:
            raise ValueError(f"{self} is not within {outer}")
        return Stride((self.start - outer.start) // outer.step, self.step // outer.step)

    def holds(self, index: Column) -> Column:
        return (index % self.step == self.start % self.step) & (index >= self.start)

    def local(self, index: Column) -> Column:
        """Place of a held index within the selection."""
        return ((index - self.start) / self.step).cast("int")


class Shard(NamedTuple):
    rows: Stride
    columns: Stride

    def of(self, outer: Shard) -> Shard:
        return Shard(self.rows.of(outer.rows), self.columns.of(outer.columns))

    def within(self, outer: Shard) -> Shard:
        return Shard(self.rows.within(outer.rows), self.columns.within(outer.columns))

    def on_diagonal(self) -> bool:
        return self.rows == self.columns


def shards(factor: int) -> list[Shard]:
    """The factor * factor shards of a matrix, row by row."""
    if factor < 1:
        raise ValueError("a factor is 1 at least")
    return [Shard(Stride(i, factor), Stride(j, factor)) for i in range(factor) for j in range(factor)]


def select(i: Column, j: Column, shard: Shard | None) -> Column:
    """The filter of a shard; everything without one."""
    return F.lit(True) if shard is None else shard.rows.holds(i) & shard.columns.holds(j)
