"""Predicates on ids: ranges, sets, boolean combinations. A selector turns into a Column where it
can (Parquet then skips row groups), and into a semi or anti join where its ids are a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Selector:
    """Combine with &, |, ^ and ~."""

    def column(self, of: Column) -> Column:
        raise NotImplementedError

    def apply(self, rows: DataFrame, id_col: str = "vec_id") -> DataFrame:
        return rows.filter(self.column(F.col(id_col)))

    def __and__(self, other: Selector) -> Selector:
        return _Made(lambda c: self.column(c) & other.column(c))

    def __or__(self, other: Selector) -> Selector:
        return _Made(lambda c: self.column(c) | other.column(c))

    def __xor__(self, other: Selector) -> Selector:
        return _Made(lambda c: self.column(c) != other.column(c))

    def __invert__(self) -> Selector:
        return _Made(lambda c: ~self.column(c))


@dataclass
class _Made(Selector):
    make: object

    def column(self, of: Column) -> Column:
        return self.make(of)


@dataclass
class Everything(Selector):
    def column(self, of: Column) -> Column:
        return F.lit(True)


@dataclass
class Between(Selector):
    """low <= id < high."""

    low: int
    high: int

    def column(self, of: Column) -> Column:
        return (of >= self.low) & (of < self.high)


@dataclass
class OneOf(Selector):
    """A list of ids that the caller holds; a bitmap or a batch of ids comes to the same."""

    ids: tuple[int, ...]

    def column(self, of: Column) -> Column:
        return of.isin(*self.ids)


@dataclass
class Bitmap(Selector):
    """Bit id % 8 of byte id // 8."""

    raw: bytes

    def column(self, of: Column) -> Column:
        return of.isin(*[8 * i + j for i, b in enumerate(self.raw) for j in range(8) if b >> j & 1])


@dataclass
class Predicate(Selector):
    """Any function of the id column; a Python function comes wrapped in a pandas UDF."""

    make: object

    def column(self, of: Column) -> Column:
        return self.make(of)


def in_table(rows: DataFrame, ids: DataFrame, id_col: str = "vec_id", keep: bool = True) -> DataFrame:
    """Rows whose id is (or isn't) in a table of ids of any size."""
    return rows.join(ids.select(id_col).distinct(), id_col, "left_semi" if keep else "left_anti")


def translated(rows: DataFrame, id_map: DataFrame, selector: Selector) -> DataFrame:
    """Rows whose external id passes; id_map: (vec_id, external_id)."""
    return rows.join(selector.apply(id_map, "external_id").select("vec_id"), "vec_id", "left_semi")
