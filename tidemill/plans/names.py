"""Names in scope: which column of a DataFrame a reference means."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from tidemill.errors import EngineError
from tidemill.plans.syntax import Ref


@dataclass(frozen=True)
class Field:
    """A column: what users call it, what the DataFrame calls it, its type and whether it may hold NULL."""

    name: str
    table: str | None
    internal: str
    kind: T.DataType
    nullable: bool = True

    @property
    def label(self) -> str:
        return self.name if self.table is None else f"{self.table}.{self.name}"


@dataclass(frozen=True)
class Scope:
    """Fields in order. Names are case-sensitive and may occur twice, as long as nobody asks for them."""

    fields: tuple[Field, ...]

    def find(self, ref: Ref) -> Field:
        hits = [f for f in self.fields if f.name == ref.name and ref.table in (None, f.table)]
        if not hits and ref.table is not None:
            # After a projection columns have no table, but one may be called by its dotted name.
            hits = [f for f in self.fields if f.name == str(ref)]
        if len(hits) == 1:
            return hits[0]
        raise EngineError(f"{'ambiguous' if hits else 'unknown'} column {ref}")

    def has(self, ref: Ref) -> bool:
        try:
            self.find(ref)
        except EngineError:
            return False
        return True

    def names(self) -> list[str]:
        return [f.label for f in self.fields]

    def __add__(self, other: Scope) -> Scope:
        return Scope(self.fields + other.fields)
