"""Label sets: a node or edge carries a sorted array of atomic type names.

A type is a set of atoms. As in the model this engine follows, a type is a subtype of another if
its atoms are a subset of the other's, so the empty type is a subtype of all, and an entity has a
type if the type's atoms are among its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_set(*atoms: Column) -> Column:
    """The set of the non-null atoms."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*atoms))))


def flags_to_labels(columns: list[str]) -> Column:
    """The set of the names of those flag columns that are set."""
    return label_set(*[F.when(F.col(c).cast("int") > 0, F.lit(c)) for c in columns]) if columns else F.array().cast("array<string>")


def is_subtype(sub: Column, sup: Column) -> Column:
    return F.size(F.array_except(sub, sup)) == 0


def has_type(types: Column, atoms: list[str] | str) -> Column:
    wanted = [atoms] if isinstance(atoms, str) else list(atoms)
    return F.size(F.array_except(F.array(*[F.lit(a) for a in wanted]).cast("array<string>"), types)) == 0


def has_any(types: Column, names: list[list[str] | str]) -> Column:
    """Whether any of the types holds; with no names, nothing does."""
    out = F.lit(False)
    for n in names:
        out = out | has_type(types, n)
    return out


def type_name(types: Column) -> Column:
    return F.array_join(types, " & ")
