"""Sort keys: their grammar, their compilation to Spark orders, and an exact comparator."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NoSortKeys


@dataclass(frozen=True)
class SortKey:
    """A top-level column, its direction, and where nulls go, each independent of the others."""

    name: str
    descending: bool = False
    nulls_first: bool = False

    def column(self) -> Column:
        return F.col(f"`{self.name}`")

    def order(self) -> Column:
        c = self.column()
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()

    def reversed(self) -> SortKey:
        """The key of the opposite order: direction and place of nulls both turn."""
        return replace(self, descending=not self.descending, nulls_first=not self.nulls_first)

    def text(self) -> str:
        return f"{self.name}:{'desc' if self.descending else 'asc'}:{str(self.nulls_first).lower()}"


def parse_sort_key(text: str) -> SortKey:
    """``name:asc|desc[:true|false]``; the third part says whether nulls come first."""
    parts = text.split(":")
    if len(parts) not in (2, 3) or not parts[0]:
        raise ValueError(f"'{text}' is not name:asc|desc[:nulls_first]")
    if parts[1].lower() not in ("asc", "desc"):
        raise ValueError(f"'{parts[1]}' is neither asc nor desc")
    if len(parts) == 3 and parts[2].lower() not in ("true", "false"):
        raise ValueError(f"'{parts[2]}' is neither true nor false")
    return SortKey(parts[0], parts[1].lower() == "desc", len(parts) == 3 and parts[2].lower() == "true")


def parse_memory_size(text: str) -> int:
    """Bytes of ``<integer>B|KB|MB|GB`` (powers of 1024, any case)."""
    m = re.fullmatch(r"\s*(\d+)\s*(B|KB|MB|GB)\s*", text, re.IGNORECASE)
    if not m:
        raise ValueError(f"'{text}' is not a whole number with B, KB, MB or GB")
    return int(m[1]) * 1024 ** ("B", "KB", "MB", "GB").index(m[2].upper())


def checked_keys(schema: T.StructType, keys: Sequence[SortKey]) -> list[SortKey]:
    """``keys``, once they are there, name columns of ``schema`` by exact case, and can be ordered."""
    if not keys:
        raise NoSortKeys("at least one sort key is needed")
    for k in keys:
        if k.name not in schema.fieldNames():
            raise ValueError(f"no column '{k.name}'; there are {', '.join(schema.fieldNames())}")
        if "map<" in schema[k.name].dataType.simpleString():
            raise ValueError(f"column '{k.name}' has a map, which has no order")
    return list(keys)


def orders(keys: Sequence[SortKey]) -> list[Column]:
    return [k.order() for k in keys]


def total_order(columns: Sequence[str], keys: Sequence[SortKey], schema: T.StructType | None = None) -> list[SortKey]:
    """``keys`` and then every other column that can be ordered, so that ties are left only between equal rows."""
    named = {k.name for k in keys}
    rest = [c for c in columns if c not in named and (schema is None or "map<" not in schema[c].dataType.simpleString())]
    return [*keys, *(SortKey(c) for c in rest)]


def compare(keys: Sequence[SortKey], left: str, right: str) -> tuple[Column, Column]:
    """(-1, 0 or 1, index of the first differing key or null) for two struct columns with the keys' fields."""
    result, place = F.lit(0), F.lit(None).cast("int")
    for i, k in reversed(list(enumerate(keys))):
        a, b = F.col(left)[k.name], F.col(right)[k.name]
        first = -1 if k.nulls_first else 1
        up = -1 if not k.descending else 1
        one = F.when(a.eqNullSafe(b), 0).when(a.isNull(), first).when(b.isNull(), -first).when(a < b, up).otherwise(-up)
        place = F.when(one != 0, F.lit(i)).otherwise(place)
        result = F.when(one != 0, one).otherwise(result)
    return result, place
