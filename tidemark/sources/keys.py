"""Mappers of compound keys: named columns from a key's parts, and a key from named columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyMapper:
    """names: of the parts, with their Spark types.  A part is a group of `pattern`, or has a fixed length (the last one may have None: the rest)."""

    key: str
    names: tuple[str, ...]
    types: tuple[str, ...] = ()
    pattern: str | None = None
    lengths: tuple[int | None, ...] = ()

    def split(self, rows: DataFrame) -> DataFrame:
        """rows with a column for each part; the key stays."""
        whole, at, out = F.col(f"`{self.key}`").cast("string"), 1, []
        for i, name in enumerate(self.names):
            if self.pattern is not None:
                part = F.regexp_extract(whole, self.pattern, i + 1)
            else:
                n = self.lengths[i]
                part = F.substring(whole, at, 2**31 - 1 if n is None else n)
                at += n or 0
            out.append(part.cast(self.types[i] if self.types else "string").alias(name))
        return rows.select("*", *out)

    def pushed(self, predicate: tuple | None) -> tuple | None:
        """predicate with the key's own condition, where it fixes every part: pk = the parts put together."""
        parts = predicate[1:] if predicate and predicate[0] == "and" else (predicate,) if predicate else ()
        fixed = {p[1]: p[2] for p in parts if len(p) == 3 and p[0] == "=" and p[1] in self.names}
        if set(fixed) != set(self.names):
            return predicate
        whole = "".join(str(fixed[n]) for n in self.names)
        if self.pattern is not None and not re.fullmatch(self.pattern, whole) or any(n is not None and len(str(fixed[x])) != n for x, n in zip(self.names, self.lengths, strict=False)):
            return predicate
        return ("and", ("=", self.key, whole), *parts)


def choose(mappers: dict[str, KeyMapper], table: str) -> KeyMapper | None:
    """The mapper of the first regex that the table's whole name matches."""
    return next((m for pattern, m in mappers.items() if re.fullmatch(pattern, table)), None)
