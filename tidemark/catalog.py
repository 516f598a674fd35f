"""Tenants, their metrics and the metrics' fields."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from .types import spark_type

#: The schema that holds the tenants' tables, where a catalog names no other.
ROOT = "tidemark"


@dataclass(frozen=True)
class Field:
    """cname: the canonical id; name: what users see; aliases: further names it was written under."""

    cname: str
    name: str
    type: str
    aliases: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        spark_type(self.type)

    def inputs(self) -> list[str]:
        """Columns that may hold the field, by precedence: the user's name, aliases as declared, the canonical id."""
        return list(dict.fromkeys([self.name, *self.aliases, self.cname]))


@dataclass(frozen=True)
class Metric:
    """A table of a tenant.  A metric that was deleted and made again has a new metric_id, which hides its old rows."""

    org: str
    metric_id: str
    name: str
    fields: tuple[Field, ...] = ()
    aliases: tuple[str, ...] = ()


@dataclass
class Catalog:
    """All tenants' metrics.  Lookups read the current state, so new metrics are seen by the next query."""

    metrics: list[Metric] = field(default_factory=list)
    extra_orgs: tuple[str, ...] = ()
    root: str = ROOT

    def orgs(self) -> list[str]:
        return sorted({m.org for m in self.metrics} | set(self.extra_orgs))

    def tables(self, org: str) -> list[Metric]:
        return sorted((m for m in self.metrics if m.org == org), key=lambda m: m.name)

    def find(self, org: str, name: str) -> Metric:
        """By user name first, then by alias; names are case-insensitive."""
        own, low = self.tables(org), name.lower()
        for of in (lambda m: [m.name], lambda m: m.aliases):
            for m in own:
                if low in (x.lower() for x in of(m)):
                    return m
        raise KeyError(f"{org} has no table {name!r}")

    def add(self, metric: Metric) -> None:
        self.metrics = [m for m in self.metrics if (m.org, m.name) != (metric.org, metric.name)] + [metric]

    def drop(self, org: str, name: str) -> None:
        gone = self.find(org, name)
        self.metrics = [m for m in self.metrics if m is not gone]

    def to_json(self) -> str:
        return json.dumps({"root": self.root, "orgs": list(self.extra_orgs), "metrics": [asdict(m) for m in self.metrics]})

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        data = json.loads(text)
        made = [Metric(m["org"], m["metric_id"], m["name"], tuple(Field(f["cname"], f["name"], f["type"], tuple(f.get("aliases", ()))) for f in m.get("fields", ())), tuple(m.get("aliases", ()))) for m in data.get("metrics", ())]
        return cls(made, tuple(data.get("orgs", ())), data.get("root", ROOT))
