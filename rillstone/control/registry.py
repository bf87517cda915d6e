"""Feature schemas by version, kept as JSON; validation of a table against them in one pass."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillstone.schemas import ddl


@dataclass
class Feature:
    name: str
    type: str
    version: int = 1
    rules: dict = field(default_factory=dict)
    description: str = ""


class FeatureRegistry:
    """Rules: min, max, allowed_values, pattern (of the whole value) and nullable."""

    def __init__(self, path: str | Path | None = None):
        self.path = Path(path) if path else None
        self.features: dict[str, list[Feature]] = {}
        if self.path and self.path.exists():
            for name, versions in json.loads(self.path.read_text()).items():
                self.features[name] = [Feature(**v) for v in versions]

    def register(self, name: str, type: str, rules: dict | None = None, description: str = "") -> Feature:
        """A new version, or the last one if nothing differs."""
        ddl(f"x {type}")
        versions = self.features.setdefault(name, [])
        new = Feature(name, type, len(versions) + 1, rules or {}, description)
        if versions and (versions[-1].type, versions[-1].rules) == (new.type, new.rules):
            return versions[-1]
        versions.append(new)
        if self.path:
            self.path.write_text(json.dumps({k: [asdict(v) for v in vs] for k, vs in self.features.items()}, indent=1))
        return new

    def get(self, name: str, version: int | None = None) -> Feature:
        return self.features[name][-1 if version is None else version - 1]

    def compare(self, name: str, one: int, other: int) -> dict:
        a, b = self.get(name, one), self.get(name, other)
        changed = {k: (a.rules.get(k), b.rules.get(k)) for k in {*a.rules, *b.rules} if a.rules.get(k) != b.rules.get(k)}
        return {"type": None if a.type == b.type else (a.type, b.type), "rules": changed, "compatible": a.type == b.type}

    def conditions(self, name: str) -> dict[str, Column]:
        f, c = self.get(name), F.col(f"`{name}`")
        made: dict[str, Column] = {}
        if "min" in f.rules:
            made["min"] = c.isNull() | (c >= f.rules["min"])
        if "max" in f.rules:
            made["max"] = c.isNull() | (c <= f.rules["max"])
        if "allowed_values" in f.rules:
            made["allowed_values"] = c.isNull() | c.isin(*f.rules["allowed_values"])
        if "pattern" in f.rules:
            made["pattern"] = c.isNull() | c.rlike(f"^(?:{f.rules['pattern']})$")
        if f.rules.get("nullable") is False:
            made["nullable"] = c.isNotNull()
        return made

    def validate(self, df: DataFrame, names: list[str] | None = None) -> DataFrame:
        """(feature, version, type_ok, violations, valid, errors): one row for each feature, from one aggregate."""
        names = names or [n for n in self.features]
        rows, aggs = [], []
        for i, n in enumerate(names):
            want = ddl(f"x {self.get(n).type}")["x"].dataType
            have = df.schema[n].dataType if n in df.columns else None
            ok = have is not None and have.simpleString() == want.simpleString()
            rules = self.conditions(n) if have is not None else {}
            aggs += [F.count_if(~rule).alias(f"v{i}_{r}") for r, rule in rules.items()]
            count = reduce(lambda a, b: a + b, [F.col(f"v{i}_{r}") for r in rules], F.lit(0).cast("long"))
            errors = [F.lit("column is missing" if have is None else f"type is {have.simpleString()}")] if not ok else []
            errors += [F.when(F.col(f"v{i}_{r}") > 0, F.concat(F.lit(f"{r}: "), F.col(f"v{i}_{r}"))) for r in rules]
            told = F.filter(F.array(*errors), lambda x: x.isNotNull()) if errors else F.array().cast("array<string>")
            rows.append(F.struct(F.lit(n).alias("feature"), F.lit(self.get(n).version).alias("version"), F.lit(ok).alias("type_ok"), count.alias("violations"), (F.lit(ok) & (count == 0)).alias("valid"), told.alias("errors")))
        return df.agg(F.count("*").alias("n"), *aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def compatible(old: StructType, new: StructType) -> list[str]:
    """What keeps data of the old schema from being read with the new one (backward compatibility): nothing if it is empty."""
    out = []
    for f in new.fields:
        if f.name not in old.names:
            if not f.nullable:
                out.append(f"{f.name} is new and may not be null")
        elif old[f.name].dataType != f.dataType:
            widening = {("int", "bigint"), ("float", "double"), ("int", "double")}
            if (old[f.name].dataType.simpleString(), f.dataType.simpleString()) not in widening:
                out.append(f"{f.name} was {old[f.name].dataType.simpleString()}")
    return out


def missing_fields(payload: dict, schema: StructType, prefix: str = "") -> list[str]:
    """Required fields that a message lacks, by dotted name."""
    out = []
    for f in schema.fields:
        value = payload.get(f.name)
        if value is None:
            if not f.nullable:
                out.append(prefix + f.name)
        elif isinstance(f.dataType, StructType):
            out += missing_fields(value, f.dataType, f"{prefix}{f.name}.") if isinstance(value, dict) else [prefix + f.name]
    return out
