"""The tools' surface: a registry with typed parameters, results with errors, schemas, entity lookup, row formatting."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog


@dataclass(frozen=True)
class Tool:
    """A query with a name, a description and typed parameters; run(catalog, **parameters) gives a DataFrame."""

    name: str
    description: str
    run: Callable[..., DataFrame]
    choices: dict[str, tuple] = field(default_factory=dict)

    @property
    def parameters(self) -> dict[str, inspect.Parameter]:
        return dict(list(inspect.signature(self.run).parameters.items())[1:])


@dataclass(frozen=True)
class Result:
    """What a call gives: the data, or the reason why there is none."""

    success: bool
    data: DataFrame | None = None
    error: str | None = None


TOOLS: dict[str, Tool] = {}
_KINDS = {"int": "integer", "float": "number", "bool": "boolean", "str": "string"}


def tool(**choices: tuple) -> Callable:
    """Registers a function under its name; choices: the values a parameter may have."""

    def register(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        TOOLS[run.__name__] = Tool(run.__name__, " ".join((run.__doc__ or "").split()), run, choices)

        @functools.wraps(run)
        def checked(cat: Catalog, **values: Any) -> DataFrame:
            for name, allowed in choices.items():
                if name in values and values[name] not in allowed:
                    raise ValueError(f"{name} is one of {', '.join(map(str, allowed))}")
            return run(cat, **values)

        return checked

    return register


def call(cat: Catalog, name: str, **values: Any) -> Result:
    """Runs a tool by name; an unknown tool, unknown or missing parameters and values out of choice come back as errors."""
    found = TOOLS.get(name)
    if found is None:
        return Result(False, error=f"no tool {name}")
    wanted = found.parameters
    if unknown := sorted(set(values) - set(wanted)):
        return Result(False, error=f"unknown parameter: {', '.join(unknown)}")
    if missing := [k for k, p in wanted.items() if p.default is p.empty and values.get(k) in (None, "", [], ())]:
        return Result(False, error=f"missing parameter: {', '.join(missing)}")
    for key, allowed in found.choices.items():
        if key in values and values[key] not in allowed:
            return Result(False, error=f"{key} is one of {', '.join(map(str, allowed))}")
    return Result(True, data=found.run(cat, **values))


def schema(name: str) -> dict[str, Any]:
    """The JSON schema of a tool's parameters."""
    t = TOOLS[name]
    properties, required = {}, []
    for key, p in t.parameters.items():
        kind = str(p.annotation).replace("<class '", "").replace("'>", "").split(" |")[0]
        entry: dict[str, Any] = {"type": "array", "items": {"type": _KINDS.get(kind[5:-1], "string")}} if kind.startswith("list") else {"type": _KINDS.get(kind, "string")}
        if key in t.choices:
            entry["enum"] = list(t.choices[key])
        if p.default is p.empty:
            required.append(key)
        elif p.default is not None:
            entry["default"] = list(p.default) if isinstance(p.default, tuple) else p.default
        properties[key] = entry
    return {"name": t.name, "description": t.description, "parameters": {"type": "object", "properties": properties, "required": required}}


def resolved(entities: DataFrame, name: str, alias: str | None = None) -> DataFrame:
    """(id, name), at most one row: the exact name (case aside), else the exact alias, else the shortest name that holds it; ties by id."""
    low, wanted = F.lower("name"), F.lit(name.strip().lower())
    rank = F.when(low == wanted, 0)
    if alias:
        rank = rank.when(F.lower(alias) == wanted, 1)
    rank = rank.when(F.contains(low, wanted), 2)
    rows = entities.select("id", "name", rank.alias("rank")).where("rank IS NOT NULL")
    return rows.orderBy("rank", F.when(F.col("rank") == 2, F.length("name")).otherwise(0), "id").limit(1).select("id", "name")


def found_by_name(entities: DataFrame, name: str) -> DataFrame:
    """(id, name), at most one row: of the names that hold it the exact one, else the first by name; ties by id."""
    low, wanted = F.lower("name"), F.lit(name.strip().lower())
    return entities.where(F.contains(low, wanted)).orderBy(F.when(low == wanted, 0).otherwise(1), "name", "id").limit(1).select("id", "name")


def top(df: DataFrame, limit: int | None, *order: Column | str) -> DataFrame:
    """The first `limit` rows in a total order; all rows, unordered, without a limit."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def all_of(*predicates: Column | None) -> Column:
    """The predicates that are given, joined by AND."""
    given = [p for p in predicates if p is not None]
    return functools.reduce(lambda a, b: a & b, given, F.lit(True))


def format_rows(df: DataFrame, template: str) -> DataFrame:
    """(line): each row as text; {name} in the template stands for a column, a null for nothing."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return df.select(F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)]).alias("line"))
