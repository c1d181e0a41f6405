"""Registries of searchable entities by version: which labels, and which of their columns, hold names.

A registry is a table (version, label, key, names, extras, valid_from, valid_to); a null bound is open. It is resolved when
a plan is built, so a query over several versions, each with a graph of its own, is one plan.
"""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Graph
from .entities import entity_cache

SCHEMA = "version string, label string, key string, names array<string>, extras array<string>, valid_from date, valid_to date"
#: Entries of all versions that a registry may have: it is read to build plans.
MOST_ENTRIES = 100_000


def resolve(registry: DataFrame, versions: list[str] | None = None, day: datetime.date | None = None) -> dict[str, dict[str, tuple[str, list[str], list[str]]]]:
    """For each version, its entries that are valid on a day (today), by label: (key, names, extras).

    Without `versions` it is the last one by name that has an entry valid then. Of several valid entries of a label the
    one that began last counts. An unknown version raises.
    """
    day = day or datetime.date.today()
    known = registry if versions is None else registry.where(F.col("version").isin(versions))
    valid = F.coalesce(F.col("valid_from") <= F.lit(day), F.lit(True)) & F.coalesce(F.col("valid_to") >= F.lit(day), F.lit(True))
    rows = known.where(valid).select("version", "label", "key", "names", "extras", "valid_from").limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a registry has at most {MOST_ENTRIES} entries")
    found: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: r["valid_from"] or datetime.date.min):
        found.setdefault(r["version"], {})[r["label"]] = (r["key"], list(r["names"]), list(r["extras"] or []))
    if versions is None:
        return {max(found): found[max(found)]} if found else {}
    if missing := sorted(set(versions) - set(found)):
        raise ValueError(f"no entry of version {', '.join(missing)} is valid on {day}")
    return {v: found[v] for v in versions}


def entity_caches(graphs: dict[str, Graph], registry: DataFrame, versions: list[str] | None = None, day: datetime.date | None = None) -> DataFrame:
    """(version, node_id, label, name_values, extra, display_name): the caches of several versions, each over its graph."""
    found = resolve(registry, versions, day)
    if absent := sorted(set(found) - set(graphs)):
        raise ValueError(f"no graph of version {', '.join(absent)}")
    return reduce(DataFrame.unionByName, (entity_cache(graphs[v], entries).select(F.lit(v).alias("version"), "*") for v, entries in found.items()))
