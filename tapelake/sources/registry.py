"""The defect and shape registry: one row per entry, from text or from any table of the same columns."""

from __future__ import annotations

import datetime as dt
import hashlib
import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelake.operators.registry_rules import chain_problems, rule_problems
from tapelake.session import small_frame

# Fixed values.
HANDLED_PATCHES = frozenset({"time_6digit"})
REGISTRY_SCHEMA = ("pos int, id string, code string, kind string, stream string, days array<string>, status string, "
                   "superseded_by string, created_at string, evidence string, evidence_sha256 string, "
                   "decision_ref string, decision_sha256 string, read_layer_action string, note string")
_COLUMNS = [part.strip().split(" ")[0] for part in REGISTRY_SCHEMA.split(", ")]


class RegistryError(ValueError):
    """The registry breaks its own rules."""


@dataclass(frozen=True)
class Registry:
    """Typed entries plus the digest of the text they came from."""

    entries: DataFrame
    sha256: str


def registry_rows(spark: SparkSession, text: str) -> DataFrame:
    """The entries as written, dates as text so that the rules can judge them; absent keys are null."""
    rows = []
    for pos, entry in enumerate(tomllib.loads(text).get("defect", []), 1):
        row = {k: v if v is None else v.isoformat() if isinstance(v, dt.date) else str(v)
               for k, v in entry.items() if k != "days"}
        row["pos"] = pos
        if "days" in entry:
            row["days"] = [d.isoformat() if isinstance(d, dt.date) else str(d) for d in entry["days"]]
        rows.append(tuple(row.get(c) for c in _COLUMNS))
    return small_frame(spark, rows, REGISTRY_SCHEMA)


def typed_entries(rows: DataFrame) -> DataFrame:
    """Days and creation date as dates; no days means the entry holds for every day."""
    days = F.transform(F.coalesce("days", F.array().cast("array<string>")), lambda d: F.to_date(d))
    return rows.withColumn("days", days).withColumn("created_at", F.to_date("created_at"))


def parse_registry(spark: SparkSession, text: str) -> Registry:
    """Read and judge registry text; any broken rule raises :class:`RegistryError`."""
    rows = registry_rows(spark, text)
    problems = rule_problems(rows).select("id", "problem").unionByName(chain_problems(rows).select("id", "problem"))
    found = problems.sort("id", "problem").limit(20).collect()
    if found:
        raise RegistryError("; ".join(f"{r['id']}: {r['problem']}" for r in found))
    return Registry(typed_entries(rows), hashlib.sha256(text.encode()).hexdigest())
