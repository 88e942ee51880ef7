"""Differences between contract versions, as rows.

Fields: entity, version, field, type, required, values, description, default (NULL where absent).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _paired(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = [k for k in ("path", "entity") if k in old.columns and k in new.columns]
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in (*keys, "field")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return old.alias("o").join(new.alias("n"), cond, "full_outer")


def _changes(old: DataFrame, new: DataFrame, names: dict[str, str], safe: str) -> DataFrame:
    both = F.col("o.field").isNotNull() & F.col("n.field").isNotNull()
    required = F.coalesce(F.col("n.required"), F.lit(False))
    was_required = F.coalesce(F.col("o.required"), F.lit(False))
    empty = F.array().cast("array<string>")
    removed = F.array_sort(F.array_except(F.coalesce("o.values", empty), F.coalesce("n.values", empty)))
    added = F.array_sort(F.array_except(F.coalesce("n.values", empty), F.coalesce("o.values", empty)))

    def change(when, kind, severity, values=None, before=None, after=None):
        return F.when(when, F.struct(
            F.lit(kind).alias("type"), F.lit(severity).alias("severity"), (values if values is not None else F.lit(None).cast("array<string>")).alias("values"),
            (before if before is not None else F.lit(None).cast("string")).alias("from"), (after if after is not None else F.lit(None).cast("string")).alias("to")))

    found = [
        change(F.col("n.field").isNull(), "field_removed", "breaking"),
        change(F.col("o.field").isNull() & required, names["added_required"], "breaking"),
        change(F.col("o.field").isNull() & ~required, names["added_optional"], safe),
        change(both & (F.col("o.type") != F.col("n.type")), "field_type_changed", "breaking", None, F.col("o.type"), F.col("n.type")),
        change(both & ~was_required & required, names["became_required"], "breaking"),
        change(both & (F.size(removed) > 0), names["values_removed"], "breaking", removed),
        change(both & (F.size(added) > 0), names["values_added"], safe, added),
    ]
    if "description" in old.columns:
        found.append(change(both & ~F.col("o.description").eqNullSafe(F.col("n.description")), "description_changed", safe))
        found.append(change(both & F.col("o.default").isNull() & F.col("n.default").isNotNull(), "field_default_added", safe, None, None, F.col("n.default")))
    keys = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in ("path", "entity") if k in old.columns and k in new.columns]
    rows = _paired(old, new).select(*keys, F.coalesce("o.field", "n.field").alias("field"),
                                    F.explode(F.filter(F.array(*found), lambda c: c.isNotNull())).alias("c"))
    return rows.select(*[k for k in ("path", "entity") if k in old.columns and k in new.columns], "field", "c.*")


# Fixed change names of the two reports.
DIFF_NAMES = {"added_required": "field_added", "added_optional": "field_added", "became_required": "field_became_required",
              "values_removed": "enum_values_removed", "values_added": "enum_values_added"}
EVOLUTION_NAMES = {"added_required": "field_required_added", "added_optional": "field_added_optional",
                   "became_required": "field_required_added", "values_removed": "enum_value_removed", "values_added": "enum_value_added"}


def contract_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Breaking and additive changes between two versions of contracts."""
    plain = [c for c in old.columns if c not in ("description", "default")]
    return _changes(old.select(*plain), new.select(*[c for c in plain if c in new.columns]), DIFF_NAMES, "non_breaking")


def evolution_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """Breaking and safe changes, with description and default changes."""
    return _changes(old, new, EVOLUTION_NAMES, "safe")


def unversioned_breaks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Contracts with a breaking change whose version did not rise."""
    broken = evolution_report(old, new).filter(F.col("severity") == "breaking").groupBy("entity").agg(F.count("*").alias("breaking_changes"))
    versions = (old.groupBy("entity").agg(F.max("version").alias("base_version"))
                .join(new.groupBy("entity").agg(F.max("version").alias("candidate_version")), "entity"))
    return broken.join(versions, "entity").filter(F.col("candidate_version") <= F.col("base_version"))
