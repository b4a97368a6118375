"""Interactive-style questions over the record set: filters, semi-joins, scopes, sorts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """Optional, conjunctive; empty means any."""

    text: str = ""
    supplier: str = ""
    base: str = ""
    family: str = ""
    parsed_only: bool = True
    required: str = ""


def split_key(key: str) -> tuple[str, str]:
    """'prop::xy' -> ('prop', 'xy'); without a qualifier the second part is empty."""
    base, _, side = key.partition("::")
    return base, side


def orientation_bucket(c: Column) -> Column:
    """xy, z or empty."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(low.rlike(r"\bz\b|vertical|upright|up\b"), "z")
        .when(low.rlike(r"x-y|\bxy\b|horizontal|flat|side"), "xy")
        .otherwise("")
    )


def matches_property(key: str, property_key: Column, bucket: Column) -> Column:
    base, side = split_key(key)
    return (property_key == base) & ((bucket == side) if side else F.lit(True))


def apply_filters(materials: DataFrame, obs: DataFrame, f: Filters) -> DataFrame:
    """Records that meet every given filter; the required property is a semi-join."""
    out = materials
    if f.text:
        hay = F.lower(F.concat_ws(" ", "product", "supplier", "base_material", "material_family", F.concat_ws(" ", "modifiers")))
        out = out.where(F.contains(hay, F.lit(f.text.lower())))
    for column, want in (("supplier", f.supplier), ("base_material", f.base), ("material_family", f.family)):
        if want:
            out = out.where(F.col(column) == want)
    if f.parsed_only:
        out = out.join(obs.select("material_id"), "material_id", "left_semi")
    if f.required:
        has = obs.where(matches_property(f.required, F.col("property_key"), orientation_bucket(F.col("orientation"))) & F.col("value").isNotNull())
        out = out.join(has.select("material_id"), "material_id", "left_semi")
    return out


def matches(supplier: str = "", product: str = "", source_file: str = "") -> Column:
    """Case-insensitive substrings, all of them; empty matches anything."""
    out = F.lit(True)
    for column, want in (("supplier", supplier), ("product", product), ("source_file", source_file)):
        if want:
            out = out & F.coalesce(F.contains(F.lower(column), F.lit(want.lower())), F.lit(False))
    return out


def matching(materials: DataFrame, supplier: str = "", product: str = "", source_file: str = "") -> DataFrame:
    """The records that match."""
    return materials.where(matches(supplier, product, source_file))


def natural_key(c: Column, width: int = 12) -> Column:
    """Sorts numbers in text by value and letters without case or accents: digit runs are filled with zeros."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(\d+|\D+)"), 1)
    return F.concat_ws("", F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), width, "0")).otherwise(x)))


def category_rank(c: Column, order: list[str]) -> Column:
    """Place in a fixed order; anything else comes after."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), c)
    return F.when(at > 0, at - 1).otherwise(F.lit(99))
