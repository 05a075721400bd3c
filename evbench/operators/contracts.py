"""Contracts as data: rules are rows, and one pass over the cells of a row evaluates them all.

A rule has a field, what it requires, a type, a list of allowed values and a pattern, each but the field possibly empty:

    required   yes, no, or yes_for_<condition>: required where the condition holds for the row
    type       string, integer, float or date (yyyy-mm-dd)
    allowed    values with | between them
    pattern    a regular expression that the whole cell must fit

A contract is the array of its rules: as many as a table has fields.  The driver reads it and makes one expression of each rule, so that Catalyst compiles them
with their patterns and lists as constants, however many rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE = ("field", "required", "type", "allowed", "pattern")

# What a cell of a type looks like.
TYPES = {"integer": r"[+-]?\d+", "float": r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", "date": r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"}


def contract(rules: DataFrame) -> DataFrame:
    """One row with the array of the rules; rules may lack columns of RULE but for the field."""
    of = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in rules.columns else F.lit("")
    lower = lambda c: F.lower(of(c))
    rule = F.struct(of("field").alias("field"), lower("required").alias("required"), lower("type").alias("type"), of("allowed").alias("allowed"), of("pattern").alias("pattern"))
    return rules.agg(F.array_sort(F.collect_list(rule)).alias("__rules"))


def violations(df: DataFrame, ident: str, rules: DataFrame, conditions: Mapping[str, Column] | None = None) -> DataFrame:
    """(id, field, violation) of every rule that a row breaks.

    no column: the table lacks a required field (for a condition: one that holds for the row); missing: the cell is null or blank; not <type>; not allowed;
    pattern.  Rules of a condition that isn't given never apply.  A blank cell breaks nothing but being required.
    """
    holds = {name.lower(): c for name, c in (conditions or {}).items()}
    made = []
    for r in contract(rules).first()[0] or []:  # as many as a table has fields
        field, required = r["field"], r["required"]
        asked = F.lit(required in ("yes", "true"))
        if required.startswith("yes_for_"):
            asked = F.coalesce(holds.get(required[8:], F.lit(False)), F.lit(False))
        if field not in df.columns:
            why = F.when(asked, F.lit("no column"))
        else:
            cell = F.nullif(F.trim(F.col(f"`{field}`").cast("string")), F.lit(""))
            why = F.when(cell.isNull(), F.when(asked, F.lit("missing")))
            if r["type"] in TYPES:
                why = why.when(~cell.rlike(f"^({TYPES[r['type']]})$"), F.lit(f"not {r['type']}"))
            if r["allowed"]:
                why = why.when(~cell.isin(*[x.strip(" ") for x in r["allowed"].split("|")]), F.lit("not allowed"))
            if r["pattern"]:
                why = why.when(~cell.rlike(f"^(?:{r['pattern']})$"), F.lit("pattern"))
        made.append(F.struct(F.lit(field).alias("field"), why.cast("string").alias("violation")))
    found = F.array(*made) if made else F.array().cast("array<struct<field:string,violation:string>>")
    return df.select(F.col(ident).alias("id"), F.explode(found).alias("v")).select("id", "v.field", "v.violation").where(F.col("violation").isNotNull())
