"""Normalising, validating, routing and deduplicating evidence rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.sequences import ALPHABET
from .ranks import numbered


def resolve_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]], explicit: Mapping[str, str] | None = None) -> DataFrame:
    """Select the wanted columns by the first of their aliases that df has, ignoring case and punctuation.

    explicit: wanted -> column that must exist.  Wanted columns without a match become null strings.
    """
    plain = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
    have: dict[str, str] = {}
    for c in df.columns:
        have.setdefault(plain(c), c)
    out = []
    for want, names in aliases.items():
        if explicit and want in explicit:
            if explicit[want] not in df.columns:
                raise ValueError(f"no column {explicit[want]!r}")
            out.append(F.col(explicit[want]).alias(want))
            continue
        hit = next((have[plain(n)] for n in (want, *names) if plain(n) in have), None)
        out.append((F.col(f"`{hit}`") if hit else F.lit(None).cast("string")).alias(want))
    return df.select(*out)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def reasons(residue: Column, position: Column, ident: Column, sequence: Column) -> Column:
    """All reasons against a row, in fixed order.  Position 0 skips the range and residue checks, as does a missing sequence."""
    pos = T.lenient_int(position)
    letter = F.length(residue) == 1
    known = sequence.isNotNull() & pos.isNotNull() & (pos != 0)
    inside = (pos >= 1) & (pos <= F.length(sequence))
    return F.array_compact(
        F.array(
            F.when(ident.isNull(), "missing_id"),
            F.when(residue.isNull(), "missing_residue"),
            F.when(residue.isNotNull() & ~(letter & F.contains(F.lit(ALPHABET), residue)), "invalid_residue"),
            F.when(pos.isNull(), "invalid_position"),
            F.when(sequence.isNull(), "missing_sequence"),
            F.when(known & ~inside, "position_out_of_range"),
            F.when(known & inside & residue.isNotNull() & (F.substring(sequence, pos, F.lit(1)) != residue), "residue_mismatch"),
        )
    )


def validate(df: DataFrame, sequences: DataFrame, ident: str, residue: str, position: str) -> DataFrame:
    """df with sequence, found_residue and reasons; sequences: (accession, sequence), one row each."""
    joined = df.join(sequences, df[ident] == sequences.accession, "left").drop("accession")
    pos = T.lenient_int(F.col(position))
    found = F.when(pos >= 1, F.nullif(F.substring("sequence", pos, F.lit(1)), F.lit("")))
    return joined.withColumn("found_residue", found).withColumn("reasons", reasons(F.col(residue), F.col(position), F.col(ident), F.col("sequence")))


def route(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their reasons joined by `;`)."""
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0).withColumn("reasons", F.array_join("reasons", ";"))


def reason_counts(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def funnel(df: DataFrame, stages: Mapping[str, Column], distinct: Mapping[str, Column]) -> DataFrame:
    """One row: rows in, rows that pass each stage after those before it, and distinct counts of keys among the last ones."""
    ok: Column = F.lit(True)
    out = [F.count(F.lit(1)).alias("rows_in")]
    for name, cond in stages.items():
        ok = ok & F.coalesce(cond, F.lit(False))
        out.append(F.count_if(ok).alias(name))
    out += [F.count_distinct(F.when(ok, c)).alias(name) for name, c in distinct.items()]
    return df.agg(*out)


def class_guard(df: DataFrame, split: str, part: str, label: str, least_test: int = 25) -> DataFrame:
    """Rows of splits whose test part is large enough and whose train and test parts hold both classes."""
    good = (
        df.groupBy(split)
        .agg(
            F.count_if(F.col(part) == "test").alias("t"),
            F.count_distinct(F.when(F.col(part) == "test", F.col(label))).alias("ct"),
            F.count_distinct(F.when(F.col(part) == "train", F.col(label))).alias("cr"),
        )
        .where((F.col("t") >= least_test) & (F.col("ct") > 1) & (F.col("cr") > 1))
    )
    return df.join(good.select(split), split, "left_semi")


def strict_lookup(df: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Inner join that raises, with the count, if any row has no match."""
    lost = df.join(dim.select(on), on, "left_anti").count()
    if lost:
        raise ValueError(f"{lost} rows have no match on {on}")
    return df.join(dim, on)


def contract_violations(df: DataFrame, ident: str, required: Sequence[str], allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """(id, column, violation): nulls in required columns and values outside the allowed ones."""
    require_columns(df, [*required, *allowed])
    cases = [F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("column"), F.lit("missing").alias("violation"))) for c in required]
    cases += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*v), F.struct(F.lit(c).alias("column"), F.lit("not allowed").alias("violation"))) for c, v in allowed.items()]
    return df.select(F.col(ident).alias("id"), F.explode(F.array_compact(F.array(*cases))).alias("v")).select("id", "v.column", "v.violation")


def evidence_tier(direct: Column, replicated: Column, overlap: Column) -> Column:
    """tier1 direct and replicated, tier2 direct, tier3 otherwise; rows that overlap the benchmark are excluded."""
    return F.when(overlap, "excluded").when(direct & replicated, "tier1").when(direct, "tier2").otherwise("tier3")


def conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys that carry more than one label, with their labels and row counts."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("__k"), F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels")).where("__k > 1").drop("__k")


def collapse(df: DataFrame, key: str, label: str, publication: str) -> DataFrame:
    """(key, label, publication, n, excluded): rows alike in all three are one; keys that carry several labels are excluded.

    Excluded rows stay in the result, so that they can be reported.
    """
    one = df.groupBy(key, label, publication).agg(F.count(F.lit(1)).alias("n"))
    clash = conflicts(df, key, label).select(key, F.lit(True).alias("excluded"))
    return one.join(clash, key, "left").fillna(False, ["excluded"])


def route_ambiguous(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, ambiguous): rows without a reason as they are, and of the others the reason and the whole row as JSON."""
    rows = df.withColumn("__why", reason)
    return rows.where("__why is null").drop("__why"), rows.where("__why is not null").select(F.col("__why").alias("reason"), F.to_json(F.struct(*df.columns)).alias("original"))


def stable_ids(df: DataFrame, keys: Sequence[str], out: str = "row_id", prefix: str = "event_", width: int = 5) -> DataFrame:
    """df with an id by place in the order of the keys, from 0, zero-padded."""
    at = F.col("__at").cast("string")
    return numbered(df, keys, "__at").select(*df.columns, F.concat(F.lit(prefix), F.lpad(at, F.greatest(F.lit(width), F.length(at)), F.lit("0"))).alias(out))


def keyword_rows(df: DataFrame, columns: Sequence[str], words: str, order: Sequence[Column], most: int = 80, least: int = 10, fallback: int = 60) -> DataFrame:
    """The first `most` rows in the order of those with one of the words (a pattern, in any case) in a column; where fewer than `least` rows have one, the
    first `fallback` of all rows.  How many have one is counted in the same job."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).rlike(f"(?i){words}"), F.lit(False))
    rows = df.withColumn("__hit", hit)
    few = rows.agg((F.count_if("__hit") < least).alias("__few"))
    best = rows.where("__hit").orderBy(*order).limit(most).unionByName(rows.orderBy(*order).limit(fallback).withColumn("__hit", F.lit(None).cast("boolean")))
    return best.join(F.broadcast(few)).where(F.col("__few") == F.col("__hit").isNull()).drop("__hit", "__few")  # one row
