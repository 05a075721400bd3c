"""Column functions for cleaning, classifying and keying evidence rows.  Column in, Column out; no Python runs per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cells that mean "missing", compared case-insensitively.
MISSING = ("", "-", "na", "n/a", "none", "null")


def clean_text(c: Column) -> Column:
    """Trimmed text; missing markers become null."""
    x = F.trim(c)
    return F.when(~F.lower(x).isin(*MISSING), x)


def first_of_many(c: Column, strip_suffix: bool = False) -> Column:
    """The first value of a cell that lists several, split at `;`, `,` or white space; optionally without its `-n` suffix."""
    x = clean_text(F.split(F.trim(c), r"[;,\s]+")[0])
    return F.substring_index(x, "-", 1) if strip_suffix else x


def canonical(c: Column, names: Mapping[str, str], keep_unknown: bool = True) -> Column:
    """Case-insensitive mapping to canonical names; unknown values pass through or become null."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in (kv[0].lower(), kv[1])])
    found = F.element_at(table, F.lower(F.trim(c)))
    return F.coalesce(found, c) if keep_unknown else found


def lenient_int(c: Column) -> Column:
    """The integer that the text spells, else null."""
    return F.trim(c.cast("string")).try_cast("int")


def tokens(c: Column) -> Column:
    """Values of a multi-valued cell: split at `;`, `,`, `|` or the word "and", trimmed, upper-cased, missing ones dropped."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"(?i)[;,|]|\band\b"), lambda x: F.upper(F.trim(x)))
    return F.filter(parts, lambda x: ~x.isin("", "NA", "NAN", "NONE", "NULL"))


def pair_key(a: Column, b: Column) -> Column:
    """The same key for both orders of a pair of strings."""
    a, b = a.cast("string"), b.cast("string")
    return F.concat_ws("||", F.least(a, b), F.greatest(a, b))


def joined_key(*parts: Column) -> Column:
    return F.concat_ws("||", *[p.cast("string") for p in parts])


def first_match(c: Column, rules: Sequence[tuple[str, str]], other: str = "other") -> Column:
    """The name of the first (regular expression, name) that the lower-cased text matches; order matters."""
    x = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(other)
    for pattern, name in reversed(rules):
        out = F.when(x.rlike(pattern), name).otherwise(out)
    return out


def year_of(c: Column) -> Column:
    """The first 19xx or 20xx in the text, else null."""
    return F.nullif(F.regexp_extract(c, r"(19|20)\d{2}", 0), F.lit("")).cast("int")


def slashed_date(c: Column) -> Column:
    """yyyy/mm/dd at the start of the text, as yyyy-mm-dd."""
    return F.when(c.rlike(r"^\d{4}/\d{2}/\d{2}"), F.regexp_replace(F.substring(c, 1, 10), "/", "-"))


def as_bool(c: Column) -> Column:
    return F.lower(F.trim(c)) == "true"


def basename(c: Column) -> Column:
    """The last part of a path with either kind of slash."""
    return F.element_at(F.split(c, r"[\\/]"), -1)


def positive_label(c: Column) -> Column:
    """True, false or null for texts that spell a binary label."""
    x = F.lower(F.trim(c.cast("string")))
    return F.when(x.isin("1", "true", "yes", "positive", "pos", "enhance", "induce"), True).when(x.isin("0", "false", "no", "negative", "neg", "inhibit"), False)


def split_name(c: Column) -> Column:
    """Synonyms of partition names to train, valid or test; others become null."""
    x = F.lower(F.trim(c))
    return F.when(x.isin("train", "training", "tr"), "train").when(x.isin("valid", "validation", "val", "dev"), "valid").when(x.isin("test", "testing", "holdout", "te"), "test")


def hash_int(*parts: Column) -> Column:
    """A non-negative 32-bit number from md5 of the parts, the same in every engine: all randomness here comes from it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def signed_effect(ratio: Column, bound: Column, free: Column, mutant: Column) -> Column:
    """struct(effect, why) from a log2 ratio of unmodified over modified and three significance flags, by six ordered rules.

    A ratio of -1 or less speaks for the modified form (enhance), one of 1 or more for the unmodified form (inhibit); a flag
    of the same side makes it the stronger reason.  Without a clear ratio flags alone may decide; else effect is null.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    low, high = yes(ratio <= -1), yes(ratio >= 1)
    rules = [
        (low & yes(bound), "enhance", "ratio and modified flag"),
        (high & yes(free), "inhibit", "ratio and unmodified flag"),
        (low, "enhance", "ratio alone"),
        (high, "inhibit", "ratio alone"),
        (yes(bound) & ~yes(free) & ~yes(mutant), "enhance", "modified flag alone"),
        (yes(free) & ~yes(bound), "inhibit", "unmodified flag alone"),
    ]
    out = F.struct(F.lit(None).cast("string").alias("effect"), F.lit("ambiguous").alias("why"))
    for cond, effect, why in reversed(rules):
        out = F.when(cond, F.struct(F.lit(effect).alias("effect"), F.lit(why).alias("why"))).otherwise(out)
    return out


def split_from_path(path: Column) -> Column:
    """The partition that a file's name tells of: the first of its words that is a synonym of train, valid or test; else null."""
    words = F.split(F.lower(F.regexp_replace(basename(path), r"\.[^.]*$", "")), "[^a-z]+")
    return F.get(F.filter(F.transform(words, split_name), lambda x: x.isNotNull()), F.lit(0))


#: Names that a split column may have, in order of precedence.
SPLIT_COLUMNS = ("split", "set", "subset", "partition", "fold")


def find_split_column(df: DataFrame) -> str | None:
    """The first column, by its name in any case and without `_`, `-` and blanks, that is named like a split and has a value that names a part.

    All candidates are looked at in one pass; one row comes back.
    """
    plain = lambda c: c.lower().replace("_", "").replace("-", "").replace(" ", "")
    found = [c for name in SPLIT_COLUMNS for c in df.columns if plain(c) == name]
    if not found:
        return None
    known = df.agg(*[F.bool_or(split_name(F.col(f"`{c}`").cast("string")).isNotNull()).alias(str(k)) for k, c in enumerate(found)]).first()
    return next((c for k, c in enumerate(found) if known[str(k)]), None)


def placeholder(sequence: Column, accession: Column, site: Column | None = None) -> Column:
    """The sequence, or ID:accession[:site] where it is missing or empty."""
    parts = [F.lit("ID"), accession.cast("string"), *([site.cast("string")] if site is not None else [])]
    return F.coalesce(F.nullif(sequence, F.lit("")), F.concat_ws(":", *parts))


def pair_entities(a: Column, b: Column) -> Column:
    """An array with the key of both ends, trimmed, in upper case and in either order; empty where both are blank."""
    x, y = (F.upper(F.trim(F.coalesce(c.cast("string"), F.lit("")))) for c in (a, b))
    return F.when((x == "") & (y == ""), F.array().cast("array<string>")).otherwise(F.array(pair_key(x, y)))


def site_entities(site: Column, owner: Column | None = None) -> Column:
    """owner:site for each value of a multi-valued owner and site; the sites alone where there is no owner; empty without a site."""
    sites = tokens(site)
    if owner is None:
        return sites
    owners = tokens(owner)
    both = F.flatten(F.transform(owners, lambda o: F.transform(sites, lambda s: F.concat(o, F.lit(":"), s))))
    return F.array_distinct(F.when(F.size(owners) > 0, both).otherwise(sites))


def value_entities(c: Column) -> Column:
    """The distinct values of a multi-valued cell: modified entities or publications."""
    return F.array_distinct(tokens(c))
