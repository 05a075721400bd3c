"""Column functions on sequences (strings over an alphabet), k-mers, windows, crops and contact lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the twenty amino-acid letters.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"


def clean_sequence(c: Column, alphabet: str = ALPHABET) -> Column:
    """Upper-cased, non-letters dropped, letters outside the alphabet as X."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z]", ""), f"[^{alphabet}]", "X")


def window_around(seq: Column, pos: Column, flank: int = 15) -> Column:
    """Up to flank letters on either side of the 1-based position, clipped at the ends; empty where it lies outside."""
    lo = F.greatest(F.lit(1), pos - flank)
    hi = F.least(F.length(seq), pos + flank)
    return F.when((pos >= 1) & (pos <= F.length(seq)), F.substring(seq, lo, hi - lo + 1)).otherwise("")


def crop_around(seq: Column, pos: Column, most: int) -> Column:
    """struct(crop, start, at): at most `most` letters around the 1-based position; start and at count from 0."""
    n = F.length(seq)
    start = F.greatest(F.lit(0), F.least(pos - 1 - most // 2, n - most))
    return F.struct(F.substring(seq, start + 1, F.lit(most)).alias("crop"), start.alias("start"), (pos - 1 - start).alias("at"))


def crop_around_median(seq: Column, places: Column, most: int) -> Column:
    """struct(crop, start) around the upper median of the distinct 1-based places, or around the middle where there are none."""
    s = F.array_sort(F.array_distinct(places))
    centre = F.when(F.size(s) > 0, F.get(s, F.floor(F.size(s) / 2).cast("int"))).otherwise(F.floor(F.length(seq) / 2).cast("int") + 1)
    start = F.greatest(F.lit(0), F.least(centre - 1 - most // 2, F.length(seq) - most))
    return F.struct(F.substring(seq, start + 1, F.lit(most)).alias("crop"), start.alias("start"))


def head_and_tail(seq: Column, most: int) -> Column:
    head = most // 2
    return F.when(F.length(seq) <= most, seq).otherwise(F.concat(F.substring(seq, 1, head), F.right(seq, F.lit(most - head))))


def kmer_list(seq: Column, k: int) -> Column:
    """All k-mers in order; none where the sequence is shorter.  A look-ahead walks the sequence once."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def kmers(seq: Column, k: int) -> Column:
    return F.array_distinct(kmer_list(seq, k))


def hash32(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def sketch(seq: Column, k: int = 3, n: int = 64) -> Column:
    """The n smallest hashes of the distinct k-mers, ascending."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(kmers(seq, k), hash32))), 1, n)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def letter_share(seq: Column, letters: str) -> Column:
    """The share of letters of a group; 0 for the empty sequence."""
    return F.when(F.length(seq) > 0, F.regexp_count(seq, F.lit(f"[{letters}]")) / F.length(seq)).otherwise(0.0)


def local_key(window: Column, motif: Column) -> Column:
    """motif|first 8 hex digits of md5 of the sorted distinct 2-mers."""
    return F.concat(motif, F.lit("|"), F.substring(F.md5(F.array_join(F.array_sort(kmers(window, 2)), "")), 1, 8))


def contact_site(c: Column) -> Column:
    """struct(chain, residue, site) of `chain:RES123...`; null where it doesn't fit."""
    pattern = r"^([A-Za-z0-9_]+):([A-Z]{3})(-?\d+)"
    part = lambda i: F.regexp_extract(c, pattern, i)
    return F.when(c.rlike(pattern), F.struct(part(1).alias("chain"), part(2).alias("residue"), part(3).cast("int").alias("site")))


def parse_pairs(c: Column) -> Column:
    """`i:j;i:j` to an array of struct(i, j); malformed pairs are skipped."""
    good = F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: x.rlike(r"^\d+:\d+$"))
    return F.transform(good, lambda x: F.struct(F.split(x, ":")[0].cast("int").alias("i"), F.split(x, ":")[1].cast("int").alias("j")))


def remap_pairs(pairs: Column, i0: Column, j0: Column, ni: Column, nj: Column) -> Column:
    """Pairs shifted into crops that start at i0 and j0 and have ni and nj letters; those outside are dropped, repeats once."""
    moved = F.transform(pairs, lambda p: F.struct((p.i - i0).alias("i"), (p.j - j0).alias("j")))
    return F.array_distinct(F.filter(moved, lambda p: (p.i >= 0) & (p.i < ni) & (p.j >= 0) & (p.j < nj)))


def format_pairs(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p.i.cast("string"), F.lit(":"), p.j.cast("string"))), ";")
