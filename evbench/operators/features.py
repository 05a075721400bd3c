"""Feature assembly from tables and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import crop_around, crop_around_median, format_pairs, hash32, kmer_list, remap_pairs
from ..functions.text import pair_key


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n / (classes * rows of the class)."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total, classes = per.agg(F.sum("n"), F.count(F.lit(1))).first()  # two numbers
    return per.withColumn("weight", F.lit(total) / (F.col("n") * classes))


def hashed_kmer_counts(df: DataFrame, ident: str, seq: Column, k: int, dims: int, salt: str) -> DataFrame:
    """(id, bucket, value): signed hashed k-mer counts divided by their Euclidean norm; buckets of value 0 are left out."""
    mers = df.select(F.col(ident).alias("id"), F.explode(kmer_list(seq, k)).alias("m")).groupBy("id", "m").agg(F.count(F.lit(1)).alias("n"))
    digest = F.md5(F.concat(F.lit(salt), F.col("m")))
    sign = 1 - 2 * (F.conv(F.substring(digest, 9, 2), 16, 10).cast("long") % 2)
    v = mers.select("id", (hash32(F.concat(F.lit(salt), F.col("m"))) % dims).alias("bucket"), (sign * F.col("n")).alias("v")).groupBy("id", "bucket").agg(F.sum("v").alias("v")).where("v <> 0")
    norm = v.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return v.join(norm, "id").select("id", "bucket", (F.col("v") / F.col("norm")).alias("value"))


def pair_vector(a: Column, b: Column) -> Column:
    """Both vectors, their absolute difference and their product, end to end."""
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))


def mean_pool(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(key, n, pooled): the element-wise mean of the vectors of a group, as `size` running means side by side."""
    mean = [F.avg(F.get(F.col(vector), F.lit(i)).cast("double")) for i in range(size)]
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array(*mean).alias("pooled"))


def mechanism_columns(df: DataFrame, defaults: dict[str, str], lengths: Sequence[str]) -> DataFrame:
    """Categories with a default for unknown ones, and log1p lengths of strings."""
    out = df
    for c, d in defaults.items():
        out = out.withColumn(c, F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(d)))
    for c in lengths:
        out = out.withColumn(f"log_{c}", F.log1p(F.coalesce(F.length(c), F.lit(0)).cast("double")))
    return out


def mechanism_frame(df: DataFrame, kind: str, residue: str, organism: str, site: str, own: str, partner: str, window: str, own_id: str, partner_id: str) -> DataFrame:
    """df with the thirteen columns that describe a modification site without looking at its effect.

    own, partner and window are sequences, null or empty where unknown; site counts from 1 and may be text.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("double")
    ident = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    place = F.col(site).try_cast("double")
    known = F.coalesce(place, F.lit(0.0))
    return df.withColumns(
        {
            "ptm": text(kind),
            "residue": F.upper(text(residue)),
            "organism": text(organism),
            "site": F.coalesce(place, F.lit(-1.0)),
            "site_log1p": F.log1p(F.greatest(known, F.lit(0.0))),
            "mod_length_log1p": F.log1p(size(own)),
            "partner_length_log1p": F.log1p(size(partner)),
            "window_length": size(window),
            "site_fraction": F.when(size(own) > 0, known / size(own)).otherwise(0.0),
            "same_entity": ident(own_id) == ident(partner_id),
            "has_mod_sequence": size(own) > 0,
            "has_partner_sequence": size(partner) > 0,
            "has_window": size(window) > 0,
        }
    )


def prefer_own(df: DataFrame, store: DataFrame, on: str, own: str, other: str) -> DataFrame:
    """df with `sequence`: the row's own where it has one, else the store's, else the empty string."""
    return df.join(store.select(on, F.col(other).alias("__other")), on, "left").withColumn("sequence", F.coalesce(F.nullif(F.col(own), F.lit("")), F.col("__other"), F.lit(""))).drop("__other")


def model_inputs(rows: DataFrame, most: int) -> DataFrame:
    """(id, crop_a, start_a, at_a, crop_b, start_b, contacts, key): what a pair model reads.

    rows: (id, a, b, seq_a, pos, seq_b, pairs), pairs of places from 0.  The modified sequence is cropped around its site, the
    partner around its median contact, and contacts are moved into the crops.
    """
    places = F.transform("pairs", lambda p: p.j + 1)
    j = rows.select("*", crop_around(F.col("seq_a"), F.col("pos"), most).alias("x"), crop_around_median(F.col("seq_b"), places, most).alias("y"))
    moved = remap_pairs(F.col("pairs"), F.col("x.start"), F.col("y.start"), F.length("x.crop"), F.length("y.crop"))
    return j.select("id", F.col("x.crop").alias("crop_a"), F.col("x.start").alias("start_a"), F.col("x.at").alias("at_a"), F.col("y.crop").alias("crop_b"), F.col("y.start").alias("start_b"), format_pairs(moved).alias("contacts"), pair_key(F.col("a"), F.col("b")).alias("key"))


def broken_inputs(manifest: DataFrame, sequence: str, ids: str, least: int = 0, most: int = 19) -> DataFrame:
    """Rows of a strict manifest whose id list isn't as long as the sequence or holds an id out of range; it must be empty."""
    bad = F.exists(ids, lambda i: i.isNull() | (i < least) | (i > most))
    return manifest.where(F.col(ids).isNull() | (F.size(ids) != F.length(sequence)) | bad)


def event_contact_signatures(mapping: DataFrame, contacts: DataFrame) -> DataFrame:
    """(event_id, complex_id, modified_chain, signature_tokens, signature_size, mapped_contact_count) of each mapping of an event to a chain.

    mapping: event_id, complex_id, modified_chain, modified, partner, partner_chains (comma-separated; blank: any), position, residue, distance.
    contacts: complex_id, chain_a, entity_a, site_a, chain_b, entity_b, site_b, contact_type; a contact counts from either end, once.
    Its tokens are the sites of both ends, the distance of its own site from the event's with its type, and the residue with its type.  Without
    a contact the token is that of the nearest interface site, where its distance is known, else there is none.
    """
    end = lambda x, y: F.struct(F.col(f"chain_{x}").alias("chain"), F.col(f"entity_{x}").alias("own"), F.col(f"site_{x}").alias("at"), F.col(f"chain_{y}").alias("other_chain"), F.col(f"entity_{y}").alias("other"), F.col(f"site_{y}").alias("other_at"))
    symmetric = (F.col("chain_a") == F.col("chain_b")) & (F.col("entity_a") == F.col("entity_b"))
    ends = contacts.select(F.col("complex_id").alias("__complex"), "contact_type", F.explode(F.when(symmetric, F.array(end("a", "b"))).otherwise(F.array(end("a", "b"), end("b", "a")))).alias("e")).select("__complex", "contact_type", "e.*")
    chains = F.filter(F.transform(F.split(F.coalesce("partner_chains", F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")
    rows = mapping.withColumn("__chains", chains)
    keys = ["event_id", "complex_id", "modified_chain", "modified", "partner", "position", "residue", "distance", "__chains"]
    same = [F.col("complex_id") == F.col("__complex"), F.col("modified_chain") == F.col("chain"), F.col("modified") == F.col("own"), F.col("partner") == F.col("other")]
    j = rows.join(ends, [*same, (F.size("__chains") == 0) | F.array_contains("__chains", F.col("other_chain"))], "left")
    away = F.col("at") - F.col("position")
    tokens = F.array(
        F.concat_ws(":", F.lit("M"), "modified", "at"), F.concat_ws(":", F.lit("P"), "partner", "other_at"),
        F.concat(F.lit("REL:"), F.when(away >= 0, "+").otherwise(""), away.cast("string"), F.lit(":"), "contact_type"), F.concat_ws(":", F.lit("AA"), "residue", "contact_type"),
    )
    g = j.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("chain").isNotNull(), tokens)))).alias("t"), F.count("chain").alias("mapped_contact_count"))
    near = F.when(F.col("distance").isNotNull(), F.array(F.concat_ws(":", F.lit("IFACE_NEAR"), "modified", F.col("distance").cast("int")))).otherwise(F.array().cast("array<string>"))
    t = F.when(F.size("t") > 0, F.col("t")).otherwise(near)
    return g.select("event_id", "complex_id", "modified_chain", F.array_join(F.array_sort(t), "|").alias("signature_tokens"), F.size(t).cast("long").alias("signature_size"), "mapped_contact_count")
