"""Rule classifiers and constant features of a modification site."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical and chemical values of modifications (mass, charge, hydrogen bonds, hydrophobicity, volume, reversibility).
CHEMISTRY = {
    "Phos": (79.966, -2.0, 2.0, -1.0, 1.25, 1.0),
    "Ac": (42.011, -1.0, -0.5, 0.35, 0.65, 1.0),
    "Me": (14.016, 0.0, -0.2, 0.45, 0.35, 1.0),
    "Ub": (8564.0, 0.0, 3.0, -0.2, 8.0, 1.0),
    "Sumo": (11000.0, 0.0, 3.0, -0.2, 8.5, 1.0),
    "Glyco": (203.0, 0.0, 4.0, -1.0, 2.0, 1.0),
}

# Patterns of assay descriptions and their families, in order of precedence.
ASSAYS = (
    (r"co-?ip|immunoprecip", "co_ip"),
    (r"pull.?down|pulldown|affinity chromatography|tap", "pull_down"),
    (r"spr|surface plasmon|bli|biolayer|itc|calorimetry|mst|thermophoresis|fluorescence polarization|anisotropy|nmr", "biophysical"),
    (r"two.hybrid|2-hybrid|y2h", "two_hybrid"),
    (r"mass spectrometry|lc-ms|ms/ms|proteomic|sds-page", "proteomics"),
    (r"microarray|array|chip", "array"),
    (r"structure|crystal|cryo|pdb|x-ray|docking|molecular dynamics", "structure_or_simulation"),
    (r"colocal|microscop|immunofluorescence|confocal", "localization"),
    (r"western|blot|overlay", "blot_overlay"),
)


def _around(window: Column, centre: Column | None) -> tuple[Column, Column, Column]:
    """(five letters before the centre, the one after it, six after it).  centre counts from 0; by default the window's middle."""
    w = F.upper(window)
    c = F.floor(F.length(w) / 2).cast("int") if centre is None else centre
    lo = F.greatest(c - 5, F.lit(0))
    return F.substring(w, lo + 1, c - lo), F.substring(w, c + 2, F.lit(1)), F.substring(w, c + 2, F.lit(6))


def motif_family(kind: Column, residue: Column, window: Column, gene: Column, partner: Column, centre: Column | None = None) -> Column:
    """The reader family that a site's context suggests.  In clipped windows pass the true centre, as the middle is off."""
    before, nxt, after = _around(window, centre)
    reader = F.upper(F.coalesce(partner, F.lit(""))).startswith("YWHA") | F.upper(F.coalesce(gene, F.lit(""))).startswith("YWHA")
    phos = (
        F.when(reader, "reader_14_3_3_edge")
        .when(residue == "Y", "phosphotyrosine_reader_candidate")
        .when(nxt == "P", "proline_directed_pin1_ww_candidate")
        .when(before.rlike("R.{1,3}$"), "basophilic_phosphosite_candidate")
        .when(before.rlike("[DE].{0,3}$") | after.rlike("^[DE]"), "acidic_phosphosite_candidate")
        .otherwise("other_phosphosite")
    )
    return (
        F.when(kind == "Phos", phos)
        .when((kind == "Ac") & (residue == "K"), "acetyl_lysine_reader_candidate")
        .when((kind == "Me") & residue.isin("K", "R"), "methyl_reader_candidate")
        .when(kind.isin("Ub", "Sumo") & (residue == "K"), "ubiquitin_like_lysine")
        .when(kind == "Glyco", "glycosylation_site")
        .otherwise("other_ptm")
    )


def kinase_proxy(kind: Column, residue: Column, window: Column, centre: Column | None = None) -> Column:
    """The kinase class that a phosphosite's context suggests; other modifications are named by their kind."""
    before, nxt, _ = _around(window, centre)
    return (
        F.when(kind != "Phos", F.concat(F.lit("non_phos_"), kind))
        .when(residue == "Y", "tyrosine_kinase_proxy")
        .when(nxt == "P", "proline_directed_kinase_proxy")
        .when(before.rlike("[RK].{0,3}$"), "basophilic_kinase_proxy")
        .when(before.rlike("[DE].{0,4}$"), "acidophilic_kinase_proxy")
        .otherwise("other_ser_thr_kinase_proxy")
    )


def chemistry(kind: Column) -> Column:
    """Six values of a modification kind, the mass as log1p; zeros for unknown kinds."""
    out = F.array(*[F.lit(0.0)] * 6)
    for name, (mass, *rest) in CHEMISTRY.items():
        out = F.when(kind == name, F.array(F.log1p(F.abs(F.lit(mass))), *map(F.lit, rest))).otherwise(out)
    return out


def parse_variant(c: Column, residues: dict[str, str]) -> Column:
    """struct(gene, wild, pos, variant) of `GENE_Thr3093Ile`, residues as letters; null where it doesn't fit."""
    pattern = r"^(.+)_([A-Z][a-z]{2})(\d+)([A-Z][a-z]{2})$"
    part = lambda i: F.regexp_extract(c, pattern, i)
    names = F.create_map(*[F.lit(x) for kv in residues.items() for x in kv])
    letter = lambda x: F.coalesce(F.element_at(names, F.upper(x)), x)
    return F.when(c.rlike(pattern), F.struct(part(1).alias("gene"), letter(part(2)).alias("wild"), part(3).cast("int").alias("pos"), letter(part(4)).alias("variant")))


def position_share(pos: Column, length: Column) -> Column:
    return F.when(length > 0, pos / length).otherwise(0.0)


def contacts_at(pairs: Column, site: Column) -> Column:
    """struct(total, at_site) of an array of struct(i, j) contacts."""
    return F.struct(F.size(pairs).alias("total"), F.size(F.filter(pairs, lambda p: p.i == site)).alias("at_site"))


def presence(a: Column, b: Column, sequence_a: Column, sequence_b: Column) -> Column:
    """struct(self_interaction, has_a, has_b): whether both ends are one, and whether each has a sequence."""
    has = lambda s: F.length(F.coalesce(s, F.lit(""))) > 0
    return F.struct(F.coalesce(a == b, F.lit(False)).alias("self_interaction"), has(sequence_a).alias("has_a"), has(sequence_b).alias("has_b"))
