"""Sparse feature packs: blocks of (slot, value) entries, stacked by offsets into vectors, without a dense array for any row.

A block's entries are an ascending array of struct(i, v) without zeros.  Blocks of an entity's sequence are made once for each distinct
sequence and joined to the rows that have it; blocks of a site are Column expressions on the row.  A pack is a list of (block,
first slots that it takes); the offsets follow from the blocks' sizes, which the manifest lists.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.sequences import kmer_list, letter_share
from ..functions.site import CHEMISTRY
from .durable import stored_path

LETTERS = "ACDEFGHIKLMNPQRSTVWY"

# Letter groups of the descriptors, in their order; the first generation adds cysteine.
DESCRIPTORS = ("AILMFWVY", "DEKRH", "DE", "KRH", "STNQCY", "PG", "FWY")

ENTRIES = "array<struct<i:int,v:double>>"


class Block(NamedTuple):
    """A block of a row: its entries and its number of slots; a block of few slots also as single (slot, value), 0 where it has none."""

    entries: Column
    size: int
    terms: tuple[tuple[Column, Column], ...] = ()


class Part(NamedTuple):
    """What a pack takes of a block: all of it, or its first slots."""

    block: str
    first: int | None = None


def known_letters(seq: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(seq, F.lit(""))), f"[^{LETTERS}]", "")


def dense(values: Sequence[Column]) -> Block:
    """The entries of a few values in order; nulls are zeros."""
    terms = tuple((F.lit(k), F.coalesce(v.cast("double"), F.lit(0.0))) for k, v in enumerate(values))
    both = F.array(*[F.struct(i.alias("i"), v.alias("v")) for i, v in terms])
    return Block(F.filter(both, lambda x: x["v"] != 0), len(values), terms)


def composition(seq: Column) -> Block:
    return _composition(known_letters(seq))


def _composition(known: Column) -> Block:
    return dense([letter_share(known, x) for x in LETTERS])


def descriptors(seq: Column, groups: Sequence[str] = DESCRIPTORS) -> Block:
    """log1p of the length and the share of each letter group."""
    return _descriptors(known_letters(seq), groups)


def _descriptors(known: Column, groups: Sequence[str]) -> Block:
    return dense([F.log1p(F.length(known).cast("double")), *[letter_share(known, g) for g in groups]])


def kind_chemistry(kind: Column) -> Block:
    """The entries of each listed kind are one constant."""
    entries = F.array().cast(ENTRIES)
    for name, (mass, *rest) in CHEMISTRY.items():
        values = (math.log1p(abs(mass)), *rest)
        entries = F.when(kind == name, F.array(*[F.struct(F.lit(k).alias("i"), F.lit(float(v)).alias("v")) for k, v in enumerate(values) if v])).otherwise(entries)
    return Block(entries, 6)


def one_hot(columns: Sequence[tuple[Column, Sequence[str]]]) -> Block:
    """One slot for each category of each column, in order; null counts as `missing`, and what isn't listed has no slot."""
    made, terms, offset = [], [], 0
    for c, categories in columns:
        at = F.array_position(F.array(*map(F.lit, categories)), F.coalesce(c.cast("string"), F.lit("missing"))).cast("int")
        made.append(F.when(at > 0, F.array(F.struct((at + (offset - 1)).alias("i"), F.lit(1.0).alias("v")))).otherwise(F.array().cast(ENTRIES)))
        terms.append((at + (offset - 1), F.when(at > 0, 1.0).otherwise(0.0)))
        offset += len(categories)
    return Block(F.concat(*made), offset, tuple(terms))


def categories(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """The sorted categories of each column, null as `missing`: a list in the program, for columns of few values."""
    sets = df.agg(*[F.array_sort(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit("missing")))).alias(c) for c in columns]).first()
    return {c: list(sets[c]) for c in columns}


def _let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body of c, which is evaluated once however often the body takes it, lambdas included."""
    return F.get(F.transform(F.array(c), body), 0)


def hashed_entries(seq: Column, k: int, dims: int, salt: str) -> Column:
    """The entries of signed hashed k-mer counts, of Euclidean norm 1, within the row: no k-mer leaves it."""
    return _hashed_entries(known_letters(seq), k, dims, salt)


def _hashed_entries(known: Column, k: int, dims: int, salt: str) -> Column:
    digests = F.transform(kmer_list(known, k), lambda m: F.md5(F.concat(F.lit(salt), m)))
    number = lambda d, at, n: F.conv(F.substring(d, at, n), 16, 10).cast("long")
    hashed = F.transform(digests, lambda d: F.struct((number(d, 1, 8) % dims).cast("int").alias("i"), (number(d, 9, 2) % 2).alias("odd")))
    slots = lambda of, odd: F.transform(F.filter(of, lambda x: x["odd"] == odd), lambda x: x["i"])
    found = lambda of, i: F.size(of) - F.size(F.array_remove(of, i))
    both = _let(hashed, lambda of: F.struct(slots(of, 0).alias("up"), slots(of, 1).alias("down")))
    signed = lambda of, i: F.struct(i.alias("i"), (found(of["up"], i) - found(of["down"], i)).cast("double").alias("v"))
    counts = _let(both, lambda of: F.transform(F.array_sort(F.array_union(of["up"], of["down"])), lambda i: signed(of, i)))
    normed = lambda of, norm: F.transform(of, lambda x: F.struct(x["i"].alias("i"), (x["v"] / norm).alias("v")))
    norm = lambda of: F.sqrt(F.aggregate(of, F.lit(0.0), lambda a, x: a + x["v"] * x["v"]))
    return _let(F.filter(counts, lambda x: x["v"] != 0), lambda of: _let(norm(of), lambda n: normed(of, n)))


def hashed_kmers(df: DataFrame, key: str, seq: Column, k: int, dims: int, salt: str) -> DataFrame:
    """(key, entries) of signed hashed k-mer counts, of Euclidean norm 1, for each distinct key."""
    return df.select(F.col(key).alias("key"), known_letters(seq).alias("s")).distinct().select("key", hashed_entries(F.col("s"), k, dims, salt).alias("entries"))


def first_slots(entries: Column, n: int) -> Column:
    return F.filter(entries, lambda x: x["i"] < n)


def shifted(entries: Column, offset: int) -> Column:
    return F.transform(entries, lambda x: F.struct((x["i"] + offset).cast("int").alias("i"), x["v"].alias("v"))) if offset else entries


def difference(a: Column, b: Column) -> Column:
    """The entries of a minus b."""
    slots = lambda e: F.transform(e, lambda x: x["i"])
    of = lambda m, i: F.coalesce(F.element_at(m, i), F.lit(0.0))
    sides = F.struct(a.alias("a"), b.alias("b"), F.map_from_entries(a).alias("x"), F.map_from_entries(b).alias("y"))
    every = lambda e: F.array_sort(F.array_union(slots(e["a"]), slots(e["b"])))
    made = _let(sides, lambda e: F.transform(every(e), lambda i: F.struct(i.alias("i"), (of(e["x"], i) - of(e["y"], i)).alias("v"))))
    return F.filter(made, lambda x: x["v"] != 0)


def stacked(blocks: dict[str, Block], parts: Sequence[Part]) -> Block:
    """A pack: its parts end to end."""
    made, offset = [], 0
    for name, first in parts:
        b = blocks[name]
        made.append(shifted(b.entries if first is None else first_slots(b.entries, first), offset))
        offset += b.size if first is None else min(first, b.size)
    return Block(F.concat(*made), offset)


def manifest(blocks: dict[str, Block], packs: dict[str, Sequence[Part]]) -> list[tuple[str, int, str, int, int]]:
    """(pack, place, block, offset, dims) of every part."""
    out = []
    for pack, parts in packs.items():
        offset = 0
        for k, (name, first) in enumerate(parts):
            dims = blocks[name].size if first is None else min(first, blocks[name].size)
            out.append((pack, k, name, offset, dims))
            offset += dims
    return out


def with_packs(df: DataFrame, blocks: dict[str, Block], packs: dict[str, Sequence[Part]]) -> DataFrame:
    """df with a column of entries for each pack."""
    return df.withColumns({name: stacked(blocks, parts).entries for name, parts in packs.items()})


def vectors(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """df with columns of entries turned into sparse ML vectors.

    A vector is stored as (type, size, indices, values), so that such structs, written as Parquet, are read back as vectors: no row passes
    through Python.
    """
    spark = df.sparkSession
    raw = lambda c, n: F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(n).alias("size"), F.transform(c, lambda x: x["i"]).alias("indices"), F.transform(c, lambda x: x["v"]).alias("values"))
    made = df.withColumns({c: raw(c, n) for c, n in sizes.items()})
    path = stored_path(spark, "vectors")
    made.write.parquet(path)
    return spark.read.schema(StructType([StructField(f.name, VectorUDT() if f.name in sizes else f.dataType) for f in made.schema.fields])).parquet(path)


# ------------------------------------------------------------------------------------- packs of the two generations

#: Pack -> parts; blocks as in event_blocks().
FIRST: dict[str, list[Part]] = {
    "site": [Part("window30"), Part("window_hash128")],
    "modified": [Part("mod29"), Part("mod_hash192")],
    "partner": [Part("partner29"), Part("partner_hash192")],
    "pair": [Part("mod29"), Part("mod_hash192"), Part("partner29"), Part("partner_hash192")],
    "mechanism": [Part("kinds"), Part("flags"), Part("window30")],
}
FIRST["combined"] = [*FIRST["mechanism"], *FIRST["site"], *FIRST["pair"]]

_STATIC = [Part("mod28"), Part("mod_hash128"), Part("partner28"), Part("partner_hash128"), Part("place")]
_WINDOW, _CHANGED = [Part("window28"), Part("window_hash96")], [Part("changed28"), Part("changed_hash96")]
SECOND: dict[str, list[Part]] = {
    "source_assay": [Part("assays")],
    "motif": [Part("motif_kinds"), Part("window28"), Part("window_hash96", 6)],
    "sequence_only": [*_WINDOW, *_STATIC],
    "counterfactual": [*_WINDOW, *_STATIC, *_CHANGED, *_STATIC, Part("chemistry"), Part("chemistry"), Part("place"), Part("state_difference"), Part("state_kinds")],
    "counterfactual_no_chemistry": [*_WINDOW, *_STATIC, *_CHANGED, *_STATIC, Part("plain_kinds")],
    "delta_only": [Part("chemistry"), Part("place"), Part("window28"), Part("window_hash96", 6), Part("two_kinds")],
}
#: One-hot blocks and their columns.
ONE_HOT = {
    "kinds": ("kind", "residue", "organism"), "motif_kinds": ("kind", "residue", "motif", "kinase"), "state_kinds": ("kind", "residue", "motif", "assay"),
    "plain_kinds": ("residue", "motif", "assay"), "two_kinds": ("kind", "residue"), "assays": ("assay", "method"),
}
#: Column, its blocks of letter groups, its blocks of hashed k-mers (k, dims, salt).
SEQUENCES: list[tuple[str, dict[str, Sequence[str]], dict[str, tuple[int, int, str]]]] = [
    ("window", {"window29": (*DESCRIPTORS, "C"), "window28": DESCRIPTORS}, {"window_hash128": (2, 128, "site"), "window_hash96": (2, 96, "site")}),
    ("changed_window", {"changed28": DESCRIPTORS}, {"changed_hash96": (2, 96, "site")}),
    ("modified_sequence", {"mod29": (*DESCRIPTORS, "C"), "mod28": DESCRIPTORS}, {"mod_hash192": (3, 192, "mod"), "mod_hash128": (3, 128, "mod")}),
    ("partner_sequence", {"partner29": (*DESCRIPTORS, "C"), "partner28": DESCRIPTORS}, {"partner_hash192": (3, 192, "partner"), "partner_hash128": (3, 128, "partner")}),
]
#: First slots of the two states that are subtracted; they lie within the windows' blocks.
STATE = 64
_STATES = {part.block for part in (*_WINDOW, *_CHANGED)}


def sequence_table(one: DataFrame, column: str, plain: dict[str, Sequence[str]], hashed: dict[str, tuple[int, int, str]]) -> tuple[DataFrame, dict[str, int]]:
    """(one with the entries of its sequences as __block..., block -> size).

    plain: block -> letter groups, for composition and descriptors; hashed: block -> (k, dims, salt).
    """
    seq = F.col("__known")  # a column of its own, as lambdas make what they take anew
    sizes = {name: 21 + len(groups) for name, groups in plain.items()} | {name: dims for name, (_, dims, _) in hashed.items()}
    made = {f"__{name}": _end_to_end(_composition(seq), _descriptors(seq, groups)).entries for name, groups in plain.items()}
    return one.withColumn("__known", known_letters(F.col(column))).withColumns(made | {f"__{name}": _hashed_entries(seq, *how) for name, how in hashed.items()}).drop("__known"), sizes


def _stored(df: DataFrame) -> DataFrame:
    """df as Parquet below the shared folder, so that Spark knows its size when it is joined."""
    path = stored_path(df.sparkSession, "blocks")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _sequence_tables(df: DataFrame, asked: set[str]) -> tuple[dict[str, DataFrame], dict[str, int], DataFrame | None]:
    """(column -> its stored sequence table, block -> size, the stored distinct pairs of windows if asked for); df is read once."""
    wanted: dict[str, tuple[dict, dict]] = {}
    for column, plain, hashed in SEQUENCES:
        plain, hashed = ({name: how for name, how in x.items() if name in asked} for x in (plain, hashed))
        if plain or hashed:
            wanted[column] = plain, hashed
    if not wanted:
        return {}, {}, None
    named = lambda name, s, t: F.struct(F.lit(name).alias("column"), s.alias("s"), t.alias("t"))
    kinds = [named(c, F.col(c), F.lit(None).cast("string")) for c in wanted]
    if "state_difference" in asked:
        kinds.append(named("both", F.col("window"), F.col("changed_window")))
    keys = _stored(df.select(F.explode(F.array(*kinds)).alias("x")).select("x.*").distinct())
    tables: dict[str, DataFrame] = {}
    sizes: dict[str, int] = {}
    for column, (plain, hashed) in wanted.items():
        table, own = sequence_table(keys.where((F.col("column") == column) & F.col("s").isNotNull()).select(F.col("s").alias(column)), column, plain, hashed)
        tables[column], sizes = _stored(table), sizes | own
    pairs = keys.where("column = 'both'").select(F.col("s").alias("window"), F.col("t").alias("changed_window")) if "state_difference" in asked else None
    return tables, sizes, pairs


def _state_differences(tables: dict[str, DataFrame], sizes: dict[str, int], pairs: DataFrame) -> DataFrame:
    """(window, changed_window, __state_difference) of distinct pairs: it hangs on the two windows alone."""
    state = lambda parts: first_slots(stacked({p.block: Block(F.col(f"__{p.block}"), sizes[p.block]) for p in parts}, parts).entries, STATE)
    x = tables["changed_window"].select("changed_window", state(_CHANGED).alias("x"))
    y = tables["window"].select("window", state(_WINDOW).alias("y"))
    none = F.array().cast(ENTRIES)
    j = pairs.join(x, "changed_window", "left").join(y, "window", "left")
    return j.select("window", "changed_window", difference(F.coalesce("x", none), F.coalesce("y", none)).alias("__state_difference"))


def _end_to_end(*blocks: Block) -> Block:
    return stacked({str(k): b for k, b in enumerate(blocks)}, [Part(str(k)) for k in range(len(blocks))])


def _asked(packs: dict[str, Sequence[Part]]) -> set[str]:
    asked = {part.block for parts in packs.values() for part in parts}
    asked |= {"window29"} if "window30" in asked else set()
    return asked | (_STATES if "state_difference" in asked else set())


def _row_blocks(asked: set[str], levels: dict[str, list[str]]) -> dict[str, Block]:
    """The blocks that a row's own columns give; levels: the categories of each column of the one-hot blocks asked for."""
    c = F.col
    place = c("position").cast("double") / F.nullif(F.length("modified_sequence"), F.lit(0))
    flag = lambda x: F.when(F.length(F.coalesce(x.cast("string"), F.lit(""))) > 0, 1.0).otherwise(0.0)
    blocks = {name: one_hot([(c(x), levels[x]) for x in columns]) for name, columns in ONE_HOT.items() if name in asked}
    blocks["flags"] = dense([place, F.when(c("modified") == c("partner"), 1.0).otherwise(0.0), flag(c("disease")), flag(c("colocalized"))])
    blocks["place"], blocks["chemistry"] = dense([place]), kind_chemistry(c("kind"))
    return blocks


def event_blocks(df: DataFrame, packs: dict[str, Sequence[Part]]) -> tuple[DataFrame, dict[str, Block]]:
    """(df with the blocks of its sequences joined, the blocks that the packs ask for).

    df: modified, partner (entity ids), modified_sequence, partner_sequence, window, changed_window (the window in its other state),
    position, kind, residue, organism, motif, kinase, assay, method, disease, colocalized.  Null sequences have empty blocks.
    """
    asked = _asked(packs)
    listed = {c: None for name in ONE_HOT if name in asked for c in ONE_HOT[name]}
    own = _row_blocks(asked, categories(df, list(listed)) if listed else {})
    tables, sizes, pairs = _sequence_tables(df, asked)
    rows = df
    for column, table in tables.items():
        rows = rows.join(table, column, "left")
    blocks = {name: Block(F.col(f"__{name}"), n) for name, n in sizes.items()}
    if pairs is not None:
        rows = rows.join(_stored(_state_differences(tables, sizes, pairs)), ["window", "changed_window"], "left")
        blocks["state_difference"] = Block(F.col("__state_difference"), STATE)
    rows = rows.withColumns({f"__{name}": F.coalesce(f"__{name}", F.array().cast(ENTRIES)) for name in blocks})
    if "window30" in asked:
        blocks["window30"] = _end_to_end(blocks["window29"], own["place"])
    return rows, blocks | own


def sums(entries: Column) -> Column:
    """struct(n, s, t): how many slots are set, the sum of their values, and that of slot times value."""
    of = lambda n, s, t: F.struct(n.alias("n"), s.alias("s"), t.alias("t"))
    zero = of(F.lit(0).cast("long"), F.lit(0.0), F.lit(0.0))
    return F.aggregate(entries, zero, lambda a, x: of(a["n"] + 1, a["s"] + x["v"], a["t"] + x["i"] * x["v"]))  # one pass, so that Catalyst copies the entries nowhere


#: Columns that a block takes.
_OWN = {"place": ("position", "modified_sequence"), "flags": ("position", "modified_sequence", "modified", "partner", "disease", "colocalized"), "chemistry": ("kind",)} | ONE_HOT
_TAKES = {name: (column,) for column, plain, hashed in SEQUENCES for name in (*plain, *hashed)} | {"state_difference": ("window", "changed_window")} | _OWN


class Side(NamedTuple):
    """What hangs on some of an event's columns.

    keys: those columns; the first one never matches a null.  base: one row for each distinct combination of the sequences, with them; the sums of the parts that hang on
    sequences are made here.  spread: base, without the sequences that nothing else takes, to one row for each value of the keys, with the columns that hang on them as well.
    how: of the join to the events.
    """

    keys: tuple[str, ...]
    base: DataFrame
    spread: Callable[[DataFrame], DataFrame] = lambda base: base
    how: str = "inner"


#: Rows of a base whose sequences a task sums, about.
DEALT = 10_000
#: Rows of a side that are looked up first for the categories that occur.
LOOKED_UP = 20_000


def _matched(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """rows joined to table by the keys, nulls as values but for the first."""
    named = table.withColumnsRenamed({c: f"__key_{c}" for c in keys})
    first, *others = keys
    on = F.col(first) == F.col(f"__key_{first}")
    for c in others:
        on = on & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    return rows.join(named, on, how).drop(*[f"__key_{c}" for c in keys])


def _occurring(rows: DataFrame, side: Side, columns: Sequence[str]) -> dict[str, list[str]]:
    """The sorted categories of the side's columns among the rows, null as `missing`.

    What the side has bounds them.  A bounded part of the side, looked up from all rows, proves most of them; where it leaves one open, the whole side is looked up.
    """
    table = side.spread(side.base).select(*side.keys, *columns)
    every = categories(table, columns)
    part = table.where(F.pmod(F.xxhash64(*side.keys), F.lit(max(1, table.count() // LOOKED_UP))) == 0)
    seen = categories(_matched(rows.select(*side.keys), F.broadcast(part), side.keys, "inner"), columns)
    return seen if seen == every else categories(_matched(rows.select(*side.keys).distinct(), table, side.keys, "inner"), columns)


def _own_sides(df: DataFrame, asked: set[str]) -> list[Side]:
    """Sides of events that have all columns themselves: one for each sequence, one for the pairs of windows, one for the kinds."""
    taken = {_TAKES[name] for name in asked if name not in _OWN or name == "chemistry"}
    return [Side(c, df.select(*c).distinct(), how="left") for c in sorted(taken)]


def pack_sums(df: DataFrame, ident: Sequence[str], packs: dict[str, Sequence[Part]], sides: Sequence[Side] = ()) -> DataFrame:
    """(ident..., a column for each pack: sums() of its entries) of every event.

    A pack's sums are those of its parts at their slots.  So a part is stacked and summed where all columns that it takes first meet: once for each distinct sequence or pair of windows,
    once for each value of a side's keys, or in the event.  An event gets three numbers of each side; neither sequences nor entries move with the events, k-mers don't leave their row.

    df and sides: together the columns of event_blocks().  Without sides the events have all columns, and are stored; sides are joined in their order, and the events are read
    with the columns that neither is in a side nor goes unused.
    """
    flat = {pack: [y for x in parts for y in ([Part("window29"), Part("place")] if x.block == "window30" else [x])] for pack, parts in packs.items()}
    asked = {p.block for parts in flat.values() for p in parts}
    needed = {c for name in asked for c in _TAKES[name]}
    if sides:
        df = df.select(*ident, *sorted(({c for c in needed if c in df.columns} | {c for side in sides for c in side.keys}) - {*ident}))
    else:
        df = _stored(df.select(*ident, *sorted(needed - {*ident})))
        sides = _own_sides(df, asked)
    has = [{*side.spread(side.base).columns} for side in sides]
    listed = {c for name in asked & {*ONE_HOT} for c in ONE_HOT[name]}
    levels = categories(df, sorted(listed & {*df.columns})) if listed & {*df.columns} else {}
    for side, columns in zip(sides, has, strict=True):
        if wanted := sorted((listed & columns) - {*levels}):
            levels |= _occurring(df, side, wanted)
    own = _row_blocks(asked, levels)
    sizes = {name: b.size for name, b in own.items()} | {"state_difference": STATE}
    for _, plain, hashed in SEQUENCES:
        sizes |= {name: 21 + len(groups) for name, groups in plain.items()} | {name: dims for name, (_, dims, _) in hashed.items()}
    placed: dict[str, list[tuple[int, Part]]] = {}
    for pack, parts in flat.items():
        offset, placed[pack] = 0, []
        for p in parts:
            placed[pack].append((offset, p))
            offset += sizes[p.block] if p.first is None else min(p.first, sizes[p.block])

    def summed(table: DataFrame, blocks: dict[str, Block], tag: str) -> tuple[DataFrame, dict[str, Column]]:
        """(table, a column of sums for each pack that takes some of these blocks): of the terms of blocks of few slots, else of the entries, once each."""
        here = {pack: [(offset, p) for offset, p in parts if p.block in blocks] for pack, parts in placed.items()}
        long = {p for parts in here.values() for _, p in parts if not blocks[p.block].terms}
        of = lambda p: f"__{p.block}_{p.first}"
        table = table.withColumns({of(p): sums(blocks[p.block].entries if p.first is None else first_slots(blocks[p.block].entries, p.first)) for p in sorted(long, key=of)})
        made = {}
        for pack, parts in here.items():
            n, s, t = F.lit(0).cast("long"), F.lit(0.0), F.lit(0.0)
            for offset, p in parts:
                if p in long:
                    x = F.col(of(p))
                    n, s, t = n + x["n"], s + x["s"], t + x["t"] + offset * x["s"]
                for i, v in blocks[p.block].terms:
                    v = v if p.first is None else F.when(i < p.first, v).otherwise(0.0)
                    n, s, t = n + F.when(v != 0, 1).otherwise(0), s + v, t + F.when(v != 0, (i + offset) * v).otherwise(0.0)
            if parts:
                made[f"__{pack}:{tag}"] = F.struct(n.alias("n"), s.alias("s"), t.alias("t"))
        return table, made

    rows, left, every = df, set(asked), []
    for k, (side, columns) in enumerate(zip(sides, has, strict=True)):
        base, blocks = side.base, {}
        if any(left & {*plain, *hashed} for column, plain, hashed in SEQUENCES if column in base.columns):
            # few bytes that take long: dealt by their number, which Spark doesn't join again
            base = _stored(base)
            base = base.repartition(max(df.sparkSession.sparkContext.defaultParallelism, base.count() // DEALT))
        for column, plain, hashed in SEQUENCES:
            mine = lambda of: {name: how for name, how in of.items() if column in base.columns and (name in left or "state_difference" in left and {"window", "changed_window"} <= {*base.columns} and name in _STATES)}  # noqa: B023, E731
            if mine(plain) or mine(hashed):
                base, _ = sequence_table(base, column, mine(plain), mine(hashed))
                blocks |= {name: Block(F.col(f"__{name}"), sizes[name]) for name in (*mine(plain), *mine(hashed))}
        if "state_difference" in left and {"window", "changed_window"} <= {*base.columns}:
            state = lambda parts: first_slots(stacked(blocks, parts).entries, STATE)  # noqa: B023, E731
            base = base.withColumn("__state_difference", difference(state(_CHANGED), state(_WINDOW)))
            blocks["state_difference"] = Block(F.col("__state_difference"), STATE)
        base, made = summed(base, {name: b for name, b in blocks.items() if name in left}, f"{k}:sequences")
        every += made
        left -= {*blocks}
        spread = side.spread(_stored(base.select(*side.base.columns, *[c.alias(name) for name, c in made.items()])) if made else side.base)
        here = {name for name in left & {*own} if {*_TAKES[name]} <= columns}
        spread, made = summed(spread, {name: own[name] for name in here}, f"{k}:own")
        left -= here
        carried = {c for name in left & {*own} for c in _TAKES[name]} & columns - {*df.columns}
        of_sequences = [c for c in every if c in spread.columns]
        every += made
        if made or carried or of_sequences:
            rows = _matched(rows, _stored(spread.select(*side.keys, *sorted(carried), *of_sequences, *[c.alias(name) for name, c in made.items()])), side.keys, side.how)
        elif side.how == "inner":
            rows = _matched(rows, spread.select(*side.keys), side.keys, side.how)
    rows, made = summed(rows, {name: own[name] for name in left}, "event")
    rows, every = rows.withColumns(made), [*every, *made]
    add = lambda pack, f, zero: sum((F.coalesce(F.col(f"`{c}`")[f], zero) for c in every if c.startswith(f"__{pack}:")), zero).alias(f)
    of_pack = lambda pack: F.struct(add(pack, "n", F.lit(0).cast("long")), add(pack, "s", F.lit(0.0)), add(pack, "t", F.lit(0.0)))
    return rows.select(*ident, *[of_pack(pack).alias(pack) for pack in packs])
