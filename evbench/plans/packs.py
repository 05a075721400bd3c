"""Queries on feature packs: lineitem rows are events, suppliers modified entities, parts partners.

Each query gives, for every event, how many slots of a pack are set, the sum of their values and the sum of slot times value, so that a
wrong slot, value or offset shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as Q
from ..functions import site as P
from ..operators import packs as X
from .base import query, table

HEX, LETTERS = "0123456789abcdef", "ACDEFGHIKLMNPQRS"
KINDS = {"R": "Phos", "A": "Ac", "N": "Ub"}
#: A site's residue in its other state.
CHANGE = ("SRK", "DKQ")


def _sequence(c: Column) -> Column:
    return F.translate(F.md5(c), HEX, LETTERS)


def _centre() -> Column:
    return F.least(F.col("position") - 1, F.lit(15))


def _windows(df: DataFrame) -> DataFrame:
    """df (modified_sequence, position) with window, residue and changed_window."""
    df = df.withColumn("window", Q.window_around(F.col("modified_sequence"), F.col("position"), 15)).withColumn("residue", F.substring("modified_sequence", F.col("position"), F.lit(1)))
    return df.withColumn("changed_window", F.concat(F.substring("window", F.lit(1), _centre()), F.translate("residue", *CHANGE), F.substring("window", _centre() + 2, F.lit(40))))


def _context(df: DataFrame) -> DataFrame:
    """df (kind, residue, window, position) with motif and kinase."""
    return df.withColumns({"motif": P.motif_family(F.col("kind"), F.col("residue"), F.col("window"), F.lit(""), F.lit(""), _centre()), "kinase": P.kinase_proxy(F.col("kind"), F.col("residue"), F.col("window"), _centre())})


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with what lineitem alone says."""
    kind = F.coalesce(*[F.when(F.col("l_returnflag") == k, v) for k, v in KINDS.items()], F.lit("Glyco"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("modified"), F.col("l_partkey").alias("partner"), (F.col("l_linenumber") * 4).cast("int").alias("position"), kind.alias("kind"),
        F.col("l_linestatus").alias("organism"), F.when(F.col("l_discount") > 0.05, "yes").alias("colocalized"), F.coalesce(F.col("l_tax") > 0.01, F.lit(False)).alias("taxed"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with all their columns."""
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    j = _rows(spark, sf_dir).join(s.select(F.col("s_suppkey").alias("modified"), "s_name"), "modified").join(p.select(F.col("p_partkey").alias("partner"), "p_name", "p_type", "p_brand"), "partner")
    j = j.withColumns({"modified_sequence": _sequence(F.col("s_name")), "partner_sequence": _sequence(F.col("p_name")), "method": F.col("p_type"), "disease": F.col("p_brand"), "assay": F.when(F.col("taxed"), F.col("p_type"))})
    return _context(_windows(j)).drop("s_name", "p_name", "p_type", "p_brand", "taxed")


def sides(spark: SparkSession, sf_dir: str) -> list[X.Side]:
    """What hangs on an event's partner and on its site: the windows of each distinct sequence, spread over the entities that have it."""
    s, p, rows = table(spark, sf_dir, "supplier").where("s_suppkey is not null"), table(spark, sf_dir, "part").where("p_partkey is not null"), _rows(spark, sf_dir)
    places = rows.select("position").distinct()
    kinds = rows.select("kind").distinct()
    taxed = rows.select("taxed").distinct()

    def over_parts(base: DataFrame) -> DataFrame:
        j = base.withColumnRenamed("p_name", "name").join(p, F.col("name").eqNullSafe(F.col("p_name"))).crossJoin(F.broadcast(taxed))
        own = {"partner": F.col("p_partkey"), "method": F.col("p_type"), "disease": F.col("p_brand"), "assay": F.when(F.col("taxed"), F.col("p_type"))}
        return j.withColumns(own).drop("name", *p.columns)

    def over_sites(base: DataFrame) -> DataFrame:
        j = base.withColumnRenamed("s_name", "name").join(s.select("s_suppkey", "s_name"), F.col("name").eqNullSafe(F.col("s_name"))).crossJoin(F.broadcast(kinds))
        return _context(j.withColumn("modified", F.col("s_suppkey")).drop("name", "s_suppkey", "s_name"))

    partners = p.select("p_name").distinct().withColumn("partner_sequence", _sequence(F.col("p_name")))
    sites = _windows(s.select("s_name").distinct().withColumn("modified_sequence", _sequence(F.col("s_name"))).crossJoin(F.broadcast(places)))
    return [X.Side(("partner", "taxed"), partners, over_parts), X.Side(("modified", "position", "kind"), sites, over_sites)]


# ------------------------------------------------------------------------------------------------------------- DuckDB

_MOTIF = """CASE WHEN kind = 'Phos' THEN CASE WHEN residue = 'Y' THEN 'phosphotyrosine_reader_candidate' WHEN nxt = 'P' THEN 'proline_directed_pin1_ww_candidate'
    WHEN regexp_matches(before, 'R.{1,3}$') THEN 'basophilic_phosphosite_candidate' WHEN regexp_matches(before, '[DE].{0,3}$') OR regexp_matches(after, '^[DE]')
    THEN 'acidic_phosphosite_candidate' ELSE 'other_phosphosite' END WHEN kind = 'Ac' AND residue = 'K' THEN 'acetyl_lysine_reader_candidate'
    WHEN kind IN ('Ub', 'Sumo') AND residue = 'K' THEN 'ubiquitin_like_lysine' WHEN kind = 'Glyco' THEN 'glycosylation_site' ELSE 'other_ptm' END"""
_KINASE = """CASE WHEN kind <> 'Phos' THEN 'non_phos_' || kind WHEN residue = 'Y' THEN 'tyrosine_kinase_proxy' WHEN nxt = 'P' THEN 'proline_directed_kinase_proxy'
    WHEN regexp_matches(before, '[RK].{0,3}$') THEN 'basophilic_kinase_proxy' WHEN regexp_matches(before, '[DE].{0,4}$') THEN 'acidophilic_kinase_proxy'
    ELSE 'other_ser_thr_kinase_proxy' END"""
EVENTS = f"""raw AS (SELECT l_orderkey, l_linenumber, l_suppkey AS modified, l_partkey AS partner, translate(md5(s_name), '{HEX}', '{LETTERS}') AS mod,
    translate(md5(p_name), '{HEX}', '{LETTERS}') AS par, l_linenumber * 4 AS position, CASE {' '.join(f"WHEN l_returnflag = '{k}' THEN '{v}'" for k, v in KINDS.items())} ELSE 'Glyco' END AS kind,
    l_linestatus AS organism, p_type AS method, p_brand AS disease, CASE WHEN l_discount > 0.05 THEN 'yes' END AS colocalized, CASE WHEN l_tax > 0.01 THEN p_type END AS assay
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
    placed AS (SELECT *, substr(mod, greatest(1, position - 15), least(32, position + 15) - greatest(1, position - 15) + 1) AS win, substr(mod, position, 1) AS residue,
    least(position - 1, 15) AS centre FROM raw),
    around AS (SELECT *, upper(win[greatest(1, centre - 4) : centre]) AS before, upper(substr(win, centre + 2, 1)) AS nxt, upper(substr(win, centre + 2, 6)) AS after,
    substr(win, 1, centre) || translate(residue, '{CHANGE[0]}', '{CHANGE[1]}') || substr(win, centre + 2) AS cha FROM placed),
    ev AS (SELECT *, {_MOTIF} AS motif, {_KINASE} AS kinase, position / 32 AS place FROM around)"""


def _composition(column: str, groups: tuple[str, ...], first: int | None) -> str:
    """Rows (key, i, v) of a sequence's composition and descriptors."""
    share = "".join
    values = [f"length(regexp_replace({column}, '[^{x}]', '', 'g')) / length({column})" for x in X.LETTERS] + [f"ln(1 + length({column}))"]
    values += [f"length(regexp_replace({column}, '[^{share(g)}]', '', 'g')) / length({column})" for g in groups]
    values = values[:first]
    return f"SELECT {column} AS key, unnest(range({len(values)})) AS i, unnest([{', '.join(values)}]) AS v FROM (SELECT DISTINCT {column} FROM ev)"


def _hashed(column: str, k: int, dims: int, salt: str, first: int | None) -> str:
    digest = f"md5('{salt}' || m)"
    return f"""SELECT key, i, v FROM (SELECT key, i, v / sqrt(sum(v * v) OVER (PARTITION BY key)) AS v FROM (SELECT key, ('0x' || substr({digest}, 1, 8))::BIGINT % {dims} AS i,
    sum(1 - 2 * (('0x' || substr({digest}, 9, 2))::BIGINT % 2)) AS v FROM (SELECT {column} AS key, substr({column}, unnest(range(1, length({column}) - {k - 2})), {k}) AS m
    FROM (SELECT DISTINCT {column} FROM ev)) GROUP BY ALL)) WHERE i < {first or dims}"""


#: Block -> (rows of (key, i, v) or values on ev, the key's column).
_SEQUENCES = {
    "window29": ("win", "first"), "window28": ("win", "second"), "changed28": ("cha", "second"), "mod29": ("mod", "first"), "mod28": ("mod", "second"), "partner29": ("par", "first"), "partner28": ("par", "second"),
    "window_hash128": ("win", 2, 128, "site"), "window_hash96": ("win", 2, 96, "site"), "changed_hash96": ("cha", 2, 96, "site"), "mod_hash192": ("mod", 3, 192, "mod"), "mod_hash128": ("mod", 3, 128, "mod"),
    "partner_hash192": ("par", 3, 192, "partner"), "partner_hash128": ("par", 3, 128, "partner"),
}


def _rows_of(block: str, first: int | None) -> tuple[str, str]:
    column, *how = _SEQUENCES[block]
    if len(how) == 1:
        return column, _composition(column, (*X.DESCRIPTORS, "C") if how[0] == "first" else X.DESCRIPTORS, first)
    return column, _hashed(column, *how, first)


def pack_sql(parts: list[X.Part]) -> str:
    """DuckDB SQL of a pack's digest.  Offsets are running sums of the blocks' sizes; one-hot sizes are counted from the data."""
    ctes, joins, terms, offset = [EVENTS], [], [], "0"
    chem = {k: v for k, v in P.CHEMISTRY.items()}

    def of_row(values: list[str], size: str) -> None:
        nonlocal offset
        terms.append((" + ".join(f"({v} <> 0)::INT" for v in values), " + ".join(values), " + ".join(f"({offset} + {k}) * {v}" for k, v in enumerate(values))))
        offset = f"{offset} + {size}"

    def of_table(name: str, column: str, rows: str, size: str) -> None:
        nonlocal offset
        ctes.append(f"{name} AS (SELECT key, count(*) AS n, sum(v) AS s, sum(i * v) AS t FROM ({rows}) WHERE v <> 0 GROUP BY key)")
        joins.append(f"LEFT JOIN {name} ON {name}.key = {column}")
        terms.append((f"coalesce({name}.n, 0)", f"coalesce({name}.s, 0)", f"coalesce({name}.t + ({offset}) * {name}.s, 0)"))
        offset = f"{offset} + {size}"

    flat = [y for x in parts for y in ([X.Part("window29"), X.Part("place")] if x.block == "window30" else [x])]
    for k, (block, first) in enumerate(flat):
        name = f"b{k}"
        if block in _SEQUENCES:
            column, rows = _rows_of(block, first)
            size = first or (int(block[-2:]) if "hash" not in block else int(block.rpartition("hash")[2]))
            of_table(name, column, rows, str(size))
        elif block in X.ONE_HOT:
            for c in X.ONE_HOT[block]:
                ctes.append(f"{name}{c} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS size FROM (SELECT DISTINCT coalesce({c}, 'missing') AS v FROM ev))")
                joins.append(f"JOIN {name}{c} ON {name}{c}.v = coalesce({c}, 'missing')")
                terms.append(("1", "1", f"({offset}) + {name}{c}.i"))
                offset = f"{offset} + {name}{c}.size"
        elif block == "place":
            of_row(["place"], "1")
        elif block == "flags":
            of_row(["place", "(modified = partner)::INT", "(length(coalesce(disease, '')) > 0)::INT", "(length(coalesce(colocalized, '')) > 0)::INT"], "4")
        elif block == "chemistry":
            values = [f"CASE {' '.join(f'''WHEN kind = '{x}' THEN {f'ln(1 + abs({v[0]!r}::DOUBLE))' if j == 0 else f'{v[j]!r}::DOUBLE'}''' for x, v in chem.items())} ELSE 0 END" for j in range(6)]
            of_row(values, "6")
        elif block == "state_difference":
            sides = []
            for sign, blocks in ((1, ("changed28", "changed_hash96")), (-1, ("window28", "window_hash96"))):
                for start, b in zip((0, 28), blocks, strict=True):
                    column, rows = _rows_of(b, min(X.STATE - start, 96))
                    sides.append(f"SELECT p.win || '|' || p.cha AS key, r.i + {start} AS i, {sign} * r.v AS v FROM (SELECT DISTINCT win, cha FROM ev) p JOIN ({rows}) r ON r.key = p.{column}")
            of_table(name, "win || '|' || cha", f"SELECT key, i, sum(v) AS v FROM ({' UNION ALL '.join(sides)}) GROUP BY key, i HAVING sum(v) <> 0", str(X.STATE))
        else:
            raise ValueError(block)
    n, s, t = (" + ".join(f"({x[k]})" for x in terms) for k in range(3))
    return f"WITH {', '.join(ctes)} SELECT l_orderkey, l_linenumber, ({n})::BIGINT AS slots, round(({s})::DOUBLE, 6) AS total, round(({t})::DOUBLE, 5) AS weighted FROM ev {' '.join(joins)}"


def digest(rows: DataFrame, sums: str) -> DataFrame:
    return rows.select("l_orderkey", "l_linenumber", F.col(sums)["n"].alias("slots"), F.round(F.col(sums)["s"], 6).alias("total"), F.round(F.col(sums)["t"], 5).alias("weighted"))


def _pack(name: str, parts: list[X.Part]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return digest(X.pack_sums(_rows(spark, sf_dir), ["l_orderkey", "l_linenumber"], {"pack": parts}, sides(spark, sf_dir)), "pack")

    run.__name__ = name
    return run


for _kind, _packs in (("pack", X.FIRST), ("state", X.SECOND)):
    for _name, _parts in _packs.items():
        query(f"{_kind}_{_name}", pack_sql(_parts))(_pack(f"{_kind}_{_name}", _parts))

_FIXED = {"window30": 30, "flags": 4, "place": 1, "chemistry": 6, "state_difference": X.STATE}


def _manifest_sql() -> str:
    rows = []
    for pack, parts in (X.FIRST | X.SECOND).items():
        for k, (block, first) in enumerate(parts):
            if block in X.ONE_HOT:
                size = " + ".join(f"(SELECT count(DISTINCT coalesce({c}, 'missing')) FROM ev)" for c in X.ONE_HOT[block])
            else:
                size = str(first or _FIXED.get(block) or (int(block.rpartition("hash")[2]) if "hash" in block else int(block[-2:])))
            rows.append(f"SELECT '{pack}' AS pack, {k} AS place, '{block}' AS block, ({size})::INT AS dims")
    return f"WITH {EVENTS}, m AS ({' UNION ALL '.join(rows)}) SELECT pack, place, block, coalesce(sum(dims) OVER (PARTITION BY pack ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS first_slot, dims FROM m"


@query("pack_manifest", _manifest_sql())
def pack_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each block of each pack lies."""
    _, blocks = X.event_blocks(events(spark, sf_dir), X.FIRST | X.SECOND)
    return spark.createDataFrame(X.manifest(blocks, X.FIRST | X.SECOND), "pack string, place int, block string, first_slot int, dims int")
