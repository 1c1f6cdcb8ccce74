"""Proteins to peptides: digestion, decoys, modifications, and the peptide index."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.functions.sequence import RESIDUE_MASS, WATER, cleavage_regex, mass_key, peptide_mass, residue_masses
from massloom.session import written


def pieces(residues: Column, enzyme: str, custom: str | None = None) -> Column:
    """The protein cut at every site, as an array of (start, sequence); the last residue is never a site."""
    cut = F.split(residues, cleavage_regex(enzyme, custom))
    starts = F.aggregate(cut, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(x))))
    return F.zip_with(F.slice(starts, 1, F.size(cut)), cut, lambda s, x: F.struct(s.alias("start"), x.alias("sequence")))


def digest(proteins: DataFrame, enzyme: str = "trypsin", digestion: str = "full", missed: int = 0, min_length: int = 6, max_length: int = 50, clip_methionine: bool = False, custom: str | None = None, protein_id: str = "protein_id", residues: str = "residues") -> DataFrame:
    """(protein_id, start, sequence) of every peptide.

    ``full``: both ends at sites (or the protein's ends) with at most ``missed`` sites inside; ``partial``: one end may lie
    anywhere; ``no-enzyme``: every substring of fitting length. With ``clip_methionine`` a full
    peptide at the start of a protein that begins with M is also given without it. Each (start, sequence) comes once.
    """
    base = proteins.select(F.col(protein_id).alias("protein_id"), F.col(residues).alias("r")).where("r is not null and r <> ''")
    if enzyme == "no-enzyme" or digestion == "non-specific":
        spans = base.select("*", F.explode(F.sequence(F.lit(0), F.length("r") - 1)).alias("start"))
        spans = spans.where(F.length("r") - F.col("start") >= min_length)
        spans = spans.select("*", F.explode(F.sequence(F.lit(min_length), F.least(F.lit(max_length), F.length("r") - F.col("start")))).alias("n"))
        return spans.select("protein_id", "start", F.substring("r", F.col("start") + 1, F.col("n")).alias("sequence"))
    cut = base.select("protein_id", "r", pieces(F.col("r"), enzyme, custom).alias("p"))
    ends = cut.select("protein_id", "r", F.transform("p", lambda x: x["start"]).alias("starts"), F.transform("p", lambda x: x["start"] + F.length(x["sequence"])).alias("ends"))
    runs = ends.select("protein_id", "r", "starts", "ends", F.posexplode("starts").alias("i", "start"))
    last = F.least(F.col("i") + missed, F.size("starts") - 1)
    if digestion == "full":
        full = runs.select("protein_id", "r", "start", F.explode(F.slice("ends", F.col("i") + 1, last - F.col("i") + 1)).alias("end"))
        if clip_methionine:
            clipped = full.where((F.col("start") == 0) & F.startswith("r", F.lit("M"))).withColumn("start", F.lit(1))
            full = full.unionByName(clipped)
    elif digestion == "partial":
        reach = F.element_at("ends", (last + 1).cast("int"))
        right = runs.select("protein_id", "r", "start", F.explode(F.sequence(F.col("start") + 1, reach)).alias("end"))
        # ends at a site: any start within the same reach to the left
        by_end = ends.select("protein_id", "r", "starts", "ends", F.posexplode("ends").alias("i", "end"))
        first = F.element_at("starts", (F.greatest(F.col("i") - missed, F.lit(0)) + 1).cast("int"))
        left = by_end.select("protein_id", "r", F.explode(F.sequence(first, F.col("end") - 1)).alias("start"), "end")
        full = right.unionByName(left)
    else:
        raise ValueError(f"unknown digestion {digestion!r}")
    size = F.col("end") - F.col("start")
    return full.where(size.between(min_length, max_length)).distinct().select("protein_id", "start", F.substring("r", F.col("start") + 1, size).alias("sequence"))


def possible_peptides(proteins: DataFrame, **options) -> DataFrame:
    """(protein, possible): how many peptides of the constraints each protein has."""
    found = digest(proteins, **options)
    return found.groupBy(F.col("protein_id").alias("protein")).agg(F.count("*").alias("possible"))


def peptide_locations(peptides: DataFrame, min_mass: float = 200.0, max_mass: float = 7200.0, static: dict[str, float] | None = None) -> DataFrame:
    """(sequence, mass, locations): each sequence once, within the mass range; unknown residues drop it."""
    grouped = peptides.groupBy("sequence").agg(F.sort_array(F.collect_set(F.struct("protein_id", "start"))).alias("locations"))
    massed = grouped.withColumn("mass", peptide_mass(F.col("sequence"), static))
    return massed.where(F.col("mass").between(min_mass, max_mass))


def residue_frequencies(peptides: DataFrame, sequence: str = "sequence") -> DataFrame:
    """(place, residue, n) with place N, I or C for the ends and the inside of peptides."""
    letters = peptides.select(F.posexplode(F.split(sequence, "")).alias("i", "residue"), F.length(sequence).alias("n"))
    place = F.when(F.col("i") == 0, "N").when(F.col("i") == F.col("n") - 1, "C").otherwise("I")
    return letters.groupBy(place.alias("place"), "residue").agg(F.count("*").alias("n"))


def _keep(sequence: Column, keep: str) -> tuple[Column, Column, Column]:
    """(kept start, changeable middle, kept end)."""
    n = F.length(sequence)
    a = 1 if keep in ("N", "NC") else 0
    b = 1 if keep in ("C", "NC") else 0
    return F.substring(sequence, 1, a) if a else F.lit(""), F.substring(sequence, F.lit(1 + a), n - a - b), (F.substring(sequence, n, F.lit(1)) if b else F.lit(""))


def reversed_sequence(sequence: Column, keep: str = "NC") -> Column:
    a, middle, b = _keep(sequence, keep)
    return F.concat(a, F.reverse(middle), b)


def shuffled_sequence(sequence: Column, keep: str = "NC", seed: int = 1, attempt: int = 0) -> Column:
    """The middle ordered by a hash of the sequence, place, seed and attempt."""
    a, middle, b = _keep(sequence, keep)
    letters = F.transform(F.split(middle, ""), lambda c, i: F.struct(F.xxhash64(sequence, i, F.lit(seed), F.lit(attempt)).alias("h"), c.alias("c")))
    return F.concat(a, F.array_join(F.transform(F.array_sort(letters), lambda x: x["c"]), ""), b)


#: Sequences up to this length have no decoy.
SHORTEST = {"N": 2, "C": 2, "NC": 3, "none": 1}


def make_decoys(peptides: DataFrame, kind: str = "shuffle", keep: str = "NC", seed: int = 1, attempts: int = 6, sequence: str = "sequence") -> DataFrame:
    """(sequence, decoy) of the targets that get one.

    A decoy differs from its target, from all targets and from the decoys of other targets. A reversal that
    collides is shuffled; attempts are made in rounds, each an anti-join against what is taken.
    """
    targets = peptides.select(F.col(sequence).alias("sequence")).distinct()
    open_rows = targets.where(F.length("sequence") > SHORTEST[keep])
    done = None
    for k in range(attempts):
        made = reversed_sequence(F.col("sequence"), keep) if kind == "reverse" and k == 0 else shuffled_sequence(F.col("sequence"), keep, seed, k)
        tried = open_rows.withColumn("decoy", made).where("decoy <> sequence")
        free = tried.join(targets.select(F.col("sequence").alias("decoy")), "decoy", "left_anti")
        if done is not None:
            free = free.join(done.select("decoy"), "decoy", "left_anti")
        free = free.groupBy("decoy").agg(F.min("sequence").alias("sequence")).select("sequence", "decoy")
        done = free if done is None else done.unionByName(free)
        open_rows = open_rows.join(free.select("sequence"), "sequence", "left_anti")
        done, open_rows = written(done, "decoys"), written(open_rows, "undecoyed")
        if open_rows.isEmpty():
            break
    return done


@dataclass(frozen=True)
class Modification:
    residues: str
    delta: float
    limit: int = 0  # 0: static
    where: str = "any"


_MOD = re.compile(r"^(\d*)([A-Z]+)([+-]\d+(?:\.\d+)?)$")
#: A few common entries of the Unimod list by number.
UNIMOD = {1: 42.010565, 4: 57.021464, 7: 0.984016, 21: 79.966331, 28: -17.026549, 35: 15.994915, 121: 114.042927, 214: 144.102063, 259: 8.014199, 267: 10.008269, 737: 229.162932}


def parse_mods(spec: str, where: str = "any") -> list[Modification]:
    """``[max]RESIDUES±mass`` in a comma list; a leading digit makes it variable. ``[Unimod:n]`` may stand for the mass."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        named = re.sub(r"\[Unimod:(\d+)\]", lambda m: f"{UNIMOD[int(m[1])]:+}", part)
        found = _MOD.match(named)
        if not found:
            raise ValueError(f"cannot read modification {part!r}")
        out.append(Modification(found[2], float(found[3]), int(found[1] or 0), where))
    return out


def static_masses(mods: list[Modification]) -> dict[str, float]:
    out: dict[str, float] = {}
    for m in mods:
        if not m.limit:
            for r in RESIDUE_MASS if m.residues == "X" else m.residues:
                out[r] = out.get(r, 0.0) + m.delta
    return out


def variable_forms(sequence: str, mods: list[Modification], max_mods: int = 255, min_mods: int = 0) -> list[list[tuple[int, float]]]:
    """All placements of variable modifications: at most one at a residue, each within its own limit.

    Modifications of the ends take the first residue's N-terminus, then residues from left to right, then the C-terminus.
    """
    variable = [m for m in mods if m.limit]
    slots: list[tuple[int, list[int]]] = []
    last = len(sequence) - 1
    slots.append((0, [k for k, m in enumerate(variable) if m.where == "nterm" and (m.residues == "X" or sequence[0] in m.residues)]))
    for i, c in enumerate(sequence):
        slots.append((i, [k for k, m in enumerate(variable) if m.where == "any" and (c in m.residues or m.residues == "X")]))
    slots.append((last, [k for k, m in enumerate(variable) if m.where == "cterm" and (m.residues == "X" or sequence[last] in m.residues)]))
    out: list[list[tuple[int, float]]] = []
    counts = [0] * len(variable)

    def grow(at: int, chosen: list[tuple[int, float]]) -> None:
        if at == len(slots):
            if len(chosen) >= min_mods:
                out.append(list(chosen))
            return
        grow(at + 1, chosen)
        if len(chosen) < max_mods:
            place, kinds = slots[at]
            for k in kinds:
                if counts[k] < variable[k].limit:
                    counts[k] += 1
                    grow(at + 1, [*chosen, (place, variable[k].delta)])
                    counts[k] -= 1

    grow(0, [])
    return out


def expand_mods(peptides: DataFrame, mods: list[Modification], max_mods: int = 255, min_mods: int = 0) -> DataFrame:
    """Append ``mods`` (place, delta), ``mod_sequence`` and the modified ``mass``; one row for each form."""
    schema = peptides.schema
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name != "mass"), "mass double", "mods array<struct<place:int,delta:double>>", "mod_sequence string"])

    def run(batches):
        for rows in batches:
            out = []
            for row in rows.to_dict("records"):
                for form in variable_forms(row["sequence"], mods, max_mods, min_mods):
                    text = "".join(c + "".join(f"[{d:+.2f}]" for p, d in form if p == i) for i, c in enumerate(row["sequence"]))
                    out.append({**row, "mass": row["mass"] + sum(d for _, d in form), "mods": [{"place": p, "delta": d} for p, d in form], "mod_sequence": text})
                if len(out) > 20_000:
                    yield pd.DataFrame(out)
                    out = []
            if out:
                yield pd.DataFrame(out)

    order = [f.name for f in schema.fields if f.name != "mass"] + ["mass", "mods", "mod_sequence"]
    return peptides.mapInPandas(lambda b: (p[order] for p in run(b)), fields)


def build_index(proteins: DataFrame, mods_spec: str = "C+57.02146", decoy: str = "shuffle", keep: str = "NC", decoy_prefix: str = "decoy_", min_mass: float = 200.0, max_mass: float = 7200.0, max_mods: int = 255, seed: int = 1, locations: bool = True, **digestion) -> DataFrame:
    """(sequence, mod_sequence, mass, mass_key, mods, locations, is_decoy, target_sequence): targets and decoys ready to search; ``locations`` may be left out."""
    mods = parse_mods(mods_spec)
    static = static_masses(mods)
    base = peptide_locations(digest(proteins, **digestion), min_mass, max_mass, static)
    targets = base.withColumn("is_decoy", F.lit(False)).withColumn("target_sequence", F.col("sequence"))
    rows = targets
    if decoy != "none":
        pairs = make_decoys(base, "reverse" if decoy == "peptide-reverse" else "shuffle", keep, seed)
        decoys = base.join(pairs, "sequence").select(F.col("decoy").alias("sequence"), "locations", "mass", F.lit(True).alias("is_decoy"), F.col("sequence").alias("target_sequence"))
        rows = targets.unionByName(decoys)
    if not locations:
        rows = rows.drop("locations")
    return expand_mods(rows, mods, max_mods).withColumn("mass_key", mass_key(F.col("mass")))


def write_index(index: DataFrame, path: str, bucket: float = 50.0, mode: str = "errorifexists") -> None:
    """Parquet below ``path``, partitioned by mass so that a search reads the masses it needs; ranges of mass are the tasks, so a crowded bucket is several."""
    index.withColumn("mass_bucket", F.floor(F.col("mass") / bucket).cast("int")).repartitionByRange("mass_bucket", "mass", "mod_sequence").sortWithinPartitions("mass_bucket", "mass").write.mode(mode).partitionBy("mass_bucket").parquet(path)


def ion_masses(sequence: Column, static: dict[str, float] | None = None) -> Column:
    """Array of prefix residue sums, one for each cut between residues."""
    sums = F.aggregate(residue_masses(sequence, static), F.array(F.lit(0.0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    return F.slice(sums, 2, F.length(sequence) - 1)


def theoretical_ions(peptides: DataFrame, max_charge: int = 1, sequence: str = "sequence", static: dict[str, float] | None = None, series: tuple[str, ...] = ("b", "y"), isotopes: int = 0, losses: bool = False) -> DataFrame:
    """One row for each fragment ion: (sequence, ion, charge, position, isotope, loss, mz).

    Losses of ammonia need one of R, K, Q, N and losses of water one of S, T, E, D within the fragment.
    """
    from massloom.functions.sequence import AMMONIA, CARBON_MONOXIDE, NEUTRON, PROTON

    base = peptides.select(F.col(sequence).alias("sequence")).distinct()
    cuts = base.select("sequence", F.posexplode(ion_masses(F.col("sequence"), static)).alias("i", "prefix"), peptide_mass(F.col("sequence"), static).alias("total"))
    kinds = {
        "b": (F.col("prefix"), True),
        "a": (F.col("prefix") - CARBON_MONOXIDE, True),
        "c": (F.col("prefix") + AMMONIA, True),
        "y": (F.col("total") - F.col("prefix"), False),
        "x": (F.col("total") - F.col("prefix") + CARBON_MONOXIDE - 2 * 1.00782503207, False),
        "z": (F.col("total") - F.col("prefix") - AMMONIA, False),
    }
    n = F.length("sequence")
    ions = F.array(*(F.struct(F.lit(k).alias("ion"), kinds[k][0].alias("mass"), F.when(F.lit(kinds[k][1]), F.col("i") + 1).otherwise(n - F.col("i") - 1).cast("int").alias("position"), (F.substring("sequence", F.lit(1), F.col("i") + 1) if kinds[k][1] else F.substring("sequence", F.col("i") + 2, n)).alias("part")) for k in series))
    rows = cuts.select("sequence", F.explode(ions).alias("x")).select("sequence", "x.*")
    rows = rows.withColumn("charge", F.explode(F.sequence(F.lit(1), F.lit(max_charge)))).withColumn("isotope", F.explode(F.sequence(F.lit(0), F.lit(isotopes))))
    if losses:
        options = F.array(F.struct(F.lit("").alias("loss"), F.lit(0.0).alias("m")), F.when(F.col("part").rlike("[RKQN]"), F.struct(F.lit("NH3").alias("loss"), F.lit(AMMONIA).alias("m"))), F.when(F.col("part").rlike("[STED]"), F.struct(F.lit("H2O").alias("loss"), F.lit(WATER).alias("m"))))
        rows = rows.withColumn("l", F.explode(F.filter(options, lambda o: o.isNotNull())))
    else:
        rows = rows.withColumn("l", F.struct(F.lit("").alias("loss"), F.lit(0.0).alias("m")))
    mz = (F.col("mass") - F.col("l.m") + F.col("isotope") * NEUTRON) / F.col("charge") + PROTON
    return rows.select("sequence", "ion", "charge", "position", "isotope", F.col("l.loss").alias("loss"), mz.alias("mz"))


def guard_decoys(proteins: DataFrame, prefix: str = "decoy_", column: str = "protein_id") -> DataFrame:
    """The proteins as they are; an error if any id already begins with the decoys' prefix, since its peptides would count as decoys."""
    found = proteins.where(F.startswith(F.col(column), F.lit(prefix))).select(column).first()
    if found is not None:
        raise ValueError(f"the database holds decoys already: {found[0]!r} begins with {prefix!r}")
    return proteins
