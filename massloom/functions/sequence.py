"""Peptide sequences as column expressions: masses, bins, tolerances, terminal flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Monoisotopic residue masses in Da.
RESIDUE_MASS = {
    "A": 71.03711378, "C": 103.00918478, "D": 115.02694302, "E": 129.04259308, "F": 147.06841390,
    "G": 57.02146372, "H": 137.05891186, "I": 113.08406396, "K": 128.09496300, "L": 113.08406396,
    "M": 131.04048460, "N": 114.04292744, "O": 114.07931294, "P": 97.05276384, "Q": 128.05857750,
    "R": 156.10111102, "S": 87.03202840, "T": 101.04767846, "U": 150.95363559, "V": 99.06841390,
    "W": 186.07931294, "Y": 163.06332852,
}
WATER = 18.01056468
AMMONIA = 17.02654910
PROTON = 1.00727646677
HYDROGEN = 1.00782503207
CARBON_MONOXIDE = 27.9949146
NEUTRON = 1.00335483
#: Average residue masses in Da.
RESIDUE_AVERAGE = {
    "A": 71.0788, "C": 103.1388, "D": 115.0886, "E": 129.1155, "F": 147.1766, "G": 57.0519, "H": 137.1411,
    "I": 113.1594, "K": 128.1741, "L": 113.1594, "M": 131.1926, "N": 114.1038, "O": 114.1472, "P": 97.1167,
    "Q": 128.1307, "R": 156.1875, "S": 87.0782, "T": 101.1051, "U": 150.0388, "V": 99.1326, "W": 186.2132, "Y": 163.1760,
}
BIN_WIDTH, BIN_OFFSET = 0.02, 0.40


def _table(masses: dict[str, float], static: dict[str, float] | None) -> Column:
    pairs = [x for r, m in masses.items() for x in (F.lit(r), F.lit(m + (static or {}).get(r, 0.0)))]
    return F.create_map(*pairs)


def residue_masses(sequence: Column, static: dict[str, float] | None = None, average: bool = False) -> Column:
    """The mass of each residue in order; null for a letter that is no residue."""
    table = _table(RESIDUE_AVERAGE if average else RESIDUE_MASS, static)
    return F.transform(F.split(sequence, ""), lambda c: F.try_element_at(table, c))


def peptide_mass(sequence: Column, static: dict[str, float] | None = None, average: bool = False) -> Column:
    """Neutral mass of the unmodified sequence; null if it is empty or holds an unknown residue."""
    sums = F.aggregate(residue_masses(sequence, static, average), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.length(sequence) > 0, sums + (WATER if not average else 18.01528))


def mass_key(mass: Column, places: int = 5) -> Column:
    """Masses as fixed-point integers, to group and join on."""
    return F.round(mass * 10**places).cast("long")


def mass2bin(mass: Column, charge: int | Column = 1, width: float = BIN_WIDTH, offset: float = BIN_OFFSET) -> Column:
    z = F.lit(charge) if isinstance(charge, int) else charge
    return F.floor((mass + (z - 1) * PROTON) / (z * F.lit(width)) + 1 - F.lit(offset)).cast("int")


def bin2mass(number: Column, charge: int | Column = 1, width: float = BIN_WIDTH, offset: float = BIN_OFFSET) -> Column:
    """The mass at the middle of a bin."""
    z = F.lit(charge) if isinstance(charge, int) else charge
    return (number - 1 + F.lit(offset) + 0.5) * z * F.lit(width) - (z - 1) * PROTON


def to_mz(mass: Column, charge: Column) -> Column:
    return mass / F.abs(charge) + F.signum(charge) * PROTON


def to_mass(mz: Column, charge: Column) -> Column:
    return F.abs(charge) * mz - charge * PROTON


def ppm_bounds(mass: Column, ppm: float | Column) -> tuple[Column, Column]:
    p = F.lit(ppm) if not isinstance(ppm, Column) else ppm
    return mass * (1 - p / 1e6), mass * (1 + p / 1e6)


def within_ppm(experimental: Column, theoretical: Column, ppm: float) -> Column:
    return F.abs((experimental - theoretical) / theoretical * 1e6) <= ppm


def plain_sequence(modified: Column) -> Column:
    """Drop bracketed modifications, flanks and case marks."""
    core = F.regexp_replace(modified, r"^[A-Z\-*]\.(.*)\.[A-Z\-*]$", "$1")
    return F.regexp_replace(core, r"\[[^\]]*\]|\([^)]*\)|[^A-Z]", "")


#: Cleavage rules as (residues before the site, residues that must not precede, residues after it, residues that must not follow).
ENZYMES = {
    "trypsin": ("KR", "", "", "P"),
    "trypsin/p": ("KR", "", "", ""),
    "chymotrypsin": ("FWYL", "", "", "P"),
    "elastase": ("ALIV", "", "", "P"),
    "clostripain": ("R", "", "", ""),
    "cyanogen-bromide": ("M", "", "", ""),
    "iodosobenzoate": ("W", "", "", ""),
    "proline-endopeptidase": ("P", "", "", ""),
    "staph-protease": ("E", "", "", ""),
    "asp-n": ("", "", "D", ""),
    "lys-c": ("K", "", "", "P"),
    "lys-n": ("", "", "K", ""),
    "arg-c": ("R", "", "", "P"),
    "glu-c": ("DE", "", "", "P"),
    "pepsin-a": ("FL", "", "", "P"),
    "elastase-trypsin-chymotrypsin": ("ALIVKRWFY", "", "", "P"),
    "lysarginase": ("", "", "KR", ""),
}


def cleavage_regex(enzyme: str, custom: str | None = None) -> str:
    """A zero-width regular expression of the enzyme's sites.

    ``custom`` is written ``[before]|[after]``, with braces for residues that forbid a cut, as in ``[KR]|{P}``.
    """
    if custom:
        left, _, right = custom.partition("|")

        def side(rule: str, look: str) -> str:
            body = rule[1:-1]
            if body in ("", "X"):
                return ""
            return f"(?{look}{'=' if rule.startswith('[') else '!'}[{body}])"

        return side(left, "<") + side(right, "") + "(?<=[A-Z])(?=[A-Z])"
    if enzyme == "no-enzyme":
        return "(?<=[A-Z])(?=[A-Z])"
    before, never_before, after, never_after = ENZYMES[enzyme]
    out = ""
    if before:
        out += f"(?<=[{before}])"
    if never_before:
        out += f"(?<![{never_before}])"
    if after:
        out += f"(?=[{after}])"
    if never_after:
        out += f"(?![{never_after}])"
    return out + "(?<=[A-Z])(?=[A-Z])"
