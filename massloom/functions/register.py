"""Names under which SQL text can call the functions of peptides: ``register(spark)`` once a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from massloom.functions.sequence import BIN_OFFSET, BIN_WIDTH, PROTON, RESIDUE_MASS, WATER

_MASSES = "map(" + ", ".join(f"'{r}', {m!r}D" for r, m in RESIDUE_MASS.items()) + ")"

#: SQL functions, whose bodies Catalyst inlines, so that no Python runs.
DEFINITIONS = {
    "peptide_mass(sequence STRING) RETURNS DOUBLE": f"CASE WHEN length(sequence) > 0 THEN aggregate(transform(split(sequence, ''), c -> try_element_at({_MASSES}, c)), 0D, (s, x) -> s + x) + {WATER!r}D END",
    "mass2bin(mass DOUBLE, charge INT) RETURNS INT": f"CAST(floor((mass + (charge - 1) * {PROTON!r}D) / (charge * {BIN_WIDTH!r}D) + 1 - {BIN_OFFSET!r}D) AS INT)",
    "bin2mass(bin INT, charge INT) RETURNS DOUBLE": f"(bin - 1 + {BIN_OFFSET!r}D + 0.5D) * charge * {BIN_WIDTH!r}D - (charge - 1) * {PROTON!r}D",
    "to_mz(mass DOUBLE, charge INT) RETURNS DOUBLE": f"mass / abs(charge) + sign(charge) * {PROTON!r}D",
    "neutral_mass(mz DOUBLE, charge INT) RETURNS DOUBLE": f"abs(charge) * mz - charge * {PROTON!r}D",
    "plain_sequence(sequence STRING) RETURNS STRING": r"regexp_replace(sequence, '\\[[^\\]]*\\]', '')",
    "tryptic_peptides(residues STRING) RETURNS ARRAY<STRING>": "filter(split(regexp_replace(residues, '([KR])(?!P)', '$1,'), ','), p -> p <> '')",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session, replacing those of the same names; gives the names."""
    for head, body in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.partition("(")[0] for h in DEFINITIONS]
