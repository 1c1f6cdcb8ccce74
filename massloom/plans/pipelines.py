"""Whole analyses as compositions of operators: what a user runs from files to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.operators import averaged, confidence, counting, digestion, features, lfq, ranking, search
from massloom.operators.confidence import SCORES, detect_score
from massloom.session import written
from massloom.sources import psms as P
from massloom.sources import spectra as S


def generate_peptides(proteins: DataFrame, decoy: str = "shuffle", keep: str = "NC", min_mass: float = 200.0, max_mass: float = 7200.0, **digest) -> DataFrame:
    """(sequence, mh, protein_ids, is_decoy): distinct peptides with masses as M+H and no static modification."""
    base = digestion.peptide_locations(digestion.digest(proteins, **digest), min_mass, max_mass)
    targets = base.select("sequence", (F.col("mass") + P.PROTON).alias("mh"), F.array_join(F.array_distinct(F.transform("locations", lambda x: x["protein_id"])), ",").alias("protein_ids"), F.lit(False).alias("is_decoy"))
    if decoy == "none":
        return targets
    pairs = digestion.make_decoys(base, "reverse" if decoy == "peptide-reverse" else "shuffle", keep)
    decoys = targets.join(pairs, "sequence").select(F.col("decoy").alias("sequence"), "mh", F.concat(F.lit("decoy_"), F.replace("protein_ids", F.lit(","), F.lit(",decoy_"))).alias("protein_ids"), F.lit(True).alias("is_decoy"))
    return targets.unionByName(decoys)


def build_index(spark: SparkSession, fasta: str, path: str, mode: str = "errorifexists", **options) -> DataFrame:
    """Digest a FASTA file into a search index below ``path`` and read it back."""
    digestion.write_index(digestion.build_index(digestion.guard_decoys(P.read_fasta(spark, fasta), options.get("decoy_prefix", "decoy_")), **options), path, mode=mode)
    return spark.read.parquet(path)


def search_files(spark: SparkSession, spectra: str, index: DataFrame, charges: tuple[int, int] = (1, 5), min_peaks: int = 20, scans: str = "", **options) -> DataFrame:
    """Match the spectra of a file or folder; protein ids carry the start of the peptide."""
    rows = S.filter_spectra(S.read_spectra(spark, spectra).where("ms_level = 2"), scans=scans, min_peaks=min_peaks)
    found = search.search(S.spectrum_charges(rows, charges), index, **options)
    ids = F.array_join(F.transform("locations", lambda x: F.concat(F.when(F.col("is_decoy"), F.lit("decoy_")).otherwise(""), x["protein_id"], F.lit("("), (x["start"] + 1).cast("string"), F.lit(")"))), ",")
    return found.withColumn("protein id", ids)


def assign_confidence(matches: DataFrame, method: str = "tdc", score: str | None = None, key: tuple[str, ...] = ("file", "scan", "charge"), peptide_level: bool = False, sidak: bool = False, pi0: float | None = None, is_decoy: str = "is_decoy", decoy_index: str = "decoy index", pep: bool = False) -> DataFrame:
    """Target matches with a q-value column (``tdc q-value``, ``mix-max q-value`` or ``atdc q-value``) and, with ``pep``, a column ``PEP``.

    ``tdc`` competes the best target with the best decoy of each key first; ``mix-max`` keeps both; ``atdc`` averages the competitions of
    each key's target with its decoys, one for each ``decoy_index`` (null for targets). With ``peptide_level`` only a peptide's best match
    stays. ``sidak`` adjusts p-values by the number of candidates (target and decoy together under ``tdc``). ``mix-max`` estimates the share
    ``pi0`` of null targets from all matches where it is not given: from the targets' p-values, or by decoys for other scores. ``atdc`` has neither level nor PEP.
    """
    score = score or detect_score(matches)
    up = SCORES.get(score, True)
    keys = [k for k in key if k in matches.columns]
    if method == "atdc":
        if peptide_level or pep:
            raise ValueError("atdc gives q-values of spectra only")
        return _averaged(matches, keys, score, not up, sidak, decoy_index)
    rows = matches
    tie = [c for c in ("sequence",) if c in rows.columns]
    if method == "tdc":
        order = [F.col(f"`{score}`").desc_nulls_last() if up else F.col(f"`{score}`").asc_nulls_last(), *map(F.col, tie)]
        t, d = F.col("t")[score], F.col("d")[score]
        if sidak and "distinct matches/spectrum" in rows.columns:
            rows = rows.withColumn("distinct matches/spectrum", F.sum("distinct matches/spectrum").over(confidence.Window.partitionBy(*keys)))
        won = confidence.competition(rows.withColumnRenamed(is_decoy, "__kind"), keys, F.col("__kind"), order, t >= d if up else t <= d)
        rows = won.drop("__kind").withColumnRenamed("is_decoy", is_decoy)
    if sidak and "distinct matches/spectrum" in rows.columns:
        rows = rows.withColumn("Sidak adjusted p-value", confidence.sidak(F.col(f"`{score}`"), F.col("`distinct matches/spectrum`")))
        score = "Sidak adjusted p-value"
    if peptide_level:
        rows = confidence.best_per_peptide(rows, ["sequence", is_decoy], score, ascending=not up, tie=[k for k in keys])
    if method == "tdc":
        if pep:
            rows = confidence.posterior_errors(written(rows, "winners"), score, F.col(is_decoy), ascending=not up)
        return confidence.tdc_qvalues(rows, score, F.col(is_decoy), ascending=not up, out="tdc q-value")
    if method == "mix-max":
        rows = written(rows, "matches")
        scored = rows.where(F.col(f"`{score}`").isNotNull())
        share = pi0
        if share is None:
            found = confidence.storey_pi0(scored.where(~F.col(is_decoy)), f"`{score}`") if score.endswith("p-value") else confidence.decoy_pi0(scored, score, F.col(is_decoy), ascending=not up)
            share = min(1 - 1e-9, max(1e-9, found))  # the table needs a share within (0, 1)
        table = confidence.mixmax_table(scored, score, F.col(is_decoy), share, ascending=not up)
        if pep:
            rows = confidence.posterior_errors(rows, score, F.col(is_decoy), ascending=not up, pi0=share)
        return rows.where(~F.col(is_decoy)).join(table.select(F.col("score").alias("__s"), F.col("q").alias("mix-max q-value")), F.col(f"`{score}`") == F.col("__s"), "left").drop("__s")
    raise ValueError(f"unknown method {method!r}")


def _averaged(matches: DataFrame, keys: list[str], score: str, ascending: bool, sidak: bool, decoy_index: str) -> DataFrame:
    """The best target of each key with its ``atdc q-value``; every key needs a decoy of each index."""
    rows = matches.where(F.col(f"`{score}`").isNotNull())
    if sidak and "distinct matches/spectrum" in rows.columns:
        rows = rows.withColumn("Sidak adjusted p-value", confidence.sidak(F.col(f"`{score}`"), F.col("`distinct matches/spectrum`")))
        score = "Sidak adjusted p-value"
    tie = [c for c in ("sequence",) if c in rows.columns]
    best = written(ranking.top_n(rows, [*keys, decoy_index], score, 1, tie, ascending, out="__place").drop("__place"), "best")
    matrix = written(confidence.atdc_matrix(best, keys, score, decoy_index), "matrix")
    rated = averaged.atdc_qvalues(matrix, keys, ascending).select(*keys, F.col("q_value").alias("atdc q-value"))
    return best.where(F.col(f"`{decoy_index}`").isNull()).join(rated, keys)


def spectral_counts(matches: DataFrame, proteins: DataFrame, measure: str = "NSAF", threshold: float | None = 0.01, q: str = "percolator q-value", parsimony: str = "none", unique: bool = False, intensity: str | None = None, **digest) -> DataFrame:
    """(protein, score) by one of RAW, NSAF, dNSAF, EMPAI and SIN, with ``rank`` of protein groups unless ``parsimony`` is none.

    ``matches`` has sequence and ``protein id``; ``intensity`` names the matched ion intensity that SIN sums.
    """
    if measure not in counting.MEASURES:
        raise ValueError(f"unknown measure {measure!r}")
    rows = counting.threshold_q(matches, q, threshold) if threshold is not None else matches
    rows = rows.withColumn("peptide", P.plain_sequence(F.col("sequence")))
    pairs = rows.select("peptide", F.explode(P.protein_ids(F.col("protein id"))).alias("protein")).distinct()
    if unique and measure != "dNSAF":
        pairs = counting.unique_mapping(pairs)
    lengths = proteins.select(F.col("protein_id").alias("protein"), F.length("residues").alias("length"))
    scores = counting.peptide_scores(rows, weight=intensity if measure == "SIN" else None)
    if measure == "RAW":
        out = counting.raw(scores, pairs)
    elif measure == "NSAF":
        out = counting.nsaf(scores, pairs, lengths)
    elif measure == "dNSAF":
        out = counting.dnsaf(scores, pairs, lengths)
    elif measure == "SIN":
        out = counting.sin(scores, pairs, lengths)
    else:
        out = counting.empai(pairs, digestion.possible_peptides(proteins, **digest))
    if parsimony == "none":
        return out
    kept = counting.greedy_parsimony(pairs).select("protein") if parsimony == "greedy" else pairs.select("protein").distinct()
    metas = counting.meta_proteins(pairs.join(kept, "protein", "left_semi"))
    ranks = counting.meta_ranks(metas, out).select(F.explode("proteins").alias("protein"), "rank")
    return out.join(ranks, "protein", "left")


def label_free(identifications: DataFrame, spectra: DataFrame, design: DataFrame | None = None, integrate: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(peptide intensities, protein intensities); proteins need a design, which also switches normalisation on."""
    peptides = written(lfq.peptide_intensities(lfq.quantify(identifications, spectra, integrate)), "peptides")
    if design is None:
        return peptides, None
    scaled = written(lfq.normalise(peptides, design), "peptides")
    proteins = identifications.select("mod_sequence", F.explode(P.protein_ids(F.col("protein_id"))).alias("protein_id"))
    return scaled, lfq.protein_intensities(scaled, proteins, design)


def assign_features(spectra: DataFrame, ppm: float = 10.0, rt: float = 0.5, max_minutes: float = 1000.0, **detection) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched) MS2 spectra after MS1 features are detected and traced."""
    found = written(features.detect_features(spectra, **detection), "features")
    traces = written(features.drop_contaminants(features.trace_features(found, ppm), max_minutes), "traces")
    return features.split_by_features(spectra, traces, ppm, rt)


def run_all(spark: SparkSession, spectra: str, fasta: str, index_path: str, q_limit: float = 0.01, measure: str = "NSAF", index_options: dict | None = None, search_options: dict | None = None) -> dict[str, DataFrame]:
    """Index, search, confidence and counting in one go; every step's table is written before the next reads it."""
    index = build_index(spark, fasta, index_path, **(index_options or {}))
    matches = written(search_files(spark, spectra, index, **(search_options or {})), "matches")
    accepted = written(assign_confidence(matches.where("`xcorr rank` = 1"), score="xcorr score"), "accepted")
    counts = spectral_counts(accepted, P.read_fasta(spark, fasta), measure, q_limit, "tdc q-value")
    return {"index": index, "matches": matches, "confidence": accepted, "counts": counts}
