"""Writers: match tables, feature tables, spectra, and the text formats of search results.

A text format is a DataFrame of lines: header rows are a small table of their own that is written as the
first part, and bodies are rows or records joined by line feeds, so Spark's text writer does the rest in parallel.
The parts of an XML format make one document when they are put together in the order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions.sequence import PROTON


def one_hot(rows: DataFrame, column: str, values: tuple[int, ...], prefix: str) -> DataFrame:
    """Append ``<prefix><value>`` = 1 where the column has that value, else 0."""
    return rows.select("*", *((F.col(column) == v).cast("int").alias(f"{prefix}{v}") for v in values))


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def _number(c: Column, digits: int = 8) -> Column:
    return F.regexp_replace(F.format_string(f"%.{digits}f", c.cast("double")), r"(\.\d*?[1-9])0+$|\.0+$", "$1")


def write_table(rows: DataFrame, path: str, columns: list[str] | None = None, overwrite: bool = False) -> None:
    """Tab-separated with a header in each part; nulls are empty cells."""
    keep = [c for c in (columns or rows.columns) if c in rows.columns]
    rows.select(*(f"`{c}`" for c in keep)).write.mode(_mode(overwrite)).option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_by_kind(rows: DataFrame, path: str, is_decoy: str = "is_decoy", overwrite: bool = False) -> None:
    """Targets and decoys below folders of their own."""
    kind = F.when(F.col(is_decoy), "decoy").otherwise("target")
    rows.withColumn("kind", kind).write.mode(_mode(overwrite)).option("sep", "\t").option("header", True).partitionBy("kind").csv(path)


def _write_lines(spark: SparkSession, head: list[str], body: DataFrame, tail: list[str], path: str, overwrite: bool, compression: str = "none") -> None:
    """``body`` (one text column) between fixed lines; parts are named in order. ``compression`` is one of the text writer's, such as gzip."""
    parts = body.toDF("value")
    if head:
        parts = spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).union(parts)
    if tail:
        parts = parts.union(spark.createDataFrame([("\n".join(tail),)], "value string").coalesce(1))
    parts.write.mode(_mode(overwrite)).option("compression", compression).text(path)


def _col(rows: DataFrame, name: str, default: str = "") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(default)) if name in rows.columns else F.lit(default)


def _matches(psms: DataFrame, fields: list[Column]) -> DataFrame:
    """A row per spectrum with its matches in rank order, spectra in order; a spectrum's matches are few (top-match). Files with the same scans stay apart.

    The plain columns are dealt by ranges of spectra once. What is made of them, the texts above all, is shuffled no more.
    """
    by = [c for c in ("file", "scan", "charge") if c in psms.columns]
    # one key: of several, a constant one (a fixed charge) would be folded away on one side and cost a second shuffle
    dealt = psms.withColumn("__key", F.struct(*by)).repartitionByRange("__key")
    rows = dealt.groupBy("__key").agg(F.max("spectrum neutral mass").alias("mass"), F.sort_array(F.collect_list(F.struct(F.col("xcorr rank").alias("rank"), *fields))).alias("m"))
    return rows.sortWithinPartitions("__key").select("__key.*", "mass", "m")


def write_sqt(psms: DataFrame, path: str, database: str = "", overwrite: bool = False) -> None:
    """SQT: S, M and L lines; charges and masses as (M+H)."""
    flank = F.col("flanking aa") if "flanking aa" in psms.columns else F.lit("--")
    peptide = F.concat(F.substring(F.coalesce(flank, F.lit("--")), 1, 1), F.lit("."), F.col("sequence"), F.lit("."), F.substring(F.coalesce(flank, F.lit("--")), -1, 1))
    line = F.concat_ws(
        "\t", F.lit("M"), _col(psms, "xcorr rank", "0"), _col(psms, "sp rank", "0"), F.format_string("%.4f", F.col("peptide mass") + PROTON), _col(psms, "delta_cn", "0"),
        _col(psms, "xcorr score", "0"), _col(psms, "sp score", "0"), _col(psms, "b/y ions matched", "0"), _col(psms, "b/y ions total", "0"), peptide, F.lit("U"),
    )
    loci = F.array_join(F.transform(F.split("protein id", ","), lambda p: F.concat(F.lit("\nL\t"), p)), "")
    rows = _matches(psms, [F.concat(line, loci).alias("text")])
    head = F.concat_ws("\t", F.lit("S"), F.col("scan").cast("string"), F.col("scan").cast("string"), F.col("charge").cast("string"), F.lit("0.0"), F.lit("spark"), F.format_string("%.4f", F.col("mass") + PROTON), F.lit("0"), F.lit("0"), F.size("m").cast("string"))
    body = rows.select(F.concat_ws("\n", head, F.array_join(F.transform("m", lambda x: x["text"]), "\n")))
    _write_lines(psms.sparkSession, ["H\tSQTGenerator massloom", f"H\tDatabase {database}"], body, [], path, overwrite)


def _xml(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _attributes(**values: Column) -> Column:
    return F.concat(*(F.concat(F.lit(f' {k}="'), _xml(F.coalesce(v.cast("string"), F.lit(""))), F.lit('"')) for k, v in values.items()))


def write_pepxml(psms: DataFrame, path: str, overwrite: bool = False, compression: str = "none") -> None:
    """pepXML: a spectrum_query per spectrum with its search hits."""
    proteins = F.split("protein id", ",")
    flank = F.coalesce(F.col("flanking aa"), F.lit("--")) if "flanking aa" in psms.columns else F.lit("--")
    others = F.array_join(F.transform(F.slice(proteins, 2, F.size(proteins)), lambda p: F.concat(F.lit('<alternative_protein protein="'), _xml(p), F.lit('"/>'))), "")
    scores = [(n, k) for n, k in (("xcorr_score", "xcorr score"), ("delta_cn", "delta_cn"), ("sp_score", "sp score"), ("tailor_score", "tailor score"), ("percolator_score", "percolator score"), ("percolator_qvalue", "percolator q-value")) if k in psms.columns]
    score = F.concat_ws("", *(F.concat(F.lit(f'<search_score name="{n}" value="'), F.col(f"`{k}`").cast("string"), F.lit('"/>')) for n, k in scores))
    plain = F.col("unmodified sequence") if "unmodified sequence" in psms.columns else F.regexp_replace("sequence", r"\[[^\]]*\]", "")
    hit = F.concat(
        F.lit("<search_hit"), _attributes(hit_rank=F.col("xcorr rank"), peptide=plain, peptide_prev_aa=F.substring(flank, 1, 1), peptide_next_aa=F.substring(flank, -1, 1), protein=proteins[0], num_tot_proteins=F.size(proteins), calc_neutral_pep_mass=F.col("peptide mass")),
        F.lit(">"), others, F.when(plain != F.col("sequence"), F.concat(F.lit('<modification_info modified_peptide="'), _xml(F.col("sequence")), F.lit('"/>'))).otherwise(""), score, F.lit("</search_hit>"),
    )
    rows = _matches(psms, [hit.alias("text")])
    query = F.concat(
        F.lit("<spectrum_query"), _attributes(spectrum=F.concat_ws(".", F.col("scan").cast("string"), F.col("scan").cast("string"), F.col("charge").cast("string")), start_scan=F.col("scan"), end_scan=F.col("scan"), precursor_neutral_mass=F.col("mass"), assumed_charge=F.col("charge")),
        F.lit("><search_result>"), F.array_join(F.transform("m", lambda x: x["text"]), ""), F.lit("</search_result></spectrum_query>"),
    )
    _write_lines(psms.sparkSession, ['<?xml version="1.0" encoding="UTF-8"?>', '<msms_pipeline_analysis xmlns="http://regis-web.systemsbiology.net/pepXML">', "<msms_run_summary>"], rows.select(query), ["</msms_run_summary>", "</msms_pipeline_analysis>"], path, overwrite, compression)


def write_mzid(psms: DataFrame, path: str, overwrite: bool = False, compression: str = "none") -> None:
    """mzIdentML: proteins, peptides, evidences and results; each list is distributed, ids are the things themselves."""
    spark = psms.sparkSession
    pairs = psms.select("sequence", F.explode(F.split("protein id", ",")).alias("protein"), F.col("is_decoy") if "is_decoy" in psms.columns else F.lit(False).alias("is_decoy"))
    proteins = pairs.select("protein").distinct().select(F.concat(F.lit("<DBSequence"), _attributes(id=F.concat(F.lit("DB_"), "protein"), accession=F.col("protein"), searchDatabase_ref=F.lit("DB")), F.lit("/>")))
    peptides = psms.select("sequence").distinct().select(F.concat(F.lit("<Peptide"), _attributes(id=F.concat(F.lit("P_"), "sequence")), F.lit("><PeptideSequence>"), _xml(F.regexp_replace("sequence", r"\[[^\]]*\]", "")), F.lit("</PeptideSequence></Peptide>")))
    evidence_id = F.concat_ws("_", F.lit("E"), "sequence", "protein")
    evidence = pairs.distinct().select(F.concat(F.lit("<PeptideEvidence"), _attributes(id=evidence_id, peptide_ref=F.concat(F.lit("P_"), "sequence"), dBSequence_ref=F.concat(F.lit("DB_"), "protein"), isDecoy=F.col("is_decoy")), F.lit("/>")))
    refs = F.array_join(F.transform(F.split("protein id", ","), lambda p: F.concat(F.lit('<PeptideEvidenceRef peptideEvidence_ref="'), _xml(F.concat_ws("_", F.lit("E"), F.col("sequence"), p)), F.lit('"/>'))), "")
    z = F.col("charge")
    item = F.concat(
        F.lit("<SpectrumIdentificationItem"), _attributes(id=F.concat_ws("_", F.lit("I"), F.col("scan").cast("string"), z.cast("string"), F.col("xcorr rank").cast("string")), rank=F.col("xcorr rank"), chargeState=z, peptide_ref=F.concat(F.lit("P_"), "sequence"), experimentalMassToCharge=F.col("spectrum neutral mass") / z + PROTON, calculatedMassToCharge=F.col("peptide mass") / z + PROTON, passThreshold=F.lit("true")),
        F.lit(">"), refs, F.lit('<cvParam accession="MS:1001155" cvRef="PSI-MS" name="SEQUEST:xcorr" value="'), _col(psms, "xcorr score"), F.lit('"/></SpectrumIdentificationItem>'),
    )
    rows = _matches(psms, [item.alias("text")])
    result = F.concat(F.lit("<SpectrumIdentificationResult"), _attributes(id=F.concat_ws("_", F.lit("R"), F.col("scan").cast("string"), F.col("charge").cast("string")), spectrumID=F.concat(F.lit("scan="), F.col("scan").cast("string")), spectraData_ref=F.lit("SD")), F.lit(">"), F.array_join(F.transform("m", lambda x: x["text"]), ""), F.lit("</SpectrumIdentificationResult>"))

    def fixed(*lines: str) -> DataFrame:
        return spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1)

    body = proteins.union(peptides).union(evidence).union(fixed("</SequenceCollection>", '<DataCollection><AnalysisData><SpectrumIdentificationList id="L">')).union(rows.select(result))
    _write_lines(spark, ['<?xml version="1.0" encoding="UTF-8"?>', '<MzIdentML version="1.1.0" xmlns="http://psidev.info/psi/pi/mzIdentML/1.1">', "<SequenceCollection>"], body, ["</SpectrumIdentificationList></AnalysisData></DataCollection>", "</MzIdentML>"], path, overwrite, compression)


#: Score columns of mzTab with their terms.
MZTAB_SCORES = (("xcorr score", "[MS, MS:1001155, SEQUEST:xcorr, ]"), ("tailor score", "[MS, MS:1003366, tailor score, ]"), ("delta_cn", "[MS, MS:1001143, SEQUEST:deltacn, ]"), ("xcorr rank", "[MS, MS:1003358, XCorr rank, ]"))


def write_mztab(psms: DataFrame, path: str, settings: dict[str, str] | None = None, run: str = "", overwrite: bool = False) -> None:
    """mzTab: metadata lines, then the match section."""
    scores = [(c, term) for c, term in MZTAB_SCORES if c in psms.columns]
    head = ["MTD\tmzTab-version\t1.0.0", "MTD\tmzTab-mode\tSummary", "MTD\tmzTab-type\tIdentification", "MTD\tdescription\tSpectrum identifications", f"MTD\tms_run[1]-location\t{run}"]
    head += [f"MTD\tpsm_search_engine_score[{k}]\t{term}" for k, (_, term) in enumerate(scores, 1)]
    head += [f"MTD\tsoftware[1]-setting[{k}]\t{n} = {v}" for k, (n, v) in enumerate(sorted((settings or {}).items()), 1)]
    names = ["sequence", "PSM_ID", "accession", "unique", "database", "search_engine", *(f"search_engine_score[{k}]" for k in range(1, len(scores) + 1)), "modifications", "spectra_ref", "retention_time", "charge", "exp_mass_to_charge", "calc_mass_to_charge", "pre", "post"]
    head += ["", "PSH\t" + "\t".join(names)]
    z = F.col("charge")
    flank = F.coalesce(F.col("flanking aa"), F.lit("--")) if "flanking aa" in psms.columns else F.lit("--")
    plain = F.col("unmodified sequence") if "unmodified sequence" in psms.columns else F.regexp_replace("sequence", r"\[[^\]]*\]", "")
    cells = [
        plain, F.concat_ws("_", F.col("scan").cast("string"), z.cast("string"), _col(psms, "xcorr rank")), F.col("protein id"), F.when(F.size(F.split("protein id", ",")) > 1, "0").otherwise("1"), F.lit("null"), F.lit("null"),
        *(_col(psms, c, "null") for c, _ in scores), _col(psms, "modifications", "null"), F.concat(F.lit("ms_run[1]:scan="), F.col("scan").cast("string")), _col(psms, "retention time", "null"), z.cast("string"),
        (F.col("spectrum neutral mass") / z + PROTON).cast("string"), (F.col("peptide mass") / z + PROTON).cast("string"), F.substring(flank, 1, 1), F.substring(flank, -1, 1),
    ]
    _write_lines(psms.sparkSession, head, psms.select(F.concat_ws("\t", F.lit("PSM"), *cells)), [], path, overwrite)


def pin_features(psms: DataFrame, charges: tuple[int, ...] = (1, 2, 3), enzyme_before: str = "KR", enzyme_not_after: str = "P") -> DataFrame:
    """The feature table of matches: label, masses, scores that the input has, peptide length, one-hot charge, terminal cleavage flags.

    Infinite -log10 p-values are capped at 100. ``flanking aa`` holds the residues before and after; ``-`` counts as a cleavage.
    """
    plain = F.col("unmodified sequence") if "unmodified sequence" in psms.columns else F.regexp_replace("sequence", r"\[[^\]]*\]", "")
    before, after = F.substring("flanking aa", 1, 1), F.substring("flanking aa", -1, 1)
    first, last = F.substring(plain, 1, 1), F.substring(plain, -1, 1)

    def site(a: Column, b: Column) -> Column:
        inside = a.isin(*enzyme_before) & ~b.isin(*enzyme_not_after)
        return (inside | (a == "-") | (b == "-")).cast("int")

    inner = F.regexp_count(plain, F.lit(f"[{enzyme_before}](?=[^{enzyme_not_after}])"))
    decoy = F.col("is_decoy") if "is_decoy" in psms.columns else (F.col("target/decoy") == "decoy" if "target/decoy" in psms.columns else F.lit(False))
    kind = F.when(decoy, "decoy").otherwise("target")
    rank = F.col("xcorr rank") if "xcorr rank" in psms.columns else F.lit(1)
    out = [
        F.concat_ws("_", kind, _col(psms, "file_idx", "0"), F.col("scan").cast("string"), F.col("charge").cast("string"), rank.cast("string")).alias("SpecId"),
        F.when(decoy, -1).otherwise(1).alias("Label"), F.col("scan").alias("ScanNr"),
        (F.col("spectrum neutral mass") + PROTON).alias("ExpMass"), (F.col("peptide mass") + PROTON).alias("CalcMass"),
    ]
    have = set(psms.columns)
    if "sp rank" in have:
        out.append(F.ln("sp rank").alias("lnrSp"))
    for source, name in (("delta_lcn", "deltLCn"), ("delta_cn", "deltCn"), ("xcorr score", "XCorr"), ("tailor score", "TailorScore"), ("sp score", "Sp"), ("refactored xcorr", "RefactoredXCorr"), ("res-ev score", "ResEvScore")):
        if source in have:
            out.append(F.col(f"`{source}`").alias(name))
    for source, name in (("exact p-value", "NegLog10PValue"), ("res-ev p-value", "NegLog10ResEvPValue"), ("combined p-value", "NegLog10CombinePValue"), ("e-value", "NegLog10EValue")):
        if source in have:
            p = F.col(f"`{source}`")
            out.append(F.when(p > 0, -F.log10(p)).otherwise(F.lit(100.0)).alias(name))
    if {"b/y ions matched", "b/y ions total"} <= have:
        out.append((F.col("`b/y ions matched`") / F.nullif(F.col("`b/y ions total`"), F.lit(0))).alias("IonFrac"))
    out += [F.length(plain).alias("PepLen"), *((F.col("charge") == z).cast("int").alias(f"Charge{z}") for z in charges), site(before, first).alias("enzN"), site(last, after).alias("enzC"), inner.alias("enzInt")]
    if "distinct matches/spectrum" in have:
        out.append(F.when(F.col("`distinct matches/spectrum`") > 0, F.ln("`distinct matches/spectrum`")).otherwise(0.0).alias("lnNumDSP"))
    delta = F.col("spectrum neutral mass") - F.col("peptide mass")
    out += [delta.alias("dM"), F.abs(delta).alias("absdM"), F.concat(before, F.lit("."), F.col("sequence"), F.lit("."), after).alias("Peptide"), F.col("protein id").alias("Proteins")]
    return psms.select(*out)


def make_pin(sources: list[DataFrame], **options) -> DataFrame:
    """Feature rows of several match tables (targets, decoys), whose columns need not be the same."""
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return pin_features(rows, **options)


def write_pin(features: DataFrame, path: str, overwrite: bool = False) -> None:
    """A header in the first part; proteins take a cell each at the end of a line."""
    names = features.columns
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names[:-1]]
    line = F.concat_ws("\t", *cells, F.regexp_replace(F.col(names[-1]), ",", "\t"))
    _write_lines(features.sparkSession, ["\t".join(names)], features.select(line), [], path, overwrite)


def concat_pins(tables: list[DataFrame]) -> DataFrame:
    """The union of feature tables, whose headers must match."""
    for t in tables[1:]:
        if t.columns != tables[0].columns:
            raise ValueError("feature tables have different headers")
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def write_ms2(spectra: DataFrame, path: str, overwrite: bool = False) -> None:
    """MS2 text of spectra with their charge states."""
    z = F.array_join(F.transform("zstates", lambda s: F.concat(F.lit("\nZ\t"), s["charge"].cast("string"), F.lit("\t"), _number(s["mh"], 5))), "")
    rt = F.when(F.col("rt").isNotNull(), F.concat(F.lit("\nI\tRTime\t"), _number(F.col("rt") / 60, 6))).otherwise("")
    peaks = F.array_join(F.zip_with("mz", "intensity", lambda m, i: F.concat(F.lit("\n"), _number(m, 4), F.lit(" "), _number(i, 4))), "")
    plain = F.col("scan").cast("string")
    scan = F.lpad(plain, F.greatest(F.length(plain), F.lit(6)), F.lit("0"))  # lpad alone cuts what is longer
    body = spectra.select(F.concat(F.lit("S\t"), scan, F.lit("\t"), scan, F.lit("\t"), _number(F.coalesce("precursor_mz", F.lit(0.0)), 5), rt, z, peaks))
    _write_lines(spectra.sparkSession, ["H\tExtractor\tmassloom"], body, [], path, overwrite)


def write_mgf(spectra: DataFrame, path: str, overwrite: bool = False) -> None:
    charge = F.when(F.size("zstates") > 0, F.concat(F.lit("\nCHARGE="), F.array_join(F.transform("zstates", lambda s: F.concat(s["charge"].cast("string"), F.lit("+"))), " and "))).otherwise("")
    rt = F.when(F.col("rt").isNotNull(), F.concat(F.lit("\nRTINSECONDS="), _number(F.col("rt"), 4))).otherwise("")
    peaks = F.array_join(F.zip_with("mz", "intensity", lambda m, i: F.concat(F.lit("\n"), _number(m, 4), F.lit(" "), _number(i, 4))), "")
    body = spectra.select(F.concat(F.lit("BEGIN IONS\nTITLE=scan="), F.col("scan").cast("string"), F.lit("\nSCANS="), F.col("scan").cast("string"), F.lit("\nPEPMASS="), _number(F.coalesce("precursor_mz", F.lit(0.0)), 5), charge, rt, peaks, F.lit("\nEND IONS")))
    _write_lines(spectra.sparkSession, [], body, [], path, overwrite)


def write_fasta(proteins: DataFrame, path: str, overwrite: bool = False) -> None:
    text = F.concat(F.lit(">"), F.col("protein_id"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" "), F.col("description"))).otherwise(""), F.lit("\n"), F.col("residues"))
    _write_lines(proteins.sparkSession, [], proteins.select(text), [], path, overwrite)


def wide_intensities(peptides: DataFrame, files: list[str], keys: list[str]) -> DataFrame:
    """One row per key with ``Intensity_<file>`` and ``Detection Type_<file>``; the files of a study are named by the caller."""
    wide = peptides.groupBy(*keys).agg(
        *(F.coalesce(F.max(F.when(F.col("file") == f, F.col("intensity"))), F.lit(0.0)).alias(f"Intensity_{f}") for f in files),
        *(F.coalesce(F.max(F.when(F.col("file") == f, F.col("detection"))), F.lit("NotDetected")).alias(f"Detection Type_{f}") for f in files),
    )
    return wide


WRITERS = {"tsv": write_table, "txt": write_table, "sqt": write_sqt, "pepxml": write_pepxml, "mzid": write_mzid, "mztab": write_mztab, "pin": lambda d, p, overwrite=False: write_pin(pin_features(d), p, overwrite), "parquet": lambda d, p, overwrite=False: d.write.mode(_mode(overwrite)).parquet(p)}


def convert(spark: SparkSession, source: str, target: str, out_format: str, in_format: str = "auto", overwrite: bool = False) -> None:
    """Read matches of one format and write them as another; feature tables can be written but not read."""
    from massloom.sources.psms import read_psms

    if out_format not in WRITERS:
        raise ValueError(f"no writer for {out_format!r}; known: {', '.join(sorted(WRITERS))}")
    if in_format in ("pin", "html") or (in_format == "auto" and source.endswith((".pin", ".html"))):
        raise ValueError("this format cannot be converted from")
    rows = read_psms(spark, source, in_format)
    if "xcorr rank" not in rows.columns:
        rows = rows.withColumn("xcorr rank", F.col("rank") if "rank" in rows.columns else F.lit(1))
    if "protein id" not in rows.columns:
        rows = rows.withColumn("protein id", F.lit(""))
    WRITERS[out_format](rows, target, overwrite=overwrite)
