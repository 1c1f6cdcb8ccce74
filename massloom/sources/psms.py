"""Readers of proteins, peptide-spectrum matches and their side files.

Matches come as one row each with the columns of ``CATALOGUE`` that the file has, typed. ``protein id``
stays a comma list as in the files; ``protein_ids`` splits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions.sequence import PROTON, plain_sequence

#: The known columns of match tables by type.
CATALOGUE = {
    "int": [
        "file_idx", "scan", "charge", "sp rank", "xcorr rank", "res-ev rank", "combined p-value rank", "percolator rank", "distinct matches/peptide",
        "b/y ions matched", "b/y ions total", "b/y ion repeat match", "total matches/spectrum", "distinct matches/spectrum", "decoy matches/spectrum", "parsimony rank",
    ],
    "double": [
        "retention time", "spectrum precursor m/z", "spectrum neutral mass", "peptide mass", "delta_cn", "delta_lcn", "sp score", "xcorr score", "exact p-value",
        "refactored xcorr", "res-ev p-value", "res-ev score", "combined p-value", "Sidak adjusted p-value", "tailor score", "e-value", "smoothed p-value",
        "precursor intensity logrank M0", "precursor intensity logrank M1", "precursor intensity logrank M2", "rt-diff", "dynamic fragment p-value",
        "static fragment p-value", "precursor coelution", "fragment coelution", "precursor fragment coelution", "ensemble score", "decoy q-value (xcorr)",
        "decoy PEP (xcorr)", "decoy q-value (e-value)", "decoy PEP (e-value)", "percolator score", "percolator q-value", "percolator PEP", "tdc q-value",
        "mix-max q-value", "b/y ions fraction", "RAW", "SIN", "NSAF", "dNSAF", "EMPAI", "score", "q-value", "posterior_error_prob",
    ],
    "string": ["file", "sequence", "modifications", "cleavage type", "unmodified sequence", "protein id", "peptides", "flanking aa", "target/decoy", "original target sequence", "PSMId", "filename", "peptide", "proteinIds"],
}
_TYPE = {name: kind for kind, names in CATALOGUE.items() for name in names}
#: Rank columns in the order in which they are looked for.
RANKS = ("percolator rank", "combined p-value rank", "res-ev rank", "xcorr rank", "sp rank")


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """A delimited table with every column as text; an empty cell is null."""
    return spark.read.option("sep", sep).option("header", header).option("quote", "").option("mode", "PERMISSIVE").csv(path)


def read_psm_table(spark: SparkSession, path: str, top_match: int = 0) -> DataFrame:
    """A match table; known columns are cast, unknown ones stay text. NaN and unreadable numbers become null.

    With ``top_match`` only rows whose rank is at most that stay; the first rank column that the file has counts.
    """
    rows = read_delimited(spark, path)
    out = rows.select(*(_typed(c) for c in rows.columns))
    ranks = [r for r in RANKS if r in out.columns]
    if top_match and ranks:
        out = out.where(F.coalesce(*(F.col(f"`{r}`") for r in ranks)) <= top_match)
    return out


def _typed(name: str) -> Column:
    kind = _TYPE.get(name, "string")
    c = F.col(f"`{name}`")
    if kind == "string":
        return c
    value = c.try_cast(kind)
    return (F.when(~F.isnan(value), value) if kind == "double" else value).alias(name)


def protein_ids(column: Column) -> Column:
    """The ids of a protein list, without the positions in parentheses at their ends."""
    return F.transform(F.split(column, ","), lambda p: F.regexp_replace(F.trim(p), r"\(\d+\)$", ""))


def mark_decoys(psms: DataFrame, prefix: str = "decoy_", column: str = "protein id", out: str = "is_decoy") -> DataFrame:
    """A match is a decoy if the prefix stands anywhere in its protein ids."""
    return psms.withColumn(out, F.coalesce(F.col(f"`{column}`").contains(prefix), F.lit(False)))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(protein_id, description, residues); the id is the first word, one trailing ``*`` is cut off.

    A protein without residues has an empty sequence; gzip is read as it is.
    """
    rows = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = rows.select(F.split("value", r"\r?\n").alias("l")).where(F.col("l")[0] != "")
    residues = F.regexp_replace(F.regexp_replace(F.array_join(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), ""), r"\s", ""), r"\*$", "")
    return lines.select(
        F.regexp_extract(F.col("l")[0], r"^(\S*)", 1).alias("protein_id"),
        F.trim(F.regexp_extract(F.col("l")[0], r"^\S*\s+(.*)$", 1)).alias("description"),
        residues.alias("residues"),
    )


def read_sqt(spark: SparkSession, path: str, top_match: int = 0) -> DataFrame:
    """SQT: each S line opens a record with its M (match) and L (locus) lines."""
    rows = spark.read.option("lineSep", "\nS\t").text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("l"))
    head = F.split(F.regexp_replace(F.col("l")[0], r"^S\t", ""), "\t")
    rows = rows.withColumn("h", head).where(F.col("h")[0].rlike(r"^\d+$"))
    # matches with their own loci: the record cut before each M line
    body = F.split(F.array_join(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), "\n"), r"(?m)^(?=M\t)")
    found = rows.select("file", "h", F.explode(F.filter(body, lambda b: F.startswith(b, F.lit("M\t")))).alias("b"))
    m = F.split(F.split("b", "\n")[0], r"\s+")
    loci = F.transform(F.filter(F.split("b", "\n"), lambda x: F.startswith(x, F.lit("L\t"))), lambda x: F.split(x, "\t")[1])
    found = found.withColumn("m", m)
    peptide = F.col("m")[9]
    out = found.select(
        "file",
        F.col("h")[0].try_cast("int").alias("scan"),
        F.col("h")[2].try_cast("int").alias("charge"),
        (F.col("h")[5].try_cast("double") - PROTON).alias("spectrum neutral mass"),
        F.col("m")[1].try_cast("int").alias("xcorr rank"),
        F.col("m")[2].try_cast("int").alias("sp rank"),
        (F.col("m")[3].try_cast("double") - PROTON).alias("peptide mass"),
        F.col("m")[4].try_cast("double").alias("delta_cn"),
        F.col("m")[5].try_cast("double").alias("xcorr score"),
        F.col("m")[6].try_cast("double").alias("sp score"),
        F.col("m")[7].try_cast("int").alias("b/y ions matched"),
        F.col("m")[8].try_cast("int").alias("b/y ions total"),
        F.regexp_extract(peptide, r"^[A-Z\-*]\.(.*)\.[A-Z\-*]$", 1).alias("sequence"),
        F.concat(F.substring(peptide, 1, 1), F.substring(peptide, -1, 1)).alias("flanking aa"),
        F.array_join(loci, ",").alias("protein id"),
    )
    return out.where(F.col("xcorr rank") <= top_match) if top_match else out


def _in_lines(spark: SparkSession, path: str, tags: tuple[str, ...]) -> bool:
    """Whether no element of ``tags`` goes over the end of a line."""
    cut = F.lit(False)
    for tag in tags:
        last = F.substring_index("value", f"<{tag} ", -1)
        cut |= F.contains("value", F.lit(f"<{tag} ")) & ~(F.contains(last, F.lit(f"</{tag}>")) | last.rlike(r"^(?:[^>\"]|\"[^\"]*\")*/>")) | F.endswith("value", F.lit(f"<{tag}"))
    return spark.read.text(path).where(cut).isEmpty()


def _elements(spark: SparkSession, path: str, tag: str, schema: str, lines: bool = False) -> DataFrame:
    """(file, attributes and children) of every element ``tag``, which has attributes and holds no other of its kind.

    Text is split at the tag, so a large document is read in parallel and the parts of a distributed write need no root of their own. A long stretch without the tag makes one
    long record then; with ``lines``, for documents whose elements end in the line they begin in, no record is longer than a line.
    """
    if lines:
        rows = spark.read.text(path).where(F.contains("value", F.lit(f"<{tag} "))).select(F.col("_metadata.file_path").alias("file"), F.split("value", f"<{tag} ").alias("v"))
        rows = rows.select("file", F.explode(F.slice("v", 2, F.size("v") - 1)).alias("value"))
    else:
        rows = spark.read.option("lineSep", f"<{tag} ").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    alone = F.regexp_extract("value", r"^(?:[^>\"]|\"[^\"]*\")*/>", 0)
    whole = F.when(alone != "", alone).otherwise(F.concat(F.substring_index("value", f"</{tag}>", 1), F.lit(f"</{tag}>")))
    found = rows.where(F.contains("value", F.lit(f"</{tag}>")) | (alone != "")).select("file", F.from_xml(F.concat(F.lit(f"<{tag} "), whole), schema).alias("e"))
    return found.select("file", "e.*")


def read_pepxml(spark: SparkSession, path: str, top_match: int = 0) -> DataFrame:
    """pepXML search hits; scores that are not in the catalogue stay in the map ``custom scores``."""
    score = "array<struct<_name:string,_value:string>>"
    hit = (
        "struct<_hit_rank:int,_peptide:string,_peptide_prev_aa:string,_peptide_next_aa:string,_protein:string,_calc_neutral_pep_mass:double,_num_matched_ions:int,_tot_num_ions:int,"
        f"alternative_protein:array<struct<_protein:string>>,modification_info:struct<_modified_peptide:string,mod_aminoacid_mass:array<struct<_position:int,_mass:double>>>,search_score:{score}>"
    )
    rows = _elements(spark, path, "spectrum_query", f"_start_scan int, _assumed_charge int, _precursor_neutral_mass double, search_result array<struct<search_hit:array<{hit}>>>")
    hits = rows.select("file", "_start_scan", "_assumed_charge", "_precursor_neutral_mass", F.explode(F.flatten(F.transform("search_result", lambda r: r["search_hit"]))).alias("x"))
    scores = F.map_from_entries(F.transform("x.search_score", lambda s: F.struct(s["_name"], s["_value"].try_cast("double"))))
    hits = hits.withColumn("scores", scores)
    named = {"xcorr_score": "xcorr score", "delta_cn": "delta_cn", "sp_score": "sp score", "xcorr_rank": "xcorr rank", "sp_rank": "sp rank", "percolator_score": "percolator score", "percolator_qvalue": "percolator q-value", "tailor_score": "tailor score", "exact_pvalue": "exact p-value"}
    others = F.map_filter("scores", lambda k, v: ~k.isin(*named))
    out = hits.select(
        "file", F.col("_start_scan").alias("scan"), F.col("_assumed_charge").alias("charge"), F.col("_precursor_neutral_mass").alias("spectrum neutral mass"),
        F.col("x._hit_rank").alias("rank"), F.col("x._calc_neutral_pep_mass").alias("peptide mass"),
        F.coalesce("x.modification_info._modified_peptide", "x._peptide").alias("sequence"), F.col("x._peptide").alias("unmodified sequence"),
        F.concat_ws(",", F.array(F.col("x._protein")), F.transform("x.alternative_protein", lambda p: p["_protein"])).alias("protein id"),
        F.concat("x._peptide_prev_aa", "x._peptide_next_aa").alias("flanking aa"), F.col("x._num_matched_ions").alias("b/y ions matched"), F.col("x._tot_num_ions").alias("b/y ions total"),
        *(F.try_element_at("scores", F.lit(k)).cast("int" if v.endswith("rank") else "double").alias(v) for k, v in named.items()), others.alias("custom scores"),
    )
    return out.where(F.col("rank") <= top_match) if top_match else out


def read_mzid(spark: SparkSession, path: str, top_match: int = 0) -> DataFrame:
    """mzIdentML matches joined to their peptides and, through the evidences, to their proteins; the parts that one write left are one document."""
    cv = "array<struct<_accession:string,_name:string,_value:string>>"
    item = f"struct<_peptide_ref:string,_chargeState:int,_experimentalMassToCharge:double,_calculatedMassToCharge:double,_rank:int,PeptideEvidenceRef:array<struct<_peptideEvidence_ref:string>>,cvParam:{cv}>"

    lines = _in_lines(spark, path, ("SpectrumIdentificationResult", "Peptide", "PeptideEvidence", "DBSequence"))

    def tag(name: str, schema: str) -> DataFrame:
        return _elements(spark, path, name, schema, lines).withColumn("file", F.regexp_replace("file", r"/part-[^/]*$", ""))

    results = tag("SpectrumIdentificationResult", f"_spectrumID string, SpectrumIdentificationItem array<{item}>")
    peptides = tag("Peptide", "_id string, PeptideSequence string, Modification array<struct<_location:int,_monoisotopicMassDelta:double>>")
    evidence = tag("PeptideEvidence", "_id string, _dBSequence_ref string, _isDecoy boolean, _pre string, _post string")
    proteins = tag("DBSequence", "_id string, _accession string")
    items = results.select("file", "_spectrumID", F.explode("SpectrumIdentificationItem").alias("x")).withColumn("row", F.monotonically_increasing_id())
    refs = items.select("file", "row", F.explode("x.PeptideEvidenceRef").alias("e")).select("file", "row", F.col("e._peptideEvidence_ref").alias("_id"))
    owners = refs.join(evidence, ["file", "_id"]).drop("_id").join(proteins.withColumnRenamed("_id", "_dBSequence_ref"), ["file", "_dBSequence_ref"])
    owners = owners.groupBy("file", "row").agg(F.array_join(F.sort_array(F.collect_set("_accession")), ",").alias("protein id"), F.bool_and(F.coalesce("_isDecoy", F.lit(False))).alias("is_decoy"), F.min(F.concat("_pre", "_post")).alias("flanking aa"))
    named = items.join(peptides.select("file", F.col("_id").alias("ref"), F.col("PeptideSequence").alias("sequence"), "Modification"), (items["x._peptide_ref"] == F.col("ref")) & (items["file"] == peptides["file"]), "left").drop(peptides["file"])
    scores = F.map_from_entries(F.transform(F.filter("x.cvParam", lambda p: p["_value"].try_cast("double").isNotNull()), lambda p: F.struct(p["_name"], p["_value"].try_cast("double"))))
    out = named.join(owners, ["file", "row"], "left").withColumn("scores", scores)
    z, mz = F.col("x._chargeState"), F.col("x._experimentalMassToCharge")
    out = out.select(
        "file", F.coalesce(F.regexp_extract("_spectrumID", r"scan=(\d+)", 1).try_cast("int"), F.regexp_extract("_spectrumID", r"(\d+)", 1).try_cast("int")).alias("scan"), z.alias("charge"),
        mz.alias("spectrum precursor m/z"), ((mz - PROTON) * z).alias("spectrum neutral mass"), ((F.col("x._calculatedMassToCharge") - PROTON) * z).alias("peptide mass"),
        F.col("x._rank").alias("rank"), F.trim("sequence").alias("sequence"), "protein id", "flanking aa", F.coalesce("is_decoy", F.lit(False)).alias("is_decoy"),
        F.get(F.map_values(F.map_filter("scores", lambda k, v: F.lower(k).rlike("xcorr"))), F.lit(0)).alias("xcorr score"),
        F.col("scores").alias("custom scores"),
    )
    return out.where(F.col("rank") <= top_match) if top_match else out


def read_pin(spark: SparkSession, path: str) -> DataFrame:
    """A feature table; the proteins, which take all remaining cells, become one comma list."""
    lines = spark.read.text(path)
    head = lines.where(F.startswith("value", F.lit("SpecId\t"))).first()
    if head is None:
        raise ValueError(f"{path} has no header")
    names = head.value.split("\t")
    cells = lines.where(F.col("value") != head.value).select(F.split("value", "\t").alias("c"))
    text = {"SpecId", "Peptide", "Proteins", "filename"}
    last = len(names) - 1
    cols = [F.get("c", F.lit(k)).alias(n) if n in text else F.get("c", F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(names[:last])]
    return cells.select(*cols, F.array_join(F.slice("c", last + 1, F.greatest(F.size("c") - last, F.lit(1))), ",").alias(names[last]))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """MS1 feature file: each ``S`` line (scan, retention time) holds ``P`` lines of features."""
    rows = spark.read.option("lineSep", "\nS\t").text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("l"))
    head = F.split(F.regexp_replace(F.col("l")[0], r"^S\t", ""), r"\t")
    features = rows.select("file", head.alias("h"), F.explode(F.filter("l", lambda x: F.startswith(x, F.lit("P\t")))).alias("p")).withColumn("p", F.split("p", r"\t"))
    names = {1: ("mono_mass", "double"), 2: ("charge", "int"), 3: ("intensity", "double"), 4: ("base_peak", "double")}
    return features.select("file", F.col("h")[0].try_cast("int").alias("scan"), F.get("h", F.lit(1)).try_cast("double").alias("rt"), *(F.get("p", F.lit(k)).try_cast(t).alias(n) for k, (n, t) in names.items()))


def read_lfq_psms(spark: SparkSession, path: str, q_limit: float = 0.01, filtered: bool = False, rt_seconds: bool = False) -> DataFrame:
    """Identifications for quantification from a match table: (file, scan, charge, rt in minutes, sequence, mod_sequence, mass, protein_id)."""
    rows = read_psm_table(spark, path)
    if not filtered and "tdc q-value" in rows.columns:
        rows = rows.where(F.col("tdc q-value") <= q_limit)
    rt = F.col("retention time") / (60.0 if rt_seconds else 1.0)
    return rows.select(
        F.regexp_replace(F.regexp_replace("file", r"^.*/", ""), r"\.[^.]*$", "").alias("file") if "file" in rows.columns else F.lit("").alias("file"),
        "scan", "charge", rt.alias("rt"), F.col("unmodified sequence").alias("sequence"), F.col("sequence").alias("mod_sequence"),
        F.col("`spectrum precursor m/z`").alias("precursor_mz"), F.col("peptide mass").alias("mass"), F.col("protein id").alias("protein_id"),
    )


def read_percolator_psms(spark: SparkSession, path: str, q_limit: float = 0.01) -> DataFrame:
    """Identifications from a table keyed by ids like ``target_0_<scan>_<charge>_<rank>``; every data line counts."""
    rows = read_psm_table(spark, path).where(F.col("q-value") <= q_limit)
    parts = F.split("PSMId", "_")
    n = F.size(parts)
    return rows.select(
        F.regexp_replace(F.col("filename"), r"\.[^.]*$", "").alias("file"), F.element_at(parts, n - 2).try_cast("int").alias("scan"), F.element_at(parts, n - 1).try_cast("int").alias("charge"),
        plain_sequence(F.col("peptide")).alias("sequence"), F.regexp_replace("peptide", r"^[A-Z\-*]\.(.*)\.[A-Z\-*]$", "$1").alias("mod_sequence"), F.col("proteinIds").alias("protein_id"), F.col("q-value"),
    )


def read_design(spark: SparkSession, path: str) -> DataFrame:
    """(file stem, condition, biorep, fraction, techrep); a header line is optional."""
    rows = read_delimited(spark, path, header=False)
    cells = [F.col(c) for c in rows.columns[:5]]
    named = rows.select(*(c.alias(n) for c, n in zip(cells, ("file", "condition", "biorep", "fraction", "techrep"), strict=True)))
    numbers = [F.col(n).try_cast("int").alias(n) for n in ("biorep", "fraction", "techrep")]
    return named.select(F.regexp_replace(F.regexp_replace("file", r"^.*/", ""), r"\.[^.]*$", "").alias("file"), "condition", *numbers).where(F.col("biorep").isNotNull())


def read_predicted_rt(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, predicted_rt)"""
    rows = read_delimited(spark, path, header=False)
    return rows.select(F.col(rows.columns[0]).alias("sequence"), F.col(rows.columns[1]).try_cast("double").alias("predicted_rt")).where(F.col("predicted_rt").isNotNull())


def read_parameters(spark: SparkSession, path: str) -> dict[str, str]:
    """Options of a file of ``name=value`` lines; ``#`` begins a comment. A file of options is small by nature."""
    rows = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"#.*$", "")).alias("v")).where(F.col("v").contains("="))
    return {k.strip(): v.strip() for k, _, v in (r.v.partition("=") for r in rows.collect())}


READERS = {"sqt": read_sqt, "xml": read_pepxml, "pepxml": read_pepxml, "mzid": read_mzid, "tsv": read_psm_table, "txt": read_psm_table, "parquet": lambda s, p, top_match=0: s.read.parquet(p)}


def read_psms(spark: SparkSession, path: str, fmt: str = "auto", top_match: int = 0) -> DataFrame:
    """Matches of any format; ``auto`` goes by the extension, and a table is what is left."""
    kind = path.lower().removesuffix(".gz").rpartition(".")[2] if fmt == "auto" else fmt
    return READERS.get(kind, read_psm_table)(spark, path, top_match=top_match)


def expand_inputs(spark: SparkSession, path: str, list_of_files: bool = False) -> list[str]:
    """The inputs that a path stands for: those of a list of files (one to a line, ``#`` begins a comment, relative ones beside the list), or itself."""
    if not list_of_files:
        return [path]
    lines = [r.v for r in spark.read.text(path, wholetext=False).select(F.trim(F.regexp_replace("value", r"#.*$", "")).alias("v")).where("v <> ''").collect()]
    if not lines:
        raise ValueError(f"{path} lists no files")
    beside = path.rpartition("/")[0]
    return [x if x.startswith("/") or "://" in x or not beside else f"{beside}/{x}" for x in lines]


def read_psm_lists(spark: SparkSession, path: str, fmt: str = "auto", top_match: int = 0) -> DataFrame:
    """Matches of all files that a list names, one table; columns that some lack are null there."""
    tables = [read_psms(spark, x, fmt, top_match) for x in expand_inputs(spark, path, list_of_files=True)]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
