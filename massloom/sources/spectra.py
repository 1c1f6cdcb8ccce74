"""Spectrum readers: MS2, CMS-style text, MGF, mzML and mzXML, each to one schema.

Text formats are split into records by Spark's text source (``lineSep`` at the record mark), so a large file
is read in parallel, and parsed by column expressions. XML formats use Spark's XML source with a
schema of the elements needed; only their base64 arrays go through numpy.

Every reader returns: file, scan, ms_level, precursor_mz, rt (seconds), zstates (charge, mh), iso_lo,
iso_hi, mz[], intensity[] (by growing m/z).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions.sequence import PROTON

COLUMNS = ["file", "scan", "ms_level", "precursor_mz", "rt", "zstates", "iso_lo", "iso_hi", "mz", "intensity"]
_ZSTATE = "array<struct<charge:int,mh:double>>"


def _records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    rows = spark.read.option("lineSep", sep).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.select("file", F.filter(F.split("value", r"\r?\n"), lambda x: x != "").alias("lines"))


def _peaks(lines: Column) -> tuple[Column, Column]:
    pairs = F.transform(F.filter(lines, lambda x: x.rlike(r"^[0-9.]+[ \t]+[0-9.eE+-]+")), lambda x: F.split(x, r"[ \t]+"))
    both = F.array_sort(F.transform(pairs, lambda p: F.struct(p[0].try_cast("double").alias("mz"), p[1].try_cast("double").alias("i"))))
    return F.transform(both, lambda b: b["mz"]), F.transform(both, lambda b: b["i"])


def read_ms2(spark: SparkSession, path: str, ms_level: int = 2) -> DataFrame:
    """MS1/MS2 text: S, I and Z lines, then peaks. ``RTime`` is in minutes there.

    A scan without a Z line has no charge states; header lines and D lines are skipped.
    """
    rows = _records(spark, path, "\nS\t").where("size(lines) > 0")
    first = F.regexp_replace(F.col("lines")[0], r"^S\t", "")
    rows = rows.withColumn("head", F.split(F.trim(first), r"[ \t]+")).where(F.try_element_at("head", F.lit(1)).rlike(r"^\d+$"))
    mz, intensity = _peaks(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))))
    z = F.transform(F.filter("lines", lambda x: F.startswith(x, F.lit("Z\t"))), lambda x: F.split(x, r"[ \t]+"))
    rt = F.try_element_at(F.filter("lines", lambda x: x.rlike(r"^I\s+(RTime|RetTime)\s")), F.lit(1))
    return rows.select(
        "file",
        F.col("head")[0].try_cast("int").alias("scan"),
        F.lit(ms_level).alias("ms_level"),
        F.try_element_at("head", F.lit(3)).try_cast("double").alias("precursor_mz"),
        (F.regexp_extract(rt, r"^I\s+\w+\s+([0-9.]+)", 1).try_cast("double") * 60).alias("rt"),
        F.transform(z, lambda p: F.struct(p[1].try_cast("int").alias("charge"), p[2].try_cast("double").alias("mh"))).alias("zstates"),
        F.lit(None).cast("double").alias("iso_lo"),
        F.lit(None).cast("double").alias("iso_hi"),
        mz.alias("mz"),
        intensity.alias("intensity"),
    )


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """MGF text; the scan is taken from SCANS, else from a title like ``name.first.last.charge``, else null."""
    rows = _records(spark, path, "BEGIN IONS")

    def value(name: str) -> Column:
        line = F.try_element_at(F.filter("lines", lambda x: F.startswith(F.upper(x), F.lit(f"{name}="))), F.lit(1))
        return F.substring(line, F.lit(len(name) + 2), F.length(line))

    rows = rows.where(F.exists("lines", lambda x: F.startswith(F.upper(x), F.lit("PEPMASS="))))
    precursor = F.split(F.trim(value("PEPMASS")), r"[ \t]+")[0].try_cast("double")
    scan = F.coalesce(F.regexp_extract(value("SCANS"), r"^(\d+)", 1).try_cast("int"), F.regexp_extract(value("TITLE"), r"scan[= ](\d+)", 1).try_cast("int"), F.regexp_extract(value("TITLE"), r"\.(\d+)\.\d+\.\d+(?:\.|$)", 1).try_cast("int"))
    charges = F.transform(F.regexp_extract_all(F.coalesce(value("CHARGE"), F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda c: c.try_cast("int"))
    mz, intensity = _peaks(F.filter("lines", lambda x: ~x.contains("=")))
    return rows.select(
        "file",
        scan.alias("scan"),
        F.lit(2).alias("ms_level"),
        precursor.alias("precursor_mz"),
        value("RTINSECONDS").try_cast("double").alias("rt"),
        F.transform(charges, lambda c: F.struct(c.alias("charge"), (precursor * c - (c - 1) * PROTON).alias("mh"))).alias("zstates"),
        F.lit(None).cast("double").alias("iso_lo"),
        F.lit(None).cast("double").alias("iso_hi"),
        mz.alias("mz"),
        intensity.alias("intensity"),
    )


def _sorted(mz: np.ndarray, intensity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(mz) > 1 and (np.diff(mz) < 0).any():
        order = np.argsort(mz, kind="stable")
        return mz[order], intensity[order]
    return mz, intensity


def _unpack(df: DataFrame, unpack) -> DataFrame:
    """Replace the packed columns a, a_kind, b, b_kind by mz[] and intensity[]."""
    rest = [c for c in df.columns if c not in ("a", "a_kind", "b", "b_kind")]

    def run(batches):
        for batch in batches:
            col = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            rows = [_sorted(*unpack(*r)) for r in zip(*(col[n].to_pylist() for n in ("a", "a_kind", "b", "b_kind")), strict=True)]
            made = [pa.array([r[k] for r in rows], pa.list_(pa.float64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(col[c] for c in rest), *made], names=[*rest, "mz", "intensity"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.mapInArrow(run, f"{fields}, mz array<double>, intensity array<double>").select(*COLUMNS)


_MZXML_SCAN = (
    "_num int, _msLevel int, _retentionTime string, "
    "precursorMz array<struct<_VALUE:double,_precursorCharge:int,_windowWideness:double>>, "
    "peaks array<struct<_VALUE:string,_precision:int,_compressionType:string>>"
)


def read_mzxml(spark: SparkSession, path: str) -> DataFrame:
    """mzXML; scans may be nested one deep. Peak arrays are big-endian pairs, plain or zlib."""
    nested = ", ".join(p.replace(" ", ":", 1) for p in _MZXML_SCAN.split(", "))
    rows = spark.read.format("xml").option("rowTag", "scan").schema(f"{_MZXML_SCAN}, scan array<struct<{nested}>>").load(path)
    names = ["_num", "_msLevel", "_retentionTime", "precursorMz", "peaks"]
    outer = F.struct(*(F.col(n) for n in names))
    inner = F.coalesce(F.transform("scan", lambda s: F.struct(*(s[n].alias(n) for n in names))), F.array().cast(f"array<struct<{nested}>>"))
    flat = rows.select(F.col("_metadata.file_path").alias("file"), F.explode(F.concat(F.array(outer), inner)).alias("s")).select("file", "s.*")
    p = F.try_element_at("precursorMz", F.lit(1))
    peaks = F.try_element_at("peaks", F.lit(1))
    time = F.regexp_extract("_retentionTime", r"PT([0-9.]+)S", 1).try_cast("double")
    charge, mz = p["_precursorCharge"], p["_VALUE"]
    states = F.when(charge.isNotNull(), F.array(F.struct(charge.alias("charge"), (mz * charge - (charge - 1) * PROTON).alias("mh")))).otherwise(F.array().cast(_ZSTATE))
    packed = flat.select(
        "file", F.col("_num").alias("scan"), F.col("_msLevel").alias("ms_level"), mz.alias("precursor_mz"), time.alias("rt"), states.alias("zstates"),
        (mz - p["_windowWideness"] / 2).alias("iso_lo"), (mz + p["_windowWideness"] / 2).alias("iso_hi"),
        F.unbase64(F.regexp_replace(peaks["_VALUE"], r"\s+", "")).alias("a"), F.concat_ws(" ", F.coalesce(peaks["_precision"], F.lit(32)).cast("string"), peaks["_compressionType"]).alias("a_kind"),
        F.lit(None).cast("binary").alias("b"), F.lit(None).cast("string").alias("b_kind"),
    )

    def unpack(a, kind, b, b_kind):
        raw = zlib.decompress(a) if a and "zlib" in kind else a or b""
        both = np.frombuffer(raw, dtype=">f8" if kind.startswith("64") else ">f4").astype(np.float64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    return _unpack(packed, unpack)


_CV = "array<struct<_accession:string,_value:string,_unitName:string>>"
#: Controlled-vocabulary accessions that the reader needs.
MS_LEVEL, START_TIME, SELECTED_MZ, CHARGE_STATE = "MS:1000511", "MS:1000016", "MS:1000744", "MS:1000041"
TARGET_MZ, LOWER_OFFSET, UPPER_OFFSET = "MS:1000827", "MS:1000828", "MS:1000829"
FLOAT_64, ZLIB, MZ_ARRAY, INTENSITY_ARRAY = "MS:1000523", "MS:1000574", "MS:1000514", "MS:1000515"


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """mzML; little-endian arrays, plain or zlib. The scan is taken from the native id, else the index + 1."""
    schema = (
        f"_id string, _index int, cvParam {_CV}, scanList struct<scan:array<struct<cvParam:{_CV}>>>, "
        f"precursorList struct<precursor:array<struct<isolationWindow:struct<cvParam:{_CV}>,selectedIonList:struct<selectedIon:array<struct<cvParam:{_CV}>>>>>>, "
        f"binaryDataArrayList struct<binaryDataArray:array<struct<cvParam:{_CV},binary:string>>>"
    )
    rows = spark.read.format("xml").option("rowTag", "spectrum").schema(schema).load(path)

    def find(params: Column, accession: str) -> Column:
        return F.try_element_at(F.filter(params, lambda p: p["_accession"] == accession), F.lit(1))

    ion = F.try_element_at(F.try_element_at(F.col("precursorList.precursor"), F.lit(1))["selectedIonList"]["selectedIon"], F.lit(1))["cvParam"]
    window = F.try_element_at(F.col("precursorList.precursor"), F.lit(1))["isolationWindow"]["cvParam"]
    start = find(F.try_element_at(F.col("scanList.scan"), F.lit(1))["cvParam"], START_TIME)
    mz = find(ion, SELECTED_MZ)["_value"].try_cast("double")
    charge = find(ion, CHARGE_STATE)["_value"].try_cast("int")
    centre = find(window, TARGET_MZ)["_value"].try_cast("double")
    arrays = F.col("binaryDataArrayList.binaryDataArray")

    def packed(accession: str) -> tuple[Column, Column]:
        one = F.try_element_at(F.filter(arrays, lambda x: F.exists(x["cvParam"], lambda p: p["_accession"] == accession)), F.lit(1))
        kind = F.concat_ws(" ", F.transform(one["cvParam"], lambda p: p["_accession"]))
        return F.unbase64(F.regexp_replace(one["binary"], r"\s+", "")), kind

    (a, a_kind), (b, b_kind) = packed(MZ_ARRAY), packed(INTENSITY_ARRAY)
    states = F.when(charge.isNotNull(), F.array(F.struct(charge.alias("charge"), (mz * charge - (charge - 1) * PROTON).alias("mh")))).otherwise(F.array().cast(_ZSTATE))
    flat = rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.coalesce(F.regexp_extract("_id", r"scan=(\d+)", 1).try_cast("int"), F.col("_index") + 1).alias("scan"),
        find(F.col("cvParam"), MS_LEVEL)["_value"].try_cast("int").alias("ms_level"),
        mz.alias("precursor_mz"),
        (start["_value"].try_cast("double") * F.when(start["_unitName"] == "minute", 60.0).otherwise(1.0)).alias("rt"),
        states.alias("zstates"),
        (centre - find(window, LOWER_OFFSET)["_value"].try_cast("double")).alias("iso_lo"),
        (centre + find(window, UPPER_OFFSET)["_value"].try_cast("double")).alias("iso_hi"),
        a.alias("a"), a_kind.alias("a_kind"), b.alias("b"), b_kind.alias("b_kind"),
    )

    def unpack(a, a_kind, b, b_kind):
        def one(raw, kind):
            raw = raw or b""
            raw = zlib.decompress(raw) if raw and kind and ZLIB in kind else raw
            return np.frombuffer(raw, dtype="<f8" if kind and FLOAT_64 in kind else "<f4").astype(np.float64)

        return one(a, a_kind), one(b, b_kind)

    return _unpack(flat, unpack)


READERS = {"ms2": read_ms2, "ms1": lambda s, p: read_ms2(s, p, 1), "cms2": read_ms2, "mgf": read_mgf, "mzxml": read_mzxml, "mzml": read_mzml, "parquet": lambda s, p: s.read.parquet(p)}


def read_spectra(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Spectra of one file or folder; the format is taken from the extension (``.gz`` aside) unless named."""
    kind = fmt or path.lower().removesuffix("/").removesuffix(".gz").rpartition(".")[2]
    if kind not in READERS:
        raise ValueError(f"no spectrum reader for {kind!r}; known: {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path)


def spectrum_charges(spectra: DataFrame, charges: tuple[int, int] = (1, 5)) -> DataFrame:
    """One row for each spectrum and charge state, with ``charge`` and ``neutral_mass``.

    A spectrum without charge states is given every charge of the range.
    """
    given = F.filter("zstates", lambda z: z["charge"].between(*charges))
    guessed = F.transform(F.sequence(F.lit(charges[0]), F.lit(charges[1])), lambda c: F.struct(c.alias("charge"), (F.col("precursor_mz") * c - (c - 1) * PROTON).alias("mh")))
    states = F.when(F.coalesce(F.size("zstates"), F.lit(0)) > 0, given).otherwise(guessed)
    rows = spectra.withColumn("__z", F.explode(states))
    return rows.select("*", F.col("__z.charge").alias("charge"), (F.col("__z.mh") - PROTON).alias("neutral_mass")).drop("__z", "zstates")


def filter_spectra(spectra: DataFrame, min_mz: float = 0.0, max_mz: float = 1e9, scans: str = "", min_peaks: int = 20) -> DataFrame:
    """Spectra by precursor m/z, scan range (``""``, ``n`` or ``a-b``, inclusive) and number of peaks."""
    lo, hi = scan_range(scans)
    return spectra.where(F.col("precursor_mz").between(min_mz, max_mz) & F.col("scan").between(lo, hi) & (F.size("mz") >= min_peaks))


def scan_range(text: str) -> tuple[int, int]:
    if not text:
        return 0, (1 << 31) - 1
    first, dash, last = text.partition("-")
    lo = int(first)
    hi = int(last) if dash else lo
    if hi < lo:
        raise ValueError(f"scan range {text!r} ends before it begins")
    return lo, hi


def spectrum_stats(spectra: DataFrame) -> DataFrame:
    """(file, scan, n_peaks, tic, base_mz, base_intensity, min_mz, max_mz)."""
    base = F.array_max(F.zip_with("intensity", "mz", lambda i, m: F.struct(i.alias("i"), m.alias("m"))))
    return spectra.select(
        "file", "scan", F.size("mz").alias("n_peaks"), F.aggregate("intensity", F.lit(0.0), lambda s, x: s + x).alias("tic"),
        base["m"].alias("base_mz"), base["i"].alias("base_intensity"), F.array_min("mz").alias("min_mz"), F.array_max("mz").alias("max_mz"),
    )


def write_records(spectra: DataFrame, path: str, charges: tuple[int, int] = (1, 5), mode: str = "errorifexists") -> None:
    """One Parquet row per spectrum and charge, ordered by neutral mass, values to four decimals."""
    rows = spectrum_charges(spectra, charges)
    rows = rows.withColumn("mz", F.transform("mz", lambda x: F.round(x, 4))).withColumn("intensity", F.transform("intensity", lambda x: F.round(x, 4)))
    rows.repartitionByRange("neutral_mass").sortWithinPartitions("neutral_mass").write.mode(mode).parquet(path)


def truncate_peaks(spectra: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` most intense peaks of each spectrum, by growing m/z again."""
    best = F.slice(F.reverse(F.array_sort(F.zip_with("intensity", "mz", lambda i, m: F.struct(i.alias("i"), m.alias("m"))))), 1, keep)
    back = F.array_sort(F.transform(best, lambda b: F.struct(b["m"].alias("m"), b["i"].alias("i"))))
    return spectra.withColumn("__p", back).withColumn("mz", F.transform("__p", lambda p: p["m"])).withColumn("intensity", F.transform("__p", lambda p: p["i"])).drop("__p")


def deisotope(spectra: DataFrame, ppm: float, max_charge: int = 3) -> DataFrame:
    """Drop a peak if one an isotope step below it, at any charge under ``max_charge``, is at least as intense."""
    step = 1.00335483
    peaks = F.zip_with("mz", "intensity", lambda m, i: F.struct(m.alias("m"), i.alias("i")))
    charges = range(1, max(2, max_charge))

    def shadowed(p: Column) -> Column:
        return F.exists("__p", lambda q: (q["i"] > p["i"]) & F.greatest(*(F.abs(p["m"] - step / z - q["m"]) <= p["m"] * ppm / 1e6 for z in charges), F.lit(False)))

    rows = spectra.withColumn("__p", peaks).withColumn("__p", F.filter("__p", lambda p: ~shadowed(p)))
    return rows.withColumn("mz", F.transform("__p", lambda p: p["m"])).withColumn("intensity", F.transform("__p", lambda p: p["i"])).drop("__p")


def top_per_region(spectra: DataFrame, regions: int = 10, keep: int = 20) -> DataFrame:
    """The ``keep`` most intense peaks of each of ``regions`` equal stretches of a spectrum's m/z range, by growing m/z again; of equal peaks the one of larger m/z."""
    lo, hi = F.array_min("mz"), F.array_max("mz")
    width = F.greatest((hi - lo) / regions, F.lit(1e-12))
    peaks = F.zip_with("mz", "intensity", lambda m, i: F.struct(F.least(F.floor((m - lo) / width), F.lit(regions - 1)).cast("int").alias("r"), i.alias("i"), m.alias("m")))
    best = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(regions - 1)), lambda r: F.slice(F.reverse(F.array_sort(F.filter(peaks, lambda p: p["r"] == r))), 1, keep)))
    back = F.array_sort(F.transform(best, lambda p: F.struct(p["m"].alias("m"), p["i"].alias("i"))))
    rows = spectra.withColumn("__p", F.when(F.size("mz") > 0, back).otherwise(F.array().cast("array<struct<m:double,i:double>>")))
    return rows.withColumn("mz", F.transform("__p", lambda p: p["m"])).withColumn("intensity", F.transform("__p", lambda p: p["i"])).drop("__p")
