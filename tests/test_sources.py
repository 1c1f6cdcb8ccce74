"""Readers and writers on small files and on round trips."""

from __future__ import annotations

import base64
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from massloom.functions.sequence import PROTON
from massloom.sources import psms, sinks, spectra

MS2 = "H\tExtractor\tx\nS\t000002\t000002\t576.54\nI\tRTime\t.5\nZ\t2\t1152.07\nZ\t3\t1727.60\n217.2 13.7\n200.0 2.4\nS\t3\t3\t400.0\nD\tx\ty\n100 1\n"
MGF = "COM=x\nBEGIN IONS\nTITLE=run.10.10.3.dta\nPEPMASS=464.27 100\nCHARGE=3+\n135.2 9.2\n134.0 1\nEND IONS\nBEGIN IONS\nTITLE=y\nSCANS=7\nPEPMASS=300\nRTINSECONDS=12.5\nEND IONS\n"


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_ms2(spark, tmp_path):
    got = spectra.read_spectra(spark, put(tmp_path, "a.ms2", MS2)).orderBy("scan").collect()
    assert [(r.scan, r.precursor_mz, r.rt) for r in got] == [(2, 576.54, 30.0), (3, 400.0, None)]
    assert got[0].mz == [200.0, 217.2] and got[0].intensity == [2.4, 13.7] and [tuple(z) for z in got[0].zstates] == [(2, 1152.07), (3, 1727.6)]
    assert got[1].zstates == []


def test_mgf(spark, tmp_path):
    got = {r.scan: r for r in spectra.read_spectra(spark, put(tmp_path, "a.mgf", MGF)).collect()}
    assert set(got) == {10, 7} and got[10].zstates[0].charge == 3 and got[10].mz == [134.0, 135.2] and got[7].rt == 12.5 and got[7].mz == []
    assert abs(got[10].zstates[0].mh - (464.27 * 3 - 2 * PROTON)) < 1e-9


def test_mzxml_and_mzml(spark, tmp_path):
    pairs = base64.b64encode(struct.pack(">4f", 100.5, 1, 99.5, 2)).decode()
    x = f'<mzXML><msRun><scan num="1" msLevel="1" retentionTime="PT3.5S"><peaks precision="32">{pairs}</peaks><scan num="2" msLevel="2" retentionTime="PT4S"><precursorMz precursorCharge="2" windowWideness="4">500.5</precursorMz><peaks precision="32" compressionType="zlib">{base64.b64encode(zlib.compress(struct.pack(">2f", 50, 5))).decode()}</peaks></scan></scan></msRun></mzXML>'
    got = spectra.read_spectra(spark, put(tmp_path, "a.mzXML", x)).orderBy("scan").collect()
    assert [(r.scan, r.ms_level, r.rt) for r in got] == [(1, 1, 3.5), (2, 2, 4.0)] and got[0].mz == [99.5, 100.5] and (got[1].iso_lo, got[1].iso_hi) == (498.5, 502.5) and got[1].mz == [50.0]
    cv = lambda a, v="": f'<cvParam accession="{a}" value="{v}" unitName="minute"/>'
    a = base64.b64encode(zlib.compress(struct.pack("<2d", 10, 20))).decode()
    b = base64.b64encode(struct.pack("<2f", 1, 2)).decode()
    m = (
        f'<mzML><spectrum index="0" id="controllerType=0 scan=9">{cv("MS:1000511", 2)}<scanList><scan>{cv("MS:1000016", 2)}</scan></scanList><precursorList><precursor><isolationWindow>{cv("MS:1000827", 500)}{cv("MS:1000828", 1)}{cv("MS:1000829", 2)}</isolationWindow>'
        f'<selectedIonList><selectedIon>{cv("MS:1000744", 500.2)}{cv("MS:1000041", 2)}</selectedIon></selectedIonList></precursor></precursorList><binaryDataArrayList><binaryDataArray>{cv("MS:1000523")}{cv("MS:1000574")}{cv("MS:1000514")}<binary>{a}</binary></binaryDataArray>'
        f'<binaryDataArray>{cv("MS:1000521")}{cv("MS:1000515")}<binary>{b}</binary></binaryDataArray></binaryDataArrayList></spectrum></mzML>'
    )
    r = spectra.read_spectra(spark, put(tmp_path, "a.mzML", m)).first()
    assert (r.scan, r.ms_level, r.rt, r.precursor_mz, r.iso_lo, r.iso_hi, r.mz, r.intensity, r.zstates[0].charge) == (9, 2, 120.0, 500.2, 499.0, 502.0, [10.0, 20.0], [1.0, 2.0], 2)
    with pytest.raises(ValueError):
        spectra.read_spectra(spark, "a.raw")


def test_spectrum_operators(spark, tmp_path):
    rows = spectra.read_spectra(spark, put(tmp_path, "a.ms2", MS2))
    assert sorted((r.scan, r.charge) for r in spectra.spectrum_charges(rows, (1, 3)).collect()) == [(2, 2), (2, 3), (3, 1), (3, 2), (3, 3)]
    assert [r.scan for r in spectra.filter_spectra(rows, scans="3-9", min_peaks=1).collect()] == [3]
    assert spectra.truncate_peaks(rows, 1).where("scan = 2").first().mz == [217.2]
    s = spectra.spectrum_stats(rows).where("scan = 2").first()
    assert (s.n_peaks, s.base_mz, s.min_mz) == (2, 217.2, 200.0)
    iso = spark.createDataFrame([([100.0, 101.00335], [5.0, 1.0])], "mz array<double>, intensity array<double>")
    assert spectra.deisotope(iso, 20).first().mz == [100.0]
    with pytest.raises(ValueError):
        spectra.scan_range("5-2")


def test_spectra_round_trip(spark, tmp_path):
    rows = spectra.read_spectra(spark, put(tmp_path, "a.ms2", MS2))
    for name, write in (("b.ms2", sinks.write_ms2), ("b.mgf", sinks.write_mgf)):
        write(rows, str(tmp_path / name))
        back = {r.scan: r for r in spectra.read_spectra(spark, str(tmp_path / name)).collect()}
        assert set(back) == {2, 3} and back[2].mz == [200.0, 217.2] and abs(back[2].rt - 30) < 1e-3 and [z.charge for z in back[2].zstates] == [2, 3]
    spectra.write_records(rows, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 7


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fasta", ">p1 first one\nMKV\nLL*\n>p2\n>p3 x\nAAA\n")
    got = [tuple(r) for r in psms.read_fasta(spark, p).collect()]
    assert got == [("p1", "first one", "MKVLL"), ("p2", "", ""), ("p3", "x", "AAA")]
    sinks.write_fasta(psms.read_fasta(spark, p), str(tmp_path / "b.fasta"))
    assert sorted(r.protein_id for r in psms.read_fasta(spark, str(tmp_path / "b.fasta")).collect()) == ["p1", "p2", "p3"]


TABLE = "scan\tcharge\tspectrum precursor m/z\tspectrum neutral mass\tpeptide mass\tdelta_cn\txcorr score\txcorr rank\tdistinct matches/spectrum\tsequence\tprotein id\tflanking aa\n10\t2\t636.34\t1270.66\t1272.32\t0.12\t0.71\t1\t79\tEHIEC[57.02]EK\tYKL127W(441),decoy_B(2)\tKV\n10\t2\t636.34\t1270.66\t1272.4\tnan\t0.5\t2\t79\tKPEEK\tP\t-A\n11\t3\t400\t1197.0\t1197.1\t0\t0.2\t1\t5\tAAKAR\tQ\tRP\n"


def test_psm_table(spark, tmp_path):
    rows = psms.read_psms(spark, put(tmp_path, "a.txt", TABLE))
    got = rows.orderBy("scan", "xcorr rank").collect()
    assert got[1]["delta_cn"] is None and got[0]["charge"] == 2 and psms.read_psm_table(spark, str(tmp_path / "a.txt"), top_match=1).count() == 2
    marked = psms.mark_decoys(rows).where("is_decoy").select(psms.protein_ids(F.col("protein id")).alias("p")).collect()
    assert [r.p for r in marked] == [["YKL127W", "decoy_B"]]


@pytest.mark.parametrize("fmt", ["sqt", "pepxml", "mzid", "tsv"])
def test_conversions_keep_matches(spark, tmp_path, fmt):
    src = put(tmp_path, "a.txt", TABLE)
    sinks.convert(spark, src, str(tmp_path / f"b.{fmt}"), fmt)
    parts = sorted((tmp_path / f"b.{fmt}").glob("part-*"))
    one = str(tmp_path / f"b.{fmt}")
    if fmt in ("pepxml", "mzid"):  # one document
        one = put(tmp_path, f"one.{fmt}", "".join(p.read_text() for p in parts))
    back = psms.read_psms(spark, one, fmt)
    rank = "rank" if "rank" in back.columns else "xcorr rank"
    got = sorted((r.scan, r.charge, r[rank], round(r["peptide mass"], 3), r["xcorr score"], r["protein id"]) for r in back.collect())
    want = sorted((r.scan, r.charge, r["xcorr rank"], r["peptide mass"], r["xcorr score"], r["protein id"]) for r in psms.read_psms(spark, src).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [set(g[5].split(",")) for g in got] == [set(w[5].split(",")) for w in want]


def test_pin(spark, tmp_path):
    rows = psms.read_psms(spark, put(tmp_path, "a.txt", TABLE)).withColumn("is_decoy", F.col("scan") == 11).withColumn("exact p-value", F.lit(0.0))
    got = {r.SpecId: r for r in sinks.make_pin([rows.where("scan = 10"), rows.where("scan = 11").drop("delta_cn")]).collect()}
    a, b = got["target_0_10_2_2"], got["decoy_0_11_3_1"]
    assert (a.Label, a.enzN, a.enzC, a.enzInt, a.Charge2, a.PepLen) == (1, 1, 1, 0, 1, 5) and (b.Label, b.enzN, b.enzC, b.enzInt) == (-1, 1, 0, 1)
    assert a.NegLog10PValue == 100.0 and got["target_0_10_2_1"].PepLen == 7
    sinks.write_pin(sinks.make_pin([rows]), str(tmp_path / "x.pin"))
    back = psms.read_pin(spark, str(tmp_path / "x.pin"))
    assert back.count() == 3 and back.where("Proteins like '%,decoy_B%'").count() == 1
    with pytest.raises(ValueError):
        sinks.concat_pins([back, back.drop("Sp", "PepLen")])
    with pytest.raises(ValueError):
        sinks.convert(spark, "x.pin", "y", "tsv")


def test_mztab_and_targets(spark, tmp_path):
    rows = psms.mark_decoys(psms.read_psms(spark, put(tmp_path, "a.txt", TABLE)))
    sinks.write_mztab(rows, str(tmp_path / "m"), {"min-length": "6"})
    lines = [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert sum(x.startswith("PSM\t") for x in lines) == 3 and any("min-length = 6" in x for x in lines)
    sinks.write_by_kind(rows, str(tmp_path / "k"))
    assert {r.kind for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "k")).select("kind").distinct().collect()} == {"target", "decoy"}
    with pytest.raises(Exception):
        sinks.write_table(rows, str(tmp_path / "k"))


def test_side_files(spark, tmp_path):
    d = psms.read_design(spark, put(tmp_path, "d.tsv", "file\tcondition\treplicate\tfraction\ttechnical_replicate\n/x/a.mzML\tK\t1\t0\t2\n")).collect()
    assert [tuple(r) for r in d] == [("a", "K", 1, 0, 2)]
    assert psms.read_parameters(spark, put(tmp_path, "p.txt", "# x\nmin-length=7\n\ntop = 3 # y\n")) == {"min-length": "7", "top": "3"}
    f = psms.read_features(spark, put(tmp_path, "f.hk", "S\t1\t0.5\tx\nP\t1000.5\t2\t99.0\t501.2\nP\t900\t1\t5\t901\nS\t2\t0.7\tx\n")).collect()
    assert [(r.scan, r.mono_mass, r.charge) for r in f] == [(1, 1000.5, 2), (1, 900.0, 1)]
    t = "PSMId\tfilename\tscore\tq-value\tposterior_error_prob\tpeptide\tproteinIds\ntarget_0_14_1_1\ta.txt\t0.1\t0.001\t1\tK.VM[15.99]F.T\tp\ntarget_0_15_2_1\ta.txt\t0.1\t0.5\t1\tGG\tp\n"
    assert [(r.scan, r.charge, r.sequence, r.mod_sequence) for r in psms.read_percolator_psms(spark, put(tmp_path, "t.txt", t)).collect()] == [(14, 1, "VMF", "VM[15.99]F")]
    l = "scan\tcharge\tspectrum precursor m/z\tpeptide mass\tsequence\tunmodified sequence\tspectrum neutral mass\tretention time\ttdc q-value\tprotein id\tfile\n36\t2\t676.3\t1350.6\tEG\tEG\t1350.6\t120\t0.001\tP\t/z/s.mzML\n37\t2\t6\t1\tE\tE\t1\t1\t0.5\tP\ts\n"
    assert [(r.file, r.scan, r.rt) for r in psms.read_lfq_psms(spark, put(tmp_path, "l.tsv", l), rt_seconds=True).collect()] == [("s", 36, 2.0)]


def test_ms2_keeps_scans_of_seven_digits(spark, tmp_path):
    z = "array<struct<charge:int,mh:double>>"
    made = [(s, 500.0, [(2, 999.0)], None, [100.0, 200.5], [1.0, 2.0]) for s in (7, 999_999, 1_000_000, 1_000_001, 21_474_836)]
    sinks.write_ms2(spark.createDataFrame(made, f"scan int, precursor_mz double, zstates {z}, rt double, mz array<double>, intensity array<double>"), str(tmp_path / "wide.ms2"))
    assert sorted(r.scan for r in spectra.read_ms2(spark, str(tmp_path / "wide.ms2")).collect()) == [r[0] for r in made]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_match_files_without_long_records(spark, tmp_path, compression):
    """Parts without a tag are no single record, texts are dealt once, and parts may be compressed."""
    rows = spark.range(3000).select(F.col("id").cast("int").alias("scan"), F.lit(2).alias("charge"), F.lit(900.5).alias("spectrum neutral mass"), F.lit(899.0).alias("peptide mass"), F.lit(1.5).alias("xcorr score"), F.lit(1).alias("xcorr rank"), F.concat(F.lit("PEPTIDE"), F.translate(F.col("id").cast("string"), "0123456789", "ACDEFGHIKL")).alias("sequence"), F.lit("A,B").alias("protein id"), F.lit("KR").alias("flanking aa"))
    sinks.write_mzid(rows, str(tmp_path / "a.mzid"), compression=compression)
    assert psms._in_lines(spark, str(tmp_path / "a.mzid"), ("SpectrumIdentificationResult", "Peptide", "PeptideEvidence", "DBSequence"))
    found = psms._elements(spark, str(tmp_path / "a.mzid"), "Peptide", "_id string, PeptideSequence string", lines=True)
    assert found.count() == 3000
    back = psms.read_mzid(spark, str(tmp_path / "a.mzid"))
    assert sorted((r.scan, r["protein id"]) for r in back.select("scan", "protein id").collect()) == [(k, "A,B") for k in range(3000)]
    sinks.write_pepxml(rows, str(tmp_path / "a.pepxml"), compression=compression)
    assert psms.read_pepxml(spark, str(tmp_path / "a.pepxml")).select("scan", "sequence").distinct().count() == 3000
    plan = sinks._matches(rows, [F.col("sequence").alias("text")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_elements_over_lines_are_read_by_tag(spark, tmp_path):
    text = '<DBSequence id="DB_A" accession="A"/><DBSequence id="DB_B"\n accession="B"/>\n'
    path = put(tmp_path, "over.mzid", text)
    assert not psms._in_lines(spark, path, ("DBSequence",))
    assert sorted(r._accession for r in psms._elements(spark, path, "DBSequence", "_id string, _accession string").collect()) == ["A", "B"]
