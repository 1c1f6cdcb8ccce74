"""Streams of spectra: an extension, with no counterpart among the batch analyses.

New files are searched as they arrive against a fixed index, late spectra are counted by event-time windows, and
the state of the spectrum before, per precursor bin, is kept by a stateful operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from massloom.operators import search
from massloom.sources.spectra import spectrum_charges

SPECTRA = "file string, scan int, ms_level int, precursor_mz double, rt double, zstates array<struct<charge:int,mh:double>>, iso_lo double, iso_hi double, mz array<double>, intensity array<double>"


def read_incoming(spark: SparkSession, path: str, schema: str = SPECTRA, files_per_trigger: int = 100) -> DataFrame:
    """Spectra from Parquet files that appear below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def search_incoming(spectra: DataFrame, index: DataFrame, target: str, checkpoint: str, available_now: bool = False, **options) -> StreamingQuery:
    """Search each micro-batch and append its matches below ``target``.

    A batch's rows go to a folder of its own number, so a batch that is repeated after a failure replaces its own output.
    """

    def batch(rows: DataFrame, number: int) -> None:
        found = search.search(spectrum_charges(rows.where("ms_level = 2")), index, **options)
        found.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = spectra.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def arrival_counts(spectra: DataFrame, time: str = "arrived", window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(file, start, n, tic) by tumbling windows of event time; rows later than ``late`` are dropped."""
    tic = F.aggregate("intensity", F.lit(0.0), lambda s, x: s + x)
    return spectra.withWatermark(time, late).groupBy(F.window(time, window), "file").agg(F.count("*").alias("n"), F.sum(tic).alias("tic")).select("file", F.col("window.start").alias("start"), "n", "tic")


def previous_in_bin(spectra: DataFrame, width: float = 1.000495, timeout: str = "1 hour") -> DataFrame:
    """(file, pbin, scan, precursor_mz, prev_scan, prev_precursor_mz) of each spectrum and the one before it in its precursor bin.

    The state of a bin is one spectrum; it is dropped if nothing comes for ``timeout``.
    """
    keyed = spectra.select("file", F.floor(F.col("precursor_mz") / width).cast("long").alias("pbin"), "scan", "precursor_mz")
    milliseconds = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("scan")  # one bin's spectra of one micro-batch
        out = []
        for r in rows.itertuples(index=False):
            if last is not None:
                out.append((key[0], key[1], r.scan, r.precursor_mz, last[0], last[1]))
            last = (int(r.scan), float(r.precursor_mz))
        if last is not None:
            state.update(last)
            state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame(out, columns=["file", "pbin", "scan", "precursor_mz", "prev_scan", "prev_precursor_mz"])

    return keyed.groupBy("file", "pbin").applyInPandasWithState(step, "file string, pbin long, scan int, precursor_mz double, prev_scan int, prev_precursor_mz double", "scan int, precursor_mz double", "append", GroupStateTimeout.ProcessingTimeTimeout)
