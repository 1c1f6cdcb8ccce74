"""WARC archives: writing, reading and resolving revisits.

Spark's own text writer writes the archives, so they go to whatever store the path
names; every record ends in the two blank lines that the writer puts between rows. A file takes as many records
as make ``FILE_BYTES`` at their mean size. Reading takes whole files (``binaryFile``) and cuts records by
their Content-Length, so a payload may hold anything.

Resolving shuffles headers alone: equal payload digests elect one response,
the other records are joined to it and become revisits with headers of their own. The verdicts then meet the full records by record id,
map-side while Spark can broadcast them; beyond that this one join shuffles the payloads once.
"""

from __future__ import annotations

import gzip
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.session import written

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Payload bytes of a file at the mean size of a record, and the most records; a reader holds one compressed file at a time.
FILE_BYTES, FILE_RECORDS = 64 << 20, 5000
_END = "\r\n\r\n"


def digest_base32(payload: Column) -> Column:
    """Upper-case base32 SHA-1: each 5 hex digits are 20 bits, or 4 characters."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(digest: Column) -> Column:
    """A record's own id, from its payload's digest and its place in the run that writes it."""
    h = F.md5(F.concat_ws(" ", digest, F.monotonically_increasing_id().cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _clean(text: Column) -> Column:
    """A header value: line ends would end the header."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")


def write_archive(records: DataFrame, path: str, mean_bytes: float | None = None) -> None:
    """Write rows (record, key, uri, payload binary, digest, n_bytes, kind, refers_to, refers_record, refers_uri) as WARC files below ``path``.

    A revisit has the response's HTTP header as its block and no payload. Null uris are
    written as empty ones, a null key has no header. ``mean_bytes`` is the mean payload, asked from ``records`` if not given.
    """
    if mean_bytes is None:
        mean_bytes = records.agg(F.avg("n_bytes")).first()[0]
    most = max(1, min(FILE_RECORDS, int(FILE_BYTES / max(1.0, mean_bytes or 1.0))))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(_END))
    revisit = F.col("kind") == "revisit"
    length = F.length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.col("kind"),
        F.lit("\r\nWARC-Record-ID: "), F.col("record"),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), _clean(F.col("uri")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Identified-Payload-Key: "), F.col("key").cast("string")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), F.col("refers_record"), F.lit("\r\nWARC-Refers-To-Target-URI: "), _clean(F.col("refers_uri")), F.lit(f"\r\nWARC-Refers-To-Date: {DATE}\r\nWARC-Refers-To-Payload-Key: "), F.col("refers_to").cast("string"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(_END),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col("payload").cast("string"), F.lit("")))
    records.select(F.concat(head, http, body).alias("value")).write.option("lineSep", _END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", most).text(path)


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows (record, key, uri, payload, digest, n_bytes, kind, refers_to) of all records below ``path``.

    ``n_bytes`` is the payload's full size, also for revisits, whose payload is null.
    """

    def run(batches):
        names = ["record", "key", "uri", "payload", "digest", "n_bytes", "kind", "refers_to"]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64())

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for files in batches:
            for raw in files.column(0):
                rows, size = [], 0
                for row in parse(gzip.GzipFile(fileobj=io.BytesIO(raw.as_py())), payloads):
                    rows.append(row)
                    size += len(row[3] or b"") + 100
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "record string, key long, uri string, payload binary, digest string, n_bytes long, kind string, refers_to long")


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parse(archive, payloads: bool = True):
    """Cut a stream of one archive into rows, see ``read_archive``; one record is in memory at a time."""
    while version := archive.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {version[:40]!r}")
        lines = []
        while (line := archive.readline()) != b"\r\n":
            lines.append(line)
        head = _headers(lines)
        block = archive.read(int(head["content-length"]))
        archive.read(len(_END))
        inner = block.index(b"\r\n\r\n")
        http = _headers(block[:inner].split(b"\r\n")[1:])
        kind = head["warc-type"]
        key, refers = head.get("warc-identified-payload-key"), head.get("warc-refers-to-payload-key")
        body = block[inner + 4 :] if payloads and kind == "response" else None
        yield head["warc-record-id"], int(key) if key else None, head.get("warc-target-uri", ""), body, head["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"]), kind, int(refers) if refers else None


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(record, refers_to, refers_record, refers_uri) of the records that become revisits, from (record, key, uri, digest, n_bytes).

    Of records with equal payloads of ``min_bytes`` at least, the one with the largest
    key is the response; records that share this key and payload are responses too. A null key is smaller than any, and where all are
    null all are responses. Groups are combined before the shuffle; only groups of two and
    more are joined back, and Spark splits the partition of a very large one.
    """
    response = F.max(F.struct("key", "record", "uri")).alias("first")  # a null key comes first
    groups = headers.where(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes").agg(response, F.count("*").alias("copies"))
    whole = groups.where("copies > 1 and first.key is not null").select("digest", "n_bytes", "first")
    joined = headers.select("record", "key", "digest", "n_bytes").join(written(whole, "responses"), ["digest", "n_bytes"])
    return joined.where(~F.col("key").eqNullSafe(F.col("first.key"))).select("record", F.col("first.key").alias("refers_to"), F.col("first.record").alias("refers_record"), F.col("first.uri").alias("refers_uri"))


def archive(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html") -> None:
    """Write every page as a response record, null payloads as empty ones.

    Repeated rows, and rows that share an id, are records of their own with record ids of their own.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(uri).cast("string").alias("uri"), body.alias("payload"))
    rows = rows.select("*", digest_base32(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"), F.lit("response").alias("kind"), F.lit(None).cast("long").alias("refers_to"))
    mean = pages.agg(F.avg(F.octet_length(payload))).first()[0]
    write_archive(rows.select("*", _record_id(F.col("digest")).alias("record"), F.lit(None).cast("string").alias("refers_record"), F.lit(None).cast("string").alias("refers_uri")), path, mean)


def deduplicate(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> None:
    """Read the archives below ``source``, resolve revisits and write archives with fresh headers below ``target``.

    Only headers are shuffled by digest. The revisits are written before they meet the
    records, so that Spark knows their size when it chooses the join.
    """
    headers = written(read_archive(spark, source, payloads=False).select("record", "key", "uri", "digest", "n_bytes"), "headers")
    mean = headers.agg(F.avg("n_bytes")).first()[0]
    revisits = written(resolve_revisits(headers, min_bytes), "revisits")
    records = read_archive(spark, source).drop("kind", "refers_to").join(revisits, "record", "left")
    write_archive(records.withColumn("kind", F.when(F.col("refers_record").isNull(), "response").otherwise("revisit")), target, mean)
