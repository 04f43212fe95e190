"""Operator 6: WARC archives with repeated payloads written as revisits.

Records' headers (id, digest, size; no payloads) are shuffled by payload digest; of each digest that repeats the record
with the largest id becomes the response, all others revisit it, and revisits that came in already are tied to that
response too. The settled originals lie in the shared folder as sorted arrays of digests, in buckets; the writers look
their records' digests up there, so payloads stay where they lie and nothing that grows is broadcast. Records get fresh
headers and are written as gzip members of .warc.gz archives in a shared folder. A manifest table that Spark commits
names the archives that count, so an attempt that was lost or run twice leaves nothing in the result. The reader's tasks
open the archives that the manifest's rows name and parse them as streams.
"""

from __future__ import annotations

import datetime
import gzip
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simgrove.llm.common import bounded_batches, map_array, open_file, put_file, shared_dir, stored, with_few

ARCHIVE_BYTES = 8_000_000
#: Level of the archives' compression; bytes that the reader takes from an archive at a time, and that leave it at once.
LEVEL, READ, SLICE, OUT = 4, 1 << 20, 1 << 14, 8_000_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, payload_digest string, refers_to long, refers_null boolean, payload binary"
_NAMES = [x.split()[0] for x in RECORD.split(", ")]
#: The digits of conv() and those of base32.
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CONTROL = re.compile("[\x00-\x20\x7f]")
#: A settled digest: the text of it, the response's id and whether it has one.
ORIGINAL = np.dtype([("digest", "S32"), ("best", "<i8"), ("named", "?")])


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 bits at a time."""
    h = F.upper(F.sha1(payload))
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(h, 1 + 10 * k, 10), 16, 32), 8, "0"), _DIGITS, _BASE32) for k in range(4)])


def _urn(page_id: int | None) -> str:
    return f"<urn:record:{'null' if page_id is None else page_id}>"


def _id(urn: str) -> int | None:
    return None if "null" in urn else int(urn.rsplit(":", 1)[1].rstrip(">"))


def record_bytes(page_id, url, kind, payload_digest, refers_to, date: str, payload: bytes) -> bytes:
    """A WARC/1.1 record; a revisit has the HTTP head alone. Blanks and control characters of the URL are escaped."""
    block = HTTP if kind == "revisit" else HTTP + payload
    clean = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", "sha1:" + payload_digest)]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to)), ("WARC-Truncated", "length")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def members(stream):
    """The decompressed members of a gzip stream, one at a time. It is fed in short slices, since what a member leaves of
    a slice is copied."""
    inflate, parts = zlib.decompressobj(31), []
    while read := stream.read(READ):
        at = 0
        while at < len(read):
            piece = read[at : at + SLICE]
            parts.append(inflate.decompress(piece))
            at += len(piece) - len(inflate.unused_data)
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("an archive ends inside of a record")


def parse(stream):
    """The (headers, payload) of each record of an archive; payload is what follows the HTTP head."""
    for raw in members(stream):
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def records(pages: DataFrame) -> DataFrame:
    """Pages as responses with digests; null html is an empty payload, null url an empty one. Other columns go."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    return own.select("page_id", "url", F.lit("response").alias("record_type"), digest(F.col("payload")).alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("refers_null"), "payload")


def _settled(folder: str):
    def run(table):
        import pyarrow as pa

        x = np.zeros(len(table), ORIGINAL)
        x["digest"] = [d.encode() for d in table.column("payload_digest").to_pylist()]
        best = table.column("best")
        x["best"], x["named"] = best.fill_null(0).to_numpy(), best.is_valid().to_numpy()
        x.sort(order="digest")
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "path": [put_file(folder, f"originals-{bucket:05d}", x.tobytes())]})

    return run


def _bucket(payload_digest: str, buckets: int) -> Column:
    return F.pmod(F.crc32(F.col(payload_digest).cast("binary")), F.lit(buckets)).cast("int")


def resolve(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """RECORD rows with record_type and refers_to settled anew.

    Records with equal digests of least_bytes or more: the one with the largest page_id is the response (null ids are
    the least, and rows that share that id are all responses), the others revisit it. Smaller payloads all stay. A
    revisit whose original is absent stays one. No rows, no records.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    counts = F.when(F.col("record_type") != "response", False).otherwise(F.octet_length("payload") >= least_bytes)
    heads = rows.select("payload_digest", F.when(counts, F.col("page_id")).alias("best"), counts.alias("counts"), (F.col("record_type") == "revisit").alias("again"))
    groups = heads.groupBy("payload_digest").agg(F.max("best").alias("best"), F.count_if("counts").alias("n"), F.count_if("again").alias("m")).where("n > 0 and n + m > 1")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.select(_bucket("payload_digest", buckets).alias("bucket"), "payload_digest", "best")
    files = {r["bucket"]: r["path"] for r in stored(dealt.groupBy("bucket").applyInArrow(_settled(f"{shared_dir(spark)}.originals"), "bucket int, path string")).collect()}  # a path for each bucket

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            bucket, own = batch.column("bucket").to_numpy(), np.array([d.encode() for d in batch.column("payload_digest").to_pylist()], "S32")
            best, named, found = np.zeros(len(own), np.int64), np.zeros(len(own), bool), np.zeros(len(own), bool)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                if b in files:
                    table, k = map_array(files[b], ORIGINAL), order[edges[b] : edges[b + 1]]
                    at = np.minimum(np.searchsorted(table["digest"], own[k]), len(table) - 1)
                    hit = table["digest"][at] == own[k]
                    found[k], best[k], named[k] = hit, table["best"][at], table["named"][at]
            page = batch.column("page_id")
            same = np.where(page.is_valid().to_numpy(zero_copy_only=False), named & (page.fill_null(0).to_numpy() == best), ~named)
            revisit = np.array(batch.column("record_type").to_pylist(), object) == "revisit"
            again = found & (revisit | (batch.column("counts").fill_null(False).to_numpy(zero_copy_only=False) & ~same))
            kind = np.where(again, "revisit", batch.column("record_type").to_pylist())
            refers = [b if a and n else None if a else r for a, n, b, r in zip(again.tolist(), named.tolist(), best.tolist(), batch.column("refers_to").to_pylist(), strict=True)]
            gone = (again & ~named) | (~again & batch.column("refers_null").fill_null(False).to_numpy(zero_copy_only=False))
            payload = pa.compute.if_else(pa.array(kind == "response"), batch.column("payload"), None)
            yield pa.RecordBatch.from_arrays([page, batch.column("url"), pa.array(kind.tolist(), pa.string()), batch.column("payload_digest"), pa.array(refers, pa.int64()), pa.array(gone), payload], _NAMES)

    return rows.select(*_NAMES, counts.alias("counts"), _bucket("payload_digest", buckets).alias("bucket")).mapInArrow(run, RECORD)


def _archives(folder: str, date: str):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        held: list[bytes] = []

        def write():
            path = put_file(folder, f"part-{TaskContext.get().partitionId():05d}", b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)], pa.int64())], ["path", "records"])

        size = 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "record_type", "payload_digest", "refers_to", "payload")]
            for page, url, kind, dig, refers, payload in zip(*cols, strict=True):
                held.append(gzip.compress(record_bytes(page, url, kind, dig, refers, date, payload or b""), LEVEL, mtime=0))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield write()
                    held, size = [], 0
        if held:
            yield write()

    return run


def write_archives(rows: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """Write RECORD rows to archives in the folder; the manifest: (path, records) of each archive that counts. The date
    of the records is the given one (ISO 8601) or that of the call."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return stored(rows.mapInArrow(_archives(folder, date), "path string, records long"))


def _parsed(batches):
    import pyarrow as pa

    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
    for batch in batches:
        for path in batch.column("path").to_pylist():
            out: list = []
            size = 0
            with open_file(path) as stream:
                for f, payload in parse(stream):
                    refers = f.get("WARC-Refers-To")
                    out.append((_id(f["WARC-Record-ID"]), f["WARC-Target-URI"], f["WARC-Type"], f["WARC-Payload-Digest"][5:], refers and _id(refers), bool(refers) and _id(refers) is None, None if refers else payload))
                    size += 200 + len(payload)
                    if size > OUT:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], _NAMES)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], _NAMES)


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """RECORD rows of the archives that a manifest names; each is read by the task that holds its row."""
    bounded_batches(spark)
    return manifest.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(_parsed, RECORD)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from deduplicated archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_archives(resolve(records(pages)), shared_dir(spark) + ".warc")
    back = read_archives(spark, manifest)
    # revisits take the size of their response's payload; responses tell their own
    heads = stored(back.select("page_id", "record_type", "payload_digest", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes")))
    again = heads.where("record_type = 'revisit'").drop("payload_bytes")
    sizes = heads.where("record_type = 'response'").join(again.select("payload_digest").distinct(), "payload_digest", "left_semi")
    sizes = sizes.groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    out = heads.where("record_type = 'response'").unionByName(with_few(again, sizes, "payload_digest"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
