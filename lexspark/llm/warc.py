"""WARC writing and a sequential reader (operator 8).

write() makes archives of one gzip member per record in the shared folder; which record of
equal payloads is the response is settled before by a small aggregate, and the others become
revisits. read() opens archives through Arrow's file systems (local, HDFS, object stores) and
streams: members are inflated piece by piece with zlib, framed by Content-Length, and
digests verified, so that memory holds one record and one piece of input.

Each task writes under a name of its own and renames the file when it is complete, so that a
repeated or speculative task replaces equal bytes. A null payload counts as empty. A null
page id is smaller than any other; records with the same payload and the same largest
id are all responses. Very long payloads are written whole. An empty table gives no
record and an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import common

PIECE = 1 << 18
#: An archive is closed after as many bytes of gzip members.
ROLL_BYTES = 256 << 20
LEVEL = 4
PREFIX = "urn:lexspark:page:"


class Broken(ValueError):
    """An archive that isn't as its own headers say."""


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: an HTTP response, or a revisit of an identical payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{PREFIX}{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join((url or "about:blank").split())),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + digest32(payload)),
        ("WARC-Block-Digest", "sha1:" + digest32(block)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{PREFIX}{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member, of the same bytes for the same data."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream):
    """Inflates gzip members one after another from a stream; yields the bytes of each whole one."""
    z, out, data = None, [], b""
    while True:
        if not data:
            data = stream.read(PIECE)
            if not data:
                break
        if z is None:
            z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        if z.eof:
            data = z.unused_data
            yield b"".join(out)
            z, out = None, []
        else:
            data = b""
    if z is not None:
        raise Broken("the last member is cut off")


def parse_all(data: bytes):
    """Headers and payload of each record in a member's bytes, framed by content length."""
    at = 0
    while at < len(data):
        fields, size = _parse(data[at:] if at else data)
        yield fields
        at += size


def parse(data: bytes) -> dict:
    """Headers and payload of a single record's bytes; raises Broken where length or digest don't match."""
    fields, size = _parse(data)
    if size != len(data):
        raise Broken("content length doesn't frame the block")
    return fields


def _parse(data: bytes) -> tuple[dict, int]:
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise Broken("no WARC version line")
    fields = {k.strip().lower().decode(): v.strip().decode("utf-8") for k, v in (x.split(b":", 1) for x in lines[1:])}
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n : n + 4] != b"\r\n\r\n":
        raise Broken("content length doesn't frame the block")
    if "warc-type" not in fields or "warc-record-id" not in fields:
        raise Broken("no type or no id")
    # Digests by other algorithms are not verified.
    differs = lambda name, x: fields.get(name, "").startswith("sha1:") and fields[name].upper() not in ("SHA1:" + digest32(x), "SHA1:" + hashlib.sha1(x).hexdigest().upper())
    if differs("warc-block-digest", block):
        raise Broken("the block's digest differs")
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    if fields["warc-type"] != "revisit" and differs("warc-payload-digest", payload):
        raise Broken("the payload's digest differs")
    return fields | {"_payload": payload}, len(head) + 4 + n + 4


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def write(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives of all pages in `folder` (a URI that all machines reach); returns their (path, records), written out."""
    common.prepare(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("payload"))
    key = F.sha2("payload", 256)
    large = rows.where(F.octet_length("payload") >= min_bytes).select("id", key.alias("key"))
    top = large.groupBy("key").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    # Written first: its size then decides whether pages are sent to it or it to the pages.
    again = common.materialize(large.distinct().join(top, "key").where("not (id <=> first)").select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("first").alias("refers")), "revisits")
    joined = rows.withColumn("key", key).join(again, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    joined = joined.select("id", "url", "payload", "refers")

    def run(batches):
        from pyspark import TaskContext

        from lexspark.llm import warc

        fs, at = warc.file_system(folder)
        fs.create_dir(at, recursive=True)
        part, n, size, out, name = TaskContext.get().partitionId(), 0, 0, None, ""
        files = []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                final = f"part-{part:06d}-{len(files):04d}.warc.gz"
                fs.move(f"{at}/{name}", f"{at}/{final}")
                files.append((f"{folder}/{final}", n))
                out = None

        for batch in batches:
            for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, n, size = f"_{uuid.uuid4().hex}.tmp", 0, 0
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                data = warc.member(warc.record(page, url, payload, refers, refers is not None))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ROLL_BYTES:
                    close()
        close()
        yield {"path": [p for p, _ in files], "records": [k for _, k in files]}

    return common.materialize(common.arrow_map(joined, run, "path string, records long"), "archives")


def read(spark: SparkSession, archives: DataFrame, batch_rows: int = 256, with_payload: bool = False) -> DataFrame:
    """Records of archives(path): ids, type, digests, sizes and, on request, payloads.

    Records of any type and origin are read, one or several to a member. page_id and refers_to are null where ids are not
    write()'s; payload_bytes of a revisit is null where it isn't stated (resolved() takes it from what the record refers to).
    """
    common.prepare(spark)
    n = max(1, archives.count())
    paths = archives.select("path").repartition(n)

    def run(batches):
        from lexspark.llm import warc

        def rows():
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    fs, at = warc.file_system(path)
                    with fs.open_input_stream(at, compression=None) as stream:
                        for data in warc.members(stream):
                            yield from warc.parse_all(data)

        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "record_id", "refers_to_id", *["payload"] * with_payload]
        part = {k: [] for k in names}

        def number(x):
            digits = x.strip("<>").removeprefix(PREFIX) if x and x.startswith(f"<{PREFIX}") else ""
            return int(digits) if digits.lstrip("-").isdigit() else None

        for r in rows():
            revisit = r["warc-type"] == "revisit"
            part["page_id"].append(number(r["warc-record-id"]))
            part["url"].append(r.get("warc-target-uri"))
            part["record_type"].append(r["warc-type"])
            stated = r.get("x-payload-length")
            part["payload_bytes"].append((int(stated) if stated else None) if revisit else len(r["_payload"]))
            part["payload_digest"].append(r["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in r else None if revisit else warc.digest32(r["_payload"]))
            part["refers_to"].append(number(r.get("warc-refers-to")) if revisit else None)
            part["record_id"].append(r["warc-record-id"])
            part["refers_to_id"].append(r.get("warc-refers-to"))
            if with_payload:
                part["payload"].append(None if revisit else r["_payload"])
            if len(part["page_id"]) >= batch_rows:
                yield part
                part = {k: [] for k in names}
        yield part

    return common.arrow_map(paths, run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, refers_to_id string" + ", payload binary" * with_payload)


def resolved(records: DataFrame) -> DataFrame:
    """read()'s records, revisits without a stated length with that of the record they refer to (null if it isn't there)."""
    known = records.where("record_type <> 'revisit'").groupBy("record_id").agg(F.max("payload_bytes").alias("n"))
    known = known.select(F.col("record_id").alias("refers_to_id"), "n")
    return records.join(known, "refers_to_id", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "n")).select(*records.columns)
