"""Convert legacy ARC archives to WARC, write the archives and read them.

An ARC record has a header line whose fields depend on the version that the file's first record
declares, and the length of what follows. The WARC record made of it has an identifier, time,
type and digests of its own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlode.llm.common import materialize, new_path, small_batches

# Fixed values of the ARC format: the fields of a URL record's header line by version.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "result", "checksum", "location", "offset", "filename", "length"),
}
LEGEND = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-to-warc")


def arc_file(records: list[dict], version: int = 1, filename: str = "pages.arc", date: str = "19960923142103") -> bytes:
    """The bytes of an ARC file: a version block, then the records (url, payload and other fields)."""
    block = f"{version} 0 {'converted'}\n{LEGEND[version]}\n".encode()
    told = {"ip": "0.0.0.0", "date": date, "mime": "text/html", "result": "200", "checksum": "-", "location": "-", "offset": "0", "filename": filename}
    first = told | {"url": f"filedesc://{filename}", "mime": "text/plain", "length": str(len(block))}
    out = [" ".join(first[f] for f in FIELDS[version]).encode() + b"\n" + block + b"\n"]
    for r in records:
        line = told | {"offset": str(sum(map(len, out)))} | {k: v for k, v in r.items() if k != "payload"} | {"length": str(len(r["payload"]))}
        out.append(" ".join("".join(line[f].split()) or "-" for f in FIELDS[version]).encode() + b"\n" + r["payload"] + b"\n")
    return b"".join(out)


def arc_records(data: bytes) -> Iterator[dict]:
    """The URL records of an ARC file, with their payload; the version block sets the fields.

    A payload is as long as its header line declares, whatever it holds. Raises ValueError for a
    header line with other fields than the version has, and for a file that ends too early.
    """
    at, version = 0, 0
    while at < len(data):
        end = data.find(b"\n", at)
        words = data[at : len(data) if end < 0 else end].decode("utf-8", "replace").split(" ")
        if end < 0 or not words[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}")
        body = data[end + 1 : end + 1 + int(words[-1])]
        if len(body) < int(words[-1]):
            raise ValueError(f"the record at byte {at} ends too early")
        at = end + 1 + len(body)
        while data[at : at + 1] == b"\n":
            at += 1
        if not version:
            version = int(body.split(b" ", 1)[0])
            continue
        if len(words) != len(FIELDS[version]):
            raise ValueError(f"{len(words)} fields in a header line of version {version}")
        yield dict(zip(FIELDS[version], words, strict=True)) | {"payload": body, "version": version}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_time(date: str) -> str:
    """An ARC date (up to 14 digits) as the time of a WARC header; the epoch if it isn't one."""
    digits = "".join(c for c in date if c.isdigit())[:14]
    try:
        when = datetime.strptime(digits.ljust(14, "0") if len(digits) > 8 else digits[:8], "%Y%m%d%H%M%S" if len(digits) > 8 else "%Y%m%d")
    except ValueError:
        when = datetime.fromtimestamp(0, timezone.utc)
    return when.strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(key: object) -> str:
    """The same identifier for the same key on every run."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(key))}>"


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[], [], [], [], [], []]
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for r in arc_records(data.as_py()):
                for column, value in zip(rows, (key, r["url"], warc_time(r["date"]), r["mime"], digest(r["payload"]), r["payload"]), strict=True):
                    column.append(value)
        kinds = (batch.column(0).type, pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["id", "url", "date", "mime", "digest", "payload"])


def convert_arcs(arcs: DataFrame, id_col: str = "id", arc_col: str = "arc") -> DataFrame:
    """ARC files (id, bytes) to one row per URL record: id, url, date, mime, digest, payload."""
    kind = arcs.schema[id_col].dataType.simpleString()
    return arcs.select(F.col(id_col).alias("id"), F.col(arc_col).alias("arc")).mapInArrow(_converted, f"id {kind}, url string, date string, mime string, digest string, payload binary")


def _as_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page as an ARC file of its own; odd ids in version 1, the others in version 2."""
    for batch in batches:
        arcs = [arc_file([{"url": url or "", "payload": (html or "").encode("utf-8", "surrogatepass")}], 1 if (key or 0) % 2 else 2) for key, url, html in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(arcs, pa.binary())], names=["id", "arc"])


def pages_as_arcs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(_as_arcs, "id long, arc binary")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WARC records as text, without the two line ends that close a record."""
    for batch in batches:
        out = []
        for key, url, date, mime, sha, payload, first in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
            revisit = first is not None and first != key
            body = b"" if revisit else payload
            lines = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{digest(body)}", f"X-Source-Id: {'' if key is None else key}", f"X-Payload-Length: {len(payload)}"]
            if revisit:
                lines += [f"WARC-Refers-To: {record_id(first)}", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"X-Refers-To-Id: {first}"]
            lines += [f"Content-Type: {mime}", f"Content-Length: {len(body)}"]
            out.append("\r\n".join([*lines, "", ""]).encode("utf-8", "surrogatepass") + body)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_warcs(records: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write ``records`` (as convert_arcs() returns them) as gzipped WARC files, one for each partition.

    Of records with equal payloads of ``least_bytes`` or more, that with the smallest id is a
    response and the others are revisits of it; shorter ones are all responses.
    """
    # the payloads are converted again where they are written, rather than kept twice on disk
    slim = materialize(records.select("id", "digest", (F.octet_length("payload") >= least_bytes).alias("long")), "digests")
    firsts = slim.where("long").groupBy(F.col("digest").alias("sha")).agg(F.min("id").alias("first"))
    linked = slim.select("id", "digest").join(firsts, F.col("digest") == F.col("sha")).select(F.col("id").alias("key"), "sha", "first").distinct()
    linked = materialize(linked, "linked")
    both = records.join(linked, F.col("id").eqNullSafe(F.col("key")) & (F.col("digest") == F.col("sha")), "left")
    texts = both.select("id", "url", "date", "mime", "digest", "payload", "first").mapInArrow(_texts, "value binary")
    texts.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def warc_records(data: bytes) -> Iterator[dict]:
    """The records of a WARC file: its named fields in lower case, and the block under 'block'."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        block = data[end + 4 : end + 4 + int(fields["content-length"])]
        at = end + 8 + len(block)
        if data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError(f"the record before byte {at} has another length than it declares")
        yield fields | {"block": block}


def unzipped(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("id", "url", "date", "mime", "record_type", "record_id", "payload_bytes", "payload_digest", "refers_to", "payload")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    for batch in batches:
        for data in batch.column(0):
            rows = []
            for r in warc_records(unzipped(data.as_py())):
                sha, length = r["warc-payload-digest"].removeprefix("sha1:"), int(r["x-payload-length"])
                block = r["block"]
                if r["warc-block-digest"] != f"sha1:{digest(block)}" or r["warc-type"] == "response" and (sha != digest(block) or length != len(block)):
                    raise ValueError(f"the digests of {r['warc-record-id']} don't hold")
                to = r.get("x-refers-to-id")
                rows.append((int(r["x-source-id"]) if r["x-source-id"] else None, r["warc-target-uri"], r["warc-date"], r["content-type"], r["warc-type"], r["warc-record-id"], length, sha, int(to) if to else None, block))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=list(names))


def read_warcs(spark, path: str) -> DataFrame:
    """One row per record of the WARC files under ``path``; a record whose digests don't hold is an error."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, "id long, url string, date string, mime string, record_type string, record_id string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def convert_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Pages as ARC files, converted, written as WARC archives and read back: a row per page.

    Null html is an empty payload, a null url an empty one ('-'). Rows of a null id are responses
    unless an equal payload has an id; equal ids with equal payloads are each a record. An empty
    table gives no record.
    """
    spark = pages.sparkSession
    small_batches(spark)
    path = new_path(spark, "warc")
    write_warcs(convert_arcs(pages_as_arcs(pages, id_col, url_col, html_col)), path, least_bytes)
    return read_warcs(spark, path).withColumnRenamed("id", id_col)
