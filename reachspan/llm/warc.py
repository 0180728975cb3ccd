"""Converter of legacy ARC archives to WARC.

An ARC file begins with a version block that names the fields of the header lines that follow; every header line
declares the length of its content.  The converter parses them by the file's own definition (version 1 or 2) and
synthesises a WARC record for each: identifier, timestamp, type, digests.  Of records with equal payloads of at least
`MIN_REVISIT` bytes one stays a response and the others become revisits that keep its HTTP header only.

Files are written by Spark's text writer, with the records' own line ends as separators, and read by its binary
reader, so any file system that Spark knows will do.  Files are small (`FILE_BYTES`), because a file is read as a whole.
Payloads never pass a shuffle except inside compressed archive files; equal payloads meet by digest only, with the maximum taken before the shuffle.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import checkpoint_dir, cut, map_batches

FILE_BYTES = 8 << 20
MIN_REVISIT = 1000

# The definition lines of both ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_EPOCH = "19700101000000"


def arc_header(version: int, url: str, date: str, kind: str, length: int, name: str, status: int = 200) -> str:
    """One header line, without its line end."""
    url = re.sub(r"[\s\x00-\x20]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "urn:none"
    if version == 1:
        return f"{url} 0.0.0.0 {date} {kind} {length}"
    return f"{url} 0.0.0.0 {date} {kind} {status} - - 0 {name} {length}"


def arc_opening(version: int, name: str) -> str:
    """The version block that an ARC file begins with."""
    body = f"{version} 0 reachspan\n{ARC_FIELDS[version]}\n"
    return arc_header(version, f"filedesc://{name}", _EPOCH, "text/plain", len(body), name) + "\n" + body


def read_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Version, header fields and content of each record after the version block; ValueError where the file is broken."""
    at, version, names = 0, 0, ARC_FIELDS[1].split()
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"a header line without end at byte {at}")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        opening = line.startswith("filedesc://")
        values = [line.split(" ")[0], line.rsplit(" ", 1)[-1]] if opening else line.rsplit(" ", len(names) - 1)
        if not values[-1].isdigit() or not opening and len(values) != len(names):
            raise ValueError(f"not a header line at byte {at}: {line[:80]}")
        content = data[end + 1 : end + 1 + int(values[-1])]
        if len(content) != int(values[-1]):
            raise ValueError(f"the record at byte {at} is shorter than declared")
        at = end + 1 + len(content)
        if opening:
            head = content.decode("utf-8", "replace").split("\n")
            version, names = int(head[0].split(" ")[0]), head[1].split()
        else:
            yield version, dict(zip(names, values, strict=True)), content


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    """A record up to the first of the two line ends after its block; the writer adds the other."""
    head = "".join(f"{name}: {value}\r\n" for name, value in {**fields, "Content-Length": str(len(block))}.items())
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record begins at byte {at}")
        fields = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        n = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + n]
        if data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is shorter than declared")
        at = end + 8 + n


def _http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP header, with its empty line, and payload."""
    end = content.find(b"\r\n\r\n")
    return (content[: end + 4], content[end + 4 :]) if end >= 0 and content.startswith(b"HTTP/") else (b"", content)


def _header_value(head: bytes, name: str) -> str | None:
    found = re.search(rf"^{name}:[ \t]*([^\r\n]*)", head.decode("latin-1"), re.MULTILINE | re.IGNORECASE)
    return found[1] if found else None


def _date(arc: str) -> str:
    d = (arc if arc.isdigit() else _EPOCH).ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _unzipped(content) -> bytes:
    content = bytes(content)
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("path", "content")


def _id(text: str | None) -> int | None:
    return int(text) if text else None


def write_arc(pages: DataFrame, path: str) -> int:
    """Writes page_id, url and html of each row as ARC files, of both versions by turns, and returns their number.

    Payload is the html in UTF-8, empty for null; the id goes into an HTTP header, and a missing url is named urn:none.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    total = rows.agg(F.sum(F.octet_length("html") + 300).alias("n")).first().n or 0
    n = max(1, -(-int(total) // FILE_BYTES))

    def written(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"pages-{part:06d}.arc"
        begun = False
        for batch in batches:
            out = [] if begun else [arc_opening(version, name).removesuffix("\n")]
            begun = True
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                own = "" if page is None else f"X-Page-Id: {page}\r\n"
                content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(html.encode())}\r\n\r\n{html}"
                out.append(arc_header(version, url, _EPOCH, "text/html", len(content.encode()), name) + "\n" + content)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    rows.repartition(n, F.xxhash64("page_id", "url", "html")).mapInArrow(written, "value string").write.option("compression", "gzip").text(path)
    return n


def convert(spark: SparkSession, arc: str, warc: str, n_files: int, min_revisit: int = MIN_REVISIT) -> None:
    """Converts the ARC files in one folder into WARC files in another.

    Equal payloads (same SHA-1 and length) of at least `min_revisit` bytes: the one with the largest page id is the response, also each
    of several records with that id; the others are revisits of it.  Records without id are the smallest; if none has an id, all are responses.
    """

    def index(batch: pa.RecordBatch):
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            for n, (_, fields, content_) in enumerate(read_arc(_unzipped(content.as_buffer()))):
                head, payload = _http(content_)
                rows.append((path, n, _id(_header_value(head, "X-Page-Id")), hashlib.sha1(payload).hexdigest(), len(payload), fields["URL"], fields["Archive-date"]))
        names = ["path", "n", "page_id", "digest", "size", "url", "date"]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    indexed = cut(map_batches(_files(spark, arc), index, "path string, n int, page_id long, digest string, size long, url string, date string"))
    groups = indexed.where(f"size >= {int(min_revisit)}").groupBy("digest", "size").agg(F.max(F.struct("page_id", "url", "date")).alias("kept"), F.count("*").alias("records")).where("records > 1 and kept.page_id is not null").select("digest", "size", "kept")
    revisits = indexed.select("path", "n", "page_id", "digest", "size").join(groups, ["digest", "size"]).where("page_id is null or page_id < kept.page_id")
    plans = revisits.groupBy("path").agg(F.collect_list(F.struct("n", "kept.page_id", "kept.url", "kept.date")).alias("revisits"))

    def converted(batches):
        first = True
        for batch in batches:
            for path, content, revisits in zip(batch.column("path").to_pylist(), batch.column("content"), batch.column("revisits").to_pylist(), strict=True):
                out = []
                name = path.rsplit("/", 1)[-1]
                if first:
                    info = b"software: reachspan\r\nformat: WARC File Format 1.0\r\n"
                    out.append(warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_NAMESPACE, path)}>", "WARC-Date": _date(_EPOCH), "WARC-Filename": name.split(".")[0] + ".warc", "Content-Type": "application/warc-fields"}, info))
                    first = False
                kept = {r["n"]: r for r in revisits or []}
                for n, (_, fields, content_) in enumerate(read_arc(_unzipped(content.as_buffer()))):
                    head, payload = _http(content_)
                    page = _header_value(head, "X-Page-Id")
                    record = {"WARC-Type": "response", "WARC-Record-ID": _record_id(fields["URL"], fields["Archive-date"], page or f"{name}/{n}"), "WARC-Date": _date(fields["Archive-date"]), "WARC-Target-URI": fields["URL"], "WARC-IP-Address": fields["IP-address"], "WARC-Payload-Digest": "sha1:" + hashlib.sha1(payload).hexdigest()}
                    if not head:
                        record |= {"WARC-Type": "resource", "Content-Type": fields["Content-type"]}
                    else:
                        record["Content-Type"] = "application/http; msgtype=response"
                    if page:
                        record["WARC-X-Page-Id"] = page
                    block = content_
                    if n in kept:
                        to = kept[n]
                        record |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "WARC-Refers-To": _record_id(to["url"], to["date"], str(to["page_id"])), "WARC-Refers-To-Target-URI": to["url"], "WARC-Refers-To-Date": _date(to["date"]), "WARC-X-Refers-To-Page-Id": str(to["page_id"])}
                        block = head
                    record["WARC-Block-Digest"] = "sha1:" + hashlib.sha1(block).hexdigest()
                    out.append(warc_record(record, block))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    files = _files(spark, arc).repartition(n_files, "path").join(plans.repartition(n_files, "path"), "path", "left")
    files.mapInArrow(converted, "value binary").select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\r\n").text(warc)


def _record_id(url: str, date: str, own: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{url} {date} {own}')}>"


def read_warcs(spark: SparkSession, warc: str) -> DataFrame:
    """Rows of the response and revisit records of a folder's WARC files: page_id, record_id, url, payload_bytes, payload_digest, record_type, refers_to."""

    def rows_of(batch: pa.RecordBatch):
        rows = []
        for content in batch.column("content"):
            for fields, block in read_warc(_unzipped(content.as_buffer())):
                if fields["WARC-Type"] not in ("response", "resource", "revisit"):
                    continue
                head, payload = _http(block)
                size, digest = len(payload), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "revisit":
                    size = int(_header_value(head, "Content-Length"))
                elif hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"the payload of {fields['WARC-Record-ID']} has another digest")
                rows.append((_id(fields.get("WARC-X-Page-Id")), fields["WARC-Record-ID"], fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], _id(fields.get("WARC-X-Refers-To-Page-Id"))))
        names = ["page_id", "record_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return map_batches(_files(spark, warc), rows_of, "page_id long, record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as ARC, converts them to WARC, reads these back, and deletes the files; all in the shared folder."""
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark)}/archives-{uuid.uuid4()}"
    try:
        n = write_arc(pages, f"{folder}/arc")
        convert(spark, f"{folder}/arc", f"{folder}/warc", n)
        return cut(read_warcs(spark, f"{folder}/warc"))
    finally:
        _delete(spark, folder)
