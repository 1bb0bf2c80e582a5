"""Legacy ARC archives to WARC.

An ARC file is a row of URL records; a ``filedesc`` record opens it, names its version and the fields of
the header lines that follow (version 1 has five, version 2 ten), and each line declares its content's
length. The converter reads lines by those names and contents by their lengths, and makes for each record
the WARC fields that ARC lacks: an identifier, an ISO timestamp, a type, and block and payload digests. Of
HTTP records with equal payloads from ``least`` bytes on, the one that ranks highest is the response; the
others become revisits of it.

Every record is a gzip member of its own, so readers can seek by it. A task packs members into files of
bounded size, which Spark's text writer writes whole, a row a file, so they go to any store that Spark writes and
a lost task is written anew; the writer's line separator is the zero byte that gzip allows as padding at a
file's end. Records are read one by one from a file's compressed bytes. Only keys of records are shuffled: equal
payloads are found by digest, and each file gets the list of its own revisits.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.shared import importable, joined, new_path, stored, tasks_for, tidy

#: The field names that versions 1 and 2 define.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_KEYS = "file string, place long, kind string, target_uri string, date string, payload_bytes long, payload_digest string"
_NAMES = [x.split()[0] for x in _KEYS.split(", ")]
#: Compressed bytes of a file, about.
FILE = 16 << 20


def arc_records(version: int, rows: list[tuple[str, str, bytes]], origin: str = "arborlake", date: str = "20240101000000") -> list[bytes]:
    """The records of one archive of (url, 14-digit date, content): a filedesc record, then one for each row.

    White space in a URL is escaped; an empty URL is "-".
    """
    about = f"{version} 0 {origin}\n{FIELDS[version]}\n".encode()
    line = lambda url, when, kind, n: (f"{url} 0.0.0.0 {when} {kind} {n}" if version == 1 else f"{url} 0.0.0.0 {when} {kind} 200 - - 0 {origin}.arc {n}").encode() + b"\n"
    out = [line(f"filedesc://{origin}.arc", date, "text/plain", len(about)) + about + b"\n"]
    return out + [line(re.sub(r"\s", "%20", url) or "-", when, "text/html", len(content)) + content + b"\n" for url, when, content in rows]


def member(record: bytes) -> bytes:
    """A record as a gzip member without a date."""
    return gzip.compress(record, 6, mtime=0)


def _written(files: DataFrame, path: str) -> None:
    """Writes a file under path for each row of files (value binary)."""
    files.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _binary(value: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], ["value"])


def http_response(payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def write_arc(pages: DataFrame, path: str, *, uri: str, html: str, version: str) -> None:
    """Archives of pages under path: columns for the URI, the page's HTML (null: empty) and the version, 1 or 2.

    A null URI is an empty one; a null version is 1; repeated rows are records of their own; an empty table writes no
    archive; further columns are ignored.
    """
    importable(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytearray] = {}
        for batch in batches:
            for u, h, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, *rest = arc_records(v or 1, [(u or "", "20240101000000", http_response((h or "").encode("utf-8", "surrogatepass")))])
                if v not in held:
                    held[v] = bytearray(member(first))
                for record in rest:
                    held[v] += member(record)
                if len(held[v]) > FILE:
                    yield _binary(bytes(held.pop(v)))
        for v in list(held):
            yield _binary(bytes(held.pop(v)))

    rows = pages.select(F.col(uri).alias("u"), F.col(html).alias("h"), F.col(version).alias("v"))
    _written(rows.coalesce(tasks_for(pages, 32)).mapInArrow(tidy(run), "value binary"), path)


def _opened(content: bytes):
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 16) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def parse_arc(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(place, version, fields, content) of each record of a file; ValueError where it is damaged."""
    f, version, names, place = _opened(content), 0, [], 0
    while line := f.readline():
        here, place = place, place + len(line)
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if not parts[-1].isdigit():
            raise ValueError(f"no length in the header line at {here}")
        length = int(parts[-1])
        block = f.read(length)
        place += len(block)
        if len(block) < length:
            raise ValueError(f"the record at {here} is cut off")
        if parts[0].startswith("filedesc://"):
            about = block.decode("utf-8", "replace").split("\n")
            version = int(about[0].split(" ")[0])
            if version not in FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            names = about[1].split(" ") if len(about) > 1 and about[1] else FIELDS[version].split(" ")
            yield here, version, {"URL": parts[0], "Archive-date": parts[2], "Content-type": parts[3]}, block
            continue
        if not version:
            raise ValueError("no filedesc record at the start")
        spare = len(parts) - len(names)
        if spare < 0:
            raise ValueError(f"fields are missing at {here}")
        yield here, version, dict(zip(names, [" ".join(parts[: spare + 1]), *parts[spare + 1 :]], strict=True)), block


def _content(url: str, block: bytes) -> tuple[str, int]:
    """(record type, where the payload begins) of a record."""
    if url.startswith("filedesc://"):
        return "warcinfo", 0
    if not block.startswith(b"HTTP/"):
        return "resource", 0
    cut = block.find(b"\r\n\r\n") + 4
    return "response", cut if cut >= 4 else len(block)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def arc_keys(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, kind, target_uri, date, payload_bytes, payload_digest) of all records of the ARC files under path."""
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64() if x.endswith("long") else pa.string() for x in _KEYS.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows = batch.column(0)[i].as_py(), []
                for place, _, f, block in parse_arc(batch.column(1)[i].as_py()):
                    kind, cut = _content(f["URL"], block)
                    rows.append((name, place, kind, f["URL"], f.get("Archive-date", ""), len(block) - cut, hashlib.sha1(memoryview(block)[cut:]).hexdigest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], _NAMES)

    return _files(spark, path).mapInArrow(tidy(run), _KEYS)


def _identifier(uri: str, date: str, digest: str, file: str, place: int) -> str:
    h = hashlib.sha1("|".join((uri, date, digest, file, str(place))).encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def _timestamp(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(file: str, place: int, version: int, fields: dict[str, str], block: bytes, first: dict | None = None) -> bytes:
    """The WARC record of an ARC record; with ``first``, its response's (uri, date, file, place), a revisit of that."""
    url, date = fields["URL"], fields.get("Archive-date", "")
    kind, cut = _content(url, block)
    payload = memoryview(block)[cut:]
    digest = hashlib.sha1(payload).hexdigest()
    lines = [("WARC-Type", "revisit" if first else kind), ("WARC-Record-ID", _identifier(url, date, digest, file, place)), ("WARC-Date", _timestamp(date))]
    about = {"warcinfo": "application/warc-fields", "resource": fields.get("Content-type", "")}.get(kind, "application/http; msgtype=response")
    if kind == "warcinfo":
        block = f"software: arborlake\r\nformat: WARC File Format 1.1\r\nsource: ARC version {version}\r\n".encode()
        lines.append(("WARC-Filename", file))
    else:
        lines += [("WARC-Target-URI", url), ("WARC-IP-Address", fields.get("IP-address", "0.0.0.0")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload))]
    if first:
        block = block[:cut]
        lines.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        lines.append(("WARC-Refers-To", _identifier(first["uri"], first["date"], digest, first["file"], first["place"])))
        lines += [("WARC-Refers-To-Target-URI", first["uri"]), ("WARC-Refers-To-Date", _timestamp(first["date"]))]
    lines += [("Content-Type", about), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("Content-Length", len(block))]
    head = "".join(f"{name}: {value}\r\n" for name, value in lines)
    return f"WARC/1.1\r\n{head}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def revisits(spark: SparkSession, arc_path: str, *, least: int = 1000, rank: str = "struct(date, target_uri)") -> DataFrame:
    """(file, list): for each ARC file the places of its revisits, each with its response's uri, date, file and place."""
    keys = stored(arc_keys(spark, arc_path).filter((F.col("kind") == "response") & (F.col("payload_bytes") >= least)).withColumn("rank", F.expr(rank)), "arc-keys")
    best = F.max(F.when(F.col("rank").isNotNull(), F.struct("rank", F.col("target_uri").alias("uri"), "date", "file", "place"))).alias("best")
    first = keys.groupBy("payload_digest").agg(best, F.count("*").alias("n")).filter("n > 1 AND best IS NOT NULL")
    found = joined(keys, first, "payload_digest", keys.count()).filter("NOT (rank <=> best.rank)")
    return found.groupBy("file").agg(F.collect_list(F.struct("place", F.struct("best.uri", "best.date", "best.file", "best.place").alias("first"))).alias("list"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, *, least: int = 1000, rank: str = "struct(date, target_uri)") -> None:
    """Converts all ARC files under arc_path to WARC files under warc_path.

    Records that tie for the highest rank are all responses. A null rank is below all others. Empty payloads
    and files without records are fine; a damaged file raises ValueError.
    """
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bytearray()
        for batch in batches:
            for i in range(batch.num_rows):
                name, first = batch.column(0)[i].as_py(), {x["place"]: x["first"] for x in batch.column(2)[i].as_py() or ()}
                for place, version, fields, block in parse_arc(batch.column(1)[i].as_py()):
                    held += member(warc_record(name, place, version, fields, block, first.get(place)))
                    if len(held) > FILE:
                        yield _binary(bytes(held))
                        held = bytearray()
        if held:
            yield _binary(bytes(held))

    files = _files(spark, arc_path)
    both = files.join(revisits(spark, arc_path, least=least, rank=rank), "file", "left").select("file", "content", "list")
    _written(both.coalesce(tasks_for(files, 32)).mapInArrow(tidy(run), "value binary"), warc_path)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a file; ValueError where it is damaged."""
    f = _opened(content)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one is due")
        fields = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.lower()] = value.strip()
        block = f.read(int(fields["content-length"]))
        if "sha1:" + hashlib.sha1(block).hexdigest() != fields["warc-block-digest"]:
            raise ValueError(f"damaged block of {fields.get('warc-record-id')}")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, type, target_uri, date, payload_bytes, payload_digest, refers_to_uri) of all but warcinfo records.

    Files without records give no rows; repeated records stay; a damaged record raises ValueError.
    Digest and length of responses and resources are of the payload as read; those of revisits are as noted.
    """
    importable(spark)
    names = ["record_id", "type", "target_uri", "date", "payload_bytes", "payload_digest", "refers_to_uri"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for f, block in parse_warc(batch.column(0)[i].as_py()):
                    kind = f["warc-type"]
                    if kind == "warcinfo":
                        continue
                    cut = block.find(b"\r\n\r\n") + 4 if kind == "response" else 0
                    payload = block[cut:] if kind != "response" or cut >= 4 else b""
                    said = f["warc-payload-digest"].removeprefix("sha1:")
                    n, digest = (int(f["x-payload-length"]), said) if kind == "revisit" else (len(payload), hashlib.sha1(payload).hexdigest())
                    if digest != said:
                        raise ValueError(f"damaged payload of {f['warc-record-id']}")
                    rows.append((f["warc-record-id"], kind, f["warc-target-uri"], f["warc-date"], n, digest, f.get("warc-refers-to-target-uri")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "payload_bytes" else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(tidy(run), "record_id string, type string, target_uri string, date string, payload_bytes long, payload_digest string, refers_to_uri string")


def pages_through_archives(pages: DataFrame, least: int = 1000, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Pages to ARC files of both versions, those to WARC files, and a row for each page as read from these.

    (id, payload_bytes, payload_digest, record_type, refers_to). The id travels as the URI's fragment. Null
    HTML is an empty payload; null and repeated ids stay; rows that tie for the largest id of equal payloads
    are all responses; an empty table gives no rows; further columns are ignored.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    uri = F.concat(F.coalesce(url_column, F.lit("")), F.lit("#page="), F.coalesce(F.col(id_column).cast("long").cast("string"), F.lit("")))
    rows = pages.select(uri.alias("uri"), F.col(html_column).alias("html"), (1 + F.pmod(F.crc32(uri.cast("binary")), F.lit(2))).cast("int").alias("version"))
    write_arc(rows, arc, uri="uri", html="html", version="version")
    number = "try_cast(substring_index({0}, '#page=', -1) AS BIGINT)"
    convert(spark, arc, warc, least=least, rank=number.format("target_uri"))
    read = read_warc(spark, warc)
    return read.select(
        F.expr(number.format("target_uri")).alias(id_column),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.expr(number.format("refers_to_uri")).alias("refers_to"),
    )
