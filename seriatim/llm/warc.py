"""Web archives: ARC and WARC files as text sinks and sources, and a converter from the legacy format.

Archives are written by Spark's text writer, a file for each partition, with the record separator as line
separator, so they go wherever Spark can write; they are read with the binary-file source, so a task holds one
compressed file at a time (2 GB at most) and parses it as a stream, record by record. Payloads stay bytes
throughout, whatever their encoding. Gzip is by file.

ARC, versions 1 and 2. A file begins with a version block
    filedesc://<name> <ip> <date> text/plain <length> NL <version> <reserved> <origin> NL <field names> NL
and each record is one header line, content of the declared length, and a newline. The version block's own field names
say what a header line holds: five fields in version 1, ten in version 2. URL and content type may hold spaces, so the line is read by the
shape of the fields between them. A line that is no header, or a length that does not fit, makes one damaged record, and reading goes on
at the next header line with a 14-digit date; ``damaged`` counts them by file. The converter synthesises what WARC needs beyond that: a record id
(a name-based UUID of URI, date and payload digest), the date in W3C form (1970 for one that is none), the type (warcinfo for the version block,
response for HTTP content, resource otherwise), the address, and SHA-1 digests of block and payload.

Deduplication: of the records with equal payloads of ``least`` bytes or more, the one with the largest item id is a response and
the others are revisits that refer to it. Null html counts as empty; a null item id ranks lowest; of rows that
repeat an item id and payload, one is the response. White space in a URI is percent-encoded, a null URI becomes "-". Empty
tables give empty archives. Only page_id, url and html are read, whatever the names of other columns; one page of any length is a record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import mapped, shared_dir, stored
from ._text import slices

#: The fields of an ARC header line by version, as the version block names them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ITEM = "X-Item-Id"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
CONVERTED = "item_id long, uri string, date string, ip string, mime string, type string, http binary, payload binary, payload_bytes long, payload_digest string, row long"
CONVERTED_KINDS = [pa.int64(), *[pa.string()] * 5, pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
#: The shape of a header line's fields; others are one word. The stricter date finds the next header after damage.
SHAPES = {"URL": r"(.+?)", "IP-address": r"([0-9A-Fa-f.:]+|-)", "Archive-date": r"(\S+)", "Content-type": r"(.*?)", "Archive-length": r"(\d{1,12})"}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_lines(index: int, rows: Iterator[tuple[int | None, str | None, str | None]], version: int) -> Iterator[str]:
    """The version block and records of one ARC file, without the newline after each."""
    about = f"{version} 0 seriatim\n{ARC_FIELDS[version]}\n"
    rest = "" if version == 1 else f"200 - - 0 part-{index:05d}.arc "
    yield f"filedesc://part-{index:05d}.arc 0.0.0.0 20200101000000 text/plain {rest}{len(about)}\n{about}"
    for item, url, html in rows:
        payload = html or ""
        n = len(payload.encode())
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n" + (f"{ITEM}: {item}\r\n" if item is not None else "") + "\r\n"
        uri = re.sub(r"\s", lambda m: quote(m[0]), url) if url else "-"
        at = datetime(2020, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=(item or 0) % 10**8)
        rest = "" if version == 1 else f"200 - - 0 part-{index:05d}.arc "
        yield f"{uri} 0.0.0.0 {at:%Y%m%d%H%M%S} text/html {rest}{len(http) + n}\n{http}{payload}"


def write_arc(pages: DataFrame, path: str) -> None:
    """Writes (page_id, url, html) as ARC files; even partitions as version 1, odd ones as version 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            for part in slices(batches, "html"):
                yield from zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")))

        held, size = [], 0
        for line in arc_lines(index, rows(), 1 + index % 2):
            held.append(line)
            size += len(line)
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    typed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    mapped(typed, run, "value string").write.options(**GZIP).option("lineSep", "\n").text(path)


def opened(content: bytes) -> io.BufferedReader:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw, 1 << 16)


def header_pattern(fields: list[str], date: str | None = None) -> re.Pattern:
    return re.compile(" ".join(date if date and f == "Archive-date" else SHAPES.get(f, r"(\S+)") for f in fields) + r"\s*$")


def version_fields(content: bytes) -> list[str]:
    """The field names that a version block declares, or those of the version it names, or of version 1."""
    lines = content.decode("utf-8", "replace").splitlines()
    if len(lines) >= 2 and {"URL", "Archive-date", "Archive-length"} <= set(lines[1].split()):
        return lines[1].split()
    return ARC_FIELDS[2 if lines and lines[0].split()[:1] == ["2"] else 1].split()


class Rewindable:
    """A stream of which what was read last can be given back."""

    def __init__(self, stream: io.BufferedReader):
        self.stream, self.held, self.at = stream, b"", 0

    def readline(self) -> bytes:
        end = self.held.find(b"\n", self.at) + 1
        if end:
            line, self.at = self.held[self.at : end], end
            return line
        start, self.held, self.at = self.held[self.at :], b"", 0
        return start + self.stream.readline()

    def read(self, n: int) -> bytes:
        start = self.held[self.at : self.at + n]
        self.at += len(start)
        return start + self.stream.read(n - len(start)) if len(start) < n else start

    def back(self, data: bytes) -> None:
        if self.held[max(0, self.at - len(data)) : self.at] == data:
            self.at -= len(data)
        else:
            self.held, self.at = data + self.held[self.at :], 0


def arc_records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record; an empty header for what is damaged. A version block counts at the file's start only.

    A record counts if a line end and another header, or the end, follow the declared length. Else its length is wrong: what was read is
    given back, and the search for the next header starts after its own header line.
    """
    fields = ARC_FIELDS[1].split()
    reader = Rewindable(stream)
    line = reader.readline()
    if line.startswith(b"filedesc://"):
        words = line.decode("utf-8", "replace").split()
        content = reader.read(int(words[-1])) if words[-1].isdigit() else b""
        fields = version_fields(content)
        yield dict(zip(("URL", "IP-address", "Archive-date", "Content-type"), [*words, "", "", ""])), content
        line = reader.readline()
    usual, strict = header_pattern(fields), header_pattern(fields, r"(\d{14})")

    def followed() -> bool:
        """Whether a line end and a header, or the end, come next; reads nothing for good."""
        seen = [reader.readline()]
        good = not seen[0].strip()
        while good and seen[-1] and not seen[-1].strip():
            seen.append(reader.readline())
        if good and seen[-1]:
            good = usual.match(seen[-1].decode("utf-8", "replace")) is not None
        reader.back(b"".join(seen))
        return good

    lost = False
    while line:
        if line.strip():
            found = (strict if lost else usual).match(line.decode("utf-8", "replace"))
            if found:
                header = dict(zip(fields, found.groups()))
                n = int(header["Archive-length"])
                content = reader.read(n)
                if len(content) == n and followed():
                    lost = False
                    yield header, content
                else:
                    reader.back(content)
                    found = None
            if not found and not lost:
                lost = True
                yield {}, b""
        line = reader.readline()


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """(HTTP header with its blank line, payload); no header for other content."""
    if content.startswith(b"HTTP/") and (at := content.find(b"\r\n\r\n")) >= 0:
        return content[: at + 4], content[at + 4 :]
    return b"", content


def http_field(http: bytes, name: str) -> str | None:
    found = re.search(rf"^{re.escape(name)}:[ \t]*([^\r\n]*)", http.decode("latin-1"), re.MULTILINE | re.IGNORECASE)
    return found[1] if found else None


def w3c(date: str) -> str:
    """An ARC date in W3C form; what is missing of the time counts as 0."""
    try:
        return f"{datetime.strptime(date[:14].ljust(14, '0'), '%Y%m%d%H%M%S'):%Y-%m-%dT%H:%M:%SZ}"
    except ValueError:
        return "1970-01-01T00:00:00Z"


def number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d{1,18}", text) else None


def in_batches(rows: Iterator[tuple], sizes: int, kinds: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Record batches of about 1 MB; ``sizes`` is the column whose length counts."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row[sizes] or b"")
        if size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def read_arc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Converted records of ARC files: what a WARC record of each needs, see CONVERTED. Damaged ones have the type damaged."""

    def rows(content: bytes, file: str) -> Iterator[tuple]:
        base = int.from_bytes(hashlib.sha1(file.rsplit("/", 1)[-1].encode()).digest()[:4]) << 31
        for k, (header, block) in enumerate(arc_records(opened(content))):
            if not header:
                yield None, None, None, None, None, "damaged", None, None, 0, None, base + k
                continue
            http, payload = http_parts(block)
            kind = "warcinfo" if k == 0 and header["URL"].startswith("filedesc://") else "response" if http else "resource"
            yield number(http_field(http, ITEM)), header["URL"], w3c(header["Archive-date"]), header["IP-address"], header.get("Content-type"), kind, http, payload if with_payload else None, len(payload), digest(payload), base + k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, file in zip(batch.column("content"), batch.column("path").to_pylist()):
                yield from in_batches(rows(content.as_py(), file), 7, CONVERTED_KINDS, [x.split()[0] for x in CONVERTED.split(", ")])

    return mapped(spark.read.format("binaryFile").load(path).select("path", "content"), run, CONVERTED)


def damaged(spark: SparkSession, path: str) -> int:
    """How many damaged places the ARC files hold."""
    return read_arc(spark, path, with_payload=False).where("type = 'damaged'").count()


def record_id(uri: str, date: str, payload_digest: str, item: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{uri} {date} {payload_digest} {item}')}>"


def warc_record(item, uri, date, ip, mime, kind, http, payload, n, payload_digest, refers) -> bytes:
    """A WARC/1.0 record without the two line ends after it. A revisit keeps the HTTP header and leaves out the payload."""
    block = http if refers else http + payload
    head = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if refers else kind}",
        f"WARC-Record-ID: {record_id(uri, date, payload_digest, item)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {uri}"] if kind != "warcinfo" else []),
        *([f"WARC-IP-Address: {ip}"] if ip not in (None, "", "-", "0.0.0.0") else []),
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        *([f"X-Payload-Length: {n}"] if refers else []),
    ]
    if refers:
        first = (refers["uri"], refers["date"], payload_digest, refers["item_id"])
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(*first)}", f"WARC-Refers-To-Target-URI: {refers['uri']}", f"WARC-Refers-To-Date: {refers['date']}", f"X-Refers-To-Item: {refers['item_id']}"]
    head += [f"Content-Type: {'application/http; msgtype=response' if http else (mime or 'application/octet-stream')}", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = 0) -> int:
    """ARC files to WARC files, with revisit records for repeated payloads; the number of damaged places that were left out."""
    narrow = stored(read_arc(spark, arc_path, with_payload=False).select("type", "payload_bytes", "payload_digest", "item_id", "row", "uri", "date"), "arc-records")
    first = narrow.where("type = 'response'").where(F.col("payload_bytes") >= least)
    repeated = stored(first.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("item_id", "row", "uri", "date")).alias("top")).where("n > 1").select("payload_digest", "top"), "warc-repeated")
    rows = read_arc(spark, arc_path).where("type <> 'damaged'").join(repeated, "payload_digest", "left")
    refers = F.when((F.col("row") != F.col("top.row")) & (F.col("type") == "response"), F.col("top"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "payload"):
            yield pa.RecordBatch.from_arrays([pa.array([warc_record(*r) for r in zip(*(c.to_pylist() for c in part.columns))], pa.binary())], names=["value"])

    wide = rows.select("item_id", "uri", "date", "ip", "mime", "type", "http", "payload", "payload_bytes", "payload_digest", refers.alias("refers"))
    # the cast keeps bytes that are no UTF-8, and the writer writes them as they are
    lines = mapped(wide, run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.options(**GZIP).option("lineSep", "\r\n\r\n").text(warc_path)
    return narrow.where("type = 'damaged'").count()


def warc_records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            return
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields.get("content-length", 0)))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per response or revisit: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, uri, date.

    A response's length and digest are taken from its payload as read, a revisit's from its header (null length where it has none).
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, uri string, date string"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 3]

    def rows(content: bytes) -> Iterator[tuple]:
        for fields, block in warc_records(opened(content)):
            kind = fields.get("warc-type")
            if kind in ("response", "revisit"):
                http, payload = http_parts(block)
                if kind == "response":
                    n, d = len(payload), digest(payload)
                else:
                    n, d = number(fields.get("x-payload-length") or http_field(http, "Content-Length")), fields.get("warc-payload-digest", "").removeprefix("sha1:")
                yield number(http_field(http, ITEM)), n, d, kind, number(fields.get("x-refers-to-item")), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from in_batches(rows(content.as_py()), 2, kinds, [x.split()[0] for x in schema.split(", ")])

    return mapped(spark.read.format("binaryFile").load(path).select("content"), run, schema)


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages to ARC files, these to WARC files, and the WARC files read back."""
    spark = pages.sparkSession
    root = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex[:12]}"
    write_arc(pages, f"{root}/arc")
    convert(spark, f"{root}/arc", f"{root}/warc", least)
    return read_warc(spark, f"{root}/warc")
