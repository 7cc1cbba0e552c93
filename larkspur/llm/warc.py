"""WARC archives: a writer that stores equal payloads once, and a reader that salvages what damage leaves.

The writer makes records with DataFrame functions and deflates each to a gzip member of its own. A member is one value
of Spark's text writer, whose line separator is the member's last byte, so archives are written by executors to any
file system that Spark reaches. The reader takes archives whole, in gzip members or plain. A record that fails a check (version line, header, length, end marks,
digests) is not trusted: the reader searches on for the next version line or gzip member at which a record does pass,
goes on from there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.llm.shared import read_table, rows_in_chunks, scratch_path, through_arrow

#: Payloads of fewer bytes are stored each time.
REVISIT_FROM = 1000
#: Bytes of an archive, about.
ARCHIVE_BYTES = 16 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = "\r\n"
_LEVEL = 5


def record_id(number: Column, salt: Column) -> Column:
    """A version 8 UUID that holds `number` (64 bits); one made of `salt` where it is null."""
    h = F.lpad(F.lower(F.hex(number)), 16, "0")
    own = F.concat(F.lit("6c61726b-7370-8"), F.substring(h, 1, 3), F.lit("-8"), F.substring(h, 4, 1), F.lit("00-"), F.substring(h, 5, 12))
    s = F.md5(F.coalesce(salt, F.lit("")).cast("binary"))
    none = F.concat(F.lit("6e756c6c-7370-8"), F.substring(s, 1, 3), F.lit("-8"), F.substring(s, 4, 1), F.lit("00-"), F.substring(s, 5, 12))
    return F.concat(F.lit("<urn:uuid:"), F.coalesce(own, none), F.lit(">"))


def number_of(uuid: str | None) -> int | None:
    """The number that `record_id` put into a UUID; null for any other."""
    m = re.fullmatch(r"<urn:uuid:6c61726b-7370-8([0-9a-f]{3})-8([0-9a-f])00-([0-9a-f]{12})>", uuid or "")
    if not m:
        return None
    n = int("".join(m.groups()), 16)
    return n - (1 << 64) if n >> 63 else n


def decided(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, payload, size, digest, original (the response's page_id where this one is a revisit).

    Only digests that occur twice go into the join; of them the largest page_id is the response.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    large = rows.where(F.col("size") >= revisit_from)
    held = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select(F.col("digest").alias("key"), "last")
    out = rows.join(held, (F.col("digest") == F.col("key")) & (F.col("size") >= revisit_from), "left")
    return out.withColumn("original", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))).drop("key", "last")


def records(rows: DataFrame) -> DataFrame:
    """One string column, `value`: a WARC record for each row of `decided`."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_EOL))
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.lit("urn:unknown"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}"), line("Content-Length", F.col("size").cast("string")), F.lit(_EOL))
    revisit = F.col("original").isNotNull()
    rows = rows.withColumn("block", F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload"))))
    value = F.concat(
        F.lit(f"WARC/1.1{_EOL}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.concat_ws("|", "url", "digest"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("block").cast("binary")))),
        F.coalesce(F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("original"), F.lit(""))))), F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(_EOL),
        F.col("block"),
        F.lit(_EOL * 2),
    )
    return rows.select(value.alias("value"))


def member(record: bytes) -> bytes:
    """A gzip member without its last byte, which is zero: the highest byte of a length below 16 MiB. Longer records get an empty member after them."""
    made = gzip.compress(record, _LEVEL, mtime=0)
    return (made if made[-1] == 0 else made + gzip.compress(b"", mtime=0))[:-1]


def _deflated(archive_bytes: int):
    """Rows (value) to (archive, value): members, and the archive of each, which ends before it would outgrow `archive_bytes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held = TaskContext.get().partitionId(), 0, 0
        for batch in rows_in_chunks(batches, 0):
            names, members = [], []
            for record in batch.column(0).to_pylist():
                made = member(record)
                if held and held + len(made) > archive_bytes:
                    number, held = number + 1, 0
                held += len(made) + 1
                names.append(f"{task:06d}-{number:06d}")
                members.append(made)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(members, pa.binary())], ["archive", "value"])

    return run


def write_archives(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record for each row of `pages` (page_id, url, html) to archives of at most `archive_bytes`, or one longer record, deflated, in folder `path`.

    Null html is an empty payload, a null url is urn:unknown, a null page_id gets a record id made from url and
    digest; all rows with the largest page_id of equal payloads are responses; very long payloads are records of their
    own length; an empty table writes no records; other columns are ignored, whatever their names.
    """
    members = through_arrow(records(decided(pages, revisit_from)).select(F.col("value").cast("binary")), _deflated(archive_bytes), "archive string, value binary")
    members.select("archive", F.col("value").cast("string")).write.option("lineSep", "\0").partitionBy("archive").text(path)


class Record(NamedTuple):
    """A valid record at [start, stop) of its archive, or a gap (`reason` set) between valid ones."""

    start: int
    stop: int
    type: str | None = None
    id: str | None = None
    uri: str | None = None
    refers_to: str | None = None
    payload_digest: str | None = None
    payload_bytes: int | None = None
    payload: bytes | None = None
    reason: str | None = None


class Damaged(ValueError):
    """A record that fails a check."""


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*)\r\n")


def _digest_ok(said: str | None, data: bytes) -> bool:
    """sha1 in hexadecimal or base 32; other algorithms are not judged."""
    if not said or not said.lower().startswith("sha1:"):
        return True
    value, made = said[5:].strip(), hashlib.sha1(data)
    if len(value) == 40:
        return value.lower() == made.hexdigest()
    import base64

    return value.upper() == base64.b32encode(made.digest()).decode()


def parse_at(data: bytes, at: int) -> Record:
    """The record that starts at `at`; Damaged if a check fails."""
    version = _VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    pos, fields = version.end(), {}
    while data[pos : pos + 2] != b"\r\n":
        field = _FIELD.match(data, pos)
        if not field:
            raise Damaged("bad header")
        name = field[1].decode("ascii").lower()
        if name in fields and name != "warc-concurrent-to":
            raise Damaged("repeated field")
        fields[name] = field[2].decode("utf-8", "replace")
        pos = field.end()
    pos += 2
    if not fields.get("content-length", "").isdigit() or not fields.get("warc-type") or not fields.get("warc-record-id"):
        raise Damaged("header lacks a field")
    stop = pos + int(fields["content-length"])
    if stop + 4 > len(data):
        raise Damaged("cut short")
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("no end mark")
    block = data[pos:stop]
    if not _digest_ok(fields.get("warc-block-digest"), block):
        raise Damaged("block digest differs")
    kind, payload, size, digest = fields["warc-type"], block, len(block), None
    said = fields.get("warc-payload-digest")
    if fields.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        if cut < 0:
            raise Damaged("no HTTP header")
        payload = block[cut + 4 :]
        declared = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)\r$", block[: cut + 2])
        size = int(declared[1]) if kind == "revisit" and declared else len(payload)
    if kind == "revisit":
        digest = said[5:].lower() if said and said.lower().startswith("sha1:") and len(said) == 45 else None
    else:
        if not _digest_ok(said, payload):
            raise Damaged("payload digest differs")
        digest = hashlib.sha1(payload).hexdigest()
    return Record(at, stop + 4, kind, fields["warc-record-id"], fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, size, payload)


def _plain(data: bytes) -> Iterator[Record]:
    at, size = 0, len(data)
    while at < size:
        try:
            found = parse_at(data, at)
        except Damaged as e:
            nxt = at + 1
            while (nxt := data.find(b"WARC/1.", nxt)) >= 0:
                try:
                    parse_at(data, nxt)
                    break
                except Damaged:
                    nxt += 1  # a cut may have left the version line within a line, so any place is tried
            stop = nxt if nxt >= 0 else size
            yield Record(at, stop, reason=str(e))
            at = stop
        else:
            yield found
            at = found.stop


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at `at` holds, up to the first error, its end, and the error."""
    z, parts, stop = zlib.decompressobj(31), [], at
    try:
        while not z.eof and stop < len(data):  # piece by piece: what follows the member is not copied
            parts.append(z.decompress(data[stop : stop + (1 << 15)]))
            stop = min(len(data), stop + (1 << 15))
    except zlib.error:
        z, again = zlib.decompressobj(31), []
        try:
            for i in range(at, stop, 1 << 15):
                z.decompress(data[i : min(stop, i + (1 << 15))])
            for i in range(stop, min(len(data), stop + (1 << 15))):
                again.append(z.decompress(data[i : i + 1]))
        except zlib.error:
            pass
        return b"".join(parts + again), stop, "bad gzip data"
    return b"".join(parts), stop - len(z.unused_data), None if z.eof else "cut short"


def _member(data: bytes, at: int) -> tuple[list[Record], int | None, str | None]:
    """The valid records of the gzip member at `at`, its end (None if its data are damaged), and what is wrong with it; Damaged if nothing can be read."""
    text, stop, broken = _inflated(data, at)
    inner = list(_plain(text))
    found = [x for x in inner if not x.reason]
    error = broken or next((x.reason for x in inner if x.reason), None)
    if error and not found:
        raise Damaged(error)
    return found, None if broken else stop, error


def _starts(data: bytes, at: int) -> tuple[list[Record], int | None, str | None]:
    """What starts at `at`, a gzip member or a plain record, as `_member` says it."""
    if data[at : at + 3] == b"\x1f\x8b\x08":
        return _member(data, at)
    one = parse_at(data, at)
    return [one], one.stop, None


_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


def salvage(data: bytes) -> Iterator[Record]:
    """Records and gaps of an archive, in order; together they cover all its bytes. An empty archive has neither.

    Gzip members and plain records may follow each other. Of a damaged member the valid records are kept, beside a gap
    with the same bounds.
    """
    at, size = 0, len(data)
    while at < size:
        found, stop, error = [], None, None
        try:
            found, stop, error = _starts(data, at)
        except Damaged as e:
            error = str(e)
        if stop is None:
            for m in _START.finditer(data, at + 1):
                try:
                    _starts(data, m.start())
                except Damaged:
                    continue
                stop = m.start()
                break
            else:
                stop = size
        yield from (x._replace(start=at, stop=stop) for x in found)
        if error:
            yield Record(at, stop, reason=error)
        at = stop


_OUT = "path string, start long, stop long, type string, record_id string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, reason string, number long, refers_to_number long"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of all archives in a folder: valid records, and gaps (reason is set) with their byte ranges.

    `number` and `refers_to_number` are the numbers in record ids that `record_id` made. Without `payloads` that
    column is null. Archives are read whole, so that they must be below 2 GB, as the writer's are; folders named
    archive=... below the folder are read too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *[pa.int64()] * 2, *[pa.string()] * 5, pa.int64(), pa.binary(), pa.string(), *[pa.int64()] * 2]
        names = [x.split()[0] for x in _OUT.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                where, rows, held = batch.column(0)[i].as_py(), [], 0
                for x in salvage(batch.column(1)[i].as_py()):
                    rows.append((where, *(x._replace(payload=x.payload if payloads else None)), number_of(x.id), number_of(x.refers_to)))
                    held += len(x.payload or b"") if payloads else 0
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return through_arrow(files, run, _OUT)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path, payloads=False)
    # archives just written have no gaps; if one has, rows would be missing
    found = found.where(F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("a gap in "), "path", F.lit(": "), "reason")).cast("boolean")))
    return found.select(F.col("number").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_number").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest AS k, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN g ON payload_digest = k AND payload_bytes >= 1000
"""

QUERIES = {"op6_warc": op6_warc}
ORACLES: dict[str, str] = {"op6_warc": ORACLE}
