"""WARC archives of pages, compressed with Zstandard record by record.

An archive is one file: a skippable frame that holds the dictionary (itself
compressed), one Zstandard frame per WARC record, and a closing skippable frame
of one byte.  Records are ``response`` records with the HTTP head and the html, or
``revisit`` records with the head alone for a payload that another page holds.

Writing: payloads are digested in the JVM, and digests that occur more than once
are reduced to their largest page id by partial aggregation before anything is
joined.  A task packs its pages into archives of about ``ARCHIVE_BYTES``; each
is one value of the text writer, one file each, so any file system that Spark
writes to will do.  (The writer ends each value with a line feed: it's the one
byte of the closing frame.)  Reading: ``binaryFile`` gives one archive a row; a
task walks its frames, checks the frames' checksums and lengths, the WARC
headers, the Content-Length and the digests, and raises :class:`WarcError` at
the first record that doesn't hold.

Defined results: a null html is an empty payload; equal payloads are those of
equal length and SHA-1.  Of rows with equal payloads those with the largest
page_id are responses (all of them, if the row is repeated), the others revisit
it.  A null page_id is smaller than any other; pages of one payload whose ids
are all null are all responses.  A null url is written as ``urn:page:<id>``
and read back as null.  White space and control characters in a url are
percent-encoded.  Other columns of the input are not archived and may have any
name; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import scratch_path

#: Payload bytes of one archive; a larger page has one of its own.
ARCHIVE_BYTES = 16 << 20
#: Pages (with the smallest digests) and bytes of each that the dictionary is trained on.
SAMPLE_PAGES = 1_000
SAMPLE_BYTES = 16 << 10
DICTIONARY_BYTES = 64 << 10
LEVEL = 6
# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
CLOSING = (0x184D2A50).to_bytes(4, "little") + (1).to_bytes(4, "little")
FRAME = (0xFD2FB528).to_bytes(4, "little")
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL = re.compile(r"[\x00-\x20\x7f]")

RECORDS = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
           "warc_date string, payload binary")


class WarcError(ValueError):
    """A frame or record that doesn't hold."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> bytes:
    """A dictionary from a bounded sample: the first ``SAMPLE_BYTES`` of
    ``SAMPLE_PAGES`` distinct pages at most, chosen by their hashes.  Empty if there is
    too little text to learn from.  A hash lets through about twice as many before
    anything is shuffled or sorted."""
    text = F.encode(F.col(f"`{html_col}`").cast("string"), "UTF-8")
    share = min(1.0, 2 * SAMPLE_PAGES / max(1, pages.count()))
    head = pages.select(F.substring(text, 1, SAMPLE_BYTES).alias("h")).where(F.length("h") > 0)
    head = head.withColumn("d", F.xxhash64("h")).where(F.pmod("d", F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = head.groupBy("d").agg(F.first("h").alias("h")).orderBy("d").limit(SAMPLE_PAGES).collect()
    if len(rows) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r["h"]) for r in rows]).as_bytes()
    except zstandard.ZstdError:  # samples too small or too alike
        return b""


def _dictionary_frame(dictionary: bytes) -> bytes:
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return SKIPPABLE.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


def _record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date),
              ("WARC-Target-URI", f"urn:page:{page_id}" if url is None else _URL.sub(lambda m: f"%{ord(m[0]):02X}", url)),
              ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to)), ("WARC-Truncated", "length")]
    fields.append(("Content-Length", str(len(block))))
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def marked(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html as binary, refers_to): refers_to is the largest page id
    with the same payload where that is another page, else null."""
    html = F.encode(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")), "UTF-8")
    source = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                          html.alias("html"))
    source = source.withColumns({"d": F.sha1("html"), "n": F.length("html")})
    repeated = (source.groupBy("d", "n").agg(F.count(F.lit(1)).alias("c"), F.max("page_id").alias("top"))
                .where("c > 1 AND top IS NOT NULL").select("d", "n", "top"))
    top = F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))  # null without copies
    return source.join(repeated, ["d", "n"], "left").select("page_id", "url", "html", top.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, dictionary: bytes = b"", id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", date: datetime | None = None) -> None:
    """Write the archives as files under ``path``."""
    stamp = (date or datetime(2001, 6, 1, tzinfo=timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        lead = _dictionary_frame(dictionary)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True)
        parts, size = [lead], 0
        for batch in batches:
            ids, urls, refers = (batch.column(k).to_pylist() for k in (0, 1, 3))
            for k in range(batch.num_rows):
                payload = batch.column(2)[k].as_py()
                if size and size + len(payload) > ARCHIVE_BYTES:
                    yield _archive(parts)
                    parts, size = [lead], 0
                parts.append(squeeze.compress(_record(ids[k], urls[k], payload, base32_sha1(payload), refers[k],
                                                      refers[k] is not None, stamp)))
                size += max(1, len(payload))
        if len(parts) > 1:
            yield _archive(parts)

    def _archive(parts):
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts) + CLOSING], pa.binary())], names=["archive"])

    archives = marked(pages, id_col, url_col, html_col).mapInArrow(run, "archive binary")
    archives.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def frames(raw: bytes):
    """(start, stop, kind) of every frame: kind 'skip' or 'data'.  The end of a data
    frame is found from its block headers, without decompressing."""
    at, n = 0, len(raw)
    while at < n:
        magic = raw[at:at + 4]
        if len(magic) < 4:
            raise WarcError(f"{n - at} stray bytes at the end")
        if int.from_bytes(magic, "little") & 0xFFFFFFF0 == 0x184D2A50:
            stop = at + 8 + int.from_bytes(raw[at + 4:at + 8], "little")
            kind = "skip"
        elif magic == FRAME:
            try:
                stop = at + zstandard.frame_header_size(raw[at:at + 18])
                checked = zstandard.get_frame_parameters(raw[at:at + 18]).has_checksum
            except zstandard.ZstdError as e:
                raise WarcError(f"frame header at byte {at}: {e}") from None
            while True:
                head = int.from_bytes(raw[stop:stop + 3], "little")
                stop += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
                if head & 1 or stop > n:
                    break
            stop += 4 if checked else 0
            kind = "data"
        else:
            raise WarcError(f"no frame at byte {at}")
        if stop > n:
            raise WarcError(f"the frame at byte {at} is cut off")
        yield at, stop, kind
        at = stop


def parse_record(raw: bytes) -> dict:
    """The headers of one record, lower-cased, with ``block``; checked."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or lines[0] != VERSION:
        raise WarcError(f"not a {VERSION} record: {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"not a header: {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not fields.get(name):
            raise WarcError(f"{name} is missing")
    if not fields["content-length"].isdecimal() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"{fields['warc-record-id']}: {len(rest) - 4} bytes where Content-Length says {fields['content-length']}")
    fields["block"] = rest[:-4]
    digest = fields.get("warc-block-digest")
    if digest is not None and digest != "sha1:" + base32_sha1(fields["block"]):
        raise WarcError(f"{fields['warc-record-id']}: block digest")
    return fields


def _page_id(name: str):
    found = re.fullmatch(r"<urn:page:(null|-?\d+)>", name)
    if not found:
        raise WarcError(f"record id {name!r}")
    return None if found[1] == "null" else int(found[1])


def _row(fields: dict) -> tuple:
    kind, name = fields["warc-type"], fields["warc-record-id"]
    if kind not in ("response", "revisit"):
        raise WarcError(f"{name}: type {kind}")
    head, found, payload = fields["block"].partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", head)
    if not found or not head.startswith(b"HTTP/") or size is None:
        raise WarcError(f"{name}: no HTTP head")
    size, digest = int(size[1]), fields.get("warc-payload-digest", "")
    page_id = _page_id(name)
    if kind == "response" and (len(payload) != size or digest != "sha1:" + base32_sha1(payload)):
        raise WarcError(f"{name}: payload of {len(payload)} bytes, {size} stated, or its digest")
    if kind == "revisit" and (payload or not re.fullmatch("sha1:[A-Z2-7]{32}", digest) or not fields.get("warc-refers-to")):
        raise WarcError(f"{name}: not a revisit of an equal payload")
    url = fields.get("warc-target-uri")
    return (page_id, None if url == f"urn:page:{page_id}" else url, kind, size, digest[5:],
            _page_id(fields["warc-refers-to"]) if kind == "revisit" else None, fields["warc-date"],
            payload if kind == "response" else None)


def read_archive(raw: bytes):
    """The rows of one archive, checked record by record."""
    unpack = None
    for number, (start, stop, kind) in enumerate(frames(raw)):
        if kind == "skip":
            if number == 0 and int.from_bytes(raw[:4], "little") == SKIPPABLE:
                stored = raw[start + 8:stop]
                if stored[:4] == FRAME:
                    stored = zstandard.ZstdDecompressor().decompress(stored)
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stored))
            continue
        unpack = unpack or zstandard.ZstdDecompressor()
        try:
            record = unpack.decompress(raw[start:stop])
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at byte {start}: {e}") from None
        yield _row(parse_record(record))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives under ``path`` (:data:`RECORDS`); the
    payload of a revisit is null."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    names = [c.split()[0] for c in RECORDS.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in RECORDS.split(", ")]

    def run(batches):
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)
        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for row in read_archive(batch.column(0)[k].as_py()):
                    rows.append(row)
                    size += len(row[-1] or b"") + 200
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, RECORDS)


def restored(records: DataFrame) -> DataFrame:
    """The records with the payloads of revisits taken from their responses."""
    held = records.where("record_type = 'response'").groupBy(
        F.col("page_id").alias("h_id"), F.col("payload_digest").alias("h_digest")).agg(F.first("payload").alias("h_payload"))
    out = records.join(held, (F.col("refers_to") == F.col("h_id")) & (F.col("payload_digest") == F.col("h_digest")), "left")
    return out.select(*[c for c in records.columns if c != "payload"], F.coalesce("payload", "h_payload").alias("payload"))


def store_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Train a dictionary, write the archives to the shared scratch folder, read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "llm-warc")
    write_archives(pages, path, train_dictionary(pages, id_col, html_col), id_col, url_col, html_col)
    return read_archives(spark, path)
