"""Writing pages as WARC archives with Spark's own writer, and a reader that salvages damaged archives.

A record becomes one gzip member. The text writer puts raw bytes on any file system that Spark can reach and ends each
row by a separator; a member's last byte is the high byte of its length, which is 0 below 16 MiB, so that byte is left
to the separator. (A longer record is followed by an empty member.) The files are plain concatenated members.

The reader checks every member (gzip's CRC), header, length, closing lines and block digest. After a failed check it
looks for the next member or version line from which a record holds all checks again, goes on from there, and logs the
bytes between as a quarantined gap. What a damaged member did inflate is searched in the same way, so it costs only the
records that are hurt; of such a member only records whose own block digest holds are believed. A damaged plain record
with a believable length is skipped as a whole: records inside its payload are marked as embedded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads below this many bytes are always written in full.
REVISIT_BYTES = 1000
RECORDS_PER_FILE, LEVEL = 5000, 4
#: Bytes of a file at most (unless one record is longer), and payloads from which on records are written apart.
FILE_BYTES, LONG_BYTES = 256 << 20, 1 << 20
#: WARC date of records that come without one.
NO_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/"
START, LINE = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r?\n"), re.compile(rb"WARC/\d\.\d\r?\n")
FIELDS = "path string, start long, stop long, gap string, record_type string, record_id string, uri string, page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary, inner_start long, inner_stop long, embedded boolean"


def record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed WARC record; with ``refers_to`` a revisit that holds the response's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", NO_DATE)]
    head += [("WARC-Target-URI", clean)] if clean else []
    head += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())]
    head += [("X-Page-Id", str(page))] if page is not None else []
    if refers_to is not None:
        head += [("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to)), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as one gzip member; if its last byte isn't 0, an empty member follows."""
    pack = lambda d: (c := zlib.compressobj(LEVEL, zlib.DEFLATED, 31)).compress(d) + c.flush()
    out = pack(data)
    return out if out[-1] == 0 else out + pack(b"")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for each row into ``path``, a folder on any file system that Spark reaches.

    Of rows with equal payloads of ``REVISIT_BYTES`` or more, those with the largest id are responses and the others
    revisit it; a row without an id is always a response. Null html is an empty payload. Other columns are ignored; an
    empty table leaves a folder without records.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # Only digests leave the map side; groups of one need no entry.
    groups = rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(groups.select(F.col("digest").alias("d"), F.col("size").alias("s"), "first"), (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    rows = rows.select("page_id", "url", "payload", "digest", F.when(F.col("first") > F.col("page_id"), F.col("first")).alias("refers_to"), (F.col("size") + F.coalesce(F.octet_length("url"), F.lit(0))).alias("bytes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = lambda x: None if pd.isna(x) else int(x)
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256].astype({"page_id": "object", "refers_to": "object"})
                yield pd.DataFrame({"member": [member(record(whole(p), u, b, d, whole(r)))[:-1] for p, u, b, d, r in part[["page_id", "url", "payload", "digest", "refers_to"]].itertuples(index=False)]})

    # Files are bounded in bytes: as many records go into one as would fit if all were as long as the longest of them.
    size = F.octet_length(html_col) + F.coalesce(F.octet_length(F.col(url_col).cast("string")), F.lit(0))
    longest = pages.agg(F.max(F.when(size <= LONG_BYTES, size)).alias("short"), F.max(size).alias("all")).first()
    fit = lambda most: max(1, min(RECORDS_PER_FILE, FILE_BYTES // ((most or 0) + 2000)))
    write = lambda some, most, mode: some.mapInPandas(run, "member binary").select(F.col("member").cast("string").alias("value")).write.mode(mode).option("lineSep", "\0").option("maxRecordsPerFile", fit(most)).text(path)
    if (longest["all"] or 0) <= LONG_BYTES:
        write(rows, longest["all"], "errorifexists")
    else:
        write(rows.filter(F.col("bytes") <= LONG_BYTES), longest["short"], "errorifexists")
        write(rows.filter(F.col("bytes") > LONG_BYTES), longest["all"], "append")


def _inflate(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """What the gzip member at ``at`` holds, as far as it inflates; where that ends; whether it ended well."""
    unpack, out, size = zlib.decompressobj(31), [], 65536
    while at < len(data):
        held = unpack.copy()
        part = data[at : at + size]
        try:
            out.append(unpack.decompress(part))
        except zlib.error:
            if size == 1:
                break
            unpack, size = held, max(1, size // 16)  # come closer to the fault
            continue
        at += len(part) - len(unpack.unused_data)
        if unpack.eof:
            return b"".join(out), at, True
    return b"".join(out), at, False


def _parse(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at ``at`` of uncompressed bytes, where it ends, and what failed.

    Of a record that failed, the end is where its length says, if it is closed there, else ``at``. ``checked`` says
    whether a block digest was there to hold.
    """
    head: dict[str, str] = {}
    line, end = at, data.find(b"\r\n", at) if data.startswith(VERSION, at) else -1
    while end > line:  # an empty line ends the header, however long it is
        if line > at:
            key, colon, value = data[line:end].partition(b":")
            if not colon:
                return None, at, "bad header line"
            head[key.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
        line, end = end + 2, data.find(b"\r\n", end + 2)
    if end < 0:
        return None, at, "no header"
    size = head.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", size):
        return None, at, "no length"
    begin, stop = end + 2, end + 2 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None, at, "length does not fit"
    block = data[begin:stop]
    said = head.get("warc-block-digest", "")
    if said.startswith("sha1:") and base64.b32encode(hashlib.sha1(block).digest()).decode() != said[5:]:
        return None, stop + 4, "block digest differs"
    http, split, payload = block.partition(b"\r\n\r\n")
    if not http.startswith(b"HTTP/") or not split:
        http, payload = b"", block
    full = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    kind = head.get("warc-type", "")
    digest = head.get("warc-payload-digest", "")
    own = hashlib.sha1(payload).digest()
    if kind == "revisit":
        try:
            hexed = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
        except ValueError:
            return None, stop + 4, "no payload digest"
    elif digest.startswith("sha1:") and digest[5:] != base64.b32encode(own).decode():
        return None, stop + 4, "payload digest differs"
    else:
        hexed = own.hex()
    number = lambda k: int(head[k]) if re.fullmatch(r"-?[0-9]{1,19}", head.get(k, "")) else None
    for page, name in (("x-page-id", "warc-record-id"), ("x-refers-to-page", "warc-refers-to")):
        if page in head and head.get(name) != record_id(number(page)):
            return None, stop + 4, "ids do not fit"
    got = {"record_type": kind, "record_id": head.get("warc-record-id"), "uri": head.get("warc-target-uri"), "page_id": number("x-page-id"), "payload_bytes": int(full[1]) if kind == "revisit" and full else len(payload), "payload_digest": hexed, "refers_to": number("x-refers-to-page"), "payload": None if kind == "revisit" else payload, "checked": said.startswith("sha1:")}
    return got, stop + 4, ""


def _whole(data: bytes, at: int) -> tuple[list[dict], int] | None:
    """All records of the member, or the one plain record, at ``at`` and its end; None if any check fails."""
    if not data.startswith(GZIP, at):
        got, end, why = _parse(data, at)
        return None if why else ([got], end)
    inner, end, ended = _inflate(data, at)
    found, pos = [], 0
    while ended and pos < len(inner):
        got, pos, why = _parse(inner, pos)
        if why:
            return None
        found.append(got)
    return (found, end) if ended else None


def _plain(data: bytes, trusted: bool) -> Iterator[tuple[int, int, dict]]:
    """Records and gaps of uncompressed bytes as (start, stop, row). Not ``trusted``: a record must have a digest that holds."""
    at = 0
    while at < len(data):
        got, end, why = _parse(data, at)
        if not why and not trusted and not got["checked"]:
            got, why = None, "no block digest in a damaged member"
        if not why:
            yield at, end, got
            at = end
            continue
        hurt, known = at, end
        if known > at and (known >= len(data) or not _parse(data, known)[2]):
            at = known  # the length held: what lies inside isn't a record of its own
        else:
            at = next((m.start() for m in LINE.finditer(data, hurt + 1) if not _parse(data, m.start())[2]), len(data))
        yield hurt, at, {"gap": why}


def salvage(data: bytes) -> Iterator[dict]:
    """Records (with ``start`` and ``stop``) and gaps (``gap`` says why) of one archive, in order.

    Together they cover all its bytes. Rows from inside a damaged member carry the member's place, and their own inside
    what it inflated to as ``inner_start`` and ``inner_stop``.
    """
    at, inside = 0, 0
    while at < len(data):
        whole = _whole(data, at)
        if whole:
            for r in whole[0]:
                yield {"start": at, "stop": whole[1], "embedded": at < inside, **r}
            at = whole[1]
            continue
        begin, why, inner, known, reach = at, "damaged member", b"", at, at
        if data.startswith(GZIP, at):
            inner, reach, ended = _inflate(data, at)
            known = reach if ended else at
        else:
            _, known, why = _parse(data, at)
        if known > begin and (known >= len(data) or _whole(data, known)):
            at = known
        else:
            # A fault may show late, so members are looked for everywhere, plain records behind what was inflated.
            starts = (m.start() for m in START.finditer(data, begin + 1) if m[0] == GZIP or m.start() >= reach)
            at = next((k for k in starts if _whole(data, k)), len(data))
            inside = max(inside, known)
        rows = list(_plain(inner, False)) if inner else []
        if any("gap" not in r for _, _, r in rows):
            for a, b, r in rows:
                yield {"start": begin, "stop": at, "inner_start": a, "inner_stop": b, "embedded": False, **r}
        else:
            yield {"start": begin, "stop": at, "gap": why}


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record and every quarantined gap of the archives in ``path``; a gap's row has ``gap`` and no record columns.

    A task holds one file; a file beyond 2 GB fails the job.
    """

    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                rows: list[dict] = []
                for r in salvage(content):
                    rows.append({"path": file, **r, **({} if payloads else {"payload": None})})
                    if len(rows) == 256:
                        yield pd.DataFrame(rows, columns=names, dtype="object")
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype="object")

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.filter(F.col("length") > 0).select("path", "content").mapInPandas(run, FIELDS)
