"""WARC archives: writing pages as deduplicated records, and a reader that salvages what damaged archives still hold.

Writing: pages of equal payloads are found by digest, on narrow rows; all but one become revisits, which carry no payload. Each task writes files of its own, a gzip
member a record, under the session's shared folder, and returns their names; a list of these is landed, so what a task that was lost or run twice has left behind is never read.

Reading: a file is one stream, read in pieces. At each place a record must stand whole: a gzip member whose checksum and length hold,
or a version line; then a header block, as many bytes as Content-Length says, the closing line breaks, and digests that fit. Where one of these
checks fails, the reader goes to the record's declared end if a valid record or the end of the file is there, and else searches on, byte by byte,
for the next member or version line with a valid record. What lies between is logged as a gap (place, length, reason), and reading goes on. A task holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import folder, land, table

_PIECE = 1 << 18
_SALTS = 16
_SAFE = "".join(map(chr, range(0x21, 0x7F)))
_START = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|WARC/[0-9]\.[0-9]\r?\n")
_VERSION = re.compile(rb"WARC/[0-9]\.[0-9]\r?\n")
_BREAKS = re.compile(rb"\r?\n\r?\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_WRITTEN = "path string, bytes long, records long"
_READ = "path string, offset long, length long, record_type string, record_id string, target_uri string, headers map<string,string>, payload_bytes long, payload_digest string, block binary, gap string"
_READ_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary()), ("gap", pa.string())])


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if re.match(r"(?!file:)[a-z][a-z0-9+.-]*://", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, block: bytes, content_type: str, date: str, more: dict[str, str | None]) -> bytes:
    """A record as it stands in an archive that isn't compressed; fields of more that are null are left out."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, **more, "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Type": content_type, "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _page_uuid(sha1: str, page_id: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{sha1}:{page_id}')}"


def page_record(page_id: int | None, url: str | None, sha1: str, size: int, payload: bytes | None, owner: int | None, date: str) -> bytes:
    """A page's response, or its revisit of the owner's where payload is null."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    more = {"WARC-Target-URI": None if url is None else quote(url, safe=_SAFE), "WARC-Payload-Digest": f"sha1:{digest}", "Page-ID": None if page_id is None else str(page_id)}
    if payload is not None:
        return record("response", _page_uuid(sha1, page_id), http + payload, "application/http; msgtype=response", date, more)
    more |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<{_page_uuid(sha1, owner)}>", "Refers-To-Page-ID": None if owner is None else str(owner)}
    return record("revisit", f"urn:uuid:{uuid.uuid4()}", http, "application/http; msgtype=response", date, more)


def marked(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, sha1, size, payload, owner): one row for each page; payload is null for revisits, whose response is the owner's.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest page_id is the owner (null ids come last; of repeated rows of one page the one with the
    smallest url). Groups are counted on narrow rows. The salted join moves payloads only where the groups are too many for a broadcast.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumns({"sha1": F.sha1("payload"), "size": F.length("payload").cast("long")})
    each = p.filter(F.col("size") >= least).groupBy("sha1", "page_id").agg(F.count("*").alias("n"))
    best = F.max(F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("rank"), "page_id", "n")).alias("b")
    groups = land(each.groupBy("sha1").agg(best, F.sum("n").alias("n")).filter("n > 1").select("sha1", F.col("b.page_id").alias("owner"), F.col("b.n").alias("own")))
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    j = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALTS))).join(salted, ["sha1", "salt"], "left").drop("salt")
    cols = ["page_id", "url", "sha1", "size", "payload", "owner"]
    owns = F.col("own").isNotNull() & F.col("page_id").eqNullSafe(F.col("owner"))
    once = j.filter(~owns | (F.col("own") == 1)).withColumn("payload", F.when(F.col("own").isNull() | owns, F.col("payload"))).select(*cols)
    if groups.filter("own > 1").isEmpty():
        return once
    # repeated rows of the owner: one response, the others by narrow rows
    same = j.filter(owns & (F.col("own") > 1))
    one = same.groupBy("sha1", "page_id", "owner").agg(F.min(F.struct(F.col("url").isNull(), "url")).alias("u"), F.any_value("size").alias("size"), F.any_value("payload").alias("payload")).withColumn("url", F.col("u.url")).select(*cols)
    rank = F.row_number().over(Window.partitionBy("sha1", "page_id").orderBy(F.asc_nulls_last("url")))
    others = same.select("page_id", "url", "sha1", "size", "owner", rank.alias("r")).filter("r > 1").withColumn("payload", F.lit(None).cast("binary")).select(*cols)
    return once.unionByName(one).unionByName(others)


def write_archives(records: DataFrame, path: str, roll: int = 64 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes records (as of ``marked``) to files under path, a new one after ``roll`` bytes; (path, bytes, records) of each file, landed."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _place(path)
        out, done = None, []

        def close() -> None:
            out[1].close()
            done.append((f"{path}/{out[0]}", out[2], out[3]))

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "sha1", "size", "payload", "owner")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    fs.create_dir(at, recursive=True)
                    out = [name, fs.open_output_stream(f"{at}/{name}", compression=None), 0, 0]
                    info = member(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", b"software: lineagrid\r\nformat: WARC File Format 1.1\r\n", "application/warc-fields", date, {"WARC-Filename": name}))
                    out[1].write(info)
                    out[2] += len(info)
                data = member(page_record(*r, date))
                out[1].write(data)
                out[2] += len(data)
                out[3] += 1
                if out[2] >= roll:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "bytes", "records"])

    return land(records.mapInArrow(write, _WRITTEN))


class _Bad(Exception):
    """A failed check; end: the record's declared end, if it is known."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.reason, self.end = reason, end


class _Archive:
    """A file that is read from any place, in pieces of which the last is kept."""

    def __init__(self, path: str):
        fs, at = _place(path)
        self.file = fs.open_input_file(at)
        self.size, self.start, self.piece = self.file.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        """n bytes from a place, fewer at the end of the file."""
        if not (self.start <= at and at + n <= self.start + len(self.piece)):
            self.file.seek(at)
            self.start, self.piece = at, self.file.read(max(n, _PIECE))
        i = at - self.start
        return self.piece[i : i + n]

    def member(self, at: int) -> tuple[bytes, int]:
        """The content of the gzip member at a place, and its end."""
        d, out, pos = zlib.decompressobj(31), [], at
        try:
            while not d.eof:
                data = self.read(pos, 1 << 14)
                if not data:
                    raise _Bad("member is cut off")
                out.append(d.decompress(data))
                pos += len(data)
        except zlib.error as e:
            raise _Bad(f"member: {e}") from e
        return b"".join(out), pos - len(d.unused_data)

    def search(self, at: int) -> Iterator[int]:
        """Places from ``at`` on where a member or a version line may begin."""
        while at < self.size:
            data = self.read(at, _PIECE)
            for m in _START.finditer(data):
                yield at + m.start()
            if at + len(data) >= self.size:
                return
            at += len(data) - 16  # a start may lie across two pieces
            # one within the overlap may come twice, which does no harm


def _digest_fits(said: str | None, data: bytes) -> bool:
    """Whether a digest of a known kind (SHA-1 or SHA-256, in base 32 or hexadecimal) is that of the data; true for other kinds."""
    kind, _, value = (said or "").partition(":")
    if kind.lower() not in ("sha1", "sha256"):
        return True
    own = hashlib.new(kind.lower(), data).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def _headers(data: bytes) -> dict[str, str]:
    """Fields of a header block, names in lower case; a folded line goes on with the one before."""
    lines = re.sub(r"\r?\n[ \t]+", " ", data.decode("utf-8", "replace")).splitlines()
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}


def _parsed(head: bytes, block: bytes) -> dict:
    """A record's fields and payload, after its digests have been checked."""
    fields = _headers(head)
    if not _digest_fits(fields.get("warc-block-digest"), block):
        raise _Bad("block digest")
    kind, payload, said = fields.get("warc-type"), block, None
    if fields.get("content-type", "").startswith("application/http") and (m := _BREAKS.search(block)):
        payload, said = block[m.end() :], _headers(block[: m.start()]).get("content-length")
    digest = fields.get("warc-payload-digest")
    if kind != "revisit" and not _digest_fits(digest, payload):
        raise _Bad("payload digest")
    size = int(said) if kind == "revisit" and said and said.isdigit() else len(payload)
    return {"record_type": kind, "record_id": fields.get("warc-record-id", "").strip("<>") or None, "target_uri": fields.get("warc-target-uri"), "headers": fields, "payload_bytes": size, "payload_digest": digest.partition(":")[2] if kind == "revisit" and digest else base32_sha1(payload), "block": block}


def _head(data: bytes) -> tuple[int, int, int]:
    """Ends of the version line and of the header block (without, with its empty line) of a record, or a failed check."""
    if not (v := _VERSION.match(data)):
        raise _Bad("no version line")
    if not (b := _BREAKS.search(data, v.end() - 1)):
        raise _Bad("header block without an end")
    if _VERSION.search(data, v.end(), b.end()):
        raise _Bad("version line in a header block")
    return v.end(), b.start(), b.end()


def _length(head: bytes) -> int:
    n = _headers(head).get("content-length", "")
    if not n.isdigit():
        raise _Bad("no Content-Length")
    return int(n)


def _plain(f: _Archive, at: int) -> tuple[dict, int]:
    """The record that begins at a place with a version line, and its end."""
    n = 1 << 13
    while True:
        data = f.read(at, n)
        try:
            version, head, body = _head(data)
            break
        except _Bad as e:
            if at + len(data) >= f.size or n > 1 << 20 or e.reason == "no version line":
                raise
            n *= 4
    n = _length(data[version:head])
    end = at + body + n + 4
    if end > f.size:
        raise _Bad("record is cut off")
    block = f.read(at + body, n + 4)
    if block[n:] != b"\r\n\r\n":
        raise _Bad("no line breaks where Content-Length says", end)
    try:
        return _parsed(data[version:head], block[:n]), end
    except _Bad as e:
        raise _Bad(e.reason, end) from e


def _records(f: _Archive, at: int) -> tuple[list[dict], int]:
    """The records at a place (several where a member holds more than one), and where the next begins."""
    if f.read(at, 3) != b"\x1f\x8b\x08":
        one, end = _plain(f, at)
        return [one], end
    data, end = f.member(at)
    found, i = [], 0
    while i < len(data) or not found:
        version, head, body = _head(data[i:] if i else data)
        n = _length(data[i + version : i + head])
        if data[i + body + n : i + body + n + 4] != b"\r\n\r\n":
            raise _Bad("no line breaks where Content-Length says", end)
        try:
            found.append(_parsed(data[i + version : i + head], data[i + body : i + body + n]))
        except _Bad as e:
            raise _Bad(e.reason, end) from e
        i += body + n + 4
    return found, end


def _valid(f: _Archive, at: int) -> bool:
    try:
        _records(f, at)
        return True
    except _Bad:
        return False


def salvage_file(path: str) -> Iterator[dict]:
    """Records and gaps of one archive, in order."""
    f, at = _Archive(path), 0
    while at < f.size:
        try:
            found, end = _records(f, at)
            for r in found:
                yield r | {"path": path, "offset": at, "length": end - at, "gap": None}
        except _Bad as e:
            if e.end is not None and (e.end == f.size or _valid(f, e.end)):
                end = e.end
            else:
                end = next((x for x in f.search(at + 1) if _valid(f, x)), f.size)
            yield dict.fromkeys(_READ_ARROW.names) | {"path": path, "offset": at, "length": end - at, "gap": e.reason}
        at = end


def read_archives(files: DataFrame, blocks: bool = True) -> DataFrame:
    """A row for each record and each gap of archives (path, ...), gzip members or plain: path, offset, length, record_type, record_id, target_uri, headers
    (names in lower case), payload_bytes and payload_digest (of the full payload; a revisit says what those are), block (null without ``blocks``), gap.

    gap is null for records and says for quarantined bytes which check failed; nothing else of theirs is filled. An empty archive has no rows, an empty list no archives. A version
    line inside a sound record is part of it; inside the bytes of a broken one a whole record is recovered.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                held, size = [], 0
                for r in salvage_file(path):
                    size += len(r["block"] or b"")
                    if not blocks:
                        r["block"] = None
                    held.append(r | {"headers": None if r["headers"] is None else list(r["headers"].items())})
                    if len(held) == 512 or blocks and size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=_READ_ARROW)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_READ_ARROW)

    n = files.count()  # a task for each file, as a few names would be taken together
    return files.select("path").repartition(max(1, n)).mapInArrow(read, _READ)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/warc-{uuid.uuid4().hex}"
    r = read_archives(write_archives(marked(table(spark, sf_dir, "pages")), path), blocks=False)
    of = lambda name: F.try_element_at("headers", F.lit(name)).cast("long")
    return r.filter("gap is null and record_type in ('response', 'revisit')").select(of("page-id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", of("refers-to-page-id").alias("refers_to"))


_B32 = " || ".join(f"translate(to_base(('0x' || substr(s, {i}, 10))::BIGINT, 32, 8), '0123456789abcdefghijklmnopqrstuv', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')" for i in (1, 11, 21, 31))
ORACLES = {
    "op13_warc": f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), q AS (SELECT page_id, b, lower(sha1(b)) AS s, row_number() OVER (PARTITION BY b ORDER BY page_id DESC NULLS LAST) AS r, max(page_id) OVER (PARTITION BY b) AS owner FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, {"upper(" + _B32.replace("translate(to_base(", "translate(lower(to_base(").replace(", 32, 8)", ", 32, 8))") + ")"} AS payload_digest, CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN owner END AS refers_to FROM q"""
}
QUERIES = {"op13_warc": op13_warc}
