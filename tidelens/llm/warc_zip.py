"""WARC records in ZIP-packaged archives: writing, and reading single records by range without extraction."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from tidelens.llm.native import NO_ID, new_folder, store

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
STAMP = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class Member:
    """A member of an archive: where its stored bytes begin, and how many there are."""

    name: str
    method: int
    offset: int
    size: int
    crc: int


# -- ZIP ------------------------------------------------------------------------------------------------------------------------


class ZipWriter:
    """Stored members, one after the other, to an output stream; ZIP64 fields wherever a number needs them."""

    def __init__(self, out, force64: bool = False) -> None:
        self.out, self.at, self.done, self.force64 = out, 0, [], force64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """Sizes and checksum follow the data (flag bit 3) in a ZIP64 descriptor."""
        raw = name.encode()
        self.name, self.start, self.crc = raw, self.at, 0
        self._put(struct.pack("<4sHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, FULL32, FULL32, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))
        self.data = self.at

    def write(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self._put(data)

    def end(self) -> None:
        size = self.at - self.data
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", self.crc, size, size))
        self.done.append((self.name, self.crc, size, self.start))

    def close(self) -> None:
        first = self.at
        for name, crc, size, start in self.done:
            large, far = self.force64 or size >= FULL32, self.force64 or start >= FULL32
            extra = (struct.pack("<QQ", size, size) if large else b"") + (struct.pack("<Q", start) if far else b"")
            extra = struct.pack("<HH", 1, len(extra)) + extra if extra else b""
            shown = FULL32 if large else size
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, shown, shown, len(name), len(extra), 0, 0, 0, 0,
                                  FULL32 if far else start) + name + extra)
        size, n = self.at - first, len(self.done)
        if self.force64 or n >= FULL16 or size >= FULL32 or first >= FULL32:
            at = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, first))
            self._put(struct.pack("<4sIQI", LOCATOR64, 0, at, 1))
            n, size, first = FULL16, FULL32, FULL32
        self._put(struct.pack("<4sHHHHIIH", END, 0, 0, n, n, size, first, 0))


class BadArchive(ValueError):
    pass


def members(read, size: int) -> list[Member]:
    """The members that the central directory lists. ``read(offset, length)`` reads a range of a file of ``size`` bytes."""
    tail_at = max(0, size - 22 - FULL16)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20:at + 22], "little") != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise BadArchive("no end of a central directory")
    n, length, first = struct.unpack("<HII", tail[at + 10:at + 20])
    if FULL16 == n or FULL32 in (length, first):
        spot = tail_at + at - 20
        mark, _, far, _ = struct.unpack("<4sIQI", read(spot, 20)) if spot >= 0 else (b"", 0, 0, 0)
        if mark != LOCATOR64:
            raise BadArchive("no ZIP64 locator")
        end = read(far, 56)
        if end[:4] != END64:
            raise BadArchive("no ZIP64 end of a central directory")
        n, length, first = struct.unpack("<QQQ", end[32:56])
    listing, at, out = read(first, length), 0, []
    for _ in range(n):
        head = struct.unpack("<4sHHHHHHIIIHHHHHII", listing[at:at + 46])
        if head[0] != CENTRAL:
            raise BadArchive("broken central directory")
        method, crc, packed, plain, a, b, c, start = head[4], head[7], head[8], head[9], head[10], head[11], head[12], head[16]
        name, extra = listing[at + 46:at + 46 + a].decode("utf-8", "replace"), listing[at + 46 + a:at + 46 + a + b]
        while len(extra) >= 4:
            kind, k = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = list(struct.unpack(f"<{k // 8}Q", extra[4:4 + k // 8 * 8]))
                plain = wide.pop(0) if plain == FULL32 and wide else plain
                packed = wide.pop(0) if packed == FULL32 and wide else packed
                start = wide.pop(0) if start == FULL32 and wide else start
            extra = extra[4 + k:]
        at += 46 + a + b + c
        local = read(start, 30)
        if local[:4] != LOCAL:
            raise BadArchive(f"no local header of {name}")
        out.append(Member(name, method, start + 30 + sum(struct.unpack("<HH", local[26:30])), packed, crc))
    return out


# -- WARC -----------------------------------------------------------------------------------------------------------------------


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(number: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit without the payload. The HTTP head keeps the payload's length in both."""
    clean = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{number}>", f"WARC-Date: {STAMP}",
            f"WARC-Target-URI: {clean}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields, HTTP fields and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise BadArchive("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if len(block) < int(fields["Content-Length"]):
        raise BadArchive("truncated WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode("utf-8").split("\r\n")[1:]), payload


# -- Spark ----------------------------------------------------------------------------------------------------------------------


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _write(batches, folder: str, level: int, records: int) -> Iterator[pa.RecordBatch]:
    fs, base = _place(folder)
    rows = ((p, u, h, r) for b in batches for p, u, h, r in zip(*(b.column(c).to_pylist() for c in ("page", "url", "html", "refers_to"))))
    left = next(rows, None)
    while left is not None:
        name = f"{uuid.uuid4().hex}.wacz"
        with fs.open_output_stream(f"{base}/{name}") as out:
            pack, index, at, n = ZipWriter(out), [], 0, 0
            pack.begin(DATA)
            while left is not None and n < records:
                page, url, html, refers_to = left
                squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = squeeze.compress(record(page, url, (html or "").encode("utf-8", "surrogatepass"), refers_to)) + squeeze.flush()
                pack.write(raw)
                index.append(json.dumps({"id": f"urn:page:{page}", "offset": at, "length": len(raw)}))
                at, n, left = at + len(raw), n + 1, next(rows, None)
            pack.end()
            pack.begin(INDEX)
            pack.write("\n".join(index).encode())
            pack.end()
            pack.close()
            size = pack.at
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], ["name", "size"])


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", refers_col: str = "refers_to",
                   level: int = 1, records: int = 5_000) -> DataFrame:
    """Write the rows as gzipped records to ZIP archives of up to ``records`` each in ``folder`` (any store that Arrow opens).

    Each archive stores the records' member and an index of offsets and lengths uncompressed. Returns the (name, size) of those that
    finished tasks wrote, from a written table: a repeated task writes new files and its first ones are never read.
    """
    fs, base = _place(folder)
    fs.create_dir(base, recursive=True)
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("page"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"), F.col(refers_col).cast("long").alias("refers_to"))
    return store(rows.mapInArrow(lambda it: _write(it, folder, level, records), "name string, size long"))


def _index(batches, folder: str) -> Iterator[pa.RecordBatch]:
    """(name, offset, length) of every record, from the stored index of each archive."""
    fs, base = _place(folder)
    for batch in batches:
        for name, size in zip(batch.column("name").to_pylist(), batch.column("size").to_pylist()):
            with fs.open_input_file(f"{base}/{name}") as file:
                found = {m.name: m for m in members(lambda at, n: file.read_at(n, at), size)}
                data, index = found[DATA], found[INDEX]
                if data.method or index.method:
                    raise BadArchive(f"{name}: members are not stored")
                raw = file.read_at(index.size, index.offset)
                if zlib.crc32(raw) != index.crc:
                    raise BadArchive(f"{name}: index is damaged")
            entries = [json.loads(x) for x in raw.decode().split("\n") if x]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(entries), pa.string()), pa.array([data.offset + e["offset"] for e in entries], pa.int64()),
                                              pa.array([e["length"] for e in entries], pa.int64())], ["name", "offset", "length"])


READ = "page long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _read(batches, folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    fs, base = _place(folder)
    schema = pa.schema([("page", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("refers_to", pa.int64()), ("payload", pa.binary())])
    number = lambda x: int(x[len("<urn:page:"):-1]) if x else None
    name, file = None, None
    for batch in batches:
        out, held = [], 0
        for r in batch.to_pylist():
            if r["name"] != name:
                name = r["name"]
                if file:
                    file.close()
                file = fs.open_input_file(f"{base}/{name}")
            fields, http, payload = parse_record(zlib.decompress(file.read_at(r["length"], r["offset"]), 31))
            said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if fields["WARC-Type"] == "response" and (digest(payload) != said or len(payload) != int(http["Content-Length"])):
                raise BadArchive(f"{name}: payload of {fields['WARC-Record-ID']} is damaged")
            out.append({"page": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_bytes": int(http["Content-Length"]),
                        "payload_digest": said, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if payloads and fields["WARC-Type"] == "response" else None})
            held += len(payload) * payloads
            if held > 16 << 20:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)
    if file:
        file.close()


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the (name, size) ``archives`` in ``folder``: only directories, indexes and the records' ranges are read.

    Archives are spread over tasks first, then ranges of records; each response's digest is verified. A damaged archive is an error.
    """
    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spots = archives.repartition(tasks, "name").mapInArrow(lambda it: _index(it, folder), "name string, offset long, length long")
    spread = spots.repartition(tasks, "name", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("name", "offset")
    return spread.mapInArrow(lambda it: _read(it, folder, payloads), READ)


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 0) -> DataFrame:
    """``pages`` with ``refers_to``: the largest id with an equal payload of ``least`` bytes or more, null for that page itself.

    A null payload is empty, a null id the smallest. Rows sharing id and payload are all responses or revisits alike. Payloads are
    compared by SHA-1 and length; only pages that do repeat another are joined back, by id and digest.
    """
    body = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    keyed = pages.withColumns({"__p": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "__k": F.concat(F.sha1(body), F.octet_length(body).cast("string")), "__n": F.octet_length(body)})
    keys = keyed.filter(F.col("__n") >= least).select("__p", "__k")
    last = keys.groupBy("__k").agg(F.max("__p").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = store(keys.join(last, "__k").filter("__p <> refers_to").distinct())
    return keyed.drop("refers_to").join(again, ["__p", "__k"], "left").drop("__p", "__k", "__n")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages, repeats as revisits, to archives in the shared folder and read the records back."""
    folder = new_folder(pages)
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    return read_archives(write_archives(revisits(pages), folder), folder, payloads=False)
