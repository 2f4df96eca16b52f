"""WARC archives: a writer of gzip members, and a reader that salvages what follows damage."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_sized, scratch_dir, stored, table

#: Compressed bytes after which a task begins another archive, and bytes that the reader inflates at once.
ARCHIVE_BYTES, CHUNK = 8 << 20, 1 << 14
MEMBER, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record; a revisit keeps the HTTP head (with the full length) and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = {
        "WARC-Type": "revisit" if refers_to is not None else "response", "WARC-Record-ID": record_uri(page_id), "WARC-Date": date, "WARC-Target-URI": clean,
        "Content-Type": "application/http; msgtype=response", "Content-Length": len(block), "WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Block-Digest": f"sha1:{digest(block)}",
    }
    if page_id is not None:
        head["X-Page-ID"] = page_id
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_uri(refers_to), "X-Refers-To-Page-ID": refers_to}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int] | None:
    """(headers, block, end) of the valid record at ``at``, or None."""
    if not (m := VERSION.match(data, at)):
        return None
    stop = data.find(b"\r\n\r\n", m.end())
    if stop < 0:
        return None
    head = {}
    for line in data[m.end() : stop].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        head[k.strip().decode("utf-8", "replace").lower()] = v.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", size := head.get("content-length", "")):
        return None
    end = stop + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    block = data[stop + 4 : end]
    if (want := head.get("warc-block-digest")) and want != f"sha1:{digest(block)}":
        return None
    return head, block, end + 4


def one_at(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """A valid record at ``at``: a whole gzip member that holds one, or a plain one."""
    if data[at : at + 3] != MEMBER:
        return parse(data, at)
    z, plain, end = zlib.decompressobj(31), [], at
    try:
        while not z.eof and end < len(data):  # piecemeal, so that what follows isn't copied for each member
            piece = data[end : end + CHUNK]
            plain.append(z.decompress(piece))
            end += len(piece) - len(z.unused_data)
    except zlib.error:
        return None
    whole = b"".join(plain)
    got = parse(whole) if z.eof else None
    return (got[0], got[1], end) if got and got[2] == len(whole) else None


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """("record", start, end, headers, block) for every valid record, and ("gap", start, end, {}, b"") for bytes between them but line ends.

    After a failed check the search goes on at the next member or version line;
    a place once found is kept until it is passed, so each byte is searched once.
    """
    at = gap = 0
    version = zipped = -1
    while at < len(data):
        if got := one_at(data, at):
            if data[gap:at].strip(b"\r\n"):
                yield "gap", gap, at, {}, b""
            yield "record", at, got[2], got[0], got[1]
            at = gap = got[2]
            continue
        if version <= at:
            version = m.start() if (m := VERSION.search(data, at + 1)) else len(data)
        if zipped <= at:
            zipped = len(data) if (z := data.find(MEMBER, at + 1)) < 0 else z
        at = min(version, zipped)
    if data[gap:].strip(b"\r\n"):
        yield "gap", gap, len(data), {}, b""


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> None:
    """A record for each row, in gzip members of archives under ``path``.

    Of rows with equal payloads of at least ``least`` bytes (equal length, SHA-1
    and MD5), the one with the smallest id is a response and others revisit it.
    Null payload counts as empty, and an empty one is a payload like others.
    Rows with a null id, and rows that repeat the response's id, are responses.
    Spark's own text writer puts each archive into a file (its bytes and a line
    end), so any file system of the cluster will do and only what successful
    task attempts wrote is there.
    """
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))
    same = [F.octet_length("html").alias("size"), F.unhex(F.sha1("html")).alias("sha1"), F.unhex(F.md5("html")).alias("md5")]
    keys = stored(pages.select("page_id", *same).where("page_id is not null").where(F.col("size") >= least), "keys")
    first = stored(keys.groupBy("size", "sha1", "md5").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    again = stored(keys.join(first.hint("merge"), ["size", "sha1", "md5"]).where("page_id <> refers_to").select("page_id", "md5", "refers_to").distinct(), "again")
    typed = join_sized(pages.withColumn("md5", F.unhex(F.md5("html"))), again, ["page_id", "md5"], "left", again.count()).select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(member(record(page, url, html.encode("utf-8", "surrogatepass"), refers)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    typed.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


READ = "file string, kind string, start long, end long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Rows of archives under ``path``: kind ``record`` for each valid record, kind ``gap`` for quarantined bytes (null columns).

    A record counts if its member or version line, length, ends and block digest
    hold. After a failure the reader searches the next place that begins a valid
    record. An archive is read whole by one task.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    schema = READ + ", payload binary" * with_payload
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                out = []
                for kind, a, b, head, block in salvage(content):
                    if kind == "gap":
                        out.append((file, kind, a, b, *[None] * 7))
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = re.search(rb"(?i)content-length: *(\d+)", http)
                    number = lambda name: int(head[name]) if re.fullmatch(r"-?\d+", head.get(name, "")) else None
                    out.append((file, kind, a, b, number("x-page-id"), head.get("warc-target-uri"), int(size[1]) if size else len(payload), head.get("warc-payload-digest", "").removeprefix("sha1:"), head.get("warc-type"), number("x-refers-to-page-id"), payload))
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)
                        out = []
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return files.mapInArrow(run, schema)


def salvage_archives(spark: SparkSession, path: str, log: str) -> DataFrame:
    """Records of the archives under ``path``; the quarantined gaps (file, start, end) are written to ``log`` as Parquet."""
    rows = stored(read_archives(spark, path), "salvaged")
    rows.where("kind = 'gap'").select("file", "start", "end").write.parquet(log)
    return rows.where("kind = 'record'").drop("kind")


def op9_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/warc"
    write_archives(table(spark, sf_dir, "pages"), f"{path}/archives")
    return salvage_archives(spark, f"{path}/archives", f"{path}/gaps").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
