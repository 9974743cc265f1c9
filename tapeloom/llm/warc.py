"""A deterministic sharded WARC writer, and a reader.

Pages are range-sorted by page_id into shards: equal cells of the id range are put together until they hold a shard's
bytes, so that the same input gives the same shards on any cluster. Each shard is written by one task as gzip members,
one per record, and rolls to a new file when its compressed size reaches ``roll_bytes``. Headers and digests are made anew
from the payload; nothing in a file depends on the time or place of writing. A file is written under a temporary name
of its task attempt and renamed; the manifest (files, records, bytes, SHA-1) is committed last, and a reader goes by it, so
that what lost tasks leave behind is never read.

Of records with equal payloads of at least ``least_bytes`` bytes, that with the smallest page_id is a response, and records
with larger ids (or none) revisit it; rows that repeat the smallest id are all responses. Null html is an empty payload; null
urls and ids are left out of the headers. Rows that repeat are written as often as they come.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.base import stored
from tapeloom.session import work_dir

#: Bytes of payload in a shard (one task) and compressed bytes in a file.
SHARD_BYTES, ROLL_BYTES = 64 << 20, 16 << 20
#: Cells of the id range for each shard.
CELLS = 16
#: The date in all headers: the archive is made again from a table, not fetched.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space for URLs


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _b32(hex_digest: str) -> str:
    return base64.b32encode(binascii.unhexlify(hex_digest)).decode()


def _record_id(page_id, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{sha1}')}>"


def record(page_id, url: str | None, payload: bytes, sha1: str, refers_to) -> bytes:
    """One record with its headers; a revisit has the HTTP header of the payload it leaves out."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url) if url else None
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _record_id(page_id, sha1), "WARC-Date": DATE, "WARC-Target-URI": target,
        "Page-ID": None if page_id is None else str(page_id),
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "WARC-Refers-To": _record_id(refers_to, sha1) if revisit else None, "Refers-To-Page-ID": str(refers_to) if revisit else None,
        "WARC-Payload-Digest": f"sha1:{sha1}", "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n"
    return lines.encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member without a time or a name."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict:
    """The headers, page ids, payload length and digest of one record, checked against its digests."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if digest(block) != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    revisit = fields["WARC-Type"] == "revisit"
    if revisit:
        length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    elif digest(payload) != sha1:
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    else:
        length = len(payload)
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("Page-ID"), "payload_bytes": length, "payload_digest": sha1, "record_type": fields["WARC-Type"],
            "refers_to": number("Refers-To-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload": None if revisit else payload}


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _shards(light: DataFrame, shard_bytes: int):
    """Column with the shard of a page_id: cells of equal width, put together in order."""
    low, high, total = light.agg(F.min("page_id"), F.max("page_id"), F.sum("size")).first()
    if low is None:
        return lambda page_id: F.lit(0)
    wanted = max(1, -(-(total or 0) // shard_bytes))
    width = max(1, -(-(high - low + 1) // (wanted * CELLS)))
    cell = lambda page_id: F.expr("0").cast("long") if page_id is None else F.coalesce(F.floor((page_id - F.lit(low)) / F.lit(width)), F.lit(0))
    # at most CELLS rows per shard
    sizes = light.groupBy(cell(F.col("page_id")).alias("cell")).agg(F.sum("size").alias("size")).orderBy("cell").collect()
    begins, held = [], shard_bytes
    for r in sizes:
        if held >= shard_bytes:
            begins.append(r["cell"])
            held = 0
        held += r["size"]
    starts = F.array(*[F.lit(b).cast("long") for b in begins])
    return lambda page_id: F.size(F.filter(starts, lambda s: s <= cell(page_id)))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) into ``folder``; returns the manifest."""
    html = F.coalesce("html", F.lit(""))
    light = stored(pages.select("page_id", F.octet_length(html).cast("long").alias("size"), F.sha1(html.cast("binary")).alias("sha1")), "digests")
    first = light.where(F.col("size") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    again = light.join(first.select("sha1", "first"), "sha1").where("page_id is null or page_id > first").select("page_id", "sha1", F.col("first").alias("refers_to")).distinct()
    again = stored(again, "revisits").select(F.col("page_id").alias("p"), F.col("sha1").alias("s"), "refers_to")
    shard = _shards(light, shard_bytes)
    full = pages.select("page_id", "url", html.alias("html")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    full = full.join(again, (F.col("sha1") == F.col("s")) & F.col("page_id").eqNullSafe(F.col("p")), "left").drop("s", "p")
    full = full.withColumn("shard", shard(F.col("page_id")))
    tasks = light.agg(F.max(shard(F.col("page_id")))).first()[0] or 1
    ranged = full.repartitionByRange(int(tasks), "shard").sortWithinPartitions("shard", "page_id", "sha1", "url")
    def write(batches):
        from pyspark import TaskContext

        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        out, state = None, None

        def close():
            out.close()
            fs.move(state["temp"], f"{root}/{state['file']}")  # over what an earlier attempt left, which has the same bytes
            return {"file": state["file"], "shard": state["shard"], "records": state["records"], "bytes": state["bytes"], "sha1": state["sum"].hexdigest(),
                    "first_page": state["first"], "last_page": state["last"]}

        for batch in batches:
            done = []
            for page_id, url, text, sha1, refers, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is not None and (state["shard"] != at or state["bytes"] >= roll_bytes):
                    done.append(close())
                    out = None
                if out is None:
                    number = state["number"] + 1 if state and state["shard"] == at else 0
                    name = f"part-{at:06d}-{number:05d}.warc.gz"
                    state = {"shard": int(at), "number": number, "file": name, "temp": f"{root}/.{name}.{attempt}", "records": 0, "bytes": 0, "sum": hashlib.sha1(), "first": page_id}
                    out = fs.open_output_stream(state["temp"], compression=None)
                data = _member(record(page_id, url, text.encode("utf-8", "replace"), _b32(sha1), refers))
                out.write(data)
                state["sum"].update(data)
                state["bytes"] += len(data)
                state["records"] += 1
                state["last"] = page_id
            if done:
                yield _manifest(done)
        if out is not None:
            yield _manifest([close()])

    def _manifest(rows):
        names = ["file", "shard", "records", "bytes", "sha1", "first_page", "last_page"]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True)], names)

    schema = f"file string, shard int, records long, bytes long, sha1 string, first_page long, last_page long"
    manifest = f"{folder}/_manifest"
    ranged.select("page_id", "url", "html", "sha1", "refers_to", "shard").mapInArrow(write, schema).write.parquet(manifest)
    return pages.sparkSession.read.schema(schema).parquet(manifest)


def read_archives(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """All records of the files in the manifest, each file read as a stream of members."""
    files = spark.read.parquet(f"{folder}/_manifest").select("file", "bytes", "records")

    def read(batches):
        fs, root = _file_system(folder)
        for batch in batches:
            for name, records in zip(batch["file"].to_pylist(), batch["records"].to_pylist(), strict=True):
                rows, held, count = [], 0, 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    z, data, rest = zlib.decompressobj(31), [], b""
                    while True:
                        chunk = rest or stream.read(1 << 20)
                        rest = b""
                        if not chunk:
                            break
                        data.append(z.decompress(chunk))
                        if z.eof:
                            rows.append(parse(b"".join(data)))
                            held += len(rows[-1]["payload"] or b"")
                            z, data, rest = zlib.decompressobj(31), [], z.unused_data
                            if held > 1 << 22 or len(rows) >= 2000:
                                count += len(rows)
                                yield _rows(rows)
                                rows, held = [], 0
                count += len(rows)
                if count != records:
                    raise ValueError(f"{name}: {count} records, the manifest has {records}")
                if rows:
                    yield _rows(rows)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * payload
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string(), pa.binary()] * payload

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payload
    tasks = max(1, files.count())
    return files.repartitionByRange(tasks, "file").mapInArrow(read, schema)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages and read them back."""
    folder = work_dir(pages.sparkSession, "warc")
    write_archives(pages, folder, least_bytes)
    return read_archives(pages.sparkSession, folder)
