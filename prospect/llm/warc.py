"""WARC archives: writing with revisits, and reading by verified chains of boundaries.

Archives are plain (no compression), a file for each task. Equal payloads share
a SHA-1 digest; the one with the least id is written as a response, the others
as revisits that name it.

Reading splits files into blocks. Every place where a record could begin, the
magic anywhere in a block, payloads included, is a candidate with its successor:
where the record ends by its own Content-Length. Only candidates on the chain
that starts at the file's first byte are records. Each task follows successors
within its block, which gives every candidate the place where its chain leaves
the block; pointer jumping over those places (each round doubles the reach)
retains the candidates that are reachable from the file's start.

A header is read to its end, however long; reading fails if it finds fewer or
more records than were written, rather than return some, and if the digest or the
length of a payload, both recomputed from its bytes, are not what its headers state.

Edge cases: a null page is an empty payload; a very long one is a record like
others, whatever the blocks; a row without an id has a record that names no page, a
revisit if a row with an id has its payload, and is read back without an id; rows that repeat
the least id of a payload are responses all; a null address has
no target header; an empty table gives no files. Columns besides ``page_id``,
``url`` and ``html`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, encode, scratch_path
from .flat import create, dealt, open_file

MAGIC, BLOCK, HEADER = b"WARC/1.1\r\n", 4 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"
#: Revisits (of 40 bytes or so) that may be broadcast.
BROADCAST_ROWS = 1 << 18
#: Payloads of fewer bytes are responses always.
LEAST_BYTES = 0
_FIELD = re.compile(rb"^([A-Za-z0-9-]+):[ \t]*(.*?)[ \t]*$", re.M)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{page_id}>"


def record(page_id, url: str | None, payload: bytes, sha1: str, refers_to=None) -> bytes:
    """A response with its payload, or a revisit with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE), ("WARC-Payload-Digest", "sha1:" + sha1)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return MAGIC + encode("".join(f"{k}: {v}\r\n" for k, v in fields)) + b"\r\n" + block + b"\r\n\r\n"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, n, uri = None, 0, 0, ""
        for batch, pages in chunks(batches, "html"):
            if out is None:
                uri, out = create(folder, ".warc")
            for page_id, url, first, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "first")), pages):
                payload = encode(page)
                data = record(page_id, url, payload, digest(payload), None if first is None else first)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["file", "bytes", "records"])

    return run


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """One record per row. Returns (file, bytes, records)."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    sha1 = F.unhex(F.sha1("html"))
    keys = cut(pages.where(F.octet_length("html") >= LEAST_BYTES).select("page_id", sha1.alias("sha1")), "digests")
    least = keys.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("sha1", "first")
    again = cut(keys.join(least, "sha1").where("page_id is null or page_id <> first").select(F.col("page_id").alias("_again"), F.col("sha1").alias("_sha1"), "first").distinct(), "again")
    # pages move only if the revisits are too many to go to them
    few = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    rows = pages.withColumn("sha1", sha1).join(few, (F.col("sha1") == F.col("_sha1")) & F.col("page_id").eqNullSafe(F.col("_again")), "left").select("page_id", "url", "html", "first")
    return cut(rows.mapInArrow(_write(folder), "file string, bytes long, records long"), "archives")


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], int, int] | None:
    """Fields of a record's header, where its block begins and where its successor would; None if this is no header."""
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None
    fields = {k.decode("latin-1").lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(data[at + len(MAGIC) : stop].replace(b"\r\n", b"\n"))}
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    return fields, stop + 4, stop + 4 + int(length) + 4


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every place of a block where a record could begin, its successor, and where its chain leaves the block."""
    for batch in batches:
        for file, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size"))):
            with open_file(file) as f:
                f.seek(at)
                data = f.read(size + HEADER)
                starts, follow, i, more = [], {}, data.rfind(MAGIC, 0, size + len(MAGIC) - 1), HEADER
                while i >= 0 and data.find(b"\r\n\r\n", i) < 0 and (rest := f.read(more)):  # the last header ends further on
                    data, more = data + rest, 2 * more
            i = data.find(MAGIC)
            while 0 <= i < size:
                if (found := parse(data, i)) is not None:
                    starts.append(at + i)
                    follow[at + i] = at + found[2]
                i = data.find(MAGIC, i + 1)
            leave: dict[int, int] = {}
            for s in reversed(starts):
                leave[s] = leave.get(follow[s], follow[s])
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(starts), pa.string()), pa.array([at // size if size else 0] * len(starts), pa.int64()), pa.array([at] * len(starts), pa.int64()), *(pa.array(x, pa.int64()) for x in (starts, [follow[s] for s in starts], [leave[s] for s in starts]))], ["file", "block", "from", "start", "next", "leaves"])


def boundaries(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, from, start, next): the records, by the block that each begins in."""
    blocks = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(block))).alias("at")).select("file", "at", F.lit(block).alias("size"))
    found = cut(dealt(blocks, files, block, "file", "at").mapInArrow(_candidates, "file string, block long, from long, start long, next long, leaves long"), "candidates")
    # pointer jumping: places reached, and jumps whose reach doubles; only first records of blocks matter
    entries = found.select("file", F.col("leaves").alias("start")).distinct()
    jumps = cut(found.join(entries, ["file", "start"], "left_semi").unionByName(found.where("start = 0")).select("file", "start", "leaves").distinct(), "jumps")
    reached = jumps.where("start = 0").select("file", "start")
    while True:
        step = reached.join(jumps, ["file", "start"]).select("file", F.col("leaves").alias("start"))
        more = cut(reached.unionByName(step.join(jumps.select("file", "start"), ["file", "start"], "left_semi")).distinct(), "reached")
        if more.count() == reached.count():
            break
        reached = more
        on = jumps.select("file", F.col("start").alias("leaves"), F.col("leaves").alias("then"))
        jumps = cut(jumps.join(on, ["file", "leaves"], "left").select("file", "start", F.coalesce("then", "leaves").alias("leaves")), "jumps")
    first = reached.withColumn("entry", F.lit(True))
    marked = found.join(first, ["file", "start"], "left")
    return marked.groupBy("file", "from").applyInArrow(_chain, "file string, from long, start long, next long")


def _chain(table: pa.Table) -> pa.Table:
    """The records of one block: those on the chain from the block's reached candidate."""
    rows = table.select(["file", "from", "start", "next", "entry"]).to_pydict()
    follow, keep = dict(zip(rows["start"], rows["next"])), {}
    for s in (s for s, e in zip(rows["start"], rows["entry"]) if e):
        while s in follow and s not in keep:
            keep[s] = s = follow[s]
    starts = sorted(keep)
    return pa.table({"file": pa.array([rows["file"][0]] * len(keep), pa.string()), "from": pa.array([rows["from"][0]] * len(keep), pa.int64()), "start": pa.array(starts, pa.int64()), "next": pa.array([keep[s] for s in starts], pa.int64())})


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fields and payload of the records."""
    for batch in batches:
        for file, starts, stops in zip(*(batch.column(c).to_pylist() for c in ("file", "starts", "stops"))):
            out = {k: [] for k in ("record_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")}
            with open_file(file) as f:
                for a, b in zip(starts, stops):
                    f.seek(a)
                    data = f.read(b - a)
                    fields, body, _ = parse(data)
                    http = data.find(b"\r\n\r\n", body) + 4
                    kept = data[http:-4] if fields["warc-type"] == "response" else None
                    length = {k.lower(): v for k, v in _FIELD.findall(data[body:http].replace(b"\r\n", b"\n"))}[b"content-length"]
                    if kept is not None and (len(kept) != int(length) or "sha1:" + digest(kept) != fields["warc-payload-digest"]):
                        raise ValueError(f"the payload of {fields['warc-record-id']} in {file} is not what its headers state")
                    for k, v in zip(out, (fields["warc-record-id"], fields.get("warc-target-uri"), fields["warc-type"], fields.get("warc-refers-to"), fields["warc-payload-digest"].removeprefix("sha1:"), int(length), kept)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()))], list(out))


def read_records(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """(record_id, url, record_type, refers_to, payload_digest, payload_bytes, payload) of every record; a revisit has no payload.

    ``files`` has (file, bytes), and ``records`` if that number is to be held against what is found.
    """
    found = cut(boundaries(files, block).groupBy("file", "from").agg(F.array_sort(F.collect_list(F.struct("start", "next"))).alias("r")), "records")
    if "records" in files.columns:
        want, got = files.agg(F.sum("records")).first()[0] or 0, found.agg(F.sum(F.size("r"))).first()[0] or 0
        if want != got:
            raise RuntimeError(f"read_records: {want} records were written, {got} found")
    found = dealt(found, files, block, "file", "from")
    return found.select("file", F.col("r.start").alias("starts"), F.col("r.next").alias("stops")).mapInArrow(
        _read, "record_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """What the archives of ``pages`` say of each page, read back."""
    kind = dict(pages.dtypes)["page_id"]
    form = "(?s)^<urn:page:(.*)>$"
    page = lambda c: F.when(F.col(c).rlike(form), F.regexp_extract(c, form, 1)).cast(kind)
    return read_records(write(pages)).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
