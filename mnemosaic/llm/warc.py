"""WARC archives and a two-level capture index.

Each task writes the records of its rows, a gzip member each, to archives of its own; a task that is run again writes other files, and
only files of the task that ended well are in the index. The index has captures sorted by reversed-host URL key, dealt by range to
shards. A shard is a file of compressed blocks of BLOCK lines and a directory of their first keys. A search goes to the shards whose
range a key may lie in, finds the first block that can hold it by binary search of the directory, reads these blocks by range,
searches their lines likewise, and then reads only the records' byte ranges.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Marks, Scratch, small_batches

#: Payloads of fewer bytes are always written.
LEAST_PAYLOAD = 100
#: An archive is closed when it has so many bytes; lines of a block of the index; captures of a shard, and the most shards.
ROLL, BLOCK, SHARD, MOST_SHARDS = 1 << 30, 1000, 10_000, 4096
#: A longer key is cut and ends with its digest, which bounds directories and the list of shards.
LONGEST_KEY = 1024
#: Neighbouring records are read at once up to so many bytes. Captures are read by stretches of an archive of 2^STRETCH_BITS bytes.
READ, STRETCH_BITS = 8 << 20, 22
CAPTURE = "key string, row bigint, page_id bigint, archive string, offset bigint, length bigint, record_type string, digest string"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload string"


def _files(root: str) -> tuple[fs.FileSystem, str]:
    files, path = fs.FileSystem.from_uri(root)
    return files, path.rstrip("/")


def _quoted(text: str) -> str:
    """Without the characters that would end a header or a field."""
    return re.sub(r"[\x00-\x20\x7f  \x85]", lambda m: quote(m[0]), text)


def url_key(url: str | None) -> str:
    """Host labels reversed, then port, path and query: https://a.example.com/x?y#z is com,example,a)/x?y. What is no URL is its own key; null is empty."""
    text = _quoted(url or "")
    try:
        x = urlsplit(text)
        host, port = (x.hostname or "").rstrip("."), x.port
    except ValueError:
        host, x, port = "", None, None
    if host:
        named = "" if port in (None, {"http": 80, "https": 443}.get(x.scheme)) else f":{port}"
        text = ",".join(reversed(host.split("."))) + named + ")" + (x.path or "/") + (f"?{x.query}" if x.query else "")
    if len(text) > LONGEST_KEY:
        text = text[:LONGEST_KEY] + "~" + hashlib.sha256(text.encode()).hexdigest()
    return text


def _name(page_id: int | None, row: int) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{row}>"


def _page_of(name: str) -> int | None:
    page = name.strip("<>").split(":")[2]
    return int(page) if page else None


def record(kind: str, name: str, url: str, date: str, payload: bytes, digest: str, refers: tuple[str, str] | None = None) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, which tells the payload's length, but not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", _quoted(url)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers[0]), ("WARC-Refers-To-Target-URI", _quoted(refers[1])), ("WARC-Refers-To-Date", date)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(member: bytes) -> dict:
    """The columns of RECORD from a record's gzip member. A payload that doesn't have the digest of its head is an error."""
    raw = zlib.decompress(member, 31)
    top, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    head, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": _page_of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": kind, "refers_to": _page_of(refers) if refers else None, "payload_bytes": size, "payload_digest": digest, "payload": payload.decode("utf-8", "replace") if kind == "response" else None}


def planned(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Written pages with row (their number), digest, and first (page_id, row, url of the response) where the row is a revisit.

    Of equal payloads the smallest page_id is the response, of equal ids the first row; null ids come last. Only rows whose payload may
    occur again are shuffled.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumns({"digest": F.sha2(html, 256), "row": F.monotonically_increasing_id()})
    rows = scratch.keep(rows)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row", "url")
    large = rows.filter(F.octet_length("html") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    again = scratch.keep(large.filter("n > 1").select("digest", "first"))
    maybe, once = Marks(again.select(F.xxhash64("digest")), scratch).split(rows, F.xxhash64("digest"))
    named = "CASE WHEN first.row <> row THEN named_struct('page_id', first.page_id, 'row', first.row, 'url', first.url) END AS first"
    told = maybe.join(again, "digest", "left").selectExpr(*rows.columns, named)
    return told.unionByName(once.selectExpr(*rows.columns, "CAST(NULL AS STRUCT<page_id: BIGINT, row: BIGINT, url: STRING>) AS first"))


def write_archives(rows: DataFrame, root: str, date: str, scratch: Scratch) -> DataFrame:
    """Writes the rows of planned() under root and gives the captures (CAPTURE), a written table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(root)
        out, at, name = None, 0, ""
        for b in batches:
            made = []
            for r in b.to_pylist():
                if out is None or at >= ROLL:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    files.create_dir(path, recursive=True)
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                first, payload = r["first"], r["html"].encode()
                kind = "revisit" if first else "response"
                refers = (_name(first["page_id"], first["row"]), first["url"] or "") if first else None
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = packer.compress(record(kind, _name(r["page_id"], r["row"]), r["url"] or "", date, payload, r["digest"], refers)) + packer.flush()
                out.write(member)
                made.append((url_key(r["url"]), r["row"], r["page_id"], name, at, len(member), kind, r["digest"]))
                at += len(member)
            yield _batch(made, CAPTURE)
        if out is not None:
            out.close()

    return scratch.keep(small_batches(rows).select("row", "page_id", F.col("url").cast("string").alias("url"), "html", "digest", "first").mapInArrow(write, CAPTURE))


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = [(f.split()[0], pa.int64() if f.split()[1] == "bigint" else pa.string()) for f in fields.split(", ")]
    columns = list(zip(*rows)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])


def write_index(captures: DataFrame, root: str, scratch: Scratch, shard: int = SHARD) -> list[tuple[str, str]]:
    """Writes shards and directories under root; (first key, shard) in order, MOST_SHARDS at most, which is also kept there as shards.json."""
    shards = min(MOST_SHARDS, captures.count() // shard + 1)
    # the row is in the range too, so that the captures of one URL may fill many shards; equal keys sort as bytes, as Spark's strings do
    ranged = captures.repartitionByRange(shards, "key", "row").sortWithinPartitions("key", "row")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(root)
        name, at, out, blocks, held, first = uuid.uuid4().hex, 0, None, [], [], None

        def block():
            nonlocal at, out
            if out is None:
                files.create_dir(path, recursive=True)
                out = files.open_output_stream(f"{path}/{name}.cdx.gz", compression=None)
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = packer.compress("".join(held).encode()) + packer.flush()
            out.write(member)
            blocks.append(f"{held[0].split(chr(9))[0]}\t{at}\t{len(member)}\n")
            at += len(member)
            held.clear()

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                first = first or (r[0], r[1], name)
                held.append("\t".join("" if v is None else str(v) for v in r) + "\n")
                if len(held) == BLOCK:
                    block()
        if held:
            block()
        if out is not None:
            out.close()
            with files.open_output_stream(f"{path}/{name}.directory", compression=None) as f:
                f.write("".join(blocks).encode())
            yield _batch([first], "key string, row bigint, shard string")

    # ranges overlap in no row, but the rows of one URL may begin several shards
    found = scratch.keep(ranged.mapInArrow(write, "key string, row bigint, shard string")).collect()
    listed = [(r.key, r.shard) for r in sorted(found, key=lambda r: (r.key.encode(), r.row))]
    files, path = _files(root)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/shards.json", compression=None) as f:
        f.write(json.dumps(listed).encode())
    return listed


def read_shards(root: str) -> list[tuple[str, str]]:
    files, path = _files(root)
    with files.open_input_stream(f"{path}/shards.json") as f:
        return [tuple(x) for x in json.loads(f.read())]


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _span(firsts: list[bytes], key: bytes) -> range:
    """The places of a sorted list of first keys whose parts may hold the key."""
    return range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))


def lookup(urls: DataFrame, root: str, column: str = "url") -> DataFrame:
    """The captures (CAPTURE) of the distinct keys of these URLs. Null is looked up as the empty URL; URLs never captured give no row."""
    shards = read_shards(root)
    firsts = [k.encode() for k, _ in shards]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = {url_key(u) for u in b.column(0).to_pylist()}
            yield _batch([(k, shards[s][1]) for k in keys for s in _span(firsts, k.encode())], "key string, shard string")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(root)
        name, place, keys, spans, blocks, held = None, None, [], [], None, []
        number = lambda x: int(x) if x else None
        for b in batches:
            for key, shard in zip(b.column("key").to_pylist(), b.column("shard").to_pylist()):
                key = key.encode()
                if shard != name:
                    if blocks is not None:
                        blocks.close()
                    with files.open_input_stream(f"{path}/{shard}.directory") as f:
                        directory = [x.split(b"\t") for x in f.read().splitlines()]
                    keys, spans = [x[0] for x in directory], [(int(x[1]), int(x[2])) for x in directory]
                    blocks, name, place = files.open_input_file(f"{path}/{shard}.cdx.gz"), shard, None
                for k in _span(keys, key):
                    if k != place:  # keys come in order, so a block is read once
                        lines = [x.split(b"\t") for x in zlib.decompress(blocks.read_at(spans[k][1], spans[k][0]), 31).split(b"\n")[:-1]]
                        place, own = k, [x[0] for x in lines]
                    for x in lines[bisect_left(own, key) : bisect_right(own, key)]:
                        held.append((x[0].decode(), int(x[1]), number(x[2]), x[3].decode(), int(x[4]), int(x[5]), x[6].decode(), x[7].decode()))
                    if len(held) >= BLOCK:
                        yield _batch(held, CAPTURE)
                        held = []
        yield _batch(held, CAPTURE)
        if blocks is not None:
            blocks.close()

    asked = urls.select(F.col(column).cast("string")).mapInArrow(route, "key string, shard string").distinct()
    # a number is given, as the few bytes of a question stand for many of the index
    return asked.repartition(max(1, min(len(shards), _tasks(urls.sparkSession))), "shard").sortWithinPartitions("shard", "key").mapInArrow(find, CAPTURE)


def read(captures: DataFrame, root: str) -> DataFrame:
    """The records (RECORD) of captures, read by byte range; neighbours in an archive are read at once. Revisits have no payload."""
    near = captures.select("archive", "offset", "length").repartition(_tasks(captures.sparkSession), "archive", F.shiftright("offset", STRETCH_BITS)).sortWithinPartitions("archive", "offset")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if held and (r[0] != held[-1][0] or r[1] != held[-1][1] + held[-1][2] or size + r[2] > READ):
                    yield held
                    held, size = [], 0
                held.append(r)
                size += r[2]
        if held:
            yield held

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(root)
        name, archive, names = None, None, [f.split()[0] for f in RECORD.split(", ")]
        for run in runs(batches):
            if run[0][0] != name:
                if archive is not None:
                    archive.close()
                name = run[0][0]
                archive = files.open_input_file(f"{path}/{name}")
            start = run[0][1]
            raw = archive.read_at(sum(r[2] for r in run), start)
            made, size = [], 0
            for _, offset, length in run:
                made.append(parsed(raw[offset - start : offset - start + length]))
                size += len(made[-1]["payload"] or "")
                if size > READ:
                    yield _batch([tuple(m[n] for n in names) for m in made], RECORD)
                    made, size = [], 0
            yield _batch([tuple(m[n] for n in names) for m in made], RECORD)
        if archive is not None:
            archive.close()

    return near.mapInArrow(fetch, RECORD)


class Archive:
    """Archives and their index under one folder that driver and executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, pages: DataFrame, scratch: Scratch, date: str = "1970-01-01T00:00:00Z", shard: int = SHARD) -> DataFrame:
        """Writes a record for each row of pages (page_id, url, html; other columns are left out) and the index; gives the captures.

        Null html is an empty payload, null url an empty one; a payload under LEAST_PAYLOAD bytes is always a response. Repeated rows have
        a record each. An empty table writes an empty index.
        """
        captures = write_archives(planned(pages, scratch), f"{self.root}/archives", date, scratch)
        write_index(captures, f"{self.root}/index", scratch, shard)
        return captures

    def lookup(self, urls: DataFrame, column: str = "url") -> DataFrame:
        return lookup(urls, f"{self.root}/index", column)

    def read(self, captures: DataFrame) -> DataFrame:
        return read(captures, f"{self.root}/archives")


def roundtrip(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, found again by the URLs of the pages."""
    archive = Archive(pages.sparkSession, f"{scratch.root}/warc")
    archive.write(pages, scratch)
    records = archive.read(archive.lookup(pages.select("url")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {LEAST_PAYLOAD} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST_PAYLOAD} AND page_id <> first THEN first END AS refers_to
FROM f
"""
