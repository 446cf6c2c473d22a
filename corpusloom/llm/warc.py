"""WARC archives: writing captures, reading records, and assembling the transactions.

``write_archives`` writes, per page, a request, a response or revisit, and a metadata record, each its own
gzip member, as crawlers do. ``read_archives`` parses archives back into one row per record. ``assemble``
joins request, response and metadata records through their concurrent-to identifiers and gives one nested
row per capture.

Captures are keyed by the place (file, offset) of their response or revisit, so equal record ids can't mix
captures. A record belongs to the capture whose response names it, else to that whose response it names,
else to that of a record it names, step by step until a step places none; records that lead nowhere become
captures of their own without a response.

Defined results: a null html is an empty payload; a null url is written as an empty target; a null page id
stays null and is below all others; rows that repeat the largest page id of a payload are all responses;
long payloads are written and read whole; an empty table gives no records and no captures.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import new_path, small_batches, spread_join, table, written

#: Payloads below this many bytes are always stored.
REVISIT_BYTES = 1000
#: An archive file ends after this many compressed bytes.
FILE_BYTES = 256_000_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "file string, at long, record_type string, record_id string, concurrent array<string>, target_uri string, date string, "
    "refers_to string, content_type string, payload_digest string, payload_bytes long, http_head string, payload binary"
)


def _urn(*parts: object) -> str:
    return "<urn:uuid:" + str(uuid.UUID(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest())) + ">"


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    raw = head.encode() + block + b"\r\n\r\n"
    #: Short records get a short window, which is much quicker to set up.
    z = zlib.compressobj(level, zlib.DEFLATED, 26, 4) if len(raw) < 1000 else zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def with_digests(pages: DataFrame) -> DataFrame:
    """Adds the payload, its SHA-1 and length, and of larger repeated payloads the page that stores it."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    slim = pages.select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n"))
    keeper = slim.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    joined = spread_join(rows, keeper, ["digest"], "copies", ["page_id", "url"], pages.count(), "left")
    return joined.withColumn("revisit", ~F.coalesce(F.col("page_id").eqNullSafe(F.col("keeper")) | F.col("keeper").isNull(), F.lit(True)))


def _records(row: dict, pid: int, no: int, file: str, level: int) -> bytes:
    request, meta = _urn("request", file, no), _urn("metadata", file, no)
    stored = row["keeper"] is not None and not row["revisit"]
    own = _urn("stored", row["digest"]) if stored else _urn("capture", file, no)
    url, digest = row["url"].replace("\r", "%0D").replace("\n", "%0A"), "sha1:" + _base32(row["digest"])
    common = [("WARC-Target-URI", url), ("WARC-Date", DATE)]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n']}\r\n\r\n".encode()
    main = [("WARC-Record-ID", own), ("WARC-Concurrent-To", request), *common, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if row["revisit"]:
        main = [("WARC-Type", "revisit"), *main, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn("stored", row["digest"]))]
        block = head
    else:
        main = [("WARC-Type", "response"), *main]
        block = head + row["payload"]
    path = url.split("/", 3)[3] if url.count("/") >= 3 else ""
    fields = f"page_id: {row['page_id']}\r\n" if row["page_id"] is not None else "via: none\r\n"
    return (
        _member([("WARC-Type", "request"), ("WARC-Record-ID", request), *common, ("Content-Type", "application/http; msgtype=request")], f"GET /{path} HTTP/1.1\r\n\r\n".encode(), level)
        + _member(main, block, level)
        + _member([("WARC-Type", "metadata"), ("WARC-Record-ID", meta), ("WARC-Concurrent-To", request), *common, ("Content-Type", "application/warc-fields")], fields.encode(), level)
    )


def write_archives(pages: DataFrame, folder: str, level: int = 3) -> list[str] | DataFrame:
    """Writes ``pages`` (page_id, url, html) to gzipped archives under ``folder`` (a URI all executors see).

    Returns a table of the files. A task writes under names of its own and only files of tasks that ended
    are in the table, so retried and speculative tasks leave nothing that is read.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(folder)
        pid = TaskContext.get().partitionId()
        files, held, out, name, no = [], 0, None, "", 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{root}/{pid:06d}-{uuid.uuid4().hex}.warc.gz"
                    fs.create_dir(root, recursive=True)
                    out, held = fs.open_output_stream(name, compression=None), 0
                    info = {"software": "corpusloom", "format": "WARC File Format 1.1"}
                    held += out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn("info", name)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], "".join(f"{k}: {v}\r\n" for k, v in info.items()).encode(), level))
                no += 1
                blob = _records(row, pid, no, name, level)
                out.write(blob)
                held += len(blob)
                if held >= FILE_BYTES:
                    out.close()
                    files.append((name, held))
                    out = None
        if out is not None:
            out.close()
            files.append((name, held))
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in files], pa.string()), pa.array([n for _, n in files], pa.int64())], ["file", "bytes"])

    rows = with_digests(pages).select("page_id", "url", "payload", "digest", "n", "keeper", "revisit")
    return written(rows.mapInArrow(run, "file string, bytes long"), "archives")


def parse_records(stream, file: str = "") -> Iterator[dict]:
    """Records of one archive, gzipped by member or plain, one at a time."""
    for at, source in _members(stream):
        line = source.readline()
        while line in (b"\r\n", b"\n"):
            line = source.readline()
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{file}: no record at byte {at}")
        headers: dict[str, list[str]] = {}
        while (line := source.readline().rstrip(b"\r\n")):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(k.strip().lower(), []).append(v.strip())
        block = source.read(int(headers["content-length"][0]))
        yield _row(headers, block, file, at)


class _Plain:
    """Lines and blocks of an unzipped archive."""

    def __init__(self, first: bytes, stream):
        self.held, self.stream, self.at = first, stream, 0

    def readline(self) -> bytes:
        while (i := self.held.find(b"\n")) < 0:
            more = self.stream.read(1 << 20)
            if not more:
                i = len(self.held) - 1
                break
            self.held += more
        out, self.held = self.held[: i + 1], self.held[i + 1 :]
        self.at += len(out)
        return out

    def read(self, n: int) -> bytes:
        parts, have = [self.held[:n]], min(n, len(self.held))
        self.held = self.held[n:]
        while have < n and (more := self.stream.read(n - have)):
            parts.append(more)
            have += len(more)
        self.at += have
        return b"".join(parts)


def _members(stream) -> Iterator[tuple[int, io.BytesIO | _Plain]]:
    first = stream.read(1 << 20)
    if first[:2] != b"\x1f\x8b":
        plain = _Plain(first, stream)
        while True:
            while plain.held[:1] in (b"\r", b"\n"):
                plain.readline()
            if not plain.held:
                plain.held = stream.read(1 << 20)
                if not plain.held:
                    return
                continue
            yield plain.at, plain
    at, held = 0, first
    while held:
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not held:
                held = stream.read(1 << 20)
                if not held:
                    raise ValueError(f"the member at byte {at} is cut off")
            used += len(held)
            parts.append(z.decompress(held))
            held = z.unused_data
        used -= len(held)
        source = io.BytesIO(b"".join(parts))
        size = len(source.getbuffer())
        while source.tell() < size:
            here = source.tell()
            yield at + here, source
            while (c := source.read(1)) in (b"\r", b"\n") and c:
                pass
            if c:
                source.seek(-1, 1)
        at += used
        held = held or stream.read(1 << 20)


def _row(headers: dict[str, list[str]], block: bytes, file: str, at: int) -> dict:
    get = lambda k: headers.get(k, [None])[0]
    kind, head, payload = get("warc-type"), None, block
    if (get("content-type") or "").startswith("application/http"):
        raw, _, payload = block.partition(b"\r\n\r\n")
        head = raw.decode("utf-8", "replace")
    digest = get("warc-payload-digest")
    if digest and digest.startswith("sha1:"):
        digest = base64.b32decode(digest[5:]).hex()
    if kind == "response":
        digest = hashlib.sha1(payload).hexdigest()
    return {
        "file": file, "at": at, "record_type": kind, "record_id": get("warc-record-id"), "concurrent": headers.get("warc-concurrent-to", []), "target_uri": get("warc-target-uri"), "date": get("warc-date"),
        "refers_to": get("warc-refers-to"), "content_type": get("content-type"), "payload_digest": digest, "payload_bytes": None if kind == "revisit" else len(payload), "http_head": head, "payload": payload,
    }


def read_archives(spark: SparkSession, files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives named by ``files.file``; a task streams whole files."""
    from pyspark.sql.types import _parse_datatype_string

    schema = pa.schema([(f.name, pa.list_(pa.string()) if "array" in f.dataType.simpleString() else {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}[f.dataType.simpleString()]) for f in _parse_datatype_string(RECORD)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(file, compression=None) as stream:
                    for row in parse_records(stream, file):
                        if not payloads and row["record_type"] in ("response", "revisit"):
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 600
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, min(files.count(), 100_000))
    return files.select("file").repartition(n, "file").mapInArrow(run, RECORD)


def _is_main() -> Column:
    return F.col("record_type").isin("response", "revisit", "resource")


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: structs ``response``, ``request`` and an array ``metadata`` of structs.

    ``records`` should be a written table, as it is read once per step.
    """
    links = records.where("record_type <> 'warcinfo'").select("file", "at", "record_id", "concurrent", _is_main().alias("main"))
    place = F.struct("file", "at").alias("capture")
    mains = links.where("main").select(place, "record_id", "concurrent")
    #: What responses name, then the responses' own ids, first come first served.
    named = mains.select(F.explode("concurrent").alias("id"), "capture", F.lit(0).alias("way")).unionByName(mains.select(F.col("record_id").alias("id"), "capture", F.lit(1).alias("way")))
    known = named.groupBy("id").agg(F.min(F.struct("way", "capture")).getField("capture").alias("capture"))
    rest = links.where("NOT main").select("file", "at", "record_id", "concurrent")
    done = rest.join(known, F.col("record_id") == F.col("id")).select("file", "at", "capture")
    rest = rest.join(known, F.col("record_id") == F.col("id"), "left_anti")
    while True:
        via = rest.select("file", "at", "record_id", F.explode("concurrent").alias("id")).join(known, "id").groupBy("file", "at", "record_id").agg(F.min("capture").alias("capture"))
        step = written(via, "links")
        if step.isEmpty():
            break
        done = done.unionByName(step.select("file", "at", "capture"))
        rest = rest.join(step.select("file", "at"), ["file", "at"], "left_anti")
        known = step.groupBy(F.col("record_id").alias("id")).agg(F.min("capture").alias("capture"))
    own = mains.select("capture.file", "capture.at", "capture").unionByName(rest.select("file", "at", place))
    where = done.unionByName(own)
    body = F.struct(*[c for c in records.columns])
    full = records.where("record_type <> 'warcinfo'").withColumn("body", body).join(where, ["file", "at"]).select("capture", "record_type", "body")
    main = _is_main()
    return full.groupBy("capture").agg(
        F.first(F.when(main, F.col("body")), ignorenulls=True).alias("response"),
        F.min_by("body", F.when(F.col("record_type") == "request", F.struct("body.file", "body.at"))).alias("request"),
        F.array_sort(F.collect_list(F.when(~main & (F.col("record_type") != "request"), F.col("body"))), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)).alias("metadata"),
    )


def op2_warc_transactions(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    files = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    records = written(read_archives(spark, files, folder, payloads=False), "records")
    fields = F.col("metadata")[0]["payload"].cast("string")
    captures = assemble(records).select(
        F.regexp_extract(fields, r"page_id: (-?\d+)", 1).alias("page"),
        F.col("response.record_type").alias("record_type"),
        F.col("response.record_id").alias("record_id"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.payload_bytes").alias("own_bytes"),
        F.col("response.refers_to").alias("target"),
        F.col("response.target_uri").alias("target_uri"),
        F.col("request.record_id").alias("request_id"),
        F.size("metadata").cast("long").alias("n_metadata"),
    )
    captures = written(captures.withColumn("page_id", F.expr("try_cast(nullif(page, '') AS bigint)")).drop("page"), "captures")
    stored = captures.where("record_type = 'response'").groupBy(F.col("record_id").alias("target")).agg(F.max("page_id").alias("refers_to"), F.max("own_bytes").alias("full_bytes"))
    wanted = captures.where("target IS NOT NULL").groupBy("target").agg(F.count(F.lit(1)).alias("copies"))
    joined = spread_join(captures, stored.join(wanted, "target"), ["target"], "copies", ["page_id", "record_id"], captures.count(), "left")
    return joined.select("page_id", F.coalesce("full_bytes", "own_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "target_uri", F.col("request_id").isNotNull().alias("has_request"), "n_metadata")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') url, encode(coalesce(html, '')) b FROM pages),
d AS (SELECT page_id, url, octet_length(b)::BIGINT n, sha1(b) digest FROM p),
k AS (SELECT digest, max(page_id) keeper FROM d WHERE n >= 1000 GROUP BY digest)
SELECT d.page_id, d.n AS payload_bytes, d.digest AS payload_digest, CASE WHEN k.keeper <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.keeper <> d.page_id THEN k.keeper END AS refers_to, d.url AS target_uri, true AS has_request, 1::BIGINT AS n_metadata
FROM d LEFT JOIN k ON k.digest = d.digest AND d.n >= 1000
"""
