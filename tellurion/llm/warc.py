"""WARC archives: written one gzip member a record, read back sequentially.

Writing.  Payload digests are computed on the executors' JVM; payloads of at least
``LEAST`` bytes that are met more than once get one response record, the page with
the largest id, and revisit records for the others.  The digests that are shared come to
the pages while they are few (counted), by a shuffle beyond.  Each task writes archives
of some ``MAX_ARCHIVE`` bytes under names of its own and reports them; the manifest, a
table that Spark commits, names those of the tasks that count.  Others are never read.

Reading.  An archive is a stream: bytes are inflated member by member in steps of
``STEP`` bytes, and one record is held at a time, so archives may be of any size.
Content-Length frames the block; block digests are verified where a record has one,
payload digests of all but revisits.  With a manifest, every archive must be there and
hold as many records as were written.  Archives from elsewhere are read without one:
records of any kind, with or without the optional headers; in records of HTTP messages the
payload is the body.

Defined results: null html is an empty payload; records shorter than ``LEAST``
are always responses; pages that repeat the largest id of a group are all
responses; page ids are longs, null ones are kept (records from elsewhere have none); an
empty table gives an empty result; other columns are ignored.  A damaged record, or a
missing archive, raises ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm.files import fresh_name, full, qualified, system_of
from tellurion.sources.scratch import fresh_path, materialise

LEAST = 1000
MAX_ARCHIVE = 16 << 20
STEP = 1 << 16
LEVEL = 6
MOST_SHARED = 1_000_000
PAGE = "urn:page:"
NO_PAGE = "urn:page-none:"


def _b32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit has an empty block and the full payload's digest and length."""
    block = payload if refers_to is None else b""
    name = f"{PAGE}{page_id}" if page_id is not None else f"{NO_PAGE}{digest}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{_b32(digest)}",
        f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(block).hexdigest())}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{PAGE}{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "replace") + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


MANIFEST = "uri string, records long, bytes long"


def write_archives(pages: DataFrame, folder: str, max_archive: int = MAX_ARCHIVE) -> None:
    """Write every row of ``pages`` (page_id, url, html) to archives and a manifest below ``folder``."""
    root = qualified(pages.sparkSession, folder)
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"), F.sha1(body).alias("digest"))
    heads = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(body).alias("digest"), F.octet_length(body).alias("n")).where(F.col("n") >= LEAST)
    shared = heads.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first")).where("n > 1 and first is not null").select("digest", "first")
    shared = materialise(shared, "shared-payloads")
    marked = rows.join(F.broadcast(shared) if shared.count() <= MOST_SHARED else shared, "digest", "left")
    own = F.when(F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first")).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, records, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["uri", "records", "bytes"])

        for b in batches:
            for i in range(b.num_rows):
                page, url, payload, digest, first = (b.column(c)[i].as_py() for c in ("page_id", "url", "payload", "digest", "refers_to"))
                m = member(record(page, url, payload, digest, first))
                if out is not None and size + len(m) > max_archive:
                    yield closed()
                    out = None
                if out is None:
                    uri, records, size = f"{root}/{fresh_name('part', '.warc.gz')}", 0, 0
                    system, path = system_of(uri)
                    out = system.open_output_stream(path, compression=None)
                out.write(m)
                records, size = records + 1, size + len(m)
        if out is not None:
            yield closed()

    marked.select("page_id", "url", "payload", "digest", own.alias("refers_to")).mapInArrow(run, MANIFEST).write.parquet(f"{root}/manifest")


def members(read) -> Iterator[bytes]:
    """The inflated gzip members of a stream (``read``: n -> bytes), inflated in steps."""
    held = read(STEP)
    while held:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if not held:
                raise ValueError("archive ends inside a member")
            try:
                out.append(z.decompress(held))
            except zlib.error as e:
                raise ValueError("archive is damaged") from e
            held = z.unused_data or read(STEP)
        yield b"".join(out)


def _digest_of(text: str) -> tuple[str, bytes] | None:
    """Algorithm and bytes of a labelled digest in base 32 or hex; None for a label that isn't known."""
    label, _, value = text.partition(":")
    size = {"sha1": 20, "sha256": 32, "md5": 16}.get(label.lower().replace("-", ""))
    if size is None:
        return None
    try:
        raw = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError as e:
        raise ValueError(f"{text} is no digest") from e
    return label.lower().replace("-", ""), raw


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, block and payload of one record, framed by Content-Length and checked against the digests it has."""
    cut = raw.find(b"\r\n\r\n")
    lines = raw[:cut].decode("utf-8", "replace").split("\r\n")
    if cut < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in " \t" and last:  # a folded line
            head[last] += " " + line.strip()
        else:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            head[last] = value.strip()
    if "warc-type" not in head or not head.get("content-length", "").isdigit():
        raise ValueError("record lacks its type or length")
    n = int(head["content-length"])
    block = raw[cut + 4 : cut + 4 + n]
    if len(block) != n or raw[cut + 4 + n :] != b"\r\n\r\n":
        raise ValueError("record is not as long as it says")
    payload = block
    if head.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    for name, data in (("warc-block-digest", block), ("warc-payload-digest", payload)):
        if name in head and not (name == "warc-payload-digest" and head["warc-type"] == "revisit"):
            want = _digest_of(head[name])
            if want and hashlib.new(want[0], data).digest() != want[1]:
                raise ValueError("digest does not match")
    return head, block, payload


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(name: str | None) -> int | None:
    name = (name or "").strip("<>")
    return int(name[len(PAGE) :]) if name.startswith(PAGE) and name[len(PAGE) :].lstrip("-").isdigit() else None


def _row(head: dict[str, str], payload: bytes) -> dict:
    revisit = head["warc-type"] == "revisit"
    given = _digest_of(head["warc-payload-digest"]) if "warc-payload-digest" in head else None
    length = head.get("warc-payload-length", "")
    return {
        "page_id": _page(head.get("warc-record-id")), "url": head.get("warc-target-uri"),
        "payload_bytes": len(payload) if not revisit else int(length) if length.isdigit() else None,
        "payload_digest": hashlib.sha1(payload).hexdigest() if not revisit else given[1].hex() if given and given[0] == "sha1" else None,
        "record_type": head["warc-type"], "refers_to": _page(head.get("warc-refers-to")), "payload": None if revisit else payload}


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row a record: page_id, url, payload_bytes, payload_digest (SHA-1, hex), record_type, refers_to[, payload]."""
    root = qualified(spark, folder)
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(root).select(F.col("path").alias("uri"))
    jvm = spark._jvm
    manifest = jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    if manifest.getFileSystem(spark._jsc.hadoopConfiguration()).exists(manifest):
        told = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").select("uri", "records")
        if not told.join(there.select(name(F.col("uri")).alias("_n")), name(F.col("uri")) == F.col("_n"), "left_anti").isEmpty():
            raise ValueError(f"an archive of {root} is missing")
        there = told
    else:
        there = there.withColumn("records", F.lit(None).cast("long"))
    schema = READ_SCHEMA + (", payload binary" if with_payload else "")
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    names = [c for c in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload") if with_payload or c != "payload"]

    def run(batches):
        for b in batches:
            for uri, records in zip(b.column("uri").to_pylist(), b.column("records").to_pylist()):
                system, path = system_of(full(uri))
                rows, held, seen = [], 0, 0
                with system.open_input_stream(path, compression=None) as f:
                    for raw in members(lambda n, f=f: f.read(n)):
                        head, _, payload = parse(raw)
                        rows.append(_row(head, payload))
                        held, seen = held + len(payload), seen + 1
                        if held > MAX_ARCHIVE or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in names], names=names)
                            rows, held = [], 0
                if records is not None and seen != records:
                    raise ValueError(f"{uri} holds {seen} records, {records} were written")
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in names], names=names)

    return there.repartition(max(1, min(there.count(), 65_536)), "uri").mapInArrow(run, schema)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """All of ``pages`` written to archives and read back."""
    folder = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder).drop("url")


ORACLE = """
SELECT page_id, strlen(p)::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN shared AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN shared AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM (SELECT page_id, p, d, strlen(p) >= 1000 AND count(*) OVER (PARTITION BY d) > 1 AS shared,
             max(page_id) OVER (PARTITION BY d) AS top
      FROM (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS d FROM pages))
"""
