"""WARC archives: write captures as transactions, read them back and assemble them.

Each capture is three records: a request, a response (or a revisit of a response
with the same payload) and a metadata record; request and metadata name the
capture in WARC-Concurrent-To. Archives are plain gzip WARC files, written by
Spark's text writer with the record end as the line end, so they can go to any
file system that Spark writes. Reading takes files whole (their size is bounded
when they are written), splits them by Content-Length alone and joins the
records of a transaction by their concurrent-to identifiers into one nested row.

Of captures with equal payloads of at least MIN_REVISIT bytes, the one with the
largest page_id is the response; the others revisit it and carry only their
HTTP head.

Defined cases: a null html is an empty payload; a null url leaves the target
out; a null page_id counts as smallest; rows that repeat page_id and payload
are captures of their own (one of them can be the response); an empty table
gives an empty archive and result. Only page_id, url and html are read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, gone_on_exit, shared_dir

MIN_REVISIT = 1000
#: Payload bytes of a file at most, unless a single capture is larger.
FILE_BYTES = 64 << 20
#: Captures are written by classes of payload size, each with its own number of captures a file, so that large ones do not make the files of small ones tiny.
CLASS_BYTES = [16 << 10, 256 << 10, 4 << 20]
#: More groups of equal payloads than this are joined by a shuffle.
BROADCAST_GROUPS = 100_000
DATE = "2024-01-01T00:00:00Z"
# Record profile of a revisit with an identical payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "kind string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, date string, payload_digest string, payload_bytes bigint, fields map<string,string>"


def _uuid(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + "|"), key))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def _key(page_id: Column, digest: Column, occ: Column) -> Column:
    return F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest, occ.cast("string"))


def _record(kind: str, record_id: Column, extra: list[Column], content_type: str, body: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    return F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n"), line("WARC-Record-ID", record_id), F.lit(f"WARC-Date: {DATE}\r\n"), *extra, F.lit(f"Content-Type: {content_type}\r\n"), line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body, F.lit("\r\n"))


def plan_captures(pages: DataFrame) -> DataFrame:
    """Payload, digest and verdict (response or revisit, and of which) of each page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("bigint").alias("n"))
    small = rows.select("page_id", "digest", "n")
    repeated = small.groupBy("page_id", "digest").count().filter("count > 1").limit(1).count() > 0
    occ = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("n")) if repeated else F.lit(1)
    rows = rows.withColumn("occ", occ)
    groups = small.filter(F.col("n") >= MIN_REVISIT).groupBy("digest", "n").agg(F.count(F.lit(1)).alias("c"), F.max("page_id").alias("of")).filter("c > 1").select(F.col("digest").alias("_d"), F.col("n").alias("_n"), "c", "of")
    groups = cut(groups)  # read by each class that is written
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    rows = rows.join(F.broadcast(groups) if few else groups, (F.col("digest") == F.col("_d")) & (F.col("n") == F.col("_n")), "left")
    is_response = F.col("c").isNull() | (F.col("page_id").eqNullSafe(F.col("of")) & (F.col("occ") == 1))
    return rows.select("page_id", "url", "html", "digest", "n", "occ", "of", is_response.alias("is_response"))


def capture_text(plan: DataFrame) -> DataFrame:
    """The records of each capture as one string, without the last line end."""
    key = _key(F.col("page_id"), F.col("digest"), F.col("occ"))
    me = _uuid("capture", key)
    of = _uuid("capture", _key(F.col("of"), F.col("digest"), F.lit(1)))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    target = F.coalesce(line("WARC-Target-URI", url), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    digest = line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))
    ask = F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n"))
    note = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    request = _record("request", _uuid("request", key), [target, line("WARC-Concurrent-To", me)], "application/http; msgtype=request", ask)
    response = _record("response", me, [target, digest], "application/http; msgtype=response", F.concat(head, "html"))
    revisit = _record("revisit", me, [target, digest, F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\n"), line("WARC-Refers-To", of)], "application/http; msgtype=response", head)
    metadata = _record("metadata", _uuid("metadata", key), [target, line("WARC-Concurrent-To", me)], "application/warc-fields", note)
    end = F.lit("\r\n")
    return plan.select(F.concat(request, end, F.when(F.col("is_response"), response).otherwise(revisit), end, metadata).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """Write one capture a page, a folder for each class of payload size; files hold FILE_BYTES of payload at most, or one capture."""
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    kind = F.aggregate(F.array(*[F.lit(b) for b in CLASS_BYTES]), F.lit(0), lambda s, b: s + (size > b).cast("int"))
    largest = {k: n for k, n in pages.groupBy(kind.alias("k")).agg(F.max(size)).collect()} or {0: 0}
    plan = plan_captures(pages)
    for k, n in sorted(largest.items()):
        # an empty table still leaves an archive without records
        some = plan.filter((F.col("n") > (CLASS_BYTES[k - 1] if k else -1)) & (F.col("n") <= n))
        capture_text(some).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, FILE_BYTES // (n + 2048))).text(f"{path}/class={k}")


def _head(data: memoryview, at: int) -> tuple[dict[str, list[str]], int]:
    raw = bytes(data[at : at + 65536])
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raw = bytes(data[at:])
        end = raw.index(b"\r\n\r\n")
    found: dict[str, list[str]] = {}
    for x in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = x.partition(":")
        found.setdefault(name.strip().lower(), []).append(value.strip())
    return found, at + end + 4


def parse(data: bytes) -> Iterator[tuple[dict[str, list[str]], memoryview]]:
    """Headers and block of each record, found by Content-Length alone."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
    view, at = memoryview(data), 0
    while at < len(view):
        if view[at : at + 2] == b"\r\n":
            at += 2
            continue
        if bytes(view[at : at + 5]) != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        head, at = _head(view, at)
        n = int(head["content-length"][0])
        yield head, view[at : at + n]
        at += n


def _row(head: dict[str, list[str]], block: memoryview, payloads: bool) -> dict:
    one = lambda name: (head.get(name) or [None])[0]
    kind, fields, n, digest = one("warc-type"), {}, None, one("warc-payload-digest")
    body = None
    if kind == "response":
        _, start = _head(block, 0)
        body = block[start:]
        n, digest = len(body), hashlib.sha1(body).hexdigest()
    elif kind == "revisit":
        http, _ = _head(block, 0)
        n, digest = int(http["content-length"][0]), digest.removeprefix("sha1:")
    elif kind == "metadata":
        for x in bytes(block).decode().split("\r\n"):
            name, colon, value = x.partition(":")
            if colon:
                fields[name.strip()] = value.strip()
    row = {"kind": kind, "record_id": one("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"), "target_uri": one("warc-target-uri"), "date": one("warc-date"), "payload_digest": digest, "payload_bytes": n, "fields": list(fields.items())}
    return row | ({"payload": bytes(body) if body is not None else None} if payloads else {})


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row a record of all archives under ``path``, with payload bytes if asked."""
    schema = RECORDS + (", payload binary" if payloads else "")
    types = [("kind", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string()))]
    arrow = pa.schema(types + ([("payload", pa.binary())] if payloads else []))

    def rows(batches):
        for batch in batches:
            for content in batch.column("content"):
                out, held = [], 0
                for head, block in parse(content.as_py()):
                    out.append(_row(head, block, payloads))
                    held += len(block) * payloads + 400
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(rows, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: its response or revisit with request, metadata and what it refers to.

    Links run from request and metadata to the capture, or back from the
    capture; both are followed. Members meet their capture by its id, and
    revisits the response they refer to.
    """
    core = records.filter(F.col("kind").isin("response", "revisit", "resource"))
    rest = records.filter(~F.col("kind").isin("response", "revisit", "resource"))
    direct = rest.filter(F.size("concurrent_to") > 0).select(F.explode("concurrent_to").alias("capture_id"), F.struct("kind", "record_id", "target_uri", "date", "fields").alias("m"))
    named = core.filter(F.size("concurrent_to") > 0).select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("_member"))
    back = rest.filter(F.size("concurrent_to") == 0).join(named, F.col("record_id") == F.col("_member")).select("capture_id", F.struct("kind", "record_id", "target_uri", "date", "fields").alias("m"))
    members = direct.unionByName(back).groupBy("capture_id").agg(
        F.max(F.when(F.col("m.kind") == "request", F.struct(F.col("m.record_id"), F.col("m.target_uri"), F.col("m.date")))).alias("request"),
        F.max(F.when(F.col("m.kind") == "metadata", F.struct(F.col("m.record_id"), F.col("m.fields").getItem("page_id").alias("page_id")))).alias("metadata"),
    )
    rows = core.join(members, F.col("record_id") == F.col("capture_id"), "left").drop("capture_id")
    head = [c for c in core.columns if c not in ("concurrent_to", "fields")]
    return rows.select(F.struct(*head).alias("capture"), "request", "metadata")


def with_referred(captures: DataFrame) -> DataFrame:
    """Captures with ``referred_page``, the page_id of the response a revisit refers to."""
    rows = captures.withColumn("page_id", F.expr("try_cast(nullif(metadata.page_id, '') AS bigint)"))
    named = rows.filter(F.col("capture.kind") == "revisit").select(F.col("capture.refers_to").alias("_of")).distinct()
    found = rows.join(named, F.col("capture.record_id") == F.col("_of")).select("_of", F.col("page_id").alias("referred_page"))
    return rows.join(found, F.col("capture.refers_to") == F.col("_of"), "left").drop("_of")


def archive_path(spark: SparkSession) -> str:
    import uuid

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    gone_on_exit(spark, path)
    return path
