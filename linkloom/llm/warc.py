"""WARC archives: segmented writing, reading and reassembly.

Writing: a record per page.  The block is an HTTP response whose payload is framed
in chunks (``Transfer-Encoding: chunked``).  A block longer than one segment
becomes a first record with WARC-Segment-Number 1 and continuation records that
name it in WARC-Segment-Origin-ID; the last one holds WARC-Segment-Total-Length.
Of pages with equal payloads of at least ``min_bytes`` the largest page_id is the
response, the others are revisit records that refer to it.  The archives are
files of Spark's text writer in the shared folder.  Chunk borders never cut a
UTF-8 character, and never leave the record separator whole inside a payload,
so the files can be split at record starts.

Reading: Spark's text reader splits the files at record starts (plain archives are
read by many tasks each, compressed ones by one; files have a bounded size).  Continuations are grouped by origin id, ordered by
segment number, joined, checked against the total length, and their chunk framing
is decoded.  A record holds at most ``segment_bytes`` plus a chunk; the group of a
record is one page.  Revisits get payload facts by a join with their response.

Defined results: null html is an empty payload; null page_id or url become empty
headers (page_id null after reading); repeated rows are separate records; a
record whose pieces are missing, in conflict or short says so in column
``problem`` and keeps its row; extra columns are ignored; an empty table
writes no records.
"""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.session import scratch_path

VERSION = "WARC/1.1\r\n"
_EPOCH = "2024-01-01T00:00:00Z"
WRITE_SCHEMA = "record string"


def chunk_ends(payload: bytes, size: int) -> list[int]:
    """Ends of the chunks of a payload: at most about ``size`` bytes, between UTF-8
    characters, and inside every occurrence of the record separator."""
    ends, at, n = [], 0, len(payload)
    marks, i = [], payload.find(b"WARC/1.1")
    while i >= 0:
        marks.append(i + 4)
        i = payload.find(b"WARC/1.1", i + 1)
    k = 0
    while at < n:
        end = min(at + size, n)
        while end < n and (payload[end] & 0xC0) == 0x80:
            end += 1
        while k < len(marks) and marks[k] <= at:
            k += 1
        if k < len(marks) and marks[k] < end:
            end = marks[k]
        ends.append(end)
        at = end
    return ends


def chunked(payload: bytes, size: int) -> list[bytes]:
    """Chunked transfer framing of a payload, one piece a chunk and the final one."""
    out, at = [], 0
    for end in chunk_ends(payload, size):
        out.append(b"%x\r\n%s\r\n" % (end - at, payload[at:end]))
        at = end
    return [*out, b"0\r\n\r\n"]


def dechunk(body: bytes) -> bytes:
    """Payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        piece = body[line + 2:line + 2 + n]
        if len(piece) != n or body[line + 2 + n:line + 4 + n] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(piece)
        at = line + 4 + n


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return (VERSION + head + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def page_records(row_id: str, page_id, url, payload: bytes, digest: str, refers_to, response_id, chunk_bytes: int,
                 segment_bytes: int) -> list[bytes]:
    """The WARC records of one page."""
    main = f"<urn:uuid:{row_id}>"
    clean = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A").replace("WARC/1.1", "WARC/1%2E1")
    common = [("WARC-Type", "revisit" if response_id else "response"), ("WARC-Record-ID", main), ("WARC-Date", _EPOCH),
              ("WARC-Target-URI", clean), ("X-Page-ID", None if page_id is None else str(page_id)),
              ("WARC-Payload-Digest", f"sha1:{digest}")]
    if response_id:
        return [_record([*common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                         ("WARC-Refers-To", f"<urn:uuid:{response_id}>"), ("X-Refers-To-Page-ID", str(refers_to))],
                        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")]
    pieces = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n",
              *chunked(payload, chunk_bytes)]
    segments, cur, size = [], [], 0
    for p in pieces:
        if cur and size + len(p) > segment_bytes:
            segments.append(b"".join(cur))
            cur, size = [], 0
        cur.append(p)
        size += len(p)
    segments.append(b"".join(cur))
    if len(segments) == 1:
        return [_record(common, segments[0])]
    total = str(sum(map(len, segments)))
    out = [_record([*common, ("WARC-Segment-Number", "1")], segments[0])]
    for k, s in enumerate(segments[1:], 2):
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.UUID(row_id), str(k))}>"),
                            ("WARC-Date", _EPOCH), ("WARC-Target-URI", clean), ("WARC-Segment-Origin-ID", main),
                            ("WARC-Segment-Number", str(k)),
                            ("WARC-Segment-Total-Length", total if k == len(segments) else None)], s))
    return out


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000, chunk_bytes: int = 4096,
                   segment_bytes: int = 16384, records_a_file: int = 50_000) -> None:
    """Write ``pages`` (page_id, url, html) as .gz WARC files of bounded size under ``path``."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    # the name of a record follows from its row, so a task that runs again writes the same record
    name = F.sha2(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.col("page_id").cast("string"),
                              F.coalesce("url", F.lit("")), F.sha2("html", 256)), 256)
    p = p.select("*", F.octet_length("html").alias("n"), F.sha2("html", 256).alias("full"), name.alias("name"))
    # narrow rows: the response of each group of equal payloads (map-side combined)
    best = (p.where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("full", "n")
            .agg(F.max(F.struct("page_id", "name")).alias("best"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
            .select(F.col("full").alias("f"), F.col("n").alias("fn"), "best"))
    j = p.join(best, (F.col("full") == F.col("f")) & (F.col("n") == F.col("fn")), "left")

    def records(batches):
        for b in batches:
            out = []
            for pid, url, html, name, ref, ref_name in zip(b["page_id"], b["url"], b["html"], b["name"], b["ref"], b["ref_name"]):
                pid = None if pd.isna(pid) else int(pid)
                mine = isinstance(ref_name, str) and pid is not None and pid != int(ref)
                payload = html.encode()
                for r in page_records(str(uuid.UUID(name[:32])), pid, url if isinstance(url, str) else None, payload,
                                      hashlib.sha1(payload).hexdigest(), int(ref) if mine else None,
                                      str(uuid.UUID(ref_name[:32])) if mine else None, chunk_bytes, segment_bytes):
                    out.append(r.decode()[:-1])  # the writer ends each line with the record's last \n
            yield pd.DataFrame({"record": out})

    j.select("page_id", "url", "html", "name", F.col("best.page_id").cast("string").alias("ref"),
             F.col("best.name").alias("ref_name")).mapInPandas(records, WRITE_SCHEMA) \
        .write.option("maxRecordsPerFile", records_a_file).text(path, compression="gzip")


def _header(name: str):
    return F.nullif(F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a WARC record of the files under ``path``: its headers and block."""
    raw = spark.read.option("lineSep", VERSION).text(path).where("length(value) > 0")
    cut = F.instr("value", "\r\n\r\n")
    x = raw.select(F.substring("value", F.lit(1), cut - 1).alias("head"),
                   F.expr("substring(cast(value as binary), octet_length(substring(value, 1, instr(value, '\r\n\r\n') + 3)) + 1)")
                   .alias("tail"))
    n = _header("Content-Length").cast("int")
    return x.select(
        _header("WARC-Type").alias("type"), _header("WARC-Record-ID").alias("record_id"),
        _header("WARC-Target-URI").alias("url"), _header("X-Page-ID").cast("long").alias("page_id"),
        _header("WARC-Payload-Digest").alias("digest"), _header("WARC-Refers-To").alias("refers_to_id"),
        _header("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        _header("WARC-Segment-Origin-ID").alias("origin"),
        F.coalesce(_header("WARC-Segment-Number").cast("int"), F.lit(1)).alias("segment"),
        _header("WARC-Segment-Number").isNotNull().alias("segmented"),
        _header("WARC-Segment-Total-Length").cast("long").alias("total"), n.alias("content_length"),
        F.substring(F.col("tail"), F.lit(1), n).alias("block"),
        F.octet_length("tail").alias("tail_bytes"))


def reassemble(records: DataFrame) -> DataFrame:
    """One row a response or revisit: record_id, type, url, page_id, digest,
    refers_to, refers_to_id, payload (binary; null for revisits), problem.

    Whole records pass by; only segments are grouped by origin id."""
    r = records.withColumn("short", F.col("tail_bytes") < F.col("content_length"))
    meta = ["type", "url", "page_id", "digest", "refers_to", "refers_to_id"]
    whole = r.where("not segmented").select("record_id", *meta, F.col("block"), F.when(F.col("short"), "record cut short").alias("problem"))
    seg = r.where("segmented").withColumn("origin", F.coalesce("origin", "record_id"))
    # a set: repeated rows of a table are records with the same name and content
    g = seg.groupBy("origin").agg(
        F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"),
        F.max("segment").alias("last"), F.count_if(F.col("segment") == 1).alias("copies"), F.max("short").alias("short"),
        F.max(F.when(F.col("segment") == 1, F.struct(*meta))).alias("m"))
    joined = g.select(
        F.col("origin").alias("record_id"), *[F.col(f"m.{c}").alias(c) for c in meta],
        F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.block))").alias("block"), "total", "last",
        F.size("parts").alias("n"), "short", F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1)))))
    joined = joined.select(
        "record_id", *meta, "block",
        F.when(F.col("short"), "record cut short").when(F.col("type").isNull(), "first segment missing")
        .when((F.col("n") != F.col("last")) | F.col("total").isNull(), "segments missing or in conflict")
        .when(F.octet_length("block") != F.col("total"), "total length differs").alias("problem"))
    both = whole.unionByName(joined)

    def decode(batches):
        for b in batches:
            payloads, problems = [], []
            for kind, block, problem in zip(b["type"], b["block"], b["problem"]):
                payload = None
                if kind == "response" and not isinstance(problem, str):
                    try:
                        head, _, body = bytes(block).partition(b"\r\n\r\n")
                        payload = dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body
                    except ValueError as e:
                        problem = f"chunk framing: {e}"
                payloads.append(payload)
                problems.append(problem if isinstance(problem, str) else None)
            yield b.drop(columns=["block", "problem"]).assign(payload=payloads, problem=problems)

    schema = ("record_id string, type string, url string, page_id long, digest string, refers_to long, "
              "refers_to_id string, payload binary, problem string")
    out = both.withColumn("page_id", F.col("page_id").cast("string")).withColumn(
        "refers_to", F.col("refers_to").cast("string"))
    text_ids = schema.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string")
    return out.mapInPandas(decode, text_ids).withColumns(
        {"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row a page of the archives: page_id, url, record_type, payload_bytes,
    payload_digest, refers_to, problem.  A revisit takes size and digest from the
    response that it refers to; a digest header that differs is a problem."""
    r = reassemble(read_records(spark, path)).select(
        "record_id", "type", "url", "page_id", "refers_to", "refers_to_id", F.regexp_replace("digest", "^sha1:", "").alias("said"),
        F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha"), "problem")
    responses = r.where("type = 'response' and bytes is not null").groupBy(F.col("record_id").alias("rid")).agg(
        F.max("bytes").alias("rbytes"), F.max("sha").alias("rsha"))
    done = r.where("type = 'response'").select("page_id", "url", F.col("type").alias("record_type"), "bytes", "sha", "refers_to",
                                              "said", "problem")
    back = r.where("type = 'revisit'").join(responses, F.col("refers_to_id") == F.col("rid"), "left").select(
        "page_id", "url", F.col("type").alias("record_type"), F.col("rbytes").alias("bytes"), F.col("rsha").alias("sha"),
        "refers_to", "said", F.coalesce("problem", F.when(F.col("rid").isNull(), "response missing")).alias("problem"))
    return done.unionByName(back).select(
        "page_id", "url", "record_type", F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"),
        "refers_to", F.coalesce("problem", F.when(F.col("said") != F.col("sha"), "digest differs")).alias("problem"))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    write_archives(pages, path, **options)
    return archived_pages(spark, path)
