"""WARC archives, index first.

Records are written as one gzip member each, many to a file.  While writing, every
record's file, offset, length, URL and digest go into an index table.  Reading selects
rows of the index, sorts them by place and coalesces near byte ranges into few reads.

Of pages with equal payloads the one with the smallest page_id is the response; the
others are revisits that refer to it and carry no payload.  Record ids are unique; that of
a response others may refer to is made from its digest, so that a revisit can name it
wherever it is written.  Frequent digests are resolved as in ``exact_dedup``.

Cases: null html is an empty payload, null urls are written as ``urn:none``; rows that
repeat page_id and payload: one of those with the smallest url (nulls first) is the
response and the others revisit it; null page_ids rank below every other, and an empty
string is a page_id like any other; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import fresh_path, materialize, open_fs
from tidewater.llm.exact_dedup import with_groups

#: Bytes between two wanted records that are read along rather than skipped, and the
#: most that is read at once.
GAP, MOST = 1 << 16, 1 << 23
INDEX = "page_id {0}, url string, name string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to {0}"


def _key(name: str = "page_id"):
    """A page_id as one string without nulls."""
    return F.coalesce(F.concat(F.lit("v"), F.col(name).cast("string")), F.lit("n"))


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """One row per distinct (page_id, payload), written: who is first among equal payloads.

    (_key, sha, rows, first_url, first_id, leads, small).  Payloads under ``least`` bytes
    are never revisits."""
    payload = _payload()
    keys = materialize(
        pages.groupBy("page_id", F.sha1(payload).alias("sha"), F.octet_length(payload).alias("size"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("url")).alias("_url")), "payloads")
    # the struct makes a null page_id count as the smallest; min() alone would pass it over
    joined = with_groups(keys, "sha", F.min(F.struct("page_id")).alias("_first"))
    small, first = F.col("size") < least, F.col("_first.page_id")
    return materialize(joined.select(
        _key().alias("_key"), "sha", "rows", F.col("_url.url").alias("first_url"), first.alias("first_id"),
        (small | F.col("page_id").eqNullSafe(first)).alias("leads"), small.alias("small")), "roles")


def _payload():
    return F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")


def response_id(digest: str) -> str:
    """The record id of the one response with this payload that others refer to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'sha1:{digest}')}>"


def _record(kind: str, page_id, url: str, payload: bytes, size: int, digest: str, refers_to, alone: bool, date: str) -> bytes:
    """``alone``: a response that no revisit refers to."""
    body = b"" if kind == "revisit" else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    own = f"<urn:uuid:{uuid.uuid4()}>" if alone or kind == "revisit" else response_id(digest)
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Target-URI: {url}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {response_id(digest)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _one_line(url: str | None) -> str:
    return "".join(c if c > " " else "%20" for c in url) if url else "urn:none"


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one archive a task below ``folder``; returns the index, itself written first
    among what readers use."""
    kind = pages.schema["page_id"].dataType.simpleString()
    # one key without nulls for the join, so that payloads are shuffled once
    own = pages.select(_key().alias("_key"), "page_id", "url", _payload().alias("payload")).withColumn("sha", F.sha1("payload"))
    role = roles(pages, least)
    found = own.join(role, ["_key", "sha"])
    if not role.where("rows > 1").isEmpty():
        # rows that repeat page_id and payload: equal ones are counted before they are
        # shuffled and only the first of a count carries the payload
        again = found.where("rows > 1").groupBy("_key", "sha", "url", "leads", "small", "first_url").agg(
            F.count(F.lit(1)).alias("n"), F.first("payload").alias("payload"), F.first(F.struct("page_id")).alias("_page"), F.first(F.struct("first_id")).alias("_first"))
        again = again.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth")).select(
            F.col("_page.page_id").alias("page_id"), "url", "payload", "sha", "small", F.col("_first.first_id").alias("first_id"),
            (F.col("leads") & F.col("url").eqNullSafe(F.col("first_url")) & (F.col("nth") == 1)).alias("leads"))
        found = found.where("rows = 1").select(*again.columns).unionByName(again)
    size = F.octet_length("payload").cast("long").alias("size")
    revisit = ~F.col("small") & ~F.col("leads")
    found = found.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), size, "sha", revisit.alias("revisit"), "small", "first_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_fs(folder)
        name, out, offset = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                if out is None:
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                places, digests, kinds, refers, sizes = [], [], [], [], []
                for page_id, url, payload, size, sha, revisit, small, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "sha", "revisit", "small", "first_id")), strict=True):
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    kinds.append("revisit" if revisit else "response")
                    refers.append(first if revisit else None)
                    member = gzip.compress(_record(kinds[-1], page_id, _one_line(url), payload or b"", size, digest, refers[-1], small, date), 6, mtime=0)
                    out.write(member)
                    places.append((offset, len(member)))
                    offset += len(member)
                    digests.append(digest)
                    sizes.append(size)
                ids = b.column("page_id")
                yield pa.RecordBatch.from_arrays([
                    ids, b.column("url"), pa.array([name] * b.num_rows, pa.string()), pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64()),
                    pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(kinds, pa.string()), pa.array(refers, ids.type)],
                    ["page_id", "url", "name", "offset", "length", "payload_digest", "payload_bytes", "record_type", "refers_to"])
        finally:
            if out is not None:
                out.close()

    found.mapInArrow(run, INDEX.format(kind)).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, body = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    body = body[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def ranges(places: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Sorted (offset, length) -> (from, to, first row, row after): what to read at once."""
    k = 0
    while k < len(places):
        start, end, j = places[k][0], sum(places[k]), k + 1
        while j < len(places) and places[j][0] - end <= GAP and sum(places[j]) - start <= MOST:
            end, j = max(end, sum(places[j])), j + 1
        yield start, end, k, j
        k = j


def _read(f, name: str, rows: list[dict]) -> Iterator[list[tuple]]:
    """The verified records of index rows of one file, in the lists in which they were read."""
    for start, end, a, z in ranges([(r["offset"], r["length"]) for r in rows]):
        data, got = f.read_at(end - start, start), []
        for r in rows[a:z]:
            fields, payload = parse(data[r["offset"] - start : r["offset"] - start + r["length"]])
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"{name} at {r['offset']}: the payload does not match its digest")
            got.append((fields.get("X-Page-ID"), r["url"], int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], fields.get("X-Refers-To-Page-ID"), payload))
        yield got


def read_records(spark: SparkSession, folder: str, selected: DataFrame) -> DataFrame:
    """The records of the selected index rows, read from the archives and verified:
    page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    kind = selected.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_fs(folder)
        name, f = None, None
        try:
            for b in batches:
                rows = b.to_pylist()
                k = 0
                while k < len(rows):
                    j = k
                    while j < len(rows) and rows[j]["name"] == rows[k]["name"]:
                        j += 1
                    if rows[k]["name"] != name:
                        if f is not None:
                            f.close()
                        name, f = rows[k]["name"], fs.open_input_file(f"{at}/{rows[k]['name']}")
                    for found in _read(f, name, rows[k:j]):
                        c = list(zip(*found, strict=True))
                        typed = [pa.array(c[i], pa.string()) for i in (0, 5)]
                        if kind != "string":
                            typed = [x.cast(b.schema.field("page_id").type) for x in typed]
                        yield pa.RecordBatch.from_arrays(
                            [typed[0], pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string()), pa.array(c[4], pa.string()), typed[1], pa.array(c[6], pa.binary())],
                            ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                    k = j
        finally:
            if f is not None:
                f.close()

    # a chunk of a file is one key, so a large archive is read by many tasks
    wanted = selected.select("page_id", "url", "name", "offset", "length").withColumn("_chunk", F.floor(F.col("offset") / (1 << 26)))
    spread = wanted.repartition("name", "_chunk").sortWithinPartitions("name", "offset")
    return spread.mapInArrow(run, f"page_id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, payload binary")


def warc_roundtrip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages and read every record back through the index."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    index = write_archives(pages, folder, least)
    return read_records(spark, folder, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
