"""WARC: records in gzip archives, and a normaliser that makes every record its own gzip member with an offset index.

``write_monolithic`` writes WARC/1.1 records, many to a single gzip stream (one member for the whole file). ``normalise``
inflates such a stream once, in pieces, cuts it into records by their headers, writes each record as a member of its own
and lists the members' offsets and lengths. ``sidecar`` makes that list a table of its own, and ``read`` fetches the
records that such a table names, by their offsets alone.

Archives are rows of a table (name, content), written by Spark's own writer: that works on any store, and a lost task's
archives are written again as a whole. The index is another table, with a row for each record; looking up or filtering
records touches no content. A reader of all records takes each archive's own list and joins nothing. An archive ends once it holds ``archive_bytes`` of records, so it is larger than that by less
than its last record, and is handled by itself. Batches between Spark and Python are bounded by bytes
(``spark.sql.execution.arrow.maxBytesPerBatch``); no setting is changed and any batch size gives the same.

Deduplication: of pages with equal payloads of at least ``least`` bytes, the one with the largest id is a response; others
are revisit records (WARC-Refers-To, no payload; the stored HTTP header keeps the payload's length).

Defined cases: null html is an empty payload; a null url leaves the target header out; null ids are written as an empty
id and never referred to; rows that share the largest id are all responses; repeated rows are separate records; line ends
in a url are percent-encoded; an empty table gives no archives; other columns are ignored.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import drop_stored, stored

_DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response, or a revisit if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def headers(data: bytes) -> dict[str, str]:
    """Header fields of a record (or of the HTTP message in it), names in lower case."""
    lines = data.partition(_END)[0].decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def split_records(content: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The records of a gzip file, inflated once from front to back, whatever its members are."""
    engine, rest = zlib.decompressobj(31), b""
    view, at = memoryview(content), 0
    while at < len(view) or rest:
        if at < len(view):
            more = engine.decompress(view[at : at + piece])
            used = min(piece, len(view) - at) - len(engine.unused_data)
            at += used
            if engine.eof and at < len(view):
                engine = zlib.decompressobj(31)
            rest += more
        start, whole = 0, True
        while (stop := rest.find(_END, start)) >= 0:
            n = int(headers(rest[start : stop + 4])["content-length"])
            if len(rest) < stop + 8 + n:
                break
            yield rest[start : stop + 8 + n]
            start = stop + 8 + n
        rest, whole = rest[start:], at < len(view)
        if not whole and rest:
            raise ValueError("a record is cut off")


def with_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: refers_to is null for responses."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    small = stored(rows.where(F.length("payload") >= least).select("page_id", "digest"))
    answers = stored(small.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", "first"))
    # only ids and digests meet on the digest (two stored tables, so that Spark splits a hot one); payloads move by page id
    revisits = small.join(answers, "digest").where("first is not null and not (page_id <=> first)").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("first").alias("refers_to"))
    revisits = stored(revisits.distinct())
    for done in (small, answers):
        drop_stored(done)
    return rows.join(revisits, rows["page_id"].eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_monolithic(rows: DataFrame, archive_bytes: int = 16 << 20) -> DataFrame:
    """``name, content``: gzip files of one member each, of the rows of :func:`with_types`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine, parts, size, n = None, [], 0, 0
        part = TaskContext.get().partitionId()

        def file() -> pd.DataFrame:
            return pd.DataFrame({"name": [f"part-{part:05d}-{n:05d}.warc.gz"], "content": [b"".join(parts) + engine.flush()]})

        for b in batches:
            for p, u, x, d, r in zip(b["page_id"], b["url"], b["payload"], b["digest"], b["refers_to"], strict=True):
                engine = engine or zlib.compressobj(1, zlib.DEFLATED, 31)
                data = record(None if pd.isna(p) else int(p), u, bytes(x), d, None if pd.isna(r) else int(r))
                parts.append(engine.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    yield file()
                    engine, parts, size, n = None, [], 0, n + 1
        if engine:
            yield file()

    return rows.mapInPandas(run, "name string, content binary")


def normalise(archives: DataFrame, level: int = 6) -> DataFrame:
    """``name, content, records``: every record a gzip member; records lists each one's id, offset and length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["name"], b["content"], strict=True):
                members, records, at = [], [], 0
                for data in split_records(bytes(content)):
                    member = gzip.compress(data, level, mtime=0)
                    members.append(member)
                    records.append({"record_id": headers(data)["warc-record-id"], "offset": at, "length": len(member)})
                    at += len(member)
                yield pd.DataFrame({"name": [name], "content": [b"".join(members)], "records": [records]})

    return archives.mapInPandas(run, "name string, content binary, records array<struct<record_id: string, offset: long, length: long>>")


def sidecar(normalised: DataFrame) -> DataFrame:
    """``name, record_id, offset, length``: the index of normalised archives, a row for each record."""
    return normalised.select("name", F.explode("records").alias("r")).select("name", "r.*")


def read(archives: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload`` of every record, by its offset; with
    ``index``, of the records that it has (rows of the sidecar): only the archives it names are read, each joined to its places.

    Length and digest are of the full payload; those of a response are computed from it, and a response whose digest
    differs from its header raises ValueError. ``payload`` is null for revisits.
    """
    import hashlib

    def number(urn: str | None) -> int | None:
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content, places in zip(b["content"], b["places"], strict=True):
                out = []
                for at, n in ((p["offset"], p["length"]) for p in places):
                    data = gzip.decompress(content[at : at + n])
                    head, block = headers(data), data.partition(_END)[2][:-4]
                    http, payload = headers(block), block.partition(_END)[2]
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    response = head["warc-type"] == "response"
                    if response and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"digest of {head['warc-record-id']}")
                    size = len(payload) if response else int(http["content-length"])
                    out.append((number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], number(head.get("warc-refers-to")), size, digest, payload if response else None))
                yield pd.DataFrame(out, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"], dtype=object)

    if index is None:
        placed = archives.select("content", F.col("records").alias("places"))
    else:
        places = index.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"))  # of one archive
        placed = archives.select("name", "content").join(places, "name").select("content", "places")
    return placed.mapInPandas(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archive(pages: DataFrame, archive_bytes: int = 16 << 20, **names: str) -> tuple[DataFrame, DataFrame]:
    """Write pages as monolithic archives and normalise them: the table of archives (name, content, records) and, as a table
    of its own, the sidecar index."""
    whole = stored(write_monolithic(with_types(pages, **names), archive_bytes))
    both = stored(normalise(whole))
    drop_stored(whole)
    return both, stored(sidecar(both))
