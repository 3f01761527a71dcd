"""WARC archives: writing with segmentation, and reading back with segment reassembly.

Payloads longer than a segment are cut: the first part is a `response` record with segment number 1,
the rest are `continuation` records that name it by WARC-Segment-Origin-ID; the last carries
WARC-Segment-Total-Length.  A reader groups continuation records by that id, orders them by segment
number, verifies that no number is missing and that the total length holds, and only then decodes the
chunked transfer framing.  Unsegmented records need no shuffle.  Archives lie in the shared folder;
each task writes files of its own attempt and names them in its output, so files of
lost attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import scratch

SEGMENT = 32_768
CHUNK = 8_192
#: Uncompressed bytes after which a task begins another archive.
ARCHIVE = 64 << 20
RECORDS = "record_id string, kind string, target string, segment int, origin string, total long, digest string, payload_length long, refers_to string, block binary"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
NAME = "urn:lodestone:page:"


class WarcError(ValueError):
    """A record that breaks the format or its own declared lengths or digests."""


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """A body in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body of a chunked transfer framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise WarcError("chunk size line without an end")
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(framed) < at + size + 2 or framed[at + size : at + size + 2] != b"\r\n":
            raise WarcError("chunk shorter than its size")
        out.append(framed[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise WarcError("HTTP head without an end")
    return unchunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, block: bytes, headers: dict[str, str]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2024-01-01T00:00:00Z", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_records(page: str, url: str, payload: bytes, digest: str, refers_to: str | None, segment: int) -> Iterator[bytes]:
    """The records of one page: a revisit, a response, or a response and its continuations."""
    target = " ".join(url.split()) or "about:blank"
    common = {"WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(len(payload))}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        profile = {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        yield record("revisit", page, head, common | profile)
        return
    block = head + chunked(payload)
    if len(block) <= segment:
        yield record("response", page, block, common)
        return
    cuts = range(0, len(block), segment)
    for number, at in enumerate(cuts, 1):
        if number == 1:
            yield record("response", page, block[:segment], common | {"WARC-Segment-Number": "1"})
        else:
            own = {"WARC-Segment-Origin-ID": f"<{page}>", "WARC-Segment-Number": str(number)}
            if number == len(cuts):
                own["WARC-Segment-Total-Length"] = str(len(block))
            yield record("continuation", f"{page}:{number}", block[at : at + segment], own)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an uncompressed archive stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise WarcError(f"no record begins with {line[:20]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline().strip()) != b"":
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise WarcError("record shorter than its content length")
        yield headers, block


def write(pages: DataFrame, min_payload: int = 0, segment: int = SEGMENT) -> DataFrame:
    """Writes all pages into archives; returns a written table (path, records, bytes).

    pages: page_id, url, html; extra columns are ignored; null html is the empty payload and null url
    about:blank.  Of the records with equal payloads of at least min_payload bytes that with the
    largest page_id is the response and the others revisit it; a null page_id is always a
    response.  Rows that share that page_id are all responses.  A record's id is its page's, with a random
    part where rows share a page_id or it is null.
    """
    spark = pages.sparkSession
    base = scratch.path(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("payload"), F.sha1(html).alias("sha"), F.octet_length(html).alias("size"))
    groups = keyed.filter((F.col("size") >= min_payload) & F.col("page_id").isNotNull()).groupBy("sha", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    groups = scratch.table(groups.filter("n > 1").drop("n"), "warc-groups")
    # only members of groups are named, so that payloads without copies cross no shuffle beyond this key
    named = keyed.join(groups, ["sha", "size"], "left").withColumn("refers", F.when(F.col("page_id") < F.col("first"), F.col("first")))
    repeated = scratch.table(keyed.groupBy("page_id").count().filter("count > 1 AND page_id IS NOT NULL").drop("count"), "warc-repeated")
    if repeated.isEmpty():  # as a rule: then no row has to be looked up
        named = named.withColumn("again", F.lit(False))
    else:
        named = named.join(repeated.withColumn("again", F.lit(True)), "page_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(base)
        system.create_dir(root, recursive=True)
        out, done, where, size, records = None, [], "", 0, 0

        def close() -> None:
            out.close()
            done.append((where, records, size))

        for batch in batches:
            for page, url, payload, refers, again in zip(batch["page_id"], batch["url"], batch["payload"], batch["refers"], batch["again"]):
                if out is None:
                    where, size, records = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(where, compression=None)
                name = NAME + ("null" if pd.isna(page) else str(int(page)))
                if pd.isna(page) or again is True:
                    name += f":{uuid.uuid4().hex}"
                to = None if pd.isna(refers) else NAME + str(int(refers))
                for raw in page_records(name, url, bytes(payload), sha1_base32(bytes(payload)), to, segment):
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(pack.compress(raw) + pack.flush())
                    size += len(raw)
                    records += 1
                if size >= ARCHIVE:
                    close()
                    out = None
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return scratch.table(named.select("page_id", "url", "payload", "refers", "again").mapInPandas(run, "path string, records long, bytes long"), "warc-archives")


def read(archives: DataFrame, uri: str) -> DataFrame:
    """The records of archives (column path), one row each (RECORDS); uri: of the file system they are on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(uri)
        bare = lambda x: x.strip("<>") if x else None
        for batch in batches:
            for where in batch["path"]:
                rows, held = [], 0
                with system.open_input_stream(where, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for h, block in parse(stream):
                        number = h.get("warc-segment-number")
                        total = h.get("warc-segment-total-length")
                        digest = (h.get("warc-payload-digest") or "").partition(":")[2] or None
                        length = h.get("x-payload-length")
                        rows.append((bare(h["warc-record-id"]), h["warc-type"], h.get("warc-target-uri"), int(number) if number else None, bare(h.get("warc-segment-origin-id")), int(total) if total else None, digest, int(length) if length else None, bare(h.get("warc-refers-to")), block))
                        held += len(block)
                        if held > 8 << 20:
                            yield _records(rows)
                            rows, held = [], 0
                yield _records(rows)

    n = max(1, min(archives.count(), archives.sparkSession.sparkContext.defaultParallelism * 4))
    return archives.select("path").repartition(n).mapInPandas(run, RECORDS)


def _records(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORDS.split(", ")])
    return out.astype({"segment": "Int32", "total": "Int64", "payload_length": "Int64"})


def reassemble(records: DataFrame) -> DataFrame:
    """Whole response and revisit records: segments are joined and verified.

    Segments are grouped by origin id and joined in the order of their numbers; a group holds one page.
    A missing part or a wrong total length raises.
    """
    whole = records.filter("segment IS NULL").drop("segment", "origin", "total")
    parts = records.filter("segment IS NOT NULL").withColumn("of", F.coalesce("origin", "record_id"))

    names = whole.columns

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("segment")
        head, block = group.iloc[0], b"".join(group["block"])
        if group["segment"].tolist() != list(range(1, len(group) + 1)) or len(block) != group["total"].max():
            raise WarcError(f"segments missing of {head['of']}")
        return pd.DataFrame([{c: block if c == "block" else head[c] for c in names}]).astype({"payload_length": "Int64"})

    return whole.unionByName(parts.groupBy("of").applyInPandas(join, whole.schema))


def pages(whole: DataFrame) -> DataFrame:
    """Per page of whole records its payload's length and digest, taken from decoded payloads (PAGES).

    A response whose payload disagrees with its declared digest or length raises.  A revisit has the length and
    digest of the response that it refers to, found by page and declared digest; without one it raises.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def number(name: str | None) -> int | None:
            page = name[len(NAME) :].partition(":")[0] if name else "null"
            return None if page == "null" else int(page)

        for batch in batches:
            rows = []
            for name, kind, digest, length, refers, block in zip(batch["record_id"], batch["kind"], batch["digest"], batch["payload_length"], batch["refers_to"], batch["block"]):
                if kind == "response":
                    payload = payload_of(bytes(block))
                    if sha1_base32(payload) != digest or len(payload) != length:
                        raise WarcError(f"digest or length of {name}")
                rows.append((number(name), int(length), digest, kind, number(refers)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PAGES.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    slim = scratch.table(whole.select("record_id", "kind", "digest", "payload_length", "refers_to", "block").mapInPandas(run, PAGES), "warc-pages")
    names = slim.columns
    responses, revisits = slim.filter("record_type = 'response'"), slim.filter("record_type = 'revisit'")
    of = responses.select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("bytes")).distinct()
    found = revisits.join(of, ["refers_to", "payload_digest"], "left")
    lost = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.col("refers_to").cast("string"))).cast("long")
    return responses.unionByName(found.withColumn("payload_bytes", F.coalesce("bytes", lost)).select(names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return pages(reassemble(read(archives, scratch.folder(spark))))
