"""WARC archives, index first.

Tasks write archives of one gzip member a record and return, per record, the archive, offset,
length, URL and digest. Readers select from that index, sort the selected byte ranges of an archive, and
read neighbours in one go; records are never searched for. Equal payloads of at least MIN_REVISIT
bytes are stored once: the least page is a response, the others are revisits that name it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import shared_files
from tallyspark.llm.arrow import batches
from tallyspark.plans.staging import new_path, settle

MIN_REVISIT = 100
#: Ranges closer than GAP are read together, up to READ bytes; a reading task takes SPLIT bytes of an archive.
GAP, READ, SPLIT = 64 << 10, 4 << 20, 32 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: HTTP header and payload, or the header alone in a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _line(url: str | None) -> str:
    """A URL on one line; what cannot stand in a header is escaped."""
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers by lower-cased name, the payload's length as it was fetched, and the payload there is."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    headers = {k.lower(): v for k, v in headers.items()}
    http, _, payload = rest[:int(headers["content-length"])].partition(b"\r\n\r\n")
    fetched = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers, fetched, payload


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), digest, and refers_to for rows that revisit another page. The
    join is on the digest of payloads that occur on several pages; a frequent one is a skewed key of
    the larger side, which adaptive execution splits."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    shared = rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    shared = shared.where("n > 1 AND least IS NOT NULL").select("digest", "least")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("least"))
    return rows.join(shared, "digest", "left").select("page_id", "url", "html", "digest", F.when(other, F.col("least")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) and returns the settled index: file,
    offset, length, url, digest, page_id, record_type. Rows of the least page id of equal payloads
    are responses, all of them if the id repeats; a null id counts as the largest."""
    folder = shared_files.folder(pages.sparkSession, folder or new_path(pages.sparkSession, "warc"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            uri = shared_files.fresh(folder, "warc.gz")
            out, offset = None, 0
            for batch in parts:
                for page, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                    out = out or shared_files.writer(uri)
                    zipped = zlib.compress(record(page, url, html.encode(), digest, refers), LEVEL, 31)
                    out.write(zipped)
                    yield uri, offset, len(zipped), url, digest, page, "response" if refers is None else "revisit"
                    offset += len(zipped)
            if out is not None:
                out.close()

        yield from batches(rows(), pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()),
                                              ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())]))

    return settle(with_revisits(pages).mapInArrow(run, "file string, offset long, length long, url string, digest string, page_id long, record_type string"), "warc-index")


def ranges(spots: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) spots as reads: from, to, and the spots inside."""
    held: list[tuple[int, int]] = []
    for offset, length in spots:
        if held and (offset - sum(held[-1]) > GAP or offset + length - held[0][0] > READ):
            yield held[0][0], sum(held[-1]), held
            held = []
        held.append((offset, length))
    if held:
        yield held[0][0], sum(held[-1]), held


def read(selected: DataFrame) -> DataFrame:
    """The records of index rows (file, offset, length): page_id, url, record_type, refers_to,
    payload_bytes, payload_digest (both of the payload as fetched) and payload (null in a revisit).
    A response whose payload does not have its digest is an error."""
    jobs = selected.select("file", "offset", "length", F.floor(F.col("offset") / SPLIT).alias("_part"))
    splits = max(1, jobs.select("file", "_part").distinct().count())  # index rows are small, what they stand for is not
    jobs = jobs.repartition(splits, "file", "_part").sortWithinPartitions("file", "offset")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def rows():
            for batch in parts:
                spots = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
                at = 0
                while at < len(spots):
                    name, stop = spots[at][0], at
                    while stop < len(spots) and spots[stop][0] == name:
                        stop += 1
                    with shared_files.reader(name) as file:
                        for first, last, inside in ranges([s[1:] for s in spots[at:stop]]):
                            data = file.read_at(last - first, first)
                            for offset, length in inside:
                                headers, fetched, payload = parse(zlib.decompress(data[offset - first:offset - first + length], 31))
                                revisit = headers["warc-type"] == "revisit"
                                digest = headers["warc-payload-digest"].removeprefix("sha256:")
                                if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                                    raise ValueError(f"damaged record at {offset} of {name}")
                                page, refers = (headers.get(k, "<urn:page:>")[len("<urn:page:"):-1] for k in ("warc-record-id", "warc-refers-to"))
                                yield (int(page) if page else None, headers["warc-target-uri"], headers["warc-type"], int(refers) if refers else None,
                                       fetched, digest, None if revisit else payload)
                    at = stop

        yield from batches(rows(), pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                                              ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]))

    return jobs.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")
