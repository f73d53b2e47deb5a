"""Pages as WARC archives: sorted, rolled by size, committed whole, read back.

Records are range-sorted by page_id. An archive holds a run of ids of one range,
and ranges are fixed numbers of ids, so the same pages give the same archives,
byte for byte, however many tasks write them. A page whose payload a page of a larger id
has too becomes a revisit of the largest such page. Each task writes to a
temporary name and renames a file once it is complete; the manifest, a table
of the job's own, lists what was committed, and readers go by it alone.

Nulls and edges: a null html is an empty payload; a null url is `urn:none`;
a page without page_id comes first and is never the page that others revisit:
where a payload has none but such pages, each is a response. Of repeated rows
with the response's id the first written is the response, the others revisit
it. An empty table writes no archive. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import Committed, open_input, shared_folder, small_batches

# An archive is closed once it has this many compressed bytes.
ROLL_BYTES = 64 << 20
# Ids that may share an archive: ranges follow from the ids alone.
RANGE_IDS = 4096
# Payloads from this size on become revisits.
REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: that of URLs
SOFTWARE = b"software: roadpulse\r\nformat: WARC File Format 1.1\r\n"


def digest(payload: bytes) -> str:
    """SHA-1 in base32, as archives carry it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{payload_digest}/{copy}')}>"


def _record(kind: str, id_: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", id_), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: int = 0) -> bytes:
    """A response, or a revisit of the page `refers_to`."""
    mark = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    headers = [
        ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "urn:none"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{mark}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, mark)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page", str(refers_to))]
    return _record("revisit" if revisit else "response", record_id(page_id, mark, copy), headers, block)


def read_records(stream, chunk: int = 1 << 20):
    """(headers, block) of each gzip member of an archive, one at a time."""
    data, member, out = b"", zlib.decompressobj(31), []
    while True:
        if not data and not (data := stream.read(chunk)):
            break
        out.append(member.decompress(data))
        data = member.unused_data
        if member.eof:
            head, _, rest = b"".join(out).partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
            yield headers, rest[: int(headers["Content-Length"])]
            member, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the archive ends within a record")


def with_responses(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """All pages, and beside them a row without html for each page_id and
    payload that stands more than once: its digest and the largest page_id that
    has it. Sorted by page_id they meet, so no payload goes through a join."""
    html = F.coalesce("html", F.lit(""))
    marks = pages.filter(F.octet_length(html) >= revisit_bytes).select("page_id", F.sha1(html.cast("binary")).alias("mark"))
    largest = marks.groupBy("mark").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1").drop("n")
    told = marks.join(largest, "mark").select("page_id", "mark", "response").distinct()
    return pages.select("page_id", "url", html.alias("html")).unionByName(told, allowMissingColumns=True)


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, range_ids: int = RANGE_IDS) -> DataFrame:
    """Write all pages; the manifest, one row per archive, is a table."""

    def run(batches):
        part, seq, file, size, n = None, 0, None, 0, 0
        last, seen, responses = None, {}, {}

        def close():
            return pd.DataFrame({"part": [part], "seq": [seq], "file": [file.commit().rpartition("/")[2]], "bytes": [size], "n": [n]})

        for pdf in batches:
            columns = (pdf["part"], pdf["page_id"], pdf["url"], pdf["html"], pdf["mark"], pdf["response"])
            for here, page_id, url, html, told, response in zip(*columns, strict=True):
                if here != part:
                    if file is not None:
                        yield close()
                    part, seq, file, n = here, 0, None, 0
                page_id = None if page_id is None else int(page_id)
                if page_id != last:
                    last, seen, responses = page_id, {}, {}
                if html is None:
                    responses[told] = None if response is None else int(response)
                    continue
                payload = html.encode()
                mark = hashlib.sha1(payload).hexdigest()
                copy = seen[mark] = seen.get(mark, -1) + 1
                response = responses.get(mark)
                refers = None if response is None or (response == page_id and not copy) else response
                data = page_record(page_id, url, payload, refers, copy)
                if file is None:
                    name = f"pages-{part}-{seq:06d}.warc.gz"
                    file = Committed(folder, name)
                    info = _record("warcinfo", record_id(None, name), [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], SOFTWARE)
                    file.write(info)
                    size = len(info)
                file.write(data)
                size, n = size + len(data), n + 1
                if size >= roll_bytes:
                    yield close()
                    file, seq, n = None, seq + 1, 0
        if file is not None:
            yield close()

    small_batches(pages.sparkSession)
    # An archive holds pages of one range of ids, whatever task writes it: a range
    # goes to one task, or two would write archives of one name. Rows without html
    # come before the pages of their id. Ids travel as text: next to nulls pandas
    # would make them doubles.
    number = F.floor(F.col("page_id") / range_ids) + F.lit(1 << 51)
    part = F.coalesce(F.format_string("%016d", number), F.lit("-"))
    rows = with_responses(pages).withColumn("part", part)
    ordered = rows.repartitionByRange("part").sortWithinPartitions("part", "page_id", F.col("html").isNotNull(), "url", "html")
    ordered = ordered.withColumns({c: F.col(c).cast("string") for c in ("page_id", "response")})
    return cut_lineage(ordered.mapInPandas(run, "part string, seq long, file string, bytes long, n long"))


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per page record of the archives that the manifest names."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns, dtype=object).astype({"page_id": "Int64", "refers_to": "Int64"})

    def run(batches):
        for pdf in batches:
            for file in pdf["file"]:
                rows = []
                with open_input(folder, file) as stream:
                    for headers, block in read_records(stream):
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        if headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
                            raise ValueError(f"{file}: a block does not match its digest")
                        size, mark = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            size, mark = len(payload), digest(payload)
                        page, to = headers["X-Page-Id"], headers.get("X-Refers-To-Page")
                        rows.append((int(page) if page else None, size, mark, kind, int(to) if to else None))
                        if len(rows) == 5000:
                            yield frame(rows)
                            rows = []
                yield frame(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.select("file").repartition(tasks, "file").mapInPandas(run, schema)


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages to the shared folder and read the archives back."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    return read_archives(spark, folder, write_archives(pages, folder))
