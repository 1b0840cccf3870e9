"""WARC archives of pages, and their merged capture index."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from urllib.parse import unquote_plus, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadsift.llm.common import shared_dir, written

CRLF = "\r\n"
#: Records of an archive file, at most.
ARCHIVE_RECORDS = 1000
#: Index entries of one task of the merge, about, and of a run that it has unpacked at a time.
MERGE_ENTRIES, MERGE_ROWS = 200_000, 1_024
#: Capture time of pages that have none: this moment and page_id seconds.
EPOCH = 1_577_836_800
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
INDEX = (
    "url_key string, captured_at string, page_id string, payload_bytes long, payload_digest string, record_type string,"
    " refers_to string, url string, archive string, place long, intact boolean"
)


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: each 5 hexadecimal digits are 4 digits of base 32."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def write_archives(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> str:
    """Write a WARC record for each page to the shared folder; returns the folder.

    Of equal payloads of at least `least_bytes` bytes the one with the largest key becomes a
    response and the others revisits that refer to it; null keys are smaller than any, and rows
    that repeat the largest key are responses too. A record is a row of a text file whose line end
    is the two line ends that close a WARC record, so Spark's own writer makes valid archives, of
    any file system. Null html is an empty payload. Control characters and spaces of a URL are
    percent-encoded; keys of any text are, as a whole.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(key).alias("_key"), F.coalesce(F.col(url), F.lit("")).alias("_url"), payload.alias("_html"),
        F.octet_length(payload).cast("long").alias("_bytes"), base32_sha1(F.encode(payload, "UTF-8")).alias("_digest"),
    )
    several = rows.groupBy("_digest", "_bytes").agg(F.count("*").alias("n"), F.max("_key").alias("_first"))
    copies = written(several.where((F.col("n") > 1) & (F.col("_bytes") >= least_bytes)).drop("n", "_bytes"), "warc-copies")
    known = rows.join(copies, "_digest", "left")
    revisit = F.col("_first").isNotNull() & (F.col("_key").isNull() | (F.col("_key") < F.col("_first")))
    encoded = reduce(lambda c, x: F.replace(c, F.lit(chr(x)), F.lit(f"%{x:02X}")), (*range(0x21), 0x7F), F.col("_url"))
    safe_url = F.when(F.col("_url").rlike(r"[\x00-\x20\x7F]"), encoded).otherwise(F.col("_url"))
    when = F.date_format(F.timestamp_seconds(EPOCH + F.coalesce(F.col("_key").try_cast("long"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), "_bytes", F.lit(CRLF * 2))
    body = F.when(revisit, F.lit("")).otherwise(F.col("_html"))

    def urn(of: str) -> Column:
        return F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(F.col(of).cast("string")), F.lit(">")), F.lit("<urn:page>"))

    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), urn("_key")),
        F.concat(F.lit("WARC-Date: "), when),
        F.concat(F.lit("WARC-Target-URI: "), safe_url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "_digest"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn("_first"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(http) + F.octet_length(body)),
    ]
    record = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), http, body)
    folder = f"{shared_dir(pages.sparkSession)}/archives-{uuid.uuid4().hex}"
    known.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", ARCHIVE_RECORDS).text(folder)
    return folder


def url_key(url: str) -> str:
    """Sort-friendly form: host labels from the right, then path and query, in lower case.

    Spaces and control characters count as themselves, percent-encoded or not.
    """
    plain = re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02x}", url.lower())
    try:
        parts = urlsplit(plain)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    path = re.sub(r"%([01][0-9a-f]|20|7f)", lambda m: chr(int(m[1], 16)), path)
    return ",".join(reversed(host.split("."))) + ")" + path


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, headers, block) of each record, by its Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode().split(CRLF)
        headers = dict(line.split(": ", 1) for line in head[1:] if ": " in line)
        start = end + 4
        size = int(headers["Content-Length"])
        yield at, headers, data[start : start + size]
        at = start + size + 4


def _urn(value: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(.*)>", value or "")
    return unquote_plus(found[1]) if found else None


def _entry(archive: str, place: int, headers: dict[str, str], block: bytes) -> tuple:
    """Index entry of a record. Length and digest of a response are measured on its payload."""
    url, stated = headers.get("WARC-Target-URI", ""), headers["WARC-Payload-Digest"].removeprefix("sha1:")
    http, _, payload = block.partition(b"\r\n\r\n")
    length, digest, intact = len(payload), stated, None
    if headers["WARC-Type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        said = next((x.split(":")[1].strip() for x in http.decode(errors="replace").split(CRLF) if x.startswith("Content-Length")), "")
        intact = digest == stated and said == str(length)
    return (
        url_key(url), headers["WARC-Date"], _urn(headers["WARC-Record-ID"]), length, digest,
        headers["WARC-Type"], _urn(headers.get("WARC-Refers-To")), url, archive, place, intact,
    )


def capture_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One run for each archive: its index entries, sorted by URL key and time."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                entries = sorted((_entry(path.rpartition("/")[2], *r) for r in records(data.as_py())), key=_order)
                if entries:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries, strict=True), TYPES, strict=True)], names=NAMES)

    return files.mapInArrow(run, INDEX)


NAMES = [c.split()[0] for c in INDEX.split(",")]
TYPES = [{"long": pa.int64(), "boolean": pa.bool_()}.get(c.split()[1], pa.string()) for c in INDEX.split(",")]


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[8], entry[9]


class LoserTree:
    """Merge of k sorted runs: inner nodes keep the losers, one path is replayed for each entry."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.keys = [h and _order(h) for h in self.heads]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:  # first visit: wait for the other half
                self.losers[node] = winner
                return
            if self._less(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[winner := self.losers[0]] is not None:
            yield self.heads[winner]
            head = self.heads[winner] = next(self.runs[winner], None)
            self.keys[winner] = head and _order(head)
            self._play(winner)


def with_measured(runs: DataFrame) -> DataFrame:
    """Revisits take length and digest from the response they refer to, as measured there.

    A revisit is intact if its own digest is that of its response; one whose response is missing
    has no length and is not.
    """
    responses = runs.where("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("_of")).agg(
        F.max(F.struct("payload_bytes", "payload_digest", "intact")).alias("_m")
    )
    revisits = runs.where("record_type = 'revisit'").join(responses, F.col("refers_to") == F.col("_of"), "left")
    same = F.coalesce(F.col("_m.intact") & (F.col("payload_digest") == F.col("_m.payload_digest")), F.lit(False))
    made = {"payload_bytes": F.col("_m.payload_bytes"), "payload_digest": F.coalesce("_m.payload_digest", "payload_digest"), "intact": same}
    return runs.where("record_type <> 'revisit'").unionByName(revisits.select(*[made.get(c, F.col(c)).alias(c) for c in NAMES]))


def capture_histories(runs: DataFrame) -> DataFrame:
    """All entries in order of URL key and capture time, across partitions.

    Range partitions of (key, time, archive) cut even one URL's history; there are as many as keep
    each near `MERGE_ENTRIES` entries. Each holds a piece of every run, which a loser tree merges;
    pieces stay packed in Arrow batches and are unpacked some rows at a time.
    """

    def unpacked(batches: list[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, len(batch), MERGE_ROWS):
                yield from zip(*[c.to_pylist() for c in batch.slice(at, MERGE_ROWS).columns], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            archives = batch.column(8).to_pylist()
            edges = [0, *(i for i in range(1, len(archives)) if archives[i] != archives[i - 1]), len(archives)]
            for low, high in zip(edges, edges[1:]):
                if high > low:
                    pieces.setdefault(archives[low], []).append(batch.slice(low, high - low))
        merged = iter(LoserTree([unpacked(p) for p in pieces.values()]))
        while part := list(islice(merged, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), TYPES, strict=True)], names=NAMES)

    order = ["url_key", "captured_at", "archive", "place"]
    held = written(runs, "warc-index")
    default = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = held.repartitionByRange(max(default, -(-held.count() // MERGE_ENTRIES)), *order)
    return ranged.sortWithinPartitions("archive", "url_key", "captured_at", "place").mapInArrow(run, INDEX)


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write archives of `pages`, read them back, and return the merged capture index.

    One row for each page, repeated rows included: see `write_archives` for equal payloads and
    nulls. Lengths and digests are measured on the payloads read; `intact` says whether they are
    what the headers state. An empty table gives an empty index. Keys come back in their own type;
    a page without a key is captured at the start of the time scale. A very long page is one record
    and with its archive of at most `ARCHIVE_RECORDS` records held in memory by one task.
    """
    folder = write_archives(pages, least_bytes, key, url, html)
    kind = pages.schema[key].dataType
    index = capture_histories(with_measured(capture_runs(pages.sparkSession, folder)))
    return index.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
