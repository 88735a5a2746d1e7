"""WARC archives of pages and their capture index by external merge.

Writing.  One record per page; the text writer's line separator is the CRLF CRLF that ends a WARC
record, so the files are gzip WARC/1.1 archives (``Content-Length`` counts UTF-8 bytes).  Among
records with equal payloads of ``min_bytes`` or more, the one with the largest page_id is a
``response``; the others are ``revisit`` records that name it and carry no payload.  Smaller
payloads are all responses.

Reading.  Archives are read as one stream per file and cut by ``Content-Length``; the digest of
every response is checked against its payload.

Index.  Each file's captures are sorted locally by (URL key, time, page_id): a run.  Runs are cut at
range bounds; the pieces of a range are merged by a loser tree, giving captures in global order
(``range``, then ``seq`` from 0 inside it).  A hot URL is cut by time and page_id like any other
place of the order, and a range holds about RANGE_ROWS captures (more beyond three billion).

Rules.  A null html is an empty payload, a null url an empty one.  Rows that repeat a page_id and payload
are the same kind of record; null page_ids are written as such and are revisits only if their payload has a
response.  Extra columns are not archived.  An empty table gives empty archives and no rows.
"""

from __future__ import annotations

import hashlib
import re
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxima.llm.chunks import freeze, thaw
from proxima.llm.common import joined_if_small, written
from proxima.session import scratch_path

END = "\r\n\r\n"
RECORDS_PER_FILE = 20_000
RUN_ROWS = 50_000
RANGE_ROWS = 100_000
SAMPLES_PER_RANGE = 64           # bounds only balance the ranges; they change no result
MAX_SAMPLES = 1 << 17            # keys that reach the driver; with more captures the ranges grow
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)   # pages carry no time: page_id seconds after this

_FIELDS = ["url_key", "captured", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to",
           "archive", "offset"]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(),
          pa.string(), pa.int64()]
_SCHEMA = ("url_key string, captured bigint, page_id bigint, url string, payload_bytes bigint, payload_digest string, "
           "record_type string, refers_to bigint, archive string, offset bigint")


# ----------------------------------------------------------------- writing
def decided(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``page_id, url, payload, bytes, digest, refers_to`` (null for a response)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                     payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("bytes"),
                     F.sha1(payload.cast("binary")).alias("digest"))
    groups = written(p.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(
        F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 and response is not null")
        .select("digest", F.col("response")), "payload-groups")
    out = joined_if_small(p, groups, "digest", "left")
    same = F.col("page_id").eqNullSafe(F.col("response"))
    return out.select("page_id", "url", "payload", "bytes", "digest",
                      F.when((F.col("bytes") >= min_bytes) & ~same, F.col("response")).alias("refers_to"))


def write_archives(rows: DataFrame, path: str) -> str:
    """Archives of ``decided`` rows under ``path``; returns it.  A rerun never overwrites."""
    def header(name, value):
        return F.concat(F.lit(f"\r\n{name}: "), value)
    revisit = F.col("refers_to").isNotNull()
    seconds = F.coalesce(F.col("page_id"), F.lit(0)) + F.lit(int(EPOCH.timestamp()))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    body = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    safe_url = F.regexp_replace(F.col("url"), r"[\r\n]", " ")
    text = F.concat(
        F.lit("WARC/1.1"),
        header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        header("WARC-Date", F.date_format(F.timestamp_seconds(F.pmod(seconds, F.lit(253402300800))), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        header("WARC-Target-URI", safe_url),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                                 header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))))
        .otherwise(F.lit("")),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length(body).cast("string")),
        F.lit(END), body)
    (rows.select(text.alias("value")).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))
    return path


# ----------------------------------------------------------------- reading
def url_key(url: str) -> str:
    """Sort-friendly form of a URL: host labels reversed, then path and query; no scheme, fragment,
    user or www."""
    try:
        u = urlsplit(url.strip())
        host, port = u.hostname or "", u.port
    except ValueError:
        return url.strip().lower()
    host = re.sub(r"^www\d*\.", "", host)
    port = "" if port in (None, 80, 443) else f":{port}"
    return ",".join(reversed(host.split("."))) + port + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def _number(text: bytes) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", text)
    return int(m[1]) if m else None


class _Stream:
    """Records of one archive, from the pieces its text was read in."""

    def __init__(self, archive: str):
        self.archive, self.buffer, self.base = archive, bytearray(), 0

    def feed(self, piece: bytes):
        """Adds a piece and the separator after it; yields the captures that are complete."""
        self.buffer += piece + END.encode()
        end = END.encode()
        while True:
            # line ends between records: a payload's last ones can hide where the separator began
            gap = len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))
            del self.buffer[:gap]
            self.base += gap
            cut = self.buffer.find(end)
            if cut < 0:
                return
            head = bytes(self.buffer[:cut])
            if not head.startswith(b"WARC/"):
                raise ValueError(f"{self.archive}: no record at {self.base}")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            if b"Content-Length" not in fields:
                raise ValueError(f"{self.archive}: the record at {self.base} has no length")
            size = int(fields[b"Content-Length"])
            stop = cut + len(end) + size
            if len(self.buffer) < stop + len(end):
                return
            yield self.capture(fields, bytes(self.buffer[cut + len(end): stop]))
            del self.buffer[:stop]
            self.base += stop

    def capture(self, f: dict, block: bytes) -> tuple:
        kind = f[b"WARC-Type"].decode()
        digest = f[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
        payload = block.split(END.encode(), 1)[1]
        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{self.archive}: payload of the record at {self.base} does not match its digest")
        url = f[b"WARC-Target-URI"].decode()
        when = datetime.strptime(f[b"WARC-Date"].decode(), "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)
        return (url_key(url), int((when - EPOCH) / timedelta(seconds=1)), _number(f[b"WARC-Record-ID"]), url,
                int(f[b"X-Payload-Length"]), digest, kind, _number(f.get(b"WARC-Refers-To", b"")), self.archive, self.base)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under ``path``, file by file; gzip files are never split, so each
    is one stream."""
    lines = spark.read.option("lineSep", END).text(path).select("value", F.col("_metadata.file_path").alias("file"))

    def run(batches):
        stream, out = None, []
        for batch in batches:
            for piece, file in zip(batch.column(0), batch.column(1)):
                file = file.as_py()
                if stream is None or stream.archive != file:
                    _ended(stream)
                    stream = _Stream(file)
                out.extend(stream.feed(piece.as_buffer().to_pybytes()))
                if len(out) >= 1000:
                    yield _batch(out)
                    out = []
        _ended(stream)
        if out:
            yield _batch(out)
    return lines.mapInArrow(run, _SCHEMA)


def _ended(stream):
    if stream is not None and stream.buffer:
        raise ValueError(f"{stream.archive}: the record at {stream.base} is cut off")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_FIELDS)


# ----------------------------------------------------------------- external merge
def _order(row: tuple):
    """URL key, time, page_id (null last), then the place in the archives."""
    return (row[0], row[1], row[2] is None, row[2] or 0, row[8], row[9])


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so the next row costs one
    walk from a leaf to the root."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.rows = [next(r, None) for r in self.runs] + [None] * (self.size - len(runs))
        self.keys = [None if r is None else _order(r) for r in self.rows]
        self.tree = [-1] * self.size                    # losers; tree[0] is the winner
        winners = list(range(self.size))
        level = self.size
        while level > 1:
            level //= 2
            nxt = []
            for k in range(level):
                a, b = winners[2 * k], winners[2 * k + 1]
                w, loser = (a, b) if self._before(a, b) else (b, a)
                self.tree[level + k] = loser
                nxt.append(w)
            winners = nxt
        self.tree[0] = winners[0]

    def _before(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None
        return self.keys[a] <= self.keys[b]

    def __iter__(self):
        while True:
            w = self.tree[0]
            if self.keys[w] is None:
                return
            yield self.rows[w]
            row = next(self.runs[w], None)
            self.rows[w], self.keys[w] = row, None if row is None else _order(row)
            node = (self.size + w) // 2
            while node >= 1:
                if not self._before(w, self.tree[node]):
                    w, self.tree[node] = self.tree[node], w
                node //= 2
            self.tree[0] = w


def _runs(bounds: list[tuple]):
    """Sorts what a task has read into runs and cuts each at the range bounds."""
    from bisect import bisect_right

    def rows_of(run, number):
        run.sort(key=_order)
        out, start = [], 0
        marks = [bisect_right(bounds, _order(r)[:4]) for r in run]
        for i in range(1, len(run) + 1):
            if i == len(run) or marks[i] != marks[start]:
                out.append((marks[start], number, i - start, freeze(_batch(run[start:i]))))
                start = i
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["range", "run", "n", "blob"])

    def run(batches):
        from pyspark import TaskContext
        held, number = [], TaskContext.get().partitionId() << 32
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols):
                if held and (held[-1][8] != row[8] or len(held) >= RUN_ROWS):
                    yield rows_of(held, number)
                    held, number = [], number + 1
                held.append(row)
        if held:
            yield rows_of(held, number)
    return run


def _merge(key, tbl):
    runs = []
    for blob in tbl.sort_by("run").column("blob"):
        b = thaw(blob.as_buffer())
        runs.append(zip(*[c.to_pylist() for c in b.columns]))
    merged = list(LoserTree(runs))
    b = _batch(merged)
    return pa.table([pa.array([key[0].as_py()] * len(merged), pa.int32()), pa.array(range(len(merged)), pa.int64()), *b.columns],
                    names=["range", "seq", *_FIELDS])


def merged_index(captures: DataFrame) -> DataFrame:
    """Captures in global order: ``range, seq`` and the capture's fields."""
    captures = written(captures, "captures")
    n = captures.count()
    ranges = min(MAX_SAMPLES // 4, max(1, n // RANGE_ROWS))
    share = max(1, n // min(MAX_SAMPLES, ranges * SAMPLES_PER_RANGE))
    bounds = []
    if ranges > 1:
        keys = captures.where(F.pmod(F.xxhash64("archive", "offset"), F.lit(share)) == 0).select("url_key", "captured", "page_id")
        got = sorted(_order((r[0], r[1], r[2], *[None] * 7))[:4] for r in keys.collect())
        bounds = sorted({got[len(got) * k // ranges] for k in range(1, ranges)}) if got else []
    pieces = captures.mapInArrow(_runs(bounds), "range int, run bigint, n bigint, blob binary")
    return pieces.groupBy("range").applyInArrow(_merge, f"range int, seq bigint, {_SCHEMA}")


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes archives of ``pages`` under ``path`` (default: the shared scratch folder), reads them
    back and returns the merged capture index."""
    spark = pages.sparkSession
    path = write_archives(decided(pages), path or scratch_path(spark, "llm-warc"))
    return merged_index(read_archives(spark, path))


def capture_report(pages: DataFrame) -> DataFrame:
    """The contract's columns of the merged index."""
    return archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
