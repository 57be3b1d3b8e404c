"""WARC writing and reading, and capture histories by external index merge.

Pages are written as WARC/1.1 records, one gzip member each, in archives of
bounded size.  Archives are rows of a table in the shared folder (archive_id,
warc), whose bytes are those of a .warc.gz file: so they live in any store
Spark writes to and survive lost executors.  export_archives() writes them out
as files.

Of records with equal payloads of at least LEAST_REVISIT bytes, the one with
the smallest page_id is the response, the others are revisits without a body
that refer to it.

Each archive is one capture run.  Its index entries are sorted locally by URL
key, timestamp and page_id and cut at splitters; each key range then merges its
slices of all runs with a loser tree, k ways, into globally ordered capture
histories.  Ranges hold RANGE entries on average; a hot URL is split among
ranges, for timestamp, page_id and place in the archives are part of the key.

Null html is an empty payload; null urls count as empty; a null page_id is kept,
is never referred to, and revisits the response of its copies where they have
one; rows that repeat the response's page_id are responses too.  Pages have no
capture time, so it is taken from the page_id.  Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Tables, documents

LEAST_REVISIT, ARCHIVE_BYTES, RANGE, PER_RANGE = 100, 4 << 20, 20_000, 10
_EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
_END = b"\r\n\r\n"


def url_key(url: str | None) -> str:
    """SURT-like key: host labels reversed, without www and port, then path and query in lower case; fragments go."""
    parts = urlsplit((url or "").strip().lower()) if "[" not in (url or "") and "]" not in (url or "") else urlsplit("")
    host = (parts.netloc.rpartition("@")[2]).partition(":")[0]
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "") if host else (url or "").strip().lower()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, stamp: str) -> bytes:
    """A WARC record as a gzip member."""
    header = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {stamp}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or ""),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        header += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    body = b"" if revisit else payload
    header += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(header).encode() + _END + body + _END, 1, mtime=0)


def members(data: bytes):
    """(offset, content) of the gzip members of data; each is fed in small pieces, so that the work is linear."""
    at, view = 0, memoryview(data)
    while at < len(data):
        inflate, out, to, step = zlib.decompressobj(31), [], at, 1 << 12
        while not inflate.eof:
            if to >= len(data):
                raise ValueError(f"cut-off record at offset {at}")
            out.append(inflate.decompress(view[to : to + step]))
            to, step = min(len(data), to + step), min(step * 2, 1 << 20)
        yield at, b"".join(out)
        at = to - len(inflate.unused_data)


def parse(warc: bytes) -> list[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, body) of the records of an archive."""
    out = []
    for at, raw in members(warc):
        head, _, rest = raw.partition(_END)
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at offset {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        out.append((at, fields, rest[: int(fields["content-length"])]))
    return out


class LoserTree:
    """K-way merge of sorted lists: each step replays one path of losers, log k comparisons."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _head(self, i: int):
        return self.runs[i][self.at[i]] if self.at[i] < len(self.runs[i]) else None

    def _beats(self, i: int, j: int) -> bool:
        a, b = self._head(i), self._head(j)
        return b is None or (a is not None and (a, i) < (b, j))

    def _play(self, i: int) -> None:
        at = (i + self.k) // 2
        while at > 0:
            if self.tree[at] < 0:
                self.tree[at] = i
                return
            if self._beats(self.tree[at], i):
                self.tree[at], i = i, self.tree[at]
            at //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.k and (top := self._head(i := self.tree[0])) is not None:
            yield top
            self.at[i] += 1
            self._play(i)


def classify(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, first (the response's id of a group of copies; null outside such groups)."""
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    firsts = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    return rows.join(firsts, "payload_digest", "left")


def _write(batches):
    """Archives of the task's rows."""
    from pyspark import TaskContext

    part, made, members, size = TaskContext.get().partitionId(), 0, [], 0
    names = ("page_id", "url", "payload", "payload_digest", "first")

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) | made], pa.int64()), pa.array([len(members)], pa.int32()), pa.array([b"".join(members)], pa.binary())], ["archive_id", "n_records", "warc"])

    for batch in batches:
        for page_id, url, payload, digest, first in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            revisit = first is not None and page_id != first
            stamp = (_EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
            members.append(record(page_id, url, payload, digest, first if revisit else None, revisit, stamp))
            size += len(members[-1])
            if size >= ARCHIVE_BYTES:
                yield flush()
                made, members, size = made + 1, [], 0
    if members:
        yield flush()


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive_id, n_records, warc): the archives of classify()'s pages."""
    return classify(pages).mapInArrow(_write, "archive_id long, n_records int, warc binary")


def export_archives(archives: DataFrame, folder: str) -> None:
    """Writes each archive as <folder>/<archive_id>.warc.gz; folder is a path that all executors mount.  Repeats of a task replace whole files."""
    import os

    def run(batches):
        for batch in batches:
            for ident, warc in zip(batch.column("archive_id").to_pylist(), batch.column("warc"), strict=True):
                path = f"{folder}/{ident:016x}.warc.gz"
                with open(part := f"{path}.{os.getpid()}.part", "wb") as out:
                    out.write(warc.as_buffer())
                os.replace(part, path)
            yield pa.RecordBatch.from_arrays([batch.column("archive_id")], ["archive_id"])

    archives.mapInArrow(run, "archive_id long").write.format("noop").mode("overwrite").save()


CAPTURE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, archive_id long, offset long"
_NAMES = [x.split()[0] for x in CAPTURE.split(", ")]


def captures(ident: int, warc: bytes) -> list[tuple]:
    """Index entries of an archive, in order of URL key, timestamp and page_id.  Payloads are held against their digests."""
    out = []
    for offset, h, body in parse(warc):
        number = lambda v: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", v or "")) else None
        digest = h["warc-payload-digest"].removeprefix("sha256:")
        if h["warc-type"] == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(h["x-payload-length"])):
            raise ValueError(f"damaged payload in archive {ident} at {offset}")
        out.append((number(h["warc-record-id"]), int(h["x-payload-length"]), digest, h["warc-type"], number(h.get("warc-refers-to")), url_key(h["warc-target-uri"]), h["warc-date"], ident, offset))
    return sorted(out, key=merge_key)


def merge_key(entry: tuple) -> tuple:
    return entry[5], entry[6], -1 if entry[0] is None else entry[0], entry[7], entry[8]


def _index(batches):
    for batch in batches:
        for ident, warc in zip(batch.column("archive_id").to_pylist(), batch.column("warc"), strict=True):
            entries = captures(ident, warc.as_py())
            yield _batch(entries, ("rank", pa.array(range(len(entries)), pa.int64())))


def _batch(entries: list[tuple], *more: tuple[str, pa.Array]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([*(pa.array([e[i] for e in entries], kinds[x.split()[1]]) for i, x in enumerate(CAPTURE.split(", "))), *(x for _, x in more)], [*_NAMES, *(x for x, _ in more)])


def _entries(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True))


def _cut(splitters):
    """Slices of the runs: each entry's range."""
    from bisect import bisect_right

    def run(batches):
        cuts = splitters.value
        for batch in batches:
            where = [bisect_right(cuts, merge_key(e)) for e in _entries(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where, pa.int32())], [*batch.schema.names, "range"])

    return run


def _merge(batches):
    """Merges the runs of each range.  Rows come by range, run and rank in the run."""
    at, runs = None, {}
    for batch in batches:
        for where, entry in zip(batch.column("range").to_pylist(), _entries(batch), strict=True):
            if where != at:
                yield from _merged(at, runs)
                at, runs = where, {}
            runs.setdefault(entry[7], []).append(entry)
    yield from _merged(at, runs)


def _merged(where, runs):
    lists = [[(merge_key(e), e) for e in rows] for _, rows in sorted(runs.items())]
    out = [e for _, e in LoserTree(lists)]
    for a in range(0, len(out), 10_000):
        part = out[a : a + 10_000]
        yield _batch(part, ("range", pa.array([where] * len(part), pa.int32())), ("place", pa.array(range(a, a + len(part)), pa.int64())))


def capture_histories(archives: DataFrame, range_entries: int = RANGE) -> DataFrame:
    """Captures of all archives in global order: CAPTURE's columns with range and place; (range, place) orders them."""
    spark = archives.sparkSession
    tables = Tables(spark, "capture-index")
    runs = tables.keep(archives.mapInArrow(_index, f"{CAPTURE}, rank long"), "runs")
    n = runs.count()
    ranges = max(1, -(-n // range_entries))
    cuts: list[tuple] = []
    if ranges > 1:  # about PER_RANGE keys a range, by hash; they only balance the ranges
        some = runs.where(F.pmod(F.xxhash64("archive_id", "offset"), F.lit(max(1, n // (ranges * PER_RANGE)))) == 0)
        keys = sorted(tuple(r) for r in some.select("url_key", "captured", F.coalesce("page_id", F.lit(-1)), "archive_id", "offset").collect())
        cuts = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if len(keys) >= ranges else keys
    cut = runs.mapInArrow(_cut(spark.sparkContext.broadcast(cuts)), f"{CAPTURE}, rank long, range int")
    return cut.repartition("range").sortWithinPartitions("range", "archive_id", "rank").mapInArrow(_merge, f"{CAPTURE}, range int, place long")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = Tables(spark, "warc").keep(write_archives(documents(spark, sf_dir, "pages")), "archives")
    return capture_histories(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages)
, f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""
