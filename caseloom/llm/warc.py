"""WARC archives with revisits, and their index merged from sorted runs."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.tables import keep, numbered
from caseloom.session import scratch_path

#: Records per archive file at most.
RECORDS = 20_000
# Fixed values of the format.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PAGE = "urn:x-page:"

SCHEME = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://")
HOST = re.compile(r"^[^/?]*")
PORT = re.compile(r":(?:80|443)$")
WWW = re.compile(r"^www[0-9]*\.")


def url_key(url: str) -> str:
    """The URL in sort-friendly form: host labels from the last to the first, then the path.

    Scheme, ``www``, standard ports and the fragment do not count, nor does case.
    """
    rest = SCHEME.sub("", url).split("#", 1)[0]
    host = HOST.match(rest).group()
    tail = rest[len(host) :].lower() or "/"
    host = WWW.sub("", PORT.sub("", host.lower()))
    return ",".join(reversed(host.split("."))) + ")" + tail


def base32(hex_digits: str) -> Column:
    """Bare upper-case base32 of a column of 40 hex digits: four letters for five digits."""
    number = f"cast(conv(substring({hex_digits}, 1 + 5 * (i div 4), 5), 16, 10) AS int)"
    letter = f"substring('{BASE32}', 1 + (shiftright({number}, 15 - 5 * cast(i % 4 AS int)) & 31), 1)"
    return F.expr(f"array_join(transform(sequence(0, 31), i -> {letter}), '')")


def _header(name: str, value: Column) -> Column:
    """A header line, left out if the value is null; line breaks in values are percent-encoded."""
    value = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")


def _page(number: str) -> Column:
    return F.concat(F.lit(f"<{PAGE}"), F.coalesce(F.col(number).cast("string"), F.lit("")), F.lit(">"))


def write(pages: DataFrame, path: str) -> None:
    """Writes a record for every row of ``pages`` (page_id, url, html, stamp) to archives below ``path``.

    The payload is the html in UTF-8 (null: empty). Of equal payloads, the record of the largest
    page_id is a response; the others are revisits that name it and hold its headers only.
    A record ends with two line breaks, which are the line separator of Spark's text writer, so
    every task streams its records into an archive (gzip) wherever Spark can write.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce("html", F.lit("")).alias("html"),
        "stamp",
    ).withColumn("_sha1", F.sha1(F.col("html").cast("binary")))
    latest = rows.groupBy("_sha1").agg(F.max("page_id").alias("_latest"))
    latest = keep(latest.withColumn("_digest", base32("_sha1")), "warc-latest")
    joined = rows.join(latest, "_sha1")
    revisit = F.coalesce(F.col("page_id") != F.col("_latest"), F.col("_latest").isNotNull())
    length = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit(END))
    payload = F.when(revisit, "").otherwise(F.col("html"))
    size = F.octet_length(http) + F.octet_length(payload)
    record = F.concat(
        F.lit("WARC/1.0\r\n"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", _page("page_id")),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Date", F.col("stamp")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "_digest")),
        _header("WARC-Refers-To", F.when(revisit, _page("_latest"))),
        _header("WARC-Profile", F.when(revisit, PROFILE)),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", size.cast("string")),
        F.lit("\r\n"),
        http,
        payload,
    )
    options = {"lineSep": END, "compression": "gzip", "maxRecordsPerFile": RECORDS}
    joined.select(record.alias("value")).write.options(**options).text(path)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an open archive."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.0":
            raise ValueError(f"no record where one should begin: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b": ")
            headers[name.decode()] = value.decode()
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(len(END)) != END.encode():
            raise ValueError("record without its end")
        yield headers, block


def _number(page: str) -> int | None:
    digits = page.removeprefix(f"<{PAGE}").removesuffix(">")
    return int(digits) if digits else None


def entries(content: bytes) -> list[tuple]:
    """The index of an archive, sorted: (url key, stamp, page, type, digest, payload bytes, refers to).

    Responses are checked against their digest.
    """
    found = []
    for headers, block in records(gzip.GzipFile(fileobj=io.BytesIO(content))):
        head, _, payload = block.partition(END.encode())
        length = int(head.rpartition(b"Content-Length: ")[2])
        named = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = headers["WARC-Type"]
        if kind == "response" and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (length, named):
            raise ValueError(f"payload of {headers['WARC-Record-ID']} is not what its headers say")
        refers = _number(headers["WARC-Refers-To"]) if kind == "revisit" else None
        key = url_key(headers["WARC-Target-URI"]) if "WARC-Target-URI" in headers else ""
        found.append((key, headers.get("WARC-Date", ""), _number(headers["WARC-Record-ID"]), kind, named, length, refers))
    return sorted(found, key=order)


def order(entry: Sequence) -> tuple:
    """Where an index entry sorts: by URL key, time and page, missing pages first."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the winner goes up.

    Taking the smallest entry replays the matches on the path from its run's leaf to the root.
    """

    def __init__(self, runs: Iterable[Sequence]):
        self.runs = [iter(run) for run in runs]
        self.size = max(1, len(self.runs))
        self.heads = [self._next(run) for run in range(len(self.runs))] or [None]
        self.losers = [-1] * self.size
        for run in range(self.size):
            self._play(run)

    def _next(self, run):
        entry = next(self.runs[run], None)
        return None if entry is None else (order(entry), run, entry)

    def _beats(self, one: int, two: int) -> bool:
        a, b = self.heads[one], self.heads[two]
        return a is not None and (b is None or a[:2] < b[:2])

    def _play(self, run: int) -> None:
        node = (run + self.size) // 2
        while node:
            if self.losers[node] < 0:  # the first to arrive waits for its opponent
                self.losers[node] = run
                return
            if self._beats(self.losers[node], run):
                self.losers[node], run = run, self.losers[node]
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[Sequence]:
        while (head := self.heads[self.losers[0]]) is not None:
            run = self.losers[0]
            yield head[2]
            self.heads[run] = self._next(run)
            self._play(run)


FIELDS = [
    ("url_key", pa.string()), ("stamp", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()),
]
ENTRY = "url_key string, stamp string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long"


def _columns(rows: list[tuple], fields) -> list[pa.Array]:
    columns = zip(*rows) if rows else [()] * len(fields)
    return [pa.array(list(column), kind) for column, (_, kind) in zip(columns, fields)]


def index(path: str, spark) -> DataFrame:
    """The index of all archives below ``path`` in one global order, with each entry's position ``capture_no``.

    Each archive gives a sorted run. Ranges of the keys are dealt to tasks; a URL with very many
    captures is cut by time. A task has a stretch of every run and merges them by a loser tree.
    """
    run_fields = [("run", pa.string()), ("at", pa.int64()), *FIELDS]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                run = name.as_py()
                rows = [(run, at, *entry) for at, entry in enumerate(entries(content.as_py()))]
                yield pa.RecordBatch.from_arrays(_columns(rows, run_fields), names=[name for name, _ in run_fields])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for run, at, *entry in zip(*(column.to_pylist() for column in batch.columns)):
                runs.setdefault(run, []).append((at, tuple(entry)))
        part, row = TaskContext.get().partitionId(), 0
        tree = iter(LoserTree([entry for _, entry in sorted(of, key=lambda x: x[0])] for of in runs.values()))
        while rows := [entry for _, entry in zip(range(10_000), tree)]:
            place = pa.array([{"part": part, "row": row + n} for n in range(len(rows))], place_kind)
            row += len(rows)
            yield pa.RecordBatch.from_arrays([*_columns(rows, FIELDS), place], names=[*(n for n, _ in FIELDS), "_place"])

    place_kind = pa.struct([("part", pa.int64()), ("row", pa.int64())])
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    runs = keep(archives.mapInArrow(read, f"run string, at long, {ENTRY}"), "warc-runs")
    # Ascending order puts nulls first, as the merge does.
    ranges = runs.repartitionByRange("url_key", "stamp", "page_id", "at", "run")
    merged = keep(ranges.mapInArrow(merge, f"{ENTRY}, _place struct<part: bigint, row: bigint>"), "warc-merged")
    return numbered(merged, "capture_no")


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html, stamp) as WARC archives and returns the merged index
    that reading them back gives: the columns of ``ENTRY`` and ``capture_no``.

    ``path`` is a folder to create, by default a scratch folder. ``stamp`` is the time of capture
    as text that sorts by time.

    Nulls: a null url has no target and sorts first; a null html is an empty payload; a null
    page_id is kept, refers to a page with the same payload if there is one, and is otherwise a
    response. Rows with the same page_id and payload are all responses, or all revisits. Captures
    that tie in url key, time and page come in any order. An empty table gives no rows. Other
    columns are ignored.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    write(pages, path)
    return index(path, pages.sparkSession)
