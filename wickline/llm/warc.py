"""WARC archives of pages, and a globally ordered capture index of them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wickline.llm.scratch import fresh_path, written

# Fixed values of the format.
BREAK = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + BREAK
URN = "urn:page:"

MIN_REVISIT = 1000
CLOCK = 100_000_000_000  # seconds, some 3,000 years
RANGE_ROWS = 200_000

_INDEX = (
    "url_key string, captured string, page_id long, url string, record_type string, refers_to long, "
    "payload_digest string, payload_bytes long, file string, offset long"
)
_FIELDS = [f.split(" ")[0] for f in _INDEX.split(", ")]
_KINDS = [pa.int64() if f.split(" ")[1] == "long" else pa.string() for f in _INDEX.split(", ")]


# ------------------------------------------------------------------------- writing


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``pages(page_id, url, payload, captured)`` with digest, ``record_type`` and
    ``refers_to``. Of equal payloads of ``min_bytes`` or more the largest page_id is
    the response. Payloads are equal when SHA-1, length and a second hash agree. Only
    digests with several captures are joined back, and on an exchange of their own, so
    that a payload with many captures can be split."""
    payload = F.col("payload")
    keyed = pages.withColumns({"sha1": F.sha1(payload), "n_bytes": F.octet_length(payload).cast("long"), "check": F.xxhash64(payload)})
    several = (
        keyed.filter(F.col("n_bytes") >= min_bytes)
        .groupBy("sha1", "n_bytes", "check")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("captures"))
        .filter("captures > 1")
        .select(F.col("sha1").alias("of_sha1"), F.col("n_bytes").alias("of_bytes"), F.col("check").alias("of_check"), "first_id")
    )
    on = (F.col("sha1") == F.col("of_sha1")) & (F.col("n_bytes") == F.col("of_bytes")) & (F.col("check") == F.col("of_check"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return keyed.join(several, on, "left").withColumns(
        {
            "record_type": F.when(revisit, "revisit").otherwise("response"),
            "refers_to": F.when(revisit, F.col("first_id")),
        }
    )


def _record(marked: DataFrame) -> Column:
    revisit = F.col("record_type") == "revisit"
    block = F.concat(F.lit(HTTP_HEAD), F.when(revisit, "").otherwise(F.col("payload")))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"\r\n{name}: "), value)

    def urn(ident: Column) -> Column:
        return F.concat(F.lit(f"<{URN}"), F.coalesce(ident.cast("string"), F.lit("")), F.lit(">"))

    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.1"),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", urn(F.col("page_id"))),
        field("WARC-Target-URI", url),
        field("WARC-Date", F.col("captured")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(revisit, F.concat(field("WARC-Refers-To", urn(F.col("refers_to"))), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response"),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(BREAK),
        block,
    )


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", captured: Column | None = None, min_bytes: int = MIN_REVISIT) -> None:
    """One gzipped WARC file per task. Every row is a record; null payloads are empty,
    a null url is empty, line ends in a url are percent-encoded. ``captured`` is the
    WARC date as text; without it a clock that ticks one second per page id, and starts again after
    ``CLOCK`` of them."""
    seconds = F.pmod(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0)), F.lit(CLOCK))
    clock = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    taken = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").alias("url"),
        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("payload"),
        (F.date_format(clock, "yyyy-MM-dd'T'HH:mm:ss'Z'") if captured is None else captured).alias("captured"),
    )
    records = mark_revisits(taken, min_bytes)
    records.select(_record(records).alias("value")).write.option("lineSep", BREAK).option("compression", "gzip").text(path)


# ------------------------------------------------------------------------- reading


def url_key(url: str) -> str:
    """The sort key of a url: host labels from the last, then path and query, lower
    case, without scheme, ``www.`` and fragment."""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.strip().lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def _number(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix(URN)
    return int(digits) if digits else None


def _index_row(fields: dict[str, str], block: bytes, file: str, offset: int) -> tuple:
    payload = block.partition(BREAK.encode())[2]
    revisit = fields["warc-type"] == "revisit"
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"{file}, {offset}: the payload doesn't have its digest")
    url = fields["warc-target-uri"]
    ids = _number(fields["warc-record-id"]), _number(fields.get("warc-refers-to"))
    size = None if revisit else len(payload)
    return url_key(url), fields["warc-date"], ids[0], url, fields["warc-type"], ids[1], digest, size, file, offset


class RecordStream:
    """Cuts the bytes of an archive, which come bit by bit, into records. Lengths
    decide, so payloads may hold any bytes."""

    def __init__(self, file: str):
        self.file, self.at, self.held, self.fields, self.start, self.need = file, 0, bytearray(), None, 0, 0

    def feed(self, data: bytes) -> Iterator[tuple]:
        mark = BREAK.encode()
        self.held += data
        while True:
            if self.fields is None:
                end = self.held.find(mark)
                if end < 0 or not self.held[:end].strip():
                    return
                head = self.held[:end].decode().lstrip().split("\r\n")
                pairs = (line.partition(": ") for line in head[1:])
                self.fields = {name.lower(): value for name, _, value in pairs}
                self.start, self.need = self.at, int(self.fields["content-length"])
                del self.held[: end + len(mark)]
                self.at += end + len(mark)
            if len(self.held) < self.need + len(mark):
                return
            yield _index_row(self.fields, bytes(self.held[: self.need]), self.file, self.start)
            del self.held[: self.need + len(mark)]
            self.at += self.need + len(mark)
            self.fields = None

    def close(self) -> None:
        if self.fields is not None or self.held.strip():
            raise ValueError(f"{self.file} ends inside a record")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces between breaks, in the order of their files, to index rows. Holds one
    record at a time."""
    stream, mark = None, BREAK.encode()
    for batch in batches:
        rows: list[tuple] = []
        for file, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
            if stream is None or stream.file != file:
                if stream is not None:
                    stream.close()
                stream = RecordStream(file)
            rows.extend(stream.feed(piece.as_buffer().to_pybytes() + mark))
        columns = zip(*rows) if rows else [[] for _ in _FIELDS]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_FIELDS)
    if stream is not None:
        stream.close()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One index row per record; digests of responses are verified. A gzipped file
    isn't splittable, so one task reads it from its start to its end."""
    text = spark.read.option("lineSep", BREAK).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary")).mapInArrow(_read, _INDEX)


# --------------------------------------------------------------------------- index


class LoserTree:
    """k-way merge of sorted runs: inner nodes hold the run that lost there, so that
    the next winner needs one comparison per level."""

    def __init__(self, runs: list[list], key: Callable):
        self.runs, self.key = runs, key
        self.place = [0] * len(runs)
        self.head = [self.key(r[0]) if r else None for r in runs]
        self.loser = [-1] * max(len(runs), 1)
        self.winner = self._play(1) if runs else -1

    def _beats(self, a: int, b: int) -> bool:
        """Run a goes before run b; an ended run goes last, equal heads by run."""
        if self.head[a] is None or self.head[b] is None:
            return self.head[b] is None and (self.head[a] is not None or a < b)
        return (self.head[a], a) < (self.head[b], b)

    def _play(self, node: int) -> int:
        if node >= len(self.runs):
            return node - len(self.runs)
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.loser[node] = lost
        return won

    def __iter__(self) -> Iterator:
        while self.winner >= 0 and self.head[self.winner] is not None:
            run = self.winner
            yield self.runs[run][self.place[run]]
            self.place[run] += 1
            rest = self.runs[run]
            self.head[run] = self.key(rest[self.place[run]]) if self.place[run] < len(rest) else None
            node = (run + len(self.runs)) // 2
            while node:
                if self._beats(self.loser[node], run):
                    self.loser[node], run = run, self.loser[node]
                node //= 2
            self.winner = run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows, run after run, each sorted, into one order."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    run, url, time, page = (table.column(c).to_pylist() for c in ("run", "url_key", "captured", "page_id"))
    starts = [i for i in range(len(run)) if i == 0 or run[i] != run[i - 1]] + [len(run)]
    runs = [range(a, b) for a, b in zip(starts, starts[1:])]
    order = LoserTree(runs, lambda i: (url[i], time[i], -1 if page[i] is None else page[i]))
    yield from table.drop_columns(["run"]).take(pa.array(list(order))).to_batches()


def capture_index(records: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Index rows in global order of url key, capture time and page id.

    Each task that reads archives leaves a sorted run in the shared folder. The runs
    are cut at common boundaries of the whole key, so that a url with very many
    captures is cut as well, into ranges of about ``range_rows``; a task merges what
    the runs have in its range. Partition i of the result is before partition i + 1.
    """
    key = ["url_key", "captured", "page_id"]
    runs = written(records.withColumn("run", F.spark_partition_id()).sortWithinPartitions(*key), "runs")
    responses = (
        runs.filter("record_type = 'response'")
        .groupBy("page_id", "payload_digest")
        .agg(F.max("payload_bytes").alias("full_bytes"))
        .toDF("of_page", "of_digest", "full_bytes")
    )
    full = (
        runs.join(responses, (F.col("refers_to") == F.col("of_page")) & (F.col("payload_digest") == F.col("of_digest")), "left")
        .withColumn("payload_bytes", F.coalesce("payload_bytes", "full_bytes"))
        .select("run", *_FIELDS)
    )
    ranges = max(1, -(-runs.count() // range_rows))
    return full.repartitionByRange(ranges, *key).sortWithinPartitions("run", *key).mapInArrow(_merge, _INDEX)


def archive_pages(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write ``pages`` as WARC archives to ``path`` (a new path in the shared folder if
    none is given), read them back, and return their capture index.

    Repeated rows are records of their own; those that repeat the largest id of their
    payload are all responses. A null page id is never the one referred to. An empty
    table gives an empty index. Other columns aren't looked at.
    """
    path = path or fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, **columns)
    return capture_index(read_archives(pages.sparkSession, path))
