"""REST services as Python data sources: collections, single items, snapshots as a stream, and a writer of changes.

Calls are made in tasks. A status outside 2xx fails the read of a collection; of a single item or a write it is the
error of its row, and the others are still asked for or sent. A busy service is waited for. Writes carry an
idempotency key, which the rows bring with them, and are logged as they happen (see answer_log).
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)

from weftline.sources import http
from weftline.sources.answer_log import ANSWER, AnswerLog, answers_of
from weftline.sources.http import call, unfilled

#: Tasks that ask one service at once, at most, where not said otherwise.
CONCURRENCY = 8
#: Partitions of a paged collection; with more pages each reads several.
MOST_PARTITIONS = 1000
#: Requests that are sent between two notes in the log.
CHUNK = 64


class RestCollection(DataSource):
    """spark.read or readStream.format("rest_collection").option("url", ...): (ordinal, item_json) of a collection.

    paging: how the service cuts it. ``page`` and ``offset`` number pages by page_parameter (and size_parameter), from
    first_page (1) or 0 on; how many there are is found by probing, unless ``pages`` says it, and a range of
    pages is a partition. ``cursor`` follows links or tokens (page_parameter), one after the other. Without
    paging the answer is the collection, and a Link to a next page is followed. As a stream each
    batch is a snapshot, kept under ``snapshots`` until the batch is committed.
    """

    @classmethod
    def name(cls) -> str:
        return "rest_collection"

    def schema(self) -> str:
        return "ordinal long, item_json string"

    def reader(self, schema) -> DataSourceReader:
        return CollectionReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SnapshotReader(self.options)


class CollectionReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.method = options["url"], options.get("method", "GET")
        self.parameter, self.size_parameter = options.get("page_parameter"), options.get("size_parameter")
        self.paging = options.get("paging") or ("page" if self.parameter else "cursor")
        self.pages, self.first = options.get("pages"), int(options.get("first_page", 1))
        self.size = int(options.get("page_size", http.PAGE_SIZE))

    def _sized(self) -> str:
        return http.with_parameters(self.url, {self.size_parameter: self.size}) if self.size_parameter else self.url

    def _url_of(self, k: int) -> str:
        return http.with_parameters(self._sized(), {self.parameter: self.first + k if self.paging == "page" else k * self.size})

    def _number_of(self, url: str) -> int | None:
        given = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(url).query)).get(self.parameter, "")
        if not given.isdigit():
            return None
        return int(given) - self.first if self.paging == "page" else int(given) // self.size

    def partitions(self) -> list[InputPartition]:
        if self.paging == "cursor":
            return [InputPartition(None)]
        if self.paging == "offset" and not self.size_parameter:  # pages are as large as the service makes them
            self.size = max(1, len(http.page(http.with_parameters(self.url, {self.parameter: 0}), self.method)[0]))
        n = int(self.pages) if self.pages else http.count_pages(self._url_of, self.method, self._number_of)
        step = -(-n // MOST_PARTITIONS)
        return [InputPartition((self.size, k, min(n, k + step))) for k in range(0, n, step)]

    def read_pages(self, partition: InputPartition) -> Iterator[tuple[int, list]]:
        """(page number, items)"""
        if partition.value is None:
            yield from enumerate(http.chain(self._sized(), self.method, self.parameter))
            return
        self.size, begin, end = partition.value
        for k in range(begin, end):
            yield k, http.page(self._url_of(k), self.method)[0]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for k, items in self.read_pages(partition):
            for i, item in enumerate(items):
                yield (k << 32) + i, json.dumps(item, ensure_ascii=False)


class SnapshotReader(DataSourceStreamReader):
    """Snapshots of a collection, one a batch; offsets are their numbers.

    What a task has read of a snapshot is kept as one file per partition, moved to its name when it is whole. A
    batch that is run again after a stop reads those files and asks the service only for the rest. So
    the numbers go on without a gap, and no batch sees two different snapshots. The plan of a snapshot, its
    pages, is kept beside the files.
    """

    def __init__(self, options):
        self.options = dict(options)
        self.folder = options["snapshots"].rstrip("/")
        self.latest = None

    def _opened(self):
        return arrow_fs.FileSystem.from_uri(self.folder)

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def _kept(self) -> int:
        """The greatest number of a snapshot whose plan is kept, or that was committed."""
        fs, root = self._opened()
        fs.create_dir(root, recursive=True)
        numbers = [int(i.base_name) for i in fs.get_file_info(arrow_fs.FileSelector(root)) if i.base_name.isdigit()]
        return max(numbers, default=0)

    def latestOffset(self) -> dict:
        """One more than the last: each batch is a new snapshot."""
        self.latest = (self._kept() if self.latest is None else self.latest) + 1
        return {"snapshot": self.latest}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        fs, root = self._opened()
        place = f"{root}/{end['snapshot']:010d}"
        fs.create_dir(place, recursive=True)
        if fs.get_file_info(f"{place}/plan").type == arrow_fs.FileType.NotFound:
            plan = [p.value for p in CollectionReader(self.options).partitions()]
            with fs.open_output_stream(f"{place}/_plan") as out:
                out.write(json.dumps(plan).encode())
            fs.move(f"{place}/_plan", f"{place}/plan")
        with fs.open_input_stream(f"{place}/plan") as text:
            plan = json.loads(text.read())
        return [InputPartition((end["snapshot"], k, value)) for k, value in enumerate(plan)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        number, k, value = partition.value
        fs, root = self._opened()
        path = f"{root}/{number:010d}/part-{k:06d}"
        if fs.get_file_info(path).type == arrow_fs.FileType.NotFound:
            mine = f"{root}/{number:010d}/_{k}-{uuid.uuid4().hex}"
            with fs.open_output_stream(mine) as out:
                for row in CollectionReader(self.options).read(InputPartition(value)):
                    out.write((json.dumps(row, ensure_ascii=False) + "\n").encode())
            fs.move(mine, path)
        with fs.open_input_file(path) as source, pa.PythonFile(source, "r") as lines:
            for line in _lines(lines):
                yield tuple(json.loads(line))

    def commit(self, end: dict) -> None:
        """Earlier snapshots go, and this one's rows; its folder stays, as the number that was reached."""
        fs, root = self._opened()
        for info in fs.get_file_info(arrow_fs.FileSelector(root)):
            if not info.base_name.isdigit() or int(info.base_name) > end["snapshot"]:
                continue
            if int(info.base_name) < end["snapshot"]:
                fs.delete_dir(info.path)
            else:
                for part in fs.get_file_info(arrow_fs.FileSelector(info.path)):
                    fs.delete_file(part.path)


def _lines(source, size: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while block := source.read(size):
        *lines, rest = (rest + block).split(b"\n")
        yield from lines
    if rest:
        yield rest


def ask_one(url: str, method: str) -> tuple[str | None, str | None]:
    """(item_json, error) of a single item; both null where it is not there."""
    try:
        if unfilled(url):
            raise ValueError(f"unfilled path {url}")
        return json.dumps(call(url, method).body, ensure_ascii=False), None
    except urllib.error.HTTPError as error:
        return None, None if error.code in http.GONE else f"{type(error).__name__}: {error}"
    except (OSError, ValueError) as error:
        return None, f"{type(error).__name__}: {error}"


class RestItems(DataSource):
    """spark.read.format("rest_items").option("url", ".../{id}"): (id, item_json, error) of the items that a filter on id names.

    Filters ``id = ...`` and ``id in (...)`` reach the reader, and only those items are asked for, by ``concurrency`` tasks at
    once. An item that is not there gives no row; one that cannot be had has an error.
    """

    @classmethod
    def name(cls) -> str:
        return "rest_items"

    def schema(self) -> str:
        return "id string, item_json string, error string"

    def reader(self, schema) -> DataSourceReader:
        return ItemReader(self.options)


class ItemReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.method = options["url"], options.get("method", "GET")
        self.concurrency = int(options.get("concurrency", CONCURRENCY))
        self.ids: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("id",):
                named = set(f.value if isinstance(f, In) else (f.value,)) - {None}
                self.ids = named if self.ids is None else self.ids & named
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.ids is None:
            raise ValueError("single items need a filter on id, and spark.sql.python.filterPushdown.enabled")
        ids = sorted(self.ids)
        return [InputPartition(ids[k :: self.concurrency]) for k in range(min(self.concurrency, len(ids)))] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i in partition.value:
            item, error = ask_one(self.url.replace("{id}", urllib.parse.quote(i, safe="")), self.method)
            if item is not None or error is not None:
                yield i, item, error


def point_reads(spark: SparkSession, url: str, ids: list[str], method: str = "GET", concurrency: int = CONCURRENCY) -> DataFrame:
    """(id, item, error) of a few items that the caller names."""
    from weftline.functions.records import record

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RestItems)
    rows = spark.read.format("rest_items").options(url=url, method=method, concurrency=str(concurrency)).load()
    return rows.where(F.col("id").isin(*ids)).select("id", record(F.col("item_json")).alias("item"), "error")


def paging_of(endpoint: Row) -> dict[str, str]:
    """An endpoint's paging as options of a scan; none if its description declares none."""
    found = endpoint.paging
    return {"paging": found.kind, "page_parameter": found.page, "size_parameter": found.size} if found else {}


def scan(spark: SparkSession, url: str, method: str = "GET", **paging) -> DataFrame:
    """(ordinal, item) of a collection; placeholders in the url are sent as they are."""
    from weftline.functions.records import record

    spark.dataSource.register(RestCollection)
    rows = spark.read.format("rest_collection").options(url=url, method=method, **{k: str(v) for k, v in paging.items() if v is not None}).load()
    return rows.select("ordinal", record(F.col("item_json")).alias("item"))


def fetch(requests: DataFrame, errors: bool = False, concurrency: int | None = None) -> DataFrame:
    """(ordinal, target_id, item) of single items, asked for by (target_id, url, method) in tasks, ``concurrency`` of them at once.

    One that is not there gives no row. One that cannot be had fails the read, or, with ``errors``, is a row
    with an error.
    """
    from weftline.functions.records import record

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                item, error = ask_one(r["url"], r["method"])
                if error and not errors:
                    raise ValueError(error)
                if item is not None or error:
                    found.append((r["target_id"], item, error))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(3)], ["target_id", "item_json", "error"])

    asked = requests.select("target_id", "url", "method")
    rows = (asked.repartition(concurrency, "target_id") if concurrency else asked).mapInArrow(run, "target_id string, item_json string, error string")
    return rows.select(F.lit(0).cast("long").alias("ordinal"), "target_id", record(F.col("item_json")).alias("item"), *(["error"] if errors else []))


def sent(r: dict) -> tuple[str | None, str | None, bool]:
    """(response_id_json, error, failed) of a request."""
    if unfilled(r["url"]):
        return None, f"unfilled path {r['url']}", True
    try:
        answer = call(r["url"], r["method"], r["body"], r["key"]).body
    except (OSError, ValueError) as error:  # refused, timed out, a status outside 2xx, no JSON
        return None, f"{type(error).__name__}: {error}", True
    found = answer.get("id") if isinstance(answer, dict) else None
    missing = r["method"].upper() == "POST" and found is None
    return None if found is None else json.dumps(found), "the answer has no id" if missing else None, False


@dataclass
class Sent(WriterCommitMessage):
    """What a task did; with ``earlier`` those that its earlier attempts had done."""

    answered: int
    failed: int
    earlier: int
    error: str | None


class RestRequests(DataSource):
    """df.write.format("rest_requests").option("answers", folder): sends (ordinal, source_id, url, method, body, key)."""

    @classmethod
    def name(cls) -> str:
        return "rest_requests"

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return RequestWriter(self.options)


class RequestWriter(DataSourceArrowWriter):
    """Tasks send rows and log them chunk by chunk; commit sums up what they report, abort leaves the log as it is.

    A task that Spark repeats finds what its earlier attempts logged and sends only the rest.
    """

    def __init__(self, options):
        self.folder, self.job, self.chunk = options["answers"], options["job"], int(options.get("chunk", CHUNK))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        log = AnswerLog(self.folder, f"{self.job}-{TaskContext.get().partitionId():06d}")
        earlier = {r["ordinal"]: r for r in log.earlier()}
        done = list(earlier.values())
        failed = sum(r["failed"] for r in done)
        total, error = len(done), min((r["error"] for r in done if r["failed"]), default=None)
        for batch in iterator:
            for at in range(0, batch.num_rows, self.chunk):
                rows = [r for r in batch.slice(at, self.chunk).to_pylist() if r["ordinal"] not in earlier]
                if not rows:
                    continue
                log.begin([r["ordinal"] for r in rows])
                answers: list[dict] = []
                try:
                    for r in rows:
                        found, wrong, did_fail = sent(r)
                        answers.append({"ordinal": r["ordinal"], "source_id": r["source_id"], "response_id_json": found, "error": wrong, "failed": did_fail})
                finally:  # what was answered is known, also if the task ends here
                    log.end(answers)
                total += len(answers)
                failed += sum(a["failed"] for a in answers)
                error = min([a["error"] for a in answers if a["failed"]] + ([error] if error else []), default=None)
        return Sent(total, failed, len(earlier), error)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        told = [m for m in messages if m]
        errors = [m.error for m in told if m.error]
        AnswerLog(self.folder).summarise({"answered": sum(m.answered for m in told), "failed": sum(m.failed for m in told), "earlier": sum(m.earlier for m in told), "error": min(errors, default=None)})

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """What was created stays created: the log is what recovery reads."""


def write(requests: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Send (ordinal, source_id, url, method, body, key); (ordinal, source_id, response_id_json, error, failed) of each, from the log in folder.

    failed: the call itself, or what led to it; a created item without an id is an error of its row only.
    """
    spark = requests.sparkSession
    spark.dataSource.register(RestRequests)
    AnswerLog(folder)  # a log without rows can be read
    rows = requests.select("ordinal", "source_id", "url", "method", "body", "key")
    rows.write.format("rest_requests").options(answers=folder, job=uuid.uuid4().hex, chunk=str(chunk)).mode("append").save()
    return answers_of(spark, folder)


__all__ = ["ANSWER", "RestCollection", "RestItems", "RestRequests", "fetch", "paging_of", "point_reads", "scan", "unfilled", "write"]
