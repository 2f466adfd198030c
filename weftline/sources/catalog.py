"""Versioned Parquet tables: a write makes a new version, then moves a pointer to it.

A table is read whole or pruned by Spark; it is never overwritten while a plan may still read it. There is
one writer at a time. A table that was never written is empty. JSON files serve for interchange only.

The id map is a log: an append writes the new rows alone, in folders by mapping, and a read takes all
versions since the last whole one. ``compact`` makes a whole one of each pair's last row; it happens by
itself after COMPACT_AFTER appends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import schemas
from weftline.operators.endpoints import with_identifier
from weftline.operators.keyed import latest

TABLES = {"apis": schemas.APIS, "mappings": schemas.MAPPINGS, "id_map": schemas.ID_MAP, "passes": schemas.PASSES, "in_doubt": schemas.IN_DOUBT, "sent": schemas.SENT}
#: Tables that are logs: the column of their folders, the key of which the last row counts, and the column that orders rows.
LOGS = {
    "id_map": ("mapping_id", ["mapping_id", "a_id"], "seq"),
    "passes": ("mapping_id", ["mapping_id", "run_id", "recovered"], "n_read"),
    "in_doubt": ("mapping_id", ["mapping_id", "key"], "seq"),
    "sent": ("mapping_id", ["mapping_id", "reverse", "target_id"], "seq"),
}
WHOLE = "-whole"
COMPACT_AFTER = 50


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self, table: str) -> list[str]:
        """Pointers in order; they are empty folders named by number and version."""
        path, fs = self._fs(f"{self.root}/{table}/pointers")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def current(self, table: str) -> list[str]:
        """The versions that make up the table: the newest, or those of a log since the last whole one."""
        pointers = self._pointers(table)
        if table not in LOGS:
            return pointers[-1:]
        whole = max((i for i, p in enumerate(pointers) if p.endswith(WHOLE)), default=0)
        return pointers[whole:]

    def next_number(self, table: str) -> int:
        """The number of the table's next version."""
        pointers = self._pointers(table)
        return int(pointers[-1][:10]) + 1 if pointers else 0

    def read(self, table: str) -> DataFrame:
        return self._of(table, self.current(table))

    def read_after(self, table: str, number: int) -> DataFrame:
        """The rows of a log's versions after that number; all of it if it was compacted since."""
        return self._of(table, [p for p in self.current(table) if int(p[:10]) > number])

    def _of(self, table: str, current: list[str]) -> DataFrame:
        if not current:
            return self.spark.createDataFrame([], TABLES[table])
        versions = f"{self.root}/{table}/versions"
        columns = [f.name for f in self.spark.createDataFrame([], TABLES[table]).schema]
        reader = self.spark.read.schema(TABLES[table] + ", version string").option("basePath", versions)
        return reader.parquet(*[f"{versions}/version={p}" for p in current]).select(*columns)

    def _put(self, table: str, df: DataFrame, kind: str = "", tag: str | None = None) -> None:
        pointer = f"{self.next_number(table):010d}-{tag or uuid.uuid4().hex}{kind}"
        empty = self.spark.createDataFrame([], TABLES[table])
        # a version that a driver left without its pointer is written over
        writer = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema]).write.mode("overwrite")
        (writer.partitionBy(LOGS[table][0]) if table in LOGS else writer).parquet(f"{self.root}/{table}/versions/version={pointer}")
        path, fs = self._fs(f"{self.root}/{table}/pointers/{pointer}")
        fs.mkdirs(path)

    def write(self, table: str, df: DataFrame) -> None:
        self._put(table, df, WHOLE if table in LOGS else "")

    def has(self, table: str, tag: str) -> bool:
        """Whether the append of this tag is done."""
        return any(p[11:] == tag for p in self._pointers(table))

    def append(self, table: str, rows: DataFrame, tag: str | None = None) -> None:
        """tag: a name for this append, which is then done once, however often it is asked for."""
        if table not in LOGS:
            return self.write(table, self.read(table).unionByName(rows))
        if tag and self.has(table, tag):
            return
        self._put(table, rows, tag=tag)
        if len(self.current(table)) > COMPACT_AFTER:
            self.compact(table)

    def compact(self, table: str) -> None:
        """The last row of each key of a log, as one whole version."""
        _, keys, order = LOGS[table]
        self.write(table, latest(self.read(table), keys, order))

    def vacuum(self, table: str) -> None:
        """Deletes versions that are no longer part of the table; to be called when no plan reads them."""
        current = self.current(table)
        for pointer in [p for p in self._pointers(table) if p not in current]:
            for folder in (f"pointers/{pointer}", f"versions/version={pointer}"):  # first what names it
                self.remove(f"{self.root}/{table}/{folder}")

    def remove(self, path: str) -> None:
        hadoop, fs = self._fs(path)
        fs.delete(hadoop, True)

    def exists(self, path: str) -> bool:
        hadoop, fs = self._fs(path)
        return fs.exists(hadoop)

    def listed(self, path: str) -> list[str]:
        """Names in a folder, none if there is no such folder."""
        hadoop, fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []

    def put_text(self, path: str, text: str) -> None:
        """A small file, moved to its name once it is whole."""
        place, _, name = path.rpartition("/")
        hadoop, fs = self._fs(f"{place}/_{name}")
        out = fs.create(hadoop, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.rename(hadoop, self._fs(path)[0])

    def text(self, path: str) -> str:
        return "\n".join(r.value for r in self.spark.read.text(path).collect())  # of put_text

    def apis(self) -> DataFrame:
        return self.read("apis")

    def mappings(self) -> DataFrame:
        return self.read("mappings")

    def api(self, api_id: str) -> DataFrame:
        return self.apis().where(F.col("id") == api_id).limit(1)

    def endpoints(self) -> DataFrame:
        """One row per endpoint: api_id, ordinal, its fields, identifier."""
        rows = self.apis().select(F.col("id").alias("api_id"), F.posexplode("endpoints").alias("ordinal", "e"))
        return with_identifier(rows.select("api_id", "ordinal", "e.*"))

    def endpoint_identifiers(self, api_id: str) -> DataFrame:
        return self.endpoints().where(F.col("api_id") == api_id).select("ordinal", "identifier")


def read_json(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A JSON array of a table's rows."""
    return spark.read.schema(TABLES[table]).option("multiLine", True).json(path)
