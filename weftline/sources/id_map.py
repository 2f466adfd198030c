"""The id map of a mapping as a bucketed base and the log since.

A base is the last pair of each a_id, written twice: bucketed and sorted by a_id for passes from a to b, and by b_id for
those back. A join with it moves the items alone: the base lies in its buckets already. What was appended since is the
delta, of at most BASE_AFTER appends; it overrides the base. Several a_ids with one b_id, which
should not be but may, stay with the delta, where the first of them is found as in the log.

A base is a folder named by the number of the log's last version in it. Folders hold Parquet files with their bucket in
their names; a session names them to its own catalog when it reads them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.records import linked
from weftline.operators.keyed import first_match, latest
from weftline.operators.sync import _or_none
from weftline.sources.catalog import Catalog

#: Appends after which a round makes a new base, and pairs of a bucket on average.
BASE_AFTER, BUCKET_ROWS = 20, 4_000_000
PAIR = "a_id string, b_id string, seq long"


@dataclass
class Layers:
    """Links of one direction: base (source_id, target_id), each source_id once; delta (a_id, b_id, seq), each a_id once."""

    base: DataFrame
    delta: DataFrame
    reverse: bool

    def link(self, items: DataFrame) -> DataFrame:
        """items (ordinal, source_id, ...) with the target_id that their link names, if there is one."""
        base = self.base.select(F.col("source_id").alias("base_source"), F.col("target_id").alias("base_target"))
        joined = items.join(base, _or_none(F.col("source_id")) == F.col("base_source"), "left")
        source, target = ("b_id", "a_id") if self.reverse else ("a_id", "b_id")
        changed = self.delta.where(F.col(source).isNotNull())
        changed = first_match(changed, [source], "seq") if self.reverse else changed
        changed = changed.select(F.col(source).alias("new_source"), F.col(target).alias("new_target"))
        joined = joined.join(changed, _or_none(F.col("source_id")) == F.col("new_source"), "left")
        if self.reverse:  # a pair whose a_id has another one by now counts no longer; else the first pair does
            moved = self.delta.select(F.col("a_id").alias("moved_id"))
            joined = joined.join(moved, _or_none(F.col("base_target")) == F.col("moved_id"), "left")
            found = F.when(F.col("base_source").isNotNull() & F.col("moved_id").isNull(), F.col("base_target")).otherwise(F.col("new_target"))
        else:
            found = F.when(F.col("new_source").isNotNull(), F.col("new_target")).otherwise(F.col("base_target"))
        return joined.select(*items.columns, F.when(linked(found), found).alias("target_id"))


class IdMap:
    def __init__(self, catalog: Catalog, mapping_id: str):
        self.catalog, self.spark, self.mapping_id = catalog, catalog.spark, mapping_id
        self.root = f"{catalog.root}/id_base/{hashlib.sha256(mapping_id.encode()).hexdigest()[:24]}"

    def _base(self) -> str | None:
        """The newest base that is whole."""
        whole = [n for n in self.catalog.listed(self.root) if self.catalog.exists(f"{self.root}/{n}/whole")]
        return whole[-1] if whole else None

    def _log(self, after: int | None = None) -> DataFrame:
        rows = self.catalog.read("id_map") if after is None else self.catalog.read_after("id_map", after)
        return rows.where(F.col("mapping_id") == self.mapping_id).select("a_id", "b_id", "seq")

    def pairs(self) -> DataFrame:
        """(a_id, b_id, seq): the last pair of each a_id."""
        return latest(self._log(), ["a_id"])

    def _bucketed(self, path: str, key: str, buckets: int) -> DataFrame:
        name = f"weftline_ids_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({PAIR}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def compact(self) -> None:
        """Make a base of all that the log holds by now; older bases go."""
        number = self.catalog.next_number("id_map") - 1
        if number < 0 or self._base() == f"{number:010d}":
            return
        folder, pairs = f"{self.root}/{number:010d}", self.pairs().persist()
        n = pairs.count()
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_ROWS))
        shared = pairs.groupBy("b_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and b_id is not null").select("b_id")
        pairs.join(shared, "b_id", "left_semi").select("a_id", "b_id", "seq").write.mode("overwrite").parquet(f"{folder}/contested")
        for key, rows in (("a_id", pairs), ("b_id", pairs.where("b_id is not null").join(shared, "b_id", "left_anti"))):
            name = f"weftline_making_{hashlib.sha256(folder.encode()).hexdigest()[:16]}_{key}"
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            # one file a bucket
            rows = rows.select("a_id", "b_id", "seq").repartition(buckets, key)
            rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/by_{key}").format("parquet").saveAsTable(name)
            self.spark.sql(f"DROP TABLE {name}")  # its files stay, they lie at a path of their own
        self.catalog.put_text(f"{folder}/whole", str(buckets))
        pairs.unpersist()
        for old in [n for n in self.catalog.listed(self.root) if n < f"{number:010d}"]:
            self.catalog.remove(f"{self.root}/{old}")

    def refresh(self) -> None:
        """A new base if there is none and enough was appended, or if much was appended since."""
        base = self._base()
        since = self.catalog.next_number("id_map") - 1 - (int(base) if base else -1)
        if since > BASE_AFTER:
            self.compact()

    def layers(self, reverse: bool) -> Layers | None:
        """Base and delta of a direction, None without a base."""
        base = self._base()
        if base is None:
            return None
        folder, key = f"{self.root}/{base}", "b_id" if reverse else "a_id"
        rows = self._bucketed(f"{folder}/by_{key}", key, int(self.catalog.text(f"{folder}/whole")))
        source, target = ("b_id", "a_id") if reverse else ("a_id", "b_id")
        contested = self.spark.read.schema(PAIR).parquet(f"{folder}/contested")
        delta = latest(self._log(int(base)).unionByName(contested), ["a_id"])
        return Layers(rows.where(F.col(source).isNotNull()).select(F.col(source).alias("source_id"), F.col(target).alias("target_id")), delta, reverse)
