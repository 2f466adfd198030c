"""A directed pass on disk, and how one that was cut off is finished.

A run is a folder: ``intent`` says whose pass it is; tables hold what was read and planned; a step's requests are
whole (Parquet's marker) before the first is sent, and what was asked and answered is logged as it happens. The ids
of created items are committed once, by the name of run and step. A run ends by the removal of its folder, or
by the mark ``ended`` where calls failed, for whoever wants to look at them; ``vacuum`` removes those.

A run without end was cut off. If a step's requests are not whole, none was sent. Else those that were
never begun are sent now, and those without an answer again, with their keys: an update says the same twice, and a
create is done once by a service that honours keys. With a service that does not, a create that was begun and has no
answer is in doubt: it is not sent again but noted in the table ``in_doubt``, and no pass creates its item
before somebody has settled the question.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftline import schemas
from weftline.functions.records import key_of
from weftline.operators.keyed import latest
from weftline.operators.sync import CREATE
from weftline.sources.answer_log import AnswerLog, answers_of, begun_of
from weftline.sources.catalog import Catalog
from weftline.sources import rest

REQUEST = "ordinal long, source_id string, url string, method string, body string, key string, action string"
STEPS = ("first", "later")


@dataclass
class Counts:
    read: int = 0
    created: int = 0
    updated: int = 0
    unchanged: int = 0
    failed: int = 0
    in_doubt: int = 0
    errors: list[str] = field(default_factory=list)

    @property
    def applied(self) -> int:
        return self.created + self.updated


def seen(told: Observation) -> defaultdict:
    """What an observation counted; 0 where a plan without rows left it out."""
    return defaultdict(int, {k: v for k, v in told.get.items() if v is not None})


class Run:
    def __init__(self, catalog: Catalog, folder: str, write: Callable | None = None):
        self.catalog, self.spark, self.folder = catalog, catalog.spark, folder
        self.run_id = folder.rpartition("/")[2]
        self.write = write
        self.intent = json.loads(catalog.text(f"{folder}/intent"))

    @classmethod
    def begin(cls, catalog: Catalog, work: str, write: Callable | None = None, **intent) -> Run:
        folder = f"{work}/{uuid.uuid4().hex}"
        catalog.put_text(f"{folder}/intent", json.dumps(intent))
        return cls(catalog, folder, write)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def _requests(self, step: str) -> DataFrame:
        return self.spark.read.schema(REQUEST).parquet(f"{self.folder}/requests-{step}")

    def _log(self, step: str) -> str:
        return f"{self.folder}/answers-{step}"

    def _send(self, requests: DataFrame, step: str) -> None:
        log = self._log(step)
        if self.write is None:
            rest.write(requests, log)
            return
        # a caller's own way of writing: all rows count as begun, their answers are noted when all are there
        AnswerLog(log)
        requests.select("ordinal").write.mode("append").json(f"{log}/begun")
        told = Observation()
        answers = self.write(requests).observe(told, F.count(F.lit(1)).alias("answered"), F.count_if("failed").alias("failed"), F.min(F.when(F.col("failed"), F.col("error"))).alias("error"))
        answers.write.mode("append").json(f"{log}/answers")
        AnswerLog(log).summarise(dict(seen(told)))

    def send(self, requests: DataFrame, step: str, counts: Counts) -> None:
        """Write a step's requests down, send them, commit the ids of what they created. Counts come from the jobs that do it."""
        told = Observation()
        created = F.col("action") == CREATE
        requests = requests.observe(told, F.count_if(created).alias("created"), F.count_if(~created).alias("updated"))
        requests = self.keep(requests.select(*[c.split()[0] for c in REQUEST.split(", ")]), f"requests-{step}")
        done = seen(told)
        counts.created += done["created"]
        counts.updated += done["updated"]
        self._send(requests, step)
        self.commit(step, done["created"])
        summary = AnswerLog(self._log(step)).summary() or {}
        counts.failed += summary.get("failed", 0)
        if summary.get("error"):
            counts.errors.append(summary["error"])

    def commit(self, step: str, created: int = 1) -> None:
        """The ids of what a step created, once, however often this is called."""
        if not created:
            return
        catalog, mapping_id = self.catalog, self.intent["mapping_id"]
        requests = self._requests(step).where((F.col("action") == CREATE) & F.col("source_id").isNotNull()).select("ordinal")
        ids = answers_of(self.spark, self._log(step)).where("error is null").join(requests, "ordinal")
        new = ids.select("ordinal", "source_id", key_of(F.parse_json("response_id_json")).alias("target_id")).where("target_id is not null")
        a, b = ("target_id", "source_id") if self.intent["reverse"] else ("source_id", "target_id")
        order = F.lit(catalog.next_number("id_map") << 40) + F.pmod("ordinal", F.lit(1 << 40))
        catalog.append("id_map", new.select(F.lit(mapping_id).alias("mapping_id"), F.col(a).alias("a_id"), F.col(b).alias("b_id"), order.alias("seq")), tag=f"{self.run_id}-{step}")

    def note_sent(self, digests: DataFrame, step: str) -> None:
        """Of the updates that did not fail what was sent, and over which base."""
        catalog = self.catalog
        done = answers_of(self.spark, self._log(step)).where("not failed").select("ordinal")
        order = F.lit(catalog.next_number("sent") << 40) + F.pmod("ordinal", F.lit(1 << 40))
        rows = digests.join(done, "ordinal").select(F.lit(self.intent["mapping_id"]).alias("mapping_id"), F.lit(self.intent["reverse"]).alias("reverse"), "target_id", "payload_digest", "base_digest", order.alias("seq"))
        catalog.append("sent", rows, tag=f"{self.run_id}-{step}")

    def end(self, counts: Counts, recovered: bool = False) -> None:
        """Note what was done. The folder goes, unless calls failed."""
        row = (self.run_id, self.intent["mapping_id"], self.intent["reverse"], counts.read, counts.created, counts.updated, counts.unchanged, counts.failed, counts.in_doubt, recovered)
        self.catalog.append("passes", self.spark.createDataFrame([row], schemas.PASSES), tag=f"{self.run_id}-{'recovered' if recovered else 'ended'}")
        if counts.failed and not recovered:
            self.catalog.put_text(f"{self.folder}/ended", json.dumps({"failed": counts.failed}))
        else:
            self.catalog.remove(self.folder)

    def finish(self) -> Counts | None:
        """Does what a cut-off run left undone; None if nothing of it had been sent."""
        if not any(self.catalog.exists(f"{self.folder}/requests-{step}/_SUCCESS") for step in STEPS):
            self.catalog.remove(self.folder)
            return None
        counts, honours = Counts(), self.intent.get("honours_keys", False)
        for step in STEPS:
            if not self.catalog.exists(f"{self.folder}/requests-{step}/_SUCCESS"):
                continue
            log, requests = self._log(step), self._requests(step)
            AnswerLog(log)
            open_rows = requests.join(answers_of(self.spark, log).select("ordinal"), "ordinal", "left_anti")
            begun = begun_of(self.spark, log).withColumn("begun", F.lit(True))
            doubtful = F.coalesce("begun", F.lit(False)) & (F.col("action") == CREATE) & F.lit(not honours)
            told = Observation()
            sorted_out = open_rows.join(begun, "ordinal", "left").withColumn("doubtful", doubtful)
            sorted_out = sorted_out.observe(
                told, F.count_if("doubtful").alias("doubtful"), F.count_if(~F.col("doubtful") & (F.col("action") == CREATE)).alias("created"), F.count_if(~F.col("doubtful") & (F.col("action") != CREATE)).alias("updated")
            )
            name = f"left-{step}-{uuid.uuid4().hex}"  # finishing may be cut off too
            left = self.keep(sorted_out.select(*requests.columns, "doubtful"), name)
            found = seen(told)
            if found["doubtful"]:
                seq = F.lit(self.catalog.next_number("in_doubt") << 40) + F.pmod("ordinal", F.lit(1 << 40))
                doubts = left.where("doubtful").select(
                    F.lit(self.intent["mapping_id"]).alias("mapping_id"), F.lit(self.intent["reverse"]).alias("reverse"), "source_id", "url", "body", "key", F.lit(self.run_id).alias("run_id"), seq.alias("seq"), F.lit(False).alias("settled")
                )
                self.catalog.append("in_doubt", doubts, tag=f"{self.run_id}-{step}")
            if found["created"] + found["updated"]:
                self._send(left.where("not doubtful").select(*requests.columns), step)
                summary = AnswerLog(log).summary() or {}
                counts.failed += summary.get("failed", 0)
                counts.errors += [summary["error"]] if summary.get("error") else []
            self.commit(step)
            counts.created += found["created"]
            counts.updated += found["updated"]
            counts.in_doubt += found["doubtful"]
        self.end(counts, recovered=True)
        return counts


def unfinished(catalog: Catalog, work: str, write: Callable | None = None) -> list[Run]:
    """Runs that were cut off; a folder without an intent never began and goes."""
    found = []
    for name in catalog.listed(work):
        names = catalog.listed(f"{work}/{name}")
        if "ended" in names:
            continue
        if "intent" in names:
            found.append(Run(catalog, f"{work}/{name}", write))
        else:
            catalog.remove(f"{work}/{name}")
    return found


def vacuum(catalog: Catalog, work: str | None = None) -> int:
    """Removes runs that ended with failed calls; how many."""
    work = work or f"{catalog.root}/work"
    ended = [n for n in catalog.listed(work) if catalog.exists(f"{work}/{n}/ended")]
    for name in ended:
        catalog.remove(f"{work}/{name}")
    return len(ended)


def in_doubt(catalog: Catalog, mapping_id: str | None = None) -> DataFrame:
    """The creates of which it is not known whether they were done."""
    rows = catalog.read("in_doubt")
    rows = rows if mapping_id is None else rows.where(F.col("mapping_id") == mapping_id)
    return latest(rows, ["mapping_id", "key"]).where("not settled")


def settle(catalog: Catalog, mapping_id: str, key: str, target_id: str | None) -> None:
    """Somebody has looked: target_id is the key (a JSON text) of what the create made, None if it was not done and may be."""
    row = in_doubt(catalog, mapping_id).where(F.col("key") == key).first()
    if row is None:
        raise KeyError(key)
    if target_id is not None and row.source_id is not None:
        a, b = (target_id, row.source_id) if row.reverse else (row.source_id, target_id)
        pair = catalog.spark.createDataFrame([(mapping_id, a, b, catalog.next_number("id_map") << 40)], schemas.ID_MAP)
        catalog.append("id_map", pair)
    settled = [(*row[:-2], catalog.next_number("in_doubt") << 40, True)]
    catalog.append("in_doubt", catalog.spark.createDataFrame([_in_order(row, settled[0])], schemas.IN_DOUBT))


def _in_order(row, values: tuple) -> tuple:
    """values, which follow the row's columns, in the order of the table's."""
    named = dict(zip(row.__fields__, values, strict=True))
    return tuple(named[c.split()[0]] for c in schemas.IN_DOUBT.split(", "))
