"""Sync rounds: both directed passes of each mapping, once or in a stream.

A pass is planned as a table first, then applied as a run (see runs): requests are written down before they are
sent and answers are noted as they come, so that an id that was created is lost neither with an executor nor with the
driver; a round finishes runs that were cut off before it plans anything. A call that fails does not
keep the others of its pass from being sent, and a linked item whose base cannot be had is left out alone: the ids of
what was created are committed, and then the failures end the mapping's round, and no other's. The passes
of a round depend on each other: the id map is committed between them. Collections are read by the paging that
their descriptions declare. What a pass did is counted by the jobs that do it and noted in the table ``passes``.

As a stream, each batch is a snapshot of the first side's collection, or, for all mappings, a tick at a fixed rate.

Of items that repeat an id in one snapshot the first is written first, and the last of the others after its id
is known, as an update: what the steps between would have written is written over by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from weftline.functions.paths import fill
from weftline.functions.records import record
from weftline.operators.graph import sides
from weftline.operators.keyed import latest
from weftline.operators.sync import CREATE, UPDATE, directed, keyed_items, lookup_keys, plan_pass, with_noop
from weftline.sources import rest
from weftline.sources.catalog import Catalog
from weftline.sources.id_map import IdMap
from weftline.sources.rest import paging_of
from weftline.streaming.runs import Counts, Run, in_doubt, seen, unfinished


class SyncError(RuntimeError):
    """Calls of a pass failed; what succeeded is committed."""


def id_pairs(catalog: Catalog, mapping_id: str) -> DataFrame:
    """(ordinal, a_id, b_id): the last pair of each a_id of a mapping."""
    log = catalog.read("id_map").where(F.col("mapping_id") == mapping_id)
    return latest(log, ["mapping_id", "a_id"]).select(F.col("seq").alias("ordinal"), "a_id", "b_id")


def path_of(endpoint: Row) -> Column:
    """The path of an endpoint with the key target_id, a JSON text, filled in as plain text."""
    value = F.try_variant_get(F.try_parse_json("target_id"), "$", "string")
    names = F.array(*[F.lit(p.name) for p in (endpoint.parameters or [])]).cast("array<string>")
    return fill(F.lit(endpoint.path), names, F.create_map(F.lit("id"), value))


def requests_of(plan: DataFrame, base_url: str, create: Row, update: Row, mapping_id: str, run_id: str) -> DataFrame:
    """Planned rows as (ordinal, source_id, url, method, body, key, action).

    The key names the run and the row, so that no two requests share one. A create of an item with an id is
    named by that id instead: a service that honours keys then creates it once, even if its answer was lost.
    """
    is_create = F.col("action") == CREATE
    item = F.when(is_create & F.col("source_id").isNotNull(), F.concat(F.lit("create:"), "source_id")).otherwise(F.concat_ws(":", F.col("action"), F.lit(run_id), F.col("ordinal")))
    return plan.select(
        "ordinal",
        "source_id",
        F.concat(F.lit(base_url), F.when(is_create, F.lit(create.path)).otherwise(path_of(update))).alias("url"),
        F.when(is_create, F.lit(create.method)).otherwise(F.lit(update.method)).alias("method"),
        (F.col("payload") if dict(plan.dtypes)["payload"] == "string" else F.to_json("payload")).alias("body"),
        F.concat(F.lit(f"{mapping_id}:{base_url}:"), item).alias("key"),
        "action",
    )


def repeats(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first, later): the first item of each id, with all that have none, and of ids with more the last item."""
    named = keyed_items(items)
    ends = named.where("source_id is not null").groupBy("source_id").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last")).where("first < last")
    # ids that repeat are few, if there are any: the items meet them alone
    met = named.join(ends, "source_id", "left")
    first = met.where("last is null or ordinal = first").select("ordinal", "item")
    return first, met.where("ordinal = last").select("ordinal", "item")


def run_pass(
    catalog: Catalog, mapping: Row, reverse: bool, scan: Callable, write: Callable | None, work: str, fetch: Callable | None = None, items: DataFrame | None = None, skip_unchanged: bool = False
) -> int | None:
    """Plan and apply one directed pass; rows applied, None if the mapping does not allow it.

    items: the source's snapshot, if it is at hand. skip_unchanged: updates that would change nothing are not sent.
    """
    source, target = mapping.parts[::-1] if reverse else mapping.parts
    if not (source.getAll and target.create and target.update):
        return None
    urls = {r.api: r.baseUrl for r in sides(catalog.mappings().where(F.col("id") == mapping.id), catalog.apis()).collect()}  # two rows
    run = Run.begin(catalog, work, write, mapping_id=mapping.id, reverse=reverse, honours_keys=bool(target.create.honoursKeys))
    counts = Counts()

    read = Observation()
    items = scan(catalog.spark, urls[source.api] + source.getAll.path, source.getAll.method, **paging_of(source.getAll)) if items is None else items
    items = run.keep(items.observe(read, F.count(F.lit(1)).alias("read")), "source")
    counts.read = seen(read)["read"]
    if scan is not rest.scan and (repeated := items.groupBy("ordinal").count().where("count > 1").first()):
        raise ValueError(f"the scan gives ordinal {repeated.ordinal} to several items; answers could not be told apart")
    if catalog.current("in_doubt"):  # items whose create may have been done wait until somebody knows
        doubts = in_doubt(catalog, mapping.id).where(F.col("reverse") == reverse).select("source_id")
        known = keyed_items(items).join(doubts, "source_id", "left_anti")
        items = known.select("ordinal", "item")
    dictionary = F.create_map(*[F.lit(x) for pair in source.fieldMapping.items() for x in pair]) if source.fieldMapping else F.create_map().cast("map<string,string>")

    def apply(items: DataFrame, step: str) -> None:
        pairs = IdMap(catalog, mapping.id).layers(reverse) or directed(id_pairs(catalog, mapping.id), reverse)
        broken = None
        if target.getOne:  # linked items are asked for one by one, in tasks: a list may not show all their properties
            known = lookup_keys(items, pairs)
            asked = known.select("target_id", F.concat(F.lit(urls[target.api]), path_of(target.getOne)).alias("url"), F.lit(target.getOne.method).alias("method"))
            told, bases = Observation(), fetch(asked) if fetch else rest.fetch(asked, errors=True)
            error = F.col("error") if "error" in bases.columns else F.lit(None).cast("string")
            bases = run.keep(bases.withColumn("error", error).observe(told, F.count("error").alias("broken"), F.min("error").alias("first")), f"bases-{step}")
            if seen(told)["broken"]:
                broken = bases.where("error is not null").select("target_id")
                counts.failed += seen(told)["broken"]
                counts.errors.append(seen(told)["first"])
            bases = bases.where("error is null").drop("error")
        else:
            bases = scan(catalog.spark, urls[target.api] + target.getAll.path, target.getAll.method, **paging_of(target.getAll)) if target.getAll else items.limit(0)
        # pairs have one row for each a_id, and what was asked for by key one for each key
        plan = plan_pass(items, bases, pairs, dictionary, unique=bool(target.getOne) and not reverse, digests=skip_unchanged)
        if broken is not None:  # their changes would be laid over an empty base
            plan = plan.join(broken, "target_id", "left_anti")
        if not (target.getOne or target.getAll):  # without a way to see the target, linked items cannot be updated
            plan = plan.where(F.col("action") == CREATE)
        if skip_unchanged:
            told = Observation()
            sent = latest(catalog.read("sent").where((F.col("mapping_id") == mapping.id) & (F.col("reverse") == reverse)), ["mapping_id", "reverse", "target_id"])
            plan = with_noop(plan, sent).observe(told, F.count_if("is_noop").alias("unchanged")).where(~F.col("is_noop"))
            plan = run.keep(plan.withColumn("payload", F.to_json("payload")), f"plan-{step}")
            counts.unchanged += seen(told)["unchanged"]
            digests = plan.where(F.col("action") == UPDATE).select("ordinal", "target_id", "payload_digest", "base_digest")
        run.send(requests_of(plan, urls[target.api], target.create, target.update, mapping.id, f"{run.run_id}-{step}"), step, counts)
        if skip_unchanged:
            run.note_sent(digests, step)

    first, later = repeats(items)
    apply(first, "first")
    if not counts.failed and not later.isEmpty():
        apply(later, "later")
    run.end(counts)
    if counts.failed:
        raise SyncError(f"{counts.failed} calls failed, among them: {min(counts.errors)}")
    return counts.applied


def recover(catalog: Catalog, work: str, write: Callable | None = None) -> dict[str, dict]:
    """Finishes the runs that were cut off; per run what was done and what stays in doubt."""
    report = {}
    for run in unfinished(catalog, work, write):
        found = run.finish()
        if found is None:
            continue
        report[run.run_id] = {"mapping": run.intent["mapping_id"], "applied": found.applied, "failed": found.failed, "in_doubt": found.in_doubt}
    return report


def run_round(catalog: Catalog, scan: Callable = rest.scan, write: Callable | None = None, work: str | None = None, fetch: Callable | None = None, skip_unchanged: bool = False) -> dict[str, str | list | dict]:
    """Both passes of every mapping; per mapping the rows applied by each pass, or the error that ended it; under "recovered" the runs that were finished first."""
    work = work or f"{catalog.root}/work"
    report: dict[str, str | list | dict] = {}
    if recovered := recover(catalog, work, write):
        report["recovered"] = recovered
    for mapping in catalog.mappings().collect():  # the catalog of mappings, not records
        report[mapping.id] = _both(catalog, mapping, scan, write, work, fetch, skip_unchanged=skip_unchanged)
    return report


def _both(catalog: Catalog, mapping: Row, scan: Callable, write: Callable | None, work: str, fetch: Callable | None, items: DataFrame | None = None, skip_unchanged: bool = False) -> str | list:
    try:
        IdMap(catalog, mapping.id).refresh()
        return [run_pass(catalog, mapping, reverse, scan, write, work, fetch, None if reverse else items, skip_unchanged) for reverse in (False, True)]
    except Exception as error:
        return f"{type(error).__name__}: {str(error)[:300]}"


def snapshot_stream(catalog: Catalog, mapping_id: str, checkpoint: str, seconds: int = 5, on_round: Callable | None = None, work: str | None = None, **how):
    """A streaming query of one mapping: each batch is a snapshot of its first side, synced to the second and back.

    The snapshot's number and rows outlast a stop: a batch that was not committed is run again with the same rows.
    """
    work = work or f"{catalog.root}/work/{mapping_id}"
    mapping = catalog.mappings().where(F.col("id") == mapping_id).first()
    source = mapping.parts[0]
    if not source.getAll:
        raise ValueError(f"the first side of {mapping_id} cannot be listed")
    base = {r.side: r.baseUrl for r in sides(catalog.mappings().where(F.col("id") == mapping_id), catalog.apis()).collect()}[0]

    def each(batch: DataFrame, number: int) -> None:
        recover(catalog, work, how.get("write"))
        current = catalog.mappings().where(F.col("id") == mapping_id).first()
        items = batch.select("ordinal", record(F.col("item_json")).alias("item"))
        report = _both(catalog, current, how.get("scan", rest.scan), how.get("write"), work, how.get("fetch"), items, how.get("skip_unchanged", False))
        if on_round:
            on_round(number, report)

    catalog.spark.dataSource.register(rest.RestCollection)
    options = {"url": base + source.getAll.path, "method": source.getAll.method, "snapshots": f"{checkpoint}/snapshots", **paging_of(source.getAll)}
    snapshots = catalog.spark.readStream.format("rest_collection").options(**{k: v for k, v in options.items() if v is not None}).load()
    return snapshots.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/query").trigger(processingTime=f"{seconds} seconds").start()


def run_stream(catalog: Catalog, checkpoint: str, seconds: int = 5, available_now: bool = False, on_round: Callable | None = None, **how):
    """A streaming query that runs a round per micro-batch."""

    def each(_: DataFrame, batch: int) -> None:
        report = run_round(catalog, **how)
        if on_round:
            on_round(batch, report)

    ticks = catalog.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = ticks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()
