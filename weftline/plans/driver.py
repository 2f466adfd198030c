"""Queries over the driver's tables, one for each operator of the integration engine, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.paths import fill, identifier
from weftline.functions.records import digest, key_of, properties_of, property_of, record
from weftline.operators import endpoints, keyed, sync
from weftline.operators.graph import graph, sides
from weftline.plans import structure, values
from weftline.plans.matching import joined

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item(**columns: str) -> Column:
    """A record of columns."""
    pairs = [x for name, c in columns.items() for x in (F.lit(name), F.col(c).cast("variant"))]
    return F.create_map(*pairs)


def constant_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


#: Customers are synced to suppliers: every twentieth customer is linked to the supplier seven further.
FIELDS = {"id": "id", "name": "title", "acctbal": "balance"}


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    source = customer.select(F.col("c_custkey").alias("ordinal"), item(id="c_custkey", name="c_name", acctbal="c_acctbal").alias("item"))
    target = supplier.select(F.col("s_suppkey").alias("ordinal"), item(id="s_suppkey", title="s_name", balance="s_acctbal", nation="s_nationkey").alias("item"))
    linked = customer.where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("ordinal"), F.col("c_custkey").cast("string").alias("source_id"), (F.col("c_custkey") + 7).cast("string").alias("target_id"))
    return sync.plan_pass(source, target, linked, constant_map(FIELDS))


def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = properties_of(F.col("payload"), {"id": "bigint", "title": "string", "balance": "double", "nation": "int"})
    plan = _plan(spark, sf_dir).select("source_id", "target_id", "action", "has_base", found.alias("p"))
    return plan.select("source_id", "target_id", "action", "has_base", F.col("p.id").alias("payload_id"), "p.title", "p.balance", "p.nation")


def sync_action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.action_counts(_plan(spark, sf_dir))


def endpoint_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/users/"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", identifier(F.col("event_type"), path).alias("identifier"))


def verb_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    verbs = {"get": F.col("p_name"), "post": F.col("p_brand"), "put": F.when(F.col("p_size") > 10, F.col("p_type"))}
    rows = endpoints.unpivot_verbs(table(spark, sf_dir, "part"), verbs, ["p_partkey"])
    return rows.select("p_partkey", "method", "verb_ordinal", F.col("operation").alias("path"))


def path_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.create_map(F.lit("id"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"))
    names = F.array(F.lit("id"), F.lit("type"), F.lit("other"))
    return table(spark, sf_dir, "events").select("event_id", fill(F.lit("/users/{id}/{type}/{other}/{id}"), names, values).alias("url"))


def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(property_of(record(F.col("props")), "k"), "$", "bigint").alias("k"))


def typed_id_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", key_of(property_of(record(F.col("props")), "k")).alias("id_key"))


def prompt_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = joined(F.col("n_nationkey"), F.col("n_name"), ",")
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(names.alias("names"))


def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_regionkey", "n_name", "n_nationkey")
    return keyed.first_match(nation, ["n_regionkey"], "n_nationkey").select("n_regionkey", F.col("n_name").alias("first_name"))


def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    changes = nation.where("n_nationkey = 3").select("n_nationkey", F.lit("REPLACED").alias("n_name"), "n_regionkey")
    return keyed.replace_by_key(nation, changes, ["n_nationkey"])


def id_map_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the log so far, suppliers of the same keys as the pairs that come to it."""
    pairs = lambda name, key, more, seq: table(spark, sf_dir, name).select(F.col(key).alias("a_id"), (F.col(key) + more).alias("b_id"), F.lit(seq).alias("seq"))
    return keyed.upsert_log(pairs("customer", "c_custkey", 7, 1), pairs("supplier", "s_suppkey", 11, 2), ["a_id"]).select("a_id", "b_id")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    part = lambda c: F.struct(F.col(c).cast("string").alias("api"))
    mappings = nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.array(part("n_regionkey"), part("n_nationkey")).alias("parts"))
    apis = region.select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"))
    return graph(apis, mappings)[1]


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day, which kinds of event occurred, as endpoints that are there or not."""
    there = lambda kind: F.when(F.bool_or(F.col("event_type") == kind), kind).alias(kind)
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return table(spark, sf_dir, "events").groupBy("user_id", day).agg(*[there(k) for k in ("view", "click", "error", "purchase")])


def sync_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).select("user_id", "day", sync.eligible(F.col("view"), F.col("click"), F.col("purchase")).alias("eligible"))


def usefulness_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).select("user_id", "day", sync.useful(F.col("view"), F.col("click"), F.col("error"), F.col("purchase")).alias("is_useful"))


def selected_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    catalog = part.select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit("GET /"), F.col("p_brand")).alias("identifier"))
    chosen = part.where("p_size = 7").select(F.concat(F.lit("GET /"), F.col("p_brand")).alias("identifier"))
    return endpoints.selected(catalog, chosen).select("ordinal", "identifier")


def unmapped_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that no link names; suppliers' keys are linked."""
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    source = customer.select(F.col("c_custkey").alias("ordinal"), item(id="c_custkey", name="c_name").alias("item"))
    key = F.col("s_suppkey")
    links = supplier.select(key.alias("ordinal"), key.cast("string").alias("source_id"), (key + 7).cast("string").alias("target_id"))
    found = properties_of(F.col("item"), {"id": "bigint", "name": "string"})
    return sync.unmapped(source, links).select(found.alias("p")).select(F.col("p.id").alias("c_custkey"), F.col("p.name").alias("c_name"))


def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return keyed.append(nation, spark.createDataFrame([(99, "ATLANTIS", 0)], nation.schema))


def catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as mappings of one part, regions as services."""
    mappings = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.array(F.struct(F.col("n_regionkey").alias("api"))).alias("parts"))
    apis = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("").alias("baseUrl"))
    return sides(mappings, apis).select(F.col("id").alias("n_nationkey"), F.col("name").alias("n_name"), F.col("api_name").alias("r_name"))


def lookup_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The updates of the plan, on bases asked for by key; suppliers answer as the target's getOne."""
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    source = customer.select(F.col("c_custkey").alias("ordinal"), item(id="c_custkey", name="c_name").alias("item"))
    links = customer.select(F.col("c_custkey").alias("ordinal"), F.col("c_custkey").cast("string").alias("source_id"), (F.col("c_custkey") + 7).cast("string").alias("target_id"))
    wanted = sync.lookup_keys(source, links)
    one = supplier.select(F.col("s_suppkey").cast("string").alias("target_id"), F.lit(0).alias("ordinal"), item(id="s_suppkey", title="s_name", nation="s_nationkey").alias("item"))
    bases = wanted.join(one, "target_id")
    found = properties_of(F.col("payload"), {"id": "bigint", "title": "string", "nation": "int"})
    plan = sync.plan_pass(source, bases, links, constant_map({"name": "title"})).select("source_id", "target_id", "action", "has_base", found.alias("p"))
    return plan.select("source_id", "target_id", "action", "has_base", F.col("p.id").alias("payload_id"), "p.title", "p.nation")


def default_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the rating their supplier of the same key has, 0 where there is none."""
    rated = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("rating"))
    return keyed.with_default(table(spark, sf_dir, "customer").select("c_custkey"), rated, ["c_custkey"], {"rating": 0})


def selection_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per region its nations, all selected, none selected, and those with even keys selected."""
    grouped = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        F.sort_array(F.collect_list("n_name")).alias("names"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("n_name", (F.col("n_nationkey") % 2 == 0).alias("on"))))).alias("even"),
    )
    count = lambda on: F.size(endpoints.chosen(endpoints.selection(F.col("names"), on)))
    return grouped.select("n_regionkey", count(True).alias("n_all"), count(False).alias("n_none"), F.array_join(F.sort_array(endpoints.chosen(F.col("even"))), ",").alias("even_names"))


def fold_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per region a dictionary of first letters to nation keys; the last nation of a letter counts."""
    nation = table(spark, sf_dir, "nation").select("n_regionkey", F.substring("n_name", 1, 1).alias("letter"), "n_nationkey", F.col("n_nationkey").alias("ordinal"))
    found = keyed.as_dictionary(nation, ["n_regionkey"], "letter", "n_nationkey", "ordinal")
    pairs = F.transform(F.map_entries("dictionary"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.select("n_regionkey", F.size("dictionary").alias("n_entries"), F.array_join(pairs, ",").alias("entries"))


def default_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.col("p_brand"))
    name = F.when(F.col("p_size") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", endpoints.default_name(name).alias("name"), endpoints.described(brand, F.col("p_type")).alias("description"))


def param_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    parameter = lambda name, place, required, ref: F.struct(ref.alias("ref"), place.alias("in"), required.alias("required"), name.alias("name"), none.alias("description"))
    size = F.col("p_size")
    given = F.array(
        parameter(F.col("p_name"), F.lit("path"), size % 2 == 0, none),
        parameter(F.col("p_brand"), F.when(size > 25, "path").otherwise("query"), F.lit(True), none),
        parameter(F.col("p_type"), F.lit("path"), F.lit(True), F.when(size % 5 == 0, "#/ref")),
    )
    kept = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(endpoints.path_parameters(given)).alias("ordinal", "p"))
    return kept.select("p_partkey", "ordinal", F.col("p.name").alias("name"))


def two_pass_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers over suppliers of the same key, then suppliers, as written, back: the first side's names win."""
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    source = customer.select(F.col("c_custkey").alias("ordinal"), item(id="c_custkey", name="c_name").alias("item"))
    target = supplier.select(F.col("s_suppkey").alias("ordinal"), item(id="s_suppkey", title="s_name", nation="s_nationkey").alias("item"))
    same = F.col("s_suppkey").cast("string")
    links = supplier.select(F.col("s_suppkey").alias("ordinal"), same.alias("a_id"), same.alias("b_id"))
    there = sync.plan_pass(source, target, sync.directed(links, False), constant_map({"name": "title"})).where("action = 'update'")
    written = there.select("ordinal", F.col("payload").alias("item"))
    back = sync.plan_pass(written, source, sync.directed(links, True), constant_map({"title": "name"}))
    return back.select(properties_of(F.col("payload"), {"id": "bigint", "name": "string"}).alias("p"), "action").select("p.id", "p.name", "action")


def noop_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers over suppliers of the same key: updates that change no nation, or were sent before over the same base.

    Suppliers of even keys were sent their customers' nations last time.
    """
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    source = customer.select(F.col("c_custkey").alias("ordinal"), item(id="c_custkey", nation="c_nationkey").alias("item"))
    target = supplier.select(F.col("s_suppkey").alias("ordinal"), item(id="s_suppkey", nation="s_nationkey", title="s_name").alias("item"))
    links = customer.select(F.col("c_custkey").alias("ordinal"), F.col("c_custkey").cast("string").alias("source_id"), F.col("c_custkey").cast("string").alias("target_id"))
    plan = sync.plan_pass(source, target, links, constant_map({"nation": "nation"}), digests=True)
    both = supplier.where("s_suppkey % 2 = 0").join(customer, F.col("s_suppkey") == F.col("c_custkey"))
    sent = both.select(
        F.col("s_suppkey").cast("string").alias("target_id"), digest(item(id="s_suppkey", nation="c_nationkey", title="s_name")).alias("payload_digest"), digest(item(id="s_suppkey", nation="s_nationkey", title="s_name")).alias("base_digest")
    )
    return sync.with_noop(plan, sent).select("source_id", "target_id", "action", "is_noop")


def _shelves(spark: SparkSession, sf_dir: str, reverse: bool) -> DataFrame:
    """Endpoints whose paths are the words of part types, in their order or back to front."""
    words = F.split(F.lower("p_type"), " ")
    path = F.concat_ws("/", F.reverse(words) if reverse else words)
    return table(spark, sf_dir, "part").select(F.concat(F.lit("GET /" if reverse else "GET /parts/"), path).alias("identifier")).distinct()


def endpoint_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.alike(_shelves(spark, sf_dir, False), _shelves(spark, sf_dir, True))
    return found.select(F.col("a").alias("a_identifier"), F.col("b").alias("b_identifier"), F.round("likeness", 6).alias("likeness"))


def field_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of orders among those of a copy that lacks every seventh order and names its fields otherwise."""
    orders = table(spark, sf_dir, "orders")
    fields = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    source = orders.select(item(**{c: c for c in fields}).alias("item"))
    target = orders.where("o_orderkey % 7 <> 0").select(item(**{f"f{i}": c for i, c in enumerate(reversed(fields))}).alias("item"))
    return values.matched_fields(source, target).select(F.col("a").alias("source_field"), F.col("b").alias("target_field"))


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    sync_plan, sync_action_counts, endpoint_identifier, verb_unpivot, path_template, json_field, typed_id_key, prompt_concat, first_match, replace_by_key, id_map_upsert,
    graph_edges, sync_eligibility, usefulness_rule, selected_endpoints, unmapped_source, append_rows, catalog_join, default_fallback, param_filter, two_pass_round,
    lookup_base, default_row, selection_maps, fold_dictionary, noop_updates, endpoint_likeness, field_matching,
]

_PLAN_SQL = """
WITH id_map AS (
  SELECT c_custkey AS source_id, c_custkey + 7 AS target_id FROM customer WHERE c_custkey % 20 = 0
), planned AS (
  SELECT c.c_custkey, c.c_name, c.c_acctbal, m.target_id, s.s_suppkey, s.s_nationkey
  FROM customer c LEFT JOIN id_map m ON c.c_custkey = m.source_id LEFT JOIN supplier s ON s.s_suppkey = m.target_id
)
"""

_FLAGS_SQL = """
WITH flags AS (
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c, bool_or(event_type = 'error') AS e,
         bool_or(event_type = 'purchase') AS p
  FROM events GROUP BY ALL
)
"""

ORACLES: dict[str, str] = {
    "sync_plan": _PLAN_SQL + """
SELECT c_custkey::VARCHAR AS source_id, target_id::VARCHAR AS target_id,
       CASE WHEN target_id IS NULL THEN 'create' ELSE 'update' END AS action, s_suppkey IS NOT NULL AS has_base,
       s_suppkey AS payload_id, c_name AS title, c_acctbal AS balance, s_nationkey AS nation
FROM planned""",
    "sync_action_counts": _PLAN_SQL + """
SELECT CASE WHEN target_id IS NULL THEN 'create' ELSE 'update' END AS action, count(*) AS n_items,
       count(*) FILTER (target_id IS NOT NULL AND s_suppkey IS NULL) AS n_vanished
FROM planned GROUP BY 1""",
    "endpoint_identifier": "SELECT event_id, upper(event_type) || ' /users/' || user_id AS identifier FROM events",
    "verb_unpivot": """
SELECT p_partkey, 'get' AS method, 0 AS verb_ordinal, p_name AS path FROM part
UNION ALL SELECT p_partkey, 'post', 1, p_brand FROM part
UNION ALL SELECT p_partkey, 'put', 2, p_type FROM part WHERE p_size > 10""",
    "path_template": "SELECT event_id, '/users/' || user_id || '/' || event_type || '/undefined/{id}' AS url FROM events",
    "json_field": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "typed_id_key": "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS id_key FROM events",
    "prompt_concat": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey",
    "first_match": "SELECT n_regionkey, arg_min(n_name, n_nationkey) AS first_name FROM nation GROUP BY n_regionkey",
    "replace_by_key": "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'REPLACED' ELSE n_name END AS n_name, n_regionkey FROM nation",
    "id_map_upsert": """
WITH old AS (SELECT c_custkey AS a_id, c_custkey + 7 AS b_id FROM customer),
     new AS (SELECT s_suppkey AS a_id, s_suppkey + 11 AS b_id FROM supplier)
SELECT coalesce(n.a_id, o.a_id) AS a_id, coalesce(n.b_id, o.b_id) AS b_id FROM old o FULL JOIN new n ON o.a_id = n.a_id""",
    "graph_edges": "SELECT n_nationkey::VARCHAR AS id, n_regionkey::VARCHAR AS src, n_nationkey::VARCHAR AS dst, n_name AS label FROM nation",
    "sync_eligibility": _FLAGS_SQL + "SELECT user_id, day, v AND c AND p AS eligible FROM flags",
    "usefulness_rule": _FLAGS_SQL + "SELECT user_id, day, (v OR c) AND (e OR p) AS is_useful FROM flags",
    "selected_endpoints": """
SELECT p_partkey AS ordinal, 'GET /' || p_brand AS identifier FROM part
WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 7)""",
    "unmapped_source": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "append_rows": "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'ATLANTIS', 0",
    "catalog_join": "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "default_fallback": """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS name,
       CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS description
FROM part""",
    "param_filter": """
WITH kept AS (
  SELECT p_partkey, 0 AS given, p_name AS name FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT p_partkey, 1, p_brand FROM part WHERE p_size > 25
  UNION ALL SELECT p_partkey, 2, p_type FROM part WHERE p_size % 5 <> 0
)
SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY given) - 1)::INTEGER AS ordinal, name FROM kept""",
    "two_pass_round": """
SELECT c_custkey AS id, c_name AS name, 'update' AS action FROM customer JOIN supplier ON c_custkey = s_suppkey
WHERE c_custkey <> 0  -- a link to 0 is none: it would be a create""",
    "lookup_base": """
SELECT c_custkey::VARCHAR AS source_id, (c_custkey + 7)::VARCHAR AS target_id, 'update' AS action, s_suppkey IS NOT NULL AS has_base,
       s_suppkey AS payload_id, c_name AS title, s_nationkey AS nation
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey + 7""",
    "noop_updates": """
SELECT c_custkey::VARCHAR AS source_id, CASE WHEN c_custkey <> 0 THEN c_custkey::VARCHAR END AS target_id, CASE WHEN c_custkey <> 0 THEN 'update' ELSE 'create' END AS action,
       c_custkey <> 0 AND s_suppkey IS NOT NULL AND (c_nationkey = s_nationkey OR s_suppkey % 2 = 0) AS is_noop
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""",
    "endpoint_likeness": r"""
WITH types AS (
  SELECT DISTINCT string_split(lower(p_type), ' ') AS w FROM part
), endpoints AS (
  SELECT 'a' AS side, 'GET /parts/' || array_to_string(w, '/') AS id, list_concat(['parts'], w) AS w FROM types
  UNION ALL SELECT 'b', 'GET /' || array_to_string(list_reverse(w), '/'), list_reverse(w) FROM types
), words AS (
  SELECT side, id, regexp_replace(word, '(\w\w)s$', '\1') AS word, row_number() OVER (PARTITION BY side, id, regexp_replace(word, '(\w\w)s$', '\1')) AS k
  FROM (SELECT side, id, unnest(w) AS word FROM endpoints)
), weights AS (
  SELECT word, ln(((SELECT count(DISTINCT id) FROM words) + 1) / count(DISTINCT id)) AS w FROM words GROUP BY word
), totals AS (
  SELECT side, id, sum(w) AS total FROM words JOIN weights USING (word) GROUP BY ALL
), shared AS (
  SELECT a.id AS a_id, b.id AS b_id, sum(w) AS s FROM words a JOIN words b USING (word, k) JOIN weights USING (word) WHERE a.side = 'a' AND b.side = 'b' GROUP BY ALL
)
SELECT a_id AS a_identifier, b_id AS b_identifier, round(s / (x.total + y.total - s), 6) AS likeness
FROM shared JOIN totals x ON x.side = 'a' AND x.id = a_id JOIN totals y ON y.side = 'b' AND y.id = b_id
WHERE s / (x.total + y.total - s) >= 0.2""",
    "field_matching": """
WITH source AS (
  SELECT DISTINCT field, v FROM (SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus, o_totalprice::VARCHAR AS o_totalprice, o_orderpriority FROM orders)
  UNPIVOT (v FOR field IN (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority))
), target AS (
  SELECT DISTINCT field, v FROM (SELECT o_orderpriority AS f0, o_totalprice::VARCHAR AS f1, o_orderstatus AS f2, o_custkey::VARCHAR AS f3, o_orderkey::VARCHAR AS f4 FROM orders WHERE o_orderkey % 7 <> 0)
  UNPIVOT (v FOR field IN (f0, f1, f2, f3, f4))
), sizes AS (
  SELECT field, count(*) AS n FROM (FROM source UNION ALL FROM target) GROUP BY field
), overlap AS (
  SELECT s.field AS source_field, t.field AS target_field, count(*) AS n_both FROM source s JOIN target t ON s.v = t.v GROUP BY ALL
)
SELECT source_field, target_field FROM overlap JOIN sizes a ON a.field = source_field JOIN sizes b ON b.field = target_field
QUALIFY row_number() OVER (PARTITION BY source_field ORDER BY n_both / (a.n + b.n - n_both) DESC) = 1""",
    "default_row": "SELECT c_custkey, coalesce(s_nationkey, 0) AS rating FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
    "selection_maps": """
SELECT n_regionkey, count(*)::INTEGER AS n_all, 0 AS n_none, coalesce(string_agg(n_name, ',' ORDER BY n_name) FILTER (n_nationkey % 2 = 0), '') AS even_names
FROM nation GROUP BY n_regionkey""",
    "fold_dictionary": """
WITH last AS (SELECT n_regionkey, left(n_name, 1) AS letter, max(n_nationkey) AS v FROM nation GROUP BY 1, 2)
SELECT n_regionkey, count(*)::INTEGER AS n_entries, string_agg(letter || '=' || v, ',' ORDER BY v) AS entries FROM last GROUP BY n_regionkey""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
