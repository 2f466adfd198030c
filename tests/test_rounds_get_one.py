"""Bases of linked items come from getOne where the target has it."""

import pytest
from pyspark.sql import functions as F
from test_engine import ISSUES, TICKETS

from weftline.functions.records import record
from weftline.plans.api import add_mapping, register_spec
from weftline.sources import rest
from weftline.sources.catalog import Catalog
from weftline.streaming.rounds import run_round

ONE = '"/issues/{id}": {"get": {"parameters": [{"name": "id", "in": "path", "required": true}], "responses": {}}, '


@pytest.mark.parametrize("listed", [True, False])
def test_linked_items_are_updated_on_what_get_one_returns(spark, tmp_path, listed):
    catalog = Catalog(spark, str(tmp_path))
    a, b = register_spec(catalog, TICKETS, "http://t"), register_spec(catalog, ISSUES.replace('"/issues/{id}": {', ONE), "http://i")
    first = {"getAll": "GET /tickets", "create": "POST /tickets", "update": "PUT /tickets/{id}"}
    second = {"getOne": "GET /issues/{id}", "create": "POST /issues", "update": "PUT /issues/{id}"} | ({"getAll": "GET /issues"} if listed else {})
    mapping = add_mapping(catalog, "issue", {a: first, b: second})
    catalog.append("id_map", spark.createDataFrame([(mapping, '"t1"', '"i1"', 1)], "mapping_id string, a_id string, b_id string, seq long"))
    rows = {"http://t/tickets": '{"id": "t1", "name": "N"}', "http://i/issues": '{"id": "i1"}'}
    scan = lambda spark, url, method="GET": spark.createDataFrame([(0, rows[url])], "ordinal long, j string").select("ordinal", record(F.col("j")).alias("item"))
    asked, sent = [], []

    def fetch(requests):
        asked.extend(r.url for r in requests.collect())
        return requests.select(F.lit(0).cast("long").alias("ordinal"), "target_id", record(F.lit('{"id": "i1", "only": "here"}')).alias("item"))

    def write(requests):
        sent.extend(r.body for r in requests.where("url like 'http://i/%'").collect())
        none = F.lit(None).cast("string")
        return requests.select("ordinal", "source_id", none.alias("response_id_json"), none.alias("error"), F.lit(False).alias("failed"))

    report = run_round(catalog, scan=scan, write=write, fetch=fetch)
    assert report[mapping][0] == 1 and asked == ["http://i/issues/i1"]
    assert len(sent) == 1 and '"only":"here"' in sent[0].replace(" ", "")


def test_a_linked_item_that_is_gone_is_updated_on_an_empty_base(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class One(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_GET(self):
            self.send_response(404 if self.path.endswith("gone") else 500 if self.path.endswith("broken") else 200)
            self.end_headers()
            self.wfile.write(b'{"id": "here"}')

    server = ThreadingHTTPServer(("127.0.0.1", 0), One)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = lambda *ids: spark.createDataFrame([(i, f"http://127.0.0.1:{server.server_port}/{i}", "get") for i in ids], "target_id string, url string, method string")
    assert [r.target_id for r in rest.fetch(ask("here", "gone")).collect()] == ["here"]
    with pytest.raises(Exception, match="500"):
        rest.fetch(ask("broken")).collect()
    server.shutdown()
