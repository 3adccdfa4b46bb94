"""The page source, mutators and model clients against a local server."""

import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from postmill.schema import LANDED, TABLES, EngineError, ProviderError
from postmill.operators import store
from postmill.sources import pages, rest
from postmill.streaming import sync


@pytest.fixture
def server():
    seen, fail = [], {}

    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            at, size = urlsplit(self.path), int(self.headers.get("Content-Length") or 0)
            body = json.loads(self.rfile.read(size) or "null") if size else None
            seen.append((self.command, at.path, parse_qs(at.query), body, self.headers.get("Authorization")))
            status, out = 200, {}
            if fail.get(at.path):
                fail[at.path] -= 1
                status = 503
            elif at.path.endswith("/messages"):
                token = parse_qs(at.query).get("pageToken")
                out = {"messages": [{"id": "m2", "threadId": "t"}]} if token else {"messages": [{"id": "m1", "threadId": "t"}], "nextPageToken": "P2"}
            elif at.path.endswith("/history"):
                start, token = int(parse_qs(at.query)["startHistoryId"][0]), parse_qs(at.query).get("pageToken")
                records = [{"id": str(i), "messagesAdded": [{"message": {"id": f"m{i}"}}]} for i in range(start + 1, 8)]
                out = {"history": records[:2], "historyId": "7", "nextPageToken": "N"} if not token else {"history": records[2:], "historyId": "7"}
            elif at.path.endswith("/delta"):
                out = {"value": [], "@odata.nextLink": f"http://{self.headers['Host']}/next"} if at.path != "/next" else {}
            elif at.path == "/next":
                out = {"value": [{"id": "q"}], "@odata.deltaLink": "d"}
            elif at.path.endswith("/messages/gone"):
                status = 404
            elif "/messages/m" in at.path and self.command == "GET":
                out = {"id": at.path.rpartition("/")[2], "internalDate": "5", "historyId": "6"}
            elif at.path == "/embedding":
                out = {"embedding": [[1.0, 2.0]] if body["content"] == "n" else [] if body["content"] == "e" else [3.0]}
            elif at.path == "/completion":
                out = {"content": ' {"category": "work"} '}
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        do_GET = do_POST = answer

        def log_message(self, *a):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen, fail
    http.shutdown()


def test_pages(spark, server):
    url, seen, fail = server
    fail["/b/messages"] = 1
    spark.dataSource.register(rest.MailPages)
    df = spark.read.format("mail_pages").options(kind="gmail_list", base_url=url + "/{account}", accounts="a,b", token="T").load()
    got = sorted(tuple(r) for r in pages.listed(df).select("account_id", "id", "thread_id").collect())
    assert got == [("a", "m1", "t"), ("a", "m2", "t"), ("b", "m1", "t"), ("b", "m2", "t")]
    assert {s[4] for s in seen} == {"Bearer T"} and seen[0][2]["maxResults"] == ["500"] and len([s for s in seen if s[1] == "/b/messages"]) == 3
    delta = spark.read.format("mail_pages").options(kind="graph_delta", base_url=url, accounts="c").load()
    assert [r["page"] for r in delta.orderBy("page").collect()] == [0, 1]
    ids = spark.createDataFrame([("a", "m7"), ("a", "gone")], "account_id string, provider_msg_id string")
    assert [r["provider_msg_id"] for r in pages.gmail_messages(rest.fetch_metadata(ids, url, "T")).collect()] == ["m7"]


def test_history_as_a_stream(spark, server, tmp_path):
    """Pages from an account's offset on, into the tables; a second run has nothing left to read."""
    url, seen, _ = server
    spark.dataSource.register(rest.MailPages)

    def run():
        feed = spark.readStream.format("mail_pages").options(**{"kind": "gmail_history", "base_url": url + "/{account}", "accounts": "a,b", "start": "3", "start.b": "6"}).load()
        sync.run(spark, feed, str(tmp_path / "t"), str(tmp_path / "c"), lambda ids: rest.fetch_metadata(ids, url, "T"), buckets=2)
        tables = store.Tables(spark, str(tmp_path / "t"), 2)
        return sorted((r["account_id"], r["provider_msg_id"], r["internal_date"]) for r in tables.read("messages").collect()), {r["account_id"]: (r["phase"], r["last_history_id"]) for r in tables.read("sync_state").collect()}

    want = [("a", f"m{i}", 5) for i in (4, 5, 6, 7)] + [("b", "m7", 5)], {"a": ("incremental", 7), "b": ("incremental", 7)}
    assert run() == want
    n = len([s for s in seen if "pageToken" in s[2]])
    assert run() == want and len([s for s in seen if "pageToken" in s[2]]) == n == 2
    lists = spark.createDataFrame([("a", "gmail_list", 0, json.dumps({"messages": [{"id": "m9", "threadId": "t"}]}))], LANDED)
    lists.write.json(f"{tmp_path}/lists")
    sync.run(spark, f"{tmp_path}/lists", str(tmp_path / "t"), str(tmp_path / "c2"), lambda ids: rest.fetch_metadata(ids, url, "T"), buckets=2)  # a new checkpoint over old tables
    tables = store.Tables(spark, str(tmp_path / "t"), 2)
    assert sorted(r["provider_msg_id"] for r in tables.read("messages").filter("account_id = 'a'").collect()) == ["m4", "m5", "m6", "m7", "m9"]
    with pytest.raises(Exception, match="as a stream"):
        spark.readStream.format("mail_pages").options(kind="gmail_list", base_url=url, accounts="a").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "d")).start().awaitTermination()


def test_mutators(server):
    url, seen, _ = server
    m = rest.GmailMutator(url, "T")
    m("archive", ["x", "y"])
    m.untrash("x")
    assert seen[0][1:4] == ("/messages/batchModify", {}, {"ids": ["x", "y"], "addLabelIds": [], "removeLabelIds": ["INBOX"]}) and seen[1][1] == "/messages/x/untrash"
    del seen[:]
    g = rest.GraphMutator(url, "T")
    g("trash", [f"i{k}" for k in range(45)])
    assert [len(s[3]["requests"]) for s in seen] == [20, 20, 5] and seen[2][3]["requests"][0]["body"] == {"destinationId": "deleteditems"}
    g("mark_read", ["z"])
    assert seen[3][3]["requests"] == [{"id": "1", "method": "PATCH", "url": "/me/messages/z", "headers": {"Content-Type": "application/json"}, "body": {"isRead": True}}]
    with pytest.raises(NotImplementedError):
        g.add_labels("z", ["l"])


def test_models(server):
    url, seen, _ = server
    embed = rest.embedder(url)()
    assert list(embed(["n", "f"])) == [[1.0, 2.0], [3.0]]
    with pytest.raises(ProviderError):
        list(embed(["e"]))
    assert rest.completer(url, {"type": "object"})()("p") == '{"category": "work"}' and seen[-1][3]["n_predict"] == 256


def test_in_flight():
    """As many calls as allowed and never more, results in order, nothing taken ahead of its turn, errors where they belong."""
    going, most, taken, lock = set(), [0], [], threading.Lock()

    def call(x):
        with lock:
            going.add(x)
            most[0] = max(most[0], len(going))
        time.sleep(0.02 if x < 7 else 0.002 * (x % 5))
        with lock:
            going.discard(x)
        if x == 30:
            raise ValueError(x)
        return -x

    def items():
        for x in range(100):
            taken.append(x)
            yield x

    got = []
    with pytest.raises(ValueError, match="30"):
        for y in rest.in_flight(call, items(), 7):
            got.append(y)
            assert len(taken) <= len(got) + 7
    assert got == [-x for x in range(30)] and most[0] == 7 and len(taken) < 40
    assert list(rest.in_flight(call, [], 3)) == [] and list(rest.in_flight(call, [1, 2], 9)) == [-1, -2]


def test_metadata_in_flight(spark, server):
    url, seen, _ = server
    ids = spark.createDataFrame([("a", f"m{i}") for i in range(40)] + [("a", "gone")], "account_id string, provider_msg_id string").coalesce(1)
    got = pages.gmail_messages(rest.fetch_metadata(ids, url, "T", 4)).select("provider_msg_id").collect()
    assert [r[0] for r in got] == [f"m{i}" for i in range(40)]
    with pytest.raises(Exception, match="404"):
        rest.fetch_metadata(ids, url, "T", skip_gone=False).collect()


def test_embeddings_before_a_failing_call_are_kept(spark, server, tmp_path):
    url, seen, fail = server
    rows = [("a", f"m{i:02}", "e" if i == 13 else f"s{i}") for i in range(20)]
    from postmill.functions.text import embedding_text
    from postmill.operators.classify import embed_pending

    messages = spark.createDataFrame(rows, "account_id string, provider_msg_id string, subject string").selectExpr("*", "cast(null as string) sender", "cast(null as string) snippet", "cast(null as long) internal_date").coalesce(1)
    bad = messages.filter("subject = 'e'").select(embedding_text(F.col("subject"), F.col("sender"), F.col("snippet"))).first()[0]
    def client():
        def one(text):
            if text == bad and os.path.exists(f"{tmp_path}/broken"):
                raise ProviderError(500)
            return [float(len(text))]

        return lambda texts: rest.in_flight(one, texts, 3)

    (tmp_path / "broken").write_text("")
    at, path = F.lit(None).cast("timestamp"), f"file://{tmp_path}/embeddings"
    with pytest.raises(EngineError, match="1 calls failed"):
        embed_pending(messages, path, client, "v", 1, at)
    kept = spark.read.parquet(path).count()
    assert 0 < kept < 20
    (tmp_path / "broken").unlink()
    assert embed_pending(messages, path, client, "v", 1, at) == 20 - kept
    assert embed_pending(messages, path, client, "v", 1, at) == 0
    assert spark.read.parquet(path).select("provider_msg_id").distinct().count() == spark.read.parquet(path).count() == 20
    with pytest.raises(EngineError, match="DimensionError"):
        embed_pending(messages.withColumn("provider_msg_id", F.lit("z")).limit(1), path, client, "v", 2, at)


@pytest.fixture
def delta():
    """A provider whose delta has pages of one message each; `down` makes a page fail, `expired` makes a link so."""
    state = {"items": [f"q{i}" for i in range(6)], "down": set(), "expired": set(), "asked": [], "walk": 0}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urlsplit(self.path)
            k = int(parse_qs(at.query).get("k", ["0"])[0])
            state["asked"].append(k)
            host = f"http://{self.headers['Host']}{at.path}"
            if k in state["down"] or k in state["expired"]:
                self.send_response(503 if k in state["down"] else 410)
                self.end_headers()
                return
            items = state["items"]
            out = {"value": [{"id": items[k], "subject": f"s{k}"}] if k < len(items) else []}
            out["@odata.nextLink" if k + 1 < len(items) else "@odata.deltaLink"] = f"{host}?k={min(k + 1, len(items))}"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *a):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", state
    http.shutdown()


def test_delta_as_a_stream(spark, delta, tmp_path, monkeypatch):
    """Each page once, whatever fails between pages; a new link goes on where the last ended; an expired one begins anew."""
    url, state = delta
    spark.dataSource.register(rest.MailPages)

    def run():
        links = spark.readStream.format("mail_pages").options(kind="graph_delta", base_url=url, accounts="a,b", pages_per_batch="4").load()
        query = rest.delta_pages(links).writeStream.format("parquet").option("path", f"{tmp_path}/landed").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="100 milliseconds").start()
        try:
            deadline, calm = time.time() + 60, 0
            while time.time() < deadline and calm < 3 and query.exception() is None:
                time.sleep(0.3)
                calm = calm + 1 if query.lastProgress and query.lastProgress["numInputRows"] == 0 else 0
            if query.exception():
                raise query.exception()
        finally:
            query.stop()
        return spark.read.schema(LANDED).parquet(f"file://{tmp_path}/landed")

    state["down"] = {5}  # behind the first batch's pages
    with pytest.raises(Exception, match="503"):
        run()
    first = spark.read.schema(LANDED).parquet(f"file://{tmp_path}/landed").filter("account_id = 'a'").count()
    assert first == 4
    state["down"] = set()
    landed = run()
    assert sorted((r["account_id"], r["page"]) for r in landed.collect()) == [(a, n) for a in "ab" for n in range(6)]
    state["items"].append("q6")
    landed = run()
    got = pages.graph_changes(landed.filter("kind = 'graph_delta'"))
    assert sorted((r["account_id"], r["page"], r["provider_msg_id"]) for r in got.collect()) == [(a, n, f"q{n}") for a in "ab" for n in range(7)]
    state["expired"], state["items"] = {7}, ["q0", "new"]
    landed = run()
    assert sorted((r["page"], r["kind"]) for r in landed.filter("account_id = 'a' and page > 6").collect()) == [(7, "graph_reset"), (8, "graph_delta"), (9, "graph_delta")]
    keys = "account_id string, provider_msg_id string"
    old = spark.createDataFrame([("a", "q0"), ("a", "q5"), ("c", "x")], keys)
    messages = spark.createDataFrame([], TABLES["messages"]).unionByName(old.withColumn("category", F.lit("work")), allowMissingColumns=True)
    tables = {"messages": messages, "embeddings": old, "message_clusters": old}
    after = sync.apply_delta(tables, landed)
    assert sorted((r["account_id"], r["provider_msg_id"], r["category"]) for r in after["messages"].collect()) == [("a", "new", None), ("a", "q0", "work"), ("b", "new", None), ("b", "q0", None), ("c", "x", "work")]
    assert sorted(map(tuple, after["embeddings"].select("account_id", "provider_msg_id").collect())) == [("a", "q0"), ("c", "x")]
