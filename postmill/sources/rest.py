"""A Spark data source of provider pages over HTTP, and clients for mutations and models.

    spark.dataSource.register(MailPages)
    spark.read.format("mail_pages").option("kind", "gmail_list").option("accounts", "a,b").option("base_url", ...).load()

One partition for each account, as pages are chained by tokens; its rows are landed as they come, and parsed by
postmill.sources.pages. Tokens are options, never columns.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

from postmill.schema import LANDED, ProviderError
from postmill.sources.pages import READ_RETRY, WRITE_RETRY, with_retry

# Page sizes, headers asked for, fields of the delta, and the most requests of one batch.
PAGE_SIZE = 500
METADATA_HEADERS = ("From", "Subject", "List-Unsubscribe")
DELTA_FIELDS = "id,conversationId,subject,bodyPreview,from,receivedDateTime,parentFolderId,isRead,categories"
BATCH = 20
#: Requests that one task has in flight: metadata, delta pages, embeddings.
FETCHES, EMBEDDINGS = 10, 8
#: Delta pages of one account in one batch of a stream.
DELTA_PAGES = 200
#: Seconds: pages and mutations, embeddings, completions.
TIMEOUT, EMBED_TIMEOUT, ASK_TIMEOUT = 30, 30, 120


def request(url: str, token: str | None = None, body: object = None, method: str | None = None, timeout: float = TIMEOUT) -> str:
    """The answer's text; ProviderError for a status that isn't one of success."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    r = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), headers, method=method)
    try:
        with urllib.request.urlopen(r, timeout=timeout) as answer:
            return answer.read().decode()
    except urllib.error.HTTPError as e:
        raise ProviderError(e.code, e.read().decode(errors="replace")) from e


def in_flight(call: Callable, items: Iterable, most: int) -> Iterator:
    """call(x) for each item, in the items' order, with at most `most` calls going on or waiting to be taken.

    No item is taken before there is room for it. The first error ends the iteration where that item's turn comes; calls
    that haven't begun are cancelled then, or when the iterator is closed.
    """
    with ThreadPoolExecutor(most) as pool:
        going: deque = deque()
        try:
            for x in items:
                if len(going) == most:
                    yield going.popleft().result()
                going.append(pool.submit(call, x))
            while going:
                yield going.popleft().result()
        finally:
            for f in going:
                f.cancel()


class _Account(InputPartition):
    def __init__(self, account: str, start: str | None = None):
        super().__init__(account)
        self.account, self.start = account, start


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [_Account(a) for a in self.options["accounts"].split(",")]

    def token(self, account: str) -> str | None:
        return self.options.get(f"token.{account.lower()}") or self.options.get("token")

    def first(self, start: str | None = None) -> str:
        kind, o = self.options["kind"], self.options
        query = {"gmail_list": {"maxResults": PAGE_SIZE}, "gmail_history": {"startHistoryId": start or o.get("start", "1"), "maxResults": PAGE_SIZE}, "graph_delta": {"$select": DELTA_FIELDS}}[kind]
        path = {"gmail_list": "/messages", "gmail_history": "/history", "graph_delta": "/me/messages/delta"}[kind]
        return o.get("cursor") if kind == "graph_delta" and o.get("cursor") else f"{o['base_url']}{path}?{urllib.parse.urlencode(query | ({'pageToken': o['cursor']} if o.get('cursor') else {}))}"

    def after(self, url: str, page: dict) -> str | None:
        if self.options["kind"] == "graph_delta":
            return page.get("@odata.nextLink")
        token = page.get("nextPageToken")
        if not token:
            return None
        parts = urllib.parse.urlsplit(url)
        query = [(k, v) for k, v in urllib.parse.parse_qsl(parts.query) if k != "pageToken"]
        return urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode([*query, ("pageToken", token)])))

    def read(self, partition):
        url, n = self.first(partition.start), 0
        gmail = self.options["kind"] != "graph_delta"
        token = self.token(partition.account)
        while url:
            body = with_retry(lambda url=url: request(url.replace("{account}", partition.account), token), READ_RETRY, rate_limited_403=gmail)
            yield partition.account, self.options["kind"], n, body
            url, n = self.after(url, json.loads(body)), n + 1


class _HistoryFeed(_Reader, DataSourceStreamReader):
    """A mailbox's history as a stream: offsets are the accounts' history ids, and pages from one on can be read again.

    A batch may see changes beyond its end, as the provider's history has no end to ask for; the next batch reads them
    again, which changes nothing where pages are folded (streaming.sync).
    """

    def __init__(self, options):
        _Reader.__init__(self, options)
        if options["kind"] != "gmail_history":
            raise ValueError(f"{options['kind']} can't be read as a stream")

    def accounts(self) -> list[str]:
        return self.options["accounts"].split(",")

    def initialOffset(self) -> dict:
        return {a: self.options.get(f"start.{a.lower()}", self.options.get("start", "1")) for a in self.accounts()}

    def latestOffset(self, *_) -> dict:
        now = {}
        for a, start in self.initialOffset().items():
            url = self.first(start).replace(f"maxResults={PAGE_SIZE}", "maxResults=1").replace("{account}", a)
            own = json.loads(with_retry(lambda url=url, a=a: request(url, self.token(a)), READ_RETRY)).get("historyId", start)
            now[a] = str(own)
        return now

    def partitions(self, start: dict, end: dict):
        return [_Account(a, str(start[a])) for a in self.accounts() if str(start[a]) != str(end[a])]

    def commit(self, end: dict) -> None:
        pass


class _DeltaFeed(_Reader, SimpleDataSourceStreamReader):
    """A mailbox's delta as a stream: offsets are the links that each account's walk goes on at, and its next page's number.

    The driver only follows the links; the rows are links too (kind graph_link), whose pages delta_pages() gets in the
    tasks. A batch that is run again walks from its first link to its last one. A link that has expired (410) gives a row
    of kind graph_reset, and the walk begins anew behind it.
    """

    def initialOffset(self) -> dict:
        return {a: {"link": self.options.get(f"cursor.{a.lower()}") or self.first().replace("{account}", a), "page": 0} for a in self.options["accounts"].split(",")}

    def walk(self, account: str, offset: dict, most: int, last: dict | None = None) -> tuple[list[tuple], dict]:
        """Rows from an offset on and the offset behind them: up to the delta's end, `most` pages, or the offset `last`."""
        link, n, rows, token = offset["link"], offset["page"], [], self.token(account)
        while len(rows) < most and (last is None or n < last["page"]):
            try:
                page = json.loads(with_retry(lambda link=link: request(link, token), READ_RETRY, rate_limited_403=False))
            except ProviderError as e:
                if e.status != 410:
                    raise
                rows, link, n = [*rows, (account, "graph_reset", n, None)], self.first().replace("{account}", account), n + 1
                continue
            end = page.get("@odata.deltaLink")
            if page.get("value") or not end:
                rows, n = [*rows, (account, "graph_link", n, link)], n + 1
                link = end or page["@odata.nextLink"]
            if end:
                break
        return rows, {"link": link, "page": n}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        most, accounts = int(self.options.get("pages_per_batch", DELTA_PAGES)), list(start)
        walks = list(in_flight(lambda a: self.walk(a, start[a], most), accounts, FETCHES))
        return iter([r for rows, _ in walks for r in rows]), {a: end for a, (_, end) in zip(accounts, walks, strict=True)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for a in start for r in self.walk(a, start[a], 1 << 62, end[a])[0]])

    def commit(self, end: dict) -> None:
        pass


def delta_pages(links: DataFrame, token: str | None = None, most: int = FETCHES) -> DataFrame:
    """LANDED pages (kind graph_delta) of rows of links as a delta stream gives them; graph_reset rows stay as they are."""

    def run(batches):
        import pyarrow as pa

        get = lambda link: None if link is None else with_retry(lambda: request(link, token), READ_RETRY, rate_limited_403=False)
        for b in batches:
            bodies = list(in_flight(get, b.column(3).to_pylist(), most))
            kinds = ["graph_delta" if k == "graph_link" else k for k in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(kinds, pa.string()), b.column(2), pa.array(bodies, pa.string())], names=b.schema.names)

    return links.select("account_id", "kind", "page", "body").mapInArrow(run, LANDED)


class MailPages(DataSource):
    """Options: kind (gmail_list, gmail_history, graph_delta), base_url (may hold {account}), accounts, token or
    token.<account>, start or, for a stream, start.<account> (history id), cursor or, for a stream, cursor.<account> (page
    token or delta link), pages_per_batch (of an account, in a delta stream)."""

    @classmethod
    def name(cls):
        return "mail_pages"

    def schema(self):
        return LANDED

    def reader(self, schema):
        return _Reader(dict(self.options))

    def streamReader(self, schema):
        return super().streamReader(schema) if self.options["kind"] == "graph_delta" else _HistoryFeed(dict(self.options))

    def simpleStreamReader(self, schema):
        return _DeltaFeed(dict(self.options))


def fetch_metadata(ids: DataFrame, base_url: str, token: str, most: int = FETCHES, skip_gone: bool = True) -> DataFrame:
    """(account_id, body) of each message of ids (account_id, provider_msg_id), `most` requests of a task at once.

    A message that is gone gives no row or, without skip_gone, ends the job as any other error does.
    """
    query = urllib.parse.urlencode([("format", "METADATA"), *(("metadataHeaders", h) for h in METADATA_HEADERS)])

    def get(row: tuple[str, str]) -> tuple[str, str] | None:
        account, message = row
        try:
            return account, with_retry(lambda: request(f"{base_url.replace('{account}', account)}/messages/{message}?{query}", token))
        except ProviderError as e:
            if e.status != 404 or not skip_gone:
                raise
            return None

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [r for r in in_flight(get, zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), most) if r]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["account_id", "body"])

    return ids.select("account_id", "provider_msg_id").mapInArrow(run, "account_id string, body string")


class GmailMutator:
    """call(action, ids) for actions.execute(), by label changes."""

    # Labels that each action adds and removes.
    LABELS = {"archive": ([], ["INBOX"]), "trash": (["TRASH"], ["INBOX"]), "mark_read": ([], ["UNREAD"])}

    def __init__(self, base_url: str, token: str):
        self.base_url, self.token = base_url, token

    def post(self, path: str, body: object = None) -> None:
        with_retry(lambda: request(f"{self.base_url}{path}", self.token, {} if body is None else body, "POST"), WRITE_RETRY, rate_limited_403=False)

    def modify(self, ids: list[str], add: list[str], remove: list[str]) -> None:
        self.post("/messages/batchModify", {"ids": ids, "addLabelIds": add, "removeLabelIds": remove})

    def __call__(self, action: str, ids: list[str]) -> None:
        self.modify(ids, *self.LABELS[action])

    def add_labels(self, message: str, labels: list[str]) -> None:
        self.modify([message], labels, [])

    def delete(self, ids: list[str]) -> None:
        self.post("/messages/batchDelete", {"ids": ids})

    def untrash(self, message: str) -> None:
        self.post(f"/messages/{message}/untrash")


class GraphMutator:
    """call(action, ids) by batches of moves and read marks; labels can't be changed there."""

    # Folders.
    FOLDERS = {"archive": "archive", "trash": "deleteditems"}

    def __init__(self, base_url: str, token: str):
        self.base_url, self.token = base_url, token

    def batch(self, ids: list[str], method: str, suffix: str, body: dict | None) -> None:
        for i in range(0, len(ids), BATCH):
            parts = [{"id": str(k + 1), "method": method, "url": f"/me/messages/{m}{suffix}"} | ({"headers": {"Content-Type": "application/json"}, "body": body} if body else {}) for k, m in enumerate(ids[i : i + BATCH])]
            with_retry(lambda parts=parts: request(f"{self.base_url}/$batch", self.token, {"requests": parts}, "POST"), WRITE_RETRY, rate_limited_403=False)

    def __call__(self, action: str, ids: list[str]) -> None:
        if action == "mark_read":
            self.batch(ids, "PATCH", "", {"isRead": True})
        else:
            self.batch(ids, "POST", "/move", {"destinationId": self.FOLDERS[action]})

    def delete(self, ids: list[str]) -> None:
        self.batch(ids, "DELETE", "", None)

    def add_labels(self, message: str, labels: list[str]) -> None:
        raise NotImplementedError("labels can't be changed there")

    def untrash(self, message: str) -> None:
        self.batch([message], "POST", "/move", {"destinationId": "inbox"})


def embedder(base_url: str, most: int = EMBEDDINGS, retry: tuple = READ_RETRY):
    """make_client for classify.embed_missing(): a vector for each text, in order, `most` requests at once; an empty one is
    an error. An iterator, so that vectors before a failing text can be kept."""

    def one(text: str) -> list[float]:
        v = json.loads(with_retry(lambda: request(f"{base_url}/embedding", body={"content": text}, timeout=EMBED_TIMEOUT), retry))["embedding"]
        v = (v[0] if v else []) if v and isinstance(v[0], list) else v
        if not v:
            raise ProviderError(200, "empty embedding")
        return v

    return lambda: lambda texts: in_flight(one, texts, most)


def completer(base_url: str, schema: dict):
    """make_client for classify.classify(): the model's answer under a JSON schema, at temperature 0."""

    def make():
        def ask(prompt):
            body = {"prompt": prompt, "n_predict": 256, "temperature": 0, "cache_prompt": True, "json_schema": schema}
            answer = json.loads(request(f"{base_url}/completion", body=body, timeout=ASK_TIMEOUT))["content"].strip()
            if not answer:
                raise ProviderError(200, "empty completion")
            return answer

        return ask

    return make
