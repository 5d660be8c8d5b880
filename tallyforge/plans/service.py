"""A loopback HTTP shell over the active snapshot: GET / (a page), GET /api/catalog, POST /api/query and POST /api/ask.

Over a mart also GET /ask?q= (an answer) and GET /desk?q= (headline figures and a draft to confirm), as pages or, with
format=json, as JSON.
"""

from __future__ import annotations

import json
from functools import cache
from html import escape
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from ..sources.snapshots import SnapshotStore
from . import evaluation, serving
from .ask import ask, draft_note
from .star import Star

MOST_BYTES = 8192
PAGE = """<!doctype html>
<html lang="zh"><meta charset="utf-8"><title>Registrations</title>
<form><input name="q" size="60" maxlength="240" placeholder="2026-01至2026-08 每月登记量"> <button>Ask</button></form>
<p id="about"></p><table id="rows"></table>
<script>
const show = (id, text) => { document.getElementById(id).textContent = text };
fetch("/api/catalog").then(r => r.json()).then(c => show("about", c.error ? c.error.code : c.metric_definition));
document.forms[0].onsubmit = async e => {
  e.preventDefault();
  const sent = {method: "POST", headers: {"Content-Type": "application/json"}, body: JSON.stringify({question: e.target.q.value})};
  const got = await (await fetch("/api/ask", sent)).json(), table = document.getElementById("rows");
  show("rows", got.error ? got.error.code + ": " + got.error.message : "");
  for (const row of got.error ? [] : [got.columns, ...got.rows.map(r => got.columns.map(c => r[c]))])
    row.forEach((v, i, all) => { (i ? table.lastChild : table.insertRow()).insertCell().textContent = v });
};
</script></html>
"""


def strict_json(text: str):
    """JSON without repeated keys, NaN or infinities."""

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise ValueError("duplicate key")
        return dict(items)

    def constant(name):
        raise ValueError(name)

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def run_query(store: SnapshotStore, name: str, given: dict) -> dict:
    found = store.active()
    if found is None:
        raise serving.QueryError("NO_ACTIVE_DATASET", "no snapshot has been published", status=503)
    described, rows = found
    known = serving.catalog(rows)
    checked = serving.prepare(name, given, known)
    frame = serving.BUILDERS[name](rows, checked)
    return {"query_id": name, "parameters": checked, "rows": [r.asDict() for r in frame.collect()], "columns": frame.columns, "source": described["source"], "metric_definition": serving.METRIC}


class Desk:
    """What the pages over a mart show."""

    def __init__(self, spark: SparkSession, star: Star):
        self.spark, self.star = spark, star

    def ask(self, question: str) -> dict:
        return {k: v for k, v in ask(self.spark, self.star, question).items() if k != "frame"}

    def draft(self, question: str) -> dict:
        return draft_note(question, self.ask(question))

    @cache  # noqa: B019  (one desk a server; the mart doesn't change under it)
    def cards(self) -> list[tuple]:
        return evaluation.headlines(self.spark, self.star)

    def page(self, at: str, given: dict[str, list[str]]) -> dict | str:
        """/ask or /desk, as a dict for format=json, else as a page."""
        question = given.get("q", [""])[0].strip()
        found = (self.draft if at == "/desk" else self.ask)(question) if question else {}
        if given.get("format", [""])[0] == "json":
            return found
        cells = lambda values, tag="td": "<tr>" + "".join(f"<{tag}>{escape(str(v))}</{tag}>" for v in values) + "</tr>"
        out = [f'<!doctype html><html lang="zh"><meta charset="utf-8"><title>Registrations</title><form action="{at}"><input name="q" size="60" maxlength="240" value="{escape(question)}"> <button>Ask</button></form>']
        if at == "/desk":
            out.append("<table>" + "".join(map(cells, self.cards())) + "</table>")
        rows = found.get("rows") or found.get("retrieve") or []
        if rows:
            out.append("<table>" + cells(rows[0], "th") + "".join(cells(r.values()) for r in rows) + "</table>")
        rest = {k: v for k, v in found.items() if k not in ("rows", "retrieve") and v not in (None, "", [], {})}
        if rest:
            out.append(f"<pre>{escape(json.dumps(rest, ensure_ascii=False, indent=2, default=str))}</pre>")
        return "".join(out) + "</html>\n"


def server(store: SnapshotStore, port: int = 0, desk: Desk | None = None) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            return

        def reply(self, status: int, body: dict | str) -> None:
            page = isinstance(body, str)
            data = (body if page else json.dumps(body, ensure_ascii=False, default=str)).encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{'text/html' if page else 'application/json'}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def guarded(self, work) -> None:
            try:
                host, origin = self.headers.get("Host", ""), self.headers.get("Origin")
                here = {f"{h}:{self.server.server_port}" for h in ("127.0.0.1", "localhost")}
                if host not in here or origin is not None and origin.removeprefix("http://") not in here:
                    raise serving.QueryError("FORBIDDEN", "loopback only", status=403)
                self.reply(200, work())
            except serving.QueryError as error:
                self.reply(error.status, error.payload())

        def body(self):
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BYTES:
                raise serving.QueryError("BODY_TOO_LARGE", "the body is too large", status=413)
            if self.headers.get_content_type() != "application/json":
                raise serving.QueryError("INVALID_CONTENT_TYPE", "application/json is expected", status=415)
            try:
                value = strict_json(self.rfile.read(size).decode())
            except ValueError:
                raise serving.QueryError("INVALID_JSON", "not valid JSON", status=400) from None
            if not isinstance(value, dict):
                raise serving.QueryError("INVALID_JSON", "an object is expected", status=400)
            return value

        def do_GET(self):
            def work():
                if self.path == "/":
                    return PAGE
                parts = urlsplit(self.path)
                if desk is not None and parts.path in ("/ask", "/desk"):
                    return desk.page(parts.path, parse_qs(parts.query))
                if self.path != "/api/catalog":
                    raise serving.QueryError("NOT_FOUND", self.path, status=404)
                found = store.active()
                if found is None:
                    raise serving.QueryError("NO_ACTIVE_DATASET", "no snapshot has been published", status=503)
                return serving.catalog(found[1]) | {"version": found[0]["version"], "metric_definition": serving.METRIC}

            self.guarded(work)

        def do_POST(self):
            def work():
                given = self.body()
                if self.path == "/api/query":
                    return run_query(store, given.get("query_id"), given.get("parameters"))
                if self.path == "/api/ask":
                    return run_query(store, *serving.route(given.get("question")))
                raise serving.QueryError("NOT_FOUND", self.path, status=404)

            self.guarded(work)

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
