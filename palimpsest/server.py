"""The engine over HTTP with JSON bodies.

    POST /entities/<e>              PUT /data/<e>     {"data": [{"id": n, "fields": {...}}]}
    PUT  /indices/<e> {"type": "string|numeric|date|bool|enum", "name": ..., "term": ...}
    POST /deltas/<e>  {"scope": {"branch": n, "date": "..."}, "deltas": [{"id": n, "fieldName": ..., "after": ...}]}
    POST /search      {"query": "FROM ..."}  -> {"data": [items]}
    POST /options     {"query": "FROM ..."}  -> [{"field": ..., "values": {...}}]

400: the query or request isn't valid; 409: the entity is there already; 404: no such route; 500: anything else.
"""

from __future__ import annotations

import datetime as dt
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from .engine import Engine
from .errors import EngineError, EntityAlreadyExists, EntityNotFound, InvalidInput
from .operators.deltas import Change
from .plans.query import Query
from .types import from_json


def items_of(engine: Engine, text: str) -> list[dict[str, Any]]:
    """A page of items, which the page's size bounds; fields in order, those missing left out."""
    q = Query.parse(text)
    id_column = engine.entities[q.entity].id_column if q.entity in engine.entities else "id"
    out = []
    for row in engine.query(q).collect():
        d = row.asDict(recursive=True)
        key = d.pop(id_column)
        out.append({"id": key, "fields": {k: _plain(v) for k, v in sorted(d.items()) if v is not None}})
    return out


def _plain(v):
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return [_plain(x) for x in v] if isinstance(v, list) else v


def handle(engine: Engine, method: str, path: str, body: Any) -> tuple[int, Any]:
    """(status, answer) of a request."""
    parts = path.strip("/").split("/")
    try:
        match method, *parts:
            case "POST", "entities", name:
                engine.create_entity(name)
            case "PUT", "data", name:
                engine.add(name, body["data"])
            case "PUT", "indices", name:
                engine.create_index(name, body["name"], from_json(body))
            case "POST", "deltas", name:
                changes = [Change(d["id"], d["fieldName"], d["after"]) for d in body["deltas"]]
                engine.store_deltas(name, _date(body["scope"]["date"]), changes, body["scope"].get("branch"))
            case "POST", "search":
                return 200, {"data": items_of(engine, body["query"])}
            case "POST", "options":
                maps: dict[str, dict[str, int]] = {}
                for r in engine.option_maps(body["query"]).collect():
                    maps.setdefault(r["field"], {}).update(r["values"])
                return 200, [{"field": f, "values": dict(sorted(values.items()))} for f, values in maps.items()]
            case _:
                return 404, f"no route {method} {path}"
    except EntityAlreadyExists as e:
        return 409, f'Conflict: "{e}"'
    except EntityNotFound as e:
        return 500, f"no entity {e}"
    except EngineError as e:
        return 400, f"{type(e).__name__}: {e}"
    except (KeyError, TypeError, AttributeError) as e:
        return 400, f"Invalid request: {e}"
    return 200, None


def _date(text: str) -> dt.date:
    try:
        return dt.date.fromisoformat(text)
    except (TypeError, ValueError):
        raise InvalidInput(f"an ISO 8601 date is needed, not {text!r}") from None


class _Handler(BaseHTTPRequestHandler):
    engine: Engine

    def _serve(self) -> None:
        raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        try:
            body = json.loads(raw or b"{}")
            status, answer = handle(self.engine, self.command, self.path, body)
        except ValueError as e:
            status, answer = 400, f"Invalid request: {e}"
        except Exception as e:  # the server goes on
            status, answer = 500, f"Something went wrong: {e}"
        data = json.dumps(answer).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    do_GET = do_POST = do_PUT = _serve

    def log_message(self, *args) -> None:
        pass


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 3000) -> ThreadingHTTPServer:
    """A server that is ready; call serve_forever()."""
    return ThreadingHTTPServer((host, port), type("Handler", (_Handler,), {"engine": engine}))
