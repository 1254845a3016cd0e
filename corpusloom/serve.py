"""An engine over HTTP, and as tools over lines of JSON-RPC; with counts of what was asked."""

from __future__ import annotations

import json
import threading
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from . import __doc__ as about
from .functions import models
from .plans import corpus
from .plans.answers import Engine
from .plans.jobs import Jobs
from .plans.store import Store
from .sources import registry

VERSION = "0.2"


class Metrics:
    """Counters and sums of seconds, as Prometheus' text format."""

    def __init__(self) -> None:
        self._lock, self.counts, self.seconds = threading.Lock(), Counter(), Counter()

    def count(self, name: str, **labels: str) -> None:
        with self._lock:
            self.counts[name, tuple(sorted(labels.items()))] += 1

    def timed(self, name: str, began: float, **labels: str) -> None:
        with self._lock:
            key = name, tuple(sorted(labels.items()))
            self.seconds[key] += time.perf_counter() - began
            self.counts[f"{name}_count", key[1]] += 1

    def text(self) -> str:
        with self._lock:
            rows = [(n, labels, v) for (n, labels), v in self.counts.items()] + [(f"{n}_sum", labels, v) for (n, labels), v in self.seconds.items()]
        shown = lambda labels: "{" + ",".join(f'{k}="{v}"' for k, v in labels) + "}" if labels else ""
        return "".join(f"{n}{shown(labels)} {v}\n" for n, labels, v in sorted(rows))


class Service:
    """What the surfaces share: questions, pushes, sources and jobs over a stored corpus."""

    def __init__(self, store: Store, embedder: models.Embedder, now: Callable[[], str], model: Callable[[str], str] | None = None):
        self.store, self.embedder, self.now, self.model = store, embedder, now, model
        self.metrics, self.jobs, self.lock = Metrics(), Jobs(), threading.Lock()

    def engine(self) -> Engine:
        return Engine(corpus.searchable(self.store), self.embedder, self.model, as_of=self.now())

    def query(self, request: dict) -> dict:
        mode, began = request.get("mode") or "synthesis", time.perf_counter()
        self.metrics.count("queries_total", mode=mode)
        options = {"sources": request.get("sources") or [], "types": request.get("source_types") or [], "topics": request.get("topics") or [], "limit": request.get("limit") or None}
        try:
            engine = self.engine()
            if mode == "raw":
                return engine.raw(request["messages"], **options)
            if mode == "local":
                return engine.local(request["messages"], **options)
            return engine.answer(request["messages"], concise=bool(request.get("concise")), no_expand=bool(request.get("no_expand")), **options)
        except Exception:
            self.metrics.count("query_errors_total")
            raise
        finally:
            self.metrics.timed("query_duration_seconds", began, phase="total")

    def push(self, request: dict) -> dict:
        """Fragments and deletions of a client. Numbers of fragments that were taken in, and that were there already."""
        rows, gone = request.get("fragments") or [], request.get("deleted") or []
        if not rows and not gone:
            raise ValueError("neither fragments nor deleted")
        spark = self.store.spark
        new = [(r["source_type"], r["source_name"], r["source_path"], r.get("content", ""), r.get("checksum", ""), k) for k, r in enumerate(rows)]
        new = spark.createDataFrame(new, "source_type string, source_name string, source_path string, raw_content string, checksum string, pos int")
        lost = spark.createDataFrame([(r["source_type"], r.get("source_name", ""), r["path"]) for r in gone], "source_type string, source_name string, source_path string")
        new = new.withColumn("embedding", models.embed(F.col("raw_content"), self.embedder, 50)).withColumn("ingested_at", F.lit(self.now()).cast("timestamp"))
        with self.lock:
            if not self.store.exists(corpus.FRAGMENTS):
                none = new.limit(0).withColumn("id", F.lit("")).drop("pos")
                self.store.write(corpus.FRAGMENTS, none)
            table = self.store.read(corpus.FRAGMENTS)
            new = new.withColumn("file_type", F.regexp_extract("source_path", r"(\.[^./]*)$", 1))
            for field in table.schema:
                if field.name != "id" and field.name not in new.columns:
                    new = new.withColumn(field.name, F.lit(None).cast(field.dataType))
            same = new.join(table.where("checksum <> ''").select("source_type", "source_path", "checksum").distinct(), ["source_type", "source_path", "checksum"], "left_semi").count()
            self.store.update(corpus.FRAGMENTS, lambda t: registry.pushed(t, new, lost))
        return {"ingested": len(rows) - same, "skipped": same}

    def sources(self) -> list[dict]:
        if not self.store.exists(corpus.REGISTRY):
            return []
        return [r.asDict() for r in corpus.overview(self.store).orderBy("source_type", "source_name").collect()]

    def export(self) -> Iterator[str]:
        """A line of JSON for each fragment with a vector."""
        rows = self.store.read(corpus.FRAGMENTS).where(F.col("embedding").isNotNull())
        for r in rows.select(F.to_json(F.struct(*rows.columns)).alias("line")).toLocalIterator():
            yield r["line"] + "\n"

    def connect(self, request: dict) -> dict:
        """Start a job that ingests a source."""
        source = registry.connector(request["kind"], **request.get("config", {}))

        def work(stop: threading.Event) -> None:
            if not stop.is_set():
                with self.lock:
                    corpus.ingest(self.store, source, self.embedder, self.now())

        job = self.jobs.start(f"{request['kind']}/{json.dumps(request.get('config', {}), sort_keys=True)}", work)
        return {"job": job.id, "state": job.state}


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def _head(self, status: int, kind: str = "application/json") -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Access-Control-Allow-Methods", "GET, POST, OPTIONS")
            self.send_header("Access-Control-Allow-Headers", "Content-Type")
            self.end_headers()

        def _send(self, status: int, body, kind: str = "application/json") -> None:
            service.metrics.count("http_requests_total", path=self.path.split("?")[0], status=str(status))
            self._head(status, kind)
            for part in [json.dumps(body)] if kind == "application/json" and not isinstance(body, Iterator) else body:
                self.wfile.write(part.encode())

        def do_OPTIONS(self) -> None:
            self._head(204)

        def do_GET(self) -> None:
            self._run({"/v1/health": lambda: {"status": "ok"}, "/v1/version": lambda: {"version": VERSION}, "/v1/sources": service.sources,
                       "/v1/sources/jobs": lambda: [{"id": j.id, "source": j.source, "state": j.state, "error": j.error} for j in service.jobs.list()],
                       "/v1/export": service.export, "/metrics": lambda: [service.metrics.text()]})

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                request = json.loads(self.rfile.read(size) or b"{}")
            except ValueError as e:
                return self._send(400, {"error": f"invalid request: {e}"})
            if self.path == "/v1/query" and request.get("stream") and request.get("messages"):
                return self._stream(request)
            self._run({"/v1/query": lambda: service.query(request), "/v1/ingest": lambda: service.push(request), "/v1/sources/connect": lambda: service.connect(request), "/v1/sources/sync": lambda: service.connect(request)})

        def _run(self, routes: dict) -> None:
            path, began = self.path.split("?")[0], time.perf_counter()
            if path not in routes:
                return self._send(404, {"error": "not found"})
            try:
                body = routes[path]()
            except (KeyError, ValueError) as e:
                return self._send(400, {"error": str(e)})
            except Exception as e:  # the server goes on
                return self._send(500, {"error": str(e)})
            self._send(200, body, "text/plain" if path == "/metrics" else "application/json")
            service.metrics.timed("http_request_duration_seconds", began, path=path)

        def _stream(self, request: dict) -> None:
            """Events: the text, then the rest of the answer."""
            self._head(200, "text/event-stream")
            try:
                out = service.query(request)
                events = [{"type": "text", "content": out.pop("content", "")}, {"type": "done", **out}]
            except Exception as e:
                events = [{"type": "error", "content": str(e)}]
            for e in events:
                self.wfile.write(f"data: {json.dumps(e)}\n\n".encode())

    return Handler


def http(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is ready to serve_forever()."""
    return ThreadingHTTPServer((host, port), handler(service))


TOOLS = [
    {
        "name": "query",
        "description": "Search the stored corpus: an answer with sources and trust, or, raw, the fragments themselves.",
        "inputSchema": {
            "type": "object", "required": ["query"],
            "properties": {"query": {"type": "string"}, "topics": {"type": "string"}, "limit": {"type": "number"}, "raw": {"type": "boolean"},
                           "sources": {"type": "string"}, "source_types": {"type": "string"}, "no_expand": {"type": "boolean"}},
        },
    },
    {"name": "list-sources", "description": "The sources of the corpus, with their sizes.", "inputSchema": {"type": "object", "properties": {}}},
]


def _list(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def tool(service: Service, name: str, arguments: dict) -> str:
    if name == "list-sources":
        return json.dumps(service.sources())
    if name != "query":
        raise ValueError(f"no such tool: {name}")
    if not arguments.get("query"):
        raise ValueError("query is required")
    request = {"messages": [{"role": "user", "content": arguments["query"]}], "concise": True, "mode": "raw" if arguments.get("raw") else "synthesis"}
    request |= {"topics": _list(arguments.get("topics")), "sources": _list(arguments.get("sources")), "source_types": _list(arguments.get("source_types"))}
    return json.dumps(service.query(request | {"limit": int(arguments.get("limit") or 0), "no_expand": arguments.get("no_expand", False)}))


def rpc(service: Service, lines: Iterable[str]) -> Iterator[str]:
    """Answers to requests of the Model Context Protocol, a line each."""
    for line in lines:
        if not line.strip():
            continue
        request = json.loads(line)
        if "id" not in request:  # a notification
            continue
        method, params = request.get("method"), request.get("params") or {}
        try:
            if method == "initialize":
                result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}, "prompts": {}}, "serverInfo": {"name": "corpusloom", "version": VERSION}}
            elif method == "tools/list":
                result = {"tools": TOOLS}
            elif method == "tools/call":
                try:
                    result = {"content": [{"type": "text", "text": tool(service, params["name"], params.get("arguments") or {})}]}
                except Exception as e:  # a tool's failure is a result
                    result = {"content": [{"type": "text", "text": str(e)}], "isError": True}
            elif method == "prompts/list":
                result = {"prompts": [{"name": "instructions", "description": "How to ask this corpus."}]}
            elif method == "prompts/get":
                known = "".join(f"- {s['source_type']}/{s['source_name']}: {s['description']}\n" for s in service.sources())
                text = f"{about}\n\nAsk with the tool query; name topics or sources to narrow it.\n\nSources:\n{known}"
                result = {"messages": [{"role": "user", "content": {"type": "text", "text": text}}]}
            elif method == "ping":
                result = {}
            else:
                yield json.dumps({"jsonrpc": "2.0", "id": request["id"], "error": {"code": -32601, "message": f"no such method: {method}"}})
                continue
            yield json.dumps({"jsonrpc": "2.0", "id": request["id"], "result": result})
        except (KeyError, ValueError) as e:
            yield json.dumps({"jsonrpc": "2.0", "id": request["id"], "error": {"code": -32602, "message": str(e)}})
