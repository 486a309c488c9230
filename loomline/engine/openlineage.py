"""OpenLineage events: building them, and sending them without holding up the run."""

from __future__ import annotations

import json
import logging
import queue
import threading
import time
import urllib.request
from collections.abc import Callable
from datetime import UTC, datetime

from loomline.engine.model import Extract

log = logging.getLogger("loomline.openlineage")

# Addresses of the public specification, and the limits of the sender.
SCHEMA_URL = "https://openlineage.io/spec/2-0-2/OpenLineage.json"
PARENT_FACET = "https://openlineage.io/spec/facets/1-0-0/ParentRunFacet.json"
ERROR_FACET = "https://openlineage.io/spec/facets/1-0-0/ErrorMessageRunFacet.json"
COLUMN_FACET = "https://openlineage.io/spec/facets/1-1-0/ColumnLineageDatasetFacet.json"
CAPACITY, ATTEMPTS, TIMEOUT_S, FIRST_PAUSE_S = 10_000, 3, 10, 0.4
PRODUCER = "https://example.org/loomline"


def now_iso() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def event(
    kind: str, run_id: str, pipeline_run_id: str | None, namespace: str, job: str, inputs: list[tuple[str, str]], outputs: list[tuple[str, str]], error: str | None = None,
    extracts: list[Extract] | None = None, when: str | None = None,
) -> dict:
    """inputs and outputs: (namespace, name). Column lineage goes to the first output."""
    facets: dict = {}
    if pipeline_run_id:
        facets["parent"] = {"_producer": PRODUCER, "_schemaURL": PARENT_FACET, "run": {"runId": pipeline_run_id}, "job": {"namespace": namespace, "name": "pipeline"}}
    if error:
        facets["errorMessage"] = {"_producer": PRODUCER, "_schemaURL": ERROR_FACET, "message": error, "programmingLanguage": "SQL"}
    out = [{"namespace": n, "name": d} for n, d in outputs]
    if out and extracts:
        out[0]["facets"] = {"columnLineage": column_facet(extracts, dict((d, n) for n, d in inputs), namespace)}
    return {
        "eventType": kind, "eventTime": when or now_iso(), "producer": PRODUCER, "schemaURL": SCHEMA_URL, "run": {"runId": run_id, "facets": facets},
        "job": {"namespace": namespace, "name": job, "facets": {}}, "inputs": [{"namespace": n, "name": d} for n, d in inputs], "outputs": out,
    }


def column_facet(extracts: list[Extract], namespaces: dict[str, str], default: str) -> dict:
    fields = {}
    for x in extracts:
        for c in x.to_dict()["columns"]:
            fields[c["output_field"]] = {
                "inputFields": [{"namespace": namespaces.get(i["dataset"], default), "name": i["dataset"], "field": i["field"], "transformations": i["transformations"]} for i in c["inputs"]]
            }
    return {"_producer": PRODUCER, "_schemaURL": COLUMN_FACET, "fields": fields}


def post(url: str, api_key: str, body: bytes) -> None:
    request = urllib.request.Request(url, data=body, method="POST", headers={"Content-Type": "application/json", **({"Authorization": f"Bearer {api_key}"} if api_key else {})})
    with urllib.request.urlopen(request, timeout=TIMEOUT_S):
        pass


class Emitter:
    """A bounded queue and one worker. emit never waits: 0 if the event was queued, 1 if it was dropped."""

    def __init__(self, url: str = "", api_key: str = "", debug: bool = False, send: Callable[[str, str, bytes], None] = post, capacity: int = CAPACITY, pause: float = FIRST_PAUSE_S):
        self.url, self.api_key, self.debug, self._send, self._pause = url, api_key, debug, send, pause
        self._queue: queue.Queue = queue.Queue(capacity)
        self._worker: threading.Thread | None = None
        self._lock = threading.Lock()

    def emit(self, record: dict) -> int:
        if not self.url:
            return 1
        try:
            self._queue.put_nowait(json.dumps(record, ensure_ascii=False).encode())
        except queue.Full:
            return 1
        with self._lock:
            if not self._worker:
                self._worker = threading.Thread(target=self._run, daemon=True, name="openlineage")
                self._worker.start()
        return 0

    def _run(self) -> None:
        while True:
            body = self._queue.get()
            if self.debug:
                log.info("%s", body.decode())
            for k in range(ATTEMPTS):
                try:
                    self._send(self.url, self.api_key, body)
                    break
                except Exception as e:  # noqa: BLE001
                    if self.debug:
                        log.warning("attempt %d: %s", k + 1, e)
                    if k + 1 < ATTEMPTS:
                        time.sleep(self._pause * 2**k)
            self._queue.task_done()

    def flush(self) -> None:
        self._queue.join()
