"""Documents over HTTP as a data source: requests are rows, fetched in the executors."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.urls import decode_body

RESPONSE = "spec_id bigint, url string, status int, body string, content_type string, attempts int, error string"
Opener = Callable[[urllib.request.Request, float], tuple[int, bytes, str]]


def open_url(request: urllib.request.Request, timeout: float) -> tuple[int, bytes, str]:
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.read(), r.headers.get("Content-Type") or ""
    except urllib.error.HTTPError as e:
        return e.code, e.read(), e.headers.get("Content-Type") or ""


def fetch(specs: DataFrame, default_retry: int = 2, backoff_ms: int = 200, timeout: float = 15.0, min_delay_ms: int = 0, opener: Opener = open_url) -> DataFrame:
    """Responses of request rows (spec_id, url, http_method, headers, body, retry, response_type, charset).

    Requests of a host share a partition, where they keep a least delay between
    them; a transport error or a status from 500 on is tried again, waiting longer
    each time. Binary types give their body as hexadecimal text.
    """
    by_host = specs.withColumn("_h", F.regexp_extract("url", "^[^/]*//([^/]*)", 1)).repartition("_h").sortWithinPartitions("_h")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                wait = last.get(r.host or "", 0) + min_delay_ms / 1000 - time.monotonic()
                if wait > 0:
                    time.sleep(wait)
                retry = default_retry if pd.isna(r.retry) else int(r.retry)
                status, body, kind, error, n = 0, None, None, None, 0
                for n in range(1, retry + 2):
                    try:
                        request = urllib.request.Request(r.url, data=r.body.encode() if r.body else None, method=r.http_method or "GET", headers={h["name"]: h["value"] for h in (r.headers if r.headers is not None else [])})
                        status, data, kind = opener(request, timeout)
                        body, error = data.hex() if r.response_type else decode_body(data, r.charset, kind), None
                    except (OSError, ValueError) as e:
                        status, body, error = 0, None, str(e)
                    if status and status < 500:
                        break
                    if n <= retry:
                        time.sleep(backoff_ms * n / 1000)
                last[r.host or ""] = time.monotonic()
                out.append((r.spec_id, r.url, status, body, kind, n, error))
            yield pd.DataFrame(out, columns=["spec_id", "url", "status", "body", "content_type", "attempts", "error"])

    return by_host.select("spec_id", "url", "http_method", "headers", "body", "retry", "response_type", "charset", F.col("_h").alias("host")).mapInPandas(run, RESPONSE)
