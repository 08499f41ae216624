"""Python data sources for quotes, charts and feeds over HTTP, with retries; at most ``CONCURRENT`` requests run at once.

Addresses are dealt to that many partitions at most, and a partition asks for one after another, or for a few at once in
a pool of its own, with that many partitions fewer.

The engine's host decides how a request is made: ``fetch`` is an importable function ``module:name`` from
(url, timeout) to text. Without one, urllib is used.
"""

from __future__ import annotations

import importlib
import itertools
import re
import time
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..functions.text import TICKER
from ..operators.charts import INTERVALS, MOST_SYMBOLS, RANGES

TIMEOUT, ATTEMPTS, CONCURRENT = 7.0, 2, 8


def open_url(url: str, timeout: float) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as r:
        return r.read().decode("utf-8")


def retriable(error: Exception) -> bool:
    """Time-outs, 429, 5xx and errors without a status may pass; other answers stand."""
    code = getattr(error, "code", None)
    return code is None or code == 429 or code >= 500


def with_retries(fetch, url: str, timeout: float = TIMEOUT, attempts: int = ATTEMPTS) -> tuple[str | None, str | None, int]:
    """(text, error, attempts used)."""
    for n in range(1, attempts + 1):
        try:
            return fetch(url, timeout), None, n
        except Exception as e:
            if n == attempts or not retriable(e):
                return None, f"{type(e).__name__}: {e}"[:200], n
            time.sleep(0.05 * n)
    return None, "no attempt", 0


class HttpSource(DataSource):
    """``spark.read.format("tidemark_http").option("urls", "...\\n...").load()``: url, text, error, attempts."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_http"

    def schema(self) -> str:
        return "url string, text string, error string, attempts int"

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(self.options)


class Dealt(InputPartition):
    """Requests that one task makes."""

    def __init__(self, requests: list[tuple]):
        self.requests = requests


def dealt(requests: list[tuple], pool: int) -> list[InputPartition]:
    """Requests dealt to as many partitions as may run with pools of this size; one of nothing where there are none."""
    if not 1 <= pool <= CONCURRENT:
        raise ValueError(f"a pool has 1 to {CONCURRENT} workers")
    n = max(1, min(len(requests), CONCURRENT // pool))
    return [Dealt(requests[i::n]) for i in range(n)]


def function_of(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function) if module else open_url


class HttpReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u.strip()]
        self.fetch, self.timeout, self.pool = options.get("fetch", ""), float(options.get("timeout", TIMEOUT)), int(options.get("pool", 1))

    def partitions(self):
        return dealt([(u,) for u in self.urls], self.pool)

    def read(self, partition):
        fetch = function_of(self.fetch)
        with ThreadPoolExecutor(self.pool) as pool:
            yield from pool.map(lambda r: (*r, *with_retries(fetch, r[0], self.timeout)), partition.requests)


class ChartSource(DataSource):
    """Charts by symbol, range and interval: ``spark.read.format("tidemark_charts").option("address", ...).load()``.

    What is asked for comes from the filters on ``symbol``, ``range`` and ``interval`` (equal to, or one of), or from the
    options of these names (with commas); a range or an interval that neither names is the default one. Options: ``address``
    with {symbol}, {range} and {interval}, ``fetch``, ``timeout``, ``pool``. A row for each combination: url, text, error,
    attempts. What the service doesn't know is answered by an error, without a request. Filters are handed down where
    ``spark.sql.python.filterPushdown.enabled`` is set. Load anew for each query: a loaded source keeps what filters last
    asked for.
    """

    @classmethod
    def name(cls) -> str:
        return "tidemark_charts"

    def schema(self) -> str:
        return "symbol string, range string, interval string, url string, text string, error string, attempts int"

    def reader(self, schema) -> DataSourceReader:
        return ChartReader(self.options)


class ChartReader(HttpReader):
    DEFAULTS = {"range": "1mo", "interval": "1d"}

    def __init__(self, options):
        super().__init__(options)
        self.address = options.get("address", "{symbol}?range={range}&interval={interval}")
        given = {c: [v.strip() for v in options.get(c, "").split(",") if v.strip()] for c in ("symbol", "range", "interval")}
        self.asked = {c: v or ([self.DEFAULTS[c]] if c in self.DEFAULTS else []) for c, v in given.items()}
        self.fixed = {c for c, v in given.items() if v}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if column in self.asked and values is not None and all(isinstance(v, str) for v in values):
                self.asked[column] = [v for v in self.asked[column] if v in values] if column in self.fixed else list(dict.fromkeys(values))
                self.fixed.add(column)
            yield f  # Spark checks the rows as well

    def partitions(self):
        if len(self.asked["symbol"]) > MOST_SYMBOLS:
            raise ValueError(f"at most {MOST_SYMBOLS} symbols are asked for at once")
        return dealt(list(itertools.product(*(self.asked[c] for c in ("symbol", "range", "interval")))), self.pool)

    def _answer(self, fetch, request: tuple) -> tuple:
        symbol, span, interval = request
        wrong = "symbol" if not re.fullmatch(TICKER, symbol) else "range" if span not in RANGES else "interval" if interval not in INTERVALS else None
        if wrong:
            return (*request, None, None, wrong, 0)
        url = self.address.format(symbol=symbol, range=span, interval=interval)
        return (*request, url, *with_retries(fetch, url, self.timeout))

    def read(self, partition):
        fetch = function_of(self.fetch)
        with ThreadPoolExecutor(self.pool) as pool:
            yield from pool.map(lambda r: self._answer(fetch, r), partition.requests)
