"""A data source for published quotes, on Spark's Python data source API.

Register with spark.dataSource.register(QuoteSource) and read with spark.read.format("quotes").option("fetch", "module:function")
.option("tickers", "A,B").load(). The fetch function gets one ticker and yields (day, value) pairs; it is called on executors, one
task a ticker, and is tried again after failures. A ticker whose fetch fails for good gives no rows, or with option failed=error fails the query.
"""

from __future__ import annotations

import importlib
import time

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Ticker(InputPartition):
    def __init__(self, name: str):
        self.name = name


class QuoteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.tickers = [t for t in options.get("tickers", "").split(",") if t]
        self.strict = options.get("failed", "skip") == "error"
        self.fetch, self.tries, self.wait = options.get("fetch", ""), int(options.get("tries", "3")), float(options.get("wait", "0.1"))

    def partitions(self):
        return [Ticker(t) for t in self.tickers] or [Ticker("")]

    def read(self, partition):
        if not partition.name:
            return
        module, _, name = self.fetch.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        for k in range(self.tries):
            try:
                rows = [(partition.name, d, None if v is None else float(v)) for d, v in fetch(partition.name)]
            except OSError:
                if self.strict and k == self.tries - 1:
                    raise
                time.sleep(self.wait * 2**k)
                continue
            yield from rows
            return


class QuoteSource(DataSource):
    @classmethod
    def name(cls):
        return "quotes"

    def schema(self):
        return "ticker string, day date, value double"

    def reader(self, schema):
        return QuoteReader(dict(self.options))
