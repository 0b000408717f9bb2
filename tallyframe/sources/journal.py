"""Tables that grow by steps: each step's rows are written whole, then a marker publishes them."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Journal:
    """Steps under a folder of any file system that Spark knows. One writer at a time: of two that race for a step, one fails.

    A marker names its step's folder and carries what the next step has to know. A marker without
    content belongs to a writer that died, and is passed over. A step may be full: it then
    holds all rows, and what came before it is no longer read.
    """

    spark: SparkSession
    root: str
    schemas: dict[str, str]
    _known: list[dict] | None = field(default=None, init=False, repr=False)
    _last: int = field(default=0, init=False, repr=False)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/published")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def _marker(self, number: int) -> dict | None:
        fs, p = self._fs(f"{self.root}/published/{number}")
        size = int(fs.getFileStatus(p).getLen())
        if not size:
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readNBytes(size)))
        finally:
            stream.close()

    def steps(self) -> list[dict]:
        """The markers in force, in order: the last full step and those after it.

        The folder is listed once; after that only markers that may have come are looked for, so a batch costs the same however many there were.
        """
        if self._known is None:
            found: list[dict] = []
            numbers = self._numbers()
            for n in reversed(numbers):
                if m := self._marker(n):
                    found.append({**m, "step": n})
                    if m["full"]:
                        break
            self._known, self._last = found[::-1], found[0]["step"] if found else 0
        n = self._last + 1
        while self._there(n):
            if m := self._marker(n):  # one without content may still be written, and is looked at again
                self._known = [{**m, "step": n}] if m["full"] else [*self._known, {**m, "step": n}]
                self._last = n
            n += 1
        return self._known

    def _there(self, number: int) -> bool:
        fs, p = self._fs(f"{self.root}/published/{number}")
        return fs.exists(p)

    def _free(self) -> int:
        """The number after all markers, with content or without."""
        self.steps()
        n = self._last + 1
        while self._there(n):
            n += 1
        return n

    def read(self, name: str, steps: list[dict] | None = None) -> DataFrame:
        """All published rows of a table, with the number of their step."""
        steps = self.steps() if steps is None else steps
        paths = [f"{self.root}/steps/{m['folder']}/{name}" for m in steps if name in m["tables"]]
        schema = f"{self.schemas[name]}, step long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def publish(self, tables: dict[str, DataFrame], facts: dict, full: bool = False) -> int:
        """Write the rows of a step, then its marker."""
        number = self._free()
        folder = f"{number}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            rows = df if full else df.withColumn("step", F.lit(number).cast("long"))
            writer = rows.write
            if full and "id" in rows.columns:  # where most files don't hold the ids that are looked for
                writer = writer.option("parquet.bloom.filter.enabled#id", "true")
            writer.parquet(f"{self.root}/steps/{folder}/{name}")
        fs, marker = self._fs(f"{self.root}/published/{number}")
        stream = fs.create(marker, False)  # fails where another writer has been
        try:
            stream.write(bytearray(json.dumps({"folder": folder, "tables": sorted(tables), "full": full, "facts": facts}).encode()))
        finally:
            stream.close()
        return number
