"""One commit for all outputs of a micro-batch (ST8).

A unit of work (a micro-batch) writes each of its tables into a folder of its own and
then publishes a manifest, one small file that names the folders: written under a
temporary name and renamed, last of all.  Readers take folders from manifests only, so
they see all tables of a batch or none; what a failed attempt left behind is never read
and is replaced when the batch is replayed.  A batch whose manifest is there is not done
again, so a replay after the commit changes nothing.

``compact`` rewrites the folders of a run of batches as one and publishes a manifest
that stands for all of theirs; ``vacuum`` deletes what no manifest names any more.

    root/<table>/batch_id=<n>/...          rows of a batch
    root/<table>/batch_id=0-<n>/...        rows of all batches up to n, after compaction
    root/_commits/<n>.json, 0-<n>.json     manifests
"""

from __future__ import annotations

import json
import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FOLDER = "batch_id"


class CommitLog:
    """The tables below ``root``.  ``step`` is called with a name after every write and
    before every publication (tests make it fail there)."""

    def __init__(self, spark: SparkSession, root: str, step: Callable[[str], None] | None = None):
        self.spark, self.root, self.step = spark, root.rstrip("/"), step or (lambda name: None)
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------- manifests
    def _names(self) -> list[tuple[int, int, str]]:
        """(first batch, last batch, name) of the published manifests."""
        folder = self._path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return []
        out = []
        for f in self._fs.listStatus(folder):
            name = f.getPath().getName()
            if name.endswith(".json") and not name.startswith((".", "_")):
                first, _, last = name[:-5].rpartition("-")
                out.append((int(first or last), int(last), name))
        return out

    def _manifest(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/_commits/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, name: str, body: dict) -> None:
        tmp, final = (self._path(f"{self.root}/_commits/{n}") for n in (f".{name}.{uuid.uuid4().hex}", name))
        out = self._fs.create(tmp)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        if not self._fs.rename(tmp, final):  # another attempt was first
            self._fs.delete(tmp, False)
            if not self._fs.exists(final):
                raise OSError(f"cannot publish {name} below {self.root}")

    def _live(self) -> list[tuple[int, int, str]]:
        """The manifests that count, by batch: a compacted run stands for all it holds."""
        names = self._names()
        upto = max((last for first, last, n in names if "-" in n), default=-1)
        run = [x for x in names if "-" in x[2] and x[1] == upto]
        return run + sorted(x for x in names if "-" not in x[2] and x[1] > upto)

    def committed(self, batch_id: int) -> bool:
        return any(first <= batch_id <= last for first, last, _ in self._live())

    # ------------------------------------------------------------- writing
    def write(self, batch_id: int | str, tables: dict[str, tuple[DataFrame, list[str]] | DataFrame]) -> dict:
        """Write tables (a DataFrame, or one with its partition columns); their entries."""
        entries = {}
        for name, t in tables.items():
            df, by = t if isinstance(t, tuple) else (t, [])
            folder = f"{name}/{FOLDER}={batch_id}"
            writer = df.write.mode("overwrite")
            (writer.partitionBy(*by) if by else writer).parquet(f"{self.root}/{folder}")
            entries[name] = {"folder": folder, "schema": df.schema.json(), "by": by}
            self.step(f"wrote {name}")
        return entries

    def publish(self, batch_id: int, entries: dict) -> None:
        self.step("publish")
        self._publish(f"{batch_id}.json", {"tables": entries})
        self.step("published")

    def commit(self, batch_id: int, tables: dict) -> bool:
        """Write all tables of a batch and publish them together; False if it is done already."""
        if self.committed(batch_id):
            return False
        self.publish(batch_id, self.write(batch_id, tables))
        return True

    # ------------------------------------------------------------- reading
    def _frame(self, entries: list[dict]) -> DataFrame:
        table = entries[0]["folder"].split("/")[0]
        schema = StructType.fromJson(json.loads(entries[-1]["schema"]))
        read = self.spark.read.schema(StructType.fromJson(json.loads(schema.json())).add(FOLDER, "string"))
        df = read.option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{e['folder']}" for e in entries])
        return df.select(*[f.name for f in schema.fields])

    def frame(self, entry: dict) -> DataFrame:
        """The rows of one entry that ``write`` has given."""
        return self._frame([entry])

    def _entries(self, table: str) -> list[dict]:
        found = [self._manifest(n)["tables"].get(table) for _, _, n in self._live()]
        return [e for e in found if e is not None]

    def read(self, table: str) -> DataFrame | None:
        """The committed rows of a table (None: never committed)."""
        entries = self._entries(table)
        return self._frame(entries) if entries else None

    def last(self, table: str, before: int | None = None) -> DataFrame | None:
        """The rows of the newest batch (before a batch) that wrote the table: a state that
        every batch replaces."""
        for first, last, name in reversed(self._live()):
            if before is None or last < before:
                e = self._manifest(name)["tables"].get(table)
                if e is not None:
                    return self._frame([e])
        return None

    # ------------------------------------------------------------- upkeep
    def compact(self, upto: int, states: tuple[str, ...] = ()) -> None:
        """Rewrite the batches up to ``upto`` as one folder a table; of ``states`` only the
        newest batch's rows are kept.  All batches up to ``upto`` must be committed ones or
        never have been; readers go on with the old folders until the manifest is there."""
        runs = [x for x in self._live() if x[1] <= upto]
        if len(runs) < 2:
            return
        upto = runs[-1][1]
        tables: dict[str, list[dict]] = {}
        for _, _, name in runs:
            for t, e in self._manifest(name)["tables"].items():
                tables.setdefault(t, []).append(e)
        entries = self.write(f"0-{upto}", {
            t: (self._frame(es[-1:] if t in states else es), es[-1]["by"]) for t, es in tables.items()})
        self.step("publish")
        self._publish(f"0-{upto}.json", {"tables": entries})
        self.step("published")

    def vacuum(self) -> None:
        """Delete manifests that a compacted run stands for, then folders that no manifest
        names and no batch still to come can be writing.  Only for times without old readers."""
        live = self._live()
        names = {n for _, _, n in live}
        done = max((last for _, last, _ in live), default=-1)
        for _, last, n in self._names():
            if n not in names:
                self._fs.delete(self._path(f"{self.root}/_commits/{n}"), False)
        tables: dict[str, set] = {}
        for n in names:
            for t, e in self._manifest(n)["tables"].items():
                tables.setdefault(t, set()).add(e["folder"].split("=")[-1])
        for t, keep in tables.items():
            for f in self._fs.listStatus(self._path(f"{self.root}/{t}")):
                own = f.getPath().getName()
                if own.startswith(f"{FOLDER}="):
                    batch = own.split("=")[-1]
                    if batch not in keep and int(batch.split("-")[-1]) <= done:
                        self._fs.delete(f.getPath(), True)


def read_committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The committed rows of one output of a stream (``routed``, ``dead_letters``,
    ``history``, ...)."""
    df = CommitLog(spark, root).read(table)
    if df is None:
        raise ValueError(f"no batch has committed {table} below {root}")
    return df
