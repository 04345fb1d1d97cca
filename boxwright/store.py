"""Versioned tables that several writers share: Parquet folders and a log of commits.

Every commit is one small file ``_log/<n>.json`` that names the folders of all
tables as they are then. It is written whole under another name and published
only if no other writer has published that number; who comes second reads the
log again, checks that nothing it had read has changed, and tries the next one.

A table with a layout is split into column groups (labels and boxes; vectors;
pixels), each bucketed by the key, so that they join without a shuffle, and
sorted for reads of one image. Changes to some rows are small tables of keys and
new values that are merged when the table is read, until ``compact`` folds them.
"""

from __future__ import annotations

import copy
import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

#: Times a commit is tried again when other writers come first.
ATTEMPTS = 20
SEQ = "_seq"


class Conflict(RuntimeError):
    """Another writer changed a table after it was read."""


@dataclass(frozen=True)
class Layout:
    """How a table lies: its key, groups of columns apart from the rest, order within files, columns with Bloom filters."""

    key: str = "id"
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    order: tuple[str, ...] = ()
    blooms: tuple[str, ...] = ()
    buckets: int = 8


LAYOUTS = {"predictions": Layout("id", {"vectors": ("embedding", "bioclip_embedding"), "roi": ("roi",)}, ("image_path", "id"), ("image_path", "roi_index"))}


class Store:
    """``<root>/<table>/<group>/seg=<name>`` and ``<root>/_log/<n>.json``."""

    def __init__(self, spark: SparkSession, root: str, layouts: dict[str, Layout] | None = None):
        self.spark, self.root, self.layouts = spark, root.rstrip("/"), LAYOUTS if layouts is None else layouts
        self._seen: dict[str, int] = {}

    # The log

    def _path(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[tuple[str, float]]:
        """Names in a folder and when they were changed, in seconds."""
        p, fs = self._path(path)
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(p)] if fs.exists(p) else []

    def log(self) -> list[int]:
        """Numbers of the commits that are kept."""
        return sorted(int(n.removesuffix(".json")) for n, _ in self._list(f"{self.root}/_log") if n.endswith(".json") and n[:-5].isdigit())

    def _state(self, number: int | None = None) -> tuple[int, dict]:
        numbers = self.log()
        if number is None and not numbers:
            return -1, {}
        number = numbers[-1] if number is None else number
        if number not in numbers:
            raise FileNotFoundError(f"no commit {number} in {self.root}")
        return number, json.loads(self.spark.read.text(f"{self.root}/_log/{number}.json", wholetext=True).first()["value"])

    def _publish(self, number: int, state: dict) -> bool:
        """Make a commit current; False if the number is taken. The file is whole before it has its name."""
        part, fs = self._path(f"{self.root}/_log/.{number}-{uuid.uuid4().hex}.part")
        out = fs.create(part, False)
        out.write(json.dumps(state, sort_keys=True).encode())
        out.close()
        final, _ = self._path(f"{self.root}/_log/{number}.json")
        try:
            return self._name(fs, part, final)
        finally:
            fs.delete(part, False)

    def _name(self, fs, part, final) -> bool:
        """Give a file its name unless something has it: by a hard link on a local disk, whose rename would overwrite,
        elsewhere by a rename that refuses to."""
        if fs.getUri().getScheme() == "file":
            try:
                os.link(part.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            return True
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(part, final, how)
        except Exception as e:
            if fs.exists(final):
                return False
            raise e
        return True

    def _commit(self, change: Callable[[dict, int], dict | None]) -> None:
        """Publish what ``change`` makes of the tables as they are; done again on what others publish first."""
        for _ in range(ATTEMPTS):
            last, state = self._state()
            new = change(copy.deepcopy(state), last + 1)
            if new is None or self._publish(last + 1, new):
                return
        raise Conflict(f"{ATTEMPTS} other commits came first")

    # Folders

    def _layout(self, table: str, columns: list[str]) -> Layout | None:
        found = self.layouts.get(table)
        return found if found and found.key in columns else None

    def _write(self, df: DataFrame, path: str, layout: Layout | None) -> None:
        if layout is None:
            df.write.parquet(path)
            return
        order = [c for c in layout.order if c in df.columns] or [layout.key]
        out = df.repartition(layout.buckets, layout.key).write.format("parquet").bucketBy(layout.buckets, layout.key).sortBy(*order)
        for c in layout.blooms:
            if c in df.columns:
                out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        name = f"boxwright_new_{uuid.uuid4().hex}"  # only a catalog entry knows of buckets
        out.option("path", path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")

    def _bucketed(self, table: str, group: str, about: dict) -> DataFrame:
        """All segments of a group as one bucketed table, its catalog entry made anew where this session has none."""
        path = f"{self.root}/{table}/{group}"
        kind = about["groups"][group]["schema"]
        name = "boxwright_" + hashlib.md5(f"{path} {kind} {about['buckets']}".encode()).hexdigest()
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(kind)))
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, seg STRING) USING parquet PARTITIONED BY (seg) CLUSTERED BY (`{about['key']}`) INTO {about['buckets']} BUCKETS LOCATION '{path}'")
        self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS " + " ".join(f"PARTITION (seg = '{s}')" for s, _ in about["groups"][group]["segs"]))
        return self.spark.table(name)

    def _segments(self, table: str, group: str, about: dict) -> DataFrame:
        """Rows of a group as they were written, with the number of the commit that brought them."""
        segs = about["groups"][group]["segs"]
        if about["key"] is None:
            return self.spark.read.schema(StructType.fromJson(json.loads(about["groups"][group]["schema"]))).parquet(*(f"{self.root}/{table}/{group}/seg={s}" for s, _ in segs))
        rows = self._bucketed(table, group, about).filter(F.col("seg").isin([s for s, _ in segs]))
        numbers = {n for _, n in segs}
        seq: Column = F.lit(numbers.pop()) if len(numbers) == 1 else F.create_map(*(F.lit(x) for s in segs for x in s))[F.col("seg")]
        return rows.withColumn(SEQ, seq).drop("seg")

    def _merged(self, table: str, group: str, about: dict) -> DataFrame:
        """Rows of a group with the changes since they were written, the latest of each value."""
        rows = self._segments(table, group, about)
        deltas = [d for d in about["deltas"] if d["group"] in (group, None)]
        if about["key"] is None or not deltas:
            return rows.drop(SEQ)
        key, parts = about["key"], []
        changed = sorted({c for d in deltas for c in d["columns"]})
        kinds = {f.name: f.dataType for f in StructType.fromJson(json.loads(about["groups"][group]["schema"]))}
        for d in deltas:
            at = self.spark.read.parquet(f"{self.root}/{table}/_changes/{d['name']}")
            cells = [(F.struct(F.lit(d["seq"]).alias("s"), F.col(c).alias("v")) if c in d["columns"] else F.lit(None).cast(StructType().add("s", IntegerType()).add("v", kinds[c]))).alias(c) for c in changed]
            parts.append(at.select(F.col(key).alias("_key"), *cells, F.lit(d["seq"] if d["group"] is None else None).cast("int").alias("_gone")))
        every = parts[0]
        for p in parts[1:]:
            every = every.union(p)
        latest = every.groupBy("_key").agg(F.max("_gone").alias("_gone"), *(F.max(c).alias(f"_to_{c}") for c in changed))
        joined = rows.join(latest, F.col(key) == F.col("_key"), "left").filter(F.col("_gone").isNull() | (F.col("_gone") < F.col(SEQ)))
        to = {c: F.when(F.col(f"_to_{c}.s") > F.col(SEQ), F.col(f"_to_{c}.v")).otherwise(F.col(c)) for c in changed}
        return joined.select(*((to[c].alias(c) if c in to else F.col(c)) for c in rows.columns if c != SEQ))

    def _about(self, table: str, version: int | None = None) -> dict:
        number, state = self._state(version)
        if table not in state:
            raise FileNotFoundError(f"no table {table} in {self.root}")
        if version is None:
            self._seen[table] = number
        return state[table]

    # Reading

    def versions(self) -> dict[str, int]:
        """How often each table was written anew, from 0."""
        return {t: about["version"] for t, about in self._state()[1].items()}

    def exists(self, table: str) -> bool:
        return table in self._state()[1]

    def read(self, table: str, *groups: str, version: int | None = None) -> DataFrame:
        """A table without the groups that lie apart, or with those named; ``version`` is an earlier commit's number."""
        return self._read(table, self._about(table, version), groups)

    def full(self, table: str, version: int | None = None) -> DataFrame:
        """A table with all its columns, as they were written."""
        about = self._about(table, version)
        return self._read(table, about, tuple(g for g in about["groups"] if g != "main")).select(*about["columns"])

    def _read(self, table: str, about: dict, groups: tuple[str, ...]) -> DataFrame:
        out = self._merged(table, "main", about)
        for g in groups:
            out = out.join(self._merged(table, g, about), about["key"], "left")
        return out

    def _outline(self, table: str, about: dict) -> DataFrame:
        """A table in all its columns, those that lie apart null: no file of theirs is read."""
        kinds = {f.name: f.dataType for x in about["groups"].values() for f in StructType.fromJson(json.loads(x["schema"]))}
        main = self._merged(table, "main", about)
        return main.select(*(F.col(c) if c in main.columns else F.lit(None).cast(kinds[c]).alias(c) for c in about["columns"]))

    def column_group(self, table: str, column: str) -> str | None:
        """The group that a column lies in; None if the table doesn't have it."""
        about = self._about(table)
        return next((g for g, x in about["groups"].items() if column in StructType.fromJson(json.loads(x["schema"])).names), None)

    def groups_of(self, table: str, columns: list[str]) -> list[str]:
        """The groups apart that some columns lie in."""
        return sorted({g for c in columns if (g := self.column_group(table, c)) not in (None, "main")})

    def add_column(self, table: str, column: str, kind: str, group: str = "main") -> None:
        """A further column, null so far. Nothing is written: files that don't have it read as null."""

        def change(state: dict, number: int) -> dict | None:
            about = state[table]
            if column in about["columns"]:
                return None
            to = about["groups"].get(group) or about["groups"]["main"]
            schema = StructType.fromJson(json.loads(to["schema"])).add(StructType.fromDDL(f"`{column}` {kind}")[0])
            to["schema"] = schema.json()
            about["columns"].append(column)
            return state

        self._commit(change)

    def has_batch(self, table: str, batch: int, writer: str = "") -> bool:
        return self._state()[1].get(table, {}).get("writers", {}).get(writer, -1) >= batch

    # Changes

    def write(self, **tables: DataFrame) -> None:
        """New versions of some tables, current in one step. A table that another writer has changed since this
        store last read it is a conflict; batches that it has taken stay known."""
        seen = {t: self._seen.get(t) for t in tables}
        made = {t: self._made(t, df) for t, df in tables.items()}

        def change(state: dict, number: int) -> dict:
            for t, about in made.items():
                before = state.get(t, {})
                if before and seen[t] is not None and before["changed"] > seen[t]:
                    raise Conflict(f"{t} has changed since it was read")
                for g in about["groups"].values():
                    g["segs"] = [[s, number] for s, _ in g["segs"]]
                state[t] = about | {"version": before.get("version", -1) + 1, "writers": before.get("writers", {}), "changed": number}
                self._seen[t] = number
            return state

        self._commit(change)

    def _made(self, table: str, df: DataFrame, about: dict | None = None) -> dict:
        """Write rows as a segment of each group; what the log says of them. ``about``: the table they join."""
        layout = self._layout(table, df.columns) if about is None else (self.layouts[table] if about["key"] else None)
        if about is not None:
            df = df.select(*about["columns"])
            layout = layout and Layout(about["key"], {g: tuple(StructType.fromJson(json.loads(x["schema"])).names) for g, x in about["groups"].items() if g != "main"}, layout.order, layout.blooms, about["buckets"])
        apart = {g: [c for c in cs if c in df.columns and c != layout.key] for g, cs in layout.groups.items()} if layout else {}
        apart = {g: cs for g, cs in apart.items() if cs}
        main = [c for c in df.columns if not any(c in cs for cs in apart.values())]
        groups, name = {}, uuid.uuid4().hex
        for g, cs in {"main": main, **{g: [layout.key, *cs] for g, cs in apart.items()}}.items():
            rows = df.select(*cs)
            self._write(rows, f"{self.root}/{table}/{g}/seg={name}", layout)
            groups[g] = {"schema": rows.schema.json(), "segs": [[name, 0]]}
        return {"columns": df.columns, "key": layout.key if layout else None, "buckets": layout.buckets if layout else 0, "groups": groups, "deltas": []}

    def append(self, table: str, rows: DataFrame | Callable[[DataFrame], DataFrame], batch: int | None = None, writer: str = "") -> None:
        """Add rows, or what a function makes of the table as it is, columns that lie apart left null (ids that go on from its highest, say).

        A batch is taken once: a writer numbers its own upwards, and the last one is kept with the table,
        whatever else is written. A function is asked again when another commit came first.
        """

        def change(state: dict, number: int) -> dict | None:
            if table not in state:
                raise FileNotFoundError(f"no table {table} in {self.root}")
            about = state[table]
            if batch is not None and about["writers"].get(writer, -1) >= batch:
                return None
            new = rows(self._outline(table, about)) if callable(rows) else rows
            made = self._made(table, new, about)
            for g, x in made["groups"].items():
                about["groups"][g]["segs"].append([x["segs"][0][0], number])
            if batch is not None:
                about["writers"][writer] = batch
            about["changed"] = number
            return state

        self._commit(change)

    def change(self, table: str, changes: DataFrame, key: str | None = None) -> None:
        """New values (null too) for the rows that ``changes`` names by key; only these are written."""
        about = self._about(table)
        if about["key"] is None:
            raise ValueError(f"{table} has no key: write it anew")
        key = key or about["key"]
        if key != about["key"]:
            changes = changes.withColumnRenamed(key, about["key"])
        columns = [c for c in changes.columns if c != about["key"]]
        where = {c: g for g, x in about["groups"].items() for c in StructType.fromJson(json.loads(x["schema"])).names if c != about["key"]}
        kinds = {f.name: f.dataType for x in about["groups"].values() for f in StructType.fromJson(json.loads(x["schema"]))}
        if unknown := [c for c in columns if c not in where]:
            raise ValueError(f"{table} has no column {', '.join(unknown)}")
        new = []
        for g in sorted({where[c] for c in columns}):
            mine = [c for c in columns if where[c] == g]
            name = uuid.uuid4().hex
            changes.select(F.col(about["key"]).cast(kinds[about["key"]]), *(F.col(c).cast(kinds[c].simpleString()) for c in mine)).write.parquet(f"{self.root}/{table}/_changes/{name}")
            new.append({"group": g, "name": name, "columns": mine})
        self._add(table, new)

    def delete(self, table: str, keys: DataFrame) -> None:
        """Rows whose key is in ``keys`` go, from all groups. A key may be used again afterwards."""
        about = self._about(table)
        if about["key"] is None:
            raise ValueError(f"{table} has no key: write it anew")
        name = uuid.uuid4().hex
        keys.select(about["key"]).write.parquet(f"{self.root}/{table}/_changes/{name}")
        self._add(table, [{"group": None, "name": name, "columns": []}])

    def _add(self, table: str, deltas: list[dict]) -> None:
        def change(state: dict, number: int) -> dict:
            state[table]["deltas"] += [d | {"seq": number} for d in deltas]
            state[table]["changed"] = number
            return state

        self._commit(change)

    def compact(self, table: str) -> None:
        """Fold the changes into the groups that they concern, and small segments into one. Groups without any stay."""

        def change(state: dict, number: int) -> dict | None:
            about = state[table]
            if about["key"] is None:
                return None
            touched = {d["group"] for d in about["deltas"]}
            work = [g for g, x in about["groups"].items() if None in touched or g in touched or len(x["segs"]) > 1]
            if not work:
                return None
            folded = {g: self._merged(table, g, about) for g in work}
            for g, df in folded.items():
                name = uuid.uuid4().hex
                layout = self.layouts[table]
                self._write(df, f"{self.root}/{table}/{g}/seg={name}", Layout(about["key"], {}, layout.order, layout.blooms, about["buckets"]))
                about["groups"][g]["segs"] = [[name, number]]
            about["deltas"] = []
            about["changed"] = number
            return state

        self._commit(change)

    def vacuum(self, keep: int = 2, older_than: float = 86_400) -> int:
        """Remove commits but the last ``keep``, and folders that none of these names; the number of folders that went.

        Folders of writers still at work are not named yet: only those are removed that are older, in seconds.
        """
        numbers = self.log()
        for n in numbers[:-keep]:
            p, fs = self._path(f"{self.root}/_log/{n}.json")
            fs.delete(p, False)
        named: set[str] = set()
        for n in numbers[-keep:]:
            for t, about in self._state(n)[1].items():
                named |= {f"{t}/{g}/seg={s}" for g, x in about["groups"].items() for s, _ in x["segs"]} | {f"{t}/_changes/{d['name']}" for d in about["deltas"]}
        gone, now = 0, time.time()
        for t, _ in self._list(self.root):
            for g, _ in self._list(f"{self.root}/{t}") if t != "_log" else []:
                for s, at in self._list(f"{self.root}/{t}/{g}"):
                    if f"{t}/{g}/{s}" not in named and now - at >= older_than:
                        p, fs = self._path(f"{self.root}/{t}/{g}/{s}")
                        fs.delete(p, True)
                        gone += 1
        return gone
