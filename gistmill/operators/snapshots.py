"""A store of several tables whose changes come all at once: snapshots, deltas with tombstones, compaction.

A change writes only what it changes, as files of rows and files of keys that are gone, and becomes visible in all tables
by one new version. A reader keeps its version. Reading merges: the base without the keys that any delta names, and of
the deltas each key's last row. Compaction makes the merged tables the next base. A change that fails before its commit
leaves files that no version names.

Reading costs one anti-join of the base with the changed keys and one grouping of the deltas, whatever their number.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.operators import store
from gistmill.operators.versions import Versions

BASE, ROWS, GONE = "base", "rows", "gone"
KEYS = {"nodes": ("id",), "edges": ("src", "type", "dst"), "embeddings": ("node_id",)}
MANIFEST = "table string, kind string, name string, seq int"


class Snapshot:
    """All tables as they were at one version."""

    def __init__(self, owner: VersionedStore, version: int, rows: list) -> None:
        self.owner, self.version, self.rows = owner, version, rows

    def _read(self, table: str, name: str, keys_only: bool = False) -> DataFrame:
        schema = self.owner.spark.createDataFrame([], self.owner.schemas[table]).schema
        if keys_only:
            schema = type(schema)([schema[k] for k in self.owner.keys[table]])
        return self.owner.spark.read.schema(schema).parquet(f"{self.owner.root}/{table}/{name}")

    def table(self, table: str) -> DataFrame:
        """The merged table."""
        keys, mine = list(self.owner.keys[table]), sorted((r for r in self.rows if r.table == table), key=lambda r: r.seq)
        empty = self.owner.spark.createDataFrame([], self.owner.schemas[table])
        bases = [self._read(table, r.name) for r in mine if r.kind == BASE]
        base = bases[0] if bases else empty
        row = F.struct(*empty.columns).alias("_row")
        deltas = [(self._read(table, r.name).select(*keys, row) if r.kind == ROWS else self._read(table, r.name, True).withColumn("_row", F.lit(None).cast(empty.select(row).schema[0].dataType))).withColumn("_seq", F.lit(r.seq)) for r in mine if r.kind != BASE]
        if not deltas:
            return base
        last = reduce(DataFrame.unionByName, deltas).groupBy(*keys).agg(F.max(F.struct("_seq", F.col("_row").isNotNull().alias("_here"))).alias("_m"), F.max_by("_row", "_seq").alias("_row"))
        return base.join(last.select(*keys), keys, "left_anti").select(*empty.columns).unionByName(last.where("_m._here").select("_row.*"))

    def __getitem__(self, table: str) -> DataFrame:
        return self.table(table)


class Change:
    """What one version changes, against the snapshot it began from. Nothing is seen of it before commit()."""

    def __init__(self, base: Snapshot) -> None:
        self.base, self.owner = base, base.owner
        self.made: list[tuple[str, str, str, int]] = []

    def _write(self, table: str, kind: str, rows: DataFrame) -> None:
        name = f"{kind}_{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.owner.root}/{table}/{name}")
        seq = max((r.seq for r in self.base.rows), default=0) + 1 + len(self.made)
        self.made.append((table, kind, name, seq))

    def upsert(self, table: str, rows: DataFrame) -> Change:
        """Rows that are new or take the place of those of their keys; of several of one key one stays."""
        schema = self.owner.spark.createDataFrame([], self.owner.schemas[table]).schema
        shaped = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        self._write(table, ROWS, shaped.dropDuplicates(list(self.owner.keys[table])))
        return self

    def delete(self, table: str, keys: DataFrame) -> Change:
        self._write(table, GONE, keys.select(*self.owner.keys[table]).distinct())
        return self

    def delete_nodes(self, ids: DataFrame) -> Change:
        """Nodes with their edges either way and their vectors."""
        gone = ids.select(F.col("id").alias("_id")).distinct()
        edges = self.base["edges"]
        near = edges.join(gone, edges["src"] == gone["_id"], "left_semi").unionByName(edges.join(gone, edges["dst"] == gone["_id"], "left_semi"))
        self.delete("edges", near).delete("embeddings", gone.select(F.col("_id").alias("node_id")))
        return self.delete("nodes", gone.select(F.col("_id").alias("id")))

    def upsert_edges(self, edges: DataFrame, nodes: DataFrame | None = None) -> Change:
        """Edges whose ends are nodes of the base or of the given new ones; raises, and so leaves no trace, if not."""
        known = self.base["nodes"].select("id")
        known = known if nodes is None else known.unionByName(nodes.select("id"))
        if store.missing_ends(edges, known).limit(1).count():
            raise ValueError("an edge has an end that is no node")
        return self.upsert("edges", edges)

    def commit(self) -> Snapshot:
        """The next version; raises Conflict if another one has come since the base."""
        rows = [(r.table, r.kind, r.name, r.seq) for r in self.base.rows] + self.made
        return self.owner.snapshot(self.owner.versions.commit(self.base.version, rows))


class VersionedStore:
    """Tables below a folder that all executors share; schemas by table, and the columns that name a row."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], keys: dict[str, tuple[str, ...]] | None = None) -> None:
        self.spark, self.root, self.schemas, self.keys = spark, root.rstrip("/"), schemas, keys or KEYS
        self.versions = Versions(spark, root, MANIFEST)

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version, the last one if none is named."""
        return Snapshot(self, *self.versions.rows(version))

    def change(self) -> Change:
        return Change(self.snapshot())

    def compact(self) -> Snapshot:
        """The same tables as one base each; older versions stay readable."""
        now, rows = self.snapshot(), []
        for table in self.schemas:
            name = f"{BASE}_{uuid.uuid4().hex}"
            now[table].write.parquet(f"{self.root}/{table}/{name}")
            rows.append((table, BASE, name, 0))
        return self.snapshot(self.versions.commit(now.version, rows))
