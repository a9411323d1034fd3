"""A versioned store of cubes on plain Parquet.

    <path>/catalog.json                              the definition of the cube
    <path>/manifest/<seq>.json                       one file a commit, a line a patch; the file number is the commit
    <path>/data/fragment=<id>/chunk_t=…/chunk_y=…/   cells, written once and never changed
    <path>/data/fragment=<id>-<n>/chunk_t=…/block_y=…/block_x=…/   the same for small chunks, n by n of them to a folder

A commit is the creation of the next manifest file, which fails if it exists: that is the only point of contention. What
no manifest names does not exist for readers, and a reader that pins a commit sees no later one. A compaction says which
commits it stands for; it takes their place in the order, so commits made meanwhile keep theirs, and their fragments are
not read by snapshots that have it. All files are reached through Hadoop's file systems, so the store lies wherever
Spark can read.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grid import Window, chunk_of
from ..operators.cells import value, with_chunks
from ..operators.pruning import missing
from .definitions import TOP, CubeDef

MANIFEST = "cube STRING, patch_id STRING, commit_seq BIGINT, pos INT, commit_ts TIMESTAMP, fragment STRING, message STRING, replaces BIGINT, whole BOOLEAN"
TRIES = 100
#: Rows of pixels of a chunk that one task writes.
ROWS = 512
#: Pixels along the edge of what one folder holds, if chunks are smaller: a folder costs as much as some 100,000 cells.
BLOCK = 1024
#: What stands for the patches of a compaction in its cells.
COMPACTED = "compacted"


class StoreError(Exception):
    pass


class ConflictError(StoreError):
    """Another writer made the same commit first."""


class NotCreatedError(StoreError):
    pass


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Files

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._p(name))

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._p(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str, overwrite: bool) -> None:
        stream = self._fs.create(self._p(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _commits(self) -> list[int]:
        if not self._exists("manifest"):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p("manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    # Definition

    @property
    def created(self) -> bool:
        return self._exists("catalog.json")

    def assert_created(self) -> None:
        if not self.created:
            raise NotCreatedError(f"no cube at {self.path}; create it first")

    def create(self, definition: CubeDef, overwrite: bool = False, exists_ok: bool = False) -> None:
        """Write the definition; no data. An existing cube is left alone with exists_ok, which wins over overwrite, replaced
        with overwrite, and otherwise a FileExistsError."""
        if self.created:
            if exists_ok:
                return
            if not overwrite:
                raise FileExistsError(f"there is a cube at {self.path}")
            for part in ("manifest", "data", "catalog.json"):
                self._fs.delete(self._p(part), True)
        self._fs.mkdirs(self._p("manifest"))
        self._write("catalog.json", json.dumps(definition.to_dict()), True)

    def definition(self) -> CubeDef:
        self.assert_created()
        return CubeDef.from_dict(json.loads(self._read("catalog.json")))

    # Versions

    def snapshot(self) -> int:
        """Number of the last commit, 0 for none."""
        return max(self._commits(), default=0)

    def _log(self, snapshot: int | None) -> DataFrame:
        """All rows of the manifest up to a commit, compactions included."""
        commits = [c for c in self._commits() if snapshot is None or c <= snapshot]
        if not commits:
            return self.spark.createDataFrame([], MANIFEST)
        rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")
        return rows.filter(F.col("commit_seq") <= commits[-1])

    def manifest(self, snapshot: int | None = None) -> DataFrame:
        """Committed patches, each with the commit that brought it; in order of (commit_seq, pos)."""
        return self._log(snapshot).filter("replaces IS NULL").drop("replaces", "whole")

    def loaded_patches(self) -> list[str]:
        return [r["patch_id"] for r in self.manifest().orderBy("commit_seq", "pos").select("patch_id").collect()]

    def live(self, snapshot: int | None = None) -> DataFrame:
        """The patches whose cells make up a snapshot: fragment, patch_id, commit_seq (their place in the order) and pos.

        That is the compaction that stands for the most commits, the later of equal ones, and all commits after those.
        """
        rows = self._log(snapshot)
        last = rows.agg(F.max(F.struct("replaces", "commit_seq")).alias("m")).select(F.coalesce("m.replaces", F.lit(0)).alias("_to"), F.col("m.commit_seq").alias("_by"))
        rows = rows.crossJoin(F.broadcast(last))  # one row
        keep = F.when(F.col("replaces").isNull(), F.col("commit_seq") > F.col("_to")).otherwise(F.col("commit_seq") == F.col("_by"))
        return rows.filter(keep).select("fragment", "patch_id", F.coalesce("replaces", "commit_seq").alias("commit_seq"), "pos", F.coalesce("whole", F.lit(False)).alias("whole"))

    def commit(self, patch_ids: Iterable[str], fragment: str, message: str = "", base: int | None = None, replaces: int | None = None, whole: bool = False) -> int:
        """Make a fragment visible as the commit after `base` (default: the last). ConflictError if that exists.

        `replaces`: the fragment has all that the commits up to that one have. `whole`: it has cells of these patches alone.
        """
        seq = (self.snapshot() if base is None else base) + 1
        now = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime()) + "Z"
        cube = self.definition().name
        lines = [json.dumps({"cube": cube, "patch_id": p, "commit_seq": seq, "pos": i, "commit_ts": now, "fragment": fragment, "message": message, "replaces": replaces, "whole": whole}) for i, p in enumerate(patch_ids)]
        try:
            self._write(f"manifest/{seq:020d}.json", "\n".join(lines) + "\n", False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                raise ConflictError(f"commit {seq} exists") from e
            raise
        return seq

    # Data

    def write_fragment(self, cells: DataFrame) -> str:
        """Write cells (patch_id, it, iy, ix, channels) as a new fragment, chunk by chunk or block by block. Not yet visible."""
        d, fragment = self.definition(), uuid.uuid4().hex
        n = max(1, BLOCK // d.chunk)
        out = with_chunks(cells, d.chunk).withColumn("chunk_t", F.coalesce("it", F.lit(0)))
        for c in d.channels:
            if c.dtype in TOP:
                fits = F.col(c.name).isNull() | F.col(c.name).between(0, TOP[c.dtype])
                out = out.withColumn(c.name, F.when(fits, F.col(c.name)).otherwise(F.raise_error(F.lit(f"{c.name} is out of range for {c.dtype}"))))
        chunks = ["chunk_t", "chunk_y", "chunk_x"]
        if n > 1:
            out = out.withColumns({f"block_{c}": chunk_of(F.col(f"i{c}"), n * d.chunk) for c in "yx"})
            chunks, fragment = ["chunk_t", "block_y", "block_x"], f"{fragment}-{n}"
        out = out.select("patch_id", "it", "iy", "ix", *[F.col(c.name).cast(c.field().dataType).alias(c.name) for c in d.channels], *chunks)
        # A chunk or block is written by tasks of ROWS rows of pixels each, in row order, so that row groups can be skipped by iy.
        out = out.repartition(*chunks, F.floor(F.col("iy") / ROWS)).sortWithinPartitions(*chunks, "iy", "ix")
        out.write.mode("error").partitionBy(*chunks).option("compression", "zstd").parquet(f"{self.path}/data/fragment={fragment}")
        return fragment

    def write_patches(self, patches: list[str] | DataFrame, cells: DataFrame, message: str = "", base: int | None = None) -> list[str]:
        """Write and commit the cells of patches, each patch at most once. Returns the ids committed now.

        If another writer commits first, the patches that it brought are left out and the commit is tried again. `base`:
        none of these patches is in the store up to this commit; otherwise what there is is looked up.
        """
        new = patches if isinstance(patches, list) else [r["patch_id"] for r in patches.select("patch_id").collect()]
        new = list(dict.fromkeys(new))
        if base is None:
            base = self.snapshot()
            held = self.manifest(base)
            new, cells = self._lacking(new, held), missing(cells, held)
        if not new:
            return []
        fragment, written = self.write_fragment(cells), len(new)
        for _ in range(TRIES):
            try:
                self.commit(new, fragment, message or f"Write {len(new)} patches", base, whole=len(new) == written)
                return new
            except ConflictError:
                since, base = base, self.snapshot()
                new = self._lacking(new, self.manifest(base).filter(F.col("commit_seq") > since))
                if not new:
                    return []
        raise ConflictError(f"no commit in {TRIES} tries")

    def _lacking(self, ids: list[str], held: DataFrame) -> list[str]:
        """Those of the ids, in order, that are not in `held`. Only ids asked for reach the driver."""
        asked = self.spark.createDataFrame([(p,) for p in ids], "patch_id string")
        there = {r["patch_id"] for r in asked.join(held.select("patch_id"), "patch_id", "left_semi").collect()} if ids else set()
        return [p for p in ids if p not in there]

    def raw(self, snapshot: int | None = None, ordered: bool = True, window: Window | None = None) -> DataFrame:
        """Committed cells with commit_seq and pos, not yet overlaid, of the live fragments. Filters on chunk columns prune partitions.

        `window`: blocks of small chunks that do not meet it are not read, which filters on chunks cannot say; cells are not cropped.

        Without `ordered` there is no commit_seq and pos, and cells are not even joined with the manifest unless a lost race
        left some in a fragment that are not committed.
        """
        d = self.definition()
        files = T.StructType([T.StructField("patch_id", T.StringType()), *d.cell_schema().fields])
        keys = T.StructType.fromDDL("fragment STRING, chunk_t INT, chunk_y INT, chunk_x INT")
        live = self.live(snapshot)
        fragments = {r["fragment"]: r["w"] for r in live.groupBy("fragment").agg(F.bool_and("whole").alias("w")).collect()}  # one a commit since the last compaction
        kinds: dict[int, list[str]] = {}
        for f in sorted(fragments):
            if self._exists(f"data/fragment={f}"):
                n = re.fullmatch(r"[0-9a-f]{32}-(\d+)", f)
                kinds.setdefault(int(n[1]) if n else 1, []).append(f"{self.path}/data/fragment={f}")
        if not kinds:
            return self.spark.createDataFrame([], T.StructType([*files.fields, *keys.fields, *T.StructType.fromDDL("commit_seq BIGINT, pos INT").fields]))
        cells = reduce(DataFrame.unionByName, [self._scan(n, paths, files, keys, window) for n, paths in sorted(kinds.items())])
        if not ordered and all(fragments.values()):
            return cells
        return cells.join(live.drop("whole"), ["fragment", "patch_id"])

    def _scan(self, n: int, paths: list[str], files: T.StructType, keys: T.StructType, window: Window | None) -> DataFrame:
        """Cells of fragments that hold n by n chunks to a folder."""
        read, edge = self.spark.read.option("basePath", f"{self.path}/data"), self.definition().chunk
        if n == 1:
            return read.schema(T.StructType([*files.fields, *keys.fields])).parquet(*paths)
        parts = T.StructType.fromDDL("fragment STRING, chunk_t INT, block_y INT, block_x INT")
        cells = read.schema(T.StructType([*files.fields, *parts.fields])).parquet(*paths)
        if window is not None:
            for c, first, last in (("y", window.iy0, window.iy1 - 1), ("x", window.ix0, window.ix1 - 1)):
                cells = cells.filter(F.col(f"block_{c}").between(first // (n * edge), last // (n * edge)))
        return with_chunks(cells, edge).select(*files.names, *keys.names)

    def overlaid(self, cells: DataFrame, overlaps: bool = True) -> DataFrame:
        """One row a cell: of each channel the last committed valid value. Without overlaps nothing is aggregated."""
        d, keys = self.definition(), ["chunk_t", "chunk_y", "chunk_x", "it", "iy", "ix"]
        if not overlaps:
            return cells.select(*keys, *d.channel_names)
        aggs = []
        for c in d.channels:
            v = value(F.col(c.name)) if c.dtype.startswith("float") else F.col(c.name)
            aggs.append(F.max_by(v, F.when(v.isNotNull(), F.struct("commit_seq", "pos"))).alias(c.name))
        return cells.groupBy(*keys).agg(*aggs)

    def compact(self) -> str | None:
        """Rewrite all committed cells, overlaid, as one fragment that later snapshots read instead.

        Earlier snapshots still read what they did. What others commit meanwhile comes after it in the order, and of two
        compactions at a time readers take the one that stands for more. Both make just a later commit.
        """
        pinned = self.snapshot()
        if not pinned:
            return None
        cells = self.overlaid(self.raw(pinned)).drop("chunk_t", "chunk_y", "chunk_x").withColumn("patch_id", F.lit(COMPACTED))
        fragment = self.write_fragment(cells)
        for _ in range(TRIES):
            try:
                self.commit([COMPACTED], fragment, f"Compact commits to {pinned}", self.snapshot(), pinned, True)
                return fragment
            except ConflictError:
                continue
        raise ConflictError(f"no commit in {TRIES} tries")

    def vacuum(self, hours: float = 168.0) -> list[str]:
        """Delete fragments that no commit names and that are older than `hours`, so that no writer may still be at them."""
        if not self._exists("data"):
            return []
        named = {r["fragment"] for r in self._log(None).select("fragment").distinct().collect()}
        gone, now = [], time.time()
        for status in self._fs.listStatus(self._p("data")):
            name = status.getPath().getName()
            if name.startswith("fragment=") and name[9:] not in named and status.getModificationTime() / 1000 < now - hours * 3600:
                self._fs.delete(status.getPath(), True)
                gone.append(name[9:])
        return gone
