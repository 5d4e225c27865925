"""Keyed tables kept by generation: each owner (a repository) has its rows of one generation, and a manifest, written last, says which.

A write that breaks off leaves files that no manifest names, so readers go on with the old rows. An owner whose rows are what
they were is left alone, so a repeated write changes nothing; of one that changed the old rows, stale ones included, are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

#: Folders that a generation's owners are spread over, so that a few owners are read without the others.
BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def bucket_of(owner: Column) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(BUCKETS)).cast("int")


class GenerationStore:
    """Rows with `owner` and `keys` (unique in an owner) under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: str, owner: str = "repo_id", keys: tuple[str, ...] = ("id",)):
        self.spark, self.path, self.schema, self.owner, self.keys = spark, path.rstrip("/"), schema, owner, tuple(keys)
        kind = next(x.dataType.simpleString() for x in spark.createDataFrame([], schema).schema if x.name == owner)
        self._manifest_schema = f"{owner} {kind}, generation string, digest decimal(38,0), n long"

    # ------------------------------------------------------------ manifests

    def versions(self) -> list[int]:
        """Versions of the manifest that were written to their end, rising."""
        fs, p = _fs(self.spark, f"{self.path}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath() for s in fs.listStatus(p)]
        done = [n.getName() for n in names if fs.exists(_fs(self.spark, f"{n}/_SUCCESS")[1])]
        return sorted(int(n.removeprefix("v")) for n in done if n.startswith("v"))

    def manifest(self) -> DataFrame:
        """(owner, generation, digest, n) of what readers see."""
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], self._manifest_schema)
        return self.spark.read.schema(self._manifest_schema).parquet(f"{self.path}/manifest/v{found[-1]}")

    def _publish(self, manifest: DataFrame) -> None:
        # Versions of broken writes are left behind; theirs is not used again.
        fs, p = _fs(self.spark, f"{self.path}/manifest")
        taken = [int(s.getPath().getName()[1:]) for s in fs.listStatus(p)] if fs.exists(p) else []
        manifest.write.parquet(f"{self.path}/manifest/v{max(taken, default=0) + 1}")

    # ------------------------------------------------------------ rows

    def digests(self, rows: DataFrame) -> DataFrame:
        """(owner, digest, n): of an owner's rows whatever their order; sums of two hashes, so large owners are added up where their rows are."""
        columns = sorted(c for c in rows.columns if c != self.owner)
        h = F.xxhash64(*columns).cast("decimal(38,0)") * 3 + F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)")
        return rows.groupBy(self.owner).agg(F.sum(h.cast("decimal(28,0)")).cast("decimal(38,0)").alias("digest"), F.count(F.lit(1)).alias("n"))

    def read(self, owners: DataFrame | None = None) -> DataFrame:
        """The rows of the active generations; with `owners` only theirs, from the folders that hold them."""
        active = self.manifest().select(self.owner, "generation")
        columns = self.spark.createDataFrame([], self.schema).columns
        if owners is not None:
            active = active.join(owners.select(self.owner).distinct(), self.owner, "left_semi")
        # Folders are few, at most generations times buckets; their names are literals, so the scan lists no others.
        places = [tuple(r) for r in active.select("generation", bucket_of(F.col(self.owner)).alias("bucket")).distinct().collect()]
        if not places:
            return self.spark.createDataFrame([], self.schema)
        data = self.spark.read.schema(f"{self.schema}, generation string, bucket int").option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/generation={g}/bucket={b}" for g, b in sorted(places)])
        return data.join(active, [self.owner, "generation"], "left_semi").select(*columns)

    def write(self, rows: DataFrame, generation: str, scope: DataFrame | None = None) -> DataFrame:
        """Makes rows the whole content of their owners, and of those in `scope` (owner) that have no rows, whose rows go. Gives what changed: (owner, inserted, updated, deleted).

        Owners outside rows and scope keep what they have. A generation's name must be new.
        """
        fs, p = _fs(self.spark, f"{self.path}/data/generation={generation}")
        old = self.manifest()
        if old.where(F.col("generation") == generation).limit(1).count():
            raise ValueError(f"generation {generation} is in use")
        if fs.exists(p):
            fs.delete(p, True)  # of a write that broke off
        now = self.digests(rows)
        same = now.join(old.select(self.owner, "digest", "n"), [self.owner, "digest", "n"], "left_semi").select(self.owner)
        changed = rows.join(same, self.owner, "left_anti")
        changed.withColumns({"generation": F.lit(generation), "bucket": bucket_of(F.col(self.owner))}).repartition("bucket", F.xxhash64(*self.keys) % 16).write.partitionBy("generation", "bucket").mode("append").parquet(f"{self.path}/data")
        fresh = self.digests(changed).select(self.owner, F.lit(generation).alias("generation"), "digest", "n")
        gone = old.select(self.owner).join(fresh, self.owner, "left_semi")
        if scope is not None:
            gone = gone.unionByName(scope.select(self.owner).distinct().join(now, self.owner, "left_anti"))
        report = self._changes(changed, gone.unionByName(fresh.select(self.owner)).distinct())
        kept = old.join(gone, self.owner, "left_anti")
        # The swap: from here on readers see the new rows.
        if not report.isEmpty():
            self._publish(kept.unionByName(fresh).select(*[c.split()[0] for c in self._manifest_schema.split(", ")]))
        return report

    def _changes(self, new: DataFrame, owners: DataFrame) -> DataFrame:
        on, rest = [self.owner, *self.keys], sorted(c for c in new.columns if c not in (self.owner, *self.keys))
        a = self.read(owners).select(*on, F.xxhash64(*rest).alias("before")) if rest else self.read(owners).select(*on, F.lit(0).alias("before"))
        b = new.select(*on, (F.xxhash64(*rest) if rest else F.lit(0)).alias("after"))
        both = a.join(b, on, "full")
        n = lambda c: F.count(F.when(c, 1))
        found = both.groupBy(self.owner).agg(n(F.col("before").isNull()).alias("inserted"), n(F.col("before") != F.col("after")).alias("updated"), n(F.col("after").isNull()).alias("deleted"))
        return cut(found.where("inserted + updated + deleted > 0"))

    def vacuum(self) -> list[str]:
        """Deletes generations that the manifest doesn't name, and older manifests; gives the generations' names."""
        used = {r[0] for r in self.manifest().select("generation").distinct().collect()}
        fs, p = _fs(self.spark, f"{self.path}/data")
        names = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
        gone = [n for n in names if n.getName().startswith("generation=") and n.getName().removeprefix("generation=") not in used]
        for n in gone:
            fs.delete(n, True)
        for v in self.versions()[:-1]:
            fs.delete(_fs(self.spark, f"{self.path}/manifest/v{v}")[1], True)
        return sorted(n.getName().removeprefix("generation=") for n in gone)


def write_graph(nodes: GenerationStore, edges: GenerationStore, new_nodes: DataFrame, new_edges: DataFrame, generation: str, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes first, then the edges (src, dst) both of whose ends are among all active nodes (id); what changed in each. Edges of other owners that lose an end go when their owner is written again."""
    first = nodes.write(new_nodes, generation, scope)
    ids = nodes.read().select("id").distinct()
    whole = new_edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return first, edges.write(whole.select(*new_edges.columns), generation, scope)
