"""The memory as one object: recall, write, organise and govern over snapshots in a folder.

Every change writes a new snapshot folder and then moves the name of the current one in a small pointer table, so readers
see the old or the new state, never a mixture; nothing is overwritten while it is read. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import cloud, governance, records, remember, scopes, search
from engram.streaming import recalls

SCHEMA = "id string, scope_type string, scope_id string, scope_key string, kind string, content string, summary string, confidence double, importance double, source string, tags array<string>, metadata string, created_at timestamp, updated_at timestamp"


class Memory:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- snapshots

    def _current(self) -> int:
        """The number of the newest complete snapshot; 0 before the first."""
        try:
            return self.spark.read.schema("version long").json(f"{self.folder}/versions").agg(F.max("version")).first()[0] or 0
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return 0
            raise

    def items(self, version: int | None = None) -> DataFrame:
        n = self._current() if version is None else version
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/items-{n}") if n else self.spark.createDataFrame([], SCHEMA)

    def save(self, items: DataFrame) -> int:
        """``items`` as the next snapshot, ordered by scope within files so that a scope's rows lie together."""
        n = self._current() + 1
        have = items.columns
        for f in self.spark.createDataFrame([], SCHEMA).schema.fields:
            if f.name not in have:
                items = items.withColumn(f.name, F.lit(None).cast(f.dataType))
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        items.select(*names).sortWithinPartitions("scope_key").write.mode("overwrite").parquet(f"{self.folder}/items-{n}")
        self.spark.createDataFrame([(n,)], "version long").write.mode("append").json(f"{self.folder}/versions")
        return n

    # -- recall

    def get(self, record_id: str) -> DataFrame:
        return self.items().filter(F.col("id") == record_id)

    def list(self, requested: DataFrame | None = None, **how) -> DataFrame:
        r = self.items()
        return records.listing(r if requested is None else scopes.in_scopes(r, requested), **how)

    def search(self, queries: DataFrame, now: Column, **how) -> DataFrame:
        return search.search(self.items(), queries, now, **how)

    def recall(self, queries: DataFrame, now: Column, most_chars: int = 4000, **how) -> DataFrame:
        r = self.items()
        return search.recall_context(search.search(r, queries, now, **how), r, most_chars)

    # -- write

    def remember(self, inputs: DataFrame, now: Column, mode: str = "threshold") -> int:
        """Inputs (ord, scope_type, scope_id, kind, content, summary, tags, importance, confidence, source, metadata) written in their order."""
        return self.save(remember.remember(inputs, self.items(), now, mode))

    def update(self, patches: DataFrame, now: Column) -> int:
        return self.save(records.update(self.items(), patches, now))

    def recalled(self, hits: DataFrame) -> int:
        """Counts hits (rank, id, ts) of recalls: the best three of each, a record again only after five minutes, into the records' metadata."""
        return self.save(recalls.written_back(self.items(), recalls.totals(recalls.of_hits(hits))))

    def forget(self, ids: DataFrame) -> int:
        """Records gone for good, and gone from the supports of others."""
        return self.save(records.forget(self.items(), ids))

    # -- organise and govern

    def decay(self, now: Column, **how) -> int:
        hit = records.decay(self.items(), now, **how).select("id", F.col("importance").alias("lower"))
        return self.save(self.items().join(hit, "id", "left").withColumn("importance", F.coalesce("lower", "importance")).drop("lower"))

    def pin(self, ids: DataFrame, on: bool = True) -> int:
        return self.save(records.pinned(self.items(), ids, on))

    def attribute(self, ids: DataFrame) -> int:
        hit = records.attributed(self.items(), ids).select("id", F.col("importance").alias("raised"))
        return self.save(self.items().join(hit, "id", "left").withColumn("importance", F.coalesce("raised", "importance")).drop("raised"))

    def reflect(self, documents: DataFrame, texts: DataFrame, scope: tuple[str, str], now: Column, **how) -> int:
        """Principles of clusters (texts by tag, from a model) written; nothing while the scope's document is fresh. ``records.reflected_documents`` has the documents
        as they are to be kept then, with the mark of this run."""
        made = records.reflected(self.items(), documents, texts, scope, now, **how)
        return self.save(remember.remember(made, self.items(), now))

    def consolidate(self, plan: DataFrame, now: Column, mode: str = "weekly") -> int:
        """A consolidation; an error, and the old snapshot, if it would lose a protected record."""
        before = self.items()
        after = records.consolidated(before, plan, now, mode)
        if not records.lost_protected(before, after).isEmpty():
            raise ValueError("the merge plan would lose protected records")
        return self.save(governance.with_pruned_supports(after, now))

    def edit(self, edits: DataFrame, now: Column) -> int:
        return self.save(governance.edited(self.items(), edits, now))

    def pull(self, remote: DataFrame, since: Column) -> int:
        """Newer remote records (columns of the items, sync_version and deleted_at) taken over."""
        local = self.items().withColumn("sync_version", F.lit(0).cast("long"))
        return self.save(cloud.pull_applied(local, remote, since))

    def export(self, rules: list[tuple[str, list[str], list[str]]], folder: str) -> None:
        """The records as Parquet, a folder for each projection target."""
        self.items().withColumn("target", records.classify(rules)).write.mode("overwrite").partitionBy("target").parquet(folder)

    def index(self) -> DataFrame:
        """The search index of the newest snapshot, made where it isn't there yet."""
        n = self._current()
        path = f"{self.folder}/index-{n}"
        try:
            return self.spark.read.schema(search.INDEX).parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        search.index(self.items()).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(search.INDEX).parquet(path)

    def versions(self, keep: int | None = None) -> list[int]:
        """The numbers of the snapshots, newest first; with ``keep`` only those to be kept, so that a clean-up knows the others."""
        n = self._current()
        return [*range(n, max(0, n - keep) if keep is not None else 0, -1)]

    def statistics(self) -> DataFrame:
        return records.statistics(self.items())
