"""A search index in segments: a base, later segments with what has changed, and merges of all of them.

A segment has documents, their postings, and the keys of older documents that it takes away. A document is live if no later
segment takes its key away; postings likewise, so frequencies are those of the live documents. A change costs a segment of its
own size; merging copies what is live into a new base.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import search as se
from tidemark.sources import files

MOST_SEGMENTS = 6


class SegmentedIndex:
    """The index below `path`. One writer at a time; a segment counts once its manifest is there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def segments(self) -> list[dict]:
        """Manifests of the segments that no complete merge has replaced, oldest first."""
        every = [json.loads(text) for text in files.read_texts(self.spark, f"{self.path}/segments")]
        gone = {n for m in every for n in m["replaces"]}
        return sorted((m for m in every if m["seg"] not in gone), key=lambda m: m["seg"])

    def _read(self, kind: str, numbers: Sequence[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/seg={n}" for n in numbers])

    def _live(self, kind: str) -> DataFrame:
        segments = self.segments()
        rows = self._read(kind, [m["seg"] for m in segments])
        takers = [m["seg"] for m in segments if m["takes"]]
        if not takers:
            return rows.drop("seg")
        gone = self._read("gone", takers).select(F.col("doc_key").alias("_gone"), F.col("seg").alias("_by"))
        return rows.join(gone, (F.col("doc_key") == F.col("_gone")) & (F.col("seg") < F.col("_by")), "left_anti").drop("seg")

    def documents(self) -> DataFrame:
        return self._live("docs")

    def postings(self) -> DataFrame:
        return self._live("postings")

    def total(self) -> int:
        """Number of live documents, from the manifests."""
        return sum(m["added"] - m["removed"] for m in self.segments())

    def add(self, documents: DataFrame, taken: DataFrame | None = None) -> None:
        """A segment of keyed documents that takes the older documents with the keys of `taken` (doc_key) away."""
        segments = self.segments()
        number = max((m["seg"] for m in segments), default=-1) + 1
        # neither is sorted as a whole: scores are summed where a document's postings lie together, and only their sums move
        documents.write.mode("overwrite").parquet(f"{self.path}/docs/seg={number}")
        added = self.spark.read.parquet(f"{self.path}/docs/seg={number}")
        se.segment_postings(added).write.mode("overwrite").parquet(f"{self.path}/postings/seg={number}")
        removed = 0
        if taken is not None and segments:
            # only keys that are there now: the list stays as short as the change
            here = self.documents().select("doc_key").join(taken.select("doc_key").distinct(), "doc_key", "left_semi")
            here.write.mode("overwrite").parquet(f"{self.path}/gone/seg={number}")
            removed = self.spark.read.parquet(f"{self.path}/gone/seg={number}").count()
        self._note(number, added.count(), removed, removed > 0, [])
        if len(segments) + 1 > MOST_SEGMENTS:
            self.merge()

    def merge(self) -> None:
        """All live rows into one segment; segments replaced by an earlier merge are removed."""
        segments = self.segments()
        numbers = [m["seg"] for m in segments]
        every = [json.loads(text)["seg"] for text in files.read_texts(self.spark, f"{self.path}/segments")]
        for dead in sorted(set(every) - set(numbers)):
            files.remove(self.spark, [f"{self.path}/{kind}/seg={dead}" for kind in ("docs", "postings", "gone")] + [f"{self.path}/segments/{dead}.json"])
        number = max(numbers) + 1
        self.documents().write.mode("overwrite").parquet(f"{self.path}/docs/seg={number}")
        self.postings().write.mode("overwrite").parquet(f"{self.path}/postings/seg={number}")
        self._note(number, sum(m["added"] - m["removed"] for m in segments), 0, False, numbers)

    def _note(self, number: int, added: int, removed: int, takes: bool, replaces: list[int]) -> None:
        files.write_text(self.spark, f"{self.path}/segments/{number}.json", json.dumps({"seg": number, "added": added, "removed": removed, "takes": takes, "replaces": replaces}))

    def search(self, question: str, limit: int = 10, **filters) -> DataFrame:
        return se.search(self.postings(), self.documents(), question, limit, total=self.total(), **filters)
