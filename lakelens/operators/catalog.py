"""A versioned index in plain files: generations of parquet and one manifest per index.

A new generation is written beside the old one and becomes current by the rename of its manifest, so readers see the whole
of one or the other; the generation before it stays until the next one is published, for readers that began with it.
Layout: ``<root>/<key>/gen=<n>/{chunks,files,postings,doc_stats,errors}`` and ``<root>/manifest/<key>.json``, on any file system
that the session knows. Positions are unique within an index only: postings and sizes carry the index key beside them.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.operators import lexical
from lakelens.session import shuffle_partitions
from lakelens.sources.files import SharedFiles

CHUNKS = "chunk_pos long, project_id string, ref string, path string, start_line int, end_line int, symbol string, text string, vector array<float>"
FILES = "project_id string, ref string, path string, sha string"
TABLES = {
    "chunks": CHUNKS,
    "files": FILES,
    "postings": "index_key string, term string, chunk_pos long, field int, positions array<int>",
    "errors": "path string, error string",
    "doc_stats": "index_key string, chunk_pos long, n_tokens long",
}


def index_key(project_id: str, ref: str) -> str:
    """Sixteen hex digits that name an index."""
    return hashlib.sha1(f"{project_id}@{ref}".encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Manifest:
    project_id: str
    ref: str
    generation: int
    commit: str
    embed_sig: str
    n_files: int
    n_chunks: int
    n_tokens: int = 0


def diff_paths(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(project_id, ref, path, change): changed (new or another sha) and removed paths, NULL-safe on the sha."""
    key = ["project_id", "ref", "path"]
    old = stored.select(*key, F.col("sha").alias("old_sha"), F.lit(True).alias("known"))
    changed = current.join(old, key, "left").where(F.col("known").isNull() | ~F.col("sha").eqNullSafe(F.col("old_sha"))).select(*key, F.lit("changed").alias("change"))
    removed = stored.join(current, key, "left_anti").select(*key, F.lit("removed").alias("change"))
    return changed.unionByName(removed)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows, and old ones whose key is not among them."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))


def merge_columns(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Column-wise upsert: a NULL in the new row keeps the old value."""
    rest = [c for c in old.columns if c not in key]
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    return o.join(n, on, "full").select(*(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in [*key, *rest]))


def apply_diff(chunks: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored chunks without those of touched paths, and the fresh ones."""
    return chunks.join(changes.select("project_id", "ref", "path"), ["project_id", "ref", "path"], "left_anti").unionByName(fresh)


class Catalog:
    """Generations on a file system that driver and executors share. One writer of an index at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, SharedFiles(spark, root)

    def _manifest_path(self, key: str) -> str:
        return self.files.at("manifest", f"{key}.json")

    def manifest(self, project_id: str, ref: str) -> Manifest | None:
        text = self.files.read(self._manifest_path(index_key(project_id, ref)))
        return Manifest(**json.loads(text)) if text else None

    def manifests(self) -> list[Manifest]:
        found = (self.files.read(self.files.at("manifest", n)) for n in self.files.names(self.files.at("manifest"), ".json"))
        return [Manifest(**json.loads(text)) for text in found if text]

    def _folder(self, m: Manifest, table: str = "") -> str:
        return self.files.at(index_key(m.project_id, m.ref), f"gen={m.generation}", *([table] if table else []))

    def read(self, table: str, project_id: str, ref: str) -> DataFrame:
        """A table of the current generation; empty where there is none."""
        m = self.manifest(project_id, ref)
        if m is None:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(self._folder(m, table))

    def read_all(self, table: str) -> DataFrame:
        """A table over the current generations of all indexes."""
        paths = [self._folder(m, table) for m in self.manifests()]
        return self.spark.read.schema(TABLES[table]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[table])

    def totals(self) -> tuple[int, float]:
        """(chunks, mean tokens of a chunk) over all indexes, from their manifests."""
        all_of = self.manifests()
        n = sum(m.n_chunks for m in all_of)
        return n, sum(m.n_tokens for m in all_of) / n if n else 0.0

    def has_index(self, project_id: str, ref: str) -> bool:
        m = self.manifest(project_id, ref)
        return m is not None and m.n_chunks > 0

    def write(self, project_id: str, ref: str, chunks: DataFrame, files: DataFrame, commit: str, embed_sig: str, errors: DataFrame | None = None) -> Manifest:
        """Write the next generation with its postings and make it current. The signature and counts come with the manifest."""
        key, old = index_key(project_id, ref), self.manifest(project_id, ref)
        kept = {f"gen={old.generation}"} if old else set()
        m = Manifest(project_id, ref, old.generation + 1 if old else 1, commit or (old.commit if old else ""), embed_sig, 0, 0)
        self.files.remove(self._folder(m))  # left over from a run that did not finish
        chunks.write.parquet(self._folder(m, "chunks"))
        files.write.parquet(self._folder(m, "files"))
        (self.spark.createDataFrame([], TABLES["errors"]) if errors is None else errors).write.parquet(self._folder(m, "errors"))
        stored = self.spark.read.schema(CHUNKS).parquet(self._folder(m, "chunks"))
        keyed = F.lit(key).alias("index_key")
        # by range of terms, so that a search for some terms reads few row groups
        postings = lexical.build_postings(stored).repartitionByRange(shuffle_partitions(self.spark), "term").sortWithinPartitions("term")
        postings.select(keyed, "term", "chunk_pos", "field", "positions").write.parquet(self._folder(m, "postings"))
        lexical.doc_stats(stored).select(keyed, "chunk_pos", "n_tokens").write.parquet(self._folder(m, "doc_stats"))
        sizes = self.spark.read.schema(TABLES["doc_stats"]).parquet(self._folder(m, "doc_stats")).agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        m = Manifest(project_id, ref, m.generation, m.commit, embed_sig, self.spark.read.schema(FILES).parquet(self._folder(m, "files")).count(), *sizes)
        self._publish(m)
        for name in self.files.names(self.files.at(key)):
            if name not in kept | {f"gen={m.generation}"}:
                self.files.remove(self.files.at(key, name))
        return m

    def touch(self, m: Manifest) -> None:
        self._publish(m)

    def _publish(self, m: Manifest) -> None:
        self.files.replace(self._manifest_path(index_key(m.project_id, m.ref)), json.dumps(asdict(m)))

    def clear(self, project_id: str, ref: str) -> None:
        key = index_key(project_id, ref)
        self.files.remove(self._manifest_path(key))
        self.files.remove(self.files.at(key))

    def status(self, project_id: str, ref: str) -> dict:
        m = self.manifest(project_id, ref)
        return {
            "project_id": project_id, "ref": ref, "commit": m.commit if m else "", "files": m.n_files if m else 0,
            "chunks": m.n_chunks if m else 0, "indexed": bool(m and m.n_chunks),
        }
