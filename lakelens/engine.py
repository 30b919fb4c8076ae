"""The search service: index a project into the catalog, keep it current, answer queries."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.config import Settings
from lakelens.functions import text as T
from lakelens.operators import chunking, embedding, fusion, lexical, vector
from lakelens.operators.catalog import CHUNKS, TABLES, Catalog, diff_paths, index_key
from lakelens.render import format_results
from lakelens.session import ship_package, stage_table
from lakelens.sources import directory, fetch

_CHUNK_COLUMNS = [c.split()[0] for c in CHUNKS.split(", ")]
_CONTROL = {chr(c) for c in range(0x20)} | {"\x7f"}


@dataclass
class IndexStats:
    project_id: str
    ref: str
    files: int = 0
    chunks: int = 0
    skipped: int = 0
    errors: list[str] = field(default_factory=list)


def _check(name: str, value: str, longest: int, white_space: bool) -> None:
    """Refuse blank, overlong and control-character input before it reaches a plan, a command or a log."""
    if not (value or "").strip():
        raise ValueError(f"{name} is empty")
    if len(value) > longest:
        raise ValueError(f"{name} is longer than {longest} characters")
    if (_CONTROL - set("\t\n\r" if white_space else "")) & set(value):
        raise ValueError(f"{name} holds control characters")


def check_project(project_id: str) -> None:
    _check("project_id", project_id, T.MAX_PROJECT, white_space=False)


def check_query(query: str) -> None:
    _check("query", query, T.MAX_QUERY, white_space=True)


class SearchEngine:
    """One engine per session. Builds of one index are serialised; a finished one is seen by all at once.

    Executors make the embedder of the settings themselves, once per process; one handed in is sent to them as it is.
    """

    def __init__(self, spark: SparkSession, settings: Settings, embedder: embedding.Embedder | None = None, reranker: embedding.Reranker | None = None):
        ship_package(spark)
        self.spark, self.settings = spark, settings
        self.embedder = embedder or embedding.cached_embedder(settings)
        # what executors need of the settings, without the secrets that they do not
        self._factory = (lambda: embedder) if embedder else partial(embedding.cached_embedder, replace(settings, gitlab_token="", api_key=""))
        self.reranker = reranker if reranker is not None else embedding.make_reranker(settings)
        self.catalog = Catalog(spark, settings.catalog_path)
        self._locks: dict[tuple[str, str], threading.RLock] = {}
        self._guard = threading.Lock()

    @property
    def embed_sig(self) -> str:
        """What an index must have been built with to be searched."""
        return f"{self.settings.embedder}:{self.settings.embed_model}:{self.embedder.dim}"

    def _lock(self, project_id: str, ref: str) -> threading.RLock:
        with self._guard:
            return self._locks.setdefault((project_id, ref), threading.RLock())

    def index(self, project_id: str, ref: str = "HEAD", force: bool = False) -> IndexStats:
        """Bring an index up to date: only files whose content changed are chunked and embedded again.

        An index built with another embedder is rebuilt; at an unchanged commit nothing is done and counts stay 0.
        """
        check_project(project_id)
        with self._lock(project_id, ref or "HEAD"):
            return self._build(project_id, ref or "HEAD", force)

    def _build(self, project_id: str, ref: str, force: bool) -> IndexStats:
        stats = IndexStats(project_id, ref)
        root = fetch.fetch_repo(self.settings, project_id, ref)
        commit, old = fetch.resolve_commit(root), self.catalog.manifest(project_id, ref)
        stale = force or bool(old and old.n_chunks and old.embed_sig != self.embed_sig)
        if not stale and old and commit and old.commit == commit and old.n_chunks:
            return stats

        def stored(table: str) -> DataFrame:  # a rebuild begins with nothing; what it replaces is read until it is published
            return self.spark.createDataFrame([], TABLES[table]) if stale else self.catalog.read(table, project_id, ref)

        tree = directory.read_tree(self.spark, str(root), self.settings)
        named = tree.select(F.lit(project_id).alias("project_id"), F.lit(ref).alias("ref"), "path", F.sha1("text").alias("sha"), "text")
        current = stage_table(named, "tree")
        changes = stage_table(diff_paths(current.select("project_id", "ref", "path", "sha"), stored("files")), "changes")
        touched = current.join(changes.where("change = 'changed'").select("path"), "path")
        cut = stage_table(chunking.chunk_files(touched, self.settings.chunk_max_chars, self.settings.chunk_max_lines), "cut")
        fresh, failed = cut.where("error IS NULL").drop("error"), cut.where("error IS NOT NULL").select("path", "error")
        kept = stored("chunks").join(changes.select("path"), "path", "left_anti").select(*_CHUNK_COLUMNS)
        written = self.catalog.write(project_id, ref, kept.unionByName(self._embedded(fresh, kept)), current.select("project_id", "ref", "path", "sha"), commit, self.embed_sig, failed)
        counts = cut.agg(F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull())).first()
        stats.files, stats.chunks, stats.skipped = written.n_files, *counts
        # the report shows some errors; all of them are the index's table "errors"
        stats.errors = [r.error for r in failed.orderBy("path").limit(self.settings.errors_shown).collect()] if stats.skipped else []
        return stats

    def _embedded(self, fresh: DataFrame, kept: DataFrame) -> DataFrame:
        first = (kept.agg(F.max("chunk_pos")).first()[0] or 0) + 1
        spread = fresh.repartition(max(1, self.settings.embed_concurrency)) if fresh.rdd.getNumPartitions() < self.settings.embed_concurrency else fresh
        numbered = spread.withColumn("chunk_pos", F.monotonically_increasing_id() + first)
        return numbered.withColumn("vector", embedding.embed_column(F.col("text"), self._factory)).select(*_CHUNK_COLUMNS)

    def status(self, project_id: str, ref: str = "HEAD") -> dict:
        return self.catalog.status(project_id, ref or "HEAD")

    def _needs_index(self, project_id: str, ref: str) -> bool:
        m = self.catalog.manifest(project_id, ref)
        return m is None or not m.n_chunks or m.embed_sig != self.embed_sig

    def search(self, project_id: str, query: str, ref: str = "HEAD", max_results: int = 5, mode: str = "auto") -> list[dict]:
        """Best chunks of a query; builds the index first where there is none for this embedder."""
        check_project(project_id)
        check_query(query)
        ref = ref or "HEAD"
        if mode not in fusion.MODES:
            raise ValueError(f"unknown mode {mode!r}; expected one of {', '.join(fusion.MODES)}")
        n = max(1, min(max_results, self.settings.max_results_cap))
        if self._needs_index(project_id, ref):
            if not self.settings.allow_auto_index:
                raise ValueError(f"{project_id!r}@{ref} is not indexed for the current embedder and indexing on search is off")
            with self._lock(project_id, ref):
                if self._needs_index(project_id, ref):
                    self.index(project_id, ref)
        asked = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        if mode == "auto":
            mode = asked.select(T.select_mode(F.col("query"))).first()[0]
        size = n if mode != "hybrid" else max(3 * n, 10)
        if self.reranker is not None:
            size = max(size, self.settings.rerank_top_k)
        chunks = self.catalog.read("chunks", project_id, ref)
        slim = chunks.select("chunk_pos", "path", "start_line", "end_line", "symbol", "text")
        arms = []
        if mode != "lexical":
            best = vector.top_k(chunks.select(F.col("chunk_pos").alias("id"), "vector"), self.embedder.embed_query(query), size, digits=12)
            arms.append(self._ranked(best.withColumnRenamed("id", "chunk_pos"), slim, 0, size))
        if mode != "semantic":
            stats = self.catalog.read("doc_stats", project_id, ref)
            scores = stage_table(lexical.bm25(self.catalog.read_all("postings"), stats, asked, self.catalog.totals(), index_key(project_id, ref)).select("chunk_pos", "score"), "scores")
            # scores alone are cut to the best, ties kept, before any text is joined to them
            edge = scores.orderBy(F.desc("score")).limit(size).agg(F.min("score")).first()[0]
            arms.append(self._ranked(scores.where(F.col("score") >= (edge or 0.0)), slim, 1, size))
        ranked = arms[0] if len(arms) == 1 else fusion.fuse(arms[0].unionByName(arms[1]), digits=12)
        rows = [r.asDict() for r in ranked.orderBy("rank").limit(max(size, n) * len(arms)).collect()]
        if self.reranker is not None and len(rows) > 1:
            head = rows[: self.settings.rerank_top_k]
            scored = zip(self.reranker.rerank(query, [r["text"] for r in head]), head)
            rows = [r | {"score": float(s)} for s, r in sorted(scored, key=lambda x: -x[0])] + rows[len(head) :]
        return rows[:n]

    @staticmethod
    def _ranked(scores: DataFrame, chunks: DataFrame, arm: int, size: int) -> DataFrame:
        """The ``size`` best chunks of one arm: few rows, so their ranks are numbered in one task."""
        joined = chunks.join(F.broadcast(scores), "chunk_pos").withColumn("query_id", F.lit(0)).withColumn("arm", F.lit(arm))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "start_line", "chunk_pos")
        best = joined.orderBy(F.desc("score"), "path", "start_line", "chunk_pos").limit(size)
        return best.withColumn("rank", F.row_number().over(order) - 1)

    def render(self, project_id: str, query: str, **how) -> str:
        return format_results(query, self.search(project_id, query, **how))

    def with_settings(self, **changes) -> SearchEngine:
        return SearchEngine(self.spark, replace(self.settings, **changes), reranker=self.reranker)
