"""The driver's queries over the core operators, by name. Each takes (spark, folder) and reads whole tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.config import Settings
from lakelens.functions import text as T
from lakelens.operators import catalog, chunking, embedding, evaluation, fusion, gate, lexical, nested_flatten, snapshot_diff, vector
from lakelens.session import ship_package, shuffle_partitions, stage_table
from lakelens.sources import directory, fetch
from lakelens.tables import load, load_spread

K = 10


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_diff.snapshot_changes(load(spark, folder, "files"), load(spark, folder, "index_meta"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested_flatten.result_locations(nested_flatten.write_tables(load(spark, folder, "gate_requests")))


def p4_results(spark: SparkSession, folder: str) -> DataFrame:
    """The table of results with its parent keys."""
    return nested_flatten.apply_schema(nested_flatten.write_tables(load(spark, folder, "gate_requests")), "result")


def p4_links(spark: SparkSession, folder: str) -> DataFrame:
    """Parent and child keys over all tables: reports, runs, rules, artifacts, results, locations."""
    return nested_flatten.links(nested_flatten.write_tables(load(spark, folder, "gate_requests")))


def p4_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The table of rules with its parent keys."""
    return nested_flatten.apply_schema(nested_flatten.write_tables(load(spark, folder, "gate_requests")), "rule")


# chunking and sources


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as source files."""
    d = load_spread(spark, folder, "documents")
    return d.select("doc_id", F.col("source").alias("project_id"), F.lit("HEAD").alias("ref"), F.coalesce("path", F.format_string("doc/%d.txt", "doc_id")).alias("path"), "text")


def line_windows(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.line_windows(_files(spark, folder)).select("doc_id", F.col("start_line").cast("long"), F.col("end_line").cast("long"), "text")


def syntax_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_files(_files(spark, folder))


def window_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the files that no parser takes: the fall-back to line windows."""
    cut = chunking.chunk_files(_files(spark, folder).where(~F.endswith("path", F.lit(".py")))).where("error IS NULL")
    return cut.select("project_id", "path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "text")


def content_sha(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").select("doc_id", T.content_sha(F.col("text")).alias("sha"))


def file_filter(spark: SparkSession, folder: str) -> DataFrame:
    named = load(spark, folder, "documents").where("path IS NOT NULL").select("doc_id", "path", F.col("n_chars").alias("length"))
    return directory.wanted(named, Settings(max_file_bytes=20_000)).select("doc_id", "path")


def url_hosts(spark: SparkSession, folder: str) -> DataFrame:
    projects = load(spark, folder, "files").select("project_id").distinct()
    url = T.clone_url(F.col("project_id"), "https://gitlab.com")
    return projects.select("project_id", url.alias("url"), T.remote_host(url).alias("host"))


def host_allowlist(spark: SparkSession, folder: str) -> DataFrame:
    hosts = url_hosts(spark, folder)
    return hosts.select("project_id", F.coalesce(F.col("host").isin("gitlab.com", "git.tarnfield.example"), F.lit(False)).alias("allowed"))


def rest_source(spark: SparkSession, folder: str) -> DataFrame:
    """A served tree behind a stand-in transport, read through the data source."""

    def transport(url: str, params: dict, headers: dict) -> tuple[int, dict, bytes]:
        if url.endswith("/tree"):
            entries = [{"type": "blob", "path": f"pkg/m{params['page']}.py"}, {"type": "blob", "path": "README.md"}, {"type": "tree", "path": "pkg"}]
            return 200, {"x-next-page": "2" if params["page"] == "1" else ""}, json.dumps(entries).encode()
        return 200, {}, b"def f():\r\n    return 1\n"

    ship_package(spark)
    source = type("StandInTree", (fetch.TreeSource,), {"transport": staticmethod(transport)})
    spark.dataSource.register(source)
    return spark.read.format("served_tree").option("project", "group/repo").load()


# index maintenance


def _snapshot(spark: SparkSession, folder: str, back: int) -> DataFrame:
    """File lists of every index's last complete snapshot (back=1) or the one before it (back=2), one row per file."""
    ref = snapshot_diff.plain_ref(F.col("ref")).alias("ref")
    meta = load(spark, folder, "index_meta").where("state = 'complete'").select("project_id", ref, "snapshot_no").distinct()
    order = Window.partitionBy("project_id", "ref").orderBy(F.desc("snapshot_no"))
    wanted = meta.withColumn("r", F.row_number().over(order)).where(F.col("r") == back).drop("r")
    rows = load(spark, folder, "files").select("project_id", ref, snapshot_diff.plain_path(F.col("path")).alias("path"), F.lower("sha").alias("sha"), "snapshot_no", "loaded_at")
    held = rows.join(wanted, ["project_id", "ref", "snapshot_no"]).groupBy("project_id", "ref", "path").agg(F.max(F.struct("loaded_at", "sha")).alias("x"))
    return held.select("project_id", "ref", "path", "x.sha")


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.diff_paths(_snapshot(spark, folder, 1), _snapshot(spark, folder, 2))


def snapshot_paths(spark: SparkSession, folder: str) -> DataFrame:
    return _changes(spark, folder)


def apply_diff_counts(spark: SparkSession, folder: str) -> DataFrame:
    chunks = load(spark, folder, "chunks").select("project_id", "ref", "path", "chunk_pos")
    kept = catalog.apply_diff(chunks, _changes(spark, folder), chunks.limit(0))
    return kept.groupBy("project_id", "ref").agg(F.count(F.lit(1)).alias("n_kept"))


def file_sha_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.upsert(_snapshot(spark, folder, 2), _snapshot(spark, folder, 1), ["project_id", "ref", "path"])


def meta_upsert(spark: SparkSession, folder: str) -> DataFrame:
    meta = load(spark, folder, "index_meta").select("project_id", snapshot_diff.plain_ref(F.col("ref")).alias("ref"), "snapshot_no", "commit_sha", "embed_sig")
    ends = meta.groupBy("project_id", "ref").agg(F.min(F.struct("snapshot_no", "commit_sha", "embed_sig")).alias("a"), F.max(F.struct("snapshot_no", "commit_sha", "embed_sig")).alias("b"))
    old, new = (ends.select("project_id", "ref", f"{x}.commit_sha", f"{x}.embed_sig") for x in "ab")
    return catalog.merge_columns(old, new, ["project_id", "ref"])


def chunk_counts_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "chunks").groupBy("project_id", "ref").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("path").alias("n_files"))


def index_status(spark: SparkSession, folder: str) -> DataFrame:
    ref = snapshot_diff.plain_ref(F.col("ref")).alias("ref")
    last = load(spark, folder, "index_meta").where("state = 'complete'").groupBy("project_id", ref).agg(F.max(F.struct("snapshot_no", "commit_sha", "n_files")).alias("m"))
    n = load(spark, folder, "chunks").groupBy("project_id", ref).agg(F.count(F.lit(1)).alias("n_chunks"))
    joined = last.join(n, ["project_id", "ref"], "left")
    count = F.coalesce("n_chunks", F.lit(0))
    return joined.select("project_id", "ref", F.coalesce("m.commit_sha", F.lit("")).alias("commit_sha"), F.col("m.n_files").cast("long").alias("n_files"), count.alias("n_chunks"), (count > 0).alias("indexed"))


# queries and text


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "bench_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "expect", "relevant")


def validate_queries(spark: SparkSession, folder: str) -> DataFrame:
    odd = ["", "   ", "\t\n", "x" * 2001, "nul\x00l", "bell\x07", "tab\tand\nline", "del\x7f", None]
    literal = spark.createDataFrame([(-1 - n, q) for n, q in enumerate(odd)], "query_id long, query string")
    both = _items(spark, folder).select("query_id", "query").unionByName(literal).unionByName(load(spark, folder, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")))
    return both.select("query_id", T.query_problem(F.col("query")).alias("query_problem"), T.project_problem(F.col("query")).alias("project_problem"))


def select_mode(spark: SparkSession, folder: str) -> DataFrame:
    literal = spark.createDataFrame(
        [(-1 - n, q) for n, q in enumerate(["acquire_lock()", "Saga.compensate", '"exactly this"', "src/lock", "find iPhone", "ACQUIRE_LOCK now please run it", "version 3.5 of the thing", "where do we take the lock"])],
        "query_id long, query string",
    )
    both = literal.unionByName(_items(spark, folder).select("query_id", "query")).unionByName(load(spark, folder, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")))
    return both.select("query_id", T.select_mode(F.col("query")).alias("mode"))


def query_terms(spark: SparkSession, folder: str) -> DataFrame:
    literal = spark.createDataFrame([(-1, "HTTPServer getHTTPResponse a1B2"), (-2, "!!!"), (-3, "__init__ Über acquire_lock")], "query_id long, query string")
    both = literal.unionByName(_items(spark, folder).select("query_id", "query"))
    return both.select("query_id", F.array_join(T.query_terms(F.col("query")), " ").alias("terms"))


def token_stats(spark: SparkSession, folder: str) -> DataFrame:
    chunks = load_spread(spark, folder, "chunks")
    sizes = lexical.doc_stats(chunks).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"))
    terms = chunks.select(F.explode(F.concat(T.tokens(F.col("text")), T.tokens(F.col("symbol")))).alias("term")).agg(F.countDistinct("term").alias("n_terms"))
    return sizes.crossJoin(terms)


def fence_length(spark: SparkSession, folder: str) -> DataFrame:
    cut = T.snippet(F.col("text"))
    return load(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.length(T.fence(cut)).cast("long").alias("n"))


def render_snippet(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


# search


def _lexical(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return lexical.search(load_spread(spark, folder, "chunks"), _items(spark, folder).select("query_id", "query"), k)


def _flat(ranked: DataFrame) -> DataFrame:
    return ranked.select(F.col("query_id").cast("long").alias("query_id"), F.col("chunk_pos").cast("long").alias("chunk_pos"), F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank"))


def lexical_batch_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_lexical(spark, folder, K))


def lexical_phrase(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers with ``_`` as queries: a phrase, and its parts."""
    asked = spark.createDataFrame([(1, "anchor_token"), (2, "the index_span of __init__"), (3, "refresh_token nested_volume")], "query_id int, query string")
    return _flat(lexical.search(load_spread(spark, folder, "chunks"), asked, K))


def lexical_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics over everything, results of one index."""
    keep = (F.col("project_id") == "meridian/atlas-core") & (F.col("ref") == "HEAD")
    return _flat(lexical.search(load_spread(spark, folder, "chunks"), _items(spark, folder).select("query_id", "query"), K, keep))


def stored_search(spark: SparkSession, folder: str) -> DataFrame:
    """The same from stored postings of all indexes, whose chunks are numbered within each index as the catalog does."""
    key = F.concat("project_id", F.lit("@"), "ref").alias("index_key")
    number = F.row_number().over(Window.partitionBy("project_id", "ref").orderBy("chunk_pos")).cast("long")
    chunks = load_spread(spark, folder, "chunks").select(key, number.alias("number"), "chunk_pos", "path", "start_line", "end_line", "symbol", "text")
    local = chunks.withColumnRenamed("chunk_pos", "given").withColumnRenamed("number", "chunk_pos")
    postings = stage_table(lexical.build_postings(local, ("index_key", "chunk_pos")).repartitionByRange(shuffle_partitions(spark), "term").sortWithinPartitions("term"), "postings")
    totals = lexical.doc_stats(local).agg(F.count(F.lit(1)), F.coalesce(F.avg("n_tokens"), F.lit(0.0))).first()
    mine = local.where(F.col("index_key") == "meridian/atlas-core@HEAD")
    scores = lexical.bm25(postings, lexical.doc_stats(mine), _items(spark, folder).select("query_id", "query"), tuple(totals), "meridian/atlas-core@HEAD")
    given = scores.join(mine.select("chunk_pos", "given"), "chunk_pos").select("query_id", F.col("given").alias("chunk_pos"), "score")
    return _flat(lexical.top_chunks(given, mine.drop("chunk_pos").withColumnRenamed("given", "chunk_pos"), K))


def lexical_text_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Full-text rank by the presence of words, as a served database ranks."""
    return _flat(lexical.text_rank(load_spread(spark, folder, "chunks"), _items(spark, folder).select("query_id", "query"), K))


def lexical_like(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(lexical.like_search(load_spread(spark, folder, "chunks"), _items(spark, folder).select("query_id", "query"), K))


def symbol_lookup(spark: SparkSession, folder: str) -> DataFrame:
    asked = spark.createDataFrame([(1, "InnerSpan"), (2, "pad_loose_lathe"), (3, "demoteOrphanStream")], "query_id int, query string")
    return _flat(lexical.search(load_spread(spark, folder, "chunks"), asked, 5))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _vectors(spark, folder)
    query = vectors.where("id = 0").select("vector").first()
    return vector.top_k(vectors, list(query.vector), K) if query else vectors.limit(0).select("id", F.lit(0.0).alias("score"))


def cosine_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _vectors(spark, folder)
    query = vectors.where("id = 0").select("vector").first()
    return vector.top_k(vectors.where("label = 3"), list(query.vector), K) if query else vectors.limit(0).select("id", F.lit(0.0).alias("score"))


def cosine_batch_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _vectors(spark, folder)
    stated = vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return vector.batch_top_k(vectors, stated, K).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


def _arms(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """A lexical arm, and a vector arm that asks with the vector of the best lexical chunk."""
    chunks = load_spread(spark, folder, "chunks")
    first = stage_table(_lexical(spark, folder, k), "lexical-arm")
    usable = chunks.where((F.size("vector") == 64) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)) & F.exists("vector", lambda x: x != 0))
    asked = first.where("rank = 0").select("query_id", "chunk_pos").join(usable.select("chunk_pos", "vector"), "chunk_pos").select("query_id", "vector")
    near = vector.batch_top_k(usable.select(F.col("chunk_pos").alias("id"), "vector"), asked, k)
    named = near.withColumnRenamed("id", "chunk_pos").join(chunks.select("chunk_pos", "path", "start_line", "end_line"), "chunk_pos")
    columns = ["query_id", "path", "start_line", "end_line", "rank", "chunk_pos"]
    return named.select(F.lit(0).alias("arm"), *columns).unionByName(first.select(F.lit(1).alias("arm"), *columns))


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(fusion.fuse(_arms(spark, folder, 30)).where(F.col("rank") < K))


def rrf_fuse(spark: SparkSession, folder: str) -> DataFrame:
    """Two given rankings, and a key listed twice in one of them."""
    rows = [(1, 0, r, p) for r, p in enumerate("abc")] + [(1, 1, r, p) for r, p in enumerate("bda")] + [(2, 0, 0, "x"), (2, 0, 1, "x"), (2, 0, 2, "y")]
    arms = spark.createDataFrame([(q, a, r, p, 1, 2) for q, a, r, p in rows], "query_id int, arm int, rank int, path string, start_line int, end_line int")
    return fusion.fuse(arms).select(F.col("query_id").cast("long").alias("query_id"), "path", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank"))


def rerank_head(spark: SparkSession, folder: str) -> DataFrame:
    ranked = _lexical(spark, folder, 20).join(load(spark, folder, "chunks").select("chunk_pos", "text"), "chunk_pos").join(_items(spark, folder).select("query_id", "query"), "query_id")
    return _flat(fusion.rerank_head(ranked, fusion.term_overlap(F.col("query"), F.col("text")), K))


def overfetch_arms(spark: SparkSession, folder: str) -> DataFrame:
    asked = spark.range(-2, 61).select(F.col("id").alias("asked")).crossJoin(spark.createDataFrame([(m, k) for m in ("semantic", "lexical", "hybrid") for k in (None, 20)], "mode string, rerank_top_k int"))
    n = fusion.clamp(F.col("asked"), 50)
    return asked.select("asked", "mode", "rerank_top_k", fusion.arm_size(n, F.col("mode"), F.col("rerank_top_k")).alias("arm_k"))


# evaluation


def ndcg_at_10(spark: SparkSession, folder: str) -> DataFrame:
    items = _items(spark, folder)
    scored = evaluation.ndcg(evaluation.unique_paths(_lexical(spark, folder, K)), evaluation.relevance(items))
    return scored.select("query_id", F.round("ndcg", 6).alias("ndcg"))


def found_precision(spark: SparkSession, folder: str) -> DataFrame:
    s = evaluation.summary(evaluation.unique_paths(_lexical(spark, folder, K)), _items(spark, folder))
    return s.select("n", *(F.round(c, 6).alias(c) for c in ("found_at_k", "precision_at_1", "ndcg")))


# gate


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    return gate.latest_per_request(load(spark, folder, "gate_requests"))


def sarif_levels(spark: SparkSession, folder: str) -> DataFrame:
    leveled = _reports(spark, folder).select("request_id", F.explode(gate.finding_levels(F.col("sarif"))).alias("level"))
    return leveled.groupBy("request_id", "level").agg(F.count(F.lit(1)).alias("n"))


def _decided(reports: DataFrame, policy: gate.Policy | None = None) -> DataFrame:
    d = gate.decide(reports, policy)
    return d.select("request_id", "state", *(F.col(c).cast("long").alias(c) for c in ("blocking", "warnings", "total")), F.array_join("reasons", "; ").alias("reasons"))


def gate_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(_reports(spark, folder).drop("policy"))


def gate_max_findings(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(_reports(spark, folder).drop("policy"), gate.Policy(block_on=(), max_findings=3))


def gate_policy_override(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(_reports(spark, folder))


def dashboard_recent(spark: SparkSession, folder: str) -> DataFrame:
    log = gate.recent(load(spark, folder, "gate_decisions"))
    return log.select("id", "ts", "project_id", "sha", "state", *(F.col(c).cast("long").alias(c) for c in ("blocking", "warnings", "total")), F.array_join("reasons", "; ").alias("reasons"))


def dashboard_totals(spark: SparkSession, folder: str) -> DataFrame:
    return gate.totals(gate.recent(load(spark, folder, "gate_decisions")))


def hash_embed(spark: SparkSession, folder: str) -> DataFrame:
    made = embedding.embed_column(F.col("text"), lambda: embedding.HashEmbedder(64))
    return load_spread(spark, folder, "chunks").select("chunk_pos", made.alias("vector"))


def hash_embed_norms(spark: SparkSession, folder: str) -> DataFrame:
    """Every text has a vector of the wanted length and unit norm, equal texts have equal ones."""
    made = hash_embed(spark, folder).join(load(spark, folder, "chunks").select("chunk_pos", "text"), "chunk_pos").where("text IS NOT NULL")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    per = made.select(F.sha1("text").alias("sha"), F.size("vector").alias("size"), F.round(norm, 4).alias("norm"), F.xxhash64("vector").alias("h"))
    return per.groupBy("sha").agg(F.max("size").cast("long").alias("size"), F.max("norm").alias("norm"), F.countDistinct("h").alias("vectors"), F.count(F.lit(1)).alias("texts"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p4_found, p4_results, p4_rules, p4_links, line_windows, window_chunks, syntax_chunks, content_sha, file_filter, url_hosts, host_allowlist, rest_source, snapshot_paths,
        apply_diff_counts, file_sha_upsert, meta_upsert, chunk_counts_by_key, index_status, validate_queries, select_mode, query_terms, token_stats,
        fence_length, render_snippet, lexical_batch_topk, lexical_phrase, lexical_filtered, stored_search, lexical_text_rank, lexical_like, symbol_lookup, cosine_topk,
        cosine_topk_filtered, cosine_batch_topk, hybrid_search, rrf_fuse, rerank_head, overfetch_arms, ndcg_at_10, found_precision, sarif_levels,
        gate_decisions, gate_max_findings, gate_policy_override, dashboard_recent, dashboard_totals, hash_embed, hash_embed_norms,
    )
}
