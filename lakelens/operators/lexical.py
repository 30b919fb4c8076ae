"""Inverted index and BM25 over two fields, single and batched queries as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.functions import text as T
from lakelens.session import shuffle_partitions, stage_table

K1, B = 1.2, 0.75


#: Distinct terms of stated queries that are written into a plan as a set at most; more of them are joined.
TERM_SET = 20_000


def build_postings(chunks: DataFrame, key: tuple[str, ...] = ("chunk_pos",)) -> DataFrame:
    """(term, key, field, positions): a row per term of a chunk's field; field 0 is the text, 1 the symbol."""
    fields = chunks.select(*key, F.posexplode(F.array(T.tokens(F.col("text")), T.tokens(F.col("symbol")))).alias("field", "tokens"))
    places = fields.select(*key, "field", F.posexplode("tokens").alias("pos", "term"))
    return places.groupBy("term", *key, "field").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def doc_stats(chunks: DataFrame) -> DataFrame:
    """(chunk_pos, n_tokens) over both fields."""
    return chunks.select("chunk_pos", (F.size(T.tokens(F.col("text"))) + F.size(T.tokens(F.col("symbol")))).cast("long").alias("n_tokens"))


def query_phrases(queries: DataFrame) -> DataFrame:
    """(query_id, phrase, times): the phrases of every query's terms; a term without tokens adds none."""
    terms = queries.select("query_id", F.explode(T.query_terms(F.col("query"))).alias("term"))
    phrase = F.array_join(T.tokens(F.col("term")), " ")
    return terms.select("query_id", phrase.alias("phrase")).where("phrase <> ''").groupBy("query_id", "phrase").agg(F.count(F.lit(1)).alias("times"))


def _parts(phrases: DataFrame) -> DataFrame:
    words = F.split("phrase", " ")
    return phrases.select("phrase").distinct().select("phrase", F.posexplode(words).alias("part", "term"), F.size(words).alias("n"))


def _whole(starts: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """A phrase stands where all its parts agree on the place of its first token."""
    met = starts.groupBy("phrase", "n", *key, "field", "at").agg(F.count(F.lit(1)).alias("c")).where("c = n")
    return met.groupBy("phrase", *key).agg(F.count(F.lit(1)).alias("f"))


def phrase_counts(postings: DataFrame, phrases: DataFrame, key: tuple[str, ...] = ("chunk_pos",)) -> DataFrame:
    """(phrase, key, f): occurrences of each phrase, never across the two fields. ``key`` tells chunks of all indexes apart."""
    hits = postings.join(F.broadcast(_parts(phrases)) if _few(phrases) else _parts(phrases), "term")
    single = hits.where("n = 1").groupBy("phrase", *key).agg(F.sum(F.size("positions")).alias("f"))
    starts = hits.where("n > 1").select("phrase", "n", *key, "field", F.explode(F.transform("positions", lambda p: p - F.col("part"))).alias("at"))
    return single.unionByName(_whole(starts, key))


def _few(phrases: DataFrame) -> bool:
    return phrases.select("phrase").distinct().count() <= TERM_SET


def scan(chunks: DataFrame, phrases: DataFrame) -> DataFrame:
    """(chunk_pos, n_tokens, hits): one pass of tokenising gives a chunk's size and the places of the phrases' terms in it."""
    words = _parts(phrases).select("term").distinct()
    terms = [r.term for r in words.limit(TERM_SET + 1).collect()]
    fields = chunks.select("chunk_pos", F.array(T.tokens(F.col("text")), T.tokens(F.col("symbol"))).alias("fields"))
    sized = fields.withColumn("n_tokens", (F.size(F.col("fields")[0]) + F.size(F.col("fields")[1])).cast("long"))
    if len(terms) > TERM_SET:
        placed = sized.select("chunk_pos", F.posexplode("fields").alias("field", "tokens")).select("chunk_pos", "field", F.posexplode("tokens").alias("pos", "term")).join(words, "term")
        hits = placed.groupBy("chunk_pos").agg(F.collect_list(F.struct("field", "pos", "term")).alias("hits"))
        return sized.drop("fields").join(hits, "chunk_pos", "left")

    def of(field: int) -> Column:
        every = F.transform(F.col("fields")[field], lambda t, k: F.struct(F.lit(field).alias("field"), k.alias("pos"), t.alias("term")))
        return F.filter(every, lambda x: x.term.isin(terms))

    return sized.select("chunk_pos", "n_tokens", F.concat(of(0), of(1)).alias("hits"))


def scanned_counts(scanned: DataFrame, phrases: DataFrame) -> DataFrame:
    """Phrase counts of scanned chunks: only occurrences of the phrases' terms are ever rows."""
    key = ("chunk_pos", "n_tokens")  # a chunk's size goes along, so that it need not be joined
    hits = scanned.select(*key, F.explode("hits").alias("h")).select(*key, "h.*").join(_parts(phrases), "term")
    single = hits.where("n = 1").groupBy("phrase", *key).agg(F.count(F.lit(1)).alias("f"))
    starts = hits.where("n > 1").select("phrase", "n", *key, "field", (F.col("pos") - F.col("part")).alias("at"))
    return single.unionByName(_whole(starts, key))


def _weight(total: Column, holding: Column) -> Column:
    idf = F.log((total - holding + 0.5) / (holding + 0.5))
    return F.when(idf > 0, idf).otherwise(F.lit(1e-6))


def _part(mean: Column) -> Column:
    """A phrase's share of a chunk's score."""
    f = F.col("f").cast("double")
    return F.col("idf") * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n_tokens") / mean))


def score(counts: DataFrame, stats: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, chunk_pos, score): BM25 over all rows of ``stats``, higher is better; chunks without any phrase are absent.

    counts: phrase, chunk_pos, n_tokens, f.
    """
    totals = stats.agg(F.count(F.lit(1)).cast("double").alias("total"), F.avg("n_tokens").alias("mean"))
    weights = counts.groupBy("phrase").agg(F.count(F.lit(1)).cast("double").alias("holding")).crossJoin(F.broadcast(totals))
    weights = weights.select("phrase", "mean", _weight(F.col("total"), F.col("holding")).alias("idf"))
    few = phrases.limit(10 * TERM_SET + 1).count() <= 10 * TERM_SET
    sent = F.broadcast if few else lambda df: df
    # by chunk from here on: the sums per query and chunk need no further shuffle; the number is given because few
    # counts become many rows once they meet the queries
    scored = counts.repartition(shuffle_partitions(counts.sparkSession), "chunk_pos").join(sent(weights), "phrase")
    parts = scored.select("phrase", "chunk_pos", _part(F.col("mean")).alias("part")).join(sent(phrases), "phrase")
    return parts.groupBy("query_id", "chunk_pos").agg(F.sum(F.col("part") * F.col("times")).alias("score"))


def bm25(postings: DataFrame, stats: DataFrame, queries: DataFrame, totals: tuple[int, float], index_key: str) -> DataFrame:
    """(query_id, chunk_pos, score) of one index's chunks, from the stored postings of all indexes.

    Statistics are over all indexes: the number and mean size of chunks come as ``totals`` from their manifests, how many
    hold a phrase from the postings. Only postings of the queries' terms are read (a pushed filter), and only this index's
    sizes. The queries are few: those of one search.
    """
    phrases = query_phrases(queries)
    terms = [r.term for r in _parts(phrases).select("term").distinct().collect()]
    counts = phrase_counts(postings.where(F.col("term").isin(terms)), phrases, ("index_key", "chunk_pos"))
    counts = stage_table(counts, "phrase-counts")
    holding = counts.groupBy("phrase").agg(F.count(F.lit(1)).cast("double").alias("holding"))
    weights = holding.select("phrase", _weight(F.lit(float(totals[0])), F.col("holding")).alias("idf"))
    mine = counts.where(F.col("index_key") == index_key).join(F.broadcast(weights), "phrase").join(stats.drop("index_key"), "chunk_pos")
    parts = mine.select("phrase", "chunk_pos", _part(F.lit(float(totals[1]))).alias("part")).join(F.broadcast(phrases), "phrase")
    return parts.groupBy("query_id", "chunk_pos").agg(F.sum(F.col("part") * F.col("times")).alias("score"))


def top_chunks(scores: DataFrame, chunks: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best chunks of every query with rank from 0, ties by path, start line and position.

    Scores alone are cut to the k best, ties kept, before chunk columns are joined to them.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    head = scores.withColumn("score", F.round("score", digits)).withColumn("_r", F.rank().over(best)).where(F.col("_r") <= k).drop("_r")
    named = head.join(chunks.select("chunk_pos", "path", "start_line", "end_line"), "chunk_pos")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "start_line", "chunk_pos")
    return named.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def search(chunks: DataFrame, queries: DataFrame, k: int, keep: Column | None = None) -> DataFrame:
    """Search without a stored index. ``keep`` filters chunks after scoring, as a key filter does.

    Phrases, scanned chunks and counts serve several times each, so they are staged; texts are tokenised once.
    """
    phrases = stage_table(query_phrases(queries), "phrases")
    scanned = stage_table(scan(chunks, phrases), "scanned-chunks")
    scores = score(stage_table(scanned_counts(scanned, phrases), "phrase-counts"), scanned.select("chunk_pos", "n_tokens"), phrases)
    if keep is not None:
        chunks = chunks.where(keep)
        scores = scores.join(chunks.select("chunk_pos"), "chunk_pos", "left_semi")
    return top_chunks(scores, chunks, k)


#: Weight of a plain word, sum of 1 / n² to infinity, and places of a word that count, as full-text ranks of databases have them.
RANK_WEIGHT, RANK_NORM, RANK_PLACES = 0.1, 1.64493406685, 255


def text_rank(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best chunks by full-text rank of the text alone: any of a query's words will do, more and repeated ones count more.

    A word that stands f times adds weight * (1 + 1/4 + … + 1/f²) / norm, divided by the number of the query's distinct
    words. No statistics of the collection enter. Columns as :func:`top_chunks`; a query without words has no rows.
    """
    words = F.array_distinct(F.transform(F.regexp_extract_all("query", F.lit("[A-Za-z_][A-Za-z0-9_]+"), F.lit(0)), F.lower))
    terms = queries.select("query_id", F.explode(words).alias("term")).select("query_id", F.array_join(T.tokens(F.col("term")), " ").alias("phrase"))
    phrases = stage_table(terms.where("phrase <> ''").distinct().withColumn("times", F.lit(1)), "rank-phrases")
    asked = phrases.groupBy("query_id").agg(F.count(F.lit(1)).alias("asked"))
    counts = scanned_counts(scan(chunks.withColumn("symbol", F.lit(None).cast("string")), phrases), phrases)
    places = F.sequence(F.lit(1), F.least(F.col("f"), F.lit(RANK_PLACES)).cast("int"))
    part = F.aggregate(places, F.lit(0.0), lambda s, n: s + 1.0 / (n.cast("double") * n)) * RANK_WEIGHT / RANK_NORM
    scores = counts.select("phrase", "chunk_pos", part.alias("part")).join(phrases, "phrase").groupBy("query_id", "chunk_pos").agg(F.sum("part").alias("s"))
    return top_chunks(scores.join(asked, "query_id").select("query_id", "chunk_pos", (F.col("s") / F.col("asked")).alias("score")), chunks, k)


def like_search(chunks: DataFrame, queries: DataFrame, k: int, block: int = 500) -> DataFrame:
    """Fall-back without an index: chunks whose lower-cased text holds a query's first term, score 1; ``_`` matches any character.

    The distinct terms are sent in blocks of ``block``, each one pass over the chunks without a join; hits then meet
    their queries by term.
    """
    first = queries.select("query_id", F.element_at(T.query_terms(F.col("query")), 1).alias("term")).where("term IS NOT NULL")
    terms = [r.term for r in first.select("term").distinct().orderBy("term").toLocalIterator()]
    slim = chunks.select("chunk_pos", "path", "start_line", "end_line", F.lower("text").alias("low"))
    out = slim.select("chunk_pos", "path", "start_line", "end_line", F.lit("").alias("term")).limit(0)
    for a in range(0, len(terms), block):
        held = slim.withColumn("terms", F.array(*map(F.lit, terms[a : a + block])))
        found = F.explode(F.expr("filter(terms, t -> low LIKE concat('%', t, '%'))"))
        out = out.unionByName(held.select("chunk_pos", "path", "start_line", "end_line", found.alias("term")))
    order = Window.partitionBy("query_id").orderBy("path", "start_line", "chunk_pos")
    hits = out.join(first, "term").withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
    return hits.select("query_id", "chunk_pos", "path", "start_line", "end_line", F.lit(1.0).alias("score"), "rank")
