"""Lexical retrieval: BM25 with keyphrase fan-out, and TF-IDF relevance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weavegrid.functions.config import BM25, RETRIEVAL, SCORING, Bm25
from weavegrid.functions.text import long_tokens, tokens
from weavegrid.operators.scratch import dropped, few_rows_a_batch, kept, ship

#: Estimated bytes up to which query-side tables are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Documents whose words a Python worker holds at once.
DOCS_A_BATCH = 64


def small(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """``df`` with a broadcast hint, if ``rows`` (counted before) of about ``row_bytes`` are few enough."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def _counted(batches):
    """doc_id and words to doc_id, term, tf, dl of every distinct word, and a row without a term for every document."""
    for batch in batches:
        words = batch.column(1)
        size = pc.list_value_length(words).fill_null(0).to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(size)), size)
        coded = words.flatten().dictionary_encode()
        distinct = max(len(coded.dictionary), 1)
        keys, tf = np.unique(doc * distinct + coded.indices.to_numpy(), return_counts=True)
        of, term = np.divmod(keys, distinct)
        rows = np.concatenate([of, np.arange(len(size))])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows)), pa.concat_arrays([coded.dictionary.take(pa.array(term)), pa.nulls(len(size), coded.dictionary.type)]), pa.array(np.concatenate([tf, size]).astype(np.float64)), pa.array(size[rows].astype(np.float64))],
            names=["doc_id", "term", "tf", "dl"],
        )
        pa.default_memory_pool().release_unused()


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf, dl: the corpus taken apart once, without a shuffle, for sizes, frequencies and scores alike; each document has a row without a term too.

    A stored table, to be deleted by ``dropped`` where nothing reads it any more.
    """
    if "tf" in docs.columns:
        return docs
    ship(docs.sparkSession)
    rows = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    with few_rows_a_batch(docs.sparkSession, DOCS_A_BATCH):
        return kept(rows.mapInArrow(_counted, f"doc_id {dict(docs.dtypes)['doc_id']}, term string, tf double, dl double"))


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_distinct."""
    t = tokens(F.col("text"))
    return docs.select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def document_frequencies(held: DataFrame) -> DataFrame:
    """term, df of ``postings``."""
    return held.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))


def corpus_size(held: DataFrame) -> DataFrame:
    """One row: n documents, avgdl, of ``postings``."""
    return held.where("term is null").agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))


def idf(frequencies: DataFrame, size: DataFrame, p: Bm25 = BM25) -> DataFrame:
    """term, df, raw_idf, idf: a negative idf becomes epsilon times the mean over all terms."""
    raw = frequencies.join(F.broadcast(size)).withColumn("raw_idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw_idf").alias("mean_idf"))  # one row
    return raw.join(F.broadcast(mean)).select("term", "df", "raw_idf", F.when(F.col("raw_idf") < 0, p.epsilon * F.col("mean_idf")).otherwise(F.col("raw_idf")).alias("idf"))


def bm25_scores(docs: DataFrame, queries: DataFrame, p: Bm25 = BM25) -> DataFrame:
    """query_id, doc_id, score of all pairs that share a term; docs: doc_id, text, or ``postings``; queries: query_id, text.

    Postings of terms that no query has go where they are read, so the shuffle
    follows the matches and not the corpus.
    """
    held = postings(docs)
    size = corpus_size(held)
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    n_asked = asked.count()
    terms = small(asked.select("term").distinct(), n_asked)
    weights = small(asked, n_asked).join(idf(document_frequencies(held), size, p).select("term", "idf"), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    matched = held.join(terms, "term", "left_semi").join(F.broadcast(size.select("avgdl")))
    part = F.col("tf") * (p.k1 + 1) / (F.col("tf") + p.k1 * (1 - p.b + p.b * F.col("dl") / F.col("avgdl")))
    return matched.select("doc_id", "term", part.alias("part")).join(small(weights, n_asked), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("part")).alias("score"))


def ranked(scores: DataFrame, k: int | None, by: str = "query_id", entry: str = "doc_id", score: str = "score", digits: int = 6) -> DataFrame:
    """``scores`` rounded, with rank by score, then entry; the first k."""
    rows = scores.withColumn(score, F.round(score, digits))
    order = Window.partitionBy(by).orderBy(F.desc(score), entry)
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows if k is None else rows.where(F.col("rank") <= k)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = RETRIEVAL.k) -> DataFrame:
    """The first k documents of each query; where fewer hold any of its terms, the first others by doc_id follow with score 0. docs: doc_id, text, or ``postings``."""
    held = postings(docs)
    top = kept(ranked(bm25_scores(held, queries), k).select("query_id", "doc_id", "score"))
    if held is not docs:
        dropped(held)
    few = queries.select("query_id").distinct().join(top.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k)
    first = docs.select("doc_id").distinct().orderBy("doc_id").limit(k)  # k rows hold enough that a query with fewer matches lacks
    others = few.select("query_id").join(F.broadcast(first)).join(top, ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return ranked(top.union(others), k)


def query_variants(queries: DataFrame) -> DataFrame:
    """query_id, source, text: the query alone (base) and once with each phrase.

    queries: query_id, text, phrases (map of kind to phrase array).
    """
    base = queries.select("query_id", F.lit("base").alias("source"), "text")
    each = queries.select("query_id", "text", F.explode("phrases").alias("kind", "list")).select("query_id", "text", "kind", F.posexplode("list").alias("i", "phrase"))
    source = F.when(F.col("i") == 0, F.col("kind")).otherwise(F.concat_ws("_", "kind", F.col("i").cast("string")))
    return base.unionByName(each.select("query_id", source.alias("source"), F.concat_ws(" ", "text", "phrase").alias("text")))


def boosted_search(docs: DataFrame, queries: DataFrame, k: int = RETRIEVAL.k) -> DataFrame:
    """query_id, doc_id, score, sources, boosted, rank: fan-out over variants, the best score of each entry, and boosts by phrase kind."""
    variants = query_variants(queries).withColumnRenamed("query_id", "qid").withColumn("query_id", F.struct("qid", "source"))
    held = postings(docs)
    hits = bm25_scores(held, variants.select("query_id", "text"))
    depth = F.when(F.col("query_id.source") == "base", 4 * k).otherwise(2 * k)
    hits = ranked(hits, None).where(F.col("rank") <= depth)
    merged = hits.groupBy(F.col("query_id.qid").alias("query_id"), "doc_id").agg(F.max("score").alias("score"), F.sort_array(F.collect_set("query_id.source")).alias("sources"))
    has = lambda kind: F.exists("sources", lambda s: s.startswith(kind))
    factor = 1.0 + sum((F.when(has(kind), b).otherwise(0.0) for kind, b in SCORING.phrase_boosts.items()), F.lit(0.0))
    merged = merged.withColumn("factor", factor).withColumn("score", F.col("score") * F.col("factor")).withColumn("boosted", F.col("factor") > 1)
    found = kept(ranked(merged.drop("factor"), k))
    if held is not docs:
        dropped(held)
    return found


def tfidf_relevance(pairs: DataFrame, floor: float = RETRIEVAL.relevance_floor, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """query_id, doc_id, relevance: cosine of TF-IDF vectors, fitted for each query on its text and its candidates.

    pairs: query_id, doc_id, text; doc_id null for the query's own text.
    """
    words = long_tokens(F.col("text"))
    if stopwords:
        words = F.filter(words, lambda w: ~w.isin(*stopwords))
    counts = pairs.select("query_id", "doc_id", F.explode(words).alias("term")).groupBy("query_id", "doc_id", "term").agg(F.count("*").cast("double").alias("tf"))
    n = pairs.groupBy("query_id").agg(F.count("*").cast("double").alias("n"))
    df = counts.groupBy("query_id", "term").agg(F.count("*").cast("double").alias("df"))
    weights = counts.join(df, ["query_id", "term"]).join(n, "query_id").withColumn("w", F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1))
    norms = weights.groupBy("query_id", "doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = weights.alias("w").join(norms.alias("m"), (F.col("w.query_id") == F.col("m.query_id")) & F.col("w.doc_id").eqNullSafe(F.col("m.doc_id")))
    unit = unit.select("w.query_id", "w.doc_id", "term", (F.col("w") / F.col("norm")).alias("u"))
    own = unit.where("doc_id is null").select("query_id", "term", F.col("u").alias("q"))
    dots = unit.where("doc_id is not null").join(own, ["query_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("u") * F.col("q")).alias("relevance"))
    return dots.where(F.col("relevance") > floor)


def phrase_matches(docs: DataFrame, queries: DataFrame, anchor: int = 5) -> DataFrame:
    """query_id, doc_id of documents that hold a query's whole text, case folded; nulls match nothing, an empty query all.

    Words 2 to 6 of a query stand whole in any text that holds it, so an
    equi-join on runs of five words finds the candidates and only those are
    searched. Queries of fewer words than that have no such run: they go by
    ``gram_matches``.
    """
    text = F.lower("text")
    words = F.array_remove(F.split(text, r"\s+"), "")
    run = lambda w, i: F.xxhash64(F.slice(w, i, anchor))
    n = queries.count()
    every = queries.where("text is not null").select("query_id", text.alias("q"), words.alias("w"))
    long = every.where(F.size("w") > anchor + 1).select("query_id", "q", run(F.col("w"), F.lit(2)).alias("run"))
    short = every.where(F.size("w") <= anchor + 1).select("query_id", "q")
    rows = docs.where("text is not null").select("doc_id", text.alias("text"), words.alias("w"))
    held = rows.where(F.size("w") >= anchor)
    # runs go without their text, which only candidates are joined with again
    runs = held.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - anchor + 1), lambda i: run(F.col("w"), i)))).alias("run"))
    candidates = runs.join(small(long, n, 4096), "run").select("query_id", "q", F.col("doc_id").alias("candidate")).distinct()
    found = candidates.join(rows, F.col("candidate").eqNullSafe(F.col("doc_id"))).where(F.contains("text", "q")).select("query_id", "doc_id")
    if short.limit(1).count():
        found = found.union(gram_matches(rows.select("doc_id", "text"), short))
    return found.distinct()


#: Letters of a gram, and how many of a query's grams, the rarest, candidates must hold.
GRAM, RAREST = 3, 4


def grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` letters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def gram_matches(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, doc_id of texts (doc_id, text) that hold a query (query_id, q) as it stands.

    An inverted index of the letter trigrams that queries have leads from the
    rarest trigrams of a query to its candidates, and only these are searched.
    Queries of one or two letters are grams themselves, of that size.
    """
    size = F.least(F.length("q"), F.lit(GRAM))
    sizes = [r[0] for r in asked.select(size).distinct().collect()]  # three at most, and the empty query's
    whole = [i for i in sizes if i]
    found = None
    if whole:
        n = asked.count()
        of_query = F.coalesce(*[F.when(size == i, grams(F.col("q"), i)) for i in whole])
        wanted = asked.where(size > 0).select("query_id", F.explode(of_query).alias("gram"))
        index = rows.select("doc_id", F.explode(F.concat(*[grams(F.col("text"), i) for i in whole])).alias("gram"))
        index = kept(index.join(small(wanted.select("gram").distinct(), 64 * n), "gram", "left_semi"))
        frequency = index.groupBy("gram").agg(F.count("*").alias("df"))
        rare = Window.partitionBy("query_id").orderBy("df", "gram")
        chosen = wanted.join(frequency, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("place", F.row_number().over(rare)).where(F.col("place") <= RAREST)
        needed = chosen.groupBy("query_id").agg(F.count("*").alias("needed"), F.min("df").alias("least")).where("least > 0")
        chosen = kept(chosen.select("query_id", "gram").join(needed.select("query_id", "needed"), "query_id"))
        held = index.join(small(chosen, RAREST * n), "gram").groupBy("query_id", "needed", "doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("needed"))
        candidates = held.select("query_id", F.col("doc_id").alias("candidate")).join(asked, "query_id")
        found = kept(candidates.join(rows, F.col("candidate").eqNullSafe(F.col("doc_id"))).where(F.contains("text", "q")).select("query_id", "doc_id"))
        dropped(index, chosen)
    if 0 in sizes:
        every = asked.where(size == 0).select("query_id").join(rows.select("doc_id"))  # what an empty query asks for
        found = found.union(every) if found is not None else every
    return found


def contains_folded(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))
