"""The operators bound to the supplied tables: one function per registered query.

A row of ``documents`` is a chunk, its language the namespace; ``embeddings`` are the vectors of
the documents with the same id; the passages of ``benchmark`` are the questions. Every query reads
its whole tables.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import Settings
from corpusloom.functions.globs import matches_any_glob
from corpusloom.functions.ids import cache_key, point_id
from corpusloom.functions.sse import stream_events
from corpusloom.functions.text import ROLES, clean_roles, tokenize
from corpusloom.functions.vectors import embedding_or_error, mock_embedding
from corpusloom.operators import bm25 as bm
from corpusloom.operators.answers import PRICES, mock_answers, prompts, token_cost, token_fragments
from corpusloom.operators.block_max import BlockMaxIndex, block_max_search
from corpusloom.operators.chunking import chunk_files, code_chunks, doc_chunks
from corpusloom.operators.contains import containing
from corpusloom.operators.dense import dense_search, dense_search_grid
from corpusloom.operators.fusion import cross_namespace_fuse, hybrid_fuse, rrf
from corpusloom.operators.hydrate import chunk_summary, display_rows, hydrate
from corpusloom.operators.metrics import aggregate_metrics, mean_recall, query_metrics
from corpusloom.operators.ranking import top_k
from corpusloom.operators.requests import answerable, split_valid, with_defaults
from corpusloom.operators.rerank import overlap_score, rerank_by, rerank_identity
from corpusloom.operators.sync import restrict_to, sync_counts, sync_diff
from corpusloom.operators.training import (
    hard_negatives,
    holdout_ids,
    holdout_split,
    positives,
    training_triples,
    with_stratum,
)
from corpusloom.plans.answer import answer
from corpusloom.plans.evaluate import Searched, dense_ranking, score_apart
from corpusloom.plans.search import hybrid_search, search_debug
from corpusloom.session import scratch_path
from corpusloom.sources.chunk_store import ChunkStore, as_stored, first_shas
from corpusloom.sources.embedding_cache import EmbeddingCache, fill_misses
from corpusloom.sources.golden import golden_namespaces

NAMESPACES = ["de", "en", "es", "fr"]
POOL = 50
HIT_GROUP = ["query_id", "namespace"]
METADATA = ["heading_path", "language", "commit_sha", "start_line", "end_line"]
METRICS = ["recall_at_5", "recall_at_10", "mrr_at_10", "precision_at_5"]
MODEL = "BAAI/bge-base-en-v1.5"
QUOTAS = {"de": 3, "en": 3, "es": 2, "fr": 2}
GLOBS = ["en/**", "*/7*", "**/*.html", "d?/[0-4]*"]
ROLE_SAMPLES = {
    " the ": " :class:`the` ",
    " and ": " :ref:`and <some-target>` ",
    " de ": " :py:func:`~de` ",
    " und ": " :doc:` und  <a/b> ` ",
}
# (first letters of a line, text before its first sentence, text after it)
MD_STYLES = [("A-H", "# ", " ##\n"), ("I-P", "## ", "\n"), ("Q-Z", "#### ", "\n")]
RST_STYLES = [("A-H", "", "\n" + "=" * 40 + "\n"), ("I-P", "", "\n" + "-" * 40 + "\n"), ("Q-Z", "", "\n" + "~" * 40 + "\n")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, namespace: str = "lang") -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col(namespace).alias("namespace"),
        F.concat("source", F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("file_path"),
        F.sha2("text", 256).alias("commit_sha"),
        F.lit("doc").alias("chunk_type"),
        F.col("doc_id").cast("string").alias("symbol"),
        F.col("source").alias("heading_path"),
        F.lit(None).cast("string").alias("language"),
        F.lit(1).alias("start_line"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("end_line"),
        "text",
    )


def vectors(spark: SparkSession, sf_dir: str, namespace: str = "lang") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col(namespace).alias("namespace"))
    found = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return docs.join(found, "doc_id").withColumn("doc_id", F.col("doc_id").cast("string"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short passages ask one namespace, long ones all of them."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("question"),
        F.when(F.length("text") < 200, F.array(F.lit("en")))
        .otherwise(F.array(*[F.lit(n) for n in NAMESPACES]))
        .alias("namespaces"),
    )


def vector_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the vector of their number; one without is still answered by its words."""
    found = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")
    )
    return requests(spark, sf_dir).join(found, "query_id", "left")


def _int(name: str):
    return F.col(name).cast("int").alias(name)


def _six(name: str):
    return F.round(name, 6).alias(name)


def tokenize_docs(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", tokenize(F.col("text")).alias("tokens"))


def term_frequency(spark, sf_dir):
    tokens = bm.tokenised(chunks(spark, sf_dir))
    return bm.term_frequencies(tokens).select("doc_id", "term", _int("tf"), _int("dl"))


def _statistics(spark, sf_dir, namespace="lang"):
    return bm.term_statistics(bm.tokenised(chunks(spark, sf_dir, namespace)))


def document_frequency(spark, sf_dir):
    return bm.document_frequencies(_statistics(spark, sf_dir))


def namespace_stats(spark, sf_dir):
    stats = bm.namespace_stats(_statistics(spark, sf_dir, "source"))
    return stats.select("namespace", "n_docs", _six("avgdl"))


def bm25_idf(spark, sf_dir):
    index = bm.Bm25Index.build(chunks(spark, sf_dir))
    return bm.idf_table(index.frequencies, index.means).select("namespace", "term", "n", _six("idf"))


def bm25_topk(spark, sf_dir):
    index = bm.Bm25Index.build(chunks(spark, sf_dir))
    hits = bm.bm25_search(index, requests(spark, sf_dir), POOL)
    return hits.select("query_id", "namespace", "doc_id", _six("score"), _int("rank"))


def bm25_topk_postings(spark, sf_dir):
    """The same over a written index, pruned to the buckets of the questions' words."""
    path = scratch_path(spark, "postings")
    bm.Bm25Index.build(chunks(spark, sf_dir)).write(path)
    hits = bm.bm25_search(bm.Bm25Index.read(spark, path), requests(spark, sf_dir), POOL)
    return hits.select("query_id", "namespace", "doc_id", _six("score"), _int("rank"))


def bm25_topk_block_max(spark, sf_dir):
    """The same over written lists of blocks, of which only those that can hold a hit are scored."""
    path = scratch_path(spark, "blocks")
    BlockMaxIndex.build(chunks(spark, sf_dir), block_docs=16).write(path)
    hits = block_max_search(BlockMaxIndex.read(spark, path), requests(spark, sf_dir), POOL).hits
    return hits.select("query_id", "namespace", "doc_id", _six("score"), _int("rank"))


def bm25_topk_by_source(spark, sf_dir):
    """Every passage against every source as a namespace of its own."""
    names = table(spark, sf_dir, "documents").select("source").distinct()
    sources = sorted(row["source"] for row in names.collect())
    asked = requests(spark, sf_dir).withColumn("namespaces", F.array(*[F.lit(n) for n in sources]))
    index = bm.Bm25Index.build(chunks(spark, sf_dir, "source"))
    hits = bm.bm25_search(index, asked, 10)
    return hits.select("query_id", "namespace", "doc_id", _six("score"), _int("rank"))


def dense_topk(spark, sf_dir):
    hits = dense_search(vectors(spark, sf_dir), vector_requests(spark, sf_dir), POOL)
    return hits.select("query_id", "namespace", "doc_id", _six("score"), _int("rank"))


def dense_topk_grid(spark, sf_dir):
    """The same through the grid of blocks that batches of any size take."""
    hits = dense_search_grid(vectors(spark, sf_dir), vector_requests(spark, sf_dir), POOL, docs_per_cell=64, queries_per_cell=32)
    return hits.select("query_id", "namespace", "doc_id", _six("score"), _int("rank"))


def _retrievers(spark, sf_dir):
    index = bm.Bm25Index.build(chunks(spark, sf_dir))
    return (
        bm.bm25_search(index, requests(spark, sf_dir), POOL),
        dense_search(vectors(spark, sf_dir), vector_requests(spark, sf_dir), POOL),
    )


def hybrid_fusion(spark, sf_dir):
    fused = hybrid_fuse(*_retrievers(spark, sf_dir))
    return fused.select("query_id", "namespace", "doc_id", _six("score"), _int("rank"))


def cross_namespace_fusion(spark, sf_dir):
    fused = hybrid_fuse(*_retrievers(spark, sf_dir))
    final = cross_namespace_fuse(fused, requests(spark, sf_dir), POOL)
    return final.select("query_id", "namespace", "doc_id", _six("score"), _int("rank"))


def rrf_variadic(spark, sf_dir):
    """Three lists per query and namespace: BM25, cosine, and the BM25 hits in id order."""
    lexical, near = _retrievers(spark, sf_dir)
    by_id = top_k(lexical.drop("rank"), HIT_GROUP, [F.col("doc_id")], POOL)
    lists = [
        hits.select(*HIT_GROUP, "doc_id", "rank", F.lit(number).alias("list_no"))
        for number, hits in enumerate((lexical, near, by_id))
    ]
    fused = rrf(lists[0].unionByName(lists[1]).unionByName(lists[2]), HIT_GROUP)
    return fused.select(*HIT_GROUP, "doc_id", _six("score"), _int("rank"))


def _search(spark, sf_dir, k=POOL):
    corpus = chunks(spark, sf_dir)
    asked = vector_requests(spark, sf_dir)
    return hybrid_search(
        corpus, bm.Bm25Index.build(corpus), asked, k, vectors=vectors(spark, sf_dir)
    )


def hybrid_search_hydrated(spark, sf_dir):
    meta = F.col("metadata")
    found = _search(spark, sf_dir, 10).hydrated
    return found.select(
        "query_id", _int("rank"), _six("score"), "doc_id", "namespace", "path", "symbol",
        "chunk_type", "text", *[meta[key].alias(key) for key in METADATA],
    )


def hydration_by_filter(spark, sf_dir):
    """Ranked ids hydrated as those of a batch without bound are: the scan of the chunks is filtered by them."""
    ranked = _search(spark, sf_dir, 10).ranked.persist()
    meta = F.col("metadata")
    found = hydrate(ranked, chunks(spark, sf_dir), small=False)
    return found.select(
        "query_id", _int("rank"), _six("score"), "doc_id", "namespace", "path", "symbol",
        "chunk_type", "text", *[meta[key].alias(key) for key in METADATA],
    )


def hybrid_search_debug(spark, sf_dir):
    debug = search_debug(_search(spark, sf_dir), vector_requests(spark, sf_dir))

    def names(stage):
        return F.transform(stage, lambda hit: F.concat_ws("/", hit["namespace"], hit["doc_id"]))

    return debug.select("query_id", *[names(c).alias(c) for c in debug.columns if c != "query_id"])


def api_summary(spark, sf_dir):
    rows = chunk_summary(_search(spark, sf_dir, 10).hydrated)
    return rows.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("int")})


def inspection_table(spark, sf_dir):
    rows = display_rows(_search(spark, sf_dir).ranked)
    return rows.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("int")})


def _candidates(spark, sf_dir):
    asked = requests(spark, sf_dir).select("query_id", "question")
    return _search(spark, sf_dir).hydrated.join(asked, "query_id")


def _reranked(df):
    return df.select("query_id", "doc_id", "score_kind", _six("score"), _int("rank"))


def rerank_identity_top10(spark, sf_dir):
    return _reranked(rerank_identity(_candidates(spark, sf_dir), 10))


def rerank_overlap_top10(spark, sf_dir):
    score = overlap_score(F.col("question"), F.col("text"))
    return _reranked(rerank_by(_candidates(spark, sf_dir), score, 10))


def request_validation(spark, sf_dir):
    raw = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"),
        F.when(F.col("role") == "system", "").otherwise(F.col("text")).alias("question"),
        F.array().cast("array<string>").alias("namespaces"),
        (F.col("turn") * 20).cast("int").alias("top_k"),
    )
    accepted, rejected = split_valid(with_defaults(raw, NAMESPACES))
    columns = ["query_id", "namespaces", "top_k", "retrieval_only", "violation"]
    return accepted.withColumn("violation", F.lit(None).cast("string")).select(*columns).unionByName(
        rejected.select(*columns)
    )


def relevant_chunks(spark, sf_dir):
    """Documents that contain a passage are relevant to it."""
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    corpus = chunks(spark, sf_dir).select("namespace", "file_path", "symbol", "text")
    return containing(corpus, passages).select("query_id", "namespace", F.col("file_path").alias("path"), "symbol")


def retrieval_metrics(spark, sf_dir):
    found = _search(spark, sf_dir, 10).hydrated
    scored = query_metrics(requests(spark, sf_dir), found, relevant_chunks(spark, sf_dir))
    return scored.select("query_id", _int("retrieved_count"), *[_six(c) for c in METRICS])


def evaluation_means(spark, sf_dir):
    found = _search(spark, sf_dir, 10).hydrated
    scored = query_metrics(requests(spark, sf_dir), found, relevant_chunks(spark, sf_dir))
    return aggregate_metrics(scored).select(
        "items", "evaluated", "skipped", *[_six(c) for c in METRICS]
    )


class _Moody:
    """An encoder that fails on every question whose length is divisible by five."""

    def encode(self, sentences, **options):
        if any(len(s) % 5 == 0 for s in sentences):
            raise ValueError("cannot encode")
        return np.ones((len(sentences), 2))


def evaluation_with_skips(spark, sf_dir):
    """Means over the questions that the encoder can take; the others are skipped by row, in the same job."""
    asked = vector_requests(spark, sf_dir)
    made = asked.withColumn("error", embedding_or_error(F.col("question"), _Moody)["error"]).persist()
    corpus = chunks(spark, sf_dir)
    found = hybrid_search(corpus, bm.Bm25Index.build(corpus), made.where("error IS NULL").drop("error"), 10, vectors=vectors(spark, sf_dir))
    searched = Searched(found.hydrated, made.where("error IS NOT NULL").select("query_id", "error"))
    scored = score_apart(asked, searched, relevant_chunks(spark, sf_dir))
    return aggregate_metrics(scored).select("items", "evaluated", "skipped", *[_six(c) for c in METRICS])


def dense_evaluation(spark, sf_dir):
    corpus = chunks(spark, sf_dir).join(
        vectors(spark, sf_dir).select("doc_id", "embedding"), "doc_id"
    )
    ranking = dense_ranking(corpus, vector_requests(spark, sf_dir), None, 10)
    relevant = relevant_chunks(spark, sf_dir)
    return mean_recall(requests(spark, sf_dir), ranking, relevant, 10).select(
        "evaluated", _six("recall")
    )


def model_comparison(spark, sf_dir):
    """Dense recall@10 of two models: the given vectors, and mock vectors of texts and questions."""
    relevant, asked = relevant_chunks(spark, sf_dir), vector_requests(spark, sf_dir)
    corpus = chunks(spark, sf_dir)
    given = corpus.join(vectors(spark, sf_dir).select("doc_id", "embedding"), "doc_id")
    rankings = {
        "given": dense_ranking(given, asked, None, 10),
        "mock": dense_ranking(corpus, asked, lambda text: mock_embedding(text, 16), 10),
    }
    rows = [
        mean_recall(requests(spark, sf_dir), ranking, relevant, 10).select(
            F.lit(label).alias("model"), "evaluated", _six("recall")
        )
        for label, ranking in rankings.items()
    ]
    return rows[0].unionByName(rows[1])


def _current_state(spark, sf_dir):
    return chunks(spark, sf_dir).select("file_path", "commit_sha")


def _earlier_state(spark, sf_dir):
    """Labelled documents, unchanged where the quality is 1, and pages that are gone by now."""
    old = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string"), "quality")
    known = chunks(spark, sf_dir).select("doc_id", "file_path", "commit_sha").join(old, "doc_id")
    sha = F.when(F.col("quality") == 1, F.col("commit_sha")).otherwise(F.lit("older"))
    gone = table(spark, sf_dir, "pages").select(
        F.concat_ws("/", F.lit("pages"), F.col("page_id")).alias("file_path"), F.lit("gone").alias("commit_sha")
    )
    return known.select("file_path", sha.alias("commit_sha")).unionByName(gone)


def sync_plain(spark, sf_dir):
    return sync_diff(_current_state(spark, sf_dir), _earlier_state(spark, sf_dir))


def sync_forced(spark, sf_dir):
    return sync_diff(_current_state(spark, sf_dir), _earlier_state(spark, sf_dir), force=True)


def sync_unreadable(spark, sf_dir):
    """Files of one source cannot be read now; indexed ones of another have no key."""
    now = chunks(spark, sf_dir).select(
        "file_path", F.when(F.col("heading_path") != "src1", F.col("commit_sha")).alias("commit_sha")
    )
    before = _earlier_state(spark, sf_dir).select(
        "file_path", F.when(~F.startswith("file_path", F.lit("src2/")), F.col("commit_sha")).alias("commit_sha")
    )
    return sync_diff(now, before)


def sync_restricted(spark, sf_dir):
    """The diff limited to a given set of files: those labelled toxic."""
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string"))
    paths = chunks(spark, sf_dir).join(toxic, "doc_id", "left_semi").select("file_path")
    return restrict_to(sync_plain(spark, sf_dir), paths)


def ingest_counts(spark, sf_dir):
    return sync_counts(sync_plain(spark, sf_dir))


def store_sync(spark, sf_dir):
    """Live rows of a store that held the earlier state and then took the diff."""
    store = ChunkStore(spark, scratch_path(spark, "store"))
    corpus = chunks(spark, sf_dir)
    old = _earlier_state(spark, sf_dir).select(
        "file_path", "commit_sha", F.lit("all").alias("namespace"), F.lit("old").alias("text"),
        F.col("file_path").alias("doc_id"),
    )
    store.upsert(old)
    diff = sync_diff(_current_state(spark, sf_dir), store.file_shas("all"))
    changed = diff.where(F.col("action").isin("add", "update")).select("file_path")
    new = corpus.join(changed, "file_path", "left_semi").select(
        "file_path", "commit_sha", F.lit("all").alias("namespace"), "text",
        F.col("file_path").alias("doc_id"),
    )
    gone = diff.where(F.col("action").isin("delete", "update")).select(
        F.lit("all").alias("namespace"), "file_path"
    )
    store.apply(as_stored(new), removed_files=gone)
    return store.read("all").select("doc_id", "namespace", "file_path", "commit_sha", "text")


def state_scroll(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("doc_id"),
        F.col("conv_id").cast("string").alias("file_path"),
        F.sha2("text", 256).alias("commit_sha"),
    )
    return first_shas(rows)


def point_ids(spark, sf_dir):
    made = point_id(*[F.col(c) for c in ("namespace", "file_path", "symbol", "start_line", "end_line")])
    return chunks(spark, sf_dir).select("doc_id", made.alias("point_id"))


def cache_keys(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", cache_key(F.col("text"), MODEL).alias("cache_key"))


def mock_embeddings(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", mock_embedding(F.col("text"), 20).alias("embedding"))


def cache_fill(spark, sf_dir):
    """New cache rows for all documents, given a cache of those that have a vector."""
    keyed = chunks(spark, sf_dir).select(
        "doc_id", cache_key(F.col("text"), MODEL).alias("cache_key"), "text"
    )
    cached = keyed.join(vectors(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")
    return fill_misses(keyed, cached.select("cache_key"), lambda text: mock_embedding(text, 8))


def cache_lookup(spark, sf_dir):
    """Documents of one source without text, a cache that holds some texts twice, and an encoder for the rest."""
    corpus = chunks(spark, sf_dir).select("doc_id", F.when(F.col("heading_path") != "src3", F.col("text")).alias("text"))
    known = corpus.join(vectors(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")
    keyed = known.select(F.col("doc_id").cast("long").alias("number"), cache_key(F.col("text"), MODEL).alias("cache_key"))
    cache = EmbeddingCache(spark, scratch_path(spark, "cache"), MODEL, buckets=8)
    cache.store(keyed.select("cache_key", F.array(F.lit(1.0)).alias("vector")))
    cache.store(keyed.where("number % 2 = 0").select("cache_key", F.array(F.lit(2.0)).alias("vector")))
    found = cache.embed(corpus, lambda text: F.array(F.length(text).cast("float"), F.lit(0.5).cast("float")))
    return found.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"))


def clean_role_markup(spark, sf_dir):
    """Documents with role markup put in, and taken out again."""
    marked = F.col("text")
    for plain, markup in ROLE_SAMPLES.items():
        marked = F.replace(marked, F.lit(plain), F.lit(markup))
    return chunks(spark, sf_dir).select("doc_id", clean_roles(marked).alias("text"))


def _all_roles(text):
    """Every role in turn, by document, around the words of a text, in three ways of writing."""
    number = F.col("doc_id").cast("long")
    role = F.array(*[F.lit(r) for r in ROLES])[F.pmod(number, F.lit(len(ROLES))).cast("int")]
    prefix = F.when(number % 2 == 0, "py:").otherwise("")
    before = F.when(number % 3 == 0, "`~").otherwise("`")
    after = F.when(number % 3 == 1, " <some.target>`").otherwise("`")
    word = F.concat(F.lit(":"), prefix, role, F.lit(":"), before, F.lit("$1"), after)
    return F.regexp_replace(text, F.lit(r"(?<![^ \n])([\p{L}]+)(?![^ \n])"), word)


def clean_all_roles(spark, sf_dir):
    """Whole texts with all roles put in, and taken out again."""
    marked = _all_roles(F.col("text"))
    return chunks(spark, sf_dir).select("doc_id", (F.length(marked) > F.length("text")).alias("marked"), clean_roles(marked).alias("text"))


def clean_role_words(spark, sf_dir):
    """The same, with the number of letters that the markup of the whole text added."""
    marked = _all_roles(F.col("text"))
    added = (F.length(marked) - F.length("text")).cast("int")
    return chunks(spark, sf_dir).select("doc_id", clean_roles(marked).alias("text"), added.alias("added"))


def _headed(spark, sf_dir, suffix: str, styles):
    """Documents whose lines open with headings: a line's first letter decides the style."""
    text = F.col("text")
    for letters, before, after in styles:
        text = F.regexp_replace(text, rf"(^|\n)([{letters}][^\n.]*)\.", f"$1{before}$2{after}")
    path = F.concat(F.col("doc_id"), F.lit(suffix))
    return chunks(spark, sf_dir).select(path.alias("path"), text.alias("text"))


def md_chunks(spark, sf_dir):
    return doc_chunks(_headed(spark, sf_dir, ".md", MD_STYLES))


def rst_chunks(spark, sf_dir):
    return doc_chunks(_headed(spark, sf_dir, ".rst", RST_STYLES))


def whole_file_chunks(spark, sf_dir):
    return doc_chunks(_headed(spark, sf_dir, ".txt", []))


def mixed_file_chunks(spark, sf_dir):
    """One table of files of four kinds, cut by their suffix: by document headed prose, plain text and code."""
    number = F.regexp_extract("path", r"^\d+", 0).cast("long")
    remarks = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")))  # a source without definitions
    commented = _headed(spark, sf_dir, ".py", []).withColumn("text", remarks)
    kinds = [_headed(spark, sf_dir, ".md", MD_STYLES), _headed(spark, sf_dir, ".rst", RST_STYLES), _headed(spark, sf_dir, ".txt", []), commented]
    files = reduce(DataFrame.unionByName, [kind.where(number % 4 == i) for i, kind in enumerate(kinds)])
    columns = ["path", "chunk_type", "language", "symbol", "heading_path", "level", "start_line", "end_line", "text"]
    return chunk_files(files).select(*columns)


def py_ast_chunks(spark, sf_dir):
    """User turns rendered as Python sources; other turns are no valid source."""
    source = F.concat(
        F.lit("import os\n\n@os.wrap\ndef turn_"), "turn", F.lit('():\n    return """'), "text",
        F.lit('"""\n\n\nclass Conv'), "conv_id", F.lit(":\n    turn = "), "turn", F.lit("\n"),
    )
    files = table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", F.lit("c"), "conv_id", F.concat("turn", F.lit(".py"))).alias("path"),
        F.when(F.col("role") == "user", source)
        .otherwise(F.concat(F.lit("def ("), F.col("text")))
        .alias("text"),
    )
    return code_chunks(files).drop("error")


def glob_filter(spark, sf_dir):
    path = F.regexp_extract("url", r"^https?://[^/]*/([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).where(
        matches_any_glob(F.col("path"), GLOBS)
    )


def prompt_context(spark, sf_dir):
    made = prompts(requests(spark, sf_dir), _search(spark, sf_dir, 10).hydrated)
    return made.select("query_id", "context", "user_message")


def namespace_summary(spark, sf_dir):
    return mock_answers(requests(spark, sf_dir), _search(spark, sf_dir, 10).hydrated)


def mock_token_stream(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", token_fragments(F.col("text")).alias("fragments")
    )


def answer_events(spark, sf_dir):
    """Every passage answered end to end; long passages ask for retrieval only."""
    corpus = chunks(spark, sf_dir)
    asked = vector_requests(spark, sf_dir).withColumns(
        {"top_k": F.lit(10), "retrieval_only": F.length("question") > 300}
    )
    settings = Settings(reranker_type="identity")
    result = answer(
        corpus, bm.Bm25Index.build(corpus), asked, settings, NAMESPACES, vectors=vectors(spark, sf_dir)
    )
    paths = F.from_json("data", "chunks array<struct<file_path:string>>")["chunks"]["file_path"]
    retrieved = F.col("event") == "retrieved"
    return result.events.select(
        "query_id",
        _int("seq"),
        "event",
        F.when(retrieved, F.array_join(paths, " ")).otherwise(F.col("data")).alias("data"),
    )


def event_parsing(spark, sf_dir):
    """Turns framed as event streams and parsed back."""
    body = F.concat(
        F.lit("event: "), "role", F.lit("\ndata: "), F.replace("text", F.lit("\n"), F.lit("\ndata: ")),
        F.lit("\n\n: ping\n\nid: 7\nevent:done\ndata\n\n"),
    )
    streams = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("stream_id"), body.alias("body")
    )
    return stream_events(streams, "stream_id").select("stream_id", _int("seq"), "event", "data")


def token_costs(spark, sf_dir):
    usage = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "assistant", F.lit(next(iter(PRICES)))).otherwise(F.col("role")).alias("model"),
        F.length("text").alias("prompt_tokens"),
        F.size(tokenize(F.col("text"))).alias("completion_tokens"),
    )
    return token_cost(usage).select(
        "conv_id", "turn", "model", F.round("input_cost", 9).alias("input_cost"),
        F.round("output_cost", 9).alias("output_cost"),
    )


def holdout(spark, sf_dir):
    """Items over one namespace are short documents; long ones count as crossing two."""
    docs = table(spark, sf_dir, "documents")
    items = docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("n_chars") <= 5000, F.array("lang"))
        .otherwise(F.array("lang", "source"))
        .alias("namespaces"),
    )
    return holdout_ids(with_stratum(items), QUOTAS)


def holdout_rest(spark, sf_dir):
    """What the hold-out leaves for training."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.array("lang").alias("namespaces"))
    train, held = holdout_split(items, QUOTAS)
    return train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("holdout"))).select("id", "part")


def answerable_requests(spark, sf_dir):
    """Whole turns, those of every third conversation blanked out, asked of a namespace for users and of none for others."""
    blank = F.when(F.col("conv_id") % 3 == 0, F.regexp_replace("text", r"\S", "")).otherwise(F.col("text"))
    asked = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"),
        blank.alias("question"),
        F.when(F.col("role") == "system", F.array().cast("array<string>")).otherwise(F.array(F.lit("en"))).alias("namespaces"),
    )
    return answerable(asked).select("query_id", "question")


def cross_namespace_same_ids(spark, sf_dir):
    """The same ids in two namespaces: both ranks count, and the namespace asked first has the id."""
    hits = bm.bm25_search(bm.Bm25Index.build(chunks(spark, sf_dir)), requests(spark, sf_dir), 5)
    twice = hits.unionByName(hits.withColumn("namespace", F.concat("namespace", F.lit("-copy"))))
    asked = requests(spark, sf_dir).withColumn(
        "namespaces", F.flatten(F.transform("namespaces", lambda n: F.array(n, F.concat(n, F.lit("-copy")))))
    )
    fused = cross_namespace_fuse(twice, asked, 8)
    return fused.select("query_id", "namespace", "doc_id", _six("score"), _int("rank"))


def golden_namespace_list(spark, sf_dir):
    items = requests(spark, sf_dir).select("namespaces")
    return golden_namespaces(items)


def _negatives(spark, sf_dir, relevant):
    return hard_negatives(_search(spark, sf_dir, 20).hydrated, relevant, 3)


def hard_negative_chunks(spark, sf_dir):
    relevant = relevant_chunks(spark, sf_dir)
    return _negatives(spark, sf_dir, relevant).select("query_id", "text", _int("rank"))


def contrastive_triples(spark, sf_dir):
    relevant = relevant_chunks(spark, sf_dir)
    found = positives(relevant, chunks(spark, sf_dir))
    return training_triples(requests(spark, sf_dir), found, _negatives(spark, sf_dir, relevant))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_docs,
        term_frequency,
        document_frequency,
        namespace_stats,
        bm25_idf,
        bm25_topk,
        bm25_topk_by_source,
        bm25_topk_postings,
        bm25_topk_block_max,
        dense_topk,
        dense_topk_grid,
        hybrid_fusion,
        cross_namespace_fusion,
        rrf_variadic,
        hybrid_search_hydrated,
        hydration_by_filter,
        hybrid_search_debug,
        api_summary,
        inspection_table,
        rerank_identity_top10,
        rerank_overlap_top10,
        request_validation,
        relevant_chunks,
        retrieval_metrics,
        evaluation_means,
        evaluation_with_skips,
        dense_evaluation,
        model_comparison,
        sync_plain,
        sync_forced,
        sync_restricted,
        sync_unreadable,
        clean_all_roles,
        clean_role_words,
        holdout_rest,
        answerable_requests,
        cross_namespace_same_ids,
        golden_namespace_list,
        ingest_counts,
        store_sync,
        state_scroll,
        point_ids,
        cache_keys,
        mock_embeddings,
        cache_fill,
        cache_lookup,
        clean_role_markup,
        md_chunks,
        rst_chunks,
        whole_file_chunks,
        mixed_file_chunks,
        py_ast_chunks,
        glob_filter,
        prompt_context,
        namespace_summary,
        mock_token_stream,
        answer_events,
        event_parsing,
        token_costs,
        holdout,
        hard_negative_chunks,
        contrastive_triples,
    )
}
