"""The driver's queries over its tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import scratch
from folioflow.functions import text as X
from folioflow.operators import answering, bm25, chunking, evaluation, fusion, latent, running_lines, vector
from folioflow.operators.vector_index import VectorIndex
from folioflow.plans import store
from folioflow.sources import datasource, docx
from folioflow.streaming import arrivals

Query = Callable[[SparkSession, str], DataFrame]

TOP, POOL, HITS = 20, 20, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return scratch.spread(found) if name == "documents" else found


def _segments(spark: SparkSession, sf_dir: str, text) -> DataFrame:
    """Each document as one segment."""
    docs = table(spark, sf_dir, "documents")
    null = F.lit(None)
    return docs.select(
        F.format_string("d%d", "doc_id").alias("doc_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("doc_name"), F.lit(0).alias("seg_no"),
        null.cast("int").alias("page"), F.col("source").alias("section"), text.alias("text"), F.lit("text").alias("method"),
    )


def _one_paragraph() -> F.Column:
    return F.array_join(X.words(F.col("text")), " ")


def _packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_segments(_segments(spark, sf_dir, F.replace("text", F.lit("\n"), F.lit("\n\n"))))


def _window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_segments(_segments(spark, sf_dir, _one_paragraph()))


def _doc_chunks(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Documents as chunks of their own; the number is the id, so ties are broken by it."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", *columns)


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_chunks(spark, sf_dir).select("chunk_id", "doc_id", "chunk_index", "word_count", "text")


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed_chunks(spark, sf_dir).select("chunk_id", "doc_id", "chunk_index", "word_count", "text")


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit(" \t "), F.replace("text", F.lit(" "), F.lit("  \t ")), F.lit("\n\n\n\nend \n"))
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_text(dirty).alias("clean"))


def repeat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as the pages of one file; a tenth of them makes a line run."""
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.filter(F.split("text", "\n"), lambda p: p != "").alias("paragraphs"))
    kept = running_lines.without_running_lines(pages, ratio=0.1)
    return kept.select("doc_id", "page", F.size("paragraphs").alias("n_paragraphs"), F.array_join("paragraphs", "\n").alias("text"))


def needs_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", running_lines.needs_ocr(X.tidy(F.col("text")), 300).alias("needs_ocr"))


def doc_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.content_id(F.col("text").cast("binary")).alias("content_id"))


def dedup_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status precedence: a known content is a duplicate even if it has no words; the first arrival of a content counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.content_id(F.col("text").cast("binary")).alias("content_id"), F.size(X.words(F.col("text"))).alias("n"))
    first = docs.groupBy("content_id").agg(F.min("doc_id").alias("first"))
    status = F.when(F.col("doc_id") > F.col("first"), "duplicate").when(F.col("n") < chunking.MIN_WORDS, "no_text").otherwise("indexed")
    return docs.join(first, "content_id").select("doc_id", "content_id", status.alias("status"))


def doc_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.catalog(_packed_chunks(spark, sf_dir)).select("doc_id", "doc_name", "n_chunks")


def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.stats(_segments(spark, sf_dir, F.col("text")), _packed_chunks(spark, sf_dir))
    return found.withColumn("mean_words", F.round("mean_words", 6))


def doc_text_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.document_texts(_packed_chunks(spark, sf_dir))


def conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.concat("role", F.lit(": "), "text").alias("text"))
    return store.document_texts(turns).withColumnRenamed("doc_id", "conv_id")


def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark(spark, sf_dir).select(F.col("query_id").alias("item_id"), F.array_join(X.query_tokens(F.col("query")), " ").alias("tokens"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.top(bm25.build_index(_doc_chunks(spark, sf_dir), stem=False), _benchmark(spark, sf_dir), TOP).select("query_id", "chunk_id", "score", "rank")


def bm25_doc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _doc_chunks(spark, sf_dir, ("lang",))
    allowed = chunks.where("lang = 'de'").select("chunk_id")
    return bm25.top(bm25.build_index(chunks, stem=False), _benchmark(spark, sf_dir), TOP, allowed).select("query_id", "chunk_id", "score", "rank")


def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.top(bm25.build_index(_doc_chunks(spark, sf_dir)), _benchmark(spark, sf_dir), TOP).select("query_id", "chunk_id", "score", "rank")


def bm25_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query tokens with an underscore are phrases of adjacent terms: every two words that stand side by side in an item."""
    words = X.index_tokens(F.col("query"))
    pairs = F.transform(F.slice(words, 2, 1 << 30), lambda w, i: F.concat_ws("_", F.get(words, i), w))
    asked = _benchmark(spark, sf_dir).select("query_id", F.array_join(pairs, " ").alias("query"))
    return bm25.matches(bm25.build_index(_doc_chunks(spark, sf_dir), stem=False), asked)


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.build_index(_doc_chunks(spark, sf_dir), stem=False).term_counts()


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of a vector search: every id divisible by 20."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.top(_vectors(spark, sf_dir), _asked(spark, sf_dir), TOP, "vec_id")


def cosine_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.top(_vectors(spark, sf_dir).where("label in (1, 3, 5)"), _asked(spark, sf_dir), TOP, "vec_id")


def cosine_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As cosine_topk, by an index of all rows that is built for it."""
    index = VectorIndex.build(_vectors(spark, sf_dir), f"{scratch.folder(spark)}/vectors", "vec_id")
    return index.top(None, _asked(spark, sf_dir), TOP, "vec_id")


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = table(spark, sf_dir, "documents").select("doc_id", F.explode(vector.HashingEmbedder(256).buckets(F.col("text"))).alias("bucket"))
    counts = buckets.groupBy("doc_id", "bucket").agg(F.count("*").alias("n"))
    norm = counts.groupBy("doc_id").agg(F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double"))).alias("norm"))
    return counts.join(norm, "doc_id").select("doc_id", "bucket", F.round(F.col("n") / F.col("norm"), 6).alias("weight"))


def _item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors that stand for the benchmark's items: those of their numbers."""
    return _benchmark(spark, sf_dir).select("query_id").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every item asked both ways: its text by BM25, and the vector of its number by cosine."""
    keyword = bm25.top(bm25.build_index(_doc_chunks(spark, sf_dir), stem=False), _benchmark(spark, sf_dir), POOL)
    semantic = vector.top(_vectors(spark, sf_dir), _item_vectors(spark, sf_dir), POOL, "vec_id").withColumnRenamed("vec_id", "chunk_id")
    return semantic, keyword


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fusion.fuse(*_lists(spark, sf_dir), k=HITS)
    return found.select("query_id", "chunk_id", "score", "semantic_score", "keyword_score", "rank")


def _scored_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused hits with a cosine for each: that of the stored vector where the semantic list lacks it."""
    hits, vectors = fusion.fuse(*_lists(spark, sf_dir), k=HITS), _vectors(spark, sf_dir)
    own = vectors.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("a"))
    asked = _item_vectors(spark, sf_dir).withColumnRenamed("embedding", "b")
    filled = hits.join(own, "chunk_id", "left").join(asked, "query_id", "left").withColumn("semantic_score", F.coalesce("semantic_score", F.round(vector.dot(F.col("a"), F.col("b")), 6)))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "text")
    cite = X.citation(F.col("source"), F.when(F.col("chunk_id") % 2 == 0, (F.col("chunk_id") % 10).cast("int")), F.when(F.col("chunk_id") % 3 == 0, F.lit("part")))
    return filled.join(docs, "chunk_id").select(F.col("query_id").cast("string").alias("query_id"), F.col("rank").cast("int").alias("rank"), "chunk_id", "score", "semantic_score", cite.alias("citation"), "text", F.col("source").alias("doc_name"))


def cosine_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_hits(spark, sf_dir).select("query_id", "rank", "chunk_id", "semantic_score", "citation")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.evidence(_scored_hits(spark, sf_dir), _benchmark(spark, sf_dir), 0.95)


def abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("query_id", "abstained", "top_score")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("query_id", F.array_join("citations", "; ").alias("citations"))


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.prompts(_scored_hits(spark, sf_dir), _benchmark(spark, sf_dir), 0.95)


def no_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers: every fifth says that it cannot find the answer."""
    said = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" I Cannot Find it."))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", answering.is_no_answer(said, F.col("doc_id") % 7 == 0).alias("no_answer"))


def ask_extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = answering.answers(_scored_hits(spark, sf_dir), _benchmark(spark, sf_dir), answering.ExtractiveModel(), 0.95)
    return said.select("query_id", "answer", "abstained", F.array_join("citations", "; ").alias("citations"), "top_score")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth: the expected source is among the hits' and the item's passage stands in the answer, which is all hits' texts, best first."""
    asked = _benchmark(spark, sf_dir)
    best = bm25.top(bm25.build_index(_doc_chunks(spark, sf_dir), stem=False), asked, HITS)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "text")
    hits = best.join(docs, "chunk_id").select(F.col("query_id").cast("string").alias("query_id"), F.col("source").alias("doc_name"), "rank", "text")
    texts = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("found")).select("query_id", F.array_join(F.col("found.text"), "\n\n").alias("text"))
    answers = asked.select(F.col("query_id").cast("string").alias("query_id"), "query").join(texts, "query_id", "left").select("query_id", F.coalesce("text", F.lit("")).alias("answer"), F.col("text").isNull().alias("abstained"))
    expected = F.when(F.col("query_id") % 3 != 0, F.concat(F.lit("SRC"), (F.col("query_id") % 10).cast("string")))
    items = asked.select(F.col("query_id").cast("string").alias("id"), "query", expected.alias("expected_doc"), F.when(F.col("query_id") % 4 != 0, F.array("query")).alias("expected_keywords"), (F.col("query_id") % 5 == 0).alias("should_abstain"))
    return evaluation.outcomes(items, hits, answers)


def eval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.report(_outcomes(spark, sf_dir)).select("id", "retrieval", "keywords", "abstain")


def eval_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.rates(_outcomes(spark, sf_dir))


def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' JSON as invoices: the user is the vendor, the value the only line's amount."""
    events = table(spark, sf_dir, "events")
    line = F.struct(F.col("event_type").alias("description"), F.lit(None).cast("double").alias("quantity"), F.lit(None).cast("double").alias("unit_price"), F.col("value").alias("amount"))
    text = F.to_json(F.struct(F.col("event_id").cast("string").alias("invoice_number"), F.when(F.col("event_id") % 2 == 0, F.array(line)).alias("line_items"), F.get_json_object("props", "$.k").alias("vendor")))
    record = answering.record_of(text, "invoice")
    rows = events.select(record.alias("r"))
    return rows.select("r.invoice_number", "r.vendor", "r.total", F.size("r.line_items").cast("long").alias("n_lines"), F.round(F.aggregate("r.line_items", F.lit(0.0), lambda a, i: a + F.coalesce(i["amount"], F.lit(0.0))), 6).alias("amount"))


def delete_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, gone = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text"), 220, True).alias("preview"), X.label(F.concat(F.lit("doc_"), "source")).alias("label"), X.shown(F.when(F.col("doc_id") % 2 == 0, F.col("source"))).alias("shown"))


def _search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk with its hashed vector."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(X.chunk_id(F.format_string("d%d", "doc_id"), F.lit(0)).alias("chunk_id"), F.format_string("d%d", "doc_id").alias("doc_id"), F.col("source").alias("doc_name"), F.lit(None).cast("int").alias("page"), F.col("lang").alias("section"), "text")
    return rows.withColumn("embedding", vector.HashingEmbedder().passages(F.col("text")))


def _search(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    chunks = _search_chunks(spark, sf_dir)
    hits = fusion.search(chunks, bm25.build_index(chunks, stem=False), _benchmark(spark, sf_dir), vector.HashingEmbedder(), HITS, mode)
    return hits.select("query_id", "rank", "chunk_id", "doc_id", "citation", "score", "semantic_score", "keyword_score")


def _embedded(spark: SparkSession, sf_dir: str, embedder: vector.Embedder) -> DataFrame:
    """The best five documents of each item by an embedder, and whether the item's passage stands in them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = _benchmark(spark, sf_dir)
    near = vector.top(docs.select("chunk_id", embedder.passages(F.col("text")).alias("embedding")), asked.select("query_id", embedder.queries(F.col("query")).alias("embedding")), HITS)
    return near.join(asked, "query_id").join(docs, "chunk_id").select("query_id", "rank", F.col("chunk_id").alias("doc_id"), "score", F.contains("text", F.col("query")).alias("holds_passage"))


def search_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By an embedder that is learned from all documents."""
    return _embedded(spark, sf_dir, latent.LatentEmbedder(latent.fit(table(spark, sf_dir, "documents"))))


def embedder_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(embedder, passed, total): for how many items a document that holds the passage is among the best five, by the hashing and by the learned embedder."""
    total = _benchmark(spark, sf_dir).count()
    of = lambda name, hits: hits.groupBy("query_id").agg(F.max("holds_passage").alias("hit")).agg(F.lit(name).alias("embedder"), F.count_if("hit").alias("passed"), F.lit(total).cast("long").alias("total"))
    return of("hashing", _embedded(spark, sf_dir, vector.HashingEmbedder())).unionByName(of("learned", search_learned(spark, sf_dir)))


def search_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "keyword")


def search_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "semantic")


def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "hybrid")


def embed_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored vectors' values that aren't 0."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(vector.HashingEmbedder().passages(F.col("text"))).alias("bucket", "weight"))
    return rows.where("weight > 0").select("doc_id", "bucket", F.round(F.col("weight").cast("double"), 5).alias("weight"))


def _stored(spark: SparkSession, sf_dir: str) -> store.Store:
    """A new store with the packed chunks of all documents, written in two parts, and the first part again, which adds nothing."""
    folder = scratch.folder(spark)
    kept = store.Store(spark, f"{folder}/store")
    _packed_chunks(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>")).write.parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    for part in (chunks.where(half), chunks.where(~half), chunks.where(half)):
        kept.add(part)
    scratch.remove(spark, f"{folder}/chunks")
    return kept


def store_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog beside what the stored index says of each document."""
    kept = _stored(spark, sf_dir)
    index = kept.index()
    of = kept.chunks().select("chunk_id", "doc_id")
    words = index.lengths.join(of, "chunk_id").groupBy("doc_id").agg(F.sum("dl").alias("n_tokens"))
    return kept.documents().join(words, "doc_id").select("doc_id", "doc_name", "n_chunks", "n_tokens")


def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the catalog, and of the index, without the documents labelled toxic."""
    kept = _stored(spark, sf_dir)
    kept.delete(table(spark, sf_dir, "labels").where("toxic = 1").select(F.format_string("d%d", "doc_id").alias("doc_id")))
    words = kept.index().lengths.select(F.substring_index("chunk_id", ":", 1).alias("doc_id"), "dl").groupBy("doc_id").agg(F.sum("dl").alias("n_tokens"))
    return kept.documents().join(words, "doc_id").select("doc_id", "n_chunks", "n_tokens")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_ingest by streaming state, a batch a file of documents."""
    path, folder = f"{sf_dir}/documents.parquet", scratch.folder(spark)
    schema = spark.read.parquet(path).schema
    # A pattern, as a stream reads a file or a folder by it alike.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path.replace(".parquet", ".parque[t]"))
    return arrivals.track(stream, f"{folder}/statuses", f"{folder}/progress")


#: Documents in a Word file.
DOCX_DOCUMENTS = 50


def _word_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, content): all documents as Word files of DOCX_DOCUMENTS each.  A line stands before the first heading; each document is a heading, its lines as
    paragraphs, and a table of two rows in which cells side by side are equal.  What XML can't hold is left out."""
    docs = table(spark, sf_dir, "documents")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\t\n\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")
    block = lambda style, text: F.struct(F.lit(style).alias("style"), text.alias("text"), F.lit(None).cast("array<array<string>>").alias("cells"))
    size = F.coalesce(F.col("n_chars").cast("string"), F.lit(""))
    cells = F.array(F.array(F.coalesce("lang", F.lit("")), F.coalesce("lang", F.lit("")), size), F.array(F.coalesce("source", F.lit("")), F.lit(""), F.lit(" ")))
    heading = F.array(block("heading 1", F.format_string("Document %d", "doc_id")))
    lines = F.transform(F.split(plain, "\n"), lambda line: block("", line))
    closing = F.array(F.struct(F.lit("").alias("style"), F.lit("").alias("text"), cells.alias("cells")))
    rows = docs.select(F.floor(F.col("doc_id") / DOCX_DOCUMENTS).alias("file"), "doc_id", F.concat(heading, lines, closing).alias("blocks"))
    gathered = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("doc_id", "blocks"))).alias("documents"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                # A file at a time, by columns of its blocks: a Python object for each field of each would take longer than the writing.
                parts = batch.column(1).slice(k, 1).flatten().field("blocks").flatten()
                own = (docx.Block(*b) for b in zip(*(parts.field(c).to_pylist() for c in ("style", "text", "cells")), strict=True))
                number = batch.column(0)[k].as_py()
                content = docx.written([docx.Block("", f"File {number}"), *own])
                yield pa.RecordBatch.from_arrays([pa.array([f"{number:08d}.docx"], pa.string()), pa.array([content], pa.binary())], ["name", "content"])

    return gathered.mapInArrow(write, "name string, content binary")


def docx_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as Word files and read back: the sections of each file, tables as text."""
    folder = f"{scratch.folder(spark)}/word"
    datasource.write(_word_files(spark, sf_dir), folder)
    found = datasource.read(spark, folder).where("suffix = '.docx' and error is null")
    rows = docx.sections(found.select("doc_id", "doc_name", F.col("seg_no").alias("block_no"), "style", F.col("paragraphs")[0].alias("text"), "cells"))
    return rows.select("doc_name", "seg_no", "section", "text")


QUERIES: tuple[Query, ...] = (
    chunk_windows, chunk_pack, clean_text, repeat_lines, needs_ocr, doc_identity, dedup_ingest, doc_catalog, ingest_stats, doc_text_concat, conversation_text, query_tokens,
    bm25_topk, bm25_doc_filter, bm25_stemmed, bm25_phrases, index_stats, cosine_topk, cosine_filtered, cosine_index_topk, hash_embed, rrf_hybrid, cosine_fill, abstain, citations, prompt_build,
    no_answer, ask_extractive, eval_outcomes, eval_rates, extract_json, delete_doc, preview, search_keyword, search_semantic, search_hybrid, search_learned, embedder_rates, embed_passages, store_ingest, store_delete, stream_ingest, docx_sections,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}
