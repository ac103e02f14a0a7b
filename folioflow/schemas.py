"""Explicit schemas of every table; nothing on the ingest path is inferred."""

SEGMENTS = "doc_id string, doc_name string, seg_no int, page int, section string, text string, method string, needs_ocr boolean"
CHUNKS = "chunk_id string, doc_id string, doc_name string, page int, section string, chunk_index int, text string, word_count int, method string"
CHUNKS_STORED = CHUNKS + ", embedding array<float>, number long, dl int"
DOCUMENTS = "doc_id string, doc_name string, n_chunks int, added_at timestamp"
HITS = "query_id string, rank int, chunk_id string, doc_id string, doc_name string, page int, section string, text string, citation string, score double, semantic_score double, keyword_score double"
ANSWERS = "query_id string, query string, answer string, abstained boolean, citations array<string>, top_score double"
EVAL_ITEMS = "id string, query string, expected_doc string, expected_keywords array<string>, should_abstain boolean"

LINE_ITEM = "struct<description:string,quantity:double,unit_price:double,amount:double>"
RECORDS = {
    "invoice": f"invoice_number string, vendor string, date string, total double, currency string, line_items array<{LINE_ITEM}>",
    "resume": "name string, email string, phone string, skills array<string>, experience array<string>",
    "contract": "parties array<string>, effective_date string, termination_terms string, payment_terms string",
}
