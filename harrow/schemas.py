"""Fixed schemas of the derived tables."""

from pyspark.sql import types as T

DOCUMENT_STATE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("status", T.StringType()),
    T.StructField("crawled_at", T.TimestampNTZType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("doc_length", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("content_hash", T.StringType()),
])

MANIFEST = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()),
])

DOC_LOG = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("doc_length", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("snippet", T.StringType()),
])

POSTINGS = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("tf", T.IntegerType()),
    T.StructField("doc_length", T.IntegerType()),
])

INDEXED_DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("doc_length", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

TERM_STATS = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("df", T.LongType()),
    T.StructField("min_length", T.IntegerType()),
    T.StructField("length_unknown", T.BooleanType()),
])

STATS = T.StructType([
    T.StructField("n_docs", T.LongType()),
    T.StructField("avgdl", T.DoubleType()),
    T.StructField("buckets", T.IntegerType()),
])

QUERIES = T.StructType([
    T.StructField("qid", T.LongType()),
    T.StructField("q", T.StringType()),
])

TEST_TABLES = {
    "documents": T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]),
    "pages": T.StructType([
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]),
    "benchmark": T.StructType([
        T.StructField("item_id", T.LongType()),
        T.StructField("text", T.StringType()),
    ]),
    "conversations": T.StructType([
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]),
}
