"""Whole documents: written, opened and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as A
from ..sources import frames as R
from .registry import query

_LINES = "list_filter(string_split(text, chr(10)), lambda x: length(x) > 0)"


@query(f"SELECT doc_id, 'ok' AS status, CAST(greatest(1, ceil(len({_LINES}) / 50.0)) AS INTEGER) AS page_count, '1.7' AS version FROM documents")
def open_documents(t):
    out = R.opened(R.text_files(t.documents))
    return out.select("doc_id", "status", "page_count", F.col("metadata")["pdf_version"].alias("version"))


@query(f"SELECT doc_id, md5(array_to_string({_LINES}, chr(10))) AS digest FROM documents WHERE len({_LINES}) > 0")
def document_runs(t):
    read = R.read(R.text_files(t.documents)).where(F.size("runs") > 0)
    return read.select("doc_id", F.md5(F.array_join(F.transform("runs", lambda x: x["text"]), "\n")).alias("digest"))


@query(f"SELECT conv_id * 1000 + turn AS doc_id, CAST(0 AS INTEGER) AS page_index, array_to_string({_LINES}, chr(10)) AS text FROM conversations WHERE len({_LINES}) > 0")
def document_page_text(t):
    texts = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return A.page_texts(R.run_table(R.text_files(texts, per_page=100_000), A.RUN)).select("doc_id", "page_index", "text")


@query("SELECT doc_id, CAST(0 AS INTEGER) AS page_index, CAST(612 AS DOUBLE) AS w, CAST(792 AS DOUBLE) AS h, CAST(0 AS INTEGER) AS rotation FROM documents")
def first_pages(t):
    pages = R.page_table(R.text_files(t.documents)).where("page_index = 0")
    c = F.col("crop")
    return pages.select("doc_id", "page_index", (c[2] - c[0]).alias("w"), (c[3] - c[1]).alias("h"), "rotation")
