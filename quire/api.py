"""A collection of documents and the questions to ask it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import assembly, structure
from .operators import search as finding
from .sources import frames


@dataclass(frozen=True)
class Collection:
    """Files (doc_id, content), and optionally page texts from elsewhere that go before their own."""

    files: DataFrame
    provider: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, glob: str = "*.pdf", provider: DataFrame | None = None) -> Collection:
        return cls(frames.files(spark, path, glob), provider)

    @cached_property
    def opened(self) -> DataFrame:
        return frames.opened(self.files)

    def pages(self) -> DataFrame:
        return frames.page_table(self.files)

    def outline(self) -> DataFrame:
        return frames.outline_table(self.files)

    def metadata(self) -> DataFrame:
        """One row a document, with dates parsed."""
        fields = ("title", "author", "subject", "keywords", "creator", "producer", "pdf_version")
        dates = {c: F.coalesce(structure.parsed_iso_date(F.col("metadata")[c]), structure.parsed_date(F.col("metadata")[c])).alias(c) for c in ("creation_date", "modification_date")}
        return self.opened.where("status = 'ok'").select("doc_id", *(F.col("metadata")[c].alias(c) for c in fields), *dates.values())

    def runs(self) -> DataFrame:
        return frames.run_table(self.files)

    def text(self, columns: bool = True) -> DataFrame:
        """(doc_id, page_index, text) of all pages that have text."""
        own = assembly.page_texts(frames.run_table(self.files, assembly.RUN), columns).select("doc_id", "page_index", "text")
        return own if self.provider is None else finding.provided(self.provider, own)

    def search(self, query: str, options: finding.Options = finding.Options(), columns: bool = True) -> DataFrame:
        return finding.search(self.text(columns), query, options)

    def page(self, page_index: int) -> DataFrame:
        """That page of every document; an ``error`` where a document has no such page."""
        counts = self.opened.where("status = 'ok'").select("doc_id", "page_count")
        found = counts.join(self.pages().where(F.col("page_index") == page_index), "doc_id", "left")
        error = F.when(F.lit(page_index < 0) | (F.col("page_count") <= page_index), F.concat(F.lit(f"page {page_index} is outside 0 to "), (F.col("page_count") - 1).cast("string")))
        return found.withColumn("error", error)
