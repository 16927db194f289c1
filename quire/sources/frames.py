"""Documents as tables: one row per file, page, outline item or text run. A bad file is a row with a status."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import PIECE, pieces, spread
from .codecs import CodecError
from .content import Interpreter
from .pdf import CannotOpen, Document


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(doc_id, content) of the files below a folder, read where they lie."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc_id"), "content")


def _rows(source: DataFrame, schema: str, kinds: dict, make) -> DataFrame:
    """``make(doc_id, content)`` gives the rows of one document."""
    kind = dict(source.dtypes)["doc_id"]

    def batch_of(docs, rows, doc_type):
        columns = zip(zip(*rows, strict=True), kinds.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(docs, doc_type), *(pa.array(c, t) for c, t in columns)], ["doc_id", *kinds])

    def run(batches):
        for batch in batches:
            docs, rows, held, doc_type = [], [], 0, batch.schema.field(0).type
            for k in range(batch.num_rows):  # a document at a time: its pages may be large
                doc_id, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b""
                rows += make(content)
                docs += [doc_id] * (len(rows) - len(docs))
                held += len(content)
                if rows and (held >= PIECE or len(rows) >= 4096):
                    yield batch_of(docs, rows, doc_type)
                    docs, rows, held = [], [], 0
            if rows:
                yield batch_of(docs, rows, doc_type)

    return source.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, {schema}")


def _open(content: bytes) -> Document | CannotOpen:
    try:
        return Document.open(content)
    except CannotOpen as e:
        return e
    except (ValueError, KeyError, TypeError, IndexError, RecursionError, MemoryError) as e:
        return CannotOpen("damaged", type(e).__name__)


def opened(source: DataFrame) -> DataFrame:
    """(doc_id, status, detail, page_count, warnings, metadata): one row for every file."""

    return _rows(source, _FACTS_SCHEMA, _FACTS, lambda content: [_facts(_open(content))])


_FACTS_SCHEMA = "status string, detail string, page_count int, warnings array<string>, metadata map<string,string>"
_FACTS = {"status": pa.string(), "detail": pa.string(), "page_count": pa.int32(), "warnings": pa.list_(pa.string()), "metadata": pa.map_(pa.string(), pa.string())}


def _facts(doc: Document | CannotOpen) -> tuple:
    if isinstance(doc, CannotOpen):
        return doc.status, doc.detail, 0, [], []
    pages, facts = doc.pages(), doc.metadata()
    return "ok", "", len(pages), [f"{a} {b}".strip() for a, b in doc.warnings.found], [(k, v) for k, v in facts.items() if isinstance(v, str)]


def read(source: DataFrame) -> DataFrame:
    """What ``opened`` gives, and the texts of all runs in order (page_index, emit_idx, text): each file is opened once."""

    def make(content):
        doc = _open(content)
        facts = _facts(doc)
        yield *facts, [{"page_index": k, "emit_idx": e, "text": r.text} for k, page in _page_runs(doc) for e, r in enumerate(page)]

    runs = pa.list_(pa.struct([("page_index", pa.int32()), ("emit_idx", pa.int32()), ("text", pa.string())]))
    return _rows(source, f"{_FACTS_SCHEMA}, runs array<struct<page_index:int,emit_idx:int,text:string>>", _FACTS | {"runs": runs}, make)


def page_table(source: DataFrame) -> DataFrame:
    """(doc_id, page_index, media, crop, rotation): boxes as arrays of two corners."""

    def make(content):
        doc = _open(content)
        for k, p in enumerate(doc.pages() if isinstance(doc, Document) else []):
            yield k, list(p.media), list(p.crop), p.rotate

    return _rows(source, "page_index int, media array<double>, crop array<double>, rotation int", {"page_index": pa.int32(), "media": pa.list_(pa.float64()), "crop": pa.list_(pa.float64()), "rotation": pa.int32()}, make)


def outline_table(source: DataFrame) -> DataFrame:
    def make(content):
        doc = _open(content)
        for k, (depth, title, page) in enumerate(doc.outline() if isinstance(doc, Document) else []):
            yield k, depth, title, page

    return _rows(source, "item_no int, depth int, title string, page_index int", {"item_no": pa.int32(), "depth": pa.int32(), "title": pa.string(), "page_index": pa.int32()}, make)


def _page_runs(doc: Document | CannotOpen):
    """(page index, runs) of the pages that can be read."""
    for k, page in enumerate(doc.pages() if isinstance(doc, Document) else []):
        try:
            yield k, Interpreter(doc).page(page)
        except CodecError:
            continue


# The columns of a run: their types, and what they are of the page's index, the run's place and the run.
_RUN = {
    "page_index": ("int", pa.int32(), lambda k, e, r: k), "emit_idx": ("int", pa.int32(), lambda k, e, r: e), "text": ("string", pa.string(), lambda k, e, r: r.text),
    "x": ("double", pa.float64(), lambda k, e, r: r.x), "y": ("double", pa.float64(), lambda k, e, r: r.y),
    "dx": ("double", pa.float64(), lambda k, e, r: r.dx), "dy": ("double", pa.float64(), lambda k, e, r: r.dy), "size": ("double", pa.float64(), lambda k, e, r: r.size),
    "width": ("double", pa.float64(), lambda k, e, r: sum(r.advances)), "vertical": ("boolean", pa.bool_(), lambda k, e, r: r.vertical), "invisible": ("boolean", pa.bool_(), lambda k, e, r: r.invisible),
    "advances": ("array<double>", pa.list_(pa.float64()), lambda k, e, r: r.advances),
    "quad": ("array<struct<x:double,y:double>>", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])), lambda k, e, r: [{"x": a, "y": b} for a, b in r.quad]),
}


def run_table(source: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The positioned runs of all pages, as ``operators.assembly`` reads them, with their quads (the lower left corner
    first, then around); of their ``columns`` only those wanted, as Spark can't leave any out by itself."""
    wanted = {c: _RUN[c] for c in columns or _RUN}

    def make(content):
        for k, page in _page_runs(_open(content)):
            for e, r in enumerate(page):
                yield tuple(value(k, e, r) for _, _, value in wanted.values())

    return _rows(source, ", ".join(f"{c} {kind}" for c, (kind, _, _) in wanted.items()), {c: kind for c, (_, kind, _) in wanted.items()}, make)


def text_files(texts: DataFrame, per_page: int = 50, xref: str = "table") -> DataFrame:
    """(doc_id, content): each text as a document, a line for each of its lines that isn't empty. ``xref`` as in
    ``write.text_document``."""
    from .write import text_document

    kind = dict(texts.dtypes)["doc_id"]

    def run(batches):
        for batch in pieces(batches):
            made = [text_document([x for x in (t or "").split("\n") if x], per_page, xref) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "content"])

    return spread(texts.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, content binary")
