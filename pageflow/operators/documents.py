"""Multi-part documents: best extraction candidate, part assembly, tables.

The PDF path of the crawler re-aimed as aggregates over already extracted parts:
``candidates(doc_id, method, method_rank, text)``, ``parts(doc_id, page_no, text)``,
``tables(doc_id, page_no, cells ARRAY<ARRAY<STRING>>)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.functions import html as H
from pageflow.functions import urls as U
from pageflow.functions.html import strip_ws
from pageflow.functions.urls import ColumnOrName, _col

# Extraction methods in trial order (a plain value that tests and fixtures share).
METHODS = ["pymupdf", "pypdf2", "ocr"]


def best_candidate(cands: DataFrame) -> DataFrame:
    """Per doc the method whose *stripped* text is longest; ties go to the earlier
    method; all blank -> ('', ''). The returned text is the unstripped one.

    One aggregate on doc_id with a partial ``max_by`` keyed by (length, earlier method): each input
    partition keeps only its best candidate per doc before the shuffle, so at most one text
    per doc and partition moves (a join that fetches the winner's text would move them all).
    """
    n = F.length(strip_ws("text")).cast("long")
    score = F.when(n > 0, F.struct(n.alias("n"), (-F.col("method_rank").cast("long")).alias("earlier")))
    best = cands.select("doc_id", "text", "method", score.alias("score")).groupBy("doc_id").agg(
        F.max_by(F.struct("text", "method"), "score").alias("b"), F.max("score").alias("top")
    )
    return best.select(
        "doc_id",
        F.when(F.col("top").isNotNull(), F.col("b.text")).otherwise(F.lit("")).alias("text"),
        F.when(F.col("top").isNotNull(), F.col("b.method")).otherwise(F.lit("")).alias("method"),
    )


def assemble_parts(parts: DataFrame, mode: str = "keep", sep: str = "\n") -> DataFrame:
    """Join a document's parts in page order with ``sep``.

    ``keep``: empty/NULL parts contribute '' (separators kept); ``drop``: they are skipped.
    """
    p = parts
    if mode == "drop":
        p = p.filter(F.col("text").isNotNull() & (F.col("text") != ""))
    elif mode != "keep":
        raise ValueError(f"unknown assemble mode {mode!r}")
    agg = p.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("t")))).alias("ps"))
    return agg.select("doc_id", F.array_join(F.transform("ps", lambda x: x["t"]), sep).alias("text"))


def render_table(cells: ColumnOrName) -> Column:
    """Rows of nullable cells -> tab-joined rows, newline-joined, wrapped in the table marker.
    Empty tables render as NULL (skipped)."""
    c = _col(cells)
    body = F.array_join(F.transform(c, lambda r: F.array_join(F.transform(r, lambda x: F.coalesce(x, F.lit(""))), "\t")), "\n")
    # Fixed value: the table marker.
    return F.when(F.size(c) > 0, F.concat(F.lit("\n**Tableau:**\n"), body, F.lit("\n")))


def assemble_document(parts: DataFrame, tables: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """Header, then per page its text + '\\n' (when non-empty), then that page's tables.

    ``tables`` has ``(doc_id, page_no, table_no, cells)``; ``urls`` (doc_id, url) adds the
    ``[Source](url)`` header. Pages are combined by a full outer join on (doc, page)
    and one ordered aggregate per doc.
    """
    rendered = (
        tables.select("doc_id", "page_no", "table_no", render_table("cells").alias("t"))
        .filter(F.col("t").isNotNull())
        .groupBy("doc_id", "page_no")
        .agg(F.sort_array(F.collect_list(F.struct("table_no", "t"))).alias("ts"))
        .select("doc_id", "page_no", F.array_join(F.transform("ts", lambda x: x["t"]), "").alias("tables_text"))
    )
    texts = parts.select("doc_id", "page_no", F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.concat("text", F.lit("\n"))).otherwise(F.lit("")).alias("page_text"))
    pages = texts.join(rendered, ["doc_id", "page_no"], "full").select(
        "doc_id", "page_no", F.concat(F.coalesce("page_text", F.lit("")), F.coalesce("tables_text", F.lit(""))).alias("chunk")
    )
    doc = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "chunk"))).alias("cs"))
    doc = doc.select("doc_id", F.array_join(F.transform("cs", lambda x: x["chunk"]), "").alias("body"))
    if urls is not None:
        doc = doc.join(urls, "doc_id", "left").select(
            "doc_id", F.concat(F.lit("[Source]("), F.coalesce("url", F.lit("")), F.lit(")\n\n"), "body").alias("text")
        )
    else:
        doc = doc.withColumnRenamed("body", "text")
    return doc


def extraction_report(best: DataFrame, methods: list[str] = METHODS) -> DataFrame:
    """P5: counters over best candidates: processed (non-blank), failed (blank), per-method
    counts zero-filled over the method list, and total text length of processed docs."""
    nb = F.length(strip_ws("text")) > 0
    totals = best.agg(
        F.count_if(nb).alias("processed"),
        F.count_if(~nb).alias("failed"),
        F.coalesce(F.sum(F.when(nb, F.length("text"))), F.lit(0)).alias("text_length"),
        *[F.count_if(nb & (F.col("method") == m)).alias(f"method_{m}") for m in methods],
    )
    return totals.select(*[F.col(c).cast("long").alias(c) for c in totals.columns])


def extraction_records(best: DataFrame, urls: DataFrame) -> DataFrame:
    """P5 records: url, method, text key and text_length (unstripped) per non-blank doc."""
    nb = best.filter(F.length(strip_ws("text")) > 0)
    return nb.join(urls, "doc_id").select(
        "doc_id", "url", F.col("method").alias("extraction_method"),
        F.concat(F.md5(F.encode("url", "UTF-8")), F.lit("_pdf.txt")).alias("text_file"),
        F.length("text").cast("long").alias("text_length"),
    )


def page_record(url: str = "url", html: str = "html", fetched: str = "fetch_ts", status: str = "status_code", headers: str = "headers") -> dict[str, Column]:
    """The fields of a page's record: url, title (null without one), timestamp (seconds since the epoch as a double),
    headers (a map as the response gave them), status_code, content and text_key (file name of the text)."""
    return {
        "url": F.col(url),
        "title": H.page_title(html),
        "timestamp": F.unix_micros(F.col(fetched)).cast("double") / 1e6,
        "headers": F.col(headers),
        "status_code": F.col(status),
        "content": H.page_text(html),
        "text_key": U.url_key(url, ".txt"),
    }
