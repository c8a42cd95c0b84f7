"""Main text of pages: subtrees that recur across the pages of a host are its template and go.

Every page is read as a tree of elements (``markup.Page``). Elements that name themselves as something else (navigation, footers,
forms, adverts, comments, ...) are left out first; a page's articles or main element, if it has them, bound the rest. What is left
is hashed: 128 bits for each block element, from its tag, text and children, whatever its attributes. Spark counts on how many
pages of a host each subtree occurs, copies of one page being one page: pages of the same remaining text count once.
A subtree on at least ``LEAST_PAGES`` pages and ``LEAST_SHARE`` of the pages of its host is template, and is deleted with all it holds.

Counting ships hashes, no text, in two steps: (host, subtree, text) are made distinct, then counted, so a host with a third of all pages is
spread over all tasks. A host has at most (blocks per page) / LEAST_SHARE template subtrees; they go to its pages as one short list, by
broadcast while all lists together are small, else by a join that splits frequent hosts.

Null urls and urls without ``://`` share the empty host. Null or empty html, and pages without main text, give an empty text. Repeated rows
are kept and treated alike. Nothing is cut: texts of any length are read whole. Extra columns pass only if named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from slidegrid.llm.markup import Page
from slidegrid.llm.urls import host_of
from slidegrid.operators.skew import spread_join
from slidegrid.session import scratch_folder

#: Pages, and share of a host's pages, from which on a subtree is template.
LEAST_PAGES, LEAST_SHARE = 5, 0.6
#: Template lists that are broadcast: at most so many bytes in all.
BROADCAST_BYTES = 32 << 20
#: Characters of html that are read and written together.
CHUNK = 8 << 20


def _pieces(batches: Iterator[pa.RecordBatch], column: str = "html") -> Iterator[pa.RecordBatch]:
    """Batches cut so that a piece holds about ``CHUNK`` characters of html, or one page."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > CHUNK:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def subtree_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, subtree, text (hashes): one row for each kept block of each page; a page of its own has subtree null."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            hosts, trees, texts = [], [], []
            for host, markup in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                page = Page(markup or "")
                keep = page.kept()
                found = page.subtrees(keep)
                if found:
                    text = xxhash.xxh3_128_digest(page.text(keep).encode("utf-8", "surrogatepass"))
                    trees += [None, *found]
                    hosts += [host] * (len(found) + 1)
                    texts += [text] * (len(found) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(trees, pa.binary()), pa.array(texts, pa.binary())], ["host", "subtree", "text"])

    return pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).mapInArrow(hashed, "host string, subtree binary, text binary")


def templates(pages: DataFrame, url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """host, recurring: the digests of each host's template subtrees; hosts without any are left out."""
    spark, at = pages.sparkSession, f"{scratch_folder(pages.sparkSession)}/counts"
    counted = subtree_pages(pages, url, html).distinct().groupBy("host", "subtree").agg(F.count("*").alias("n"))
    counted.where(F.col("n") >= least_pages).write.parquet(at)
    counts = spark.read.parquet(at)
    hosts = counts.where("subtree IS NULL").select("host", F.col("n").alias("pages"))
    often = spread_join(counts.where("subtree IS NOT NULL"), hosts, ["host"], salt_on=["subtree"]).where(F.col("n") >= least_share * F.col("pages"))
    return often.groupBy("host").agg(F.array_sort(F.collect_set("subtree")).alias("recurring"))


def extract(
    pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id", "url"),
    least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``keep``, text, n_chars of every page."""
    spark = pages.sparkSession
    at = f"{scratch_folder(spark)}/templates"
    templates(pages, url, html, least_pages, least_share).write.parquet(at)
    found = spark.read.parquet(at)
    size = found.agg(F.sum(F.octet_length("host") + 32 * F.size("recurring"))).first()[0] or 0
    rows = pages.select(*[F.col(c).alias(f"__{c}") for c in keep], host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    if size <= broadcast_bytes:
        rows = rows.join(F.broadcast(found), "host", "left")
    else:
        rows = spread_join(rows, found, ["host"], "left", salt_on=["html"])
    names = [f"__{c}" for c in keep]
    kept = T.StructType([*(T.StructField(c, rows.schema[c].dataType) for c in names), T.StructField("text", T.StringType())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            out = []
            for markup, gone in zip(batch.column("html").to_pylist(), batch.column("recurring").to_pylist()):
                page = Page(markup or "")
                left = page.kept()
                out.append(page.text(page.without(left, frozenset(gone)) if gone else left))
            data = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*data, pa.array(out, pa.string())], [*names, "text"])

    done = rows.select(*names, "html", "recurring").mapInArrow(texts, kept)
    return done.select(*[F.col(f"__{c}").alias(c) for c in keep], "text", F.length("text").cast("long").alias("n_chars"))
