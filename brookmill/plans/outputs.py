"""Queries over finished outputs: documentation pages, post-processing, papers, scrubbed pages."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookmill.functions import dom
from brookmill.functions import outputs as O
from brookmill.functions import page as G
from brookmill.functions import papers as A
from brookmill.functions import patterns as P
from brookmill.functions import text as X
from brookmill.operators import extract as E
from brookmill.operators import gates
from brookmill.plans.documents import pages
from brookmill.plans.gates import ARTICLE_SQL, grounded
from brookmill.plans.pages import WORDS
from brookmill.plans.registry import query
from brookmill.sources.tables import spread, table

C = F.col
sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()


@query("documentation_pages", f"SELECT page_id, replace(trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)), '&amp;', '&') AS title FROM pages WHERE contains(html, '<h1>') AND {WORDS(ARTICLE_SQL)} >= 8")
def documentation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the pages read as documentation, whose sidebars are pruned; as the pages spell them, but for ``&amp;``."""

    other = re.compile("&(?!amp;)")

    def rows(html: str | None) -> Iterator[dict]:
        found = O.documentation(html)
        if found:
            # Where all entities are &amp;, decoding them all is the same.
            yield {"title": O.documentation_title_source(html).replace("&amp;", "&") if other.search(html) else found["title"]}

    return E.per_page(pages(spark, sf_dir), "page_id bigint, title string", rows)


@F.pandas_udf(T.StringType())
def with_links_and_tables(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in parts:
        yield t.map(lambda x: x if x is None else O.converted_tables(O.mended_links(x)))


@F.pandas_udf(T.StringType())
def with_page_tables(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for t, h in parts:
        yield pd.Series([x if x is None else O.with_tables(x, y) for x, y in zip(t, h, strict=True)], dtype=object)


def post_processed(found: DataFrame) -> DataFrame:
    """Candidates (page_id, text, title, html, news) after clean-up: missing code, links, tables, wiki marks; on news short
    boilerplate lines go, elsewhere data tables and the title come in. Column steps around two walks in Python."""
    text = F.when(C("news"), C("text")).otherwise(X.with_missing_code(C("text"), C("html")))
    text = X.strip_wiki(with_links_and_tables(text))
    text = F.when(C("news"), X.strip_boilerplate(text)).otherwise(X.with_title(with_page_tables(text, C("html")), C("title")))
    return found.withColumn("text", text)


@query("finished_results")
def finished_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade's choice for each page, post-processed, cut at the text bound, counted and scored for completeness."""
    p = pages(spark, sf_dir)
    best = E.cascade(E.candidates(p)).select("page_id", "strategy", "text", "title")
    j = best.join(p.select(C("page_id").cast("bigint").alias("page_id"), "html", G.is_news(C("html")).alias("news")), "page_id")
    j = post_processed(j).withColumn("cut", X.truncated(C("text")))
    j = j.join(grounded(p), "page_id", "left")
    truncated = F.length("text") > P.TEXT_MOST
    done = gates.completeness(G.count_words(C("cut")), truncated, G.structure_losses(C("html"), C("cut")), C("coverage"), C("grounding"), F.length("html") <= P.SCAN_MOST)
    route = F.when(C("strategy").startswith("github-"), "github_source").when(C("strategy") == "rs-trafilatura", "native_fast_path").otherwise("deterministic_fallback")
    return j.select("page_id", "strategy", route.alias("route"), C("cut").alias("text"), G.count_words(C("cut")).alias("word_count"), truncated.alias("truncated"), done["score"].alias("completeness"), F.array_join(done["reasons"], ",").alias("reasons"))


@query("scrubbed_pages", "SELECT page_id, sha256(html) AS html_sha256, 2 AS n_removed FROM pages")
def scrubbed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with an annotation tool's wrapper around them come back as they were."""

    def rows(html: str | None) -> Iterator[dict]:
        out, counts = O.scrubbed(html or "")
        yield {"html_sha256": sha(out), "n_removed": counts["wrapper_tags"]}

    marked = pages(spark, sf_dir).select("page_id", F.concat(F.lit("<marked-text>"), "html", F.lit("</marked-text>")).alias("html"))
    return E.per_page(marked, "page_id bigint, html_sha256 string, n_removed bigint", rows)


@query("pdf_links", "SELECT page_id, url || '/a.pdf' AS first, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 2 END AS n FROM (SELECT page_id, 'https://papers.example/' || page_id AS url FROM pages)")
def pdf_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF candidates of papers made of pages: a citation tag, the same file in another guise, and on odd pages a second file."""
    link = F.when(C("page_id") % 2 == 0, '<a href="/x/supplement.pdf">s</a>').otherwise('<a href="b.pdf">Download PDF</a>')
    url = F.concat(F.lit("https://papers.example/"), "page_id")
    head = F.concat(F.lit('<meta name="citation_pdf_url" content="'), url, F.lit('/a.pdf"><a href="'), url, F.lit('/a.pdf?download=1">pdf</a>'))
    made = pages(spark, sf_dir).select("page_id", F.concat(head, link, F.lit("<i>"), url).alias("html"))

    def rows(html: str | None) -> Iterator[dict]:
        found = A.pdf_candidates(dom.parse(html), html.rsplit("<i>", 1)[1])
        yield {"first": found[0], "n": len(found)}

    return E.per_page(made, "page_id bigint, first string, n bigint", rows)


def _papers(docs: DataFrame, schema: str, rows) -> DataFrame:
    return E.per_page(docs.select(C("doc_id").alias("page_id"), C("text").alias("html")), schema, rows).withColumnRenamed("page_id", "doc_id")


@query("paper_sections", "SELECT doc_id, CASE WHEN trim(split_part(text, chr(10), 1)) = '' THEN 1 ELSE 2 END AS n, 'Methods' AS last FROM documents WHERE length(text) > 200")
def paper_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents dressed as papers: a body line, a heading, the text without its line ends, references that are left out."""
    d = table(spark, sf_dir, "documents").where("length(text) > 200")
    body = F.concat(F.substring_index("text", "\n", 1), F.lit(" .\nMethods\n"), F.regexp_replace("text", r"\s+", " "), F.lit(" .\nReferences\nA 1999 10.1000/x\nCorrespondence\nnobody"))

    def rows(text: str | None) -> Iterator[dict]:
        found = A.sections(text or "")
        yield {"n": len(found), "last": found[-1]["heading"]}

    return _papers(spread(d.select("doc_id", body.alias("text"))), "page_id bigint, n bigint, last string", rows)


@query("paper_records")
def paper_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, authors, abstract, references and Markdown of documents read as plain text of papers."""

    def rows(text: str | None) -> Iterator[dict]:
        t = text or ""
        p = {"title": A.plain_title(t), "authors": A.plain_authors(t), "abstract": A.structured_abstract(A.plain_abstract(t)), "references": A.references(t)}
        p["sections"] = A.sections(t, p["title"], p["abstract"], p["authors"])
        yield {"title": p["title"], "authors": json.dumps(p["authors"]), "n_sections": len(p["sections"]), "markdown": A.paper_markdown(p)}

    return _papers(spread(table(spark, sf_dir, "documents")), "page_id bigint, title string, authors string, n_sections bigint, markdown string", rows)
