"""Queries over specialist pages and records, and order-sensitive scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.functions import grams as N
from brookmill.functions import scoring as K
from brookmill.operators import specialists as Sp
from brookmill.operators.extract import per_page
from brookmill.plans.evaluation import pairs
from brookmill.plans.registry import query
from brookmill.sources.tables import table

C = F.col
# Scholarly pages made of page numbers: with citation tags, with JSON-LD, and without either.
TAGGED = '<head><meta name="citation_title" content="On  Things #"><meta name="citation_author" content="A B"><meta name="citation_author" content="a b"><meta name="citation_author" content="C D"><meta name="citation_doi" content="doi:10.1000/ab(#)."><meta name="citation_date" content="2021/3/4"><meta name="citation_pdf_url" content="https://x.example/#.pdf"></head><p>short'
LINKED = '<script type="application/ld+json">{"@graph":[{"@type":"ScholarlyArticle","headline":"LD paper #","author":[{"name":"E F"}],"datePublished":"2020-13-01"}]}</script>'


def numbered(spark: SparkSession, sf_dir: str, *texts: str) -> DataFrame:
    """Pages with one of the texts each, in turn, with the page's number for #."""
    t = F.element_at(F.array(*map(F.lit, texts)), (C("page_id") % len(texts) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.replace(t, F.lit("#"), C("page_id").cast("string")).alias("html"))


@query("academic_papers", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'On Things ' ELSE 'LD paper ' END || page_id AS title, CASE WHEN page_id % 3 = 0 THEN 'A B; C D' ELSE 'E F' END AS authors, CASE WHEN page_id % 3 = 0 THEN '10.1000/ab(' || page_id || ')' ELSE '' END AS doi,
  CASE WHEN page_id % 3 = 0 THEN '2021-03-04' ELSE '2020' END AS published, CASE WHEN page_id % 3 = 0 THEN 'https://x.example/' || page_id || '.pdf' ELSE '' END AS pdf_url, FALSE AS is_full_text FROM pages WHERE page_id % 3 < 2""")
def academic_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Sp.papers(numbered(spark, sf_dir, TAGGED, LINKED, "<p>no paper #")).drop("abstract")


CODE = (
    '<h1>Issue #</h1><div class="comment-body"><p>first</p></div><div class="comment-body"><p>second #</p></div><div class="comment-body"><p>First</p></div>',
    '<h1>repo #</h1><table aria-labelledby="folders-listing"><tr><td><a href="/o/r/tree/main/src">src</a><tr><td><a href="/o/r/blob/main/a.py">a.py</a><tr><td><a href="/x">x</a></table>',
    '<article class="markdown-body"><h1>Read me #</h1><p>text</p></article>',
)


@query("code_host_pages", "SELECT page_id, ['github-thread', 'github-tree', 'github-readme'][page_id % 3 + 1] AS strategy, ['Issue ', 'repo ', 'Read me '][page_id % 3 + 1] || page_id AS title, [2, 2, 1][page_id % 3 + 1] AS n_items, FALSE AS truncated FROM pages")
def code_host_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Sp.code_pages(numbered(spark, sf_dir, *CODE)).drop("text")


CHANGES = (
    '<main><h1>Commit #</h1><p>1 file changed</p><table aria-label="Diff for: a#.py"><tbody><tr><td>1<td>+x</table></main>',
    "<main><h1>Commit #</h1><p>2 files changed</p></main>",
    "<h1>Only a title #</h1>",
)


@query("code_changes", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'github-commit' ELSE 'github-commit-partial' END AS strategy, 'Commit ' || page_id AS title, 1 - page_id % 3 AS n_files, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'github_change_diff_unavailable' END AS reasons FROM pages WHERE page_id % 3 < 2")
def code_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of changes made of page numbers: with a diff, without one, and with nothing but a title."""
    return per_page(numbered(spark, sf_dir, *CHANGES), Sp.CHANGE, lambda html: Sp.change_page(html, compare=False)).drop("text")


@query("code_releases", "SELECT page_id, 'github-release' AS strategy, 'v' || page_id AS title, 2 AS n_items FROM pages WHERE page_id % 2 = 0")
def code_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release pages with two bodies, one of them twice, and pages without any."""
    body = '<main><h1>v#</h1>' + '<div class="release-body"><div class="markdown-body"><p>Notes of #</p></div></div>' * 2 + '<div class="markdown-body"><p>More</p></div></main>'
    return per_page(numbered(spark, sf_dir, body, "<h1>v#</h1>"), Sp.CODE_PAGE, Sp.release_page).drop("text", "truncated")


@query("raw_links", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://github.com/o/r/raw/main/f' || page_id || '.py' END AS raw FROM pages")
def raw_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files of blob pages; links to other repositories and other hosts are not trusted."""
    p = numbered(spark, sf_dir, '<a id="raw-url" href="https://github.com/o/r/raw/main/f#.py">#', '<a id="raw-url" href="https://github.com/o/x/raw/main/f#.py">#', '<a id="raw-url" href="https://evil.example/o/r/raw/main/f#.py">#')
    return per_page(p, "page_id bigint, raw string", lambda html: iter([{"raw": Sp.raw_url(html, f"https://github.com/o/r/blob/main/f{html.rsplit('>', 1)[1]}.py")}]))


@query("crossref_records", "SELECT doc_id::VARCHAR AS key, CASE WHEN doc_id % 2 = 0 THEN 'T ' || doc_id END AS title, CASE WHEN doc_id % 2 = 0 THEN 'A B; Group' END AS authors, CASE WHEN doc_id % 2 = 0 THEN '10.1/x' || doc_id END AS doi, CASE WHEN doc_id % 2 = 0 THEN '2020-02-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') ELSE '2020' END AS published, doc_id % 2 = 0 AS is_ieee FROM documents")
def crossref_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads made of document numbers, full and nearly empty ones."""
    i = C("doc_id").cast("string")
    full = F.concat(F.lit('{"DOI":"10.1/X'), i, F.lit('","title":["T '), i, F.lit('"],"author":[{"given":"A","family":"B"},{"name":"Group"}],"issued":{"date-parts":[[2020,2,'), (C("doc_id") % 28 + 1).cast("string"), F.lit(']]},"publisher":"IEEE Press"}'))
    payload = F.when(C("doc_id") % 2 == 0, full).otherwise('{"title":[],"issued":{"date-parts":[[2020,13,1]]},"publisher":"Other"}')
    return Sp.crossref_records(table(spark, sf_dir, "documents").select(i.alias("key"), payload.alias("payload")))


@query("merged_records", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'l' || doc_id WHEN doc_id % 5 <> 0 THEN 'r' || doc_id ELSE '' END AS title, CASE WHEN doc_id % 3 <> 2 AND doc_id % 2 = 0 THEN 'u' || doc_id WHEN doc_id % 5 <> 0 THEN 'v' || doc_id ELSE CASE WHEN doc_id % 3 = 2 THEN NULL ELSE '' END END AS url FROM documents WHERE doc_id % 3 <> 2 OR doc_id % 5 <> 0")
def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of records that each lack some documents and some fields, merged field by field."""
    d, i = table(spark, sf_dir, "documents"), C("doc_id").cast("string")
    left = d.where("doc_id % 3 <> 2").select(C("doc_id").alias("id"), F.when(C("doc_id") % 3 == 0, F.concat(F.lit("l"), i)).otherwise("").alias("title"), F.when(C("doc_id") % 2 == 0, F.concat(F.lit("u"), i)).otherwise("").alias("url"))
    right = d.where("doc_id % 5 <> 0").select(C("doc_id").alias("id"), F.concat(F.lit("r"), i).alias("title"), F.concat(F.lit("v"), i).alias("url"))
    return Sp.merge_records(left, right, "id")


@query("title_matches", "SELECT doc_id, doc_id % 3 = 0 AS same FROM documents WHERE length(split_part(text, chr(10), 1)) > 40")
def title_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first line against itself in capitals, against its half, and against another text."""
    first = F.substring_index("text", "\n", 1)
    other = F.when(C("doc_id") % 3 == 0, F.concat(F.upper(first), F.lit("."))).when(C("doc_id") % 3 == 1, F.substr(first, F.lit(1), F.expr("length(substring_index(text, '\n', 1)) div 2"))).otherwise("quite another matter")
    return table(spark, sf_dir, "documents").where(F.length(first) > 40).select("doc_id", K.same_title(first, other).alias("same"))


@query("ordered_scores")
def ordered_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subsequence F1, best window F1 and ordered share of each document against its reference; whole texts count."""
    t = pairs(spark, sf_dir).select(C("l").alias("doc_id"), C("lt").alias("a"), C("rt").alias("b"))
    return t.select("doc_id", N.ordered_scores("a", "b").alias("s")).select("doc_id", "s.*")
