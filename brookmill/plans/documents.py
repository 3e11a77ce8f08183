"""Queries over parsed pages: blocks, candidates, extraction, tables, lists, medoids, span lattices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.functions.sqltext import values
from brookmill.operators import extract as E
from brookmill.operators import lattice as L
from brookmill.plans.pages import pages as scan
from brookmill.plans.registry import query
from brookmill.sources.tables import literal, spread

C = F.col


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(scan(spark, sf_dir))


@query("ir_block_tags", r"""SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(list_concat(list_transform(regexp_extract_all(html, '<h1>'), lambda x: 'h1'), list_transform(regexp_extract_all(html, '<nav>'), lambda x: 'nav'), list_transform(regexp_extract_all(html, '<article>'), lambda x: 'article'), list_transform(regexp_extract_all(html, '<li>'), lambda x: 'li'))) AS tag FROM pages) GROUP BY ALL""")
def ir_block_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by tag, for the tags that every page's skeleton has."""
    return E.blocks(pages(spark, sf_dir)).where("tag IN ('h1', 'nav', 'article', 'li')").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("ir_blocks")
def ir_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.blocks(pages(spark, sf_dir))


@query("link_density_by_role")
def link_density_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.blocks(pages(spark, sf_dir)).groupBy("role").agg(F.count("*").alias("n"), F.avg("link_density").alias("link_density"), F.avg("text_density").alias("text_density"), F.sum("word_count").alias("words"))


@query("extract_candidates")
def extract_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.candidates(pages(spark, sf_dir))


@query("extract_cascade")
def extract_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cascade(E.candidates(pages(spark, sf_dir)))


FOUND = values(
    [
        (1, 0, "trafilatura", "First paragraph with more than thirty letters.\n\nSecond paragraph, also long enough to count:", "t", 14, 0.9),
        (1, 1, "readability", "first  paragraph with more than thirty letters.\n\nA third paragraph that only this one has.", "t", 14, 0.9),
        (1, 2, "markdownify", "Menu and everything else that is on the page, navigation too.", "t", 90, 0.9),
        (2, 0, "markdownify", "Nothing clean here, so the whole page is the base of it.", "t", 12, 0.2),
        (2, 1, "raw_lxml", "raw words", "t", 200, 0.1),
        (3, 0, "documentation", "Docs text that stands alone, however short the others are.", "t", 31, 0.8),
        (3, 1, "trafilatura", "Other paragraph which would be new to the text of the base.", "t", 50, 0.8),
    ],
    "kind, ord, strategy, text, title, word_count, confidence",
)


@query("extract_union", f"SELECT page_id, CASE kind WHEN 1 THEN 'union(trafilatura+readability)' WHEN 2 THEN 'markdownify' ELSE 'documentation' END AS strategy, CASE kind WHEN 1 THEN text || ' ' || page_id || chr(10) || chr(10) || 'A third paragraph that only this one has. ' || page_id ELSE text || ' ' || page_id END AS text FROM ({FOUND}) f JOIN pages ON page_id % 3 + 1 = kind WHERE ord = 0")
def extract_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of three kinds of pages, their last paragraph with the page's number, merged."""
    f = F.broadcast(literal(spark, FOUND))
    rows = pages(spark, sf_dir).select("page_id", (C("page_id") % 3 + 1).alias("kind")).join(f, "kind").withColumn("text", F.concat("text", F.lit(" "), "page_id")).drop("kind")
    return E.union(rows).select("page_id", "strategy", "text")


SPANNED = "<table><thead><tr><th scope=col>A<th>B</tr></thead><tr><td rowspan=2>#<td>2<tr><td>3</table>"
CELL_ROWS = values([(0, 0, 1, 1, "thead", True, "A"), (0, 1, 1, 1, "thead", True, "B"), (1, 0, 2, 1, "tbody", False, "#"), (1, 1, 1, 1, "tbody", False, "2"), (2, 1, 1, 1, "tbody", False, "3")], "row_index, column_index, row_span, column_span, row_group, header, text")


@query("table_cells", f"SELECT page_id, 0 AS table_no, row_index, column_index, row_span, column_span, row_group, header, replace(text, '#', page_id::VARCHAR) AS text FROM pages, ({CELL_ROWS})")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of a table with spans that each page gets, with the page's number in a cell."""
    put = F.concat(F.replace(F.lit(SPANNED), F.lit("#"), C("page_id").cast("string")), "html")
    return E.cells(pages(spark, sf_dir).select("page_id", put.alias("html"))).drop("scope")


NESTED = "<ol start=3><li>a<li value=8>b<ol reversed><li>i<li>j</ol></ol>"
ITEM_ROWS = values([(0, 0, "ordered", 0, 3, "a"), (0, 1, "ordered", 0, 8, "bij"), (1, 0, "ordered", 1, 2, "i"), (1, 1, "ordered", 1, 1, "j")], "list_no, index, kind, depth, ordinal, text")
NAV_ITEMS = "regexp_extract_all(html, '<li><a [^>]*>([^<]*)</a></li>', 1)"


@query("list_items", f"SELECT page_id, list_no, index, kind, depth, ordinal, text FROM pages, ({ITEM_ROWS}) UNION ALL SELECT page_id, 2, k - 1, 'unordered', 0, NULL, trim(regexp_replace(x, '\\s+', ' ', 'g')) FROM (SELECT page_id, unnest({NAV_ITEMS}) AS x, generate_subscripts({NAV_ITEMS}, 1) AS k FROM pages)")
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the pages' lists, and of nested numbered lists put before them."""
    return E.items(pages(spark, sf_dir).select("page_id", F.concat(F.lit(NESTED), "html").alias("html")))


@query("list_ordinals", "SELECT conv_id, turn, 3 + sum(CASE WHEN role = 'system' THEN 10 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal FROM conversations")
def list_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running ordinals as a window over exploded items (turns stand in for items)."""
    from pyspark.sql.window import Window

    from brookmill.sources.tables import table

    step = F.when(C("role") == "system", 10).otherwise(1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.lit(2) + F.sum(step).over(Window.partitionBy("conv_id").orderBy("turn"))).alias("ordinal"))


MEDOID = """SELECT page_id, 'a' AS key, 'native' AS lineage, 0 AS priority, regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', ' ', 'g') AS text FROM pages
  UNION ALL SELECT page_id, 'b', 'density', 1, regexp_replace(regexp_extract(html, '(?is)<p>(.*)</p>', 1), '<[^>]+>', ' ', 'g') FROM pages
  UNION ALL SELECT page_id, 'c', 'dump', 2, regexp_replace(html, '<[^>]+>', ' ', 'g') FROM pages UNION ALL SELECT page_id, 'd', 'density', 3, repeat('unrelated words only ', 3) FROM pages"""


@query("text_medoid", f"""
WITH g AS (SELECT page_id, key, item, count(*) AS n FROM (SELECT page_id, key, unnest(CASE WHEN length(text) >= 5 THEN list_transform(range(1, length(text) - 3), lambda i: substr(text, i, 5)) ELSE [] END) AS item FROM ({MEDOID})) GROUP BY ALL),
z AS (SELECT page_id, key, sum(n) AS size FROM g GROUP BY ALL), h AS (SELECT a.page_id, a.key, b.key AS other, sum(least(a.n, b.n)) AS hit FROM g a JOIN g b USING (page_id, item) WHERE a.key <> b.key GROUP BY ALL),
r AS (SELECT * FROM ({MEDOID}) JOIN z USING (page_id, key)),
s AS (SELECT a.page_id, a.key, a.priority, b.lineage, max(2 * coalesce(hit, 0)::DOUBLE / (a.size + b.size)) AS s FROM r a JOIN r b ON a.page_id = b.page_id AND a.lineage <> b.lineage LEFT JOIN h ON h.page_id = a.page_id AND h.key = a.key AND h.other = b.key GROUP BY ALL),
m AS (SELECT page_id, key, priority, avg(s) AS mean, min(s) AS low, count(*) FILTER (s * 1000000 >= 100000) AS good FROM s GROUP BY ALL)
SELECT page_id, key, round(mean, 12) AS mean, round(low, 12) AS low FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY mean DESC, low DESC, priority, key) AS place FROM m WHERE good >= 2) WHERE place = 1""")
def text_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most typical of four candidates of each page: article, paragraphs, everything, and unrelated words."""
    h = C("html")
    strip = lambda x: F.regexp_replace(x, "<[^>]+>", " ")
    one = lambda key, lineage, priority, text: F.struct(F.lit(key).alias("key"), F.lit(lineage).alias("lineage"), F.lit(priority).alias("priority"), text.alias("text"))
    found = F.array(
        one("a", "native", 0, strip(F.regexp_extract(h, "(?is)<article[^>]*>(.*?)</article>", 1))), one("b", "density", 1, strip(F.regexp_extract(h, "(?is)<p>(.*)</p>", 1))),
        one("c", "dump", 2, strip(h)), one("d", "density", 3, F.lit("unrelated words only " * 3)),
    )
    return E.medoid(pages(spark, sf_dir).select("page_id", found.alias("candidates"))).withColumns({c: F.round(c, 12) for c in ("mean", "low")})


@query("lattice_best_path")
def lattice_best_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best paths over spans made from each page's blocks."""
    b = E.blocks(pages(spark, sf_dir), "page_id bigint, block_id string, ord bigint, parent_id string, role string, selectable boolean, word_count bigint, text_density double, link_density double").where("selectable")
    spans = b.select(C("page_id").alias("doc_id"), C("block_id").alias("source"), (C("ord") * 10).alias("s"), (C("ord") * 10 + F.least(C("word_count"), F.lit(14))).alias("e"), C("block_id").alias("block"), C("role").alias("type"), (C("text_density") - C("link_density")).alias("score"), F.array_compact(F.array("parent_id")).alias("ancestors"))
    return L.decode(spans, L.Weights(coverage=0.01, gap=0.001, fragment=0.1, contiguous=8, heading_body=0.2))
