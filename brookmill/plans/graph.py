"""Queries over the ordered graph of pages: its tables, integrity, atoms, selections and certificates."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookmill.functions import ir2 as R
from brookmill.operators import extract as E
from brookmill.operators import studies as U
from brookmill.plans.documents import pages
from brookmill.plans.registry import query
from brookmill.sources.tables import table

C = F.col
WITHIN = "table_id string, cell_id string, list_id string, item_id string, code_id string, math_id string"
ELEMENTS = f"page_id bigint, id string, ord bigint, parent_id string, depth bigint, tag string, path string, heading_level bigint, href string, src string, alt string, language string, {WITHIN}"
RUNS = f"page_id bigint, id string, ord bigint, parent_id string, depth bigint, text string, {WITHIN}"
MATHS = "page_id bigint, node_id string, ord bigint, format string, display string, tex string, mathml string, alt string, truncated boolean"
ATOMS = "page_id bigint, run_id string, ord bigint, kind string, closure_id string, text string"


def _each(field: str):
    def rows(html: str | None) -> Iterator[dict]:
        yield from getattr(R.graph(html), field)

    return rows


def elements(p: DataFrame) -> DataFrame:
    return E.per_page(p, ELEMENTS, _each("elements"))


def runs(p: DataFrame) -> DataFrame:
    return E.per_page(p, RUNS, _each("runs"))


def maths(p: DataFrame) -> DataFrame:
    return E.per_page(p, MATHS, lambda html: R.maths(R.graph(html)))


def atoms(p: DataFrame) -> DataFrame:
    return E.per_page(p, ATOMS, lambda html: R.atoms(R.graph(html)))


COUNTS = " UNION ALL ".join(f"SELECT page_id, '{t}' AS tag, len(regexp_extract_all(html, '<{t}[ >]')) AS n FROM pages" for t in ("h1", "nav", "article", "li", "a", "footer", "b", "ul"))


@query("graph_tags", f"SELECT * FROM ({COUNTS}) WHERE n > 0")
def graph_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by tag, for tags that the pages write out."""
    return elements(pages(spark, sf_dir)).where("tag IN ('h1', 'nav', 'article', 'li', 'a', 'footer', 'b', 'ul')").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("graph_elements")
def graph_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(pages(spark, sf_dir))


@query("graph_links", r"SELECT page_id, k::BIGINT - 1 AS n, regexp_extract(x, 'href=\"([^\"]*)\"', 1) AS href, regexp_extract(x, '>([^<]*)</a>', 1) AS text FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*>[^<]*</a>')) AS x, generate_subscripts(regexp_extract_all(html, '<a [^>]*>[^<]*</a>'), 1) AS k FROM pages)")
def graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with the text run that stands in them, by their place among the page's links."""
    p = pages(spark, sf_dir)
    a = elements(p).where("tag = 'a'").select("page_id", "id", "ord", "href")
    t = runs(p).select("page_id", C("parent_id").alias("id"), "text")
    w = Window.partitionBy("page_id").orderBy("ord")
    return a.join(t, ["page_id", "id"]).select("page_id", (F.row_number().over(w) - 1).cast("bigint").alias("n"), "href", "text")


@query("graph_integrity", "SELECT page_id, 0 AS repeated_ids, 0 AS lost_parents, 0 AS order_faults, 0 AS depth_faults FROM pages")
def graph_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of each page's graph: ids that repeat, parents that do not exist, children not after their parent, depths not one below it."""
    p = pages(spark, sf_dir)
    e = elements(p).select("page_id", "id", "parent_id", "ord", "depth")
    every = e.unionByName(runs(p).select("page_id", "id", "parent_id", "ord", "depth"))
    up = e.select("page_id", C("id").alias("parent_id"), C("ord").alias("up_ord"), C("depth").alias("up_depth"))
    j = every.join(up, ["page_id", "parent_id"], "left")
    held = C("parent_id").isNotNull()
    g = j.groupBy("page_id").agg((F.count("id") - F.countDistinct("id")).alias("repeated_ids"), F.count_if(held & C("up_ord").isNull()).alias("lost_parents"), F.count_if(held & (C("ord") <= C("up_ord"))).alias("order_faults"), F.count_if(held & (C("depth") != C("up_depth") + 1)).alias("depth_faults"))
    return pages(spark, sf_dir).select("page_id").join(g, "page_id", "left").fillna(0)


STATE = "page_id bigint, truncated boolean, n_elements bigint, n_runs bigint, max_depth bigint, n_mapped bigint, source_mapped boolean, map_digest string"


def _state(html: str | None) -> Iterator[dict]:
    import hashlib

    g = R.graph(html)
    spans = R.source_text_map(html or "", g)
    framed = "".join(f"{len(i)}:{i}{a},{b};" for i, a, b in spans or ())
    yield {"truncated": g.truncated, "n_elements": len(g.elements), "n_runs": len(g.runs), "max_depth": max((e["depth"] for e in g.elements), default=0), "n_mapped": len(R.mapped_elements(html or "", g)), "source_mapped": spans is not None, "map_digest": hashlib.sha256(framed.encode()).hexdigest() if spans is not None else None}


@query("graph_state")
def graph_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each page's graph, and whether all its text was found in the source."""
    return E.per_page(pages(spark, sf_dir), STATE, _state)


@query("input_preflight", "SELECT page_id, length(html) BETWEEN 1 AND 1000000 AS admitted FROM pages")
def input_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission of pages to the costly lane, by characters, elements, depth and text fragments."""
    p = pages(spark, sf_dir)
    s = graph_state(spark, sf_dir)
    j = p.select("page_id", F.length("html").alias("chars")).join(s, "page_id")
    ok = C("chars").between(1, 1_000_000) & (C("n_elements") <= 5000) & (C("max_depth") <= 64) & (C("n_runs") <= 8000) & ~C("truncated")
    return j.select("page_id", ok.alias("admitted"))


@query("graph_markdown")
def graph_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of each page's whole graph."""
    return E.per_page(pages(spark, sf_dir), "page_id bigint, text string", lambda html: iter([{"text": R.serialized(R.graph(html))[0]}]))


@query("graph_maths")
def graph_maths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of the pages; each page gets one more in a paragraph, as the tables have none."""
    more = F.when(C("page_id") % 2 == 0, '<p><math alttext="x"><annotation encoding="application/x-tex">x^2</annotation></math>').otherwise('<script type="math/tex; mode=display">y</script>')
    return maths(pages(spark, sf_dir).select("page_id", F.concat("html", more).alias("html")))


@query("selection_atoms", "SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li>')) FROM pages) GROUP BY page_id")
def selection_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List-item atoms of each page; an item of the pages' lists holds one run."""
    return atoms(pages(spark, sf_dir)).where("kind = 'list_item'").groupBy("page_id").agg(F.count("*").alias("n"))


@query("atom_catalog")
def atom_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms(pages(spark, sf_dir))


@query("typed_overlays", "SELECT page_id, 'ul' AS tag, len(regexp_extract_all(html, '<ul>')) AS n FROM pages WHERE contains(html, '<ul>')")
def typed_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outermost code, tables, lists and formulas of each page, by tag; a figure is a barrier."""
    e = elements(pages(spark, sf_dir)).select(C("page_id").alias("doc"), "id", "tag", "path")
    above = F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 2), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k + 1), "/")), lambda x: x != C("path"))
    rows = e.select("doc", C("path").alias("id"), "tag", F.when(F.size(F.split("path", "/")) > 2, above).otherwise(F.array().cast("array<string>")).alias("ancestors"))
    got = U.outermost(rows, C("tag").isin("pre", "code", "table", "ul", "ol", "dl", "math", "figure")).where("tag <> 'figure'")
    return got.groupBy(C("doc").alias("page_id"), "tag").agg(F.count("*").alias("n"))


def classifier_records(blocks: DataFrame, chars: int = 4000, most: int = 40) -> DataFrame:
    """Selectable blocks as JSON records until characters or blocks are spent: page_id, ord, block_id, record, exposed."""
    record = F.to_json(F.struct(C("block_id").alias("id"), "role", F.substring("text", 1, 400).alias("text")))
    b = blocks.where("selectable").select("page_id", "ord", "block_id", "parent_id", "text", record.alias("record"))
    w = Window.partitionBy("page_id").orderBy("ord")
    run = F.sum(F.length("record") + 1).over(w)
    return b.withColumn("exposed", (run <= chars) & (F.row_number().over(w) <= most))


@query("classifier_input")
def classifier_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks exposed to a classifier and those left out, per page."""
    r = classifier_records(E.blocks(pages(spark, sf_dir)))
    return r.groupBy("page_id").agg(F.count_if("exposed").alias("n_exposed"), F.count_if(~C("exposed")).alias("n_omitted"), F.sum(F.when(C("exposed"), F.length("record") + 1).otherwise(0)).alias("n_chars"))


def parsed_selection(items: Column, exposed: Column) -> Column:
    """struct(ids, error) of a selection: block ids, or forward ranges ``a..b`` of the exposed ids; in strict order, without repeats."""
    ends = F.transform(items, lambda x: F.struct(F.array_position(exposed, F.substring_index(x, "..", 1)).alias("a"), F.array_position(exposed, F.substring_index(x, "..", -1)).alias("b"), F.contains(x, F.lit("..")).alias("range")))
    unknown = F.exists(ends, lambda e: (e["a"] == 0) | (e["b"] == 0))
    backward = F.exists(ends, lambda e: e["range"] & (e["a"] >= e["b"]))
    places = F.flatten(F.transform(ends, lambda e: F.sequence(F.least(e["a"], e["b"]), F.greatest(e["a"], e["b"]))))
    error = (
        F.when(F.exists(items, lambda x: ~x.rlike(r"^block-\d{6}(\.\.block-\d{6})?$")), "not a block or range").when(F.size(F.array_distinct(items)) < F.size(items), "duplicate item").when(unknown, "unknown block")
        .when(backward, "range not forward").when(F.array_sort(F.array_distinct(places)) != places, "not in strict order")
    )
    return F.struct(F.when(error.isNull(), F.transform(places, lambda k: F.get(exposed, (k - 1).cast("int")))).alias("ids"), error.alias("error"))


@query("block_selections", "WITH p AS (SELECT page_id FROM pages) SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'range not forward' WHEN 2 THEN 'unknown block' WHEN 3 THEN 'duplicate item' WHEN 4 THEN 'not in strict order' END AS error, CASE WHEN page_id % 5 = 0 THEN 3 END AS n_selected FROM p")
def block_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections over each page's exposed blocks: a sound one, and four that break a rule."""
    r = classifier_records(E.blocks(pages(spark, sf_dir))).where("exposed").groupBy("page_id").agg(F.sort_array(F.collect_list("block_id")).alias("ids"))
    at = lambda k: F.get("ids", F.lit(k))
    span = lambda a, b: F.concat(a, F.lit(".."), b)
    k = C("page_id") % 5
    items = F.when(k == 0, F.array(at(0), span(at(1), at(2)))).when(k == 1, F.array(span(at(2), at(1)))).when(k == 2, F.array(F.lit("block-999999"))).when(k == 3, F.array(at(0), at(0))).otherwise(F.array(at(2), at(0)))
    s = r.select("page_id", parsed_selection(items, C("ids")).alias("s"))
    return s.select("page_id", "s.error", F.when(C("s.ids").isNotNull(), F.size("s.ids")).alias("n_selected"))


@query("reconstructions")
def reconstructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the longest run of selected blocks (every second one) that a budget of characters holds."""
    b = classifier_records(E.blocks(pages(spark, sf_dir))).where("exposed AND ord % 2 = 0")
    w = Window.partitionBy("page_id").orderBy("ord")
    kept = b.withColumn("run", F.sum(F.length("text") + 2).over(w)).where("run <= 1500")
    return kept.groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


@query("block_documents", "SELECT page_id, TRUE AS sound FROM pages")
def block_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural checks of each page's block document: numbers without gaps, ids that follow them, parents before children."""
    b = E.blocks(pages(spark, sf_dir))
    up = b.select("page_id", C("block_id").alias("parent_id"), C("ord").alias("up"))
    j = b.join(up, ["page_id", "parent_id"], "left")
    ok = (C("block_id") == F.format_string("block-%06d", "ord")) & (C("parent_id").isNull() | (C("up") < C("ord")))
    g = j.groupBy("page_id").agg((F.bool_and(ok) & (F.max("ord") + 1 == F.count("*")) & (F.min("ord") == 0)).alias("sound"))
    return pages(spark, sf_dir).select("page_id").join(g, "page_id", "left").fillna(True, ["sound"])


def _certified(html: str | None) -> Iterator[dict]:
    g = R.graph(html)
    chosen = [e["id"] for e in g.elements if e["tag"] == "p"][:3]
    made = R.certificate(html or "", chosen)
    text = R.replayed(html or "", made) if made else None
    yield {"issued": made is not None, "replayed": text is not None, "refused": R.replayed((html or "") + " ", made or "") is None, "n_chars": len(text or "")}


@query("selection_certificates", "SELECT page_id, TRUE AS issued, TRUE AS replayed, TRUE AS refused FROM pages WHERE contains(html, '<p>')")
def selection_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificates of each page's first paragraphs: made, replayed from the source, and refused for another source."""
    got = E.per_page(pages(spark, sf_dir).where(F.contains("html", F.lit("<p>"))), "page_id bigint, issued boolean, replayed boolean, refused boolean, n_chars bigint", _certified)
    return got.drop("n_chars")


SEPARATOR = r"(?m)^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$"


def structural_score(kind: Column, text: Column) -> Column:
    """2 for markup or fences (code), markup or a separator row (tables); 1 for indented code or two lines with pipes; else 0."""
    low, lines = F.lower(text), F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    code = F.when(low.rlike(r"<\s*(?:pre|code)\b") | text.rlike(r"(?m)^\s{0,3}(?:```|~~~)"), 2).when((F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(r"^(?:    |\t)")), 1).otherwise(0)
    grid = F.when(low.rlike(r"<\s*table\b") | text.rlike(SEPARATOR), 2).when(F.size(F.filter(lines, lambda x: F.contains(x, F.lit("|")))) >= 2, 1).otherwise(0)
    return F.when(kind == "code", code).otherwise(grid)


@query("structural_scores", r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN regexp_matches(lower(text), '<\s*(?:pre|code)\b') OR regexp_matches(text, '(?m)^\s{0,3}(?:```|~~~)') THEN 2 WHEN len(l) > 0 AND len(list_filter(l, lambda x: NOT regexp_matches(x, '^(?:    |\t)'))) = 0 THEN 1 ELSE 0 END
  ELSE CASE WHEN regexp_matches(lower(text), '<\s*table\b') OR regexp_matches(text, '(?m)^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$') THEN 2 WHEN len(list_filter(l, lambda x: contains(x, '|'))) >= 2 THEN 1 ELSE 0 END END AS score
  FROM (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)""")
def structural_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as code (even numbers) and as tables (odd ones)."""
    kind = F.when(C("doc_id") % 2 == 0, "code").otherwise("table")
    return table(spark, sf_dir, "documents").select("doc_id", structural_score(kind, C("text")).alias("score"))


def table_reasons(cells: DataFrame) -> DataFrame:
    """Per table of ``cells`` the first reason against reading it as data; null if it is a plain grid with one header row."""
    g = cells.groupBy("page_id", "table_no").agg(
        F.max(C("row_index") + C("row_span")).alias("rows"), F.max(C("column_index") + C("column_span")).alias("columns"), F.count("*").alias("n"), F.bool_or((C("row_span") > 1) | (C("column_span") > 1)).alias("spans"),
        F.bool_and((C("row_index") > 0) | C("header")).alias("headed"), F.bool_or((C("row_index") > 0) & C("header")).alias("more"), F.bool_or(C("text") == "").alias("empty"),
    )
    why = (
        F.when((C("rows") < 2) | (C("columns") < 2), "non_data_table_shape").when(C("spans") | (C("n") != C("rows") * C("columns")), "non_rectangular_table").when(~C("headed"), "layout_table_without_header")
        .when(C("more"), "complex_header_table").when(C("empty"), "empty_or_inexact_table_cell")
    )
    return g.select("page_id", "table_no", why.alias("reason"))


@query("table_eligibility", """SELECT page_id, 0::BIGINT AS table_no, CASE page_id % 6 WHEN 1 THEN 'non_data_table_shape' WHEN 2 THEN 'non_rectangular_table' WHEN 3 THEN 'layout_table_without_header' WHEN 4 THEN 'complex_header_table' WHEN 5 THEN 'empty_or_inexact_table_cell' END AS reason FROM pages""")
def table_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table put into each page, of six shapes, with its page's title in a cell."""
    row = lambda tag, *cells: "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
    head, body = row("th", "a", "b"), row("td", "1", "2")
    shapes = [head + body, row("th", "a", "b"), head + "<tr><td colspan=2>1</td></tr>", body + body, head + row("th", "c", "d"), head + row("td", "1", "")]
    shape = F.element_at(F.array(*[F.lit(f"<table>{s}</table>") for s in shapes]), (C("page_id") % 6 + 1).cast("int"))
    return table_reasons(E.cells(pages(spark, sf_dir).select("page_id", F.concat(shape, "html").alias("html"))))
