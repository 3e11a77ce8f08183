"""Pages to tables: one Arrow pass of the parser per page, then columns and joins only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookmill.functions import dom
from brookmill.functions import grams as N
from brookmill.functions import patterns as P
from brookmill.functions import text as X

BLOCKS = (
    "page_id bigint, block_id string, ord bigint, parent_id string, tag string, role string, atomic boolean, selectable boolean, text string, depth bigint, word_count bigint, text_bytes bigint, "
    "html_bytes bigint, link_count bigint, link_text_bytes bigint, descendants bigint, text_density double, link_density double"
)
CANDIDATES = "page_id bigint, ord bigint, strategy string, text string, title string, word_count bigint, confidence double"
CELLS = "page_id bigint, table_no bigint, row_index bigint, column_index bigint, row_span bigint, column_span bigint, row_group string, header boolean, scope string, text string"
ITEMS = "page_id bigint, list_no bigint, index bigint, kind string, depth bigint, ordinal bigint, text string"
TYPES = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}


def per_page(pages: DataFrame, schema: str, rows_of: Callable[[str], Iterator[dict]]) -> DataFrame:
    """Rows of ``schema`` from each page's html, a few hundred at a time."""
    fields = [f.split() for f in schema.split(", ")]
    arrow = pa.schema([(n, TYPES[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept: list[dict] = []
            for page, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                kept += ({"page_id": page, **r} for r in rows_of(html.as_py()))
                if len(kept) > 2000:
                    yield pa.RecordBatch.from_pylist(kept, schema=arrow)
                    kept = []
            if kept:
                yield pa.RecordBatch.from_pylist(kept, schema=arrow)

    return pages.select(F.col("page_id").cast("bigint"), "html").mapInArrow(run, schema)


def blocks(pages: DataFrame, schema: str = BLOCKS) -> DataFrame:
    """The pages' blocks; a schema of fewer columns keeps the others in the Python worker."""
    return per_page(pages, schema, dom.blocks)


def candidates(pages: DataFrame) -> DataFrame:
    return per_page(pages, CANDIDATES, dom.candidates)


def _cells(html: str) -> Iterator[dict]:
    for k, t in enumerate(n for n in dom.prune(dom.parse(html)).walk() if n.tag == "table"):
        for c in dom.table_cells(t):
            yield {"table_no": k, **c}


def _items(html: str) -> Iterator[dict]:
    for k, t in enumerate(n for n in dom.prune(dom.parse(html)).walk() if n.tag in ("ul", "ol", "dl")):
        for i in dom.list_items(t):
            i.pop("node")
            yield {"list_no": k, **i}


def cells(pages: DataFrame) -> DataFrame:
    return per_page(pages, CELLS, _cells)


def items(pages: DataFrame) -> DataFrame:
    return per_page(pages, ITEMS, _items)


def rank(strategy: Column) -> Column:
    """Trust in a strategy; unknown ones stand above the last resort."""
    table = F.create_map(*[F.lit(x) for kv in P.STRATEGY_RANK.items() for x in kv])
    return F.coalesce(F.element_at(table, strategy), F.lit(1))


def cascade(found: DataFrame, least: float = 0.6) -> DataFrame:
    """The first candidate, in the strategies' order, with enough words; the first strategy also needs confidence."""
    usable = found.where((F.col("word_count") >= 8) & ((F.col("strategy") != "rs-trafilatura") | (F.col("confidence") >= least)))
    best = usable.groupBy("page_id").agg(F.min(F.struct("ord", "strategy", "text", "title", "word_count", "confidence")).alias("b"))
    return best.select("page_id", "b.strategy", "b.text", "b.title", "b.word_count", "b.confidence")


def union(found: DataFrame, news: bool = False) -> DataFrame:
    """The cleanest substantial candidate; a thin base takes in paragraphs of other clean candidates that it lacks, in
    the order of the candidates. Columns: page_id, strategy, text, word_count."""
    special = ((F.col("strategy") == "documentation") | F.col("strategy").startswith("github-")) & (F.col("word_count") >= 30)
    clean = F.col("strategy").isin(*P.CLEAN_STRATEGIES)
    c = found.withColumns({"special": special, "clean": clean, "rank": rank(F.col("strategy"))})
    first = Window.partitionBy("page_id").orderBy(F.desc("special"), F.desc("clean"), F.desc("rank"), F.desc("word_count"), "ord")
    c = c.withColumn("base", F.row_number().over(first) == 1)
    paras = c.where("base OR clean").select("page_id", "ord", "strategy", "base", F.posexplode(X.paragraphs(F.col("text"))).alias("pos", "p"))
    paras = paras.withColumn("key", X.dedup_key(F.col("p"))).where("key <> ''")
    fresh = paras.groupBy("page_id", "key").agg(F.max("base").alias("known"), F.min(F.struct("ord", "pos", "p", "strategy")).alias("a")).where("NOT known")
    more = fresh.groupBy("page_id").agg(F.sort_array(F.collect_list("a")).alias("more"))
    b = c.where("base").join(more, "page_id", "left")
    thin = (F.col("word_count") < (100 if news else 400)) & (F.col("strategy") != "documentation") & ~F.col("strategy").startswith("github-") & F.col("more").isNotNull()
    used = F.array_distinct(F.concat(F.array("strategy"), F.transform("more", lambda m: m["strategy"])))
    text = F.when(thin, F.concat("text", F.lit("\n\n"), F.array_join(F.transform("more", lambda m: m["p"]), "\n\n"))).otherwise(F.col("text"))
    label = F.when(thin & (F.size(used) > 1), F.concat(F.lit("union("), F.array_join(used, "+"), F.lit(")"))).otherwise(F.col("strategy"))
    return b.select("page_id", label.alias("strategy"), text.alias("text"), F.regexp_count(text, F.lit(P.WORD)).alias("word_count"))


MEDOID = pa.schema([("page_id", pa.int64()), ("key", pa.string()), ("mean", pa.float64()), ("low", pa.float64())])


def medoid(pages: DataFrame, least_ppm: int = 100_000) -> DataFrame:
    """The candidate most like the other lineages: per candidate the best five-character Dice similarity to each other
    lineage; eligible with at least two of at least ``least_ppm``; then the best mean, the best minimum, the first role, the
    smallest key. Candidates without grams count for nothing; ratios are compared as doubles of integers.

    pages: page_id, candidates (array of key, lineage, priority, text). A page's candidates are compared where they are;
    only ids are counted over all rows, and those of rows that share one are put together, texts of one key as one bag.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, found in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                best = _medoid(found.as_py() or [], least_ppm)
                if best:
                    out.append({"page_id": page, **best})
            yield pa.RecordBatch.from_pylist(out, schema=MEDOID)

    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "candidates")
    shared = p.groupBy("page_id").count().where("count > 1").select("page_id")
    if not shared.isEmpty():
        together = p.join(shared, "page_id", "left_semi").groupBy("page_id").agg(F.flatten(F.collect_list("candidates")).alias("candidates"))
        p = p.join(shared, "page_id", "left_anti").unionByName(together)
    return p.mapInArrow(run, "page_id bigint, key string, mean double, low double")


def _medoid(candidates: list[dict], least_ppm: int) -> dict | None:
    texts: dict[str, list[str]] = {}
    roles = {c["key"]: c for c in candidates}
    for c in candidates:
        if len(c["text"] or "") >= N.GRAM:
            texts.setdefault(c["key"], []).append(c["text"])
    keys = list(texts)
    if len({roles[k]["lineage"] for k in keys}) < 3:
        return None
    counts = N.bags([texts[k] for k in keys])
    size = counts.sum(axis=0).tolist()
    places = []
    for i, k in enumerate(keys):
        best: dict[str, float] = {}
        for j, other in enumerate(keys):
            if (their := roles[other]["lineage"]) != roles[k]["lineage"]:
                best[their] = max(best.get(their, 0.0), 2 * int(np.minimum(counts[:, i], counts[:, j]).sum()) / (size[i] + size[j]))
        if sum(s * 1_000_000 >= least_ppm for s in best.values()) >= 2:
            mean, low = sum(best.values()) / len(best), min(best.values())
            places.append(((-mean, -low, roles[k]["priority"], k), {"key": k, "mean": mean, "low": low}))
    return min(places, key=lambda x: x[0])[1] if places else None