"""Queries over Markdown and plain texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookmill.functions import page as G
from brookmill.functions import patterns as P
from brookmill.functions import text as X
from brookmill.functions.sqltext import lit
from brookmill.plans.pages import COUNT, HAS
from brookmill.plans.registry import query
from brookmill.sources.tables import table

C = F.col


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


PROBE = f"trim(regexp_replace(x, {lit(P.LINE_PREFIX)}, ''))"


@query("boilerplate_lines", f"""SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT ({PROBE} <> '' AND len(regexp_extract_all({PROBE}, '\\S+')) <= 10 AND regexp_matches({PROBE}, {lit(P.BOILERPLATE_LINE)}))), chr(10))) AS kept_md5 FROM documents""")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(X.strip_boilerplate(C("text"))).alias("kept_md5"))


PARAS = "list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: length(p) > 30)"


@query("paragraph_keys", f"SELECT doc_id, len(ps) AS n_paragraphs, md5(array_to_string(list_transform(ps, lambda p: substr(trim(regexp_replace(lower(p), '\\s+', ' ', 'g')), 1, 200)), '|')) AS keys_md5 FROM (SELECT doc_id, {PARAS} AS ps FROM documents)")
def paragraph_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = documents(spark, sf_dir).select("doc_id", X.paragraphs(C("text")).alias("ps"))
    return p.select("doc_id", F.size("ps").alias("n_paragraphs"), F.md5(F.array_join(F.transform("ps", X.dedup_key), "|")).alias("keys_md5"))


@query("repeated_paragraphs", "SELECT key, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, lower(trim(unnest(string_split(text, chr(10))))) AS key FROM documents) WHERE length(key) > 30 GROUP BY key HAVING count(DISTINCT doc_id) > 1")
def repeated_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in more than one document."""
    k = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.lower(F.trim("line")).alias("key")).where(F.length("key") > 30)
    return k.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last")).where("first_doc <> last").drop("last")


# Documents with a title: another one, their own first line, none, or a heading in place.
TITLED = "SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN '# ' || text WHEN doc_id % 4 = 3 THEN '  ' || text || chr(10) || '```py' || chr(10) || 'a {color: red} function (x)' || chr(10) || '```' || chr(10) || 'cookie [edit] $x$ `c`' ELSE text END AS text, CASE WHEN doc_id % 4 = 0 THEN 'A title' WHEN doc_id % 4 = 1 THEN ' ' || lower(split_part(text, chr(10), 1)) WHEN doc_id % 4 = 2 THEN 'x' ELSE '' END AS title FROM documents"


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = C("doc_id") % 4, C("text")
    more = F.concat(F.lit("  "), t, F.lit("\n```py\na {color: red} function (x)\n```\ncookie [edit] $x$ `c`"))
    title = F.when(k == 0, "A title").when(k == 1, F.concat(F.lit(" "), F.lower(F.substring_index(t, "\n", 1)))).when(k == 2, "x").otherwise("")
    return documents(spark, sf_dir).select("doc_id", F.when(k == 2, F.concat(F.lit("# "), t)).when(k == 3, more).otherwise(t).alias("text"), title.alias("title"))


BODY = "ltrim(regexp_replace(text, '^\\s+', ''))"
FIRST = f"trim(split_part({BODY}, chr(10), 1))"


@query("title_heading", f"""SELECT doc_id, md5(CASE WHEN title = '' OR trim(text) = '' OR starts_with({FIRST}, '#') THEN text WHEN lower({FIRST}) = lower(trim(title)) THEN '# ' || {BODY} ELSE '# ' || trim(title) || chr(10) || chr(10) || {BODY} END) AS text_md5 FROM ({TITLED})""")
def title_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titled(spark, sf_dir).select("doc_id", F.md5(X.with_title(C("text"), C("title"))).alias("text_md5"))


CATS = ", ".join(f"CASE WHEN {HAS('text', p)} THEN '{n}' END" for p, n in ((P.MD_HEADING, "heading"), (P.MD_LIST_ITEM, "list"), (P.MD_TABLE, "table"), (P.MD_CODE, "code"), (P.MD_MATH, "math")))
PROSE = "regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '`[^`]+`', ' ', 'g')"


@query("markdown_checks", f"""SELECT doc_id, array_to_string(list_filter([{CATS}], lambda x: x IS NOT NULL), ',') AS categories,
  CASE WHEN length(text) = 0 THEN 0 ELSE greatest(0, 1 - least(1.0::DOUBLE, ({COUNT(PROSE, X.CSS_RULE)} * 4 + {COUNT(PROSE, X.JS_LEAK)} * 2 + {COUNT(PROSE, X.NAVIGATION)}) * 1000.0::DOUBLE / greatest(length(text), 1))) END AS noise,
  regexp_replace(text, {lit(P.WIKI_EDIT)}, '', 'g').md5() AS no_wiki, md5(regexp_replace(text, '([\\\\`*_\\[\\]<>])', '\\\\\\1', 'g')) AS escaped, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS html_escaped,
  repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda r: length(r))), 0) + 1)) AS fence FROM ({TITLED})""")
def markdown_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = C("text")
    fence = F.substring_index(X.fenced(t, F.lit("")), "\n", 1)
    return titled(spark, sf_dir).select("doc_id", F.array_join(G.markdown_categories(t), ",").alias("categories"), X.noise_score(t).alias("noise"), F.md5(X.strip_wiki(t)).alias("no_wiki"), F.md5(X.escape_markdown(t)).alias("escaped"), F.md5(X.escape_html(t)).alias("html_escaped"), fence.alias("fence"))


@query("truncate_boundary", """SELECT doc_id, length(t) AS n, md5(t) AS text_md5 FROM (SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE
  rtrim(substr(text, 1, CASE WHEN cut_at < 479 THEN 959 ELSE cut_at END), ' ' || chr(10) || chr(9)) || chr(10) || chr(10) || '[content truncated at configured limit]' END AS t
  FROM (SELECT doc_id, text, greatest(959 - coalesce(nullif(strpos(reverse(substr(text, 1, 959)), chr(10)), 0), 960), 959 - coalesce(nullif(strpos(reverse(substr(text, 1, 959)), ' '), 0), 960)) AS cut_at FROM documents))""")
def truncate_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts capped at 1000 characters (so that most are), at a line or word end."""
    t = documents(spark, sf_dir).select("doc_id", X.truncated(C("text"), 1000).alias("t"))
    return t.select("doc_id", F.length("t").alias("n"), F.md5("t").alias("text_md5"))


@query("response_budget", "SELECT doc_id, CASE WHEN sum(octet_length(encode(text))) OVER (ORDER BY doc_id) > 400000 THEN 'response output budget exceeded' END AS error FROM documents")
def response_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte budget over a response: rows after the budget is spent carry an error. Sums are added up per range of ids, then over the ranges."""
    d = documents(spark, sf_dir).select("doc_id", F.octet_length("text").alias("b"), F.floor(C("doc_id") / 1024).alias("part"))
    sums = d.groupBy("part").agg(F.sum("b").alias("s"))
    before = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.sum("b").over(Window.partitionBy("part").orderBy("doc_id"))
    return d.withColumn("run", inner).join(before, "part").select("doc_id", F.when(C("run") + C("before") > 400000, "response output budget exceeded").alias("error"))


NAMES = ("b.py?raw=1", "Dockerfile", "q.SQL#L1", "none", "m.cc")


@query("source_languages", "SELECT page_id, ['python', 'dockerfile', 'sql', '', 'cpp'][page_id % 5 + 1] AS language FROM pages")
def source_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of files whose names go round, in folders named by page numbers."""
    name = F.element_at(F.array(*map(F.lit, NAMES)), (C("page_id") % 5 + 1).cast("int"))
    url = F.concat(F.lit("https://x.example/"), C("page_id").cast("string"), F.lit("/"), name)
    return table(spark, sf_dir, "pages").select("page_id", X.source_language(url).alias("language"))


@query("text_sections", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
s AS (SELECT *, sum(CASE WHEN length(line) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l)
SELECT doc_id, section, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM s GROUP BY ALL""")
def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections opened by short lines: a running sum of boundaries within each document."""
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    s = F.sum(F.when(F.length("line") < 60, 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("pos"))
    return rows.withColumn("section", s).groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("conversation_windows", "SELECT conv_id, turn, role, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS chars_so_far, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role FROM conversations")
def conversation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.sum(F.length("text")).over(w).alias("chars_so_far"), F.lag("role").over(w).alias("previous_role"))
