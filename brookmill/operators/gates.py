"""Acceptance: completeness scores, risk and quality gates, routes, provenance. Columns only, unless a sequence is walked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.functions import page as G
from brookmill.functions import patterns as P
from brookmill.functions import scoring as K

# Bounds of the gates.
ACCEPT_WORDS = 8
SPARSE_WORDS = 15
CONFIDENT, ADAPTIVE_CONFIDENT = 0.60, 0.75
RISKY_TYPES = ("collection", "listing", "product")
COMPLEXITY, LOSSES, DISAGREEMENT = 3, 1, 0.45
RESCUE_CHARS = 3000
GROUNDED, IN_ORDER, DUPLICATES = 0.80, 0.65, 0.25
PROSE_TYPES = ("article", "documentation")


def reasons(*named: tuple[Column, str]) -> Column:
    """The names whose condition holds, in this order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in named]))


def completeness(words: Column, truncated: Column, losses: Column, coverage: Column, grounding: Column, whole: Column) -> Column:
    """struct(score, coverage, source_coverage, output_grounding, reasons): a conservative estimate of how complete an output is.

    The lesser of source coverage and output grounding, at most 0.50 for sparse output, 0.65 if truncated, 0.99 if only a
    prefix was assessed, less 0.08 for every lost kind of structure (0.35 at most). Without grounding (null) it is 0.
    """
    known = coverage.isNotNull() & grounding.isNotNull()
    sparse, lost = words <= SPARSE_WORDS, F.size(losses)
    capped = F.least(coverage, grounding, F.when(sparse, 0.50).otherwise(1.0), F.when(truncated, 0.65).otherwise(1.0), F.when(whole, 1.0).otherwise(0.99))
    score = F.round(F.greatest(F.lit(0.0), capped - F.least(F.lit(0.35), lost * 0.08)), 3)
    first = reasons((sparse, "sparse_output"), (truncated, "output_truncated"))
    last = reasons((~known, "grounding_unavailable"), (known & ~whole, "grounding_budget_limited"), (known & (coverage < GROUNDED), "low_source_coverage"), (known & (grounding < GROUNDED), "low_output_grounding"))
    label = F.when(~known, "unassessed").when(whole, "source_full").otherwise("source_prefix")
    return F.struct(
        F.when(known, score).otherwise(0.0).alias("score"), label.alias("coverage"), F.round(coverage, 4).alias("source_coverage"), F.round(grounding, 4).alias("output_grounding"),
        F.concat(first, losses, last).alias("reasons"),
    )


def confident(words: Column, kind: Column, confidence: Column, shortcut: bool = True) -> Column:
    """Whether a primary candidate stands on its own; articles do without confidence where the shortcut is allowed."""
    sure = confidence >= (CONFIDENT if shortcut else max(CONFIDENT, ADAPTIVE_CONFIDENT))
    return (words >= ACCEPT_WORDS) & ((sure | (kind == "article")) if shortcut else sure)


def risk(kind: Column, confidence: Column, complexity: Column, losses: Column, candidates: Column, disagreement: Column) -> Column:
    """Reasons why a candidate merits a second opinion; none: an empty array."""
    lossy = F.size(losses) >= LOSSES
    named = reasons((confidence < ADAPTIVE_CONFIDENT, "low_confidence"), (kind.isin(*RISKY_TYPES), "risky_page_type"), (complexity >= COMPLEXITY, "structural_complexity"), (lossy, "structure_loss"))
    last = reasons(((candidates >= 2) & (disagreement >= DISAGREEMENT), "candidate_disagreement"))
    return F.concat(named, F.when(lossy, losses).otherwise(F.array().cast("array<string>")), last)


def rescue(broad: Column, broad_words: Column, article: Column, article_words: Column) -> Column:
    """Whether an article candidate replaces a short broad one: at least a quarter longer."""
    tried = (broad_words >= ACCEPT_WORDS) & (F.length(broad) <= RESCUE_CHARS)
    return tried & (article_words >= ACCEPT_WORDS) & (F.length(article) * 4 >= F.length(broad) * 5)


def duplicate_share(text: Column) -> Column:
    """Share of blocks that repeat another one, of texts with at least three blocks; else 0."""
    blocks = F.filter(F.split(text, r"\n\s*\n"), lambda b: G.content_units(b) >= 4)
    keys = F.transform(blocks, lambda b: F.lower(F.trim(F.regexp_replace(b, r"\s+", " "))))
    return F.when(F.size(keys) >= 3, (F.size(keys) - F.size(F.array_distinct(keys))) / F.size(keys)).otherwise(0.0)


def quality_rejection(text: Column, source: Column, kind: Column, confidence: Column, words: Column, baseline: Column, attested: Column | None = None) -> Column:
    """The first gate that a text fails which is to replace ``baseline`` (kind, confidence and words are the baseline's); null if none.

    ``source`` is the visible source text. A text whose serialisation is attested skips grounding and order only.
    """
    trusted = kind.isin(*PROSE_TYPES) & (confidence >= ADAPTIVE_CONFIDENT)
    least = F.when(trusted & (words >= 80), F.greatest(F.lit(ACCEPT_WORDS), F.floor(words / 2))).when(words >= 100, F.least(F.lit(24), F.greatest(F.lit(ACCEPT_WORDS), F.floor(words / 20)))).otherwise(ACCEPT_WORDS)
    ours, theirs = G.quality_tokens(text), G.quality_tokens(source)
    loose = F.lit(True) if attested is None else ~attested
    lost = F.array_except(G.markdown_categories(baseline), G.markdown_categories(text))
    fences = F.regexp_count(text, F.lit("```"))
    return (
        F.when(G.content_units(text) < least, "insufficient_content")
        .when(F.contains(text, F.lit("\0")) | text.rlike(P.UNSAFE_HTML), "unsafe_structure")
        .when(fences % 2 == 1, "unbalanced_code_fence")
        .when(duplicate_share(text) > DUPLICATES, "duplicate_content")
        .when(loose & ((F.size(ours) == 0) | (F.size(theirs) == 0)), "ungrounded_content")
        .when(loose & (K.bag_share(ours, theirs) < GROUNDED), "ungrounded_content")
        .when(loose & (K.order_share_of(ours, theirs) < IN_ORDER), "source_order_violation")
        .when(trusted & (F.size(lost) > 0), "structure_regression")
    )


def cacheable(m: Column) -> Column:
    """Whether a result's provenance ``m`` lets it be cached: no temporary fallback, and model output only with a verified receipt."""
    assisted = m["model_assisted"] | (m["route"] == "quality_model") | m["strategy"].startswith("mineru-")
    receipt = m["receipt_verified"] & (m["receipt_schema"] == "source-serialization.v1") & m["receipt_sha256"].rlike("^[0-9a-f]{64}$") & (m["items"] >= 1) & m["selected"].between(F.lit(1), m["items"])
    model = m["quality_succeeded"] & receipt & (F.trim(m["backend_revision"]) != "")
    return F.when(assisted, model).otherwise(~(m["quality_attempted"] & ~m["quality_succeeded"]))


def specialist_route(strategy: Column, scope: Column) -> Column:
    """struct(route, reasons) of outputs that specialists made."""
    known = [
        (strategy.startswith("academic-metadata-"), "scholarly_metadata_fallback", ("publisher_full_text_unavailable", "metadata_only")), (strategy == "pypdfium2+academic", "academic_pdf", ("direct_pdf",)),
        (strategy == "academic-html+pdf", "academic_pdf_fallback", ("academic_landing_detected", "pdf_full_text_selected")), (strategy == "academic-html", "academic_html", ("academic_full_text_detected",)),
        (strategy == "academic-landing", "academic_landing", ("full_text_unavailable",)), (strategy.startswith("github-"), "github_source", ("github_source_specialist",)), (scope == "source", "raw_source", ("non_html_source",)),
    ]
    pair = lambda route, why: F.struct(F.lit(route).alias("route"), why.alias("reasons"))
    last = pair("specialist", F.array(F.when(strategy == "", "specialist_output").otherwise(strategy)))
    return reduce(lambda rest, k: F.when(k[0], pair(k[1], F.array(*map(F.lit, k[2])))).otherwise(rest), reversed(known), last)


def stage_timings(total: Column, queue: Column, fetch: Column, render: Column) -> Column:
    """map of stage to milliseconds that never claims more than the total: fetch and render shrink in proportion."""
    none = F.lit(0.0)
    total = F.greatest(none, total)
    queue = F.least(F.greatest(none, queue), total)
    work = total - queue
    fetch, render = F.greatest(none, fetch), F.greatest(none, render)
    seen = fetch + render
    scale = F.when((seen > work) & (seen > 0), work / seen).otherwise(1.0)
    rest = F.when(seen > work, none).otherwise(work - seen)
    parts = {"queue": queue, "fetch": fetch * scale, "render": render * scale, "extraction": rest, "total": total}
    return F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), F.round(v, 3))])


def full_text(source: Column, path: Column, words: Column, abstract_words: Column, sections: Column) -> Column:
    """Whether a scholarly page holds the paper itself, not only its landing page."""
    return (
        F.when((source == "pubmed") | ((source == "arxiv") & F.contains(path, F.lit("/abs/"))), False)
        .when(source == "pmc", words >= 200)
        .when(source.isNull() & (words >= F.greatest(F.lit(300), abstract_words * 2)), True)
        .otherwise((words >= 1000) | ((words >= 400) & (sections >= 2)))
    )


def request_error(urls: Column, formats: Column, max_pages: Column, max_depth: Column, schema_json: Column, schema_depth: Column) -> Column:
    """The first bound that a request breaks; null for a sound one."""
    pages = F.when(max_depth > 0, max_pages).otherwise(F.size(urls))
    return (
        F.when(~F.size(urls).between(1, 50), "urls")
        .when(~F.size(formats).between(1, 4), "formats")
        .when(F.size(F.array_distinct(formats)) < F.size(formats), "formats must not contain duplicates")
        .when((max_depth > 0) & (max_pages < F.size(urls)), "max_pages must be greater than or equal to the number of seed URLs")
        .when(F.array_contains(formats, "html") & (pages > 5), "html output is limited to 5 URLs per request")
        .when(F.octet_length(schema_json) > 100_000, "json_schema exceeds the 100000-byte limit")
        .when(schema_depth > 20, "json_schema exceeds the maximum depth of 20")
    )


def decided(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """``rows`` with allowed and reason from ``decisions`` (key, allowed, reason); a missing decision denies."""
    j = rows.join(decisions.select(key, F.col("allowed").alias("__a"), F.col("reason").alias("__r")), key, "left")
    return j.select(*rows.columns, F.coalesce("__a", F.lit(False)).alias("allowed"), F.when(F.col("__a").isNull(), "document_policy_failed").when(~F.col("__a"), F.col("__r")).alias("reason"))
