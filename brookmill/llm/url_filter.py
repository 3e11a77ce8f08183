"""URL filtering by a character language-model ratio (native: DataFrame functions only).

Rules on host suffix and path prefix label URLs as accepted or rejected. Two smoothed variable-order Markov models
over URL characters, one per label, are counted over all labelled URLs but a held-out share: the probability of a
character after a context of up to ORDER characters backs off from longer to shorter contexts by Witten-Bell weights, so
each context reaches as far as its counts support. A URL's score is the difference of the two log-likelihoods over its
length; all that follows ``://`` is scored. The threshold is calibrated on the held-out labelled URLs: of a fixed grid of
cuts, the one with the best balanced accuracy.

The models are a table with a row per context and gram that occurs, over all characters: it grows with the URLs and is
joined, never gathered. Every distinct gram of the input gets its log ratio there once; a URL's score is the sum over its
grams. Grams with a share of at least 1/HEAVY of all places are joined by broadcast (HEAVY of them at most), so that
a common host makes no hot task; the others by an ordinary join, or by broadcast too where they are counted to be few.
Counts are combined before the shuffle.

Defined cases: a null URL, or one without ``://``, has an empty host and path, matches no rule and scores 0; an empty
path is kept empty; without any labelled URL every score is 0; without held-out ones the cut is 0; repeated rows are
judged alike and all count in training; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookmill.llm._common import IDS_MOST, Scratch, hash32, small_or_plain

#: (host suffix, path prefix, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Characters of the longest context.
ORDER = 4
#: Stands before a URL's first character.
START = "\x02"
#: The probability from which the shortest context backs off is one over this.
LETTERS = 256
#: One labelled URL in so many, by hash, is held out for the calibration.
HELD_OUT = 5
HEAVY = 5000
#: The grid of cuts: multiples of 1/CUTS_PER_UNIT from -CUT_RANGE to CUT_RANGE, in nats a character.
CUTS_PER_UNIT, CUT_RANGE = 100, 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path_rest(url: Column) -> tuple[Column, Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; path: then up to ``?`` or ``#``; and what follows the host."""
    rest = F.when(F.contains(url, F.lit("://")), F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = lambda text: F.substring(text, F.length(host) + 1, F.lit(2**31 - 1))
    path = after(F.regexp_extract(rest, r"(?s)^[^/?#]*[^?#]*", 0))
    return F.translate(host, UPPER, LOWER), path, after(rest)


def longest_rule(host: Column, path: Column) -> Column:
    """The longest fitting rule as struct(rule, verdict); null where none fits. Equally long ones: the first listed."""
    ranked = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for suffix, prefix, verdict in reversed(ranked):
        fits = ((host == suffix) | F.endswith(host, F.lit("." + suffix))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, F.struct(F.lit(suffix + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams_of(text: Column) -> Column:
    """An array with each character of the text and the ORDER before it."""
    padded = F.concat(F.lit(START * ORDER), text)
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substr(padded, i, F.lit(ORDER + 1)))


def model_tables(urls: DataFrame) -> tuple[Scratch, Scratch]:
    """For ``urls`` (text, label: 1 accepted, 0 rejected, null not counted): distinct grams (gram, n, n1, n0), and what is known of
    each string that occurs in the labelled ones as a gram (c1, c0) or as a context (total1, kinds1, total0, kinds0)."""
    is_ = lambda v: F.sum(F.when(F.col("label") == v, 1).otherwise(0))
    grams = urls.select("label", F.explode(grams_of(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"), is_(1).alias("n1"), is_(0).alias("n0"))
    grams = Scratch(grams, "url-grams")
    counted = grams.df.where("n1 + n0 > 0").select(F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))).alias("k"), "gram", "n1", "n0")
    shorter = counted.select(F.expr("right(gram, k)").alias("s"), "n1", "n0").groupBy("s").agg(F.sum("n1").alias("c1"), F.sum("n0").alias("c0"))
    shorter = Scratch(shorter, "url-shorter")
    none = F.lit(0).cast("bigint")
    as_gram = shorter.df.select("s", "c1", "c0", *[none.alias(c) for c in ("total1", "kinds1", "total0", "kinds0")])
    seen = lambda v: F.when(F.col(f"c{v}") > 0, 1).otherwise(0).cast("bigint")
    as_context = shorter.df.select(F.expr("left(s, length(s) - 1)").alias("s"), none.alias("c1"), none.alias("c0"), F.col("c1").alias("total1"), seen(1).alias("kinds1"), F.col("c0").alias("total0"), seen(0).alias("kinds0"))
    stats = as_gram.unionByName(as_context).groupBy("s").agg(*[F.sum(c).alias(c) for c in as_gram.columns[1:]])
    return grams, Scratch(stats, "url-stats")


def log_ratios(grams: DataFrame, stats: Scratch) -> DataFrame:
    """(gram, n, r): the log of P(last character | those before it, accepted) over the same under rejected, as decimal.

    Witten-Bell: p_k = (count + kinds * p_(k-1)) / (total + kinds), from p_(-1) = 1 / LETTERS.
    """
    orders = grams.select("gram", "n", F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))).alias("k"))
    facts = small_or_plain(stats, IDS_MOST)
    looked = orders.select("gram", "n", "k", F.explode(F.array(F.expr("right(gram, k)"), F.expr("left(right(gram, k), k - 1)"))).alias("s"))
    found = looked.join(facts, "s", "left")
    of = lambda c, own: F.coalesce(F.max(F.when((F.length("s") == F.col("k")) == own, F.col(c))), F.lit(0)).alias(c)
    per = found.groupBy("gram", "n", "k").agg(*[of(f"c{v}", True) for v in (1, 0)], *[of(f"{c}{v}", False) for v in (1, 0) for c in ("total", "kinds")])
    per = per.groupBy("gram", "n").agg(F.sort_array(F.collect_list(F.struct("k", "c1", "total1", "kinds1", "c0", "total0", "kinds0"))).alias("o"))
    p = lambda v: F.aggregate("o", F.lit(1.0 / LETTERS), lambda q, x: F.when(x[f"total{v}"] > 0, (x[f"c{v}"] + x[f"kinds{v}"] * q) / (x[f"total{v}"] + x[f"kinds{v}"])).otherwise(q))
    return per.select("gram", "n", F.round(F.log(p(1)) - F.log(p(0)), 9).cast("decimal(18,9)").alias("r"))


def mean_ratios(urls: DataFrame, ratios: Scratch) -> DataFrame:
    """(rid, score): the mean log ratio over the grams of each row of ``urls`` (rid, text)."""
    places = ratios.df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()["all"]
    least = max(1, -(-places // HEAVY))
    heavy, rest = (ratios.df.where(F.col("n") >= least), ratios.df.where(F.col("n") < least))
    rest = small_or_plain(Scratch(rest.select("gram", "r"), "url-rest"), IDS_MOST)
    each = urls.select("rid", F.explode(grams_of(F.col("text"))).alias("gram"))
    first = each.join(F.broadcast(heavy.select("gram", "r")), "gram", "left")
    # Sums of a row's common grams leave the task as one row.
    common = first.where("r IS NOT NULL").groupBy("rid").agg(F.sum("r").alias("r"), F.count(F.lit(1)).alias("k"))
    rare = first.where("r IS NULL").select("rid", "gram").join(rest, "gram").groupBy("rid").agg(F.sum("r").alias("r"), F.count(F.lit(1)).alias("k"))
    both = common.unionByName(rare).groupBy("rid").agg(F.sum("r").alias("r"), F.sum("k").alias("k"))
    return both.select("rid", F.round(F.col("r").cast("double") / F.col("k"), 9).alias("score"))


def score_urls(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (nats a character), method_verdict."""
    host, path, rest = (F.coalesce(c, F.lit("")) for c in host_path_rest(F.col("url")))
    t = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"), F.concat(host, rest).alias("text"))
    t = t.withColumns({"r": longest_rule(F.col("host"), F.col("path")), "held": hash32(F.col("text"), seed="url-fold") % HELD_OUT == 0, "rid": F.monotonically_increasing_id()})
    t = Scratch(t, "url-texts").df
    label = F.when(F.col("r").isNotNull() & ~F.col("held"), (F.col("r.verdict") == "allow").cast("int"))
    grams, stats = model_tables(t.select("text", label.alias("label")))
    ratios = Scratch(log_ratios(grams.df, stats), "url-ratios")
    scored = t.join(mean_ratios(t, ratios), "rid", "left").select("page_id", "host", "path", "r", "held", F.coalesce("score", F.lit(0.0)).alias("score"))
    scored = Scratch(scored, "url-scores").df
    cut = calibrate(scored.where("held"))
    judged = scored.withColumn("cut", F.coalesce(cut.scalar(), F.lit(0.0)))
    method = F.when(F.col("score") >= F.col("cut"), "allow").otherwise("block")
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), method).alias("verdict"), "score", method.alias("method_verdict"))


def calibrate(scored: DataFrame) -> DataFrame:
    """One row with the cut of best balanced accuracy on the labelled URLs; of equals the one nearest 0, then the smaller. No row without labels."""
    top = CUT_RANGE * CUTS_PER_UNIT
    step = F.greatest(F.lit(-top), F.least(F.lit(top), F.floor(F.col("score") * CUTS_PER_UNIT))).cast("int")
    is_allow = F.col("r.verdict") == "allow"
    hist = scored.where("r IS NOT NULL").groupBy(step.alias("step")).agg(F.sum(F.when(is_allow, 1).otherwise(0)).alias("good"), F.sum(F.when(is_allow, 0).otherwise(1)).alias("bad"))
    steps = scored.sparkSession.range(-top, top + 1).select(F.col("id").cast("int").alias("step"))
    h = steps.join(F.broadcast(hist), "step", "left").fillna(0, ["good", "bad"])
    w, every = Window.orderBy("step"), Window.partitionBy()
    h = h.select("step", F.sum("good").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("kept_good"), F.coalesce(F.sum("bad").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cut_bad"), F.sum("good").over(every).alias("good"), F.sum("bad").over(every).alias("bad"))
    gain = F.col("kept_good") / F.greatest(F.col("good"), F.lit(1)) + F.col("cut_bad") / F.greatest(F.col("bad"), F.lit(1))
    best = h.where("good + bad > 0").agg(F.max(F.struct(F.round(gain, 9).alias("g"), (-F.abs("step")).alias("a"), (-F.col("step")).alias("s"))).alias("b"))
    return best.select((-F.col("b.s") / F.lit(float(CUTS_PER_UNIT))).alias("cut"))
