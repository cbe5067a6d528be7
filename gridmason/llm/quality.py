"""Quality rules whose cutoffs carry a guarantee against false rejection. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bind, cut, stored, table

SYMBOLS = "#*$%&|<>"
#: Each rule is a share of 0 to 1, higher for worse texts, held in BINS steps.
RULES = ("symbols", "dup_lines", "repeats", "capitals", "marks", "long_words")
BINS = 200
#: In a stratum, rules may reject this share of good texts together; all bounds hold at once with confidence 1 - DELTA.
ALPHA = 0.03
DELTA = 0.05
#: Among the cutoffs that are safe, a good text rejected counts as much as this many bad texts.
PRICE = 5.0


def _removed(text: Column, pattern: str) -> Column:
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeat_words(words: Column) -> Column:
    """Words that stand in a run of five words found twice or more in the text. Runs compare by 64-bit hashes."""

    def of_hashes(h: Column) -> Column:
        n = F.size(h)
        at = lambda i, k: F.get(h, i + k)
        grams = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[at(i, k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>"))
        return bind(grams, of_grams)

    def of_grams(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(bind(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), of_sorted))

    def of_sorted(s: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(s, j)["x"] == e["x"], F.lit(False))
        twice = F.filter(s, lambda e, j: F.when(j > 0, same(e, j - 1)).otherwise(F.lit(False)) | same(e, j + 1))
        return bind(F.sort_array(F.transform(twice, lambda e: e["i"])), covered)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1) - x, F.lit(5))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return bind(F.transform(words, lambda w: F.xxhash64(w)), of_hashes).cast("long")


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The columns to keep, counts of each text, base_failed, and bin_<rule> for each rule. A null text is an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, text.alias("__text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("__words"))
    t = F.col("__text")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    rows = rows.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        _removed(t, r"[#*$%&|<>]+").alias("n_symbols"),
        bind(lines, lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("__lines"),
        repeat_words(F.col("__words")).alias("n_repeat_words"),
        _removed(t, r"\p{Lu}+").alias("__capitals"),
        _removed(t, r"[!?]+").alias("__marks"),
        F.size(F.filter("__words", lambda w: F.char_length(w) > 30)).alias("__long"),
    )
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    shares = {
        "symbols": F.col("n_symbols") / chars,
        "dup_lines": F.col("__lines.dup") / F.greatest("__lines.all", F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "capitals": F.col("__capitals") / chars,
        "marks": F.col("__marks") / chars,
        "long_words": F.col("__long") / words,
    }
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select(
        *keep, "n_words", "word_chars", "n_symbols", F.col("__lines.dup").cast("long").alias("n_dup_lines"), "n_repeat_words", failed.alias("base_failed"),
        *[F.least(F.floor(shares[r] * BINS), F.lit(BINS)).cast("int").alias(f"bin_{r}") for r in RULES],
    )


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 17, less the factors in between."""
    z = n.cast("double") + 17
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    for k in range(1, 17):
        series = series - F.log(n.cast("double") + k)
    return series


def binomial_cdf(x: Column, n: Column, p: float) -> Column:
    """P(X <= x) for X binomial of n and p, to double precision, for x up to n * p; 1 beyond."""
    top = log_factorial(n) - log_factorial(x) - log_factorial(n - x) + x * math.log(p) + (n - x) * math.log1p(-p)
    steps = F.least(x, F.ceil(12 * F.sqrt(n * p)) + 60)
    ratio = lambda i: i / (n - i + 1) * ((1 - p) / p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * ratio(x - k)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.when(steps > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), steps.cast("long") - 1), start, add)["sum"]).otherwise(F.lit(1.0))
    return F.when(x > n * p, F.lit(1.0)).otherwise(F.exp(top) * total)


def cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row for each stratum: lang, cut_<rule> of each rule (a text whose bin is above it is rejected).

    labelled: lang, quality, bin_<rule>. A cutoff is safe if the exact binomial test rejects, at level delta / (strata * rules),
    that the rule rejects alpha / rules or more of the good texts. Cutoffs are tried from the mildest on and stop at the first that isn't
    safe, which needs no further correction. Of the safe ones, that which rejects most bad texts, PRICE times the good ones deducted,
    is taken; the mildest, if several. Strata with too few labels reject nothing.
    """
    good = (F.col("quality") == 1).cast("long")
    binned = labelled.select("lang", good.alias("good"), F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"bin_{r}").alias("bin")) for r in RULES])).alias("e"))
    counts = binned.groupBy("lang", "e.rule", "e.bin").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    cell = Window.partitionBy("lang", "rule")
    above = cell.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    strata = counts.select("lang").distinct().agg(F.count(F.lit(1)).alias("strata"))
    counts = counts.crossJoin(strata)
    zero = F.lit(0).cast("long")
    counts = counts.select(
        "lang", "rule", "bin", "strata",
        F.coalesce(F.sum("good").over(above), zero).alias("x"), F.sum("good").over(cell).alias("n"),
        F.coalesce(F.sum("bad").over(above), zero).alias("caught"), F.sum("bad").over(cell).alias("n_bad"),
    )
    level = delta / len(RULES) / F.col("strata")
    counts = counts.withColumn("safe", (F.col("n") > 0) & (binomial_cdf(F.col("x"), F.col("n"), alpha / len(RULES)) <= level))
    milder = cell.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("safe", F.min("safe").over(milder))
    gain = F.col("caught") / F.greatest("n_bad", F.lit(1)) - PRICE * F.col("x") / F.greatest("n", F.lit(1))
    best = counts.where(F.col("safe") & (gain > 0)).groupBy("lang", "rule").agg(F.max_by("bin", F.struct(F.round(gain, 9), F.col("bin"))).alias("cut"))
    return best.groupBy("lang").agg(*[F.coalesce(F.max(F.when(F.col("rule") == r, F.col("cut"))), F.lit(BINS)).alias(f"cut_{r}") for r in RULES])


def label_of(labels: DataFrame) -> DataFrame:
    """One quality for each labelled doc_id: the worst where there are several; null labels and ids don't count."""
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("labelled_id")).agg(F.min("quality").alias("quality"))


def fit(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """Cutoffs from the labelled texts that the base rules keep: a row for each stratum, written as a table, so that the planner knows how small it is."""
    held = feats.where("not base_failed").join(label_of(labels), F.col("doc_id") == F.col("labelled_id"))
    return stored(cutoffs(held))


def with_verdict(feats: DataFrame, cuts: DataFrame) -> DataFrame:
    """feats with kept: false if the base rules fail, or a rule's bin is above its stratum's cutoff."""
    joined = feats.join(cuts.withColumnRenamed("lang", "of_lang"), F.col("lang").eqNullSafe(F.col("of_lang")), "left")
    bad = F.lit(False)
    for r in RULES:
        bad = bad | F.coalesce(F.col(f"bin_{r}") > F.col(f"cut_{r}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~bad).drop("of_lang", *[f"cut_{r}" for r in RULES])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The features of every document, and kept.

    Strata are the values of lang, null among them. Null and empty texts have no words, so they fail. Repeated rows are judged
    each. Empty tables give empty results; without labels only the base rules reject. Other columns are ignored.
    """
    feats = cut(features(docs))
    return with_verdict(feats, fit(feats, labels))


def op8(spark, sf_dir: str) -> DataFrame:
    """The counts of every row of documents, base_failed and kept, as judge has them: nulls and empty texts fail, repeated rows are judged each, an empty table gives no rows."""
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with cutoffs fitted on the stage's own labelled documents.

    Each text is measured once: rows are written with their features, which the fit and the verdicts read. Null and empty texts go, since they have no words. Repeated rows are judged each, columns of
    any names are kept, an empty table gives an empty one, and without labels only the base rules reject.
    """
    carried = docs.select("doc_id", "lang", "text", F.struct(*docs.columns).alias("__row"))
    scored = stored(features(carried, ("doc_id", "lang", "__row")))
    return with_verdict(scored, fit(scored, table(spark, sf_dir, "labels"))).where("kept").select("__row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, string_split(t, chr(10)) AS lines FROM d),
g AS (SELECT rid, i, array_to_string(words[i:i+4], ' ') AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
g2 AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c >= 2),
rep AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM g2) GROUP BY rid),
ln AS (SELECT rid, len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_all,
         len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dis FROM w),
f AS (SELECT d.rid, doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, n_all - n_dis AS n_dup_lines, n_all, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')) AS caps, length(t) - length(regexp_replace(t, '[!?]+', '', 'g')) AS marks,
        len(list_filter(words, lambda x: length(x) > 30)) AS n_long
      FROM d JOIN w ON d.rid = w.rid JOIN ln ON d.rid = ln.rid LEFT JOIN rep ON d.rid = rep.rid),
b AS (SELECT rid, doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        least(floor(n_symbols / greatest(word_chars, 1) * 200), 200) AS b1, least(floor(n_dup_lines / greatest(n_all, 1) * 200), 200) AS b2,
        least(floor(n_repeat_words / greatest(n_words, 1) * 200), 200) AS b3, least(floor(caps / greatest(word_chars, 1) * 200), 200) AS b4,
        least(floor(marks / greatest(word_chars, 1) * 200), 200) AS b5, least(floor(n_long / greatest(n_words, 1) * 200), 200) AS b6 FROM f),
l AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
e AS (SELECT lang, quality, unnest([{'rule': 1, 'bin': b1}, {'rule': 2, 'bin': b2}, {'rule': 3, 'bin': b3}, {'rule': 4, 'bin': b4}, {'rule': 5, 'bin': b5}, {'rule': 6, 'bin': b6}]) AS s
      FROM b JOIN l ON b.doc_id = l.doc_id WHERE NOT base_failed),
c AS (SELECT lang, s.rule AS rule, s.bin AS bin, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, sum(CASE WHEN quality = 1 THEN 0 ELSE 1 END) AS bad FROM e GROUP BY ALL),
k AS (SELECT lang, rule, bin, coalesce(sum(good) OVER (PARTITION BY lang, rule ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x, sum(good) OVER (PARTITION BY lang, rule) AS n,
        coalesce(sum(bad) OVER (PARTITION BY lang, rule ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caught, sum(bad) OVER (PARTITION BY lang, rule) AS n_bad FROM c),
p AS (SELECT k.*, n > 0 AND x <= n * 0.005 AND list_sum(list_transform(range(0, CAST(x AS BIGINT) + 1),
        lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005) + (n - i) * ln(0.995)))) <= 0.05 / 6 / (SELECT count(*) FROM (SELECT DISTINCT lang FROM c)) AS ok FROM k),
q AS (SELECT *, bool_and(ok) OVER (PARTITION BY lang, rule ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) AS safe, caught / greatest(n_bad, 1) - 5.0 * x / greatest(n, 1) AS gain FROM p),
r AS (SELECT lang, rule, bin AS cut FROM (SELECT *, row_number() OVER (PARTITION BY lang, rule ORDER BY round(gain, 9) DESC, bin DESC) AS rn FROM q WHERE safe AND gain > 0) WHERE rn = 1),
v AS (SELECT DISTINCT b.rid FROM b JOIN r ON b.lang IS NOT DISTINCT FROM r.lang WHERE (CASE rule WHEN 1 THEN b1 WHEN 2 THEN b2 WHEN 3 THEN b3 WHEN 4 THEN b4 WHEN 5 THEN b5 ELSE b6 END) > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM v) AS kept FROM b
"""
