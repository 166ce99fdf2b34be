"""Quality rules with risk-controlled cut-offs, in DataFrame functions only.

Every rule rejects a document whose badness score exceeds a cut-off. The cut-offs of all rules stand on one scale of
strictness, fixed ahead (``CUTOFFS``). Per stratum (language), going from the mildest step to the strictest, a step is
accepted as long as the exact binomial test rejects, at level ``delta / strata``, that its rules together lose a share of
``alpha`` or more of the stratum's good documents, counted on the labelled ones; the walk ends at the first step that is
not accepted. A walk in a fixed order needs no correction for its length, each step is one hypothesis about all rules, and
Bonferroni's correction covers the strata, so with probability 1 - ``delta`` no stratum loses ``alpha`` of its good
documents or more. A stratum with too few labels to prove a step keeps everything that the base rules keep; without a loss
86 labelled good documents prove one at the default levels and four strata.

Defined cases: a null or blank text has no words and fails the base rules; a null language is the stratum ``und``; a
null label, and a document labelled both ways, is not good; a labelled doc_id is one trial however often it repeats, in
the first of its rows' strata and with the worst of their scores; ties of a score with a cut-off are kept; texts of any
length are counted whole, inside their row; an empty table of documents or labels is allowed (no labels: base rules only);
other columns are kept apart, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import joined_small, save

ALPHA, DELTA = 0.05, 0.05
#: Strata whose cut-offs are sent to all tasks at most; with more they are joined by a shuffle.
MOST_STRATA = 4096
MIN_WORDS, MAX_REPEAT = 50, 0.5
#: Cut-offs of each rule, step by step from mild to strict.
CUTOFFS = {
    "symbols": (0.60, 0.45, 0.30, 0.20, 0.15, 0.12, 0.10, 0.08),
    "dup_lines": (0.90, 0.80, 0.70, 0.60, 0.50, 0.45, 0.40, 0.35),
    "repeats": (0.48, 0.45, 0.42, 0.40, 0.38, 0.35, 0.32, 0.30),
    "capitals": (0.95, 0.90, 0.80, 0.70, 0.60, 0.50, 0.45, 0.40),
    "shouts": (0.90, 0.80, 0.70, 0.60, 0.50, 0.45, 0.40, 0.30),
}
_SPACE = "\\x20\\x09-\\x0D"
_BLANKS = " \t\n\x0b\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts")


def base_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the columns ``COUNTS``. Everything is computed inside the row. Three-word windows are found again by a hash,
    and told apart by their words. Save the result before filtering on it: a filter moved below would count anew."""
    df = df.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn("__w", F.expr(rf"filter(split(__t, r'[{_SPACE}]+'), w -> w != '')"))
    df = df.withColumn("__l", F.expr(rf"filter(split(__t, r'\n'), l -> l rlike r'[^{_SPACE}]')"))
    df = df.withColumn("__h", F.expr("case when size(__w) < 3 then array() else transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])) end"))
    # windows found again: their positions, in order; each adds the words that the one before did not reach
    window = "struct(h as h, __w[i] as a, __w[i + 1] as b, __w[i + 2] as c)"
    df = df.withColumn("__s", F.expr(f"case when size(array_distinct(__h)) < size(__h) then sort_array(transform(__h, (h, i) -> struct({window} as g, i as i))) end"))
    again = "sort_array(transform(filter(__s, (x, j) -> (j > 0 and __s[greatest(j - 1, 0)].g = x.g) or (j + 1 < size(__s) and __s[least(j + 1, size(__s) - 1)].g = x.g)), x -> x.i))"
    repeats = f"case when __s is null then 0 else aggregate({again}, struct(-3 as last, 0 as n), (a, i) -> struct(i as last, a.n + least(3, i - a.last) as n), a -> a.n) end"
    without = lambda chars: F.length("__t") - F.length(F.translate("__t", chars, ""))
    counts = {
        "n_words": F.size("__w"),
        "word_chars": F.length(F.translate("__t", _BLANKS, "")),
        "n_symbols": without("#*$%&|<>"),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": F.expr(repeats),
        "n_lines": F.size("__l"),
        "n_capitals": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_shouts": without("!"),
    }
    return df.withColumns({name: c.cast("long") for name, c in counts.items()}).drop("__t", "__w", "__l", "__h", "__s")


def scores() -> dict[str, Column]:
    """The rules' badness scores over the counts."""
    per = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b).cast("double"), F.lit(1.0))
    return {"symbols": per("n_symbols", "word_chars"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "capitals": per("n_capitals", "word_chars"), "shouts": per("n_shouts", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT) * F.col("n_words"))


def stratum(col: str = "lang") -> Column:
    return F.coalesce(F.col(col), F.lit("und"))


def binomial_tail(k: str, n: str, p: float) -> str:
    """SQL for P(X <= k) of X ~ Binomial(n, p), summed term by term; 1 where k exceeds the mean."""
    step = f"ln((({n}) - i + 1) / cast(i as double)) + ln({p!r}d / (1 - {p!r}d))"
    first = f"({n}) * ln(1 - {p!r}d)"
    more = f"aggregate(sequence(1, {k}), struct({first} as t, exp({first}) as s), (a, i) -> struct(a.t + {step} as t, a.s + exp(a.t + {step}) as s), a -> a.s)"
    return f"case when {k} > ({n}) * {p!r}d then 1d when {k} = 0 then exp({first}) else {more} end"


def choose_cutoffs(scored: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, cutoffs: dict = CUTOFFS) -> DataFrame:
    """``stratum, rule, cutoff`` of the strictest accepted step. ``scored`` has ``doc_id, stratum, base_failed`` and a
    column per rule; ``labels`` has ``doc_id, quality``; all rules have as many cut-offs."""
    steps = len(next(iter(cutoffs.values())))
    good = labels.groupBy("doc_id").agg((F.min(F.coalesce("quality", F.lit(0))) == 1).alias("good")).where("good and doc_id is not null").select("doc_id")
    worst = scored.where(~F.col("base_failed") & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("stratum").alias("stratum"), *[F.max(rule).alias(rule) for rule in cutoffs])
    lost = [F.count_if(reduce(lambda a, b: a | b, [F.col(rule) > cuts[i] for rule, cuts in cutoffs.items()])).alias(f"lost_{i}") for i in range(steps)]
    counts = worst.join(good, "doc_id").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *lost)
    grid = counts.select("stratum", "n", F.expr(f"stack({steps}, {', '.join(f'{i}, lost_{i}' for i in range(steps))}) as (step, k)"))
    strata = counts.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("strata"))
    tested = grid.withColumn("p", F.expr(binomial_tail("k", "n", alpha))).crossJoin(F.broadcast(strata))
    refused = F.min(F.when(F.col("p") > delta / F.col("strata"), F.col("step")))
    walk = tested.groupBy("stratum").agg((F.coalesce(refused, F.lit(steps)) - 1).alias("step")).where("step >= 0")
    lists = ", ".join(f"'{rule}', array({', '.join(f'{c!r}d' for c in cuts)})[step]" for rule, cuts in cutoffs.items())
    return walk.select("stratum", F.expr(f"stack({len(cutoffs)}, {lists}) as (rule, cutoff)"))


def scored_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``doc_id, stratum``, base counts, ``base_failed`` and the scores: one narrow row per document."""
    df = base_counts(docs.select(F.col(id_col).alias("doc_id"), stratum(stratum_col).alias("stratum"), F.col(text_col).alias("text")))
    return df.select("doc_id", "stratum", *COUNTS, base_failed().alias("base_failed"), *[c.alias(rule) for rule, c in scores().items()])


def wide_cutoffs(chosen: DataFrame, cutoffs: dict = CUTOFFS) -> DataFrame:
    """One row per stratum with its cut-offs in the columns ``__cut_<rule>``."""
    return chosen.groupBy(F.col("stratum").alias("__stratum")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__cut_{r}") for r in cutoffs])


def verdict(cutoffs: dict = CUTOFFS) -> Column:
    """The name of the first rule that rejects, null where none does; over rule columns and ``__cut_`` columns."""
    return F.coalesce(*[F.when(F.col(r) > F.col(f"__cut_{r}"), r) for r in cutoffs])


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per document: base counts, ``base_failed``, the rule that rejects it (``rejected_by``) and ``kept``.

    Scores are computed once and written as a narrow table; labels meet them there, not the texts."""
    scored = save(scored_docs(docs), "quality-scores")
    cuts = save(wide_cutoffs(choose_cutoffs(scored, labels.select("doc_id", "quality"), alpha, delta)), "quality-cutoffs")
    out = joined_small(scored, cuts, scored["stratum"] == cuts["__stratum"], "left", MOST_STRATA)
    out = out.withColumn("rejected_by", F.when(~F.col("base_failed"), verdict()))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"), "rejected_by", "stratum")


def filter_documents(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``. Documents are written once
    beside their scores, so that they are counted once and never shuffled."""
    inner = base_counts(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__d")).withColumn("__text", F.col("__d.text")), "__text")
    scored = inner.select("__d", stratum("__d.lang").alias("stratum"), base_failed().alias("base_failed"), *[c.alias(r) for r, c in scores().items()])
    scored = save(scored, "quality-scored")
    narrow = scored.select(F.col("__d.doc_id").alias("doc_id"), "stratum", "base_failed", *CUTOFFS)
    cuts = save(wide_cutoffs(choose_cutoffs(narrow, labels.select("doc_id", "quality"), alpha, delta)), "quality-cutoffs")
    out = joined_small(scored, cuts, scored["stratum"] == cuts["__stratum"], "left", MOST_STRATA)
    return out.where(~F.col("base_failed") & verdict().isNull()).select("__d.*")
