"""Mixing sources to target weights, in DataFrame functions only.

Temperature mixing: a source with share p of all tokens gets a weight proportional to p^a. The exponent a is bisected
until the entropy of the weights meets the target: below 1 it flattens the mix, above 1 it sharpens it. If that mix would
repeat a source more than the limit, a is bisected between there and 1 until it does not. Entropy falls as a grows, and
repetition falls towards a = 1 from either side, so each search has one answer. a = 1, the shares as they are, stands where
no exponent meets the target (equal shares, one source) and where the budget alone breaks the limit.

Bisection runs over t in [0, 1) with a = t / (1 - t). The midpoints of ``HALVINGS`` halvings are all tried in one grouped
job, which finds the interval that as many single steps would, and ``PASSES`` such jobs follow one another.

The weights are realised as budgeted permutations of blocks. Each source is cut into ``blocks`` blocks by a hash of the
document; in every epoch the blocks stand in another order, given by a hash of (source, epoch, block). A source with a
budget of r times its tokens appears in the first floor(r) epochs whole, and in the next with the blocks of its order
whose middle lies before the budget's end, so that a source misses its budget by half a block at most.

Sums are taken per (source, block) before anything else; the only windows run over the fixed number of blocks of one
source. Defined cases: a null source is the source ``""``; a null or blank text has no tokens and counts as one token so
that it can be placed; documents that repeat are placed each; an empty table gives an empty mix; other columns are kept
apart, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import joined_small, save

BLOCKS, MAX_REPEAT, TARGET_EVENNESS, SEED = 512, 4.0, 0.97, 20240229
#: Halvings a job, and jobs; t is exact to 2 ** -(HALVINGS * PASSES).
HALVINGS, PASSES = 7, 3
#: Blocks of all sources that are sent to all tasks at most; with more they are joined by a shuffle.
MOST_BROADCAST = 200_000


def count_tokens(text: str = "text") -> Column:
    """Words of a text, at least 1."""
    return F.greatest(F.size(F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")), " ")), F.lit(1)).cast("long")


def _hash(*cols: Column) -> Column:
    """48 bits of a digest, the same in every SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[c.cast("string") for c in cols])), 1, 12), 16, 10).cast("long")


def _bisect(shares: DataFrame, t_of: str, meets: Column) -> float | None:
    """The least u on the grid of [0, 1] for which the mix at ``t_of`` (SQL over u) meets a condition that, once met, is
    met for every greater u; None if it is not met at any u below 1."""
    low, step, found = 0.0, 1.0, None
    for _ in range(PASSES):
        step /= 1 << HALVINGS
        tried = shares.select("p", "n", F.explode(F.expr(f"transform(sequence(0, {1 << HALVINGS}), i -> {low!r}d + i * {step!r}d)")).alias("u")).withColumn("t", F.expr(t_of)).where("t < 1")
        tried = tried.withColumn("a", F.col("t") / (1 - F.col("t")))
        w = F.pow("p", F.col("a"))
        per = tried.groupBy("u").agg(F.sum(w).alias("z"), F.sum(w * F.col("a") * F.log("p")).alias("s"), F.max(w / F.col("p")).alias("r"), F.max("n").alias("n"))
        first = per.agg(F.min(F.when(meets, F.col("u"))).alias("u")).first()["u"]
        if first is None:
            return found
        found, low = first, max(first - step, 0.0)
    return found


def find_exponent(sizes: DataFrame, budget: float = 1.0, max_repeat: float = MAX_REPEAT, evenness: float = TARGET_EVENNESS) -> float:
    """The exponent whose mix of ``sizes`` (``source, tokens``) has an entropy of ``evenness`` of the greatest possible or,
    where that repeats a source more than ``max_repeat`` times for a budget of ``budget`` times all tokens, the nearest to
    it that does not."""
    head = sizes.agg(F.sum("tokens").alias("all"), F.count(F.lit(1)).alias("n"))
    shares = sizes.crossJoin(F.broadcast(head)).select((F.col("tokens") / F.col("all")).alias("p"), "n")
    entropy = F.log("z") - F.col("s") / F.col("z")
    t = _bisect(shares, "u", entropy <= evenness * F.log(F.greatest("n", F.lit(2)).cast("double")) + 1e-12)
    if t is None:
        return 1.0
    u = _bisect(shares, f"{t!r}d + u * (0.5d - {t!r}d)", budget * F.col("r") / F.col("z") <= max_repeat)
    t = 0.5 if u is None else t + u * (0.5 - t)
    return t / (1 - t)


def plan_blocks(sized: DataFrame, budget: float = 1.0, blocks: int = BLOCKS, seed: int = SEED, max_repeat: float = MAX_REPEAT, evenness: float = TARGET_EVENNESS) -> DataFrame:
    """``source, block, epoch, slot, weight, exponent``: how often and where each block of each source appears.
    ``sized`` has ``source, block, tokens``, a row per document. ``slot`` runs from 0 to 1 through the mix."""
    spread = save(sized.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    sizes = save(spread.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    a = find_exponent(sizes, budget, max_repeat, evenness)
    total = sizes.agg(F.sum("tokens").alias("all"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a))).alias("z"))
    share = F.pow(F.col("tokens").cast("double"), F.lit(a)) / F.col("z")
    quota = sizes.crossJoin(F.broadcast(total)).select("source", F.col("tokens").alias("size"), share.alias("weight"), (share * budget * F.col("all")).alias("quota"))
    placed = spread.join(quota, "source").withColumn("epoch", F.explode(F.expr("sequence(0, cast(ceil(quota / size) as int))")))
    placed = placed.withColumn("__o", _hash(F.lit(seed), F.col("source"), F.col("epoch"), F.col("block")))
    ahead = F.coalesce(F.sum("tokens").over(Window.partitionBy("source", "epoch").orderBy("__o", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = F.col("epoch") * F.col("size") + ahead + F.col("tokens") / 2
    return placed.withColumn("__m", middle).where("__m <= quota").select("source", "block", "epoch", (F.col("__m") / F.col("quota")).alias("slot"), "weight", F.lit(a).alias("exponent"))


def block_of(id_col: Column, blocks: int = BLOCKS, seed: int = SEED) -> Column:
    return F.pmod(_hash(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(blocks)).cast("int")


def mix(docs: DataFrame, budget: float = 1.0, blocks: int = BLOCKS, seed: int = SEED, max_repeat: float = MAX_REPEAT, evenness: float = TARGET_EVENNESS) -> DataFrame:
    """A row for each time a document appears: ``doc_id, source, n_tokens, epoch, block, slot, weight, exponent``."""
    sized = save(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), count_tokens().alias("tokens"), block_of(F.col("doc_id"), blocks, seed).alias("block")), "mix-docs")
    plan = save(plan_blocks(sized, budget, blocks, seed, max_repeat, evenness), "mix-plan")
    out = joined_small(sized, plan, ["source", "block"], "inner", MOST_BROADCAST)
    return out.select("doc_id", "source", F.col("tokens").alias("n_tokens"), "epoch", "block", "slot", "weight", "exponent")


def mix_documents(docs: DataFrame, budget: float = 1.0, blocks: int = BLOCKS, seed: int = SEED, max_repeat: float = MAX_REPEAT, evenness: float = TARGET_EVENNESS) -> DataFrame:
    """The documents as often as the mix has them, with the columns of ``docs``. Texts are joined to the plan of blocks,
    which has a fixed number of rows a source, and not shuffled while that is small."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__d"), F.coalesce("source", F.lit("")).alias("source"), block_of(F.col("doc_id"), blocks, seed).alias("block"))
    plan = save(plan_blocks(keyed.select("source", "block", count_tokens("__d.text").alias("tokens")), budget, blocks, seed, max_repeat, evenness).select("source", "block", "epoch"), "mix-plan")
    return joined_small(keyed, plan, ["source", "block"], "inner", MOST_BROADCAST).select("__d.*")
