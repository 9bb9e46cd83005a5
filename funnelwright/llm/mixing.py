"""Temperature mixing of sources: exponentiated shares, realised as budgeted block permutations.

A source with share p of the tokens gets weight p^a / sum of p^a. The exponent is found by bisection
in [0, 1], several points at a time: the largest exponent that reaches the target entropy, raised if
a source would be repeated more often than the limit. Each probe is one aggregation over the table
of sources, so any number of sources will do.

A source's budget is its weight times the total budget. It is met by whole epochs and a part of
one more. Documents are dealt to blocks by hash; an epoch permutes the blocks of its source, and the
documents in each block, by keyed hashes. In the partial epoch blocks are taken in order while the
budget lasts, and the block at its edge document by document, so only block totals are ever summed
along a source and no window holds more than one block of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelwright.llm.common import cut_lineage, fresh, row_hash

WORD = r"[^\x20\x09-\x0D]+"
BLOCK, SEED, REPEATS = 256, "mix", 4.0
#: Points of the exponent that one aggregation tries, and how often; the result is rounded.
POINTS, ROUNDS, DECIMALS = 15, 8, 4


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """(row, key, source, n_tokens); null sources are the source ''. Equal rows share ``row``."""
    return docs.select(
        row_hash(key).alias("row"),
        F.col(key),
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )


def _bisected(shares: DataFrame, holds) -> float:
    """Largest exponent in [0, 1] at which ``holds`` does: it does from 0 up to some exponent."""
    low, high = 0.0, 1.0
    if shares.agg(holds(1.0)).first()[0]:
        return 1.0
    for _ in range(ROUNDS):
        step = (high - low) / (POINTS + 1)
        tried = [low + step * (i + 1) for i in range(POINTS)]
        good = shares.agg(*(holds(a).alias(f"p{i}") for i, a in enumerate(tried))).first()
        reached = sum(1 for x in good if x)
        low, high = low + step * reached, low + step * (reached + 1)
    return low


def entropy(a: float) -> Column:
    """Entropy of the weights at exponent ``a``, from shares p."""
    z = F.sum(F.pow("p", F.lit(a)))
    return F.log(z) - a * F.sum(F.pow("p", F.lit(a)) * F.log("p")) / z


def exponent(totals: DataFrame, target: float | None = None, repeats: float = REPEATS) -> float:
    """The exponent for totals (source, tokens > 0) and a budget of all tokens.

    ``target`` is an entropy in nats; by default halfway from the sources' own to the uniform one.
    The least repeated exponent wins where both can't be met; 1 without sources.
    """
    total = totals.agg(F.sum("tokens"), F.count("*")).first()
    if not total[1]:
        return 1.0
    shares = totals.select((F.col("tokens") / F.lit(total[0])).alias("p"))
    if target is None:
        target = 0.5 * (shares.agg(entropy(1.0)).first()[0] + shares.agg(entropy(0.0)).first()[0])
    spread = _bisected(shares, lambda a: entropy(a) >= target)

    def over(a: float) -> Column:
        # Times that the most repeated source is seen; it falls as the exponent grows.
        return F.max(F.pow("p", F.lit(a - 1.0))) / F.sum(F.pow("p", F.lit(a))) > repeats

    return round(max(spread, _bisected(shares, over) if shares.agg(over(0.0)).first()[0] else 0.0), DECIMALS)


def _key(*parts: str | Column) -> Column:
    return F.md5(F.concat_ws("|", *(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in parts)).cast("binary"))


def schedule(docs: DataFrame, target: float | None = None, repeats: float = REPEATS, key: str = "doc_id", source: str = "source") -> DataFrame:
    """(row, key, source, n_tokens, weight, epoch, block_rank, doc_rank): the mix, a row for each use.

    Ordering a source's rows by (epoch, block_rank, doc_rank) is its permutation. A document of the
    last epoch is used while the tokens before it are below the budget. Sources without tokens, and
    null or empty texts of others in a partial epoch beyond the budget, are left out; null ids are
    one id; repeated rows are separate documents of equal rank keys.
    """
    rows = cut_lineage(sized(docs, key, source))
    totals = cut_lineage(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).where("tokens > 0"))
    a = exponent(totals, target, repeats)
    sums = totals.agg(F.sum("tokens"), F.sum(F.pow("tokens", F.lit(a)))).first()
    budget, z = (sums[0] or 0), (sums[1] or 1.0)
    plan = totals.select(
        "source",
        F.round(F.pow("tokens", F.lit(a)) / z, 9).alias("weight"),
        "tokens",
        F.ceil(F.col("docs") / BLOCK).cast("long").alias("blocks"),
    ).withColumn("wanted", F.round(F.col("weight") * budget).cast("long"))
    plan = plan.select("source", "weight", "blocks", F.floor(F.col("wanted") / F.col("tokens")).alias("whole"), (F.col("wanted") % F.col("tokens")).alias("rest"))
    plan = cut_lineage(plan)
    number = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    dealt = rows.join(plan, "source").withColumn("block", number % F.col("blocks"))
    # Block totals: a row for each block of a source.
    blocks = cut_lineage(dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")))
    used = blocks.join(plan, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
    used = used.withColumn("order", _key(F.lit(SEED), F.col("epoch").cast("string"), "source", F.col("block").cast("string")))
    along = Window.partitionBy("source", "epoch").orderBy("order", "block")
    used = used.select(
        "source", "block", "epoch", "weight", "whole", "rest", "tokens",
        F.row_number().over(along).alias("block_rank"),
        (F.sum("tokens").over(along) - F.col("tokens")).alias("before"),
    )
    partial = F.col("epoch") == F.col("whole")
    used = used.where(~partial | (F.col("before") < F.col("rest")))
    uses = rows.join(plan.select("source", "blocks"), "source").withColumn("block", number % F.col("blocks")).join(
        used.drop("tokens"), ["source", "block"]
    )
    inside = Window.partitionBy("source", "epoch", "block").orderBy("doc_order", "n_tokens")
    uses = uses.withColumn("doc_order", _key(F.lit(SEED), F.col("epoch").cast("string"), F.col(key).cast("string")))
    uses = uses.withColumn("doc_rank", F.row_number().over(inside)).withColumn(
        "doc_before", F.col("before") + F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    )
    uses = uses.where((F.col("epoch") < F.col("whole")) | (F.col("doc_before") < F.col("rest")))
    return uses.select("row", key, "source", "n_tokens", "weight", "epoch", "block_rank", "doc_rank")


def mixed(docs: DataFrame, plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents of a schedule, once for each use, with weight, epoch, block_rank and doc_rank.

    These replace columns of the same name.
    """
    order = ["weight", "epoch", "block_rank", "doc_rank"]
    row = fresh(docs, "row")
    # Equal rows are listed each in the schedule; one of them stands for all.
    texts = docs.withColumn(row, row_hash(key)).drop(*order).dropDuplicates([row])
    uses = plan.select(F.col("row").alias(row), *order)
    return texts.join(uses, row).select(*(c for c in docs.columns if c not in order), *order)
