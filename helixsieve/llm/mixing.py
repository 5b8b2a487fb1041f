"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a digest and queued, ``cap`` times over. An entry's virtual finish time is the
cumulative words of its source, itself included, divided by the source's weight. All entries are sorted by finish time
in one global order and cut where the words served reach the budget. Words served up to an entry's finish time t are
``t * (weights of sources still queued) + (words of sources that have ended)``: sums along the order of what the
sources' last entries carry. The cut is the time, between two finishes, at which they are the budget: entries that
have finished by then are taken, and of each source the one in service is taken in part. A source that has ended
leaves its share to the others by weight, so each source's words come to its target.

Both orders, that of a source's queue and that of finish times, are range sorts of narrow rows whose sums run by range
and then within; the row's own key is the last sort key, so that ranges split hot sources and repeated rows alike.
Virtual times are integers, in units of one word over the least common multiple of the weights.

Null text and text without words have size 0 and are never taken. Sources are ordered by code point, null last. Of
equal tickets (rows of equal source, doc_id and text) the order is open, and all rows are queued, each on its own.
Texts of any length are one entry a round, counted whole. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helixsieve.llm.common import SPACE, WORD, Scratch, in_order, with_uid

SOURCE = "struct<none:boolean,name:string>"


def cut_time(sources: Sequence[tuple[int, int]], budget: Fraction, cap: int) -> Fraction:
    """The time t at which sum(min(cap * size, weight * t)) over (size, weight) is the budget, or all are served.

    What the cut along the order must come to; tests hold it against this.
    """
    left, weight, t = Fraction(budget), sum(w for s, w in sources if s), Fraction(0)
    for s, w in sorted(((s, w) for s, w in sources if s), key=lambda x: Fraction(x[0], x[1])):
        ends = Fraction(cap * s, w)
        if left <= (ends - t) * weight:
            return t + left / weight
        left, weight, t = left - (ends - t) * weight, weight - w, ends
    return t


def word_count(text: Column) -> Column:
    """Words of a text: runs of characters that are no space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ticket(seed: int, *columns: str) -> Column:
    """A digest of the seed and columns, by which documents are shuffled."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).cast("binary"))


def _running(rows: DataFrame, within: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Add sums that run along an order of ranges, each row's own part included; ``within`` names what they are apart for."""
    parts = rows.groupBy("part", *within).agg(*[F.sum(c).alias(f"{k}_sum") for k, c in sums.items()])
    upto = W.partitionBy(*within).orderBy("part") if within else W.orderBy("part")
    parts = parts.select("part", *within, *[(F.sum(f"{k}_sum").over(upto) - F.col(f"{k}_sum")).alias(f"{k}_before") for k in sums])
    here = W.partitionBy("part", *within).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({k: F.sum(c).over(here) for k, c in sums.items()}).join(parts, ["part", *within])
    return rows.withColumns({k: F.col(k) + F.col(f"{k}_before") for k in sums}).drop(*[f"{k}_before" for k in sums])


def queue(sized: DataFrame, weights: Sequence[int], scratch: Scratch) -> DataFrame:
    """sized (uid, doc_id, source, size, ticket) with upto, its source's words up to it, source_size and weight."""
    sized = sized.withColumn("queue", F.struct(F.col("source").isNull().alias("none"), F.col("source").alias("name")))
    own = in_order(sized, ["queue", "ticket", "uid"], scratch, "queues").drop("rank")
    sources = in_order(own.groupBy("queue").agg(F.sum("size").alias("source_size")), ["queue"], scratch, "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = sources.select("queue", "source_size", weight.cast("long").alias("weight"))
    own = _running(own, ["queue"], ["ticket", "uid"], {"upto": F.col("size")})
    return scratch.save(own.drop("part").join(sources, "queue").drop("queue"), "queued")


def entries(queued: DataFrame, cap: int, unit: int) -> DataFrame:
    """One row a round of each document that has words: before, its source's words until then, and finish."""
    rounds = queued.where("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cap - 1).cast("long"))))
    last = rounds.withColumn("before", F.col("round") * F.col("source_size") + F.col("upto") - F.col("size"))
    return last.withColumn("finish", (F.col("before") + F.col("size")) * F.expr(f"{unit} div weight"))


def cut(served: DataFrame, total: int, share: Fraction, cap: int, unit: int) -> Fraction:
    """The virtual time, in units, at which the words served reach the budget. served is in order of finish times.

    The driver sees one row of sums a range, and one entry.
    """
    ends = F.col("before") + F.col("size") == cap * F.col("source_size")
    served = served.select("part", "finish", "uid", "round", F.when(ends, F.col("weight")).otherwise(0).alias("leaves"), F.when(ends, cap * F.col("source_size")).otherwise(0).alias("ended"))
    parts = served.groupBy("part").agg(F.max("finish").alias("finish"), F.sum("leaves").alias("leaves"), F.sum("ended").alias("ended")).orderBy("part").collect()
    goal, queued = share * total * unit, sum(r["leaves"] for r in parts)
    words = lambda finish, leaves, ended: finish * (queued - leaves) + unit * ended
    leaves = ended = 0
    for r in parts:
        if words(r["finish"], leaves + r["leaves"], ended + r["ended"]) >= goal:
            break
        leaves, ended = leaves + r["leaves"], ended + r["ended"]
    else:  # all that is queued is less than the budget
        return Fraction(max((r["finish"] for r in parts), default=0))
    here = W.partitionBy("part").orderBy("finish", "uid", "round").rowsBetween(W.unboundedPreceding, 0)
    rows = served.where(F.col("part") == r["part"]).withColumns({"gone": F.sum("leaves").over(here) + leaves, "done": F.sum("ended").over(here) + ended})
    have = words(F.col("finish").cast("decimal(38,0)"), F.col("gone"), F.col("done").cast("decimal(38,0)"))
    first = rows.where(have * goal.denominator >= F.lit(str(goal.numerator)).cast("decimal(38,0)")).orderBy("finish", "uid", "round").first()
    rate = queued - first["gone"] + first["leaves"]  # of the sources that were queued until then
    return first["finish"] - (words(Fraction(first["finish"]), first["gone"], first["done"]) - goal) / rate


def schedule(sized: DataFrame, *, weights: Sequence[int] = (3, 1, 2), share: Fraction = Fraction(3, 2), cap: int = 2, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents with source_size, target and taken; and the mix's entries in order, with the words taken of each.

    sized has uid, doc_id, source, size and ticket. The driver sees one row of sums.
    """
    scratch = scratch or Scratch(sized.sparkSession, "mixing")
    unit = lcm(*weights)
    queued = queue(sized, weights, scratch)
    served = in_order(entries(queued, cap, unit).drop("ticket", "source", "upto"), ["finish", "uid", "round"], scratch, "served").drop("rank")
    total = queued.agg(F.sum("size")).first()[0] or 0
    t = cut(served, total, share, cap, unit) / unit
    quota, target = F, F
    for w in sorted(set(weights)):
        quota = quota.when(F.col("weight") == w, F.lit(w * t.numerator // t.denominator).cast("long"))
        target = target.when(F.col("weight") == w, F.lit(float(w * t)))
    taken = F.least("size", F.greatest(F.lit(0).cast("long"), quota - F.col("before")))
    taken_of = served.withColumn("part", taken).where("part > 0").select("uid", "round", "finish", "part")
    # A document's own entries by the same rule, so that it needs no join with them.
    rounds = sum((F.least("size", F.greatest(F.lit(0).cast("long"), quota - (F.lit(k) * F.col("source_size") + F.col("upto") - F.col("size")))) for k in range(cap)), F.lit(0).cast("long"))
    docs = queued.withColumn("target", F.least(target, (cap * F.col("source_size")).cast("double"))).withColumn("taken", rounds)
    return docs.select("uid", "doc_id", "source", "size", "source_size", "weight", "target", "taken"), taken_of


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("uid", F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), ticket(seed, "doc_id", "text").alias("ticket"))


def mix(docs: DataFrame, *, seed: int = 17, scratch: Scratch | None = None, **how) -> DataFrame:
    """uid, doc_id, source, size, source_size, weight, target and taken of every document."""
    return schedule(_sized(with_uid(docs.select("doc_id", "source", "text")), seed), scratch=scratch, **how)[0]


def emit(docs: DataFrame, *, seed: int = 17, scratch: Scratch | None = None, **how) -> DataFrame:
    """The mix: a row of the documents' own columns each time one is taken, range-sorted by finish time.

    A document that is in service at the cut keeps its first words.
    """
    columns = docs.columns
    rows = with_uid(docs.select(F.struct("*").alias("row"), "doc_id", "source", "text"))
    taken = schedule(_sized(rows, seed), scratch=scratch, **how)[1]
    out = rows.select("uid", "row", word_count(F.col("text")).alias("size")).join(taken.hint("merge"), "uid")
    short = F.col("part") < F.col("size")
    words = F.split(F.when(short, F.col("row.text")), rf"(?<=[^{SPACE}])(?=[{SPACE}])")
    text = F.when(short, F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), "")).otherwise(F.col("row.text"))
    out = out.repartitionByRange("finish", "uid", "round").sortWithinPartitions("finish", "uid", "round")
    return out.select(*[text.alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in columns])
