"""Multiple-choice responses: (entity, item, choice, acc).  A negative choice is an unparseable answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import ordinal


def recover_gold(r: DataFrame) -> DataFrame:
    """item, gold: the most frequent choice among correct answers, the smallest of equal ones; -1 if none is correct.
    agreement: share of the correct answers that have it."""
    right = r.where("acc = 1 AND choice >= 0").groupBy("item", "choice").agg(F.count(F.lit(1)).alias("k"))
    best = right.groupBy("item").agg(F.max_by("choice", F.struct("k", -F.col("choice"))).alias("gold"), F.max("k").alias("top"), F.sum("k").alias("n"))
    items = r.select("item").distinct()
    return items.join(best, "item", "left").select("item", F.coalesce("gold", F.lit(-1)).alias("gold"), F.round(F.col("top") / F.col("n"), 8).alias("agreement"))


def validate_gold(r: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: share of answers where `choice is gold` and `acc` agree, over items with a key."""
    both = r.where("choice >= 0").join(gold.where("gold >= 0").select("item", "gold"), "item")
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(((F.col("choice") == F.col("gold")) == (F.col("acc") == 1)).cast("int")), 8).alias("reproduced"))


def wrong_counts(r: DataFrame) -> DataFrame:
    return r.where("acc = 0 AND choice >= 0").groupBy("item", "choice").agg(F.count(F.lit(1)).alias("k"))


def concentration(r: DataFrame) -> DataFrame:
    """item, n_wrong, q2 = sum over choices of (share of wrong answers)^2; null below two wrong answers."""
    w = wrong_counts(r).groupBy("item").agg(F.sum("k").alias("n_wrong"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    return w.select("item", "n_wrong", F.when(F.col("n_wrong") >= 2, F.round(F.col("kk") / (F.col("n_wrong") * F.col("n_wrong")), 8)).alias("q2"))


def global_agreement(r: DataFrame) -> DataFrame:
    """One row: agreement of two different wrong answers to the same item, pooled over items."""
    w = wrong_counts(r).groupBy("item").agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1)).alias("same"))
    return w.agg(F.sum("same").alias("same"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")).select("same", "pairs", F.round(F.col("same") / F.col("pairs"), 8).alias("agreement"))


def pair_agreement(r: DataFrame, pairs: DataFrame | None = None, least: int = 20, blocks: int = 16) -> DataFrame:
    """i, j, n, observed, expected: agreement of two entities over the items that both get wrong, against that of
    answers drawn independently from the item's wrong ones.  Pairs with fewer than `least` such items are left out.
    The
    expectation is a sum of whole 1e-8ths, the same in any order.  pairs: (i, j) if only some matter; else all i < j, which meet by their answers as bits, or else by item and a pair of
    entity blocks."""
    w = r.where("acc = 0 AND choice >= 0").select("entity", "item", "choice")
    q2 = concentration(r).where("q2 is not null").select("item", "q2")
    if pairs is None and (met := _met_by_bits(r, w, q2)) is not None:
        out = met.where(F.col("n") >= least)
        millionths = F.expr("(2000000L * same + n) div (2 * n)")  # round, of at most 64 items never between two: no decimals a pair
        return out.select("i", "j", "n", (millionths / 1e6).alias("observed"), (F.floor(F.col("e") / F.col("n")) / 1e8).alias("expected"))
    i = w.select(F.col("entity").alias("i"), "item", F.col("choice").alias("ci"))
    j = w.select(F.col("entity").alias("j"), "item", F.col("choice").alias("cj"))
    if pairs is None:
        block, every = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        both = i.withColumn("a", block("i")).withColumn("b", every).join(j.withColumn("b", block("j")).withColumn("a", every), ["item", "a", "b"]).where("i < j").join(q2, "item")
    else:
        both = pairs.join(i, "i").join(j, ["j", "item"]).join(q2, "item")
    out = both.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("ci") == F.col("cj")).cast("int")).alias("o"), F.sum(F.round(F.col("q2") * 1e8).cast("long")).alias("e"))
    return out.where(F.col("n") >= least).select("i", "j", "n", F.round("o", 6).alias("observed"), (F.floor(F.col("e") / F.col("n")) / 1e8).alias("expected"))


CHOICES = 16  # different ones, whose bits are columns


def _met_by_bits(r: DataFrame, w: DataFrame, q2: DataFrame) -> DataFrame | None:
    """i, j, n, same, e of all pairs: an entity's wrong answers are a word of its items and one for each choice, so that a
    joined row has all that is said of a pair and no pair is shuffled.  None where items are not numbered below 64, choices
    are many, or an entity answers an item twice."""
    from .pairs import _meet_blocks, block_count

    if dict(r.dtypes)["item"] not in ("tinyint", "smallint", "int", "bigint"):
        return None
    weights = {x.item: round(x.q2 * 1e8) for x in q2.limit(65).collect()}
    choices = sorted(x.choice for x in w.select("choice").distinct().limit(CHOICES + 1).collect())
    if len(weights) > 64 or len(choices) > CHOICES or any(not 0 <= k < 64 for k in weights):
        return None
    item = F.col("item").cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), item)
    names = [f"c{k}" for k in range(len(choices))]
    one = [F.bit_or(F.when(F.col("choice") == c, bit).otherwise(0)).alias(n) for n, c in zip(names, choices, strict=True)]
    a = w.where(F.col("item").isin(list(weights))).groupBy("entity").agg(F.count(F.lit(1)).alias("k"), F.bit_or(bit).alias("w"), *one)
    ends = a.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("k") - F.bit_count("w")).alias("twice")).head()
    if ends.twice:
        return None
    blocks = block_count(ends.n)
    b = a.select(F.col("entity").alias("other"), F.col("w").alias("x"), *[F.col(n).alias(f"x{n}") for n in names])
    both, same, e = F.col("w").bitwiseAND(F.col("x")), F.lit(0), F.lit(0).cast("long")
    for n in names:
        same = same + F.bit_count(F.col(n).bitwiseAND(F.col(f"x{n}")))
    for k, v in weights.items():
        e = e + F.shiftrightunsigned("both", k).bitwiseAND(F.lit(1)) * F.lit(v).cast("long")
    met = _meet_blocks(a.drop("k"), b, blocks).select(F.least("entity", "other").alias("i"), F.greatest("entity", "other").alias("j"), both.alias("both"), same.alias("same"))
    return met.where("both <> 0").select("i", "j", F.bit_count("both").cast("long").alias("n"), "same", e.alias("e"))


def tiebreak(seed: int, *columns: str):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def majority_vote(r: DataFrame, panels: DataFrame, gold: DataFrame, seed: int = 0) -> DataFrame:
    """panel: accuracy of the panel's majority over the keyed items.  Unparseable votes do not count, no votes are
    wrong, and ties go by a hash of seed, panel, item and choice."""
    keyed = gold.where("gold >= 0").select("item", "gold")
    votes = panels.join(r.where("choice >= 0"), "entity").groupBy("panel", "item", "choice").agg(F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy("panel", "item").orderBy(F.desc("k"), tiebreak(seed, "panel", "item", "choice"))
    won = votes.withColumn("place", F.row_number().over(order)).where("place = 1").select("panel", "item", "choice")
    asked = panels.select("panel").distinct().crossJoin(F.broadcast(keyed))  # the cells of the result
    out = asked.join(won, ["panel", "item"], "left")
    return out.groupBy("panel").agg(F.count(F.lit(1)).alias("n_items"), F.round(F.avg(F.coalesce((F.col("choice") == F.col("gold")).cast("int"), F.lit(0))), 8).alias("accuracy"))


def permute_wrong(r: DataFrame, seed: int, keep_mask: bool = True) -> DataFrame:
    """Responses with the choices shuffled within each item.  keep_mask: only wrong answers change places, so that each
    item keeps its composition; else all answers do while `acc` stays, which mixes right answers into the wrong ones."""
    group = ["item", "acc"] if keep_mask else ["item"]
    a, b = Window.partitionBy(*group).orderBy("entity"), Window.partitionBy(*group).orderBy(tiebreak(seed, "entity", "item"))
    here = r.withColumn("place", F.row_number().over(a)).drop("choice")
    there = r.select(*group, "choice", F.row_number().over(b).alias("place"))
    return here.join(there, [*group, "place"]).select("entity", "item", "choice", "acc")


def hashed_panels(entities: DataFrame, panels: int, size: int, seed: int = 0) -> DataFrame:
    """(panel, entity): `panels` panels of `size` entities, drawn by hash order."""
    all_ = entities.select("entity").distinct().crossJoin(F.broadcast(entities.sparkSession.range(panels).withColumnRenamed("id", "panel")))
    order = Window.partitionBy("panel").orderBy(tiebreak(seed, "panel", "entity"))
    return all_.withColumn("k", F.row_number().over(order)).where(F.col("k") <= size).select("panel", "entity")


def top_panel(o: DataFrame, size: int) -> DataFrame:
    """The `size` entities with the fewest failures."""
    from .margins import entity_margins

    return entity_margins(o).orderBy("r", "entity").limit(size).select("entity", "r")


def item_halves(o: DataFrame, seed: int = 0) -> DataFrame:
    """item, half (1 or 2): by hash order, the first half of the items and the rest."""
    ranked = ordinal(o.select("item").distinct().withColumn("h", tiebreak(seed, "item")), [F.col("h"), F.col("item")])
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    return ranked.crossJoin(F.broadcast(n)).select("item", F.when(F.col("rank") * 2 <= F.col("n") + F.col("n") % 2, 1).otherwise(2).alias("half"))


def greedy_diverse(pairs: DataFrame, start: int, size: int, candidates: DataFrame | None = None) -> list[int]:
    """Entities chosen one by one, each the least similar on average to those chosen; ties by entity.  pairs: i, j,
    agreement.  `size` is that of a panel, so the loop is short; each round is one aggregate over the chosen's pairs."""
    sim = pairs.select(F.col("i").alias("a"), F.col("j").alias("b"), "agreement").union(pairs.select("j", "i", "agreement"))
    if candidates is not None:
        sim = sim.join(candidates.select(F.col("entity").alias("b")).distinct(), "b", "left_semi")
    chosen = [start]
    while len(chosen) < size:
        rest = sim.where(F.col("a").isin(chosen) & ~F.col("b").isin(chosen)).groupBy("b").agg(F.round(F.avg("agreement"), 10).alias("s"))
        best = rest.orderBy("s", "b").head()
        if best is None:
            break
        chosen.append(best.b)
    return chosen


def diverse_panel(o: DataFrame, start, size: int, sign: int = 1) -> DataFrame:
    """place, entity: chosen one by one, each with the least (sign -1: the largest) mean agreement with those chosen; ties by
    entity.  No pairs are made: an entity's row is its failures as words, a step is one pass over those rows with the chosen
    ones' words as literals, and the least value comes back.  Integer items below 64 x pairs.WORDS."""
    from . import pairs
    from ..sources.storage import stored

    shape = pairs.shape(o)
    words = shape.high // 64 + 1
    if shape.low < 0 or words > pairs.WORDS:
        raise ValueError("items are numbered from 0 to 64 x WORDS")
    rows = stored(pairs.vectors(o, words), "vectors")
    names = ["r", *[f"w{k}" for k in range(words)]]
    chosen, known = [start], []
    while len(chosen) < size:
        known.append(rows.where(F.col("entity") == F.lit(chosen[-1])).select(*names).head())
        if known[-1] is None:
            break
        total = F.lit(0.0)
        for x in known:
            g = F.lit(0)
            for k in range(words):
                g = g + F.bit_count(F.col(f"w{k}").bitwiseAND(F.lit(x[f"w{k}"])))
            total = total + (F.lit(shape.m) - F.col("r") - F.lit(x.r) + 2 * g) / F.lit(shape.m)
        value = F.round(sign * total / len(known), 10)
        best = rows.where(~F.col("entity").isin(chosen)).agg(F.min(F.struct(value.alias("s"), "entity")).alias("best")).head().best
        if best is None:
            break
        chosen.append(best.entity)
    return o.sparkSession.createDataFrame(list(enumerate(chosen)), f"place int, entity {dict(o.dtypes)['entity']}")  # a panel
