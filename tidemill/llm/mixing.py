"""A mix of sources with target shares of the total size."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.runtime import cut

#: Documents of a leaf are ordered in buckets of about this many, so that no task sorts a whole source.
BUCKET_DOCUMENTS = 65_536

PLACE = ("domain", "language", "source")


@dataclass
class Leaf:
    """A source's documents of one language in one domain. ``size`` is that of its documents together, ``share`` its part of the source's share, ``asked``."""

    domain: str
    language: str
    source: str
    share: float
    max_repeats: int
    size: int = 0
    n: int = 0
    asked: float = 0.0
    largest: int = 0
    wanted: float = 0.0
    budget: float = 0.0

    @property
    def most(self) -> int:
        return self.size * self.max_repeats

    @property
    def unmet(self) -> float:
        """What the leaf lacks of its own share however often its documents may be used."""
        return max(0.0, self.wanted - self.most)


def level(amount: float, weights: list[float], rooms: list[float]) -> list[float]:
    """Parts of ``amount`` by weight, none above its room: what the full ones leave over goes to the others, by weight again.

    Parts of weight 0 get nothing; what no part has room for is not given.
    """
    given = [0.0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and rooms[i] > 0]
    while open_ and amount > 0:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if rooms[i] <= amount * weights[i] / whole]
        for i in full or open_:
            given[i] = rooms[i] if full else amount * weights[i] / whole
        if not full:
            break
        amount -= sum(rooms[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return given


def _grouped(leaves: list[Leaf], by: Callable[[Leaf], str]) -> list[list[Leaf]]:
    groups: dict[str, list[Leaf]] = defaultdict(list)
    for leaf in leaves:
        groups[by(leaf)].append(leaf)
    return [groups[k] for k in sorted(groups)]


def budget(leaves: list[Leaf], total: float) -> list[Leaf]:
    """Budgets of the leaves for a mix in which each has ``share`` of ``total``, with shortages handed on.

    A node's weight is the sum of its leaves' shares, its room that of its leaves. From the root down a node's budget is parted among its children by
    weight, as far as each has room. So a leaf's shortage goes to the other sources of its language and domain, by their
    weights; only what the whole language has no room for goes to the domain's other languages, and only what the domain has none for to
    other domains. Leaves of weight 0 get nothing.
    """
    for leaf in leaves:
        leaf.wanted = leaf.share * total

    def descend(group: list[Leaf], amount: float, levels: tuple[str, ...]) -> None:
        children = _grouped(group, lambda x: getattr(x, levels[0]))
        parts = level(amount, [sum(x.share for x in c) for c in children], [float(sum(x.most for x in c if x.share > 0)) for c in children])
        for child, part in zip(children, parts):
            if len(levels) > 1:
                descend(child, part, levels[1:])
            else:
                child[0].budget = part

    descend(leaves, sum(x.wanted for x in leaves), PLACE)
    return leaves


def hand_on(leaves: list[Leaf], reached: dict[tuple[str, str, str], float]) -> list[Leaf]:
    """Hand what the leaves' prefixes are off to one sibling each: the one of the most documents, which can come nearest to any budget.

    A leaf alone in its language hands it to that of its domain.
    """
    weighted = [x for x in leaves if x.share > 0 and x.n]
    off = {id(x): reached.get((x.domain, x.language, x.source), 0.0) - x.budget for x in weighted}
    for of in (lambda x: (x.domain, x.language), lambda x: x.domain):
        for group in _grouped(weighted, of):  # type: ignore[arg-type]
            taker = max(group, key=lambda x: (x.n, x.source, x.language))
            others = [x for x in group if x is not taker]
            if others:
                taker.budget = min(max(taker.budget - sum(off[id(x)] for x in others), 0.0), float(taker.most))
                off |= dict.fromkeys(map(id, group), 0.0)
    return leaves


@dataclass(frozen=True)
class Mix:
    """``chosen``: ``doc_id, domain, language, source, size, uses``; ``leaves``: with their budgets; ``total``: size of all documents."""

    chosen: DataFrame
    leaves: list[Leaf]
    total: int


def measure(docs: DataFrame, targets: DataFrame) -> tuple[DataFrame, list[Leaf], int]:
    """(documents of the targeted sources, budgeted leaves, size of all documents).

    ``docs``: ``doc_id, source, domain, language, size``; ``targets``: ``source, target_share, max_repeats``, the configuration of the mix,
    which is collected; one row per source counts, the first by share. Sizes come from one aggregation of all documents,
    NULL sources included; a row per source, language and domain reaches the driver, which must come from a fixed list. A source's share is parted among its
    leaves by their sizes. A NULL language or domain is the one without a name; a NULL share or repeat number counts as 0.
    """
    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("domain", "language")]
    ready = cut(docs.select("doc_id", "source", *named, F.coalesce("size", F.lit(0)).cast("bigint").alias("size")))
    wanted: dict[str, tuple[float, int]] = {}
    for r in sorted(targets.where(F.col("source").isNotNull()).collect(), key=lambda r: (r["source"], -(r["target_share"] or 0.0))):
        wanted.setdefault(r["source"], (r["target_share"] or 0.0, r["max_repeats"] or 0))
    names = ready.sparkSession.createDataFrame([(s,) for s in wanted], "source string")
    total = ready.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"]
    own = ready.join(F.broadcast(names), "source")  # as many rows as the mix has sources
    found: dict[str, list] = defaultdict(list)
    for r in own.groupBy(*PLACE).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("size").alias("largest")).collect():
        found[r["source"]].append(r)
    leaves = []
    for s, (share, repeats) in wanted.items():
        whole = sum(r["size"] for r in found[s])
        leaves += [Leaf(r["domain"], r["language"], s, share * r["size"] / whole if whole else share / len(found[s]), repeats, r["size"], r["n"], share, r["largest"]) for r in found[s]]
        if not found[s]:
            leaves.append(Leaf("", "", s, share, repeats, asked=share))
    return own, budget(leaves, total), total


def _prefixes(own: DataFrame, leaves: list[Leaf], seed: int) -> DataFrame:
    """``doc_id, domain, language, source, size, uses`` of the prefix of every leaf's epochs that comes nearest to its budget."""
    rows = []
    for leaf in leaves:
        whole = min(int(leaf.budget // leaf.size), leaf.max_repeats) if leaf.size else 0
        rest = int(leaf.budget - whole * leaf.size) if leaf.size and whole < leaf.max_repeats else 0
        bits = max(0, (max(leaf.n, 1) // BUCKET_DOCUMENTS).bit_length())
        rows.append((leaf.domain, leaf.language, leaf.source, whole, rest, bits))
    at = list(PLACE)
    plan = F.broadcast(own.sparkSession.createDataFrame(rows, "domain string, language string, source string, whole bigint, rest bigint, bits int"))  # a row per leaf
    order = F.xxhash64(F.lit(seed), F.col("whole"), F.col("doc_id"))  # the epoch after the whole ones
    planned = own.join(plan, at).withColumn("place", order).withColumn("bucket", F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(place, 64 - bits)")).otherwise(F.lit(0).cast("bigint")))
    sums = planned.where(F.col("rest") > 0).groupBy(*at, "bucket", "rest").agg(F.sum("size").alias("s"))
    ends = sums.withColumn("upto", F.sum("s").over(Window.partitionBy(*at).orderBy("bucket")))
    last = ends.where(F.col("upto") > F.col("rest")).groupBy(*at).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("s")).alias("before"))).alias("e")).select(*at, F.col("e.bucket").alias("end"), F.col("e.before").alias("before"))
    placed = planned.join(F.broadcast(last), at, "left")  # a row per leaf
    ending = F.coalesce((F.col("rest") > 0) & (F.col("bucket") == F.col("end")), F.lit(False))
    running = Window.partitionBy(*at, "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    at_end = placed.where(ending).withColumn("upto", F.col("before") + F.sum("size").over(running)).withColumn("once", F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    others = placed.where(~ending).withColumn("once", (F.col("rest") > 0) & (F.col("end").isNull() | (F.col("bucket") < F.col("end"))))
    used = others.unionByName(at_end.drop("upto")).select("doc_id", *at, "size", (F.col("whole") + F.col("once").cast("bigint")).alias("uses"))
    return used.where(F.col("uses") > 0)


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0) -> Mix:
    """Choose documents so that each leaf comes to its budget, none used more than ``max_repeats`` times.

    A leaf's documents are laid out in epochs, each in a seeded random order of its own; the mix takes the prefix
    of this sequence that comes nearest to the budget: some whole epochs, and of the next the documents at least half of which still
    fit. So the uses of a leaf's documents differ by at most one, and a leaf is off by half a document at most; by what
    the leaves are off, the largest of their siblings is given more or less.

    The running size needs no sorted source: sizes are summed per bucket of the order, of about ``BUCKET_DOCUMENTS`` documents,
    the running sum over buckets finds the one in which the prefix ends, and only that bucket is sorted. Documents of
    size 0 go with their leaf's whole epochs. Sources without a target, and documents without a source, are not chosen; an
    empty table gives an empty mix. ``doc_id`` should be unique; repeated ids are chosen each by itself.
    """
    own, leaves, total = measure(docs, targets)
    first = _prefixes(own, leaves, seed).groupBy(*PLACE).agg(F.sum(F.col("size") * F.col("uses")).alias("s"))
    hand_on(leaves, {tuple(r[c] for c in PLACE): float(r["s"]) for r in first.collect()})  # type: ignore[misc]
    return Mix(cut(_prefixes(own, leaves, seed)), leaves, total)


def shortages(leaves: list[Leaf], docs: DataFrame, total: int) -> DataFrame:
    """``source, unmet``: sources whose budgets leave part of their share unmet, before others make up for it.

    The leaves' parts are fractions; where they add up to nothing but rounding, the source's whole sizes settle it.
    """
    rows = []
    for group in _grouped(leaves, lambda x: x.source):
        unmet, over = sum(x.unmet for x in group), sum(x.most - x.wanted for x in group)
        if unmet > 0 or abs(over) <= 1e-9 * max(total, 1):
            if sum(x.most for x in group) < group[0].asked * total:
                rows.append((group[0].source, float(unmet)))
    return docs.sparkSession.createDataFrame(rows, "source string, unmet double")


def shares(m: Mix) -> DataFrame:
    """Per source of the mix: target share, budget, size reached and the share of the mix it has."""
    spark = m.chosen.sparkSession
    sources = _grouped(m.leaves, lambda x: x.source)
    rows = [(g[0].source, float(sum(x.share for x in g)), g[0].max_repeats, len(g), float(sum(x.budget for x in g))) for g in sources]
    plan = spark.createDataFrame(rows, "source string, target_share double, max_repeats bigint, leaves bigint, budget double")
    got = m.chosen.groupBy("source").agg(F.sum(F.col("size") * F.col("uses")).alias("reached"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"))
    out = plan.join(got, "source", "left").fillna(0, ["reached", "uses", "most_uses"])
    whole = F.sum("reached").over(Window.partitionBy())  # over one row per source of the mix
    return out.withColumn("share", F.when(whole > 0, F.col("reached") / whole))


def leaf_shares(m: Mix) -> DataFrame:
    """Per leaf: ``domain, language, source``, size, its largest document, the size wanted, budgeted and reached."""
    rows = [(x.domain, x.language, x.source, x.size, x.largest, float(x.wanted), float(x.budget)) for x in m.leaves]
    plan = m.chosen.sparkSession.createDataFrame(rows, "domain string, language string, source string, size bigint, largest bigint, wanted double, budget double")
    got = m.chosen.groupBy(*PLACE).agg(F.sum(F.col("size") * F.col("uses")).alias("reached"))
    return plan.join(got, list(PLACE), "left").fillna(0, ["reached"])
