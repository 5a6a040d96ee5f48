"""References to records that do not exist, do not exist yet, or have been removed."""

from __future__ import annotations

from functools import reduce
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.asof import last_before
from tidemill.runtime import cut


def match_references(refs: DataFrame, parents: DataFrame, keys: list[tuple[str, str]], facts: dict[str, Column], match: str = "simple") -> DataFrame:
    """Resolve (composite) references, NULL parts included, and report the orphans.

    ``keys``: pairs of a column of ``refs`` and its column of ``parents``. ``facts``: name → aggregate over the
    parents that share a key, handed to the references that find one. Adds to ``refs`` the columns ``orphan``
    (BOOLEAN, never NULL), ``null_mask`` (one character per key, ``1`` where the reference's part is NULL) and the facts.

    References are grouped by their NULL mask; each mask that occurs is anti-joined with the parents on its non-NULL
    columns. ``match`` is the declared semantics: ``simple`` – any NULL part satisfies the reference;
    ``partial`` – the non-NULL parts must agree with some parent; ``full`` – all parts are NULL or
    none is, a mix is an orphan. A reference whose parts are all NULL is never an orphan.

    The anti-join is written as an outer join with one row per distinct parent key, so that one shuffle of the
    references yields the orphans and, for the others, the facts. Parents are aggregated before the
    join (partial sums before the shuffle) and written out, so the join reads a plain scan and adaptive execution can
    split a hot key's partition of the references. Extra columns of ``refs`` pass through, but for any called like an added one, which
    is replaced; repeated references are kept; with no parents at all every checked reference is an orphan.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"match must be simple, partial or full, not {match!r}")
    mask = F.concat(*[F.when(F.col(r).isNull(), "1").otherwise("0") for r, _ in keys])
    added = {"null_mask", "orphan", *facts}
    marked = refs.select(*[c for c in refs.columns if c not in added], mask.alias("null_mask"))
    checked = ["0" * len(keys)]
    if match == "partial" and len(keys) > 1:  # the masks that occur, at most 2 to the number of keys
        checked = sorted(r["null_mask"] for r in marked.select("null_mask").distinct().collect() if "0" in r["null_mask"]) or checked
    if len(checked) > 1 and not facts:
        parents = cut(parents.select(*dict.fromkeys(p for _, p in keys)).distinct())  # every mask reads the distinct keys
    parts = []
    for m in checked:
        used = [(r, p) for (r, p), bit in zip(keys, m) if bit == "0"]
        names = [f"__key{i}" for i in range(len(used))]
        known = parents.where(reduce(lambda a, b: a & b, [F.col(p).isNotNull() for _, p in used]))
        known = cut(known.groupBy(*[F.col(p).alias(n) for n, (_, p) in zip(names, used)]).agg(F.lit(True).alias("__known"), *[a.alias(n) for n, a in facts.items()]))
        # As plain NULL tests the mask reaches the reader of the references.
        group = marked.where(reduce(lambda a, b: a & b, [F.col(r).isNull() if bit == "1" else F.col(r).isNotNull() for (r, _), bit in zip(keys, m)]))
        joined = group.join(known, [group[r] == known[n] for n, (r, _) in zip(names, used)], "left")
        parts.append(joined.select(*[group[c] for c in marked.columns], known["__known"].isNull().alias("orphan"), *[known[n] for n in facts]))
    rest = marked.where(~F.col("null_mask").isin(checked))
    empty = parts[0].schema
    mixed = F.lit(match == "full") & F.contains(F.col("null_mask"), F.lit("0"))
    parts.append(rest.select(*marked.columns, mixed.alias("orphan"), *[F.lit(None).cast(empty[n].dataType).alias(n) for n in facts]))
    return reduce(DataFrame.unionByName, parts)


def broken_references(refs: DataFrame, parents: DataFrame, changes: DataFrame) -> DataFrame:
    """References with no parent (``missing``), with one that came later (``late``), or to a removed one (``deleted``).

    ``refs``: ``src_table, row_id, ref, at, check_removed``; ``parents``: ``key, at``; ``changes``: ``seq, key, op, at`` with
    ``op`` ``remove`` or ``restore`` (others are ignored), repeated changes allowed. Returns ``src_table, row_id, at,
    reason`` of the broken references, the first reason that holds. A NULL reference is no case; a NULL ``at`` is neither late nor
    after a removal; ties in a history go to the larger ``seq``; empty tables give an empty result, or ``missing`` for all.

    Only references at or after their parent's first removal go through the look-up of its history.
    """
    history = changes.where(F.col("op").isin("remove", "restore") & F.col("key").isNotNull())
    seen = parents.select("key", F.col("at").alias("seen_at"), F.lit(None).cast("timestamp").alias("removed_at"))
    gone = history.where(F.col("op") == "remove").select("key", F.lit(None).cast("timestamp").alias("seen_at"), F.col("at").alias("removed_at"))
    # A removal alone makes no parent: its key counts as known only where a parent row has it.
    facts = {"parents": F.count("seen_at"), "first_seen": F.min("seen_at"), "first_removed": F.min("removed_at")}
    refs = refs.select("src_table", "row_id", "ref", "at", "check_removed")
    found = match_references(refs, seen.unionByName(gone), [("ref", "key")], facts)
    at = F.col("at")
    state = (
        F.when(F.col("ref").isNull(), None)
        .when(F.col("orphan") | (F.col("parents") == 0), F.lit("missing"))
        .when(F.col("first_seen") > at, F.lit("late"))
        .when(F.col("check_removed") & (F.col("first_removed") <= at), F.lit("ask"))
    )
    staged = cut(found.select("src_table", "row_id", "ref", "at", state.alias("state")).where(F.col("state").isNotNull()))
    probes = staged.where(F.col("state") == "ask").select(F.col("ref").alias("key"), "at", F.struct("src_table", "row_id").alias("seq"))
    kind = staged.schema["row_id"].dataType
    events = history.select("key", "at", F.struct(F.lit("").alias("src_table"), F.col("seq").cast(kind).alias("row_id")).alias("seq"), F.col("op").alias("value"))
    last = last_before(events, probes)
    deleted = last.where(F.col("value") == "remove").select(F.col("seq.src_table").alias("src_table"), F.col("seq.row_id").alias("row_id"), "at", F.lit("deleted").alias("reason"))
    return staged.where(F.col("state") != "ask").select("src_table", "row_id", "at", F.col("state").alias("reason")).unionByName(deleted)


def broken_by_month(broken: DataFrame) -> DataFrame:
    """Number of broken references per table, month and reason."""
    return broken.groupBy("src_table", F.date_format("at", "yyyy-MM").alias("month"), "reason").agg(F.count(F.lit(1)).alias("n"))
