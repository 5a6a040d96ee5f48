"""Queries of the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import kmv, mixing, packing, truncation
from tidemill.llm.arrow_agg import scan_tasks
from tidemill.llm.tokens import token_count
from tidemill.llm.topn import top_n
from tidemill.runtime import cut, table

# --- distinct counts -------------------------------------------------------------------------------------------------

DIMS = ["load_no", "day", "region", "year", "sku"]


def _dims(df: DataFrame, day: bool) -> list[Column]:
    """``DIMS`` of a table, NULL where it has none or the day isn't asked for."""
    have = set(df.columns)
    own = [(F.col(c) if c in have else F.lit(None).cast(kind)).alias(c) for c, kind in (("region", "string"), ("year", "bigint"), ("sku", "string"))]
    return [F.col("load_no"), (F.to_date("loaded_at") if day else F.lit(None).cast("date")).alias("day"), *own]


def _tall(spark: SparkSession, d: str, name: str, columns: tuple[str, ...]) -> DataFrame:
    """``table_name, column_name, DIMS, id`` of the counted columns' values that aren't NULL."""
    df = table(spark, d, name)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.xxhash64(c).alias("id"), F.col(c).isNotNull().alias("there")) for c in columns])
    spread = df.select(F.lit(name).alias("table_name"), *_dims(df, day=False), F.explode(pairs).alias("p"))
    return spread.where("p.there").select("table_name", "p.column_name", *DIMS, "p.id")


def _subsets(dims: list[str]) -> list[tuple[str, ...]]:
    return reduce(lambda acc, dim: acc + [(*s, dim) for s in acc], dims, [()])


FIXED = ["table_name", "column_name"]


K = kmv.K


def _sketches(spark: SparkSession, d: str, name: str, asked: dict[str, set[tuple[str, ...]]], day: bool = False, k: int | None = None) -> DataFrame:
    """Sketches of the grouping sets asked for per column of a table; a dimension no set of a column has is left out of its finest groups."""
    k, df = k or K, table(spark, d, name)
    used = {c: [dim for dim in DIMS if any(dim in s for s in own)] for c, own in asked.items()}
    finest = kmv.partial_sketches_of(df.select(*_dims(df, day), *[F.col(c).alias(f"v_{c}") for c in asked]), DIMS, {c: F.col(f"v_{c}") for c in asked}, used, k)
    sets = sorted(set().union(*asked.values()))
    only = {s: F.col("column_name").isin([c for c, own in asked.items() if s in own]) for s in sets}
    spread = kmv.grouping_sets(finest, DIMS, sets, ["column_name"], k, only)
    return kmv.merge_sketches(spread, ["column_name", "grouped", *DIMS], k, tasks=scan_tasks(df)).withColumn("table_name", F.lit(name))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Recorded distinct counts that are off by more than a fifth.

    Each record is held against the bounds of its group's sketch. Where these don't settle it, the group's distinct
    values are counted exactly, for those groups only.
    """
    ids = {"shop_orders": ("id", "customer_id", "region", "year"), "shop_lineitem": ("order_id", "sku", "revenue")}
    limits = [F.when(F.col(c).isNotNull(), F.lit(c)) for c in ("region", "year", "sku")]
    known = reduce(lambda x, y: x | y, [(F.col("table_name") == t) & F.col("column_name").isin(*cs) for t, cs in ids.items()])
    stats = table(spark, d, "table_stats").where(F.col("ndv").isNotNull() & F.col("load_no").isNotNull() & known)
    asked = stats.select("stat_id", *FIXED, "load_no", "region", "year", "sku", "ndv", F.concat_ws(",", F.lit("load_no"), *limits).alias("grouped"))
    combos: dict[str, dict[str, set[tuple[str, ...]]]] = {t: {} for t in ids}
    for r in asked.select(*FIXED, "grouped").distinct().collect():  # columns times sets of dimensions at most
        combos[r["table_name"]].setdefault(r["column_name"], set()).add(tuple(r["grouped"].split(",")))
    parts = [_sketches(spark, d, t, c) for t, c in combos.items() if c]
    if not parts:
        return asked.select("stat_id").limit(0)
    low, high = kmv.bounds(F.col("hashes"), K)
    counts = reduce(DataFrame.unionByName, parts).select(*FIXED, "grouped", *DIMS, low.alias("low"), high.alias("high"))
    on = [asked[c] == counts[c] for c in (*FIXED, "grouped", "load_no")] + [asked[c].eqNullSafe(counts[c]) for c in ("region", "year", "sku")]
    held = asked.join(counts, on, "left").select(asked["*"], F.coalesce(counts["low"], F.lit(0.0)).alias("low"), F.coalesce(counts["high"], F.lit(0.0)).alias("high"))
    wrong = (F.col("ndv") > 1.2 * F.col("high")) | (F.col("ndv") < 0.8 * F.col("low"))
    sound = (F.col("ndv") <= 1.2 * F.col("low")) & (F.col("ndv") >= 0.8 * F.col("high"))
    judged = cut(held.withColumn("verdict", F.when(F.col("low") == F.col("high"), F.abs(F.col("ndv") - F.col("low")) > 0.2 * F.col("low")).when(wrong, F.lit(True)).when(sound, F.lit(False))))
    found = judged.where(F.col("verdict")).select("stat_id")
    tall = {t: _tall(spark, d, t, columns) for t, columns in ids.items()}
    exact = _counted(tall, judged.where(F.col("verdict").isNull()))
    return found if exact is None else found.unionByName(exact.where(F.abs(F.col("ndv") - F.col("true_ndv")) > 0.2 * F.col("true_ndv")).select("stat_id"))


def _counted(tall: dict[str, DataFrame], records: DataFrame) -> DataFrame | None:
    """``stat_id, ndv, true_ndv`` of records, by an exact count of their groups; None without records.

    Each set of dimensions is counted by itself, so every join is one on equal keys. Rows are kept by a semi-join with the groups asked for and
    reduced to distinct values before they are counted, spread by group and value: a load with a third of all rows is not one task's.
    """
    parts = []
    for r in records.select("table_name", "grouped").distinct().collect():  # tables times sets of dimensions at most
        keys = [*FIXED, *r["grouped"].split(",")]
        asked = records.where((F.col("table_name") == r["table_name"]) & (F.col("grouped") == r["grouped"])).select("stat_id", "ndv", *keys)
        rows = tall[r["table_name"]].join(asked.select(*keys).distinct(), keys, "left_semi")
        counts = rows.select(*keys, "id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("true_ndv"))
        parts.append(asked.join(counts, keys, "left").select("stat_id", "ndv", F.coalesce("true_ndv", F.lit(0)).alias("true_ndv")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct customers and orders per load, day, region, year and sku and every combination of these, with bounds."""
    orders = _sketches(spark, d, "shop_orders", {"customer_id": set(_subsets(["load_no", "day", "region", "year"]))}, day=True)
    lines = _sketches(spark, d, "shop_lineitem", {"order_id": set(_subsets(["load_no", "day", "sku"]))}, day=True)
    low, high = kmv.bounds(F.col("hashes"))
    return orders.unionByName(lines).select(*FIXED, "grouped", *DIMS, kmv.estimate(F.col("hashes")).alias("ndv"), low.alias("low"), high.alias("high"))


def p3_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The bounds of sketches of 64 values, which have to estimate nearly everywhere, held against exact counts.

    Per load and region the customers, per load and article the orders: their true number and whether the bounds hold it.
    """
    sets = {"shop_orders": ("customer_id", ("load_no", "region")), "shop_lineitem": ("order_id", ("load_no", "sku"))}
    low, high = kmv.bounds(F.col("hashes"), 64)
    parts = []
    for name, (column, dims) in sets.items():
        keys = [*FIXED, *dims]
        bounds = _sketches(spark, d, name, {column: {dims}}, k=64).select(*keys, low.alias("low"), high.alias("high"))
        true = _tall(spark, d, name, (column,)).select(*keys, "id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("true_ndv"))
        same = reduce(lambda a, b: a & b, (true[k].eqNullSafe(bounds[k]) for k in keys))
        held = F.coalesce(F.col("true_ndv").between(F.col("low"), F.col("high")), F.lit(False)).alias("held")
        parts.append(true.join(bounds, same, "left").select(*[true[k] for k in FIXED], true["load_no"], true[dims[1]].alias("value"), "true_ndv", held))
    return reduce(DataFrame.unionByName, parts)


def p3_kept_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers of each load against the load before: all, in both, and in either only, with bounds."""
    sketches = cut(_sketches(spark, d, "shop_orders", {"customer_id": {("load_no",)}}).select("load_no", "hashes"))
    before = sketches.select((F.col("load_no") + 1).alias("load_no"), F.col("hashes").alias("before"))
    return kmv.compare(sketches.join(before, "load_no"), "before", "hashes").drop("before", "hashes")


# --- top N per group -------------------------------------------------------------------------------------------------


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "shop_lineitem").where(F.col("revenue").isNotNull() & F.col("sku").isNotNull() & F.col("order_id").isNotNull()).select("line_id", "order_id", "sku", "revenue", "load_no")
    # Rows of one id agree, so the distinct pairs have each id once, and are found by hashing, where max(region) would sort. Written
    # out, the join reads two plain scans and a hot order's partition can be split.
    orders = cut(table(spark, d, "shop_orders").where(F.col("region").isNotNull()).select("id", "region").distinct())
    joined = lines.join(orders, lines["order_id"] == orders["id"]).select("load_no", "region", "sku", "revenue", "line_id")
    return top_n(joined, ["load_no", "region", "sku"], "revenue", "line_id", 3).select("line_id", F.col("rank_no").cast("bigint").alias("rank_no"))


# --- containers ------------------------------------------------------------------------------------------------------


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return cut(table(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("tokens")))


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    """The containers asked for: two rows of configuration."""
    return {r["container_name"]: r["capacity_tokens"] for r in table(spark, d, "containers").collect()}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that come to lie in several containers of the kind ``large``."""
    packed = packing.pack(_sized(spark, d), "doc_id", "tokens", _capacities(spark, d)["large"])
    spread = packed.groupBy("item").agg(F.min("container_no").alias("first"), F.max("container_no").alias("last"))
    return spread.where(F.col("first") < F.col("last")).select(F.col("item").alias("doc_id"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every text or piece, for each kind of container."""
    sized = _sized(spark, d)
    parts = [
        packing.pack(sized, "doc_id", "tokens", capacity).select(F.lit(name).alias("container_name"), F.col("item").alias("doc_id"), "piece_no", F.col("size").alias("tokens"), "container_no")
        for name, capacity in sorted(_capacities(spark, d).items())
    ]
    return reduce(DataFrame.unionByName, parts)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    sized = _sized(spark, d)
    parts = [packing.fill(packing.pack(sized, "doc_id", "tokens", capacity), capacity).withColumn("container_name", F.lit(name)) for name, capacity in sorted(_capacities(spark, d).items())]
    return reduce(DataFrame.unionByName, parts)


def p6_by_chars(spark: SparkSession, d: str) -> DataFrame:
    """The packing with sizes in characters, and what has to hold of it, per kind of container.

    Texts packed, texts in more than one container, pieces, characters packed; and, each 0, containers above their capacity, pieces without a container, and
    texts whose pieces don't add up to them.
    """
    sized = cut(table(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("chars")))
    parts = []
    for name, capacity in sorted(_capacities(spark, d).items()):
        packed = cut(packing.pack(sized, "doc_id", "chars", capacity))
        texts = packed.groupBy("item").agg(F.min("container_no").alias("a"), F.max("container_no").alias("b"), F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.sum(F.col("container_no").isNull().cast("bigint")).alias("lost"))
        whole = sized.where(F.col("chars") > 0).join(texts, F.col("doc_id") == F.col("item"), "full")
        count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
        sums = whole.agg(count(F.col("item").isNotNull()).alias("texts"), count(F.col("a") < F.col("b")).alias("split"), count(F.col("n")).alias("pieces"), count(F.col("s")).alias("chars"), count(F.col("lost")).alias("unplaced"), count(~F.col("s").eqNullSafe(F.col("chars"))).alias("unequal"))
        over = packed.groupBy("container_no").agg(F.sum("size").alias("s")).agg(count(F.col("s") > capacity).alias("overfull"))
        kind = F.lit(name).alias("container_name")
        parts.append(sums.select(kind, "*").join(over.select(kind, "*"), "container_name"))  # one row each
    return reduce(DataFrame.unionByName, parts)


# --- mixing ----------------------------------------------------------------------------------------------------------


#: The domains of the mix, by the name a host begins with; any other host is of the domain without a name.
DOMAINS = ("blog", "m", "shop", "www")


def _host_domain(url: Column) -> Column:
    first = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([a-z0-9-]+)\.", 1))
    return F.when(first.isin(*DOMAINS), first)


def _language(lang: Column) -> Column:
    return F.lower(F.regexp_extract(lang, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))


def _mix_documents(spark: SparkSession, d: str, size: Column) -> DataFrame:
    language = _language(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", "source", _host_domain(F.col("url")).alias("domain"), F.when(language != "", language).alias("language"), size.alias("size"))


def _mix_of(spark: SparkSession, d: str, size: Column) -> mixing.Mix:
    return mixing.mix(_mix_documents(spark, d, size), table(spark, d, "mix_targets"))


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return _mix_of(spark, d, token_count(F.col("text")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose leaves' budgets leave part of their share unmet."""
    docs, leaves, total = mixing.measure(_mix_documents(spark, d, token_count(F.col("text"))), table(spark, d, "mix_targets"))
    return mixing.shortages(leaves, docs, total).select("source")


def p7_chosen(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).chosen.select("doc_id", "source", "uses")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_mix(spark, d))


def p7_leaves(spark: SparkSession, d: str) -> DataFrame:
    """The tree of the mix: size, share, budget and size reached of every source in every language and domain."""
    return mixing.leaf_shares(_mix(spark, d))


def p7_by_chars(spark: SparkSession, d: str) -> DataFrame:
    """The mix with sizes in characters, and what has to hold of it, per source.

    Characters the source has, whether its share can't be reached; and, each 0, documents used more often than allowed, documents used twice as rows, and
    leaves off their budget by more than a document.
    """
    m = _mix_of(spark, d, F.length("text"))
    sizes = mixing.leaf_shares(m).groupBy("source").agg(F.sum("size").alias("chars"), F.sum((F.abs(F.col("reached") - F.col("budget")) > F.col("largest")).cast("bigint")).alias("off"))
    targets = table(spark, d, "mix_targets")
    used = m.chosen.join(targets.select("source", "max_repeats"), "source").groupBy("source", "doc_id").agg(F.sum((F.col("uses") > F.col("max_repeats")).cast("bigint")).alias("over"), F.count(F.lit(1)).alias("n"))
    faults = used.groupBy("source").agg(F.sum("over").alias("over_used"), F.sum((F.col("n") > 1).cast("bigint")).alias("twice"))
    short = mixing.shortages(m.leaves, m.chosen, m.total).select("source", F.lit(True).alias("short"))
    return sizes.join(faults, "source", "left").join(short, "source", "left").fillna(0, ["over_used", "twice"]).fillna(False, ["short"])


# --- truncated texts -------------------------------------------------------------------------------------------------


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents")).where("truncated").select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(truncation.truncated(table(spark, d, "documents")))


def p8_closed(spark: SparkSession, d: str) -> DataFrame:
    """Per source the texts without a ``<`` that end with a full stop, question or exclamation mark, and how many of them are reported: none."""
    docs = table(spark, d, "documents")
    closed = docs.where(F.col("text").rlike(r"(?<!\.\.)[.!?]\z") & ~F.contains(F.col("text"), F.lit("<"))).select("doc_id")
    judged = truncation.truncated(docs).join(closed, "doc_id")
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("closed"), F.sum(F.col("truncated").cast("bigint")).alias("reported"))


QUERIES = {f.__name__: f for f in (p3_found, p3_counts, p3_bounds, p3_kept_customers, p4_found, p6_found, p6_containers, p6_fill, p6_by_chars, p7_found, p7_chosen, p7_shares, p7_leaves, p7_by_chars, p8_found, p8_rates, p8_closed)}

_STATS = " UNION ALL ".join(
    f"SELECT s.stat_id, s.ndv, count(DISTINCT t.{c}) AS true_ndv FROM table_stats s LEFT JOIN {t} t ON t.load_no = s.load_no {extra} WHERE s.table_name = '{t}' AND s.column_name = '{c}' {only} GROUP BY ALL"
    for t, columns, extra, only in (
        ("shop_orders", ("id", "customer_id", "region", "year"), "AND (s.region IS NULL OR t.region = s.region) AND (s.year IS NULL OR t.year = s.year)", "AND s.sku IS NULL"),
        ("shop_lineitem", ("order_id", "sku", "revenue"), "AND (s.sku IS NULL OR t.sku = s.sku)", "AND s.region IS NULL AND s.year IS NULL"),
    )
    for c in columns
)
ORACLE = {
    "p3_found": f"SELECT stat_id FROM ({_STATS}) WHERE ndv IS NOT NULL AND abs(ndv - true_ndv) > 0.2 * true_ndv",
    "p4_found": """SELECT line_id, rank_no FROM (SELECT l.line_id, row_number() OVER (PARTITION BY l.load_no, o.region, l.sku ORDER BY l.revenue DESC, l.line_id) AS rank_no
  FROM shop_lineitem l JOIN (SELECT DISTINCT id, region FROM shop_orders) o ON o.id = l.order_id WHERE l.revenue IS NOT NULL AND l.sku IS NOT NULL AND o.region IS NOT NULL) WHERE rank_no <= 3""",
    "p3_bounds": """SELECT 'shop_orders' AS table_name, 'customer_id' AS column_name, load_no, region AS value, count(DISTINCT customer_id) AS true_ndv, true AS held FROM shop_orders WHERE customer_id IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'shop_lineitem', 'order_id', load_no, sku, count(DISTINCT order_id), true FROM shop_lineitem WHERE order_id IS NOT NULL GROUP BY ALL""",
    "p6_by_chars": """SELECT container_name, count(*) AS texts, count(*) FILTER (WHERE length(text) > capacity_tokens) AS split, CAST(sum(ceil(length(text) / capacity_tokens)) AS BIGINT) AS pieces,
  CAST(sum(length(text)) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS unplaced, CAST(0 AS BIGINT) AS unequal, CAST(0 AS BIGINT) AS overfull FROM documents, containers WHERE length(text) > 0 GROUP BY container_name""",
    "p7_by_chars": """SELECT t.source, CAST(coalesce(s.chars, 0) AS BIGINT) AS chars, coalesce(s.chars, 0) * t.max_repeats < t.target_share * (SELECT sum(length(text)) FROM documents) AS short,
  CAST(0 AS BIGINT) AS off, CAST(0 AS BIGINT) AS over_used, CAST(0 AS BIGINT) AS twice
  FROM mix_targets t LEFT JOIN (SELECT source, sum(length(text)) AS chars FROM documents GROUP BY source) s ON s.source = t.source""",
    "p8_closed": "SELECT source, count(*) AS closed, CAST(0 AS BIGINT) AS reported FROM documents WHERE right(text, 1) IN ('.', '!', '?') AND NOT (right(text, 1) = '.' AND text LIKE '%...') AND NOT contains(text, '<') GROUP BY source",
}
