"""Mixing sources to target weights by min-cost flow.

Documents of the same sources form a pattern. Every source has a quota of words, and a
pattern may give its words to any of its sources, up to three times over; each time over
costs more than the last. The cheapest flow says how many words each pattern gives, and
documents are taken in a seeded order until the pattern has given them. Sources that
patterns connect share a flow; a source that no pattern shares is its own, of one edge.
"""

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthgrain.llm.components import components
from growthgrain.llm.words import WORD
from growthgrain.operators.ordered import ranked
from growthgrain.session import shared_folder

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "1"
#: Patterns that are solved by one task, connected ones always together.
PATTERNS_A_TASK = 10_000
#: Hexadecimal digits of the seeded order that make a bucket: 4096 for each pattern.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _key(source: Column) -> Column:
    """A text that is never missing, another for every source."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(sizes: DataFrame, total: int, weights=WEIGHTS, most=MOST) -> DataFrame:
    """``sizes`` (``source``, ``source_size``) with the words wanted of each source,
    ``target``: shares of ``total`` by weight, none over ``most`` times its size; what is
    over goes to the others by weight.

    Sources by code point, missing last, take the weights in turn. Each round adds up what
    the sources that cannot give their share leave to the others, until no more become so.
    """
    placed = ranked(sizes.withColumn("_same", F.lit(0)), "_same", ["source"], "_place")
    turn = F.pmod(F.col("_place") - 1, F.lit(len(weights)))
    placed = placed.withColumn("_weight", F.get(F.array(*map(F.lit, weights)), turn)).checkpoint()
    full_size, weight = F.col("source_size") * most, F.col("_weight")
    share, full, n_full = F.lit(0.0), F.lit(False), -1
    while True:
        row = placed.agg(
            F.count_if(full).alias("n"),
            F.coalesce(F.sum(F.when(full, full_size)), F.lit(0)).alias("given"),
            F.coalesce(F.sum(F.when(~full, weight)), F.lit(0)).alias("open"),
        ).first()
        if row.n == n_full or not row.open:
            break
        share, n_full = weight * F.lit((total - row.given) / row.open), row.n
        full = share >= full_size
    target = F.when(full, full_size.cast("double")).otherwise(share)
    return placed.withColumn("target", target).drop("_same", "_place", "_weight")


class _Flow:
    """Largest flow of whole words from patterns to sources, enlarged step by step."""

    def __init__(self, n: int):
        self.edges: list[list[int]] = []  # target, capacity; the reverse edge is next to it
        self.at: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, capacity: int) -> int:
        self.at[a].append(len(self.edges))
        self.at[b].append(len(self.edges) + 1)
        self.edges += [[b, capacity], [a, 0]]
        return len(self.edges) - 2

    def _levels(self, source: int, sink: int) -> dict[int, int]:
        """Steps from the source to the nodes that can still be reached, up to the sink."""
        level, queue = {source: 0}, deque([source])
        while queue and sink not in level:
            node = queue.popleft()
            for e in self.at[node]:
                target, capacity = self.edges[e]
                if capacity and target not in level:
                    level[target] = level[node] + 1
                    queue.append(target)
        return level

    def fill(self, source: int, sink: int) -> None:
        """Block all shortest paths at once, as long as there are any."""
        while sink in (level := self._levels(source, sink)):
            following = {node: iter(self.at[node]) for node in level}
            path, node = [], source
            while True:
                if node == sink:
                    amount = min(self.edges[e][1] for e in path)
                    for e in path:
                        self.edges[e][1] -= amount
                        self.edges[e ^ 1][1] += amount
                    cut = next(i for i, e in enumerate(path) if not self.edges[e][1])
                    node = self.edges[path[cut] ^ 1][0]
                    following[node] = iter([path[cut], *following[node]])
                    path = path[:cut]
                step = next(
                    (e for e in following[node] if self.edges[e][1] and level.get(self.edges[e][0]) == level[node] + 1),
                    None,
                )
                if step is not None:
                    path.append(step)
                    node = self.edges[step][0]
                elif path:
                    node = self.edges[path.pop() ^ 1][0]
                else:
                    break


def given(
    patterns: dict[tuple, int], quotas: dict[str | None, int], most: int = MOST
) -> dict[tuple, int]:
    """Words each pattern gives so that quotas are met, by cheapest flow.

    All patterns cost the same, more for each time over, and giving to one source or
    another costs nothing; so the cheapest flow is the largest that takes every pattern
    once, enlarged with second times, and so on.
    """
    rest = list(patterns)
    names = sorted({s for p in rest for s in p}, key=lambda s: (s is None, s or ""))
    begin, end = len(rest) + len(names), len(rest) + len(names) + 1
    node = {s: len(rest) + i for i, s in enumerate(names)}
    flow = _Flow(end + 1)
    for s in names:
        flow.edge(node[s], end, quotas[s])
    supply = [flow.edge(begin, i, 0) for i, _ in enumerate(rest)]
    for i, p in enumerate(rest):
        for s in p:
            flow.edge(i, node[s], most * patterns[p])
    for _ in range(most):
        for i, p in enumerate(rest):
            flow.edges[supply[i]][1] += patterns[p]
        flow.fill(begin, end)
    return {p: flow.edges[supply[i] ^ 1][1] for i, p in enumerate(rest)}


def _solved(table: pa.Table, quotas: pa.Table, most: int) -> pa.Table:
    """``amount``, the words that each pattern of some groups of sources gives."""
    wanted = dict(zip(quotas.column("source").to_pylist(), quotas.column("quota").to_pylist(), strict=True))
    names = [tuple(p) for p in table.column("sources").to_pylist()]
    found = given(dict(zip(names, table.column("size").to_pylist(), strict=True)), wanted, most)
    sources = pa.array([list(p) for p in names], pa.list_(pa.string()))
    amounts = pa.array([found[p] for p in names], pa.int64())
    return pa.table({"sources": sources, "size": table.column("size"), "amount": amounts})


def _amounts(patterns: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """``sources``, ``size`` and ``amount`` of every pattern.

    A source that no pattern shares gives its quota, or all it has ``most`` times over.
    The others are grouped by what connects them, and each group is solved in one task.
    """
    quota = F.floor(F.col("target") + 0.5).alias("quota")
    node = F.xxhash64(_key(F.col("source")))
    nodes = wanted.select("source", quota, node.alias("node"), _key(F.col("source")).alias("key"))
    pairs = F.transform(F.col("sources"), lambda s: F.xxhash64(_key(s)))
    shared = patterns.where(F.size("sources") > 1).withColumn("nodes", pairs)
    if shared.isEmpty():
        linked = None
    else:
        links = shared.select(F.get("nodes", F.lit(0)).alias("a"), F.explode("nodes").alias("b"))
        linked = components(links).withColumnRenamed("node", "linked")
        nodes = nodes.join(linked, F.col("node") == F.col("linked"), "left").checkpoint()
    first = patterns.withColumn("first", _key(F.get("sources", F.lit(0))))
    joined = first.join(nodes, F.col("first") == F.col("key"))
    single = F.least(F.col("quota"), F.col("size") * most)
    if linked is None:
        return joined.select("sources", "size", single.alias("amount"))
    joined = joined.checkpoint()
    alone = joined.where("root is null").select("sources", "size", single.alias("amount"))
    n = max(1, -(-patterns.count() // PATTERNS_A_TASK))
    task = F.pmod(F.xxhash64("root"), F.lit(n)).alias("task")
    together = joined.where("root is not null").select(task, "sources", "size").groupBy("task")
    quotas = nodes.where("root is not null").select(task.alias("of"), "source", "quota").groupBy("of")
    solve = lambda table, quotas: _solved(table, quotas, most)
    solved = together.cogroup(quotas).applyInArrow(solve, "sources array<string>, size bigint, amount bigint")
    return alone.unionByName(solved)


def _plan(patterns: DataFrame, weights, most) -> DataFrame:
    """For each pattern the words of its first source, that source's target, and how many
    words the pattern gives as whole rounds (``rounds``) and beyond (``rest``)."""
    each = patterns.select(F.explode("sources").alias("source"), "size")
    sizes = each.groupBy("source").agg(F.sum("size").alias("source_size")).checkpoint()
    total = patterns.agg(F.sum("size")).first()[0] or 0
    wanted = targets(sizes, total, weights, most).checkpoint()
    amounts = _amounts(patterns, wanted, most).withColumn("first", _key(F.get("sources", F.lit(0))))
    named = wanted.select(_key(F.col("source")).alias("first"), "source_size", "target")
    some = F.col("size") > 0
    return amounts.join(named, "first").select(
        F.col("sources").alias("plan_sources"),
        "source_size",
        "target",
        F.when(some, F.expr("amount div size")).otherwise(0).alias("rounds"),
        F.when(some, F.expr("amount % size")).otherwise(0).alias("rest"),
    )


def mix(
    docs: DataFrame,
    keep: list[str],
    sources: Column | None = None,
    weights: tuple = WEIGHTS,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """``row`` (the columns ``keep`` of ``docs``), ``size`` in words, ``source_size``,
    ``target``, and the words ``taken``, repeats counted.

    ``sources`` are the names a document counts for (by default its ``source``); figures
    of sources are those of the first by code point. Whole documents are taken, 0 to
    ``most`` times, but for one document of each pattern, which is cut where the quota
    ends. The order is the MD5 of ``doc_id`` and ``seed``; rows equal in ``doc_id`` go by
    size and a hash of the text. A null text has no words, a null source is a source of its own, a null
    ``doc_id`` counts as an empty one. A text of any length is one document. An empty table
    gives no rows.
    """
    shared_folder(docs.sparkSession)
    sources = F.array(docs.source.cast("string")) if sources is None else sources
    order = F.md5(F.concat(F.coalesce(docs.doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    items = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"),
        F.array_sort(F.array_distinct(sources)).alias("sources"),
        word_count(docs.text).alias("size"),
        order.alias("order"),
        F.substring(order, 1, BUCKET_DIGITS).alias("bucket"),
        F.xxhash64(docs.text).alias("tie"),
    )
    buckets = items.groupBy("sources", "bucket").agg(F.sum("size").alias("bucket_size"))
    buckets = buckets.checkpoint()
    patterns = buckets.groupBy("sources").agg(F.sum("bucket_size").alias("size")).checkpoint()
    plan = _plan(patterns, weights, most)
    earlier = Window.partitionBy("sources").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = buckets.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    offsets = offsets.join(plan, F.col("sources") == F.col("plan_sources"))
    inside = (
        Window.partitionBy("sources", "bucket")
        .orderBy("order", "size", "tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return (
        items.join(offsets.drop("bucket_size", "plan_sources"), ["sources", "bucket"])
        .withColumn("before", before)
        .withColumn("taken", F.col("rounds") * F.col("size") + cut)
        .select("row", "size", "source_size", "target", "taken")
    )


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them, with their columns as they were.

    Documents stay whole: one that the mix cuts is in if half of it or more is.
    """
    mixed = mix(docs, docs.columns, **options).where("taken > 0")
    times = F.floor(F.try_divide("taken", "size") + 0.5).cast("int")
    copies = F.explode(F.array_repeat(F.lit(True), times)).alias("copy")
    return mixed.select("row", copies).select("row.*")


SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':1') AS place
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER o AS i,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0))::DOUBLE AS words_left,
    (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0))::DOUBLE AS weight_left
  FROM s WINDOW o AS (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST)
), f AS (
  SELECT coalesce(min(i), 1000000000) AS i FROM r
  WHERE weight * (words_left / weight_left) < 3 * source_size
), t AS (
  SELECT source, source_size,
    CASE WHEN i < (SELECT i FROM f) THEN (3 * source_size)::DOUBLE
    ELSE weight * (SELECT words_left / weight_left FROM r WHERE i = (SELECT i FROM f)) END AS target
  FROM r
), w AS (
  SELECT *, floor(target + 0.5)::BIGINT AS words FROM t
), c AS (
  SELECT doc_id, size, source_size, target, words,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size
    + greatest(0, least(size, words % source_size - before)) END::BIGINT AS taken
FROM c
"""
