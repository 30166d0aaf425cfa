"""Tries of conversation prefixes, packed in double arrays.

Conversations with the same turns are first reduced to one sequence with a weight. The
sequences are dealt into shards by a prefix, a longer one where a prefix is too frequent
for one shard. A shard numbers its turns densely, packs its trie into the arrays BASE and
CHECK (from slot s, the turn with number c leads to slot BASE[s] + c if CHECK there is s)
and walks all its sequences through them. Nodes above the cut of a prefix lie in several
shards; their sums are merged over all shards.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthgrain.llm.words import BASE, mixed
from growthgrain.session import shared_folder

#: A conversation begins like the first of its hundred, for 0 to 5 turns.
BLOCK, WAYS = 100, 6
#: Turns of distinct sequences that a prefix may have in one shard.
SHARD_TURNS = 1 << 18
#: Prefixes of fewer turns are not cut, however many tasks there are.
LEAST_TURNS = 512
#: Conversation numbers that are joined to one text before they meet the rest.
ID_BLOCK = 1024
#: Tables up to this many rows of a few numbers each are sent to all executors.
FEW_ROWS = 1_000_000
NOBODY = hashlib.sha256(b"").hexdigest()
SECOND_BASE = 0xD1B54A32D192ED03

NODES = (
    "shared boolean, key binary, parent_key binary, ancestors array<binary>, conv_id bigint, "
    "depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, chars bigint, ends_sha256 string"
)
RESULT = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
]


def shared_turns(conv_id: Column, ways: int = WAYS) -> Column:
    """How many turns a conversation takes from the first of its block."""
    return F.crc32(conv_id.cast("string").cast("binary")) % ways


def rebuilt(turns: DataFrame, block: int = BLOCK, ways: int = WAYS) -> DataFrame:
    """``conv_id`` and ``path``, its turns as (``one``, ``other``, ``chars``): two hashes of
    role and text, and the length of the text.

    The turns of a conversation and of the first one of its block meet in one exchange,
    without their texts.
    """
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (turns.role, turns.text))
    conv_id = turns.conv_id.cast("bigint")
    rows = turns.where(turns.conv_id.isNotNull()).select(
        (conv_id - conv_id % block).alias("block"),
        conv_id.alias("conv_id"),
        F.struct(
            turns.turn.isNotNull().alias("numbered"),
            turns.turn.alias("turn"),
            F.xxhash64(role, text).alias("one"),
            F.xxhash64(text, F.lit(1), role).alias("other"),
            F.length(text).alias("chars"),
        ).alias("this"),
    )
    whole = rows.repartition("block").groupBy("block", "conv_id")
    whole = whole.agg(F.array_sort(F.collect_list("this")).alias("own"))
    first = F.when(F.col("conv_id") == F.col("block"), F.slice("own", 1, ways - 1))
    donor = F.max(first).over(Window.partitionBy("block"))
    whole = whole.withColumn("donor", F.coalesce(donor, F.slice("own", 1, 0)))
    h = shared_turns(F.col("conv_id"), ways).cast("int")
    path = F.concat(
        F.slice("donor", F.lit(1), h), F.slice("own", h + F.lit(1), F.size("own"))
    )
    return whole.select(
        "conv_id", F.transform(path, lambda t: F.struct(t["one"], t["other"], t["chars"])).alias("path")
    )


def _keyed(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.xxhash64("path").alias("one"),
        F.xxhash64(F.lit(1), F.col("path")).alias("other"),
        "conv_id",
        "path",
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined numbers of each key; the rows of a key follow each other, and
    only the state of the digest is held."""
    key, state = None, None
    for batch in batches:
        done = []
        ones, others, texts = (batch.column(c).to_pylist() for c in ("one", "other", "ids"))
        for one, other, text in zip(ones, others, texts, strict=True):
            if key == (one, other):
                state.update(b",")
            else:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (one, other), hashlib.sha256()
            state.update(text.encode())
        yield _digest_rows(done)
    if key is not None:
        yield _digest_rows([(*key, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"one": pa.int64(), "other": pa.int64(), "ends_sha256": pa.string()}
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]
    return pa.RecordBatch.from_arrays(columns, names=list(kinds))


def sequences(conversations: DataFrame) -> DataFrame:
    """One row per distinct ``path``: ``n`` conversations, ``least`` their smallest number,
    and ``ends_sha256`` of all their numbers.

    Any number of copies leaves each task as one row. For the digest, numbers are joined
    in blocks before those of one sequence follow each other through a task.
    """
    keyed = _keyed(conversations)
    found = keyed.groupBy("one", "other").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("path").alias("path")
    )
    numbers = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    blocks = keyed.groupBy("one", "other", F.floor(F.col("conv_id") / ID_BLOCK).alias("at"))
    blocks = blocks.agg(F.array_join(numbers, ",").alias("ids"))
    digests = (
        blocks.repartition("one", "other")
        .sortWithinPartitions("one", "other", "at")
        .select("one", "other", "ids")
        .mapInArrow(_digests, "one bigint, other bigint, ends_sha256 string")
    )
    return found.join(digests, ["one", "other"])


def _prefix() -> Column:
    return F.xxhash64("cut", F.slice("path", F.lit(1), F.col("cut")))


def _sendable(small: DataFrame) -> DataFrame:
    """``small`` for a join: sent whole if it is counted and few, else left to a shuffle."""
    return F.broadcast(small) if small.limit(FEW_ROWS + 1).count() <= FEW_ROWS else small


def _branches(sequences_of_hot: DataFrame) -> DataFrame:
    """``hot`` and ``next``, the length at which the sequences of a prefix first differ: the
    first place at which the smallest and the largest of them do."""
    ends = sequences_of_hot.groupBy("hot").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    same = F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y))
    return ends.select("hot", F.array_position(same, False).cast("int").alias("next"))


def sharded(distinct: DataFrame, shard_turns: int = SHARD_TURNS, least_turns: int = LEAST_TURNS) -> DataFrame:
    """``distinct`` with ``cut``, a length at which the prefix of a sequence is not too
    frequent, and ``shard``, which follows from that prefix.

    Too frequent are ``shard_turns``, or twice the fair share of a task where that is less.
    Such a prefix is cut where its sequences first differ, and so on, a round for each
    such place on the way down.
    """
    total = distinct.agg(F.sum(F.size("path") + 1)).first()[0] or 0
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(shard_turns, max(least_turns, 2 * total // tasks))
    distinct, round_ = distinct.withColumns({"cut": F.lit(1), "round": F.lit(0)}), 0
    while True:
        again = (F.col("round") == round_) & (F.size("path") >= F.col("cut"))
        turns, n = F.sum(F.size("path") + 1).alias("turns"), F.count("*").alias("n")
        hot = distinct.where(again).groupBy(_prefix().alias("hot")).agg(turns, n)
        hot = hot.where((F.col("turns") > most) & (F.col("n") > 1)).select("hot").checkpoint()
        if hot.isEmpty():
            break
        keyed = distinct.withColumn("own", F.when(again, _prefix()))
        there = keyed.join(_sendable(hot), F.col("own") == F.col("hot"))
        branches = _branches(there.select("hot", "path")).checkpoint()
        moved = keyed.join(_sendable(branches), F.col("own") == F.col("hot"), "left")
        distinct = moved.withColumns(
            {"cut": F.coalesce("next", "cut"), "round": F.col("round") + F.col("next").isNotNull().cast("int")}
        )
        distinct, round_ = distinct.drop("own", "hot", "next").checkpoint(), round_ + 1
    n_shards = max(-(-total // shard_turns), tasks)
    shard = F.pmod(_prefix(), F.lit(n_shards)).cast("int")
    return distinct.drop("round").withColumn("shard", shard)


class Shape:
    """The nodes of a trie by breadth: ``parent``, ``code`` (the dense number of the turn)
    and ``depth`` of each, the root first, so children of a node follow each other."""

    def __init__(self, code: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        kinds = int(code.max(initial=0)) + 1
        at = np.zeros(len(sizes), np.int64)
        parents, codes, firsts, self.levels = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [], [0, 1]
        for d in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-sizes, -d, "left"))
            here = starts[:live] + d
            steps, first, back = np.unique(
                at[:live] * kinds + code[here], return_index=True, return_inverse=True
            )
            parents.append(steps // kinds)
            codes.append(steps % kinds)
            firsts.append(here[first])
            at[:live] = self.levels[-1] + back
            self.levels.append(self.levels[-1] + len(steps))
        self.parent = np.concatenate(parents)
        self.first = np.concatenate([np.zeros(1, np.int64), *firsts])
        self.depth = np.repeat(np.arange(len(self.levels) - 1), np.diff(self.levels))
        # numbers in the order of first use, so those of siblings lie close together
        code = np.concatenate(codes)
        used, seen = np.unique(code[1:], return_index=True)
        self.number = np.zeros(kinds, np.int64)
        self.number[used[np.argsort(seen)]] = np.arange(1, len(used) + 1)
        self.code = self.number[code]
        self.code[0] = 0

    def __len__(self) -> int:
        return len(self.parent)


#: Places looked at for one node before the search goes on from there for all.
TRIES = 256


def bases(shape: Shape) -> np.ndarray:
    """For each node the number to add to the codes of its children, so that all nodes
    get different slots. Nodes with several children go first, those with most of them
    before the others; single children then fill the slots left between."""
    first = np.searchsorted(shape.parent[1:], np.arange(len(shape) + 1)) + 1
    n_children = np.diff(first)
    base = np.zeros(len(shape), np.int64)
    taken = np.zeros(2 * len(shape) + int(shape.code.max(initial=0)) + 2, bool)
    taken[0] = True
    low, top = 1, 1
    wide = np.flatnonzero(n_children > 1)
    for node in wide[np.argsort(-n_children[wide], kind="stable")]:
        codes = np.sort(shape.code[first[node] : first[node] + n_children[node]])
        need = top + int(codes[-1] - codes[0]) + TRIES + 2
        if need > len(taken):
            taken = np.concatenate([taken, np.zeros(max(need - len(taken), len(taken)), bool)])
        at = low + np.flatnonzero(~taken[low : low + TRIES])
        rows = max(1, (1 << 16) // len(codes))
        at = at[at <= top][:rows]
        fits = ~taken[at[:, None] + (codes - codes[0])].any(axis=1) if len(at) else np.zeros(0, bool)
        if fits.any():
            begin = int(at[np.argmax(fits)])
        else:
            begin, low = top, max(low, min(low + TRIES, top))
        base[node] = begin - codes[0]
        taken[base[node] + codes] = True
        top = max(top, int(base[node] + codes[-1]) + 1)
    single = np.flatnonzero(n_children == 1)
    free = np.flatnonzero(~taken)
    if len(free) < len(single):
        free = np.concatenate([free, len(taken) + np.arange(len(single) - len(free))])
    base[single] = free[: len(single)] - shape.code[first[single]]
    return base


class DoubleArray:
    """BASE and CHECK of a trie; the root is in slot 0. ``slot`` has the slot of each node."""

    def __init__(self, shape: Shape):
        base = bases(shape)
        self.slot = base[shape.parent] + shape.code
        self.slot[0] = 0
        size = int(self.slot.max()) + 1
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.base[self.slot] = base
        self.check[self.slot] = self.slot[shape.parent]

    def step(self, slots: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The slots that turns lead to from slots; -1 where there is no such child."""
        to = self.base[slots] + codes
        there = (to > 0) & (to < len(self.check))
        there &= self.check[np.where(there, to, 0)] == slots
        return np.where(there, to, -1)


def _dense(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 that are equal where both hashes are."""
    order = np.lexsort((other, one))
    new = (np.diff(one[order], prepend=0) != 0) | (np.diff(other[order], prepend=0) != 0)
    new[:1] = False
    dense = np.empty(len(one), np.int64)
    dense[order] = np.cumsum(new)
    return dense


def _node_keys(shape: Shape, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Two hashes of the turns from the root to each node, the same in every shard."""
    keys = np.zeros((len(shape), 2), np.uint64)
    for a, b in zip(shape.levels[1:], shape.levels[2:], strict=False):
        before, turn = keys[shape.parent[a:b]], shape.first[a:b]
        keys[a:b, 0] = mixed(before[:, 0] * np.uint64(BASE) + one[turn])
        keys[a:b, 1] = mixed(before[:, 1] * np.uint64(SECOND_BASE) + other[turn] + np.uint64(1))
    return keys


def shard_nodes(table: pa.Table) -> pa.Table:
    """The nodes of a shard. ``shared`` ones hold what this shard adds to them; there,
    children, leaves and saved tokens are those of the nodes hung on that are not shared."""
    paths = table.column("path").combine_chunks()
    sizes = paths.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    turns = paths.flatten()
    one, other, chars = (turns.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    longest = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[longest]
    sizes = sizes[longest]
    weight, least, cut = (table.column(c).to_numpy()[longest] for c in ("n", "least", "cut"))
    dense = _dense(one, other)
    shape = Shape(dense, starts, sizes)
    trie = DoubleArray(shape)
    code = shape.number[dense]

    slots = len(trie.check)
    count, member = np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max)
    shared = np.zeros(slots, bool)
    count[0], member[0], shared[0] = weight.sum(), least.min(), True
    at = np.zeros(len(sizes), np.int64)
    for d in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -d, "left"))
        at[:live] = trie.step(at[:live], code[starts[:live] + d])
        np.add.at(count, at[:live], weight[:live])
        np.minimum.at(member, at[:live], least[:live])
        shared[at[:live][cut[:live] > d + 1]] = True
    if (at < 0).any():
        raise ValueError("a sequence is not in its trie")

    slot, parent = trie.slot, trie.slot[shape.parent]
    own = ~shared
    children, leaves, saved = (np.zeros(slots, np.int64) for _ in range(3))
    length = np.zeros(slots, np.int64)
    length[slot[1:]] = chars[shape.first[1:]]
    np.add.at(children, parent[1:], own[slot[1:]])
    leaves[slot] = own[slot] & (children[slot] == 0)
    saved[slot] = np.where(own[slot], (count[slot] - 1) * length[slot], 0)
    for a, b in reversed(list(zip(shape.levels[1:], shape.levels[2:], strict=False))):
        whole = a + np.flatnonzero(own[slot[a:b]])  # shared ones are added up over all shards
        np.add.at(leaves, parent[whole], leaves[slot[whole]])
        np.add.at(saved, parent[whole], saved[slot[whole]])

    keys = _node_keys(shape, one.view(np.uint64), other.view(np.uint64))
    named = shared[slot] | shared[parent]
    key = [k.tobytes() if wanted else None for k, wanted in zip(keys, named, strict=True)]
    above = np.flatnonzero(shared[slot])
    ancestors: dict[int, list] = {0: []}
    for node in above[1:]:
        up = int(shape.parent[node])
        ancestors[int(node)] = [*ancestors[up], key[up]]
    digests = np.full(slots, None, object)
    digests[at] = np.array(table.column("ends_sha256").to_pylist(), object)[longest]
    top = np.arange(len(shape)) == 0
    known = ~shared[parent] & ~top
    columns = {
        "shared": pa.array(shared[slot]),
        "key": pa.array([k if s else None for k, s in zip(key, shared[slot], strict=True)], pa.binary()),
        "parent_key": pa.array(
            [key[p] if s and i else None for i, (p, s) in enumerate(zip(shape.parent, shared[parent], strict=True))],
            pa.binary(),
        ),
        "ancestors": pa.array([ancestors.get(i) for i in range(len(shape))], pa.list_(pa.binary())),
        "conv_id": pa.array(member[slot]),
        "depth": pa.array(shape.depth),
        "parent_conv_id": pa.array(member[parent], mask=~known),
        "n_convs": pa.array(count[slot]),
        "n_children": pa.array(children[slot]),
        "n_leaves": pa.array(leaves[slot]),
        "saved_tokens": pa.array(saved[slot]),
        "chars": pa.array(length[slot]),
        "ends_sha256": pa.array(digests[slot].tolist(), pa.string()),
    }
    return pa.table(columns)


def _merged(parts: DataFrame) -> DataFrame:
    """The shared nodes, with the parts of all shards and of the shared nodes below added."""
    nodes = parts.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"),
        F.first("ancestors").alias("ancestors"),
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("chars").alias("chars"),
        F.max("ends_sha256").alias("ends_sha256"),
    )
    nodes = nodes.checkpoint()
    below = nodes.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("n_below"))
    nodes = nodes.join(below, "key", "left")
    nodes = nodes.withColumn("n_children", F.col("n_children") + F.coalesce("n_below", F.lit(0)))
    sums = nodes.select(
        F.explode(F.concat("ancestors", F.array("key"))).alias("key"),
        (F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint")).alias("leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    sums = sums.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    return nodes.drop("n_leaves", "saved_tokens").join(sums, "key")


def prefix_nodes(
    turns: DataFrame, shard_turns: int = SHARD_TURNS, least_turns: int = LEAST_TURNS
) -> DataFrame:
    """One row for each distinct beginning of the rebuilt conversations.

    Turns go by ``turn``, a missing one first, equal ones by a hash of role and text; a
    row that repeats another is a turn of its own. A missing role or text is empty. Rows
    without ``conv_id`` belong to no conversation. An empty table has no conversations
    and gives no rows, not even the root. Texts enter as hashes and lengths, so their
    length does not matter; further columns are not read. A conversation is held whole by
    one task, at some 20 bytes a turn.
    """
    shared_folder(turns.sparkSession)
    distinct = sequences(rebuilt(turns)).checkpoint()
    nodes = sharded(distinct, shard_turns, least_turns).groupBy("shard").applyInArrow(shard_nodes, NODES)
    nodes = nodes.checkpoint()
    shared = _merged(nodes.where("shared")).checkpoint()
    parents = _sendable(
        shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    )
    below = nodes.where("not shared and parent_key is not null").drop("parent_conv_id")
    found = nodes.where("not shared and parent_key is null").select(*RESULT)
    for part in (below.join(parents, "parent_key"), shared.join(parents, "parent_key", "left")):
        found = found.unionByName(part.select(*RESULT))
    return found.fillna({"ends_sha256": NOBODY})


SQL = """
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
    md5(coalesce(role, '') || chr(1) || coalesce(text, '')) AS turn_key,
    length(coalesce(text, ''))::BIGINT AS chars
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS donor,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1),
        lambda i: [ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384)
        ELSE crc // 2 END), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), spliced AS (
  SELECT ids.conv_id, 0 AS part, place, turn_key, chars
  FROM ids JOIN own ON own.conv_id = ids.donor AND own.place <= ids.h
  UNION ALL
  SELECT ids.conv_id, 1, place, turn_key, chars
  FROM ids JOIN own ON own.conv_id = ids.conv_id AND own.place > ids.h
), path AS (
  SELECT conv_id, chars, turn_key, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth
  FROM spliced
), members AS (
  SELECT conv_id, depth, chars,
    md5(string_agg(turn_key, '' ) OVER (PARTITION BY conv_id ORDER BY depth)) AS node
  FROM path
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM ids
), ends AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM members JOIN (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id) USING (conv_id, depth)
  GROUP BY node
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars
  FROM members GROUP BY node, depth
), linked AS (
  SELECT n.*, p.node AS parent, p.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN members m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1
  LEFT JOIN nodes p ON p.node = m.node
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY parent
), sums AS (
  SELECT m.node, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens,
    count(*) FILTER (WHERE c.node IS NULL) AS n_leaves
  FROM nodes n LEFT JOIN children c ON c.node = n.node
  JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth
  GROUP BY m.node
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM linked JOIN sums USING (node) LEFT JOIN children USING (node) LEFT JOIN ends USING (node)
"""
