"""Prefix trie of conversations: shared prefixes as nodes, subtree sums by heavy-path decomposition.

Texts are hashed where they are read and never move. A node is named by its depth and the sums of its turns' hashes
with their places, so a conversation's nodes come from running sums. Heavy paths: every node keeps the child with the
most members; any other child has at most half of its parent's members, so a node lies below at most
``log2(conversations)`` light edges. Values along a path are suffix sums over its array, and finished light paths are
attached to their parents level by level, deepest first, in that many rounds over a table of one row a path.

Nothing ordered is one task by its key: places, running sums and suffix sums are taken in stretches of ``BLOCK``, whose
few totals are run through apart; members of one end node are packed in ranges of ids before their digest is taken.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of one conversation, path or end node that are ordered together, as a power of two.
BITS = 12
BLOCK = 1 << BITS
#: A conversation takes over fewer turns than this from its group's first one; conversations of a group.
HEADS, GROUP = 6, 100
SLICES = ("h0", "h1", "h2", "h3")
NOTHING = hashlib.sha256(b"").hexdigest()
SCHEMA = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def _key(depth, sums, names=("k0", "k1")):
    """Two 64-bit halves of a node's name."""
    depth = depth.cast("bigint")
    return [F.xxhash64(depth, *sums).alias(names[0]), F.xxhash64(F.lit(1), *sums[::-1], depth).alias(names[1])]


def _read(conversations: DataFrame) -> DataFrame:
    """(conv, turn, h0..h3, len): hashes of role and text, and the text's code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), digest.alias("h"), F.length(text).cast("bigint").alias("len"))
    return rows.select("conv", "turn", *[F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("bigint").alias(c) for k, c in enumerate(SLICES)], "len")


def _stretched(rows: DataFrame) -> DataFrame:
    """Adds a, b: turns of one stretch, null turns first and in stretches of their hashes."""
    none = F.col("turn").isNull()
    return rows.withColumn("a", F.when(none, F.lit(-(1 << 60))).otherwise(F.shiftright("turn", BITS))).withColumn("b", F.when(none, F.shiftright("h0", 24)).otherwise(0))


def _places(at: DataFrame, stretches: DataFrame) -> DataFrame:
    """Adds pos, the turn's place from 1; ``stretches`` has (conv, a, b, before, ...)."""
    inside = Window.partitionBy("conv", "a", "b").orderBy(F.col("turn").asc_nulls_first(), *SLICES)
    return at.join(stretches, ["conv", "a", "b"]).withColumn("pos", F.row_number().over(inside) + F.col("before"))


def _counted(at: DataFrame) -> DataFrame:
    """(conv, a, b, before, n): rows of the conversation before a stretch, and of all of it."""
    counts = at.groupBy("conv", "a", "b").agg(F.count("*").alias("c"))
    w = Window.partitionBy("conv").orderBy("a", "b")
    return counts.select("conv", "a", "b", (F.sum("c").over(w) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy("conv")).alias("n"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv, depth, h0..h3, len, size): every conversation's rebuilt turns, depth 0 standing for the empty beginning."""
    at = _stretched(_read(conversations))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    base = F.col("conv") - F.col("conv") % GROUP
    first = _stretched(_read(conversations.where(F.col("conv_id").cast("bigint") % GROUP == 0)))
    first = _places(first, _counted(first)).where(F.col("pos") < HEADS).select(F.col("conv").alias("base"), "pos", *SLICES, "len", "n")
    found = first.groupBy("base").agg(F.max("n").alias("base_n"))
    stretches = _counted(at).withColumn("h", head).withColumn("base", base).join(found, "base", "left")
    stretches = stretches.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("size", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = _places(at, stretches.select("conv", "a", "b", "before", "h", "taken", "size")).where("pos > h")
    own = own.select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), *SLICES, "len", "size")
    convs = stretches.where("before = 0").select("conv", "base", "taken", "size")
    given = convs.where("taken > 0").join(first.drop("n"), "base").where("pos <= taken").select("conv", F.col("pos").cast("bigint").alias("depth"), *SLICES, "len", "size")
    empty = convs.select("conv", F.lit(0).cast("bigint").alias("depth"), *[F.lit(0).cast("bigint").alias(c) for c in SLICES], F.lit(0).cast("bigint").alias("len"), "size")
    return own.unionByName(given).unionByName(empty)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, k0, k1, p0, p1, len, last): names of the nodes that a conversation passes, and of their parents."""
    one, two = F.xxhash64(*SLICES, "depth"), F.xxhash64("depth", *SLICES[::-1])  # of a turn at its place, so that order counts
    low = lambda x: x.bitwiseAND(0xFFFFFFFF)
    placed = (low(one), F.shiftrightunsigned(one, 32), low(two), F.shiftrightunsigned(two, 32))
    at = turns.select("conv", "depth", "len", "size", *[x.alias(c) for x, c in zip(placed, SLICES, strict=True)], F.shiftright("depth", BITS).alias("block"))
    long = at.where(F.col("size") >= BLOCK).groupBy("conv", "block").agg(*[F.sum(c).alias(f"t_{c}") for c in SLICES])
    w = Window.partitionBy("conv").orderBy("block")
    before = long.select("conv", "block", *[(F.sum(f"t_{c}").over(w) - F.col(f"t_{c}")).alias(f"b_{c}") for c in SLICES])
    inside = Window.partitionBy("conv", "block").orderBy("depth")
    sums = at.join(before, ["conv", "block"], "left").select("conv", "depth", "len", "size", *SLICES, *[(F.sum(c).over(inside) + F.coalesce(f"b_{c}", F.lit(0))).alias(f"s_{c}") for c in SLICES])
    now = [F.col(f"s_{c}") for c in SLICES]
    return sums.select("conv", "depth", *_key(F.col("depth"), now), *_key(F.col("depth") - 1, [F.col(f"s_{c}") - F.col(c) for c in SLICES], ("p0", "p1")), "len", (F.col("depth") == F.col("size")).alias("last"))


def _digests(batches):
    """SHA-256 of each node's packed ids, which come in order; a node may span batches."""
    node, state = None, None
    for batch in batches:
        done = []
        for k0, k1, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node == (k0, k1):
                state.update(b"," + ids.encode())
            else:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (k0, k1), hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["e0", "e1", "ends"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], ["e0", "e1", "ends"])


def _ends(rows: DataFrame) -> DataFrame:
    """(e0, e1, ends): digest of the conversations that end at a node; ids meet in ranges of BLOCK first."""
    packed = rows.where("last").groupBy("k0", "k1", F.shiftright("conv", BITS).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    return packed.repartition("k0", "k1").sortWithinPartitions("k0", "k1", "range").select("k0", "k1", "ids").mapInArrow(_digests, "e0 bigint, e1 bigint, ends string")


def _on_paths(rows: DataFrame) -> DataFrame:
    """Nodes with their heavy path (q0, q1: its top node), level (light edges above) and, for tops, the path above."""
    nodes = rows.groupBy("k0", "k1").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("depth", "p0", "p1", "len")])
    child = nodes.where("depth > 0").groupBy(F.col("p0").alias("c0"), F.col("p1").alias("c1")).agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", -F.col("conv"), "k0", "k1")).alias("heavy"))
    ends = _ends(rows)
    full = nodes.join(child, (F.col("k0") == F.col("c0")) & (F.col("k1") == F.col("c1")), "left").join(ends, (F.col("k0") == F.col("e0")) & (F.col("k1") == F.col("e1")), "left")
    full = full.select("k0", "k1", "p0", "p1", "depth", "conv", "n_convs", "len", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("heavy.k0").alias("w0"), F.col("heavy.k1").alias("w1"), "ends")
    # The root may own a third of all nodes: its one row goes to its children as literals, not by a join.
    tops = rows.where("depth = 1").groupBy("k0", "k1").agg(F.count("*").alias("n"), F.min("conv").alias("conv")).orderBy(F.desc("n"), "conv").limit(1).collect()
    root = rows.where("depth = 0").agg(F.min("conv").alias("conv"), F.min("k0").alias("k0"), F.min("k1").alias("k1")).first()
    high = (F.col("k0") != F.lit(tops[0]["k0"])) | (F.col("k1") != F.lit(tops[0]["k1"])) if tops else F.lit(False)
    kept = ["k0", "k1", "depth", "conv", "n_convs", "len", "n_children", "ends"]
    near = full.where("depth <= 1").select(*kept, F.when(F.col("depth") == 1, F.lit(root["conv"])).cast("bigint").alias("parent"), ((F.col("depth") == 1) & high).alias("light"))
    above = full.where("depth > 0 and n_children > 0").select(F.col("k0").alias("u0"), F.col("k1").alias("u1"), F.col("conv").alias("parent"), "w0", "w1")
    far = full.where("depth > 1").drop("w0", "w1").join(above, (F.col("p0") == F.col("u0")) & (F.col("p1") == F.col("u1"))).select(*kept, "parent", ((F.col("k0") != F.col("w0")) | (F.col("k1") != F.col("w1"))).alias("light"))
    nodes = cut(near.unionByName(far))
    # A node's path is the last light node at or above it, all of which its smallest member passes too: few for each conversation.
    tops = nodes.where("light").select(F.col("k0").alias("t0"), F.col("k1").alias("t1"))
    passed = rows.where("depth > 0").select("conv", "depth", "k0", "k1").join(tops, (F.col("k0") == F.col("t0")) & (F.col("k1") == F.col("t1")))
    passed = passed.groupBy(F.col("conv").alias("owner")).agg(F.sort_array(F.collect_list(F.struct("depth", "k0", "k1"))).alias("tops"))
    start = F.array(F.struct(F.lit(0).cast("bigint").alias("depth"), F.lit(root["k0"]).cast("bigint").alias("k0"), F.lit(root["k1"]).cast("bigint").alias("k1")))
    mine = F.filter(F.concat(start, F.coalesce("tops", F.array().cast("array<struct<depth:bigint,k0:bigint,k1:bigint>>"))), lambda t: t["depth"] <= F.col("depth"))
    at = nodes.join(passed, F.col("conv") == F.col("owner"), "left").withColumn("mine", mine)
    own, over = F.element_at("mine", -1), F.when(F.col("light"), F.try_element_at("mine", F.lit(-2)))
    return at.select(*kept, "parent", "light", own["k0"].alias("q0"), own["k1"].alias("q1"), (F.size("mine") - 1).alias("level"), over["k0"].alias("o0"), over["k1"].alias("o1"))


def _attached(nodes: DataFrame) -> DataFrame:
    """(q0, q1, depth, leaves, saved): what finished light paths add to the nodes that they hang on, over logarithmic rounds."""
    paths = nodes.groupBy("q0", "q1").agg(
        F.max("level").alias("level"), F.sum(F.col("leaf")).alias("leaves"), F.sum("saved").alias("saved"), F.max("o0").alias("o0"), F.max("o1").alias("o1"), F.min("depth").alias("top")
    )
    paths = cut(paths)
    deepest = paths.agg(F.max("level")).first()[0] or 0
    found: list[DataFrame] = []
    for level in range(deepest, 0, -1):
        now = paths.where(F.col("level") == level)
        if found:
            more = found[-1].groupBy(F.col("q0").alias("m0"), F.col("q1").alias("m1")).agg(F.sum("leaves").alias("ml"), F.sum("saved").alias("ms"))
            now = now.join(more, (F.col("q0") == F.col("m0")) & (F.col("q1") == F.col("m1")), "left")
            now = now.withColumn("leaves", F.col("leaves") + F.coalesce("ml", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("ms", F.lit(0)))
        found.append(cut(now.groupBy(F.col("o0").alias("q0"), F.col("o1").alias("q1"), (F.col("top") - 1).alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))))
    out = paths.select("q0", "q1", F.col("top").alias("depth"), "leaves", "saved").where("false")
    for part in found:
        out = out.unionByName(part)
    return out.groupBy("q0", "q1", "depth").agg(F.sum("leaves").alias("leaf"), F.sum("saved").alias("saved"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct beginning of the rebuilt conversations, the empty one (root) included.

    Columns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Rows of a null conv_id belong to no conversation and are left out; a null turn comes first; a null role or text is
    empty. Equal turns of one conversation, repeated rows too, stand side by side in the order of their hashes (any
    order of equal rows is the same). Negative ids belong to the group towards zero. Long texts and long conversations
    are whole. An empty table has no conversation and so no root. Further columns are not looked at.
    """
    rows = cut(prefixes(rebuilt(conversations)))
    if rows.isEmpty():
        return conversations.sparkSession.createDataFrame([], SCHEMA)
    nodes = _on_paths(rows).withColumn("leaf", (F.col("n_children") == 0).cast("bigint")).withColumn("saved", (F.col("n_convs") - 1) * F.col("len")).drop("len")
    nodes = cut(nodes)
    both = nodes.withColumn("node", F.lit(True)).unionByName(_attached(nodes).withColumn("node", F.lit(False)), allowMissingColumns=True).withColumn("block", F.shiftright("depth", BITS))
    below = Window.partitionBy("q0", "q1").orderBy(F.desc("block"))
    long = both.where(F.col("block") > 0).groupBy("q0", "q1", "block").agg(F.sum("leaf").alias("l"), F.sum("saved").alias("s"))
    long = long.select("q0", "q1", (F.col("block") - 1).alias("block"), F.sum("l").over(below).alias("more_l"), F.sum("s").over(below).alias("more_s"))
    suffix = Window.partitionBy("q0", "q1", "block").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, 0)
    total = lambda c, more: (F.sum(c).over(suffix) + F.coalesce(more, F.lit(0))).cast("bigint")
    out = both.join(long, ["q0", "q1", "block"], "left").withColumn("n_leaves", total("leaf", "more_l")).withColumn("saved_tokens", total("saved", "more_s")).where("node")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))


#: Every conversation's prefixes as texts of digests, and every pair of a prefix and a longer one of the same conversation.
ORACLE = f"""
WITH t AS (SELECT conv_id AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT c, d, n, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS pos FROM t),
convs AS (SELECT c, c - c % {GROUP} AS base, xor(4294967295, list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda x: x::UBIGINT)), lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))) % {HEADS} AS h FROM (SELECT DISTINCT c FROM t)),
turns AS (SELECT convs.c, 0 AS own, p.pos, p.d, p.n FROM convs JOIN p ON p.c = convs.base AND p.pos <= convs.h UNION ALL SELECT convs.c, 1, p.pos, p.d, p.n FROM convs JOIN p ON p.c = convs.c AND p.pos > convs.h),
line AS (SELECT c, row_number() OVER w AS depth, string_agg(d, '') OVER w AS k, n FROM turns WINDOW w AS (PARTITION BY c ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT c, depth, k, n FROM line UNION ALL SELECT c, 0, '', 0 FROM convs),
size AS (SELECT c, max(depth) AS top FROM whole GROUP BY c),
nodes AS (SELECT k, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n, left(k, length(k) - 64) AS up FROM whole GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
ends AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS e FROM whole JOIN size USING (c) WHERE depth = top GROUP BY k),
under AS (SELECT DISTINCT a.k, b.k AS low FROM whole a JOIN whole b ON a.c = b.c AND b.depth >= a.depth),
sums AS (SELECT under.k, count(*) FILTER (WHERE kids.k IS NULL) AS n_leaves, sum((nodes.n_convs - 1) * nodes.n) AS saved FROM under JOIN nodes ON nodes.k = under.low LEFT JOIN kids ON kids.k = under.low GROUP BY under.k)
SELECT nodes.conv_id, nodes.depth, CASE WHEN nodes.depth > 0 THEN u.conv_id END AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM nodes JOIN sums ON sums.k = nodes.k LEFT JOIN kids ON kids.k = nodes.k LEFT JOIN ends ON ends.k = nodes.k LEFT JOIN nodes u ON nodes.depth > 0 AND u.k = nodes.up
"""
