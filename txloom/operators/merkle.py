"""Merkle trees and proofs as relations.

A subtree is one row (`subtree_rows`): the leaves, with who registered for them, come together in one shuffle; each level
is an expression over the level below, the proof (STUMP) one over the levels, its bytes one over the proof. Nothing is
taken apart and joined again. The proof needs no loop: which nodes it holds is a closed form of the registered offsets.
For every level the offsets above the registered leaves are needed; the proof holds their siblings, and the registered
leaves themselves at level 0. Offsets beyond the level's real nodes are marked as duplicates without a hash.

`tree_levels_by_shuffle`, `stump_nodes` and `encode_stumps` do the same node by node, for subtrees too large for a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txloom.functions.scalars import compact_size_hex, double_sha256_hex, let, sha256_hex

#: Levels a tree may have (2**MAX_HEIGHT leaves).
MAX_HEIGHT = 20
TREE = ["block_hash", "subtree_index"]


def subtree_arrays(leaves: DataFrame) -> DataFrame:
    """block_hash, subtree_index, height, n, hashes (raw hex by leaf index), subtree_hash (content address)."""
    packed = F.array_sort(F.collect_list(F.struct("leaf_index", "raw_hex")))
    out = leaves.groupBy(*TREE, "height").agg(packed.alias("_l"))
    out = out.select(*TREE, "height", F.expr("transform(_l, x -> x.raw_hex)").alias("hashes"))
    return out.withColumn("n", F.size("hashes")).withColumn("subtree_hash", sha256_hex(F.unhex(F.array_join("hashes", ""))))


def subtree_rows(leaves: DataFrame, registrations: DataFrame | None = None, key: str = "raw_hex") -> DataFrame:
    """block_hash, subtree_index, height, n, tree_height, hashes (binary, by leaf index) and found: the registered leaves
    (raw_hex, leaf_index, callbacks: url and token). Of equal hashes in a subtree only the last leaf counts.

    registrations: key, url, token; a txid's urls are bounded by the cap, so they travel as one array."""
    if registrations is None:
        leaves = leaves.withColumn("callbacks", F.lit(None).cast("array<struct<url:string,token:string>>"))
    else:
        who = registrations.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("url", "token"))).alias("callbacks"))
        leaves = leaves.join(who, key, "left")
    packed = F.array_sort(F.collect_list(F.struct(F.col("leaf_index").cast("int").alias("leaf_index"), "raw_hex", "callbacks")))
    rows = leaves.groupBy(*TREE, "height").agg(packed.alias("_l"))
    hit = F.array_sort(F.transform(F.filter("_l", lambda x: x["callbacks"].isNotNull()), lambda x: F.struct(x["raw_hex"].alias("raw_hex"), x["leaf_index"].alias("leaf_index"), x["callbacks"].alias("callbacks"))))
    last = let(hit, lambda h: F.filter(h, lambda x, i: (i == F.size(h) - 1) | (F.try_element_at(h, i + 2)["raw_hex"] != x["raw_hex"])))
    n = F.size("_l")
    return rows.select(*TREE, "height", n.alias("n"), tree_height(n).cast("int").alias("tree_height"), F.transform("_l", lambda x: F.unhex(x["raw_hex"])).alias("hashes"), last.alias("found"))


def double_sha256(b: Column) -> Column:
    """SHA-256 of SHA-256, from binary to binary."""
    return F.unhex(F.sha2(F.unhex(F.sha2(b, 256)), 256))


def _parents(below: Column) -> Column:
    def parent(i: Column) -> Column:
        left = F.element_at(below, i * 2 + 1)
        return double_sha256(F.concat(left, F.coalesce(F.try_element_at(below, i * 2 + 2), left)))

    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(below) + 1, 1) - 1), parent)


def with_levels(rows: DataFrame, height: int = MAX_HEIGHT) -> DataFrame:
    """rows with levels: an array (leaves first, root last) of the arrays of each level's hashes. height: a bound of the
    levels above the leaves; a tree that needs more raises an error."""
    small = F.when(F.col("tree_height") <= min(height, MAX_HEIGHT), F.col("tree_height")).otherwise(F.raise_error(F.lit("the tree is too high"))).cast("int")
    start = F.struct(F.col("hashes").alias("top"), F.array("hashes").alias("all"))

    def step(acc: Column, i: Column) -> Column:
        return let(_parents(acc["top"]), lambda up: F.struct(up.alias("top"), F.concat(acc["all"], F.array(up)).alias("all")))

    turns = F.slice(F.sequence(F.lit(0), F.lit(MAX_HEIGHT)), 1, small)
    return rows.withColumn("levels", F.aggregate(turns, start, step, lambda acc: acc["all"]))


def root_of(levels: Column, height: Column) -> Column:
    """The root's hex, from the levels of a row and its tree_height."""
    return F.lower(F.hex(F.element_at(F.element_at(levels, height + 1), 1)))


def _proof_level(levels: Column, own: Column, level: Column, above: bool = False) -> Column:
    """The proof's nodes at a level, in order. above: level 0 holds no leaves, but nodes like those of all other levels."""
    real = F.element_at(levels, level + 1)

    def node(flag: int):
        return lambda o: F.struct(level.alias("level"), o.alias("offset"), F.when(o >= F.size(real), 1).otherwise(flag).alias("flag"), F.lower(F.hex(F.try_element_at(real, o + 1))).alias("hash"))

    def made(beside: Column) -> Column:
        leaves = F.concat(F.transform(own, node(2)), F.transform(F.array_except(beside, own), node(0)))
        return F.transform(beside, node(0)) if above else F.array_sort(F.when(level == 0, leaves).otherwise(F.transform(beside, node(0))))

    up = F.array_distinct(F.transform(own, lambda o: F.call_function("shiftright", o, level)))
    return let(F.transform(up, lambda o: o.bitwiseXOR(F.lit(1))), made)


def with_proof(rows: DataFrame, offsets: Column | None = None) -> DataFrame:
    """rows (with_levels) with nodes: the proof of the found leaves (or of `offsets`) as an array of (level, offset, flag,
    hash) in order. A single leaf has no path and so no nodes."""
    own = F.array_distinct(offsets if offsets is not None else F.transform("found", lambda x: x["leaf_index"]))
    turns = F.slice(F.sequence(F.lit(0), F.lit(MAX_HEIGHT)), 1, F.col("tree_height"))
    nodes = let(F.struct(F.col("levels").alias("l"), own.alias("o")), lambda v: F.flatten(F.transform(turns, lambda k: _proof_level(v["l"], v["o"], k))))
    return rows.withColumn("nodes", nodes)


#: Levels of a chunk of a large tree.
CHUNK_BITS = 10


def chunked_proofs(leaves: DataFrame, registered: DataFrame | None = None, bits: int = CHUNK_BITS) -> DataFrame:
    """block_hash, subtree_index, height, n, tree_height, root, nodes: the tree and the proof of a subtree of any size, with
    two shuffles and no row that holds all of its leaves.

    The leaves of an aligned chunk (2**bits of them) come together in one row, which gives the chunk's root and its part of
    the proof; then the roots of a subtree's chunks come together, as the leaves of the tree above, with these parts. Siblings
    below a chunk's root lie in the same chunk. The last chunk, if it is not full, goes up to the height of the others: a node
    without a sibling is hashed with itself, as in the whole tree.

    registered: block_hash, subtree_index, leaf_index of the leaves to prove (of equal hashes in a subtree the last, as
    registry.lookup gives them). A subtree without registered leaves has no nodes."""
    size = 1 << bits
    cut = [F.shiftright(F.col("leaf_index").cast("long"), bits).alias("chunk"), (F.col("leaf_index").cast("long") % size).cast("int").alias("at")]
    rows = leaves.select(*TREE, "height", *cut, F.unhex("raw_hex").alias("hash"))
    if registered is not None:
        rows = rows.unionByName(registered.select(*TREE, F.lit(None).cast("long").alias("height"), *cut, F.lit(None).cast("binary").alias("hash")))
    real = F.col("hash").isNotNull()
    rows = rows.groupBy(*TREE, "chunk").agg(F.max("height").alias("height"), F.array_sort(F.collect_list(F.when(real, F.struct("at", "hash")))).alias("_l"), F.array_sort(F.collect_set(F.when(~real, F.col("at")))).alias("own"))
    m = F.size("_l")
    # a chunk that is not the only one of its tree goes up to the common height
    up = F.when((F.col("chunk") > 0) | (m == size), bits).otherwise(tree_height(m)).cast("int")
    rows = with_levels(rows.select(*TREE, "height", "chunk", "own", m.alias("m"), up.alias("tree_height"), F.transform("_l", lambda x: x["hash"]).alias("hashes")))
    turns = F.slice(F.sequence(F.lit(0), F.lit(MAX_HEIGHT)), 1, F.col("tree_height"))
    shift = lambda x: F.struct(x["level"].alias("level"), (x["offset"] + F.call_function("shiftleft", F.col("chunk"), F.lit(bits) - x["level"])).cast("long").alias("offset"), x["flag"].alias("flag"), x["hash"].alias("hash"))
    part = let(F.struct(F.col("levels").alias("l"), F.col("own").alias("o")), lambda v: F.flatten(F.transform(turns, lambda k: F.transform(_proof_level(v["l"], v["o"], k), shift))))
    top = F.element_at(F.element_at("levels", F.col("tree_height") + 1), 1)
    rows = rows.select(*TREE, "height", "m", F.struct("chunk", top.alias("root"), (F.size("own") > 0).alias("has"), F.when(F.size("own") > 0, part).alias("nodes")).alias("c"))
    rows = rows.groupBy(*TREE).agg(F.max("height").alias("height"), F.sum("m").alias("n"), F.array_sort(F.collect_list("c")).alias("_c"))
    above = F.when(F.size("_c") > 1, tree_height(F.size("_c"))).otherwise(0).cast("int")
    rows = with_levels(rows.select(*TREE, "height", F.col("n").cast("int").alias("n"), "_c", above.alias("tree_height"), F.transform("_c", lambda x: x["root"]).alias("hashes")))
    # a tree of several chunks has full ones, so what is above them begins at level `bits`
    high = lambda x: F.struct((x["level"] + bits).alias("level"), x["offset"].cast("long").alias("offset"), x["flag"].alias("flag"), x["hash"].alias("hash"))
    own = F.transform(F.filter("_c", lambda x: x["has"]), lambda x: x["chunk"].cast("int"))
    upper = let(F.struct(F.col("levels").alias("l"), own.alias("o")), lambda v: F.flatten(F.transform(turns, lambda k: F.transform(_proof_level(v["l"], v["o"], k, True), high))))
    lower = F.flatten(F.transform(F.filter("_c", lambda x: x["has"]), lambda x: x["nodes"]))
    root = root_of(F.col("levels"), F.col("tree_height"))
    rows = rows.select(*TREE, "height", "n", root.alias("root"), F.array_sort(F.concat(lower, upper)).alias("nodes"))
    return rows.withColumn("tree_height", tree_height(F.col("n")).cast("int"))


def with_stump(rows: DataFrame) -> DataFrame:
    """rows (with_proof) with stump_hex and stump_ref; both null where the proof has no nodes."""
    one = lambda x: F.concat(compact_size_hex(x["offset"]), F.lpad(F.lower(F.hex(x["flag"])), 2, "0"), F.when(x["flag"] != 1, x["hash"]).otherwise(""))
    turns = F.slice(F.sequence(F.lit(0), F.lit(MAX_HEIGHT)), 1, F.col("tree_height"))
    written = lambda own: F.concat(compact_size_hex(F.size(own)), F.array_join(F.transform(own, one), ""))
    body = let(F.col("nodes"), lambda ns: F.array_join(F.transform(turns, lambda k: let(F.filter(ns, lambda x: x["level"] == k), written)), ""))
    text = F.concat(compact_size_hex("height"), F.lpad(F.lower(F.hex("tree_height")), 2, "0"), body)
    return rows.withColumn("stump_hex", F.when(F.size("nodes") > 0, text)).withColumn("stump_ref", sha256_hex(F.unhex("stump_hex")))


def provable(rows: DataFrame) -> DataFrame:
    """The rows that have a proof: a registered leaf and a path. Asked of what is given, not of the proof, so that nothing
    is computed for the others and nothing twice."""
    return rows.where((F.size("found") > 0) & (F.col("tree_height") > 0))


def callbacks_of(rows: DataFrame) -> DataFrame:
    """block_hash, subtree_index, url, token (that of the last leaf with one that is not empty), stump_ref: one message for
    each url of a row; no shuffle, as a row holds all of its subtree."""
    entry = lambda x: lambda c: F.struct(c["url"].alias("url"), (c["token"] != "").alias("some"), x["leaf_index"].alias("leaf_index"), F.nullif(c["token"], F.lit("")).alias("token"))
    pairs = F.sort_array(F.flatten(F.transform("found", lambda x: F.transform(x["callbacks"], entry(x)))))
    # the last of each url's sorted pairs has a token if any has, and is of the last such leaf
    last = let(pairs, lambda p: F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.try_element_at(p, i + 2)["url"] != x["url"])))
    return provable(rows).select(*TREE, "stump_ref", F.explode(last).alias("_c")).select(*TREE, "_c.url", "_c.token", "stump_ref")


def tree_levels(leaves: DataFrame, height: int) -> DataFrame:
    """block_hash, subtree_index, height, n, level, offset, hash: all nodes. height: the levels above the leaves that
    the largest subtree needs (ceil(log2(size)))."""
    t = with_levels(subtree_rows(leaves), height)
    t = t.select(*TREE, "height", "n", F.posexplode("levels").alias("level", "_nodes"))
    return t.select(*TREE, "height", "n", "level", F.posexplode(F.transform("_nodes", lambda h: F.lower(F.hex(h)))).alias("offset", "hash"))


def tree_levels_by_shuffle(leaves: DataFrame, height: int, stage=None) -> DataFrame:
    """The same, one aggregation a level: for subtrees too large for one row. stage (for instance a checkpoint) is given
    each level, so that no level is computed again by those above it."""
    level = leaves.withColumn("offset", F.col("leaf_index").cast("int")).withColumn("hash", F.col("raw_hex"))
    sizes = leaves.groupBy(*TREE).agg(F.count("*").cast("int").alias("n"))
    level = level.join(sizes, TREE).select(*TREE, "height", "n", "offset", "hash")
    made = None
    for i in range(height + 1):
        if i:
            two = level.where(F.expr(f"n > cast(power(2, {i - 1}) as int)")).groupBy(*TREE, "height", "n", F.expr("offset div 2").cast("int").alias("up"))
            level = two.agg(F.min_by("hash", "offset").alias("l"), F.max_by("hash", "offset").alias("r"))
            level = level.select(*TREE, "height", "n", F.col("up").alias("offset"), double_sha256_hex(F.concat("l", "r")).alias("hash"))
        level = stage(level) if stage else level
        own = level.select(*TREE, "height", "n", F.lit(i).alias("level"), "offset", "hash")
        made = own if made is None else made.unionByName(own)
    return made


def tree_height(n: Column) -> Column:
    """ceil(log2(n)), from the binary text of n - 1: no floating point."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin((n - 1).cast("long"))))


def roots(levels: DataFrame) -> DataFrame:
    """block_hash, subtree_index, n, root."""
    return levels.groupBy(*TREE, "n").agg(F.max_by("hash", "level").alias("root"))


def stump_nodes(registered: DataFrame, levels: DataFrame) -> DataFrame:
    """block_hash, subtree_index, height, tree_height, level, offset, flag, hash: what each subtree's proof holds.

    registered: block_hash, subtree_index, leaf_index of the leaves to prove. A single leaf has no path and so no rows.
    flag: 1 duplicate (no hash), 2 registered leaf, 0 other.
    """
    sizes = levels.where("level = 0 and offset = 0").select(*TREE, "height", "n").withColumn("tree_height", tree_height(F.col("n")))
    r = registered.select(*TREE, "leaf_index").distinct().join(sizes, TREE).where("tree_height > 0")
    up = r.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("tree_height") - 1)))
    above = F.expr("cast(shiftright(leaf_index, level) as int)")
    keys = [*TREE, "height", "n", "tree_height", "level", "offset"]
    siblings = up.select(*keys[:-1], above.bitwiseXOR(F.lit(1)).alias("offset"), F.lit(0).alias("own"))
    own = r.select(*keys[:-2], F.lit(0).alias("level"), F.col("leaf_index").cast("int").alias("offset"), F.lit(1).alias("own"))
    held = siblings.unionByName(own).groupBy(*keys).agg(F.max("own").alias("own"))
    real = F.expr("cast(ceil(n / power(2, level)) as int)")
    nodes = levels.select(*TREE, "level", "offset", "hash")
    held = held.join(nodes, [*TREE, "level", "offset"], "left")
    duplicate = F.col("offset") >= real
    flag = F.when(duplicate, 1).when(F.col("own") == 1, 2).otherwise(0)
    return held.select(*TREE, "height", "tree_height", "level", "offset", flag.alias("flag"), F.when(~duplicate, F.col("hash")).alias("hash"))


def encode_stumps(nodes: DataFrame) -> DataFrame:
    """block_hash, subtree_index, stump_hex, stump_ref (its content address): height, tree height, then for each level
    the count of nodes and each one's offset, flag and hash."""
    node = F.concat(compact_size_hex("offset"), F.lpad(F.lower(F.hex("flag")), 2, "0"), F.coalesce("hash", F.lit("")))
    by_level = nodes.groupBy(*TREE, "height", "tree_height", "level").agg(F.array_sort(F.collect_list(F.struct("offset", node.alias("x")))).alias("l"))
    text = F.concat(compact_size_hex(F.size("l")), F.array_join(F.expr("transform(l, e -> e.x)"), ""))
    whole = by_level.groupBy(*TREE, "height", "tree_height").agg(F.array_sort(F.collect_list(F.struct("level", text.alias("x")))).alias("l"))
    stump = F.concat(compact_size_hex("height"), F.lpad(F.lower(F.hex("tree_height")), 2, "0"), F.array_join(F.expr("transform(l, e -> e.x)"), ""))
    return whole.select(*TREE, stump.alias("stump_hex")).withColumn("stump_ref", sha256_hex(F.unhex("stump_hex")))


def parse_stump(data: bytes) -> tuple[int, int, list[tuple[int, int, int, str | None]]]:
    """(height, tree height, [(level, offset, flag, hash)]) of an encoded proof; ValueError if it is malformed."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("the proof ends early")
        at += n
        return data[at - n : at]

    def number() -> int:
        first = take(1)[0]
        return first if first < 0xFD else int.from_bytes(take({0xFD: 2, 0xFE: 4, 0xFF: 8}[first]), "little")

    height, levels, nodes = number(), take(1)[0], []
    for level in range(levels if at < len(data) else 0):
        for _ in range(number()):
            offset, flag = number(), take(1)[0]
            if flag > 2:
                raise ValueError(f"unknown flag {flag}")
            nodes.append((level, offset, flag, None if flag == 1 else take(32).hex()))
    return height, levels, nodes


def decode_stumps(stumps: DataFrame, key: list[str] | None = None) -> DataFrame:
    """key columns, height, tree_height, level, offset, flag, hash of each node of stump_hex: a sequential parse, in Arrow
    batches. A malformed proof gives one row with an error and no node."""
    key = key or TREE
    kinds = [stumps.schema[k] for k in key]
    head = ", ".join(f"`{k.name}` {k.dataType.simpleString()}" for k in kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, text in enumerate(batch.column(len(key)).to_pylist()):
                try:
                    height, levels, nodes = parse_stump(bytes.fromhex(text or ""))
                    made = [(height, levels, *n, None) for n in nodes]
                except (ValueError, KeyError) as e:
                    made = [(None, None, None, None, None, None, str(e))]
                rows += made
                at += [i] * len(made)
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            cols = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(key))] + [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(cols, [*key, "height", "tree_height", "level", "offset", "flag", "hash", "error"])

    return stumps.select(*key, "stump_hex").mapInArrow(run, f"{head}, height long, tree_height int, level int, offset int, flag int, hash string, error string")


def fold_root(leaf: Column, offset: Column, siblings: Column) -> Column:
    """The root that a leaf leads to. siblings: array of struct(level, hash); a null hash stands for the node itself."""
    step = lambda acc, s: F.struct(
        double_sha256_hex(F.when(acc["o"] % 2 == 0, F.concat(acc["h"], F.coalesce(s["hash"], acc["h"]))).otherwise(F.concat(F.coalesce(s["hash"], acc["h"]), acc["h"]))).alias("h"),
        F.expr("0L").alias("z"),
        F.shiftright(acc["o"], 1).alias("o"),
    )
    start = F.struct(leaf.alias("h"), F.expr("0L").alias("z"), offset.cast("long").alias("o"))
    return F.aggregate(siblings, start, step, lambda acc: acc["h"])


def verify(nodes: DataFrame) -> DataFrame:
    """block_hash, subtree_index, leaf_index, root: the root that each registered leaf of a proof folds to."""
    own = nodes.where("flag = 2").select(*TREE, "tree_height", F.col("offset").alias("leaf_index"), F.col("hash").alias("leaf"))
    steps = own.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("tree_height") - 1)))
    steps = steps.withColumn("offset", F.expr("cast(shiftright(leaf_index, level) as int)").bitwiseXOR(F.lit(1)))
    found = steps.join(nodes.select(*TREE, "level", "offset", "hash"), [*TREE, "level", "offset"])
    path = F.array_sort(F.collect_list(F.struct("level", "hash")))
    paths = found.groupBy(*TREE, "leaf_index", "leaf").agg(path.alias("path"))
    return paths.select(*TREE, "leaf_index", fold_root(F.col("leaf"), F.col("leaf_index"), F.col("path")).alias("root"))


def verified(rows: DataFrame, *keep: str) -> DataFrame:
    """block_hash, subtree_index, keep columns, leaf_index, root: the root that each registered leaf of a row's own nodes
    folds to, without a join or shuffle. A node that the proof lacks leads to another root."""
    turns = F.slice(F.sequence(F.lit(0), F.lit(MAX_HEIGHT)), 1, F.col("tree_height"))
    held = lambda own: F.struct(F.transform(own, lambda x: x["offset"]).alias("at"), F.transform(own, lambda x: F.coalesce(x["hash"], F.lit("-"))).alias("hash"))
    levels = F.transform(turns, lambda k: let(F.filter("nodes", lambda x: x["level"] == k), held))

    def folded(levels: Column, leaf: Column) -> Column:
        def beside(k: Column) -> Column:
            level = F.element_at(levels, k + 1)
            at = F.array_position(level["at"], F.call_function("shiftright", leaf["offset"], k).bitwiseXOR(F.lit(1)))
            # a duplicate, held as "-", stands for the node itself; what is not held at all is empty
            return F.struct(k.alias("level"), F.nullif(F.when(at > 0, F.element_at(level["hash"], F.greatest(at, F.lit(1)).cast("int"))).otherwise(F.lit("")), F.lit("-")).alias("hash"))

        return F.struct(leaf["offset"].alias("leaf_index"), fold_root(leaf["hash"], leaf["offset"], F.transform(turns, beside)).alias("root"))

    own = F.filter("nodes", lambda x: (x["level"] == 0) & (x["flag"] == 2))
    roots = let(levels, lambda ls: F.transform(own, lambda leaf: folded(ls, leaf)))
    return rows.select(*TREE, *keep, F.inline(roots))


def merged(*proofs: Column) -> Column:
    """Proofs of one subtree, as arrays of nodes, as one: nodes by (level, offset), registered leaves before others."""
    every = F.array_sort(F.concat(*proofs))
    other = lambda x, y: (x["level"] != y["level"]) | (x["offset"] != y["offset"])
    return let(every, lambda a: F.filter(a, lambda x, i: (i == F.size(a) - 1) | other(x, F.try_element_at(a, i + 2))))


def root_of_proof(nodes: list[tuple[int, int, int, str | None]], height: int) -> str | None:
    """The root of a whole proof, level by level: a duplicate takes its sibling's hash, a hash that the proof gives goes
    before one computed from below, and pairs that lack a side lead nowhere. None without a registered leaf at level 0."""
    import hashlib

    if not any(level == 0 and flag == 2 for level, _, flag, _ in nodes):
        return None
    made: dict[int, bytes] = {}
    for level in range(height):
        given = {o: bytes.fromhex(h) for k, o, f, h in nodes if k == level and f != 1 and h}
        made |= given
        for k, o, f, _ in nodes:
            if k == level and f == 1 and o ^ 1 in made:
                made[o] = made[o ^ 1]
        up = {}
        for o in {x & ~1 for x in made}:
            if o in made and o + 1 in made:
                up[o // 2] = hashlib.sha256(hashlib.sha256(made[o] + made[o + 1]).digest()).digest()
        if not up and level < height - 1:
            break
        made = up
    return made[0].hex() if 0 in made else None


def stump_roots(stumps: DataFrame, key: list[str] | None = None) -> DataFrame:
    """key columns, root, error of each encoded proof (stump_hex): null with an error if it is malformed, has no registered
    leaf, or does not lead to one root."""
    key = key or TREE
    head = ", ".join(f"`{k}` {stumps.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, errors = [], []
            for text in batch.column(len(key)).to_pylist():
                root, error = None, None
                try:
                    _, levels, nodes = parse_stump(bytes.fromhex(text or ""))
                    root = root_of_proof(nodes, levels)
                    error = None if root else "no registered leaf leads to a root"
                except (ValueError, KeyError) as e:
                    error = str(e)
                roots.append(root)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(key))), pa.array(roots, pa.string()), pa.array(errors, pa.string())], [*key, "root", "error"])

    return stumps.select(*key, "stump_hex").mapInArrow(run, f"{head}, root string, error string")


def merge(nodes: DataFrame) -> DataFrame:
    """Proofs of one subtree as one: nodes by (level, offset), registered leaves before others."""
    return nodes.groupBy(*TREE, "height", "tree_height", "level", "offset").agg(F.max("flag").alias("flag"), F.max("hash").alias("hash"))


def proof_walk(nodes: DataFrame) -> DataFrame:
    """block_hash, subtree_index, leaf_index, level, own, other: the nodes that lead each registered leaf to the root."""
    own = nodes.where("flag = 2").select(*TREE, "tree_height", F.col("offset").alias("leaf_index"))
    up = own.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("tree_height") - 1)))
    at = F.expr("cast(shiftright(leaf_index, level) as int)")
    return up.select(*TREE, "leaf_index", "level", at.alias("own"), at.bitwiseXOR(F.lit(1)).alias("other"))


def layout(levels: DataFrame, width: float = 100.0) -> DataFrame:
    """Where a drawing puts each node: x over the middle of its leaves, y by level."""
    return levels.withColumn("x", (F.col("offset") + 0.5) * width * F.expr("power(2, level)")).withColumn("y", -F.col("level") * width)
