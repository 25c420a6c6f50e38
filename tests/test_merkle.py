"""Trees and proofs: the published vector, and random trees against a plain construction."""

import base64
import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txloom.functions import scalars as S
from txloom.operators import merkle as M

# A published proof of 4 leaves, of which 0 and 2 are registered, and its root.
VECTOR = (
    "/fQBAgQAApailtIk8oXGe+6Tww+KMJFX8NqjXcW4fkELeGMKCc/HAQBH3FQMlM63BKI4dcESc+FrsLioeu2E3pEfITNWgRXyVAICmb5e+4jKIBO9jk6wNf1C1SRUaP6a+nDYupwcQZpIxOgDAJtPsk7dbR2IMOJyOYJjzb8Ca5c5LMNTh7mR3AJIpij5"
    "AgAA6ltlDw+3PC3JFIbkNMD0qRXGEhJ1puWMoC9TXIUW4sEBACyjCeYVrSt/X+zKSCWxqSNIBLKpN5C42BxvBRPgwM7g"
)
ROOT = "bd5740a64b2e0737c3a78790fa3f1622af554ee537400f47fb4a64dc357fad9d"


def double(b: bytes) -> bytes:
    return hashlib.sha256(hashlib.sha256(b).digest()).digest()


def leaf(i: int) -> bytes:
    return hashlib.sha256(bytes([i & 255, i >> 8])).digest()


def tree(n: int) -> list[list[bytes]]:
    out = [[leaf(i) for i in range(n)]]
    while len(out[-1]) > 1:
        x = out[-1]
        out.append([double(x[i] + (x[i + 1] if i + 1 < len(x) else x[i])) for i in range(0, len(x), 2)])
    return out


def leaves(spark, n, block="b"):
    return spark.createDataFrame([(block, 500, 0, i, leaf(i).hex()) for i in range(n)], "block_hash string, height long, subtree_index long, leaf_index long, raw_hex string")


def registered(spark, rs):
    return spark.createDataFrame([("b", 0, r) for r in rs], "block_hash string, subtree_index long, leaf_index long")


def test_published_vector(spark):
    levels = M.tree_levels(leaves(spark, 4), 2).cache()
    nodes = M.stump_nodes(registered(spark, [0, 2]), levels)
    made = M.encode_stumps(nodes).head()
    assert made["stump_hex"] == base64.b64decode(VECTOR).hex()
    assert made["stump_ref"] == hashlib.sha256(base64.b64decode(VECTOR)).hexdigest()
    assert {r["root"] for r in M.verify(nodes).collect()} == {ROOT}
    again = M.decode_stumps(spark.createDataFrame([("b", 0, made["stump_hex"])], "block_hash string, subtree_index long, stump_hex string"))
    assert {r["root"] for r in M.verify(again.drop("error")).collect()} == {ROOT}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 40), st.data())
def test_every_proof_folds_to_the_root(spark, n, data):
    rs = data.draw(st.sets(st.integers(0, n - 1), min_size=1, max_size=6))
    levels = M.tree_levels(leaves(spark, n), 6).cache()
    want = tree(n)
    got = {(r["level"], r["offset"]): r["hash"] for r in levels.collect()}
    assert got == {(i, j): h.hex() for i, level in enumerate(want) for j, h in enumerate(level)}
    nodes = M.stump_nodes(registered(spark, rs), levels)
    proofs = {r["leaf_index"]: r["root"] for r in M.verify(nodes).collect()}
    assert proofs == ({} if n == 1 else {r: want[-1][0].hex() for r in rs})
    levels.unpersist()


def test_both_tree_plans_agree(spark):
    a = {tuple(r) for r in M.tree_levels(leaves(spark, 13), 4).select("level", "offset", "hash").collect()}
    assert a == {tuple(r) for r in M.tree_levels_by_shuffle(leaves(spark, 13), 4).select("level", "offset", "hash").collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 40), st.data())
def test_rows_and_nodes_agree(spark, n, data):
    """The proof of one row is that made node by node, whole proofs lead to the root, and of equal leaves the last counts."""
    rs = data.draw(st.sets(st.integers(0, n - 1), min_size=1, max_size=6))
    twin = n > 1 and data.draw(st.booleans())
    made = [("b", 500, 0, i, leaf(0 if twin and i == n - 1 else i).hex()) for i in range(n)]
    lv = spark.createDataFrame(made, "block_hash string, height long, subtree_index long, leaf_index long, raw_hex string")
    regs = spark.createDataFrame([(made[r][4], "u", "") for r in rs], "raw_hex string, url string, token string").distinct()
    own = {max(i for i in range(n) if made[i][4] == made[r][4]) for r in rs}
    row = M.with_stump(M.with_proof(M.with_levels(M.subtree_rows(lv, regs), 6))).withColumn("root", M.root_of(F.col("levels"), F.col("tree_height"))).head()
    levels = M.tree_levels_by_shuffle(lv, 6)
    want = {(r["level"], r["offset"], r["flag"], r["hash"]) for r in M.stump_nodes(registered(spark, own), levels).collect()}
    assert [(x["level"], x["offset"]) for x in row["nodes"]] == sorted((k, o) for k, o, _, _ in want)
    assert {tuple(x) for x in row["nodes"]} == {(k, o, f, h if f != 1 else None) for k, o, f, h in want}
    if n == 1:
        assert row["stump_hex"] is None
        return
    _, height, nodes = M.parse_stump(bytes.fromhex(row["stump_hex"]))
    assert M.root_of_proof(nodes, height) == row["root"]
    assert M.root_of_proof([(k, o, 0 if f == 2 else f, h) for k, o, f, h in nodes], height) is None


def test_a_tree_over_the_bound_is_an_error(spark):
    with pytest.raises(Exception, match="too high"):
        M.with_levels(M.subtree_rows(leaves(spark, 9)), 3).collect()


def test_whole_proofs_as_rows(spark):
    got = M.stump_roots(spark.createDataFrame([(1, base64.b64decode(VECTOR).hex()), (2, "00"), (3, None)], "k int, stump_hex string"), ["k"]).collect()
    assert {r["k"]: (r["root"], r["error"] is None) for r in got} == {1: (ROOT, True), 2: (None, False), 3: (None, False)}


def test_malformed_proofs_are_rows_with_an_error(spark):
    good = base64.b64decode(VECTOR)
    bad = [good[:50].hex(), "zz", "", None, (good[:6] + b"\x09" + good[7:]).hex()]
    rows = M.decode_stumps(spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "k int, stump_hex string"), ["k"]).collect()
    assert sorted(r["k"] for r in rows if r["error"]) == [0, 1, 2, 3, 4]
    assert M.parse_stump(bytes.fromhex("fdf40100")) == (500, 0, [])


def test_merge_prefers_registered_leaves(spark):
    levels = M.tree_levels(leaves(spark, 8), 3).cache()
    a, b = (M.stump_nodes(registered(spark, [r]), levels) for r in (2, 3))
    both = M.stump_nodes(registered(spark, [2, 3]), levels)
    key = lambda df: {tuple(r) for r in df.select("level", "offset", "flag", "hash").collect()}
    assert key(M.merge(a.unionByName(b))) == key(both)


# The compact form of numbers around its limits.
@pytest.mark.parametrize(("n", "want"), [(0, "00"), (1, "01"), (127, "7f"), (128, "80"), (252, "fc"), (253, "fdfd00"), (300, "fd2c01"), (65535, "fdffff"), (65536, "fe00000100"), (1 << 32, "ff0000000001000000")])
def test_compact_size(spark, n, want):
    assert spark.range(1).select(S.compact_size_hex(F.lit(n))).head()[0] == want


@pytest.mark.parametrize(("n", "rs"), [(1, [0]), (2, [1]), (7, [0, 6]), (8, [3]), (9, [8]), (13, [0, 7, 12]), (16, []), (17, [16]), (33, [5, 32]), (64, [63]), (65, [0, 64])])
def test_chunks_give_the_same_tree_and_proof(spark, n, rs):
    lv, own = leaves(spark, n), registered(spark, rs) if rs else None
    got = M.with_stump(M.chunked_proofs(lv, own, 3)).head()
    flat = M.with_levels(M.subtree_rows(lv), 7)
    want = M.with_stump(M.with_proof(flat, F.array(*map(F.lit, rs)).cast("array<int>"))).head()
    assert got["root"] == tree(n)[-1][0].hex() and (got["n"], got["tree_height"], got["height"]) == (n, want["tree_height"], 500)
    assert [tuple(x) for x in got["nodes"]] == [tuple(x) for x in want["nodes"]] and got["stump_hex"] == want["stump_hex"]
    if rs and n > 1:
        found = M.verified(M.chunked_proofs(lv, own, 3).withColumn("want", F.col("root")), "want").collect()
        assert sorted(r["leaf_index"] for r in found) == rs and {r["root"] for r in found} == {got["root"]}


def test_chunks_need_two_shuffles(spark):
    lv = leaves(spark, 40)
    plan = M.chunked_proofs(lv, registered(spark, [3]), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_a_broken_proof_leads_elsewhere(spark):
    row = M.chunked_proofs(leaves(spark, 20), registered(spark, [3]), 3)
    cut = row.withColumn("nodes", F.filter("nodes", lambda x: x["level"] != 2))
    assert [r["root"] == row.head()["root"] for r in M.verified(cut).collect()] == [False]
