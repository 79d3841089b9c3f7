import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pageflow.llm import merkle as M

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, hash string, idx int, grp string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [row[0], row[3], row[2], row[4], text]
    return H(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [H(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
        out.append(nodes)
    return out


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    """Whole trees, level by level; sets of (doc_id, leaf, subroot, root, proof, folded, verified)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[g] = levels([leaf(r, r[1]) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            cur, proof = leaf(r, lower(r[1]) if bad else r[1]), []
            for tree, own in ((trees[g], i), (top, k)):
                for level in tree[:-1]:
                    first = own - own % 8
                    run = level[first : first + 8]
                    proof += [h for j, h in enumerate(run) if first + j != own]
                    run[own - first] = cur
                    cur, own = H(*run), own // 8
            out.append((r[0], trees[g][0][i], trees[g][-1][0], top[-1][0], H(*proof), cur, cur == top[-1][0]))
    return sorted(out, key=str)


def got(spark, rows):
    docs = spark.createDataFrame([(*r, "h", 1, "g") for r in rows], COLUMNS)
    return sorted((tuple(r) for r in M.verified_documents(docs, M.tampered(docs)).collect()), key=str)


def test_odd_rows(odd, spark):
    rows = [(r["doc_id"], r["text"], ["en", None, "", "é", "En"][k % 5], [None, "s"][k % 2], [None, 3][k % 3 > 0]) for k, r in enumerate(odd.collect())]
    rows += rows[:3]  # repeated rows
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 511, 512, 513, 520, 1030, 4200])
def test_sizes_around_the_blocks(spark, n):
    """One hot group of n leaves among small ones."""
    rows = [(k, f"Text {k}", "en", "s", k) for k in range(n)] + [(-k, f"T{k}", f"l{k}", "s", 0) for k in range(1, 4)]
    have, want = got(spark, rows), plain(rows)
    assert have == want
    assert any(r[-1] for r in have) and not all(r[-1] for r in have)


def test_more_groups_than_a_block(spark):
    rows = [(k, f"Doc {k}", f"g{k % 600}", "s", 1) for k in range(700)]
    assert got(spark, rows) == plain(rows)


def test_one_row_and_none(spark):
    assert got(spark, [(1, "a", None, None, None)]) == plain([(1, "a", None, None, None)])
    docs = spark.createDataFrame([], COLUMNS)
    assert M.verified_documents(docs, M.tampered(docs)).count() == 0


def test_log_is_postorder_and_addresses_hold():
    """The closed form against the builder, for every node of trees of one block."""
    for n in [*range(1, 75), 200, 511, 512]:
        leaves = [bytes([k % 256, k // 256]) * 16 for k in range(n)]
        top = M.block_top(0, n)
        log = M.append_log(leaves, top)
        tree = [leaves]
        for _ in range(top):
            tree.append([M.parent(tree[-1][k : k + 8]) for k in range(0, len(tree[-1]), 8)])
        assert len(log) == sum(map(len, tree)) and log[-1] == tree[-1][-1]
        for level, nodes in enumerate(tree):
            for k, node in enumerate(nodes):
                assert log[M.place(level, k, n, top)] == node
                if level < M.HEIGHT:
                    assert M.address(level, k, n).position == M.place(level, k, n, top)


def test_stored_nodes_are_found_by_address(spark):
    n = 1100
    docs = spark.range(n).select(F.lit(b"\x01en").alias("grp"), F.col("id").alias("key"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("hash"), F.struct(F.col("id").alias("key")).alias("row"))
    held = M.manifest(docs, ["key"])
    stored = {(r["tier"], r["position"]): r["hash"].hex() for r in held.nodes().collect()}
    tree = levels([hashlib.sha256(str(k).encode()).hexdigest() for k in range(n)])
    for level, nodes in enumerate(tree):
        for k, node in enumerate(nodes):
            a = M.address(level, k, n)
            assert stored[a.tier, a.position] == node
    assert held.proofs().count() == n
