"""Merkle manifest of a dataset as a postorder append log (operator 12).

Every row is a leaf: the digest of its columns. The leaves of a group (a language), in the order of their ids, form
a tree of arity 8: while several nodes remain, every 8 consecutive ones become their digest (the last run may be
shorter, down to one). What remains is the group's root; the group roots, in the order of their groups, form the
top tree in the same way, whose root stands for the dataset. Digests are SHA-256, inputs in lower-case hex text.

The log is built in tiers. An aligned builder takes the 512 leaves that start at a multiple of 512 and appends
the nodes above them in the order in which they are complete: postorder, so a subtree is one stretch of the
log that ends in its own node. The builders' last nodes are the next tier's leaves, until a group has one block.
A node's place in the log follows from sizes alone (:func:`address`): no node stores a link, and a proof
addresses its siblings in closed form. Proofs are extracted from the top tier down, each block handing the
siblings above it to the blocks below.

Where it runs: leaves are digested in one scan; only ids and digests are shuffled; a group's leaves are numbered by
a range sort that splits hot groups; a builder holds 512 leaves, a proof task one block. Log and
leaves are written to the shared folder, so lost executors cost their tasks alone.

Nulls are ``-`` in a leaf, and a null group is the first one; a null id comes before all others. Rows that agree in id
and digest tie, in any order with the same result; other ties follow the leaf digest. Empty texts, very
long ones and extra columns are digested or left out like any other; an empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.llm.common import ascii_lower, table, written
from pageflow.operators.ranking import rank_in_groups

ARITY, HEIGHT = 8, 3
SPAN = ARITY**HEIGHT
WIDTH = 32
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def parent(nodes: list[bytes]) -> bytes:
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def height(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    h = 0
    while leaves > 1:
        leaves, h = -(-leaves // ARITY), h + 1
    return h


def place(level: int, index: int, leaves: int, top: int) -> int:
    """Where node ``index`` of a level stands in the postorder log of a tree with ``top`` levels above its leaves.

    Before the node's first leaf come the nodes that are complete by then, of every level; then its own subtree.
    """
    first = index * ARITY**level
    end = min((index + 1) * ARITY**level, leaves)
    before = sum(first // ARITY**j for j in range(top + 1))
    own = sum(-(-end // ARITY**j) - first // ARITY**j for j in range(level + 1))
    return before + own - 1


#: Entries of the log that a full builder writes.
FULL = place(HEIGHT, 0, SPAN, HEIGHT) + 1


@dataclass(frozen=True)
class Address:
    """A node in the log: its tier, the builder's block there, and the entry within what that builder wrote."""

    tier: int
    block: int
    entry: int

    @property
    def position(self) -> int:
        """The entry in the tier's whole log of a group: all earlier builders are full."""
        return self.block * FULL + self.entry


def address(level: int, index: int, leaves: int) -> Address:
    """Where the log of a group with that many leaves holds node ``index`` of a level."""
    tier = level // HEIGHT
    here = leaves
    for _ in range(tier):
        here = -(-here // SPAN)
    within = level % HEIGHT
    block = index // ARITY ** (HEIGHT - within)
    held = min(SPAN, here - block * SPAN)
    top = block_top(block, held)
    return Address(tier, block, place(within, index - block * ARITY ** (HEIGHT - within), held, top))


def block_top(block: int, held: int) -> int:
    """Levels that a builder makes: all, unless its block is the group's only one."""
    return HEIGHT if block or held == SPAN else height(held)


def append_log(leaves: list[bytes], top: int) -> list[bytes]:
    """The nodes above a block's leaves with the leaves, each when it is complete."""
    log: list[bytes] = []
    open_: list[list[bytes]] = [[] for _ in range(top + 1)]

    def add(level: int, node: bytes) -> None:
        log.append(node)
        open_[level].append(node)
        if level < top and len(open_[level]) == ARITY:
            close(level)

    def close(level: int) -> None:
        run, open_[level] = open_[level], []
        add(level + 1, parent(run))

    for leaf in leaves:
        add(0, leaf)
    for level in range(top):  # the short runs at the end
        if open_[level]:
            close(level)
    return log


def _entry(log: bytes, k: int) -> bytes:
    return log[WIDTH * k : WIDTH * (k + 1)]


def places(leaves: int, top: int) -> list[list[int]]:
    """The places of a block's nodes by level."""
    return [[place(level, k, leaves, top) for k in range(-(-leaves // ARITY**level))] for level in range(top + 1)]


def siblings(log: bytes, leaf: int, at: list[list[int]]) -> list[tuple[int, list[bytes]]]:
    """For each level of a block with the places ``at``: the node's place in its run, and the run's other nodes."""
    out, own = [], leaf
    for level in at[:-1]:
        first = own - own % ARITY
        run = level[first : first + ARITY]
        out.append((own - first, [_entry(log, p) for p in run if p != level[own]]))
        own //= ARITY
    return out


def encode(steps: list[tuple[int, list[bytes]]]) -> bytes:
    """A proof as bytes: for each level the place, the number of siblings and their digests."""
    return b"".join(bytes((at, len(others))) + b"".join(others) for at, others in steps)


def decode(proof: bytes) -> Iterator[tuple[int, list[bytes]]]:
    k = 0
    while k < len(proof):
        at, n = proof[k], proof[k + 1]
        k += 2
        yield at, [proof[k + WIDTH * j : k + WIDTH * (j + 1)] for j in range(n)]
        k += WIDTH * n


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    for at, others in decode(proof):
        leaf = parent([*others[:at], leaf, *others[at:]])
    return leaf


def proof_digest(proof: bytes) -> str:
    h = hashlib.sha256()
    for _, others in decode(proof):
        h.update("".join(o.hex() for o in others).encode())
    return h.hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """The digest of a row's columns, each ``-`` if null, else its bytes in UTF-8 behind their number."""
    fields = []
    for c in columns:
        text = c.cast("string")
        fields.append(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.unhex(F.sha2(F.concat(*fields), 256))


def group_key(c: Column) -> Column:
    """A group as bytes in the order of groups: null first, then by UTF-8."""
    return F.when(c.isNull(), F.lit(b"\x00")).otherwise(F.concat(F.lit(b"\x01"), c.cast("string").cast("binary")))


def logs(hashes: Column, block: Column) -> Column:
    """What a builder writes for the leaves of a block."""

    @F.arrow_udf("binary")
    def write(hashes: pa.Array, blocks: pa.Array) -> pa.Array:
        made = [b"".join(append_log(h, block_top(b, len(h)))) for h, b in zip(hashes.to_pylist(), blocks.to_pylist(), strict=True)]
        return pa.array(made, pa.binary())

    return write(hashes, block)


def build(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The log of every group of ``leaves`` (grp, idx from 0 without gaps, hash, and a struct ``row`` in the first tier).

    A tier is a table (grp, block, leaves, log, root, rows), one row per builder. Its last entry is the
    block's own node. The last tier has one block per group.
    """
    tiers: list[DataFrame] = []
    while True:
        row = F.col("row") if "row" in leaves.columns else F.lit(None).cast("struct<key: bigint>")
        held = leaves.select("grp", F.expr(f"idx div {SPAN}").alias("block"), F.struct("idx", "hash", row.alias("row")).alias("leaf"))
        blocks = held.groupBy("grp", "block").agg(F.array_sort(F.collect_list("leaf")).alias("of"))
        made = blocks.select("grp", "block", F.size("of").alias("leaves"), logs(F.col("of.hash"), F.col("block")).alias("log"), F.col("of.row").alias("rows"))
        tier = written(made.withColumn("root", F.expr(f"substring(log, octet_length(log) - {WIDTH - 1}, {WIDTH})")), f"{name}-{len(tiers)}")
        tiers.append(tier)
        if not tier.agg(F.max("block")).first()[0]:  # none, or one block in each group
            return tiers
        leaves = tier.select("grp", F.col("block").alias("idx"), F.col("root").alias("hash"))


def extract(tiers: list[DataFrame], above: DataFrame, row: str = "struct<key: bigint>") -> DataFrame:
    """(grp, idx, hash, row, proof, subroot, root) of every leaf of the first tier.

    ``above`` (grp, block, proof, subroot, root) has for each group's only block of the last tier what lies over it;
    a null subroot or root is this tree's own.
    """
    for k in reversed(range(len(tiers))):
        kind = row if k == 0 else "struct<key: bigint>"
        both = tiers[k].withColumnRenamed("root", "node").join(above, ["grp", "block"])
        both = both.select("grp", "block", "leaves", "log", "proof", *[F.coalesce(c, "node").alias(c) for c in ("subroot", "root")], "rows")
        below = both.mapInArrow(_proofs, f"grp binary, idx bigint, hash binary, proof binary, subroot binary, root binary, row {kind}")
        if k == 0:
            return below
        above = below.select("grp", F.col("idx").alias("block"), "proof", "subroot", "root")
    raise ValueError("no tier")


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("grp", "idx", "hash", "proof", "subroot", "root")
    kinds = (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    known: dict[tuple[int, int], list[list[int]]] = {}
    for batch in batches:
        rows = batch.column("rows")
        for k, (grp, block, n, log, over, subroot, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "leaves", "log", "proof", "subroot", "root")), strict=True)):
            top = block_top(block, n)
            if (n, top) not in known:  # one for all full blocks
                known[n, top] = places(n, top)
            at = known[n, top]
            columns = (
                [grp] * n, [block * SPAN + j for j in range(n)], [_entry(log, p) for p in at[0]],
                [encode(siblings(log, j, at)) + over for j in range(n)], [subroot] * n, [root] * n,
            )
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, rows[k].values], names=[*names, "row"])


@dataclass
class Manifest:
    """The logs of the groups and of the top tree over them. ``groups`` is empty for an empty dataset."""

    groups: list[DataFrame]
    top: list[DataFrame]
    row: str

    def nodes(self) -> DataFrame:
        """(grp, tier, position, hash): the groups' logs, one row per entry, as :func:`address` names them."""
        entry = lambda k: F.substring(F.col("log"), k * WIDTH + 1, F.lit(WIDTH))
        each = lambda: F.posexplode(F.transform(F.sequence(F.lit(0), F.expr(f"octet_length(log) div {WIDTH}").cast("int") - 1), entry)).alias("entry", "hash")
        parts = [t.select("grp", F.lit(k).alias("tier"), "block", each()) for k, t in enumerate(self.groups)]
        return reduce(DataFrame.unionByName, parts).select("grp", "tier", (F.col("block") * FULL + F.col("entry")).alias("position"), "hash")

    def proofs(self) -> DataFrame:
        """(grp, idx, hash, proof, subroot, root, row) of every row of the dataset: proof from leaf to root."""
        last = self.top[-1].select("grp", "block", F.lit(b"").alias("proof"), F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("binary").alias("root"))
        over = extract(self.top, last, "struct<key: binary>")
        above = over.select(F.col("row.key").alias("grp"), F.lit(0).cast("bigint").alias("block"), "proof", F.col("hash").alias("subroot"), "root")
        return extract(self.groups, above, self.row)


def manifest(leaves: DataFrame, order: list[str]) -> Manifest:
    """The manifest of ``leaves`` (grp, hash, and a struct ``row`` that goes with each); a group's leaves in ``order``, then by hash."""
    leaves = written(leaves, "leaves")  # the range sort reads its rows twice: the texts once
    ranked = rank_in_groups(leaves, ["grp"], [*order, "hash"], "rn")
    numbered = ranked.select("grp", (F.col("rn") - 1).alias("idx"), "hash", "row")
    groups = build(numbered, "manifest")
    roots = groups[-1].select(F.lit(b"").alias("all"), F.col("grp"), F.col("root").alias("hash"))
    over = rank_in_groups(roots, ["all"], ["grp"], "rn")
    top = build(over.select(F.col("all").alias("grp"), (F.col("rn") - 1).alias("idx"), "hash", F.struct(F.col("grp").alias("key")).alias("row")), "manifest-top")
    return Manifest(groups, top, leaves.schema["row"].dataType.simpleString())


def certified(leaf: Column, proof: Column) -> Column:
    """The digest of a proof and the root that it gives for a leaf."""

    @F.arrow_udf("struct<proof_sha256: string, folded: binary>")
    def check(leaves: pa.Array, proofs: pa.Array) -> pa.Array:
        rows = [(proof_digest(p), fold(x, p)) for x, p in zip(leaves.to_pylist(), proofs.to_pylist(), strict=True)]
        columns = list(zip(*rows, strict=True)) or [(), ()]
        return pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary())], names=["proof_sha256", "folded"])

    return check(leaf, proof)


def verified_documents(docs: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Leaf, roots and proof of every document, and whether what is shown for it gives the root.

    ``shown``: ``docs`` with a further column ``shown``, the leaf that is presented later (null: the same).
    """
    given = shown if shown is not None else docs.withColumn("shown", F.lit(None).cast("binary"))
    leaf = leaf_digest([F.col(c) for c in COLUMNS])
    leaves = given.select(group_key(F.col("lang")).alias("grp"), F.col("doc_id").alias("key"), leaf.alias("hash"), F.struct(F.col("doc_id").alias("key"), "shown").alias("row"))
    found = manifest(leaves, ["key"]).proofs()
    checked = found.withColumn("c", certified(F.coalesce("row.shown", "hash"), F.col("proof")))
    low = lambda c: F.lower(F.hex(c))
    return checked.select(
        F.col("row.key").alias("doc_id"), low("hash").alias("leaf"), low("subroot").alias("subroot"), low("root").alias("root"),
        F.col("c.proof_sha256").alias("proof_sha256"), low("c.folded").alias("folded_root"), (F.col("c.folded") == F.col("root")).alias("verified"))


def tampered(docs: DataFrame) -> DataFrame:
    """``docs`` with the leaf of a text in lower case where 3 divides the CRC-32 of the id."""
    columns = [ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS]
    return docs.withColumn("shown", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_digest(columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    return verified_documents(docs, tampered(docs))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HEAD = " || ".join(_FIELD.format(c) for c in COLUMNS[:-1])
_CRC = """xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""

SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, sha256({_HEAD} || {_FIELD.format('text')}) AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN sha256({_HEAD} || {_FIELD.format(_LOWER)}) END AS shown FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM docs
), up AS (
  SELECT g, 0 AS lv, idx, leaf AS h, n FROM leaves
  UNION ALL
  SELECT g, lv + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM up WHERE n > 1 GROUP BY g, lv, idx // 8
), subs AS (
  SELECT g, h AS subroot, lv AS levels, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS lv, idx, subroot AS h, n FROM subs
  UNION ALL
  SELECT lv + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY lv, idx // 8
), nodes AS (
  SELECT g AS tree, lv, idx, h FROM up WHERE n > 1 UNION ALL SELECT 'top', lv, idx, h FROM top WHERE n > 1
), plan AS (
  SELECT DISTINCT u.g, u.lv AS s, u.g AS tree, u.lv, NULL::BIGINT AS own FROM up u WHERE u.n > 1
  UNION ALL
  SELECT DISTINCT b.g, b.levels + t.lv, 'top', t.lv, b.idx FROM subs b, top t WHERE t.n > 1
), steps AS (
  SELECT l.g, l.idx AS i, p.s, p.tree, p.lv, coalesce(p.own, l.idx) // (8 ** p.lv)::BIGINT AS own FROM leaves l JOIN plan p ON l.g = p.g
), proofs AS (
  SELECT t.g, t.i, sha256(coalesce(string_agg(n.h, '' ORDER BY t.s, n.idx), '')) AS proof FROM steps t
  JOIN nodes n ON n.tree = t.tree AND n.lv = t.lv AND n.idx // 8 = t.own // 8 AND n.idx <> t.own GROUP BY t.g, t.i
), folds AS (
  SELECT g, idx AS i, 0 AS s, coalesce(shown, leaf) AS cur FROM leaves
  UNION ALL
  SELECT f.g, f.i, f.s + 1, sha256(string_agg(CASE WHEN n.idx = t.own THEN f.cur ELSE n.h END, '' ORDER BY n.idx)) FROM folds f
  JOIN steps t ON t.g = f.g AND t.i = f.i AND t.s = f.s JOIN nodes n ON n.tree = t.tree AND n.lv = t.lv AND n.idx // 8 = t.own // 8
  GROUP BY f.g, f.i, f.s
), ends AS (SELECT g, i, arg_max(cur, s) AS folded FROM folds GROUP BY g, i)
SELECT l.doc_id, l.leaf, b.subroot, r.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded AS folded_root, e.folded = r.h AS verified
FROM leaves l JOIN subs b ON l.g = b.g JOIN (SELECT h FROM top WHERE n = 1) r ON true JOIN ends e ON e.g = l.g AND e.i = l.idx
LEFT JOIN proofs p ON p.g = l.g AND p.i = l.idx
"""
