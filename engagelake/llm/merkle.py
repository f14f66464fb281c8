"""A Merkle manifest of a dataset: a tree per source, a tree over the sources, and proofs by octopus multiproof.

1. Rows become leaves in the scan; from there only digests move. Leaves are numbered inside their source by ranges.
2. Runs of leaves (ARITY to the power of the levels climbed at once) are climbed to their top in one task, the tops again in runs, up to the roots.
3. Every part of the leaves names the nodes it lacks on the ways to the root, each once for all its leaves and none that
   its own leaves give; one join fetches them. The part then derives the nodes its leaves share and every single proof.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engagelake.llm.common import query, read, stored

#: Nodes that are hashed together.
ARITY = 3
#: The number of the tree over the sources.
TOP = -1
NODES = "tree long, level int, n long, idx long, digest binary, part int"
#: Sources whose numbers may be broadcast.
BROADCAST_SOURCES = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Shape:
    """How the work is cut; the results are the same for all shapes.

    ``step``: levels that one task climbs at once. ``range_rows``, ``part_rows``: nodes in one part, on average, of the
    numbering, and of the climbing and proving.
    """

    step: int = 7
    range_rows: int = 100_000
    part_rows: int = 32_000

    @property
    def run(self) -> int:
        """Nodes below one top."""
        return ARITY**self.step


SHAPE = Shape()


# --- hashing ----------------------------------------------------------------------------------------------------------

def digest(*parts: str) -> str:
    """H: lower-case hex SHA-256 of the parts, concatenated."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as UTF-8 byte count, colon, value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def parents(nodes: list[str]) -> list[str]:
    """The next level: every ARITY consecutive nodes, the last ones fewer."""
    return [digest(*nodes[i:i + ARITY]) for i in range(0, len(nodes), ARITY)]


def folded(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf leads to by the siblings before and after it, level by level."""
    for before, after in path:
        node = digest(before, node, after)
    return node


# --- numbering --------------------------------------------------------------------------------------------------------

def numbered(rows: DataFrame, group: str, order: list[str], total: int, shape: Shape = SHAPE) -> DataFrame:
    """Add ``idx``, from 0 in every group by ``order``, and ``n``, the rows of the group; nulls come first.

    Rows are dealt into ranges of group and order, and equal rows by the place they are read from, so a group or a
    value with any share of the rows is spread. Only the counts per group and range are summed up in order.
    """
    ranges = max(1, math.ceil(total / shape.range_rows))
    dealt = rows.withColumn("__at", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(ranges, F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], "__at")
    dealt = stored(dealt.withColumn("__range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(F.col(group).alias("__group"), F.col("__range").alias("__r")).agg(F.count("*").alias("__c"))
    whole = W.partitionBy("__group")
    ahead = F.sum("__c").over(whole.orderBy("__r").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("__group", "__r", F.coalesce(ahead, F.lit(0)).alias("__ahead"), F.sum("__c").over(whole).alias("n"))
    own = F.row_number().over(W.partitionBy("__range", group).orderBy(*[F.col(c).asc_nulls_first() for c in order], "__at"))
    same = F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__r"))
    joined = dealt.withColumn("__own", own).join(counts, same)
    return joined.withColumn("idx", F.col("__ahead") + F.col("__own") - 1).drop("__at", "__range", "__group", "__r", "__ahead", "__own")


# --- climbing ---------------------------------------------------------------------------------------------------------

def runs(table: pa.Table, size: int) -> Iterator[tuple[int, int, int, int, list[str], slice]]:
    """(tree, level, n, first idx, digests, rows) of the runs of ``size`` nodes in a table sorted by tree and idx."""
    tree, idx = table["tree"].to_numpy(), table["idx"].to_numpy()
    run = idx // size
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(tree) != 0) | (np.diff(run) != 0)])) if len(tree) else []
    level, n, nodes = table["level"].to_numpy(), table["n"].to_numpy(), [d.hex() for d in table["digest"].to_pylist()]
    for low, high in zip(heads, [*heads[1:], len(tree)], strict=True):
        yield int(tree[low]), int(level[low]), int(n[low]), int(run[low]) * size, nodes[low:high], slice(int(low), int(high))


def climbed(nodes: DataFrame, every: bool, shape: Shape = SHAPE) -> DataFrame:
    """The nodes above ``nodes`` (tree, level, n, idx, digest, part), up to a step: all, or the tops of the runs only."""
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tree", "ascending"), ("idx", "ascending")])
        part, out = table["part"][0].as_py(), []
        for tree, level, n, first, digests, _ in runs(table, shape.run):
            for _ in range(shape.step):
                if n == 1:
                    break
                digests, level, n, first = parents(digests), level + 1, -(-n // ARITY), first // ARITY
                if every:
                    out += [(tree, level, n, first + i, bytes.fromhex(d), part) for i, d in enumerate(digests)]
            if not every:
                out.append((tree, level, n, first, bytes.fromhex(digests[0]), part))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
        return pa.table({f.split()[0]: pa.array(c, k) for f, c, k in zip(NODES.split(", "), columns, kinds, strict=True)})

    return nodes.select("tree", "level", "n", "idx", "digest", "part").groupBy("part").applyInArrow(work, NODES)


def dealt(nodes: DataFrame, total: int, shape: Shape = SHAPE) -> DataFrame:
    """Set ``part``: the runs of nodes by hash. A tree of any size is spread over parts."""
    parts = max(1, math.ceil(total / shape.part_rows))
    return nodes.withColumn("part", F.pmod(F.xxhash64("tree", F.floor(F.col("idx") / shape.run)), F.lit(parts)).cast("int"))


def grown(tops: DataFrame, shape: Shape = SHAPE) -> DataFrame:
    """All nodes from ``tops`` (tree, level, n, idx, digest, part) up to the roots, themselves included.

    Every round climbs a step in all trees that have not ended; there are as many as the logarithm of the largest.
    """
    every, now = [tops], tops.where("n > 1")
    while (left := now.count()) > 0:
        above = stored(climbed(dealt(now, left, shape), every=True, shape=shape), "nodes")
        every.append(above)
        # The highest level of the round goes on; a level below has more nodes than the one above it.
        high = above.groupBy("tree").agg(F.max("level").alias("level"))
        now = stored(above.where("n > 1").join(high, ["tree", "level"]).select("tree", "level", "n", "idx", "digest", "part"), "tops")
    out = every[0]
    for more in every[1:]:
        out = out.union(more)
    return out


# --- proofs -----------------------------------------------------------------------------------------------------------

def lacking(tree: np.ndarray, level: np.ndarray, n: np.ndarray, idx: np.ndarray, trees: int) -> list[tuple[int, int, int]]:
    """(tree, level, idx) of the nodes that the ways of the given nodes to the root need and none of them gives.

    Per level, the nodes at hand are those given or derived below; what is lacking are their siblings that are not at
    hand. The ways meet, so the list is the union over all of them, each node once.
    """
    out: list[tuple[int, int, int]] = []
    hand: dict[tuple[int, int], tuple[int, set[int]]] = {}
    for t, lv, size, i in zip(tree.tolist(), level.tolist(), n.tolist(), idx.tolist(), strict=True):
        hand.setdefault((t, lv), (size, set()))[1].add(i)

    def up(t: int, lv: int, size: int, mine: set[int]) -> None:
        while size > 1:
            above = {i // ARITY for i in mine}
            out.extend((t, lv, i) for p in above for i in range(p * ARITY, min((p + 1) * ARITY, size)) if i not in mine)
            mine, size, lv = above, -(-size // ARITY), lv + 1

    for (t, lv), (size, mine) in hand.items():
        up(t, lv, size, mine)
    up(TOP, 0, trees, {t for t, _ in hand})
    return sorted(out)


def wanted(tops: DataFrame, trees: int) -> DataFrame:
    """(part, tree, level, idx): what every part of the leaves lacks, from the tops of its runs."""
    def work(table: pa.Table) -> pa.Table:
        out = lacking(*[table[c].to_numpy() for c in ("tree", "level", "n", "idx")], trees)
        columns = list(zip(*out, strict=True)) or [[]] * 3
        part = pa.array([table["part"][0].as_py()] * len(out), pa.int32())
        return pa.table({"part": part, "tree": pa.array(columns[0], pa.int64()), "level": pa.array(columns[1], pa.int32()), "idx": pa.array(columns[2], pa.int64())})

    return tops.select("part", "tree", "level", "n", "idx").groupBy("part").applyInArrow(work, "part int, tree long, level int, idx long")


class Ways:
    """The nodes of one part, given and derived, and the way of each to the root."""

    def __init__(self, fetched: pa.Table, trees: int):
        self.known: dict[tuple[int, int], dict[int, str]] = defaultdict(dict)
        for t, lv, i, d in zip(*[fetched[c].to_pylist() for c in ("tree", "level", "idx", "digest")], strict=True):
            self.known[t, lv][i] = d.hex()
        self.trees = trees

    def family(self, tree: int, level: int, n: int, idx: int) -> tuple[str, str]:
        """The siblings before and after a node."""
        row, first = self.known[tree, level], idx // ARITY * ARITY
        return "".join(row[i] for i in range(first, idx)), "".join(row[i] for i in range(idx + 1, min(first + ARITY, n)))

    def derive(self, tops: list[tuple[int, int, int, int, str]]) -> dict[int, str]:
        """Derive all nodes above (tree, level, n, idx, digest); subroots by tree. The root is known[TOP, ...][0]."""
        hand: dict[tuple[int, int], tuple[int, set[int]]] = {}
        for t, lv, n, i, d in tops:
            hand.setdefault((t, lv), (n, set()))[1].add(i)
            self.known[t, lv][i] = d

        def up(t: int, lv: int, n: int, mine: set[int]) -> str:
            while n > 1:
                row, above = self.known[t, lv], {i // ARITY for i in mine}
                for p in above:
                    self.known[t, lv + 1][p] = digest(*[row[i] for i in range(p * ARITY, min((p + 1) * ARITY, n))])
                mine, n, lv = above, -(-n // ARITY), lv + 1
            return self.known[t, lv][0]

        roots = {t: up(t, lv, n, mine) for (t, lv), (n, mine) in hand.items()}
        self.known[TOP, 0].update(roots)
        self.root = up(TOP, 0, self.trees, set(roots))
        return roots

    def way(self, tree: int, level: int, n: int, idx: int) -> list[tuple[str, str]]:
        """Siblings before and after, level by level, from a node to the root over all trees."""
        out = []
        for t, lv, size, i in ((tree, level, n, idx), (TOP, 0, self.trees, tree)):
            while size > 1:
                out.append(self.family(t, lv, size, i))
                i, size, lv = i // ARITY, -(-size // ARITY), lv + 1
        return out


def proven(leaves: DataFrame, fetched: DataFrame, trees: int, with_proof: bool, shape: Shape = SHAPE) -> DataFrame:
    """Every leaf with its subroot, the root, its proof, and the root that ``shown`` (else the leaf) folds to."""
    columns = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    columns += ", proof array<struct<before:string,after:string>>" * with_proof
    proof_type = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("tree", "ascending"), ("idx", "ascending")])
        ways, pieces, tops = Ways(right, trees), [], []
        for tree, level, n, first, digests, rows in runs(left, shape.run):
            levels, sizes = [digests], [n]
            while sizes[-1] > 1 and len(levels) <= shape.step:
                levels.append(parents(levels[-1]))
                sizes.append(-(-sizes[-1] // ARITY))
            tops.append((tree, level + len(levels) - 1, sizes[-1], first // ARITY**(len(levels) - 1), levels[-1][0]))
            pieces.append((tree, levels, rows))
        subroots, ids, shown = ways.derive(tops) if tops else {}, left["doc_id"].to_pylist(), left["shown"].to_pylist()
        out: list[list] = [[] for _ in range(6 + with_proof)]
        for (tree, levels, rows), top in zip(pieces, tops, strict=True):
            above = ways.way(*top[:4])
            tail = "".join(b + a for b, a in above)
            for k, own in enumerate(levels[0]):
                path, i = [], k
                for nodes in levels[:-1]:
                    low = i // ARITY * ARITY
                    path.append(("".join(nodes[low:i]), "".join(nodes[i + 1:low + ARITY])))
                    i //= ARITY
                at = rows.start + k
                given = own if shown[at] is None else shown[at].hex()
                proof = digest(*[b + a for b, a in path], tail)
                row = [ids[at], own, subroots[tree], ways.root, proof, folded(given, path + above)]
                if with_proof:
                    row.append([{"before": b, "after": a} for b, a in path + above])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        kinds = [pa.int64(), *[pa.string()] * 5, *[proof_type] * with_proof]
        names = [c.split()[0] for c in columns.split(", ")]
        return pa.table({name: pa.array(c, k) for name, c, k in zip(names, out, kinds, strict=True)})

    return leaves.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(work, columns)


def manifest(rows: DataFrame, shape: Shape = SHAPE) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(leaves, tops of their runs, all nodes above, number of trees) of rows (doc_id, source, leaf, shown).

    ``leaf``: 32 bytes; ``shown``: the digest that is to be verified instead, null where it is the leaf. Leaves ascend by
    doc_id (null first), equal ids by leaf; a null source is a source of its own, before all others. The tree over the
    sources has number TOP.
    """
    rows = stored(rows.select("doc_id", "source", "leaf", "shown"), "digests")  # the texts are read and hashed once
    total = rows.count()
    leaves = numbered(rows, "source", ["doc_id", "leaf"], total, shape)
    sources = stored(leaves.where("idx = 0").select("source"), "sources")
    trees = sources.count()
    order = numbered(sources.withColumn("__all", F.lit(0)), "__all", ["source"], trees, shape).select(
        F.col("source").alias("__source"), F.col("idx").alias("tree"))
    order = F.broadcast(order) if trees <= BROADCAST_SOURCES else order
    leaves = leaves.join(order, F.col("source").eqNullSafe(F.col("__source"))).select(
        "tree", F.lit(0).alias("level"), "n", "idx", F.col("leaf").alias("digest"), "doc_id", "shown")
    leaves = stored(dealt(leaves, total, shape), "leaves")
    tops = stored(climbed(leaves, every=False, shape=shape), "tops")
    nodes = grown(tops, shape)
    subroots = stored(nodes.where("n = 1").select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.lit(trees).cast("long").alias("n"),
        F.col("tree").alias("idx"), "digest", F.lit(0).alias("part")), "subroots")
    return leaves, tops, nodes.union(grown(subroots, shape)), trees


def with_proofs(rows: DataFrame, with_proof: bool = False, shape: Shape = SHAPE) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) of rows (doc_id, source, leaf, shown), as for ``manifest``.

    ``with_proof`` adds ``proof``, the siblings before and after, level by level; ``folded`` checks one without Spark. A
    proof is as long as the logarithm of the table. Repeated rows are leaves of their own, each with its own proof.
    """
    leaves, tops, nodes, trees = manifest(rows, shape)
    needs = wanted(tops, trees)
    fetched = needs.join(nodes.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"]).select("part", "tree", "level", "idx", "digest")
    return proven(leaves, fetched, trees, with_proof, shape)


SQL = r"""
WITH RECURSIVE rows AS (
  SELECT *, doc_id IS NOT NULL AND xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
           4294967295) % 2 = 0 AS tampered FROM documents),
fields AS (
  SELECT doc_id, source, tampered, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head FROM rows),
hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END) || ':'
                || CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END, '-')) AS shown FROM fields),
leaves AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY source) AS n FROM hashed),
inner_nodes(tree, level, idx, n, h) AS (
  SELECT tree, 0, idx, n, leaf FROM leaves
  UNION ALL SELECT tree, any_value(level) + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY idx)) FROM inner_nodes WHERE n > 1 GROUP BY tree, idx // 3),
tops AS MATERIALIZED (SELECT tree AS idx, h, count(*) OVER () AS n FROM inner_nodes WHERE n = 1),
outer_nodes(level, idx, n, h) AS (
  SELECT 100, idx, n, h FROM tops
  UNION ALL SELECT any_value(level) + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY idx)) FROM outer_nodes WHERE n > 1 GROUP BY idx // 3),
nodes AS MATERIALIZED (
  SELECT tree, level, idx, n, h FROM inner_nodes UNION ALL SELECT -1, level, idx, n, h FROM outer_nodes),
family AS MATERIALIZED (
  SELECT a.tree, a.level, a.idx, a.n, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS bef,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS aft
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY 1, 2, 3, 4),
way(leaf_tree, leaf_idx, tree, level, idx, n, cur, proof) AS (
  SELECT tree, idx, tree, 0, idx, n, shown, '' FROM leaves
  UNION ALL
  SELECT w.leaf_tree, w.leaf_idx, CASE WHEN w.n > 1 THEN w.tree ELSE -1 END, CASE WHEN w.n > 1 THEN w.level + 1 ELSE 100 END,
         CASE WHEN w.n > 1 THEN w.idx // 3 ELSE w.leaf_tree END, CASE WHEN w.n > 1 THEN (w.n + 2) // 3 ELSE (SELECT max(n) FROM tops) END,
         CASE WHEN w.n > 1 THEN sha256(f.bef || w.cur || f.aft) ELSE w.cur END, w.proof || coalesce(f.bef || f.aft, '')
  FROM way w LEFT JOIN family f ON f.tree = w.tree AND f.level = w.level AND f.idx = w.idx WHERE w.n > 1 OR w.tree >= 0)
SELECT l.doc_id, l.leaf, t.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.cur AS folded_root, w.cur = r.h AS verified
FROM way w JOIN leaves l ON l.tree = w.leaf_tree AND l.idx = w.leaf_idx JOIN tops t ON t.idx = w.leaf_tree
JOIN (SELECT h FROM outer_nodes WHERE n = 1) r ON true
WHERE w.tree = -1 AND w.n = 1"""


@query("op13_merkle", SQL)
def _merkle(spark, folder):
    """Proofs of all documents, verified against documents of which half have lost their line feeds."""
    docs = read(spark, folder, "documents")
    rest = [F.col(c) for c in FIELDS[:-1]]
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    changed = tampered & F.contains(F.col("text"), F.lit("\n"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(*rest, F.col("text")).alias("leaf"),
                       F.when(changed, leaf(*rest, F.translate("text", "\n", ""))).alias("shown"))
    return with_proofs(rows).withColumn("verified", F.col("folded_root") == F.col("root"))
