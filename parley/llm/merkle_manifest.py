"""A manifest of a dataset as a Merkle tree, with every row's authentication path by fractal traversal.

Each row is a leaf.  The leaves of a group ascend by id and are hashed in runs of ``ARITY`` into nodes,
level by level, until one is left, the subroot; the subroots, in order of their groups, give the root in
the same way.  Leaves are range-sorted, so a leaf's index is the number of rows before its file and its
place in it; no group goes through one task.

Trees are worked in aligned blocks of ``ARITY ** HEIGHT`` leaves.  First every block gives its top
node; these are the leaves of the next tier, and so on until a tier has one block, where the paths are
known and go back down: each block is joined with the path above it.  In a block, ``Traversal`` gives
the paths of successive leaves: it keeps a stack of small subtrees of ``STRATUM`` levels that lie above
the current leaf, and for each one below the top the next of its kind, which it builds by one leaf a step
and which is complete when the current one has been passed.  A task holds one block.

Defined results for odd input: a null in any column is hashed as ``-``; a null group comes first; rows
without an id come first in their group and count as not tampered with; rows of equal group and id are
ordered by leaf; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.storage import scratch, stored

ARITY = 8
HEIGHT = 4
STRATUM = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(n: int) -> int:
    """The number of levels from n leaves to one node."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


class Subtree:
    """The nodes of ``height`` levels of a tree, without its top node: the descendants of one node.

    ``push`` takes the nodes of the lowest level from left to right; a run that is full gives its node to the level above.
    """

    def __init__(self, height: int):
        self.rows: list[list[str]] = [[] for _ in range(height)]
        self.top: str | None = None

    def push(self, node: str) -> None:
        for row in self.rows:
            row.append(node)
            if len(row) % ARITY:
                return
            node = digest("".join(row[-ARITY:]))
        self.top = node

    def close(self) -> None:
        """Nothing more comes: the last run of each level gives its node, however short it is."""
        if self.top is not None or not self.rows[0]:
            return
        for i, row in enumerate(self.rows):
            if len(row) % ARITY:
                node = digest("".join(row[-(len(row) % ARITY) :]))
                if i + 1 == len(self.rows):
                    self.top = node
                else:
                    self.rows[i + 1].append(node)
            elif i + 1 == len(self.rows):
                self.top = digest("".join(row[-ARITY:]))


class Climber:
    """The nodes of one level, made leaf by leaf; holds a run a level below it."""

    def __init__(self, level: int):
        self.open: list[list[str]] = [[] for _ in range(level)]

    def push(self, node: str) -> Iterator[str]:
        for run in self.open:
            run.append(node)
            if len(run) < ARITY:
                return
            node = digest("".join(run))
            run.clear()
        yield node

    def close(self) -> Iterator[str]:
        carried: list[str] = []
        for run in self.open:
            run += carried
            carried = [digest("".join(run))] if run else []
            run.clear()
        yield from carried


class Traversal:
    """The authentication paths of successive leaves of a tree of ``n`` leaves and ``height`` levels.

    ``leaf`` gives a leaf by its index; a tree may have fewer leaves than its height allows.
    """

    def __init__(self, leaf: Callable[[int], str], n: int, height: int):
        self.leaf, self.n = leaf, n
        self.floors = list(range(0, height, STRATUM))
        self.heights = [min(STRATUM, height - f) for f in self.floors]
        self.now = [self._built(i, 0) for i in range(len(self.floors))]
        self.next = [self._begun(i, 1) for i in range(len(self.floors) - 1)]

    def _span(self, i: int) -> int:
        """Leaves below a subtree of stratum i."""
        return ARITY ** (self.floors[i] + self.heights[i])

    def _begun(self, i: int, number: int) -> dict:
        return {"tree": Subtree(self.heights[i]), "climber": Climber(self.floors[i]), "at": number * self._span(i), "end": min((number + 1) * self._span(i), self.n), "number": number}

    def _step(self, built: dict) -> None:
        """One more leaf for a subtree that is being built."""
        if built["at"] < built["end"]:
            for node in built["climber"].push(self.leaf(built["at"])):
                built["tree"].push(node)
            built["at"] += 1
            if built["at"] == built["end"]:
                for node in built["climber"].close():
                    built["tree"].push(node)
                built["tree"].close()

    def _built(self, i: int, number: int) -> Subtree:
        built = self._begun(i, number)
        while built["at"] < built["end"]:
            self._step(built)
        return built["tree"]

    def top(self) -> str:
        return self.now[-1].top if self.now else self.leaf(0)

    def paths(self) -> Iterator[list[list[str]]]:
        """For each leaf, level by level from below, its run without itself."""
        for k in range(self.n):
            for i in range(len(self.next)):
                if k and k % self._span(i) == 0:
                    self.now[i] = self.next[i]["tree"]
                    self.next[i] = self._begun(i, k // self._span(i) + 1)
            path = []
            for i, floor in enumerate(self.floors):
                for j, row in enumerate(self.now[i].rows):
                    at = k // ARITY ** (floor + j) % ARITY ** (self.heights[i] - j)
                    first = at // ARITY * ARITY
                    path.append(row[first:at] + row[at + 1 : first + ARITY])
            yield path
            for built in self.next:
                self._step(built)


def fold(node: str, index: int, n: int, path: str, at: int = 0) -> tuple[str, int]:
    """The top that a node at ``index`` of ``n`` gives with its siblings, and where these end in ``path``."""
    while n > 1:
        place = index % ARITY
        run = min(ARITY, n - index + place)
        left, end = at + 64 * place, at + 64 * (run - 1)
        node = digest(path[at:left] + node + path[left:end])
        index, n, at = index // ARITY, -(-n // ARITY), end
    return node, at


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(_field(columns[f]) for f in FIELDS)), 256)


def _indexed(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes (g, ...) with ``i``, their place in the order of their group, and ``n``, the size of the group."""
    ranged = nodes.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("part", F.spark_partition_id())
    table = stored(ranged, "ordered-leaves").select("*", F.col("_metadata.row_index").alias("row"))
    # a row for each group of each file, and one more for each file that begins within a group
    parts = table.groupBy("g", "part").agg(F.count("*").alias("c"), F.min("row").alias("first"))
    before = F.expr("sum(c) over (partition by g order by part rows between unbounded preceding and current row) - c")
    parts = parts.select("g", "part", before.alias("before"), F.expr("sum(c) over (partition by g)").alias("n"), "first")
    return table.join(parts, ["g", "part"]).withColumn("i", F.col("before") + F.col("row") - F.col("first")).drop("part", "row", "before", "first")


def _tops(nodes: DataFrame, height: int) -> DataFrame:
    """The top node of each block of nodes (g, block, i, n, node)."""

    def top(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        n = table["n"][0].as_py()
        least = min(height, levels(n))
        climber = Climber(least)
        tops = [t for x in table["node"] for t in climber.push(x.as_py())] + list(climber.close())
        return pa.table({"g": table["g"][:1], "i": table["block"][:1], "n": pa.array([-(-n // ARITY**least)]), "node": pa.array(tops[:1])})

    return nodes.select("g", "block", "i", "n", "node").groupBy("g", "block").applyInArrow(top, "g string, i long, n long, node string")


def _paths(table: pa.Table, above: pa.Table, height: int) -> tuple[pa.Table, Iterator[str], dict]:
    """A block in order with the whole path of each leaf and what is known above it."""
    table = table.sort_by("i")
    up = {c: above[c][0].as_py() for c in above.column_names}
    height = min(height, levels(table["n"][0].as_py()))
    leaves = table["node"].to_pylist()
    walk = Traversal(leaves.__getitem__, len(leaves), height)
    return table, ("".join(map("".join, p)) + up["path"] for p in walk.paths()), up


def _tier(nodes: DataFrame, height: int) -> DataFrame:
    """g, i, path and top for nodes (g, i, n, node), one row for each node."""
    if nodes.filter("n > 1").isEmpty():
        return nodes.select("g", "i", F.lit("").alias("path"), F.col("node").alias("top"))
    nodes = nodes.withColumn("block", F.expr(f"i div {ARITY**height}"))
    above = _tier(stored(_tops(nodes, height), "block-tops"), height).withColumnRenamed("i", "block")

    def down(left: pa.Table, right: pa.Table) -> pa.Table:
        table, paths, up = _paths(left, right, height)
        return pa.table({"g": table["g"], "i": table["i"], "path": pa.array(list(paths), pa.string()), "top": pa.array([up["top"]] * table.num_rows, pa.string())})

    return nodes.groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(down, "g string, i long, path string, top string")


def _prove(table: pa.Table, above: pa.Table, height: int) -> pa.Table:
    """The rows of the manifest for one block of leaves."""
    table, paths, up = _paths(table, above, height)
    columns = [table[c].to_pylist() for c in ("doc_id", "node", "held", "i", "n")]
    proofs, folded = [], []
    for path, held, i, n in zip(paths, *columns[2:], strict=True):
        proofs.append(digest(path))
        subroot, at = fold(held, i, n, path)
        folded.append(fold(subroot, up["group_i"], up["group_n"], path, at)[0])
    rows = table.num_rows
    return pa.table({"doc_id": table["doc_id"], "leaf": table["node"], "subroot": [up["subroot"]] * rows, "root": [up["root"]] * rows, "proof_sha256": proofs, "folded_root": folded, "verified": [f == up["root"] for f in folded]}).cast(pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())]))


def leaves(docs: DataFrame) -> DataFrame:
    """g, doc_id, node (the leaf) and held, the leaf of what a holder shows: the same, or tampered with.

    Where 3 divides the crc32 of the id, the holder's text has its A-Z lower-cased.
    """
    columns = {f: F.col(f"`{f}`") for f in FIELDS}
    lower = columns | {"text": F.translate(columns["text"].cast("string"), UPPER, UPPER.lower())}
    tampered = F.coalesce(F.crc32(columns["doc_id"].cast("string").cast("binary")) % 3 == 0, F.lit(False))
    group = F.coalesce(F.concat(F.lit("v"), columns["lang"].cast("string")), F.lit(""))
    return docs.select(group.alias("g"), columns["doc_id"].cast("long").alias("doc_id"), _leaf(columns).alias("node"), F.when(tampered, _leaf(lower)).alias("held"))


@scratch
def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row."""
    digests = stored(leaves(docs), "leaves")
    nodes = stored(_indexed(digests, "doc_id", "node").withColumn("held", F.coalesce("held", "node")).withColumn("block", F.expr(f"i div {ARITY**height}")), "indexed-leaves")
    within = stored(_tier(stored(_tops(nodes, height), "block-tops"), height), "group-paths")
    # one subroot for each group; the groups are the leaves of the last tree
    subroots = within.filter("i = 0").select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("top").alias("node"))
    named = stored(_indexed(subroots, "name"), "groups")
    last = _tier(named.select("g", "i", "n", "node"), height).select("i", F.col("path").alias("last"), F.col("top").alias("root"))
    groups = named.join(last, "i").select(F.col("name").alias("g"), F.col("i").alias("group_i"), F.col("n").alias("group_n"), "last", "root")
    above = within.join(groups, "g").select("g", F.col("i").alias("block"), F.concat("path", "last").alias("path"), F.col("top").alias("subroot"), "group_i", "group_n", "root")
    return nodes.groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(lambda left, right: _prove(left, right, height), OUT)


def oracle_sql(table: str = "documents", height: int = 7) -> str:
    """The rows of ``manifest`` in DuckDB's SQL, for groups of at most ``ARITY ** height`` rows."""

    def field(c: str) -> str:
        return f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(text if f == 'text' else f) for f in FIELDS)})"

    crc = "list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, case when a & 1 = 1 then 3988292384 else 0 end) end)"
    parts = [
        f"""d as (select row_number() over (order by lang nulls first, doc_id nulls first, {leaf("text")}) r, coalesce('v' || lang, '') g, doc_id, {leaf("text")} leaf,
        case when doc_id is not null and xor({crc}, 4294967295) % 3 = 0 then {leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} else {leaf("text")} end held from {table})""",
        "n0 as (select g, row_number() over (partition by g order by r) - 1 i, leaf node, count(*) over (partition by g) n from d)",
        "p0 as (select r, g, row_number() over (partition by g order by r) - 1 i, doc_id, leaf, held node, '' proof from d)",
    ]

    def level(k: int, last: bool) -> list[str]:
        a, b, group = ("m", "q", "''") if last else ("n", "p", "x.g")
        run = f"(select g, i // {ARITY} up, i - i % {ARITY} first, list(node order by i) run, any_value(n) n from {a}{k} group by g, i // {ARITY}, i - i % {ARITY})"
        return [
            f"{a}{k + 1} as (select g, case when n > 1 then up else first end i, case when n > 1 then sha256(array_to_string(run, '')) else run[1] end node, case when n > 1 then (n + {ARITY - 1}) // {ARITY} else 1 end n from {run})",
            f"{b}{k + 1} as (select x.* exclude (i, node, proof), case when n > 1 then up else x.i end i, case when n > 1 then sha256(array_to_string(run[1:x.i - first] || [x.node] || run[x.i - first + 2:], '')) else x.node end node, case when n > 1 then proof || array_to_string(run[1:x.i - first] || run[x.i - first + 2:], '') else proof end proof from {b}{k} x join {run} y on y.g = {group} and x.i // {ARITY} = y.up)",
        ]

    for k in range(height):
        parts += level(k, False)
    parts += [
        f"m0 as (select '' g, row_number() over (order by g) - 1 i, node, count(*) over () n, g name from n{height})",
        f"q0 as (select x.* exclude (i), y.i, y.node subroot from p{height} x join m0 y on x.g = y.name)",
    ]
    for k in range(height):
        parts += level(k, True)
    return f"with {', '.join(parts)} select doc_id, leaf, subroot, z.node root, sha256(proof) proof_sha256, x.node folded_root, x.node = z.node verified from q{height} x, m{height} z"
