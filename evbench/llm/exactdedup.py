"""Exact deduplication by Patricia-trie owners (operator 11).

Texts are equal when their bytes agree after each run of ASCII white space became one space.  A document goes to the
partition of its byte length and content hash.  A task inserts the full byte strings of its partition into a compressed radix
trie; a terminal node keeps the ids that ended there, and the smallest one owns the text.  Equality is decided by bytes alone,
the hash only deals the documents out.

Hot texts: length-and-hash classes of more than max(HOT, rows / MOST_HOT) documents, of which there are at most MOST_HOT, are
dealt over salts.  Each salt's trie gives a partial owner, and partial owners, one row of text each, meet in the next round.

Memory: a trie that holds more than BUDGET bytes spills its heaviest subtree.  What ended there becomes partial owners, later
strings that reach the subtree pass through as such, and the next round deals them anew, by another hash and over more
partitions.  So a round leaves final owners and partial ones, and rounds go on until there are none of the latter.

Null text counts as empty, and empty texts are equal.  A text that is a prefix of another ends at an inner node.  Very long
texts are held once each.  Rows with one id and one text are counted in group_size one by one and share a verdict, since
nothing tells them apart; one id with two texts is two rows.  Rows with a null id are left out of the verdicts and stay in
deduplicated().  Columns other than id and text are never read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, texts

#: Documents of one length and hash beyond which they are dealt over salts, and the most such classes there can be.
HOT, MOST_HOT = 500, 100_000
#: Bytes that a task's trie holds before it spills a subtree.
BUDGET = 64 << 20
#: Bytes that a terminal node and a member of it count for besides the text.
NODE, MEMBER = 400, 100
#: Partial owners that are broadcast; more of them are joined by a shuffle.
BROADCAST_OWNERS = 100_000
#: Rounds that may spill.
ROUNDS = 12

SPACE = r"[\x20\x09-\x0D]+"
OWNED = "doc_id long, owner long, n long, sha binary, text binary"


class Node:
    __slots__ = ("text", "start", "end", "children", "members", "weight", "spilled")

    def __init__(self, text: bytes, start: int, end: int, weight: int = 0):
        """The edge text[start:end]; text[:end] is the whole path from the root."""
        self.text, self.start, self.end, self.weight = text, start, end, weight
        self.children: dict[int, Node] = {}
        self.members: list[tuple[int, int, bool]] | None = None
        self.spilled = False


def agreement(a: bytes, b: bytes, lo: int, hi: int) -> int:
    """The first place in [lo, hi) where a and b differ, else hi."""
    step = 64
    while lo < hi:
        n = min(hi, lo + step)
        if a[lo:n] == b[lo:n]:
            lo, step = n, 4 * step
        elif n - lo == 1:
            return lo
        else:
            hi, step = n, (n - lo) // 2
    return lo


class Trie:
    """A compressed radix trie of byte strings; a terminal node's members are (id, rows that it stands for, is it hot)."""

    def __init__(self):
        self.root, self.terminals = Node(b"", 0, 0), 0

    def insert(self, text: bytes, doc_id: int, rows: int = 1, hot: bool = False) -> bool:
        """False if the string ends in a subtree that was spilled."""
        node, path = self.root, [self.root]
        while node.end < len(text):
            first = text[node.end]
            child = node.children.get(first)
            if child is None:
                child = node.children[first] = Node(text, node.end, len(text))
            elif (at := agreement(text, child.text, child.start, min(child.end, len(text)))) < child.end:
                upper = node.children[first] = Node(child.text, child.start, at, child.weight)
                upper.children[child.text[at]] = child
                child.start = at
                child = upper
            path.append(child)
            node = child
            if node.spilled:
                return False
        more = MEMBER
        if node.members is None:
            node.members = []
            self.terminals += 1
            more += len(text) + NODE
        node.members.append((doc_id, rows, hot))
        for x in path:
            x.weight += more
        return True

    def ends(self, node: Node | None = None):
        """(text, members) of the terminal nodes below a node."""
        todo = [node or self.root]
        while todo:
            node = todo.pop()
            todo.extend(node.children.values())
            if node.members:
                yield node.text[: node.end], node.members

    def spill(self, budget: int) -> list[tuple[bytes, list]]:
        """Give up the heaviest subtree, or of one that holds more than half of the budget its heaviest part; what it held."""
        path = [self.root]
        while path[-1].children:
            path.append(max(path[-1].children.values(), key=lambda x: x.weight))
            if path[-1].weight <= budget // 2:
                break
        node = path[-1]
        gone, weight = list(self.ends(node)), node.weight
        self.terminals -= len(gone)
        node.children, node.members, node.spilled = {}, None, True
        prefix = node.text[: node.end]  # no longer the reason that a long text stays in memory
        for x in path:
            x.weight -= weight
            x.text = prefix
        return gone


def _owned(batches, budget: int):
    """Of (text, doc_id, n, hot) rows those of OWNED: text is kept on the owner's row if it is a partial one."""
    trie, out = Trie(), []

    def settle(text: bytes, members: list, partial: bool) -> None:
        owner, n, sha = min(i for i, *_ in members), sum(k for _, k, _ in members), hashlib.sha256(text).digest()
        partial = partial or any(hot for *_, hot in members)
        for i, *_ in members:
            out.append((i, owner, n, sha, text if partial and i == owner else None))
            partial = partial and i != owner  # rows of one id give one partial owner

    def flush():
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "owner", "n", "sha", "text"])

    for b in batches:
        for text, doc_id, n, hot in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if not trie.insert(text, doc_id, n, hot):
                settle(text, [(doc_id, n, True)], True)
            while trie.root.weight > budget and trie.terminals > 1:
                for x in trie.spill(budget):
                    settle(*x, True)
            if len(out) >= 2000:
                yield flush()
    for x in trie.ends():
        settle(*x, False)
        if len(out) >= 2000:
            yield flush()
    if out:
        yield flush()


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def _round(rows: DataFrame, keys: list[Column], partitions: int, budget: int) -> DataFrame:
    dealt = rows.repartition(partitions, *keys).select("text", "doc_id", "n", "hot")
    return cut(dealt.mapInArrow(lambda batches: _owned(batches, budget), OWNED))


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): per row of docs the smallest id that has its text."""
    spark = docs.sparkSession
    given = texts(docs, id_col, text_col)
    n_rows, n_bytes = given.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = lambda size: max(least, -(-2 * size // budget))

    norm = given.select("doc_id", normalised(F.col("text")).alias("s"))
    keyed = norm.select("doc_id", "s", F.octet_length("s").alias("len"), F.xxhash64("s").alias("h"))
    most = max(hot, n_rows // MOST_HOT)
    classes = keyed.groupBy("len", "h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most)
    salts = classes.select("len", "h", F.ceil(F.col("c") / most).alias("salts"))  # at most MOST_HOT rows, as c > rows / MOST_HOT
    rows = keyed.join(F.broadcast(salts), ["len", "h"], "left").select(
        "doc_id", F.col("s").cast("binary").alias("text"), "len", "h", F.lit(1).cast("long").alias("n"), F.col("salts").isNotNull().alias("hot"),
        F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), "salts")).alias("salt"),
    )
    found = _round(rows, [F.col("len"), F.col("h"), F.col("salt")], tasks(n_bytes), budget)
    result, partial = found.select("doc_id", "owner", "n", "sha"), found.where("text is not null")
    for k in range(1, ROUNDS + 1):
        count, size = partial.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        if not count:
            break
        again = partial.select(F.col("owner").alias("doc_id"), "text", "n", F.lit(False).alias("hot"))
        last = k == ROUNDS
        found = _round(again, [F.octet_length("text"), F.xxhash64("text", F.lit(k))], tasks(size << k), 1 << 62 if last else budget)
        one = found.groupBy("doc_id", "sha").agg(F.min("owner").alias("__owner"), F.max("n").alias("__n"))
        one = one.withColumnsRenamed({"doc_id": "owner"})
        one = F.broadcast(one) if count <= BROADCAST_OWNERS else one
        result = result.join(one, ["owner", "sha"], "left").select("doc_id", F.coalesce("__owner", "owner").alias("owner"), F.coalesce("__n", "n").alias("n"), "sha")
        partial = found.where("text is not null")
    return result.select("doc_id", F.col("owner").alias("keep_id"), F.col("n").alias("group_size"), (F.col("doc_id") == F.col("owner")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text a smaller id has; every column as it was."""
    lost = owners(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    same = (docs[id_col].cast("long") == lost["__id"]) & (F.sha2(normalised(docs[text_col]), 256) == lost["__sha"])
    return docs.join(lost, same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owners(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Rows of query() in DuckDB.
SQL = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(s) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents WHERE doc_id IS NOT NULL)
WINDOW same AS (PARTITION BY s)
"""
