"""The trie of all conversation prefixes, by chained digests.

A conversation is rebuilt as some first turns of the conversation that its number
names, then its own turns after as many. A turn is a SHA-256 of role and text, and a
prefix is a chain of them: the digest of the prefix before and the turn's. Chains run in
blocks of BLOCK turns, each dealt to a task of its own, and the last digests of a
conversation's blocks are chained again, so that a prefix's digest follows from its turns
alone and no task holds a conversation. Every prefix is a row; grouped by (depth,
digest) the rows are the nodes.

Sums over subtrees go from each node to all its ancestors. All of these are prefixes of
the node's smallest member, and the nodes of which a conversation is the smallest member
are the deepest prefixes of it; so the values that a conversation's nodes give to one
ancestor are added up, as running sums from the last turn on, before they leave: a row for each
prefix, however deep the trie is. Only digests and counts move, texts stay where they are read.

Defined cases: null roles and texts are empty; rows without a conv_id are passed over;
turns are in order of ``turn``, null first, equal ones in order of their digest, and
repeated rows are turns of their own; c - c % 5 takes the sign of c for the remainder; a
conversation without turns after rebuilding is a member of the root only; an empty table
has no node, not even a root. Columns other than the four read are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize, streamed_sums

BLOCK = 1024
FAMILY, TURNS = 5, 9
EMPTY = hashlib.sha256(b"").hexdigest()
#: Characters of listed members in a row.
PIECE = 1 << 16


def digest(value: Column) -> Column:
    return F.unhex(F.sha2(value.cast("binary"), 256))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, said, bytes, pos): each turn's digest, its text's bytes and its place, from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), said.alias("said"), F.octet_length(text).cast("long").alias("bytes")).where("conv_id is not null")
    return streamed_sums(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("said")], {"pos": F.lit(1)}).select("conv_id", "said", "bytes", (F.col("pos") - 1).alias("pos"))


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over, if there are as many."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % TURNS).cast("long")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (c, source, h, k, size), and their rebuilt turns (c, p, said, bytes, last)."""
    n = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    own = n.select(F.col("conv_id").alias("c"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("source"), shared_turns(F.col("conv_id")).alias("h"), "n")
    k = F.least("h", F.coalesce("have", F.lit(0)))
    convs = own.join(n.select(F.col("conv_id").alias("source"), F.col("n").alias("have")), "source", "left").withColumn("k", k)
    # written out, so that the joins read two exchanges and a long conversation can be split
    convs = materialize(convs.select("c", "source", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "conversations")
    first = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < TURNS - 1)).withColumnRenamed("conv_id", "source")
    heads = first.join(convs, "source").where("pos < h").select("c", F.col("pos").alias("p"), "said", "bytes", "size")
    tails = placed.join(convs, F.col("conv_id") == F.col("c")).where("pos >= h").select("c", (F.col("k") + F.col("pos") - F.col("h")).alias("p"), "said", "bytes", "size")
    return convs, heads.unionByName(tails).select("c", "p", "said", "bytes", (F.col("p") + 1 == F.col("size")).alias("last"))


def chain(rows: DataFrame, group: list[str], order: str, value: str, before: str, out: str) -> DataFrame:
    """``rows`` with the chained digest of ``value`` before each row and after it, in its group; null before the first.

    The digest after a first row is its value itself.
    """
    names = rows.columns
    keys = [names.index(g) for g in group]
    at = names.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = None, None
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for *key, said in zip(*[batch.column(i).to_pylist() for i in [*keys, at]], strict=True):
                if key != last:
                    last, now = key, None
                found[0].append(now)
                now = said if now is None else hashlib.sha256(now + said).digest()
                found[1].append(now)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.binary()) for x in found]], [*names, before, out])

    ddl = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema], f"{before} binary", f"{out} binary"])
    return rows.repartition(*group).sortWithinPartitions(*group, order).mapInArrow(run, ddl)


def prefixes(rebuilt_turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(c, depth, node, parent, bytes, last): every prefix of one turn or more, named by its digest; a first turn's parent is empty."""
    blocks = rebuilt_turns.withColumn("block", F.floor(F.col("p") / block))
    inside = materialize(chain(blocks, ["c", "block"], "p", "said", "before", "after"), "chains")
    ends = inside.where(F.col("p") % block == block - 1).select("c", "block", F.col("after").alias("end"))
    # of all blocks before; no row for conversations of one block
    carried = chain(ends, ["c"], "block", "end", "_", "carry").select("c", (F.col("block") + 1).alias("block"), "carry")
    later = inside.where("block > 0").join(carried, ["c", "block"])
    link = lambda x: digest(F.concat("carry", x))
    later = later.select("c", "p", link("after").alias("node"), F.coalesce(link("before"), "carry").alias("parent"), "bytes", "last")
    first = inside.where("block = 0").select("c", "p", F.col("after").alias("node"), F.coalesce("before", F.lit(b"")).alias("parent"), "bytes", "last")
    return first.unionByName(later).select("c", (F.col("p") + 1).alias("depth"), "node", "parent", "bytes", "last")


def listed(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of rows (depth, node, c): the digest of the numbers in order, with commas between.

    Tasks write out their stretches of the order; one then passes over a node's pieces, a piece at a time.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, node, c = (batch.column(i).to_pylist() for i in range(3))
            out, begin = [], 0
            for i in range(1, len(c) + 1):
                if i == len(c) or (depth[i], node[i]) != (depth[begin], node[begin]) or i - begin >= PIECE // 16:
                    out.append((depth[begin], node[begin], c[begin], ",".join(map(str, c[begin:i]))))
                    begin = i
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.binary(), pa.int64(), pa.string()), strict=True)], ["depth", "node", "first", "text"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for depth, node, text in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)], strict=True):
                if (depth, node) == last:
                    state.update(b"," + text.encode())
                    continue
                if last is not None:
                    out.append((*last, state.hexdigest()))
                last, state = (depth, node), hashlib.sha256(text.encode())
            yield of_rows(out)
        if last is not None:
            yield of_rows([(*last, state.hexdigest())])

    def of_rows(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.binary(), pa.string()), strict=True)], ["depth", "node", "ends_sha256"])

    key = ["depth", "node"]
    pieces = ends.select(*key, "c").repartitionByRange(*key, "c").sortWithinPartitions(*key, "c").mapInArrow(write, "depth long, node binary, first long, text string")
    return pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(read, "depth long, node binary, ends_sha256 string")


def nodes(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for every node, the root included."""
    key = ["depth", "node"]
    convs, said = rebuilt(turns(conversations))
    every = materialize(prefixes(said, block), "prefixes")
    # parent and bytes follow from the node; as keys they leave the aggregate a hash of fixed fields
    found = every.groupBy(*key, "parent", "bytes").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"))
    found = materialize(found, "nodes")
    children = found.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    given = found.join(children, key, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "saved": (F.col("n_convs") - 1) * F.col("bytes")})
    given = materialize(given, "nodes")
    own = F.col("c") == F.col("conv_id")
    values = every.select("c", *key).join(given.select(*key, "conv_id", "n_children", "saved"), key)
    values = values.select("c", *key, F.when(own, F.col("saved")).otherwise(0).alias("saved"), F.when(own & (F.col("n_children") == 0), 1).otherwise(0).alias("leaf"))
    upward = streamed_sums(values, "c", [F.col("depth").desc()], {"saved_below": F.col("saved"), "leaves_below": F.col("leaf")})
    sums = materialize(upward.groupBy(*key).agg(F.sum("saved_below").alias("saved_tokens"), F.sum("leaves_below").alias("n_leaves")), "sums")
    ends = materialize(listed(every.where("last").select(*key, "c").unionByName(convs.where("size = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("node"), "c"))), "ends")
    # one row: the root
    whole = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = given.agg(F.count(F.when(F.col("depth") == 1, 1)).alias("n_children"), F.greatest(F.count(F.when(F.col("n_children") == 0, 1)), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    root = whole.crossJoin(top).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("node"), F.lit(None).cast("binary").alias("parent"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    below = given.join(sums, key).select("conv_id", *key, "parent", "n_convs", "n_children", "n_leaves", "saved_tokens")
    all_ = materialize(root.unionByName(below), "trie")
    parents = all_.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = all_.join(parents, ["depth", "parent"], "left").join(ends, key, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
