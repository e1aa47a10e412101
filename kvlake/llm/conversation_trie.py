"""The prefix trie of conversations, built as a burst trie.

Distinct conversations are suffixes in a container, at first one under the root. A container that is too
large bursts: what all its suffixes share becomes a chain of nodes, and the suffixes go on to containers
under the next turn's id. The containers that remain are dealt to tasks, sorted, and swept into nodes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Turns of the largest container that is swept; larger ones burst. Bytes of ids that are hashed as one row. Bytes of a turn's id.
LIMIT, CHUNK, WIDE = 1 << 12, 1 << 20, 16
NONE = hashlib.sha256(b"").hexdigest()
TURNS = "array<struct<id: binary, words: bigint>>"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _short(text: Column) -> Column:
    """The first 16 bytes of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 2 * WIDE))


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) of conversations (conv_id, turn, role, text): each turn's id, by role and text, and its words, in order of turn, nulls first; turns of one number are in order of their ids. A null role or text is empty; rows without a conv_id belong to no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce(F.col("turn"), F.lit(0)).cast("long").alias("b"), _short(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("id"), F.regexp_count(text, F.lit(r"[^ \x09-\x0D]+")).cast("long").alias("words"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), own.alias("x"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lists.select("conv_id", F.transform("x", lambda x: F.struct(x["id"].alias("id"), x["words"].alias("words"))).alias("turns"))


def rebuilt(lists: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """(conv_id, turns): of each conversation c, the first h turns of conversation c - c % family (none if it is absent), then its own after its first h; h is crc32 of the decimal c, modulo `shared`."""
    first = F.col("conv_id") - F.col("conv_id") % family
    heads = lists.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, shared - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    rows = lists.withColumn("first", first).join(heads, "first", "left").withColumn("h", h)
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("head", F.array().cast(TURNS)), F.lit(1), F.col("h")), own).alias("turns"))


def member_hashes(members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, ends): the SHA-256 of each key's decimal conv_ids, rising and joined by commas.

    Ids are sorted by ranges, so that many tasks share a key with many, and each joins what it has of a key
    to rows of about `chunk` bytes; one task then hashes a key's few rows in order.
    """

    def join(batches):
        key, ids, size = None, [], 0
        for batch in batches:
            out = []
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (k != key or size > chunk):
                    out.append((key, int(ids[0]), ",".join(ids).encode()))
                    ids, size = [], 0
                key = k
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield _chunks(out)
        yield _chunks([(key, int(ids[0]), ",".join(ids).encode())] if ids else [])

    def digest(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for k, body in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist()):
                if k == key:
                    state.update(b"," + body)
                    continue
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(body)
            yield _hashes(out)
        yield _hashes([(key, state.hexdigest())] if state is not None else [])

    sorted_ = members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = sorted_.mapInArrow(join, "key binary, first long, body binary")
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ends string")


def _chunks(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch({"key": pa.array([r[0] for r in rows], pa.binary()), "first": pa.array([r[1] for r in rows], pa.int64()), "body": pa.array([r[2] for r in rows], pa.binary())})


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch({"key": pa.array([r[0] for r in rows], pa.binary()), "ends": pa.array([r[1] for r in rows], pa.string())})


def burst(suffixes: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """(containers of at most `limit` turns, the heads that burst on the way).

    suffixes and containers have (head, depth, up, path, turns, n, conv, ends): the trie head a suffix is
    under and its depth, the smallest member of the head's parent, the burst heads above, and the whole
    conversation with its copies' number and smallest id and its members' hash. A head that burst has
    lcp, the depth down to which its suffixes are the same. A single suffix never bursts.
    """
    small, heads = [], []
    while True:
        size = F.size("turns")
        by_head = suffixes.groupBy("head").agg(
            F.sum(size - F.col("depth") + 1).alias("load"), F.count("*").alias("many"), F.min("depth").alias("depth"), F.min("up").alias("up"), F.min("path").alias("path"), F.min("turns").alias("low"), F.max("turns").alias("high"),
            F.min("conv").alias("conv"), F.sum("n").alias("n"), F.min(size).alias("shortest"), F.min_by("ends", size).alias("ends"),
        )
        same = F.zip_with("low", "high", lambda x, y: F.coalesce(x["id"].eqNullSafe(y["id"]), F.lit(False)))
        large = stored(by_head.where((F.col("load") > limit) & (F.col("many") > 1)).withColumn("lcp", (F.array_position(same, F.lit(False)) - 1).cast("int")).drop("high", "load", "many"))
        if large.isEmpty():
            small.append(suffixes)
            return reduce(DataFrame.unionByName, small), heads
        heads.append(large)
        small.append(suffixes.join(large.select("head"), "head", "left_anti"))
        on = suffixes.join(large.select("head", "lcp", F.col("conv").alias("top")), "head").where(F.size("turns") > F.col("lcp"))
        next_ = F.element_at("turns", F.col("lcp") + 1)["id"]
        suffixes = stored(on.select(_short(F.concat("head", next_)).alias("head"), (F.col("lcp") + 1).alias("depth"), F.col("top").alias("up"), F.concat("path", F.array("head")).alias("path"), "turns", "n", "conv", "ends"))


def chains(heads: DataFrame) -> DataFrame:
    """The nodes of heads that burst, from each head down to where its suffixes part, with `alone`, what they save by themselves and below in the chain."""
    at = heads.withColumn("at", F.explode(F.sequence("depth", "lcp")))
    words = F.when(F.col("at") > 0, F.element_at("low", F.greatest("at", F.lit(1)))["words"]).otherwise(0)
    last = F.col("at") == F.col("lcp")
    nodes = at.select("head", "at", "conv", F.when(F.col("at") == F.col("depth"), F.col("up")).otherwise(F.col("conv")).alias("parent"), "n", ((F.col("n") - 1) * words).alias("own"), last.alias("last"), F.when(last & (F.col("shortest") == F.col("lcp")), F.col("ends")).otherwise(NONE).alias("ends"))
    return nodes.withColumn("alone", F.sum("own").over(Window.partitionBy("head").orderBy(F.desc("at"))))


def sweep(containers: DataFrame) -> DataFrame:
    """The nodes of containers' suffixes, each container's first node with `path`, the burst heads above it. A task sorts its containers' suffixes and takes them in order; it holds the nodes of one container."""
    rows = containers.select("head", "depth", "up", "path", F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["id"])), "")).alias("ids"), F.transform("turns", lambda x: x["words"]).alias("words"), "n", "conv", "ends")

    def run(batches):
        head, before, nodes, stack, up, path = None, b"", [], [], None, None

        def open_(depth, words):
            nodes.append([None, depth, stack[-1] if stack else -1, 0, 0, 0, words, 0, NONE])  # conv, depth, parent, n, children, leaves, words, saved, ends
            stack.append(len(nodes) - 1)

        def close():
            own = nodes[stack.pop()]
            own[5] = own[5] or 1
            own[7] += (own[3] - 1) * own[6]
            if stack:
                over = nodes[stack[-1]]
                over[0] = own[0] if over[0] is None else min(over[0], own[0])
                over[3], over[4], over[5], over[7] = over[3] + own[3], over[4] + 1, over[5] + own[5], over[7] + own[7]

        def done():
            while stack:
                close()
            out = [(x[0], x[1], nodes[x[2]][0] if x[2] >= 0 else up, x[3], x[4], x[5], x[7], x[8], None if x[2] >= 0 else path) for x in nodes]
            nodes.clear()
            return _nodes(out)

        for batch in batches:
            for row in batch.to_pylist():
                ids, words = row["ids"], row["words"]
                if row["head"] != head:
                    if nodes:
                        yield done()
                    head, up, path, common = row["head"], row["up"], row["path"], row["depth"]
                    open_(common, words[common - 1] if common else 0)
                else:
                    common = row["depth"]
                    while before[common * WIDE : (common + 1) * WIDE] == ids[common * WIDE : (common + 1) * WIDE] and len(before) > common * WIDE:
                        common += 1
                    while nodes[stack[-1]][1] > common:
                        close()
                for d in range(common + 1, len(words) + 1):
                    open_(d, words[d - 1])
                own, before = nodes[stack[-1]], ids
                own[0] = row["conv"] if own[0] is None else min(own[0], row["conv"])
                own[3], own[8] = own[3] + row["n"], row["ends"]
        if nodes:
            yield done()

    return rows.repartition("head").sortWithinPartitions("head", "ids").mapInArrow(run, f"{NODE}, path array<binary>")


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 7, pa.string(), pa.list_(pa.binary())]
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "path")
    return pa.record_batch({c: pa.array(v, kind) for c, v, kind in zip(names, zip(*rows), kinds)})


def trie(lists: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the prefix trie of conversations (conv_id, turns: id of 16 bytes and words), one conv_id once.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a node's
    smallest member and depth, its parent's smallest member (null for the root), how many conversations
    begin with it, its children, the childless nodes below (itself, if it is one), what sharing it and all
    below saves in words, and the hash of the members that end there.

    Copies are one suffix, however many. A burst container's suffixes move once, by a join on its head that
    Spark may split, and what they share is skipped, so each burst parts them; only a conversation by
    itself can be longer than the limit. A conversation is one row here, of some 24 bytes a turn.
    Conversations without turns are members of the root; an empty table gives no nodes.
    """
    key = _short(F.array_join(F.transform("turns", lambda x: F.hex(x["id"])), ""))
    convs = stored(lists.select("conv_id", key.alias("key"), "turns"))
    classes = convs.groupBy("key").agg(F.first("turns").alias("turns"), F.count("*").alias("n"), F.min("conv_id").alias("conv"))
    suffixes = classes.join(member_hashes(convs), "key")
    root = {"head": F.lit(b""), "depth": F.lit(0), "up": F.lit(None).cast("long"), "path": F.array().cast("array<binary>")}
    containers, heads = burst(stored(suffixes.select(*(v.alias(k) for k, v in root.items()), "turns", "n", "conv", "ends")), limit)
    swept = stored(sweep(containers))
    nodes = swept.drop("path")
    if not heads:
        return nodes
    over = stored(reduce(DataFrame.unionByName, heads))
    chain = chains(over)
    tops = swept.where("path IS NOT NULL").select("path", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    whole = chain.groupBy("head").agg(F.max("alone").alias("saved")).join(over.select("head", "path"), "head").select("path", F.lit(0).cast("long").alias("leaves"), "saved")
    # each container and each burst head counts for all burst heads above it, and as a child of the last
    each = tops.unionByName(whole).select(F.posexplode("path").alias("k", "head"), F.size("path").alias("last"), "leaves", "saved")
    below = each.groupBy("head").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count(F.when(F.col("k") == F.col("last") - 1, 1)).alias("children"))
    inner = chain.join(below, "head").select(
        F.col("conv").alias("conv_id"), F.col("at").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(F.col("last"), F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("alone") + F.col("saved")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
    return inner.unionByName(nodes)


def conversation_trie(conversations: DataFrame, family: int = 20, shared: int = 4, limit: int = LIMIT) -> DataFrame:
    """The trie of all rebuilt conversations; see `turn_lists`, `rebuilt` and `trie`. Repeated rows are turns of their own; further columns are ignored."""
    return trie(rebuilt(turn_lists(conversations), family, shared), limit)
