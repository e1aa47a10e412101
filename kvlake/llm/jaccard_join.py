"""N-gram Jaccard join by grouped prefixes.

Every document becomes the set of hashes of its word shingles. Under any one total order of all
shingles, two sets of Jaccard similarity s or more share a shingle among the first
n - ceil(s * n) + 1 of each, the prefix; the order used here puts shingles that occur often last.
Documents with the same prefix and set size form one group, documents with the same set one class.
Groups meet over their prefix shingles.

Each class has a bitmap: the parity of its shingles in each of 512 buckets. Two bitmaps differ in at
most as many bits as the sets differ in shingles, so most pairs that cannot link are refused by bit
counts, inside the join that would form them. A group keeps one member's bitmap and the greatest
distance of the others from it, which bounds all pairs of members of two groups.

First each group is verified with the least group of each of its shingles, then groups in large
meetings with a few others; what these links join needs no further pair. All pairs of groups that
still lie in different components and pass the bounds of size, position and bitmap are then expanded
to their members and verified exactly on the full sets.

The result is exact (up to collisions of 64-bit hashes): every link of two different sets is either
verified or inside a component that verified links already join.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import discard, stored, texts

#: Document frequency from which a shingle counts as frequent, and how many such shingles at most, the most frequent, are told to all tasks (8 MB).
FREQUENT, TOLD = 12, 1 << 20
#: Shingles that a task counts at once, and about so many that one block of the hash space gets.
RUN, PER_BLOCK = 1 << 20, 1 << 20
NO_ID = -(1 << 63)
#: Groups at a shingle's meeting from which on it is large, the groups that each of a large one is first verified with, and rounds of that at most.
LARGE, CENTRES, ROUNDS = 16, 8, 2
#: A bitmap's columns, 64 bits each.
BITS = [f"b{k}" for k in range(8)]


def _need(n_a: Column, n_b: Column, percent: int) -> Column:
    """Shingles that two similar sets of these sizes have in common at least."""
    both = F.lit(percent) * (n_a + n_b) + F.lit(99 + percent)
    return ((both - both % (100 + percent)) / (100 + percent)).cast("long")


def _near(a: str, b: str, percent: int, slack: Column | int = 0) -> Column:
    """Whether sets with sizes a_n, b_n and bitmaps a_b0..., b_b0..., each known up to some bits (slack in all), can be similar."""
    n_a, n_b = F.col(f"{a}_n"), F.col(f"{b}_n")
    apart = sum((F.bit_count(F.col(f"{a}_{x}").bitwiseXOR(F.col(f"{b}_{x}"))) for x in BITS), F.lit(0))
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (apart - slack <= n_a + n_b - 2 * _need(n_a, n_b, percent))


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = words.utf8(column)
    h, doc = words.split(data, offsets, words.plain_words())
    count = np.bincount(doc, minlength=len(column))
    end = np.cumsum(count)
    s = h * words.M1
    for k, m in zip(range(1, width), (words.M2, words.M3, words.M4) * width):
        s[:-k] = s[:-k] * words.M4 + h[k:] * (m + np.uint64(2 * k))
    s = words.mixed(s)
    out = []
    for n, e in zip(count.tolist(), end.tolist()):
        if n >= width:
            x = np.sort(s[e - n : e - width + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif n:  # the whole sequence as one
            own = words.mixed(h[e - n : e] + np.arange(1, n + 1, dtype=np.uint64) * words.M4)
            out.append(words.mixed(np.bitwise_xor.reduce(own, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signature(s: np.ndarray) -> int:
    """One 63-bit number for a set."""
    if not len(s):
        return -1
    k = np.arange(len(s), dtype=np.uint64)
    return int(words.mixed(np.array([np.bitwise_xor.reduce(words.mixed(s + k * words.M4)) + np.uint64(len(s))], np.uint64))[0] >> np.uint64(1))


def bitmap(s: np.ndarray) -> np.ndarray:
    """The parity of a set's number of shingles in each bucket, as 64-bit numbers."""
    odd = np.bincount((s & np.uint64(64 * len(BITS) - 1)).astype(np.int64), minlength=64 * len(BITS)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(batches, width: int):
    for batch in batches:
        for a, z in words.pieces(batch.column("text")):
            yield batch.column("doc_id").slice(a, z - a), shingle_sets(batch.column("text").slice(a, z - a), width)


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """Frequent shingles (their upper 48 bits), by document frequency. All documents count; equal sets that meet in one run of a task count once. Only the order of shingles depends on it, never a result.

    A run of a task counts its shingles first, so that one that is in all documents costs an entry a run.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(8, (size // 6 // PER_BLOCK).bit_length())

    def blocks(rows):
        kept, seen = [], set()

        def counted():
            x, n = np.unique(np.concatenate(kept) >> np.uint64(16), return_counts=True)
            block = x >> np.uint64(48 - bits)
            edge = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            parts = list(zip(block[edge].tolist(), np.split(x, edge[1:]), np.split(n, edge[1:])))
            kept.clear()
            return pa.record_batch({
                "block": pa.array([k for k, _, _ in parts], pa.int64()), "shingles": pa.array([_packed(np.diff(part, prepend=np.uint64(0))) for _, part, _ in parts], pa.binary()),
                "counts": pa.array([_packed(many) for _, _, many in parts], pa.binary()),
            })

        size = 0
        for _, sets in _sets(rows, width):
            for s in sets:
                if len(s) and (mark := _signature(s)) not in seen:
                    seen.add(mark)
                    kept.append(s)
                    size += len(s)
            if size > RUN:
                yield counted()
                size = 0
                seen.clear()
        if kept:
            yield counted()

    def merged(group: pa.Table) -> pa.Table:
        x = np.concatenate([np.cumsum(_unpacked(b), dtype=np.uint64) for b in group.column("shingles").to_pylist()])
        n = np.concatenate([_unpacked(b) for b in group.column("counts").to_pylist()]).astype(np.int64)
        by = np.argsort(x, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], x[by][1:] != x[by][:-1])))
        x, n = x[by][first], np.add.reduceat(n[by], first)
        often = n >= FREQUENT
        return pa.table({"shingle": pa.array(x[often].astype(np.int64)), "n": pa.array(n[often])})

    counted = stored(docs.mapInArrow(blocks, "block long, shingles binary, counts binary").groupBy("block").applyInArrow(merged, "shingle long, n long"))
    least, told = 1 << 62, 0
    for n, many in sorted(((r["n"], r["count"]) for r in counted.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().collect()), reverse=True):
        if (told := told + many) > TOLD:
            break
        least = n
    top = counted.where(F.col("n") >= least).toArrow()
    return top["shingle"].to_numpy()[np.lexsort((top["shingle"].to_numpy(), top["n"].to_numpy()))].astype(np.uint64)


def _prefixes(docs: DataFrame, told, width: int, percent: int) -> DataFrame:
    """(doc_id, n, sig, gid, prefix, bitmap columns): the prefix only where a task meets the group for the first time."""

    def run(rows):
        place = np.argsort(told.value)
        known = told.value[place]
        seen: set[int] = set()
        for ids, sets in _sets(rows, width):
            n, sig, gid, prefix = [], [], [], []
            for s in sets:
                m = len(s)
                n.append(m)
                sig.append(_signature(s))
                if m and len(known):
                    short = s >> np.uint64(16)
                    at = np.minimum(np.searchsorted(known, short), len(known) - 1)
                    ordered = s[np.argsort(np.where(known[at] == short, place[at] + 1, 0), kind="stable")]
                else:
                    ordered = s
                part = ordered[: m - (percent * m + 99) // 100 + 1]
                g = (_signature(np.sort(part)) * 31 + m) & (1 << 62) - 1 if m else -1
                gid.append(g)
                prefix.append(None if g in seen or not m else part.astype(np.int64))
                seen.add(g)
                if len(seen) > 1 << 20:
                    seen.clear()
            maps = np.stack([bitmap(s) for s in sets]) if sets else np.zeros((0, len(BITS)), np.int64)
            columns = {"n": pa.array(n, pa.int64()), "sig": pa.array(sig, pa.int64()), "gid": pa.array(gid, pa.int64()), "prefix": pa.array(prefix, pa.list_(pa.int64()))}
            yield pa.record_batch({"doc_id": ids} | columns | {b: pa.array(np.ascontiguousarray(maps[:, k])) for k, b in enumerate(BITS)})

    return docs.mapInArrow(run, "doc_id long, n long, sig long, gid long, prefix array<long>, " + ", ".join(f"{b} long" for b in BITS))


def _full_sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(sig, shingles) of the classes in pairs, from the text of one member each."""

    def run(rows):
        for _, sets in _sets(rows, width):
            yield pa.record_batch({"sig": pa.array([_signature(s) for s in sets], pa.int64()), "shingles": pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())})

    wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
    members = stored(classes.join(wanted, "sig", "left_semi").select(F.col("member").alias("doc_id")).distinct())  # written, so that its size is known to the join
    own = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text").join(members, "doc_id", "left_semi")
    return stored(own.mapInArrow(run, "sig long, shingles binary").dropDuplicates(["sig"]))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of pairs whose whole sets are similar enough."""

    def run(rows):
        for batch in rows:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))  # no copy
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("sig").alias("b"), F.col("shingles").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those (a, b) of pairs that link; the whole sets, the largest thing written, go when they have been compared."""
    sets = _full_sets(docs, classes, pairs, width)
    found = stored(_verified(pairs, sets, percent))
    discard(sets)
    return found


def _stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that join the same nodes in fewer steps: each task ties every node of its own edges to the least one that these reach."""

    def tied(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([x.column(c).to_numpy() for x in some]) for c in ("a", "b")]
        node, at = np.unique(np.concatenate(ends), return_inverse=True)
        a, b = np.split(at, 2)
        least = np.arange(len(node))
        while len(a):
            low, high = np.minimum(least[a], least[b]), np.maximum(least[a], least[b])
            np.minimum.at(least, high, low)  # a root's own label, so that its whole tree follows
            while not np.array_equal(least, up := least[least]):
                least = up
            open_ = least[a] != least[b]
            a, b = a[open_], b[open_]
        return pa.record_batch({"a": pa.array(node), "b": pa.array(node[least])})

    def run(batches):
        some, size = [], 0
        for batch in batches:
            some.append(batch)
            if (size := size + batch.num_rows) > RUN:
                yield tied(some)
                some, size = [], 0
        if some:
            yield tied(some)

    return edges.select("a", "b").distinct().mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of edges (a, b); comp is the smallest node of its component. Tasks first join what their own edges join. Then in each step a node takes the least label among its neighbours' and then that label's own label, until none changes."""
    edges = stored(_stars(edges))
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    state = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("comp")))
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = state.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = state.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        new = stored(step.join(jump, "comp").select("node", "old", F.least("comp", "root").alias("comp")))
        state = new.select("node", "comp")
        if new.where("old != comp").isEmpty():
            return state


def _extended(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """comp (node, comp) after further edges (a, b): only what these join is labelled anew, over one edge between two components."""
    own = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    between = edges.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    top = components(between.where("a != b"))
    old = comp.join(top.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
    return stored(old.union(top.join(comp, "node", "left_anti")))


def _named(df: DataFrame, name: str, *rest: str) -> DataFrame:
    """Size, bitmap and other columns of df as name_column."""
    return df.select(*(F.col(c).alias(f"{name}_{c}") for c in ("n", *BITS, *rest)))


def _grouped(classes: DataFrame) -> DataFrame:
    """(gid, n, head, bitmap columns, reach) of each group: its first class, that one's bitmap, and how many bits those of its other classes are away at most."""
    heads = classes.join(classes.groupBy("gid").agg(F.min("sig").alias("sig")), ["gid", "sig"], "left_semi").select("gid", "n", F.col("sig").alias("head"), *BITS)
    away = sum((F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(b))) for b in BITS), F.lit(0))
    reach = _named(classes, "x", "gid").join(heads, F.col("x_gid") == F.col("gid")).groupBy("gid").agg(F.max(away).alias("reach"))
    return stored(heads.join(reach, "gid"))


def _shared(rows: DataFrame) -> DataFrame:
    """(token, gid, pos, lead): the places of prefix shingles that more than one group has, and the least group of each."""
    index = rows.where("prefix IS NOT NULL").select("gid", "prefix").dropDuplicates(["gid"]).select("gid", F.posexplode("prefix").alias("pos", "token"))
    tokens = index.groupBy("token").agg(F.min("gid").alias("lead"), F.count("*").alias("groups")).where("groups > 1").select("token", "lead")
    return stored(index.join(tokens, "token").select("token", "gid", "pos", "lead"))


def _heads(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of first classes of the pairs (gid, gid_2) of groups, less those that cannot be similar."""
    both = pairs.join(_named(groups, "x", "gid", "head"), F.col("gid") == F.col("x_gid")).join(_named(groups, "y", "gid", "head"), (F.col("gid_2") == F.col("y_gid")) & _near("x", "y", percent))
    return both.select(F.least("x_head", "y_head").alias("a"), F.greatest("x_head", "y_head").alias("b"))


def _star(shared: DataFrame, groups: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes to verify first: a group's first class with the group's others, and with the first class of the least group of each shingle."""
    met = shared.where("gid != lead").select("gid", F.col("lead").alias("gid_2")).distinct()
    inner = _named(classes, "x", "gid", "sig").join(_named(groups, "y", "gid", "head"), (F.col("x_gid") == F.col("y_gid")) & (F.col("x_sig") != F.col("y_head")) & _near("x", "y", percent))
    return _heads(met, groups, percent).union(inner.select(F.least("x_sig", "y_head").alias("a"), F.greatest("x_sig", "y_head").alias("b"))).distinct()


def _mixed(shared: DataFrame, groups: DataFrame, classes: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes with their components, groups with their least and greatest component, the places of shingles whose groups lie in different components, with the number of those groups)."""
    of = stored(classes.join(comp.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig")))
    spread = stored(groups.join(of.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high")), "gid"))
    placed = shared.join(spread.select("gid", "low", "high"), "gid")
    tokens = placed.groupBy("token").agg(F.min("low").alias("from"), F.max("high").alias("to"), F.count("*").alias("groups")).where("from < to").select("token", "groups")
    return of, spread, stored(placed.join(tokens, "token").select("token", "gid", "pos", "low", "high", "groups"))


def _more_stars(mixed: DataFrame, spread: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of classes to verify before all pairs of a large meeting are formed: its groups with a few of them, the same ones in all meetings as far as they are in them."""
    large = mixed.where(F.col("groups") >= LARGE).select("token", "gid", "low")
    turns = np.random.default_rng(turn).integers(1, 1 << 61, CENTRES).tolist()
    centres = large.groupBy("token").agg(*(F.min(F.col("gid").bitwiseXOR(F.lit(x))).alias(f"c{k}") for k, x in enumerate(turns)))
    met = stored(large.join(centres, "token"))
    pairs = None
    for k, x in enumerate(turns):
        own = met.select("gid", F.col(f"c{k}").bitwiseXOR(F.lit(x)).alias("gid_2")).where("gid != gid_2")
        pairs = own if pairs is None else pairs.union(own)
    return _heads(pairs.distinct(), spread, percent).distinct()


def _crossing(of: DataFrame, spread: DataFrame, mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in different components that the bounds of size, position and bitmap leave, of groups that share a prefix shingle or are one group."""
    a = _named(mixed.join(spread.select("gid", "n", "reach", *BITS), "gid"), "x", "token", "gid", "pos", "low", "high", "reach")
    b = a.select(*(F.col(c).alias("y" + c[1:]) for c in a.columns))
    # the first shingle that a pair has in common lies among the first n - need + 1 of both
    need = _need(F.col("x_n"), F.col("y_n"), percent)
    early = (F.col("x_pos") <= F.col("x_n") - need) & (F.col("y_pos") <= F.col("y_n") - need)
    apart = F.expr("x_gid < y_gid AND least(x_low, y_low) < greatest(x_high, y_high)")
    pairs = a.join(b, (F.col("x_token") == F.col("y_token")) & apart & early & _near("x", "y", percent, F.col("x_reach") + F.col("y_reach")))
    pairs = pairs.select(F.col("x_gid").alias("gid"), F.col("y_gid").alias("gid_2")).distinct().union(spread.where("low < high").select("gid", F.col("gid").alias("gid_2")))
    found = pairs.join(_named(of, "x", "gid", "sig", "comp"), F.col("gid") == F.col("x_gid"))
    found = found.join(_named(of, "y", "gid", "sig", "comp"), (F.col("gid_2") == F.col("y_gid")) & (F.col("x_comp") != F.col("y_comp")) & _near("x", "y", percent))
    return found.select(F.least("x_sig", "y_sig").alias("a"), F.greatest("x_sig", "y_sig").alias("b")).distinct()


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    Words are runs of bytes other than blank and 0x09-0x0D, with A-Z lower-cased; a text with fewer
    than `width` words is one shingle; one without words, empty or null, has none and links with
    nothing. Rows link when 100 * |intersection| >= percent * |union|. component_id is the smallest
    doc_id that links reach. Repeated rows and ties link like any others; a row with a null doc_id
    carries links too and gets the least id of its component (null if no row there has one); an
    empty table gives an empty result; other columns are ignored.
    """
    docs = texts(docs)
    told = docs.sparkSession.sparkContext.broadcast(_frequent(docs, width))
    rows = stored(_prefixes(docs, told, width, percent))
    classes = stored(rows.where("n > 0").groupBy("sig", "gid", "n").agg(F.min("doc_id").alias("least_id"), F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("member"), *(F.max(b).alias(b) for b in BITS)))
    groups, shared = _grouped(classes), _shared(rows)
    tried = stored(_star(shared, groups, classes, percent))
    links = _links(docs, classes, tried, width, percent) if not tried.isEmpty() else tried
    comp = components(links) if not links.isEmpty() else links.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    of, spread, mixed = _mixed(shared, groups, classes, comp)
    for turn in range(ROUNDS):
        if mixed.where(F.col("groups") >= LARGE).isEmpty():
            break
        more = stored(_more_stars(mixed, spread, percent, turn).join(tried, ["a", "b"], "left_anti"))
        if more.isEmpty():
            break
        comp, tried = _extended(comp, _links(docs, classes, more, width, percent)), tried.union(more)
        of, spread, mixed = _mixed(mixed.select("token", "gid", "pos"), groups, classes, comp)
    rest = stored(_crossing(of, spread, mixed, percent).join(tried, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        comp = _extended(comp, _links(docs, classes, rest, width, percent))
    of = stored(classes.join(comp.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "least_id", F.coalesce("comp", "sig").alias("comp")))
    of = of.join(of.groupBy("comp").agg(F.min("least_id").alias("component_id")), "comp").select("sig", "component_id")
    return rows.select("doc_id", "n", "sig").join(of, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_row_per_component(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """The rows of docs, unchanged, less those that another row stands for, by their texts alone: of each component one row stays, that with the least doc_id (a null is the largest).

    Rows are told apart by a key written before the join, so rows with a null doc_id or one that others
    have too are compared and kept like any others. A text without words has no near copies and stays.
    """
    row = "__row"
    while row in docs.columns:  # an unused name
        row += "_"
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    comp = jaccard_components(keyed.select(F.col(row).alias("doc_id"), "text"), width, percent).select(F.col("doc_id").alias(row), "component_id")
    ids = keyed.select(row, F.col("doc_id").isNull().alias("none"), "doc_id")
    least = comp.join(ids, row).groupBy("component_id").agg(F.min(F.struct("none", "doc_id", row)).alias("least"))
    return keyed.join(least.select(F.col("least")[row].alias(row)), row, "left_semi").select(*docs.columns)
