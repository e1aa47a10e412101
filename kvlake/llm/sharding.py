"""Sharding by histogram sort: equal bytes, equal texts together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, texts

#: Bits of the key that one round of counting resolves, and bits of the key in all.
ROUND, BITS = 12, 60
#: Parts in which a cell is dealt when its rows are numbered, so that a group of copies is not numbered in one task, and rows of a cell for each part more.
PARTS, ROWS = 16, 1 << 20


def _splitters(rows: DataFrame, key: str, wanted: list[float], tolerance: float) -> list[tuple[int, int, int]]:
    """For each wanted number of bytes, (boundary, bytes below it, bytes in the smallest cell above it that counting reached).

    Each round counts, exactly and over all rows, the bytes in 2**ROUND cells of every cell that still
    holds a wanted number, and moves the boundary to the nearest of the new cells' borders, until that
    is within tolerance or a cell is a single key.
    """
    cells = {(0, BITS): 0}  # cell (number, bits not yet resolved) -> bytes below it
    found: dict[int, tuple[int, int, int]] = {}
    open_at = {k: (0, BITS) for k in range(len(wanted))}
    while open_at:
        left = next(iter(cells))[1]
        to = left - ROUND
        numbers = sorted({c for c, _ in cells})
        part = rows if left == BITS else rows.where(F.shiftright(key, left).isin(numbers))
        counts: dict[int, dict[int, int]] = {c: {} for c in numbers}
        for r in part.groupBy(F.shiftright(key, to).alias("cell")).agg(F.sum("size").alias("bytes")).collect():  # at most 2**ROUND for each splitter
            counts[r["cell"] >> ROUND][r["cell"]] = r["bytes"]
        below, inside = {}, {}
        for c in numbers:
            total = cells[c, left]
            for cell in sorted(counts[c]):
                below[cell], inside[cell] = total, counts[c][cell]
                total += counts[c][cell]
        cells = {}
        for k, c in list(open_at.items()):
            own = [x for x in below if x >> ROUND == c[0]]
            cell = max((x for x in own if below[x] <= wanted[k]), default=min(own, default=None))
            if cell is None:
                found[k] = (c[0] << left, 0, 0)
                del open_at[k]
                continue
            down, up = wanted[k] - below[cell], below[cell] + inside[cell] - wanted[k]
            near = (cell << to, below[cell], inside[cell]) if down <= up else ((cell + 1) << to, below[cell] + inside[cell], 0)
            if min(down, up) <= tolerance or to == 0:
                found[k] = near if min(down, up) <= tolerance else (cell << to, below[cell], inside[cell])
                del open_at[k]
            else:
                open_at[k] = (cell, to)
                cells[cell, to] = below[cell]
    return [found[k] for k in range(len(wanted))]


def shard_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = 0.005) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs (doc_id, text).

    Law `bytes`: the shards' sizes are within `tolerance` of a shard's fair share at each border (or as
    near as single documents allow). Documents are sorted by the first 60 bits of their text's MD5, so
    equal texts lie together and in one shard; only where a group of equal texts is itself larger than
    the tolerance and lies on a border, that group is sorted on by a hash of doc_id and the row's place
    in the input, and cut. size is the text's UTF-8 bytes plus 1, a null text having none (its crc32 is 0). slot numbers a shard's rows
    from 0 without gaps. Null ids and repeated rows are rows like others; an empty table gives an empty
    result; other columns are ignored.
    """
    rows = texts(docs).select(
        "doc_id",
        (F.octet_length("text").cast("long") + 1).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 15), 16, 10).cast("long").alias("key"),
        F.shiftrightunsigned(F.xxhash64("doc_id", F.monotonically_increasing_id()), 64 - BITS).alias("salt"),
    )
    rows = stored(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    wanted = [total * k / shards for k in range(1, shards)]
    allowed = tolerance * total / shards
    shard = F.lit(0)
    for want, (border, below, inside) in zip(wanted, _splitters(rows, "key", wanted, allowed)):
        beyond = F.col("key") >= border
        if inside and min(want - below, below + inside - want) > allowed:  # a single large group lies on the border
            group = rows.where(F.col("key") == border)
            cut, _, _ = _splitters(group, "salt", [want - below], allowed)[0]
            beyond = (F.col("key") > border) | (F.col("key") == border) & (F.col("salt") >= cut)
        shard = shard + beyond.cast("int")
    # the one exchange by shard: rows are numbered within cells, and a cell's first number follows from the counts of those before it
    rows = rows.withColumns({"shard": shard, "cell": F.shiftright("key", BITS - ROUND)})
    parts = rows.groupBy("cell").agg((F.lit(PARTS) + F.floor(F.count("*") / ROWS)).alias("parts"))
    rows = rows.join(F.broadcast(parts), "cell").withColumn("part", F.col("salt") % F.col("parts"))  # at most 2**ROUND cells
    before = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "cell", "part").agg(F.count("*").alias("n")).withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("shard", "cell", "part").orderBy("key", "salt", "doc_id", "size")
    placed = rows.withColumn("at", F.row_number().over(inside) - 1).join(F.broadcast(counts.select("shard", "cell", "part", "from")), ["shard", "cell", "part"])  # at most shards + PARTS * 2**ROUND counts, and one more for each ROWS rows
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("from") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
