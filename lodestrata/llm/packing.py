"""Filling containers of fixed capacity with texts.

Shortest-pack-first over the length histogram: lengths are placed longest first, each into the packs that are
shortest so far, and only the counts of packing patterns are kept. The histogram has at most ``capacity`` entries and
leaves at most two patterns per entry, whatever the number of texts, so this step is bounded by the capacity alone.
Texts then find their place by rank: the r-th text of a length takes the r-th slot for that length. Ranks are counted
in buckets, so a length that a third of all texts share is ranked in many tasks. The table of slots is sent to all tasks
only while it is small; its size is known on the driver.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.codepoints import map_text

#: Largest capacity: bounds the histogram and the patterns on the driver.
MOST_CAPACITY = 1_000_000
#: Items of one bucket of ranks on the average; there are 64 buckets at least.
BUCKET_ITEMS = 500_000
#: Slots (about 100 bytes each) that may go to every task; more are joined by length and bucket.
MOST_BROADCAST = 200_000


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, number of such packs), for ``histogram`` as number of items by length; every item is placed once."""
    open_: list[tuple[int, int, tuple[int, ...], int]] = []  # heap: most room first
    closed: list[tuple[tuple[int, ...], int]] = []
    serial = 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit the capacity {capacity}")
        left = histogram[length]
        while left:
            if open_ and -open_[0][0] >= length:
                room, _, pack, count = heapq.heappop(open_)
                used = min(count, left)
                if count > used:
                    serial += 1
                    heapq.heappush(open_, (room, serial, pack, count - used))
                room = -room - length
            else:
                room, pack, used = capacity - length, (), left
            left -= used
            if room:
                serial += 1
                heapq.heappush(open_, (-room, serial, (*pack, length), used))
            else:
                closed.append(((*pack, length), used))
    return closed + [(pack, count) for _, _, pack, count in open_]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first container, containers): whose items of that length the containers of a pattern take."""
    taken: dict[int, int] = {}
    out, base = [], 0
    for pack, count in patterns:
        for length, same in groupby(pack):
            n = count * sum(1 for _ in same)
            begin = taken.get(length, 0)
            taken[length] = begin + n
            out.append((length, begin, begin + n, base, count))
        base += count
    return out


def byte_pieces(text: str, capacity: int) -> list[tuple[int, int]]:
    """(first byte, tokens) of each piece of a text: whole characters, at most ``capacity`` tokens; the last also holds the closing token."""
    data = text.encode()
    out, a = [], 0
    while len(data) - a + 1 > capacity:
        b = a + capacity
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if b == a:
            raise ValueError("a character needs more tokens than the capacity")
        out.append((a, b - a))
        a = b
    out.append((a, len(data) - a + 1))
    return out


def _capacities(containers: DataFrame) -> dict[str, int]:
    """The capacity of each kind; rows without one are left out."""
    kinds = [(r[0], int(r[1])) for r in containers.select("container_kind", "capacity_tokens").dropna().distinct().limit(1001).collect()]
    if len(kinds) > 1000 or any(not 4 <= c <= MOST_CAPACITY for _, c in kinds):
        raise ValueError(f"at most 1000 kinds of containers, of 4 to {MOST_CAPACITY} tokens each")
    if len(dict(kinds)) < len(kinds):
        raise ValueError("a kind of containers has two capacities")
    return dict(kinds)


def pack_items(docs: DataFrame, containers: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(container_kind, doc_id, piece_no, n_pieces, first_byte, n_tokens): what has to be placed.

    Tokens are those of the byte-level ByT5 tokenizer: one for each UTF-8 byte and a closing one. Only a text with more
    tokens than the capacity is divided. Null texts have no items, empty ones have one token; further columns are ignored.
    """
    kinds = sorted(_capacities(containers).items())
    schema = "container_kind string, doc_id long, piece_no int, n_pieces int, first_byte long, n_tokens long"
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.octet_length(text_col) + 1).cast("long").alias("n_tokens")).where(F.col("text").isNotNull())
    if not kinds:
        return docs.sparkSession.createDataFrame([], schema)
    least = min(c for _, c in kinds)
    whole = F.array(*[F.lit(k) for k, _ in kinds])
    small = sized.where(F.col("n_tokens") <= least).select(F.explode(whole).alias("container_kind"), "doc_id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).cast("long").alias("first_byte"), "n_tokens")

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), strict=True):
            for kind, capacity in kinds:
                parts = byte_pieces(text, capacity)
                out += [(kind, doc, k, len(parts), a, n) for k, (a, n) in enumerate(parts)]
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["container_kind", "doc_id", "piece_no", "n_pieces", "first_byte", "n_tokens"])

    large = map_text(sized.where(F.col("n_tokens") > least).select("doc_id", "text"), run, schema, "text")
    return small.unionByName(large)


def pack(docs: DataFrame, containers: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``pack_items`` with the ``container_no`` of each item, from 0 within its kind; no container holds more tokens than its capacity.

    A kind of two capacities is refused.

    Repeated rows are placed each. The same rows get the same containers, whatever the partitions, up to ties
    between equal ids.
    """
    spark = docs.sparkSession
    items = pack_items(docs, containers, id_col=id_col, text_col=text_col)
    caps = _capacities(containers)
    histograms: dict[str, dict[int, int]] = {k: {} for k in caps}
    for r in items.groupBy("container_kind", "n_tokens").count().collect():  # at most `capacity` rows of each kind
        histograms[r[0]][int(r[1])] = int(r[2])
    places = [(kind, *s) for kind, h in histograms.items() for s in slots(pack_histogram(h, caps[kind]))]
    table = spark.createDataFrame(places, "kind string, size long, rank_from long, rank_to long, base long, containers long")

    buckets = max(64, sum(sum(h.values()) for h in histograms.values()) // BUCKET_ITEMS)
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)))
    offsets = items.groupBy("container_kind", "n_tokens", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("container_kind", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("container_kind", "n_tokens", "bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("container_kind", "n_tokens", "bucket").orderBy("doc_id", "piece_no")
    ranked = items.withColumn("k", F.row_number().over(within) - 1).join(offsets.drop("n"), ["container_kind", "n_tokens", "bucket"]).withColumn("rank", F.col("k") + F.col("offset"))
    here = (F.col("kind") == F.col("container_kind")) & (F.col("size") == F.col("n_tokens")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    if len(places) <= most_broadcast:
        placed = ranked.join(F.broadcast(table), here)
    else:  # each bucket of ranks only meets the slots it reaches into; a length that many texts share is split
        own = offsets.select(F.col("container_kind").alias("kind"), F.col("n_tokens").alias("size"), F.col("bucket").alias("part"), "offset", (F.col("offset") + F.col("n")).alias("stop"))
        reached = table.join(own, ["kind", "size"]).where((F.col("rank_from") < F.col("stop")) & (F.col("rank_to") > F.col("offset"))).drop("offset", "stop")
        placed = ranked.join(reached, here & (F.col("part") == F.col("bucket")))
    number = F.col("base") + F.pmod(F.col("rank") - F.col("rank_from"), F.col("containers"))
    return placed.select("container_kind", number.alias("container_no"), "doc_id", "piece_no", "n_pieces", "first_byte", "n_tokens")


def container_fill(placed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, containers, items, used_tokens, unused_tokens, fill) for each kind."""
    by = placed.groupBy("container_kind").agg(F.countDistinct("container_no").alias("containers"), F.count("*").alias("items"), F.sum("n_tokens").alias("used_tokens"))
    total = F.col("containers") * F.col("capacity_tokens")
    return by.join(containers.select("container_kind", "capacity_tokens"), "container_kind").select("container_kind", "containers", "items", "used_tokens", (total - F.col("used_tokens")).alias("unused_tokens"), F.round(F.col("used_tokens") / total, 6).alias("fill"))
