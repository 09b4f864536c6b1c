"""Best-two-fit packing of document pieces into sequences of a fixed length.

A bin is filled greedily, largest piece that fits first. If a gap stays, the
bin's smallest piece is taken out again when two unpacked pieces fit the
widened gap more tightly, and the bin is filled on.

Lengths are integers up to the sequence length, so a task packs from counts
per length; each step looks at lengths, not at pieces. Pieces are dealt by a
hash of their key into shards of about ``shard_pieces``: every shard is one
group of bounded size whatever the table's size, no key can make one larger,
and each leaves at most a few sequences that other shards could have filled.

Defined results: a null text is a document of the closing id alone; pieces
with a null or zero length take no room and sit at the end of a sequence; a
piece longer than a sequence raises; repeated rows are packed one by one; an
empty table gives an empty result; further columns of ``pieces`` pass.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from offerlab.llm.bpe import encode_texts
from offerlab.llm.common import need, written

CAPACITY = 2048
SHARD_PIECES = 50_000


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; lengths are 0 to ``capacity``."""
    lengths = np.asarray(lengths, dtype=np.int64)
    if len(lengths) and (lengths.max() > capacity or lengths.min() < 0):
        raise ValueError(f"a piece's length is not in 0..{capacity}")
    count = np.bincount(lengths, minlength=capacity + 1).tolist()
    present = sum(1 << n for n in range(1, capacity + 1) if count[n])  # bit n: some piece of length n is unpacked
    upto = [(1 << (n + 1)) - 1 for n in range(capacity + 1)]
    bins: list[list[int]] = []

    def take(n):
        nonlocal present
        count[n] -= 1
        if not count[n]:
            present &= ~(1 << n)

    def fill(items, gap):
        while gap and (n := (present & upto[gap]).bit_length() - 1) > 0:
            take(n)
            items.append(n)
            gap -= n
        return gap

    def tightest_two(room, over):
        """The unpacked pair with the largest sum in (over, room], larger first."""
        best = None
        x = (present & upto[room - 1]).bit_length() - 1 if room > 1 else 0
        while x > 0 and 2 * x > over:
            y = (present & upto[min(x, room - x)]).bit_length() - 1
            if y == x and count[x] < 2:
                y = (present & upto[x - 1]).bit_length() - 1
            if y > 0 and x + y > over:
                best, over = (x, y), x + y
                if over == room:
                    break
            x = (present & upto[x - 1]).bit_length() - 1
        return best

    while present:
        first = present.bit_length() - 1
        take(first)
        items = [first]
        gap = fill(items, capacity - first)
        if gap and len(items) > 1:
            smallest = min(items)
            pair = tightest_two(gap + smallest, smallest)
            if pair:
                items.remove(smallest)
                for n in pair:
                    take(n)
                items += pair
                gap += smallest - sum(pair)
                count[smallest] += 1
                present |= 1 << smallest
                fill(items, gap)
        bins.append(items)
    # deal the pieces of each length, in order, to the places of that length
    sizes = np.fromiter((n for b in bins for n in b), dtype=np.int64)
    of = np.repeat(np.arange(len(bins)), [len(b) for b in bins]) if bins else np.zeros(0, dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    first_of_bin = np.r_[True, of[1:] != of[:-1]] if len(of) else np.zeros(0, dtype=bool)
    offset = starts - np.repeat(starts[first_of_bin], [len(b) for b in bins]) if bins else starts
    bin_of, at = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    some = np.flatnonzero(lengths > 0)
    order = some[np.argsort(lengths[some], kind="stable")]
    places = np.argsort(sizes, kind="stable")
    bin_of[order], at[order] = of[places], offset[places]
    none = lengths == 0
    if none.any() and bins:
        at[none] = sum(bins[0])
    return bin_of, at


def pieces(docs: DataFrame, vocabulary: str, text: str = "text", capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """Adds piece, start, length and ids (binary, little-endian 32 bit): one row per piece of at most ``capacity`` ids.

    The document's ids end with ``closing``.
    """
    need(docs, text)
    closed = F.lit(closing.to_bytes(4, "little"))
    ids = encode_texts(docs, vocabulary, text, "__ids").withColumn("__ids", F.concat(F.col("__ids"), closed))
    total = (F.octet_length("__ids") / 4).cast("int")
    each = F.transform(F.sequence(F.lit(0), (F.ceil(total / capacity) - 1).cast("int")),
                       lambda i: F.struct(i.alias("piece"), (i * capacity).cast("long").alias("start"),
                                          F.least(F.lit(capacity), total - i * capacity).cast("long").alias("length")))
    rest = [c for c in docs.columns if c not in ("piece", "start", "length", "ids")]
    return (ids.select("*", F.explode(each).alias("__p"))
            .select(*rest, F.col("__p.piece").alias("piece"), F.col("__p.start").alias("start"), F.col("__p.length").alias("length"),
                    F.expr("substring(__ids, int(__p.start * 4 + 1), int(__p.length * 4))").alias("ids")))


def pack(table: DataFrame, key: list[str], length: str = "length", capacity: int = CAPACITY,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to each row of a written ``table``; ``key`` and the row's place in it deal out the rows.

    The place takes part because one key, or one whole row, may come up any number of times.
    """
    need(table, *key, length)
    table = table.drop("sequence_id", "offset")
    shards = max(1, -(-table.count() // shard_pieces))
    out = T.StructType([*table.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(shard: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="__shard")
        in_bin, at = best_two_fit(rows[length].fillna(0).to_numpy(), capacity)
        return rows.assign(sequence_id=(int(shard[0]) << 32) + in_bin, offset=at)

    return (table.withColumn("__shard", F.pmod(F.xxhash64(*key, F.monotonically_increasing_id()), F.lit(shards)))
            .groupBy("__shard").applyInPandas(run, out))


def pack_documents(docs: DataFrame, vocabulary: str, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Place of every piece: doc, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs.select(doc, text), vocabulary, text, capacity)
    small = written(cut.select(doc, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(small, [doc, "piece"], capacity=capacity)
