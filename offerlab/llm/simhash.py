"""SimHash near-duplicates with pivot distance tables.

A fingerprint has bit k set if over half of the text's shingle hashes have
it. Documents meet by fingerprint first, so only distinct fingerprints are
compared. The 64 bits are cut into six blocks; fingerprints at most four
bits apart agree in at least two blocks, so the fifteen pairs of blocks are
keys under which every link is met (no link is lost). Each fingerprint
carries its Hamming distances to ``PIVOTS`` reference fingerprints; by the
triangle inequality a pair whose distances to any reference differ by more
than the limit is discarded, and the survivors are verified bit by bit.
Dense groups are walked by spanning links, never all pairs.

Defined results: null and empty texts have fingerprint zero and link like
any other; a row with a null doc_id gets its group's component; a group with
no doc_id at all has a null component; repeated rows get a row each.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from offerlab.llm.blocks import bounds, grouped, small_pairs, spanning_links
from offerlab.llm.common import need, shuffle_width, text_or_empty, written
from offerlab.llm.graph import connected_components

BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # first bit, bits
PIVOTS = 16
SMALL_GROUP = 64


def pivot_fingerprints(n: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i), seed=7) for i in range(n)], dtype=np.uint64)


def fingerprint(text: str, shingle: int) -> int:
    """Signed 64-bit fingerprint; words are cut at ASCII white space, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space cuts
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends + 1).tolist()]
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1:].tolist())]
    h = np.array(hashes, dtype="<u8")
    bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[i:i + (1 << 16)])
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 4, out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as a long."""
    need(df, text)

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, shingle) for x in texts], dtype="int64")

    return df.withColumn(out, run(text_or_empty(text)))


def near_links(distinct: DataFrame, column: str, bits: int, partitions: int) -> DataFrame:
    """(a, b): links that span the groups of distinct fingerprints at most ``bits`` apart."""
    if bits > len(BLOCKS) - 2:
        raise ValueError(f"at most {len(BLOCKS) - 2} bits")
    pairs = list(combinations(BLOCKS, 2))

    def keyed(batches):
        pivots = pivot_fingerprints()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            table = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.uint8)
            table = [x.tobytes() for x in table]
            for k, ((s1, n1), (s2, n2)) in enumerate(pairs):
                one = (fp >> np.uint64(s1)) & np.uint64((1 << n1) - 1)
                two = (fp >> np.uint64(s2)) & np.uint64((1 << n2) - 1)
                key = (np.uint64(k) << np.uint64(40)) | (one << np.uint64(n2)) | two
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), batch.column(0), pa.array(table, pa.binary())], ["key", "fp", "pivots"])

    def link(table: pa.Table):
        key, fp = (table.column(i).to_numpy() for i in (0, 1))
        starts, sizes = bounds(key)
        if not (sizes > 1).any():
            return
        fp = fp.view(np.uint64)
        at = np.frombuffer(b"".join(table.column(2).to_pylist()), dtype=np.uint8).reshape(len(fp), -1).astype(np.int16)
        small = sizes <= SMALL_GROUP
        i, j = small_pairs(starts[small], sizes[small])
        close = np.abs(at[i] - at[j]).max(axis=1, initial=0) <= bits
        i, j = i[close], j[close]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= bits
        a, b = [fp[i[near]]], [fp[j[near]]]
        for s, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
            f, t = fp[s:s + n], at[s:s + n]

            def near_to(x, rest):
                ok = np.ones(len(rest), dtype=bool)
                for c in range(t.shape[1]):
                    live = np.flatnonzero(ok)
                    if len(live) < 64:
                        break
                    ok[live] = np.abs(t[rest[live], c] - t[x, c]) <= bits
                live = np.flatnonzero(ok)
                ok[live] = np.bitwise_count(f[rest[live]] ^ f[x]) <= bits
                return ok

            x, y = spanning_links(n, near_to)
            a.append(f[np.array(x, dtype=np.int64)])
            b.append(f[np.array(y, dtype=np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    keys = distinct.select(column).mapInArrow(keyed, "key long, fp long, pivots binary")
    return grouped(keys, "key", link, "a long, b long", partitions)


def with_components(distinct: DataFrame, bits: int) -> DataFrame:
    """Adds _component, the smallest fingerprint of its group, to rows of distinct fingerprints _fp."""
    found = connected_components(near_links(distinct, "_fp", bits, shuffle_width(distinct.sparkSession)))
    return (distinct.join(found.withColumnRenamed("node", "_fp"), "_fp", "left")
            .withColumn("_component", F.coalesce("component", "_fp")).drop("component"))


def first_of_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """One row of ``docs`` for each group: the one with the smallest (id, hash of the text), null ids last.

    Rows that agree in both have one text, so they are of one group, where any of them stays.
    """
    need(docs, doc, text)
    content = text_or_empty(text)
    row = F.struct(F.col(doc).isNull().alias("_no_id"), F.col(doc).alias("_id"), F.xxhash64(content).alias("_h1"), F.xxhash64(F.lit(1), content).alias("_h2"))
    prints = fingerprints(docs.select(row.alias("_row"), F.col(text).alias("text")), "text", shingle, "_fp")
    distinct = written(prints.groupBy("_fp").agg(F.min("_row").alias("_row")), "distinct")
    least = with_components(distinct, bits).groupBy("_component").agg(F.min("_row").alias("_row"))
    stay = written(least.select(*[F.col(f"_row.{c}").alias(f"{c}_stay") for c in ("_id", "_h1", "_h2")]), "stay")
    rows = docs.select(row.alias("_row"), F.struct(*docs.columns).alias("_document")).select("_row.*", "_document")
    met = F.col("_id").eqNullSafe(F.col("_id_stay")) & (F.col("_h1") == F.col("_h1_stay")) & (F.col("_h2") == F.col("_h2_stay"))
    return rows.join(stay, met, "left_semi").dropDuplicates(["_id", "_h1", "_h2"]).select("_document.*")


def simhash_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """(doc, fingerprint long, component_id): one row per row of ``docs``."""
    need(docs, doc, text)
    prints = written(fingerprints(docs.select(doc, text), text, shingle, "_fp").select(F.col(doc).alias("_doc"), "_fp"), "fingerprints")
    distinct = written(prints.groupBy("_fp").agg(F.min("_doc").alias("_least")), "distinct")
    of = with_components(distinct, bits)
    least = of.groupBy("_component").agg(F.min("_least").alias("component_id"))
    labels = written(of.join(least, "_component").select("_fp", "component_id"), "labels")
    return prints.join(labels, "_fp").select(F.col("_doc").alias(doc), F.col("_fp").alias("fingerprint"), "component_id")
