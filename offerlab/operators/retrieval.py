"""A2, H1-H7: knowledge scan, chunking, vectors and top-k retrieval."""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from offerlab.config import CHUNK_SEPARATORS, DEFAULT_PARAMS, Params
from offerlab.functions.text import ustrip
from offerlab.session import cut_lineage


def load_knowledge(spark: SparkSession, dir_path: str) -> DataFrame:
    """A2: .txt / .md files (any case) as whole texts, stripped, empty
    dropped, file name kept as source. Any path Spark can read; a missing
    folder gives no rows, files that cannot be read are skipped."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(dir_path)
    if not path.getFileSystem(hadoop).exists(path):
        return spark.createDataFrame([], "source string, text string")
    df = (spark.read.option("wholetext", True).option("recursiveFileLookup", False).option("ignoreCorruptFiles", True)
          .option("pathGlobFilter", "*.[tTmM][xXdD]*").text(dir_path))
    df = df.select(F.col("_metadata.file_name").alias("source"), ustrip(F.col("value")).alias("text"))
    keep = F.lower(F.col("source")).endswith(".txt") | F.lower(F.col("source")).endswith(".md")
    return df.where(keep & (F.length("text") > 0))


def chunk_bounds(sizes, chunk_size: int, chunk_overlap: int) -> list[int]:
    """H1: first and after, first and after, ... piece numbers of the chunks, from the pieces' sizes.

    Prefix sums of the sizes give each chunk by two binary searches: the
    last piece that fits, and the longest tail of at most ``chunk_overlap``
    that the next chunk repeats. The piece that did not fit opens the next
    chunk whatever its size.
    """
    upto = [0, *accumulate(sizes)]
    n, out, first, least = len(upto) - 1, [], 0, 1
    while n:
        after = max(bisect_right(upto, upto[first] + chunk_size) - 1, least)
        out += [first, min(after, n)]
        if after >= n:
            break
        first, least = max(first, bisect_left(upto, upto[after] - chunk_overlap)), after + 1
    return out


def chunk_corpus(docs: DataFrame, params: Params = DEFAULT_PARAMS, id_col: str = "doc_id",
                 text_col: str = "text", source_col: str = "source") -> DataFrame:
    """H1 + H2: one row per chunk (doc_id, source, chunk_no, text).

    A text is cut at the first of the separators that it holds; its pieces
    are stripped, blank ones dropped, and packed by ``chunk_bounds``; a piece
    longer than a chunk stays whole. Only the pieces' sizes go to Python."""
    text = F.col(text_col)
    separator = F.coalesce(*[F.when(F.contains(text, F.lit(x)), F.lit(x)) for x in CHUNK_SEPARATORS], F.lit(CHUNK_SEPARATORS[-1]))
    cut = docs.where(text.isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), text.alias("_t"), separator.alias("_sep"))
    pieces = F.filter(F.transform(F.split("_t", F.concat(F.lit(r"\Q"), F.col("_sep"), F.lit(r"\E")), F.lit(-1)), ustrip), lambda x: F.length(x) > 0)
    size, overlap = params.chunk_size, params.chunk_overlap

    @F.pandas_udf("array<int>")
    def bounds(sizes: pd.Series) -> pd.Series:
        return pd.Series([chunk_bounds(x.tolist(), size, overlap) for x in sizes], dtype=object)

    packed = cut.withColumn("_pieces", pieces).withColumn("_bounds", bounds(F.transform("_pieces", lambda x: F.length(x))))
    numbered = packed.where(F.size("_bounds") > 0).select("doc_id", "source", "_pieces", "_sep", "_bounds", F.explode(F.expr("sequence(0, size(_bounds) div 2 - 1)")).alias("_i"))
    return numbered.select("doc_id", "source", F.col("_i").cast("int").alias("chunk_no"), F.expr(
        "array_join(slice(_pieces, _bounds[2 * _i] + 1, _bounds[2 * _i + 1] - _bounds[2 * _i]), _sep)").alias("text"))


def l2_normalize(v: F.Column) -> F.Column:
    """H4: v / ||v||; a zero vector stays zero."""
    dv = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(dv, F.lit(0.0), lambda s, x: s + x * x))
    # bind the norm once per row (a one-element array), not once per element
    return F.aggregate(F.array(norm), dv, lambda _, n: F.when(n > 0, F.transform(dv, lambda x: x / n))
                       .otherwise(dv))


def attach_vectors(items: DataFrame, vectors: DataFrame, dim: int, key: str = "vec_id",
                   vec_col: str = "embedding") -> DataFrame:
    """H3: left join items to their vectors; missing -> zero vector."""
    zero = F.array_repeat(F.lit(0.0), dim)
    return items.join(vectors.select(key, vec_col), key, "left").withColumn(
        vec_col, F.coalesce(F.transform(vec_col, lambda x: x.cast("double")), zero))


def label_centroid_queries(vectors: DataFrame, dim: int, label: str = "label",
                           vec_col: str = "embedding", max_queries: int = 10_000) -> list[tuple]:
    """Query vectors derived from the corpus: the normalised mean vector of
    each label (one query per label, like one query per segment). The
    per-(label, dim) means are an aggregate of labels x dim rows; the count
    of labels is checked before it is pulled to the driver."""
    n_labels = vectors.select(label).distinct().count()
    if n_labels > max_queries:
        raise ValueError(f"{n_labels} query labels exceed the broadcast bound {max_queries}")
    long = vectors.select(label, F.posexplode(vec_col).alias("d", "v"))
    means = long.groupBy(label, "d").agg(F.avg(F.col("v").cast("double")).alias("m")).collect()
    by = {}
    for r in means:
        by.setdefault(r[label], [0.0] * dim)[r["d"]] = r["m"]
    out = []
    for lab in sorted(by):
        v = by[lab]
        nrm = math.sqrt(sum(x * x for x in v))
        out.append((lab, [x / nrm for x in v] if nrm > 0 else v))
    return out


def best_of(ids: np.ndarray, scores: np.ndarray, qids: np.ndarray, k: int, key: str) -> pd.DataFrame:
    """The k best rows per query of a (rows x queries) score matrix whose rows are in id order; one sort for all queries."""
    top = np.argsort(-scores, axis=0, kind="stable")[:k]
    return pd.DataFrame({key: ids[top.T.ravel()], "query_id": np.repeat(qids, top.shape[0]), "score": np.take_along_axis(scores, top, 0).T.ravel()})


def exact_topk(vectors: DataFrame, queries: list[tuple], k: int, key: str = "vec_id",
               vec_col: str = "embedding") -> DataFrame:
    """H4 + H5: inner-product top-k per query over L2-normalised vectors.

    The query matrix (a bounded list, checked by the caller) is shipped with
    the task closure. Each Arrow batch of vectors is scored against all
    queries with one numpy matrix product and only its k best rows per
    query (score desc, id asc) leave the task; a window then ranks the
    partial winners. The shuffle carries at most k rows per query per
    batch, never all pairs."""
    qids = np.array([q for q, _ in queries], dtype=np.int64)
    qmat = np.array([v for _, v in queries], dtype=np.float64)

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            pdf = pdf.sort_values(key, kind="stable")  # ties go to the smaller id
            m = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
            nrm = np.sqrt((m * m).sum(axis=1))
            m = np.where(nrm[:, None] > 0, m / np.where(nrm > 0, nrm, 1.0)[:, None], m)
            yield best_of(pdf[key].to_numpy(), m @ qmat.T, qids, k, key)

    part = vectors.select(key, vec_col).mapInPandas(run, f"{key} long, query_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieve(vectors: DataFrame, queries: list[tuple], top_k: int = 3, key: str = "vec_id") -> DataFrame:
    """H7: search 2k, drop duplicate ids, keep the first top_k with scores."""
    cand = exact_topk(vectors, queries, 2 * top_k, key)
    dedup = cand.dropDuplicates(["query_id", key])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return dedup.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def build_buckets(vectors: DataFrame, path: str, params: Params = DEFAULT_PARAMS, key: str = "vec_id",
                  vec_col: str = "embedding", seed: int = 42) -> None:
    """A10, H6: the stored index. ``nlist`` k-means centroids (fewer for fewer
    vectors); every vector, normalised, goes to its centroid's bucket, a
    partition folder of the table; centroids, bucket sizes and radii are stored too."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    vectors.select(key, l2_normalize(F.col(vec_col)).alias("v")).write.parquet(f"{path}/vectors")
    vec = spark.read.parquet(f"{path}/vectors").withColumn("features", array_to_vector("v"))
    model = KMeans(k=max(2, params.nlist), seed=seed, featuresCol="features", predictionCol="bucket").fit(vec)
    centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "bucket int, centre array<double>")
    centres.coalesce(1).write.parquet(f"{path}/centres")
    append_buckets(spark.read.parquet(f"{path}/vectors"), path, key)


def append_buckets(vectors: DataFrame, path: str, key: str = "vec_id", vec_col: str = "v") -> None:
    """A10: more vectors for a stored index. Each goes, normalised, to the nearest stored centroid's
    bucket; its count and its radius (greatest distance from the centroid) are added for the buckets it fills."""
    spark = vectors.sparkSession
    found = sorted((r["bucket"], r["centre"]) for r in spark.read.parquet(f"{path}/centres").collect())  # nlist rows
    buckets, matrix = np.array([b for b, _ in found], dtype=np.int32), np.array([c for _, c in found])

    def run(batches):
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf["v"].to_numpy())
                near = np.argmin((matrix * matrix).sum(axis=1)[None, :] - 2 * (m @ matrix.T), axis=1)
                yield pd.DataFrame({key: pdf[key], "v": pdf["v"], "far": np.sqrt(((m - matrix[near]) ** 2).sum(axis=1)), "bucket": buckets[near]})

    part = uuid.uuid4().hex
    placed = vectors.select(key, l2_normalize(F.col(vec_col)).alias("v")).mapInPandas(run, f"{key} long, v array<double>, far double, bucket int")
    placed.withColumn("part", F.lit(part)).write.mode("append").partitionBy("bucket", "part").parquet(f"{path}/buckets")
    new = spark.read.parquet(f"{path}/buckets").where(F.col("part") == part)
    new.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).coalesce(1).write.mode("append").parquet(f"{path}/sizes")


def stored_centres(spark: SparkSession, path: str) -> list[tuple]:
    """(bucket, centre, vectors, radius) of the buckets that hold any, in bucket order: at most nlist rows."""
    sizes = spark.read.parquet(f"{path}/sizes").groupBy("bucket").agg(F.sum("n").alias("n"), F.max("far").alias("far"))
    rows = spark.read.parquet(f"{path}/centres").join(sizes, "bucket").collect()
    return sorted((r["bucket"], r["centre"], r["n"], r["far"]) for r in rows)


def certified_topk(spark: SparkSession, path: str, queries: list[tuple], k: int, params: Params = DEFAULT_PARAMS, key: str = "vec_id") -> tuple[DataFrame, float]:
    """H6 with a certificate: exactly the top k of all stored vectors, and the share of (query, bucket) pairs read.

    No vector of a bucket scores more than q.centre + |q| * radius. The first
    read takes each query's ``nprobe`` buckets of the highest bounds (more
    while they hold fewer than k vectors); its k-th score rules out all
    unread buckets with lower bounds, and a second read takes the others.
    """
    centres = stored_centres(spark, path)
    names, matrix = np.array([c[0] for c in centres]), np.array([c[1] for c in centres])
    sizes, radius = np.array([c[2] for c in centres]), np.array([c[3] for c in centres])
    qids, qmat = np.array([q for q, _ in queries], dtype=np.int64), np.array([v for _, v in queries], dtype=np.float64)
    bound = qmat @ matrix.T + np.sqrt((qmat * qmat).sum(axis=1))[:, None] * radius[None, :] + 1e-9
    order = np.argsort(-bound, axis=1, kind="stable")
    first = np.zeros(bound.shape, dtype=bool)
    for i in range(len(qids)):
        enough = int(np.searchsorted(np.cumsum(sizes[order[i]]), k)) + 1
        first[i, order[i, :max(params.nprobe, enough)]] = True
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))

    def read(wanted: np.ndarray) -> DataFrame:
        asked = {int(names[j]): np.flatnonzero(wanted[:, j]) for j in np.flatnonzero(wanted.any(axis=0))}
        rows = spark.read.parquet(f"{path}/buckets").where(F.col("bucket").isin(list(asked)))

        def run(batches):
            for pdf in batches:
                for bucket, part in pdf.groupby("bucket"):
                    part, at = part.sort_values(key, kind="stable"), asked[int(bucket)]
                    yield best_of(part[key].to_numpy(), np.stack(part["v"].to_numpy()) @ qmat[at].T, qids[at], k, key)

        found = rows.mapInPandas(run, f"{key} long, query_id long, score double")
        return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)

    best = cut_lineage(read(first))
    kth = {r["query_id"]: r["s"] for r in best.groupBy("query_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).collect()}
    least = np.array([kth.get(int(q), -np.inf) for q in qids])
    second = ~first & (bound >= least[:, None])
    if second.any():
        both = best.drop("rank").unionByName(read(second).drop("rank"))
        best = both.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    return best, float((first | second).mean())


def bucketed_topk(spark: SparkSession, path: str, queries: list[tuple], k: int, params: Params = DEFAULT_PARAMS,
                  key: str = "vec_id") -> DataFrame:
    """H6: approximate top-k from a stored index. Each query probes its
    ``nprobe`` best buckets, and further ones while those hold fewer than k
    vectors; only probed buckets are read, then H5 ranking."""
    centres = stored_centres(spark, path)
    matrix, sizes = np.array([c[1] for c in centres]), np.array([c[2] for c in centres])
    wanted: dict[int, list] = {}
    for qid, qv in queries:
        order = np.argsort(-(matrix @ np.array(qv)), kind="stable")
        enough = int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1
        for i in order[: max(params.nprobe, enough)]:
            wanted.setdefault(centres[i][0], []).append((qid, qv))
    rows = spark.read.parquet(f"{path}/buckets").where(F.col("bucket").isin(list(wanted)))

    def run(batches):
        for pdf in batches:
            for bucket, part in pdf.groupby("bucket"):
                m, ids = np.stack(part["v"].to_numpy()), part[key].to_numpy()
                for qid, qv in wanted[bucket]:
                    scores = m @ np.array(qv)
                    order = np.lexsort((ids, -scores))[:k]
                    yield pd.DataFrame({key: ids[order], "query_id": qid, "score": scores[order]})

    part = rows.mapInPandas(run, f"{key} long, query_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
