"""Language-model scores by stupid backoff over word pairs, computed relationally.

Words are the runs between ASCII white space, A-Z lower-cased, known by their
64-bit hashes. Every word has its own count; only where ``vocabulary`` is
given, the words below the smallest count that leaves at most that many share
one entry, whose count is theirs summed. With c(w), c(v, w) and N counted over
all documents, a word w after v in a document scores

    log(c' / c(v))        if c' = c(v, w) minus the document's own pairs > 0
    log(backoff * c(w) / N)  otherwise

and a document's first word log(c(w) / N): a pair counts where another
document has it too. Rows with the same id add up (each leaves out its own).

Passes: (1) word counts, combined per task, summed by word; the ``NUMBERED``
most frequent words get numbers of 16 bits, which are broadcast. (2) Pairs of
the ``frequent`` most frequent words, a square table of bounded size, are
counted densely; any pair outside it holds less than one part in ``frequent``
of all words, so no key is hot. (3) All other (pair, document) entries of
numbered words are exploded once per document, dealt by a hash of the pair to
buckets, and travel as packed arrays; a bucket builds the count table of its
pairs, joins it to its entries and sums per document before the last shuffle.
(4) Entries with any other word travel once, as rows dealt by that word: its
entries give its count and the pairs' sums in one place, and a numbered word
has its count from the start. A pair of two such words goes to both. Such a
word holds less than one part in ``NUMBERED`` of all words.

Defined results: null and empty texts have no words, score 0 and a null mean;
rows with a null id are one document; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from offerlab.functions.stats import order_statistics
from offerlab.llm.blocks import grouped
from offerlab.llm.common import bounded_ranges, need, shuffle_width, written

#: Bytes of text that are worked on at once.
STEP = 1_000_000
#: Words with a number of 16 bits; the others go by their hashes.
NUMBERED = 65_535
NULL_ID = -(1 << 63)
ODD = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of the words in a run of texts: polynomial over the bytes modulo 2^64, mixed."""

    def __init__(self):
        self.letter = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))
        self.letter[65:91] = self.letter[97:123]
        self.space = np.zeros(256, dtype=bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            back = pow(ODD, -1, 1 << 64)
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(n, ODD, dtype=np.uint64)])
            self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, back, dtype=np.uint64)])

    def of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text number) of each word; ``ends`` are the texts' ends in ``data``."""
        self._powers(len(data))
        blank = self.space[data]
        begin = ~blank
        begin[1:] &= blank[:-1]
        cuts = ends[(ends > 0) & (ends < len(data))]
        begin[cuts] = ~blank[cuts]  # a text's start also begins a word
        last = ~blank
        last[:-1] &= blank[1:]
        last[cuts - 1] = ~blank[cuts - 1]
        start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.letter[data] * self.power[:len(data)], dtype=np.uint64)])
        h = (total[end] - total[start]) * self.inverse[start]
        return _mixed(h ^ ((end - start).astype(np.uint64) << np.uint64(1))), np.searchsorted(ends, start, side="right")


def _runs(batch: pa.RecordBatch, words: Words):
    """(ids, number of texts, word hashes, text numbers) for bounded runs of a batch (id, text)."""
    ids = batch.column(0).fill_null(NULL_ID).to_numpy()
    texts = batch.column(1).fill_null("").cast(pa.large_binary())  # read where they lie: a batch may be a whole partition
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    every = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    for i, j in bounded_ranges(np.diff(at).tolist(), STEP):
        data, ends = every[at[i]:at[j]], at[i + 1:j + 1] - at[i]
        h, of = words.of(data, ends) if len(data) else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        yield ids[i:j], h, of


def _added(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by number, as floats also where there are none (numpy gives integers then)."""
    return np.bincount(of, weights=values, minlength=n).astype(np.float64, copy=False)


class Sums:
    """Counts by key, combined in a task and given out when many."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.keys, self.counts, self.held = most, [], [], 0

    def add(self, keys: np.ndarray):
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(n)
        self.held += len(k)
        if self.held > 2 * self.most:
            yield from self.out(self.most)

    def out(self, keep: int = 0):
        if not self.held:
            return
        k, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(self.counts)).astype(np.int64)
        if len(k) <= keep:
            self.keys, self.counts, self.held = [k], [n], len(k)
            return
        self.keys, self.counts, self.held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.uint64).view(np.int64)), pa.array(n)], ["key", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, n): count of every word, by its hash; ``docs`` has (id, text)."""
    def count(batches):
        words, sums = Words(), Sums()
        for batch in batches:
            for _, h, _ in _runs(batch, words):
                yield from sums.add(h)
        yield from sums.out()

    return docs.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def choose_vocabulary(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int, DataFrame | None]:
    """(hashes, counts, all words, counts of the others): words of at least the smallest count that leaves at most ``most`` of them."""
    counts = written(counts, "word-counts")
    size, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    others = None
    if size > most:
        # the count of the first word that does not fit; words of that count stay out together
        bound = order_statistics(counts, {"n": [size - most - 1]})[("n", size - most - 1)]
        others, counts = counts.where(F.col("n") <= bound), counts.where(F.col("n") > bound)
    top = counts.orderBy("key").toPandas()  # at most most rows
    return top["key"].to_numpy(dtype=np.int64).view(np.uint64), top["n"].to_numpy(dtype=np.int64), int(total or 0), others


class Model:
    """What is broadcast: numbered words (0 is any other, with the others' sum if ``pooled``), word counts, counts of the frequent pairs."""

    def __init__(self, hashes, counts, total, frequent, pooled, bits=16):
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], (order + 1).astype(np.int64)
        self.count = np.r_[total - counts.sum() if pooled else 0, counts]
        self.total, self.bits, self.pooled = total, bits, pooled
        self.rank = np.full(len(self.count), -1)
        most = np.argsort(-self.count, kind="stable")[:frequent]
        if not pooled:
            most = most[most > 0]
        self.rank[most] = np.arange(len(most))
        self.frequent = len(most)
        self.pairs = None

    def ids(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.number[at], 0)

    def dense(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Place in the square table of frequent pairs, or -1."""
        a, b = self.rank[v], self.rank[w]
        return np.where((a >= 0) & (b >= 0), a * self.frequent + b, -1)

    def score(self, v, w, others, backoff):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(others > 0, np.log(others / self.count[v]), np.log(backoff * self.count[w] / self.total))


def _once(doc: np.ndarray, key: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, key, times) of each pair that comes up; sorted by doc, then key."""
    both, n = np.unique(doc.astype(np.int64) * keys + key, return_counts=True)
    return both // keys, both % keys, n


def rare_entries(docs: DataFrame, shared) -> DataFrame:
    """(id, word, other, times, n): pairs with a word that has no number, once per document, under that word.

    ``times`` is negative where ``word`` is the pair's first word. ``other``, the pair's other word, is given by
    number where it has one, else by hash; it is null where ``word`` begins the document. ``n`` is the count of a
    numbered ``other``, else 0. A pair of two words without a number comes under either.
    """
    def explode(batches):
        words, m = Words(), shared.value
        for batch in batches:
            for ids_of, h, of in _runs(batch, words):
                if not len(of):
                    continue
                ids = m.ids(h)
                first = np.r_[True, of[1:] != of[:-1]]
                before = np.r_[0, np.arange(len(of) - 1)]
                at = np.flatnonzero((ids == 0) | (~first & (ids[before] == 0)))
                if not len(at):
                    continue
                named = np.where(ids > 0, ids, h.view(np.int64))
                d, w, lead = of[at], named[at], first[at]
                v = np.where(lead, 0, named[before[at]])
                order = np.lexsort((w, v, lead, d))
                d, v, w, lead, at = d[order], v[order], w[order], lead[order], at[order]
                new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (lead[1:] != lead[:-1])])
                times, at, lead, d, v, w = np.diff(np.r_[new, len(d)]), at[new], lead[new], ids_of[d[new]], v[new], w[new]
                a, b = np.where(lead, -1, ids[before[at]]), ids[at]
                under_w, under_v = np.flatnonzero(b == 0), np.flatnonzero(a == 0)
                either = [np.r_[x[under_w], y[under_v]] for x, y in ((w, v), (v, w), (m.count[np.maximum(a, 0)] * (a > 0), m.count[b] * (b > 0)), (times, -times))]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.r_[d[under_w], d[under_v]]), pa.array(either[0]), pa.array(either[1], mask=np.r_[lead[under_w], np.zeros(len(under_v), dtype=bool)]),
                    pa.array(either[3].astype(np.int64)), pa.array(either[2].astype(np.int64))], ["id", "word", "other", "times", "n"])

    return docs.mapInArrow(explode, "id long, word long, other long, times long, n long")


def rare_scores(entries: DataFrame, total: int, backoff: float, width: int) -> DataFrame:
    """(id, logprob) of ``entries``, which are dealt by word once: a word's count is that of its entries as a pair's second or a document's first word."""
    after = F.col("times") > 0  # ``word`` comes second, or begins the document
    pair = Window.partitionBy("word", "other", after)
    rows = entries.repartition(width, "word").sortWithinPartitions("word", "other", after)  # one order for both windows
    rows = (rows.withColumn("others", F.sum("times").over(pair) - F.col("times"))
            .withColumn("c", F.sum(F.when(after, F.col("times")).otherwise(0)).over(Window.partitionBy("word"))))
    seen = F.abs("others") > 0
    # seen: log(others / count of the first word), else by the count of the second; of two words without a number either gives its part
    score = (F.when(F.col("other").isNull(), F.log(F.col("c") / total))
             .when(after & seen, F.when(F.col("n") > 0, F.log(F.col("others") / F.col("n"))).otherwise(0.0))
             .when(after, F.log(backoff * F.col("c") / total))
             .when(seen, F.log(-F.col("others") / F.col("c")))
             .when(F.col("n") > 0, F.log(backoff * F.col("n") / total)).otherwise(0.0))
    return rows.groupBy("id").agg(F.sum(F.abs("times") * score).alias("logprob"))


ENTRY = "bucket int, docs binary, entries binary, keys binary, times binary, scored binary, words binary, sums binary"


def lm_scores(docs: DataFrame, doc: str = "doc_id", text: str = "text", vocabulary: int | None = None, frequent: int = 256, backoff: float = 0.4) -> DataFrame:
    """(doc, n_words, logprob): one row per document id."""
    need(docs, doc, text)
    if vocabulary is not None and vocabulary > NUMBERED:
        raise ValueError("a shared entry needs a vocabulary below 65,536 words; without a vocabulary each word has its own")
    spark = docs.sparkSession
    docs = docs.select(F.col(doc).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    partitions = shuffle_width(spark)
    pooled = vocabulary is not None
    hashes, counts, total, unnumbered = choose_vocabulary(word_counts(docs), vocabulary if pooled else NUMBERED)
    model = Model(hashes, counts, total, frequent, pooled)
    half = spark.sparkContext.broadcast(model)

    def count_frequent(batches):
        words, m = Words(), half.value
        table = np.zeros(m.frequent ** 2, dtype=np.int64)
        for batch in batches:
            for _, h, of in _runs(batch, words):
                ids = m.ids(h)
                at = m.dense(ids[:-1], ids[1:])[of[1:] == of[:-1]] if len(ids) else ids
                table += np.bincount(at[at >= 0], minlength=len(table))
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(table[some])], ["key", "n"])

    table = np.zeros(model.frequent ** 2, dtype=np.int64)  # at most frequent ^ 2 rows come to the driver
    for r in docs.mapInArrow(count_frequent, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        table[r["key"]] = r["n"]
    model.pairs = table
    shared = spark.sparkContext.broadcast(model)

    def explode(batches):
        words, m = Words(), shared.value
        for batch in batches:
            for ids_of, h, of in _runs(batch, words):
                ids = m.ids(h)
                n = len(ids_of)
                first = np.r_[True, of[1:] != of[:-1]] if len(of) else np.zeros(0, dtype=bool)
                own_entry = ids > 0 if not m.pooled else np.ones(len(ids), dtype=bool)  # the rest is for rare_entries
                begin = first & own_entry
                score = _added(of[begin], np.log(m.count[ids[begin]] / m.total), n)
                follow = np.flatnonzero(~first & own_entry)
                follow = follow[own_entry[follow - 1]]
                d, key, times = _once(of[follow], ids[follow - 1] << m.bits | ids[follow], 1 << 2 * m.bits)
                v, w = key >> m.bits, key & ((1 << m.bits) - 1)
                at = m.dense(v, w)
                here = at >= 0
                score += _added(d[here], times[here] * m.score(v[here], w[here], m.pairs[at[here]] - times[here], backoff), n)
                length = np.bincount(of, minlength=n).astype(np.int64)
                d, key, times = d[~here], key[~here], times[~here]
                bucket = (_mixed(key.astype(np.uint64)) % np.uint64(partitions)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")  # within a bucket still by document
                cuts = np.searchsorted(bucket[order], np.arange(partitions + 1))
                own = int(np.uint64(abs(int(ids_of[0]))) % np.uint64(partitions)) if n else 0
                rows = []
                for b in range(partitions):
                    part = order[cuts[b]:cuts[b + 1]]
                    if not len(part) and b != own:
                        continue
                    who, many = np.unique(d[part], return_counts=True)
                    mine = [ids_of.tobytes(), length.tobytes(), score.tobytes()] if b == own else [b"", b"", b""]
                    rows.append((b, ids_of[who].tobytes(), many.astype("<u4").tobytes(), key[part].astype("<u4").tobytes(), times[part].astype("<u4").tobytes(), *mine))
                kinds = [pa.int32(), *[pa.binary()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in ENTRY.split(", ")])

    def join(table: pa.Table):
        m = shared.value
        ends = table.column(0).to_numpy()
        for b in np.unique(ends):
            rows = table.filter(pa.array(ends == b))
            get = lambda i, kind: np.frombuffer(b"".join(rows.column(i).to_pylist()), dtype=kind)
            ids, many, key, times = get(1, "<i8"), get(2, "<u4"), get(3, "<u4"), get(4, "<u4")
            # the count table of this bucket's pairs, joined to its entries
            pairs, at = np.unique(key, return_inverse=True)
            c = np.bincount(at, weights=times).astype(np.int64)
            v, w = (key >> np.uint32(m.bits)).astype(np.int64), (key & np.uint32((1 << m.bits) - 1)).astype(np.int64)
            value = times * m.score(v, w, c[at] - times, backoff)
            who, of = np.unique(np.repeat(ids, many), return_inverse=True)
            yield from dealt(np.r_[who, get(5, "<i8")], np.r_[np.zeros(len(who), dtype=np.int64), get(6, "<i8")],
                             np.r_[_added(of, value, len(who)), get(7, "<f8")])

    def dealt(ids, n, s):
        """Sums of a bucket, packed by hash of the document for the last shuffle."""
        group = (_mixed(ids.view(np.uint64) + np.uint64(ODD)) % np.uint64(partitions)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(partitions + 1))
        some = [(g, order[a:b]) for g, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in some], pa.int32()), *[
            pa.array([x[at].tobytes() for _, at in some], pa.binary()) for x in (ids, n, s)]], ["part", "ids", "n", "s"])

    def total_up(table: pa.Table):
        parts = table.column(0).to_numpy()
        for g in np.unique(parts):
            rows = table.filter(pa.array(parts == g))
            ids, n, s = (np.frombuffer(b"".join(rows.column(i).to_pylist()), dtype=kind) for i, kind in ((1, "<i8"), (2, "<i8"), (3, "<f8")))
            who, of = np.unique(ids, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.bincount(of, weights=n, minlength=len(who)).astype(np.int64)),
                                              pa.array(_added(of, s, len(who)))], ["id", "n_words", "logprob"])

    sums = grouped(docs.mapInArrow(explode, ENTRY), "bucket", join, "part int, ids binary, n binary, s binary", partitions)
    scores = grouped(sums, "part", total_up, "id long, n_words long, logprob double", partitions)
    if not pooled and unnumbered is not None:
        rare = rare_scores(rare_entries(docs, shared), total, backoff, partitions).select("id", F.lit(0).cast("long").alias("n_words"), "logprob")
        scores = scores.unionByName(rare).groupBy("id").agg(F.sum("n_words").alias("n_words"), F.sum("logprob").alias("logprob"))
    return scores.select(
        F.when(F.col("id") != F.lit(NULL_ID), F.col("id")).alias(doc), "n_words", "logprob")


#: The same scores in SQL; {vocabulary} and {backoff} as above.
ORACLE = r"""
WITH words AS (
  SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents)),
counts AS (SELECT word, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, word) AS r FROM words GROUP BY word),
bound AS (SELECT coalesce(max(n) FILTER (WHERE r = {vocabulary} + 1), 0) AS n FROM counts),
known AS (SELECT c.word, c.n FROM counts c, bound b WHERE c.n > b.n),
total AS (SELECT count(*) AS n FROM words),
mapped AS (SELECT doc_id, pos, coalesce(k.word, '') AS word FROM words LEFT JOIN known k USING (word)),
single AS (SELECT word, count(*) AS n FROM mapped GROUP BY word),
pairs AS (SELECT a.doc_id, a.word AS v, b.word AS w, count(*) AS t FROM mapped a JOIN mapped b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 GROUP BY ALL),
shared AS (SELECT v, w, sum(t) AS c FROM pairs GROUP BY v, w),
scored AS (
  SELECT p.doc_id, sum(p.t * CASE WHEN c > t THEN ln((c - t) / s.n) ELSE ln({backoff} * e.n / total.n) END) AS s
  FROM pairs p JOIN shared USING (v, w) JOIN single s ON s.word = p.v JOIN single e ON e.word = p.w, total GROUP BY p.doc_id
  UNION ALL
  SELECT m.doc_id, ln(e.n / total.n) FROM mapped m JOIN single e ON e.word = m.word, total WHERE m.pos = 1),
lengths AS (SELECT d.doc_id, count(w.pos) AS n_words FROM documents d LEFT JOIN words w ON w.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT l.doc_id, l.n_words, round(coalesce(sum(s.s), 0) * 100) / 100 + 0.0 AS logprob,
       round(sum(s.s) / l.n_words * 10000) / 10000 + 0.0 AS mean_logprob
FROM lengths l LEFT JOIN scored s ON s.doc_id = l.doc_id GROUP BY l.doc_id, l.n_words
"""
