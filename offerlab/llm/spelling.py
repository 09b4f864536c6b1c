"""Spelling variants by a relational trie frontier.

The words of a corpus are the paths of a trie, held as a distributed table of
edges (node, letter, child); a node's number is a hash of its prefix. States
(word, position, node, edits) move through it level by level: a state without
edits sits on its word's own path and gives off one-edit states, by leaving
out its next letter or by following another letter's edge; a state with one
edit follows only its word's next letter, by a join on (node, letter).
States whose word is used up and whose node ends a word are neighbours.

Two words one edit apart share their first or their last half, so the
frontier runs twice, over the words and over the reversed words, and edits
start in the second half only, where nodes have few children. Of two
neighbours the longer one (of equally long ones the one with the greater
letter) finds the other. Each level is a written table; most states die at
the first, so later levels are small and their join side is broadcast where
Spark finds it small enough. Words of more than ``TRIE_CHARS`` letters would
need a level per letter; they meet by hashes of the word without one letter
(prefix polynomials, linear in the word). All pairs are checked on their
letters at the end, so hash collisions cannot add any.

A word's form is its neighbour of largest count where that is ``ratio`` times
its own; counts grow along forms, so chains are short and roots are found by
pointer doubling.

Defined results: null and empty texts have no words; a null doc_id counts as
the empty text in the spoiling hash; repeated rows count again; an empty table
gives an empty one; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerlab.llm.common import discard, need, text_or_empty, written

#: Words longer than this meet by hashes of all but one letter.
TRIE_CHARS = 24
#: Distinct words that a task holds before it passes them on.
HELD_WORDS = 200_000
ODD = 0xD6E8FEB86659FD93


def word_pattern(min_chars: int):
    """Runs of Latin letters in Latin-1 bytes, of at least ``min_chars``."""
    return re.compile(rb"[A-Za-z\xC0-\xFF]{%d,}" % min_chars)


def spoiled_words(doc_id, text: str, pattern, every: int | None):
    """(word, times) of one text as Latin-1 bytes; one run in ``every`` loses a letter, chosen by a hash."""
    runs = Counter(pattern.findall(text.encode("latin-1", "replace").lower()))  # others become "?"; only A-Z change
    if not every:
        yield from runs.items()
        return
    start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for run, times in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        yield run, times


def count_words(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 7, min_count: int = 2, every: int | None = None) -> DataFrame:
    """(word, n): words of at least ``min_chars`` letters that occur at least ``min_count`` times."""
    need(docs, doc, text)

    def task(batches):
        pattern, held = word_pattern(min_chars), Counter()

        def pack():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, body in zip(batch.column(0), batch.column(1)):
                for word, times in spoiled_words(doc_id.as_py(), body.as_py(), pattern, every):
                    held[word] += times
                if len(held) >= HELD_WORDS:
                    yield pack()
                    held.clear()
        if held:
            yield pack()

    rows = docs.select(F.col(doc).alias("doc"), text_or_empty(text).alias("text")).mapInArrow(task, "word string, n long")
    return (rows.groupBy("word").agg(F.sum("n").alias("n"))
            .where((F.col("n") >= min_count) & (F.char_length("word") >= min_chars)))


def _prefix(word, depth):
    return F.xxhash64(F.substring(word, F.lit(1), depth))


def _letter(word, at):
    """The letter at position ``at`` (from 0)."""
    return F.substring(word, at + 1, F.lit(1))


def frontier_pairs(words: DataFrame) -> DataFrame:
    """(a, b): words one edit apart in the second half of the longer one; ``words`` has word (and only short ones)."""
    size = F.char_length("word")
    own = (words.select("word", F.explode(F.sequence(F.floor((size - 1) / 2).cast("int"), size - 1)).alias("at"))
           .select("word", "at", _prefix("word", F.col("at")).alias("node"), _letter("word", F.col("at")).alias("letter")))
    edges = written(own.select("node", "letter", _prefix("word", F.col("at") + 1).alias("child")).distinct(), "edges")
    branching = edges.groupBy("node").agg(F.min("letter").alias("least"))
    # a greater letter than the node's least one has a smaller brother: only such states can be replaced
    replaced = (own.join(branching, "node").where("letter > least").drop("least")
                .join(edges.withColumnRenamed("letter", "other"), "node").where("other < letter")
                .select("word", (F.col("at") + 1).alias("position"), F.col("child").alias("node")))
    left_out = own.select("word", (F.col("at") + 1).alias("position"), "node")
    states = written(replaced.unionByName(left_out), "states")
    ended = F.col("position") >= F.char_length("word")
    ends = states.where(ended).select("word", "node")
    old = []
    while True:
        # one level: each state follows its word's next letter
        open_ = states.where(~ended).withColumn("letter", _letter("word", F.col("position")))
        after = written(open_.join(edges, ["node", "letter"]).select("word", (F.col("position") + 1).alias("position"), F.col("child").alias("node")), "states")
        old.append(states)
        if after.isEmpty():
            break
        states = after
        ends = ends.unionByName(states.where(ended).select("word", "node"))
    last = words.select(F.col("word").alias("b"), F.xxhash64("word").alias("node"))
    found = written(ends.withColumnRenamed("word", "a").join(last, "node").where("a != b").select("a", "b").distinct(), "pairs")
    discard(edges, after, *old)
    return found


def long_pairs(words: DataFrame) -> DataFrame:
    """(a, b): words equal but for one letter, found by hashes of the word without each of its letters and checked on the letters."""
    def task(batches):
        for batch in batches:
            for number, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
                n = len(data)
                power = np.cumprod(np.r_[np.uint64(1), np.full(n, ODD, dtype=np.uint64)])
                total = np.r_[np.uint64(0), np.cumsum(data * power[:n], dtype=np.uint64)]
                without = total[:-1] + (total[-1] - total[1:]) * np.uint64(pow(ODD, -1, 1 << 64))
                columns = [np.full(n + 1, number), np.arange(-1, n), np.r_[total[-1], without].view(np.int64), np.r_[n, np.full(n, n - 1)]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["number", "at", "key", "size"])

    numbered = words.select(F.xxhash64("word").alias("number"), "word")
    keys = numbered.mapInArrow(task, "number long, at long, key long, size long")
    gone, whole = keys.where("at >= 0").withColumnRenamed("number", "a"), keys.where("at < 0").drop("at")
    replaced = gone.join(gone.withColumnRenamed("a", "b"), ["at", "key", "size"]).where("a > b").select("a", "b", "at", F.lit(True).alias("both"))
    left_out = gone.join(whole.withColumnRenamed("number", "b"), ["key", "size"]).select("a", "b", "at", F.lit(False).alias("both"))
    met = (replaced.unionByName(left_out).join(numbered.toDF("a", "one"), "a").join(numbered.toDF("b", "two"), "b"))

    def rest(word):
        return F.concat(F.substring(word, F.lit(1), F.col("at")), F.substring(word, F.col("at") + 2, F.char_length(word)))

    same = rest("one") == F.when(F.col("both"), rest("two")).otherwise(F.col("two"))
    return met.where(same & (F.col("one") != F.col("two"))).select(F.col("one").alias("a"), F.col("two").alias("b")).distinct()


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): both directions of all pairs of words exactly one edit apart; ``words`` has distinct, non-empty word."""
    size = F.char_length("word")
    short = words.select("word").where(size <= TRIE_CHARS)
    ahead = frontier_pairs(short)
    behind = frontier_pairs(short.select(F.reverse("word").alias("word"))).select(F.reverse("a").alias("a"), F.reverse("b").alias("b"))
    long_ = long_pairs(words.select("word").where(size >= TRIE_CHARS))
    pairs = ahead.unionByName(behind).where(F.levenshtein("a", "b") == 1).unionByName(long_)
    return (pairs.select(F.col("a").alias("word"), F.col("b").alias("near"))
            .unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"))).distinct())


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) without cycles: the last form reached, by pointer doubling."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not new.where("moved").isEmpty()
        discard(now)
        now = new.drop("moved")
        if not moved:
            return now
        now._written = new._written


def spelling_variants(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 7, min_count: int = 2,
                      ratio: int = 10, every: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word."""
    words = written(count_words(docs, doc, text, min_chars, min_count, every), "words")
    of = words.select(F.col("word").alias("near"), F.col("n").alias("m"))
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("near")))
    near = near_words(words).join(of, "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    strong = -F.col("best.m") >= ratio * F.col("n")
    table = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n")), "variants")
    root = roots(table.where("form is not null"))
    return (table.join(root, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
