"""Frequent phrases and their collocation scores, mined by Rabin-Karp fingerprints.

Prefix polynomials over the bytes of a run of text give every word's hash by
two look-ups, and prefix polynomials over those every n-gram's fingerprint.

Counting goes by length: an n-gram can only be frequent where both its parts
of one word less are, so a pass sends (fingerprint, count) only for n-grams
whose parts are set in a bitmap of fixed size (slots that collide only send
more, so nothing is lost). Tasks count before the shuffle.

A last pass sends, for fingerprints that turned out frequent, their counts
with a pointer to an occurrence (hash of the text, place of the word). Within
a task each occurrence is compared byte by byte with the one pointed to;
between tasks a second, independent hash of the phrase must agree. A
fingerprint that fails either is counted again by text. Then only frequent
phrases are read out of the texts, at their pointers.

Scores, cuts and the dropping of contained phrases are joins on the small
table of frequent phrases, in exact decimals.

Defined results: null texts have no words; a null language is ``und``;
repeated rows count again; an empty table gives an empty one; further columns
are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from offerlab.llm.common import bitmap_of, in_bitmap, need, text_or_empty, written

LONGEST = 5
#: Bytes of text that are worked on at once.
STEP = 300_000
#: Fingerprints that a task counts together.
HELD = 1_000_000
#: Frequent phrases that a task of the last pass counts together.
HELD_POINTS = 300_000
#: Rows of a batch that a task of the last pass gives out.
BATCH = 50_000
FILTER_BITS = 25
ODD = 0xD6E8FEB86659FD93
# fixed values: what ends a piece and what ends a word
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
KIND = np.zeros(256, dtype=np.uint8)
KIND[list(BLANKS)], KIND[list(PIECE_ENDS)] = 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
AHEAD = re.compile(rb"(?:[ \t]*[^ \t]+){0,%d}" % LONGEST)
#: Signed 64-bit columns of a pass that only counts, and of the last one.
COUNTED = "fp long, n long"
POINTED = "words int, lang string, fp long, n long, proof long, clash boolean, text_key long, at long"
BY_TEXT = "words int, lang string, fp long, phrase string, n long"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(ODD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
OTHER_BYTES = mixed(mixed(np.arange(1001, 1257, dtype=np.uint64)))


class Powers:
    """Powers of an odd base and of its inverse, modulo 2^64, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, ODD, dtype=np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(ODD, -1, 1 << 64), dtype=np.uint64)])

    def prefix(self, x: np.ndarray) -> np.ndarray:
        """Prefix polynomials of x; those of a stretch [s, e) are (out[e] - out[s]) * down[s]."""
        self.reach(len(x))
        return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x * self.up[:len(x)], dtype=np.uint64)])


POWERS = Powers()


def salt_of(lang: str, words: int) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), seed=words)


class Piecewise:
    """Words and n-gram fingerprints of a run of texts (bytes) with their languages; ``own`` starts of the last text count (all if None)."""

    def __init__(self, texts: list[bytes], langs: list[str], base: list[int], own: int | None = None):
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.text_start = np.cumsum(sizes) - sizes
        self.data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
        kind = KIND[self.data]
        word = kind == 0
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        edge = np.r_[0, edge] if len(word) and word[0] else edge
        self.start, self.end = edge[0::2], edge[1::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[self.start]
        self.of = np.searchsorted(self.text_start, self.start, side="right") - 1
        self.langs, self.base, self._proof = langs, np.array(base, dtype=np.int64), None
        self.counted = np.ones(len(self.start), dtype=bool) if own is None else self.start < own
        prefix = POWERS.prefix(BYTES[self.data])
        self.hashes = mixed((prefix[self.end] - prefix[self.start]) * POWERS.down[self.start] + (self.end - self.start).astype(np.uint64))
        self.prefix = POWERS.prefix(self.hashes)
        names = sorted(set(langs))
        self.lang_names = names
        self.lang = np.array([names.index(x) for x in langs], dtype=np.int64)[self.of] if len(langs) else np.zeros(0, dtype=np.int64)

    def fingerprints(self, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, is one) of the n words from each word on; ``bits`` below 64 make collisions (tests)."""
        count = len(self.start) - n + 1
        if count <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        salts = np.array([salt_of(x, n) for x in self.lang_names], dtype=np.uint64)[self.lang[:count]]
        fp = mixed((self.prefix[n:] - self.prefix[:count]) * POWERS.down[:count] + salts)
        if bits < 64:
            fp &= np.uint64((1 << bits) - 1)
        return fp, self.piece[:count] == self.piece[n - 1:]

    def proofs(self, i: np.ndarray, n: int) -> np.ndarray:
        """A hash of the n words from each word of i on that shares nothing with the fingerprints: other letters, other order of work."""
        if self._proof is None:
            prefix = POWERS.prefix(OTHER_BYTES[self.data])
            self._proof = mixed((prefix[self.end] - prefix[self.start]) * POWERS.down[self.start] ^ ((self.end - self.start).astype(np.uint64) << np.uint64(40)))
        out = np.full(len(i), n, dtype=np.uint64)
        for k in range(n):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + self._proof[i + k])
        return out

    def phrase(self, i: int, n: int) -> bytes:
        return b" ".join([self.data[s:e].tobytes() for s, e in zip(self.start[i:i + n].tolist(), self.end[i:i + n].tolist())])

    def same_words(self, i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
        """Whether the n words from i on are byte by byte those from j on."""
        ok = np.ones(len(i), dtype=bool)
        size = self.end - self.start
        for k in range(n):
            ok &= size[i + k] == size[j + k]
        for k in range(n):
            live = np.flatnonzero(ok)
            a, b, left = self.start[i[live] + k], self.start[j[live] + k], size[i[live] + k]
            at = 0
            while len(live):  # a byte of all words at a time
                more = left > at
                live, a, b, left = live[more], a[more], b[more], left[more]
                differ = self.data[a + at] != self.data[b + at]
                ok[live[differ]] = False
                live, a, b, left = live[~differ], a[~differ], b[~differ], left[~differ]
                at += 1
        return ok


def runs(batches):
    """Piecewise of bounded runs of rows (text_key, lang, bytes), with the text keys; long texts in pieces that look ahead a few words."""
    def made(rows):
        return Piecewise([r[2] for r in rows], [r[1] for r in rows], [0] * len(rows)), np.array([r[0] for r in rows], dtype=np.int64)

    for batch in batches:
        held, total = [], 0
        for key, lang, text in zip(*((x.as_py() for x in batch.column(i)) for i in range(3))):  # a row at a time: a batch may be a whole partition
            if len(text) <= STEP:
                if held and total + len(text) > STEP:
                    yield made(held)
                    held, total = [], 0
                held.append((key, lang, text))
                total += len(text)
                continue
            a = 0
            while a < len(text):
                b = min(len(text), a + STEP)
                while b < len(text) and not KIND[text[b]]:
                    b += 1  # a word is never cut
                yield Piecewise([text[a:AHEAD.match(text, b).end()]], [lang], [a], b - a), np.array([key], dtype=np.int64)
                a = b
        if held:
            yield made(held)


def chosen(p: Piecewise, n: int, frequent: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, fingerprint) of the n-grams whose parts of one word less are in the bitmap of their length."""
    fp, one = p.fingerprints(n, bits)
    if n > 1 and len(fp):
        part, _ = p.fingerprints(n - 1, bits)
        known = in_bitmap(part, frequent[n - 2])
        one = one & known[:len(fp)] & known[1:len(fp) + 1]
    at = np.flatnonzero(one & p.counted[:len(fp)])
    return at, fp[at]


def count_task(n: int, frequent, bits: int):
    """Counts of the fingerprints of one length, as rows of COUNTED."""
    def task(batches):
        held, total = [], 0

        def packed():
            fp, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(times.astype(np.int64))], ["fp", "n"])

        for p, _ in runs(batches):
            _, fp = chosen(p, n, [x.value for x in frequent], bits)
            held.append(fp)
            total += len(fp)
            if total >= HELD:
                yield packed()
                held, total = [], 0
        if total:
            yield packed()
    return task


#: Columns of the last pass inside a task, all 64-bit.
POINT = np.dtype([(c, np.int64) for c in ("words", "lang", "fp", "n", "proof", "clash", "text_key", "at")])


def combined(points: np.ndarray) -> np.ndarray:
    """One row per (words, fp): counts added, the first pointer kept, a clash where proofs or languages differ."""
    order = np.lexsort((points["fp"], points["words"]))  # columns are sorted one at a time: whole rows would be held several times
    fp, words = points["fp"][order], points["words"][order]
    new = np.r_[True, (fp[1:] != fp[:-1]) | (words[1:] != words[:-1])]
    del fp, words
    head = np.flatnonzero(new)
    lead = order[head][np.cumsum(new) - 1]
    clash = points["clash"][order] > 0
    for c in ("proof", "lang"):
        clash |= points[c][order] != points[c][lead]
    out = points[order[head]]
    out["n"] = np.add.reduceat(points["n"][order], head)
    out["clash"] = np.logical_or.reduceat(clash, head)
    return out


def pointer_task(frequent, bits: int):
    """Counts with a pointer of the n-grams of frequent fingerprints, and each language's words (words = 0), as rows of POINTED."""
    names = [x.split()[0] for x in POINTED.split(", ")]

    def task(batches):
        table = [x.value for x in frequent]
        langs: dict[str, int] = {}
        held, total = [], 0

        def packed(all_points):
            by_number = np.array(list(langs), dtype=object)
            for i in range(0, len(all_points), BATCH):
                points = all_points[i:i + BATCH]
                columns = [pa.array(points["words"].astype(np.int32)), pa.array(by_number[points["lang"]], pa.string()), *[pa.array(points[c]) for c in ("fp", "n", "proof")],
                           pa.array(points["clash"] > 0), *[pa.array(points[c]) for c in ("text_key", "at")]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        def taken():
            """What is held, as one table, which is then the only one."""
            points = np.concatenate(held)
            held.clear()
            return combined(points)

        for p, keys in runs(batches):
            number = np.array([langs.setdefault(x, len(langs)) for x in p.lang_names], dtype=np.int64)
            present, words = np.unique(p.lang[p.counted], return_counts=True)
            rows = np.zeros(len(present), dtype=POINT)
            rows["lang"], rows["n"] = number[present], words
            rows["fp"] = np.array([salt_of(p.lang_names[x], 0) for x in present], dtype=np.uint64).view(np.int64)
            held.append(rows)
            for n in range(1, LONGEST + 1):
                at, fp = chosen(p, n, table, bits)
                hit = in_bitmap(fp, table[n - 1])
                at, fp = at[hit], fp[hit]
                if not len(at):
                    continue
                order = np.argsort(fp, kind="stable")
                at, fp = at[order], fp[order]
                head = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
                times = np.diff(np.r_[head, len(fp)])
                same = np.minimum.reduceat(p.same_words(at, np.repeat(at[head], times), n), head)
                i = at[head]
                rows = np.zeros(len(head), dtype=POINT)
                rows["words"], rows["lang"], rows["fp"], rows["n"], rows["clash"] = n, number[p.lang[i]], fp[head].view(np.int64), times, ~same
                rows["proof"] = p.proofs(i, n).view(np.int64)
                rows["text_key"], rows["at"] = keys[p.of[i]], p.start[i] - p.text_start[p.of[i]] + p.base[p.of[i]]
                held.append(rows)
                total += len(rows)
            if total >= HELD_POINTS:
                points = taken()
                total = len(points)
                if total > HELD_POINTS // 2:
                    yield from packed(points)
                    total = 0
                else:
                    held.append(points)
        if held:
            yield from packed(taken())
    return task


def recount_task(frequent, clashing, bits: int):
    """Counts by text of the n-grams whose fingerprints clash, as rows of BY_TEXT."""
    names = [x.split()[0] for x in BY_TEXT.split(", ")]

    def task(batches):
        for p, _ in runs(batches):
            rows: dict[tuple, int] = {}
            for n in range(1, LONGEST + 1):
                at, fp = chosen(p, n, [x.value for x in frequent], bits)
                hit = in_bitmap(fp, clashing.value)
                for i, f in zip(at[hit].tolist(), fp[hit].view(np.int64).tolist()):
                    key = (n, p.langs[p.of[i]], f, p.phrase(i, n).decode())
                    rows[key] = rows.get(key, 0) + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(*k, c) for k, c in rows.items()]), [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64()])],
                                                 names=names)
    return task


def read_phrases(batches):
    """Phrases at pointers: rows (words, lang, fp, phrase) from rows (text, pointers)."""
    for batch in batches:
        out = []
        for text, pointers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for q in pointers:
                words, a = [], q["at"]
                while len(words) < q["words"]:
                    while text[a] in BLANKS:
                        a += 1
                    b = a
                    while b < len(text) and not KIND[text[b]]:
                        b += 1
                    words.append(text[a:b].lower())
                    a = b
                out.append((q["words"], q["lang"], q["fp"], b" ".join(words).decode()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.string(), pa.int64(), pa.string()])], ["words", "lang", "fp", "phrase"])


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """((words, lang, phrase, a) of all phrases of 1 to 5 words that occur ``least`` times, (lang, n) of all words)."""
    need(docs, text, lang)
    broadcast = docs.sparkSession.sparkContext.broadcast
    body = text_or_empty(text)
    rows = docs.select(F.xxhash64(body).alias("text_key"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), body.cast("binary").alias("bytes"))
    frequent = []
    for n in range(1, LONGEST + 1):
        counts = rows.mapInArrow(count_task(n, frequent, bits), COUNTED).groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        frequent = [*frequent, broadcast(bitmap_of(counts, "fp", FILTER_BITS))]
    found = written(rows.mapInArrow(pointer_task(frequent, bits), POINTED).groupBy("words", "lang", "fp").agg(
        F.sum("n").alias("a"), ((F.min("proof") != F.max("proof")) | F.max("clash")).alias("clash"),
        F.first("text_key").alias("text_key"), F.first("at").alias("at")).where((F.col("a") >= least) | (F.col("words") == 0)), "fingerprints")
    phrases = found.where("words > 0")
    good = phrases.where("not clash")
    pointers = written(good.groupBy("text_key").agg(F.collect_list(F.struct("words", "lang", "fp", "at")).alias("pointers")), "pointers")
    read = (rows.select("text_key", "bytes").join(pointers, "text_key").dropDuplicates(["text_key"]).select("bytes", "pointers").mapInArrow(read_phrases, "words int, lang string, fp long, phrase string")
            .groupBy("words", "lang", "fp").agg(F.min("phrase").alias("phrase")))
    table = good.select("words", "lang", "fp", "a").join(read, ["words", "lang", "fp"]).select("words", "lang", "phrase", "a")
    bad = phrases.where("clash")
    if not bad.isEmpty():
        again = rows.mapInArrow(recount_task(frequent, broadcast(bitmap_of(bad, "fp", FILTER_BITS)), bits), BY_TEXT)
        again = again.join(bad.select("words", "lang", "fp"), ["words", "lang", "fp"], "left_semi").groupBy("words", "lang", "phrase").agg(F.sum("n").alias("a"))
        table = table.unionByName(again.where(F.col("a") >= least))
    return written(table, "phrases"), found.where("words = 0").groupBy("lang").agg(F.sum("a").alias("n"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, covered_percent: int = 100, top: int = 2000, bits: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to 5 words."""
    phrases, totals = phrase_counts(docs, text, lang, least, bits)
    phrases = phrases.withColumn("split", F.split("phrase", " ", -1))
    candidates = phrases.where("words > 1")
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "split", "words").select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("split", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("split", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    part = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    scored = (cuts.join(part.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "left"])
              .join(part.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "right"]).join(totals, "lang"))
    wide = {c: F.col(c).cast("decimal(18,0)") for c in "alrn"}
    exact = scored.withColumn("up", (wide["a"] * wide["n"]).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("down", wide["l"] * wide["r"])
    best = (exact.withColumn("score", F.expr("up div down")).groupBy("lang", "phrase", "a", "n")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    at = F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split, i, m), ' '))))"))
    cover = candidates.where("words > 2").select("lang", F.col("a").alias("f"), at.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    stay = best.join(cover, ["lang", "phrase"], "left").where(F.col("f").isNull() | (100 * F.col("f") < covered_percent * F.col("a")))
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (stay.select("lang", "phrase", "a", "cut.*", "n").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


ORACLE = """
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs),
split AS (SELECT lang, [x for x in regexp_split_to_array(piece, '[ \\t]+') if x <> ''] AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
words AS (SELECT lang, id, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM (SELECT *, row_number() OVER () AS id FROM split)),
runs AS (SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4, lead(w1, 4) OVER p AS w5
         FROM words WINDOW p AS (PARTITION BY id ORDER BY i)),
grams AS (SELECT lang, k, CASE k WHEN 1 THEN w1 WHEN 2 THEN w1 || ' ' || w2 WHEN 3 THEN w1 || ' ' || w2 || ' ' || w3
                 WHEN 4 THEN w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 ELSE w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 END AS phrase
          FROM runs, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM grams WHERE phrase IS NOT NULL GROUP BY lang, k, phrase HAVING count(*) >= {least}),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS c FROM f WHERE k > 1),
scored AS (SELECT x.lang, x.phrase, x.a, x.c, p.a AS l, q.a AS r, t.n,
                  CAST((1000::HUGEINT * x.a * t.n) // (p.a::HUGEINT * q.a) AS BIGINT) AS score
           FROM cuts x JOIN totals t ON t.lang = x.lang
           JOIN f p ON p.lang = x.lang AND p.phrase = array_to_string(x.w[1:x.c], ' ')
           JOIN f q ON q.lang = x.lang AND q.phrase = array_to_string(x.w[x.c + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
parts AS (SELECT lang, a, w, k, unnest(range(2, k)) AS m FROM f WHERE k > 2),
inside AS (SELECT lang, a, unnest([array_to_string(w[i:i + m - 1], ' ') for i in range(1, k - m + 2)]) AS phrase FROM parts),
cover AS (SELECT lang, phrase, max(a) AS f FROM inside GROUP BY lang, phrase),
stay AS (SELECT b.* FROM best b LEFT JOIN cover c ON c.lang = b.lang AND c.phrase = b.phrase WHERE c.f IS NULL OR 100 * c.f < {covered} * b.a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM stay)
SELECT * FROM ranked WHERE rank <= {top}
"""
