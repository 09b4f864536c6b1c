"""Line deduplication by a segment-partition edit join.

A line (its characters without white space at both ends) is dropped where an
equal one, or one within ``edits`` character edits, comes earlier in the
corpus; order is that of (document id, line number). Blank lines stay, and
only lines of at least ``near_chars`` characters are compared inexactly.

Segments: a line of L characters is cut into edits + 1 even segments. Two
lines within ``edits`` edits share one of them, at nearly the same place, so
each line is indexed under (L, segment number, segment) and probes the
indexes of the lengths L - edits to L with its substrings at the few starts
that can matter (multi-match-aware). Substring hashes come from prefix sums
of a polynomial hash over a whole run of text.

Equal lines combine per task before the shuffle; a key's group merges them to
their first place. Candidates must pass a bound on letter counts (packed in
64 bits); what remains is verified on the lines' characters with a banded
bit-parallel automaton (2 * edits + 1 diagonals, edits + 1 words). Texts for
that are read again only from documents that hold a candidate, which a filter
of fixed size finds.

A small group gives all its candidates. A crowded one gives each line's
``PARTNERS`` earliest candidates and tells whether there are more; where a line
has more, the key's lines are written too, once each. Only lines all of whose
candidates fail the verification, and that have more, are compared to all
others of such a key in a second round, from what was written. So groups of
near copies cost their lines, not their pairs, and no link is missed. The
second round deals the open lines and all lines of a key to blocks of about
``BLOCK`` lines; a task compares one block of each, verifies on the spot, and
only lines with a link leave it.

A line's place is one integer, the document's number and the line's. Unique
ids below 2^42 in size are the numbers; otherwise (null, repeated or larger
ids, documents of more than 2^20 lines) all distinct rows are numbered in the
order of (id, hash of the text), and a long document takes several numbers.

Defined results: null text has no lines and stays null; a row that repeats id
and text keeps the lines its first copy keeps; different texts under one id,
or under none, are different documents; a null doc_id sorts first; an empty
table gives an empty one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from offerlab.llm.blocks import bounds, grouped, small_pairs
from offerlab.llm.common import bitmap_of, bounded_ranges, in_bitmap, in_filter, need, shuffle_width, written

EDITS = 2
NEAR_CHARS = 20
#: Bytes of text that are worked on at once.
STEP = 250_000
LINE_BITS = 20
FILTER_BITS = 25
SMALL_GROUP = 64
#: Candidates per line and key that a crowded key gives in the first round.
PARTNERS = 8
#: Rows of a batch in which a crowded key gives its lines.
BATCH = 50_000
#: Lines of a key, on either side, that are compared in one cell of the second round.
BLOCK = 4096
ODD = 0xD6E8FEB86659FD93
WHITE = "\t\n\v\f\r \x85\xa0\u3000"
BLANK = np.isin(np.arange(0x3002), [ord(c) for c in WHITE])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


#: Values of the characters below 2^16.
LETTERS = _mixed(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x1234567))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of an odd base and of its inverse, modulo 2^64."""
    up, down = (np.cumprod(np.r_[np.uint64(1), np.full(n, x, dtype=np.uint64)]) for x in (ODD, pow(ODD, -1, 1 << 64)))
    return up, down


@lru_cache(maxsize=1)
def kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return powers(2 * STEP)


def place(doc_id: int | None, line: int) -> int:
    """(document id, line number) as one integer that sorts like the pair; a null id sorts first."""
    if doc_id is None:
        doc_id = -(1 << 42)
    if not -(1 << 42) <= doc_id < 1 << 42:
        raise ValueError("a document id of 2^42 or more")
    return (doc_id << LINE_BITS) + min(line, (1 << LINE_BITS) - 1)


def segment_cuts(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of each of the edits + 1 even segments, shorter ones first."""
    parts = edits + 1
    base, extra = length // parts, length % parts
    out, start = [], np.zeros_like(length)
    for i in range(parts):
        size = base + (i >= parts - extra)
        out.append((start, size))
        start = start + size
    return out


def probe_shifts(edits: int, shorter: int, segment: int) -> range:
    """Starts, relative to the segment's start in a line ``shorter`` characters shorter, at which a probe can match (segment from 0)."""
    rest = edits - segment
    return range(max(-segment, shorter - rest), min(segment, shorter + rest) + 1)


class Lines:
    """Lines of a run of texts as code points, with their hashes."""

    def __init__(self, texts: list[str | None]):
        joined = "\n".join(x or "" for x in texts)
        self.data = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = len(self.data)
        breaks = np.flatnonzero(self.data == 10)
        start, end = np.r_[0, breaks + 1], np.r_[breaks, n]
        sizes = np.array([len(x or "") for x in texts])
        doc_start = np.cumsum(sizes + 1) - sizes - 1
        of = np.searchsorted(doc_start, start, side="right") - 1
        first = np.searchsorted(of, np.arange(len(texts)))
        number = np.arange(len(start)) - first[of]
        # strip white space: first and last other character of each line
        solid = np.flatnonzero(~BLANK[np.minimum(self.data, len(BLANK) - 1)])
        if len(solid):
            a = np.searchsorted(solid, start)
            b = np.searchsorted(solid, end) - 1
            some = a <= b
            self.start, self.end = solid[a[some]], solid[b[some]] + 1
        else:
            some = np.zeros(len(start), dtype=bool)
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.of, self.number = of[some], number[some]
        self.length = self.end - self.start
        up, self.back = kept_powers() if n <= 2 * STEP else powers(n)
        letters = LETTERS[np.minimum(self.data, len(LETTERS) - 1)]
        rest = np.flatnonzero(self.data >= len(LETTERS))
        letters[rest] = _mixed(self.data[rest].astype(np.uint64) + np.uint64(0x1234567))
        letters *= up[:n]
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(letters, out=self.total[1:])
        self.hash = self.hash_of(self.start, self.length)

    def hash_of(self, start: np.ndarray, size: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        h = (self.total[start + size] - self.total[start]) * self.back[start]
        return _mixed(_mixed(h ^ (np.asarray(size).astype(np.uint64) << np.uint64(7))) + np.asarray(salt).astype(np.uint64))

    def places(self, ids: list[int | None]) -> np.ndarray:
        """(document id, line number) of each line as one integer."""
        first = np.array([place(x, 0) for x in ids], dtype=np.int64)
        return first[self.of] + self.number

    def letter_counts(self, pick: np.ndarray) -> np.ndarray:
        """Counts of 16 classes of characters modulo 16, packed into 64 bits, of each of the lines ``pick``."""
        length = self.length[pick]
        at = np.arange(length.sum()) + np.repeat(self.start[pick] - np.cumsum(length) + length, length)
        kind = (self.data[at] * np.uint32(2654435761)) >> np.uint32(28)
        counts = np.bincount(np.repeat(np.arange(len(pick)) * 16, length) + kind, minlength=16 * len(pick)).reshape(-1, 16).astype(np.uint64) & np.uint64(15)
        return (counts << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)


def classes_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of letter classes whose counts differ; an edit changes at most two."""
    d = a ^ b
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    return np.bitwise_count(d & np.uint64(0x1111111111111111))


def far_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lower bound of twice the edits between lines, from their packed letter counts."""
    total = np.zeros(np.broadcast_shapes(a.shape, b.shape), dtype=np.uint8)
    for i in range(16):
        d = ((a >> np.uint64(4 * i)) - (b >> np.uint64(4 * i))).astype(np.uint8) & np.uint8(15)
        total += np.minimum(d, 16 - d)
    return total


def within_edits(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, edits: int) -> np.ndarray:
    """Whether row i of ``a`` and ``b`` (code points, padded) are at most ``edits`` edits apart.

    Bit d of word e tells, after j characters of b, whether a[: j + d - edits] is at most e edits from b[: j].
    """
    n, band = len(a), 2 * edits + 1
    full = np.uint16((1 << band) - 1)
    one = np.uint16(1)
    padded = np.concatenate([np.full((n, edits), 0xFFFFFFFF, dtype=np.uint32), a, np.full((n, edits + 1 + max(0, b.shape[1] - a.shape[1])), 0xFFFFFFFE, dtype=np.uint32)], axis=1)
    words = [np.full(n, sum(1 << (edits + d) for d in range(e + 1)), dtype=np.uint16) for e in range(edits + 1)]
    done = np.zeros(n, dtype=bool)
    goal = (a_size - b_size + edits).astype(np.int64)
    ok = (goal >= 0) & (goal < band)
    bit = np.where(ok, goal, 0).astype(np.uint16)
    result = np.zeros(n, dtype=bool)
    for j in range(b.shape[1] + 1):
        now = ~done & (b_size == j)
        if now.any():
            result[now] = (words[edits][now] >> bit[now] & one).astype(bool)
            done |= now
        if j == b.shape[1]:
            break
        match = np.zeros(n, dtype=np.uint16)
        for d in range(band):
            match |= (padded[:, j + d] == b[:, j]).astype(np.uint16) << np.uint16(d)
        new = [words[0] & match]
        for e in range(1, edits + 1):
            w = words[e] & match | words[e - 1] | words[e - 1] >> one  # match, substitution, b's character added
            w |= new[e - 1] << one  # a's character left out
            new.append(w & full)
        words = new
    return result & ok


def runs(batches):
    """(Lines, places) of bounded runs of rows (id, text); texts become Python's a run at a time, as a batch may be a whole partition."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for i, j in bounded_ranges([x or 0 for x in pc.binary_length(texts).to_pylist()], STEP):
            lines = Lines(texts.slice(i, j - i).to_pylist())
            yield lines, lines.places(ids[i:j])


def keyed_lines(batches, edits: int, near_chars: int, wanted: np.ndarray | None = None):
    """Index and probe rows of a task's lines: (key, line, place, letters, is_index); only those of keys in the bitmap ``wanted``, if given."""
    seen: dict[int, int] = {}
    names = ["key", "line", "place", "letters", "is_index"]
    for lines, places in runs(batches):
        order = np.lexsort((places, lines.hash))
        first = order[np.r_[True, lines.hash[order[1:]] != lines.hash[order[:-1]]]] if len(order) else order  # least place in this run
        if len(seen) > 300_000:
            seen.clear()
        pick = []
        for k, h, at in zip(first.tolist(), lines.hash[first].tolist(), places[first].tolist()):
            if at < seen.get(h, at + 1):
                seen[h] = at
                pick.append(k)
        pick = np.array(pick, dtype=np.int64)
        pick = pick[lines.length[pick] >= near_chars]
        if not len(pick):
            continue
        start, length = lines.start[pick], lines.length[pick]
        keys, index = [], []
        for shorter in range(edits + 1):
            other = length - shorter
            for s, (begin, size) in enumerate(segment_cuts(other, edits)):
                for shift in probe_shifts(edits, shorter, s):
                    keys.append(lines.hash_of(begin + shift + start, size, other * 64 + s))
                    index.append(shorter == 0 and shift == 0)
        key, is_index = np.concatenate(keys), np.repeat(np.array(index), len(pick))
        of = np.tile(np.arange(len(pick)), len(keys))
        if wanted is not None:
            hit = np.flatnonzero(in_bitmap(key, wanted))
            if not len(hit):
                continue
            some, of = np.unique(of[hit], return_inverse=True)
            key, is_index, pick = key[hit], is_index[hit], pick[some]
        columns = [lines.hash[pick].view(np.int64), places[pick], lines.letter_counts(pick).view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), *[c[of] for c in columns], is_index)], names)


KEYED = "key long, line long, place long, letters long, is_index boolean"
PAIR = "a long, a_place long, b long, b_place long, more boolean"
#: Pairs (no key), and the lines b of the keys in which a line has more candidates (no a).
FOUND = f"{PAIR}, key long, letters long, is_index boolean"


def candidates(table: pa.Table, edits: int):
    """Pairs of different lines of a key, one of them indexed, that pass the bound on letter counts; a comes first.

    Crowded keys give each line's earliest partners and whether it has more, and all their lines if one has. Rows of FOUND.
    """
    key, line, at, letters = (table.column(i).to_numpy() for i in range(4))
    index = table.column(4).to_numpy(zero_copy_only=False)
    starts, sizes = bounds(key)
    busy = np.repeat(sizes > 1, sizes)
    key, line, at, letters, index = key[busy], line[busy], at[busy], letters[busy].view(np.uint64), index[busy]
    if not len(key):
        return
    # equal lines of a key become one, at their first place
    order = np.lexsort((line, key))
    key, line, at, letters, index = key[order], line[order], at[order], letters[order], index[order]
    lead = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (line[1:] != line[:-1])])
    key, line, letters = key[lead], line[lead], letters[lead]
    at, index = np.minimum.reduceat(at, lead), np.logical_or.reduceat(index, lead)
    # then by place, so that the earlier line of a pair has the smaller row number
    order = np.lexsort((line, at, key))
    key, line, at, letters, index = key[order], line[order], at[order], letters[order], index[order]
    starts, sizes = bounds(key)
    most = 2 * edits

    names = [x.split()[0] for x in FOUND.split(", ")]

    def out(i, j, more):
        none = [pa.nulls(len(j), t) for t in (pa.int64(), pa.int64(), pa.bool_())]
        return pa.RecordBatch.from_arrays([*[pa.array(x) for x in (line[i], at[i], line[j], at[j], more)], *none], names)

    def members(rows, more):
        none = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, *[pa.array(x) for x in (line[rows], at[rows], more, key[rows], letters[rows].view(np.int64), index[rows])]], names)

    small = (sizes > 1) & (sizes <= SMALL_GROUP)
    i, j = small_pairs(starts[small], sizes[small])
    near = (index[i] | index[j]) & (classes_apart(letters[i], letters[j]) <= most)
    i, j = i[near], j[near]
    near = far_apart(letters[i], letters[j]) <= most
    if near.any():
        yield out(i[near], j[near], np.zeros(near.sum(), dtype=bool))
    for s, n in zip(starts[sizes > SMALL_GROUP].tolist(), sizes[sizes > SMALL_GROUP].tolist()):
        more = np.zeros(n, dtype=bool)
        for k in range(s, s + n, 256):
            later = np.arange(k, min(k + 256, s + n))
            found = np.zeros(len(later), dtype=np.int64)
            rows = []
            for p in range(s, int(later[-1]), 4096):
                live = np.flatnonzero(found <= PARTNERS)
                if not len(live):
                    break
                earlier, mine = np.arange(p, min(p + 4096, int(later[-1]))), later[live]
                x, y = np.nonzero(classes_apart(letters[mine][:, None], letters[earlier][None, :]) <= most)
                ok = (earlier[y] < mine[x]) & (index[earlier[y]] | index[mine[x]])
                x, y = x[ok], y[ok]
                ok = far_apart(letters[mine[x]], letters[earlier[y]]) <= most
                x, y = x[ok], y[ok]  # y rises within x
                if not len(x):
                    continue
                order_of = np.arange(len(x)) - np.searchsorted(x, x) + found[live[x]]
                pick = order_of < PARTNERS
                rows.append((earlier[y[pick]], live[x[pick]]))
                found += np.bincount(live[x], minlength=len(later))
            for a, b in rows:
                yield out(a, later[b], found[b] > PARTNERS)
            more[k - s:k - s + len(later)] = found > PARTNERS
        if more.any():
            for k in range(0, n, BATCH):
                rows = np.arange(s + k, s + min(k + BATCH, n))
                yield members(rows, more[k:k + BATCH])


def docs_among(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` (doc, text) that ``wanted`` (doc) holds, and few others."""
    return docs.where(in_filter(wanted.select(F.xxhash64("doc").alias("h")), FILTER_BITS)(F.xxhash64("doc")))


def line_texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(place, line_text) of all ``places``; texts are read from documents that hold one."""
    wanted = places.select(F.shiftright("place", LINE_BITS).alias("doc"), F.col("place").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int").alias("line"))
    wanted = written(wanted.groupBy("doc").agg(F.collect_set("line").alias("lines")), "wanted")
    # a filter of fixed size on the ids keeps most texts out of the shuffle
    some = docs_among(docs.select(F.coalesce("id", F.lit(-(1 << 42))).alias("doc"), "text"), wanted)

    def cut(batches):
        for batch in batches:
            rows = []
            for d, text, numbers in zip(*(batch.column(i).to_pylist() for i in range(3))):
                split = (text or "").split("\n")
                rows += [(place(d, k), split[k]) for k in numbers if k < len(split)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["place", "line_text"])

    return written(some.join(wanted, "doc").select("doc", "text", "lines").mapInArrow(cut, "place long, line_text string").dropDuplicates(["place"]), "texts")


def code_points(line: str) -> np.ndarray:
    return np.frombuffer(line.strip(WHITE).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def near_pairs(a: list[np.ndarray], b: list[np.ndarray], edits: int) -> np.ndarray:
    """Whether a[i] and b[i] are at most ``edits`` edits apart, in steps of bounded size."""
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b)]).reshape(-1, 2)
    keep = np.zeros(len(a), dtype=bool)
    order = np.argsort(sizes.max(axis=1), kind="stable")
    for i, j in bounded_ranges(sizes.max(axis=1)[order].tolist(), 500_000):
        at = order[i:j]
        width = int(sizes[at].max())
        x, y = (np.full((len(at), width), 0xFFFFFFFD, dtype=np.uint32) for _ in range(2))
        for r, k in enumerate(at):
            x[r, :len(a[k])], y[r, :len(b[k])] = a[k], b[k]
        keep[at] = within_edits(x, y, sizes[at, 0], sizes[at, 1], edits)
    return keep


def verified(docs: DataFrame, pairs: DataFrame, edits: int) -> DataFrame:
    """The pairs whose lines are at most ``edits`` edits apart."""
    texts = line_texts(docs, pairs.select(F.col("a_place").alias("place")).unionByName(pairs.select(F.col("b_place").alias("place"))).distinct())

    def verify(batches):
        for batch in batches:
            a, b = ([code_points(x) for x in batch.column(i).to_pylist()] for i in (5, 6))
            yield batch.select([0, 1, 2, 3, 4]).filter(pa.array(near_pairs(a, b, edits)))

    joined = (pairs.join(texts.select(F.col("place").alias("a_place"), F.col("line_text").alias("a_text")), "a_place")
              .join(texts.select(F.col("place").alias("b_place"), F.col("line_text").alias("b_text")), "b_place"))
    return written(joined.select("a", "a_place", "b", "b_place", "more", "a_text", "b_text").mapInArrow(verify, PAIR), "verified")


def linked_in_cells(table: pa.Table, edits: int):
    """Open lines of a cell that are within ``edits`` edits of an earlier line of the cell."""
    cell, line, at, letters = (table.column(i).to_numpy() for i in range(4))
    index, mine = (table.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
    letters, most = letters.view(np.uint64), 2 * edits
    for s, n in zip(*(x.tolist() for x in bounds(cell))):
        group = np.arange(s, s + n)
        own, others = group[mine[s:s + n]], group[~mine[s:s + n]]
        others = others[np.lexsort((line[others], at[others]))]
        points = [code_points(x) for x in table.column(6).slice(s, n).to_pylist()]
        for k in range(0, len(own), 256):
            later = own[k:k + 256]
            hit = np.zeros(len(later), dtype=bool)
            for p in range(0, len(others), 4096):
                live, earlier = np.flatnonzero(~hit), others[p:p + 4096]
                x, y = np.nonzero(classes_apart(letters[later[live]][:, None], letters[earlier][None, :]) <= most)
                x, y = live[x], earlier[y]
                b = later[x]
                ok = ((at[y] < at[b]) | ((at[y] == at[b]) & (line[y] < line[b]))) & (index[y] | index[b])
                x, y = x[ok], y[ok]
                ok = far_apart(letters[later[x]], letters[y]) <= most
                x, y = x[ok], y[ok]
                for i in range(0, len(x), 4096):
                    u, v = x[i:i + 4096], y[i:i + 4096]
                    u, v = u[~hit[u]], v[~hit[u]]
                    near = near_pairs([points[c - s] for c in v], [points[c - s] for c in later[u]], edits)
                    hit[u[near]] = True
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(line[later[hit]])], ["line"])


def open_linked(docs: DataFrame, crowded: DataFrame, opened: DataFrame, edits: int, width: int) -> DataFrame:
    """(line): the open lines that are within ``edits`` edits of any earlier line of a key in which they have more candidates.

    ``crowded`` has the lines of such keys, ``opened`` (line).
    """
    # a line's other keys gave all its candidates in the first round
    own = crowded.where("more").join(opened.select("line"), "line", "left_semi").select("key", "line", F.lit(True).alias("open"))
    members = (crowded.join(own.select("key").distinct(), "key", "left_semi").join(own, ["key", "line"], "left")
               .select("key", "line", "place", "letters", "is_index", F.coalesce("open", F.lit(False)).alias("open")))
    members = written(members, "open-members")
    texts = line_texts(docs, members.select("place").distinct())
    blocks = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n_all"), F.ceil(F.count_if("open") / BLOCK).alias("n_open"))
    # only keys of more than a block, so at most one row for BLOCK members
    members = members.join(texts, "place").join(F.broadcast(blocks.where("n_all > 1")), "key", "left").fillna(1, ["n_all", "n_open"])
    rest = ["line", "place", "letters", "is_index"]
    mine = members.where("open").select("key", F.expr("pmod(line, n_open)").alias("i"), F.explode(F.expr("sequence(0L, n_all - 1)")).alias("j"), *rest, F.lit(True).alias("mine"), "line_text")
    others = members.select("key", F.explode(F.expr("sequence(0L, n_open - 1)")).alias("i"), F.expr("pmod(line, n_all)").alias("j"), *rest, F.lit(False).alias("mine"), "line_text")
    # cells whose hashes clash merely compare more lines
    cells = mine.unionByName(others).select(F.xxhash64("key", "i", "j").alias("cell"), *rest, "mine", "line_text")
    return written(grouped(cells, "cell", lambda t: linked_in_cells(t, edits), "line long", width).distinct(), "open-linked")


def near_lines(docs: DataFrame, edits: int = EDITS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(line): hashes of the lines that are within ``edits`` edits of an earlier, different line; ``docs`` has (id, text)."""
    width = shuffle_width(docs.sparkSession)
    keyed = docs.mapInArrow(lambda b: keyed_lines(b, edits, near_chars), KEYED)

    found = written(grouped(keyed, "key", lambda t: candidates(t, edits), FOUND, width), "found")
    first = written(found.where("key is null").groupBy("a", "b").agg(F.min("a_place").alias("a_place"), F.min("b_place").alias("b_place"), F.max("more").alias("more"))
                    .select("a", "a_place", "b", "b_place", "more"), "candidates")
    near = verified(docs, first, edits)
    dropped = near.select(F.col("b").alias("line")).distinct()
    opened = first.where("more").select(F.col("b").alias("line")).distinct()
    opened = written(opened.join(dropped, "line", "left_anti"), "open")
    if not opened.isEmpty():
        crowded = found.where("key is not null").select("key", F.col("b").alias("line"), F.col("b_place").alias("place"), "letters", "is_index", "more")
        dropped = dropped.unionByName(open_linked(docs, crowded, opened, edits, width)).distinct()
    return dropped


def all_lines(batches):
    """(line, place) of every line that is not blank."""
    for lines, places in runs(batches):
        yield pa.RecordBatch.from_arrays([pa.array(lines.hash.view(np.int64)), pa.array(places)], ["line", "place"])


def numbered(docs: DataFrame, doc: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(docs with their number __doc, (id, text) of at most 2^20 lines each, (part, __doc, skipped) where rows had to be numbered)."""
    id_, body = F.col(doc).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit(""))
    n_lines = F.octet_length(body) - F.octet_length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    by_id = docs.select(id_.alias("id"), n_lines.alias("lines")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("lines").alias("lines"))
    small = F.col("id").isNotNull() & (F.col("id") >= -(1 << 42) + 1) & (F.col("id") < 1 << 42) & (F.col("n") == 1) & (F.col("lines") <= 1 << LINE_BITS)
    if by_id.where(~small).isEmpty():
        return docs.withColumn("__doc", id_), docs.select(id_.alias("id"), F.col(text).cast("string").alias("text")), None
    width = shuffle_width(docs.sparkSession)
    order = ["has", "id", "h1", "h2"]
    row = [id_.isNotNull().alias("has"), id_.alias("id"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2")]
    keys = docs.select(*row, F.ceil(n_lines / (1 << LINE_BITS)).alias("parts")).distinct()
    placed = written(keys.repartitionByRange(width, *order).withColumn("at", F.spark_partition_id()), "rows")
    before = placed.groupBy("at").agg(F.sum("parts").alias("n"))  # a row per partition
    before = before.select("at", F.coalesce(F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("parts").over(Window.partitionBy("at").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = written(placed.withColumn("inside", inside).join(F.broadcast(before), "at").select(*order, "parts", (F.col("inside") + F.col("before")).alias("__doc")), "numbers")
    mine = docs.select(F.struct(*docs.columns).alias("__row"), *row[1:])
    met = mine.join(numbers.drop("has").withColumnRenamed("id", "__id"), ["h1", "h2"]).where(F.col("id").eqNullSafe(F.col("__id")))
    docs = met.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns], "__doc", F.col("parts").alias("__parts"))
    piece = F.when(F.col("__parts") == 1, F.col(text).cast("string")).otherwise(F.array_join(F.slice(
        F.split(F.col(text).cast("string"), F.lit("\n"), F.lit(-1)), (F.col("__i") * (1 << LINE_BITS) + 1).cast("int"), F.lit(1 << LINE_BITS)), "\n"))
    plain = docs.select("__doc", "__parts", F.col(text), F.explode(F.expr("sequence(0L, __parts - 1)")).alias("__i")).select((F.col("__doc") + F.col("__i")).alias("id"), piece.alias("text"))
    parts = numbers.select("__doc", F.explode(F.expr("sequence(0L, parts - 1)")).alias("i")).select((F.col("__doc") + F.col("i")).alias("part"), "__doc", (F.col("i") * (1 << LINE_BITS)).alias("skipped"))
    return docs.drop("__parts"), plain, parts


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", edits: int = EDITS, near_chars: int = NEAR_CHARS, salts: int = 16) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; adds n_lines (not blank) and n_dropped."""
    need(docs, doc, text)
    docs, plain, parts = numbered(docs.drop("n_lines", "n_dropped"), doc, text)
    near = near_lines(plain, edits, near_chars).withColumn("near", F.lit(True))
    lines = written(plain.mapInArrow(all_lines, "line long, place long"), "lines")  # two numbers a line; the texts are read once for both uses
    first = lines.groupBy("line").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    # lines that lose a place; a frequent line's places are spread over salts
    marked = (first.join(near, "line", "left").where("n > 1 or near").select("line", F.when(F.col("near"), F.lit(None)).otherwise(F.col("first")).alias("kept"))
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    lost = (lines.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(salts)).cast("int")).join(written(marked, "marked"), ["line", "salt"])
            .where(F.col("kept").isNull() | (F.col("place") != F.col("kept"))).select("place").distinct())
    lost = lost.select(F.shiftright("place", LINE_BITS).alias("__doc"), F.col("place").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int").alias("number"))
    if parts is not None:
        lost = lost.withColumnRenamed("__doc", "part").join(parts, "part").select("__doc", (F.col("number") + F.col("skipped")).cast("int").alias("number"))
    by_doc = lost.groupBy("__doc").agg(F.collect_list("number").alias("__lost"))
    lost_lines = F.coalesce("__lost", F.expr("cast(array() as array<int>)"))
    split = F.split(F.col(text), F.lit("\n"), F.lit(-1))
    solid = F.filter(split, lambda x: ~x.rlike(f"\\A[{WHITE}]*\\z"))
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(lost_lines, i)), "\n")
    return (docs.join(by_doc, "__doc", "left")
            .withColumn("n_lines", F.coalesce(F.size(solid), F.lit(0)).cast("long")).withColumn("n_dropped", F.size(lost_lines).cast("long"))
            .withColumn(text, kept).drop("__doc", "__lost"))
