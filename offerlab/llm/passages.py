"""Removal of repeated passages by a distributed merge sort of suffixes.

A byte goes where a string of ``span`` bytes that covers it also starts in a
document with a smaller id. Strings are judged on the input; matches never
cross documents.

Which suffixes are sorted. Each ``span``-byte string holds its ``KMER``-byte
piece of least hash; equal strings have it at the same place, so it is enough
to compare suffixes at these anchors (about one byte in fourteen). A first
pass counts the anchors' hashes; anchors of one document only can match
nothing and stay at home. A bitmap of fixed size tells the others (slots that
collide only send more). Later copies of a whole text need no suffixes: all
their bytes are in the first copy.

Runs. A task sorts the suffixes at its anchors, with the bytes to their left,
keeps one of equal ones (that of the smallest document; the others are covered
at once, so a passage in a third of all documents sends a row per task), and
sends sorted runs, front-coded: the length of the prefix shared with the
suffix before, and the rest. Rows meet under the bytes that all strings
around an anchor share, its own ``KMER``. Anchors that the first pass met in
many runs send a row for each of three ranges of their place inside the string
instead (``bands``); rows of a range share more bytes, so that a
frequent passage's ends, with other neighbours in every document, spread over
the buckets.

Merge. A bucket's runs are combined by a loser tree whose nodes know the prefix that
the loser shares with the last winner; unequal lengths decide without
looking at a byte, equal ones compare from there on only. The merged
lengths give groups of equal strings for each place of the anchor, and in each group
all documents but the smallest are covered.

Defined results: null texts read as empty and stay null; rows that share an id never remove
from each other; a null id counts as larger than all others (and all null ids
as equal); an empty table gives an empty one; further columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerlab.llm.common import bitmap_of, discard, in_bitmap, need, shuffle_width, text_or_empty, written

KMER = 24
#: Bytes of text that are hashed at once.
STEP = 1_000_000
#: Suffixes that a task sorts into one set of runs.
RUN_ROWS = 150_000
#: From this count on (at most two per run) an anchor's rows are split by its place in the string.
HOT = 64
#: Bits of the bitmap of repeated anchors.
FILTER_BITS = 26
LAST = (1 << 63) - 1
ODD = np.uint64(0xD6E8FEB86659FD93)


def bands(reach: int) -> list[tuple[int, int]]:
    """Ranges of the places 0 to ``reach`` of an anchor inside a string: all of them, then three that are narrow at both ends."""
    edge = min(3, reach // 3)
    return [(0, reach), (0, edge), (edge + 1, reach - edge - 1), (reach - edge, reach)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def piece_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place, by doubling."""
    power, h, out, done = int(ODD), BYTES[data], None, 0
    step = 1
    while True:
        if size & step:
            if out is None:
                out = h
            else:
                out = out[:len(h) - done] * np.uint64(power) + h[done:len(out) + done] if len(h) > done else out[:0]
            done += step
        if done == size:
            return mixed(out)
        h = h[:-step] * np.uint64(power) + h[step:] if len(h) > step else h[:0]
        power = power * power % (1 << 64)
        step *= 2


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each ``width`` values in a row."""
    got, out = 1, x
    while got < width:
        step = min(got, width - got)
        out = pick(out[:-step], out[step:]) if len(out) > step else out[:0]
        got += step
    return out


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of the documents data[start:end]."""
    if len(data) < span:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    width = span - KMER + 1
    h = piece_hashes(data, KMER)
    n = len(data) - span + 1
    inside = np.zeros(n + 1, dtype=np.int32)  # places where a string fits into a document
    fits = ends - starts >= span
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, ends[fits] - span + 1, -1)
    inside = np.cumsum(inside[:n]) > 0
    least = np.where(inside, sliding(h, width, np.minimum)[:n], np.uint64(0))
    wide = np.concatenate([np.zeros(width - 1, dtype=np.uint64), least, np.zeros(width - 1, dtype=np.uint64)])
    at = np.flatnonzero(h == sliding(wide, width, np.maximum)[:len(h)])
    return at, h[at]


def slices(batches, span: int):
    """(data, starts, ends, number of the document, before, rows) of bounded pieces of text.

    A text longer than ``STEP`` comes in pieces that overlap by span - 1 bytes;
    ``data`` holds the bytes around a piece as well, which starts and ends leave out.
    """
    for batch in batches:
        doc, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        lengths = np.array([len(x.as_buffer()) for x in batch.column(2)], dtype=np.int64)
        held, total = [], 0
        for i in [*np.flatnonzero(lengths >= span).tolist(), -1]:
            if held and (i < 0 or total + lengths[i] > STEP):
                texts = [batch.column(2)[j].as_buffer() for j in held]
                size = lengths[held]
                ends = np.cumsum(size)
                yield np.frombuffer(b"".join(texts), dtype=np.uint8), ends - size, ends, np.zeros(len(held), dtype=np.int64), doc[held], own[held]
                held, total = [], 0
            if i < 0:
                break
            if lengths[i] <= STEP:
                held.append(i)
                total += lengths[i]
                continue
            whole = np.frombuffer(batch.column(2)[i].as_buffer(), dtype=np.uint8)
            for a in range(0, len(whole) - span + 1, STEP):
                b = min(len(whole), a + STEP + span - 1)
                yield whole[a:b], np.array([0]), np.array([b - a]), np.array([a]), doc[[i]], own[[i]]


def repeated_anchors(texts: DataFrame, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the slots of anchors that occur in two documents or more, and of those in many runs."""
    def task(batches):
        for data, starts, ends, _, doc, _ in slices(batches, span):
            at, h = anchors(data, starts, ends, span)
            of = np.searchsorted(starts, at, side="right") - 1
            order = np.lexsort((of, h))
            h, of = h[order], of[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])][:len(h)]
            h = h[new]  # once per document
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][:len(h)])
            times = np.minimum(np.diff(np.r_[first, len(h)]), 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(times.astype(np.int64))], ["h", "n"])

    repeated = written(texts.mapInArrow(task, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "anchors")
    both = bitmap_of(repeated, "h", FILTER_BITS), bitmap_of(repeated.where(F.col("n") >= HOT), "h", FILTER_BITS)
    discard(repeated)
    return both


def shared_prefix(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row of a byte matrix shares with the one before (0 for the first)."""
    out = np.zeros(len(rows), dtype=np.uint8)
    if len(rows) > 1 and rows.shape[1]:
        other = rows[1:] != rows[:-1]
        out[1:] = np.where(other.any(axis=1), other.argmax(axis=1), rows.shape[1])
    return out


def joined_spans(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of one key (a number) made one."""
    if not len(key):
        return key, start, end
    order = np.lexsort((end, start, key))
    key, start, end = key[order], start[order], end[order]
    first = np.r_[True, key[1:] != key[:-1]]
    big = np.int64(end.max() + 1)
    group = np.cumsum(first) * big
    reach = np.maximum.accumulate(end + group)
    new = first.copy()
    new[1:] |= (start + group)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(key)] - 1
    return key[at], start[at], (reach - group)[last]


def span_batch(doc, own, start, end):
    """Joined spans of rows (doc, own), as a batch of covers."""
    pair = np.zeros(len(doc), dtype=[("d", np.int64), ("o", np.int64)])
    pair["d"], pair["o"] = doc, own
    names, key = np.unique(pair, return_inverse=True)
    key, start, end = joined_spans(key, start, end)
    return names["d"][key], names["o"][key], start, end


def runs(texts: DataFrame, bitmaps, span: int, width: int) -> DataFrame:
    """Sorted front-coded runs per bucket (bucket 0 and up) and spans that are covered already (buckets below 0).

    bucket, band, shared (bytes), rest (bytes), doc, own (longs), times (ints): the places of each suffix, flat in places (longs).
    """
    reach = span - KMER
    cut = bands(reach)
    schema = "bucket int, band int, shared binary, rest binary, doc binary, own binary, times binary, places binary"

    def task(batches):
        repeated, hot = bitmaps.value
        kept = {b: [] for b in range(len(cut))}
        count = 0

        def packed(bucket, band, shared, rest, *numbers):
            values = [[np.int32(bucket)], [np.int32(band)], [shared], [rest], *[[x.tobytes()] for x in numbers]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int32(), pa.int32(), *[pa.binary()] * 6])], names=schema_names)

        def flush():
            covered = []
            for b, (lo, hi) in enumerate(cut):
                if not kept[b]:
                    continue
                rows, doc, own, place = (np.concatenate(x) for x in zip(*kept[b]))
                kept[b].clear()
                order = np.lexsort((place, own, doc))
                text = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
                order = order[np.argsort(text[order], kind="stable")]
                rows, doc, own, place = rows[order], doc[order], own[order], place[order]
                shared = shared_prefix(rows)
                new = shared < rows.shape[1]
                new[0] = True
                least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
                later = doc > least
                first, last = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)  # places of the anchor that fit the document
                covered.append((doc[later], own[later], (place - last)[later], (place - first + span)[later]))
                stay = ~later
                rows, doc, own, place = rows[stay], doc[stay], own[stay], place[stay]
                head = np.flatnonzero(np.r_[True, (shared_prefix(rows)[1:] < rows.shape[1]) | (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])][:len(rows)])
                times = np.diff(np.r_[head, len(rows)])
                sent, first_place = rows[head], np.r_[0, np.cumsum(times)]
                core = sent[:, :span - hi + lo].astype(np.uint64) + np.uint64(1)
                odd = np.cumprod(np.full(core.shape[1], ODD, dtype=np.uint64))
                to = (mixed((core * odd).sum(axis=1, dtype=np.uint64)) % np.uint64(width)).astype(np.int64)
                for bucket in np.unique(to).tolist():
                    at = np.flatnonzero(to == bucket)
                    mine = sent[at]
                    share = shared_prefix(mine)
                    rest = mine[np.arange(mine.shape[1])[None, :] >= share[:, None]].tobytes()
                    flat = np.concatenate([place[first_place[i]:first_place[i + 1]] for i in at.tolist()])
                    yield packed(bucket * len(cut) + b, b, share.tobytes(), rest, doc[head[at]], own[head[at]], times[at].astype(np.int32), flat)
            if covered:
                d, o, s, e = span_batch(*(np.concatenate(x) for x in zip(*covered)))
                if len(d):
                    yield packed(-1 - int(d[0]) % width, -1, b"", b"", d, o, s, e)

        schema_names = [x.split()[0] for x in schema.split(", ")]
        for data, starts, ends, before, doc, own in slices(batches, span):
            at, h = anchors(data, starts, ends, span)
            some = in_bitmap(h, repeated)
            at, split = at[some], in_bitmap(h[some], hot)
            if not len(at):
                continue
            of = np.searchsorted(starts, at, side="right") - 1
            padded = np.concatenate([np.zeros(span, dtype=np.uint8), data, np.zeros(span, dtype=np.uint8)])
            for b, (lo, hi) in enumerate(cut):
                last = np.minimum(hi, at - starts[of])
                first = np.maximum(lo, at + span - ends[of])
                fits = (first <= last) & (split if b else ~split)
                if not fits.any():
                    continue
                p, o, f, l = at[fits], of[fits], first[fits], last[fits]
                # the suffix from the band's first place on, then the bytes to its left, from right to left
                column = np.r_[np.arange(-lo, span - lo), np.arange(-lo - 1, -hi - 1, -1)]
                where = p[:, None] + column[None, :]
                rows = padded[where + span]
                rows[(where < (p - l)[:, None]) | (where >= (p - f + span)[:, None])] = 0  # no string of the document reaches there
                kept[b].append((np.concatenate([rows, f[:, None].astype(np.uint8), l[:, None].astype(np.uint8)], axis=1), doc[o], own[o], p - starts[o] + before[o]))
                count += len(p)
            if count >= RUN_ROWS:
                yield from flush()
                count = 0
        yield from flush()

    return texts.mapInArrow(task, schema)


def first_difference(a: bytes, b: bytes, start: int) -> int:
    """First place from ``start`` on at which two byte strings of one length differ; their length if none."""
    x = int.from_bytes(a[start:], "big") ^ int.from_bytes(b[start:], "big")
    return len(a) - (x.bit_length() + 7) // 8


def merge_runs(coded: list[tuple[np.ndarray, bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, number in the run, shared prefix, rows) of the merged order of front-coded sorted runs of strings of ``size`` bytes.

    ``losers`` holds in each inner node the run that lost there and ``knows``
    the prefix its string shares with the last string put out.
    """
    k = len(coded)
    total = sum(len(shared) for shared, _ in coded)
    out_run, out_at, out_shared = np.empty(total, dtype=np.int64), np.empty(total, dtype=np.int64), np.empty(total, dtype=np.uint8)
    out = bytearray()
    shares = [shared.tolist() for shared, _ in coded]
    at, read = [0] * k, [0] * k
    text: list[bytes | None] = [None] * k

    def advance(i):
        """The run's next string, from its front code; the prefix shared with the one before."""
        j = at[i]
        if j == len(shares[i]):
            text[i] = None
            return -1
        share = shares[i][j]
        end = read[i] + size - share
        text[i] = (text[i][:share] if share else b"") + coded[i][1][read[i]:end]
        read[i] = end
        at[i] = j + 1
        return share

    def play(a, known_a, b, known_b):
        """(winner, its known prefix, loser, its known prefix); a run that has ended loses."""
        if text[a] is None or text[b] is None:
            return (b, known_b, a, known_a) if text[a] is None else (a, known_a, b, known_b)
        if known_a != known_b:
            return (a, known_a, b, known_b) if known_a > known_b else (b, known_b, a, known_a)
        x, y = text[a], text[b]
        d = first_difference(x, y, known_a)
        if d == size:
            return (a, known_a, b, size) if a < b else (b, known_b, a, size)
        return (a, known_a, b, d) if x[d] < y[d] else (b, known_b, a, d)

    losers, knows = [0] * k, [0] * k

    def build(node):
        if node >= k:
            advance(node - k)
            return node - k, 0
        a, known_a = build(2 * node)
        b, known_b = build(2 * node + 1)
        winner, known, losers[node], knows[node] = play(a, known_a, b, known_b)
        return winner, known

    winner, known = build(1) if k > 1 else (0, max(advance(0), 0))
    for n in range(total):
        out_run[n], out_at[n], out_shared[n] = winner, at[winner] - 1, known
        out += text[winner]
        known = advance(winner)
        node = (winner + k) >> 1
        while node:
            winner, known, losers[node], knows[node] = play(winner, known, losers[node], knows[node])
            node >>= 1
    return out_run, out_at, out_shared, np.frombuffer(bytes(out), dtype=np.uint8).reshape(total, size)


def covered_places(rows: np.ndarray, shared: np.ndarray, doc: np.ndarray, span: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) place of the anchor at which each row's string is in a smaller document; least > greatest where none."""
    n = len(rows)
    least, greatest = np.full(n, hi + 1, dtype=np.int64), np.full(n, lo - 1, dtype=np.int64)
    left = np.ascontiguousarray(rows[:, span:span + hi - lo])
    order = np.argsort(left.view(f"S{hi - lo}").ravel(), kind="stable") if hi > lo else np.arange(n)
    left_shared = shared_prefix(left[order])
    first, last = rows[:, -2], rows[:, -1]
    for j in range(lo, hi + 1):
        e = j - lo
        right_group = np.cumsum(shared < span - e)
        left_group = np.empty(n, dtype=np.int64)
        left_group[order] = np.cumsum(left_shared < e)
        valid = np.flatnonzero((first <= j) & (j <= last))
        if len(valid) < 2:
            continue
        key = right_group[valid] * (n + 1) + left_group[valid]
        by = np.argsort(key, kind="stable")
        key = key[by]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        low = np.minimum.reduceat(doc[valid][by], start)
        low = np.repeat(low, np.diff(np.r_[start, len(key)]))
        hit = valid[by[doc[valid][by] > low]]
        least[hit] = np.minimum(least[hit], j)
        greatest[hit] = j
    return least, greatest


def covers(run_table: DataFrame, span: int, partitions: int) -> DataFrame:
    """(doc, own, start, end) covered by strings of smaller documents."""
    cut = bands(span - KMER)

    def solved(group):
        (lo, hi) = cut[group[0]["band"]]
        size = span + hi - lo + 2
        coded = [(np.frombuffer(r["shared"], dtype=np.uint8), r["rest"]) for r in group]
        run, at, shared, rows = merge_runs(coded, size)
        base = np.cumsum([0, *[len(s) for s, _ in coded]])
        item = base[run] + at
        doc, own, times = (np.concatenate([np.frombuffer(r[c], dtype=t) for r in group]) for c, t in (("doc", np.int64), ("own", np.int64), ("times", np.int32)))
        places = np.concatenate([np.frombuffer(r["places"], dtype=np.int64) for r in group])
        least, greatest = covered_places(rows, shared, doc[item], span, lo, hi)
        hit = least <= greatest
        item, least, greatest = item[hit], least[hit], greatest[hit]
        many = times[item]
        offset = (np.cumsum(times) - times)[item]
        flat = np.repeat(offset, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        place = places[flat]
        return np.repeat(doc[item], many), np.repeat(own[item], many), place - np.repeat(greatest, many), place - np.repeat(least, many) + span

    def batch_of(parts):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in span_batch(*(np.concatenate(p) for p in zip(*parts)))], ["doc", "own", "start", "end"])

    def task(batches):
        group, parts, rows = [], [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] < 0:
                    parts.append(tuple(np.frombuffer(r[c], dtype=np.int64) for c in ("doc", "own", "times", "places")))
                    rows += len(parts[-1][0])
                else:
                    if group and group[0]["bucket"] != r["bucket"]:
                        parts.append(solved(group))
                        rows += len(parts[-1][0])
                        group = []
                    group.append(r)
                if rows > 500_000:
                    yield batch_of(parts)
                    parts, rows = [], 0
        if group:
            parts.append(solved(group))
        if parts:
            yield batch_of(parts)

    return run_table.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(task, "doc long, own long, start long, end long")


def repeated_passages(docs: DataFrame, doc: str = "doc_id", text: str = "text", span: int = 50) -> DataFrame:
    """``docs`` with ``spans`` (array of start, end in bytes: the removed runs) and ``kept`` (binary: the bytes that stay)."""
    need(docs, doc, text)
    if not KMER < span < 256:
        raise ValueError(f"span must be more than {KMER} and less than 256")
    width = shuffle_width(docs.sparkSession)
    body = text_or_empty(text)
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.coalesce(F.col(doc).cast("long"), F.lit(LAST)).alias("__doc"),
                       body.cast("binary").alias("__bytes"), F.xxhash64(body).alias("__own"), F.xxhash64(F.lit(1), body).alias("__own2"))
    # later copies of a whole text: all their bytes are in the first one
    whole = rows.where(F.octet_length("__bytes") >= span).select("__doc", "__own", "__own2")
    first = whole.groupBy("__own", "__own2").agg(F.min("__doc").alias("__first"), F.max("__doc").alias("__last")).where("__first < __last")
    copies = written(whole.join(first.drop("__last"), ["__own", "__own2"]).where("__doc > __first").select("__doc", "__own").distinct(), "copies")
    texts = rows.join(copies, ["__doc", "__own"], "left_anti").where(F.octet_length("__bytes") >= span).select("__doc", "__own", "__bytes")
    bitmaps = docs.sparkSession.sparkContext.broadcast(repeated_anchors(texts, span))
    found = covers(runs(texts, bitmaps, span, width), span, width)
    of_text = written(found.groupBy("doc", "own").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__found")), "covers")
    whole_copy = copies.withColumn("__copy", F.lit(True))

    @F.pandas_udf("spans array<struct<start:long,end:long>>, kept binary")
    def cut(body: pd.Series, found: pd.Series, copy: pd.Series) -> pd.DataFrame:
        spans, kept = [], []
        for data, f, c in zip(body, found, copy):
            if c:
                spans.append([{"start": 0, "end": len(data)}])
                kept.append(b"")
            elif f is None or not len(f):
                spans.append([])
                kept.append(data)
            else:
                a, b = np.array([x["start"] for x in f], dtype=np.int64), np.array([x["end"] for x in f], dtype=np.int64)
                _, a, b = joined_spans(np.zeros(len(a), dtype=np.int64), a, b)
                spans.append([{"start": s, "end": e} for s, e in zip(a.tolist(), b.tolist())])
                kept.append(b"".join(data[s:e] for s, e in zip([0, *b.tolist()], [*a.tolist(), len(data)])))
        return pd.DataFrame({"spans": spans, "kept": kept})

    out = (rows.join(of_text, (F.col("__doc") == F.col("doc")) & (F.col("__own") == F.col("own")), "left")
           .join(whole_copy, ["__doc", "__own"], "left")
           .withColumn("__cut", cut("__bytes", "__found", F.coalesce("__copy", F.lit(False)))))
    keep = [c for c in docs.columns if c not in ("spans", "kept")]
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in keep], F.col("__cut.spans").alias("spans"), F.col("__cut.kept").alias("kept"))
