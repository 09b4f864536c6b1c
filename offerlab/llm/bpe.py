"""Byte-pair encoding and decoding as a bounded-lookahead streaming transducer.

Sufficient lookahead. Run the merges over a prefix and over the whole piece
side by side: the runs differ first where a merge reaches past the prefix's
end, and a difference at some place moves left only by a later merge (u, v)
whose v starts at that place, so v's left spine holds the left part of the
merge before. ``lookahead`` follows all such chains through the merge list
(each of strictly rising rank) and takes the longest in symbols: no symbol
that many places behind the read position can still change its token.

Encoding reads a piece's symbols one by one, holds at most a window of four
lookaheads, merges the window when it is full, emits the tokens that end a
lookahead before its end and keeps the rest. Memory is a constant set by the
merge list, however long the piece. Short pieces (nearly all) fit the window
at once; their ids are kept in a table of bounded size, and the new ones of a
bounded stretch of texts are merged side by side, in arrays.

Decoding feeds ids to an incremental UTF-8 machine that holds at most three
bytes of an unfinished character; bad bytes give U+FFFD.

Null texts read as empty and give no ids and an empty text; repeated rows,
ties and further columns pass through; a column of the output's name is
replaced. Special strings inside a text become their ids, as the library
does by default.
"""

from __future__ import annotations

import codecs
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from offerlab.llm.common import bounded_ranges, give_back, need, text_or_empty
from offerlab.llm.vocab import BYTE_OF, RARE, PairTable, Vocab, composed_lower, merge, spaced

#: Words whose ids a worker keeps, in each of two generations.
KEPT_WORDS = 120_000
#: Longest run of text whose ids are kept.
KEPT_CHARS = 64
#: Characters of text that ``transcode`` works on at once.
STEP = 1_000_000
#: Characters of text whose new words ``encode_all`` merges side by side.
TOGETHER = 1_000_000


def lookahead(merges: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Symbols after which a token's end can no longer change; ``length`` gives each token's symbols."""
    spine: dict[int, tuple[int, ...]] = {}
    chain: dict[int, int] = {}
    longest = 0
    for u, v, made in merges:
        reach = max((chain.get(x, 0) for x in (v, *spine.get(v, ()))), default=0)
        total = length[u] + reach
        spine[made] = (u, *spine.get(u, ()))
        chain[u] = max(chain.get(u, 0), total)
        longest = max(longest, total)
    return longest + max(length.values())


class Encoder:
    """Streaming encoder of one vocabulary; ``content`` is the JSON file's text."""

    def __init__(self, content: str):
        self.vocab = v = Vocab(content)
        length = {i: 1 for i in v.ids.values()}
        for a, b, c in v.merges:
            length[c] = length[a] + length[b]
        self.length = length
        self.pairs = PairTable(v.merges)
        self.byte_ids = np.array(v.byte_ids, dtype=np.int64)
        self.end_ids = np.zeros(max(v.byte_ids) + 1, dtype=np.int64)
        self.end_ids[list(v.end_ids)] = list(v.end_ids.values())
        self.lookahead = lookahead(v.merges, length)
        self.window = 4 * self.lookahead
        self.special_bytes = {t: np.array([i], dtype="<u4").tobytes() for t, i in v.special.items()}
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def stream(self, symbols):
        """Tokens of one piece, emitted as soon as they are stable."""
        v, held = self.vocab, []
        for s in symbols:
            held.append(s)
            if len(held) == self.window:
                done, out = 0, []
                for t in merge(held, v.rank, v.made):
                    if done + self.length[t] > self.window - self.lookahead:
                        break
                    done += self.length[t]
                    out.append(t)
                yield from out
                held = held[done:]
        yield from merge(held, v.rank, v.made)

    def forget(self) -> None:
        self.kept, self.older = {}, {}

    def _keep(self, run: str, got: bytes) -> bytes:
        if len(run) <= KEPT_CHARS:
            if len(self.kept) >= KEPT_WORDS:
                self.older, self.kept = self.kept, {}
            self.kept[run] = got
        return got

    def _run(self, run: str) -> bytes:
        """Ids of a run of normal text that no other run can change."""
        got = self.kept.get(run)
        if got is not None:
            return got
        got = self.older.get(run)
        if got is None:
            v = self.vocab
            pieces = v.pieces(run)
            if len(pieces) == 1:
                s = v.symbols(pieces[0])
                got = array("I", merge(s, v.rank, v.made) if len(s) < self.window else self.stream(s)).tobytes()
            else:
                got = b"".join([self._run(x) for x in pieces])
        return self._keep(run, got)

    def learn(self, runs: set[str]) -> list[str]:
        """Keep the ids of all ``runs``, merging the pieces of new ones side by side; returns the runs too long to stay kept."""
        v = self.vocab
        if len(self.kept) >= KEPT_WORDS:
            self.older, self.kept = self.kept, {}
        kept = self.kept
        new = runs.difference(kept)
        rare = bool(RARE.search("\n".join(new)))
        one_by_one = {x: self._run(x) for x in new if len(x) > KEPT_CHARS or rare and RARE.search(x)}
        before, kept, older = kept, self.kept, self.older  # ``_run`` may have changed them
        kept.update(one_by_one)
        if kept is before:
            new.difference_update(one_by_one)
        else:
            new = runs.difference(kept)
        if older:
            kept.update([(x, older[x]) for x in new if x in older])
            new = new.difference(older)
        # most words are letters alone, one piece; the others are cut in one go, a line each
        whole = list(filter(str.isalpha, new)) if v.words else list(new)
        rest = list(filterfalse(str.isalpha, new)) if v.words else []
        flat = v.lined.findall("\n".join(rest)) if rest else []
        line_end = np.array(list(map("\n".__eq__, flat)), dtype=bool)
        of = np.r_[np.arange(len(whole)), len(whole) + np.cumsum(line_end)[~line_end]]
        chars = np.r_[np.fromiter(map(len, whole), np.int64, len(whole)), np.fromiter(map(len, flat), np.int64, len(flat))[~line_end]]
        raw = np.frombuffer("".join(["".join(whole), *[x for x in flat if x != "\n"]]).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        first = np.r_[np.flatnonzero(raw & 0xC0 != 0x80), len(raw)]  # a character's first byte
        ends = first[np.cumsum(chars)]
        symbols = self.byte_ids[raw]
        if v.suffix:
            symbols[ends - 1] = self.end_ids[symbols[ends - 1]]
        ids, n = self.pairs.merge_all(symbols, np.diff(ends, prepend=0))
        data, ends = ids.astype("<u4").tobytes(), np.cumsum(4 * np.bincount(of, n, len(new)).astype(np.int64)).tolist()
        kept.update(zip([*whole, *rest], [data[i:j] for i, j in zip([0, *ends], ends)]))
        return [x for x in one_by_one if len(x) > KEPT_CHARS]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each text; the new words of a bounded stretch of texts are merged side by side."""
        v, out = self.vocab, []
        for i, j in bounded_ranges([len(x) for x in texts], TOGETHER):
            runs: set[str] = set()
            cut = []
            for text in texts[i:j]:
                parts = []
                for special, part in v.parts(text):
                    if not special:
                        part = v.normal(part)
                        part = spaced(part) if v.words else v.pieces(part)
                        runs.update(part)
                    parts.append((special, part))
                cut.append(parts)
            long = self.learn(runs)
            ids = self.kept.__getitem__
            out += [b"".join([self.special_bytes[part] if special else b"".join(map(ids, part)) for special, part in parts]) for parts in cut]
            for x in long:
                del self.kept[x]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        v, out = self.vocab, []
        for special, part in v.parts(text):
            if special:
                out.append(self.special_bytes[part])
                continue
            part = v.normal(part)
            runs = spaced(part) if v.words else v.pieces(part)
            get, run = self.kept.get, self._run
            out.extend([get(x) or run(x) for x in runs])
        return b"".join(out)


class Decoder:
    """Incremental byte-to-text machine over the vocabulary's token bytes."""

    def __init__(self, content: str):
        j = json.loads(content)  # the tokens only: decoding needs no merges
        ids = {**j["model"]["vocab"], **{x["content"]: x["id"] for x in j["added_tokens"]}}
        tokens = [""] * (max(ids.values()) + 1)
        for t, i in ids.items():
            tokens[i] = t
        if j["decoder"]:
            self.bytes = [bytes(BYTE_OF[c] for c in t) if all(c in BYTE_OF for c in t) else t.encode() for t in tokens]
            self.between = b""
        else:  # no decoder in the file: tokens as they are, with a space between two
            self.bytes, self.between = [t.encode() for t in tokens], b" "

    def decode(self, ids: bytes, step: int = 4096) -> str:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        all_ids = np.frombuffer(ids, dtype="<u4")
        out = []
        for i in range(0, len(all_ids), step):
            chunk = self.between.join([self.bytes[x] for x in all_ids[i:i + step].tolist()])
            out.append(machine.decode(self.between + chunk if i else chunk))
        out.append(machine.decode(b"", True))
        return "".join(out)


@lru_cache(maxsize=4)
def encoder(content: str) -> Encoder:
    made = Encoder(content)
    give_back()  # reading the file takes several times what stays
    return made


@lru_cache(maxsize=4)
def decoder(content: str) -> Decoder:
    return Decoder(content)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_texts(df: DataFrame, vocabulary: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: the text's ids as binary, little-endian unsigned 32-bit integers.

    ``vocabulary`` is the path of the file on the driver; its content (a file of fixed size) is broadcast.
    """
    need(df, text)
    content = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.pandas_udf(T.BinaryType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(content.value)
        try:
            for texts in batches:
                yield pd.Series(e.encode_all(texts.tolist()), dtype=object)
        finally:
            e.forget()  # a worker serves other stages next
            give_back()

    return df.withColumn(out, run(text_or_empty(text)))


def decode_ids(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the text of the binary ids in column ``ids`` (null: empty)."""
    need(df, ids)
    content = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.pandas_udf(T.StringType())
    def run(rows: pd.Series) -> pd.Series:
        decode = decoder(content.value).decode
        return pd.Series([decode(x or b"") for x in rows], dtype=object)

    return df.withColumn(out, run(F.col(ids)))


def transcode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``ids`` and ``decoded`` (the text of these ids) in one pass: one Python worker a task, a bounded run of text at a time."""
    need(df, text)
    content = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    rows = df.drop(ids, decoded).withColumn("__text", text_or_empty(text))
    kept = [c for c in rows.columns if c != "__text"]
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "__text"], T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])

    def run(batches):
        e, decode = encoder(content.value), decoder(content.value).decode
        try:
            for batch in batches:
                column = batch.column(len(kept))
                for i, j in bounded_ranges([len(x.as_buffer()) for x in column], STEP):
                    got = e.encode_all(column.slice(i, j - i).to_pylist())
                    part = batch.slice(i, j - i)
                    yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(kept))], pa.array(got, pa.binary()), pa.array([decode(x) for x in got], pa.string())],
                                                     names=[*kept, ids, decoded])
        finally:
            e.forget()  # a worker serves other stages next
            give_back()

    return rows.mapInArrow(run, schema)
