"""Token counts by the whole-token shortcut.

Offline, on the driver: every vocabulary string is run through the merges by
itself; the strings that come out as one token (and that the pre-tokenizer
leaves whole) are proven to count one. The proven set is part of the
vocabulary, so its broadcast is bounded by the vocabulary's size. In a task,
a text is cut into pre-tokens; those in the set count one at once, only the
rest is merged (with a table of bounded size for repeated ones).

Defined results: null text counts as empty (0 bytes, 0 tokens); special
strings inside a text count one each, as the library does by default;
repeated rows and further columns pass; columns of the output's names are
replaced.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from offerlab.llm.bpe import read_vocabulary
from offerlab.llm.common import need, text_or_empty
from offerlab.llm.vocab import BYTE_OF, Vocab, merge

KEPT_PIECES = 300_000
#: Longest piece that is merged as one; longer ones go to the streaming encoder.
LONG_PIECE = 2_000


def proven_whole(vocab: Vocab) -> frozenset[str]:
    """Vocabulary strings, as text, that encode alone as one token."""
    found = []
    for token in vocab.ids:
        body = token.removesuffix(vocab.suffix) if vocab.suffix else token
        if vocab.suffix and body == token:
            continue  # a token inside a word only
        try:
            text = bytes(BYTE_OF[c] for c in body).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        m = vocab.pattern.fullmatch(text)
        if m and vocab.pattern.match(text)[0] == text and merge(vocab.symbols(text), vocab.rank, vocab.made) == [vocab.ids[token]]:
            found.append(text)
    return frozenset(found)


class Counts:
    def __init__(self, content: str, whole: frozenset[str]):
        self.content, self.vocab, self.whole = content, Vocab(content), whole
        self.kept: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        n = self.kept.get(piece)
        if n is None:
            v = self.vocab
            if len(piece) > LONG_PIECE:
                from offerlab.llm.bpe import encoder

                return sum(1 for _ in encoder(self.content).stream(v.symbols(piece)))
            n = len(merge(v.symbols(piece), v.rank, v.made))
            if len(self.kept) >= KEPT_PIECES:
                self.kept.clear()
            if len(piece) <= 64:
                self.kept[piece] = n
        return n

    def count(self, text: str) -> int:
        v, whole, n = self.vocab, self.whole, 0
        for special, part in v.parts(text):
            if special:
                n += 1
                continue
            pieces = v.pieces(v.normal(part))
            n += len(pieces)
            for piece, times in Counter(pieces).items():
                if piece not in whole:
                    n += (self.merged(piece) - 1) * times
        return n


@lru_cache(maxsize=2)
def counts(content: str, whole: frozenset[str]) -> Counts:
    return Counts(content, whole)


def token_counts(df: DataFrame, vocabulary: str, limit: int, text: str = "text") -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    need(df, text)
    content = read_vocabulary(vocabulary)
    shared = df.sparkSession.sparkContext.broadcast((content, proven_whole(Vocab(content))))

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        count = counts(*shared.value).count
        return pd.Series([count(x) for x in texts], dtype="int64")

    t = text_or_empty(text)
    return (df.withColumn("n_bytes", F.octet_length(t).cast("long")).withColumn("n_tokens", run(t))
            .withColumn("over_limit", F.col("n_tokens") > limit))
