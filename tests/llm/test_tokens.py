"""Encoding, decoding, counting and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from offerlab.llm import bpe, packing, token_counts
from offerlab.llm.vocab import merge

WORDS, BYTES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def hard_texts():
    rng = random.Random(1)
    letters = "theinganosr"
    return [None, "", "  \n", "<|endoftext|>hi<|startoftext|>  there", "ΑΣ ΑΣΑ İx", "é ́a\x1cb\x1fc d", "don't I'LL '''s 1234 ½ ٣", "日本語テキスト 👩‍👩‍👧 à̖",
            "x" * 5000, "ab" * 3000 + "c", "".join(rng.choice(letters) for _ in range(9000)), "a   b\n\n c  \t", "it's <|endoftext|",
            " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(800))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "own") for i, t in enumerate(hard_texts())] + [(None, "no id", "own"), (3, "again", "own"), (3, "again", "own")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")  # ids: a clashing name


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encode_and_decode(docs, path):
    t = library(path)
    rows = bpe.decode_ids(bpe.encode_texts(docs, path), path).collect()
    both = bpe.transcode(docs, path)
    assert sorted(map(repr, both.select(*docs.columns, "ids", "decoded").collect())) == sorted(repr(r) for r in bpe.decode_ids(bpe.encode_texts(docs, path), path).select(*docs.columns, "ids", "decoded").collect())
    assert len(rows) == docs.count()
    for r in rows:
        want = t.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.decoded == t.decode(want, skip_special_tokens=False)


def test_stream_keeps_a_bounded_window_and_equals_a_whole_merge():
    e = bpe.Encoder(bpe.read_vocabulary(WORDS))
    rng = random.Random(3)
    for letters in ("ab", "theinganosr", "aaab", "lov"):
        text = "".join(rng.choice(letters) for _ in range(3 * e.window + 17))
        symbols = e.vocab.symbols(text)
        assert list(e.stream(iter(symbols))) == merge(symbols, e.vocab.rank, e.vocab.made)


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_new_words_are_merged_side_by_side(path, monkeypatch):
    """All short plain words of a stretch of texts go through the merges together, with the ids that the library gives."""
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdefghiXYZ     123.,!'\n\t\x85\x1céßñ") for _ in range(rng.randrange(300))) for _ in range(800)]
    odd = ["", " ", "漢字 Σς ﬁ e\u0301 \u1e9e", "<|endoftext|>x<|startoftext|>", "a" * 3000 + " " + "é" * 64 + " " + "b" * 65, "don't  stop\n\n now", "😀 x😀y"]
    e = bpe.Encoder(bpe.read_vocabulary(path))
    t = library(path)
    want = [np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts + odd]
    monkeypatch.setattr(bpe, "KEPT_WORDS", 500)  # words are forgotten and learned again
    monkeypatch.setattr(bpe, "TOGETHER", 5_000)
    assert e.encode_all(texts + odd) == want and e.encode_all(odd + texts[::-1]) == want[800:] + want[:800][::-1]
    assert all(len(x) <= 64 for x in e.kept) and e.encode_all([]) == []
    e.forget()

    def never(*_):
        raise AssertionError("a word was merged by itself")

    monkeypatch.setattr(bpe, "merge", never)
    assert e.encode_all(texts) == want[:800]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_a_worker_holds_one_copy_of_the_vocabulary(path):
    """The library's steps are kept without its tokens and merges, and cut texts as the whole library does."""
    v, t = bpe.Vocab(bpe.read_vocabulary(path)), library(path)
    assert v.library.get_vocab_size() == 0
    for text in filter(None, hard_texts()):
        part = t.normalizer.normalize_str(text) if t.normalizer else text
        assert v.normal(text) == part or v.words and v.normal(text).split() == part.split()
        assert v.library.pre_tokenizer.pre_tokenize_str(part) == t.pre_tokenizer.pre_tokenize_str(part)


def test_words_are_looked_up_once_among_the_kept():
    """A stretch's words are compared with the kept ones once; only the new ones are looked at again."""
    class Runs(set):
        walks = 0

        def difference(self, *others):
            Runs.walks += 1
            return set(self).difference(*others)

    e = bpe.Encoder(bpe.read_vocabulary(WORDS))
    words = ["known", "word", "x1-y", "don't", "日本語", "z" * 90]
    for runs in (words, [*words, "new", "n3w"]):
        Runs.walks = 0
        assert e.learn(Runs(runs)) == ["z" * 90] and Runs.walks == 1
        assert {x: e.kept[x] for x in runs} == {x: np.array(library(WORDS).encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in runs}
        del e.kept["z" * 90]


def test_sufficient_lookahead_holds_for_prefixes():
    e = bpe.Encoder(bpe.read_vocabulary(WORDS))
    rng = random.Random(4)
    text = "".join(rng.choice("theinganosr") for _ in range(e.lookahead + 300))
    symbols = e.vocab.symbols(text + "x")[:-1]
    whole = merge(symbols, e.vocab.rank, e.vocab.made)
    ends = np.cumsum([e.length[x] for x in whole])
    for cut in (e.lookahead + 10, e.lookahead + 120):
        part = merge(symbols[:cut], e.vocab.rank, e.vocab.made)
        stable = int((np.cumsum([e.length[x] for x in part]) <= cut - e.lookahead).sum())
        assert part[:stable] == whole[:stable]
        assert ends[:stable].tolist() == np.cumsum([e.length[x] for x in part])[:stable].tolist()


def test_decoder_machine_replaces_broken_bytes():
    d = bpe.Decoder(bpe.read_vocabulary(BYTES))
    t = library(BYTES)
    ids = [t.token_to_id(x) for x in ("ð", "Ł", "ĺ", "Ģ")] + t.encode("é").ids + [t.token_to_id("ð")]
    assert d.decode(np.array(ids, "<u4").tobytes(), step=1) == t.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_counts(docs, path):
    t = library(path)
    for r in token_counts.token_counts(docs, path, 10).collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 10)


def test_whole_tokens_are_proven():
    content = bpe.read_vocabulary(BYTES)
    v = token_counts.Vocab(content)
    whole, t = token_counts.proven_whole(v), library(BYTES)
    for x in random.Random(2).sample(sorted(whole), 300):
        assert len(t.encode(x, add_special_tokens=False).ids) == 1


def first_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        for i, b in enumerate(bins):
            if b + n <= capacity:
                bins[i] += n
                break
        else:
            bins.append(n)
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0 if seed % 2 else 1, [60, 100, 35, 50, 10, 100][seed], 400)
    b, o = packing.best_two_fit(lengths, 100)
    for x in np.unique(b):
        at = np.flatnonzero((b == x) & (lengths > 0))
        at = at[np.argsort(o[at])]
        assert lengths[at].sum() <= 100 and o[at].tolist() == (np.cumsum(lengths[at]) - lengths[at]).tolist()
    assert len(np.unique(b)) <= first_fit(lengths.tolist(), 100) + 1


def test_best_two_fit_replaces_the_smallest():
    # greedy fills 6+3 and leaves 1; 2+2 instead of 3 fill it
    b, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert len(set(b[[0, 2, 3]])) == 1 and b[1] != b[0]


def test_too_long_a_piece_raises():
    with pytest.raises(ValueError):
        packing.best_two_fit(np.array([11]), 10)


def test_pack_documents(spark, docs):
    t = library(WORDS)
    got = packing.pack_documents(docs, WORDS, capacity=256).toPandas()
    by_id = got[got.doc_id.notna() & (got.doc_id != 3)]
    for i, text in enumerate(hard_texts()):
        if i == 3:
            continue
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        p = by_id[by_id.doc_id == i].sort_values("piece")
        assert p.piece.tolist() == list(range(-(-len(ids) // 256)))
        assert [zlib.crc32(ids[s:s + n].tobytes()) for s, n in zip(p.start, p.length)] == p.ids_crc32.tolist() and p.length.sum() == len(ids)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 256 and (g.offset == g.length.cumsum() - g.length).all()
    assert (got.doc_id == 3).sum() == 3  # repeated rows are packed one by one
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


def test_queries(spark, sf_small):
    from offerlab.llm.queries import QUERIES

    t = library(WORDS)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    for r in QUERIES["op2_bpe"](spark, sf_small).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
