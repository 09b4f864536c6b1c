"""Byte-pair vocabularies of tokenizers' JSON files and their pre-tokens.

Reads two kinds of file and refuses all others: byte-level ones (text split
by the byte-level pattern) and word ones (text composed, lower-cased, white
space dropped, last symbol of a word marked ``</w>``).
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex
from tokenizers import Tokenizer

# The byte-level pattern, and the white space of Unicode
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NOT_WHITE = regex.compile(f"[^{WHITE_SPACE}]+")
#: str.split() also cuts at these, which are no white space in Unicode
EXTRA_SPLIT = regex.compile(r"[\x1c-\x1f]")
#: Letters whose class or lower case may differ between Unicode versions are left to the library's own steps
RARE = regex.compile(r"[^\x00-\u024f\u2010-\u2027]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(others)) for b in range(256)]


LETTERS = byte_letters()
BYTE_OF = {c: b for b, c in enumerate(LETTERS)}


def spaced(text: str) -> list[str]:
    """The runs of text between white space."""
    return NOT_WHITE.findall(text) if EXTRA_SPLIT.search(text) else text.split()


def composed_lower(text: str) -> str:
    """NFC, then each character lower-cased by itself (so a final capital sigma stays an inner one)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Vocab:
    """One vocabulary: ids by symbol, merges by pair of ids, pre-tokens, special strings."""

    def __init__(self, content: str):
        j = json.loads(content)
        model, pre = j["model"], j["pre_tokenizer"] or {}
        #: the library's normalizer and pre-tokenizer; its own copy of tokens and merges would take most of a worker's vocabulary
        self.library = Tokenizer.from_str(json.dumps({**j, "added_tokens": [], "model": {**model, "vocab": {}, "merges": []}}))
        self.suffix = model.get("end_of_word_suffix") or ""
        steps = [x["type"] for x in (j["normalizer"] or {}).get("normalizers", [])]
        self.words = bool(self.suffix)
        known = (model["type"] == "BPE" and not model.get("byte_fallback") and not model.get("ignore_merges") and not model.get("dropout")
                 and not model.get("continuing_subword_prefix") and (
                     steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]
                     and pre["pretokenizers"][0]["behavior"] == "Removed" and pre["pretokenizers"][0]["invert"]
                     if self.words else not j["normalizer"] and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]))
        if not known or any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in j["added_tokens"]):
            raise ValueError("a kind of vocabulary that is not supported")
        self.pattern = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"] if self.words else BYTE_PATTERN)
        #: cuts plain words, one a line, in one go: no pre-token of a word vocabulary holds white space
        self.lined = regex.compile(f"{self.pattern.pattern}|\n")
        self.ids: dict[str, int] = model["vocab"]
        self.byte_ids = [self.ids[c] for c in LETTERS]
        self.end_ids = {self.ids[c]: self.ids[c + self.suffix] for c in LETTERS} if self.suffix else {}
        self.special = {x["content"]: x["id"] for x in j["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = t
        self.byte_level_decoder = bool(j["decoder"])
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs]
        #: (left << 20 | right) -> rank; the merged id by rank
        self.rank = {a << 20 | b: r for r, (a, b, _) in enumerate(self.merges)}
        self.made = [c for _, _, c in self.merges]
        born = {c: r for r, (_, _, c) in enumerate(self.merges)}
        if len(born) != len(self.merges) or any(max(born.get(a, -1), born.get(b, -1)) >= r for r, (a, b, _) in enumerate(self.merges)):
            raise ValueError("a merge list in which a merge comes before its parts")

    def normal(self, part: str) -> str:
        """A part without special strings as the pre-tokenizer sees it."""
        if not self.words:
            return part
        return self.library.normalizer.normalize_str(part) if RARE.search(part) else composed_lower(part)

    def pieces(self, part: str) -> list[str]:
        """The pre-tokens of a normal part."""
        if RARE.search(part):
            return [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return self.pattern.findall(part)

    def symbols(self, pre_token: str) -> list[int]:
        """The ids of a pre-token's bytes; the last one with the word end."""
        of = self.byte_ids
        out = [of[b] for b in pre_token.encode("utf-8", "surrogatepass")]
        if out and self.suffix:
            out[-1] = self.end_ids[out[-1]]
        return out

    def parts(self, text: str):
        """(is special, part) in order; special strings are found in the raw text."""
        if not self.special_cut or not self.special_cut.search(text):
            return [(False, text)] if text else []
        return [(x in self.special, x) for x in self.special_cut.split(text) if x]


NEVER = 1 << 60


def merge(symbols: list[int], rank: dict[int, int], made: list[int]) -> list[int]:
    """Byte-pair merges of one piece: lowest rank first, leftmost first."""
    s = list(symbols)
    get = rank.get
    ranks = [get(a << 20 | b, NEVER) for a, b in zip(s, s[1:])]
    while ranks:
        best = min(ranks)
        if best == NEVER:
            break
        i = ranks.index(best)
        s[i:i + 2] = [made[best]]
        del ranks[i]
        if i:
            ranks[i - 1] = get(s[i - 1] << 20 | s[i], NEVER)
        if i < len(ranks):
            ranks[i] = get(s[i] << 20 | s[i + 1], NEVER)
    return s


#: Ids of a block of words, padded to like size, that ``PairTable.merge_all`` works on at once.
BLOCK_IDS = 1 << 16


class PairTable:
    """The merge list as an open hash table in arrays, and the merges of many words side by side."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.bits = max(4, (4 * len(merges)).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.made = np.array([c for _, _, c in merges], dtype=np.int64)
        keys = np.array([a << 20 | b for a, b, _ in merges], dtype=np.int64)
        self.key, self.rank = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, NEVER, dtype=np.int64)
        left, slot = np.arange(len(keys)), self.slots(keys)
        self.probes = 0
        while len(left):  # a step along the table for all that found their slot taken
            self.probes += 1
            free = self.key[slot] < 0
            self.key[slot[free]] = keys[left[free]]  # of those that meet, one stays
            mine = self.key[slot] == keys[left]
            self.rank[slot[mine]] = left[mine]
            left, slot = left[~mine], (slot[~mine] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; ``NEVER`` where there is no merge, or an id is below 0."""
        keys = left << 20 | right
        keys = np.where((left < 0) | (right < 0), np.int64(-2), keys)
        slot = self.slots(keys)
        out = np.where(self.key[slot] == keys, self.rank[slot], NEVER)
        open_ = np.flatnonzero((self.key[slot] != keys) & (self.key[slot] >= 0) & (keys >= 0))
        slot = slot[open_]
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot = (slot + 1) & self.mask
            met, hit = self.key[slot], self.key[slot] == keys[open_]
            out[open_[hit]] = self.rank[slot[hit]]
            stay = ~hit & (met >= 0)
            open_, slot = open_[stay], slot[stay]
        return out

    def merge_all(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words after all merges, as ``merge`` does them one by one; words lie one after another.

        A step does one merge, the lowest and leftmost, in each word that has one left.
        """
        order = np.argsort(sizes, kind="stable")  # words of like size share a block
        starts = np.cumsum(sizes) - sizes
        words: list[np.ndarray] = []
        out_sizes = np.zeros(len(sizes), dtype=np.int64)
        w = 0
        while w < len(order):
            width = int(sizes[order[min(w + BLOCK_IDS // 8, len(order)) - 1]])
            pick = order[w:w + max(1, BLOCK_IDS // max(8, width))]
            w += len(pick)
            n, width = len(pick), int(sizes[pick].max())
            place = np.arange(width)
            inside = place < sizes[pick][:, None]
            ids = np.full((n, width + 1), -1, dtype=np.int64)
            ids[:, :width][inside] = symbols[(starts[pick][:, None] + place)[inside]]
            done = ids.copy()
            ranks = np.full((n, width + 1), NEVER, dtype=np.int64)
            ranks[:, :width - 1] = self.ranks(ids[:, :width - 1].ravel(), ids[:, 1:width].ravel()).reshape(n, width - 1)
            row = np.arange(n)  # where each word that is still open stands in ``done``
            while len(row):
                at = ranks.argmin(axis=1)
                each = np.arange(len(row))
                best = ranks[each, at]
                live = best < NEVER
                if not live.all():
                    done[row[~live], :ids.shape[1]] = ids[~live]
                    done[row[~live], ids.shape[1]:] = -1
                    ids, ranks, row, at, best = ids[live], ranks[live], row[live], at[live], best[live]
                    if not len(row):
                        break
                    each = np.arange(len(row))
                # the merged id takes the left place, what follows moves up by one
                after = np.arange(ids.shape[1] - 1) > at[:, None]
                ids[each, at] = self.made[best]
                ids = np.where(after, ids[:, 1:], ids[:, :-1])
                ranks = np.where(after, ranks[:, 1:], ranks[:, :-1])
                ends = np.concatenate([ids, np.full((len(row), 1), -1, dtype=np.int64)], axis=1)
                mine, right = ends[each, at], ends[each, at + 1]
                left = np.where(at > 0, ends[each, np.maximum(at - 1, 0)], -1)
                ranks[each, at] = self.ranks(mine, right)
                some = np.flatnonzero(at > 0)
                ranks[some, at[some] - 1] = self.ranks(left[some], mine[some])
            kept = done >= 0
            out_sizes[pick] = kept.sum(axis=1)
            words.append(done[kept])
        # back in the words' order
        flat = np.concatenate(words) if words else np.zeros(0, dtype=np.int64)
        from_ = np.zeros(len(sizes), dtype=np.int64)
        from_[order] = np.cumsum(out_sizes[order]) - out_sizes[order]
        at = np.arange(out_sizes.sum()) + np.repeat(from_ - np.cumsum(out_sizes) + out_sizes, out_sizes)
        return flat[at], out_sizes
