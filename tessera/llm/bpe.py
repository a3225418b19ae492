"""BPE encoding and decoding with a pair occurrence index.

A task gathers the new words of its batch, writes their symbols into one linked list and maps every adjacent
pair to all its positions there.  Ranks that occur are applied in ascending order: all positions of the lowest rank
are merged at once, and only the lists of the pairs left and right of a merge change.  Words are then numbers,
and a text is its words' ids one after the other.

The vocabulary file is a parameter.  Its layout: byte-level symbols, a suffix on the last symbol of a word, normalization to NFC,
one space for white space, lower case, and a split by a pattern whose matches are the words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare

#: Pieces of text that a worker remembers in each of two generations, and characters of them, their ids and tokens.  When the young one is full, it
#: takes the place of the old one, out of which only those seen again come back; this changes no result.
MEMORY, MEMORY_CHARS = 100_000, 8_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: bytes that print stand for themselves, the others follow from 256 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


#: White space by the Unicode property, which leaves out four separators that str.split() cuts at.
SPACE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
NOT_SPACE = regex.compile("[\x1c-\x1f]")


def pieces(text: str) -> list[str]:
    """What stands between white space."""
    return [p for p in SPACE.split(text) if p] if NOT_SPACE.search(text) else text.split()


#: Marks that are words of their own after a letter.
MARKS = frozenset(".,;:!?|")


class Bpe:
    """A vocabulary with its ranks; encodes batches of words and decodes ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: by rank: left id, right id, id of the merged symbol
        self.merges = [(self.ids[x], self.ids[y], self.ids[x + y]) for x, y in merges]
        #: rank by left id << 20 | right id; the lowest where a pair is listed twice
        self.rank_of: dict[int, int] = {}
        for k, (x, y, _) in enumerate(self.merges):
            self.rank_of.setdefault(x << 20 | y, k)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        symbols = byte_symbols()
        #: symbol by byte, and by 256 + byte for the last one of a word
        self.symbol = np.array([self.ids[s] for s in symbols] + [self.ids[s + self.suffix] for s in symbols])
        self.first_rank = np.array([[self.rank_of.get(int(x) << 20 | int(y), -1) for y in self.symbol] for x in self.symbol], dtype=np.int32)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_of = regex.compile(pattern).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.special_entries = [(i, t) for t, i in self.special.items()]
        #: by piece, and by id for special tokens
        self.memory: dict[str | int, tuple[int, str, str]] = {}
        self.old_memory: dict[str | int, tuple[int, str, str]] = {}
        self.word_memory: dict[str, tuple[int, str, str]] = {}
        self.chars = 0

    @staticmethod
    def normalize(text: str) -> str:
        """NFC and lower case, one character at a time (a final sigma is no exception)."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def merge_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word: one pair occurrence index over all of them, kept by rank."""
        if not words:
            return []
        encoded = [w.encode("utf-8", "surrogatepass") for w in words]
        ends = np.cumsum([len(e) for e in encoded])
        code = np.frombuffer(b"".join(encoded), np.uint8).astype(np.int32)
        code[ends - 1] += 256
        starts = np.concatenate(([0], ends[:-1]))
        # every pair's positions, grouped by rank; position i is the pair of i and what follows it
        rank = self.first_rank[code[:-1], code[1:]]
        rank[ends[:-1] - 1] = -1
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[at], prepend=-1))
        active = rank[at][cuts].tolist()  # ascending, so a heap
        places = dict(zip(active, map(np.ndarray.tolist, np.split(at, cuts[1:])))) if len(at) else {}
        sym = self.symbol[code].tolist()
        n = len(sym)
        follow, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in starts.tolist():
            prev[i] = -1
        for i in ends.tolist():
            follow[i - 1] = -1
        rank_of, merges, push, pop = self.rank_of.get, self.merges, heapq.heappush, heapq.heappop
        while active:
            r = pop(active)
            a, b, merged = merges[r]
            places_of_r = places.pop(r)
            places_of_r.sort()  # left to right within a word
            for i in places_of_r:
                j = follow[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue
                sym[i], sym[j] = merged, -1
                k = follow[i] = follow[j]
                if k >= 0:
                    prev[k] = i
                    x = rank_of(merged << 20 | sym[k])
                    if x is not None:
                        if x in places:
                            places[x].append(i)
                        else:
                            places[x] = [i]
                            push(active, x)
                h = prev[i]
                if h >= 0:
                    x = rank_of(sym[h] << 20 | merged)
                    if x is not None:
                        if x in places:
                            places[x].append(h)
                        else:
                            places[x] = [h]
                            push(active, x)
        left = np.array(sym)
        ids = left[left >= 0].tolist()
        upto = np.cumsum(left >= 0)[ends - 1].tolist()
        return [ids[i:j] for i, j in zip([0, *upto], upto)]

    def words_in(self, piece: str) -> list[str]:
        """The matches of the split pattern; letters with one mark at the end, as most are, need no pattern."""
        if piece.isalpha():
            return [piece]
        if piece[:-1].isalpha() and piece[-1] in MARKS:
            return [piece[:-1], piece[-1]]
        return self.words_of(piece)

    def learn(self, new_pieces: set[str]) -> None:
        """Fill the memory for pieces of normalized text without white space."""
        known = self.word_memory
        split = {p: self.words_in(p) for p in new_pieces}
        new_words = {w for words in split.values() for w in words if w not in known}
        for w in new_words & self.old_memory.keys():  # a piece of the older generation that is one word
            if len(self.words_in(w)) == 1:
                known[w] = self.old_memory[w]
        new = [w for w in new_words if w not in known]
        tokens = self.tokens
        for w, ids in zip(new, self.merge_words(new)):
            known[w] = (len(ids), " ".join([str(i) for i in ids]), " ".join([tokens[i] for i in ids]))
        for p, words in split.items():
            got = [known[w] for w in words]
            self.memory[p] = got[0] if len(got) == 1 else (sum([g[0] for g in got]), " ".join([g[1] for g in got]), " ".join([g[2] for g in got]))
            self.chars += len(p) + len(self.memory[p][1]) + len(self.memory[p][2])

    def encode_batch(self, texts: list[str]) -> list[list[tuple[int, str, str]]]:
        """For each text its pieces as (number of ids, ids, tokens), the last two joined by spaces."""
        if len(self.memory) > MEMORY or self.chars > MEMORY_CHARS:
            keep = self.chars <= MEMORY_CHARS  # a generation of very long pieces is not kept
            self.old_memory, self.memory, self.word_memory, self.chars = self.memory if keep else {}, {}, {}, 0
        memory, old = self.memory, self.old_memory
        split: list[list[str | int]] = []
        for text in texts:
            if self.split_special is None or not any(t in text for t in self.special):
                split.append(pieces(self.normalize(text)))
                continue
            parts: list[str | int] = []
            for k, part in enumerate(self.split_special.split(text)):
                parts += [self.special[part]] if k % 2 else pieces(self.normalize(part))
            split.append(parts)
        for i, t in self.special_entries:
            memory[i] = (1, str(i), t)
        unknown = {p for parts in split for p in parts if p not in memory}
        memory |= {p: old[p] for p in unknown if p in old}
        if new := unknown - memory.keys():
            self.learn(new)
        return [[memory[p] for p in parts] for parts in split]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space; ids that the vocabulary lacks are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary, once in a worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, vocabulary: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs`` its id, n_tokens and, as asked for, ids (array<int>) and decoded, or the SHA-256 of either.

    ``vocabulary`` is a path that every executor can open.  Null and empty texts have no tokens.  No shuffle: each
    task keeps nothing but its memory of words, and whole texts of any length pass through in batches of bounded rows.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "n_tokens long, ids array<int>, decoded string"
    kinds = [pa.int64(), pa.string(), pa.string()] if digest else [pa.int64(), pa.list_(pa.int32()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            out: list[list] = [[], [], []]
            for parts in bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()]):
                filled = [p for p in parts if p[0]]
                ids, text = " ".join([p[1] for p in filled]), " ".join([p[2] for p in filled])
                out[0].append(sum([p[0] for p in filled]))
                if digest:
                    out[1].append(hashlib.sha256(ids.encode()).hexdigest())
                    out[2].append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                else:
                    out[1].append([int(i) for i in ids.split()])
                    out[2].append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds))], names=[id_col, *(f.split()[0] for f in schema.split(", "))])

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return rows.mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, {schema}")
