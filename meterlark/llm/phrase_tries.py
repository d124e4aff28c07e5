"""Count tries over the words of many texts: built per shard, serialised in order, merged by ranges of prefixes.

A shard is some texts cut into words once, each word as its number in the shard (``Numbered``); everything else starts from the numbers.

A trie has a level for the language and one for each word of a phrase, ``depth`` at most. A level is three columns in the order of
its paths (languages and words compare by their UTF-8 bytes): the parent's place in the level above, the word, and the count.

Ranges are given by paths: range r holds every node from its first path up to that of range r + 1. A node's path falls
in one range whatever its shard, and a path has up to ``depth`` words, so a frequent first word or pair is spread over as many ranges as it needs. A range
also gets the ancestors of its first path from every shard, so that a walk down finds the whole count of each node above.

A filter is a bitset of fixed size over keys, the 64-bit hashes of words and of pairs of neighbouring words. Keys are counted by ranges of equal size,
each with its own stretch of the bitset, so what a shard hands on for a range is two plain columns. A filter only leaves out what cannot be frequent;
keys that meet leave out less, never more.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

#: What ends a piece, as one byte that no UTF-8 text holds.
BREAK = b"\xff"
#: What a byte is: part of a word (0), white space (1) or the end of a piece (2).
KINDS = bytes(1 if b in b" \t" else 2 if b in b".,;:!?\n\x0b\x0c\r" else 0 for b in range(256))
#: A filter has 2 to the power of so many bits (8 MB); ranges of keys are 2 to the power of KEY_BITS at most, so that each has whole bytes of it.
FILTER_BITS, KEY_BITS = 26, 16
OF_LANG, OF_FIRST, OF_SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
Path = tuple[bytes, ...]


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts, whether each begins a piece, and how many each text has. No text is null."""
    texts.validate(full=True)  # BREAK is told from words only in proper UTF-8
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2].slice(at[0], at[-1] - at[0]).to_pybytes().lower() if at[-1] > at[0] else b""  # lower() of bytes changes A-Z alone
    at -= at[0]
    kind = np.frombuffer(data.translate(KINDS), np.uint8)
    inside, edge = kind == 0, np.zeros(len(data) + 1, bool)
    edge[at] = True
    apart = ~(inside[1:] & inside[:-1]) | edge[1:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= apart
    last[:-1] &= apart
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    offsets = np.zeros(len(first) + 1, np.int32)
    np.cumsum(last - first + 1, out=offsets[1:])
    begins = np.zeros(len(first) + 1, bool)
    begins[np.searchsorted(first, np.flatnonzero(kind == 2))] = True
    place = np.searchsorted(first, at)
    begins[place] = True
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.frombuffer(data, np.uint8)[inside])])
    return words, begins[:-1], np.diff(place)


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64)


def mixed(sums: np.ndarray) -> np.ndarray:
    """Keys from sums of hashes, each times the number of its part: OF_LANG, OF_FIRST and, for a pair, OF_SECOND."""
    sums ^= sums >> np.uint64(29)
    sums *= np.uint64(0xBF58476D1CE4E5B9)
    return sums


def passes(passing: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter has each key."""
    slots = keys >> np.uint64(64 - FILTER_BITS)
    return (passing[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def frequent_keys(keys: np.ndarray, times: np.ndarray, least: int, bits: int) -> bytes:
    """The stretch of a filter for one of 2 ** ``bits`` ranges, from the keys' 32 bits after those of the range, and how often each came in a shard."""
    both = keys.astype(np.uint64) << np.uint64(32) | times
    both.sort()
    ordered = both >> np.uint64(32)
    new = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] ^ np.uint64(1)))
    found = ordered[new][np.add.reduceat(both & np.uint64(0xFFFFFFFF), new) >= least]
    stretch = np.zeros(1 << (FILTER_BITS - bits), bool)
    stretch[found >> np.uint64(32 - FILTER_BITS + bits)] = True
    return np.packbits(stretch, bitorder="little").tobytes()


def distinct(keys: np.ndarray, below: int, places: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """The different keys in order, which of them each key is (if asked for), and how often each occurs; all keys are below ``below``."""
    if below <= 4 * len(keys) + 1024:  # few possible keys: counted in place
        often = np.bincount(keys, minlength=1)
        found = np.flatnonzero(often)
        place = (np.cumsum(often > 0) - 1)[keys] if places else None
        return found, place, often[found]
    ordered, order = in_order(keys, below) if places else (np.sort(keys), None)
    new = np.diff(ordered, prepend=-1) != 0
    at, place = np.flatnonzero(new), None
    if places:
        place = np.empty(len(keys), np.int64)
        place[order] = np.cumsum(new) - 1
    return ordered[at], place, np.diff(at, append=len(ordered))


def in_order(keys: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, and the place that each had; all are below ``below``."""
    bits = max(1, len(keys)).bit_length()
    if below <= 1 << (63 - bits):  # sorted as one number with its place, which takes a fraction of the time
        both = keys << bits
        both |= np.arange(len(keys))
        both.sort()
        ordered = both >> bits
        both &= (1 << bits) - 1
        return ordered, both
    order = np.argsort(keys, kind="stable")
    return keys[order], order


@dataclass
class Level:
    parent: np.ndarray
    word: np.ndarray  # place in the sorted words
    count: np.ndarray


@dataclass
class Trie:
    words: list[bytes]  # sorted; languages are among them
    levels: list[Level]

    def below(self, path: Path, level_keys: list[np.ndarray]) -> list[tuple[int, bool]]:
        """For each level how many of its nodes come before ``path``, and whether the last of them is an ancestor of it."""
        out, base, node, before = [], len(self.words) + 1, 0, 0  # ``node``: the place of the path's part so far, None where the trie lacks it
        for d, keys in enumerate(level_keys):
            if node is None or d >= len(path):
                at = int(np.searchsorted(keys, (before if node is None else node) * base))
                out.append((at, False))
                node, before = None, at
                continue
            rank = bisect_left(self.words, path[d])
            at = int(np.searchsorted(keys, node * base + rank))
            there = rank < len(self.words) and self.words[rank] == path[d] and at < len(keys) and keys[at] == node * base + rank
            node = at if there else None
            above = there and d + 1 < len(path)
            before = at + above
            out.append((before, above))
        return out

    def cut(self, starts: list[Path]) -> Iterator[tuple[int, bytes]]:
        """(range, part) for every range of which the trie has a node or an ancestor; ``starts`` has the first path of each range but range 0."""
        first = [(0, False)] * len(self.levels)
        keys = [x.parent * (len(self.words) + 1) + x.word for x in self.levels]  # once a trie: once a range, time would grow with nodes times ranges
        for r in range(len(starts) + 1):
            last = self.below(starts[r], keys) if r < len(starts) else [(len(x.word), False) for x in self.levels]
            spans = [(a - above, b) for (a, above), (b, _) in zip(first, last)]
            if any(b > a for a, b in spans):
                yield r, self.part(spans)
            first = last

    def part(self, spans: list[tuple[int, int]]) -> bytes:
        used = np.unique(np.concatenate([x.word[a:b] for x, (a, b) in zip(self.levels, spans)]))
        columns = [np.asarray([b - a for a, b in spans], np.uint32)]
        above = 0
        for x, (a, b) in zip(self.levels, spans):
            columns += [np.diff(x.parent[a:b] - above, prepend=0).astype(np.uint32), np.searchsorted(used, x.word[a:b]).astype(np.uint32), x.count[a:b].astype(np.uint32)]
            above = a
        text = BREAK.join(self.words[k] for k in used.tolist())
        head = np.asarray([len(self.levels), len(text)], np.uint32)
        return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + text + b"".join(c.tobytes() for c in columns))


def read_part(data: bytes) -> Trie:
    raw = zstandard.ZstdDecompressor().decompress(data)
    depth, size = np.frombuffer(raw, np.uint32, 2).tolist()
    words, at, levels = raw[8 : 8 + size].split(BREAK), 8 + size, []

    def take(n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(raw, np.uint32, n, at).astype(np.int64)
        at += 4 * n
        return found

    for n in take(depth).tolist():
        parent, word, times = take(n), take(n), take(n)
        levels.append(Level(np.cumsum(parent), word, times))
    return Trie(words, levels)


@dataclass
class Numbered:
    """The words of some texts in turn: the number of each and of its language, and whether it begins a piece."""

    words: pa.Array
    langs: list[bytes]
    ids: np.ndarray
    lang: np.ndarray
    begins: np.ndarray

    def listed(self, places: np.ndarray | None = None) -> list[bytes]:
        """The different words, or those at some places; to_pylist() takes ten times as long."""
        offsets, text = np.frombuffer(self.words.buffers()[1], np.int32, len(self.words) + 1), self.words.buffers()[2].to_pybytes()
        first, last = (offsets[:-1], offsets[1:]) if places is None else (offsets[places], offsets[places + 1])
        return [text[a:b] for a, b in zip(first.tolist(), last.tolist())]

    def packed(self) -> bytes:
        lengths = np.diff(np.frombuffer(self.words.buffers()[1], np.int32, len(self.words) + 1))
        text, langs = self.words.buffers()[2].to_pybytes()[: lengths.sum()], BREAK.join(self.langs)
        run = np.flatnonzero(np.diff(self.lang, prepend=-1))
        head = [len(lengths), len(text), len(langs), len(run), len(self.ids)]
        columns = [head, lengths, run, self.lang[run], self.ids]
        raw = b"".join([*(np.asarray(c).astype(np.uint32).tobytes() for c in columns), text, langs, np.packbits(self.begins).tobytes()])
        return zstandard.ZstdCompressor(level=1).compress(raw)

    @classmethod
    def unpacked(cls, data: bytes) -> Numbered:
        raw = zstandard.ZstdDecompressor().decompress(data)
        n, text, langs, runs, size = np.frombuffer(raw, np.uint32, 5).tolist()
        at = 20

        def take(count: int) -> np.ndarray:
            nonlocal at
            at += 4 * count
            return np.frombuffer(raw, np.int32, count, at - 4 * count)

        lengths, run, lang, ids = take(n), take(runs), take(runs), take(size)
        offsets = np.zeros(n + 1, np.int32)
        np.cumsum(lengths, out=offsets[1:])
        words = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw[at : at + text])])
        at += text
        named = raw[at : at + langs].split(BREAK)
        begins = np.unpackbits(np.frombuffer(raw, np.uint8, -1, at + langs), count=size) == 1
        return cls(words, named, ids, np.repeat(lang, np.diff(run, append=size)), begins)

    def sampled_paths(self, n: int, depth: int) -> list[bytes]:
        """The paths at ``n`` places evenly apart, joined by BREAK."""
        out = []
        for at in np.unique(np.linspace(0, len(self.ids) - 1, n).astype(np.int64)).tolist():
            ends = np.flatnonzero(self.begins[at + 1 : at + depth])
            ids = self.ids[at : at + 1 + (ends[0] if len(ends) else depth - 1)]
            out.append(BREAK.join([self.langs[self.lang[at]], *(self.words[k].as_py() for k in ids.tolist())]))
        return out

    @cached_property
    def hashed(self) -> tuple[np.ndarray, np.ndarray]:
        return word_hashes(self.langs) * OF_LANG, word_hashes(self.listed())

    def word_keys(self, places: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """The keys of the different words of each language, which of them each word in turn has (if asked for), and how often each occurs."""
        langs, words = self.hashed
        found, place, often = distinct(self.lang.astype(np.int64) * len(words) + self.ids, len(langs) * len(words), places)
        return mixed(langs[found // len(words)] + words[found % len(words)] * OF_FIRST), place, often

    def pair_keys(self) -> np.ndarray:
        """The key of each word but the last one with the word after it, whether or not that is of the same piece."""
        langs, words = self.hashed
        keys = (words * OF_FIRST)[self.ids[:-1]]
        keys += (words * OF_SECOND)[self.ids[1:]]
        keys += langs[self.lang[:-1]]
        return mixed(keys)

    def counted_keys(self, bits: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of words, then of pairs: for each of 2 ** ``bits`` ranges where it begins, the 32 bits after those of the range, and how often each key came.

        Nothing is counted beyond ``least``: sums of such counts reach it where the whole ones do.
        """
        keys, _, often = self.word_keys()
        order = np.argsort(keys)
        for ordered, many in ((keys[order], often[order]), (np.sort(self.pair_keys()[~self.begins[1:]]), None)):
            ordered >>= np.uint64(32 - bits)
            new = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] ^ np.uint64(1)))
            if len(new):
                times = np.diff(new, append=len(ordered)) if many is None else np.add.reduceat(many, new)
                kept = ordered[new]
                starts = np.searchsorted(kept, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
                yield starts, kept.astype(np.uint32), np.minimum(times, least).astype(np.uint8 if least < 256 else np.uint32)

    def trie(self, depth: int, passing: np.ndarray | None = None) -> Trie:
        """With a filter, paths begin and go on only where it has the word and the pair; the counts of languages are whole."""
        begin, may = np.ones(len(self.ids), bool), ~self.begins[1:]
        if passing is not None:
            keys, place, _ = self.word_keys(places=True)
            begin = passes(passing, keys)[place]
            del place
            may &= begin[1:] & passes(passing, self.pair_keys())
        at = np.flatnonzero(begin)
        used = np.flatnonzero(np.bincount(self.ids[at], minlength=len(self.words)))
        listed = self.listed(used)
        often = np.bincount(self.lang, minlength=len(self.langs))
        langs = sorted((x, k) for k, x in enumerate(self.langs) if often[k])
        words = sorted({*listed, *(x for x, _ in langs)})
        number = {w: k for k, w in enumerate(words)}
        rank = np.zeros(len(self.words), np.int32)
        rank[used] = np.fromiter(map(number.__getitem__, listed), np.int32, len(listed))
        ids, base = rank[self.ids], len(words) + 1
        order, node = [k for _, k in langs], np.zeros(len(self.langs), np.int64)
        node[order] = np.arange(len(order))
        node = node[self.lang[at]]
        levels = [Level(np.zeros(len(order), np.int64), np.asarray([number[x] for x, _ in langs], np.int64), often[order])]
        for d in range(1, depth + 1):
            if d > 1:  # the path goes on to the next word of the piece
                on = np.flatnonzero(at + d - 1 < len(ids))
                on = on[may[at[on] + d - 2]]
                at, node = at[on], node[on]
            found, node, times = distinct(node * base + ids[at + d - 1], len(levels[-1].word) * base, d < depth)
            levels.append(Level(found // base, found % base, times))
        return Trie(words, levels)


class Shard:
    """Texts that are numbered together."""

    def __init__(self, depth: int = 0):
        self.depth = depth
        self.clear()

    def clear(self) -> None:
        self.words: list[pa.Array] = []
        self.begins: list[np.ndarray] = []
        self.langs: list[np.ndarray] = []
        self.numbers: dict[bytes, int] = {}
        self.size = 0

    def add(self, lang: bytes, text: str) -> None:
        self.add_all(pa.array([lang.decode()]), pa.array([text]))

    def add_all(self, langs: pa.Array, texts: pa.Array) -> None:
        words, begins, each = cut_words(texts)
        known = langs.dictionary_encode()
        numbers = np.asarray([self.numbers.setdefault(x.as_py().encode(), len(self.numbers)) for x in known.dictionary], np.int32)
        self.words.append(words)
        self.begins.append(begins)
        self.langs.append(np.repeat(numbers[known.indices.to_numpy()], each))
        self.size += len(words)

    def numbered(self) -> Numbered:
        words = pa.concat_arrays(self.words).dictionary_encode()
        return Numbered(words.dictionary, list(self.numbers), words.indices.to_numpy(), np.concatenate(self.langs), np.concatenate(self.begins))

    def trie(self) -> Trie:
        return self.numbered().trie(self.depth)


def merged(parts: list[Trie]) -> Trie:
    """One trie with the sums of all: the sorted runs of each level are merged, from the top down."""
    words = sorted(set().union(*[p.words for p in parts]))
    number = {w: k for k, w in enumerate(words)}
    ranks = [np.fromiter((number[w] for w in p.words), np.int64, len(p.words)) for p in parts]
    base, levels = len(words) + 1, []
    nodes = [np.zeros(1, np.int64) for _ in parts]
    for d in range(len(parts[0].levels)):
        keys = np.concatenate([nodes[k][p.levels[d].parent] * base + ranks[k][p.levels[d].word] for k, p in enumerate(parts)])
        ordered, order = in_order(keys, (len(levels[-1].word) if levels else 1) * base)
        first = np.diff(ordered, prepend=-1) != 0
        new = np.flatnonzero(first)
        times = np.concatenate([p.levels[d].count for p in parts])[order]
        place = np.empty(len(keys), np.int64)
        place[order] = np.cumsum(first) - 1
        nodes = np.split(place, np.cumsum([len(p.levels[d].word) for p in parts])[:-1])
        found = ordered[new]
        levels.append(Level(found // base, found % base, np.add.reduceat(times, new) if len(new) else times))
    return Trie(words, levels)


def frequent_nodes(trie: Trie, least: int, start: Path | None) -> Iterator[tuple[Path, list[int]]]:
    """(path, counts from the language down) of nodes with at least ``least`` occurrences, from the top down; ancestors of ``start`` are another range's."""
    for d in range(1, len(trie.levels)):
        for at in np.flatnonzero(trie.levels[d].count >= least).tolist():
            path, counts = [], []
            for level in reversed(trie.levels[: d + 1]):
                path.append(trie.words[level.word[at]])
                counts.append(int(level.count[at]))
                at = int(level.parent[at])
            found = tuple(reversed(path))
            if start is None or not (len(found) < len(start) and start[: len(found)] == found):
                yield found, counts[::-1]
