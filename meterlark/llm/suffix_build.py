"""Column-wise construction of the suffix order of many short documents, in numpy.

Every round puts one more symbol in front of the suffixes found so far, for all documents at once: the collection's
Burrows-Wheeler column says which symbol that is, a stable sort by it gives the next order (its LF mapping), and the
common prefix of two neighbours with the same symbol is one more than the smallest common prefix between their
places in the last order. Each column (owner, Burrows-Wheeler symbol, common prefix) is read once in order and
written anew once per round, as the method does with files.

A symbol is ``width`` bytes at a byte position; a byte string is then ``width`` chains, one for each phase, and
a common prefix of ``match / width`` symbols is one of ``match`` bytes. A width of 1 is the classic form; wider
symbols need as many fewer rounds. Symbols are numbered by a 64-bit hash, and their bytes are compared; should a hash
have two meanings, they are numbered by their bytes. A symbol that occurs once ends every common prefix, so chains are cut
there, and pieces with fewer symbols than the shortest match asked for are not inserted.
"""

from __future__ import annotations

import numpy as np

from .minhash import BYTE_CODES, ODD, _powers, mixed


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of a byte string; span_hashes reads the hash of any span from them."""
    powers, _ = _powers(len(data) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[data] * powers[: len(data)], dtype=np.uint64)])


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal bytes give equal hashes wherever they stand."""
    _, inverse = _powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * ODD)


def least_between(column: np.ndarray, first: np.ndarray, last: np.ndarray, most: int) -> np.ndarray:
    """Smallest value of a column over each [first, last], for first <= last; values of ``most`` or more count as ``most``.

    Common prefixes are a few symbols long, so it is enough to count, for each length below ``most``, where the column is shorter.
    """
    out = np.zeros(len(first), np.int16)
    for depth in range(1, most + 1):
        shorter = np.zeros(len(column) + 1, np.int32)
        np.cumsum(column < depth, out=shorter[1:])
        out += shorter[last + 1] == shorter[first]
    return out


def sorted_places(symbols: np.ndarray) -> np.ndarray:
    """The places of a column in the order of their symbols, equal ones in the order they have."""
    return np.sort((symbols.astype(np.int64) << 32) | np.arange(len(symbols))) & 0xFFFFFFFF


def _windows(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(data, width)[at]


def _one_meaning(data: np.ndarray, at: np.ndarray, like: np.ndarray, width: int) -> bool:
    """Whether the ``width`` bytes at each place equal those at ``like``. Where both move on by one, one byte is compared."""
    moves_on = np.concatenate([[False], (np.diff(at) == 1) & (np.diff(like) == 1)])
    if not (data[at[moves_on] + width - 1] == data[like[moves_on] + width - 1]).all():
        return False
    rest = np.flatnonzero(~moves_on & (at != like))
    return all((_windows(data, at[rest[k : k + 8192]], width) == _windows(data, like[rest[k : k + 8192]], width)).all() for k in range(0, len(rest), 8192))


def numbered(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of the symbol at each place, and how often each symbol occurs."""
    if not len(at):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    codes = span_hashes(prefix_sums(data), at, at + width)
    order = np.argsort(codes)
    new = np.concatenate([[True], np.diff(codes[order]) != 0])
    starts = np.flatnonzero(new)
    often = np.diff(np.concatenate([starts, [len(at)]]))
    symbols = np.empty(len(at), np.int32)
    symbols[order] = np.cumsum(new, dtype=np.int32) - 1
    if not _one_meaning(data, at, at[np.minimum.reduceat(order, starts)][symbols], width):
        rows = np.ascontiguousarray(_windows(data, at, width)).view(f"S{width}" if width == 1 else f"V{width}").ravel()
        _, symbols, often = np.unique(rows, return_inverse=True, return_counts=True)
    return symbols.astype(np.int32), often


def chains(strings: list[bytes], width: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of chains of symbols that occur more than once, ``least`` or more of them: their symbols one after another, where each came
    from, first and length of each piece; and where each string's places begin."""
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    counts = np.maximum(sizes - width + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts)
    symbols, often = numbered(data, inside + np.repeat(np.cumsum(sizes) - sizes, counts), width)
    chain = np.repeat(np.arange(len(strings), dtype=np.int64) * width, counts) + inside % width
    several = np.flatnonzero(often[symbols] > 1) if len(symbols) else np.zeros(0, np.int64)
    order = several[sorted_places(chain[several])]  # by chain, then place
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(chain[order]) != 0) | (np.diff(order) != width)])) if len(order) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([starts, [len(order)]]))
    kept = length >= least
    return symbols[order], order, starts[kept], length[kept], offsets


def repeated_starts(strings: list[bytes], matches: tuple[int, ...], width: int, limits: list[int] | None = None) -> list[list[np.ndarray]]:
    """For each of ``matches`` (in bytes) and each string, which of its starts (0 to its length - match) begin a match that also starts elsewhere in the collection.

    With ``limits`` only so many starts of each string count, its other bytes are there for matches to run into.
    """
    assert all(m % width == 0 for m in matches)
    depths = [m // width for m in matches]
    most = max(depths)
    symbols, origin, first, length, offsets = chains(strings, width, min(depths))
    docs = len(first)
    owner, taken = np.arange(docs, dtype=np.int32), np.zeros(docs, np.int32)
    first, length = first.astype(np.int32), length.astype(np.int32)
    every, none, fresh = owner, taken, np.zeros(docs, np.int16)
    last = symbols[first + length - 1] if docs else np.zeros(0, np.int32)
    ahead, common = last, np.zeros(docs, np.int16)
    for _ in range(int(length.max()) if docs else 0):
        open_ = np.flatnonzero(taken < length[owner])  # those with a symbol in front
        if len(open_) == 0:
            break
        place = open_[sorted_places(ahead[open_])]
        same = ahead[place[1:]] == ahead[place[:-1]]
        new_common = np.zeros(len(place), np.int16)
        at = np.flatnonzero(same) + 1
        if len(at):
            new_common[at] = least_between(common, place[at - 1] + 1, place[at], most - 1) + 1
        who, depth = owner[place], taken[place] + 1
        rest = length[who] - depth
        owner, taken = np.concatenate([every, who]), np.concatenate([none, depth])
        ahead = np.concatenate([last, symbols[first[who] + np.maximum(rest - 1, 0)]])
        common = np.concatenate([fresh, new_common])
    where = origin[first[owner] + np.minimum(length[owner] - taken, length[owner] - 1)] if docs else np.zeros(0, np.int64)
    begins, sizes = offsets[:-1], np.diff(offsets)
    if limits is not None:
        string = np.searchsorted(offsets, where, side="right") - 1
        counting = np.flatnonzero((where - begins[string] < np.asarray(limits)[string]) & (taken > 0))
        # Between neighbours that count lies the smallest common prefix of all between them.
        between = least_between(common, counting[:-1] + 1, counting[1:], most) if len(counting) > 1 else np.zeros(0, np.int16)
        where, common = where[counting], np.concatenate([np.zeros(min(1, len(counting)), np.int16), between])
        sizes = np.minimum(sizes, np.asarray(limits, np.int64))
    out = []
    for match, depth in zip(matches, depths):
        hit = common >= depth
        hit[:-1] |= hit[1:].copy()
        flags = np.zeros(offsets[-1] + 1, bool)
        flags[where[hit]] = True
        ends = np.minimum(begins + sizes, offsets[1:] - match + width)
        out.append([flags[o : max(o, e)] for o, e in zip(begins, ends)])
    return out
