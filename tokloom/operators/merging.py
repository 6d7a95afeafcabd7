"""Symbols of many pieces as one array, and merges applied to all of them at once.

Helpers for Arrow-batched tasks: a batch's symbol strings (``|a||b|``) become one array of ids with the
number of symbols of each piece, so that no Python object is made per symbol or piece.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.constants import MAX_VOCAB

#: Rank of a pair that no merge has.
NO_RANK = np.iinfo(np.int32).max


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number per pair of ids."""
    return left.astype(np.int64) * MAX_VOCAB + right


class MergeTable:
    """Merges by pair: ``order`` of each pair among the merges, and the ``new`` id of each merge in that order."""

    def __init__(self, ranks: Mapping[tuple[int, int], tuple[int, int]]) -> None:
        """``ranks``: (left, right) -> (rank, new id)."""
        flat = np.array([(left, right, rank, new) for (left, right), (rank, new) in ranks.items()], np.int64).reshape(-1, 4)
        flat = flat[np.argsort(flat[:, 2], kind="stable")]
        key = pair_keys(flat[:, 0], flat[:, 1])
        by_key = np.argsort(key)
        self.key, self.order, self.new = key[by_key], by_key.astype(np.int32), flat[:, 3].astype(np.int32)

    def ranks(self, sym: np.ndarray, seg: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Order of the pairs that begin at the places ``at``; :data:`NO_RANK` where none does or no merge has it."""
        out = np.full(len(at), NO_RANK, np.int32)
        inside = np.flatnonzero(at < len(sym) - 1)
        inside = inside[seg[at[inside]] == seg[at[inside] + 1]]
        i = at[inside]
        key = pair_keys(sym[i], sym[i + 1])
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        found = self.key[place] == key
        out[inside[found]] = self.order[place[found]]
        return out


def every_other(at: np.ndarray) -> np.ndarray:
    """Of places that follow each other directly (overlapping pairs of one id) every other one, from the left."""
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
    if len(first) == len(at):
        return at
    nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return at[nth % 2 == 0]


def merged(sym: np.ndarray, size: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and sizes of pieces after the merges of ``table``: in every piece the lowest-ranked adjacent pair is
    merged at all its places, left to right, and so on. One step does this in all pieces; finished ones leave."""
    size = np.asarray(size, np.int64)
    if not len(sym) or not len(table.key):
        return sym, size
    sym, seg = sym.astype(np.int32), np.repeat(np.arange(len(size)), size)
    rank = table.ranks(sym, seg, np.arange(len(sym)))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(sym):
        start = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        n, best = np.diff(np.append(start, len(seg))), np.minimum.reduceat(rank, start)
        live = best < NO_RANK
        if 4 * live.sum() < 3 * len(live):
            on = np.repeat(live, n)
            done.append((sym[~on], seg[~on]))
            sym, seg, rank, n, best = sym[on], seg[on], rank[on], n[live], best[live]
        elif not live.any():
            break
        at = every_other(np.flatnonzero((rank == np.repeat(best, n)) & (rank < NO_RANK)))
        sym[at] = table.new[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, seg, rank = sym[keep], seg[keep], rank[keep]
        at = at - np.arange(len(at))
        changed = np.concatenate([at[at > 0] - 1, at])
        rank[changed] = table.ranks(sym, seg, changed)
    sym, seg = (np.concatenate(x) for x in zip(*done, (sym, seg)))
    return sym[np.argsort(seg, kind="stable")], np.bincount(seg, minlength=len(size))


@lru_cache(maxsize=1)
def _names() -> pa.Array:
    return pa.array(np.arange(MAX_VOCAB)).cast(pa.string())


def joined(sym: np.ndarray, size: np.ndarray) -> pa.Array:
    """Per piece its symbols as ``a||b||c``."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), _names().take(pa.array(sym))), "||")


def written(sym: np.ndarray, size: np.ndarray) -> pa.Array:
    """Per piece its symbol string ``|a||b||c|``."""
    return pc.binary_join_element_wise("|", joined(sym, size), "|", "")


def parsed(y: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all symbol strings end to end, and how many each has."""
    if not len(y):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    size = pc.count_substring(y, "||").to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return np.fromstring("".join(y.to_pylist()).replace("|", " ").strip(), dtype=np.int32, sep=" "), size


def of_bytes(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte symbols (byte + 1) of all pieces end to end, and how many each has."""
    size = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces.cast(pa.binary())), b"")[0].as_py()
    return np.frombuffer(text, np.uint8).astype(np.int32) + 1, size


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their numbers."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")       # goes fast over keys that are sorted in parts
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n[order], first, dtype=np.int64)
