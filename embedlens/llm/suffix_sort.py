"""Deep-shallow sorting of suffixes: multikey quicksort to a shallow depth, blind tries below it.

A suffix is given by its first bytes, in a matrix padded with zeros, and by its length. The shallow part splits
suffixes three ways by a pivot, eight bytes at a time. Suffixes that still agree at ``SHALLOW`` bytes have a long common
prefix; each such group goes into a blind trie, which branches on single bytes, is searched without looking at the
bytes between branches, and compares one whole string per insertion.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 24
SMALL = 48


class _Node:
    __slots__ = ("depth", "kids")

    def __init__(self, depth: int):
        self.depth, self.kids = depth, {}


def _lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n if not differ else n - (differ.bit_length() + 7) // 8


def _branch(text: bytes, depth: int) -> int:
    return text[depth] if depth < len(text) else -1


def blind_trie_order(texts: list[bytes]) -> list[int]:
    """Positions of ``texts`` in sorted order; a text that is another's prefix comes first, equal texts stay in order."""
    root: object = [0]  # a leaf is the list of the positions of one text
    for i in range(1, len(texts)):
        text, node = texts[i], root
        while isinstance(node, _Node):
            node = node.kids.get(_branch(text, node.depth)) or next(iter(node.kids.values()))
        other = texts[node[0]]
        if text == other:
            node.append(i)
            continue
        same = _lcp(text, other)
        above, node = None, root
        while isinstance(node, _Node) and node.depth < same:
            above, node = node, node.kids[_branch(text, node.depth)]
        if isinstance(node, _Node) and node.depth == same:
            node.kids[_branch(text, same)] = [i]
            continue
        split = _Node(same)
        split.kids = {_branch(other, same): node, _branch(text, same): [i]}
        if above is None:
            root = split
        else:
            above.kids[_branch(text, above.depth)] = split
    out: list[int] = []
    open_ = [root]
    while open_:
        node = open_.pop()
        if isinstance(node, _Node):
            open_ += [node.kids[c] for c in sorted(node.kids, reverse=True)]
        else:
            out += node
    return out


def deep_shallow_order(rows: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The sorted order of the rows of a byte matrix, each of its own length."""
    n, width = rows.shape
    words = np.zeros((n, -(-max(width, SHALLOW) // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order = np.arange(n)
    deep: list[tuple[int, int]] = []
    todo = [(0, n, 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2:
            continue
        if depth * 8 >= SHALLOW:
            deep.append((lo, hi))
            continue
        own = order[lo:hi]
        key = words[own, depth]
        if hi - lo <= SMALL:
            place = np.argsort(key, kind="stable")
            order[lo:hi], key = own[place], key[place]
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), hi - lo]
            todo += [(lo + a, lo + b, depth + 1) for a, b in zip(cuts, cuts[1:]) if b - a > 1]
            continue
        pivot = np.sort(key[:: max(1, len(key) // 9)])[4]
        less, more = key < pivot, key > pivot
        a, b = lo + int(less.sum()), hi - int(more.sum())
        order[lo:hi] = np.concatenate([own[less], own[~(less | more)], own[more]])
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    raw, stride = np.ascontiguousarray(rows).tobytes(), width
    for lo, hi in deep:
        own = order[lo:hi].tolist()
        texts = [raw[i * stride : i * stride + lens[i]] for i in own]
        order[lo:hi] = [own[i] for i in blind_trie_order(texts)]
    return order


def neighbour_lcp(rows: np.ndarray, lens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, by place; the first has -1."""
    out = np.full(len(order), -1, np.int64)
    for at in range(1, len(order), 65536):
        a, b = order[at - 1 : at + 65535][: len(order) - at], order[at : at + 65536]
        differ = rows[a] != rows[b]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[at : at + len(b)] = np.minimum(first, np.minimum(lens[a], lens[b]))
    return out
