"""Weighted acyclic automata over word sequences of bounded length.

Two forms of the same thing. A ``Tree`` has one node per sequence, level by level in sorted order, with a weight each (the
count of that sequence, 0 for a mere prefix). A stored automaton shares equal endings: nodes of a level whose outgoing arcs have
the same words, weights and targets become one state. All steps work on whole levels at once.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


@dataclass
class Tree:
    """``words`` in byte order; per level the parent (a node of the level above), the word's number and the weight."""

    words: pa.LargeBinaryArray
    parent: list[np.ndarray]
    label: list[np.ndarray]
    weight: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.label)

    def first_children(self, level: int) -> np.ndarray:
        """Where the children of each node of a level start in the next one; one more for the end."""
        return np.searchsorted(self.parent[level + 1], np.arange(len(self.label[level]) + 1))


def grouped(code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, ascending, which of them each code is, and the sums of weights."""
    order = np.argsort(code, kind="stable")
    ordered = code[order]
    new = np.ones(len(code), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    which = np.empty(len(code), np.int64)
    which[order] = np.cumsum(new) - 1
    sums = np.add.reduceat(weight[order], starts) if len(starts) else np.zeros(0, np.int64)
    return ordered[starts], which, sums.astype(np.int64)


def in_order(words: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words in byte order, and the place of each."""
    order = pc.sort_indices(words).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return words.take(pa.array(order)), place


def built(words: pa.LargeBinaryArray, ids: np.ndarray, new: np.ndarray, depth: int) -> Tree:
    """Counts every sequence of up to ``depth`` neighbouring words. ``ids`` are numbers of sorted words, -1 is a break;
    a sequence counts where ``new`` holds for its last word."""
    v, valid, state = len(words), ids >= 0, ids
    count = np.bincount(ids[valid], new[valid], v).astype(np.int64) if v else np.zeros(0, np.int64)
    tree = Tree(words, [np.zeros(v, np.int64)], [np.arange(v)], [count])
    for k in range(1, depth):
        valid = valid[:-1] & (ids[k:] >= 0)
        code = state[:-1][valid] * v + ids[k:][valid]
        codes, which, sums = grouped(code, new[k:][valid].astype(np.int64))
        state = np.full(len(valid), -1, np.int64)
        state[valid] = which
        tree.parent.append(codes // v)
        tree.label.append(codes % v)
        tree.weight.append(sums)
    return tree


# -- cutting by prefix range -------------------------------------------------------------------
def positions(tree: Tree, bound: tuple[bytes, ...], starts: list[np.ndarray]) -> list[int]:
    """Per level, how many nodes come before the sequence ``bound``; a sequence comes after its own prefixes."""
    out, low, high, exact = [], 0, len(tree.label[0]), True
    for k in range(tree.depth):
        if exact and k < len(bound):
            number = word_place(tree.words, bound[k])
            at = low + int(np.searchsorted(tree.label[k][low:high], number[0]))
            exact = number[1] and at < high and tree.label[k][at] == number[0]
            inner = exact and k + 1 < len(bound)
            out.append(at + inner)
        else:
            at, inner = low, False
            out.append(low)
        exact = inner
        if k + 1 < tree.depth:
            low = int(starts[k][at])
            high = int(starts[k][at + 1]) if exact else low
    return out


def word_place(words: pa.LargeBinaryArray, word: bytes) -> tuple[int, bool]:
    """Where a word stands or would stand, and whether it is there."""
    at = bisect_left(words, word, key=lambda w: w.as_py())
    return at, at < len(words) and words[at].as_py() == word


def cut(tree: Tree, bounds: list[tuple[bytes, ...]]) -> list[Tree | None]:
    """The tree in len(bounds) + 1 parts by prefix range. Prefixes that belong to an earlier part have weight 0."""
    starts = [tree.first_children(k) for k in range(tree.depth - 1)]
    ends = [positions(tree, b, starts) for b in bounds] + [[len(x) for x in tree.label]]
    parts, begin = [], [0] * tree.depth
    for end in ends:
        if begin == end:
            parts.append(None)
        else:
            parts.append(_slice(tree, begin, end))
        begin = end
    return parts


def _slice(tree: Tree, begin: list[int], end: list[int]) -> Tree:
    first = list(begin)
    for k in range(tree.depth - 1, 0, -1):  # prefixes of the first node
        if first[k] < end[k]:
            first[k - 1] = min(first[k - 1], int(tree.parent[k][first[k]]))
    out = Tree(tree.words, [], [], [])
    for k in range(tree.depth):
        stop = max(end[k], begin[k], first[k])
        weight = tree.weight[k][first[k]:stop].copy()
        weight[:begin[k] - first[k]] = 0
        out.parent.append(tree.parent[k][first[k]:stop] - (first[k - 1] if k else 0))
        out.label.append(tree.label[k][first[k]:stop])
        out.weight.append(weight)
    return used_words(out)


def used_words(tree: Tree) -> Tree:
    """The same tree with no other words than it uses."""
    used, labels = np.unique(np.concatenate(tree.label), return_inverse=True)
    at = np.cumsum([0, *map(len, tree.label)])
    return Tree(tree.words.take(pa.array(used)), tree.parent, [labels[a:b] for a, b in zip(at, at[1:])], tree.weight)


def pruned(tree: Tree, least: int) -> Tree:
    """Only sequences of weight ``least`` or more and their prefixes; lighter prefixes get weight 0."""
    keep: list[np.ndarray] = [w >= least for w in tree.weight]
    for k in range(tree.depth - 1, 0, -1):
        keep[k - 1][tree.parent[k][keep[k]]] = True
    out, place = Tree(tree.words, [], [], []), None
    for k in range(tree.depth):
        out.parent.append(tree.parent[k][keep[k]] if place is None else place[tree.parent[k][keep[k]]])
        out.label.append(tree.label[k][keep[k]])
        out.weight.append(np.where(tree.weight[k] >= least, tree.weight[k], 0)[keep[k]])
        place = np.cumsum(keep[k]) - 1
    return used_words(out)


# -- union and composition ---------------------------------------------------------------------
def union(trees: list[Tree]) -> Tree:
    """One tree of all sequences; weights of equal ones are summed."""
    every = pa.concat_arrays([t.words for t in trees]).dictionary_encode()
    words, place = in_order(every.dictionary)
    number = place[every.indices.to_numpy()]
    at = np.cumsum([0, *(len(t.words) for t in trees)])
    maps, v = [number[a:b] for a, b in zip(at, at[1:])], max(len(words), 1)
    out, above = Tree(words, [], [], []), None
    for k in range(trees[0].depth):
        code = [m[t.label[k]] if above is None else a[t.parent[k]] * v + m[t.label[k]]
                for t, m, a in zip(trees, maps, above or trees)]
        codes, which, sums = grouped(np.concatenate(code), np.concatenate([t.weight[k] for t in trees]))
        out.parent.append(codes // v)
        out.label.append(codes % v)
        out.weight.append(sums)
        at = np.cumsum([0, *map(len, code)])
        above = [which[a:b] for a, b in zip(at, at[1:])]
    return out


def of_sequences(sequences: list[tuple[bytes, ...]], depth: int) -> tuple[Tree, np.ndarray, np.ndarray]:
    """A tree of weight 0 that accepts the sequences, and level and node of each."""
    length = np.array([len(s) for s in sequences])
    every = pa.array([w for s in sequences for w in s], pa.large_binary()).dictionary_encode()
    words, place = in_order(every.dictionary)
    flat, at, v = place[every.indices.to_numpy()], np.cumsum([0, *length])[:-1], max(len(words), 1)
    tree, node = Tree(words, [], [], []), np.zeros(len(sequences), np.int64)
    for k in range(depth):
        rows = np.flatnonzero(length > k)
        codes, which, _ = grouped(node[rows] * v + flat[at[rows] + k], np.zeros(len(rows), np.int64))
        node[rows] = which
        tree.parent.append(codes // v)
        tree.label.append(codes % v)
        tree.weight.append(np.zeros(len(codes), np.int64))
    return tree, length - 1, node


def composed(sequences: list[tuple[bytes, ...]], counts: Tree) -> np.ndarray:
    """The weights ``counts`` gives the sequences, 0 where it does not have one. The acceptor of all sequences and the
    counts are walked together, a level at a time, so shared prefixes are walked once."""
    asked, level, node = of_sequences(sequences, counts.depth)
    both = pa.concat_arrays([counts.words, asked.words]).dictionary_encode().indices.to_numpy()
    back = np.full(int(both.max(initial=-1)) + 1, -1, np.int64)
    back[both[:len(counts.words)]] = np.arange(len(counts.words))
    number, v = back[both[len(counts.words):]], max(len(counts.words), 1)
    found, above = [], None
    for k in range(counts.depth):
        label = number[asked.label[k]]
        up = np.zeros(len(label), np.int64) if above is None else above[asked.parent[k]]
        have = counts.parent[k] * v + counts.label[k]
        want = np.where((label >= 0) & (up >= 0), up * v + label, -1)
        at = np.searchsorted(have, want)
        hit = (want >= 0) & (at < len(have))
        hit[hit] = have[at[hit]] == want[hit]
        above = np.where(hit, at, -1)
        weight = np.zeros(len(label), np.int64)
        weight[hit] = counts.weight[k][at[hit]]
        found.append(weight)
    out = np.zeros(len(sequences), np.int64)
    for k in range(counts.depth):
        rows = level == k
        out[rows] = found[k][node[rows]]
    return out


def sequences_of(tree: Tree) -> list[tuple[list[bytes], np.ndarray]]:
    """Per level the sequences, words joined by a space, and their weights."""
    words, out, above = tree.words.to_numpy(zero_copy_only=False), [], None
    for k in range(tree.depth):
        own = words[tree.label[k]]
        above = own if above is None else above[tree.parent[k]] + b" " + own
        out.append((above, tree.weight[k]))
    return out


# -- the stored form ---------------------------------------------------------------------------
def shared(tree: Tree) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per level (arcs of each state, labels, weights, targets); nodes with equal endings are one state."""
    levels, state = [], np.zeros(len(tree.label[-1]), np.int64)
    for k in range(tree.depth - 1, -1, -1):
        label, weight = tree.label[k], tree.weight[k]
        nodes = len(tree.label[k - 1]) if k else 1
        arcs = np.bincount(tree.parent[k], minlength=nodes)
        start = np.cumsum(arcs) - arcs
        place = np.arange(len(label)) - np.repeat(start, arcs)
        mixed = (label.astype(np.uint64) * MIX[0]) ^ (weight.astype(np.uint64) + np.uint64(place.size)) * MIX[1]
        mixed = (mixed ^ (mixed >> np.uint64(29))) + state.astype(np.uint64) * MIX[0] + place.astype(np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * MIX[1]
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed)])
        _, first, same = np.unique(total[start + arcs] - total[start] + arcs.astype(np.uint64), return_index=True, return_inverse=True)
        # equal hashes are compared; whoever differs from the first of its hash stays a state of its own
        model = first[same]
        differs = arcs != arcs[model]
        rows = np.flatnonzero(~differs & (model != np.arange(nodes)))
        lengths = arcs[rows]
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        a, b = np.repeat(start[rows], lengths) + inside, np.repeat(start[model[rows]], lengths) + inside
        unequal = (label[a] != label[b]) | (weight[a] != weight[b]) | (state[a] != state[b])
        differs[np.repeat(rows, lengths)[unequal]] = True
        model = np.where(differs, np.arange(nodes), model)
        kept, state_of = np.unique(model, return_inverse=True)
        lengths = arcs[kept]
        take = np.repeat(start[kept], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        levels.append((lengths, label[take], weight[take], state[take]))
        state = state_of
    return levels[::-1]


def unfolded(words: pa.LargeBinaryArray, levels: list[tuple[np.ndarray, ...]]) -> Tree:
    tree, state = Tree(words, [], [], []), np.zeros(1, np.int64)
    for arcs, label, weight, target in levels:
        start, lengths = np.cumsum(arcs) - arcs, arcs[state]
        take = np.repeat(start[state], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        tree.parent.append(np.repeat(np.arange(len(state)), lengths))
        tree.label.append(label[take])
        tree.weight.append(weight[take])
        state = target[take]
    return tree


def stored(tree: Tree) -> bytes:
    """Bytes of the shared form: numbers in as few bytes as each list needs, equal places of them together."""
    lists = [a for level in shared(tree) for a in level]
    text = b"\n".join(tree.words.to_pylist())  # no word holds a line break
    head, body = [tree.depth, len(tree.words), len(text)], []
    for a in lists:
        width = next(w for w in (1, 2, 4, 8) if int(a.max(initial=0)) < 1 << (8 * w))
        head += [len(a), width]
        body.append(np.ascontiguousarray(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes())
    raw = np.array([len(head), *head], "<i8").tobytes() + text + b"".join(body)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def loaded(data: bytes) -> Tree:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    size = int(np.frombuffer(raw, "<i8", 1)[0])
    depth, n_words, n_text, *rest = np.frombuffer(raw, "<i8", size, 8).tolist()
    at = 8 * (size + 1)
    words = pa.array(raw[at:at + n_text].split(b"\n") if n_words else [], pa.large_binary())
    at += n_text
    lists = []
    for n, width in zip(rest[::2], rest[1::2]):
        part = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        lists.append(np.ascontiguousarray(part).view(f"<u{width}").ravel().astype(np.int64))
        at += n * width
    return unfolded(words, [tuple(lists[4 * k:4 * k + 4]) for k in range(depth)])


def checksum(tree: Tree) -> int:
    return zlib.crc32(stored(tree))
