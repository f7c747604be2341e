"""Unigram segmentation over a fixed vocabulary, computed level by level along a trie of distinct words.

The forward value of a prefix depends on the prefix alone. Distinct words are sorted, so that
words with a common prefix are neighbours; every distinct prefix is one trie node, and a level of nodes is computed
at once from the levels above it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

from dialogmill.llm.text_hash import span_hashes, text_chunks, word_spans

WORD_START = "▁".encode()
#: Words are put into tries by length: up to so many bytes, and up to twice, four times, ... as many.
TRIE_BYTES = 48
#: Bytes of words in one trie; fewer words than FEW of such a length are computed one by one, which gives the same.
TRIE_CELLS, FEW = 5_000_000, 32
#: Below this, sums of chances are taken relative to a new base.
SMALL = 1e-100
CHUNK = 4 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Pieces in order of rank; scores are -ln(rank) and each byte that no piece covers costs ``byte_score``."""

    pieces: tuple[bytes, ...]

    @classmethod
    def load(cls, model_file: str) -> Vocabulary:
        """The ordinary pieces of a sentencepiece model, in the order of its ids."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        return cls(tuple(dict.fromkeys(model.id_to_piece(i).encode() for i in ids)))

    @cached_property
    def scores(self) -> np.ndarray:
        return -np.log(np.arange(1, len(self.pieces) + 1) + 1.0)

    @property
    def byte_score(self) -> float:
        return -float(np.log(len(self.pieces) + 2)) - 10.0

    @cached_property
    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte trie of the pieces: next state by (state, byte), 0 for none, and the piece that ends in each state, -1 for none."""
        children: list[dict[int, int]] = [{}, {}]
        ends: dict[int, int] = {}
        for k, piece in enumerate(self.pieces):
            state = 1
            for b in piece:
                if b not in children[state]:
                    children[state][b] = len(children)
                    children.append({})
                state = children[state][b]
            ends[state] = k
        table, piece_of = np.zeros((len(children), 256), np.int32), np.full(len(children), -1, np.int32)
        for state, to in enumerate(children):
            table[state, list(to)] = list(to.values())
        piece_of[list(ends)] = list(ends.values())
        return table, piece_of


@dataclass
class Level:
    """One level of the word trie: for each node the words below it, and for each piece length what ends there."""

    rows: np.ndarray  # words that reach this level
    node: np.ndarray  # their nodes
    parent: np.ndarray  # node of each node one level up
    piece: np.ndarray  # [node, length - 1]: the piece of that many bytes that ends here, -1 for none


def trie_levels(words: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> Iterator[Level]:
    """Levels from the first byte on. words: [word, byte] sorted, 256 beyond a word's end."""
    table, piece_of = vocabulary.steps
    fresh = np.ones(words.shape, bool)
    np.logical_or.accumulate(words[1:] != words[:-1], axis=1, out=fresh[1:])
    states = np.zeros((1, 1), np.int32)
    node_above = np.zeros(len(words), np.int64)
    for depth in range(words.shape[1]):
        rows = np.flatnonzero(sizes > depth)
        if not len(rows):
            return
        new = fresh[rows, depth]
        new[0] = True
        node = np.cumsum(new) - 1
        first = rows[new]
        parent, byte = node_above[first], words[first, depth].astype(np.int64)
        came = states[parent]
        states = np.concatenate([table[1, byte][:, None], table[came, byte[:, None]]], axis=1) if depth else table[1, byte][:, None]
        alive = np.flatnonzero(states.any(axis=0))
        states = states[:, : alive[-1] + 1 if len(alive) else 1]
        node_above = np.zeros(len(words), np.int64)
        node_above[rows] = node
        yield Level(rows, node, parent, piece_of[states])


def _history(before: np.ndarray | None, value: np.ndarray | None, parent: np.ndarray, width: int, start: float) -> np.ndarray:
    """[node, k]: the value of the prefix k + 1 bytes shorter; ``start`` is that of the empty prefix."""
    if before is None:
        return np.full((len(parent), 1, *np.shape(start)), start)
    return np.concatenate([value[parent][:, None], before[parent][:, : width - 1]], axis=1)


def best_segmentation(words: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Pieces in the best segmentation of each word (highest score, then fewest pieces), and per level (node of each word, length and piece of the last step)."""
    scores = np.append(vocabulary.scores, -np.inf)
    counts, steps = np.zeros(len(words), np.int64), []
    old_score = old_count = score = count = None
    for depth, level in enumerate(trie_levels(words, sizes, vocabulary)):
        width = level.piece.shape[1]
        old_score = _history(old_score, score, level.parent, width, 0.0)
        old_count = _history(old_count, count, level.parent, width, 0)
        reach = min(width, old_score.shape[1])
        by_piece = old_score[:, :reach] + scores[level.piece[:, :reach]]
        by_piece = np.concatenate([by_piece, old_score[:, :1] + vocabulary.byte_score], axis=1)
        used = np.concatenate([old_count[:, :reach], old_count[:, :1]], axis=1) + 1
        top = by_piece.max(axis=1, keepdims=True)
        pick = np.where(by_piece >= top - 1e-9, used, np.iinfo(np.int64).max).argmin(axis=1)
        at = np.arange(len(pick))
        score, count = by_piece[at, pick], used[at, pick]
        ended = sizes[level.rows] == depth + 1
        counts[level.rows[ended]] = count[level.node[ended]]
        node = np.zeros(len(words), np.int64)
        node[level.rows] = level.node
        is_byte = pick == reach
        steps.append((node, np.where(is_byte, 1, pick + 1), np.where(is_byte, -1, level.piece[at, np.minimum(pick, reach - 1)])))
    return counts, steps


def pieces_used(sizes: np.ndarray, steps: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, pieces) of the best segmentations, last pieces first; bytes without a piece are left out."""
    left = sizes.astype(np.int64).copy()
    for depth in range(len(steps) - 1, -1, -1):
        words = np.flatnonzero(left == depth + 1)
        node, length, piece = (x[words] if k == 0 else x for k, x in enumerate(steps[depth]))
        left[words] -= length[node]
        found = piece[node]
        yield words[found >= 0], found[found >= 0]


def forward(words: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary, chance: np.ndarray, byte_chance: float) -> np.ndarray:
    """ln of the summed chance of all segmentations of each word under each model. chance: [piece, model].

    Sums are kept relative to a base for each node and model, which is moved before they run under; so no word's sum is cut off.
    """
    models = chance.shape[1]
    by_piece = np.vstack([chance, np.zeros((1, models))])
    out = np.zeros((len(words), models))
    old = value = base = None
    for depth, level in enumerate(trie_levels(words, sizes, vocabulary)):
        width = level.piece.shape[1]
        old = _history(old, value, level.parent, width, np.ones(models))
        base = np.zeros((len(level.parent), models)) if base is None else base[level.parent]
        value = old[:, 0] * byte_chance
        for k in range(min(width, old.shape[1])):
            hit = np.flatnonzero(level.piece[:, k] >= 0)
            value[hit] += old[hit, k] * by_piece[level.piece[hit, k]]
        small = np.flatnonzero((value < SMALL).any(axis=1))
        if len(small):
            factor = value[small]
            base[small] += np.log(factor)
            old[small] /= factor[:, None]
            value[small] = 1.0
        ended = sizes[level.rows] == depth + 1
        at = level.node[ended]
        out[level.rows[ended]] = np.log(value[at]) + base[at]
    return out


def _ends(word: bytes, start: int, vocabulary: Vocabulary) -> Iterator[tuple[int, int]]:
    table, piece_of = vocabulary.steps
    state = 1
    for k in range(start, len(word)):
        state = table[state, word[k]]
        if not state:
            return
        if piece_of[state] >= 0:
            yield k + 1, int(piece_of[state])


def long_best(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """Pieces of the best segmentation of one word, -1 for a byte without a piece."""
    best: list = [(0.0, 0, 0, -1)] + [None] * len(word)
    for i in range(len(word)):
        score, used = best[i][:2]
        for end, piece, gain in [(i + 1, -1, vocabulary.byte_score), *((e, p, vocabulary.scores[p]) for e, p in _ends(word, i, vocabulary))]:
            had = best[end]
            if had is None or score + gain > had[0] + 1e-9 or (score + gain >= had[0] - 1e-9 and used + 1 < had[1]):
                best[end] = (score + gain, used + 1, i, piece)
    out, at = [], len(word)
    while at:
        out.append(best[at][3])
        at = best[at][2]
    return out[::-1]


def long_forward(word: bytes, vocabulary: Vocabulary, chance: np.ndarray, byte_chance: float) -> np.ndarray:
    value = np.full((len(word) + 1, chance.shape[1]), -np.inf)
    value[0] = 0
    log_chance = np.log(chance)
    for i in range(len(word)):
        value[i + 1] = np.logaddexp(value[i + 1], value[i] + np.log(byte_chance))
        for end, piece in _ends(word, i, vocabulary):
            value[end] = np.logaddexp(value[end], value[i] + log_chance[piece])
    return value[-1]


@dataclass
class Words:
    """Words of a chunk of texts: hashes in order, bounds of each row, and the distinct ones with a place where they stand."""

    row: int
    bound: np.ndarray  # of each row among the words
    which: np.ndarray  # of each word among the distinct ones
    keys: np.ndarray  # sorted hashes of the distinct ones
    raw: np.ndarray
    begin: np.ndarray
    size: np.ndarray


def words_of(texts: pa.Array) -> Iterator[Words]:
    for row, raw, off in text_chunks(texts, CHUNK):
        begin, end = word_spans(raw, off)
        keys, first, which = np.unique(span_hashes(raw, begin, end, fold=False), return_index=True, return_inverse=True)
        yield Words(row, np.searchsorted(begin, off), which, keys, raw, begin[first], (end - begin)[first] + 1)


def computed(words: Words, chosen: np.ndarray, in_trie: Callable, alone: Callable, out: np.ndarray) -> np.ndarray:
    """Fills out[k] for the distinct words ``chosen`` (indices), along tries of words of like length."""
    mark = np.frombuffer(WORD_START, np.uint8)
    sizes = words.size[chosen]
    kind = np.ceil(np.log2(np.maximum(sizes, TRIE_BYTES) / TRIE_BYTES)).astype(int)
    for k in np.unique(kind):
        same, most = chosen[kind == k], TRIE_BYTES << int(k)
        if k and len(same) < FEW:
            for w in same:
                out[w] = alone(WORD_START + words.raw[words.begin[w] : words.begin[w] + words.size[w]].tobytes(), w)
            continue
        for part in np.array_split(same, -(-len(same) * most // TRIE_CELLS)):
            size = words.size[part]
            place = np.arange(size.max())
            inside = place < size[:, None]
            table = np.full((len(part), len(mark) + len(place)), 256, np.int16)
            table[:, : len(mark)] = mark
            table[:, len(mark) :][inside] = words.raw[(words.begin[part][:, None] + place)[inside]]
            order = np.argsort(np.where(inside, table[:, len(mark) :], 0).astype(np.uint8).view(f"S{len(place)}").ravel(), kind="stable")
            out[part[order]] = in_trie(table[order], size[order] + len(mark), part[order])
    return out


class Memo:
    """Values of words seen before in this task, by hash; begins anew when full."""

    def __init__(self, shape: tuple[int, ...], dtype, limit: int = 1 << 20):
        self.keys, self.values, self.limit = np.zeros(0, np.uint64), np.zeros((0, *shape), dtype), limit

    def of(self, words: Words, in_trie: Callable, alone: Callable) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.keys, words.keys), max(len(self.keys) - 1, 0))
        known = self.keys[place] == words.keys if len(self.keys) else np.zeros(len(words.keys), bool)
        out = np.zeros((len(words.keys), *self.values.shape[1:]), self.values.dtype)
        out[known] = self.values[place[known]]
        new = np.flatnonzero(~known)
        computed(words, new, in_trie, alone, out)
        if len(self.keys) + len(new) > self.limit:
            self.keys, self.values = self.keys[:0], self.values[:0]
        if len(new) <= self.limit:
            keys = np.concatenate([self.keys, words.keys[new]])
            order = np.argsort(keys)
            self.keys, self.values = keys[order], np.concatenate([self.values, out[new]])[order]
        return out


def row_sums(words: Words, values: np.ndarray) -> np.ndarray:
    """Sum of the words' values in each row of the chunk."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values[words.which], axis=0)])
    return total[words.bound[1:]] - total[words.bound[:-1]]
