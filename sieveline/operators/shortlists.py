"""What a later step can use of the scores of a task's documents.

A step that takes a request's candidates in order looks at few of them, and which those are shows among any part of the
candidates already: each rule below leaves out a row only if rows before it, all met in the same task, rule it out.  So the
rows of all tasks together hold every row that counts, and what is kept does not grow with the documents of a task.
A rule's state is a table of bounds by request, which its ``drop`` tightens with each block and applies to it by writing -1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Entries of a state by path, class and request.
STATE = 1 << 21


def sizes(most: int) -> np.ndarray:
    """Least tokens of each class of sizes up to ``most``: single numbers first, then steps by a quarter."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array([0, *(x for x in out if x <= most)], np.int64)


class Keep:
    def begin(self, n_queries: int) -> object:
        raise NotImplementedError

    def drop(self, state: object, part: pa.RecordBatch, score: np.ndarray) -> None:
        raise NotImplementedError


class Best(Keep):
    """The best ``most`` of each request, with all ties at the edge for the keys to decide."""

    def __init__(self, most: int) -> None:
        self.most = most

    def begin(self, n_queries: int) -> np.ndarray:
        return np.full((self.most if self.most * n_queries <= STATE else 0, n_queries), -1.0)  # the best scores so far; for very many requests none

    def drop(self, state: np.ndarray, part: pa.RecordBatch, score: np.ndarray) -> None:
        score[~self.best(state, score)] = -1

    def best(self, state: np.ndarray, score: np.ndarray) -> np.ndarray:
        both = np.concatenate([state, score])
        if len(both) < self.most:
            return score >= 0
        top = np.partition(both, len(both) - self.most, axis=0)[len(both) - self.most :]
        state[:] = top[: len(state)]
        return (score >= top[0]) & (score >= 0)


class Sums(Keep):
    """Rows that the sum of weights of the smaller rows before them does not rule out.

    ``low`` are the least tokens of each class; a row of class j goes if the weights (tokens, ``most`` at most) of rows before
    it with ``upto[j]`` tokens or fewer sum to more than ``room[j]``, and if it has more than ``largest`` tokens.
    """

    def __init__(self, low: np.ndarray, upto: np.ndarray, room: np.ndarray, most: int, largest: int | None = None) -> None:
        self.low, self.upto, self.room, self.most, self.largest = low, upto, room, most, largest

    def begin(self, n_queries: int) -> object:
        return np.full((len(self.low), n_queries), -1.0), [(np.zeros(0), np.zeros(0, np.int64))] * n_queries

    def drop(self, state: object, part: pa.RecordBatch, score: np.ndarray) -> None:
        edge, kept = state
        tokens = part.column("tokens").to_numpy()
        if self.largest is not None:
            score[tokens > self.largest] = -1
        kind = np.searchsorted(self.low, tokens, "right") - 1
        score[score < edge[kind]] = -1
        for q in np.flatnonzero((score >= 0).any(0)).tolist():
            hit = np.flatnonzero(score[:, q] >= 0)
            s, t = np.r_[kept[q][0], score[hit, q]], np.r_[kept[q][1], tokens[hit]]
            order = np.argsort(-s, kind="stable")
            s, t = s[order], t[order]
            over = np.cumsum(np.where(t <= self.upto[:, None], np.minimum(t, self.most), 0), axis=1) > self.room[:, None]
            j = np.flatnonzero(over[:, -1])
            edge[j, q] = np.maximum(edge[j, q], s[over[j].argmax(1)])
            stays = s >= edge[np.searchsorted(self.low, t, "right") - 1, q]
            kept[q] = s[stays], t[stays]
        score[score < edge[kind]] = -1


def fitting(room: int) -> Sums:
    """For a fold that takes every row that still fits: of the rows before one, those no larger than it were taken if it is,
    as the room only shrinks, and so they fit together with it."""
    low = sizes(room)
    return Sums(low, low, room - low, room, room)


def missed(room: int, most: int) -> Sums:
    """For the first ``most`` rows that such a fold leaves: the rows before one of them are taken, which fit the room, or among
    the ``most - 1`` rows left before; all of the first rows up to there stay, so that the fold over them is the same."""
    return Sums(np.zeros(1, np.int64), np.full(1, np.iinfo(np.int64).max), np.full(1, room + (most - 1) * (room + 1)), room + 1)


class Steps(Keep):
    """For folds that take one row a path, within ``room``: after one that was not taken only a smaller one can be, and so of
    each path the rows stay that are smaller than all before them (by class of sizes)."""

    def __init__(self, room: int) -> None:
        self.room, self.low = room, sizes(room)

    def begin(self, n_queries: int) -> tuple[dict[str, int], list[np.ndarray], int]:
        n = STATE // max(1, n_queries * len(self.low))  # rows of further paths all stay
        return {}, [np.full((0, len(self.low), n_queries), -1.0)], n

    def drop(self, state: tuple, part: pa.RecordBatch, score: np.ndarray) -> None:
        score[~self.small(state, part, score)] = -1

    def small(self, state: tuple, part: pa.RecordBatch, score: np.ndarray) -> np.ndarray:
        known, held, most = state
        tokens, paths = part.column("tokens").to_numpy(), part.column("path").dictionary_encode()
        names = paths.dictionary.to_pylist()
        for x in names:
            if x not in known and len(known) < most:
                known[x] = len(known)
        own = np.array([known.get(x, -1) for x in names] + [-1])[paths.indices.fill_null(len(names)).to_numpy()]
        more = len(known) - len(held[0])
        edge = held[0] = np.concatenate([held[0], np.full((more, *held[0].shape[1:]), -1.0)]) if more else held[0]
        at = np.searchsorted(self.low, tokens, "left")  # a row rules out those of its class at least
        rows = np.flatnonzero((own >= 0) & (at < len(self.low)))
        if len(rows):
            group = own[rows] * len(self.low) + at[rows]
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
            flat = edge.reshape(-1, score.shape[1])
            flat[group[order][first]] = np.maximum(flat[group[order][first]], np.maximum.reduceat(score[rows[order]], first, axis=0))
            np.maximum.accumulate(edge, axis=1, out=edge)
        out = (score >= 0) & (tokens <= self.room)[:, None]
        mine = np.flatnonzero(own >= 0)
        out[mine] &= score[mine] >= edge[own[mine], np.searchsorted(self.low, tokens[mine], "right") - 1]
        return out


class Pack(Keep):
    """For the pack of all passes within ``room``: the best ``most``, and ``Steps``."""

    def __init__(self, most: int, room: int) -> None:
        self.first, self.steps = Best(most), Steps(room)

    def begin(self, n_queries: int) -> tuple:
        return self.first.begin(n_queries), self.steps.begin(n_queries)

    def drop(self, state: tuple, part: pa.RecordBatch, score: np.ndarray) -> None:
        score[~(self.first.best(state[0], score) | self.steps.small(state[1], part, score))] = -1
