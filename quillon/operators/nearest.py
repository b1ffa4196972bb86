"""The best k classes of each query in one partition of classes: what a task keeps, in bounded memory, and the two ways to score.

Classes come in the order that breaks ties. Scores are compared at 9 digits; NaN is above all numbers and null below, as in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

NOTHING, NULL, NAN = -np.inf, -1e306, 1e306
CELLS = 4_000_000  # scores held at once


def order_keys(scores: np.ndarray) -> np.ndarray:
    keys = np.clip(np.floor(scores * 1e9 + 0.5), -1e305, 1e305)
    return np.where(np.isnan(scores), NAN, keys)


class Best:
    """Of n queries the k best classes so far: keys, scores and values (whatever stands for a class)."""

    def __init__(self, n: int, k: int):
        self.keys, self.scores = np.full((n, k), NOTHING), np.zeros((n, k))
        self.values = np.full((n, k), None, object)

    def meet(self, at: int, keys: np.ndarray, values: np.ndarray, scores_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """keys[i, j] is that of query at + i and class j; scores_of gives the scores of chosen pairs. Earlier classes win ties."""
        k = self.keys.shape[1]
        worst = self.keys[at : at + len(keys), -1]
        better = keys > worst[:, None]
        if keys.shape[1] > k and better.sum() > 2 * k * len(keys):
            least = np.partition(keys, keys.shape[1] - k, axis=1)[:, keys.shape[1] - k]
            better &= keys >= least[:, None]
        who, what = np.nonzero(better)
        if not len(who):
            return
        rows, compact = np.unique(who, return_inverse=True)
        mine = slice(None), np.arange(k)
        own = np.repeat(np.arange(len(rows)), k)
        all_who = np.concatenate([own, compact])
        all_keys = np.concatenate([self.keys[at + rows][mine].ravel(), keys[who, what]])
        order = np.lexsort((-all_keys, all_who))  # stable: those held come first, then by place
        first = np.searchsorted(all_who[order], np.arange(len(rows)))
        kept = order[first[:, None] + np.arange(k)]
        old = kept < len(own)
        new_keys, new_scores = all_keys[kept], np.empty(kept.shape)
        new_values = np.empty(kept.shape, object)
        held_scores, held_values = self.scores[at + rows].ravel(), self.values[at + rows].ravel()
        new_scores[old], new_values[old] = held_scores[kept[old]], held_values[kept[old]]
        chosen = kept[~old] - len(own)
        new_scores[~old], new_values[~old] = scores_of(who[chosen], what[chosen]), values[what[chosen]]
        self.keys[at + rows], self.scores[at + rows], self.values[at + rows] = new_keys, new_scores, new_values

    def columns(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Number of the query, value and score of all that is held."""
        who, slot = np.nonzero(self.keys > NOTHING)
        return who, self.values[who, slot], pa.array(self.scores[who, slot], mask=self.keys[who, slot] == NULL)


def in_order(products: np.ndarray) -> np.ndarray:
    """Sums of rows, added up from the first."""
    return np.cumsum(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length, without null ones and those that hold a null."""
    lengths = np.array(vectors.value_lengths().fill_null(-1))
    flat = vectors.flatten()
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])[:-1]
    if flat.null_count:
        holes = np.concatenate([[0], np.cumsum(np.asarray(flat.is_null()))])
        lengths = np.where(holes[starts + np.maximum(lengths, 0)] > holes[starts], -1, lengths)
        flat = flat.fill_null(0)
    numbers = np.asarray(flat)
    for length in np.unique(lengths[lengths >= 0]):
        places = np.flatnonzero(lengths == length)
        yield places, numbers[starts[places][:, None] + np.arange(length)].astype(np.float64)


def nearest_vectors(queries: pa.Array, top_k: int, normalized: bool, batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The best classes (iri, embedding) of each query vector. Blocks are scored by matrix products; what is kept is added up in order."""
    best, asked = Best(len(queries), top_k), list(by_length(queries))
    lengths_of = lambda x: np.sqrt(in_order(x * x))
    norms = {q.shape[1]: lengths_of(q) for _, q in asked}
    whole = np.full(len(queries), 0)
    for i, (places, _) in enumerate(asked):
        whole[places] = i + 1
    for batch in batches:
        for lo in range(0, len(batch), 2048):
            part = batch.slice(lo, 2048)
            iris = np.array(part.column(0).to_pylist(), object)
            classes = {x.shape[1]: (places, x) for places, x in by_length(part.column(1))}
            for group in range(len(asked) + 1):  # queries of each length, and those without a vector
                members = np.flatnonzero(whole == group)
                q = asked[group - 1][1] if group else None
                own, x = classes.get(q.shape[1], (np.empty(0, int), None)) if group else (np.empty(0, int), None)
                size = lengths_of(x) if x is not None and not normalized else None
                row_of = np.full(len(iris), -1)
                row_of[own] = np.arange(len(own))
                block = max(1, CELLS // max(1, len(iris)))
                for at in range(0, len(members), block):
                    some = members[at : at + block]
                    keys = np.full((len(some), len(iris)), NULL)
                    if x is not None:
                        s = q[at : at + block] @ x.T
                        if not normalized:
                            s /= norms[q.shape[1]][at : at + block, None] * size[None, :] + 1e-12
                        keys[:, own] = order_keys(s)

                    def scores_of(who, what, q=q, x=x, at=at, size=size, row_of=row_of):
                        out = np.zeros(len(who))
                        for i in range(0, len(who) if x is not None else 0, 65_536):
                            a, b = at + who[i : i + 65_536], row_of[what[i : i + 65_536]]
                            s = in_order(q[a] * x[b])
                            out[i : i + 65_536] = s if normalized else s / (norms[q.shape[1]][a] * size[b] + 1e-12)
                        return out

                    _meet_members(best, some, keys, iris, scores_of)
    return best.columns()


def _meet_members(best: Best, members: np.ndarray, keys: np.ndarray, values: np.ndarray, scores_of: Callable) -> None:
    """Best.meet for queries that are one stretch (the usual case) or lie apart."""
    if members[-1] - members[0] + 1 == len(members):
        best.meet(int(members[0]), keys, values, scores_of)
        return
    for i, member in enumerate(members):
        best.meet(int(member), keys[i : i + 1], values, lambda who, what, i=i: scores_of(who + i, what))


def heaviest_sets(n: int, starts: np.ndarray, bags: np.ndarray, weights: np.ndarray, top_k: int, batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The best classes (value, numbers of tokens) of n bags of tokens, by the sum of the weights of the tokens they share.

    Token t is in the bags starts[t]..starts[t + 1] of `bags`, with those weights. Bags that share nothing with a class don't meet it.
    """
    best = Best(n, top_k)
    counts = np.diff(starts)
    step = max(1, CELLS // max(1, n))
    for batch in batches:
        names, sets = batch.column(0), batch.column(1)
        for lo in range(0, len(batch), step):
            some = sets.slice(lo, step)
            sizes, flat = np.array(some.value_lengths()), np.asarray(some.flatten())
            of = np.repeat(np.arange(len(some)), sizes)
            met = counts[flat]
            total = np.zeros(len(some) * n)
            ends = np.cumsum(met)
            at = 0
            while at < len(flat):  # as many tokens as make a block of pairs
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
                m = met[at:to]
                offsets = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                where = np.repeat(starts[flat[at:to]], m) + offsets
                np.add.at(total, np.repeat(of[at:to], m) * n + bags[where], weights[where])
                at = to
            scores = total.reshape(len(some), n).T
            keys = np.where(scores > 0, order_keys(scores), NOTHING)
            values = np.empty(len(some), object)
            values[:] = names.slice(lo, step).to_pylist()
            best.meet(0, keys, values, lambda who, what, s=scores: s[who, what])
    return best.columns()
