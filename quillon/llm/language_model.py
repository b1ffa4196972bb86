"""Language-model scores by a weighted backoff automaton of order three.

States are the empty context, each context word (with the start of a text), and each context of two words; a state has an arc
for each word that follows it in training text, the empty one for all words, and a failure arc to the context without its
first word. With c counts in training text and p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)), the arc of the empty context has the
weight log10 p(w), an arc of a context h to w the weight log10(L * c(h w) / c(h) + (1 - L) * p'(w)), where p' is what the
shorter context gives, and the failure arc log10(1 - L). L is chosen for each order and each class of contexts of like
frequency, from a few values, by the leave-one-out likelihood of all training text, order two first. A text is read once from
left to right: the traversal carries its state, follows failure arcs until the state has an arc for the word, adds up the weights, and goes
on in the arc's target, the longest context that the automaton has.

The corpus never meets in one place and no model is sent to all workers. Texts are tokenised into blocks; a block asks
for the counts of its own distinct words and bigrams, in packed arrays dealt by ranges of their hashes; a range adds up
what all blocks tell it and answers each. A block then asks for trigrams: only for those whose two bigrams other blocks have too, since
no other block can have the rest. With the answers it has the part of the automaton that its texts can reach. A range
holds a bounded number of keys, since their number grows with the tokens, and a frequent n-gram comes once from a block.
Keys are told apart by 48 bits of hash within their range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import vec
from quillon.llm.ranges import pack_keys, pack_unordered, range_cuts, unpack_keys
from quillon.llm.scratch import forget, release, written

U64 = np.uint64
END = U64(0x3C6EF372FE94F82B)
START = U64(0xA54FF53A5F1D36F1)
BLOCK_BYTES = 3 << 20
RANGE_TOKENS = 1_500_000
LEVELS = np.array([0.02, 0.1, 0.25, 0.4, 0.55, 0.7, 0.85, 0.95])
CLASSES = 12
SEGMENT = 256
_BLOCKS = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, vocabulary binary, tokens binary, n_tokens long"
_ASKED = "kind int, part int, block long, keys binary, counts binary"
_TOLD = "kind int, part int, block long, counts binary, known long, total long"
_COUNTED = (
    "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, vocabulary binary, tokens binary, n_words int, last int, words binary, bigrams binary, "
    "trigrams binary, left_out array<double>"
)
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _squeeze(a: np.ndarray) -> bytes:
    """Counts or ids, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def _expand(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def _vocabulary(raw: bytes) -> np.ndarray:
    """Ascending hashes, of their differences."""
    return np.cumsum(_expand(raw).view(U64), dtype=U64)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one after another: no more than one block is copied out of it."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, seq = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for row, end, buf, offs in vec.text_chunks(batch.column(2), BLOCK_BYTES):
            buf = vec.lower(buf)
            starts, ends, bounds = vec.word_spans(buf, offs)
            stream = np.insert(vec.span_hashes(buf, starts, ends), bounds[1:], END)
            vocabulary, tokens = np.unique(stream, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([place + seq], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, end - row], pa.int32()), batch.column(0).slice(row, end - row)),
                    pa.ListArray.from_arrays(pa.array([0, end - row], pa.int32()), batch.column(1).slice(row, end - row)),
                    pa.ListArray.from_arrays(pa.array([0, end - row], pa.int32()), pa.array((np.diff(bounds) + 1).astype(np.int32))),
                    pa.array([_squeeze(np.diff(vocabulary, prepend=U64(0)))], pa.binary()),
                    pa.array([_squeeze(tokens)], pa.binary()),
                    pa.array([len(tokens)], pa.int64()),
                ],
                ["block", "doc_ids", "held", "lengths", "vocabulary", "tokens", "n_tokens"],
            )
            seq += 1


class Block:
    """A block's tokens and n-grams. Words are in ascending order of hash, n-grams in that of their code, context * words + word: a
    bigram's context is a word or, after the last, the start of a text; a trigram's is a bigram, and a text's first token has none."""

    def __init__(self, held: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, n_words: int):
        self.n, self.lengths = n_words, lengths.astype(np.int64)
        self.tokens = tokens.astype(np.int64)
        self.text = np.repeat(np.arange(len(lengths)), self.lengths)
        self.train = np.repeat(~held, self.lengths)
        heads = np.cumsum(self.lengths) - self.lengths
        self.before = np.empty(len(self.tokens), np.int64)
        self.before[1:] = self.tokens[:-1]
        self.before[heads] = n_words
        self.bigrams, self.bigram = np.unique(self.before * n_words + self.tokens, return_inverse=True)
        self.context = np.empty(len(self.tokens), np.int64)
        self.context[1:] = self.bigram[:-1]
        self.context[heads] = -1

    @cached_property
    def _trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        inner = np.flatnonzero(self.context >= 0)
        codes, at = np.unique(self.context[inner] * self.n + self.tokens[inner], return_inverse=True)
        each = np.full(len(self.tokens), -1, np.int64)
        each[inner] = at
        return codes, each

    @property
    def trigrams(self) -> np.ndarray:
        return self._trigrams[0]

    @property
    def trigram(self) -> np.ndarray:
        """The trigram of each token, -1 for a text's first."""
        return self._trigrams[1]

    @classmethod
    def of(cls, r: dict) -> Block:
        return cls(np.array(r["held"], bool), np.array(r["lengths"]), _expand(r["tokens"]), r["n_words"])

    def own(self, at: np.ndarray, size: int) -> np.ndarray:
        """Counts in the block's training text."""
        return np.bincount(at[self.train & (at >= 0)], minlength=size)

    def hashes(self, words: np.ndarray) -> np.ndarray:
        """Hashes of the bigrams, in the order of their codes."""
        n = max(self.n, 1)
        first = np.append(vec.mix(words, 21), vec.mix(np.array([START]), 21))
        return vec.mix(first[self.bigrams // n] + words[self.bigrams % n], 22)

    def trigram_hashes(self, two: np.ndarray, words: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Hashes of some of the trigrams, by those of the bigrams."""
        return vec.mix(vec.mix(two, 23)[self.trigrams[some] // max(self.n, 1)] + words[self.trigrams[some] % max(self.n, 1)], 24)


def _packets(kind: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[tuple]:
    """(kind, part, packed keys, packed counts) of each range; answers come back in the order of the keys' hashes."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    cuts = range_cuts(keys, parts)
    for part in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[part], cuts[part + 1]
        yield kind, part, pack_keys(keys[a:b], part, parts), _squeeze(counts[a:b])


def _answered(told: list[tuple], keys: np.ndarray) -> np.ndarray:
    """The answers (see _told) to the keys, of (part, answers) to _packets of them."""
    out = np.zeros(len(keys), np.int64)
    if told:
        out[np.argsort(keys, kind="stable")] = np.concatenate([_expand(c) for _, c in sorted(told, key=lambda x: x[0])])
    return out


def _asked(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                words = _vocabulary(r["vocabulary"])
                block = Block.of(r | {"n_words": len(words)})
                two = block.hashes(words)
                out = [*_packets(0, words, block.own(block.tokens, len(words)), parts), *_packets(1, two, block.own(block.bigram, len(two)), parts)]
                if out:
                    kind, part, keys, counts = map(list, zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array([r["block"]] * len(out), pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())],
                        ["kind", "part", "block", "keys", "counts"],
                    )

    return run


def _told(table: pa.Table) -> pa.Table:
    """Adds up a range's counts over all blocks and answers each block in the order that it asked: twice the sum, and one if another block has the key."""
    keys = [unpack_keys(x.as_py()) for x in table["keys"]]
    counts = np.concatenate([_expand(x.as_py()) for x in table["counts"]]).astype(np.int64)
    size = np.array([len(k) for k in keys])
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    new = np.ones(len(every), bool)
    new[1:] = every[order][1:] != every[order][:-1]
    first = np.flatnonzero(new)
    total = np.add.reduceat(counts[order], first)
    answer = 2 * total + (np.diff(np.r_[first, len(every)]) > 1)
    back = np.empty(len(every), np.int64)
    back[order] = answer[np.cumsum(new) - 1]
    ends = np.cumsum(size)
    answers = [_squeeze(back[e - n : e]) for n, e in zip(size.tolist(), ends.tolist(), strict=True)]
    kind, part = table["kind"][0].as_py(), table["part"][0].as_py()
    rows = len(answers) + 1
    del keys, counts, every, order, back
    vec.trim()
    return pa.table(
        {
            "kind": pa.array([kind] * rows, pa.int32()),
            "part": pa.array([part] * rows, pa.int32()),
            "block": pa.concat_arrays([*table["block"].chunks, pa.array([None], pa.int64())]),
            "counts": pa.array([*answers, None], pa.binary()),
            "known": pa.array([None] * (rows - 1) + [int((total > 0).sum())], pa.int64()),
            "total": pa.array([None] * (rows - 1) + [int(total.sum())], pa.int64()),
        }
    )


@dataclass(frozen=True)
class Totals:
    """Training tokens, distinct ones, and L for each class of contexts of one and of two words."""

    tokens: int
    known: int
    one: np.ndarray | None = None
    two: np.ndarray | None = None

    def word(self, count: np.ndarray, less: int = 0) -> np.ndarray:
        return (count - less + 0.5) / (self.tokens - less + 0.5 * (self.known + 1))


def class_of(count: np.ndarray) -> np.ndarray:
    return np.minimum(CLASSES - 1, np.log2(np.maximum(count, 1)) // 2).astype(np.int64)


def _contexts(words: np.ndarray, last: int) -> np.ndarray:
    """How often each word, and the start of a text, is a context: the start is as frequent as the end, which is none."""
    out = np.append(words, words[last] if last >= 0 else 0)
    if last >= 0:
        out[last] = 0
    return out


def _left_out_words(b: Block, words: np.ndarray, bigrams: np.ndarray, last: int, totals: Totals) -> np.ndarray:
    """[class, level] log10 likelihood of the training tokens by contexts of one word, each left out of the counts."""
    context = _contexts(words, last)[b.before]
    at = np.flatnonzero(b.train & (context > 1))
    share, p = (bigrams[b.bigram[at]] - 1) / (context[at] - 1), totals.word(words[b.tokens[at]], 1)
    return np.stack([np.bincount(class_of(context[at]), np.log10(v * share + (1 - v) * p), CLASSES) for v in LEVELS], axis=1).astype(float)


def _left_out_pairs(b: Block, words: np.ndarray, bigrams: np.ndarray, trigrams: np.ndarray, last: int, totals: Totals) -> np.ndarray:
    """The same by contexts of two words, over what contexts of one word give with the L chosen for them."""
    context = np.where(b.context >= 0, bigrams[b.context], 0)
    at = np.flatnonzero(b.train & (context > 1))
    one = _contexts(words, last)[b.before[at]]
    share = (trigrams[b.trigram[at]] - 1) / (context[at] - 1)
    v1 = totals.one[class_of(one)]
    p = v1 * (bigrams[b.bigram[at]] - 1) / (one - 1) + (1 - v1) * totals.word(words[b.tokens[at]], 1)
    return np.stack([np.bincount(class_of(context[at]), np.log10(v * share + (1 - v) * p), CLASSES) for v in LEVELS], axis=1).astype(float)


class BackoffAutomaton:
    """The part of the automaton that a block's texts can reach.

    States: 0 the empty context, 1 + v the word v (v = n: the start of a text), 2 + n + j the bigram j; those without a count in
    training text don't exist. fails, fail_weight: the failure arc of each state. Arcs lie by order: of the empty state a weight
    and a target for each word, of words and bigrams codes in ascending order with a weight and a target each.
    """

    def __init__(self, b: Block, words: np.ndarray, bigrams: np.ndarray, trigrams: np.ndarray, last: int, totals: Totals):
        n, self.n, self.base = b.n, b.n, b.n + 2
        contexts = _contexts(words, last)
        ends = b.bigrams % max(n, 1) == last
        self.exists = np.concatenate([[True], contexts > 0, (bigrams > 0) & ~ends])
        one, two = totals.one[class_of(contexts)], totals.two[class_of(bigrams)]
        self.fails = np.concatenate([np.zeros(n + 2, np.int64), 1 + b.bigrams % max(n, 1)])
        self.fail_weight = np.concatenate([[0.0], np.log10(1 - one), np.log10(1 - two)])
        p = totals.word(words)
        self.weight0, self.target0 = np.log10(p), np.where(contexts[:n] > 0, 1 + np.arange(n), 0)
        has = np.flatnonzero(bigrams > 0)
        v, w = b.bigrams[has] // max(n, 1), b.bigrams[has] % max(n, 1)
        p2 = np.zeros(len(bigrams))
        p2[has] = one[v] * bigrams[has] / contexts[v] + (1 - one[v]) * p[w]
        self.codes1, self.weight1, self.target1 = b.bigrams[has], np.log10(p2[has]), self._reached(self.base + has, w)
        has = np.flatnonzero(trigrams > 0)
        j, w = b.trigrams[has] // max(n, 1), b.trigrams[has] % max(n, 1)
        pair = np.searchsorted(b.bigrams, b.bigrams[j] % max(n, 1) * n + w)
        p3 = two[j] * trigrams[has] / bigrams[j] + (1 - two[j]) * p2[pair]
        self.codes2, self.weight2, self.target2 = b.trigrams[has], np.log10(p3), self._reached(self.base + pair, w)

    def _reached(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The longest context that exists of those that end a two-word state."""
        return np.where(self.exists[state], state, np.where(self.exists[1 + word], 1 + word, 0))

    def start(self, b: Block, at: np.ndarray) -> np.ndarray:
        """The state before the tokens at these places."""
        j, v = b.context[at], b.before[at]
        two = self.base + np.maximum(j, 0)
        return np.where((j >= 0) & self.exists[np.minimum(two, len(self.exists) - 1)], two, np.where(self.exists[1 + v], 1 + v, 0))

    @staticmethod
    def _arc(codes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
        return at, (codes[at] == code) if len(codes) else np.zeros(len(code), bool)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, weight of the way to it) of states that read a word each."""
        state, out, target = state.copy(), np.zeros(len(state)), np.zeros(len(state), np.int64)
        open_ = np.ones(len(state), bool)
        for low, codes, weight, to in ((self.base, self.codes2, self.weight2, self.target2), (1, self.codes1, self.weight1, self.target1)):
            here = np.flatnonzero(open_ & (state >= low))
            at, hit = self._arc(codes, (state[here] - low) * self.n + word[here])
            took, at = here[hit], at[hit]
            out[took] += weight[at]
            target[took], open_[took] = to[at], False
            lost = here[~hit]
            out[lost] += self.fail_weight[state[lost]]
            state[lost] = self.fails[state[lost]]
        rest = np.flatnonzero(open_)
        out[rest] += self.weight0[word[rest]]
        target[rest] = self.target0[word[rest]]
        return target, out

    def traverse(self, b: Block) -> np.ndarray:
        """The log10 probability of each text. Texts are read side by side, long ones in segments of SEGMENT tokens, each from
        the state that the two tokens before it lead to."""
        counts = -(-b.lengths // SEGMENT)
        text = np.repeat(np.arange(len(b.lengths)), counts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = np.repeat(np.cumsum(b.lengths) - b.lengths, counts) + number * SEGMENT
        length = np.minimum(SEGMENT, np.repeat(b.lengths, counts) - number * SEGMENT)
        order = np.argsort(-length, kind="stable")
        first, length, text = first[order], length[order], text[order]
        most = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(most), "left")
        state, total = self.start(b, first), np.zeros(len(first))
        for t in range(most):
            n = active[t]
            state[:n], weight = self.step(state[:n], b.tokens[first[:n] + t])
            total[:n] += weight
        return np.bincount(text, total, len(b.lengths)).astype(float)


def _row(r: dict, **more) -> pa.Table:
    names = [f.split() for f in _COUNTED.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    r = r | more
    return pa.table({name: pa.array([r.get(name)], kinds[kind]) for name, kind in names})


def _told_by_kind(told: pa.Table) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {0: [], 1: [], 2: []}
    for kind, part, counts in zip(told["kind"].to_pylist(), told["part"].to_pylist(), told["counts"], strict=True):
        out[kind].append((part, counts.as_py()))
    return out


def _with_bigrams(totals: Totals):
    """A block with the counts of its words and bigrams."""

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        out, answers = [], _told_by_kind(told)
        for r in own.to_pylist():
            vocabulary = _vocabulary(r["vocabulary"])
            b = Block.of(r | {"n_words": len(vocabulary)})
            words, pairs = _answered(answers[0], vocabulary) >> 1, _answered(answers[1], b.hashes(vocabulary))
            end = int(np.searchsorted(vocabulary, END))
            last = end if end < len(vocabulary) and vocabulary[end] == END else -1
            left = _left_out_words(b, words, pairs >> 1, last, totals).reshape(-1)
            out.append(_row(r, n_words=len(vocabulary), last=last, words=_squeeze(words), bigrams=_squeeze(pairs), left_out=left))
        vec.trim()
        return pa.concat_tables(out)

    return run


def _asked_trigrams(parts: int):
    """What blocks ask for trigrams, made from what they keep, so that it is stored nowhere but on its way to the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                b, vocabulary = Block.of(r), _vocabulary(r["vocabulary"])
                open_ = _open_trigrams(b, _expand(r["bigrams"]))
                three, order, cuts = _ranges_of_trigrams(b, vocabulary, open_, parts)
                counts, told = b.own(b.trigram, len(b.trigrams))[open_], np.flatnonzero(np.diff(cuts)).tolist()
                at = [order[cuts[p] : cuts[p + 1]] for p in told]
                keys = [pack_unordered(three[i], p, parts) for p, i in zip(told, at, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([2] * len(told), pa.int32()),
                        pa.array(told, pa.int32()),
                        pa.array([r["block"]] * len(told), pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array([_squeeze(counts[i]) for i in at], pa.binary()),
                    ],
                    ["kind", "part", "block", "keys", "counts"],
                )
                vec.trim()

    return run


def _ranges_of_trigrams(b: Block, vocabulary: np.ndarray, open_: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, order, cuts): hashes of the open trigrams, and their places by range, in the order of their codes in each."""
    three = b.trigram_hashes(b.hashes(vocabulary), vocabulary, open_)
    part = ((three >> U64(32)) * U64(parts)) >> U64(32)
    order = np.argsort(part, kind="stable")
    return three, order, np.searchsorted(part[order], np.arange(parts + 1))


def _open_trigrams(b: Block, pairs: np.ndarray) -> np.ndarray:
    """The trigrams that other blocks may have: those both of whose bigrams (with their answers `pairs`) others have."""
    n = max(b.n, 1)
    context = b.trigrams // n
    pair = np.searchsorted(b.bigrams, b.bigrams[context] % n * n + b.trigrams % n)
    return np.flatnonzero(pairs[context] & pairs[pair] & 1)


def _with_trigrams(totals: Totals, parts: int):
    """A block with the counts of its trigrams too."""

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        rows, answers, out = own.to_pylist(), _told_by_kind(told), []
        for r in rows:
            b, words, pairs = Block.of(r), _expand(r["words"]), _expand(r["bigrams"])
            trigrams = b.own(b.trigram, len(b.trigrams))
            if answers[2]:
                told = np.concatenate([_expand(c) for _, c in sorted(answers[2], key=lambda x: x[0])]) >> 1
                open_ = _open_trigrams(b, pairs)
                trigrams[open_[_ranges_of_trigrams(b, _vocabulary(r["vocabulary"]), open_, parts)[1]]] = told
            left = _left_out_pairs(b, words, pairs >> 1, trigrams, r["last"], totals).reshape(-1)
            out.append(_row(r, vocabulary=None, trigrams=_squeeze(trigrams), left_out=left))
        vec.trim()
        return pa.concat_tables(out)

    return run


def _scored(totals: Totals):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                b = Block.of(r)
                words, pairs, trigrams = (_expand(r[c]) for c in ("words", "bigrams", "trigrams"))
                automaton = BackoffAutomaton(b, words, pairs >> 1, trigrams, r["last"], totals)
                count, n = words[b.tokens], len(b.lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(r["doc_ids"], pa.int64()),
                        pa.array(r["held"], pa.bool_()),
                        pa.array(b.lengths),
                        pa.array(np.bincount(b.text, count > 0, n).astype(np.int64)),
                        pa.array(np.bincount(b.text, np.log10(totals.word(count)), n).astype(float)),
                        pa.array(automaton.traverse(b)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )
                vec.trim()

    return run


def _chosen(blocks: DataFrame) -> np.ndarray:
    """L of each class: the level of the greatest likelihood; the second level for a class that training text lacks."""
    sums = {r[0]: r[1] for r in blocks.select(F.posexplode("left_out")).groupBy("pos").agg(F.sum("col")).collect()}
    grid = np.array([sums.get(i, 0.0) for i in range(CLASSES * len(LEVELS))]).reshape(CLASSES, len(LEVELS))
    return np.array([LEVELS[int(np.argmax(g))] if g.any() else LEVELS[1] for g in grid])


def score_texts(docs: DataFrame, folds: int = 5, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of `docs`.

    held_out: crc32(doc_id as text) mod `folds` is `fold`; the other rows are the training text. Tokens are words,
    lower-cased in A-Z, and an end. n_known: tokens that training text has; train_tokens: its tokens in all. base_score:
    the log10 probability by words alone; score: by the automaton. A null or empty text is one end. Rows with a null
    id are training text. Without training text every word's probability is that of an unseen word.
    """
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held"), F.col(text_col).cast("string").alias("text"))
    blocks = written(rows.mapInArrow(_tokenised, _BLOCKS), "lm-blocks")
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-tokens // RANGE_TOKENS))
    told = written(blocks.mapInArrow(_asked(parts), _ASKED).groupBy("kind", "part").applyInArrow(_told, _TOLD), "lm-counts")
    known, total = told.where("kind = 0 and block is null").agg(F.sum("known"), F.sum("total")).first()
    release(docs.sparkSession)
    totals = Totals(total or 0, known or 0)
    answers = told.where("block is not null").select("kind", "part", "block", "counts")
    counted = written(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_with_bigrams(totals), _COUNTED), "lm-bigrams")
    del answers
    forget(blocks, told)
    totals = replace(totals, one=_chosen(counted))
    release(docs.sparkSession)
    asked = counted.mapInArrow(_asked_trigrams(parts), _ASKED)
    told = written(asked.groupBy("kind", "part").applyInArrow(_told, _TOLD), "lm-trigram-counts")
    release(docs.sparkSession)
    answers = told.where("block is not null").select("kind", "part", "block", "counts")
    automata = written(counted.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_with_trigrams(totals, parts), _COUNTED), "lm-trigrams")
    forget(counted, told)
    del asked, answers
    release(docs.sparkSession)
    totals = replace(totals, two=_chosen(automata))
    scored = automata.mapInArrow(_scored(totals), _SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")
