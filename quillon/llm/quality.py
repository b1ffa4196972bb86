"""Quality rules: counts of words, symbols and repetition, and line labelling by a conditional random field.

The lines of a text that hold a word are a sequence; a linear-chain conditional random field over features of each line
labels it content or boilerplate by Viterbi decoding. The share of a text's words that stand in content lines decides
whether it is retained.

Training: labels say which texts are good, not which lines. All lines of a bad text start as boilerplate; after a first
fit, those of its lines that the field holds to be content with a probability of `sure` are taken as content, and it
is fitted again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import vec

FEATURES = 14
_RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_words long"
)


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[ord(c) for c in chars]] = 1
    return out


_SYMBOL = _mask("#*$%&|<>")
_UPPER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _mask("0123456789")
_PUNCT = _mask("!\"'()+,-./:;=?@[\\]^_`{}~")
_BANG = _mask("!")
_STOP = _mask(".,;:")
_LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.uint8)


def _sum(table: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum over each of the ascending disjoint spans."""
    out = np.zeros(len(starts), np.int64)
    full = np.flatnonzero(ends > starts)
    if len(full):
        cuts = np.stack([starts[full], ends[full]], axis=1).reshape(-1)
        values = np.append(table[buf], 0)
        out[full] = np.add.reduceat(values, cuts, dtype=np.int64)[::2]
    return out


@dataclass
class Lines:
    """Counts of each text, and its lines with a word: bounds of each text's, their words and features."""

    counts: np.ndarray  # [text, (words, word_chars, symbols, dup_lines, repeat_words)]
    bounds: np.ndarray
    words: np.ndarray
    features: np.ndarray


def measure(buf: np.ndarray, offs: np.ndarray) -> Lines:
    n = len(offs) - 1
    starts, ends, word_bounds = vec.word_spans(buf, offs)
    text_of = np.repeat(np.arange(n), np.diff(word_bounds))
    hashes = vec.span_hashes(buf, starts, ends)
    counts = np.zeros((n, 5), np.int64)
    counts[:, 0] = np.diff(word_bounds)
    lengths = _sum(_LEAD, buf, starts, ends)
    counts[:, 1] = np.bincount(text_of, lengths, n)
    counts[:, 2] = _sum(_SYMBOL, buf, offs[:-1], offs[1:])

    grams, gram_bounds = vec.gram_hashes(hashes, word_bounds, 3)
    gram_text = np.repeat(np.arange(n), np.diff(gram_bounds))
    _, inverse, times = np.unique(grams ^ vec.mix(gram_text.astype(np.uint64), 3), return_inverse=True, return_counts=True)
    again = times[inverse] > 1
    first_word = np.arange(len(grams)) + np.repeat(word_bounds[:-1] - gram_bounds[:-1], np.diff(gram_bounds))
    repeated = np.zeros(len(starts) + 3, bool)
    for i in range(3):
        repeated[first_word[again] + i] = True
    repeated = repeated[: len(starts)]
    counts[:, 4] = np.bincount(text_of, repeated, n)

    breaks = np.flatnonzero(buf == 0x0A)
    line_starts = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    line_text = np.searchsorted(offs, line_starts, "right") - 1
    # A break at a text's very end starts an empty line, which holds no word; as its start is the next text's, drop it.
    own = np.concatenate([np.ones(n, bool), (breaks + 1) < offs[np.searchsorted(offs, breaks, "right")]])
    order = np.argsort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    line_starts, line_text = line_starts[own[order]], line_text[own[order]]
    line_text = np.minimum(line_text, n - 1) if n else line_text
    line_ends = np.append(line_starts[1:], len(buf))
    inside = np.searchsorted(starts, line_starts)
    line_words = np.diff(np.append(inside, len(starts)))
    held = np.flatnonzero(line_words > 0)
    a, e, t, k = line_starts[held], line_ends[held], line_text[held], line_words[held]
    trimmed = e - ((e > a) & (buf[np.maximum(e - 1, 0)] == 0x0A)) if len(e) else e
    line_hash = vec.span_hashes(buf, a, trimmed) ^ vec.mix(t.astype(np.uint64), 5)
    _, first = np.unique(line_hash, return_index=True)
    dup = np.ones(len(held), bool)
    dup[first] = False
    counts[:, 3] = np.bincount(t, dup, n)

    size = np.maximum(1, e - a).astype(np.float64)
    w0 = inside[held]
    chars = np.add.reduceat(np.append(lengths, 0), w0)[: len(w0)] if len(w0) else np.zeros(0)
    rep = np.add.reduceat(np.append(repeated.astype(np.int64), 0), w0)[: len(w0)] if len(w0) else np.zeros(0)
    last = buf[ends[w0 + k - 1] - 1] if len(w0) else np.zeros(0, np.uint8)
    first_byte = buf[starts[w0]] if len(w0) else np.zeros(0, np.uint8)
    f = np.ones((len(held), FEATURES))
    f[:, 1] = np.log1p(k)
    f[:, 2] = np.minimum(chars / np.maximum(1, k), 30) / 10
    for j, table in enumerate((_SYMBOL, _UPPER, _DIGIT, _PUNCT, _BANG), 3):
        f[:, j] = _sum(table, buf, a, e) / size
    f[:, 8] = rep / np.maximum(1, k)
    f[:, 9] = dup
    f[:, 10] = _STOP[last]
    f[:, 11] = _UPPER[first_byte] | (first_byte == 0xC3)
    f[:, 12] = k < 4
    f[:, 13] = f[:, 3] > 0.05
    return Lines(counts, np.searchsorted(t, np.arange(n + 1)), k, f)


@dataclass
class LineField:
    """weights: of the standardised features for content against boilerplate; move, start: scores of labels."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights

    def labels(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The most likely label (1 content) of each line, by Viterbi decoding over all texts side by side."""
        e = self.emissions(features)
        length = np.diff(bounds)
        order = np.argsort(-length, kind="stable")
        first, length = bounds[:-1][order], length[order]
        most = int(length[0]) if len(length) else 0
        back = np.zeros((len(e), 2), np.int8)
        active = np.searchsorted(-length, -np.arange(most), "left")
        best = np.zeros((len(order), 2))
        for t in range(most):
            n = active[t]
            at = first[:n] + t
            if t:
                each = best[:n, :, None] + self.move
                back[at] = each.argmax(axis=1)
                now = each.max(axis=1)
            else:
                now = np.broadcast_to(self.start, (n, 2)).copy()
            now[:, 1] += e[at]
            best[:n] = now
        out = np.zeros(len(e), np.int8)
        state = best.argmax(axis=1)
        for t in range(most - 1, -1, -1):
            n = active[t]
            at = first[:n] + t
            ends = length[:n] == t + 1
            here = np.where(ends, best[:n].argmax(axis=1), state[:n])
            out[at] = here
            state[:n] = back[at, here]
        return out


def _marginals(e: np.ndarray, live: np.ndarray, move: np.ndarray, start: np.ndarray):
    """Forward-backward over padded texts: (label marginals, expected moves, log partition)."""
    d, length = e.shape
    emit = np.stack([np.zeros_like(e), e], axis=2)
    fwd = np.zeros((d, length, 2))
    bwd = np.zeros((d, length, 2))
    fwd[:, 0] = start + emit[:, 0]
    for t in range(1, length):
        nxt = np.logaddexp(fwd[:, t - 1, 0, None] + move[0], fwd[:, t - 1, 1, None] + move[1]) + emit[:, t]
        fwd[:, t] = np.where(live[:, t, None], nxt, fwd[:, t - 1])
    for t in range(length - 2, -1, -1):
        after = emit[:, t + 1] + bwd[:, t + 1]
        nxt = np.logaddexp(move[:, 0] + after[:, 0, None], move[:, 1] + after[:, 1, None])
        bwd[:, t] = np.where(live[:, t + 1, None], nxt, 0)
    log_z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    node = np.exp(fwd + bwd - log_z[:, None, None]) * live[:, :, None]
    pair = np.exp(fwd[:, :-1, :, None] + move + (emit + bwd)[:, 1:, None, :] - log_z[:, None, None, None]) * live[:, 1:, None, None]
    return node, pair


@dataclass
class _Group:
    """Labelled texts of like numbers of lines, padded: features, which places are lines, labels, texts known to be good."""

    x: np.ndarray
    live: np.ndarray
    y: np.ndarray
    good: np.ndarray

    def marginals(self, theta: np.ndarray):
        return _marginals(np.where(self.live, self.x @ theta[:FEATURES], 0), self.live, theta[FEATURES : FEATURES + 4].reshape(2, 2), theta[FEATURES + 4 :])

    def gradient(self, theta: np.ndarray) -> np.ndarray:
        onehot = np.stack([1 - self.y, self.y], axis=2) * self.live[:, :, None]
        moves = (onehot[:, :-1, :, None] * onehot[:, 1:, None, :]).sum(axis=(0, 1))
        node, pair = self.marginals(theta)
        gap = onehot - node
        return np.concatenate([np.einsum("dl,dlf->f", gap[:, :, 1], self.x), (moves - pair.sum(axis=(0, 1))).reshape(-1), gap[:, 0].sum(axis=0)])


def fit(texts: list[str], good: list[int], steps: int = 120, sure: float = 0.8, penalty: float = 1e-3) -> LineField:
    """Fits the field to all lines of labelled texts. Without both classes all lines are content.

    The first labels of a bad text's lines are all boilerplate; a second fit takes those of them for content that the first is sure of.
    """
    found = [measure(buf, offs) for _, _, buf, offs in vec.text_chunks(pa.array([t or "" for t in texts], pa.large_string()))]
    y_text = np.array(good, np.int64)
    everything = LineField(np.zeros(FEATURES), np.ones(FEATURES), np.r_[1.0, np.zeros(FEATURES - 1)], np.zeros((2, 2)), np.zeros(2))
    if not found or y_text.min() == y_text.max() or not any(len(m.words) for m in found):
        return everything
    per_text = [m.features[m.bounds[i] : m.bounds[i + 1]] for m in found for i in range(len(m.bounds) - 1)]
    used = [i for i, f in enumerate(per_text) if len(f)]
    lines = np.concatenate([per_text[i] for i in used])
    mean, scale = lines.mean(axis=0), lines.std(axis=0)
    mean[0], scale[0] = 0.0, 1.0
    scale[scale < 1e-9] = 1.0
    like: dict[int, list[int]] = {}
    for i in used:
        like.setdefault((len(per_text[i]) - 1).bit_length(), []).append(i)
    groups = []
    for members in like.values():
        length = max(len(per_text[i]) for i in members)
        x, live = np.zeros((len(members), length, FEATURES)), np.zeros((len(members), length), bool)
        for row, i in enumerate(members):
            x[row, : len(per_text[i])] = (per_text[i] - mean) / scale
            live[row, : len(per_text[i])] = True
        good_rows = y_text[members] == 1
        groups.append(_Group(x, live, np.repeat(good_rows[:, None], length, axis=1).astype(np.int64), good_rows))
    theta = np.zeros(FEATURES + 6)
    for _round in range(2):
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            grad = sum(g.gradient(theta) for g in groups) / len(used) - penalty * theta
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
            theta = theta + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        for g in groups:
            g.y = np.where(g.good[:, None], 1, (g.marginals(theta)[0][:, :, 1] > sure).astype(np.int64))
    return LineField(mean, scale, theta[:FEATURES].copy(), theta[FEATURES : FEATURES + 4].reshape(2, 2).copy(), theta[FEATURES + 4 :].copy())


def verdicts(lines: Lines, field: LineField, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, kept, content lines, words in content lines) of each text."""
    label = field.labels(lines.features, lines.bounds)
    n = len(lines.counts)
    text = np.repeat(np.arange(n), np.diff(lines.bounds))
    content_words = np.bincount(text, lines.words * label, n).astype(np.int64)
    words, repeat = lines.counts[:, 0], lines.counts[:, 4]
    failed = (words < 50) | (100 * repeat > 50 * words)
    return failed, ~failed & (content_words >= share * words), np.bincount(text, label, n).astype(np.int64), content_words


def train_quality(docs: DataFrame, labels: DataFrame, per_class: int = 600, max_chars: int = 10_000) -> LineField:
    """The field of at most per_class labelled rows of each class, of texts of at most max_chars characters, which are read whole."""
    known = labels.where("quality is not null and doc_id is not null")
    picked = [
        known.where(F.col("quality") == q).select("doc_id", F.lit(q).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for q in (0, 1)
    ]
    sample = F.broadcast(picked[0].union(picked[1]).groupBy("doc_id").agg(F.max("good").alias("good")))
    rows = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(sample, "doc_id").select("doc_id", "text", "good")
    got = sorted(rows.collect(), key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in got], [r.good for r in got])


def quality_rules(docs: DataFrame, field: LineField, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of counts and verdicts for each row of `docs`; `docs` isn't shuffled.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word equal to an earlier line of
    the text), n_repeat_words (words in three-word windows found at least twice in the text), base_failed (under 50
    words, or over half of them repeated), kept (false if base_failed, else whether at least `share` of the words
    stand in content lines), n_lines, n_content_lines, content_words. A null text counts as empty and is not kept.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, offs in vec.text_chunks(batch.column(1)):
                lines = measure(buf, offs)
                failed, kept, content_lines, content_words = verdicts(lines, held.value, share)
                columns = [
                    batch.column(0).slice(row, end - row),
                    *(pa.array(lines.counts[:, i]) for i in range(5)),
                    pa.array(failed),
                    pa.array(kept),
                    pa.array(np.diff(lines.bounds)),
                    pa.array(content_lines),
                    pa.array(content_words),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _RESULT.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _RESULT)
