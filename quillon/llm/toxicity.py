"""Toxicity: a gap-weighted subsequence-kernel support vector machine with Nyström landmarks.

The kernel compares two strings by their common subsequences of four symbols, each weighted by `decay` to the power of
its span in either string and no wider than `span`, and is normalised to 1 for equal strings. It tolerates inserted
characters and gaps. The strings are the words of a sentence (runs of single letters count as one word), as 26 letters
with a mark at either end: case, Latin-1 accents, digits used for letters and all other characters are folded or left
out; a long word is several overlapping strings. A sentence, and a text, is as toxic as its most toxic string.

Training: labels say which texts are toxic, not which sentences. The strings that best tell the toxic training texts
from the others start as positives; the machine is fitted against strings of clean sentences, and the positives are
then chosen again as the toxic texts' best strings, with the clean strings that it scores highest as more negatives.
The landmarks span the kernel's features (Nyström); since the machine is linear in the kernel values with the landmarks,
it is applied as one weight for each four-symbol subsequence.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import vec

ORDER, WIDTH, MARKS = 4, 16, 28
LETTERS = WIDTH - 2
TELLING = 20.0  # G statistic of a first positive: chance gives it to about one run of symbols in 100,000
RARER = 5  # a positive string occurs in clean texts at most once for so many toxic texts
FLOOR = -1.0  # strings as far as this from the toxic side are told apart no more


def _letter_codes() -> np.ndarray:
    code = np.zeros(512, np.uint8)  # 256 + byte: the byte after 0xC3
    for i in range(26):
        code[97 + i] = code[65 + i] = i + 1
    for digit, letter in zip("013457@$", "oieastas", strict=True):
        code[ord(digit)] = code[ord(letter)]
    for byte, letter in zip(range(0xA0, 0xC0), "aaaaaaaceeeeiiiidnooooo ouuuuyty", strict=True):
        code[256 + byte] = code[256 + byte - 0x20] = code[ord(letter)] if letter != " " else 0
    code[256 + 0x9F] = code[ord("s")]
    return code


_CODE = _letter_codes()


def unit_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, units before each text and in all) of words; runs of three or more one-byte words are one."""
    starts, ends, bounds = vec.word_spans(buf, offs)
    single = ends - starts == 1
    if not single.any():
        return starts, ends, bounds
    doc = np.searchsorted(bounds[1:], np.arange(len(starts)), "right")
    joined = np.zeros(len(starts), bool)
    joined[1:] = single[1:] & single[:-1] & (doc[1:] == doc[:-1])
    run = np.cumsum(~joined) - 1
    size = np.bincount(run)
    joined &= size[run] >= 3
    first = np.flatnonzero(~joined)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1], np.searchsorted(first, bounds)


def strings_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([string, WIDTH] of codes 1-26 with marks 27 and 28, 0 at the end; the unit of each string)."""
    code = _CODE[buf]
    after = np.zeros(len(buf), bool)
    after[1:] = buf[:-1] == 0xC3
    code[after] = _CODE[256 + buf[after].astype(np.int64)]
    kept = np.flatnonzero(code)
    code = code[kept]
    a, b = np.searchsorted(kept, starts), np.searchsorted(kept, ends)
    length = b - a
    pieces = np.where(length > 0, 1 + np.maximum(0, -(-(length - LETTERS) // (LETTERS // 2))), 0)
    unit = np.repeat(np.arange(len(starts)), pieces)
    nth = np.arange(len(unit)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = a[unit] + nth * (LETTERS // 2)
    size = np.minimum(LETTERS, b[unit] - begin)
    cols = np.arange(LETTERS)
    padded = np.concatenate([code, np.zeros(LETTERS, np.uint8)])
    body = np.where(cols < size[:, None], padded[begin[:, None] + cols], 0).astype(np.uint8)
    out = np.zeros((len(unit), WIDTH), np.uint8)
    first = nth == 0
    out[first, 0] = 27
    at = first.astype(np.int64)[:, None] + cols
    np.put_along_axis(out, at, body, axis=1)
    last = nth == pieces[unit] - 1
    rows = np.flatnonzero(last)
    out[rows, (first.astype(np.int64) + size)[rows]] = 28
    return out, unit


class Subsequences:
    """The subsequences of a string: places of four symbols within `span`, and their weights."""

    def __init__(self, span: int, decay: float):
        places = [c for c in combinations(range(WIDTH), ORDER) if c[-1] - c[0] < span]
        self.places = np.array(places)
        self.weights = np.array([decay ** (c[-1] - c[0] + 1 - ORDER) for c in places], np.float32)

    def codes(self, strings: np.ndarray) -> np.ndarray:
        """[string, place] of a number for each subsequence, 0 for none."""
        s = strings.astype(np.int32)
        p = self.places
        out = s[:, p[:, 0]]
        for i in range(1, ORDER):
            out = out * (MARKS + 1) + s[:, p[:, i]]
        return np.where(s[:, p[:, -1]] > 0, out, 0)

    def features(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, code, weight) of the distinct subsequences of each string, normalised to length 1."""
        codes = self.codes(strings)
        n = len(codes)
        key = (np.arange(n)[:, None] * np.int64((MARKS + 1) ** ORDER) + codes).reshape(-1)
        weight = np.broadcast_to(self.weights, codes.shape).reshape(-1)
        live = codes.reshape(-1) > 0
        distinct, inverse = np.unique(key[live], return_inverse=True)
        total = np.bincount(inverse, weight[live], len(distinct))
        row, code = np.divmod(distinct, (MARKS + 1) ** ORDER)
        norm = np.sqrt(np.bincount(row, total**2, n))
        return row, code, total / norm[row]


@dataclass
class ToxicityModel:
    """weights: one for each subsequence code; the score of a text is logistic in its best string's margin."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    span: int
    decay: float

    def margins(self, strings: np.ndarray) -> np.ndarray:
        """The margin of each string, FLOOR at least.

        A string's length in the feature space is at least that of its subsequences taken as all different, so most
        strings are seen to be at the floor before equal subsequences are brought together.
        """
        sub, out = Subsequences(self.span, self.decay), np.full(len(strings), FLOOR)
        squares = sub.weights**2
        for at in range(0, len(strings), 1024):
            codes = sub.codes(strings[at : at + 1024])
            raw = (self.weights[codes] * sub.weights).sum(axis=1)
            least = np.sqrt((codes > 0) @ squares)
            near = np.flatnonzero(np.maximum(raw, 0) / np.maximum(least, 1e-9) + self.bias > FLOOR)
            norm = np.maximum(self._norms(codes[near], sub.weights), 1e-9)
            out[at + near] = np.maximum(FLOOR, raw[near] / norm + self.bias)
        return out

    @staticmethod
    def _norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        order = np.argsort(codes, axis=1)
        c, w = np.take_along_axis(codes, order, axis=1), np.where(codes > 0, weights, 0)
        w = np.take_along_axis(w, order, axis=1).astype(np.float64)
        total = np.cumsum(w, axis=1)
        last = np.ones(c.shape, bool)
        last[:, :-1] = c[:, 1:] != c[:, :-1]
        at_last = np.where(last, total, 0)
        before = np.maximum.accumulate(at_last, axis=1)
        group = np.where(last, total - np.concatenate([np.zeros((len(c), 1)), before[:, :-1]], axis=1), 0)
        return np.sqrt((group**2).sum(axis=1))

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.minimum(margin, 3) + self.shift)))


class TextScorer:
    """Scores texts; margins of strings met before are kept, up to `most` of them."""

    def __init__(self, model: ToxicityModel, most: int = 500_000):
        self.model, self.most, self.met = model, most, {}

    def best_margins(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Of each text its greatest margin, FLOOR without letters."""
        starts, ends, bounds = unit_spans(buf, offs)
        keys = vec.span_hashes(vec.lower(buf), starts, ends)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        listed = distinct.tolist()
        if len(self.met) + len(listed) > self.most:
            self.met.clear()
        new = [i for i, k in enumerate(listed) if k not in self.met]
        if new:
            strings, unit = strings_of(buf, starts[first[new]], ends[first[new]])
            best = np.full(len(new), FLOOR)
            np.maximum.at(best, unit, self.model.margins(strings))
            self.met.update(zip([listed[i] for i in new], best.tolist(), strict=True))
        value = np.fromiter(map(self.met.__getitem__, listed), np.float64, len(listed))[inverse]
        out = np.full(len(offs) - 1, FLOOR)
        np.maximum.at(out, np.repeat(np.arange(len(out)), np.diff(bounds)), value)
        return out

    def scores(self, text: pa.Array) -> np.ndarray:
        out = np.empty(len(text))
        for row, end, buf, offs in vec.text_chunks(text):
            out[row:end] = self.model.probability(self.best_margins(buf, offs))
        return out


_scorers: list[TextScorer] = []


def worker_scorer(model: ToxicityModel) -> TextScorer:
    """The worker's scorer of a model, kept from task to task with the margins that it has met."""
    if not _scorers or _scorers[0].model is not model:
        _scorers[:] = [TextScorer(model)]
    return _scorers[0]


def _distinct_strings(texts: Iterable[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(distinct strings, the indices of each text's own)."""
    table: dict[bytes, int] = {}
    per_text = []
    for row, end, buf, offs in vec.text_chunks(pa.array(list(texts), pa.large_string()), 1 << 17):
        starts, ends, bounds = unit_spans(buf, offs)
        strings, unit = strings_of(buf, starts, ends)
        index = np.fromiter((table.setdefault(s.tobytes(), len(table)) for s in strings), np.int64, len(strings))
        cuts = np.searchsorted(unit, bounds)
        per_text += [np.unique(index[cuts[i] : cuts[i + 1]]) for i in range(end - row)]
    strings = np.frombuffer(b"".join(table), np.uint8).reshape(-1, WIDTH) if table else np.zeros((0, WIDTH), np.uint8)
    return strings, per_text


def _first_witnesses(strings: np.ndarray, bags: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """A value of each string: the evidence of its most telling run of four or more symbols (signed G statistic)."""
    nt, nc = int(toxic.sum()), int((~toxic).sum())
    best = np.zeros(len(strings), np.float32)
    for size in (4, 5, 6):
        runs = np.zeros((len(strings), WIDTH - size + 1), np.uint32)
        for i in range(size):
            runs = runs * np.uint32(MARKS + 1) + strings[:, i : i + WIDTH - size + 1]
        runs[strings[:, size - 1 :] == 0] = 0
        distinct, of_string = np.unique(runs, return_inverse=True)
        of_string = of_string.reshape(len(strings), -1).astype(np.int32)
        hits, clean = np.zeros(len(distinct)), np.zeros(len(distinct))
        for bag, t in zip(bags, toxic, strict=True):
            (hits if t else clean)[np.unique(of_string[bag])] += 1
        p = (hits + clean) / (nt + nc)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = 2 * (hits * np.log(hits / (nt * p)) + np.where(clean > 0, clean * np.log(clean / (nc * p)), 0))
        value = np.where((hits > nt * p) & (distinct > 0), g, 0).astype(np.float32)
        for column in of_string.T:
            np.maximum(best, value[column], out=best)
    return best


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps on its active set."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(xb.shape[1])
    reg = np.eye(xb.shape[1])
    reg[-1, -1] = 1e-3
    for _ in range(40):
        active = y * (xb @ w) < 1
        xa, ca = xb[active], c * weight[active]
        new = np.linalg.solve(reg + (xa * ca[:, None]).T @ xa, (xa * ca[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    x = np.stack([np.minimum(m, 3), np.ones(len(m))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return max(float(w[0]), 0.0), float(w[1])


def fit(texts: list[str], toxic: list[int], span: int = 7, decay: float = 0.6, landmarks: int = 192, rounds: int = 3, c: float = 10.0, seed: int = 5) -> ToxicityModel:
    """Fits the machine to labelled texts. With one class only, or no texts, all scores are the class's rate."""
    y = np.array(toxic, bool)
    size = (MARKS + 1) ** ORDER
    rate = (y.sum() + 0.5) / (len(y) + 2)
    strings, bags = _distinct_strings(t or "" for t in texts)
    flat = ToxicityModel(np.zeros(size, np.float32), -1.0, 0.0, float(np.log(rate / (1 - rate))), span, decay)
    if not y.any() or y.all() or not len(strings):
        return flat
    rng = np.random.default_rng(seed)
    sub = Subsequences(span, decay)
    toxic_bags = [b for b, t in zip(bags, y, strict=True) if t and len(b)]
    clean_count = np.bincount(np.concatenate([b for b, t in zip(bags, y, strict=True) if not t] + [np.zeros(0, np.int64)]), minlength=len(strings))
    value = _first_witnesses(strings, bags, y)
    witness = Counter(int(i) for b in toxic_bags for i in b[value[b] > max(TELLING, 0.5 * value[b].max())])
    if not witness:
        return flat
    clean = np.flatnonzero(clean_count > 0)
    often = clean[np.argsort(-clean_count[clean], kind="stable")]
    negatives = np.unique(np.concatenate([often[:2000], rng.permutation(clean)[:6000]]))
    model = flat
    for _ in range(rounds):
        positives = np.array([i for i in witness if RARER * clean_count[i] <= witness[i] > 1], np.int64)
        if not len(positives):
            break
        negatives = np.setdiff1d(negatives, positives)
        chosen = np.concatenate(
            [sorted(positives, key=lambda i: (-witness[i], i))[: landmarks // 2], rng.permutation(negatives)[: landmarks // 2]]
        ).astype(np.int64)
        mark_row, mark_code, mark_value = sub.features(strings[chosen])
        used = np.unique(mark_code)
        dense = np.zeros((len(used) + 1, len(chosen)), np.float32)
        dense[np.searchsorted(used, mark_code), mark_row] = mark_value
        gram = dense.T @ dense
        values, vectors = np.linalg.eigh(gram.astype(np.float64))
        good = values > 1e-6 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])

        def kernel(index: np.ndarray) -> np.ndarray:
            out = np.zeros((len(index), len(chosen)))
            for at in range(0, len(index), 256):
                some = index[at : at + 256]
                row, code, weight = sub.features(strings[some])
                place = np.searchsorted(used, code)
                here = np.flatnonzero((place < len(used)) & (used[np.minimum(place, len(used) - 1)] == code))
                rows, first = np.unique(row[here], return_index=True)
                if len(rows):
                    out[at + rows] = np.add.reduceat(dense[place[here]] * weight[here][:, None].astype(np.float32), first, axis=0)
            return out

        index = np.concatenate([positives, negatives])
        label = np.concatenate([np.ones(len(positives)), -np.ones(len(negatives))])
        weight = np.concatenate([np.minimum(np.array([witness[int(i)] for i in positives]), 20.0), np.ones(len(negatives))])
        weight[: len(positives)] *= max(1.0, 0.2 * len(negatives) / weight[: len(positives)].sum())
        w, bias = _squared_hinge(kernel(index) @ root, label, weight, c)
        beta = root @ w
        table = np.zeros(size, np.float32)
        table[used] = dense[: len(used)] @ beta
        table[0] = 0
        model = ToxicityModel(table, bias, 1.0, 0.0, span, decay)
        margin = model.margins(strings)
        best = margin > 0
        witness = Counter(int(i) for b in toxic_bags for i in b[best[b] & (value[b] > TELLING) & (margin[b] > 0.5 * margin[b].max())])
        hard = clean[margin[clean] > -0.5]
        negatives = np.union1d(negatives, hard[np.argsort(-margin[hard], kind="stable")][:3000])
    best = np.array([margin[b].max() if len(b) else FLOOR for b in bags])
    model.slope, model.shift = _logistic(best, y.astype(float))
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, fold: int, folds: int, per_class: int, max_chars: int) -> list[tuple[str, int]]:
    """Texts and labels of at most `per_class` rows of each class outside the fold, of at most max_chars characters."""
    ids = labels.where("toxic is not null and doc_id is not null").where(
        F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) != fold
    )
    picked = [
        ids.where(F.col("toxic") == t).select("doc_id", F.lit(t).alias("toxic_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for t in (0, 1)
    ]
    sample = F.broadcast(picked[0].union(picked[1]).groupBy("doc_id").agg(F.max("toxic_label").alias("toxic_label")))
    rows = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(sample, "doc_id").select("doc_id", "text", "toxic_label")
    return [(r.text, r.toxic_label) for r in sorted(rows.collect(), key=lambda r: (r.doc_id, r.text))]


def toxicity_udf(spark, model: ToxicityModel):
    """A column function: the score of a text; null and empty texts have the score of a text without letters."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxicity(text: pa.Array) -> pa.Array:
        return pa.array(worker_scorer(held.value).scores(text))

    return toxicity


def train_toxicity(docs: DataFrame, labels: DataFrame, fold: int = 0, folds: int = 5, per_class: int = 1500, max_chars: int = 10_000) -> ToxicityModel:
    """The model of labelled rows whose crc32(doc_id as text) mod `folds` isn't `fold`; bounded by per_class and max_chars."""
    sample = labelled_sample(docs, labels, fold, folds, per_class, max_chars)
    return fit([t for t, _ in sample], [y for _, y in sample])


def score_toxicity(docs: DataFrame, model: ToxicityModel, folds: int = 5, fold: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs`, from the text alone; `docs` isn't shuffled."""
    score = toxicity_udf(docs.sparkSession, model)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False)).alias("held_out"),
        score(F.col(text_col).cast("string")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
