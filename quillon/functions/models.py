"""Neural boundaries: encoders and pair scorers are pluggable; adapters are imported only when they are used.

An encoder turns a text column into array<float>; a pair scorer turns two text columns into a double. The defaults are
deterministic Column expressions; the adapters run a local model in Arrow batches, loaded once a worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.vectors import hashed_encoding, token_overlap

Encoder = Callable[[Column], Column]
PairScorer = Callable[[Column, Column], Column]


def hashing_encoder(dims: int = 64) -> Encoder:
    return lambda c: hashed_encoding(c, dims)


def overlap_scorer() -> PairScorer:
    return token_overlap


def transformer_encoder(path: str, max_length: int = 256, batch: int = 64, normalize: bool = True) -> Encoder:
    """A bi-encoder: mean-pooled last hidden states of a model in `path`. Needs transformers and torch on the workers."""

    @F.pandas_udf("array<float>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import torch
        from transformers import AutoModel, AutoTokenizer

        tokenizer, model = AutoTokenizer.from_pretrained(path), AutoModel.from_pretrained(path).eval()
        for series in texts:
            out = []
            values = series.fillna("").tolist()
            for at in range(0, len(values), batch):
                x = tokenizer(values[at : at + batch], padding=True, truncation=True, max_length=max_length, return_tensors="pt")
                with torch.no_grad():
                    hidden = model(**x).last_hidden_state
                mask = x["attention_mask"].unsqueeze(-1).float()
                pooled = (hidden * mask).sum(1) / mask.sum(1).clamp(min=1e-9)
                out += (torch.nn.functional.normalize(pooled) if normalize else pooled).tolist()
            yield pd.Series(out)

    return encode


def transformer_scorer(path: str, max_length: int = 256, batch: int = 32) -> PairScorer:
    """A cross-encoder: the score of a pair's logits by a model in `path`. Needs transformers and torch on the workers."""

    @F.pandas_udf("array<double>")
    def logits(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import torch
        from transformers import AutoModelForSequenceClassification, AutoTokenizer

        tokenizer, model = AutoTokenizer.from_pretrained(path), AutoModelForSequenceClassification.from_pretrained(path).eval()
        for left, right in pairs:
            out = []
            for at in range(0, len(left), batch):
                x = tokenizer(left[at : at + batch].tolist(), right[at : at + batch].tolist(), padding=True, truncation=True, max_length=max_length, return_tensors="pt")
                with torch.no_grad():
                    out += model(**x).logits.double().tolist()
            yield pd.Series(out)

    from quillon.functions.vectors import score_from_logits

    return lambda left, right: score_from_logits(logits(left, right))


def word_pieces(vocabulary: list[str], unknown: str = "[UNK]", longest: int = 100) -> Callable[[Column], Column]:
    """Greedy longest-match word pieces of a vocabulary; pieces inside a word start with '##'."""
    known = frozenset(vocabulary)

    def pieces(word: str) -> list[str]:
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                piece = ("##" if at else "") + word[at:end]
                if piece in known:
                    break
            else:
                return [unknown]
            out.append(piece)
            at = end
        return out if len(word) <= longest else [unknown]

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        import re

        return texts.fillna("").map(lambda t: [p for w in re.findall(r"\w+|[^\w\s]", t.lower()) for p in pieces(w)])

    return split
