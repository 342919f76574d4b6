"""Language labels for the words of a text by a linear-chain conditional random field.

A chain is a line, however long. A word is a run of letters (Unicode category L); its features are its
lower-case form (lexicon), its prefixes and suffixes of up to three letters and its letter pairs and
triples, hashed to ``BUCKETS`` weights per language; label transitions have weights too. Training
maximises the penalised likelihood of a bounded sample of labelled documents by Adagrad on the exact
gradient. Forward-backward gives each word's label probabilities, so code-switched text is labelled
word by word; a document's language is the one of the largest mean probability over all its words,
ties going to the first in order of name.

**Sample.** Of the distinct (text, lang) that may be learned from, those of the least hashes, whole
texts, up to ``SAMPLE_DOCS`` of them and ``SAMPLE_CHARS`` characters in all (one at least). The two
bounds concern training alone, and are what the driver ever holds.

A text without a letter, a null one included, is ``und`` with score 0; so is everything if there is
nothing to learn from. A null doc_id counts as held out. Rows that repeat a text get the same label.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, over_texts, release, releasing

BUCKETS = 1 << 17
SAMPLE_DOCS = 800
SAMPLE_CHARS = 1_200_000
EPOCHS = 14
RATE = 0.4
PENALTY = 1e-5
CACHE_WORDS = 300_000  # words whose scores a Python worker remembers, some 50 MB
CHUNK = 1_500_000  # characters labelled at once: long lines take as many steps whatever stands beside them

# letters as Python's patterns have them, which take numerals such as \u00b2 or \u2460 for letters too
_tokens = re.compile(r"[^\W\d_]+")


def letters_of(token: str) -> list[str]:
    """The words of a token: its runs of letters, where it holds other characters too."""
    if token.isascii() or token.isalpha():
        return [token]
    return "".join(c if c.isalpha() else " " for c in token).split()


def features(word: str) -> list[int]:
    """Buckets of a lower-case word."""
    marked = f"<{word}>"
    n = len(marked)
    names = [f"w{word}"]
    names += [f"p{marked[:k]}" for k in range(2, min(5, n))]
    names += [f"s{marked[-k:]}" for k in range(2, min(5, n))]
    names += [marked[i : i + 2] for i in range(n - 1)]
    names += [marked[i : i + 3] for i in range(n - 2)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for x in names]


def chains(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of all texts, the text each belongs to, and where chains start (one more entry: the end)."""
    words: list[str] = []
    owner_counts, starts = [], [0]
    for text in texts:
        before = len(words)
        for line in (text or "").lower().split("\n"):
            own = _tokens.findall(line)
            if own and not "".join(own).isalpha():
                own = [word for token in own for word in letters_of(token)]
            if own:
                words += own
                starts.append(len(words))
        owner_counts.append(len(words) - before)
    return words, np.repeat(np.arange(len(texts)), owner_counts), np.array(starts)


def marginals(scores: np.ndarray, starts: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Label probabilities of all words by forward-backward, chains in lockstep; with ``pairs`` also
    the expected transition counts. ``scores``: words x labels; ``trans``: label to label."""
    n, k = scores.shape
    length = np.diff(starts)
    order = np.argsort(-length, kind="stable")
    first, length = starts[:-1][order], length[order]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(trans - trans.max())
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    steps = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")
    for t in range(steps):
        at = first[: alive[t]] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ move) * emit[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        b = (emit[at + 1] * beta[at + 1]) @ move.T
        beta[at] = b / b.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    if not pairs:
        return gamma, None
    inner = np.ones(n, bool)
    inner[starts[:-1]] = False
    at = np.nonzero(inner)[0]
    joint = alpha[at - 1][:, :, None] * move[None] * (emit[at] * beta[at])[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return gamma, joint.sum(axis=0)


@dataclass(frozen=True)
class Model:
    """Learned labels, feature weights (buckets x labels) and transitions."""

    labels: tuple[str, ...]
    weights: np.ndarray
    trans: np.ndarray


def flat_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lists = [features(word) for word in words]
    return np.concatenate([np.array(x, np.int64) for x in lists]), np.concatenate([[0], np.cumsum([len(x) for x in lists])[:-1]])


def train(texts: list[str], langs: list[str], epochs: int = EPOCHS) -> Model:
    """Fit a model to texts whose words all count as their text's language."""
    labels = tuple(sorted(set(langs)))
    k = len(labels)
    words, owner, starts = chains(texts)
    if not words:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))
    gold = np.array([labels.index(x) for x in langs])[owner]
    types: dict[str, int] = {}
    kind = np.array([types.setdefault(word, len(types)) for word in words])
    flat, at = flat_features(list(types))
    size = np.diff(np.concatenate([at, [len(flat)]]))
    weights, trans = np.zeros((BUCKETS, k)), np.zeros((k, k))
    past_w, past_t = np.full((BUCKETS, k), 1e-8), np.full((k, k), 1e-8)
    inner = np.ones(len(words), bool)
    inner[starts[:-1]] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[np.nonzero(inner)[0] - 1], gold[inner]), 1)
    for _ in range(epochs):
        scores = np.add.reduceat(weights[flat], at)
        gamma, moved = marginals(scores[kind], starts, trans, pairs=True)
        gamma[np.arange(len(gold)), gold] -= 1
        per_type = np.stack([np.bincount(kind, weights=gamma[:, j], minlength=len(types)) for j in range(k)], axis=1) / len(gold)
        spread = np.repeat(per_type, size, axis=0)
        slope = np.stack([np.bincount(flat, weights=spread[:, j], minlength=BUCKETS) for j in range(k)], axis=1) + PENALTY * weights
        past_w += slope**2
        weights -= RATE * slope / np.sqrt(past_w)
        slope = (moved - seen) / len(gold) + 0.01 * trans
        past_t += slope**2
        trans -= RATE * slope / np.sqrt(past_t)
    return Model(labels, weights.astype(np.float32), trans)


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of doc_id as text leaves no remainder by 5; true for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Train on the sample of the rows with text and lang that are not held out. A threshold that
    about twice as many rows as needed pass keeps the others from being sorted; it grows until enough
    pass or all do, so repeated texts never leave the sample empty."""
    rows = docs.filter(~is_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("text", "lang", F.xxhash64("text", "lang").alias("h"))
    place = F.pmod("h", F.lit(1 << 32))
    count, chosen, most = rows.count(), [], sample_docs
    while count and len(chosen) < sample_docs:
        most = min(2 * most, count)
        some = rows if most == count else rows.filter(place < int(most / count * (1 << 32)))
        chosen = some.groupBy("h").agg(F.min(F.length("text")).alias("n")).orderBy("h").limit(sample_docs).collect()
        if most == count:
            break
        most *= 8
    total, keys = 0, []
    for r in chosen:
        total += r["n"]
        if keys and total > sample_chars:
            break
        keys.append(r["h"])
    if not keys:
        return train([], [])
    texts = rows.filter(F.col("h").isin(keys)).groupBy("h").agg(F.min(F.struct("text", "lang")).alias("s")).orderBy("h").collect()
    model = train([r["s"]["text"] for r in texts], [r["s"]["lang"] for r in texts])
    release()
    return model


class Labeller:
    """Applies a model; remembers the scores of words."""

    def __init__(self, model: Model):
        self.model = model
        self.index: dict[str, int] = {}
        self.table = np.empty((0, len(model.labels)))

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self.index) > CACHE_WORDS:
            self.index = {}
        new = [word for word in dict.fromkeys(words) if word not in self.index]
        if new:
            flat, at = flat_features(new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            added = np.add.reduceat(self.model.weights[flat].astype(np.float64), at)
            while len(self.table) < len(self.index):
                self.table = np.concatenate([self.table, np.empty((max(len(self.table), 4_096), len(self.model.labels)))])
            self.table[len(self.index) - len(new) : len(self.index)] = added
        return self.table[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Language and score of each text; all words, their texts and their label probabilities."""
        words, owner, starts = chains(texts)
        if not words or not self.model.labels:
            return ["und"] * len(texts), np.zeros(len(texts)), words, owner, np.zeros((len(words), 0))
        gamma, _ = marginals(self.scores(words), starts, self.model.trans)
        count = np.bincount(owner, minlength=len(texts))
        mean = np.stack([np.bincount(owner, weights=gamma[:, j], minlength=len(texts)) for j in range(gamma.shape[1])], axis=1) / np.maximum(count, 1)[:, None]
        best = mean.argmax(axis=1)
        score = np.where(count > 0, np.clip(mean[np.arange(len(texts)), best], 0, 1), 0.0)
        return [self.model.labels[b] if c else "und" for b, c in zip(best, count)], score, words, owner, gamma


def predicted(model: Model, text: str = "text") -> Column:
    """(lang_pred, score) of a text column as a struct; only the texts go to Python."""

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(model)
        for column in columns:
            parts = []
            for part in chunks([column.to_frame("text")], "text", CHUNK):
                langs, score, *_ = labeller.label(list(part["text"]))
                parts.append(pd.DataFrame({"lang_pred": langs, "score": score}))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": pd.Series([], dtype=str), "score": pd.Series([], dtype=float)})

    whole = releasing(run)

    def label(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from whole(columns)

    # called non-deterministic, so that it runs once a row however often its fields are used
    return F.pandas_udf(label, "lang_pred string, score double").asNondeterministic()(F.col(text))


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score added (columns of those names are replaced)."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "_said")]
    bounded_batches(docs.sparkSession)
    return docs.select(*[F.col(f"`{c}`") for c in kept], predicted(model).alias("_said")).select(*[F.col(f"`{c}`") for c in kept], "_said.lang_pred", "_said.score")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", is_held_out().alias("held_out"))
    return with_language(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and ``words``: an array of (word, lang, p) for every word of the text, lower-cased."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(model)
        for part in chunks(frames, "text", CHUNK):
            _, _, words, owner, gamma = labeller.label(list(part["text"]))
            best = gamma.argmax(axis=1) if gamma.shape[1] else np.zeros(len(words), np.int64)
            made = [{"word": w, "lang": model.labels[b], "p": float(g[b])} if len(g) else {"word": w, "lang": "und", "p": 0.0} for w, b, g in zip(words, best, gamma)]
            bounds = np.searchsorted(owner, np.arange(len(part) + 1))
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "words": [made[a:b] for a, b in zip(bounds[:-1], bounds[1:])]})

    return over_texts(docs.select("doc_id", "text"), run, "doc_id long, words array<struct<word:string,lang:string,p:double>>")


def digests(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
