"""Problem 2: the share of a document's words that only repeat earlier ones.

A word is repeated if it lies in six consecutive words that already began at an earlier word of the text. A worker takes the
words of a batch as hashes (``words.word_hashes``) and each document's statistics in numpy: repeated words, pairs and triples
of words, the commonest word, the length; windows of six are not among them. Gradient-boosted trees, fitted on made-up
documents and flattened into node arrays, score all documents of a batch at once; the score is an estimate of the share. The
trees are monotonic in the repeated words, pairs and triples. Of the words that a share of s counts, each is a repeated
word, and of six in a repeated window five begin a repeated pair and four a repeated triple; so the least score of documents with
shares of s, 5/6 s and 4/6 s of these can be computed from the trees. Documents below it are passed over without loss; of all
others the windows of six are compared.

Results: null, empty and wordless texts have 0 words and share 0.0; texts under six words have share 0.0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.words import word_hashes

WINDOW = 6
FEATURES = ["words1", "windows2", "windows3", "commonest", "log_words"]
#: +1: the score never falls as the statistic grows; 0: free.
MONOTONIC = np.array([1, 1, 1, 0, 0])


# ---- statistics -----------------------------------------------------------------------------------------------


def repeated_windows(codes: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Begins of the windows of ``width`` words whose like began earlier in the same document. Windows of one hash are compared word by word."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    key = doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        for k in range(width):
            key = (key ^ (codes[k : k + n] + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
    begins = np.flatnonzero(doc[:n] == doc[width - 1 :])
    key = key[begins]
    order = np.argsort(key, kind="stable")
    x, y = begins[order[1:]], begins[order[:-1]]
    same = (key[order[1:]] == key[order[:-1]]) & (doc[x] == doc[y])
    for k in range(width):
        same &= codes[x + k] == codes[y + k]
    return np.sort(x[same])


def covered(begins: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n places lie in a window that begins at one of ``begins``."""
    edge = np.zeros(n + 1, np.int64)
    edge[:n] += np.bincount(begins, minlength=n)[:n]
    edge -= np.bincount(begins + width, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def statistics(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """FEATURES of each document; ``codes``: the words of all documents one after the other."""
    m, n = len(sizes), len(codes)
    doc = np.repeat(np.arange(m), sizes)
    least = np.maximum(sizes, 1)
    out = np.zeros((m, len(FEATURES)))
    if n:
        order = np.lexsort((codes, doc))
        c, d = codes[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])]))
        times, of = np.diff(np.concatenate([first, [n]])), d[first]
        out[:, 0] = np.bincount(of, times - 1, minlength=m) / least
        np.maximum.at(out[:, 3], of, times)
        out[:, 3] /= least
    for f, width in ((1, 2), (2, 3)):
        out[:, f] = np.bincount(doc[repeated_windows(codes, doc, width)], minlength=m) / least
    out[:, 4] = np.log1p(sizes)
    return out


def shares(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The exact share of each document."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(doc[covered(repeated_windows(codes, doc, WINDOW), len(codes), WINDOW)], minlength=len(sizes)) / np.maximum(sizes, 1)


# ---- gradient-boosted trees -----------------------------------------------------------------------------------


class Trees:
    """Boosted regression trees as flat node arrays: feature (-1 at a leaf), cut (right if above), left, right, value."""

    def __init__(self, base: float, nodes: dict[str, np.ndarray], roots: np.ndarray):
        self.base, self.roots = base, roots
        self.feature, self.cut, self.left, self.right, self.value = (nodes[k] for k in ("feature", "cut", "left", "right", "value"))

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.base + self.value[at].sum(1)
            above = x[row, np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, np.where(above, self.right[at], self.left[at]), at)

    def least_score(self, at_least: dict[int, float]) -> float:
        """A lower bound of the score of anything whose features are at least these: each tree's least leaf within reach."""
        total = self.base
        for root in self.roots:
            low, todo = np.inf, [root]
            while todo:
                k = todo.pop()
                if self.feature[k] < 0:
                    low = min(low, self.value[k])
                else:
                    todo.append(self.right[k])
                    if not at_least.get(int(self.feature[k]), -np.inf) > self.cut[k]:
                        todo.append(self.left[k])
            total += low
        return total


def fit_trees(x: np.ndarray, y: np.ndarray, monotonic: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10) -> Trees:
    """Squared-error boosting on quantile bins. A split against a constraint is refused, and the means of its sides
    bound all leaves below them, so the whole model is monotonic."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    nodes: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}
    base, roots = float(y.mean()), []
    fitted = np.full(len(y), base)

    def grow(rows: np.ndarray, residual: np.ndarray, level: int, low: float, high: float) -> int:
        k = len(nodes["feature"])
        mean = float(np.clip(residual[rows].mean(), low, high))
        for name, v in (("feature", -1), ("cut", 0.0), ("left", k), ("right", k), ("value", rate * mean)):
            nodes[name].append(v)
        best = (1e-9, -1, -1, 0.0, 0.0)
        if level < depth and len(rows) >= 2 * least:
            r = residual[rows]
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                count = np.bincount(binned[rows, f], minlength=len(c) + 1).cumsum()[:-1]
                total = np.bincount(binned[rows, f], r, minlength=len(c) + 1).cumsum()[:-1]
                ok = (count >= least) & (len(rows) - count >= least)
                a = np.clip(total / np.maximum(count, 1), low, high)
                b = np.clip((r.sum() - total) / np.maximum(len(rows) - count, 1), low, high)
                if monotonic[f]:
                    ok &= (b - a) * monotonic[f] >= 0
                gain = np.where(ok, count * a**2 + (len(rows) - count) * b**2 - len(rows) * mean**2, -1)
                g = int(gain.argmax())
                if gain[g] > best[0]:
                    best = (float(gain[g]), f, g, float(a[g]), float(b[g]))
        _, f, g, a, b = best
        if f >= 0:
            right = binned[rows, f] > g
            middle = (a + b) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(monotonic[f])]
            nodes["feature"][k], nodes["cut"][k] = f, float(cuts[f][g])
            nodes["left"][k] = grow(rows[~right], residual, level + 1, *bounds[0])
            nodes["right"][k] = grow(rows[right], residual, level + 1, *bounds[1])
        return k

    for _ in range(rounds):
        roots.append(grow(np.arange(len(y)), y - fitted, 0, -np.inf, np.inf))
        only = Trees(0.0, {k: np.array(v) for k, v in nodes.items()}, np.array(roots[-1:]))
        fitted += only.score(x)
    return Trees(base, {k: np.array(v) for k, v in nodes.items()}, np.array(roots))


def synthetic(n: int = 3000, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and exact shares of made-up documents: random words into which runs of earlier words are copied."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(n):
        size, vocab = int(rng.integers(5, 500)), int(rng.integers(20, 2000))
        text = list(rng.zipf(1.4, size) % vocab) if rng.random() < 0.5 else list(rng.integers(0, vocab, size))
        wanted, copied = rng.random() * size * (rng.random() < 0.7), 0
        while copied < wanted:
            run = int(rng.choice([1, 3, 6, 7, 12, 30, 80]))
            at = int(rng.integers(0, len(text)))
            piece = text[at : at + run] * int(rng.integers(1, 4))
            put = int(rng.integers(at, len(text) + 1))
            text[put:put] = piece
            copied += len(piece)
        texts.append(text)
    sizes = np.array([len(t) for t in texts])
    codes = np.concatenate(texts).astype(np.uint64)
    return statistics(codes, sizes), shares(codes, sizes)


@lru_cache(1)
def model() -> Trees:
    """Fitted in about a second on made-up documents, so it is the same for every input."""
    return fit_trees(*synthetic(), MONOTONIC)


def bound(trees: Trees, limit: float) -> float:
    """The least score that a document with this share can have."""
    return trees.least_score({k: limit * (WINDOW - k) / WINDOW for k in range(3)}) - 1e-9


# ---- the operator ---------------------------------------------------------------------------------------------


def _scorer(trees: Trees, limit: float | None):
    """Arrow UDF: text -> struct of word count, exact share (null where the score rules ``limit`` out) and score."""
    least = -np.inf if limit is None else bound(trees, limit)

    @F.arrow_udf("struct<n_words: int, share: double, score: double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for _, codes, sizes in word_hashes(texts):
                got = trees.score(statistics(codes, sizes))
                share = np.full(len(sizes), np.nan)
                chosen = got >= least
                share[chosen] = shares(codes[np.repeat(chosen, sizes)], sizes[chosen])
                parts.append((sizes, share, got))
            sizes, share, got = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0),) * 3
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(share, pa.float64(), mask=np.isnan(share)), pa.array(got, pa.float64())], ["n_words", "share", "score"])

    return score


def repetition(df: DataFrame, key: str = "parsed_id", text: str = "text", limit: float | None = None) -> DataFrame:
    """``key``, n_words, share, score of each document. With ``limit``, share is null where the trees rule it out that the share reaches ``limit``."""
    return df.select(F.col(key), _scorer(model(), limit)(F.col(text)).alias("r")).select(key, "r.*")


def found(df: DataFrame, least_words: int = 30, least_share: float = 0.4) -> DataFrame:
    return repetition(df, limit=least_share).where((F.col("n_words") >= least_words) & (F.col("share") >= least_share)).select("parsed_id").distinct()
