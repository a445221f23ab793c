"""Reading level by gradient-boosted regression trees over length, vocabulary, syntax and cohesion.

The trees are trained on windows of the graded samples, and their predictions are calibrated on predictions for
samples that were held out. A document is cut into windows of its own English prose; its grade is a smooth median
of its windows' grades, weighted by words, so that most of the prose decides.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import bpe, language, prose
from tidewell.llm.language import Languages

LEAST_WORDS = 20
#: Most labelled rows the trees are trained on; beyond it a sample by hash of the key, of about this size.
MOST_SAMPLES = 20_000
#: Words of the windows that the samples are cut into, one cut after the other.
TRAINED_ON = (25, 40, 60, 90, 130)
#: Width over which a window counts to both sides of the median.
BLUR = 0.25
VOWELS = re.compile(r"[aeiouy]+")
#: Chosen by hand, for the features: endings of learned words, and words that join clauses or sentences.
LEARNED = ("tion", "sion", "ity", "ism", "ness", "ment", "ance", "ence", "ical", "ious", "eous", "ially", "ally", "ively", "ology", "isation", "ization", "ability", "ous", "ive", "ate")
SUBORDINATE = frozenset("which whose whom that although though because unless whereas while whether if until since insofar inasmuch provided where when lest notwithstanding".split())
CONNECT = frozenset("however therefore consequently conversely moreover furthermore nevertheless thus hence accordingly whereby thereby notwithstanding insofar inasmuch irrespective subsequent albeit".split())
SIMPLE_JOIN = frozenset("and but so then or".split())
PERSON = frozenset("i you my your we our me it she he they her his".split())
PASSIVE = frozenset("is are was were be been being".split())
CLOSED = prose.ENGLISH | SUBORDINATE | CONNECT | PERSON | PASSIVE


CONTENT, LEARN, SUB, CON, JOIN, PERS, PASS, THE, OF, A, WHICH, THAT, LY = (1 << k for k in range(13))


def word_kind(w: str) -> tuple[int, int, int]:
    """Length, syllables and kinds of a word in lower case."""
    content = w not in CLOSED
    kinds = (
        CONTENT * content | LEARN * (content and len(w) >= 7 and w.endswith(LEARNED)) | SUB * (w in SUBORDINATE) | CON * (w in CONNECT) | JOIN * (w in SIMPLE_JOIN)
        | PERS * (w in PERSON) | PASS * (w in PASSIVE) | THE * (w == "the") | OF * (w == "of") | A * (w in ("a", "an")) | WHICH * (w == "which") | THAT * (w == "that") | LY * w.endswith("ly")
    )
    return len(w), max(1, len(VOWELS.findall(w[:-1] if w.endswith("e") else w))), kinds


def quantile(value: np.ndarray, first: np.ndarray, n: np.ndarray, q: float) -> np.ndarray:
    """Of values sorted within groups that begin at first and have n members; 0 for an empty group."""
    if not len(value):
        return np.zeros(len(n))
    at = q * np.maximum(n - 1, 0)
    low = np.minimum(first + at.astype(np.int64), len(value) - 1)
    high = np.minimum(first + np.ceil(at).astype(np.int64), len(value) - 1)
    return np.where(n > 0, value[low] + (value[high] - value[low]) * (at - np.floor(at)), 0.0)


class Words(dict):
    """Numbers of words, given as they come, and what the features take from each: its number in lower case, its length,
    syllables and kinds, and, with a model, its score in each language. Kept from batch to batch, up to a number of words."""

    def __init__(self, languages: Languages | None = None):
        self.languages = languages
        self.lower: dict[str, int] = {}
        self.low_of: list[int] = []
        self.kinds: list[tuple[int, int, int]] = []
        self.scores: list[np.ndarray] = []
        self._tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.low_of)
        low = word.lower()
        k = self.lower.get(low)
        if k is None:
            k = self.lower[low] = len(self.kinds)
            self.kinds.append(word_kind(low))
            if self.languages:
                self.scores.append(self.languages.score(low))
        self.low_of.append(k)
        return n

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """low_of by number; kinds and scores by number in lower case."""
        if self._tables is None or len(self._tables[0]) != len(self.low_of):
            scores = np.stack(self.scores) if self.scores else np.zeros((len(self.kinds), 1), np.float32)
            self._tables = np.array(self.low_of, np.int64), np.array(self.kinds, np.int64).reshape(-1, 3), scores
        return self._tables


def marks(sentence: str) -> tuple[int, int, int]:
    """Commas, other signs between clauses, and question marks of a sentence."""
    return sentence.count(","), sentence.count(";") + sentence.count(":") + sentence.count(" - ") + sentence.count("—"), sentence.count("?")


def features(windows: list[tuple[list[str], list[list[str]]]]) -> np.ndarray:
    """One row for each window of sentences."""
    words = Words()
    ids = np.array([words[w] for _, sents in windows for ws in sents for w in ws], np.int64)
    low, kinds, _ = words.tables()
    signs = np.array([marks(s) for sents, _ in windows for s in sents], np.int64).reshape(-1, 3)
    return window_features(low[ids], kinds, np.array([len(ws) for _, sents in windows for ws in sents], np.int64), signs, np.array([len(sents) for _, sents in windows], np.int64))


def window_features(word: np.ndarray, kinds: np.ndarray, length: np.ndarray, signs: np.ndarray, n_sent: np.ndarray) -> np.ndarray:
    """All windows together, as columns of words and sentences: the words by number and what is known of each number, the
    words and marks of each sentence, the sentences of each window."""
    g, many = len(n_sent), max(1, len(kinds))
    size, syllables, kind = (kinds[word, k] for k in range(3))
    sent_win = np.repeat(np.arange(g), n_sent)
    sent = np.repeat(np.arange(len(length)), length)
    win = sent_win[sent]
    n = np.bincount(win, minlength=g)
    first, first_sent = np.cumsum(n) - n, np.cumsum(n_sent) - n_sent

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(win, x, g) / n

    def share(k: int) -> np.ndarray:
        return mean((kind & k) > 0)

    def deviation(x: np.ndarray, m: np.ndarray, group: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.sqrt(np.bincount(group, (x - m[group]) ** 2, g) / count)

    ordered = size[np.lexsort((size, win))].astype(float)
    content = (kind & CONTENT) > 0
    c_win, c_size = win[content], size[content].astype(float)
    c_n = np.bincount(c_win, minlength=g)
    c_first = np.cumsum(c_n) - c_n
    c_ordered = c_size[np.lexsort((c_size, c_win))]
    c_some = np.maximum(c_n, 1)
    l_ordered = length[np.lexsort((length, sent_win))].astype(float)
    size_mean, length_mean, syllables_mean = mean(size), np.bincount(sent_win, length, g) / n_sent, mean(syllables)
    depth = np.bincount(sent, (kind & SUB) > 0, len(length))

    # content words that neighbouring sentences share, as a part of those of either
    distinct = np.unique(sent[content] * np.int64(many) + word[content])
    d_sent = distinct // many
    per_sent = np.bincount(d_sent, minlength=len(length))
    both = np.bincount(np.intersect1d(distinct + many, distinct, assume_unique=True) // many, minlength=len(length))[: len(length)]
    later = np.r_[False, sent_win[1:] == sent_win[:-1]]
    either = np.maximum(per_sent + np.r_[0, per_sent[:-1]] - both, 1)
    shared = np.bincount(sent_win, np.where(later, both / either, 0), g) / np.maximum(n_sent - 1, 1)
    types = np.bincount(np.unique(win * np.int64(many) + word) // many, minlength=g)

    commas = np.maximum.reduceat(signs[:, 0], first_sent)
    clauses = np.bincount(sent_win, signs[:, 0] + signs[:, 1], g)
    asked = np.bincount(sent_win, signs[:, 2], g)
    return np.stack(
        [
            np.log(n), size_mean, quantile(ordered, first, n, 0.5), deviation(size, size_mean, win, n), mean(size >= 7), mean(size >= 10), mean(size >= 12), quantile(ordered, first, n, 0.9),
            syllables_mean, mean(syllables >= 3), mean(syllables >= 4), mean(syllables >= 5),
            np.bincount(c_win, c_size, g) / c_some, quantile(c_ordered, c_first, c_n, 0.5), quantile(c_ordered, c_first, c_n, 0.25), quantile(c_ordered, c_first, c_n, 0.75), np.bincount(win, (kind & LEARN) > 0, g) / c_some,
            length_mean, quantile(l_ordered, first_sent, n_sent, 0.5), quantile(l_ordered, first_sent, n_sent, 1.0), quantile(l_ordered, first_sent, n_sent, 0.0), deviation(length, length_mean, sent_win, n_sent),
            clauses / n, clauses / n_sent, commas,
            share(SUB), np.maximum.reduceat(depth, first_sent), np.bincount(sent_win, depth, g) / n_sent, share(CON),
            share(JOIN), share(PERS), share(PASS),
            c_n / n, types / n, share(THE), share(OF), share(A), share(WHICH), share(THAT),
            asked / n_sent, shared, share(LY), mean(size <= 3),
            206.835 - 1.015 * length_mean - 84.6 * syllables_mean, 0.39 * length_mean + 11.8 * syllables_mean - 15.59,
        ],
        axis=1,
    )


@dataclass
class Trees:
    """Boosted regression trees of fixed depth over binned features."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, leaves)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:  # all rows are at the same depth
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 300, depth: int = 3, rate: float = 0.05, bins: int = 32, least: float = 8.0, seed: int = 7) -> Trees:
    """Least squares; each tree sees a random half of the features and four fifths of the rows."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], axis=1)
    random = np.random.default_rng(seed)
    base = float(np.average(y, weights=weight))
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    guess = np.full(n, base)
    for t in range(trees):
        cols = random.permutation(m)[: max(1, m // 2)]
        w = weight * (random.random(n) < 0.8)
        rest = y - guess
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2**level - 1
            for node in range(first, 2 * first + 1):
                rows = np.flatnonzero(at == node)
                if len(rows):
                    keys = (np.arange(len(cols)) * bins + binned[np.ix_(rows, cols)]).ravel()
                    total = np.repeat(w[rows], len(cols))
                    cw = np.bincount(keys, total, len(cols) * bins).reshape(-1, bins).cumsum(axis=1)
                    cs = np.bincount(keys, total * np.repeat(rest[rows], len(cols)), len(cols) * bins).reshape(-1, bins).cumsum(axis=1)
                    a, b = cw[:, :-1], cw[:, -1:] - cw[:, :-1]
                    with np.errstate(all="ignore"):
                        gain = np.where((a >= least) & (b >= least), cs[:, :-1] ** 2 / a + (cs[:, -1:] - cs[:, :-1]) ** 2 / b - cs[:, -1:] ** 2 / cw[:, -1:], -np.inf)
                    j, k = np.unravel_index(np.argmax(gain), gain.shape)
                    c = cols[j]
                    if gain[j, k] > 1e-12 and k < len(cuts[c]):
                        feature[t, node], cut[t, node] = c, cuts[c][k]
                at[rows] = 2 * node + 1 + (x[rows, feature[t, node]] > cut[t, node])
        place = at - inner
        s, v = np.bincount(place, w * rest, leaves), np.bincount(place, w, leaves)
        leaf[t] = rate * s / (v + 1.0)
        guess += leaf[t][place]
    return Trees(base, feature, cut, leaf)


@dataclass
class Model:
    """trees, and the calibration: held-out predictions in ascending order with the grades they stand for."""

    trees: Trees
    raw: np.ndarray
    graded: np.ndarray
    held_out: dict[str, float]
    by_source: dict[str, tuple[int, float]]

    def grade(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.predict(x), self.raw, self.graded)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising fit of y on x, as a few points to interpolate between."""
    o = np.argsort(x, kind="stable")
    stack: list[list[float]] = []  # mean x, mean y, weight
    for a, b, c in zip(x[o], y[o], w[o], strict=True):
        stack.append([a, b, c])
        while len(stack) > 1 and stack[-2][1] >= stack[-1][1]:
            p, q = stack.pop(), stack.pop()
            s = p[2] + q[2]
            stack.append([(p[0] * p[2] + q[0] * q[2]) / s, (p[1] * p[2] + q[1] * q[2]) / s, s])
    return np.array([s[0] for s in stack]), np.array([s[1] for s in stack])


def train(samples: list[tuple[str | None, int | None]], folds: int = 5, sources: list[str] | None = None, apart: bool = False) -> Model:
    """From graded texts; texts without prose or grade are left out. sources: of each text, for the figures by source;
    apart: whether all texts of a source are held out together, instead of ``folds`` parts by chance.

    held_out: mean error and share of right grades of whole texts, each predicted by trees and a calibration that have
    seen neither it nor any other text of its fold. The calibration that is kept is fitted on all held-out predictions.
    """
    x, y, text, weight = [], [], [], []
    for k, (t, g) in enumerate(samples):
        if not t or g is None:
            continue
        for s, w in [(s, w) for size in TRAINED_ON for s, w, _ in prose.windows(t, size)]:
            x.append((s, w))
            y.append(float(g))
            text.append(k)
            weight.append(sum(map(len, w)))
    if not x:
        raise ValueError("no graded text with prose")
    xs, ys, ks, ws = features(x), np.array(y), np.array(text), np.array(weight, float)
    ws /= ws.mean()
    raw = np.zeros(len(ys))
    of_text = np.random.default_rng(11).permutation(len(samples)) % folds  # the samples may be ordered by grade
    if apart and sources:
        of_text = np.unique(sources, return_inverse=True)[1]
    fold = of_text[ks]
    for f in np.unique(fold):
        on = fold != f
        if on.any():
            raw[~on] = boost(xs[on], ys[on], ws[on]).predict(xs[~on])
    calibrated = raw.copy()
    for f in np.unique(fold):
        on = fold != f
        if on.any():
            calibrated[~on] = np.interp(raw[~on], *isotonic(raw[on], ys[on], ws[on]))
    _, first, owner = np.unique(ks, return_index=True, return_inverse=True)
    whole = np.stack([smooth_median(calibrated, ws, owner, len(first)), ys[first]], axis=1)
    error = np.abs(whole[:, 0] - whole[:, 1])
    held_out = {"mean_error": float(error.mean()), "right": float((error < 0.5).mean()), "upper_right": float(((whole[:, 0] >= 3.5) == (whole[:, 1] >= 3.5)).mean())}
    by_source: dict[str, tuple[int, float]] = {}
    if sources:
        of = np.array(sources)[ks[first]]
        by_source = {str(k): (int((of == k).sum()), float(error[of == k].mean())) for k in np.unique(of)}
    return Model(boost(xs, ys, ws), *isotonic(raw, ys, ws), held_out, by_source)


def nearest_sources(texts: list[str | None], documents: list[tuple[str | None, str | None]]) -> list[str]:
    """Of each text the source whose documents' words make it likeliest: the samples carry no source of their own."""
    words: dict[str, Counter] = defaultdict(Counter)
    for text, source in documents:
        if text and source:
            words[source].update(w.lower() for w in prose.WORD.findall(text))
    sums = {k: sum(c.values()) for k, c in words.items()}
    total = Counter()
    for c in words.values():
        total.update(c)
    every = sum(total.values())
    out = []
    for t in texts:
        own = Counter(w.lower() for w in prose.WORD.findall(t or ""))
        like = {k: sum(n * np.log(0.9 * words[k][w] / sums[k] + 0.1 * (total[w] + 0.5) / every) for w, n in own.items()) for k in sorted(words)}
        out.append(max(like, key=like.get) if like else "")
    return out


def smooth_median(value: np.ndarray, weight: np.ndarray, owner: np.ndarray, groups: int) -> np.ndarray:
    """Of each group the value that as much weight lies above as below, where a value near it counts in part to both sides.

    So a window whose grade is in doubt decides less than one whose grade is clear. NaN for an empty group.
    """
    total = np.bincount(owner, weight, groups)
    lo, hi = np.zeros(groups), np.full(groups, 6.0)
    for _ in range(24):
        mid = (lo + hi) / 2
        above = np.bincount(owner, weight / (1 + np.exp((mid[owner] - value) / BLUR)), groups)
        up = above > total / 2
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return np.where(total > 0, (lo + hi) / 2, np.nan)


def graded_texts(samples: DataFrame) -> list[tuple[str | None, int | None]]:
    """(text, grade) of about MOST_SAMPLES samples at most, in the order of sample_id."""
    n = samples.count()
    rows = samples if n <= MOST_SAMPLES else samples.filter(F.pmod(F.xxhash64("sample_id"), F.lit(n)) < MOST_SAMPLES)
    return [(r.text, r.grade) for r in rows.orderBy("sample_id").select("text", "grade").collect()]


def trained(samples: DataFrame) -> Model | None:
    """samples: text, grade, sample_id. None without any graded text."""
    graded = graded_texts(samples)
    return train(graded) if any(t and t.strip() and g is not None for t, g in graded) else None


def validation(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """(source, folds, n_samples, mean_error): the error of held-out, calibrated grades of the samples by the source whose
    documents they are nearest to, once held out by chance and once with all samples of a source together.

    The samples carry no source, and the nearest one goes with their grade, so the second takes whole grades from the
    training; it says how far the trees carry beyond what they saw. No rows without graded samples.
    """
    graded = graded_texts(samples)
    rows = []
    if any(t and t.strip() and g is not None for t, g in graded):
        nearest = nearest_sources([t for t, _ in graded], [(t, s) for t, _, s in language.labelled_sample(documents)])
        for name, apart in (("by chance", False), ("by source", True)):
            rows += [(k, name, n, e) for k, (n, e) in sorted(train(graded, sources=nearest, apart=apart).by_source.items())]
    return documents.sparkSession.createDataFrame(rows, "source string, folds string, n_samples int, mean_error double")


#: Words that are kept from batch to batch; beyond it they are learned anew.
KEPT_WORDS = 300_000


class Grader:
    """Grades batches of texts; once in each task."""

    def __init__(self, model: Model | None, languages: Languages | None, least_words: int):
        self.model, self.languages, self.least_words = model, languages, least_words
        self.words = Words(languages)

    def grade(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The grade of each text (NaN: none), and the words of its English prose."""
        if len(self.words) > KEPT_WORDS:
            self.words = Words(self.languages)
        number = self.words.__getitem__
        ids: list[int] = []
        length: list[int] = []
        signs: list[tuple[int, int, int]] = []
        paragraph_sents: list[int] = []
        text_paragraphs = np.zeros(len(texts), np.int64)
        rule: list[bool] = []
        for i, t in enumerate(texts):
            split = prose.paragraphs(t) if t else []
            text_paragraphs[i] = len(split)
            for p in split:
                paragraph_sents.append(len(p))
                for s, ws in p:
                    ids.extend(map(number, ws))
                    length.append(len(ws))
                    signs.append(marks(s))
                if not self.languages:
                    rule.append(prose.is_english([w.lower().replace("’", "'") for _, ws in p for w in ws]))
        grade, words = np.full(len(texts), np.nan), np.zeros(len(texts), np.int64)
        if not length:
            return grade, words
        low, kinds, scores = self.words.tables()
        word, size, in_paragraph = low[np.array(ids, np.int64)], np.array(length, np.int64), np.array(paragraph_sents, np.int64)
        first_sent, first_word = np.cumsum(in_paragraph) - in_paragraph, np.cumsum(size) - size
        english = np.array(rule, bool)
        if self.languages:
            english = np.add.reduceat(scores[word], first_word[first_sent], axis=0).argmax(axis=1) == self.languages.english
        sent_text = np.repeat(np.repeat(np.arange(len(texts)), text_paragraphs), in_paragraph)
        sent_english = np.repeat(english, in_paragraph)
        words = np.bincount(sent_text[sent_english], size[sent_english], len(texts)).astype(np.int64)
        other = np.bincount(sent_text[~sent_english], size[~sent_english], len(texts))
        # texts that get no grade need no windows
        wanted = words >= np.maximum(self.least_words, other)
        bounds = np.searchsorted(sent_text, np.arange(len(texts) + 1))
        sizes, own = size.tolist(), sent_english.tolist()
        found = [(a + p, a + q, i) for i in np.flatnonzero(wanted) for a, z in [(int(bounds[i]), int(bounds[i + 1]))] for p, q in prose.group(sizes[a:z], own[a:z]) if own[a + p]]
        if found and self.model:
            a, z, owner = (np.array(v, np.int64) for v in zip(*found, strict=True))
            sents = np.repeat(a - np.cumsum(z - a) + (z - a), z - a) + np.arange(int((z - a).sum()))
            n = size[sents]
            at = np.repeat(first_word[sents] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            x = window_features(word[at], kinds, n, np.array(signs, np.int64)[sents], z - a)
            in_window = np.add.reduceat(n, np.cumsum(z - a) - (z - a))
            grade = np.where(wanted, smooth_median(self.model.grade(x), in_window, owner, len(texts)), np.nan)
        return grade, words


def reading_grades(documents: DataFrame, samples: DataFrame, least_words: int = LEAST_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, grade, n_words and the columns carry): grade (1 to 5, not whole) of each document's own English prose;
    n_words of it.

    grade is null for null, empty and blank texts, for texts with fewer than least_words words of prose, and for
    texts of which less than half of the prose is English. Code, logs, tables, quotes, links and markup do not
    count. Texts are read whole. One row for each row; other columns are ignored. Without samples all grades are null.
    Languages are learned from the column lang, of which a part may be wrong, on the bounded sample of
    language.labelled_sample; where it has no two languages with labels, paragraphs are judged by function words.
    """
    labelled = language.labelled_sample(documents)
    languages = language.fit((t, label) for t, label, _ in labelled)
    model = trained(samples)
    held = {c: documents.schema[c].dataType.simpleString() for c in carry}
    sent = documents.sparkSession.sparkContext.broadcast((model, languages))  # bounded by the samples' sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grader = Grader(*sent.value, least_words)
        for b in batches:
            for at, texts in bpe.text_pieces(b, "text"):
                grade, words = grader.grade(texts)
                columns = [b.column("doc_id").slice(at, len(texts)), pa.array(grade, mask=np.isnan(grade)), pa.array(words), *[b.column(c).slice(at, len(texts)) for c in held]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "grade", "n_words", *held])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *held)
    return bpe.spread(rows).mapInArrow(run, ", ".join(["doc_id bigint, grade double, n_words bigint", *[f"`{c}` {t}" for c, t in held.items()]]))


def demanding(documents: DataFrame, samples: DataFrame, least_grade: float = 3.5) -> DataFrame:
    """(doc_id) of the documents whose own prose is of grade 4 or 5."""
    return reading_grades(documents, samples).filter(F.col("grade") >= least_grade).select("doc_id")


def profile(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """(source, grade, docs, words) of the documents that have a grade, rounded to a whole one."""
    g = reading_grades(documents, samples, carry=("source",)).filter("grade is not null").withColumn("grade", F.round("grade").cast("int"))
    return g.groupBy("source", "grade").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_words").alias("words"))
