"""Which language a paragraph is in, learned from the documents' own labels.

A naive Bayes model over the character n-grams of words: of each language how often each n-gram occurs in the words of
the documents that carry its label. Labels may be wrong for a part of the documents, as long as a language's n-grams are
relatively more frequent under its own label than under others.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable
from math import log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import prose

ENGLISH = "en"
#: Most labelled documents the model is fitted on: about so many, by a hash of the key. Longer texts are not taken for it.
MOST_LABELLED, LONGEST_LABELLED = 3_000, 20_000
#: A label needs so many documents to be a language of the model.
LEAST_DOCUMENTS = 8
#: Share of each n-gram's probability that is the same in all languages, so that one that was never seen decides nothing.
SHARED = 0.02
LONGEST_GRAM = 3
#: Letters of a word that are looked at; scripts without spaces have words as long as a sentence, which are cut into several.
PIECE = 30


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in range(1, LONGEST_GRAM + 1) for i in range(len(w) - n + 1) if w[i : i + n] != " "]


class Languages:
    """score(word): the log probability of a word in each language, from which paragraphs are summed."""

    def __init__(self, counts: dict[str, Counter]):
        self.names = sorted(counts)
        self.english = self.names.index(ENGLISH)
        total = Counter()
        for c in counts.values():
            total.update(c)
        everything = sum(total.values())
        sums = [sum(counts[k].values()) for k in self.names]
        self.log = {
            g: np.array([log((1 - SHARED) * counts[k][g] / n + SHARED * t / everything) for k, n in zip(self.names, sums, strict=True)], np.float32) for g, t in total.items()
        }
        self.none = np.zeros(len(self.names), np.float32)

    def score(self, word: str) -> np.ndarray:
        known = self.log
        out = self.none.copy()
        for i in range(0, len(word), PIECE):
            for g in grams(word[i : i + PIECE]):
                if g in known:
                    out += known[g]
        return out

    def is_english(self, low: list[str]) -> bool:
        return int(np.argmax(sum((self.score(w) for w in low), self.none))) == self.english


def fit(labelled: Iterable[tuple[str, str | None]]) -> Languages | None:
    """From texts and their labels; None where there are not two languages, one of them English, with LEAST_DOCUMENTS each."""
    words: dict[str, Counter] = defaultdict(Counter)
    docs: Counter = Counter()
    for text, label in labelled:
        name = (label or "").strip().lower()
        if not name or name == "und" or not text:
            continue
        docs[name] += 1
        words[name].update(w.lower() for w in prose.WORD.findall(prose.plain_text(text)))
    names = [k for k, n in docs.items() if n >= LEAST_DOCUMENTS and words[k]]
    if ENGLISH not in names or len(names) < 2:
        return None
    counts: dict[str, Counter] = {}
    for k in names:
        counts[k] = Counter()
        for w, n in words[k].items():
            for i in range(0, len(w), PIECE):
                for g in grams(w[i : i + PIECE]):
                    counts[k][g] += n
    return Languages(counts)


def labelled_sample(documents: DataFrame, most: int = MOST_LABELLED, longest: int = LONGEST_LABELLED) -> list[tuple[str, str | None, str | None]]:
    """(text, lang, source) of about ``most`` documents at most, in the order of their key; null columns where the table has none."""
    column = lambda c: F.col(c).cast("string") if c in documents.columns else F.lit(None).cast("string")
    rows = documents.select("doc_id", F.col("text"), column("lang").alias("lang"), column("source").alias("source"))
    n = documents.count()
    if n > most:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < most)
    return [(r.text, r.lang, r.source) for r in rows.filter(F.col("text").isNotNull() & (F.length("text") <= longest)).orderBy("doc_id", "text").collect()]
