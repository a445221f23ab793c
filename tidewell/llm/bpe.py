"""Byte-level BPE of a whole corpus by an index of pair occurrences.

The words of a batch of texts are encoded together, each distinct word once: their bytes lie in one array with
links to the next and previous symbol, and an index maps each pair that can be merged to all its positions.
The ranks that occur are applied in ascending order; a merge touches only the pairs beside it, which enter the
index under their own ranks. A merge list ranks every pair below the pairs it is built from, so the order
within each word is the same as if it were encoded alone.
"""

from __future__ import annotations

import heapq
import json
import os
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the vocabulary files.
TOKENIZERS = "/opt/tokenizers"
#: Fixed values of byte-level BPE: how text is split into words before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words that are kept from batch to batch; beyond it the store is emptied.
KEPT_WORDS = 300_000
#: Characters from which a text is encoded in parts, cut between words.
LONG_TEXT = 8_000_000
PAIR = 1 << 20


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, spare = [], 256
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class PairBPE:
    """Encoder of one byte-level vocabulary file with a merge list."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.first = [vocab[c] for c in byte_symbols()]
        self.left = [vocab[a] for a, _ in pairs]
        self.right = [vocab[b] for _, b in pairs]
        self.made = [vocab[a + b] for a, b in pairs]
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(zip(self.left, self.right, strict=True)):
            self.rank.setdefault(a * PAIR + b, r)
        self.vocab = vocab
        self.split = regex.compile(SPLIT).findall
        self.words: dict[str, tuple[int, ...]] = {}

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each of the distinct words, by one pair index for all."""
        first, rank = self.first, self.rank
        symbol: list[int] = [-1]  # -1: edge of a word
        start: list[int] = []
        for w in words:
            start.append(len(symbol))
            symbol.extend([first[b] for b in w.encode("utf-8", "replace")])
            symbol.append(-1)
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        at: dict[int, list[int]] = {}
        get = rank.get
        previous = -1
        for i, s in enumerate(symbol):
            if s >= 0 and previous >= 0 and (r := get(previous * PAIR + s)) is not None:
                if (positions := at.get(r)) is None:
                    at[r] = [i - 1]
                else:
                    positions.append(i - 1)
            previous = s
        active = list(at)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, new = self.left[r], self.right[r], self.made[r]
            for i in sorted(at.pop(r)):
                if symbol[i] != a:
                    continue
                j = after[i]
                if symbol[j] != b:
                    continue
                k, h = after[j], before[i]
                symbol[i], symbol[j] = new, -2  # -2: part of the symbol before it
                after[i] = k
                before[k] = i
                if (s := symbol[h]) >= 0 and (q := get(s * PAIR + new)) is not None:
                    if (positions := at.get(q)) is None:
                        at[q] = [h]
                        heapq.heappush(active, q)
                    else:
                        positions.append(h)
                if (s := symbol[k]) >= 0 and (q := get(new * PAIR + s)) is not None:
                    if (positions := at.get(q)) is None:
                        at[q] = [i]
                        heapq.heappush(active, q)
                    else:
                        positions.append(i)
        out = []
        for i in start:
            ids = []
            while symbol[i] != -1:
                ids.append(symbol[i])
                i = after[i]
            out.append(tuple(ids))
        return out

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids of each text; of an empty or null text none."""
        texts = list(texts)
        if any(t and len(t) > LONG_TEXT for t in texts):
            return [x for t in texts for x in ([self.encode_long(t)] if t and len(t) > LONG_TEXT else self.encode([t]))]
        split = [self.split(t) if t else [] for t in texts]
        known = self.words
        new = list(dict.fromkeys(w for words in split for w in words if w not in known))
        if len(known) + len(new) > KEPT_WORDS:
            known.clear()
            new = list(dict.fromkeys(chain.from_iterable(split)))
        known.update(zip(new, self.encode_words(new), strict=True))
        ids = known.__getitem__
        out = [list(chain.from_iterable(map(ids, words))) for words in split]
        if len(known) > KEPT_WORDS:
            known.clear()
        return out

    @cached_property
    def bytes_of(self) -> dict[int, bytes]:
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        return {i: bytes(byte_of[c] for c in t) for t, i in self.vocab.items() if all(c in byte_of for c in t)}

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def encode_long(self, text: str) -> list[int]:
        """A very long text, some words at a time."""
        found = (m.group() for m in regex.finditer(SPLIT, text))
        out = array("i")
        while words := list(islice(found, LONG_TEXT // 8)):
            new = [w for w in dict.fromkeys(words) if w not in self.words]
            if len(self.words) + len(new) > KEPT_WORDS:
                self.words.clear()
                new = list(dict.fromkeys(words))
            self.words.update(zip(new, self.encode_words(new), strict=True))
            out.extend(chain.from_iterable(map(self.words.__getitem__, words)))
        return out


@lru_cache(maxsize=4)
def encoder(name: str, folder: str = TOKENIZERS) -> Callable[[Iterable[str | None]], list[list[int]]]:
    """encode(texts) of a public tokenizer, without special tokens; once in each Python worker.

    Byte-level vocabularies with a merge list are encoded by PairBPE; the other kinds by their library.
    """
    if folder == TOKENIZERS and not os.path.isdir(folder):  # where the files are only there as a package
        import public_tokenizers

        folder = os.path.dirname(public_tokenizers.__file__)
    path = os.path.join(folder, name)
    if os.path.exists(f"{path}.json"):
        with open(f"{path}.json", encoding="utf-8") as f:
            head = json.load(f)
        pre = head.get("pre_tokenizer") or {}
        # the split that PairBPE makes: the usual pattern, and no space in front of a text
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not head.get("normalizer"):
            return PairBPE(f"{path}.json").encode
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(f"{path}.json")
        t.encode_special_tokens = True
        return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    if os.path.exists(f"{path}.tiktoken"):
        import base64

        import tiktoken

        with open(f"{path}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding(name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [e.encode_ordinary(x or "") for x in texts]
    if os.path.exists(f"{path}.model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=f"{path}.model")
        return lambda texts: [p.encode(x or "", num_threads=1) for x in texts]
    raise FileNotFoundError(f"no tokenizer {name} in {folder}")


#: Characters of text that are encoded together.
BATCH_CHARS = 4_000_000


def text_pieces(b: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str | None]]]:
    """Cuts a batch so that no piece has many more than BATCH_CHARS characters (or one text)."""
    texts = b.column(column).to_pylist()
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BATCH_CHARS:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores is dealt out to all; larger ones stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(3 * cores)


def encode_corpus(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids): the token ids of each text, one row for each row of documents; other columns are ignored.

    A null or empty text has an empty list. Text that looks like a special token is ordinary text. Texts of any
    length are encoded whole. An empty table gives no rows.
    """
    schema = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, folder)
        for b in batches:
            for at, texts in text_pieces(b, "text"):
                ids = encode(texts)
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column("key").slice(at, len(texts)), lists], schema=schema)

    out = spread(documents.selectExpr(f"cast(`{key}` as bigint) as key", f"`{text}` as text")).mapInArrow(run, "key bigint, ids array<int>")
    return out.withColumnRenamed("key", key)


def token_counts(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens), as encode_corpus counts them."""
    schema = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, folder)
        for b in batches:
            for at, texts in text_pieces(b, "text"):
                yield pa.RecordBatch.from_arrays([b.column("key").slice(at, len(texts)), pa.array([len(i) for i in encode(texts)], pa.int64())], schema=schema)

    out = spread(documents.selectExpr(f"cast(`{key}` as bigint) as key", f"`{text}` as text")).mapInArrow(run, "key bigint, n_tokens bigint")
    return out.withColumnRenamed("key", key)


def round_trip(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, same): whether the ids of a text, read back, give the text; a null text counts as empty. For vocabularies that
    PairBPE encodes."""
    schema = pa.schema([("key", pa.int64()), ("same", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, folder)
        for b in batches:
            for at, texts in text_pieces(b, "text"):
                same = [encode.__self__.decode(ids) == (t or "") for ids, t in zip(encode(texts), texts, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("key").slice(at, len(texts)), pa.array(same, pa.bool_())], schema=schema)

    out = spread(documents.selectExpr(f"cast(`{key}` as bigint) as key", f"`{text}` as text")).mapInArrow(run, "key bigint, same boolean")
    return out.withColumnRenamed("key", key)
