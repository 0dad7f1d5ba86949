"""Token ids by a public byte-level BPE tokenizer (problem 7): greedy longest match proposes, pair checks verify."""

from __future__ import annotations

import heapq
import importlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.plans.spread import spread

#: What splits a text into words before the merges. A fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of more characters are encoded anew each time; the words kept by a worker are at most KEEP.
LONGEST_KEPT, KEEP = 64, 400_000


def vocabulary_path(path: str | None = None) -> str:
    """The vocabulary file: ``path``, else LYREBIRD_BPE, else the one of the installed package of public tokenizers."""
    return path or os.environ.get("LYREBIRD_BPE") or importlib.import_module("public_tokenizers").path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 bytes stand for themselves, the
    rest, in order, for the characters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for byte in range(256):
        if byte in own:
            out.append(chr(byte))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class SpeculativeBpe:
    """A byte-level BPE encoder that merges only where a guess fails.

    A sequence of tokens is the BPE encoding of its bytes exactly if every adjacent pair is the encoding of the bytes of
    that pair. So the greedy longest match of a word is taken as a guess, all distinct adjacent pairs of a batch of
    guesses are tested together in NumPy, and only words with a pair that fails are merged step by step.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = {c: b for b, c in enumerate(byte_letters())}
        ids = {}
        for token, i in model["vocab"].items():
            try:
                ids[bytes(letters[c] for c in token)] = i
            except KeyError:  # a special token's string
                continue
        self.ids = ids
        size = max(ids.values()) + 1
        self.longest = np.zeros(256 * 256, np.int64)  # longest token by its first two bytes
        for token in ids:
            if len(token) > 1:
                first = token[0] * 256 + token[1]
                self.longest[first] = max(self.longest[first], len(token))
        self.longest = self.longest.tolist()
        # each token's last merge and its rank; single bytes are their own halves and rank before all merges
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank = np.zeros(size, np.int64)
        single = sorted(i for t, i in ids.items() if len(t) == 1)
        for at, i in enumerate(single):
            self.rank[i] = at
        keys, values = [], []
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for at, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = (ids[bytes(letters[c] for c in x)] for x in (a, b))
            both = model["vocab"][pair.replace(" ", "") if isinstance(pair, str) else pair[0] + pair[1]]
            rank = 256 + at
            self.left[both], self.right[both], self.rank[both] = a, b, rank
            self.merge[a, b] = (rank, both)
            keys.append(a * size + b)
            values.append(rank)
        order = np.argsort(np.array(keys))
        self.size, self.keys, self.values = size, np.array(keys)[order], np.array(values)[order]
        self.split = regex.compile(PATTERN).findall
        self.kept: dict[str, tuple[int, ...]] = {}
        self.sizes: dict[str, int] = {}
        self.pairs: dict[int, bool] = {}
        self.guessed = self.merged = 0

    def guess(self, word: bytes) -> list[int]:
        """The greedy longest match from the left."""
        ids, longest, out, at, end = self.ids, self.longest, [], 0, len(word)
        while at < end:
            if at + 1 < end:
                for stop in range(min(end, at + longest[word[at] * 256 + word[at + 1]]), at + 1, -1):
                    found = ids.get(word[at:stop])
                    if found is not None:
                        out.append(found)
                        at = stop
                        break
                else:
                    out.append(ids[word[at : at + 1]])
                    at += 1
            else:
                out.append(ids[word[at : at + 1]])
                at += 1
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair (a, b) is the encoding of its own bytes.

        The merges of both tokens are undone from the last on; the pair fails if the merging would at some point have
        joined what then stands left and right of the seam before the merge just undone."""
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        rows = np.arange(len(a))
        while len(rows):
            x, y = a[rows], b[rows]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            bad = (self.keys[at] == key) & (self.values[at] < limit[rows])
            good[rows[bad]] = False
            rows, x, y = rows[~bad], x[~bad], y[~bad]
            more_x, more_y = self.left[x] != x, self.left[y] != y
            take_x = more_x & (~more_y | (self.rank[x] > self.rank[y]))
            take_y = more_y & ~take_x
            # a merge on the left wins a tie in rank against the seam, one on the right loses it
            limit[rows[take_x]] = self.rank[x[take_x]]
            a[rows[take_x]] = self.right[x[take_x]]
            limit[rows[take_y]] = self.rank[y[take_y]] + 1
            b[rows[take_y]] = self.left[y[take_y]]
            rows = rows[take_x | take_y]
        return good

    def exact(self, word: bytes) -> list[int]:
        """The merging itself, lowest rank first and leftmost among equals, with a heap."""
        token = [self.ids[word[i : i + 1]] for i in range(len(word))]
        end = len(token)
        after, before, gone = list(range(1, end + 1)), list(range(-1, end - 1)), [False] * end
        heap = [(*m, i, token[i], token[i + 1]) for i in range(end - 1) if (m := self.merge.get((token[i], token[i + 1])))]
        heap = [(rank, i, both, a, b) for rank, both, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, both, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= end or token[i] != a or token[j] != b:
                continue
            token[i], gone[j] = both, True
            after[i] = after[j]
            if after[j] < end:
                before[after[j]] = i
            for p in (before[i], i):
                if p >= 0 and after[p] < end and (m := self.merge.get((token[p], token[after[p]]))):
                    heapq.heappush(heap, (m[0], p, m[1], token[p], token[after[p]]))
        return [t for t, x in zip(token, gone) if not x]

    def words(self, words: list[str]) -> list[list[int]]:
        """The ids of distinct words: guesses, tested together, with exact merging for those that fail."""
        raw = [w.encode("utf-8", "replace") for w in words]
        guesses = [self.guess(w) for w in raw]
        flat = np.array([t for g in guesses for t in g], np.int64)
        of = np.repeat(np.arange(len(guesses)), [len(g) for g in guesses])
        seam = of[1:] == of[:-1]
        pair = (flat[:-1] * self.size + flat[1:])[seam]
        distinct, back = np.unique(pair, return_inverse=True)
        good = np.array([self.pairs.get(p, -1) for p in distinct.tolist()], np.int8)
        new = np.flatnonzero(good < 0)
        if len(new):
            good[new] = self.compatible(distinct[new] // self.size, distinct[new] % self.size)
            if len(self.pairs) > 2 * KEEP:
                self.pairs.clear()
            self.pairs.update(zip(distinct[new].tolist(), good[new].tolist()))
        failed = np.unique(of[1:][seam][good[back] == 0])
        for i in failed.tolist():
            guesses[i] = self.exact(raw[i])
        self.guessed += len(words)
        self.merged += len(failed)
        return guesses

    def counts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """The number of tokens of each text, and how many of these belong to words that begin in its first line, if it has
        several: its prompt. One pass; a text is split once."""
        split = [self.split(t) if t else [] for t in texts]
        sizes = self.sizes
        if len(sizes) > KEEP:
            sizes.clear()
        new = list({w for ws in split for w in ws if w not in sizes})
        once: dict[str, int] = {}
        if new:
            for w, ids in zip(new, self.words(new)):
                (sizes if len(w) <= LONGEST_KEPT else once)[w] = len(ids)
        out = []
        for text, ws in zip(texts, split):
            of = [sizes[w] if w in sizes else once[w] for w in ws]
            prompt = 0
            if text and "\n" in text:
                begin = len(text) - len(text.lstrip())
                end = text.find("\n", begin)
                if end >= 0 and text[end:].strip():
                    at = 0
                    for w, n in zip(ws, of):
                        if at >= end:
                            break
                        prompt += n
                        at += len(w)
            out.append((sum(of), prompt))
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; [] for null and empty texts."""
        split = [self.split(t) if t else [] for t in texts]
        kept = self.kept
        if len(kept) > KEEP:
            kept.clear()
        new = list({w for ws in split for w in ws if w not in kept})
        once: dict[str, list[int]] = {}
        if new:
            for w, ids in zip(new, self.words(new)):
                (kept if len(w) <= LONGEST_KEPT else once)[w] = ids
        out = []
        for ws in split:
            ids: list[int] = []
            if once:
                for w in ws:
                    ids += kept[w] if w in kept else once[w]
            else:
                for w in ws:
                    ids += kept[w]
            out.append(ids)
        return out


_shipped: set[tuple[str, str]] = set()


def shipped(spark: SparkSession, path: str | None = None) -> str:
    """The name under which executors find the vocabulary file, which is sent to them once for each application."""
    path = vocabulary_path(path)
    key = (spark.sparkContext.applicationId, path)
    if key not in _shipped:
        spark.sparkContext.addFile(path)
        _shipped.add(key)
    return os.path.basename(path)


_loaded: dict[str, SpeculativeBpe] = {}


def encoder(name: str) -> SpeculativeBpe:
    """The worker's encoder of a vocabulary file that was sent to it, loaded once a process."""
    path = SparkFiles.get(name)
    if path not in _loaded:
        _loaded[path] = SpeculativeBpe(path)
    return _loaded[path]


def token_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every text, whole, without special tokens; their strings in a text are ordinary
    text. Null and empty texts have the empty list. Repeated rows give repeated rows, an empty table none."""
    name = shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(name)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = pa.array(bpe.encode(batch.column(1).to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return spread(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, "doc_id bigint, ids array<int>")


def p7_ids(spark, sf_dir: str) -> DataFrame:
    """The ids of each document by byte_bpe_50k."""
    return token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"p7_ids": p7_ids}
ORACLE: dict[str, str] = {}
