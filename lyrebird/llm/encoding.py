"""Text decoded with the wrong encoding (problem 2): a hidden Markov model labels characters, spans are turned back."""

from __future__ import annotations

import functools
import hashlib
import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.known_text import KNOWN
from lyrebird.plans.spread import spread

#: (encoding that was used, encoding that was right). A name twice in a row, as in ``utf-8 utf-8``, means garbled twice.
PAIRS = [
    ("cp1252", "utf-8"), ("cp1251", "utf-8"), ("cp866", "utf-8"), ("koi8-r", "utf-8"), ("mac-roman", "utf-8"),
    ("cp850", "utf-8"), ("cp437", "utf-8"), ("cp1252", "cp1251"), ("cp866", "cp1251"), ("koi8-r", "cp1251"),
    ("mac-roman", "cp1251"), ("cp1251", "koi8-r"), ("cp1252", "koi8-r"), ("cp866", "koi8-r"), ("cp1251", "iso8859-5"),
    ("cp1252", "iso8859-5"), ("cp1251", "cp866"), ("cp1252", "cp866"), ("mac-roman", "cp1252"), ("cp1251", "cp1252"),
    ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "utf-8 utf-8"), ("cp1251", "utf-8 utf-8"),
    ("cp1252", "cp1253"), ("cp1252", "shift_jis"), ("cp1252", "euc_jp"), ("cp1252", "gb18030"), ("cp1252", "big5"), ("cp1252", "euc_kr"),
]
#: Bounds of ``sample_texts``, which no query uses: texts, characters of a text that are read whole, and the number of pieces,
#: evenly from the first character to the last, that are read of longer ones, as many characters in all.
SAMPLE, SAMPLE_CHARS, PIECES = 400, 60_000, 10
#: Characters with a class of their own, the most frequent ones: the model has pairs times the square of this many cells.
MOST_CHARS = 600
#: Log odds of entering and of leaving a garbled state, the bound of one character's evidence, and evidence that counts as none.
ENTER, LEAVE, MOST, LEAST = 7.0, 2.0, 7.0, 0.1
#: The counts of all texts are brought down to those of so many characters, as otherwise what is rare would be the rarer, and
#: ``KNOWN`` the less, the more texts there are.
COUNTED = 1_200_000
#: Cells of evidence that are decoded together, 4 bytes each.
CELLS = 6_000_000
#: Characters up to which a loop adds up a text's likelihood faster than arrays do; those up to which spans, and how many, are kept
#: with what they were turned back to.
SHORT, KEPT_CHARS, KEPT = 200, 200, 1 << 15
LOST = "�"
#: Encodings of several bytes a character, and how many of these an inverse must give; those of Cyrillic in one byte; those
#: that make letters of letters, one by one.
WIDE, LEAST_WIDE = frozenset(("shift_jis", "euc_jp", "gb18030", "big5", "euc_kr")), 4
CYRILLIC = frozenset(("cp1251", "koi8-r", "iso8859-5", "cp866"))
WESTERN = frozenset(("cp1252",))
#: Encodings of which whole stretches are garbled, not single letters, and whose bytes are like those of many others.
LONG_RUNS = WIDE | {"cp1253"}
#: The state of what was replaced for good, which emits nothing but U+FFFD and has no inverse; its evidence for that sign is
#: enough to leave any other state for it, by way of the clean one, and to enter that again.
GONE, GONE_EVIDENCE = ("lost", ""), 2 * (ENTER + LEAVE + MOST) + 3.0


def _tables() -> dict[str, tuple[dict[str, bytes], list[str]]]:
    """For each single-byte encoding: character to byte, and byte to character. A byte without a character stands for
    the control character of its number, as browsers have it."""
    out = {}
    for name in {a for a, _ in PAIRS} | {b for _, b in PAIRS if " " not in b and b != "utf-8" and b not in WIDE}:
        chars = []
        for byte in range(256):
            try:
                chars.append(bytes([byte]).decode(name))
            except UnicodeDecodeError:
                chars.append(chr(byte))
        back = {c: bytes([i]) for i, c in enumerate(chars)}
        if name == "cp1252":
            for byte in range(128, 160):
                back.setdefault(chr(byte), bytes([byte]))
        out[name] = (back, chars)
    return out


TABLES = _tables()


#: Byte (as the Latin-1 character of its number) to character for each encoding, and character to such a byte.
DECODE = {name: {i: c for i, c in enumerate(chars)} for name, (_, chars) in TABLES.items()}
ENCODE = {name: {ord(c): chr(b[0]) for c, b in back.items()} for name, (back, _) in TABLES.items()}


def garble(text: str, wrong: str, right: str) -> str:
    """The text as it looks after decoding with ``wrong``; characters that ``right`` lacks become blanks."""
    for name in right.split():
        if name == "utf-8" or name in WIDE:
            raw = text.encode(name, "ignore").decode("latin-1")
        else:
            known = ENCODE[name]
            raw = text.translate({c: known.get(c, " ") for c in map(ord, set(text))})
        text = raw.translate(DECODE[wrong])
    return text


def ungarble(text: str, wrong: str, right: str) -> str | None:
    """The inverse; None if a character isn't of ``wrong``. Bytes that ``right`` doesn't know become U+FFFD."""
    for name in right.split():
        back = TABLES[wrong][0]
        try:
            raw = b"".join([back[c] for c in text])
        except KeyError:
            return None
        text = raw.decode(name, "replace") if name == "utf-8" or name in WIDE else "".join(TABLES[name][1][b] for b in raw)
    return text


def scripts() -> np.ndarray:
    """For each code point: 0 no letter (blank, digit or ASCII sign), 1 ASCII letter, 2 Latin-1 and the like, 3 Cyrillic
    or Greek, 4 others."""
    out = np.full(0x110000, 4, np.int8)
    out[:128] = 0
    out[65:91] = out[97:123] = 1
    out[0x80:0x370] = 2
    out[0x370:0x530] = 3
    return out


SCRIPTS = scripts()
#: A symbol of ``Statistics`` is a letter or sign beyond ASCII by its code point, ``a`` or ``A`` for an ASCII letter, 0 for the place
#: before a text, and from ``AFTER`` on an ASCII sign or blank by the last letter before it. To that comes ``KINDS`` times the
#: block of the last letter of another block, if the letter is none of ASCII.
AFTER, SHIFT = 0x110000, 24
KINDS, SYMBOL_END = 2 * AFTER, 14 * AFTER
#: Between texts that are counted together, and the symbol of each code point that is none of ASCII's signs.
BETWEEN, SYMBOLS = "\ud800", np.arange(AFTER, dtype=np.int32)
SYMBOLS[65:91], SYMBOLS[97:123], SYMBOLS[ord(BETWEEN)] = ord("A"), ord("a"), 0
#: The blocks: none, ASCII, Latin, Greek, Cyrillic, signs and others, East Asian.
BLOCKS = np.searchsorted([1, 0x80, 0x370, 0x400, 0x530, 0x2E80], np.arange(AFTER), "right").astype(np.int8)
BLOCKS[ord(BETWEEN)] = 0
#: Characters and symbols that are counted at once.
CHARS_AT_ONCE, SYMBOLS_AT_ONCE = 300_000, 1_000
#: Steps in which it is found what comes before runs of characters that an encoding lacks.
STEPS = 10
#: For ``_symbol_pairs``: the number of each symbol among those that are counted at once.
NUMBERS = np.empty(SYMBOL_END, np.int32)


class Statistics(NamedTuple):
    """What a model is made of: the pairs of neighbouring symbols (``first << SHIFT | second``), how often each occurs, the hashes
    of the Cyrillic words, and how often each of these occurs. How often pairs occur once garbled follows from this."""

    pairs: np.ndarray
    times: np.ndarray
    words: np.ndarray
    uses: np.ndarray


@functools.lru_cache(1 << 17)
def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate([np.empty(0, np.int64), *keys]), return_inverse=True)
    return found, np.bincount(at, np.concatenate([np.empty(0, np.int64), *counts]), len(found)).astype(np.float64)


def added(parts: list[Statistics]) -> Statistics:
    return Statistics(*_summed([p.pairs for p in parts], [p.times for p in parts]), *_summed([p.words for p in parts], [p.uses for p in parts]))


def _symbol_pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    code = np.frombuffer(BETWEEN.join(["", *texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.flatnonzero(SCRIPTS[code] > 0)
    symbols, block = SYMBOLS[code[letters]], BLOCKS[code[letters]]
    new = np.flatnonzero(block[1:] != block[:-1])
    before = np.repeat(np.concatenate([[0], block[new]]), np.diff(np.concatenate([[0], new + 1, [len(block)]])))
    symbols += np.where(block > 1, before, 0).astype(np.int32) * KINDS
    symbol = np.repeat(symbols + AFTER, np.diff(np.append(letters, len(code))))
    symbol[letters] = symbols
    places = np.arange(len(symbol), dtype=np.int32)
    NUMBERS[symbol] = places
    there = symbol[NUMBERS[symbol] == places].astype(np.int64)  # each symbol once
    NUMBERS[there] = places[: len(there)]
    number = NUMBERS[symbol].astype(np.int64)
    both = number[:-1] * len(there) + number[1:]
    if len(there) <= SYMBOLS_AT_ONCE:
        times = np.bincount(both, minlength=1)
        found = np.flatnonzero(times)
        times = times[found]
    else:
        found, times = np.unique(both, return_counts=True)
    first, second = (there[x] for x in np.divmod(found, len(there)))
    return (first << SHIFT | second)[second > 0], times[second > 0]


def statistics(texts: list[str]) -> Statistics:
    """The statistics of the texts, each of which begins anew."""
    pairs, times, words, group, size = [], [], Counter(), [], 0
    for k, text in enumerate(texts):
        group.append(text)
        size += len(text)
        if size > CHARS_AT_ONCE or k == len(texts) - 1:
            a, b = _symbol_pairs(group)
            pairs.append(a)
            times.append(b)
            words.update(CYRILLIC_WORD.findall("\n".join(group).lower()))
            group, size = [], 0
    hashes = np.fromiter(map(word_hash, words), np.int64, len(words))
    return Statistics(*_summed(pairs, times), *_summed([hashes], [np.fromiter(words.values(), np.int64, len(words))]))


class _Images:
    """What the characters become by one pair, each by itself, as all of these encodings garble character by character. One that
    ``right`` lacks becomes a blank, or nothing in encodings of several bytes."""

    def __init__(self, letters: np.ndarray, pair: tuple[str, str] | None):
        self.block, self.before = BLOCKS[letters % AFTER], letters // AFTER
        chars = "\n".join(map(chr, (letters[1:] % AFTER).tolist()))
        became = (garble(chars, *pair) if pair else chars).split("\n")
        became = ["" if x == " " else x for x in became] if len(letters) > 1 else []
        self.blanks = not pair or pair[1] not in WIDE
        self.codes = np.frombuffer("".join(became).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sizes = np.array([0, *map(len, became)])
        self.owner = np.repeat(np.arange(len(letters)), self.sizes)

    def counts(self, once: np.ndarray) -> np.ndarray:
        """How often each code point occurs in the garbled texts, if the characters occur so often in the texts."""
        return np.bincount(self.codes, once[self.owner], 0x110000)

    def pairs(self, cls: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, letters: tuple[np.ndarray, np.ndarray], times: np.ndarray, once: np.ndarray) -> np.ndarray:
        """How often each pair of classes occurs in the garbled texts: inside of what a character became, and where two meet.

        A blank has its class by the last letter before it that ``right`` has; where others lie between, by the shares of the
        scripts that come before these (``_shares``)."""
        script = SCRIPTS[self.codes]
        # what a character becomes begins with none of ASCII's signs, so that the last letter is always its own
        script = script[np.maximum.accumulate(np.where(script > 0, np.arange(len(script)), 0))] if len(script) else script
        k = np.where(SCRIPTS[self.codes] == 0, script, cls[self.codes]).astype(np.int64)
        there, ends = self.sizes > 0, np.cumsum(self.sizes)
        start, end, after = (np.full(len(there), BLANK, np.int64) for _ in range(3))
        start[there], end[there], after[there] = k[(ends - self.sizes)[there]], k[ends[there] - 1], script[ends[there] - 1]
        inner = np.flatnonzero(self.owner[1:] == self.owner[:-1]) + 1
        out = np.bincount(k[inner - 1] * n + k[inner], once[self.owner[inner]], n * n).astype(np.float64)
        whole = letters[0] & there[a], letters[1] & there[b]
        shares = self._shares(there, after, a, b, letters[1] & ~there[b], times, once)
        if not self.blanks:  # what is left out has no neighbours
            kept = ~(letters[0] & ~there[a] & (a > 0)) & ~(letters[1] & ~there[b])
            a, b, times, whole = a[kept], b[kept], times[kept], (whole[0][kept], whole[1][kept])
        x = whole[0]
        out += np.bincount(end[a[x]] * n + np.where(whole[1][x], start[b[x]], after[a[x]]), times[x], n * n)
        a, b, times, second = a[~x], b[~x], times[~x], whole[1][~x]
        for c in range(shares.shape[1]):
            out += np.bincount(c * n + np.where(second, start[b], c), times * shares[a, c], n * n)
        return out.reshape(n, n)

    def _shares(self, there: np.ndarray, after: np.ndarray, a: np.ndarray, b: np.ndarray, lacking: np.ndarray, times: np.ndarray, once: np.ndarray) -> np.ndarray:
        """For each letter the shares of the scripts that the last letter has once it is past: its own; of one that ``right``
        lacks those of the block before, or if that is lacking too, of what comes before the letter."""
        shares = np.zeros((len(there), SMALL))
        shares[there, after[there]] = 1
        shares[0, BLANK] = 1
        blocks = np.bincount(self.block[there].astype(np.int64) * SMALL + after[there], once[there], 7 * SMALL).reshape(7, SMALL)
        blocks[0, BLANK] = 1
        blocks = np.divide(blocks, blocks.sum(1, keepdims=True), out=np.zeros_like(blocks), where=blocks.sum(1, keepdims=True) > 0)
        missing = ~there
        missing[0] = False
        shares[missing] = blocks[self.before[missing]]
        lacking = lacking & (shares[b].sum(1) == 0)
        a, b, times = a[lacking], b[lacking], times[lacking]
        missing = np.unique(b)
        for _ in range(STEPS if len(missing) else 0):
            seen = np.stack([np.bincount(b, times * shares[a, c], len(there)) for c in range(SMALL)], 1)[missing]
            total = seen.sum(1, keepdims=True)
            shares[missing] = np.divide(seen, total, out=np.zeros_like(seen), where=total > 0)
        shares[shares.sum(1) == 0, BLANK] = 1
        return shares


#: Classes: for ASCII that is no letter one for each script of the last letter, small and capital ASCII letters, rare
#: characters by range, then the characters that the texts have.
BLANK, SMALL, CAPITAL, RARE = 0, 5, 6, 7
RANGES = [(0x80, 0xA0), (0xA0, 0x250), (0x250, 0x400), (0x400, 0x530), (0x530, 0x2000), (0x2000, 0x2700), (0x2700, 0x110000)]


class GarbleModel:
    """A hidden Markov model over characters: one clean state and one for each encoding pair.

    A character's evidence for a state is the log odds of seeing it after the one before, in garbled against clean text;
    both are fitted on the texts, garbled by each pair. ASCII counts by class only (small or capital letter, or
    neither, by the script of the letter before), and between ASCII characters there is no evidence, so that mark-up
    says nothing. The best path is Viterbi's; a text of which no stretch can outweigh the entry into any state is clean
    without it, which is found by one cumulated sum of the largest evidence of any state."""

    def __init__(self, sample: list[str] | Statistics, pairs: list[tuple[str, str]] | None = None, least: int = 3):
        self.pairs = [*(pairs or PAIRS), GONE]
        stats = sample if isinstance(sample, Statistics) else statistics(sample)
        order = np.argsort(stats.words)
        order = order[stats.uses[order] > 1]
        self.words, self.weights, self.asked = stats.words[order], np.log(stats.uses[order]).astype(np.float32), {}
        self.tried: dict[tuple, tuple[str, int, int] | None] = {}
        first, second, times = stats.pairs >> SHIFT, stats.pairs & ((1 << SHIFT) - 1), stats.times
        signs = [x % KINDS >= AFTER for x in (first, second)]
        first, second = (x // KINDS * AFTER + x % AFTER for x in (first, second))
        letters = np.union1d([0], np.concatenate([first, second]))
        a, b = np.searchsorted(letters, first), np.searchsorted(letters, second)
        once = np.bincount(b[~signs[1]], times[~signs[1]], len(letters)).astype(np.float64)
        images = [_Images(letters, p) for p in (None, *self.pairs[:-1])]
        counts = np.zeros(0x110000)
        for image in images:
            counts = np.maximum(counts, image.counts(once))
        counts[:128] = 0
        counts[0xFFFD] = 0
        known = np.flatnonzero(counts >= least)
        if len(known) > MOST_CHARS:  # the others count by their range
            known = np.sort(known[np.argsort(-counts[known], kind="stable")[:MOST_CHARS]])
        self.cls = np.zeros(0x110000, np.int32)
        for k, (low, high) in enumerate(RANGES):
            self.cls[low:high] = RARE + k
        self.cls[65:91], self.cls[97:123] = CAPITAL, SMALL
        gone = RARE + len(RANGES)
        self.cls[0xFFFD] = gone
        self.cls[known] = np.arange(len(known)) + gone + 1
        for byte, char in enumerate(TABLES["cp1252"][1][128:160], 128):  # read as Latin-1, these bytes stay control characters
            self.cls[byte] = self.cls[ord(char)]
        n = self.n = gone + 1 + len(known)
        self.odds = np.empty((len(self.pairs), n, n), np.float16)
        for state, image in enumerate(images, -1):
            pair = image.pairs(self.cls, n, a, b, (~signs[0], ~signs[1]), times, once)
            one = pair.sum(0) + 0.5
            one /= one.sum()
            log = np.log((pair + 2 * one) / (pair.sum(1, keepdims=True) + 2)).astype(np.float32)
            if state < 0:
                clean = log
            else:
                self.odds[state] = np.clip(log - clean, -MOST, MOST)
        odds = self.odds[:-1]
        odds[np.abs(odds) < LEAST] = 0
        odds[:, :RARE, :RARE] = 0
        odds[:, gone, :] = np.minimum(odds[:, gone, :], 0)  # the sign says nothing about what comes next
        odds[:, :, gone] = 0
        self.odds[-1] = -MOST
        self.odds[-1, :, gone] = GONE_EVIDENCE
        self.odds = np.ascontiguousarray(self.odds.reshape(len(self.pairs), n * n).T).T  # a pair's evidence for all states side by side
        self.clean = clean.reshape(n * n)
        self.most = self.odds.max(0).astype(np.float32)

    def _pairs_of(self, code: np.ndarray) -> np.ndarray:
        """The number of each pair of a character's class and that of the one before."""
        script = SCRIPTS[code]
        letter = script > 0
        last = np.maximum.accumulate(np.arange(len(code)) * letter)  # before the first letter a sign, whose script is BLANK
        k = np.where(letter, self.cls[code], script[last])
        out = k.astype(np.int64)
        out[1:] += k[:-1] * self.n  # before the first one is BLANK, 0
        return out

    def _codes(self, text: str) -> np.ndarray:
        return self._pairs_of(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Of each text the garbled spans (start, end, state) of the best path."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        same: dict[bytes, list[tuple[int, np.ndarray]]] = {}  # stretches of equal evidence have the same path
        for i, text in enumerate(texts):
            if not text or text.isascii():
                continue
            code = self._codes(text)
            most = self.most[code]
            at = np.flatnonzero(most)
            if not len(at):
                continue
            gain = np.cumsum(most[at], dtype=np.float64)
            floor = np.minimum(np.minimum.accumulate(gain), 0)
            # the walk of the largest evidence above its minimum: only a stretch in which it passes the cost of entering
            # can hold a garbled span
            above = gain - floor
            if above.max() <= ENTER:
                continue
            up = above > 0
            starts = np.flatnonzero(up & ~np.concatenate([[False], up[:-1]]))
            ends = np.flatnonzero(up & ~np.concatenate([up[1:], [False]])) + 1
            enough = np.maximum.reduceat(above, starts) > ENTER
            code = code[at].astype(np.int32)
            for start, end in zip(starts[enough].tolist(), ends[enough].tolist()):
                same.setdefault(code[start:end].tobytes(), []).append((i, at[start:end]))
        todo = sorted(same, key=len)
        start = 0
        while start < len(todo):
            end = start + 1
            while end < len(todo) and end - start < 1024 and (end + 1 - start) * (len(todo[end]) // 4) * len(self.pairs) <= CELLS:
                end += 1
            for key, found in self._viterbi(todo[start:end]):
                for i, at in same[key]:
                    out[i] += [(int(at[a]), int(at[z - 1]) + 1, state) for a, z, state in found]
            start = end
        for found in out:
            found.sort()
        return out

    def _viterbi(self, todo: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
        """The stretches, each the numbers of its pairs, whose best path has spans, with these."""
        codes = [np.frombuffer(key, np.int32) for key in todo]
        size, rows, states = max(map(len, codes)), len(codes), len(self.pairs)
        code = np.zeros((size, rows), np.int32)
        for r, c in enumerate(codes):
            code[: len(c), r] = c
        inside = np.empty((size + 1, states, rows), np.float32)  # first the evidence, then the value of each state before each step
        inside[0] = -1e9
        step = max(1, CELLS // 16 // (states * rows))
        for t in range(0, size, step):
            inside[t + 1 : t + 1 + step] = self.odds.T[code[t : t + step]].transpose(0, 2, 1)
        for r, c in enumerate(codes):
            inside[len(c) + 1 :, :, r] = 0
        clean = np.zeros((size + 1, rows), np.float32)
        come, value, best = np.empty(rows, np.float32), np.empty(rows, np.float32), np.empty((states, rows), np.float32)
        enter, leave = np.float32(ENTER), np.float32(LEAVE)
        for now, then, before, after in zip(inside, inside[1:], clean, clean[1:]):
            np.subtract(before, enter, out=come)
            np.maximum.reduce(now, axis=0, out=value)
            np.subtract(value, leave, out=value)
            np.maximum(before, value, out=after)
            np.maximum(now, come, out=best)
            np.add(best, then, out=then)
        left = clean[1:] > clean[:-1]  # clean is best reached from a state
        last = inside[size].max(0) > clean[size]
        for r in np.flatnonzero(last | left.any(0)).tolist():
            state = int(inside[size, :, r].argmax()) if last[r] else -1
            t = end = size
            spans, length = [], len(codes[r])
            exits = left[:, r].nonzero()[0]
            while state >= 0 or (len(exits) and exits[0] < t):
                if state < 0:
                    t = end = int(exits[exits.searchsorted(t) - 1])
                    state = int(inside[t, :, r].argmax())
                low, found = t, ()
                while not len(found):  # the first step always enters
                    low = max(0, 2 * low - t - 64)
                    # the best way into the state comes from clean
                    found = (clean[low:t, r] - enter > inside[low:t, state, r]).nonzero()[0]
                t = low + int(found[-1])
                if t < length:
                    spans.append((t, min(end, length), state))
                state = -1
            yield todo[r], spans

    def likelihood(self, text: str) -> float:
        """Log probability of a text under the clean state."""
        if len(text) > SHORT:
            return float(self.clean[self._codes(text)].sum(dtype=np.float64))
        script, cls, clean, n = memoryview(SCRIPTS), memoryview(self.cls), memoryview(self.clean), self.n
        total, last, before = 0.0, BLANK, BLANK
        for c in map(ord, text):  # as in _pairs_of
            k = script[c]
            if k:
                last, k = k, cls[c]
            else:
                k = last
            total += clean[before * n + k]
            before = k
        return total

    def turned(self, text: str, start: int, end: int, state: int, least: int = 0) -> tuple[int, str, int, int] | None:
        """A labelled span turned back: the place where it begins, which may lie before the label, the new text, the state
        whose inverse was used, and how many characters after the label belong to it. That is the label's own, if it makes the text clearly more likely; else the best of those with
        the same wrong encoding, between which few characters can't decide. None if there is no such inverse.

        The span is widened to whole runs of characters beyond ASCII, from ``least`` on. ASCII and stretches whose characters aren't all of
        the wrong encoding stay. The gain is taken whatever the case, as capitals are rare but not wrong; where it is
        small, the case may speak for the inverse."""
        known = TABLES[self.pairs[state][0]][0]
        enough = sum(ord(c) > 127 for c in text[start:end]) >= LEAST_SINGLE
        while start > least and ord(text[start - 1]) > 127 and text[start - 1] in known:
            start -= 1
        span = text[max(0, start - 12) : start], text[start:end], text[end : end + 13], state, enough
        if end - start > KEPT_CHARS:
            found = self._turned(*span)
        else:  # menus and the like are on many pages
            if span not in self.tried:
                if len(self.tried) >= KEPT:
                    self.tried.clear()
                self.tried[span] = self._turned(*span)
            found = self.tried[span]
        return found and (start, *found)

    def _turned(self, before: str, old: str, rest: str, state: int, enough: bool) -> tuple[str, int, int] | None:
        """What ``turned`` gives for a widened span, without its place, by the twelve characters before and the 13 after it."""
        wrong, after = self.pairs[state][0], rest[:12]
        was = None
        best, best_gain = None, 0.0
        # what was garbled twice looks right enough turned back once, but what was garbled once can't be turned back twice
        own = [k for k, p in enumerate(self.pairs) if p == (wrong, f"{self.pairs[state][1]} utf-8")] + [state]
        for used in [*own, *(k for k, (w, _) in enumerate(self.pairs) if w == wrong and k not in own)]:
            right, fine = self.pairs[used][1], 0
            # bytes of the wide ones make ideographs of almost anything: only their own label speaks for them, and only for them
            if used != state and (right in WIDE or self.pairs[state][1] in WIDE):
                continue

            def back(m: re.Match, right: str = right) -> str:
                nonlocal fine
                new = ungarble(m.group(), wrong, right)
                if new is None or new.count(LOST) * 3 > len(new):
                    return m.group()
                if right in WESTERN:  # single letters among others: each must gain, and a letter stay one
                    if any(x.isalpha() and not (y.isalpha() or y == "’") for x, y in zip(m.group(), new)):
                        return m.group()
                    a, z = old[max(0, m.start() - 3) : m.start()], old[m.end() : m.end() + 3]
                    if self.likelihood(a + new + z) <= self.likelihood(a + m.group() + z):
                        return m.group()
                fine += len(m.group())
                return new

            if right in WIDE:  # ASCII letters may be second bytes
                new = self._whole(old, rest[:1], wrong, right)
                if new is None:
                    continue
                new, taken = new
                old_, after_ = old + rest[:taken], rest[taken : taken + 12]
                gain = self.likelihood(before + new + after_) - self.likelihood(before + old_ + after_) - (len(old_) - len(new)) - MANY * len(new)
                wide = sum(ord(c) > 0x2E7F for c in new)
                return (new, used, taken) if gain >= GAIN and wide >= LEAST_WIDE else None
            if not enough and right not in WESTERN and not right.startswith("utf"):
                continue
            new = NOT_ASCII.sub(back, old)
            if not fine:
                continue
            # garbled UTF-8 has more characters than the text, whose likelihood rises by the shorter length alone
            fewer = len(old) - len(new)
            fewer += MIXED_COST * (len(MIXED.findall(new)) - len(MIXED.findall(old)))
            if was is None:
                was = self.likelihood((before + old + after).lower())
            blind = self.likelihood((before + new + after).lower()) - was - fewer
            if blind < (1 if right in WESTERN else GAIN) or (right in CYRILLIC and not self._reads_better(old, new)):
                continue
            case = self.likelihood(before + new + after) - self.likelihood(before + old + after) - fewer
            if (blind >= GAIN or case >= GAIN + 2) and max(case, blind) > best_gain:
                best, best_gain = (new, used, 0), max(case, blind)
                if used in own:
                    break
        return best

    @staticmethod
    def _whole(old: str, next_: str, wrong: str, right: str) -> tuple[str, int] | None:
        """A span, or the span with the next character, as text of a wide encoding, if all of its bytes are."""
        for taken in (0, 1) if next_ else (0,):
            new = ungarble(old + next_[:taken], wrong, right)
            if new is not None and LOST not in new:
                return new, taken
        return None

    def _reads_better(self, old: str, new: str) -> bool:
        """Whether Cyrillic turned into Cyrillic gains words, or loses none and isn't made of abbreviations, which look as
        unlikely as garbled text. A letter counts by the logarithm of how often its word occurs in the clean texts, as in very
        many texts any letters are a word somewhere."""
        was, now = CYRILLIC_WORD.findall(old), CYRILLIC_WORD.findall(new)
        gain = self._known(now) - self._known(was)
        short = sum(len(w) for w in was if ABBREVIATION.fullmatch(w))
        return gain > 0 or (gain == 0 and 2 * short < sum(map(len, was)) + (not was))

    def _known(self, words: list[str]) -> float:
        total = 0.0
        for word in map(str.lower, words):
            if word not in self.asked:
                if len(self.asked) >= 1 << 17:
                    self.asked.clear()
                key = word_hash(word)
                at = np.searchsorted(self.words, key)
                self.asked[word] = len(word) * float(self.weights[at]) if at < len(self.words) and self.words[at] == key else 0.0
            total += self.asked[word]
        return total

    @staticmethod
    def _whole_runs(text: str, start: int, end: int) -> tuple[int, int]:
        """The span without runs of characters beyond ASCII that it holds in part, and without ASCII at its ends."""
        if 0 < start < len(text) and ord(text[start - 1]) > 127:
            while start < end and ord(text[start]) > 127:
                start += 1
        if 0 < end < len(text) and ord(text[end]) > 127:
            while start < end and ord(text[end - 1]) > 127:
                end -= 1
        while start < end and ord(text[start]) < 128:
            start += 1
        while start < end and ord(text[end - 1]) < 128:
            end -= 1
        return start, end

    def is_clean(self, text: str, spans: list[tuple[int, int, int]]) -> bool:
        """Whether nothing of the text is lost and none of its labelled spans can be turned back."""
        return not spans or not (any(self.pairs[k] == GONE for _, _, k in spans) or self.restore(text, spans, 1)[1])

    def sure(self, text: str, spans: list[tuple[int, int, int]], good: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The labelled spans apart from those turned back whose evidence alone is enough: what is lost of them, as bytes
        that were dropped or replaced, doesn't make them right."""
        rest = [s for s in spans if all(s[1] <= a or s[0] >= z for a, z, _ in good)]
        if not rest:
            return []
        code = self._codes(text)
        rest = [(a, z, k) for a, z, k in rest if self.pairs[k] == GONE or not all(c.isupper() for c in text[a:z] if ord(c) > 127)]  # capitals are rare
        return [(a, z, k) for a, z, k in rest if self.pairs[k] == GONE or (self.pairs[k] not in SWAPPED and self.pairs[k][1] not in WIDE and self.odds[k, code[a:z]].sum(dtype=np.float64) >= SURE)]

    def _joined(self, text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The spans, where such as lie side by side with the same wrong encoding are one, if the longest of them is of a pair
        of ``LONG_RUNS`` and its inverse fits them all: a few characters of such a stretch may look more like another pair."""
        out: list[tuple[int, int, int]] = []
        i = 0
        while i < len(spans):
            k = i
            while k + 1 < len(spans) and spans[k + 1][0] - spans[k][1] <= 3 and self.pairs[spans[k + 1][2]][0] == self.pairs[spans[i][2]][0]:
                k += 1
            longest = max(spans[i : k + 1], key=lambda s: s[1] - s[0])
            if k > i and self.pairs[longest[2]][1] in LONG_RUNS:
                new = self.turned(text, spans[i][0], spans[k][1], longest[2])
                if new is not None and new[2] == longest[2]:
                    out.append((spans[i][0], spans[k][1], longest[2]))
                    i = k + 1
                    continue
            out += spans[i : k + 1]
            i = k + 1
        return out

    def restore(self, text: str, spans: list[tuple[int, int, int]], most: int | None = None) -> tuple[str, list[tuple[int, int, int]]]:
        """The text with each span turned back, and the spans for which that made sense, each with the state whose inverse
        was used; no more than the first ``most``."""
        parts, at, good = [], 0, []
        for start, end, state in self._joined(text, spans):
            if self.pairs[state] == GONE:
                continue
            inner = self._whole_runs(text, start, end)
            while end < len(text) and ord(text[end]) > 127 and text[end] in TABLES[self.pairs[state][0]][0]:
                end += 1
            start = max(start, at)
            if start >= end:
                continue
            new = self.turned(text, start, end, state, at)
            # a clean word that the label only touches may spoil the whole; as UTF-8 such words stay anyway, or are lost
            if inner[0] < inner[1] and new is None and not self.pairs[state][1].startswith("utf"):
                start, end = max(inner[0], at), inner[1]
                new = self.turned(text, start, end, state, at) if start < end else None
            elif start < inner[0] < end and new is not None and LOST in new[1].partition(" ")[0]:
                other = self.turned(text, inner[0], end, state, at)
                if other is not None and other[1].count(LOST) < new[1].count(LOST):
                    start, new = inner[0], other
            if new is None or new[0] < at:
                continue
            parts += [text[at : new[0]], new[1]]
            at = end + new[3]
            good.append((start, at, new[2]))
            if len(good) == most:
                break
        parts.append(text[at:])
        return "".join(parts), good


CYRILLIC_WORD = re.compile("[\u0400-\u04ff]+")
ABBREVIATION = re.compile("[БВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ]{1,5}")
#: An ASCII letter beside a Cyrillic one, and what each such place, gained or lost, counts.
MIXED, MIXED_COST = re.compile("(?<=[A-Za-z])[\u0400-\u04ff]|(?<=[\u0400-\u04ff])[A-Za-z]"), 6.0
#: Gain in log likelihood that turning a span back must bring; characters that a span of Cyrillic must have.
GAIN, LEAST_SINGLE = 6.0, 4
#: What each character of a wide encoding counts against an inverse that gives it, as one class of the model stands for
#: thousands of them: about the logarithm of their number in use.
MANY = 7.0
#: Evidence with which a labelled span counts that can't be turned back. Pairs that make letters of letters are left out:
#: words in capitals have as much evidence for them.
SURE = 25.0
SWAPPED = {("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "iso8859-5")}
NOT_ASCII = re.compile(r"[^\x00-\x7f\ufffd]+(?:[ \x7f]+[^\x00-\x7f\ufffd]+)*")
ENTITY = re.compile(r"&(?!(?:lt|gt|amp|quot|apos|nbsp|#0*(?:32|34|38|39|60|62|160)|#[xX]0*(?:20|22|26|27|3[cCeE]|[aA]0));)(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def shown(text: str) -> str:
    """The text with the entities of letters and signs decoded; those of blanks and mark-up stay."""
    return ENTITY.sub(lambda m: _html.unescape(m.group()), text) if "&" in text else text


def clean_sample(texts: list[str]) -> list[str]:
    """The texts with tags left out."""
    return [re.sub(r"<[^>]*>", "\n", shown(t)) for t in texts if t]


def clean_statistics(texts: list[str], model: GarbleModel) -> Statistics:
    """The statistics of those texts that the model finds clean."""
    shorn = clean_sample(texts)
    return statistics([t for t, s in zip(shorn, model.spans(shorn)) if model.is_clean(t, s)])


class Texts:
    """All texts of some tables' columns, which are counted where they lie: tasks judge them and count, numbers are sent."""

    def __init__(self, *columns: tuple[DataFrame, str]):
        self.tables = [rows.select(F.col(text).alias("text")).where(F.length(text) > 0) for rows, text in columns]

    def __iter__(self) -> Iterator[str]:
        for table in self.tables:
            for row in table.toLocalIterator():
                yield row.text

    def clean_statistics(self, model: GarbleModel) -> Statistics:
        shared = self.tables[0].sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    stats = clean_statistics(whole.slice(at, 1024).column(0).to_pylist(), shared.value)
                    for word, keys, counts in ((False, stats.pairs, stats.times), (True, stats.words, stats.uses)):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), word)), pa.array(keys, pa.int64()), pa.array(counts, pa.float64())], names=["word", "key", "n"])

        counted = None
        for table in self.tables:
            part = spread(table).mapInArrow(run, "word boolean, key bigint, n double")
            counted = part if counted is None else counted.unionByName(part)
        # a word that occurs once in all texts is as good as none
        got = counted.groupBy("word", "key").agg(F.sum("n").alias("n")).where("not word or n > 1").toArrow()
        shared.unpersist()
        word, key, n = (got.column(k).to_numpy() for k in range(3))
        word = word.astype(bool)
        return Statistics(key[~word], n[~word], key[word], n[word])


def fit(texts: list[str] | Texts, rounds: int = 2) -> GarbleModel:
    """A model whose clean state is fitted on those of the texts that are clean, and on ``KNOWN``.

    Which texts are clean is first judged by a model of ``KNOWN`` alone, then by the model of the texts so found; a text in
    which spans can be turned back is left out, whatever share of the texts has them. All texts are judged and counted in each
    round, in tasks where they are ``Texts``."""
    own, model = statistics([KNOWN]), GarbleModel([KNOWN])
    for _ in range(rounds):
        stats = texts.clean_statistics(model) if isinstance(texts, Texts) else clean_statistics(list(texts), model)
        share = min(1, COUNTED / max(1, stats.times.sum()))
        model = GarbleModel(added([stats._replace(times=stats.times * share), own]))
    return model


SCHEMA = "id bigint, restored string, spans int, turned int, pairs array<string>"


def garbled(rows: DataFrame, model: GarbleModel, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, restored, spans, turned, pairs) of each row with at least one garbled stretch.

    ``restored`` is the text with every labelled span turned back, ``spans`` and ``turned`` how many there are and how
    many could be, ``pairs`` the encodings, each the pair whose inverse was used; 'lost' stands for stretches of U+FFFD, which
    have a state of their own and can't be turned back, nor can a label of strong evidence (``SURE``) that no inverse makes
    more likely.
    ``model`` is fitted by ``fit``, in the queries on all texts of both fields. Null and empty texts give no row; texts are
    read whole; repeated rows give repeated rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)  # pairs times the square of the known characters, and 12 bytes a word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids, texts = batch.column(0).to_pylist(), [shown(t) for t in batch.column(1).to_pylist()]
                found = []
                for i, t, spans in zip(ids, texts, model.spans(texts)):
                    if spans:
                        new, good = model.restore(t, spans)
                        sure = model.sure(t, spans, good)
                        if good or sure:
                            named = sorted({" > ".join(x for x in model.pairs[s][::-1] if x) for _, _, s in good + sure})
                            found.append((i, new, len(good) + len(sure), len(good), named))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())))],
                    names=["id", "restored", "spans", "turned", "pairs"],
                )

    read = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)
    # a text without a character beyond ASCII, as such or as an entity, can't be garbled
    return spread(read.where(F.col("text").rlike(r"[^\x00-\x7F]|&[#a-zA-Z]"))).mapInArrow(run, SCHEMA)


def sample_texts(rows: DataFrame, text: str = "text", size: int = SAMPLE) -> list[str]:
    """At most ``size`` texts, chosen by the hash of the text; pieces of those that are longer than ``SAMPLE_CHARS``. For trying
    ``fit`` on a few texts: the queries fit on all of them."""
    there = rows.where(F.length(text) > 0)
    # the hashes first, so that tasks send numbers and not texts
    last = there.select(F.xxhash64(text).alias("h")).distinct().orderBy("h").limit(size).agg(F.max("h")).first()[0]
    if last is None:
        return []
    each, size_of = SAMPLE_CHARS // PIECES, F.length(text)
    pieces = [F.substring(text, (F.floor((size_of - each) * k / (PIECES - 1)) + 1).cast("int"), F.lit(each)) for k in range(PIECES)]
    read = F.when(size_of <= SAMPLE_CHARS, F.col(text)).otherwise(F.concat_ws("\n", *pieces))
    picked = there.where(F.xxhash64(text) <= F.lit(last)).select(F.xxhash64(text).alias("h"), read.alias("t"))
    return [r.t for r in picked.dropDuplicates(["h"]).orderBy("h").limit(size).collect()]


def _found(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = spark.read.parquet(f"{sf_dir}/crawled.parquet").select(F.col("page_id").alias("id"), F.col("html_content").alias("text"))
    titles = spark.read.parquet(f"{sf_dir}/docinfo.parquet").select(F.col("doc_id").alias("id"), F.col("title").alias("text"))
    model = fit(Texts((pages, "text"), (titles, "text")))
    return garbled(pages, model), garbled(titles, model)


def p2_found(spark, sf_dir: str) -> DataFrame:
    """The pages and the titles with a garbled stretch."""
    pages, titles = _found(spark, sf_dir)
    return pages.select(F.lit("html_content").alias("field"), F.col("id").alias("page_id")).unionByName(titles.select(F.lit("title").alias("field"), F.col("id").alias("page_id"))).distinct()


def p2_restored(spark, sf_dir: str) -> DataFrame:
    """What could be restored, with the encodings."""
    pages, titles = _found(spark, sf_dir)
    return pages.select(F.lit("html_content").alias("field"), "*").unionByName(titles.select(F.lit("title").alias("field"), "*")).withColumn("pairs", F.concat_ws(", ", "pairs"))


QUERIES = {"p2_found": p2_found, "p2_restored": p2_restored}
ORACLE: dict[str, str] = {}
