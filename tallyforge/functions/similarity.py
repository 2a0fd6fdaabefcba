"""String similarities of 0 to 100 as Arrow UDFs; equality and containment are tested before them in the JVM."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Patterns of up to WORD characters are compared by bits of one machine word; longer texts than LONG one at a time.
WORD, LONG, CELLS = 64, 512, 1 << 17


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the characters of a."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        u = rows & where.get(c, 0)
        rows = (rows + u | rows - u) & full
    return len(a) - rows.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths."""
    size = len(a) + len(b)
    return 100.0 * 2 * lcs_length(a, b) / size if size else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text to a stretch of the longer one, its ends included."""
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return 100.0 if not t else 0.0
    if s in t:
        return 100.0
    n = len(s)
    windows = {t[max(0, i) : i + n] for i in range(1 - n, len(t)) if t[max(0, i) : i + n]}
    best = max(ratio(s, w) for w in windows)
    if len(s) == len(t):
        best = max(best, max(ratio(t, w) for w in {s[max(0, i) : i + n] for i in range(1 - n, n)} if w))
    return best


def token_set_ratio(a: str, b: str) -> float:
    """Likeness of two sets of words: what they share against each side's rest; 100 if one holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, p, q = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not p or not q):
        return 100.0
    n = len(both)
    la, lb = n + (n > 0) + len(p), n + (n > 0) + len(q)
    indel = len(p) + len(q) - 2 * lcs_length(p, q)
    scores = [100.0 * (1 - indel / (la + lb)) if la + lb else 100.0]
    if n:
        scores += [100.0 * 2 * n / (n + la), 100.0 * 2 * n / (n + lb)]
    return max(scores)


def _sorted_words(a: str) -> str:
    return " ".join(sorted(a.split()))


def partial_token_ratio(a: str, b: str) -> float:
    """The best partial ratio of the sorted words and of the words that only one side has; 100 if they share a word."""
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return max(partial_ratio(_sorted_words(a), _sorted_words(b)), partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x))))


def weighted_ratio(a: str, b: str) -> float:
    """The best of the ratios, those of words and of parts weighing less: parts count only where one text is much longer."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    words = max(ratio(_sorted_words(a), _sorted_words(b)), token_set_ratio(a, b))
    if longer < 1.5:
        return max(ratio(a, b), 0.95 * words)
    part = 0.9 if longer <= 8 else 0.6
    return max(ratio(a, b), part * partial_ratio(a, b), part * 0.95 * partial_token_ratio(a, b))


# --- many pairs at once -------------------------------------------------------
def _word(n: int) -> type:
    return np.uint16 if n <= 16 else np.uint32 if n <= 32 else np.uint64


def _points(texts: list[str]) -> np.ndarray:
    """Code points, a row for each text, 0 after its end."""
    a = np.array(texts, dtype=str)
    return a.view(np.uint32).reshape(len(texts), a.dtype.itemsize // 4)


def lcs_of_masks(masks: np.ndarray, n: int) -> np.ndarray:
    """Longest common subsequences of a pattern of n characters with the columns' texts; masks (place, column): where the pattern has the text's character."""
    rows = np.full(masks.shape[1], (1 << n) - 1, dtype=masks.dtype)
    for m in masks:
        u = rows & m
        rows = (rows + u) | (rows - u)
    return n - np.bitwise_count(rows & masks.dtype.type((1 << n) - 1)).astype(np.int64)


def stretches_of_masks(masks: np.ndarray, n: int) -> np.ndarray:
    """The longest common subsequence of a pattern of n characters with any n neighbouring places of the columns' texts."""
    full, wide = masks.dtype.type((1 << n) - 1), len(masks) - n + 1
    rows = np.full((wide, masks.shape[1]), full, dtype=masks.dtype)
    u, less = np.empty_like(rows), np.empty_like(rows)
    for k in range(n):
        np.bitwise_and(rows, masks[k : k + wide], out=u)
        np.subtract(rows, u, out=less)
        np.add(rows, u, out=rows)
        np.bitwise_or(rows, less, out=rows)
    rows &= full
    return n - np.bitwise_count(rows).min(axis=0).astype(np.int64)


def partial_of_masks(masks: np.ndarray, n: int, lengths: np.ndarray) -> np.ndarray:
    """partial_ratio() of a pattern of n characters with the columns' texts, each longer than it (or as long, one way)."""
    full = masks.dtype.type((1 << n) - 1)
    count = lambda rows: n - np.bitwise_count(rows & full).astype(np.int64)
    best = 200.0 * stretches_of_masks(masks, n) / (2 * n)
    # stretches at the start, and those at the end, are shorter than the pattern
    rows = np.full(masks.shape[1], full, dtype=masks.dtype)
    for k in range(n - 1):
        u = rows & masks[k]
        rows = (rows + u) | (rows - u)
        best = np.maximum(best, 200.0 * count(rows) / (n + k + 1))
    if n > 1:
        ends = np.take_along_axis(masks, lengths[None, :] - (n - 1) + np.arange(n - 1)[:, None], axis=0)
        rows = np.full(ends.shape, full, dtype=masks.dtype)
        for k in range(n - 1):
            own = rows[: n - 1 - k]
            u = own & ends[k:]
            rows[: n - 1 - k] = (own + u) | (own - u)
        best = np.maximum(best, (200.0 * count(rows) / (n + np.arange(n - 1, 0, -1))[:, None]).max(axis=0))
    return best


class Texts:
    """A column of texts as characters' numbers (place, row), for one pattern against many rows."""

    def __init__(self, texts: list[str]):
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.odd = np.array([len(t) > LONG or "\0" in t for t in texts], dtype=bool)
        points = _points(["" if odd else t for t, odd in zip(texts, self.odd, strict=True)])
        known = np.flatnonzero(np.bincount(points.ravel()))
        known = known[known > 0]
        number = np.zeros(max(int(known.max()) if len(known) else 0, 1) + 1, dtype=np.uint8 if len(known) < 256 else np.uint32)
        number[known] = np.arange(1, len(known) + 1)
        self._number = number
        self.codes, self._of = np.ascontiguousarray(number[points].T), {chr(c): k for k, c in enumerate(known, 1)}

    def masks(self, pattern: str, rows) -> np.ndarray:
        """Masks of a pattern of at most WORD characters with the rows (a slice or positions)."""
        table = np.zeros(len(self._of) + 1, dtype=_word(len(pattern)))
        for i, c in enumerate(pattern):
            if k := self._of.get(c):
                table[k] |= table.dtype.type(1 << i)
        return table[self.codes[:, rows]]

    def tables(self, patterns: list[str]) -> np.ndarray:
        """For each of the patterns, which have one length, the mask of each character."""
        points, every = _points(patterns), np.arange(len(patterns))
        out = np.zeros((len(patterns), len(self._of) + 1), dtype=_word(len(patterns[0])))
        for i in range(len(patterns[0])):
            out[every, np.where(points[:, i] < len(self._number), self._number[np.minimum(points[:, i], len(self._number) - 1)], 0)] |= out.dtype.type(1 << i)
        out[:, 0] = 0
        return out

    def masks_of(self, tables: np.ndarray, which: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Masks of pairs of tables (their positions which) and rows."""
        places = int(self.lengths[rows].max(initial=0))
        return tables.ravel().take(self.codes[:places].take(rows, axis=1) + (which * tables.shape[1]).astype(np.int32))

    def sums(self, letter: str) -> np.ndarray:
        """(place, row): how often the letter stands before the place; the last are the whole texts' counts."""
        out = np.zeros((len(self.codes) + 1, len(self.lengths)), dtype=np.int16)
        if k := self._of.get(letter):
            np.cumsum(self.codes == k, axis=0, dtype=np.int16, out=out[1:])
        return out


class Letters:
    """Bits of texts' letters, so that one operation bounds what a text shares with another, and with it their common subsequence.

    A bit says that a text has a letter at least k times. The 64 most frequent of the given texts have one; those that have
    none are taken as shared.
    """

    def __init__(self, texts: Iterable[str]):
        seen = Counter(x for t in texts for x in self._each(t))
        self._bit = {x: np.uint64(i) for i, (x, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:64])}
        self.letters: dict[str, list[tuple[int, np.uint64]]] = {}
        for (c, k), bit in self._bit.items():
            self.letters.setdefault(c, []).append((k, bit))

    @staticmethod
    def _each(text: str) -> list[tuple[str, int]]:
        return [(c, k) for c, n in Counter(text).items() for k in range(1, n + 1)]

    def of(self, text: str) -> tuple[np.uint64, int]:
        """The bits of one of the texts, and how many of its letters have none."""
        own = [self._bit[x] for x in self._each(text) if x in self._bit]
        return np.uint64(sum(1 << int(b) for b in own)), len(text) - len(own)

    def signs(self, counts: Callable[[str], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """Bits of other texts; counts: from a letter to how often each of them has it."""
        out = np.zeros(shape, dtype=np.uint64)
        for c, bits in self.letters.items():
            n = counts(c)
            for k, bit in bits:
                out |= (n >= k).astype(np.uint64) << bit
        return out


def _groups(patterns: list[str], texts: list[str], at: Iterable[int]) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """(n, positions, masks) of pairs whose patterns have n characters, in groups of like lengths."""
    at = sorted(at, key=lambda i: (len(patterns[i]), len(texts[i])))
    while at:
        n = len(patterns[at[0]])
        size, k = max(64, CELLS // max(len(texts[at[0]]), 1)), 1
        while k < min(size, len(at)) and len(patterns[at[k]]) == n and len(texts[at[k]]) <= 2 * len(texts[at[0]]) + 8:
            k += 1
        own, at = at[:k], at[k:]
        p, t = np.ascontiguousarray(_points([patterns[i] for i in own]).T), np.ascontiguousarray(_points([texts[i] for i in own]).T)
        masks = np.zeros(t.shape, dtype=_word(n))
        for i in range(n):
            masks |= (t == p[i]).astype(masks.dtype) << masks.dtype.type(i)
        yield n, own, masks


def _short(a: str, b: str) -> bool:
    return 0 < len(a) <= WORD and len(b) <= LONG and "\0" not in a and "\0" not in b


def lcs_lengths(pairs: list[tuple[str, str]]) -> np.ndarray:
    """lcs_length() of each pair."""
    a, b = [min(p, key=len) for p in pairs], [p[1] if len(p[0]) <= len(p[1]) else p[0] for p in pairs]
    fast = [i for i in range(len(pairs)) if _short(a[i], b[i])]
    out = np.zeros(len(pairs), dtype=np.int64)
    for n, own, masks in _groups(a, b, fast):
        out[own] = lcs_of_masks(masks, n)
    for i in set(range(len(pairs))).difference(fast):
        out[i] = lcs_length(a[i], b[i])
    return out


def ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """ratio() of each pair."""
    size = np.array([len(a) + len(b) for a, b in pairs], dtype=np.int64)
    return np.where(size > 0, 200.0 * lcs_lengths(pairs) / np.maximum(size, 1), 100.0)


def partial_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """partial_ratio() of each pair."""
    s, t = [a if len(a) <= len(b) else b for a, b in pairs], [b if len(a) <= len(b) else a for a, b in pairs]
    fast = [i for i in range(len(pairs)) if _short(s[i], t[i])]
    out = np.zeros(len(pairs))
    for x, y, at in ((s, t, fast), (t, s, [i for i in fast if len(s[i]) == len(t[i])])):
        for n, own, masks in _groups(x, y, at):
            out[own] = np.maximum(out[own], partial_of_masks(masks, n, np.array([len(y[i]) for i in own])))
    for i in set(range(len(pairs))).difference(fast):
        out[i] = partial_ratio(s[i], t[i])
    return out


def token_set_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """token_set_ratio() of each pair; rests are compared only where they could count for more than what is shared."""
    out, open_, rests = np.zeros(len(pairs)), [], []
    for i, (a, b) in enumerate(pairs):
        x, y = set(a.split()), set(b.split())
        if not x or not y:
            continue
        both, p, q = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
        if both and (not p or not q):
            out[i] = 100.0
            continue
        n = len(both)
        la, lb = n + (n > 0) + len(p), n + (n > 0) + len(q)
        out[i] = max(100.0 * 2 * n / (n + la), 100.0 * 2 * n / (n + lb)) if n else 0.0
        if 100.0 * (1 - abs(len(p) - len(q)) / (la + lb)) > out[i]:
            open_.append((i, len(p) + len(q), la + lb))
            rests.append((p, q))
    if open_:
        i, letters, size = np.array(open_).T
        out[i] = np.maximum(out[i], 100.0 * (1 - (letters - 2 * lcs_lengths(rests)) / size))
    return out


class WordSets:
    """A column of texts as sets of words, for token_set_ratio() of one text with many rows."""

    def __init__(self, texts: list[str]):
        self.words = [frozenset(t.split()) for t in texts]
        self.letters = np.array([sum(map(len, w)) for w in self.words], dtype=np.int64)
        self.counts = np.array([len(w) for w in self.words], dtype=np.int64)
        where: dict[str, list[int]] = {}
        for i, own in enumerate(self.words):
            for w in own:
                where.setdefault(w, []).append(i)
        self.where = {w: np.array(v) for w, v in where.items()}
        self._rests: dict = {}
        self._plain: dict = {}

    def _rest(self, shared: tuple[str, ...]) -> tuple[np.ndarray, Texts, list[str]]:
        """Rows that have all the words shared, and their other words."""
        if shared not in self._rests:
            if len(self._rests) >= 64:
                self._rests.clear()
            rows = np.arange(len(self.words))
            for w in shared:
                rows = np.intersect1d(rows, self.where[w], assume_unique=True)
            rest = [" ".join(sorted(self.words[i].difference(shared))) for i in rows]
            self._rests[shared] = rows, Texts(rest), rest
        return self._rests[shared]

    def scores(self, text: str, lo: int, hi: int) -> np.ndarray:
        """token_set_ratio() of text with the rows from lo to hi."""
        return self.scores_of([text], [np.arange(lo, hi)])

    def scores_of(self, texts: list[str], rows: list[np.ndarray], plain: bool = False) -> np.ndarray:
        """token_set_ratio() of several texts with their rows, which ascend, one after another; rests are compared for all texts at once.

        plain: many texts are of like lengths, so that rows' scores by frequent words are worked out once for all of them.
        """
        ends, groups = np.cumsum([0, *map(len, rows)]), {}
        out = np.zeros(ends[-1])
        for text, own, start, end in zip(texts, rows, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if not plain:
                at = np.arange(end - start)
            else:
                known, sure, often = self._alone(text)
                out[start:end], apart = known[own], ~sure[own]
                for w in set(text.split()) if len(own) else ():
                    if w in self.where and w not in often:
                        apart[self._having(w, own)] = True
                at = np.flatnonzero(apart)
            if len(at):
                out[start + at] = self._shared(text, own[at], start + at, groups)
        for (shared, n), parts in groups.items():
            self._rests_of(shared, n, parts, out)
        return out

    def _having(self, word: str, rows: np.ndarray) -> np.ndarray:
        """Positions of the rows, which ascend, that have a word."""
        holders = self.where[word]
        if rows[-1] - rows[0] + 1 == len(rows):
            return holders[slice(*np.searchsorted(holders, (rows[0], rows[-1] + 1)))] - rows[0]
        return np.flatnonzero(holders[np.minimum(np.searchsorted(holders, rows), len(holders) - 1)] == rows)

    def _shared(self, text: str, rows: np.ndarray, places: np.ndarray, groups: dict) -> np.ndarray:
        """Scores by the words that are shared. groups gets (text's rest, what stands before it, rows, their places) where rests may count for more."""
        mine, out = sorted(set(text.split())), np.zeros(len(rows))
        met = [(w, self._having(w, rows)) for w in mine if w in self.where]
        met = [(w, at) for w, at in met if len(at)]
        if not mine or len(met) > 60:
            return token_set_ratios([(text, " ".join(self.words[i])) for i in rows.tolist()]) if mine else out
        kind = np.zeros(len(rows), dtype=np.int64)
        for k, (_, at) in enumerate(met):
            kind[at] |= 1 << k
        for c in np.flatnonzero(np.bincount(kind)).tolist() if len(met) <= 10 else np.unique(kind).tolist():
            at = np.flatnonzero(kind == c)
            shared = tuple(w for k, (w, _) in enumerate(met) if c >> k & 1)
            n, p = len(" ".join(shared)), " ".join(w for w in mine if w not in shared)
            if n and not p:
                out[at] = 100.0
                continue
            more = self.counts[rows[at]] - len(shared)
            q = np.where(more > 0, self.letters[rows[at]] - sum(map(len, shared)) + more - 1, 0)
            head = n + (n > 0)
            la, lb = head + len(p), head + q
            score = np.maximum(100.0 * 2 * n / (n + la), 100.0 * 2 * n / (n + lb)) if n else np.zeros(len(at))
            need = np.flatnonzero((q > 0) & (100.0 * (1 - np.abs(len(p) - q) / (la + lb)) > score))
            if len(need):
                groups.setdefault((shared, len(p)), []).append((p, head, rows[at[need]], places[at[need]]))
            out[at] = np.where(q > 0, score, 100.0 if n else 0.0)
        return out

    def most(self, text: str, bits: np.uint64, others: int, signs: np.ndarray) -> np.ndarray:
        """Upper bounds of scores() of all rows, made from words that many rows have, lengths and Letters; rows with a rarer word of the text get 100.

        bits, others, signs: those of the text and of the rows' texts.
        """
        plain, need, apart, rest, sides, often = self._by_length(text)[1:]
        out = plain.copy()
        if len(need):
            both = np.bitwise_count(signs[need] & bits).astype(np.int64) + others
            out[need] = np.maximum(out[need], 100.0 * (1 - np.maximum(rest - 2 * both, apart) / sides))
        for w in set(text.split()):
            if w in self.where and w not in often:
                out[self.where[w]] = 100.0
        return out

    def _by_length(self, text: str) -> tuple:
        """_lengths() of a text, before them the scores without rounding and after them its frequent words."""
        mine = sorted(set(text.split()))
        often = tuple(w for w in mine if 64 * len(self.where.get(w, ())) > len(self.words))
        key = often, sum(map(len, mine)), len(mine)
        if key not in self._plain:
            if len(self._plain) >= 64:
                self._plain.clear()
            score, *rests = self._lengths(*key)
            self._plain[key] = score, score.astype(np.float32), *rests, often
        return self._plain[key]

    def _alone(self, text: str) -> tuple[np.ndarray, np.ndarray, tuple[str, ...]]:
        """Scores of rows by frequent words, for which rows they are the scores unless a rarer word is shared, and these words."""
        score, _, need, *_, often = self._by_length(text)
        sure = np.ones(len(score), dtype=bool)
        sure[need] = False
        return score, sure, often

    def _lengths(self, often: tuple[str, ...], size: int, count: int) -> tuple[np.ndarray, ...]:
        """Of a text of so many words and letters that shares only words of often: scores by them, and where rests may count for more: rows, what lengths differ by, rests' letters, both sides' letters."""
        letters, words = np.zeros(len(self.words), dtype=np.int64), np.zeros(len(self.words), dtype=np.int64)
        for w in often:
            letters[self.where[w]] += len(w)
            words[self.where[w]] += 1
        n = letters + np.maximum(words - 1, 0)
        p, q = size - letters + np.maximum(count - words - 1, 0), self.letters - letters + np.maximum(self.counts - words - 1, 0)
        la, lb = n + (n > 0) + p, n + (n > 0) + q
        score = np.where(n > 0, 200.0 * n / np.maximum(np.minimum(n + la, n + lb), 1), 0.0)
        score[(n > 0) & ((p == 0) | (q == 0))] = 100.0
        need = np.flatnonzero((p > 0) & (q > 0) & (100.0 * (1 - np.abs(p - q) / np.maximum(la + lb, 1)) > score))
        return score, need, np.abs(p - q)[need], (p + q)[need], (la + lb)[need]

    def _rests_of(self, shared: tuple[str, ...], n: int, parts: list[tuple], out: np.ndarray) -> None:
        """Raise out to the scores of rests of n characters with the rows' rests."""
        rows, at = np.concatenate([x[2] for x in parts]), np.concatenate([x[3] for x in parts])
        holders, texts, rest = self._rest(shared)
        patterns, head = [x[0] for x in parts], parts[0][1]
        which, k = np.repeat(np.arange(len(parts)), [len(x[2]) for x in parts]), np.searchsorted(holders, rows)
        if n > WORD:
            lcs = lcs_lengths([(patterns[i], rest[j]) for i, j in zip(which.tolist(), k.tolist(), strict=True)])
        else:
            tables, lcs, step = texts.tables(patterns), np.zeros(len(at), dtype=np.int64), max(64, CELLS // max(len(texts.codes), 1))
            for i in range(0, len(at), step):
                lcs[i : i + step] = lcs_of_masks(texts.masks_of(tables, which[i : i + step], k[i : i + step]), n)
            for j in np.flatnonzero(texts.odd[k]).tolist():
                lcs[j] = lcs_length(patterns[which[j]], rest[k[j]])
        q = texts.lengths[k]
        indel, size = n + q - 2 * lcs, head + n + head + q
        out[at] = np.maximum(out[at], 100.0 * (1 - indel / size))


def _udf(function: Callable[[list[tuple[str, str]]], np.ndarray]):
    """A function of two columns, which is given each different pair once; the Arrow UDF is made on use, when there is a session."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        number, pairs = pd.factorize(pd.Series(list(zip(a.fillna(""), b.fillna(""), strict=True)), dtype=object))
        return pd.Series(function(list(pairs))[number] if len(pairs) else [], dtype="float64")

    return lambda a, b: F.pandas_udf(run, "double")(a, b)


ratio_udf, partial_ratio_udf, token_set_ratio_udf = _udf(ratios), _udf(partial_ratios), _udf(token_set_ratios)
