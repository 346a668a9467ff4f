"""Toxicity of texts whose words may be obfuscated.

A word is taken as a noisy form of a plain one: letters replaced by digits and
symbols, letters repeated or doubled, letters or pieces set apart by blanks or
marks. Suspicious tokens of any length, runs of single letters, and tokens that
make up a telling word one after the other become a lattice of plain letters with
a cost for each kind of noise, in which a mark or blank is dropped or a border of
words. A Viterbi search finds the reading that is likeliest together with a
character trigram model, counted over all documents. The restored text is then
scored.

The score is a logistic regression over telling words and stems that several
words of a text share. They are chosen by their likelihood ratio, which is also where
their weights start from, and fitted on at most about ``fit_rows`` labelled documents, equal texts counted once; the
classifier sees restored words only, never label, language, source or key.

NULL and empty texts get the score of a text without telling words; rows that
repeat are scored each; without labels every score is one half below; an empty
table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import col, seeded
from tidyloom.session import cut_lineage

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
SIZE = len(LETTERS) + 1  # 0 stands for any border of a word
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
# Letters that digits and symbols stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
    "*": "aeiou", "#": "aeiou",
}
# Letters of other scripts that look like plain ones; full-width forms.
LOOKALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "һ": "h", "к": "k", "м": "m", "т": "t", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u",
}
WIDE = {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
SEEMS = LOOKALIKE | WIDE
#: Cost of reading a look-alike.
ALIKE = 0.5
REPLACE, DROP_MARK, DROP_LEET, DROP_REPEAT, DROP_DOUBLE = 1.0, 0.7, 6.0, 0.5, 8.0
#: Cost of dropping a blank beside a piece of several characters.
JOIN = 6.0
#: Cost of taking a telling word as a whole instead of letter by letter.
WHOLE_WORD = 8.0
#: Characters after which a search moves what all its states share to its result.
SETTLE = 64
#: Characters remembered in each store of a Python worker (other operators share its memory).
CACHE_CHARS = 1_500_000
#: Text whose tokens are looked up together, in characters.
PIECE_CHARS = 2 << 20
#: Beginnings of tokens (three characters) remembered.
HEADS = 100_000
FIT_ROWS = 20_000
#: Evidence (G²) from which a word counts as telling, and its least number of texts.
EVIDENCE, LEAST_TEXTS = 18.0, 3
#: Lengths of the stems that count when several distinct words share them.
STEMS = (4, 5, 6, 7)
EDGE = re.compile(r"^([^\w\s])\1+|([^\w\s])\2+$|[.,;:?!\"')\]}>]+$|^[\"'(\[{<]+(?=\w)")
TWICE = re.compile(r"(.)\1")
RUNS = re.compile(r"(.)\1+")
CLOSING = ".,;:?!\"')]}>"
ONLY_LETTERS = re.compile(f"[{LETTERS}]+").fullmatch
# The same for columns, without references back.
ALL_LETTERS = f"^[{LETTERS}]+$"
SOME_TWICE = "|".join(c + c for c in LETTERS)
ODD = re.compile(f"[{''.join(SEEMS)}]")
MORE = re.compile(r"(.)\1{3,}")


# --- language model ----------------------------------------------------------------------


def trigram_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram index at each character of the words, and the word of each."""
    text = "  " + "  ".join(words) + "  "
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = np.zeros(0x180, np.int64)
    for c, i in CODE.items():
        table[ord(c)] = i
    code = table[np.where(points < 0x180, points, 0)]
    word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    a, b, c = code[:-2], code[1:-1], code[2:]
    index = (a * SIZE + b) * SIZE + c
    return np.where((c > 0) | (b > 0), index, -1)[: len(word)], word


def count_trigrams(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Letter trigram counts over all words of all rows (a cube of fixed size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        words: Counter = Counter()

        def flush() -> None:
            if words:
                index, word = trigram_codes(list(words))
                weight = np.fromiter(words.values(), np.int64, len(words))[word]
                good = index >= 0
                total[:] += np.bincount(index[good], weight[good], SIZE**3).astype(np.int64)
                words.clear()

        for b in batches:
            for text in b.column(0):
                words.update((text.as_py() or "").lower().split())
                if len(words) > 150_000:
                    flush()
        flush()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    texts = df.select(col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    cube = np.zeros(SIZE**3)
    cube[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return cube.reshape(SIZE, SIZE, SIZE)


def costs(cube: np.ndarray, blend: float = 5.0) -> np.ndarray:
    """-log P(c | a, b), each order blended with the next lower one."""
    one = (cube.sum((0, 1)) + 1) / (cube.sum() + SIZE)
    two = cube.sum(0)
    two = (two + blend * one) / (two.sum(1, keepdims=True) + blend)
    three = (cube + blend * two[None]) / (cube.sum(2, keepdims=True) + blend)
    return -np.log(three).astype(np.float32)


# --- channel -----------------------------------------------------------------------------


def options(token: str, i: int) -> list[tuple[str, float]]:
    """Plain letters for one observed character of a token ('' drops it)."""
    c = token[i]
    if c in CODE:
        found = [(c, 0.0)]
        if i and token[i - 1] == c:
            thrice = token[i - 2 : i + 1] == c * 3 or token[i - 1 : i + 2] == c * 3
            found.append(("", DROP_REPEAT if thrice else DROP_DOUBLE))
        return found
    if c in SEEMS:
        return [(SEEMS[c], ALIKE)]
    if c in LEET:
        return [*((x, REPLACE + math.log(len(LEET[c]))) for x in LEET[c]), ("", DROP_LEET)]
    return [("", DROP_MARK)]


def readings(token: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each observed character its plain letters."""
    return [options(token, i) for i in range(len(token))]


def borders(token: str) -> list[float | None]:
    """Cost of reading each character as a border of words (None for letters)."""
    letters = CODE.keys() | SEEMS.keys()
    return [None if c in letters else 0.0 if c == " " else DROP_LEET if c in LEET else DROP_MARK for c in token]


def joined(token: str) -> list[list[tuple[str, float]]]:
    """The lattice of a token or of several with blanks between them."""
    out = readings(token)
    for i, c in enumerate(token):
        if c == " " and not (token[i - 2 : i - 1] in ("", " ") and token[i + 2 : i + 3] in ("", " ")):
            out[i] = [("", JOIN)]
    return out


def viterbi(
    token: str, cost: np.ndarray, known: dict[str, list[str]] | None = None, split: bool = False
) -> tuple[float, str]:
    """The cheapest reading of a token and its cost; states are the last two plain letters.

    With ``split`` marks and blanks may be borders of words, blanks in the result.
    Words of ``known`` (lists by first letter) may stand between borders as a whole.
    """
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    # Words being taken as a whole: how many of their letters are read.
    whole: dict[tuple[str, int], tuple[float, str]] = {}
    ends, settled = borders(token) if split else [None] * len(token), []
    fresh = True  # whether a border has just been read
    for i, letters in enumerate(joined(token) if split else readings(token)):
        if known and fresh and (0, 0) in states:
            total, text = states[0, 0]
            for word in {w for letter, _ in letters for w in known.get(letter, ())}:
                whole[word, 0] = total + WHOLE_WORD, text
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (total, text) in states.items():
            for letter, noise in letters:
                if letter:
                    c = CODE[letter]
                    key, value, plain = (b, c), total + noise + cost[a, b, c], text + letter
                else:
                    key, value, plain = (a, b), total + noise, text
                if key not in new or (value, plain) < new[key]:
                    new[key] = (value, plain)
            if ends[i] is not None:
                done = (total + ends[i] + cost[a, b, 0], text + " ") if b else (total + ends[i], text)
                if (0, 0) not in new or done < new[0, 0]:
                    new[0, 0] = done
        taken: dict[tuple[str, int], tuple[float, str]] = {}
        for (word, n), (total, text) in whole.items():
            for letter, noise in letters:
                if not letter or word[n : n + 1] == letter:
                    key, value = (word, n + len(letter)), (total + noise, text)
                    if key not in taken or value < taken[key]:
                        taken[key] = value
            if n == len(word) and ends[i] is not None:
                done = (total + ends[i], text + word + " ")
                if (0, 0) not in new or done < new[0, 0]:
                    new[0, 0] = done
        states, whole, fresh = new, taken, ends[i] is not None
        if i % SETTLE == SETTLE - 1:
            texts = [t for _, t in (*states.values(), *whole.values())]
            n = len(os.path.commonprefix(texts))
            settled.append(texts[0][:n])
            states = {k: (v, t[n:]) for k, (v, t) in states.items()}
            whole = {k: (v, t[n:]) for k, (v, t) in whole.items()}
    last = [(total + (cost[a, b, 0] if b or not split else 0.0), text) for (a, b), (total, text) in states.items()]
    last += [(total, text + word) for (word, n), (total, text) in whole.items() if n == len(word)]
    total, text = min(last)
    return total, "".join(settled) + text


def noise_of(token: str, word: str) -> float:
    """Cheapest noise that turns ``word`` into ``token`` (infinite if none does)."""
    best = [0.0] + [math.inf] * len(word)
    for letters in readings(token):
        new = [math.inf] * len(best)
        for letter, noise in letters:
            if not letter:
                new = [min(x, y + noise) for x, y in zip(new, best)]
            else:
                for j, c in enumerate(word):
                    if c == letter:
                        new[j + 1] = min(new[j + 1], best[j] + noise)
        best = new
    return best[-1]


class Store(dict):
    """What has been found for texts; emptied when its keys get long together."""

    chars = 0

    def keep(self, key, found, size: int):
        self.chars += size + 20
        if self.chars > CACHE_CHARS:
            self.clear()
            self.chars = size + 20
        self[key] = found
        return found


def spelled(token: str, before: str, allowed: set[str]) -> set[str]:
    """What the readings of a token, put behind ``before``, may spell within ``allowed`` (and ``before``)."""
    token = MORE.sub(r"\1\1\1", token)
    found = {before}
    for i in range(len(token)):
        found = {w for f in found for letter, _ in options(token, i) if (w := f + letter) == before or w in allowed}
        if not found:
            break
    return found - {before}


def can_begin(head: str, allowed: set[str]) -> bool:
    """Whether readings of a token with this beginning may stay within ``allowed``."""
    found = {""}
    for i in range(len(head)):
        found = {w for f in found for letter, _ in options(head, i) if not (w := f + letter) or w in allowed}
    return bool(found) and bool(allowed)


class Starts(Store):
    """Beginnings of known words that a token, put behind another beginning, may spell."""

    def __init__(self, known: list[str]):
        super().__init__()
        self.begun = {w[:i] for w in known for i in range(len(w) + 1)}

    def __missing__(self, key: tuple[str, str]) -> frozenset[str]:
        before, token = key
        if is_plain(token):
            found = frozenset([before + token]) & self.begun  # its only reading
        else:
            found = frozenset(spelled(token, before, self.begun))
        return self.keep(key, found, len(before) + len(token))


def is_plain(token: str) -> bool:
    """Whether a token can be read in one way only."""
    return ONLY_LETTERS(token) is not None and not TWICE.search(token)


def is_single(token: str) -> bool:
    """Whether a token may be one letter of a word set apart by blanks."""
    return len(token) == 1 or (len(token) == 2 and not token.isalnum())


def runs_of(single: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of two or more single tokens of one text."""
    if not len(single):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joins = single[1:] & single[:-1] & (owner[1:] == owner[:-1])
    begin, end = np.flatnonzero(single & ~np.append(False, joins)), np.flatnonzero(single & ~np.append(joins, False)) + 1
    long = end - begin >= 2
    return begin[long], end[long]


def core_of(token: str) -> str:
    """A token without the marks around it."""
    if token.isalpha():
        return token
    while True:
        cut = EDGE.sub("", token)
        if cut == token:
            return cut
        token = cut


class Restorer(Store):
    """Plain form of lower-case tokens, remembered within a Python worker.

    A form of several words has blanks between them. ``known`` words may also be
    taken as a whole, at a fixed cost.
    """

    def __init__(self, cost: np.ndarray, known: list[str] = ()):
        super().__init__()
        self.cost = cost
        self.known: dict[str, list[str]] = {}
        for w in sorted(known):
            self.known.setdefault(w[:1], []).append(w)
        self.complete = frozenset(known)
        self.starts = Starts(list(known))
        self.runs = Store()

    def decode(self, core: str) -> str:
        core = MORE.sub(r"\1\1\1", core)
        return viterbi(core, self.cost, self.known, split=True)[1].strip()

    @staticmethod
    def is_noisy(core: str) -> bool:
        """Whether a token without its edges has to be decoded."""
        if core.isalpha() and not TWICE.search(core) and not ODD.search(core):
            return False
        return any(c in CODE or c in WIDE for c in core)

    def __missing__(self, token: str) -> str:
        core = core_of(token)
        plain = self.decode(core) if self.is_noisy(core) else core
        return self.keep(token, plain, 2 * len(token))

    def run(self, tokens: list[str]) -> str:
        """Plain form of tokens that may belong together."""
        text = " ".join(tokens)
        return self.runs[text] if text in self.runs else self.runs.keep(text, self.decode(text), 2 * len(text))

    def pieces(self, tokens: list[str], first: int, end: int) -> Iterator[tuple[int, int]]:
        """Ranges of tokens from ``first`` on that spell a known word one after the other."""
        found, j = self.starts["", tokens[first]], first + 1
        while found and j < end:
            found = frozenset().union(*(self.starts[f, tokens[j]] for f in found))
            j += 1
            if found & self.complete:
                yield first, j

    def joined_ranges(
        self, tokens: list[str], end: int, singles: list[tuple[int, int]], first: list[int]
    ) -> set[tuple[int, int]]:
        """Ranges of the tokens of a text (which ``end`` there) that are read as one.

        ``singles`` are its runs of two and more single characters; a range that starts
        or ends in one takes it whole. ``first`` are the tokens that may begin a known
        word spelled by several.
        """
        edges = {k: (i, j) for i, j in singles for k in range(i, j)} if first else {}
        ranges = {(i, j) for i, j in singles if j - i >= 3 and sum(t[0] in CODE or t[0] in WIDE for t in tokens[i:j]) >= 2}
        for k in first:
            for i, j in self.pieces(tokens, k, end):
                ranges.add((edges.get(i, (i, j))[0], edges.get(j - 1, (i, j))[1]))
        return ranges

    def words(self, text: str | None) -> set[str]:
        """Distinct restored words, with those set apart by blanks put together."""
        tokens = (text or "").lower().split()
        plain: set[str] = set()
        for t in set(tokens):
            plain.update(self[t].split())
        first = [i for i, t in enumerate(tokens) if self.starts["", t]] if self.complete else []
        single = np.fromiter(map(is_single, tokens), bool, len(tokens))
        singles = list(zip(*(x.tolist() for x in runs_of(single, np.zeros(len(tokens), np.int64)))))
        for i, j in self.joined_ranges(tokens, len(tokens), singles, first):
            plain.update(self.run(tokens[i:j]).split())
        return plain


# --- classifier --------------------------------------------------------------------------


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, start: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights of a logistic regression by Newton steps (intercept first).

    They are drawn towards ``start``; the intercept is free. Rows stand for ``n``
    cases each. A step is halved until the loss falls.
    """
    x = np.column_stack([np.ones(len(x)), x])
    start = np.concatenate([[0.0], start])
    w = start.copy()
    keep = np.full(len(w), ridge)
    keep[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + (keep * (w - start) ** 2).sum() / 2)

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (n * (p - y)) + keep * (w - start)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(keep), slope)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        w, before, now = w - step, now, loss(w - step)
        if before - now < 1e-9:
            break
    return w


def features(words: set[str]) -> list[str]:
    """The words, and each stem that two (three) or more of them begin with."""
    stems = Counter(w[:k] for w in words for k in STEMS if len(w) > k)
    return sorted([*words, *(f"{p} x{n}" for p, m in stems.items() for n in (2, 3) if m >= n)])


class Model:
    """Character costs, and a logistic regression over telling features."""

    def __init__(self, cost: np.ndarray, weights: dict[str, float], intercept: float):
        self.cost, self.weights, self.intercept = cost, weights, intercept
        self.key = uuid.uuid4().hex
        self.stems = {f.split(" ")[0] for f in weights if " " in f}

    def words(self) -> list[str]:
        return [f for f in self.weights if " " not in f]


def log_odds(model: Model, words: set[str]) -> float:
    """The score of a text's restored words, before it is squeezed into 0 to 1."""
    weights = model.weights
    stems = Counter(w[:k] for w in words for k in STEMS if len(w) > k and w[:k] in model.stems)
    shared = (weights.get(f"{p} x{n}", 0.0) for p, m in stems.items() for n in (2, 3) if m >= n)
    return model.intercept + math.fsum(weights.get(w, 0.0) for w in words) + math.fsum(shared)


class Scorer:
    """Scores of many texts at once, the same as ``log_odds`` of each text's ``words``.

    Tokens of a piece of text are numbered, so what a token tells is found once for
    each distinct one. Only restored words count that are telling or begin with a
    telling stem; a token that can't be read as one isn't decoded.
    """

    def __init__(self, model: Model):
        self.model = model
        self.restorer = Restorer(model.cost, model.words())
        self.telling = {w for w in model.weights if " " not in w}
        self.beginnings = self.telling | model.stems
        self.four = {w[:4] for w in self.beginnings}
        #: Runs of letters in the words are one letter here, as any letter may be a repetition.
        self.once_telling = {RUNS.sub(r"\1", w) for w in self.telling}
        self.once_stems = {RUNS.sub(r"\1", w) for w in model.stems}
        self.once_lengths = sorted({len(w) for w in self.once_stems})
        self.begun = {w[:i] for w in self.beginnings for i in range(len(w) + 1)}
        #: Beginnings of telling words, and what may follow a beginning.
        self.opening = self.restorer.starts.begun if self.telling else set()
        self.inside = {w[i:j] for w in self.telling for i in range(1, len(w)) for j in range(i, len(w) + 1)}
        self.heads: dict[str, tuple[bool, bool]] = {}
        self.cores = Store()

    def tells(self, word: str) -> bool:
        if word[:4] not in self.four:
            return False
        stems = self.model.stems
        return word in self.telling or any(len(word) > k and word[:k] in stems for k in STEMS)

    def may_tell(self, core: str) -> bool:
        """Whether any reading of a token that has several has a word that tells something."""
        core = MORE.sub(r"\1\1\1", core)
        found: set[str] = {""}
        for i, end in enumerate(borders(core)):
            found = {f + letter for f in found for letter, _ in options(core, i)} & self.begun
            if found & self.beginnings:
                return True
            if end is not None:
                found.add("")
        return False

    def words_of(self, core: str) -> tuple[str, ...]:
        """The telling words of a token without its edges."""
        if ONLY_LETTERS(core):
            if not TWICE.search(core):
                return (core,) if self.tells(core) else ()
            # Its readings differ in repetitions alone.
            once = RUNS.sub(r"\1", core)
            if once not in self.once_telling and not any(once[:k] in self.once_stems for k in self.once_lengths):
                return ()
        elif not self.restorer.is_noisy(core):
            return tuple(w for w in core.split() if self.tells(w))
        elif not self.may_tell(core):
            return ()
        if core in self.cores:
            return self.cores[core]
        found = tuple(w for w in self.restorer.decode(core).split() if self.tells(w))
        return self.cores.keep(core, found, len(core))

    def head(self, head: str) -> tuple[bool, bool]:
        """Whether tokens with this beginning may begin, or go on with, a telling word spelled by several."""
        if head not in self.heads:
            known = tuple(can_begin(head, allowed) for allowed in (self.opening, self.inside))
            if len(self.heads) >= HEADS:
                return known
            self.heads[head] = known
        return self.heads[head]

    def begins(self, token: str) -> bool:
        """Whether a token may begin a telling word spelled by several."""
        return token in self.opening if is_plain(token) else bool(self.restorer.starts["", token])

    def goes_on(self, token: str) -> bool:
        """Whether a token may be a later part of such a word."""
        return token in self.inside if is_plain(token) else bool(spelled(token, "", self.inside))

    def told(self, tokens: pa.Array) -> tuple[dict[int, tuple[str, ...]], np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct tokens: the telling words of those that have any; which are single, which begin, which might go on.

        A token whose only reading does not begin like a telling word is passed over
        by vector; the others are looked at one by one.
        """
        core = pc.utf8_rtrim(tokens, characters=CLOSING)
        once = pc.and_not(pc.match_substring_regex(core, ALL_LETTERS), pc.match_substring_regex(core, SOME_TWICE))
        begins = pc.is_in(pc.utf8_slice_codeunits(core, 0, 4), value_set=pa.array(sorted(self.four), pa.string()))
        look = np.flatnonzero(~once.to_numpy(zero_copy_only=False) | begins.to_numpy(zero_copy_only=False))
        words = {}
        for i, token in zip(look.tolist(), tokens.take(pa.array(look)).to_pylist()):
            own = token if token.isalpha() else token.rstrip(CLOSING)
            found = self.words_of(own if own.isalpha() else core_of(token))
            if found:
                words[i] = found
        single = np.zeros(len(tokens), bool)
        short = np.flatnonzero(pc.less_equal(pc.utf8_length(tokens), 2).to_numpy(zero_copy_only=False))
        single[short] = [is_single(t) for t in tokens.take(pa.array(short)).to_pylist()]
        heads = pc.utf8_slice_codeunits(tokens, 0, 3).dictionary_encode()
        known = np.array([self.head(h) for h in heads.dictionary.to_pylist()], bool).reshape(-1, 2)
        first, inner = known[heads.indices.to_numpy()].T.copy()
        some = np.flatnonzero(first)
        first[some] = [self.begins(t) for t in tokens.take(pa.array(some)).to_pylist()]
        return words, single, first, inner

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < PIECE_CHARS):
                size += len(texts[to] or "")
                to += 1
            out[at:to] = self.piece(texts[at:to])
            at = to
        return out

    def piece(self, texts: list[str | None]) -> list[float]:
        tokens: list[str] = []
        ends = [0]
        for t in texts:
            if t:
                tokens += t.lower().split()
            ends.append(len(tokens))
        words: list[set[str]] = [set() for _ in texts]
        if tokens:
            coded = pa.array(tokens, pa.string()).dictionary_encode()
            code = coded.indices.to_numpy()
            told, single, first, inner = self.told(coded.dictionary)
            single, first = single[code], first[code]
            hit = np.zeros(len(coded.dictionary), bool)
            hit[list(told)] = True
            hit = hit[code]
            owner = np.searchsorted(ends, np.arange(len(code)), "right") - 1
            at = np.flatnonzero(hit)
            for i, c in zip(owner[at].tolist(), code[at].tolist()):
                words[i].update(told[c])
            # A telling word spelled by several tokens needs one that begins it and one that goes on.
            first[:-1] &= inner[code[1:]] & (owner[1:] == owner[:-1])
            first[-1] = False
            begins = np.flatnonzero(first)
            after, which = np.unique(code[begins + 1], return_inverse=True)
            goes_on = np.array([self.goes_on(t) for t in coded.dictionary.take(pa.array(after)).to_pylist()], bool)
            begins = begins[goes_on[which]]
            found: dict[int, tuple[list, list]] = {}
            for k in begins.tolist():
                found.setdefault(int(owner[k]), ([], []))[1].append(k)
            for i, j in zip(*(x.tolist() for x in runs_of(single, owner))):
                found.setdefault(int(owner[i]), ([], []))[0].append((i, j))
            for i, (runs, begins) in found.items():
                for a, b in self.restorer.joined_ranges(tokens, ends[i + 1], runs, begins):
                    words[i].update(w for w in self.restorer.run(tokens[a:b]).split() if self.tells(w))
        return [log_odds(self.model, w) for w in words]


_WORKER: dict[str, Scorer] = {}


def worker_scorer(model: Model) -> Scorer:
    """One scorer in each Python worker, for the latest model."""
    if model.key not in _WORKER:
        _WORKER.clear()
        _WORKER[model.key] = Scorer(model)
    return _WORKER[model.key]


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", fit_rows: int = FIT_ROWS, seed: int = 5,
) -> Model:
    """Fit on ``labels`` (one row per key counts; the larger label wins)."""
    spark = docs.sparkSession
    cost = costs(count_trigrams(docs, text_col))
    known = labels.where(col(label_col).isNotNull()).groupBy(col(id_col).alias("id")).agg(
        F.max(col(label_col).cast("int")).alias("toxic")
    )
    n = known.count()
    # At most about fit_rows rows, so this side may be sent to all executors.
    drawn = known.where(seeded(F.col("id"), seed) < int(2147483647 * min(1.0, fit_rows / max(1, n))))
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(drawn), "id")
    sent = spark.sparkContext.broadcast(cost)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(sent.value)
        for b in batches:
            texts = b.column(0).to_pylist()
            words = pa.array([features(restorer.words(t)) for t in texts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), words], ["toxic", "same", "words"])

    marked = rows.select("text", "toxic", F.sha2(F.coalesce("text", F.lit("")), 256).alias("same"))
    restored = marked.mapInArrow(restore, "toxic int, same string, words array<string>")
    distinct = restored.groupBy("same").agg(F.max("toxic").alias("toxic"), F.first("words").alias("words"))
    texts = cut_lineage(distinct.drop("same"))
    total = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        return Model(cost, {}, math.log((bad + 0.5) / (good + 0.5)))
    by_word = texts.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")
    )
    a, b = F.col("a"), F.col("b")
    share = (a + b) / F.lit(bad + good)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    evidence = 2 * (
        part(a, share * bad) + part(b, share * good)
        + part(bad - a, (1 - share) * bad) + part(good - b, (1 - share) * good)
    )
    ratio = F.log((a + 0.5) / F.lit(bad + 1)) - F.log((b + 0.5) / F.lit(good + 1))
    telling = by_word.where((a >= LEAST_TEXTS) & (ratio > 0) & (evidence >= EVIDENCE))
    # All of this comes from no more than about fit_rows texts.
    known: dict[tuple, tuple[str, float]] = {}
    for r in sorted(telling.select("w", "a", "b", ratio.alias("r")).collect(), key=lambda r: r["w"]):
        # Of stems that begin alike and are seen equally often one is enough.
        stem, _, times = r["w"].partition(" ")
        known.setdefault((stem[: STEMS[0]], times, r["a"], r["b"]) if times else (stem,), (r["w"], r["r"]))
    place = {f: i for i, (f, _) in enumerate(known.values())}
    start = np.array([r for _, r in known.values()])
    lists = F.array(*[F.lit(f) for f in place]).cast("array<string>")
    cases = texts.groupBy("toxic", F.array_intersect("words", lists).alias("hits")).count().collect()
    x = np.zeros((len(cases), len(place)))
    for row, case in zip(x, cases):
        row[[place[f] for f in case["hits"]]] = 1
    fit = logistic(x, np.array([c["toxic"] for c in cases]), np.array([c["count"] for c in cases], float), start)
    return Model(cost, dict(zip(place, fit[1:].tolist())), float(fit[0]))


def scorer(spark, model: Model):
    """A column function: text to score."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        z = worker_scorer(sent.value).scores(texts.tolist())
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return score


def score_toxicity(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add ``out`` to every row, without a shuffle."""
    return df.withColumn(out, scorer(df.sparkSession, model)(col(text_col).cast("string")))


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels outside the held-out fifth."""
    return labels.where(~held_out(col(id_col)))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))
