"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. Reading a word, the
automaton follows it as long as the letters read so far occur in the language's text; where
they stop, a phrase ends and a new one begins. The language whose automaton needs the
fewest phrases per letter explains the text best. Phrases end with their word, so the count
of a text is a sum over its words, and a task parses each distinct word once.

The finished automata are compiled to arrays, once in a Python worker: a hash table leads from
state and letter to the next state. The words that a slice of texts shows first are parsed
together, letter by letter: one numpy vector holds the state of every word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.slices import bounded

#: At most so many labelled documents per language are learned from, chosen by hash of the
#: text, and at most so many distinct words of theirs: the bound of the model.
SAMPLE_DOCS = 200
SAMPLE_WORDS = 12_000
#: Languages at most; each has its automaton in every worker.
MAX_LANGUAGES = 200
UNKNOWN = "und"
REMEMBER = 400_000
#: Bytes of text in a slice (a longer text is a slice of its own), and letters of words parsed at
#: once. Words of more than LONG letters are parsed alone where fewer than FEW are so long.
SLICE = 2 << 20
TOGETHER = 1 << 21
LONG, FEW = 512, 32
#: The code points, and the factor that spreads the keys of the hash table.
CODES = 0x110000
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """All substrings of a list of words, as a chain of states with suffix links."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for word in words:
            last = 0
            for letter in word:
                last = self._extend(last, letter)

    def _extend(self, last: int, letter: str) -> int:
        known = self.next[last].get(letter)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is None:
            state = self._state({}, self.length[last] + 1)
            at = last
            while at >= 0 and letter not in self.next[at]:
                self.next[at][letter] = state
                at = self.link[at]
            if at < 0:
                self.link[state] = 0
                return state
        else:
            state, at = -1, last
        target = self.next[at][letter]
        if self.length[target] == self.length[at] + 1:
            self.link[state] = target
            return state
        clone = self._state(dict(self.next[target]), self.length[at] + 1)
        self.link[clone] = self.link[target]
        self.link[target] = clone
        if state >= 0:
            self.link[state] = clone
        while at >= 0 and self.next[at].get(letter) == target:
            self.next[at][letter] = clone
            at = self.link[at]
        return state if state >= 0 else clone

    def _state(self, following: dict[str, int], length: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def phrases(self, word: str) -> int:
        """Phrases of the greedy parse; a letter the language never shows is one phrase."""
        count, state = 0, 0
        for letter in word:
            after = self.next[state].get(letter)
            if after is None:
                count += state != 0
                after = self.next[0].get(letter)
                if after is None:
                    count += 1
                    after = 0
            state = after
        return count + (state != 0)


def text_words(text: str) -> list[str]:
    """Lower-case runs between white space, framed by spaces, that hold a letter."""
    return [f" {w} " for w in text.lower().split()]


def sample(docs: DataFrame, lang: str = "lang", text: str = "text", docs_per_language: int = SAMPLE_DOCS) -> DataFrame:
    """Up to `docs_per_language` whole documents of each language, by hash of their text."""
    by_hash = Window.partitionBy(lang).orderBy(F.xxhash64(text), text)
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    return usable.withColumn("_n", F.row_number().over(by_hash)).where(F.col("_n") <= docs_per_language).drop("_n")


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", docs_per_language: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """Distinct words of the sample by language, bounded by the three parameters."""
    def distinct(batches):
        for part in batches:
            rows = [
                (name, w)
                for name, body in zip(part[lang], part[text], strict=True)
                for w in dict.fromkeys(text_words(body))
                if len(w) <= 42 and any(c.isalpha() for c in w)
            ]
            yield part.__class__(rows, columns=["lang", "word"])

    few = sample(docs, lang, text, docs_per_language).mapInPandas(distinct, "lang string, word string")
    often = few.groupBy("lang", "word").agg(F.count("*").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), F.xxhash64("word"), "word")
    rows = often.withColumn("_k", F.row_number().over(top)).where(F.col("_k") <= SAMPLE_WORDS).collect()
    model: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["_k"])):
        model.setdefault(r["lang"], []).append(r["word"])
    if len(model) > MAX_LANGUAGES:
        raise ValueError(f"{len(model)} languages; the model is meant for {MAX_LANGUAGES} at most")
    return model


class Transitions:
    """The transitions of an automaton as a hash table with open addressing."""

    def __init__(self, automaton: SuffixAutomaton, number: dict[str, int]):
        self.width = len(number) + 1
        key = np.array([s * self.width + number[c] for s, after in enumerate(automaton.next) for c in after], np.int64)
        to = np.array([t for after in automaton.next for t in after.values()], np.int64)
        bits = (4 * len(key) + 1).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.to = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        at = self._home(key)
        while len(key):
            free = self.key[at] < 0
            self.key[at[free]] = key[free]
            settled = self.key[at] == key
            self.to[at[settled]] = to[settled]
            key, to, at = key[~settled], to[~settled], (at[~settled] + 1) & self.mask
        self.first = self.after(np.zeros(self.width, np.int64), np.arange(self.width))

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * SPREAD >> self.shift).view(np.int64)

    def after(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        key = state * self.width + letter
        at = self._home(key)
        found = self.key[at]
        hit = found == key
        out = np.where(hit, self.to[at], -1)
        left = np.flatnonzero(~hit & (found >= 0))
        at, key = at[left], key[left]
        while len(left):
            at = (at + 1) & self.mask
            found = self.key[at]
            hit = found == key
            out[left[hit]] = self.to[at[hit]]
            more = ~hit & (found >= 0)
            left, at, key = left[more], at[more], key[more]
        return out

    def phrases(self, letters: list[np.ndarray], n: int) -> np.ndarray:
        """Phrases of n words by decreasing length; `letters` has, for each place, the words' letters there."""
        count, state = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for letter in letters:
            before = state[: len(letter)]
            after = self.after(before, letter)
            ended = np.flatnonzero(after < 0)
            again = self.first[letter[ended]]
            count[ended] += (before[ended] != 0).astype(np.int64) + (again < 0)
            after[ended] = np.maximum(again, 0)
            state[: len(letter)] = after
        return count + (state != 0)


class Languages:
    """The learned words by language; a worker compiles them when it first parses."""

    def __init__(self, model: dict[str, list[str]]):
        self.names = sorted(model)
        self.words = [model[n] for n in self.names]

    @cached_property
    def number(self) -> dict[str, int]:
        return {c: k for k, c in enumerate(sorted({c for words in self.words for w in words for c in w}), 1)}

    @cached_property
    def of_code(self) -> np.ndarray:
        out = np.zeros(CODES, np.int64)
        out[[ord(c) for c in self.number]] = list(self.number.values())
        return out

    @cached_property
    def alphabetic(self) -> np.ndarray:
        """Whether a code point is a letter; -1 where nobody asked yet."""
        return np.full(CODES, -1, np.int8)

    @cached_property
    def tables(self) -> list[Transitions]:
        return [Transitions(SuffixAutomaton(words), self.number) for words in self.words]

    @cached_property
    def automata(self) -> list[SuffixAutomaton]:
        return [SuffixAutomaton(words) for words in self.words]

    def count(self, words: list[str]) -> np.ndarray:
        """For each word its phrases by language, then its length; all 0 without a letter."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros((len(self.names) + 1, len(words)), np.int32)
        ends = np.cumsum(size)
        at = 0
        while at < len(words):
            to = max(int(np.searchsorted(ends, ends[at] - size[at] + TOGETHER, side="right")), at + 1)
            part = size[at:to]
            most = max(LONG, int(np.partition(part, -FEW)[-FEW]) if len(part) >= FEW else 0)
            of = at + np.flatnonzero(part <= most)
            if len(of):
                out[:, of] = self._together([words[i] for i in of], size[of] + 2)
            for i in at + np.flatnonzero(part > most):
                if any(c.isalpha() for c in words[i]):
                    out[:, i] = [a.phrases(f" {words[i]} ") for a in self.automata] + [size[i]]
            at = to
        return out

    def _together(self, words: list[str], size: np.ndarray) -> np.ndarray:
        code = np.frombuffer(f" {'  '.join(words)} ".encode("utf-32-le"), np.uint32)
        start = np.cumsum(size) - size
        for c in np.unique(code[self.alphabetic[code] < 0]).tolist():
            self.alphabetic[c] = chr(c).isalpha()
        spoken = np.maximum.reduceat(self.alphabetic[code], start).astype(bool)
        order = np.argsort(-size, kind="stable")
        order = order[spoken[order]]
        start, longer, letter = start[order], -size[order], self.of_code[code]
        places = range(-int(longer[0]) if len(order) else 0)
        letters = [letter[start[: np.searchsorted(longer, -k)] + k] for k in places]
        out = np.zeros((len(self.names) + 1, len(words)), np.int64)
        for k, table in enumerate(self.tables):
            out[k, order] = table.phrases(letters, len(order))
        out[-1, order] = size[order] - 2
        return out


class Parser:
    """Phrase counts per language of whole texts, through remembered words."""

    def __init__(self, languages: Languages):
        self.languages = languages
        self._forget()

    def _forget(self) -> None:
        self.place: defaultdict[str, int] = defaultdict()
        self.place.default_factory = self.place.__len__
        self.counts = np.zeros((len(self.languages.names) + 1, 0), np.int32)

    def totals(self, texts: list[str]) -> np.ndarray:
        """Phrases by language, then letters, of each text."""
        if len(self.place) > REMEMBER:
            self._forget()
        known = len(self.place)
        at = []
        for text in texts:
            words = text.lower().split()
            at.append(np.fromiter(map(self.place.__getitem__, words), np.int64, len(words)))
        new = list(islice(self.place, known, None))
        self.counts = np.concatenate([self.counts, self.languages.count(new)], axis=1)
        ends = np.cumsum([0, *map(len, at)])
        every = np.concatenate(at) if at else np.zeros(0, np.int64)
        out = np.empty((len(self.counts), len(texts)), np.int64)
        for k, count in enumerate(self.counts):
            out[k] = np.diff(np.concatenate([[0], np.cumsum(count[every], dtype=np.int64)])[ends])
        return out

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        names = self.languages.names
        if not names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        *phrases, letters = self.totals([t or "" for t in texts])
        best = np.argmin(phrases, axis=0)
        score = np.ones(len(texts))
        if len(names) > 1:
            fewest, second = np.partition(phrases, 1, axis=0)[:2]
            score = 1 - fewest / np.maximum(second, 1)
        found = [names[b] if n else UNKNOWN for b, n in zip(best, letters, strict=True)]
        return found, np.where(letters > 0, score, 0.0)


def predict(docs: DataFrame, model: dict[str, list[str]], text: str = "text") -> DataFrame:
    """The documents, without the text, with `lang_pred` and `score`.

    `und` with score 0 for null texts, texts without a letter, and without any learned
    language. The score is 1 - fewest / second fewest phrases, 1 with a single language;
    ties go to the smaller name. Whole texts are parsed; repeated rows are judged each; an
    empty table gives an empty result. Columns of the result's names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Languages(model))
    kept = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in bounded(batch, at, SLICE):
                names, scores = parser.judge(part.column(at).to_pylist())
                rest = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if n != text]
                yield pa.RecordBatch.from_arrays(
                    [c for _, c in rest] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[n for n, _ in rest] + ["lang_pred", "score"],
                )

    schema = T.StructType([f for f in kept.schema if f.name != text]).add("lang_pred", "string").add("score", "double")
    return kept.mapInArrow(run, schema)
