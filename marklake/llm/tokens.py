"""Token counts by prefix dynamic programming over a BPE vocabulary of pieces.

No piece of the model joins a character to a space that follows it, so a text is encoded unit by unit, a unit being a
run of spaces and the word after it. Within a unit the dynamic programme goes over all prefixes: the tokens of a
prefix end in the one piece whose remainder, a shorter prefix, ends in a piece that it can stand next to. Two pieces can
stand next to each other if merging their characters gives just them. That yields the count at every prefix at once;
sums over units carry it through the text. What is stored is the change of the count with every character, and the
count at the end of every unit to get about quickly. Truncation and budget questions, to the character, are looked up there.

A model that normalises texts, or puts no space in front of them, would be counted wrongly; it is refused.

Fixed results: a null text counts as empty and has no tokens; repeated rows are counted each; extra columns are
carried, one named like the result is replaced; an empty table gives an empty one. A text of any length is one pass
with a bounded cache of units; one without spaces is a single unit.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHED_UNITS = 800_000
CACHED_PAIRS = 1_000_000
LONG_UNIT = 64
#: Pieces are looked up by so many last characters; shorter ones are tried at every prefix.
_ENDING = 3
_SHORT = tuple(range(_ENDING - 1, 0, -1))
_NONE = 1 << 40
_UNITS = re.compile(" +[^ ]*")
#: Texts that common normalisations change: full width, ligatures, composed letters, runs and ends of white space.
PROBES = ("ab", " a  b ", "\uff21\ufb01\u2460", "e\u0301\u212b", "a\tb\n\u3000c\u00a0", "\u00ad\u200b", "")


class PieceCounter:
    """Counts at every prefix for a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for probe in PROBES:
            if model.normalize(probe) != (SPACE + probe.replace(" ", SPACE) if probe else ""):
                raise ValueError("this model changes texts before it encodes them")
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        #: Rank of each piece: merges of better score, then of the one further left, go first.
        self.rank = {model.id_to_piece(i): (-model.get_score(i), i) for i in plain}
        order = {r: n for n, r in enumerate(sorted(set(self.rank.values())))}
        self.rank = {p: order[r] for p, r in self.rank.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece of this model spans words")
        self.longest = max(map(len, self.rank), default=1)
        #: Pieces that merging arrives at from their own characters.
        self.reached = {p for p in self.rank if len(p) == 1 or self.merged(p) == [p]}
        #: Lengths of the pieces that can end a prefix, by the last characters of the prefix; longest first.
        held: dict[str, set[int]] = defaultdict(lambda: set(_SHORT))
        for p in self.reached:
            if len(p) >= _ENDING:
                held[p[-_ENDING:]].add(len(p))
        self._lengths = {ending: tuple(sorted(sizes, reverse=True)) for ending, sizes in held.items()}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._profiles: dict[str, int] = {}
        self._steps: dict[str, list[int]] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short string: the best adjacent pair is merged until none is left."""
        parts, rank = list(text), self.rank.get
        pairs = [rank(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := min(pairs)) != _NONE:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            # Only the pairs on both sides of the new piece are others than before.
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], _NONE)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], _NONE)
        return parts

    def _fit(self, left: str, right: str) -> bool:
        found = self._pairs.get((left, right))
        if found is None:
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            found = self._pairs[left, right] = self.merged(left + right) == [left, right]
        return found

    def profile(self, unit: str) -> list[int]:
        """Tokens of the first 0, 1, 2... characters of a unit."""
        counts, last = [0], [""]
        reached, lengths, pairs, fit = self.reached, self._lengths, self._pairs, self._fit
        for end in range(1, len(unit) + 1):
            # Longest first, and only lengths at which some piece ends as this prefix does.
            for size in lengths.get(unit[end - _ENDING : end] if end >= _ENDING else "", _SHORT):
                start = end - size
                if start < 0 or (piece := unit[start:end]) not in reached:
                    continue
                left = last[start]
                if left:
                    fits = pairs.get((left, piece))
                    if not (fit(left, piece) if fits is None else fits):
                        continue
                counts.append(counts[start] + 1)
                last.append(piece)
                break
            else:  # a character outside the vocabulary: one token for each of its bytes, next to anything
                counts.append(counts[end - 1] + len(unit[end - 1].encode()))
                last.append("")
        return counts

    def count(self, unit: str) -> int:
        found = self._profiles.get(unit)
        if found is None:
            found = self.profile(unit)[-1]
            if len(unit) <= LONG_UNIT:
                if len(self._profiles) >= CACHED_UNITS:
                    self._profiles.clear()
                self._profiles[unit] = found
        return found

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if text[0] == " " or "  " in text or text[-1] == " ":
            return [u.replace(" ", SPACE) for u in _UNITS.findall(" " + text)]
        return [SPACE + w for w in text.split(" ")]

    def total(self, text: str) -> int:
        count, found = self.count, self._profiles.get
        return sum([n if (n := found(u)) is not None else count(u) for u in self.units(text)])

    def steps(self, unit: str) -> list[int]:
        """How the count changes with each character of a unit."""
        found = self._steps.get(unit)
        if found is None:
            counts = self.profile(unit)
            found = [b - a for a, b in zip(counts, counts[1:], strict=False)]
            if len(unit) <= LONG_UNIT:
                if len(self._steps) >= CACHED_UNITS:
                    self._steps.clear()
                self._steps[unit] = found
        return found

    def prefixes(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Characters up to each unit's end, the tokens of that prefix, and the change of the count with each character."""
        ends, tokens, steps = [], [], []
        for unit in self.units(text):
            more = self.steps(unit)
            if not ends:  # the first unit's space isn't in the text, but counts as soon as there is any
                more = [more[0] + more[1], *more[2:]]
            steps += more
            ends.append(len(steps))
            tokens.append(sum(more) + (tokens[-1] if tokens else 0))
        return ends, tokens, steps


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def with_token_counts(docs: DataFrame, model_path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """Adds the exact token count of each whole text. ``model_path`` is a file that every executor has, such as a
    package's data file; a column named ``into`` is replaced."""

    @F.pandas_udf("long")
    def total(texts):
        held = counter(model_path)
        return texts.map(lambda t: held.total(t) if t else 0)

    return docs.withColumn(into, total(F.coalesce(F.col(text), F.lit(""))))


def with_prefix_counts(docs: DataFrame, model_path: str, text: str = "text", into: str = "prefixes") -> DataFrame:
    """Adds ``into``: struct of ``ends`` (characters) and ``tokens``, one entry for each unit of the text, and ``steps``,
    the change of the count with each character."""
    kind = "struct<ends:array<bigint>,tokens:array<bigint>,steps:array<tinyint>>"
    names = ["ends", "tokens", "steps"]

    @F.pandas_udf(kind)
    def stored(texts):
        import pandas as pd

        held = counter(model_path)
        return pd.DataFrame([dict(zip(names, held.prefixes(t or ""), strict=True)) for t in texts], columns=names)

    return docs.withColumn(into, stored(F.coalesce(F.col(text), F.lit(""))))


def total_of(prefixes: Column) -> Column:
    """Tokens of the whole text."""
    return F.coalesce(F.try_element_at(prefixes["tokens"], F.lit(-1)), F.lit(0))


def _up_to(prefixes: Column, units: Column) -> tuple[Column, Column]:
    """Characters and tokens of so many whole units."""
    return F.coalesce(F.get(prefixes["ends"], units - 1), F.lit(0)), F.coalesce(F.get(prefixes["tokens"], units - 1), F.lit(0))


def within_budget(prefixes: Column, budget: int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens.

    Counts at the ends of units never fall, so that prefix ends within the first unit that doesn't fit as a whole.
    """
    whole = F.size(F.filter(prefixes["tokens"], lambda t: t <= budget))
    at, tokens = _up_to(prefixes, whole)
    stop = F.coalesce(F.get(prefixes["ends"], whole), at)
    inner = F.slice(prefixes["steps"], (at + 1).cast("int"), (stop - at).cast("int"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), tokens.cast("bigint").alias("tokens"), F.lit(0).cast("bigint").alias("best"))

    def step(held: Column, change: Column) -> Column:
        n, now = held["n"] + 1, held["tokens"] + change
        return F.struct(n.alias("n"), now.alias("tokens"), F.when(now <= budget, n).otherwise(held["best"]).alias("best"))

    return at + F.aggregate(inner, start, step)["best"]


def tokens_at(prefixes: Column, characters: Column) -> Column:
    """Tokens of the prefix of so many characters (of the whole text, if it has fewer)."""
    whole = F.size(F.filter(prefixes["ends"], lambda e: e <= characters))
    at, tokens = _up_to(prefixes, whole)
    inner = F.slice(prefixes["steps"], (at + 1).cast("int"), F.greatest(characters - at, F.lit(0)).cast("int"))
    return tokens + F.aggregate(inner, F.lit(0).cast("bigint"), lambda held, change: held + change)
