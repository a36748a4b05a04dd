"""The published Snowball stemmer for Russian, for use in one Arrow function."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

VOWELS = "аеиоуыэюя"
# The endings of the published algorithm.
GERUND_1, GERUND_2 = "вшись|вши|в", "ывшись|ившись|ывши|ивши|ыв|ив"
ADJECTIVE = "ими|ыми|его|ого|ему|ому|ее|ие|ые|ое|ей|ий|ый|ой|ем|им|ым|ом|их|ых|ую|юю|ая|яя|ою|ею"
PARTICIPLE_1, PARTICIPLE_2 = "ем|нн|вш|ющ|щ", "ивш|ывш|ующ"
REFLEXIVE = "ся|сь"
VERB_1 = "ете|йте|ешь|нно|ла|на|ли|ем|ло|но|ет|ют|ны|ть|й|л|н"
VERB_2 = "ейте|уйте|ила|ыла|ена|ите|или|ыли|ило|ыло|ено|ует|уют|ены|ить|ыть|ишь|ей|уй|ил|ыл|им|ым|ен|ят|ит|ыт|ую|ю"
NOUN = "иями|ями|ами|ией|иям|ием|иях|ев|ов|ие|ье|еи|ии|ей|ой|ий|ям|ем|ам|ом|ях|ах|ию|ью|ия|ья|а|е|и|й|о|у|ы|ь|ю|я"
SUPERLATIVE, DERIVATIONAL = "ейше|ейш", "ость|ост"

_after_a = lambda endings: re.compile(rf"(?<=[ая])(?:{endings})$")
_any = lambda endings: re.compile(rf"(?:{endings})$")


def _regions(word: str) -> tuple[int, int]:
    """Starts of RV (after the first vowel) and of R2."""
    rv = next((i + 1 for i, c in enumerate(word) if c in VOWELS), len(word))

    def after(start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in VOWELS and word[i - 1] in VOWELS:
                return i + 1
        return len(word)

    return rv, after(after(0))


def _cut(word: str, rv: int, *patterns: re.Pattern) -> str | None:
    """The word without the longest ending that stands in RV, or None."""
    best = min((m.start() + rv for p in patterns if (m := p.search(word[rv:]))), default=None)
    return None if best is None else word[:best]


def stem(word: str) -> str:
    word = word.replace("ё", "е")
    rv, r2 = _regions(word)
    cut = _cut(word, rv, _after_a(GERUND_1), _any(GERUND_2))
    if cut is None:
        word = _cut(word, rv, _any(REFLEXIVE)) or word
        if (cut := _cut(word, rv, _any(ADJECTIVE))) is not None:
            shorter = _cut(cut, rv, _after_a(PARTICIPLE_1), _any(PARTICIPLE_2))
            cut = shorter if shorter is not None else cut
        else:
            cut = _cut(word, rv, _after_a(VERB_1), _any(VERB_2))
            if cut is None:
                cut = _cut(word, rv, _any(NOUN))
    word = word if cut is None else cut
    if word[rv:].endswith("и"):
        word = word[:-1]
    if m := _any(DERIVATIONAL).search(word[r2:]):
        word = word[: r2 + m.start()]
    if word[rv:].endswith("нн"):
        return word[:-1]
    if m := _any(SUPERLATIVE).search(word[rv:]):
        word = word[: rv + m.start()]
        return word[:-1] if word[rv:].endswith("нн") else word
    return word[:-1] if word[rv:].endswith("ь") else word


#: Stems that a worker process keeps.
CACHED = 200_000
_known: dict[str, str] = {}


def _known_stem(word: str) -> str:
    if (found := _known.get(word)) is None:
        if len(_known) >= CACHED:
            _known.clear()
        found = _known[word] = stem(word)
    return found


@F.arrow_udf(ArrayType(StringType()))
def _stems(tokens: pa.Array) -> pa.Array:
    flat = tokens.flatten().dictionary_encode()
    words = flat.dictionary
    # a word without a vowel of the alphabet has no region in which an ending could stand, so it is its own stem
    vowels = pc.match_substring_regex(words, f"[{VOWELS}ё]")
    stemmed = pa.array([_known_stem(w) for w in words.filter(vowels).to_pylist()], words.type)
    stemmed = pc.replace_with_mask(words, vowels, stemmed).take(flat.indices)
    lengths = pc.fill_null(tokens.value_lengths(), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, stemmed, mask=tokens.is_null() if tokens.null_count else None)


def stems(tokens: Column) -> Column:
    """Stems of an array of tokens."""
    return _stems(tokens)
