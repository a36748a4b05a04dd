"""Text normalisation as Column expressions: no function here leaves the JVM.

``tokenize`` is a chain of rewrites.  Symbols that count as white space are first marked with \\x01,
because they neither end nor begin a number; a number is a digit followed by digits, dots, commas
and marks.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkwell.functions import tables as T
from linkwell.functions.stem import stems

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"
NUMBER_RUN = r"\d[\d.\x01]*"
SKIP = "\x01"


def lookup(table: dict[str, str], word: Column) -> Column:
    """The table's entry, or the word itself."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, word), word)


def fold_letters(s: Column) -> Column:
    return F.translate(s, "ёй", "еи")


def clean_characters(s: Column) -> Column:
    """Code points outside printable ASCII and U+0401 to U+0451 become spaces."""
    return F.regexp_replace(s, r"[^\x20-\x7EЁ-ё]", " ")


def strip_symbols(s: Column) -> Column:
    return F.translate(s, T.SPACE_SYMBOLS, " " * len(T.SPACE_SYMBOLS))


def split_numbers(s: Column) -> Column:
    """Put numbers apart from what stands beside them; expects lower case and skipped symbols as \\x01."""
    s = bound(s, lambda x: F.when(F.contains(x, F.lit(".")) | F.contains(x, F.lit(",")), _points(x)).otherwise(x))
    s = bound(s, lambda x: F.when(x.rlike(r"\d"), _apart(x)).otherwise(x))
    return F.replace(s, F.lit("%"), F.lit("% "))


def _points(s: Column) -> Column:
    """Only dots inside or before numbers stay; nothing changes where there is no dot or comma."""
    # dots and commas that no digit precedes are white space
    s = F.regexp_replace(s, r"((?:^|[^\d.,\x01])\x01*|(?!^)\G\x01*)[.,]", "$1 ")
    # a decimal comma becomes a dot
    s = F.regexp_replace(s, rf"({NUMBER_RUN}|(?!^)\G[\d.\x01]*),", "$1.")
    # the last dot of a number goes if something follows
    return F.regexp_replace(s, rf"({NUMBER_RUN})\.(?=[^\d.\x01])", "$1 ")


def _apart(s: Column) -> Column:
    """White space around numbers; nothing changes where there is no digit."""
    s = F.regexp_replace(s, rf"({NUMBER_RUN})(?=[^\d.\x01%])", " $1 ")
    return F.regexp_replace(s, rf"({NUMBER_RUN})", " $1")


def words(s: Column) -> Column:
    """Split on white space; no empty words."""
    return F.filter(F.split(s, r"\s+"), lambda w: w != "")


def expand_units(tokens: Column) -> Column:
    """After an integer token a unit is spelled out; then one-letter tokens go, but for the first token."""
    return bound(tokens, _expanded)


def _expanded(tokens: Column) -> Column:
    n = F.size(tokens)
    before, after = F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(n - 1, F.lit(0)))
    spelled = F.zip_with(before, after, lambda p, w: F.when(p.rlike(r"^\d+$"), lookup(T.UNITS_AFTER_NUMBER, w)).otherwise(w))
    return F.concat(F.slice(tokens, 1, 1), F.filter(spelled, lambda w: F.length(w) > 1))


def transliterate(s: Column) -> Column:
    """Latin letters a to z in Cyrillic."""
    return F.replace(F.translate(s, T.LATIN, T.CYRILLIC), F.lit("x"), F.lit(T.LATIN_X))


def tokenize(s: Column, to_cyrillic: bool = True) -> Column:
    """A name's tokens joined by one space; null stays null."""
    s = F.regexp_replace(s, r"[^\x20-\x7EЁ-ё]", SKIP)
    s = F.translate(F.lower(s), T.SPACE_SYMBOLS, SKIP * len(T.SPACE_SYMBOLS))
    s = F.replace(split_numbers(s), F.lit(SKIP), F.lit(" "))
    joined = F.array_join(expand_units(words(fold_letters(s))), " ")
    return transliterate(joined) if to_cyrillic else joined


def as_number(t: Column) -> Column:
    """The token's value as text with a decimal point, or null."""
    return F.when(t.rlike(NUMBER), t.try_cast("double").cast("string"))


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def normal_token(t: Column, to_cyrillic: bool = False, fold_short_i: bool = True) -> Column:
    """One token: numbers as decimals, dimensions joined by x, units spelled out, dots split."""
    folded = F.translate(t, "ё,й", "е.и") if fold_short_i else F.translate(t, "ё,", "е.")
    return bound(folded, lambda x: F.coalesce(as_number(x), bound(_letters(x, to_cyrillic), _word)))


def _letters(t: Column, to_cyrillic: bool) -> Column:
    t = F.rtrim(t, F.lit("ъ"))
    return bound(t, lambda x: F.when(x.rlike(r"^[\x00-\x7F]*$"), transliterate(x)).otherwise(x)) if to_cyrillic else t


def _word(t: Column) -> Column:
    dimension = bound(F.split(t, "[xх*]"), lambda sides: F.when((F.size(sides) > 1) & F.forall(sides, lambda p: p.rlike(NUMBER)), F.array_join(F.transform(sides, as_number), "x")))
    parts = F.filter(F.transform(F.split(t, r"\."), lambda p: lookup(T.UNITS_NORMAL, p)), lambda p: F.length(p) > 1)
    measure = F.when(t.rlike(r"^\d"), bound(F.regexp_extract_all(t, F.lit(r"([-+]?\d*\.\d+|\d+)"), 1), lambda found: _measure(t, found)))
    return F.coalesce(dimension, measure, F.array_join(parts, " "))


def _measure(t: Column, found: Column) -> Column:
    """The first number of a token and what follows it up to the next, spelled out."""
    first = F.get(found, 0)
    rest = F.ltrim(t, first)
    unit = F.when(F.size(found) > 1, F.call_function("substring_index", rest, F.get(found, 1), F.lit(1))).otherwise(rest)
    return F.concat_ws(" ", first.try_cast("double").cast("string"), lookup(T.UNITS_NORMAL, unit))


def normalize(s: Column, to_cyrillic: bool = True, fold_short_i: bool = True) -> Column:
    """Brackets and dashes as spaces, lower case, words without punctuation around them, then ``normal_token``."""
    s = F.lower(F.translate(s, T.BRACKET_SYMBOLS, " " * len(T.BRACKET_SYMBOLS)))
    bare = F.transform(words(s), lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", ""))
    bare = F.filter(bare, lambda w: w != "")
    return F.array_join(F.transform(bare, lambda w: normal_token(w, to_cyrillic, fold_short_i)), " ")


def mask_numbers(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike(NUMBER), F.lit("<NUMBER>")).otherwise(t))


def unique_words(s: Column) -> Column:
    """The text's words, each where it first stands."""
    return F.array_join(F.array_distinct(words(s)), " ")


def product_text(name: Column, synonyms: Column, brand: Column, use_synonyms: bool = False) -> Column:
    """Lower-case name, with its synonyms' new words on request, and the brand unless it is inside already."""
    text = F.lower(name)
    if use_synonyms:
        merged = unique_words(F.concat_ws(" ", text, F.lower(F.array_join(synonyms, " "))))
        text = F.when(F.size(F.coalesce(synonyms, F.array().cast("array<string>"))) > 0, merged).otherwise(text)
    brand = F.lower(F.coalesce(brand, F.lit("")))
    return F.when(F.contains(text, brand), text).otherwise(F.concat_ws(" ", text, brand))


def query_text(name: Column, brand: Column) -> Column:
    return tokenize(F.concat_ws(" ", name, F.coalesce(brand, F.lit(""))))


def unit_text(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"(?U)\W", " "), r"\s+", " "))


def organisation(comment: Column) -> Column:
    """What stands before the first bar, without braces at its front; raises if there is none."""
    head = F.split_part(comment, F.lit("|"), F.lit(1))
    checked = F.when(head.startswith("{"), head).otherwise(F.raise_error(F.concat(F.lit("no organisation in "), comment)).cast("string"))
    return F.when(comment.isNotNull(), F.ltrim(checked, F.lit("{")))


def barcode_numbers(codes: Column) -> Column:
    return F.transform(codes, lambda c: c.try_cast("bigint"))


@lru_cache(maxsize=1)
def stop_words() -> tuple[str, ...]:
    """Russian stop words and the catalogue's, with letters folded as tokens are, so that they can match."""
    from pyspark.ml.feature import StopWordsRemover

    found = [*StopWordsRemover.loadDefaultStopWords("russian"), *T.CATALOGUE_STOP_WORDS]
    return tuple(dict.fromkeys(w.replace("ё", "е").replace("й", "и") for w in found))


def without_stop_words(tokens: Column, stop: tuple[str, ...] | None = None) -> Column:
    listed = F.array(*[F.lit(w) for w in (stop if stop is not None else stop_words())])
    return F.filter(tokens, lambda t: ~F.array_contains(listed, t))


def of_length(tokens: Column, least: int = 2, most: int = 100) -> Column:
    return F.filter(tokens, lambda t: F.length(t).between(least, most))


def analyse(s: Column, stemmed: bool = True) -> Column:
    """The index analyser: split on white space, lower case, stop words, lengths, Russian stems."""
    tokens = of_length(without_stop_words(words(F.lower(s))))
    return stems(tokens) if stemmed else tokens


def url_quote(s: Column) -> Column:
    """Percent-encoded UTF-8 but for letters, digits and _.-~/."""
    for coded, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        s = F.replace(F.url_encode(s) if coded == "+" else s, F.lit(coded), F.lit(plain))
    return s


def chunks(values: Column, size: int, fill: Column | None = None) -> Column:
    """An array in pieces of ``size``, the last one shorter or, with ``fill``, filled up; no pieces of an empty array."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(size))
    pieces = F.filter(F.transform(starts, lambda i: F.slice(values, i, size)), lambda c: F.size(c) > 0)
    return pieces if fill is None else F.transform(pieces, lambda c: F.concat(c, F.array_repeat(fill, F.lit(size) - F.size(c))))
