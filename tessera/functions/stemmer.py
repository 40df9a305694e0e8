"""Suffix stripping for Portuguese as column expressions: the published algorithm with its regions R1, R2 and RV.

A word loses the longest standard suffix whose region condition holds; else the longest verb suffix inside RV; then a
residual vowel, a last e, or a cedilla. ``ã`` and ``õ`` are taken apart into a vowel and ``~``, which counts as a consonant.
Everything is built-in functions, so words are stemmed where they are tokenized.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouáéíóúâêô"
#: Fixed values of the algorithm. Standard suffixes deleted in R2; those replaced in R2; those with rules of their own.
DELETED = ("eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos "
           "adora ador aça~o adoras adores aço~es ante antes ância").split()
REPLACED = {"log": ["logia", "logias"], "u": ["uça~o", "uço~es"], "ente": ["ência", "ências"]}
ADVERB, MANNER, QUALITY, KIND, AGENT = ["amente"], ["mente"], ["idade", "idades"], ["iva", "ivo", "ivas", "ivos"], ["ira", "iras"]
#: Verb suffixes.
VERBS = ("ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam "
         "eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar "
         "er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses "
         "esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis "
         "ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos "
         "eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras").split()
RESIDUAL = "os a i o á í ó".split()
#: The last letters of words that a step can change; all others are their own stems.
ENDINGS = "".join(sorted({s[-1] for s in (*DELETED, *sum(REPLACED.values(), []), *ADVERB, *MANNER, *QUALITY, *KIND, *AGENT, *VERBS,
                                          *RESIDUAL)} | set("eéêç")))

#: R1 of a word, and R2 as R1 of R1; RV by the kinds of the first two letters.
AFTER_VOWEL = f"^.*?[{VOWELS}][^{VOWELS}](.*)$"
AFTER_START = f"^(?:.[^{VOWELS}].*?[{VOWELS}]|[{VOWELS}][{VOWELS}].*?[^{VOWELS}]|[^{VOWELS}][{VOWELS}].)(.*)$"


def _longest(word: Column, suffixes: list[str]) -> Column:
    """The longest of ``suffixes`` at the end of ``word`` (empty if none): looked up by length, longest first."""
    out = None
    for n in sorted({len(s) for s in suffixes}, reverse=True):
        tail = F.substring(word, -n, n)
        own = tail.isin([s for s in suffixes if len(s) == n])
        out = F.when(own, tail) if out is None else out.when(own, tail)
    return out.otherwise("")


def _without(word: Column, letters: Column) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - letters)


def _cut(word: Column, suffixes: list[str], floor: Column) -> Column:
    """``word`` without the longest of ``suffixes`` if that begins at ``floor`` or later."""
    n = F.length(_longest(word, suffixes))
    return F.when(F.length(word) - n >= floor, _without(word, n)).otherwise(word)


def _standard(c: Callable[[str], Column]) -> Column:
    """The word after the action of its standard suffix ``s``, where that may be taken off the rest ``b``."""
    s, b, p2 = c("s"), c("b"), c("p2")
    start = F.length(b)
    in_r2 = start >= p2
    out = F.when(s == "", c("w")).when(in_r2 & s.isin(DELETED), b)
    for letters, group in REPLACED.items():
        out = out.when(in_r2 & s.isin(group), F.concat(b, F.lit(letters)))
    active = F.when(start - 2 >= p2, _cut(_without(b, F.lit(2)), ["at"], p2)).otherwise(b)
    return (out.when(s.isin(ADVERB) & (start >= c("p1")),
                     F.when(b.endswith("iv"), active).otherwise(_cut(b, ["os", "ic", "ad"], p2)))
            .when(s.isin(MANNER) & in_r2, _cut(b, ["ante", "avel", "ível"], p2))
            .when(s.isin(QUALITY) & in_r2, _cut(b, ["abil", "ic", "iv"], p2))
            .when(s.isin(KIND) & in_r2, _cut(b, ["at"], p2))
            .when(s.isin(AGENT) & (start >= c("pv")) & b.endswith("e"), F.concat(b, F.lit("ir")))
            .otherwise(c("w")))


def _residual(c: Callable[[str], Column]) -> Column:
    """After an action an i behind c goes; without one, a last vowel (or os)."""
    two = c("two")
    single = F.when(two.endswith("ci") & (F.length(two) - 1 >= c("pv")), _without(two, F.lit(1))).otherwise(two)
    return F.when(two != c("w"), single).otherwise(_cut(two, RESIDUAL, c("pv")))


def _last_e(c: Callable[[str], Column]) -> Column:
    three = c("three")
    joined = three.rlike("(?:gu|ci)[eéê]$") & (F.length(three) - 2 >= c("pv"))
    cut = F.when(joined, _without(three, F.lit(2))).when(F.length(three) - 1 >= c("pv"), _without(three, F.lit(1)))
    return F.when(F.substring(three, -1, 1).isin("e", "é", "ê"), cut.otherwise(three)).when(
        three.endswith("ç"), F.concat(_without(three, F.lit(1)), F.lit("c"))).otherwise(three)


_EVERY = DELETED + [s for g in (*REPLACED.values(), ADVERB, MANNER, QUALITY, KIND, AGENT) for s in g]
def _regions(w: Column) -> Column:
    """Where R1, R2 and RV begin, and the standard suffix."""
    r1 = F.regexp_extract(w, AFTER_VOWEL, 1)
    return F.struct((F.length(w) - F.length(r1)).alias("p1"),
                    (F.length(w) - F.length(F.regexp_extract(r1, AFTER_VOWEL, 1))).alias("p2"),
                    (F.length(w) - F.length(F.regexp_extract(w, AFTER_START, 1))).alias("pv"),
                    _longest(w, _EVERY).alias("s"))


def _verb(c: Callable[[str], Column]) -> Column:
    """What a standard suffix has left, else the word without the verb suffix inside RV."""
    in_rv = F.substring(c("w"), c("pv") + 1, F.length(c("w")))
    return F.when(c("one") != c("w"), c("one")).otherwise(_without(c("w"), F.length(_longest(in_rv, VERBS))))


#: The steps in order: each is a column over the ones before it (``c`` gives them by name). Few, since the planner's time
#: doubles with every variable bound inside another.
_STEPS: list[tuple[str, Callable]] = [("one", _standard), ("two", _verb), ("three", _residual)]


def portuguese_stem(word: Column) -> Column:
    """The stem of a lower-case word with composed letters (accents stay); null stays null. What later steps name several
    times is bound once, as the variable of a one-element ``transform``. Words with another last letter than ``ENDINGS`` are
    not taken through the steps."""
    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), body)[0]

    def steps(have: dict[str, Column], left: list[tuple[str, Callable]]) -> Column:
        if not left:
            return F.replace(F.replace(_last_e(have.__getitem__), F.lit("a~"), F.lit("ã")), F.lit("o~"), F.lit("õ"))
        name, step = left[0]
        return let(step(have.__getitem__), lambda x: steps({**have, name: x}, left[1:]))

    def with_regions(w: Column, at: Column) -> Column:
        have = {"w": w, **{n: at[n] for n in ("p1", "p2", "pv", "s")}}
        return steps({**have, "b": _without(w, F.length(at["s"]))}, _STEPS)
    apart = F.replace(F.replace(word, F.lit("ã"), F.lit("a~")), F.lit("õ"), F.lit("o~"))
    stem = let(apart, lambda w: let(_regions(w), lambda at: with_regions(w, at)))
    return F.when(word.rlike(f"[{ENDINGS}]$"), stem).otherwise(word)


def composed(text: Column, letters: str = "áàâãäéèêëíìîïóòôõöúùûüçñ") -> Column:
    """Letters written as a base letter and a combining mark, put together (texts without combining marks stay)."""
    out = text
    for c in letters + letters.upper():
        out = F.replace(out, F.lit(unicodedata.normalize("NFD", c)), F.lit(c))
    return F.when(text.rlike(r"\p{Mn}"), out).otherwise(text)


STEMMERS = {"portuguese": portuguese_stem}
