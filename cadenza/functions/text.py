"""Token and phrase expressions over text columns, all built in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _latin_table() -> tuple[str, str]:
    """Letters of the Latin blocks and the base letters that they decompose to."""
    source, target = [], []
    for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(i)) if unicodedata.category(c) != "Mn")
        if base != chr(i) and len(base) == 1:
            source.append(chr(i))
            target.append(base)
    return "".join(source), "".join(target)


_FROM, _TO = _latin_table()
_NOT_WORD = r"[^\p{L}\p{N}\s]"
_NOT_TOKEN = r"[^\p{L}\p{N}]"

# Words that carry no content.
STOPWORDS_ES = (
    "a al algo algun alguna algunas algunos ante asi aun bien cada como con cual cuando de del donde e el ella ellas ello ellos en era eran eres es esa "
    "esas ese eso esos esta estan estas este esto estos fue fueron ha han hay la las le les lo los mas me mi mis mucho muy nada ni no nos nosotros nuestra "
    "nuestro o os para pero poco por porque pues que quien se segun ser si sin sobre solo somos son soy su sus tal tambien tan te ti tu tus un una unas uno "
    "unos va vamos ya yo"
).split()
STOPWORDS_EN = (
    "a about after again all am an and any are as at be been being but by can did do does doing for from gonna got had has have having he her here hers him "
    "his how i if in into is it its just like me more my no nor not of on or our out over own s same she so some such t than that the their them then there "
    "these they this those to too up very was we were what when where which who why will with would you your yours"
).split()
# Stems and phrases by which speakers name their own edits.
SELF_EDIT_ES = {"stems": ["rebobin", "corta", "borra", "olvid", "repit", "repetir"], "phrases": ["eso no", "otra vez", "de nuevo", "mejor dicho", "no sirve"]}
SELF_EDIT_EN = {"stems": ["rewind", "again", "redo"], "phrases": ["cut that", "delete that", "scratch that", "forget that", "take two"]}
# Hesitations.
HESITATIONS = (r"\be+h+m?\b", r"\bm+h?m+\b", r"\ba+h+\b")

CONTENT_FLOOR = 2
RUN = 3
CARRYING = 4


def fold(x: Column) -> Column:
    """Latin letters without their marks; combining marks go."""
    return F.regexp_replace(F.translate(x, _FROM, _TO), r"\p{Mn}", "")


@F.pandas_udf(StringType())
def fold_full(x: pd.Series) -> pd.Series:
    """Every letter of any script without its marks, by canonical decomposition."""
    return x.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalise(x: Column) -> Column:
    """Lower case, punctuation to spaces, single spaces."""
    return squeeze(F.regexp_replace(F.lower(x), _NOT_WORD, " "))


def normalise_folded(x: Column) -> Column:
    return normalise(fold(x))


def token(x: Column) -> Column:
    """One word folded to its letters and digits."""
    return F.regexp_replace(F.lower(fold(x)), _NOT_TOKEN, "")


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(fold(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def words(x: Column) -> Column:
    """Words of a text, punctuation apart, unfolded."""
    return F.filter(F.split(normalise(x), " "), lambda w: w != "")


def words_folded(x: Column) -> Column:
    return F.filter(F.split(normalise_folded(x), " "), lambda w: w != "")


def is_english(lang: Column) -> Column:
    return F.coalesce(F.lower(fold(lang)).startswith("en"), F.lit(False))


def content_count(run: Column, lang: Column) -> Column:
    """Words of an array that are no stop words; English for languages that begin with `en`, else Spanish."""
    keep = lambda stop: F.size(F.filter(run, lambda w: ~fold(w).isin(stop)))
    return F.when(is_english(lang), keep(STOPWORDS_EN)).otherwise(keep(STOPWORDS_ES))


def ngrams(array: Column, n: int) -> Column:
    """All runs of n consecutive elements, joined by spaces."""
    last = F.size(array) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(array, i, n), " "))).otherwise(F.array().cast("array<string>"))


def count_run(array: Column, run: Column) -> Column:
    """How often a run of words stands in an array of words, without overlaps.

    Words are padded on both sides, so that a replacement is greedy, aligned to words and
    moves left to right."""
    padded = lambda x: F.array_join(F.transform(x, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), "")
    hay, needle = padded(array), padded(F.split(run, " "))
    return ((F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))) / F.length(needle)).cast("long")


def carrying(x: Column) -> Column:
    """The distinct words of four letters or more."""
    return F.array_distinct(F.filter(words(x), lambda w: F.length(w) >= CARRYING))


def contains_phrase(text: Column, phrase: Column, share: float = 0.6) -> Column:
    """Whether enough of a phrase's carrying words (all of its words if none carries) are in a text."""
    every, heard = words(phrase), words(text)
    long = F.filter(every, lambda w: F.length(w) >= CARRYING)
    wanted = F.when(F.size(long) > 0, long).otherwise(every)
    hits = F.size(F.filter(wanted, lambda w: F.array_contains(heard, w)))
    return F.coalesce(F.try_divide(hits, F.size(wanted)) >= share, F.lit(False))


def views_disagree(transcript: Column, heard: Column, all_silence: Column) -> Column:
    a, b = carrying(transcript), carrying(heard)
    only_a, only_b = F.size(F.array_except(a, b)), F.size(F.array_except(b, a))
    return (
        F.when(all_silence & (F.size(b) > 0), "soft-speech")
        .when((only_a > 0) & (only_b == 0), "transcript-claims-more")
        .when(only_b > 0, "heard-more")
        .otherwise("aligned")
    )


def leak_reading(window: Column, removed: Column) -> Column:
    """What stands in a window at a join, against the text that was removed there."""
    a, b = carrying(window), carrying(removed)
    share = F.try_divide(F.size(F.array_intersect(a, b)), F.size(a))
    return F.when(F.size(a) == 0, "check-by-ear").when(share >= 0.5, "removed-text-leaked").otherwise("lands")


def reason_mismatch(removed: Column, reason: Column) -> Column:
    """Whether a reason shares less than half of the carrying words of what it removes; at least four are needed."""
    a, b = carrying(fold(removed)), words(fold(reason))
    shared = F.size(F.filter(a, lambda w: F.array_contains(b, w)))
    return (F.size(a) >= 4) & (shared / F.greatest(F.lit(1), F.size(a)) < 0.5)


def hesitates(x: Column) -> Column:
    return F.lit(False) if not HESITATIONS else x.rlike("(?i)" + "|".join(HESITATIONS))


def reading_of_nonspeech(text: Column, level_db: Column, floor: float = -40.0) -> Column:
    """What a stretch that a classifier took for no speech is."""
    return F.when(hesitates(text), "hesitation").when(F.size(words(text)) > 0, "speech").when(level_db > floor, "noise").otherwise("silence")


def names_edit(x: Column, lang: Column) -> Column:
    """Whether a line names its own edit: a word that begins with a stem, or an exact phrase."""
    folded = F.transform(F.filter(F.split(x, r"\s+"), lambda w: w != ""), token)
    line = F.concat(F.lit(" "), F.array_join(folded, " "), F.lit(" "))

    def hit(lexicon: dict[str, list[str]]) -> Column:
        stems = F.exists(folded, lambda w: w.rlike("^(?:" + "|".join(lexicon["stems"]) + ")"))
        return stems | line.rlike(" (?:" + "|".join(lexicon["phrases"]) + ") ")

    return F.when(is_english(lang), hit(SELF_EDIT_EN)).otherwise(hit(SELF_EDIT_ES))


def cut_off(x: Column) -> Column:
    """Whether a text ends in a word without closing punctuation."""
    last = F.element_at(F.split(F.trim(x), r"\s+"), -1)
    return (F.trim(x) != "") & ~last.rlike("[.!?…,;:]$")
