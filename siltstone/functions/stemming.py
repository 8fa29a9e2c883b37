"""Russian stems and stop words as Column expressions, by the Snowball description of the algorithm.

A word's endings are taken off its RV region (what follows its first vowel), the longest of a
list first; a preceding а or я that an ending asks for must lie in the region too.  Words
without Cyrillic letters are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lists of the algorithm.  Those of the first kind follow an а or я.
VOWEL = "аеиоуыэюя"
GERUND = ("в вши вшись", "ив ивши ившись ыв ывши ывшись")
ADJECTIVE = ("", "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею")
PARTICIPLE = ("ем нн вш ющ щ", "ивш ывш ующ")
REFLEXIVE = ("", "ся сь")
VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно", "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
NOUN = ("", "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я")
STOP_WORDS = tuple(
    """и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда
    даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя
    их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы
    нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много разве три
    эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между""".split()
)


def ending(lists: tuple[str, str]) -> str:
    """A pattern for the longest ending of the lists; a group keeps the letter before one of the first kind."""
    after, free = (" ".join(x for x in sorted(part.split(), key=len, reverse=True)).replace(" ", "|") for part in lists)
    parts = ([f"(?<=[ая])(?:{after})"] if after else []) + [f"(?:{free})"]
    return f"(?:{'|'.join(parts)})$"


def _off(c: Column, lists: tuple[str, str]) -> Column:
    return F.regexp_replace(c, ending(lists), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _first_step(region: Column) -> Column:
    """The region without a gerund's ending, or else without a reflexive and then an adjective's, verb's or noun's."""

    def without_reflexive(bare: Column) -> Column:
        verb = lambda v: F.when(v != bare, v).otherwise(_off(bare, NOUN))
        adjective = lambda a: F.when(a != bare, _off(a, PARTICIPLE)).otherwise(_let(_off(bare, VERB), verb))
        return _let(_off(bare, ADJECTIVE), adjective)

    return _let(_off(region, GERUND), lambda g: F.when(g != region, g).otherwise(_let(_off(region, REFLEXIVE), without_reflexive)))


def russian_stem(word: Column) -> Column:
    """The stem of a lower-case word; null stays null."""

    def derivational(plain: Column, start: Column, rest: Column) -> Column:
        """Without an ending ость that lies in R2, which begins after two vowels that a consonant follows."""
        second = F.length(F.regexp_extract(plain, f"^(?:.*?[{VOWEL}][^{VOWEL}]){{2}}", 0))
        ending_ = F.length(F.regexp_extract(rest, "ость?$", 0))
        inside = (ending_ > 0) & (second > 0) & (F.length(start) + F.length(rest) - ending_ >= second)
        return F.when(inside, F.regexp_replace(rest, "ость?$", "")).otherwise(rest)

    def last_step(rest: Column) -> Column:
        """Without a superlative's ending, a second н or a soft sign."""
        tidy = lambda bare: F.when((bare != rest) | rest.endswith("нн"), F.regexp_replace(bare, "нн$", "н")).otherwise(F.regexp_replace(rest, "ь$", ""))
        return _let(F.regexp_replace(rest, "ейше?$", ""), tidy)

    def whole(plain: Column) -> Column:
        def stem(start: Column) -> Column:
            steps = lambda region: _let(F.regexp_replace(_first_step(region), "и$", ""), lambda rest: _let(derivational(plain, start, rest), last_step))
            return F.concat(start, _let(F.substr(plain, F.length(start) + 1), steps))

        return _let(F.regexp_extract(plain, f"^[^{VOWEL}]*(?:[{VOWEL}]|$)", 0), stem)

    return F.when(word.rlike("[а-яё]"), _let(F.replace(word, F.lit("ё"), F.lit("е")), whole)).otherwise(word)


def russian_words(text: Column) -> Column:
    """The words of a text in order, without stop words."""
    words = F.regexp_extract_all(F.replace(F.lower(text), F.lit("ё"), F.lit("е")), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*(s.replace("ё", "е") for s in STOP_WORDS)))


def russian_terms(text: Column) -> Column:
    """The stems of a text's words in order, without stop words; the same for documents and queries."""
    return F.transform(russian_words(text), russian_stem)
