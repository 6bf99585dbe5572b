"""Stems of Russian words by the published Snowball rules, for a text index's `stem`."""

from __future__ import annotations

import re

# The endings of the Snowball rules for Russian; those of a first group stand after а or я
_GERUND = ("в вши вшись", "ив ивши ившись ыв ывши ывшись")
_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
_PARTICIPLE = ("ем нн вш ющ щ", "ивш ывш ующ")
_REFLEXIVE = "ся сь"
_VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно", "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"
_SUPERLATIVE = "ейш ейше"
_DERIVED = "ост ость"


def _ending(plain: str, after_a: str = "") -> re.Pattern:
    """The longest of the endings at the end of a word's part."""
    kinds = [(e, "") for e in plain.split()] + [(e, "(?<=[ая])") for e in after_a.split()]
    return re.compile("(?:" + "|".join(before + e for e, before in sorted(kinds, key=lambda k: -len(k[0]))) + ")$")


_gerund, _adjective, _participle, _reflexive, _verb, _noun, _superlative, _derived = (
    _ending(*_GERUND[::-1]), _ending(_ADJECTIVE), _ending(*_PARTICIPLE[::-1]), _ending(_REFLEXIVE), _ending(*_VERB[::-1]), _ending(_NOUN), _ending(_SUPERLATIVE), _ending(_DERIVED),
)
_FIRST_VOWEL = re.compile("[аеиоуыэюя]")
_REGION = re.compile("[аеиоуыэюя][^аеиоуыэюя]")


def russian(word: str) -> str:
    """`word` (lower case) without its endings; ё counts as е.  Words without a Russian vowel stay as they are."""
    word = word.replace("ё", "е")
    vowel = _FIRST_VOWEL.search(word)
    if not vowel:
        return word
    head, rest = word[: vowel.end()], word[vowel.end() :]

    def without(pattern: re.Pattern, text: str) -> str | None:
        """Endings lie behind the first vowel; what must stand before one does too."""
        m = pattern.search(text)
        return text[: m.start()] if m else None

    cut = without(_gerund, rest)
    if cut is None:
        own = without(_reflexive, rest)
        rest = rest if own is None else own
        cut = without(_adjective, rest)
        if cut is not None:
            inner = without(_participle, cut)
            cut = cut if inner is None else inner
        else:
            cut = without(_verb, rest)
            cut = without(_noun, rest) if cut is None else cut
    rest = rest if cut is None else cut
    rest = rest.removesuffix("и")
    first = _REGION.search(word)
    second = _REGION.search(word, first.end()) if first else None
    if second:
        m = _derived.search(head + rest)
        if m and m.start() >= second.end():
            rest = (head + rest)[: m.start()][len(head) :]
    shorter = without(_superlative, rest)
    if shorter is not None:
        rest = shorter
    if rest.endswith("нн"):
        rest = rest[:-1]
    elif shorter is None:
        rest = rest.removesuffix("ь")
    return head + rest
