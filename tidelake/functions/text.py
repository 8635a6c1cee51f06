"""Text and number expressions of the cleaning rules."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the pattern that an e-mail address has to match.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"

#: Normalisations by name. trim removes U+0020 only; title lowers all but the first letter between spaces.
NORMALISE: dict[str, Callable[[Column], Column]] = {
    "trim": F.trim,
    "upper": lambda c: F.upper(F.trim(c)),
    "lower": lambda c: F.lower(F.trim(c)),
    "title": lambda c: F.initcap(F.trim(c)),
}


#: Hangul syllables decompose by arithmetic: first, vowels, finals, and the letters that they count from.
SYLLABLES, VOWELS, FINALS, LEADS_FROM, VOWELS_FROM, FINALS_FROM = range(0xAC00, 0xD7A4), 21, 28, 0x1100, 0x1161, 0x11A7


@cache
def _without_accents() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition, without combining marks, is one other character, and these; then the marks.
    Beside them those that become several characters or none. By Unicode's own tables, without Hangul syllables."""
    from_, to, gone, several = [], [], [], {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]):
        plain = c if unicodedata.is_normalized("NFKD", c) else unicodedata.normalize("NFKD", c)
        plain = "".join(x for x in plain if not unicodedata.combining(x))
        if plain == c or ord(c) in SYLLABLES:
            continue
        if len(plain) == 1:
            from_.append(c)
            to.append(plain)
        elif plain:
            several[c] = plain
        else:
            gone.append(c)
    return "".join(from_ + gone), "".join(to), several


def _syllable(c: Column) -> Column:
    """The letters of a Hangul syllable."""
    i = F.ascii(c) - SYLLABLES.start  # the code point
    letter = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
    final = i % FINALS
    return F.concat(letter(F.floor(i / (VOWELS * FINALS)) + LEADS_FROM), letter(F.floor(i % (VOWELS * FINALS) / FINALS) + VOWELS_FROM),
                    F.when(final > 0, letter(final + FINALS_FROM)).otherwise(""))


def without_accents(text: Column) -> Column:
    """The compatibility decomposition (NFKD) without combining marks.

    What becomes one character is translated; only texts with characters that become several go through these one by one.
    Such texts are told by what a translation deletes, which looks each character up in a hash map: a pattern's class of so many
    characters tries them in turn.
    """
    from_, to, several = _without_accents()
    places, parts = "".join(several), F.split(F.lit("\n".join(several.values())), "\n")
    one = lambda c: (F.when(F.ascii(c) < 0x80, c).when((c >= chr(SYLLABLES.start)) & (c <= chr(SYLLABLES.stop - 1)), _syllable(c))
                     .otherwise(F.coalesce(F.get(parts, F.instr(F.lit(places), c) - 1), c)))
    each = F.array_join(F.transform(F.split(text, ""), one), "")
    grows = F.octet_length(F.translate(text, places, "")) < F.octet_length(text)
    grows = grows | text.rlike(f"[\\x{{{SYLLABLES.start:x}}}-\\x{{{SYLLABLES.stop - 1:x}}}]")
    return F.translate(F.when(grows, each).otherwise(text), from_, to)


def slug(text: Column) -> Column:
    """Lower case without accents, spaces and apostrophes."""
    return F.regexp_replace(F.lower(without_accents(text)), "[ ']", "")


def cents(amount: Column) -> Column:
    """A decimal rounded half-even to two places."""
    return F.bround(amount, 2)
