"""Text helpers as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\s\u0085   -     　\x1C-\x1F"
#: All white space, for trimming.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
#: What ends a line.
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\u0085  ]"
#: Blocks whose characters lose accents and compatibility forms: Latin, Greek, Cyrillic, marks, small digits, ligatures, full width.
_BLOCKS = (range(0xA0, 0x250), range(0x300, 0x530), range(0x1E00, 0x2000), range(0x2070, 0x20A0), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F))


def _plain_forms() -> dict[str, str]:
    """Compatibility decomposition without combining characters, where it differs."""
    forms = {c: "".join(d for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d)) for c in map(chr, chain(*_BLOCKS))}
    return {c: form for c, form in forms.items() if form != c}


_FORMS = _plain_forms()
_LONG = {c: form for c, form in _FORMS.items() if len(form) > 1}
_ONE = sorted((c for c in _FORMS if c not in _LONG), key=lambda c: _FORMS[c] == "")  # those that vanish last
_ACCENTED, _PLAIN = "".join(_ONE), "".join(_FORMS[c] for c in _ONE)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.btrim(text, F.lit(WHITE))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words is a substring."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def first_contained(text: Column, words: tuple[str, ...]) -> Column:
    """The first of the words, in their order, that is a substring."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words])


def normal_token(text: Column) -> Column:
    """Upper case in plain characters, without ``.,:;-$()`` at the ends.

    Accents and compatibility forms of the blocks above are undone; other scripts stay as they are.
    """
    spelled = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(_LONG[c])), _LONG, text)
    whole = F.when(text.rlike(f"[{''.join(_LONG)}]"), spelled).otherwise(text)
    # Text of single bytes has nothing to undo, and most words are such.
    plain = F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(whole, _ACCENTED, _PLAIN))
    return F.upper(F.btrim(plain, F.lit(".,:;-$()")))


def tokens(text: Column) -> Column:
    """Distinct normal tokens of a text, without empty ones."""
    parts = F.split(strip(text), f"[{SPACE}]+")
    return F.array_distinct(F.filter(F.transform(parts, normal_token), lambda t: t != ""))


def round1(x: Column) -> Column:
    """``x`` in 0..100 to one decimal; ties go by the exact binary value, even only if that is a tie.

    ``x * 20`` is an odd whole number just for apparent ties. Its exact rest comes from
    splitting ``x`` into two halves of its digits, whose products by 20 are exact.
    """
    scaled = F.rint(x * 20)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    rest = (high * 20 - scaled) + (x - high) * 20
    tie = (x * 20 == scaled) & (F.pmod(scaled, F.lit(2.0)) == 1) & (rest != 0)
    return F.when(tie, (scaled + F.signum(rest)) / 20).otherwise(F.bround(x, 1))


def clp(x: Column) -> Column:
    """``$1.234.567``: no decimals, half to even."""
    return F.concat(F.lit("$"), F.replace(F.format_number(x, 0), F.lit(","), F.lit(".")))


def split_lines(text: Column) -> Column:
    """Lines of a text as an array: no trailing empty line, no lines for an empty text."""
    parts = F.split(text, LINE_BREAK, -1)
    trimmed = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(text != "", trimmed).otherwise(F.array().cast("array<string>"))
