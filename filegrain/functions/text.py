"""Column functions over text. All of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv

# Unicode white space, spelled out so that every regex engine agrees on it.
WS_CLASS = (
    r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS = f"[{WS_CLASS}]"
WS_CHARS = "".join(
    map(chr, (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680,
              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once. A lambda over arrays would otherwise pull the
    expression inside and compute it again for every element."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def squeeze(text: Column) -> Column:
    """White-space runs to one blank, ends trimmed."""
    return strip(F.regexp_replace(text, f"{WS}+", " "))


def clip(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def sentences(
    text: Column,
    *,
    normalise: bool = False,
    openers: str = "A-Z\"'(",
    min_chars: int = fv.MIN_SENTENCE_CHARS,
    max_sentences: int | None = None,
) -> Column:
    """Split after ``.!?`` before an opener; trim; drop short pieces.

    ``normalise`` first collapses blank runs and long newline runs, as the
    comparison needs. ``max_sentences`` is off: whole texts are split.
    """
    if normalise:
        text = F.regexp_replace(text, r"\n{3,}", "\n\n")
        text = F.regexp_replace(text, r"\t[ \t]*| [ \t]+", " ")  # single blanks are what they are to be
    pieces = F.split(text, rf"(?<=[.!?]){WS}+(?=[{openers}])")
    kept = F.filter(F.transform(pieces, strip), lambda s: F.length(s) >= min_chars)
    return F.slice(kept, 1, max_sentences) if max_sentences else kept


def token_set(text: Column) -> Column:
    """Distinct words of three or more ASCII letters, not part of a longer word."""
    return F.array_distinct(
        F.regexp_extract_all(
            F.lower(text),
            F.lit(r"(?<![\p{L}\p{N}_])[a-z]{3,}(?![\p{L}\p{N}_])"),
            F.lit(0),
        )
    )


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return (
        F.when(both == 0, F.lit(1.0))
        .otherwise(F.size(F.array_intersect(a, b)) / both)
    )


_SEP = "\x1f"


def string_array(values: Iterable[str]) -> Column:
    """A constant array from one literal: small to analyse, folded once."""
    return F.split(F.lit(_SEP.join(values)), _SEP)


def int_array(values: Iterable[int]) -> Column:
    return string_array(str(v) for v in values).cast("array<int>")


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    """True when the lower-cased text contains one of the phrases."""
    needles = [p.lower() for p in phrases]
    return let(
        F.lower(text),
        lambda t: F.exists(string_array(needles), lambda p: F.contains(t, p)),
    )


def matched(text: Column, phrases: Iterable[str]) -> Column:
    """The phrases found in the text, in list order, compared without case."""
    phrases = list(phrases)
    shown = string_array(phrases)
    return F.transform(positions(text, [p.lower() for p in phrases]), lambda i: F.get(shown, i))


def positions(text: Column, needles: Sequence[str]) -> Column:
    """Ordinals of the needles (lower case) that the text contains, ascending."""
    constant = string_array(needles)
    every = int_array(range(len(needles)))
    return let(
        F.lower(text), lambda t: F.filter(every, lambda i: F.contains(t, F.get(constant, i)))
    )


def around(text: Column, position: Column, length: Column, before: int, after: int) -> Column:
    """Text from ``before`` characters ahead of a 1-based position to ``after``
    characters behind the match."""
    first = F.greatest(F.lit(1), position - before)
    return F.substring(text, first, position + length + after - first)


def starts_with_any(text: Column, prefixes: Iterable[str]) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | F.startswith(text, F.lit(prefix))
    return out


# --- markup ---------------------------------------------------------------

_NAMED = (
    ("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"),
    ("copy", "©"), ("reg", "®"), ("middot", "·"), ("ndash", "–"), ("mdash", "—"),
    ("lsquo", "‘"), ("rsquo", "’"), ("ldquo", "“"), ("rdquo", "”"),
    ("bull", "•"), ("hellip", "…"), ("sect", "§"), ("trade", "™"),
)
_MARK = "\x01"


def _decode_numeric(text: Column) -> Column:
    pattern = r"(?i)&#(x[0-9a-f]{1,6}|\d{1,7});"

    def code_point(reference: Column) -> Column:
        number = F.when(
            F.lower(F.substring(reference, 1, 1)) == "x", F.conv(F.substring(reference, 2, 7), 16, 10)
        ).otherwise(reference).cast("long")
        usable = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return F.when(
            usable,
            F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"),
        ).otherwise(F.lit("�"))

    decoded = F.array_join(
        F.zip_with(
            F.split(text, pattern),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(1)),
            lambda piece, ref: F.when(ref.isNull(), piece).otherwise(F.concat(piece, code_point(ref))),
        ),
        "",
    )
    return F.when(F.contains(text, F.lit("&#")), decoded).otherwise(text)


def unescape(text: Column) -> Column:
    out = text
    for name, char in _NAMED:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    out = F.replace(let(out, _decode_numeric), F.lit("&amp;"), F.lit("&"))
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def strip_markup(html: Column, separator: str = " ", drop: Iterable[str] = ("script", "style", "noscript")) -> Column:
    """Visible text: each text run trimmed, empty runs dropped, the rest joined
    by ``separator``."""
    for tag in drop:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}{WS}*>", _MARK)
    html = F.regexp_replace(html, r"(?s)<!--.*?-->|<[!?/]?[A-Za-z][^>]*>", _MARK)
    runs = F.transform(F.split(unescape(html), _MARK), strip)
    return F.array_join(F.filter(runs, lambda r: F.length(r) > 0), separator)


# --- match positions -----------------------------------------------------------


_BLOCK = 64


def running_sums(numbers: Column) -> Column:
    """The sum up to each element. Sums of blocks first, then inside a block: nothing is appended to."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)

    def summed(v: Column) -> Column:
        count = F.ceil(F.size(v) / _BLOCK).cast("int")
        blocks = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda b: total(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))
        before = let(blocks, lambda bs: F.transform(bs, lambda _, b: total(F.slice(bs, F.lit(1), b))))
        return let(before, lambda bs: F.transform(v, lambda _, i: F.get(bs, (i / _BLOCK).cast("int")) + total(
            F.slice(v, (i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK + 1)
        )))

    return let(numbers, summed)


def match_spans(text: Column, pattern: str | Column) -> Column:
    """All matches as ``array<struct<first:int, past:int>>``, 0-based, ``past``
    exclusive. No built-in returns offsets, but the pieces between the matches
    and the matches themselves add up to them."""

    regex = F.lit(pattern) if isinstance(pattern, str) else pattern

    def spans(t: Column) -> Column:
        gaps = F.transform(F.split(t, regex), F.length)
        placed = lambda hits: let(F.struct(gaps.alias("gaps"), hits.alias("hits")), positions_of)
        none = F.array().cast("array<struct<first:int,past:int>>")
        # a text without a match is not read again
        return let(F.transform(F.regexp_extract_all(t, regex, F.lit(0)), F.length), lambda hits: F.when(F.size(hits) == 0, none).otherwise(placed(hits)))

    def positions_of(v: Column) -> Column:
        sizes = F.zip_with(F.slice(v["gaps"], F.lit(1), F.size(v["hits"])), v["hits"], lambda gap, hit: gap + hit)
        return F.zip_with(
            running_sums(sizes), v["hits"], lambda past, hit: F.struct((past - hit).cast("int").alias("first"), past.cast("int").alias("past"))
        )

    return let(text, spans)


def pieces_between(text: Column, pattern: str, group: int) -> Column:
    """Matches with the text that follows each up to the next match:
    ``array<struct<key:string, body:string, last:boolean>>``."""

    def cut(t: Column) -> Column:
        keys = F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
        return let(
            F.struct(keys.alias("keys"), F.split(t, pattern).alias("pieces")),
            lambda v: F.transform(
                F.arrays_zip(v["keys"], F.slice(v["pieces"], F.lit(2), F.greatest(F.size(v["keys"]), F.lit(1)))),
                lambda x, i: F.struct(
                    x["keys"].alias("key"),
                    x["1"].alias("body"),
                    (i == F.size(v["keys"]) - 1).alias("last"),
                ),
            ),
        )

    return let(text, cut)


# --- numbers --------------------------------------------------------------------


def number(text: Column) -> Column:
    """Number with optional thousands commas, NULL when it is none."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def _formatted(value: Column, pattern: str) -> Column:
    # decides halves on the exact binary value, as C and Python formatting do
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def fixed(value: Column, digits: int) -> Column:
    return _formatted(value, "0." + "0" * digits if digits else "0")


def whole(value: Column) -> Column:
    return _formatted(value, "#,##0")


def signed_whole(value: Column) -> Column:
    return _formatted(value, "+#,##0;-#,##0")
