"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, validators (number ranges, Luhn, mod 97) confirm them, and
words near a span raise its score. Positions count code points; ends are exclusive.

The expressions are written so that a match attempt never goes over the same characters twice:
runs are possessive and start only where a run starts (or where the last match ended, ``\\G``).
Matches are the same as those of the plain expressions they stand for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import with_columns

#: characters before and after a span in which context words count
NEAR = 40
#: numbers that are added up in one run, and characters of a text in one block
_RUN, _BLOCK = 64, 1024


@dataclass(frozen=True)
class Kind:
    """``pattern``: proposes spans; ``needs``: a text without this has none; ``score`` without
    and ``bonus`` with one of the ``context`` words nearby."""

    name: str
    pattern: str
    needs: str
    score: float
    context: str
    bonus: float
    base: bool


# fixed values: the base patterns are [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+,
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), [0-9]([\x20-]?[0-9])+ and \+[0-9][\x20().0-9-]+[0-9]
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         0.9, r"e-?mail|contact|write|courriel|correo|kontakt", 0.1, True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"\bip\b|address|host|server|adresse|direcci", 0.3, True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.8, r"card|visa|master|credit|pay|karte|carte|tarjeta", 0.2, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, r"phone|call|tel|mobile|fax|anruf|appel|llam", 0.3, True),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", "",
         0.8, r"iban|account|bank|konto|compte|cuenta", 0.2, False),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "-", 0.3, r"ssn|social security", 0.6, False),
)
#: spans of the kinds that are not base count from this score on
LEAST = 0.5


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _mod97(x: Column) -> Column:
    """True if the account number's check digits hold: first four characters last, letters as
    10 to 35, the whole modulo 97 is 1."""
    plain = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(acc, c):
        letter = F.ascii(c) >= 65
        return F.when(letter, (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97)

    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.length(plain).between(15, 34) & (F.aggregate(chars, F.lit(0), step) == 1)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        small = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
        return F.forall(F.split(x, r"\."), lambda p: p.rlike(small))
    if kind == "card":
        return F.length(_digits(x)).between(12, 19) & F.call_function("luhn_check", F.substring(_digits(x), 1, 19))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    if kind == "iban":
        return _mod97(x)
    return F.lit(True)


def _upto(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What ``combine`` makes of the numbers up to and with each one. Arrays are only appended to
    within runs of ``_RUN`` values, so the work does not grow with the square of their number."""

    def running(x: Column, first: Column) -> Column:
        grown = F.aggregate(x, F.array(first), lambda acc, v: F.concat(acc, F.array(combine(F.element_at(acc, -1), v))))
        return F.slice(grown, F.lit(2), F.size(x))

    zero = F.lit(0)
    runs = F.transform(F.sequence(zero, ((F.size(values) - 1) / _RUN).cast("int")), lambda k: F.slice(values, k * _RUN + 1, F.lit(_RUN)))
    whole = F.transform(runs, lambda r: F.aggregate(r, zero, combine))
    before = F.concat(F.array(zero), F.slice(running(whole, zero), F.lit(1), F.size(whole) - 1))
    return F.flatten(F.zip_with(runs, before, running))


def _located(text: Column, nth: int, kind: Kind, hits: Column) -> Column:
    """Array of (start, kind, end, score) of the valid hits. Ends are running sums over the hits
    and the pieces between them, so the text is split once and never searched again."""
    gaps = F.split(text, kind.pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    around = F.zip_with(pairs, F.slice(gaps, F.lit(2), F.size(hits)), lambda p, g: F.struct(p["gap"].alias("gap"), p["hit"].alias("hit"), g.alias("after")))
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,score:double>>)")

    def span(x: Column, end: Column) -> Column:
        gap, hit, after = x["gap"], x["hit"], x["after"]
        near = F.lower(F.concat(F.right(gap, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR))))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), F.lit(kind.bonus)).otherwise(F.lit(0.0))
        made = F.struct((end - F.length(hit)).alias("start"), F.lit(nth).alias("kind"), end.alias("end"), score.alias("score"))
        return F.when(_valid(kind.name, hit) if kind.base else _valid(kind.name, hit) & (score >= LEAST), made)

    sizes = F.transform(around, lambda x: F.length(x["gap"]) + F.length(x["hit"]))
    found = F.filter(F.zip_with(around, _bound(sizes, lambda v: _upto(v, lambda p, q: p + q)), span), lambda s: s.isNotNull())
    return F.when(F.size(hits) > 0, found).otherwise(empty)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with pii: array of (start, kind, end, score) by start, then kind; ``kind`` is the
    place in ``KINDS``.

    Per kind, matches are leftmost and do not overlap; a match that fails its validator is
    dropped without a second try inside it. Spans of different kinds may overlap. Null and empty
    texts have none; repeated rows get equal spans; an empty table gives an empty one. A column
    of ``docs`` named pii is replaced. No shuffle and no Python: every row is worked on by
    itself, whatever the key distribution, in time that follows its length and number of hits.
    """
    words = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    none = F.expr("cast(array() as array<string>)")

    def hits(kind: Kind) -> Column:
        found = F.regexp_extract_all(words, F.lit(kind.pattern), F.lit(0))
        return F.when(F.contains(words, F.lit(kind.needs)), found).otherwise(none) if kind.needs else found

    proposed = with_columns(docs, F.struct(words.alias("t"), *[hits(k).alias(k.name) for k in KINDS]), {"_pii": lambda c: c})
    spans = [_located(F.col("_pii.t"), i, k, F.col(f"_pii.{k.name}")) for i, k in enumerate(KINDS)]
    return with_columns(proposed, F.array_sort(F.concat(*spans)), {"pii": lambda c: c}).drop("_pii")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(spans: Column) -> Column:
    """The spans of the base kinds."""
    return F.filter(spans, lambda s: s["kind"] < sum(k.base for k in KINDS))


def how_many(spans: Column, name: str) -> Column:
    """Number of spans of a kind."""
    nth = [k.name for k in KINDS].index(name)
    return F.size(F.filter(spans, lambda s: s["kind"] == nth)).cast("long")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the first
    gives the name and all their characters go. Pieces are taken from blocks of the text, so
    that none is searched from its start."""
    names = F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS])
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))

    def piece(b: Column, start: Column, end: Column) -> Column:
        first, last = (start / _BLOCK).cast("int"), (end / _BLOCK).cast("int")
        at = lambda k: F.coalesce(F.get(b, k), F.lit(""))
        inner = F.array_join(F.slice(b, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        several = F.concat(F.substring(at(first), start % _BLOCK + 1, F.lit(_BLOCK)), inner, F.left(at(last), end % _BLOCK))
        return F.when(first == last, F.substring(at(first), start % _BLOCK + 1, end - start)).otherwise(several)

    def joined(b: Column) -> Column:
        reach = _bound(F.transform(spans, lambda s: s["end"]), lambda v: _upto(v, lambda p, q: F.greatest(p, q)))

        def cut_out(r: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), F.slice(r, F.lit(1), F.size(r) - 1))
            parts = F.zip_with(spans, before, lambda s, at: F.when(s["start"] >= at, F.concat(piece(b, at, s["start"]), F.element_at(names, s["kind"] + 1))).otherwise(F.lit("")))
            return F.concat(F.array_join(parts, ""), piece(b, F.element_at(r, -1), F.length(text)))

        return _bound(reach, cut_out)

    return F.when(F.size(spans) > 0, _bound(blocks, joined)).otherwise(text)
