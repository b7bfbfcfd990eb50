"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import kept_text

#: Code points before a span that are searched for context words.
CONTEXT = 40
#: Spans are placed in pieces of so many, so that the work stays in proportion to their number.
PIECE = 512
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _is_ip(hit: Column) -> Column:
    return hit.rlike(rf"\A{_BYTE}(?:\.{_BYTE}){{3}}\z")


def _is_card(hit: Column) -> Column:
    digits = _digits(hit)
    return F.char_length(digits).between(16, 19) & F.call_function("luhn_check", digits)


def _is_phone(hit: Column) -> Column:
    return F.char_length(_digits(hit)).between(8, 15)


def _is_iban(hit: Column) -> Column:
    """The rest of the number, its letters read as 10 to 35, modulo 97, must be 1."""
    plain = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.split(turned, "(?!\\A|\\z)"),
        F.lit(0),
        lambda acc, c: F.when(c.between("0", "9"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97,
    )
    return F.char_length(plain).between(15, 34) & (rest == 1)


def _is_ssn(hit: Column) -> Column:
    return ~hit.rlike(r"\A(?:000|666|9..)|-00-|-0000\z")


@dataclass(frozen=True)
class Kind:
    """``score`` is that of a confirmed span; a context word before it adds ``bonus``. Spans below ``least`` go."""

    name: str
    pattern: str
    confirmed: Callable[[Column], Column]
    context: str
    score: float
    bonus: float = 0.2
    least: float = 0.5
    #: What a text with such a span contains.
    needs: str | None = None


#: Possessive repeats match the same spans as greedy ones here, in time proportional to the text: what follows
#: a run is never part of it. A run is tried from its start or where the last match ended, not from its middle.
BASE_KINDS = [
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda hit: F.lit(True),
        "mail|contact|kontakt|contacto",
        0.8,
        needs="@",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _is_ip, r"\bip\b|address|server|host", 0.6, needs="."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _is_card, "card|visa|carte|karte|tarjeta", 0.8),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _is_phone, r"phone|tel\b|call|mobile|telefon", 0.6, needs="+"),
]
EXTRA_KINDS = [
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
        _is_iban,
        "iban|account|konto|compte|cuenta",
        0.8,
    ),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _is_ssn, r"ssn|social|security", 0.4, needs="-"),
]


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value bound to a name, so that it is computed once."""
    return F.transform(F.array(value), f)[0]


def _running(steps: Column, start: Column) -> Column:
    """Sums of ``start`` and the steps before each step."""
    state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("seen"))
    return F.aggregate(
        steps,
        state,
        lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["seen"], s["at"]).alias("seen")),
        lambda s: s["seen"],
    )


def _starts(steps: Column) -> Column:
    """As ``_running`` from 0, piece by piece."""

    def pieced(pieces: Column) -> Column:
        sums = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        return F.flatten(_once(sums, lambda s: F.zip_with(pieces, _running(s, F.lit(0)), _running)))

    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / PIECE).cast("int")),
        lambda i: F.slice(steps, i * PIECE + 1, PIECE),
    )
    return _once(pieces, pieced)


def _spans(kind: Kind, t: Column, hits: Column) -> Column:
    """Confirmed spans of a kind, of a text with hits. What lies between hits gives places and context."""

    def placed(between: Column) -> Column:
        steps = F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda b, h: F.char_length(b) + F.char_length(h))

        def with_ends(ends: Column) -> Column:
            return F.zip_with(
                F.arrays_zip(F.slice(between, 1, F.size(hits)).alias("before"), hits.alias("hit")),
                ends,
                lambda x, s: F.struct(
                    F.lit(kind.name).alias("kind"),
                    (s + F.char_length(x["before"])).alias("start"),
                    (s + F.char_length(x["before"]) + F.char_length(x["hit"])).alias("end"),
                    F.when(~kind.confirmed(x["hit"]), 0.0)
                    .when(F.lower(F.right(x["before"], F.lit(CONTEXT))).rlike(kind.context), kind.score + kind.bonus)
                    .otherwise(kind.score)
                    .alias("score"),
                ),
            )

        return _once(_once(steps, _starts), with_ends)

    found = F.filter(_once(F.split(t, kind.pattern, -1), placed), lambda s: s["score"] >= kind.least)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return F.when(F.size(hits) == 0, none).otherwise(found)


def personal_data(docs: DataFrame, kinds: list[Kind], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``spans``, an array of (kind, start, end, score).

    Places count code points from 0, the end is not part of the span. Spans are ordered by kind as listed, then
    by start; kinds may overlap. A null or empty text has no spans; ids may be null or repeated; other columns
    are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), kept_text(f"`{text}`").alias("__t"))
    t = F.col("__t")
    for kind in kinds:
        hits = F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0))
        if kind.needs:
            hits = F.when(t.contains(kind.needs), hits).otherwise(F.array().cast("array<string>"))
        rows = rows.withColumn(f"__hits_{kind.name}", hits)
    spans = [_spans(kind, t, F.col(f"__hits_{kind.name}")) for kind in kinds]
    return rows.select(F.col("__id").alias(id_col), F.concat(*spans).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
