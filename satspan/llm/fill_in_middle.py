"""Fill-in-the-middle forms: texts cut at the boundaries of a unit grammar.

A grammar says between which two neighbouring characters a unit ends: pairs of
character classes (left, right).  It is translated to one zero-width regular
expression of lookbehinds and lookaheads, so Spark's ``split`` cuts there and
keeps every character in some piece; the pieces joined give the text back.
``split`` makes one empty piece of an empty text, so empty texts are handled on
their own: no units.

Three numbers drawn from the sha256 of ``seed:doc_id`` choose two cuts and the
form: ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or
``plain`` (the text as it is).  A text that is empty or already holds a sentinel
stays plain, so that ``restored`` gives back the exact text from output and form.

Defined results: null text is an empty text; a null id draws from the seed
alone; rows with one id draw alike; ids may be of any type and are written in
decimal; extra columns are ignored; an empty table gives an empty result.  A
text is cut in one row's memory, at about 60 bytes a unit while it is cut.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A sentinel cannot overlap another or itself, so each is found where it was put.
_SENTINEL = "<[PSM]>"

ANY = "."
_BLANK, _SOLID = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"

#: A unit ends between a character of the first class and one of the second.
#: Classes are of ASCII characters or what is not among them, so the halves of a
#: character beyond the basic plane (two to Java) are never told apart.
GRAMMARS: dict[str, tuple[tuple[str, str], ...]] = {
    "characters": ((ANY, ANY),),
    "words": ((_BLANK, _SOLID),),
    "lines": ((r"\n", ANY),),
    "sentences": ((r"[.!?]", _BLANK),),
    "identifiers": (
        (r"[a-z]", r"[A-Z0-9]"), (r"[A-Z]", r"[0-9]"), (r"[0-9]", r"[A-Za-z]"),
        (r"[A-Za-z0-9]", r"[^A-Za-z0-9]"), (r"[^A-Za-z0-9]", ANY),
    ),
}


def boundary(grammar: str | tuple[tuple[str, str], ...]) -> str:
    """The zero-width expression that matches where a unit ends."""
    pairs = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    return "(?s)" + "|".join(f"(?<={left})(?={right})" for left, right in pairs)


def pieces(text: Column, grammar: str | tuple[tuple[str, str], ...]) -> Column:
    """The units of a text in order; joined, they are the text."""
    none = F.array().cast("array<string>")
    return F.when(text == "", none).otherwise(F.split(text, boundary(grammar)))


class Rates(NamedTuple):
    """Of 100 documents: from which draw on a text stays plain, below which it is spm."""

    plain_from: int = 90
    spm_below: int = 20


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(
    docs: DataFrame, grammar: str | tuple[tuple[str, str], ...] = "characters", seed: str = "1", rates: Rates = Rates()
) -> DataFrame:
    """Per row: doc_id, text, n (units), form, prefix, middle, suffix (null if
    plain) and output."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), digest.alias("digest"))

    def cut(units: Column) -> Column:
        n = F.size(units)
        one, two = (F.col(f"h{k}") % (n + 1) for k in (1, 2))
        low, high = F.least(one, two).cast("int"), F.greatest(one, two).cast("int")
        part = lambda start, count: F.array_join(F.slice(units, start + 1, count), "")
        return F.struct(
            n.cast("long").alias("n"),
            part(F.lit(0), low).alias("prefix"),
            part(low, high - low).alias("middle"),
            part(high, n - high).alias("suffix"),
        )

    # The one-element array binds the units to a name, so a text is split once.
    cuts = F.element_at(F.transform(F.array(pieces(F.col("text"), grammar)), cut), 1)
    plain = (F.col("text") == "") | F.col("text").rlike(_SENTINEL) | (F.col("h3") % 100 >= rates.plain_from)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < rates.spm_below, "spm").otherwise("psm")
    formed = (
        drawn.select("doc_id", "text", *[_draw(F.col("digest"), k).alias(f"h{k + 1}") for k in range(4)])
        .select("doc_id", "text", form.alias("form"), cuts.alias("cut"))
    )
    prefix, middle, suffix = (F.when(F.col("form") != "plain", F.col(f"cut.{x}")) for x in ("prefix", "middle", "suffix"))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "cut.prefix", F.lit(SUFFIX), "cut.suffix", F.lit(MIDDLE), "cut.middle"))
        .otherwise(F.concat(F.lit(SUFFIX), "cut.suffix", F.lit(PREFIX), "cut.prefix", F.lit(MIDDLE), "cut.middle"))
    )
    return formed.select(
        "doc_id", "text", F.col("cut.n").alias("n"), "form",
        prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` of this form was made from."""

    def joined(order: list[int]) -> Column:
        return F.element_at(F.transform(F.array(F.split(output, _SENTINEL)), lambda x: F.concat(*[F.element_at(x, i) for i in order])), 1)

    # The piece before the first sentinel is empty.
    return F.when(form == "plain", output).when(form == "psm", joined([2, 4, 3])).otherwise(joined([3, 4, 2]))
