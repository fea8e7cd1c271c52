"""String functions on whole texts: native expressions, and a vectorised search for long runs.

No pattern here puts a quantifier on a group: on a long text Java's matcher would
recurse once per repetition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import corpora

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = " \t\n\r"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row.

    Spark would otherwise copy each expression into every later one that reads it;
    it doesn't look through ``inline``.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE))


def any_of(text: Column, needles: list[str]) -> Column:
    """Whether a text contains one of the needles."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def matched(text: Column, needles: list[str]) -> Column:
    """The needles that a text contains, in list order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(n)), F.lit(n)) for n in needles]))


def snippet(text: Column, needle: Column) -> Column:
    """80 characters from 20 before the needle (found without regard to ASCII case), trimmed; from the start if it isn't there."""
    at = F.position(needle, ascii_lower(text))
    return trimmed(F.substr(text, F.greatest(at - 20, F.lit(1)), F.lit(80)))


def truncated(c: Column, n: int, mark: str = "") -> Column:
    """At most n characters, with a mark where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substr(c, F.lit(1), F.lit(n)), F.lit(mark))).otherwise(c)


def hidden_char(text: Column) -> Column:
    """The first invisible character, or null."""
    return F.nullif(F.regexp_extract(text, f"({corpora.HIDDEN})", 1), F.lit(""))


def code_point(char: Column) -> Column:
    return F.lpad(F.hex(F.ascii(char)), 4, "0")


_IN_RUN = np.zeros(256, bool)
_IN_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-")] = True
_DIGIT = re.compile(rb"[0-9]")
LEAST_RUN, CUT_RUN = 40, 48
#: Bytes of text that are searched at once, about.
SEARCHED = 1 << 22


def _runs(b: np.ndarray, o: np.ndarray) -> Iterator[str | None]:
    """Of each text in a buffer (with offsets), the run that ``encoded_run`` returns."""
    inside = _IN_RUN[b]
    # A text's first byte may begin a run, whatever the text before ends with, and its last byte ends one.
    begins, over = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    over[:-1] &= ~inside[1:]
    cuts = o[(o > 0) & (o < len(b))]
    begins[cuts] = inside[cuts]
    over[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(over) + 1
    long_ = ends - starts >= LEAST_RUN
    found: dict[int, str] = {}
    for start, end, d in zip(starts[long_].tolist(), ends[long_].tolist(), (np.searchsorted(o, starts[long_], side="right") - 1).tolist()):
        run = b[start:end].tobytes()
        digit = None if d in found else _DIGIT.search(run)
        if digit:
            found[d] = run[: min(CUT_RUN, max(LEAST_RUN, digit.start() + 1))].decode()
    return (found.get(d) for d in range(len(o) - 1))


def buffers(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """UTF-8 bytes and offsets of texts (null: empty), in parts of about ``SEARCHED`` bytes or one longer text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = min(len(texts), max(at + 1, int(np.searchsorted(o, o[at] + SEARCHED, side="right")) - 1))
        yield b[o[at] : o[end]], o[at : end + 1] - o[at]
        at = end


@F.arrow_udf(StringType())
def encoded_run(texts: pa.Array) -> pa.Array:
    """The first run of at least 40 base64 or hex characters that has a digit, cut where it is recognised and at 48."""
    return pa.array([run for b, o in buffers(texts) for run in _runs(b, o)], pa.string())


def holding(b: np.ndarray, o: np.ndarray, chars: dict[int, int]) -> np.ndarray:
    """Of each text in a buffer, the bits of the characters (by code point) that it holds, or-ed."""
    leads = np.zeros(256, bool)
    leads[[chr(c).encode()[0] for c in chars]] = True
    at = np.flatnonzero(leads[b])
    masks = np.zeros(len(o) - 1, np.int64)
    if len(at):
        padded = np.concatenate((b, np.zeros(3, np.uint8))).astype(np.int32)
        one, two, three, four = (padded[at + i] for i in range(4))
        tail = (two & 63) << 6 | three & 63
        code = np.where(one < 0x80, one, np.where(one < 0xE0, (one & 31) << 6 | two & 63, np.where(one < 0xF0, (one & 15) << 12 | tail, (one & 7) << 18 | tail << 6 | four & 63)))
        for bit in set(chars.values()):
            hit = at[np.isin(code, [c for c, x in chars.items() if x == bit])]
            masks[np.searchsorted(o, hit, side="right") - 1] |= bit
    return masks


def has_image_mark(text: Column) -> Column:
    return F.contains(text, F.lit("![")) & F.contains(text, F.lit("]("))


def has_image_url(text: Column) -> Column:
    """Whether ``image_url`` finds one."""
    return F.coalesce(has_image_mark(text) & image_url(text).isNotNull(), F.lit(False))


def image_url(text: Column) -> Column:
    """The target of the first markdown image that is an http(s) URL, at most 120 characters.

    An image's target begins at the first ``](`` after its ``![``, and ends at the next
    ``)``, so the text is cut at ``](`` once and each cut is looked at with the piece
    before it.
    """
    parts = F.split(text, r"\]\(")
    beside = F.arrays_zip(F.slice(parts, F.lit(1), F.size(parts) - 1).alias("before"), F.slice(parts, F.lit(2), F.size(parts) - 1).alias("after"))
    opens = F.transform(beside, lambda x, i: F.when(F.contains(x["before"], F.lit("![")) & F.ltrim(x["after"], F.lit(SPACE)).rlike("^https?://"), i))
    first = F.get(F.array_compact(opens), F.lit(0))
    rest = F.array_join(F.slice(parts, first + 2, F.size(parts)), "](")
    url = F.when(F.contains(rest, F.lit(")")), F.substr(trimmed(F.substring_index(rest, ")", 1)), F.lit(1), F.lit(120)))
    return F.when(has_image_mark(text), F.when(first.isNotNull(), url))


def fold_fullwidth(c: Column) -> Column:
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    return F.translate(c, wide, "".join(chr(ord(x) - 0xFEE0) for x in wide))


def frontmatter(text: Column) -> Column:
    """Between --- at the start and the next line that begins with ---, else empty."""
    body = F.regexp_replace(text, r"^\s+", "")
    opened = F.startswith(body, F.lit("---"))
    rest = F.substr(body, F.lit(4))
    end = F.locate("\n---", rest)
    return F.when(opened & (end > 0), F.substr(rest, F.lit(1), end - 1)).otherwise(F.lit(""))
