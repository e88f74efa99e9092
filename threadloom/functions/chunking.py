"""Long texts to chunks. Packing depends on what was packed before, so it is a small function per text behind Arrow."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import named
from threadloom.schemas import MAX_CHUNK

#: What `str.strip` takes away, for the JVM.
_BLANK = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_BLANK_ENDS = rf"^{_BLANK}+|(?<!{_BLANK}){_BLANK}++\z"
_HEADING = re.compile(r"^#{1,6}[ \t]", re.M)


def _packed(section: str, most: int) -> list[str]:
    chunks, held = [], None
    for paragraph in section.split("\n\n"):
        joined = paragraph if held is None else held + "\n\n" + paragraph
        if len(joined) <= most:
            held = joined
            continue
        if held:
            chunks.append(held)
        cuts = range(0, len(paragraph), most) if len(paragraph) > most else [0]
        *full, held = (paragraph[i : i + most] for i in cuts)
        chunks += full
    return [*chunks, held] if held else chunks


def chunks_of(text: str, split: bool = True, most: int = MAX_CHUNK) -> list[str]:
    """A text of up to `most` characters, or one that may not be split, is one chunk; else its sections, and long sections
    by paragraphs; a longer paragraph is cut."""
    text = text.strip()
    if not text:
        return []
    if not split or len(text) <= most:
        return [text]
    starts = sorted({0, *(m.start() for m in _HEADING.finditer(text))})
    sections = [text[a:z].strip() for a, z in zip(starts, [*starts[1:], len(text)], strict=True)]
    out: list[str] = []
    for s in sections:
        out += [s] if len(s) <= most else _packed(s, most)
    return [c for c in out if c]


def chunked(text: Column, split: bool = True, most: int = MAX_CHUNK) -> Column:
    """array<string>; null and blank texts have no chunks. Only texts that are cut go through Python."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks_of(t, split, most) if isinstance(t, str) else [])

    ends, body = text.rlike(rf"^{_BLANK}|{_BLANK}\z"), F.regexp_replace(text, _BLANK_ENDS, "")
    long = (F.char_length(text) > most) & (F.char_length(body) > most) if split else F.lit(False)
    none = F.array().cast("array<string>")
    one = lambda b: F.when(b == "", none).otherwise(F.array(b))
    return F.when(text.isNull(), none).when(long, run(F.when(long, text))).when(ends, named(body, one)).otherwise(one(text))
