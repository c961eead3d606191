"""Text column functions (JVM-side expressions, Arrow pandas UDFs only where a
scan over characters is needed)."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default token pattern: a run of letters/digits/underscore, or one other
# non-space character.  It needs no vocabulary file and any SQL engine can repeat
# it; a tokenizer (``functions/tokenizers.py``, any callable) can be plugged in.
TOKEN_PATTERN = r"[\pL\pN_]+|[^\pL\pN_\s]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_length(text, tokenizer: Callable[[str], list] | None = None) -> Column:
    """number of tokens; NULL text has length 0.

    With ``tokenizer`` (a callable str -> list of tokens, loaded once per
    worker) the count runs as an Arrow pandas UDF.
    """
    if tokenizer is None:
        return F.coalesce(F.regexp_count(_c(text), F.lit(TOKEN_PATTERN)), F.lit(0))

    @F.pandas_udf(T.LongType())
    def _count(s: pd.Series) -> pd.Series:
        return s.map(lambda x: 0 if x is None else len(tokenizer(x))).astype("int64")

    return _count(_c(text))


def canonical_newlines(text, keep: int = 1) -> Column:
    """runs of newlines -> one (keep=1) or runs of 2+ -> two (keep=2)."""
    if keep == 1:
        return F.regexp_replace(_c(text), r"\n+", "\n")
    return F.regexp_replace(_c(text), r"\n{2,}", "\n\n")


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def html_to_text_regex(html, fallback: int = 25) -> Column:
    """F2 (SQL-checkable form): drop script/style blocks and tags, decode the
    basic entities, collapse blank runs; fall back to the raw HTML when the
    result is shorter than ``fallback`` characters."""
    t = F.regexp_replace(_c(html), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for a, b in _ENTITIES:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.trim(F.regexp_replace(t, r"[ \t]+", " "))
    return F.when(F.length(t) < fallback, _c(html)).otherwise(t)


def _html_text(html: str | None, fallback: int) -> str | None:
    if html is None:
        return None

    class _P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style"):
                self.skip += 1

        def handle_endtag(self, tag):
            if tag in ("script", "style") and self.skip:
                self.skip -= 1

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    p = _P()
    p.feed(html)
    p.close()
    text = "".join(p.out)
    return html if len(text) < fallback else text


def html_to_text(html, fallback: int = 25) -> Column:
    """text content of an HTML page via the standard-library parser (Arrow
    batches), script/style bodies dropped; raw HTML when shorter than fallback."""

    @F.pandas_udf(T.StringType())
    def _conv(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _html_text(x, fallback))

    return _conv(_c(html))


# Elements that end a block (a blank line around them), those that end
# a line, and those whose content is no text.
_BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table section article header footer nav main aside form fieldset hr body".split())
_LINES = frozenset("br li tr dt dd caption".split())
_CELLS = frozenset(("td", "th"))
_NO_TEXT = frozenset(("script", "style", "head", "title", "template"))


class _BlockText(HTMLParser):
    """Text by blocks: white space runs are one blank outside ``pre``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = [""]
        self.breaks, self.hidden, self.pre = 0, 0, 0

    def _end(self, breaks: int) -> None:
        self.breaks = max(self.breaks, breaks)

    def handle_starttag(self, tag, attrs):
        if tag in _NO_TEXT:
            self.hidden += 1
        elif tag in _BLOCKS:
            self._end(2)
        elif tag in _LINES:
            self._end(1)
        elif tag in _CELLS:
            self._put(" ")
        self.pre += tag == "pre"

    def handle_startendtag(self, tag, attrs):
        if tag not in _NO_TEXT:
            self.handle_starttag(tag, attrs)
            self.pre -= tag == "pre"

    def handle_endtag(self, tag):
        if tag in _NO_TEXT:
            self.hidden = max(0, self.hidden - 1)
        elif tag in _BLOCKS:
            self._end(2)
        elif tag in _LINES and tag != "br":
            self._end(1)
        if tag == "pre":
            self.pre = max(0, self.pre - 1)

    def _put(self, text: str) -> None:
        if self.breaks and (self.pre or text.strip(" ")):
            if any(self.lines):
                self.lines += [""] * self.breaks
            self.breaks = 0
        if self.breaks or not (self.pre or text.strip(" ") or self.lines[-1]):
            return  # blanks between blocks, or at the start of a line
        if not self.pre and (not self.lines[-1] or self.lines[-1].endswith(" ")):
            text = text.lstrip(" ")
        self.lines[-1] += text

    def handle_data(self, data):
        if self.hidden:
            return
        if not self.pre:
            self._put(re.sub("[ \t\n\r\f]+", " ", data))
            return
        for i, line in enumerate(data.split("\n")):
            if i:
                self.lines.append("")
            self._put(line)

    def text(self) -> str:
        return "\n".join(x.rstrip(" ") for x in self.lines).strip("\n")


def block_text(html: str | None, fallback: int = 25) -> str | None:
    """F2 by blocks: the text of an HTML page with a blank line between blocks
    (paragraphs, headings, lists, tables, ``pre``) and a line per list item, table row
    or ``br``.

    Links and emphasis leave their text, images and anchors nothing; table cells
    are set apart by a blank; scripts, styles and the head are no text.  Shorter
    than ``fallback`` characters, the result is the raw HTML.
    """
    if html is None:
        return None
    p = _BlockText()
    p.feed(html)
    p.close()
    text = p.text()
    return html if len(text) < fallback else text


def extract_response(text, marker: str) -> Column:
    """F8: the text after the first ``marker``, stripped; NULL without marker."""
    from pairlab.functions.numeric import py_strip
    part = F.try_element_at(F.split(_c(text), re.escape(marker), 2), F.lit(2))
    return py_strip(part)


_SLOT = re.compile(r"\{(\w+)\}")


def fill_template(template: str, values: dict) -> Column:
    """Fill ``{name}`` slots of a literal template with columns, all at once
    (a value that itself contains ``{x}`` is not expanded again)."""
    parts, pos = [], 0
    for m in _SLOT.finditer(template):
        parts.append(F.lit(template[pos:m.start()]))
        parts.append(values[m.group(1)])
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


# F9 -------------------------------------------------------------------------
_MAIN = re.compile(r"\b(?:int\s+)?main\b")


def cut_after_main(text: str | None) -> str | None:
    """``text`` up to the brace that closes the body of its first ``main``.

    Over the braces after ``main`` the running sum (+1 open, -1 close) returns to
    zero at the end of the body: at the first closing brace with sum zero that
    has an opening one before it.  Braces in strings count; without ``main`` or
    such a brace the text stays whole.
    """
    found = _MAIN.search(text) if text is not None else None
    if found is None:
        return text
    tail = np.array(list(text[found.end():]), dtype="U1")
    at = np.flatnonzero((tail == "{") | (tail == "}"))
    step = np.where(tail[at] == "{", 1, -1)
    ends = at[(step < 0) & (np.cumsum(step) == 0) & (np.cumsum(step > 0) > 0)]
    return text[:found.end() + int(ends[0]) + 1] if len(ends) else text


def first_program(text) -> Column:
    """keep a completion up to the end of its first ``main`` (Arrow UDF)."""

    @F.pandas_udf(T.StringType())
    def _cut(s: pd.Series) -> pd.Series:
        return s.map(cut_after_main)

    return _cut(_c(text))


def postprocess_completion(text, template: str) -> Column:
    """Completions of the ``code_opt`` template keep only their first program;
    other templates' completions are left as they are."""
    return first_program(text) if template == "code_opt" else _c(text)


# Portable seeded hash -------------------------------------------------------

def seeded_hash(*cols, seed: int = 0) -> Column:
    """60-bit hash of a seed and any columns, by their text, from MD5.

    Every bit mixes seed and keys, ids may be strings, and any SQL engine with
    MD5 can repeat it (so an oracle can check seeded shuffles and draws).
    """
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def seeded_hash_sql(*cols: str, seed: int = 0) -> str:
    key = " || '|' || ".join([f"'{seed}'", *[f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols]])
    return f"CAST('0x' || substr(md5({key}), 1, 15) AS BIGINT)"
