"""Quality rules, line first: lines that fail a rule go, then documents that lost too much text go.

Every line of a document that has a word is judged alone, by three rules:

* punctuation: it has no letter or digit; or more than one symbol of ``[#*$%&|<>]`` per four words; or one ``!!`` or
  more per four words; or under eight words and no closing mark (``.!?;:`` and their kin) anywhere;
* navigation: it has three or more separators that stand alone as words, one or more per four words;
* boilerplate: it has one of the phrases in :data:`BOILERPLATE`, in any case.

Lines that fail any rule are removed. A document is then kept if it passed the base limits (50 words, at most half of its
words in repeated three-word windows) and at least half of its words are in lines that stayed.

One pass over the text in Arrow batches, no shuffle; a document is worked on alone, so nothing depends on what else there is.

* Null text: no words; all counts 0, ``base_failed``, not kept, ``clean_text`` null. Empty text: the same, ``clean_text`` empty.
* Very long texts are judged whole. Repeated rows and equal ids are judged one by one. An empty table gives an empty table.
* Columns of the input that have the name of a result column are not carried along.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from newsloom.llm.common import batch_map, quoted

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_KEPT_PERCENT = 50
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "click here", "enable javascript", "sign up for our newsletter", "subscribe to our newsletter", "licensed under", "lorem ipsum",
)
SYMBOLS = b"#*$%&|<>"
SEPARATORS = {b"|", b"/", b">", b"<", b"-", b"*", "•".encode(), "·".encode(), "»".encode(), "›".encode()}
CLOSING = re.compile("[.!?;:…。！？]")  # noqa: RUF001
LETTER = re.compile(r"[^\W_]")
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_SPACE = b" \t\n\v\f\r"


def line_fails(line: str, words: list[bytes]) -> str | None:
    """The rule that a line with words fails, if any."""
    raw, n = line.encode(), len(words)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    if not LETTER.search(line) or 4 * symbols > n or 4 * raw.count(b"!!") >= n or (n < 8 and not CLOSING.search(line)):
        if 4 * (alone := sum(w in SEPARATORS for w in words)) >= n and alone >= 3:
            return "navigation"
        return "punctuation"
    if 4 * (alone := sum(w in SEPARATORS for w in words)) >= n and alone >= 3:
        return "navigation"
    return "boilerplate" if _BOILERPLATE.search(line.lower()) else None


def repeat_words(words: list[bytes]) -> int:
    """Words covered by a three-word window that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def judge(text: str | None) -> tuple:
    """What :func:`quality_rules` returns for a text, in its order of columns."""
    words = [] if text is None else text.encode().split()
    if not words:
        return 0, 0, 0, 0, 0, True, False, 0, 0, text
    raw = text.encode()
    chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen, repeated, lost_lines, lost_words, left = set(), 0, 0, 0, []
    for line in text.split("\n"):
        own = line.encode().split()
        if not own:
            left.append(line)
            continue
        repeated += line in seen
        seen.add(line)
        if line_fails(line, own):
            lost_lines += 1
            lost_words += len(own)
        else:
            left.append(line)
    n, again = len(words), repeat_words(words)
    failed = n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n
    kept = not failed and 100 * (n - lost_words) >= MIN_KEPT_PERCENT * n
    return n, chars, symbols, repeated, again, failed, kept, lost_lines, lost_words, "\n".join(left) if lost_lines else text


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "n_words_removed", "clean_text")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, n_words_removed long, clean_text string"


def quality_rules(docs: DataFrame, text: str = "text", carry_text: bool = True) -> DataFrame:
    """Every row of ``docs``, with or without its text, with the counts, the verdict and the text without the lines that failed."""
    taken = {c.lower() for c in COLUMNS}
    carried = [c for c in docs.columns if (c.lower() not in taken and c != text) or (c == text and carry_text)]
    schema = T.StructType([docs.schema[c] for c in carried] + T._parse_datatype_string(SCHEMA).fields)
    place = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> dict:
        found = list(zip(*(judge(t.as_py()) for t in batch.column(place)), strict=True)) or [()] * len(COLUMNS)
        return {c: batch.column(c) for c in carried} | dict(zip(COLUMNS, found, strict=True))

    return batch_map(docs, [quoted(c) for c in docs.columns], run, schema)
