"""Line-first quality rules, in native expressions: one projection per document, no shuffle.

Every line that holds a word is judged by itself; failing lines are removed; a document that loses too
much of its text, or fails the base limits, is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The blanks that a line can hold, as contents of SQL literals; the line feed separates lines.
_BLANKS = (" ", "\\t", "\\u000b", "\\u000c", "\\r")
_SYMBOLS = "#*$%&|<>"
_SEPARATORS = "|>»"
#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "cookies to", "enable javascript", "javascript is",
    "log in to", "lorem ipsum", "powered by", "privacy policy", "read more", "share this", "sign up", "skip to content",
    "subscribe to", "terms of service", "terms of use",
)


def _without(line: str, characters) -> str:
    for c in characters:
        line = f"replace({line}, '{c}', '')"
    return f"length({line})"


#: What is counted in a line ``l`` first: characters that are not blank, symbols, separators.
_LINE = (
    f"named_struct('line', l, 'n', {_without('l', _BLANKS)}, 'symbols', length(l) - {_without('l', _SYMBOLS)}, "
    f"'separators', length(l) - {_without('l', _SEPARATORS)})"
)
_SPACES = "(length(x.line) - length(replace(x.line, ' ', '')))"
_INNER_SPACES = "(length(trim(x.line)) - length(replace(x.line, ' ', '')))"
_END = "right(rtrim(x.line), 1)"
#: Does the line ``x`` fail?
#:
#: * navigation: three or more ``|`` ``>`` or ``»`` separators, one for every eight blanks at least;
#: * symbols: a tenth of its characters are symbols;
#: * shouting: half of its characters are capitals, in a line of ten characters or more;
#: * punctuation: it ends with an ellipsis or a comma, or has two words and no sentence end;
#: * boilerplate: a phrase of page furniture in a line of at most 200 characters.
_FAILS = (
    f"((x.separators >= 3 AND 8 * x.separators >= {_SPACES}) OR 10 * x.symbols >= x.n"
    " OR (x.n >= 10 AND 2 * length(regexp_replace(x.line, '[^A-Z]+', '')) >= x.n)"
    f" OR {_END} = ',' OR right(rtrim(x.line), 3) = '...'"
    f" OR ({_INNER_SPACES} = 1 AND NOT contains('.!?:;)\"', {_END}))"
    " OR (length(x.line) <= 200 AND transform(array(lower(x.line)), y -> "
    + " OR ".join(f"contains(y, '{p}')" for p in BOILERPLATE)
    + ")[0]))"
)


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words() -> Column:
    """Words covered by three-word windows met twice or more in the document.

    Windows are sorted by hash, neighbours with equal hashes repeat; of two repeated windows that start ``d``
    words apart, the first covers ``least(3, d)`` words that the second doesn't.
    """
    windows = (
        "sort_array(transform(sequence(0, size(words) - 3), i -> struct("
        "xxhash64(words[i], words[i + 1], words[i + 2]) AS h, i AS i)))"
    )
    starts = (
        "sort_array(transform(filter(w, (x, k) -> get(w, k - 1).h <=> x.h OR get(w, k + 1).h <=> x.h), x -> x.i))"
    )
    covered = "aggregate(s, named_struct('n', 0L, 'end', -1), (a, x) -> named_struct('n', a.n + least(3, x + 3 - greatest(a.end, x)), 'end', x + 3)).n"
    return F.expr(f"IF(size(words) < 3, 0L, {_let(windows, 'w', _let(starts, 's', covered))})")


def judge_lines(docs: DataFrame, *, text_col: str = "text", min_words: int = 50, repeat_percent: int = 50, min_left_percent: int = 60) -> DataFrame:
    """All columns of ``docs``, then a struct ``judged``:

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines (lines that hold a
    word), n_failed_lines, left_chars (word characters in lines that pass), clean_text (those lines and blank
    ones), kept. ``kept`` is false when the base fails (fewer than ``min_words`` words, or over
    ``repeat_percent`` of them in repeated windows) or when fewer than ``min_left_percent`` of the word
    characters are left.

    A null text counts as empty and stays null in clean_text; texts without words fail the base. Rows are judged
    one by one, so repeated rows and ids make no difference. An input column named ``judged`` is replaced.
    """
    text = f"coalesce(`{text_col}`, '')"
    keep = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.expr(text).alias("text"))
    split = keep.select(
        "row",
        F.expr("array_remove(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), '') AS words"),
        F.expr(
            f"transform(transform(split(text, '\n'), l -> {_LINE}), "
            f"x -> named_struct('line', x.line, 'n', x.n, 'symbols', x.symbols, 'fails', x.n > 0 AND {_FAILS})) AS lines"
        ),
    )
    counted = split.select(
        "row",
        F.expr("cast(size(words) AS bigint) AS n_words"),
        F.expr("aggregate(lines, 0L, (a, l) -> a + l.n) AS word_chars"),
        F.expr("aggregate(lines, 0L, (a, l) -> a + l.symbols) AS n_symbols"),
        F.expr("filter(lines, l -> l.n > 0) AS worded"),
        _repeat_words().alias("n_repeat_words"),
        F.expr("aggregate(lines, 0L, (a, l) -> a + IF(l.fails, 0, l.n)) AS left_chars"),
        F.expr("array_join(transform(filter(lines, l -> NOT l.fails), l -> l.line), '\\n') AS clean_text"),
    )
    judged = counted.withColumns({
        "n_dup_lines": F.expr("cast(size(worded) - size(array_distinct(transform(worded, l -> l.line))) AS bigint)"),
        "n_lines": F.expr("cast(size(worded) AS bigint)"),
        "n_failed_lines": F.expr("cast(size(filter(worded, l -> l.fails)) AS bigint)"),
        "base_failed": F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {repeat_percent} * n_words"),
    }).withColumns({
        "kept": F.expr(f"NOT base_failed AND 100 * left_chars >= {min_left_percent} * word_chars"),
        "clean_text": F.expr(f"IF(row.`{text_col}` IS NULL, null, clean_text)"),
    })
    fields = (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_lines", "n_failed_lines", "left_chars", "clean_text", "kept",
    )
    others = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() != "judged"]
    # A generator of one row: a later filter on the verdict stays above it, so nothing is computed twice.
    return judged.select(*others, F.explode(F.array(F.struct(*fields))).alias("judged"))
