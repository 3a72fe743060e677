"""Column expressions for text: cleaning (P12, P13), word splitting, overlapping word windows
(C1), sentence splitting (P14), text normalisation (T3) and token helpers (T4, T7).

All of these are JVM-side expressions (regexp_replace, split, transform, slice, ...) and stay in
whole-stage code generation; only NFKD normalisation (no Spark built-in) needs a pandas UDF.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# Patterns that must equal the reference's text cleaning for equal results.
#   1. "&amp;" becomes "&"
#   2. greedy entity strip "&.+;" (one line: "." does not cross a newline) becomes one space
#   3. "<br>" becomes one space
#   4. runs of non-word characters (word = letter, number or underscore, Unicode-aware) become
#      one space, then the ends are stripped
AMP_ENTITY = "&amp;"
GREEDY_ENTITY = "&[^\\n]+;"
BR_TAG = "<br>"
NON_WORD_RUN = "[^\\p{L}\\p{N}_]+"
# Non-greedy alternative for the entity step (offered, not the default).
STRICT_ENTITY = "&[^;\\s]+;"
# ---------------------------------------------------------------------------------------------

# Sentence-piece word-start marker used by the piece-level helpers.
PIECE_MARK = "▁"

# The characters Python's str.split() / str.strip() treat as whitespace.
WS_CLASS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text_full(c, entity_mode: str = "compat") -> Column:
    """Entities, ``<br>``, non-word runs, strip.  ``entity_mode='strict'`` uses a
    non-greedy entity pattern instead of the reference's greedy one."""
    return F.trim(F.regexp_replace(_without_entities(c, entity_mode), NON_WORD_RUN, " "))


def _without_entities(c, entity_mode: str) -> Column:
    pattern = GREEDY_ENTITY if entity_mode == "compat" else STRICT_ENTITY
    s = F.regexp_replace(F.replace(_c(c), F.lit(AMP_ENTITY), F.lit("&")), pattern, " ")
    s = F.when(F.contains(_c(c), F.lit("&")), s).otherwise(_c(c))  # most texts have none
    return F.replace(s, F.lit(BR_TAG), F.lit(" "))


def clean_words(c, entity_mode: str = "compat") -> Column:
    """The words of a text cleaned by P12, cut at the non-word runs without writing the cleaned text first."""
    return F.array_remove(F.split(_without_entities(c, entity_mode), NON_WORD_RUN), "")


def clean_text_basic(c) -> Column:
    """Only the non-word collapse and strip."""
    return F.trim(F.regexp_replace(_c(c), NON_WORD_RUN, " "))


def py_strip(c) -> Column:
    """Python ``str.strip()`` for the whitespace that occurs in text files."""
    return F.regexp_replace(_c(c), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def _single_spaces(c) -> Column:
    """Whitespace runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), f"{WS_CLASS}+", " "))


def split_words(c, cleaned: bool = False) -> Column:
    """Python ``str.split()``: split on whitespace runs, no empty words (so '' -> []).
    ``cleaned=True`` skips the whitespace normalisation for text that came out of
    :func:`clean_text_full` / :func:`clean_text_basic` (single spaces, no ends)."""
    s = _c(c) if cleaned else _single_spaces(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))


def word_windows(words, size: int, overlap: float = 0.25) -> Column:
    """Overlapping windows of ``size`` words; ``step = size - int(overlap * size)``.

    First window starts at 0; if there are more than ``size`` words, further windows start at
    ``step, 2*step, ... < n``.  An empty word list gives one empty window."""
    step = size - int(overlap * size)
    if step <= 0:
        raise ValueError("overlap must leave a positive step")
    w = _c(words)
    n = F.size(w)
    starts = F.when(n > size, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array(F.lit(0)))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))


def chunk_text(c, size: int, overlap: float = 0.25) -> Column:
    """C1 on a text column.  Pass a column of words to :func:`word_windows` where possible: a
    lambda that refers to an expression re-evaluates it for every window, so callers that
    project many rows should first materialise the words (see ``explode_chunks``)."""
    return word_windows(split_words(c), size, overlap)


def sentences(cols, clean: bool = True, entity_mode: str = "compat") -> Column:
    """Per column split on newline, strip, drop empty, clean (P12), strip, drop empty;
    concatenated over the columns in order.  Null columns contribute nothing."""
    parts = [F.coalesce(F.split(_c(c), "\n"), F.array().cast("array<string>")) for c in cols]
    arr = F.flatten(F.array(*parts)) if len(parts) > 1 else parts[0]
    # cleaning strips too: whitespace at the ends is part of a non-word run and of no entity
    each = (lambda s: clean_text_full(s, entity_mode)) if clean else py_strip
    return F.filter(F.transform(arr, lambda s: each(s)), lambda s: F.length(s) > 0)


def concat_text(cols, fill: str = " ") -> Column:
    """Join text columns with one space after null -> ``fill``."""
    return F.concat_ws(" ", *[F.coalesce(_c(c), F.lit(fill)) for c in cols])


# --- T3 text normalisation ------------------------------------------------------------------

_MARKS: list[re.Pattern] = []


def _combining() -> re.Pattern:
    """All characters with a combining class, as one character class (made once per process)."""
    if not _MARKS:
        marks = (chr(i) for i in range(0x300, 0x1F000) if unicodedata.combining(chr(i)))
        _MARKS.append(re.compile("[" + "".join(marks) + "]+"))
    return _MARKS[0]


def by_rows(find, column, bytes_at_once: int = 1 << 20):
    """``find`` over an Arrow column a run of rows at a time, so that a worker holds the Python values of one run only; a run has
    ``bytes_at_once`` bytes or one row."""
    import pyarrow as pa

    if not len(column):
        return find(column)
    step = max(1, int(len(column) * bytes_at_once // max(column.nbytes, 1)))
    return pa.concat_arrays([find(column.slice(i, step)) for i in range(0, len(column), step)])


def _nfkd_strip_marks(texts):
    import pyarrow as pa

    marks = _combining()
    one = lambda s: None if s is None else marks.sub("", unicodedata.normalize("NFKD", s))
    return by_rows(lambda run: pa.array([one(s.as_py()) for s in run], pa.string()), texts)


def _nfkd_udf():
    """NFKD, then drop combining characters (Spark has no Unicode normaliser built in)."""
    import pyarrow as pa

    _nfkd_strip_marks.__annotations__ = {"texts": pa.Array, "return": pa.Array}  # as objects: this module's own are strings
    return F.arrow_udf(_nfkd_strip_marks, T.StringType())


nfkd_strip_marks = _nfkd_udf()


def normalise_text(c, remove_space: bool = True, keep_accents: bool = False, lower: bool = False) -> Column:
    """Collapse whitespace, two backticks / two quotes -> '"', NFKD without combining marks
    unless ``keep_accents``, optional lower-casing."""
    s = _c(c)
    if remove_space:
        s = _single_spaces(s)
    s = F.replace(F.replace(s, F.lit("``"), F.lit('"')), F.lit("''"), F.lit('"'))
    if not keep_accents:
        # ASCII texts stay as they are: the UDF, which Spark evaluates for every row, gets nulls for them
        other = F.transform(F.array(s), lambda x: F.when(F.octet_length(x) != F.length(x), x))[0]
        s = F.coalesce(nfkd_strip_marks(other), s)
    if lower:
        s = F.lower(s)
    return s


# --- piece-level helpers (T4, T7) -----------------------------------------------------------

def word_pieces(c, cleaned: bool = False) -> Column:
    """Word-level pieces with the word-start marker: 'a b' -> ['▁a', '▁b']; ``cleaned`` as in :func:`split_words`."""
    return F.transform(split_words(c, cleaned), lambda w: F.concat(F.lit(PIECE_MARK), w))


# Characters Python's str.isdigit() accepts besides decimal digits (superscripts, subscripts,
# circled and parenthesised digits).
DIGIT_CLASS = "[\\p{Nd}\\u00B2\\u00B3\\u00B9\\u2070\\u2074-\\u2079\\u2080-\\u2089\\u2460-\\u2468\\u2474-\\u247C\\u2488-\\u2490\\u24F5-\\u24FD\\u2776-\\u277E\\u2780-\\u2788\\u278A-\\u2792]"


def repair_digit_comma(pieces) -> Column:
    """T4: a piece longer than 1 char that ends in ',' right after a digit is cut into its stem
    and ',' ; the stem keeps its leading marker only if the piece had one (the stem is not
    re-segmented: that needs the external piece model)."""
    return F.flatten(
        F.transform(
            _c(pieces),
            lambda x: F.when(
                x.endswith(",") & (F.length(x) > 1) & x.rlike(DIGIT_CLASS + ",$"),  # few pieces get as far as the pattern
                F.array(F.regexp_replace(x, ",$", ""), F.lit(",")),
            ).otherwise(F.array(x)),
        )
    )


def pieces_to_string(pieces) -> Column:
    """Concatenate pieces, marker -> space, strip."""
    return F.trim(F.replace(F.array_join(_c(pieces), ""), F.lit(PIECE_MARK), F.lit(" ")))
