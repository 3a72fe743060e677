"""DuckDB spellings of the text expressions, for the oracle SQL that checks each query."""

from __future__ import annotations


def clean_full(c: str) -> str:
    s = f"replace({c}, '&amp;', '&')"
    s = f"regexp_replace({s}, '&[^\\n]+;', ' ', 'g')"
    s = f"regexp_replace({s}, '<br>', ' ', 'g')"
    s = f"regexp_replace({s}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')"
    return f"trim({s})"


def clean_basic(c: str) -> str:
    return f"trim(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


# Python's whitespace set in RE2 syntax (the Spark side spells the same set for Java).
WS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def py_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def split_words(c: str) -> str:
    s = py_strip(f"regexp_replace({c}, '{WS}+', ' ', 'g')")
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE string_split({s}, ' ') END)"


def word_windows(w: str, size: int, overlap: float = 0.25) -> str:
    step = size - int(overlap * size)
    return (
        f"list_transform(CASE WHEN len({w}) > {size} THEN range(0, len({w}), {step}) ELSE [0] END, "
        f"lambda i: array_to_string({w}[i + 1:i + {size}], ' '))"
    )


def vector_md5(c: str) -> str:
    return f"md5(array_to_string(list_transform({c}, lambda x: CAST(round(x * 1000000) AS BIGINT)), ','))"


def words_in(c: str) -> str:
    return f"(CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END)"


def hash_hex(seed, *parts: str) -> str:
    return "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def uniform(seed, *parts: str) -> str:
    return f"(('0x' || substr({hash_hex(seed, *parts)}, 1, 13))::BIGINT / 4503599627370496.0)"


def uniform_hex(h: str) -> str:
    return f"(('0x' || substr({h}, 1, 13))::BIGINT / 4503599627370496.0)"
