"""DuckDB forms of the text measures, for oracles."""

from __future__ import annotations

from proseline.functions import text as T


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


TOKEN = quoted(T.TOKEN)


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {TOKEN})"


def n_tokens(x: str) -> str:
    return f"CAST(len({tokens(x)}) AS BIGINT)"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def filled(parts: str) -> str:
    return f"list_transform(list_filter({parts}, lambda p: regexp_matches(p, '\\S')), lambda p: {n_tokens('p')})"


def paragraphs(x: str) -> str:
    return filled(f"string_split({x}, chr(10) || chr(10))")


def sentences(x: str) -> str:
    marked = f"regexp_replace({stripped(x)}, '([.!?])\\s+', '\\1' || chr(30), 'g')"
    return filled(f"string_split({marked}, chr(30))")


def spread(values: str) -> str:
    total, squares = f"list_sum({values})", f"list_sum(list_transform({values}, lambda v: v * v))"
    return f"CASE WHEN len({values}) > 1 THEN sqrt(CAST({squares} * len({values}) - {total} * {total} AS DOUBLE)) / len({values}) END"


def hits(x: str, name: str, patterns: dict[str, str] = T.TELLS) -> str:
    double = f"len(list_filter(regexp_extract_all({x}, '-{{2,}}'), lambda d: len(d) = 2))"
    if name == "any_dash":
        return f"CAST(len(regexp_extract_all({x}, '—|–|\\s-\\s')) + {double} AS BIGINT)"
    if name == "ascii_double_dash":
        return f"CAST({double} AS BIGINT)"
    return f"CAST(len(regexp_extract_all({x}, {quoted('(?im)' + patterns[name])})) AS BIGINT)"


def opener(x: str) -> str:
    return f"lower(array_to_string(list_slice({tokens(x)}, 1, 5), ' '))"


def normalised(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


def shingles(x: str, k: int = 5) -> str:
    words = f"list_transform({tokens(x)}, lambda w: lower(w))"
    runs = f"list_distinct(list_transform(range(1, len({words}) - {k} + 2), lambda i: array_to_string(list_slice({words}, i, i + {k} - 1), ' ')))"
    return f"CASE WHEN len({words}) < {k} THEN [array_to_string({words}, ' ')] ELSE {runs} END"


def intent(x: str) -> str:
    first = f"split_part({stripped(x)}, chr(10), 1)"
    rest = " ".join(
        f"WHEN regexp_matches({x}, {quoted('(?i)' + p)}) THEN {quoted(n)}" for n, p in T.INTENTS.items() if n != "thanks"
    )
    return f"CASE WHEN regexp_matches({first}, {quoted('(?i)' + T.INTENTS['thanks'])}) THEN 'thanks' {rest} ELSE 'other' END"


def nearest(column: str, point: float, order: str | None = None) -> str:
    """Nearest-rank percentile of a group: the value at place floor(point * n)."""
    own = f"list(CAST({column} AS DOUBLE) ORDER BY {column}) FILTER (WHERE {column} IS NOT NULL)"
    return f"({own})[least(CAST(floor({point} * count({column})) AS BIGINT), count({column}) - 1) + 1]"


def mtld(words: str) -> str:
    """Lexical diversity of a list of tokens in lower case: a reduction over the tokens, each way."""

    def one(own: str) -> str:
        kinds = "CASE WHEN list_contains(a.s, x.s[1]) THEN a.s ELSE list_append(a.s, x.s[1]) END"
        state = lambda f, s, n: f"{{'f': {f}, 's': {s}, 'n': {n}}}"
        none = "CAST([] AS VARCHAR[])"
        step = f"CASE WHEN len({kinds}) / (a.n + 1) <= 0.72 THEN {state('a.f + 1', none, 'CAST(0 AS BIGINT)')} ELSE {state('a.f', kinds, 'a.n + 1')} END"
        rows = f"list_transform({own}, lambda t: {state('CAST(0 AS DOUBLE)', '[t]', 'CAST(0 AS BIGINT)')})"
        end = f"list_reduce({rows}, lambda a, x: {step}, {state('CAST(0 AS DOUBLE)', none, 'CAST(0 AS BIGINT)')})"
        total = "z.f + CASE WHEN z.n > 0 THEN (1 - len(z.s) / z.n) / (1 - 0.72) ELSE 0 END"
        return f"list_transform([{end}], lambda z: CASE WHEN {total} > 0 THEN len({words}) / ({total}) ELSE CAST(len({words}) AS DOUBLE) END)[1]"

    return f"CASE WHEN len({words}) >= 20 THEN ({one(words)} + {one(f'list_reverse({words})')}) / 2 END"
