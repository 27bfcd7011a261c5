"""DuckDB spellings of the column functions, for the oracles."""

from __future__ import annotations

from ..functions import arabic as ar
from ..functions.text import PUNCTUATION, SPACE


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(expr: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(to)}, 'g')"


def values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else q(v) if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names}))"


def no_punct(e: str) -> str:
    return f"translate({e}, {q(PUNCTUATION)}, '')"


def squeeze(e: str) -> str:
    return f"trim({rx(e, SPACE, ' ')})"


def words(e: str) -> str:
    return f"list_filter(string_split_regex({e}, {q(SPACE)}), lambda x: x <> '')"


def translit(e: str) -> str:
    return f"translate(lower({e}), {q(ar.LATIN)}, {q(ar.ARABIC)})"


def strip(e: str) -> str:
    return rx(e, ar.STRIPPED)


def hamza(e: str) -> str:
    return f"replace(translate({e}, 'أإؤئ', 'ءءءء'), 'آ', {q('ء' + ar.FATHA + 'ا')})"


def al(e: str) -> str:
    return rx(e, "(^| )ال", r"\1ء" + ar.FATHA + "ل")


def shadda(e: str) -> str:
    plain = f"[{ar.MARKS.replace(ar.SHADDA, '')}]*"
    for _ in range(3):
        e = rx(e, f"{ar.SHADDA}({plain}){ar.SHADDA}", ar.SHADDA + r"\1")
    return rx(e, f"({ar.LETTER})({plain}){ar.SHADDA}", r"\1" + ar.SUKUN + r"\1\2")


def phones(e: str) -> str:
    madda = f"replace({e}, 'آ', {q('ء' + ar.FATHA + 'ا')})"
    return f"regexp_extract_all({shadda(madda)}, {q(ar.LETTER + ar.MARK + '*')})"


def classes(e: str) -> str:
    vowel = f"[{ar.SHORT}{ar.TANWIN}]"
    one = (
        f"CASE WHEN starts_with(p, 'ا') THEN 'A' WHEN starts_with(p, 'ى') THEN 'V' WHEN regexp_matches(p, {q(vowel)}) THEN 'M' "
        "WHEN left(p, 1) IN ('و', 'ي') THEN 'V' ELSE 'S' END"
    )
    s = f"array_to_string(list_transform({phones(e)}, lambda p: {one}), '')"
    return f"regexp_replace(regexp_replace({s}, '^AS', 'WS'), 'M([VA])A$', 'M\\1F')"


def slots(cls: str) -> str:
    """The fold, with the open slot behind the last blank of an accumulated string."""
    from ..functions.syllable import STEPS

    open_ = "string_split(a, ' ')[-1]"
    shut = f"(CASE WHEN {open_} = '' THEN a ELSE a || ' ' END)"
    steps = " ".join(f"WHEN {open_} = {q(o)} AND {'x = ' + q('S') if e == 'C' else 'x IN (' + q('V') + ', ' + q('A') + ', ' + q('W') + ', ' + q('F') + ')'} THEN left(a, length(a) - length({open_})) || {q(b)}" for (o, e), b in STEPS.items())
    step = f"CASE WHEN x = 'M' THEN {shut} || 'CV' WHEN x IN ('W', 'F') THEN {shut} || x || ' ' {steps} WHEN x = 'S' THEN {shut} || 'C' ELSE a || '+V' END"
    return f"trim(list_reduce(list_prepend('', list_filter(string_split({cls}, ''), lambda z: z <> '')), lambda a, x: {step}))"


def gate(p: str) -> str:
    from ..functions.syllable import WHOLE

    bad = f"len(list_filter(string_split({p}, ' '), lambda z: z NOT IN ({', '.join(map(q, [*WHOLE, 'C', 'W', 'F']))}))) > 0"
    return f"CASE WHEN {p} = '' THEN 'DEFER' WHEN {bad} THEN 'BLOCK' WHEN list_contains(string_split({p}, ' '), 'C') THEN 'DEFER' ELSE 'ACCEPT' END"


#: surface, n of the transliterated vocabulary.
VOCABULARY = f"""(SELECT * FROM (SELECT {translit('w')} AS surface, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents) AS u WHERE w <> '' GROUP BY w) AS v WHERE regexp_matches(surface, {q('^' + ar.LETTER)}))"""
TOKENS = f"(SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS surface FROM (SELECT doc_id, {words('text')} AS ws FROM documents) AS d)"
