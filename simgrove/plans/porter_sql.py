"""The Porter stemmer as SQL over a table of words: consonants and vowels as regular expressions, a step for each table."""

from simgrove.functions.porter import STEP2, STEP3, STEP4

# a y at the start counts as a consonant, so it is written Y; elsewhere it is a vowel after a consonant
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_POSITIVE = f"^({_C})?{_V}{_C}"
_ONE = f"^({_C})?{_V}{_C}({_V})?$"
_MORE = f"^({_C})?{_V}{_C}{_V}{_C}"
_VOWEL = f"^({_C})?[aeiouy]"
_CVC = f"^{_C}[aeiouy][^aeiouwxy]$"


def _is(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _cut(n: int) -> str:
    return f"left(s, length(s) - {n})"


def _table(table: dict[str, str], measure: str) -> str:
    """The longest suffix that is shorter than the word decides, whether its stem is long enough or not."""
    out = "CASE"
    for end, new in sorted(table.items(), key=lambda x: (-len(x[0]), x[0])):
        ok = _is(_cut(len(end)), measure) + (f" AND {_is(_cut(3), '[st]$')}" if end == "ion" else "")
        out += f" WHEN s LIKE '_%{end}' THEN CASE WHEN {ok} THEN {_cut(len(end))} || '{new}' ELSE s END"
    return out + " ELSE s END"


_DOUBLE = "right(s, 1) = right(left(s, length(s) - 1), 1) AND length(s) > 1 AND (right(s, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'y') OR regexp_matches(s, '[^aeiouy]yy$'))"
#: (columns that a step makes from the last one's s); `made` says that 1b has cut an ending
_STEPS = [
    "CASE WHEN s LIKE '%sses' OR s LIKE '%ies' THEN left(s, length(s) - 2) WHEN s LIKE '%s' AND s NOT LIKE '%ss' THEN left(s, length(s) - 1) ELSE s END AS s",
    f"""CASE WHEN s LIKE '%eed' THEN CASE WHEN {_is(_cut(3), _POSITIVE)} THEN {_cut(1)} ELSE s END WHEN s LIKE '%ed' THEN CASE WHEN {_is(_cut(2), _VOWEL)} THEN {_cut(2)} ELSE s END
     WHEN s LIKE '%ing' AND {_is(_cut(3), _VOWEL)} THEN {_cut(3)} ELSE s END AS s, s NOT LIKE '%eed' AND ((s LIKE '%ed' AND {_is(_cut(2), _VOWEL)}) OR (s LIKE '%ing' AND {_is(_cut(3), _VOWEL)})) AS made""",
    f"CASE WHEN NOT made THEN s WHEN {_is('s', '(at|bl|iz)$')} OR {_is('s', _CVC)} THEN s || 'e' WHEN {_DOUBLE} AND right(s, 1) NOT IN ('l', 's', 'z') THEN {_cut(1)} ELSE s END AS s",
    f"CASE WHEN s LIKE '%y' AND {_is(_cut(1), _VOWEL)} THEN {_cut(1)} || 'i' ELSE s END AS s",
    f"{_table(STEP2, _POSITIVE)} AS s",
    f"{_table(STEP3, _POSITIVE)} AS s",
    f"{_table(STEP4, _MORE)} AS s",
    f"CASE WHEN s LIKE '%e' AND ({_is(_cut(1), _MORE)} OR ({_is(_cut(1), _ONE)} AND NOT {_is(_cut(1), _CVC)})) THEN {_cut(1)} ELSE s END AS s",
    f"CASE WHEN s LIKE '%ll' AND {_is('s', _MORE)} THEN {_cut(1)} ELSE s END AS s",
]


def stems(words: str) -> str:
    """CTEs up to `stems` (word, stem) of a table or CTE `words` with the column word; of two letters or fewer nothing changes."""
    out = f"p0 AS (SELECT word, CASE WHEN word LIKE 'y%' THEN 'Y' || substr(word, 2) ELSE word END AS s, false AS made FROM {words} WHERE length(word) > 2)"
    for i, step in enumerate(_STEPS):
        made = "" if " AS made" in step else ", made"
        out += f",\n p{i + 1} AS (SELECT word, {step}{made} FROM p{i})"
    return out + f",\n stems AS (SELECT word, CASE WHEN s LIKE 'Y%' THEN 'y' || substr(s, 2) ELSE s END AS stem FROM p{len(_STEPS)} UNION ALL SELECT word, word FROM {words} WHERE length(word) <= 2)"
