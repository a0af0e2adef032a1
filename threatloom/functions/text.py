"""Text expressions. All native; nothing here leaves the JVM."""

import re

from .. import dimensions as D
from .sqltext import one_of, q

# Word boundary over ASCII letters, digits and underscore. Java's own \b
# depends on the JDK for accented letters; this one does not. Its \w is ASCII
# and one table look, where a written class without case is a chain of ranges.
_WORD = r"\w"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _cut(p: str) -> tuple[list, list]:
    """Alternatives of a pattern, and its groups outside others as (start, end)."""
    depth, bars, groups = 0, [-1], []
    for i, c in enumerate(p):
        if i and p[i - 1] == "\\":
            continue
        if c == "(":
            depth += 1
            if depth == 1:
                groups.append([i, i])
        elif c == ")":
            depth -= 1
            if not depth:
                groups[-1][1] = i
        elif c == "|" and not depth:
            bars.append(i)
    return [p[a + 1:b] for a, b in zip(bars, [*bars[1:], len(p)])], groups


def _in_words(p: str, end: bool) -> bool:
    """Whether each match surely starts (or ends) with an ASCII word character; false where that is not plain to see."""
    parts, groups = _cut(p)
    if len(parts) > 1:
        return all(_in_words(x, end) for x in parts)
    if end and p.endswith(")") or not end and p.startswith("(?:"):
        a, b = groups[-1 if end else 0]
        return p.startswith("(?:", a) and p[b + 1:b + 2] not in ("?", "*", "{") and _in_words(p[a + 3:b], end)
    plain = r"(?:^|[^\\])(?:\w|\w\w\?|\\d)$" if end else r"(?:\w|\\d)(?![?*{])"
    return re.search(plain if end else "^" + plain, p, re.ASCII) is not None


def _firsts(p: str) -> set | None:
    """The letters with which a match can start; None where that is not plain to see."""
    parts, groups = _cut(p)
    if len(parts) > 1:
        each = [_firsts(x) for x in parts]
        return None if None in each else set().union(*each)
    if p.startswith("(?:"):
        a, b = groups[0]
        return None if p[b + 1:b + 2] in ("?", "*", "{") else _firsts(p[a + 3:b])
    return {p[0].lower()} if re.match(r"[A-Za-z](?![?*{])", p) else None


def ascii_words(pattern: str) -> str:
    """Word boundaries over ASCII. At the ends of a pattern one look is enough where it starts or ends with a word character.

    A look at the first letter, which few places pass, comes before the look back.
    """
    p, head, tail = pattern, "", ""
    inner = p.removeprefix(r"\b").removesuffix(r"\b")
    if len(_cut(inner)[0]) == 1:
        if p.startswith(r"\b") and _in_words(inner, False):
            starts = _firsts(inner)
            look = f"(?=[{''.join(sorted(starts | {x.upper() for x in starts}))}])" if starts else ""
            p, head = p[2:], f"{look}(?<!{_WORD})"
        if p.endswith(r"\b") and _in_words(inner, True):
            p, tail = p[:-2], f"(?!{_WORD})"
    return head + p.replace(r"\b", _BOUNDARY) + tail


def contains_any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def contains_each(expr: str, *groups) -> str:
    """At least one word of every group."""
    return "(" + " AND ".join(contains_any(expr, g) for g in groups) + ")"


def clean_line(x: str, limit: int = 500) -> str:
    flat = (f"trim(regexp_replace(regexp_replace({x}, {q('[' + chr(92) + 'x00-' + chr(92) + 'x08' + chr(92) + 'x0b' + chr(92) + 'x0c' + chr(92) + 'x0e-' + chr(92) + 'x1f' + chr(92) + 'x7f]')}, ''), "
            f"{q(chr(92) + 's+')}, ' '))")
    return f"CASE WHEN length({flat}) > {limit} THEN concat(substring({flat}, 1, {limit}), '…') ELSE {flat} END"


def defang(x: str) -> str:
    return f"replace(regexp_replace({x}, '^(?i)http', 'hxxp'), '.', '[.]')"


def scrub_artefacts(x: str) -> str:
    """Blank corpus placeholders, list footers, signatures, quotes, attributions, inline headers, in that order."""
    for p in D.ARTEFACT_PATTERNS:
        x = f"regexp_replace({x}, {q(p)}, ' ')"
    return x


def clean_subject(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {q(D.SUBJECT_PREFIX)}, ''), {q(D.LIST_TAG)}, ' ')"


def mask_text(x: str) -> str:
    for p, r in ((D.MASK_URL, " urltoken "), (D.MASK_EMAIL, " emailtoken "), (D.MASK_NUMBER, " 0 ")):
        x = f"regexp_replace({x}, {q(p)}, {q(r)})"
    return f"lower(trim(regexp_replace({x}, {q(chr(92) + 's+')}, ' ')))"


def normalise(subject: str, body: str, max_chars: int | None = None) -> str:
    """Model input text. Whole by default; ``max_chars`` restores the bounded form (twice that before masking)."""
    text = f"concat({clean_subject(subject)}, '\\n', {body})"
    if max_chars:
        text = f"substring({text}, 1, {2 * max_chars})"
    text = mask_text(scrub_artefacts(text))
    return f"substring({text}, 1, {max_chars})" if max_chars else text


def alpha_tokens(x: str, min_len: int = 1) -> str:
    pattern = r"^\p{L}+$" if min_len <= 1 else r"^\p{L}{" + str(min_len) + r",}$"
    return f"filter(split({x}, {q(chr(92) + 's+')}), t -> t RLIKE {q(pattern)})"


def english_ratio(tokens: str) -> str:
    """Share of stop words among tokens; null when there are too few tokens to tell."""
    hits = f"size(filter({tokens}, t -> {one_of('t', D.STOPWORDS)}))"
    return f"CASE WHEN size({tokens}) >= {D.MIN_ENGLISH_TOKENS} THEN {hits} / size({tokens}) END"


def is_english(x: str) -> str:
    return f"transform(array({alpha_tokens(x)}), k -> coalesce({english_ratio('k')}, 0.0D) >= {D.MIN_ENGLISH_RATIO}D)[0]"


def blank_words(x: str) -> str:
    """Lower-case words between blanks."""
    return f"filter(split(lower({x}), {q(chr(92) + 's+')}), v -> v <> '')"


def char_wb_grams(x: str, sizes) -> str:
    """Character grams inside blank-padded words. A word shorter than a gram counts once, and longer sizes skip
    words that an earlier size already covered whole."""
    parts = []
    for i, n in enumerate(sizes):
        slide = f"transform(sequence(1, greatest(length(w) - {n - 1}, 1)), p -> substring(w, p, {n}))"
        if i:
            slide = f"IF(length(w) > {sizes[i - 1]}, {slide}, CAST(array() AS array<string>))"
        parts.append(slide)
    body = f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]
    words = f"transform({blank_words(x)}, v -> concat(' ', v, ' '))"
    return f"flatten(transform({words}, w -> {body}))"


def entropy_bits(x: str) -> str:
    """Shannon entropy of the characters of a string."""
    n = f"length({x})"
    share = f"(({n} - length(replace({x}, c, ''))) / {n})"
    return (f"CASE WHEN {n} > 0 THEN aggregate(array_sort(array_distinct(filter(split({x}, ''), c -> c <> ''))), 0.0D, "
            f"(acc, c) -> acc - {share} * log2({share})) ELSE 0.0D END")
