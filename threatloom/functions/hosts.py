"""Host names: suffix rules, registrable domains, look-alikes, scripts."""

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dimensions as D
from .sqltext import one_of, pick, q

IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
NON_ASCII = r"[^\x20-\x7e]"


@dataclass(frozen=True)
class SuffixRules:
    """Public suffix rules as membership sets; lookups compile to hash sets, so the full list needs no join."""
    multi: tuple = field(default_factory=lambda: tuple(D.MULTI_LABEL_SUFFIXES))
    wildcard_parents: tuple = field(default_factory=lambda: tuple(D.WILDCARD_SUFFIX_PARENTS))
    exceptions: tuple = field(default_factory=lambda: tuple(D.WILDCARD_SUFFIX_EXCEPTIONS))


RULES = SuffixRules()


def clean_host(h: str) -> str:
    return f"regexp_replace(regexp_replace(lower({h}), {q(chr(92) + '.$')}, ''), {q('^' + chr(92) + '[|' + chr(92) + ']$')}, '')"


def is_ipv4(h: str) -> str:
    return f"({h} RLIKE {q(IPV4)})"


def is_ip(h: str) -> str:
    return f"({is_ipv4(h)} OR (contains({h}, ':') AND {h} RLIKE '^[0-9a-fA-F:.]+$'))"


def suffix_depth(h: str, rules: SuffixRules = RULES) -> str:
    """How many labels the public suffix of a host has."""
    by_depth = {}
    for s in rules.multi:
        by_depth.setdefault(s.count(".") + 1, []).append(s)
    cases = [(one_of(f"substring_index({h}, '.', -{d})", by_depth[d]), str(d)) for d in sorted(by_depth, reverse=True)]
    last, two = f"substring_index({h}, '.', -1)", f"substring_index({h}, '.', -2)"
    cases.append((f"{one_of(last, rules.wildcard_parents)} AND contains({h}, '.') AND NOT "
                  f"{one_of(two, rules.exceptions)}", "2"))
    return pick(cases, "1")


def registrable(h: str, rules: SuffixRules = RULES) -> str:
    """Registrable domain; an IP address or a bare suffix stands for itself."""
    return f"CASE WHEN {is_ip(h)} THEN {h} ELSE substring_index({h}, '.', -1 - {suffix_depth(h, rules)}) END"


def official_brand(domain: str) -> str:
    """Brand that owns a registrable domain, or null."""
    return pick([(one_of(domain, domains.split()), q(name)) for name, _, domains in D.BRANDS])


def substitute(s: str) -> str:
    for a, b in D.SUBSTITUTIONS:
        s = f"replace({s}, {q(a)}, {q(b)})"
    return s


def latin_skeleton(s: str) -> str:
    return f"translate(lower({s}), {q(''.join(D.CONFUSABLES))}, {q(''.join(D.CONFUSABLES.values()))})"


def is_private_ip(ip: str) -> str:
    a, b = f"try_cast(split_part({ip}, '.', 1) AS int)", f"try_cast(split_part({ip}, '.', 2) AS int)"
    v4 = (f"coalesce({a} IN (10, 127) OR ({a} = 172 AND {b} BETWEEN 16 AND 31) OR ({a} = 192 AND {b} = 168) "
          f"OR ({a} = 169 AND {b} = 254), false)")
    return f"CASE WHEN {is_ipv4(ip)} THEN {v4} ELSE lower({ip}) RLIKE '^(?:::1$|fc|fd|fe80)' END"


@F.pandas_udf(T.StructType([T.StructField("unicode", T.StringType()), T.StructField("folded", T.StringType())]))
def decode_idn(host: pd.Series) -> pd.DataFrame:
    """Unicode form of an internationalised host and its NFKC lower-case fold; null stays null."""
    import unicodedata

    def one(h):
        if h is None:
            return None, None
        labels = []
        for label in h.split("."):
            try:
                labels.append(label[4:].encode("ascii").decode("punycode") if label.startswith("xn--") else label)
            except (UnicodeError, ValueError):
                labels.append(label)
        u = ".".join(labels)
        return u, unicodedata.normalize("NFKC", u).lower()

    return pd.DataFrame([one(h) for h in host], columns=["unicode", "folded"])


SCRIPTS = [r"\p{IsLatin}", r"\p{IsCyrillic}", r"\p{IsGreek}", r"\p{IsArmenian}"]


def script_count(label: str) -> str:
    """How many scripts the letters of a label use; letters of any further script count as one."""
    named = " + ".join(f"int({label} RLIKE {q(s)})" for s in SCRIPTS)
    rest = f"regexp_replace({label}, {q('[' + ''.join(SCRIPTS) + ']')}, '')"
    return f"({named} + int({rest} RLIKE {q(chr(92) + 'p{L}')}))"


def host_dimension(hosts: DataFrame, rules: SuffixRules = RULES) -> DataFrame:
    """One row per distinct host with everything the detectors need to know about it.

    ``hosts`` has one column ``host``. The expensive comparisons with every
    brand keyword run once per distinct host, never once per link.
    """
    base = hosts.where("host IS NOT NULL AND host <> ''").selectExpr(f"{clean_host('host')} AS host").distinct()
    df = base.selectExpr("host", f"{is_ip('host')} AS is_ip", f"{suffix_depth('host', rules)} AS _depth",
                         f"host RLIKE {q('(?:^|' + chr(92) + '.)xn--')} OR host RLIKE {q(NON_ASCII)} AS is_idn")
    df = df.select("*", decode_idn(F.expr("IF(is_idn, host, NULL)")).alias("_idn"))
    df = df.selectExpr(
        "*", "IF(is_ip, host, substring_index(host, '.', -1 - _depth)) AS registrable",
        "IF(is_ip, '', substring_index(host, '.', -_depth)) AS public_suffix",
        "coalesce(_idn.unicode, host) AS unicode_host", "coalesce(_idn.folded, host) AS _folded")
    df = df.selectExpr(
        "*", "IF(is_ip, host, substring_index(registrable, '.', 1)) AS label",
        "IF(is_ip, _folded, substring_index(substring_index(_folded, '.', -1 - _depth), '.', 1)) AS _ulabel",
        "IF(length(host) > length(registrable), substring(host, 1, length(host) - length(registrable) - 1), '') AS subdomain",
        "substring_index(public_suffix, '.', -1) AS tld", f"{official_brand('registrable')} AS brand")
    df = df.selectExpr(
        "*", f"{one_of('registrable', D.FREE_MAIL)} AS free_mail", f"{one_of('tld', D.ABUSED_TLDS)} AS abused_tld",
        f"{one_of('registrable', D.SHORTENERS)} OR {one_of('host', D.SHORTENERS)} AS shortener",
        "IF(subdomain = '', 0, length(subdomain) - length(replace(subdomain, '.', '')) + 1) AS sub_levels",
        f"is_idn AND exists(split(unicode_host, {q(chr(92) + '.')}), x -> {script_count('x')} > 1) AS mixed_script",
        f"IF(is_idn, {latin_skeleton('_folded')}, NULL) AS idn_skeleton", f"{latin_skeleton('_ulabel')} AS _uskel",
        f"transform(filter(split(label, '[-_]'), t -> t <> ''), t -> named_struct('t', t, 's', "
        f"{substitute(latin_skeleton('t'))})) AS _tok", "split(subdomain, '[._-]') AS _subs")
    df = df.selectExpr("*", f"{substitute('_uskel')} AS _fskel")
    df = df.selectExpr("*", f"{best_match()} AS _best")
    return df.selectExpr(
        "host", "unicode_host", "registrable", "label", "subdomain", "sub_levels", "public_suffix", "tld", "is_ip",
        "is_idn", "mixed_script", "idn_skeleton", "brand", "free_mail", "abused_tld", "shortener",
        "CASE WHEN NOT is_ip AND label <> '' AND _best IS NOT NULL THEN named_struct('brand', _best.brand, 'keyword', "
        "_best.kw, 'technique', _best.technique, 'confidence', _best.confidence) END AS lookalike")


def best_match() -> str:
    """Strongest brand match of a prepared host row; the first brand in registry order wins ties."""
    c = D.LOOKALIKE_CONFIDENCE
    rows = ", ".join(f"named_struct('brand', {q(b)}, 'kw', {q(k)}, 'n', {len(k)}, 'first', {-i})"
                     for b, k, i in D.brand_keywords())
    near = "k.n >= 5 AND length(label) >= 5 AND abs(length(label) - k.n) <= IF(k.n >= 8, 2, 1)"
    edits = "IF(k.n >= 8, levenshtein(label, k.kw, 2), levenshtein(label, k.kw, 1))"
    many = "size(_tok) > 1"

    def hit(technique, confidence):
        return (f"named_struct('confidence', {c[confidence]}D, 'first', k.first, 'brand', k.brand, 'kw', k.kw, "
                f"'technique', '{technique}')")

    one = pick([
        (f"_ulabel RLIKE {q(NON_ASCII)} AND _uskel = k.kw", hit("homoglyph", "homoglyph")),
        ("label <> k.kw AND _fskel = k.kw", hit("character_substitution", "substitution")),
        (f"{near} AND {edits} = 1", hit("typosquat", "one_edit")),
        (f"{near} AND {edits} = 2", hit("typosquat", "two_edits")),
        (f"{many} AND k.n >= 5 AND exists(_tok, t -> t.t <> k.kw AND t.s = k.kw)",
         hit("character_substitution", "token_skeleton")),
        (f"{many} AND exists(_tok, t -> t.t = k.kw)", hit("brand_embedded", "token_equal")),
        ("array_contains(_subs, k.kw)", hit("brand_in_subdomain", "subdomain")),
        (f"{many} AND k.n >= 6 AND exists(_tok, t -> length(t.t) >= 6 AND t.s <> k.kw AND levenshtein(t.t, k.kw, 1) = 1)",
         hit("typosquat", "token_one_edit")),
        (f"NOT ({many}) AND k.n >= 5 AND length(label) > k.n + 2 AND contains(label, k.kw)",
         hit("brand_embedded", "contains")),
    ])
    return (f"array_max(filter(transform(filter(array({rows}), k -> NOT k.brand <=> brand), k -> {one}), "
            "m -> m IS NOT NULL))")
