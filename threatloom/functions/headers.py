"""Header expressions over array<struct<pos, name, value>>, so a message never leaves its row."""

from pyspark.sql import DataFrame

from .hosts import clean_host, is_ip, is_private_ip, registrable
from .sqltext import q

NAME = r"^[!-9;-~]+:"
NEWLINE = q(r"\r?\n")


def split_block(raw: str) -> str:
    """struct(header_block, body, valid) of a raw message; header-only input is valid."""
    parts = f"split({raw}, {q(chr(92) + 'r?' + chr(92) + 'n' + chr(92) + 'r?' + chr(92) + 'n')}, 2)"
    lines = f"split({raw}, {NEWLINE}, 3)"
    first = f"IF(startswith({lines}[0], 'From '), coalesce(try_element_at({lines}, 2), ''), {lines}[0])"
    return (f"struct({parts}[0] AS header_block, coalesce(try_element_at({parts}, 2), '') AS body, "
            f"{first} RLIKE {q(NAME)} AS valid)")


def header_array(block: str, limit: int | None = None) -> str:
    """Unfolded headers in order, duplicates kept."""
    mbox, fold = q(r"^From [^\n]*\n"), q(r"[ \t]*\r?\n[ \t]+")
    flat = f"regexp_replace(regexp_replace({block}, {mbox}, ''), {fold}, ' ')"
    out = (f"transform(filter(split({flat}, {NEWLINE}), x -> x RLIKE {q(NAME)}), (x, i) -> struct(i AS pos, "
           f"substring_index(x, ':', 1) AS name, trim(regexp_replace(x, {q('^[^:]*:[ ' + chr(92) + 't]*')}, '')) AS value))")
    return f"slice({out}, 1, {limit})" if limit else out


def values_of(headers: str, name: str) -> str:
    return f"transform(filter({headers}, h -> lower(h.name) = '{name.lower()}'), h -> h.value)"


def first_of(headers: str, name: str) -> str:
    return f"try_element_at({values_of(headers, name)}, 1)"


def domain_of(address: str) -> str:
    """After the last '@', lower case, without trailing '>' or blanks; '' without an '@'."""
    return (f"IF(contains({address}, '@'), regexp_replace(lower(substring_index({address}, '@', -1)), "
            f"{q('[>' + chr(92) + 's]+$')}, ''), '')")


def mailbox_address(value: str) -> str:
    return f"nullif(lower(trim(coalesce(nullif(regexp_extract({value}, '<([^<>]*)>', 1), ''), {value}))), '')"


def mailbox_name(value: str) -> str:
    quotes = q(r'^\s*"|"\s*$')
    return (f"IF({value} RLIKE '<[^<>]+>', trim(regexp_replace(trim(regexp_replace({value}, '<[^<>]*>.*$', '')), "
            f"{quotes}, '')), '')")


def return_path(value: str) -> str:
    return (f"nullif(lower(trim(IF({value} RLIKE '<[^>]*>', regexp_extract({value}, '<([^>]*)>', 1), {value}))), '')")


def parse_date(text: str) -> str:
    """Timestamp of an RFC 5322 date; week day and comments are ignored, garbage becomes null."""
    plain = (f"trim(regexp_replace(regexp_replace(regexp_replace({text}, {q(chr(92) + '([^)]*' + chr(92) + ')')}, ''), "
             f"{q('^' + chr(92) + 's*[A-Za-z]+,')}, ''), {q(chr(92) + 's+')}, ' '))")
    return f"try_to_timestamp(regexp_replace({plain}, ' (?:GMT|UTC|UT)$', ' +0000'), 'd MMM yyyy HH:mm:ss Z')"


_FROM = r"(?i)\bfrom\s+(.+?)(?:\s+by\s|\s+with\s|\s+id\s|\s+for\s|;|$)"
_IP = r"(?i)\[((?:[0-9]{1,3}\.){3}[0-9]{1,3}|[0-9a-f:]{3,})\]|\(((?:[0-9]{1,3}\.){3}[0-9]{1,3})\)"
BACKWARDS, NO_RDNS = "timestamp earlier than previous hop", "no reverse DNS for sending IP"
NO_TIME, LATE = "missing or unparseable timestamp", "delayed more than 24 hours"


def with_received_chain(df: DataFrame, values: str) -> DataFrame:
    """Add ``hops``: Received values in travel order with delay to the hop before and flags."""
    sender = f"nullif(trim(regexp_extract(v, {q(_FROM)}, 1)), '')"
    df = df.selectExpr("*", f"transform(reverse({values}), v -> struct(v AS v, {sender} AS sender, IF(contains(v, ';'), "
                            f"{parse_date(chr(115) + 'ubstring_index(v, ' + q(';') + ', -1)')}, NULL) AS ts)) AS _h1")
    ip = f"coalesce(nullif(regexp_extract(h.sender, {q(_IP)}, 1), ''), nullif(regexp_extract(h.sender, {q(_IP)}, 2), ''))"
    df = df.selectExpr("*", f"transform(_h1, (h, i) -> struct(h.v AS v, h.sender AS sender, h.ts AS ts, {ip} AS ip, "
                            "unix_timestamp(h.ts) - unix_timestamp(try_element_at(_h1, nullif(i, 0)).ts) AS delay)) AS _h2")
    unknown = f"h.sender RLIKE {q('(?i)' + chr(92) + 'bunknown' + chr(92) + 'b')} AND {is_ip('h.ip')} AND NOT {is_private_ip('h.ip')}"
    flags = (f"array_compact(array(IF({unknown}, '{NO_RDNS}', NULL), IF(h.ts IS NULL, '{NO_TIME}', NULL), "
             f"CASE WHEN h.delay < -300 THEN '{BACKWARDS}' WHEN h.delay > 86400 THEN '{LATE}' END))")
    word = r"\s+([^\s;()]+)"
    df = df.selectExpr("*", f"transform(_h2, (h, i) -> struct(i + 1 AS hop, h.sender AS sender, IF({is_ip('h.ip')}, h.ip, NULL) "
                            f"AS from_ip, nullif(regexp_extract(h.v, {q('(?i)' + chr(92) + 'bby' + word)}, 1), '') AS by, "
                            f"nullif(regexp_extract(h.v, {q('(?i)' + chr(92) + 'bwith' + word)}, 1), '') AS with, h.ts AS ts, "
                            f"h.delay AS delay_seconds, {flags} AS flags)) AS hops")
    return df.drop("_h1", "_h2")


METHODS = "spf|dkim|dmarc|arc|compauth|iprev|auth"


def auth_statements(header: str) -> str:
    """Method statements of one Authentication-Results value: comments gone, authserv-id gone."""
    plain = f"regexp_replace({header}, {q(chr(92) + '([^()]*' + chr(92) + ')')}, ' ')"
    has_method = q(r"\b(spf|dkim|dmarc)\s*=")
    return (f"IF(substring_index({plain}, ';', 1) RLIKE {has_method}, concat(';', {plain}), "
            f"regexp_replace({plain}, '^[^;]*', ''))")


def auth_result(st: str, method: str) -> str:
    return f"nullif(lower(regexp_extract({st}, {q(rf'(?i)[;\s]{method}=([^\s;]+)')}, 1)), '')"


def auth_property(st: str, method: str, name: str) -> str:
    """Property of the first statement of a method; the last value wins inside it."""
    tail = f"regexp_extract({st}, {q(rf'(?i)[;\s]{method}=[^\s;]+([^;]*)')}, 1)"
    own = f"regexp_replace({tail}, {q(rf'(?i)\s(?:{METHODS})=.*$')}, '')"
    value = f"regexp_extract({own}, {q(rf'(?i)^.*\s{name.replace(chr(46), chr(91) + chr(46) + chr(93))}=([^\s]+)')}, 1)"
    return f"nullif(lower(regexp_replace({value}, '[\";]', '')), '')"


def auth_state(result: str) -> str:
    return (f"CASE WHEN {result} IS NULL THEN 'not_present' WHEN {result} = 'pass' THEN 'pass' WHEN {result} IN "
            "('fail', 'softfail', 'hardfail', 'permerror') THEN 'fail' ELSE 'unknown' END")


def auth_summary(df: DataFrame, headers: str = "headers", from_domain: str = "from_domain") -> DataFrame:
    """Add spf_*, dkim_*, dmarc_* from the top-most Authentication-Results header only."""
    df = df.selectExpr("*", f"{values_of(headers, 'authentication-results')} AS _ar",
                       f"{first_of(headers, 'received-spf')} AS _rs",
                       f"size({values_of(headers, 'dkim-signature')}) > 0 AS dkim_signed",
                       f"{registrable(clean_host(from_domain))} AS _own")
    df = df.selectExpr("*", f"{auth_statements('try_element_at(_ar, 1)')} AS _st", "size(_ar) AS auth_headers")
    df = df.selectExpr("*", f"{auth_result('_st', 'spf')} AS _spf")
    df = df.selectExpr("*", "_spf IS NULL AND _rs IS NOT NULL AS _back")
    spf_domain = (f"IF(_back, nullif(regexp_extract(_rs, {q('(?i)envelope-from=<?([^>;' + chr(92) + 's]+)')}, 1), ''), coalesce("
                  f"{auth_property('_st', 'spf', 'smtp.mailfrom')}, {auth_property('_st', 'spf', 'smtp.helo')}))")
    df = df.selectExpr(
        "*", f"IF(_back, nullif(lower(regexp_extract(_rs, {q('^' + chr(92) + 's*([A-Za-z0-9_]+)')}, 1)), ''), _spf) AS spf_result",
        f"substring_index({spf_domain}, '@', -1) AS spf_domain", f"{auth_result('_st', 'dkim')} AS dkim_result",
        f"coalesce({auth_property('_st', 'dkim', 'header.d')}, substring_index({auth_property('_st', 'dkim', 'header.i')}, '@', -1)) AS dkim_domain",
        f"{auth_result('_st', 'dmarc')} AS dmarc_result",
        f"coalesce({auth_property('_st', 'dmarc', 'header.from')}, {from_domain}) AS dmarc_domain")

    def aligned(c):
        return f"CASE WHEN {c} <> '' AND {from_domain} <> '' THEN {registrable(clean_host(c))} = _own END AS {c.split('_')[0]}_aligned"

    return df.selectExpr(
        "*", f"{auth_state('spf_result')} AS spf_state",
        f"IF(dkim_result IS NULL AND dkim_signed, 'unknown', {auth_state('dkim_result')}) AS dkim_state",
        f"{auth_state('dmarc_result')} AS dmarc_state", aligned("spf_domain"), aligned("dkim_domain"),
        aligned("dmarc_domain")).drop("_ar", "_rs", "_st", "_own", "_spf", "_back")
