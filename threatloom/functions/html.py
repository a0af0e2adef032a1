"""HTML structure by pattern, as SQL expressions: links, forms, images, concealed text, active content."""

from pyspark.sql import functions as F

from .. import dimensions as D
from .sqltext import q

ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
UNSEEN = [rf"(?is)<{tag}\b.*?</{tag}>" for tag in ("head", "script", "style")]
STYLE = D.HIDDEN_STYLE.removeprefix("(?i)")
#: An element that its opening tag conceals, up to the first end tag of its name.
CONCEALED = (rf"""(?is)<([a-z][a-z0-9]*)(?=\s)(?:[^>]*\sstyle\s*=\s*(?:"[^">]*(?:{STYLE})|'[^'>]*(?:{STYLE}))|[^>]*\shidden(?=[\s=/>])"""
             r"""|[^>]*\saria-hidden\s*=\s*["']?true)[^>]*>(.*?)</\1\s*>""")


def tags(html: str, name: str) -> str:
    """array<string> of the opening tags of one name."""
    return f"regexp_extract_all(coalesce({html}, ''), {q(rf'(?is)<{name}(?=[\s/>])[^>]*>')}, 0)"


def attribute(tag: str, name: str) -> str:
    """Value of an attribute in an opening tag, quoted or bare; empty if it has none."""
    p = q(rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
    return "trim(concat(" + ", ".join(f"regexp_extract({tag}, {p}, {g})" for g in (1, 2, 3)) + "))"


def plain(markup: str) -> str:
    """Text of markup: tags and runs of white space become single spaces."""
    tag, space = q(r"<[^>]*>"), q(r"\s+")
    return f"trim(regexp_replace(regexp_replace({markup}, {tag}, ' '), {space}, ' '))"


def count_of(html: str, name: str) -> str:
    return f"size({tags(html, name)})"


def anchor_array(html: str) -> str:
    """array<struct<href, text>>, in order."""
    a = q(ANCHOR)
    return (f"transform(regexp_extract_all(coalesce({html}, ''), {a}, 0), x -> struct(trim(regexp_extract(x, {a}, 1)) AS href, "
            f"{plain(f'regexp_extract(x, {a}, 2)')} AS text))")


def form_array(html: str) -> str:
    """array<struct<action, method, password, inputs>>; a form that is never closed reaches to the end."""
    forms = f"regexp_extract_all(coalesce({html}, ''), {q(r'(?is)<form(?=[\s/>])[^>]*>.*?(?:</form\s*>|$)')}, 0)"
    head, field = "regexp_extract(x, '(?is)^<form[^>]*>', 0)", tags("x", "input")
    secret = f"exists({field}, i -> lower({attribute('i', 'type')}) = 'password')"
    names = f"filter(transform({field}, i -> {attribute('i', 'name')}), n -> n <> '')"
    return (f"transform({forms}, x -> struct({attribute(head, 'action')} AS action, "
            f"coalesce(nullif(lower({attribute(head, 'method')}), ''), 'get') AS method, {secret} AS password, {names} AS inputs))")


def concealed_texts(html: str) -> str:
    """array<string> of the texts of concealed elements, longer than two characters."""
    p = q(CONCEALED)
    return (f"filter(transform(regexp_extract_all(coalesce({html}, ''), {p}, 0), x -> {plain(f'regexp_extract(x, {p}, 2)')}), "
            "t -> length(t) > 2)")


def visible_text(html: str) -> str:
    for p in UNSEEN:
        html = f"regexp_replace({html}, {q(p)}, ' ')"
    return plain(html)


def inspect_html(html: str):
    """Struct column of everything above."""
    images = f"filter(transform({tags(html, 'img')}, i -> {attribute('i', 'src')}), s -> s <> '')"
    refresh = (f"transform(filter({tags(html, 'meta')}, m -> contains(lower({attribute('m', 'http-equiv')}), 'refresh')), "
               f"m -> {attribute('m', 'content')})")
    return F.expr(f"""struct({anchor_array(html)} AS anchors, {form_array(html)} AS forms, {images} AS images, {concealed_texts(html)} AS hidden,
        {count_of(html, 'script')} AS scripts, {count_of(html, 'iframe')} AS iframes, try_element_at({refresh}, 1) AS refresh,
        coalesce({visible_text(html)}, '') AS visible)""")
