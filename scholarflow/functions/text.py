"""Scalar text functions, all built from native Spark expressions.

Every function takes and returns a Column, so it fuses into the surrounding
projection and needs neither a shuffle nor a Python worker.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# The characters that Python's str.strip() and \s treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set, and the word characters of Python's \w, as regex class bodies
# that mean the same thing in Java and in RE2.
SPACE_CLASS = r"\t\n\x0b\x0c\r\x1c-\x1f\x85\p{Z}"
WORD_CLASS = r"\p{L}\p{N}_"
# One token is a run of word characters or one other visible character.
TOKEN_PATTERN = rf"[{WORD_CLASS}]+|[^{WORD_CLASS}{SPACE_CLASS}]"
# Url rules: (source, text the url holds, pattern whose group 1 is the id).
URL_RULES = (
    ("IEEE", "ieee.org", r"/document/(\p{Nd}+)"),
    ("ACM", "dl.acm.org", r"/doi/(10\.\p{Nd}{4,}/[^\n]+)"),
)
DOI_PREFIX = "https://doi.org/"
DOCUMENT_PREFIX = "/document/"
UNKNOWN = "Unknown"
# ----------------------------------------------------------------------------


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_bind(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it as ``name`` in ``body``.

    ``element_at`` keeps the type of what it reads; ``[0]`` would derive it anew for every
    value, through all bindings in ``body``.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def on(c: Column | str, build) -> Column:
    """Column of the SQL text ``build(x)``, where x stands for ``c``.

    Deeply nested lambdas are written as SQL text: one parse in the JVM takes
    the place of a round trip per function call.
    """
    if isinstance(c, str):
        return F.expr(build(f"`{c}`"))
    bound = F.call_function("transform", F.array(c), F.expr(f"x_ -> {build('x_')}"))
    return F.element_at(bound, 1)


def strip_sql(x: str) -> str:
    return f"btrim({x}, {sql_text(WHITESPACE)})"


def strip(c: Column | str) -> Column:
    """Remove Unicode white space from both ends."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def clean_abstract(c: Column | str) -> Column:
    """Drop white space between a LaTeX command and the closing dollar sign."""
    return F.regexp_replace(col(c), rf"(\\[^{SPACE_CLASS}]+)[{SPACE_CLASS}]+\$", r"$1\$")


def heading_slug(c: Column | str) -> Column:
    """In-document link of a heading: '#' + lower-case words, blanks as %20."""
    kept = F.regexp_replace(col(c), rf"[^{WORD_CLASS}{SPACE_CLASS}-]", "")
    return F.concat(F.lit("#"), F.replace(F.lower(kept), F.lit(" "), F.lit("%20")))


def contains_ignore_case(haystack: Column | str, needle: Column | str) -> Column:
    return F.contains(F.lower(col(haystack)), F.lower(col(needle)))


def capture(c: Column | str, pattern: str, default: str | None = None) -> Column:
    """Group 1 of the first match, or ``default``."""
    hit = F.regexp_extract(col(c), pattern, 1)
    return F.coalesce(blank_to_null(hit), F.lit(default).cast("string"))


def classify_url(c: Column | str, rules=URL_RULES) -> Column:
    """Struct (source, document_id); the first rule whose text occurs decides."""
    url = col(c)
    source, document = F.lit("Other"), F.lit(UNKNOWN)
    for name, marker, pattern in reversed(rules):
        hit = F.contains(url, F.lit(marker))
        source = F.when(hit, F.lit(name)).otherwise(source)
        document = F.when(hit, capture(url, pattern, UNKNOWN)).otherwise(document)
    return F.when(
        url.isNotNull(), F.struct(source.alias("source"), document.alias("document_id"))
    )


def drop_extension(c: Column | str) -> Column:
    """File name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(col(c), r"(?<=[^.])\.[^.]*$", "")


def without(c: Column | str, *literals: str) -> Column:
    """Remove every occurrence of each literal."""
    out = col(c)
    for text in literals:
        out = F.replace(out, F.lit(text), F.lit(""))
    return out


def escape_citation_sql(x: str) -> str:
    opened = f"if(startswith({x}, '['), replace({x}, '[', '\\\\['), {x})"
    return f"if(endswith({x}, ']'), replace({opened}, ']', '\\\\]'), {opened})"


def escape_citation(c: Column | str) -> Column:
    """Escape the brackets of a citation mark such as [12].

    ``[`` is escaped when the text starts with it, ``]`` when the text ends
    with it.
    """
    return on(c, escape_citation_sql)


def hashes(level: Column | str) -> Column:
    return F.repeat(F.lit("#"), col(level))


def image_url(href: Column, site: str = "https://ieeexplore.ieee.org/") -> Column:
    return F.concat(F.lit(site), href)


# HTML reads the numbers 128 to 159 as this code page does, where it has a character
_WESTERN = "".join(
    c if (c := bytes([n]).decode("cp1252", "ignore")) else chr(n) for n in range(128, 160)
)


def unescape_sql(x: str, entities: dict[str, int] | None = None) -> str:
    if entities is None:
        table = {k: v for k, v in html.entities.html5.items() if k.endswith(";")}
    else:
        table = {f"{k};": chr(v) for k, v in entities.items()}
    # one foldable call; as a map constructor it would carry thousands of literals
    pairs = "\x01".join(f"&{k}\x02{v}" for k, v in table.items())
    # most references are one of a few; a map is searched from end to end
    common = " ".join(
        f"when {sql_text('&' + k)} then {sql_text(table[k])}"
        for k in ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;") if k in table
    )
    named = f"coalesce(str_to_map({sql_text(pairs)}, '\x01', '\x02')[e_], e_)"
    named = f"case e_ {common} else {named} end" if common else named
    # digits after leading zeros; more of them than any character has are out of range
    decimal = r"nullif(regexp_extract(e_, '^&#0*([0-9]+);$', 1), '')"
    hexa = r"nullif(regexp_extract(e_, '^&#[xX]0*([0-9a-fA-F]+);$', 1), '')"
    number = (
        f"coalesce(if(length({decimal}) > 7, 1114112, cast({decimal} as bigint)),"
        f" if(length({hexa}) > 6, 1114112, cast(conv({hexa}, 16, 10) as bigint)))"
    )
    legal = "n_ between 1 and 1114111 and n_ not between 55296 and 57343"
    western = f"if(n_ between 128 and 159, substr({sql_text(_WESTERN)}, int(n_ - 127), 1), {{}})"
    character = western.format("decode(unhex(lpad(hex(n_), 8, '0')), 'UTF-32')")
    numeric = sql_bind(number, "n_", f"case when n_ is null then e_ when {legal} then {character} else '\ufffd' end")
    resolved = (
        "case when not startswith(e_, '&') then e_ "
        f"when startswith(e_, '&#') then {numeric} else {named} end"
    )
    pieces = "regexp_extract_all(u_, '&#?[0-9A-Za-z]+;|[^&]+|&', 0)"
    return sql_bind(
        x, "u_",
        f"if(contains(u_, '&'), array_join(transform({pieces}, e_ -> {resolved}), ''), u_)",
    )


def unescape_html(c: Column | str, entities: dict[str, int] | None = None) -> Column:
    """Resolve named and numeric character references in one pass.

    ``entities`` maps names to code points; the default is the standard
    library's HTML 5 table. Unknown names stay as they are.
    """
    return on(c, lambda x: unescape_sql(x, entities))


def escape_html(c: Column | str) -> Column:
    out = F.replace(col(c), F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


# --- Markdown splitting -------------------------------------------------------


def front_matter(c: Column | str) -> Column:
    """Struct (header, body): the text through the second '---' and the rest.

    Text that does not start with '---', or never closes it, has the header ''
    and is its own body.
    """
    text = col(c)
    second = F.locate("---", text, 4)
    found = F.startswith(text, F.lit("---")) & (second > 0)
    return F.struct(
        F.when(found, strip(F.substr(text, F.lit(1), second + 2))).otherwise("").alias("header"),
        F.when(found, strip(F.substr(text, second + 3))).otherwise(text).alias("body"),
    )


def chapters(c: Column | str) -> Column:
    """Split before every line that starts with '## '; strip, drop blank ones."""
    pieces = F.transform(F.split(col(c), r"(?md)(?=^## )", -1), strip)
    return F.filter(pieces, lambda x: x != "")


def count_tokens_sql(x: str, pattern: str = TOKEN_PATTERN) -> str:
    return f"regexp_count({x}, {sql_text(pattern)})"


def count_tokens(c: Column | str, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def part_count_sql(tokens: str, threshold: int) -> str:
    return f"cast(if({tokens} > {threshold}, {tokens} div {threshold} + 1, 1) as int)"


def part_count(tokens: Column | str, threshold: int = 2000) -> Column:
    """One part up to the threshold, beyond it the whole quotient plus one."""
    n = col(tokens)
    return F.when(n > threshold, F.floor(n / threshold).cast("int") + 1).otherwise(1)


def split_parts_sql(x: str, n: str, delimiter: str = "\n\n", pattern: str | None = None) -> str:
    """SQL of ``split_parts``; ``n`` may refer to the text as ``t_``."""
    if pattern is None:
        d, back = len(delimiter), f"instr(reverse(v_), {sql_text(delimiter[::-1])})"
        cut = sql_bind(back, "k_", f"if(k_ > 0, length(v_) - k_ - {d - 1}, length(v_))")
    else:
        found = f"regexp_extract_all(v_, {sql_text(pattern)}, 0)"
        tail = f"element_at(split(v_, {sql_text(pattern)}, -1), -1)"
        cut = sql_bind(found, "k_", (
            f"if(size(k_) > 0, length(v_) - length({tail}) - length(element_at(k_, -1)), length(v_))"
        ))
    at = sql_bind("substr(s_.rest, 1, w_)", "v_", cut)
    step = sql_bind(at, "c_", (
        "struct(substr(s_.rest, c_ + 1) as rest, "
        "array_append(s_.parts, substr(s_.rest, 1, c_)) as parts)"
    ))
    folded = (
        "aggregate(sequence(1, n_), struct(t_ as rest, cast(array() as array<string>) as parts), "
        "(s_, i_) -> if(i_ = n_, struct('' as rest, array_append(s_.parts, s_.rest) as parts), "
        f"{step}), s_ -> s_.parts)"
    )
    # a text that stays whole skips the fold
    sized = f"if(n_ = 1, array(t_), {sql_bind('cast(length(t_) div n_ as int)', 'w_', folded)})"
    return sql_bind(x, "t_", sql_bind(n, "n_", sized))


def split_parts(
    c: str, n: str, delimiter: str = "\n\n", *, pattern: str | None = None
) -> Column:
    """Cut a text into ``n`` parts of about equal length, losing no character.

    Each part ends at the last delimiter inside its window of ``len // n``
    characters, or at the window's end when there is none; the last part takes
    the rest. With ``pattern`` (a regex that never matches the empty string)
    the last of the non-overlapping matches counts, else the last occurrence
    of the literal ``delimiter``. The delimiter opens the next part. ``c`` and
    ``n`` are column names or SQL.
    """
    return F.expr(split_parts_sql(c, n, delimiter, pattern))
