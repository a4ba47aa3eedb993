"""Expressions over page mark-up: tags, attributes, plain text, inline Markdown.

Every function takes and returns SQL text (see ``text.on``), since rendering
nests lambdas several levels deep.
"""

from __future__ import annotations

from scholarflow.functions.text import (
    escape_citation_sql, sql_bind, sql_text, strip_sql, unescape_sql,
)

# --- fixed values -----------------------------------------------------------
# Tokens of a whole page: comment, script, style, tag, text, stray '<'.
# What is left of a tag before its end: a > inside a quoted value is no end. A tag
# with an unclosed quote ends at the first >.
REST = r"""(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>)|[^>]*)"""
TOKEN_PATTERN = (
    r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
    rf"|</?[a-z!?]{REST}>|[^<]+|<"
)
# What carries no content; formula scripts stay.
NOISE_PATTERN = (
    r"(?is)<(?:!--.*?-->|style\b.*?</style>"
    r"|script\b(?![^>]*math/tex)[^>]*>.*?</script>)"
)
TAG_PATTERN = rf"(?is)</?[a-z!?]{REST}>"
INLINE_TAGS = ("inline-formula", "disp-formula", "a", "i", "b", "sub", "sup", "monospace")
# Tokens inside one paragraph: a closed inline element is one token.
INLINE_PATTERN = (
    "(?is)" + "|".join(rf"<{t}(?:\s{REST})?>.*?</{t}\s*>" for t in INLINE_TAGS)
    + rf"|</?[a-z!?]{REST}>|[^<]+|<"
)
LINK_PATTERN = rf"(?is)<a(?:\s{REST})?>.*?</a\s*>"
XREF_PATTERN = r"(?is)<a(?:\s[^>]*)?\sref-type\s*=[^>]*>.*?</a\s*>"
HEADING_PATTERN = rf"(?is)<h[1-6](?:\s{REST})?>.*?</h[1-6]\s*>"
BLOCK_TAGS = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6")
# Link kinds whose target is the anchor itself, besides fig, table and sec.
ANCHOR_KINDS = ("bibr", "fn", "disp-formula", "algorithm", "lemma", "theorem", "graphic")
FIGURE_KINDS = ("fig", "table")
# ----------------------------------------------------------------------------


def listed(values) -> str:
    return ", ".join(sql_text(v) for v in values)


def find_all(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, {sql_text(pattern)}, 0)"


def find(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({x}, {sql_text(pattern)}, {group})"


def clean(x: str) -> str:
    """Page without comments, styles and scripts other than formulas."""
    return f"regexp_replace({x}, {sql_text(NOISE_PATTERN)}, '')"


def _any_tag(tags) -> str:
    return rf"</?(?:{'|'.join(tags)})(?:\s{REST})?/?>"


def split_at(x: str, tags) -> str:
    """Cut before every opening and closing tag of the given names."""
    return f"split({x}, {sql_text(f'(?i)(?={_any_tag(tags)})')}, -1)"


def leading_tag(x: str, tags) -> str:
    """The tag a text starts with, if it is one of the names, else ''."""
    return find(x, f"(?i)^{_any_tag(tags)}")


def tag_name(x: str) -> str:
    return f"lower({find(x, '^</?([A-Za-z][A-Za-z0-9-]*)', 1)})"


def attribute(x: str, name: str, *, plain: bool = False) -> str:
    """Value of an attribute of the leading tag, or NULL when it is absent.

    ``plain`` values, such as class names, hold no character references.
    """
    raw = find(x, rf"(?is)^<[^>\"']*?(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*?)*?\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    value = "btrim(a_, '\"\\'')"
    return sql_bind(raw, "a_", f"if(a_ = '', null, {value if plain else unescape_sql(value)})")


def has_class(x: str, *names: str) -> str:
    return f"arrays_overlap(split(coalesce({x}, ''), '\\\\s+'), array({listed(names)}))"


def plain_text(x: str) -> str:
    """Text without its tags, references resolved."""
    return unescape_sql(f"regexp_replace({x}, {sql_text(TAG_PATTERN)}, '')")


def compact_text(x: str) -> str:
    """Every run of text stripped, and joined without a separator."""
    run = strip_sql(unescape_sql("r_"))
    return f"array_join(transform(split({x}, {sql_text(TAG_PATTERN)}, -1), r_ -> {run}), '')"


def first_element(x: str, tag: str, with_attribute: str = "") -> str:
    """Inner mark-up of the first ``tag`` element, or NULL when there is none."""
    extra = rf"[^>]*{with_attribute}" if with_attribute else ""
    pattern = rf"(?is)<{tag}(?=[\s>]){extra}[^>]*>(.*?)</{tag}\s*>"
    return f"if({x} rlike {sql_text(pattern)}, {find(x, pattern, 1)}, null)"


def inline_tokens(x: str) -> str:
    return find_all(x, INLINE_PATTERN)


def _element(targets: str, loose: str) -> str:
    """Markdown of the closed element ``t_`` named ``name_`` with text ``text_``."""
    script = find("t_", r"(?is)<script\b[^>]*math/tex[^>]*>(.*?)</script>", 1)
    span = plain_text(find(
        "t_", r"(?is)<span\b[^>]*class\s*=\s*[\"']tex tex2jax_ignore[\"'][^>]*>(.*?)</span>", 1
    ))
    display = sql_bind(
        span, "s_",
        f"if(s_ = '', '', concat('\n\n$$\n', if({loose}, s_, replace(s_, '\n', '')), '\n$$\n\n'))",
    )
    key = (
        f"case when k_ in ({listed(FIGURE_KINDS)}) then coalesce({targets}['fig:' || h_], 'none') "
        f"when k_ = 'sec' then coalesce({targets}['sec:' || h_], '#none') else coalesce(h_, '') end"
    )
    shown = f"if(k_ = 'bibr', {escape_citation_sql('text_')}, text_)"
    kinds = listed((*ANCHOR_KINDS, *FIGURE_KINDS, "sec"))
    target = sql_bind(attribute("t_", "anchor"), "h_", f"concat('[', {shown}, '](', {key}, ')')")
    link = sql_bind(
        attribute("t_", "ref-type", plain=True), "k_",
        f"if(coalesce(k_ in ({kinds}), false), {target}, text_)",
    )
    return (
        "case when name_ = 'i' then concat('*', text_, '*') "
        f"when name_ = 'inline-formula' then concat('$', replace({script}, '\n', ''), '$') "
        f"when name_ = 'disp-formula' then {display} "
        f"when {loose} then text_ "
        f"when name_ = 'a' then {link} "
        "when name_ = 'b' then concat('**', text_, '**') "
        "when name_ = 'monospace' then concat('`', text_, '`') "
        "else concat('<', name_, '>', text_, '</', name_, '>') end"
    )


def render(x: str, targets: str, loose: str) -> str:
    """Markdown of the inline mark-up ``x``.

    ``targets`` maps 'fig:<anchor>' and 'sec:<anchor>' to link targets. Where
    ``loose`` holds, the mark-up stands in a section outside any paragraph:
    only italics and formulas keep their mark-up and blank text is dropped.
    """
    element = sql_bind(tag_name("t_"), "name_", _element(targets, loose))
    # a tag on its own is closing, void, or opens an element that never closes
    token = sql_bind(
        plain_text("t_"), "text_",
        "case when not startswith(t_, '<') or t_ = '<' "
        f"then if({loose} and {strip_sql('text_')} = '', '', text_) "
        f"when startswith(t_, '</') or not contains(t_, '</') then '' else {element} end",
    )
    return f"array_join(transform({inline_tokens(x)}, t_ -> {token}), '')"


def render_piece(body: str, slot: str, targets: str) -> str:
    """Markdown of the mark-up that follows a container tag.

    ``slot`` tells the list the piece stands in (``list_tag``) and whether its
    tag ends that list (``ends_list``). The piece is cut into blocks at its
    paragraph, item and heading tags.
    """
    block = sql_bind(
        leading_tag("b_", BLOCK_TAGS), "lead_",
        f"struct(if(startswith(lead_, '</'), '', {tag_name('lead_')}) as tag, "
        "substr(b_, length(lead_) + 1) as text)",
    )
    blocks = f"transform({split_at('y_', BLOCK_TAGS)}, b_ -> {block})"
    # an item shows its first child only: a text, an element, or a paragraph
    mode = (
        f"case when {slot}.list_tag is null then case p_.tag when 'p' then 'p' when '' then 'loose' "
        "when 'li' then 'loose' else '' end "
        "when p_.tag = 'li' and p_.text <> '' then 'item' "
        "when p_.tag = 'li' and not coalesce(try_element_at(ps_, i_ + 2).tag = 'p', false) then 'empty' "
        "when p_.tag = 'p' and i_ > 0 and ps_[greatest(i_ - 1, 0)].tag = 'li' "
        "and ps_[greatest(i_ - 1, 0)].text = '' then 'item p' else '' end"
    )
    first = plain_text(f"try_element_at({inline_tokens('p_.text')}, 1)")
    inline = render("p_.text", targets, "(m_ = 'loose')")
    text = f"if(m_ = 'item', {first}, {inline})"
    marker = f"if({slot}.list_tag = 'ol', '1. ', '- ')"
    line = sql_bind(
        text, "o_",
        f"case m_ when 'p' then concat(o_, '\n\n') when 'loose' then o_ "
        f"else concat({marker}, o_, '\n') end",
    )
    written = sql_bind(mode, "m_", f"if(m_ = '', '', {line})")
    joined = sql_bind(blocks, "ps_", f"array_join(transform(ps_, (p_, i_) -> {written}), '')")
    # most pieces hold no mark-up: one text outside any paragraph
    bare = sql_bind(unescape_sql("y_"), "z_", f"if({strip_sql('z_')} = '', '', z_)")
    either = f"case when contains(y_, '<') then {joined} when {slot}.list_tag is null then {bare} else '' end"
    return f"concat(if({slot}.ends_list, '\n\n', ''), {sql_bind(body, 'y_', either)})"
