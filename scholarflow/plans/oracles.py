"""The same results in plain SQL on the given tables, one per registered query.

They start from the base columns, not from the derived pages or payloads, so
they check the parsing and not only the parser against itself.
"""

from __future__ import annotations

from scholarflow.plans.inputs import JOURNALS, WEB_PAGE


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NL = "chr(10)"
WS = _q(
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACES, WORDS = r"\t\n\x0b\x0c\r\x1c-\x1f\x85\p{Z}", r"\p{L}\p{N}_"
HTML_TOKEN = (
    r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
    r"""|</?[a-z!?](?:[^>"']|"[^"]*"|'[^']*')*>|</?[a-z!?][^>]*>|[^<]+|<"""
)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def slug(x: str) -> str:
    return f"'#' || replace(lower(regexp_replace({x}, '[^{WORDS}{SPACES}-]', '', 'g')), ' ', '%20')"


def clean(x: str) -> str:
    return rf"regexp_replace({x}, '(\\[^{SPACES}]+)[{SPACES}]+\$', '\1$', 'g')"


def unescape(x: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"replace({x}, '&{name};', {_q(char)})"
    return x


def text_of(x: str) -> str:
    return unescape(f"regexp_replace({x}, '<[^>]*>', '', 'g')")


def capture(x: str, pattern: str) -> str:
    return f"nullif(regexp_extract({x}, {_q(pattern)}, 1), '')"


# --- shared parts -------------------------------------------------------------

LINES = f"""lines as (
  select doc_id, lang, source, n_chars, len(l) as n, generate_subscripts(l, 1) - 1 as i, unnest(l) as x
  from (select *, string_split(text, {NL}) as l from documents))"""

HEADER = f"'---' || {NL} || 'lang: ' || lang || {NL} || 'source: ' || source || {NL} || '---'"
BODY = strip(f"'# ' || source || {NL} || {NL} || replace(text, {NL}, {NL} || {NL} || '## ')")


def chapter_list(body: str) -> str:
    cut = f"string_split(regexp_replace({body}, '(?m)^## ', chr(1) || '## ', 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda c: {strip('c')}), lambda c: c <> '')"


CHAPTERS = f"""chapters as (
  select doc_id, generate_subscripts(l, 1) as chapter_no, unnest(l) as t
  from (select doc_id, {chapter_list(BODY)} as l from documents))"""


def tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[{WORDS}]+|[^{WORDS}{SPACES}]'))"


def parts(source: str, keys: str, threshold: int, delimiter: str) -> str:
    """Recursive cut of ``t`` of a relation into parts: relation ``parts``
    (keys, n, part_no, p)."""
    d, back = len(delimiter), _q(delimiter[::-1])
    delim = f"replace({_q(delimiter)}, '', '')" if "\n" not in delimiter else NL
    back = back if "\n" not in delimiter else NL
    window = "substr(t, st + length(p) + 1, pl)"
    return f"""sized as (
  select {keys}, t, n, length(t) // n as pl from (
    select *, case when k > {threshold} then k // {threshold} + 1 else 1 end as n
    from (select *, {tokens('t')} as k from {source}))),
steps as (
  select {keys}, t, n, pl, 0 as i, 0 as st, '' as p from sized
  union all
  select {keys}, t, n, pl, i + 1, st + length(p),
    case when i + 1 = n then substr(t, st + length(p) + 1)
         when contains({window}, {delim}) then substr(t, st + length(p) + 1,
           length({window}) - strpos(reverse({window}), {back}) - {d - 1})
         else {window} end
  from steps where i < n),
parts as (select {keys}, n, i as part_no, p from steps where i >= 1)"""


ROUNDTRIP = f"""with recursive {CHAPTERS},
{parts('chapters', 'doc_id, chapter_no', 60, '. ')},
joined as (
  select doc_id, chapter_no, count(*) as np, string_agg(lower(p), {NL} || {NL} order by part_no) as o
  from parts group by doc_id, chapter_no),
result as (
  select d.doc_id, cast(coalesce(sum(np), 0) as bigint) as n_chunks,
    max({HEADER}) || {NL} || {NL} ||
    coalesce(string_agg({NL} || {NL} || o, '' order by chapter_no), '') as markdown
  from documents d left join joined j on d.doc_id = j.doc_id group by d.doc_id)"""

JOURNAL_ROWS = "journals as (select * from (values " + ", ".join(
    f"({_q(j)}, {_q(s)}, {i})" for i, (j, s) in enumerate(JOURNALS)
) + ") as v(journal, name_short, ordinal)), names as (select journal, arg_max(name_short, ordinal) as name_short, min(ordinal) as ordinal from journals group by journal)"


def venue(table: str) -> str:
    return f"""select v.venue, arg_min(name_short, ordinal) as venue_short
  from (select distinct venue from {table}) v join names on contains(lower(v.venue), lower(journal))
  group by v.venue"""


URL = r"""regexp_replace(regexp_replace(url, '://[^/]*\.org/[a-z]+/', '://ieeexplore.ieee.org/document/', 'g'),
  '://[^/]*\.net/[a-z]+/', '://dl.acm.org/doi/10.1145/', 'g')"""
PLACES = rf"""places as (
  select page_id, case when contains(u, 'ieee.org') then 'IEEE' when contains(u, 'dl.acm.org') then 'ACM' else 'Other' end as source,
    case when contains(u, 'ieee.org') then {capture('u', '/document/([0-9]+)')}
         when contains(u, 'dl.acm.org') then {capture('u', '/doi/(10[.][0-9][0-9][0-9][0-9]+/.+)')} end as document_id
  from (select page_id, {URL} as u from pages))"""

PAPERS = rf"""{JOURNAL_ROWS}, {PLACES},
base as (
  select 'S' || doc_id as semantic_id, case when lang <> 'es' then string_split(text, {NL})[1] end as title,
    '2019-06-03' as date, source || ';' || lang as authors,
    cast(len(string_split(text, {NL})) + 1900 as int) as year, source || ' Bolt Letters of ' || lang as venue,
    {clean(r"'$\alpha  $ ' || text")} as abstract, n_chars as citation_count, doc_id
  from documents),
short as ({venue('base')}),
papers as (
  select b.*, venue_short, semantic_id as id_semantic,
    case when p.source = 'IEEE' then document_id end as id_ieee,
    case when p.source = 'ACM' then document_id end as id_acm,
    '10.5555/p' || doc_id as id_doi, cast(doc_id as varchar) as id_corpusid
  from base b left join short s on b.venue = s.venue left join places p on p.page_id = b.doc_id)"""

URL_PAPERS = rf"""url_papers as (
  select cast(page_id as varchar) as sid, {capture('url', '/([0-9]+)')} as ieee,
    {capture('url', r'://([^/]*[.]org)/')} as org from pages)"""

CASCADE = """local as (select cast(doc_id as varchar) as k, 'S' || doc_id as local from labels),
fetched as (
  select cast(doc_id as varchar) as k, 'A' || doc_id as fetched from documents d
  where lang <> 'es' and not exists (select 1 from labels l where l.doc_id = d.doc_id))"""
DOI_FOUND = f"""with {CASCADE},
asked as (select event_id, json_extract_string(props, '$.k') as k from events),
found as (
  select event_id, '10.5555/d' || a.k as doi, coalesce(local, fetched) as semantic_id,
    local is null and fetched is not null as is_new
  from asked a left join local using (k) left join fetched using (k))"""

# --- publisher pages ------------------------------------------------------------


def sections_of(sid: str, rows: str = "lines") -> str:
    """Relations ``titled`` and ``sections`` (page_id, ordinal, ..) of the pages, from lines (and their ``sid``)."""
    path = f"'../img/' || {sid} || '_img/ieee_' || doc_id || '_fig' || i || '.gif'"
    nxt = f"coalesce({slug('next_title')}, '#none')"
    main = (
        f"x || ' See [next](' || {nxt} || '), [Fig. ' || i || '](' || {path} || ') and [\\[' || i || "
        f"'\\]](ref' || i || ').' || {NL} || {NL} || {NL} || '![Fig' || i || '](' || {path} || ')' || {NL} || {NL} || "
        f"'**Fig. ' || i || '.** Line' || i || 'of ' || n || {NL} || {NL}"
    )
    notes = (
        f"'Length $n_' || i || '<' || length(x) || '$, *' || lang || '* **' || source || '**.' || {NL} || {NL} || "
        f"'unclosed' || {NL} || {NL} || '- chars ' || length(x) || {NL} || '- words <sub>' || i || '</sub>' || {NL} || {NL} || {NL}"
    )
    return f"""{LINES},
titled as (
  select *, lead(title) over (partition by doc_id order by i) as next_title from (
    select *, source || ' – ' || lang || ' (' || (i + 1) || ')' as title from {rows})),
sections as (
  select doc_id as page_id, cast(2 * i as int) as ordinal, cast(null as int) as parent_ordinal, 2 as level, title,
    {main} as content, 'sec' || i as section_id from titled
  union all
  select doc_id, cast(2 * i + 1 as int), cast(2 * i as int), 3, 'Notes ' || (i + 1), {notes}, 'sec' || i || 'a' from titled)"""


MARKDOWN = f"string_agg(repeat('#', level) || ' ' || title || {NL} || {NL} || content || {NL} || {NL}, '' order by ordinal)"
OWN_SECTIONS = sections_of("'S' || doc_id")

RICH_KINDS = ("bibr", "fn", "disp-formula", "algorithm", "lemma", "theorem", "graphic", "fig", "table", "sec", "odd")
RICH_LINKS = f"""{LINES},
each as (select doc_id, i, n, x, k, kind, '../img/S' || doc_id || '_img/ieee_' || doc_id || '_table' || i || '.gif' as path
  from lines, (select generate_subscripts(l, 1) as k, unnest(l) as kind from (select [{', '.join(map(_q, RICH_KINDS))}] as l))),
linked as (select doc_id, i, n, x, path, string_agg(' ' || case kind when 'odd' then 'odd ' || i else
    '[' || kind || ' ' || i || '](' || case kind when 'fig' then 'none' when 'table' then path
      when 'sec' then case when i + 1 < n then '#part%20' || (i + 2) else '#none' end else kind || i end || ')' end, '' order by k) as links
  from each group by doc_id, i, n, x, path)"""

KNOWN = f"""{CASCADE},
resolved as (
  select d.doc_id, coalesce(local, fetched) as sid from documents d
  left join local l on l.k = cast(d.doc_id as varchar) left join fetched f on f.k = cast(d.doc_id as varchar)
  where coalesce(local, fetched) is not null)"""

KNOWN_SECTIONS = sections_of("sid", "lines join resolved using (doc_id)")

# --- web pages --------------------------------------------------------------------

_nav = "regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<a[^>]*>(.*?)</a>', 1)"
_article = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
_loose = lambda x: f"case when {strip(text_of(x))} = '' then '' else {text_of(x)} end"
_paragraph = f"{text_of('p')} || {NL} || {NL}"
WEB = f"""web as (
  select page_id, ordinal, case when ordinal = 2 then 1 end as level,
    case when ordinal = 2 then {strip(text_of("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} else '' end as title,
    '' as section_id, cast(null as int) as parent_ordinal,
    case ordinal
      when 0 then array_to_string(list_transform({_nav}, lambda a: '- ' || {text_of('a')} || {NL}), '') || {NL} || {NL}
      when 1 then {_loose("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")}
      when 2 then array_to_string(list_transform(string_split({_article}, '<p>')[2:], lambda p: {_paragraph}), '')
      else {_loose("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")} end as content
  from pages, (values (0), (1), (2), (3)) as o(ordinal))"""

_known_tags = sorted(
    {*WEB_PAGE.cut_tags, "p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "inline-formula", "disp-formula", "a", "i", "b", "sub", "sup", "monospace", "img", "script", "style", "span"}
)
_web_tokens = f"select page_id, unnest(regexp_extract_all(html, {_q(HTML_TOKEN)})) as token from pages"

ORACLES: dict[str, str] = {
    "strip_unicode": f"select doc_id, {strip('text')} as stripped from documents",
    "clean_abstract": rf"select doc_id, {clean(rf'''replace(text, '. ', ' $\beta' || chr(9) || ' $ ')''')} as abstract from documents",
    "heading_slug": f"select doc_id, {slug('text')} as slug from documents",
    "escape_citation": r"select doc_id, case when lang = 'en' then '\[' || source || '\]' else source || '[\]' end as mark from documents",
    "front_matter": f"select doc_id, {HEADER} as header, {BODY} as body from documents",
    "unescape_text": f"select page_id, {unescape('html')} as html from pages",
    "normalise_papers": f"""with {PAPERS} select semantic_id, title, date, authors, year, venue, venue_short,
  abstract, citation_count, id_semantic, id_ieee, id_acm, id_doi, id_corpusid from papers""",
    "papers_display": f"""with {PAPERS} select semantic_id, coalesce(title, 'Unknown Title') as title, date,
  case when year = 1901 then 'Unknown Year' else cast(year as varchar) end as year,
  coalesce(venue, 'Unknown Venue') as venue, coalesce(venue_short, 'Unknown Venue') as venue_short,
  coalesce(abstract, 'No abstract available.') as abstract, cast(citation_count as varchar) as citation_count from papers""",
    "override_ids": """select doc_id, cast(doc_id as varchar) as semantic,
  case when lang <> 'en' then lang else source end as ieee_id, case when lang = 'fr' then source end as acm_id from documents""",
    "venue_short": f"""with {JOURNAL_ROWS},
part_venues as (select p_partkey, p_name || ' Letters of ' || lower(p_type) as venue from part),
short as ({venue('part_venues')})
select p_partkey, p.venue, venue_short from part_venues p left join short s on p.venue = s.venue""",
    "missing_ids": """select cast(doc_id as varchar) as id from documents d
where not exists (select 1 from labels l where l.doc_id = d.doc_id)""",
    "missing_edges_bag": """select o_orderkey as paper_id, o_custkey from orders
where not exists (select 1 from lineitem where l_orderkey = o_orderkey)""",
    "all_edges_bag": "select o_orderkey as paper_id, o_custkey from orders",
    "pending_download": f"""with {URL_PAPERS} select sid as semantic_id, org as document_id from url_papers
where org is not null and not exists (select 1 from labels where cast(doc_id as varchar) = sid)""",
    "latest_wins": """select user_id, event_id, event_type from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1""",
    "papers_upsert": """select d.doc_id, coalesce('q' || quality, source) as value
from documents d left join labels l on d.doc_id = l.doc_id""",
    "bucket_upsert": """select d.doc_id, coalesce('q' || quality, source) as value
from documents d left join labels l on d.doc_id = l.doc_id""",
    "latest_ingested": """select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type
from events group by user_id""",
    "fetch_log": f"""with {LINES}, asked as (select doc_id from documents semi join labels using (doc_id))
select cast(doc_id as varchar) as paper_id,
  cast(max(case when n > 1 and lang <> 'de' then n else 0 end) as int) as n_edges
from lines semi join asked using (doc_id) group by doc_id
union all select cast(doc_id as varchar), null from documents anti join asked using (doc_id)""",
    "id_batches": """select user_id, event_id,
  cast((row_number() over (partition by user_id order by event_id) - 1) // 25 as bigint) as batch_no from events""",
    "run_counts": f"""with {CHAPTERS},
k as (select *, {tokens('t')} as k from chapters)
select 'chapters' as metric, count(*) as n from k
union all select 'parts', cast(sum(case when k > 60 then k // 60 + 1 else 1 end) as bigint) from k
union all select 'tokens', cast(sum(k) as bigint) from k
union all select 'characters', cast(sum(length(t)) as bigint) from k
union all select 'to_fetch', count(*) from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)""",
    "classify_url": f"""with {PLACES} select page_id, source, coalesce(document_id, 'Unknown') as document_id from places""",
    "doi_source": f"""with {PLACES} select doc_id, '10.5555/p' || doc_id as doi, source, document_id
from (select doc_id from documents) d left join places on page_id = doc_id""",
    "id_rows": f"""with {URL_PAPERS} select sid as semantic_id, 'SEMANTIC' as key, sid as value from url_papers
union all select sid, 'IEEE', ieee from url_papers where ieee is not null
union all select sid, 'ORG', org from url_papers where org is not null""",
    "papers_with_id": f"with {URL_PAPERS} select sid as semantic_id from url_papers where org is not null",
    "lookup_id": f"""with {URL_PAPERS},
firsts as (select * from (select *, row_number() over (partition by ieee order by sid) as r from url_papers) where r = 1)
select doc_id, cast(doc_id as varchar) as value, sid as semantic_id, org
from documents left join firsts on ieee = cast(doc_id as varchar)""",
    "semantic_to_ieee": """select event_id, 'S' || user_id as semantic_id,
  case when quality = 1 then cast(doc_id as varchar) end as ieee_id from events left join labels on doc_id = user_id""",
    "stored_lookup": """select event_id, 'S' || user_id as semantic_id,
  case when quality = 1 then cast(doc_id as varchar) end as ieee_id from events left join labels on doc_id = user_id""",
    "resolve_cascade": f"{DOI_FOUND} select event_id, doi, semantic_id, is_new from found",
    "fetched_new_papers": f"{DOI_FOUND} select distinct semantic_id, doi from found where is_new",
    "resolve_ieee": f"""with {CASCADE},
asked as (select event_id, cast(user_id as varchar) as k from events),
own as (select cast(doc_id as varchar) as k, 'S' || doc_id as own from labels where quality = 1),
dois as (select cast(doc_id as varchar) as k, true as has_doi from documents where lang <> 'fr')
select event_id, k as ieee_id, coalesce(own, case when has_doi then coalesce(local, fetched) end) as semantic_id,
  coalesce(own is null and has_doi and local is null and fetched is not null, false) as is_new
from asked left join own using (k) left join dois using (k) left join local using (k) left join fetched using (k)""",
    "doi_on_page": "select cast(doc_id as varchar) as ieee_id, '10.5555/p' || doc_id as doi from documents",
    "edges_flat": f"""with {LINES} select cast(doc_id as varchar) as paper_id, 'reference' as direction,
  'P' || length(x) as other_id, x as title, cast(1990 + i as int) as year, source as venue,
  lang || ',background' as intents, length(x) > 80 as is_influential, cast(i as int) as ordinal
from lines where n > 1 and lang <> 'de'""",
    "citations_flat": f"""with {LINES} select cast(doc_id as varchar) as paper_id, 'citation' as direction,
  'P' || length(x) as other_id, x as title, cast(1990 + i as int) as year, source as venue,
  lang as intents, length(x) > 80 as is_influential, cast(i as int) as ordinal from lines""",
    "edges_written": f"""with {LINES} select cast(doc_id as varchar) as paper_id, 'reference' as direction,
  'P' || length(x) as other_id, x as title, cast(1990 + i as int) as year, source as venue,
  lang || ',background' as intents, length(x) > 80 as is_influential, cast(i as int) as ordinal
from lines where n > 1 and lang <> 'de'""",
    "drop_extension": """select doc_id, source || '.' || lang || '.v' || doc_id as stem, '.' || source as hidden
from documents""",
    "contains_ignore_case": """select doc_id, contains(lower(text), 'the ') as article,
  contains(lower(text), lang || 'e') as by_lang from documents""",
    "bibliography": """select cast(l_orderkey as varchar) as paper_id, cast(l_partkey as varchar) as other_id,
  l_quantity > 25 as is_influential, 'citation' as direction from lineitem
union all select cast(o_orderkey as varchar), cast(o_custkey as varchar), null, 'reference' from orders""",
    "frontier_topk": """select cast(l_partkey as varchar) as other_id, count(*) as n_edges,
  count(*) filter (l_quantity > 25) as n_influential
from lineitem where not exists (select 1 from part where p_partkey = l_partkey and p_size > 25)
group by l_partkey order by n_edges desc, n_influential desc, other_id limit 50""",
    "html_tokens": f"""select page_id, cast(generate_subscripts(l, 1) - 1 as int) as pos, unnest(l) as token
from (select page_id, regexp_extract_all(html, {_q(HTML_TOKEN)}) as l from pages)""",
    "html_headings": f"with {WEB} select page_id, ordinal, parent_ordinal, level, title, section_id from web",
    "html_sections": f"with {WEB} select page_id, ordinal, parent_ordinal, level, title, content, section_id from web",
    "html_markdown": f"""with {WEB} select page_id, string_agg(
  case when level = 1 then '# ' || title || {NL} || {NL} else '' end || content || {NL} || {NL}, '' order by ordinal) as markdown
from web group by page_id""",
    "html_links": f"""with anchors as (
  select page_id, generate_subscripts(l, 1) as i, unnest(l) as a
  from (select page_id, regexp_extract_all(html, '(?s)<a[^>]*>.*?</a>') as l from pages)),
named as (select page_id, i, {strip(text_of('a'))} as text, {unescape("regexp_extract(a, 'href=.([^" + '"' + "]*)', 1)")} as href from anchors)
select page_id, text, arg_max(href, i) as href from named where text <> '' and href <> '' group by page_id, text""",
    "html_unhandled": f"""with tags as (
  select page_id, lower(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9-]*)', 1)) as name,
    case when token like '</%' then -1 when token like '%/>' then 0 else 1 end as move
  from ({_web_tokens}) where regexp_matches(token, '^</?[A-Za-z]')),
counted as (select page_id, name, count(*) filter (move >= 0) as opened, sum(move) as open from tags group by page_id, name)
select page_id, 'tag' as kind, name, opened as n from counted where opened > 0 and name not in ({', '.join(map(_q, _known_tags))})
union all select page_id, 'unbalanced', name, cast(open as bigint) from counted where open <> 0 and name in ({', '.join(map(_q, WEB_PAGE.tags))})""",
    "page_sections": f"with {OWN_SECTIONS} select * from sections",
    "html_lists": f"""with {OWN_SECTIONS},
items as (select page_id, ordinal, list_filter(string_split(content, {NL}), lambda l: starts_with(l, '- ')) as items from sections)
select page_id, ordinal, cast(generate_subscripts(items, 1) - 1 as int) as item_no, unnest(items) as item from items""",
    "rich_sections": f"""with {RICH_LINKS} select doc_id as page_id, cast(i as int) as ordinal, cast(null as int) as parent_ordinal,
  2 as level, 'Part ' || (i + 1) as title, 'sec' || i as section_id,
  x || '<sup>' || i || '</sup> `m' || i || '`' || links || ' ' || {NL} || {NL} || '$$' || {NL} || 'P_' || i || '=q' || {NL} || '$$'
  || repeat({NL}, 4) || {NL} || {NL} || '$$' || {NL} || 'E_' || i || '=' || {NL} || 'mc' || {NL} || '$$' || {NL} || {NL}
  || '1. one ' || i || {NL} || '1. two' || {NL} || {NL} || {NL} || {NL} || 'Figure could not be parsed.' || {NL}
  || {NL} || '![T ' || i || '](' || path || ')' || {NL} || {NL} || '**Table ' || i || '** of ' || doc_id || {NL} || {NL} as content
from linked""",
    "rich_xrefs": f"""with {RICH_LINKS} select doc_id as page_id, cast(11 * i + k - 1 as int) as pos, kind as ref_type,
  kind || (case when kind = 'sec' then i + 1 else i end) as anchor, kind || ' ' || i as text, target, target is not null as resolved
from (select *, case kind when 'odd' then null when 'fig' then null when 'table' then path
  when 'sec' then case when i + 1 < n then '#part%20' || (i + 2) end else kind || i end as target from each)""",
    "html_figures": f"""with {LINES} select doc_id as page_id, cast(i as int) as ordinal,
  'https://ieeexplore.ieee.org//mediastore/' || doc_id || '-' || i || '.gif' as image_href,
  'ieee_' || doc_id || '_fig' || i || '.gif' as img_file_name, 'fig' || i as data_fig_id, 'Fig' || i as alt,
  'Fig. ' || i || '.' as caption_title, 'Line' || i || 'of ' || n as caption_text from lines""",
    "image_manifest": f"""with {LINES} select doc_id as page_id,
  'https://ieeexplore.ieee.org//mediastore/' || doc_id || '-' || i || '.gif' as image_href,
  'img/' || doc_id || '_img/ieee_' || doc_id || '_fig' || i || '.gif' as file_path from lines""",
    "xref_resolve": f"""with {OWN_SECTIONS}
select doc_id as page_id, cast(3 * i + v as int) as pos,
  case v when 0 then 'sec' when 1 then 'fig' else 'bibr' end as ref_type,
  case v when 0 then 'sec' || (i + 1) when 1 then 'fig' || i else 'ref' || i end as anchor,
  case v when 0 then 'next' when 1 then 'Fig. ' || i else '[' || i || ']' end as text,
  case v when 0 then {slug('next_title')} when 1 then '../img/S' || doc_id || '_img/ieee_' || doc_id || '_fig' || i || '.gif'
    else 'ref' || i end as target,
  v > 0 or next_title is not null as resolved
from titled, (values (0), (1), (2)) as o(v)""",
    "page_markdown": f"with {OWN_SECTIONS} select page_id, {MARKDOWN} as markdown from sections group by page_id",
    "reference_list": f"""with {LINES},
papers as (select 'S' || d.doc_id as sid, '10.5555/' || source as doi, cast(n_chars as varchar) as ieee
  from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id)),
answers as (select '10.5555/' || lang as doi, min('A' || doc_id) as fetched from documents where lang <> 'es' group by lang),
by_doi as (select doi, coalesce(max(own), max(fetched)) as semantic_id from (
  select doi, min(sid) as own, null as fetched from papers group by doi
  union all select doi, null, fetched from answers) group by doi),
page_dois as (select {capture('url', '/([0-9]+)')} as ieee, min('10.5555/' || regexp_extract(url, '/([a-z]{{2}})/', 1)) as doi from pages group by 1),
by_ieee as (select ieee, coalesce(max(own), max(other)) as semantic_id from (
  select ieee, min(sid) as own, null as other from papers group by ieee
  union all select ieee, null, semantic_id from page_dois left join by_doi using (doi)) group by ieee),
asked as (select *, 'https://doi.org/10.5555/' || case when i = 0 then source else lang end as doi_link,
  case when i = 0 or contains(x, ',') then '/document/' || length(x) end as page_link,
  i > 0 and contains(x, ',') as page_last from lines)
select a.doc_id as page_id, cast(i as int) as ordinal, (i + 1) || '.' as number, {strip('x')} as title,
  'CrossRef=' || doi_link || coalesce(';View Article=' || page_link, '') as links,
  case when page_last then e.semantic_id else o.semantic_id end as semantic_id
from asked a left join by_doi o on 'https://doi.org/' || o.doi = doi_link
left join by_ieee e on '/document/' || e.ieee = page_link""",
    "corpus_summary": f"""with {KNOWN}, {KNOWN_SECTIONS}
select s.page_id, sid as semantic_id, count(*) as n_sections, count(*) // 2 as n_figures, count(*) // 2 as n_references,
  length({MARKDOWN}) as n_chars, md5({MARKDOWN}) as markdown_md5
from sections s join resolved r on r.doc_id = s.page_id group by s.page_id, sid""",
    "crawl_records": f"""with {KNOWN}, {KNOWN_SECTIONS},
images as (select doc_id, string_agg('ieee_' || doc_id || '_fig' || i || '.gif', {NL} order by i) as img_info from lines group by doc_id),
told as (select page_id as doc_id, string_agg(level || '|' || section_id || '|' || title || '|' || content, {NL} order by ordinal) as section_info
  from sections group by page_id),
refs as (select l.doc_id, string_agg((i + 1) || '.|' || coalesce(r.sid, '-') || '|' || {strip('x')}, {NL} order by i) as reference_info
  from lines l left join resolved r on i > 0 and contains(x, ',') and r.doc_id = length(x) group by l.doc_id)
select doc_id as page_id, cast(doc_id as varchar) as ieee_paper_id, sid as semantic_id, 'out/' || sid || '_original.md' as output_md_path,
  'img/' || sid || '_img' as final_img_dir, 'info/' || sid || '_original.json' as paper_info_path,
  reference_info, img_info, section_info
from resolved left join images using (doc_id) left join told using (doc_id) left join refs using (doc_id)""",
    "chapters": f"with {CHAPTERS} select doc_id, cast(chapter_no as int) as chapter_no, t as text from chapters",
    "chunk_plan": f"""select doc_id, cast(k as int) as n_tokens, cast(case when k > 200 then k // 200 + 1 else 1 end as int) as n_parts
from (select doc_id, {tokens('text')} as k from documents)""",
    "chunks": f"""with recursive whole as (select doc_id, text as t from documents),
{parts('whole', 'doc_id', 200, chr(10))} select doc_id, part_no, p as text from parts""",
    "chunks_by_pattern": f"""with recursive whole as (select doc_id, text as t from documents),
{parts('whole', 'doc_id', 200, '. ')} select doc_id, part_no, p as text from parts""",
    "transform_roundtrip": f"{ROUNDTRIP} select doc_id, n_chunks, markdown from result",
    "transform_callable": f"{ROUNDTRIP} select doc_id, n_chunks, markdown from result",
    "transform_retries": f"""with recursive {CHAPTERS},
{parts('chapters', 'doc_id, chapter_no', 60, '. ')},
marked as (
  select doc_id, case when {strip('p')} = '' then 'blank' when length(lower(p)) >= 100 then 'ok' else 'short' end as status from parts
  union all select doc_id, 'blank' from documents)
select doc_id, status, count(*) as n,
  cast(sum(case status when 'ok' then 1 when 'short' then 3 else 0 end) as bigint) as tries
from marked group by doc_id, status""",
    "transform_resumed": f"{ROUNDTRIP} select doc_id, n_chunks, markdown from result",
    "heading_alignment": f"""with {LINES}, heads as (select doc_id, i, {strip('x')} as heading from lines where i > 0)
select doc_id, 'kept' as status, heading, count(*) as n from heads where i <> 2 group by all
union all select doc_id, 'missing', heading, 1 from heads where i = 2
union all select doc_id, 'extra', 'added ' || lang, 1 from documents""",
    "compare_structure": f"""{ROUNDTRIP},
counted as (
  select d.doc_id, len({chapter_list(BODY)}) as source_chapters,
    len({chapter_list(strip('substr(markdown, length(' + HEADER + ') + 1)'))}) as output_chapters
  from documents d join result r on d.doc_id = r.doc_id)
select doc_id, cast(source_chapters as int) as source_chapters, cast(output_chapters as int) as output_chapters,
  source_chapters = output_chapters as same from counted""",
    "overview": f"""select cast(doc_id as varchar) as key, replace(text, {NL}, ' ') || '<sup>' || n_chars || '</sup><br>' || lang
  || '<br><br>' || case when lang <> 'es' then source else '' end as "Overview" from documents""",
    "links_view": f"""select cast(doc_id as varchar) as key, replace(text, {NL}, ' ') as title,
  '[[reader/' || lang || '-' || source || '/zh|kr]]' as "KR", '[[reader/' || lang || '-' || source || '/en|en]]' as "EN",
  '[doi.org](https://doi.org/10.5555/' || source || ')' as "Link",
  '[slide](http://localhost/slides/' || doc_id || '.md)' as "Slide" from documents""",
    "review_page": f"""select cast(doc_id as varchar) as key,
  {NL} || '-------' || {NL} || {NL} || '<!-- graphical abstract -->' || {NL} || {NL} || case when lang <> 'es' then source else '' end
  || {NL} || {NL} || '<!-- graphical abstract -->' || {NL}
  || {NL} || '-------' || {NL} || {NL} || '<!-- review -->' || {NL} || {NL} || text || {NL} || {NL} || '<!-- review -->' || {NL}
  || {NL} || '-------' || {NL} || {NL} || '<!-- bibliography -->' || {NL} || {NL} || {NL} || {NL} || '<!-- bibliography -->' || {NL}
  || {NL} || '-------' || {NL} as page from documents""",
    "incremental_ids": "select distinct cast(user_id as varchar) as id from events",
}
