"""The registered queries as plain SQL for an independent engine.

Written against the driver tables only; nothing here is derived from a Spark plan. Shared
parts are named common table expressions that a query lists in `use`.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from filigree import rules as R
from filigree.plans import standins as D

ORACLE: dict[str, str] = {}
PARTS: dict[str, str] = {}


def lit(value: str) -> str:
    """A string literal, with line breaks kept."""
    pieces = ["'" + piece.replace("'", "''") + "'" for piece in value.split("\n")]
    return "(" + " || chr(10) || ".join(pieces) + ")"


def strings(values: Iterable[str]) -> str:
    return "cast([" + ", ".join(lit(v) for v in values) + "] as varchar[])"


def has(text: str, words: Iterable[str]) -> str:
    return "coalesce(" + " or ".join(f"contains({text}, {lit(w)})" for w in words) + ", false)"


def compact(items: Iterable[str]) -> str:
    return "list_filter([" + ", ".join(items) + "], lambda x: x is not null)"


def tag(text: str, dictionary: Mapping[str, Iterable[str]]) -> str:
    return compact(f"case when {has(text, words)} then {lit(name)} end" for name, words in dictionary.items())


def word_tag(text: str, words: Iterable[str]) -> str:
    return tag(text, {word: [word.lower()] for word in words})


def line(array: str) -> str:
    return f"coalesce(array_to_string({array}, '|'), '')"


def both(a: str, b: str) -> str:
    """Elements of a that are in b, in the order of a."""
    return f"list_filter({a}, lambda x: list_contains({b}, x))"


def without(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: not list_contains({b}, x))"


def unique(a: str) -> str:
    return f"list_filter({a}, lambda x, i: list_position({a}, x) = i)"


BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def part(name: str, sql: str, use: Iterable[str] = ()) -> None:
    PARTS[name] = (sql, tuple(use))


def oracle(name: str, sql: str, use: Iterable[str] = ()) -> None:
    """Register SQL with the parts it uses, in order of dependence."""
    order: list[str] = []

    def visit(item: str) -> None:
        for before in PARTS[item][1]:
            visit(before)
        if item not in order:
            order.append(item)

    for item in use:
        visit(item)
    head = ",\n".join(f"{item} as ({PARTS[item][0]})" for item in order)
    ORACLE[name] = f"with {head}\n{sql}" if head else sql


# -- shared parts ----------------------------------------------------------

SELECTED = "case conv_id % 3 when 0 then cast([] as varchar[]) when 1 then ['src1'] else ['src1', 'src2'] end"
SECTION = "case when n_chars > 1000 then 'Risk Factors' else 'Business' end"
ACCESSION = (
    "case when o_orderstatus = 'P' then 'P-' || o_orderkey else lpad(o_custkey::varchar, 10, '0') || '-' || "
    "strftime(o_orderdate, '%y') || '-' || lpad((o_orderkey % 1000000)::varchar, 6, '0') end"
)

part("m", "select conv_id, turn, role, text as content from conversations")
part("asked", f"""
    select conv_id || '-' || turn as query_id, conv_id, turn, content as query, {SELECTED} as companies
    from m where role = 'user'""", ["m"])
part("numbered", """
    select *, row_number() over (partition by conv_id order by turn nulls first, role, content) - 1 as pos
    from m where role in ('user', 'assistant') and content is not null""", ["m"])
part("question", f"""
    select conv_id || '-' || pos as query_id, conv_id || '-' || pos as conv_id, {SELECTED} as companies, conv_id as conv,
        pos as place, content as query, answer
    from (select u.conv_id, u.pos, u.content, coalesce(a.content, '') as answer
          from numbered u left join numbered a on a.conv_id = u.conv_id and a.pos = u.pos + 1 and a.role = 'assistant' where u.role = 'user')""",
     ["numbered"])
part("before_question", """
    select q.conv_id, m.pos as turn, m.role, m.content from numbered m join question q on m.conv_id = q.conv and m.pos < q.place""",
     ["numbered", "question"])
part("chunks", f"""
    select source || '_' || lang || '_' || doc_id || '_' || section || '_' || i as chunk_id, source as ticker,
        lang as filing_type, doc_id, section, i as chunk_index, substring(text, i * 900 + 1, 1000) as content
    from (select *, {SECTION} as section,
            unnest(range(0, greatest(length(text) - 101, 0) // 900 + 1)) as i
          from documents where length(text) > 0)""")
part("postings", """
    select chunk_id, term, count(*) as tf
    from (select chunk_id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) as term from chunks)
    group by all""", ["chunks"])
part("total", "select count(*)::double as n from chunks", ["chunks"])
part("idf", "select term, ln((any_value(n) + 1) / (count(*) + 1)) + 1 as idf from postings, total group by term",
     ["postings", "total"])
part("weights", """
    select chunk_id, term, tf * idf / sqrt(sum((tf * idf) ^ 2) over (partition by chunk_id)) as w
    from postings join idf using (term)""", ["postings", "idf"])


def lexical_parts(prefix: str, requests: str, k: int, use: list[str]) -> None:
    """Parts `<prefix>_hits` for requests (query_id, query, companies)."""
    part(f"{prefix}_terms", f"""
        select query_id, term, count(*) as tf from (
            select query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) as term from {requests})
        group by all""", use)
    part(f"{prefix}_weights", f"""
        select query_id, term, tf * coalesce(idf, ln(n + 1) + 1)
            / sqrt(sum((tf * coalesce(idf, ln(n + 1) + 1)) ^ 2) over (partition by query_id)) as w
        from {prefix}_terms left join idf using (term), total""", [f"{prefix}_terms", "idf", "total"])
    part(f"{prefix}_hits", f"""
        select query_id, chunk_id, s as score, rank from (
            select *, row_number() over (partition by query_id order by s desc, chunk_id) as rank from (
                select q.query_id, c.chunk_id, round(sum(q.w * c.w), 6) as s
                from {prefix}_weights q join weights c using (term)
                join chunks using (chunk_id) join {requests} r on r.query_id = q.query_id
                where coalesce(len(r.companies), 0) = 0 or list_contains(r.companies, ticker)
                group by all) where s > 0)
        where rank <= {k}""", [f"{prefix}_weights", "weights", "chunks"])


part("free", "select query_id, query, cast([] as varchar[]) as companies from asked", ["asked"])
lexical_parts("free", "free", 3, ["free"])
part("five", """
    select query_id, query, companies from asked union all select query_id || '-blank', '', companies from asked""", ["asked"])
lexical_parts("five", "five", 5, ["five"])
lexical_parts("question", "question", 3, ["question"])

part("vec", f"""
    select vec_id, label, embedding::double[] as e, coalesce(text, '') as content, lang, 
        case when n_chars > 1000 then 'Risk Factors' when text is not null then 'Business' end as section
    from embeddings left join documents on doc_id = vec_id""")
part("pair_scores", """
    select a.vec_id as query_id, b.vec_id as chunk_id, a.label as own, b.label as label,
        round(list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)), 6) as s
    from vec a, vec b""", ["vec"])
for name, where in [("near", "true"), ("near_own", "label in (own, (own + 1) % 10)")]:
    part(name, f"""
        select p.query_id, p.rank, p.s as score, p.chunk_id, v.content, v.section, v.lang as filing_type,
            v.label::varchar as ticker, 'Company ' || v.label as company, 'Unknown' as date
        from (select *, row_number() over (partition by query_id order by s desc, chunk_id) as rank
              from pair_scores where {where} qualify rank <= 8) p
        join vec v on v.vec_id = p.chunk_id""", ["pair_scores", "vec"])
part("steps", f"""
    select *, (rank - 1) // 3 as step_no,
        case (rank - 1) // 3 when 1 then '{R.COMPARER_TOOL}' else '{R.RETRIEVER_TOOL}' end as tool
    from near_own""", ["near_own"])
part("facts", """
    select 'ALL' as ticker, o_orderpriority as data_point, year(o_orderdate) as year,
        sum(o_totalprice::decimal(18, 2))::decimal(18, 2) as value
    from orders group by all""")
part("trends", """
    select *, lag(year) over w as previous_year, lag(value) over w as previous_value,
        round((value::double - lag(value::double) over w) / lag(value::double) over w * 100, 2) as pct_change,
        year = max(year) over (partition by data_point) as is_latest
    from facts window w as (partition by data_point order by year)""", ["facts"])

# -- sources ---------------------------------------------------------------

part("filings", f"""
    select ticker, filing_type, accession_number from (
        select *, row_number() over (partition by ticker order by
            case when yy >= 93 then 1900 + yy else 2000 + yy end desc, substring(accession_number, 15, 6)::int desc,
            accession_number desc) as n
        from (select distinct 'C' || o_custkey as ticker, '10-K' as filing_type, {ACCESSION} as accession_number,
                strftime(o_orderdate, '%y')::int as yy
              from orders where o_orderstatus <> 'P'))
    where n <= 2""")
oracle("list_filings", "select * from filings", ["filings"])
oracle("company_filings", """
    select f.*, c_name as company from filings f join customer on ticker = 'C' || c_custkey""", ["filings"])
oracle("pick_primary_document", """
    select l_orderkey::varchar as accession_number, coalesce(
        min(case when l_linenumber > 1 and l_returnflag = 'A' then 'b' || l_linenumber || '.HTM'
                 when l_linenumber > 1 and l_returnflag = 'R' then 'a' || l_linenumber || '.html' end),
        max(case when l_linenumber = 1 then 'full-submission.txt' end)) as file_name
    from lineitem group by 1 having file_name is not null""")
oracle("latest_filings", """
    select o_custkey, o_orderkey from orders
    qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) <= 2""")
oracle("list_companies", """
    select d.source as ticker, coalesce(s_name, upper(d.source)) as name
    from (select distinct source from documents) d left join supplier on d.source = 'src' || s_suppkey""")
oracle("search_companies", """
    select c_mktsegment as ticker, c_name as name, c_name || ' (' || c_mktsegment || ')' as label
    from customer where contains(lower(c_name || ' (' || c_mktsegment || ')'), '7 (auto')""")
oracle("selectable_company", """
    select event_id, user_id as ticker from events
    where user_id in (select c_custkey from customer)""")
oracle("company_display_name", """
    select c_custkey, t::varchar as ticker, coalesce(n_name, t::varchar) as display_name
    from (select c_custkey, c_nationkey + 100 * (c_custkey % 3 = 0)::int as t from customer) left join nation on t = n_nationkey""")
oracle("write_chunks", "select chunk_id, content, ticker, section, chunk_index::int as chunk_index from chunks", ["chunks"])
oracle("ingest_stream", """
    select source || '_' || lang || '_' || doc_id || '_Full Document_' || i as chunk_id,
        substring(text, i * 900 + 1, 1000) as content, source as ticker, 'Full Document' as section,
        i::int as chunk_index
    from (select *, unnest(range(0, greatest(length(text) - 101, 0) // 900 + 1)) as i
          from documents where length(text) > 0)""")

oracle("read_document", """
    select doc_id, regexp_replace(text, '[^\\x00-\\x7F]', chr(65533), 'g') as text from documents""")
oracle("valid_accession", "select o_orderkey, o_orderstatus <> 'P' as valid from orders")
oracle("filter_companies", "select chunk_id, ticker from chunks where ticker in ('src3', 'src5')", ["chunks"])
oracle("embed", """
    select chunk_id, length(content)::int as n_chars, (length(content) - length(replace(content, 'e', '')))::int as n_e
    from chunks""", ["chunks"])

# -- scalar and text -------------------------------------------------------

oracle("filing_url", f"""
    select o_orderkey, 'https://www.sec.gov/Archives/edgar/data/'
        || case when acc like 'P%' then '0000000000' else lpad(o_custkey::varchar, 10, '0') end
        || '/' || replace(acc, '-', '') || '/' || lower(o_orderstatus) || '.htm' as url
    from (select *, {ACCESSION} as acc from orders)""")

_page = "coalesce(nullif(regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1), ''), " \
        "nullif(regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1), ''), html)"
_page = f"regexp_replace({_page}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g')"
_tags = "p|div|br|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|hr|pre|blockquote"
_page = rf"regexp_replace({_page}, '(?i)</?(?:{_tags})(?:\s[^>]*)?/?>', chr(10), 'g')"
_page = f"regexp_replace({_page}, '<[^>]*>', '', 'g')"
for _entity, _char in [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&ndash;", "\u2013"), ("&rsquo;", "\u2019"),
    ("&#8220;", "\u201c"), ("&#x201D;", "\u201d"), ("&#xa0;", " "), ("&#128512;", "\U0001f600"), ("&#39;", "'"), ("&amp;", "&"),
]:
    _page = f"replace({_page}, {lit(_entity)}, {lit(_char)})"
_page = rf"regexp_replace({_page}, '[ \t\r]+', ' ', 'g')"
_page = rf"regexp_replace({_page}, ' ?\n[ \n]*', chr(10), 'g')"
_marked = "replace(html, '</article>', '<p>&#8220;a&#x201D;&#xa0;&ndash; &#128512;&rsquo;s &amp;lt; &#0; &#xD800; &unknown;</p></article>')"
part("marked", f"select page_id, url, {_marked} as html from pages")
part("page_text", f"select page_id, url, {strip(_page)} as text from marked", ["marked"])
oracle("html_to_text", "select page_id, text from page_text", ["page_text"])
oracle("extract_sections", f"""
    select doc_id, section, text from (
        select doc_id, {lit(R.TARGET_SECTIONS["1A"])} as section, {strip("text")} as text from documents
        union all
        select doc_id, {lit(R.TARGET_SECTIONS["7"])}, {strip("lang || ' ' || text")} from documents)
    where text <> ''""")
oracle("chunk_text", "select doc_id, chunk_index::int as chunk_index, content from chunks", ["chunks"])
oracle("chunk_text_snapped", r"""
    with recursive s as (
        select doc_id, text, 1::bigint as p, 0::bigint as n, 0 as i from documents where length(text) > 0
        union all
        select doc_id, text, p + n, case when length(text) - p - n + 1 <= 900 then length(text) - p - n + 1 else
            coalesce(nullif(length(regexp_extract(substring(text, p + n, 900), '(?s)^(..*\s)', 1)), 0), 900) end, i + 1
        from s where p + n <= length(text)),
    strides as (select doc_id, i - 1 as i, substring(text, p, n) as x from s where i > 0)
    select a.doc_id, a.i::int as chunk_index, a.x || coalesce(substring(b.x, 1, 100), '') as content
    from strides a left join strides b on b.doc_id = a.doc_id and b.i = a.i + 1
    where a.i = 0 or b.x is not null or length(a.x) > 100""")
oracle("chunk_counts", """
    select ticker, filing_type, doc_id::varchar as accession_number, section, count(*) as n_chunks,
        sum(length(content))::bigint as n_chars from chunks group by all""", ["chunks"])
oracle("process_filing", r"""
    select t || '_10-K_' || page_id || '_Full Document_' || i as chunk_id, substring(text, i * 900 + 1, 1000) as content,
        t as company, 'Unknown' as date, 'Full Document' as section, i::int as chunk_index
    from (select *, regexp_extract(url, '//([^.]+)\.', 1) as t,
            unnest(range(0, greatest(length(text) - 101, 0) // 900 + 1)) as i
          from page_text where length(text) > 0)""", ["page_text"])
oracle("filing_label", """
    select o_orderkey, o_orderpriority || ' (' || case when o_orderstatus = 'P' then 'N/A'
        else strftime(o_orderdate, '%Y-%m-%d') end || ')' as filing from orders""")
oracle("company_label", "select s_suppkey, s_name || ' (' || s_suppkey || ')' as label from supplier")
oracle("chunk_metadata", """
    select ticker as company, ticker, filing_type, 'Unknown' as date, doc_id::varchar as accession_number, section,
        chunk_index::int as chunk_index from chunks""", ["chunks"])
oracle("format_context_block", """
    select chunk_id, 'Source: ' || filing_type || ' (' || ticker || ', Unknown), Section: ' || section || chr(10)
        || 'Content: ' || content as block from chunks""", ["chunks"])
oracle("annotate_user_message", """
    select conv_id, turn, content || case conv_id % 3 when 0 then '' when 1 then ' (Companies selected: src1)'
        else ' (Companies selected: src1, src2)' end as content from m""", ["m"])
oracle("extract_years", """
    select o_orderkey, case when o_orderstatus <> 'O' then year(o_orderdate)::varchar end as filing_year,
        (year(o_orderdate) - 3) || '|' || year(o_orderdate) as years from orders""")
oracle("strip_selection_tag", rf"""
    select conv_id, turn, annotated, {strip('''replace(c, case conv_id % 3 when 0 then '(Companies selected: kept)'
        when 1 then '(Companies selected: src1)' else '(Companies selected: src1, src2)' end, '')''')} as content
    from (select *, ' ' || chr(160) || chr(10) || annotated || ' (Companies selected: kept)' || chr(12288) || chr(9) as c
          from (select *, content || case conv_id % 3 when 0 then '' when 1 then ' (Companies selected: src1)'
                    else ' (Companies selected: src1, src2)' end as annotated from m))""", ["m"])

# -- retrieval -------------------------------------------------------------

oracle("lexical_search", "select query_id, rank::int as rank, score, chunk_id from free_hits", ["free_hits"])
oracle("stored_search", "select query_id, rank::int as rank, score, chunk_id from free_hits", ["free_hits"])
oracle("retrieve_sections", "select query_id, rank::int as rank, score, chunk_id from five_hits", ["five_hits"])
oracle("knn_search", "select query_id, rank::int as rank, score, chunk_id from near where rank <= 3", ["near"])
oracle("knn_filtered", "select query_id, rank::int as rank, score, chunk_id, ticker from near_own where rank <= 3", ["near_own"])
oracle("knn_clustered", "select query_id, rank::int as rank, score, chunk_id from near where rank <= 3", ["near"])
oracle("knn_clustered_filtered", "select query_id, rank::int as rank, score, chunk_id from near_own where rank <= 3", ["near_own"])

# -- context and citations -------------------------------------------------

oracle("assemble_context", f"""
    select doc_id as query_id, coalesce(context, {lit(R.NO_CONTEXT)}) as context
    from documents left join (
        select query_id, string_agg('Source: ' || coalesce(filing_type, 'N/A') || ' (' || company || ', ' || date
            || '), Section: ' || coalesce(section, 'N/A') || chr(10) || 'Content: ' || content,
            {lit(R.CONTEXT_SEPARATOR)} order by rank) as context
        from near where rank <= 3 group by query_id) on query_id = doc_id""", ["near"])


def citations(hits: str, order: str) -> str:
    return f"""
    select query_id, (row_number() over (partition by query_id order by place))::int as ord, company, ticker,
        filing_type || ' (' || date || ')' as filing, section, 0 as page
    from (select query_id, ticker, filing_type, date, section, min({order}) as place, arg_min(company, {order}) as company
          from (select * replace (coalesce(section, 'N/A') as section, coalesce(filing_type, 'N/A') as filing_type)
                from {hits}) group by all)"""


part("cited", citations("near_own", "rank"), ["near_own"])
oracle("dedupe_citations", "select * from cited", ["cited"])
part("near_5", "select * from near where rank <= 5", ["near"])
part("near_3", "select * from near where rank <= 3", ["near"])
part("near_3_cited", citations("near_3", "rank"), ["near_3"])
part("near_5_cited", citations("near_5", "rank"), ["near_5"])
oracle("citation_ordinal", "select query_id, ord, section from near_5_cited", ["near_5_cited"])
oracle("build_responses", f"""
    select doc_id as query_id, case when c.citations is null then {lit(R.NO_HITS_ANSWER)} else text end as answer,
        coalesce(c.citations, '') as citations,
        case when c.citations is not null and lang = 'en' then 'en' else '' end as suggested_queries
    from documents left join (
        select query_id, string_agg(company || '/' || ticker || '/' || filing || '/' || section, '|' order by ord) as citations
        from near_3_cited group by 1) c on c.query_id = doc_id""", ["near_3_cited"])
oracle("source_counts", "select query_id, count(*) as n_sources from cited group by 1", ["cited"])
oracle("collect_metadata", """
    select query_id, coalesce((
            select string_agg(section, '|' order by r) from (
                select section, min(rank) as r from near n where n.query_id = q.query_id and rank <= 5
                    and section is not null group by 1)), '') as sections, (
            select string_agg(name, '|' order by r, sub) from (
                select company as name, 0 as sub, min(rank) as r from near n
                where n.query_id = q.query_id and rank <= 5 group by 1
                union all
                select ticker, 1, min(rank) from near n where n.query_id = q.query_id and rank <= 5 group by 1)) as entities
    from (select distinct query_id from near) q""", ["near"])
part("retrieved", f"select * from steps where tool = '{R.RETRIEVER_TOOL}'", ["steps"])
oracle("agent_citations", citations("retrieved", "rank"), ["retrieved"])
part("trace", f"""
    select query_id, list_sort(list(distinct tool)) as tools,
        coalesce(list_sort(list(distinct section) filter (tool = '{R.RETRIEVER_TOOL}' and section is not null)), []) as sections,
        {compact(f"case when bool_or(tool = '{R.RETRIEVER_TOOL}' and contains(lower(content), {lit(t)})) then {lit(t)} end"
                 for t in D.AGENT.topics)} as topics
    from steps group by query_id""", ["steps"])
oracle("trace_profile", f"select query_id, {line('tools')} as tools, {line('sections')} as sections, {line('topics')} as topics from trace",
       ["trace"])
oracle("fallback_citations", f"""
    select doc_id as query_id, i::int as ord, c.co as company, c.co as ticker, {lit(R.FALLBACK_FILING)} as filing,
        c.se as section, 0 as page
    from (select doc_id, unnest(all_c) as c, generate_subscripts(all_c, 1) as i from (
        select doc_id, list_concat(
            [{{'co': source, 'se': 'Various'}}, {{'co': lang, 'se': 'Various'}}, {{'co': source, 'se': 'Various'}}],
            list_transform(named, lambda s: {{'co': source, 'se': s}}),
            list_transform(named, lambda s: {{'co': lang, 'se': s}})) as all_c
        from (select *, {tag("text", {s: [s] for s in D.ANSWER_SECTIONS})} as named from documents where lang <> 'es')))""")

# -- routing and tags ------------------------------------------------------

oracle("valid_query", "select conv_id, turn, content as query from m where turn % 4 = 0", ["m"])
oracle("normalize_companies", """
    select doc_id, source, source || '|' || lang as listed, '' as n_chars from documents""")

oracle("route_query", f"select query_id, conv_id % 3 = 2 or {has('lower(query)', D.ROUTING)} as to_agent from asked", ["asked"])
oracle("route_query_default", f"select doc_id, {has('lower(text)', R.ROUTING_KEYWORDS)} as to_agent from documents")
oracle("flag_complex_query", f"""
    select query_id, c as is_complex, case when c then {R.COMPLEX_TIMEOUT_MS} else {R.SIMPLE_TIMEOUT_MS} end as timeout_ms
    from (select query_id, {has('lower(query)', D.ROUTING)} as c from asked)""", ["asked"])
oracle("tag_topics", f"select doc_id, {line(tag('lower(text)', D.TOPICS))} as topics from documents")
oracle("tag_topics_default", f"select doc_id, {line(tag('lower(text)', R.TOPIC_KEYWORDS))} as topics from documents")
oracle("tag_query_patterns", "select query_id, " + ", ".join(
    f"{has('lower(query)', words)} as is_{name}" for name, words in D.PATTERNS.items()) + " from asked", ["asked"])
_companies = {name.upper(): [name] for name in D.RULES.names} | {t: [t.lower()] for t in D.RULES.tickers}
_sections = {s.upper(): [s] for s in D.RULES.sections}
oracle("tag_mentions", f"""
    select conv_id, turn, {line(tag('lower(content)', _companies))} as companies_named,
        {line(tag('lower(content)', _sections))} as sections_named from m""", ["m"])
oracle("tag_agent_topics", f"select doc_id, {line(word_tag('lower(text)', D.AGENT.topics))} as topics from documents")
oracle("match_rules", f"select doc_id, unnest({tag('lower(text)', D.TOPICS)}) as rule from documents")

oracle("match_dictionary", """
    select distinct d.doc_id, w.rule from documents d join (
        select distinct 'r' || doc_id % 40 as rule, lower(substring(text, 3 + doc_id % 7, 2 + doc_id % 11)) as word from documents) w
    on trim(w.word, ' ') <> '' and contains(lower(d.text), w.word)""")

# -- conversations ---------------------------------------------------------

oracle("clean_history", """
    select conv_id, turn, role, text as content from conversations
    where role is not null and length(text) % 5 > 0""")
oracle("normalize_history", """
    select conv_id, turn, role, case when length(text) % 5 > 0 then text end as content from conversations""")
oracle("drop_loading", "select conv_id, turn from conversations where length(text) % 7 <> 0")
oracle("format_history", "select * from m where role in ('user', 'assistant')", ["m"])

oracle("last_n_messages", """
    select conv_id, turn, role, content from m where role in ('user', 'assistant') and content is not null
    qualify row_number() over (partition by conv_id order by turn desc) <= 3""", ["m"])


def grouped(text: str, dictionary: Mapping[str, Iterable[str]]) -> str:
    return compact(f"case when bool_or({has(text, words)}) then {lit(name)} end" for name, words in dictionary.items())


def profile(messages: str, n: int) -> str:
    return f"""
    select conv_id, {grouped('lower(content)', D.TOPICS)} as topics, {grouped('lower(content)', _companies)} as companies,
        {grouped('lower(content)', _sections)} as sections, list_sort(list(distinct lower(content))) as asked
    from (select * from {messages} qualify row_number() over (partition by conv_id order by turn desc) <= {n})
    where role = 'user' group by conv_id"""


part("profile_3", profile("m", 3), ["m"])
part("profile_before", profile("before_question", R.HISTORY_WINDOW), ["before_question"])
oracle("history_profile", f"""
    select conv_id, {line('topics')} as topics, {line('companies')} as companies, {line('sections')} as sections,
        {line('asked')} as asked from profile_3""", ["profile_3"])
_words = {w: [w] for w in D.WORDS}
oracle("user_topics", f"""
    select conv_id, {line(grouped('lower(content)', _words))} as topics from m where role = 'user' group by 1""", ["m"])
oracle("priority_topics", f"""
    select conv_id, {line(f"list_concat({both('h', 'c')}, {without('c', 'h')})")} as topics from (
    select conv_id, coalesce(h, cast([] as varchar[])) as h, coalesce(c, cast([] as varchar[])) as c
    from (select conv_id, {grouped('lower(content)', _words)} as h from m where role = 'user' group by 1)
    full join (select conv_id, {grouped('lower(content)', _words)} as c from m where role = 'assistant' group by 1)
    using (conv_id))""", ["m"])
oracle("missing_sections", f"""
    select doc_id, {line(without(strings(D.WORDS), 'found'))} as missing
    from (select doc_id, {word_tag('lower(text)', D.WORDS)} as found from documents)""")
oracle("other_companies", f"""
    select doc_id, {line("case when len(p) > 0 then p else o end")} as others from (
        select *, {both('o', 'd')} as p from (
            select doc_id, {without(strings(D.RULES.peers), '[source]')} as o,
                case when lang = 'en' then ['src' || doc_id % 7, 'OU'] else [source] end as d from documents))""")
oracle("union_suggestions", f"""
    select doc_id, {line(unique('l'))} as texts from (
        select doc_id, list_filter(list_concat({word_tag('lower(text)', D.WORDS[:4])}, ['from', case when lang = 'en' then 'with' end],
            {word_tag('lower(text)', D.WORDS[2:])}), lambda x: x is not null) as l from documents)""")
part("candidates", rf"""
    select conv_id + next as conv_id, conv_id as from_conv, turn, (pos - 1)::int as pos, text
    from (select conv_id, turn, unnest(s) as text, generate_subscripts(s, 1) as pos from (
        select conv_id, turn, list_filter(list_transform(string_split(content, '. '), lambda x: {strip('x')}),
            lambda x: x <> '') as s from m where role = 'user')), (select unnest([0, 1]) as next)""", ["m"])
oracle("drop_asked_questions", """
    select from_conv, turn, pos, conv_id, text from candidates c where not exists (
        select 1 from m where m.role = 'user' and m.conv_id = c.conv_id
            and (contains(lower(m.content), lower(c.text)) or contains(lower(c.text), lower(m.content))))""",
       ["candidates", "m"])
oracle("drop_asked_comparisons", """
    select conv_id, turn, company, other from m, (values ('Thble', 'With'), ('ION', 'ther'), ('avec', 'Que'),
        ('Ein', 'ung')) p(company, other)
    where role = 'user' and not exists (
        select 1 from m b where b.role = 'user' and b.conv_id = m.conv_id and contains(lower(b.content), 'tion')
            and contains(lower(b.content), lower(company)) and contains(lower(b.content), lower(other)))""", ["m"])

# -- suggestions and prompts -----------------------------------------------


def choose(history: str, table: list[tuple[list[str], list[str]]]) -> str:
    """First text of the first entry that meets the history."""
    cases = [f"when list_has_any({history}, {strings(topics)}) then {lit(texts[0])}" for topics, texts in table[:-1]]
    return "case " + " ".join(cases) + f" else {lit(table[-1][1][0])} end"


_not_asked = ("list_filter({list}, lambda q: len(list_filter(asked, lambda p: contains(p, lower(q)) "
              "or contains(lower(q), p))) = 0)")
_question_cases = "case t " + " ".join(f"when {lit(t)} then {lit(q)}" for t, q in R.TOPIC_QUESTIONS.items()) + " end"
_basis = ("case when len(hist) = 0 then case " + " ".join(
    f"when list_contains(topics, {lit(t)}) then {lit(b)}" for t, b in R.PEER_BASIS_BY_CONTENT)
    + f" else {lit(R.PEER_BASES[-1][1][0])} end else {choose('hist', R.PEER_BASES)} end")
part("question_content", """
    select query_id, string_agg(content, ' ' order by rank) as content,
        list_sort(list(distinct section)) as sections,
        list(ticker order by rank) as tickers
    from question_hits join chunks using (chunk_id) group by query_id""", ["question_hits", "chunks"])
part("sug_1", f"""
    select r.query_id, lower(query) as query, r.answer,
        coalesce(c.sections, []) as sections, coalesce(p.topics, []) as hist, coalesce(p.companies, []) as discussed,
        coalesce(p.sections, []) as discussed_sections, coalesce(p.asked, []) as asked,
        case when len(r.companies) > 0 then r.companies else {unique("coalesce(c.tickers, cast([] as varchar[]))")} end as targets,
        lower(r.answer || ' ' || coalesce(c.content, '')) as content
    from question r left join question_content c using (query_id) left join profile_before p on p.conv_id = r.conv_id""",
     ["question", "question_content", "profile_before"])
part("sug_2", f"""
    select *, targets[1] as company, coalesce(targets[1], 'the company') as ref, {tag('content', D.TOPICS)} as topics,
        {", ".join(f"{has('query', words)} as is_{name}" for name, words in D.PATTERNS.items())}
    from sug_1""", ["sug_1"])
part("sug_3", f"""
    select *, case when len({both('o', 'discussed')}) > 0 then {both('o', 'discussed')}[1] else o[1] end as peer,
        {_not_asked.format(list=f'''list_transform(list_filter(list_concat({both('hist', 'topics')}, {without('topics', 'hist')}),
            lambda t: {_question_cases} is not null), lambda t: replace({_question_cases}, 'the company', ref))''')} as by_topic
    from (select *, case when company is not null then {without(strings(D.RULES.peers), '[company]')} end as o from sug_2)""",
     ["sug_2"])
part("sug_4", f"""
    select *, list_filter(list_concat([
        case when is_comparison and len(targets) >= 2 then 'How do ' || array_to_string(targets[1:2], ' and ')
            || ' compare in terms of ' || {choose('hist', R.COMPARE_ASPECTS)} || '?' end,
        case when is_recommendation then 'What are the biggest risks for investing in ' || company || '?' end,
        case when is_recommendation then 'What competitive advantages does ' || company || ' have?' end,
        case when is_trend or list_contains(topics, 'growth') then 'What has been the trend in ' || company || '''s '
            || {choose('hist', R.TREND_METRICS)} || ' over the past 3 years?' end,
        case when list_contains(sections, 'Risk Factors') and not list_contains(discussed_sections, 'RISK FACTORS')
            then 'What strategies does ' || ref || ' have to mitigate these risks?' end,
        case when list_contains(sections, 'MD&A') and not list_contains(discussed_sections, 'MD&A')
            then 'What does management say about future growth opportunities for ' || ref || '?' end], by_topic,
        [case when len(targets) = 1 and not is_comparison and len(list_filter(asked, lambda p: contains(p, 'compare')
                and contains(p, lower(company)) and contains(p, lower(peer)))) = 0
            then 'How does ' || company || ' compare to ' || peer || ' in terms of ' || {_basis} || '?' end]),
        lambda x: x is not null) as s
    from sug_3""", ["sug_3"])
part("sug_5", f"""
    select query_id, list_filter(list_concat(s, case when len(s) < 2 then list_transform(
            {_not_asked.format(list=strings(R.GENERIC_QUESTIONS))}, lambda q: replace(q, 'the company', ref))[1:3 - len(s)]
            else cast([] as varchar[]) end, [
        case when list_contains(hist, 'financial') and list_contains(topics, 'growth')
            then 'What financial metrics show ' || company || '''s strongest growth areas?' end,
        case when list_contains(hist, 'risk')
            then 'How has ' || company || '''s risk profile changed since their previous filing?' end,
        case when list_contains(hist, 'strategy')
            then 'What long-term strategic initiatives is ' || company || ' investing in?' end]),
        lambda x: x is not null) as s
    from sug_4""", ["sug_4"])
part("suggested", f"select query_id, {unique('s')}[1:3] as s from sug_5", ["sug_5"])
oracle("suggest_followups", f"select query_id, {line('s')} as suggested_queries from suggested", ["suggested"])

_agent_topics = strings(D.AGENT.topics)
part("agent_1", f"""
    select d.doc_id as query_id, case d.doc_id % 3 when 0 then cast([] as varchar[]) when 1 then ['AAPL'] else ['AAPL', 'MSFT'] end as companies,
        coalesce(t.tools, []) as tools, coalesce(t.sections, []) as sections, coalesce(h.hist, []) as hist,
        {both(_agent_topics, f"list_concat(coalesce(t.topics, []), {word_tag('lower(d.text)', D.AGENT.topics)})")} as topics,
        case d.doc_id % 3 when 0 then 'the company' else 'AAPL' end as ref
    from documents d left join trace t on t.query_id = d.doc_id left join (
        select conv_id, {grouped('lower(content)', {t: [t] for t in D.AGENT.history_topics})} as hist
        from m where role = 'user' group by 1) h on h.conv_id = d.doc_id""", ["trace", "m"])
part("agent_2", f"""
    select *, list_filter([
        case when list_contains(tools, '{R.COMPARER_TOOL}') and len(companies) > 1
            then 'What specific differences did you find in ' || {choose('hist', R.AGENT_ASPECTS)} || ' between '
                || array_to_string(companies, ' and ') || '?' end,
        case when list_contains(tools, '{R.FACTS_TOOL}') or list_contains(topics, 'revenue') then
            case when list_contains(hist, 'growth') then 'What factors are driving ' || ref || '''s growth according to recent filings?'
            else 'How has ' || ref || '''s financial performance trended over the past 3 years?' end end,
        case when list_contains(sections, 'Risk Factors')
            then 'What strategies does ' || ref || ' mention for mitigating these risks?' end,
        'What does the ' || {without(strings(R.AGENT_SECTIONS), 'sections')}[1] || ' section reveal about ' || ref || '?',
        case when len(companies) = 1 then 'How does AAPL''s approach to ' || coalesce({both('topics', 'hist')}[1], topics[1],
            'business strategy') || ' compare to MSFT?' end], lambda x: x is not null) as s
    from agent_1""", ["agent_1"])
part("agent_3", f"""
    select query_id, list_concat(s, case when len(s) < 2 then {without(
        "[" + ", ".join("replace(" + lit(g) + ", '{company}', ref)" for g in R.AGENT_GENERAL) + "]", "s")}[1:2 - len(s)]
        else cast([] as varchar[]) end)[1:3] as s from agent_2""", ["agent_2"])
oracle("suggest_agent_followups", f"select query_id, {line('s')} as suggested_queries from agent_3", ["agent_3"])
part("agent_cited", citations("retrieved", "rank"), ["retrieved"])
_named = tag("text", {s: [s] for s in R.ANSWER_SECTIONS})
part("agent_fallback", f"""
    select doc_id as query_id, array_to_string(list_concat(
        list_transform(companies, lambda c: c || '/' || c || '/{R.FALLBACK_FILING}/{R.FALLBACK_SECTION}'),
        flatten(list_transform(companies, lambda c: list_transform(named,
            lambda n: c || '/' || c || '/{R.FALLBACK_FILING}/' || n)))), '|') as citations
    from (select *, {_named} as named,
            case doc_id % 3 when 0 then cast([] as varchar[]) when 1 then ['AAPL'] else ['AAPL', 'MSFT'] end as companies
          from documents where doc_id % 2 = 0 and doc_id not in (select query_id from steps))""", ["steps"])
oracle("ask_agent", f"""
    select d.doc_id as query_id, d.text as answer, coalesce(c.citations, f.citations, '') as citations,
        {line('s')} as suggested_queries
    from documents d join agent_3 a on a.query_id = d.doc_id left join (
        select query_id, string_agg(company || '/' || ticker || '/' || filing || '/' || section, '|' order by ord) as citations
        from agent_cited group by 1) c on c.query_id = d.doc_id
    left join agent_fallback f on f.query_id = d.doc_id""", ["agent_3", "agent_cited", "agent_fallback"])


def agent_prompt(query: str, companies: str, hints) -> str:
    cases = [f"case when {has(f'lower({query})', words)} then {lit(hint)} else '' end" for words, hint in hints]
    return " || ".join([
        query,
        f"case when len({companies}) > 0 then {lit(R.AGENT_COMPANY_LINE)} || array_to_string({companies}, ', ') else '' end",
        f"case when len({companies}) > 1 then {lit(R.AGENT_MULTI_COMPANY)} else '' end", *cases,
    ])


oracle("build_agent_prompt", f"select query_id, {agent_prompt('query', 'companies', D.HINTS)} as prompt from asked", ["asked"])
oracle("build_agent_prompt_default",
       f"select doc_id, {agent_prompt('text', '[source, lang]', R.AGENT_HINTS)} as prompt from documents")


def rag_prompt(query: str, context: str, lines: str) -> str:
    return (f"{lit(R.RAG_SYSTEM)} || chr(10) || chr(10) || coalesce({lines}, '') || 'Question: ' || {query} || chr(10) || chr(10) "
            f"|| 'Context:' || chr(10) || {context} || chr(10) || chr(10) || 'Answer:'")


part("lines", f"""
    select conv_id, string_agg(role || ': ' || content || chr(10) || chr(10), '' order by turn) as lines
    from (select * from before_question where role in ('user', 'assistant')
          qualify row_number() over (partition by conv_id order by turn desc) <= {R.HISTORY_WINDOW}) group by 1""", ["before_question"])
oracle("build_rag_prompt", f"select query_id, {rag_prompt('query', 'answer', 'lines')} as prompt from question left join lines using (conv_id)",
       ["question", "lines"])
oracle("build_compare_prompt", f"""
    select doc_id, case lang when 'de' then {lit(R.COMPARE_TOO_FEW)} else
        {lit(R.COMPARE_SYSTEM)} || chr(10) || chr(10) || {lit(R.COMPARE_INTRO)}
        || case lang when 'fr' then 'Focus the comparison on: risk factors. ' else '' end || chr(10) || chr(10)
        || 'Text 1:' || chr(10) || text || chr(10) || chr(10) || 'Text 2:' || chr(10) || source || chr(10) || chr(10) end as prompt
    from documents""")
oracle("build_summary_prompt", f"""
    select doc_id, {lit(R.SUMMARY_SYSTEM.format(words=150))} || chr(10) || chr(10) || text as prompt from documents""")
part("question_cited", """
    select query_id, string_agg(c, '|' order by r) as citations from (
        select query_id, ticker || '/' || ticker || '/' || filing_type || ' (Unknown)/' || section as c, min(rank) as r
        from question_hits join chunks using (chunk_id) group by all) group by query_id""", ["question_hits", "chunks"])
oracle("ask", f"""
    select query_id, case when citations is null then {lit(R.NO_HITS_ANSWER)} else answer end as answer,
        coalesce(citations, '') as citations, case when citations is null then '' else {line('s')} end as suggested_queries
    from question left join question_cited using (query_id) join suggested using (query_id)""", ["question", "question_cited", "suggested"])
part("question_context", f"""
    select query_id, string_agg('Source: ' || filing_type || ' (' || ticker || ', Unknown), Section: ' || section
        || chr(10) || 'Content: ' || content, {lit(R.CONTEXT_SEPARATOR)} order by rank) as context
    from question_hits join chunks using (chunk_id) group by 1""", ["question_hits", "chunks"])
_to_agent = f"(len(companies) > 1 or {has('lower(query)', R.ROUTING_KEYWORDS)})"
oracle("ask_prompts", f"""
    select query_id, 'rag' as route, {rag_prompt('query', f"coalesce(context, {lit(R.NO_CONTEXT)})", 'lines')} as prompt
    from question left join question_context using (query_id) left join lines using (conv_id) where not {_to_agent}
    union all
    select query_id, 'agent', {agent_prompt('query', 'companies', R.AGENT_HINTS)} from question where {_to_agent}""",
       ["question", "question_context", "lines"])

# -- facts and texts -------------------------------------------------------

oracle("pivot_facts", """
    select ticker, data_point, string_agg(year || '=' || value, '|' order by year) as series from facts
    where data_point in ('1-URGENT', '2-HIGH', '5-LOW') and year between 1995 and 1998 group by all""", ["facts"])
oracle("yoy_trend", "select data_point, year::int as year, previous_year::varchar as previous_year, pct_change, is_latest from trends", ["trends"])
oracle("trend_text", """
    select ticker, data_point, 'Placeholder: ' || data_point || ' changed by ' || printf('%.2f', pct_change) || '% between '
        || previous_year || ' and ' || year || '.' as message
    from trends where is_latest""", ["trends"])
part("doc_terms", """
    select doc_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'))) as t from documents""")
oracle("compare_texts", f"""
    select a.doc_id as pair_id, {line(both('a.t', 'b.t'))} as shared_terms, {line(without('a.t', 'b.t'))} as own_first,
        {line(without('b.t', 'a.t'))} as own_second,
        round(len({both('a.t', 'b.t')}) / nullif(len(list_distinct(list_concat(a.t, b.t))), 0), 4) as jaccard
    from doc_terms a join (
        select n.doc_id - 1 as doc_id, n.t from doc_terms n union all
        select doc_id, cast([] as varchar[]) from doc_terms where doc_id + 1 not in (select doc_id from doc_terms)
    ) b on b.doc_id = a.doc_id""", ["doc_terms"])
part("doc_postings", """
    select doc_id, term, count(*) as tf from (
        select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from documents) group by all""")
part("doc_idf", """
    select term, ln(((select count(*) from documents)::double + 1) / (count(*) + 1)) + 1 as idf
    from doc_postings group by term""", ["doc_postings"])
part("doc_weights", "select doc_id, term, tf * idf as w from doc_postings join doc_idf using (term)", ["doc_postings", "doc_idf"])
part("doc_norms", "select doc_id, sqrt(sum(w * w)) as norm from doc_weights group by 1", ["doc_weights"])
oracle("compare_weights", """
    select p.doc_id as pair_id, 1 as other, round(coalesce(d.dot / (na.norm * nb.norm), 0), 4) as cosine
    from documents p left join doc_norms na on na.doc_id = p.doc_id left join doc_norms nb on nb.doc_id = p.doc_id + 1
    left join (select a.doc_id, sum(a.w * b.w) as dot from doc_weights a join doc_weights b
               on b.doc_id = a.doc_id + 1 and b.term = a.term group by 1) d on d.doc_id = p.doc_id""", ["doc_weights", "doc_norms"])
part("sents", rf"""
    select doc_id, unnest(s) as sentence, generate_subscripts(s, 1) as pos from (
        select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), '. '), lambda x: {strip('x')}), lambda x: x <> '') as s
        from documents)""")
part("sent_scores", r"""
    select s.doc_id, s.pos, s.sentence, len(regexp_split_to_array(sentence, '\s+')) as n, coalesce(score, 0) as score
    from sents s left join (
        select doc_id, pos, round(avg(idf), 6) as score from (
            select doc_id, pos, unnest(regexp_extract_all(lower(sentence), '[\p{L}\p{N}]+')) as term from sents)
        join doc_idf using (term) group by all) using (doc_id, pos)""", ["sents", "doc_idf"])
oracle("summarize_extractive", """
    select d.doc_id, coalesce(any_value(summary), '') as summary, coalesce(any_value(n_words), 0)::bigint as n_words
    from documents d left join (
        select doc_id, string_agg(sentence, '. ' order by pos) as summary, sum(n)::bigint as n_words from (
            select *, sum(n) over (partition by doc_id order by score desc, pos rows unbounded preceding) as running
            from sent_scores) where running <= 150 or running = n group by doc_id) s on s.doc_id = d.doc_id
    group by d.doc_id""", ["sent_scores"])
oracle("knn_odd_vectors", """
    with odd as (select vec_id, case vec_id % 7 when 1 then list_concat(embedding[1:3]::double[], [null], embedding[5:]::double[])
                     when 2 then list_concat(embedding[1:3]::double[], ['nan'::double], embedding[5:]::double[]) else embedding::double[] end as e from embeddings),
    fine as (select * from odd where vec_id % 7 not in (1, 2)),
    ranked as (select a.vec_id as query_id, b.vec_id as chunk_id,
        round(list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)), 6) as score
        from fine a, fine b),
    numbered as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from ranked)
    select k, query_id, rank::int as rank, chunk_id from numbered, (values (1), (3), (20)) v(k) where rank <= k""")
oracle("chunk_text_recursive", r"""
    with recursive s as (
        select doc_id, text, 1::bigint as p, 0::bigint as n, 0 as i from documents where length(text) > 0
        union all
        select doc_id, text, p + n, case when length(text) - p - n + 1 <= 900 then length(text) - p - n + 1 else
            coalesce(nullif(length(regexp_extract(substring(text, p + n, 900), '(?s)^(.+\n\n)', 1)), 0),
                     nullif(length(regexp_extract(substring(text, p + n, 900), '(?s)^(.+\n)', 1)), 0),
                     nullif(length(regexp_extract(substring(text, p + n, 900), '(?s)^(.+ )', 1)), 0), 900) end, i + 1
        from s where p + n <= length(text)),
    strides as (select doc_id, i - 1 as i, substring(text, p, n) as x from s where i > 0)
    select a.doc_id, a.i::int as chunk_index, a.x || coalesce(substring(b.x, 1, 100), '') as content
    from strides a left join strides b on b.doc_id = a.doc_id and b.i = a.i + 1
    where a.i = 0 or b.x is not null or length(a.x) > 100""".replace("\\n", "\n"))

# -- filing trees ----------------------------------------------------------

_accession = "lpad(page_id::varchar, 10, '0') || '-21-' || lpad((page_id % 1000000)::varchar, 6, '0')"
_filing_page = """case when page_id % 7 = 0 then '<p>no items here</p>' else replace(html, '</article>', '<p>' || chr(160) || 'Item 1A. Risk Factors</p><p>risk '
    || chr(8211) || ' of ' || page_id || '</p><p>Item 7. Discussion</p><p>talk ' || chr(8220) || 'of' || chr(8221) || ' ' || page_id
    || '</p></article>') end"""
part("tree", f"select 'P' || page_id % 20 as ticker, page_id, {_accession} as accession_number, {_filing_page} as html from pages")
oracle("read_documents", f"""
    select ticker, accession_number, 'Name ' || ticker as company,
        case page_id % 5 when 0 then null when 1 then 'full-submission.txt' else 'primary.htm' end as file_name,
        case when page_id % 5 > 0 then length({strip(_page)})::int end as n_chars
    from tree""", ["tree"])
part("tree_sections", """
    select *, unnest([{'i': '1A', 's': 'Risk Factors', 't': 'risk ' || chr(8211) || ' of ' || page_id},
        {'i': '7', 's': 'MD&A', 't': 'talk ' || chr(8220) || 'of' || chr(8221) || ' ' || page_id}]) as x
    from tree where page_id % 5 > 0 and page_id % 7 > 0""", ["tree"])
oracle("ingest", f"""
    select ticker || '_10-K_' || accession_number || '_' || section || '_0' as chunk_id, content, ticker, section, 0::int as chunk_index
    from (select *, case x.i when '1A' then {lit(R.TARGET_SECTIONS["1A"])} else {lit(R.TARGET_SECTIONS["7"])} end as section,
                 x.t as content from tree_sections)""", ["tree_sections"])
oracle("ingest_report", """
    select ticker, accession_number, case when page_id % 5 = 0 then 'no document' when page_id % 7 = 0 then 'no section' else 'read' end as state,
        case when page_id % 5 > 0 and page_id % 7 > 0 then 2 else 0 end::bigint as n_chunks from tree""", ["tree"])

oracle("compose_history", f"""
    select conv_id, turn, role, {strip("content")} as content from (
        select *, case conv_id % 3 when 0 then 0 when 1 then 27 else 33 end as added from m)
    where (length(content) + added) % 7 <> 0
    qualify row_number() over (partition by conv_id order by turn desc) <= 3""", ["m"])

# -- sections by sequence and facts of statements ---------------------------

_ends = "chr(10) || 'Item 7 of this report, and' || chr(10) || 'Item 8, which follows' || chr(10) || 'end of risks'"
oracle("extract_sections_by_sequence", f"""
    select doc_id, section, text from (
        select doc_id, {lit(R.TARGET_SECTIONS["1A"])} as section, {strip(f"text || {_ends}")} as text from documents
        union all
        select doc_id, {lit(R.TARGET_SECTIONS["7"])},
            {strip("lang || ' ' || text || chr(10) || 'Item 1A. Risk Factors' || chr(10) || 'as above'")} from documents where doc_id % 3 > 0)
    where text <> ''""")
part("statement", """
    select page_id as n, 'P' || page_id % 20 as ticker,
        case when page_id % 3 > 0 then '2024-0' || ((page_id // 20) % 9 + 1) || '-01' else '' end as filed,
        unnest(case page_id % 4
            when 0 then [
                {'r': 1, 'c': 1, 'p': 'Revenue', 'y': 2023, 'v': (page_id * 1000 + 37) * 1000.0::decimal(18,2)}, {'r': 1, 'c': 2, 'p': 'Revenue', 'y': 2022, 'v': (page_id * 900 + 11) * 1000.0},
                {'r': 2, 'c': 1, 'p': 'Net income (loss)', 'y': 2023, 'v': (page_id * 10 + 5) * -1000.0}, {'r': 2, 'c': 2, 'p': 'Net income (loss)', 'y': 2022, 'v': (page_id * 7 + 3) * 1000.0},
                {'r': 3, 'c': 1, 'p': 'Earnings per share', 'y': 2023, 'v': 1.25}, {'r': 3, 'c': 2, 'p': 'Earnings per share', 'y': 2022, 'v': -0.5},
                {'r': 4, 'c': 1, 'p': 'Margin', 'y': 2023, 'v': 12.5}]
            when 1 then [
                {'r': 2, 'c': 1, 'p': 'Revenue', 'y': 2023, 'v': (page_id * 1000 + 37) * 1000000.0}, {'r': 2, 'c': 4, 'p': 'Revenue', 'y': 2022, 'v': (page_id * 900 + 11) * 1000000.0},
                {'r': 3, 'c': 1, 'p': 'Net income (loss)', 'y': 2023, 'v': (page_id * 10 + 5) * -1000000.0}, {'r': 3, 'c': 4, 'p': 'Net income (loss)', 'y': 2022, 'v': (page_id * 7 + 3) * 1000000.0}]
            when 2 then [
                {'r': 3, 'c': 1, 'p': 'Net sales / Products', 'y': 2023, 'v': page_id * 1000000000.0 + 500000000}, {'r': 3, 'c': 2, 'p': 'Net sales / Products', 'y': 2022, 'v': 2000000000.0},
                {'r': 4, 'c': 1, 'p': 'Net sales / Services', 'y': 2023, 'v': 3000000000.0}, {'r': 4, 'c': 2, 'p': 'Net sales / Services', 'y': 2022, 'v': 4000000000.0},
                {'r': 5, 'c': 1, 'p': 'Net sales / Total net sales', 'y': 2023, 'v': 3000000000.0}, {'r': 5, 'c': 2, 'p': 'Net sales / Total net sales', 'y': 2022, 'v': 6000000000.0},
                {'r': 6, 'c': 1, 'p': 'Employees (in thousands)', 'y': 2023, 'v': (page_id * 7 + 3) * 1000.0}, {'r': 6, 'c': 2, 'p': 'Employees (in thousands)', 'y': 2022, 'v': 8000.0}]
            else [
                {'r': 1, 'c': 1, 'p': 'Revenue', 'y': 2023, 'v': page_id * 1000.0 + 37}, {'r': 2, 'c': 1, 'p': 'Net income (loss)', 'y': 2023, 'v': page_id * -10.0 - 5},
                {'r': 3, 'c': 1, 'p': 'Revenue', 'y': 2023, 'v': 7.0}] end) as f
    from pages where contains(html, '</article>')""")
oracle("table_facts", """
    select n as page_id, f.r::int as row_no, f.c::int as column_no, f.p as data_point, f.y::int as year, f.v::decimal(18,2) as value
    from statement""", ["statement"])
part("extracted", """
    select ticker, f.p as data_point, f.y::int as year, f.v::decimal(18,2) as value from statement
    qualify row_number() over (partition by ticker, f.p, f.y order by filed desc, n desc, f.r, f.c) = 1""", ["statement"])
oracle("extract_facts", "select * from extracted", ["extracted"])
oracle("extracted_series", """
    select ticker, data_point, string_agg(year || '=' || value, '|' order by year) as series from extracted
    where data_point in ('Revenue', 'Net income (loss)', 'Net sales / Products') group by all""", ["extracted"])
part("extracted_last", """
    select *, lag(year) over w as py, lag(value::double) over w as pv from extracted
    window w as (partition by ticker, data_point order by year) qualify row_number() over (partition by ticker, data_point order by year desc) = 1""", ["extracted"])
oracle("extracted_trends", """
    select ticker, data_point, case when py is null then 'Need at least two data points to calculate trend.'
        when pv = 0 then 'Could not calculate trend: division by zero'
        else 'Placeholder: ' || data_point || ' changed by ' || printf('%.2f', round((value::double - pv) / pv * 100, 2)) || '% between '
            || py || ' and ' || year || '.' end as message from extracted_last""", ["extracted_last"])
part("typed_word", r"""
    select p_partkey, regexp_extract(p_name, '(\w+)', 1) as w, 'p' || p_partkey as ticker, p_name as name,
        p_name || ' (p' || p_partkey || ')' as label from part""")
part("typed", """
    select p_partkey as search_id, lower(trim(case when p_partkey % 4 = 0 then w else
        substring(w, 1, 2) || substring(w, 4, 3) || 'x' || substring(w, 7, 20) end)) as text from typed_word""", ["typed_word"])
part("typed_pair", r"""
    select t.search_id, t.text, c.ticker, c.name, c.label, contains(lower(c.label), t.text) as inside,
        list_min(list_transform(regexp_extract_all(lower(c.label), '[\p{L}\p{N}]+'), lambda x: levenshtein(x, t.text))) as near
    from typed t, typed_word c where t.text <> ''""", ["typed", "typed_word"])
oracle("search_companies_typed", """
    select search_id, rank, ticker, name, distance from (
        select search_id, ticker, name, case when inside then 0 else near end::int as distance,
            row_number() over (partition by search_id order by not inside, case when inside then 0 else near end, label, ticker)::int as rank
        from typed_pair
        where inside or near <= case when length(text) >= 8 then 2 when length(text) >= 4 then 1 else 0 end)
    where rank <= 5""", ["typed_pair"])
part("profile_10", profile("m", R.HISTORY_WINDOW), ["m"])
oracle("history_stream", f"""
    select conv_id, {line('topics')} as topics, {line('companies')} as companies, {line('sections')} as sections,
        {line('asked')} as asked from profile_10""", ["profile_10"])

# -- both routes and the tree as a source -----------------------------------

part("agent_question", f"select * from question where {_to_agent}", ["question"])
lexical_parts("agentq", "agent_question", 5, ["agent_question"])
part("agentq_trace", f"""
    select query_id, list_sort(list(distinct section)) as sections, {grouped('lower(content)', {t: [t] for t in D.AGENT.topics})} as topics
    from agentq_hits join chunks using (chunk_id) group by query_id""", ["agentq_hits", "chunks"])
part("agentq_1", f"""
    select q.query_id, q.companies, q.answer, coalesce(t.sections, []) as sections, coalesce(h.hist, []) as hist,
        {both(_agent_topics, f"list_concat(coalesce(t.topics, []), {word_tag('lower(q.answer)', D.AGENT.topics)})")} as topics,
        q.companies[1] as company, coalesce(q.companies[1], 'the company') as ref
    from agent_question q left join agentq_trace t using (query_id) left join (
        select conv_id, {grouped('lower(content)', {t: [t] for t in D.AGENT.history_topics})} as hist
        from (select * from before_question qualify row_number() over (partition by conv_id order by turn desc) <= 10)
        where role = 'user' group by 1) h on h.conv_id = q.conv_id""", ["agent_question", "agentq_trace", "before_question"])
part("agentq_2", f"""
    select *, list_filter([
        case when list_has_any(topics, ['financial', 'revenue']) then
            case when list_contains(hist, 'growth') then 'What factors are driving ' || ref || '''s growth according to recent filings?'
            else 'How has ' || ref || '''s financial performance trended over the past 3 years?' end end,
        case when list_contains(sections, 'Risk Factors')
            then 'What strategies does ' || ref || ' mention for mitigating these risks?' end,
        'What does the ' || {without(strings(D.AGENT.sections), 'sections')}[1] || ' section reveal about ' || ref || '?',
        case when len(companies) = 1 and list_contains({strings(D.AGENT.peers)}, company) then 'How does ' || company || '''s approach to '
            || coalesce({both('topics', 'hist')}[1], topics[1], 'business strategy') || ' compare to '
            || {without(strings(D.AGENT.peers), '[company]')}[1] || '?' end], lambda x: x is not null) as s
    from agentq_1""", ["agentq_1"])
part("agentq_3", f"""
    select query_id, list_concat(s, case when len(s) < 2 then {without(
        "[" + ", ".join("replace(" + lit(g) + ", '{company}', ref)" for g in R.AGENT_GENERAL) + "]", "s")}[1:2 - len(s)]
        else cast([] as varchar[]) end)[1:3] as s from agentq_2""", ["agentq_2"])
part("agentq_cited", """
    select query_id, string_agg(c, '|' order by r) as citations from (
        select query_id, ticker || '/' || ticker || '/' || filing_type || ' (Unknown)/' || section as c, min(rank) as r
        from agentq_hits join chunks using (chunk_id) group by all) group by query_id""", ["agentq_hits", "chunks"])
oracle("ask_both_routes", f"""
    select query_id, case when citations is null then {lit(R.NO_HITS_ANSWER)} else answer end as answer,
        coalesce(citations, '') as citations, case when citations is null then '' else {line('s')} end as suggested_queries
    from question left join question_cited using (query_id) join suggested using (query_id) where not {_to_agent}
    union all
    select query_id, answer, coalesce(citations, ''), {line('s')}
    from agent_question left join agentq_cited using (query_id) join agentq_3 using (query_id)""",
       ["question", "question_cited", "suggested", "agent_question", "agentq_cited", "agentq_3"])
_tree_name = "case page_id % 5 when 0 then 'exhibit.pdf' when 1 then 'full-submission.txt' else 'primary.htm' end"
oracle("filing_tree", f"select ticker, '10-K' as filing_type, accession_number, {_tree_name} as file_name from tree", ["tree"])
oracle("filing_tree_stream", f"select ticker, '10-K' as filing_type, accession_number, {_tree_name} as file_name from tree", ["tree"])
