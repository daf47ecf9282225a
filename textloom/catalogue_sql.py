"""DuckDB SQL of the registered queries, for comparison."""

from __future__ import annotations

W = r"\p{L}\p{M}\p{N}"

#: Lines of the documents: path, line, text, folded text.
LINES = """files as (select concat(source, '/', lang, '/', doc_id, '.txt') as path, text from documents where text <> ''),
lined as (select path, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) as raw, generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) as line from files),
units as (select path, cast(line as bigint) as line, regexp_replace(raw, '\\r+$', '') as t, replace(lower(regexp_replace(raw, '\\r+$', '')), 'ß', 'ss') as b from lined)"""
CELLS = """cells as (select p_partkey + 1 as r, unnest([1, 2, 3, 4]) as c, unnest([p_name, p_brand, p_type, cast(p_size as varchar)]) as t from part)"""


def whole(c: str, t: str, extra: str = "") -> str:
    return f"regexp_matches({c}, '(?:^|[^{W}{extra}]){t}(?:$|[^{W}{extra}])')"


def kind(t: str) -> str:
    f = t.lower()
    return f"case when {whole('t', t)} then 'exact' when {whole('b', f)} then 'caseFolded' when contains(b, '{f}') then 'substring' end"


def score(t: str) -> str:
    f = t.lower()
    return f"cast(case when {whole('t', t)} then 100 when {whole('b', f)} then 98 when contains(b, '{f}') then 70 end as bigint)"


def start(t: str) -> str:
    """0-based start, in the line as it stands, of the match that ``kind`` names; for terms without s (ß is one character there)."""
    f = t.lower()
    at = lambda c, x: f"length(regexp_extract({c}, '(?s)^(.*?)(?:^|[^{W}]){x}(?:$|[^{W}])', 1)) + case when regexp_matches({c}, '^{x}(?:$|[^{W}])') then 0 else 1 end"
    return f"cast(case when {whole('t', t)} then {at('t', t)} when {whole('b', f)} then {at('lower(t)', f)} else instr(lower(t), '{f}') - 1 end as bigint)"


PLAIN = f"with {LINES} select path, line, {kind('thtion')} as kind, {score('thtion')} as score from units where contains(b, 'thtion')"
HITS = f"{LINES}, terms as (select * from (values ('batch:1', 'thtion', 0), ('batch:2', 'the', 1), ('batch:3', 'absent-term', 2), ('batch:4', 'Tion', 3)) v(term_id, term, ord)), hits as ({' union all '.join(f'''select path, line, 'batch:{i}' as term_id, '{t.lower()}' as term_key, {score(t)} as score from units where contains(b, '{t.lower()}')''' for i, t in ((1, 'thtion'), (2, 'the'), (3, 'absent-term'), (4, 'Tion')))})"
RANK = f"""{HITS}, per as (select path, term_key, max(score) as best from hits group by all), q as (select path, min(best) as quality, count(*) as matched_terms from per group by path),
pl as (select path, least(count(distinct line), 5) as distinct_evidence from hits group by path),
rk as (select q.path, quality, matched_terms, distinct_evidence, row_number() over (order by quality desc, matched_terms desc, distinct_evidence desc, replace(lower(q.path), 'ß', 'ss'), q.path) as file_rank from q join pl using (path))"""
PATHS = "paths as (select concat('/r/', source, '/', lang, '/', case when doc_id % 3 = 0 then '~$' else '' end, doc_id, '.', ['txt', 'MD', 'docx', 'exe', 'py'][doc_id % 5 + 1]) as path, doc_id % 5 as e, doc_id % 3 as l from documents)"
PREVIEW = f"""{LINES}, h as (select path, line, t, {start('thtion')} as s, {start('thtion')} + 6 as e, length(t) as n from units where contains(b, 'thtion')),
w as (select *, least(greatest(s - 60, 0), n) as a from h), v as (select *, least(a + greatest(180, e - a + 60), n) as z from w),
pv as (select path, line, case when n <= 240 then t else concat(case when a > 0 then '… ' else '' end, substr(t, a + 1, z - a), case when z < n then ' …' else '' end) end as preview, n > 240 as truncated,
cast(case when n <= 240 then s else s - a + case when a > 0 then 2 else 0 end end as bigint) as start_at, cast(case when n <= 240 then e else e - a + case when a > 0 then 2 else 0 end end as bigint) as end_at from v)"""


def cond(group: str, all_: list[str], any_: list[str], none: list[str], c: str = "b") -> str:
    has = lambda t: f"bool_or(contains({c}, '{t}'))"
    parts = [has(t) for t in all_] + ([f"({' or '.join(has(t) for t in any_)})"] if any_ else []) + [f"not {has(t)}" for t in none]
    return f"group by {group} having {' and '.join(parts)}"


SAFE = "case when regexp_matches({0}, '^[\\s\\x00-\\x1f]*[=+\\-@]') then concat('''', {0}) else {0} end"
TOKEN = r"[A-Z]+(?:[^a-z]|$)"

#: Lines with their loose form and tokens (cut at case changes and between letters and digits).
LOOSE = f"""{LINES}, lt as (select path, line, b, regexp_replace(b, '[\\s_\\-./]', '', 'g') as x, list_transform(regexp_extract_all(regexp_replace(regexp_replace(t, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z]+|[0-9]+'), lambda w: lower(w)) as ws from units)"""

#: The same with tokens of all scripts, as an index has them.
SCRIPTS = f"""{LINES}, lt as (select path, line, b, regexp_replace(b, '[\\s_\\-./]', '', 'g') as x, list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([0-9])([^0-9\\s])', '\\1 \\2', 'g'), '([^0-9\\s])([0-9])', '\\1 \\2', 'g'), '[{W}]+'), lambda w: replace(lower(w), 'ß', 'ss')) as ws from units)"""


def near(first: str, low: int, high: int) -> str:
    return f"len(list_filter(ws, lambda w: starts_with(w, '{first}') and length(w) between {low} and {high})) > 0"


INGTHEA = f"((contains(x, 'ing') and contains(x, 'ngt') and contains(x, 'gth')) or {near('i', 6, 8)})"
THTION = f"((contains(x, 'tht') and contains(x, 'hti') and contains(x, 'tio')) or {near('t', 5, 7)})"
RANK1 = f"""{HITS}, h1 as (select * from hits where term_key = 'thtion'), q1 as (select path, max(score) as quality, least(count(distinct line), 5) as places from h1 group by path),
r1 as (select path, row_number() over (order by quality desc, places desc, replace(lower(path), 'ß', 'ss'), path) as k from q1)"""


OFFICE = """n as (select n_nationkey as k, n_name from nation), u as (
select 'xlsx' as e, 1 as q, 'cell' as kind, 'body' as class, n_name as t, 'S!A1' as p, k from n
union all select 'xlsx' as e, 2 as q, 'cell' as kind, 'body' as class, cast(k as varchar) as t, 'S!B1' as p, k from n
union all select 'xlsx' as e, 3 as q, 'formula' as kind, 'formula' as class, '=B1+1' as t, 'S!A2 / 数式' as p, k from n
union all select 'xlsx' as e, 4 as q, 'cell' as kind, 'body' as class, cast(k + 1 as varchar) as t, 'S!A2' as p, k from n
union all select 'xlsx' as e, 5 as q, 'excelComment' as kind, 'note' as class, 'note ' || n_name as t, 'S!A1 / コメント 1' as p, k from n
union all select 'xlsx' as e, 6 as q, 'excelComment' as kind, 'note' as class, 'ask ' || n_name as t, 'S!B1 / コメント p' as p, k from n
union all select 'xlsx' as e, 7 as q, 'excelComment' as kind, 'note' as class, 'reply ' || n_name as t, 'S!B1 / コメント q' as p, k from n
union all select 'xlsx' as e, 8 as q, 'shape' as kind, 'body' as class, 'box ' || n_name as t, 'S / Box (B3)' as p, k from n
union all select 'xlsx' as e, 9 as q, 'shape' as kind, 'body' as class, 'old ' || n_name as t, 'S / m (A5)' as p, k from n
union all select 'docx' as e, 1 as q, 'paragraph' as kind, 'body' as class, n_name as t, '本文 段落 1' as p, k from n
union all select 'docx' as e, 2 as q, 'wordTableParagraph' as kind, 'body' as class, 'cell ' || k as t, '表 1 / 行 1 / 列 1 / 段落 1' as p, k from n
union all select 'docx' as e, 3 as q, 'paragraph' as kind, 'body' as class, 'last' as t, '本文 段落 3' as p, k from n
union all select 'docx' as e, 4 as q, 'wordHeader' as kind, 'note' as class, 'head ' || n_name as t, 'ヘッダー w/h.xml first / 段落 1' as p, k from n
union all select 'docx' as e, 5 as q, 'wordComment' as kind, 'note' as class, 'word ' || n_name as t, 'コメント w/c.xml 7 / 段落 1' as p, k from n
union all select 'pptx' as e, 1 as q, 'shape' as kind, 'body' as class, n_name as t, 'スライド 1 / Title' as p, k from n
union all select 'pptx' as e, 2 as q, 'slideTableCell' as kind, 'body' as class, 'slide ' || k as t, 'スライド 1 / Tab / 行 1 / 列 1' as p, k from n
union all select 'pptx' as e, 3 as q, 'note' as kind, 'note' as class, 'talk ' || n_name as t, 'スライド 1 / ノート Notes / 段落 1' as p, k from n
union all select e, 0, 'fileName', 'fileName', concat(k, '.', e), 'ファイル名', k from n, (values ('xlsx'), ('docx'), ('pptx')) v(e))"""


#: 256 words of the documents, those of the smallest digests.
DRAWN = f"""{LINES}, words as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{{5,9}}')) as term from documents), terms as (select term from words order by md5(term), term limit 256),
held as (select term, path, line, t, b from terms join units on contains(b, term))"""


def word(c: str) -> str:
    return f"list_contains(regexp_extract_all({c}, '[{W}]+'), term)"


ORACLE: dict[str, str] = {
    "q09_typo_tokens": f"with {LOOSE}, w as (select path, line, unnest(list_distinct(ws)) as token from lt) select token, count(*) as n from w where token[1] = 't' and length(token) between 5 and 7 and levenshtein(token, 'thtion') = 1 group by token",
    "q62_typo_words": f"with {LOOSE}, k as (select distinct unnest(ws) as token from lt), q as (select distinct word from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from benchmark) where length(word) >= 6), e as (select *, case when length(word) >= 11 then 2 else 1 end as most from q) select word, token, distance from (select word, token, levenshtein(word, token) as distance, most from e join k on word[1] = token[1] and abs(length(word) - length(token)) <= most) z where distance between 1 and most and distance * 5 <= length(word)",
    "q63_range_join": "with l as (select doc_id, doc_id * 7 as a, doc_id * 7 + n_chars % 90 as b from documents), r as (select doc_id as other, doc_id * 6 as c, doc_id * 6 + case when doc_id % 50 = 0 then n_chars % 3000 else n_chars % 12 end as d from documents) select doc_id, count(*) as n, cast(sum(other) as bigint) as others from l join r on a <= d and c <= b group by doc_id",
    "q64_many_contexts": f"with {CELLS}, f as (select * from cells where t <> ''), h as (select r as target, greatest(r - 2, 1) as a, greatest(c - 2, 1) as b from f where contains(lower(t), 'brand#1')), x as (select target, count(*) as cells, cast(sum(length(substr(t, 1, 300))) as bigint) as chars, count(*) filter (where length(t) > 300) as cut from h join f on r between a and a + 4 and c between b and b + 4 group by target), k as (select p_partkey + 1 as k from part), m as (select k as fr, k % 4 + 1 as fc, k + k % 3 as lr, k % 4 + 1 + k % 2 as lc from k), y as (select target, count(*) as merges from h join m on fr <= a + 4 and lr >= a and fc <= b + 4 and lc >= b group by target) select cast(target as bigint) as target, cells, chars, cut, coalesce(merges, 0) as merges from x left join y using (target)",
    "q46_event_protocol": "with f as (select row_number() over (order by cast(n_nationkey as varchar)) as k, contains(lower(n_name), 'an') as h from nation), e as (select * from (values (0, 1, 'started'), (0, 2, 'progress'), (0, 3, 'progress'), (1000000, 1, 'rankingSummary'), (1000000, 2, 'executionSummary'), (1000000, 3, 'finished')) v(k, j, type) union all select k, 1, 'result' from f where h union all select k, 2, 'fileRanked' from f where h union all select k, 3, 'progress' from f) select row_number() over (order by k, j) as sequence, type from e",
    "q59_index_blocks": f"with {SCRIPTS} select path, line from lt where {INGTHEA}",
    "q60_index_stream": f"with {SCRIPTS.replace('from documents where', "from (select source, lang, doc_id, case when doc_id % 11 = 0 then concat(text, chr(10), 'ingthea ', doc_id) else text end as text from documents where text is not null and doc_id % 7 <> 0) where")} select path, line from lt where {INGTHEA}",
    "q61_compaction": f"with {LINES} select (select count(*) from documents) as files, cast(count(*) as bigint) as lines, count(*) filter (where contains(b, 'thtion')) as hits, true as few_segments from units",
    "q56_many_terms": f"with {DRAWN} select terms.term, count(distinct path) as file_count, count(path) as hit_count from terms left join held using (term) group by all",
    "q57_many_kinds": f"with {DRAWN}, k as (select *, case when {word('t')} then 'exact' when {word('b')} then 'caseFolded' else 'substring' end as kind from held) select term, kind, count(*) as n, cast(sum(case kind when 'exact' then 100 when 'caseFolded' then 98 else 70 end) as bigint) as score, count(distinct path) as files from k group by all",
    "q58_many_identifiers": f"with {DRAWN}, i as (select term, path, line from held where list_contains(regexp_extract_all(b, '[{W}_]+'), term)) select terms.term, count(distinct path) as file_count, count(path) as hit_count from terms left join i using (term) group by all",
    "q55_office_units": f"with {OFFICE} select concat('/n/', k, '.', e) as path, cast(q as bigint) as seq, kind as source_kind, class as content_class, t as text, p as place from u",
    "q21_candidates_gram": f"with {LOOSE} select path, line from lt where {INGTHEA}",
    "q21b_index_lookup": f"with {LOOSE.replace(LINES, LINES.replace(LINES[: LINES.index(chr(10))], "files as (select concat('b/', item_id) as path, text from benchmark where text <> ''),"))} select path, line from lt where contains(x, 'th')",
    "q44_width_kana_loose": "select doc_id, md5(replace(lower(text), 'ß', 'ss')) as base, md5(replace(lower(text), 'ß', 'ss')) as width, md5(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\\s_\\-./\\x0B]', '', 'g')) as loose from documents where text is not null",
    "q51_unicode_terms": f"with {LINES} " + " union all ".join(f"select path, line, 'batch:{i}' as term_id from units where contains(b, '{t}')" for i, t in enumerate(("stin", "éri", "ét", "über", "esse", "fin"), 1)),
    "q51b_unicode_conditions": f"with {LINES} select path from units {cond('path', ['ét'], ['stin', 'esse'], ['fin'])}",
    "q52_filter_summary": f"with {PREVIEW}, f as (select path, count(*) as n, count(*) filter (where contains(path, '/en/') and not contains(lower(preview), 'the ')) as k from pv group by path) select count(*) filter (where k > 0) as files, cast(coalesce(sum(k), 0) as bigint) as hits, count(*) as all_files, cast(coalesce(sum(n), 0) as bigint) as all_hits from f",
    "q53_result_types": f"with {LINES}, {CELLS} select * from (select 'txt' as file_type where exists (select 1 from units where contains(b, 'in')) union all select 'xlsx' where exists (select 1 from cells where contains(lower(t), 'in')))",
    "q54_top_comparison": f"with {RANK.replace(HITS, RANK1)} select coalesce(r1.k, rk.file_rank) as rank, r1.path as old_path, rk.path as new_path from (select * from r1 where k <= 5) r1 full join (select * from rk where file_rank <= 5) rk on r1.k = rk.file_rank",
    "q01_plain_standard": PLAIN,
    "q02_match_range": f"with {LINES} select path, line, {kind('Tion')} as kind, {start('Tion')} as start_at, {start('Tion')} + 4 as end_at from units where contains(b, 'tion')",
    "q03_cond_unit": f"with {LINES} select path, line from units where contains(b, 'thtion') and contains(b, 'er') and (contains(b, 'onwh') or contains(b, 'ndly')) and not contains(b, 'heit')",
    "q04_cond_file": f"with {LINES}, every as (select path, b from units union all select concat(source, '/', lang, '/', doc_id, '.txt'), concat(doc_id, '.txt') from documents) select path from every {cond('path', ['thtion', 'er'], ['onwh', 'ndly'], ['heit'])}",
    "q05_cond_row": f"with {CELLS}, f as (select r, lower(t) as b from cells where t <> '') select cast(r as bigint) as sheet_row from f {cond('r', ['brand#1', 'small'], ['ring', 'bolt'], ['promo'])}",
    "q06_rank_files": f"with {RANK} select path, quality, cast(matched_terms as bigint) as matched_terms, cast(distinct_evidence as bigint) as distinct_evidence, file_rank from rk",
    "q07_batch_summary": f"with {HITS} select t.term_id, t.term, count(distinct h.path) as file_count, count(h.path) as hit_count from terms t left join hits h using (term_id) group by all",
    "q08_grams": r"with l as (select item_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) as t, generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) as k from benchmark where text <> ''), f as (select item_id, k, regexp_replace(replace(lower(t), 'ß', 'ss'), '[\s_\-./]', '', 'g') as x from l), g as (select distinct item_id, k, n, substr(x, cast(i as bigint), n) as gram from f, (values (2), (3)) v(n), range(1, 2000) r(i) where i <= length(x) - n + 1) select gram, count(*) as n from g group by gram",
    "q10_batch_matrix": f"with {HITS}, m as (select term_id, split_part(path, '/', 2) as lang from hits) select t.term_id, t.term, {', '.join(f'''count(*) filter (where lang = '{x}') as {x}''' for x in ('de', 'en', 'es', 'fr'))} from terms t left join m using (term_id) group by all",
    "q11_batch_status": f"with {HITS} select term_id, case when count(h.path) = 0 then '指定範囲内で該当なし' else '確認完了' end as status from terms left join hits h using (term_id) group by term_id",
    "q12_identifier_terms": f"with {LINES} select path, line, 'batch:1' as term_id from units where {whole('b', 'the', '_')} union all select path, line, 'batch:2' from units where {whole('b', 'of', '_')}",
    "q13_not_only_literal": f"with {LINES} select path from units {cond('path', ['the'], [], ['thtion', 'idiot'])}",
    "q14_evidence_best": f"with {LINES}, h as (select path, line, 'all:1' as term_id, {score('Tion')} as score from units where contains(b, 'tion') union all select path, line, 'all:2', {score('The')} from units where contains(b, 'the')), r as (select *, row_number() over (partition by path, term_id order by score desc, line) as k from h) select path, term_id, line, score from r where k = 1",
    "q16_same_row_terms": f"with {CELLS}, f as (select r, lower(t) as b from cells), n as (select r, cast(bool_or(contains(b, 'brand#1')) as bigint) + cast(bool_or(contains(b, 'small')) as bigint) + cast(bool_or(contains(b, 'bolt')) as bigint) as n from f group by r) select cast(r as bigint) as sheet_row, n from n where n > 1",
    "q16b_same_row_most": f"with {CELLS}, f as (select r, lower(t) as b from cells), n as (select r, cast(bool_or(contains(b, 'brand#1')) as bigint) + cast(bool_or(contains(b, 'small')) as bigint) + cast(bool_or(contains(b, 'bolt')) as bigint) as n from f group by r) select 'part.xlsx' as path, max(n) as most from n having max(n) > 1",
    "q17_document_order": f"with {LINES} select path, line, row_number() over (partition by path order by line) as rank_in_file from units where contains(b, 'thtion')",
    "q18_result_id": f"with {LINES} select path, line, row_number() over (order by string_split(path, '/'), line) as result_id from units where contains(b, 'thtion')",
    "q19_preview": f"with {PREVIEW} select path, line, preview, truncated, start_at, end_at from pv",
    "q20_tokens": "with w as (select unnest(regexp_extract_all(p_type, '[A-Z]+|[A-Z]?[a-z]+|[0-9]+')) as token from part) select lower(token) as token, count(*) as n from w group by all",
    "q22_candidate_superset": f"with {LOOSE} select count(*) as units, count(*) filter (where {THTION}) as candidates, count(*) filter (where contains(b, 'thtion')) as hits, count(*) filter (where contains(b, 'thtion') and not {THTION}) as lost from lt",
    "q23_index_reuse": "select count(*) filter (where doc_id % 7 <> 0 and doc_id % 11 <> 0) as reused, count(*) filter (where doc_id % 7 = 0 or doc_id % 11 = 0) as extracted from documents",
    "q24_prune_missing": "select concat(source, '/', lang, '/', doc_id, '.txt') as path from documents where lang <> 'en'",
    "q25_ext_filter": f"with {PATHS} select path from paths where e in (0, 1) or (e = 2 and l <> 0)",
    "q26_exclude_dirs": f"with {PATHS} select path from paths where not starts_with(path, '/r/src1/') and not starts_with(path, '/r/src2/en/')",
    "q27_nested_roots": "with r as (select distinct unnest([concat('/r/', source, '/', lang), concat('/r/', source)]) as root from documents) select root from r where root not in ('/r/src0', '/r/src1') and (root not like '/r/%/%' or starts_with(root, '/r/src0/') or starts_with(root, '/r/src1/'))",
    "q28_filename_unit": f"with {LINES}, every as (select path, line, t, b, 'textLine' as source_kind from units union all select concat(source, '/', lang, '/', doc_id, '.txt'), 0, concat(doc_id, '.txt'), concat(doc_id, '.txt'), 'fileName' from documents) select path, line, source_kind, {score('7')} as score from every where contains(b, '7')",
    "q29_filter_path_ext_body": f"with {PREVIEW} select path, line from pv where contains(path, '/en/') and contains(lower(preview), 'the ') and not contains(lower(preview), 'zzz')",
    "q30_directory_rollup": f"with {LINES}, h as (select path, count(*) as n from units where contains(b, 'thtion') group by path) select regexp_replace(path, '/[^/]*$', '') as directory, count(*) as files, cast(sum(n) as bigint) as hits, count(*) filter (where cast(regexp_extract(path, '/([0-9]+)\\.txt$', 1) as bigint) % 10 = 0) as errors from h group by directory",
    "q31_pagination": f"with {RANK} select path, file_rank from rk where file_rank between 201 and 400",
    "q32_context_window": f"with {CELLS} select cast(r as bigint) as sheet_row, cast(c as bigint) as sheet_column, substr(t, 1, 300) as text from cells where r between 1 and 5 and c between 1 and 5 and t <> ''",
    "q33_merge_intersect": f"with {CELLS}, k as (select p_partkey + 1 as k from part), m as (select k as a, k % 4 + 1 as b, k + k % 3 as y, k % 4 + 1 + k % 2 as z from k) select cast(a as bigint) as first_row, cast(b as bigint) as first_column, cast(y as bigint) as last_row, cast(z as bigint) as last_column, t as anchor_text from m left join cells on r = a and c = b where a <= 22 and y >= 18 and b <= 5 and z >= 1",
    "q34_hidden_ranges": "select distinct cast(n as bigint) as number from part, range(15, 61) r(n) where p_partkey % 10 = 0 and n between p_partkey and p_partkey + 3",
    "q35_style_fallback": "select cast(p_partkey as bigint) as sheet_row, cast(c as bigint) as sheet_column, cast(case when p_partkey % 2 = 0 and p_partkey % 4 + 1 = c then p_partkey % 9 when p_partkey % 5 = 0 then p_partkey % 7 when c in (2, 3) then 22 when c = 1 then 21 else 0 end as bigint) as style from part, range(1, 5) r(c)",
    "q36_comment_threads": "select c.conv_id, c.turn, concat('A', c.conv_id + 1) as address from conversations c",
    "q37_vml_comment_anti": "select conv_id, turn from conversations c where not exists (select 1 from conversations a where a.role = 'assistant' and a.conv_id = c.conv_id and a.turn = c.turn)",
    "q38_a1_address": "with k as (select p_partkey + 1 as r, ((p_partkey + 1) * 7) % 16384 + 1 as c from part) select concat(case when c > 702 then chr(cast(65 + (c - 703) // 676 as int)) else '' end, case when c > 26 then chr(cast(65 + (c - 27) // 26 % 26 as int)) else '' end, chr(cast(65 + (c - 1) % 26 as int)), r) as address, cast(r as bigint) as sheet_row, cast(c as bigint) as sheet_column from k",
    "q39_csv_tsv_escape": f"""with s as (select doc_id, source, {SAFE.format("text")} as t from documents) select doc_id, md5(case when regexp_matches(t, '[,"\\r\\n]') then concat('"', replace(t, '"', '""'), '"') else t end) as csv,
        md5(replace(replace(replace(replace(t, '\\', '\\\\'), chr(9), '\\t'), chr(13), '\\r'), chr(10), '\\n')) as tsv, concat(''' =', source) as guarded from s""",
    "q40_labels": f"with {LINES} select path, line, 'テキスト行' as source_label, case {kind('thtion')} when 'exact' then '完全一致' when 'caseFolded' then '表記揺れ' else '部分一致' end as match_label, concat('行 ', line) as place from units where contains(b, 'thtion')",
    "q41_term_dedup": "with w as (select item_id, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) as pos from benchmark), k as (select *, replace(lower(word), 'ß', 'ss') as key from w) select key, arg_min(word, (item_id, pos)) as word from k group by key",
    "q42_issue_dedup": "select distinct user_id as path, event_type as code from events",
    "q43_run_counts": f"with {LINES}, h as (select * from units where contains(b, 'thtion')) select (select count(*) from documents) as discovered, (select count(text) from documents) as processed, (select count(*) from h) as results, (select count(distinct path) from h) as files_hit",
    "q47_stream_plain": PLAIN,
    "q48_range_merge": "with r as (select l_orderkey, cast(l_linenumber as bigint) * 3 as a, cast(l_linenumber as bigint) * 3 + cast(l_quantity as bigint) % 5 as b from lineitem), f as (select * from r where b > a), c as (select *, max(b) over (partition by l_orderkey order by a, b rows between unbounded preceding and 1 preceding) as high from f), g as (select *, sum(case when high >= a then 0 else 1 end) over (partition by l_orderkey order by a, b rows unbounded preceding) as g from c) select l_orderkey, min(a) as start_at, max(b) as end_at from g group by l_orderkey, g",
    "q49_conversations_search": "with l as (select unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) as t from conversations where text <> ''), u as (select t, replace(lower(t), 'ß', 'ss') as b from l) select " + kind("ing") + " as kind, count(*) as n from u where contains(b, 'ing') group by 1",
    "q50_pages_search": "with l as (select url as path, unnest(string_split(regexp_replace(html, '\\n$', ''), chr(10))) as t from pages where html <> ''), u as (select path, t, replace(lower(t), 'ß', 'ss') as b from l) select path, " + kind("article") + " as kind, " + score("article") + " as score from u where contains(b, 'article')",
}
