"""DuckDB statements that state the same results independently.

Each statement is put together from common table expressions over the driver's
views.  Only the fixed value lists are shared with the library.
"""

from __future__ import annotations

from bindery.functions import fixed
from bindery.plans.catalog import (
    BASE,
    KEYWORDS,
    MAX_LINES,
    PLANTED,
    SKIP,
    STAMP,
    WARN,
)

OVERHEAD = fixed.EXACT_OVERHEAD
FULL = MAX_LINES - OVERHEAD


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _in(words) -> str:
    return "(" + ", ".join("'" + w + "'" for w in words) + ")"


def _lookup(column: str, values: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in values.items()) + " end"


def _case(column: str, groups: dict[str, str]) -> str:
    arms = " ".join(f"when {column} in {_in(v.split())} then '{k}'" for k, v in groups.items())
    return f"case {arms} end"


DOCS = """
docs0 as (
  select doc_id, source as repo, text as content,
    ['src','src/core','lib','docs','app/models','node_modules/pkg','build',
     'exported_sources_old','tests','','src/core/io'][1 + doc_id % 11] as dir,
    ['.py','.ts','.js','.kt','.swift','.html','.sh','.dart','.md','.json',
     '.xyz','.PY','.swp'][1 + doc_id % 13] as ext,
    ['Dockerfile','package.json','package-lock.json','tsconfig.json','.env',
     '.env.json','build.gradle.kts','Makefile'][1 + (doc_id // 17) % 8] as special
  from documents),
docs as (
  select repo, content,
    case when doc_id % 17 = 0
         then concat_ws('/', nullif(dir, ''), 'd' || doc_id, special)
         else concat_ws('/', nullif(dir, ''), 'f' || doc_id || ext) end as rel_path
  from docs0)"""

EVERY = (
    DOCS
    + """,
every as (
  select repo, rel_path, content from docs
  union all
  select regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), 'pages/p' || page_id || '.html', html from pages
  union all
  select 'chat', 'chat/c' || conv_id || '/t' || turn || '_' || role || '.md', text from conversations
  union all
  select 'bench', 'docs/b' || item_id || '.txt', text from benchmark)"""
)

NAME = "regexp_extract(rel_path, '[^/]*$')"
SUFFIX = f"lower(regexp_extract({NAME}, '^.+(\\.[^.]+)$', 1))"
PARENT = "case when contains(rel_path, '/') then regexp_replace(rel_path, '/[^/]*$', '') else '' end"
TOP = "string_split(rel_path, '/')[1]"
CATEGORY = (
    f"coalesce({_case(NAME, fixed.SPECIAL_NAMES)}, {_case(SUFFIX, fixed.CATEGORY_SUFFIXES)})"
)
ICON = (
    f"coalesce({_lookup(NAME, fixed.NAME_ICONS)}, {_lookup(SUFFIX, fixed.SUFFIX_ICONS)}, "
    + "case category "
    + " ".join(f"when '{c}' then '{i}'" for c, i in fixed.CATEGORY_ICONS.items())
    + f" end, '{fixed.DEFAULT_ICON}')"
)
TYPE_NAME = (
    "case icon "
    + " ".join(f"when '{i}' then '{n}'" for i, n in fixed.ICON_NAMES.items())
    + f" else '{fixed.DEFAULT_ICON_NAME}' end"
)
DESCRIPTION = (
    "case category "
    + " ".join(f"when '{c}' then '{d}'" for c, d in fixed.CATEGORY_DESCRIPTIONS.items())
    + " else category end"
)


def _globs(patterns) -> str:
    tests = [f"rel_path glob '{p}' or {NAME} glob '{p}'" for p in patterns]
    return "(" + " or ".join(tests) + ")"


# DuckDB's glob lets "*" cross "/", as the operator does.
PATH_REASON = f"""case
    when list_has_any(string_split(rel_path, '/'), {_list(fixed.EXCLUDED_PARTS)}) then 'default_excluded_dir'
    when starts_with(rel_path, 'exported_sources') then 'default_excluded_prefix'
    %s
    when {_globs(fixed.EXTRA_PATTERNS)} then 'extra_excluded_pattern'
    when {_globs(fixed.SECRET_PATTERNS)} then 'secret_like_file'
    when {CATEGORY} is null then 'unsupported_type' end"""
REASON = PATH_REASON % ""

LINES = """case when content = '' then []::varchar[]
    else string_split(regexp_replace(content, '\\n$', ''), chr(10)) end"""


def _files(source: str) -> str:
    """Kept files of a listing as the relation ``files``."""
    return f"""
files0 as (
  select repo, rel_path, content, {CATEGORY} as category, {LINES} as lines
  from {source} where {REASON} is null),
files as (
  select *, len(lines)::int as line_count, octet_length(encode(content)) as size_bytes,
    sha256(array_to_string(lines, chr(10))) as sha256
  from files0)"""


WITH_DOCS = f"with recursive {DOCS}, {_files('docs')}"
WITH_EVERY = f"with recursive {EVERY}, {_files('every')}"

CHUNKS = f"""
chunks0 as (
  select repo, rel_path, category, line_count as total_file_lines, lines,
    ceil(line_count / {FULL})::int as chunk_count, unnest(range(1, ceil(line_count / {FULL})::int + 1))::int as chunk_index
  from files where line_count > 0),
chunks as (
  select repo, rel_path, category, chunk_index, chunk_count,
    (chunk_index - 1) * {FULL} + 1 as start_line,
    least(chunk_index * {FULL}, total_file_lines) as end_line,
    total_file_lines,
    least(chunk_index * {FULL}, total_file_lines) - (chunk_index - 1) * {FULL} as line_count,
    array_to_string(lines[(chunk_index - 1) * {FULL} + 1 : chunk_index * {FULL}], chr(10)) as text
  from chunks0)"""

PACKED = f"""
seq as (
  select *, line_count + {OVERHEAD} as need,
    row_number() over (partition by repo order by rel_path, chunk_index) as rn
  from chunks where line_count + {OVERHEAD} <= {MAX_LINES}),
fold as (
  select repo, rn, need as fill, 1 as bundle_id from seq where rn = 1
  union all
  select s.repo, s.rn,
    case when f.fill + s.need > {MAX_LINES} then s.need else f.fill + s.need end,
    case when f.fill + s.need > {MAX_LINES} then f.bundle_id + 1 else f.bundle_id end
  from fold f join seq s on s.repo = f.repo and s.rn = f.rn + 1),
packed as (select s.*, f.bundle_id from seq s join fold f using (repo, rn))"""

PLACED = """
placed as (
  select *,
    (1 + coalesce(sum(need) over before, 0))::int as bundle_start_line,
    (coalesce(sum(need) over before, 0) + need)::int as bundle_end_line,
    (count(*) over before)::int as k
  from packed
  window before as (partition by repo, bundle_id order by rel_path, chunk_index
                    rows between unbounded preceding and 1 preceding))"""

RULE = "=" * 60
HEADER = (
    f"'{RULE}' || chr(10) || '===== BEGIN FILE: ' || rel_path || ' =====' || chr(10) || "
    "'# category : ' || category || chr(10) || '# chunk : ' || chunk_index || '/' || chunk_count || chr(10) || "
    "'# line_range : ' || start_line || '-' || end_line || chr(10) || "
    f"'# total_lines : ' || total_file_lines || chr(10) || '{RULE}'"
)
FOOTER = (
    f"'{RULE}' || chr(10) || '===== END FILE: ' || rel_path || ' (chunk ' || chunk_index || '/' || "
    f"chunk_count || ') =====' || chr(10) || '{RULE}'"
)
BLOCK = f"{HEADER} || text || chr(10) || {FOOTER}"

MANIFEST = f"""
manifest as (
  select repo, p.bundle_id, repo || '_bundle_' || lpad(p.bundle_id::varchar, greatest(3, length(p.bundle_id::varchar))::int, '0') || '_{STAMP}.txt' as bundle,
    rel_path as path, p.category, f.size_bytes, f.sha256, p.total_file_lines,
    p.chunk_index, p.chunk_count, p.start_line as file_start_line, p.end_line as file_end_line,
    p.line_count as file_line_count, bundle_start_line, bundle_end_line, need as bundle_line_count,
    bundle_start_line - k as physical_start_line, bundle_end_line - k as physical_end_line
  from placed p join files f using (repo, rel_path))"""

WITH_PACKED = f"{WITH_DOCS}, {CHUNKS}, {PACKED}"
WITH_MANIFEST = f"{WITH_PACKED}, {PLACED}, {MANIFEST}"

# A budget equal to the overhead leaves the whole budget to a chunk, and then
# every chunk is too long by the overhead.
OVERSIZED = f"""
oversized as (
  select repo, rel_path as path, 'chunk_exceeds_max_lines' as reason, i as chunk_index,
    (least(i * {OVERHEAD}, line_count) - (i - 1) * {OVERHEAD})::int as line_count
  from (select *, unnest(range(1, ceil(line_count / {OVERHEAD})::int + 1))::int as i
        from files where line_count > 0))"""
LARGE = f"""
large as (
  select repo, rel_path as path,
    case when line_count >= {SKIP} then 'large_file_exceeds_skip_threshold' else 'large_file_warning' end as reason,
    line_count, case when line_count >= {SKIP} then {SKIP} else {WARN} end as threshold
  from files where line_count >= {WARN})"""

# Redaction: RE2 has no look-around, so exempt matches are marked with a control
# character first and unmarked afterwards.
JSON_WORDS = (
    "api[_-]?key|token|secret|password|client[_-]?secret|access[_-]?token|refresh[_-]?token|"
    "bearer|auth_token|private[_-]?key|credentials"
)
ENV = (
    "((?:SECRET_KEY|API_KEY|PRIVATE_KEY|SIGNING_KEY|CLIENT_SECRET|API_SECRET|ACCESS_KEY|AUTH_TOKEN|"
    "BEARER_TOKEN|CREDENTIALS|TOKEN|PASSWORD|PASS|SIGNING_SECRET|API_PASSWORD|CLIENT_KEY)[A-Z0-9_]*)"
)
ENV_HEAD = f"(?m)^[ \\t]*(?:export[ \\t]+)?{ENV}[ \\t]*=[ \\t]*"
REDACTIONS = [
    ("-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[^\\n]*?-----END [A-Z0-9 ]*PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----\n<REDACTED>\n-----END PRIVATE KEY-----"),
    ("(?i)(Authorization[ \\t]*:[ \\t]*Bearer[ \\t]+)[A-Za-z0-9\\-_.=]+", "\\1<REDACTED>"),
    ('(?i)("Authorization"[ \\t]*:[ \\t]*")Bearer[ \\t]+[^"\\n]+"', '\\1Bearer <REDACTED>"'),
    ("(?i)((?:x-api-key|api-key|apikey|api_key)[\" \\t:=]+)[\"']?[A-Za-z0-9_\\-.]{8,}[\"']?", "\\1<REDACTED>"),
    ("\\beyJ[A-Za-z0-9_\\-]{10,}\\.[A-Za-z0-9_\\-]{10,}\\.[A-Za-z0-9_\\-]{10,}\\b", "<REDACTED>"),
    ("AKIA[0-9A-Z]{16}", "<REDACTED>"),
    ("gh[pousr]_[A-Za-z0-9_]{36,251}", "<REDACTED>"),
    ("xox[bpors]-[0-9]{10,13}-[0-9]{10,13}[a-zA-Z0-9-]*", "<REDACTED>"),
    ("AIza[0-9A-Za-z\\-_]{35}", "<REDACTED>"),
    ("sk_live_[0-9a-zA-Z]{24,}", "<REDACTED>"),
    ("SK[0-9a-fA-F]{32}", "<REDACTED>"),
    (f'(?i)("(?:{JSON_WORDS})"[ \\t]*:[ \\t]*)"[^"\\n]*"', '\\1"<REDACTED>"'),
    (f"(?im)({JSON_WORDS}|secret[_-]?key|signing[_-]?key)([ \\t]*:[ \\t]*(?:\"\"|''|null|~))([ \\t]|$)", "\\1\x01\\2\\3"),
    (f"(?i)({JSON_WORDS}|secret[_-]?key|signing[_-]?key)[ \\t]*:[ \\t]*([^\\s]+)", "\\1: <REDACTED>"),
    ("\x01", ""),
    ("(?i)\\b((?:token|access_token|refresh_token|api_key|apikey|secret|sig|signature|auth|bearer|password|passwd|pwd)=)[^&\\s\"]+", "\\1<REDACTED>"),
    ("(?i)((?:secret|private|signing)[_-]?key(?:_[a-z]+)?)[ \\t]*=[ \\t]*['\"][A-Za-z0-9+/]{20,}={0,2}['\"]", '\\1="<REDACTED>"'),
    ("(?i)((?:secret|token|password|auth)[_-]?(?:key|value|hash|secret)?)[ \\t]*=[ \\t]*['\"][0-9a-f]{32,}['\"]", "\\1='<REDACTED>'"),
    (ENV_HEAD + '"(?:[^\\n]*")?[ \\t]*$', '\\1=\x01"<REDACTED>"'),
    (ENV_HEAD + "'(?:[^\\n]*')?[ \\t]*$", "\\1=\x01'<REDACTED>'"),
    (ENV_HEAD + "[^\\s\x01][^\\n]*$", "\\1=<REDACTED>"),
    ("\x01", ""),
]


def _sql_text(s: str) -> str:
    s = s.replace("'", "''")
    for ch in ("\x01", "\n"):
        s = s.replace(ch, f"' || chr({ord(ch)}) || '")
    return "'" + s + "'"


def _redacted(column: str, whole: bool = False) -> str:
    out = column
    for pattern, replacement in REDACTIONS:
        if whole:
            pattern = _across_lines(pattern)
        out = f"regexp_replace({out}, {_sql_text(pattern)}, {_sql_text(replacement)}, 'g')"
    return out


def _across_lines(pattern: str) -> str:
    """The pattern with white space and quoted values that may span lines."""
    pattern = pattern.replace("[ \\t]*$", "[ \\x00]*$").replace("[ \\t]", "\\s")
    pattern = pattern.replace('[^"\\n]', '[^"]').replace("[\" \\t:=]", "[\"\\s:=]")
    return pattern.replace("[ \\x00]*$", "[ \\t]*$").replace("KEY-----[^\\n]*?", "KEY-----(?s:.)*?")


#: The steps of REDACTIONS that each rule is made of; a line holds one match of its rule at most.
RULE_STEPS = {
    "private_key_block": [0], "bearer_header": [1], "bearer_json": [2], "api_key_header": [3], "jwt": [4], "aws_key": [5],
    "github_token": [6], "slack_token": [7], "google_key": [8], "stripe_key": [9], "twilio_key": [10], "json_secret": [11],
    "yaml_secret": [12, 13, 14], "url_secret": [15], "base64_secret": [16], "hex_secret": [17], "env_secret": [18, 19, 20, 21],
}


def _planted() -> str:
    return f"""named as (select repo, rel_path, content, sha256(repo || '/' || rel_path) as name from every),
        planted as (select repo, rel_path, content || chr(10) || replace(
            ({_list(PLANTED)})[1 + ('0x' || substring(name, 1, 7))::int % {len(PLANTED)}], '@', name) as content from named)"""


def _rule_hits(every: str) -> str:
    """Each rule counts its matches in what the rules before it left."""
    steps, counts, source = [], [], "planted"
    for rule, places in RULE_STEPS.items():
        out, hits = "content", []
        for place in places:
            pattern, replacement = REDACTIONS[place]
            if replacement and rule != "yaml_secret" or place == 13:
                hits.append(f"len(regexp_extract_all({out}, {_sql_text(pattern)}))")
            out = f"regexp_replace({out}, {_sql_text(pattern)}, {_sql_text(replacement)}, 'g')"
        steps.append(f"{rule} as materialized (select {out} as content, {' + '.join(hits)} as n from {source})")
        counts.append(f"select '{rule}' as rule, sum(n)::bigint as hits, count(*) filter (where n > 0) as texts from {rule}")
        source = rule
    return f"{every}, {_planted()}, {', '.join(steps)} select * from ({' union all '.join(counts)}) where hits > 0"


CANONICAL = _lookup("lower(trim(w))", {c: c for c in fixed.CATEGORY_DESCRIPTIONS} | fixed.CATEGORY_ALIASES)
TYPED = (
    f"[' ' || substring({SUFFIX}, 2, 100), upper({TOP}), replace({SUFFIX}, '.', '')]"
)


# Typed paths ------------------------------------------------------------------


def _first_tier(inputs: str, tier: str, source: str = "files") -> str:
    """Matches of ``inputs(raw)`` at the best tier they have in each repository."""
    return f"""
rated as (
  select f.repo, f.rel_path, f.category, f.line_count, i.raw, {tier} as tier
  from {source} f cross join (select unnest({inputs}) as raw) i),
best as (
  select repo, raw, min(tier) as best from rated group by repo, raw),
hits as (
  select r.* from rated r join best b using (repo, raw) where r.tier = b.best)"""


PATH_INPUTS = _list(["src/core/", "lib", "Dockerfile", "./tests", "/corpus/src1/docs", "gone/x.py"])
PLAIN = (
    f"case when starts_with(raw, '{BASE}/' || f.repo || '/') then substring(raw, length('{BASE}/' || f.repo) + 2) "
    "else rtrim(raw, '/') end"
)
PATH_TIER = f"""case
    when f.rel_path = {PLAIN} or starts_with(f.rel_path, {PLAIN} || '/') then 0
    when raw = './' || f.rel_path then 0
    when not contains(raw, '/') and regexp_extract(f.rel_path, '[^/]*$') = raw then 1 end"""
WORD = (
    f"case when starts_with(raw, '{BASE}/' || f.repo || '/') "
    f"then substring(raw, length('{BASE}/' || f.repo) + 2) else raw end"
)
WORD_TIER = f"""case
    when f.rel_path = {WORD} then 1
    when ends_with(f.rel_path, '/' || {WORD}) then 2
    when starts_with(f.rel_path, {WORD} || '/') or contains(f.rel_path, '/' || {WORD} || '/') then 4
    when contains(f.rel_path, {WORD}) then 5
    when starts_with(replace(f.rel_path, '/', ''), replace({WORD}, '/', '')) then 6 end"""
WORDS = _list(["Dockerfile", "core", "src", "f12", "zzz", "/corpus/src3/lib"])


def _mode(
    mode: str, where: str = "true", categories: str = "", missing: str | None = None,
    names: str = "''", n_paths: str = "0", extra: str = "",
) -> str:
    missing = missing or "''"
    return f"""
select r.repo, '{mode}' as selection_mode, '{categories}' as selected_categories,
  {names} as name_filters, {missing} as missing_paths, {n_paths} as n_paths,
  (select count(*) from files f where f.repo = r.repo and ({where})) as files,
  coalesce((select sum(line_count)::bigint from files f where f.repo = r.repo and ({where})), 0) as lines
from (select distinct repo from files) r {extra}"""


SRC = "(starts_with(f.rel_path, 'src/') or contains(f.rel_path, '/src/'))"


# File trees -------------------------------------------------------------------

TREE = f"""
t_files as (
  select repo, rel_path, {NAME} as name, {PARENT} as parent, {ICON} as icon
  from files),
t_place as (
  select *, string_split(parent, '/')[1] as top,
    row_number() over (partition by repo, parent order by name) as file_no,
    count(*) over (partition by repo, parent) as n_here,
    max(parent) over (partition by repo, string_split(parent, '/')[1]) as last_parent,
    count(distinct parent) over (partition by repo, string_split(parent, '/')[1]) as n_dirs,
    max(nullif(string_split(parent, '/')[1], '')) over (partition by repo) as last_top,
    count(*) filter (where parent = '') over (partition by repo) as root_files
  from t_files),
t_style as (
  select *,
    parent <> '' and n_dirs = 1 and parent = top as alone,
    top = last_top and root_files = 0 as end_top,
    parent = last_parent as end_dir,
    file_no = n_here as end_file
  from t_place),
t_lines as (
  select distinct repo, 0 as sec, 0::bigint as rank, '' as top, '' as parent, 0 as kind, '' as name, repo || '/' as text from t_files
  union all
  select repo, 1, 0, '', '', 1, name,
    case when end_file and last_top is null then '└── ' else '├── ' end || icon || ' ' || name
  from t_style where parent = ''
  union all
  select repo, 2, 0, top, '', 0, '',
    case when bool_or(end_top) then '└── ' else '├── ' end || top || '/' ||
    case when bool_or(alone and n_here <= 3) then ' [' || string_agg(icon || ' ' || name, ', ' order by name) || ']' else '' end
  from t_style where parent <> '' group by repo, top
  union all
  select distinct repo, 2, 0, top, parent, 0, '',
    case when end_top then '    ' else '│   ' end || case when end_dir then '└── ' else '├── ' end ||
    substring(parent, length(top) + 2) || '/'
  from t_style where parent <> top
  union all
  select repo, 2, 0, top, parent, 1, name,
    case when end_top then '    ' else '│   ' end ||
    case when parent = top then '' when end_dir then '    ' else '│   ' end ||
    case when end_file and (alone or parent <> top) then '└── ' else '├── ' end || icon || ' ' || name
  from t_style where parent <> '' and not (alone and n_here <= 3)
  union all
  select repo, 6, -count(*), '', '', 0, icon, '  ' || icon || ' ' ||
    rpad({TYPE_NAME}, greatest(12, length({TYPE_NAME}))::int, ' ') || ' × ' || count(*)
  from t_files group by repo, icon
  union all
  select repo, 8, 0, '', '', 0, '', '  📁  Total: ' || count(*) || ' files' from t_files group by repo
  union all
  select repo, sec, 0, '', '', 0, '', text from (select distinct repo from t_files),
    (values (3, ''), (4, '{"─" * 40}'), (5, '📊 File Summary:'), (7, '  ───')) v(sec, text))"""


# Overview ---------------------------------------------------------------------

TIER = (
    f"case when {NAME} in {_in(fixed.ENTRY_NAMES)} then 1 when {NAME} in {_in(fixed.CONFIG_NAMES)} then 2 "
    f"when {TOP} in {_in(fixed.KEY_DIRS)} then 3 end"
)
FRAMEWORKS = "frameworks as (" + " union all ".join(
    f"select distinct repo, {i} as place, '{name}' as framework from files where "
    + " or ".join(f"ends_with({NAME}, '{e}')" for e in endings.split())
    for i, (name, endings) in enumerate(fixed.FRAMEWORK_ENDINGS.items(), 1)
) + ")"
CATEGORY_TABLE = f"""
category_table as (
  select repo, category, count(*) as files, sum(line_count)::bigint as lines, sum(size_bytes)::bigint as bytes,
    {DESCRIPTION} as description,
    row_number() over (partition by repo order by count(*) desc, min(rel_path))::int as place
  from %s group by repo, category)"""
FOLDERS = f"""
folders as (
  select repo, case when len(string_split(rel_path, '/')) = 1 then '.' else {TOP} end as folder,
    count(*) as files, sum(line_count)::bigint as lines
  from %s group by all),
folder_places as (
  select *, row_number() over (partition by repo order by files desc, folder)::int as place from folders)"""
READING = f"""
reading as (
  select repo, rel_path, {TIER} as tier,
    row_number() over (partition by repo order by {TIER}, rel_path)::int as place
  from files where {TIER} is not null)"""
DEPS = f"""
deps as (
  select repo, rel_path, row_number() over (partition by repo order by rel_path) as place
  from files where {NAME} in {_in(fixed.DEPENDENCY_NAMES)})"""


def _wide(label: str, width: int) -> str:
    return (
        f"'  ' || rpad({label}, greatest({width}, length({label}))::int, ' ') || ' ' || "
        "lpad(files::varchar, greatest(4, length(files::varchar))::int, ' ') || ' files  ' || "
        "lpad(lines::varchar, greatest(7, length(lines::varchar))::int, ' ') || ' lines'"
    )


OVERVIEW = f"""
chosen as (select * from files where category in ('python', 'config_docs', 'web_ui')),
trees as (
  select repo, count(*) as n, count({TIER}) as n_read from files
  where repo in (select repo from chosen) group by repo),
heads(section, title) as (values (1, '📊 PROJECT STATISTICS'), (2, '🚀 DETECTED FRAMEWORKS'),
  (3, '📦 DEPENDENCY FILES'), (4, '📁 FILES BY CATEGORY'), (5, '📂 TOP FOLDERS'),
  (6, '📖 SUGGESTED READING ORDER')),
body as (
  select repo, 1 as section, 1 as ord, '  Total files in project: ' || n as text from trees
  union all select repo, 1, 2, '  Files exported: ' || count(*) from chosen group by repo
  union all select repo, 1, 3, '  Selection mode: category' from trees
  union all select repo, 2, place, '  • ' || framework from frameworks
  union all select repo, 3, place, '  • ' || rel_path from deps where place <= 10
  union all select repo, 4, place, {_wide('category', 15)} || '  | ' || description from category_table
  union all select repo, 5, place, {_wide('folder', 20)} from folder_places where place <= 10
  union all select repo, 6, place, '  ' || lpad(place::varchar, 3, ' ') || '. ' || rel_path from reading where place <= 20
  union all select repo, 6, 999999, '  ... and ' || (n_read - 20) || ' more' from trees where n_read > 20),
overview as (
  select * from body where repo in (select repo from trees)
  union all
  select distinct b.repo, h.section, e.ord, case e.ord when -2 then h.title when -1 then '{"-" * 40}' else '' end
  from body b join heads h using (section) cross join (values (-2), (-1), (1000000)) e(ord)
  where b.repo in (select repo from trees)
  union all
  select repo, section, ord, text from trees cross join lateral (values
    (0, 1, '{RULE}'), (0, 2, 'PROJECT OVERVIEW: ' || repo), (0, 3, '{RULE}'),
    (0, 4, 'Generated: 2026-01-02T03:04:05+00:00'), (0, 5, 'Manifest: ' || repo || '_manifest_{STAMP}.json'),
    (0, 6, ''), (7, 1, '{RULE}'), (7, 2, 'END OF PROJECT OVERVIEW'), (7, 3, '{RULE}')) v(section, ord, text))"""

MANIFEST_ROW = ", ".join(
    f"'{c}': {c}"
    for c in (
        "path category size_bytes sha256 total_file_lines chunk_index chunk_count file_start_line "
        "file_end_line file_line_count bundle_start_line bundle_end_line bundle_line_count"
    ).split()
)

TREE_TEXT = """
tree_text as (
  select repo, count(*) as n, string_agg(text, chr(10) order by sec, rank, top, parent, kind, name) as text
  from t_lines group by repo)"""
TREE_NAME = f"repo || '_file_tree_{STAMP}.txt'"
MANIFEST_WITH_TREE = f"""
shifted as (
  select m.* replace (
    bundle_start_line + case when bundle_id = 1 then n + 6 else 0 end as bundle_start_line,
    bundle_end_line + case when bundle_id = 1 then n + 6 else 0 end as bundle_end_line,
    physical_start_line + case when bundle_id = 1 then n + 6 else 0 end as physical_start_line,
    physical_end_line + case when bundle_id = 1 then n + 6 else 0 end as physical_end_line)
  from manifest m join tree_text using (repo)
  union all by name
  select repo, 1 as bundle_id, repo || '_bundle_001_{STAMP}.txt' as bundle, {TREE_NAME} as path, 'filetree' as category,
    length(text) as size_bytes, '' as sha256, n + 6 as total_file_lines, 1 as chunk_index, 1 as chunk_count,
    1 as file_start_line, n + 6 as file_end_line, n + 6 as file_line_count, 1 as bundle_start_line,
    n + 6 as bundle_end_line, n + 6 as bundle_line_count, 1 as physical_start_line, n + 6 as physical_end_line
  from tree_text)"""
WITH_TREE = f"{WITH_MANIFEST}, {TREE}, {TREE_TEXT}, {MANIFEST_WITH_TREE}"

JSON_SKIP = """case when stage = 1
    then to_json({'path': path, 'reason': reason, 'line_count': line_count, 'threshold': threshold})::varchar
    else to_json({'path': path, 'reason': reason, 'line_count': line_count, 'max_lines': max_lines})::varchar end"""
FRAME = [
    (0, "'{'"),
    (0, "'\"tool\": \"bindery\",'"),
    (0, "'\"created_at_utc\": \"then\",'"),
    (0, f"'\"project_root\": \"{BASE}/' || repo || '\",'"),
    (0, f"'\"max_lines_per_bundle\": {MAX_LINES},'"),
    (0, "'\"bundle_count\": ' || n_bundles || ','"),
    (0, "'\"skip_secret_like_files\": true,'"),
    (0, "'\"selection\": {'"),
    (0, "'\"selection_mode\": \"non_interactive\",'"),
    (0, "'\"selected_categories\": [],'"),
    (0, "'\"name_filters\": [],'"),
    (0, "'\"missing_paths\": ' || missing || ','"),
    (0, "'\"selected_paths\": ['"),
    (2, "']},'"),
    (2, "'\"selected_files\": ['"),
    (4, "'],'"),
    (4, f"'\"filetree\": \"' || {TREE_NAME} || '\",'"),
    (4, "'\"summary\": {'"),
    (4, "'\"selected_file_count\": ' || n_files || ','"),
    (4, "'\"selected_total_lines\": ' || n_lines || ','"),
    (4, "'\"selected_total_bytes\": ' || n_bytes || ','"),
    (4, "'\"skipped_counts\": {' || reasons || '},'"),
    (4, "'\"skipped_during_pack_count\": ' || n_skips || '},'"),
    (4, "'\"skipped_during_pack\": ['"),
    (6, "'],'"),
    (6, "'\"bundles\": ['"),
    (8, "']'"),
    (8, "'}'"),
]
MANIFEST_LINES = f"""
skips as (
  select repo, 1 as stage, path, reason, line_count, threshold, null::int as max_lines, 0 as chunk_index from large
  union all select repo, 2, path, reason, line_count, null::int, {OVERHEAD}, chunk_index from oversized),
totals as (
  select repo, count(*) as n_files, sum(line_count)::bigint as n_lines, sum(size_bytes)::bigint as n_bytes,
    (select max(bundle_id) from packed p where p.repo = f.repo) as n_bundles,
    (select count(*) from skips s where s.repo = f.repo) as n_skips,
    case when bool_or(starts_with(rel_path, 'src/')) then '["gone.py"]' else '["gone.py","src","src/"]' end as missing,
    (select string_agg('"' || reason || '":' || n, ',' order by reason) from (
       select repo, {REASON} as reason, count(*) as n from docs where {REASON} is not null group by all) r
     where r.repo = f.repo) as reasons
  from files f group by repo)
select repo, sec, rank, '' as key, text from totals cross join lateral (values
  {", ".join(f"({sec}, {i}, {text})" for i, (sec, text) in enumerate(FRAME))}) v(sec, rank, text)
union all
select repo, 1, 0, path, case when path = 'gone.py' then '  ' else ' ,' end || '"' || path || '"'
from totals cross join (values ('gone.py'), ('src')) v(path)
union all
select repo, 3, 0, rel_path,
  case when row_number() over (partition by repo order by rel_path) = 1 then '  ' else ' ,' end || '"' || rel_path || '"'
from files
union all
select repo, 5, stage, path || chr(0) || lpad(chunk_index::varchar, 10, '0'),
  case when row_number() over (partition by repo order by stage, path, chunk_index) = 1 then '  ' else ' ,' end || {JSON_SKIP}
from skips
union all
select repo, 7, bundle_id, '', case when bundle_id = 1 then '  ' else ' ,' end ||
  to_json({{'bundle': any_value(bundle), 'files': list({{{MANIFEST_ROW}}} order by bundle_start_line)}})::varchar
from shifted group by repo, bundle_id"""

IGNORE = """
trees0 as (select source as repo, min(doc_id) as low, max(doc_id) as high from documents group by source),
listing as (
  select repo, rel_path from docs
  union all select repo, '.gitignore' from trees0),
ignored as (
  select l.repo, l.rel_path,
    case
      when regexp_matches(rel_path, '^tests/f[^/][13579][^/]*(/|$)') then true
      when regexp_matches(rel_path, '^(.*/)?f' || high || '\\.[a-z][^/]*(/|$)') then true
      when regexp_matches(rel_path, '\\.dart(/|$)') then false
      when regexp_matches(rel_path, '^src/(.*/)?io(/|$)') then true
      when regexp_matches(rel_path, '(^|/)f' || low || '\\.[^/]*(/|$)') then true
      when starts_with(rel_path, 'docs/') then true
      when regexp_matches(rel_path, '\\.html(/|$)') then true
      else false end as hit
  from listing l join trees0 using (repo))"""


def statements() -> dict[str, str]:
    every, docs = f"with {EVERY}", f"with {DOCS}"
    out = {
        "scan_files": f"{WITH_EVERY} select repo, rel_path, category, line_count, size_bytes, sha256 from files",
        "ignore_reason": f"{every} select repo, rel_path, coalesce({REASON}, '') as reason from every",
        "skip_counts": f"{every} select repo, reason, count(*) as files from (select repo, {REASON} as reason from every) where reason is not null group by all",
        "ignore_patterns": f"""{docs}, {IGNORE}
            select repo, u.ordinal - 1 as ordinal, u.pattern from trees0, lateral (
              select unnest(p) as pattern, generate_subscripts(p, 1) as ordinal from (select
                ['# written for this tree', '*.html', '/docs/', 'f' || low || '.*', 'src/**/io', '!*.dart', '',
                 '**/f' || high || '.[a-z]*', 'tests/f?[13579]*', '\\#odd'] as p)) u""",
        "gitignore_filter": f"""{docs}, {IGNORE}
            select repo, rel_path from ignored
            where hit and not list_has_any(string_split(rel_path, '/'), {_list(fixed.EXCLUDED_PARTS)})
              and not starts_with(rel_path, 'exported_sources')""",
        "binary_sniff": f"{every} select repo, rel_path, octet_length(encode(content)) < 4096 as is_binary from every",
        "decode_lines": f"{every} select repo, rel_path, len({LINES})::int as line_count, array_to_string({LINES}, '|') as lines from every",
        "decode_fallback": f"{docs} select repo, rel_path, content as decoded from docs",
        "file_lines": f"{WITH_DOCS} select repo, rel_path, unnest(lines) as line, generate_subscripts(lines, 1)::int as line_no from files",
        "skip_dir": f"{every} select repo, rel_path from every where list_has_any(string_split(rel_path, '/'), {_list(fixed.EXCLUDED_PARTS)})",
        "skip_prefix": f"{every} select repo, rel_path from every where rel_path like 'exported#_sources%' escape '#'",
        "glob_match": f"{every} select repo, rel_path from every where {_globs(fixed.EXTRA_PATTERNS + ['src/*io/f*.??', '[!a-f]1*.kt', 't*s'])}",
        "secret_like_files": f"{every} select repo, rel_path from every where {_globs(fixed.SECRET_PATTERNS)}",
        "detect_category": f"{every} select repo, rel_path, coalesce({CATEGORY}, '') as category from every",
        "path_suffix": f"{every} select repo, rel_path, {SUFFIX} as suffix from every",
        "path_parts": f"""{every} select repo, rel_path, len(string_split(rel_path, '/'))::int as depth, {NAME} as name,
            {PARENT} as parent, coalesce(nullif(array_to_string(list_slice(string_split(rel_path, '/'), 1,
              least(len(string_split(rel_path, '/')), 3) - 1), '/'), ''), '.') as folder from every""",
        "file_icon": f"{every} select repo, rel_path, {ICON} as icon from (select *, {CATEGORY} as category from every)",
        "icon_name": f"""{every} select repo, {TYPE_NAME} as type_name, count(*) as files from
            (select repo, {ICON} as icon from (select *, {CATEGORY} as category from every)) group by all""",
        "parse_csv": f"""{every} select repo, rel_path, array_to_string(list_filter(list_transform(string_split(content, ','),
            lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), '|') as words from every""",
        "parse_tokens": f"""{every} select repo, rel_path, array_to_string(list_filter(
            regexp_split_to_array(content, '[,;\\s]+'), lambda x: x <> ''), '|') as words from every""",
        "normalize_categories": f"""{every}, w as (select repo, rel_path, unnest({TYPED}) as w, generate_subscripts({TYPED}, 1) as i from every),
            k as (select repo, rel_path, {CANONICAL} as category, min(i) as i from w group by all)
            select repo, rel_path, coalesce(string_agg(category, ',' order by i), '') as categories from k group by all""",
        "invalid_categories": f"""{every}, w as (select repo, rel_path, unnest({TYPED}) as w, generate_subscripts({TYPED}, 1) as i from every)
            select repo, rel_path, coalesce(string_agg(w, ',' order by i) filter (where {CANONICAL} is null), '') as unknown from w group by all""",
        "normalize_paths": f"""{every} select repo, rel_path, rel_path as inside, '/elsewhere/' || rel_path as outside,
            {PARENT} as relative from every""",
        "selected_paths": f"""{WITH_DOCS}, repos as (select distinct repo from files)
            select repo, unnest(['src', 'lib'] || case when repo = 'src1' then ['docs', '.'] else ['/corpus/src1/docs', '/corpus/src1'] end) as path from repos""",
        "run_timestamp": f"""select event_id, strftime(ts, '%Y%m%dT%H%M%SZ') as stamp, value > 5 as is_stamp,
            case when value > 5 then strftime(ts, '%Y%m%dT%H%M%SZ') else '{STAMP}' end as dir_stamp from events""",
        "content_sha256": f"{every} select repo, rel_path, sha256(regexp_replace(content, '\\n$', '')) as sha256 from every",
        "file_sizes": f"{every} select repo, rel_path, len({LINES})::int as line_count, octet_length(encode(content)) as size_bytes from every",
        "redact_text": f"{every} select repo, rel_path, {_redacted('content')} as redacted from every",
        "redact_whole_text": f"{every} select repo, rel_path, {_redacted('content', whole=True)} as redacted from every",
        "redact_rule_hits": _rule_hits(every),
        "redact_planted": f"{every}, {_planted()} select repo, rel_path, {_redacted('content')} as redacted from planted",
        "select_categories": f"{WITH_DOCS} select repo, rel_path from files where category in ('python', 'config_docs', 'web_ui')",
        "select_name_filters": f"{WITH_DOCS} select repo, rel_path from files where regexp_matches({NAME}, '(?i)f12|docker|\\.kt')",
        "select_keywords": f"{WITH_EVERY} select repo, rel_path from files where " + " or ".join(
            f"contains(lower(content), '{k.lower()}')" for k in KEYWORDS[1:]),
        "matched_keywords": f"""{WITH_EVERY} select repo, keyword, count(*) as files from files,
            (select unnest({_list([k.lower() for k in KEYWORDS])}) as keyword) where contains(lower(content), keyword) group by all""",
        "select_paths": f"{WITH_DOCS}, {_first_tier(PATH_INPUTS, PATH_TIER)} select distinct repo, rel_path from hits",
        "missing_paths": f"""{WITH_DOCS}, {_first_tier(PATH_INPUTS, PATH_TIER)}
            select repo, raw as input from best where best is null""",
        "smart_paths": f"""{WITH_DOCS}, {_first_tier(WORDS, WORD_TIER)}
            select repo, raw as word, tier, rel_path from hits""",
        "mode_path_missing": f"""{WITH_DOCS}, {_first_tier(WORDS, WORD_TIER)}, chosen as (select distinct repo, rel_path from hits)
            select repo, rel_path from chosen except select repo, {TOP} from chosen""",
        "select_non_interactive": f"""{WITH_DOCS}, chosen as (select * from files where category in ('python', 'config_docs', 'web_ui')),
            {_first_tier(PATH_INPUTS, PATH_TIER, 'chosen')} select distinct repo, rel_path from hits""",
        "select_mixed": f"""{WITH_DOCS}, {_first_tier("['core', 'tests']", WORD_TIER)}
            select distinct repo, rel_path from hits where category in ('python', 'config_docs', 'web_ui')
              and regexp_matches({NAME}, '(?i)1|md')""",
        "select_modes": f"{WITH_DOCS}, modes as ("
        + " union all ".join(
            [
                _mode("all"),
                _mode("category", "f.category in ('python', 'config_docs', 'web_ui')", "python,config_docs,web_ui"),
                _mode("path", SRC, missing="'zzz'", n_paths=f"(select count(*) from files f where f.repo = r.repo and {SRC})"),
                _mode("mixed", f"f.category = 'python' and {SRC} and contains(regexp_extract(f.rel_path, '[^/]*$'), 'f1')", "python",
                      names="'f1'", n_paths=f"(select count(*) from files f where f.repo = r.repo and {SRC})"),
                _mode("keyword", "contains(lower(f.content), 'license')",
                      names="case when exists (select 1 from files f where f.repo = r.repo and contains(lower(f.content), 'license')) then 'license' else '' end",
                      n_paths="(select count(*) from files f where f.repo = r.repo and contains(lower(f.content), 'license'))"),
                _mode("non_interactive", "starts_with(f.rel_path, 'lib/')", n_paths="2",
                      missing="case when exists (select 1 from files f where f.repo = r.repo and starts_with(f.rel_path, 'lib/')) then 'gone.py' else 'gone.py,lib/' end"),
            ]
        )
        + ") select * from modes",
        "summary_category": f"""{WITH_EVERY} select repo, category, count(*) as files, sum(line_count)::bigint as lines,
            sum(size_bytes)::bigint as bytes from files group by all""",
        "summary_folders": f"""{WITH_EVERY}, p as (select *, string_split(rel_path, '/') as parts from files)
            select repo, case len(parts) when 1 then '.' when 2 then parts[1] else parts[1] || '/' || parts[2] end as folder,
              count(*) as files, sum(line_count)::bigint as lines from p group by all""",
        "top_folders": f"{WITH_EVERY}, {FOLDERS % 'files'} select * from folder_places where place <= 3",
        "folder_table": f"""{WITH_EVERY}, n as (
            select repo, coalesce(nullif({PARENT}, ''), '.') as folder, count(*) as files, sum(line_count)::bigint as lines
            from files group by all), p as (select *, row_number() over (partition by repo order by files desc, folder)::int as place from n)
            select * from p where place <= 15""",
        "category_table": f"{WITH_EVERY}, {CATEGORY_TABLE % 'files'} select * from category_table",
        "tree_type_counts": f"""{WITH_EVERY}, i as (select repo, {ICON} as icon from files)
            select repo, icon, {TYPE_NAME} as type_name, count(*) as files from i group by all""",
        "detect_frameworks": f"{WITH_DOCS}, {FRAMEWORKS} select repo, place, framework from frameworks",
        "dependency_files": f"{WITH_DOCS}, {DEPS} select repo, rel_path from deps",
        "reading_order": f"{WITH_DOCS}, {READING} select repo, place, tier, rel_path from reading where place <= 20",
        "large_file_bands": f"""{WITH_EVERY} select repo, case when line_count = 0 then 'empty' when line_count >= {SKIP} then 'skip'
            when line_count >= {WARN} then 'warn' else 'ok' end as band, count(*) as files, sum(line_count)::bigint as lines from files group by all""",
        "split_chunks": f"{WITH_EVERY}, {CHUNKS} select * from chunks",
        "oversized_chunks": f"{WITH_DOCS}, {OVERSIZED} select repo, path, reason, chunk_index, line_count, {OVERHEAD} as max_lines from oversized",
        "processing_skips": f"""{WITH_DOCS}, {OVERSIZED}, {LARGE}
            select repo, 1 as stage, path, reason, line_count, threshold, -1 as max_lines, -1 as chunk_index from large
            union all select repo, 2, path, reason, line_count, -1, {OVERHEAD}, chunk_index from oversized""",
        "pack_bundles": f"{WITH_PACKED} select repo, rel_path, chunk_index, need, bundle_id from packed",
        "pack_one_tree": f"""with recursive {EVERY}, one as (select 'everything' as repo, repo || '/' || rel_path as rel_path, content, rel_path as p from every),
            files0 as (select o.repo, o.rel_path, 'any' as category, {LINES} as lines from one o
              where (select {REASON} from (select o.p as rel_path)) is null),
            files as (select *, len(lines)::int as line_count from files0), {CHUNKS}, {PACKED}
            select repo, rel_path, chunk_index, bundle_id from packed""",
        "bundle_positions": f"""{WITH_PACKED}, {PLACED} select repo, bundle_id, rel_path, chunk_index, bundle_start_line, bundle_end_line,
            bundle_start_line - k as physical_start_line, bundle_end_line - k as physical_end_line from placed""",
        "bundle_names": f"""{WITH_PACKED} select distinct repo, bundle_id,
            printf('my_%s_bundle_%03d_{STAMP}.txt', repo, bundle_id) as bundle,
            printf('my_%s_manifest_{STAMP}.json', repo) as manifest, printf('my_%s_file_tree_{STAMP}.txt', repo) as tree,
            printf('exported_sources_my_%s_{STAMP}', repo) as output_dir from packed""",
        "chunk_header": f"{WITH_DOCS}, {CHUNKS} select repo, rel_path, chunk_index, {HEADER} as header from chunks",
        "chunk_footer": f"{WITH_DOCS}, {CHUNKS} select repo, rel_path, chunk_index, {FOOTER} as footer from chunks",
        "render_blocks": f"{WITH_DOCS}, {CHUNKS} select repo, rel_path, chunk_index, {BLOCK} as block from chunks",
        "render_redacted": f"""{WITH_DOCS}, {CHUNKS} select repo, rel_path, chunk_index,
            {HEADER} || chr(10) || {_redacted('text')} || chr(10) || {FOOTER} || chr(10) as block from chunks""",
        "bundle_text": f"""{WITH_PACKED} select repo, bundle_id, count(*) as chunks,
            string_agg({BLOCK}, '' order by rel_path, chunk_index) as text from packed group by all""",
        "chunk_source_join": f"{WITH_MANIFEST} select repo, path, chunk_index, size_bytes, sha256, total_file_lines from manifest",
        "manifest_files": f"{WITH_MANIFEST} select * from manifest",
        "manifest_json": f"""{WITH_MANIFEST} select repo, bundle_id, to_json({{'bundle': any_value(bundle),
            'files': list({{{MANIFEST_ROW}}} order by bundle_start_line)}})::varchar as json from manifest group by all""",
        "manifest_with_tree": f"{WITH_TREE} select * from shifted",
        "manifest_lines": f"{WITH_TREE}, {OVERSIZED}, {LARGE}, {MANIFEST_LINES}",
        "bundle_text_with_tree": f"""{WITH_TREE}, b as (select repo, bundle_id, count(*) as chunks,
            string_agg({BLOCK}, '' order by rel_path, chunk_index) as body from packed group by all)
            select repo, bundle_id, chunks, case when bundle_id = 1 then '{RULE}' || chr(10) || '===== FILETREE: Project Structure =====' ||
              chr(10) || '{RULE}' || chr(10) || text || chr(10) || '{RULE}' || chr(10) || '===== END FILETREE =====' || chr(10) ||
              '{RULE}' || chr(10) else '' end || body as text from b join tree_text using (repo)""",
        "manifest_summary": f"""{WITH_DOCS}, {OVERSIZED}, {LARGE},
            s as (select repo, count(*) as n from (select repo from large union all select repo from oversized) group by repo)
            select repo, count(*) as selected_file_count, sum(line_count)::bigint as selected_total_lines,
              sum(size_bytes)::bigint as selected_total_bytes, coalesce(any_value(s.n), 0) as skipped_during_pack_count
            from files left join s using (repo) group by repo""",
        "run_result": f"""{WITH_PACKED} select repo, count(*) as files_exported,
            coalesce((select max(bundle_id) from packed p where p.repo = f.repo), 0) as bundles_created,
            (select count(*) from packed p where p.repo = f.repo) as chunks from files f group by repo""",
        "tree_lines": f"""{WITH_EVERY}, {TREE} select repo, text,
            row_number() over (partition by repo order by sec, rank, top, parent, kind, name)::int as line_no from t_lines""",
        "project_overview": f"""{WITH_DOCS}, {FRAMEWORKS}, {DEPS}, {READING}, {OVERVIEW.split('trees as')[0].rstrip().rstrip(',')},
            {CATEGORY_TABLE % 'chosen'}, {FOLDERS % 'chosen'}, trees as{OVERVIEW.split('trees as', 1)[1]}
            select repo, section::int as section, ord::int as ord, text from overview""",
    }
    out["written_documents"] = f"""{WITH_EVERY},
        texts as (select repo, category || '.txt' as doc, string_agg(rel_path || chr(10), '' order by rel_path) as text from files group by all)
        select repo, doc, octet_length(encode(text))::bigint as size_bytes, sha256(text) as sha256 from texts"""
    out["one_scan_many_exports"] = f"""{WITH_DOCS},
        chosen as (
          select 'all' as export, * from files
          union all select 'category', * from files where category in {_in(["python", "config_docs", "web_ui"])}
          union all select 'keyword', * from files where contains(lower(array_to_string(lines, chr(10))), 'license'))
        select export, repo, count(*) as files, sum(line_count)::bigint as lines, sum(size_bytes)::bigint as bytes, min(sha256) as first_hash
        from chosen group by all"""
    return out
