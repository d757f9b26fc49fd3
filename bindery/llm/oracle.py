"""SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11 = rf"""
with recursive steps as (
    select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: xor(a >> 1, 3988292384 * (a & 1))) as c from range(256) r(i)
),
crc as (select list(c order by i) as t from steps),
runs as (
    select id, run, count(*) as n from (
        select coalesce(doc_id::varchar, '') as id,
               unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) as run
        from documents
    ) where length(run) >= 5 group by 1, 2
),
bytes as (
    select run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda ch:
        case when unicode(ch) < 128 then [unicode(ch)::bigint] else [192 + (unicode(ch)::bigint >> 6), 128 + (unicode(ch)::bigint & 63)] end)) as b
    from runs
),
hashed as (
    select run, n, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) as h
    from bytes, crc
),
edited as (
    select case when h % 97 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n
    from hashed
),
words as (
    select word, sum(n)::bigint as n from edited where length(word) >= 5 group by 1 having sum(n) >= 3
),
places as (select word, unnest(range(length(word))) as i from words),
gaps as (select word, substr(word, 1, i) as head, substr(word, i + 2) as tail from places),
pairs as (
    select x.word as a, y.word as b from gaps x join gaps y on x.head = y.head and x.tail = y.tail and x.word <> y.word
    union select g.word, w.word from gaps g join words w on w.word = g.head || g.tail
    union select w.word, g.word from gaps g join words w on w.word = g.head || g.tail
),
near as (
    select a as word, count(*) as n_near, max(w.n) as most from pairs join words w on w.word = b group by 1
),
forms as (
    select x.word, min(p.b) as form from near x join pairs p on p.a = x.word join words w on w.word = p.b and w.n = x.most
    join words own on own.word = x.word where x.most >= 2 * own.n group by 1
),
chain as (
    select word, form as root, 1 as step from forms
    union all select c.word, f.form, c.step + 1 from chain c join forms f on f.word = c.root
),
roots as (select word, max_by(root, step) as root from chain group by 1)
select w.word, f.form, coalesce(r.root, w.word) as root, w.n, coalesce(x.n_near, 0)::bigint as n_near,
       case when f.form is not null then x.most end as form_n
from words w left join near x using (word) left join forms f using (word) left join roots r using (word)
"""

OP12 = r"""
with sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
),
sources as (
    select source, sum(size)::bigint as source_size, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
    from sized group by source
),
laid as (
    select *, row_number() over (order by source_size / weight, source nulls last) as place,
        3 * sum(source_size) over () - 4 * coalesce(sum(source_size) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as top,
        2 * sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as bottom
    from sources
),
level as (
    select top::hugeint as top, bottom::hugeint as bottom, place from laid where weight * top < 2 * source_size * bottom order by place limit 1
),
targets as (
    select l.source, l.source_size,
        case when l.place < v.place or v.place is null then (2 * l.source_size)::double else (l.weight * v.top)::double / v.bottom::double end as target
    from laid l left join level v on true
),
rates as (
    select *, case when source_size > 0 then target / source_size else 0.0 end as rate,
        ('0x' || substr(md5('0:' || coalesce(source, '')), 1, 9))::bigint * 14 as start
    from targets
),
numbered as (
    select *, row_number() over (partition by source order by size desc, doc_id nulls first) - 1 as i from sized
),
taken as (
    select n.doc_id, n.size, r.source_size, r.target, n.source, n.i::hugeint as i, floor(r.rate)::bigint as whole,
        floor((r.rate - floor(r.rate)) * 1000000000000)::hugeint as parts, r.start::hugeint as start
    from numbered n join rates r on n.source is not distinct from r.source
),
copied as (
    select *, (whole + ((i + 1) * parts + start) // 1000000000000 - (i * parts + start) // 1000000000000)::bigint as copies from taken
)
select doc_id, size, source_size, target, copies * size as taken, source, copies from copied
"""

OP13 = rf"""
with pieces as (
    select coalesce(lang, 'und') as lang, doc_id,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
),
split as (select lang, doc_id, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces),
totals as (select lang, sum(len(words))::bigint as n from split group by 1),
places as (
    select lang, doc_id, words, size, unnest(range(1, len(words) - size + 2)) as i
    from split, (select unnest(range(1, 6)) as size) where len(words) >= size
),
known as (
    select lang, size, array_to_string(words[i : i + size - 1], ' ') as phrase, count(*)::bigint as f, min(doc_id) as doc_id
    from places group by 1, 2, 3 having count(*) >= 100
),
candidates as (select *, string_split(phrase, ' ') as w from known where size > 1),
parts as (
    select c.lang, c.f, array_to_string(c.w[s : s + m - 1], ' ') as phrase
    from candidates c, (select unnest(range(2, 5)) as m) x, (select unnest(range(1, 5)) as s) y where m < c.size and s + m - 1 <= c.size
),
most as (select lang, phrase, max(f) as longer from parts group by 1, 2),
kept as (select c.* from candidates c left join most m using (lang, phrase) where m.longer is null or 100 * m.longer < 100 * c.f),
cuts as (
    select t.lang, t.phrase, t.f, t.doc_id, k, l.f as l, r.f as r, n, (1000 * t.f::hugeint * n) // (l.f::hugeint * r.f) as score
    from kept t, (select unnest(range(1, 5)) as k) x, known l, known r, totals s
    where k < t.size and l.lang = t.lang and r.lang = t.lang and s.lang = t.lang
      and l.phrase = array_to_string(t.w[1:k], ' ') and r.phrase = array_to_string(t.w[k + 1 :], ' ')
),
best as (select *, row_number() over (partition by lang, phrase order by score, k) as place from cuts),
ranked as (
    select *, row_number() over (partition by lang order by score desc, f desc, phrase) as rank from best where place = 1
)
select lang, rank, phrase, f as a, l, r, n, score::bigint as score, doc_id from ranked where rank <= 2000
"""


def curve_steps(dimensions: int, bits: int) -> str:
    """CTEs from ``cells`` (columns x0, x1, ...) to ``curve`` with ``hilbert``: one sub-query per bit and dimension."""
    names = [f"x{i}" for i in range(dimensions)]
    steps, last = [], "cells"

    def step(name: str, changed: dict[str, str]) -> None:
        nonlocal last
        kept = ", ".join(f"{v} as {k}" for k, v in changed.items())
        steps.append(f"{name} as (select * replace ({kept}) from {last})")
        last = name

    for bit in range(bits - 1, 0, -1):
        q = 1 << bit
        for i, x in enumerate(names):
            swap = f"xor(x0, {x}) & {q - 1}"
            changed = {"x0": f"case when {x} & {q} <> 0 then xor(x0, {q - 1}) else xor(x0, {swap}) end"}
            if i:
                changed[x] = f"case when {x} & {q} <> 0 then {x} else xor({x}, {swap}) end"
            else:
                changed["x0"] = f"case when x0 & {q} <> 0 then xor(x0, {q - 1}) else x0 end"
            step(f"turn_{bit}_{i}", changed)
    for i in range(1, dimensions):
        step(f"gray_{i}", {f"x{i}": f"xor(x{i}, x{i - 1})"})
    turn = "0::bigint"
    for bit in range(bits - 1, 0, -1):
        turn = f"xor({turn}, case when {names[-1]} & {1 << bit} <> 0 then {(1 << bit) - 1} else 0 end)"
    step("untwisted", {x: f"xor({x}, {turn})" for x in names})
    index = " + ".join(
        f"(((x{i} >> {bit}) & 1) << {bit * dimensions + dimensions - 1 - i})" for bit in range(bits) for i in range(dimensions)
    )
    return ",\n".join([*steps, f"curve as (select *, ({index})::bigint as hilbert from {last})"])


def string_cell(column: str) -> str:
    """The step of a string: by the rank of its value where these are few, else by the rows before it; 0 for null."""
    return f"""case when {column} is null then 0 when count(distinct {column}) over () <= 32
        then (dense_rank() over (order by {column} nulls last) - 1) * 32 // count(distinct {column}) over ()
        else (rank() over (order by {column} nulls last) - 1) * 32 // count({column}) over () end::bigint"""


def number_cell(column: str) -> str:
    low, high = f"min({column}) over ()", f"max({column}) over ()"
    return f"""case when {column} is null or {low} = {high} then 0
        else least(floor(({column} - {low}) / ({high} - {low}) * 32), 31) end::bigint"""


OP2 = rf"""
with recursive steps as (
    select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: xor(a >> 1, 3988292384 * (a & 1))) as c from range(256) r(i)
),
crc as (select list(c order by i) as t from steps),
bytes as (
    select text, list_transform(range(1, 2 * octet_length(encode(text)), 2), lambda i: ('0x' || substr(h, i, 2))::bigint) as b
    from (select text, hex(encode(text)) as h from (select distinct coalesce(text, '') as text from documents))
),
hashed as (
    select text, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) as text_crc32
    from bytes, crc
),
sized as (
    select doc_id, lang, source, octet_length(encode(coalesce(d.text, ''))) + 1 as size, text_crc32
    from documents d join hashed h on h.text = coalesce(d.text, '')
),
rated as (select *, ln(size) / ln(2.0::double) as magnitude, doc_id::double as place from sized),
cells as (
    select *, {string_cell("lang")} as x0, {string_cell("source")} as x1, {number_cell("magnitude")} as x2, {number_cell("place")} as x3
    from rated
),
{curve_steps(4, 5)},
ranked as (
    select *, row_number() over (order by hilbert, doc_id nulls first, lang nulls first, source nulls first, size, text_crc32) - 1 as place_,
           count(*) over () as total
    from curve
),
sharded as (select *, (place_ * 8 // total)::int as shard from ranked)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'rows' as law, shard,
       (place_ - (shard::bigint * total + 7) // 8)::bigint as slot, null::int as grown_shard, hilbert
from sharded
"""

OP6 = rf"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w from documents
),
sets as (
    select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) as s
    from words
),
classes as (select s, min(doc_id) as cls, len(s) as n from sets where len(s) > 0 group by s),
shingles as (select cls, n, unnest(s) as shingle from classes),
shared as (
    select x.cls as a, y.cls as b, x.n as na, y.n as nb, count(*) as shared_n
    from shingles x join shingles y on x.shingle = y.shingle and x.cls < y.cls group by 1, 2, 3, 4
),
links as (select a, b from shared where 100 * shared_n >= 85 * (na + nb - shared_n)),
ways as (select a, b from links union all select b, a from links),
reach as (
    select cls as a, cls as b from classes
    union select r.a, w.b from reach r join ways w on w.a = r.b
),
least as (select a as cls, min(b) as component from reach group by 1)
select t.doc_id, len(t.s)::bigint as n_shingles, coalesce(l.component, t.doc_id) as component_id,
       t.doc_id = coalesce(l.component, t.doc_id) as kept
from sets t left join classes c on c.s = t.s left join least l on l.cls = c.cls
"""

OP9 = r"""
with rows_ as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
bodies as (
    select *, case when regexp_matches(text, '\\(###|</turn>)') or contains(text || chr(10) || '</turn>', chr(10) || '</turn>' || chr(10))
                     or ends_with(text, chr(10) || '</turn>')
                   then regexp_replace(text, '(\\*)(###|</turn>)', '\\\1\2', 'g') else text end as body,
           regexp_replace(role, '([\\:<#\n])', '\\\1', 'g') as head
    from rows_
),
chats as (
    select conv_id, count(*) as n_turns,
           string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as lines,
           coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss,
           string_agg('### ' || head || ': ' || body || chr(10) || '</turn>' || chr(10), '' order by turn nulls first, role, text) as formatted
    from bodies group by conv_id
)
select conv_id, n_turns::bigint as n_turns, sha256(lines) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256,
       length(formatted)::bigint as formatted_chars, true as exact
from chats
"""

ORACLE_SQL = {
    "op2_hilbert_shards": OP2, "op6_bottom_k_duplicates": OP6, "op9_chat_format": OP9,
    "op11_spelling_variants": OP11, "op12_systematic_mix": OP12, "op13_phrase_collocations": OP13,
}
