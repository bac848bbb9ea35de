"""The queries in SQL for another engine, where SQL can express them."""

from __future__ import annotations

import string

from tarmac.llm.licenses import (
    DEMANDING,
    LEADING,
    LONGER,
    REDUCED,
    known_sentences,
    licence_rules,
)
from tarmac.llm.secrets import RULES

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def _lower(text: str) -> str:
    return f"translate({text}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _crc32(text: str) -> str:
    """The checksum of the UTF-8 bytes of ``text``."""
    every = f"range(strlen({text}))"
    byte = f"('0x' || substr(hex({text}), 2 * i + 1, 2))::bigint"
    bits = "[xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]"
    step = f"list_reduce({bits}, lambda x, y: xor(x >> 1, (x & 1) * {0xEDB88320}))"
    taken = f"list_prepend({0xFFFFFFFF}::bigint, list_transform({every}, lambda i: {byte}))"
    return f"xor(list_reduce({taken}, lambda crc, byte: {step}), {0xFFFFFFFF})"


MIXING = rf"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as size,
    row_number() over () as row, ('0x' || left(md5('0:' || md5(coalesce(text, '')) || ':' ||
      coalesce(cast(doc_id as varchar), '')), 15))::bigint as place
  from documents
), sources as (
  select source, sum(size)::bigint as source_size,
    [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from sized group by source
), ordered as (
  select *, 2 * source_size as cap, sum(source_size) over () as total,
    coalesce(sum(2 * source_size) over before, 0) as used,
    sum(weight) over (order by 2.0::double * source_size / weight, source nulls last
                      rows between current row and unbounded following) as open
  from sources
  window before as (order by 2.0::double * source_size / weight, source nulls last
                    rows between unbounded preceding and 1 preceding)
), levels as (
  select (total * 150 / 100.0::double - used) / open::double as level, cap, weight, used
  from ordered
), chosen as (
  select arg_min(level, used) as level from levels where weight * level <= cap
), targets as (
  select source, source_size,
    least(weight * coalesce((select level from chosen), 0.0), cap::double) as target
  from ordered
), parts as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole,
  from targets
), running as (
  select s.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size as rest,
    sum(s.size) over (partition by s.source order by s.place, s.row
                      rows between unbounded preceding and current row) - s.size as before
  from sized s join parts p on s.source is not distinct from p.source
), chosen_rows as (
  select *, whole + case when rest > 0 and before + size / 2 < rest then 1 else 0 end as copies
  from running
)
select doc_id, size::bigint as size, source_size, target, (size * copies)::bigint as taken,
  copies::int as copies
from chosen_rows
"""

_KINDS = {
    "assign": r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"
    r"[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)",
    "access": r"()(AKIA[A-Z0-9]+)",
    "hex": r"()([0-9a-f]+)",
    "pem": r"()(-----BEGIN [A-Z ]*PRIVATE KEY-----)",
    "provider": r"()(\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abp]-[A-Za-z0-9-]{10,}))",
}


def _spans(kind: str) -> str:
    """Rows ``id, kind, place, start, end`` of one kind; matches and the text between them."""
    place = [r.kind for r in RULES].index(kind)
    pattern = _quoted(_KINDS[kind])
    return f"""
  select id, '{kind}' as kind, {place} as place,
    list_sum(list_transform(gaps[:i], lambda g: length(g)))
      + coalesce(list_sum(list_transform(found[:i - 1], lambda m: length(m))), 0) as start,
    list_sum(list_transform(gaps[:i], lambda g: length(g)))
      + list_sum(list_transform(found[:i], lambda m: length(m))) as stop,
    length(values[i]) as n
  from (
    select id, found, values, unnest(range(1, len(found) + 1)) as i,
      string_split_regex(text, {pattern.replace('(', '(?:').replace('(?:?:', '(?:')}) as gaps
    from (
      select id, text, regexp_extract_all(text, {pattern}) as found,
        regexp_extract_all(text, {pattern}, 2) as values from texts
    ) where len(found) > 0
  )"""


SECRETS = rf"""
with texts as (
  select row_number() over () as id, doc_id, coalesce(text, '') as text from documents
), spans as (
  {' union all '.join(_spans(r.kind) for r in RULES)}
), kept as (
  select * from spans
  where n >= case kind {' '.join(f"when '{r.kind}' then {r.least}" for r in RULES)} end
), listed as (
  select id,
    count(*) filter (kind = 'assign') as n_assign,
    count(*) filter (kind = 'access') as n_access,
    count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, place)
      filter (kind in ('assign', 'access', 'hex')) as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, place) as spans
  from kept group by id
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access,
  coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans
from texts left join listed using (id)
"""

_BENCH = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
with texts as (
  select row_number() over () as id, doc_id,
    regexp_extract_all({_lower("coalesce(text, '')")}, '{_BENCH}') as words
  from documents
), items as (
  select cast(item_id as varchar) as item_id,
    regexp_extract_all({_lower("coalesce(text, '')")}, '{_BENCH}') as words
  from benchmark
), windows as (
  select distinct item_id, least(10, len(words)) as n,
    array_to_string(words[i:i + least(10, len(words)) - 1], ' ') as phrase
  from (
    select *, unnest(range(1, len(words) - least(10, len(words)) + 2)) as i
    from items where len(words) > 0
  )
), places as (
  select id, n, i, array_to_string(words[i:i + n - 1], ' ') as phrase
  from (
    select id, words, n, unnest(range(1, len(words) - n + 2)) as i
    from texts, (select distinct n from windows) where len(words) >= n
  )
), hits as (
  select id, i, n, item_id from places join windows using (n, phrase)
), covered as (
  select id, count(distinct spot) as n_hit
  from (select id, unnest(range(i, i + n)) as spot from (select distinct id, i, n from hits))
  group by id
), named as (
  select id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names
  from (select distinct id, item_id from hits where item_id is not null) group by id
)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0) as n_hit,
  coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from texts left join covered using (id) left join named using (id)
"""

QUALITY_RULES = rf"""
with texts as (
  select row_number() over () as id, doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda l: regexp_matches(l, '{WORD}')) as lines
  from documents
), windows as (
  select id, i, array_to_string(words[i:i + 4], ' ') as phrase
  from (select id, words, unnest(range(1, len(words) - 3)) as i from texts)
), repeated as (
  select id, i from windows qualify count(*) over (partition by id, phrase) > 1
), covered as (
  select id, count(distinct spot) as n
  from (select id, unnest(range(i, i + 5)) as spot from repeated) group by id
), measured as (
  select doc_id, len(words)::bigint as n_words,
    length(array_to_string(words, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    len(lines)::bigint as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words,
    length(regexp_replace(text, '[^A-Z]+', '', 'g'))::bigint as n_upper
  from texts left join covered using (id)
), judged as (
  select *, n_words < 10 as few, 100 * n_repeat_words > 20 * n_words as repeats,
    100 * n_symbols > 30 * n_words as symbols, 100 * n_dup_lines > 60 * n_lines as lines,
    word_chars < 2 * n_words as short, word_chars > 15 * n_words as long,
    2 * n_upper > word_chars as shouting
  from measured
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  few or repeats as base_failed,
  not (few or repeats or symbols or lines or short or long or shouting) as kept,
  (few::int + 2 * repeats::int + 4 * symbols::int + 8 * lines::int + 16 * short::int
    + 32 * long::int + 64 * shouting::int)::bigint as failures
from judged
"""


def _licence(name: str, rules: list[tuple[str, ...]]) -> str:
    found = []
    for rule in rules:
        wanted = "".join(f"<{i}>" for i in rule if not i.startswith("!"))
        line = "line"
        # Where a barred sentence follows, the sequence is taken out first.
        for i in rule:
            if i.startswith("!"):
                line = f"replace({line}, '{wanted}<{i[1:]}>', '<{i[1:]}>')"
        found.append(f"contains({line}, '{wanted}')")
    return f"case when {' or '.join(found)} then '{name}' end"


def _reduced(text: str) -> str:
    for pattern, to in REDUCED:
        text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(to)})"
    return text


_KNOWN = known_sentences()
_NAMED = ", ".join(f"({_quoted(s)}, {_quoted(i)})" for s, i in _KNOWN.items())
_FIRST = ", ".join(_quoted(w) for w in sorted({s.split()[0] for s in _KNOWN} | set(LEADING)))
_SHORT = "'SPDX-License-Identifier:|[ \\t](?:OR|AND)[ \\t]'"
LICENSE_SCAN = rf"""
with known(sentence, id) as (values {_NAMED}), numbered as (
  select doc_id, row_number() over () as row,
    list_transform(string_split(coalesce(text, ''), chr(10)), lambda l:
      case when contains(l, 'SPDX-License-Identifier:') then regexp_replace(l, {_SHORT},
        chr(10) || chr(10) || 'SPDX-License-Identifier ', 'g') || chr(10) else l end) as raw
  from documents
), clauses as (
  select doc_id, row, regexp_replace(regexp_replace(
    regexp_replace(array_to_string(raw, chr(10)), '([Vv])\.[ \t\r\n]+([0-9])', '\1 \2', 'g'),
    '[.;:!?][ \t]+|[.;:!?][ \t\r"'')*/]*\n', chr(10) || chr(10), 'g'),
    '\n[^\p{{L}}\p{{N}}\n]*\n', chr(10) || chr(10), 'g') as text
  from numbered
), joined as (
  select doc_id, row, regexp_replace({_lower(
      "regexp_replace(text, '([^\\n])\\n[^\\p{L}\\p{N}\\n]*([a-z])', '\\1 \\2', 'g')"
  )}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') as text
  from clauses
), cut as (
  select doc_id, row, list_transform(string_split(regexp_replace(text,
    '(^|[ \n])({'|'.join(DEMANDING)}) ?\n ?([^ \n])', '\1\2 \3', 'g'), chr(10)),
    lambda l: trim(l, ' ')) as lines
  from joined
), places as (
  select row, lines, unnest(range(1, len(lines) + 1)) as start from cut
), starts as (
  select row, start, lines[start:len(lines)] as lines,
    coalesce(nullif(list_position(lines[start:len(lines)], ''), 0) - 1, len(lines) - start + 1) as most
  from places where split_part(lines[start], ' ', 1) in ({_FIRST})
), runs as (
  select row, start, lines, unnest(range(1, most + 1)) as n from starts
), sentences as (
  select row, start, n, array_to_string(lines[1:n], ' ') as sentence from runs
), named as (
  select row, start, n, coalesce(k.id, r.id) as id from sentences s
  left join known k on k.sentence = s.sentence
  left join known r on r.sentence = {_reduced('s.sentence')}
  where coalesce(k.id, r.id) is not null
    and length(s.sentence) <= {max(map(len, _KNOWN)) + LONGER} + (n > 1)::int
), hits as (
  select row, start, max(n) as n, arg_max(id, n) as id from named group by row, start
), ordered as (
  select row, list([{{'start': start, 'n': n, 'id': id}}] order by start) as hits from hits group by row
), kept as (
  select row, list_transform(list_reduce(hits, lambda had, hit:
    case when had[-1].start + had[-1].n <= hit[1].start then list_concat(had, hit) else had end),
    lambda h: h.id) as ids
  from ordered
), lines as (
  select doc_id, len(list_filter(lines, lambda l: l <> ''))::bigint as n_sentences,
    coalesce(ids, []) as ids,
    coalesce(array_to_string(list_transform(ids, lambda i: '<' || i || '>'), ''), '') as line
  from cut left join kept using (row)
)
select doc_id, n_sentences, len(ids)::bigint as n_known,
  array_to_string(ids, ',') as sentence_ids,
  concat_ws(',', {', '.join(_licence(*x) for x in licence_rules().items())}) as licences
from lines
"""

SPELLING = rf"""
with recursive runs as (
  select coalesce(cast(doc_id as varchar), '') as key, {_lower(
      "unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+'))"
  )} as run from documents
), summed as (
  select run, count(*) as copies, {_crc32("key || ':' || run")} as h from runs
  where length(run) >= 7 group by key, run
), spelt as (
  select copies, case when h % 31 = 0
    then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word
  from summed
), words as (
  select word, sum(copies)::bigint as n from spelt where length(word) >= 7
  group by word having sum(copies) >= 2
), places as (
  select word, unnest(range(length(word))) as cut from words
), shorter as (
  select word, cut, left(word, cut) || substr(word, cut + 2) as less from places
), pairs as (
  select a.word, b.word as near from shorter a join shorter b
    on a.less = b.less and a.cut = b.cut and a.word <> b.word
  union select word, less from shorter where less in (select word from words)
  union select less, word from shorter where less in (select word from words)
), best as (
  select p.word, count(*) as n_near, arg_min(p.near, (-w.n, p.near)) as near, max(w.n) as near_n
  from pairs p join words w on w.word = p.near group by p.word
), forms as (
  select word, n, coalesce(n_near, 0)::bigint as n_near,
    case when near_n >= 10 * n then near end as form,
    case when near_n >= 10 * n then near_n end as form_n
  from words left join best using (word)
), followed as (
  select word, word as root, 0 as links from forms
  union all
  select r.word, f.form, links + 1 from followed r join forms f on f.word = r.root
  where f.form is not null
), ends as (
  select word, arg_max(root, links) as root from followed group by word
)
select word, form, root, n, n_near, form_n from forms join ends using (word)
"""

PREFIX_TRIE = rf"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as place
  from conversations where conv_id is not null
), ids as (
  select distinct conv_id, conv_id - conv_id % 5 as start,
    {_crc32("cast(conv_id as varchar)")} % 9 as taken
  from turns
), rebuilt as (
  select i.conv_id, 1 as part, place, role, text
  from ids i join turns t on t.conv_id = i.start and place <= taken
  union all
  select t.conv_id, 2, place, role, text from ids i join turns t using (conv_id)
  where place > taken
), prefixes as (
  select conv_id, row_number() over by_turn as depth, strlen(text) as n_bytes,
    sha256(string_agg(concat(length(role), ':', role, length(text), ':', text)) over by_turn) as node
  from rebuilt window by_turn as (partition by conv_id order by part, place)
  union all select conv_id, 0, 0, '' from ids
), nodes as (
  select node, depth, count(*) as n_convs, min(conv_id) as conv_id, max(n_bytes) as n_bytes
  from prefixes group by node, depth
), parents as (
  select distinct c.node, p.node as parent
  from prefixes c join prefixes p on p.conv_id = c.conv_id and p.depth = c.depth - 1
), children as (
  select parent as node, count(*) as n_children from parents group by parent
), below as (
  select distinct u.node, d.node as other
  from prefixes u join prefixes d on u.conv_id = d.conv_id and u.depth <= d.depth
), totals as (
  select b.node, count(*) filter (where n_children is null) as n_leaves,
    sum((n_convs - 1) * n_bytes) as saved_tokens
  from below b join nodes n on n.node = b.other left join children c on c.node = b.other
  group by b.node
), ends as (
  select node, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids
  from (from prefixes qualify depth = max(depth) over (partition by conv_id)) group by node
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs,
  coalesce(n_children, 0)::bigint as n_children, n_leaves, saved_tokens::bigint as saved_tokens,
  sha256(coalesce(ids, '')) as ends_sha256
from nodes n join totals using (node) left join children using (node) left join ends using (node)
  left join parents using (node) left join nodes p on p.node = parent
"""

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": MIXING,
    "op2_secret_scan": SECRETS,
    "op6_decontamination": DECONTAMINATION,
    "op8_quality_rules": QUALITY_RULES,
    "op9_license_scan": LICENSE_SCAN,
    "op11_spelling": SPELLING,
    "op12_prefix_trie": PREFIX_TRIE,
}
