"""DuckDB SQL for the queries that SQL can state."""

from __future__ import annotations

import math
import re

from tremorframe.llm.licenses import BLOCK_WORDS, EVIDENCE, FULL_TEXTS, PHRASES, TEMPLATES, THRESHOLD

SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"

QUALITY = rf"""with base as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
parts as (
  select r, doc_id, text, regexp_extract_all(text, '{NOT_SPACE}+') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{NOT_SPACE}')) as lines from base),
places as (
  select r, unnest(range(1, len(words) - 6)) as i, words from parts where len(words) >= 8),
windows as (
  select r, i, array_to_string(words[i : i + 7], ' ') as w from places),
twice as (
  select r, i from windows qualify count(*) over (partition by r, w) > 1),
covered as (
  select r, least(8, coalesce(lead(i) over (partition by r order by i) - i, 8)) as n from twice),
repeated as (
  select r, sum(n) as n from covered group by r),
counted as (
  select doc_id, cast(len(words) as bigint) as n_words,
    cast(length(array_to_string(words, '')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(n, 0) as bigint) as n_repeat_words, len(lines) as n_lines,
    length(text) - length(replace(text, '!', '')) as n_exclamations,
    len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) as n_stutters
  from parts left join repeated using (r)),
judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counted)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or 10 * n_exclamations > 3 * n_words or 5 * n_stutters > n_words or (n_dup_lines >= 3 and 2 * n_dup_lines > n_lines)
    or word_chars < 2 * n_words or word_chars > 15 * n_words) as kept
from judged"""

MIXING = rf"""with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{NOT_SPACE}+')) as bigint) as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':9'), 1, 15) as bigint) as k
  from documents),
sources as (
  select source, cast(sum(size) as bigint) as source_size, cast(3 * sum(size) as double) as cap,
    cast([5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as double) as weight
  from sized group by source),
levels as (
  select *, (sum(source_size) over () * 1.0::double - coalesce(sum(cap) over (
      order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following)
    as level, row_number() over (order by cap / weight, source nulls last) as rk
  from sources),
targets as (
  select source, source_size, least(cap, coalesce(
    arg_min(level, rk) filter (where level * weight <= cap) over () * weight, cap)) as target from levels),
placed as (
  select doc_id, size, source_size, target, coalesce(sum(size) over (
    partition by s.source order by k, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as start,
    cast(floor(target) as bigint) as budget
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(case when source_size = 0 then 0 else
  (budget // source_size) * size + least(size, greatest(0, budget % source_size - start)) end as bigint) as taken
from placed"""


TOPK = """with usable as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x) or abs(x) >= 4194304)) = 0),
scored as (
  select a.vec_id as query_id, b.vec_id, cast(list_dot_product(a.q, b.q) as bigint) as score
  from usable a join usable b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rk from scored)
select query_id, cast(rk as int) as rank, vec_id, score from ranked where rk <= 5"""

NEAR_DEDUP = rf"""with recursive sized as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{NOT_SPACE}+') as words from documents),
shingles as (
  select distinct r, array_to_string(words[i : i + 2], ' ') as s
  from (select r, words, unnest(range(1, greatest(len(words) - 1, 2))) as i from sized where len(words) > 0)),
counts as (
  select r, count(*) as n from shingles group by r),
shared as (
  select x.r as a, y.r as b, count(*) as c from shingles x join shingles y on x.s = y.s and x.r < y.r group by x.r, y.r),
links as (
  select x.doc_id as a, y.doc_id as b
  from shared join counts m on a = m.r join counts n on b = n.r join sized x on a = x.r join sized y on b = y.r
  where 100 * c >= 85 * (m.n + n.n - c)),
both_ways as (
  select a, b from links union select b, a from links),
reach(node, other) as (
  select doc_id, doc_id from sized union select node, b from reach join both_ways on other = a)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, doc_id = component_id as kept
from sized left join counts using (r) join (
  select node as doc_id, min(other) as component_id from reach group by node) using (doc_id)"""


def crc32_sql(column: str) -> str:
    """CRC-32 of a decimal number, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::bigint],
    list_transform(string_split(cast({column} as varchar), ''), lambda x: cast(ascii(x) as bigint))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda z, k: xor(z >> 1, (z & 1) * 3988292384))))"""


RUNS = rf"""with base as (
  select row_number() over () as r, doc_id, {crc32_sql("doc_id")} as h,
    regexp_extract_all(coalesce(text, ''), '{NOT_SPACE}+') as w from documents),
places as (
  select *, (h // 10) % greatest(len(w), 1) as a from base),
tiles as (
  select *, 1 + (len(w) - a) // (3 + (h // 10) % 8) as p from places),
texts as (
  select r, doc_id, case when h % 10 = 0 and len(w) > 0
    then list_transform(range(len(w)), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) else w end as w
  from tiles),
words as (
  select r, len(w) as n, unnest(w) as word, unnest(range(len(w))) as i from texts),
again as (
  select y.r, y.i, y.i - x.i as q from words x join words y
    on x.r = y.r and x.word = y.word and x.i < y.i and 4 * (y.i - x.i) <= x.n),
marked as (
  select r, q, i, i - row_number() over (partition by r, q order by i) as island from again),
islands as (
  select r, q, min(i) - q as start, max(i) + 1 as stop from marked group by r, q, island
  having count(*) + q >= greatest(6, 4 * q)),
found as (
  select r, start, stop - start as length, min(q) as period from islands group by r, start, stop),
lists as (
  select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines
  from found group by r),
best as (
  select r, start, length, period from (select *, row_number() over (
    partition by r order by cast(length as decimal(18, 0)) * 1000000000 // period desc, start, period) as rk from found) where rk = 1),
dropped as (
  select distinct r, i from (select r, unnest(range(start + period, start + length)) as i from found)),
kept as (
  select words.r, string_agg(word, ' ' order by words.i) as t
  from words left join dropped on words.r = dropped.r and words.i = dropped.i where dropped.r is null group by words.r)
select doc_id, cast(coalesce(n_runs, 0) as bigint) as n_runs, cast(start as bigint) as start, cast(length as bigint) as length,
  cast(period as bigint) as period, cast(1000 * length // period as bigint) as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from texts left join lists using (r) left join best using (r) left join kept using (r)"""


TRIE = f"""with own as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations
  where conv_id is not null),
digested as (
  select c, turn, sha256(strlen(role) || ':' || role || text) as d, cast(length(text) as bigint) as n from own),
turns as (
  select c, d, n, row_number() over (partition by c order by turn nulls first, d) as i from digested),
heads as (
  select c, c - c % 100 as b, {crc32_sql("c")} % 6 as h from (select distinct c from turns)),
rebuilt as (
  select heads.c, i, d, n from heads join turns on turns.c = heads.c and i > h
  union all select heads.c, i, d, n from heads join turns on turns.c = b and i <= h),
placed as (
  select c, d, n, row_number() over (partition by c order by i) as i from rebuilt),
paths as (
  select c, i, n, string_agg(d, '') over (partition by c order by i) as path from placed
  union all select c, 0, 0, '' from heads),
sizes as (
  select c, max(i) as m from paths group by c),
nodes as (
  select path, i, n, min(paths.c) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(cast(paths.c as varchar), ',' order by paths.c) filter (where i = m), '')) as ends_sha256
  from paths join sizes using (c) group by path, i, n),
children as (
  select substr(path, 1, 64 * (i - 1)) as path, count(*) as n_children from nodes where i > 0 group by 1),
whole as (
  select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (path)),
above as (
  select unnest(range(0, i + 1)) as k, path, n_children, (n_convs - 1) * n as saved from whole),
sums as (
  select substr(path, 1, 64 * k) as path, count(*) filter (where n_children = 0) as n_leaves, sum(saved) as saved
  from above group by 1)
select w.conv_id, cast(w.i as bigint) as depth, p.conv_id as parent_conv_id, w.n_convs, w.n_children, n_leaves,
  cast(sums.saved as bigint) as saved_tokens, w.ends_sha256
from whole w join sums on w.path = sums.path
  left join nodes p on w.i > 0 and p.path = substr(w.path, 1, 64 * (w.i - 1))"""


def _told(label: str) -> str:
    """Whether a block has what tells a label, as ``EVIDENCE`` does; without looking behind, which DuckDB cannot."""
    tests = []
    for pattern in EVIDENCE.get(label, []):
        text = "block_text"
        if pattern.startswith("(?<!"):
            ahead, pattern = re.match(r"\(\?<!(.*?\))\)(.*)", pattern).groups()
            text = f"regexp_replace(block_text, '{ahead}{pattern.rstrip()}', ' x', 'g')"
        tests.append(f"regexp_matches({text}, '{pattern}')")
    return " and ".join(tests) or "true"


def licenses_sql() -> str:
    """Phrase places, and containment in overlapping blocks with the words that tell a label, by definition."""
    phrases = "\n  union all ".join(
        f"select r, '{label}' as label, i from words_at where words[i + 1 : i + {len(p.split())}] = {p.split()}"
        for label, p in PHRASES.items()
    )

    def length(words: int) -> int:
        """Words of the blocks for a template: at least twice its own."""
        size = BLOCK_WORDS
        while size < 2 * words:
            size *= 2
        return size

    every = TEMPLATES + FULL_TEXTS
    templates = ", ".join(
        f"('{label}', {sorted(set(t.split()))}, {math.ceil(THRESHOLD * len(set(t.split())) - 1e-9)}, {length(len(t.split()))})"
        for label, t in every
    )
    lengths = sorted({length(len(t.split())) for _, t in every})
    told = " ".join(f"when '{label}' then {_told(label)}" for label in dict(every))
    return rf"""with base as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents),
words_at as (
  select r, words, unnest(range(0, len(words))) as i from base
  where list_has_any(words, ['under', 'apache', 'cc'])),
places as ({phrases}),
based as (
  select r, count(*) as n, min(i) as f, max(i) as l, list(distinct label) as labels from places group by r),
templates(label, tokens, need, length) as (values {templates}),
blocks as (
  select r, length, words[i + 1 : i + length] as block,
    ' ' || array_to_string(words[greatest(i, 1) : i + length], ' ') || ' ' as block_text
  from (select r, words, length, unnest(range(0, greatest(len(words) - length // 2, 1), length // 2)) as i
    from base, (select unnest({lengths}) as length)
    where list_has_any(words, ['license', 'licensed', 'cc', 'redistribution', 'permitted', 'permission', 'copy']))),
shares as (
  select r, label, need, len(list_intersect(tokens, block)) as share, len(tokens) as size, block_text
  from blocks join templates using (length)),
found as (
  select r, list(distinct label) as labels, max(share / size) as best from shares
  where share >= need and case label {told} else true end group by r)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_base,
  cast(f as bigint) as first_word, cast(l as bigint) as last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') as labels,
  case when n > 0 then 1.0::double else coalesce(best, 0.0::double) end as score
from base left join based b using (r) left join found m using (r)"""


def llm_oracles() -> dict[str, str]:
    return {
        "op5_licenses": licenses_sql(),
        "op6_topk": TOPK,
        "op7_quality": QUALITY,
        "op9_mixing": MIXING,
        "op10_near_dedup": NEAR_DEDUP,
        "op11_runs": RUNS,
        "op12_conversation_trie": TRIE,
    }
