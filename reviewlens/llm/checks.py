"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from reviewlens.llm import mixture, quality, url_filter

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def url_filter_sql(rules: dict[str, str], rejected_words: tuple[str, ...]) -> str:
    """The two models level by level: a window's last character in contexts of 0 to ORDER characters."""
    order = url_filter.ORDER
    whens = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        domain, _, rest = rule.partition("/")
        whens.append(
            f"when (host = '{domain}' or ends_with(host, '.{domain}')) and starts_with(path, '/{rest}') then '{rule}'"
        )
    decided = " ".join(f"when '{rule}' then '{verdict}'" for rule, verdict in rules.items())
    bad = " or ".join(f"contains(host, '{w}')" for w in rejected_words)
    levels, joins = [], []
    for n in range(1, order + 2):
        joins.append(
            f"left join counts c{n} on c{n}.gram = right(w.gram6, {n}) "
            f"left join contexts x{n} on x{n}.context = left(right(w.gram6, {n}), {n - 1})"
        )
        for cls in "ar":
            levels.append(
                f"coalesce(c{n}.{cls}, 0)::double as g{n}{cls}, coalesce(x{n}.n_{cls}, 0)::double as n{n}{cls}, "
                f"coalesce(x{n}.t_{cls}, 0)::double as t{n}{cls}"
            )

    def chain(cls: str) -> list[str]:
        steps, last = [], f"(1.0::double / {url_filter.ALPHABET})"
        for n in range(1, order + 2):
            steps.append(
                f"case when n{n}{cls} > 0 then (g{n}{cls} + t{n}{cls} * {last}) / (n{n}{cls} + t{n}{cls}) else {last} end as p{n}{cls}"
            )
            last = f"p{n}{cls}"
        return steps

    pad = " || ".join(["chr(2)"] * order)
    return f"""
with split as (
  select page_id,
    case when strpos(url, '://') > 0 then {_lower("regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1)")} else '' end as host,
    case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
ruled as (select *, host || path as key, case {' '.join(whens)} end as rule from split),
judged as (select *, case rule {decided} end as decided from ruled),
keys as (select key, max(decided) as decided, bool_or({bad}) as bad from judged group by key),
labels as (
  select key, not (bad or coalesce(decided = 'block', false)) as accepted,
    ('0x' || substr(md5(key), 1, 8))::bigint % {url_filter.HELD_OUT} as fold
  from keys),
cut as (
  select key, substr({pad} || key || chr(3), i, {order + 1}) as gram6
  from (select key, unnest(range(1, length(key) + 2)) as i from keys)),
longest as (
  select gram6, count(*) filter (accepted) as a, count(*) filter (not accepted) as r
  from cut join labels using (key) where fold <> 0 group by gram6),
counts as (
  select right(gram6, n) as gram, sum(a)::bigint as a, sum(r)::bigint as r
  from longest, unnest(range(1, {order + 2})) as u(n) group by 1),
contexts as (
  select left(gram, length(gram) - 1) as context, sum(a)::bigint as n_a, count(*) filter (a > 0) as t_a,
    sum(r)::bigint as n_r, count(*) filter (r > 0) as t_r
  from counts group by 1),
found as (select w.gram6, {', '.join(levels)} from (select distinct gram6 from cut) w {' '.join(joins)}),
chained as (select gram6, {', '.join(chain('a') + chain('r'))} from found),
windows as (select gram6, round((ln(p{order + 1}a) - ln(p{order + 1}r)) * 1000000)::bigint as micro from chained),
scores as (select key, round(sum(micro)::double / count(*))::bigint as score from cut join windows using (gram6) group by key),
both_classes as (
  select count(*) filter (accepted and fold <> 0) > 0 and count(*) filter (not accepted and fold <> 0) > 0 as ok from labels),
bins as (
  select floor(score / 1000.0)::bigint as bin, count(*) as n
  from scores join labels using (key) where accepted and fold = 0 group by 1),
ranked as (select bin, sum(n) over (order by bin) as below, sum(n) over () as total from bins),
lim as (
  select case when (select ok from both_classes)
    then least(0, coalesce((select min(bin) from ranked where below > {url_filter.FALSE_REJECTS} * total) * 1000, 0)) end as v)
select j.page_id, j.host, j.path, j.rule,
  coalesce(j.decided, case when s.score < (select v from lim) then 'block' else 'allow' end) as verdict
from judged j left join scores s on s.key = j.key
"""


OP3 = rf"""
with docs as (
  select doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select distinct coalesce(item_id::varchar, '') as item,
    regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
item_runs as (
  select item, n, array_to_string(w[i:i + n - 1], ' ') as run
  from (select *, least(10, len(w)) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)),
doc_runs as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as run
  from (
    select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i
    from docs, (select distinct n from item_runs) where len(w) >= n)),
hits as (select doc_id, i, d.n, item from doc_runs d join item_runs r using (n, run)),
words as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hits)) group by doc_id),
owners as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join words using (doc_id) left join owners using (doc_id)
"""

OP5 = rf"""
with recursive words as (
  select doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) >= 2
    then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
    else list_distinct(w) end as s
  from words),
members as (select doc_id, len(s) as n, unnest(s) as t from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as k, any_value(a.n) as na, any_value(b.n) as nb
  from members a join members b on a.t = b.t and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by 1, 2),
links as (select a, b from pairs where 100 * k >= 80 * (na + nb - k)),
both_ways as (select a, b from links union all select b, a from links),
reach as (
  select doc_id as a, doc_id as b from documents
  union
  select r.a, l.b from reach r join both_ways l on l.a = r.b),
least_ids as (select a, min(b) as component_id from reach group by a)
select s.doc_id, len(s.s)::bigint as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from sets s join least_ids c on c.a = s.doc_id
"""

def _cut(limits: tuple[float, float], rule: int | None = None) -> str:
    """A rule's limit on a host of strictness t, the mild one without a rule."""
    mild, clear = limits
    return f"({clear!r}::double + {mild - clear!r}::double * {f't{rule}' if rule else '1e0'})"


OP6 = rf"""
with words as (
  select doc_id, source, coalesce(text, '') as text, {WORDS} as w from documents),
runs as (
  select doc_id, i, array_to_string(w[i:i + {quality.REPEAT_WINDOW - 1}], ' ') as run
  from (
    select doc_id, w, unnest(range(1, len(w) - {quality.REPEAT_WINDOW} + 2)) as i
    from words where len(w) >= {quality.REPEAT_WINDOW})),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, run) as n from runs) where n > 1),
repeats as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest(range(i, i + {quality.REPEAT_WINDOW})) as p from again) group by doc_id),
lines as (
  select doc_id, sum(n - 1)::bigint as n_dup_lines
  from (
    select doc_id, line, count(*) as n
    from (select doc_id, unnest(string_split(text, chr(10))) as line from words)
    where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1, 2)
  group by doc_id),
counted as (
  select w.doc_id, w.source, len(w.w)::bigint as n_words, length(array_to_string(w.w, ''))::bigint as word_chars,
    length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(l.n_dup_lines, 0)::bigint as n_dup_lines, coalesce(r.n_repeat_words, 0)::bigint as n_repeat_words
  from words w left join lines l using (doc_id) left join repeats r using (doc_id)),
marked as (
  select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words as base_failed,
    n_symbols > {_cut(quality.SYMBOL_LIMITS)} * n_words as r1, n_dup_lines >= {_cut(quality.LINE_LIMITS)} as r2,
    word_chars < {_cut(quality.SHORT_LIMITS)} * n_words or word_chars > {_cut(quality.LONG_LIMITS)} * n_words as r3
  from counted),
hosts as (
  select source, count(*) as n_docs, count(*) filter (r1) as n1, count(*) filter (r2) as n2, count(*) filter (r3) as n3
  from marked group by source),
rates as (
  select *, trunc(n1 * 1000000 / n_docs)::bigint as q1, trunc(n2 * 1000000 / n_docs)::bigint as q2,
    trunc(n3 * 1000000 / n_docs)::bigint as q3 from hosts),
prior as (
  select {', '.join(f'''sum(q{i})::double / count(*) / 1e6 as m{i},
    sum(q{i}::hugeint * q{i})::double / count(*) / 1e12 - (sum(q{i})::double / count(*) / 1e6) * (sum(q{i})::double / count(*) / 1e6) as v{i}'''
    for i in (1, 2, 3))}, avg(n_docs) as size
  from rates),
strengths as (
  select *, {', '.join(f"case when v{i} > 1e-12 then greatest(1.0, m{i} * (1 - m{i}) / v{i} - 1) else size end as k{i}" for i in (1, 2, 3))}
  from prior),
verdicts as (
  select source, {', '.join(f"case when m{i} > 0 then least(1e0, (n{i} + m{i} * k{i}) / (n_docs + k{i}) / m{i}) else 0e0 end as t{i}" for i in (1, 2, 3))}
  from hosts, strengths)
select m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or n_symbols > {_cut(quality.SYMBOL_LIMITS, 1)} * n_words or n_dup_lines >= {_cut(quality.LINE_LIMITS, 2)}
    or word_chars < {_cut(quality.SHORT_LIMITS, 3)} * n_words or word_chars > {_cut(quality.LONG_LIMITS, 3)} * n_words) as kept
from marked m join verdicts v on m.source is not distinct from v.source
"""

_WEIGHTS = " ".join(f"when {i} then {float(w)}" for i, w in enumerate(mixture.WEIGHTS))
OP7 = rf"""
with weights as (
  select doc_id, case when max(quality) > 0 then 2.0 when max(quality) = 0 then 0.5 else 1.0 end as weight
  from labels where doc_id is not null group by doc_id),
sized as (
  select doc_id, source, len({WORDS})::bigint as size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint + 0.5::double) / 281474976710656.0::double as u
  from documents),
keyed as (select s.*, -ln(u) / coalesce(weight, 1.0)::double as key from sized s left join weights w using (doc_id)),
sources as (select source, sum(size)::bigint as source_size from keyed group by source),
ranked as (
  select source, source_size,
    (case (row_number() over (order by source nulls last) - 1) % {len(mixture.WEIGHTS)} {_WEIGHTS} end)::double as w
  from sources),
levels as (
  select *, sum(source_size) over () as total,
    coalesce(sum(source_size) over (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as filled,
    sum(w) over (order by source_size / w, source nulls last rows between current row and unbounded following) as w_left
  from ranked),
tried as (select *, (total - {mixture.MOST_EPOCHS} * filled)::double / w_left as level from levels),
chosen as (
  select level from tried where level * w <= {mixture.MOST_EPOCHS} * source_size order by filled, level limit 1),
targets as (
  select source, source_size,
    least((select level from chosen) * w, ({mixture.MOST_EPOCHS} * source_size)::double) as target from ranked),
planned as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from targets),
ends as (
  select k.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size as rest,
    sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows unbounded preceding) as e
  from keyed k join planned p on k.source is not distinct from p.source)
select doc_id, size, source_size, target,
  (size * (epochs + case when e - size < rest and e - rest <= rest - (e - size) then 1 else 0 end))::bigint as taken
from ends
"""

OP11 = rf"""
with words as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as body, {WORDS} as w from documents),
failing as (
  select doc_id, part,
    case when len(w) < 200 then 1 else 0 end
    + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
    + case when 100 * len(regexp_extract_all(body, '[A-Z]')) > 2 * length(body) then 4 else 0 end
    + case when regexp_matches(body, '[#$%&*|]') then 8 else 0 end
    + case when coalesce(doc_id > min(doc_id) over (partition by body), false) then 16 else 0 end as mask
  from words),
marks as (
  select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic
  from labels where doc_id is not null group by doc_id),
cells as (
  select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
  from failing left join marks using (doc_id) group by part, mask),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as letter, unnest([1, 2, 4, 8, 16]) as bit),
orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order,
    [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letters a
  join letters b on b.letter <> a.letter
  join letters c on c.letter not in (a.letter, b.letter)
  join letters d on d.letter not in (a.letter, b.letter, c.letter)
  join letters e on e.letter not in (a.letter, b.letter, c.letter, d.letter)),
steps as (
  select filter_order, step, bits[step] as bit, list_sum(bits[1:step]) as after, coalesce(list_sum(bits[1:step - 1]), 0) as before
  from orders, (select unnest([1, 2, 3, 4, 5]) as step)),
figures as (
  select part, filter_order, step, bit,
    coalesce(sum(n) filter (mask & after::int = 0), 0) as kept,
    coalesce(sum(n) filter (mask & before::int = 0 and mask & bit > 0), 0) as removed,
    coalesce(sum(n) filter (mask & before::int > 0 and mask & bit > 0), 0) as redundant,
    coalesce(sum(n) filter (mask = bit), 0) as unique_fails,
    coalesce(sum(good) filter (mask & before::int = 0 and mask & bit > 0), 0) as good_lost,
    coalesce(sum(toxic) filter (mask & before::int = 0 and mask & bit > 0), 0) as toxic_lost
  from cells, steps group by part, filter_order, step, bit)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed,
  redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
  toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley
from figures
"""

CHECKS: dict[str, str] = {
    "op3_decontaminate": OP3,
    "op5_near_dedup": OP5,
    "op6_quality_rules": OP6,
    "op7_mixture": OP7,
    "op11_filter_audit": OP11,
}
