"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from marginspark.llm import chat, line_dedup, quality

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))

#: Measures of :mod:`quality` for a table ``input(doc_id, text)``.
_MEASURES = rf"""
  texts as (select doc_id, coalesce(text, '') as t from documents),
  split as (select doc_id, t,
      list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
    from texts),
  grams as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as g
    from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from split)),
  twice as (select doc_id, i from grams
    qualify count(*) over (partition by doc_id, g) > 1),
  covered as (select doc_id, count(distinct i + k) as n
    from twice, range(5) as r(k) group by doc_id),
  measured as (select doc_id,
      len(w)::bigint as n_words,
      length(array_to_string(w, ''))::bigint as word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
      length(regexp_replace(t, '\P{{Lu}}', '', 'g'))::bigint as n_upper,
      length(regexp_replace(t, '[^!]', '', 'g'))::bigint as n_exclaims,
      len(l)::bigint as n_lines,
      (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
      len(list_filter(w, lambda x: lower(x) in ({_STOP})))::bigint as n_stop,
      coalesce(n, 0)::bigint as n_repeat_words
    from split left join covered using (doc_id))"""


def _rule(rule: quality.Rule) -> str:
    count = f"100 * {rule.count}" if rule.base else rule.count
    unit = rule.base or "1"
    inside = [
        f"{count} {sign} {bound} * {unit}"
        for sign, bound in ((">=", rule.low), ("<=", rule.high))
        if bound is not None
    ]
    return f"(({' and '.join(inside)}) or n_words < {rule.from_words})"


_BASE = " or ".join(
    f"not {_rule(r)}" for r in quality.RULES if r.name in quality.BASE_RULES
)
_KEPT = " and ".join(_rule(r) for r in quality.RULES)

#: Runs as diagonals of equal lines: for each pair of an earlier and a later
#: place of a line, neighbouring pairs at the same distance form the runs.
_LINE_DEDUP = rf"""
  texts as (select doc_id, text, string_split(text, chr(10)) as l from documents),
  flat as (select doc_id, unnest(l) as s, unnest(range(len(l))) as i from texts),
  spoken as (select doc_id, s, i,
      len(list_filter(string_split_regex(s, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as w,
      row_number() over (order by doc_id, i) as pos
    from flat where regexp_matches(s, '[^\x20\x09-\x0D]')),
  pairs as (select b.doc_id, a.doc_id as other, b.pos, b.i, b.w, b.pos - a.pos as gap
    from spoken a join spoken b on a.s = b.s and a.pos < b.pos),
  islands as (select *,
      pos - row_number() over (partition by doc_id, other, gap order by pos) as island
    from pairs),
  gone as (select distinct doc_id, i from (select doc_id, i,
      sum(w) over (partition by doc_id, other, gap, island) as run from islands)
    where run >= {line_dedup.MIN_WORDS}),
  lost as (select doc_id, list(i) as g from gone group by doc_id)"""

def _case(column: str, values: dict[str, object], other: str) -> str:
    arms = " ".join(f"when '{k}' then {v}" for k, v in values.items())
    return f"case {column} {arms} else {other} end"


_T = chat.TEMPLATE
#: The machine over roles, its state being the last role (no other state is
#: reached by two roles but ``asked``, which user and tool both lead to).
_STEPS = ", ".join(
    f"('{before}', '{role}')"
    for state, moves in _T.moves.items()
    for role in moves
    for before in (
        [_T.start] if state == _T.start
        else [r for m in _T.moves.values() for r, to in m.items() if to == state]
    )
)
_CHAT = rf"""
  turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t
    from (select conv_id, turn, role, text from conversations union all
      select -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok')),
  sized as (select *, role = 'assistant' as learned,
      {_case("role", {k: len(v) for k, v in _T.headers.items()}, "length(role) + 8")}
      + {len(_T.end)} + length(t)
      + length(t) - length(replace(t, '\', ''))
      + list_sum(list_transform([''] || regexp_extract_all(t, '#{{3,}}'),
          lambda x: greatest(length(x) - 2, 0)))
      + (length(t) - length(replace(t, '</turn>', ''))) // 7 as n,
      (lag(role, 1, '{_T.start}') over (partition by conv_id order by turn, role, t), role)
        in ({_STEPS}) as step
    from turns)"""

#: Lines with their line feeds, joined up to the two cuts.
_FILL_MIDDLE = r"""
  texts as (select doc_id, coalesce(text, '') as t, sha256('7:' || doc_id::varchar) as h from documents),
  drawn as (select *, string_split(t, chr(10)) as l,
      [('0x' || h[8 * k + 1:8 * k + 8])::bigint for k in range(4)] as r from texts),
  counted as (select *, case when t = '' then 0
      when suffix(t, chr(10)) then len(l) - 1 else len(l) end::bigint as n from drawn),
  cuts as (select *, least(r[1] % (n + 1), r[2] % (n + 1)) as i, greatest(r[1] % (n + 1), r[2] % (n + 1)) as j,
      case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 100
        then 'plain' when r[4] % 100 < 50 then 'spm' else 'psm' end as form from counted),
  ends as (select *,
      case when i = 0 then 0 when i = n then length(t) else length(array_to_string(l[:i], chr(10))) + 1 end as a,
      case when j = 0 then 0 when j = n then length(t) else length(array_to_string(l[:j], chr(10))) + 1 end as b
    from cuts),
  made as (select *, t[:a] as p, t[a + 1:b] as m, t[b + 1:] as s from ends),
  written as (select *, case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
      else '<S>' || s || '<P>' || p || '<M>' || m end as output from made)"""

ORACLES = {
    "op13_fill_middle": f"""with {_FILL_MIDDLE}
  select doc_id, n, form,
    case when form <> 'plain' then length(p) end::bigint as prefix_chars,
    case when form <> 'plain' then length(m) end::bigint as middle_chars,
    sha256(output) as output_sha256, sha256(t) as restored_sha256
  from written""",
    "op5_chat": f"""with {_CHAT}
  select conv_id, count(*)::bigint as n_turns,
    sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn, role, t)) as turns_sha256,
    coalesce(sum(length(t)) filter (learned), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(t, '' order by turn, role, t) filter (learned), '')) as loss_sha256,
    sum(n)::bigint as formatted_chars, bool_and(step) as valid
  from sized group by conv_id""",
    "op4_topk": """with good as (select vec_id,
      list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
    from embeddings where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  q as (select vec_id as query_id, unnest(v) as a, unnest(range(len(v))) as j
    from good where vec_id % 50 = 0),
  c as (select vec_id, unnest(v) as b, unnest(range(len(v))) as j from good),
  scores as (select query_id, vec_id, sum(a * b)::bigint as score
    from q join c using (j) where vec_id <> query_id group by all)
  select query_id, (row_number() over (partition by query_id
      order by score desc, vec_id))::int as rank, vec_id, score
  from scores qualify rank <= 5""",
    "op9_line_dedup": f"""with {_LINE_DEDUP}
  select doc_id,
    case when g is null then text else array_to_string(
      list_filter(l, lambda x, i: not list_contains(g, i - 1)), chr(10)) end as text,
    coalesce(len(l), 0)::bigint as n_lines, coalesce(len(g), 0)::bigint as n_removed_lines
  from texts left join lost using (doc_id)""",
    "op10_quality_rules": f"""with {_MEASURES}
  select doc_id, {", ".join(quality.MEASURES)},
    ({_BASE}) as base_failed, ({_KEPT}) as kept
  from measured""",
}
