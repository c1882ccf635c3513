"""DuckDB SQL of the registered queries, written from the operators' definitions."""

from __future__ import annotations

from . import fixtures as X
from .functions import prompts
from .functions import vocab as V
from .queries import ASKED, BREAKER, CORPUS_DOMAINS, CORPUS_POLICY, TTL, corpus_mixed, corpus_policies, plumbing
from .sources.policies import Policy


def s(x: object) -> str:
    """An SQL literal."""
    if x is None:
        return "null"
    return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(s(v) for v in values) + "]::varchar[]"


def values(rows, names: str) -> str:
    return f"(values {', '.join('(' + ', '.join(s(x) for x in r) + ')' for r in rows)}) v({names})"


def alnum(c: str) -> str:
    return f"[t for t in regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+') if length(t) >= 3 and not list_contains({arr(V.STOPWORDS)}, t)]"


def word(c: str) -> str:
    return f"[lower(t) for t in regexp_extract_all(coalesce({c}, ''), '[a-zA-Z]+(?:[-''][a-zA-Z]+)?')]"


def letters(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-zA-Z]+'))"


def strip(c: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({c}, ''), '^\s+', ''), '\s+$', '')"


def stem(t: str) -> str:
    cases = " ".join(f"when {t} like '%{x}' and length({t}) > {len(x) + 2} then left({t}, length({t}) - {len(x)})" for x in ("ing", "ed", "es", "s"))
    return f"(case {cases} else {t} end)"


def keywords(c: str, p: Policy) -> str:
    pairs = sorted(p.synonym_map.items())
    table = f"map({arr(k for k, _ in pairs)}, {arr(v for _, v in pairs)})"
    return f"list_distinct([coalesce({table}[k], k) for k in [{stem('t')} for t in {alnum(c)}]])"


def has(tokens: str, terms) -> str:
    return f"list_has_any({tokens}, {arr(terms)})" if list(terms) else "false"


def within(c: str, phrases) -> str:
    return "(" + " or ".join(f"contains({c}, {s(p)})" for p in phrases) + ")"


def how_many(c: str, phrases) -> str:
    return "(" + " + ".join(f"contains({c}, {s(p)})::int" for p in phrases) + ")"


def whole(c: str, terms) -> str:
    body = "|".join(t.replace("-", "\\-") for t in terms)
    return rf"regexp_matches(coalesce({c}, ''), {s(r'(?i)(^|[^\p{L}\p{N}_])(' + body + r')($|[^\p{L}\p{N}_])')})"


def case(pairs, default: str) -> str:
    return "(case " + " ".join(f"when {c} then {s(v)}" for c, v in pairs) + f" else {default} end)"


MARKER = lambda low: rf"(regexp_matches({low}, '(^|\s)\d+[.)]\s') or {within(low, V.STEP_MARKERS)})"
COUNT = lambda tokens, terms: f"len([t for t in {tokens} if list_contains({arr(terms)}, t)])"
SIGNALS = f"""{COUNT('toks', V.ACTION_VERBS)} as action_verbs, {MARKER('low')} as has_step_markers, length(raw) as length_chars, len(toks) as length_tokens,
  length(raw) - length(replace(replace(raw, ',', ''), ';', '')) as punct_signals, {how_many('low', V.EXPLANATORY_HINTS)} as explanatory_hints"""


def signals(source: str, key: str = "doc_id") -> str:
    """CTEs up to ``sig``: key, raw, low, lowraw, toks and the quality signals, parts and score."""
    return f"""src as ({source}), base as (select {key}, coalesce(text, '') as raw, lower({strip('text')}) as low, lower(coalesce(text, '')) as lowraw from src),
tok as (select *, {word('low')} as toks from base), sig0 as (select *, {SIGNALS},
  len([t for t in toks if list_contains({arr(V.PART_WORDS)}, t) or (t like '%s' and list_contains({arr(V.PART_WORDS)}, left(t, length(t) - 1)))]) as part_terms from tok),
sig as (select *, has_step_markers or action_verbs >= 2 or (action_verbs >= 1 and part_terms >= 1) as procedural,
  greatest(0.0, least(1.0, 0.25 * least(action_verbs, 4) / 4.0 + 0.25 * least(part_terms, 4) / 4.0 + case when has_step_markers then 0.2 else 0 end + 0.2 * least(length_tokens, 40) / 40.0
    + 0.1 * least(punct_signals, 6) / 6.0 - 0.1 * least(explanatory_hints, 3) / 3.0)) as quality_score,
  action_verbs + case when has_step_markers then 2 else 0 end + least(punct_signals, 3) as hits from sig0),
act as (select *, greatest(0.0, least(1.0, 0.5 + case when hits >= 5 then 0.2 when hits >= 3 then 0.1 else 0 end + case when {has('toks', V.SCHEDULE_TOKENS)} then 0.1 else 0 end
  + case when part_terms > 0 then 0.1 else 0 end - case when regexp_matches(raw, '(^|[^\\p{{L}}\\p{{N}}_])(19|20)\\d\\d($|[^\\p{{L}}\\p{{N}}_])') then 0.1 else 0 end)) as action_score,
  {GATED_KIND} as gated_kind, {GENERIC_KIND} as generic_kind from sig)"""


_MAINT = f"({has('toks', V.KIND_MAINTENANCE_TOKENS)} or {within('lowraw', V.KIND_OIL_PHRASES)})"
GATED_KIND = case([
    (within("lowraw", V.KIND_HOWTO_PHRASES), "PROCEDURAL"), (f"{has('toks', V.KIND_REPAIR_TOKENS)} and action_verbs >= 1", "PROCEDURAL"), (f"{_MAINT} and (action_verbs >= 2 or has_step_markers)", "PROCEDURAL"), (_MAINT, "OVERVIEW"),
    (within("lowraw", V.KIND_INFO_PHRASES), "INFORMATIONAL"), (f"{has('toks', V.INTENT_DIAGNOSE)} or {within('lowraw', ['symptoms', 'signs of'])}", "DIAGNOSTIC"), (has("toks", V.INTENT_OVERVIEW), "OVERVIEW"),
], "'UNKNOWN'")
GENERIC_KIND = case([
    (within("lowraw", V.KIND_INFO_PHRASES), "INFORMATIONAL"), (within("lowraw", ["symptoms", "signs of"]), "DIAGNOSTIC"), ("action_verbs >= 2 or has_step_markers", "PROCEDURAL"), (has("toks", V.INTENT_OVERVIEW), "OVERVIEW"),
], "'UNKNOWN'")


def client_kind(c: str) -> str:
    low, t = f"lower(coalesce({c}, ''))", letters(c)
    return case([
        (f"starts_with({low}, 'how to') or contains({low}, 'steps to') or {COUNT(t, V.CLIENT_VERBS)} >= 2", "PROCEDURAL"), (has(t, V.CLIENT_MAINTENANCE), "OVERVIEW"),
        (within(low, V.KIND_INFO_PHRASES), "INFORMATIONAL"), (within(low, ["symptoms", "signs of"]), "DIAGNOSTIC"),
    ], "'UNKNOWN'")


def bonus(c: str) -> str:
    return f"least(0.3, case when {has(letters(c), V.CLIENT_MAINTENANCE)} then 0.2 else 0 end + case when {has(letters(c), ['how', 'steps'])} then 0.1 else 0 end)"


def intent(tokens: str) -> str:
    return case([(has(tokens, V.INTENT_HOWTO), "HOWTO"), (has(tokens, V.INTENT_DIAGNOSE), "DIAGNOSE"), (has(tokens, V.INTENT_OVERVIEW), "OVERVIEW"), (has(tokens, V.INTENT_INFO), "INFO")], "'UNKNOWN'")


def fit(matrix, i: str, k: str) -> str:
    return "(case " + " ".join(f"when {i} = {s(a)} and {k} = {s(b)} then {v}" for a, row in matrix.items() for b, v in zip(V.KINDS, row, strict=True)) + " end)"


def fit_gated(i: str, k: str) -> str:
    return f"(case when {i} in ('OVERVIEW', 'INFO', 'UNKNOWN') and {k} in ('OVERVIEW', 'INFORMATIONAL') then least(1.0, {fit(V.INTENT_FIT, i, k)} + 0.15) else {fit(V.INTENT_FIT, i, k)} end)"


def set_domain(tokens: str, domains) -> str:
    n = [f"len(list_intersect(list_distinct({tokens}), {arr(t)}))" for _, t in domains]
    top = f"greatest({', '.join(n)})"
    return f"(case when {top} = 0 then 'unknown' when {' + '.join(f'({x} = {top})::int' for x in n)} > 1 then 'ambiguous' " + " ".join(f"when {x} = {top} then {s(d)}" for (d, _), x in zip(domains, n, strict=True)) + " end)"


def first_domain(c: str, domains) -> str:
    return case([(within(f"lower(coalesce({c}, ''))", t), d) for d, t in domains], "'unknown'")


def rule_counts(c: str, rules) -> dict[str, str]:
    out: dict[str, str] = {}
    for d, terms in rules:
        n = " + ".join(f"{whole(c, [t])}::int" for t in terms)
        out[d] = f"{out[d]} + {n}" if d in out else n
    return {d: f"({n})" for d, n in out.items()}


def best(counts: dict[str, str]) -> str:
    """From columns n_<domain>: the domain of most hits, the earlier on ties."""
    names = list(counts)
    return f"(case when greatest({', '.join(names)}) = 0 then null " + " ".join(f"when {n} = greatest({', '.join(names)}) then {s(d)}" for n, d in counts.items()) + " end)"


def cosine_rows(k: int = 10) -> str:
    return f"""vecs as (select vec_id, label, embedding::double[] as e from embeddings),
cos as (select q.vec_id as query_id, v.vec_id, v.label, list_sum([a[1] * a[2] for a in list_zip(q.e, v.e)]) / (sqrt(list_sum([x * x for x in q.e])) * sqrt(list_sum([x * x for x in v.e]))) as sim
  from vecs q join vecs v on q.vec_id % 20 = 0 and q.vec_id != v.vec_id),
top as (select * from (select *, row_number() over (partition by query_id order by sim desc, vec_id)::int as rank from cos) where rank <= {k})"""


JUDGED = "judged as (select q.vec_id as query_id, v.vec_id from embeddings q join embeddings v on q.label = v.label and q.vec_id % 20 = 0 and q.vec_id != v.vec_id)"
METRICS = """per as (select j.query_id, case when min(rank) = 1 then 1.0 else 0 end as acc1, coalesce(1.0 / min(rank), 0) as mrr, case when min(rank) <= 3 then 1.0 else 0 end as recall_any,
  count(*) filter (rank <= 3) / count(*)::double as recall_all from judged j left join top t on t.query_id = j.query_id and t.vec_id = j.vec_id group by j.query_id)"""
REQUESTS = "req as (select source as query_id, source as query, row_number() over (partition by source order by doc_id) - 1 as request_index, doc_id as original_index, text, case when doc_id % 3 != 0 then (doc_id % 97) / 97.0::double end as similarity from documents)"
HOWTO_DOCS = f"select -1 - o as doc_id, t as text from {values([(o, t) for o, _, t in X.CORPUS], 'o, t')}"
WITH_HOWTO = f"select doc_id, text from documents union all {HOWTO_DOCS}"
PAIRED = "paired as (select d.doc_id, d.text, b.text as query from documents d join benchmark b on b.item_id = d.doc_id % (select max(item_id) + 1 from benchmark))"
VERBS = " + ".join(f"{whole('text', [v])}::int" for v in V.PROCEDURE_VERBS)
BULLETS = r"len(regexp_extract_all(coalesce(text, ''), '(?m)^\s*(?:\d+[)\.:]|[-*+])\s+'))"
SEPARATORS = r"len(regexp_extract_all(coalesce(text, ''), '[.;:]\s+|,\s+'))"


HOWTO_ROWS = values([(q, t, i, o, d, m) for q, t in X.QUERIES for i, (o, m, d) in enumerate(X.CORPUS)], "query_id, query, request_index, original_index, text, similarity")
CORPUS_ROWS = f"""(select b.item_id as query_id, case when b.item_id % 4 = 0 then regexp_extract(b.text, '[a-zA-Z]+') else b.text end as query, row_number() over (partition by b.item_id order by d.doc_id) - 1 as request_index, d.doc_id as original_index, d.text,
  case when d.doc_id % 3 != 0 then (d.doc_id % 97) / 97.0::double end as similarity from documents d join benchmark b on b.item_id = d.doc_id % (select max(item_id) + 1 from benchmark)
  union all select * from {values([(-q, t, i, -1 - o, d, m if i % 3 else None) for q, t in [*X.QUERIES, *ASKED] for i, (o, m, d) in enumerate(X.CORPUS)], "query_id, query, request_index, original_index, text, similarity")})"""


def gated_pipeline(source: str = HOWTO_ROWS, p: Policy | None = None) -> str:
    """CTEs of request rows under a policy (the plumbing policy): facts, score, gated, final."""
    p = p or plumbing()
    counts = {c: rule_counts(c, V.DOMAIN_RULES) for c in ("query", "text")}
    n_cols = ", ".join(f"{n} as {pre}_{d}" for c, pre in (("query", "q"), ("text", "d")) for d, n in counts[c].items())
    names = list(counts["query"])
    items = {c: "list_filter([" + ", ".join(f"case when {whole(c, a)} then {s(i)} end" for i, a in p.item_aliases.items()) + "], lambda x: x is not null)" for c in ("query", "text")}
    trimmed = "case when length(text) > 800 then left(text, 600) || ' [...] ' || right(text, 200) else text end"
    tokens = f"list_distinct({word('query')})"
    ambiguous = f"(len({tokens}) <= 1 or {has(tokens, p.ambiguous_triggers)})" if p.ambiguous_triggers else "false"
    signal = f"{BULLETS} * 4 + ({VERBS}) * 2 + least({SEPARATORS}, 8)"
    about = [*V.KIND_MAINTENANCE_TOKENS, "fix", "repair", "replace"]
    return f"""rows as (select query_id::bigint as query_id, query, request_index::int as request_index, original_index::bigint as original_index, text, similarity::double as similarity from {source}),
f0 as (select *, {n_cols}, {items['query']} as q_items, {items['text']} as d_items from rows),
f1 as (select *, {trimmed} as trimmed, case when len(q_items) = 1 then q_items[1] end as query_item, {best({f'q_{d}': d for d in names})} as query_domain, {best({f'd_{d}': d for d in names})} as doc_domain,
  {' + '.join(f'd_{d}' for d in names)} as doc_hits, {' + '.join(f'q_{d}' for d in names)} as query_hits from f0),
facts as (select *, case when len(d_items) > 0 then coalesce(list_contains(d_items, query_item), false) end as same_item, coalesce(query_domain = doc_domain, false) as same_domain from f1),
k as (select *, {keywords('query', p)} as qk, {keywords('text', p)} as dk, ({signal})::int as signal, ({signal.replace('coalesce(text,', 'coalesce(trimmed,')})::int as cap_signal, ({VERBS})::int as verbs, {word("lower(text)")} as dt from facts),
t as (select *, case when len(qk) = 0 then 2 when len(list_intersect(qk, dk)) = 0 then 0 when {has('list_intersect(qk, dk)', p.tier_a)} then 2 else 1 end as overlap_tier,
  not {has('qk', p.domain_keywords)} or {has('dk', p.domain_keywords)} as allowed, {has('qk', p.intent_keywords)} as intends from k),
g as (select *, case when request_index >= 5 and overlap_tier = 0 then 'tier_0' when request_index >= 5 and not allowed then 'domain' else '-' end as gate, overlap_tier * 100 + signal as tie_breaker from t),
b0 as (select *, case when gate != '-' then 0 when query_item is null then case when same_domain and {has('dt', about)} then 2 when same_domain then 1 else 0 end
  when coalesce(same_item, false) then case when verbs >= 2 then 3 else 2 end when same_domain then 1 else 0 end as b from g),
score as (select *, case when intends and b = 3 and cap_signal < 2 then 2 when intends and b = 2 and cap_signal < 1 then 1 else b end as bucket from b0),
moded as (select *, case when {ambiguous} then 'AMBIGUOUS' else 'SPECIFIC' end as gmode from score),
clamps as (select *, case when case when not same_domain or (query_item is not null and not coalesce(same_item, false)) then 0 else bucket end = 0 and same_domain and coalesce(same_item, false) then 1
  when not same_domain or (query_item is not null and not coalesce(same_item, false)) then 0 else bucket end as kept from moded),
clamped as (select *, kept as clamped, case when gmode = 'AMBIGUOUS' then bucket else kept end as tier from clamps),
{signals('select distinct original_index, text from rows', 'original_index')},
gate as (select c.*, a.action_score, a.gated_kind as doc_kind, a.generic_kind, a.action_verbs, a.quality_score, {intent(word('query'))} as query_intent, len({word('query')}) <= 1 as short_query,
  len(list_intersect(list_distinct([x for x in {word('query')} if length(x) >= 3 and not list_contains({arr(V.OVERLAP_STOPWORDS)}, x)]), [x for x in {word('c.text')} if length(x) >= 3 and not list_contains({arr(V.OVERLAP_STOPWORDS)}, x)])) as overlap
  from clamped c join act a using (original_index)),
r0 as (select *, {fit_gated('query_intent', 'doc_kind')} as intent_fit from gate),
r1 as (select *, count(distinct tier) over q <= 2 as flat, 1.0 - request_index / greatest(1, count(*) over q - 1)::double as place from r0 window q as (partition by query_id)),
r1b as (select *, case when (gmode = 'AMBIGUOUS' or short_query) and flat then coalesce(similarity, place) * 0.85::double + overlap * 0.15::double else tier end as final_score from r1),
r1c as (select *, case when tier > 0 and final_score > 0 then action_score * intent_fit else 0.0 end as final_rank,
  case when final_score = 0 then case when gmode = 'AMBIGUOUS' then 'low_signal' when not same_domain then 'domain_mismatch' when query_item is not null and same_item = false then 'item_mismatch' when len(d_items) = 0 then 'no_item_found' else 'low_signal' end end as zero_reason from r1b),
r2 as (select *, case when zero_reason = 'item_mismatch' then 0 when zero_reason = 'no_item_found' and (same_domain or coalesce(same_item, false)) then 1 else 2 end as ztier,
  case when zero_reason = 'no_item_found' then 0.1 * intent_fit else final_score end as score_raw, greatest(0.0, coalesce(similarity, 0.0)) as sim0 from r1c),
r3 as (select *, case when tier > 0 then 'ACCEPT' else 'REJECT_TIER_' || ztier end as decision, case when tier > 0 then final_rank else 0.0 end as rank_score,
  gmode = 'AMBIGUOUS' and score_raw <= 0 and 0.12 * sim0 > score_raw as soft from r2),
gated as (select *, case when soft then 0.12 * sim0 else score_raw end as shown_score, greatest(least(1.0, greatest(0.0, score_raw / 3.0)), case when soft then 0.04 * sim0 else 0.0 end) as score_norm,
  row_number() over (partition by query_id order by case when rank_score > 0 then 0 else 1 end, case when rank_score > 0 then tier end desc nulls last, case when rank_score > 0 then rank_score end desc nulls last,
  case when rank_score > 0 then intent_fit end desc nulls last, case when rank_score > 0 then doc_kind end desc nulls last, case when rank_score > 0 then 0 else ztier end, sim0 desc, case when rank_score > 0 then original_index end desc nulls last, original_index)::int as policy_rank,
  row_number() over (partition by query_id order by tier desc, tie_breaker desc, request_index) - 1 as idx from r3)"""


def final_pipeline(said: str, err: str) -> str:
    """CTEs after ``gated_pipeline``: the fine pass over the first ten accepted rows of a query, whose outputs are
    expressions of original_index, and both final orders."""
    return f"""asked as (select query_id, original_index, {said} as said, {err} as err from (select *, row_number() over (partition by query_id order by policy_rank) as n from gated where decision = 'ACCEPT') where n <= 10 and length(coalesce(text, '')) > 0),
fine as (select g.*, a.original_index is not null and (a.said is not null or a.err is not null) as used,
  case when a.said is not null or a.err is not null then coalesce(a.said, greatest(0, least(100, round_even((0.7::double * g.intent_fit + 0.3::double * coalesce(g.similarity, 0)) * 100, 0)::int))) end as fine_score, a.err || '|fallback' as error
  from gated g left join asked a using (query_id, original_index)),
final as (select *, row_number() over (partition by query_id order by decision = 'ACCEPT' desc, tier desc, coalesce(fine_score, -1) desc, rank_score desc, coalesce(similarity, 0) desc, original_index, idx)::int as rank from fine),
shown as (select *, row_number() over (partition by query_id order by case when decision = 'ACCEPT' then 0 else 2 end, case when decision = 'ACCEPT' then rank end,
  case when decision != 'ACCEPT' then case zero_reason when 'item_mismatch' then 0 when 'no_item_found' then 1 when 'domain_mismatch' then 2 else 9 end end, coalesce(similarity, 0) desc, original_index)::int as client_rank from final)"""


FINAL = final_pipeline("(case original_index when 0 then 77 when 4 then 41 when 1 then 66 end)", "(case original_index when 2 then 'json_parse_failed' when 6 then 'empty_output' end)")
CORPUS_FINAL = final_pipeline("(case abs(original_index) % 5 when 0 then 77 when 2 then 41 when 3 then 66 end)", "(case abs(original_index) % 5 when 1 then 'json_parse_failed' when 4 then 'empty_output' end)")
GENERIC = f"""g1 as (select *, {set_domain(word('query'), V.GENERIC_DOMAINS)} as qd, {set_domain(word('text'), V.GENERIC_DOMAINS)} as dd, len(list_distinct({word('query')})) as qn, {fit(V.INTENT_FIT, 'query_intent', 'generic_kind')} as gfit from gate),
g2 as (select *, qd not in ('unknown', 'ambiguous') and dd not in ('unknown', 'ambiguous') and qd != dd as other, case when qn <= 1 or qd in ('unknown', 'ambiguous') then 'AMBIGUOUS' else 'SPECIFIC' end as mode, greatest(0.0, least(1.0, action_verbs / 4.0 * gfit)) as base from g1),
GBUCKET
g4 as (select *, case when other then greatest(0.0, base - 0.25) else base end as pre, case when mode = 'SPECIFIC' and other then 'REJECT_TIER_9' when mode = 'SPECIFIC' and gtier <= 0 then 'REJECT_TIER_2' when mode = 'AMBIGUOUS' and gtier <= 0 then 'KEEP_LOW_SIGNAL' else 'ACCEPT' end as gdecision from g3),
g5 as (select *, case when gdecision = 'ACCEPT' then pre else 0.0 end as grank, case gdecision when 'ACCEPT' then 0 when 'KEEP_LOW_SIGNAL' then 1 else 2 end as grp from g4)"""
# the generic policy has no gates and an empty context: tier 0 without any shared keyword, no caps but for intent
GENERIC = GENERIC.replace("GBUCKET", f"""gk as (select *, {keywords('query', Policy())} as gqk, {keywords('text', Policy())} as gdk from g2),
g3a as (select *, case when request_index >= 5 and len(gqk) > 0 and len(list_intersect(gqk, gdk)) = 0 then 0 when query_item is null then case when same_domain and {has('dt', [*V.KIND_MAINTENANCE_TOKENS, 'fix', 'repair', 'replace'])} then 2 when same_domain then 1 else 0 end
  when coalesce(same_item, false) then case when verbs >= 2 then 3 else 2 end when same_domain then 1 else 0 end as gb, {has('gqk', V.CONTEXT_INTENT)} as gintends from gk),
g3 as (select *, case when gintends and gb = 3 and cap_signal < 2 then 2 when gintends and gb = 2 and cap_signal < 1 then 1 else gb end as gtier from g3a),""")


GENERIC_OUT = """select query_id, original_index, gtier as tier, mode, gdecision as decision, case when gdecision = 'REJECT_TIER_9' then 'domain_mismatch' when gdecision != 'ACCEPT' then 'low_signal' else '-' end as zero_reason, generic_kind as doc_kind, dd as doc_domain, round(gfit, 6) as intent_fit,
  round(grank, 6) as rank_score, row_number() over (partition by query_id order by grp, gtier desc, grank desc, gfit desc, case generic_kind when 'PROCEDURAL' then 4 when 'DIAGNOSTIC' then 3 when 'OVERVIEW' then 2 when 'INFORMATIONAL' then 1 else 0 end desc, coalesce(similarity, 0) desc, request_index)::int as policy_rank from g5"""


def fallback_sql() -> str:
    rows = [(q, "maintenance" if q == 4 else t, t, o, d, m, i + 1) for q, t in X.QUERIES for i, (o, m, d) in enumerate(X.CORPUS)]
    ci = f"case when {has(letters('query'), V.CLIENT_MAINTENANCE)} then 'OVERVIEW' else 'UNKNOWN' end"
    return f"""with r as (select * from {values(rows, 'query_id, query, asked, original_index, text, similarity, retrieval_rank')}),
a as (select *, {first_domain('text', V.CLIENT_DOMAINS)} as domain, {client_kind('text')} as doc_kind, {ci} as qi, {bonus('text')} as bonus, len(list_intersect({letters('query')}, {letters('text')})) as overlap from r),
b as (select *, 0.7 * similarity::double * {fit(V.CLIENT_INTENT_FIT, 'qi', 'doc_kind')} + 0.15 * overlap + 0.15 * bonus as score from a),
c as (select *, row_number() over (partition by query_id order by score desc, retrieval_rank) as r from b),
d as (select *, min(r) over (partition by query_id, domain) = r as best from c), e as (select *, best and sum(best::int) over (partition by query_id order by r rows unbounded preceding) <= 3 as is_head from d)
select query_id::bigint as query_id, original_index::bigint as original_index, domain, doc_kind, round(score, 6) as score, is_head, row_number() over (partition by query_id order by is_head desc, r)::int as rank,
  len({letters('query')}) <= 1 as ambiguous, case when len({letters('query')}) = 0 then 'empty' when len({letters('query')}) <= 1 and {has(letters('query'), V.CLIENT_TRIGGERS)} then 'trigger' when len({letters('query')}) <= 1 then 'too_short' else '-' end as reason from e"""


def domain_sql() -> str:
    counts = rule_counts("text", CORPUS_DOMAINS)
    cols = ", ".join(f"{n} as n_{d}" for d, n in counts.items())
    choose = best({f"n_{d}": d for d in counts})
    listed = "array_to_string(list_filter([" + ", ".join(f"case when {whole('text', a)} then {s(i)} end" for i, a in CORPUS_POLICY.item_aliases.items()) + "], lambda x: x is not null), ',')"
    return f"""with c as (select *, {cols} from documents) select doc_id, {set_domain(word("lower(text)"), CORPUS_DOMAINS)} as generic, {first_domain('text', CORPUS_DOMAINS)} as client, coalesce({choose}, '-') as chosen,
  coalesce({choose}, '-') as inferred, {listed} as items from c"""


def cache_sql(key: str) -> str:
    """Hits of a cache by key, request after request."""
    return f"""with recursive e as (select event_id, {key} as k, epoch_us(ts) as t, row_number() over (partition by {key} order by ts, event_id) as n from events),
f as (select event_id, k, n, t as w, false as hit from e where n = 1 union all select e.event_id, e.k, e.n, case when e.t - f.w < {TTL[key]} * 1000000::bigint then f.w else e.t end, e.t - f.w < {TTL[key]} * 1000000::bigint from f join e on e.k = f.k and e.n = f.n + 1)
select event_id, hit from f"""


def flag(c: str) -> str:
    return f"case when {c} is null then '?' when {c} then '+' else 'x' end"


FLAGS = "case when doc_id % 3 = 0 then '?' when doc_id % 3 = 1 then '+' else 'x' end"
PERCENT = lambda x: f"greatest(0, least(100, round_even({x}, 0)::int))"
G = gated_pipeline()
C = gated_pipeline(CORPUS_ROWS, corpus_mixed())
GATED_OUT = "select query_id, original_index, gmode as mode, tier, decision, coalesce(zero_reason, '-') as zero_reason, doc_kind, round(intent_fit, 6) as intent_fit, round(rank_score, 6) as rank_score, round(shown_score, 6) as score, round(score_norm, 6) as score_norm, policy_rank from gated"
IDENTITY = "select query_id, original_index, array_to_string(d_items, ',') as doc_items, query_item, same_item, same_domain, query_domain, doc_domain, doc_hits > 0 as domain_match_doc, query_hits > 0 as domain_match_query, doc_hits from facts"
GATE_STATS = "select query_id, count(*) filter (gate = '-' and overlap_tier = 2) as tier_a, count(*) filter (gate = '-' and overlap_tier = 1) as tier_b, count(*) filter (gate != '-') as skipped from score group by 1"
PROMPTS = f"""said as (select d.doc_id, d.doc_id % (select max(item_id) + 1 from benchmark) as item_id, substr(coalesce(d.text, ''), 1, 1600) as doc from documents d),
asked as (select s.*, coalesce(b.text, '') as query, {s(prompts.FINE)} || chr(10) || 'QUERY: ' || coalesce(b.text, '') || chr(10) || 'DOCUMENT: ' || s.doc as prompt from said s join benchmark b using (item_id))"""
BREAKDOWN = f"""select query_id, count(*) filter (decision = 'ACCEPT') as accepted, count(*) filter (decision = 'KEEP_LOW_SIGNAL') as kept, {', '.join(f"count(*) filter (decision = 'REJECT_TIER_{t}') as reject_{t}" for t in (0, 1, 2, 9))}, 0::bigint as other from gated group by 1"""
ORACLES: dict[str, str] = {
    "prompt_hash": f"with {PROMPTS} select doc_id, sha1(prompt) as prompt_sha1, 'm:' || sha1(prompt) || ':' || sha1(doc) || ':' || sha1(query) as cache_key from asked",
    "fine_outputs": f"""with {PROMPTS}, h as (select *, ('0x' || substr(md5(prompt), 1, 6))::int as h from asked)
select item_id as query_id, doc_id as original_index, case h % 8 when 0 then 50 when 1 then null when 2 then null else h % 101 end as fine,
  case h % 8 when 1 then 'empty_output' when 2 then 'fine_score_timeout' else '-' end as error, case when h % 8 = 0 then 2 else 1 end as attempts from h""",
    "topk_cosine": f"with {cosine_rows()} select query_id, vec_id, round(sim, 6) as sim, rank, label from top",
    "retrieval_metrics": f"with {cosine_rows()}, {JUDGED}, {METRICS} select query_id, round(acc1, 6) as acc1, round(mrr, 6) as mrr, round(recall_any, 6) as recall_any, round(recall_all, 6) as recall_all from per",
    "retrieval_average": f"with {cosine_rows()}, {JUDGED}, {METRICS} select count(*) as queries, round(avg(acc1), 6) as acc1, round(avg(mrr), 6) as mrr, round(avg(recall_any), 6) as recall_any, round(avg(recall_all), 6) as recall_all from per",
    "diversified_topk": f"""with {cosine_rows()}, r as (select *, row_number() over (partition by query_id order by round(sim, 6) desc, rank) as r from top), d as (select *, min(r) over (partition by query_id, label) = r as best from r),
e as (select *, best and sum(best::int) over (partition by query_id order by r rows unbounded preceding) <= 3 as is_head from d) select query_id, vec_id, label, is_head, row_number() over (partition by query_id order by is_head desc, r)::int as rank from e""",
    "missing_sim_default": f"with {REQUESTS} select query_id, original_index, round(coalesce(similarity, 1.0 - request_index / greatest(1, count(*) over (partition by query_id) - 1)), 6) as similarity from req",
    "truncate_usage": f"with {REQUESTS}, u as (select query_id, max(length(left(query, 256))) as query_tokens, sum(length(left(text, 512)))::bigint as document_tokens, count(*) as pairs from req group by 1) select *, query_tokens + document_tokens as total_tokens from u",
    "request_status": f"with {REQUESTS} select query_id, count(text) as documents, case when count(text) = 0 then 422 when count(text) > 50 then 413 else 200 end as status from req group by 1",
    "last_wins": f"with {REQUESTS} select query_id, original_index % 7 as original_index, max(request_index) as request_index from req group by 1, 2",
    "text_forms": f"""with t as (select doc_id, coalesce(text, '') as t, {strip("replace(text, chr(10), ' ')")} as o from documents) select doc_id, left(t, 512) as truncated, case when length(t) > 800 then left(t, 600) || ' [...] ' || right(t, 200) else t end as trimmed,
  case when length(o) > 80 then left(o, 77) || '...' else o end as snippet, {FLAGS} as flag from t""",
    "loose_numbers": r"select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as double), -1) as k, coalesce(nullif(regexp_extract(event_type, '\b(3|2|1|0)\b', 1), '')::double, -1) as kind from events",
    "keyword_sets": f"select doc_id, len({alnum('text')}) as tokens, array_to_string(list_sort({keywords('text', CORPUS_POLICY)}), ' ') as keywords, len({letters('text')}) as letters from documents",
    "quality_signals": f"with {signals('select doc_id, text from documents')} select doc_id, action_verbs, has_step_markers, length_chars, length_tokens, punct_signals, explanatory_hints from sig",
    "gated_quality": f"with {signals(WITH_HOWTO)} select doc_id, part_terms, procedural, round(quality_score, 6) as quality_score, round(action_score, 6) as action_score from act",
    "doc_kinds": f"with {signals(WITH_HOWTO)} select doc_id, gated_kind as gated, generic_kind as generic, {client_kind('raw')} as client, round({bonus('raw')}, 6) as bonus from act",
    "query_intents": f"""with r as (select conv_id, turn, text from conversations union all select -q, 0, t from {values(X.QUERIES, 'q, t')}), a as (select *, {word("lower(coalesce(text, ''))")} as w from r),
b as (select *, {intent('w')} as intent, case when {has(letters('text'), V.CLIENT_MAINTENANCE)} then 'OVERVIEW' else 'UNKNOWN' end as client_intent, {has('w', V.INTENT_HOWTO)} as howto,
  len(list_distinct(w)) <= 1 or {set_domain('w', V.GENERIC_DOMAINS)} in ('unknown', 'ambiguous') as ambiguous, len(list_distinct(w)) <= 1 or {has('w', CORPUS_POLICY.ambiguous_triggers)} as triggered, {client_kind('text')} as kind from a)
select conv_id, turn, intent, client_intent, howto, ambiguous, triggered, kind, round({fit_gated('intent', 'kind')}, 6) as fit, round({fit(V.CLIENT_INTENT_FIT, 'client_intent', 'kind')}, 6) as client_fit from b""",
    "procedure_signals": f"""with r as (select doc_id, text from documents union all select -i, t from {values(X.STEPS, 'i, t')}), c as (select doc_id, {BULLETS} as bullets, ({VERBS})::int as verbs, {SEPARATORS} as separators from r)
select *, bullets * 4 + verbs * 2 + least(separators, 8) as signal from c""",
    "keyword_tiers": f"""with {PAIRED}, k as (select *, {keywords('query', CORPUS_POLICY)} as qk, {keywords('text', CORPUS_POLICY)} as dk from paired) select doc_id,
  case when len(qk) = 0 then 2 when len(list_intersect(qk, dk)) = 0 then 0 when {has('list_intersect(qk, dk)', CORPUS_POLICY.tier_a)} then 2 else 1 end as tier, not {has('qk', CORPUS_POLICY.domain_keywords)} or {has('dk', CORPUS_POLICY.domain_keywords)} as allowed,
  len(list_intersect(list_distinct([x for x in {word('query')} if length(x) >= 3 and not list_contains({arr(V.OVERLAP_STOPWORDS)}, x)]), [x for x in {word('text')} if length(x) >= 3 and not list_contains({arr(V.OVERLAP_STOPWORDS)}, x)])) as overlap from k""",
    "domain_detect": domain_sql(),
    "identity_facts": f"with {G} {IDENTITY}",
    "gated_bucket": f"with {G} select query_id, original_index, overlap_tier, tie_breaker, gate, bucket, clamped from clamped",
    "gate_stats": f"with {G} {GATE_STATS}",
    "gated_rank": f"with {G} select query_id, original_index, clamped as tier, decision, coalesce(zero_reason, '-') as zero_reason, doc_kind, round(intent_fit, 6) as intent_fit, round(rank_score, 6) as rank_score, round(score_raw, 6) as score, round(greatest(0.0, least(1.0, score_raw / 3.0)), 6) as score_norm, policy_rank from gated",
    "generic_rank": f"with {G}, {GENERIC} {GENERIC_OUT}",
    "final_order": f"with {G}, {FINAL} select query_id, original_index, rank, client_rank, coalesce(fine_score, -1) as fine_score, used as tie_breaker_used, case when used then coalesce(error, '-') else '-' end as error from shown",
    "decision_breakdown": f"with {G} {BREAKDOWN}",
    "reject_groups": f"with {G} select query_id, zero_reason as reason, count(*) as n, array_to_string(list_sort(list(original_index)), ',') as docs from gated where decision != 'ACCEPT' group by 1, 2",
    "plain_response": f"with {G}, {FINAL} select query_id, rank - 1 as index, round(score_raw, 6) as relevance_score, original_index as original_corpus_index from final",
    "reports": f"""with {G}, {FINAL}, o as (select *, {strip("replace(text, chr(10), ' ')")} as o from final) select query_id, rank, case when decision = 'ACCEPT' then 'accepted' else 'filtered' end as "group", original_index,
  '#' || rank || ' score=' || printf('%.2f', shown_score) || ' item=' || coalesce(d_items[1], '-') || {flag('same_item')} || ' domain=' || coalesce(doc_domain, '-') || {flag('same_domain')} || coalesce(' ' || zero_reason, '') || ' ' || case when length(o) > 80 then left(o, 77) || '...' else o end as line from o""",
    "howto_metrics": f"""with {G}, {FINAL}, rel as (select * from {values(X.RELEVANT, 'query_id, original_index')}), places as (select 'retrieved' as stage, query_id, original_index, request_index + 1 as rank from final union all select 'reranked', query_id, original_index, rank from final),
hits as (select p.stage, r.query_id, p.rank from rel r join places p using (query_id, original_index)) select stage, query_id::bigint as query_id, case when min(rank) = 1 then 1.0 else 0.0 end as acc1, round(1.0 / min(rank), 6) as mrr,
  case when min(rank) <= 3 then 1.0 else 0.0 end as recall_any, round(count(*) filter (rank <= 3) / count(*)::double, 6) as recall_all from hits group by 1, 2""",
    "corpus_gated": f"with {C} {GATED_OUT}",
    "corpus_routed": " union all ".join(
        f"(with {gated_pipeline(f'(select * from {CORPUS_ROWS} where ((query_id % {len(corpus_policies())}) + {len(corpus_policies())}) % {len(corpus_policies())} = {i}) w', p)} {GATED_OUT.replace('gmode as mode', f'gmode as mode, {s(p.name)} as policy_id')})" for i, p in enumerate(corpus_policies())
    ),
    "corpus_gate_stats": f"with {C} {GATE_STATS}",
    "corpus_identity": f"with {C} {IDENTITY}",
    "corpus_generic": f"with {C}, {GENERIC} {GENERIC_OUT}",
    "corpus_final": f"with {C}, {CORPUS_FINAL} select query_id, original_index, rank, client_rank, coalesce(fine_score, -1) as fine_score, used as tie_breaker_used, case when used then coalesce(error, '-') else '-' end as error from shown",
    "corpus_breakdown": f"with {C} {BREAKDOWN}",
    "corpus_rejects": f"with {C} select query_id, coalesce(zero_reason, 'unknown') as reason, count(*) as n from gated where decision != 'ACCEPT' group by 1, 2",
    "corpus_relevance": f"with {C}, {CORPUS_FINAL} select query_id, rank - 1 as index, round(shown_score, 6) as relevance_score, original_index as original_corpus_index from final",
    "ambiguous_fallback": fallback_sql(),
    "parse_buckets": f"select id, b::int as bucket from {values(list(enumerate(X.BUCKETS)), 'id, b')}",
    "parse_fines": f"select id, f::int as score, e::varchar as error from {values([(i, f, e) for i, (f, e) in enumerate(zip(X.FINES, X.FINE_ERRORS, strict=True))], 'id, f, e')}",
    "parse_event_scores": f"""with e as (select event_id, json_extract_string(props, '$.k')::double as k from events), x as (select event_id, k, case event_id % 3 when 0 then k when 1 then (event_id % 100) else case when k <= 1 then k * 100 else k end end as v from e)
select event_id, {PERCENT('v')} as fine, (select x.b from (select case event_id % 3 when 1 then case event_id % 100 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 1 when 7 then 2 when 10 then 3 else 0 end else case k::int when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 1 when 7 then 2 when 10 then 3 end end as b) x)::int as bucket from x""",
    "fallback_fines": f"select event_id, {PERCENT('(coalesce(case when event_id % 7 != 0 then (event_id % 21) / 20.0::double end, 0) * 0.7::double + (event_id % 11) / 10.0::double * 0.3::double) * 100')} as fine from events",
    "response_texts": f"select id, a as answer from {values([(i, a) for i, (_, a) in enumerate(X.REPLIES)], 'id, a')}",
    "flatlines": "select user_id as query_id, count(distinct round(value, 0)) as different, max(round(value, 0)) as max_score, count(distinct round(value, 0)) <= 2 as flat from events group by 1",
    "score_gap": "select source as query_id, round(avg(n_chars) filter (quality = 1) - avg(n_chars) filter (quality != 1), 6) as gap from labels join documents using (doc_id) group by 1",
    "latency_stats": "select count(value) as n, round(avg(value), 6) as avg_ms, round(min(value), 6) as min_ms, round(max(value), 6) as max_ms from events",
    "tie_summaries": "select user_id as query_id, count(*) filter (event_type != 'error') as used, count(*) filter (event_type = 'error') as parse_failed, trunc(avg(trunc(value)))::int as avg_latency_ms from events group by 1",
    "missing_docs": "select doc_id from documents except select doc_id from labels",
    "circuit_breaker": f"with c as (select event_id, count(*) filter (event_type = 'error') over (order by ts range between interval {BREAKER[0]} preceding and current row) as failures from events) select *, failures >= {BREAKER[1]} as open from c",
    "user_breaker": "with c as (select event_id, count(*) filter (event_type = 'error') over (partition by user_id order by ts range between interval 1 day preceding and current row) as failures from events) select *, failures >= 2 as open from c",
    "ttl_cache": cache_sql("user_id"),
    "type_cache": cache_sql("event_type"),
    "series_budget": "with c as (select event_id, coalesce(sum(value) over (order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as spent from events) select event_id, round(spent, 3) as spent, spent > 5000 as skipped from c",
    "one_query_rank": "select 0 as query_id, doc_id as original_index, row_number() over (order by length(coalesce(text, '')) desc, (doc_id % 97) / 97.0::double desc, doc_id) as rank from documents",
    "latency_budget": "with c as (select event_id, coalesce(sum(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as spent from events) select event_id, round(spent, 4) as spent, spent > 500 as skipped from c",
}
