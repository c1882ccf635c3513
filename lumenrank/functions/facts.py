"""Domains, items and identity facts of query and document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.policies import Policy
from ..sources.policy_table import PolicyColumns
from . import vocab as V
from .dictionary import found
from .text import any_of, contains_any, let, matches_any, text, tokens_lower, tokens_word, words


def terms_of(rules: list[tuple[str, list[str]]]) -> list[str]:
    return sorted({t.lower() for _, terms in rules for t in terms})


def rule_hits(col: Column, rules: list[tuple[str, list[str]]] = V.DOMAIN_RULES, have: Column | None = None) -> list[tuple[str, Column]]:
    """Per rule, how many of its words occur (as whole words; a term of several words as a whole phrase). ``have``:
    ``dictionary.found`` of the text and all the rules' terms, where that is a column already."""
    have = found(col, terms_of(rules)) if have is None else have
    return [(name, F.size(F.array_intersect(have, words(sorted({t.lower() for t in terms}))))) for name, terms in rules]


def domain_hits(col: Column, rules: list[tuple[str, list[str]]] = V.DOMAIN_RULES, have: Column | None = None) -> Column:
    """map<domain, hits> of the domains with hits, rules of one name added up."""

    def table(hits: Column) -> Column:
        total: dict[str, Column] = {}
        for name, n in rule_hits(col, rules, hits):
            total[name] = total[name] + n if name in total else n
        return F.map_filter(F.create_map(*[x for name, n in total.items() for x in (F.lit(name), n)]), lambda _, n: n > 0)

    return let(found(col, terms_of(rules)) if have is None else have, table)


def domain_soft_match(col: Column, policy: Policy) -> Column:
    """Whether any of the policy's domain keywords occurs as a whole word; true for a policy without any."""
    return matches_any(col, policy.domain_keywords) if policy.domain_keywords else F.lit(True)


def _first_best(hits: list[tuple[str, Column]]) -> Column:
    """The name of the most hits, the earlier on ties; null without hits."""
    top = F.greatest(*[n for _, n in hits]) if len(hits) > 1 else hits[0][1]
    out = F.lit(None).cast("string")
    for name, n in reversed(hits):
        out = F.when(n == top, name).otherwise(out)
    return F.when(top > 0, out)


def choose_domain(hits: Column, rules: list[tuple[str, list[str]]] = V.DOMAIN_RULES) -> Column:
    """Of a ``domain_hits`` map the domain with most hits, the earlier rule on ties."""
    names = list(dict.fromkeys(name for name, _ in rules))
    return _first_best([(n, F.coalesce(F.try_element_at(hits, F.lit(n)), F.lit(0))) for n in names])


def infer_domain(col: Column, rules: list[tuple[str, list[str]]] = V.DOMAIN_RULES, negative: dict[str, list[str]] | None = None, have: Column | None = None) -> Column:
    """The domain of the single rule with most hits (rules of one name aren't added up); rules whose
    ``negative`` words occur are out."""
    names = [name for name, _ in rules]

    def counts(hits: Column) -> Column:
        return F.array(*[F.when(matches_any(col, (negative or {}).get(name, [])), 0).otherwise(n) for name, n in rule_hits(col, rules, hits)])

    # the hits as one array: every mention of them below is a look-up
    return let(let(found(col, terms_of(rules)) if have is None else have, counts), lambda a: _first_best([(name, a[i]) for i, name in enumerate(names)]))


def generic_domain(col: Column, domains: list[tuple[str, list[str]]] = V.GENERIC_DOMAINS, tokens: Column | None = None) -> Column:
    """By token sets: the domain with most distinct tokens, ``ambiguous`` on a tie, ``unknown`` without any. ``tokens``: the
    lower-case word tokens, or those of them that any domain has, where that is a column already."""
    known = sorted({t for _, terms in domains for t in terms})
    tokens = F.filter(tokens_lower(F.lower(text(col))) if tokens is None else tokens, lambda t: t.isin(known))

    def named(a: Column) -> Column:
        top = F.array_max(a)
        first = F.element_at(words([name for name, _ in domains]), F.array_position(a, top).cast("int"))
        return F.when(top == 0, "unknown").when(F.size(F.filter(a, lambda n: n == top)) > 1, "ambiguous").otherwise(first)

    return let(tokens, lambda t: let(F.array(*[F.size(F.array_intersect(t, words(terms))) for _, terms in domains]), named))


def client_domain(col: Column, domains: list[tuple[str, list[str]]] = V.CLIENT_DOMAINS) -> Column:
    """By substrings, the first domain that has one; ``unknown`` without."""
    low, out = F.lower(text(col)), F.lit("unknown")
    for name, terms in reversed(domains):
        out = F.when(contains_any(low, terms), name).otherwise(out)
    return out


def item_terms(policy: Policy | PolicyColumns) -> list[str]:
    return list(policy.terms) if isinstance(policy, PolicyColumns) else [n for names in policy.item_aliases.values() for n in names]


def items(col: Column, policy: Policy | PolicyColumns, have: Column | None = None) -> Column:
    """The policy's items that the text names, in the policy's order. ``have``: ``dictionary.found`` of the text and at
    least the ``item_terms``, where that is a column already."""
    if have is None:
        return let(found(col, item_terms(policy)), lambda x: items(col, policy, x))
    if isinstance(policy, PolicyColumns):
        return F.transform(F.filter(policy.items, lambda x: F.arrays_overlap(have, x["names"])), lambda x: x["item"])
    aliases = {item: sorted({n.lower() for n in names}) for item, names in policy.item_aliases.items()}
    if not aliases:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(any_of(have, names), item) for item, names in aliases.items()]))


def single_item(hits: Column) -> Column:
    """The item, if there is exactly one."""
    return F.when(F.size(hits) == 1, F.element_at(hits, 1))


def identity(query: Column, doc: Column, policy: Policy | PolicyColumns, said: Column | None = None) -> Column:
    """struct of query_item, doc_items, same_item (null: the document names no item), domain_match (the same
    as same_domain), domain_match_doc, domain_match_query, query_domain, doc_domain, their hits, same_domain. ``said``: ``dictionary.whole_words`` of the document, where that is
    a column already."""
    terms = [*item_terms(policy), *terms_of(V.DOMAIN_RULES)]
    of = lambda c, i, h, words_=None: let(found(c, terms, words_), lambda have: F.struct(items(c, policy, have).alias(i), domain_hits(c, have=have).alias(h)))
    both = F.struct(of(query, "qi", "qh").alias("q"), of(doc, "di", "dh", said).alias("d"))
    raw = let(both, lambda r: F.struct(r["q"]["qi"].alias("qi"), r["d"]["di"].alias("di"), r["q"]["qh"].alias("qh"), r["d"]["dh"].alias("dh")))
    named = lambda r: F.struct(r["qi"].alias("qi"), r["di"].alias("di"), r["qh"].alias("qh"), r["dh"].alias("dh"), single_item(r["qi"]).alias("q"), choose_domain(r["qh"]).alias("qd"), choose_domain(r["dh"]).alias("dd"))

    def facts(r: Column) -> Column:
        same_item = F.when(F.size(r["di"]) > 0, F.coalesce(F.array_contains(r["di"], r["q"]), F.lit(False)))
        same_domain = F.coalesce(r["qd"] == r["dd"], F.lit(False))
        return F.struct(
            r["q"].alias("query_item"), r["di"].alias("doc_items"), same_item.alias("same_item"), same_domain.alias("domain_match"), (F.size(r["dh"]) > 0).alias("domain_match_doc"),
            (F.size(r["qh"]) > 0).alias("domain_match_query"), r["qd"].alias("query_domain"), r["dd"].alias("doc_domain"), r["qh"].alias("query_domain_hits"), r["dh"].alias("doc_domain_hits"),
            same_domain.alias("same_domain"),
        )

    return let(let(raw, named), facts)


def ambiguous_client(query: Column) -> tuple[Column, Column]:
    """(ambiguous, reason): no token, or one distinct token (``trigger`` words or ``too_short``)."""
    t = F.array_distinct(F.regexp_extract_all(F.lower(text(query)), F.lit("[a-zA-Z]+"), F.lit(0)))
    yes = F.size(t) <= 1
    return yes, F.when(F.size(t) == 0, "empty").when(yes & any_of(t, V.CLIENT_TRIGGERS), "trigger").when(yes, "too_short")


def ambiguous_gated(query: Column, policy: Policy | PolicyColumns) -> Column:
    """Only with triggers: at most one distinct token, or a trigger among them."""
    given = policy.ambiguous_triggers
    if not isinstance(given, Column) and not given:
        return F.lit(False)
    t = F.array_distinct(tokens_word(query))
    return (F.size(words(given)) > 0) & ((F.size(t) <= 1) | any_of(t, given))


def ambiguous_generic(query: Column) -> Column:
    """At most one distinct token, or no single domain."""
    return (F.size(F.array_distinct(tokens_word(query))) <= 1) | generic_domain(query).isin("unknown", "ambiguous")
