"""DuckDB expressions that mirror the native columns."""

from __future__ import annotations

from .. import constants as K
from ..functions.text import RUN, WORD

Q = "'"


def lit(s: str) -> str:
    return Q + s.replace(Q, Q + Q) + Q


def word_list(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def tokens(x: str) -> str:
    low = f"lower({x})"
    runs = f"regexp_extract_all({low}, '{RUN}')"
    pieces = ", ".join(f"flatten(list_transform({runs}, lambda w: string_split(w, '{s}')))" for s in "-_")
    kept = f"list_filter({word_list(K.PRESERVED_TERMS)}, lambda t: contains({low}, t))"
    return f"list_distinct(list_filter(list_concat({kept}, {runs}, {pieces}), lambda t: length(t) > 1))"


def words(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '{WORD}'))"


def overlap(q: str, c: str) -> str:
    a, b = words(q), words(c)
    both = f"len(list_intersect({a}, {b}))"
    return f"(case when len({a}) = 0 then 0.0 else {both}::double / (len({a}) + len({b}) - {both}) end)"


def quality(c: str) -> str:
    ws = rf"list_filter(regexp_split_to_array({c}, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"
    chars = f"len(list_distinct(string_split(lower({c}), '')))"
    short = f"(case when length({c}) < 50 then length({c}) / 50.0::double else 1.0 end)"
    variety = f"least({chars}::double / least(length({c}), 100) * 2, 1.0)"
    diverse = f"(case when len({ws}) > 5 then 0.7::double + 0.3::double * (len(list_distinct({ws}))::double / len({ws})) else 1.0 end)"
    return f"(case when length({c}) = 0 then 0.0 else greatest({short} * {variety} * {diverse}, 0.1::double) end)"


def any_of(low: str, items) -> str:
    return "(" + " or ".join(f"contains({low}, {lit(w)})" for w in items) + ")"


def classify(x: str) -> str:
    whens = " ".join(f"when {any_of(f'lower({x})', items)} then {lit(name)}" for name, items in K.QUERY_CLASSES)
    return f"case {whens} else {lit(K.DEFAULT_CLASS)} end"


def cosine(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1]::double * p[2]::double))"
    return f"{dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"


#: Common table expressions of BM25: query(query_id, query) must come before them.
def bm25(docs: str = "documents") -> str:
    return f"""
 dt as (select doc_id as key, {tokens("text")} as ts from {docs}),
 post as (select key, len(ts) as dl, unnest(ts) as token from dt),
 corp as (select count(*) as n, avg(len(ts)) as avgdl from dt),
 term as (select token, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) as idf from post, corp group by token, n),
 qt as (select query_id, unnest({tokens("query")}) as token from query),
 scored as (select query_id, key, sum(idf * 2.5::double / (1 + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))) as score
   from qt join term using (token) join post using (token), corp group by query_id, key),
 ranked as (select *, row_number() over (partition by query_id order by round(score, 9) desc, key) as rank from scored)"""
