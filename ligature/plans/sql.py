"""Building blocks of the SQL that says the same as the queries."""

from __future__ import annotations

from ligature.functions.text import ADDRESS_WORDS, LEGAL_CANONICAL, LEGAL_PHRASES, LEGAL_WORDS, TRADE_NAME

NAMES = ", ".join(f"'{w}'" for w in LEGAL_WORDS)


def clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}\p{{M}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def words(x: str, table: dict[str, str]) -> str:
    cases = " ".join(f"when '{a}' then '{b}'" for a, b in table.items())
    return f"array_to_string(list_filter(list_transform({toks(x)}, lambda w: case w {cases} else w end), lambda w: w <> ''), ' ')"


def phrases(x: str, table: dict[str, str]) -> str:
    out = f"' ' || {x} || ' '"
    for a, b in table.items():
        for _ in range(2):
            out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim({out})"


LEGAL_CANONICAL_SQL = phrases(words("{x}", LEGAL_CANONICAL), LEGAL_PHRASES)
LEGAL_REMOVE_SQL = words("{x}", dict.fromkeys(LEGAL_WORDS, ""))
ADDRESS_SQL = words("{x}", ADDRESS_WORDS)
ZEROS_SQL = r"regexp_replace({x}, '\b0+([0-9])', '\1', 'g')"
TRADE_SQL = "regexp_replace({x}, '" + TRADE_NAME + "', '')"
INVISIBLE_SQL = "regexp_replace({x}, '[​-‍﻿­]', '', 'g')"
WEB_SQL = r"regexp_replace(regexp_replace({x}, '\bwww\.', '', 'g'), '\.(?:com|net|org|co\.in|in|co|fr)\b', ' ', 'g')"

RECORDS = """
s1 as (select entity_id, coalesce(min(business_name), '') as business_name, coalesce(min(business_address), '') as business_address, coalesce(min(country), '') as country from train_source1 group by entity_id),
pool as (select entity_id, coalesce(min(business_name), '') as business_name, coalesce(min(business_address), '') as business_address, coalesce(min(country), '') as country
  from (select * from train_source2 union all select * from train_source3) group by entity_id),
m as (select source1_entity_id, max(coalesce(matched_entity_ids, '')) as matched_entity_ids from train_matches group by source1_entity_id),
truth as (select distinct source1_entity_id as s1_id, unnest(list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '')) as cand_id from m)"""
NORMAL = f"""{RECORDS},
s1n as (select entity_id, country, {clean("lower(business_name)")} as name, {clean("lower(business_address)")} as addr from s1),
pooln as (select entity_id, country, {clean("lower(business_name)")} as name, {clean("lower(business_address)")} as addr from pool)"""


def keys(name: str, source: str) -> str:
    """CTEs with all five key types of a table, and one that unites them under ``name``."""
    core = f"list_filter(n, lambda w: w not in ({NAMES}))"
    big = "list_transform(range(1, greatest(len({w}), 1)), lambda i: {w}[i] || '_' || {w}[i + 1])"
    return f"""{name}_t as (select entity_id, country, {toks('name')} as n, {toks('addr')} as a from {source}),
{name} as (select distinct entity_id, key, is_name from (
  select entity_id, country || '|nw|' || unnest(n) as key, 1 as is_name from {name}_t union all select entity_id, country || '|aw|' || unnest(a), 0 from {name}_t
  union all select entity_id, country || '|nb|' || unnest({big.format(w='n')}), 1 from {name}_t union all select entity_id, country || '|ab|' || unnest({big.format(w='a')}), 0 from {name}_t
  union all select entity_id, country || '|nj|' || array_to_string({core}, ''), 1 from {name}_t where length(array_to_string({core}, '')) >= 4))"""


KEYED = f"{NORMAL}, {keys('k1', 's1n')}, {keys('kp', 'pooln')}"


def scores(max_df: int, q: str = "k1", p: str = "kp", n: str = "pool", name: str = "scores") -> str:
    return f"""{name}_df as (select key, ln((select count(*) from {n})::double / count(*)) as idf from {p} where key in (select key from {q}) group by key having count(*) <= {max_df}),
{name} as (select *, round(score_all - score_name, 9) as score_addr from (select q.entity_id as s1_id, p.entity_id as cand_id, round(sum(idf), 9) as score_all, round(sum(case when q.is_name = 1 then idf else 0 end), 9) as score_name, count(*) as shared
  from {q} q join {p} p using (key) join {name}_df using (key) group by 1, 2))"""


def ranked(k: int, source: str = "scores", name: str = "cand") -> str:
    return f"{name} as (select * from (select *, row_number() over (partition by s1_id order by score_all desc, cand_id) as block_rank from {source}) where block_rank <= {k})"
