"""All queries of the engine by name, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ligature.functions import text as T
from ligature.functions.similarity import jaccard, mean_known
from ligature.operators import blocking, decision, evaluation, features, keys, learn, profile, reverse, stage2
from ligature.plans import sql as Q
from ligature.sources import sinks, tables
from ligature.workspace import ship

MAX_DF, TOP_K = 50, 10
#: The reference's chosen design of five-key blocking, and the grid it was chosen from.
WIDE_DF, WIDE_K = 1000, 100
WIDE_DFS, WIDE_KS = [100, 300, 1000], [25, 50, 100, 200]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ tables


def _s1(s, d):
    return tables.reference_records(s, d)


def _pool(s, d):
    return tables.pool_records(s, d)


def _norm(df: DataFrame) -> DataFrame:
    return df.select("entity_id", "country", T.normalize(F.col("business_name")).alias("name"), T.normalize(F.col("business_address")).alias("addr"))


def _truth(s, d):
    return tables.explode_matches(tables.known_matches(s, d)).select(F.col("source1_entity_id").alias("s1_id"), F.col("match_id").alias("cand_id"))


def _candidates(s, d, top_k=TOP_K, ranking="all", max_df=MAX_DF):
    pool = _norm(_pool(s, d))
    return blocking.candidates(keys.record_keys(_norm(_s1(s, d))), keys.record_keys(pool), pool.count(), max_df, top_k, ranking)


def _scored(s, d):
    """Candidates with a probability that stands in for a model's."""
    return _candidates(s, d).withColumn("probability", F.round(F.col("score_all") / (F.col("score_all") + 20), 6)).select("s1_id", "cand_id", "score_all", "block_rank", "probability")


CAND = f"{Q.KEYED}, {Q.scores(MAX_DF)}, {Q.ranked(TOP_K)}"
SCORED = f"{CAND}, scored as (select s1_id, cand_id, score_all, block_rank, round(score_all / (score_all + 20), 6) as probability from cand)"
PAIRS = f"{CAND}, pairs as (select c.*, s.name as name_s, s.addr as addr_s, p.name as name_c, p.addr as addr_c from cand c join s1n s on s.entity_id = c.s1_id join pooln p on p.entity_id = c.cand_id)"
LISTED = ", listed as (select s1_id, list(distinct cand_id) as ids from {0} group by s1_id)"
F05 = "case when n_true = 0 and n_pred = 0 then 1.0 when n_correct = 0 then 0.0 else 1.25 * (n_correct / n_pred) * (n_correct / n_true) / (0.25 * (n_correct / n_pred) + n_correct / n_true) end"


def _entity_sql(pairs: str) -> str:
    return f""", per as (select m.source1_entity_id, count(distinct t.cand_id) as n_true from m left join truth t on t.s1_id = m.source1_entity_id group by 1),
      hits as (select s1_id, count(*) as n_pred, sum(case when t.cand_id is not null then 1 else 0 end) as n_correct from {pairs} p left join truth t using (s1_id, cand_id) group by s1_id),
      ent as (select source1_entity_id, n_true::int as n_true, coalesce(n_pred, 0)::int as n_pred, coalesce(n_correct, 0)::int as n_correct from per left join hits on s1_id = source1_entity_id),
      sc as (select *, {F05} as f05 from ent)"""


# ------------------------------------------------------------------ sources and sinks


@query(f"with {Q.RECORDS} select entity_id, business_name, business_address, country from s1")
def src_reference(s, d):
    return _s1(s, d)


@query(f"with {Q.RECORDS} select entity_id, business_name, country from pool where country = 'India'")
def src_pool_country(s, d):
    return tables.pool_records(s, d, where=F.col("country") == "India").select("entity_id", "business_name", "country")


@query(f"with {Q.RECORDS} select source1_entity_id, matched_entity_ids from m")
def src_matches(s, d):
    return tables.known_matches(s, d)


@query(f"with {Q.RECORDS} select s1_id as source1_entity_id, cand_id as match_id, substr(cand_id, 1, 2) as match_source from truth")
def src_matches_long(s, d):
    return tables.explode_matches(tables.known_matches(s, d))


@query("select count(*) as n_rows from candidate_pairs")
def src_row_count(s, d):
    return tables.table(s, d, "candidate_pairs").agg(F.count("*").alias("n_rows"))


@query(f"with {Q.RECORDS} select sum(length(business_address) - length(replace(business_address, ',', ''))) as commas, sum(length(business_name) - length(replace(business_name, ' ', ''))) as blanks from pool")
def src_raw_counts(s, d):
    n = lambda c, x: F.sum(F.length(c) - F.length(F.replace(F.col(c), F.lit(x), F.lit(""))))
    return _pool(s, d).agg(n("business_address", ",").alias("commas"), n("business_name", " ").alias("blanks"))


@query("select * from (values ('S1-1', 'S2-5,S3-9'), ('S1-2', '')) t(source1_entity_id, matched_entity_ids)")
def src_literal(s, d):
    return s.createDataFrame([("S1-1", "S2-5,S3-9"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")


@query(f"with {SCORED} {LISTED.format('scored')} select s.entity_id as source1_entity_id, coalesce(array_to_string(list_sort(ids), ','), '') as matched_entity_ids from s1 s left join listed on s1_id = s.entity_id")
def sink_assemble(s, d):
    return sinks.assemble(_s1(s, d), decision.to_lists(_scored(s, d)))


@query(f"""with {SCORED} {LISTED.format('scored')}, o as (select s.entity_id as id, coalesce(ids, []) as ids from s1 s left join listed on s1_id = s.entity_id), x as (select unnest(ids) as c from o)
    select (select count(*) from o) as n_rows, (select count(*) from o where len(ids) = 0) as empty_lists, (select count(*) from o where contains(array_to_string(ids, ','), chr(13))) as carriage_returns, (select count(*) from (select c from x group by c having count(*) > 1)) as double_owned,
    (select count(distinct c) from x) as distinct_ids, (select count(*) from s1 where entity_id not in (select id from o)) as missing, (select count(*) from o where id not in (select entity_id from s1)) as unknown""")
def sink_validate(s, d):
    from ligature.workspace import materialize

    out = materialize(sinks.assemble(_s1(s, d), decision.to_lists(_scored(s, d))), "output")
    return sinks.validate(out, _s1(s, d))


# ------------------------------------------------------------------ normalisation


def _norm_query(name: str, column: str, step, sql: str, word_step: bool) -> None:
    def f(s, d):
        raw = F.lower(column)
        out = step(T.clean(raw)) if word_step else T.clean(step(raw))
        return _pool(s, d).select("entity_id", out.alias("text"))

    f.__name__ = name
    inner = f"lower({column})"
    made = sql.format(x=Q.clean(inner)) if word_step else Q.clean(sql.format(x=inner))
    query(f"with {Q.RECORDS} select entity_id, {made} as text from pool")(f)


for _name, _column, _step, _sql, _word in (
    ("norm_clean", "business_name", lambda c: c, "{x}", True),
    ("norm_trade_name", "business_name", T.keep_real_name, Q.TRADE_SQL, False),
    ("norm_invisible", "business_name", T.remove_invisible, Q.INVISIBLE_SQL, False),
    ("norm_ampersand", "business_name", T.ampersand_to_and, "replace({x}, '&', ' and ')", False),
    ("norm_web", "business_name", T.drop_web, Q.WEB_SQL, False),
    ("norm_dots", "business_name", T.join_dotted, "replace({x}, '.', '')", False),
    ("norm_legal_canonical", "business_name", T.canonical_legal, Q.LEGAL_CANONICAL_SQL, True),
    ("norm_legal_remove", "business_name", T.remove_legal, Q.LEGAL_REMOVE_SQL, True),
    ("norm_address_abbrev", "business_address", T.expand_address, Q.ADDRESS_SQL, True),
    ("norm_placeholders", "business_address", T.drop_placeholders, Q.words("{x}", T.PLACEHOLDERS), True),
    ("norm_zeros", "business_address", T.strip_leading_zeros, Q.ZEROS_SQL, True),
):
    _norm_query(_name, _column, _step, _sql, _word)


@query()
def norm_accents(s, d):
    return _pool(s, d).select("entity_id", T.normalize(F.col("business_name"), ["accents"]).alias("text"))


@query()
def norm_translit(s, d):
    return _pool(s, d).select("entity_id", T.normalize(F.col("business_name"), ["translit"]).alias("text"))


@query()
def norm_full(s, d):
    """The chosen steps for names and addresses, with the flag of names in Indic scripts."""
    foreign = F.col("business_name").rlike(T.INDIC).cast("int").alias("name_foreign")
    name, addr = T.normalize(F.col("business_name"), ("translit", *T.NAME_STEPS)), T.normalize(F.col("business_address"), ("translit", *T.ADDRESS_STEPS))
    return _pool(s, d).select("entity_id", "country", name.alias("name_norm"), addr.alias("addr_norm"), foreign)


@query("select substr(md5('trade_name+invisible+accents+web|invisible+accents+address_abbrev+null+zeros'), 1, 8) as tag")
def norm_tag(s, d):
    return s.createDataFrame([(T.normalization_tag(T.NAME_STEPS, T.ADDRESS_STEPS),)], "tag string")


# ------------------------------------------------------------------ keys and candidates


def _key_query(kind: str) -> None:
    def f(s, d):
        return keys.record_keys(_norm(_s1(s, d)), [kind]).groupBy("key").agg(F.count("*").alias("df"))

    f.__name__ = f"key_{kind}"
    query(f"with {Q.NORMAL}, {Q.keys('k1', 's1n')} select key, count(*) as df from k1 where key like '%|{kind}|%' group by key")(f)


for _kind in keys.KEY_TYPES:
    _key_query(_kind)


@query(f"with {Q.KEYED}, {Q.scores(MAX_DF)} select key, round(idf, 9) as idf, count(*) as postings from kp join scores_df using (key) group by key, idf")
def block_index(s, d):
    pool = _norm(_pool(s, d))
    index = blocking.build_index(keys.record_keys(_norm(_s1(s, d))), keys.record_keys(pool), pool.count(), MAX_DF)
    return index.groupBy("key").agg(F.round(F.first("idf"), 9).alias("idf"), F.count("*").alias("postings"))


@query(f"with {CAND} select s1_id, cand_id, round(score_all, 6) as score_all, round(score_name, 6) as score_name, round(score_addr, 6) as score_addr, block_rank from cand")
def block_candidates_all(s, d):
    c = _candidates(s, d)
    return c.select("s1_id", "cand_id", *[F.round(x, 6).alias(x) for x in ("score_all", "score_name", "score_addr")], "block_rank")


@query(f"with {Q.KEYED}, {Q.scores(WIDE_DF)}, {Q.ranked(WIDE_K)} select s1_id, cand_id, round(score_all, 6) as score_all, block_rank from cand")
def block_candidates_wide(s, d):
    """Candidates at the reference's chosen design; keys and ranking as in block_candidates_all."""
    return _candidates(s, d, WIDE_K, max_df=WIDE_DF).select("s1_id", "cand_id", F.round("score_all", 6).alias("score_all"), "block_rank")


@query(f"""with {Q.KEYED}, {Q.scores(MAX_DF)} select s1_id, cand_id, round(score_all, 6) as score_all from (select *, row_number() over (partition by s1_id order by score_name desc, cand_id) as a,
    row_number() over (partition by s1_id order by score_addr desc, cand_id) as b from scores) where a <= {TOP_K // 2} or b <= {TOP_K // 2}""")
def block_candidates_split(s, d):
    return _candidates(s, d, ranking="split").select("s1_id", "cand_id", F.round("score_all", 6).alias("score_all"))


@query(f"with {CAND} select s1_id, cand_id, block_rank from cand")
def block_hashed(s, d):
    """The same candidates from keys hashed to 64 bits."""
    pool = _norm(_pool(s, d))
    c = blocking.candidates(keys.record_keys(_norm(_s1(s, d)), hashed=True), keys.record_keys(pool, hashed=True), pool.count(), MAX_DF, TOP_K)
    return c.select("s1_id", "cand_id", "block_rank")


WORD_KEYS = f"""{Q.NORMAL}, w1 as (select distinct entity_id, country || '|' || unnest(list_concat({Q.toks('name')}, {Q.toks('addr')})) as key, 1 as is_name from s1n),
  wp as (select distinct entity_id, country || '|' || unnest(list_concat({Q.toks('name')}, {Q.toks('addr')})) as key, 1 as is_name from pooln), {Q.scores(20, 'w1', 'wp')}, {Q.ranked(TOP_K)}"""


def _rule_candidates(s, d):
    pool = _norm(_pool(s, d))
    return blocking.candidates(keys.word_keys(_norm(_s1(s, d))), keys.word_keys(pool), pool.count(), 20, TOP_K)


@query(f"with {WORD_KEYS} select s1_id, cand_id, round(score_all, 6) as score_all, shared from cand")
def block_rule(s, d):
    return _rule_candidates(s, d).select("s1_id", "cand_id", F.round("score_all", 6).alias("score_all"), "shared")


@query(f"""with {Q.KEYED}, f as (select key, count(*) as df from kp group by key)
    select s1_id, cand_id, string_split(key, '|')[2] as key_type, min(df) as min_df from truth t join k1 on k1.entity_id = s1_id join kp on kp.entity_id = cand_id and kp.key = k1.key join f using (key) group by 1, 2, 3""".replace("join f using (key)", "join f on f.key = k1.key").replace("string_split(key", "string_split(k1.key"))
def block_reach(s, d):
    return blocking.key_reach(_truth(s, d), keys.record_keys(_norm(_s1(s, d))), keys.record_keys(_norm(_pool(s, d))))


def _sweep_sql(max_dfs: list[int], top_ks: list[int]) -> str:
    parts = ", ".join(f"{Q.scores(m, name=f'sc{m}')}" for m in max_dfs)
    both = " union all ".join(f"select {m} as max_df, s1_id, cand_id, score_all from sc{m}" for m in max_dfs)
    return f"""with {Q.KEYED}, {parts}, u as ({both}), r as (select *, row_number() over (partition by max_df, s1_id order by score_all desc, cand_id) as place from u),
      x as (select r.*, k.top_k from r join (values {', '.join(f'({k})' for k in top_ks)}) k(top_k) on place <= top_k)
      select max_df, top_k, count(*) as pairs, count(distinct s1_id) as entities, sum(case when t.cand_id is not null then 1 else 0 end)::bigint as found from x left join truth t using (s1_id, cand_id) group by 1, 2"""


def _sweep(s, d, max_dfs: list[int], top_ks: list[int]) -> DataFrame:
    pool = _norm(_pool(s, d))
    a, b, n = keys.record_keys(_norm(_s1(s, d))), keys.record_keys(pool), pool.count()
    return blocking.sweep_in_slices(a, b, n, _truth(s, d), max_dfs, top_ks)


@query(_sweep_sql([20, 50], [5, 10]))
def block_sweep(s, d):
    return _sweep(s, d, [20, 50], [5, 10])


@query(_sweep_sql(WIDE_DFS, WIDE_KS))
def block_sweep_wide(s, d):
    """The reference's grid of designs."""
    return _sweep(s, d, WIDE_DFS, WIDE_KS)


@query(f"""with {CAND}, b as (select sum(a * b) as brute from (select country, count(*) as a from s1 group by country) join (select country, count(*) as b from pool group by country) using (country))
    select count(*) as pairs, any_value(brute)::bigint as brute_force, round(1 - count(*) / any_value(brute), 9) as reduction from cand, b""")
def block_reduction(s, d):
    return blocking.reduction(_s1(s, d), _pool(s, d), _candidates(s, d))


# ------------------------------------------------------------------ reverse index

REV = f"{Q.KEYED}, {Q.scores(MAX_DF, 'kp', 'k1', 's1', 'rs')}, {Q.ranked(10, 'rs', 'rev0')}, rev as (select s1_id as record_id, cand_id as s1_id, score_all as r_score, block_rank as r_rank from rev0)"


def _reverse(s, d):
    s1 = _norm(_s1(s, d))
    return reverse.reverse_table(keys.record_keys(s1), keys.record_keys(_norm(_pool(s, d))), s1.count(), MAX_DF, 10)


@query(f"with {REV} select record_id, s1_id, round(r_score, 6) as r_score, r_rank from rev")
def rev_table(s, d):
    return _reverse(s, d).withColumn("r_score", F.round("r_score", 6))


REV_FEATURES = f"""{REV}, {Q.scores(MAX_DF)}, {Q.ranked(TOP_K)}, tops as (select record_id, max(case when r_rank = 1 then r_score end) as best, max(case when r_rank = 2 then r_score end) as second from rev group by record_id),
  rf as (select c.s1_id, c.cand_id, coalesce(r.r_rank, 11) as r_rank, coalesce(r.r_score, 0) as r_score, coalesce(case when r.r_rank = 1 then second else best end, 0) as r_best_other
    from cand c left join rev r on r.record_id = c.cand_id and r.s1_id = c.s1_id left join tops t on t.record_id = c.cand_id)"""


@query(f"with {REV_FEATURES} select s1_id, cand_id, r_rank, round(r_score, 6) as r_score, round(r_best_other, 6) as r_best_other, round(round(r_score - r_best_other, 9), 6) as r_gap from rf")
def rev_features(s, d):
    f = reverse.reverse_features(_candidates(s, d).select("s1_id", "cand_id"), _reverse(s, d))
    return f.select("s1_id", "cand_id", F.col("r_rank").cast("int").alias("r_rank"), *[F.round(x, 6).alias(x) for x in ("r_score", "r_best_other", "r_gap")])


@query(f"""with {REV} select count(*) as true_pairs, sum(case when r_rank <= 1 then 1 else 0 end)::bigint as at_1, sum(case when r_rank <= 3 then 1 else 0 end)::bigint as at_3, sum(case when r_rank <= 10 then 1 else 0 end)::bigint as at_10
    from truth t left join rev r on r.record_id = t.cand_id and r.s1_id = t.s1_id""")
def rev_diagnostics(s, d):
    t = _truth(s, d).join(_reverse(s, d).withColumnRenamed("record_id", "cand_id"), ["s1_id", "cand_id"], "left")
    at = lambda k: F.sum(F.when(F.col("r_rank") <= k, 1).otherwise(0)).alias(f"at_{k}")
    return t.agg(F.count("*").alias("true_pairs"), at(1), at(3), at(10))


# ------------------------------------------------------------------ pair features


def _pairs(s, d):
    return features.with_texts(_candidates(s, d), _norm(_s1(s, d)), _norm(_pool(s, d)))


_N = {"ns": Q.toks("name_s"), "nc": Q.toks("name_c"), "as_": Q.toks("addr_s"), "ac": Q.toks("addr_c")}
_CANON = " ".join(f"when '{a}' then '{b}'" for a, b in T.LEGAL_CANONICAL.items())
FEAT = f"""{PAIRS}, f0 as (select *, {', '.join(f'{v} as {k}' for k, v in _N.items())}, list_distinct(regexp_extract_all(addr_s, '([0-9]+)')) as ds, list_distinct(regexp_extract_all(addr_c, '([0-9]+)')) as dc from pairs),
  f1 as (select *, list_filter(ns, lambda w: w not in ({Q.NAMES})) as ks, list_filter(nc, lambda w: w not in ({Q.NAMES})) as kc,
    list_distinct(list_filter(list_transform(ns, lambda w: case w {_CANON} else w end), lambda w: w in ({Q.NAMES}))) as ls, list_distinct(list_filter(list_transform(nc, lambda w: case w {_CANON} else w end), lambda w: w in ({Q.NAMES}))) as lc from f0)"""


def _inter(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def _size(a: str) -> str:
    return f"len(list_distinct({a}))"


def _jac(a: str, b: str) -> str:
    return f"case when {_size(a)} > 0 and {_size(b)} > 0 then {_inter(a, b)} / ({_size(a)} + {_size(b)} - {_inter(a, b)}) end"


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) as {name}"


@query(f"""with {FEAT} select s1_id, cand_id, (name_s = name_c)::int as name_exact, (array_to_string(ks, ' ') = array_to_string(kc, ' '))::int as core_exact from f1""")
def feat_exact(s, d):
    return features.set_features(_pairs(s, d)).select("s1_id", "cand_id", "name_exact", "core_exact")


@query(f"with {FEAT} select s1_id, cand_id, {_r(_jac('ns', 'nc'), 'name_jaccard')}, {_r(_jac('as_', 'ac'), 'addr_jaccard')}, {_r(_jac('ks', 'kc'), 'core_jaccard')} from f1")
def feat_jaccard(s, d):
    return features.set_features(_pairs(s, d)).select("s1_id", "cand_id", *[F.round(c, 6).alias(c) for c in ("name_jaccard", "addr_jaccard", "core_jaccard")])


def _both(a: str, b: str, x: str) -> str:
    return f"case when {_size(a)} > 0 and {_size(b)} > 0 then {x} end"


_DICE = {n: _both(a, b, f"2 * {_inter(a, b)} / ({_size(a)} + {_size(b)})") for n, a, b in (("name_dice", "ns", "nc"), ("addr_dice", "as_", "ac"))}
_OVER = {n: _both(a, b, f"{_inter(a, b)} / least({_size(a)}, {_size(b)})") for n, a, b in (("name_overlap", "ns", "nc"), ("addr_overlap", "as_", "ac"))}


@query(f"with {FEAT} select s1_id, cand_id, {', '.join(_r(v, k) for k, v in _DICE.items())} from f1")
def feat_dice(s, d):
    return features.set_features(_pairs(s, d)).select("s1_id", "cand_id", *[F.round(c, 6).alias(c) for c in _DICE])


@query(f"with {FEAT} select s1_id, cand_id, {', '.join(_r(v, k) for k, v in _OVER.items())} from f1")
def feat_overlap(s, d):
    return features.set_features(_pairs(s, d)).select("s1_id", "cand_id", *[F.round(c, 6).alias(c) for c in _OVER])


@query(f"""with {FEAT} select s1_id, cand_id, (len(ls) > 0 and len(lc) > 0 and {_inter('ls', 'lc')} = len(ls) and len(ls) = len(lc))::int as legal_same,
    (len(ls) > 0 and len(lc) > 0 and {_inter('ls', 'lc')} = 0)::int as legal_conflict, ((len(ls) > 0) <> (len(lc) > 0))::int as legal_one_missing from f1""")
def feat_legal(s, d):
    return features.set_features(_pairs(s, d)).select("s1_id", "cand_id", "legal_same", "legal_conflict", "legal_one_missing")


_DIFF = f"(len(ds) + len(dc) - 2 * {_inter('ds', 'dc')})"


@query(f"""with {FEAT} select s1_id, cand_id, {_inter('ds', 'dc')}::int as num_shared, {_r(_jac('ds', 'dc'), 'num_jaccard')}, (len(ds) > 0 and len(dc) > 0 and {_inter('ds', 'dc')} = 0)::int as num_conflict,
    (len(dc) > 0 and {_inter('ds', 'dc')} = len(dc))::int as num_c_subset, (len(ds) > 0 and {_DIFF} = 0)::int as num_exact_match, {_DIFF}::int as num_diff_count from f1""")
def feat_numbers(s, d):
    f = features.set_features(_pairs(s, d))
    return f.select("s1_id", "cand_id", "num_shared", F.round("num_jaccard", 6).alias("num_jaccard"), "num_conflict", "num_c_subset", "num_exact_match", "num_diff_count")


@query(f"""with {FEAT} select s1_id, cand_id, abs(length(name_s) - length(name_c))::int as name_len_diff, {_r('least(length(name_s), length(name_c)) / greatest(length(name_s), length(name_c), 1)', 'name_len_ratio')},
    {_r("case when addr_c <> '' then least(length(addr_s), length(addr_c)) / greatest(length(addr_s), length(addr_c), 1) end", 'addr_len_ratio')}, (addr_c = '')::int as addr_c_empty, (cand_id like 'S3%')::int as is_source3,
    regexp_matches(name_c, '[ऀ-ൿ]')::int as name_c_foreign from f1""")
def feat_length(s, d):
    f = features.set_features(_pairs(s, d))
    return f.select("s1_id", "cand_id", "name_len_diff", F.round("name_len_ratio", 6).alias("name_len_ratio"), F.round("addr_len_ratio", 6).alias("addr_len_ratio"), "addr_c_empty", "is_source3", "name_c_foreign")


@query(f"""with {CAND} select s1_id, cand_id, block_rank, round(score_all / max(score_all) over (partition by s1_id), 6) as block_score_rel, count(*) over (partition by s1_id) as n_candidates from cand""")
def feat_block(s, d):
    f = features.block_features(_candidates(s, d))
    return f.select("s1_id", "cand_id", "block_rank", F.round("block_score_rel", 6).alias("block_score_rel"), "n_candidates")


@query(f"with {FEAT} select s1_id, cand_id, {_r('coalesce((j + k) / 2, j, k, 0)', 'rule_score')} from (select s1_id, cand_id, {_jac('ns', 'nc')} as j, {_jac('as_', 'ac')} as k from f1)")
def feat_rule(s, d):
    return features.set_features(_pairs(s, d)).select("s1_id", "cand_id", F.round("rule_score", 6).alias("rule_score"))


@query(f"with {CAND} select c.s1_id, c.cand_id, (t.cand_id is not null)::int as label from cand c left join truth t using (s1_id, cand_id)")
def feat_label(s, d):
    return _labelled(_candidates(s, d).select("s1_id", "cand_id"), s, d)


def _labelled(pairs: DataFrame, s, d) -> DataFrame:
    return pairs.join(_truth(s, d).withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("hit", F.lit(0))).drop("hit")


@query()  # the other engine counts bytes, not letters
def feat_levenshtein(s, d):
    return _pairs(s, d).select("s1_id", "cand_id", F.levenshtein("name_s", "name_c").alias("name_distance"))


@query()
def feat_fuzzy(s, d):
    from ligature.workspace import scatter

    f = features.ratio_features(scatter(_pairs(s, d).select("s1_id", "cand_id", "name_s", "addr_s", "name_c", "addr_c"), "s1_id", "cand_id"))
    return f.drop("name_s", "addr_s", "name_c", "addr_c")


_GRAM = """select text, substr(w, i, 3) as gram from (select text, ' ' || unnest({0}) || ' ' as w from (select distinct text from {1})) t, lateral (select unnest(range(1, length(w) - 1)) as i)"""


@query(f"""with {PAIRS}, corpus as (select name as text from pooln), texts as (select distinct text from (select name_s as text from pairs union all select name_c from pairs)),
    gc as ({_GRAM.format(Q.toks('text'), 'corpus')}), gt as ({_GRAM.format(Q.toks('text'), 'texts')}), df as (select gram, count(distinct text) as df from gc group by gram having count(distinct text) >= 2),
    w as (select text, gram, count(*) * (ln((1 + (select count(distinct text) from corpus)) / (1 + any_value(df))) + 1) as w from gt join df using (gram) group by text, gram),
    n as (select text, gram, w / sqrt(sum(w * w) over (partition by text)) as w from w),
    dots as (select a, b, sum(x.w * y.w) as c from (select distinct name_s as a, name_c as b from pairs) join n x on x.text = a join n y on y.text = b and y.gram = x.gram group by a, b)
    select s1_id, cand_id, round(coalesce(c, 0), 6) as name_tfidf from pairs left join dots on a = name_s and b = name_c""")
def feat_tfidf(s, d):
    from ligature.workspace import materialize

    pairs = materialize(_pairs(s, d).select("s1_id", "cand_id", "name_s", "name_c"), "pairs")
    made = features.tfidf_cosine(pairs, "name_s", "name_c", _norm(_pool(s, d)).select(F.col("name").alias("text")))
    return made.select("s1_id", "cand_id", F.round("cosine", 6).alias("name_tfidf"))


_AUC = """, u as (select feature, value, label from l unpivot (value for feature in ({0}))), c as (select feature, value, sum(label) as pos, sum(1 - label) as neg from u group by 1, 2),
    w as (select feature, pos, neg, pos * (sum(neg) over (partition by feature order by value) - neg + neg / 2) as wins from c)
    select feature, sum(pos)::bigint as positives, sum(neg)::bigint as negatives, round(case when sum(pos) * sum(neg) > 0 then sum(wins) / (sum(pos) * sum(neg)) end, 6) as auc from w group by feature"""


@query(f"""with {FEAT}, l as (select round({_jac('ns', 'nc')}, 9) as name_jaccard, round({_jac('as_', 'ac')}, 9) as addr_jaccard, score_all::double as score_all, (t.cand_id is not null)::int as label
    from f1 left join truth t using (s1_id, cand_id)) {_AUC.format('name_jaccard, addr_jaccard, score_all')}""")
def feat_auc(s, d):
    f = _labelled(features.set_features(_pairs(s, d)).select("s1_id", "cand_id", F.round("name_jaccard", 9).alias("name_jaccard"), F.round("addr_jaccard", 9).alias("addr_jaccard"), "score_all"), s, d)
    long = f.unpivot(["label"], ["name_jaccard", "addr_jaccard", "score_all"], "feature", "value")
    return evaluation.rank_auc(long, "value", "label", ["feature"])


# ------------------------------------------------------------------ second stage


@query(f"""with {SCORED}, k as (select s1_id, cand_id, probability as p1, substr(cand_id, 1, 2) as src from scored where probability >= 0.01),
    r as (select *, row_number() over (partition by s1_id order by p1 desc, cand_id) as p1_rank, max(p1) over (partition by s1_id) as best, (p1 >= 0.9)::int as sure from k),
    x as (select *, max(case when p1_rank = 2 then p1 end) over (partition by s1_id) as second, sum(sure) over (partition by s1_id) as nc, sum(sure) over (partition by s1_id, src) as ns, sum((p1 >= 0.5)::int) over (partition by s1_id) as nh from r)
    select s1_id, cand_id, p1_rank, round(best - p1, 6) as p1_gap_to_best, nh::bigint as n_above_half, round(case when p1 >= best then coalesce(second, 0) else best end, 6) as p1_best_other, nc::bigint as n_confident,
    (ns - sure)::bigint as n_confident_same_source, (nc - ns)::bigint as n_confident_other_source, (nc - sure > 0)::int as has_confident_other from x""")
def s2_context(s, d):
    f = stage2.context_features(_scored(s, d).select("s1_id", "cand_id", F.col("probability").alias("p1")))
    return f.select("s1_id", "cand_id", "p1_rank", F.round("p1_gap_to_best", 6).alias("p1_gap_to_best"), "n_above_half", F.round("p1_best_other", 6).alias("p1_best_other"), "n_confident", "n_confident_same_source", "n_confident_other_source", "has_confident_other")


_NEAR = "len(list_filter(dc, lambda n: len(list_filter(ds, lambda m: n = m or (greatest(length(n), length(m)) >= 2 and abs(length(n) - length(m)) <= 1 and levenshtein(n, m) <= 1))) > 0))"


@query(f"with {FEAT}, z as (select s1_id, cand_id, ds, dc, {_NEAR} as near, {_inter('ds', 'dc')} as same from f1) select s1_id, cand_id, near::int as num_close_shared, (near - same)::int as num_close_only, (len(ds) > 0 and len(dc) > 0 and near = 0)::int as num_conflict_close from z")
def s2_close_numbers(s, d):
    return stage2.number_noise(_pairs(s, d)).select("s1_id", "cand_id", "num_close_shared", "num_close_only", "num_conflict_close")


@query(f"with {Q.NORMAL} select word, count(*) as n from (select unnest(list_distinct(list_filter({Q.toks('name')}, lambda w: w not in ({Q.NAMES})))) as word from s1n) group by word")
def s2_word_freq(s, d):
    return stage2.word_frequencies(_norm(_s1(s, d)))


@query()
def s2_word_noise(s, d):
    return stage2.word_noise(_pairs(s, d).select("s1_id", "cand_id", "name_s", "name_c"), stage2.word_frequencies(_norm(_s1(s, d))))


@query()
def s2_cross(s, d):
    p = _pairs(s, d).withColumn("p1", F.round(F.col("score_all") / (F.col("score_all") + 2), 6))
    return stage2.cross_features(p.select("s1_id", "cand_id", "p1", "name_c", "addr_c"))


# ------------------------------------------------------------------ decisions


@query(f"with {SCORED} select s1_id, cand_id, probability from scored where probability >= 0.6")
def dec_global(s, d):
    return decision.global_threshold(_scored(s, d), 0.6).select("s1_id", "cand_id", "probability")


@query(f"with {SCORED} select s1_id, cand_id, probability from (select *, max(probability) over (partition by s1_id) as best from scored) where probability >= 0.5 and probability >= 0.8 * best")
def dec_relative(s, d):
    return decision.relative_threshold(_scored(s, d), 0.5, 0.8).select("s1_id", "cand_id", "probability")


@query(f"""with {SCORED}, a as (select *, row_number() over w as k, sum(probability) over (w rows unbounded preceding) as cum, sum(probability) over (partition by s1_id) as n, sum(ln(greatest(1e-12, 1 - probability))) over (partition by s1_id) as l from scored window w as (partition by s1_id order by probability desc, cand_id)),
    b as (select *, exp(l) as none, round(1.25 * cum / (k + 0.25 * n), 12) as f_k from a), c as (select s1_id, case when none >= f_k then 0 else k end as best_k from (select *, row_number() over (partition by s1_id order by f_k desc, k) as place from b) where place = 1)
    select s1_id, cand_id, probability from b join c using (s1_id) where k <= best_k""")
def dec_expected(s, d):
    return decision.expected_f05(_scored(s, d)).select("s1_id", "cand_id", "probability")


@query("select 'A' as s1_id, unnest(['a1', 'a2']) as cand_id union all select 'B', 'b1'")
def dec_expected_toy(s, d):
    """Three entities for which the choice is known."""
    rows = [("A", "a1", 0.99), ("A", "a2", 0.98), ("A", "a3", 0.65), ("A", "a4", 0.05), ("B", "b1", 0.65), ("B", "b2", 0.10), ("C", "c1", 0.30)]
    return decision.expected_f05(s.createDataFrame(rows, "s1_id string, cand_id string, probability double")).select("s1_id", "cand_id")


OWNED = f"{SCORED}, owned as (select * from (select *, row_number() over (partition by cand_id order by probability desc, s1_id) as place from scored where probability >= 0.5) where place = 1)"


def _owned(s, d):
    return decision.one_owner(decision.global_threshold(_scored(s, d), 0.5))


@query(f"with {OWNED} select s1_id, cand_id, probability from owned")
def dec_one_owner(s, d):
    return _owned(s, d).select("s1_id", "cand_id", "probability")


@query(f"with {OWNED} {LISTED.format('owned')} select s.entity_id as source1_entity_id, coalesce(array_to_string(list_sort(ids), ','), '') as matched_entity_ids from s1 s left join listed on s1_id = s.entity_id")
def dec_assemble(s, d):
    return sinks.assemble(_s1(s, d), decision.to_lists(_owned(s, d)))


_GRID = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


@query(f"""with {SCORED}, grid as (select unnest({_GRID}) as threshold), per as (select m.source1_entity_id as s1_id, count(distinct t.cand_id) as n_true from m left join truth t on t.s1_id = m.source1_entity_id group by 1),
    h as (select threshold, p.s1_id, count(*) as n_pred, sum((t.cand_id is not null)::int) as n_correct from scored p join grid on probability >= threshold left join truth t using (s1_id, cand_id) group by 1, 2),
    e as (select g.threshold, per.s1_id, n_true, coalesce(n_pred, 0) as n_pred, coalesce(n_correct, 0) as n_correct from per cross join grid g left join h on h.s1_id = per.s1_id and h.threshold = g.threshold)
    select threshold::double as threshold, round(avg({F05}), 6) as macro_f05, sum(n_pred)::bigint as n_pred, sum(n_correct)::bigint as n_correct from e group by threshold""")
def dec_sweep(s, d):
    return evaluation.threshold_sweep(tables.known_matches(s, d), _scored(s, d), _GRID)


# ------------------------------------------------------------------ evaluation


def _scores(s, d):
    return evaluation.score_per_entity(tables.known_matches(s, d), decision.to_lists(_owned(s, d)))


@query(f"with {OWNED} {_entity_sql('owned')} select source1_entity_id, n_true, n_pred, n_correct, round(f05, 6) as f05 from sc")
def eval_per_entity(s, d):
    return _scores(s, d).withColumn("f05", F.round("f05", 6))


@query(f"""with {OWNED} {_entity_sql('owned')} select count(*) as entities, round(avg(f05), 6) as macro_f05, round(avg(case when n_true > 0 then f05 end), 6) as matched_f05, round(avg(case when n_true = 0 then f05 end), 6) as single_f05,
    round(sum(n_correct) / nullif(sum(n_pred), 0), 6) as micro_precision, round(sum(n_correct) / nullif(sum(n_true), 0), 6) as micro_recall, sum(n_true)::bigint as n_true, sum(n_pred)::bigint as n_pred, sum(n_correct)::bigint as n_correct from sc""")
def eval_report(s, d):
    return evaluation.report(_scores(s, d))


@query(f"with {CAND} select count(*) as true_pairs, count(c.cand_id) as found, round(count(c.cand_id) / nullif(count(*), 0), 6) as recall from truth t left join cand c using (s1_id, cand_id)")
def eval_recall(s, d):
    return evaluation.candidate_recall(_truth(s, d), _candidates(s, d))


@query(f"""with {SCORED}, c as (select probability as v, sum((t.cand_id is not null)::int) as pos, sum((t.cand_id is null)::int) as neg from scored p left join truth t using (s1_id, cand_id) group by 1),
    w as (select pos, neg, pos * (sum(neg) over (order by v) - neg + neg / 2) as wins from c) select sum(pos)::bigint as positives, sum(neg)::bigint as negatives, round(sum(wins) / nullif(sum(pos) * sum(neg), 0), 6) as auc from w""")
def eval_auc(s, d):
    return evaluation.rank_auc(_labelled(_scored(s, d), s, d), "probability", "label")


@query(f"with {SCORED} select (t.cand_id is not null)::int as label, (probability >= 0.5)::int as predicted, count(*) as n from scored p left join truth t using (s1_id, cand_id) group by 1, 2")
def eval_confusion(s, d):
    return _labelled(_scored(s, d), s, d).groupBy("label", (F.col("probability") >= 0.5).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


@query(f"""with {SCORED} select least(floor(probability * 10), 9)::bigint as bucket, count(*) as n, round(avg(probability), 6) as mean_probability, round(avg((t.cand_id is not null)::int), 6) as true_share
    from scored p left join truth t using (s1_id, cand_id) group by 1""")
def eval_calibration(s, d):
    bucket = F.least(F.floor(F.col("probability") * 10), F.lit(9)).alias("bucket")
    return _labelled(_scored(s, d), s, d).groupBy(bucket).agg(F.count("*").alias("n"), F.round(F.avg("probability"), 6).alias("mean_probability"), F.round(F.avg("label"), 6).alias("true_share"))


@query()
def eval_bootstrap(s, d):
    from ligature.workspace import materialize

    truth, scored = tables.known_matches(s, d), materialize(_scored(s, d), "scored")
    a = evaluation.score_per_entity(truth, decision.to_lists(decision.global_threshold(scored, 0.5)))
    b = evaluation.score_per_entity(truth, decision.to_lists(decision.one_owner(decision.global_threshold(scored, 0.5))))
    return evaluation.paired_bootstrap(a, b)


@query(f"""with {SCORED}, kept as (select * from scored where probability >= 0.5) {_entity_sql('kept')}, sa as (select * from sc), o as (select * from (select *, row_number() over (partition by cand_id order by probability desc, s1_id) as place from kept) where place = 1),
    hb as (select s1_id, count(*) as n_pred, sum(case when t.cand_id is not null then 1 else 0 end) as n_correct from o p left join truth t using (s1_id, cand_id) group by s1_id),
    eb as (select source1_entity_id, n_true, coalesce(n_pred, 0) as n_pred, coalesce(n_correct, 0) as n_correct from per left join hb on s1_id = source1_entity_id), sb as (select source1_entity_id, {F05} as f from eb)
    select sum((f > f05)::int)::bigint as better, sum((f < f05)::int)::bigint as worse, sum((f = f05)::int)::bigint as unchanged from sa join sb using (source1_entity_id)""")
def eval_bootstrap_counts(s, d):
    truth, scored = tables.known_matches(s, d), _scored(s, d)
    kept = decision.global_threshold(scored, 0.5)
    a = evaluation.score_per_entity(truth, decision.to_lists(kept)).select("source1_entity_id", F.col("f05").alias("x"))
    b = evaluation.score_per_entity(truth, decision.to_lists(decision.one_owner(kept))).select("source1_entity_id", F.col("f05").alias("y"))
    n = lambda c, name: F.sum(c.cast("int")).alias(name)
    return a.join(b, "source1_entity_id").agg(n(F.col("y") > F.col("x"), "better"), n(F.col("y") < F.col("x"), "worse"), n(F.col("y") == F.col("x"), "unchanged"))


@query(f"""with {SCORED}, l as (select p.*, (t.cand_id is not null) as hit, max(case when t.cand_id is not null then probability end) over (partition by p.s1_id) as own from scored p left join truth t using (s1_id, cand_id) where p.s1_id in (select source1_entity_id from m))
    select case when hit and probability >= 0.5 then 'ok' when hit then 'missed' when probability < 0.5 then 'rejected' when own is null then 'wrong_no_match' else 'wrong_beside_match' end as kind, count(*) as n from l group by 1""")
def eval_error_kinds(s, d):
    listed = tables.known_matches(s, d).select(F.col("source1_entity_id").alias("s1_id"))
    l = _labelled(_scored(s, d), s, d).join(listed, "s1_id", "left_semi").withColumn("own", F.max(F.when(F.col("label") == 1, F.col("probability"))).over(Window.partitionBy("s1_id")))
    yes = F.col("probability") >= 0.5
    kind = F.when((F.col("label") == 1) & yes, "ok").when(F.col("label") == 1, "missed").when(~yes, "rejected").when(F.col("own").isNull(), "wrong_no_match").otherwise("wrong_beside_match")
    return l.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"""with {OWNED} {_entity_sql('owned')}, cost as (select *, n_pred - n_correct as wrong from ent), v as (select 'as_is' as variant, n_true, n_pred, n_correct from cost union all select 'no_false_merges', n_true, n_correct, n_correct from cost
    union all select 'no_misses', n_true, n_true + wrong, n_true from cost) select variant, round(avg({F05}), 6) as macro_f05 from v group by variant""")
def eval_error_cost(s, d):
    e = _scores(s, d)
    wrong = F.col("n_pred") - F.col("n_correct")
    def variant(name, p, c):
        return F.struct(F.lit(name).alias("variant"), p.alias("p"), c.alias("c"))

    n, ok = F.col("n_true"), F.col("n_correct")
    variants = F.array(variant("as_is", F.col("n_pred"), ok), variant("no_false_merges", ok, ok), variant("no_misses", n + wrong, n))
    v = e.select("n_true", F.explode(variants).alias("v"))
    return v.groupBy("v.variant").agg(F.round(F.avg(evaluation.f05(F.col("n_true"), F.col("v.p"), F.col("v.c"))), 6).alias("macro_f05"))


@query(f"""with {Q.RECORDS}, h as (select entity_id, md5('42' || entity_id) as h from s1), v as (select entity_id, h, ('0x' || substr(h, 1, 8))::bigint < 858993459 as validation from h), r as (select *, row_number() over (partition by validation order by h, entity_id) as place from v)
    select entity_id, case when validation then 'validation' else 'train' end as split, validation and place <= 100 as small_validation from r""")
def split_entities(s, d):
    return evaluation.split_entities(_s1(s, d), "entity_id", 0.2, 100)


# ------------------------------------------------------------------ learning

_ML = ["score_all", "score_name", "score_addr", "block_rank", "block_score_rel", "n_candidates", "name_exact", "core_exact", "name_jaccard", "addr_jaccard", "core_jaccard", "name_dice", "name_len_ratio", "legal_conflict", "num_shared", "num_conflict", "num_exact_match", "addr_c_empty", "is_source3"]


def _training(s, d):
    from ligature.workspace import materialize

    listed = tables.known_matches(s, d).select(F.col("source1_entity_id").alias("s1_id"))
    p = _labelled(features.set_features(features.block_features(_pairs(s, d))), s, d).join(listed, "s1_id", "left_semi")
    return materialize(p.select("s1_id", "cand_id", "label", *_ML), "training")


def _model_query(learner: str) -> None:
    def f(s, d):
        e = learn.EXPERIMENTS[learner]
        from ligature.workspace import materialize

        oof = materialize(learn.out_of_fold(_training(s, d), e, _ML), "out-of-fold")
        return evaluation.rank_auc(oof, "probability", "label").withColumn("learner", F.lit(learner))

    f.__name__ = f"model_{learner}"
    query()(f)


for _learner in ("logistic", "forest", "boosting"):
    _model_query(_learner)


# ------------------------------------------------------------------ profiles


@query("""select 'train_source' || n as file, n_rows, ids, n_rows - ids as repeated, empty_names, empty_addresses, names, round(nl, 6) as name_length, round(al, 6) as address_length from (
    select n, count(*) as n_rows, count(distinct entity_id) as ids, sum((coalesce(business_name, '') = '')::int)::bigint as empty_names, sum((coalesce(business_address, '') = '')::int)::bigint as empty_addresses, count(distinct business_name) as names, avg(length(business_name)) as nl, avg(length(business_address)) as al
    from (select 1 as n, * from train_source1 union all select 2, * from train_source2 union all select 3, * from train_source3) group by n)""")
def eda_files(s, d):
    parts = [profile.file_profile(tables.table(s, d, f"train_source{i}")).select(F.lit(f"train_source{i}").alias("file"), "*") for i in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""select country, sum((n = 1)::int)::bigint as s1, sum((n = 2)::int)::bigint as s2, sum((n = 3)::int)::bigint as s3 from (select 1 as n, country from train_source1 union all select 2, country from train_source2 union all select 3, country from train_source3) group by country""")
def eda_countries(s, d):
    u = None
    for i in (1, 2, 3):
        t = tables.table(s, d, f"train_source{i}").select("country", F.lit(f"s{i}").alias("file"))
        u = t if u is None else u.unionByName(t)
    return u.groupBy("country").pivot("file", ["s1", "s2", "s3"]).count().na.fill(0)


@query(f"""with {Q.RECORDS}, x as (select list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '') as ids from m)
    select len(ids)::int as n_matches, len(list_filter(ids, lambda x: x like 'S2%'))::int as n_s2, len(list_filter(ids, lambda x: x like 'S3%'))::int as n_s3, count(*) as entities from x group by 1, 2, 3""")
def eda_match_counts(s, d):
    return profile.match_counts(tables.known_matches(s, d))


@query(f"with {Q.RECORDS} select cand_id, count(*) as owners from truth group by cand_id having count(*) > 1")
def eda_double_owned(s, d):
    return _truth(s, d).groupBy("cand_id").agg(F.count("*").alias("owners")).where("owners > 1")


_SHARES = {
    "indic": (lambda c: c.rlike(T.INDIC), "regexp_matches(x, '[ऀ-ൿ]')"),
    "accented": (lambda c: c.rlike("[\\u00c0-\\u024f]"), "regexp_matches(x, '[À-ɏ]')"),
    "upper": (lambda c: (c == F.upper(c)) & (c != F.lower(c)), "x = upper(x) and x <> lower(x)"),
    "lower": (lambda c: (c == F.lower(c)) & (c != F.upper(c)), "x = lower(x) and x <> upper(x)"),
    "symbol_first": (lambda c: c.rlike(r"^[^\p{L}\p{N}\p{M}]"), r"regexp_matches(x, '^[^\p{L}\p{N}\p{M}]')"),
    "bracket": (lambda c: c.rlike(r"[\[\]()]"), r"regexp_matches(x, '[\[\]()]')"),
    "domain": (lambda c: c.rlike(r"\.(com|net|org|in|co|fr)$"), r"regexp_matches(x, '\.(com|net|org|in|co|fr)$')"),
    "handle": (lambda c: c.rlike("^[#@]"), "regexp_matches(x, '^[#@]')"),
}


@query(f"""with {Q.RECORDS}, t as (select country, substr(entity_id, 1, 2) as source, business_name as x from pool)
    select country, source, count(*) as n, {', '.join(f'round(100 * avg(({v[1]})::int), 6) as {k}' for k, v in _SHARES.items())} from t group by rollup(country, source)""")
def eda_name_shares(s, d):
    t = _pool(s, d).select("country", F.substring("entity_id", 1, 2).alias("source"), F.col("business_name").alias("x"))
    t = t.select("country", "source", *[v[0](F.col("x")).cast("int").alias(k) for k, v in _SHARES.items()])
    return t.rollup("country", "source").agg(F.count("*").alias("n"), *[F.round(100 * F.avg(k), 6).alias(k) for k in _SHARES])


def _top_sql(pick: str) -> str:
    return f"""with {Q.NORMAL}, w as (select country, unnest({pick}) as word from (select country, {Q.toks('name')} as t from s1n)), c as (select country, word, count(*) as n from w group by 1, 2)
      select * from (select *, row_number() over (partition by country order by n desc, word) as place from c) where place <= 20"""


@query(_top_sql("t"))
def eda_top_words(s, d):
    return profile.top_words(_norm(_s1(s, d)), "name", "country", 20)


@query(_top_sql("t[-1:]"))
def eda_last_words(s, d):
    return profile.top_words(_norm(_s1(s, d)), "name", "country", 20, "last")


@query(_top_sql("t[1:1]"))
def eda_first_words(s, d):
    return profile.top_words(_norm(_s1(s, d)), "name", "country", 20, "first")


@query(f"with {Q.NORMAL} select country, name, count(*) as n from s1n where name <> '' group by country, name having count(*) > 1")
def eda_repeated_names(s, d):
    return _norm(_s1(s, d)).where("name <> ''").groupBy("country", "name").agg(F.count("*").alias("n")).where("n > 1")


@query(f"""with {Q.RECORDS} select country, count(*) as n, round(100 * avg((business_address = '')::int), 6) as empty_percent, round(100 * avg((lower(trim(business_address)) in ('null', 'none', '-', 'n/a', 'na'))::int), 6) as placeholder_percent,
    round(avg(len(string_split(business_address, ','))), 6) as comma_parts, round(100 * avg(regexp_matches(business_address, '[0-9]')::int), 6) as number_percent, round(100 * avg(regexp_matches(lower(business_address), '(^|[^a-z])(near|opp|behind|nr)([^a-z]|$)')::int), 6) as landmark_percent from pool group by country""")
def eda_addresses(s, d):
    a = F.col("business_address")
    return _pool(s, d).groupBy("country").agg(
        F.count("*").alias("n"), F.round(100 * F.avg((a == "").cast("int")), 6).alias("empty_percent"), F.round(100 * F.avg(F.lower(F.trim(a)).isin("null", "none", "-", "n/a", "na").cast("int")), 6).alias("placeholder_percent"),
        F.round(F.avg(F.size(F.split(a, ","))), 6).alias("comma_parts"), F.round(100 * F.avg(a.rlike("[0-9]").cast("int")), 6).alias("number_percent"),
        F.round(100 * F.avg(F.lower(a).rlike("(^|[^a-z])(near|opp|behind|nr)([^a-z]|$)").cast("int")), 6).alias("landmark_percent"),
    )


@query(f"with {Q.RECORDS} select a.country as s1_country, b.country as pool_country, count(*) as n from truth t join s1 a on a.entity_id = s1_id join pool b on b.entity_id = cand_id group by 1, 2")
def eda_pair_countries(s, d):
    a, b = _s1(s, d).select(F.col("entity_id").alias("s1_id"), F.col("country").alias("s1_country")), _pool(s, d).select(F.col("entity_id").alias("cand_id"), F.col("country").alias("pool_country"))
    return _truth(s, d).join(a, "s1_id").join(b, "cand_id").groupBy("s1_country", "pool_country").agg(F.count("*").alias("n"))


TRUE_PAIRS = f"{Q.NORMAL}, tp as (select t.*, s.country, s.name as name_s, s.addr as addr_s, p.name as name_c, p.addr as addr_c from truth t join s1n s on s.entity_id = s1_id join pooln p on p.entity_id = cand_id), te as (select *, {Q.toks('name_s')} as ns, {Q.toks('name_c')} as nc, {Q.toks('addr_s')} as as_, {Q.toks('addr_c')} as ac from tp)"


@query(f"""with {TRUE_PAIRS} select country, substr(cand_id, 1, 2) as source, count(*) as n, round(100 * avg((name_s = name_c)::int), 6) as same_name, round(100 * avg((addr_s = addr_c)::int), 6) as same_address, round(100 * avg(({_inter('ns', 'nc')} > 0)::int), 6) as shared_name_word,
    round(100 * avg(({_inter('as_', 'ac')} > 0)::int), 6) as shared_address_word, round(100 * avg((addr_c = '')::int), 6) as empty_address from te group by rollup(country, source)""".replace("rollup(country, source)", "rollup(country, substr(cand_id, 1, 2))"))
def eda_evidence(s, d):
    p = features.with_texts(_truth(s, d), _norm(_s1(s, d)), _norm(_pool(s, d))).join(_s1(s, d).select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    w = lambda a, b: F.arrays_overlap(T.tokens(F.col(a)), T.tokens(F.col(b)))
    checks = {"same_name": F.col("name_s") == F.col("name_c"), "same_address": F.col("addr_s") == F.col("addr_c"), "shared_name_word": w("name_s", "name_c"), "shared_address_word": w("addr_s", "addr_c"), "empty_address": F.col("addr_c") == ""}
    p = p.select("country", F.substring("cand_id", 1, 2).alias("source"), *[v.cast("int").alias(k) for k, v in checks.items()])
    return p.rollup("country", "source").agg(F.count("*").alias("n"), *[F.round(100 * F.avg(k), 6).alias(k) for k in checks])


@query(f"""with {TRUE_PAIRS}, e as (select case when name_s = name_c then 'equal' when {_inter('ns', 'nc')} > 0 then 'shared' else 'none' end as name_evidence, case when addr_c = '' then 'empty' when addr_s = addr_c then 'equal' when {_inter('as_', 'ac')} > 0 then 'shared' else 'none' end as addr_evidence from te)
    select name_evidence, addr_evidence, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from e group by 1, 2""")
def eda_evidence_cross(s, d):
    p = features.with_texts(_truth(s, d), _norm(_s1(s, d)), _norm(_pool(s, d)))
    w = lambda a, b: F.arrays_overlap(T.tokens(F.col(a)), T.tokens(F.col(b)))
    name = F.when(F.col("name_s") == F.col("name_c"), "equal").when(w("name_s", "name_c"), "shared").otherwise("none")
    addr = F.when(F.col("addr_c") == "", "empty").when(F.col("addr_s") == F.col("addr_c"), "equal").when(w("addr_s", "addr_c"), "shared").otherwise("none")
    n = p.groupBy(name.alias("name_evidence"), addr.alias("addr_evidence")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n")).first()[0]
    return n.withColumn("share", F.round(F.col("n") / F.lit(total or 1), 6))


@query(f"""with {Q.NORMAL}, same as (select s.entity_id as s1_id, p.entity_id as cand_id from s1n s join pooln p using (country, name) where s.name <> '' and s.entity_id in (select source1_entity_id from m))
    select count(*) as equal_names, sum((t.cand_id is null)::int)::bigint as traps, count(distinct case when t.cand_id is null then s1_id end) as entities from same left join truth t using (s1_id, cand_id)""")
def eda_traps(s, d):
    a = _norm(_s1(s, d)).where("name <> ''").join(tables.known_matches(s, d).select(F.col("source1_entity_id").alias("entity_id")), "entity_id", "left_semi").select(F.col("entity_id").alias("s1_id"), "country", "name")
    same = a.join(_norm(_pool(s, d)).select(F.col("entity_id").alias("cand_id"), "country", "name"), ["country", "name"])
    l = _labelled(same.select("s1_id", "cand_id"), s, d)
    return l.agg(F.count("*").alias("equal_names"), F.sum(1 - F.col("label")).alias("traps"), F.countDistinct(F.when(F.col("label") == 0, F.col("s1_id"))).alias("entities"))


@query(f"with {OWNED} {_entity_sql('owned')} select country, case when n_true = 0 then 'none' when n_true = 1 then 'one' else 'many' end as kind, count(*) as entities, round(avg(f05), 6) as macro_f05 from sc join s1 on entity_id = source1_entity_id group by 1, 2")
def eda_score_by_kind(s, d):
    kind = F.when(F.col("n_true") == 0, "none").when(F.col("n_true") == 1, "one").otherwise("many").alias("kind")
    e = _scores(s, d).join(_s1(s, d).select(F.col("entity_id").alias("source1_entity_id"), "country"), "source1_entity_id")
    return e.groupBy("country", kind).agg(F.count("*").alias("entities"), F.round(F.avg("f05"), 6).alias("macro_f05"))


@query(f"with {SCORED} select floor(score_all / 10)::bigint as bucket, (t.cand_id is not null)::int as label, count(*) as n from scored p left join truth t using (s1_id, cand_id) group by 1, 2")
def eda_score_buckets(s, d):
    return _labelled(_scored(s, d), s, d).groupBy(F.floor(F.col("score_all") / 10).alias("bucket"), "label").agg(F.count("*").alias("n"))


_F05_ROWS = [(4, 4, 4), (4, 5, 4), (4, 3, 3), (4, 2, 2), (4, 1, 1), (4, 4, 2), (4, 4, 1), (4, 0, 0), (0, 0, 0), (0, 2, 0)]


@query(f"select n_true, n_pred, n_correct, round({F05}, 6) as f05 from (values {', '.join(map(str, _F05_ROWS))}) t(n_true, n_pred, n_correct)")
def eda_f05_scenarios(s, d):
    rows = s.createDataFrame(_F05_ROWS, "n_true int, n_pred int, n_correct int")
    return rows.withColumn("f05", F.round(evaluation.f05(F.col("n_true"), F.col("n_pred"), F.col("n_correct")), 6))


# ------------------------------------------------------------------ the rule-based baseline


@query(f"""with {WORD_KEYS}, pairs as (select c.s1_id, c.cand_id, s.name as name_s, s.addr as addr_s, p.name as name_c, p.addr as addr_c from cand c join s1n s on s.entity_id = c.s1_id join pooln p on p.entity_id = c.cand_id),
    t0 as (select s1_id, cand_id, {', '.join(f'{v} as {k}' for k, v in _N.items())} from pairs), j as (select s1_id, cand_id, {_jac('ns', 'nc')} as j, {_jac('as_', 'ac')} as k from t0),
    o as (select * from (select s1_id, cand_id, row_number() over (partition by cand_id order by p desc, s1_id) as place from (select s1_id, cand_id, round(coalesce((j + k) / 2, j, k, 0), 9) as p from j) where p >= 0.6) where place = 1) {LISTED.format('o')}
    select s.entity_id as source1_entity_id, coalesce(array_to_string(list_sort(ids), ','), '') as matched_entity_ids from s1 s left join listed on s1_id = s.entity_id""")
def er_baseline(s, d):
    p = features.with_texts(_rule_candidates(s, d), _norm(_s1(s, d)), _norm(_pool(s, d)))
    tok = lambda c: T.tokens(F.col(c))
    score = F.round(mean_known(jaccard(tok("name_s"), tok("name_c")), jaccard(tok("addr_s"), tok("addr_c"))), 9)
    kept = decision.one_owner(decision.global_threshold(p.select("s1_id", "cand_id", score.alias("probability")), 0.6))
    return sinks.assemble(_s1(s, d), decision.to_lists(kept))





# ------------------------------------------------------------------ more profiles


@query(f"""with {OWNED}, t as (select least(len(list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '')), 8)::int as n_matches from m),
    p as (select least(coalesce(k, 0), 8)::int as n_matches from s1 left join (select s1_id, count(*) as k from owned group by s1_id) on s1_id = entity_id),
    a as (select n_matches, round(count(*) / sum(count(*)) over (), 6) as known_share from t group by 1), b as (select n_matches, round(count(*) / sum(count(*)) over (), 6) as found_share from p group by 1)
    select n_matches, coalesce(known_share, 0) as known_share, coalesce(found_share, 0) as found_share from a full join b using (n_matches)""")
def eda_match_distribution(s, d):
    """Shares of entities by number of matches, known and found, side by side."""
    known = tables.known_matches(s, d).select(F.least(F.size(tables.id_list("matched_entity_ids")), F.lit(8)).alias("n_matches"))
    found = sinks.assemble(_s1(s, d), decision.to_lists(_owned(s, d))).select(F.least(F.size(tables.id_list("matched_entity_ids")), F.lit(8)).alias("n_matches"))

    def shares(df, name):
        n = df.groupBy("n_matches").agg(F.count("*").alias("n"))  # nine rows at most
        return n.withColumn(name, F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6)).drop("n")

    return shares(known, "known_share").join(shares(found, "found_share"), "n_matches", "full").na.fill(0.0)


@query(f"""with {Q.RECORDS}, h as (select entity_id, country, ('0x' || substr(md5('42' || entity_id), 1, 8))::bigint < 858993459 as validation from s1), t as (select s1_id, count(*) as k from truth group by s1_id)
    select case when validation then 'validation' else 'train' end as split, country, count(*) as entities, count(m.source1_entity_id) as listed, round(avg(case when m.source1_entity_id is not null then coalesce(k, 0) end), 6) as mean_matches
    from h left join m on m.source1_entity_id = entity_id left join t on t.s1_id = entity_id group by 1, 2""")
def eda_split(s, d):
    """Whether both parts of the split look alike."""
    e = evaluation.split_entities(_s1(s, d), "entity_id", 0.2, 0).join(_s1(s, d).select("entity_id", "country"), "entity_id")
    k = tables.known_matches(s, d).select(F.col("source1_entity_id").alias("entity_id"), F.size(tables.id_list("matched_entity_ids")).alias("k"))
    return e.join(k, "entity_id", "left").groupBy("split", "country").agg(F.count("*").alias("entities"), F.count("k").alias("listed"), F.round(F.avg("k"), 6).alias("mean_matches"))


@query(f"""with {Q.RECORDS}, p as (select country, trim(string_split(business_address, ',')[-1]) as part from s1), c as (select country, part, count(*) as n from p group by 1, 2)
    select * from (select *, row_number() over (partition by country order by n desc, part) as place from c) where place <= 20""")
def eda_last_parts(s, d):
    """The most frequent last parts of addresses per country."""
    c = _s1(s, d).groupBy("country", F.trim(F.element_at(F.split("business_address", ","), -1)).alias("part")).agg(F.count("*").alias("n"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("n"), "part"))).where("place <= 20")


_FORMS = ("ltd", "limited", "inc", "incorporated", "corp", "corporation", "pvt", "private")


@query(f"""with {TRUE_PAIRS}, f as (select list_filter(ns, lambda w: w in {_FORMS})[-1] as a, list_filter(nc, lambda w: w in {_FORMS})[-1] as b from te)
    select coalesce(a, '') as reference_form, coalesce(b, '') as pool_form, count(*) as n from f group by 1, 2""")
def eda_legal_variants(s, d):
    """How the last legal form of a name is written on both sides of known pairs."""
    p = features.with_texts(_truth(s, d), _norm(_s1(s, d)), _norm(_pool(s, d)))
    last = lambda c: F.coalesce(F.try_element_at(F.filter(T.tokens(F.col(c)), lambda w: w.isin(*_FORMS)), F.lit(-1)), F.lit(""))
    return p.groupBy(last("name_s").alias("reference_form"), last("name_c").alias("pool_form")).agg(F.count("*").alias("n"))


_SHARE_GRID = [0.5, 0.7, 0.9]


@query(f"""with {SCORED}, g as (select unnest({_SHARE_GRID}) as share), b as (select *, max(probability) over (partition by s1_id) as best from scored where s1_id in (select source1_entity_id from m))
    select share::double as share, count(*) as n_pred, sum((t.cand_id is not null)::int)::bigint as n_correct from b join g on probability >= 0.5 and probability >= share * best left join truth t using (s1_id, cand_id) group by share""")
def dec_relative_grid(s, d):
    """Pairs kept and right for several shares of the entity's best probability."""
    listed = tables.known_matches(s, d).select(F.col("source1_entity_id").alias("s1_id"))
    b = _labelled(_scored(s, d), s, d).join(listed, "s1_id", "left_semi").withColumn("best", F.max("probability").over(Window.partitionBy("s1_id")))
    g = b.select("*", F.explode(F.array(*[F.lit(x) for x in _SHARE_GRID])).alias("share")).where((F.col("probability") >= 0.5) & (F.col("probability") >= F.col("share") * F.col("best")))
    return g.groupBy("share").agg(F.count("*").alias("n_pred"), F.sum("label").alias("n_correct"))
