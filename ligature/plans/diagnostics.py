"""Queries that look into a run: blocking, reverse index, features, errors, baselines and more profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ligature.functions import text as T
from ligature.operators import blocking, decision, evaluation, features, keys, profile
from ligature.plans import sql as Q
from ligature.plans.registry import (
    CAND, F05, FEAT, MAX_DF, OWNED, REV, SCORED, TOP_K, TRUE_PAIRS, _AUC, _GRAM, _candidates, _entity_sql, _inter, _jac, _labelled, _norm, _owned, _pairs, _pool, _reverse, _s1, _scored, _truth, query,
)
from ligature.sources import sinks, tables
from ligature.workspace import materialize

# ------------------------------------------------------------------ sources, sinks, sets


@query(f"with {Q.RECORDS} select entity_id, country from pool where country in ('India', 'France')")
def src_pool_countries(s, d):
    return tables.pool_records(s, d, where=F.col("country").isin("India", "France")).select("entity_id", "country")


@query("""with t as (select concat_ws(chr(9), entity_id, coalesce(business_name, ''), coalesce(business_address, ''), coalesce(country, '')) || chr(10) as x from train_source2)
    select sum(length(x) - length(replace(x, ',', '')))::bigint as commas, sum(length(x) - length(replace(x, chr(10), '')))::bigint as feeds, sum((length(x) - length(replace(x, chr(9) || chr(10), ''))) / 2)::bigint as open_ends, sum(length(x) - length(replace(x, chr(13), '')))::bigint as returns from t""")
def src_text_counts(s, d):
    """What stands in the text form of a table: separators, line feeds, open line ends, carriage returns."""
    x = F.concat(F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in tables.RECORD_COLUMNS]), F.lit("\n")).alias("x")
    n = lambda y: F.sum(((F.length("x") - F.length(F.replace(F.col("x"), F.lit(y), F.lit("")))) / len(y)).cast("long"))
    return tables.table(s, d, "train_source2").select(x).agg(n(",").alias("commas"), n("\n").alias("feeds"), n("\t\n").alias("open_ends"), n("\r").alias("returns"))


@query(f"with {CAND} select s1_id as source1_entity_id, string_agg(cand_id, ',' order by block_rank) as candidate_entity_ids from cand group by s1_id")
def sink_candidates(s, d):
    return sinks.candidate_lists(_candidates(s, d))


@query(f"with {Q.NORMAL} select country, unnest(list_distinct({Q.toks('name')})) as word from s1n union select country, unnest(list_distinct({Q.toks('name')})) from pooln")
def set_words_union(s, d):
    """Words that either side uses, each once."""
    w = lambda df: _norm(df).select("country", F.explode(T.tokens(F.col("name"))).alias("word"))
    return w(_s1(s, d)).union(w(_pool(s, d))).distinct()


@query(f"""with {Q.NORMAL}, a as (select distinct country, name from s1n), b as (select distinct country, name from pooln) select 'both' as side, count(*) as n from (select * from a intersect select * from b)
    union all select 'reference', count(*) from (select * from a except select * from b) union all select 'pool', count(*) from (select * from b except select * from a)""")
def set_names_overlap(s, d):
    a, b = (_norm(x).select("country", "name").distinct() for x in (_s1(s, d), _pool(s, d)))
    side = lambda df, n: df.agg(F.lit(n).alias("side"), F.count("*").alias("n"))
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "reference")).unionByName(side(b.subtract(a), "pool"))


@query(f"with {Q.NORMAL}, {Q.keys('k1', 's1n')}, u as (select distinct key from k1 where key like '%|nj|%') select key, row_number() over (partition by split_part(key, '|', 1) order by key) - 1 as code from u")
def key_codes(s, d):
    """Codes of keys in string order, counted within a country."""
    k = keys.record_keys(_norm(_s1(s, d)), ["nj"]).select("key").distinct()
    return k.withColumn("code", F.row_number().over(Window.partitionBy(F.split("key", r"\|")[0]).orderBy("key")) - 1)


@query(f"with {Q.RECORDS} select country, entity_id from (select *, row_number() over (partition by country order by md5('7' || entity_id), entity_id) as place from s1) where place <= 50")
def sample_per_country(s, d):
    """Fifty records of each country, by hash: the same in every run."""
    w = Window.partitionBy("country").orderBy(F.md5(F.concat(F.lit("7"), "entity_id")), "entity_id")
    return _s1(s, d).withColumn("place", F.row_number().over(w)).where("place <= 50").select("country", "entity_id")


@query(f"""with {Q.RECORDS}, h as (select entity_id, md5('42' || entity_id) as h from s1), v as (select entity_id, h, ('0x' || substr(h, 1, 8))::bigint < 858993459 as validation from h),
    t as (select entity_id, 'tuning' as query_set from v where not validation order by md5('7' || entity_id), entity_id limit 200), x as (select entity_id, 'validation' as query_set from v where validation order by h, entity_id limit 100)
    select * from t union all select * from x""")
def split_query_sets(s, d):
    """The sets that designs are tuned and judged on, drawn from either side of the split."""
    split = evaluation.split_entities(_s1(s, d), "entity_id", 0.2, 100)
    tuning = split.where("split = 'train'").orderBy(F.md5(F.concat(F.lit("7"), "entity_id")), "entity_id").limit(200)
    return tuning.select("entity_id", F.lit("tuning").alias("query_set")).unionByName(split.where("small_validation").select("entity_id", F.lit("validation").alias("query_set")))


# ------------------------------------------------------------------ blocking and reverse index


def _place(order: str) -> str:
    return f"row_number() over (partition by max_df, s1_id order by {order} desc, cand_id)"


@query(f"""with {Q.KEYED}, {Q.scores(20, name='sc20')}, {Q.scores(50, name='sc50')}, u as (select 20 as max_df, * from sc20 union all select 50, * from sc50),
    r as (select *, {_place('score_all')} as a, {_place('score_name')} as b, {_place('score_addr')} as c from u), k as (select unnest([4, 10]) as top_k),
    x as (select max_df, 'all' as ranking, top_k, s1_id, cand_id from r join k on a <= top_k union all select max_df, 'split', top_k, s1_id, cand_id from r join k on b <= top_k / 2 or c <= top_k / 2)
    select max_df, ranking, top_k, count(*) as pairs, sum((t.cand_id is not null)::int)::bigint as found, (select count(*) from s1) - count(distinct x.s1_id) as empty_entities from x left join truth t using (s1_id, cand_id) group by 1, 2, 3""")
def block_sweep_rankings(s, d):
    """Designs by df bound, ranking and K: pairs, true pairs found, entities without a candidate."""
    pool, s1 = _norm(_pool(s, d)), _norm(_s1(s, d))
    a, b, n = keys.record_keys(s1), keys.record_keys(pool), pool.count()
    u = reduce(DataFrame.unionByName, [blocking.shared_keys(a, blocking.build_index(a, b, n, m)).withColumn("max_df", F.lit(m)) for m in (20, 50)])
    place = lambda c: F.row_number().over(Window.partitionBy("max_df", "s1_id").orderBy(F.desc(c), "cand_id"))
    r = u.withColumns({"a": place("score_all"), "b": place("score_name"), "c": place("score_addr")})
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("top_k"), F.lit(x).alias("ranking")) for k in (4, 10) for x in ("all", "split")])).alias("g")
    x = r.select("*", grid).where(((F.col("g.ranking") == "all") & (F.col("a") <= F.col("g.top_k"))) | ((F.col("g.ranking") == "split") & ((F.col("b") <= F.col("g.top_k") / 2) | (F.col("c") <= F.col("g.top_k") / 2))))
    x = x.select("max_df", "g.ranking", "g.top_k", "s1_id", "cand_id").join(_truth(s, d).withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    total = s1.count()
    return x.groupBy("max_df", "ranking", "top_k").agg(F.count("*").alias("pairs"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"), (F.lit(total) - F.countDistinct("s1_id")).alias("empty_entities"))


@query(f"""with {REV}, {Q.scores(MAX_DF)}, {Q.ranked(TOP_K)}, t as (select t.s1_id, t.cand_id, r.r_rank, c.cand_id is not null as own from truth t left join rev r on r.record_id = t.cand_id and r.s1_id = t.s1_id left join cand c on c.s1_id = t.s1_id and c.cand_id = t.cand_id)
    select k, round(avg(coalesce((r_rank <= k)::int, 0)), 6) as reverse_recall, round(avg((own or coalesce(r_rank <= k, false))::int), 6) as union_recall, round(avg(case when not own then coalesce((r_rank <= k)::int, 0) end), 6) as recovered from t, (select unnest([1, 2, 3, 5, 10]) as k) group by k""")
def rev_recall(s, d):
    """At several ranks: recall from the records' side, of both sides together, and the share of misses it recovers."""
    own = _candidates(s, d).select("s1_id", "cand_id", F.lit(True).alias("own"))
    t = _truth(s, d).join(_reverse(s, d).withColumnRenamed("record_id", "cand_id"), ["s1_id", "cand_id"], "left").join(own, ["s1_id", "cand_id"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    x = t.select("*", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 5, 10)])).alias("k")).withColumn("back", F.coalesce(F.col("r_rank") <= F.col("k"), F.lit(False)))
    return x.groupBy("k").agg(F.round(F.avg(F.col("back").cast("int")), 6).alias("reverse_recall"), F.round(F.avg((F.col("own") | F.col("back")).cast("int")), 6).alias("union_recall"), F.round(F.avg(F.when(~F.col("own"), F.col("back").cast("int"))), 6).alias("recovered"))


@query(f"""with {REV}, {Q.scores(MAX_DF)}, {Q.ranked(TOP_K)}, found as (select t.s1_id, t.cand_id, c.cand_id is not null as own, r.r_rank from truth t left join cand c using (s1_id, cand_id) left join rev r on r.record_id = t.cand_id and r.s1_id = t.s1_id),
    v as (select 'own' as variant, s1_id, cand_id from found where own union all select 'with_reverse_3', s1_id, cand_id from found where own or r_rank <= 3 union all select 'with_reverse_5', s1_id, cand_id from found where own or r_rank <= 5),
    per as (select m.source1_entity_id as s1_id, count(distinct t.cand_id) as n_true from m left join truth t on t.s1_id = m.source1_entity_id group by 1), n as (select variant, s1_id, count(*) as n_pred from v group by 1, 2),
    e as (select w.variant, per.s1_id, n_true, coalesce(n_pred, 0) as n_pred, coalesce(n_pred, 0) as n_correct from per cross join (select unnest(['own', 'with_reverse_3', 'with_reverse_5']) as variant) w left join n on n.s1_id = per.s1_id and n.variant = w.variant)
    select variant, round(avg({F05}), 6) as macro_f05 from e group by variant""")
def rev_oracle(s, d):
    """Macro F0.5 of a perfect judge of the candidates, alone and together with the reverse index."""
    own = _candidates(s, d).select("s1_id", "cand_id", F.lit(True).alias("own"))
    t = _truth(s, d).join(own, ["s1_id", "cand_id"], "left").join(_reverse(s, d).select(F.col("record_id").alias("cand_id"), "s1_id", "r_rank"), ["s1_id", "cand_id"], "left")
    known = F.col("own").isNotNull()
    variants = {"own": known, "with_reverse_3": known | (F.col("r_rank") <= 3), "with_reverse_5": known | (F.col("r_rank") <= 5)}
    n = t.groupBy("s1_id").agg(*[F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias(v) for v, c in variants.items()])
    e = tables.known_matches(s, d).select(F.col("source1_entity_id").alias("s1_id"), F.size(tables.id_list("matched_entity_ids")).alias("n_true")).join(n, "s1_id", "left").na.fill(0, list(variants))
    long = e.unpivot(["n_true"], list(variants), "variant", "n_pred")
    return long.groupBy("variant").agg(F.round(F.avg(evaluation.f05(F.col("n_true"), F.col("n_pred"), F.col("n_pred"))), 6).alias("macro_f05"))


@query(f"""with {REV}, best as (select record_id, max(r_score) as v from rev group by 1), l as (select v, case when t.cand_id is null then 0 else 1 end as label from best left join (select distinct cand_id from truth) t on t.cand_id = record_id),
    c as (select v, sum(label) as pos, sum(1 - label) as neg from l group by 1), w as (select pos, neg, pos * (sum(neg) over (order by v) - neg + neg / 2) as wins from c) select sum(pos)::bigint as positives, sum(neg)::bigint as negatives, round(sum(wins) / nullif(sum(pos) * sum(neg), 0), 6) as auc from w""")
def rev_distractors(s, d):
    """How well the best score of a record tells records with a known owner from the others."""
    best = _reverse(s, d).groupBy("record_id").agg(F.max("r_score").alias("v"))
    owned = _truth(s, d).select(F.col("cand_id").alias("record_id"), F.lit(1).alias("hit")).distinct()
    return evaluation.rank_auc(best.join(owned, "record_id", "left").withColumn("label", F.coalesce("hit", F.lit(0))), "v", "label")


# ------------------------------------------------------------------ features


@query(f"""with {FEAT.split(', f0 as')[0]}, corpus as (select addr as text from pooln where addr <> ''), texts as (select distinct text from (select addr_s as text from pairs union all select addr_c from pairs)),
    gc as ({_GRAM.format(Q.toks('text'), 'corpus')}), gt as ({_GRAM.format(Q.toks('text'), 'texts')}), df as (select gram, count(distinct text) as df from gc group by gram having count(distinct text) >= 2),
    w as (select text, gram, count(*) * (ln((1 + (select count(distinct text) from corpus)) / (1 + any_value(df))) + 1) as w from gt join df using (gram) group by text, gram), n as (select text, gram, w / sqrt(sum(w * w) over (partition by text)) as w from w),
    dots as (select a, b, sum(x.w * y.w) as c from (select distinct addr_s as a, addr_c as b from pairs) join n x on x.text = a join n y on y.text = b and y.gram = x.gram group by a, b)
    select s1_id, cand_id, case when addr_c <> '' then round(coalesce(c, 0), 6) end as addr_tfidf from pairs left join dots on a = addr_s and b = addr_c""")
def feat_tfidf_address(s, d):
    pairs = materialize(_pairs(s, d).select("s1_id", "cand_id", "addr_s", "addr_c"), "pairs")
    made = features.tfidf_cosine(pairs, "addr_s", "addr_c", _norm(_pool(s, d)).where("addr <> ''").select(F.col("addr").alias("text")))
    return made.select("s1_id", "cand_id", F.when(F.col("addr_c") != "", F.round("cosine", 6)).alias("addr_tfidf"))


_TABLE = {"name_jaccard": _jac("ns", "nc"), "addr_jaccard": _jac("as_", "ac"), "core_jaccard": _jac("ks", "kc"), "num_jaccard": _jac("ds", "dc"), "score_all": "score_all", "block_rank": "block_rank"}


@query(f"""with {FEAT}, l as (select {', '.join(f'round(({v})::double, 9) as {k}' for k, v in _TABLE.items())}, (t.cand_id is not null)::int as label from f1 left join truth t using (s1_id, cand_id)) {_AUC.format(', '.join(_TABLE)).split('select feature, sum(pos)')[0].rstrip()},
    a as (select feature, sum(wins) / nullif(sum(pos) * sum(neg), 0) as auc from w group by feature), i as (select feature, value, label from l unpivot include nulls (value for feature in ({', '.join(_TABLE)}))),
    mm as (select feature, round(100 * avg((value is null)::int), 4) as missing_percent, round(avg(case when label = 1 then value end), 4) as mean_true, round(avg(case when label = 0 then value end), 4) as mean_false from i group by feature)
    select feature, round(auc, 6) as auc, case when auc >= 0.5 then 'higher = match' else 'lower = match' end as direction, round(abs(round(auc, 6) - 0.5) * 2, 6) as separation, missing_percent, mean_true, mean_false from a join mm using (feature)""")
def feat_table(s, d):
    """Each feature by itself: AUC, its direction and separation, share of unknown values, means of both classes."""
    f = _labelled(features.set_features(_pairs(s, d)).select("s1_id", "cand_id", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in _TABLE]), s, d)
    return evaluation.feature_table(f, list(_TABLE))


@query(f"""with {FEAT}, v as (select s1_id, cand_id, coalesce({_jac('ns', 'nc')}, 0) as name, coalesce({_jac('as_', 'ac')}, 0) as address, coalesce({_jac('ds', 'dc')}, 0) as number from f1)
    select s1_id, cand_id, case when name >= address and name >= number then 'name' when address >= number then 'address' else 'number' end as best_field from v""")
def feat_best_field(s, d):
    """The field that a pair agrees in most; of equal ones the first."""
    f = features.set_features(_pairs(s, d)).select("s1_id", "cand_id", *[F.coalesce(F.col(c), F.lit(0.0)).alias(n) for n, c in (("name", "name_jaccard"), ("address", "addr_jaccard"), ("number", "num_jaccard"))])
    order = F.array_sort(F.array(*[F.struct((-F.col(c)).alias("v"), F.lit(i).alias("i"), F.lit(c).alias("field")) for i, c in enumerate(("name", "address", "number"))]))
    return f.select("s1_id", "cand_id", order[0]["field"].alias("best_field"))


# ------------------------------------------------------------------ errors

_LISTED = "where p.s1_id in (select source1_entity_id from m)"


@query(f"""with {OWNED}, o as (select cand_id, min(s1_id) as owner from truth group by 1), l as (select p.s1_id, p.cand_id, t.cand_id is not null as hit, w.cand_id is not null as chosen, o.owner from scored p left join truth t using (s1_id, cand_id) left join owned w using (s1_id, cand_id) left join o on o.cand_id = p.cand_id {_LISTED})
    select case when hit and not chosen then 'FN' when not hit and chosen then 'FP' when hit then 'ok' else 'rejected' end as error, case when owner is null then 'nobody' when owner = s1_id then 'this' else 'another' end as owner, count(*) as n from l group by 1, 2""")
def eval_error_labels(s, d):
    """Pairs judged wrongly and rightly, by whom the record belongs to."""
    known = tables.known_matches(s, d).select(F.col("source1_entity_id").alias("s1_id"))
    return evaluation.error_labels(_scored(s, d).join(known, "s1_id", "left_semi"), _owned(s, d), _truth(s, d)).groupBy("error", "owner").agg(F.count("*").alias("n"))


@query(f"""with {OWNED}, x as (select t.*, c.cand_id is not null as candidate, w.cand_id is not null as chosen, s.name as ns, p.name as nc, p.addr as ac from truth t left join cand c using (s1_id, cand_id) left join owned w using (s1_id, cand_id) join s1n s on s.entity_id = t.s1_id join pooln p on p.entity_id = t.cand_id)
    select case when chosen then 'found' when candidate then 'missed' else 'no_candidate' end as outcome, case when ac = '' then 'no_address' when regexp_matches(nc, '[ऀ-ൿ]') then 'other_script' when len(list_intersect({Q.toks('ns')}, {Q.toks('nc')})) = 0 then 'no_shared_word' else 'other' end as reason, count(*) as n from x group by 1, 2""")
def eval_miss_reasons(s, d):
    """True pairs by what became of them, and the first reason that may explain a miss."""
    p = features.with_texts(_truth(s, d), _norm(_s1(s, d)), _norm(_pool(s, d)))
    flag = lambda df, n: df.select("s1_id", "cand_id", F.lit(True).alias(n))
    p = p.join(flag(_candidates(s, d), "candidate"), ["s1_id", "cand_id"], "left").join(flag(_owned(s, d), "chosen"), ["s1_id", "cand_id"], "left")
    outcome = F.when(F.col("chosen"), "found").when(F.col("candidate"), "missed").otherwise("no_candidate")
    reason = F.when(F.col("addr_c") == "", "no_address").when(F.col("name_c").rlike(T.INDIC), "other_script").when(~F.arrays_overlap(T.tokens(F.col("name_s")), T.tokens(F.col("name_c"))), "no_shared_word").otherwise("other")
    return p.groupBy(outcome.alias("outcome"), reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"""with {OWNED}, sh as (select t.s1_id, t.cand_id, count(*) as n, max((split_part(k.key, '|', 2) in ('nw', 'nb', 'nj'))::int) as by_name, max((split_part(k.key, '|', 2) in ('aw', 'ab'))::int) as by_addr from truth t join k1 k on k.entity_id = t.s1_id join kp p on p.entity_id = t.cand_id and p.key = k.key group by 1, 2),
    x as (select t.*, (c.cand_id is not null) as found, coalesce(n, 0) as n, coalesce(by_name, 0) as by_name, coalesce(by_addr, 0) as by_addr, p.addr as ac, t.cand_id like 'S3%' as s3 from truth t left join cand c using (s1_id, cand_id) left join sh using (s1_id, cand_id) join pooln p on p.entity_id = t.cand_id)
    select found, count(*) as pairs, round(avg((n = 0)::int), 6) as no_shared_key, round(1 - avg(by_name), 6) as no_name_key, round(1 - avg(by_addr), 6) as no_address_key, round(avg((ac = '')::int), 6) as empty_address, round(avg(s3::int), 6) as from_source3, median(n)::double as median_keys from x group by found""")
def eval_missed_profile(s, d):
    """True pairs that the blocking found and missed: shared keys of either kind and what the record lacks."""
    k1, kp = keys.record_keys(_norm(_s1(s, d))), keys.record_keys(_norm(_pool(s, d)))
    kind = F.split("key", r"\|")[1]
    shared = _truth(s, d).join(k1.select(F.col("entity_id").alias("s1_id"), "key"), "s1_id").join(kp.select(F.col("entity_id").alias("cand_id"), "key"), ["cand_id", "key"])
    shared = shared.groupBy("s1_id", "cand_id").agg(F.count("*").alias("n"), F.max(kind.isin("nw", "nb", "nj").cast("int")).alias("by_name"), F.max(kind.isin("aw", "ab").cast("int")).alias("by_addr"))
    found = _candidates(s, d).select("s1_id", "cand_id", F.lit(True).alias("found"))
    x = _truth(s, d).join(found, ["s1_id", "cand_id"], "left").join(shared, ["s1_id", "cand_id"], "left").join(_norm(_pool(s, d)).select(F.col("entity_id").alias("cand_id"), "addr"), "cand_id")
    x = x.withColumn("found", F.coalesce("found", F.lit(False))).na.fill(0, ["n", "by_name", "by_addr"])
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return x.groupBy("found").agg(
        F.count("*").alias("pairs"), share(F.col("n") == 0).alias("no_shared_key"), F.round(1 - F.avg("by_name"), 6).alias("no_name_key"), F.round(1 - F.avg("by_addr"), 6).alias("no_address_key"),
        share(F.col("addr") == "").alias("empty_address"), share(F.col("cand_id").startswith("S3")).alias("from_source3"), F.percentile("n", F.lit(0.5)).alias("median_keys"),
    )


@query(f"""with {OWNED} {_entity_sql('owned')}, miss as (select t.s1_id, count(*) as n from truth t left join cand c using (s1_id, cand_id) where c.cand_id is null group by 1), e as (select ent.*, coalesce(n, 0) as unreached from ent left join miss on s1_id = source1_entity_id),
    v as (select 'as_is' as variant, n_true, n_pred, n_correct from e union all select 'no_false_merges', n_true, n_correct, n_correct from e union all select 'no_misses_among_candidates', n_true, n_pred + (n_true - unreached - n_correct), n_true - unreached from e union all select 'no_blocking_misses', n_true, n_pred + unreached, n_correct + unreached from e)
    select variant, round(avg({F05}), 6) as macro_f05 from v group by variant""")
def eval_error_cost_parts(s, d):
    """What each kind of error costs: the score if it alone were mended."""
    missed = _truth(s, d).join(_candidates(s, d), ["s1_id", "cand_id"], "left_anti").groupBy(F.col("s1_id").alias("source1_entity_id")).agg(F.count("*").alias("unreached"))
    e = evaluation.score_per_entity(tables.known_matches(s, d), decision.to_lists(_owned(s, d))).join(missed, "source1_entity_id", "left").na.fill(0, ["unreached"])
    t, p, c, u = F.col("n_true"), F.col("n_pred"), F.col("n_correct"), F.col("unreached")
    variants = {"as_is": (p, c), "no_false_merges": (c, c), "no_misses_among_candidates": (p + t - u - c, t - u), "no_blocking_misses": (p + u, c + u)}
    v = e.select("n_true", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), x.cast("long").alias("p"), y.cast("long").alias("c")) for n, (x, y) in variants.items()])).alias("v"))
    return v.groupBy("v.variant").agg(F.round(F.avg(evaluation.f05(t, F.col("v.p"), F.col("v.c"))), 6).alias("macro_f05"))


@query(f"""with {Q.RECORDS}, per as (select source1_entity_id, list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '') as ids from m), n as (select len(list_distinct(ids)) as t, len(list_distinct(ids[1:(len(ids) + 1) // 2])) as half from per),
    v as (select 'perfect' as prediction, t as n_true, t as n_pred, t as n_correct from n union all select 'nothing', t, 0, 0 from n union all select 'first_half', t, half, half from n union all select 'one_wrong', t, t + 1, t from n) select prediction, round(avg({F05}), 6) as macro_f05, sum(n_pred)::bigint as n_pred from v group by 1""")
def eval_fake_predictions(s, d):
    """Scores of predictions made from the truth: as it is, empty, its first half, with one wrong id more."""
    truth = tables.known_matches(s, d)
    ids = tables.id_list("matched_entity_ids")
    made = {"perfect": ids, "nothing": F.array().cast("array<string>"), "first_half": F.slice(ids, F.lit(1), F.ceil(F.size(ids) / 2).cast("int")), "one_wrong": F.concat(ids, F.array(F.lit("S2-none")))}
    parts = [evaluation.score_per_entity(truth, truth.select("source1_entity_id", F.array_join(v, ",").alias("matched_entity_ids"))).withColumn("prediction", F.lit(k)) for k, v in made.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("prediction").agg(F.round(F.avg("f05"), 6).alias("macro_f05"), F.sum("n_pred").alias("n_pred"))


@query(f"""with {Q.NORMAL}, per as (select m.source1_entity_id as s1_id, count(distinct t.cand_id) as n_true from m left join truth t on t.s1_id = m.source1_entity_id group by 1), j as (select s.entity_id as s1_id, p.entity_id as cand_id, 'same_name' as baseline from s1n s join pooln p using (country, name) where s.name <> ''
    union all select s.entity_id, p.entity_id, 'same_address' from s1n s join pooln p using (country, addr) where s.addr <> '' union all select s.entity_id, p.entity_id, 'same_both' from s1n s join pooln p using (country, name, addr) where s.name <> '' and s.addr <> ''),
    h as (select baseline, j.s1_id, count(*) as n_pred, sum((t.cand_id is not null)::int) as n_correct from j left join truth t using (s1_id, cand_id) group by 1, 2), e as (select b.baseline, per.s1_id, n_true, coalesce(n_pred, 0) as n_pred, coalesce(n_correct, 0) as n_correct from per cross join (select unnest(['same_name', 'same_address', 'same_both']) as baseline) b left join h on h.s1_id = per.s1_id and h.baseline = b.baseline)
    select baseline, round(avg({F05}), 6) as macro_f05, sum(n_pred)::bigint as n_pred, sum(n_correct)::bigint as n_correct from e group by 1""")
def eval_baselines(s, d):
    """Scores of the simplest rules: equal names, equal addresses, both."""
    a, b, truth = _norm(_s1(s, d)).withColumnRenamed("entity_id", "s1_id"), _norm(_pool(s, d)).withColumnRenamed("entity_id", "cand_id"), tables.known_matches(s, d)
    a = a.join(truth.select(F.col("source1_entity_id").alias("s1_id")), "s1_id", "left_semi")
    rules = {"same_name": ["name"], "same_address": ["addr"], "same_both": ["name", "addr"]}
    parts = []
    for n, cols in rules.items():
        some = reduce(lambda x, y: x & y, [F.col(c) != "" for c in cols])
        pairs = a.where(some).select("s1_id", "country", *cols).join(b.select("cand_id", "country", *cols), ["country", *cols]).select("s1_id", "cand_id")
        parts.append(evaluation.score_per_entity(truth, decision.to_lists(pairs)).withColumn("baseline", F.lit(n)))
    return reduce(DataFrame.unionByName, parts).groupBy("baseline").agg(F.round(F.avg("f05"), 6).alias("macro_f05"), F.sum("n_pred").alias("n_pred"), F.sum("n_correct").alias("n_correct"))


@query(f"""with {SCORED} select case when probability <= 0.2 then '[0.0, 0.2]' when probability <= 0.4 then '(0.2, 0.4]' when probability <= 0.6 then '(0.4, 0.6]' when probability <= 0.8 then '(0.6, 0.8]' else '(0.8, 1.0]' end as bucket, count(*) as n, round(avg(probability), 6) as mean_probability from scored group by 1""")
def eval_buckets(s, d):
    """Pairs by probability in buckets that hold their upper edge; the first one holds its lower edge too."""
    return _scored(s, d).groupBy(evaluation.buckets(F.col("probability"), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("probability"), 6).alias("mean_probability"))


_FINE = [round(0.2 + 0.05 * i, 2) for i in range(16)]


@query(f"""with {SCORED}, grid as (select unnest({_FINE}) as threshold), per as (select m.source1_entity_id as s1_id, count(distinct t.cand_id) as n_true from m left join truth t on t.s1_id = m.source1_entity_id group by 1),
    h as (select threshold, p.s1_id, count(*) as n_pred, sum((t.cand_id is not null)::int) as n_correct from scored p join grid on probability >= threshold left join truth t using (s1_id, cand_id) group by 1, 2),
    e as (select g.threshold, per.s1_id, n_true, coalesce(n_pred, 0) as n_pred, coalesce(n_correct, 0) as n_correct from per cross join grid g left join h on h.s1_id = per.s1_id and h.threshold = g.threshold), f as (select threshold::double as threshold, round(avg({F05}), 6) as macro_f05 from e group by threshold)
    select threshold, macro_f05 from f order by macro_f05 desc, threshold limit 1""")
def dec_best_threshold(s, d):
    """The threshold with the greatest macro F0.5 over the fine grid; of equal ones the first."""
    return evaluation.best_threshold(evaluation.threshold_sweep(tables.known_matches(s, d), _scored(s, d), _FINE)).select("threshold", "macro_f05")


@query()
def dec_expected_grid(s, d):
    """Expected-F0.5 decisions for several shares of true pairs that the blocking misses."""
    scored, truth = materialize(_scored(s, d), "scored"), tables.known_matches(s, d)
    parts = [evaluation.report(evaluation.score_per_entity(truth, decision.to_lists(decision.expected_f05(scored, m)))).select(F.lit(m).alias("missing_rate"), "macro_f05", "n_pred", "n_correct") for m in (0.0, 0.05, 0.1, 0.2)]
    return reduce(DataFrame.unionByName, parts)


@query(f"with {SCORED} select s1_id, cand_id, probability from scored order by probability desc, s1_id, cand_id limit 100")
def top_pairs(s, d):
    """The hundred most probable pairs of all."""
    return _scored(s, d).select("s1_id", "cand_id", "probability").orderBy(F.desc("probability"), "s1_id", "cand_id").limit(100)


# ------------------------------------------------------------------ profiles


@query("""select 'train_source' || n as file, median(length(business_name))::double as name_length, median(length(business_address))::double as address_length, min(length(business_name))::bigint as shortest, max(length(business_name))::bigint as longest
    from (select 1 as n, * from train_source1 union all select 2, * from train_source2 union all select 3, * from train_source3) group by n""")
def eda_lengths(s, d):
    parts = []
    for i in (1, 2, 3):
        n, a = F.length("business_name"), F.length("business_address")
        parts.append(tables.table(s, d, f"train_source{i}").agg(F.lit(f"train_source{i}").alias("file"), F.percentile(n, F.lit(0.5)).alias("name_length"), F.percentile(a, F.lit(0.5)).alias("address_length"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest")))
    return reduce(DataFrame.unionByName, parts)


@query(f"""with {SCORED} select count(*) as n, round(avg(probability), 6) as mean, round(stddev_samp(probability), 6) as std, min(probability) as least, round(quantile_cont(probability, 0.25), 6) as q25, round(median(probability), 6) as q50, round(quantile_cont(probability, 0.75), 6) as q75, max(probability) as most from scored""")
def eda_describe(s, d):
    p = F.col("probability")
    q = lambda x: F.round(F.percentile(p, F.lit(x)), 6)
    return _scored(s, d).agg(F.count(p).alias("n"), F.round(F.avg(p), 6).alias("mean"), F.round(F.stddev_samp(p), 6).alias("std"), F.min(p).alias("least"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max(p).alias("most"))


_BLOCKS = {"devanagari": 0x0900, "bengali": 0x0980, "gurmukhi": 0x0A00, "gujarati": 0x0A80, "oriya": 0x0B00, "tamil": 0x0B80, "telugu": 0x0C00, "kannada": 0x0C80, "malayalam": 0x0D00}
_SCRIPTS = {**{k: f"[{chr(v)}-{chr(v + 0x7F)}]" for k, v in _BLOCKS.items()}, "accented": "[À-ɏ]", "non_ascii": r"[^\x00-\x7F]"}


@query(f"with {Q.RECORDS} select country, count(*) as n, {', '.join(f'sum(regexp_matches(business_name, {chr(39)}{v}{chr(39)})::int)::bigint as {k}' for k, v in _SCRIPTS.items())} from pool group by country")
def eda_scripts(s, d):
    """Names that hold a letter of each script."""
    return _pool(s, d).groupBy("country").agg(F.count("*").alias("n"), *[F.sum(F.col("business_name").rlike(v).cast("int")).alias(k) for k, v in _SCRIPTS.items()])


@query(f"""with {Q.RECORDS}, c as (select substr(entity_id, 1, 2) as source, unnest(string_split(regexp_replace(business_name, '[\\p{{L}}\\p{{N}}\\p{{M}}\\s]', '', 'g'), '')) as sign from pool)
    select sign, count(*) filter (source = 'S2') as s2, count(*) filter (source = 'S3') as s3 from c where sign <> '' and ascii(sign) < 128 group by sign""")
def eda_punctuation(s, d):
    """How often each ASCII sign stands in names, by source."""
    signs = F.explode(F.split(F.regexp_replace("business_name", r"[\p{L}\p{N}\p{M}\s]", ""), "")).alias("sign")
    c = _pool(s, d).select(F.lower(F.substring("entity_id", 1, 2)).alias("source"), signs).where("sign <> '' and ascii(sign) < 128")
    return c.groupBy("sign").pivot("source", ["s2", "s3"]).count().na.fill(0)


@query(f"with {Q.RECORDS} select country, substr(entity_id, 1, 2) as source, count(*) as n, round(100 * avg(regexp_matches(business_name, '[0-9]')::int), 6) as percent from pool group by rollup(country, substr(entity_id, 1, 2))")
def eda_share_digits(s, d):
    """Percentage of names with a digit, per country and source and over all."""
    return profile.share_true(_pool(s, d).withColumn("source", F.substring("entity_id", 1, 2)), F.col("business_name").rlike("[0-9]"), ["country", "source"])


_SHORT = tuple(sorted(T.ADDRESS_WORDS))


@query(f"""with {TRUE_PAIRS}, f as (select list_distinct(list_filter(as_, lambda w: w in {_SHORT})) as a, list_distinct(list_filter(ac, lambda w: w in {_SHORT})) as b from te), x as (select unnest(list_distinct(list_concat(a, b))) as word, a, b from f)
    select word, sum(list_contains(a, word)::int)::bigint as in_reference, sum(list_contains(b, word)::int)::bigint as in_pool, sum((list_contains(a, word) and list_contains(b, word))::int)::bigint as in_both from x group by word""")
def eda_abbreviations(s, d):
    """On which side of known pairs the short forms of address words stand."""
    p = features.with_texts(_truth(s, d), _norm(_s1(s, d)), _norm(_pool(s, d)))
    some = lambda c: F.array_distinct(F.filter(T.tokens(F.col(c)), lambda w: w.isin(*_SHORT)))
    x = p.select(some("addr_s").alias("a"), some("addr_c").alias("b")).select("a", "b", F.explode(F.array_distinct(F.concat("a", "b"))).alias("word"))
    here = lambda c: F.array_contains(c, F.col("word"))
    return x.groupBy("word").agg(F.sum(here("a").cast("int")).alias("in_reference"), F.sum(here("b").cast("int")).alias("in_pool"), F.sum((here("a") & here("b")).cast("int")).alias("in_both"))


@query(f"""with {TRUE_PAIRS} select country, count(*) as n, round(100 * avg((len(list_distinct(ns)) = {_inter('ns', 'nc')})::int), 6) as name_inside, round(100 * avg((len(list_distinct(ns)) = len(list_distinct(nc)) and len(list_distinct(ns)) = {_inter('ns', 'nc')})::int), 6) as same_words,
    round(100 * avg((replace(name_s, ' ', '') = replace(name_c, ' ', ''))::int), 6) as same_joined, round(100 * avg((len(list_intersect(regexp_extract_all(addr_s, '([0-9]+)'), regexp_extract_all(addr_c, '([0-9]+)'))) > 0)::int), 6) as shared_number from te group by rollup(country)""")
def eda_evidence_more(s, d):
    """Further checks of known pairs: all words of the name inside the other, the same words, the same joined, a shared number."""
    p = features.with_texts(_truth(s, d), _norm(_s1(s, d)), _norm(_pool(s, d))).join(_s1(s, d).select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    a, b = F.array_distinct(T.tokens(F.col("name_s"))), F.array_distinct(T.tokens(F.col("name_c")))
    both, bare = F.size(F.array_intersect(a, b)), lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    digits = lambda c: F.regexp_extract_all(F.col(c), F.lit("([0-9]+)"), 1)
    checks = {"name_inside": F.size(a) == both, "same_words": (F.size(a) == both) & (F.size(b) == both), "same_joined": bare("name_s") == bare("name_c"), "shared_number": F.arrays_overlap(digits("addr_s"), digits("addr_c"))}
    p = p.select("country", *[v.cast("int").alias(k) for k, v in checks.items()])
    return p.rollup("country").agg(F.count("*").alias("n"), *[F.round(100 * F.avg(k), 6).alias(k) for k in checks])


@query(f"""with {TRUE_PAIRS} select case when regexp_matches(name_c, '[ऀ-ൿ]') then 'other_script' when replace(name_s, ' ', '') = replace(name_c, ' ', '') then 'run_together' when len(nc) = 1 then 'one_word' else 'other' end as reason, count(*) as n from te where {_inter('ns', 'nc')} = 0 group by 1""")
def eda_no_shared_word(s, d):
    """Why known pairs share no word of the name."""
    p = features.with_texts(_truth(s, d), _norm(_s1(s, d)), _norm(_pool(s, d)))
    a, b = T.tokens(F.col("name_s")), T.tokens(F.col("name_c"))
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    reason = F.when(F.col("name_c").rlike(T.INDIC), "other_script").when(bare("name_s") == bare("name_c"), "run_together").when(F.size(b) == 1, "one_word").otherwise("other")
    return p.where(F.size(F.array_intersect(a, b)) == 0).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
