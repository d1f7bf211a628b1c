"""Features of candidate pairs. Unknown values are null; counts and flags are integers."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ligature.functions.similarity import RATIOS, all_ratios, dice, jaccard, mean_known, overlap
from ligature.functions.text import INDIC, LEGAL_CANONICAL, LEGAL_WORDS, tokens
from ligature.operators.keys import core_words
from ligature.operators.reverse import reverse_features
from ligature.workspace import materialize, scatter


#: The pair features of a model in their order: all, and those beyond the first design.
FEATURES = (
    "name_exact", "name_jaccard", "name_ratio", "name_token_sort", "name_token_set", "core_ratio", "core_token_set", "core_partial", "core_joined_ratio", "name_tfidf", "name_len_diff", "name_c_foreign",
    "legal_same", "legal_conflict", "legal_one_missing", "addr_c_empty", "addr_jaccard", "addr_ratio", "addr_token_set", "addr_token_sort", "addr_tfidf", "num_shared", "num_jaccard", "num_conflict", "num_c_subset",
    "score_all", "score_name", "score_addr", "block_rank", "block_score_rel", "n_candidates", "name_token_set_rel", "addr_token_set_rel", "is_source3",
)
TFIDF = ("name_tfidf", "addr_tfidf")
EXTRA = ("name_dice", "name_overlap", "core_exact", "core_jaccard", "name_len_ratio", "addr_dice", "addr_overlap", "addr_len_ratio", "num_exact_match", "num_diff_count")
REVERSE = ("r_rank", "r_score", "r_best_other", "r_gap")


def feature_names(tfidf: bool = True, extra: bool = False, reverse: bool = False) -> list[str]:
    """34 features, 32 without tf-idf, 10 more with ``extra``, 4 more with ``reverse``."""
    return [f for f in FEATURES if tfidf or f not in TFIDF] + list(EXTRA if extra else ()) + list(REVERSE if reverse else ())


def pair_vector(pairs: DataFrame, reference: DataFrame, pool: DataFrame, table: DataFrame | None = None, tfidf: bool = False) -> DataFrame:
    """Candidates with their texts and all features; ``pool`` has name_foreign of the raw names, ``table`` is the reverse index."""
    out = block_features(pairs)
    if table is not None:
        out = reverse_features(out, table)
    out = with_texts(out, reference, pool)
    out = ratio_features(scatter(set_features(out), "s1_id", "cand_id"))
    out = out.drop("name_c_foreign").join(pool.select(F.col("entity_id").alias("cand_id"), F.col("name_foreign").alias("name_c_foreign")).hint("merge"), "cand_id")
    if tfidf:
        out = materialize(out, "pair-features")
        for kind in ("name", "addr"):
            out = tfidf_cosine(out, f"{kind}_s", f"{kind}_c", pool.where(F.col(kind) != "").select(F.col(kind).alias("text"))).withColumnRenamed("cosine", f"{kind}_tfidf")
        out = out.withColumn("addr_tfidf", F.when(F.col("addr_c") != "", F.col("addr_tfidf")))
    return out


def with_texts(pairs: DataFrame, reference: DataFrame, pool: DataFrame) -> DataFrame:
    """Candidate pairs with name_s, addr_s, name_c, addr_c; texts are fetched after ranking, for kept pairs only."""
    s = reference.select(F.col("entity_id").alias("s1_id"), F.col("name").alias("name_s"), F.col("addr").alias("addr_s"))
    c = pool.select(F.col("entity_id").alias("cand_id"), F.col("name").alias("name_c"), F.col("addr").alias("addr_c"))
    return pairs.join(s.hint("merge"), "s1_id").join(c.hint("merge"), "cand_id")


def _flag(c: Column) -> Column:
    return c.cast("int")


def _legal(words: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LEGAL_CANONICAL.items() for x in pair])
    full = F.transform(words, lambda w: F.coalesce(table[w], w))
    return F.array_distinct(F.filter(full, lambda w: w.isin(*LEGAL_WORDS)))


def _numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)(\d+)"), 1))


def _length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def set_features(pairs: DataFrame) -> DataFrame:
    """Features of pairs with texts that need no string distance."""
    c = F.col
    ns, nc, as_, ac = tokens(c("name_s")), tokens(c("name_c")), tokens(c("addr_s")), tokens(c("addr_c"))
    base = pairs.withColumns({"ns": ns, "nc": nc, "as": as_, "ac": ac})
    base = base.withColumns({"ks": core_words(c("ns")), "kc": core_words(c("nc")), "ls": _legal(c("ns")), "lc": _legal(c("nc")), "ds": _numbers(c("addr_s")), "dc": _numbers(c("addr_c"))})
    has = c("addr_c") != ""
    both_legal = (F.size("ls") > 0) & (F.size("lc") > 0)
    both_num = (F.size("ds") > 0) & (F.size("dc") > 0)
    same_legal = F.size(F.array_except("ls", "lc")) + F.size(F.array_except("lc", "ls")) == 0
    same_num = F.size(F.array_except("ds", "dc")) + F.size(F.array_except("dc", "ds"))
    out = {
        "name_exact": _flag(c("name_s") == c("name_c")), "core_exact": _flag(F.array_join("ks", " ") == F.array_join("kc", " ")),
        "name_jaccard": jaccard(c("ns"), c("nc")), "addr_jaccard": jaccard(c("as"), c("ac")), "core_jaccard": jaccard(c("ks"), c("kc")),
        "name_dice": dice(c("ns"), c("nc")), "addr_dice": F.when(has, dice(c("as"), c("ac"))),
        "name_overlap": overlap(c("ns"), c("nc")), "addr_overlap": F.when(has, overlap(c("as"), c("ac"))),
        "name_len_diff": F.abs(F.length("name_s") - F.length("name_c")), "name_len_ratio": _length_ratio(c("name_s"), c("name_c")),
        "addr_len_ratio": F.when(has, _length_ratio(c("addr_s"), c("addr_c"))), "addr_c_empty": _flag(~has),
        "legal_same": _flag(both_legal & same_legal), "legal_conflict": _flag(both_legal & ~F.arrays_overlap("ls", "lc")),
        "legal_one_missing": _flag((F.size("ls") > 0) != (F.size("lc") > 0)),
        "num_shared": F.size(F.array_intersect("ds", "dc")), "num_jaccard": jaccard(c("ds"), c("dc")), "num_conflict": _flag(both_num & ~F.arrays_overlap("ds", "dc")),
        "num_c_subset": _flag((F.size("dc") > 0) & (F.size(F.array_except("dc", "ds")) == 0)), "num_exact_match": _flag((F.size("ds") > 0) & (same_num == 0)), "num_diff_count": same_num,
        "name_c_foreign": _flag(c("name_c").rlike(INDIC)), "is_source3": _flag(c("cand_id").startswith("S3")),
    }
    out["rule_score"] = mean_known(out["name_jaccard"], out["addr_jaccard"])
    return base.withColumns(out).drop("ns", "nc", "as", "ac", "ks", "kc", "ls", "lc", "ds", "dc")


def block_features(pairs: DataFrame) -> DataFrame:
    """Place, share of the best score and number of candidates within the entity."""
    w = Window.partitionBy("s1_id")
    place = F.row_number().over(w.orderBy(F.desc("score_all"), "cand_id"))
    best = F.max("score_all").over(w)
    return pairs.withColumns({"block_rank": place, "block_score_rel": F.when(best > 0, F.col("score_all") / best), "n_candidates": F.count("*").over(w)})


def ratio_features(pairs: DataFrame) -> DataFrame:
    """Ratios by longest common subsequence; addresses are unknown if the candidate's is empty."""
    c = F.col
    core_s, core_c = F.array_join(core_words(tokens(c("name_s"))), " "), F.array_join(core_words(tokens(c("name_c"))), " ")
    base = pairs.withColumns({"core_s": core_s, "core_c": core_c, "known_s": F.when(c("addr_c") != "", c("addr_s")), "known_c": F.when(c("addr_c") != "", c("addr_c"))})
    # one pass over the batches for all ratios
    made = all_ratios("name_s", "name_c", "core_s", "core_c", "known_s", "known_c")
    out = base.withColumn("made", made).withColumns({n: c(f"made.{n}") for n in RATIOS}).drop("made")
    w = Window.partitionBy("s1_id")
    rel = {"name_token_set_rel": c("name_token_set") - F.max("name_token_set").over(w), "addr_token_set_rel": F.coalesce("addr_token_set", F.lit(0.0)) - F.coalesce(F.max("addr_token_set").over(w), F.lit(0.0))}
    return out.withColumns(rel).drop("core_s", "core_c", "known_s", "known_c")


#: Letter trigrams that are sent to the tasks at most, some hundred bytes each in Python.
MOST_GRAMS = 300_000


def _words(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))


def tfidf_cosine(pairs: DataFrame, a: str, b: str, corpus: DataFrame, least_df: int = 2, most_grams: int = MOST_GRAMS) -> DataFrame:
    """``pairs`` with the cosine of two texts under the weights of ``gram_weights``, 0 if nothing is shared.

    The grams of all texts together are few, so their idf goes to the tasks, texts are cut there, and nothing is
    shuffled but counts of grams. Should there be more than ``most_grams``, weights and pairs are joined.
    """
    spark = pairs.sparkSession
    texts = corpus.select("text").distinct()
    cut = F.flatten(F.transform(_words(F.col("text")), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3)))))
    df = texts.select(F.explode(F.array_distinct(cut)).alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") >= least_df)
    df = materialize(df, "gram-counts")
    if df.count() > most_grams:
        both = pairs.select(F.col(a).alias("text")).unionByName(pairs.select(F.col(b).alias("text")))
        return cosine(pairs, a, b, materialize(gram_weights(both, corpus, least_df), "gram-weights"))
    n = texts.count()
    rows = df.toArrow()
    idf = spark.sparkContext.broadcast({g: math.log((1 + n) / (1 + k)) + 1 for g, k in zip(rows["gram"].to_pylist(), rows["df"].to_pylist(), strict=True)})

    @F.pandas_udf("double")
    def likeness(x: pd.Series, y: pd.Series) -> pd.Series:
        known, seen, out = idf.value, {}, []

        def weights(text: str | None) -> dict[str, float]:
            if text not in seen:
                tf: dict[str, int] = {}
                for w in (text or "").split(" "):
                    if w:
                        w = f" {w} "
                        for i in range(len(w) - 2):
                            if (g := w[i : i + 3]) in known:
                                tf[g] = tf.get(g, 0) + 1
                made = {g: k * known[g] for g, k in tf.items()}
                norm = math.sqrt(math.fsum(v * v for v in made.values()))
                seen[text] = {g: v / norm for g, v in made.items()}
            return seen[text]

        for s, t in zip(x, y, strict=True):
            p, q = weights(s), weights(t)
            out.append(math.fsum(v * q[g] for g, v in p.items() if g in q))
        return pd.Series(out, dtype="float64")

    return pairs.withColumn("cosine", likeness(a, b))


def gram_weights(texts: DataFrame, corpus: DataFrame, least_df: int = 2) -> DataFrame:
    """(text, gram, weight): L2-normalised tf-idf of letter trigrams of words padded by a blank.

    ``texts`` and ``corpus`` have one column text; idf is ln((1 + n) / (1 + df)) + 1 over the corpus' distinct
    texts. Grams in fewer than ``least_df`` texts count for nothing.
    """
    def grams(df: DataFrame) -> DataFrame:
        words = df.select("text").distinct().select("text", F.explode(tokens(F.col("text"))).alias("w")).withColumn("w", F.concat(F.lit(" "), "w", F.lit(" ")))
        return words.select("text", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substr(F.col("w"), i, F.lit(3)))).alias("gram")).groupBy("text", "gram").agg(F.count("*").alias("tf"))

    n = corpus.select("text").distinct().count()
    df = grams(corpus).groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") >= least_df)
    w = grams(texts).join(df, "gram").withColumn("w", F.col("tf") * (F.log((1 + F.lit(float(n))) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("text")))
    return w.select("text", "gram", (F.col("w") / norm).alias("weight"))


def cosine(pairs: DataFrame, a: str, b: str, weights: DataFrame) -> DataFrame:
    """``pairs`` (distinct a, b) with the cosine of their texts, 0 if nothing is shared."""
    x = weights.select(F.col("text").alias(a), "gram", F.col("weight").alias("wa"))
    y = weights.select(F.col("text").alias(b), "gram", F.col("weight").alias("wb"))
    dots = pairs.select(a, b).distinct().join(x, a).join(y, [b, "gram"]).groupBy(a, b).agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return pairs.join(dots, [a, b], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
