import random
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from ligature.llm import encoding, gazetteer, leaks, lookalike, matching, metric, names, places, quality, terms, topn, variants


# ------------------------------------------------------------------ 6: top N


def test_top_n_against_sorting(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 5) if rng.random() < 0.6 else 7, rng.randint(0, 60), rng.choice([0.5, 1.0, 1.5, float("inf"), float("-inf")]), "x") for _ in range(3000)]
    rows += [(None, 1, 1.0, "x"), (1, None, 1.0, "x"), (1, 900, None, "x"), (1, 901, float("nan"), "x")]
    df = spark.createDataFrame(rows, "g long, i long, score double, s string").repartition(7)
    best = {}
    for g, i, s, _ in rows:
        if None not in (g, i, s) and s == s:
            best[g, i] = max(s, best.get((g, i), float("-inf")))
    wanted = set()
    for g in {k[0] for k in best}:
        items = sorted((-s, i) for (h, i), s in best.items() if h == g)[:10]
        wanted |= {(g, i) for _, i in items}
    got = [(r.g, r.i) for r in topn.top_n(df, "g", "i", "score", 10, state_rows=40).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    assert topn.top_n(df.where("g > 99"), "g", "i", "score").count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df, "g", "i", "score", 0)


# ------------------------------------------------------------------ 2: terms


def test_ngrams_against_counting(spark):
    rows = [("a", "The the fox", None), ("b", "", "x y x"), ("c", None, "x"), ("c", None, "x"), (None, "the", "x"), ("d", "ÉTÉ 12", "x y " * 300), ("e", "the fox the fox", "")]
    df = spark.createDataFrame(rows, "entity_id string, name string, suffix string")
    for n, hot in ((1, 10**6), (3, 2)):
        got = {(r.field, tuple(r.terms)): (r.occurrences, r.records) for r in terms.ngram_frequencies(df, "entity_id", ["name", "suffix"], n, hot).collect()}
        occ, rec = Counter(), defaultdict(set)
        for k, a, b in dict.fromkeys(r for r in rows if r[0]):
            for f, t in (("name", a), ("suffix", b)):
                w = (t or "").lower().split()
                for i in range(len(w)):
                    for j in range(i + 1, min(i + n, len(w)) + 1):
                        occ[f, tuple(w[i:j])] += 1
                        rec[f, tuple(w[i:j])].add(k)
        assert got == {k: (v, len(rec[k])) for k, v in occ.items()}
    marks = {(r.field, r.term): r.mark for r in terms.marked_terms(df, "entity_id", ["name"], common_share=0.3).collect()}
    assert marks["name", "été"] == "rare" and marks["name", "the"] == "common"
    assert terms.marked_terms(df.where("entity_id = 'z'"), "entity_id", ["name"]).count() == 0


# ------------------------------------------------------------------ 5: look-alikes


def test_lookalikes(spark):
    same = ["Caf\u00e9 ABC-d", "Cafe\u0301 ABC-d", "\uff23af\u00e9 ABC\u2011d", "Caf\u00e9\u00a0\u0410BC-d", "Ca\u200bf\u00e9 ABC-d", "C\u0430f\u0435\u0301 ABC-d"]
    other = ["Cafe ABC-d", "caf\u00e9 ABC-d", "Caf\u00e9 ABCd", "Caf\u00e8 ABC-d", "", "\ufb01x", "fix"]
    rows = [(f"k{i}", t, 1) for i, t in enumerate(same + other)] + [("k0", same[0], 2), ("n", None, 1), (None, same[0], 1), ("long", "x" * 5000, 1)]
    df = spark.createDataFrame(rows, "entity_id string, t string, form int")
    got = {(r.key_a, r.key_b) for r in lookalike.lookalike_pairs(df, "entity_id", "t").collect()}
    n = len(same)
    wanted = {tuple(sorted((f"k{a}", f"k{b}"))) for a in range(n) for b in range(n) if a < b} | {("k11", "k12")}
    assert got == wanted
    assert lookalike.lookalike_pairs(df.where("form = 9"), "entity_id", "t").count() == 0


def test_classes_are_transitive_and_rewriting_ends():
    table = lookalike.rewrite_table({"\uff25": 1, "\u0415": 2, "E": 9, "\u0401": 1, "\u0308": 1})
    r = lookalike.Rewriter(table)
    assert r("\uff25\u0415E") == "EEE" and r("\u0401") == r("E\u0308") == r("\u0415\u0308")


# ------------------------------------------------------------------ 7: encoding


@given(st.lists(st.text("ab'strevml 1\n\t .,éß\u3000九²", max_size=30), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_word_splitting(texts):
    import regex

    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    kept = [t for t in texts if t]
    if not kept:
        return
    points = np.frombuffer("".join(kept).encode("utf-32-le"), np.uint32)
    begins = np.cumsum([0, *map(len, kept)])[:-1]
    starts = [*encoding.split_words(points, begins).tolist(), len(points)]
    whole = "".join(kept)
    assert [whole[a:b] for a, b in zip(starts, starts[1:], strict=False)] == [w for t in kept for w in pattern.findall(t)]


def test_encode_and_decode(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = encoding.VOCABULARY.replace(".tiktoken", ".json")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = ["Hello  world's  \n\n end ", "", None, "<|endoftext|>", "naïve \U0001f600 日本", "a" * 3000 + " b", "Hello  world's  \n\n end "]
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encoding.encode(df, "doc_id", "text", block_chars=50).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    back = {r.doc_id: r.text for r in encoding.decode(encoding.encode(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back == {i: x or "" for i, x in enumerate(texts)}
    assert encoding.encode(df.where("doc_id > 99"), "doc_id", "text").count() == 0


# ------------------------------------------------------------------ 8: leaks

ITEM = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar"


def test_leaks(spark):
    w = ITEM.split()
    docs = {
        1: "x " + " ".join(w[:12]) + " y", 2: "x " + " ".join(w[:11]) + " y", 3: "\\emph{Alpha} bravo~\\cite{a,b} char-\nlie, {\\bf delta} echo\nfoxtrot gol\\-f hotel India juliett % note\nkilo lima",
        4: "% alpha bravo charlie delta echo foxtrot\n% golf hotel india juliett kilo lima\n", 5: "malpha " + " ".join(w[1:12]), 6: "", 7: None, 8: "z " * 4000 + ITEM,
    }
    corpus = spark.createDataFrame([(k, v, 1) for k, v in docs.items()] + [(1, docs[1], 2)], "doc_id long, text string, item int")
    items = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, ""), (5, "un d\u00e9tail cach\u00e9 dans une longue phrase que personne ne lit jamais vraiment"), (1, ITEM)], "item_id long, text string")
    got = [(r.item_id, r.doc_id) for r in leaks.leaked(corpus, "doc_id", "text", items, "item_id", "text").collect()]
    assert sorted(got) == [(1, 1), (1, 3), (1, 4), (1, 8)]
    tex = spark.createDataFrame([(9, "un d\\'etail cach{\\'e} dans une longue phrase que personne ne lit jamais \\textit{vraiment}")], "doc_id long, text string")
    assert leaks.leaked(tex, "doc_id", "text", items, "item_id", "text").count() == 1
    assert leaks.leaked(corpus, "doc_id", "text", items.where("item_id = 2"), "item_id", "text").count() == 0
    assert leaks.leaked(corpus.where("doc_id = 99"), "doc_id", "text", items, "item_id", "text").count() == 0


@given(st.integers(1, 9), st.integers(1, 9), st.data())
@settings(max_examples=100, deadline=None)
def test_winnowing_keeps_every_long_shared_span(k, w, data):
    draw = lambda n: data.draw(st.text("ab", min_size=n, max_size=n + 8))
    shared = draw(k + w - 1)
    a, b = draw(0) + shared + draw(0), draw(0) + shared + draw(0)
    kept = []
    for t in (a, b):
        h = leaks.hashes(np.frombuffer(t.encode("utf-32-le"), np.uint32), k)
        assert len(h) == len(t) - k + 1
        kept.append(set(h[leaks.winnow(h, w)].tolist()))
    assert kept[0] & kept[1]


# ------------------------------------------------------------------ 9: quality


def test_quality(spark):
    prose = "We show that the method of the authors is stable, and it follows that the results are the same in all of the cases.\n" * 1
    different = "".join(f"We show that the method number {i} of the authors is stable and that it follows the results of case {i}.\n" for i in range(12))
    docs = {
        1: different, 2: "\\begin{itemize}\n" + "".join(f"\\item spare part {i}\n" for i in range(40)) + "\\end{itemize}", 3: "\\begin{tabular}{ll}\n" + "".join(f"row & {i} & {i * 3.5} \\\\\n" for i in range(40)) + "\\end{tabular}",
        4: "null " * 400, 5: "", 6: None, 7: "  \n ", 8: prose, 9: "\\begin{equation}\n x^2 = y \\\\ z\n\\end{equation}\n" * 40 + prose, 10: different + "\\begin{thebibliography}{9}\n" + "\\bibitem{a} A. B, title, 1999.\n" * 90 + "\\end{thebibliography}",
    }
    df = spark.createDataFrame([(k, v, "x") for k, v in docs.items()], "doc_id long, text string, words string")
    got = {r.doc_id: r.kind for r in quality.no_prose(df, "doc_id", "text").collect()}
    assert got == {2: "list", 3: "table", 4: "junk"}
    s = quality.statistics(df, "doc_id", "text").withColumn("why", quality.reasons())
    rows = {r.doc_id: r for r in s.collect()}
    assert len(rows) == len(docs) and rows[6].words == 0 and rows[1].why == [] and "body_no_prose" in rows[4].why and "too_few_words" in rows[8].why
    assert quality.no_prose(df.where("doc_id = 99"), "doc_id", "text").count() == 0


# ------------------------------------------------------------------ 4: names


@given(st.lists(st.text("abc", max_size=7), min_size=1, max_size=8), st.text("abc", max_size=7))
@settings(max_examples=200, deadline=None)
def test_distances(texts, pivot):
    assert metric.distances(texts, pivot).tolist() == [names.damerau(t, pivot) for t in texts]


@given(st.text("ab", max_size=6), st.text("ab", max_size=6), st.text("ab", max_size=6))
@settings(max_examples=300, deadline=None)
def test_distance_is_a_metric(a, b, c):
    assert names.damerau(a, c) <= names.damerau(a, b) + names.damerau(b, c) and names.damerau(a, b) == names.damerau(b, a)


def test_radius_join_against_all_pairs(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(2, 6))) for _ in range(150)})
    df = spark.createDataFrame([("x", w) for w in words] + [("y", "aaaa"), ("y", None), ("y", "")], "scope string, word string")
    got = {(r.scope, r.word_a, r.word_b, r.distance) for r in metric.radius_pairs(df, "scope", "word").collect()}
    wanted = {("x", a, b, 1) for i, a in enumerate(words) for b in words[i + 1 :] if names.damerau(a, b) == 1}
    assert got == wanted


def test_radius_two_against_all_pairs(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(3, 8))) for _ in range(250)} | {"".join(rng.choice("ab") for _ in range(n)) for n in (22, 23, 24, 25, 26, 27, 28, 40)})
    long = [w for w in words if len(w) >= 22]
    for w in long:  # one or two edits of long words, over the border between both ways to join
        words += [w[:5] + w[6:], w[:9] + w[10] + w[9] + w[11:], w[:3] + "c" + w[3:15] + w[16:], w + "dd"]
    words = sorted(set(words))
    got = {(r.word_a, r.word_b, r.distance) for r in metric.radius_pairs(spark.createDataFrame([("x", w) for w in words], "scope string, word string"), "scope", "word", 2).collect()}
    assert got == {(a, b, d) for i, a in enumerate(words) for b in words[i + 1 :] if (d := names.damerau(a, b, 2)) <= 2}


def test_names_within_the_radius_against_all_pairs(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 10))) for _ in range(60)]

    def spoil(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdefgh") + w[i:], w[:i] + w[i : i + 2][::-1] + w[i + 2 :], w])

    cores = set()
    while len(cores) < 2000:
        pair = [rng.choice(base) for _ in range(rng.choice([2, 2, 2, 3]))]
        cores.add(tuple(sorted({spoil(spoil(w)) if rng.random() < 0.3 else w for w in pair})))
    cores = sorted(c for c in cores if len(c) >= 2)
    got = {(r.a, r.b) for r in variants.linked_names(spark.createDataFrame([("x", list(c)) for c in cores], "country string, words array<string>")).collect()}

    letters = {w: frozenset(w) for c in cores for w in c}

    @lru_cache(None)
    def fits(x, y):
        if abs(len(x) - len(y)) > 2 or len(letters[x] ^ letters[y]) > 4:
            return 99
        d = names.damerau(x, y, 2)
        return 99 if d * variants.LETTERS > max(len(x), len(y)) else d

    def near(a, b):
        rest_a, rest_b = [w for w in a if w not in b], [w for w in b if w not in a]
        if len(a) != len(b) or len(rest_a) > 2:
            return False
        if len(rest_a) == 1:
            return fits(rest_a[0], rest_b[0]) <= 2
        return min(fits(rest_a[0], rest_b[0]) + fits(rest_a[1], rest_b[1]), fits(rest_a[0], rest_b[1]) + fits(rest_a[1], rest_b[0])) <= 2

    texts = [" ".join(c) for c in cores]
    wanted = {(min(texts[i], texts[j]), max(texts[i], texts[j])) for i in range(len(cores)) for j in range(i + 1, len(cores)) if near(cores[i], cores[j])}
    assert wanted <= got
    # beyond the radius only names that lie within it of one and the same name
    within = wanted | {(b, a) for a, b in wanted}
    beside = {}
    for a, b in within:
        beside.setdefault(a, set()).add(b)
    assert all(beside.get(a, set()) & beside.get(b, set()) for a, b in got - wanted)


def test_short_forms_of_lines():
    used = names.Lines({"developers": 5, "development": 2})
    assert [used(w) for w in ("dev", "devlprs", "svcs", "mfg", "baker", "mason", "ltd", "rex", "jewellery", "resaurant")] == ["developers", "developers", "services", "manufacturing", None, None, "", None, "jewellery", "restaurant"]


def test_names_far_apart_in_use(spark):
    rows = [("a", "Kowalski Bremner", "US"), ("b", "Kowlaski Bremner", "US"), ("c", "Featherstone Ltd", "US"), ("d", "Fetherstonn Ltd", "US"), ("e", "Rex Holt", "US"), ("f", "Rexx Holt", "US"), ("g", "Jones Miller", "US"), ("h", "James Miller", "US")]
    more = [(f"k{i}", f"Kowalski {w}", "US") for i, w in enumerate(("Ostrey", "Tusmore", "Wexcombe"))] + [(f"l{i}", f"Kowlaski {w}", "US") for i, w in enumerate(("Lindham", "Corfast", "Yaldune"))]
    for every in (rows, rows + more):
        df = spark.createDataFrame(every, "entity_id string, name string, country string")
        assert sorted((r.key_a, r.key_b) for r in variants.name_pairs(df, "entity_id", "name", "country").collect()) == [("a", "b"), ("c", "d"), ("e", "f")]


def test_name_pairs(spark):
    rows = [
        ("a", "Fairbanks & Moreland Industries LLC", "US"), ("b", "Moreland-Fairbanks Inds", "US"), ("c", "The Fairbanks Morelnad", "US"), ("d", "Fairbanks & Moreland Foods Inc", "US"), ("e", "Fairbanks & Moreland Industries LLC", "India"),
        ("f", "Tommy Pramlusk Plumbing", "US"), ("g", "T. Pramlusk Plumbing Co", "US"), ("h", "Robert Pramlusk Plumbing", "US"), ("i", None, "US"), ("j", "", "US"), ("k", "...", "US"), ("a", "Fairbanks & Moreland Industries LLC", "US"), (None, "x y", "US"),
    ]
    df = spark.createDataFrame(rows, "entity_id string, name string, country string")
    got = [(r.key_a, r.key_b) for r in variants.name_pairs(df, "entity_id", "name", "country").collect()]
    assert sorted(got) == [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("f", "g")]
    assert variants.name_pairs(df.where("entity_id = 'z'"), "entity_id", "name", "country").count() == 0


# ------------------------------------------------------------------ 1: addresses


@pytest.mark.parametrize(
    ("address", "country", "wanted"),
    [
        ("Suite 5, 0042 N. Wexley Street, Dunmore, OH", "US", ("42", "n", "wexley", "street", "dunmore")), ("Dunmore Ohio 42 Wexley St. North", "US", ("42", "n", "wexley", "street", "dunmore")), ("#50; 42 Wexley; Dunmore", "US", ("42", "", "wexley", "", "dunmore")),
        ("1st Floor, Plot No. 042, Rokavi Mg, Teja Towers, Near Gana Temple, Sivo Ngr, Dhamo, WB", "India", ("42", "", "rokavi", "marg", "dhamo")), ("42 bis, r. de la Brisette, Bâtiment B, Vernay, Grand Est", "France", ("42b", "", "brisette", "rue", "vernay")),
    ],
)
def test_reading_addresses(address, country, wanted):
    assert places.readings(address, country) == [wanted]


@pytest.mark.parametrize(
    ("address", "country", "wanted"),
    [
        ("7 Old Mill Road, San Jose", "US", [("7", "", "old mill", "road", "san jose")]), ("7 Old Oak Road, San Jose", "US", [("7", "", "old oak", "road", "san jose")]), ("100 Martin Luther King Blvd, Austin TX 78701", "US", [("100", "", "martin luther king", "boulevard", "austin")]),
        ("12 rue Victor Basch, 69001 Lyon, France", "France", [("12", "", "victor basch", "rue", "lyon")]), ("Hauptstraße 12, 10115 Berlin", "Germany", [("12", "", "hauptstrasse", "", "berlin")]), ("MG Road 12, Bengaluru", "India", [("12", "", "mg", "road", "bengaluru")]),
        ("100 5th Ave, New York, NY 10011", "US", [("100", "", "5th", "avenue", "new york")]), ("Dhamo 51, Rokavi Cross Teja Chambers 4th Floor WB", "India", [("51", "", "rokavi", "cross", "dhamo")]), ("12/3 Gana Nagar Road, Pune", "India", [("12/3", "", "gana nagar", "road", "pune")]),
        ("", "US", []), ("no number", "", []), ("x " * 3000, "US", []),
    ],
)
def test_reading_word_sequences(address, country, wanted):
    assert places.readings(address, country) == wanted


def test_streets_of_several_words(spark):
    rows = [
        ("a", "7 Old Mill Road, San Jose", "US"), ("b", "7 Old Oak Road, San Jose", "US"), ("c", "Suite 4, 7 Old Mill Rd, San Jose, CA", "US"), ("d", "100 Martin Luther King Blvd, Austin", "US"), ("e", "100 Martin Gale Road, Austin", "US"), ("f", "100 5th Ave, Austin", "US"), ("g", "100 6th Ave, Austin", "US"),
        ("h", "Hauptstrasse 12, Berlin", "Germany"), ("i", "Hauptstrase 12, 10115 Berlin", "Germany"), ("j", "12 rue Victor Hugo, Lyon", "France"), ("k", "12 rue Victor Basch, Lyon", "France"), ("l", "7 Old Mill, Suite 5, San Jose", "US"),
    ]
    df = spark.createDataFrame(rows, "id string, a string, country string")
    got = sorted((r.key_a, r.key_b) for r in gazetteer.same_place(df, "id", "a", "country").collect())
    assert got == [("a", "c"), ("a", "l"), ("c", "l"), ("h", "i")]
    assert gazetteer.same_place(df, "id", "a", "country", by_unit=True).where("key_a = 'a'").count() == 0
    links = {r.key: (r.place, r.links) for r in gazetteer.place_members(df, "id", "a", "country").collect()}
    assert len(links) == len(rows) and links["a"] == links["c"] == links["l"] and links["a"][1] == 2 and links["b"][1] == 0 and links["h"] == links["i"]


def test_places_do_not_depend_on_unrelated_records(spark):
    streets = ["Wexley", "Kelver", "Brastow", "Quindle", "Hamwick", "Jorvane", "Tusmore", "Pilgard"]
    few = [("x", "77 Wexley Street, Dunmore, OH", "US"), ("y", "77 Wexley Street, Dunmroe, OH", "US")]
    more = [(f"r{s}{i}", f"{i} {s} Street, {t}, OH", "US") for s in streets for i in range(1, 6) for t in ("Dunmore", "Dunmroe")]
    for rows in (few, few + more):
        df = spark.createDataFrame(rows, "id string, a string, country string")
        assert ("x", "y") in {(r.key_a, r.key_b) for r in gazetteer.same_place(df, "id", "a", "country").collect()}


def test_same_place(spark):
    rows = [
        ("a", "42 N Wexley Street, Dunmore, OH", "US"), ("b", "Suite 3, 42 North Wexley St, Dunmore", "US"), ("c", "42 N Wexly, Dunmore, Ohio", "US"), ("d", "42 N Wexley Road, Dunmore, OH", "US"), ("e", "42 S Wexley Street, Dunmore, OH", "US"),
        ("f", "43 N Wexley Street, Dunmore, OH", "US"), ("g", "42 N Wexley Street, Otherton, OH", "US"), ("h", None, "US"), ("i", "", "US"), ("j", "no number here", "US"), ("a", "42 N Wexley Street, Dunmore, OH", "US"),
    ]
    df = spark.createDataFrame(rows, "entity_id string, business_address string, country string")
    got = [(r.key_a, r.key_b) for r in gazetteer.same_place(df, "entity_id", "business_address", "country").collect()]
    assert sorted(got) == [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d")]
    assert gazetteer.same_place(df.where("entity_id = 'z'"), "entity_id", "business_address", "country").count() == 0


# ------------------------------------------------------------------ 3: matching


def test_reading_any_name():
    assert matching.read_any("www.foxbrook.co.in")[0] == ["foxbrook"] and matching.read_any("#foxbrook")[0] == ["foxbrook"]
    assert matching.read_any("Oldco d.b.a. Foxbrook Foods") == (["foxbrook"], "", "foods")
    assert matching.read_any("वयखेभि प्राइवेट लिमिटेड") == (["vayakhebhi"], "", "")


def test_match(spark):
    schema = "entity_id string, n string, a string, country string"
    ref = spark.createDataFrame([("S1-1", "Foxbrook Denham Foods", "42 Wexley St, Dunmore", "US"), ("S1-2", "Foxbrook Denham Foods", "7 Other St, Dunmore", "US"), ("S1-3", "Vayakhebhi Dhoja Traders", "5 Rokavi Marg, Dhamo", "India"), ("S1-4", None, None, "US")], schema)
    pool = spark.createDataFrame([("S2-1", "DENHAM FOXBROOK", "42 wexley street, dunmore, ohio", "US"), ("S2-2", "foxbrookdenham.com", "7 Other Street Dunmore", "US"), ("S2-3", "वयखेभि धोज", None, "India"), ("S2-4", "Else Entirely", "42 Wexley St, Dunmore", "US"), ("S2-5", "", "", "US"), ("S2-1", "DENHAM FOXBROOK", "42 wexley street, dunmore, ohio", "US")], schema)
    got = {(r.reference, r.pool): r.confidence for r in matching.match(ref, pool, "entity_id", "n", "a", "country").collect()}
    assert set(got) == {("S1-1", "S2-1"), ("S1-2", "S2-2"), ("S1-3", "S2-3")} and all(0 < c <= 1 for c in got.values())
    assert matching.match(ref, pool.where("entity_id = 'z'"), "entity_id", "n", "a", "country").count() == 0


def test_neighbours_over_partitions(spark):
    rng = random.Random(3)
    rows = [(f"{rng.random():.9f}", i % 2, i, -1, None) for i in range(4000)]
    df = spark.createDataFrame(rows, "key string, source int, row long, bits long, door long")
    order = sorted(rows)
    wanted = set()
    for i, a in enumerate(order):
        for b in order[i + 1 : i + 4]:
            if a[1] != b[1]:
                wanted.add((a[2], b[2]) if a[1] == 0 else (b[2], a[2]))
    got = [(r.reference, r.pool) for r in matching.neighbours(df, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_match_in_a_group_of_copies(spark):
    schema = "entity_id string, n string, a string, country string"
    ref = spark.createDataFrame([("S1-1", "Foxbrook Denham Foods", "42 Wexley St, Dunmore", "US"), ("S1-2", "Tarrow Quill", None, "US")], schema)
    lines = ["Foods", "Plumbing", "Hotel", "Bakery", "Motors", "Textiles", "Jewellers", "Pharmacy", "Printing", "Software", "Logistics", "Furniture", "Traders", "Electronics"]
    copies = [(f"S2-{i:03d}", "Foxbrook Denham Foods", "42 Wexley St, Dunmore", "US") for i in range(60)]
    homes = [(f"S3-{i:03d}", "Tarrow Quill", f"{i + 1} Elm St, Dunmore", "US") for i in range(40)]
    other = [(f"S2-9{i:02d}", f"Foxbrook Denham {x}", "42 Wexley St, Dunmore", "US") for i, x in enumerate(lines)]
    found = matching.match(ref, spark.createDataFrame(copies + homes + other, schema), "entity_id", "n", "a", "country").collect()
    got = {(r.reference, r.pool) for r in found}
    assert len(found) == len(got) and {("S1-1", x[0]) for x in copies} | {("S1-2", x[0]) for x in homes} <= got
    compared = {(r.reference, r.pool) for r in matching.scored_pairs(ref, spark.createDataFrame(copies + other, schema), "entity_id", "n", "a", "country").collect()}
    assert {("S1-1", x[0]) for x in copies + other} <= compared


# ------------------------------------------------------------------ growth: absolute counts don't switch links off


def test_common_misspellings_of_a_common_name(spark):
    others = ["Kelver", "Brastow", "Quindle", "Hamwick", "Jorvane", "Tusmore", "Wexcombe", "Pilgard", "Ostrey", "Lindham", "Corfast", "Yaldune"] + [f"{a}{b}" for a in ("Gront", "Fesk", "Vurm", "Dapl") for b in ("ingway", "ostle", "ebury", "antock", "ulmish")]
    rows = [(f"r{i}", f"Fairbanks {w}", "US") for i, w in enumerate(others)] + [(f"w{i}", f"Fairbnaks {w}", "US") for i, w in enumerate(others[:3])]
    rows += [(f"a{i}", f"Merrow {w}", "US") for i, w in enumerate(others[:9])] + [(f"b{i}", f"Merrox {w}", "US") for i, w in enumerate(others[5:12])] + [("c1", "Merrow Foods", "US"), ("c2", "Merrox Foods", "US")]
    df = spark.createDataFrame(rows, "entity_id string, name string, country string")
    got = {(r.key_a, r.key_b) for r in variants.name_pairs(df, "entity_id", "name", "country").collect()}
    assert got == {(f"r{i}", f"w{i}") for i in range(3)} | {(f"a{i}", f"b{i - 5}") for i in range(5, 9)}


def test_common_misspellings_of_a_large_town(spark):
    streets = ["Wexley", "Kelver", "Brastow", "Quindle", "Hamwick", "Jorvane", "Tusmore", "Pilgard"]
    rows = [(f"r{s}{i}", f"{i} {s} Street, Dunmore, OH", "US") for s in streets for i in range(1, 9)]
    rows += [(f"w{i}", f"{i} {s} Street, Dunmroe, OH", "US") for i, s in enumerate(streets[1:6], 20)] + [("x", "77 Wexley Street, Dunmore, OH", "US"), ("y", "77 Wexly Street, Dunmroe, OH", "US")]
    df = spark.createDataFrame(rows, "entity_id string, business_address string, country string")
    got = {(r.key_a, r.key_b) for r in gazetteer.same_place(df, "entity_id", "business_address", "country").collect()}
    assert got == {("x", "y")}


def test_match_with_equal_reference_records(spark):
    schema = "entity_id string, n string, a string, country string"
    row = ("Foxbrook Denham Foods", "42 Wexley St, Dunmore", "US")
    ref = spark.createDataFrame([(f"S1-{i}", *row) for i in range(4)], schema)
    found = matching.match(ref, spark.createDataFrame([("S2-1", *row)], schema), "entity_id", "n", "a", "country").collect()
    assert [(r.reference, r.pool) for r in found] == [("S1-0", "S2-1")] and 0 < found[0].confidence <= 0.25


# ------------------------------------------------------------------ 9: kinds of lines


def test_kinds_of_documents(spark):
    docs = {
        1: "\\noindent " + ", ".join(f"how the part {i} explains it" for i in range(60)) + ".", 2: "".join(f"valve{i};on the upper shelf {i};how the box holds it;spare\n" for i in range(30)), 3: "null\n" * 200,
        4: "".join(f"-- h\\'et\\'erog\\`ene mod\\`ele r\\'egl\\'e num {'abcdefghij'[i % 10]}{'klmnop'[i % 6]}x\n" for i in range(30)), 5: "In this part, as in the first, we show, for all of the cases, that the results hold, and that they are the same. " * 1 + "We show that it is so in the other case as well.",
        6: ", ".join(["the same thing here"] * 80), 7: "Ã©Ã¨ Ã  Ã´tre dans lÃ©tat de la rÃ©gion et les Ã©coles dÃ©partementales " * 10,
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: r.kind for r in quality.no_prose(df, "doc_id", "text").collect()} == {1: "list", 2: "table", 3: "junk", 4: "list", 6: "junk", 7: "junk"}


# ------------------------------------------------------------------ 3: assignment, windows without a filter


def test_one_to_one_assignment_against_all_choices(spark):
    import itertools

    rng = random.Random(9)
    rows = [(f"r{i}", f"p{j}", round(rng.random(), 2)) for i in range(4) for j in range(4) if rng.random() < 0.8] + [("r0", "p0", 0.1), ("r9", "p9", None)]
    worth = {}
    for r, p, c in rows:
        if c is not None:
            worth[r, p] = max(c, worth.get((r, p), 0))
    most = max(sum(worth.get((f"r{i}", f"p{j}"), 0) for i, j in enumerate(order)) for order in itertools.permutations(range(4)))
    got = matching.assign_one_to_one(spark.createDataFrame(rows, "reference string, pool string, confidence double"), step=0.02).collect()
    assert len({r.reference for r in got}) == len({r.pool for r in got}) == len(got) and sum(r.confidence for r in got) >= most - 0.09
    assert matching.assign_one_to_one(spark.createDataFrame([], "reference string, pool string, confidence double")).count() == 0


def test_windows_without_a_filter(spark):
    rows = [(f"{i:05d}", i % 2, i, 1 << (i % 60), None) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, source int, row long, bits long, door long")
    assert matching.neighbours(df, 2, share=0).count() == 399 and matching.neighbours(df, 2).count() == 0
