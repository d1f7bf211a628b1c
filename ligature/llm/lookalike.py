"""Problem 5: text that looks the same but is made of different characters.

Method: look-alike relations hold between strings and code points ("fi" and the ligature, "e" + acute and
"e-acute", Latin "a" and Cyrillic "a"). Union-find closes them transitively into classes over the alphabet
that occurs in the data; the most frequent member of a class stands for it, and one multi-pattern automaton
rewrites all texts greedily, longest match first, until nothing changes.

The alphabet is bounded by Unicode (1.1 million code points, some thousand in practice), so its counts may
go to the driver; texts never do.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ligature.workspace import scatter

# Letters of other scripts that have the shape of a Latin letter.
HOMOGLYPHS = {
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оο", "p": "р", "q": "ԛ",
    "s": "ѕ", "v": "ѵν", "w": "ԝ", "x": "х", "y": "у",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚK", "M": "МΜϺ",
    "N": "Ν", "O": "ОΟ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
    "-": "‐‑",
}
#: Decompositions whose result reads as the same text; not super- and subscripts, circled and the like.
_SAME = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>"}


def invisible(ch: str) -> bool:
    """Format characters, variation selectors and joiners: nothing of them can be seen."""
    o = ord(ch)
    return unicodedata.category(ch) == "Cf" or o in (0x34F, 0x115F, 0x1160, 0x3164, 0x180B, 0x180C, 0x180D) or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def groups(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def relations(alphabet: Iterable[str]) -> Iterable[tuple[str, str]]:
    """Pairs of strings that look the same, as far as the alphabet needs them."""
    seen = set(alphabet)
    marks = {c for c in seen if unicodedata.combining(c)} | {m for c in seen for m in unicodedata.normalize("NFD", c)[1:] if unicodedata.combining(m)}
    bases = set()
    for ch in sorted(seen):
        if invisible(ch):
            yield ch, ""
            continue
        if unicodedata.category(ch) == "Zs" or ch in "\t\n\r\x0b\x0c\x85  ":
            yield ch, " "
            continue
        tag, _, rest = unicodedata.decomposition(ch).partition(" ")
        if tag in _SAME:
            text = "".join(chr(int(x, 16)) for x in rest.split())
            if text and text[0] != " ":
                yield ch, text
                bases.update(text)
        full = unicodedata.normalize("NFD", ch)
        if full != ch:
            yield ch, full
            for k in range(1, len(full)):
                yield ch, unicodedata.normalize("NFC", full[:k]) + full[k:]
        bases.update(full)
        bases.add(ch)
    for latin, others in HOMOGLYPHS.items():
        for o in others:
            yield o, latin
            for m in sorted(marks):
                yield o + m, latin + m
                for whole in (unicodedata.normalize("NFC", o + m), unicodedata.normalize("NFC", latin + m)):
                    if len(whole) == 1:
                        yield whole, latin + m
    for b in sorted(bases):
        for m in sorted(marks):
            whole = unicodedata.normalize("NFC", b + m)
            if len(whole) == 1 and whole != b + m:
                yield b + m, whole


def rewrite_table(counts: dict[str, int]) -> dict[str, str]:
    """Member -> representative, for every member of a class that is not its own representative.

    The representative is the member with the highest count; a class of invisible or blank characters
    goes to "" or " ". Of equal counts the shorter, then the smaller string wins.
    """
    classes = Classes()
    for a, b in relations(counts):
        classes.union(a, b)

    def weight(x: str) -> float:
        return min((counts.get(c, 0) for c in x), default=0)

    out = {}
    for group in classes.groups():
        best = "" if "" in group else " " if " " in group else min(group, key=lambda x: (-weight(x), len(x), x))
        out.update({x: best for x in group if x != best and x})
    return out


def rewrites_ascii(table: dict[str, str]) -> bool:
    """Whether printable ASCII is rewritten, which is so where another spelling is the more frequent one."""
    return any(k.isascii() and k.isprintable() for k in table)


class Rewriter:
    """Greedy leftmost-longest rewriting by an Aho-Corasick automaton, repeated to a fixed point."""

    def __init__(self, table: dict[str, str]) -> None:
        import ahocorasick

        self.table = table
        self.plain = rewrites_ascii(table)
        self.automaton = ahocorasick.Automaton()
        for k, v in table.items():
            self.automaton.add_word(k, (k, v))
        if table:
            self.automaton.make_automaton()

    def _once(self, text: str) -> str:
        out, at = [], 0
        for end, (k, v) in self.automaton.iter_long(text):
            start = end - len(k) + 1
            out += (text[at:start], v)
            at = end + 1
        return "".join(out) + text[at:] if out else text

    def __call__(self, text: str) -> str:
        if not self.table or not self.plain and text.isascii() and text.isprintable():
            return text
        for _ in range(len(text) + 6):  # until nothing changes; the bound only guards against a circle
            new = self._once(text)
            if new == text:
                break
            text = new
        return text


def alphabet(df: DataFrame, column: str) -> dict[str, int]:
    """How often every code point occurs in the column."""
    chars = df.where(F.col(column).isNotNull()).select(F.explode(F.split(F.col(column), "")).alias("ch"))
    return {r.ch: r.n for r in chars.where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n")).collect()}


def fold_lookalikes(df: DataFrame, column: str, out: str, counts: dict[str, int] | None = None) -> DataFrame:
    """``df`` with column ``out``: the text in its one consistent form (null stays null, "" stays "")."""
    table = rewrite_table(alphabet(df, column) if counts is None else counts)

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        if not hasattr(fold_lookalikes, "made") or fold_lookalikes.made[0] != table:
            fold_lookalikes.made = (table, Rewriter(table))
        rewrite = fold_lookalikes.made[1]
        return texts.map(rewrite, na_action="ignore")

    # printable ASCII mostly has nothing to rewrite and stays in the JVM
    plain = F.col(column).rlike(r"^[ -~]*$") & F.lit(not rewrites_ascii(table))
    return df.withColumn(out, F.when(F.col(column).isNull() | plain, F.col(column)).otherwise(fold(F.when(~plain, F.col(column)))))


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of keys whose texts differ as stored and read the same: (key_a, key_b), key_a < key_b.

    A key counts once, with its first text in string order if it was delivered with several. Rows with a null
    key or text make no pair. Equal texts are gathered before pairs are made, so copies are compared once.
    """
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")
    rows = rows.groupBy("id").agg(F.min("t").alias("t"))
    counts = alphabet(rows, "t")
    # only texts whose form is shared by another spelling can make pairs
    forms = fold_lookalikes(scatter(rows.select("t").distinct(), "t"), "t", "form", counts)
    shared = forms.groupBy("form").agg(F.count("*").alias("k")).where("k > 1").select("form")
    forms = forms.join(shared, "form")
    members = rows.join(forms, "t")
    a, b = members.alias("a"), members.alias("b")
    pairs = a.join(b, (F.col("a.form") == F.col("b.form")) & (F.col("a.t") != F.col("b.t")) & (F.col("a.id") < F.col("b.id")))
    return pairs.select(F.col("a.id").alias("key_a"), F.col("b.id").alias("key_b"))


def consistent_text(spark: SparkSession, df: DataFrame, column: str) -> DataFrame:
    """The table with ``column`` replaced by its consistent form and ``changed`` telling where it differs."""
    out = fold_lookalikes(df, column, "__form")
    return out.withColumn("changed", ~F.col(column).eqNullSafe(F.col("__form"))).withColumn(column, F.col("__form")).drop("__form")
