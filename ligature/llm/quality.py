"""Problem 9: per-document statistics of text quality, and documents that are no prose.

Method: length, symbol, punctuation, bullet and common-word statistics of every document, computed over
batches, then fixed thresholds with a recorded reason for each one that fails. The general thresholds are
those published for the Gopher and C4 corpora. For typeset articles, which fail many of them for their formulas
and commands, the same statistics are taken line by line over the body (without preamble, title, bibliography and
comments): share of common words, sentence ends, words a sentence and a phrase, repeated words and lines, bullets,
separators, letters. That gives the words and characters of prose, lists, tables and junk; a document is no prose
if less than half of its body is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

# Common words of the four languages.
COMMON = frozenset("""
the of and is a in to that it an with for as are was were be been its their which this these those not no from by on at or but if
when then we our than only each every has have had must what there they can also so such under over nothing once
le la les des du un une et est dans que qui pour par sur avec son ses sa leur leurs ce cette ces il elle nous au aux ne pas plus ou sont lorsque en de dont soit
der die das den dem des ein eine einen einem einer eines und ist in zu mit von für auf sich nicht als auch aus bei wird werden sind dass wenn wie noch nur so sein seine seinen ihr ihre wir im am zwischen während obwohl kein keine daß sobald damit
el los las un una unos y en que se del al por con para su sus es son como más no lo entre cuando este esta estos sin pero si también ya
""".split())  # fmt: skip
_LIST, _TABLE, _CODE, _MATH = "list", "table", "code", "math"
_ENVIRONMENTS = {
    **dict.fromkeys(("itemize", "enumerate", "description", "list", "compactitem", "theindex"), _LIST),
    **dict.fromkeys(("tabular", "tabular*", "tabularx", "longtable", "tabbing", "supertabular"), _TABLE),
    **dict.fromkeys(("verbatim", "lstlisting", "alltt", "Verbatim"), _CODE),
    **dict.fromkeys(("equation", "equation*", "align", "align*", "gather", "gather*", "eqnarray", "eqnarray*", "multline", "displaymath", "math", "array"), _MATH),
}
_HEAD = re.compile(r"\s*\\(?:documentclass|usepackage|newcommand|renewcommand|providecommand|def|title|author|date|maketitle|input|include|label|newtheorem|DeclareMathOperator|bibliography|bibliographystyle|section|subsection|subsubsection|chapter|paragraph|tableofcontents|pagestyle|setlength|hline|toprule|midrule|bottomrule|clearpage|newpage|appendix)\b")
_BIBLIOGRAPHY = re.compile(r"\\begin\{thebibliography\}.*?(?:\\end\{thebibliography\}|\Z)", re.S)
_SWITCH = re.compile(r"\\(begin|end)\{([a-zA-Z]+\*?)\}(?:\[[^\]]*\])?(?:\{[^}]*\})?")
_COMMAND = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?|[{}~$]")
_COMMENT = re.compile(r"(?<!\\)%.*")
_LETTER_WORD = re.compile(r"[^\W\d_]\S*")
_BULLET = re.compile(r"\s*(?:\\item\b|--?\s|[*•·‣–—+o]\s|\(?\d{1,3}[.)]\s|\(?[a-zA-Z][.)]\s|#)")
_CELLS = re.compile(r"\s*(?:&|\||;|\t|,| {2,})\s*")
_DENSE = re.compile(r"[,;|\t](?=\S)|\s\|\s|(?<=\S) {2,}(?=\S)")
_ACCENT = re.compile(r"\\[\"'`^~=.cvuHkrdb]?\{\\?([A-Za-z])\}|\\[\"'`^~=.]\\?([A-Za-z])|\{?\\(ss|ae|oe|AE|OE|o|O|l|L|i|j)\b ?(?:\{\}|\})?")
_SEPARATED = re.compile(r"[&|;\t]|  |,\S")
_PART = re.compile(r"[,;]\s*")
_SENTENCE = re.compile(r"[.!?](?:\s|$)")
_PHRASE = re.compile(r"[^\W\d_][\w'’ \\\"`^~{}-]*")
_BROKEN = re.compile(r"Ã.|Â.|â€|�|[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_NUMBER = re.compile(r"[-+±$\\pm .,\d%eE]*\d[-+±$\\pm .,\d%eE]*|--|-|n/?a|NaN|null|nan")
FIELDS = ["words", "chars", "mean_word_length", "symbol_ratio", "ellipsis_lines", "punctuated_lines", "bullet_lines", "letter_words", "common_share", "repeated_lines"]
SHARES = [f"{k}_{u}" for k in ("body", "prose", "list", "table", "junk") for u in ("words", "chars")]


def body(text: str) -> str:
    """The body: without preamble, title, bibliography, comments and what follows the end."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    at = text.find("\\begin{document}")
    if at >= 0:
        text = text[at + 16 :]
    at = text.find("\\end{document}")
    if at >= 0:
        text = text[:at]
    if "thebibliography" in text:
        text = _BIBLIOGRAPHY.sub("\n", text)
    return text


def plain_accents(text: str) -> str:
    """Letters for accented letters in markup, so that words of such texts look like words."""
    return _ACCENT.sub(lambda m: m[1] or m[2] or m[3], text) if "\\" in text else text


def _unreadable(line: str, tokens: list[str]) -> bool:
    """Random characters, dumps, broken encoding or one word over and over."""
    if not line.isascii() and len(_BROKEN.findall(line)) > 0.03 * len(line):
        return True
    letters = sum(map(str.isalpha, line))
    if letters < 0.5 * (len(line) - line.count(" ")):
        return True
    if len(tokens) >= 8 and len(set(tokens)) <= 0.34 * len(tokens):
        return True
    if max(map(len, tokens)) > 40:
        return True
    odd = sum(1 for w in tokens if not w.isalpha() and not w.rstrip(".,;:!?)").lstrip("(").replace("-", "").replace("'", "").isalpha() and not w.replace(".", "").isdigit())
    return odd > 0.4 * len(tokens)


def _row(line: str) -> bool:
    """Cells of numbers and short phrases, parted as in an exported table: no blank behind a separator."""
    dense = len(_DENSE.findall(line))
    if dense < 2:
        return False
    cells = [c for c in _CELLS.split(line.strip().rstrip("\\").strip()) if c]
    numbers = sum(map(bool, map(_NUMBER.fullmatch, cells)))
    return len(cells) >= 3 and (numbers >= 1 or dense >= 3 or len(cells) == dense + 1 >= 3) and numbers + sum(map(bool, map(_PHRASE.fullmatch, cells))) >= 0.9 * len(cells)


def _enumerates(line: str, words: int) -> bool:
    """Short phrases in a row without sentences: more than 40 words a sentence, at most 7 a phrase."""
    parts = line.count(", ") + line.count("; ")
    return parts >= 5 and words <= 7 * (parts + 1) and words > 40 * len(_SENTENCE.findall(line))


def line_kinds(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, words, characters) of every line of the body; kind is prose, list, table or junk."""
    inside: list[str] = []
    seen: Counter[str] = Counter()
    for line in plain_accents(body(text)).split("\n"):
        if "%" in line:
            line = _COMMENT.sub("", line)
        if "\\begin{" in line or "\\end{" in line:
            for m in _SWITCH.finditer(line):
                if m[1] == "begin":
                    inside.append(_ENVIRONMENTS.get(m[2], ""))
                elif inside:
                    inside.pop()
            line = _SWITCH.sub(" ", line)
        if not line.strip() or _HEAD.match(line) and "&" not in line:
            continue
        env = next((e for e in reversed(inside) if e), "")
        markup = "\\" in line or "$" in line or "{" in line or "}" in line or "~" in line
        bare = _COMMAND.sub(" ", line) if markup and env != _CODE else line
        tokens = bare.split()
        if not tokens:
            continue
        words, chars = len(tokens), len(line.strip())
        if env == _MATH:
            yield "prose", words, chars
            continue
        seen[bare] += 1
        if seen[bare] > 3 and env != _TABLE:  # the same words over and over
            yield "junk", words, chars
            continue
        common = sum(map(COMMON.__contains__, bare.lower().split()))
        if words >= 12 and not env and common >= 0.12 * words and line.isascii() and line.count(",") < 5 and not _SEPARATED.search(line) and len(set(tokens)) >= 0.3 * words:
            yield "prose", words, chars  # what most lines are; nothing below would say otherwise
            continue
        bullet = _BULLET.match(line)
        if env == _TABLE or line.count("&") >= 2 or _row(line):
            yield "table", words, chars
            continue
        if common >= 0.12 * words and words >= 4 and not (words < 12 and (bullet or env == _LIST) and line.rstrip()[-1] not in ".!?"):
            if not line.isascii() and len(_BROKEN.findall(line)) > 0.03 * len(line):
                yield "junk", words, chars
            elif words > 12 and (_enumerates(line, words) or (parts := line.count(",") + line.count(";")) >= 8 and words <= 4 * parts):
                # many short phrases in a row: a list, unless they are the same ones
                phrases = _PART.split(bare)
                yield "list" if len(set(phrases)) >= 0.3 * len(phrases) else "junk", words, chars
            elif words > 20 and len(set(tokens)) < 0.3 * words:
                yield "junk", words, chars
            else:
                yield "prose", words, chars
            continue
        cells = [c for c in _CELLS.split(line.strip().rstrip("\\").strip()) if c]
        if env == _LIST and (bullet or words < 12):
            yield "list", words, chars
        elif _unreadable(bare, tokens):
            yield "junk", words, chars
        elif bullet or len(cells) >= 5 and all(len(c.split()) <= 5 for c in cells):
            yield "list", words, chars
        elif words < 12 and not line.rstrip().endswith((",", ";")):
            # a heading, a formula or the end of a wrapped paragraph, unless lines like it go on and on
            yield "short", words, chars
        else:
            yield "list" if line.rstrip().endswith((",", ";")) else "prose", words, chars


def shares(text: str) -> list[int]:
    """Words and characters of the body and of its prose, lists, tables and junk."""
    n: dict[str, list[int]] = {k: [0, 0, 0] for k in ("prose", "list", "table", "junk", "short")}
    for kind, words, chars in line_kinds(text):
        c = n[kind]
        c[0] += words
        c[1] += chars
        c[2] += 1
    # many short lines without a sentence anywhere near are entries of a list
    if n["short"][2] >= 10 and n["short"][0] > n["prose"][0]:
        n["list"][0] += n["short"][0]
        n["list"][1] += n["short"][1]
    else:
        n["prose"][0] += n["short"][0]
        n["prose"][1] += n["short"][1]
    total = [sum(n[k][i] for k in ("prose", "list", "table", "junk")) for i in (0, 1)]
    return [*total, *n["prose"][:2], *n["list"][:2], *n["table"][:2], *n["junk"][:2]]


def general(text: str) -> list[float]:
    """The statistics of FIELDS over the whole text."""
    tokens = text.split()
    words, chars = len(tokens), len(text)
    if not words:
        return [0.0, float(chars), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    n = len(lines) or 1
    symbols = text.count("#") + text.count("...") + text.count("…")
    return [
        float(words), float(chars), sum(map(len, tokens)) / words, symbols / words,
        sum(x.endswith(("...", "…")) for x in lines) / n, sum(x.endswith((".", "!", "?", '"', "»", "”")) for x in lines) / n,
        sum(map(bool, map(_BULLET.match, lines))) / n, len(_LETTER_WORD.findall(text)) / words,
        sum(map(COMMON.__contains__, text.lower().split())) / words, 1 - len(set(lines)) / n,
    ]


def _measure(fields: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            columns = [b.column(0)]
            if fields[0] == FIELDS[0]:
                columns += [pa.array(x, pa.float64()) for x in list(zip(*map(general, texts), strict=True)) or [()] * len(FIELDS)]
            columns += [pa.array(x, pa.int64()) for x in list(zip(*map(shares, texts), strict=True)) or [()] * len(SHARES)]
            yield pa.record_batch(columns, ["key", *fields])

    return run


def statistics(df: DataFrame, key: str, text: str, whole: bool = True) -> DataFrame:
    """Statistics of every row's text: (key, FIELDS..., SHARES...); of null and empty texts all are 0.

    Without ``whole`` only those of the body's lines: (key, SHARES...).
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    fields = (*FIELDS, *SHARES) if whole else tuple(SHARES)
    schema = StructType([StructField("key", rows.schema["key"].dataType), *(StructField(n, DoubleType() if n in FIELDS else LongType()) for n in fields)])
    return rows.mapInArrow(_measure(fields), schema).withColumnRenamed("key", key)


_NO_PROSE = "body_words > 2 * prose_words and body_chars > 2 * prose_chars"


def reasons() -> Column:
    """Names of the published thresholds that a row of ``statistics`` fails."""
    c = F.col
    rules = {
        "too_few_words": c("words") < 50,
        "too_many_words": c("words") > 100_000,
        "word_length": ~c("mean_word_length").between(3, 10),
        "symbols": c("symbol_ratio") > 0.1,
        "bullets": c("bullet_lines") > 0.9,
        "ellipses": c("ellipsis_lines") > 0.3,
        "letterless_words": c("letter_words") < 0.8,
        "common_words": c("common_share") * c("words") < 2,
        "repeated_lines": c("repeated_lines") > 0.3,
        "body_no_prose": F.expr(_NO_PROSE),
    }
    return F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())


def no_prose(df: DataFrame, key: str, text: str, least_chars: int = 100) -> DataFrame:
    """Documents whose body is, by more than half of its words and of its characters, no prose: (key, kind).

    ``kind`` is the class with the most characters: list, table or junk. Null, empty and blank texts are no
    case, nor are bodies of fewer than ``least_chars`` characters. Repeated rows give one row each.
    """
    s = statistics(df, key, text, whole=False)
    most = F.greatest("list_chars", "table_chars", "junk_chars")
    kind = F.when(F.col("junk_chars") == most, "junk").when(F.col("table_chars") == most, "table").otherwise("list")
    return s.where((F.col("body_chars") >= least_chars) & F.expr(_NO_PROSE)).select(key, kind.alias("kind"))
