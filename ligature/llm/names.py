"""Reading of business names: letters folded, legal form, line of business and proper words told apart."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from ligature.functions.text import LEGAL_CANONICAL, LEGAL_WORDS
from ligature.llm.lookalike import HOMOGLYPHS, invisible

_LATIN = {ord(o): latin for latin, others in HOMOGLYPHS.items() for o in others}

#: Legal forms: those of the normalisation steps, and some that it doesn't need.
LEGAL = frozenset({*LEGAL_WORDS, *LEGAL_CANONICAL, *LEGAL_CANONICAL.values(), "llp", "plc", "liability", "gmbh", "ag", "srl", "spa", "bv", "nv", "pty"})
# Words without weight, general words for lines of business, usual short forms of first names.
NOISE = frozenset("the and et und y shree shri sri sons son fils brothers bros of de du des la le les works wks".split())
LINES_OF_BUSINESS = """
accounting advertising agencies agency airlines analytics antiques apparel appliances architects architecture associates attorneys auto automotive aviation bakery bank banking beauty beverages bookkeeping books
boulangerie boutique brewery builders building cafe capital carpentry carpets catering center chemicals childcare cleaning clinic clothing coaching coffee communications compagnie computers conseil constructions
construction consultants consulting contractors cosmetics couriers creations dairy decor decorators dental design designs developers development diagnostics distribution distributors education electric electricals
electricite electrical electronics energy engineering enterprises entertainment equipment etablissements events exports export fabrication farms fashion finance financial fisheries fitness flooring florist flowers foods
foundation foundry freight fuels furnishings furniture gallery gardens gifts glass grocery group hardware healthcare heating holdings homes hospital hospitality hotel hotels housing immobilier imports import industrial
industries information infotech infrastructure ingenierie instruments insurance interiors international investments irrigation janitorial jewellers jewelry jewellery laboratories labs landscaping laundry law learning leasing leather legal
library lighting logistics lumber machinery maintenance management manufacturing marine marketing masonry mechanical media medical menuiserie metals mills minerals mining mobility mortgage motors movers
music networks nursery nutrition office oil optical optics packaging painting paints paper partners petroleum pharma pharmaceuticals pharmacy photography piano plastics plumbing pottery power press printing products
productions projects properties publications publishing real realty recycling refrigeration removals rentals repair repairs research resorts restaurant retail roofing rubber salon school security services shipping shoes
software solar solutions spa sports staffing stationery steel storage stores studio studios supermarket supply surveyors sweets systems tailoring tailors tannery technologies telecom textiles therapy tiles timber
tours towing toys traders trading training transport transports travel travels trucking tutoring upholstery utilities ventures veterinary video warehousing waste watches water weaving welding wellness wholesale wines
""".split()  # fmt: skip
FIRST_NAMES = {
    "alexander": "alex xander sandy", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs", "benjamin": "ben benny benji", "catherine": "cathy cath", "charles": "charlie chuck", "christina": "tina chrissy",
    "christopher": "chris kit", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby", "donald": "don donny", "dorothy": "dot dottie", "edward": "ed eddie ned ted", "elizabeth": "liz beth betty lizzie eliza bess libby",
    "frederick": "fred freddy freddie", "gerald": "gerry jerry", "gregory": "greg", "henry": "hank harry hal", "isabella": "bella izzy isa", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny",
    "john": "jack johnny", "jonathan": "jon jonny", "joseph": "joe joey", "joshua": "josh", "katherine": "kate kathy katie kitty", "kenneth": "ken kenny", "lawrence": "larry", "margaret": "maggie peggy meg marge", "matthew": "matt",
    "michael": "mike mick mickey", "nathaniel": "nate nathan nat", "nicholas": "nick nicky", "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "paddy", "peter": "pete", "philip": "phil", "rebecca": "becky", "richard": "rick dick richie ricky",
    "robert": "bob bobby rob robbie", "ronald": "ron ronny", "samantha": "sammie", "samuel": "sam sammy", "stephen": "steve stevie", "susan": "sue susie", "theodore": "theo teddy", "thomas": "tom tommy", "timothy": "tim timmy",
    "victoria": "vicky vicki tori", "walter": "walt wally", "william": "will bill billy willie", "zachary": "zach zack",
}
#: Short forms and other spellings that no rule of ``abbreviates`` gives.
OTHER_LINES = {"cie": "compagnie", "ctr": "center", "centre": "center", "intl": "international"}


def _stem(word: str) -> str:
    """One form for singular and plural of a line of business."""
    return word[:-3] + "y" if word.endswith("ies") else word[:-1] if word.endswith("s") and not word.endswith("ss") else word


_FULL = {_stem(w): w for w in sorted(LINES_OF_BUSINESS)}
LINES = {**_FULL, **{w: _FULL[_stem(w)] for w in LINES_OF_BUSINESS}, **{w: _FULL[_stem(full)] for w, full in OTHER_LINES.items()}}
FIRST = {a: full for full, short in FIRST_NAMES.items() for a in (full, *short.split())}


def fold(text: str) -> str:
    """One plain form: compatibility letters, look-alikes and accents folded, invisible characters gone; case kept."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", text).translate(_LATIN)
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c) and not invisible(c))


def damerau(a: str, b: str, most: int | None = None) -> int:
    """Unrestricted Damerau-Levenshtein distance: a metric that counts a swap of neighbours once.

    Beyond ``most`` some number above it is given.
    """
    if a == b:
        return 0
    if most is not None:
        if abs(len(a) - len(b)) > most:
            return most + 1
        # equal ends cost nothing, but for one letter that a swap may need
        i, n = 0, min(len(a), len(b))
        while i < n and a[i] == b[i]:
            i += 1
        j = 0
        while j < n - i and a[-1 - j] == b[-1 - j]:
            j += 1
        i, j = max(0, i - 1), max(0, j - 1)
        a, b = a[i : len(a) - j], b[i : len(b) - j]
    big = len(a) + len(b)
    last: dict[str, int] = {}
    d = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, match = 0, j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[-1][-1]


def deletions(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def may_be_typo(a: str, b: str) -> bool:
    """One edit in at most every fourth letter: in shorter words one edit makes another word."""
    return max(len(a), len(b)) >= 4 and damerau(a, b, 1) <= 1


def meeting(words) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for word in words:
        for x in deletions(word):
            out.setdefault(x, []).append(word)
    return out


@lru_cache(1)
def _near_lines() -> dict[str, list[str]]:
    # words of a list are taken with a typo from five letters on: shorter ones are near too many proper words
    return meeting(w for w in {*LINES, *LEGAL} if len(w) >= 5)


@lru_cache(1)
def _lines_by_letter() -> dict[str, list[tuple[str, frozenset]]]:
    out: dict[str, list[tuple[str, frozenset]]] = {}
    for w in LINES_OF_BUSINESS:
        out.setdefault(w[0], []).append((w, frozenset(w)))
    return out


def abbreviates(short: str, full: str) -> bool:
    """The beginning of a word and then only consonants of it in order: "constr", "svcs", "devlprs", "mfg".

    Three letters at least, and three at least left out, so that no word of its own is taken ("baker").
    """
    if len(short) < 3 or short[0] != full[0] or len(full) - len(short) < (2 if not set(short[1:]) & set("aeiou") else 3):
        return False
    i = 1
    while i < len(short) and short[i] == full[i]:
        i += 1
    at = i
    for c in short[i:]:
        at = full.find(c, at) + 1
        if c in "aeiou" or not at:
            return False
    return True


_CLIPPED = re.compile("[^aeiouy]{3}")


class Lines:
    """The lines of business of one country, with how often its names hold each: that decides what a short form means."""

    def __init__(self, used: dict[str, int] | None = None) -> None:
        self.used = used or {}
        self.known: dict[str, str | None] = {}

    def __call__(self, word: str) -> str | None:
        """The line of business that a word stands for, "" for a legal form, None for a proper word."""
        if word not in self.known:
            if len(self.known) >= 200_000:
                self.known.clear()
            self.known[word] = self._read(word)
        return self.known[word]

    def _read(self, word: str) -> str | None:
        if word in LEGAL:
            return ""
        if word in LINES:
            return LINES[word]
        if len(word) >= 5:
            near = [known for x in deletions(word) for known in _near_lines().get(x, ()) if damerau(word, known, 1) <= 1 and known != word + "y"]  # a baker is no bakery
            if near:
                return LINES.get(min(near, key=lambda w: (-self.used.get(LINES.get(w, ""), 0), w)), "")
        # a short form has no letter that the word lacks, with a typo one at most
        some, letters = _lines_by_letter().get(word[:1], ()), frozenset(word)
        short = [w for w, has in some if letters <= has and abbreviates(word, w)]
        if not short and len(word) >= 5 and _CLIPPED.search(word):
            short = [w for w, has in some if len(word) < len(w) and len(letters - has) <= 1 and any(abbreviates(x, w) for x in deletions(word))]
        return LINES[min(short, key=lambda w: (-self.used.get(LINES[w], 0), not w.startswith(word), w[-1] != word[-1], len(w), w))] if short else None


ANY_LINES = Lines()


def line_usage(names: DataFrame, name: str, country: str, most: int = 100_000) -> dict[str, dict[str, int]]:
    """How many names of each country hold each line of business, written in full: {country: {line: names}}.

    At most ``most`` counts, the highest, reach the driver: all lines of some hundred countries.
    """
    plain = F.translate(F.lower(F.col(name)), "àâäáãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")
    word = F.explode(F.array_distinct(F.split(plain, r"[^\p{L}]+")))
    seen = names.select(F.coalesce(F.col(country).cast("string"), F.lit("")).alias("country"), word.alias("word")).where(F.col("word").isin(*LINES_OF_BUSINESS))
    out: dict[str, dict[str, int]] = {}
    for r in seen.groupBy("country", "word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country", "word").limit(most).collect():
        lines = out.setdefault(r.country, {})
        lines[LINES[r.word]] = lines.get(LINES[r.word], 0) + r.n
    return out


_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DOTTED = re.compile(r"\b([A-Za-z])\.(?=[A-Za-z]\b)")


def words(name: str) -> list[str]:
    """Lower-case words of a name; dotted letters are joined and words run together are parted at capitals."""
    text = _CAMEL.sub(" ", _DOTTED.sub(r"\1", fold(name)))
    found = re.findall(r"[^\W_]+", text.lower())
    out: list[str] = []
    for i, w in enumerate(found):
        # a blank that slipped by one letter: "medica lcenter", "engineeringw orks"
        if len(w) == 1 and out and (out[-1] + w) in LINES:
            out[-1] += w
        elif len(w) == 1 and i + 1 < len(found) and (w + found[i + 1]) in LINES:
            found[i + 1] = w + found[i + 1]
        else:
            out.append(w)
    return out


def read_name(name: str, lines_of: Lines = ANY_LINES) -> tuple[list[str], str, str]:
    """(proper words in order, first name or initial or "", lines of business or "")."""
    proper, lines = [], []
    all_words = words(name)
    for i, w in enumerate(all_words):
        if w in NOISE or w == "p" and all_words[i + 1 : i + 2] in (["ltd"], ["limited"]):
            continue
        line = lines_of(w)
        if line is None:
            proper.append(w)
        elif line:
            lines.append(line)
    first = ""
    if len(proper) >= 2:
        for i, w in enumerate(proper):
            if w in FIRST or len(w) == 1 and w.isalpha():
                first = FIRST.get(w, w)
                proper = proper[:i] + proper[i + 1 :]
                break
    if not proper and lines:  # nothing but a line of business: it is the name
        return lines, "", ""
    return proper, first, " ".join(sorted(set(lines)))
