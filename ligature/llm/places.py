"""Reading of postal addresses: the parts that tell a place, and those that don't.

A reading is (number, direction, street, street type, town); street and town are word sequences. An address may
have several readings, as parts may stand in any order, without separators and with typos, and the number may
stand before its street or behind it; the gazetteer decides between them.
"""

from __future__ import annotations

import re
from functools import lru_cache

from ligature.functions.indic import has_indic, romanise
from ligature.functions.text import ADDRESS_WORDS
from ligature.llm.names import deletions, damerau, fold

# Words of addresses and what they stand for. Street types stand behind the street, or before it in the countries named.
_BEHIND = {
    "alley": "aly", "avenue": "av aven", "bend": "", "boulevard": "boul", "bypass": "", "circle": "", "close": "", "court": "", "cove": "", "crescent": "cres", "cross": "crs", "drive": "", "esplanade": "", "expressway": "expy",
    "freeway": "fwy", "gali": "", "gardens": "gdns", "grove": "grv", "highway": "", "lane": "", "loop": "", "marg": "mg", "mews": "", "parkway": "pky", "path": "", "pike": "", "place": "", "plaza": "plz", "ridge": "", "road": "",
    "row": "", "salai": "", "square": "sq", "street": "str", "terrace": "ter terr", "trail": "trl", "turnpike": "tpke", "walk": "", "way": "",
}
_BEFORE = {
    "allee": "all allees", "avenida": "avda", "avenue": "aven", "boulevard": "bld boul", "calle": "", "carrer": "", "chemin": "ch che chem", "cite": "", "corso": "", "cours": "", "esplanade": "", "faubourg": "fg fbg", "impasse": "imp",
    "passage": "", "paseo": "", "piazza": "", "place": "", "plaza": "", "quai": "", "rua": "", "route": "rte", "sentier": "", "square": "sq", "travessa": "", "via": "", "viale": "", "voie": "",
}
BEFORE_COUNTRIES = frozenset("france belgium spain italy portugal brazil mexico argentina luxembourg".split())
DIRECTIONS = {"north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw"}
UNITS = frozenset("suite ste unit apt apartment flat room rm office bureau batiment bat etage esc escalier appt appartement porte fl floor".split())
BUILDINGS = frozenset("complex bhavan bhawan towers tower chambers building bldg residency heights mansion arcade".split())
AREAS = frozenset("nagar ngr colony col layout lyt enclave extension extn society vihar".split())
NEAR = frozenset("near nr opp opposite behind beside".split())
LANDMARKS = frozenset("temple bank school hospital station market mall park church mosque college stadium".split())
ARTICLES = frozenset("de du des la le les l d del di da do dos".split())
SUFFIXES = {"bis": "b", "ter": "t", "quater": "q", "b": "b", "t": "t", "q": "q"}
STATES = {
    "us": "alabama al,alaska ak,arizona az,arkansas ar,california ca,colorado co,connecticut ct,delaware de,florida fl,georgia ga,hawaii hi,idaho id,illinois il,indiana in,iowa ia,kansas ks,kentucky ky,louisiana la,maine me,maryland md,massachusetts ma,michigan mi,minnesota mn,mississippi ms,missouri mo,montana mt,nebraska ne,nevada nv,new hampshire nh,new jersey nj,new mexico nm,new york ny,north carolina nc,north dakota nd,ohio oh,oklahoma ok,oregon or,pennsylvania pa,rhode island ri,south carolina sc,south dakota sd,tennessee tn,texas tx,utah ut,vermont vt,virginia va,washington wa,west virginia wv,wisconsin wi,wyoming wy,district of columbia dc",
    "india": "andhra pradesh ap,arunachal pradesh ar,assam as,bihar br,chhattisgarh cg,delhi dl,goa ga,gujarat gj,haryana hr,himachal pradesh hp,jharkhand jh,karnataka ka,kerala kl,madhya pradesh mp,maharashtra mh,manipur mn,meghalaya ml,mizoram mz,nagaland nl,odisha od,punjab pb,rajasthan rj,sikkim sk,tamil nadu tn,telangana ts,tripura tr,uttar pradesh up,uttarakhand uk,west bengal wb",
    "france": "auvergne-rhone-alpes,bourgogne-franche-comte,bretagne,centre-val de loire,corse,grand est,hauts-de-france,ile-de-france,normandie,nouvelle-aquitaine,occitanie,pays de la loire,provence-alpes-cote d azur,ain,aisne,allier,alpes-maritimes,ardeche,ardennes,ariege,aube,aude,aveyron,bas-rhin,bouches-du-rhone,calvados,cantal,charente,charente-maritime,cher,correze,cote-d-or,cotes-d-armor,creuse,deux-sevres,dordogne,doubs,drome,essonne,eure,eure-et-loir,finistere,gard,gers,gironde,haut-rhin,haute-corse,haute-garonne,haute-loire,haute-marne,haute-savoie,haute-saone,haute-vienne,hautes-alpes,hautes-pyrenees,hauts-de-seine,herault,ille-et-vilaine,indre,indre-et-loire,isere,jura,landes,loir-et-cher,loire,loire-atlantique,loiret,lot,lot-et-garonne,lozere,maine-et-loire,manche,marne,mayenne,meurthe-et-moselle,meuse,morbihan,moselle,nievre,nord,oise,orne,pas-de-calais,puy-de-dome,pyrenees-atlantiques,pyrenees-orientales,rhone,sarthe,savoie,saone-et-loire,seine-et-marne,seine-maritime,seine-saint-denis,somme,tarn,tarn-et-garonne,territoire de belfort,val-d-oise,val-de-marne,var,vaucluse,vendee,vienne,vosges,yonne,yvelines",
}
_COMPOUND = re.compile(r"\w{2,}(?:strasse|strabe|str|gasse|weg|platz|allee|ufer|damm|straat|laan|gatan|vagen|gade|vej)")


@lru_cache(64)
def type_words(country: str) -> dict[str, str]:
    """Street types of a country and their short forms; those of the normalisation steps count too."""
    table = _BEFORE if country.lower() in BEFORE_COUNTRIES else _BEHIND
    out = {a: full for full, short in table.items() for a in (full, *short.split())}
    if table is _BEFORE:
        out["rue"] = "rue"
    return {**{a: full for a, full in ADDRESS_WORDS.items() if full in out}, **out}


@lru_cache(64)
def _long_types(country: str) -> frozenset:
    return frozenset(x for x in type_words(country) if len(x) >= 4)


@lru_cache(64)
def _state_phrases(country: str) -> dict[str, list[tuple[int, list[str], bool]]]:
    """States by their first word: (place in the order, words, whether it is a short form); the longest come first."""
    every = []
    for entry in filter(None, STATES.get(country.lower(), "").split(",")):
        head, _, code = entry.rpartition(" ") if country.lower() != "france" else (entry, "", "")
        every.append((re.split("[ -]", head), False))
        if code:
            every.append(([code], True))
    out: dict[str, list[tuple[int, list[str], bool]]] = {}
    for place, (phrase, short) in enumerate(sorted(every, key=lambda x: -len(x[0]))):
        out.setdefault(phrase[0], []).append((place, phrase, short))
    return out


@lru_cache(64)
def _near_words(group: frozenset, least: int) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for word in group:
        if len(word) >= least:
            for x in deletions(word):
                out.setdefault(x, []).append(word)
    return out


@lru_cache(100_000)
def one_of(word: str, group: frozenset, least: int = 5) -> str | None:
    """The member of the group that the word is, or has one typo of; words under ``least`` letters have no typos here."""
    if word in group:
        return word
    if len(word) >= least:
        for x in deletions(word):
            for known in _near_words(group, least).get(x, ()):
                if damerau(word, known, 1) <= 1:
                    return known
    return None


_TOKEN = re.compile(r"\d+(?:st|nd|rd|th|eme|er)\b|\d+(?:[/-]\d+)*|[^\W\d_]+|[,;#]|\s-\s|\n")
_INDIC = re.compile("[ऀ-ൿ‌‍]+")
_PLACEHOLDER = re.compile(r"\b(?:null|none|n/a|nan|unknown)\b")
_NUMBER_WORDS = frozenset("no num number plot door house hno nr".split())
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th|eme|er|e)|ground|first|second|third|fourth|fifth")


def tokens(address: str) -> list[str]:
    """Lower-case words, numbers and separators; dotted short forms are joined, hyphens part words."""
    if has_indic(address):  # mostly the state; only where nothing else is written, it tells the place
        latin = _INDIC.sub(" ", address)
        address = latin if re.search("[A-Za-z]", latin) else romanise(address)
    text = _PLACEHOLDER.sub(" ", fold(address).lower())
    text = text.replace("'", " ").replace("’", " ").replace("ß", "ss")
    text = re.sub(r"\bh\.? ?no\b\.?", "hno ", text)
    return ["," if t.strip() in (",", ";", "-", "") else t.strip() for t in _TOKEN.findall(text)]


def _number(t: str) -> bool:
    return t[0].isdigit() and not t[-1].isalpha()


class _Words:
    """Tokens of one address with what is known of each."""

    def __init__(self, toks: list[str], country: str) -> None:
        self.t, self.country, self.used, self.unit = toks, country, [t == "," for t in toks], ""
        self.kinds = type_words(country)
        self.before = country.lower() in BEFORE_COUNTRIES
        self.long_kinds = _long_types(country)

    def free(self, i: int) -> bool:
        return 0 <= i < len(self.t) and not self.used[i]

    def word(self, i: int) -> bool:
        return self.free(i) and not _number(self.t[i]) and self.t[i] != "#"

    def take(self, *at: int) -> None:
        for i in at:
            if 0 <= i < len(self.t):
                self.used[i] = True

    def kind(self, i: int, least: int = 5) -> str:
        """The street type that a word is, perhaps with a typo."""
        x = self.t[i]
        return self.kinds.get(x) or self.kinds.get(one_of(x, self.long_kinds, least) or "", "")


def _states(w: _Words) -> None:
    """Marks the country and one state: a full name anywhere, or a short form at the end of a part."""
    known, t = _state_phrases(w.country), w.t
    home = {w.country.lower(), *(("usa", "us") if w.country.lower() == "us" else ())}
    best: tuple[bool, int, int] | None = None
    for i, x in enumerate(t):
        for _, phrase, short in known.get(x, ()):
            n = len(phrase)
            if t[i : i + n] != phrase or any(w.used[i : i + n]):
                continue
            end = i + n
            if end < len(t) and re.fullmatch(r"\d{5,}", t[end]):  # a postal code
                end += 1
            last = end == len(t) or end + 1 == len(t) and t[end] in home
            alone = (i == 0 or t[i - 1] == ",") and (last or t[end] == ",")
            if short and not (alone or last and x not in w.kinds) and end == i + n:
                continue
            if not short and n == 1 and not alone and not last and w.before:
                continue
            # of several the last one that is a part of its own: "New York, NY"
            if best is None or (alone, i, n) > best:
                best = (alone, i, n)
    if best:
        w.take(*range(best[1], best[1] + best[2]))
    if len(t) > 1 and t[-1] in home:
        w.take(len(t) - 1)


def _units(w: _Words) -> None:
    """Marks units, floors, buildings, areas and landmarks."""
    t = w.t
    for i, x in enumerate(t):
        if w.used[i] or x not in UNITS:
            continue
        if x in ("floor", "fl", "etage") and i and (_number(t[i - 1]) or _ORDINAL.fullmatch(t[i - 1])):
            w.take(i, i - 1)
            continue
        j = i + 1
        if j < len(t) and re.fullmatch(r"\d+|[a-z]", t[j]):
            w.take(i, j)
            unit = t[j]
            if t[j].isdigit() and j + 1 < len(t) and re.fullmatch(r"[a-z]", t[j + 1]) and (t[j + 1] not in ("n", "s", "e", "w") or j + 2 == len(t) or t[j + 2] == ","):
                w.take(j + 1)
                unit += t[j + 1]
            if x not in ("floor", "fl", "etage"):
                w.unit = unit.lstrip("0")
        elif x not in w.kinds and (j >= len(t) or t[j] == ","):
            w.take(i)
    for i, x in enumerate(t):
        if x in NEAR and not w.used[i] and not (i + 1 < len(t) and _number(t[i + 1])):
            j = i + 1
            while j < len(t) and j <= i + 3 and t[j] != ",":
                w.take(j)
                if one_of(t[j], LANDMARKS):
                    break
                j += 1
            w.take(i)
    for i, x in enumerate(t):
        if not w.used[i] and i and w.word(i - 1) and (one_of(x, BUILDINGS) or one_of(x, AREAS)) and not (w.word(i + 1) and w.kind(i + 1)):
            w.take(i, i - 1)
    # "#" before a number that ends its part is a unit; else it belongs to the house number
    for i, x in enumerate(t):
        if x == "#" and w.free(i):
            j = i + 1
            end = j + 1
            if end < len(t) and re.fullmatch(r"[a-z]", t[end]) and (t[end] not in ("n", "s", "e", "w") or end + 1 == len(t) or t[end + 1] == ","):
                end += 1
            w.take(i)
            other = any(_number(y) and w.free(k) for k, y in enumerate(t) if k >= end or k < i)
            if j < len(t) and other and (end >= len(t) or not w.word(end)):
                w.take(*range(j, end))
                w.unit = "".join(t[j:end]).lstrip("0")


def _run(w: _Words, i: int, step: int) -> list[int]:
    """Free words next to each other from i on, in one direction, in order."""
    out = []
    while w.word(i) and w.t[i] not in _NUMBER_WORDS:
        out.append(i)
        i += step
    return out[::step]


def _direction(word: str) -> str:
    return DIRECTIONS.get(word, word if word in DIRECTIONS.values() else "")


def _streets(w: _Words, run: list[int], whole: bool) -> list[tuple[str, str, str, int, set[int]]]:
    """(direction, street, type, score, tokens taken) that a run of words may be; ``whole``: the town stands elsewhere."""
    t, out = w.t, []
    if w.before:
        kind, k = "", 0
        if len(run) > 1 and (kind := w.kind(run[0])):
            k = 1
        ends = [len(run)] if whole else range(k + 1, len(run)) or [len(run)]
        for end in ends:
            street = [t[i] for i in run[k:end] if t[i] not in ARTICLES]
            if street:
                out.append(("", " ".join(street), kind, 2 * bool(kind), set(run[:end])))
        return out
    n, k, direction = len(run), 0, ""
    if n > 1 and (d := _direction(t[run[0]])) and not (n == 2 and w.kind(run[1])):
        direction, k = d, 1
    if n - k == 1 and len(t[run[k]]) < 2:
        return out
    types = [p for p in range(k + 1, n) if w.kind(run[p])]
    types = [p for p in types if p + 1 not in types]  # of types in a row the last one
    closing = [p for p in types if p == n - 1 or p == n - 2 and _direction(t[run[p + 1]])]
    for p in closing or types:
        end, facing = p + 1, direction
        if not facing and end < n and _direction(t[run[end]]):
            facing, end = _direction(t[run[end]]), end + 1
        out.append((facing, " ".join(t[i] for i in run[k:p]), w.kind(run[p]), 2, set(run[:end])))
    if types:
        return out
    for end in [n] if whole else range(k + 1, n) or [n]:
        last, facing = end, direction
        if not facing and end - k > 1 and _direction(t[run[end - 1]]):
            facing, last = _direction(t[run[end - 1]]), end - 1
        street = [t[i] for i in run[k:last]]
        typed = bool(_COMPOUND.fullmatch(street[0])) if street else False
        out.append((facing, " ".join(street), "", 2 * typed, set(run[:end])))
        # a short type with a typo: the gazetteer knows whether it is one
        if last - k > 1 and (kind := w.kind(run[last - 1], 4)):
            out.append((facing, " ".join(street[:-1]), kind, 2 * typed, set(run[:end])))
    return out


def read_parts(address: str, country: str) -> tuple[list[tuple[str, str, str, str, str]], str]:
    """The readings of an address, and its unit ("" if it states none)."""
    w = _Words(tokens(address), country)
    t = w.t
    _states(w)
    _units(w)
    found: list[tuple[str, tuple[str, str, str, int, set[int]], set[int], int]] = []
    numbers = [i for i, x in enumerate(t) if _number(x) and w.free(i)]
    words = {i for i in range(len(t)) if w.word(i) and t[i] not in _NUMBER_WORDS}
    for i in numbers:
        number = "/".join(x.lstrip("0") or "0" for x in re.split("[/-]", t[i]))
        at, j = {i}, i + 1
        if j < len(t) and w.free(j):
            if w.before and t[j] in SUFFIXES and t[j] not in w.kinds:
                number, j = number + SUFFIXES[t[j]], j + 1
            elif not w.before and re.fullmatch(r"[a-z]", t[j]) and (t[j] not in ("n", "s", "e", "w") or j + 1 == len(t) or t[j + 1] == ","):
                number, j = number + t[j], j + 1
        at |= set(range(i, j))
        score = (i > 0 and t[i - 1] in _NUMBER_WORDS) - 3 * (len(t[i]) >= 5 and t[i].isdigit() and len(numbers) > 1)
        after, before = _run(w, j, 1), [k for k in _run(w, i - 1, -1)]
        k = i - 1
        while k >= 0 and t[k] in _NUMBER_WORDS:
            k -= 1
        before = before or _run(w, k, -1)
        runs = [(after, 0), (before, -1)]
        if not after:  # the street may be the next part, or where the number stands alone the last one
            k = j
            while k < len(t) and w.used[k]:
                k += 1
            runs = [(_run(w, k, 1), -1 if before else 0), (before, -1)]
            if not before and not runs[0][0]:
                runs = [(_run(w, max((x for x in words if x < i), default=-1), -1), -1)]
        for run, worth in runs:
            if run:
                rest = words - set(run) - at
                found += [(number, s, at, score + worth + s[3]) for s in _streets(w, run, bool(rest))]
    best = max((f[3] for f in found), default=0)
    parted = any(x == "," for x in t)
    out: dict[tuple[str, str, str, str, str], None] = {}
    for number, (direction, street, kind, _, taken), at, score in found:
        if score < best:
            continue
        rest = [i for i in sorted(words - taken - at) if not (w.before and t[i] in w.kinds)]
        runs: list[list[int]] = []
        for i in rest:
            if runs and runs[-1][-1] == i - 1:
                runs[-1].append(i)
            else:
                runs.append([i])
        towns = [" ".join(t[i] for i in r) for r in runs]
        if not parted:  # words of something else may stand beside the town
            towns += [" ".join(t[i] for i in part) for r in runs for m in range(1, len(r)) for part in (r[m:], r[:m])]
        towns = [x for x in dict.fromkeys(towns) if len(x) >= 2]
        for town in towns or [""]:
            out[(number, direction, street, kind, town)] = None
    return list(out), w.unit


def readings(address: str, country: str) -> list[tuple[str, str, str, str, str]]:
    """(number, direction, street, type, town) of an address; more than one where it is open what is what."""
    return read_parts(address, country)[0]
