"""Full-text search: analysis, web-style queries, ranking and snippets.

An analysed text is one string of terms with a space on both sides of each (" the terms of it "), so that terms and
phrases are substring tests that stay in the JVM. Stemming and cover density, which have no built-in, are Arrow
functions; ranking and snippets are meant for rows that matched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English words that carry no meaning in a search.
STOP_WORDS = tuple(
    """a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further
had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own
s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will
with you your yours yourself yourselves""".split()
)


def analyse(c: Column) -> Column:
    """Words of a-z and 0-9 in lower case, each with a space before and after; null for null."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))


_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Fixed values of the published English stemming algorithm.
_STEP2 = [x.split(">") for x in "ization>ize ational>ate fulness>ful ousness>ous iveness>ive tional>tion biliti>ble lessli>less entli>ent ation>ate alism>al aliti>al ousli>ous iviti>ive fulli>ful enci>ence anci>ance abli>able izer>ize ator>ate alli>al bli>ble ogi>og li>".split()]
_STEP3 = [x.split(">") for x in "ational>ate tional>tion alize>al icate>ic iciti>ic ative> ical>ic ness> ful>".split()]
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()
_SPECIAL = dict(x.split(">") for x in "skis>ski skies>sky dying>die lying>lie tying>tie idly>idl gently>gentl ugly>ugli early>earli only>onli singly>singl sky>sky news>news howe>howe atlas>atlas cosmos>cosmos bias>bias andes>andes".split())
_KEEP = set("inning outing canning herring earring proceed exceed succeed".split())


def _regions(w: str) -> tuple[int, int]:
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    find = lambda at: next((i + 1 for i in range(at + 1, len(w)) if w[i] not in _VOWELS and w[i - 1] in _VOWELS), len(w))
    r1 = find(0) if r1 is None else r1
    return r1, find(r1)


def _short(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-3] not in _VOWELS and w[-2] in _VOWELS and w[-1] not in _VOWELS + "wxY"


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """English stem of a word in lower case, by the published second version of the Porter algorithm."""
    if len(word) < 3:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = re.sub(r"(?<=[aeiouy])y|^y", "Y", word)
    r1, r2 = _regions(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _KEEP:
        return w
    if w.endswith(("eedly", "eed")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                if any(c in _VOWELS for c in w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLES):
                        w = w[:-1]
                    elif r1 >= len(w) and _short(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for end, to in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1 and not (end == "ogi" and w[-4:-3] != "l") and not (end == "li" and w[-3:-2] not in "cdeghkmnrt"):
                w = w[: -len(end)] + to
            break
    for end, to in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + to
            break
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and not (end == "ion" and w[-4:-3] not in "st"):
                w = w[: -len(end)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@F.pandas_udf(T.StringType())
def stemmed(s: pd.Series) -> pd.Series:
    """Analysed text to stems without stop words, in the same form."""
    stop = set(STOP_WORDS)
    return s.map(lambda x: None if x is None else " " + " ".join(stem(w) for w in x.split() if w not in stop) + " ")


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]
    negated: bool = False


def parse(query: str, stems: bool = False) -> list[list[Term]]:
    """A web-style query as alternatives of terms: bare words are all wanted, "quoted words" in this order, OR between
    alternatives, a leading - excludes. Anything can be parsed; an unbalanced quote runs to the end. Stop words count
    for nothing, but stay in quoted words that aren't stemmed."""
    out: list[list[Term]] = [[]]
    stop = set(STOP_WORDS)
    for m in re.finditer(r'(-?)"([^"]*)(?:"|$)|(-?)([^\s"]+)', query):
        quoted = m[2] is not None
        if not quoted and m[4].lower() == "or" and not m[3]:
            out.append([])
            continue
        words = [stem(w) if stems else w for w in re.findall("[a-z0-9]+", (m[2] if quoted else m[4]).lower()) if w not in stop or (quoted and not stems)]
        if words:
            out[-1].append(Term(tuple(words), bool(m[1] or m[3])))
    return [a for a in out if a]


def has(text: Column, term: Term) -> Column:
    found = text.contains(f" {' '.join(term.words)} ")
    return ~found if term.negated else found


def matches(text: Column, *queries: str, stems: bool = False) -> Column:
    """Whether an analysed text matches any of the queries. A query of no terms, or of excluded terms alone without a
    text to hold against, matches as its terms say; no terms match nothing."""
    alternatives = [a for q in queries for a in parse(q, stems)]
    if not alternatives:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [reduce(lambda x, y: x & y, [has(text, t) for t in a]) for a in alternatives])


def wanted(*queries: str, stems: bool = False) -> list[str]:
    """Distinct words of the terms that aren't excluded, in order."""
    return list(dict.fromkeys(w for q in queries for a in parse(q, stems) for t in a if not t.negated for w in t.words))


def frequency_rank(text: Column, words: list[str], weight: float = 0.1) -> Column:
    """r / (r + 1), r the weighted logs of term frequencies: a rank that needs no positions."""
    terms = F.split(F.trim(text), " ")
    often = lambda w: F.size(F.filter(terms, lambda x: x == w)).cast("double")
    r = sum((F.log1p(often(w)) for w in words), F.lit(0.0)) * weight
    return F.coalesce(r / (r + 1), F.lit(0.0))


def covers(terms: list[str], words: set[str]) -> list[tuple[int, int, int]]:
    """Shortest stretches with all of the words that occur: (first, last, words between)."""
    at = [(i, t) for i, t in enumerate(terms) if t in words]
    need = len({t for _, t in at})
    out, inside, lo = [], {}, 0
    for i, t in at:
        inside[t] = inside.get(t, 0) + 1
        while len(inside) == need:
            p, q = at[lo]
            if inside[q] == 1:
                out.append((p, i, 0))
                del inside[q]
            else:
                inside[q] -= 1
            lo += 1
    return out


def cover_density(words: list[str], weight: float = 0.1):
    """Arrow function of an analysed text: cover density (Clarke, Cormack and Tudhope) damped as r / (r + 1). Each
    cover counts its words' weight over the words it holds beyond them."""
    chosen = set(words)

    @F.pandas_udf(T.DoubleType())
    def rank(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> float:
            if not x:
                return 0.0
            terms = x.split()
            r = 0.0
            for a, b, _ in covers(terms, chosen):
                own = sum(t in chosen for t in terms[a : b + 1])
                r += own * weight / (1 + (b - a + 1 - own))
            return r / (r + 1)

        return s.map(one)

    return rank


def headline(words: list[str], most: int = 55, least: int = 22, fragments: int = 1, between: str = " … ", stems: bool = False):
    """Arrow function of a text: the densest stretches of at most `most` words around wanted ones, the first of equal
    ones; the beginning of the text where none occurs."""
    chosen = set(words)

    @F.pandas_udf(T.StringType())
    def cut(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if x is None:
                return None
            tokens = x.split()
            plain = [re.sub("[^a-z0-9]+", "", t.lower()) for t in tokens]
            hits = [i for i, t in enumerate(plain) if (stem(t) if stems else t) in chosen]
            if not hits:
                return " ".join(tokens[:least])
            taken: list[tuple[int, int]] = []
            for _ in range(fragments):
                best = None
                for k, lo in enumerate(hits):
                    if any(a <= lo < b for a, b in taken):
                        continue
                    n = sum(1 for h in hits[k:] if h < lo + most)
                    if best is None or n > best[0]:
                        best = (n, lo)
                if best is None:
                    break
                lo = max(0, best[1] - least // 4)
                hi = min(len(tokens), lo + most)
                if any(a < hi and lo < b for a, b in taken):
                    continue
                taken.append((lo, hi))
            return between.join(" ".join(tokens[a:b]) for a, b in sorted(taken))

        return s.map(one)

    return cut
