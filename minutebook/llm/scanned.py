"""Noise in text from scanned pages (problem 5).

The lines of a page are labelled by a hidden Markov model over layout features: running header or footer, printed page
number, body, body that begins a paragraph, blank. A state emits two features of a line, its form and place on the
page and what sets it apart from the line before it. Features are computed once and kept; the model is estimated from
all pages, first from plain rules, then from its own labels. Headers must return on another page of their document.
Broken and misread words are judged by a vocabulary of all pages: the form that the corpus uses far more often wins.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minutebook.session import cut

# What scanning makes of letters, as "read>printed"; months; marks at the end of a broken line.
CONFUSIONS = [tuple(x.split(">")) for x in "c>e ri>n f>t 0>o cl>d 5>s 1>l 1>i ii>u rn>m q>g b>h vv>w ü>ti ﬁ>fi ﬂ>fl @>a 8>b 6>b 9>g |>l !>l !>i |>i e>c h>b li>h nn>m iii>m tl>d lc>k ﬀ>ff".split()]
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
BREAK_MARKS = "-­¬‐‑"

DATE = re.compile(rf"(?i)\b(?:{MONTHS})\s+\d{{1,2}}\s*,?\s+\d{{4}}\b|\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}\b|\b\d{{4}}-\d{{1,2}}-\d{{1,2}}\b|\b\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{4}}\b")
YEAR = re.compile(r"\d{4}")
_N = r"(?:\d{1,4}|[ivxlc]{1,6})"
PAGE_NUMBER = re.compile(rf"(?i)^[\s\[({{<~*=_.\-–—|]*(?:(?:page|pages|pg|p|sheet|folio)\b[.:#\s]*(?:no\.?\s*)?{_N}|\d{{1,4}})(?:\s*(?:/|of|\||-|–)\s*\d{{1,4}})?[\s\])}}>~*=_\-–—|]*$")
# A lone number that was misread (l4, I, |2, 1O) or is roman; only at page edges a page number.
_M = r"[\dlIOoS|]{1,4}"
_ROMAN = r"(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})|(?=[IVXLC])(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})"
LONE_NUMBER = re.compile(rf"^[\s\[({{<~*=_.\-–—]*(?:(?i:page|pages|pg|p|sheet|folio)\b[.:#\s]*(?i:no\.?\s*)?)?(?:{_M}|{_ROMAN})(?:\s*(?:/|of|-|–)\s*{_M})?[\s\])}}>~*=_\-–—]*$")
WORD = re.compile(r"@?[^\W_]+(?:[@'’\-|!]?[^\W_]+)*@?")
TAIL = re.compile(rf"([^\W_][^\s]*?)[{BREAK_MARKS}][ \t\r]*$")
HEAD = re.compile(r"^\s*(@?[^\W_]+(?:[@'’\-]?[^\W_]+)*)")



def tail_of(line: str) -> re.Match[str] | None:
    """The match of a line that ends with a break mark after a word."""
    return TAIL.search(line) if line.rstrip(" \t\r")[-1:] in MARKS else None


MARKS = set(BREAK_MARKS)
STATES = "HPBSX"  # header, page number, body, body that begins a paragraph, blank
BODY = (STATES.index("B"), STATES.index("S"))
SHAPES = ("blank", "number", "lone", "digits", "table", "title", "long title", "dated", "short", "text")
PLACES = "fsmnl"
#: What sets a line apart from the body line before it: the gap between (first of the page, blank, next line), an
#: indent, whether that line is short, whether it ends a sentence, and how this one begins.
CUES = ("^bn", "-i", "fs", ",.", "lud")


def place_of(rank: int, count: int) -> str:
    """Of the line's rank among the lines that aren't blank: f first, s second, l last, n next to last, m between."""
    return "f" if rank == 0 else "l" if rank == count - 1 else "s" if rank == 1 else "n" if rank == count - 2 else "m"


def shape_of(line: str) -> str:
    s = line.strip()
    if not s:
        return "blank"
    if PAGE_NUMBER.match(s):
        return "number" if len(s) <= 3 or not s.isdigit() else "digits"
    if LONE_NUMBER.match(s):
        return "lone"
    if not s[0].isalpha() and s.upper() == s.lower():  # no letters
        return "digits"
    if "\t" in s:
        return "table"
    if YEAR.search(s) and DATE.search(s):
        if s.endswith((".", ",", ";")) or sum(w[:1].isupper() or not w[:1].isalpha() for w in s.split()) * 2 <= len(s.split()):
            return "dated"
        return "title" if len(s) <= 110 else "long title"
    return "short" if len(s) < 40 else "text"


def features(lines: list[str]) -> tuple[bytes, bytes, bytes]:
    """A byte a line each: form and place, cue, and the label by plain rules from which estimation starts."""
    ranks = [i for i, x in enumerate(lines) if x.strip()]
    rank = {i: k for k, i in enumerate(ranks)}
    lengths = sorted(len(lines[i].rstrip()) for i in ranks)
    usual = lengths[len(lengths) * 9 // 10] if lengths else 0
    forms, cues, labels = bytearray(), bytearray(), bytearray()
    before, blank, margin = "", True, 0
    for i, line in enumerate(lines):
        if i not in rank:
            forms.append(0)
            cues.append(0)
            labels.append(STATES.index("X"))
            blank = True
            continue
        shape, place = shape_of(line), place_of(rank[i], len(ranks))
        s = line.strip()
        indent = len(line) - len(line.lstrip())
        cue = (
            0 if not before else 1 if blank else 2, int(indent > margin + 1), int(len(before) * 10 < usual * 7), int(before.endswith((".", "!", "?", ":", "”", '"'))),
            0 if s[0].islower() else 1 if s[0].isalpha() or s[0] in "“\"'‘(" else 2,
        )
        code = 0
        for values, c in zip(CUES, cue):
            code = code * len(values) + c
        forms.append(1 + (SHAPES.index(shape) - 1) * len(PLACES) + PLACES.index(place))
        cues.append(code)
        if shape in ("number", "lone") and place != "m":
            labels.append(STATES.index("P"))
        elif shape in ("title", "long title") and place != "m":
            labels.append(STATES.index("H"))
        else:
            broken = before[-1:] in MARKS and before[-1:] != ""
            begins = not broken and (cue[0] == 0 and cue[4] > 0 or cue[0] == 1 and (cue[3] == 1 or cue[4] > 0) or cue[1] == 1 or cue[2] == cue[3] == 1 and cue[4] > 0)
            labels.append(STATES.index("S" if begins else "B"))
            before, margin = line.rstrip(), indent if cue[1] == 0 else margin
        blank = False
    return bytes(forms), bytes(cues), bytes(labels)


FORMS = 1 + (len(SHAPES) - 1) * len(PLACES)
ALL_CUES = math.prod(len(v) for v in CUES)


def is_lone(form: int) -> bool:
    """A misread or roman number at the edge of a page."""
    return form > 0 and SHAPES[1 + (form - 1) // len(PLACES)] == "lone" and PLACES[(form - 1) % len(PLACES)] != "m"


class Markov:
    """Log probabilities of moves and of what the states emit, from counts (moves, forms, cues) of labelled lines. The
    two states of body share their forms, and tell themselves apart by cues; to the other states a cue says nothing."""

    def __init__(self, moves: np.ndarray, forms: np.ndarray, cues: np.ndarray):
        n = len(STATES)
        body = list(BODY)
        forms = forms.astype(float)
        forms[body] = forms[body].sum(axis=0)
        cues = cues.astype(float)
        general = cues.sum(axis=0)
        cues[[k for k in range(n) if k not in BODY]] = general
        share = lambda x, least: np.log((x + least) / (x + least).sum(axis=1, keepdims=True))
        self.emit_form, self.emit_cue = share(forms, 0.01), share(cues, 0.01)
        move = share(moves.astype(float), 0.1)  # rows: each state and the begin; columns: each state and the end
        self.start, self.move, self.end = move[n, :n], move[:n, :n], move[:n, n]

    def label(self, pages: list[tuple[bytes, bytes]]) -> list[np.ndarray]:
        """The most likely sequence of states of each page (Viterbi), line by line for all pages at once."""
        order = sorted(range(len(pages)), key=lambda k: -len(pages[k][0]))
        sizes = np.array([len(pages[k][0]) for k in order], dtype=np.int64)
        out: list[np.ndarray] = [np.empty(0, dtype=np.int8)] * len(pages)
        if not len(sizes) or sizes[0] == 0:
            return out
        at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        forms, cues = (np.frombuffer(b"".join(pages[k][j] for k in order), dtype=np.uint8) for j in (0, 1))
        back = np.zeros((len(forms), len(STATES)), dtype=np.int8)
        score = self.start + self.emit_form.T[forms[at[sizes > 0]]] + self.emit_cue.T[cues[at[sizes > 0]]]
        final = np.zeros((len(order), len(STATES)))
        final[: len(score)] = score
        for t in range(1, sizes[0]):
            live = int(np.searchsorted(-sizes, -t, side="left"))  # pages of more than t lines
            paths = final[:live, :, None] + self.move
            best = paths.argmax(axis=1)
            now = at[:live] + t
            back[now] = best
            final[:live] = np.take_along_axis(paths, best[:, None, :], axis=1)[:, 0] + self.emit_form.T[forms[now]] + self.emit_cue.T[cues[now]]
        state = (final + self.end).argmax(axis=1)
        labels = np.zeros(len(forms), dtype=np.int8)
        for t in range(int(sizes[0]) - 1, -1, -1):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            now = at[:live] + t
            labels[now] = state[:live]
            state[:live] = back[now, state[:live]]
        for j, k in enumerate(order):
            out[k] = labels[at[j] : at[j] + sizes[j]]
        return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = list(zip(*(features(c.split("\n")) for c in batch.column("content").to_pylist()))) or [()] * 3
        arrays = [pa.array(c, pa.binary()) for c in cols]
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "forms", "cues", "rules"])


def _line_counts(model: Markov | None):
    """Counts of moves, forms and cues of the labels, as one row of a fixed number of sums."""
    n = len(STATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, forms, cues = np.zeros((n + 1, n + 1), np.int64), np.zeros((n, FORMS), np.int64), np.zeros((n, ALL_CUES), np.int64)
        for batch in batches:
            pages = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            labels = model.label([p[:2] for p in pages]) if model else [np.frombuffer(p[2], dtype=np.int8) for p in pages]
            for (f, c, _), s in zip(pages, labels):
                np.add.at(forms, (s, np.frombuffer(f, dtype=np.uint8)), 1)
                np.add.at(cues, (s, np.frombuffer(c, dtype=np.uint8)), 1)
                np.add.at(moves, (np.concatenate([[n], s]), np.concatenate([s, [n]])), 1)
        flat = np.concatenate([x.ravel() for x in (moves, forms, cues)])
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(flat[some], pa.int64())], ["at", "n"])

    return run


def fit_lines(lines: DataFrame, rounds: int = 2) -> Markov:
    """The line model of all pages. What reaches the driver is a table of states by features, of fixed size."""
    n, model = len(STATES), None
    sizes = ((n + 1, n + 1), (n, FORMS), (n, ALL_CUES))
    for _ in range(rounds):
        flat = np.zeros(sum(a * b for a, b in sizes))
        rows = lines.select("forms", "cues", "rules").mapInArrow(_line_counts(model), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        flat[rows["at"].to_numpy(dtype=np.int64)] = rows["n"]
        parts = np.split(flat, np.cumsum([a * b for a, b in sizes])[:-1])
        model = Markov(*(x.reshape(size) for x, size in zip(parts, sizes)))
    return model


@dataclass
class Scan:
    """Pages with the features of their lines (page_id, document_id, page_number, content, forms, cues, rules), and the
    line model estimated from them."""

    lines: DataFrame
    model: Markov


def scanned(pages: DataFrame) -> Scan:
    """Null and empty pages hold no lines."""
    number = F.col("page_number") if "page_number" in pages.columns else F.col("id")
    some = pages.where(F.col("content").isNotNull() & (F.col("content") != "")).select(F.col("id").alias("page_id"), "document_id", number.cast("int").alias("page_number"), "content")
    schema = "page_id long, document_id long, page_number int, content string, forms binary, cues binary, rules binary"
    lines = cut(some.mapInArrow(_featured, schema))
    return Scan(lines, fit_lines(lines))


def broken_at(lines: list[str], i: int, body: list[bool]) -> tuple[str, str, int] | None:
    """(head, tail, line) of a word that line i may break: what stands before the mark, and the next body line's first
    word with its line number; an empty tail where the page ends."""
    m = tail_of(lines[i])
    if not m:
        return None
    words = WORD.findall(m[1])
    if not words or not m[1].endswith(words[-1]) or not words[-1][-1].isalpha() and words[-1][-1] not in "015@":
        return None
    for j in range(i + 1, len(lines)):
        if body[j]:
            n = HEAD.match(lines[j])
            return (words[-1], n[1], j) if n else None
    return words[-1], "", -1


def page_words(lines: list[str], body: list[bool]) -> Iterator[tuple[int, str]]:
    """(line, word) of the body; a broken word counts whole, on the line where it begins."""
    skip: dict[int, int] = {}
    for i, line in enumerate(lines):
        if not body[i]:
            continue
        words = WORD.findall(line)
        if i in skip:
            words = words[1:]
        b = broken_at(lines, i, body)
        if b and words:
            yield from ((i, w) for w in words[:-1])
            yield i, b[0] + b[1]
            if b[2] >= 0:
                skip[b[2]] = 1
        else:
            yield from ((i, w) for w in words)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for content in batch.column(0).to_pylist():
            lines = content.lower().split("\n")
            for i, line in enumerate(lines):
                if m := tail_of(line):  # its last word is a part of one
                    lines[i] = line[: m.start(1)]
            counts.update(WORD.findall("\n".join(lines)))
        if len(counts) > 300_000:
            yield emit(counts)
            counts = Counter()
    yield emit(counts)


def corrections_of(word: str) -> set[str]:
    """What a word may have been in print, by one confusion, at one place or all places."""
    out = set()
    for read, printed in CONFUSIONS:
        at = word.find(read)
        if at < 0:
            continue
        out.add(word.replace(read, printed))
        while at >= 0:
            out.add(word[:at] + printed + word[at + len(read) :])
            at = word.find(read, at + 1)
    out.discard(word)
    return out


def odd(word: str) -> bool:
    """A word that no print has: a digit or an @ among letters, or a ligature."""
    if word.isascii() and word.isalpha():
        return False
    if re.search(r"[ﬀ-ﬆ]", word):
        return True
    letters = sum(c.isalpha() for c in word)
    if letters < 2 or re.search(r"^\d+(?:st|nd|rd|th|s|a|b|am|pm|k|m|mm|cm|km|ft)$", word, re.I):
        return False
    return bool(re.search(r"[^\W\d_][0158@|!][^\W\d_]|^[015@][^\W\d_]{2,}|[^\W\d_]{2,}[015@]$", word)) and not re.search(r"\d{2}", word)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(w, n, c, odd(w)) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for c in corrections_of(w)]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())], ["word", "n", "printed", "odd"])


def vocabulary(lines: DataFrame) -> DataFrame:
    """(word, n) in lower case, of all pages, without the parts of broken words."""
    return cut(lines.select("content").mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


def misread(vocab: DataFrame, words: DataFrame, rate: float = 0.03) -> DataFrame:
    """(word, printed): of words (word, n) those that a confusion turns into a far more frequent word of the vocabulary.
    A form may be up to `rate` of the right one's occurrences, or occur twice; else both are words. A form that no print
    has needs no such proof."""
    tried = words.mapInArrow(_candidates, "word string, n long, printed string, odd boolean")
    met = tried.join(vocab.select(F.col("word").alias("printed"), F.col("n").alias("m")), "printed")
    met = met.where(F.col("odd") | (F.col("m") >= 3) & (F.col("m") >= 3 * F.col("n")) & ((F.col("n") <= 2) | (F.col("n") <= F.col("m") * F.lit(rate))))
    return met.groupBy("word").agg(F.max(F.struct("m", "printed")).alias("b")).select("word", F.col("b.printed").alias("printed"))


#: Bits of the Bloom filter a word, and the bounds of its size: 8 kB and 16 MB, a million words. Beyond that it lets
#: more words pass, which the exact join takes out.
BITS_A_WORD, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27


def _hashes(word: str, bits: int) -> list[int]:
    h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=12).digest(), "little")
    return [(h >> (32 * k)) % bits for k in range(3)]


def _filter_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, int] = {}
        for batch in batches:
            for w in batch.column(0).to_pylist():
                for h in _hashes(w, bits):
                    words[h >> 5] = words.get(h >> 5, 0) | 1 << (h & 31)
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.int64()), pa.array(list(words.values()), pa.int64())], ["slot", "bits"])

    return run


def word_filter(words: DataFrame) -> bytes:
    """A Bloom filter of a column of words, sized by their number; it only saves rows, the exact join follows."""
    bits = LEAST_BITS
    wanted = min(MOST_BITS, BITS_A_WORD * words.count())
    while bits < wanted:
        bits *= 2
    rows = words.select("word").mapInArrow(_filter_rows(bits), "slot long, bits long").groupBy("slot").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()
    out = np.zeros(bits // 32, dtype=np.uint32)
    out[rows["slot"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out.tobytes()


def header_keys(line: str) -> list[str]:
    """Up to case and spacing, with and without a number before or after."""
    s = re.sub(r"\s+", " ", line).strip().lower()
    return list(dict.fromkeys(re.sub(r"\s", "", x) for x in (s, re.sub(r" \d{1,4}$", "", s), re.sub(r"^\d{1,4} ", "", s))))


def _signs(model: Markov, words: bytes):
    """Pages to what may be a fault: (page_id, document_id, line_no, sign, a, b)."""
    bits = np.frombuffer(words, dtype=np.uint32)
    size = len(bits) * 32
    known: dict[str, str] = {}

    def sign_of(w: str) -> str:
        """odd, glyph for what the filter holds, or empty; kept for the words of a worker, within a bound."""
        low = w.lower()
        sign = "odd" if odd(low) else "glyph" if len(low) > 1 and all(int(bits[h >> 5]) >> (h & 31) & 1 for h in _hashes(low, size)) else ""
        if len(known) > 200_000:
            known.clear()
        known[w] = sign
        return sign

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            page_ids, docs, contents, forms, cues = (batch.column(k).to_pylist() for k in ("page_id", "document_id", "content", "forms", "cues"))
            for page, doc, content, form, labels in zip(page_ids, docs, contents, forms, model.label(list(zip(forms, cues)))):
                lines = content.split("\n")
                body = np.isin(labels, BODY).tolist()
                for i in np.flatnonzero(labels == STATES.index("P")).tolist():
                    if PAGE_NUMBER.match(lines[i].strip()) or is_lone(form[i]):
                        out.append((page, doc, i, "page_number", "", ""))
                for i in np.flatnonzero(labels == STATES.index("H")).tolist():
                    out += [(page, doc, i, "header", k, "") for k in header_keys(lines[i])]
                for i, line in enumerate(lines):
                    if body[i] and (b := broken_at(lines, i, body)):
                        mark = "hard" if line.rstrip().endswith("-") else "soft"
                        out.append((page, doc, i, f"hyphen {mark}", (b[0] + b[1]).lower(), f"{b[0]}-{b[1]}".lower()))
                for i, w in page_words(lines, body):
                    sign = known.get(w)
                    if sign is None:
                        sign = sign_of(w)
                    if sign:
                        out.append((page, doc, i, sign, w.lower(), w))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), *[pa.array(c, pa.string()) for c in cols[3:]]], ["page_id", "document_id", "line_no", "sign", "a", "b"])

    return run


def faults(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, fault, was, now): the faulty lines of all pages; was and now are the word as it stands and as
    it was printed, for hyphen and glyph. A page that arrives twice counts once; null and empty pages have no faults."""
    return faults_of(scanned(pages))


def faults_of(scan: Scan) -> DataFrame:
    vocab = vocabulary(scan.lines)
    wrong = cut(misread(vocab, vocab))
    signs = cut(scan.lines.select("page_id", "document_id", "content", "forms", "cues").mapInArrow(_signs(scan.model, word_filter(wrong)), "page_id long, document_id long, line_no int, sign string, a string, b string").distinct())
    is_ = lambda *names: signs.where(F.col("sign").isin(*names))
    found = lambda df, fault, was, now: df.select("page_id", "line_no", F.lit(fault).alias("fault"), was.alias("was"), now.alias("now"))
    none = F.lit(None).cast("string")

    head = is_("header")
    back = head.groupBy("document_id", "a").agg(F.countDistinct("page_id").alias("pages")).where("pages > 1").drop("pages")
    headers = head.join(back, ["document_id", "a"], "left_semi")

    parts = is_("hyphen soft", "hyphen hard")
    joined = parts.join(vocab.select(F.col("word").alias("a"), F.col("n").alias("whole")), "a", "left")
    joined = joined.join(vocab.select(F.col("word").alias("b"), F.col("n").alias("own")), "b", "left")
    broken = joined.where(F.coalesce("own", F.lit(0)) <= F.coalesce("whole", F.lit(0)))

    # words that are whole only once joined may be missing from the vocabulary's own misread words
    late = broken.where(F.col("whole").isNull()).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n"))
    wrong_late = misread(vocab, late)
    all_wrong = wrong.unionByName(wrong_late).distinct()
    glyph = is_("glyph").join(all_wrong.select(F.col("word").alias("a"), "printed"), "a")
    glyph = glyph.unionByName(broken.join(wrong_late.select(F.col("word").alias("a"), "printed"), "a").select(*glyph.columns))
    strange = is_("odd").join(all_wrong.select(F.col("word").alias("a"), "printed"), "a", "left")
    every = found(headers, "header", none, none)
    every = every.unionByName(found(is_("page_number"), "page_number", none, none))
    every = every.unionByName(found(broken, "hyphen", F.col("b"), F.col("a")))
    every = every.unionByName(found(glyph, "glyph", F.col("b"), F.col("printed"))).unionByName(found(strange, "glyph", F.col("b"), F.col("printed")))
    return every.distinct()


def _like(was: str, now: str) -> str:
    return now.upper() if was.isupper() and len(was) > 1 else now[:1].upper() + now[1:] if was[:1].isupper() else now


def _mended(line: str, fixes: dict[str, str]) -> str:
    """line with the words in fixes put right, each as a whole word."""
    return WORD.sub(lambda m: _like(m[0], fixes[m[0].lower()]) if m[0].lower() in fixes else m[0], line) if fixes else line


LAST_WORD = re.compile(rf"({WORD.pattern})$")


def page_pieces(lines: list[str], labels: list[int], found: list[dict]) -> list[tuple[str, bool, bool]]:
    """(text, begins, open) of the paragraphs of a page, without headers and page numbers, with broken words joined and
    misread ones put right: begins is whether the text begins a paragraph, open whether its last word goes on."""
    gone = {f["line_no"] for f in found if f["fault"] in ("header", "page_number")}
    broken = {f["line_no"] for f in found if f["fault"] == "hyphen"}
    fixes: dict[int, dict[str, str]] = {}
    for f in found:
        if f["fault"] == "glyph" and f["now"]:
            fixes.setdefault(f["line_no"], {})[f["was"].lower()] = f["now"]
    out: list[tuple[str, bool, bool]] = []
    text, begins, open_, spanning = "", True, False, {}
    for i, line in enumerate(lines):
        s = re.sub(r"[ \t\r\xa0]+", " ", line).strip()
        if i in gone or not s:
            continue
        own = fixes.get(i, {})
        starts = labels[i] not in BODY or STATES[labels[i]] == "S"
        if text and starts and not open_:
            out.append((text, begins, False))
            text, begins = "", True
        if not text:
            begins = starts
        head, tail = (LAST_WORD.search(text), HEAD.match(s)) if open_ else (None, None)
        whole = head and tail and next((spanning[w] for w in ((head[1] + tail[1]).lower(), f"{head[1]}-{tail[1]}".lower()) if w in spanning), None)
        if whole:
            text = text[: head.start()] + _like(head[1], whole) + _mended(s[tail.end() :], own)
        else:
            text = f"{text}{'' if open_ or not text else ' '}{_mended(s, own)}"
        open_ = i in broken
        if open_:
            text, spanning = re.sub(f"[{BREAK_MARKS}]$", "", text), own
        elif re.search(f"[^\\W\\d_][{BREAK_MARKS}]$", text):  # a word with a hyphen of its own goes on
            text, open_, spanning = text[:-1] + "-", True, {}
    if text:
        out.append((text, begins, open_))
    return out


def _pieces(model: Markov):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids, contents, forms, cues, found = (batch.column(k).to_pylist() for k in ("page_id", "content", "forms", "cues", "found"))
            keys = list(zip(batch.column("document_id").to_pylist(), batch.column("page_number").to_pylist(), ids))
            for key, content, labels, f in zip(keys, contents, model.label(list(zip(forms, cues))), found):
                started = 0
                for k, (text, begins, open_) in enumerate(page_pieces(content.split("\n"), labels.tolist(), f or [])):
                    started += begins
                    rows.append((*key, k, text, begins, open_, started))
            cols = list(zip(*rows)) or [()] * 8
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["document_id", "page_number", "page_id", "piece", "text", "begins", "open", "started"])

    return run


def paragraphs(scan: Scan, found: DataFrame) -> DataFrame:
    """(document_id, paragraph, first_page, last_page, text): the paragraphs of each document in order, from 0, whole
    over the ends of pages; pages by page_number, then id. found: (page_id, line_no, fault, was, now). A paragraph goes
    on over the end of a page where the next page's first line doesn't begin one, or a word is broken there. Null and
    empty pages hold none and end none. What passes from page to page are two flags and a count, so a document of very
    many pages has only these in one window."""
    own = found.groupBy("page_id").agg(F.collect_list(F.struct("line_no", "fault", "was", "now")).alias("found"))
    joined = scan.lines.drop("rules").join(own, "page_id", "left").select("page_id", "document_id", "page_number", "content", "forms", "cues", "found")
    pieces = cut(joined.mapInArrow(_pieces(scan.model), "document_id long, page_number int, page_id long, piece int, text string, begins boolean, open boolean, started int").distinct())
    page = ["document_id", "page_number", "page_id"]
    flags = pieces.groupBy(*page).agg(F.min_by("begins", "piece").alias("begins"), F.max_by("open", "piece").alias("open"), F.max("started").alias("started"))
    order = Window.partitionBy("document_id").orderBy("page_number", "page_id")
    flags = flags.withColumn("kept", F.col("begins") & F.coalesce(F.lag("open").over(order), F.lit(False)))  # a broken word holds it to the page before
    fresh = F.col("started") - F.col("kept").cast("int")
    flags = flags.withColumn("offset", F.coalesce(F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("kept").cast("int"))
    pieces = pieces.join(flags.select(*page, "offset"), page).withColumn("paragraph", F.col("offset") + F.col("started"))
    whole = pieces.groupBy("document_id", "paragraph").agg(
        F.min(F.struct("page_number", "page_id")).alias("first"), F.max(F.struct("page_number", "page_id")).alias("last"),
        F.sort_array(F.collect_list(F.struct("page_number", "page_id", "piece", "text", "open"))).alias("p"),
    )
    parts = F.transform("p", lambda x, i: F.concat(x["text"], F.when(x["open"] | (i == F.size("p") - 1), "").otherwise(" ")))
    least = F.min("paragraph").over(Window.partitionBy("document_id"))
    return whole.select("document_id", (F.col("paragraph") - least).alias("paragraph"), F.col("first.page_number").alias("first_page"), F.col("last.page_number").alias("last_page"), F.array_join(parts, "").alias("text"))
