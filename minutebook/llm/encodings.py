"""Text that was decoded with the wrong character encoding (problem 10).

Each document has a latent encoding chain: clean, or one of the chains below. Expectation-maximization fits two
things over all documents: how often each source uses each chain, and how often each non-ASCII character stands
between which neighbours in clean text. A run of characters that undoes to something far more usual is evidence for a
chain; weak evidence adds up within a document, and through the chain's frequency in its source also across documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutebook.session import cut

#: Chains as pairs (written as, read as), undone from the last to the first.
UTF8_READ_AS = ("latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp866", "gbk", "big5", "cp932")
BYTES_READ_AS = (("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("gbk", "cp1252"), ("big5", "cp1252"))
TWICE = ("latin-1", "cp1252", "mac_roman")
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    *((("utf-8", e),) for e in UTF8_READ_AS),
    *((("utf-8", a), ("utf-8", b)) for a in TWICE for b in TWICE),
    *((pair,) for pair in BYTES_READ_AS),
)
LOST = "�"
RUN = re.compile(r"[^\x00-\x7f]+")
#: Shares of a document's runs that may have passed through its chain; a part of a document may be garbled.
SHARES = (0.003, 0.03, 0.2, 0.7, 0.98)
#: Log of the number of characters in use that a block of ideographs stands for.
BLOCK = math.log(1000)
MULTIBYTE = {"gbk", "big5", "cp932"}


@lru_cache(maxsize=64)
def _leads(encoding: str) -> frozenset[str]:
    """Characters of an encoding that stand for the first byte of a UTF-8 sequence."""
    return frozenset(c for c, b in _table(encoding).items() if 0xC2 <= b <= 0xF4)


@lru_cache(maxsize=64)
def _table(encoding: str) -> dict[str, int]:
    """Character to byte of a one-byte encoding. Bytes it leaves undefined are read as control characters."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def _utf8_at(codes: list[int | None], i: int) -> int:
    """Length of the UTF-8 sequence of several bytes that begins at i, or 0."""
    first = codes[i]
    if first is None or not 0xC2 <= first <= 0xF4:
        return 0
    n = 2 if first < 0xE0 else 3 if first < 0xF0 else 4
    rest = codes[i + 1 : i + n]
    if len(rest) < n - 1 or any(x is None or not 0x80 <= x <= 0xBF for x in rest):
        return 0
    return n


#: Bytes of characters by encoding; bounded by the characters there are.
_WIDE: dict[str, dict[str, tuple]] = {}


def _undo_wide(run: str, read: str) -> str:
    """UTF-8 that was read in an encoding of two bytes a character: from each character on, whole UTF-8 sequences are
    taken until they end with a character; if they don't, the character stays."""
    codes: list[int | None] = []
    first: list[bool] = []
    known = _WIDE.setdefault(read, {})
    for c in run:
        own = known.get(c)
        if own is None:
            try:
                own = tuple(c.encode(read))
            except UnicodeEncodeError:
                own = (None,)
            known[c] = own
        first += (True, False)[: len(own)] if len(own) < 3 else (True, *(False,) * (len(own) - 1))
        codes += own
    first.append(True)
    starts = [i for i, x in enumerate(first) if x]
    out, k = [], 0
    while k < len(run):
        at = starts[k]
        while (n := _utf8_at(codes, at)) and not (first[at + n]):
            at += n
        back = None
        if n:
            try:
                back = bytes(codes[starts[k] : at + n]).decode("utf-8")
            except UnicodeDecodeError:
                back = None
        if back is None:
            out.append(run[k])
            k += 1
        else:
            out.append(back)
            k += sum(first[starts[k] : at + n])
    return "".join(out)


def _undo_step(run: str, written: str, read: str) -> str:
    if read in MULTIBYTE:
        return _undo_wide(run, read)
    if written == "utf-8" and _leads(read).isdisjoint(run):
        return run
    table = _table(read)
    codes = [table.get(c) for c in run]
    if written == "utf-8":
        out, i = [], 0
        while i < len(run):
            n = _utf8_at(codes, i)
            back = None
            if n:
                try:
                    back = bytes(codes[i : i + n]).decode("utf-8")
                except UnicodeDecodeError:
                    back = None
            if back is None:
                out.append(run[i])
                i += 1
            else:
                out.append(back)
                i += n
        return "".join(out)
    if written in MULTIBYTE:
        if any(c is None for c in codes):
            return run
        try:
            return bytes(codes).decode(written)
        except UnicodeDecodeError:
            return run
    out = []
    for c, code in zip(run, codes):
        try:
            out.append(c if code is None else bytes([code]).decode(written))
        except UnicodeDecodeError:
            out.append(c)
    return "".join(out)


@lru_cache(maxsize=1 << 16)
def undo(run: str, chain: int) -> str:
    """The run before the chain; parts that the chain can't have made stay as they are."""
    now = run
    for written, read in reversed(CHAINS[chain]):
        back = _undo_step(now, written, read)
        if back == now:
            return run
        now = back
    return now


@lru_cache(maxsize=1 << 14)
def _class(c: str) -> str:
    if not c:
        return "e"
    if c.islower():
        return "a"
    if c.isupper():
        return "A"
    if c.isspace():
        return " "
    if c.isdigit():
        return "9"
    return "W" if c.isalpha() else "."


@lru_cache(maxsize=1 << 14)
def _symbol(c: str) -> str:
    """Characters above the general symbols count by block of 256, so the table of symbols has a bound."""
    o = ord(c)
    if o < 0x3000:
        return c
    return "H" if 0x3400 <= o < 0xA000 else f"b{o >> 8}"


def _events(left: str, run: str, right: str) -> list[tuple[str, str]]:
    """(context, symbol) of each non-ASCII character of a run between its neighbours."""
    n = len(run)
    out = []
    for i, c in enumerate(run):
        if c > "\x7f":
            out.append((_class(run[i - 1] if i else left) + _class(run[i + 1] if i + 1 < n else right), _symbol(c)))
    return out


class Model:
    """Probability of a symbol and the class of its right neighbour, given the class of the left one, from counts."""

    def __init__(self, counts: dict[tuple[str, str], float]):
        self.joint = counts
        self.left: dict[str, float] = defaultdict(float)
        self.symbol: dict[str, float] = defaultdict(float)
        for (context, symbol), n in counts.items():
            self.left[context[0]] += n
            self.symbol[symbol] += n
        self.total = sum(self.symbol.values())
        self.cached: dict[tuple[str, str], float] = {}

    def log(self, context: str, symbol: str) -> float:
        key = (context, symbol)
        p = self.cached.get(key)
        if p is None:
            usual = (self.symbol.get(symbol, 0.0) + 0.02) / (self.total + 20.0) / 8
            p = math.log((self.joint.get(key, 0.0) + 0.5 * usual) / (self.left.get(context[0], 0.0) + 0.5))
            if len(symbol) > 1 or symbol == "H":  # one of many characters of its block
                p -= BLOCK
            self.cached[key] = p
        return p

    def run(self, left: str, run: str, right: str) -> float:
        return sum(self.log(*e) for e in _events(left, run, right))


def discounted(counts: dict[tuple[str, str], float], rate: float = 0.005) -> dict[tuple[str, str], float]:
    """First counts, less what garbling at a small rate would bring into each: where a rare character stands just where
    a frequent one is that a one-byte chain turns into it, the rare one is not yet evidence of clean text."""
    out = {}
    for (context, symbol), n in counts.items():
        inflow = 0.0
        if len(symbol) == 1:
            for chain, steps in enumerate(CHAINS):
                if len(steps) == 1 and steps[0] in BYTES_READ_AS:
                    back = undo(symbol, chain)
                    if back != symbol and len(back) == 1:
                        inflow += rate * counts.get((context, back), 0.0)
        out[context, symbol] = max(n - inflow, 0.0)
    return out


def runs_of(text: str) -> list[tuple[int, str, str, str]]:
    """(start, left neighbour, run, right neighbour) of each run of non-ASCII characters."""
    return [(m.start(), text[m.start() - 1 : m.start()], m.group(), text[m.end() : m.end() + 1]) for m in RUN.finditer(text)]


def evidence(model: Model, runs: list[tuple[int, str, str, str]], cache: dict) -> list[dict[int, float]]:
    """Of each run the gain of every chain that changes it: log-likelihood undone less as it stands."""
    out = []
    for _, left, run, right in runs:
        key = (_class(left), run, _class(right))
        gains = cache.get(key)
        if gains is None:
            gains = {}
            here = None
            for chain in range(len(CHAINS)):
                back = undo(run, chain)
                if back != run and LOST not in back:
                    if here is None:
                        here = model.run(left, run, right)
                    gains[chain] = model.run(left, back, right) - here
            if len(cache) > 1 << 16:
                cache.clear()
            cache[key] = gains
        out.append(gains)
    return out


def _log1pexp(x: float) -> float:
    return x if x > 30.0 else math.log1p(math.exp(x))


def posterior(gains: list[dict[int, float]], prior: list[float]) -> tuple[list[float], list[float]]:
    """Probabilities of clean and of each chain (in this order), and the best share of runs for each chain. prior: the
    same order, of the document's source."""
    some: dict[int, list[float]] = defaultdict(list)
    for g in gains:
        for chain, gain in g.items():
            some[chain].append(gain)
    logs, shares = [math.log(prior[0])], [0.0] * len(CHAINS)
    for chain in range(len(CHAINS)):
        own = some.get(chain)
        if not own or max(own) <= 0:
            logs.append(-math.inf)
            continue
        best = -math.inf
        for share in SHARES:
            rest = math.log1p(-share)
            # a run that the chain could have touched and that reads worse for it speaks against it; other runs don't
            odds = math.log(share) - rest
            score = sum(rest + _log1pexp(gain + odds) for gain in own)
            if score > best:
                best, shares[chain] = score, share
        logs.append(math.log(prior[chain + 1]) + best - math.log(len(SHARES)))
    top = max(logs)
    weights = [math.exp(x - top) for x in logs]
    total = sum(weights)
    return [w / total for w in weights], shares


FLAT = [0.97, *[0.03 / len(CHAINS)] * len(CHAINS)]


#: Distinct runs whose weights a partition holds before it adds up their characters.
HELD_RUNS = 200_000


def _e_step(model: Model | None):
    """Documents that aren't all ASCII to expected counts: ("s", source, chain) and ("c", context, symbol), added up
    within the partition. Equal runs between equal neighbours are weighed together before their characters count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains: Counter = Counter()
        counts: Counter = Counter()
        weights: Counter = Counter()  # (left, run, right, chain or -1 for as it stands) to how often
        cache: dict = {}

        def add_up() -> None:
            for (left, r, right, chain), n in weights.items():
                for e in _events(left, undo(r, chain) if chain >= 0 else r, right):
                    counts[e] += n
            weights.clear()

        for batch in batches:
            for source, text, prior in zip(*(batch.column(i).to_pylist() for i in range(3))):
                runs = runs_of(text)
                if len(weights) > HELD_RUNS:
                    add_up()
                if model is None:  # at first: what no chain could have made counts as clean, the rest by little
                    for _, left, r, right in runs:
                        touched = any(undo(r, c) != r for c in range(len(UTF8_READ_AS)))
                        weights[left, r, right, -1] += 0.05 if touched else 1.0
                    continue
                gains = evidence(model, runs, cache)
                p, shares = posterior(gains, prior or FLAT)
                for k, x in enumerate(p):
                    chains[source, k] += x
                for (_, left, r, right), g in zip(runs, gains):
                    clean = 1.0
                    for chain, gain in g.items():
                        x = p[chain + 1]
                        if x > 0.0:
                            odds = math.exp(min(gain, 50.0)) * shares[chain] / max(1e-9, 1 - shares[chain])
                            x *= odds / (1 + odds)
                            clean -= x
                            weights[left, r, right, chain] += x
                    if LOST not in r:
                        weights[left, r, right, -1] += max(clean, 0.0)
        add_up()
        rows = [("c", context, symbol, n) for (context, symbol), n in counts.items()] + [("s", source, str(k), n) for (source, k), n in chains.items()]
        kinds, a, b, n = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.float64())], ["kind", "a", "b", "n"])

    return run


SUMS = "kind string, a string, b string, n double"


def _priors(sums: DataFrame) -> DataFrame:
    """(source, prior): of each source how often each chain, drawn to the share over all sources and that to a flat
    one; so a source with few documents borrows from the others."""
    own = sums.where(F.col("kind") == "s").select(F.col("a").alias("source"), F.col("b").cast("int").alias("k"), "n")
    wide = own.groupBy("source").agg(*[F.sum(F.when(F.col("k") == i, F.col("n")).otherwise(0.0)).alias(f"k{i}") for i in range(len(FLAT))])
    total = wide.agg(*[F.sum(f"k{i}").alias(f"t{i}") for i in range(len(FLAT))]).first()  # one row
    t = [float(total[i] or 0.0) for i in range(len(FLAT))]
    everywhere = [(x + 2.0 * f) / (sum(t) + 2.0) for x, f in zip(t, FLAT)]
    size = sum((F.col(f"k{i}") for i in range(len(FLAT))), F.lit(0.0))
    prior = F.array(*[(F.col(f"k{i}") + F.lit(20.0 * everywhere[i])) / (size + F.lit(20.0)) for i in range(len(FLAT))])
    return wide.select("source", prior.alias("prior"))


#: A table of priors of at most this many sources (about 300 bytes each) is broadcast; a larger one joins by shuffle.
MOST_SOURCES = 20_000


def _with_prior(docs: DataFrame, priors: DataFrame | None) -> DataFrame:
    if priors is None:
        return docs.withColumn("prior", F.lit(None).cast("array<double>"))
    p = priors.select(F.col("source").alias("_source"), "prior")
    if priors.count() <= MOST_SOURCES:
        p = F.broadcast(p)
    return docs.join(p, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


FOREIGN = r"[^\x00-\x7f]"


def fit(documents: DataFrame, text: str = "text", source: str = "source", rounds: int = 3) -> tuple[Model, DataFrame]:
    """The clean-text model and the chain priors of each source, from all documents.

    What reaches the driver is the table of (context, symbol): at most 64 contexts times the code points below U+3000
    and the blocks above, whatever the number of documents. The priors stay a table, one row a source.
    """
    every = documents.select(F.col(source).alias("source"), F.col(text).alias("text"))
    docs = every.where(F.col("text").rlike(FOREIGN))
    # texts of ASCII are clean whatever the model
    plain = every.where(~F.col("text").rlike(FOREIGN)).groupBy(F.col("source").alias("a")).agg(F.count("*").cast("double").alias("n"))
    plain = cut(plain.select(F.lit("s").alias("kind"), "a", F.lit("0").alias("b"), "n"))
    model, priors = None, None
    for _ in range(rounds):
        step = _with_prior(docs, priors).select("source", "text", "prior")
        sums = step.mapInArrow(_e_step(model), SUMS).unionByName(plain).groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
        sums = cut(sums)
        table = sums.where(F.col("kind") == "c").select("a", "b", "n").collect()
        counts = {(r.a, r.b): r.n for r in table}
        before, model = model, Model(counts if model else discounted(counts))
        if before is not None:
            priors = cut(_priors(sums))
    return model, priors


def repaired(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", rounds: int = 3, sure: float = 0.5) -> DataFrame:
    """(key, chain, probability, restored): one row for each document with garbled characters.

    A document counts if its probability of a chain is above `sure` and a run reads better undone, or if it holds the
    replacement character, which stands for what is lost. restored has every run undone that more likely than not
    passed through the chain; lost characters stay. Null and empty texts are never garbled.
    """
    model, priors = fit(documents, text, source, rounds)
    kind = documents.schema[key].dataType.simpleString()
    docs = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"))
    docs = docs.where(F.col("text").rlike(FOREIGN))
    docs = _with_prior(docs, priors).select("key", "text", "prior")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            out: list[tuple] = []
            for k, t, prior in zip(*(batch.column(i).to_pylist() for i in range(3))):
                runs = runs_of(t)
                p, shares = posterior(gains := evidence(model, runs, cache), prior or FLAT)
                lost = LOST in t
                best = max(range(len(CHAINS)), key=lambda c: p[c + 1])
                fixed, at, changed = [], 0, 0
                if 1 - p[0] > sure:
                    for (start, _, r, _), g in zip(runs, gains):
                        odds = math.exp(min(g.get(best, -50.0), 50.0)) * shares[best] / max(1e-9, 1 - shares[best])
                        if odds > 1:
                            fixed += [t[at:start], undo(r, best)]
                            at = start + len(r)
                            changed += 1
                if lost or changed:
                    name = "+".join(f"{w} read as {r}" for w, r in CHAINS[best]) if changed else "lost"
                    out.append((k, name, 1.0 if lost else 1 - p[0], "".join(fixed) + t[at:]))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.string())], [key, "chain", "probability", "restored"])

    return docs.mapInArrow(run, f"`{key}` {kind}, chain string, probability double, restored string")
