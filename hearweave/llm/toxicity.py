"""Toxicity by weighted finite-state transducers over clauses.

A lexicon turns words into classes: insults and threats (learned from labels, and fixed stems of
threats), targets, intent, negation, report, quotes. An acceptor reads each clause first and puts what it
found in front of it as a mark: whether somebody is addressed, and whether somebody means to act. Three
transducers then read the marked clause as one, their composition: negation marks what stands in its
reach, report what is told or quoted, and the pattern gives out a match for an insult, or for a threat
with a target by somebody who means it. A match has the log odds of its word, and on the arc the logarithm of the factor that
its context puts on its probability, which is learned from labels too: however sure a word is, a denied or reported match stays
below its context's factor. Plain matches of a text combine as independent evidence; of those that are denied, reported, or threats
that aim at nobody, only the strongest counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearweave.llm.bpe_codec import Cache
from hearweave.llm.common import slices, stored, unused, with_columns

#: Labelled rows that are learned from, at most, dealt by a hash of the text's id. They bound the lexicon.
FIT_ROWS = 24_000
#: Letters of word beginnings that a lexicon may hold (only whole words are learned); expected chance terms.
BEGINNINGS, CHANCE = range(4, 8), 0.02
#: Least share of toxic texts among those with a learned term.
PRECISION = 0.9
#: Words a negation reaches.
REACH = 3
#: Texts that a context weighs as much as before it has been seen; what a plain and a marked one is then taken for.
PRIOR, PLAIN, MARKED = 4.0, 0.95, 0.4
#: The factor of a threat of the fixed lists that has nobody for its object.
UNAIMED = 0.4
#: The evidence of a threat that is no learned term.
THREATENS = math.log(9.0)
PREDICTED = 0.7

# Classes of words in English, German, French and Spanish; a stem ends in *.
THREATS = (
    "kill*", "murder*", "stab*", "strangl*", "slaughter*", "shoot*", "töte*", "ermord*", "umbring*", "umzubringen", "erschieß*",
    "erstech*", "erwürg*", "unalive*", "tuer", "tue", "tuerai", "assassin*", "poignard*", "étrangl*", "matar*", "mato", "asesin*", "apuñal*",
    "estrangul*",
)
HARMS = (
    "hurt*", "beat", "beaten", "beating", "destroy*", "smash*", "punch*", "burn*", "crush*", "schlag*", "verprügel*", "zerstör*",
    "vernicht*", "frapp*", "détrui*", "brûl*", "golpe*", "destru*", "quemar*",
)
INTENTS = ("will", "going", "gonna", "shall", "should", "i'll", "we'll", "they'll", "werde", "werden", "wird", "werdet", "vais", "allons", "vont", "voy", "vamos")
SELVES = ("i", "we", "ich", "wir", "je", "nous", "yo", "nosotros")
TARGETS = ("you", "your", "he", "she", "they", "him", "her", "them", "du", "dich", "dir", "euch", "sie", "ihr", "tu", "te", "toi", "vous", "usted", "ustedes", "ti")
NEGATIONS = ("not", "never", "no", "cannot", "cant", "dont", "didnt", "wont", "nicht", "kein", "keine", "nie", "pas", "jamais", "non", "nunca", "jamás")
REPORTS = ("said", "says", "called", "wrote", "claimed", "sagte", "sagt", "nannte", "schrieb", "dit", "appelle", "dijo", "dice", "llamó")
# Whom a threat aims at: behind the verb, in front of it (German, French, Spanish), as an ending of it; and what makes a passive.
OBJECTS = ("you", "yourself", "yourselves", "him", "her", "them", "your", "his", "their", "dich", "dir", "euch", "ihn", "sie", "te", "toi", "vous", "ti", "usted", "ustedes")
OBJECTS_BEFORE = ("dich", "dir", "euch", "te", "t'", "vous", "os", "ihn")
OBJECT_ENDINGS = ("te", "lo", "la", "los", "las", "le", "les", "os")
PASSIVES = ("be", "been", "being", "get", "getting")
# Phrases that wish or order a death.
PHRASES = (
    ("kill", "yourself"), ("kill", "yourselves"), ("hang", "yourself"), ("go", "die"), ("hope", "you", "die"), ("hope", "they", "die"), ("töte", "dich"),
    ("bring", "dich", "um"), ("va", "mourir"), ("hoffe", "du", "stirbst"), ("ojalá", "te", "mueras"), ("vete", "a", "morir"),
)
QUOTES = "\"“”„«»"
PAUSES = ","
ENDS = ".!?;:\n"

OTHER, INSULT, THREAT, HARM, INTENT, SELF, TARGET, NEGATION, REPORT, QUOTE, PAUSE, END, CLAUSE, MATCH = range(14)
_CLASSES = ((INTENT, INTENTS), (SELF, SELVES), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (QUOTE, QUOTES), (PAUSE, PAUSES), (END, ENDS))
_FIXED = {w: c for c, words in _CLASSES for w in words}
_STEMS = {w.rstrip("*") + ("" if w.endswith("*") else "$"): c for c, words in ((THREAT, THREATS), (HARM, HARMS)) for w in words}
_LONGEST = max(map(len, _STEMS))
_PHRASES = {}
for _phrase in PHRASES:
    _PHRASES.setdefault(_phrase[-1], []).append(_phrase)
#: Words between an object in front of a verb and the verb, at most.
BETWEEN = 4
_TOKENS = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;:,\n\"“”„«»]")

#: Contexts of a match, as bits: in the reach of a negation, told by somebody, in a clause that addresses
#: somebody, a threat. A clause's mark has the third, and two of its own.
NEGATED, REPORTED, TARGETED, THREATENED = 1, 2, 4, 8
MEANT, BY_SELF = 8, 16

Symbol = tuple[int, int]  # a class and its marks


class Transducer:
    """A deterministic weighted transducer: arcs[state][symbol in] = (symbol out, next state, weight)."""

    def __init__(self, start: object, step: Callable[[object, Symbol], tuple[Symbol, object, float]], symbols: Iterable[Symbol]):
        """Its states are those that step reaches from start by symbols."""
        symbols = list(symbols)
        number, self.arcs, todo = {start: 0}, [], [start]
        for state in todo:
            arcs = {}
            for symbol in symbols:
                out, after, weight = step(state, symbol)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                arcs[symbol] = (out, number[after], weight)
            self.arcs.append(arcs)

    def outputs(self) -> set[Symbol]:
        return {out for arcs in self.arcs for out, _, _ in arcs.values()}

    def __matmul__(self, after: "Transducer") -> "Transducer":
        """The composition: after reads what this one writes; weights add up."""

        def step(state: tuple[int, int], symbol: Symbol) -> tuple[Symbol, tuple[int, int], float]:
            between, mine, one = self.arcs[state[0]][symbol]
            out, other, two = after.arcs[state[1]][between]
            return out, (mine, other), one + two

        return Transducer((0, 0), step, self.arcs[0])


def negation(symbols: Iterable[Symbol]) -> Transducer:
    """Marks insults and threats within REACH words of a negation; a pause or a new clause ends its reach."""

    def step(left: int, symbol: Symbol) -> tuple[Symbol, int, float]:
        kind, marks = symbol
        if kind in (CLAUSE, END, PAUSE):
            return symbol, 0, 0.0
        out = (kind, marks | NEGATED) if left and kind in (INSULT, THREAT, HARM) else symbol
        return out, REACH if kind == NEGATION else max(0, left - 1), 0.0

    return Transducer(0, step, symbols)


def report(symbols: Iterable[Symbol]) -> Transducer:
    """Marks insults and threats after a word of reporting in the clause, and in quotes, over clauses."""

    def step(state: tuple[bool, bool], symbol: Symbol) -> tuple[Symbol, tuple[bool, bool], float]:
        (told, quoted), (kind, marks) = state, symbol
        if kind == QUOTE:
            return symbol, (told, not quoted), 0.0
        if kind in (CLAUSE, END):
            return symbol, (False, quoted), 0.0
        out = (kind, marks | REPORTED) if (told or quoted) and kind in (INSULT, THREAT, HARM) else symbol
        return out, (told or kind == REPORT, quoted), 0.0

    return Transducer((False, False), step, symbols)


def pattern(symbols: Iterable[Symbol], weights: dict[int, float]) -> Transducer:
    """Gives out a match with its context for each insult, and for the threats of a clause that addresses
    somebody and says who means to act: milder harm only by a stated intent."""

    def step(mark: int, symbol: Symbol) -> tuple[Symbol, int, float]:
        kind, marks = symbol
        if kind == CLAUSE:
            return (OTHER, 0), marks, 0.0
        meant = mark & TARGETED and mark & (MEANT | BY_SELF if kind == THREAT else MEANT)
        if kind == INSULT or (kind in (THREAT, HARM) and meant):
            context = marks | (mark & TARGETED) | (0 if kind == INSULT else THREATENED)
            return (MATCH, context), mark, weights.get(context, expected(context))
        return (OTHER, 0), mark, 0.0

    return Transducer(0, step, symbols)


def expected(context: int, toxic: float = 0.0, n: float = 0.0) -> float:
    """The weight of a context of which toxic of n texts are: the logarithm of a factor, never for, only against a match."""
    return math.log((toxic + PRIOR * (MARKED if context & (NEGATED | REPORTED) else PLAIN)) / (n + PRIOR))


def mark_of(kinds: Iterable[int]) -> int:
    """What the acceptor found in a clause."""
    kinds = set(kinds)
    return (TARGETED if TARGET in kinds else 0) | (MEANT if INTENT in kinds else 0) | (BY_SELF if SELF in kinds else 0)


def aims(words: list[str], at: int) -> bool:
    """Whether the threat at that place of a clause has somebody for its object: the next word, one in front of it, its ending; or it
    is a passive of somebody."""
    word = words[at]
    if at + 1 < len(words) and words[at + 1] in OBJECTS:
        return True
    if not word.isascii() or word.endswith(("r", "en", "e")):
        if any(w in OBJECTS_BEFORE for w in words[max(0, at - BETWEEN - 1) : at]):
            return True
    if any(word.endswith("r" + end) for end in OBJECT_ENDINGS):
        return True
    return at > 0 and words[at - 1] in PASSIVES and any(_FIXED.get(w) == TARGET for w in words[: at - 1])


def tokens(text: str | None) -> list[str]:
    return _TOKENS.findall((text or "").lower().replace("’", "'"))


def entries(word: str) -> list[str]:
    """What a word can match in the lexicon: itself, and its beginnings."""
    return [word + "$", *(word[:k] for k in BEGINNINGS if len(word) >= k)]


def clauses(words: list[str]) -> Iterator[list[str]]:
    """words cut after each end of a clause, the end left out."""
    at = 0
    for k, w in enumerate(words):
        if _FIXED.get(w) == END:
            yield words[at:k]
            at = k + 1
    yield words[at:]


class Grammar:
    """The composed transducers over a lexicon: entry to evidence (log odds); an entry of threats begins with !."""

    def __init__(self, lexicon: dict[str, float], contexts: dict[int, float], base: float):
        self.lexicon, self.contexts, self.base = lexicon, contexts, base
        self.classes = Cache(self._class)
        read = [(kind, 0) for kind in range(END + 1)] + [(CLAUSE, mark) for mark in range(0, 32, 4)]
        first = negation(read)
        second = first @ report(first.outputs())
        self.arcs = (second @ pattern(second.outputs(), contexts)).arcs

    def __reduce__(self):
        return Grammar, (self.lexicon, self.contexts, self.base)

    def _class(self, word: str) -> tuple[int, float]:
        """The lexicon as a transducer of one state: a word's class, and the evidence of insults and threats."""
        if word in _FIXED:
            return _FIXED[word], 0.0
        if word.endswith("n't"):
            return NEGATION, 0.0
        own = entries(word) if self.lexicon else ()
        if found := [self.lexicon["!" + e] for e in own if "!" + e in self.lexicon]:
            return HARM, max(found)
        if found := [self.lexicon[e] for e in own if e in self.lexicon]:
            return INSULT, max(found)
        for stem in (word + "$", *(word[:k] for k in range(min(len(word), _LONGEST), 2, -1))):
            if stem in _STEMS:
                return _STEMS[stem], self.lexicon.get("", THREATENS)
        return OTHER, 0.0

    def read(self, words: list[str]) -> list[tuple[float, float, int, bool]]:
        """(evidence, weight, context, aimed) of each match: the log odds of its word, the weight of its context, and whether it is no
        threat of the fixed lists that aims at nobody."""
        kinds = list(map(self.classes.__getitem__, words))
        for k in (k for k, w in enumerate(words) if w in _PHRASES):
            if any(tuple(words[k + 1 - len(p) : k + 1]) == p for p in _PHRASES[words[k]] if len(p) <= k + 1):
                kinds[k] = INSULT, self.lexicon.get("", THREATENS)
        if not any(evidence for _, evidence in kinds):
            return []
        out: list[tuple[float, float, int, bool]] = []
        state, at = 0, 0
        for end in [*(k for k, (kind, _) in enumerate(kinds) if kind == END), len(kinds)]:
            clause = kinds[at:end]
            mark = mark_of(kind for kind, _ in clause) | (MEANT if any(words[k : k + 2] == ["van", "a"] for k in range(at, end)) else 0)
            _, state, _ = self.arcs[state][CLAUSE, mark]
            for k, (word, evidence) in enumerate(clause):
                (kind, context), state, weight = self.arcs[state][word, 0]
                if kind == MATCH:
                    fixed = word in (THREAT, HARM) and not any("!" + e in self.lexicon for e in entries(words[at + k]))
                    out.append((evidence, weight, context, not fixed or aims(words[at:end], k)))
            at = end + 1
        return out

    def matches(self, words: list[str]) -> list[tuple[float, int]]:
        """(evidence, context) of each match; the evidence is that of the word and of its context."""
        return [(evidence + weight, context) for evidence, weight, context, _ in self.read(words)]

    def score(self, text: str | None) -> float:
        """From 0 to 1; a text without a match has the labels' base rate of those."""
        clean, weak = 1.0 - self.base, 0.0
        for evidence, weight, context, aimed in self.read(tokens(text)):
            p = math.exp(weight) / (1.0 + math.exp(-evidence))
            if context & (NEGATED | REPORTED) or not aimed:
                weak = max(weak, p if aimed else UNAIMED * p)
            else:
                clean *= 1.0 - p
        return 1.0 - clean * (1.0 - weak)


def held_out(key: str = "doc_id"):
    """Rows that labels are never learned from: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def found_entries(words: list[str]) -> set[str]:
    """The entries that a text's words can teach, whole words only: of all, and marked with ! of those in a clause that
    addresses somebody and says who means to act."""
    out = {w + "$" for w in set(words) if w not in _FIXED}
    for clause in clauses(words):
        mark = mark_of(_FIXED.get(w, OTHER) for w in clause)
        if mark & TARGETED and mark & MEANT:
            out |= {"!" + w + "$" for w in set(clause) if w not in _FIXED}
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> Grammar:
    """Learns the lexicon and the weights of contexts from at most rows labelled rows outside the
    held-out part, each over its whole text.

    A term is taken if it stands in toxic texts more often than chance explains; a threat likewise, by
    its clauses that address somebody and say who means to act, if it is no insult by itself. Texts with the
    same least hashed three words count once for a term, so that copies don't make terms. Of several labels of
    one key the largest holds; rows that repeat count once by that rule. Without labels of both kinds the
    lexicon is empty. What is learned is bounded by the words of the sample's toxic rows.
    """
    known = labels.where(~held_out(key) & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key)
    known = known.agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64(key), key).limit(rows)
    sample = stored(docs.select(key, text).join(F.broadcast(known), key).select("y", text), "sample")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            y, e, sign = [], [], []
            for label_, x in zip(batch.column("y").to_pylist(), batch.column(text).to_pylist()):
                words = tokens(x)
                found = found_entries(words) | {""}
                least = min((xxhash.xxh64_intdigest(" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))), default=0)
                e += found
                y += [label_] * len(found)
                sign += [least - (1 << 63)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(e, pa.string()), pa.array(sign, pa.int64())], names=["y", "entry", "sign"])

    seen = sample.mapInArrow(features, "y int, entry string, sign long").groupBy("entry", "sign").agg(F.max("y").alias("y"))
    counts = stored(seen.groupBy("entry").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).where("n > 1 or entry = ''"), "counts")
    whole = counts.where("entry = ''").first()
    total, toxic = (whole["n"], whole["pos"]) if whole else (0, 0)
    if not toxic or toxic == total:
        return Grammar({}, {}, toxic / total if total else 0.02)
    base = toxic / total
    tried = counts.count()
    least = math.ceil(math.log(max(tried, 2) / CHANCE) / -math.log(base))
    kept = counts.where((F.col("entry") != "") & (F.col("pos") >= least) & (F.col("pos") >= PRECISION * F.col("n"))).collect()
    lexicon = {r["entry"]: math.log((r["pos"] + 0.5) / (r["n"] - r["pos"] + 0.5)) for r in kept}
    lexicon = {"": THREATENS, **{e: v for e, v in lexicon.items() if e[0] != "!" or e[1:] not in lexicon}}
    return _with_contexts(sample, text, Grammar(lexicon, {}, base))


def _with_contexts(sample: DataFrame, text: str, grammar: Grammar) -> Grammar:
    """grammar with weights for contexts: the share of toxic texts among those whose matches are all in
    one context. Rare contexts stay near what is expected of them. Its base is the
    rate of toxic texts without a match."""
    shared = sample.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in slices(batches, text):
            kinds = [{c for _, c in g.matches(tokens(x))} for x in batch.column(text).to_pylist()]
            kind = [-1 if not k else k.pop() if len(k) == 1 else -2 for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(kind, pa.int32())], names=["y", "kind"])

    rows = sample.mapInArrow(run, "y int, kind int").groupBy("kind").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).collect()
    found = {r["kind"]: (r["pos"], r["n"]) for r in rows}
    pos, n = found.get(-1, (0, 0))
    return Grammar(grammar.lexicon, {c: expected(c, *found.get(c, (0, 0))) for c in range(16)}, (pos + 1.0) / (n + 50.0))


def score_documents(docs: DataFrame, grammar: Grammar, text: str = "text", to: str = "score") -> DataFrame:
    """docs with the toxicity of text in the column to. Null and empty texts have the base rate; texts of
    any length are read whole, repeated rows each; an empty table stays empty. Rows stay where they are;
    other columns are kept, one named as the result is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def make():
        g = shared.value
        return lambda texts: {to: np.array([g.score(x) for x in texts], np.float64)}

    return with_columns(docs, text, make, f"`{to}` double")


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: key, held_out, score, predicted (1 from PREDICTED on)."""
    scored = score_documents(docs.select(key, "text"), fit(docs, labels, key=key))
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without those predicted toxic. All columns stay as they are."""
    to = unused(docs, "toxicity")
    return score_documents(docs, fit(docs, labels, key=key), to=to).where(F.col(to) < PREDICTED).drop(to)
