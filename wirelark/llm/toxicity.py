"""Toxicity by a weighted finite-state grammar over clauses.

Small transducers are composed into one machine. The lexicon maps a word to a symbol (insult, threat, target, negation,
reporting word, other) and, for insults, to a weight; the negation transducer marks an insult within a few words after
a negation; the reported-speech transducer marks what follows a reporting word or stands in quotation marks; the target
transducer marks a clause that speaks of a person. A clause runs from one sentence mark to the next. Only clauses with an
insult or a threat in them are read, found by an automaton over the whole text; what their marks add up to, over all
clauses, gives the score of the text.

What is learned, from labelled rows that are not held out: the insults, as words and word beginnings that are more
frequent in toxic texts, with a cautious estimate of their log odds as weights; and, from other rows than these, the
weight of each sum of marks, by logistic regression (so a mark that says nothing in the labels gets no
weight). The sample is bounded by ``SAMPLE``, the lexicon by ``MOST_UNITS``.

Nulls and edge cases: a null or empty text has no clause and the least score; long texts are read clause by clause; a
null ``doc_id`` is scored but never learned from; without labels of both kinds every score is 0; repeated rows are scored alike;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wirelark.llm.common import byte_column, evaluated_once, small_batches, word_array
from wirelark.llm.labelled import held_out, training_sample
from wirelark.session import store

SAMPLE = {1: 3000, 0: 6000}
LEAST_BEGIN, LONGEST_BEGIN, MOST_UNITS = 4, 8, 500
LEAST_TOXIC, LEAST_ODDS, CAUTION = 4, 1.0, 2.0
ACCEPT = 0.5
SCOPE = 3

# Closed word classes of the grammar in the four languages of the corpus.
TARGETS = frozenset("you your yours he she they him her them his their people du dich dir ihr sie euch tu toi vous te vos ils elles tú usted ustedes ellos ellas".split())
NEGATIONS = frozenset("not no never nor isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás ni".split())
REPORTS = frozenset("said says say told wrote writes quoted called sagte sagt schrieb dit écrit dijo dice escribió".split())
THREATS = frozenset("kill hurt destroy beat shoot burn töten schlagen tuer frapper matar golpear".split())

INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER = "insult", "threat", "target", "negation", "report", "quote", "other"
SYMBOLS = (INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER)
MARKS = ("insult", "threat", "targeted", "negated", "reported")
# What a text is judged by: its heaviest insult, the weight of all, the marks' counts (logarithms), and insults by length.
SUMS = ("heaviest", "weight", "insults", "threats", "targeted", "negated", "reported", "density")


@dataclass(frozen=True)
class Transducer:
    """States from 0 on; ``arcs[state][symbol]`` is the next state and the marks that the symbol gets there."""

    arcs: tuple[dict[str, tuple[int, frozenset[str]]], ...]

    @classmethod
    def of(cls, states: int, step: Callable[[int, str], tuple[int, Iterable[str]]]) -> Transducer:
        arcs = []
        for state in range(states):
            moves = {symbol: step(state, symbol) for symbol in SYMBOLS}
            arcs.append({symbol: (to, frozenset(marks)) for symbol, (to, marks) in moves.items()})
        return cls(tuple(arcs))

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols; a symbol gets the marks of either. Only states that can be reached are made."""
        number, queue, arcs = {(0, 0): 0}, [(0, 0)], []
        for here in queue:
            row = {}
            for symbol in SYMBOLS:
                (a, some), (b, more) = self.arcs[here[0]][symbol], other.arcs[here[1]][symbol]
                if (a, b) not in number:
                    number[(a, b)] = len(queue)
                    queue.append((a, b))
                row[symbol] = (number[(a, b)], some | more)
            arcs.append(row)
        return Transducer(tuple(arcs))


def _hits(symbol: str, mark: str, when: bool) -> tuple[str, ...]:
    """``mark``, if the symbol is an insult or a threat and ``when`` holds."""
    return (mark,) if when and symbol in (INSULT, THREAT) else ()


def grammar() -> Transducer:
    """The composed machine."""
    insult = Transducer.of(1, lambda q, s: (0, _hits(s, "insult", s == INSULT)))
    threat = Transducer.of(1, lambda q, s: (0, _hits(s, "threat", s == THREAT)))
    target = Transducer.of(2, lambda q, s: (int(q or s == TARGET), _hits(s, "targeted", q == 1)))
    # State k: k more words are in the scope of a negation.
    negation = Transducer.of(SCOPE + 1, lambda q, s: (SCOPE if s == NEGATION else max(0, q - 1), _hits(s, "negated", q > 0)))
    # 1: after a reporting word; 2: within quotation marks.
    reported = Transducer.of(
        3, lambda q, s: ((0 if q == 2 else 2) if s == QUOTE else max(q, int(s == REPORT)), _hits(s, "reported", q > 0))
    )
    machine = insult
    for part in (threat, target, negation, reported):
        machine = machine.compose(part)
    return machine


_MACHINE = grammar()
_CLAUSE = re.compile(r"[.!?;\n]")
_WORD = re.compile(r"[\"“”«»„]|[^\W\d_]+(?:['’][^\W\d_]+)?")
_QUOTES = frozenset("\"“”«»„")


class Grammar:
    """The machine with a learned lexicon and weights of the marks.

    A unit of the lexicon is the begin of a word, or a whole word with a blank behind it.
    """

    def __init__(self, units: dict[str, float], weights: list[float] | None = None, bias: float = 0.0):
        self.units, self.bias = units, bias
        self.weights = np.array(weights if weights is not None else [0.0] * len(SUMS))
        self.finder = ahocorasick.Automaton()
        for unit in {u.rstrip() for u in units} | THREATS:
            self.finder.add_word(unit, len(unit))
        self.finder.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        """The symbol of a word, and its weight as an insult: that of the heaviest unit in it."""
        if word in _QUOTES:
            return QUOTE, 0.0
        own = [word + " ", *(word[:n] for n in range(LEAST_BEGIN, min(len(word), LONGEST_BEGIN) + 1))]
        if weights := [self.units[u] for u in own if u in self.units]:
            return INSULT, max(weights)
        for words, symbol in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
            if word in words:
                return symbol, 0.0
        return OTHER, 0.0

    def clause_marks(self, clause: str) -> list[np.ndarray]:
        """The marks of each insult or threat of a clause as numbers, an insult's own as its weight."""
        state, found, target = 0, [], False
        for word in _WORD.findall(clause):
            symbol, weight = self.symbol(word)
            target |= symbol == TARGET
            state, marks = _MACHINE.arcs[state][symbol]
            if marks & {"insult", "threat"}:
                found.append(np.array([weight if m == "insult" else float(m in marks) for m in MARKS]))
        for marks in found:  # a target that comes later in the clause counts too
            marks[MARKS.index("targeted")] = float(target)
        return found

    def clauses(self, text: str) -> Iterator[str]:
        """The clauses of ``text``, in lower case, that an insult or a threat may stand in."""
        low, done = text.lower(), 0
        for end, length in self.finder.iter(low):
            begin = end - length + 1
            if begin < done or (begin and low[begin - 1].isalnum()):
                continue
            left = max(done, 1 + max(low.rfind(mark, done, begin) for mark in ".!?;\n"))
            right = _CLAUSE.search(low, end)
            done = right.end() if right else len(low)
            yield low[left:done]

    def sums(self, text: str) -> np.ndarray:
        """What the marks of all clauses of ``text`` add up to, see ``SUMS``; zeros if it has none."""
        rows = [m for clause in self.clauses(text) for m in self.clause_marks(clause)]
        if not rows:
            return np.zeros(len(SUMS))
        marks = np.array(rows)
        insults, counts = marks[:, 0], np.log1p((marks > 0).sum(axis=0))
        return np.array([insults.max(), insults.sum() / 10, *counts, (insults > 0).sum() / (1 + len(text) / 1000)])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.sums(text) @ self.weights + self.bias, -30, 30))))


def lexicon(sample: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Words and word begins of ``sample`` (``text``, ``label``) that are far more frequent where the label is 1.

    The weight is the logarithm of how many times, less ``CAUTION`` times its standard error. A unit that only repeats
    a shorter one is left out.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    begins = F.expr(
        f"flatten(transform(words, w -> concat(array(w || ' '), if(length(w) < {LEAST_BEGIN}, array(),"
        f" transform(sequence({LEAST_BEGIN}, least({LONGEST_BEGIN}, length(w))), n -> substr(w, 1, n))))))"
    )
    units = sample.select("label", words.alias("words")).select("label", F.explode(F.array_distinct(begins)).alias("unit"))
    counts = units.groupBy("unit").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    odds = F.round(F.log((t / (toxic + 1)) / (c / (clean + 1))) - CAUTION * F.sqrt(1 / t + 1 / c), 6)
    kept = counts.where(F.col("t") >= max(LEAST_TOXIC, toxic // 200)).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    kept = store(kept.select("unit", "odds"), "units")
    # A unit that a shorter one begins, with odds no worse, says nothing new; how many are left is bounded by the sample alone.
    cuts = F.explode(F.sequence(F.lit(LEAST_BEGIN), F.length("unit") - 1)).alias("n")
    begun = kept.where(F.length("unit") > LEAST_BEGIN).select("unit", "odds", cuts).withColumn("shorter", F.expr("substr(unit, 1, n)"))
    shorter = kept.select(F.col("unit").alias("shorter"), F.col("odds").alias("before"))
    repeats = begun.join(shorter, "shorter").where(F.col("before") >= F.col("odds")).select("unit").distinct()
    return {r["unit"]: r["odds"] for r in kept.join(repeats, "unit", "left_anti").collect()}


def _logistic(inputs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights by Newton steps on the logistic loss, both labels weighing alike, with a small pull to zero."""
    weights, pull = np.zeros(inputs.shape[1]), 0.05 * np.eye(inputs.shape[1])
    each = np.where(target > 0, 0.5 / target.mean(), 0.5 / (1 - target.mean()))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(inputs @ weights, -30, 30)))
        gradient = inputs.T @ (each * (p - target)) + pull @ weights
        weights = weights - np.linalg.solve((inputs * (each * p * (1 - p))[:, None]).T @ inputs + pull, gradient)
    return weights


def without_copies(sample: DataFrame) -> DataFrame:
    """``text`` and ``label`` of ``sample``, of near copies one: else what a text and its copies share looks like a rule.

    Texts count as near copies if the least hash of their three-word shingles is the same.
    """
    split = sample.select(F.coalesce("text", F.lit("")).alias("text"), "label").withColumn("words", word_array(F.col("text")))
    shingles = F.expr("transform(words, (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2)))")
    least = evaluated_once(split, words=F.col("words")).withColumn("least", F.array_min(shingles))
    return least.groupBy("label", "least").agg(F.min("text").alias("text")).select("text", "label")


def fitted(docs: DataFrame, labels: DataFrame) -> Grammar | None:
    """The grammar for the ``toxic`` labels of a bounded sample; None without both labels."""
    rows = without_copies(training_sample(docs, labels, "toxic", SAMPLE))
    # Two thirds teach the lexicon and the others the weights: judged by the rows it comes from, every chance find looks sure.
    sample = store(rows.withColumn("part", F.pmod(F.xxhash64("text", F.lit("part")), F.lit(3))), "toxic-sample")
    counts = Counter()
    for r in sample.groupBy("label", "part").count().collect():
        counts[(r[0], r[1] > 0)] += r[2]
    if len(counts) < 4:
        return None
    units = lexicon(sample.where("part > 0"), counts[(1, True)], counts[(0, True)])
    small_batches(docs.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = _grammar_once(units, None, 0.0)
        for batch in batches:
            made = [plain.sums(t.decode()).tolist() for t in byte_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch.column(1)], names=["sums", "label"])

    others = sample.where("part = 0").select("text", "label").mapInArrow(sums, "sums array<double>, label int")
    taught = sorted((r["sums"], r["label"]) for r in others.collect())
    inputs = np.array([[*m, 1.0] for m, _ in taught])
    weights = _logistic(inputs, np.array([label for _, label in taught], dtype=np.float64))
    return Grammar(units, weights[:-1].tolist(), float(weights[-1]))


_made: dict[str, Grammar] = {}


def _grammar_once(units: dict[str, float], weights: list[float] | None, bias: float) -> Grammar:
    key = hashlib.md5(json.dumps([units, weights, bias], sort_keys=True).encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Grammar(units, weights, bias)
    return _made[key]


def scored(docs: DataFrame, grammar: Grammar | None) -> DataFrame:
    """``docs`` with ``score``, the probability that a text is toxic, in place of a column of that name."""
    small_batches(docs.sparkSession)
    docs = docs.drop("score")
    known = grammar and (grammar.units, grammar.weights.tolist(), grammar.bias)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _grammar_once(*known) if known else None
        for batch in batches:
            scores = [own.score((t or b"").decode()) if own else 0.0 for t in byte_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(of, StructType([*docs.schema, StructField("score", DoubleType())]))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``."""
    made = scored(docs.select("doc_id", "text"), fitted(docs, labels))
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
