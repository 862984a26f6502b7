"""Toxicity by a weighted finite-state pattern grammar.

A clause is the text between . ! ? ; : , and line feeds; a stretch without any of them ends CLAUSE
characters before or after a match. It is read as a sequence of token classes: insult, threat, target,
negation, report, intent or other. Small weighted transducers each mark one thing and pass the rest on:

* ``negation``: an insult or threat within three words after a negation is marked negated;
* ``reported``: one anywhere in the clause after a reporting word is marked reported;
* ``threat``: a threat word within three words after an intent word is marked intended;
* ``pile``: an insult after another in its clause, both neither negated nor reported, is marked piled;
* ``target``: one within four words after a target word, or two before one, is marked targeted.

Their composition is one machine; running it over a clause yields marked symbols, and a pattern is what
one symbol's marks say; a clause that insults after another that did is a pattern of its own. An insult
or threat in isolation, with no target, intent or other insult, is no pattern and scores nothing.
Negated and reported patterns have weights of their own. A document's score is a logistic function of
its patterns' sums. An Aho-Corasick automaton over the lexicon finds the clauses that can match.

Learning. All word classes come from labelled training rows (at most ``per_class`` of each class, in the
order of a hash of the id), none from a list:

* insults: words, and word beginnings with every ending, that tell toxic from clean texts, with a
  strength by their odds;
* targets: words that stand beside an insult in at least ``beside`` of the toxic texts that hold them,
  which are those that go with most of what is said (pronouns, articles, forms of "to be");
* negations and reports: words that go before insults in clean texts and not in toxic ones, negations
  where the three words before tell as much as all of the clause before, reports where they tell less;
* intents and threats: pairs of words, at most three apart, that tell toxic texts where neither word
  does; the rarer one is the threat.

The weights come from a logistic fit. A class that the rows give no evidence of stays empty. Without
labels of both classes nothing is learned and every text has the share of label 1 (0 without any).

Defined results: null and empty texts match nothing and get the base score; repeated rows each get a
row; other columns are not read. An empty table gives an empty result. Time and memory are linear in a
text's length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan.llm.common import column, fold, labelled_sample, map_texts, stage_table

INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, OTHER = "insult", "threat", "target", "negation", "report", "intent", "other"
ALPHABET = [INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, OTHER]
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[«„“\"]")
#: Shortest and longest word beginning that the lexicon may learn.
PREFIX = (4, 10)
#: Words that negation and intent reach; words that a target reaches onward, and back.
WINDOW, REACH, BACK = 3, 4, 2
#: Characters that a clause has at most on either side of a match.
CLAUSE = 400
_ENDS = ".!?;:,\n"
_CLAUSE_END = re.compile(f"[{_ENDS}]")

# --- transducers ------------------------------------------------------------------------------------


@dataclass
class Transducer:
    """Arcs (state, symbol) -> (state, symbol out, weight). A state's other symbols follow its
    ``default`` arc and pass through. State 0 is the start; every state accepts."""

    arcs: dict[tuple[int, str], tuple[int, str, float]] = field(default_factory=dict)
    default: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        hit = self.arcs.get((state, symbol))
        return hit if hit is not None else (self.default.get(state, 0), symbol, 0.0)

    def compose(self, after: Transducer, alphabet: list[str]) -> Transducer:
        """The machine that feeds this one's output to ``after``, over the reachable state pairs."""
        out, number, todo = Transducer(), {(0, 0): 0}, [(0, 0)]
        while todo:
            pair = todo.pop()
            for symbol in alphabet:
                a, mid, w = self.step(pair[0], symbol)
                b, end, v = after.step(pair[1], mid)
                if (a, b) not in number:
                    number[a, b] = len(number)
                    todo.append((a, b))
                out.arcs[number[pair], symbol] = (number[a, b], end, w + v)
        return out

    def run(self, symbols: list[str]) -> tuple[list[str], float]:
        state, out, total = 0, [], 0.0
        for s in symbols:
            state, o, w = self.step(state, s)
            out.append(o)
            total += w
        return out, total


def _window(opens: set[str], marks: dict[str, str], weight: float, reach: int | None = WINDOW) -> Transducer:
    """After a symbol of ``opens``, for ``reach`` symbols (None: to the end), rename by ``marks``."""
    t = Transducer()
    last = 1 if reach is None else reach
    for o in opens:
        for q in range(last + 1):
            t.arcs[q, o] = (1, o, 0.0)
    for q in range(1, last + 1):
        nxt = 1 if reach is None else (q + 1 if q < last else 0)
        t.default[q] = nxt
        for a, b in marks.items():
            t.arcs[q, a] = (nxt, b, weight)
    return t


PARTS = ("negation", "reported", "threat", "pile", "target")


def grammar(without: str | None = None) -> Transducer:
    """negation o reported o threat o pile o target, composed into one machine; ``without`` leaves one out.

    Marks are suffixes of the symbol: ~n negated, ~r reported, ~i intended, ~p piled, ~t targeted. A
    target that follows an insult that had none before it is emitted as "closed~t".
    """
    some = [INSULT, THREAT]
    machine = None

    def then(part: str, build) -> None:
        nonlocal machine, some
        if part != without:
            t, more = build()
            some = some + more
            machine = t if machine is None else machine.compose(t, ALPHABET)

    def marked(opens: set[str], mark: str, weight: float, reach: int | None, of=lambda s: True):
        marks = {s: s + mark for s in some if of(s)}
        return _window(opens, marks, weight, reach), list(marks.values())

    def target():
        t, more = marked({TARGET}, "~t", 0.5, REACH)
        first = REACH + 1  # states of an insult that waits for a target behind it
        for q in (0, *range(first, first + BACK)):
            for s in some:
                t.arcs[q, s] = (first, s, 0.0)
        for q in range(first, first + BACK):
            t.default[q] = q + 1 if q + 1 < first + BACK else 0
            t.arcs[q, TARGET] = (1, "closed~t", 0.5)
        return t, more

    then("negation", lambda: marked({NEGATION}, "~n", -0.5, WINDOW))
    then("reported", lambda: marked({REPORT}, "~r", -0.5, None))
    then("threat", lambda: marked({INTENT}, "~i", 0.5, WINDOW, lambda s: s.startswith(THREAT)))
    then("pile", lambda: marked({INSULT}, "~p", 0.5, None, lambda s: s == INSULT))
    then("target", target)
    return machine


#: The patterns, which are the columns of the fit. An isolated insult or threat is none of them.
FEATURES = ["targeted insult", "negated insult at a target", "reported insult at a target", "piled insult", "insulting clause after another", "intended threat", "intended threat, negated or reported"]


def patterns(symbols: list[str], strength: list[float], out: list[str]) -> tuple[np.ndarray, float]:
    """The sums of a clause's patterns, from the machine's output, and the strongest insult that is
    neither negated nor reported."""
    f, abuse = np.zeros(len(FEATURES)), 0.0
    waits = -1  # the insult that a target may still close
    for i, o in enumerate(out):
        kind = symbols[i]
        if kind == INSULT:
            damped = "~n" in o or "~r" in o
            if not damped:
                abuse = max(abuse, strength[i])
                f[3] += strength[i] * ("~p" in o)
            if "~t" in o:
                f[1 if "~n" in o else 2 if "~r" in o else 0] += strength[i]
            waits = -1 if "~t" in o else i
        elif kind == THREAT and "~i" in o:
            f[6 if "~n" in o or "~r" in o else 5] += 1
        elif o == "closed~t" and waits >= 0:
            f[1 if "~n" in out[waits] else 2 if "~r" in out[waits] else 0] += strength[waits]
            waits = -1
    return f, abuse


# --- lexicon and matching -----------------------------------------------------------------------------

#: The direction a fit starts from and is pulled to: damped patterns count less.
DEFAULT, BIAS = np.array([3.0, -1.0, -1.0, 1.0, 1.0, 3.0, -1.0]), -3.0


@dataclass
class Toxicity:
    """Insult words and beginnings with their strength (0..1), the classes of other words, pattern
    weights and bias."""

    words: dict[str, float]
    prefixes: dict[str, float]
    classes: dict[str, str]
    weights: np.ndarray
    bias: float
    machine: Transducer = field(default_factory=grammar)
    _automaton: object = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for w in {*self.words, *self.prefixes, *(w for w, k in self.classes.items() if k == THREAT)}:
                a.add_word(w, len(w))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def token(self, word: str) -> tuple[str, float]:
        if (w := self.words.get(word)) is not None:
            return INSULT, w
        if (c := self.classes.get(word)) is not None:
            return c, 0.0
        for k in range(PREFIX[0], min(PREFIX[1], len(word) - 1) + 1):
            if (w := self.prefixes.get(word[:k])) is not None:
                return INSULT, w
        return OTHER, 0.0

    def clauses(self, text: str) -> list[tuple[int, int]]:
        """Spans of the clauses of a lower-cased text that hold an insult or threat word, in order and
        apart. A clause is looked for between the end of the one before and CLAUSE characters on."""
        out: list[tuple[int, int]] = []
        if not len(self.automaton()):
            return out
        done = 0
        for end, size in self.automaton().iter(text):
            start = end - size + 1
            if start < done or (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
                continue
            word = _WORD.match(text, start)
            if word is None or self.token(word[0])[0] not in (INSULT, THREAT):
                continue
            low, high = max(done, start - CLAUSE), word.end() + CLAUSE
            left = max(max(text.rfind(c, low, start) for c in _ENDS) + 1, low)
            m = _CLAUSE_END.search(text, word.end(), high)
            done = m.start() if m else min(high, len(text))
            out.append((left, done))
        return out

    def features(self, text: str) -> tuple[np.ndarray, int]:
        text = text.lower()
        total, n, before = np.zeros(len(FEATURES)), 0, 0.0
        known: dict[str, tuple[str, float]] = {}
        for a, b in self.clauses(text):
            tokens = [known.get(w) or known.setdefault(w, self.token(w)) for w in _WORD.findall(text, a, b)]
            if len(known) > 1 << 16:
                known.clear()
            symbols = [t[0] for t in tokens]
            f, abuse = patterns(symbols, [t[1] for t in tokens], self.machine.run(symbols)[0])
            f[4] = abuse if before else 0.0
            before = before or abuse
            total += f
            n += bool(f.any())
        return np.log1p(total), n

    def score(self, text: str) -> tuple[float, int]:
        """The score and the number of clauses that match a pattern."""
        f, n = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(f @ self.weights) + self.bias)))), n


# --- learning -------------------------------------------------------------------------------------------


def _counted(df: DataFrame, keys, total: tuple[int, int], schema: str = "k string") -> DataFrame:
    """(k, toxic, clean, gain, g2): in how many texts of each label a key of ``keys(text)`` occurs, the log
    odds of the two shares, and the likelihood ratio (Dunning's G squared)."""

    def run(part, texts):
        n: Counter = Counter()
        for label, text in zip(column(part, "label").to_pylist(), texts, strict=True):
            n.update((k, label) for k in keys(text.decode("utf-8", "replace").lower()))
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in n], pa.string()), pa.array([v for _, v in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["k", "label", "n"])

    side = lambda v: F.sum(F.when(F.col("label") == v, F.col("n")).otherwise(0))
    d = map_texts(df, run, "k string, label int, n long").groupBy("k").agg(side(1).alias("toxic"), side(0).alias("clean"))
    clean, toxic = total
    gain = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    return d.withColumn("gain", gain).withColumn("g2", _likelihood_ratio(F.col("toxic"), toxic, F.col("clean"), clean))


def _likelihood_ratio(a: Column, n: int, b: Column, m: int) -> Column:
    """Dunning's G squared of a of n against b of m."""
    p = (a + b) / F.lit(float(n + m))
    part = lambda k, n: F.when(k > 0, k * F.log(k / n / p)).otherwise(0) + F.when(k < n, (n - k) * F.log((n - k) / n / (1 - p))).otherwise(0)
    return F.round(F.when(p < 1, 2 * (part(a, F.lit(float(n))) + part(b, F.lit(float(m))))).otherwise(0.0), 6)


def _keys_of(text: str) -> set[str]:
    """Words, ended by "$", and word beginnings, which stand for every longer word."""
    found = set(_WORD.findall(text))
    return {w + "$" for w in found if len(w) >= 3} | {w[:k] for w in found for k in range(PREFIX[0], min(PREFIX[1], len(w) - 1) + 1)}


def _hits(model: Toxicity, text: str):
    """(words, place) of every insult of the matched clauses."""
    for a, b in model.clauses(text):
        words = _WORD.findall(text, a, b)
        for i, w in enumerate(words):
            if model.token(w)[0] == INSULT:
                yield words, i


def _context(model: Toxicity, text: str) -> set[str]:
    """What stands by the insults of a text: "b" beside, "n" in the words that a negation reaches from,
    "r" anywhere before in the clause; and "o" all words of a text that has insults."""
    out = set()
    for words, i in _hits(model, text):
        out.update("b" + w for w in words[max(0, i - BACK) : i + BACK + 1] if model.token(w)[0] != INSULT)
        out.update("n" + w for w in words[max(0, i - WINDOW) : i])
        out.update("r" + w for w in words[:i])
    return out | {"*"} | {"o" + w for w in _WORD.findall(text)} if out else out


def _pairs_of(text: str, least: int = 3) -> set[str]:
    """Words of a clause, the second one at most WINDOW after the first."""
    clauses = [_WORD.findall(c) for c in _CLAUSE_END.split(text)]
    return {f"{u} {w}" for words in clauses for d in range(1, WINDOW + 1) for u, w in zip(words, words[d:], strict=False) if len(w) >= least and u != w}


def learn(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = 4000, least: int = 6, share: float = 0.012, odds: float = 2.0, sure: float = 24.0, beside: float = 0.2) -> Toxicity:
    """``least``, ``share``, ``odds`` and ``sure``: a key enters a class if it is in that many and that
    share of the texts that it tells, its share of them is exp(odds) times that of the others, and G
    squared is at least ``sure``. Of texts with the same least three-word shingle (by a hash: copies, and
    most near copies) one counts, so that a copied text's chance words do not look telling."""
    sample = labelled_sample(docs, labels, "toxic", train, per_class)
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 2)), lambda i: F.xxhash64(F.try_element_at("w", i), F.try_element_at("w", i + 1), F.try_element_at("w", i + 2)))
    sample = sample.withColumn("w", words).withColumn("least", F.array_min(shingles)).groupBy("least", "label").agg(F.min_by("text", "doc_id").alias("text")).select("text", "label")
    sample = stage_table(sample, "toxic-sample")
    totals = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    full = {r.toxic: r["count"] for r in labels.filter(train & F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    if len(totals) < 2:
        prior = full.get(1, 0) / max(1, sum(full.values()))
        return Toxicity({}, {}, {}, np.zeros(len(FEATURES)), math.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
    total = (totals[0], totals[1])
    telling = lambda d, side, n: d.filter((F.col(side) >= max(least, share * n)) & (F.col("g2") >= sure) & ((F.col("gain") if side == "toxic" else -F.col("gain")) >= odds))

    # insults; each row is in `least` of the bounded sample's texts
    lexicon: dict[str, float] = {}
    prefixes: dict[str, float] = {}
    taken: set[str] = set()
    # of nested beginnings and words, the one of the largest likelihood ratio speaks; of equals the longest
    for r in sorted(telling(_counted(sample, _keys_of, total), "toxic", totals[1]).collect(), key=lambda r: (-r.g2, -len(r.k), r.k)):
        stem = r.k.rstrip("$")
        if r.k in taken or any(stem[:k] in prefixes for k in range(PREFIX[0], len(stem))):
            continue
        (lexicon if r.k.endswith("$") else prefixes)[stem] = min(1.0, r.gain / 5)
        taken.update(stem[:k] for k in range(PREFIX[0], len(stem)))
    model = Toxicity(lexicon, prefixes, {}, DEFAULT, BIAS)
    sent = sample.sparkSession.sparkContext.broadcast(model)  # the lexicon

    # words that stand by insults
    context = _counted(sample, lambda t: _context(sent.value, t), total).persist()
    matched = context.filter("k = '*'").first()
    if matched is not None and matched.toxic:
        near = context.filter(F.col("k").startswith("b") & (F.col("toxic") >= least)).select(F.substring("k", 2, 99).alias("w"), F.col("toxic").alias("near"))
        held = context.filter(F.col("k").startswith("o")).select(F.substring("k", 2, 99).alias("w"), "toxic")
        for r in near.join(held, "w").filter(F.col("near") >= beside * F.col("toxic")).collect():
            model.classes[r.w] = TARGET
        hits, others = matched.toxic, matched.clean
        damps = (F.col("clean") >= least) & (F.col("clean") / F.lit(max(1, others)) >= math.exp(odds) * (F.col("toxic") + 0.5) / F.lit(hits + 1))
        damping: dict[str, tuple[float, bool]] = {}
        for r in context.filter(F.substring("k", 1, 1).isin("n", "r") & damps).withColumn("ratio", _likelihood_ratio(F.col("clean"), others, F.col("toxic"), hits)).filter(F.col("ratio") >= sure).collect():
            word = r.k[1:]
            damping[word] = max(damping.get(word, (0.0, False)), (r.ratio, r.k[0] == "n"))
        model.classes.update({w: NEGATION if near else REPORT for w, (_, near) in damping.items()})
    context.unpersist()

    # pairs that tell where neither word does
    toxic_pairs = _counted(sample.filter("label = 1"), _pairs_of, total).filter(F.col("toxic") >= max(least, share * totals[1])).select("k").collect()
    some = frozenset(r.k for r in toxic_pairs if not any(model.token(w)[0] == INSULT for w in r.k.split(" ")))  # in `least` toxic texts of the sample
    if some:
        pairs = telling(_counted(sample, lambda t: _pairs_of(t) & some, total), "toxic", totals[1]).collect()
        single = {w for r in pairs for w in r.k.split(" ")}
        alone = {r.k: (r.g2 if r.gain > 0 else 0.0, r.toxic + r.clean) for r in _counted(sample, lambda t: single & set(_WORD.findall(t)), total).collect()} if single else {}
        # the rarer word of a pair threatens; of pairs that tell alike, that with the rarest
        for r in sorted(pairs, key=lambda r: (-r.g2, alone[r.k.split(" ")[1]][1], r.k)):
            u, w = r.k.split(" ")
            if alone[w][1] < alone[u][1] and r.g2 > 2 * max(alone[u][0], alone[w][0]) and model.classes.get(w, THREAT) == THREAT and model.classes.get(u) != THREAT:
                model.classes[u], model.classes[w] = INTENT, THREAT

    model._automaton = None
    known = sample.sparkSession.sparkContext.broadcast(model)  # a few thousand words

    def features(part, texts):
        f = [known.value.features(t.decode("utf-8", "replace"))[0].tolist() for t in texts]
        return pa.RecordBatch.from_arrays([column(part, "label"), pa.array(f, pa.list_(pa.float64()))], ["label", "f"])

    got = map_texts(sample, features, "label int, f array<double>").toPandas()  # 2 * per_class short rows
    x, y = np.array(got["f"].tolist()), got["label"].to_numpy(dtype=float)
    weight = np.where(y == 1, full[1] / max(1, (y == 1).sum()), full[0] / max(1, (y == 0).sum()))
    model.weights, model.bias = _logistic(x, y, weight / weight.sum())
    return model


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, pull: float = 1e-4) -> tuple[np.ndarray, float]:
    """Newton steps of a logistic fit pulled to DEFAULT."""
    a = np.column_stack([x, np.ones(len(x))])
    base = np.append(DEFAULT, BIAS)
    w, keep = base.copy(), np.full(len(base), pull)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ ((p - y) * share) + keep * (w - base)
        h = (a * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(keep)
        step = np.linalg.solve(h, g)
        w = w - step / max(1.0, np.abs(step).max() / 2)
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: Toxicity, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with score and n_clauses, the clauses that match a pattern."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand words
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(part, texts):
        got = [sent.value.score(t.decode("utf-8", "replace")) for t in texts]
        return pa.RecordBatch.from_arrays([*[column(part, c) for c in keep], pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], [*keep, "score", "n_clauses"])

    return map_texts(docs.select(*dict.fromkeys((*keep, "text"))), run, f"{fields}, score double, n_clauses long")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return fold(doc_id, 3) == 1


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learn from the labelled rows of the training folds, then score every row of ``docs``."""
    return score(docs, learn(docs, labels, ~held_out()), keep)
