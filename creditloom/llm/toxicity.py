"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are read as classes: insult, harm, intention, target, negation, report. Four transducers over these classes, for
threats, targets, negation and reported speech, are composed into one deterministic table whose arcs say which pattern
a head (insult or threat) completes and with which weight: a directed insult weighs more than a bare one, a negated or
reported one less. The table is run over every clause that has a head; a text's margin is a linear function of what
its clauses matched, never of words that stand outside a match.

Learned from labelled rows that are not held out (at most about ``SAMPLE``, one text for each label, drawn by a hash of
doc_id over the whole table, label 1 preferred): further insults, as whole words or word beginnings, chosen one after
another by the toxic texts that no earlier choice explains, near copies counting together; the weights of patterns on
top of the grammar's own; a Platt calibration on a fifth of the sample that is kept apart.

Results for special rows: null, empty and wordless texts have no clause and score the calibrated bias. Rows that repeat
a doc_id are scored one by one; contradicting labels of one doc_id are both used. A null doc_id is neither held out nor
trained on; null labels and labels without a document are not used. Without labels of both kinds the grammar's own
weights hold. Long texts are read whole. A score of exactly 0.5 is toxic. An empty table gives an empty result. Other columns are
handed through in a struct, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.language import held_out
from creditloom.llm.linear import Rows, fit, logistic, sigmoid
from creditloom.llm.text import ALNUM, Spans, Texts, mix, run_starts, slices

SAMPLE = 6000
LEAST = 3.0  # toxic texts, near copies counted once, that an insult to be learned has to explain
CLEARER = 20.0  # how many times more frequent it has to be in toxic texts
PREFIXES = (3, 4, 5, 6, 7)  # code points
ROUNDS = 400

# Words of the classes, in English, German, French and Spanish.
INSULTS = """
idiot idiots moron morons imbecile cretin stupid dumb fool loser losers pathetic worthless scum trash garbage clown disgusting vermin filth pig
swine bastard bitch whore slut asshole jerk dumbass fuck fucking fucker shit bullshit cunt dick prick coward freak creep parasite
idioten trottel depp dummkopf dumm blöd arschloch schwein abschaum versager dreck widerlich wertlos erbärmlich scheiße hure wichser ungeziefer
imbécile crétin débile abruti stupide ordure connard salaud salope minable pourriture dégueulasse merde raclure vermine
idiota imbécil estúpido estúpida basura escoria cabrón puta mierda inútil patético asqueroso asquerosa tonto gilipollas
""".split()
HARMS = """
kill murder hurt destroy shoot stab burn beat crush hang strangle punch slaughter exterminate töten umbringen verletzen vernichten erschießen
schlagen verbrennen tuer frapper brûler détruire massacrer égorger matar herir destruir quemar golpear degollar sterben mourir morir
""".split()
INTENTIONS = "will gonna going shall should must must'll want wanna let ll werde werden soll sollen muss vais va allons devrait doit voy vamos debe debería".split()
TARGETS = """
you your yours yourself u ur them they those these he she him her people everyone women men immigrants jews muslims christians blacks whites gays
du dich dir euch ihr sie ihn leute frauen männer tu te toi vous ils elles gens femmes hommes tú usted ustedes vosotros ellos ellas gente mujeres hombres
""".split()
NEGATIONS = "not no never neither nor none without don doesn didn isn aren wasn weren ain hardly nicht kein keine keinen nie ne pas jamais aucun sans nunca jamás ningún sin".split()
REPORTS = """
said says say saying called calls wrote writes claimed claims told alleged reported quoted according sagte sagt behauptete nannte schrieb laut
dit disait déclare écrit selon appelé dijo dice escribió según llamó
""".split()
BREAKS = "but because although though whereas while aber weil obwohl mais parce quoique pero porque aunque".split()

OTHER, INSULT, HARM, INTENTION, TARGET, NEGATION, REPORT, BREAK, QUOTE = range(9)
THREAT = 9  # made by the first transducer
#: What a head can turn out to be, and the grammar's own weight.
HEADS = {"insult": 2.0, "insult_at": 3.0, "insult_late": 1.0, "threat": 2.0, "threat_at": 4.0, "threat_late": 2.0}
CONTEXTS = {"plain": 1.0, "negated": 0.1, "reported": 0.4}
PATTERNS = [(h, c) for h in HEADS for c in CONTEXTS]
PRIOR = np.array([HEADS[h] * CONTEXTS[c] for h, c in PATTERNS])
REACH = 4  # words over which intention, target and negation act

# --- transducers: state, symbol -> state, symbol, weight ----------------------------------------


def threats(state, symbol):
    """An intention followed by a harm is a threat."""
    if symbol == INTENTION:
        return REACH, OTHER, 1.0
    if symbol == HARM:
        return 0, THREAT if state else HARM, 1.0
    return max(state - 1, 0), symbol, 1.0


def targets(state, symbol):
    """Heads that have a target before them, or get one shortly after. State: reach of a target, open head, its reach."""
    near, head, left = state
    later = (max(near - 1, 0), head if left > 1 else "", max(left - 1, 0))
    if symbol == TARGET:
        if head:
            return (REACH, "", 0), "threat_at" if head == "harm" else f"{head}_late", HEADS["threat_at"] if head == "harm" else HEADS[f"{head}_late"]
        return (REACH, "", 0), OTHER, 1.0
    if symbol in (INSULT, THREAT):
        name = "insult" if symbol == INSULT else "threat"
        if near:
            return (near - 1, "", 0), f"{name}_at", HEADS[f"{name}_at"]
        return (0, name, REACH), name, HEADS[name]
    if symbol == HARM:  # without intention it counts only if it hits somebody
        return (max(near - 1, 0), "harm", 2), OTHER, 1.0
    return later, symbol, 1.0


def negations(state, symbol):
    if symbol == NEGATION:
        return REACH, OTHER, 1.0
    if isinstance(symbol, str):
        return max(state - 1, 0), (symbol, "negated" if state else "plain"), CONTEXTS["negated"] if state else 1.0
    return max(state - 1, 0), symbol, 1.0


def reports(state, symbol):
    """Heads after a verb of saying or within quotation marks."""
    said, quoted = state
    if symbol == REPORT:
        return (True, quoted), OTHER, 1.0
    if symbol == QUOTE:
        return (said, not quoted), OTHER, 1.0
    if isinstance(symbol, tuple) and symbol[1] == "plain" and (said or quoted):
        return state, (symbol[0], "reported"), CONTEXTS["reported"]
    return state, symbol, 1.0


def compose(first: Callable, second: Callable) -> Callable:
    """The transducer that feeds the output of ``first`` to ``second``; weights are multiplied."""

    def both(state, symbol):
        a, middle, v = first(state[0], symbol)
        b, out, w = second(state[1], middle)
        return (a, b), out, v * w

    return both


class Table:
    """A transducer as a table: ``arcs[state][symbol]`` is (state, pattern or -1, weight); state 0 is the start."""

    def __init__(self, step: Callable, start, symbols: int):
        known, todo, arcs = {start: 0}, [start], []
        while todo:
            state, row = todo.pop(0), []
            for symbol in range(symbols):
                after, out, weight = step(state, symbol)
                if after not in known:
                    known[after] = len(known)
                    todo.append(after)
                row.append((known[after], PATTERNS.index(out) if isinstance(out, tuple) else -1, weight))
            arcs.append(row)
        self.arcs = arcs
        #: State after 0 .. REACH + 1 words of no class; more of them change nothing.
        self.idle = [list(range(len(arcs)))]
        for _ in range(REACH + 1):
            self.idle.append([arcs[s][OTHER][0] for s in self.idle[-1]])


def grammar() -> Table:
    step = compose(compose(compose(threats, targets), negations), reports)
    return Table(step, (((0, (0, "", 0)), 0), (False, False)), QUOTE + 1)


# --- words and clauses ---------------------------------------------------------------------------


def _lowered(column: pa.Array) -> Texts:
    return Texts(pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string())))


def _hashes(words: list[str]) -> np.ndarray:
    texts = Texts(pa.array(words, pa.large_string()))
    return Spans(texts, texts.at[:-1], texts.at[1:]).hashes()


def _beginnings(words: Spans, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the first ``size`` code points of all words that are longer."""
    data = words.texts.bytes[: words.texts.n]
    places = np.flatnonzero((data & 0xC0) != 0x80)
    cut = np.searchsorted(places, words.start) + size
    at = np.flatnonzero(cut < len(places))
    at = at[places[cut[at]] < words.end[at]]
    part = Spans(words.texts, words.start[at], places[cut[at]], words.owner[at])
    return at, part.hashes()


class Lexicon:
    """Class and strength of words; learned insults are (length or 0 for the whole word, hash, strength)."""

    def __init__(self, learned: list[tuple[int, int, float]]):
        listed = [(w, c) for c, ws in ((BREAK, BREAKS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (INTENTION, INTENTIONS), (HARM, HARMS), (INSULT, INSULTS)) for w in ws]
        fixed = {int(h): (c, 1.0) for h, (_, c) in zip(_hashes([w for w, _ in listed]), listed)}
        for size, h, strength in learned:
            if size == 0:
                fixed.setdefault(h, (INSULT, strength))
        self.words = np.array(sorted(fixed), np.uint64)
        self.kind = np.array([fixed[int(h)][0] for h in self.words], np.int64)
        self.strength = np.array([fixed[int(h)][1] for h in self.words])
        self.parts = {}
        for size in sorted({s for s, _, _ in learned if s}):
            mine = sorted((h, x) for s, h, x in learned if s == size)
            self.parts[size] = np.array([h for h, _ in mine], np.uint64), np.array([x for _, x in mine])

    def read(self, words: Spans) -> tuple[np.ndarray, np.ndarray]:
        """Class and strength of every word."""
        kind, strength = np.zeros(len(words), np.int64), np.zeros(len(words))
        if not len(words):
            return kind, strength
        for size, (known, value) in self.parts.items():
            at, h = _beginnings(words, size)
            slot = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[slot] == h
            kind[at[hit]] = INSULT
            strength[at[hit]] = np.maximum(strength[at[hit]], value[slot[hit]])
        h = words.hashes()
        slot = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        hit = np.flatnonzero(self.words[slot] == h)
        kind[hit], strength[hit] = self.kind[slot[hit]], self.strength[slot[hit]]
        return kind, strength


_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?;\n")] = True


class Matches:
    """What the grammar matches in the texts of a column: sums by pattern, matched clauses, the heaviest clause."""

    def __init__(self, column: pa.Array, lexicon: Lexicon, table: Table):
        texts = _lowered(column)
        words = texts.runs(ALNUM)
        kind, strength = lexicon.read(words)
        n = len(column)
        self.sums = np.zeros((n, len(PATTERNS)))
        self.words, self.clauses, self.best = words.count, np.zeros(n, np.int64), [None] * n
        data = texts.bytes[: texts.n]
        ends = np.flatnonzero(_ENDS[data])
        breaks = np.cumsum(kind == BREAK)
        # clauses: from one end mark, break word or text to the next
        clause = np.searchsorted(ends, words.start) + breaks + words.owner
        heads = np.flatnonzero((kind == INSULT) | (kind == HARM))
        if not len(heads):
            return
        quotes = np.flatnonzero(data == 0x22)
        before = np.searchsorted(words.start, quotes)
        live = np.unique(clause[heads])
        edges = np.searchsorted(clause, live), np.searchsorted(clause, live, "right")
        for first, last in zip(*(e.tolist() for e in edges)):
            doc = int(words.owner[first])
            at = first + np.flatnonzero(kind[first:last] != OTHER)
            tokens = [(i, 1, k) for i, k in zip(at.tolist(), kind[at].tolist())]
            a, b = np.searchsorted(before, first, "right"), np.searchsorted(before, last - 1, "right")
            if b > a:
                tokens = sorted([*tokens, *((i, 0, QUOTE) for i in before[a:b].tolist())])
            state, done, weight = 0, first, 0.0
            for i, width, symbol in tokens:
                if i > done:
                    state = table.idle[min(i - done, REACH + 1)][state]
                state, pattern, factor = table.arcs[state][OTHER if symbol == BREAK else symbol]
                done = i + width
                if pattern >= 0:
                    # a target that comes late speaks for the head before it
                    x = strength[i] or 1.0
                    self.sums[doc, pattern] += x
                    weight += x * factor
            if weight:
                self.clauses[doc] += 1
                if self.best[doc] is None or weight > self.best[doc][0]:
                    self.best[doc] = weight, bytes(texts.bytes[words.start[first] : words.end[last - 1]]).decode("utf-8", "replace")


def _rows(m: Matches) -> np.ndarray:
    """Features of the margin: the grammar's own weight, each pattern, and the weight for a hundred words."""
    own = m.sums @ PRIOR
    return np.column_stack([np.log1p(own), np.log1p(m.sums), np.minimum(100.0 * own / np.maximum(m.words, 1), 20.0)])


class Model:
    """Learned insults, weights of the features, calibration."""

    def __init__(self, learned: list[tuple[int, int, float]], weights: np.ndarray, bias: float, scale: float, shift: float):
        self.learned, self.weights, self.bias, self.scale, self.shift = learned, weights, bias, scale, shift

    def scores(self, m: Matches) -> np.ndarray:
        return sigmoid(self.scale * (_rows(m) @ self.weights + self.bias) + self.shift)


#: The grammar's own judgement, for tables without labels of both kinds.
UNTRAINED = Model([], np.array([1.5, *[0.0] * len(PATTERNS), 0.1]), -3.0, 1.0, 0.0)

# --- learning ------------------------------------------------------------------------------------


def learn_insults(column: pa.Array, toxic: np.ndarray) -> list[tuple[int, int, float]]:
    """Words and word beginnings that explain toxic texts, the most explaining first."""
    words = _lowered(column).runs(ALNUM)
    if not len(words) or not toxic.any() or toxic.all():
        return []
    whole = words.hashes()
    forms = [(words.owner, whole, 0)]
    for size in PREFIXES:
        at, h = _beginnings(words, size)
        forms.append((words.owner[at], h, size))
    owner = np.concatenate([o for o, _, _ in forms])
    # the length is part of the form, so that a word and a beginning of the same letters stay apart
    form = np.concatenate([mix(h + np.uint64(size)) for _, h, size in forms])
    raw, size = np.concatenate([h for _, h, _ in forms]), np.concatenate([np.full(len(h), s) for _, h, s in forms])
    order = np.lexsort((owner, form))
    owner, form, raw, size = owner[order], form[order], raw[order], size[order]
    fresh = np.ones(len(form), bool)
    fresh[1:] = (form[1:] != form[:-1]) | (owner[1:] != owner[:-1])
    owner, form, raw, size = owner[fresh], form[fresh], raw[fresh], size[fresh]
    # texts with the same least pair of words are taken for near copies and share one vote
    pair, first = words.windows(whole, 2)
    least = np.full(len(column), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, words.owner[first], pair)
    _, group, copies = np.unique(np.where(words.count > 1, least, mix(np.arange(len(column), dtype=np.uint64))), return_inverse=True, return_counts=True)
    vote = 1.0 / copies[group]
    start = run_starts(form)
    slot = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(form))))
    clean = np.bincount(slot, np.where(toxic[owner], 0.0, vote[owner]), len(start))
    total = np.bincount(slot, np.where(toxic[owner], vote[owner], 0.0), len(start))
    n1, n0 = vote[toxic].sum(), vote[~toxic].sum()
    odds = ((total + 0.1) / (n1 + 0.2)) / ((clean + 0.1) / (n0 + 0.2))
    fit_for = (total >= LEAST) & (odds >= CLEARER)
    mine = np.flatnonzero(fit_for[slot] & toxic[owner])
    left, chosen = vote * toxic, []
    length = np.where(size[start] == 0, 99, size[start])
    for _ in range(ROUNDS):
        gain = np.bincount(slot[mine], left[owner[mine]], len(start))
        gain[gain < LEAST / 2] = 0.0
        value = gain * np.log(odds)
        if not (value > 0).any():
            break
        # of forms that explain the same texts the longer one, the whole word before all
        best = np.flatnonzero(value >= value.max() * (1 - 1e-9))
        best = best[np.argmax(length[best])]
        chosen.append((int(size[start[best]]), int(raw[start[best]]), float(total[best] / (total[best] + clean[best]))))
        hit = owner[mine[slot[mine] == best]]
        left[hit] *= 0.3
        mine = mine[slot[mine] != best]
    return chosen


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(scale, shift) by Platt's method; the penalty keeps them finite where the margin separates a small sample."""
    if len(set(y)) < 2:
        return 1.0, 0.0
    w, b = fit(Rows([np.zeros(1, np.int32)] * len(y), list(margin[:, None]), 1), y, logistic, penalty=0.1)
    return (float(w[0]), b) if w[0] > 0 else (1.0, 0.0)


def fit_model(texts: pa.Array, toxic: np.ndarray, apart: np.ndarray, prior: float) -> Model:
    """``prior``: what the log odds of the drawn rows lack to those of all labelled rows."""
    pick = lambda mask: texts.take(pa.array(np.flatnonzero(mask)))
    learned = learn_insults(pick(~apart), toxic[~apart])
    lexicon, table = Lexicon(learned), grammar()
    x = _rows(Matches(texts, lexicon, table))
    y = np.where(toxic, 1.0, -1.0)
    index = np.arange(x.shape[1], dtype=np.int32)
    rows = Rows([index] * int((~apart).sum()), list(x[~apart]), x.shape[1])
    w, b = fit(rows, y[~apart], logistic, penalty=1.0)
    scale, shift = calibrate(x[apart] @ w + b, y[apart])
    return Model(learned, w, b, scale, shift + prior)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most about ``sample`` labels, a third of them of toxic documents where there are as many."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("y"))
    marks = marks.where("doc_id is not null and y is not null").where(~held_out())
    count = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(count) < 2:
        return UNTRAINED
    rate = {1: min(1.0, sample / 3 / count[1]), 0: min(1.0, 2 * sample / 3 / count[0])}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    drawn = marks.where(draw < F.when(F.col("y") == 1, rate[1]).otherwise(rate[0])).distinct()
    # about ``sample`` rows of two numbers, whatever the number of labels; a repeated doc_id has one text for each label
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    texts = known.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "y"])
        toxic = pdf["y"].to_numpy() == 1
        apart = mix(pdf["doc_id"].to_numpy().astype(np.uint64)) % np.uint64(5) == 0
        if len(set(toxic[~apart])) < 2:
            return pd.DataFrame({"size": [[]], "form": [[]], "strength": [[]], "weights": [[]], "rest": [[]]})
        m = fit_model(pa.array(pdf["text"], pa.large_string()), toxic, apart, float(np.log(rate[0] / rate[1])))
        size, form, strength = [[x[i] for x in m.learned] for i in range(3)]
        signed = [int(np.uint64(h).astype(np.int64)) for h in form]
        return pd.DataFrame({"size": [size], "form": [signed], "strength": [strength], "weights": [m.weights.tolist()], "rest": [[m.bias, m.scale, m.shift]]})

    schema = "size array<long>, form array<long>, strength array<double>, weights array<double>, rest array<double>"
    row = texts.groupBy().applyInPandas(one, schema).first()
    if row is None or not row["rest"]:
        return UNTRAINED
    learned = [(s, int(np.int64(h).astype(np.uint64)), x) for s, h, x in zip(row["size"], row["form"], row["strength"])]
    return Model(learned, np.array(row["weights"]), *row["rest"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every document (struct ``doc``) with held_out, score, predicted, n_clauses and the heaviest matched clause. Map-only."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, table = Lexicon(sent.value.learned), grammar()
        for batch in batches:
            for rows in slices(batch, "text"):
                m = Matches(rows.column("text"), lexicon, table)
                p = sent.value.scores(m)
                clause = pa.array([b and b[1] for b in m.best], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc"), rows.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(m.clauses), clause],
                    ["doc", "held_out", "score", "predicted", "n_clauses", "clause"],
                )

    pair = docs.select(F.struct("*").alias("doc"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = T.StructType().add("doc", docs.schema, False).add("held_out", "boolean").add("score", "double").add("predicted", "integer").add("n_clauses", "long").add("clause", "string")
    return pair.mapInArrow(run, schema)
