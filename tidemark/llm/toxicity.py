"""Toxicity by weak supervision.

1. Words and word beginnings (4 to 8 characters) that toxic texts hold far
   more often are mined from a bounded sample of labelled rows. An entry that a
   shorter mined one covers is left out, and the rest is dealt by stem to
   STRONG + WEAK lexicons, so no two lexicons share a stem.
2. Each lexicon votes on a text, and so do patterns: how dense strong hits
   are, how many strong lexicons are hit, hits in disguise (digits for letters, letters set apart),
   insults in address, shouting and exclamation. A voter says toxic, clean or nothing.
3. A generative label model is fitted by EM over the distinct vote patterns of
   the sample, without the given labels. Given the hidden label, voters form a
   tree: each has an accuracy table and depends on the voter with which it
   shares most beyond the label. Tree and tables are estimated together.
4. A linear classifier (logistic regression) on graded votes is trained on the
   model's posterior labels and scores every whole text.

Learning uses at most MAX_LABELLED labelled rows, chosen by hash of their id,
which are read once; what makes an entry strong and the longest beginning are chosen
on a third of them that the rest was learnt without. Scoring reads all. A score depends on the text alone.

Defined cases: a null or empty text has no votes and gets the score of a clean
text; a null doc_id is carried through; repeated rows get equal scores, and an id
is learnt from with all its rows or not at all; without labelled rows every
score is 0; an empty table gives an empty result. Only doc_id and text, and of
the labels doc_id and toxic, are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.shingles import text_batches

#: Labelled rows that learning reads at most.
MAX_LABELLED = 20_000
#: Entries of a lexicon at most, those with the strongest evidence.
MAX_ENTRIES = 2_000
MIN_SUPPORT = 4
MIN_LOG_ODDS = 4.0
BEGINNINGS = (4, 5, 6, 7, 8)
KINDS = ("word", *(f"p{n}" for n in BEGINNINGS))
#: Lexicons of entries that a large share of toxic texts hold, and of others.
STRONG, WEAK = 16, 8
#: The share that makes an entry strong, and the longest beginnings: what is tried on a part of the learnable rows.
STRONG_SHARE, SHARES, LONGEST = 0.02, (0.01, 0.02, 0.05), (6, 8)
#: One part in so many of the learnable rows judges the choices.
INNER = 3
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
SHOUT = re.compile(r"\b[A-Z]{3,}\b")
# each takes time linear in the text: runs are possessive and start at a word's start
DIGIT = re.compile(r"[013457@$]")
DISGUISED = re.compile(r"(?<![a-z])[a-z]++[013457@$][a-z013457@$]*[a-z]")
APART = re.compile(r"[ .-][a-z][ .-][a-z][ .-][a-z](?:[ .-][a-z](?![a-z]))++")
PLAIN = str.maketrans("013457@$", "oieastas", " .-")
ADDRESS = re.compile(r"you(?<!\wyou)(?:'re| are)(?: such)?(?: an?)?(?: \w++)? (\w++)")


def held_out(doc_id: Column) -> Column:
    """The rows that labels are never learnt from: crc32 of the id as text is 2 modulo 4."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def _features(text: str) -> set[tuple[int, str]]:
    out = set()
    for w in set(WORD.findall(text.lower())):
        if len(w) >= 3:
            out.add((0, w))
        for k, n in enumerate(BEGINNINGS, 1):
            if len(w) >= n:
                out.add((k, w[:n]))
    return out


def mine(sample: DataFrame) -> list[dict[str, tuple[float, bool]]]:
    """A table a kind, entry -> (log odds, share of the toxic texts that hold it); ``sample`` has text and toxic."""

    def rows(batches):
        for b, texts in text_batches(batches):
            kind, entry, y = [], [], []
            for t, label in zip(texts, b.column("toxic").to_pylist(), strict=True):
                for k, e in _features(t.decode("utf-8", "replace")):
                    kind.append(k)
                    entry.append(e)
                    y.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(entry, pa.string()), pa.array(y, pa.int32())], ["kind", "entry", "toxic"])

    n1, n0 = (float(x or 0) for x in sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    seen = sample.select("text", "toxic").mapInArrow(rows, "kind int, entry string, toxic int").groupBy("kind", "entry").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    strong = seen.filter(F.col("a") >= MIN_SUPPORT).withColumn("o", odds).filter(F.col("o") >= MIN_LOG_ODDS)
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("o"), F.desc("a"), "entry"))
    out: list[dict[str, tuple[float, bool]]] = [{} for _ in KINDS]
    # MAX_ENTRIES a kind
    for r in strong.withColumn("place", place).filter(F.col("place") <= MAX_ENTRIES).orderBy("kind", "place").collect():
        out[r["kind"]][r["entry"]] = (r["o"], r["a"] / n1)
    return out


def dealt(mined: list[dict[str, tuple[float, float]]], share: float = STRONG_SHARE, longest: int = BEGINNINGS[-1]) -> list[dict[str, tuple[float, bool]]]:
    """STRONG + WEAK lexicons, entry -> (log odds, whether it is a whole word), those of one stem in one."""
    out: list[dict[str, tuple[float, bool]]] = [{} for _ in range(STRONG + WEAK)]
    used = [(j, n) for j, n in enumerate(BEGINNINGS, 1) if n <= longest]
    for k in (*(j for j, _ in used), 0):
        for e, (o, held) in mined[k].items():
            if not any(e[:n] in mined[j] for j, n in used if (n < len(e) if k else n <= len(e))):
                h = zlib.crc32(e[: BEGINNINGS[0]].encode())
                out[h % STRONG if held >= share else STRONG + h % WEAK][e] = (o, k == 0)
    return out


class Voters:
    """Counts of lexicon hits and pattern figures of a text."""

    def __init__(self, lexicons: list[dict[str, tuple[float, bool]]]):
        self.n, self.auto = len(lexicons), None
        self.entries = {e: (k, o, whole) for k, lex in enumerate(lexicons) for e, (o, whole) in lex.items()}
        if self.entries:
            import ahocorasick

            self.auto = ahocorasick.Automaton()
            for e, v in self.entries.items():
                self.auto.add_word(e, (len(e), *v))
            self.auto.make_automaton()

    def listed(self, word: str) -> bool:
        return word in self.entries or any(word[:n] in self.entries and not self.entries[word[:n]][2] for n in BEGINNINGS)

    def graded(self, text: str) -> np.ndarray:
        """On log scales: hits a lexicon, log odds of strong ones and how many a hundred words, hits in disguise and in address, shouted words and exclamations."""
        low = text.lower()
        hits, weight, firm, disguised, address = [0] * self.n, 0.0, 0, 0, 0
        if self.auto is not None:
            for end, (n, k, o, whole) in self.auto.iter(low):
                start = end - n + 1
                if start and low[start - 1].isalpha():
                    continue
                if not whole or end + 1 == len(low) or not low[end + 1].isalpha():
                    hits[k] += 1
                    if k < STRONG:
                        weight += o
                        firm += 1
            odd = APART.findall(" " + low) + (DISGUISED.findall(low) if DIGIT.search(low) else [])
            disguised = sum(self.listed(x.translate(PLAIN)) for x in odd)
            address = sum(self.listed(x) for x in ADDRESS.findall(low))
        words = text.count(" ") + text.count("\n") + 1
        return np.log1p([*hits, weight, 100.0 * firm / words, disguised, address, 100.0 * len(SHOUT.findall(text)) / words, text.count("!")])

    @staticmethod
    def votes(x: np.ndarray) -> np.ndarray:
        """1 toxic, -1 clean, 0 no vote, a column a voter, from graded figures."""
        lex, rest = x[:, : STRONG + WEAK] > 0, np.expm1(x[:, STRONG + WEAK :])
        kinds, dense = lex[:, :STRONG].sum(axis=1), rest[:, 1]
        return np.column_stack([
            lex.astype(int),
            np.where(kinds == 0, -1, np.where(kinds >= 2, 1, 0)),
            np.where(dense >= 1.0, 1, np.where(dense == 0, -1, 0)),
            (rest[:, 2] > 0).astype(int),
            (rest[:, 3] > 0).astype(int),
            (rest[:, 4] >= 30).astype(int),
            (rest[:, 5] >= 5).astype(int),
        ])


class LabelModel:
    """A hidden label whose voters form a tree given it, fitted by EM.

    ``table`` (label, voter, vote) holds a voter's own probabilities, ``given``
    (label, voter, vote, parent's vote) those of voters with a parent, from the
    joint votes of both, backed by ``table``. The tree is the greatest spanning
    tree by what two voters share beyond the label (Chow and Liu), without
    links of less than LEAST nats; it is found anew every few rounds.
    """

    LEAST = 0.002

    def __init__(self, votes: np.ndarray, rounds: int = 60, anew: int = 5):
        patterns, inverse, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
        one = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)
        m, flat = patterns.shape[1], one.reshape(len(patterns), -1)
        post = 1 / (1 + np.exp(-2.0 * patterns.sum(axis=1)))
        self.parent = np.full(m, -1)
        for r in range(rounds):
            mass = np.stack([(1 - post) * n, post * n])
            self.prior = np.clip(mass.sum(axis=1) / n.sum(), 1e-4, 1)
            table = np.einsum("yp,pvk->yvk", mass, one) + 0.1
            self.table = table / table.sum(axis=2, keepdims=True)
            joint = np.stack([(flat * w[:, None]).T @ flat for w in mass]).reshape(2, m, 3, m, 3).transpose(0, 1, 3, 2, 4)
            if r % anew == 0:
                shared = self._shared(joint, n.sum())
                self.parent = self._tree(shared)
            some = np.flatnonzero(self.parent >= 0)
            self.given = np.zeros((2, m, 3, 3))
            if len(some):
                both = joint[:, some, self.parent[some]]
                self.given[:, some] = (both + self.table[:, some, :, None]) / (both.sum(axis=2, keepdims=True) + 1)
            free = np.flatnonzero(self.parent < 0)
            log = np.log(self.prior)[:, None] + np.einsum("pvk,yvk->yp", one[:, free], np.log(self.table[:, free]))
            if len(some):
                log += np.einsum("pvk,pvl,yvkl->yp", one[:, some], one[:, self.parent[some]], np.log(self.given[:, some]), optimize=True)
            post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        self.accuracy = (self.prior[:, None] * self.table[:, :, [0, 2]][[0, 1], :, [0, 1]]).sum(axis=0)
        own = -(self.prior[:, None, None] * self.table * np.log(self.table)).sum(axis=(0, 2))
        #: A voter's share of what it and those that depend on it say.
        self.weight = 1 / (1 + (shared / np.maximum(own, 1e-9)[:, None]).sum(axis=1))
        self.posterior = post[inverse]

    @staticmethod
    def _shared(joint: np.ndarray, n: float) -> np.ndarray:
        """Mutual information of each two voters given the label, in nats."""
        p = joint / np.maximum(joint.sum(axis=(3, 4), keepdims=True), 1e-12)
        apart = p.sum(axis=4, keepdims=True) * p.sum(axis=3, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(p > 0, p * np.log(p / apart), 0.0)
        out = (joint.sum(axis=(3, 4)) / n * part.sum(axis=(3, 4))).sum(axis=0)
        np.fill_diagonal(out, 0)
        return out

    @classmethod
    def _tree(cls, shared: np.ndarray) -> np.ndarray:
        """Each voter's parent, or -1; parts that share too little are trees of their own."""
        m = len(shared)
        parent, best, done = np.full(m, -1), np.full(m, -1.0), np.zeros(m, bool)
        for _ in range(m):
            v = int(np.argmax(np.where(done, -2.0, best)))
            if best[v] < cls.LEAST:
                parent[v] = -1
            done[v] = True
            closer = ~done & (shared[v] > best)
            best[closer], parent[closer] = shared[v][closer], v
        return parent


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights by Newton steps; the last is the intercept."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    keep = ridge * np.eye(len(w))
    keep[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + keep, a.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most MAX_LABELLED rows (text, toxic) that are not held out: ids by hash, each with all its rows."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    # at most MAX_LABELLED ids, so the broadcasts and the window are bounded
    rows = docs.select("doc_id").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= MAX_LABELLED)
    within = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")) <= MAX_LABELLED
    few = rows.withColumn("_in", within).filter("_in").select("doc_id", "toxic")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id").select("text", "toxic")


def chosen(sample: DataFrame) -> tuple[float, int]:
    """The share and the longest beginning with the fewest wrong verdicts on a part of the learnable rows that the rest was learnt without.

    Both labels weigh the same; of equals the one with the least log loss is taken. Rows of one text fall in one part. Rows that are held out play no part, so their
    labels shape nothing.
    """
    inner = F.pmod(F.xxhash64("text"), F.lit(INNER))
    mined = mine(sample.filter(inner != 0))
    choices = [(share, longest) for share in SHARES for longest in LONGEST]
    lexicons = [dealt(mined, *c) for c in choices]

    def rows(batches):
        voters = [Voters(x) for x in lexicons]
        for b, texts in text_batches(batches):
            x = [np.concatenate([v.graded(t) for v in voters]).astype(np.float32).tobytes() for t in (t.decode("utf-8", "replace") for t in texts)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("judge"), pa.array(x, pa.binary())], ["toxic", "judge", "x"])

    # MAX_LABELLED rows at most
    got = sample.select("text", "toxic", (inner == 0).alias("judge")).mapInArrow(rows, "toxic int, judge boolean, x binary").toPandas()
    judge, y = got["judge"].to_numpy(dtype=bool), got["toxic"].to_numpy()
    if not judge.any() or len({*y[judge]}) < 2 or len({*y[~judge]}) < 2:
        return STRONG_SHARE, BEGINNINGS[-1]
    every = np.frombuffer(b"".join(got["x"]), dtype=np.float32).reshape(len(got), len(choices), -1).astype(np.float64)
    losses = []
    for k in range(len(choices)):
        x = every[:, k]
        w = _logistic(x[~judge], LabelModel(Voters.votes(x[~judge])).posterior)
        p = np.clip(1 / (1 + np.exp(-np.clip(x[judge] @ w[:-1] + w[-1], -30, 30))), 1e-6, 1 - 1e-6)
        told = (p >= THRESHOLD) == (y[judge] == 1)
        missed = 2 - told[y[judge] == 1].mean() - told[y[judge] == 0].mean()
        losses.append((round(float(missed), 6), round(float(-np.mean(np.where(y[judge] == 1, np.log(p), np.log(1 - p)))), 6)))
    return choices[losses.index(min(losses))]


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[dict[str, tuple[float, bool]]], np.ndarray, LabelModel | None]:
    """Lexicons, classifier weights and label model from rows that are not held out."""
    sample = cut(labelled(docs, labels))
    lexicons = dealt(mine(sample), *chosen(sample))
    graded = sample.select("text").mapInArrow(_grader(lexicons, []), "x array<double>").toPandas()
    if not len(graded):
        return lexicons, np.zeros(0), None
    x = np.array(graded["x"].tolist())
    model = LabelModel(Voters.votes(x))
    return lexicons, _logistic(x, model.posterior), model


def _grader(lexicons: list[dict[str, tuple[float, bool]]], carry: list[str], score: Callable | None = None):
    def rows(batches):
        voters = Voters(lexicons)
        for b, texts in text_batches(batches):
            x = [voters.graded(t.decode("utf-8", "replace")) for t in texts]
            out = pa.array([v.tolist() for v in x], pa.list_(pa.float64())) if score is None else pa.array(score(np.array(x)), pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], out], [*carry, "x" if score is None else "score"])

    return rows


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, a row a document."""
    lexicons, w, _ = fit(docs, labels)

    def linear(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) if len(w) else np.zeros(len(x))

    got = docs.select("doc_id", "text").mapInArrow(_grader(lexicons, ["doc_id"], linear), "doc_id bigint, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
