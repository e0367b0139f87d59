"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors.

1. Terms of a text are its words and their beginnings of 4 and 5 bytes, hashed
   into spaces of SPACES slots. Document frequencies by label are counted over
   all labelled training rows; terms with a high log odds ratio, and a high
   z-value of it, form the lexicons (words) and patterns (beginnings).
2. Voters say toxic, clean or abstain: the fixed insult list, the learned
   lexicon, the patterns of 4 and of 5 bytes, several different terms, the
   density of terms, shouting, and the absence of any term.
3. The label model has a rate for each voter, class and vote. It is fitted by EM
   on the histogram of vote patterns of all documents (labels are not used),
   starting from the share of toxic votes. Voters that agree more than the class
   explains share their weight: a voter's log odds are divided by one plus the
   sum of its positive correlations given the class.
4. A logistic classifier on the terms found, their number and the voters is
   trained on the posteriors of TRAIN_ROWS documents at most (those of smallest
   hash, toxic and clean patterns alike), and its margin is scaled to a
   probability on the labelled training rows.

Only the term rows found in a text leave the second pass over it; scoring needs
no third. Model state is bounded by the hash spaces and the vote patterns.

Edge cases: a null or empty text has no term and gets the score of such texts.
Repeated rows are scored alike. Labels of a doc_id that disagree count as toxic
if half of them do; a null label is none. Without a toxic training row only the
fixed list votes toxic, and scores are its posteriors. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilake.llm import text as T
from epilake.llm.tables import lookup, read_table, written

SPACES = (1 << 17, 1 << 16, 1 << 17)  # words, beginnings of 4 bytes, of 5
N_TERMS = sum(SPACES)
#: Least log odds ratio of a term, and least root of its G statistic (words are many, so chance finds more of them).
LEAST_ODDS, LEAST_G_WORD, LEAST_G_BEGIN = 1.5, 4.5, 3.5
TRAIN_ROWS = 20_000
THRESHOLD = 0.7
#: General insults in English, as a voter that needs no labels.
INSULTS = ("idiot idiots moron morons stupid dumb loser losers pathetic worthless trash scum garbage disgusting clown fool "
           "fools imbecile filth filthy vermin bastard jerk creep hate kill ugly shut").split()
VOTERS = ("insults", "lexicon", "begin4", "begin5", "several", "density", "shouting", "nothing")
_OFFSETS = np.cumsum((0, *SPACES[:-1]))
_INSULTS = np.sort(T.words([w.encode() for w in INSULTS], T.PUNCT, latin=True)[0])


def _parts(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, span):
    long4, long5 = ends - starts > 4, ends - starts > 5
    one = span(starts, np.where(long4, starts + 4, ends))
    two = span(starts, np.where(long5, starts + 5, ends))
    loud = (ends - starts > 2) & (b[starts] >= 65) & (b[starts] <= 90) & (b[ends - 1] >= 65) & (b[ends - 1] <= 90)
    return np.where(long4, one, 0), np.where(long5, two, 0), loud


@dataclass
class Terms:
    """Distinct (text, term) pairs in order, with facts of each text."""
    owner: np.ndarray
    term: np.ndarray
    n_words: np.ndarray
    insults: np.ndarray
    loud: np.ndarray


def terms(texts: list[bytes], wanted: np.ndarray | None = None) -> Terms:
    """wanted: a mask over all terms; others are left out."""
    h, counts, more = T.words(texts, T.PUNCT, latin=True, also=_parts)
    n = len(texts)
    owner = np.repeat(np.arange(n), counts)
    if not len(h):
        zero = np.zeros(n, np.int64)
        return Terms(owner, np.empty(0, np.int64), counts, zero, zero)
    pieces = []
    for k, x in enumerate((h, more[0], more[1])):
        keep = x != 0
        term = _OFFSETS[k] + (T.mix(x[keep]) >> np.uint64(65 - SPACES[k].bit_length())).astype(np.int64)
        own = owner[keep]
        if wanted is not None:
            hit = wanted[term]
            term, own = term[hit], own[hit]
        pieces.append(own * N_TERMS + term)
    pair = np.unique(np.concatenate(pieces))
    bad = np.isin(h, _INSULTS)
    return Terms(pair // N_TERMS, pair % N_TERMS, counts, np.bincount(owner[bad], minlength=n), np.bincount(owner[more[2]], minlength=n))


def _frequency_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean, n_toxic, n_clean = np.zeros(N_TERMS, np.int64), np.zeros(N_TERMS, np.int64), 0, 0
    for batch in batches:
        texts, label = T.texts_of(batch["text"]), np.asarray(batch["toxic"].to_pylist(), bool)
        for a, b in T.groups(texts):
            t = terms(texts[a:b])
            own = label[a:b][t.owner]
            toxic += np.bincount(t.term[own], minlength=N_TERMS)
            clean += np.bincount(t.term[~own], minlength=N_TERMS)
        n_toxic, n_clean = n_toxic + int(label.sum()), n_clean + int((~label).sum())
    if n_toxic + n_clean:
        at = np.flatnonzero(toxic + clean)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(toxic[at], n_toxic)), pa.array(np.append(clean[at], n_clean))],
                                         ["term", "toxic", "clean"])


def lexicon(labelled: DataFrame) -> dict[int, float]:
    """Terms that speak for toxic, with their log odds ratio. labelled: text, toxic; every row is counted."""
    got = labelled.mapInArrow(_frequency_partition, "term long, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    got = written(got, "toxic-frequencies")
    sums = got.where("term = -1").first()
    if sums is None or not sums.toxic:
        return {}
    n_toxic, n_clean = sums.toxic, sums.clean
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(t / (n_toxic - F.col("toxic") + 0.5)) - F.log(c / (n_clean - F.col("clean") + 0.5))
    share = (F.col("toxic") + F.col("clean")) / (n_toxic + n_clean)
    gain = F.col("toxic") * F.log(F.col("toxic") / n_toxic / share)
    gain = gain + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / n_clean / share)).otherwise(0.0)
    rows = got.where("term >= 0 and toxic > 1").select("term", odds.alias("odds"), F.sqrt(F.greatest(F.lit(0.0), 2 * gain)).alias("root"))
    least = F.when(F.col("term") < SPACES[0], LEAST_G_WORD).otherwise(LEAST_G_BEGIN)
    rows = rows.where((F.col("odds") >= LEAST_ODDS) & (F.col("root") >= least)).collect()  # N_TERMS rows at most
    return {r.term: r.odds for r in rows}


def _vote(t: Terms, odds: np.ndarray) -> np.ndarray:
    """Votes of each voter on each text: 1 toxic, -1 clean, 0 abstains."""
    n = len(t.n_words)
    space = np.searchsorted(_OFFSETS, t.term, "right") - 1
    hits = np.stack([np.bincount(t.owner[space == k], minlength=n) for k in range(3)])
    strong = np.bincount(t.owner[odds[t.term] >= 2.5], minlength=n) if len(t.term) else np.zeros(n, int)
    total = hits.sum(axis=0)
    words = np.maximum(t.n_words, 1)
    on = lambda x: x.astype(np.int8)
    return np.stack([
        on(t.insults > 0), on(hits[0] > 0), on(hits[1] > 0), on(hits[2] > 0), on(strong > 1),
        on(total / words > 0.02), on(t.loud / words > 0.5), -on((total == 0) & (t.insults == 0))], axis=1)


def _find_partition(odds_of: dict[int, float], keep: tuple[str, ...]):
    def run(batches):
        odds = np.zeros(N_TERMS)
        odds[list(odds_of)] = list(odds_of.values())
        wanted = odds > 0
        for batch in batches:
            texts = T.texts_of(batch["_text"])
            for a, b in T.groups(texts):
                t = terms(texts[a:b], wanted)
                at = np.searchsorted(t.owner, np.arange(b - a + 1)).astype(np.int32)
                votes = _vote(t, odds)
                yield pa.RecordBatch.from_arrays(
                    [*(batch[k].slice(a, b - a) for k in keep), pa.ListArray.from_arrays(pa.array(at), pa.array(t.term)),
                     pa.array(["".join("-0+"[v + 1] for v in row) for row in votes], pa.string())], [*keep, "terms", "votes"])

    return run


class LabelModel:
    """Rates of votes given the class, weights against double counting, and the prior."""

    def __init__(self, patterns: np.ndarray, n: np.ndarray, rounds: int = 200):
        """patterns: votes by row; n: documents with the pattern."""
        onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
        total = n.sum()
        share = (patterns[:, :-1] == 1).mean(axis=1)
        q = np.clip(np.where((patterns == -1).any(axis=1), 0.02, 0.2 + 1.2 * share), 0.02, 0.98)
        weight = np.ones(patterns.shape[1])
        for _ in range(rounds):
            mass = np.stack([n * (1 - q), n * q], axis=1)
            self.prior = float(np.clip(mass[:, 1].sum() / total, 1e-4, 0.5))
            self.rates = np.stack([(np.einsum("p,pvk->vk", mass[:, y], onehot) + 0.5) / (mass[:, y].sum() + 1.5) for y in (0, 1)])
            # correlations of the votes given the class
            corr = np.zeros((patterns.shape[1],) * 2)
            for y in (0, 1):
                w = mass[:, y] / max(mass[:, y].sum(), 1e-9)
                d = patterns - w @ patterns
                cov = (d * w[:, None]).T @ d
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                corr += np.where(np.outer(sd, sd) > 1e-6, cov / np.outer(sd, sd), 0) * (mass[:, y].sum() / total)
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.clip(corr, 0, 1).sum(axis=1))
            self.weight, self.correlations = weight, corr
            new = self.posterior(patterns)
            done = np.abs(new - q).max() < 1e-7
            q = new
            if done:
                break

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        idx = patterns.astype(int) + 1
        rows = np.arange(idx.shape[1])
        odds = np.log(self.rates[1][rows, idx]) - np.log(self.rates[0][rows, idx])
        z = np.log(self.prior / (1 - self.prior)) + (odds * self.weight).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _votes(text: str) -> list[int]:
    return ["-0+".index(c) - 1 for c in text]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float, rounds: int = 50) -> np.ndarray:
    """Newton steps for soft labels y in [0, 1]; the last column of x is the constant."""
    beta = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], l2)
    reg[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + reg * beta
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(reg)
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass
class Classifier:
    """Margin: a weight for the log odds of the terms found (sum, most, number) and for each voter."""
    odds: dict
    beta: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)

    def inputs(self, found: list[list[int]], votes: np.ndarray) -> np.ndarray:
        own = [[self.odds[t] for t in ts] for ts in found]
        facts = np.array([[np.log1p(sum(o)), max(o, default=0.0), np.log1p(len(o))] for o in own]).reshape(len(found), 3)
        return np.concatenate((facts, votes, np.ones((len(found), 1))), axis=1)

    def margin(self, found, votes) -> np.ndarray:
        return self.inputs(found, votes) @ self.beta

    def score(self, found, votes) -> np.ndarray:
        z = self.scale[0] * self.margin(found, votes) + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: DataFrame, odds: dict[int, float], limit: int = TRAIN_ROWS) -> Classifier | None:
    """rows: doc_id, terms, votes, toxic (null where it must not be learned from or is unknown)."""
    got = rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ^ voters rows at most
    if not got:
        return None
    model = LabelModel(np.array([_votes(r.votes) for r in got], float), np.array([r.n for r in got], float))
    pick = rows.select("doc_id", "terms", "votes", "toxic", F.xxhash64("doc_id", F.lit("train")).alias("_h"))
    hot = F.substring("votes", 1, len(VOTERS) - 1).contains("+")
    sample = [r for part in (pick.where(hot), pick.where(~hot)) for r in part.orderBy("_h").limit(limit // 2).collect()]
    votes = np.array([_votes(r.votes) for r in sample], float)
    found = [r.terms for r in sample]
    out = Classifier(odds, np.zeros(1))
    x = out.inputs(found, votes)
    out.beta = _logistic(x, model.posterior(votes), np.ones(len(x)), 1.0)
    known = [i for i, r in enumerate(sample) if r.toxic is not None]
    label = np.array([float(sample[i].toxic) for i in known])
    if len(known) > 20 and 0 < label.sum() < len(label):
        m = x[known] @ out.beta
        # the sample has as many documents with a toxic vote as without: weigh them back
        share = {True: 0, False: 0}
        for r in got:
            share["+" in r.votes[:-1]] += r.n
        taken = {k: max(1, sum(("+" in r.votes[:-1]) == k for r in sample)) for k in share}
        w = np.array([share[("+" in sample[i].votes[:-1])] / taken[("+" in sample[i].votes[:-1])] for i in known])
        a, b = _logistic(np.stack([m, np.ones(len(m))], axis=1), label, w / w.mean(), 1e-3)
        if a > 0:
            out.scale = (float(a), float(b))
    return out


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), limit: int = TRAIN_ROWS) -> DataFrame:
    """score (0 to 1) and predicted of every text. labels: doc_id, toxic (boolean), the training rows only."""
    spark = docs.sparkSession
    light = labels.select("doc_id", "toxic")
    labelled = lookup(docs.select("doc_id", "text"), light, "doc_id", "toxic-labels", how="inner").select("text", "toxic")
    odds = lexicon(labelled)
    source = docs.select(*keep, F.col("text").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema.fields)
    found = written(source.mapInArrow(_find_partition(odds, keep), f"{kept}, terms array<long>, votes string"), "toxic-found")
    rows = lookup(found.select("doc_id", "terms", "votes"), light, "doc_id", "toxic-labels")
    shared = spark.sparkContext.broadcast(train(rows, odds, limit))  # N_TERMS terms at most

    def run(batches):
        c = shared.value
        for batch in batches:
            s = c.score(batch["terms"].to_pylist(), np.array([_votes(v) for v in batch["votes"].to_pylist()], float).reshape(-1, len(VOTERS)))
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))],
                                             [*keep, "score", "predicted"])

    return found.mapInArrow(run, f"{kept}, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxic_rows(labels: DataFrame) -> DataFrame:
    """doc_id, toxic: one row for each labelled document."""
    return labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.avg(F.col("toxic").cast("double")) >= 0.5).alias("toxic"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    labels = toxic_rows(read_table(spark, sf_dir, "labels")).where(~held_out(F.col("doc_id")))
    return score(docs, labels, keep=("doc_id", "held_out"))
