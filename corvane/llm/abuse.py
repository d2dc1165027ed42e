"""Abusive, hateful or sexually explicit texts: a counterfactually regularised classifier over sentences.

A logistic model over words, word pairs and triples and the character 3- to 5-grams of words is fitted on labelled
documents only (a bounded sample, see ``MOST_LABELLED`` and ``MOST_BYTES``). Labels are of documents and raters err, so the
sentences of a document are instances of a bag: rounds of expectation maximisation under a noisy-or weigh each sentence of
a document by how far the votes and the model hold it responsible; the raters' error rate is read off their disagreement.
Identity terms in labelled sentences are swapped for others and the change of score is penalised, so that the mention of a
group alone does not raise it; terms are known group words, the usual endings of demonyms, and whatever stands in the same
frames as those in the labelled sentences. The threshold is the best one on documents held out from the fit, by
cross-validation, that flags few ok ones (``MOST_FALSE``). Every document is then scored by its worst sentence; the weights have a fixed number of columns.

Undone before scoring: case, accents, look-alike letters, digits for letters, stretched and spaced letters, hidden
characters; a masked word (``i***t``) is read as the known word that fits best.

Cases: null or empty text scores 0; labels of raters are trimmed and lower-cased, ``unsure``, null and unknown ones do not
count, repeated rows of a rater count once; documents without labels are only scored; without labelled documents of both
kinds there is nothing to learn from and every score is 0; repeated texts are scored each; long texts are read whole. A null
source is a group.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_LABELLED = 20_000  # documents the model is fitted on at most, by hash of the id
MOST_BYTES = 128 << 20  # of their texts together, in the same order
BAD = ("abusive", "hateful", "sexual")
FOLDS = 4
MOST_FALSE = 0.02
ROUNDS, EPOCHS, SWAP = 5, 50, 1.0
PENALTIES = (0.3, 1.0)  # of large weights; cross-validation takes the better one
COLUMNS = 1 << 20
CHARS = (3, 4, 5)

# Letters of other scripts that look like Latin ones, and digits and marks that stand for letters.
LOOKALIKE = str.maketrans("аеорсухкіїјѕԁһԛԝвмнтгбαεορυνικτχɑɡıⅼ", "aeopcyxkiijsdhqwbmhtrbaeopuviktxagil")
LEET = str.maketrans("0134578@$!|+", "oieastbasiit")
# Fixed words: groups of people, from which the terms to swap are found.
GROUPS = frozenset("women men girls boys migrants immigrants refugees foreigners muslims jews christians hindus catholics blacks whites asians africans arabs mexicans gypsies gays lesbians homosexuals transgender disabled elderly frauen manner auslander fluchtlinge juden muslime mujeres hombres inmigrantes extranjeros judios musulmanes femmes hommes migrants etrangers juifs musulmans".split())
DEMONYM = re.compile(r"^[a-z]{3,}(?:ians?|ites?|ish|ese|ovites?|landers?)$")

SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_]){3,}[^\W\d_](?![^\W_])")
SPLIT = re.compile(r"[.!?;:\n\r`\"“”«»|]+|\s:\)|(?<=\s)[-–—](?=\s)")
TOKEN = re.compile(r"[^\W_][\w*@$!'’+|#]*|\*+\w[\w*]*")
RUN3 = re.compile(r"(.)\1{2,}")
HIDDEN = re.compile(r"[\u00ad\u200b-\u200f\u2060\ufeff\u180e]")


@lru_cache(maxsize=200_000)
def clean_word(word: str) -> str:
    if "*" in word.strip("*"):
        word = word.strip("'’!|+#")
        return word if re.fullmatch(r"[a-z]*\*[a-z*]*", word) else word.replace("*", "")
    word = word.strip("*'’!|+#")
    letters = sum(c.isalpha() for c in word)
    if letters and not word.isalpha():
        digits = sum(c.isdigit() for c in word)
        if digits and (digits <= letters + 1) and not re.fullmatch(r"[a-z]+\d+", word) or re.search(r"[@$!|+]", word):
            word = word.translate(LEET)
        elif digits and re.fullmatch(r"[a-z]{1,}\d+", word) and digits > 2:
            word = "<id>"
    if word.isdigit():
        return "<n>"
    word = RUN3.sub(r"\1", word)
    return re.sub(r"[^a-z<>'*]", "", word.replace("’", "'"))


def fold(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKD", HIDDEN.sub("", unicodedata.normalize("NFKC", text))).casefold()
        text = "".join(c for c in text if not unicodedata.combining(c)).translate(LOOKALIKE)
    return SPACED.sub(lambda m: re.sub(r"[ .\-_]", "", m[0]), text.casefold())


def sentences(text: str | None) -> list[tuple[str, ...]]:
    """The sentences of a text as undisguised words; of some sixty words at most, longer ones in overlapping parts."""
    out: list[tuple[str, ...]] = []
    if not text:
        return out
    for part in SPLIT.split(fold(text)):
        words = tuple(w for w in map(clean_word, TOKEN.findall(part)) if w)
        if words:
            out += [words] if len(words) <= 60 else [words[k : k + 40] for k in range(0, len(words), 20)]
    return out


# --- features -------------------------------------------------------------------------------------------------------
@lru_cache(maxsize=200_000)
def word_columns(word: str) -> tuple[int, np.ndarray]:
    """(hash of a word, columns of its character n-grams)."""
    shaped = f"<{word}>"
    parts = {shaped[k : k + n] for n in CHARS for k in range(len(shaped) - n + 1)}
    return zlib.crc32(word.encode()), np.array(sorted({zlib.crc32(b"#" + p.encode()) % COLUMNS for p in parts}), dtype=np.int64)


class Encoded(NamedTuple):
    """Sentences as arrays: the tokens' sentence and word; per word its column, and the character columns of all words."""

    size: int
    sentence: np.ndarray
    word: np.ndarray
    own: np.ndarray
    char_word: np.ndarray
    char_column: np.ndarray
    pair_sentence: np.ndarray
    pair_column: np.ndarray
    scale: np.ndarray  # per sentence: long ones count less for each of their words
    char_scale: np.ndarray  # per word


def encode(items: list[tuple[str, ...]]) -> Encoded:
    known: dict[str, int] = {}
    word = np.array([known.setdefault(w, len(known)) for s in items for w in s], dtype=np.int64)
    lengths = np.array([len(s) for s in items], dtype=np.int64)
    sentence = np.repeat(np.arange(len(items)), lengths)
    columns = [word_columns(w) for w in known]
    hashes = np.array([h for h, _ in columns], dtype=np.uint64)
    counts = np.array([len(c) for _, c in columns], dtype=np.int64)
    h = hashes[word]
    two = sentence[:-1] == sentence[1:]
    three = sentence[:-2] == sentence[2:]
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))[two]
    triples = (h[:-2] * np.uint64(0xD6E8FEB86659FD93) + h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:] * np.uint64(0xA0761D6478BD642F))[three]
    mixed = np.concatenate([pairs, triples])
    return Encoded(
        len(items),
        sentence,
        word,
        (hashes % np.uint64(COLUMNS)).astype(np.int64),
        np.repeat(np.arange(len(known)), counts),
        np.concatenate([c for _, c in columns]) if columns else np.zeros(0, dtype=np.int64),
        np.concatenate([sentence[:-1][two], sentence[:-2][three]]),
        ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(COLUMNS)).astype(np.int64),
        1 / np.maximum(1.0, lengths**0.5 / 2),
        1 / np.maximum(1.0, counts) ** 0.5,
    )


def logits(x: Encoded, weights: np.ndarray, bias: float) -> np.ndarray:
    chars = np.bincount(x.char_word, weights[x.char_column], minlength=len(x.own)) * x.char_scale
    words = weights[x.own] + chars
    return bias + x.scale * (np.bincount(x.sentence, words[x.word], minlength=x.size) + np.bincount(x.pair_sentence, weights[x.pair_column], minlength=x.size))


def back(e: np.ndarray, x: Encoded, columns: int) -> np.ndarray:
    """The gradient of the weights from that of the logits."""
    e = e * x.scale
    words = np.bincount(x.word, e[x.sentence], minlength=len(x.own))
    out = np.bincount(x.own, words, minlength=columns)
    out += np.bincount(x.char_column, (words * x.char_scale)[x.char_word], minlength=columns)
    return out + np.bincount(x.pair_column, e[x.pair_sentence], minlength=columns)


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Weights by column; ``scores`` gives the probability of the worst sentence of each text."""

    def __init__(self, weights: np.ndarray, bias: float, lexicon: dict[str, float]):
        self.weights, self.bias, self.lexicon = weights, bias, lexicon
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for w in lexicon:
            self.by_length[len(w)].append(w)
        self.read: dict[str, str] = {}

    def unmask(self, words: tuple[str, ...]) -> tuple[str, ...]:
        """Masked words read as the heaviest known word each may be."""
        if not any("*" in w for w in words):
            return words
        return tuple(self.open(w) if "*" in w else w for w in words)

    def open(self, word: str) -> str:
        if word not in self.read:
            pattern = re.compile(re.escape(word).replace(r"\*", "[a-z]"))
            fits = [w for w in self.by_length[len(word)] if pattern.fullmatch(w)]
            self.read[word] = max(fits, key=lambda w: (self.lexicon[w], w), default=word.replace("*", "") or word)
        return self.read[word]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        found = [sentences(t) for t in texts]
        flat = [self.unmask(s) for own in found for s in own]
        out = np.zeros(len(texts))
        if flat and self.lexicon:
            owner = np.repeat(np.arange(len(texts)), [len(own) for own in found])
            np.maximum.at(out, owner, squash(logits(encode(flat), self.weights, self.bias)))
        return out


EMPTY = Model(np.zeros(1), -30.0, {})


# --- fitting --------------------------------------------------------------------------------------------------------
class Bag(NamedTuple):
    text: str
    bad: int  # votes
    ok: int


def error_rate(bags: list[Bag]) -> float:
    """Of one rater, from how often two disagree: twice the rate times its complement."""
    apart = sum(b.bad * b.ok for b in bags)
    pairs = sum((b.bad + b.ok) * (b.bad + b.ok - 1) // 2 for b in bags)
    disagree = (apart + 1) / (pairs + 20)
    return min(0.2, max(0.01, (1 - (1 - 2 * min(disagree, 0.48)) ** 0.5) / 2))


def identity_terms(items: list[tuple[str, ...]]) -> list[str]:
    """Known group words and demonyms of the sentences, and the words that stand in two frames or more as those do."""
    frames: dict[tuple, set[str]] = defaultdict(set)
    for s in set(items):
        for k, w in enumerate(s):
            frames[s[max(0, k - 2) : k], s[k + 1 : k + 3]].add(w)
    terms = {w for ws in frames.values() for w in ws if w in GROUPS or DEMONYM.match(w)}
    shared: dict[str, int] = defaultdict(int)
    for (left, right), ws in frames.items():
        if len(left) + len(right) >= 3 and len(ws & terms) >= 2:
            for w in ws - terms:
                shared[w] += 1
    return sorted(terms | {w for w, n in shared.items() if n >= 2 and len(w) > 3})


def fit(bags: list[Bag], penalty: float = PENALTIES[-1], seed: int = 0) -> Model:
    """The model of some labelled documents."""
    items: list[tuple[str, ...]] = []
    owner: list[int] = []
    for b, bag in enumerate(bags):
        for s in dict.fromkeys(sentences(bag.text)):
            items.append(s)
            owner.append(b)
    ratio = np.log((1 - error_rate(bags)) / error_rate(bags)) * np.array([b.bad - b.ok for b in bags])
    if not items or not (ratio > 0).any() or not (ratio < 0).any():
        return EMPTY
    bag_of = np.array(owner)
    size = np.bincount(bag_of, minlength=len(bags))
    target = (ratio[bag_of] > 0) / np.maximum(1, size[bag_of])
    model = EMPTY
    state: np.ndarray | None = None
    for round_ in range(ROUNDS):
        items = [model.unmask(s) for s in items] if round_ == 1 else items
        model, state, p = step(items, bag_of, target, state if round_ != 1 else None, penalty, seed)
        # votes and model together: how likely is the document bad, and which sentence made it so
        clean = np.exp(np.bincount(bag_of, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(bags)))
        likely = np.exp(np.clip(ratio, -20, 20))
        posterior = (1 - clean) * likely / ((1 - clean) * likely + clean)
        target = np.minimum(1.0, p / np.maximum(1e-12, 1 - clean)[bag_of] * posterior[bag_of])
    return model


def step(items: list[tuple[str, ...]], bag_of: np.ndarray, target: np.ndarray, start: np.ndarray | None, penalty: float, seed: int) -> tuple[Model, np.ndarray, np.ndarray]:
    """Weights for soft targets of the sentences: (model, state to go on from, probabilities)."""
    chance = np.random.default_rng(seed)
    terms = identity_terms(items)
    term_set = set(terms)
    swapped: list[tuple[str, ...]] = []  # what stands around a term, and the same with another term, in turn
    for s in items:
        for k, w in enumerate(s):
            if w in term_set and len(terms) > 1:
                for other in (*chance.choice(terms, size=2), "they"):
                    if other != w:
                        swapped += [s[max(0, k - 2) : k + 3], (*s[max(0, k - 2) : k], str(other), *s[k + 1 : k + 3])]
    n, x = len(items), encode([*items, *swapped])
    # columns of words and their sequences seen in one document only stay at zero: nothing can be learnt from them
    seen = np.concatenate([np.stack([x.own[x.word], x.sentence]), np.stack([x.pair_column, x.pair_sentence])], axis=1)
    seen = seen[:, seen[1] < n]
    held = np.unique(seen[0] * len(items) + bag_of[seen[1]])
    columns, documents = np.unique(held // len(items), return_counts=True)
    free = np.zeros(COLUMNS, dtype=bool)
    free[columns[documents >= 2]] = True
    used, char_at = np.unique(x.char_column, return_inverse=True)
    free[used] = True
    names = np.flatnonzero(free)
    at = np.full(COLUMNS, len(names), dtype=np.int64)  # the last but one place gathers what stays at zero
    at[names] = np.arange(len(names))
    x = x._replace(own=at[x.own], char_column=at[x.char_column], pair_column=at[x.pair_column])
    m = len(names) + 1

    def gradient(w: np.ndarray) -> np.ndarray:
        z = logits(x, w[:-1], w[-1])
        e = np.empty(x.size)
        e[:n] = squash(z[:n]) - target
        change = SWAP * (z[n::2] - z[n + 1 :: 2])
        e[n::2], e[n + 1 :: 2] = change, -change
        out = np.append(back(e, x, m), e[:n].sum())
        out[: m - 1] += penalty * w[: m - 1]
        out[m - 1] = 0.0
        return out

    # a bound of the curvature by column: the sum of its values times that of the sentence's values
    total = 1 + x.scale * (np.bincount(x.sentence, (1 + 1 / x.char_scale)[x.word], minlength=x.size) + np.bincount(x.pair_sentence, minlength=x.size))
    e = np.empty(x.size)
    e[:n] = total[:n] / 4
    e[n::2] = e[n + 1 :: 2] = SWAP * (total[n::2] + total[n + 1 :: 2])
    rate = 1 / (np.append(back(e, x, m), e[:n].sum()) + penalty)
    if start is None:
        w = np.zeros(m + 1)
        w[-1] = np.log(max(1e-4, target.mean()) / (1 - min(0.99, target.mean())))
    else:
        w = start
    ahead, old = w.copy(), w.copy()
    for k in range(EPOCHS):  # accelerated gradient descent, scaled by column
        new = ahead - rate * gradient(ahead)
        ahead = new + k / (k + 3) * (new - old)
        old = new
    weights = np.zeros(COLUMNS)
    weights[names] = old[: m - 1]
    words = sorted({w for s in items for w in s if "*" not in w})
    single = encode([(w,) for w in words])
    lexicon = dict(zip(words, (logits(single, weights, 0.0)).tolist())) if words else {}
    return Model(weights, float(old[-1]), {w: v for w, v in lexicon.items() if v > 0} or lexicon), old, squash(logits(x, old[:-1], old[-1])[:n])


# --- Spark ----------------------------------------------------------------------------------------------------------
def labelled(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_bytes: int = MOST_BYTES) -> list[Bag]:
    """The labelled documents with their votes; at most so many and so many bytes, by hash of the id."""
    name = F.lower(F.trim("label"))
    votes = labels.select("doc_id", "rater_id", name.alias("label")).where(name.isin("ok", *BAD)).distinct()
    judged = votes.groupBy("doc_id").agg(F.count_if(F.col("label") != "ok").alias("bad"), F.count_if(F.col("label") == "ok").alias("ok")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.where("text is not null").select("doc_id", "text").join(judged, "doc_id")
    running = F.sum(F.octet_length("text")).over(W.orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(W.unboundedPreceding, 0))  # of ``most`` documents
    return [Bag(row["text"], row["bad"], row["ok"]) for row in texts.withColumn("running", running).where(F.col("running") <= most_bytes).drop("running").orderBy("doc_id", "text").collect()]


def best_threshold(scored: np.ndarray, bags: list[Bag]) -> tuple[float, float]:
    """(the highest F1 on held-out documents, the middle of the thresholds that come within a hundredth of it).

    Only thresholds count at which no more than ``MOST_FALSE`` of the held-out ok documents are flagged; with few labels
    that decides. Raters err, so some of those are bad all the same.
    """
    bad, ok = np.array([b.bad > b.ok for b in bags]), np.array([b.bad < b.ok for b in bags])
    cuts = squash(np.arange(-5.0, 4.0, 0.1))
    hit = np.array([(scored[bad] >= t).sum() for t in cuts])
    wrong = np.array([(scored[ok] >= t).sum() for t in cuts])
    f1 = np.where((wrong <= MOST_FALSE * ok.sum()) | (cuts == cuts[-1]), 2 * hit / np.maximum(1, hit + wrong + bad.sum()), -1.0)
    near = cuts[f1 >= f1.max() - 0.01]
    return float(f1.max()), float(near[len(near) // 2 if f1.max() > 0 else 0])


def learnt(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[Model, float, dict[str, float]]:
    """(model, threshold, its measures on held-out documents). The fits are tasks; only scores and weights come back."""
    spark = documents.sparkSession
    bags = labelled(documents, labels, most)
    if not any(b.bad > b.ok for b in bags) or not any(b.bad < b.ok for b in bags):
        return EMPTY, 1.0, {}
    fold_of = np.random.default_rng(0).permutation(len(bags)) % FOLDS
    shared = spark.sparkContext.broadcast(bags)  # bounded by ``most`` and ``MOST_BYTES``
    schema = pa.schema([("task", pa.int64()), ("numbers", pa.list_(pa.float64())), ("columns", pa.list_(pa.int64())), ("words", pa.list_(pa.string())), ("values", pa.list_(pa.float64()))])

    def folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                own, fold = shared.value, task % FOLDS
                model = fit([b for b, at in zip(own, fold_of) if at != fold], PENALTIES[task // FOLDS])
                yield pa.RecordBatch.from_pylist([{"task": task, "numbers": model.scores([b.text for b, at in zip(own, fold_of) if at == fold]).tolist(), "columns": [], "words": [], "values": []}], schema=schema)

    form = "task bigint, numbers array<double>, columns array<bigint>, words array<string>, values array<double>"
    tasks = FOLDS * len(PENALTIES)
    held = {r["task"]: r["numbers"] for r in spark.range(0, tasks, 1, tasks).mapInArrow(folds, form).collect()}
    trials = []
    for p in range(len(PENALTIES)):
        scored = np.zeros(len(bags))
        for fold in range(FOLDS):
            scored[fold_of == fold] = held[p * FOLDS + fold]
        trials.append((*best_threshold(scored, bags), p, scored))
    _, threshold, best, scored = max(trials, key=lambda t: (t[0], t[2]))
    penalty = PENALTIES[best]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                model = fit(shared.value, penalty)
                used = np.flatnonzero(np.abs(model.weights) > 1e-6)
                yield pa.RecordBatch.from_pylist([{"task": task, "numbers": [model.bias, *model.weights[used].tolist()], "columns": used.tolist(), "words": list(model.lexicon), "values": list(model.lexicon.values())}], schema=schema)

    row = spark.range(0, 1, 1, 1).mapInArrow(whole, form).first()
    shared.unpersist()
    weights = np.zeros(COLUMNS)
    weights[np.array(row["columns"], dtype=np.int64)] = row["numbers"][1:]
    sure_bad, sure_ok = np.array([b.bad - b.ok >= 2 for b in bags]), np.array([b.ok - b.bad >= 2 for b in bags])
    measures = {"penalty": penalty, "threshold": threshold, "recall": float((scored[sure_bad] >= threshold).mean()) if sure_bad.any() else float("nan"), "false_rate": float((scored[sure_ok] >= threshold).mean()) if sure_ok.any() else float("nan")}
    return Model(weights, row["numbers"][0], dict(zip(row["words"], row["values"]))), threshold, measures


def scores(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, source, score, flagged: every document."""
    model, threshold, _ = learnt(documents, labels, most)
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.lexicon))  # ``COLUMNS`` numbers and the sample's words
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("score", pa.float64()), ("flagged", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            score = np.concatenate([own.scores(batch.column(2)[k : k + 500].to_pylist()) for k in range(0, batch.num_rows, 500)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, type=pa.float64()), pa.array(score >= threshold)], schema=schema)

    return documents.select(F.col("doc_id").cast("bigint"), F.col("source"), "text").mapInArrow(run, "doc_id bigint, source string, score double, flagged boolean")


def rates(scored: DataFrame) -> DataFrame:
    """source, documents, flagged, rate, mean_score."""
    name = F.regexp_replace(F.lower(F.trim("source")), r"[\s\-]+", "_")
    return scored.groupBy(name.alias("source")).agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
