"""Toxicity by weak supervision.

1. Lexicons: words and word beginnings that labelled toxic training texts use and clean ones hardly
   do (lower Wilson bound of the toxic share). They are split into several voters; pattern voters
   look at repeated hits, hit density, and texts without any hit. A voter says toxic, clean or
   nothing.
2. Label model: EM over the counts of vote patterns of all documents, without labels. Voters have
   class-conditional vote probabilities (their accuracies), and correlated voters are modelled in a
   tree: each voter also depends on the voter with which it shares most information given the class.
3. The posterior of each pattern is the label for a linear (logistic) classifier on hit features
   of all training documents, whose output is the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pulseline.llm.common import hashes_of, id_remainder, making_room, pieces, schema_text, shingle_hashes, stored, words_of

FOLDS, HELD = 3, 1
THRESHOLD = 0.7
#: Bound of the lexicon, which goes to every task.
ENTRIES = 4_000
BEGINNINGS = (4, 5)
#: An entry needs LEAST_TEXTS toxic texts at least; common ones are taken first, from a SPREAD-th
#: share of the texts on, and the floor falls by FALL until it is LEAST_TEXTS.
WILSON_Z, LEAST_SHARE, LEAST_TEXTS, SPREAD, FALL = 2.0, 0.5, 4, 0.02, 4
#: Voters on lexicon parts: (kind, part, parts); kind 0 is whole words, then word beginnings.
PARTS = ((0, 0, 3), (0, 1, 3), (0, 2, 3), (4, 0, 2), (4, 1, 2), (5, 0, 2), (5, 1, 2))
VOTERS = len(PARTS) + 3
FEATURES = len(PARTS) + 4
PIECE = 4 << 20


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, tuple[int, ...]]  # feature -> the parts it belongs to
    weights: tuple[float, ...]  # bias first
    accuracies: tuple[float, ...]  # share of right votes per voter, by the label model


def plain(words: pa.Array) -> list[str]:
    """Lower case, without punctuation at both ends."""
    return pc.utf8_trim(pc.utf8_lower(words), "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~").to_pylist()


def features_of(word: str) -> list[str]:
    return [f"0{word}", *(f"{n}{word[:n]}" for n in BEGINNINGS if len(word) >= n)] if word else []


def document_features(texts: pa.Array) -> Iterator[set[str]]:
    codes, starts, words = words_of(texts)
    own = [features_of(w) for w in plain(words)]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        yield set().union(*(own[c] for c in np.unique(codes[a:b])))


def feature_counts(texts: DataFrame, told: frozenset[str] = frozenset()) -> DataFrame:
    """feature, docs: in how many texts each feature occurs; texts with a feature that is already
    `told` do not count. The feature "" counts the texts themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                found: dict[str, int] = {"": 0}
                for own in document_features(part["text"]):
                    if own.isdisjoint(told):
                        found[""] += 1
                        for f in own:
                            found[f] = found.get(f, 0) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["feature", "docs"]
                )

    return texts.select("text").mapInArrow(run, "feature string, docs long").groupBy("feature").agg(F.sum("docs").alias("docs"))


def one_of_copies(texts: DataFrame) -> DataFrame:
    """One text of those that share the least hash of their five-word shingles: copies and near
    copies would otherwise make each of their words look telling."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                codes, starts, words = words_of(part["text"])
                own = hashes_of(words)[codes] if len(codes) else np.zeros(0, np.uint64)
                grams, first = shingle_hashes(own, starts, 5)
                least = [int(grams[a:b].min()) & (2**63 - 1) if b > a else -1 for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part["text"], pa.array(least, pa.int64())], names=["text", "least"])

    marked = texts.select("text").mapInArrow(run, "text string, least long")
    return marked.groupBy("least").agg(F.min("text").alias("text"))


def wilson(share: Column, n: Column) -> Column:
    z2 = WILSON_Z**2
    centre = share + z2 / (2 * n)
    return (centre - WILSON_Z * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def learn_lexicon(labelled: DataFrame) -> dict[str, tuple[int, ...]]:
    """Features whose presence makes a training text toxic; at most ENTRIES of them.

    Each round looks at the toxic texts that no entry explains yet, so words beside an insult gain
    nothing from it. Features that occur in many of them come first; the floor falls whenever a
    round adds no entry, and the search ends when none is added at LEAST_TEXTS texts.
    """
    toxic = stored(one_of_copies(labelled.filter("toxic = 1")), "toxicity-texts")
    # counts of later rounds never exceed those of the first, so its features are all candidates
    first = stored(feature_counts(toxic).filter(F.col("docs") >= LEAST_TEXTS), "toxicity-features")
    texts = (first.filter("feature = ''").first() or {"docs": 0})["docs"]
    # both sides grow with the vocabulary, so neither is broadcast
    against = stored(
        first.filter("feature != ''").select("feature")
        .join(feature_counts(labelled.filter("toxic = 0")).withColumnRenamed("docs", "clean").hint("merge"), "feature", "left")
        .select("feature", F.coalesce("clean", F.lit(0)).alias("clean")), "toxicity-against",
    )
    out: dict[str, tuple[int, ...]] = {}
    rank = dict.fromkeys((0, *BEGINNINGS), 0)
    floor, counts = max(LEAST_TEXTS, int(SPREAD * texts)), first
    while len(out) < ENTRIES:
        both = F.col("docs") + F.col("clean")
        # features that fewer toxic than clean texts hold are below LEAST_SHARE at any size
        chosen = (
            counts.filter(F.col("docs") >= floor).join(against.hint("merge"), "feature")
            .filter("docs > clean").select("feature", wilson(F.col("docs") / both, both).alias("bound"))
            .filter(F.col("bound") >= LEAST_SHARE - 1e-9).orderBy(F.desc("bound"), "feature").limit(ENTRIES - len(out)).collect()
        )
        for row in chosen:
            kind = int(row["feature"][0])
            out[row["feature"]] = tuple(k for k, (own, part, parts) in enumerate(PARTS) if own == kind and rank[kind] % parts == part)
            rank[kind] += 1
        if chosen:
            counts = stored(feature_counts(toxic, frozenset(out)).filter(F.col("docs") >= LEAST_TEXTS), "toxicity-features")
        elif floor > LEAST_TEXTS:
            floor = max(LEAST_TEXTS, floor // FALL)
        else:
            break
    return out


def hits(texts: pa.Array, lexicon: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hits per text and lexicon part, different words hit per text, words per text."""
    codes, starts, words = words_of(texts)
    n = np.diff(starts)
    owner = np.repeat(np.arange(len(n)), n)
    table = np.zeros((len(words), len(PARTS)), bool)
    for i, word in enumerate(plain(words)):
        for f in features_of(word):
            for part in lexicon.get(f, ()):
                table[i, part] = True
    hit_words = np.nonzero(table.any(axis=1))[0]
    known = np.full(len(words), -1)
    known[hit_words] = np.arange(len(hit_words))
    at = np.nonzero(known[codes] >= 0)[0] if len(codes) else np.zeros(0, np.int64)
    counts = np.zeros((len(n), len(PARTS)))
    np.add.at(counts, owner[at], table[codes[at]].astype(float))
    pairs = np.unique(owner[at] * (len(words) + 1) + codes[at])
    different = np.bincount(pairs // (len(words) + 1), minlength=len(n)) if len(pairs) else np.zeros(len(n))
    every = np.bincount(owner[at], minlength=len(n)) if len(at) else np.zeros(len(n))
    return counts, np.stack([different, every], axis=1), n


def votes_and_features(texts: pa.Array, lexicon: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Votes (0 nothing, 1 toxic, 2 clean) and features of each text."""
    counts, summary, n = hits(texts, lexicon)
    different, every = summary.T
    votes = np.zeros((len(n), VOTERS), np.int64)
    votes[:, :len(PARTS)] = counts > 0
    votes[:, -3] = np.where(different >= 2, 1, 0)
    votes[:, -2] = np.where(every * 50 >= n + 10, 1, np.where(every * 400 < n, 2, 0))
    votes[:, -1] = np.where(every == 0, 2, 0)
    dense = every / (n + 20.0)
    features = np.column_stack([np.log1p(counts), np.log1p(different), np.log1p(every), 10 * dense, every > 0])
    return votes, features.astype(float)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of toxic for each vote pattern, and each voter's share of right votes.

    The first run takes voters as independent given the class; its posteriors give the shared
    information of all pairs of voters, whose greatest spanning tree holds the correlations that
    the second run estimates together with the accuracies.
    """
    toxic, clean = (patterns == 1).sum(axis=1), (patterns == 2).sum(axis=1)
    posterior = np.where(toxic > clean, 0.9, np.where(clean > toxic, 0.02, 0.1))
    parent = [-1] * patterns.shape[1]
    for tree in (False, True):
        if tree:
            parent = spanning_tree(patterns, counts, posterior)
        for _ in range(rounds):
            weight = np.stack([counts * (1 - posterior), counts * posterior])
            prior = weight.sum(axis=1) + 1
            score = np.log(prior / prior.sum())[:, None].repeat(len(patterns), axis=1)
            for j, p in enumerate(parent):
                above = patterns[:, p] if p >= 0 else np.zeros(len(patterns), np.int64)
                for y in (0, 1):
                    table = np.full((3, 3), 0.5)
                    np.add.at(table, (above, patterns[:, j]), weight[y])
                    score[y] += np.log(table / table.sum(axis=1, keepdims=True))[above, patterns[:, j]]
            new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
            if np.abs(new - posterior).max() < 1e-6:
                break
            posterior = new
    right = np.where(patterns == 1, posterior[:, None], 1 - posterior[:, None]) * (patterns > 0) * counts[:, None]
    return posterior, right.sum(axis=0) / np.maximum(((patterns > 0) * counts[:, None]).sum(axis=0), 1)


def spanning_tree(patterns: np.ndarray, counts: np.ndarray, posterior: np.ndarray) -> list[int]:
    """Each voter's parent (-1: none) in the tree of greatest information given the class."""
    m = patterns.shape[1]
    shared = np.zeros((m, m))
    for w in (counts * posterior, counts * (1 - posterior)):
        for a in range(m):
            for b in range(a):
                joint = np.full((3, 3), 1e-3)
                np.add.at(joint, (patterns[:, a], patterns[:, b]), w)
                p = joint / joint.sum()
                own = p * np.log(p / (p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True)))
                shared[a, b] = shared[b, a] = shared[a, b] + own.sum() * w.sum()
    parent, inside = [-1] * m, [0]
    while len(inside) < m:
        gain, a, b = max((shared[a, b], a, b) for a in inside for b in range(m) if b not in inside)
        parent[b] = a if gain > 0 else -1
        inside.append(b)
    return parent


def newton_sums(x: np.ndarray, y: np.ndarray, share: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the weighted logistic loss, in steps of 2**-48. Whole numbers add up
    to the same sums in any order, so the fit does not depend on how rows are dealt to tasks."""
    x = np.column_stack([np.ones(len(x)), x])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    slope = x * (share * (y - p))[:, None]
    bend = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1) * (share * (p * (1 - p) + 1e-6))[:, None]
    return np.rint(np.hstack([slope, bend]) * 2.0**48).astype(np.int64).sum(axis=0)


def fit_linear(rows: DataFrame, total: int, codes: np.ndarray, posterior: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Logistic regression on probabilities over all rows (code, features, n), by Newton's method;
    bias first. Each step is one pass over the rows; a task sends its sums only. The ridge shrinks
    with the root of the number of texts, up to 20,000 of them."""
    size = FEATURES + 1
    ridge /= min(total, 20_000) ** 0.5
    w = np.zeros(size)
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast((codes, posterior, w))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            codes, posterior, w = shared.value
            sums = np.zeros(size + size * size, np.int64)
            for batch in batches:
                x = batch["features"].flatten().to_numpy().reshape(-1, FEATURES)
                y = posterior[np.searchsorted(codes, batch["code"].to_numpy())]
                sums += newton_sums(x, y, batch["n"].to_numpy() / total, w)
            yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.int64()))], names=["sums"])

        sums = sum((np.array(r["sums"], object) for r in rows.mapInArrow(run, "sums array<long>").collect()), np.zeros(size + size * size, object))
        sums = np.array(sums / 2**48, float)
        step = np.linalg.solve(sums[size:].reshape(size, size) + ridge * np.eye(size), sums[:size] - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from documents and the labels of training folds (crc32 of the key, modulo FOLDS, is
    not HELD). Labels choose lexicon entries only; vote patterns come from all documents with words,
    and the classifier from all of those in the training folds.

    Rows without words teach nothing, null labels and labels of a null key neither. Without toxic training texts the
    lexicon is empty, and every score is 0.
    """
    open_ = id_remainder(F.col(key), FOLDS) != HELD
    told = labels.filter(open_ & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("toxic"))
    labelled = stored(
        # labels grow with the corpus, so they are never broadcast, on small inputs either
        docs.filter(open_).select(key, F.col(text).alias("text")).join(told.hint("merge"), key).select("text", "toxic"), "toxicity-labelled"
    )
    lexicon = learn_lexicon(labelled)
    if not lexicon:
        return Model({}, (-30.0, *[0.0] * FEATURES), (0.0,) * VOTERS)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                part = part.filter(pa.array(np.diff(words_of(part["text"])[1]) > 0))
                votes, features = votes_and_features(part["text"], shared.value)
                code = votes @ (3 ** np.arange(VOTERS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code), pa.array(features.tolist(), pa.list_(pa.float64())), part["open"]], names=["code", "features", "open"],
                )

    # texts without hits and copies share a row, so what is stored and fitted is small
    seen = stored(
        docs.select(F.col(text).alias("text"), open_.alias("open")).mapInArrow(run, "code long, features array<double>, open boolean")
        .groupBy("code", "features", "open").agg(F.count("*").alias("n")), "toxicity-votes",
    )
    counted = seen.groupBy("code").agg(F.sum("n").alias("n")).collect()  # at most 3 ** VOTERS patterns
    codes = np.array(sorted(r["code"] for r in counted), np.int64)
    counts = np.array([n for _, n in sorted((r["code"], r["n"]) for r in counted)], float)
    posterior, right = fit_labels(codes[:, None] // 3 ** np.arange(VOTERS) % 3, counts)
    rows = seen.filter("open").select("code", "features", "n")
    total = rows.agg(F.sum("n")).first()[0]
    return Model(lexicon, tuple(fit_linear(rows, total, codes, posterior).tolist()), tuple(right.tolist()))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """Add `into`, 0 to 1, from the text alone (null counts as empty). All rows and other columns
    pass; a column that was already called `into` is replaced."""
    docs = making_room(docs, into)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"{schema_text(docs)}, `{into}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array(shared.value.weights)
        for batch in batches:
            for part in pieces(batch, text, PIECE):
                _, features = votes_and_features(part[text], shared.value.lexicon)
                own = 1 / (1 + np.exp(-np.clip(weights[0] + features @ weights[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own)], names=[*part.schema.names, into])

    return docs.mapInArrow(run, schema)
