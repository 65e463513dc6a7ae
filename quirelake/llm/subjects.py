"""Subject areas of documents by class-association rules.

Every sentence or entry of a labelled document is a transaction of its words and the
document's subject. Rules of one word come from the words' counts by subject. Longer ones
are mined by parallel frequent-pattern growth: transactions, equal ones once with a weight,
are cut to the prefix that each shard of the words needs, and each shard grows patterns on
its own prefix tree. Growth stops at ``LONGEST`` words and wherever a longer pattern can only
be redundant: below a pattern whose entries are all of one subject, and at a word that every
entry of the pattern holds (its rules are those of the pattern). So a sentence given many
times is no more work than one given once, however long it is.

A rule is redundant when a part of its words implies the subject as surely. Confidences are
calibrated by shrinking them towards the subjects' base rate with the strength that predicts
held-out labels best, and an entry goes to the subject with the largest evidence: the log
odds of its surest matching rule and a small part of all others', as many weak rules (the
common words of a language whose documents are mostly about one subject) must not outvote a
sure one. A document's subjects are those of at least ``share`` of its entries that have one.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from itertools import combinations
from math import log

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.lookalike import _unseen
from quirelake.llm.textual import BROKEN, QUOTED, words
from quirelake.runtime import cut, widen

#: Labelled documents the rules are mined from, at most; beyond it a hash of doc_id chooses.
LABELLED = 200_000
LEAST_COUNT = 3  # entries an itemset must occur in
LEAST_SUPPORT = 2e-5  # and the share of all entries: at most 50 000 rules for each word of a mean entry
LEAST_CONFIDENCE = 0.65
LONGEST = 3  # words a rule may have
NEWS = 0.02  # a longer rule must be so much surer than its parts
STRENGTHS = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)  # of the shrinkage, in entries
HELD = 5  # every so-many-th labelled document is held out to choose among them
ECHO = 0.1
FIRM = 0.5  # evidence from which an entry has a subject by itself

_ITEM = regex.compile(r"(?m)^[ \t]*(?:[-*•–]|\d+[.)])[ \t]+")
_BLANK = regex.compile(r"\n[ \t]*\n+")
_STOP = regex.compile(r"(?<=[.!?…])[\"”»)\]]*\s+")


def entries(text: str | None) -> list[list[str]]:
    """Distinct words of each sentence, or of each line of a list."""
    if not text or not text.strip():
        return []
    flat = QUOTED.sub(" ", BROKEN.sub("", _unseen.sub("", text)))
    parts = []
    for paragraph in _BLANK.split(flat):
        if _ITEM.search(paragraph):
            parts += paragraph.split("\n")
        else:
            parts += _STOP.split(paragraph.replace("\n", " "))
    out = []
    for part in parts:
        some = sorted({w for w in words(part) if len(w) > 1})
        if some:
            out.append(some)
    return out


def _entry_rows(batches):
    for pdf in batches:
        rows = [(d, k, s, e) for d, s, t in zip(pdf["doc_id"], pdf["subject"], pdf["text"]) for k, e in enumerate(entries(t))]
        yield pd.DataFrame(rows, columns=["doc_id", "k", "subject", "words"])


class PatternTree:
    """Transactions by their common prefixes, with counts by class at every node."""

    def __init__(self, classes: int):
        self.classes = classes
        self.item: list[str] = [""]
        self.above: list[int] = [-1]
        self.count = [np.zeros(classes)]
        self.below: list[dict[str, int]] = [{}]
        self.nodes: dict[str, list[int]] = defaultdict(list)

    def add(self, items, counts: np.ndarray) -> None:
        at = 0
        for item in items:
            following = self.below[at].get(item)
            if following is None:
                following = self.below[at][item] = len(self.item)
                self.item.append(item)
                self.above.append(at)
                self.count.append(np.zeros(self.classes))
                self.below.append({})
                self.nodes[item].append(following)
            self.count[following] += counts
            at = following

    def base(self, item: str) -> list[tuple[list[str], np.ndarray]]:
        """The conditional pattern base: what stands before ``item``, with counts."""
        out = []
        for node in self.nodes[item]:
            path, at = [], self.above[node]
            while at > 0:
                path.append(self.item[at])
                at = self.above[at]
            if path:
                out.append((path[::-1], self.count[node]))
        return out


def grow(tree: PatternTree, items, least: float, longest: int = LONGEST):
    """Yields ``(words, counts by class)`` of the patterns of 2 to ``longest`` words ending in ``items``.

    Patterns that can only give redundant rules are neither yielded nor grown.
    """
    todo = [((item,), tree, item) for item in items]
    while todo:
        pattern, own, item = todo.pop()
        whole = sum((own.count[n] for n in own.nodes[item]), np.zeros(own.classes))
        if whole.max() == whole.sum() or len(pattern) == longest:
            continue
        base = own.base(item)
        counts: dict[str, np.ndarray] = {}
        for path, n in base:
            for other in path:
                counts[other] = counts[other] + n if other in counts else n
        # frequent, and not in every entry of the pattern
        good = {o: n for o, n in counts.items() if n.max() >= least and n.sum() < whole.sum()}
        for other, n in good.items():
            yield (*pattern, other), n
        if good and len(pattern) + 1 < longest:
            smaller = PatternTree(own.classes)
            for path, n in base:
                kept = [o for o in path if o in good]
                if kept:
                    smaller.add(kept, n)
            todo += [((*pattern, o), smaller, o) for o in good]


def _grow_shard(classes: list[str], least: float, shards: int):
    place = {c: i for i, c in enumerate(classes)}

    def run(key, pdf):
        tree = PatternTree(len(classes))
        for items, subject, n in zip(pdf["items"], pdf["subject"], pdf["n"]):
            one = np.zeros(len(classes))
            one[place[subject]] = n
            tree.add(items, one)
        own = [item for item in tree.nodes if _shard(item, shards) == int(key[0])]
        rows = [(sorted(w), int(n.sum()), [int(x) for x in n]) for w, n in grow(tree, own, least)]
        return pd.DataFrame(rows, columns=["words", "of", "by_class"])

    return run


def _shard(word: str, shards: int) -> int:
    return xxhash.xxh32_intdigest(word) % shards


def _prefixes(shards: int):
    def run(batches):
        for pdf in batches:
            rows = []
            for items, subject, n in zip(pdf["items"], pdf["subject"], pdf["n"]):
                last: dict[int, int] = {}
                for i, item in enumerate(items):
                    last[_shard(item, shards)] = i
                rows += [(s, items[: i + 1], subject, n) for s, i in last.items() if i]
            yield pd.DataFrame(rows, columns=["shard", "items", "subject", "n"])

    return run


def mine(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[list[tuple[tuple[str, ...], str, float]], str | None]:
    """Rules ``(words, subject, log odds)`` from the documents with exactly one subject, and
    the subject of most entries (of equals the first by name)."""
    spark = documents.sparkSession
    one = (
        labels.where(F.col("doc_id").isNotNull() & F.col("subject").isNotNull())
        .groupBy("doc_id")
        .agg(F.collect_set("subject").alias("s"))
        .where(F.size("s") == 1)
        .select("doc_id", F.col("s")[0].alias("subject"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(labelled)
    )
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(one, "doc_id")
    rows = cut(texts.mapInPandas(_entry_rows, "doc_id long, k int, subject string, words array<string>"))
    sizes = {r["subject"]: r["n"] for r in rows.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return [], None
    classes = sorted(sizes)
    base = {c: n / total for c, n in sizes.items()}
    usual = max(classes, key=lambda c: sizes[c])
    least = max(LEAST_COUNT, LEAST_SUPPORT * total)
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(HELD)) == 0
    worded = rows.select("subject", held.alias("held"), F.explode("words").alias("word"))
    by_class = worded.groupBy("word", "subject").agg(F.count(F.lit(1)).alias("n"), F.count_if("held").alias("h"))
    counts = by_class.groupBy("word").agg(
        F.sum("n").alias("of"), F.sum("h").alias("of_held"), F.max("n").alias("most"), F.collect_list(F.struct("subject", "n", "h")).alias("by")
    )
    # the words that say anything about a subject: as many as the least support allows
    telling = cut(counts.where((F.col("most") >= least) & (F.col("most") >= 0.5 * F.col("of"))))
    strength = _strength(telling, base)

    # only words of several subjects can be part of a rule that is surer than its words
    mixed = telling.where("most < of").select("word", "of")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    baskets = (
        rows.select("doc_id", "k", "subject", F.explode("words").alias("word"))
        .join(mixed, "word")
        .groupBy("doc_id", "k", "subject")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("of")).alias("o"), "word"))), lambda x: x["word"]).alias("items"))
        .where(F.size("items") > 1)
        .groupBy("items", "subject")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    patterns = (
        baskets.mapInPandas(_prefixes(shards), "shard int, items array<string>, subject string, n long")
        .groupBy("shard")
        .applyInPandas(_grow_shard(classes, least, shards), "words array<string>, of long, by_class array<long>")
    )
    found: dict[tuple[tuple[str, ...], str], float] = {}

    def note(some: tuple[str, ...], subject: str, n: int, of: int) -> None:
        if n >= least and n >= LEAST_CONFIDENCE * of:
            found[some, subject] = (n + strength * base[subject]) / (of + strength)

    for r in telling.toLocalIterator():
        for x in r["by"]:
            note((r["word"],), x["subject"], x["n"], r["of"])
    for r in patterns.toLocalIterator():
        for c, n in zip(classes, r["by_class"]):
            note(tuple(r["words"]), c, n, r["of"])
    rules = []
    for (some, subject), sure in found.items():
        prior = base[subject]
        parts = (p for n in range(1, len(some)) for p in combinations(some, n))
        if any(found.get((p, subject), 0) >= sure - NEWS for p in parts):
            continue
        if sure > prior:
            rules.append((some, subject, log(sure / (1 - min(sure, 0.999))) - log(prior / (1 - min(prior, 0.999)))))
    return rules, usual


def _strength(telling: DataFrame, base: dict[str, float]) -> float:
    """The shrinkage under which the words' confidences, from the documents that are not held
    out, give the held-out labels the greatest likelihood."""
    spark = telling.sparkSession
    priors = spark.createDataFrame(list(base.items()), "subject string, prior double")
    x = telling.select("of", "of_held", F.explode("by").alias("x")).select("of", "of_held", "x.*").join(F.broadcast(priors), "subject")
    x = x.where((F.col("of_held") > 0) & (F.col("of") > F.col("of_held")))

    def gain(m: float):
        p = (F.col("n") - F.col("h") + m * F.col("prior")) / (F.col("of") - F.col("of_held") + m)
        p = F.greatest(F.lit(1e-6), F.least(p, F.lit(1 - 1e-6)))
        return F.sum(F.col("h") * F.log(p) + (F.col("of_held") - F.col("h")) * F.log(1 - p))

    row = x.agg(*[gain(m).alias(f"g{i}") for i, m in enumerate(STRENGTHS)]).collect()[0]
    gains = [row[i] for i in range(len(STRENGTHS))]
    return 2.0 if gains[0] is None else STRENGTHS[max(range(len(gains)), key=lambda i: gains[i])]


class Scorer:
    def __init__(self, rules, usual: str | None):
        self.subjects = sorted({s for _, s, _ in rules} | ({usual} if usual is not None else set()))
        self.usual = usual
        place = {s: i for i, s in enumerate(self.subjects)}
        self.single: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.longer: dict[str, list[tuple[frozenset, int, float]]] = defaultdict(list)
        for some, s, weight in rules:
            if len(some) == 1:
                self.single[some[0]].append((place[s], weight))
            else:
                self.longer[some[0]].append((frozenset(some), place[s], weight))

    def entry(self, some: list[str]) -> np.ndarray:
        total, most = np.zeros(len(self.subjects)), np.zeros(len(self.subjects))
        held = None
        for w in some:
            for s, weight in self.single.get(w, ()):
                total[s] += weight
                most[s] = max(most[s], weight)
            for needed, s, weight in self.longer.get(w, ()):
                held = held or set(some)
                if needed <= held:
                    total[s] += weight
                    most[s] = max(most[s], weight)
        return most + ECHO * total

    def document(self, text: str | None, share: float) -> list[tuple[str, float]]:
        """``(subject, share of the entries that have one)``."""
        if not self.subjects or not text or not text.strip():
            return []
        n, weak = np.zeros(len(self.subjects)), np.zeros(len(self.subjects))
        for some in entries(text):
            score = self.entry(some)
            if score.max() > FIRM:
                n[int(score.argmax())] += 1
            else:
                weak += score
        if not n.sum():
            # no entry has a subject by itself: the text's evidence as a whole, else the usual one
            at = int(weak.argmax()) if weak.max() > 0 else self.subjects.index(self.usual)
            return [(self.subjects[at], 1.0)]
        parts = n / n.sum()
        top = [int(i) for i in np.argsort(-parts, kind="stable")[:2] if parts[i] >= share]
        return [(self.subjects[i], float(parts[i])) for i in top or [int(parts.argmax())]]


_SCORERS: dict[str, Scorer] = {}


def subjects(documents: DataFrame, labels: DataFrame, share: float = 0.25) -> DataFrame:
    """``(doc_id, subject, part)``: subjects of at least ``share`` of a document's entries.

    Null and blank texts give no row, every other text gives one or two (ties by the subject's
    name). Where no entry has a subject by itself, the evidence of all entries together
    decides, and where there is none, the subject most entries have (part 1.0). Labels of unknown documents, null labels and
    repeated labels do not matter; without labels there are no rows. Documents whose labels
    name two subjects are classified but not learned from.
    """
    spark = documents.sparkSession
    # bounded by LEAST_SUPPORT, whatever the labels and the documents
    shared = spark.sparkContext.broadcast(mine(documents, labels))
    tag = uuid.uuid4().hex

    def run(batches):
        scorer = _SCORERS.get(tag)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[tag] = Scorer(*shared.value)
        for pdf in batches:
            rows = [(d, s, p) for d, t in zip(pdf["doc_id"], pdf["text"]) for s, p in scorer.document(t, share)]
            yield pd.DataFrame(rows, columns=["doc_id", "subject", "part"])

    return widen(documents.select("doc_id", "text")).mapInPandas(run, "doc_id long, subject string, part double")
