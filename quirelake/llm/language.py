"""Language of pages and of their stretches by fusing evidence.

One pass over the texts cuts them into sentences and turns every word into three numbers:
the buckets, in a table of fixed size, of the word and of its first and last letters. All
later passes are arithmetic on these numbers.

Text likelihoods are the buckets' counts over the whole corpus: first under the declared
languages, wrong ones included, together with a few common words of each language, so that
one nobody declares can still be found; then again under the languages that the first model
gives to each sentence. A page's prior fuses the declared language (through the measured
odds of declaring ``d`` for text in ``l``), the suffix of the address, and the languages of
the host: file counts without the page's own are smoothed towards the folder's, the folder's
towards the suffix's, the suffix's towards the corpus. All counts are grouped aggregations.

Within a page the language is a chain of states that changes rarely, and then to a language
by its prior; the most probable chain of the sentences gives the stretches, the forward and
backward probabilities their confidence. A short sentence thus counts as much as it says.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.scans import body
from quirelake.llm.textual import sentences, words
from quirelake.runtime import cut, widen

BUCKETS = 1 << 16
EDGE = 0.3  # weight of a word's first and last letters against the whole word
SMOOTH = 0.05
PULL = 4.0  # strength, in sentences, of the next higher level of the host's hierarchy
SWITCH = 0.01  # probability that a sentence's language is chosen anew
SEED = 3  # times that each common word counts before any text is read
# Common words of the languages that can be expected.
COMMON = {
    "eng": "the of and to in is that it was for on with as are this be at from which not",
    "deu": "der die und das ist nicht ein eine den von zu mit sich des auf für im dem auch wird",
    "fra": "le la les des et est une dans que pour qui du pas sur au avec ce il sont plus",
    "spa": "el la los las de que y en un una es por con para del se no su al lo",
    "por": "o a os as de que e em um uma é não do da para com no na se por",
    "ita": "il la di che e è un una in per non del della con sono le gli si nel alla",
    "nld": "de het een van en is dat in op te niet zijn met voor die er aan ook naar wordt",
    "rus": "и в не на что он с как это по но из у за от так же все она был",
    "ukr": "і в не на що він з як це та до за від але є які був вона або його",
    "tur": "ve bir bu için ile de da çok daha olarak olan gibi sonra kadar en değil her ama ne var",
}


def _buckets(word: str) -> tuple[int, int, int]:
    return tuple(xxhash.xxh32_intdigest(x) % BUCKETS for x in (word, "^" + word[:3], word[-3:] + "$"))


class Shared:
    """A broadcast value with an identity that workers can remember models by."""

    def __init__(self, spark, value):
        self.box = spark.sparkContext.broadcast(value)
        self.id = uuid.uuid4().hex

    @property
    def value(self):
        return self.box.value


class Likelihood:
    """Log likelihoods of words under each language, from bucket counts (BUCKETS, languages)."""

    def __init__(self, counts: np.ndarray):
        share = counts.sum(axis=0, keepdims=True) + 1.0
        logs = np.log((counts + SMOOTH) / (share + SMOOTH * BUCKETS))
        logs -= logs.mean(axis=1, keepdims=True)
        logs[counts.sum(axis=1) == 0] = 0.0
        # a language without any counts can't be told by text
        self.unknown = counts.sum(axis=0) == 0
        self.logs = logs.astype(np.float32)

    def score(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores (sentences, languages) of sentences given by their words' buckets (words, 3)."""
        if not len(lengths):
            return np.zeros((0, self.logs.shape[1]))
        out = np.empty((len(lengths), self.logs.shape[1]))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        for a in range(0, len(lengths), 4096):
            b = min(a + 4096, len(lengths))
            some = features[starts[a] : ends[b - 1]]
            each = self.logs[some[:, 0]] + np.float32(EDGE) * (self.logs[some[:, 1]] + self.logs[some[:, 2]])
            out[a:b] = np.add.reduceat(each, starts[a:b] - starts[a], axis=0)
        out[:, self.unknown] = -1e9
        return out


_MODELS: dict[str, Likelihood] = {}


def _model(shared) -> Likelihood:
    if shared.id not in _MODELS:
        _MODELS.clear()
        _MODELS[shared.id] = Likelihood(shared.value["counts"])
    return _MODELS[shared.id]


def _cut_rows(batches):
    """Pages' sentences as packed buckets, three a word, and packed lengths in words."""
    known: dict[str, bytes] = {}
    for pdf in batches:
        packed, sizes = [], []
        for text in pdf["text"]:
            features, lengths = [], []
            for s in sentences(body(text)):
                some = words(s)
                lengths.append(len(some))
                for w in some:
                    three = known.get(w)
                    if three is None:
                        three = np.array(_buckets(w), np.uint16).tobytes()
                        if len(known) < 400_000:
                            known[w] = three
                    features.append(three)
            packed.append(zlib.compress(b"".join(features), 1))
            sizes.append(np.array(lengths, np.uint32).tobytes())
        yield pdf[["page_id", "lang", "file", "folder", "suffix"]].assign(features=packed, lengths=sizes)


def _unpack(pdf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (words, 3) and lengths of all the sentences of a batch, and each page's number of them."""
    features = [np.frombuffer(zlib.decompress(x), np.uint16) for x in pdf["features"]]
    lengths = [np.frombuffer(x, np.uint32) for x in pdf["lengths"]]
    n = np.array([len(x) for x in lengths], np.int64)
    if not len(features):
        return np.zeros((0, 3), np.uint16), np.zeros(0, np.int64), n
    return np.concatenate(features).reshape(-1, 3), np.concatenate(lengths).astype(np.int64), n


def _slices(pdf, most: int = 2000):
    """A batch in parts whose arrays stay small."""
    for a in range(0, len(pdf), most):
        yield pdf.iloc[a : a + most]


def _count_features(codes: list[str], shared):
    """Bucket counts of the batches, by declared language or by each sentence's best one."""
    place = {c: i for i, c in enumerate(codes)}
    k = len(codes)

    def run(batches):
        counts = np.zeros(BUCKETS * k, np.int64)
        for pdf in batches:
            for part in _slices(pdf):
                if shared is None:
                    part = part[part["lang"].isin(codes)]
                features, lengths, n = _unpack(part)
                if not len(lengths):
                    continue
                if shared is None:
                    at = np.repeat([place[x] for x in part["lang"]], n)
                else:
                    at = _model(shared).score(features, lengths).argmax(axis=1)
                keys = features.astype(np.int64) * k + np.repeat(at, lengths)[:, None]
                counts += np.bincount(keys.ravel(), minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"b": (used // k).astype(np.int32), "k": (used % k).astype(np.int32), "n": counts[used]})

    return run


def _learn(pages: DataFrame, codes: list[str], shared=None) -> np.ndarray:
    part = pages.select("lang", "features", "lengths").mapInPandas(_count_features(codes, shared), "b int, k int, n long")
    counts = np.zeros((BUCKETS, len(codes)))
    # at most BUCKETS rows for each language, whatever the corpus
    rows = part.groupBy("b", "k").agg(F.sum("n").alias("n")).toPandas()
    counts[rows["b"], rows["k"]] = rows["n"]
    if shared is None:
        for i, code in enumerate(codes):
            for word in COMMON.get(code, "").split():
                for b in _buckets(word):
                    counts[b, i] += SEED
    return counts


def _tally(codes: list[str], shared):
    """The pages' sentences of each language by text alone."""

    def run(batches):
        model = _model(shared)
        for pdf in batches:
            for part in _slices(pdf):
                features, lengths, n = _unpack(part)
                yield part[["lang", "file", "folder", "suffix"]].assign(n=_page_counts(model.score(features, lengths), n, len(codes)).tolist())

    return run


def _page_counts(score: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    page = np.repeat(np.arange(len(n)), n)
    best = score.argmax(axis=1) if len(score) else np.zeros(0, np.int64)
    return np.bincount(page * k + best, minlength=len(n) * k).reshape(len(n), k)


def chain(score: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most probable languages of a page's sentences, and the posterior of each.

    ``score`` are log likelihoods (sentences, languages), ``prior`` log probabilities.
    """
    m, k = score.shape
    prior = prior - np.logaddexp.reduce(prior)
    move = np.broadcast_to(np.log(SWITCH) + prior, (k, k)).copy()
    move[np.diag_indices(k)] = np.logaddexp(np.log1p(-SWITCH), move[np.diag_indices(k)])
    best, source = prior + score[0], np.zeros((m, k), np.int64)
    ahead = np.empty((m, k))
    ahead[0] = best
    for i in range(1, m):
        through = best[:, None] + move
        source[i] = through.argmax(axis=0)
        best = through.max(axis=0) + score[i]
        ahead[i] = np.logaddexp.reduce(ahead[i - 1][:, None] + move, axis=0) + score[i]
    path = np.empty(m, np.int64)
    path[-1] = best.argmax()
    for i in range(m - 1, 0, -1):
        path[i - 1] = source[i, path[i]]
    back, sure = np.zeros(k), np.empty(m)
    for i in range(m - 1, -1, -1):
        both = ahead[i] + back
        sure[i] = np.exp(both[path[i]] - np.logaddexp.reduce(both))
        back = np.logaddexp.reduce(move + score[i] + back, axis=1)
    return path, sure


def label_segments(pages: DataFrame, codes: list[str]) -> DataFrame:
    """``(page_id, declared, segment, lang, confidence, sentences)``: stretches in one language.

    ``pages`` has ``page_id, pdf_path, text, lang``; ``codes`` are the possible languages.
    Neighbouring sentences of one language form a segment; the confidence is the mean
    posterior of its sentences. Null, empty and sentence-less texts give no segment; every
    page with a whole sentence gives at least one, however unsure. A declared language that
    is no code counts as none. Repeated pages are judged alike.
    """
    spark = pages.sparkSession
    size = len(codes)
    path = F.coalesce(F.col("pdf_path"), F.lit(""))
    base = widen(
        pages.where(F.col("text").isNotNull() & (F.col("text") != "")).select(
            "page_id",
            "text",
            "lang",
            path.alias("file"),
            F.regexp_replace(path, r"/[^/]*$", "").alias("folder"),
            F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).alias("suffix"),
        )
    )
    # the only pass over the texts
    ready = cut(base.mapInPandas(_cut_rows, "page_id long, lang string, file string, folder string, suffix string, features binary, lengths binary"))
    first = Shared(spark, {"counts": _learn(ready, codes)})
    second = Shared(spark, {"counts": _learn(ready, codes, first)})
    # judged once: the tallies serve three levels of the hierarchy and the odds
    tallied = cut(
        ready.drop("page_id").mapInPandas(_tally(codes, second), "lang string, file string, folder string, suffix string, n array<long>")
        .groupBy("lang", "file", "folder", "suffix")
        .agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(size)])
    )
    total = [F.sum(f"n{i}").alias(f"n{i}") for i in range(size)]
    by_file = tallied.groupBy("file", "folder", "suffix").agg(*total)
    by_folder = by_file.groupBy("folder").agg(*total)
    by_suffix = by_file.groupBy("suffix").agg(*total)
    row = by_suffix.agg(*total).collect()[0]
    corpus = np.array([(row[i] or 0) + 1.0 for i in range(size)])
    corpus /= corpus.sum()

    def smoothed(frame: DataFrame, prior, name: str, keys: list[str]) -> DataFrame:
        whole = sum((F.col(f"n{i}") for i in range(size)), F.lit(0))
        return frame.select(
            *keys, *[((F.col(f"n{i}") + F.lit(PULL) * prior(i)) / (whole + F.lit(PULL))).alias(f"{name}{i}") for i in range(size)]
        )

    suffix_prior = smoothed(by_suffix, lambda i: F.lit(float(corpus[i])), "s", ["suffix"])
    folders = by_file.select("folder", "suffix").distinct().join(suffix_prior, "suffix").join(by_folder, "folder")
    folder_prior = smoothed(folders, lambda i: F.col(f"s{i}"), "d", ["folder", "suffix"])
    hosts = by_file.join(folder_prior, ["folder", "suffix"]).select(
        "file", F.array(*[F.col(f"n{i}").cast("double") for i in range(size)]).alias("own"), F.array(*[f"d{i}" for i in range(size)]).alias("above")
    )
    # odds of each declaration for text of each language: a table of (codes + 1) x codes
    declared = F.when(F.col("lang").isin(codes), F.col("lang")).otherwise(F.lit(""))
    odds = np.full((size + 1, size), 1.0)
    place = {c: i for i, c in enumerate(codes)}
    for r in tallied.groupBy(declared.alias("d")).agg(*total).collect():
        odds[place.get(r["d"], size)] += [r[f"n{i}"] or 0 for i in range(size)]
    odds = np.log(odds / odds.sum(axis=0, keepdims=True))

    def settle(batches):
        model = _model(second)
        for pdf in batches:
            for part in _slices(pdf):
                features, lengths, n = _unpack(part)
                score = model.score(features, lengths)
                # the file without the page itself, pulled towards its folder
                rest = np.array(part["own"].tolist(), float).reshape(-1, size) - _page_counts(score, n, size)
                above = np.array(part["above"].tolist(), float).reshape(-1, size)
                prior = np.log((np.maximum(rest, 0) + PULL * above) / (np.maximum(rest, 0).sum(axis=1, keepdims=True) + PULL))
                prior += odds[[place.get(x, size) for x in part["lang"]]] if len(part) else 0
                fused = score + np.repeat(prior, n, axis=0)
                best = fused.argmax(axis=1) if len(fused) else np.zeros(0, np.int64)
                alone = np.exp(-np.logaddexp.reduce(fused - fused.max(axis=1, keepdims=True), axis=1)) if len(fused) else np.zeros(0)
                ends = np.cumsum(n)
                out = []
                for page, lang, a, b, p in zip(part["page_id"], part["lang"], ends - n, ends, prior):
                    if a == b:
                        continue
                    if (best[a:b] == best[a]).all():
                        out.append((page, lang, 0, codes[best[a]], float(alone[a:b].mean()), b - a))
                        continue
                    path, sure = chain(score[a:b], p)
                    starts = [0, *(np.flatnonzero(np.diff(path)) + 1), b - a]
                    out += [(page, lang, k, codes[path[x]], float(sure[x:y].mean()), y - x) for k, (x, y) in enumerate(zip(starts, starts[1:]))]
                yield pd.DataFrame(out, columns=["page_id", "declared", "segment", "lang", "confidence", "sentences"])

    judged = ready.drop("folder", "suffix").join(hosts, "file").drop("file")
    return judged.mapInPandas(settle, "page_id long, declared string, segment int, lang string, confidence double, sentences int")


def doubtful_pages(segments: DataFrame) -> DataFrame:
    """``(page_id, lang)``: languages of the pages that are not simply in the declared one."""
    per_page = segments.groupBy("page_id").agg(F.first("declared").alias("declared"), F.collect_set("lang").alias("langs"))
    plain = F.col("declared").isNotNull() & (F.size("langs") == 1) & (F.col("langs")[0] == F.col("declared"))
    return per_page.where(~F.coalesce(plain, F.lit(False))).select("page_id", F.explode("langs").alias("lang"))
