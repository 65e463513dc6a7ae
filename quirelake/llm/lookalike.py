"""One form for text that looks the same.

A weighted edit automaton walks tries of the corpus vocabulary with every doubtful token as
it stands: a step over a look-alike letter, a wide form, a ligature or a decomposed accent
costs nothing, and so does staying put on an ignorable character; every other edit costs
one. The words it reaches within its budget are the token's possible canonical spellings:
they decide the script of its letters, and the cheapest of them in that script, the one with
the fewest letters turned and then the most frequent, is written in the token's case. Tokens
that reach no word are normalised by table, in the script of their own unambiguous letters
or else of the words beside them.

The tries hold the whole vocabulary and are sharded by the first letters of the words with
look-alikes merged, which no free step changes, so tokens and vocabulary meet in one
shuffle, and no vocabulary is broadcast. A trie is the sorted list of its words, a node a
range of it.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.runtime import cut, widen

# Letters that cannot be told apart, in the scripts Cyrillic and Greek, each
# with its Latin twin.
CYRILLIC = "а е о р с у х і ј ѕ ԁ һ ԛ ԝ ӏ ѵ А В Е К М Н О Р С Т У Х І Ј Ѕ Ԛ Ԝ Ѵ".split()
CYRILLIC_TWIN = "a e o p c y x i j s d h q w l v A B E K M H O P C T Y X I J S Q W V".split()
GREEK = "ο ν ρ ι α υ χ γ Α Β Ε Ζ Η Ι Κ Μ Ν Ο Ρ Τ Υ Χ".split()
GREEK_TWIN = "o v p i a u x y A B E Z H I K M N O P T Y X".split()
#: Letters of the Cyrillic alphabets in use here that Latin letters may stand for.
LIVING = set("аеорсухіАВЕКМНОРСТУХІ")
#: One-letter words of Greek that are read as themselves, not as the Latin letter.
LONE_GREEK = set("νριαυχγ")

TO_LATIN = {**dict(zip(CYRILLIC, CYRILLIC_TWIN)), **dict(zip(GREEK, GREEK_TWIN))}
TO_CYRILLIC = {b: a for a, b in zip(CYRILLIC, CYRILLIC_TWIN) if a in LIVING}
TO_CYRILLIC |= {a: TO_CYRILLIC[b] for a, b in zip(GREEK, GREEK_TWIN) if b in TO_CYRILLIC}
TO_GREEK = {b: a for a, b in zip(GREEK, GREEK_TWIN)}
TO_GREEK |= {a: TO_GREEK[b] for a, b in zip(CYRILLIC, CYRILLIC_TWIN) if b in TO_GREEK}
INTO = {"L": TO_LATIN, "C": TO_CYRILLIC, "G": TO_GREEK}

_UNSEEN = r"­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ"
_SPACES = r"   -   　"
_WIDE = r"！-ﾟ￠-￦"
_JOINED = r"ﬀ-ﬆĲĳǄ-ǌǱ-ǳ"
#: Characters that make a value suspect by themselves (for the JVM).
ODD = rf"[{_UNSEEN}{_SPACES}{_WIDE}{_JOINED}KΩÅ]|\p{{Mn}}|[\x{{1D400}}-\x{{1D7FF}}]"


def suspect(column):
    """Whether a value may have another form: odd characters, or letters of two scripts."""
    latin, cyrillic, greek = (column.rlike(rf"\p{{Is{s}}}") for s in ("Latin", "Cyrillic", "Greek"))
    plain_only = F.octet_length(column) == F.length(column)
    others = column.rlike(r"[\x{370}-\x{52F}]")
    return ~plain_only & (column.rlike(ODD) | (others & ((latin & (cyrillic | greek)) | (cyrillic & greek))))


_unseen, _space = regex.compile(f"[{_UNSEEN}]"), regex.compile(f"[{_SPACES}]")
_joined, _wide = regex.compile(f"[{_JOINED}]"), regex.compile(f"[{_WIDE}\\U0001D400-\\U0001D7FF]")


def script_of(ch: str) -> str | None:
    """'L', 'C', 'G' for letters of the three scripts, 'O' for other letters, else None."""
    if ch < "\u0250":
        return "L" if ch.isalpha() else None
    if "\u0370" <= ch < "\u0400":
        return "G" if ch.isalpha() else None
    if "\u0400" <= ch < "\u0530":
        return "C" if ch.isalpha() else None
    if not ch.isalpha():
        return None
    return "L" if "\u1E00" <= ch < "\u1F00" else "O"


def pieces(text: str) -> list[tuple[int, str]]:
    """``(offset, characters)``: visible clusters, singly written, of plain width and decomposed."""
    out: list[tuple[int, str]] = []
    for i, ch in enumerate(text):
        if ch < "\x80":
            out.append((i, ch))
        elif _unseen.match(ch):
            continue
        elif _space.match(ch):
            out.append((i, " "))
        elif unicodedata.combining(ch) and out and out[-1][1][0].isalpha():
            out[-1] = (out[-1][0], out[-1][1] + ch)
        elif _joined.match(ch) or _wide.match(ch):
            out += [(i, c) for c in unicodedata.normalize("NFKC", ch)]
        else:
            out.append((i, unicodedata.normalize("NFD", ch) if ch.isalpha() else ch))
    return out


def scripts(word: list[str]) -> set[str]:
    """Scripts in which the whole word can be written with the same look."""
    can = set()
    for s in "LCG":
        if all(script_of(c[0]) == s or c[0] in INTO[s] for c in word):
            can.add(s)
    return can


def rewrite(word: list[str], script: str) -> list[str]:
    into = INTO[script]
    return [
        unicodedata.normalize("NFC", (c[0] if script_of(c[0]) == script else into.get(c[0], c[0])) + c[1:]) for c in word
    ]


def _merged() -> dict[int, str]:
    """Lower-case letters with all that may stand for them, in either case, made one."""
    first: dict[str, str] = {}

    def root(x: str) -> str:
        while first.get(x, x) != x:
            x = first[x]
        return x

    for a, b in TO_LATIN.items():
        first[root(a.lower())] = root(b.lower())
    return {ord(x): root(x) for x in first}


_MERGED = _merged()
KEY = 5  # letters of the key that tokens and words are sharded by


def shard_key(letters: str) -> str:
    """The first letters without accents, look-alikes merged; no free step of the automaton changes it."""
    return "".join(c for c in unicodedata.normalize("NFD", letters) if not unicodedata.combining(c))[:KEY].lower().translate(_MERGED)


def looks(ch: str) -> set[str]:
    """The lower-case letters that ``ch``, in its own case, may stand for at no cost."""
    return {ch.lower()} | {into[ch].lower() for into in INTO.values() if ch in into}


class Trie:
    """Vocabulary words by their decomposed letters, with counts, as a sorted list: a node is a
    range of words that begin alike."""

    def __init__(self):
        self.counts: dict[str, int] = {}
        self.words: list[str] = []

    def add(self, word: str, count: int) -> None:
        word = unicodedata.normalize("NFD", word)
        self.counts[word] = self.counts.get(word, 0) + count

    def _step(self, node: tuple[int, int, int], edge: str) -> tuple[int, int, int] | None:
        lo, hi, depth = node
        at = lambda w: w[depth : depth + 1]
        lo = bisect_left(self.words, edge, lo, hi, key=at)
        hi = bisect_right(self.words, edge, lo, hi, key=at)
        return (lo, hi, depth + 1) if lo < hi else None

    def _below(self, node: tuple[int, int, int]):
        lo, hi, depth = node
        if lo < hi and len(self.words[lo]) == depth:
            lo += 1
        while lo < hi:
            edge = self.words[lo][depth]
            following = self._step((lo, hi, depth), edge)
            yield edge, following
            lo = following[1]

    def reach(self, token: str, budget: int = 0) -> list[tuple[str, int, int]]:
        """``(word, count, cost)`` of the words within ``budget`` edits of the raw token.

        Look-alike steps and ignorable characters are free, a substitution, insertion or
        deletion of anything else costs one.
        """
        if len(self.words) != len(self.counts):
            self.words = sorted(self.counts)
        states = {(0, len(self.words), 0): 0}

        def close(found):
            queue = list(found) if budget else []
            while queue:
                node = queue.pop()
                if found[node] < budget:
                    for _, following in self._below(node):
                        if found[node] + 1 < found.get(following, budget + 1):
                            found[following] = found[node] + 1
                            queue.append(following)
            return found

        states = close(states)
        for ch in visible(token):
            free, moved = looks(ch), {}
            for node, cost in states.items():
                if cost < budget:
                    moved[node] = min(moved.get(node, budget + 1), cost + 1)
                    edges = [(f, cost + (e not in free)) for e, f in self._below(node)]
                else:
                    edges = [(f, cost) for e in free if (f := self._step(node, e))]
                for following, total in edges:
                    if total < moved.get(following, budget + 1):
                        moved[following] = total
            states = close(moved)
            if not states:
                return []
        ended = ((self.words[lo], cost) for (lo, _, depth), cost in states.items() if len(self.words[lo]) == depth)
        return [(unicodedata.normalize("NFC", w), self.counts[w], cost) for w, cost in ended]


def visible(token: str) -> str:
    """The token's characters that are seen, decomposed and of plain width."""
    return "".join(c for _, c in pieces(token))


def spelled(clusters: list[str], word: str) -> list[str] | None:
    """``word`` cluster by cluster in the case of the token's; None if they don't pair up."""
    own = [c for _, c in pieces(word)]
    if len(own) != len(clusters) or any(len(a) != len(b) for a, b in zip(own, clusters)):
        return None
    out = []
    for c, w in zip(clusters, own):
        first = c[0] if c[0].lower() == w[0] else w[0].upper() if c[0] != c[0].lower() else w[0]
        out.append(unicodedata.normalize("NFC", first + w[1:]))
    return out


_RUN = regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}{_UNSEEN}]*")


@lru_cache(200_000)
def _token(raw: str):
    """Of a run of letters: offsets and clusters, own scripts, possible scripts, the sure one, whether the vocabulary is asked."""
    found = pieces(raw)
    word = [c for _, c in found]
    own = {script_of(c[0]) for c in word}
    can = scripts(word)
    sure = None
    if len(can) == 1:
        sure = next(iter(can))
    elif not can and own != {"O"}:
        share: dict[str, int] = defaultdict(int)
        for c in word:
            share[script_of(c[0]) or "O"] += 1
        sure = max(share, key=lambda x: share[x])
    odd = "".join(unicodedata.normalize("NFC", c) for c in word) != raw
    asked = odd or len(own) > 1 or len(can) > 1 and (own != {"L"} or "C" in can)
    return [i for i, _ in found], word, own, can, sure, asked


def asked_tokens(text: str | None) -> list[str]:
    """The raw tokens whose spelling the vocabulary is asked about."""
    return sorted({raw for raw in _RUN.findall(text or "") if _token(raw)[5]})


def plain_pieces(text: str, spellings: dict[str, list[tuple[str, int, int]]]):
    """``(offset, characters, pieces)`` of the parts of a text; pieces are ``(offset, plain
    characters)`` from the part's start, or None for a part that stays as it is.

    ``spellings``: the words that raw tokens reach, as ``(word, count, cost)``.
    """
    runs = [(m.start(), m.end()) for m in _RUN.finditer(text)]
    token = [_token(text[a:b]) for a, b in runs]
    firm = [t[4] for t in token]

    def beside(k: int, step: int) -> str | None:
        j = k + step
        while 0 <= j < len(token):
            if firm[j] and firm[j] != "O" and not (firm[j] == "G" and len(token[j][1]) == 1):
                return firm[j]
            j += step
        return None

    def touches(k: int, script: str) -> bool:
        """Whether the next word of the line, on either side, is one of the script."""
        return any(
            0 <= j < len(runs) and firm[j] == script and visible(text[x:y]) == " "
            for j, x, y in ((k - 1, runs[k - 1][1], runs[k][0]), (k + 1, runs[k][1], runs[k + 1][0] if k + 1 < len(runs) else 0))
        )

    def form(k: int) -> list[str]:
        _, word, own, can, script, asked = token[k]
        as_is = [unicodedata.normalize("NFC", c) for c in word]
        reached = spellings.get(text[runs[k][0] : runs[k][1]], [])
        if "O" in own:
            return as_is
        if own == {"L"} and "C" not in can:
            script = "L"
        elif script is None:
            known: dict[str, int] = defaultdict(int)
            for w, n, _ in reached:
                if (s := script_of(w[0])) in can:
                    known[s] += n
            left, right = beside(k, -1), beside(k, 1)
            around = {s for s in (left, right) if s}
            now = next(iter(own)) if len(own) == 1 else None
            if now:
                # a word in one script is another script's only where that script is all around
                # it and has the word
                script = now
                if len(around) == 1 and now not in around:
                    other = next(iter(around))
                    lone = len(word) == 1 and word[0][0] in LONE_GREEK
                    if other in can and not lone and (known.get(other, 0) if len(word) > 1 else touches(k, other)):
                        script = other
            else:
                best = [s for s in known if s in around] or list(known)
                script = max(best, key=lambda s: known[s]) if best else (left or right or "L")
                if script not in can:
                    script = next(iter(sorted(can, reverse=True)), "L")
        # the cheapest spelling in that script: fewest edits, then fewest letters turned
        offers = []
        for w, n, cost in reached:
            if script_of(w[0]) == script and (out := spelled(word, w)):
                offers.append((cost, sum(a != b for a, b in zip(out, as_is)), -n, out))
        if offers:
            return min(offers)[3]
        # no word is reached: by table; letters of a word that no single script can write
        # follow the majority
        return rewrite(word, script)

    last = 0
    for k, (a, b) in enumerate([*runs, (len(text), len(text))]):
        gap = text[last:a]
        if gap:
            yield last, gap, None if gap.isascii() else pieces(gap)
        last = b
        if a < b:
            plainly = not token[k][5] and (token[k][2] == {"L"} or "O" in token[k][2] or len(token[k][3]) == 1)
            yield a, text[a:b], None if plainly else list(zip(token[k][0], form(k)))


def plain(text: str, start: int = 0, stop: int | None = None, spellings: dict | None = None) -> str:
    """The one form of ``text[start:stop]``, read in the context of the whole text."""
    stop = len(text) if stop is None else stop
    out = []
    for at, raw, made in plain_pieces(text, spellings or {}):
        if made is None:
            out.append(raw[max(0, start - at) : max(0, stop - at)])
        else:
            out += [c for i, c in made if start <= at + i < stop]
    return "".join(out)


def vocabulary(corpus: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)``: words of one script, in lower case, over all rows."""
    words = corpus.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{Mn}]+")).alias("word"))
    pure = F.col("word").rlike(r"^(\p{IsLatin}+|\p{IsCyrillic}+|\p{IsGreek}+)$") & ~F.col("word").rlike(f"[{_WIDE}{_JOINED}]")
    return words.where(F.col("word") != "").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(pure)


def _keys_column(column):
    @F.pandas_udf("string")
    def f(words: pd.Series) -> pd.Series:
        return words.map(shard_key)

    return f(column)


def _asked_column(column):
    @F.pandas_udf("array<struct<token:string,key:string>>")
    def f(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"token": raw, "key": shard_key(visible(raw))} for raw in asked_tokens(t)])

    return f(column)


def _match_shard(key, asked, known):
    trie = Trie()
    for w, n in zip(known["word"], known["n"]) if len(asked) else ():
        trie.add(w, int(n))
    rows = [(t, w, n, cost) for t in asked["token"] for w, n, cost in trie.reach(t)]
    return pd.DataFrame(rows, columns=["token", "word", "n", "cost"])


def canonical_values(values: DataFrame, corpus: DataFrame, shards: int | None = None) -> DataFrame:
    """``(field, row_key, plain)``: the values whose one form differs from them.

    ``values`` has ``(field, row_key, whole, skip, size)``: the value is the slice of
    ``whole`` from ``skip`` of ``size`` characters, the rest is its context. ``corpus``
    has the column ``text`` the vocabulary is taken from. Null and empty values have no
    form of their own and give no row; equal rows give one. Case, padding, line breaks,
    typographic quotes, dashes, superscripts and words of another script stay.
    """
    odd = widen(values).where(suspect(F.col("whole"))).dropDuplicates(["field", "row_key"])
    if shards is None:  # as many tries as the session's shuffles are sized for
        shards = max(32, 4 * int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # read and asked about once: three branches start here, and suspects are few
    asked = cut(odd.withColumn("asked", _asked_column("whole")))
    tokens = asked.select(F.explode("asked").alias("t")).select("t.token", "t.key").distinct()
    known = vocabulary(corpus).withColumn("key", _keys_column("word"))
    shard = lambda df: df.groupBy(F.pmod(F.xxhash64("key"), F.lit(shards)))
    met = shard(tokens).cogroup(shard(known)).applyInPandas(_match_shard, "token string, word string, n long, cost int")
    reached = met.groupBy("token").agg(F.collect_list(F.struct("word", "n", "cost")).alias("words"))
    keys = ["field", "row_key"]
    asked_of = asked.select(*keys, F.explode("asked.token").alias("token")).join(reached, "token")
    answers = asked_of.groupBy(*keys).agg(F.collect_list(F.struct("token", "words")).alias("answers"))
    joined = asked.join(answers, keys, "left")

    def settle(batches):
        for pdf in batches:
            rows = []
            for field, key, whole, skip, size, got in zip(*(pdf[c] for c in ("field", "row_key", "whole", "skip", "size", "answers"))):
                words = {a["token"]: [(w["word"], w["n"], w["cost"]) for w in a["words"]] for a in got} if got is not None else {}
                value = whole[skip : skip + size]
                form = plain(whole, skip, skip + size, words)
                if form != value:
                    rows.append((field, key, form))
            yield pd.DataFrame(rows, columns=["field", "row_key", "plain"])

    return joined.select(*keys, "whole", "skip", "size", "answers").mapInPandas(settle, "field string, row_key string, plain string")
