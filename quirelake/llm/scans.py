"""Repair of text from scanned pages by a noisy channel.

A page's lines are first told apart: furniture (headers, footers, page numbers, stamps) by
its shape, by not belonging to the sentences around it, and by recurring in its file with
other numbers. What is left is running text. A word broken over a line end has passed the
channel too: it was written in one or with a hyphen, and both readings, with all that either
may be a misreading of, are states of the lattice.

A word is suspect when the corpus hardly has it outside of scans. Its candidates are the
corpus words it could have been: the usual confusions of characters are undone, up to two
in a word, and what is left after a filter of the vocabulary is joined with it. Long words,
for which that would be too many forms, meet the long words of the vocabulary in a third of
their letters, as two confusions leave one third alone, and are then compared. Words known mostly from
scans are candidates too, with a likelihood that falls with their share outside of scans. The probability of each
confusion is estimated from the corpus: first decisions with equal probabilities are
counted by confusion. For each line the most probable sequence is then decoded by Viterbi
over its lattice of candidates, channel probability times smoothed bigram likelihood, with
bigrams counted over all pages. Of a line only the suspects and the words beside them enter
the lattice: all other words are certain, and their factors are the same for every sequence.

Vocabulary, candidates, bigrams and lattices are tables that are joined. Tokens are never
shuffled as such: words and bigrams (as 64-bit hashes) are counted before the shuffle, and
lines are searched for suspects with a bit filter of fixed size. Broadcast are only such
filters and the words of at least ``HEAVY`` of all tokens.
"""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.runtime import cut, widen

# What scanners read -> what it was.
CONFUSIONS = {
    "c": "e é è ê", "e": "c", "1": "i l í ı", "f": "t", "o": "a á à ã â ä", "0": "o ó ô ö õ о", "ri": "n", "cl": "d",
    "5": "s ş", "rn": "m", "ii": "u ü ú ù", "6": "b б", "b": "h", "9": "g ğ", "m": "in rn", "vv": "w", "h": "li",
    "l": "i", "i": "l", "nn": "rm", "3": "з", "8": "b", "ni": "m", "u": "ii", "a": "o", "t": "f", "n": "ri", "d": "cl",
}
START_P = 2e-4  # each confusion before any is counted
EDITS = 2
LONG = 24  # longer words are compared by thirds
OFTENER = 3  # a candidate known outside of scans must be seen so many times, and so many times as often as the suspect
FILTER = 1 << 25  # bits of the filters of words, 4 MB
HEAVY = 1e-4  # share of all tokens from which a word's count is broadcast: at most 10 000 words
WORDY = 8  # a line of more words is furniture only where it recurs in its file
REAL = 0.004  # how many occurrences a never-seen word counts as
KNOWN = 0.05  # share of occurrences outside of scans from which a word is no suspect and counts in full
UNSEEN = 0.05  # what a word never seen outside of scans counts of that
RARER = 20  # so many times as frequent, a word known mostly from scans is a candidate
PAIR = 0.5  # share of the bigram in the likelihood of a word after another

TOKEN = regex.compile(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*(?:[-'’][\p{L}\p{N}][\p{L}\p{M}\p{N}]*)*")
_BREAK = regex.compile(r"(?<=[\p{L}\p{N}])[-¬=­]\s*$")
_ENDS = regex.compile(r"[.!?:;…][\"”»)\]]*\s*$|[\"”»]\s*$")
_NUMBER = regex.compile(r"^[\[(|\-–—\s]*(?=.*[\dlivxLIVXoO])[\dlIOoiSvxcVXC5]{1,7}[\])|\-–—\s]*$")
_PAGE_OF = regex.compile(r"^\p{Lu}[\p{L}\d]{1,8}\.? +[\dlIOoiSvxcLXVC]{1,7} +[\p{L}\d]{1,4} +[\dlIOoiS]{1,6}$")
_STAMP = regex.compile(r"^\p{Lu}[\p{L}\d]*(?: +\p{Lu}[\p{L}\d]*)? +[\dlIOoSi]{1,6}(?: *[|/] *\S{1,6})?$")
_LEADS = regex.compile(r"^[\dlIOoivxSC]{1,6} {2,}\p{Lu}|\p{L} {3,}[\dlIOoivxSC]{1,6}$")
#: Characters nobody sees inside a word (at a line's end a soft hyphen is a break).
_INSIDE = regex.compile(r"(?<=[\p{L}\p{M}\d])[\u00AD\u200B-\u200F\u2060-\u2064\uFEFF]+(?=[\p{L}\p{M}\d])")
_DIGITS = regex.compile(r"[\dlIOo]+")


def line_key(line: str) -> str:
    """A furniture line without what changes from page to page."""
    return regex.sub(r"\s+", " ", _DIGITS.sub("#", line)).strip().casefold()


def may_recur(line: str) -> bool:
    s = line.strip()
    return bool(s) and not _ENDS.search(s) and not _BREAK.search(s)


def furniture(lines: list[str], recurring: set[int]) -> list[bool]:
    """Which lines of a page are not running text; ``recurring``: lines seen on other pages."""
    filled = [i for i, s in enumerate(lines) if s.strip()]
    width = max((len(lines[i].rstrip()) for i in filled), default=0)
    out = [False] * len(lines)
    for at, i in enumerate(filled):
        s = lines[i].strip()
        if _ENDS.search(s) and not _NUMBER.match(s):
            continue
        if _NUMBER.match(s) or _PAGE_OF.match(s) or _STAMP.match(s):
            out[i] = True
            continue
        if _BREAK.search(s) or len(s.split()) > WORDY and i not in recurring:
            continue
        if _LEADS.search(s):
            out[i] = True
            continue
        before = next((lines[j] for j in reversed(filled[:at]) if not out[j]), None)
        after = lines[filled[at + 1]].strip() if at + 1 < len(filled) else None
        starts = after is None or not after[0].islower()
        ended = before is None or bool(_ENDS.search(before.strip()))
        title = s.upper() == s or all(w[0].isupper() or not w[0].isalpha() or len(w) <= 4 for w in s.split())
        short = len(s) <= 0.8 * width or len(filled) == 1 or lines[i].startswith("     ")
        narrow = len(s) <= 0.65 * width
        if short and (ended and starts and (title or narrow or i in recurring) or title and s.upper() == s and len(s) > 3):
            out[i] = True
        elif i in recurring and short and title and (ended or starts):
            out[i] = True
    return out


def body(text: str) -> str:
    """A page's text without furniture; a sentence that ran on across it is whole again."""
    lines = text.split("\n")
    drop = furniture(lines, set())
    if not any(drop):
        return text
    out: list[str] = []
    gap = False
    for s, d in zip(lines, drop):
        if d:
            gap = True
        elif s.strip() or not gap:
            if gap and out and s.strip():
                while out and not out[-1].strip():
                    out.pop()
                if out and _ENDS.search(out[-1]):
                    out.append("")
            gap = gap and not s.strip()
            out.append(s)
    return "\n".join(out)


def running_lines(lines: list[str], drop: list[bool]) -> tuple[list[list[str]], list[str]]:
    """Lower-case tokens of the running lines, and the joined words broken over line ends.

    A broken word stands at the end of its first line, with both parts put together around
    a break mark (\u0001) for the vocabulary to say whether the hyphen stays.
    """
    keep = [s for s, d in zip(lines, drop) if not d and s.strip()]
    out, carry = [], None
    for at, line in enumerate(keep):
        s = _INSIDE.sub("", line.strip())
        tokens = TOKEN.findall(s)
        if carry is not None and tokens:
            out[-1].append(carry + "\u0001" + tokens[0].lower())
            tokens = tokens[1:]
            carry = None
        m = _BREAK.search(s)
        following = keep[at + 1].strip() if at + 1 < len(keep) else ""
        if m and tokens and following[:1].islower():
            carry = tokens[-1].lower()
            tokens = tokens[:-1]
        out.append([t.lower() for t in tokens])
    return out, keep


def sources(word: str, known=lambda w: True) -> list[tuple[str, str]]:
    """``(candidate, confusions)`` of up to two undone confusions, as far as they are ``known``;
    confusions as 'wrong>right' joined by '|'."""
    found = {word: ""}
    layer = {word: ""}
    for _ in range(EDITS):
        following: dict[str, str] = {}
        for w, how in layer.items():
            for i in range(len(w)):
                for size in (1, 2):
                    wrong = w[i : i + size]
                    if len(wrong) < size or wrong not in _UNDONE:
                        continue
                    for right in _UNDONE[wrong]:
                        c = w[:i] + right + w[i + size :]
                        if c not in found and c not in following:
                            following[c] = f"{how}|{wrong}>{right}" if how else f"{wrong}>{right}"
        found.update(following)
        layer = following
    found.pop(word)
    return [(c, how) for c, how in found.items() if known(c) and _lettered(c)]


def _lettered(word: str) -> bool:
    return word.replace("-", "").replace("’", "").replace("'", "").isalpha()


_UNDONE = {wrong: right.split() for wrong, right in CONFUSIONS.items()}


def explain(word: str, right: str, edits: int = EDITS) -> str | None:
    """The confusions that make ``word`` of ``right``, written as in ``sources``; None beyond ``edits``."""
    if word == right:
        return ""
    if not edits or abs(len(word) - len(right)) > edits:
        return None
    same = next((i for i, (a, b) in enumerate(zip(word, right)) if a != b), min(len(word), len(right)))
    # one of the confusions lies at the first difference, another may have prepared it beside it
    for i in range(max(0, same - 2), min(len(word), same + 3)):
        for wrong in {word[i : i + 1], word[i : i + 2]}:
            for meant in _UNDONE.get(wrong, ()):
                rest = explain(word[:i] + meant + word[i + len(wrong) :], right, edits - 1)
                if rest is not None:
                    return f"{wrong}>{meant}|{rest}" if rest else f"{wrong}>{meant}"
    return None


def _thirds(n: int) -> list[tuple[int, int]]:
    return [(n * k // 3, n * (k + 1) // 3) for k in range(3)]


def third_keys(word: str, of_vocabulary: bool) -> list[int]:
    """Hashes of (length, third, letters): a word's own thirds, or all that a word it was may have."""
    out = set()
    for n in (len(word),) if of_vocabulary else range(len(word) - EDITS, len(word) + EDITS + 1):
        for k, (a, b) in enumerate(_thirds(n)):
            for shift in (0,) if of_vocabulary else range(-EDITS, EDITS + 1):
                if 0 <= a + shift and b + shift <= len(word):
                    out.add(_signed_hash(f"{n} {k} {word[a + shift : b + shift]}"))
    return sorted(out)


def word_hash(word: str, seed: int = 42) -> int:
    """The engine's own 64-bit hash of a string, without sign."""
    return xxhash.xxh64_intdigest(word.encode(), seed)


def _signed_hash(word: str, seed: int = 42) -> int:
    h = word_hash(word, seed)
    return h - (1 << 64) if h >> 63 else h


def pair_hash(a: str, b: str) -> int:
    """The engine's hash of two columns."""
    return _signed_hash(b, word_hash(a))


def _filter(words: DataFrame) -> bytes:
    """A bit for each word's hash: FILTER bits, whatever the number of words."""
    h = F.pmod(F.xxhash64("word"), F.lit(FILTER))
    rows = words.groupBy(F.floor(h / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(word), 64) AS int))")).alias("bits")).toPandas()
    table = np.zeros(FILTER // 64, np.int64)
    table[rows["w"]] = rows["bits"]
    return table.tobytes()


def _in(bits: bytes, word: str) -> int:
    h = word_hash(word) & (FILTER - 1)
    return bits[h >> 3] >> (h & 7) & 1


def _lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _edge_rows(batches):
    for pdf in batches:
        rows = [(f, line_key(s), p, i) for f, p, t in zip(pdf["file"], pdf["page_id"], pdf["text"]) for i, s in enumerate(_lines_of(t)) if may_recur(s)]
        yield pd.DataFrame(rows, columns=["file", "key", "page_id", "at"])


def _wrapped_column(column):
    """Whether a sentence, or even a word, runs on in the next line; in a script without case,
    whether three lines follow each other that do not end a sentence."""
    return column.rlike(r"\p{L}[-¬=,\x{AD}]? *\n *\p{Ll}") | column.rlike(r"\p{Lo} *\n *\p{Lo}[^\n]*\p{Lo} *\n *\p{Lo}")


def _parse_rows(batches):
    for pdf in batches:
        rows = []
        for page, text, scan, recurring in zip(pdf["page_id"], pdf["text"], pdf["scan"], pdf["recurring"]):
            lines = _lines_of(text)
            drop = furniture(lines, set(recurring) if recurring is not None else set()) if scan else [False] * len(lines)
            tokens, _ = running_lines(lines, drop)
            pieces = sorted({regex.sub(r"\s+", " ", s.strip()) for s, d in zip(lines, drop) if d})
            rows.append((page, bool(scan), pieces, "\n".join(map(" ".join, tokens))))
        yield pd.DataFrame(rows, columns=["page_id", "scan", "furniture", "lines"])


def _sources_column(column, bits):
    @F.pandas_udf("array<struct<cand:string,how:string>>")
    def f(words: pd.Series) -> pd.Series:
        own = bits.value
        return words.map(lambda w: [{"cand": c, "how": h} for c, h in sources(w, lambda x: _in(own, x))])

    return f(column)


def _thirds_column(column, of_vocabulary: bool):
    @F.pandas_udf("array<long>")
    def f(words: pd.Series) -> pd.Series:
        return words.map(lambda w: third_keys(w, of_vocabulary))

    return f(column)


def _explain_column(word, cand):
    @F.pandas_udf("string")
    def f(words: pd.Series, cands: pd.Series) -> pd.Series:
        return pd.Series([explain(w, c) if _lettered(c) else None for w, c in zip(words, cands)], dtype=object)

    return f(word, cand)


def parse(pages: DataFrame) -> DataFrame:
    """``(page_id, scan, furniture, lines)``; a file is a scan when sentences or words are broken
    over its lines. ``lines`` holds the running lines' tokens, set apart by spaces and line breaks."""
    base = pages.where(F.col("text").isNotNull() & (F.col("text") != "")).select(
        "page_id", F.coalesce("pdf_path", F.lit("")).alias("file"), "text"
    )
    base = widen(base)
    # what is known of pages by their files is joined without the texts
    light = base.select("page_id", "file", _wrapped_column(F.col("text")).alias("wrapped"))
    scans = light.where("wrapped").select("file").distinct().withColumn("scan", F.lit(True))
    edges = base.mapInPandas(_edge_rows, "file string, key string, page_id long, at int").join(scans, "file", "left_semi")
    often = edges.groupBy("file", "key").agg(F.min("page_id").alias("a"), F.max("page_id").alias("b")).where("a <> b").select("file", "key")
    recurring = edges.join(often, ["file", "key"]).groupBy("page_id").agg(F.collect_set("at").alias("recurring"))
    flags = light.select("page_id", "file").join(scans, "file").select("page_id", "scan").distinct().join(recurring, "page_id", "left")
    ready = base.join(flags, "page_id", "left").select("page_id", "text", F.coalesce("scan", F.lit(False)).alias("scan"), "recurring")
    return ready.mapInPandas(_parse_rows, "page_id long, scan boolean, furniture array<string>, lines string")


def _weighted(options: DataFrame) -> DataFrame:
    """``options`` with ``weight``, the log probability that the candidate is a word at all.

    It falls with the share outside of scans below ``KNOWN``, and for a word that a known one
    explains as a misreading of itself.
    """
    share = F.least(F.lit(1.0), F.greatest(F.lit(UNSEEN), F.col("clean_cand") / F.col("n_cand") / KNOWN))
    likely = F.col("n_cand") * F.pow(F.lit(START_P), F.size(F.split("how", r"\|")))
    explained = options.where("known").groupBy(F.col("word").alias("cand")).agg(F.max(likely).alias("source"))
    real = F.when(F.col("known"), F.lit(1.0)).otherwise(REAL / (REAL + F.coalesce("source", F.lit(0.0))))
    return options.join(explained, "cand", "left").withColumn("weight", F.log(share) + F.log(real)).drop("source")


def repair(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Furniture ``(page_id, piece)``, broken words ``(page_id, piece)`` and misread words
    ``(page_id, word, right)`` of the pages ``(page_id, pdf_path, text)``.

    Null and empty texts have none. A file no page of which has a sentence running over a line
    end is no scan; its pages only add to the vocabulary. Pages extracted again are pages
    of their own.
    """
    spark = pages.sparkSession
    parsed = cut(parse(pages))
    tokens = parsed.select("scan", F.explode(F.split("lines", r"[ \n]+")).alias("word"))
    counts = tokens.where((F.col("word") != "") & ~F.contains("word", F.lit("\u0001"))).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.col("scan"), 1).otherwise(0)).alias("clean")
    )
    counts = cut(counts)
    size = counts.agg(F.sum("n")).collect()[0][0] or 1

    # broken words: both readings, in one or with a hyphen
    broken = parsed.select(F.explode(F.regexp_extract_all("lines", F.lit("([^ \\n]*\u0001[^ \\n]*)"))).alias("raw")).distinct()
    reading = F.explode(F.array(F.replace("raw", F.lit("\u0001"), F.lit("")), F.replace("raw", F.lit("\u0001"), F.lit("-")))).alias("word")
    forms = broken.select("raw", reading).join(counts.select("word", "n"), "word", "left")
    forms = cut(forms.select("raw", "word", F.coalesce("n", F.lit(0)).alias("n")))

    # suspects: words of scans that the corpus hardly has outside of them
    mended = forms.where("n = 0").select("word").distinct().select("word", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("clean"))
    suspects = (
        counts.where("n > clean AND clean * 20 <= n")
        .unionAll(mended)
        .where((F.length("word") >= 2) & F.col("word").rlike(r"\p{L}"))
        .select("word", F.col("n").alias("n_word"), F.col("clean").alias("clean_word"))
    )
    suspects = cut(suspects)
    short, long = suspects.where(F.length("word") <= LONG), suspects.where(F.length("word") > LONG)
    bits = spark.sparkContext.broadcast(_filter(counts))
    made = short.withColumn("c", F.explode(_sources_column("word", bits))).select("word", "n_word", "clean_word", F.col("c.cand").alias("cand"), F.col("c.how").alias("how"))
    vocabulary = counts.where(F.length("word") > LONG - EDITS).select(F.col("word").alias("cand"), F.explode(_thirds_column("word", True)).alias("k"))
    met = long.withColumn("k", F.explode(_thirds_column("word", False))).join(vocabulary, "k").where("word <> cand").drop("k").distinct()
    met = met.withColumn("how", _explain_column("word", "cand")).where(F.col("how").isNotNull()).select("word", "n_word", "clean_word", "cand", "how")
    options = (
        made.unionAll(met)
        .join(counts.select(F.col("word").alias("cand"), F.col("n").alias("n_cand"), F.col("clean").alias("clean_cand")), "cand")
        .withColumn("known", F.col("clean_cand") / F.col("n_cand") > KNOWN)
        .where(
            F.col("word").rlike(r"\d")
            | F.col("known") & (F.col("n_cand") > F.col("n_word") * OFTENER) & (F.col("n_cand") >= OFTENER)
            | (F.col("n_cand") > F.col("n_word") * RARER)
        )
    )
    options = _weighted(cut(options))
    # confusion probabilities from first decisions: one row for each confusion of the fixed table
    first = options.groupBy("word").agg(F.max_by("how", F.log("n_cand") + F.col("weight") + F.log(F.lit(START_P)) * F.size(F.split("how", r"\|"))).alias("how"), F.max("n_word").alias("n"))
    tally = {r["h"]: r["n"] for r in first.select(F.explode(F.split("how", r"\|")).alias("h"), "n").groupBy("h").agg(F.sum(F.greatest("n", F.lit(1))).alias("n")).collect()}
    mean = (sum(tally.values()) or 1) / max(1, len(tally))
    logs = {h: log(START_P * (n + 0.05 * mean) / (1.05 * mean)) for h, n in tally.items()}
    floor = log(START_P * 0.05 / 1.05)
    scored = spark.createDataFrame([(h, v) for h, v in logs.items()] or [("", 0.0)], "h string, v double")
    channel = (
        options.select("word", "cand", F.explode(F.split("how", r"\|")).alias("h"))
        .join(F.broadcast(scored), "h", "left")
        .groupBy("word", "cand")
        .agg(F.sum(F.coalesce("v", F.lit(floor))).alias("logp"))
    )
    states = (
        options.join(channel, ["word", "cand"])
        .groupBy("word", "n_word", "clean_word")
        .agg(F.collect_list(F.struct("cand", (F.col("logp") + F.col("weight")).alias("logp"), "n_cand")).alias("cands"))
    )

    # the suspects of the lines, found with a filter and then by join
    states = cut(states)
    asked = spark.sparkContext.broadcast(_filter(states))
    hits = cut(parsed.where("scan").select("page_id", "lines").mapInPandas(_hit_rows(asked), "page_id long, line int, at int, raw string, before string, after string"))
    # a broken word's states: its readings as they stand, and what each may be a misreading of
    misread_as = forms.join(states, "word", "left").select("raw", "word", "n", F.coalesce("clean_word", F.lit(0)).alias("clean"), F.coalesce("cands", F.array()).alias("cands"))
    readings = misread_as.groupBy("raw").agg(F.collect_list(F.struct("word", "n", "clean", "cands")).alias("readings"))
    whole = states.select(F.col("word").alias("raw"), F.array(F.struct("word", F.col("n_word").alias("n"), F.col("clean_word").alias("clean"), "cands")).alias("readings"))
    placed = hits.join(whole.unionByName(readings), "raw")
    lattice = cut(
        placed.groupBy("page_id", "line").agg(F.collect_list(F.struct("at", "raw", "before", "after", "readings")).alias("suspects"))
    )
    # counts of single words and of pairs, by hash; those of the most frequent words go to all
    heavy = spark.sparkContext.broadcast({r["word"]: r["n"] for r in counts.where(F.col("n") >= F.lit(HEAVY * size)).select("word", "n").collect()})
    line = parsed.select(F.explode(F.split("lines", "\n")).alias("line")).select(F.split("line", " ").alias("t"))
    pairs = line.select(F.explode(F.expr("transform(slice(t, 1, size(t) - 1), (x, i) -> xxhash64(x, t[i + 1]))")).alias("h")).select("h", F.lit(1).cast("long").alias("n"))
    grams = pairs.unionAll(counts.select(F.xxhash64("word").alias("h"), "n")).groupBy("h").agg(F.sum("n").alias("n"))
    wanted = lattice.mapInPandas(_asks(heavy), "page_id long, line int, h long")
    answers = wanted.join(grams, "h").groupBy("page_id", "line").agg(F.collect_list(F.struct("h", "n")).alias("grams"))
    decoded = lattice.join(answers, ["page_id", "line"], "left").mapInPandas(_viterbi_rows(float(size), heavy), "page_id long, word string, right string, broken boolean")
    decoded = cut(decoded)
    # a broken word's decision is its piece; any other reading of a word than itself is a misreading
    split = decoded.where("broken").select("page_id", F.col("right").alias("piece")).distinct()
    misread = decoded.where("word <> right").select("page_id", "word", "right").distinct()
    found = parsed.select("page_id", F.explode("furniture").alias("piece")).distinct()
    return found, split, misread


def _options(readings) -> list[tuple[str, float, float]]:
    """``(form, log channel, occurrences)`` of a suspect, itself included; of a broken word for both
    readings, where a hyphen that nothing speaks for is the less likely one."""
    out: dict[str, tuple[float, float]] = {}
    broken = len(readings) > 1
    for r in readings:
        word, dashed = r["word"], broken and "-" in r["word"]
        itself = 1e-6 if any(ch.isdigit() for ch in word) else REAL * (0.1 if dashed else 1.0) + 0.1 * float(r["clean"])
        if broken and not len(r["cands"]):
            itself = max(itself, float(r["n"]))
        for form, logp, n in [(word, 0.0, itself)] + [(c["cand"], c["logp"], float(c["n_cand"])) for c in r["cands"]]:
            if form not in out or (logp, n) > out[form]:
                out[form] = (logp, n)
    return [(form, logp, n) for form, (logp, n) in out.items()]


def _as_read(readings) -> str:
    """A word as it stands; of a broken word the reading the corpus has more often, in one if none."""
    return max(readings, key=lambda r: (r["n"], "-" not in r["word"]))["word"]


def _hit_rows(asked):
    """The broken words and, as far as the filter can tell, the suspects of the lines, with the words beside them."""

    def run(batches):
        bits, known = asked.value, {}
        for pdf in batches:
            rows = []
            for page, lines in zip(pdf["page_id"], pdf["lines"]):
                for k, line in enumerate(lines.split("\n")):
                    some = line.split()
                    for at, raw in enumerate(some):
                        hit = known.get(raw)
                        if hit is None:
                            hit = "\u0001" in raw or bool(_in(bits, raw))
                            if len(known) < 400_000:
                                known[raw] = hit
                        if hit:
                            rows.append((page, k, at, raw, some[at - 1] if at else None, some[at + 1] if at + 1 < len(some) else None))
            yield pd.DataFrame(rows, columns=["page_id", "line", "at", "raw", "before", "after"])

    return run


def lattice_cells(suspects) -> list[tuple[int, list[tuple[str, float, float | None]]]]:
    """``(place, states)`` of a line's suspects and of the words beside them, whose count is None."""
    found = {x["at"]: _options(x["readings"]) for x in suspects}
    for x in suspects:
        for at, word in ((x["at"] - 1, x["before"]), (x["at"] + 1, x["after"])):
            if word is not None and at not in found:
                found[at] = [(word.replace("\u0001", ""), 0.0, None)]
    return sorted(found.items())


def _errors(suspects) -> set[str]:
    """Words whose own pairs speak for nothing: suspects as they stand, where they have another form."""
    return {r["word"] for x in suspects for r in x["readings"] if len(r["cands"])}


def _neighbours(cells, own: set[str]):
    """Pairs of states that stand beside each other; a suspect's own pairs are its errors' and speak for nothing."""
    for (i, left), (j, right) in zip(cells, cells[1:]):
        if j == i + 1 and (len(left) > 1 or len(right) > 1):
            for a, _, _ in left:
                for b, _, _ in right:
                    if a not in own and b not in own:
                        yield a, b


def _asks(heavy):
    def run(batches):
        frequent = heavy.value
        for pdf in batches:
            pages, lines, hashes = [], [], []
            for page, line, suspects in zip(pdf["page_id"], pdf["line"], pdf["suspects"]):
                cells = lattice_cells(suspects)
                want = {pair_hash(a, b) for a, b in _neighbours(cells, _errors(suspects))}
                want |= {_signed_hash(w) for _, cell in cells for w, _, n in cell if n is None and w not in frequent}
                pages += [page] * len(want)
                lines += [line] * len(want)
                hashes += want
            yield pd.DataFrame({"page_id": np.array(pages, np.int64), "line": np.array(lines, np.int32), "h": np.array(hashes, np.int64)})

    return run


def viterbi(cells: list[list[tuple[str, float, float]]], bigrams: dict[tuple[str, str], int], size: float) -> list[str]:
    """The most probable forms of a line: channel times bigram likelihood."""
    best: list[list[tuple[float, int]]] = []
    for k, cell in enumerate(cells):
        row = []
        for form, channel, n in cell:
            alone = n / size
            if k == 0:
                row.append((channel + log(alone), -1))
                continue
            score, source = max(
                (best[k - 1][j][0] + log(PAIR * min(1.0, bigrams.get((left, form), 0) / max(m, 1.0)) + (1 - PAIR) * alone), j)
                for j, (left, _, m) in enumerate(cells[k - 1])
            )
            row.append((score + channel, source))
        best.append(row)
    at = max(range(len(cells[-1])), key=lambda j: best[-1][j][0])
    out = []
    for k in range(len(cells) - 1, -1, -1):
        out.append(cells[k][at][0])
        at = best[k][at][1]
    return out[::-1]


def _viterbi_rows(size: float, heavy):
    def run(batches):
        frequent = heavy.value
        for pdf in batches:
            rows = []
            for page, line, suspects, grams in zip(*(pdf[c] for c in ("page_id", "line", "suspects", "grams"))):
                n_of = {g["h"]: g["n"] for g in grams} if grams is not None else {}
                cells = lattice_cells(suspects)
                pairs = {(a, b): n_of.get(pair_hash(a, b), 0) for a, b in _neighbours(cells, _errors(suspects))} if n_of else {}
                states = [[(w, p, float(frequent.get(w) or n_of.get(_signed_hash(w), 1)) if n is None else n) for w, p, n in cell] for _, cell in cells]
                forms = dict(zip((at for at, _ in cells), viterbi(states, pairs, size)))
                for x in suspects:
                    right, broken = forms[x["at"]], "\u0001" in x["raw"]
                    as_read = [r["word"] for r in x["readings"]]
                    word = right if right in as_read else _as_read(x["readings"])
                    if broken or right != word:
                        rows.append((page, word, right, broken))
            yield pd.DataFrame(rows, columns=["page_id", "word", "right", "broken"])

    return run


def readable(text: str, drop: list[bool], right: dict[str, str], whole: set[str]) -> str:
    """A page as paragraphs: furniture left out, words mended and set right, lines joined."""
    paragraphs: list[str] = []
    now = ""
    for line, d in zip(_lines_of(text), drop):
        if d:
            continue
        s = line.strip()
        if not s or line.startswith("   ") and now and not _BREAK.search(now):
            if now and _ENDS.search(now):
                paragraphs.append(now)
                now = ""
        if not s:
            continue
        m = _BREAK.search(now)
        if m and s[0].islower():
            first, second = TOKEN.findall(now)[-1].lower(), TOKEN.findall(s)[:1]
            dashed = second and f"{first}-{second[0].lower()}" in whole
            now = now[: m.start()] + ("-" if dashed else "") + s
        else:
            now = f"{now} {s}" if now else s
    if now:
        paragraphs.append(now)

    def fix(m):
        new = right.get(m.group().lower())
        if new is None:
            return m.group()
        return new.upper() if m.group().isupper() and len(new) > 1 else new[0].upper() + new[1:] if m.group()[0].isupper() else new

    return "\n\n".join(TOKEN.sub(fix, p) for p in paragraphs)


def readable_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, text)``: every page with text, as continuous readable paragraphs."""
    found, split, misread = repair(pages)
    per_page = (
        misread.select("page_id", F.struct("word", "right").alias("m"), F.lit(None).cast("string").alias("w"), F.lit(None).cast("string").alias("f"))
        .unionAll(split.select("page_id", F.lit(None), "piece", F.lit(None)))
        .unionAll(found.select("page_id", F.lit(None), F.lit(None), "piece"))
        .groupBy("page_id")
        .agg(F.collect_list("m").alias("right"), F.collect_list("w").alias("whole"), F.collect_list("f").alias("furniture"))
    )

    def run(batches):
        for pdf in batches:
            rows = []
            for page, text, right, whole, pieces in zip(*(pdf[c] for c in ("page_id", "text", "right", "whole", "furniture"))):
                if right is None:
                    rows.append((page, text))
                    continue
                gone = set(pieces)
                drop = [regex.sub(r"\s+", " ", s.strip()) in gone for s in _lines_of(text)]
                rows.append((page, readable(text, drop, {m["word"]: m["right"] for m in right}, set(whole))))
            yield pd.DataFrame(rows, columns=["page_id", "text"])

    texts = pages.where(F.col("text").isNotNull()).select("page_id", "text")
    return texts.join(per_page, "page_id", "left").mapInPandas(run, "page_id long, text string")
