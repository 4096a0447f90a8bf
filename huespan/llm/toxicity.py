"""8. Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text, normalised by length.

Folding lower-cases, maps look-alike letters of other scripts and full-width forms to Latin ones, drops invisible
characters, and turns digits and signs that stand beside letters back into the letters they replace (1d10t). The
words of the folded text, with one space around each, are what the automaton runs over: an entry ` foo ` is a whole word,
` foo` the start of one. Matches inside an exception phrase don't count. The sum of the weights of the matches,
over the square root of the text's length in hundreds of words, becomes a score from 0 to 1.

The lexicon has hand-written entries and learned ones. Learning takes a bounded sample of labelled rows
(SAMPLE_ROWS, a parameter, by a hash of the key; one text for each key): word starts and whole words are counted by class in Spark; all whose weight, a lower bound of their log odds,
exceeds LEAST_WEIGHT become candidates; then entries are taken one by one, each the one that adds most to positives
covered fewer than COVER times, until none adds enough. What the driver holds is bounded by the sample alone.

Null and empty texts score 0. Repeated rows score alike; for a key with several labels the largest counts, for one with several texts the one with the smallest hash. Ties between entries go to the
longer, then the later in order. An empty label table leaves the hand-written entries. Columns of other names are kept, one named as the score is replaced. Scoring is by row, in passes
over its whole text whatever its length; only the lexicon travels. An empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huespan.llm.common import materialize

SAMPLE_ROWS, COVER = 20_000, 3
STEM_SIZES = range(3, 9)
#: Counts of features that a task holds before it passes them on.
FEATURES_HELD = 200_000
#: Lower bound of the log odds that a learned entry needs.
LEAST_WEIGHT = 1.5
THRESHOLD = 0.3
_LETTERS = re.compile(r"[^\W\d_]+")

# Letters of other scripts that look like Latin ones, and what stands in for letters.
HOMOGLYPHS = str.maketrans(
    dict(zip("абвгдеёзијкмнорстухѕіїјһԁԛԝ", "abbrdeesnjkmhopctyxsiijhdqw", strict=True))
    | dict(zip("αβγεικνορτυχωη", "abyeiknoptuxwn", strict=True))
    | {chr(0xFF41 + k): chr(97 + k) for k in range(26)}
    | {chr(0xFF10 + k): chr(48 + k) for k in range(10)}
    | {"ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "ｓ": "s"}
    | dict.fromkeys("\xad​‌‍⁠﻿̶̵", None)
)
_FOREIGN = re.compile("[" + "".join(re.escape(chr(k)) for k in HOMOGLYPHS) + "]")
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "i", "!": "i"}
#: Runs of stand-ins right before a word's first letter (signs, and one digit), and behind a letter, where each but the last of a word is followed by more of it.
_STAND_INS = re.compile(r"(?<![^\W_])(?<![@$])(?:[@$]++[0134578]?|[0134578])(?=[^\W\d_])|(?<=[^\W\d_])(?:[0134578@$|!](?=[^\W_]|[@$|])|[013457@$](?![\d,.]*\d))++")
_DIGITS = str.maketrans(DIGITS)
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][.\-*_ ]){3,}[^\W\d_](?![^\W_])")

# Hand-written entries with weights, and phrases in which they are harmless.
ENTRIES = {
    " idiot": 3.0, " moron": 3.0, " stupid": 2.2, " imbecil": 3.0, " dumbass": 4.0, " scum": 3.0, " loser": 2.2, " pathetic": 2.2, " worthless": 2.4, " disgusting": 2.2,
    " trash ": 1.6, " clown ": 1.8, " retard": 3.0, " asshole": 4.0, " bastard": 3.0, " bitch": 3.5, " cunt": 4.5, " dickhead": 4.0, " fuck": 3.0, " shithead": 4.0,
    " bullshit": 2.2, " whore": 3.5, " slut": 3.5, " wanker": 3.5, " twat": 3.5, " vermin": 2.0, " subhuman": 4.0, " kill yourself ": 5.0, " go to hell ": 3.0, " shut up ": 1.5,
    " hate you ": 2.5, " hope you die ": 5.0, " arschloch": 4.0, " hurensohn": 4.5, " schlampe": 3.5, " vollidiot": 4.0, " wichser": 4.0, " abschaum": 3.0, " missgeburt": 4.0,
    " connard": 4.0, " salope": 4.0, " enculé": 4.5, " putain ": 2.0, " abruti": 3.0, " ordure ": 2.0, " crétin": 3.0, " imbécile": 3.0,
    " cabrón": 3.0, " gilipollas": 4.0, " hijo de puta ": 5.0, " pendejo": 3.5, " estúpid": 2.5, " basura ": 1.5, " escoria ": 2.5,
}
EXCEPTIONS = [
    " trash can ", " trash bin ", " trash bag ", " trash collection ", " take out the trash ", " clown fish ", " circus clown ", " clown school ", " sore loser ", " loser s bracket ", " winner and loser ",
    " the idiot by dostoevsky ", " dostoevsky s idiot ", " vermin control ", " scum of the pond ", " pond scum ", " soap scum ", " flame retardant ", " fire retardant ", " retarded potential ", " retarded time ",
    " not stupid ", " no such thing as a stupid question ", " stupid simple ", " useful idiot ", " idiot proof ",
    " bastard sword ", " bastard file ", " bastard cut ", " vermin proof ", " white trash bag ", " trash compactor ", " retard the growth ", " retard the spread ",
    " retard en ", " en retard ", " un retard ", " le retard ", " du retard ", " de retard ", " ce retard ", " son retard ", " leur retard ", " sans retard ", " au retard ", " retard de ", " retard du ", " retards ",
    " retarder", " retardé", " retardement", " retardateur", " retardatair", " salopette", " poisson clown ", " nez de clown ", " ordure ménagère ", " sac à ordure ", " l idiot de dostoïevski ", " crétinisme ",
    " retardo ", " retardos ", " retardar", " retardad", " cubo de basura ", " bote de basura ", " bolsa de basura ", " camión de basura ", " contenedor de basura ", " recogida de basura ", " sacar la basura ",
    " tirar la basura ", " tirar a la basura ", " cesto de basura ", " correo basura ", " comida basura ", " escoria volcánica ", " escoria de alto horno ", " el idiota de dostoievski ", " pez payaso ", " nariz de clown ",
    " der idiot von dostojewski ", " dostojewskis idiot ", " idiotensicher", " idiotikon ", " retardiert", " retardierend", " schlamperei", " in loser folge ", " in loser reihe ", " loser zusammenschluss ", " loser verbund ",
    " loser tabak ", " loser tee ", " loser schnee ", " bastardzypresse", " bastardklee", " clown im zirkus ",
]


def fold(text: str) -> str:
    """Lower-case text with stand-ins undone."""
    t = text.lower()
    if not t.isascii() and _FOREIGN.search(t):
        t = t.translate(HOMOGLYPHS)
    while _STAND_INS.search(t):  # a run goes at once; a further pass is due where a number turned out to be a word
        t = _STAND_INS.sub(lambda m: m[0].translate(_DIGITS), t)
    if _SPACED.search(t):
        t = _SPACED.sub(lambda m: re.sub(r"[.\-*_ ]", "", m[0]), t)
    return t


class Lexicon:
    """Weighted entries over folded words. scale: the raw value at which the score is THRESHOLD."""

    def __init__(self, entries: dict[str, float] | None = None, scale: float = 1.0, exceptions: list[str] | None = None):
        self.entries = dict(ENTRIES) if entries is None else entries
        self.exceptions = EXCEPTIONS if exceptions is None else exceptions
        self.scale = scale
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def matches(self, text: str | None) -> tuple[list[tuple[int, int, str]], int]:
        """Matches (start, end, entry) outside exception phrases, and the number of words."""
        import ahocorasick

        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for e in self.entries:
                self._automaton.add_word(e, (e, False))
            for e in self.exceptions:
                self._automaton.add_word(e, (e, True))
            self._automaton.make_automaton()
        words = _LETTERS.findall(fold(text or ""))
        line = f" {' '.join(words)} "
        found, free = [], []
        for end, (e, harmless) in self._automaton.iter(line):
            (free if harmless else found).append((end - len(e) + 1, end + 1, e))
        if free:
            free.sort()
            begins, reach = [a for a, _, _ in free], list(accumulate((b for _, b, _ in free), max))  # how far the phrases up to each one reach
            found = [m for m in found if not ((at := bisect_right(begins, m[0])) and m[1] <= reach[at - 1])]
        return found, len(words)

    def raw(self, text: str | None) -> float:
        found, n = self.matches(text)
        best: dict[int, float] = {}  # the entries that start at a place are one word: its best weight counts
        for start, _, e in found:
            best[start] = max(best.get(start, 0.0), self.entries[e])
        return sum(best.values()) / math.sqrt(max(1.0, n / 100))

    def score(self, text: str | None) -> float:
        """From 0 to 1; THRESHOLD where the raw value is the scale."""
        raw = self.raw(text)
        return raw / (raw + self.scale * (1 - THRESHOLD) / THRESHOLD)


def _features(text: str | None) -> set[str]:
    out = set()
    for w in set(_LETTERS.findall(fold(text or ""))):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in STEM_SIZES if len(w) >= k)
    return out


def sample_of(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Texts and labels (text, y) of at most `rows` labelled keys outside the held-out fold, a row for each; the keys' number bounds the broadcast."""
    key = F.col("doc_id").cast("long")
    train = labels.select(key.alias("k"), F.col("toxic").cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull() & (F.crc32(F.col("k").cast("string").cast("binary")) % 4 != 2))
    picked = train.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(rows)
    texts = docs.select(key.alias("k"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "k")
    return texts.groupBy("k", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "y")


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Lexicon:
    """A lexicon fitted on a bounded sample; see the module's text."""
    sample = materialize(sample_of(docs, labels, rows), "sample")  # three passes below read it

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            names = list(pos.keys() | neg.keys())
            for k in range(0, len(names), 50_000):
                part = names[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([pos[f] for f in part], pa.int64()), pa.array([neg[f] for f in part], pa.int64())], ["f", "p", "n"])
            pos.clear()
            neg.clear()

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                (pos if y else neg).update(_features(text.as_py()))
                (pos if y else neg)[""] += 1
                if len(neg) + len(pos) > FEATURES_HELD:
                    yield from out()
        yield from out()

    found = sample.mapInArrow(counts, "f string, p long, n long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where((F.col("p") >= 2) | (F.col("f") == ""))
    found = materialize(found, "features")
    totals = found.where("f = ''").select("p", "n").first() or (0, 0)
    a, b = (F.col("p") + 0.5) / (totals[0] + 1), (F.col("n") + 0.5) / (totals[1] + 1)
    weight = F.log(a / b) - 1.3 * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    top = found.where((F.col("f") != "") & (F.col("p") > F.col("n"))).withColumn("w", weight).where(F.col("w") > LEAST_WEIGHT).select("f", "w").collect()
    candidates = {r.f: r.w for r in sorted(top)}
    probe = Lexicon(candidates | ENTRIES, exceptions=[])

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sorted({e for _, _, e in probe.matches(t.as_py())[0]}) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.string()))], ["y", "e"])

    held = sample.mapInArrow(covered, "y int, e array<string>").where(F.size("e") > 0).collect() if candidates else []
    chosen = _cover([set(r.e) for r in held if r.y], [set(r.e) for r in held if not r.y], candidates)
    lexicon = Lexicon(ENTRIES | chosen)

    def raws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([lexicon.raw(t.as_py()) for t in batch.column(0)], pa.float64())], ["y", "raw"])

    lexicon.scale = _boundary([(r.raw, r.y) for r in sample.mapInArrow(raws, "y int, raw double").collect()])
    return lexicon


def _cover(positives: list[set[str]], negatives: list[set[str]], candidates: dict[str, float]) -> dict[str, float]:
    """Entries taken greedily until no further one adds to positives covered fewer than COVER times."""
    against = Counter(e for s in negatives for e in s)
    where: dict[str, list[int]] = {}
    for k, s in enumerate(positives):
        for e in s:
            where.setdefault(e, []).append(k)
    need = [COVER] * len(positives)
    chosen: dict[str, float] = {}
    gain = {e: len(ks) for e, ks in where.items() if e in candidates}
    least = max(3, len(positives) // 500)
    while gain:
        e = max(gain, key=lambda x: (gain[x] - 5 * against[x], len(x), x))
        if gain[e] - 5 * against[e] < least:
            break
        chosen[e] = candidates[e]
        for k in where[e]:
            need[k] -= 1
            if need[k] == 0:
                for x in positives[k]:
                    if x in gain:
                        gain[x] -= 1
        stem = e.rstrip()
        for x in [x for x in gain if x.startswith(stem) or stem.startswith(x) and where[x] == where[e]]:
            del gain[x]  # e itself, what it covers, and what covers no more than it
    return chosen


def _boundary(rows: list[tuple[float, int]]) -> float:
    """The raw value that parts the classes with the fewest errors, halfway to its neighbours."""
    values = sorted(rows)
    if not any(y for _, y in values):
        return 1.0
    wrong = best = sum(1 for _, y in values if not y)  # all predicted 1
    cut = (values[0][0] / 2, values[0][0] / 2)
    for k, (raw, y) in enumerate(values):
        wrong += 1 if y else -1
        nxt = values[k + 1][0] if k + 1 < len(values) else raw + 1
        if nxt > raw and wrong < best:
            best, cut = wrong, (raw, nxt)
    return max(0.2, (cut[0] + cut[1]) / 2)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a column `score` from 0 to 1; a column of that name is replaced."""
    keep = [c for c in docs.columns if c != score]
    at = keep.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = pa.array([lexicon.score(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, s], [*keep, score])

    rows = docs.select(*[docs[c] for c in keep])
    return rows.mapInArrow(work, T.StructType([*rows.schema.fields, T.StructField(score, T.DoubleType())]))
