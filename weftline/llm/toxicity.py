"""Operator 6, toxicity: a support vector machine on a subsequence string kernel with Nystroem landmarks.

Kernel. The common subsequences of three characters of a word and a landmark are summed, each worth
``DECAY`` to the number of characters that it spans, and divided by the norms; that of a longer word is
lessened by the root of the lengths' quotient, and the result is 1 at most. So characters put into or left out of an insult lower it but little, and there is
no floor. A word whose letters can't carry ``REACH`` of the landmark's norm, by Cauchy and Schwarz, counts as 0
without being compared; a word with an insult's letters and others between them always can.

Landmarks are the word parts that tell toxic from other labelled texts: those in some toxic texts that
hardly occur elsewhere, whole insults before their pieces, and that do so in the second half of the sample
too. The landmarks' own kernel matrix gives Nystroem features, and for each landmark a linear machine with
squared hinge loss parts the toxic texts' words that hold it from the clean texts' words that share some of it.

Threshold. A text is as toxic as its worst word. Each machine's threshold lies where so few clean texts are
above it that all machines together give a share of ``ALARMS``, and ``MARGIN`` of the way from there to the words
that hold the landmark; so a landmark that clean words resemble is stricter than one that stands alone.
Everything is learned from a bounded sample: at most ``PER_LABEL`` texts of a label, each of at most
``MAX_BYTES`` bytes, none held out. All texts are scored whole. Single letters that stand apart in a row are
read as one word too.

Null and empty texts have no words and get the lowest score. If the sample lacks a label or a landmark, the score
is the sample's share of label 1 (one half without any sample). A null id counts as the empty text in the
split; each input row gives one row, repeated rows included; further columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import crc_remainder, map_batches, mix, random_table, text_bytes
from weftline.llm.labelled import labelled_sample, sigmoid

PER_LABEL, MAX_BYTES = {0: 2000, 1: 1200}, 32_768
#: Span decay; share of a landmark's norm that a word's letters must be able to carry.
DECAY, REACH = 0.9, 0.75
#: Toxic texts that must hold a landmark: a share of them within two fixed numbers, so a larger sample asks for no more. Lengths of landmarks.
MIN_TEXTS, MIN_SHARE, PART = (4, 8), 0.025, (4, 12)
#: Share of false ones among confirmed landmarks, as expected.
DISCOVERIES = 0.1
#: Clean texts above the thresholds, and where these lie from there to the toxic words.
ALARMS, MARGIN = 0.005, 0.12
#: Slope of the logistic curve from a margin to a score.
STEEP = 4.0
#: Longest word that is compared at once, words compared at once, words kept in a worker's cache.
WIDTH, AT_ONCE, CACHE_WORDS = 24, 20_000, 400_000
_LONE = re.compile(r"(?:(?<=\s)|^)(?:\w[\s.\-_*]+){2,}\w(?=\s|$|[.,!?])")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def words_of(text: str) -> set[str]:
    """Distinct lower-case words without punctuation around them; of longer words all windows of ``WIDTH`` at half steps; spelled-out words joined."""
    lowered = text.lower()
    out = {w if w[0].isalnum() and w[-1].isalnum() else _EDGES.sub("", w) for w in set(lowered.split())}
    for spelled in _LONE.findall(lowered):
        out.add(re.sub(r"[\s.\-_*]+", "", spelled))
    long = [w for w in out if len(w) > WIDTH]
    for w in long:
        out.discard(w)
        out.update(w[i: i + WIDTH] for i in range(0, len(w) - WIDTH // 2, WIDTH // 2))
    out.discard("")
    return out


def points_of(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each position."""
    return np.ascontiguousarray(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).T)


def raw_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Gap-weighted common subsequences of three characters of each column of ``s`` with ``t``: one word, or a column for each."""
    rows, square = s.shape[1], np.float32(DECAY * DECAY)
    one, two = (np.zeros((len(t) + 1, rows), np.float32) for _ in range(2))  # subsequences of one and two characters up to each place of t
    total = np.zeros(rows, np.float32)
    for column in s:
        run_one, run_two = np.zeros(rows, np.float32), np.zeros(rows, np.float32)
        new_one, new_two = np.empty_like(one), np.empty_like(two)
        new_one[0] = new_two[0] = 0
        for b, other in enumerate(t):
            same = column == other
            total += same * two[b]
            run_two = DECAY * run_two + same * (square * one[b])
            run_one = DECAY * run_one + same * square
            new_two[b + 1] = DECAY * two[b + 1] + run_two
            new_one[b + 1] = DECAY * one[b + 1] + run_one
        one, two = new_one, new_two
    return total.astype(np.float64) * square


def _masks(points: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduce(np.uint64(1) << (points.astype(np.uint64) & np.uint64(63)), axis=0)


@dataclass
class Kernel:
    """Normalised kernels of words with the landmarks."""

    landmarks: list[str]
    _set: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"landmarks": self.landmarks, "_set": []}

    def _ready(self) -> list:
        """For each landmark its code points, norm, the bits of its letters, and what its part in each choice of letters reaches."""
        if not self._set:
            for z in self.landmarks:
                points = np.array([ord(c) for c in z], np.uint32)
                bits = np.unique(points & 63)
                self._set.append((points, float(raw_kernel(points[:, None], points)[0]), bits, np.full(1 << len(bits), np.nan)))
        return self._set

    @staticmethod
    def _reach(points: np.ndarray, norm: float, bits: np.ndarray, known: np.ndarray, choices: np.ndarray) -> np.ndarray:
        """The most that a word can have with the landmark, from the landmark's letters that it holds: by Cauchy and Schwarz, the norm of the landmark's subsequences of these letters."""
        for c in np.flatnonzero(np.isnan(known) & (np.bincount(choices, minlength=len(known)) > 0)).tolist():
            held = np.isin(points & 63, bits[[c >> i & 1 == 1 for i in range(len(bits))]])
            # other letters become marks that differ between the sides, so they never match but still span
            left, right = np.where(held, points, 1 << 30), np.where(held, points, 1 << 31)
            known[c] = math.sqrt(float(raw_kernel(left[:, None].astype(np.uint32), right.astype(np.uint32))[0]) / norm) if norm else 0.0
        return known[choices]

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)))
        lengths, ready = np.array([len(w) for w in words], np.int64), self._ready()
        sizes, norm_of = np.array([len(x[0]) for x in ready]), np.array([x[1] for x in ready])
        table = np.full((max(sizes, default=0), len(ready)), 1 << 31, np.uint32)  # a column for each landmark, filled up with what never matches
        for k, (z, *_) in enumerate(ready):
            table[: len(z), k] = z
        for n in np.unique(lengths[lengths >= 3]).tolist():
            of = np.flatnonzero(lengths == n)
            points = points_of([words[i] for i in of])
            masks, pairs = _masks(points), []
            for k, (z, norm, bits, known) in enumerate(ready):
                choices = np.zeros(len(of), np.int64)
                for i, b in enumerate(bits.tolist()):
                    choices |= ((masks >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
                rows = np.flatnonzero(self._reach(z, norm, bits, known, choices) >= REACH)
                pairs.append((rows, np.full(len(rows), k)))
            row, k = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
            if len(row):
                own, back = np.unique(row, return_inverse=True)
                norms = raw_kernel(points[:, own], points[:, own])[back] * np.minimum(1.0, sizes[k] / n) ** 0.5  # an ending added to an insult costs little
                out[of[row], k] = np.minimum(1, raw_kernel(points[:, row], table[:, k]) / np.sqrt(np.maximum(norms * norm_of[k], 1e-12)))
        return out


def without_copies(texts: list[set[str]]) -> list[int]:
    """Indices of the texts that are no near copy of an earlier one, so copies of one text don't make its words frequent."""
    seen: set[tuple] = set()
    out, salts = [], random_table(61, 12)
    for i, words in enumerate(texts):
        if words:
            hashes = np.array([zlib.crc32(w.encode(errors="replace")) for w in words], np.uint64)
            least = mix(hashes[:, None] * salts[None, :]).min(axis=0).tolist()
            keys = {(k, *least[3 * k: 3 * k + 3]) for k in range(4)}
        else:
            keys = {(-1, i)}
        if not keys & seen:
            out.append(i)
        seen |= keys
    return out


def support(toxic: int) -> int:
    """Texts that must hold a landmark, out of so many toxic ones."""
    return min(MIN_TEXTS[1], max(MIN_TEXTS[0], int(toxic * MIN_SHARE)))


def choose_landmarks(toxic: list[set[str]], other: list[set[str]], other_texts: list[str]) -> list[str]:
    """Word parts in many toxic texts that are at least twenty times rarer in the others, each in words without the ones before."""
    rate = max(1, len(other)) / max(1, len(toxic))
    usual = Counter(w for words in other for w in words)
    texts_of: dict[str, set[int]] = defaultdict(set)
    for i, words in enumerate(toxic):
        for w in words:
            texts_of[w].add(i)
    texts_of = {w: found for w, found in texts_of.items() if len(found) * rate >= 20 * usual[w]}
    words_with: dict[str, set[str]] = defaultdict(set)
    for w in texts_of:
        for a in range(len(w) - PART[0] + 1):
            for b in range(a + PART[0], min(len(w), a + PART[1]) + 1):
                words_with[w[a:b]].add(w)
    least = support(len(toxic))
    spread = {p: n for p, ws in words_with.items() if (n := len(set().union(*[texts_of[w] for w in ws]))) >= least}
    if not spread:
        return []
    search = ahocorasick.Automaton()
    for p in spread:
        search.add_word(p, p)
    search.make_automaton()
    elsewhere: Counter = Counter()
    for t in other_texts:
        elsewhere.update({p for _, p in search.iter(t.lower())})
    chosen: list[str] = []
    # of parts with like numbers of texts the longest goes first, so a whole insult comes before its pieces
    for p in sorted(spread, key=lambda p: (-int(math.log2(spread[p])), -len(p), p)):
        left = [w for w in words_with[p] if not any(q in w for q in chosen)]
        texts = set().union(*[texts_of[w] for w in left])
        if len(texts) >= least and len(texts) * rate >= 20 * elsewhere[p]:
            chosen.append(p)
    return chosen


@dataclass
class ToxicityModel:
    """``weights`` has a column for each landmark's machine; its margin is 0 at the threshold and 1 at words that hold the landmark."""

    kernel: Kernel
    weights: np.ndarray
    bias: np.ndarray
    lowest: float = 0.0

    def worst(self, texts: list[set[str]], seen: set[str], known: dict[str, float]) -> np.ndarray:
        """The highest margin of each text's words. ``seen`` keeps words that were compared, ``known`` the margins of those that share something with a landmark."""
        new = sorted(set().union(*texts) - seen) if texts and self.kernel.landmarks else []
        for a in range(0, len(new), AT_ONCE):
            part = new[a: a + AT_ONCE]
            values = self.kernel(part)
            some = np.flatnonzero(values.any(axis=1))
            known.update(zip([part[i] for i in some], (values[some] @ self.weights + self.bias).max(axis=1).tolist(), strict=True))
        seen.update(new)
        return np.array([max([known[w] for w in words if w in known], default=self.lowest) for words in texts])

    def score(self, margins: np.ndarray) -> np.ndarray:
        return sigmoid(STEEP * margins)


def hinge_machine(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 1e-3, rounds: int = 200) -> np.ndarray:
    """Linear machine with squared hinge loss by accelerated gradient steps; both labels weigh the same."""
    z, sign = np.hstack([x, np.ones((len(x), 1))]), np.where(y == 1, 1.0, -1.0)
    weight = times * np.where(y == 1, 0.5 / max(1, times[y == 1].sum()), 0.5 / max(1, times[y == 0].sum()))
    rate = 1 / (2 * np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2 + ridge)
    w = ahead = np.zeros(z.shape[1])
    for k in range(rounds):
        slack = np.maximum(0, 1 - sign * (z @ ahead))
        new = ahead - rate * (-2 * z.T @ (weight * sign * slack) + ridge * ahead)
        ahead, w = new + k / (k + 3) * (new - w), new
    return w


def holding(parts: list[str], texts: list[set[str]]) -> np.ndarray:
    """How many texts have a word with each part."""
    joined = ["\n".join(words) for words in texts]
    return np.array([sum(p in t for t in joined) for p in parts], np.int64)


def chance(toxic: int, texts: int, share: float) -> float:
    """The chance that at least ``toxic`` of so many texts are toxic, if each is with the chance ``share``."""
    logs = [math.lgamma(texts + 1) - math.lgamma(k + 1) - math.lgamma(texts - k + 1) + k * math.log(share) + (texts - k) * math.log1p(-share) for k in range(toxic, texts + 1)]
    return min(1.0, math.fsum(map(math.exp, logs)))


def confirmed(parts: list[str], toxic: list[set[str]], other: list[set[str]]) -> list[str]:
    """Parts that also tell toxic texts from others among texts that they weren't chosen from: eight times likelier there, and by more than chance, with a share of ``DISCOVERIES`` false ones."""
    if not toxic or not other:
        return []
    rate, share = len(other) / len(toxic), len(toxic) / (len(toxic) + len(other))
    counts = list(zip(holding(parts, toxic).tolist(), holding(parts, other).tolist(), strict=True))
    odds = [chance(t, t + c, share) if t * rate >= 8 * c else 1.0 for t, c in counts]
    sure = max((p for k, p in enumerate(sorted(odds), 1) if p <= DISCOVERIES * k / len(parts)), default=-1.0)
    return [p for p, x in zip(parts, odds, strict=True) if x <= sure]


def machines(landmarks: list[str], toxic: list[set[str]], clean: list[set[str]]) -> ToxicityModel:
    """A machine for each landmark, and its threshold."""
    kernel = Kernel(landmarks)
    gram = kernel(landmarks)
    roots, vectors = np.linalg.eigh((gram + gram.T) / 2)
    whiten = vectors / np.sqrt(np.maximum(roots, 1e-2)) @ vectors.T
    good, bad = (Counter(w for words in texts for w in words) for texts in (clean, toxic))
    words = sorted(good)
    values = np.vstack([np.zeros((0, len(landmarks))), *[kernel(words[a: a + AT_ONCE]) for a in range(0, len(words), AT_ONCE)]])
    some = np.flatnonzero(values.any(axis=1))
    place = {words[i]: k for k, i in enumerate(some)}
    near, times = values[some], np.array([good[words[i]] for i in some], float)
    texts_of = [np.array([place[w] for w in t if w in place], np.int64) for t in clean]
    holds = np.array([[z in words[i] for z in landmarks] for i in some], bool).reshape(len(some), len(landmarks))
    weights, bias = np.zeros((len(landmarks), len(landmarks))), np.zeros(len(landmarks))
    for k, z in enumerate(landmarks):
        held = [w for w in bad if z in w] or [z]
        here = np.flatnonzero((near[:, k] > 0) & ~holds[:, k])
        x = np.vstack([near[here], kernel(held), np.zeros((1, len(landmarks)))]) @ whiten  # the last: any word that shares nothing
        y = np.array([0] * len(here) + [1] * len(held) + [0])
        w = hinge_machine(x, y, np.concatenate([times[here], [bad[v] or 1 for v in held], [1.0]]))
        alpha = whiten @ w[:-1]
        # clean texts that hold the landmark itself are quotations or wrong labels, as it is confirmed
        rest = np.sort([0.0, *((near[of] @ alpha).max(initial=0.0) for of in texts_of if not holds[of, k].any())])
        alarm = rest[max(0, len(rest) - 1 - int(ALARMS * len(rest) / len(landmarks)))]
        sure = max(float(np.median(kernel(held) @ alpha)), 1e-6)
        if alarm < sure:
            cut = alarm + MARGIN * (sure - alarm)
            weights[:, k], bias[k] = alpha / (sure - cut), -cut / (sure - cut)
        else:  # clean words hold it as toxic ones do
            bias[k] = -1.0
    return ToxicityModel(kernel, weights, bias, float(bias.max()))


def fit(sample: list[tuple[str, int]]) -> ToxicityModel:
    labels = np.array([v for _, v in sample], np.int64)
    share = min(max(float(labels.mean()) if len(labels) else 0.5, 1e-6), 1 - 1e-6)
    texts = [words_of(t) for t, _ in sample]
    single = without_copies(texts)
    sample, texts, labels = [sample[i] for i in single], [texts[i] for i in single], labels[single]
    second = np.array([zlib.crc32(t.encode(errors="replace")) >> 7 & 1 for t, _ in sample], bool)

    def of(label: int, which: np.ndarray) -> list[int]:
        return np.flatnonzero((labels == label) & which).tolist()

    toxic, clean = ([texts[i] for i in of(v, ~second)] for v in (1, 0))
    chosen = choose_landmarks(toxic, clean, [sample[i][0] for i in of(0, ~second)]) if toxic and clean else []
    kept = confirmed(chosen, *([texts[i] for i in of(v, second)] for v in (1, 0)))
    if not kept:
        return ToxicityModel(Kernel([]), np.zeros((0, 0)), np.zeros(0), math.log(share / (1 - share)) / STEEP)
    return machines(kept, *([texts[i] for i in of(v, second | ~second)] for v in (1, 0)))


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", modulus: int = 5, held_remainder: int = 0) -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    model = fit(labelled_sample(docs, labels, label, modulus, held_remainder, PER_LABEL, MAX_BYTES, key, text))

    def make():
        seen: set[str] = set()
        known: dict[str, float] = {}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            if len(seen) > CACHE_WORDS:
                seen.clear()
                known.clear()
            scores = model.score(model.worst([words_of(t.decode()) for t in text_bytes(batch.column(2))], seen, known)).tolist()
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[key, "held_out", "score", "predicted"])

        return each

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, (crc_remainder(F.col(key), modulus) == held_remainder).alias("held_out"), F.col(text).cast("string"))
    return map_batches(rows, f"`{key}` {kind}, held_out boolean, score double, predicted int", make)
