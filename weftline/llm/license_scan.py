"""Operator 8, license scans: fuzzy search for short notices by pigeonhole seeds and bounded-error matching.

A notice that may hold k edits is split into k+1 pieces; in any match one piece stands unchanged, so an
Aho-Corasick automaton of all pieces finds every candidate place. There the regex library matches the
notice with at most k errors and gives the span. The words that tell licenses apart, a name or a version, may have
one error at most and must not be another license's. Exact places of the base phrases are counted as words.

Null and empty texts have no words and no places: counts 0, first_word and last_word null, labels
empty, score 0. Texts are searched whole; each row gives one row; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_batches, text_bytes


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int = 0
    names: tuple[str, ...] = ()


#: The base phrases, matched as whole words.
BASE = (Notice("under the mit license", "mit"), Notice("apache license version 2", "apache-2"), Notice("cc by nc", "cc-by-nc"))
#: What the method looks for besides, with up to so many edits.
NOTICES = (
    Notice("under the mit license", "mit", 2, ("mit",)),
    Notice("permission is hereby granted free of charge", "mit", 4),
    Notice("apache license version 2", "apache-2", 2, ("apache", "2")),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 3, ("noncommercial",)),
    Notice("creative commons attribution sharealike", "cc-by-sa", 3, ("sharealike",)),
    Notice("gnu general public license", "gpl", 2, ("gnu", "general")),
    Notice("gnu lesser general public license", "lgpl", 2, ("gnu", "lesser")),
    Notice("mozilla public license", "mpl", 2, ("mozilla",)),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
)
#: Names of other licenses that are one letter off a name above; numbers count as such too.
OTHERS = frozenset("mpl mit bsd gpl lgpl isc npl epl eupl gnu nist nit mitre apache".split())
#: Any byte that no word holds becomes a space; A-Z become a-z.
_MAP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def near(word: str, name: str) -> bool:
    """Whether a word is a name, or one edit off it and no other license's name or number."""
    if word == name:
        return True
    if word in OTHERS or word.isdigit() or name.isdigit() or abs(len(word) - len(name)) > 1:
        return False
    return regex.fullmatch(f"(?:{regex.escape(name)}){{e<=1}}", word) is not None


class Scanner:
    def __init__(self, base: tuple[Notice, ...] = BASE, notices: tuple[Notice, ...] = NOTICES):
        self.base, self.notices = base, notices
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(notices):
            cuts = [len(notice.phrase) * i // (notice.edits + 1) for i in range(notice.edits + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(notice.phrase[a:b], []).append((n, a))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()
        self.patterns = [regex.compile(f"(?:{regex.escape(x.phrase)}){{e<={x.edits}}}", regex.BESTMATCH) for x in notices]

    def words(self, text: bytes) -> list[str]:
        return text.translate(_MAP).decode().split(" ") if text else []

    def exact(self, joined: str) -> list[tuple[int, str]]:
        """(first word, label) of each place of a base phrase in words joined by spaces."""
        padded, out = f" {joined} ", []
        for notice in self.base:
            at = padded.find(f" {notice.phrase} ")
            while at >= 0:
                out.append((padded.count(" ", 0, at), notice.label))
                at = padded.find(f" {notice.phrase} ", at + 1)
        return out

    def fuzzy(self, joined: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, errors) of the notices, in characters of the joined words."""
        regions: dict[int, set[tuple[int, int]]] = {}
        for end, (length, uses) in self.seeds.iter(joined):
            for n, offset in uses:
                k, size = self.notices[n].edits, len(self.notices[n].phrase)
                a = max(0, end + 1 - length - offset - k)
                regions.setdefault(n, set()).add((a, min(a + size + 3 * k, len(joined))))
        found = []
        for n, spans in regions.items():
            notice, places = self.notices[n], []
            for a, b in sorted(spans):  # each seed's own place, so a better match nearby hides none
                m = self.patterns[n].search(joined, a, b)
                if m and self._named(joined, notice, m.start(), m.end()):
                    places.append((sum(m.fuzzy_counts), m.start(), m.end()))
            taken: list[tuple[int, int]] = []
            for errors, a, b in sorted(places):  # of matches that overlap the best
                if all(b <= x or a >= y for x, y in taken):
                    taken.append((a, b))
                    found.append((notice.label, a, b, errors))
        return found

    @staticmethod
    def _named(joined: str, notice: Notice, start: int, end: int) -> bool:
        """Whether the words that a match touches hold the notice's names."""
        start, end = joined.rfind(" ", 0, start + 1) + 1, joined.find(" ", end - 1 if end > start else end)
        words = joined[start: end if end >= 0 else len(joined)].split(" ")
        return all(any(near(w, name) for w in words) for name in notice.names)

    def __call__(self, text: bytes) -> dict:
        words = [w for w in self.words(text) if w]
        joined = " ".join(words)
        exact, fuzzy = self.exact(joined), self.fuzzy(joined)
        starts = [w for w, _ in exact]
        base = sorted({label for _, label in exact})
        best = max([1.0] * bool(exact) + [1 - e / max(1, b - a) for _, a, b, e in fuzzy], default=0.0)
        return {
            "n_words": len(words), "n_base": len(exact), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(base), "labels": ",".join(sorted({*base, *(x[0] for x in fuzzy)})), "score": max(0.0, best),
            "spans": [{"label": x[0], "start": x[1], "end": x[2], "errors": x[3]} for x in sorted(fuzzy, key=lambda x: x[1:])],
        }


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


_FIELDS = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
    "spans": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("errors", pa.int32())])),
}
_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:int,end:int,errors:int>>"


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for every row of ``docs``: its key, counts and labels, and the spans of fuzzy matches in its joined words."""

    def make():
        scan = scanner()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [scan(t) for t in text_bytes(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[f] for r in rows], t) for f, t in _FIELDS.items()]], names=[key, *_FIELDS])

        return each

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, F.col(text).cast("string")), f"`{key}` {kind}, {_SCHEMA}", make)
