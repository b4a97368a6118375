"""License scans with a generalised suffix automaton over licence tokens.

The automaton holds every run of words of all templates. A file's words stream through it:
at each word it knows the longest run, ending there, that some template contains (the
matching statistics). Maximal runs of `LEAST` words or more become anchors. For every
template the best chain of anchors is found, that go forward in both text and template with
small gaps: each anchor is linked to the best of the few that end shortly before it. A
chain's worth is what it covers less what it lacks: template words left out, and text words
between its anchors. Chains are taken from the worthiest down, and one that overlaps a
taken chain goes: so of sibling licences (BSD of two or three clauses, GPL versions, CC
licences) the one that fits a passage best wins it. A template may name phrases of which
one must stand in the span; without it the sibling isn't told, and the span gets no label.

Words outside the templates' vocabulary reset the automaton, so runs without them are all
that is walked.

Defined results: a null text counts as empty: no words, no labels, score 0; repeated rows
are scanned each; null ids pass through; of chains of equal worth the earlier one wins, and
at one place the template listed first; texts of any length are scanned whole, in time in
proportion to them; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_ALNUM, binary, map_batches, process_cache, table
from .licence_texts import FAMILIES, TEMPLATES, Template

#: Phrases that label a file by themselves.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Words of a match that can anchor a span, words between anchors of a span, and the cover that labels.
LEAST = 4
GAP = 12
COVER = 0.6
COVER_WORDS = 24


def words(text: bytes) -> list[bytes]:
    return text.translate(LOWER_ALNUM).split()


class Span(NamedTuple):
    """Words first..last of the text match `covered` words of a template."""

    label: str
    template: int
    first: int
    last: int
    covered: int
    share: float
    worth: int = 0


def labels(s: Span) -> bool:
    """Whether a span covers enough to label the text."""
    return s.share >= COVER or s.covered >= COVER_WORDS


class Link(NamedTuple):
    """A chain of anchors: it ends at `end`, begins at `first`, covers so many words and leaves so many between."""

    end: int
    first: int
    covered: int
    between: int


class Automaton:
    """Suffix automaton of all templates; a state knows where in the templates its runs end."""

    def __init__(self, templates: list[list[bytes]]):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, tokens in enumerate(templates):
            last = 0
            for at, token in enumerate(tokens):
                last = self.extend(last, self.ids.setdefault(token, len(self.ids)))
                self.ends[last].add((t, at))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]

    def add(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def split(self, parent: int, token: int, state: int) -> int:
        """A copy of `state` for the runs no longer than the parent's plus one."""
        twin = self.add(self.length[parent] + 1, dict(self.next[state]), self.link[state])
        self.link[state] = twin
        while parent >= 0 and self.next[parent].get(token) == state:
            self.next[parent][token] = twin
            parent = self.link[parent]
        return twin

    def extend(self, last: int, token: int) -> int:
        known = self.next[last].get(token)
        if known is not None:  # another template has this run already
            return known if self.length[known] == self.length[last] + 1 else self.split(last, token, known)
        new = self.add(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = new
            at = self.link[at]
        if at >= 0:
            state = self.next[at][token]
            self.link[new] = state if self.length[state] == self.length[at] + 1 else self.split(at, token, state)
        return new

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest known run that ends at each id."""
        state = length = 0
        for x in ids:
            while state and x not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            to = self.next[state].get(x)
            if to is None:
                state = length = 0
            else:
                state, length = to, length + 1
            yield state, length

    def anchors(self, ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
        """(end, state, length) of every maximal run of `least` words or more; -1 stands for unknown words."""
        known = np.concatenate([[False], ids >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        out = []
        for lo, hi in edges.reshape(-1, 2).tolist():
            if hi - lo < least:
                continue
            seen = list(self.statistics(ids[lo:hi].tolist()))
            for i, (state, length) in enumerate(seen):
                if length >= least and (i + 1 == len(seen) or seen[i + 1][1] <= length):
                    out.append((lo + i, state, length))
        return out


class Scanner:
    """Finds phrases and template spans in a text."""

    def __init__(self, templates: list[Template] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.labels = [t.label for t in templates]
        self.tokens = [words(t.text.encode()) for t in templates]
        self.needs = [[b" " + b" ".join(words(n.encode())) + b" " for n in t.needs] for t in templates]
        self.automaton = Automaton(self.tokens)
        self.cached: dict[int, list[tuple[int, int, int]]] = {}
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]

    def base(self, parts: list[bytes]) -> list[tuple[int, str]]:
        """(first word, label) of every place of a phrase."""
        line = b" " + b" ".join(parts) + b" "
        out = []
        for phrase, label in self.phrases:
            at, seen, word = line.find(phrase), 0, 0
            while at >= 0:
                word += line.count(b" ", seen, at)  # blanks are counted on from the last place
                seen = at
                out.append((word, label))
                at = line.find(phrase, at + 1)
        return sorted(out)

    def places(self, state: int) -> list[tuple[int, int, int]]:
        """(template, last word there, most words) of all runs of LEAST words or more that end where the state's do."""
        if state not in self.cached:
            auto, made, seen = self.automaton, [], set()
            at = state
            while at > 0 and auto.length[at] >= LEAST:
                made += [(t, e, auto.length[at]) for t, e in sorted(auto.ends[at] - seen)]
                seen |= auto.ends[at]
                at = auto.link[at]
            self.cached[state] = made
        return self.cached[state]

    def chains(self, found: list[tuple[int, int, int]]) -> Iterator[Span]:
        """The best chain of each template's anchors, cut where a gap is too wide, in the order of their ends."""
        # per template and place in it: the best chain that ends there, as (end, place, first word, covered, words between)
        open_: dict[int, dict[int, Link]] = {}
        best: dict[int, Link] = {}

        def worth(t: int, link: Link) -> int:
            return 2 * link.covered - len(self.tokens[t]) - link.between

        def span(t: int) -> Span:
            link = best[t]
            return Span(self.labels[t], t, link.first, link.end, link.covered, link.covered / len(self.tokens[t]), worth(t, link))

        for end, state, run in found:
            for t in [t for t, links in open_.items() if end - run + 1 - max(x.end for x in links.values()) > GAP + 1]:
                yield span(t)
                del open_[t], best[t]
            for t, at, most in self.places(state):
                length = min(run, most)
                start = end - length + 1
                links = open_.setdefault(t, {})
                made = Link(end, start, length, 0)
                for p in [p for p, x in links.items() if start - x.end > GAP + 1]:
                    del links[p]
                for p, x in links.items():
                    fresh = min(length, end - x.end, at - p)
                    if fresh > 0 and at - length - p <= GAP:
                        longer = Link(end, x.first, x.covered + fresh, x.between + max(0, start - x.end - 1))
                        if worth(t, longer) > worth(t, made):
                            made = longer
                old = links.get(at)
                if old is None or worth(t, made) >= worth(t, old) - (end - old.end):
                    links[at] = made
                if t in best and made.first > best[t].end:  # the text begins the template anew
                    yield span(t)
                    best[t] = made
                elif t not in best or worth(t, made) > worth(t, best[t]):
                    best[t] = made
        for t in best:
            yield span(t)

    def spans(self, parts: list[bytes]) -> list[Span]:
        """Chains that overlap no worthier one, from left to right; those whose sibling isn't told are left out."""
        get = self.automaton.ids.get
        found = self.automaton.anchors(np.array([get(w, -1) for w in parts], np.int64))
        out: list[Span] = []
        run: list[Span] = []
        reach = -1

        def settle() -> None:
            """Of chains that overlap in a row, the worthiest first, and those that label before all others."""
            taken: list[Span] = []
            for s in sorted(run, key=lambda s: (not labels(s), -s.worth, s.first, s.template)):
                k = bisect.bisect(taken, s.first, key=lambda o: o.first)
                free = (not k or taken[k - 1].last < s.first) and (k == len(taken) or s.last < taken[k].first)
                if free and self.told(s, parts):
                    taken.insert(k, self.settled(s, run))
            out.extend(taken)

        for s in sorted(self.chains(found), key=lambda s: (s.first, s.last, s.template)):
            if s.first > reach:
                settle()
                run = []
            run.append(s)
            reach = max(reach, s.last)
        settle()
        return out

    def settled(self, s: Span, run: list[Span]) -> Span:
        """The span under its family's label, if a sibling's words fit there as well; a template that needs a phrase has told itself."""
        family = FAMILIES.get(s.label)
        if not family or self.needs[s.template]:
            return s
        fit: dict[str, float] = {}  # what each sibling covers of the span, over all its templates
        for o in run:
            both = min(o.last, s.last) - max(o.first, s.first) + 1
            if both > 0 and o.label != s.label and FAMILIES.get(o.label) == family and not self.needs[o.template]:
                fit[o.label] = fit.get(o.label, 0.0) + o.covered * both / (o.last - o.first + 1)
        return s._replace(label=family) if any(x > s.covered - 1 for x in fit.values()) else s

    def told(self, s: Span, parts: list[bytes]) -> bool:
        """Whether one of the phrases that tell the template from its siblings stands in the span."""
        needs = self.needs[s.template]
        if not needs:
            return True
        line = b" " + b" ".join(parts[s.first : s.last + 1]) + b" "
        return any(n in line for n in needs)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[Span], float]:
        """Words, phrase places, labelling spans, and the best share of a template covered."""
        parts = words(text)
        base = self.base(parts)
        every = self.spans(parts)
        spans = [s for s in every if labels(s)]
        return len(parts), base, spans, 1.0 if base else max((min(1.0, s.share) for s in every), default=0.0)


def scan(docs: DataFrame) -> DataFrame:
    """The digest of every row plus `spans`: the label and first and last word of each covered template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = process_cache("licenses")
        scanner = cache.get("scanner") or cache.setdefault("scanner", Scanner())
        for b in batches:
            rows = []
            for t in binary(b.column("text")):
                n, base, spans, score = scanner.scan(t or b"")
                own = {label for _, label in base}
                rows.append(
                    (
                        n,
                        len(base),
                        base[0][0] if base else None,
                        base[-1][0] if base else None,
                        ",".join(sorted(own)),
                        ",".join(sorted(own | {s.label for s in spans})),
                        score,
                        " ".join(f"{s.label}:{s.first}-{s.last}" for s in spans),
                    )
                )
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made], names=names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, spans string"
    )
    return map_batches(docs, [F.col("doc_id"), F.col("text")], run, schema)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans of every document."""
    return scan(table(spark, sf_dir, "documents"))
