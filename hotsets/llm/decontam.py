"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotsets.llm.common import bound_batches, handoff, keep_columns, quoted

#: words: runs of digits, letters and anything beyond ASCII, A-Z lower-cased (on UTF-8 bytes)
_TO_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: item words held by one automaton; more items make more automata
AUTOMATON_WORDS = 200_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over word ids: every run of item words is a path from 0.

    ``longest[s]`` is the length of the longest run of state s and ``link[s]`` the state of its
    longest suffix that occurs elsewhere too.  ``items[s]`` has the items in which the runs of s
    occur, kept for the states that hold a run of ``window`` words or a whole shorter item.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        ends: list[list[int]] = [[]]  # items that end a run here, for every position of every item
        for n, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                ends.extend([] for _ in range(len(self.step) - len(ends)))
                ends[last].append(n)
        order = sorted(range(1, len(self.step)), key=self.longest.__getitem__, reverse=True)
        # a state holds runs of window words if its shortest run is no longer than that
        self.items: list[frozenset[int]] = [frozenset()] * len(self.step)
        gathered = [set(e) for e in ends]
        for s in order:
            up = self.link[s]
            if up > 0 and self.longest[up] >= window:  # runs above are of interest too
                gathered[up] |= gathered[s]
            if self.longest[s] >= window > self.longest[up]:
                self.items[s] = frozenset(gathered[s])
        self.names = [str(i) for i, _ in items]
        # whole items of fewer words: the nearest one among the suffixes of each state
        self.short: list[int] = [0] * len(self.step)  # state of the longest whole short item that is a suffix
        self.whole: dict[int, set[int]] = {}
        for n, (_, words) in enumerate(items):
            if 0 < len(words) < window:
                s = 0
                for w in words:
                    s = self.step[s][self.ids[w]]
                self.whole.setdefault(s, set()).add(n)
        for s in reversed(order):
            up = self.link[s]
            self.short[s] = s if s in self.whole else self.short[up] if up > 0 else 0
        # a whole item is its state's longest run only if nothing longer shares the state
        self.whole_length = {s: len(items[next(iter(ns))][1]) for s, ns in self.whole.items()}

    def _extend(self, last: int, c: int) -> int:
        step, link, longest = self.step, self.link, self.longest
        if c in step[last]:  # the run is known from an earlier item
            q = step[last][c]
            return q if longest[last] + 1 == longest[q] else self._clone(last, q, c)
        new = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if longest[p] + 1 == longest[q] else self._clone(p, q, c)
        return new

    def _clone(self, p: int, q: int, c: int) -> int:
        step, link, longest = self.step, self.link, self.longest
        new = len(step)
        step.append(dict(step[q]))
        longest.append(longest[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = new
            p = link[p]
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words (start, end) inside a window's occurrence, and the items concerned.

        The state after each word is the longest run of item words that ends there.
        """
        step, link, longest, window, short = self.step, self.link, self.longest, self.window, self.short
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        state = length = 0
        get = self.ids.get
        for i, w in enumerate(words):
            c = get(w)
            if c is None:
                state = length = 0
                continue
            at = step[state]
            while c not in at and state:
                state = link[state]
                length = longest[state]
                at = step[state]
            if c not in at:
                state = length = 0
                continue
            state = at[c]
            length += 1
            if length >= window:
                spans.append((i + 1 - length, i + 1))
                s = state
                while longest[link[s]] >= window:
                    s = link[s]
                items |= self.items[s]
            s = state
            if short[s]:
                self._short_hits(s, length, i, spans, items)
        return spans, items

    def _short_hits(self, s: int, length: int, i: int, spans: list, items: set) -> None:
        s = self.short[s]
        while s > 0:
            n = self.whole_length[s]
            if n <= length:
                spans.append((i + 1 - n, i + 1))
                items |= self.whole[s]
            up = self.link[s]
            s = self.short[up] if up > 0 else 0


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _automata(benchmark: DataFrame, window: int, per_automaton: int) -> Iterator[SuffixAutomaton]:
    """Automata over all items, each of about ``per_automaton`` words at most.

    The size of the benchmark is measured first; one part of the items at a time reaches the
    driver.
    """
    items = benchmark.select(F.coalesce(quoted("item_id").cast("string"), F.lit("")).alias("item_id"), quoted("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.length("text")).alias("c"), F.count("*").alias("n")).first()
    parts = max(1, -(-(size["c"] or 0) // (2 * per_automaton)))
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        words = [(r["item_id"], w) for r in own if (w := words_of(r["text"]))]
        yield SuffixAutomaton(sorted(words), window)


_FOUND = "struct<n_words:long,spans:array<struct<a:int,b:int>>,items:array<string>,clean:string>"
_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                          ("items", pa.list_(pa.string())), ("clean", pa.string())])


def _scanner(state, cut: bool):
    """Arrow UDF over texts (and what earlier automata found) for one automaton."""

    @F.arrow_udf(_FOUND)
    def scan(text: pa.Array, before: pa.Array) -> pa.Array:
        automaton = SuffixAutomaton.__new__(SuffixAutomaton)
        automaton.__dict__.update(state.value)
        out = []
        for t, old in zip(text, before):
            t, old = t.as_py(), old.as_py() or {"spans": [], "items": []}
            words = words_of(t)
            spans, hit = automaton.scan(words)
            spans = merged(spans + [(x["a"], x["b"]) for x in old["spans"]])
            out.append({"n_words": len(words), "spans": [{"a": x, "b": y} for x, y in spans],
                        "items": sorted({automaton.names[i] for i in hit} | set(old["items"])),
                        "clean": cut_words(t, spans) if cut and spans else None})
        return pa.array(out, _FOUND_ARROW)

    return scan


def with_findings(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10,
                  per_automaton: int = AUTOMATON_WORDS, cut: bool = False) -> DataFrame:
    """``docs`` with ``__found``: ``n_words``, merged hit ``spans`` (of words, end exclusive),
    ``items`` with an occurring window (as strings, sorted), and with ``cut`` the text without
    the spans (NULL where there is none).

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.  A word is hit
    if it lies in an occurrence of ``window`` consecutive words of an item, or of a whole item
    of fewer words.  NULL and empty texts have no words; items without words match nothing; an
    item without id is named by the empty string; repeated items count by their id.  One
    automaton holds a bounded number of item words; a larger benchmark is streamed through in
    parts, each of which adds to the findings so far.  No shuffle, no join.
    """
    bound_batches(docs.sparkSession)
    out = docs.withColumn("__found", F.lit(None).cast(_FOUND))
    for n, automaton in enumerate(_automata(benchmark, window, per_automaton)):
        state = docs.sparkSession.sparkContext.broadcast(automaton.__dict__)
        out = (handoff(out) if n else out).withColumn("__found", _scanner(state, cut)(quoted(text_col).cast("string"), F.col("__found")))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       window: int = 10, per_automaton: int = AUTOMATON_WORDS) -> DataFrame:
    """``doc_id``, ``n_words``, ``spans``, ``items`` of every row (see ``with_findings``)."""
    src = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    found = with_findings(src, benchmark, "text", window, per_automaton)
    return found.select("doc_id", "__found.n_words", "__found.spans", "__found.items")


def n_hit(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])


def cut_words(text: str | None, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them.

    What a span leaves behind is joined by a line break if the span held one at its edge, else
    by a blank.
    """
    places = [m.span() for m in _WORD.finditer(text or "")]
    out, at = [], 0
    for a, b in spans:
        out.append((text[at:places[a][0]]).rstrip(" "))
        at = places[b - 1][1]
    out.append(text[at:].lstrip(" ") if out else text[at:])
    return " ".join(x for x in out if x)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5,
                         per_automaton: int = AUTOMATON_WORDS) -> DataFrame:
    """``docs`` without benchmark passages; the columns stay as they are.

    Every hit span (of ``window`` words or more, or a whole short item) is cut out of the text;
    a document of which hits cover more than ``max_coverage`` of the words goes as a whole.
    Documents without a hit, NULL and empty texts included, stay as they are.
    """
    found = with_findings(docs, benchmark, "text", window, per_automaton, cut=True)
    found = found.where(n_hit(F.col("__found.spans")) <= max_coverage * F.col("__found.n_words"))
    return keep_columns(found.withColumn("text", F.coalesce("__found.clean", "text")), docs.columns)
