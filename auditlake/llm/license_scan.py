"""License scans with a generalised suffix automaton of licence tokens."""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import arrow_columns, field, fresh, utf8, words
from auditlake.llm.license_texts import LICENSES

#: Base phrases: every place where their words stand consecutively counts.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Words of the templates that an automaton may hold, some hundred bytes each; a larger library is refused, not cut.
LIBRARY_WORDS = 200_000
MIN_MATCH, MAX_GAP, COVERAGE = 3, 4, 0.8


@dataclass
class Automaton:
    """States 0.. (0 is the start): step[s][word] -> state, link, length; ends[s]: {template: ends of all places of what s
    spells}, for what is MIN_MATCH words or longer; near[s]: for each template that holds a suffix of MIN_MATCH words or
    more of what s spells, (template, state of its longest one); phrases[s]: (phrase, words) that are suffixes of it."""

    step: list[dict] = dc_field(default_factory=lambda: [{}])
    link: list[int] = dc_field(default_factory=lambda: [-1])
    length: list[int] = dc_field(default_factory=lambda: [0])
    ends: list[dict] = dc_field(default_factory=lambda: [{}])
    near: list[list] = dc_field(default_factory=list)
    phrases: list[list] = dc_field(default_factory=list)

    def _new(self, length: int, step: dict, link: int) -> int:
        self.step.append(step), self.length.append(length), self.link.append(link), self.ends.append({})
        return len(self.step) - 1

    def _split(self, p: int, c, q: int) -> int:
        """A copy of q for the strings that reach it through p."""
        clone = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, c) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new


def build(templates: list[list[bytes]], phrases: list[list[bytes]]) -> Automaton:
    """The automaton of all substrings of the templates; phrases must be among them."""
    a = Automaton()
    for t in templates:
        last = 0
        for c in t:
            last = a.extend(last, c)
    for k, t in enumerate(templates):  # each prefix's state and the states of its suffixes get the place
        s = 0
        for i, c in enumerate(t):
            s = a.step[s][c]
            x = s
            while a.length[x] >= MIN_MATCH:
                a.ends[x].setdefault(k, []).append(i + 1)
                x = a.link[x]
    for s in range(len(a.step)):
        found, x = {}, s
        while a.length[x] >= MIN_MATCH:
            for k in a.ends[x]:
                found.setdefault(k, x)
            x = a.link[x]
        a.near.append(list(found.items()))
    home = {}
    for k, p in enumerate(phrases):
        s = 0
        for c in p:
            s = a.step[s][c]
        home.setdefault(s, []).append((k, len(p)))
    for s in range(len(a.step)):
        got, x = [], s
        while x > 0:
            got += home.get(x, [])
            x = a.link[x]
        a.phrases.append(got)
    return a


def scan(w: list[bytes], a: Automaton, vocabulary: frozenset):
    """(phrase, start) of each phrase place, and for each template with long matches (words covered, first word, word after
    the last) of its best chain.

    At each word the automaton holds the longest suffix that some template contains; its suffix links give each template's
    own longest one, of MIN_MATCH words or more. A template's match is as long as it gets where the next word doesn't
    lengthen it. Words outside the vocabulary only reset the automaton, so they are skipped.
    """
    places, matches, now = [], {}, {}
    step, link, length, outs, near = a.step, a.link, a.length, a.phrases, a.near
    s = l = 0
    before = -2

    def close(end: int, held: dict, grown: dict) -> None:
        for k, (x, n) in held.items():
            if grown.get(k, (0, 0))[1] != n + 1:
                matches.setdefault(k, []).append((end, n, a.ends[x][k]))

    for i in [i for i, x in enumerate(w) if x in vocabulary]:
        if i != before + 1 and l:
            close(before + 1, now, {})
            s = l = 0
            now = {}
        c = w[i]
        while s and c not in step[s]:
            s = link[s]
            l = length[s]
        if c in step[s]:
            s, l = step[s][c], l + 1
        if now or l >= MIN_MATCH:
            # what s spells may be longer than the l words held, but is then cut to them
            grown = {k: (x, min(l, length[x])) for k, x in near[s] if l >= MIN_MATCH}
            close(i, now, grown)
            now = grown
        for k, n in outs[s]:
            if l >= n:
                places.append((k, i + 1 - n))
        before = i
    close(before + 1, now, {})
    return places, {k: best_chain(m) for k, m in matches.items()}


def best_chain(matches: list[tuple[int, int, list[int]]]) -> tuple[int, int, int]:
    """(words covered, first word, word after the last) of the chain that covers most of a template; of equals the first.

    matches: (end in the document, words, ends in the template), by end. In a chain both ends grow, and a match starts at
    most MAX_GAP words after the one before it ends; what overlaps counts once. Only matches that end close enough before
    are looked at.
    """
    links: list[tuple[int, int, int, int]] = []  # ends in document and template, covered, start
    best, first = (0, 0, 0), 0
    for end, n, places in matches:
        while first < len(links) and links[first][0] < end - n - MAX_GAP:
            first += 1
        made = []
        for p in places:
            most, start = n, end - n
            for d, t, covered, since in links[first:]:
                more = min(n, end - d, p - t)
                if more > 0 and (covered + more, -since) > (most, -start):
                    most, start = covered + more, since
            made.append((end, p, most, start))
            if most > best[0]:
                best = (most, start, end)
        links += made
    return best


def library_of(templates) -> list[tuple[str, list[bytes]]]:
    """(label, words) of a list of (label, text), or of a table with these columns, which is read to the driver: it is
    refused if it has more than LIBRARY_WORDS words. Rows without label or words are left out."""
    if isinstance(templates, DataFrame):
        chosen = templates.select("label", "text").where("label is not null and text is not null")
        size = chosen.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
        if size > LIBRARY_WORDS:
            raise ValueError(f"{size} words of licence texts; at most {LIBRARY_WORDS} fit in an automaton")
        templates = [(r.label, r.text) for r in chosen.orderBy("label", "text").collect()]
    known = [(label, words(text.encode())) for label, text in templates]
    if sum(len(w) for _, w in known) > LIBRARY_WORDS:
        raise ValueError(f"more than {LIBRARY_WORDS} words of licence texts don't fit in an automaton")
    return [(label, w) for label, w in known if w]


def scan_licenses(docs: DataFrame, text: str = "text", phrases=PHRASES, templates=LICENSES, drop: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score, spans, and those columns' names.

    templates: (label, text) pairs or a table of them (library_of). Documents are streamed, not shuffled, through one
    automaton of the phrases and templates, whose size is the library's. Each template's matches of MIN_MATCH words or
    more, at all their places in it, are chained (best_chain); a chain that covers COVERAGE of a template labels the
    document. score is the largest covered share; a whole phrase counts as 1. spans: label, first word, word after the
    last and share of the chains that label, by place. Null texts are empty: no words, no labels, score 0. Repeated rows
    each come back; an empty table gives none.
    """
    names = {k: fresh(docs, k) for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
    span = T.ArrayType(T.StructType([field("label", T.StringType()), field("start", T.LongType()), field("end", T.LongType()), field("share", T.DoubleType())]))
    kinds = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.DoubleType(), span]
    library = library_of(templates)
    known = [w for _, w in library] + [p.encode().split() for p, _ in phrases]
    automaton = build(known, known[len(library) :])
    vocabulary = frozenset(chain.from_iterable(known))
    shared = docs.sparkSession.sparkContext.broadcast((automaton, vocabulary, [label for label, _ in library], [len(w) for w in known]))

    def make(batch):
        a, vocab, labels, sizes = shared.value
        out = [[] for _ in kinds]
        for t in utf8(batch.column(batch.schema.get_field_index(text))):
            w = words(t)
            places, best = scan(w, a, vocab)
            base = sorted({phrases[k][1] for k, _ in places})
            chains = [(start, end, labels[k], min(1.0, covered / sizes[k])) for k, (covered, start, end) in best.items() if k < len(labels)]
            told = sorted(c for c in chains if c[3] >= COVERAGE)
            starts = [s for _, s in places]
            score = 1.0 if places else max((c[3] for c in chains), default=0.0)
            spans = [{"label": label, "start": start, "end": end, "share": share} for start, end, label, share in told]
            row = (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *(c[2] for c in told)})), score, spans)
            for column, x in zip(out, row):
                column.append(x)
        return out

    return arrow_columns(docs, make, [field(x, k) for x, k in zip(names.values(), kinds)], drop=drop), names


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), drop=("text",))[0].drop("spans")
