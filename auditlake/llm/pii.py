"""Personal data: pattern spans, and terms that reveal the entities they stand near (information-theoretic sanitisation)."""

from __future__ import annotations

import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import arrow_columns, bounded_batches, byte_slices, durable, field, fresh, strings, utf8, words

KINDS = ["email", "ip", "card", "phone", "term"]
#: Words on either side of an entity that count as its context, and the characters that are looked at for them.
CONTEXT_WORDS, CONTEXT_CHARS = 8, 160
#: A term is disclosing if it stands near the entity in at least SUPPORT different contexts, at least SHARE of the
#: documents that hold it do so, and that tells at least BITS bits about the entity.
SUPPORT, SHARE, BITS = 3, 0.75, 5.0
#: Terms that a task holds at once, and the shortest prefix that a term is generalised to.
BLOCK_TERMS, LEAST_PREFIX = 200_000, 3

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches found from each @: the local part is the run before it, no further back than the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of emails, ip addresses, cards and phones, by start, then kind. Linear in the text's length."""
    out = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):  # int() takes no more than 4,300 digits
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(text: str, span: tuple[int, int, int]) -> int:
    """A hash of the span's kind and value, letters lower-cased and numbers without separators."""
    start, kind, end = span
    value = text[start:end].lower()
    value = re.sub(r"[^0-9]", "", value) if kind > 1 else value
    return xxhash.xxh64_intdigest(f"{kind}:{value}".encode()) - (1 << 63)


def contexts(text: str, spans: list[tuple[int, int, int]]):
    """(entity, context hash, words near it), without words of the spans themselves."""
    covered = list(text)  # spans are blanked, so none is another's context
    for a, _, b in spans:
        covered[a:b] = " " * (b - a)
    blank = "".join(covered)
    for span in spans:
        a, _, b = span
        before = words(blank[max(0, a - CONTEXT_CHARS) : a].encode())
        before = (before[1:] if a > CONTEXT_CHARS else before)[-CONTEXT_WORDS:]
        after = words(blank[b : b + CONTEXT_CHARS].encode())
        after = (after[:-1] if b + CONTEXT_CHARS < len(blank) else after)[:CONTEXT_WORDS]
        mark = xxhash.xxh64_intdigest(b" ".join(before[-2:] + [b"|"] + after[:2])) - (1 << 63)
        yield entity(text, span), mark, {*before, *after}


def _neighbours(batches):
    """(term, entity, context, first): first is 1 once a document and (term, entity). The term '' stands for the entity."""
    import pyarrow as pa

    for batch in (part for whole in batches for part in byte_slices(whole)):
        rows = []
        for t in strings(batch.column(0)):
            spans = base_spans(t) if t else []
            seen = set()
            for e, mark, near in contexts(t, spans) if spans else ():
                for w in (b"", *near):
                    rows.append((w, e, mark, int((w, e) not in seen)))
                    seen.add((w, e))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((),) * 4, (pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["term", "entity", "context", "first"])


def disclosing_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, bits, general): terms that reveal a protected entity, from counts over all documents, and what they are
    generalised to: the longest prefix, of LEAST_PREFIX bytes or more, that so many documents hold that even all of the
    entity's would be less than SHARE of them; null where none is that common, then the term is removed.

    Pairs of term and entity are combined before the shuffle; pairs without SUPPORT contexts go first. The documents
    that hold the remaining terms, and those that hold the prefixes of disclosing ones, are counted in further passes,
    again combined within each task.
    """
    bounded_batches(docs.sparkSession)
    pairs = docs.select(text).mapInArrow(_neighbours, "term binary, entity long, context long, first long")
    pairs = pairs.groupBy("term", "entity", "context").agg(F.sum("first").alias("n"))
    pairs = durable(pairs.groupBy("term", "entity").agg(F.sum("n").alias("near"), F.count("*").alias("contexts")))
    entities = pairs.where("term = X''").select("entity", F.col("near").alias("held"))
    close = durable(pairs.where(f"term != X'' and contexts >= {SUPPORT}"))
    wanted = _bounded(close.select("term").distinct())
    if wanted is not None and not wanted:
        return close.select("term", F.lit(0.0).alias("bits"), F.lit(None).cast("binary").alias("general"))
    held = durable(_document_counts(docs, text, wanted))
    total = held.where("term = X''").first()["docs"]
    share = F.col("near") / F.col("docs")
    told = durable(
        close.join(held, "term")
        .join(entities, "entity")
        .withColumn("bits", F.log2(share / (F.col("held") / F.lit(float(total)))))
        .where((share >= SHARE) & (F.col("bits") >= BITS))
        .groupBy("term")
        .agg(F.max("bits").alias("bits"), F.max("held").alias("held"))
    )
    sizes = F.sequence(F.lit(LEAST_PREFIX), F.octet_length("term") - 1)
    cut = told.where(F.octet_length("term") > LEAST_PREFIX).select("term", "held", F.explode(F.transform(sizes, lambda n: F.substring(F.col("term"), F.lit(1), n))).alias("prefix"))
    prefixes = _bounded(cut.select(F.col("prefix").alias("term")).distinct())
    if prefixes is not None and not prefixes:
        return told.select("term", "bits", F.lit(None).cast("binary").alias("general"))
    common = _document_counts(docs, text, prefixes, prefix=True).where("term != X''")
    general = cut.join(common.select(F.col("term").alias("prefix"), "docs"), "prefix").where(F.col("held") < F.col("docs") * SHARE)
    return told.join(general.groupBy("term").agg(F.max_by("prefix", F.octet_length("prefix")).alias("general")), "term", "left").select("term", "bits", "general")


def _bounded(terms: DataFrame) -> frozenset | None:
    """The terms, if they are BLOCK_TERMS at most; else None, which stands for all."""
    got = [bytes(r[0]) for r in terms.limit(BLOCK_TERMS + 1).collect()]
    return frozenset(got) if len(got) <= BLOCK_TERMS else None


def _document_counts(docs: DataFrame, text: str, wanted: frozenset | None, prefix: bool = False) -> DataFrame:
    """(term, docs): documents that hold each wanted term (None: each term), or a term with each wanted prefix; the term ''
    stands for all documents. A task sends its counts on when it holds BLOCK_TERMS of them."""
    known = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches):
        import pyarrow as pa

        schema = pa.schema([("term", pa.binary()), ("docs", pa.int64())])
        seen, only = Counter(), known.value
        starts = {p[:LEAST_PREFIX] for p in only} if prefix and only is not None else None
        for batch in (part for whole in batches for part in byte_slices(whole)):
            for t in utf8(batch.column(0)):
                held = set(words(t))
                if prefix:
                    held = {w[:n] for w in held if starts is None or w[:LEAST_PREFIX] in starts for n in range(LEAST_PREFIX, len(w) + 1)}
                seen.update(held if only is None else only.intersection(held))
                seen[b""] += 1
            if len(seen) > BLOCK_TERMS:
                yield pa.RecordBatch.from_pydict({"term": list(seen), "docs": list(seen.values())}, schema=schema)
                seen.clear()
        yield pa.RecordBatch.from_pydict({"term": list(seen), "docs": list(seen.values())}, schema=schema)

    return docs.select(text).mapInArrow(count, "term binary, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


def term_spans(text: str, base: list[tuple[int, int, int]], terms) -> list[tuple[int, int, int]]:
    """Spans of the text's words that are among `terms` (lower-cased text), outside of the base spans; both lists are walked
    once."""
    out, at, end = [], 0, 0
    base = sorted((a, b) for a, _, b in base)
    for m in _TERM.finditer(text.translate(_LOWER)):
        if m[0] not in terms:
            continue
        while at < len(base) and base[at][0] < m.end():  # all that start before the word ends: the furthest end counts
            end = max(end, base[at][1])
            at += 1
        if end <= m.start():
            out.append((m.start(), 4, m.end()))
    return out


def find_personal_data(docs: DataFrame, text: str = "text", clean: bool = False, drop: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """docs with spans (start, kind, end; kind indexes KINDS; code points, by start, then kind) and, if asked for,
    `clean`: the text with entities generalised to their kind's name, and disclosing terms to their common prefix and *
    or, without one, removed; and the names.

    Base spans always stay. Terms are looked for outside of them, in every document. Null texts have no spans and clean
    null; empty ones stay empty. Repeated rows each come back. Disclosing terms go to the documents in blocks of bounded
    size; no document is shuffled.
    """
    spark, terms = docs.sparkSession, durable(disclosing_terms(docs, text).select("term", "general"))
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    names = {"spans": fresh(docs, "spans")} | ({"clean": fresh(docs, "clean")} if clean else {})
    kind = T.ArrayType(T.ArrayType(T.LongType()))
    out = docs
    told = fresh(docs, "_told")  # what each term span becomes, carried from block to block
    for b in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b).collect()  # bounded
        mine = {bytes(r.term).decode("utf-8", "replace"): bytes(r.general).decode("utf-8", "ignore") if r.general is not None else "" for r in rows}
        shared, last = spark.sparkContext.broadcast(mine), b == blocks - 1

        def make(batch, shared=shared, b=b, last=last):
            at = batch.schema.get_field_index
            texts = strings(batch.column(at(text)))
            before = batch.column(at(names["spans"])).to_pylist() if b else None
            carried = batch.column(at(told)).to_pylist() if b else None
            spans, become = [], []
            for i, t in enumerate(texts):
                got = base_spans(t) if t and not b else [tuple(s) for s in before[i]] if b else []
                forms = dict(carried[i]) if b else {}
                if t and shared.value:
                    more = term_spans(t, [s for s in got if s[1] < 4], shared.value)
                    forms |= {a: shared.value[t[a:e].translate(_LOWER)] for a, _, e in more}
                    got = sorted([*got, *more])
                spans.append(got)
                become.append(forms)
            made = [spans]
            if clean and last:
                made.append([sanitised(t, s, f) for t, s, f in zip(texts, spans, become)])
            if not last:
                made.append([list(f.items()) for f in become])
            return made

        fields = [field(names["spans"], kind)] + ([field(names["clean"], T.StringType())] if clean and last else []) + ([] if last else [field(told, T.MapType(T.LongType(), T.StringType()))])
        out = arrow_columns(out, make, fields, drop=(*((names["spans"], told) if b else ()), *(drop if last else ())))
    return out, names


def sanitised(text: str | None, spans, general: dict[int, str]) -> str | None:
    """The text with each span replaced: entities by their kind, terms by what `general` has for their start."""
    if text is None:
        return None
    out, done = [], 0
    for a, kind, b in spans:
        if b <= done:
            continue
        form = general.get(a, "")
        out += [text[done : max(a, done)], (f"{form}*" if form else "") if kind == 4 else f"<{KINDS[kind].upper()}>"]
        done = b
    return "".join([*out, text[done:]])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), drop=("text",))
    names = F.array(*map(F.lit, KINDS))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, (s[1] + 1).cast("int")), s[0].cast("string"), s[2].cast("string"))), ",")
    base = F.filter("spans", lambda s: s[1] < 4)
    of = lambda k: F.filter("spans", lambda s: s[1] == k)  # noqa: E731 (a second argument would be the element's index)
    n = [F.size(of(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select("doc_id", *n, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
