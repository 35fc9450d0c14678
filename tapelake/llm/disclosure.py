"""Personal data: patterns, and terms that give protected entities away.

E-mail addresses, IP addresses, card and phone numbers are found by pattern; their values are the protected entities. A term
is a word of four letters or more, anywhere in a document with the entity. Counted over the documents of the whole corpus, its
pointwise mutual information with the entity says how much of the entity's information content it reveals: a term met only
where the entity is reveals all of it. Terms seen with an entity in enough distinct texts (in all of them, if the entity has
fewer) and revealing at least a stated share of it are disclosing. Every occurrence of theirs in a document with the entity,
but for those inside an entity, is marked: terms that reveal all are to be removed, the others generalised.

As a term is with an entity in at most all documents of the entity, its own count bounds what it can reveal. Terms too common
for every entity of their document are left out before entities and terms are paired, which loses no disclosing term.

Null texts count as empty; texts are searched whole; repeated rows give the same spans, and copies of a text lend no support; an empty table gives no
rows; further columns are ignored; a null id stays null. Places are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelake.llm.store import stored

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot begin inside a run of digits: what fails at its start fails further on as well.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\W\d_]{4,}")

#: In how many distinct texts a term must be seen with the entity, or in all of the entity if they are fewer; the share of the
#: entity's information content from which a term counts as disclosing.
SUPPORT, DISCLOSED = 3, 0.9


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: every match has exactly one @, with all that may stand before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        # Before the next @ nothing at or before this one can be part of a local part.
        done = max(done, at + 1)
        at = text.find("@", done)


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind number, entity) in order."""
    out = [(a, b, 0, text[a:b].lower()) for a, b in emails(text)]
    out += [(m.start(), m.end(), 1, m[0]) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), 2, digits))
    for m in _PHONE.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 10 <= len(digits) <= 15:
            out.append((m.start(), m.end(), 3, "+" + digits))
    return sorted(out)


def distinct_terms(text: str) -> set[str]:
    return {w.lower() for w in set(_TERM.findall(text))}


def marks(text: str, spans: list[tuple[int, int]], terms: dict[str, bool]) -> list[tuple[int, int, bool]]:
    """(start, end, remove) of every occurrence of the terms that no span overlaps; spans in order."""
    out, at, covered = [], 0, 0
    for m in _TERM.finditer(text):
        # Up to where the spans that begin before the word's end reach.
        while at < len(spans) and spans[at][0] < m.end():
            covered = max(covered, spans[at][1])
            at += 1
        if m.start() >= covered and (remove := terms.get(m[0].lower())) is not None:
            out.append((m.start(), m.end(), remove))
    return out


_FOUND = "spans array<struct<start:bigint,end:bigint,kind:int>>, entities array<string>, held string"
_TERMS = "array<struct<start:bigint,end:bigint,remove:boolean>>"


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: _row, doc_id, text_id, its pattern spans, its entities, and the text if there are any."""
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, entities, held = [], [], []
            for t in batch.column(2).to_pylist():
                hits = base_spans(t or "")
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k, _ in hits])
                entities.append(sorted({f"{KINDS[k]}:{v}" for _, _, k, v in hits}))
                held.append(t if hits else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, span_type), pa.array(entities, pa.list_(pa.string())), pa.array(held, pa.string())],
                names=["doc_id", "text_id", "spans", "entities", "held"])

    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_id"), F.col(text).alias("text"))
    rows = rows.mapInArrow(search, f"doc_id {kind}, text_id bigint, {_FOUND}")
    return stored(rows.withColumn("_row", F.monotonically_increasing_id()), "disclosure-found")


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n_term): the number of documents with each term, counted by batches before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                n.update(distinct_terms(t or ""))
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["term", "n"])

    counts = docs.select(F.col(text).alias("text")).mapInArrow(count, "term string, n bigint")
    return stored(counts.groupBy("term").agg(F.sum("n").alias("n_term")), "disclosure-terms")


def together(docs: DataFrame, rows: DataFrame, support: int = SUPPORT, share: float = DISCLOSED, text: str = "text") -> DataFrame:
    """(_row, text_id, entity, term) with counts: the terms beside each entity of a row that may reveal the share of it.

    ``rows`` is what ``found`` made of ``docs``. Probabilities are shares of documents; ``needed`` counts distinct texts.
    """
    each = rows.select("_row", "text_id", F.explode("entities").alias("entity"))
    texts = each.groupBy("entity", "text_id").agg(F.count(F.lit(1)).alias("n"))
    entities = texts.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.least(F.count(F.lit(1)), F.lit(support)).alias("needed"))
    # One row: the number of documents. An entity in every document has no information to give away.
    entities = entities.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n_docs")))).filter(F.col("n_entity") < F.col("n_docs"))
    most = F.col("n_docs") * F.pow(F.col("n_entity") / F.col("n_docs"), F.lit(share)) * (1 + 1e-9)
    entities = stored(entities.withColumn("most", most), "disclosure-entities")
    held = stored(each.join(entities, "entity"), "disclosure-held")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [list(distinct_terms(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], names=["_row", "terms"])

    words = rows.filter(F.col("held").isNotNull()).select("_row", "held").mapInArrow(split, "_row bigint, terms array<string>")
    words = words.select("_row", F.explode("terms").alias("term")).join(term_counts(docs, text), "term")
    rare = words.join(held.groupBy("_row").agg(F.max("most").alias("_most")), "_row").filter(F.col("n_term") <= F.col("_most"))
    rare = stored(rare.drop("_most"), "disclosure-rare")
    return rare.join(held, "_row").filter(F.col("n_term") <= F.col("most"))


def disclosing_terms(pairs: DataFrame, share: float = DISCLOSED) -> DataFrame:
    """(entity, term, revealed): terms that give at least the share of the entity's information away."""
    of = ["entity", "term", "n_entity", "n_term", "n_docs", "needed"]
    joint = pairs.groupBy(*of, "text_id").agg(F.count(F.lit(1)).alias("n"))
    joint = joint.groupBy(*of).agg(F.sum("n").alias("n_joint"), F.count(F.lit(1)).alias("n_texts")).filter(F.col("n_texts") >= F.col("needed"))
    information = F.log2(F.col("n_docs") / F.col("n_entity"))
    mutual = F.log2(F.col("n_joint") * F.col("n_docs") / (F.col("n_term") * F.col("n_entity")))
    scored = joint.withColumn("revealed", mutual / information).filter(F.col("revealed") >= share)
    return stored(scored.select("entity", "term", "revealed"), "disclosure-pairs")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, ``spans`` (pattern spans) and ``terms`` (start, end, whether to remove rather than generalise)."""
    rows = found(docs)
    pairs = together(docs, rows)
    told = pairs.select("_row", "entity", "term").join(disclosing_terms(pairs), ["entity", "term"])
    told = told.groupBy("_row", "term").agg((F.max("revealed") >= 1).alias("remove"))
    told = told.groupBy("_row").agg(F.collect_list(F.struct("term", "remove")).alias("told"))

    @F.udf(_TERMS)
    def places(text: str, spans: list, told: list) -> list:
        return marks(text, [(x.start, x.end) for x in spans], {x.term: x.remove for x in told})

    terms = rows.select("_row", "held", "spans").join(told, "_row").select("_row", places("held", "spans", "told").alias("terms"))
    out = rows.select("_row", "doc_id", "spans").join(terms, "_row", "left")
    return out.select("doc_id", "spans", F.coalesce("terms", F.array().cast(_TERMS)).alias("terms"))


def masked(text: str, spans: list[tuple[int, int, int]], terms: list[tuple[int, int, bool]]) -> str:
    """The text with patterns replaced by their kind, removed terms left out and generalised ones cut to a placeholder."""
    changes = sorted([(a, b, f"[{KINDS[k]}]") for a, b, k in spans] + [(a, b, "" if gone else "[word]") for a, b, gone in terms])
    out, done = [], 0
    for a, b, new in changes:
        if a >= done:
            out += [text[done:a], new]
        done = max(done, b)
    return "".join([*out, text[done:]])


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their text masked. The id must tell rows apart."""
    mask = F.udf(lambda t, spans, terms: t and masked(t, [tuple(x) for x in spans or ()], [tuple(x) for x in terms or ()]))
    spans = personal_data(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select(
        F.col("doc_id").alias("_id"), F.col("spans").alias("_spans"), F.col("terms").alias("_terms"))
    out = docs.join(spans, F.col(doc_id) == F.col("_id"), "left").withColumn(text, mask(text, "_spans", "_terms"))
    return out.select(*docs.columns)


def digests(rows: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the pattern spans and the list of all spans."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    term = F.lit(len(KINDS) - 1)
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    ordered = lambda xs: F.array_sort(F.transform(xs, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    extra = F.transform("terms", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), term.alias("kind")))
    counts = [F.size(F.array_remove(F.transform("spans", lambda x: x["kind"]), k)) for k in range(4)]
    counts = [(F.size("spans") - n).cast("long").alias(f"n_{KINDS[k]}") for k, n in enumerate(counts)]
    return rows.select("doc_id", *counts, F.sha2(text(ordered(F.col("spans"))), 256).alias("base_sha256"),
                       text(ordered(F.concat("spans", extra))).alias("spans"))
