"""Information-theoretic sanitisation of personal data.

Base spans are emails, ip addresses, payment cards and phone numbers, found in every whole text. The values found are
the protected entities, and with each value the wider ones that it belongs to (see ``levels``): an email's domain and local part,
an address block, a card's issuer, a phone's dialling code. Over the whole corpus, a term t discloses an entity e
by the share of e's information that it gives away,

    PMI(e; t) / IC(e) = log(P(e, t) / (P(e) P(t))) / -log P(e),

with document counts as estimates: 1 where t occurs only together with e, about 0 where t says nothing of e. An estimate
counts only where the corpus supports it: at least ``SUPPORT`` different texts hold both e and t (copies of one text prove no more
than it does; an entity of a single text is covered by its levels, if at all), and e is in at least ``CONFIDENCE`` of the texts
that hold t, as otherwise most of them would be changed for an entity that they have nothing to do with. Then terms at or above
``GENERALISE`` become a word that only tells their kind, and terms at or above ``REMOVE`` are removed, in every text
that has them: where e itself is not named they are what gives it away. Base spans are replaced by their kind.

Only the terms of texts with base spans are stored, once for each distinct text. A term can only reach
``GENERALISE`` if it is rare enough for the most frequent supported entity of its text (``_reach``), so the others are dropped before they
are shuffled: those in very many texts by a broadcast of at most ``MAX_FREQUENT`` terms, the rest where they meet
their counts. Entities meet their counts in several tasks each; all other groups are bounded by a text or by
the share of texts that a term not broadcast can have. Each disclosing term, with its highest
disclosure, then goes to all texts: broadcast up to ``MAX_TOLD`` terms, else joined with the terms of each
text, which gives the same result. Terms are runs of letters and digits, lower-cased, outside base spans.

Defined cases: null and empty texts have no spans. Rows are independent: null or repeated ids stay, one
result for each row. Texts without a base span or disclosing term are unchanged. Extra columns pass only if named in ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, salted_join, text_of, tidy, written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
SUPPORT = 3
CONFIDENCE = 0.5
GENERALISE = 0.75
REMOVE = 0.95
#: At most so many disclosing terms are broadcast; beyond it they meet the terms of each text in a join.
MAX_TOLD = 300_000
#: Terms of so many texts that no more of them exist are told apart by a broadcast.
MAX_FREQUENT = 100_000

SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"

# Fixed patterns of the base spans; each is anchored or possessive so that no text takes quadratic time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An email's local part is the run before an @, from the end of the last email on."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time of each dotted chain; those above 255 are dropped, and not tried again."""
    if "." not in text:
        return
    for chain in _DOTTED.finditer(text):
        numbers = chain.group().split(".")
        start = chain.start()
        for i in range(0, len(numbers) - 3, 4):
            end = start + sum(map(len, numbers[i : i + 4])) + 3
            if all(len(n.lstrip("0")) <= 3 and int(n[-3:]) <= 255 for n in numbers[i : i + 4]):
                yield start, end
            start = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 12:
            continue
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" not in text:
        return
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


_FINDERS = dict(zip(KINDS, (_emails, _ips, _cards, _phones)))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base spans, by start and then kind as listed."""
    found = [(start, i, end) for i, kind in enumerate(KINDS) for start, end in _FINDERS[kind](text)]
    return [(KINDS[i], start, end) for start, i, end in sorted(found)]


def _entity(kind: str, value: str) -> str:
    """A found value in the form in which it is counted."""
    return f"{kind}:{value.lower() if kind == 'email' else re.sub(r'[^0-9.]' if kind == 'ip' else r'[^0-9]', '', value)}"


def levels(value: str) -> list[str]:
    """An entity in the form in which it is counted, and the wider ones that it belongs to."""
    kind, _, own = value.partition(":")
    if kind == "email":
        local, _, domain = own.partition("@")
        return [value, f"domain:{domain}", f"local:{local}"]
    if kind == "ip":
        return [value, f"block:{own.rpartition('.')[0]}"]
    return [value, f"issuer:{own[:6]}" if kind == "card" else f"code:{own[:5]}"]


def _base(text: str) -> list[dict]:
    return [{"kind": k, "start": a, "end": b, "value": _entity(k, text[a:b])} for k, a, b in base_spans(text)]


def _terms(text: str, spans: list[dict]) -> Iterator[re.Match]:
    """Words outside the base spans."""
    ends = iter(sorted((s["start"], s["end"]) for s in spans))
    start, end = next(ends, (len(text), len(text)))
    for m in _WORD.finditer(text):
        while end <= m.start() and start < len(text):
            start, end = next(ends, (len(text), len(text)))
        if m.end() <= start:
            yield m


def _found(docs: DataFrame, text_col: str) -> DataFrame:
    """text_hash, entities and distinct terms of the texts with base spans."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, entities, terms = [], [], []
            for text_hash, text in zip(*(c.to_pylist() for c in batch.columns)):
                spans = _base(text)
                if spans:
                    hashes.append(text_hash)
                    entities.append(sorted({e for s in spans for e in levels(s["value"])}))
                    terms.append(sorted({m.group().lower() for m in _terms(text, spans)}))
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.int64()), pa.array(entities, lists), pa.array(terms, lists)], ["text_hash", "entities", "terms"]
            )

    rows = docs.select(text_of(text_col).alias("text")).select(F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(tidy(work), "text_hash long, entities array<string>, terms array<string>")


def _reach(n_entity: Column, total: Column, least: float, confidence: float) -> Column:
    """The most texts that a term may be in and still disclose ``least`` of an entity of so many texts: of
    n_both <= n_entity in PMI / IC >= least follows n_term <= n_entity (total / n_entity) ** (1 - least), and of
    n_both >= confidence n_term that n_term <= n_entity / confidence."""
    return F.least(n_entity * F.pow(total / n_entity, F.lit(1 - least)), n_entity / confidence) * (1 + 1e-9) + 1e-6


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term and the number of rows that have it."""
    split = F.filter(F.split(text_of(text_col), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    words = F.array_distinct(F.transform(split, lambda w: F.lower(w)))  # as in _terms: first split, then folded
    return docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def disclosures(
    docs: DataFrame, found: DataFrame, counts: DataFrame, frequent: DataFrame, *, support: int = SUPPORT, least: float = GENERALISE, confidence: float = CONFIDENCE
) -> DataFrame:
    """entity, term, disclosure and the counts behind it, of all pairs that the corpus supports and that disclose ``least`` or more.

    ``found`` has entities and terms of the texts with base spans (see ``_found``), ``counts`` the terms' counts
    and ``frequent`` the part of them that may be broadcast (see ``frequent_terms``)."""
    n_rows = float(docs.count())
    total = F.lit(n_rows)
    texts = found.groupBy("text_hash").agg(
        F.count(F.lit(1)).alias("n"), F.first("entities").alias("entities"), F.first("terms").alias("terms")
    )  # equal texts have equal lists
    texts = written(texts, "texts")
    named = texts.select("text_hash", "n", F.explode("entities").alias("entity"))
    sizes = named.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("in_texts"))
    sizes = sizes.where(F.col("in_texts") >= support).drop("in_texts")
    named = written(salted_join(named, sizes, "entity", "text_hash"), "entities")
    reach = named.groupBy("text_hash").agg(F.max(_reach(F.col("n_entity"), total, least, confidence)).alias("reach"))
    terms = texts.join(reach, "text_hash").select("text_hash", "reach", F.explode("terms").alias("term"))
    known = terms.join(F.broadcast(frequent), "term", "left").where(F.col("n_frequent").isNull() | (F.col("n_frequent") <= F.col("reach")))
    rare = known.where("n_frequent is null").drop("n_frequent").join(counts, "term")
    near = known.where("n_frequent is not null").withColumnRenamed("n_frequent", "n_term").unionByName(rare)
    near = near.where(F.col("n_term") <= F.col("reach")).select("text_hash", "term", "n_term")
    pairs = (
        near.join(named, "text_hash")
        .groupBy("entity", "term")
        .agg(
            F.sum("n").alias("n_both"),
            F.count(F.lit(1)).alias("n_texts"),
            F.first("n_entity").alias("n_entity"),
            F.first("n_term").alias("n_term"),
        )
        .where((F.col("n_texts") >= support) & (F.col("n_both") >= F.col("n_term") * confidence))
    )
    pmi = F.log(F.col("n_both") * total / (F.col("n_entity") * F.col("n_term")))
    told = F.when(F.col("n_entity") < total, pmi / F.log(total / F.col("n_entity"))).otherwise(0.0)
    return pairs.withColumn("disclosure", told).where(F.col("disclosure") >= least).select(
        "entity", "term", "disclosure", "n_entity", "n_both", "n_term"
    )


def frequent_terms(counts: DataFrame, most: int = MAX_FREQUENT) -> DataFrame:
    """term and ``n_frequent`` of the terms in more texts than all counts divided by ``most``: at most ``most`` terms."""
    whole = counts.agg(F.coalesce(F.sum("n_term"), F.lit(0))).first()[0]
    return counts.where(F.col("n_term") > whole / most).withColumnRenamed("n_term", "n_frequent")


def _replaced(text: str, terms: dict[str, float]) -> tuple[list[dict], str]:
    """All spans of a text, and the text with every span replaced."""
    spans = _base(text)
    more = [
        {"kind": TERM, "start": m.start(), "end": m.end(), "value": m.group()}
        for m in (_terms(text, spans) if terms else ())
        if m.group().lower() in terms
    ]
    spans = sorted(spans + more, key=lambda s: (s["start"], (*KINDS, TERM).index(s["kind"])))
    out, at = [], 0
    for s in spans:
        if s["start"] < at:  # what an earlier span covers is gone already
            at = max(at, s["end"])
            continue
        out += text[at : s["start"]], _substitute(s, terms)
        at = s["end"]
    return spans, "".join([*out, text[at:]])


def _applied(rows: DataFrame, told: dict[str, float] | None, texts: bool) -> DataFrame:
    """Rows (id, kept, text, and ``revealing`` terms where ``told`` is none): id, kept, all spans, and the text
    with every span replaced."""
    sent = None if told is None else rows.sparkSession.sparkContext.broadcast(told)
    names = ["id", "kept", "spans", "text"]
    schema = rows.select("id", "kept", F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("string").alias("text")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            found, out = [], []
            own = batch.column(3).to_pylist() if sent is None else [None] * batch.num_rows
            for text, revealing in zip(batch.column(2).to_pylist(), own):
                spans, clean = _replaced(text, {r["term"]: r["disclosure"] for r in revealing or ()} if sent is None else sent.value)
                found.append(spans)
                out.append(clean if texts or spans else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(found, to_arrow_type(schema["spans"].dataType)), pa.array(out, pa.string())], names
            )

    return rows.mapInArrow(tidy(work), StructType([*schema]))


def _revealing(docs: DataFrame, told: DataFrame, frequent: DataFrame, text_col: str) -> DataFrame:
    """text_hash and the told terms of each text that has some. Frequent terms are looked up before the shuffle. Words are split as by ``_terms``; texts of one
    hash share their list, which is harmless, as a text only takes the terms that it has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [list({w.lower() for w in _WORD.findall(t)} | {m.group().lower() for m in _terms(t, _base(t))}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], ["text_hash", "terms"])

    texts = docs.select(text_of(text_col).alias("text")).select(F.xxhash64("text").alias("text_hash"), "text")
    words = texts.mapInArrow(tidy(work), "text_hash long, terms array<string>").select("text_hash", F.explode("terms").alias("term"))
    often = frequent.join(told, "term", "left").select("term", "disclosure", F.lit(True).alias("often"))
    words = words.join(F.broadcast(often), "term", "left")  # at most MAX_FREQUENT terms
    rare = words.where("often is null").select("text_hash", "term").join(told, "term")
    return (
        words.where("disclosure is not null").select("text_hash", "term", "disclosure").unionByName(rare.select("text_hash", "term", "disclosure"))
        .groupBy("text_hash", "term")
        .agg(F.first("disclosure").alias("disclosure"))
        .groupBy("text_hash")
        .agg(F.collect_list(F.struct("term", "disclosure")).alias("revealing"))
    )


def _substitute(span: dict, terms: dict[str, float]) -> str:
    if span["kind"] != TERM:
        return f"[{span['kind'].upper()}]"
    value = span["value"]
    if terms[value.lower()] >= REMOVE:
        return ""
    return "[NUMBER]" if value.isdigit() else "[NAME]" if value[:1].isupper() else "[WORD]"


def sanitise(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), texts: bool = True
) -> DataFrame:
    """One row for each row of ``docs``: id, ``spans`` (base and term spans, with values), ``sanitised``
    (with ``texts``; else null where nothing changed) and the columns ``keep``."""
    found = written(_found(docs, text_col), "terms")
    counts = written(term_counts(docs, text_col), "counts")
    frequent = frequent_terms(counts)
    told = disclosures(docs, found, counts, frequent)
    told = written(told.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "told")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("none")]).alias("kept"),
        text_of(text_col).alias("text"),
    )
    if told.count() <= MAX_TOLD:
        table = told.toArrow()
        done = _applied(rows, dict(zip(table["term"].to_pylist(), table["disclosure"].to_pylist())), texts)
        discard(counts, told)
    else:
        revealing = written(_revealing(docs, told, frequent, text_col), "revealing")
        hashed = rows.withColumn("text_hash", F.xxhash64("text"))
        joined = salted_join(hashed, revealing, "text_hash", "id", "left")  # copies of a text are no hot key
        done = _applied(joined.select("id", "kept", "text", "revealing"), None, texts)
        discard(counts, told)
    discard(found)
    return done.select(
        F.col("id").alias(id_col),
        "spans",
        F.col("text").alias("sanitised"),
        *[F.col("kept")[c].alias(c) for c in keep if c not in (id_col, "spans", "sanitised")],
    )
