"""Personal data: patterns for the identifiers themselves, and information-theoretic sanitisation of what gives them away.

Patterns find the protected entities (an e-mail address, a card number, ...). Terms near an entity are then held against
the whole corpus: with n documents, the entity e in df(e), the term t in df(t), and t near e in c(t, e) of them,
PMI(t, e) = log(n c / (df(t) df(e))) is what t tells about e, out of IC(e) = log(n / df(e)). A term whose share
PMI / IC passes a threshold reveals the entity: below a second threshold it is generalised to the class of its shape, above
it is removed. A meeting seen in one document only is no estimate and reveals nothing.

Entities and their terms come from windows of words, so their pairs grow with the mentions; counts are aggregates with
map-side combine; pairs that hold over a thousandth of the meetings join by broadcast of these, at most a thousand.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import row_chunks, table, text_or_empty, written
from strandline.llm.trie import split_join

#: Kinds in the order of the base spans; terms that the corpus gives away come last.
KINDS = ("email", "ip", "card", "phone", "term")

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
JAVA_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local part, @ and dotted labels, in time linear in the text: each @ looks back no further than the one before."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        match = DOMAIN.match(text, at)
        if match:
            start = at
            while start > end and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < at:
                out.append((start, match.end()))
                end = match.end()
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += DOUBLED[int(d)] if i % 2 else int(d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) in code points, in that order: leftmost matches of every kind that pass its test.

    No pattern reads a character more than a few times. An address never starts inside a run of digits: one that did
    would start at the run's head as well.
    """
    found = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups()):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isascii() and c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def mentions(text: str, spans: list[tuple[int, int, int]], window: int = 8, least: int = 3) -> tuple[list[str], list[tuple[str, str]], dict[str, list[tuple[int, int]]]]:
    """Entities of the text, (entity, term) for each term within `window` words of a mention, and all places of these terms.

    An entity is its kind and value. Terms are words of at least `least` characters, lower-cased, outside all spans.
    """
    words: list[tuple[int, int]] = []
    covered, reach = [], 0
    for start, _, end in spans:  # union of the spans, as sorted stretches
        if covered and start <= covered[-1][1]:
            covered[-1] = (covered[-1][0], max(covered[-1][1], end))
        else:
            covered.append((start, end))
    for m in WORD.finditer(text):
        while reach < len(covered) and covered[reach][1] <= m.start():
            reach += 1
        if reach == len(covered) or covered[reach][0] >= m.end():
            words.append((m.start(), m.end()))
    starts = [a for a, _ in words]
    pairs: dict[tuple[str, str], None] = {}
    entities: dict[str, None] = {}
    for start, kind, end in spans:
        entity = f"{KINDS[kind]}:{text[start:end]}"
        entities[entity] = None
        i = bisect.bisect_left(starts, start)
        j = bisect.bisect_left(starts, end)
        for a, b in words[max(0, i - window) : i] + words[j : j + window]:
            if b - a >= least:
                pairs[(entity, text[a:b].translate(LOWER))] = None
    near = {t for _, t in pairs}
    places: dict[str, list[tuple[int, int]]] = {}
    for a, b in words:
        term = text[a:b].translate(LOWER)
        if term in near:
            places.setdefault(term, []).append((a, b))
    return list(entities), list(pairs), places


FOUND = "entities array<string>, base array<struct<start:int,kind:int,end:int>>, pairs array<struct<entity:string,term:string>>, places array<struct<term:string,start:int,end:int>>"


def _found(documents: DataFrame, carry: tuple[str, ...], window: int) -> DataFrame:
    """Rows of the documents, each with a number of its own, and what their texts mention; written."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry if c != "text"])
    kept = [c for c in docs.columns if c != "text" or "text" in carry]
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_chunks(batches, 1024):
            entities, base, pairs, places = [], [], [], []
            for text in part.column("text").to_pylist():
                spans = base_spans(text)
                e, p, at = mentions(text, spans, window) if spans else ([], [], {})
                entities.append(e)
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                pairs.append([{"entity": x, "term": t} for x, t in p])
                places.append([{"term": t, "start": a, "end": b} for t, where in at.items() for a, b in where])
            span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
            made = [
                pa.array(entities, pa.list_(pa.string())), pa.array(base, pa.list_(span)), pa.array(pairs, pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))),
                pa.array(places, pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
            ]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], names=[*kept, "entities", "base", "pairs", "places"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + f", {FOUND}"
    return written(docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "pii-found")


def disclosures(found: DataFrame, documents: DataFrame, least_meetings: int = 2, generalise: float = 0.8) -> DataFrame:
    """(entity, term, meetings, share): terms that give an entity away, by counts over all documents.

    share = PMI / IC is at most 1, which a term reaches that stands in none but the entity's documents and near it in all.
    An entity that every document has carries no information, so nothing reveals it.
    """
    n = found.count()
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("df_e"))
    meetings = found.select(F.explode("pairs").alias("p")).groupBy("p.entity", "p.term").agg(F.count(F.lit(1)).alias("meetings"))
    meetings = written(meetings.where(F.col("meetings") >= least_meetings), "pii-meetings")
    lower = F.translate(text_or_empty(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = documents.select(F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(JAVA_WORD), 0))).alias("term"))
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    total = meetings.count()
    uses = meetings.groupBy("term").agg(F.count(F.lit(1)).alias("uses_t"))
    frequent = written(uses.join(counts, "term"), "pii-terms")
    known = split_join(meetings, frequent, ["term"], F.col("uses_t") * 1000 > total)
    of_entity = meetings.groupBy("entity").agg(F.count(F.lit(1)).alias("uses_e"))
    known = split_join(known, entities.join(of_entity, "entity"), ["entity"], F.col("uses_e") * 1000 > total)
    content = F.log(F.lit(float(n)) / F.col("df_e"))
    told = F.log(F.lit(float(n)) * F.col("meetings") / (F.col("df_t").cast("double") * F.col("df_e")))
    share = F.when(content > 0, told / content)
    return known.select("entity", "term", "meetings", share.alias("share")).where(F.col("share") >= generalise)


def personal_data(documents: DataFrame, carry: tuple[str, ...] = (), window: int = 8, least_meetings: int = 2, generalise: float = 0.8) -> DataFrame:
    """One row a document row: doc_id, base and all (arrays of (start, kind, end, share), ordered by start, then kind), and `carry`.

    A term that gives away an entity of its document is marked wherever it stands in it, with its largest share; base
    spans have share 1. Null and empty texts have no spans; ties and repeated rows are rows of their own, which count
    each as a document; an empty table gives no rows. Other columns are not read unless carried, under their own names;
    base and spans cannot be carried.
    """
    judged = _judged(documents, carry, window, least_meetings, generalise)
    return judged.select("doc_id", "base", "spans", *[F.col("text" if c == "text" else f"carry_{c}").alias(c) for c in carry])


def _judged(documents: DataFrame, carry: tuple[str, ...], window: int, least_meetings: int, generalise: float) -> DataFrame:
    """`personal_data` with carried columns named carry_<name>, but for text."""
    found = _found(documents, carry, window)
    told = written(disclosures(found, documents, least_meetings, generalise), "pii-disclosures")
    met = found.select("row", F.explode("pairs").alias("p")).select("row", "p.entity", "p.term")
    total = told.agg(F.sum("meetings")).first()[0] or 0
    given = split_join(met, told.select("entity", "term", "meetings", "share"), ["entity", "term"], F.col("meetings") * 1000 > total)
    given = given.groupBy("row", "term").agg(F.max("share").alias("share")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("given"))
    whole = found.join(given, "row", "left")
    marked = F.filter(F.transform("places", lambda p: F.struct(p["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), p["end"].alias("end"), F.col("given")[p["term"]].alias("share"))), lambda s: s["share"].isNotNull())
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(1.0).alias("share")))
    spans = F.array_sort(F.concat(base, F.coalesce(marked, F.array().cast("array<struct<start:int,kind:int,end:int,share:double>>"))))
    return whole.select("doc_id", base.alias("base"), spans.alias("spans"), *["text" if c == "text" else f"carry_{c}" for c in carry])


def sanitised(documents: DataFrame, carry: tuple[str, ...] = (), window: int = 8, least_meetings: int = 2, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """Documents (doc_id, text, `carry`) whose personal data is replaced: identifiers by their kind in brackets, terms with a
    share of at least `remove` by nothing, other marked terms by the class of their shape (NUMBER, NAME, WORD).

    Of overlapping spans the first, then the longest, is replaced, and what a later one covers beyond it goes as well.
    """
    judged = _judged(documents, ("text", *[c for c in carry if c != "text"]), window, least_meetings, generalise)
    at = {c: i for i, c in enumerate(judged.columns)}
    rest = [c for c in judged.columns if c.startswith("carry_")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_chunks(batches, 1024):
            texts = [replaced(t, [(s["start"], s["kind"], s["end"], s["share"]) for s in spans], remove) for t, spans in zip(part.column(at["text"]).to_pylist(), part.column(at["spans"]).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(at["doc_id"]), pa.array(texts, pa.string()), *(part.column(at[c]) for c in rest)], names=["doc_id", "text", *[c[6:] for c in rest]])

    types = dict(judged.dtypes)
    return judged.mapInArrow(run, ", ".join(["doc_id long", "text string", *[f"`{c[6:]}` {types[c]}" for c in rest]]))


def replaced(text: str, spans: list[tuple[int, int, int, float]], remove: float = 0.95) -> str:
    """The text with its spans (start, kind, end, share) replaced as `sanitised` says."""
    out, at = [], 0
    for start, kind, end, share in sorted(spans, key=lambda s: (s[0], -s[2], s[1])):
        if end <= at:
            continue
        if start >= at:
            out.append(text[at:start])
            word = text[start:end]
            shape = "NUMBER" if word.isdecimal() else "NAME" if word[:1].isupper() else "WORD"
            out.append(f"[{KINDS[kind].upper()}]" if kind < len(KINDS) - 1 else "" if share >= remove else f"[{shape}]")
        at = end
    return "".join(out) + text[at:]


def listed(spans: Column) -> Column:
    """kind:start:end of ordered spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
