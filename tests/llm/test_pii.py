"""Personal data: patterns against plain regular expressions, disclosures against plain counts."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from strandline.llm import pii
from strandline.llm.registry import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def luhn(digits):
    values = [int(d) for d in digits]
    for i in range(len(values) - 2, -1, -2):
        values[i] = sum(map(int, str(2 * values[i])))
    return sum(values) % 10 == 0


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def named(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def plain_report(texts, window=8, least=3, threshold=0.8):
    """(base, all) span lists of every text, by counting over all texts."""
    texts = [t or "" for t in texts]
    n = len(texts)
    df_t = Counter(w for t in texts for w in set(WORD.findall(t.translate(ASCII))))
    df_e, meet, words, near, held = Counter(), Counter(), [], [], []
    for t in texts:
        spans = plain_spans(t)
        free = [(m.start(), m.end()) for m in WORD.finditer(t.translate(ASCII)) if all(b <= m.start() or a >= m.end() for a, _, b in spans)]
        pairs = set()
        for a, k, b in spans:
            before, after = [w for w in free if w[0] < a][-window:], [w for w in free if w[0] >= b][:window]
            pairs |= {(f"{pii.KINDS[k]}:{t[a:b]}", t[x:y].translate(ASCII)) for x, y in before + after if y - x >= least}
        df_e.update({f"{pii.KINDS[k]}:{t[a:b]}" for a, k, b in spans})
        meet.update(pairs)
        words.append(free)
        near.append(pairs)
        held.append(spans)
    out = []
    for t, spans, free, pairs in zip(texts, held, words, near):
        told = set()
        for e, w in pairs:
            content = math.log(n / df_e[e])
            if meet[e, w] >= 2 and content > 0 and math.log(n * meet[e, w] / (df_t[w] * df_e[e])) / content >= threshold - 1e-12:
                told.add(w)
        out.append((spans, sorted(spans + [(a, 4, b) for a, b in free if t[a:b].translate(ASCII) in told])))
    return out


def test_patterns_on_random_texts():
    """Texts of the characters that patterns turn on."""
    rng = random.Random(1)
    for alphabet in ("a1@.-", "1.", "12 -", "+1 ().-", "aA1@.+ -%_é\n", "0259.", "4 -1+"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            assert pii.base_spans(text) == plain_spans(text), text


def test_known_numbers():
    text = "4111 1111 1111 1111, 4111-1111-1111-1112; +1 (017) 555-7713 at 10.0.0.256 or 010.0.00.255; a.b@c.d@e.f, x@y, ٣٣٣@a.b"
    assert pii.base_spans(text) == plain_spans(text)
    assert named(pii.base_spans(text)).count("card") == 1


def test_long_texts_take_linear_time():
    for text in ("x" * 3_000_000, "1" * 3_000_000, "1." * 1_000_000, "a@" * 1_000_000, "1 " * 1_000_000, "+1 " * 500_000, "@" + "a" * 2_000_000 + "@b", ("a@b." * 500_000)):
        pii.base_spans(text)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "s", 1, "x") for d, t in rows], "doc_id long, text string, spans string, row int, term string")


def corpus(seed=3):
    """Copies and neighbours of identifiers, terms that follow them and terms that are everywhere, odd rows."""
    rng = random.Random(seed)
    common = "the of and with from under over".split()
    ids = ["ada@mail.example", "10.1.2.3", "4111 1111 1111 1111", "+49 30 1234 5678", "bob@mail.example"]
    rows = []
    for i in range(120):
        words = [rng.choice(common) for _ in range(12)] + [f"Word{rng.randrange(40)}"]
        if rng.random() < 0.4:
            k = rng.randrange(len(ids))
            words += [f"Nick{k}", ids[k], rng.choice(common), f"nick{k}" if rng.random() < 0.3 else "plain"]
        rng.shuffle(words) if rng.random() < 0.3 else None
        rows.append((i, " ".join(words)))
    rows += [(200 + i, "Solo copy zed@mail.example of one text") for i in range(60)]
    return rows + [(7, None), (None, "the ada@mail.example"), (8, ""), (1009, "once@only.example hapax"), (8, "Nick1 is not here"), (300, "10.1.2.3 " * 400 + "nick1 " * 300)]


def test_disclosures(spark):
    rows = corpus()
    got = pii.personal_data(frame(spark, rows)).select("doc_id", pii.listed("base").alias("b"), pii.listed("spans").alias("s")).collect()
    want = [(d, named(b), named(s)) for (d, _), (b, s) in zip(rows, plain_report([t for _, t in rows]))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    by = {r["doc_id"]: r["s"] for r in got}
    assert by[1009] == "email:0:17" and "term" in by[200] and any("term" in r["s"] for r in got if r["doc_id"] is not None and r["doc_id"] < 120)
    assert pii.personal_data(frame(spark, rows).limit(0)).count() == 0


def test_sanitised(spark):
    rows = corpus()
    got = pii.sanitised(frame(spark, rows), carry=("spans", "row"))
    assert got.columns == ["doc_id", "text", "spans", "row"] and got.count() == len(rows)
    texts = [r["text"] for r in got.collect()]
    assert not any(plain_spans(t) for t in texts) and sum("[EMAIL]" in t for t in texts) > 60
    assert pii.replaced("ab 12 Cd ef", [(0, 4, 2, 0.85), (3, 4, 5, 0.85), (6, 4, 8, 0.85), (9, 4, 11, 1.0)]) == "[WORD] [NUMBER] [NAME] "
    assert pii.replaced("abcdef", [(0, 2, 3, 1.0), (2, 3, 5, 1.0)]) == "[CARD]f"


@pytest.mark.parametrize("table", ["documents"])
def test_query(spark, sf_dir, table):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op13_personal_data"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    seen = defaultdict(int)
    for (doc, _), (base, every) in zip(rows, plain_report([t for _, t in rows])):
        r, kinds = got[doc], Counter(k for _, k, _ in base)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(kinds[k] for k in range(4))
        assert r["base_sha256"] == hashlib.sha256(named(base).encode()).hexdigest() and r["spans"] == named(every)
        seen["base"] += bool(base)
    assert seen["base"]
