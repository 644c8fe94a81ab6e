"""The filter audit against filters that are applied one after the other."""

import random
import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from quaywork.llm import audit

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def fails(rows):
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": re.search("[#$%&*|]", text) is not None,
            "E": doc_id is not None and least[text] < doc_id,
        }
        yield doc_id, lang or "", {k for k, v in out.items() if v}


def plain(rows, labels):
    known = {}
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            q, t = known.get(doc_id, (False, False))
            known[doc_id] = (q or quality == 1, t or toxic == 1)
    docs = [(lang, bad, *known.get(doc_id, (False, False))) for doc_id, lang, bad in fails(rows)]
    out = {}
    for part in {d[0] for d in docs}:
        own, shapley = [d for d in docs if d[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left, gone = own, []
            for step, name in enumerate(order, 1):
                removed = [d for d in left if name in d[1]]
                left = [d for d in left if name not in d[1]]
                shapley[name] += len(removed)
                out[part, order, step] = [len(left), len(removed), sum(name in d[1] for d in gone), sum(d[1] == {name} for d in own), sum(d[2] for d in removed), sum(d[3] for d in removed)]
                gone += removed
        for order in map("".join, permutations("ABCDE")):
            for step, name in enumerate(order, 1):
                out[part, order, step].append(shapley[name])
    return sorted((*k, *v) for k, v in out.items())


def got(frame):
    return sorted(tuple(r) for r in frame.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def sample(n):
    rnd = random.Random(n)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        few = rnd.choice([0, 5, 150, 199, 200, 201, 260])
        text = " ".join(rnd.choices(words if rnd.random() < 0.7 else words[:20], k=few))
        text += rnd.choice(["", "", " #x", " |", "\x0b"]) + rnd.choice(["", "A" * 60, " É"])
        rows.append((rnd.choice([i, i, i, None]) if i % 9 == 0 else i, rnd.choice([text, text, text, "copied text", None, ""]), rnd.choice(["en", "fr", None, ""])))
    rows += rows[:7] + [(n + 1, "W " * 200_000, "en"), (n + 2, "z" * 500_000, "xx")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, n, 2)]
    return rows, labels + labels[:9] + [(None, 1, 1), (10**9, 1, 1)]


def test_every_order_equals_filters_in_a_row(spark):
    rows, labels = sample(160)
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(3) for c in ("mask", "digest", "first", "part", "good", "n", "total", "quality")})
    assert got(audit.audit_filters(docs.repartition(5), spark.createDataFrame(labels, LABELS))) == plain(rows, labels)


def test_a_text_of_very_many_copies(spark):
    rows = [(i, "The Same Text" if i % 3 == 0 else f"text {i} of its own", "en") for i in range(3000)]
    assert got(audit.audit_filters(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(6, 1, 1)], LABELS))) == plain(rows, [(6, 1, 1)])


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], LABELS), spark.createDataFrame([], DOCS)
    assert got(audit.audit_filters(docs, none)) == []
    clean = [(1, " ".join(f"w{i}" for i in range(300)), None)]
    assert got(audit.audit_filters(spark.createDataFrame(clean, DOCS), none)) == plain(clean, [])


def test_shapley_values_share_what_is_removed(spark):
    counts = spark.createDataFrame([("p", 0, 10, 0, 0), ("p", 3, 7, 1, 0), ("p", 4, 2, 0, 2), ("p", 7, 5, 5, 5)], "part string, mask int, all long, good long, toxic long")
    rows = audit.audit_orders(audit.removal_polynomials(counts, 3), "ABC").where("step = 1").select("filter_order", "shapley").collect()
    shares = {r.filter_order[0]: r.shapley for r in rows}
    assert shares == {"A": 7 * 3 + 5 * 2, "B": 7 * 3 + 5 * 2, "C": 2 * 6 + 5 * 2} and sum(shares.values()) == 14 * 6
