import random
import re
from collections import Counter, defaultdict

import pytest

from loomery.llm.source_audit import audit_sources, term_counts

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(docs, min_docs, top=10, share=10**9):
    """Rows by the definition: every group against every other over every kept term."""
    docs = [(a or "", b or "", c or "") for a, b, c in docs]
    out = []
    for lang in {x[0] for x in docs}:
        own = [(s, TERM.findall(lower(t))) for g, s, t in docs if g == lang]
        holding = Counter(t for _, terms in own for t in set(terms))
        kept = sorted(t for t, n in holding.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for s, terms in own:
            counts[s].update(t for t in terms if holding[t] >= min_docs)
        whole = sum(counts.values(), Counter())
        def shares(c):
            return {t: 1 + share * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        q, p = shares(whole), {s: shares(c) for s, c in counts.items()}
        for s in p:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in p if o != s))
            terms = sorted(((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]))[:top]
            for part, items in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(items, 1)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["The", "the", "cat", "éa", "ÉA", "日本", "x y", "sat", "mat", "zeta", "Ω", "ß", "'s", "12ab", "_", "end.", "{b}", "\x7fdel", " em", "naïve-ish"]
    docs = [(rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot", "hot", "a", "b", None, "zé"]), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30])))) for _ in range(150)]
    docs += [("fr", "only", "mot mot"), ("it", "one", "uno"), ("it", "two", None), ("it", "three", ""), ("de", "long", "der die das " * 5000), ("en", "silent", None), ("en", "hot", docs[0][2])]
    return docs


@pytest.mark.parametrize("seed, piece_rows, few", [(1, 200_000, 10), (2, 1, 10_000), (3, 7, 0)])
def test_equals_brute_force(spark, seed, piece_rows, few):
    docs = corpus(seed)
    frame = spark.createDataFrame([(a, b, c, i, 1, "t") for i, (a, b, c) in enumerate(docs)], "lang string, source string, text string, doc_id long, value long, `a.term` string").repartition(5)
    got = audit_sources(frame, min_docs=3, piece_rows=piece_rows, few_groups=few)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == brute(docs, 3)


def test_nothing_kept_and_empty(spark):
    frame = spark.createDataFrame([("en", "a", "one"), ("en", "b", "two"), ("en", "c", None)], "lang string, source string, text string")
    assert sorted(map(tuple, audit_sources(frame).collect())) == brute([tuple(r) for r in frame.collect()], 10)
    assert audit_sources(frame.limit(0)).count() == 0


def test_counts_do_not_depend_on_what_is_held(spark):
    docs = corpus(4)
    frame = spark.createDataFrame(docs, "lang string, source string, text string").repartition(3)
    sums = [
        sorted(map(tuple, term_counts(frame, held_terms=n).groupBy("lang", "source", "term").sum("n", "docs").collect()))
        for n in (1, 10, 10**6)
    ]
    assert sums[0] == sums[1] == sums[2]
    want = Counter((a or "", b or "", t) for a, b, c in docs for t in TERM.findall(lower(c or "")))
    assert {(a, b, t): n for a, b, t, n, _ in sums[0]} == want
