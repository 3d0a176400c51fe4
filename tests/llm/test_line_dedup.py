import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from loomery.llm.line_dedup import dedup_lines, keep_bitmaps

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(docs, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    for i, t in docs:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= min_chars:
                    holders[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        gone = [i is not None and len(holders.get(key(x), ())) >= min_docs and max(holders[key(x)]) != i for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    pool = ["Line %d is repeated in places é" % i for i in range(8)] + ["short", "", "ÀÉ upper accents stay as they ARE"]
    vary = lambda s: rng.choice([s, s.upper() if s.isascii() else s, "  " + s + "\t", s + "\r"])
    docs = [(i, "\n".join(vary(rng.choice(pool)) for _ in range(rng.randint(0, 9)))) for i in range(80)]
    docs += [(200, None), (201, ""), (202, "\n\n"), (5, docs[5][1]), (5, "\n".join(pool)), (None, "\n".join(pool)), (None, None)]
    docs += [(300, "\n".join(pool * 400)), (301, "\n".join(pool))]
    frame = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, n_lines int")
    out = dedup_lines(frame, keep_bitmaps(frame))
    assert out.columns == ["doc_id", "text", "n_lines", "_n_lines", "n_dropped"]
    got = sorted((str(r.doc_id), r._n_lines, r.n_dropped, r.text or "") for r in out.collect())
    assert got == sorted((str(i), n, d, t) for i, n, d, t in brute(docs))
    runs = keep_bitmaps(frame).where("doc = 300").collect()[0]
    assert runs.n_dropped == brute(docs)[-2][2] == 9 * 400
    assert len(runs.keep_runs) <= 2 * 400 + 1


def test_first_keeper_and_empty(spark):
    frame = spark.createDataFrame([(i, "a line that is long enough") for i in (4, 9, 6)], "doc_id long, text string")
    out = dedup_lines(frame, keep_bitmaps(frame, keeper="first"))
    assert {r.doc_id: r.text for r in out.collect()} == {4: "a line that is long enough", 6: "", 9: ""}
    assert dedup_lines(frame.limit(0), keep_bitmaps(frame.limit(0))).count() == 0
    digest = out.select(F.sha2("text", 256).alias("h")).collect()
    assert hashlib.sha256(b"").hexdigest() in {r.h for r in digest}
