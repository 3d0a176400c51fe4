"""Names beyond ASCII: folding against Python's, and aliases looked up by a map and by a join."""

import random

from pyspark.sql import functions as F

from loomery.functions import text as X
from loomery.operators import alias as A


def folded(s):
    return None if s is None else " ".join(s.replace("_", " ").replace("-", " ").split()).casefold()


def test_every_character(spark):
    names = [f"a{chr(i)}B" for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and (chr(i).casefold() != chr(i) or chr(i).isspace() or i % 97 == 0)]
    names += [None, "", " _ ", "STRASSE", "Straße", "ΣΊΣΥΦΟΣ", "ﬃ ŉ İ", " Große_Lampe\xa0", "ǅ-ß"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", X.name_fold(F.col("n")).alias("f")).collect()
    assert [(names[r.i], r.f) for r in rows if r.f != folded(names[r.i])] == []


def cases(seed):
    rng = random.Random(seed)
    words = ["Straße", "STRASSE", "Lampe", "lampe_", "Ärger", "ÄRGER", "ΣΑΣ", "σας", "nobody", "wall", None, ""]
    aliases = [(rng.choice([1, 2, None]), rng.choice(words), rng.choice([[1], [2, 3], [4, 5, 6, 7, 8, 9], None])) for _ in range(40)]
    commands = [(i, rng.choice([1, 2, 3, None]), rng.choice(["set", "seq", "alias"]), rng.choice([[], [7], None]), rng.choice([None, [], [rng.choice(words)], [rng.choice(words), rng.choice(words)], ["wall"] * 4])) for i in range(300)]
    return aliases, commands


def resolved(aliases, commands, keyed):
    table = {}
    for device, name, pins in aliases:
        if name is not None and pins is not None:
            key = (device if keyed else 0, folded(name))
            table[key] = min(table.get(key, pins), pins)
    out = []
    for i, device, action, pins, names in commands:
        have, verdict = list(pins or []), "execute"
        for n in (names or []) if action != "alias" else []:
            more = table.get((device if keyed else 0, folded(n)))
            if more is None or len(have) + len(more) > 16:
                have, verdict = [], "unknown_name" if more is None else "too_many_pins"
                break
            have += more
        if action == "seq" and verdict == "execute" and names and len(have) < 2:
            have, verdict = [], "name_too_few_pins"
        out.append((i, verdict, have))
    return out


def test_map_and_join_agree(spark):
    for keyed in (False, True):
        aliases, commands = cases(1 + keyed)
        table = spark.createDataFrame(aliases, "device int, name string, pins array<int>")
        frame = spark.createDataFrame(commands, "id int, device int, action string, pins array<int>, names array<string>").withColumn("row", F.lit(1)).repartition(4)
        want = resolved(aliases, commands, keyed)
        for most in (10_000, 2):
            got = A.resolve(frame, table, *(["device"] if keyed else []), fold=X.name_fold, most=most)
            assert got.columns == ["id", "device", "action", "pins", "names", "row", "verdict", "resolved"]
            assert sorted((r.id, r.verdict, list(r.resolved)) for r in got.collect()) == want
        assert A.resolve(frame.limit(0), table, fold=X.name_fold, most=2).count() == 0
