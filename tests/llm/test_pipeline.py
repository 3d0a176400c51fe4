import public_tokenizers

import corpus_pipeline
from loomery.llm import decontaminate, sampled_pieces, toxicity
from test_jaccard_join import brute_sets, shingles
from test_line_dedup import brute as brute_lines

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen[name] = before
        after = docs.collect()
        if name != "SentencePiece sampling":
            assert docs.columns == columns
        texts = {r.doc_id: r.text for r in before}
        got = {r.doc_id: getattr(r, "text", None) for r in after}
        if name == "toxicity":
            model = toxicity.fitted(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
            score = model.scorer()
            assert got == {i: t for i, t in texts.items() if score(t) < 0.5}
            assert len(got) > 0.7 * len(texts)
        elif name == "line dedup":
            want = {i: t for i, _, _, t in brute_lines(list(texts.items()))}
            assert got == want and all(r.n_chars == len(r.text) for r in after)
        elif name == "n-gram Jaccard join":
            classes = brute_sets({i: shingles(t, 5) for i, t in texts.items()}, 80)
            assert got == {i: t for i, t in texts.items() if classes[i] == i}
        elif name == "benchmark decontamination":
            items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            windows = set()
            for _, t in items:
                w = decontaminate.clean_words(t)
                size = min(10, len(w))
                windows |= {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
            sizes = {len(w) for w in windows}

            def clean(text):
                w = decontaminate.clean_words(text)
                return not any(tuple(w[i : i + m]) in windows for m in sizes for i in range(len(w) - m + 1))

            assert got == {i: t for i, t in texts.items() if clean(t)}
        else:
            sampler = sampled_pieces.Sampler(public_tokenizers.path(corpus_pipeline.PIECES))
            rows = {(r.doc_id, r.path): r for r in after}
            assert all(r.round_trip for r in after)
            for i, t in list(texts.items())[:40]:
                for k, (ids, logp, _) in enumerate(sampler.batch([i], [t])[0]):
                    assert rows[i, k + 1].n_pieces == len(ids) and abs(rows[i, k + 1].log_prob - logp) < 1e-6 * (1 + abs(logp))
    assert len(seen) == 5


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:2] == ["doc_id", "path"] and out.count() > 100


ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, doc int, copy int, bm_doc int, hit_spans int"


def test_odd_rows_come_through(spark, tmp_path):
    same = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, same), (4, same), (4, same), (None, same), (None, None), (5, " "), (6, "long " * 50_000)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or ""), "s", 1, 2, 3, 4) for i, t in rows], ODD)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "3", "5", "6", "None", "None"]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.where("doc_id = 1").count() == 1 and last.where("not round_trip").count() == 0


def test_empty_tables_stay_empty(spark):
    docs = spark.createDataFrame([], ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
