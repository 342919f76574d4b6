"""The pipeline's stages against brute force on a small corpus."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
import numpy as np
import tiktoken
from test_corpus_operators import RANKS, WORDS, brute_components, prose

from methyloom.llm import segbpe


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    bench = [(i, prose(rng, 20, [f"b{k}" for k in range(99)])) for i in range(4)]
    for i in range(120):
        lang = rng.choice(sorted(WORDS))
        lines = [prose(rng, 9, WORDS[lang].split()) for _ in range(4)]
        if i % 10 == 3:
            lines.append(bench[i % 4][1])
        rows.append((i, "\n".join(lines), lang if i % 7 else None, "s", 0))
    for i in range(120, 140):  # near copies: the words of one line in another order of lines
        words = rows[i - 100][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en", "s", 0))
    rows += [(140, None, None, "s", None), (141, "", "en", "s", 0), (142, "1234 %%", "en", "s", 0), (143, rows[5][1], "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, out = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
        out[name] = {r.doc_id: r for r in docs.collect()}
    assert set(out["language_id"]) == set(range(140)) | {143}

    kept, seen = {}, set()
    for i in sorted(out["language_id"]):
        lines = rows[i][1].split("\n")
        gone = {k + j for k in range(len(lines) - 1) for j in (0, 1) if (lines[k], lines[k + 1]) in seen}
        seen |= {(lines[k], lines[k + 1]) for k in range(len(lines) - 1)}
        kept[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    assert {i: r.text for i, r in out["line_dedup"].items()} == kept and kept[143] == ""
    assert all(r.n_chars == len(kept[i]) for i, r in out["line_dedup"].items())

    ids = sorted(kept)
    _, comp = brute_components([kept[i] for i in ids], 5, 80)
    assert sorted(out["near_duplicates"]) == [i for k, i in enumerate(ids) if comp[k] == k]

    clean = [i for i in out["near_duplicates"] if not any(item in kept[i].replace("\n", " ") for _, item in bench)]
    assert sorted(out["benchmark_decontamination"]) == sorted(clean)

    known = tiktoken.Encoding("own", pat_str=corpus_pipeline.PATTERN, mergeable_ranks=segbpe.load_ranks(RANKS), special_tokens={})
    for i, r in out["byte_bpe"].items():
        ids = np.array(known.encode_ordinary(kept[i]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(kept[i].encode()).hexdigest())
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(out["byte_bpe"])


def test_near_duplicates_by_text(spark):
    """Rows that repeat a doc_id, or lack one, are told apart by their texts."""
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    one, two, three = (prose(rng, 80, vocabulary) for _ in range(3))
    near = one.replace(one.split()[40], "changed", 1)
    rows = [(5, one), (5, two), (5, two), (None, near), (None, three), (7, three), (8, None), (8, None), (9, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(None, near), (5, two), (None, three), (8, None), (8, None), (9, ""), (None, None)], key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "some words of an item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
