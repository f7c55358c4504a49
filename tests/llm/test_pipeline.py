"""The pipeline against plain code, stage by stage."""
import os
import pathlib
import subprocess
import sys

import public_tokenizers
import tiktoken

import corpus_pipeline as c
from tidemark.llm import bpe_replay, secrets_crf
from tidemark.llm.common import saved

from .conftest import SF
from .test_decontaminate import brute
from .test_simhash_golay import brute_classes, brute_print


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    tables = {}
    for name, stage in c.STAGES:
        before, docs = docs, saved(stage(spark, docs, SF))
        if name != c.STAGES[-1][0]:
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
        tables[name] = {r["doc_id"]: r.asDict() for r in docs.collect()}
        assert len(tables[name]) == docs.count()
    kept = tables["language_id"]
    assert len(kept) == spark.read.parquet(f"{SF}/documents.parquet").count()
    prints = {i: brute_print(r["text"]) for i, r in kept.items()}
    root, first = brute_classes(prints.values()), {}
    for i in sorted(prints):
        first.setdefault(root[prints[i]], i)
    assert set(tables["near_dedup"]) == set(first.values())
    clean = {i for i, r in tables["near_dedup"].items() if not ((v := brute(r["text"], bench))[1] and 20 * v[1] >= v[0])}
    assert set(tables["decontamination"]) == clean == set(tables["secrets"])
    for i, r in tables["secrets"].items():
        assert not secrets_crf.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not secrets_crf.find_secrets(tables["decontamination"][i]["text"], secrets_crf.fitted())[1]:
            assert r == tables["decontamination"][i]
    ranks = bpe_replay.compiled(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {i: r["token_ids"] for i, r in tables["byte_bpe"].items()} == {i: library.encode_ordinary(r["text"]) for i, r in tables["secrets"].items()}


def test_executors_need_no_installed_package(tmp_path):
    """Elsewhere than in the repository, the package reaches the Python workers by itself."""
    repo = pathlib.Path(c.__file__).parent
    code = f"""
import sys
sys.path.insert(0, {str(repo)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', {str(tmp_path)!r}).getOrCreate()
from tidemark.llm import queries
print('rows', queries.op2_secrets_crf(spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows 200" in done.stdout, done.stderr[-2000:]


def test_empty_and_odd_documents(spark, odd_docs, no_docs):
    docs, seen = odd_docs, {}
    for name, stage in c.STAGES:
        before, docs = docs, saved(stage(spark, docs, SF))
        if name != c.STAGES[-1][0]:
            assert docs.dtypes == before.dtypes
        seen[name] = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in docs.collect())
    letterless = {(True, 2), (True, 3), (True, 5), (True, 6)}
    assert not letterless & set(seen["language_id"]) and seen["language_id"].count((True, 1)) == 2
    assert seen["near_dedup"].count((True, 1)) == 1 and seen["near_dedup"].count((False, 0)) == seen["language_id"].count((False, 0)) == 1
    assert seen["decontamination"] == seen["secrets"] == seen["byte_bpe"] == seen["near_dedup"]
    assert all(r["n_tokens"] == len(r["token_ids"]) > 0 for r in docs.collect())
    docs = no_docs
    for _, stage in c.STAGES:
        docs = saved(stage(spark, docs, SF))
        assert docs.count() == 0


def test_run_is_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in c.STAGES:
        docs = saved(stage(spark, docs, SF))
    one, other = (sorted(map(tuple, d.select("doc_id", "n_tokens").collect())) for d in (docs, c.run(spark, SF)))
    assert one == other and one
